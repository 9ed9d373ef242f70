import itertools
import random

from vectorloom.llm import pages

HEAD = '<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body>'


def extracted(page):
    return pages.extract(pages.parse(page), set())


def test_one_page():
    page = HEAD + (
        "<header>Site</header><nav><ul><li><a href=/>Home</a><li>News</ul></nav><div class='cookie-notice'>We use cookies</div><!-- no -->"
        "<article class=\"post\"><h1>A  title &amp;amp;</h1><p><b>First&nbsp;line.<br><p>Second <i>li</i>ne\n two.<form><p>Mail? <input></form><aside>More</aside>"
        "<div class=ad>Buy</div><table><tr><td>one<td>two</table></article><section id=comments><article><p>I disagree</article></section><footer>&copy; me</footer></body></html>"
    )
    assert extracted(page) == "A title &amp;\n\nFirst line.\n\nSecond line two.\n\none\n\ntwo"
    assert extracted(page[: page.index("ne\n two")]).endswith("Second li")


def test_odd_pages():
    assert extracted("") == "" and extracted("just text & more") == "just text & more"
    assert extracted("<p>a<p>b</p></div>c") == "a\n\nb\n\nc"
    assert extracted("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert extracted('<p title="a>b">x</p><p>1 < 2') == "x\n\n1 < 2"
    assert extracted("<article><p>x<script>no") == "x"


def best(a, b):
    """Simple tree matching by trying everything."""
    if a.tag != b.tag:
        return 0
    most = 0
    for n in range(min(len(a.kids), len(b.kids)) + 1):
        for p in itertools.combinations(a.kids, n):
            for q in itertools.combinations(b.kids, n):
                w = [best(x, y) for x, y in zip(p, q)]
                if all(w):
                    most = max(most, sum(w))
    return 1 + most


def test_matching_is_best():
    rng = random.Random(5)

    def tree(depth):
        return "".join(f"<{t}>{tree(depth - 1)}</{t}>" for t in rng.choices(["div", "b", "i"], k=rng.randint(0, 3))) if depth else ""

    for _ in range(60):
        a, b = pages.parse(tree(3)), pages.parse(tree(3))
        pairs = pages.match(a, b)
        assert len(pairs) == best(a, b)
        assert len({id(x) for x, _ in pairs}) == len(pairs) == len({id(y) for _, y in pairs}) and all(x.tag == y.tag for x, y in pairs)


def test_template_is_learned(spark):
    page = "<html><body><div><p>Welcome to the site</p></div><div><p>story {0} begins</p><p>and {0} ends</p></div><div>All rights reserved</div></body></html>"
    rows = [(i, f"http://h.example/{i}", page.format(i)) for i in range(6)] + [(100, "http://other.example/", page.format("x")), (None, None, None), (7, "http://h.example/7", None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = {r.page_id: (r.text, r.n_chars) for r in pages.text_digest(df).collect()}
    for i in range(6):
        assert got[i] == (f"story {i} begins\n\nand {i} ends", len(f"story {i} begins\n\nand {i} ends"))
    assert got[100][0].startswith("Welcome") and got[None] == ("", 0) and got[7] == ("", 0)
    assert pages.text_digest(df.limit(0)).count() == 0


def test_join_and_broadcast_agree(spark, small, monkeypatch):
    df = spark.read.parquet(f"{small}/pages.parquet")
    first = sorted(map(tuple, pages.text_digest(df).collect()))
    monkeypatch.setattr(pages, "BROADCAST", 0)
    assert sorted(map(tuple, pages.text_digest(df).collect())) == first and len(first) == df.count()


def test_articles_of_the_table(spark, small):
    import re

    for r in pages.main_text(spark.read.parquet(f"{small}/pages.parquet")).join(spark.read.parquet(f"{small}/pages.parquet").select("page_id", "html"), "page_id").collect():
        body = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)[1]
        blocks = [" ".join(pages.html_lib.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"<p>|</?h1>|</p>", body)]
        assert r.text == "\n\n".join(b for b in blocks if b)


def test_near_copies_and_series_keep_every_paragraph(spark):
    body = "".join(f"<p>Paragraph {k} of the very same story, told at some length.</p>" for k in range(5))
    rows = [(i, f"http://copies.example/{i}", f"<body><nav>Menu</nav><article><h1>Day {i}</h1>{body}</article><footer>end</footer>") for i in range(4)]
    # the same without an article element: copies say nothing about the template
    rows += [(10 + i, f"http://plain.example/{i}", f"<body><div><h1>Day {i}</h1>{body}</div>") for i in range(4)]
    rows += [(20 + i, f"http://series.example/{i}", f"<body><article><p>In this series we look at rivers.</p><p class=legal>Free to copy.</p><p>{'river number %d ' % i * 30}</p></article>") for i in range(5)]
    got = {r.page_id: r.text for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    told = "\n\n".join(f"Paragraph {k} of the very same story, told at some length." for k in range(5))
    for i in range(4):
        assert got[i] == got[10 + i] == f"Day {i}\n\n{told}"
    for i in range(5):
        assert got[20 + i].startswith("In this series we look at rivers.\n\nFree to copy.\n\nriver number")


def test_template_despite_empty_and_unlike_references(spark):
    page = "<html><body><div><p>Welcome to the site</p></div><div><p>{0}</p></div><div>All rights reserved</div></body></html>"
    rows = [(0, "http://h.example/0", " "), (1, "http://h.example/1", "<html><body><h1>404</h1>")] + [(i, f"http://h.example/{i}", page.format(f"story number {i} " * 9)) for i in range(2, 40)]
    got = {r.page_id: r.text for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == " ".join(f"story number {i} ".split() * 9) for i in range(2, 40))


def test_unclosed_and_deep_elements():
    assert extracted("<article><p>a<svg><path><p>b</article>") == "a\n\nb"
    deep = "<article>" + "<div>" * 400 + "x" + "</div>" * 400 + "<p>y</article><nav>z</nav>"
    assert extracted(deep) == "x\n\ny"
    a, b = (pages.parse("<div>" * 3000 + f"<{t}></{t}>" + "</div>" * 3000) for t in "bi")
    assert len(pages.match(a, b)) == 3001


def test_many_siblings_are_matched_as_well_as_can_be():
    rng = random.Random(6)
    for n in (30, 700):
        p, q = ([rng.choice(["p", "b", "i", "p><u></u"]) for _ in range(n)] for _ in range(2))
        a, b = (pages.parse("<div>" + "".join(f"<{t}></{t[0]}>" for t in x) + "</div>") for x in (p, q))
        line = [0] * (n + 1)
        for x in p:
            above = line[:]
            for j, y in enumerate(q):
                w = 0 if x[0] != y[0] else 1 + (x == y and len(x) > 1)
                line[j + 1] = max(above[j + 1], line[j], above[j] + w)
        assert len(pages.match(a, b)) == 2 + line[n]
