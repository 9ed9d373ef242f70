"""Personal data and secrets replaced by surrogates, with built-in functions only.

Detected are e-mail addresses, payment card numbers, phone numbers, IPv4 and IPv6 addresses, social security numbers,
IBANs, cloud access keys, ``password=``/``token =`` values, and names behind a title or led by a known given name. A full
name found in a text is replaced wherever it stands in that text, and so is its surname alone.

A surrogate is drawn from a keyed SHA-256 of the entity's normal form (letter case, spaces and punctuation aside), so
one entity gets one surrogate wherever and however it is written, and keeps its form: digits stay digits, letters keep
script and case, card numbers keep their first digit and card numbers and IBANs right check digits, phone numbers their country code, given
names their gender and script. Known given names are permuted; for others one is made of syllables, of another ending by
gender. Punctuation is that of the occurrence.

Collision checks: the distinct entities of all documents (found with map-side combining) get their surrogates; if two
share one, or one is itself an entity of the corpus, later ones draw again, until none is left. Only these exceptions,
normally none, are carried into the replacing pass; that pass is a projection without a shuffle.

The key is a secret of whoever runs this: an argument, or the session's ``spark.vectorloom.pii.key``. There is no default.

Defined results: a null text stays null and an empty one empty, both with n_entities 0; repeated rows are rewritten
alike; rows with null ids are rewritten too; other columns are kept by ``surrogates`` and not looked at, but for one named ``pii_kinds``, which is replaced.
"""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectorloom.llm.common import checkpointed

KEY_SETTING = "spark.vectorloom.pii.key"
#: Up to so many exceptions are carried as a literal; more are joined.
LITERAL = 1000

#: Given names by script and gender; each list is permuted by the key.
GIVEN = {
    "latin_f": "Anna Maria Laura Sophie Emma Julia Clara Elena Marie Camille Lucia Carmen Sarah Emily Mary Jane Linda Susan Karen Ingrid".split(),
    "latin_m": "James John Robert Michael David Peter Paul Thomas Hans Klaus Jean Pierre Louis Carlos Miguel Juan Pablo Andrew George Henry".split(),
    "cyrillic_f": "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана".split(),
    "cyrillic_m": "Иван Сергей Андрей Дмитрий Алексей Михаил Николай Павел".split(),
}
_SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ka ke ko la le lo ma me mo na ne no ra re ro sa se ta te to va vo".split(),
    "cyrillic": "ба бе бо да де до фа фе га го ка ке ко ла ле ло ма ме мо на не но ра ре ро са се та те то ва во".split(),
}
_TITLE_F, _TITLE_M, _TITLE_N = "Mrs|Ms|Miss|Mme|Mlle|Madame|Frau|Señora|Sra", "Mr|Herr|Monsieur|Señor", "Dr|Prof"
_WORD = r"\p{Lu}\p{Ll}+(?:-\p{Lu}\p{Ll}+)?"
_ALL_GIVEN = "|".join(n for names in GIVEN.values() for n in names)

#: What begins at a word's edge, by kind and in this order, each with the characters it may begin with; a text position
#: belongs to the first that matches there. Nothing gives back of an address's first part: it has no @.
_EDGED = {
    "email": ("", [r"[\p{L}\p{N}._%+-]{1,64}+@[\p{L}\p{N}-]{1,63}(?:\.[\p{L}\p{N}-]{1,63}){0,6}\.\p{L}{2,24}"]),
    "secret": ("[AaPpSsTt]", [r"(?i:password|passwd|pwd|token|secret|api_?key)(?: ?[=:] ?)\x22?(?=[A-Za-z_+/.-]*[0-9])[A-Za-z0-9_+/.-]{6,}\x22?"]),
    "aws": ("[A-Z]", [r"A[KS]IA[0-9A-Z]{16}\b"]),
    "iban": ("[A-Z]", [r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"]),
    "ipv6": ("[0-9A-Fa-f]{1,4}:", [r"(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}\b", r"(?=[A-Fa-f:]*[0-9])(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}\b"]),
    "ip": ("[0-9]", [r"(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})\b"]),
    "card": ("[0-9]", [r"[0-9](?:[ -]?[0-9]){12,18}\b"]),
    "ssn": ("[0-9]", [r"[0-9]{3}-[0-9]{2}-[0-9]{4}\b"]),
    "phone": ("[0-9]", [r"[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}\b"]),
    "name": (r"\p{Lu}", [rf"(?:{_TITLE_F}|{_TITLE_M}|{_TITLE_N})\.? {_WORD}(?: {_WORD})?", rf"(?:{_ALL_GIVEN}) {_WORD}"]),
}
#: What begins with a plus or a bracket, anywhere.
_LOOSE = {"phone": [r"(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}\b", r"\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}\b"]}
PATTERNS = {k: "|".join([*_LOOSE.get(k, []), *(rf"\b{p}" for p in ps)]) for k, (_, ps) in _EDGED.items()}
COMBINED = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Finds what ``COMBINED`` finds in about a fifth of the time: an edge is looked for once, and only what may begin with the next character is tried.
SEARCH = (
    r"\b(?:" + "|".join(f"(?={first})(?:{'|'.join(p for _, ps in group for p in ps)})" for first, group in groupby(_EDGED.values(), lambda x: x[0]))
    + ")|(?=[+(])(?:" + "|".join(_LOOSE["phone"]) + ")"
)


def _q(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _array(names: list[str]) -> str:
    return "array(" + ", ".join(map(_q, names)) + ")"


def _kind(m: str) -> str:
    cases = " ".join(f"WHEN {m} RLIKE {_q(f'^(?:{p})$')} THEN '{k}'" for k, p in PATTERNS.items())
    return f"CASE {cases} END"


_TITLE_RE = rf"^(?:(?:{_TITLE_F}|{_TITLE_M}|{_TITLE_N})\\.? )?"


def _parts(m: str) -> str:
    """What is replaced of an occurrence: array of (kind, normal form), one or, for names, given name and surname."""
    value = f"regexp_extract({m}, {_q('^[A-Za-z_]+ ?[=:] ?' + chr(34) + '?([^' + chr(34) + ']*)')}, 1)"
    rest = f"regexp_replace({m}, {_q(_TITLE_RE.replace(chr(92) * 2, chr(92)))}, '')"
    digits = f"regexp_replace({m}, '[^0-9]', '')"
    one = lambda k, v: f"array(named_struct('kind', '{k}', 'norm', {v}))"
    given = f"split({rest}, ' ')[0]"
    female = f"({m} RLIKE {_q(rf'^(?:{_TITLE_F})')} OR array_contains({_array(GIVEN['latin_f'] + GIVEN['cyrillic_f'])}, {given}))"
    return f"""CASE {_kind(m)}
      WHEN 'email' THEN {one('email', f'lower({m})')}
      WHEN 'secret' THEN {one('secret', value)}
      WHEN 'aws' THEN {one('aws', m)}
      WHEN 'iban' THEN {one('iban', f"replace({m}, ' ', '')")}
      WHEN 'ip' THEN {one('ip', m)}
      WHEN 'ipv6' THEN {one('ipv6', f'lower({m})')}
      WHEN 'card' THEN {one('card', digits)}
      WHEN 'ssn' THEN {one('ssn', digits)}
      WHEN 'phone' THEN {one('phone', digits)}
      WHEN 'name' THEN transform(split({rest}, ' '), (w, i) -> named_struct('kind',
        CASE WHEN i = size(split({rest}, ' ')) - 1 THEN 'surname' WHEN {female} THEN 'given_f' ELSE 'given_m' END, 'norm', w)) END"""


def _stream(kind: str, norm: str, attempt: str, key: str) -> str:
    """128 hexadecimal digits."""
    seed = f"concat_ws('|', {_q(key)}, {kind}, {norm}, cast({attempt} as string)"
    return f"concat(sha2({seed}, 'a'), 256), sha2({seed}, 'b'), 256))"


def _byte(h: str, i: str) -> str:
    return f"cast(conv(substring({h}, 1 + (2 * ({i})) % 126, 2), 16, 10) as int)"


def _swap(s: str, h: str) -> str:
    """Digit for digit and letter for letter of the same script and case."""
    b = _byte(h, "i")
    return f"""array_join(transform(split({s}, ''), (c, i) -> CASE
      WHEN c RLIKE '[0-9]' THEN cast({b} % 10 as string)
      WHEN c RLIKE '[a-z]' THEN char(97 + {b} % 26) WHEN c RLIKE '[A-Z]' THEN char(65 + {b} % 26)
      WHEN c RLIKE '[а-я]' THEN substring('абвгдежзийклмнопрстуфхцчшщъыьэюя', 1 + {b} % 32, 1)
      WHEN c RLIKE '[А-Я]' THEN substring('АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ', 1 + {b} % 32, 1)
      WHEN c RLIKE '[\\\\p{{L}}]' THEN char(97 + {b} % 26) ELSE c END), '')"""


def _hexed(s: str, h: str) -> str:
    return f"array_join(transform(split({s}, ''), (c, i) -> substring({h}, 1 + i % 128, 1)), '')"


def _luhn(body: str) -> str:
    """The check digit of a digit string."""
    total = f"""aggregate(transform(split(reverse({body}), ''), (c, i) -> CASE WHEN c = '' THEN 0 WHEN i % 2 = 1 THEN cast(c as int)
      ELSE cast(c as int) * 2 - CASE WHEN cast(c as int) > 4 THEN 9 ELSE 0 END END), 0, (a, x) -> a + x)"""
    return f"cast((10 - {total} % 10) % 10 as string)"


def _mod97(s: str) -> str:
    """The remainder of an IBAN's characters, letters as numbers from 10."""
    return f"aggregate(split({s}, ''), 0, (a, c) -> CASE WHEN c = '' THEN a WHEN c RLIKE '[0-9]' THEN (a * 10 + cast(c as int)) % 97 ELSE (a * 100 + ascii(c) - 55) % 97 END)"


def _rotated(names: list[str], w: str, attempt: str, key_of: str, key: str) -> str:
    """A permutation of the list; for a name outside one is made, never one of a list: long, and by gender with a vowel or
    a consonant at the end."""
    shift = 1 + sum(map(ord, key + key_of)) % (len(names) - 1)
    script, gender = key_of.split("_")
    made = f"array_join(transform(sequence(0, 3 + {attempt}), k -> {_array(_SYLLABLES[script])}[{_byte(_stream(_q(key_of), w, attempt, key), 'k')} % 32]), '')"
    if gender == "m":
        made = f"concat({made}, '{'n' if script == 'latin' else 'н'}')"
    return f"CASE WHEN array_contains({_array(names)}, {w}) THEN {_array(names)}[(cast(array_position({_array(names)}, {w}) as int) - 1 + {shift}) % {len(names)}] ELSE initcap({made}) END"


def _surname(w: str, h: str, attempt: str) -> str:
    made = lambda script: f"array_join(transform(sequence(0, 3 + {attempt}), k -> {_array(_SYLLABLES[script])}[{_byte(h, 'k')} % 32]), '')"
    return f"initcap(CASE WHEN {w} RLIKE '[а-яА-Я]' THEN {made('cyrillic')} ELSE {made('latin')} END)"


def surrogate_sql(kind: str, norm: str, attempt: str, key: str) -> str:
    """The surrogate of a normal form, as SQL over the names of three columns or lambda variables."""
    h = _stream(kind, norm, attempt, key)
    swap = _swap(norm, h)
    card = f"concat(substring({norm}, 1, 1), substring({swap}, 2, length({norm}) - 2))"
    country, bban = f"substring({norm}, 1, 2)", _swap(f"substring({norm}, 3)", h)
    account = f"substring({bban}, 3)"
    iban = f"concat({country}, lpad(cast(98 - {_mod97(f'concat({account}, {country}, {chr(39)}00{chr(39)})')} as string), 2, '0'), {account})"
    local, domain = f"split({norm}, '@')[0]", f"split({norm}, '@')[1]"
    labels = f"split({domain}, '[.]')"
    return f"""CASE {kind}
      WHEN 'email' THEN concat({_swap(local, h)}, '@', {_swap(f'{labels}[0]', _stream("'domain'", domain, '0', key))}, '.example.', {labels}[size({labels}) - 1])
      WHEN 'secret' THEN CASE WHEN {norm} RLIKE '^[0-9a-f]+$' THEN {_hexed(norm, h)} ELSE {swap} END
      WHEN 'aws' THEN concat(substring({norm}, 1, 4), {_swap(f'substring({norm}, 5)', h)})
      WHEN 'iban' THEN CASE WHEN {_mod97(f'concat(substring({norm}, 5), substring({norm}, 1, 4))')} = 1 THEN {iban} ELSE concat({country}, {bban}) END
      WHEN 'ipv6' THEN array_join(transform(split({norm}, ''), (c, i) -> CASE WHEN c IN (':', '') THEN c ELSE substring({h}, 1 + i % 128, 1) END), '')
      WHEN 'ip' THEN array_join(transform(sequence(0, 3), k -> cast(1 + {_byte(h, 'k')} % 254 as string)), '.')
      WHEN 'card' THEN concat({card}, CASE WHEN {_luhn(f'substring({norm}, 1, length({norm}) - 1)')} = substring({norm}, -1, 1) THEN {_luhn(card)} ELSE substring({swap}, -1, 1) END)
      WHEN 'phone' THEN concat(substring({norm}, 1, greatest(length({norm}) - 10, 0)), cast(2 + {_byte(h, '62')} % 8 as string), substring({swap}, greatest(length({norm}) - 10, 0) + 2))
      WHEN 'ssn' THEN {swap}
      WHEN 'given_f' THEN CASE WHEN {norm} RLIKE '[а-яА-Я]' THEN {_rotated(GIVEN['cyrillic_f'], norm, attempt, 'cyrillic_f', key)} ELSE {_rotated(GIVEN['latin_f'], norm, attempt, 'latin_f', key)} END
      WHEN 'given_m' THEN CASE WHEN {norm} RLIKE '[а-яА-Я]' THEN {_rotated(GIVEN['cyrillic_m'], norm, attempt, 'cyrillic_m', key)} ELSE {_rotated(GIVEN['latin_m'], norm, attempt, 'latin_m', key)} END
      WHEN 'surname' THEN {_surname(norm, h, attempt)} END"""


def _laid_out(m: str, chars: str, kept: str) -> str:
    """The characters set into the occurrence's format: what ``kept`` matches stays, the rest is taken in order."""
    return f"""array_join(transform(split({m}, ''), (c, i) -> CASE WHEN c RLIKE {_q(kept)} THEN c
      ELSE substring({chars}, length(regexp_replace(substring({m}, 1, i + 1), {_q(kept)}, '')), 1) END), '')"""


def _written(m: str, kind: str, made: str) -> str:
    """An occurrence with its surrogates (an array of strings) in place."""
    lead = f"regexp_extract({m}, {_q('^[A-Za-z_]+ ?[=:] ?' + chr(34) + '?')}, 0)"
    tail = f"CASE WHEN {m} LIKE '%\"' THEN '\"' ELSE '' END"
    title = f"regexp_extract({m}, {_q(_TITLE_RE.replace(chr(92) * 2, chr(92)))}, 0)"
    return f"""CASE WHEN {kind} IN ('card', 'ssn', 'phone') THEN {_laid_out(m, f'{made}[0]', '[^0-9]')}
      WHEN {kind} = 'ipv6' THEN CASE WHEN {m} RLIKE '[A-F]' THEN upper({made}[0]) ELSE {made}[0] END
      WHEN {kind} = 'iban' THEN {_laid_out(m, f'{made}[0]', ' ')}
      WHEN {kind} = 'secret' THEN concat({lead}, {made}[0], {tail})
      WHEN {kind} IN ('surname', 'given_f', 'given_m') THEN concat({title}, array_join({made}, ' '))
      ELSE {made}[0] END"""


def _matches(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(SEARCH), F.lit(0)), F.array().cast("array<string>"))


def _each_match(found: DataFrame) -> DataFrame:
    """A row for each element of ``found``, as ``m``. The outer form: for the inner one Spark adds a filter that repeats the search."""
    return found.withColumn("m", F.explode_outer("found")).drop("found").where("m IS NOT NULL")


def entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The distinct (kind, norm) of all texts."""
    found = _each_match(docs.select(_matches(F.col(text_col)).alias("found")))
    return found.select(F.explode(F.expr(_parts("m"))).alias("p")).select("p.kind", "p.norm").distinct()


#: Known given names are permuted within their lists, so they can't collide.
_PERMUTED = " OR ".join(f"kind = 'given_{g}' AND array_contains({_array(GIVEN[f'latin_{g}'] + GIVEN[f'cyrillic_{g}'])}, norm)" for g in "fm")


def exceptions(found: DataFrame, key: str, rounds: int = 20) -> DataFrame:
    """(kind, norm, attempt) of the entities whose first surrogates collide with another's or with an entity."""
    now = checkpointed(found.where(f"NOT ({_PERMUTED})").withColumn("attempt", F.lit(0)))
    for _ in range(rounds):
        made = now.withColumn("made", F.expr(surrogate_sql("kind", "norm", "attempt", key)))
        # who drew it first keeps it; entities themselves are always first
        claims = made.select("kind", F.lower("made").alias("at"), F.struct(F.lit(1).alias("late"), "attempt", "norm").alias("who")).unionByName(
            made.select("kind", F.lower("norm").alias("at"), F.struct(F.lit(0).alias("late"), F.lit(0).alias("attempt"), F.col("norm")).alias("who"))
        )
        first = claims.groupBy("kind", "at").agg(F.min("who").alias("first"), F.count("*").alias("n")).where("n > 1")
        again = made.withColumn("at", F.lower("made")).join(first, ["kind", "at"]).where("first.late = 0 OR first.norm <> norm").select("kind", "norm", F.lit(1).alias("more"))
        again = checkpointed(again)
        if again.isEmpty():
            return now.where("attempt > 0")
        now = checkpointed(now.join(again, ["kind", "norm"], "left").select("kind", "norm", (F.col("attempt") + F.coalesce("more", F.lit(0))).alias("attempt")))
    raise RuntimeError("surrogates still collide")


def _key(docs: DataFrame, key: str | None) -> str:
    found = key or docs.sparkSession.conf.get(KEY_SETTING, None)
    if not found:
        raise ValueError(f"surrogates need a key: give one, or set {KEY_SETTING}")
    return found


def _coreferent() -> Column:
    """Full names that were found in a text, then their surnames alone, replaced wherever else they stand in it."""
    people = "array_distinct(filter(__pii_new, x -> x.old IS NOT NULL))"
    pairs = f"concat(transform({people}, x -> named_struct('old', x.old, 'new', x.new)), transform(filter({people}, x -> length(x.last) > 2), x -> named_struct('old', x.last, 'new', x.new_last)))"
    edge = "concat('(?<![\\\\p{L}\\\\p{N}_])', p.old, '(?![\\\\p{L}\\\\p{N}_])')"
    return F.expr(f"CASE WHEN exists(__pii_new, x -> x.old IS NOT NULL) THEN aggregate({pairs}, __pii_text, (t, p) -> CASE WHEN contains(t, p.old) THEN regexp_replace(t, {edge}, p.new) ELSE t END) ELSE __pii_text END")


def surrogates(docs: DataFrame, text_col: str = "text", key: str | None = None) -> DataFrame:
    """All columns of the input, the text rewritten, and ``pii_kinds``: the kinds replaced, in text order."""
    key = _key(docs, key)
    order = [c for c in docs.columns if c != "pii_kinds"]
    docs = docs.select(*order)
    odd = exceptions(entities(docs, text_col), key)
    n = odd.count()
    source = docs.withColumn("__pii_found", _matches(F.col(text_col)))
    if n == 0:
        attempt = "0"
    elif n <= LITERAL:
        pairs = [F.lit(x) for r in odd.collect() for x in (f"{r.kind}|{r.norm}", r.attempt)]
        source = source.withColumn("__pii_odd", F.create_map(*pairs))
        attempt = "coalesce(element_at(__pii_odd, concat(p.kind, '|', p.norm)), 0)"
    else:
        keyed = _each_match(docs.select(F.sha2(F.col(text_col), 256).alias("__pii_key"), _matches(F.col(text_col)).alias("found")))
        hits = keyed.select("__pii_key", F.explode(F.expr(_parts("m"))).alias("p")).select("__pii_key", "p.*").distinct().join(odd, ["kind", "norm"])
        maps = hits.groupBy("__pii_key").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "kind", "norm"), "attempt"))).alias("__pii_odd"))
        source = source.withColumn("__pii_key", F.sha2(F.col(text_col), 256)).join(maps, "__pii_key", "left").drop("__pii_key")
        attempt = "coalesce(element_at(__pii_odd, concat(p.kind, '|', p.norm)), 0)"
    made = f"transform(ps, p -> {surrogate_sql('p.kind', 'p.norm', attempt, key)})"
    full = "size(ps) = 2 AND ps[1].kind = 'surname'"
    person = ", ".join(f"'{name}', CASE WHEN {full} THEN {value} END" for name, value in (("old", "concat(ps[0].norm, ' ', ps[1].norm)"), ("new", "array_join(made, ' ')"), ("last", "ps[1].norm"), ("new_last", "made[1]")))
    # nested one-element transforms bind a value once
    written = f"""transform(__pii_found, m -> transform(array({_parts('m')}), ps -> transform(array({made}), made -> named_struct('kind', CASE WHEN size(ps) > 0 AND ps[0].kind IN ('surname', 'given_f', 'given_m') THEN 'name' ELSE ps[0].kind END, 'text', {_written('m', 'ps[0].kind', 'made')}, {person}))[0])[0])"""
    source = source.withColumn("__pii_new", F.expr(f"CASE WHEN size(__pii_found) > 0 THEN {written} END"))
    between = F.split(F.col(text_col), SEARCH, -1)
    joined = F.array_join(F.transform(between, lambda b, i: F.concat(b, F.coalesce(F.get(F.col("__pii_new.text"), i), F.lit("")))), "")
    source = source.withColumn("__pii_text", F.when(F.size("__pii_found") > 0, joined).otherwise(F.col(text_col)))
    kinds = F.coalesce(F.col("__pii_new.kind"), F.array().cast("array<string>"))
    return source.withColumns({text_col: _coreferent(), "pii_kinds": kinds}).select(*order, "pii_kinds")


def surrogate_digest(docs: DataFrame, key: str | None = None) -> DataFrame:
    s = surrogates(docs.select("doc_id", "text"), key=key)
    return s.select("doc_id", "text", F.size("pii_kinds").alias("n_entities"), F.array_join("pii_kinds", ",").alias("kinds"))
