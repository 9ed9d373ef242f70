import random

import numpy as np
import pytest
from docs import ROWS, awkward, empty

from vectorloom.llm import simhash


def sets(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def truth(rows):
    """Brute force over distinct texts."""
    first = {}
    for i, t in rows:
        first[t or ""] = min(i, first.get(t or "", i))
    ids, s = list(first.values()), [sets(t) for t in first]
    comp = dict(zip(ids, ids))
    for _ in range(len(ids)):
        before = dict(comp)
        for i in range(len(ids)):
            for j in range(i):
                if jaccard(s[i], s[j]) >= 0.8:
                    comp[ids[i]] = comp[ids[j]] = min(comp[ids[i]], comp[ids[j]])
        if comp == before:
            break
    return {i: comp[first[t or ""]] for i, t in rows}


def corpus(seed=4):
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(400)]
    rows = [" ".join(rng.choices(words, k=rng.randint(60, 300))) for _ in range(60)]
    for g in range(12):
        for _ in range(6):
            w = rows[g].split()
            for _ in range(rng.randint(1, 4)):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append(" ".join(w))
    rows += [rows[0]] * 20 + ["a b c", "a b c", "", "", "one"]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("cell", [2048, 6])
def test_against_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(simhash, "CELL", cell)
    rows = corpus()
    got = {r.doc_id: r.class_id for r in simhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == truth(rows)


def test_shingle_sets_are_those_of_words():
    rng = random.Random(9)
    for _ in range(50):
        a = " ".join(rng.choices("ab", k=rng.randint(0, 40))).replace("a b", "a\n b")
        b = " ".join(rng.choices("ab", k=rng.randint(0, 40)))
        x, y = simhash.shingles(a), simhash.shingles(b)
        assert len(x) == len(sets(a)) and len(np.intersect1d(x, y)) == len(sets(a) & sets(b))


def test_agreement_is_as_computed():
    rng = np.random.default_rng(1)
    found = []
    for _ in range(40):
        common, a, b = (rng.integers(0, 1 << 63, k, dtype=np.uint64) for k in (800, 100, 100))
        found.append((simhash.simhash(np.concatenate([common, a])) == simhash.simhash(np.concatenate([common, b]))).mean())
    assert abs(np.mean(found) - simhash.agreement(0.8)) < 0.01


def test_awkward_texts(spark):
    rows = simhash.classes(awkward(spark)).collect()
    assert len(rows) == len(ROWS)
    assert {r.doc_id: r.class_id for r in rows} == {1: 1, 2: 2, 3: 2, 4: 4, 5: 5, 6: 1, None: None}
    kept = simhash.keep_one(awkward(spark))
    assert kept.columns == awkward(spark).columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 4, 5]
    assert simhash.classes(empty(spark)).count() == 0


@pytest.mark.parametrize("cell", [2048, 6])
def test_short_texts_at_the_threshold(spark, monkeypatch, cell):
    monkeypatch.setattr(simhash, "CELL", cell)
    rng = random.Random(3)
    rows = []
    for n in (8, 8, 8, 8, 8, 12, 16, 40, 44, 48) * 12:
        words = [f"v{rng.randrange(10**6)}" for _ in range(n)]
        # n - 4 shingles, and a quarter more
        rows += [words, words + [f"v{rng.randrange(10**6)}" for _ in range((n - 4) // 4)]]
    rows = list(enumerate(" ".join(w) for w in rows))
    got = {r.doc_id: r.class_id for r in simhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i, _ in rows}


def test_tables_follow_the_true_agreement():
    assert simhash.disagreement(4, 0, 1) == 0.1875
    rng = np.random.default_rng(1)
    differ = [(simhash.simhash(h[:40]) != simhash.simhash(h)).mean() for h in rng.integers(0, 1 << 63, (200, 50), dtype=np.uint64)]
    assert abs(np.mean(differ) - simhash.disagreement(40, 0, 10)) < 0.004
    for n in (10_000, 30_000_000):
        assert simhash.found(*simhash.plan(n), simhash.miss(0.8)) >= simhash.RECALL


@pytest.mark.parametrize("cell", [2048, 6])
def test_withheld_pairs_are_not_lost(spark, monkeypatch, cell):
    """Every pair of a cell is a candidate, so each text is first verified against an unlike one."""
    monkeypatch.setattr(simhash, "CELL", cell)
    monkeypatch.setattr(simhash, "farthest", lambda bits, threshold: bits)
    rows = corpus(5)
    got = {r.doc_id: r.class_id for r in simhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == truth(rows)


def test_recall_at_the_threshold(spark, monkeypatch):
    """Pairs of exactly 0.8 by the tables and bits of a million texts."""
    real = simhash.plan
    monkeypatch.setattr(simhash, "plan", lambda n, threshold: real(1_000_000, threshold))
    rng = random.Random(8)
    rows = []
    for n in (8, 16, 44, 48, 404) * 60:
        words = [f"v{rng.randrange(10**6)}" for _ in range(n)]
        rows += [words, words + [f"v{rng.randrange(10**6)}" for _ in range((n - 4) // 4)]]
    rows = list(enumerate(" ".join(w) for w in rows))
    got = {r.doc_id: r.class_id for r in simhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[i] == i - i % 2 for i, _ in rows) >= 0.99 * len(rows)



def test_codes_of_long_texts_are_the_majority_of_signs(monkeypatch):
    """Counted a byte's worth at a time, nothing overflows; powers are worked out once."""
    rng = np.random.default_rng(9)
    for n in (0, 1, 2, 254, 255, 256, 510, 4080, 4096, 9000):
        h = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        lanes = np.arange(1, simhash.BITS // 64 + 1, dtype=np.uint64) * simhash._ODD
        signs = np.unpackbits(simhash.mixed(h[:, None] ^ lanes).view(np.uint8).reshape(n, simhash.BITS // 8), axis=1) if n else np.zeros((0, simhash.BITS))
        assert (simhash.simhash(h) == (2 * signs.sum(0, dtype=np.int64) > n)).all()
        same = np.repeat(h[:1], n)  # every coordinate's count is 0 or n
        assert (simhash.simhash(same) == (signs[0] > 0 if n else False)).all()
    long, word = b"x" * 70_000 + b" end of it", b"end"
    simhash.word_hashes(np.frombuffer(word, np.uint8))
    assert simhash.word_hashes(np.frombuffer(long, np.uint8))[1] == simhash.word_hashes(np.frombuffer(word, np.uint8))[0]
    monkeypatch.setattr(np, "cumprod", None)
    simhash.word_hashes(np.frombuffer(b"two words", np.uint8))
