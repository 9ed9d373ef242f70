import hashlib
import random

import numpy as np
import pytest
from docs import ROWS, awkward, empty

from vectorloom.llm import substrings


def truth(rows, length=50):
    """Brute force over all strings."""
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        if i is not None:
            for k in range(len(b) - length + 1):
                s = b[k : k + length]
                first[s] = min(first.get(s, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if i is not None and first[b[k : k + length]] < i:
                gone[k : k + length] = True
        kept = bytes(v for v, g in zip(b, gone) if not g)
        runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def digest(df):
    return sorted(map(tuple, substrings.cut_digest(df).collect()), key=str)


def corpus(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choices("abcd é\n", k=n))
    shared = [text(rng.randint(48, 200)) for _ in range(8)]
    rows = []
    for i in range(60):
        t = ""
        for _ in range(rng.randint(0, 4)):
            t += text(rng.randint(0, 120)) + (s := rng.choice(shared))[rng.randint(0, 10) : len(s) - rng.randint(0, 10)]
        rows.append((i, t))
    rows += [(100 + i, rows[3][1]) for i in range(5)] + [(200, "aaaa" * 60), (201, "a" * 300), (202, "ab" * 100), (203, "ba" * 90 + "c")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, monkeypatch, seed):
    if seed >= 2:
        monkeypatch.setattr(substrings, "FLUSH", 40)
    if seed == 3:
        monkeypatch.setattr(substrings, "CELL", 5)
    rows = corpus(seed)
    assert digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == truth(rows)


def test_anchor_of_every_string():
    rng = np.random.default_rng(0)
    for alphabet in (2, 20, 256):
        data = rng.integers(0, alphabet, 500).astype(np.uint8)
        at, h = substrings.anchors(data)
        for k in range(len(data) - 49):
            inner_at, inner_h = substrings.anchors(data[k : k + 50])
            assert set(zip(inner_at + k, inner_h)) <= set(zip(at, h))


def test_awkward_texts(spark):
    assert digest(awkward(spark)) == truth([(r[0], r[1]) for r in ROWS])
    assert substrings.cut_digest(empty(spark)).count() == 0


def test_text_is_shuffled_once(spark, small):
    df = substrings.cut_digest(spark.read.parquet(f"{small}/documents.parquet"))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan
