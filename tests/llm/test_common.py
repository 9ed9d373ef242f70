import random

import pyarrow as pa

from vectorloom.llm import common


def test_groups_are_not_cut():
    rng = random.Random(2)
    for rows in (1, 5, 1000):
        keys = sorted(rng.choices(range(40), k=300))
        batches, at = [], 0
        while at < len(keys):
            n = rng.randint(0, 30)
            batches.append(pa.RecordBatch.from_arrays([pa.array(keys[at : at + n], pa.int64())], ["k"]))
            at += n
        got = [t.column(0).to_pylist() for t in common.whole_groups(iter(batches), rows=rows)]
        assert sum(got, []) == keys
        assert all(not set(a) & set(b) for i, a in enumerate(got) for b in got[:i])
    assert list(common.whole_groups(iter([]))) == []


def test_slices_are_bounded():
    texts = [None, "x" * 50, "", "y" * 500, "z" * 10] * 20
    batch = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array(texts)], ["i", "t"])
    pieces = list(common.slices(batch, "t", 200))
    assert sum((p.column(0).to_pylist() for p in pieces), []) == list(range(100))
    for p in pieces:
        assert p.num_rows == 1 or sum(len(t or "") for t in p.column(1).to_pylist()) <= 200
    assert list(common.slices(batch.slice(0, 0), "t")) == []


def test_one_thing_is_kept():
    made = []
    for key in "aabba":
        common.kept(key, lambda key=key: made.append(key) or key)
    assert made == ["a", "b", "a"]
    common.forget()
    common.kept("a", lambda: made.append("a"))
    assert len(made) == 4
