"""Choosing codes: how product quantizers of several sizes distort distances, on a bounded sample."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from vectorloom.operators import quantizers
from vectorloom.operators.training import sample

POOL, QUERIES = 20_000, 500


def code_report(base: DataFrame, sizes: list[tuple[int, int]], bound: float | None = None, k: int = 10) -> DataFrame:
    """One row a (m, bits): the median relative error of distances over the true k nearest, recall of the k best by
    code, recall counting all within the k-th distance, how many rows tie with the k-th and the 3k-th estimate, the
    correlation, and whether the size is the one to take: the smallest within the bound, else the least distorted.

    Works on at most POOL rows and QUERIES queries, chosen by a hash of the id."""
    x = sample(base, POOL)
    q = x[:: max(1, len(x) // QUERIES)][:QUERIES]
    true = ((q * q).sum(1)[:, None] - 2 * q @ x.T + (x * x).sum(1)).clip(0)
    nearest = np.argsort(true, 1, kind="stable")[:, : k + 1]
    rows = []
    for m, bits in sizes:
        code = quantizers.ProductQuantizer(m, bits).fit(x)
        back = code.decode(code.encode(x))
        estimate = ((q * q).sum(1)[:, None] - 2 * q @ back.T + (back * back).sum(1)).clip(0)
        at = np.arange(len(q))[:, None]
        d, e = np.sqrt(true[at, nearest]), np.sqrt(estimate[at, nearest])
        kth = true[at, nearest[:, k - 1 : k]]
        found = np.argsort(estimate, 1, kind="stable")[:, :k]
        hits = np.mean([len(set(a) & set(b)) / k for a, b in zip(found, nearest[:, :k])])
        ordered = np.sort(estimate, 1)
        ties = [float((np.isclose(ordered, ordered[:, min(j, ordered.shape[1]) - 1 :][:, :1], 1e-9)).sum(1).mean()) for j in (k, 3 * k)]
        some = slice(0, None, max(1, true.shape[1] // 200))
        rows.append((m, bits, float(np.median(np.abs(1 - e[d > 0] / d[d > 0]))), float(hits), float((true[at, found] <= kth).mean()), *ties, float(np.corrcoef(true[:, some].ravel(), estimate[:, some].ravel())[0, 1])))
    within = [r for r in rows if bound is not None and r[2] <= bound]
    best = min(within, key=lambda r: (r[0] * r[1], r[2])) if within else min(rows, key=lambda r: r[2])
    schema = "m int, bits int, distortion double, recall double, band_recall double, ties_k double, ties_3k double, correlation double, chosen boolean"
    return base.sparkSession.createDataFrame([(*r, r is best) for r in rows], schema)
