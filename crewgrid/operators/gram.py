"""Cross-product sums for regressions: partial sums in tasks, one small total on the driver."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

MAX_TERMS = 200


def upper_sums(df, block, size):
    """Sum of the upper triangles that `block(pandas frame) -> (size x size) array` gives per batch.

    Each task adds its batches and emits one row per cell; cells are then summed
    by Spark.  The driver receives size*(size+1)/2 numbers, whatever the row count."""
    if size > MAX_TERMS:
        raise ValueError(f"{size} terms: use at most {MAX_TERMS}")
    iu = np.triu_indices(size)

    def part(batches):
        total = np.zeros((size, size))
        for pdf in batches:
            if len(pdf):
                total += block(pdf)
        yield pd.DataFrame({"cell": np.arange(len(iu[0]), dtype="int32"), "v": total[iu]})

    rows = df.mapInPandas(part, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()
    m = np.zeros((size, size))
    for r in rows:
        m[iu[0][r["cell"]], iu[1][r["cell"]]] = r["v"]
    return m + np.triu(m, 1).T


def solve(a, b, tol):
    """Dense solve that refuses a rank-deficient system."""
    s = np.linalg.svd(a, compute_uv=False)
    if s[-1] <= tol * max(1.0, s[0]):
        raise ValueError("singular system: a term has no variation of its own")
    return np.linalg.solve(a, b)


def ols(xtx, xty, yty, y_sum, n, absorbed=0, tss=None):
    """Coefficients, classical standard errors and R2 from sums alone (no second pass).

    Where sums are left after taking factors out, `absorbed` is the number of their effects and tss the
    variation of y before that."""
    p = len(xty)
    if n <= p + absorbed:
        raise ValueError(f"{n} rows for {p + absorbed} terms")
    inv = solve(xtx, np.eye(p), 1e-12)
    beta = inv @ xty
    rss = max(0.0, yty - beta @ xty)
    tss = yty - y_sum ** 2 / n if tss is None else tss
    se = np.sqrt(np.maximum(rss / (n - p - absorbed) * np.diag(inv), 0.0))
    return beta, se, float(1.0 - rss / tss if tss > 0 else 0.0)
