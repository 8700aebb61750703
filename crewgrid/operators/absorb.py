"""Regressions whose controls have any number of labels: their effects are taken out by group means, not written as columns.

People are first reduced to one row per combination of the factors, with the sums every regression needs.  The spread inside
such a cell does not touch the factors, so only the cells' means are projected.  One factor needs a single pass.  Several are
taken out in turn until nothing moves (alternating projections); each round adds up grouped sums and is cut off by a checkpoint."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from crewgrid.operators.gram import ols, upper_sums
from crewgrid.session import ensure_checkpoint_dir

TOLERANCE = 1e-11  # largest group mean left, against the spread of its column
ROUNDS = 2000


def cells(pop, target, factors, dummies, numeric):
    """One row per combination of the factors and dummy columns: n and the sums of y, the numeric columns and their products.

    dummies: {column: [labels that get a term]}; the label terms are constant inside a cell."""
    y = F.ln(F.col(target).cast("double"))
    v = {"y": y, **{f"x{i}": F.col(c).cast("double") for i, c in enumerate(numeric)}}
    names = list(v)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    keys = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"f{i}") for i, c in enumerate(factors)]
    rows = pop.select(*keys, *dummies, *[e.alias(c) for c, e in v.items()])
    g = rows.groupBy(*[f"f{i}" for i in range(len(factors))], *dummies).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in names], *[F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for a, b in pairs])
    labels = [(c, label) for c, got in dummies.items() for label in got]
    out = g.select(
        *[f"f{i}" for i in range(len(factors))], F.col("n").cast("double").alias("n"), *[F.coalesce((F.col(c) == label).cast("double"), F.lit(0.0)).alias(f"d{k}") for k, (c, label) in enumerate(labels)],
        *[(F.col(c) / F.col("n")).alias(c) for c in names], *[(F.col(f"{a}_{b}") - F.col(a) * F.col(b) / F.col("n")).alias(f"{a}_{b}") for a, b in pairs])
    columns = [f"d{k}" for k in range(len(labels))] + [f"x{i}" for i in range(len(numeric))] + ["y"]
    return out, columns, [f"{c}={label}" for c, label in labels] + list(numeric)


def merged(table, factor, least=1):
    """The cells with people of no label, or of a label that fewer than `least` people have, joined to the first label that has enough."""
    k = table.groupBy(factor).agg(F.sum("n").alias("_k"))
    enough = (F.col("_k") >= least) & (F.col(factor) != "")
    base = k.agg(F.min(F.when(enough, F.col(factor))).alias("_base"))  # one row
    few = k.where(~enough).select(factor, F.lit(True).alias("_few"))
    x = table.join(few, factor, "left").crossJoin(F.broadcast(base))
    return x.withColumn(factor, F.when(F.col("_few"), F.coalesce("_base", F.lit(""))).otherwise(F.col(factor))).drop("_few", "_base")


def centred(table, factors, columns):
    """The cells with every factor's means taken out of the columns, and the number of rounds.  Weighted by n."""
    spark = table.sparkSession
    ensure_checkpoint_dir(spark)
    whole = table.agg(F.sum("n").alias("n"), *[(F.sum(F.col("n") * F.col(c)) / F.sum("n")).alias(c) for c in columns]).collect()[0]
    table = table.withColumns({c: F.col(c) - F.lit(whole[c]) for c in columns}).checkpoint()
    spread = table.agg(*[F.sqrt(F.sum(F.col("n") * F.col(c) ** 2) / F.sum("n")).alias(c) for c in columns]).collect()[0]
    scale = {c: spread[c] or 1.0 for c in columns}
    for done in range(1, ROUNDS + 1):
        for f in factors:
            means = table.groupBy(f).agg(*[(F.sum(F.col("n") * F.col(c)) / F.sum("n")).alias(f"m_{c}") for c in columns])
            table = table.join(means, f).withColumns({c: F.col(c) - F.col(f"m_{c}") for c in columns})
            table = table.withColumn(f"_move_{f}", F.greatest(F.lit(0.0), *[F.abs(F.col(f"m_{c}")) / scale[c] for c in columns])).drop(*[f"m_{c}" for c in columns])
        table = table.checkpoint()
        move = table.agg(F.max(F.greatest(F.lit(0.0), *[F.col(f"_move_{f}") for f in factors]))).collect()[0][0] or 0.0
        table = table.drop(*[f"_move_{f}" for f in factors])
        if len(factors) == 1 or move <= TOLERANCE:
            return table, done
    raise ValueError(f"factors {factors} did not settle in {ROUNDS} rounds")


def effects(table, factors):
    """Number of independent effects of the factors: labels less one for each factor after the first.  Factors that hang together
    in several separate parts have fewer; the standard errors are then a little wide."""
    got = table.agg(*[F.count_distinct(f).alias(f) for f in factors]).collect()[0]
    return sum(got) - len(factors) + 1


def fit(pop, target, factors, dummies, numeric, least=1):
    """OLS of ln(target) on the dummy labels and numeric columns, every factor's labels held fixed.

    factors: columns with any number of labels; people of no label, or of one that fewer than `least` people
    have, count with the first label, as they do where labels are written out.  Gives the terms, coefficients, errors, n and
    R2 that `payfit.fit` gives with the factors written out; there is no intercept term."""
    table, columns, terms = cells(pop, target, factors, dummies, numeric)
    names = [f"f{i}" for i in range(len(factors))]
    for f in names:
        table = merged(table, f, least)
    ensure_checkpoint_dir(pop.sparkSession)
    table = table.checkpoint()
    n = table.agg(F.sum("n")).collect()[0][0] or 0.0
    if not n:
        raise ValueError("no rows")
    p = len(terms)
    shift = table.agg((F.sum(F.col("n") * F.col("y")) / F.sum("n"))).collect()[0][0]
    tss = table.agg(F.sum(F.col("n") * (F.col("y") - shift) ** 2 + F.col("y_y"))).collect()[0][0]
    within = {(a, b): f"{a}_{b}" for a in columns for b in columns if f"{a}_{b}" in table.columns}
    used = effects(table, names)
    inner, rounds = centred(table, names, columns)

    def block(pdf):
        x = pdf[columns].to_numpy(float)
        m = (x * pdf["n"].to_numpy(float)[:, None]).T @ x
        for (a, b), c in within.items():
            i, j = columns.index(a), columns.index(b)
            m[i, j] += pdf[c].sum()
            if i != j:
                m[j, i] += pdf[c].sum()
        return np.triu(m)

    m = upper_sums(inner, block, p + 1)
    beta, se, r2 = ols(m[:p, :p], m[:p, p], m[p, p], 0.0, n, used, tss)
    return {"terms": terms, "beta": beta, "se": se, "n": int(round(n)), "r2": r2, "rounds": rounds}
