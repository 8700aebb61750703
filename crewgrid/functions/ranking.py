"""Exact ranks, quantiles and row numbers that never sort a whole group in one task.

A window over a whole table (or over one hot key) sorts it in a single task.
Here rows are first reduced to one row per distinct value with a count, then
cut into value ranges at split points.  Only the per-range totals, whose number
is fixed by the split count, are added up in order; the running count inside a
range is an ordinary window over (keys, range).  A value that holds a third of
all rows is one row after the count, and a key that holds a third of all rows
is spread over all ranges.  Split points only balance the work: results do not
depend on them.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Window, functions as F, types as T

_INF = float("inf")


def split_points(df, value, parts=None):
    """Approximate quantiles of a column, used as range bounds."""
    if parts is None:
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(parts, 2000))
    if parts == 1:
        return []
    if not _measured(df, value):
        # values without a measure: every k-th of a random sample, compared as they are
        v = df.select(F.col(value).alias("v")).where("v is not null")
        parts = min(parts, 200)
        share = min(1.0, 40.0 * parts / max(1, v.count()))
        got = sorted(r["v"] for r in v.sample(share, seed=7).limit(80 * parts).collect())
        return sorted(set(got[len(got) // parts::max(1, len(got) // parts)])) if got else []
    v = df.select(F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    pts = v.approxQuantile("v", [i / parts for i in range(1, parts)], 0.5 / parts)
    return sorted(set(pts))


def _measured(df, value):
    return isinstance(df.schema[value].dataType, (T.NumericType, T.TimestampType, T.BooleanType))


def add_range(df, value, splits, out="_range"):
    """Range number of a value; equal values always fall in the same range."""
    if not splits:
        return df.withColumn(out, F.lit(0.0))
    if not _measured(df, value):
        bounds = F.array(*[F.lit(s) for s in splits])
        return df.withColumn(out, F.size(F.filter(bounds, lambda s: s <= F.col(value))).cast("double"))
    b = Bucketizer(splits=[-_INF, *splits, _INF], inputCol="_range_in", outputCol=out, handleInvalid="keep")
    return b.transform(df.withColumn("_range_in", F.col(value).cast("double"))).drop("_range_in")


def running_totals(df, keys, value, weights, splits=None):
    """Exclusive running sums below_<w> and key totals total_<w>, in value order.
    `df` holds one row per (keys, value)."""
    keys = list(keys)
    if splits is None:
        splits = split_points(df, value)
    r = add_range(df, value, splits)
    totals = r.groupBy(*keys, "_range").agg(*[F.sum(w).alias(f"_s_{w}") for w in weights])
    over = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = over.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(
        *keys, "_range",
        *[F.coalesce(F.sum(f"_s_{w}").over(before), F.lit(0)).alias(f"_b_{w}") for w in weights],
        *[F.sum(f"_s_{w}").over(over).alias(f"total_{w}") for w in weights],
    )
    inside = Window.partitionBy(*keys, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    for w in weights:
        r = r.withColumn(f"_i_{w}", F.coalesce(F.sum(w).over(inside), F.lit(0)))
    out = _join_null_safe(r, base, ["_range", *keys])
    for w in weights:
        out = out.withColumn(f"below_{w}", F.col(f"_b_{w}") + F.col(f"_i_{w}"))
    return out.drop("_range", *[f"_{p}_{w}" for p in "bi" for w in weights])


def _running(df, keys, value, weight, splits):
    out = running_totals(df, keys, value, [weight], splits)
    return out.withColumnsRenamed({f"below_{weight}": "below", f"total_{weight}": "total"})


def _join_null_safe(left, right, on):
    """Inner join that treats null keys as one group."""
    r = right.withColumnsRenamed({c: f"_r_{c}" for c in on})
    cond = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on]
    return left.join(r, cond).drop(*[f"_r_{c}" for c in on])


def value_ranks(df, value, keys=(), splits=None, weight=None):
    """One row per (keys, value): n = rows with it, below = rows under it, total = rows of the key."""
    keys = list(keys)
    df = df.where(F.col(value).isNotNull())
    if splits is None:
        splits = split_points(df, value)
    n = F.sum(weight) if weight is not None else F.count(F.lit(1))
    counts = df.groupBy(*keys, value).agg(n.alias("n"))
    return _running(counts, keys, value, "n", splits)


def value_ranks_small(df, value, keys, extra=()):
    """Same columns per row for groups whose size is fixed by construction
    (a peer group of at most a few dozen rows)."""
    w = Window.partitionBy(*keys)
    under = w.orderBy(value).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        df.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*keys, value)))
        .withColumn("below", F.count(F.lit(1)).over(under) - F.col("n"))
        .withColumn("total", F.count(F.lit(1)).over(w))
    )


def average_rank_percentile(below="below", n="n", total="total"):
    """0..100, ties share the average rank, the value itself is in the population."""
    t = F.col(total) - 1
    return 100.0 * (F.col(below) + (F.col(n) - 1) / 2.0) / F.when(t > 0, t)


def mid_rank_percentile(below, equal, total):
    """0..100, half of the ties count, the value itself is not in the population."""
    return 100.0 * (below + 0.5 * equal) / F.when(total > 0, total)


def strict_below_percentile(below, total):
    return 100.0 * below / F.when(total > 0, total)


def _value_at(index, value):
    hit = (F.col("below") <= index) & (index < F.col("below") + F.col("n"))
    return F.max(F.when(hit, F.col(value)))


def quantiles(df, value, probs, keys=(), splits=None, method="linear"):
    """Exact quantiles.  probs: {output name: q}.  One row per key.

    linear: interpolate between the two neighbours.
    nearest: the value at index round-half-even(q * (n - 1))."""
    keys = list(keys)
    r = value_ranks(df.select(*keys, F.col(value).cast("double").alias("_v")), "_v", keys, splits)
    aggs, outs = [F.max("total").alias("n_obs")], []
    for name, q in probs.items():
        p = F.lit(float(q)) * (F.col("total") - 1)
        if method == "nearest":
            aggs.append(_value_at(F.bround(p, 0), "_v").alias(name))
            outs.append(F.col(name))
        else:
            lo = F.floor(p)
            aggs += [
                _value_at(lo, "_v").alias(f"_lo_{name}"),
                _value_at(F.ceil(p), "_v").alias(f"_hi_{name}"),
                F.max(p - lo).alias(f"_f_{name}"),
            ]
            outs.append(
                (F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * F.col(f"_f_{name}")).alias(name)
            )
    return r.groupBy(*keys).agg(*aggs).select(*keys, "n_obs", *outs)


def row_numbers(df, order, keys=(), out="row_no", splits=None):
    """1-based row number in the order of a column that is unique within keys,
    without sorting a whole group in one task."""
    keys = list(keys)
    if splits is None:
        splits = split_points(df, order)
    r = _running(df.withColumn("_one", F.lit(1)), keys, order, "_one", splits)
    return r.withColumn(out, F.col("below") + 1).drop("_one", "below", "total")


def top_k(df, k, keys, order, out="rank_no"):
    """First k rows per key; Spark keeps at most k rows per task and key before it shuffles."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= k)


def carry_last(df, keys, order, flag, value, out="last_seen", splits=None):
    """Struct of the latest row strictly before this one (same keys, unique order
    column) that satisfies a flag; null when there is none.

    Like the running sums above: the last flagged row of each range is carried
    over the ranges of a key, so a key with most of the rows is still spread out."""
    keys = list(keys)
    if splits is None:
        splits = split_points(df, order)
    mark = F.when(flag, F.struct(F.col(order), *[F.col(v) for v in value]))
    r = add_range(df, order, splits).withColumn("_mark", mark)
    inside = Window.partitionBy(*keys, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    tails = r.groupBy(*keys, "_range").agg(F.max("_mark").alias("_tail"))
    over = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carry = tails.select(*keys, "_range", F.last("_tail", ignorenulls=True).over(over).alias("_carry"))
    r = r.withColumn("_near", F.last("_mark", ignorenulls=True).over(inside)).drop("_mark")
    return _join_null_safe(r, carry, [*keys, "_range"]).withColumn(out, F.coalesce("_near", "_carry")).drop("_near", "_carry", "_range")


def ordered_positions(df, value, tie, keys=(), out="pos", splits=None):
    """0-based position in (value, tie) order.  Equal values are numbered inside
    their block by ranges of the tie column, so a block may hold any share of the rows."""
    keys = list(keys)
    blocks = value_ranks(df, value, keys, splits).select(*keys, value, F.col("below").alias("_block"), F.col("total").alias("_total"))
    r = _running(df.withColumn("_one", F.lit(1)), [*keys, value], tie, "_one", split_points(df, tie)).drop("_one", "total")
    j = _join_null_safe(r, blocks, [*keys, value])
    return j.withColumn(out, F.col("_block") + F.col("below")).withColumnRenamed("_total", f"{out}_total").drop("_block", "below")
