"""Data contracts: named rules that list what is wrong instead of failing on the first row.

A contract never changes data.  `violations` is one projection over one scan;
checks across rows are grouped counts and anti-joins.  `require_clean` is the only action."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from crewgrid.functions.numeric import finite, whole


class ContractError(ValueError):
    """Raised when a source breaks its contract; carries the first few violations."""

    def __init__(self, rows):
        self.rows = rows
        super().__init__("; ".join(f"{r['rule']}[{r['key']}] {r['detail'] or ''}".strip() for r in rows))


# ---- header rules (driver side, names only)


def check_header(found, expected, mode="set", forbidden=()):
    """mode: set (same names, any order), order (same list), min (at least these)."""
    low = [c.strip().lower() for c in found]
    if len(set(low)) != len(low):
        raise ContractError([{"rule": "duplicate_header", "key": ",".join(found), "detail": None}])
    bad = {"set": set(found) != set(expected), "order": list(found) != list(expected), "min": not set(expected) <= set(found)}[mode]
    if bad:
        raise ContractError([{"rule": f"header_{mode}", "key": ",".join(found), "detail": "expected " + ",".join(expected)}])
    blocked = sorted(set(low) & {f.lower() for f in forbidden})
    if blocked:
        raise ContractError([{"rule": "protected_column", "key": ",".join(blocked), "detail": None}])


# ---- row rules


def violations(df, key, rules, detail=None):
    """rules: {name: boolean Column, true when bad}.  One row per broken rule."""
    hits = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules.items()]))
    k = key.cast("string") if not isinstance(key, str) else F.col(key).cast("string")
    d = F.lit(None).cast("string") if detail is None else detail
    return df.select(F.explode(hits).alias("rule"), k.alias("key"), d.alias("detail"))


def _row(df, rule, key, detail=None):
    d = F.lit(None).cast("string") if detail is None else detail.cast("string")
    return df.select(F.lit(rule).alias("rule"), key.cast("string").alias("key"), d.alias("detail"))


def duplicates(df, keys, rule="duplicate_key"):
    """Keys seen more than once, with their counts."""
    d = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return _row(d, rule, F.concat_ws("|", *keys), F.col("_n"))


def unknown_refs(df, column, roster, roster_column, rule="unknown_reference"):
    """Values of a column that the roster does not hold, one row per value."""
    used = df.select(F.col(column).alias("_v")).where("_v is not null").distinct()
    return _row(used.join(roster.select(F.col(roster_column).alias("_v")).distinct(), "_v", "left_anti"), rule, F.col("_v"))


def unknown_array_refs(df, column, roster, roster_column, rule="unknown_reference"):
    return unknown_refs(df.select(F.explode(column).alias("_e")), "_e", roster, roster_column, rule)


def roster_differences(left, right, column, rule="roster_differs"):
    """Values on one side only, from a single grouped pass over both sides."""
    a = left.select(F.col(column).alias("_v"), F.lit(1).alias("l"), F.lit(0).alias("r"))
    b = right.select(F.col(column).alias("_v"), F.lit(0).alias("l"), F.lit(1).alias("r"))
    g = a.unionByName(b).groupBy("_v").agg(F.max("l").alias("l"), F.max("r").alias("r")).where("l <> r")
    return _row(g, rule, F.col("_v"), F.when(F.col("l") == 1, "left only").otherwise("right only"))


def exactly_one(df, predicate, rule="exactly_one"):
    n = df.agg(F.count_if(predicate).alias("_n")).where("_n <> 1")
    return _row(n, rule, F.lit("table"), F.col("_n"))


def not_empty(df, rule="no_rows"):
    return _row(df.limit(1).agg(F.count(F.lit(1)).alias("_n")).where("_n = 0"), rule, F.lit("table"))


def quarter_spine(df, column, rule="spine_gap"):
    """Period ends must be unique calendar quarter ends without a gap.  The spine has one row per quarter."""
    w = Window.partitionBy(F.lit(0)).orderBy(column)
    n = df.groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    x = n.withColumn("_p", F.lag(column).over(w))
    q = lambda c: F.year(c) * 4 + F.quarter(c)
    bad = (F.col("_n") > 1) | (F.col(column) != F.last_day(column)) | (F.month(column) % 3 != 0) | (q(column) - q("_p") != 1)
    return _row(x.where(F.coalesce(bad, F.lit(False))), rule, F.col(column))


def union(*frames):
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def require_clean(found, show=8):
    """Raise with the first few violations; does nothing on a clean source."""
    rows = found.limit(show).collect()
    if rows:
        raise ContractError([r.asDict() for r in rows])


# ---- cell gates


def blank(c):
    return F.col(c).isNull() | (F.trim(F.col(c)) == "")


def not_number(c, positive=False, minimum=None):
    v = finite(c)
    bad = v.isNull()
    if positive:
        bad = bad | (v <= 0)
    if minimum is not None:
        bad = bad | (v < minimum)
    return bad


def not_whole(c, positive=False):
    v = whole(c)
    bad = v.isNull()
    return bad | (v <= 0) if positive else bad | (v < 0)


def not_date(c):
    """Strict ISO shape and a day that exists."""
    t = F.col(c).cast("string")
    return ~F.coalesce(t.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(t, "yyyy-MM-dd").isNotNull(), F.lit(False))


def not_in(c, values):
    return ~F.coalesce(F.col(c).isin(*values), F.lit(False))


def not_binary(c):
    return ~F.coalesce(F.col(c).isin(0, 1), F.lit(False))


def outside(c, lo, hi):
    v = finite(c)
    return v.isNull() | ~v.between(lo, hi)
