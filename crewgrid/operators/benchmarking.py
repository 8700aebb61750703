"""Pay elements of one subject against the peer distribution, role by role."""

from __future__ import annotations

from pyspark.sql import functions as F

from crewgrid.functions.numeric import half_even
from crewgrid.functions.ranking import mid_rank_percentile, quantiles

ROLES = ["CEO", "CFO", "COO", "CLO", "CHRO"]
MIN_PEERS = 6
NON_INCUMBENT = ["former", "outgoing", "interim", "retired"]
ELEMENTS = {  # element -> (expression, target band)
    "base": (lambda: F.col("salary"), 45, 55),
    "sti": (lambda: F.col("bonus") + F.col("non_equity_incentive"), 50, 60),
    "total_cash": (lambda: F.col("salary") + F.col("bonus") + F.col("non_equity_incentive"), 50, 60),
    "ltie": (lambda: F.col("stock_awards") + F.col("option_awards"), 50, 65),
    "tdc": (lambda: F.col("total"), 50, 65),
}
MONEY = ["salary", "bonus", "stock_awards", "option_awards", "non_equity_incentive", "other_comp"]


def with_total(rows):
    return rows.withColumn("total", sum((F.col(c) for c in MONEY[1:]), F.col(MONEY[0])))


def comparable(rows):
    """Comparable disclosure basis without the rows marked for exclusion."""
    return rows.where((F.col("disclosure") == "def14a") & ~F.startswith("row_caveat", F.lit("EXCLUDE:")))


def exclusion_counts(rows):
    foreign = F.col("disclosure") != "def14a"
    marked = ~foreign & F.startswith("row_caveat", F.lit("EXCLUDE:"))
    return rows.groupBy("role").agg(F.count_if(foreign).alias("foreign_rows"), F.count_if(marked).alias("marked_rows"), F.count(F.lit(1)).alias("rows"))


def incumbents(rows):
    """One row per (ticker, role): sitting title first, then higher total, then title.
    A max of a struct, so each task keeps one row per key before the shuffle."""
    sitting = ~F.lower("title").rlike("|".join(NON_INCUMBENT))
    key = F.struct(sitting.alias("sitting"), "total", "title", *[F.col(c) for c in MONEY], "row_id")
    best = rows.groupBy("ticker", "role").agg(F.max(key).alias("b"))
    return best.select("ticker", "role", "b.title", "b.total", *[f"b.{c}" for c in MONEY])


def long_elements(rows):
    pairs = F.array(*[F.struct(F.lit(k).alias("element"), e().cast("double").alias("pay")) for k, (e, _, _) in ELEMENTS.items()])
    return rows.select("ticker", "role", F.inline(pairs))


def positions(rows, subject, min_peers=MIN_PEERS):
    """Percentile of the subject's pay in each role and element against all peers.

    The subject has at most one row per role and element; it is looked up
    while the peers are counted, so the peers are aggregated once and never sorted whole."""
    rows = with_total(rows).where(F.col("role").isin(*ROLES))
    own = long_elements(incumbents(rows.where(F.col("ticker") == subject))).select("role", "element", F.col("pay").alias("subject_pay"))
    peers = long_elements(incumbents(comparable(rows.where(F.col("ticker") != subject))))
    q = quantiles(peers, "pay", {"p25": 0.25, "median": 0.5, "p75": 0.75}, ["role", "element"])
    place = peers.join(own, ["role", "element"]).groupBy("role", "element", "subject_pay").agg(
        F.count_if(F.col("pay") < F.col("subject_pay")).alias("_b"), F.count_if(F.col("pay") == F.col("subject_pay")).alias("_e"), F.count(F.lit(1)).alias("peer_n"))
    x = place.where(F.col("peer_n") >= min_peers).join(q.drop("n_obs"), ["role", "element"])
    x = x.withColumn("percentile", half_even(mid_rank_percentile(F.col("_b"), F.col("_e"), F.col("peer_n")), 1))
    return x.select("role", "element", "subject_pay", "peer_n", "p25", "median", "p75", "percentile", *status_columns())


def status_columns():
    pick = lambda i: F.create_map(*[F.lit(v) for k, e in ELEMENTS.items() for v in (k, float(e[i]))])[F.col("element")]
    lo, hi, p = pick(1), pick(2), F.col("percentile")
    status = F.when(p < lo, "below").when(p > hi, "above").otherwise("within")
    gap = F.when(p < lo, half_even(lo - p, 1)).when(p > hi, half_even(p - hi, 1)).otherwise(0.0)
    return [lo.alias("target_lo"), hi.alias("target_hi"), status.alias("status"), gap.alias("gap")]


def worst_gaps(pos):
    order = F.array_position(F.array(*[F.lit(k) for k in ELEMENTS]), F.col("element"))
    return pos.where("status = 'below'").orderBy(F.desc("gap"), "role", order)


def gap_concentration(pos):
    """Share of below-target positions that are equity elements, with its reading."""
    a = pos.agg(F.count_if(F.col("status") == "below").alias("below"),
                F.count_if((F.col("status") == "below") & F.col("element").isin("ltie", "tdc")).alias("equity_below"),
                F.count(F.lit(1)).alias("positions"))
    n, e = F.col("below"), F.col("equity_below")
    text = F.when(n == 0, "none").when(e == n, "all equity").when(e * 2 >= n, "mostly equity").when(e == 0, "all cash").otherwise("spread")
    return a.select("positions", "below", "equity_below", text.alias("concentration"))


def position_violations(pos):
    """Rows whose percentile, status and gap do not agree."""
    p, lo, hi = F.col("percentile"), F.col("target_lo"), F.col("target_hi")
    want = F.when(p < lo, "below").when(p > hi, "above").otherwise("within")
    gap = F.when(p < lo, half_even(lo - p, 1)).when(p > hi, half_even(p - hi, 1)).otherwise(0.0)
    bad = ~p.between(0, 100) | (F.col("status") != want) | (F.abs(F.col("gap") - gap) > 1e-9) | (F.col("p25") > F.col("median")) | (F.col("median") > F.col("p75"))
    return pos.where(bad).select(F.lit("position_agrees").alias("rule"), F.concat_ws("/", "role", "element").alias("key"))


def position_totals_violations(result_counts, pos, suppressed):
    """One-row counts against the positions; suppressed roles must not be positioned."""
    n = pos.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "below").alias("b"), F.count_distinct("role", "element").alias("d"))
    ties = n.crossJoin(result_counts).where((F.col("n") != F.col("n_positions")) | (F.col("b") != F.col("n_below_target")) | (F.col("d") != F.col("n")))
    both = suppressed.join(pos.select("role").distinct(), "role", "left_semi")
    high = suppressed.where(F.col("peer_n") >= MIN_PEERS)
    row = lambda df, rule, key: df.select(F.lit(rule).alias("rule"), key.alias("key"))
    return row(ties, "totals_tie", F.lit("result")).unionByName(row(both, "suppressed_not_positioned", F.col("role"))).unionByName(row(high, "suppressed_below_floor", F.col("role")))
