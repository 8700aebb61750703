"""Peer groups: size screens for one subject and citation-graph groups for every company at once."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from crewgrid.functions.numeric import half_even, log_closeness
from crewgrid.functions.ranking import top_k
from crewgrid.session import stored

FIT_WEIGHTS = {"revenue_usd": 0.5, "market_cap_usd": 0.3, "employees": 0.2}
SCREEN = {"revenue_mult": (0.5, 2.0), "market_cap_mult": (0.5, 2.0), "employees_mult": None,
          "group": "subindustry", "group_values": None, "min_criteria": None}
_FIELD = {"revenue": "revenue_usd", "market_cap": "market_cap_usd", "employees": "employees"}


def _check_band(name, band):
    lo, hi = band
    if not (math.isfinite(lo) and math.isfinite(hi) and 0 < lo <= hi):
        raise ValueError(f"{name} must satisfy 0 < lo <= hi")


def fit_score(weights, co, subj):
    """Weighted log-closeness on 0..100."""
    parts = [w * log_closeness(co(k), subj(k)) for k, w in weights.items()]
    return half_even(100.0 * sum(parts[1:], parts[0]), 1)


def fit_renormalised(weights, co, subj):
    """Same, with the weights rescaled over the fields both sides have."""
    num, den = F.lit(0.0), F.lit(0.0)
    for k, w in weights.items():
        have = co(k).isNotNull() & subj(k).isNotNull()
        num = num + F.when(have, w * log_closeness(co(k), subj(k))).otherwise(0.0)
        den = den + F.when(have, w).otherwise(0.0)
    return F.when(den > 0, half_even(100.0 * num / F.when(den > 0, den), 1)).otherwise(0.0)


def screen(companies, subject, criteria=None, renormalise=False):
    """Every candidate against one subject: a boolean per criterion, pass count,
    membership and fit.  The subject is one row, so the join is a broadcast of one row."""
    c = {**SCREEN, **(criteria or {})}
    active = [k for k in _FIELD if c[f"{k}_mult"]]
    for k in active:
        _check_band(f"{k}_mult", c[f"{k}_mult"])
    if c["group"] not in ("group", "sector", "subindustry", None):
        raise ValueError("group must be group, sector, subindustry or None")
    grouped = c["group"] is not None
    n_active = len(active) + grouped
    if not n_active:
        raise ValueError("a screen needs at least one active criterion")
    need = n_active if c["min_criteria"] is None else c["min_criteria"]
    if type(need) is not int or not 1 <= need <= n_active:
        raise ValueError("min_criteria outside 1..active criteria")
    one = companies.where(F.col("ticker") == subject).limit(1)
    keep = ["revenue_usd", "market_cap_usd", "employees", "sector", "subindustry"]
    one = one.select(*[F.col(k).alias(f"s_{k}") for k in keep])
    x = companies.where(F.col("ticker") != subject).crossJoin(F.broadcast(one))
    flags = []
    for k in active:
        lo, hi = c[f"{k}_mult"]
        f = _FIELD[k]
        x = x.withColumn(f"{k}_ok", F.col(f).between(F.col(f"s_{f}") * lo, F.col(f"s_{f}") * hi))
        flags.append(F.col(f"{k}_ok"))
    if grouped:
        if c["group"] == "group":
            ok = F.col("subindustry").isin(*c["group_values"])
        else:
            ok = F.col(c["group"]) == F.col("s_" + c["group"])
        x = x.withColumn("group_ok", ok)
        flags.append(F.col("group_ok"))
    passed = sum((f.cast("int") for f in flags), F.lit(0))
    member = F.col("pass_count") >= need
    if c["group"] == "group":
        member = member & F.col("group_ok")
    fit = (fit_renormalised if renormalise else fit_score)(FIT_WEIGHTS, F.col, lambda k: F.col(f"s_{k}"))
    return (
        x.withColumn("pass_count", passed).withColumn("is_peer", member).withColumn("fit", fit)
        .withColumn("revenue_distance", F.abs(F.col("revenue_usd") - F.col("s_revenue_usd")))
        .drop(*[f"s_{k}" for k in keep])
    )


def listing(screened):
    """Peers by fit, then everyone else by revenue distance; ticker settles ties."""
    second = F.when(F.col("is_peer"), -F.col("fit")).otherwise(F.col("revenue_distance").cast("double"))
    return screened.orderBy(F.desc("is_peer"), second, "ticker")


def exclusions(screened):
    """Every company that is not a peer, nearest misses first."""
    return screened.where(~F.col("is_peer")).orderBy(F.desc("pass_count"), F.desc("group_ok"), "revenue_distance", "ticker")


def core_and_watchlist(screened, core_n):
    """The core_n best fits are the core, every other peer goes on the watch list."""
    peers = screened.where("is_peer")
    core = peers.orderBy(F.desc("fit"), "ticker").limit(core_n).select("ticker", F.lit("core").alias("part"))
    return peers.join(core, "ticker", "left").withColumn("part", F.coalesce("part", F.lit("watchlist")))


def strict_percentile(peers, value, subject_value):
    """Share of peers strictly below the subject, 0..100."""
    return peers.agg((100.0 * F.count_if(F.col(value) < subject_value) / F.count(F.lit(1))).alias("percentile"))


def equal_width_histogram(df, value, n=5):
    """n equal-width buckets over min..max; the top edge belongs to the last bucket."""
    lim = df.agg(F.min(value).cast("double").alias("_lo"), F.max(value).cast("double").alias("_hi"))
    width = F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo")).otherwise(1.0) / n
    slot = F.least(F.floor((F.col(value) - F.col("_lo")) / width), F.lit(n - 1))
    h = df.crossJoin(F.broadcast(lim)).groupBy(slot.cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    frame = df.sparkSession.range(n).select(F.col("id").cast("int").alias("bucket"))
    return frame.join(h, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


# ---- citation graph, all subjects in one job --------------------------------


def first_degree(edges):
    """(subject, peer, cited, citing): companies the subject names, and companies that name it."""
    out = edges.select(F.col("src").alias("subject"), F.col("dst").alias("peer"), F.lit(1).alias("c"), F.lit(0).alias("n"))
    inn = edges.select(F.col("dst").alias("subject"), F.col("src").alias("peer"), F.lit(0).alias("c"), F.lit(1).alias("n"))
    fd = out.unionByName(inn).where("subject <> peer")
    return fd.groupBy("subject", "peer").agg(F.max("c").alias("cited"), F.max("n").alias("citing"))


def candidates(edges):
    """(subject, ticker, first_degree, citations) over direct and second-degree companies.

    A company's own citation list is one disclosed row, so expanding a first
    degree through it grows with the number of edges, not with its square.  The
    lists are joined as one array row per company: the build side is unique on
    the key, and a hot peer only repeats on the stream side, where AQE can split it."""
    fd = first_degree(edges)
    lists = edges.where("src <> dst").groupBy(F.col("src").alias("peer")).agg(F.collect_set("dst").alias("named"))
    second = fd.join(lists, "peer").select("subject", F.explode("named").alias("ticker"), F.lit(0).alias("first"), F.lit(1).alias("hits"))
    direct = fd.select("subject", F.col("peer").alias("ticker"), F.lit(1).alias("first"), (F.col("cited") + F.col("citing")).alias("hits"))
    both = direct.unionByName(second).where("subject <> ticker")
    return both.groupBy("subject", "ticker").agg(F.max("first").alias("first_degree"), F.sum("hits").alias("citations"))


PAIRS = 1_000_000  # about so many of them are added up in one task
ATTRIBUTES = ("revenue_usd", "market_cap_usd", "sector", "subindustry")


def sized_candidates(companies, edges, fits, **measures):
    """(subject, ticker, first_degree, citations, measures) over the `candidates` that fit their subject by size.

    fits and measures take (subject, candidate), each with the ATTRIBUTES.  Both sides' values are joined while rows are still as
    many as the edges: a peer's row holds itself and the companies it names, so a pair that does not fit is never shuffled, and
    no join runs over pairs.  Pairs are dealt before they are added up, to as many parts as the edges let expect pairs, so what a
    task holds does not grow with the input."""
    edges = stored(edges.select("src", "dst"))
    n, sources = edges.groupBy("src").count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.count(F.lit(1))).first()
    parts = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * n * n // max(1, sources) // PAIRS + 1)  # balances only
    attrs = lambda prefix="": [F.col(a).alias(f"{prefix}{a}") for a in ATTRIBUTES]
    company = companies.select(F.col("ticker").alias("peer"), F.struct("ticker", *attrs()).alias("own"))
    named = edges.where("src <> dst").join(companies.select(F.col("ticker").alias("dst"), F.struct("ticker", *attrs()).alias("x")), "dst")
    known = company.join(named.groupBy(F.col("src").alias("peer")).agg(F.collect_set("x").alias("named")), "peer", "full")
    fd = first_degree(edges).join(companies.select(F.col("ticker").alias("subject"), F.struct(*attrs()).alias("s")), "subject")
    hit = lambda x, first, hits: F.struct(x.alias("x"), F.lit(first).alias("first"), hits.cast("long").alias("hits"))
    direct = F.array_compact(F.array(F.when(F.col("own").isNotNull(), hit(F.col("own"), 1, F.col("cited") + F.col("citing")))))
    second = F.transform("named", lambda x: hit(x, 0, F.lit(1)))
    pairs = fd.join(known, "peer").select("subject", "s", F.inline(F.concat(direct, F.coalesce(second, F.array().cast(_hits(companies))))))
    pairs = pairs.where(F.col("subject") != F.col("x.ticker")).where(fits(F.col("s"), F.col("x")))
    pairs = pairs.select("subject", "x.ticker", "first", "hits", *[m(F.col("s"), F.col("x")).alias(k) for k, m in measures.items()])
    return pairs.repartition(parts, "subject", "ticker").groupBy("subject", "ticker").agg(F.max("first").alias("first_degree"), F.sum("hits").alias("citations"), *[F.max(k).alias(k) for k in measures])


def _hits(companies):
    kinds = ",".join(f"{a}:{companies.schema[a].dataType.simpleString()}" for a in ("ticker", *ATTRIBUTES))
    return f"array<struct<x:struct<{kinds}>,first:int,hits:bigint>>"


COMPARISON = {"revenue_mult": (0.4, 2.5), "market_cap_mult": (0.25, 4.0), "most": 24, "minimum": 12}


def comparison_groups(companies, edges, criteria=None):
    """Up to 24 size-screened companies per subject, closest industry first."""
    c = {**COMPARISON, **(criteria or {})}
    fits = lambda s, x: (x["revenue_usd"] / s["revenue_usd"]).between(*c["revenue_mult"]) & (x["market_cap_usd"] / s["market_cap_usd"]).between(*c["market_cap_mult"])
    tier = lambda s, x: F.when(x["subindustry"] == s["subindustry"], 0).when(x["sector"] == s["sector"], 1).otherwise(2)
    x = sized_candidates(companies, edges, fits, tier=tier, apart=lambda s, x: F.abs(x["revenue_usd"] - s["revenue_usd"]))
    return top_k(x, c["most"], ["subject"], ["tier", F.desc("first_degree"), "apart", "ticker"]).select("subject", "ticker", "first_degree", "rank_no")


COCITATION = {"cap_lo": 0.33, "cap_hi": 3.0, "most": 15, "minimum": 10}


def cocitation_groups(companies, edges, criteria=None):
    """Up to 15 companies per subject by citation count, inside a market-cap band."""
    c = {**COCITATION, **(criteria or {})}
    fits = lambda s, x: x["market_cap_usd"].between(c["cap_lo"] * s["market_cap_usd"], c["cap_hi"] * s["market_cap_usd"])
    x = sized_candidates(companies, edges, fits, apart=lambda s, x: F.abs(x["market_cap_usd"] - s["market_cap_usd"]))
    return top_k(x, c["most"], ["subject"], [F.desc("citations"), "apart", "ticker"]).select("subject", "ticker", "citations", "rank_no")


def group_overlap(left, right):
    """Size of both groups and of their intersection per subject."""
    a = left.select("subject", "ticker", F.lit(1).alias("a"), F.lit(0).alias("b"))
    b = right.select("subject", "ticker", F.lit(0).alias("a"), F.lit(1).alias("b"))
    p = a.unionByName(b).groupBy("subject", "ticker").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return p.groupBy("subject").agg(F.sum("a").alias("left_n"), F.sum("b").alias("right_n"), F.sum(F.col("a") * F.col("b")).alias("both_n"))
