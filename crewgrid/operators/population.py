"""Point-in-time populations and headcount over calendar spines."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from crewgrid.functions.dates import month_ends, trailing_year
from crewgrid.functions.numeric import half_even, ratio


@dataclass
class Workforce:
    """The frames one reporting date is computed from.  All stay lazy."""

    workers: DataFrame
    as_of: dt.date
    bands: DataFrame = None
    benefits: DataFrame = None
    cases: DataFrame = None
    financials: DataFrame = None
    params: dict = field(default_factory=dict)

    @property
    def employees(self):
        return self.workers.where("worker_type = 'employee'")

    @property
    def active(self):
        return self.employees.where(active_at(self.as_of))

    @property
    def clock(self):
        """Snapshot time of day for timestamped facts."""
        return dt.datetime.combine(self.as_of, dt.time(18, 0))


def day(d):
    return F.lit(d).cast("date")


def stamp(ts):
    return F.lit(ts.isoformat(sep=" ")).cast("timestamp_ntz")


def active_at(d):
    """hire <= d < term; a missing hire date never counts, a missing term date never ends."""
    d = d if not isinstance(d, dt.date) else day(d)
    return (F.col("hire_date") <= d) & (F.col("term_date").isNull() | (F.col("term_date") > d))


def within(c, start, end):
    """start < date <= end; null dates are outside."""
    return F.coalesce((F.col(c) > day(start)) & (F.col(c) <= day(end)), F.lit(False))


def matured(as_of, days):
    return F.col("hire_date") <= day(as_of - dt.timedelta(days=days))


def average_headcount_expr(as_of):
    """Mean of the active counts at the 12 month ends up to as_of's month, as
    one aggregate expression: no spine join, one pass, partial sums per task."""
    ends = month_ends(*trailing_year(as_of))
    total = sum((active_at(e).cast("int") for e in ends), F.lit(0))
    return F.sum(F.coalesce(total, F.lit(0))) / float(len(ends))


def turnover(wf, predicate, by=(), name="exits"):
    """Exits matching a predicate in the trailing year over average headcount, annualised."""
    start, end = trailing_year(wf.as_of)
    agg = wf.employees.groupBy(*by).agg(
        F.count_if(predicate & within("term_date", start, end)).alias(name),
        average_headcount_expr(wf.as_of).alias("avg_headcount"),
    )
    return agg.withColumn("rate_pct", half_even(100 * ratio(name, "avg_headcount", 0), 1))


def movements(employees, by=()):
    """Daily headcount changes per segment: the only pass over the workers that
    a series of any length needs.  Rows out: segments x days with a change."""
    e = employees.where("hire_date is not null")
    voluntary = F.coalesce(F.col("term_type") == "voluntary", F.lit(False))
    involuntary = F.coalesce(F.col("term_type") == "involuntary", F.lit(False))
    regret = F.coalesce(F.col("regrettable") == "yes", F.lit(False))

    def move(d, delta, hire, vol, inv, reg):
        return F.struct(
            F.col(d).alias("d"), F.lit(delta).alias("delta"), F.lit(hire).alias("hire"),
            F.lit(vol).cast("int").alias("vol"), F.lit(inv).cast("int").alias("inv"), F.lit(reg).cast("int").alias("reg"),
        )

    both = F.array(
        move("hire_date", 1, 1, False, False, False), move("term_date", -1, 0, voluntary, involuntary, regret)
    )
    m = e.select(*by, F.explode(both).alias("m")).where("m.d is not null")
    return m.groupBy(*by, F.col("m.d").alias("d")).agg(
        *[F.sum(f"m.{c}").alias(c) for c in ("delta", "hire", "vol", "inv", "reg")]
    )


def headcount_at(moves, dates, by=()):
    """Active count per segment and date from the daily changes (long form)."""
    cols = [F.sum(F.when(F.col("d") <= day(d), F.col("delta")).otherwise(0)).alias(str(d)) for d in dates]
    wide = moves.groupBy(*by).agg(*cols)
    return wide.unpivot(list(by), [str(d) for d in dates], "as_of", "headcount").withColumn("as_of", F.col("as_of").cast("date"))


def turnover_series(employees, as_ofs, by=()):
    """Turnover rates at many reporting dates in one job: as_of is a column, not a loop of jobs."""
    moves = movements(employees, by)
    blocks = []
    for a in as_ofs:
        start, end = trailing_year(a)
        ends = month_ends(start, end)
        hc = sum((F.when(F.col("d") <= day(e), F.col("delta")).otherwise(0) for e in ends), F.lit(0))
        inside = within("d", start, end)
        blocks.append(
            F.struct(
                day(a).alias("as_of"),
                (F.sum(hc) / float(len(ends))).alias("avg_headcount"),
                F.sum(F.when(F.col("d") <= day(a), F.col("delta")).otherwise(0)).alias("headcount"),
                *[F.sum(F.when(inside, F.col(c)).otherwise(0)).alias(n)
                  for c, n in (("vol", "voluntary_exits"), ("inv", "involuntary_exits"), ("reg", "regrettable_exits"), ("hire", "hires"))],
            )
        )
    rows = moves.groupBy(*by).agg(F.array(*blocks).alias("s")).select(*by, F.inline("s"))
    rate = lambda c: half_even(100 * ratio(c, "avg_headcount", 0), 1)
    return rows.select(
        *by, "as_of", "headcount", "hires", "voluntary_exits", "involuntary_exits", "regrettable_exits",
        half_even("avg_headcount", 6).alias("avg_headcount"),
        rate("voluntary_exits").alias("voluntary_pct"), rate("involuntary_exits").alias("involuntary_pct"),
        rate("regrettable_exits").alias("regrettable_pct"),
        rate(F.col("voluntary_exits") + F.col("involuntary_exits")).alias("total_pct"),
    )
