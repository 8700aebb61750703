"""Readers.  Schemas are explicit, nothing is inferred, bad cells stay visible for the contracts."""

from __future__ import annotations

from csv import reader as csv_lines

from pyspark.sql import functions as F, types as T

from crewgrid.functions.text import front_matter
from crewgrid.sources.contracts import check_header


def _header(spark, path):
    """Header names as written.  Only the first line of one file is read."""
    line = spark.read.text(path).limit(1).collect()
    return [c.strip() for c in next(csv_lines([line[0][0].lstrip("\ufeff")]), [])] if line else []


def csv(spark, path, columns, mode="set", types=None, forbidden=()):
    """CSV with a checked header.  Every column arrives as text plus `_corrupt` for
    ragged rows; types ({column: type}) adds null-on-failure casts and keeps the text as <column>_raw."""
    found = _header(spark, path)
    check_header(found, columns, mode, forbidden)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in found] + [T.StructField("_corrupt", T.StringType())])
    df = spark.read.schema(schema).options(header=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt", enforceSchema=True, encoding="UTF-8").csv(path)
    for c, t in (types or {}).items():
        df = df.withColumn(f"{c}_raw", F.col(c)).withColumn(c, F.col(c).try_cast(t))
    return df


def panel(spark, path, columns, types=None):
    """A person-month panel as CSV.  Extra columns are allowed, but none that describes a protected trait or comes from surveillance."""
    from crewgrid.sources.rulesets import FORBIDDEN

    return csv(spark, path, columns, "min", types, FORBIDDEN)


def parquet(spark, path, columns=None):
    df = spark.read.parquet(path)
    if columns:
        check_header(df.columns, columns, "min")
    return df


def json(spark, path, schema, multiline=True):
    return spark.read.schema(schema).option("multiLine", multiline).json(path)


EVENT = T.StructType([
    T.StructField("ts", T.StringType()), T.StructField("actor", T.StructType([T.StructField(c, T.StringType()) for c in ("id", "display", "kind", "role")])),
    T.StructField("channel", T.StringType()), T.StructField("type", T.StringType()), T.StructField("scope", T.StringType()), T.StructField("requires_approval", T.BooleanType()), T.StructField("gated", T.BooleanType()),
    T.StructField("approval", T.StructType([T.StructField("decision", T.StringType()), T.StructField("entitled", T.BooleanType()), T.StructField("by", T.StringType()), T.StructField("scope", T.StringType()), T.StructField("registry_version", T.StringType())])),
    T.StructField("correlation_id", T.StringType()), T.StructField("causation_id", T.StringType()), T.StructField("idempotency_key", T.StringType()), T.StructField("schema_version", T.StringType()),
    T.StructField("sequence", T.LongType()), T.StructField("prev_hash", T.StringType()), T.StructField("event_id", T.StringType()), T.StructField("event_hash", T.StringType()), T.StructField("hmac", T.StringType()),
])


def ledger_lines(spark, path):
    """JSONL ledger: the raw line is kept, because digests cover it byte for byte."""
    raw = spark.read.text(path).where(F.trim("value") != "").select(F.trim("value").alias("line"), F.col("_metadata.file_path").alias("ledger_id"))
    return raw.withColumn("e", F.from_json("line", EVENT)).withColumn("well_formed", F.try_parse_json("line").isNotNull())


def ledger_stream(spark, path, **options):
    return spark.readStream.options(**options).text(path).where(F.trim("value") != "").select(F.trim("value").alias("line")).withColumn("e", F.from_json("line", EVENT))


def notes(spark, path, root=""):
    """Front-matter notes: provenance comes from the real path, never from the note."""
    t = spark.read.text(path, wholetext=True).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("path"))
    source = F.regexp_replace(F.regexp_replace(F.col("path"), f"^.*?{root}/", ""), r"\.md$", "")
    m = front_matter(F.col("text"))
    return t.select("text", source.alias("source"), m.alias("front"), F.lit(True).alias("loaded_from_disk"), m["topic"].alias("topic"), m["status"].alias("status"), m["content_type"].alias("content_type"),
                    F.coalesce(m["last_reviewed"], m["last-reviewed"]).alias("last_reviewed"), F.regexp_replace(F.regexp_replace("text", r"(?s)^---\n.*?\n---", ""), r"^\s+|\s+$", "").alias("statement"))


METRIC = "id string, name string, domain string, unit string, metric_class string, formula string, allowed_actions array<string>, forbidden_actions array<string>, params map<string,double>"


def metric_catalogue(spark, path):
    return spark.read.schema(f"schema_version string, metrics array<struct<{METRIC.replace(' string', ': string').replace(' array', ': array').replace(' map', ': map')}>>").option("multiLine", True).json(path).select(F.inline("metrics"))


def metric_param(catalogue, metric_id, key, default=None):
    """Threshold of a metric as a one-row frame."""
    return catalogue.where(F.col("id") == metric_id).agg(F.coalesce(F.max(F.col("params")[key]), F.lit(default).cast("double")).alias("value"))


def may(catalogue, metric_id, action):
    return catalogue.where(F.col("id") == metric_id).select(F.array_contains("allowed_actions", action).alias("allowed"))


def file_digests(spark, path, pattern=None):
    from crewgrid.operators.lineage import file_snapshot

    return file_snapshot(spark, path, pattern)


PVP = T.StructType([
    T.StructField("fiscal_years", T.ArrayType(T.IntegerType())), T.StructField("fiscal_year_end", T.StringType()), T.StructField("price_by_date", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("neos", T.ArrayType(T.StructType([
        T.StructField("id", T.StringType()), T.StructField("role", T.StringType()), T.StructField("is_peo", T.BooleanType()),
        T.StructField("sct", T.MapType(T.StringType(), T.StructType([T.StructField(c, T.DoubleType()) for c in ("total", "stock_awards", "option_awards")]))),
        T.StructField("pension_adjustment_by_fy", T.MapType(T.StringType(), T.StructType([T.StructField(c, T.DoubleType()) for c in ("service_cost", "prior_service_cost", "change_in_actuarial_pv")]))),
        T.StructField("tranches", T.ArrayType(T.StructType([
            T.StructField("id", T.StringType()), T.StructField("type", T.StringType()), T.StructField("grant_fy", T.IntegerType()), T.StructField("grant_date", T.DateType()), T.StructField("vest_date", T.DateType()),
            T.StructField("forfeited", T.BooleanType()), T.StructField("forfeit_date", T.DateType()), T.StructField("shares", T.DoubleType()), T.StructField("target_shares", T.DoubleType()), T.StructField("strike", T.DoubleType()),
            T.StructField("expiry", T.DateType()), T.StructField("performance_end", T.DateType()), T.StructField("earned_payout_pct", T.DoubleType()), T.StructField("dividends_paid_unvested_by_fy", T.MapType(T.StringType(), T.DoubleType())),
        ]))),
    ]))),
])


def award_tables(spark, path):
    """Nested award document to flat tables: sct, tranches, pension, dividends, prices."""
    doc = json(spark, path, PVP).select("*", F.xxhash64(F.col("_metadata.file_path")).alias("company_id"))
    neo = doc.select("company_id", F.inline("neos"))
    sct = neo.select("company_id", F.col("id").alias("neo_id"), F.coalesce("is_peo", F.lit(False)).alias("is_peo"), F.explode("sct").alias("fy", "s")).select("company_id", "neo_id", "is_peo", F.col("fy").cast("int").alias("fy"), "s.total", F.coalesce("s.stock_awards", F.lit(0.0)).alias("stock_awards"), F.coalesce("s.option_awards", F.lit(0.0)).alias("option_awards"))
    t = neo.select("company_id", F.col("id").alias("neo_id"), F.explode("tranches").alias("t"))
    tranches = t.select("company_id", "neo_id", F.col("t.id").alias("tranche_id"), "t.type", "t.grant_fy", "t.grant_date", "t.vest_date", F.coalesce("t.forfeited", F.lit(False)).alias("forfeited"), "t.forfeit_date",
                        F.coalesce("t.shares", "t.target_shares").alias("shares"), "t.strike", "t.expiry", F.coalesce("t.performance_end", "t.vest_date").alias("performance_end"), F.col("t.earned_payout_pct").alias("earned_pct"))
    div = t.select("company_id", "neo_id", F.explode("t.dividends_paid_unvested_by_fy").alias("fy", "d")).groupBy("company_id", "neo_id", F.col("fy").cast("int").alias("fy")).agg(F.sum("d").alias("dividends"))
    pension = neo.select("company_id", F.col("id").alias("neo_id"), F.explode("pension_adjustment_by_fy").alias("fy", "p")).select("company_id", "neo_id", F.col("fy").cast("int").alias("fy"), (F.col("p.service_cost") + F.col("p.prior_service_cost") - F.col("p.change_in_actuarial_pv")).alias("pension"))
    prices = doc.select("company_id", F.explode("price_by_date").alias("day", "price")).withColumn("day", F.col("day").cast("date"))
    return {"sct": sct, "tranches": tranches, "dividends": div, "pension": pension, "prices": prices}
