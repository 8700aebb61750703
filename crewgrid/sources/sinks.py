"""Sinks.  Spark's committer makes a write all-or-nothing; readers never see half a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from crewgrid.sources.contracts import ContractError


def parquet(df, path, partition_by=(), mode="overwrite"):
    w = df.write.mode(mode)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def csv(df, path, columns, mode="overwrite"):
    df.select(*columns).write.mode(mode).option("header", True).csv(path)


def json(df, path, mode="overwrite"):
    df.write.mode(mode).json(path)


def append_ledger(spark, path, rows, key="idempotency_key"):
    """Append new events to a Parquet ledger; keyed events already there are left out."""
    from crewgrid.operators.ledger import idempotent_append

    try:
        have = spark.read.parquet(path)
    except Exception as e:  # the first append creates the ledger
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        have = rows.limit(0)
    idempotent_append(have, rows, key).write.mode("append").parquet(path)


def write_anchor(spark, path, anchors, allow_rollback=False):
    """Checkpoint table per ledger; never lowers a count or rewrites a head unless told to."""
    try:
        old = spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        old = None
    if old is not None and not allow_rollback:
        o = old.groupBy("ledger_id").agg(F.max_by("head_hash", "count").alias("_h"), F.max("count").alias("_n"))
        j = anchors.join(o, "ledger_id", "right")
        bad = j.where(F.col("count").isNull() | (F.col("count") < F.col("_n")) | ((F.col("count") == F.col("_n")) & (F.col("head_hash") != F.col("_h")))).limit(8).collect()
        if bad:
            raise ContractError([{"rule": "anchor_rollback", "key": str(r["ledger_id"]), "detail": f"{r['_n']} -> {r['count']}"} for r in bad])
    anchors.write.mode("append").parquet(path)
