"""Session helpers.

Every operator takes its settings from the session it is given.  The defaults
below only apply when this package builds the session itself (tests, bench).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

INFERRED = "org.apache.spark.sql.catalyst.optimizer.InferFiltersFromGenerate"


def build_session(app="crewgrid", cores="*", shuffle_partitions=8, memory="8g", extra=None):
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return guard(spark)


def ensure_checkpoint_dir(spark):
    """Use the shared folder the cluster names; fall back to a scratch folder
    only on a local master, where driver and executors share one disk."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="crewgrid-ckpt-")
    sc.setCheckpointDir(named)
    return named


def scratch_folder(spark):
    """A new folder in the shared checkpoint folder, for tables an iteration writes once and reads again."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/crewgrid-{uuid.uuid4().hex}"


def stored(df):
    """The frame, written once to the shared checkpoint folder and read again, for results that many branches use."""
    path = scratch_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def guard(spark):
    """Spark 4.1 may take a union of equally partitioned inputs for one partitioned
    input and then join it wrongly; this keeps unions plain.

    It also filters on the size of every exploded array below the explode, which evaluates the array twice and whatever the
    array is made of (parsed texts, say) once for each place that names it; explode drops empty arrays by itself."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    rules = [r for r in (spark.conf.get("spark.sql.optimizer.excludedRules", None) or "").split(",") if r.strip()]
    if INFERRED not in rules:
        spark.conf.set("spark.sql.optimizer.excludedRules", ",".join([*rules, INFERRED]))
    return spark


def table(spark, sf_dir, name):
    guard(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
