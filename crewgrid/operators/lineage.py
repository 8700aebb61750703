"""Evidence graph as tables: claims, sources and an edge list."""

from __future__ import annotations

from pyspark.sql import functions as F

from crewgrid.functions.hashing import canonical_json, sha256
from crewgrid.session import ensure_checkpoint_dir, scratch_folder


def _row(df, rule, key):
    return df.select(F.lit(rule).alias("rule"), key.cast("string").alias("key"))


def _rounds(start, step):
    """Semi-naive iteration.  Every round's new rows are written once to the shared
    folder; the next round reads what all rounds wrote.  Nothing is rewritten, and a
    lost executor only costs the round in progress."""
    spark = start.sparkSession
    path = scratch_folder(spark)
    start.write.parquet(f"{path}/round=0")
    schema = start.schema
    read = lambda k: spark.read.schema(schema).parquet(*[f"{path}/round={i}" for i in k])
    k = 0
    while True:
        k += 1
        new = step(read([k - 1])).join(read(range(k)), start.columns, "left_anti")
        new.select(*start.columns).write.parquet(f"{path}/round={k}")
        if read([k]).isEmpty():
            return read(range(k))  # every round adds rows, so this ends


def grounded_claims(edges):
    """Claims that reach at least one source.  Only the newly grounded claims go
    round again, and each claim is kept once, so work is bounded by the edges."""
    up = edges.where("target_kind = 'claim'").select("claim_id", F.col("target_id").alias("supporter"))
    start = edges.where("target_kind = 'source'").select("claim_id").distinct()
    return _rounds(start, lambda f: up.join(f.withColumnRenamed("claim_id", "supporter"), "supporter", "left_semi").select("claim_id").distinct())


def source_closure(edges):
    """(claim, source) over all support paths: each round extends only the pairs found last."""
    up = edges.where("target_kind = 'claim'").select("claim_id", F.col("target_id").alias("supporter"))
    start = edges.where("target_kind = 'source'").select("claim_id", F.col("target_id").alias("source_id")).distinct()
    return _rounds(start, lambda f: f.withColumnRenamed("claim_id", "supporter").join(up, "supporter").select("claim_id", "source_id").distinct())


def cyclic_claims(edges):
    """Claims on a support cycle (or on a path between two cycles).

    Ends that cannot be on a cycle are peeled off: nodes nothing supports and
    nodes that support nothing.  What is left after no more ends can be peeled is cyclic."""
    ensure_checkpoint_dir(edges.sparkSession)
    e = edges.where("target_kind = 'claim'").select(F.col("claim_id").alias("a"), F.col("target_id").alias("b")).distinct().checkpoint()
    n = e.count()
    while True:
        starts, ends = e.select(F.col("a").alias("b")).distinct(), e.select(F.col("b").alias("a")).distinct()
        e = e.join(starts, "b", "left_semi").join(ends, "a", "left_semi").select("a", "b").checkpoint()
        left = e.count()
        if left == n or left == 0:
            break
        n = left
    return e.select(F.col("a").alias("claim_id")).distinct()


def coverage(claims, grounded):
    """Material, supported, blocked and traceable counts."""
    c = claims.join(grounded.withColumn("_g", F.lit(True)), "claim_id", "left")
    m = F.col("material")
    return c.agg(
        F.count(F.lit(1)).alias("claims"), F.count_if(m).alias("material"), F.count_if(m & ~F.col("blocked")).alias("supported"),
        F.count_if(m & F.col("blocked")).alias("blocked"), F.count_if(m & F.col("_g").isNotNull()).alias("traceable"))


def ungrounded_material(claims, grounded):
    return _row(claims.where("material").join(grounded, "claim_id", "left_anti"), "material_not_grounded", F.col("claim_id"))


def missing_nodes(edges, claims, sources):
    """Edges to nodes that do not exist, and claims that support themselves."""
    c = edges.where("target_kind = 'claim'").join(claims.select(F.col("claim_id").alias("target_id")), "target_id", "left_anti")
    s = edges.where("target_kind = 'source'").join(sources.select(F.col("source_id").alias("target_id")), "target_id", "left_anti")
    me = edges.where("target_kind = 'claim' and target_id = claim_id")
    key = F.concat_ws(">", "claim_id", "target_id")
    return _row(c, "missing_claim", key).unionByName(_row(s, "missing_source", key)).unionByName(_row(me, "supports_itself", F.col("claim_id")))


def unshared_checks(check_sources, claim_checks, closure):
    """(claim_id, check_id) of checks that share no source with their claim's closure.

    Starts from the closure: a check's sources are only looked up, not written out once more for each claim that names it."""
    c = claim_checks.join(check_sources, "check_id", "left_semi").select("claim_id", "check_id").distinct()
    hit = closure.join(c, "claim_id").join(check_sources, ["check_id", "source_id"], "left_semi").select("claim_id", "check_id").distinct()
    return c.join(hit, ["claim_id", "check_id"], "left_anti")


def check_overlap(check_sources, claim_checks, closure):
    """Claim checks that share no source with the claim's closure."""
    return _row(unshared_checks(check_sources, claim_checks, closure), "check_outside_closure", F.concat_ws("/", "claim_id", "check_id"))


def blocking_rules(claims, claim_caveats):
    """A material claim with a blocking caveat must be blocked, and a blocked one needs such a caveat."""
    b = claim_caveats.where("severity = 'blocking'").select("claim_id").distinct().withColumn("_b", F.lit(True))
    j = claims.join(b, "claim_id", "left").withColumn("_b", F.coalesce("_b", F.lit(False)))
    return _row(j.where("material and _b and not blocked"), "must_be_blocked", F.col("claim_id")).unionByName(_row(j.where("blocked and not _b"), "blocked_without_caveat", F.col("claim_id")))


def latest_reviews(reviews):
    """Latest review per claim: its status, or conflict when the latest moment holds several.

    The number of different statuses is small and fixed, so one max per status
    replaces a sort of all reviews of a claim."""
    per = reviews.groupBy("claim_id", "status").agg(F.max("reviewed_at").alias("latest_at"))
    top = per.groupBy("claim_id").agg(F.max("latest_at").alias("latest_at"))
    j = per.join(top, ["claim_id", "latest_at"]).groupBy("claim_id", "latest_at").agg(F.count(F.lit(1)).alias("n"), F.min("status").alias("status"))
    return j.select("claim_id", "latest_at", F.when(F.col("n") > 1, "conflict").otherwise(F.col("status")).alias("status"))


def approval_gaps(claims, reviews):
    """Material claims whose latest review is missing, conflicting or not an approval."""
    r = latest_reviews(reviews)
    j = claims.where("material").join(r, "claim_id", "left").where(F.coalesce(F.col("status"), F.lit("none")) != "approved")
    return j.select("claim_id", F.coalesce("status", F.lit("none")).alias("latest"))


def inspect_claim(claim_id, claims, edges):
    """Immediate support of one claim with the supporting claims' own values."""
    e = edges.where(F.col("claim_id") == claim_id)
    v = claims.select(F.col("claim_id").alias("target_id"), F.lit("claim").alias("target_kind"), "value")
    return e.join(v, ["target_id", "target_kind"], "left").select("target_kind", "target_id", "value")


def record_snapshot(records, key, payload):
    """Source row per record: digest of the record's canonical JSON."""
    return records.select(F.col(key).alias("source_id"), F.lit("canonical_record").alias("hash_scope"), F.concat(F.lit("sha256:"), sha256(canonical_json(F.col(payload)))).alias("content_hash"))


def file_snapshot(spark, path, pattern=None):
    """Source row per file: digest of its bytes and its path."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        r = r.option("pathGlobFilter", pattern)
    return r.load(path).select("path", F.lit("file_bytes").alias("hash_scope"), F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("content_hash"), "length")


def source_hash_mismatches(sources, files):
    """Recorded file digests that differ from the files on disk, or whose file is gone."""
    f = files.select(F.col("path").alias("uri"), F.col("content_hash").alias("_h"))
    j = sources.where("hash_scope = 'file_bytes'").join(f, "uri", "left")
    return _row(j.where("_h is null"), "source_missing", F.col("uri")).unionByName(_row(j.where("_h <> content_hash"), "source_changed", F.col("uri")))


def bundle_entries(artifacts, claims, artifact="artifact_id"):
    """Hashes and sorted material claim ids per artifact (an artifact's claims are one document)."""
    ids = claims.where("material").groupBy(artifact).agg(F.array_sort(F.collect_set(F.col("claim_id").cast("string"))).alias("material_claim_ids"))
    return artifacts.join(ids, artifact, "left").withColumn("material_claim_ids", F.coalesce("material_claim_ids", F.array().cast("array<string>")))


def bundle_hash(entries, bundle="bundle_id"):
    """Digest over a bundle's sorted entries."""
    line = F.concat_ws("|", "artifact_id", "content_hash", "evidence_hash", "semantic_hash", F.concat_ws(",", "material_claim_ids"))
    g = entries.groupBy(bundle, "agent_id", "as_of", "period").agg(F.array_sort(F.collect_list(line)).alias("l"), F.array_sort(F.collect_list("artifact_id")).alias("artifact_ids"),
                                                                 F.array_sort(F.array_distinct(F.flatten(F.collect_list("material_claim_ids")))).alias("ids"))
    return g.select(bundle, "agent_id", "as_of", "period", F.concat(F.lit("sha256:"), sha256(F.concat_ws("\n", "l"))).alias("bundle_hash"), "artifact_ids",
                    F.concat(F.lit("sha256:"), sha256(F.concat_ws(",", "ids"))).alias("material_claim_ids_hash"))


def authorization_mismatches(envelopes, hashes):
    """Envelopes that do not equal the bundle they name."""
    h = hashes.select("bundle_id", F.col("bundle_hash").alias("_b"), F.col("material_claim_ids_hash").alias("_m"), F.col("artifact_ids").alias("_a"))
    j = envelopes.join(h, "bundle_id", "left")
    same = (F.col("bundle_hash").eqNullSafe(F.col("_b"))) & (F.col("material_claim_ids_hash").eqNullSafe(F.col("_m"))) & (F.col("artifact_ids").eqNullSafe(F.col("_a")))
    return _row(j.where(~same), "authorization_differs", F.col("bundle_id"))


def portfolio_reconcile(expected, found, key):
    """Missing and unexpected artifacts from one full join."""
    a, b = expected.select(key).distinct().withColumn("_e", F.lit(1)), found.select(key).distinct().withColumn("_f", F.lit(1))
    j = a.join(b, key, "full")
    return j.where("_e is null or _f is null").select(key, F.when(F.col("_f").isNull(), "missing").otherwise("unexpected").alias("state"))


MARKER = r'data-claim="([a-z0-9._:-]+)" data-display="([^"]*)"'


def reference_coverage(content, claims):
    """Material claims that a rendered document does not show with the right display value."""
    m = content.select("artifact_id", F.explode(F.arrays_zip(F.regexp_extract_all("html", F.lit(MARKER), 1).alias("c"), F.regexp_extract_all("html", F.lit(MARKER), 2).alias("d"))).alias("m"))
    seen = m.select("artifact_id", F.col("m.c").alias("claim_id"), F.col("m.d").alias("shown")).distinct()
    j = claims.where("material").join(seen, ["artifact_id", "claim_id"], "left").groupBy("artifact_id", "claim_id", "display_value").agg(
        F.count("shown").alias("n"), F.count_if(F.col("shown") == F.col("display_value")).alias("ok"))
    return j.where("n = 0 or ok < n").select("artifact_id", "claim_id", F.when(F.col("n") == 0, "not_referenced").otherwise("display_differs").alias("rule"))
