"""Policy notes and untrusted content."""

from __future__ import annotations

from pyspark.sql import functions as F

from crewgrid.functions.text import is_stale, pii_hits
from crewgrid.sources import contracts as c


def trust_class(n):
    """Trust follows provenance: the loader's stamp, the real path and the approval, never the label."""
    trusted = F.coalesce(F.col("loaded_from_disk") & F.startswith("source", F.lit("policy/")) & (F.col("status") == "approved"), F.lit(False))
    declared = F.col("content_type").isin("draft", "case_note", "transcript", "external_message")
    return n.withColumn("trust", F.when(trusted, "trusted_policy").when(F.coalesce(declared, F.lit(False)), F.col("content_type")).otherwise("external_message"))


def lookup(notes, topics, as_of, max_age_days=365):
    """One current trusted note answers a topic; none, several or a stale one escalates."""
    t = trust_class(notes).where("trust = 'trusted_policy'")
    pick = F.struct("source", "statement", "last_reviewed")
    g = t.groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.min(pick).alias("p"))
    j = topics.select("topic").distinct().join(g, "topic", "left")
    stale = is_stale(F.col("p.last_reviewed"), as_of, max_age_days)
    status = F.when(F.col("n").isNull(), "no_policy").when(F.col("n") > 1, "ambiguous").when(stale, "stale").otherwise("answered")
    ok = status == "answered"
    return j.select("topic", status.alias("status"), F.when(ok, F.col("p.statement")).alias("answer"), F.when(status.isin("answered", "stale"), F.col("p.source")).alias("cite"))


def note_lint(notes, as_of, required=("title", "status", "owner", "last_reviewed"), max_age_days=365):
    """Rules over a map column of front matter plus the body."""
    fm = lambda k: F.col("front")[k]
    rules = {f"{k}_missing": fm(k).isNull() | (F.trim(fm(k)) == "") for k in required}
    rules.update({
        "status_unknown": ~F.coalesce(fm("status").isin("draft", "review", "approved", "retired"), F.lit(False)),
        "date_unreadable": fm("last_reviewed").isNotNull() & F.try_to_date(fm("last_reviewed"), "yyyy-MM-dd").isNull(),
        "stale": is_stale(fm("last_reviewed"), as_of, max_age_days), "personal_data": F.size(pii_hits("text")) > 0})
    return c.violations(notes, "source", rules)
