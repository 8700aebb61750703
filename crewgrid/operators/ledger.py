"""Hash-chained decision ledgers: integrity, governance and approval rules.

Every rule is a branch that returns (rule, ledger_id, event_id or key).  Nothing
replays a ledger in one task: the chain is a join on (ledger, sequence), the
approval rules are two 'latest before' lookups and one minimum.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from crewgrid.functions.hashing import sha256
from crewgrid.functions.ranking import carry_last, split_points
from crewgrid.functions.text import pii_hits

GENESIS = "0" * 64
EVENT_TYPES = ["request", "response", "recommendation", "approval", "action", "escalation", "fyi"]


def _hits(df, rule, key="event_id"):
    return df.select(F.lit(rule).alias("rule"), F.col("ledger_id"), F.col(key).cast("string").alias("key"))


def union_all(frames):
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def content(body="body", prev="prev_hash"):
    """Text that the event hash covers."""
    return F.concat_ws("|", prev, body)


def verify_chain(events):
    """Gaps, forks, broken links and changed content.  Rows meet their predecessor on
    (ledger, sequence - 1), so one giant ledger spreads over all tasks."""
    e = events.select("ledger_id", "sequence", "event_id", "prev_hash", "event_hash", sha256(content()).alias("_want"))
    held = e.groupBy("ledger_id", "sequence").agg(F.min("event_hash").alias("_prev"), F.count(F.lit(1)).alias("_n"))  # of a forked place always the same row
    prev = held.select("ledger_id", (F.col("sequence") + 1).alias("sequence"), "_prev")
    forked = _hits(e.join(held.where("_n > 1").select("ledger_id", "sequence"), ["ledger_id", "sequence"], "left_semi"), "duplicate_sequence")
    j = e.join(prev, ["ledger_id", "sequence"], "left")
    expected = F.when(F.col("sequence") == 0, F.lit(GENESIS)).otherwise(F.col("_prev"))
    rules = F.array_compact(F.array(
        F.when((F.col("sequence") > 0) & F.col("_prev").isNull(), F.lit("sequence_gap")),
        F.when(~F.col("prev_hash").eqNullSafe(expected), F.lit("broken_chain")),
        F.when(F.col("event_hash") != F.col("_want"), F.lit("tampered"))))
    return j.select(F.explode(rules).alias("rule"), "ledger_id", F.col("event_id").cast("string").alias("key")).unionByName(forked)


def duplicate_keys(events, column, rule):
    """Keys that occur more than once, with the number of extra rows."""
    d = events.where(F.col(column).isNotNull()).groupBy("ledger_id", column).agg((F.count(F.lit(1)) - 1).alias("extra")).where("extra > 0")
    return d.select(F.lit(rule).alias("rule"), "ledger_id", F.col(column).cast("string").alias("key"), "extra")


def causation_order(events):
    """Causes that name no event at or before their own position (an event may name itself)."""
    first = events.groupBy("ledger_id", F.col("event_id").alias("causation_id")).agg(F.min("sequence").alias("_first"))
    c = events.where(F.col("causation_id").isNotNull()).join(first, ["ledger_id", "causation_id"], "left")
    return _hits(c.where(F.col("_first").isNull() | (F.col("_first") > F.col("sequence"))), "cause_not_earlier")


def evidence_bound(t="type", requires="requires_approval"):
    """Events that need an authorization."""
    return F.col(t).isin("approval", "action") | ((F.col(t) == "recommendation") & F.coalesce(F.col(requires), F.lit(False)))


def effective_scope(scope="scope", approval_scope="approval_scope"):
    return F.coalesce(F.col(scope), F.col(approval_scope))


def authorization_ok(c="auth"):
    return F.coalesce(F.col(c).rlike(r"^[0-9a-z:]+$"), F.lit(False))


def schema_rules(events):
    """Per-event shape, governance and personal-data rules as one projection."""
    blank = lambda c: F.col(c).isNull() | (F.trim(F.col(c)) == "")
    rules = F.array_compact(F.array(
        F.when(blank("channel"), F.lit("channel_empty")),
        F.when(~F.coalesce(F.col("type").isin(*EVENT_TYPES), F.lit(False)), F.lit("unknown_type")),
        F.when(~F.coalesce(F.col("actor_kind").isin("agent", "human"), F.lit(False)), F.lit("actor_kind")),
        F.when(F.col("scope").isNotNull() & blank("scope"), F.lit("scope_empty")),
        F.when((F.col("type") == "action") & blank("scope"), F.lit("action_without_scope")),
        F.when(evidence_bound() & F.col("correlation_id").isNull(), F.lit("correlation_missing")),
        F.when(evidence_bound() & F.col("auth").isNull(), F.lit("authorization_missing")),
        F.when((F.col("type") == "approval") & ~F.coalesce(F.col("decision").isin("approved", "denied"), F.lit(False)), F.lit("decision_value")),
        F.when(F.size(pii_hits("body")) > 0, F.lit("personal_data"))))
    return events.select(F.explode(rules).alias("rule"), "ledger_id", F.col("event_id").cast("string").alias("key"))


def can_approve(requests, actors, role_members, scopes):
    """entitled and reason per (actor_id, scope): scope names a role, the actor is human and holds it."""
    s = scopes.select("scope", F.col("role").alias("_role"))
    a = actors.select("actor_id", F.col("kind").alias("_kind"))
    m = role_members.select(F.col("role").alias("_role"), "actor_id", F.lit(True).alias("_holds"))
    j = requests.join(s, "scope", "left").join(a, "actor_id", "left").join(m, ["_role", "actor_id"], "left")
    reason = (
        F.when(F.col("_role").isNull(), "unknown scope").when(F.col("_kind").isNull(), "unknown actor")
        .when(F.col("_kind") != "human", "not human").when(F.col("_holds").isNull(), "lacks role").otherwise("holds role"))
    return j.withColumn("reason", reason).withColumn("entitled", F.col("reason") == "holds role").drop("_role", "_kind", "_holds")


def approver_pool(scopes, role_members):
    """Number of people who can approve each scope (0 when nobody can)."""
    j = scopes.join(role_members, "role", "left")
    return j.groupBy("scope").agg(F.count("actor_id").alias("pool_size"))


def membership_rules(events, members, actors):
    """Actors outside the channel, and attributes that differ from the registered ones."""
    outside = events.join(members, ["actor_id", "channel"], "left_anti")
    reg = actors.select("actor_id", F.col("kind").alias("_k"))
    spoof = events.join(reg, "actor_id").where(~F.col("actor_kind").eqNullSafe(F.col("_k")))
    return union_all([_hits(outside, "not_a_member"), _hits(spoof, "spoofed_kind")])


def can_react(requests, members):
    j = requests.join(members.withColumn("_m", F.lit(True)), ["actor_id", "channel"], "left")
    ok = F.coalesce(F.col("_m"), F.lit(False))
    return j.drop("_m").select("*", ok.alias("allowed"), F.when(ok, "channel member").otherwise("not a member").alias("reason"))


def approval_rules(events, auth_ok=None):
    """Approvals bind to the latest recommendation, actions to the latest approval, each approval works once.

    events: position (unique), event_id, correlation_id, type, requires_approval,
    decision, causation_id, scope, approval_scope, authorization, entitled (from
    the registry) and logged_entitled; auth_ok: a column that tells valid
    authorizations, where their form alone does not.

    The replay state at any event is determined by the latest earlier
    recommendation and the latest earlier valid approval or denial of its
    thread.  Within one approval's reach the first fully valid action consumes
    it, which is a minimum over positions.  So no thread is ever folded in order."""
    e = events.where(F.col("type").isin("recommendation", "approval", "action")).select(
        "ledger_id", "position", "event_id", "correlation_id", "type", "requires_approval", "decision", "causation_id", "scope",
        effective_scope().alias("eff_scope"), "auth", (F.col(auth_ok) if auth_ok else authorization_ok()).alias("auth_ok"), "entitled", "logged_entitled")
    splits = split_points(e, "position")
    keys = ["ledger_id", "correlation_id"]
    is_rec = (F.col("type") == "recommendation") & F.coalesce(F.col("requires_approval"), F.lit(False))
    e = carry_last(e, keys, "position", is_rec, ["event_id", "scope", "auth", "auth_ok"], "pend", splits)
    p = F.col("pend")
    cause_ok = p.isNotNull() & F.col("causation_id").eqNullSafe(p["event_id"])
    scope_ok = p["scope"].eqNullSafe(F.col("eff_scope"))
    auth_ok = F.coalesce(p["auth_ok"] & F.col("auth_ok") & p["auth"].eqNullSafe(F.col("auth")), F.lit(False))
    approval = F.col("type") == "approval"
    e = e.withColumn("bound", approval & cause_ok & scope_ok & auth_ok)
    grants_it = approval & (F.col("decision") == "approved") & F.col("entitled") & F.col("bound")
    denies = approval & (F.col("decision") == "denied")
    e = e.withColumn("why", F.when(approval & ~cause_ok, "approval_unbound").when(approval & ~scope_ok, "approval_scope_pivot").when(approval & ~auth_ok, "approval_substituted"))
    e = e.withColumn("grants_it", F.coalesce(grants_it, F.lit(False))).drop("pend")
    decide = F.col("grants_it") | F.coalesce(denies, F.lit(False))
    e = carry_last(e, keys, "position", decide, ["event_id", "grants_it", "eff_scope", "auth"], "appr", splits)
    a = F.col("appr")
    standing = F.coalesce(a["grants_it"], F.lit(False))
    action = F.col("type") == "action"
    c_ok = F.col("causation_id").eqNullSafe(a["event_id"])
    s_ok = F.col("scope").eqNullSafe(a["eff_scope"])
    u_ok = F.col("auth_ok") & a["auth"].eqNullSafe(F.col("auth"))
    e = e.withColumn("match", action & standing & c_ok & s_ok & u_ok).withColumn("appr_id", F.when(standing, a["event_id"])).withColumn("appr_pos", F.when(standing, a["position"]))
    used = e.where("match").groupBy("ledger_id", "appr_id", "appr_pos").agg(F.min("position").alias("used_at"))
    once = used.groupBy("ledger_id", F.col("appr_id").alias("causation_id")).agg(F.min("used_at").alias("consumed_at"))
    acts = (
        e.where(action).join(used, ["ledger_id", "appr_id", "appr_pos"], "left").join(once, ["ledger_id", "causation_id"], "left")
        .withColumn("open", standing & (F.col("used_at").isNull() | (F.col("position") <= F.col("used_at")))))
    replay = F.coalesce(F.col("consumed_at") < F.col("position"), F.lit(False))
    act_rules = F.array_compact(F.array(
        F.when(~F.col("open") & replay, F.lit("action_replay")), F.when(~F.col("open") & ~replay, F.lit("action_ungated")),
        F.when(F.col("open") & ~c_ok, F.lit("action_cause")), F.when(F.col("open") & ~s_ok, F.lit("action_scope")), F.when(F.col("open") & ~u_ok, F.lit("action_substituted"))))
    app_rules = F.array_compact(F.array(
        F.col("why"), F.when(~F.col("logged_entitled").eqNullSafe(F.col("entitled")), F.lit("approval_flag_disagrees")),
        F.when((F.col("decision") == "approved") & ~F.col("entitled"), F.lit("approval_forged"))))
    row = lambda df, rules: df.select(F.explode(rules).alias("rule"), "ledger_id", F.col("event_id").cast("string").alias("key"))
    return row(e.where(approval), app_rules).unionByName(row(acts, act_rules))


def head_state(events):
    """Row count and head hash per ledger."""
    return events.groupBy("ledger_id").agg(F.count(F.lit(1)).alias("count"), F.max_by("event_hash", "sequence").alias("head_hash"))


def anchor(events):
    return head_state(events).withColumn("schema_version", F.lit("1.0"))


def verify_anchor(events, anchors, min_counts=None):
    """Shape, rollback below the last known height, count and head."""
    a = anchors.join(head_state(events).withColumnsRenamed({"count": "_n", "head_hash": "_h"}), "ledger_id", "left")
    if min_counts is not None:
        a = a.join(min_counts, "ledger_id", "left")
    else:
        a = a.withColumn("min_count", F.lit(None).cast("bigint"))
    n = F.coalesce(F.col("_n"), F.lit(0))
    h = F.coalesce(F.col("_h"), F.lit(GENESIS))
    shape = F.col("count").isNull() | (F.col("count") < 0) | F.col("head_hash").isNull() | (F.col("head_hash") == "")
    rules = F.when(shape, F.array(F.lit("anchor_shape"))).otherwise(F.array_compact(F.array(
        F.when(F.col("count") < F.col("min_count"), F.lit("anchor_rollback")), F.when(n != F.col("count"), F.lit("anchor_count")),
        F.when(h != F.col("head_hash"), F.lit("anchor_head")))))
    return a.select(F.explode(rules).alias("rule"), "ledger_id", F.col("count").cast("string").alias("key"))


def open_guard(events, anchors):
    """A ledger may grow past its anchor but must still hold the anchored head at that height."""
    at = events.groupBy("ledger_id", (F.col("sequence") + 1).alias("count")).agg(F.min("event_hash").alias("_h"))
    a = anchors.select("ledger_id", "count", "head_hash").join(at, ["ledger_id", "count"], "left")
    want = F.when(F.col("count") == 0, F.lit(GENESIS)).otherwise(F.col("_h"))
    return a.select(F.explode(F.array_compact(F.array(
        F.when((F.col("count") > 0) & F.col("_h").isNull(), F.lit("truncated_below_anchor")),
        F.when(want.isNotNull() & (want != F.col("head_hash")), F.lit("head_rewritten"))))).alias("rule"), "ledger_id", F.col("count").cast("string").alias("key"))


def bundle_authorizations(events, bundle_id):
    return events.where(F.col("auth").isNotNull() & (F.col("bundle_id") == bundle_id))


def idempotent_append(existing, incoming, key="idempotency_key"):
    """New rows only: keyed rows already in the ledger, or repeated in the batch, are dropped.
    The first row of a repeated key is kept by a minimum, not by a sort."""
    keyed = incoming.where(F.col(key).isNotNull())
    first = keyed.groupBy("ledger_id", key).agg(F.min_by(F.struct(*incoming.columns), "position").alias("r")).select("r.*")
    new = first.join(existing.where(F.col(key).isNotNull()).select("ledger_id", key), ["ledger_id", key], "left_anti")
    return new.select(*incoming.columns).unionByName(incoming.where(F.col(key).isNull()))
