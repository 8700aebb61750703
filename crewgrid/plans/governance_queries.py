"""Ledger, lineage, text-scan, contract and report queries on the views."""

from __future__ import annotations

from pyspark.sql import functions as F

from crewgrid.functions.hashing import canonical_json, sha256
from crewgrid.functions import text as tx
from crewgrid.operators import ledger as lg, lineage as ln, reports as rp
from crewgrid.plans.catalog import add
from crewgrid.sources import contracts as ct, rulesets as rs
from crewgrid.views import AS_OF, view

A = f"DATE '{AS_OF}'"


def rows(s, d):
    return view(s, d, "ledger_rows")


# ---- chain fixture: each ledger holds at most 100 events by construction


def chained(s, d):
    e = rows(s, d)
    arr = e.groupBy("ledger_id").agg(F.sort_array(F.collect_list(F.struct("sequence", "event_id", "body"))).alias("a"))
    item = "array<struct<sequence:bigint,event_id:bigint,body:string,prev_hash:string,event_hash:string>>"
    start = F.struct(F.lit(lg.GENESIS).alias("h"), F.array().cast(item).alias("o"))

    def link(acc, x):
        h = F.sha2(F.concat_ws("|", acc["h"], x["body"]), 256)
        row = F.struct(x["sequence"].alias("sequence"), x["event_id"].alias("event_id"), x["body"].alias("body"), acc["h"].alias("prev_hash"), h.alias("event_hash"))
        return F.struct(h.alias("h"), F.array_append(acc["o"], row).alias("o"))

    return arr.select("ledger_id", F.inline(F.aggregate("a", start, link, lambda acc: acc["o"])))


def tampered(s, d):
    e = chained(s, d).where("event_id % 401 <> 13")
    return e.withColumn("body", F.when(F.col("event_id") % 211 == 7, F.concat("body", F.lit("x"))).otherwise(F.col("body"))).withColumn(
        "prev_hash", F.when(F.col("event_id") % 307 == 11, F.repeat(F.lit("f"), 64)).otherwise(F.col("prev_hash")))


CHAIN = """WITH good AS (WITH RECURSIVE ch(ledger_id, sequence, event_id, body, prev_hash, event_hash) AS (
  SELECT ledger_id, sequence, event_id, body, repeat('0', 64), sha256(concat(repeat('0', 64), '|', body)) FROM ledger_rows WHERE sequence = 0
  UNION ALL SELECT l.ledger_id, l.sequence, l.event_id, l.body, ch.event_hash, sha256(concat(ch.event_hash, '|', l.body)) FROM ch JOIN ledger_rows l ON l.ledger_id = ch.ledger_id AND l.sequence = ch.sequence + 1) SELECT * FROM ch),
bad AS (SELECT ledger_id, sequence, event_id, CASE WHEN event_id % 211 = 7 THEN concat(body, 'x') ELSE body END AS body, CASE WHEN event_id % 307 = 11 THEN repeat('f', 64) ELSE prev_hash END AS prev_hash, event_hash FROM good WHERE event_id % 401 <> 13)
"""
LR = ["ledger_rows"]
add("ledger_chain_violations", lambda s, d: lg.verify_chain(tampered(s, d)), LR, CHAIN + """, x AS (SELECT b.*, p.event_hash AS ph, p.ledger_id IS NULL AS nop FROM bad b LEFT JOIN bad p ON b.ledger_id = p.ledger_id AND p.sequence = b.sequence - 1)
SELECT 'sequence_gap' AS rule, ledger_id, CAST(event_id AS VARCHAR) AS key FROM x WHERE sequence > 0 AND nop
UNION ALL SELECT 'broken_chain', ledger_id, CAST(event_id AS VARCHAR) FROM x WHERE prev_hash IS DISTINCT FROM CASE WHEN sequence = 0 THEN repeat('0', 64) ELSE ph END
UNION ALL SELECT 'tampered', ledger_id, CAST(event_id AS VARCHAR) FROM x WHERE event_hash <> sha256(concat(prev_hash, '|', body))""")
add("ledger_head_state", lambda s, d: lg.head_state(chained(s, d)), LR, CHAIN + "SELECT ledger_id, count(*) AS count, arg_max(event_hash, sequence) AS head_hash FROM good GROUP BY 1")
add("ledger_anchor_verify", lambda s, d: lg.verify_anchor(chained(s, d).where("event_id % 401 <> 99 or sequence < 99"), lg.anchor(chained(s, d)), lg.head_state(chained(s, d)).select("ledger_id", (F.col("count") + F.when(F.col("ledger_id") % 7 == 3, 1).otherwise(0)).alias("min_count"))), LR,
    CHAIN + """, n AS (SELECT ledger_id, count(*) AS count, arg_max(event_hash, sequence) AS h FROM good GROUP BY 1), t AS (SELECT ledger_id, count(*) AS count, arg_max(event_hash, sequence) AS h FROM good WHERE event_id % 401 <> 99 OR sequence < 99 GROUP BY 1)
SELECT r AS rule, n.ledger_id, CAST(n.count AS VARCHAR) AS key FROM n LEFT JOIN t ON n.ledger_id = t.ledger_id CROSS JOIN (SELECT unnest(['anchor_rollback', 'anchor_count', 'anchor_head']) AS r)
WHERE (r = 'anchor_rollback' AND n.ledger_id % 7 = 3) OR (r = 'anchor_count' AND n.count <> t.count) OR (r = 'anchor_head' AND n.h <> t.h)""")
add("ledger_open_guard", lambda s, d: lg.open_guard(tampered(s, d), lg.anchor(chained(s, d)).where("ledger_id % 2 = 0")), LR, CHAIN + """, n AS (SELECT ledger_id, count(*) AS count, arg_max(event_hash, sequence) AS h FROM good WHERE ledger_id % 2 = 0 GROUP BY 1)
SELECT CASE WHEN b.ledger_id IS NULL THEN 'truncated_below_anchor' ELSE 'head_rewritten' END AS rule, n.ledger_id, CAST(n.count AS VARCHAR) AS key FROM n LEFT JOIN bad b ON b.ledger_id = n.ledger_id AND b.sequence + 1 = n.count WHERE b.event_hash IS DISTINCT FROM n.h""")
add("ledger_duplicate_idempotency", lambda s, d: lg.duplicate_keys(rows(s, d), "idempotency_key", "double_processed"), LR,
    "SELECT 'double_processed' AS rule, ledger_id, idempotency_key AS key, count(*) - 1 AS extra FROM ledger_rows WHERE idempotency_key IS NOT NULL GROUP BY 2, 3 HAVING count(*) > 1")
add("ledger_causation_order", lambda s, d: lg.causation_order(rows(s, d)), LR, """SELECT 'cause_not_earlier' AS rule, e.ledger_id, CAST(e.event_id AS VARCHAR) AS key FROM ledger_rows e
WHERE causation_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ledger_rows c WHERE c.ledger_id = e.ledger_id AND c.event_id = e.causation_id AND c.sequence <= e.sequence)""")
GOV = "(type IN ('approval', 'action') OR (type = 'recommendation' AND requires_approval))"
_S = {"channel_empty": "trim(channel) = ''", "unknown_type": "type = 'note'", "action_without_scope": "type = 'action' AND scope IS NULL", "correlation_missing": f"{GOV} AND correlation_id IS NULL",
      "authorization_missing": f"{GOV} AND auth IS NULL", "decision_value": "type = 'approval' AND decision NOT IN ('approved', 'denied')"}
add("ledger_schema_rules", lambda s, d: lg.schema_rules(rows(s, d)), LR, " UNION ALL ".join(f"SELECT '{k}' AS rule, ledger_id, CAST(event_id AS VARCHAR) AS key FROM ledger_rows WHERE {v}" for k, v in _S.items()))
add("ledger_idempotent_append", lambda s, d: lg.idempotent_append(rows(s, d).where("event_id % 10 < 5"), rows(s, d).where("event_id % 10 >= 5")).select("event_id", "ledger_id", "idempotency_key"), LR,
    """SELECT event_id, ledger_id, idempotency_key FROM (SELECT *, row_number() OVER (PARTITION BY ledger_id, idempotency_key ORDER BY position) AS rn FROM ledger_rows WHERE event_id % 10 >= 5) n
WHERE idempotency_key IS NULL OR (rn = 1 AND NOT EXISTS (SELECT 1 FROM ledger_rows o WHERE o.event_id % 10 < 5 AND o.ledger_id = n.ledger_id AND o.idempotency_key = n.idempotency_key))""")


def entitled(s, d):
    ask = rows(s, d).where("type in ('approval', 'action', 'recommendation')").withColumn("_own", F.col("scope")).withColumn("scope", F.coalesce("scope", "approval_scope"))
    r = lg.can_approve(ask, view(s, d, "actors"), view(s, d, "role_members"), view(s, d, "scopes"))
    return r.withColumn("scope", F.col("_own")).drop("_own")


ENT = """WITH ent AS (SELECT e.*, coalesce(e.scope, e.approval_scope) AS eff, CASE WHEN s.scope IS NULL THEN 'unknown scope' WHEN a.actor_id IS NULL THEN 'unknown actor' WHEN a.kind <> 'human' THEN 'not human' WHEN m.actor_id IS NULL THEN 'lacks role' ELSE 'holds role' END AS reason
  FROM ledger_rows e LEFT JOIN scopes s ON s.scope = coalesce(e.scope, e.approval_scope) LEFT JOIN actors a ON a.actor_id = e.actor_id LEFT JOIN role_members m ON m.role = s.role AND m.actor_id = e.actor_id WHERE type IN ('approval', 'action', 'recommendation'))
"""
EV = ["ledger_rows", "actors", "role_members", "scopes"]
add("ledger_entitlement", lambda s, d: entitled(s, d).select("event_id", "entitled", "reason"), EV, ENT + "SELECT event_id, reason = 'holds role' AS entitled, reason FROM ent")
add("ledger_approver_pool", lambda s, d: lg.approver_pool(view(s, d, "scopes"), view(s, d, "role_members")), EV, "SELECT scope, count(actor_id) AS pool_size FROM scopes LEFT JOIN role_members m ON scopes.role = m.role GROUP BY 1")
add("ledger_membership_rules", lambda s, d: lg.membership_rules(rows(s, d), view(s, d, "channel_members"), view(s, d, "actors")), EV + ["channel_members"],
    """SELECT 'not_a_member' AS rule, ledger_id, CAST(event_id AS VARCHAR) AS key FROM ledger_rows e WHERE NOT EXISTS (SELECT 1 FROM channel_members m WHERE m.actor_id = e.actor_id AND m.channel = e.channel)
UNION ALL SELECT 'spoofed_kind', ledger_id, CAST(event_id AS VARCHAR) FROM ledger_rows e JOIN actors a ON a.actor_id = e.actor_id WHERE a.kind <> e.actor_kind""")
FOLD = ENT + """, ev AS (SELECT *, reason = 'holds role' AS can, auth IS NOT NULL AS aok, row_number() OVER (PARTITION BY ledger_id, correlation_id ORDER BY position) AS rn FROM ent),
st AS (WITH RECURSIVE f(ledger_id, correlation_id, rn, event_id, v, pe, ps, pa, pok, ae, asc_, aa, cons, cz) AS (
  SELECT ledger_id, correlation_id, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST([] AS VARCHAR[]), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), false, CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT) FROM (SELECT DISTINCT ledger_id, correlation_id FROM ev)
  UNION ALL SELECT e.ledger_id, e.correlation_id, e.rn, e.event_id,
    list_filter(CASE WHEN e.type = 'approval' THEN [
      CASE WHEN f.pe IS NULL OR e.causation_id IS DISTINCT FROM f.pe THEN 'approval_unbound' WHEN f.ps IS DISTINCT FROM e.eff THEN 'approval_scope_pivot' WHEN NOT (f.pok AND e.aok AND f.pa = e.auth) THEN 'approval_substituted' END,
      CASE WHEN e.logged_entitled <> e.can THEN 'approval_flag_disagrees' END, CASE WHEN e.decision = 'approved' AND NOT e.can THEN 'approval_forged' END]
    WHEN e.type = 'action' THEN CASE WHEN f.ae IS NULL THEN [CASE WHEN list_contains(f.cons, e.causation_id) THEN 'action_replay' ELSE 'action_ungated' END] ELSE [
      CASE WHEN e.causation_id IS DISTINCT FROM f.ae THEN 'action_cause' END, CASE WHEN e.scope IS DISTINCT FROM f.asc_ THEN 'action_scope' END, CASE WHEN NOT coalesce(e.aok AND f.aa = e.auth, false) THEN 'action_substituted' END] END
    ELSE CAST([] AS VARCHAR[]) END, lambda z: z IS NOT NULL),
    CASE WHEN e.type = 'recommendation' AND e.requires_approval THEN e.event_id ELSE f.pe END, CASE WHEN e.type = 'recommendation' AND e.requires_approval THEN e.scope ELSE f.ps END,
    CASE WHEN e.type = 'recommendation' AND e.requires_approval THEN e.auth ELSE f.pa END, CASE WHEN e.type = 'recommendation' AND e.requires_approval THEN e.aok ELSE f.pok END,
    CASE WHEN g.ok THEN e.event_id WHEN g.off THEN NULL ELSE f.ae END, CASE WHEN g.ok THEN e.eff WHEN g.off THEN NULL ELSE f.asc_ END, CASE WHEN g.ok THEN e.auth WHEN g.off THEN NULL ELSE f.aa END,
    CASE WHEN g.used THEN list_append(f.cons, f.ae) ELSE f.cons END, CASE WHEN g.used THEN f.ae END
  FROM f JOIN ev e ON e.ledger_id = f.ledger_id AND e.correlation_id IS NOT DISTINCT FROM f.correlation_id AND e.rn = f.rn + 1,
  LATERAL (SELECT coalesce(e.type = 'approval' AND e.decision = 'approved' AND e.can AND f.pe IS NOT NULL AND e.causation_id = f.pe AND f.ps IS NOT DISTINCT FROM e.eff AND f.pok AND e.aok AND f.pa = e.auth, false) AS ok,
    coalesce((e.type = 'approval' AND e.decision = 'denied') OR (e.type = 'action' AND f.ae IS NOT NULL AND e.causation_id = f.ae AND e.scope IS NOT DISTINCT FROM f.asc_ AND e.aok AND f.aa = e.auth), false) AS off,
    coalesce(e.type = 'action' AND f.ae IS NOT NULL AND e.causation_id = f.ae AND e.scope IS NOT DISTINCT FROM f.asc_ AND e.aok AND f.aa = e.auth, false) AS used) g) SELECT * FROM f)
"""
# within one thread; a stream keeps one state per thread and reports the same
THREAD_RULES = FOLD + "SELECT unnest(v) AS rule, ledger_id, CAST(event_id AS VARCHAR) AS key FROM st WHERE rn > 0"
# an approval consumed in another thread of the ledger is a replay too
LEDGER_RULES = FOLD + """, r AS (SELECT unnest(v) AS rule, ledger_id, event_id FROM st WHERE rn > 0), used AS (SELECT ledger_id, event_id AS at_event, cz FROM st WHERE cz IS NOT NULL)
SELECT CASE WHEN r.rule = 'action_ungated' AND EXISTS (SELECT 1 FROM used u JOIN ent e ON e.event_id = r.event_id WHERE u.ledger_id = r.ledger_id AND u.cz = e.causation_id AND u.at_event < r.event_id) THEN 'action_replay' ELSE r.rule END AS rule, r.ledger_id, CAST(r.event_id AS VARCHAR) AS key FROM r"""
add("ledger_approval_rules", lambda s, d: lg.approval_rules(entitled(s, d)), EV, LEDGER_RULES)

# ---- lineage
E = ["support_edges", "claims"]
edges = lambda s, d: view(s, d, "support_edges")
claims = lambda s, d: view(s, d, "claims")
GR = """WITH gr AS (WITH RECURSIVE g(claim_id) AS (SELECT DISTINCT claim_id FROM support_edges WHERE target_kind = 'source' UNION SELECT e.claim_id FROM g JOIN support_edges e ON e.target_kind = 'claim' AND e.target_id = g.claim_id) SELECT * FROM g),
cl AS (WITH RECURSIVE g(claim_id, source_id) AS (SELECT DISTINCT claim_id, target_id FROM support_edges WHERE target_kind = 'source' UNION SELECT e.claim_id, g.source_id FROM g JOIN support_edges e ON e.target_kind = 'claim' AND e.target_id = g.claim_id) SELECT * FROM g)
"""
add("lineage_grounded_claims", lambda s, d: ln.grounded_claims(edges(s, d)), E, GR + "SELECT claim_id FROM gr")
add("lineage_source_closure", lambda s, d: ln.source_closure(edges(s, d)), E, GR + "SELECT claim_id, source_id FROM cl")
add("lineage_ungrounded_material", lambda s, d: ln.ungrounded_material(claims(s, d), ln.grounded_claims(edges(s, d))), E, GR + "SELECT 'material_not_grounded' AS rule, CAST(claim_id AS VARCHAR) AS key FROM claims WHERE material AND claim_id NOT IN (SELECT claim_id FROM gr)")
add("lineage_coverage", lambda s, d: ln.coverage(claims(s, d), ln.grounded_claims(edges(s, d))), E, GR + """SELECT count(*) AS claims, count(*) FILTER (WHERE material) AS material, count(*) FILTER (WHERE material AND NOT blocked) AS supported, count(*) FILTER (WHERE material AND blocked) AS blocked,
count(*) FILTER (WHERE material AND claim_id IN (SELECT claim_id FROM gr)) AS traceable FROM claims""")
add("lineage_cycles", lambda s, d: ln.cyclic_claims(view(s, d, "cyclic_edges")), ["cyclic_edges"], """WITH reach AS (WITH RECURSIVE g(a, b) AS (SELECT DISTINCT claim_id, target_id FROM cyclic_edges WHERE target_kind = 'claim' UNION SELECT g.a, e.target_id FROM g JOIN cyclic_edges e ON e.target_kind = 'claim' AND e.claim_id = g.b) SELECT * FROM g),
onc AS (SELECT DISTINCT a FROM reach WHERE a = b)
SELECT a AS claim_id FROM onc UNION SELECT r.b FROM reach r WHERE r.a IN (SELECT a FROM onc) AND EXISTS (SELECT 1 FROM reach q WHERE q.a = r.b AND q.b IN (SELECT a FROM onc))""")
add("lineage_missing_nodes", lambda s, d: ln.missing_nodes(edges(s, d), claims(s, d), view(s, d, "sources")), E + ["sources"], """SELECT CASE target_kind WHEN 'claim' THEN 'missing_claim' ELSE 'missing_source' END AS rule, concat(CAST(claim_id AS VARCHAR), '>', CAST(target_id AS VARCHAR)) AS key FROM support_edges
WHERE (target_kind = 'claim' AND target_id NOT IN (SELECT claim_id FROM claims)) OR (target_kind = 'source' AND target_id NOT IN (SELECT source_id FROM sources))""")
add("lineage_check_overlap", lambda s, d: ln.check_overlap(view(s, d, "check_sources"), view(s, d, "claim_checks"), ln.source_closure(edges(s, d))), E + ["check_sources", "claim_checks"],
    GR + """SELECT 'check_outside_closure' AS rule, concat(CAST(c.claim_id AS VARCHAR), '/', CAST(c.check_id AS VARCHAR)) AS key FROM claim_checks c WHERE c.check_id IN (SELECT check_id FROM check_sources)
AND NOT EXISTS (SELECT 1 FROM check_sources k JOIN cl ON cl.source_id = k.source_id WHERE k.check_id = c.check_id AND cl.claim_id = c.claim_id)""")
add("lineage_blocking_rules", lambda s, d: ln.blocking_rules(claims(s, d), view(s, d, "claim_caveats")), ["claims", "claim_caveats"], """WITH b AS (SELECT claim_id FROM claim_caveats WHERE severity = 'blocking')
SELECT 'must_be_blocked' AS rule, CAST(claim_id AS VARCHAR) AS key FROM claims WHERE material AND NOT blocked AND claim_id IN (SELECT claim_id FROM b) UNION ALL SELECT 'blocked_without_caveat', CAST(claim_id AS VARCHAR) FROM claims WHERE blocked AND claim_id NOT IN (SELECT claim_id FROM b)""")
LAT = """WITH lat AS (SELECT claim_id, latest_at, CASE WHEN count(DISTINCT status) > 1 THEN 'conflict' ELSE min(status) END AS status FROM (SELECT *, max(reviewed_at) OVER (PARTITION BY claim_id) AS latest_at FROM reviews) WHERE reviewed_at = latest_at GROUP BY 1, 2)
"""
add("lineage_latest_reviews", lambda s, d: ln.latest_reviews(view(s, d, "reviews")), ["reviews"], LAT + "SELECT * FROM lat")
add("lineage_approval_gaps", lambda s, d: ln.approval_gaps(claims(s, d), view(s, d, "reviews")), ["claims", "reviews"], LAT + "SELECT c.claim_id, coalesce(status, 'none') AS latest FROM claims c LEFT JOIN lat ON c.claim_id = lat.claim_id WHERE material AND coalesce(status, 'none') <> 'approved'")
add("lineage_inspect_claim", lambda s, d: ln.inspect_claim(9, claims(s, d), edges(s, d)), E, "SELECT target_kind, target_id, CASE WHEN target_kind = 'claim' THEN value END AS value FROM support_edges e LEFT JOIN claims c ON e.target_id = c.claim_id WHERE e.claim_id = 9")
add("lineage_display_match", lambda s, d: view(s, d, "claim_displays").select("claim_id", tx.display_matches("value", "display_value").alias("matches")), ["claim_displays"],
    "SELECT claim_id, abs(value - CASE WHEN claim_id % 7 = 0 THEN 1000 * floor(value / 1000) ELSE floor(value) + claim_id % 3 END) <= CASE WHEN claim_id % 7 = 0 THEN 500 ELSE 0.5 END AS matches FROM claim_displays")
add("lineage_record_hash", lambda s, d: ln.record_snapshot(rows(s, d).select("event_id", F.concat(F.lit('{"id":'), F.col("event_id").cast("string"), F.lit(', "a":"'), F.col("type"), F.lit('"}')).alias("p")), "event_id", "p"), LR,
    """SELECT event_id AS source_id, 'canonical_record' AS hash_scope, concat('sha256:', sha256(concat('{"a":"', type, '","id":', CAST(event_id AS VARCHAR), '}'))) AS content_hash FROM ledger_rows""")

# ---- text
docs = lambda s, d: view(s, d, "docs")
PII = r"""len(list_filter(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@([A-Za-z0-9.-]+\.[A-Za-z]{2,})', 1), lambda x: NOT (lower(x) IN ('example.com', 'example.org', 'example.net') OR ends_with(lower(x), '.example.com') OR ends_with(lower(x), '.example.org') OR ends_with(lower(x), '.example.net')))) > 0"""
add("text_pii_scan", lambda s, d: docs(s, d).select("doc_id", F.array_join(tx.pii_hits("text"), ",").alias("hits")).where("hits <> ''"), ["docs"], rf"""SELECT * FROM (SELECT doc_id, array_to_string(list_filter([CASE WHEN {PII} THEN 'email' END, CASE WHEN regexp_matches(text, '\b\d{{3}}[-.\s]\d{{2}}[-.\s]\d{{4}}\b') THEN 'ssn' END,
CASE WHEN regexp_matches(text, '(^|[^0-9])\(?\d{{3}}\)?[-.\s]\d{{3}}[-.\s]\d{{4}}($|[^0-9])') THEN 'phone' END], lambda z: z IS NOT NULL), ',') AS hits FROM docs) WHERE hits <> ''""")
_INJ = ["ignore (all )?(previous|prior|above)", "disregard (the )?(policy|rules|instructions)", "you are now", r"system\s*:", r"assistant\s*:", "approve (everything|all|anything)", "exfiltrate|leak|send .*secret", "override"]
add("text_injection_scan", lambda s, d: view(s, d, "turns").select("conv_id", "turn", F.size(tx.injection_hits("text")).alias("markers")), ["turns"],
    "SELECT conv_id, turn, CAST(" + " + ".join(f"CAST(regexp_matches(lower(text), '{p}') AS INTEGER)" for p in _INJ) + " AS INTEGER) AS markers FROM turns")
add("text_deny_tokens", lambda s, d: tx.deny_tokens(docs(s, d), "doc_id", "text", view(s, d, "roster"), "token"), ["docs", "roster"], """SELECT doc_id, count(DISTINCT w) AS hits FROM (SELECT doc_id, unnest(string_split(upper(regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g')), ' ')) AS w FROM docs)
WHERE w IN (SELECT token FROM roster) GROUP BY 1""")
add("text_fence", lambda s, d: docs(s, d).select("doc_id", sha256(tx.fence("text")).alias("digest")), ["docs"], "SELECT doc_id, sha256(concat('<<<UNTRUSTED_DATA>>>', chr(10), replace(text, '<<<UNTRUSTED_DATA>>>', ''), chr(10), '<<<UNTRUSTED_DATA>>>')) AS digest FROM docs")
add("text_canonical_json", lambda s, d: view(s, d, "event_props").select("event_id", canonical_json("props").alias("canonical"), sha256(F.col("props")).alias("digest")), ["event_props"], "SELECT event_id, replace(props, ' ', '') AS canonical, sha256(props) AS digest FROM event_props")
add("name_roster_match", lambda s, d: tx.name_matches(view(s, d, "part_names"), view(s, d, "name_roster"), "id", "name"), ["part_names", "name_roster"], """WITH n AS (SELECT id, name, trim(lower(name)) AS n FROM part_names), r AS (SELECT DISTINCT trim(lower(name)) AS n FROM name_roster)
SELECT id, name FROM n WHERE EXISTS (SELECT 1 FROM r WHERE list_has_all(string_split(n.n, ' '), string_split(r.n, ' ')) OR list_has_all(string_split(r.n, ' '), string_split(n.n, ' ')) OR replace(n.n, ' ', '') = replace(r.n, ' ', ''))""")
add("person_feature_hash", lambda s, d: view(s, d, "workers").select("emp_id", F.sha2(F.concat_ws("|", F.format_string("%.6f", F.col("base_salary") / 7.0), F.format_string("%.6f", F.col("scheduled_hours") / 3.0)), 256).alias("digest")), ["workers"],
    "SELECT emp_id, sha256(concat(printf('%.6f', base_salary / 7.0::DOUBLE), '|', printf('%.6f', scheduled_hours / 3.0::DOUBLE))) AS digest FROM workers")

# ---- contracts
V = lambda table, key, rules: " UNION ALL ".join(f"SELECT '{k}' AS rule, CAST({key} AS VARCHAR) AS key, CAST(NULL AS VARCHAR) AS detail FROM {table} WHERE {w}" for k, w in rules.items())
add("contract_case_intervals", lambda s, d: rs.case_intervals(view(s, d, "cases_raw")), ["cases_raw"], V("cases_raw", "case_id", {"opened_missing": "opened_at IS NULL", "resolved_before_opened": "resolved_at < opened_at"}))
add("contract_merit_population", lambda s, d: rs.merit_population(view(s, d, "workers"), view(s, d, "bands")), ["workers", "bands"], V("(SELECT * FROM workers WHERE worker_type = 'employee' AND status <> 'terminated')", "emp_id", {
    "rating_unknown": "rating IS NULL", "promotion_contradiction": "promoted_this_period = 'yes' AND promotion_eligible <> 'yes'", "hours_above_full_time": "scheduled_hours > standard_full_time_hours"}))
add("contract_pay_equity", lambda s, d: rs.pay_equity(view(s, d, "workers")), ["workers"], V("(SELECT * FROM workers WHERE worker_type = 'employee' AND status <> 'terminated')", "emp_id", {"rating_unknown": "rating IS NULL", "level_unknown": "level NOT IN ('L3', 'L4', 'L5', 'L6', 'L7')"}))
add("contract_equity_ledger", lambda s, d: rs.equity_ledger(view(s, d, "grants"), view(s, d, "workers"), view(s, d, "plans"), view(s, d, "share_spine"), view(s, d, "financials")), ["grants", "workers", "plans"],
    V("grants JOIN (SELECT emp_id AS e, term_date FROM workers) w ON grants.emp_id = w.e", "grant_id", {"granted_after_leaving": "grant_date > term_date"}) + """
UNION ALL SELECT 'duplicate_grant', CAST(grant_id AS VARCHAR), CAST(count(*) AS VARCHAR) FROM grants GROUP BY grant_id HAVING count(*) > 1
UNION ALL SELECT DISTINCT 'holder_unknown', CAST(emp_id AS VARCHAR), NULL FROM grants WHERE emp_id NOT IN (SELECT emp_id FROM workers)""")
add("contract_requisitions", lambda s, d: rs.requisitions(view(s, d, "requisitions")), ["requisitions"], V("requisitions", "req_id", {"status_unknown": "status = 'draft'", "updated_before_opened": "last_update < opened_date", "country_text": "NOT regexp_full_match(country, '[A-Za-z0-9][A-Za-z0-9 .,&/()''-]{0,63}')"}))

# ---- reports
flagged = lambda s, d: rp.requisition_flags(view(s, d, "requisitions").where("status <> 'draft'"), AS_OF)
RQ = ["requisitions"]
FL = f"""WITH f AS (SELECT *, {A} - opened_date AS days_open, {A} - last_update AS upd, status = 'open' AND {A} - opened_date > 90 AS ag, status = 'open' AND {A} - last_update > 14 AS stl, status = 'open' AND priority = 'P1' AND pipeline < 3 AS th FROM requisitions WHERE status <> 'draft'),
o AS (SELECT * FROM f WHERE status = 'open')
"""
add("requisition_flags", lambda s, d: flagged(s, d).select("req_id", F.col("days_open").cast("bigint").alias("days_open"), F.array_join("flags", ",").alias("flags")), RQ, FL + "SELECT req_id, days_open, array_to_string(list_filter([CASE WHEN ag THEN 'AGING' END, CASE WHEN stl THEN 'STALE' END, CASE WHEN th THEN 'THIN_PIPELINE' END], lambda z: z IS NOT NULL), ',') AS flags FROM f")
add("requisition_kpis", lambda s, d: rp.requisition_kpis(flagged(s, d)), RQ, FL + "SELECT count(*) FILTER (WHERE status = 'open') AS total_open, count(*) FILTER (WHERE status = 'on-hold') AS on_hold, (SELECT round_even(avg(days_open), 0) FROM o) AS avg_days_open, count(*) FILTER (WHERE ag OR stl OR th) AS at_risk, (SELECT round_even(median(pipeline), 0) FROM o) AS median_pipeline FROM f")
for _by in ("stage", "department", "country"):
    add(f"requisition_mix_{_by}", lambda s, d, b=_by: rp.requisition_mix(flagged(s, d), b), RQ, FL + f"SELECT {_by}, count(*) AS n FROM o GROUP BY 1")
add("requisition_age_bands", lambda s, d: rp.requisition_age_bands(flagged(s, d)), RQ, FL + "SELECT CASE WHEN days_open <= 30 THEN '0-30' WHEN days_open <= 60 THEN '31-60' WHEN days_open <= 90 THEN '61-90' ELSE '90+' END AS band, count(*) AS n FROM o GROUP BY 1")
add("recruiter_scorecard", lambda s, d: rp.recruiter_scorecard(flagged(s, d)), RQ, FL + "SELECT recruiter, count(*) AS reqs, count(*) FILTER (WHERE ag OR stl OR th) AS at_risk, CAST(sum(pipeline) AS BIGINT) AS pipeline, round_even(avg(days_open), 0) AS avg_days_open FROM o GROUP BY 1")
add("requisition_watchlist", lambda s, d: rp.watchlist(flagged(s, d)).select("req_id", F.col("days_since_update").cast("bigint").alias("days_since_update")), RQ, FL + "SELECT req_id, upd AS days_since_update FROM o WHERE upd > 14")
add("requisition_concentration", lambda s, d: rp.requisition_concentration(flagged(s, d)), RQ, FL + """, a AS (SELECT 'aged' AS kind, department AS name, count(*) AS n FROM o WHERE days_open > 90 GROUP BY 2), b AS (SELECT 'at_risk' AS kind, recruiter AS name, count(*) AS n FROM o WHERE ag OR stl OR th GROUP BY 2)
SELECT kind, arg_min(name, (-n, name)) AS name, max(n) AS n, CAST(sum(n) AS BIGINT) AS total FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1""")
snap = lambda s, d: rp.snapshot_enrich(view(s, d, "comp_snapshot"))
SN = """WITH x AS (SELECT *, round_even(base_salary / range_mid, 2) AS compa, base_salary < range_min OR base_salary > range_max AS oob FROM comp_snapshot)
"""
CS = ["comp_snapshot"]
add("comp_snapshot_kpis", lambda s, d: rp.snapshot_kpis(snap(s, d)), CS, SN + "SELECT count(*) AS population, round_even(avg(compa), 2) AS avg_compa, count(*) FILTER (WHERE oob) AS out_of_band, count(*) FILTER (WHERE exception_flag = 'yes') AS exceptions, count(*) FILTER (WHERE oob AND exception_flag = 'no') AS unexcepted_oob, round_even(100.0 * count(*) FILTER (WHERE oob) / count(*), 0) AS out_of_band_rate FROM x")
add("comp_snapshot_distribution", lambda s, d: rp.snapshot_distribution(snap(s, d)), CS, SN + "SELECT CASE WHEN compa < 0.8 THEN '<0.80' WHEN compa < 0.9 THEN '0.80-0.90' WHEN compa <= 1.1 THEN '0.90-1.10' WHEN compa <= 1.2 THEN '1.10-1.20' ELSE '>1.20' END AS band, count(*) AS n FROM x GROUP BY 1")
add("comp_snapshot_by_level", lambda s, d: rp.snapshot_by_level(snap(s, d)), CS, SN + "SELECT level, count(*) AS n, round_even(avg(compa), 2) AS avg_compa, count(*) FILTER (WHERE oob) AS oob FROM x GROUP BY 1")
add("comp_snapshot_enriched", lambda s, d: snap(s, d).select("emp_id", "compa_ratio", "direction", "unexcepted"), CS, SN + "SELECT emp_id, compa AS compa_ratio, CASE WHEN base_salary < range_min THEN 'below min' WHEN base_salary > range_max THEN 'above max' ELSE 'in band' END AS direction, oob AND exception_flag = 'no' AS unexcepted FROM x")
