"""People-shaped views over the driver's tables.

Each view is one plain SELECT in a dialect Spark and DuckDB share, so the same
mapping feeds the DataFrame operators and the SQL they are compared with.  The
views hold no analytics: only renames, modulus labels and one-level sums.
"""

from __future__ import annotations

import datetime as dt
import re

from crewgrid.session import table

AS_OF = dt.date(2000, 12, 31)

BASE = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "pages", "benchmark", "labels", "conversations",
)

VIEWS = {}

VIEWS["order_span"] = """
SELECT o_custkey AS k, CAST(min(o_orderdate) AS DATE) AS first_day, CAST(max(o_orderdate) AS DATE) AS last_day
FROM {orders} GROUP BY o_custkey"""

VIEWS["horizon"] = "SELECT CAST(max(o_orderdate) AS DATE) AS day FROM {orders}"

VIEWS["workers"] = """
SELECT c_custkey AS emp_id,
  CASE WHEN c_custkey % 20 = 7 THEN 'contractor' ELSE 'employee' END AS worker_type,
  CASE WHEN left_day IS NOT NULL THEN 'terminated' WHEN c_custkey % 17 = 0 THEN 'on_leave' ELSE 'active' END AS status,
  first_day AS hire_date, left_day AS term_date,
  CASE WHEN left_day IS NULL THEN NULL WHEN c_custkey % 3 = 0 THEN 'involuntary' ELSE 'voluntary' END AS term_type,
  CASE WHEN left_day IS NOT NULL AND c_custkey % 3 <> 0 AND c_custkey % 4 = 1 THEN 'yes' ELSE 'no' END AS regrettable,
  concat('L', CAST(3 + c_custkey % 5 AS STRING)) AS level,
  c_mktsegment AS job_family,
  concat('N', CAST(c_nationkey AS STRING)) AS location,
  CASE WHEN c_custkey < 6 THEN NULL ELSE CAST((c_custkey - c_custkey % 6) / 6 AS BIGINT) END AS manager_id,
  CASE WHEN c_custkey % 7 = 0 THEN 'yes' ELSE 'no' END AS is_people_manager,
  CAST(CASE WHEN c_custkey % 10 = 0 THEN 1040 WHEN c_custkey % 10 = 3 THEN 2600 ELSE 2080 END AS BIGINT) AS scheduled_hours,
  CAST(2080 AS BIGINT) AS standard_full_time_hours,
  CAST(30000 + 20000 * (c_custkey % 5) + floor(greatest(c_acctbal, 0) * 4) AS BIGINT) AS base_salary,
  concat('L', CAST(3 + c_custkey % 5 AS STRING), '-', c_mktsegment) AS band_id,
  CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 11 = 1 THEN 'below' WHEN c_custkey % 11 < 7 THEN 'meets'
       WHEN c_custkey % 11 < 10 THEN 'exceeds' ELSE 'outstanding' END AS rating,
  CASE WHEN c_custkey % 97 = 0 THEN NULL WHEN c_custkey % 8 IN (0, 3, 5) THEN 'B' ELSE 'A' END AS gender_group,
  CASE WHEN c_custkey % 9 < 5 THEN 'grp1' WHEN c_custkey % 9 < 8 THEN 'grp2' ELSE 'grp3' END AS ethnicity_group,
  CASE WHEN c_custkey % 3 = 1 THEN 'no' ELSE 'yes' END AS promotion_eligible,
  CASE WHEN c_custkey % 24 = 2 THEN 'yes' ELSE 'no' END AS promoted_this_period,
  first_day AS level_entry_date,
  CASE WHEN c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 13 < 5 THEN 'Low' WHEN c_custkey % 13 < 10 THEN 'Med' ELSE 'High' END AS potential
FROM (SELECT c.*, s.first_day,
        CASE WHEN CAST(s.last_day + INTERVAL 180 DAY AS DATE) < (SELECT day FROM horizon) THEN s.last_day END AS left_day
      FROM {customer} c JOIN order_span s ON c.c_custkey = s.k) x"""

VIEWS["bands"] = """
SELECT concat(level, '-', family) AS band_id, level, family AS job_family,
  CAST(0.8 * mid AS BIGINT) AS range_min, mid AS range_mid, CAST(1.2 * mid AS BIGINT) AS range_max
FROM (SELECT DISTINCT c_mktsegment AS family FROM {customer}) f
CROSS JOIN (SELECT 'L3' AS level, CAST(50000 AS BIGINT) AS mid UNION ALL SELECT 'L4', 70000 UNION ALL SELECT 'L5', 90000
            UNION ALL SELECT 'L6', 110000 UNION ALL SELECT 'L7', 130000) l"""

VIEWS["case_lines"] = "SELECT l_orderkey AS k, max(l_shipdate) AS last_ship FROM {lineitem} GROUP BY l_orderkey"

VIEWS["cases_raw"] = """
SELECT o.o_orderkey AS case_id, o.o_orderdate AS opened_at,
  CASE WHEN o.o_orderstatus <> 'O' THEN l.last_ship END AS resolved_at,
  o.o_orderpriority AS category,
  CAST(4000 * (1 + o.o_orderkey % 5) AS BIGINT) AS sla_target_hours,
  CASE WHEN o.o_orderkey % 9 = 0 THEN 'yes' ELSE 'no' END AS reopened,
  CASE WHEN o.o_orderkey % 4 = 1 THEN 'yes' ELSE 'no' END AS first_contact_resolution,
  CASE WHEN o.o_orderkey % 3 = 0 THEN NULL ELSE 1 + o.o_orderkey % 5 END AS csat,
  o.o_custkey AS emp_id
FROM {orders} o LEFT JOIN case_lines l ON o.o_orderkey = l.k"""

VIEWS["cases"] = """
SELECT case_id, opened_at, CASE WHEN resolved_at >= opened_at THEN resolved_at END AS resolved_at, category,
  sla_target_hours, reopened, first_contact_resolution, csat, emp_id
FROM cases_raw"""

VIEWS["benefits"] = """
SELECT c_custkey AS emp_id, benefit,
  CASE WHEN (c_custkey + bx) % 10 = 0 THEN 'no' ELSE 'yes' END AS eligible,
  CASE WHEN (c_custkey * bx) % 4 = 1 OR (c_custkey + bx) % 10 = 0 THEN 'no' ELSE 'yes' END AS enrolled,
  CAST(500 * bx + c_custkey % 100 AS BIGINT) AS employer_cost_annual
FROM {customer} CROSS JOIN (SELECT 'medical' AS benefit, 1 AS bx UNION ALL SELECT 'dental', 2 UNION ALL SELECT 'vision', 3
  UNION ALL SELECT 'retirement', 4 UNION ALL SELECT 'commuter', 5) b"""

VIEWS["financials"] = """
SELECT CAST(CAST(qs + INTERVAL 3 MONTH AS DATE) - INTERVAL 1 DAY AS DATE) AS period_end, revenue_usd
FROM (SELECT CAST(date_trunc('quarter', o_orderdate) AS DATE) AS qs,
        CAST(floor(sum(CAST(o_totalprice AS DECIMAL(18, 2)))) AS BIGINT) AS revenue_usd
      FROM {orders} GROUP BY 1) q"""

VIEWS["share_spine"] = """
SELECT period_end, CAST(1000000 + 10000 * qx AS BIGINT) AS common_shares_outstanding,
  CAST(980000 + 9800 * qx AS BIGINT) AS waso_basic, CAST(1020000 + 10200 * qx AS BIGINT) AS waso_diluted,
  20.0E0 + qx * 0.5E0 AS close_price_usd, 0.08E0 + 0.02E0 * (qx % 20) AS annualized_volatility
FROM (SELECT period_end, (year(period_end) - 1995) * 4 + (month(period_end) - 3) / 3 AS qx FROM financials) f"""

VIEWS["grants"] = """
SELECT l_orderkey * 10 + l_linenumber AS grant_id,
  CASE WHEN l_suppkey % 2 = 0 THEN 'P-A' ELSE 'P-B' END AS plan_id, l_suppkey AS emp_id,
  CASE WHEN l_suppkey = 0 THEN 'ceo' WHEN l_suppkey % 10 = 1 THEN 'section16' WHEN l_suppkey % 3 = 0 THEN 'management' ELSE 'staff' END AS participant_group,
  CASE l_returnflag WHEN 'A' THEN 'option' WHEN 'R' THEN 'psu' ELSE 'rsu' END AS award_type,
  CAST(l_shipdate AS DATE) AS grant_date, CAST(l_quantity AS BIGINT) AS shares_granted,
  CAST(floor(l_extendedprice / l_quantity) AS BIGINT) AS stock_price_at_grant_usd,
  CAST(floor(l_extendedprice / l_quantity * CASE WHEN l_returnflag = 'A' THEN 0.4E0 ELSE 1.0E0 END) + 1 AS BIGINT) AS grant_date_fv_per_share_usd,
  CAST(l_shipdate AS DATE) AS vest_start_date, CAST(12 * (1 + l_linenumber % 4) AS INT) AS vest_months_total,
  CAST(CASE WHEN l_returnflag = 'R' THEN 12 * (1 + l_linenumber % 4) ELSE 12 END AS INT) AS cliff_months
FROM {lineitem}"""

VIEWS["plans"] = """
SELECT 'P-A' AS plan_id, CAST((SELECT 2 * sum(CAST(l_quantity AS BIGINT)) FROM {lineitem}) AS BIGINT) AS initial_pool_shares, 12 AS min_vesting_months,
  'no' AS permits_repricing, 'no' AS dividends_on_unvested, 'yes' AS discretionary_acceleration, 'strict' AS share_recycling, 'none' AS evergreen
UNION ALL SELECT 'P-B', CAST((SELECT 2 * sum(CAST(l_quantity AS BIGINT)) FROM {lineitem}) AS BIGINT), 6, 'no', 'yes', 'no', 'liberal', 'none'"""

VIEWS["companies"] = """
SELECT c.c_custkey AS ticker, c.c_name AS company_name, r.r_name AS sector, c.c_mktsegment AS subindustry,
  o.revenue AS revenue_usd, CAST(2000000 + floor(greatest(c.c_acctbal, 0) * 1000) AS BIGINT) AS market_cap_usd,
  o.n AS employees, o.revenue * 2 AS total_assets_usd
FROM (SELECT o_custkey AS k, CAST(floor(sum(CAST(o_totalprice AS DECIMAL(18, 2)))) AS BIGINT) AS revenue, count(*) AS n FROM {orders} GROUP BY 1) o
JOIN {customer} c ON c.c_custkey = o.k JOIN {nation} n ON c.c_nationkey = n.n_nationkey JOIN {region} r ON n.n_regionkey = r.r_regionkey"""

VIEWS["peer_edges"] = """
SELECT DISTINCT e.src, e.dst FROM (
  SELECT c_custkey AS src, (c_custkey * 31 + 17 * i * i + 7 * i + 1) % (SELECT count(*) FROM {customer}) AS dst
  FROM {customer} CROSS JOIN (SELECT 1 AS i UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6
    UNION ALL SELECT 7 UNION ALL SELECT 8 UNION ALL SELECT 9 UNION ALL SELECT 10 UNION ALL SELECT 11 UNION ALL SELECT 12) n) e
JOIN order_span s ON e.src = s.k JOIN order_span d ON e.dst = d.k WHERE e.src <> e.dst"""

_YEAR_SUMS = ", ".join(
    f"CAST(floor(sum(CASE WHEN year(o_orderdate) = {1995 + y} THEN CAST(o_totalprice AS DECIMAL(18, 2)) ELSE 0 END)) AS BIGINT) AS s{y}"
    for y in range(1, 6)
)
_PER_YEAR = ", ".join(
    f"100000 + s{y} AS pay_y{y}, 40.0E0 + (s{y} + k) % 161 AS tsrval_y{y}, 200000 + s{y} % 70001 AS neo_other_pay_y{y}, "
    f"20000 + (s{y} * 3) % 30011 AS sti_payout_y{y}, 30000 + k % 1009 AS sti_target_y{y}, 90000 + (s{y} * 7) % 400009 AS cap_y{y}, "
    f"1.0E0 + (s{y} % 97) * 0.25E0 AS eps_y{y}, 50000 + s{y} AS rev_y{y}, 1000 + s{y} % 5003 AS ocf_y{y}, "
    f"((s{y} + k) % 41) * 0.5E0 - 5 AS roe_y{y}, ((s{y} + 3 * k) % 31) * 0.25E0 - 2 AS roa_y{y}"
    for y in range(1, 6)
)
VIEWS["company_years"] = f"""
SELECT k AS ticker, {_PER_YEAR}, ((s1 + s5 + k) % 2003) * 0.125E0 - 20 AS fin_eva,
  50.0E0 + (k % 101) * 0.5E0 AS prior_support_pct,
  CASE k % 4 WHEN 0 THEN 'robust' WHEN 1 THEN 'limited' WHEN 2 THEN 'none' ELSE 'n/a' END AS responsiveness
FROM (SELECT o_custkey AS k, {_YEAR_SUMS} FROM {{orders}} GROUP BY o_custkey) y"""

# Every supplier's sales are read as one company's disclosed officer pay: five
# roles, several rows per role, so that incumbents have to be picked.
VIEWS["proxy_pay"] = """
SELECT l_orderkey * 10 + l_linenumber AS row_id, l_suppkey AS ticker,
  CASE l_linenumber % 6 WHEN 0 THEN 'CEO' WHEN 1 THEN 'CFO' WHEN 2 THEN 'COO' WHEN 3 THEN 'CLO' WHEN 4 THEN 'CHRO' ELSE 'CTO' END AS role,
  CASE l_orderkey % 7 WHEN 0 THEN 'former officer' WHEN 1 THEN 'Interim officer' ELSE 'officer' END AS title,
  CAST(floor(l_extendedprice) AS BIGINT) AS salary, CAST(floor(l_extendedprice * l_discount) AS BIGINT) AS bonus,
  CAST(l_quantity * 1000 AS BIGINT) AS stock_awards, CAST(l_linenumber * 500 AS BIGINT) AS option_awards,
  CAST(floor(l_extendedprice * l_tax) AS BIGINT) AS non_equity_incentive, CAST(l_orderkey % 900 AS BIGINT) AS other_comp,
  CASE WHEN l_suppkey % 9 = 4 THEN 'foreign_issuer_limited' ELSE 'def14a' END AS disclosure,
  CASE WHEN l_orderkey % 50 = 3 THEN 'EXCLUDE: part year' ELSE '' END AS row_caveat
FROM {lineitem}"""

# Decision ledgers of at most 100 events each; ten events share one thread.
VIEWS["ledger_rows"] = """
SELECT event_id, CAST((event_id - event_id % 100) / 100 AS BIGINT) AS ledger_id, CAST(event_id % 100 AS BIGINT) AS sequence, event_id AS position, user_id AS actor_id,
  CASE WHEN (user_id % 10 = 9) <> (event_id % 53 = 0) THEN 'agent' ELSE 'human' END AS actor_kind,
  CASE event_id % 10 WHEN 0 THEN 'recommendation' WHEN 5 THEN 'recommendation' WHEN 1 THEN 'approval' WHEN 6 THEN 'approval' WHEN 8 THEN 'approval' WHEN 4 THEN CASE WHEN event_id % 4 = 0 THEN 'note' ELSE 'fyi' END ELSE 'action' END AS type,
  event_id % 10 IN (0, 5) AND event_id % 29 <> 0 AS requires_approval,
  CASE WHEN event_id % 10 IN (1, 6, 8) THEN CASE WHEN event_type = 'error' THEN 'denied' WHEN event_id % 59 = 0 THEN 'maybe' ELSE 'approved' END END AS decision,
  CASE WHEN event_id % 10 IN (1, 2, 6, 7) THEN CASE WHEN event_id % 13 = 0 THEN event_id + 3 ELSE event_id - 1 END WHEN event_id % 10 = 3 THEN event_id - 2 WHEN event_id % 10 = 8 THEN event_id - 3 WHEN event_id % 10 = 9 THEN event_id - 1 END AS causation_id,
  CASE WHEN event_id % 17 = 0 THEN 'other' WHEN event_id % 41 = 0 THEN NULL WHEN ((event_id - event_id % 10) / 10) % 3 = 2 THEN 'audit' ELSE 'publish' END AS scope,
  CASE WHEN event_id % 41 = 0 THEN 'publish' END AS approval_scope,
  CASE WHEN event_id % 61 = 0 THEN NULL WHEN event_id % 19 = 0 THEN 'sha256:0f' ELSE concat('sha256:', CAST(CAST((event_id - event_id % 10) / 10 AS BIGINT) AS STRING)) END AS auth,
  (user_id % 4 <> 0) <> (event_id % 23 = 0) AS logged_entitled,
  CASE WHEN event_id % 101 = 0 THEN '' ELSE concat('c', CAST(user_id % 5 AS STRING)) END AS channel,
  CASE WHEN event_id % 97 = 4 THEN NULL ELSE CAST((event_id - event_id % 10) / 10 AS BIGINT) END AS correlation_id,
  CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 31 = 0 THEN concat('k', CAST(event_id - 1 AS STRING)) ELSE concat('k', CAST(event_id AS STRING)) END AS idempotency_key,
  concat(CAST(event_id AS STRING), ':', event_type, ':', CAST(user_id AS STRING), ':', props) AS body
FROM {events}"""

# The same events as members of JSON objects, in key order, with <> for braces; `cause` is the place of the causing event in its ledger.
VIEWS["event_parts"] = """
SELECT ledger_id, sequence, event_id, CASE WHEN causation_id IS NOT NULL THEN CAST(causation_id - ledger_id * 100 AS INT) END AS cause,
  concat('"actor":<"display":"', CASE WHEN event_id % 71 = 2 THEN 'Boss' ELSE concat('D', CAST(actor_id AS STRING)) END, '","id":"', CAST(actor_id AS STRING), '","kind":"', actor_kind, '","role":"staff">',
    CASE WHEN decision IS NULL THEN '' ELSE concat(',"approval":<"by":"', CASE WHEN event_id % 43 = 6 THEN 'u-other' ELSE CAST(actor_id AS STRING) END, '","decision":"', decision, '","entitled":', CASE WHEN logged_entitled THEN 'true' ELSE 'false' END,
      CASE WHEN event_id % 47 = 6 THEN '' WHEN event_id % 53 = 8 THEN ',"registry_version":"v0"' ELSE ',"registry_version":"v1"' END,
      ',"scope":"', CASE WHEN scope IS NOT NULL AND event_id % 37 = 1 THEN 'other2' WHEN scope IS NULL THEN approval_scope ELSE scope END, '">') END,
    CASE WHEN auth IS NULL THEN '' ELSE concat(',"authorization":<"artifacts":[<"artifact_id":"a-1","content_hash":"sha256:', repeat('ab', 32), '","evidence_hash":"sha256:', lpad(replace(auth, 'sha256:', ''), 64, '0'), '">],"bundle_hash":"sha256:', repeat('0c', 32), '","bundle_id":"pack-1","material_claim_ids_hash":"sha256:', repeat('1d', 32), '">') END) AS a,
  concat(',"channel":"', channel, '"', CASE WHEN correlation_id IS NULL THEN '' ELSE concat(',"correlation_id":"T', CAST(correlation_id AS STRING), '"') END) AS a2,
  concat(CASE WHEN idempotency_key IS NULL THEN '' ELSE concat(',"idempotency_key":"', idempotency_key, '"') END, ',"payload":<"n":', CAST(sequence AS STRING), '.5,"t":"é ', type, '">') AS b,
  concat(CASE WHEN type = 'recommendation' THEN concat(',"requires_approval":', CASE WHEN requires_approval THEN 'true' ELSE 'false' END) ELSE '' END, ',"schema_version":"1.2"',
    CASE WHEN scope IS NULL THEN '' ELSE concat(',"scope":"', scope, '"') END, ',"sequence":', CAST(sequence AS STRING), ',"ts":"2000-01-01","type":"', type, '"') AS c
FROM ledger_rows"""

# Orders as bundles of the artifacts their lines stand for.
VIEWS["bundle_artifacts"] = """
SELECT DISTINCT l_orderkey AS bundle_no, concat('a', lpad(CAST(l_linenumber AS STRING), 2, '0'), '-', CAST(l_partkey AS STRING)) AS artifact_id,
  CASE WHEN l_partkey % 31 = 4 THEN 'memo' WHEN l_partkey % 2 = 0 THEN 'report' ELSE 'dataset' END AS artifact_type,
  concat('sha256:', lpad(CAST(l_partkey AS STRING), CASE WHEN l_partkey % 37 = 5 THEN 63 ELSE 64 END, '0')) AS content_hash, concat('sha256:', lpad(CAST(l_suppkey AS STRING), 64, 'a')) AS evidence_hash,
  CASE l_partkey % 23 WHEN 3 THEN 'repo:../out/of.txt' WHEN 7 THEN 'repo:/abs.txt' WHEN 9 THEN 'http:x' WHEN 11 THEN 'urn:x' WHEN 12 THEN 'repo:a/./b//c.txt' ELSE concat('repo:out/', CAST(l_partkey AS STRING), '.md') END AS content_uri,
  concat('c', lpad(CAST(l_suppkey % 40 AS STRING), 3, '0')) AS claim_1, concat('d', lpad(CAST(l_partkey % 40 AS STRING), 3, '0')) AS claim_2
FROM {lineitem}"""

VIEWS["manifest_claims"] = """
SELECT DISTINCT l_orderkey AS manifest_no, concat('c', lpad(CAST(l_linenumber AS STRING), 2, '0'), '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING)) AS claim_id, l_partkey AS k, l_suppkey % 3 AS s
FROM {lineitem}"""

VIEWS["real_issuers"] = """
SELECT c_custkey AS k, concat('T', upper(c_mktsegment), '.', CAST(c_custkey AS STRING)) AS ticker, concat('Issuer ', CAST(c_custkey AS STRING), CASE WHEN c_custkey % 2 = 0 THEN ', Inc.' ELSE ' Holdings Ltd' END) AS company_name,
  CASE WHEN c_custkey % 50 = 1 THEN 'yes' ELSE 'no' END AS is_subject FROM {customer}"""

VIEWS["invented_rows"] = """
SELECT o.o_orderkey AS id, CASE WHEN o_orderkey % 97 = 5 THEN concat(' ', lower(i.ticker)) WHEN o_orderkey % 89 = 6 THEN 'ABQQQ' WHEN o_orderkey % 83 = 7 THEN CAST(NULL AS STRING)
    ELSE concat(chr(CAST(65 + o_orderkey % 26 AS INT)), chr(CAST(65 + o_custkey % 26 AS INT)), 'KQ') END AS ticker,
  CASE WHEN o_orderkey % 79 = 8 THEN concat('ISSUER ', CAST(i.k AS STRING), ' Corp') WHEN o_orderkey % 73 = 9 THEN CAST(NULL AS STRING) ELSE concat('Made Up ', chr(CAST(65 + o_orderkey % 26 AS INT))) END AS company_name,
  CASE WHEN o_orderkey % 71 = 1 THEN concat('see ', i.ticker, ', then ', i.ticker, '.') WHEN o_orderkey % 71 = 2 THEN concat('x', i.ticker, ' and ', i.ticker, 'Z') WHEN o_orderkey % 71 = 3 THEN CAST(NULL AS STRING) ELSE concat('ABKQ holds: ', o_comment) END AS note, i.k AS k, i.is_subject AS is_subject
FROM (SELECT DISTINCT o_orderkey, o_custkey, o_orderpriority AS o_comment FROM {orders}) o JOIN real_issuers i ON i.k = o.o_custkey"""

VIEWS["actors"] = """
SELECT DISTINCT user_id AS actor_id, CASE WHEN user_id % 10 = 9 THEN 'agent' ELSE 'human' END AS kind FROM {events}"""
VIEWS["role_members"] = """
SELECT DISTINCT 'publisher' AS role, user_id AS actor_id FROM {events} WHERE user_id % 4 <> 0
UNION ALL SELECT DISTINCT 'auditor', user_id FROM {events} WHERE user_id % 3 = 0"""
VIEWS["scopes"] = "SELECT DISTINCT CASE WHEN event_id % 2 = 0 THEN 'publish' ELSE 'audit' END AS scope, CASE WHEN event_id % 2 = 0 THEN 'publisher' ELSE 'auditor' END AS role FROM {events}"
VIEWS["channel_members"] = "SELECT DISTINCT user_id AS actor_id, concat('c', CAST((user_id + CASE WHEN user_id % 6 = 0 THEN 1 ELSE 0 END) % 5 AS STRING)) AS channel FROM {events}"

# Published claims and what supports them, by key arithmetic over parts.
VIEWS["claims"] = """
SELECT p_partkey AS claim_id, p_partkey % 4 <> 1 AS material, p_partkey % 11 = 5 AS blocked, p_retailprice AS value, p_size AS size
FROM {part}"""

VIEWS["support_edges"] = """
SELECT DISTINCT claim_id, target_kind, target_id FROM (
  SELECT p_partkey AS claim_id, 'claim' AS target_kind, CAST((p_partkey - p_partkey % 3) / 3 AS BIGINT) AS target_id FROM {part} WHERE p_partkey % 3 <> 0 AND p_partkey > 2
  UNION ALL SELECT p_partkey, 'claim', CAST((p_partkey - p_partkey % 5) / 5 AS BIGINT) FROM {part} WHERE p_partkey % 5 = 4
  UNION ALL SELECT l_partkey, 'source', l_suppkey FROM {lineitem} WHERE l_partkey % 3 = 0 AND l_linenumber = 1
  UNION ALL SELECT p_partkey, 'source', p_partkey % 10 FROM {part} WHERE p_partkey < 3) e"""

VIEWS["cyclic_edges"] = """
SELECT * FROM support_edges
UNION ALL SELECT CAST((p_partkey - p_partkey % 3) / 3 AS BIGINT), 'claim', p_partkey FROM {part} WHERE p_partkey % 3 <> 0 AND p_partkey > 2 AND p_partkey % 37 = 1"""

VIEWS["sources"] = "SELECT s_suppkey AS source_id FROM {supplier} WHERE s_suppkey % 50 <> 7"

VIEWS["reviews"] = """
SELECT l_partkey AS claim_id, CASE l_linenumber % 3 WHEN 0 THEN 'rejected' WHEN 1 THEN 'approved' ELSE 'reviewed' END AS status, CAST(CAST(l_shipdate AS DATE) AS STRING) AS reviewed_at
FROM {lineitem} WHERE l_partkey % 9 <> 2"""

VIEWS["claim_caveats"] = "SELECT p_partkey AS claim_id, CASE p_partkey % 3 WHEN 0 THEN 'info' WHEN 1 THEN 'warning' ELSE 'blocking' END AS severity FROM {part} WHERE p_partkey % 5 = 1"
VIEWS["claim_checks"] = "SELECT p_partkey AS claim_id, p_partkey % 20 AS check_id FROM {part} WHERE p_partkey % 4 <> 1"
VIEWS["check_sources"] = "SELECT s_suppkey % 20 AS check_id, s_suppkey AS source_id FROM {supplier}"
VIEWS["claim_displays"] = """
SELECT p_partkey AS claim_id, p_retailprice AS value, CASE WHEN p_partkey % 7 = 0 THEN concat('$', CAST(CAST(floor(p_retailprice / 1000) AS BIGINT) AS STRING), 'K')
  ELSE concat('$', CAST(CAST(floor(p_retailprice) + p_partkey % 3 AS BIGINT) AS STRING)) END AS display_value FROM {part}"""

VIEWS["requisitions"] = """
SELECT concat('R-', CAST(o.o_orderkey AS STRING)) AS req_id, o.o_orderpriority AS title, c.c_mktsegment AS department, concat('N', CAST(c.c_nationkey AS STRING)) AS location, n.n_name AS country,
  CAST(o.o_orderdate AS DATE) AS opened_date, CASE o.o_orderkey % 4 WHEN 0 THEN 'Sourcing' WHEN 1 THEN 'Screen' WHEN 2 THEN 'Onsite' ELSE 'Offer' END AS stage,
  concat('rec ', CAST(o.o_custkey % 25 AS STRING)) AS recruiter, concat('mgr ', CAST(o.o_custkey % 40 AS STRING)) AS hiring_manager, CAST(o.o_orderkey % 9 AS INT) AS pipeline,
  CAST(CASE WHEN o.o_orderkey % 200 = 9 THEN o.o_orderdate - INTERVAL 5 DAY ELSE o.o_orderdate + INTERVAL 20 DAY END AS DATE) AS last_update,
  CASE o.o_orderkey % 3 WHEN 0 THEN 'P1' WHEN 1 THEN 'P2' ELSE 'P3' END AS priority,
  CASE o.o_orderkey % 6 WHEN 0 THEN 'filled' WHEN 1 THEN 'on-hold' WHEN 2 THEN CASE WHEN o.o_orderkey % 11 = 0 THEN 'draft' ELSE 'closed' END ELSE 'open' END AS status
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {nation} n ON c.c_nationkey = n.n_nationkey WHERE CAST(o.o_orderdate AS DATE) <= DATE '2000-12-31'"""

VIEWS["comp_snapshot"] = """
SELECT w.emp_id, w.level, w.job_family, w.location, w.base_salary, b.range_min, b.range_mid, b.range_max, CASE WHEN w.emp_id % 6 = 0 THEN 'yes' ELSE 'no' END AS exception_flag
FROM workers w JOIN bands b ON w.band_id = b.band_id"""

VIEWS["docs"] = "SELECT doc_id, text FROM {documents}"
VIEWS["turns"] = "SELECT conv_id, turn, text FROM {conversations}"
VIEWS["roster"] = "SELECT DISTINCT upper(split_part(p_name, ' ', 1)) AS token FROM {part} UNION SELECT DISTINCT upper(p_type) FROM {part} UNION SELECT 'QUE' UNION SELECT 'THE'"
VIEWS["part_names"] = "SELECT p_partkey AS id, concat(p_name, CASE WHEN p_partkey % 3 = 0 THEN concat(' ', lower(p_type)) ELSE '' END) AS name FROM {part}"
VIEWS["name_roster"] = "SELECT DISTINCT concat(split_part(p_name, ' ', 2), ' ', lower(p_type)) AS name FROM {part} WHERE p_partkey % 10 = 3"

VIEWS["event_props"] = "SELECT event_id, props FROM {events}"

VIEWS["month_orders"] = """
SELECT o_custkey AS k, CAST((year(o_orderdate) - 1998) * 12 + month(o_orderdate) - 1 AS INT) AS mi, count(*) AS n FROM {orders} GROUP BY 1, 2"""

VIEWS["panel_months"] = """
SELECT mi, CAST(CAST(DATE '1998-02-01' + mi * INTERVAL 1 MONTH AS DATE) - INTERVAL 1 DAY AS DATE) AS month FROM (
  SELECT CAST(a.i * 6 + b.i AS INT) AS mi FROM (SELECT 0 AS i UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5) a
  CROSS JOIN (SELECT 0 AS i UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5) b) x"""

VIEWS["panel"] = """
SELECT w.emp_id, m.month, m.mi AS month_index, w.level, w.job_family, w.location, w.emp_id * 100 + m.mi AS row_id,
  CASE WHEN w.term_date > m.month AND (year(w.term_date) - 1998) * 12 + month(w.term_date) - 1 = m.mi + 1 THEN CASE WHEN w.emp_id % 15 = 6 THEN 'retirement' ELSE w.term_type END ELSE 'none' END AS event_next,
  w.base_salary / (50000.0E0 + 20000 * (w.emp_id % 5)) AS comp_ratio,
  CAST(coalesce(a.n, 0) + coalesce(b.n, 0) + coalesce(c.n, 0) AS DOUBLE) AS recent_orders,
  CASE WHEN (w.emp_id + m.mi) % 7 = 3 THEN NULL ELSE CAST(coalesce(a.n, 0) - coalesce(c.n, 0) AS DOUBLE) END AS order_trend,
  CAST(CASE WHEN (year(m.month) - year(w.hire_date)) * 12 + month(m.month) - month(w.hire_date) BETWEEN 18 AND 24 THEN 1 ELSE 0 END AS DOUBLE) AS tenure_window,
  CAST(w.emp_id % 5 AS DOUBLE) AS grade, CAST((w.emp_id * 37 + m.mi * 11) % 17 AS DOUBLE) AS noise
FROM workers w JOIN panel_months m ON w.hire_date <= m.month AND (w.term_date IS NULL OR w.term_date > m.month)
LEFT JOIN month_orders a ON a.k = w.emp_id AND a.mi = m.mi LEFT JOIN month_orders b ON b.k = w.emp_id AND b.mi = m.mi - 1 LEFT JOIN month_orders c ON c.k = w.emp_id AND c.mi = m.mi - 2
WHERE w.worker_type = 'employee'"""

VIEWS["unit_prices"] = """
SELECT l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS day, CAST(l_orderkey AS BIGINT) * 1000000000 + l_partkey * 10 + l_linenumber AS seq, CAST(floor(l_extendedprice / l_quantity) AS BIGINT) AS price FROM {lineitem}"""

VIEWS["plan_companies"] = """
SELECT CAST((s_suppkey - s_suppkey % 25) / 25 AS BIGINT) AS plan_id, s_suppkey AS ticker, CASE WHEN s_suppkey % 25 = 0 THEN 'issuer' ELSE 'peer' END AS role, s_suppkey % 13 <> 5 AS index_start, s_suppkey % 17 <> 3 AS index_end FROM {supplier}"""

VIEWS["tranches"] = """
SELECT DISTINCT l_suppkey AS company_id, l_suppkey * 10 + l_linenumber % 4 AS neo_id, concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING)) AS tranche_id,
  CASE l_returnflag WHEN 'A' THEN 'option' WHEN 'R' THEN 'psu_rtsr' ELSE 'rsu' END AS type, CAST(year(l_shipdate) AS INT) AS grant_fy, CAST(l_shipdate AS DATE) AS grant_date,
  CAST(l_shipdate + INTERVAL 500 DAY AS DATE) AS vest_date, l_partkey % 8 = 3 AS forfeited, CASE WHEN l_partkey % 8 = 3 THEN CAST(l_shipdate + INTERVAL 200 DAY AS DATE) END AS forfeit_date,
  CAST(l_quantity AS BIGINT) AS shares, CAST(30 + l_partkey % 40 AS BIGINT) AS strike, CAST(l_shipdate + INTERVAL 1500 DAY AS DATE) AS expiry, CAST(l_shipdate AS DATE) AS performance_end, CAST(50 + l_partkey % 100 AS DOUBLE) AS earned_pct
FROM {lineitem}"""

VIEWS["company_prices"] = """
SELECT company_id, day, CAST(20 + (company_id * 7 + day_no) % 80 AS BIGINT) AS price FROM (
  SELECT DISTINCT company_id, day, CAST(year(day) * 372 + month(day) * 31 + day(day) AS BIGINT) AS day_no FROM (
    SELECT company_id, vest_date AS day FROM tranches UNION ALL SELECT s_suppkey, CAST('1996-12-31' AS DATE) FROM {supplier} UNION ALL SELECT s_suppkey, CAST('1997-12-31' AS DATE) FROM {supplier} UNION ALL SELECT s_suppkey, CAST('1998-12-31' AS DATE) FROM {supplier}
    UNION ALL SELECT s_suppkey, CAST('1999-12-31' AS DATE) FROM {supplier} UNION ALL SELECT s_suppkey, CAST('2000-12-31' AS DATE) FROM {supplier}) d) x"""

VIEWS["officer_pay"] = """
SELECT company_id, neo_id, neo_id % 10 = 0 AS is_peo, y AS fy, CAST(1000000 + neo_id * 100 + y AS BIGINT) AS total, CAST(400000 + neo_id AS BIGINT) AS stock_awards, CAST(100000 + y AS BIGINT) AS option_awards
FROM (SELECT DISTINCT company_id, neo_id FROM tranches) n CROSS JOIN (SELECT CAST(1997 AS INT) AS y UNION ALL SELECT 1998 UNION ALL SELECT 1999 UNION ALL SELECT 2000) ys"""

VIEWS["officer_pension"] = "SELECT company_id, neo_id, fy, CAST(neo_id % 7 * 100 + fy % 10 - 30 AS DOUBLE) AS pension FROM officer_pay WHERE neo_id % 3 = 1"

VIEWS["open_tranches"] = "SELECT company_id, neo_id, tranche_id, type, grant_fy, grant_date, vest_date, forfeited, forfeit_date, shares, strike, expiry, vest_date AS performance_end, earned_pct FROM tranches"

VIEWS["award_dividends"] = """
SELECT company_id, tranche_id, y AS fy, CAST(shares * (y % 4 + 1) AS DOUBLE) AS amount FROM open_tranches
CROSS JOIN (SELECT CAST(1997 AS INT) AS y UNION ALL SELECT 1998 UNION ALL SELECT 1999 UNION ALL SELECT 2000) ys WHERE shares % 3 <> 1"""

VIEWS["pay_peers"] = """
SELECT s_suppkey AS company_id, CASE WHEN s_suppkey > k THEN s_suppkey - k ELSE s_suppkey + k END AS peer, CAST(20 + s_suppkey % 50 + k AS DOUBLE) AS spot
FROM {supplier} CROSS JOIN (SELECT CAST(1 AS BIGINT) AS k UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) ks"""

VIEWS["filer_results"] = """
SELECT l_suppkey AS company_id, CAST(year(l_shipdate) AS INT) AS fy, CAST(sum(CAST(floor(l_extendedprice) AS BIGINT) - 35000) AS DOUBLE) AS net_income_usd, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS csm_usd FROM {lineitem} GROUP BY 1, 2"""

VIEWS["pay_rows"] = """
SELECT concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING), '-', CAST(CAST(floor(l_extendedprice * 100) AS BIGINT) AS STRING)) AS doc_id, l_partkey AS k, concat('Officer ', CAST(l_suppkey AS STRING)) AS title,
  CAST(floor(l_extendedprice) AS BIGINT) AS salary, CAST(floor(l_extendedprice * l_discount) AS BIGINT) AS bonus, CAST(l_quantity * 1000 AS BIGINT) AS stock_awards, CAST(l_linenumber * 500 AS BIGINT) AS option_awards,
  CAST(floor(l_extendedprice * l_tax) AS BIGINT) AS non_equity_incentive, CAST(l_orderkey % 900 AS BIGINT) AS other_comp FROM {lineitem}"""

_NAMES = {k: re.compile(rf"\b{k}\b") for k in VIEWS}


def _closure(names, given=()):
    order, seen = [], set()

    def visit(n):
        if n in seen:
            return
        seen.add(n)
        for other, pat in _NAMES.items():
            if other != n and n not in given and pat.search(VIEWS[n]):
                visit(other)
        order.append(n)

    for n in names:
        visit(n)
    return order


def with_clause(names, given=()):
    """'WITH a AS (...), b AS (...)' for the views and whatever they read; given ones are read as frames."""
    parts = [f"{n} AS (SELECT * FROM {{{n}}})" if n in given else f"{n} AS ({VIEWS[n]})" for n in _closure(names, given)]
    return "WITH " + ",\n".join(parts)


def oracle(names, body):
    """One self-contained SQL statement over the plain table names."""
    if not names:
        return body.strip()
    text = with_clause(names)
    for t in BASE:
        text = text.replace("{" + t + "}", t)
    body = body.strip()
    if body[:5].upper() == "WITH ":
        return text + ",\n" + body[5:]
    return text + "\n" + body


def view(spark, sf_dir, name, **given):
    """given: frames to read in place of views that this one is made of, as they are stored once and used by several."""
    text = with_clause([name], given)
    frames = {t: table(spark, sf_dir, t) for t in BASE if "{" + t + "}" in text} | {n: df for n, df in given.items() if "{" + n + "}" in text}
    return spark.sql(f"{text}\nSELECT * FROM {name}", **frames)
