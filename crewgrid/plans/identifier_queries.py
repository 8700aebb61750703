"""Gates over real identifiers: every customer but the subjects is a real issuer, every order a row that should hold invented ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from crewgrid.operators import identifiers as idn
from crewgrid.plans.catalog import add
from crewgrid.views import view

V = ["real_issuers", "invented_rows"]


def _roster(s, d):
    tickers, names = idn.real_roster(view(s, d, "real_issuers"))
    return tickers.select(F.lit("ticker").alias("what"), F.col("ticker").alias("word")).unionByName(names.select(F.lit("name").alias("what"), F.col("name").alias("word")))


add("identifier_roster", _roster, V, "SELECT 'ticker' AS what, ticker AS word FROM real_issuers WHERE is_subject = 'no' UNION ALL SELECT 'name', concat('issuer ', k) FROM real_issuers WHERE is_subject = 'no'")
add("identifier_gate", lambda s, d: idn.identifier_rules(view(s, d, "invented_rows"), "id", *idn.real_roster(view(s, d, "real_issuers"))), V, """WITH r AS (SELECT *, upper(trim(ticker)) AS t FROM invented_rows)
SELECT 'real_ticker' AS rule, CAST(id AS VARCHAR) AS key, t AS detail FROM r WHERE t IN (SELECT ticker FROM real_issuers WHERE is_subject = 'no')
UNION ALL SELECT 'not_invented', CAST(id AS VARCHAR), t FROM r WHERE t IS NULL OR NOT regexp_full_match(t, '[A-Z]{3}Q')
UNION ALL SELECT 'real_name', CAST(id AS VARCHAR), NULL FROM r WHERE company_name LIKE 'ISSUER %' AND is_subject = 'no'""")
add("identifier_mentions", lambda s, d: idn.text_mentions(view(s, d, "invented_rows"), "id", "note", idn.real_roster(view(s, d, "real_issuers"))[0]), V, """SELECT id AS key, i.ticker, 2 AS n
FROM invented_rows r JOIN real_issuers i ON r.k = i.k WHERE starts_with(note, 'see ') AND i.is_subject = 'no'""")
