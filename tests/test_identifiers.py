"""Gates over real identifiers, compared with sets in plain Python."""

import random
import re

import pytest

from crewgrid.operators import identifiers as idn


@pytest.fixture(scope="module")
def universe(spark):
    rows = [("aapx ", "Apex Widgets, Inc.", "no"), ("QTX", "Quartz Co", "no"), ("", "Blank Ticker LLC", "no"), (None, None, "no"), ("SUBQ", "Subject Corp", "yes"), ("QTX", "Quartz Co", "no")]
    return spark.createDataFrame(rows, "ticker string, company_name string, is_subject string")


def test_roster(spark, universe):
    former = spark.createDataFrame([("Old Name Inc",), (" ",)], "n string")
    tickers, names = idn.real_roster(universe, former=former, require=True)
    assert {r[0] for r in tickers.collect()} == {"AAPX", "QTX"}
    assert {r[0] for r in names.collect()} == {"apex widgets", "quartz", "blank ticker", "old name"}


def test_empty_roster_raises_when_required(universe):
    only = universe.where("is_subject = 'yes'")
    assert idn.real_roster(only)[0].count() == 0
    with pytest.raises(ValueError):
        idn.real_roster(only, require=True)
    with pytest.raises(ValueError):
        idn.real_roster(universe.where("company_name is null"), require=True)


def test_bits_lose_no_word(spark, monkeypatch):
    monkeypatch.setattr(idn, "BITS", 1 << 16)  # crowded on purpose
    words = [f"W{i}" for i in range(20000)]
    roster = spark.createDataFrame([(w,) for w in words[::7]], "ticker string")
    rows = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string")
    may = {r.w for r in idn.may_hold(rows, "w", roster, "ticker").collect()}
    assert set(words[::7]) <= may and len(may) < 8000
    assert sorted(r.w for r in idn.on_roster(rows, "w", roster, "ticker").collect()) == sorted(words[::7])


def test_hot_and_repeated_words_keep_every_row(spark):
    rows = spark.createDataFrame([(i, "HOT" if i % 3 else f"X{i}") for i in range(3000)], "i int, w string")
    roster = spark.createDataFrame([("HOT",), ("HOT",)], "ticker string")
    assert idn.on_roster(rows, "w", roster, "ticker").count() == 2000


def test_rules(spark, universe):
    tickers, names = idn.real_roster(universe)
    rows = spark.createDataFrame([(1, "ABCQ", "Made Up"), (2, " qtx", "Fine Name"), (3, "AB1Q", "APEX WIDGETS"), (4, None, None), (5, "ABCQ", "Made Up")], "id int, ticker string, company_name string")
    got = sorted((r.rule, r.key, r.detail or "") for r in idn.identifier_rules(rows, "id", tickers, names).collect())
    assert got == [("not_invented", "2", "QTX"), ("not_invented", "3", "AB1Q"), ("not_invented", "4", ""), ("real_name", "3", ""), ("real_ticker", "2", "QTX")]
    assert idn.identifier_rules(rows.limit(0), "id", tickers, names).count() == 0


def test_text_mentions_match_brute_force(spark):
    rng = random.Random(3)
    roster = {f"{a}{b}X" for a in "ABCDE" for b in "FGHIJ"} | {"BRK.B"}
    pieces = sorted(roster) + ["afX", "AFXs", "xAFX", "AFX1", "BRK", "plain", "A", "é"]
    texts = [(i, rng.choice([" ", ", ", ". ", "-x "]).join(rng.choice(pieces) for _ in range(rng.randrange(0, 40)))) for i in range(300)] + [(300, None), (301, "")]
    want = {}
    for i, t in texts:
        for w in re.findall(r"(?<![A-Za-z0-9])[A-Z][A-Z0-9.\-]*(?![a-z])", t or ""):
            w = w.rstrip(".-")
            if w in roster:
                want[i, w] = want.get((i, w), 0) + 1
    got = idn.text_mentions(spark.createDataFrame(texts, "id int, text string"), "id", "text", spark.createDataFrame([(w,) for w in roster], "ticker string"))
    assert {(r.key, r.ticker): r.n for r in got.collect()} == want
