"""Real identifiers in tables that must hold invented ones only: a roster of real tickers and names, and gates over key and text columns.

The roster may be larger than a broadcast.  Words of all rows are first tested against a bit table of fixed size, which goes to
every task; words that may be on the roster are then confirmed by an exact join, so the bits never decide a result."""

from __future__ import annotations

from pyspark.sql import functions as F

from crewgrid.functions.numeric import col
from crewgrid.functions.text import canonical_name, name_matches

BITS = 1 << 27  # 16 MB in all; a larger roster lets more words through to the exact join
SPREAD = 16  # parts of the rows of one confirmed word
# Fixed value: the form of an invented ticker.
INVENTED = r"^[A-Z]{3}Q$"


def ticker(c):
    """Upper case without blanks around; null for an empty one."""
    t = F.upper(F.trim(col(c)))
    return F.when(t != "", t)


def real_roster(universe, ticker_col="ticker", name_col="company_name", subject_col="is_subject", former=None, require=False):
    """(tickers, names): distinct tickers and canonical names of the rows that are not the subject, former names added.

    With `require`, a roster without tickers or without names of its own raises: an empty roster would pass everything."""
    peers = universe.where(F.col(subject_col).isin("no"))
    tickers = peers.select(ticker(ticker_col).alias("ticker")).where("ticker is not null").distinct()
    own = peers.select(canonical_name(name_col).alias("name")).where("name <> ''").distinct()
    if require and (tickers.isEmpty() or own.isEmpty()):
        raise ValueError("the roster of real identifiers has no tickers or no names")
    names = own if former is None else own.unionByName(former.select(canonical_name(former.columns[0]).alias("name")).where("name <> ''")).distinct()
    return tickers, names


def _places(word):
    return [F.pmod(F.xxhash64(F.lit(seed), word), F.lit(BITS)) + 1 for seed in (1, 2)]


def bit_table(roster, word):
    """(bucket, bits): the roster's two places a word, 4,096 bytes a bucket and at most BITS / 32768 buckets."""
    at = roster.select(F.explode(F.array(*_places(F.col(word)))).alias("at"))
    return at.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))


def may_hold(rows, word, roster, roster_word):
    """Rows whose word has both its bits set: all rows with a word on the roster, and few others."""
    out, bits = rows, bit_table(roster, roster_word)
    for i, at in enumerate(_places(F.col(word))):
        place = F.bitmap_bit_position(at)
        byte = F.conv(F.hex(F.substring(F.col("_bits"), (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        table = F.broadcast(bits.select(F.col("bucket").alias("_bucket"), F.col("bits").alias("_bits")))
        out = out.withColumn("_bucket", F.bitmap_bucket_number(at)).join(table, "_bucket").where(byte.bitwiseAND(F.pow(F.lit(2), place % 8).cast("int")) != 0).drop("_bucket", "_bits")
    return out


def on_roster(rows, word, roster, roster_word):
    """Rows whose word is on the roster, exactly.  The rows of one word are dealt to SPREAD parts by their other columns."""
    left = may_hold(rows, word, roster, roster_word)
    seen = left.select(F.col(word).alias("_w")).distinct()
    sure = seen.join(roster.select(F.col(roster_word).alias("_w")).distinct(), "_w", "left_semi").select("_w", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("_part"))
    dealt = left.withColumn("_part", F.pmod(F.xxhash64(*rows.columns), F.lit(SPREAD)).cast("int")).withColumn("_w", F.col(word))
    return dealt.join(sure, ["_w", "_part"], "left_semi").drop("_w", "_part")


def identifier_rules(rows, key, tickers, names, ticker_col="ticker", name_col="company_name", shape=INVENTED):
    """(rule, key, detail): tickers on the roster, tickers not of the invented form, names that match a real one."""
    t = rows.select(F.col(key).cast("string").alias("key"), ticker(ticker_col).alias("detail"))
    real = on_roster(t.where("detail is not null"), "detail", tickers, "ticker").select(F.lit("real_ticker").alias("rule"), "key", "detail")
    form = t.where(~F.coalesce(F.col("detail").rlike(shape), F.lit(False))).select(F.lit("not_invented").alias("rule"), "key", "detail")
    out = real.unionByName(form)
    if names is None:
        return out
    named = name_matches(rows.select(F.col(key).cast("string").alias("key"), F.col(name_col).alias("name")), names, "key", "name")
    return out.unionByName(named.select(F.lit("real_name").alias("rule"), "key", F.lit(None).cast("string").alias("detail")).distinct())


def text_mentions(docs, key, text, tickers):
    """(key, ticker, n): how often each text names a real ticker, as a whole word in capitals."""
    words = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"(?<![A-Za-z0-9])[A-Z][A-Z0-9.\-]*(?![a-z])"), F.lit(0))
    bare = F.transform(words, lambda w: F.rtrim(w, F.lit(".-")))
    w = may_hold(docs.select(F.col(key).alias("key"), F.explode(bare).alias("ticker")), "ticker", tickers, "ticker")
    return on_roster(w.groupBy("key", "ticker").agg(F.count(F.lit(1)).alias("n")), "ticker", tickers, "ticker")
