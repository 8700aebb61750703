"""The corpus pipeline: toxic documents go, one document of each near-duplicate group stays, documents with benchmark
passages go, secrets are masked, and what is left is encoded as SentencePiece ids.

Each stage takes (spark, docs, sf_dir) and works on all documents its predecessor kept; docs is read from Parquet each time.
All but the last return the columns of documents.  Null ids stay documents of their own; null texts stay null until they are
encoded, as the empty text; empty tables pass through."""

from __future__ import annotations

from pyspark.sql import functions as F

from crewgrid.llm import contamination, neardup, pieces, secrets, toxicity
from crewgrid.llm import textops as X

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
CARRIED = ["doc_id", "original", "lang", "source", "n_chars"]
ORACLE_SQL = None


def _carried(docs):
    """documents with the text twice: as it is, to be kept, and as what an operator reads."""
    return docs.select("doc_id", F.col("text").alias("original"), "lang", "source", "n_chars", "text")


def _documents(rows, text="original"):
    return rows.select("doc_id", F.col(text).alias("text"), "lang", "source", "n_chars")


def drop_toxic(spark, docs, sf_dir):
    index = toxicity.trained(docs, X.read(spark, sf_dir, "labels"))
    return _documents(toxicity.score(_carried(docs), index, CARRIED).where(F.col("score") < toxicity.THRESHOLD))


def drop_near_duplicates(spark, docs, sf_dir):
    return neardup.one_of_each(docs, COLUMNS)


def drop_contaminated(spark, docs, sf_dir):
    return _documents(contamination.contamination(_carried(docs), X.read(spark, sf_dir, "benchmark"), CARRIED).where(F.size("runs") == 0))


def mask_secrets(spark, docs, sf_dir):
    found = secrets.scan(_carried(docs), secrets.fit_field(docs), CARRIED)
    changed = F.size("spans") > 0
    return found.select("doc_id", F.when(changed, F.col("clean")).otherwise(F.col("original")).alias("text"), "lang", "source", F.when(changed, F.length("clean").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def encode_pieces(spark, docs, sf_dir):
    return pieces.encode(docs, ["doc_id", "lang", "source", "n_chars"])


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("sentencepiece", encode_pieces),
]


def run(spark, sf_dir):
    docs = X.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = X.written(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
