"""Ranked lexical search, reversed: documents stream through a broadcast index over the items.

The items' terms form the inverted index (term -> items, with repeats).  Each task streams its documents' term counts through
it, adds up integer scores per item, and keeps a bounded heap of the best documents of each item; the heaps of all tasks are
merged by rank.  A first pass counts documents, terms, and the documents of each item term.

The items are broadcast in slices of about SLICE_BYTES of text, so no broadcast grows with them.  A task keeps items x k
entries and a block of at most BLOCK scores; documents are never shuffled, and a merge reads at most k rows a task and item.

Cases: null or empty texts have no terms: such documents count nowhere and are never found, such items find nothing; repeated
items count once, and two texts under one item id are two searches; repeated documents are each a document; equal scores go by
ascending document id, null ids last; an empty table gives no rows; further columns are ignored."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Window, functions as F

from crewgrid.llm import textops as X
from crewgrid.llm.contamination import _Members, _words

BEST = 10
SLICE_BYTES = 4 << 20
BLOCK = 2_000_000


def _bags(h, lo, hi):
    """(document, term, repeats) of the terms of each document, by document."""
    doc = np.repeat(np.arange(len(lo)), hi - lo)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))) if len(h) else np.zeros(0, np.int64)
    return doc[first], h[first], np.diff(np.append(first, len(h)))


def corpus_counts(texts, vocabulary=None):
    """Rows (term, n): documents that hold each term, of the given terms only if any are given; and under a null term the
    rows (documents with a term, all terms)."""
    held = texts.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches):
        seen = None if held.value is None else _Members(held.value)
        parts, docs, total = [], 0, 0
        for b in batches:
            for _, _, data, offs in X.pieces(b.column(0)):
                h, lo, hi = _words(data, offs)
                docs, total = docs + int((hi > lo).sum()), total + len(h)
                doc = np.repeat(np.arange(len(lo)), hi - lo)
                if seen is not None:
                    at, place = seen.find(h)
                    key = np.unique(doc[at] * len(seen.values) + place) if len(at) else at
                    parts.append(np.unique(seen.values[key % len(seen.values)], return_counts=True) if len(key) else (h[:0], key))
                else:
                    parts.append(np.unique(_bags(h, lo, hi)[1], return_counts=True))
            if len(parts) >= 16:
                parts = [_added(parts)]
        terms, n = _added(parts) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(terms.astype(np.int64)), pa.array(n, pa.int64()), pa.array(np.zeros(len(n)), pa.int64())], names=["term", "n", "total"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([docs], pa.int64()), pa.array([total], pa.int64())], names=["term", "n", "total"])

    return texts.select("text").mapInArrow(count, "term long, n long, total long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def _added(parts):
    terms, at = np.unique(np.concatenate([t for t, _ in parts]), return_inverse=True)
    return terms, np.bincount(at, np.concatenate([n for _, n in parts]), len(terms)).astype(np.int64)


def _item_terms(rows):
    data, offs = X.as_bytes(pa.array([r["text"] for r in rows], pa.large_string()))
    return _words(data, offs)


def weight(n_docs, df):
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _index(rows, df, n_docs):
    """Postings of a slice: sorted terms; for each its items and weight x repeats in the item."""
    item, term, repeats = _bags(*_item_terms(rows))
    order = np.argsort(term, kind="stable")
    item, term, repeats = item[order], term[order], repeats[order]
    terms, first = np.unique(term, return_index=True)
    w = np.array([weight(n_docs, df.get(t, 0)) for t in terms.tolist()], np.int64)
    return {"terms": terms, "first": np.append(first, len(term)), "item": item, "gain": repeats * np.repeat(w, np.diff(np.append(first, len(term)))), "n_items": len(rows)}


class Heaps:
    """The k best (score, document) of each item."""

    def __init__(self, n_items, k):
        self.k, self.n = k, n_items
        self.floor = np.ones(n_items, np.int64)
        self.item, self.score, self.doc, self.null = (np.zeros(0, np.int64) for _ in range(4))

    def update(self, scores, doc, null):
        """scores: documents x items."""
        d, i = np.nonzero(scores >= self.floor)
        if not len(d):
            return
        item, score = np.concatenate([self.item, i]), np.concatenate([self.score, scores[d, i]])
        doc, null = np.concatenate([self.doc, doc[d]]), np.concatenate([self.null, null[d]])
        order = np.lexsort((doc, null, -score, item))
        item = item[order]
        first = np.searchsorted(item, item)
        keep = order[np.arange(len(item)) - first < self.k]
        self.item, self.score, self.doc, self.null = (np.concatenate([self.item, i]))[keep], score[keep], doc[keep], null[keep]
        last = np.bincount(self.item, minlength=self.n) == self.k
        ends = np.searchsorted(self.item, np.arange(self.n), "right") - 1
        self.floor[last] = self.score[ends[last]]


def _searched(held, k, n_docs, n_terms):
    def search(batches):
        ix = held.value
        members, heaps = _Members(ix["terms"]), Heaps(ix["n_items"], k)
        block = max(1, BLOCK // max(1, ix["n_items"]))
        for b in batches:
            ids = b.column(0)
            null = ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
            ids = ids.fill_null(0).to_numpy()
            for p, _, data, offs in X.pieces(b.column(1)):
                h, lo, hi = _words(data, offs)
                n = hi - lo
                m = 25 + 75 * n * n_docs // max(1, n_terms)
                doc, term, tf = _bags(h, lo, hi)
                at, place = members.find(term)
                doc, tf = doc[at], tf[at]
                part = 1_000_000_000 * tf // (1000 * tf + 8 * m[doc])
                for d in range(0, len(n), block):
                    lo_, hi_ = np.searchsorted(doc, (d, d + block))
                    first, size = ix["first"][place[lo_:hi_]], np.diff(ix["first"])[place[lo_:hi_]]
                    post = np.repeat(first - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
                    rows = min(block, len(n) - d)
                    scores = np.zeros((rows, ix["n_items"]), np.int64)
                    np.add.at(scores.reshape(-1), np.repeat(doc[lo_:hi_] - d, size) * ix["n_items"] + ix["item"][post], np.repeat(part[lo_:hi_], size) * ix["gain"][post])
                    heaps.update(scores, ids[p + d:p + d + rows], null[p + d:p + d + rows])
        found = pa.array(heaps.doc, pa.int64(), mask=heaps.null == 1)
        yield pa.RecordBatch.from_arrays([pa.array(heaps.item, pa.int64()), found, pa.array(heaps.score, pa.int64())], names=["row", "doc", "score"])

    return search


def search(docs, items, id_col="doc_id", text_col="text", item_col="item_id", item_text="text", k=BEST, slice_bytes=SLICE_BYTES):
    """Per item its k best documents: item_col, rank, id_col (long), score."""
    spark = docs.sparkSession
    texts = X.plain_text(docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")), ["doc"])
    asked = items.select(F.col(item_col).alias("item"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("text")).distinct()
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(size // slice_bytes) + 1
    asked = asked.withColumn("part", F.pmod(F.xxhash64("item", "text"), F.lit(n)))
    kind = asked.schema["item"].dataType.simpleString()
    whole = None if n > 1 else np.unique(_item_terms(asked.select("text").collect())[0])  # one slice at most
    counts = X.written(spark, corpus_counts(texts, whole), "terms")
    told = counts.where("term is null").first()
    n_docs, n_terms = (told["n"], told["total"]) if told else (0, 0)
    out = []
    for s in range(n):
        rows = asked.where(F.col("part") == s).select("item", "text").orderBy("item", "text").collect()  # about slice_bytes
        terms = np.unique(_item_terms(rows)[0]).astype(np.int64)
        wanted = spark.createDataFrame(pa.table({"term": pa.array(terms, pa.int64())}))
        df = {r["term"] & 0xFFFFFFFFFFFFFFFF: r["n"] for r in counts.join(F.broadcast(wanted), "term").select("term", "n").collect()}  # terms of a slice
        heaps = texts.mapInArrow(_searched(spark.sparkContext.broadcast(_index(rows, df, n_docs)), k, n_docs, n_terms), "row long, doc long, score long")
        names = spark.createDataFrame([(i, r["item"]) for i, r in enumerate(rows)], f"row long, item {kind}")
        rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("doc")))
        out.append(heaps.withColumn("rank", rank).where(F.col("rank") <= k).join(F.broadcast(names), "row"))  # ids of one slice
    found = out[0]
    for f in out[1:]:
        found = found.unionAll(f)
    return found.select(F.col("item").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("doc").alias(id_col), "score")


def op12_ranked_search(spark, sf_dir):
    return search(X.read(spark, sf_dir, "documents"), X.read(spark, sf_dir, "benchmark"))


TERMS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT doc_id, len(t) AS n, t FROM (SELECT doc_id, {TERMS_SQL} AS t FROM documents) WHERE len(t) > 0),
size AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS nt FROM d),
q AS (SELECT item_id, term, count(*) AS q FROM (SELECT item_id, unnest({TERMS_SQL}) AS term FROM benchmark) GROUP BY item_id, term),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY doc_id, n, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * nd + 2) / (2 * df + 1))) AS BIGINT) AS w FROM df, size),
s AS (SELECT item_id, doc_id, CAST(sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * nd) // nt)))) AS BIGINT) AS score FROM tf JOIN q USING (term) JOIN w USING (term), size GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""
