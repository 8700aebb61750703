"""Benchmark decontamination by a prefix-filtered set join.

An item's shingles are its runs of WINDOW words (an item with fewer words is one shingle).  A document contains a shingle
only if it contains each of its words, so with words ordered by how often the corpus has them, a prefix of one word, the
shingle's rarest, is enough to find every candidate.  A candidate then has to lie inside its document (length and positional
bound), and all its words are compared over the shingle's own length.

The benchmark is broadcast in slices of about SLICE_BYTES of text, each a narrow step over the documents, so no broadcast
grows with it.  Documents are never shuffled.

Cases: null or empty text has no words; null ids stay; repeated rows are each reported; an empty benchmark or table gives
no hits or no rows; columns other than those named are ignored; ties in rarity go to the smaller hash."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F, types as T

from crewgrid.llm import textops as X

WINDOW = 10
SLICE_BYTES = 4 << 20
WORD = np.ones(256, bool)
WORD[0x00:0x30] = WORD[0x3A:0x41] = WORD[0x5B:0x61] = WORD[0x7B:0x80] = False


def _words(data, offs):
    starts, ends = X.spans(WORD[data], offs)
    return X.run_hashes(data, starts, ends, X.LOWER_BYTE), *X.doc_ranges(starts, offs)


class _Members:
    """Membership and place in a sorted array, behind a bit table that refuses most values at once."""

    def __init__(self, values):
        self.values = np.unique(values)
        self.table = np.zeros(1 << 20, bool)
        self.table[self.values & np.uint64((1 << 20) - 1)] = True

    def find(self, h):
        at = np.flatnonzero(self.table[h & np.uint64((1 << 20) - 1)])
        place = np.searchsorted(self.values, h[at])
        place[place == len(self.values)] = 0
        good = self.values[place] == h[at] if len(self.values) else np.zeros(len(at), bool)
        return at[good], place[good]


def _slice_words(rows):
    items = pa.array([r["text"] for r in rows], pa.large_string())
    data, offs = X.as_bytes(items)
    return _words(data, offs)


def _index(rows, window, counts):
    """Distinct shingles of a slice, sorted by their rarest word."""
    h, lo, hi = _slice_words(rows)
    seen = {}
    for i, (a, b) in enumerate(zip(lo, hi)):
        for s in range(a, max(a + 1, b - window + 1) if b > a else a):
            seen.setdefault(tuple(h[s:min(s + window, b)].tolist()), set()).add(rows[i]["item"])
    keys, members = list(seen), [sorted(x) for x in seen.values()]
    size = np.array([len(k) for k in keys], np.int64)
    grid = np.zeros((len(keys), window), np.uint64)
    for i, k in enumerate(keys):
        grid[i, :len(k)] = k
    rarest = np.array([min(range(len(k)), key=lambda j: (counts.get(k[j], 0), k[j])) for k in keys], np.int64)
    prefix = grid[np.arange(len(keys)), rarest] if keys else np.zeros(0, np.uint64)
    order = np.argsort(prefix, kind="stable")
    return {"grid": grid[order], "size": size[order], "back": rarest[order], "prefix": prefix[order], "items": [members[i] for i in order]}


def _vocabulary_counts(docs, vocabulary):
    """How often the corpus has each word of a slice."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches):
        seen = _Members(held.value)
        total = np.zeros(len(seen.values), np.int64)
        for b in batches:
            for _, _, data, offs in X.pieces(b.column(0)):
                total += np.bincount(seen.find(_words(data, offs)[0])[1], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.values[at].astype(np.int64)), pa.array(total[at])], names=["word", "n"])

    rows = docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()  # at most a slice's words
    return {r["word"] & 0xFFFFFFFFFFFFFFFF: r["n"] for r in rows}


def _hits(data, offs, ix, members, first):
    """Shingle occurrences of a piece: document, first word in it, end word, shingle."""
    h, lo, hi = _words(data, offs)
    none = np.zeros(0, np.int64)
    at, place = members.find(h)
    if not len(at):
        return lo, hi, none, none, none, none
    n = first[place + 1] - first[place]
    who = np.repeat(first[place] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
    word = np.repeat(at, n)
    doc = np.searchsorted(hi, word, "right")
    start = word - ix["back"][who]
    end = start + ix["size"][who]
    inside = (start >= lo[doc]) & (end <= hi[doc])
    who, doc, start, end = who[inside], doc[inside], start[inside], end[inside]
    same = np.ones(len(who), bool)
    for k in range(ix["grid"].shape[1]):
        live = np.flatnonzero(same & (k < ix["size"][who]))
        same[live] = h[start[live] + k] == ix["grid"][who[live], k]
    return lo, hi, doc[same], start[same], end[same], who[same]


def _step(held):
    def step(batches):
        ix = held.value
        members = _Members(ix["prefix"])
        first = np.searchsorted(ix["prefix"], np.append(members.values, np.uint64(0xFFFFFFFFFFFFFFFF)))
        first[-1] = len(ix["prefix"])
        for b in batches:
            words, found, items = [], [], []
            old_runs, old_items = b.column("runs").to_pylist(), b.column("items").to_pylist()
            for p, _, data, offs in X.pieces(b.column("text")):
                lo, hi, doc, start, end, who = _hits(data, offs, ix, members, first)
                words += (hi - lo).tolist()
                mine = np.searchsorted(doc, np.arange(len(lo) + 1)) if len(doc) and np.all(np.diff(doc) >= 0) else None
                if mine is None:
                    order = np.argsort(doc, kind="stable")
                    doc, start, end, who = doc[order], start[order], end[order], who[order]
                    mine = np.searchsorted(doc, np.arange(len(lo) + 1))
                for d in range(len(lo)):
                    a, z = mine[d], mine[d + 1]
                    runs, got = old_runs[p + d] or [], set(old_items[p + d] or [])
                    if z > a:
                        runs = _merged(runs, start[a:z] - lo[d], end[a:z] - lo[d])
                        for w in set(who[a:z].tolist()):
                            got.update(ix["items"][w])
                    found.append(runs)
                    items.append(sorted(got))
            cols = {"text": b.column("text"), "n_words": pa.array(words, pa.int64()), "runs": pa.array(found, pa.list_(pa.int64())), "items": pa.array(items, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([cols.get(n, b.column(i)) for i, n in enumerate(b.schema.names)], names=b.schema.names)

    return step


def _merged(runs, start, end):
    """Disjoint word runs as a flat list of starts and ends."""
    s = np.concatenate([np.asarray(runs[0::2], np.int64), start])
    e = np.concatenate([np.asarray(runs[1::2], np.int64), end])
    order = np.argsort(s, kind="stable")
    s, e = s[order], np.maximum.accumulate(e[order])
    new = np.append(True, s[1:] > e[:-1])
    at = np.flatnonzero(new)
    return np.column_stack([s[at], np.append(e[at[1:] - 1], e[-1])]).ravel().tolist()


def contamination(docs, benchmark, id_cols=("doc_id",), text_col="text", item_col="item_id", item_text="text", window=WINDOW, slice_bytes=SLICE_BYTES):
    """Per row of docs: its id columns, n_words, runs (flat starts and ends of hit words), items (ids as strings, sorted)."""
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(size // slice_bytes) + 1
    texts = X.plain_text(docs, id_cols, text_col)
    out = texts.select(*id_cols, "text", F.lit(0).cast("long").alias("n_words"), F.array().cast("array<long>").alias("runs"), F.array().cast("array<string>").alias("items"))
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).collect()  # about slice_bytes
        counts = _vocabulary_counts(texts, np.unique(_slice_words(rows)[0]))
        out = out.mapInArrow(_step(spark.sparkContext.broadcast(_index(rows, window, counts))), T.StructType([*out.schema]))
    return out.drop("text")


def op7_decontamination(spark, sf_dir):
    found = contamination(X.read(spark, sf_dir, "documents"), X.read(spark, sf_dir, "benchmark"))
    hit = F.aggregate("runs", F.lit(0).cast("long"), lambda a, x: x - a)  # ends minus starts of an even list
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("runs") > 0).alias("contaminated"),
    )


WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
b AS (SELECT item_id, {WORDS_SQL} AS w FROM benchmark),
shingle AS (SELECT DISTINCT item_id, list_slice(w, s, s + 9) AS g FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(g) AS n FROM shingle),
place AS (SELECT doc_id, s, n, list_slice(w, s, s + n - 1) AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
found AS (SELECT doc_id, s, n, item_id FROM place JOIN shingle USING (g)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM found) GROUP BY doc_id),
item AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM found GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN item USING (doc_id)
"""
