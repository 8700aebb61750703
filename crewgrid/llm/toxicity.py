"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are whole words and the first PREFIX bytes of longer words, lower-cased.  The index is fitted on a bounded sample of the
labelled rows (`Fit.rows`, those with the smallest hash of their id).  Terms that the toxic examples have significantly more
often (likelihood-ratio statistic `Fit.evidence`, and toxic in more than `Fit.purity` of their examples) carry weight; others have weight zero, so most texts have an empty vector.

Search: examples are cut into blocks; per term and block the index keeps the largest weight.  A query adds these to bound each
block, visits blocks from the highest bound, and stops when the next bound is below its k-th best cosine: exact, ties included
by example order.  Votes are weighted by closeness, 1 / (distance + 0.05) times the cosine; `Fit.prior` votes of the toxic rate
among examples without any term calibrate few or distant neighbours, and give the score of a text without terms.

The index, at most Fit.rows examples and Fit.terms terms, is broadcast; every document is scored in a narrow step.

Cases: null and empty texts get the score of texts without terms; labels that are null, or whose document is missing, are
not used; several labels of one id count as their largest; without any labelled row every score is 0.5; null ids are never
examples but are scored; repeated rows are each scored; an empty table gives no rows; further columns are ignored."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from crewgrid.llm import textops as X
from crewgrid.llm.contamination import WORD, _Members

PREFIX = 4


@dataclass(frozen=True)
class Fit:
    rows: int = 30_000
    terms: int = 50_000
    evidence: float = 24.0
    purity: float = 0.6
    neighbours: int = 15
    block: int = 64
    prior: float = 0.15


def _terms(data, offs):
    """Term hashes of a piece, and the document of each."""
    starts, ends = X.spans(WORD[data], offs)
    doc = np.searchsorted(offs, starts, "right") - 1
    long = ends - starts > PREFIX
    cut = X.run_hashes(data, starts[long], starts[long] + PREFIX, X.LOWER_BYTE) ^ np.uint64(0x5851F42D4C957F2D)
    return np.concatenate([X.run_hashes(data, starts, ends, X.LOWER_BYTE), cut]), np.concatenate([doc, doc[long]])


def _bags(h, doc):
    """Distinct (document, term) with counts, by document then term."""
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))) if len(h) else np.zeros(0, np.int64)
    return h[first], doc[first], np.diff(np.append(first, len(h)))


def _examples(docs, labels, id_col, text_col, label_col, label_id, fit):
    known = labels.where(F.col(label_col).isNotNull() & F.col(label_id).isNotNull()).groupBy(F.col(label_id).alias("key")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    chosen = known.orderBy(F.xxhash64("key"), "key").limit(fit.rows)
    texts = docs.select(F.col(id_col).alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "key").select("key", "y", "text")  # fit.rows ids at most


def _term_counts(examples):
    def count(batches):
        parts = {0: [], 1: []}
        docs = [0, 0]
        for b in batches:
            y = np.asarray(b.column(1).to_numpy(zero_copy_only=False), np.int64)
            for lo, hi, data, offs in X.pieces(b.column(2)):
                h, doc, _ = _bags(*_terms(data, offs))
                for v in (0, 1):
                    parts[v].append(np.unique(h[y[lo:hi][doc] == v], return_counts=True))
            docs[0] += int((y == 0).sum())
            docs[1] += int((y != 0).sum())
        for v in (0, 1):
            if parts[v]:
                terms, at = np.unique(np.concatenate([p[0] for p in parts[v]]), return_inverse=True)
                n = np.bincount(at, np.concatenate([p[1] for p in parts[v]]), len(terms)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(terms.astype(np.int64)), pa.array(n * (v == 0)), pa.array(n * (v == 1)), pa.array(np.zeros(len(n), bool))], names=["term", "a0", "a1", "total"])
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([docs[0]], pa.int64()), pa.array([docs[1]], pa.int64()), pa.array([True])], names=["term", "a0", "a1", "total"])

    return examples.mapInArrow(count, "term long, a0 long, a1 long, total boolean").groupBy("term", "total").agg(F.sum("a0").alias("a0"), F.sum("a1").alias("a1"))


def _chosen_terms(counts, fit):
    """(terms, idf, examples of each class); counts is small enough to shuffle, only the chosen terms reach the driver."""
    n = counts.where("total").first()
    n0, n1 = (n["a0"], n["a1"]) if n else (0, 0)
    if not n0 + n1:
        return np.zeros(0, np.uint64), np.zeros(0), 0, 0
    p = n1 / (n0 + n1)
    df = F.col("a0") + F.col("a1")

    def part(k, q):
        return F.when(k > 0, k * F.log(k / (df * F.lit(max(q, 1e-12))))).otherwise(0.0)

    g = 2 * (part(F.col("a1"), p) + part(F.col("a0"), 1 - p))
    rows = counts.where("not total").where((F.col("a1") > df * max(p, fit.purity)) & (g >= fit.evidence)).orderBy(g.desc(), "term").limit(fit.terms).select("term", df.alias("df")).collect()
    terms = np.array([r["term"] for r in rows], np.int64).astype(np.uint64)
    df = np.array([r["df"] for r in rows], float)
    order = np.argsort(terms)
    return terms[order], np.log((1 + n0 + n1) / (1 + df[order])) + 1, n0, n1


class _Vectors:
    """TF-IDF vectors of length one over the chosen terms."""

    def __init__(self, terms, idf):
        self.members, self.idf = _Members(terms), idf

    def of(self, data, offs):
        """(document, term, weight), by document; documents without terms are absent."""
        h, doc = _terms(data, offs)
        at, place = self.members.find(h)
        place, doc, tf = _bags(place, doc[at])
        w = (1 + np.log(tf)) * self.idf[place]
        norm = np.sqrt(np.bincount(doc, w * w, len(offs) - 1))
        return doc, place, w / norm[doc]


class BlockMax:
    """Inverted index over example vectors: postings by term, and the largest weight per term and block."""

    def __init__(self, n_docs, n_terms, doc, term, weight, block):
        self.block, self.n = block, n_docs
        order = np.lexsort((doc, term))
        self.doc, self.weight, term = doc[order], weight[order], term[order]
        self.first = np.searchsorted(term, np.arange(n_terms + 1))
        cell = term * (n_docs // block + 1) + self.doc // block  # non-empty (term, block) cells in order
        at = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else np.zeros(0, np.int64)
        self.cell_block = (self.doc[at] // block).astype(np.int64)
        self.cell_max = np.maximum.reduceat(self.weight, at) if len(at) else np.zeros(0)
        self.cell_from, self.cell_to = at, np.append(at[1:], len(cell))
        self.term_cells = np.searchsorted(at, self.first)

    def nearest(self, terms, weights, k):
        """The k nearest examples: (examples, cosines), best first; only examples with a common term."""
        cells = [np.arange(self.term_cells[t], self.term_cells[t + 1]) for t in terms]
        q = np.repeat(weights, [len(c) for c in cells])
        cells = np.concatenate(cells)
        bound = np.bincount(self.cell_block[cells], q * self.cell_max[cells])
        by_block = np.argsort(self.cell_block[cells], kind="stable")
        cells, q = cells[by_block], q[by_block]
        edges = np.searchsorted(self.cell_block[cells], np.arange(len(bound) + 1))
        best_doc, best = np.zeros(0, np.int64), np.zeros(0)
        for b in np.argsort(-bound, kind="stable"):
            if bound[b] <= 0 or (len(best) == k and bound[b] < best[-1] - 1e-12):
                break
            acc = np.zeros(self.block)
            for c, w in zip(cells[edges[b]:edges[b + 1]].tolist(), q[edges[b]:edges[b + 1]].tolist()):
                s = slice(self.cell_from[c], self.cell_to[c])
                acc[self.doc[s] - b * self.block] += w * self.weight[s]
            hit = np.flatnonzero(acc)
            best_doc, best = np.concatenate([best_doc, hit + b * self.block]), np.concatenate([best, acc[hit]])
            keep = np.lexsort((best_doc, -best))[:k]
            best_doc, best = best_doc[keep], best[keep]
        return best_doc, best


def fit_index(docs, labels, id_col="doc_id", text_col="text", label_col="toxic", label_id="doc_id", fit=Fit()):
    """The broadcastable index of a bounded sample of labelled rows."""
    examples = X.written(docs.sparkSession, _examples(docs, labels, id_col, text_col, label_col, label_id, fit), "examples")
    terms, idf, n0, n1 = _chosen_terms(_term_counts(examples), fit)
    held = docs.sparkSession.sparkContext.broadcast((terms, idf))

    def vectors(batches):
        v = _Vectors(*held.value)
        for b in batches:
            for lo, hi, data, offs in X.pieces(b.column(2)):
                doc, place, w = v.of(data, offs)
                edge = np.searchsorted(doc, np.arange(hi - lo + 1))
                some = np.flatnonzero(np.diff(edge))
                part = b.slice(lo, hi - lo).take(pa.array(some))
                lists = [pa.array([x[edge[d]:edge[d + 1]] for d in some], t) for x, t in ((place, pa.list_(pa.int64())), (w, pa.list_(pa.float64())))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *lists], names=["key", "y", "terms", "weights"])

    kind = examples.schema["key"].dataType.simpleString()
    rows = examples.mapInArrow(vectors, f"key {kind}, y int, terms array<long>, weights array<double>").orderBy("key").collect()  # fit.rows at most
    n = np.array([len(r["terms"]) for r in rows], np.int64)
    flat = lambda c, t: np.array([x for r in rows for x in r[c]], t)
    y = np.array([r["y"] for r in rows], np.int64)
    rest0, rest1 = n0 - int((y == 0).sum()), n1 - int((y != 0).sum())
    return {
        "terms": terms, "idf": idf, "y": y, "keys": [r["key"] for r in rows],
        "index": BlockMax(len(rows), len(terms), np.repeat(np.arange(len(rows)), n), flat("terms", np.int64), flat("weights", float), fit.block),
        "rest": (rest1 + 0.5) / (rest0 + rest1 + 1.0) if n0 + n1 else 0.5, "fit": fit,
    }


def score(docs, index, id_cols=("doc_id",), text_col="text", evidence=3):
    """Per row: its id columns, score in 0 to 1, neighbours (ids of the nearest examples) and their cosines."""
    texts = X.plain_text(docs, id_cols, text_col)
    held, k = docs.sparkSession.sparkContext.broadcast(index), len(id_cols)
    keys = pa.array(index["keys"])
    kind = "long" if pa.types.is_integer(keys.type) or not len(keys) else "string"

    def step(batches):
        ix = held.value
        fit, vectors, y = ix["fit"], _Vectors(ix["terms"], ix["idf"]), ix["y"]
        for b in batches:
            scores, near, cosines = [], [], []
            for lo, hi, data, offs in X.pieces(b.column(k)):
                doc, place, w = vectors.of(data, offs)
                edge = np.searchsorted(doc, np.arange(hi - lo + 1))
                for d in range(hi - lo):
                    got, cos = (), ()
                    value = ix["rest"]
                    if edge[d + 1] > edge[d]:
                        got, cos = ix["index"].nearest(place[edge[d]:edge[d + 1]], w[edge[d]:edge[d + 1]], fit.neighbours)
                        vote = cos / (1.05 - np.minimum(cos, 1.0))
                        value = float((fit.prior * ix["rest"] + (vote * (y[got] != 0)).sum()) / (fit.prior + vote.sum()))
                    scores.append(min(1.0, max(0.0, value)))
                    near.append([ix["keys"][g] for g in got[:evidence]])
                    cosines.append([float(c) for c in cos[:evidence]])
            cols = [pa.array(scores, pa.float64()), pa.array(near, pa.list_(pa.int64() if kind == "long" else pa.string())), pa.array(cosines, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:k], *cols], names=[*b.schema.names[:k], "score", "neighbours", "cosines"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema[:-1])
    return texts.mapInArrow(step, f"{schema}, score double, neighbours array<{kind}>, cosines array<double>")


THRESHOLD = 0.7


def trained(docs, labels, fit=Fit()):
    """The index learned from the labelled rows that are not held out."""
    return fit_index(docs, labels.where(X.hash_bucket(F.col("doc_id"), 3) != 1), fit=fit)


def op6_toxicity(spark, sf_dir):
    docs = X.read(spark, sf_dir, "documents")
    found = score(docs, trained(docs, X.read(spark, sf_dir, "labels")))
    return found.select("doc_id", (X.hash_bucket(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "neighbours", "cosines")
