"""Language ID by word-first backoff.

A word is a run of letters and marks, lower-cased.  A word that the model knows scores, for each language, the log of its share
of the language's words.  An unseen word falls back to its character n-grams (with a blank on either side), from ORDERS[0]
down to single letters: the first order with a known n-gram scores the mean over its known n-grams.  What a language has never
seen scores `penalty`, one power of ten below its rarest entry.  A text's score is the mean over its words; the language with the
highest one is predicted, and `score` is its share of exp(mean x EVIDENCE words at most), so short texts stay uncertain.

The model is fitted on a bounded sample of labelled rows: about Fit.rows of each language, chosen by the hash of their id at a
rate that the language's row count gives.  Words and n-grams are counted in tasks and added up; of each order the Fit.words (words) or
Fit.grams entries with most occurrences make the model, and only they reach the driver and the broadcast.  Every document is
scored in one narrow step.

Cases: null and empty texts and texts without a letter are `und` with score 0; so is every text if no row teaches; words with
nothing known score alike for all languages; equal scores go to the first language by name; rows without language teach
nothing but are predicted; repeated rows are each predicted; an empty table gives no rows; further columns are ignored."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from crewgrid.llm import textops as X
from crewgrid.llm.contamination import _Members

ORDERS = (5, 4, 3, 2, 1)
EVIDENCE = 12
UNKNOWN = "und"


@dataclass(frozen=True)
class Fit:
    rows: int = 6_000
    words: int = 300_000
    grams: int = 100_000


@lru_cache(maxsize=1)
def _letters():
    """Of each code point: whether it belongs to words (letters, and the marks that follow them), and a hash value."""
    part = np.fromiter((unicodedata.category(chr(i))[0] in "LM" for i in range(0x110000)), bool, 0x110000)
    return part, X.seeded(0x110000, 11) | np.uint64(1)


@lru_cache(maxsize=1)
def _true_letters():
    return np.fromiter((unicodedata.category(chr(i))[0] == "L" for i in range(0x110000)), bool, 0x110000)


def words_of(texts):
    """(code points with blanks for what is no letter, starts, ends, text of each word, whether each text has a letter)."""
    part, _ = _letters()
    joined = " " + " ".join([t.lower() for t in texts]) + " "
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    lens = np.array([len(t.lower()) for t in texts], np.int64)
    offs = 1 + np.append(0, np.cumsum(lens + 1))
    inside = part[points]
    letter = _true_letters()[points]
    points = np.where(inside, points, 32)
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edge[::2], edge[1::2]
    total = np.append(0, np.cumsum(letter))
    some = total[offs[1:] - 1] > total[offs[:-1]]
    return points, starts, ends, np.searchsorted(offs, starts, "right") - 1, some


def gram_hashes(points, starts, ends, n):
    """(word, hash) of the n-grams of words, a blank on either side."""
    _, table = _letters()
    size = np.maximum(ends - starts + 3 - n, 0)
    word = np.repeat(np.arange(len(starts)), size)
    at = np.repeat(starts - 1 - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
    h = np.zeros(len(at), np.uint64)
    for k in range(n):
        h = h * X.BASE + table[points[at + k]]
    return word, X.mix(h + np.uint64(n))


def _word_hashes(points, starts, ends):
    return X.run_hashes(points, starts, ends, _letters()[1])


def _counted(sample):
    """Rows (lang, kind, entry, n): occurrences of words (kind 0) and n-grams (kind n) in each language; kind -1: all words."""

    def count(batches):
        parts, pending = {}, 0

        def drain():
            for (lang, kind), got in parts.items():
                entry, at = np.unique(np.concatenate([e for e, _ in got]), return_inverse=True)
                n = np.bincount(at, np.concatenate([c for _, c in got]), len(entry)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array([kind] * len(n), pa.int32()), pa.array(entry.astype(np.int64)), pa.array(n)], names=["lang", "kind", "entry", "n"])

        for b in batches:
            lang = np.array(b.column(0).to_pylist(), object)
            for lo, hi, _, _ in X.pieces(b.column(1)):
                texts = b.column(1).slice(lo, hi - lo).to_pylist()
                points, starts, ends, doc, _ = words_of(texts)
                by = lang[lo:hi][doc]
                h = _word_hashes(points, starts, ends)
                grams = {n: gram_hashes(points, starts, ends, n) for n in ORDERS}
                for v in set(by.tolist()):
                    mine = by == v
                    for kind, x in [(0, h[mine]), (-1, np.zeros(int(mine.sum()), np.uint64)), *((n, g[mine[w]]) for n, (w, g) in grams.items())]:
                        parts.setdefault((v, kind), []).append(np.unique(x, return_counts=True))
                        pending += len(parts[v, kind][-1][0])
                if pending > 2_000_000:
                    yield from drain()
                    parts, pending = {}, 0
        yield from drain()

    return sample.mapInArrow(count, "lang string, kind int, entry long, n long").groupBy("lang", "kind", "entry").agg(F.sum("n").alias("n"))


def _sample(docs, id_col, text_col, lang_col, fit):
    """About fit.rows rows of each language: those whose id hashes below the share that many rows are."""
    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 20)).alias("at"))
    share = rows.groupBy("lang").agg((F.lit(float(fit.rows << 20)) / F.count("*")).alias("share"))
    few = share.limit(10_001).count() <= 10_000  # one row a language: beyond that Spark chooses the join
    return rows.join(F.broadcast(share) if few else share, "lang").where(F.col("at") < F.col("share")).select("lang", "text")


def train(docs, id_col="doc_id", text_col="text", lang_col="lang", fit=Fit()):
    """The model: languages; by kind sorted entries and their log shares (entries x languages)."""
    spark = docs.sparkSession
    counts = X.written(spark, _counted(_sample(docs, id_col, text_col, lang_col, fit)), "language_counts")
    sums = counts.groupBy("kind", "lang").agg(F.sum("n").alias("n")).collect()  # kinds x languages
    langs = sorted({r["lang"] for r in sums})
    model = {"langs": langs, "tables": {}}
    for kind in (0, *ORDERS):
        total = np.array([sum(r["n"] for r in sums if r["kind"] == kind and r["lang"] == v) for v in langs], float)
        limit = fit.grams if kind else fit.words
        top = counts.where(F.col("kind") == kind).groupBy("entry").agg(F.sum("n").alias("all")).orderBy(F.desc("all"), "entry").limit(limit)
        rows = counts.where(F.col("kind") == kind).join(top, "entry").select("entry", "lang", "n").toArrow()  # at most limit x languages
        entries, at = np.unique(rows.column("entry").to_numpy().astype(np.uint64), return_inverse=True)
        shares = np.full((len(entries), len(langs)), -1.0 - np.log10(max(1.0, total.max(initial=1.0))), np.float32)
        lang = pc.index_in(rows.column("lang"), pa.array(langs, pa.string())).to_numpy() if len(rows) else np.zeros(0, np.int64)
        shares[at, lang] = np.log10(rows.column("n").to_numpy() / total[lang])
        model["tables"][kind] = entries, shares
    return model


def score_words(model, members, points, starts, ends):
    """Log shares (words x languages) of words, by the first table that knows them; unknown words score alike."""
    out = np.zeros((len(starts), len(model["langs"])), np.float32)
    at, place = members[0].find(_word_hashes(points, starts, ends))
    out[at] = model["tables"][0][1][place]
    open_ = np.ones(len(starts), bool)
    open_[at] = False
    for n in ORDERS:
        left = np.flatnonzero(open_)
        if not len(left):
            break
        word, h = gram_hashes(points, starts[left], ends[left], n)
        at, place = members[n].find(h)
        word = word[at]
        if not len(word):
            continue
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        size = np.diff(np.append(first, len(word)))
        out[left[word[first]]] = np.add.reduceat(model["tables"][n][1][place], first, axis=0) / size[:, None]
        open_[left[word[first]]] = False
    return out


def predict(docs, model, id_cols=("doc_id",), text_col="text"):
    """Per row: its id columns, lang_pred, score in 0 to 1, n_words, n_unseen (words that fell back)."""
    texts = X.plain_text(docs, id_cols, text_col)
    held, k = docs.sparkSession.sparkContext.broadcast(model), len(id_cols)

    def step(batches):
        m = held.value
        members = {kind: _Members(t[0]) for kind, t in m["tables"].items()}
        for b in batches:
            langs, scores, counts, unseen = [], [], [], []
            for lo, hi, _, _ in X.pieces(b.column(k)):
                points, starts, ends, doc, some = words_of(b.column(k).slice(lo, hi - lo).to_pylist())
                n = np.bincount(doc, minlength=hi - lo)
                counts += n.tolist()
                known = np.zeros(len(starts), np.int64)
                known[members[0].find(_word_hashes(points, starts, ends))[0]] = 1
                unseen += (n - np.bincount(doc, known, hi - lo).astype(np.int64)).tolist()
                if not m["langs"]:
                    langs += [UNKNOWN] * (hi - lo)
                    scores += [0.0] * (hi - lo)
                    continue
                each = score_words(m, members, points, starts, ends)
                mean = np.column_stack([np.bincount(doc, each[:, v], hi - lo) for v in range(len(m["langs"]))]) / np.maximum(n, 1)[:, None]
                best = mean.argmax(axis=1)
                power = np.exp((mean - mean.max(axis=1, keepdims=True)) * np.log(10) * np.minimum(n, EVIDENCE)[:, None])
                share = 1 / power.sum(axis=1)
                langs += [m["langs"][v] if good else UNKNOWN for v, good in zip(best.tolist(), some.tolist())]
                scores += np.where(some, share, 0.0).tolist()
            cols = [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(counts, pa.int64()), pa.array(unseen, pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns[:k], *cols], names=[*b.schema.names[:k], "lang_pred", "score", "n_words", "n_unseen"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema[:-1])
    return texts.mapInArrow(step, f"{schema}, lang_pred string, score double, n_words long, n_unseen long")


def op11_language(spark, sf_dir):
    docs = X.read(spark, sf_dir, "documents")
    held_out = X.hash_bucket(F.col("doc_id"), 3) == 1
    model = train(docs.where(~held_out))
    return predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "n_words", "n_unseen")
