"""Language-model scoring by online logistic context mixing.

A text is lower-cased (A-Z) and predicted byte by byte, with one end symbol, as the bits of a prefix code made from the training
texts' byte counts.  Per bit four hashed contexts (two, four and six bytes, and the current word) give a log-odds each.
A gate, the bit's depth in the code, chooses the weights that add them up; a refinement then moves the result towards what was
seen in the same text after like predictions.  Weights and refinement start from the model and are learned on along each text,
chunk by chunk (CHUNKS), from what has already been scored only; so a score depends on the model and the text alone.

Learning: every task counts zeros and ones per context slot over its training texts, and the counts are added up slot block by
slot block; the tables have a fixed number of slots (SLOTS), which bounds the broadcast, while what is gathered grows with the
number of tasks.  Starting weights are fitted over all training texts, against counts without the bit itself: tasks return sums of
one size for each Newton step.

Base score: token counts over all training texts.  Tokens with the highest counts are broadcast, VOCABULARY at most; what a
text has of others is looked up by a join, so nothing broadcast grows with the vocabulary.

Cases: null and empty texts are one end symbol and one end token; without training texts all counts are zero; null ids count as
the empty id; repeated rows are each scored and each learned from; an empty table gives no rows; further columns are ignored."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from crewgrid.llm import textops as X

PIECE = 1 << 18
SLOTS = (1 << 19, 1 << 21, 1 << 21, 1 << 21)
FIRST = np.concatenate([[0], np.cumsum(SLOTS)])
CUT = 4096
REACH = (2, 4, 6)
WORD_REACH = 7
END = 256
END_TOKEN = np.uint64(0x2545F4914F6CDD1D)
VOCABULARY = 3_000_000
CHUNKS = (0, 24, 48, 96, 192, 384, 768, 1536, 3072)
STEP = 4096
SCALE = 16.0
DEPTHS = 12
CELLS = 16
PARTS = (64, 8, 1)
NEAR = 0.02
STEPS = 50
LOG10 = float(np.log(10.0))


@dataclass(frozen=True)
class Model:
    sample: int = 300
    smooth: float = 0.03
    rate: float = 0.6
    trust: float = 40.0


class Code:
    """A prefix code over bytes and END: per symbol its length, and node and bit at each depth."""

    def __init__(self, counts):
        heap = [(int(n) + 1, s, s) for s, n in enumerate(counts)]
        heapq.heapify(heap)
        kids, nxt = {}, len(counts)
        while len(heap) > 1:
            (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
            kids[nxt] = (x, y)
            heapq.heappush(heap, (a + b, nxt, nxt))
            nxt += 1
        paths, todo = {}, [(heap[0][2], ())]
        while todo:
            node, path = todo.pop()
            if node < len(counts):
                paths[node] = path
            else:
                todo += [(kids[node][bit], path + ((node - len(counts), bit),)) for bit in (0, 1)]
        self.size = np.array([len(paths[s]) for s in range(len(counts))])
        self.shortest = int(self.size.min())
        self.node = np.zeros((len(counts), int(self.size.max())), np.uint32, "F")
        self.bit = np.zeros((len(counts), int(self.size.max())), np.uint8, "F")
        for s, path in paths.items():
            for j, (node, bit) in enumerate(path):
                self.node[s, j], self.bit[s, j] = node, bit


def _symbols(data, offs):
    """Symbols of a piece with END after each text, their place in the text, and the text."""
    n = np.diff(offs) + 1
    sym = np.full(int(n.sum()), END, np.uint16)
    doc = np.repeat(np.arange(len(n)), n)
    first = np.cumsum(n) - n
    place = np.arange(len(sym)) - np.repeat(first, n)
    sym[place < np.repeat(n - 1, n)] = X.LOWER[data]
    return sym, place, doc


def _contexts(sym, place):
    """One 32-bit hash per context and symbol, from the bytes before it in its text (REACH and the current word)."""
    before = np.zeros(len(sym), np.uint64)
    before[1:] = sym[:-1]
    last = before.copy()
    for k in (1, 2, 4):
        moved = np.zeros_like(before)
        moved[k:] = before[:-k]
        before = before | (moved << np.uint64(8 * k))
    near = np.minimum(place, 8).astype(np.uint64)
    low = np.append((np.uint64(1) << (np.arange(8, dtype=np.uint64) * np.uint64(8))) - np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF))
    before &= low[near]
    at = np.arange(len(sym))
    space = X.SPACES[last.astype(np.uint8)] | (place == 0)
    since = at - np.maximum.accumulate(np.where(space, at, 0))
    word = (before & low[np.minimum(since, WORD_REACH)]) ^ (np.minimum(since, WORD_REACH + 1).astype(np.uint64) << np.uint64(57))
    out = []
    for k, x in enumerate([before & low[r] for r in REACH] + [word]):
        x = (x + np.uint64(k + 1)) * np.uint64(0x9E3779B97F4A7C15)
        out.append(((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)).astype(np.uint32))
    return out


def _slots(k, context, node):
    return ((context + node * np.uint32(0x9E3779B1)) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - int(np.log2(SLOTS[k])))


def _by_depth(code, sym, group, ctx):
    """Per depth of the code: depth, the symbols that have a bit there, their groups and contexts, node and bit."""
    for j in range(code.node.shape[1]):
        if j >= code.shortest:
            at = np.flatnonzero(code.size[sym] > j)
            if not len(at):
                return
            sym, group, ctx = sym[at], None if group is None else group[at], [c[at] for c in ctx]
        yield j, sym, group, ctx, code.node[:, j].take(sym), code.bit[:, j].take(sym)


def _training_pieces(batch):
    keep = np.asarray(batch.column("held_out").to_numpy(zero_copy_only=False), bool)
    texts = batch.column("text").filter(pa.array(~keep))
    yield from X.pieces(texts, PIECE)


def _token_hashes(data, offs):
    starts, ends = X.spans(X.NON_SPACE[data], offs)
    return X.run_hashes(data, starts, ends, X.LOWER_BYTE), *X.doc_ranges(starts, offs)


def _counted(parts):
    h, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return h, np.bincount(at.ravel(), np.concatenate([p[1] for p in parts]), len(h)).astype(np.int64)


def _tokens_and_bytes(texts):
    """(token, n): counts of token hashes; tokens -1 to -257 of `byte` rows are symbol counts."""
    def step(batches):
        parts, held, symbols = [], 0, np.zeros(257, np.int64)
        for b in batches:
            for _, _, data, offs in _training_pieces(b):
                symbols[:256] += np.bincount(X.LOWER[data], minlength=256)
                symbols[END] += len(offs) - 1
                parts.append(np.unique(_token_hashes(data, offs)[0], return_counts=True))
                held += len(parts[-1][0])
                if held > 2_000_000:
                    parts = [_counted(parts)]
                    held = len(parts[0][0])
                    if held > 1_000_000:
                        yield _token_batch(*parts[0])
                        parts, held = [], 0
        if parts:
            yield _token_batch(*_counted(parts))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(END_TOKEN.astype(np.int64), np.arange(257))), pa.array(np.append(symbols[END], symbols)), pa.array(np.arange(258) > 0)], names=["token", "n", "byte"])

    def _token_batch(h, n):
        return pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), pa.array(n), pa.array(np.zeros(len(h), bool))], names=["token", "n", "byte"])

    return texts.select("held_out", "text").mapInArrow(step, "token long, n long, byte boolean").groupBy("byte", "token").agg(F.sum("n").alias("n")).where("n > 0")


def _bit_counts(texts, code):
    """(cut, zeros, ones): counts per slot, CUT slots a row, summed over all training texts."""
    held = texts.sparkSession.sparkContext.broadcast(code)

    def count(batches):
        code = held.value
        totals = [np.zeros(2 * n, np.uint32) for n in SLOTS]
        waiting = [[] for _ in SLOTS]
        size = 0

        def settle():
            for k, w in enumerate(waiting):
                if w:
                    totals[k] += np.bincount(np.concatenate(w), minlength=2 * SLOTS[k]).astype(np.uint32)
                    w.clear()

        for b in batches:
            for _, _, data, offs in _training_pieces(b):
                sym, place, _ = _symbols(data, offs)
                ctx = _contexts(sym, place)
                for _, s, _, part, node, bit in _by_depth(code, sym, None, ctx):
                    for k in range(len(SLOTS)):
                        waiting[k].append((_slots(k, part[k], node) << np.uint32(1)) | bit)
                    size += len(s)
                if size > 3_000_000:
                    settle()
                    size = 0
        settle()
        for k, t in enumerate(totals):
            cuts, rows = [], []
            for c in range(0, SLOTS[k], CUT):
                part = t[2 * c:2 * (c + CUT)]
                at = np.flatnonzero(part)
                if len(at):
                    cuts.append((FIRST[k] + c) // CUT)
                    rows.append(at.astype(np.uint16).tobytes() + part[at].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(cuts, pa.int64()), pa.array(rows, pa.binary())], names=["cut", "part"])

    def add(batches):
        now, total = None, None
        for b in batches:
            cuts, rows = [], []
            for cut, part in zip(b.column(0).to_pylist(), b.column(1)):
                if cut != now:
                    if now is not None:
                        cuts.append(now)
                        rows.append(total.tobytes())
                    now, total = cut, np.zeros(2 * CUT, np.uint64)
                raw = part.as_py()
                n = len(raw) // 6
                total[np.frombuffer(raw, np.uint16, n)] += np.frombuffer(raw, np.uint32, n, 2 * n)
            yield pa.RecordBatch.from_arrays([pa.array(cuts, pa.int64()), pa.array(rows, pa.binary())], names=["cut", "part"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["cut", "part"])

    parts = texts.select("held_out", "text").mapInArrow(count, "cut long, part binary")
    rows = parts.repartition("cut").sortWithinPartitions("cut").mapInArrow(add, "cut long, part binary").toLocalIterator()  # FIRST[-1] slots in all
    counts = np.zeros(2 * int(FIRST[-1]), np.float32)
    for r in rows:
        counts[2 * CUT * r["cut"]:2 * CUT * (r["cut"] + 1)] = np.frombuffer(r["part"], np.uint64)
    return counts[0::2], counts[1::2]


def _curvature(code, judged, weights, moving, data, offs, total):
    """Adds a piece's log probability, slope and curvature per moving depth to `total`, each bit judged without its own count."""
    sym, place, _ = _symbols(data, offs)
    ctx = _contexts(sym, place)
    for j, part, _, near, node, bit in _by_depth(code, sym, None, ctx):
        d = min(j, DEPTHS - 1)
        if not moving[d]:
            continue
        x = np.empty((len(SLOTS), len(part)))
        for k in range(len(SLOTS)):
            at = _slots(k, near[k], node)
            at += np.uint32(FIRST[k])
            at <<= np.uint32(1)
            at |= bit
            x[k] = judged.take(at)
        z = weights[d] @ x
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30, out=z), out=z))
        total[d, 0, 0] += np.log(np.where(bit, p, 1 - p)).sum()
        total[d, 1] += x @ (bit - p)
        total[d, 2:] += (x * (p * (1 - p))) @ x.T


def _newton_sums(texts, held, weights, moving):
    """Log probability (first value), slope and curvature (rows) per moving depth, summed over the training texts in tasks."""
    k = len(SLOTS)

    def step(batches):
        code, judged = held.value
        total = np.zeros((DEPTHS, k + 2, k))
        for b in batches:
            for _, _, data, offs in _training_pieces(b):
                _curvature(code, judged, weights, moving, data, offs, total)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["at", "v"])

    total = np.zeros(DEPTHS * (k + 2) * k)
    for r in texts.select("held_out", "text").mapInArrow(step, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():  # total.size rows
        total[r["at"]] = r["v"]
    return total.reshape(DEPTHS, k + 2, k)


def _fitted(texts, held, weights):
    """Weights by Newton steps until no weight of a depth moves by NEAR; a step that makes the texts less probable is halved."""
    weights, move, best, moving = weights.copy(), np.zeros_like(weights), np.full(DEPTHS, -np.inf), np.ones(DEPTHS, bool)
    for _ in range(STEPS):
        total = _newton_sums(texts, held, weights + move, moving)
        for d in np.flatnonzero(moving):
            w, (value, *_), slope, curve = weights[d] + move[d], total[d, 0], total[d, 1], total[d, 2:]
            value -= ((w - 0.3) ** 2).sum() / 2
            better = value >= best[d]
            if better:
                weights[d], best[d], move[d] = w, value, np.linalg.solve(curve + np.eye(len(w)), slope - (w - 0.3))
            else:
                move[d] /= 2
            if np.abs(move[d]).max() < NEAR:
                moving[d] = False
                weights[d] += move[d] if better else 0
        if not moving.any():
            break
    return weights


def _start_weights(texts, code, zeros, ones, model, n):
    """Weights per depth fitted by Newton steps over all n training texts, each bit judged without its own count.

    The first steps run over parts of the texts, by hash, of `Model.sample` texts at least: that only saves steps over the whole.
    The last ones run over all texts until no weight moves by NEAR, which leaves an error of about its square; weights are
    rounded, so that the order of the sums does not show."""
    judged = np.empty((len(zeros), 2), np.float32)  # log-odds of a slot as a zero and as a one of it sees them
    judged[:, 0] = np.log((ones + model.smooth) / (np.maximum(zeros - 1, 0) + model.smooth))
    judged[:, 1] = np.log((np.maximum(ones - 1, 0) + model.smooth) / (zeros + model.smooth))
    held = texts.sparkSession.sparkContext.broadcast((code, judged.ravel()))
    weights = np.full((DEPTHS, len(SLOTS)), 0.3)
    for part in PARTS:
        if part == 1 or n >= part * model.sample:
            weights = _fitted(texts.where(~F.col("held_out") & (F.pmod(F.xxhash64("text"), F.lit(part)) == 0)), held, weights)
    held.unpersist()
    return np.round(weights, 6).astype(np.float32)


class Scorer:
    def __init__(self, code, tables, weights, model):
        self.code, self.tables, self.weights, self.model = code, tables, weights, model

    def fresh(self, n):
        """State of n texts: weights, learned bits, refinement counts, log probability."""
        k = len(SLOTS)
        return {"w": np.repeat(self.weights[:, :, None], n, 2).copy(), "g": np.full((DEPTHS, k, n), 25.0, np.float32), "n": np.zeros((DEPTHS, n * CELLS), np.float32), "s": np.zeros((DEPTHS, n * CELLS), np.float32), "log": np.zeros(n)}

    def run(self, state, sym, place, doc, ctx):
        """Scores symbols in the order of their chunks; state goes on from earlier symbols of the same texts."""
        chunk = np.where(place < CHUNKS[-1], np.searchsorted(CHUNKS, place, "right") - 1, len(CHUNKS) - 1 + (place - CHUNKS[-1]) // STEP)
        order = np.argsort(chunk.astype(np.uint32), kind="stable")
        sym, doc, chunk, ctx = sym[order], doc[order], chunk[order], [c[order] for c in ctx]
        new = np.flatnonzero(np.append(True, (chunk[1:] != chunk[:-1]) | (doc[1:] != doc[:-1])))
        group = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(sym))))
        group_doc, group_chunk = doc[new], chunk[new]
        for j, s, group, ctx, node, y in _by_depth(self.code, sym, group, ctx):
            x = np.empty((len(SLOTS), len(s)), np.float32)
            for k, table in enumerate(self.tables):
                x[k] = table.take(_slots(k, ctx[k], node))
            x *= np.float32(1 / SCALE)
            count = np.bincount(group, minlength=len(new))
            some = np.flatnonzero(count)
            count, docs, chunks = count[some], group_doc[some], group_chunk[some]
            edge = np.concatenate([[0], np.cumsum(count)])
            step = np.append(np.flatnonzero(np.append(True, chunks[1:] != chunks[:-1])), len(some))
            d = min(j, DEPTHS - 1)
            for a, z in zip(step[:-1].tolist(), step[1:].tolist()):
                self._learn(state, d, x[:, edge[a]:edge[z]], y[edge[a]:edge[z]], docs[a:z], count[a:z], edge[a:z] - edge[a])

    def _learn(self, state, d, x, y, docs, count, starts):
        """One chunk of one gate for all texts that have it: predict with what is known, then learn from the outcome."""
        w = state["w"][d][:, docs]
        z = np.einsum("kn,kn->n", np.repeat(w, count, 1), x)
        np.clip(z, -12, 12, out=z)
        p = 1 / (1 + np.exp(-z))
        cell = ((z + np.float32(12)) * np.float32(CELLS / 24.001)).astype(np.int64) + np.repeat(docs * CELLS, count)
        seen, hits = state["n"][d].take(cell), state["s"][d].take(cell)
        trust = np.float32(self.model.trust)
        final = 0.5 * p + 0.5 * (hits + trust * p) / (seen + trust)
        right = np.where(y, final, 1 - final)
        state["log"][docs] += np.add.reduceat(np.log(np.maximum(right, np.float32(1e-7))), starts, dtype=np.float64)
        err = y - p
        g = np.add.reduceat(err * x, starts, 1)
        state["g"][d][:, docs] += g * g
        state["w"][d][:, docs] = w + np.float32(self.model.rate) * g / (np.sqrt(state["g"][d][:, docs]) + count)
        n = len(state["n"][d])
        state["n"][d] += np.bincount(cell, minlength=n).astype(np.float32)
        state["s"][d] += np.bincount(cell, y, n).astype(np.float32)

    def log_probabilities(self, data, offs):
        """Natural log probability of each text of a piece."""
        state = self.fresh(len(offs) - 1)
        sym, place, doc = _symbols(data, offs)
        for at in range(0, len(sym), 4 * PIECE):  # one long text goes through in parts
            lo = max(0, at - 8 - WORD_REACH)
            part = slice(at, min(len(sym), at + 4 * PIECE))
            ctx = [c[at - lo:] for c in _contexts(sym[lo:part.stop], place[lo:part.stop])]
            self.run(state, sym[part], place[part], doc[part], ctx)
        return state["log"]


def language_model(docs, id_col="doc_id", text_col="text", held_out=None, model=Model()):
    """Everything learned from the rows that are not held out: code, tables, weights and token counts."""
    spark = docs.sparkSession
    texts = docs.select(held_out.alias("held_out"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    counts = X.written(spark, _tokens_and_bytes(texts), "tokens")
    symbols = np.zeros(257, np.int64)
    for r in counts.where("byte").collect():  # 257 rows
        symbols[r["token"]] = r["n"]
    code = Code(symbols)
    zeros, ones = _bit_counts(texts, code)
    weights = _start_weights(texts, code, zeros, ones, model, int(symbols[END]))
    odds = np.log((ones + model.smooth) / (zeros + model.smooth))
    tables = [np.clip(np.round(odds[FIRST[k]:FIRST[k + 1]] * SCALE), -127, 127).astype(np.int8) for k in range(len(SLOTS))]
    tokens = counts.where("NOT byte")
    size = tokens.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    steps = tokens.groupBy(F.expr("floor(log2(n))").alias("e")).agg(F.count("*").alias("v")).orderBy(F.col("e").desc()).collect()  # 64 rows at most
    total, least = 0, None
    for r in steps:
        total += r["v"]
        if total > VOCABULARY:
            break
        least = 1 << int(r["e"])
    known = tokens.where(F.col("n") >= least).select("token", "n").toArrow() if least else pa.table({"token": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
    h = known["token"].to_numpy().astype(np.uint64)
    order = np.argsort(h)
    return {"code": code, "tables": tables, "weights": weights, "model": model, "known": h[order], "counts": known["n"].to_numpy()[order], "complete": total == (size["v"] or 0), "tokens": tokens, "n": size["n"] or 0, "v": size["v"] or 0}


def score(docs, lm, id_cols=("doc_id",), text_col="text"):
    """Per row: its id columns, n_bytes, n_tokens, n_known, base_score, score."""
    spark, k = docs.sparkSession, len(id_cols)
    texts = X.plain_text(docs, id_cols, text_col)
    held = spark.sparkContext.broadcast({x: lm[x] for x in ("code", "tables", "weights", "model", "known", "counts", "n", "v")})
    names = ["n_bytes", "n_tokens", "n_known", "base", "score", "others"]

    def step(batches):
        m = held.value
        scorer = Scorer(m["code"], m["tables"], m["weights"], m["model"])
        log_c = np.log10(m["counts"] + 0.5)
        unit = np.log10(m["n"] + 0.5 * (m["v"] + 1))
        for b in batches:
            for lo, hi, data, offs in X.pieces(b.column(k), PIECE):
                h, a, z = _token_hashes(data, offs)
                place = np.searchsorted(m["known"], h)
                place[place == len(m["known"])] = 0
                good = m["known"][place] == h if len(m["known"]) else np.zeros(len(h), bool)
                end = np.searchsorted(m["known"], END_TOKEN)
                has_end = end < len(m["known"]) and m["known"][end] == END_TOKEN
                value = np.zeros(len(h) + 1)
                np.cumsum(np.where(good, log_c[place] if len(log_c) else 0.0, np.log10(0.5)), out=value[1:])
                base = value[z] - value[a] + (log_c[end] if has_end else np.log10(0.5)) - unit * (z - a + 1)
                logs = scorer.log_probabilities(data, offs)
                rest = np.flatnonzero(~good)
                edge = np.searchsorted(rest, a), np.searchsorted(rest, z)
                others = [h[rest[s:e]].astype(np.int64) for s, e in zip(*edge)]
                cols = [pa.array(np.diff(offs)), pa.array(z - a + 1), pa.array(X.range_sums(good, a, z) + int(has_end)), pa.array(base), pa.array(logs / LOG10), pa.array(others, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*(b.column(i).slice(lo, hi - lo) for i in range(k)), *cols], names=[*b.schema.names[:k], *names])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema[:-1])
    out = texts.mapInArrow(step, f"{schema}, n_bytes long, n_tokens long, n_known long, base double, score double, others array<long>")
    if not lm["complete"]:
        out = _with_rare(spark, out, lm, id_cols)
    return out.select(*id_cols, "n_bytes", "n_tokens", "n_known", F.col("base").alias("base_score"), "score")


def _with_rare(spark, out, lm, id_cols):
    """Adds what tokens outside the broadcast vocabulary contribute: joined by token, summed per row."""
    rows = X.written(spark, out.withColumn("row", F.xxhash64(F.struct(*id_cols, "n_bytes", "score", "others"))), "scored")
    rare = rows.dropDuplicates(["row"]).select("row", F.explode("others").alias("token")).groupBy("row", "token").agg(F.count("*").alias("times")).join(lm["tokens"], "token")
    more = rare.groupBy("row").agg(F.sum("times").alias("known"), F.sum(F.col("times") * (F.log10(F.col("n") + 0.5) - F.log10(F.lit(0.5)))).alias("more"))
    both = rows.join(more, "row", "left")
    return both.withColumn("n_known", F.col("n_known") + F.coalesce("known", F.lit(0))).withColumn("base", F.col("base") + F.coalesce("more", F.lit(0.0)))


def op1_scoring(spark, sf_dir):
    docs = X.read(spark, sf_dir, "documents")
    held_out = X.hash_bucket(F.col("doc_id"), 5) == 1
    lm = language_model(docs, held_out=held_out)
    bits = -F.col("score") * float(np.log2(10.0)) / F.greatest("n_bytes", F.lit(1))
    return score(docs, lm).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(lm["n"]).cast("long").alias("train_tokens"), "base_score", "score", bits.alias("bits_per_byte"))
