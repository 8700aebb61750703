"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives one Viterbi pass.

At each position the automaton's output links give every piece that ends there; each relaxes the best score of its end from
that of its start.  A character no piece covers costs a fixed penalty and becomes byte pieces.  Blanks are written as the
model's blank sign and a blank is put before the text.  Where no piece has a blank sign behind another character, the best
path always breaks before a run of blanks, so the pass goes over one such unit at a time, and each task keeps the units it
has seen.  The blank sign itself in a text goes to byte pieces, so decoding gives every text back exactly.

The model file is read by the driver and its pieces are broadcast (their number is the vocabulary's size, fixed by the file).
Narrow steps only; memory is bounded by a batch and KEEP units.

Cases: null and empty texts have no ids and decode to the empty text; repeated rows are each encoded; null ids stay; equal
scores go to the longer last piece; an empty table gives no rows; further columns are ignored."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import functions as F

from crewgrid.llm import textops as X

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
TAKEN = "\udc81"  # stands for a blank sign of the text itself; no valid text has it
KEEP = 200_000


def vocabulary(path=MODEL):
    """(piece, score, kind) by id; kind: n normal, b byte, x never produced from text."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(m.id_to_piece(i), m.get_score(i), "b" if m.is_byte(i) else "x" if m.is_control(i) or m.is_unknown(i) or m.is_unused(i) else "n") for i in range(m.get_piece_size())]


class Pieces:
    def __init__(self, vocab):
        import ahocorasick

        self.trie = ahocorasick.Automaton()
        self.raw, self.byte_id, worst, splits = [], {}, 0.0, True
        for i, (piece, score, kind) in enumerate(vocab):
            if kind == "b":
                self.byte_id[int(piece[3:5], 16)] = i
                self.raw.append(bytes([int(piece[3:5], 16)]))
                continue
            self.raw.append(piece.replace(BLANK, " ").encode() if kind == "n" else b"")
            if kind == "n":
                self.trie.add_word(piece, (len(piece), i, score))
                worst = min(worst, score)
                splits &= BLANK not in piece.lstrip(BLANK)
        self.trie.make_automaton()
        self.penalty = worst - 10.0
        self.unit = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+" if splits else r"(?s).+")
        self.seen = {}

    def best(self, unit):
        """Ids of the best path over one unit."""
        n = len(unit)
        score, via = [0.0] + [None] * n, [None] * (n + 1)
        matches = self.trie.iter(unit)
        nxt = next(matches, None)
        for end in range(1, n + 1):
            top, how = score[end - 1] + self.penalty, None
            while nxt is not None and nxt[0] == end - 1:
                size, i, s = nxt[1]
                s += score[end - size]
                if s > top:
                    top, how = s, (size, i)
                nxt = next(matches, None)
            score[end], via[end] = top, how
        out, at = [], n
        while at:
            if via[at]:
                size, i = via[at]
                out.append(i)
                at -= size
            else:
                char = BLANK if unit[at - 1] == TAKEN else " " if unit[at - 1] == BLANK else unit[at - 1]
                out += [self.byte_id[x] for x in reversed(char.encode())]
                at -= 1
        return tuple(reversed(out))

    def units(self, text):
        """(ids, ids as text) of each unit of a text."""
        if not text:
            return []
        seen, out = self.seen, []
        for u in self.unit.findall(BLANK + text.replace(BLANK, TAKEN).replace(" ", BLANK)):
            got = seen.get(u)
            if got is None:
                if len(seen) >= KEEP:
                    seen.clear()
                ids = self.best(u)
                got = ids, ",".join(map(str, ids))
                if len(u) <= 64:
                    seen[u] = got
            out.append(got)
        return out

    def encode(self, text):
        return [i for ids, _ in self.units(text) for i in ids]

    def decode(self, ids):
        return b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")[1:]


def encode(docs, id_cols=("doc_id",), text_col="text", model=MODEL):
    """Per row: its id columns, ids (array<int>), n_pieces, and same: whether the ids decode to the text."""
    texts = X.plain_text(docs, id_cols, text_col)
    held, k = docs.sparkSession.sparkContext.broadcast(vocabulary(model)), len(id_cols)

    def step(batches):
        p = Pieces(held.value)
        for b in batches:
            for lo, hi, _, _ in X.pieces(b.column(k)):
                part = b.slice(lo, hi - lo)
                texts_ = part.column(k).to_pylist()
                ids = [p.encode(t) for t in texts_]
                cols = [pa.array(ids, pa.list_(pa.int32())), pa.array(list(map(len, ids)), pa.int64()), pa.array([p.decode(i) == t for i, t in zip(ids, texts_)], pa.bool_())]
                yield pa.RecordBatch.from_arrays([*part.columns[:k], *cols], names=[*b.schema.names[:k], "ids", "n_pieces", "same"])

    return texts.mapInArrow(step, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema[:-1]) + ", ids array<int>, n_pieces long, same boolean")


def decode(encoded, id_cols=("doc_id",), ids_col="ids", model=MODEL):
    """Per row: its id columns and the text its ids stand for; null ids give the empty text."""
    rows = encoded.select(*id_cols, F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids"))
    held, k = encoded.sparkSession.sparkContext.broadcast(vocabulary(model)), len(id_cols)

    def step(batches):
        p = Pieces(held.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:k], pa.array([p.decode(x) for x in b.column(k).to_pylist()], pa.string())], names=[*b.schema.names[:k], "text"])

    return rows.mapInArrow(step, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1]) + ", text string")


def round_trips(docs, id_cols=("doc_id",), text_col="text", model=MODEL):
    """encode() and decode() in one pass: id columns, n_chars, n_pieces, n_byte_pieces, ids_sha256 (comma-joined ids), text_sha256 of the decoded text, same."""
    texts = X.plain_text(docs, id_cols, text_col)
    held, k = docs.sparkSession.sparkContext.broadcast(vocabulary(model)), len(id_cols)
    names = ["n_chars", "n_pieces", "n_byte_pieces", "ids_sha256", "text_sha256", "same"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_())

    def step(batches):
        p = Pieces(held.value)
        byte_ids = set(p.byte_id.values())
        for b in batches:
            out = []
            for t in b.column(k).to_pylist():
                units = p.units(t)
                ids = [i for x, _ in units for i in x]
                back = p.decode(ids)
                n_bytes = len(ids) - sum(i not in byte_ids for i in ids) if not byte_ids.isdisjoint(ids) else 0
                out.append((len(t), len(ids), n_bytes, X.sha256(",".join(x for _, x in units)), X.sha256(back), back == t))
            cols = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays([*b.columns[:k], *(pa.array(c, t) for c, t in zip(cols, kinds))], names=[*b.schema.names[:k], *names])

    return texts.mapInArrow(step, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema[:-1]) + ", n_chars long, n_pieces long, n_byte_pieces long, ids_sha256 string, text_sha256 string, same boolean")


def op10_sentencepiece(spark, sf_dir):
    return round_trips(X.read(spark, sf_dir, "documents"))
