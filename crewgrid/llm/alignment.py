"""Cross-tokenizer alignment by inverted pair bitmaps.

Two tokenizers cut the same bytes (a blank, then the text).  Offsets where tokens of both end cut them into groups; each
occurrence of an A token is linked to each occurrence of a B token of its group.  For each id pair the documents that hold it
linked are a bitmap: one task numbers the documents of a chunk of about CHUNK text bytes, and writes for each pair of the
chunk a plane 0 (documents with a link) and, where some have several, planes 1, 2, 4 ... of the links beyond the first.  Slots
of a document range that is mostly empty are kept as a sorted list, others as bits.  Chunks cover disjoint documents, so the
OR of a pair's bitmaps over all chunks has the sum of their popcounts, which Spark adds up.  The counts then go back along the
postings: joined to each chunk's bitmaps, they add to the documents whose slots are set.

Texts are encoded unit by unit, cut where both tokenizers always cut (before blanks behind other characters; around a single
line break), so repeated units are encoded once a task.  Memory is bounded by a chunk and KEEP units, of which the most used stay.  The largest count of
each A id (at most the vocabulary's size) is the only thing broadcast; documents, bitmaps and counts stay distributed.

Cases: null and empty texts, and texts whose tokens do not spell them (a blank sign in the text), have no tokens: zeros and
an empty digest; each row is a document of its own, also when rows or ids repeat; null ids stay; a pair linked several times in a
document counts it once; ties of the highest count are all best; an empty table gives no rows; further columns are ignored."""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from crewgrid.llm import textops as X
from crewgrid.session import scratch_folder

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_BPE = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
CHUNK = 8 << 20
SLOTS = 1 << 16
KEEP = 320_000
# A unit starts before blanks that follow another character, and at a single line break between others.
UNIT = re.compile(r"(?:(?<=\S)\n(?=\S)\S*| +\S*|\S+)(?:(?! |(?<=\S)\n\S)\s+\S*)*")
UNIT_WITHOUT_BREAKS = re.compile(r"(?: +\S*|\S+)(?:(?! )\s+\S*)*")
# Texts without this have units of one leading blank or line break, found by splitting alone.
UNEVEN = re.compile(r"\s[ \n]|\n\s")


def _byte_letters():
    """The letter that stands for each byte in a byte-level vocabulary: itself where it prints, else the next free one from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


# Fixed value: the published pre-token pattern of byte-level BPE vocabularies of this kind.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_bpe_encoder(path):
    """(encode, bytes by id) of a byte-level BPE file.  Where the file's merges are in the order of their ids, ranks of byte
    strings say the same and encode faster; any other file is left to its own library."""
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    special = {t["content"] for t in told["added_tokens"]}
    letters = _byte_letters()
    vocab = {t: i for t, i in told["model"]["vocab"].items() if t not in special}
    raw = {i: bytes(letters[c] for c in t) for t, i in vocab.items()} | {t["id"]: t["content"].encode() for t in told["added_tokens"]}
    made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in told["model"]["merges"]]
    plain = told["normalizer"] is None and told["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    if plain and made == sorted(made) and len(made) + 256 == len(vocab) and not told["model"]["ignore_merges"]:
        ranks = tiktoken.Encoding("ranks", pat_str=PRE_TOKEN, mergeable_ranks={raw[i]: i for i in vocab.values()}, special_tokens={})
        one = ranks.encode_ordinary
        return (lambda units: [one(u) for u in units]), [raw.get(i, b"") for i in range(max(raw) + 1)]
    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    return (lambda units: [e.ids for e in own.encode_batch(units, add_special_tokens=False)]), [raw.get(i, b"") for i in range(max(raw) + 1)]


def _flat(lists):
    """(all values, length of each list)."""
    n = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, int(n.sum())), n


class Tokenizers:
    """Both tokenizers, the bytes of each id, and the units seen."""

    def __init__(self, byte_bpe, piece_bpe):
        import sentencepiece

        self.encode_a, self.raw_a = byte_bpe_encoder(byte_bpe)
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_bpe)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.raw_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) or self.b.is_unknown(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)]
        normal = [p for p, raw in zip(pieces, self.raw_b) if raw]
        if any(BLANK in p.lstrip(BLANK) for p in normal):
            raise ValueError("a piece has a blank behind another character: units cannot be cut at blanks")
        self.blank = [self.b.piece_to_id(BLANK)]
        self.breaks = self.b.encode("\n")[:1] == self.blank and not any("\n" in p for p in normal)
        self.unit = UNIT if self.breaks else UNIT_WITHOUT_BREAKS
        self.len_a, self.len_b = (np.array([len(x) for x in raw], np.int64) for raw in (self.raw_a, self.raw_b))
        self.names = np.array([str(i) for i in range(max(len(self.raw_a), len(self.raw_b)))], object)
        self.clear()

    def clear(self):
        """seen: number by unit; units of even texts are kept without their leading blank, those of others in `uneven`."""
        self.seen, self.uneven, self.text, self.held, self.bad = {}, {}, [], 0, set()
        self._parts = [(np.zeros((0, 5), np.int32), np.zeros(0, np.int64))]
        self.uses = np.zeros(0, np.int64)

    def used(self, units):
        self.uses = np.bincount(units, minlength=len(self.text)) + np.pad(self.uses, (0, len(self.text) - len(self.uses)))

    def trim(self):
        """Beyond KEEP units only those used most stay, half as many.  Between chunks only: unit numbers of a chunk stay valid."""
        if len(self.text) <= KEEP and self.held <= 4 * CHUNK:
            return
        self.used(np.zeros(0, np.int64))
        stay = np.argsort(-self.uses, kind="stable")[:KEEP // 2]
        stay = np.sort(stay[self.uses[stay] > 1])
        stats, pairs = self.known()
        first = np.cumsum(stats[:, 4]) - stats[:, 4]
        size = stats[stay, 4]
        at = np.repeat(first[stay] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        self._parts = [(stats[stay], pairs[at])]
        place = dict(zip(stay.tolist(), range(len(stay))))
        self.text = [self.text[i] for i in stay.tolist()]
        self.bad = {place[i] for i in self.bad if i in place}
        self.seen, self.uneven = ({u: place[i] for u, i in seen.items() if i in place} for seen in (self.seen, self.uneven))
        self.held = sum(map(len, self.seen)) + sum(map(len, self.uneven))
        self.uses = np.zeros(len(stay), np.int64)

    def known(self):
        """Of all units seen: (n_a, n_b, n_groups, n_links, linked pairs) rows, and the pairs themselves."""
        self._parts = [tuple(np.concatenate(x) for x in zip(*self._parts))]
        return self._parts[0]

    def ids_b(self, units):
        """B ids of units as they stand within a text; B puts a blank before what it is given."""
        got = self.b.encode([u[1:] if u[0] == " " else u for u in units], num_threads=1)
        return [self.blank if u == " " else ids if u[0] == " " else ids[1:] for u, ids in zip(units, got)]

    def learn(self, units):
        """Encode new units and keep their groups; units whose tokens do not spell them are bad."""
        raw = [u.encode() for u in units]
        ids_a, ids_b = self.encode_a(units), self.ids_b(units)
        spell = [b"".join([table[i] for ids in x for i in ids]) for x, table in ((ids_a, self.raw_a), (ids_b, self.raw_b))]
        if not spell[0] == spell[1] == b"".join(raw):
            for k, (u, a, b) in enumerate(zip(raw, ids_a, ids_b)):
                if not b"".join([self.raw_a[i] for i in a]) == u == b"".join([self.raw_b[i] for i in b]):
                    self.bad.add(len(self.text) + k)
                    ids_a[k], ids_b[k], raw[k] = [], [], b""
        a, n_a = _flat(ids_a)
        b, n_b = _flat(ids_b)
        end_a, end_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        ends = np.intersect1d(end_a, end_b, assume_unique=True)  # of groups
        group_a, group_b = np.searchsorted(ends, end_a), np.searchsorted(ends, end_b)
        in_a, in_b = np.bincount(group_a, minlength=len(ends)), np.bincount(group_b, minlength=len(ends))
        first_b = np.cumsum(in_b) - in_b
        # every A token with every B token of its group
        each = in_b[group_a]
        at_b = np.repeat(first_b[group_a] - np.cumsum(each) + each, each) + np.arange(int(each.sum()))
        pairs = np.repeat(a, each) << 32 | b[at_b]
        # a group as text: its A ids, a bar, its B ids; a token's place is behind the tokens of earlier groups
        shown = np.empty(len(a) + len(b), object)
        last_a, last_b = np.append(group_a[1:] != group_a[:-1], True)[:len(a)], np.append(group_b[1:] != group_b[:-1], True)[:len(b)]
        shown[np.arange(len(a)) + first_b[group_a]] = self.names[a] + np.where(last_a, "|", ",").astype(object)
        place_b = np.arange(len(b)) + np.cumsum(in_a)[group_b]
        shown[place_b] = self.names[b] + np.where(last_b, ";", ",").astype(object)
        unit_end = np.cumsum([len(u) for u in raw])
        group_unit = np.searchsorted(unit_end, ends)  # a unit's end is a group's end
        links = in_a * in_b
        stats = np.column_stack([n_a, n_b, np.bincount(group_unit, minlength=len(units)), *[np.bincount(group_unit, links, len(units))] * 2]).astype(np.int32)  # of one unit
        edge = np.append(0, np.cumsum(n_a + n_b)).tolist()
        shown = shown.tolist()
        self.text += ["".join(shown[lo:hi])[:-1] for lo, hi in zip(edge, edge[1:])]
        self._parts.append((stats, pairs))
        self.held += int(unit_end[-1])

    def numbers(self, texts):
        """Unit numbers of each text (none where it has no tokens)."""
        cut = []
        for t in texts:
            if not t or BLANK in t:
                cut.append((None, []))
            elif not self.breaks or UNEVEN.search(t) or t[0] in " \n" or t[-1] in " \n":
                cut.append((self.uneven, self.unit.findall(" " + t)))
            else:
                cut.append((self.seen, t.replace("\n", " \n").split(" ")))
        for seen in (self.seen, self.uneven):
            new = set().union(*[u for kind, u in cut if kind is seen]) - seen.keys()
            if new:
                new = sorted(new)
                seen.update(zip(new, range(len(self.text), len(self.text) + len(new))))
                self.learn([u if seen is self.uneven or u[:1] == "\n" else " " + u for u in new])
        found = [[kind[u] for u in units] for kind, units in cut]
        return [[] if self.bad and not self.bad.isdisjoint(u) else u for u in found]


@lru_cache(maxsize=1)
def tokenizers(byte_bpe, piece_bpe):
    """Loaded once a Python worker; the units it has seen serve its later tasks."""
    return Tokenizers(byte_bpe, piece_bpe)


class Chunk:
    """Documents numbered by slot, and what they hold linked."""

    def __init__(self):
        self.units, self.bytes, self.rows = [], 0, []

    def add(self, rows, texts, tok, keep_groups):
        for r, units in enumerate(tok.numbers(texts)):
            groups = ";".join(map(tok.text.__getitem__, units))
            self.rows.append((rows.slice(r, 1), hashlib.sha256(groups.encode()).hexdigest() if units else "", groups if keep_groups else None))
            self.units.append(np.array(units, np.int32))
        self.bytes += sum(map(len, texts))

    def counts(self, tok):
        """n_a, n_b, n_groups and n_links by slot."""
        stats, units = tok.known()[0], np.concatenate(self.units)
        tok.used(units)
        edge = np.append(0, np.cumsum([len(u) for u in self.units]))
        out, total = [], np.zeros(len(units) + 1, np.int64)
        for c in range(4):
            np.cumsum(stats[units, c], out=total[1:])
            out.append(total[edge[1:]] - total[edge[:-1]])
        return out

    def planes(self, tok):
        """(pair, plane, documents, slots) arrays and the bits of each plane, by pair."""
        slot = np.repeat(np.arange(len(self.units)), [len(u) for u in self.units])
        n_units = max(1, len(tok.text))
        key, n = np.unique(slot * n_units + np.concatenate(self.units), return_counts=True)
        slot, unit = key // n_units, key % n_units
        stats, pair = tok.known()
        size = stats[:, 4].astype(np.int64)
        first = np.cumsum(size) - size
        each = size[unit]
        at = np.repeat(first[unit] - np.cumsum(each) + each, each) + np.arange(int(each.sum()))
        known, pair = np.unique(pair, return_inverse=True)
        pair, links, slot = pair[at], np.repeat(n, each), np.repeat(slot, each)
        if len(links) and int(links.max()) < 1 << 15:  # one sort of packed values; at most 2^32 pairs
            packed = pair << 31 | slot << 15 | links
            packed.sort()
            pair, slot, links = packed >> 31, packed >> 15 & 0xFFFF, packed & 0x7FFF
        else:
            order = np.lexsort((slot, pair))
            pair, slot, links = pair[order], slot[order], links[order]
        new = np.flatnonzero(np.append(True, (pair[1:] != pair[:-1]) | (slot[1:] != slot[:-1]))) if len(pair) else np.zeros(0, np.int64)
        links = np.add.reduceat(links, new) if len(new) else links
        pair, slot = known[pair[new]], slot[new]
        yield self._plane(pair, slot, 0)
        more, k = links - 1, 1
        while more.any():
            some = (more & 1) == 1
            yield self._plane(pair[some], slot[some], k)
            keep = more > 1
            pair, slot, more, k = pair[keep], slot[keep], more[keep] >> 1, k + 1

    def _plane(self, pair, slot, plane):
        first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else np.zeros(0, np.int64)
        n = np.diff(np.append(first, len(pair)))
        width = (len(self.rows) + 7) // 8
        sparse = np.repeat(2 * n <= width, n)
        size = np.where(2 * n <= width, 2 * n, width)
        offs = np.append(0, np.cumsum(size))
        bits = np.zeros(int(offs[-1]), np.uint8)
        at = (np.repeat(offs[:-1], n) + 2 * (np.arange(len(pair)) - np.repeat(first, n)))[sparse]
        bits[at], bits[at + 1] = slot[sparse] & 255, slot[sparse] >> 8
        at = (np.repeat(offs[:-1], n) + (slot >> 3))[~sparse]
        np.bitwise_or.at(bits, at, (1 << (slot[~sparse] & 7)).astype(np.uint8))
        return pair[first], np.full(len(n), plane), n, offs, bits


def slots_of(n, offs, bits):
    """(row, slot) of every document set in planes of n documents each; the inverse of Chunk._plane."""
    size = np.diff(offs)
    sparse = np.flatnonzero(size == 2 * n)
    row = np.repeat(sparse, n[sparse])
    at = np.repeat(offs[sparse], n[sparse]) + 2 * (np.arange(len(row)) - np.repeat(np.cumsum(n[sparse]) - n[sparse], n[sparse]))
    rows, slots = [row], [bits[at].astype(np.int64) | bits[at + 1].astype(np.int64) << 8]
    for r in np.flatnonzero(size != 2 * n).tolist():
        found = np.flatnonzero(np.unpackbits(bits[offs[r]:offs[r + 1]], bitorder="little"))
        rows.append(np.full(len(found), r))
        slots.append(found)
    return np.concatenate(rows), np.concatenate(slots)


def _binary(offs, bits):
    return pa.Array.from_buffers(pa.binary(), len(offs) - 1, [None, pa.py_buffer(offs.astype(np.int32).tobytes()), pa.py_buffer(bits.tobytes())])


COUNTS = ("n_a", "n_b", "n_groups", "n_links")
LINKED = "pair long, plane int, n long, bits binary"


def postings(docs, id_cols, text_col, byte_bpe, piece_bpe, keep_groups):
    """Rows of two kinds: each document with its chunk and slot, and each chunk's planes (kind 'plane')."""
    texts = X.plain_text(docs, id_cols, text_col)
    k = len(id_cols)
    fields = "chunk long, slot int, " + ", ".join(f"{c} long" for c in COUNTS) + ", groups_sha256 string, groups string, " + LINKED + ", kind string"
    ids = [f"_id{i} {f.dataType.simpleString()}" for i, f in enumerate(texts.schema[:-1])]
    names = [x.split(" ")[0] for x in ids] + [x.split(" ")[0] for x in fields.split(", ")]

    def step(batches):
        tok, chunk, serial = tokenizers(byte_bpe, piece_bpe), Chunk(), 0
        tok.trim()
        schema = None

        def out(cols, n):
            return pa.RecordBatch.from_arrays([cols[f.name].cast(f.type) if f.name in cols else pa.nulls(n, f.type) for f in schema], schema=schema)

        def flush():
            number = (TaskContext.get().partitionId() << 24) + serial
            held = pa.Table.from_batches([r for r, _, _ in chunk.rows]).combine_chunks()
            n = len(chunk.rows)
            cols = {names[i]: held.column(i).combine_chunks() for i in range(k)}
            cols |= {c: pa.array(v) for c, v in zip(COUNTS, chunk.counts(tok))}
            cols |= {"chunk": pa.array([number] * n), "slot": pa.array(range(n)), "groups_sha256": pa.array([s for _, s, _ in chunk.rows]), "groups": pa.array([g for _, _, g in chunk.rows], pa.string()), "kind": pa.array(["doc"] * n)}
            whole = out(cols, n)
            yield from (whole.slice(i, 1000) for i in range(0, n, 1000))
            for pair, plane, docs_, offs, bits in chunk.planes(tok):
                for lo in range(0, len(pair), 50_000):
                    hi = min(len(pair), lo + 50_000)
                    part = _binary(offs[lo:hi + 1] - offs[lo], bits[offs[lo]:offs[hi]])
                    yield out({"chunk": pa.array([number] * (hi - lo)), "pair": pa.array(pair[lo:hi]), "plane": pa.array(plane[lo:hi]), "n": pa.array(docs_[lo:hi]), "bits": part, "kind": pa.array(["plane"] * (hi - lo))}, hi - lo)

        for b in batches:
            if schema is None:
                kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
                schema = pa.schema([pa.field(names[i], b.schema.field(i).type) for i in range(k)] + [pa.field(*(lambda a: (a[0], kinds[a[1]]))(x.split(" "))) for x in fields.split(", ")])
            for lo, hi, _, _ in X.pieces(b.column(k)):
                for lo in range(lo, hi, SLOTS):
                    part = b.slice(lo, min(hi - lo, SLOTS))
                    if chunk.rows and (chunk.bytes + part.column(k).nbytes > CHUNK or len(chunk.rows) + part.num_rows > SLOTS):
                        yield from flush()
                        serial, chunk = serial + 1, Chunk()
                        tok.trim()
                    chunk.add(part.select(range(k)), part.column(k).to_pylist(), tok, keep_groups)
        if chunk.rows:
            yield from flush()

    return texts.mapInArrow(step, ", ".join(ids) + ", " + fields), [x.split(" ")[0] for x in ids]


def _scored(ids):
    """Adds a chunk's counts to its documents along the planes."""

    def step(docs, planes):
        n = planes.column("n").combine_chunks().to_numpy()
        bits = planes.column("bits").combine_chunks()
        raw, offs = X.as_bytes(bits) if len(bits) else (np.zeros(0, np.uint8), np.zeros(1, np.int64))
        row, slot = slots_of(n, offs, raw)
        plane = planes.column("plane").combine_chunks().to_numpy().astype(np.int64)
        weight = (np.int64(1) << np.maximum(plane - 1, 0))[row]
        held, best = planes.column("docs").combine_chunks().to_numpy(), planes.column("best").combine_chunks().to_numpy()
        slots = docs.column("slot").combine_chunks().to_numpy()
        size = int(slots.max()) + 1 if len(slots) else 0
        total, top = np.zeros(size, np.int64), np.zeros(size, np.int64)
        np.add.at(total, slot, held[row] * weight)
        np.add.at(top, slot, weight * (held == best)[row])
        cols = [docs.column(c) for c in ids] + [docs.column(c) for c in COUNTS] + [pa.array(top[slots]), pa.array(total[slots]), docs.column("groups_sha256"), docs.column("groups")]
        return pa.table(cols, names=[*ids, *COUNTS, "n_best", "count_sum", "groups_sha256", "groups"])

    return step


def pair_counts(planes):
    """Per id pair: docs (documents that hold it linked) and links, from the popcounts of its planes."""
    return planes.groupBy("pair").agg(
        F.sum(F.when(F.col("plane") == 0, F.col("n")).otherwise(0)).alias("docs"),
        F.sum(F.col("n") * F.expr("shiftleft(1L, greatest(plane - 1, 0))")).alias("links"),
    )


def align(docs, id_cols=("doc_id",), text_col="text", byte_bpe=BYTE_BPE, piece_bpe=PIECE_BPE, keep_groups=False):
    """(documents, pairs).  documents: id columns, COUNTS, n_best, count_sum, groups_sha256, groups (null unless kept);
    pairs: a, b, docs, links."""
    spark = docs.sparkSession
    rows, ids = postings(docs, id_cols, text_col, byte_bpe, piece_bpe, keep_groups)
    path = f"{scratch_folder(spark)}/postings"
    rows.write.partitionBy("kind").parquet(path)
    found, planes = (spark.read.schema(rows.schema).parquet(path).where(F.col("kind") == kind) for kind in ("doc", "plane"))
    found = found.select("chunk", "slot", *ids, *COUNTS, "groups_sha256", "groups")
    planes = planes.select("chunk", "pair", "plane", "n", "bits")
    pairs = X.written(spark, pair_counts(planes), "pairs")
    top = pairs.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("docs").alias("best"))
    known = pairs.join(F.broadcast(top), F.shiftright("pair", 32) == F.col("a")).select("pair", "docs", "best")  # top: one row an A id
    scored = planes.join(known, "pair").select("chunk", "plane", "n", "bits", "docs", "best")
    names = [*ids, *COUNTS, "n_best", "count_sum", "groups_sha256", "groups"]
    schema = ", ".join([f"{c} {found.schema[c].dataType.simpleString()}" for c in ids] + [f"{c} long" for c in names[len(ids):-2]] + ["groups_sha256 string", "groups string"])
    out = found.groupBy("chunk").cogroup(scored.groupBy("chunk")).applyInArrow(_scored(ids), schema)
    return out.select(*[F.col(c).alias(n) for c, n in zip(ids, id_cols)], *names[len(ids):]), pairs.select(F.shiftright("pair", 32).cast("int").alias("a"), F.expr("cast(pair & 4294967295 as int)").alias("b"), "docs", "links")


def op13_alignment(spark, sf_dir):
    return align(X.read(spark, sf_dir, "documents"))[0].drop("groups")
