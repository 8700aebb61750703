"""Removal of byte strings of LENGTH that occur twice or more, by blockwise suffix sorting with a difference cover.

Every string of LENGTH bytes has an anchor: the place of the least hash of SEED bytes among the WIDTH places from MARGIN on.  It
depends on the string alone, so equal strings have equal anchors at equal distances, and the strings of one anchor in a text
are neighbours (a run).  Runs are grouped by the bytes all strings of their anchor share; these groups are the suffix buckets.

1. A bucket with one run holds no repeated string.  Runs whose whole stretch of bytes occurs again are repeated throughout.
2. Of the other buckets, one run for each different stretch is sorted.  Buckets are sorted block by block, BLOCK bytes at a
   time: the suffixes at the difference-cover places of the block are ranked first, by doubling; then a suffix compares by
   its first bytes, by the rank at its next cover place, and by its last bytes.  Memory is that of a block.
3. A bucket of more than CROWD stretches is first cut finer: its runs are divided into runs of fewer places, whose strings
   share more bytes and so fall into smaller buckets; at one place per run equal bucket means equal string.

Texts are compared by bytes, matches never cross texts.  Texts move only where a bit table of fixed size says that they have a
repeated string; others are reported by a narrow step.

Cases: null and empty texts have no bytes; texts shorter than LENGTH lose none; a repeated row is a second place of all its
strings; null ids stay; an empty table gives no rows; further columns are ignored."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from crewgrid.llm import textops as X

LENGTH, MARGIN, WIDTH, SEED = 400, 100, 200, 16
FINER = 25
CROWD = 5_000
BLOCK = 1 << 20
TIED = 1 << 16
ROWS = 256
SEGMENT = 1 << 19
PERIOD = 32
INVERSE = np.uint64(pow(int(X.BASE), -1, 1 << 64))


class Substrings:
    """64-bit hashes of any substrings of a text."""

    def __init__(self, data):
        n = len(data)
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(X.BYTE[data] * X.powers(n), out=self.total[1:])
        self.undo = np.full(n + 1, INVERSE, np.uint64)
        self.undo[0] = 1
        np.multiply.accumulate(self.undo, out=self.undo)

    def __call__(self, start, end):
        return X.mix((self.total[end] - self.total[start]) * self.undo[start] + (end - start).astype(np.uint64) * X.BASE)


def _least_places(data):
    """For each place the place of the least SEED hash among WIDTH from there on, the first of equals."""
    h = X.BYTE[data]
    step, power = 1, X.BASE
    while step < SEED:
        h = h[:-step] * power + h[step:]
        step, power = step * 2, power * power
    h = (X.mix(h) >> np.uint64(28) << np.uint64(28)) | np.arange(len(h), dtype=np.uint64)
    step = 1
    while step * 2 <= WIDTH:
        h = np.minimum(h[:-step], h[step:])
        step *= 2
    if step < WIDTH:
        h = np.minimum(h[:len(h) - (WIDTH - step)], h[WIDTH - step:])
    return (h & np.uint64((1 << 28) - 1)).astype(np.int64)


def anchored_runs(data, offs):
    """Runs of a piece: document, first and last string start in it, anchor, bucket hash, stretch hash."""
    lens = np.diff(offs)
    docs = np.flatnonzero(lens >= LENGTH)
    if not len(docs):
        return [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)] * 2
    count = lens[docs] - LENGTH + 1
    doc = np.repeat(docs, count)
    start = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(offs[docs], count)
    anchor = _least_places(data)[start + MARGIN]
    first = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])))
    last = np.append(first[1:], len(start)) - 1
    part = Substrings(data)
    a = anchor[first]
    bucket = part(a - MARGIN, a - MARGIN - WIDTH + 1 + LENGTH)
    stretch = part(start[first], start[last] + LENGTH)
    base = offs[doc[first]]
    return doc[first], start[first] - base, start[last] - base, a - base, bucket, stretch


def _segments(data, offs):
    """(first document, place of the segment in it, bytes, offsets): long documents in overlapping segments."""
    if len(offs) == 2 and offs[1] > 2 * SEGMENT:
        for at in range(0, int(offs[1]) - LENGTH + 1, SEGMENT):
            part = data[at:min(at + SEGMENT + LENGTH - 1, int(offs[1]))]
            yield at, part, np.array([0, len(part)])
    else:
        yield 0, data, offs


RUN = "bucket long, stretch long, rid long, s0 long, s1 long, anchor long"


def _run_batch(bucket, stretch, rid, s0, s1, anchor):
    cols = [np.asarray(x).astype(np.int64) if np.asarray(x).dtype != np.uint64 else np.asarray(x).view(np.int64) for x in (bucket, stretch, rid, s0, s1, anchor)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["bucket", "stretch", "rid", "s0", "s1", "anchor"])


def _runs(texts):
    def step(batches):
        for b in batches:
            rid = b.column(0).to_numpy()
            for lo, hi, data, offs in X.pieces(b.column(1), SEGMENT):
                for at, part, edges in _segments(data, offs):
                    doc, s0, s1, anchor, bucket, stretch = anchored_runs(part, edges)
                    yield _run_batch(bucket, stretch, rid[lo:hi][doc], s0 + at, s1 + at, anchor + at)

    return texts.select("rid", "text").mapInArrow(step, RUN)


def _words_of(ids):
    """A bit table of row ids, at most 2^18 words of 64 bits."""
    return ids.selectExpr("shiftright(pmod(rid, 16777216L), 6) AS word", "shiftleft(1L, cast(pmod(rid, 64L) AS int)) AS mask").groupBy("word").agg(F.expr("bit_or(mask)").alias("mask"))


def _marked(texts, ids):
    """texts with near: false only where the row id is surely not among ids."""
    joined = texts.join(F.broadcast(_words_of(ids)), F.expr("shiftright(pmod(rid, 16777216L), 6) = word"), "left")
    return joined.withColumn("near", F.expr("coalesce((shiftright(mask, cast(pmod(rid, 64L) AS int)) & 1L) = 1, false)")).drop("word", "mask")


def _with_texts(texts, runs):
    """Each run with its stretch of bytes (from s0 to s1 + LENGTH): each text meets its own runs only."""
    mine = runs.groupBy("rid").agg(F.collect_list(F.struct("bucket", "stretch", "s0", "s1", "anchor", "single")).alias("runs"))
    one = _marked(texts, mine).where("near").groupBy("rid").agg(F.first("text").alias("text"))  # rows of one id and text are equal

    def step(batches):
        for b in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):  # runs have several times the bytes of their texts
            rids, texts_, lists = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()
            out = []
            for rid, text, mine in zip(rids, texts_, lists):
                raw = text.encode()
                out += [(r["bucket"], r["stretch"], rid, r["s0"], r["s1"], r["anchor"], r["single"], raw[r["s0"]:r["s1"] + LENGTH]) for r in mine]
            cols = list(zip(*out)) or [()] * 8
            kinds = [pa.int64()] * 6 + [pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[*"bucket stretch rid s0 s1 anchor single bytes".split()])

    return one.join(mine, "rid").select("rid", "text", "runs").mapInArrow(step, RUN + ", single boolean, bytes binary")


def difference_cover(period=PERIOD):
    """Residues such that any two residues have a common shift into the set, chosen greedily."""
    cover, have = [0], {0}
    while len(have) < period:
        best = max((x for x in range(period) if x not in cover), key=lambda x: (len({(x - c) % period for c in cover} | {(c - x) % period for c in cover} - have), -x))
        cover.append(best)
        have |= {(a - b) % period for a in cover for b in cover}
    return sorted(cover)


def _ranked(rows):
    """Dense ranks of fixed-width byte rows."""
    flat = np.ascontiguousarray(rows)
    return np.unique(flat.view(np.dtype((np.void, flat.shape[1] * flat.itemsize))).ravel(), return_inverse=True)[1].ravel().astype(np.int64)


def _pairs_ranked(a, b):
    return np.unique(a * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1].ravel().astype(np.int64)


def _whole_groups(key):
    """Slices of a sorted key, each of whole groups of equals and, unless one group has more, about TIED rows."""
    edge = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key)) if len(key) else np.zeros(1, np.int64)
    at = 0
    while at < len(key):
        stop = int(edge[max(np.searchsorted(edge, at + TIED, "right") - 1, np.searchsorted(edge, at, "right"))])
        yield slice(at, stop)
        at = stop


def sort_block(buckets, stretches, anchors):
    """Suffix-sorts one block.  buckets: bucket number of each stretch; anchors: place of its anchor in it.
    Returns, per stretch, a mask over its string starts: True where another stretch has the same string."""
    cover = difference_cover()
    lens = np.array([len(s) for s in stretches], np.int64)
    lead = (-anchors) % PERIOD  # anchors stand at multiples of the period, so equal strings have equal residues
    room = -(-(lead + lens) // PERIOD) * PERIOD + 2 * PERIOD * 8
    base = np.cumsum(room) - room
    buf = np.zeros(int(room.sum()) + LENGTH, np.uint8)
    for s, at in zip(stretches, (base + lead).tolist()):
        buf[at:at + len(s)] = np.frombuffer(s, np.uint8)
    # ranks of PERIOD, 2, 4 and 8 PERIOD bytes at the cover places of the block
    n = len(buf) // PERIOD * PERIOD - PERIOD
    place = (np.arange(0, n, PERIOD)[:, None] + np.array(cover)[None, :]).ravel()
    windows = np.lib.stride_tricks.sliding_window_view(buf, PERIOD)
    rank = _ranked(windows[place])
    by_size = {1: rank}
    for k in (1, 2, 4):
        ahead = np.concatenate([by_size[k][k * len(cover):], np.zeros(k * len(cover), np.int64)])
        by_size[2 * k] = _pairs_ranked(by_size[k], ahead)
    # the suffixes: every string start of every stretch
    count = np.maximum(lens - LENGTH + 1, 0)
    who = np.repeat(np.arange(len(lens)), count)
    offset = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    start = offset + (base + lead)[who]
    shift = np.array([next(k for k in range(len(cover) + 1) if k == len(cover) or cover[k] >= r) for r in range(PERIOD)])
    row, residue = start // PERIOD, start % PERIOD
    slot = row * len(cover) + shift[residue]  # the next cover place, the first of the next period after the last
    # suffix bucket (bucket, distance to the anchor), then rank at the cover place: 8 PERIOD bytes and the 2 PERIOD after them
    group = _pairs_ranked(np.asarray(buckets)[who], offset - anchors[who] + 4 * LENGTH)
    key = _pairs_ranked(_pairs_ranked(group, by_size[8][slot]), by_size[2][slot + 8 * len(cover)])
    tied = np.flatnonzero(np.bincount(key)[key] > 1)
    # what the ranks leave open of tied suffixes: the bytes before the cover place, and the last ones
    head, tail = PERIOD, LENGTH - 10 * PERIOD
    wide = np.lib.stride_tricks.sliding_window_view(buf, head)
    end = np.lib.stride_tricks.sliding_window_view(buf, tail + PERIOD)
    out = np.zeros(len(who), bool)
    tied = tied[np.argsort(key[tied], kind="stable")]
    for part in _whole_groups(key[tied]):
        at = tied[part]
        k = _pairs_ranked(key[at], _ranked(wide[start[at]]))
        k = _pairs_ranked(k, _ranked(end[start[at] + LENGTH - tail - PERIOD]))
        out[at] = np.bincount(k)[k] > 1
    return np.split(out, np.cumsum(count)[:-1])


def _sorted_repeats(runs):
    """(rid, s0, s1) of repeated string starts of the runs that are single, bucket by bucket."""
    def step(batches):
        held = []

        def flush():
            number = {x: i for i, x in enumerate(dict.fromkeys(r[0] for r in held))}
            masks = sort_block([number[r[0]] for r in held], [r[7] for r in held], np.array([r[5] - r[3] for r in held], np.int64))
            out = []
            for r, mask in zip(held, masks):
                if r[6] and mask.any():
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
                    out += [(r[2], r[3] + int(a), r[3] + int(z) - 1) for a, z in zip(edge[0::2], edge[1::2])]
            cols = list(zip(*out)) or [()] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["rid", "s0", "s1"])

        size = 0
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns)):
                if size >= BLOCK and held[-1][0] != r[0]:  # a block is whole buckets; a bucket has CROWD stretches at most
                    yield flush()
                    held, size = [], 0
                held.append(r)
                size += len(r[7])
        if held:
            yield flush()

    return runs.repartition("bucket").sortWithinPartitions("bucket", "stretch").mapInArrow(step, "rid long, s0 long, s1 long")


def _divided(runs, width):
    """Runs (with bytes) cut into runs of at most width string starts, with buckets and stretches of their own."""
    def step(batches):
        for b in batches:
            out = []
            for bucket, _, rid, s0, s1, anchor, single, raw in zip(*(c.to_pylist() for c in b.columns)):
                part = Substrings(np.frombuffer(raw, np.uint8))
                low = anchor - MARGIN - WIDTH + 1  # the first possible start of this anchor's strings
                for k in range((s0 - low) // width, (s1 - low) // width + 1):
                    a, z = max(s0, low + k * width), min(s1, low + k * width + width - 1)
                    ends = np.array([low + k * width + width - 1, low + k * width + LENGTH]) - s0
                    inner = part(np.array([min(max(ends[0], 0), len(raw))]), np.array([min(ends[1], len(raw))]))[0]
                    shared = X.mix(np.array([np.uint64(bucket & 0xFFFFFFFFFFFFFFFF) ^ inner ^ np.uint64((k + 1) * 0x9E3779B1)]))[0]
                    out.append((shared, part(np.array([a - s0]), np.array([z - s0 + LENGTH]))[0], rid, a, z, anchor, single))
            cols = list(zip(*out)) or [()] * 7
            head = _run_batch(np.array(cols[0], np.uint64), np.array(cols[1], np.uint64), *(np.array(c, np.int64) for c in cols[2:6]))
            yield pa.RecordBatch.from_arrays([*head.columns, pa.array(cols[6], pa.bool_())], names=[*head.schema.names, "single"])

    return runs.mapInArrow(step, RUN + ", single boolean")


def repeated_starts(spark, texts):
    """(rid, s0, s1): string starts s0 to s1 of row rid occur elsewhere."""
    runs = X.written(spark, _runs(texts).withColumn("single", F.lit(True)), "runs")
    found = None
    for width in (WIDTH, FINER, 1):
        buckets = runs.groupBy("bucket").agg(F.count("*").alias("n"), F.min("stretch").alias("low"), F.max("stretch").alias("high")).where("n > 1")
        shared = X.written(spark, runs.join(buckets, "bucket"), "shared")
        stretches = shared.groupBy("bucket", "stretch").agg(F.count("*").alias("times"), F.max(F.struct("rid", "s0", "s1", "anchor")).alias("one"), F.max("single").alias("single"), F.first("low").alias("low"), F.first("high").alias("high"))
        again = stretches.where("times > 1").select("bucket", "stretch")
        whole = shared.where("single").join(again, ["bucket", "stretch"]).select("rid", "s0", "s1")
        found = whole if found is None else found.union(whole)
        if width == 1:
            break
        open_ = X.written(spark, stretches.where("low <> high").select("bucket", "stretch", "one.*", (F.col("single") & (F.col("times") == 1)).alias("single")), "open")
        crowded = open_.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > CROWD).select("bucket")
        crowds = crowded.count()
        calm = open_ if not crowds else open_.join(crowded, "bucket", "left_anti")
        found = found.union(_sorted_repeats(_with_texts(texts, calm)))
        if not crowds:
            break
        found = X.written(spark, found, "found")
        runs = X.written(spark, _divided(_with_texts(texts, open_.join(crowded, "bucket", "left_semi")), FINER if width == WIDTH else 1), "runs")
    return X.written(spark, found, "found")


def deduplicate(docs, id_cols=("doc_id",), text_col="text"):
    """Per row: its id columns, text, and cut: the removed byte runs as flat starts and ends."""
    spark = docs.sparkSession
    texts = X.plain_text(docs, id_cols, text_col)
    texts = texts.withColumn("rid", F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in id_cols], F.col("text")))
    found = repeated_starts(spark, texts)
    lists = found.groupBy("rid").agg(F.sort_array(F.collect_set(F.struct("s0", "s1"))).alias("starts"))  # a text's own runs
    marked = _marked(texts, lists)
    near = marked.where("near").join(lists, "rid", "left").select(*id_cols, "text", "starts")
    far = marked.where("NOT near").select(*id_cols, "text", F.lit(None).cast(near.schema["starts"].dataType).alias("starts"))
    merged = F.aggregate(
        F.coalesce("starts", F.array().cast(near.schema["starts"].dataType)), F.array().cast("array<long>"),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1) >= x["s0"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.greatest(F.element_at(acc, -1), x["s1"] + LENGTH)))).otherwise(F.concat(acc, F.array(x["s0"], x["s1"] + LENGTH))),
    )
    return near.withColumn("cut", merged).unionByName(far.withColumn("cut", F.array().cast("array<long>"))).select(*id_cols, "text", "cut")


def kept_bytes(text, cut):
    raw = text.encode()
    at, out = 0, []
    for s, e in zip(cut[0::2], cut[1::2]):
        out.append(raw[at:s])
        at = e
    out.append(raw[at:])
    return b"".join(out)


def op5_suffix_dedup(spark, sf_dir):
    rows = deduplicate(X.read(spark, sf_dir, "documents"))

    def digest(batches):
        for b in batches:
            out = []
            for text, cut in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                n = len(text.encode())
                kept = kept_bytes(text, cut)
                out.append((n, n - len(kept), len(cut) // 2, hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*out)) or [()] * 4
            kinds = [pa.int64()] * 3 + [pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.mapInArrow(digest, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
