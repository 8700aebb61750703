"""Vectorised reading of Arrow text batches, shared by the operators of this folder.

Texts are handled as UTF-8 bytes.  A batch is walked in pieces of whole documents of about
PIECE bytes, so that working arrays stay small; one longer document is a piece of its own."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from crewgrid.session import scratch_folder

PIECE = 1 << 19
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
NON_SPACE = ~SPACES
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def plain_text(df, id_cols, text_col="text"):
    """Only the named columns, the text last with null read as empty; further columns cannot clash."""
    return df.select(*[F.col(c) for c in id_cols], F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def as_bytes(col):
    """(bytes, offsets) of an Arrow string column; null counts as empty."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if col.null_count:
        col = col.fill_null("")
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    bufs = col.buffers()
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(bufs[1], kind, len(col) + 1 + col.offset)[col.offset:].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    return data[offs[0]:offs[-1]], offs - offs[0]


def pieces(col, size=PIECE):
    """(first row, last row + 1, bytes, offsets) of consecutive whole documents."""
    data, offs = as_bytes(col)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + size, "right")) - 1)
        yield lo, hi, data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]
        lo = hi


def spans(inside, offs):
    """Starts and ends of the runs where `inside` holds; no run crosses a document edge."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(len(inside) + 1, bool)
    edge[offs] = True
    before = np.empty(len(inside), bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(len(inside), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    return starts, np.flatnonzero(inside & (~after | edge[1:])) + 1


def _mixed(x):
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeded(n, seed):
    """n fixed pseudo-random 64-bit values."""
    return _mixed((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed * 1_000_003)) * np.uint64(0x9E3779B97F4A7C15))


mix = _mixed
BYTE = seeded(256, 1) | np.uint64(1)
BASE = np.uint64(0xD1342543DE82EF95)
_powers = np.ones(1, np.uint64)


def powers(n):
    global _powers
    if len(_powers) < n:
        p = np.full(max(n, 64), BASE, np.uint64)
        p[0] = 1
        _powers = np.multiply.accumulate(p)
    return _powers[:n]


def run_hashes(data, starts, ends, table=BYTE):
    """A 64-bit hash of each run data[start:end]; runs don't overlap and are in order."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    first = np.zeros(len(lens), np.int64)
    np.cumsum(lens[:-1], out=first[1:])
    shift = np.repeat(starts - first, lens)
    at = np.arange(int(lens.sum()), dtype=np.int64)
    values = table[data[at + shift]]
    values *= powers(int(lens.max()))[at - np.repeat(first, lens)]
    return _mixed(np.add.reduceat(values, first) + lens.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


LOWER_BYTE = BYTE[LOWER]


def window_hashes(h, n):
    """Hash of h[i:i+n] for each i; shorter input gives none."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = out * BASE + h[k:len(h) - n + 1 + k]
    return _mixed(out)


def doc_ranges(starts, offs):
    """For each document the range of runs that start in it."""
    at = np.searchsorted(starts, offs)
    return at[:-1], at[1:]


def range_sums(values, lo, hi):
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[hi] - total[lo]


def sha256(text):
    return hashlib.sha256(text.encode("utf-8") if isinstance(text, str) else text).hexdigest()


def code_point_starts(data):
    return (data & 0xC0) != 0x80


def written(spark, df, name):
    """The frame, written once to the shared checkpoint folder and read again: its lineage ends here."""
    path = f"{scratch_folder(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read(spark, sf_dir, name):
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hash_bucket(col, n):
    """crc32 of a key's text, modulo n; null counts as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % n

