"""Quality rules: word and repetition counts, and compression bands.

A text is compressed with zstandard as a whole and in fixed chunks; ratio = bytes / compressed bytes.  Repetitive text has a
high ratio and incompressible text a low one, but short texts compress badly and long ones well whatever they say, so each
length class has its own limits (`Bands`).  A document is rejected when its whole ratio is outside its class's band or when
more than `chunk_share` of its full-size chunks are outside the chunk band.

Every document is judged by itself in a narrow step: no shuffle, and memory is bounded by a batch.

Cases: null and empty texts have no words and fail the base rule; repeated rows are each reported; null ids stay; an empty
table gives no rows; further columns are ignored."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from crewgrid.llm import textops as X

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
RUN = 8


@dataclass(frozen=True)
class Bands:
    """(bytes from, lowest ratio, highest ratio) by length; below the first length no ratio is judged."""

    whole: tuple = ((150, 1.0, 2.6), (400, 1.2, 2.8), (1_000, 1.35, 3.0), (4_000, 1.5, 3.2), (16_000, 1.6, 3.4), (64_000, 1.6, 3.6))
    chunk_bytes: int = 4096
    chunk: tuple = (1.4, 3.4)
    chunk_share: float = 0.5
    level: int = 3


def _verdict(text, bands, squeeze):
    n = len(text)
    if n < bands.whole[0][0]:
        return None, None, True
    low, high = next((lo, hi) for start, lo, hi in reversed(bands.whole) if n >= start)
    ratio = n / len(squeeze(text))
    chunks = range(0, n - bands.chunk_bytes + 1, bands.chunk_bytes)
    bad = sum(not bands.chunk[0] <= bands.chunk_bytes / len(squeeze(text[i:i + bands.chunk_bytes])) <= bands.chunk[1] for i in chunks)
    share = bad / len(chunks) if len(chunks) else 0.0
    return ratio, share, low <= ratio <= high and share <= bands.chunk_share


def _keyed(h, doc):
    """Values made distinct between documents."""
    return X.mix(h ^ X.mix(doc.astype(np.uint64)))


def _counts(data, offs):
    n = len(offs) - 1
    inside = X.NON_SPACE[data]
    starts, ends = X.spans(inside, offs)
    lo, hi = X.doc_ranges(starts, offs)
    out = {"n_words": hi - lo, "word_chars": X.range_sums(inside & X.code_point_starts(data), offs[:-1], offs[1:]), "n_symbols": X.range_sums(SYMBOL[data], offs[:-1], offs[1:])}
    # lines with a word that equal an earlier one of their document
    line_from, line_to = X.spans(data != 0x0A, offs)
    words_before = np.zeros(len(data) + 1, np.int64)
    np.cumsum(inside, out=words_before[1:])
    full = words_before[line_to] > words_before[line_from]
    line_from, line_to = line_from[full], line_to[full]
    doc = np.searchsorted(offs, line_from, "right") - 1
    first = np.unique(_keyed(X.run_hashes(data, line_from, line_to), doc), return_index=True)[1]
    out["n_dup_lines"] = np.bincount(doc, minlength=n) - np.bincount(doc[first], minlength=n)
    # words covered by a window of RUN words that occurs twice in its document
    h = X.window_hashes(X.run_hashes(data, starts, ends), RUN)
    word_doc = np.repeat(np.arange(n), hi - lo)
    whole = np.flatnonzero(np.arange(len(h)) + RUN <= hi[word_doc[:len(h)]])
    key = _keyed(h[whole], word_doc[whole])
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.append(False, same) | np.append(same, False)
    at = whole[order[twice]] if len(order) else whole
    cover = np.zeros(len(starts) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.subtract.at(cover, at + RUN, 1)
    out["n_repeat_words"] = X.range_sums(np.cumsum(cover[:-1]) > 0, lo, hi)
    return out


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def quality(docs, id_cols=("doc_id",), text_col="text", bands=Bands()):
    """Per row: its id columns, COUNTS, ratio (null where not judged), bad_chunk_share, in_band."""
    texts = X.plain_text(docs, id_cols, text_col)
    k = len(id_cols)

    def judge(batches):
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=bands.level).compress
        for b in batches:
            counts, verdicts = {c: [] for c in COUNTS}, []
            for _, _, data, offs in X.pieces(b.column(k)):
                for c, v in _counts(data, offs).items():
                    counts[c].append(v)
                raw = memoryview(np.ascontiguousarray(data))
                verdicts += [_verdict(raw[s:e], bands, squeeze) for s, e in zip(offs[:-1].tolist(), offs[1:].tolist())]
            cols = [pa.array(np.concatenate(counts[c]).astype(np.int64) if counts[c] else [], pa.int64()) for c in COUNTS]
            ratio, share, good = zip(*verdicts) if verdicts else ((), (), ())
            cols += [pa.array(ratio, pa.float64()), pa.array(share, pa.float64()), pa.array(good, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*b.columns[:k], *cols], names=[*b.schema.names[:k], *COUNTS, "ratio", "bad_chunk_share", "in_band"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema[:-1]) + ", " + ", ".join(f"{c} long" for c in COUNTS) + ", ratio double, bad_chunk_share double, in_band boolean"
    return texts.mapInArrow(judge, schema)


def op9_quality(spark, sf_dir):
    found = quality(X.read(spark, sf_dir, "documents"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return found.select("doc_id", *COUNTS, failed.alias("base_failed"), (~failed & F.col("in_band")).alias("kept"), "ratio", "bad_chunk_share")
