"""Secret scans: fixed patterns, and a linear-chain conditional random field that adds spans they miss.

The field tags white-space tokens of a line as begin, inside or outside of a secret, from their shape, the neighbouring tokens
and the file they stand in, and is decoded by Viterbi.  It is trained here on a bounded sample of documents (`Training`), with
the fixed patterns' spans as labels; the sample only teaches, every document is scanned.

Only tokens with a digit, an assignment sign or a key word (`TELLING`) and their neighbours have features of their own; all
others share one feature set.  `Field.decode` runs over each stretch of tokens near a telling one.  That equals decoding the
whole line when, for a shared-feature token, the tag "outside" beats the others between any two tags; this is tested once on the
trained weights, and if it fails whole lines are decoded.

Spans are code points, end exclusive.  A scan is a narrow step without shuffle.

Cases: null and empty texts have no spans; without labelled spans in the sample the field adds nothing; repeated rows are each
scanned; null ids stay; an empty table gives no rows; further columns are ignored."""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from crewgrid.llm import textops as X

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run of fewer can't be part of a longer match
KEYWORD = re.compile(r"password|passwd|secret|token|api_?key|credential|auth|private", re.I | re.A)
TELLING = re.compile(r"[0-9=:]|password|passwd|secret|token|api_?key|credential", re.I | re.A)
TOKEN = re.compile(r"\S+")
KINDS = ("assign", "access", "hex", "crf")
EDGES = "\"'`,.;:()[]{}<>"
B, I, O = 0, 1, 2  # noqa: E741
BUCKETS = 1 << 11
WIDTH = 20


@dataclass(frozen=True)
class Training:
    documents: int = 20_000
    sequences: int = 20_000
    length: int = 32
    rounds: int = 80
    rate: float = 0.15
    decay: float = 1e-4


def base_spans(text):
    out = []
    if ":" in text or "=" in text:
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def _bucket(name):
    return 1 + zlib.crc32(name.encode()) % (BUCKETS - 1)


def _shape(token):
    """Names of a token's own features."""
    core = token.strip(EDGES)
    n = len(core)
    digits, upper, lower = sum(c.isdigit() for c in core), sum(c.isupper() for c in core), sum(c.islower() for c in core)
    counts = {}
    for c in core:
        counts[c] = counts.get(c, 0) + 1
    bits = -sum(k / n * math.log2(k / n) for k in counts.values()) if n else 0.0
    case = ("u" if upper else "") + ("l" if lower else "") + ("d" if digits else "")
    out = [f"len{min(12, n // 4)}", f"dig{digits * 4 // n if n else 0}", f"case{case}", f"bits{int(bits * 2)}", f"case{case}len{min(6, n // 8)}"]
    if re.fullmatch(r"[0-9a-f]+", core):
        out.append(f"hex{min(4, n // 8)}")
    if re.fullmatch(r"[A-Za-z0-9+/_=-]+", core):
        out.append(f"code{min(4, n // 8)}{case}")
    if re.fullmatch(r"[0-9.:()+ -]+", core):
        out.append("number")
    if "@" in core or "://" in core:
        out.append("address")
    if KEYWORD.search(core):
        out.append("keyword")
    if re.search(r"[:=]", token):
        out.append("sign")
    if token[:1] in "\"'":
        out.append("quoted")
    return out


PLAIN = ["plain"]


def _features(tokens, telling, file):
    """Feature numbers per token (WIDTH wide, 0: none); its own, its neighbours' and its file's."""
    own = [_shape(t) if k else PLAIN for t, k in zip(tokens, telling)]
    brief = ["plain" if not k else "keyword" if "keyword" in o and "sign" not in o else "keysign" if "keyword" in o else "sign" if t.strip(EDGES + "=") == "" else "other" for t, o, k in zip(tokens, own, telling)]
    at = lambda i: brief[i] if 0 <= i < len(brief) else "plain"
    out = np.zeros((len(tokens), WIDTH), np.int64)
    for i, o in enumerate(own):
        names = [*o, f"prev {at(i - 1)}", f"prev2 {at(i - 2)} {at(i - 1)}", f"next {at(i + 1)}", f"next2 {at(i + 1)} {at(i + 2)}", *file][:WIDTH]
        out[i, :len(names)] = [_bucket(x) for x in names]
    return out


def _file(text, n_telling):
    return [f"file signs{min(4, (text.count('=') + text.count(':')).bit_length())}", f"file telling{min(6, n_telling.bit_length())}"]


def stretches(text, whole_lines=False):
    """(token spans, features) of each stretch of tokens near a telling one; no stretch crosses a line."""
    marks = [m.start() for m in TELLING.finditer(text)]
    if not marks:
        return
    file, at = _file(text, len(marks)), 0
    while at < len(marks):
        line_from = text.rfind("\n", 0, marks[at]) + 1
        line_to = text.find("\n", marks[at])
        line_to = len(text) if line_to < 0 else line_to
        spans = [m.span() for m in TOKEN.finditer(text, line_from, line_to)]
        telling = [False] * len(spans)
        k = 0
        while at < len(marks) and marks[at] < line_to:
            while spans[k][1] <= marks[at]:
                k += 1
            telling[k] = True
            at += 1
        near, last = [], -1
        for i in (i for i, x in enumerate(telling) if x):
            lo, hi = max(0, i - 3), min(len(spans), i + 4)
            if near and lo <= last:
                near[-1][1] = hi
            else:
                near.append([lo, hi])
            last = hi
        for lo, hi in [[0, len(spans)]] if whole_lines else near:
            yield spans[lo:hi], _features([text[a:z] for a, z in spans[lo:hi]], telling[lo:hi], file)


class Field:
    """Weights by (feature, tag) and (tag, tag); a sequence starts and ends outside."""

    def __init__(self, emit, trans):
        self.emit, self.trans = emit, trans
        plain = [_bucket(x) for x in (*PLAIN, "prev plain", "prev2 plain plain", "next plain", "next2 plain plain")]
        files = [_bucket(f"file {a}{b}") for a in ("signs", "telling") for b in range(7)]
        worst = self.emit[plain].sum(0)
        slack = np.array([sum(sorted((self.emit[f, O] - self.emit[f, x] for f in files))[:2]) if x != O else 0.0 for x in range(3)])
        gain = [worst[O] - worst[x] + min(0.0, slack[x]) + min(trans[a, O] + trans[O, b] - trans[a, x] - trans[x, b] for a in range(3) for b in range(3)) for x in (B, I)]
        self.local = min(gain) > 0

    def decode(self, features):
        """The best tags of a sequence."""
        e = self.emit[features].sum(1)
        best, back = e[0] + self.trans[O], []
        for row in e[1:]:
            paths = best[:, None] + self.trans
            back.append(paths.argmax(0))
            best = paths.max(0) + row
        tag = int((best + self.trans[:, O]).argmax())
        out = [tag]
        for b in reversed(back):
            out.append(tag := int(b[tag]))
        return out[::-1]


def _log_sum(x, axis):
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def train(features, tags, size, how):
    """Maximum likelihood by Adam over padded sequences: features (n, length, WIDTH), tags (n, length), size (n)."""
    n, length = tags.shape
    emit, trans = np.zeros((BUCKETS, 3)), np.zeros((3, 3))
    inside = np.arange(length)[None, :] < size[:, None]
    rows = np.arange(n)
    gold = np.zeros((n, length, 3))
    gold[rows[:, None], np.arange(length)[None, :], tags] = 1
    gold[~inside] = 0
    pairs = np.zeros((3, 3))
    before = np.column_stack([np.full(n, O), tags[:, :-1]])
    np.add.at(pairs, (before[inside], tags[inside]), 1)
    np.add.at(pairs, (tags[rows, size - 1], O), 1)
    state = [(np.zeros_like(w), np.zeros_like(w)) for w in (emit, trans)]
    for step in range(1, how.rounds + 1):
        e = emit[features].sum(2)
        a = np.zeros((n, length, 3))
        a[:, 0] = e[:, 0] + trans[O]
        for t in range(1, length):
            a[:, t] = np.where(inside[:, t, None], _log_sum(a[:, t - 1, :, None] + trans, 1) + e[:, t], a[:, t - 1])
        z = _log_sum(a[:, -1] + trans[:, O], 1)
        b = np.zeros((n, length, 3))
        b[:, -1] = trans[:, O]
        wanted = np.zeros((3, 3))
        for t in range(length - 2, -1, -1):
            ahead = trans + (e[:, t + 1] + b[:, t + 1])[:, None, :]
            live = inside[:, t + 1, None]
            b[:, t] = np.where(live, _log_sum(ahead, 2), trans[:, O])
            p = np.exp(a[:, t, :, None] + ahead - z[:, None, None])
            wanted += p[inside[:, t + 1]].sum(0)
        p = np.exp(a + b - z[:, None, None]) * inside[:, :, None]
        wanted[O] += p[:, 0].sum(0)
        wanted[:, O] += p[rows, size - 1].sum(0)
        diff = gold - p
        flat = features.ravel()
        g_emit = np.stack([np.bincount(flat, np.repeat(diff[:, :, k].ravel(), WIDTH), BUCKETS) for k in range(3)], 1) / n - how.decay * emit
        g_trans = (pairs - wanted) / n - how.decay * trans
        for w, g, (m, v) in zip((emit, trans), (g_emit, g_trans), state):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w += how.rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
        emit[0] = 0
    return Field(emit, trans)


def fit_field(docs, id_col="doc_id", text_col="text", how=Training()):
    """The field trained on a bounded sample of docs; None where the sample has no labelled span."""
    ids = docs.select(F.col(id_col).alias("key")).where(F.col("key").isNotNull()).orderBy(F.xxhash64("key"), "key").limit(how.documents).distinct()
    texts = docs.select(F.col(id_col).alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(ids), "key", "left_semi").select("text")

    def label(batches):
        for b in batches:
            out = []
            for text in b.column(0).to_pylist():
                base = base_spans(text)
                for spans, features in stretches(text):
                    tags, last = [], None
                    for s, e in spans:
                        hit = next((x for x in base if x[1] < e and s < x[2]), None)
                        tags.append(O if hit is None else I if last is not None and last[1] < hit[2] and hit[1] < last[2] else B)
                        last = hit
                    for k in range(0, len(tags), how.length):
                        out.append((features[k:k + how.length].ravel().tolist(), tags[k:k + how.length]))
            f, t = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.list_(pa.int64())), pa.array(t, pa.list_(pa.int64()))], names=["features", "tags"])

    rows = texts.mapInArrow(label, "features array<long>, tags array<long>").orderBy(F.xxhash64("features", "tags"), "features", "tags").limit(how.sequences).collect()
    if not any(t != O for r in rows for t in r["tags"]):
        return None
    n = len(rows)
    size = np.array([len(r["tags"]) for r in rows])
    features, tags = np.zeros((n, int(size.max()), WIDTH), np.int64), np.full((n, int(size.max())), O)
    for i, r in enumerate(rows):
        features[i, :size[i]] = np.array(r["features"]).reshape(-1, WIDTH)
        tags[i, :size[i]] = r["tags"]
    return train(features, tags, size, how)


def find(text, field):
    """All spans of a text, by start, then kind as listed in KINDS."""
    base = base_spans(text)
    out = list(base)
    if field is not None:
        for spans, features in stretches(text, not field.local):
            tags, k = field.decode(features), 0
            while k < len(tags):
                if tags[k] == O:
                    k += 1
                    continue
                first = k
                k += 1
                while k < len(tags) and tags[k] == I:
                    k += 1
                s, e = spans[first][0], spans[k - 1][1]
                e -= len(text[s:e]) - len(text[s:e].rstrip(EDGES))
                s += len(text[s:e]) - len(text[s:e].lstrip(EDGES))
                if s < e and not any(a < e and s < z for _, a, z in base):
                    out.append(("crf", s, e))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def redacted(text, spans, mark="[SECRET]"):
    out, at = [], 0
    for _, s, e in spans:
        if e > at:
            if s >= at:
                out += [text[at:s], mark]
            at = e
    return "".join(out) + text[at:]


def scan(docs, field, id_cols=("doc_id",), text_col="text"):
    """Per row: its id columns, clean (the text with its secrets masked) and spans (kind, from, to)."""
    texts, k = X.plain_text(docs, id_cols, text_col), len(id_cols)
    held = docs.sparkSession.sparkContext.broadcast(None if field is None else (field.emit, field.trans))
    span = pa.list_(pa.struct([("kind", pa.string()), ("from", pa.int64()), ("to", pa.int64())]))

    def step(batches):
        f = None if held.value is None else Field(*held.value)
        for b in batches:
            for lo, hi, _, _ in X.pieces(b.column(k)):
                part = b.slice(lo, hi - lo)
                rows = [(t, find(t, f)) for t in part.column(k).to_pylist()]
                cols = [pa.array([redacted(t, s) if s else t for t, s in rows], pa.string()), pa.array([[{"kind": x[0], "from": x[1], "to": x[2]} for x in s] for _, s in rows], span)]
                yield pa.RecordBatch.from_arrays([*part.columns[:k], *cols], names=[*b.schema.names[:k], "clean", "spans"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema[:-1])
    return texts.mapInArrow(step, f"{schema}, clean string, spans array<struct<kind:string,from:long,to:long>>")


def _count(kind):
    return F.size(F.filter("spans", lambda s: s["kind"] == kind))


def op4_secrets(spark, sf_dir):
    docs = X.read(spark, sf_dir, "documents")
    found = scan(docs, fit_field(docs))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["from"], s["to"])), ",")
    base = F.filter("spans", lambda s: s["kind"] != "crf")
    return found.select(
        "doc_id", *(_count(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(said(base).cast("binary"), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"),
    )
