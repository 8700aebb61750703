"""Main text of web pages by minimum-cut labelling.

A page is cut into blocks (runs of inline text inside one block-level element).  A logistic classifier's log-odds become each
block's terminal capacity: towards "content" or towards "boilerplate".  Neighbours in page order and blocks of one parent
element are joined by smoothness edges.  The minimum cut, found by maximum flow, gives the labelling of least total cost.
A block whose terminal capacity exceeds all its edges has the same label in every minimum cut, so it is settled first and only
the rest goes through the flow.

The classifier is trained here on a bounded sample of pages (`Training`).  Its labels come from the elements and class names
whose meaning HTML fixes (`LEADS`, `SIDE`); it carries them over to blocks without such marks by length, links, punctuation,
parents and class words, starting from PRIOR for the marks themselves.  Every page is extracted in a narrow step.

Cases: null and empty pages have no text; pages without any content block give the empty text; repeated rows are each
extracted; broken markup is read as far as it goes; null ids stay; an empty table gives no rows; further columns are ignored."""

from __future__ import annotations

import html
import math
import re
import zlib
from collections import deque
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from crewgrid.llm import textops as X

TAG = re.compile(r"""<!--|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""")
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
RAW = ("script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "object", "title", "select", "canvas", "audio", "video")
RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre "
    "section summary table tbody td tfoot th thead tr ul option".split()
)
CLOSES = {t: frozenset(x.split()) for t, x in {"li": "li p", "p": "p", "td": "td th p", "th": "td th p", "tr": "tr td th p", "dd": "dd dt p", "dt": "dd dt p"}.items()}
SCOPE = frozenset("ul ol table dl div article section main aside nav header footer form body".split())
LEADS = frozenset(("article", "main"))
SIDE = frozenset("nav aside footer form button dialog menu".split())
SIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disqus discussion footer gdpr header hidden legal login "
    "masthead menu modal nav navbar navigation newsletter notice notices notification overlay pagination pager popup promo promoted promotion recommended related replies reply reviews share sharing sidebar "
    "signup skip social sponsor sponsored subscribe tags toolbar tracking widget widgets".split()
)
BODY_WORDS = frozenset("article articlebody body content entry entrycontent main maincontent post postbody postcontent story storybody text".split())
BUCKETS = 1 << 12


@dataclass(frozen=True)
class Training:
    pages: int = 4_000
    blocks: int = 60_000
    rounds: int = 150
    rate: float = 0.1
    decay: float = 2e-4

#: Where the weights of marks with a fixed meaning start, and what they are drawn to.
PRIOR = {"sideTrue": -7.0, "leadTrue": 3.0, "bodywordTrue": 2.0}


@dataclass(frozen=True)
class Smoothness:
    adjacent: float = 0.3
    siblings: float = 0.7


class _Node:
    __slots__ = ("tag", "words", "up", "number", "lead", "side")

    def __init__(self, tag, words, up, number):
        self.tag, self.words, self.up, self.number = tag, words, up, number
        self.lead = (up.lead if up else False) or tag in LEADS
        own = tag in SIDE or (tag == "header" and not self.lead) or any(w in SIDE_WORDS for w in words) and tag not in ("body", "html")
        self.side = (up.side if up else False) or own


def _words(attributes):
    out = []
    if attributes and not attributes.isspace():
        for m in ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                out.append("hidden")
            elif name in ("class", "id", "role"):
                for part in value.split():
                    out.append(re.sub(r"[^a-z0-9]", "", part))
                    out += [w for w in re.split(r"[^a-z]+", part) if w]
    return out


class Block:
    __slots__ = ("text", "links", "node", "inline")

    def __init__(self, text, links, node, inline):
        self.text, self.links, self.node, self.inline = text, links, node, inline


def blocks(page):
    """Blocks of a page with text, in page order."""
    out, parts, link_chars, inline = [], [], 0, set()
    count = 1
    node = _Node("#page", [], None, 0)
    in_link = 0
    at, n = 0, len(page)

    def flush():
        nonlocal parts, link_chars, inline
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, link_chars, node, inline))
        parts, link_chars, inline = [], 0, set()

    while at < n:
        m = TAG.search(page, at)
        end = m.start() if m else n
        if end > at:
            text = page[at:end]
            text = html.unescape(text) if "&" in text else text
            parts.append(text)
            if in_link:
                link_chars += len(text.strip())
        if not m:
            break
        at = m.end()
        if m[0] == "<!--":
            close = page.find("-->", at)
            at = n if close < 0 else close + 3
            continue
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if tag == "a":
                in_link = max(0, in_link - 1)
            if tag in BLOCK:
                flush()
            x = node
            while x.up is not None and x.tag != tag and not (tag not in BLOCK and x.tag in BLOCK):
                x = x.up
            if x.up is not None and x.tag == tag:
                node = x.up
            continue
        if tag in RAW:
            close = RAW_END[tag].search(page, at)
            at = close.end() if close else n
            parts.append(" ")
            continue
        if tag == "br" or tag in ("img", "input"):
            parts.append(" ")
        if tag in BLOCK:
            flush()
            in_link = in_link if tag == "div" else 0
            shut = CLOSES.get(tag) or (CLOSES["p"] if tag != "option" else frozenset(("option",)))
            x = node
            while x.up is not None and x.tag not in shut and x.tag not in SCOPE:
                x = x.up
            while x.up is not None and x.tag in shut:
                node = x = x.up
        if tag in VOID or (m[3] or m[6] or "").endswith("/"):
            continue
        if tag == "a":
            in_link += 1
        words = _words(m[3] or m[6])
        if tag in BLOCK or words:
            node = _Node(tag, words, node, count)
            count += 1
        else:
            inline.add(tag)
    flush()
    return out


def _number(name):
    return 1 + zlib.crc32(name.encode()) % (BUCKETS - 1)


def _features(all_blocks):
    """Feature numbers of each block."""
    out, n = [], len(all_blocks)
    for i, b in enumerate(all_blocks):
        size = len(b.text)
        tags, words, x = [], [], b.node
        while x is not None:
            if x.tag in BLOCK or x.tag in LEADS:
                tags.append(x.tag)
            words += x.words
            x = x.up
        stops = sum(b.text.count(c) for c in ".!?,;")
        names = ["bias", f"size{min(9, int(math.log2(size + 1)))}", f"links{min(4, b.links * 5 // (size + 1))}", f"stops{min(4, stops)}", f"ends{b.text[-1] in '.!?:\"'}", f"own {tags[0] if tags else ''}", f"place{min(4, i * 5 // n)}"]
        names += [f"in {t}" for t in dict.fromkeys(tags)] + [f"word {w}" for w in dict.fromkeys(words)]
        names += [f"side{b.node.side}", f"lead{b.node.lead and not b.node.side}", f"bodyword{any(w in BODY_WORDS for w in words)}"]
        out.append([_number(x) for x in names])
    return out


def _seed(block):
    """1 content, 0 boilerplate, None unknown, from marks whose meaning is fixed."""
    if block.node.side:
        return 0
    if block.node.lead:
        return 1
    words, x = [], block.node
    while x is not None:
        words += x.words
        x = x.up
    if any(w in BODY_WORDS for w in words) and len(block.text) > 40:
        return 1
    return None


def fit_costs(pages, id_col="page_id", html_col="html", how=Training()):
    """Weights of the block classifier, from a bounded sample of pages; None without any labelled block."""
    ids = pages.select(F.col(id_col).alias("key")).where(F.col("key").isNotNull()).orderBy(F.xxhash64("key"), "key").limit(how.pages).distinct()
    sample = pages.select(F.col(id_col).alias("key"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(ids), "key", "left_semi").select("text")

    def label(batches):
        for b in batches:
            rows = []
            for page in b.column(0).to_pylist():
                found = blocks(page)
                rows += [(f, s) for f, s in zip(_features(found), map(_seed, found)) if s is not None]
            f, s = zip(*rows) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.list_(pa.int64())), pa.array(s, pa.int64())], names=["f", "y"])

    rows = sample.mapInArrow(label, "f array<long>, y long").orderBy(F.xxhash64("f", "y"), "f").limit(how.blocks).collect()
    if not rows:
        return None
    y = np.array([r["y"] for r in rows], float)
    size = np.array([len(r["f"]) for r in rows])
    flat, owner = np.array([k for r in rows for k in r["f"]], np.int64), np.repeat(np.arange(len(rows)), size)
    balance = np.where(y > 0, 0.5 / max(1.0, y.sum()), 0.5 / max(1.0, (1 - y).sum()))
    prior, m, v = np.zeros(BUCKETS), np.zeros(BUCKETS), np.zeros(BUCKETS)
    for name, weight in PRIOR.items():
        prior[_number(name)] += weight
    w = prior.copy()
    for step in range(1, how.rounds + 1):
        p = 1 / (1 + np.exp(-np.bincount(owner, w[flat], len(rows))))
        g = np.bincount(flat, ((y - p) * balance)[owner], BUCKETS) - how.decay * (w - prior)
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        w += how.rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return w


def _max_flow(n, edges, source, sink):
    """Source side of a minimum cut; edges: (u, v, capacity, capacity back).  Shortest augmenting paths with level graphs."""
    to, cap, out = [], [], [[] for _ in range(n)]
    for u, v, c, back in edges:
        out[u].append(len(to))
        to.append(v)
        cap.append(c)
        out[v].append(len(to))
        to.append(u)
        cap.append(back)
    while True:
        level = [-1] * n
        level[source] = 0
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for e in out[u]:
                if cap[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [x >= 0 for x in level]
        turn, path, u = [0] * n, [], source
        while True:
            if u == sink:
                push = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= push
                    cap[e ^ 1] += push
                keep = next(i for i, e in enumerate(path) if cap[e] <= 1e-9)
                u = to[path[keep] ^ 1]
                del path[keep:]
                continue
            while turn[u] < len(out[u]) and not (cap[out[u][turn[u]]] > 1e-9 and level[to[out[u][turn[u]]]] == level[u] + 1):
                turn[u] += 1
            if turn[u] < len(out[u]):
                path.append(out[u][turn[u]])
                u = to[path[-1]]
            elif u == source:
                break
            else:
                level[u] = -1
                u = to[path.pop() ^ 1]


def labelled(odds, edges):
    """True for each node on the content side of the minimum cut; edges: (i, j, capacity)."""
    n = len(odds)
    near = [[] for _ in range(n)]
    for i, j, c in edges:
        near[i].append((j, c))
        near[j].append((i, c))
    pull, free = list(odds), [sum(c for _, c in x) for x in near]
    label, queue = [None] * n, deque(range(n))
    while queue:
        i = queue.popleft()
        if label[i] is None and abs(pull[i]) > free[i] + 1e-9:
            label[i] = pull[i] > 0
            for j, c in near[i]:
                if label[j] is None:
                    pull[j] += c if label[i] else -c
                    free[j] -= c
                    queue.append(j)
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        place = {i: k for k, i in enumerate(rest)}
        s, t = len(rest), len(rest) + 1
        flow = [(s, place[i], pull[i], 0.0) if pull[i] > 0 else (place[i], t, -pull[i], 0.0) for i in rest]
        flow += [(place[i], place[j], c, c) for i, j, c in edges if i in place and j in place]
        side = _max_flow(len(rest) + 2, flow, s, t)
        for i in rest:
            label[i] = side[place[i]]
    return label


def content(page, weights, smooth=Smoothness()):
    """Texts of the content blocks of a page."""
    found = blocks(page)
    if not found or weights is None:
        return [b.text for b in found if _seed(b) != 0]
    odds = [float(weights[f].sum()) for f in map(np.array, _features(found))]
    edges, last = [], {}
    for i, b in enumerate(found):
        if i:
            edges.append((i - 1, i, smooth.adjacent))
        parent = b.node.up.number if b.node.up is not None else -1
        if parent in last:
            edges.append((last[parent], i, smooth.siblings))
        last[parent] = i
    return [b.text for b, keep in zip(found, labelled(odds, edges)) if keep]


def extract(pages, weights, id_cols=("page_id", "url"), html_col="html", smooth=Smoothness()):
    """Per row: its id columns, text (content blocks in page order, one per line), n_chars."""
    rows, k = X.plain_text(pages, id_cols, html_col), len(id_cols)
    held = pages.sparkSession.sparkContext.broadcast(weights)

    def step(batches):
        for b in batches:
            for lo, hi, _, _ in X.pieces(b.column(k)):
                part = b.slice(lo, hi - lo)
                texts = ["\n".join(content(p, held.value, smooth)) for p in part.column(k).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:k], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=[*b.schema.names[:k], "text", "n_chars"])

    return rows.mapInArrow(step, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1]) + ", text string, n_chars long")


def op3_extraction(spark, sf_dir):
    pages = X.read(spark, sf_dir, "pages")
    return extract(pages, fit_costs(pages))
