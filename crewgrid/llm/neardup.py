"""Near-duplicate groups by improved consistent weighted sampling over TF-IDF shingles.

A text's shingles are its runs of SHINGLE lower-cased words (a text with fewer words is one shingle).  A shingle weighs its
count times 1 + the mean idf of its words, idf = ln(1 + N/df) / ln(1 + N), counted over all documents in FEATURES hashed
buckets as in Spark's HashingTF, so the broadcast table has a fixed size.

1. Exact copies (same words in the same order) form classes; only one of a class goes on.
2. Each class has ROWS x BANDS consistent weighted samples; classes that agree on a band of ROWS samples share a bucket.
3. Each class is paired with the leader of its buckets whose samples agree best, pairs are verified by exact weighted Jaccard
   similarity of the whole texts, and verified links are joined to components.
4. In buckets that still hold several components, all cross pairs are tested: up to SMALL members by a join; the members of
   larger ones by a prefix-filtered weighted-Jaccard join (`settled`), which first links each member to its likeliest partner
   outside its component, round by round, and then tests every cross pair that is left.  A
   link inside a component adds nothing to the classes, so it is not tested again.
No step emits all pairs of a large bucket: members that share a prefix shingle are compared in tiles inside tasks, and only
pairs of different components whose weights and samples allow the threshold come out.
Pairs whose samples agree in fewer than MATCHES places are dropped before their texts move (a similarity of 0.8 falls below
that with probability 1e-5).

Cases: rows with a null id are not compared and have no group; rows of one id are one document; texts without words are exact
copies of each other; null texts are empty; ties go to the smaller id; an empty table gives no rows; further columns are
ignored."""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from crewgrid.llm import textops as X
from crewgrid.llm.components import components
from crewgrid.llm.contamination import _words

SHINGLE, SIMILARITY = 5, 0.8
ROWS, BANDS = 3, 12
MATCHES = 18
SMALL = 32
TILE = 1024
COUNTS = 1 << 20
CUT = 4096
YIELD = 0.25
FEATURES = 1 << 18
GRID = 1 << 16


def _bucket(h):
    return (h >> np.uint64(20)).astype(np.int64) & (FEATURES - 1)


def word_idf(texts):
    """idf by hashed word bucket, over all documents."""
    def count(batches):
        total, docs = np.zeros(FEATURES, np.int64), 0
        for b in batches:
            docs += b.num_rows
            for _, _, data, offs in X.pieces(b.column(0)):
                h, lo, hi = _words(data, offs)
                key = np.repeat(np.arange(len(lo)) * FEATURES, hi - lo) + _bucket(h)
                total += np.bincount(np.unique(key) & (FEATURES - 1), minlength=FEATURES)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], docs))], names=["bucket", "n"])

    rows = texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # FEATURES + 1 rows at most
    bucket, n = rows["bucket"].to_numpy(), rows["n"].to_numpy()
    docs = max(1, int(n[bucket == -1].sum()))
    df = np.zeros(FEATURES)
    df[bucket[bucket >= 0]] = n[bucket >= 0]
    return (np.log1p(docs / np.maximum(df, 1)) / np.log1p(docs)).astype(np.float32)


def _bags(data, offs, idf):
    """(document, shingle, weight), distinct, by document; and the words."""
    h, lo, hi = _words(data, offs)
    n = hi - lo
    value = idf[_bucket(h)].astype(np.float64)
    total = np.concatenate([[0.0], np.cumsum(value)])
    size = np.minimum(n, SHINGLE)
    count = np.where(n > 0, n - size + 1, 0)
    doc = np.repeat(np.arange(len(n)), count)
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    start = np.arange(int(count.sum())) - np.repeat(first, count) + np.repeat(lo, count)
    key = np.zeros(len(start), np.uint64)
    mean = np.zeros(len(start))
    for k in range(SHINGLE):
        live = slice(None) if len(size) == 0 or size[n > 0].min(initial=SHINGLE) == SHINGLE else np.flatnonzero(size[doc] > k)
        key[live] = key[live] * X.BASE + h[start[live] + k]
        mean[live] += value[start[live] + k]
    key = X.mix(key)
    order = np.argsort(key, kind="stable")
    order = order[np.argsort(doc[order], kind="stable")] if len(n) > 1 else order
    key, doc, mean = key[order], doc[order], mean[order] / size[doc[order]]
    new = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]))) if len(key) else np.zeros(0, np.int64)
    tf = np.diff(np.append(new, len(key)))
    return doc[new], key[new], tf * (1 + np.round(mean[new], 9)), h, lo, hi


class Sampler:
    """Improved consistent weighted sampling: per sample a Gamma(2,1) scale r, a Gamma(2,1) level c and a shift b, all keyed by
    the shingle.  The smallest ln a = ln c - r (t - b + 1), t = floor(ln w / r + b), names the sampled shingle and level."""

    def __init__(self, samples=ROWS * BANDS):
        p = (np.arange(GRID) + 0.5) / GRID
        x = np.linspace(0, 30, 400_001)
        self.gamma = np.interp(p, 1 - np.exp(-x) * (1 + x), x).astype(np.float32)
        self.log_gamma = np.log(self.gamma)
        self.seeds = X.seeded(samples, 7)

    def __call__(self, key, weight, first):
        """(documents, samples) of 32-bit signatures; first: where each document's shingles start, none empty."""
        log_w = np.log(weight).astype(np.float32)
        out = np.zeros((len(first), len(self.seeds)), np.int32)
        for k, seed in enumerate(self.seeds):
            u = (key ^ seed) * np.uint64(0x9FB21C651E98DF25)
            u ^= u >> np.uint64(32)
            u *= np.uint64(0xD6E8FEB86659FD93)
            r = self.gamma[(u >> np.uint64(48)).astype(np.int64)]
            c = self.log_gamma[(u >> np.uint64(32)).astype(np.int64) & (GRID - 1)]
            b = ((u >> np.uint64(16)).astype(np.int64) & (GRID - 1)).astype(np.float32) * np.float32(1 / GRID)
            t = np.floor(log_w / r + b)
            out[:, k] = np.minimum.reduceat(c - r * (t - b + 1), first).view(np.int32)
        return out


def signatures(texts, idf):
    """id, key (16 bytes naming the word sequence), sig (null without words)."""
    held = texts.sparkSession.sparkContext.broadcast(idf)
    kind = texts.schema["id"].dataType.simpleString()

    def step(batches):
        draw = Sampler()
        for b in batches:
            for lo_row, hi_row, data, offs in X.pieces(b.column(1)):
                doc, key, weight, h, lo, hi = _bags(data, offs, held.value)
                names = [hashlib.blake2b(h[a:z].tobytes(), digest_size=16).digest() for a, z in zip(lo.tolist(), hi.tolist())]
                first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, np.int64)
                sig = [None] * (hi_row - lo_row)
                if len(first):
                    for d, row in zip(doc[first].tolist(), draw(key, weight, first)):
                        sig[d] = row
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo_row, hi_row - lo_row), pa.array(names, pa.binary()), pa.array(sig, pa.list_(pa.int32()))], names=["id", "key", "sig"])

    return texts.mapInArrow(step, f"id {kind}, key binary, sig array<int>")


def _needed(texts, ids):
    """The rows of texts whose id is in ids.  A bit table of the ids, at most 2^18 words of 64 bits, drops most others before the shuffle."""
    bit = F.expr("pmod(xxhash64(id), 16777216L)")
    words = ids.select(F.shiftright(bit, 6).alias("word"), F.expr("shiftleft(1L, cast(pmod(xxhash64(id), 64L) AS int))").alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("mask"))
    near = texts.join(F.broadcast(words), F.shiftright(bit, 6) == F.col("word"))
    return near.where(F.expr("(shiftright(mask, cast(pmod(xxhash64(id), 64L) AS int)) & 1L) = 1")).select("id", "text")


def verified(spark, texts, pairs, idf, similarity=SIMILARITY):
    """The pairs (a, b), stored and all different, whose weighted Jaccard similarity reaches the threshold.  Texts of b move to their a; an a with many
    partners is dealt to several tasks."""
    hubs = pairs.groupBy("a").agg(F.expr("cast(ceil(count(*) / 64) AS int)").alias("salts"))
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    some = _needed(texts, ids)
    left = some.join(hubs.withColumnRenamed("a", "id"), "id").select(F.col("id").alias("a"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("part"), F.col("id").alias("b"), "text")
    right = pairs.join(hubs, "a").select("a", F.expr("cast(pmod(xxhash64(b), salts) AS int)").alias("salt"), F.lit(1).alias("part"), F.col("b").alias("id")).join(some, "id").select("a", "salt", "part", F.col("id").alias("b"), "text")
    held = spark.sparkContext.broadcast(idf)
    kind = texts.schema["id"].dataType.simpleString()

    def check(batches):
        hub = None
        for b in batches:
            out_a, out_b, out_s = [], [], []
            a_col, s_col, p_col, b_col = (b.column(i).to_pylist() for i in range(4))
            for lo, hi, data, offs in X.pieces(b.column(4)):
                doc, key, weight = _bags(data, offs, held.value)[:3]
                edge = np.searchsorted(doc, np.arange(hi - lo + 1))
                for d in range(hi - lo):
                    k, w, row = key[edge[d]:edge[d + 1]], weight[edge[d]:edge[d + 1]], lo + d
                    if p_col[row] == 0:
                        hub = (a_col[row], s_col[row], k, w, w.sum())
                    elif hub is not None and hub[:2] == (a_col[row], s_col[row]) and len(k) and len(hub[2]):
                        at = np.searchsorted(hub[2], k)
                        at[at == len(hub[2])] = 0
                        common = np.flatnonzero(hub[2][at] == k)
                        both = np.minimum(w[common], hub[3][at[common]]).sum()
                        s = both / (w.sum() + hub[4] - both)
                        if s >= similarity:
                            out_a.append(a_col[row])
                            out_b.append(b_col[row])
                            out_s.append(float(s))
            yield pa.RecordBatch.from_arrays([pa.array(out_a, b.schema.field(0).type), pa.array(out_b, b.schema.field(3).type), pa.array(out_s, pa.float64())], names=["a", "b", "similarity"])

    dealt = left.unionByName(right).repartition("a", "salt").sortWithinPartitions("a", "salt", "part")
    return X.written(spark, dealt.mapInArrow(check, f"a {kind}, b {kind}, similarity double"), "links")


def _alike(pairs, sigs):
    """Pairs whose samples agree in MATCHES places at least, with that number."""
    side = lambda c: sigs.select(F.col("id").alias(c), F.col("sig").alias(f"sig_{c}"))
    same = F.size(F.filter(F.zip_with("sig_a", "sig_b", lambda x, y: x == y), lambda x: x))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", same.alias("same")).where(F.col("same") >= MATCHES)


def _members(sigs):
    """One row per class and band: key, id, band, sig."""
    hashes = F.array(*[F.xxhash64(F.lit(i), *[F.col("sig")[ROWS * i + k] for k in range(ROWS)]) for i in range(BANDS)])
    return sigs.select("id", F.posexplode(hashes).alias("band", "key"))


def _postings(texts, ids, idf, similarity):
    """id, shingle, total, rest of the open ids: each text's rarest shingles, with the text's weight and that of the shingle and
    all after it in order of rarity.  Weights sum to `total`; a partner shares at least `similarity` of it, so their first common
    shingle has a rest of that much in both.  Rarity is counted in COUNTS hashed buckets over the open texts; any fixed order is right."""
    near = _needed(texts, ids)
    sc = texts.sparkSession.sparkContext
    held = sc.broadcast(idf)

    def count(batches):
        total = np.zeros(COUNTS, np.int64)
        for b in batches:
            for _, _, data, offs in X.pieces(b.column(1)):
                total += np.bincount((_bags(data, offs, held.value)[1] & np.uint64(COUNTS - 1)).astype(np.int64), minlength=COUNTS)
        cuts, parts = [], []
        for cut in range(0, COUNTS, CUT):
            at = np.flatnonzero(total[cut:cut + CUT])
            if len(at):
                cuts.append(cut)
                parts.append(at.astype(np.uint16).tobytes() + total[cut + at].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(cuts, pa.int64()), pa.array(parts, pa.binary())], names=["cut", "part"])

    def add(batches):
        sums = {}
        for b in batches:
            for cut, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n = len(part) // 10
                total = sums.setdefault(cut, np.zeros(CUT, np.int64))
                total[np.frombuffer(part, np.uint16, n)] += np.frombuffer(part[2 * n:], np.int64, n)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["cut", "part"])

    rows = near.mapInArrow(count, "cut long, part binary").repartition("cut").mapInArrow(add, "cut long, part binary").toArrow()  # COUNTS numbers at most
    often = np.zeros(COUNTS, np.int64)
    for cut, part in zip(rows["cut"].to_pylist(), rows["part"].to_pylist()):
        often[cut:cut + CUT] = np.frombuffer(part, np.int64)
    table = sc.broadcast(often)
    kind = texts.schema["id"].dataType.simpleString()

    def step(batches):
        for b in batches:
            for lo, hi, data, offs in X.pieces(b.column(1)):
                doc, key, weight = _bags(data, offs, held.value)[:3]
                order = np.lexsort((key, table.value[(key & np.uint64(COUNTS - 1)).astype(np.int64)], doc))
                doc, key, weight = doc[order], key[order], weight[order]
                total = np.bincount(doc, weight, hi - lo)
                past = np.concatenate([[0.0], np.cumsum(weight)])
                before = past[:-1] - past[np.searchsorted(doc, np.arange(hi - lo))][doc]
                keep = np.flatnonzero(before <= (1 - similarity + 1e-9) * total[doc])
                cols = [b.column(0).take(pa.array(lo + doc[keep])), pa.array(key[keep].view(np.int64)), pa.array(total[doc[keep]]), pa.array((total[doc] - before)[keep])]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "shingle", "total", "rest"])

    return near.mapInArrow(step, f"id {kind}, shingle long, total double, rest double")


def _tile_pairs(group, tile, label, total, rest, code, similarity, best):
    """(row, row, agreeing samples) of the rows of one shingle and tile pair that can reach the threshold and have different
    labels; with `best` only each row's likeliest partner (rows of the most frequent label are partners only)."""
    hub = np.bincount(label).argmax()
    others = np.flatnonzero(label != hub)
    out = []
    for at in range(0, len(others), 64):
        p = others[at:at + 64, None]
        q = np.arange(len(label))[None, :]
        ok = (label[p] != label[q]) & ((label[q] == hub) | (p < q)) & (np.minimum(rest[p], rest[q]) >= (similarity / (1 + similarity) - 1e-9) * (total[p] + total[q]))
        if group[1] != group[2]:
            ok &= tile[p] != tile[q]
        x, y = np.nonzero(ok)
        x = others[at + x]
        for k in range(0, len(x), 1 << 16):
            a, b = x[k:k + (1 << 16)], y[k:k + (1 << 16)]
            same = (code[a] == code[b]).sum(1)
            good = np.flatnonzero(same >= MATCHES)
            out.append((a[good], b[good], same[good]))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    a, b, same = (np.concatenate(c) for c in zip(*out))
    if best:
        order = np.argsort(-same, kind="stable")
        a, b, same = a[order], b[order], same[order]
        keep = np.unique(np.concatenate([np.unique(a, return_index=True)[1], np.flatnonzero(label[b] != hub)[np.unique(b[label[b] != hub], return_index=True)[1]]]))
        a, b, same = a[keep], b[keep], same[keep]
    return a, b, same


def _cross_pairs(postings, nodes, similarity, best):
    """a, b, same: pairs of nodes(id, label, code) with different labels that a shared shingle leaves possible."""
    now = postings.join(nodes, "id")
    busy = now.groupBy("shingle").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("shingle", F.expr(f"cast(ceil(n / {TILE}) AS int)").alias("tiles"))
    dealt = now.join(busy, "shingle").withColumn("tile", F.expr("cast(pmod(xxhash64(id), tiles) AS int)")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select("shingle", F.least("tile", "with").alias("i"), F.greatest("tile", "with").alias("j"), "tile", "id", "label", "total", "rest", "code")
    kind = nodes.schema["id"].dataType.simpleString()

    def step(batches):
        def pairs(rows, last):
            """Pairs of the whole groups of rows, and the rows of the last group unless it is `last`."""
            key = np.column_stack([rows.column(k).to_numpy() for k in range(3)])
            edge = np.append(np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(1))), len(key))
            stop = len(edge) - (1 if last else 2)
            tile, total, rest = (rows.column(k).to_numpy() for k in (3, 6, 7))
            label = rows.column(5).combine_chunks().dictionary_encode().indices.to_numpy()
            code = rows.column(8).combine_chunks().flatten().to_numpy().reshape(len(key), -1)
            found = []
            for s, e in zip(edge[:stop].tolist(), edge[1:stop + 1].tolist()):
                own = np.unique(label[s:e], return_inverse=True)[1]
                if own.any():
                    a, b, same = _tile_pairs(key[s], tile[s:e], own, total[s:e], rest[s:e], code[s:e], similarity, best)
                    found.append((s + a, s + b, same))
            a, b, same = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
            ids = rows.column(4).combine_chunks()
            return pa.RecordBatch.from_arrays([ids.take(pa.array(a)), ids.take(pa.array(b)), pa.array(same.astype(np.int64))], names=["a", "b", "same"]), rows.slice(edge[stop])

        held = None
        for b in batches:
            if b.num_rows:
                rows = pa.Table.from_batches([b])
                rows = rows if held is None else pa.concat_tables([held, rows]).combine_chunks()
                out, held = pairs(rows, False)
                yield out
        if held is not None and held.num_rows:
            yield pairs(held.combine_chunks(), True)[0]

    found = dealt.repartition("shingle", "i", "j").sortWithinPartitions("shingle", "i", "j").mapInArrow(step, f"a {kind}, b {kind}, same long")
    return found.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("same").alias("same"))


def joined(spark, labels, *links):
    """(id, label) after further links: the components of the old ones, each hung on its label, and the links."""
    ends = [labels.where("id <> label").select(F.col("label").alias("u"), F.col("id").alias("v")), *(x.select(F.col("a").alias("u"), F.col("b").alias("v")) for x in links)]
    return components(spark, reduce(lambda x, y: x.union(y), ends))


def settled(spark, texts, ids, sigs, labels, idf, likely, similarity=SIMILARITY):
    """labels after all pairs of ids in different components, and the pairs `likely`, are tested.  While at least
    YIELD of the likeliest partners are links, only they are verified; the last round verifies every pair left."""
    code = F.expr("transform(sig, x -> cast(pmod(hash(x), 256) - 128 AS tinyint))")  # equal samples have equal bytes
    coded = X.written(spark, sigs.join(ids, "id", "left_semi").select("id", code.alias("code")), "coded")
    postings = X.written(spark, _postings(texts, ids, idf, similarity), "postings")
    shared = postings.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1").select("shingle")
    postings = X.written(spark, postings.join(shared, "shingle"), "postings")
    best, waiting, links = True, likely.select("a", "b"), []
    while True:
        nodes = coded.join(labels, "id", "left").select("id", F.coalesce("label", "id").alias("label"), "code")
        pairs = X.written(spark, _cross_pairs(postings, nodes, similarity, best), "likely")
        if best:
            both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "same"))
            pairs = both.groupBy("a").agg(F.max(F.struct("same", "b"))["b"].alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
            pairs = X.written(spark, pairs, "likely")
        nothing = pairs.isEmpty()
        if nothing and waiting is None:
            return joined(spark, labels, *links) if links else labels
        tested = pairs if waiting is None else X.written(spark, pairs.select("a", "b").union(waiting).distinct(), "pairs")
        new = verified(spark, texts, tested.select("a", "b"), idf, similarity)
        found = new.count()
        own = found if waiting is None else new.join(pairs, ["a", "b"], "left_semi").count()
        if found:
            links.append(new)
        last = nothing or not best
        more = not last and own >= YIELD * pairs.count()
        if links and (last or more):  # the last round may test a few pairs that single links have joined meanwhile
            labels, links = joined(spark, labels, *links), []
        if last:
            return labels
        best, waiting = more, None


def _busy(spark, members, labels):
    """key, id, label of the buckets that hold several components."""
    tagged = X.written(spark, members.select("key", "id").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id")), "tagged")
    busy = tagged.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
    return X.written(spark, tagged.join(busy, "key"), "busy")


def near_groups(docs, id_col="doc_id", text_col="text", similarity=SIMILARITY):
    """One row per id: id, class_id (least id with the same words), group_id (least id of its near-duplicate group)."""
    spark = docs.sparkSession
    texts = X.plain_text(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), ["id"]).where(F.col("id").isNotNull())
    idf = word_idf(texts)
    signed = X.written(spark, signatures(texts, idf), "signed")
    classes = signed.groupBy("key").agg(F.min("id").alias("class_id"))
    classed = X.written(spark, signed.select("id", "key").join(classes, "key").groupBy("id").agg(F.min("class_id").alias("class_id")), "classed")
    sigs = X.written(spark, signed.where(F.col("sig").isNotNull()).join(classes.select(F.col("class_id").alias("id"), "key"), ["id", "key"]).groupBy("id").agg(F.min("sig").alias("sig")), "sigs")
    found = X.written(spark, _members(sigs), "members")
    shared = found.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("leader")).where("n > 1")
    members = X.written(spark, found.join(shared, "key"), "shared")
    led = _alike(members.where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct(), sigs)
    best = led.groupBy("b").agg(F.min(F.struct((-F.col("same")).alias("less"), F.col("a"))).alias("x"))
    led = X.written(spark, best.select(F.col("x.a").alias("a"), "b"), "led")
    links = verified(spark, texts, led, idf, similarity)
    # links between parts that are not yet joined
    labels = components(spark, links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    small = _busy(spark, members.where(F.col("n") <= SMALL), labels)
    side = lambda c: small.select("key", F.col("id").alias(c), F.col("label").alias(f"label_{c}"))
    pairs = side("a").join(side("b"), "key").where("a < b AND label_a <> label_b").select("a", "b").distinct()
    likely = X.written(spark, _alike(pairs, sigs), "likely")
    rest = X.written(spark, _busy(spark, members.where(F.col("n") > SMALL), labels).select("id").distinct(), "rest")
    if not rest.isEmpty():
        labels = settled(spark, texts, rest, sigs, labels, idf, likely, similarity)
    elif not likely.isEmpty():
        labels = joined(spark, labels, verified(spark, texts, likely, idf, similarity))
    return classed.join(labels.select(F.col("id").alias("class_id"), "label"), "class_id", "left").select("id", "class_id", F.coalesce("label", "class_id").alias("group_id"))


def one_of_each(docs, columns, id_col="doc_id", text_col="text", similarity=SIMILARITY):
    """The rows of docs (columns only) that lead their near-duplicate group, one row an id; rows with a null id stay.  A bit
    table of the ids that go or are repeated keeps all other rows where they are."""
    groups = near_groups(docs, id_col, text_col, similarity)
    drop = groups.where("id <> group_id").select("id", F.lit(True).alias("gone"))
    again = docs.groupBy(F.col(id_col).alias("id")).count().where("count > 1 AND id IS NOT NULL").select("id", F.lit(False).alias("gone"))
    listed = X.written(docs.sparkSession, drop.union(again).groupBy("id").agg(F.max("gone").alias("gone")), "listed")
    rows = docs.select(*columns)
    words = listed.selectExpr("shiftright(pmod(xxhash64(id), 16777216L), 6) AS word", "shiftleft(1L, cast(pmod(xxhash64(id), 64L) AS int)) AS mask").groupBy("word").agg(F.expr("bit_or(mask)").alias("mask"))
    marked = rows.join(F.broadcast(words), F.expr(f"shiftright(pmod(xxhash64(`{id_col}`), 16777216L), 6) = word"), "left")
    near = F.expr(f"`{id_col}` IS NOT NULL AND coalesce((shiftright(mask, cast(pmod(xxhash64(`{id_col}`), 64L) AS int)) & 1L) = 1, false)")
    flagged = marked.withColumn("near", near).drop("word", "mask")
    held = flagged.where("near").drop("near").join(listed.withColumnRenamed("id", id_col), id_col, "left").where("gone IS NULL OR NOT gone")
    rest = [c for c in columns if c != id_col]
    single = held.groupBy(id_col).agg(F.min(F.struct(*rest)).alias("row")).select(id_col, *[F.col(f"row.{c}").alias(c) for c in rest])
    return flagged.where("NOT near").select(*columns).unionByName(single.select(*columns))


def op2_neardup(spark, sf_dir):
    docs = X.read(spark, sf_dir, "documents")
    groups = near_groups(docs)
    return docs.select("doc_id").join(groups.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("doc_id", "class_id", "group_id", (F.col("doc_id") == F.col("group_id")).alias("kept"))
