"""Language ID, ranked search and cross-tokenizer alignment against plain brute-force versions, and on awkward rows."""

import bisect
import collections
import hashlib
import math
import re
import unicodedata
import zlib

import numpy as np
import pytest

from crewgrid.llm import alignment, langid, ranked
from crewgrid.llm import textops as X

SF = "/root/testdata/sf0.001"
ODD = [
    (1, None, "en"), (2, "", "en"), (3, "  \n\t ", None), (4, "the small river", "en"), (4, "the small river", "en"), (5, "the small river\n\nbank  and\t more ", "en"),
    (None, "the lonely river", "en"), (6, "le petit fleuve où l'été " * 900, "fr"), (7, "▁ blank \U0001f600 sign", "fr"), (8, "a\n b \n\nc\r\nd <|endoftext|> </s> <0x41> é́ 'll x's 123abc!!", "fr"),
    (9, " leading and trailing ", None), (10, "12 34 !!", "en"), (11, "　漢字 かな x\x1c y\x85z", None), (12, "x" * 5000 + " " * 300 + "\n" * 7 + "y", "en"),
]
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def odd(spark):
    names = ["key", "term", "row", "chunk", "slot", "kind", "score", "groups", "pair", "item"]  # names the operators use inside
    return spark.createDataFrame([(*r, *["clash"] * len(names)) for r in ODD], "doc_id long, text string, lang string, " + ", ".join(f"{n} string" for n in names))


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("1 = 0")


def documents(spark):
    return [(r.doc_id, r.text) for r in X.read(spark, SF, "documents").select("doc_id", "text").collect()]


# alignment


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(alignment.BYTE_BPE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=alignment.PIECE_BPE)
    letters = alignment._byte_letters()
    raw_a = {i: bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t, i in a.get_vocab().items()}
    raw_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in range(b.get_piece_size())]
    return a, b, raw_a, raw_b


def plain_alignment(docs, libraries):
    """Whole texts by the libraries, links by loops, counts by counters."""
    a, b, raw_a, raw_b = libraries
    found, held = [], collections.Counter()
    for text in docs:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        want = (" " + text).encode() if text else b""
        if not b"".join(raw_a[i] for i in ids_a) == want == b"".join(raw_b[i] for i in ids_b):
            ids_a = ids_b = []
        ends_a = np.cumsum([len(raw_a[i]) for i in ids_a]).tolist()
        ends_b = np.cumsum([len(raw_b[i]) for i in ids_b]).tolist()
        cuts = sorted(set(ends_a) & set(ends_b))
        in_a, in_b = ([[] for _ in cuts] for _ in range(2))
        for ids, ends, into in ((ids_a, ends_a, in_a), (ids_b, ends_b, in_b)):
            for i, e in zip(ids, ends):
                into[bisect.bisect_left(cuts, e)].append(i)
        links = collections.Counter((x, y) for p, q in zip(in_a, in_b) for x in p for y in q)
        held.update(links.keys())
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in zip(in_a, in_b))
        found.append((len(ids_a), len(ids_b), len(cuts), links, text))
    best = {}
    for (x, _), n in held.items():
        best[x] = max(best.get(x, 0), n)
    return [
        (na, nb, ng, sum(l.values()), sum(m for p, m in l.items() if held[p] == best[p[0]]), sum(m * held[p] for p, m in l.items()), hashlib.sha256(t.encode()).hexdigest() if na else "")
        for na, nb, ng, l, t in found
    ], held, found


FIELDS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_alignment_equals_brute_force(spark, libraries):
    docs = documents(spark)
    want = dict(zip([i for i, _ in docs], plain_alignment([t for _, t in docs], libraries)[0]))
    got = alignment.op13_alignment(spark, SF).collect()
    assert {r.doc_id: tuple(r[f] for f in FIELDS) for r in got} == want


@pytest.mark.parametrize("chunk", [1, 200, 24 << 20])
def test_alignment_of_awkward_rows(spark, odd, libraries, chunk, monkeypatch):
    """Counts do not depend on how documents are cut into chunks; the pairs table holds documents and links."""
    monkeypatch.setattr(alignment, "CHUNK", chunk)
    want, held, found = plain_alignment([t for _, t, _ in ODD], libraries)
    docs, pairs = alignment.align(odd.repartition(2), keep_groups=True)
    assert collections.Counter((r.doc_id, *(r[f] for f in FIELDS)) for r in docs.collect()) == collections.Counter((i, *w) for (i, _, _), w in zip(ODD, want))
    assert collections.Counter(r.groups for r in docs.collect()) == collections.Counter(f[4] for f in found)
    links = collections.Counter()
    for f in found:
        links.update(f[3])
    assert {(r.a, r.b): (r.docs, r.links) for r in pairs.collect()} == {p: (held[p], links[p]) for p in links}


def test_units_spell_what_whole_texts_spell(libraries):
    a, b, _, _ = libraries
    tok = alignment.Tokenizers(alignment.BYTE_BPE, alignment.PIECE_BPE)
    rng = np.random.default_rng(5)
    signs = list("abtheZé1 9.,'\"  \n\n\t\r;)({}漢 　s") + ["'s", "\r\n", " \n", "ing", "\x1c", "́"]
    for _ in range(800):
        text = "".join(rng.choice(signs, rng.integers(1, 25)))
        units = [u for u in tok.unit.findall(" " + text)]
        assert "".join(units) == " " + text
        assert [i for ids in tok.encode_a(units) for i in ids] == a.encode(" " + text, add_special_tokens=False).ids
        assert [i for ids in tok.ids_b(units) for i in ids] == b.encode(text)
        even = [tok.text[u] for u in tok.numbers([text])[0]]
        assert ";".join(even) == plain_alignment([text], libraries)[2][0][4]


def test_planes_give_slots_back():
    """Sorted lists and bits, and links of many sizes."""
    chunk = alignment.Chunk()
    chunk.rows = [None] * 4000
    rng = np.random.default_rng(3)
    pair = np.repeat(np.arange(50), rng.integers(1, 3900, 50))
    slot = np.concatenate([np.sort(rng.permutation(4000)[:n]) for n in np.bincount(pair)])
    first, _, n, offs, bits = chunk._plane(pair, slot, 0)
    row, back = alignment.slots_of(n, offs, bits)
    assert sorted(zip(first[row].tolist(), back.tolist())) == sorted(zip(pair.tolist(), slot.tolist()))
    assert (np.diff(offs) < 2 * n).any() and (np.diff(offs) == 2 * n).any()


def test_alignment_of_nothing(none):
    docs, pairs = alignment.align(none)
    assert docs.count() == 0 and pairs.count() == 0 and docs.columns[:1] == ["doc_id"]


# ranked search


def plain_search(docs, items, k=10):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    bags = [(i, collections.Counter(w.translate(lower) for w in WORD.findall(t or ""))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = collections.Counter(w for _, b in bags for w in b)
    out = []
    for item, text in items:
        want = collections.Counter(w.translate(lower) for w in WORD.findall(text or ""))
        rows = []
        for i, b in bags:
            m = 100 - 75 + (75 * sum(b.values()) * n_docs) // total
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * b[w]) // (1000 * b[w] + 8 * m)) for w, q in want.items() if w in b)
            if s > 0:
                rows.append((-s, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(rows)[:k], 1)]
    return out


@pytest.mark.parametrize("slice_bytes", [1 << 22, 600])
def test_search_equals_brute_force(spark, slice_bytes):
    docs, items = documents(spark), [(r.item_id, r.text) for r in X.read(spark, SF, "benchmark").collect()]
    got = ranked.search(X.read(spark, SF, "documents"), X.read(spark, SF, "benchmark"), slice_bytes=slice_bytes).collect()
    assert sorted((r.item_id, r["rank"], r.doc_id, r.score) for r in got) == sorted(plain_search(docs, items))


def test_search_of_awkward_rows(spark, odd, none):
    items = [("a", "small RIVER river bank"), ("a", "small RIVER river bank"), ("b", None), ("c", ""), ("d", "été où le"), ("e", "nothingness"), (None, "the lonely river"), ("f", "12 34"), ("a", "漢字 sign")]
    table = spark.createDataFrame([(*i, "clash") for i in items], "item_id string, text string, row string")
    got = ranked.search(odd, table).collect()
    distinct = list(dict.fromkeys(items))
    assert collections.Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in got) == collections.Counter(plain_search([(i, t) for i, t, _ in ODD], distinct))
    assert ranked.search(none, table).count() == 0 and ranked.search(odd, table.where("1 = 0")).count() == 0


def test_search_heaps_keep_ties_by_id(spark):
    """Many equal documents over several blocks and tasks: the smallest ids stay."""
    docs = spark.createDataFrame([(int(i), "same words here" if i % 3 else "other") for i in np.random.default_rng(1).permutation(3000)], "doc_id long, text string").repartition(5)
    items = spark.createDataFrame([(1, "words")], "item_id long, text string")
    got = ranked.search(docs, items).orderBy("rank").collect()
    assert [r.doc_id for r in got] == [i for i in range(3000) if i % 3][:10] and len({r.score for r in got}) == 1


# language ID


def plain_words(text):
    out, word = [], ""
    for c in (text or "").lower() + " ":
        if unicodedata.category(c)[0] in "LM":
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def plain_language(rows, text, langs):
    """(language, share) by dictionaries over all rows (language, text)."""
    words, grams = {v: collections.Counter() for v in langs}, {n: {v: collections.Counter() for v in langs} for n in langid.ORDERS}
    for v, t in rows:
        for w in plain_words(t):
            words[v][w] += 1
            for n in langid.ORDERS:
                for i in range(len(w) + 3 - n):
                    grams[n][v][f" {w} "[i:i + n]] += 1

    def scores(table, key):
        total = {v: sum(table[v].values()) for v in langs}
        penalty = -1 - math.log10(max(1, *total.values()))
        return [math.log10(table[v][key] / total[v]) if table[v][key] else penalty for v in langs] if any(table[v][key] for v in langs) else None

    found = []
    for w in plain_words(text):
        each = scores(words, w)
        for n in langid.ORDERS:
            if each is None:
                parts = [s for s in (scores(grams[n], f" {w} "[i:i + n]) for i in range(len(w) + 3 - n)) if s]
                each = np.mean(parts, axis=0) if parts else None
        found.append(each if each is not None else [0.0] * len(langs))
    if not any(unicodedata.category(c)[0] == "L" for c in (text or "").lower()):
        return "und", 0.0
    mean = np.mean(found, axis=0)
    share = np.exp((mean - mean.max()) * math.log(10) * min(len(found), langid.EVIDENCE))
    return langs[int(mean.argmax())], float(1 / share.sum())


def test_language_equals_brute_force(spark):
    rows = [(r.lang, r.text, r.doc_id) for r in X.read(spark, SF, "documents").limit(60).select("lang", "text", "doc_id").collect()]
    rows = [(v, (t or "")[:400], i) for v, t, i in rows]
    asked = [(1, "the river where l'été"), (2, "zzzxq wörtlich unseenword"), (3, None), (4, "12 !!"), (5, "漢字"), *[(100 + i, t) for _, t, i in rows[:10]]]
    docs = spark.createDataFrame([(i, t, v) for v, t, i in rows], "doc_id long, text string, lang string")
    model = langid.train(docs)
    got = langid.predict(spark.createDataFrame(asked, "doc_id long, text string"), model).collect()
    langs = sorted({v for v, _, _ in rows})
    for r, (_, text) in zip(got, asked):
        lang, share = plain_language([(v, t) for v, t, _ in rows], text, langs)
        assert (r.lang_pred, r.n_words) == (lang, len(plain_words(text))) and r.score == pytest.approx(share, rel=1e-3)


def test_language_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    known = {r.doc_id: r.lang for r in X.read(spark, sf, "documents").collect()}
    rows = langid.op11_language(spark, sf).collect()
    assert len(rows) == len(known) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    judged = [r for r in rows if r.held_out and r.lang_pred != "und"]
    assert np.mean([r.lang_pred == known[r.doc_id] for r in judged]) >= 0.95


def test_language_of_awkward_rows(odd, none):
    model = langid.train(odd)
    got = langid.predict(odd, model).collect()
    assert len(got) == len(ODD)
    by_text = {t: r for (_, t, _), r in zip(ODD, got)}
    for text in (None, "", "  \n\t ", "12 34 !!"):
        assert (by_text[text].lang_pred, by_text[text].score) == ("und", 0.0)
    assert by_text["the small river"].lang_pred == "en" and by_text[ODD[7][1]].lang_pred == "fr"
    empty = langid.train(none)
    assert empty["langs"] == [] and {r.lang_pred for r in langid.predict(odd, empty).collect()} == {"und"}
    assert langid.predict(none, model).count() == 0


def test_language_sample_is_bounded(spark):
    word = lambda i: "".join(chr(97 + int(c)) for c in str(i))
    docs = spark.createDataFrame([(i, f"wort{word(i)}" if i % 10 else f"mot{word(i)}", "de" if i % 10 else "fr") for i in range(4000)], "doc_id long, text string, lang string")
    got = dict(langid._sample(docs, "doc_id", "text", "lang", langid.Fit(rows=300)).groupBy("lang").count().collect())
    assert 200 < got["de"] < 400 and 200 < got["fr"] <= 400
    model = langid.train(docs, fit=langid.Fit(rows=300, words=50, grams=40))
    assert len(model["tables"][0][0]) == 50 and len(model["tables"][5][0]) == 40
