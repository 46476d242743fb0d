"""Ranked search, language identification and vector codes against plain Python, with awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from fathom.llm import codes, language, search
from fathom.llm.queries import QUERIES
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranked(docs, items, k):
    """(item, rank, doc, score) of lists of (id, text), by the rule and one pair after the other."""
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    many, length, df = len(bags), sum(n for _, _, n in bags), Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        asked, scored = Counter(terms(text)), []
        for i, b, n in bags:
            m = 25 + 75 * n * many // length
            score = sum(q * math.floor(1000 * math.log((2 * many + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t, q in asked.items() if b[t])
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r, None if x[1] else x[2], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)]
    return out


def by_text(rows):
    return sorted(rows, key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("s", [search.Settings(), search.Settings(top_k=3, pairs=40, matches=50)], ids=["one block", "many blocks"])
def test_search_equals_plain_ranking(spark, s):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)] + ["ÉTÉ", "Été", "naïve", "日本", "x-y", "a_b", "İ", "1st"]
    text = lambda n: " ".join(rng.choices(vocabulary, [1 / (1 + i) for i in range(len(vocabulary))], k=n))
    docs = [(i, text(rng.randint(1, 40))) for i in range(150)]
    docs += [(200 + i, docs[3][1]) for i in range(30)] + [(3, docs[3][1]), (None, docs[4][1]), (None, docs[4][1])]  # ties, repeated rows, null ids
    docs += [(300, None), (301, ""), (302, " .,- \n"), (303, text(60_000)), (304, "W1.W2,w3\tW1\x0bw2\x00w4")]
    items = [(f"i{i}", text(rng.randint(1, 20))) for i in range(12)] + [("none", None), ("empty", ""), ("strange", "zzz qqq"), (None, "w1 w1 w2"), ("i0", "w5 été"), ("long", text(5000))]
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, item string, score int").repartition(5)
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id string, text string, row int")
    got = search.rank(table, asked, s)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert by_text(map(tuple, got.collect())) == by_text(ranked(docs, items, s.top_k))


def test_search_of_nothing(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([("i", "a")], "item_id string, text string")
    assert search.rank(docs.limit(0), items).count() == 0 and search.rank(docs, items.limit(0)).count() == 0
    assert [tuple(r) for r in search.rank(docs, items).collect()] == ranked([(1, "a b")], [("i", "a")], 10)


def test_radix_order():
    rng = np.random.default_rng(1)
    for most in (1, 70_000, 1 << 40):
        keys = rng.integers(0, most, 5000)
        assert (keys[search.radix_order(keys, most)] == np.sort(keys)).all()


def test_search_query_equals_plain_ranking(spark):
    docs = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    got = QUERIES["op11_ranked_search"](spark, SF).collect()
    assert by_text((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got) == by_text(ranked(docs, items, 10))


def plain_grams(text, n):
    words = re.findall(r"[^\W\d_]+", "".join(c if c.isalpha() else " " for c in (text or "").lower()))
    return [f" {w} "[i : i + n] for w in words for i in range(len(w) + 3 - n)]


def test_grams_are_those_of_words():
    texts = ["Ab a\n\nthe", "", None, "!!1", "x", "thé THE", "naïve 日本語, İx", " a-b_c9d ", "\n"]
    for n in (2, 3, 4):
        at, h, has = language.grams(texts, n)
        assert [Counter(at.tolist()).get(i, 0) for i in range(len(texts))] == [len(plain_grams(t, n)) for t in texts]
        named = {}
        for text, value in zip([g for t in texts for g in plain_grams(t, n)], h.tolist(), strict=True):
            assert named.setdefault(text, value) == value
        assert len(set(named.values())) == len(named)
    assert has.tolist() == [any(c.isalpha() for c in t or "") for t in texts]


WORDS = {"aa": ["babo", "dodi", "gagu", "bodo", "dagi"], "bb": ["xyxo", "zuzu", "vyvo", "xuvy", "zyxo"], "cc": ["бабо", "доди", "гагу", "бодо", "даги"], "dd": ["babo", "qoqi", "gagu", "qaqo", "qiqa"]}


def sentences(seed, rows):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choices(WORDS[lang], k=rng.randint(4, 30))), lang) for i, lang in enumerate(rng.choices(sorted(WORDS), [6, 3, 1, 2], k=rows))]


def test_languages_equal_sets_of_grams(spark):
    """The filters say what exact sets of n-grams say, but for rare false positives."""
    rows = sentences(1, 400)
    learned = spark.createDataFrame(rows + [(900, None, "aa"), (901, "babo", None), (None, "babo", "bb"), *[rows[0]] * 3], "doc_id long, text string, lang string")
    s = language.Settings(share=0.4)
    f = language.learn(learned, s)
    assert f.languages == ("aa", "bb", "cc", "dd") and f.usual == 0 and (f.fill < 0.5).all()
    counts = {lang: Counter(g for _, t, own in rows if own == lang for g in plain_grams(t, 3)) for lang in WORDS}
    rate = {lang: {g: n / sum(c.values()) for g, n in c.items()} for lang, c in counts.items()}
    held = {lang: {g for g, n in counts[lang].items() if n >= s.least and rate[lang][g] >= s.share * max(r.get(g, 0) for r in rate.values())} for lang in WORDS}
    tried = [t for _, t, _ in sentences(2, 200)]
    found, _ = language.shares(tried, f)
    wanted = np.array([[np.mean([g in held[lang] for g in plain_grams(t, 3)]) for lang in f.languages] for t in tried])
    assert np.abs(found - wanted).max() < 0.02
    assert np.mean([f.languages[i] == own for i, (_, _, own) in zip(found.argmax(axis=1), sentences(2, 200))]) > 0.97


def test_languages_of_awkward_rows(spark):
    f = language.learn(spark.createDataFrame(sentences(3, 300), "doc_id long, text string, lang string"))
    rows = [(1, None), (2, ""), (3, "12 !?"), (4, "ωψξ"), (5, "babo dodi gagu " * 20_000), (6, "babo dodi"), (6, "babo dodi"), (None, "бабо")]
    docs = spark.createDataFrame([(i, t, "own", 5, 6) for i, t in rows], "doc_id long, text string, lang_pred string, `a.b` int, text_ int")
    got = language.identify(docs, f).collect()
    assert [(r["doc_id"], r["text"], r["a.b"], r["text_"]) for r in got] == [(i, t, 5, 6) for i, t in rows]
    assert [r["lang_pred"] for r in got] == ["und", "und", "und", "aa", "aa", "aa", "aa", "cc"]
    assert [r["score"] for r in got][:4] == [0.0] * 4 and all(0.9 < r["score"] <= 1 for r in got[4:])
    nothing = language.learn(docs.limit(0).withColumn("lang", F.lit("x")))
    assert nothing.languages == () and {r["lang_pred"] for r in language.identify(docs, nothing).collect()} == {"und"}
    assert language.identify(docs.limit(0), f).count() == 0


def test_many_languages_share_places(spark):
    rows = [(i * 40 + j, " ".join(chr(0x4E00 + 50 * i + (j + k) % 50) * 2 for k in range(10)), f"l{i:02}") for i in range(20) for j in range(6)]
    f = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), language.Settings(least=1))
    found, _ = language.shares([t for _, t, _ in rows], f)
    assert f.bits.shape[1] == 3 and [f.languages[i] for i in found.argmax(axis=1)] == [lang for _, _, lang in rows]


def test_language_query_on_held_out_rows(spark):
    lang = {r["doc_id"]: (r["lang"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    got = QUERIES["op12_language_id"](spark, SF).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(list(lang))
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in lang[r["doc_id"]][1] or ""))
    held = [r["lang_pred"] == lang[r["doc_id"]][0] for r in got if r["held_out"]]
    assert sum(held) >= 0.95 * len(held)


def coded(rows, parts, entries, rounds, scale):
    """id: (code, error), and the codebooks' digest, in Python's integers."""
    whole = sorted(((i is None, i or 0, v) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)))
    size = len(whole[0][2])
    whole = [(None if none else i, [math.floor(scale * int(x)) if abs(x) >= 2**52 else math.floor(scale * x) for x in v]) for none, i, v in whole if len(v) == size]
    width = -(-size // parts)
    cut = [(i, [(v + [0] * parts)[p * width : (p + 1) * width] for p in range(parts)]) for i, v in whole]
    books = [[v[p] for _, v in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda p, x: min((far(x, c), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        groups = [[[] for _ in book] for book in books]
        for _, v in cut:
            for p in range(parts):
                groups[p][near(p, v[p])[1]].append(v[p])
        books = [[[sum(c) // len(g) for c in zip(*g)] if g else old for g, old in zip(gs, book)] for gs, book in zip(groups, books)]
    out = []
    for i, v in cut:
        found = [near(p, v[p]) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found)))
    return out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


@pytest.mark.parametrize("size,big", [(8, 1.0), (6, 1.0), (8, 1e6), (8, 1e300)], ids=["plain", "filled up", "large", "huge"])
def test_codes_equal_plain_rounds(spark, size, big):
    rng = np.random.default_rng(5)
    rows = [(int(i), (rng.standard_normal(size) * (big if i % 7 == 0 else 1.0)).tolist()) for i in rng.permutation(90)]
    rows += [(300, rows[0][1]), (300, rows[0][1]), (4, rows[1][1]), (None, rows[2][1])]  # repeated rows and ids, a null id
    odd = [(200, None), (201, []), (202, [1.0] * (size - 1) + [None]), (203, [math.nan] * size), (204, [math.inf] + [0.0] * (size - 1)), (205, [1.0] * (size + 2))]
    label = lambda i: None if i is None or i % 5 == 0 else i % 3
    table = spark.createDataFrame([(i, v, label(i), 1) for i, v in rows + odd], "vec_id long, embedding array<double>, label int, error int").repartition(4)
    s = codes.Settings(entries=12, rounds=3, block_rows=16, chunk=7)
    got = codes.compress(table, s).collect()
    wanted, name = coded(rows + odd, s.parts, s.entries, s.rounds, s.scale)
    fits = lambda e: e if e < 1 << 63 else None
    assert by_text((r["vec_id"], r["code"], r["error"]) for r in got) == by_text((i, c, fits(e)) for i, c, e in wanted)
    assert {r["codebooks_sha256"] for r in got} == {name}
    total = Counter()
    for i, _, e in wanted:
        total[label(i)] += e
    assert all(r["label"] == label(r["vec_id"]) and r["label_error"] == fits(total[label(r["vec_id"])]) for r in got)


def test_codes_of_few_and_none(spark):
    table = spark.createDataFrame([(7, [1.0, 2.0, 3.0, 4.0], "a")], "vec_id long, embedding array<float>, label string")
    assert [(r["code"], r["error"], r["label_error"]) for r in codes.compress(table).collect()] == [("00000000", 0, 0)]
    assert codes.compress(table.limit(0)).count() == 0


def test_codes_query_equals_plain_rounds(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in pq.read_table(f"{SF}/embeddings.parquet").to_pylist()]
    got = QUERIES["op13_vector_codes"](spark, SF).collect()
    whole = np.array([v for _, v in sorted(rows)], dtype=np.float64)
    x = np.floor(1024 * whole).astype(np.int64)
    books = [x[:256, 16 * p : 16 * p + 16] for p in range(4)]
    near = lambda p: ((x[:, None, 16 * p : 16 * p + 16] - books[p][None]) ** 2).sum(axis=2)
    for _ in range(4):
        at = [near(p).argmin(axis=1) for p in range(4)]
        books = [np.array([x[at[p] == e, 16 * p : 16 * p + 16].sum(axis=0) // (at[p] == e).sum() if (at[p] == e).any() else books[p][e] for e in range(256)]) for p in range(4)]
    apart = [near(p) for p in range(4)]
    wanted = {i: ("".join(f"{apart[p][j].argmin():02x}" for p in range(4)), int(sum(apart[p][j].min() for p in range(4)))) for j, (i, _) in enumerate(sorted(rows))}
    assert {r["vec_id"]: (r["code"], r["error"]) for r in got} == wanted
