"""The queries of the operators on the smallest tables, whole, against plain Python: the columns that they derive from
what the operators return."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from fathom.llm.queries import QUERIES
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return {r["doc_id"]: r["text"] for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}


def run(spark, name, key="doc_id"):
    rows = QUERIES[name](spark, SF).collect()
    return rows if key is None else {r[key]: r for r in rows}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def ids_of(texts, name, end):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    return {k: [*tokenizer.encode(t or "", add_special_tokens=False).ids, end] for k, t in texts.items()}


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def test_decontamination_digests(spark, docs):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
    windows = defaultdict(set)
    for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist():
        ws = words(r["text"])
        for i in range(max(1, len(ws) - 9) if ws else 0):
            windows[tuple(ws[i : i + 10])].add(str(r["item_id"]))
    sizes, got = {len(w) for w in windows}, run(spark, "op1_decontamination")
    assert set(got) == set(docs)
    for k, text in docs.items():
        ws, hit, items = words(text), set(), set()
        for n in sizes:
            for i in range(len(ws) - n + 1):
                found = windows.get(tuple(ws[i : i + n]))
                if found:
                    hit |= set(range(i, i + n))
                    items |= found
        r = got[k]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (len(ws), len(hit), len(items), bool(hit)), k
        assert r["items_sha256"] == sha(",".join(sorted(items)))


def test_packing_digests(spark, docs):
    ids, pieces, sequences = ids_of(docs, "byte_bpe_50k.json", 0), defaultdict(list), defaultdict(list)
    for r in run(spark, "op3_packing", None):
        assert r["ids_crc32"] == crc(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]) and r["doc_tokens"] == len(ids[r["doc_id"]])
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(docs)
    for k, found in pieces.items():
        assert [s for s, _ in sorted(found)] == [0, *np.cumsum([n for _, n in sorted(found)])[:-1]] and sum(n for _, n in found) == len(ids[k])
    for found in sequences.values():
        assert [s for s, _ in sorted(found)] == [0, *np.cumsum([n for _, n in sorted(found)])[:-1]] and sum(n for _, n in found) <= 1024


def test_sharding_columns(spark, docs):
    rows = run(spark, "op4_sharding", None)
    assert Counter(r["doc_id"] for r in rows) == Counter(list(docs))
    slots = defaultdict(list)
    for r in rows:
        text = docs[r["doc_id"]]
        assert r["size"] == 8 + len((text or "").encode()) and r["law"] == "key" and r["grown_shard"] in (r["shard"], 24)
        assert text is None or r["text_crc32"] == zlib.crc32(text.encode())
        slots[r["shard"]].append(r["slot"])
    assert set(slots) <= set(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_jaccard_components(spark, docs):
    sets = {}
    for k, text in docs.items():
        ws = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
        sets[k] = {tuple(ws[i : i + 4]) for i in range(max(1, len(ws) - 3))} if ws else set()
    least = {k: k for k in docs}
    links = [(a, b) for a in docs for b in docs if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    for _ in docs:
        before = dict(least)
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
        if before == least:
            break
    assert {k: (r["n_shingles"], r["component_id"]) for k, r in run(spark, "op6_ngram_jaccard").items()} == {k: (len(sets[k]), least[k]) for k in docs}


def test_toxicity_columns(spark, docs):
    got = run(spark, "op8_toxicity")
    assert set(got) == set(docs)
    for k, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)


def test_token_file_digests(spark, docs):
    ids, start, got = ids_of(docs, "word_bpe_49k.json", 2), 0, run(spark, "op9_token_files")
    assert set(got) == set(docs)
    for k in sorted(docs):
        r = got[k]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids[k]), crc(ids[k]))
        start += len(ids[k])


def test_secret_scan_digests(spark, docs):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    got = run(spark, "op10_secret_scan")
    assert set(got) == set(docs)
    for k, text in docs.items():
        text = text or ""
        spans = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(text) if len(m[2]) >= 6]
        spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        base = [f"{kind}:{s}:{e}" for s, _, e, kind in sorted(spans)]
        r = got[k]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(x[3] == kind for x in spans) for kind in ("assign", "access", "hex"))
        assert r["base_sha256"] == sha(",".join(base)) and set(base) <= set(r["spans"].split(",")) | {""}


def test_license_query_equals_its_sql_on_licences(spark, tmp_path):
    """On a table whose documents are licences in many layouts, and almost licences."""
    import duckdb
    from fathom.llm import licenses
    from fathom.llm.queries import ORACLE_SQL

    mit, isc, texts = licenses.KNOWN["MIT"], licenses.KNOWN["ISC"], []
    full = dict(licenses.full_texts())
    wrap = lambda t, n: "\n".join(" ".join(t.split()[i : i + n]) for i in range(0, len(t.split()), n))
    texts += [mit, f"MIT License\n\nCopyright (c) 2020 Some Body\n\n{mit}", f"The MIT License (MIT)\n\nCopyright Some Body\n\n{wrap(mit, 9)}", wrap(isc, 5), mit + " And more.", "licence licence licence", "license license license"]
    texts += [f"{name} notes\n\n{body}" for name, body in full.items()] + list(full.values()) + [wrap(b, 11) for b in full.values()]
    texts += ["Released under the MIT Licence.\nother", "a\nLicensed under CC BY-NC 4.0.\nReleased under the MIT License.", None, "", "copyright notice and this permission", "x " * 50_000 + "license"]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)] + [(0, mit, "en", "s"), (None, mit, "en", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, license string, digest string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(str, (tuple(r) for r in QUERIES["op2_license_scan"](spark, str(tmp_path)).select("doc_id", "digest", "license", "notices").collect())))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    con.execute(f"CREATE VIEW theirs AS {ORACLE_SQL['op2_license_scan']}")
    assert got == sorted(map(str, con.execute("SELECT doc_id, digest, license, notices FROM theirs").fetchall()))
    by_id = {r["doc_id"]: r for r in QUERIES["op2_license_scan"](spark, str(tmp_path)).collect()}
    assert [by_id[i]["license"] for i in range(7)] == ["MIT", "MIT", "MIT", "ISC", None, None, None] and by_id[5]["digest"] == by_id[6]["digest"]
    assert {by_id[i]["license"] for i in range(7 + len(full), 7 + 2 * len(full))} >= set(full) - {None}
    given = licenses.known_digests(spark).unionByName(licenses.known_digests(spark))
    joined = licenses.scan(spark.read.parquet(str(tmp_path / "documents.parquet")), known=given)
    listed = {r["digest"] for r in given.collect()}
    plain = {i: r["license"] if r["digest"] in listed else None for i, r in by_id.items()}
    assert {r["doc_id"]: (r["license"], ",".join(r["notices"])) for r in joined.collect()} == {i: (plain[i], by_id[i]["notices"]) for i in by_id} and joined.count() == len(rows)
