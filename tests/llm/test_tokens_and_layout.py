"""Token files, packing and sharding against plain Python on small tables with awkward rows."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from fathom.llm import packing, sharding, token_files
from fathom.llm.shared import new_path
from fathom.llm.tokens import encoder
from tokenizers import Tokenizer

AWKWARD = [
    "", None, " ", "one", " lead and trail ", "two  spaces\tand\ttabs", "line\n\nbreak \n x", "it's <|endoftext|> we'll", "ß É é   x　y  z", "a" * 5000,
    "word " * 3000, "日本語 テキスト", "x\x1c y \x85 z", "same text here", "same text here", "same text here", "ΑΣ ΑΣ. 12 345", "end ", "\n", "\r\n a",
    "Well, no. It's ,. odd., x , y. É, è. _, a. ...", ", x", ". y", "A\u0300, B. İ, ı. ẞ", "a  , b", "\u00a0 x \u00a0", "x\x0b y",
    "a <|endoftext|> b", "<|STARTOFTEXT|> A <|startoftext|>x y", "<|endoftext|>", "long " * 40_000,
]


def table(spark, texts=AWKWARD):
    rows = [(i, t, "src", t) for i, t in enumerate(texts)] + [(3, "one", "again", "ids"), (None, "no id", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, ids string")


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_give_the_ids_of_whole_texts(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    ids, bounds = encoder(name).encode(pa.array(AWKWARD))
    for text, a, b in zip(AWKWARD, bounds[:-1], bounds[1:]):
        assert ids[a:b].tolist() == t.encode(text or "", add_special_tokens=False).ids, repr(text)


def whole(name, text, end):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return t.encode(text or "", add_special_tokens=False).ids + [end]


def test_token_files_round_trip(spark):
    path = new_path(spark, "t")
    token_files.write_token_files(table(spark), path)
    rows = sorted(token_files.read_token_files(spark, path).collect(), key=lambda r: r["start"])
    assert len(rows) == len(AWKWARD) + 2 and rows[0]["doc_id"] is None
    ids = [r["doc_id"] for r in rows[1:]]
    assert ids == sorted(ids)
    start, texts = 0, dict(enumerate(AWKWARD)) | {None: "no id"}
    for r in rows:
        assert (r["start"], r["n_tokens"]) == (start, len(r["ids"]))
        assert r["ids"] == whole("word_bpe_49k.json", texts[r["doc_id"]], 2)
        start += r["n_tokens"]
    digests = {(r["start"], r["ids_crc32"]) for r in token_files.token_digests(token_files.read_token_files(spark, path)).collect()}
    assert digests == {(r["start"], zlib.crc32(np.array(r["ids"], "<u4").tobytes())) for r in rows}


def test_packing_holds_each_id_once_without_gaps(spark):
    pieces = packing.pack(table(spark), length=64).collect()
    texts = Counter((i, t) for i, t in [*enumerate(AWKWARD), (3, "one"), (None, "no id")])
    by_place = sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"]))
    place = 0
    for r in by_place:
        assert r["sequence_id"] * 64 + r["offset"] == place and 0 < r["length"] <= 64
        place += r["length"]
    assert place == sum(len(whole("byte_bpe_50k.json", t, 0)) * n for (_, t), n in texts.items())
    joined = defaultdict(list)
    for r in by_place:
        joined[r["doc_id"]].append((r["start"], np.frombuffer(bytes(r["ids"]), "<u4").tolist()))
    for i, t in enumerate(AWKWARD):
        if i != 3:
            assert [x for _, ids in sorted(joined[i]) for x in ids] == whole("byte_bpe_50k.json", t, 0)


def test_hilbert_curve_steps_to_neighbours():
    side = np.arange(8)
    cells = np.stack(np.meshgrid(side, side, side), axis=-1).reshape(-1, 3)
    order = cells[np.argsort(packing.hilbert_key(cells, bits=3))]
    assert len(set(packing.hilbert_key(cells, bits=3))) == 512
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def test_sharding_slots_and_movement(spark):
    rows = [(i % 900, f"text {i % 7}") for i in range(1000)] + [(None, None)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.assign(docs, sharding.tree_of(24), sharding.tree_of(25)).collect()
    assert len(got) == 1003
    by_shard, of = defaultdict(list), defaultdict(set)
    for r in got:
        by_shard[r["shard"]].append(r["slot"])
        of[r["doc_id"]].add((r["shard"], r["grown_shard"]))
        assert r["grown_shard"] in (r["shard"], 24)
    assert all(len(x) == 1 for x in of.values())
    assert all(sorted(x) == list(range(len(x))) for x in by_shard.values()) and set(by_shard) == set(range(24))
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    moved = sum(r["grown_shard"] == 24 for r in got)
    assert abs(moved - 1003 / 25) < 5 * math.sqrt(1003 / 25)


def test_sharding_weights_confine_movement(spark):
    old = {"a": {"k": {0: 1.0, 1: 1.0}}, "b": {"k": {2: 1.0, 3: 1.0}, "l": {4: 2.0}}}
    new = {"a": {"k": {0: 1.0, 1: 1.0}}, "b": {"k": {2: 1.0, 3: 3.0}, "l": {4: 2.0}}}
    keys = spark.range(4000)
    got = keys.select(sharding.shard_of(keys.id, old).alias("x"), sharding.shard_of(keys.id, new).alias("y")).collect()
    counts = Counter(r["x"] for r in got)
    assert abs(counts[4] - 4000 * 2 / 6) < 200 and abs(counts[0] - 4000 / 6) < 150
    for r in got:
        assert r["x"] == r["y"] or r["y"] in (2, 3, 4)  # into the region whose weight grew, or within it
        assert not (r["x"] == 3 and r["y"] != 3)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    path = new_path(spark, "t")
    token_files.write_token_files(empty, path)
    assert token_files.read_token_files(spark, path).count() == 0
    assert packing.pack(empty).count() == 0
    assert sharding.assign(empty, sharding.tree_of(24)).count() == 0
