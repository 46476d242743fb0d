"""Canonical JSON and fingerprints against Python's json, JSON in free text, records and rules."""

import hashlib
import json
import math
import random
import re

import pytest
from fathom.functions import canonical
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBERS = [0.0, -0.0, 1.0, -1.5, 0.1, 123456.789, 1e7, 1.5e7, 123456789.125, 1e15, 1e16, 1.5e16, 1e22, 1e-3, 1e-4, 1.5e-4, 1e-5, 2.5e-7, 1e300, 5e-324, 1.7976931348623157e308, 0.30000000000000004, 1 / 3, 1e21 + 1, 9007199254740993.0, -1e-4, -2e7, -3e-9]
TEXTS = ["", "plain", 'a "quoted" \\ text', "line\nfeed\ttab\r\b\f", "\x00\x01\x1f\x7f", "é日本😀", "/slash</script>", " "]


def _kind(v):
    if isinstance(v, dict):
        return T.StructType([T.StructField(k, _kind(x)) for k, x in v.items()])
    if isinstance(v, list):
        return T.ArrayType(_kind(v[0]) if v else T.StringType())
    return {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType(), type(None): T.StringType()}[type(v)]


def test_canonical_json_is_what_python_writes(spark):
    values = [*NUMBERS, *[random.Random(i).uniform(-1, 1) * 10 ** random.Random(i).randint(-20, 20) for i in range(200)]]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = {r["i"]: r["s"] for r in rows.select("i", canonical.canonical_json(F.col("v"), T.DoubleType()).alias("s")).collect()}
    assert {i: json.dumps(v) for i, v in enumerate(values)} == got
    odd = spark.createDataFrame([(math.nan,), (math.inf,), (-math.inf,)], "v double").select(canonical.canonical_json(F.col("v"), T.DoubleType()))
    assert [r[0] for r in odd.collect()] == ["NaN", "Infinity", "-Infinity"]
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    assert [r[0] for r in rows.select(canonical.canonical_json(F.col("t"), T.StringType())).collect()] == [json.dumps(t, ensure_ascii=False) for t in TEXTS]


def test_nested_keys_are_sorted_at_every_level(spark):
    payload = {"b": {"z": 1, "a": [{"y": "é", "x": None}, {"y": "2", "x": "3"}]}, "C": True, "é": 1.5e7, "a": [], "n": None, "l": [1.0, 2.5]}
    kind = _kind(payload)
    rows = spark.createDataFrame([(payload,)], T.StructType([T.StructField("p", kind)]))
    for compact, separators in ((True, (",", ":")), (False, None)):
        (r,) = rows.select(canonical.canonical_json(F.col("p"), kind, compact).alias("s")).collect()
        assert r["s"] == json.dumps(payload, ensure_ascii=False, sort_keys=True, separators=separators)
    flat = rows.select("p.*")
    (h,) = flat.select(canonical.fingerprint(flat, *payload)).first()
    assert h == canonical.fingerprint_of(payload) == hashlib.sha256(json.dumps(payload, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    maps = spark.createDataFrame([({"b": [1], "a": [2, None], "": []},), ({},), (None,)], "m map<string,array<int>>")
    assert [r[0] for r in maps.select(canonical.canonical_json(F.col("m"), maps.schema["m"].dataType)).collect()] == ['{"":[],"a":[2,null],"b":[1]}', "{}", "null"]


def test_json_is_found_in_text(spark):
    texts = ['{"a": 1}', ' ```json\n{"a": [1, 2]}\n``` ', "```\n[1]\n```", 'so: {"a": {"b": "}"}} end', "list [1, {\"x\": 2}] and more", "no json", "{broken", None, "", "12", '```JSON {"k": 0}```', "a [1] b {2}"]

    def plain(text):
        text = (text or "").strip()
        if text.startswith("```"):
            text = re.sub(r"```$", "", re.sub(r"^```(?:json)?", "", text, flags=re.I).strip()).strip()
        try:
            json.loads(text)
            return text
        except ValueError:
            found = re.search(r"(\{.*\}|\[.*\])", text, re.S)
            try:
                return found and (json.loads(found[1]), found[1])[1]
            except ValueError:
                return None

    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    assert [r["j"] for r in rows.select("i", canonical.json_in(F.col("t")).alias("j")).orderBy("i").collect()] == [plain(t) for t in texts]
