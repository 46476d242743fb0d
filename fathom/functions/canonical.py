"""Canonical JSON of columns of any type, for fingerprints, and JSON found in free text.

Keys are sorted at every level, of structs by name and of maps by value; the text is what Python's ``json`` writes with
sorted keys and without escaping other than what JSON asks for, so a fingerprint made here and one made of the same values
in plain Python agree."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters that JSON escapes by a letter; other controls go by number.
_SHORT = {'"': '\\"', "\\": "\\\\", "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}
_CONTROLS = {chr(i): f"\\u{i:04x}" for i in range(32)}


def _string(c: Column) -> Column:
    """A JSON string. Texts without anything to escape, nearly all, take one test."""
    escaped = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for char, said in ({k: v for k, v in _SHORT.items() if k != "\\"} | {k: v for k, v in _CONTROLS.items() if k not in _SHORT}).items():
        escaped = F.replace(escaped, F.lit(char), F.lit(said))
    return F.concat(F.lit('"'), F.when(c.rlike(r'["\\\x00-\x1f]'), escaped).otherwise(c), F.lit('"'))


def _double(c: Column) -> Column:
    """A number as Python writes it: the fewest digits that make the same number again, plain from 1e-4 to 1e16, else with
    an exponent of two digits or more."""
    said = [F.format_string(f"%.{n}e", c) for n in (0, 14, 15, 16)]
    shortest = F.coalesce(*[F.when(x.cast("double") == c, x) for x in said[:3]], said[3])
    digits = F.replace(F.regexp_extract(shortest, r"^-?([0-9.]+)", 1), F.lit("."), F.lit(""))
    bare = F.regexp_replace(digits, "(?<=[0-9])0+$", "")
    exponent = F.regexp_extract(shortest, r"e([+-][0-9]+)$", 1).try_cast("int")
    sign = F.when(c < 0, "-").otherwise("")
    whole = F.rpad(bare, 40, "0")
    large = F.concat(sign, F.substring(whole, F.lit(1), exponent + 1), F.lit("."), F.when(F.length(bare) > exponent + 1, F.substring(bare, exponent + 2, F.length(bare))).otherwise("0"))
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), bare)
    power = F.concat(F.when(exponent < 0, "-").otherwise("+"), F.lpad(F.abs(exponent).cast("string"), F.greatest(F.lit(2), F.length(F.abs(exponent).cast("string"))), F.lit("0")))
    odd = F.concat(sign, F.substring(bare, 1, 1), F.when(F.length(bare) > 1, F.concat(F.lit("."), F.substring(bare, F.lit(2), F.length(bare)))).otherwise(""), F.lit("e"), power)
    scaled = F.when(exponent.between(-4, -1), small).when(exponent.between(0, 15), large).otherwise(odd)
    named = F.when(F.isnan(c), "NaN").when(c == float("inf"), "Infinity").when(c == float("-inf"), "-Infinity").when(c == 0, c.cast("string"))
    return F.coalesce(named, scaled)


def canonical_json(c: Column, kind: T.DataType, compact: bool = True) -> Column:
    """A column of a type as canonical JSON; null is ``null``. Compact: without spaces behind commas and colons. Dates and
    times are strings as Spark writes them, numbers with a fixed point keep their digits; binary isn't JSON."""
    comma, colon = ("," if compact else ", "), (":" if compact else ": ")
    inner = lambda x, k: canonical_json(x, k, compact)
    if isinstance(kind, T.StructType):
        fields = [F.concat(F.lit(json.dumps(f.name, ensure_ascii=False) + colon), inner(c.getField(f.name), f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name)]
        out = F.concat(F.lit("{"), F.concat_ws(comma, *fields), F.lit("}"))
    elif isinstance(kind, T.MapType):
        entries = F.array_sort(F.transform(F.map_entries(c), lambda e: F.struct(e["key"].cast("string").alias("k"), e["value"].alias("v"))), lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0))
        out = F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(_string(e["k"]), F.lit(colon), inner(e["v"], kind.valueType))), comma), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: inner(x, kind.elementType)), comma), F.lit("]"))
    elif isinstance(kind, T.BooleanType):
        out = c.cast("string")
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        out = _double(c)
    elif isinstance(kind, (T.IntegralType, T.DecimalType)):
        out = c.cast("string")
    elif isinstance(kind, T.BinaryType):
        raise TypeError("binary has no JSON")
    else:
        out = _string(c.cast("string"))
    return F.coalesce(out, F.lit("null"))


def fingerprint(rows: DataFrame, *columns: str | Column, compact: bool = True) -> Column:
    """sha256 of the canonical JSON of an object with these columns of ``rows``."""
    whole = F.struct(*[F.col(c) if isinstance(c, str) else c for c in columns])
    return F.sha2(canonical_json(whole, rows.select(whole.alias("w")).schema["w"].dataType, compact), 256)


def fingerprint_of(payload: dict, compact: bool = True) -> str:
    """The same of plain values."""
    said = json.dumps(payload, ensure_ascii=False, sort_keys=True, separators=(",", ":") if compact else None)
    return hashlib.sha256(said.encode()).hexdigest()


def json_in(c: Column) -> Column:
    """The JSON in a text, as text: the whole of it, without a fence around it; else what stands from the first brace or
    bracket to the last that closes its kind; null where neither is JSON."""
    text = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    inside = F.regexp_replace(F.regexp_replace(text, r"(?i)^```(?:json)?", ""), r"(?U)^\s+|\s+$", "")
    plain = F.when(F.startswith(text, F.lit("```")), F.regexp_replace(F.regexp_replace(inside, "```$", ""), r"(?U)^\s+|\s+$", "")).otherwise(text)
    found = F.nullif(F.regexp_extract(plain, r"(?s)(\{.*\}|\[.*\])", 1), F.lit(""))
    valid = lambda x: F.when(F.try_parse_json(x).isNotNull(), x)
    return F.coalesce(valid(plain), valid(found))
