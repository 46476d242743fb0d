"""License scans by canonical digest: a text is a known licence if its canonical form has a known digest.

The canonical form has lower case, no copyright lines, no punctuation, one spelling of words that differ and
single spaces, so layout, holders and years don't matter. A text may also be known by its bare form, which goes
without notices of holders and marks of lists only, so that a wrapped line may begin with "copyright"; there the
full licences are listed with their usual titles.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import written

# Equivalent spellings, as licence matching guidelines list them.
SPELLINGS = {
    "licence": "license", "licenced": "licensed", "sub license": "sublicense", "noninfringement": "non infringement", "merchantibility": "merchantability",
    "copyright holder": "copyright owner", "copyright holders": "copyright owners", "whilst": "while", "wilful": "willful", "favour": "favor", "judgement": "judgment",
}

# Texts of short licences and notices, and their identifiers.
KNOWN = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "MIT (notice)": "Released under the MIT License.",
    "Apache-2.0 (notice)": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0 (notice)": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 (notice)": "Licensed under CC BY-NC 4.0.",
}

COPYRIGHT_LINE = r"(?m)^[ \t]*(copyright|\(c\)|©)[^\n]*$|^[ \t]*all rights reserved\.?[ \t]*$"
SEPARATORS = r"[^a-z0-9\x{80}-\x{10FFFF}]+"

#: Notices: "copyright" with a sign, a year or a field to fill in, or at the head of a paragraph with a name.
NOTICE_LINE = (
    r"(?m)^[ \t]*(?:copyright[ \t:,]*(?:\(c\)|©|[12][0-9]{3}|[\[<{](?:yyyy|year))|\(c\)[ \t]*(?:copyright|[12][0-9]{3}|[\[<{])|©)[^\n]*$"
    r"|(?<=\A|\n[ \t\r]{0,8}\n)[ \t]*copyright[ \t]+(?!notice|holder|owner|law|licen|and |or )[^\n]*$"
    r"|^[ \t]*all rights reserved\.?[ \t\r]*$"
)
LIST_MARK = r"(?m)^[ \t]*(?:\(?[0-9a-z]\)|[0-9]{1,2}\.|[*•-])[ \t]+"
HOLDER_NAME = r" neither the names? of .{1,200}? nor the names of (?:its|their|any) contributors may "

# Full licences whose texts are in KNOWN or, by identifier, in the folder of texts; and their usual titles.
TEXTS = Path(__file__).with_name("license_texts")
TITLES = {
    "MIT": ["MIT License", "The MIT License", "MIT License (MIT)", "The MIT License (MIT)", "The MIT License MIT License", "License: MIT"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)", "ISC License (ISCL)"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD", "Zero-Clause BSD License", "BSD Zero Clause License (0BSD)", "Zero-Clause BSD (0BSD)", "0BSD License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", "BSD 2-Clause \"Simplified\" License", "Simplified BSD License", "FreeBSD License", "BSD License", "The BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", "BSD 3-Clause \"New\" or \"Revised\" License", "New BSD License", "Modified BSD License", "Revised BSD License", "BSD License", "The BSD License"],
    "BSL-1.0": [],
    "Unlicense": ["The Unlicense", "Unlicense"],
    "Zlib": ["zlib License", "The zlib License", "zlib/libpng License", "The zlib/libpng License"],
    "Apache-2.0": [], "GPL-2.0": [], "GPL-3.0": [], "LGPL-2.1": [], "LGPL-3.0": [], "MPL-2.0": [], "CC0-1.0": [],
}
#: Licences often come without what follows these lines (how to apply them), and without their own title.
APPENDIX = ("END OF TERMS AND CONDITIONS",)


def canonical(text: Column) -> Column:
    """Canonical form of a whole text; null for null."""
    return F.trim(_spelled(F.regexp_replace(F.lower(text), COPYRIGHT_LINE, " ")))


def _spelled(lowered: Column) -> Column:
    # Two spaces between words: each has its own on either side, so a word that repeats is found every time.
    wide = lambda words: f" {words.replace(' ', '  ')} "
    out = F.concat(F.lit(" "), F.trim(F.regexp_replace(lowered, SEPARATORS, "  ")), F.lit(" "))
    for old, new in SPELLINGS.items():
        out = F.replace(out, F.lit(wide(old)), F.lit(wide(new)))
    return F.replace(out, F.lit("  "), F.lit(" "))


def bare(text: Column) -> Column:
    """Form of a whole text without notices, marks of lists and layout; null for null."""
    out = F.regexp_replace(F.regexp_replace(F.lower(text), NOTICE_LINE, " "), LIST_MARK, " ")
    return F.trim(F.regexp_replace(_spelled(out), HOLDER_NAME, " neither the name of the copyright owner nor the names of its contributors may "))


def full_texts() -> list[tuple[str, str]]:
    """Identifier and text of each full licence, as it is, under each of its titles, and without its appendix."""
    out = []
    for name, titles in TITLES.items():
        files = [p.read_text("utf-8") for p in sorted(TEXTS.glob(f"{name}.txt")) + sorted(TEXTS.glob(f"{name}_*.txt"))]
        for body in [KNOWN[name]] if name in KNOWN else files:
            bodies = [body, *(body[: body.index(x) + n] for x in APPENDIX if x in body for n in (0, len(x)))]
            out += [(name, f"{title}\n\n{b}") for b in bodies for title in ("", f"SPDX-License-Identifier: {name}", *titles)]
    return out


def bare_digests(spark: SparkSession) -> DataFrame:
    """digest, license of each full licence in its usual layouts; a list kept by hand, too."""
    rows = spark.createDataFrame(full_texts(), "license string, body string")
    return rows.groupBy(F.sha2(bare(F.col("body")), 256).alias("digest")).agg(F.min("license").alias("license"))


def known_digests(spark: SparkSession, known: dict[str, str] = KNOWN) -> DataFrame:
    """digest, license of each known text; as many rows as there are known texts."""
    rows = spark.createDataFrame(sorted(known.items()), "license string, body string")
    return rows.groupBy(F.sha2(canonical(F.col("body")), 256).alias("digest")).agg(F.min("license").alias("license"))


def scan(docs: DataFrame, known: DataFrame | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, digest, license (null: unknown), notices (sorted identifiers of lines that are a known text whole).

    Whole texts are matched by digest, and so is each line that speaks of a license; a text, or line, that
    says more than the known one isn't it. Unless a table of known digests (digest, license) is given, a whole text can
    also be a full licence by its bare form, which ``digest`` doesn't show. Null and empty texts have no license;
    repeated rows stay; other columns aren't read. The list kept by hand goes to the tasks as literals, and documents
    aren't moved; a given table, of any size, is joined, and the lines' digests move."""
    lines = F.filter(F.split(F.col(text_col), "\n"), lambda x: F.lower(x).rlike("licen[cs]e"))
    digests = F.transform(F.coalesce(lines, F.array().cast("array<string>")), lambda x: F.sha2(canonical(x), 256))
    rows = docs.select(F.col(id_col).alias("id"), F.sha2(canonical(F.col(text_col)), 256).alias("digest"), digests.alias("lines"), F.col(text_col).alias("text"))
    if known is not None:
        return _joined(rows.drop("text"), known, id_col)
    spark = docs.sparkSession
    listed = lambda found: F.create_map(*[F.lit(x) for r in found.collect() for x in (r["digest"], r["license"])])
    by_digest, by_bare = listed(known_digests(spark)), listed(bare_digests(spark))
    named = F.transform("lines", lambda x: F.try_element_at(by_digest, x))
    notices = F.array_sort(F.array_distinct(F.filter(named, lambda x: x.isNotNull())))
    # Every full licence has one of these words; other texts needn't be put in the form.
    laid = F.when(F.lower("text").rlike("licen[cs]e|copyright|permission|redistribution|warrant"), F.try_element_at(by_bare, F.sha2(bare(F.col("text")), 256)))
    return rows.select(F.col("id").alias(id_col), "digest", F.coalesce(F.try_element_at(by_digest, "digest"), laid).alias("license"), notices.alias("notices"))


def _joined(rows: DataFrame, known: DataFrame, id_col: str) -> DataFrame:
    """The same with a table of known digests: one join for whole texts, one for the lines that speak of a license."""
    known = known.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("license").alias("license"))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "license-digests")
    said = rows.select("row", F.explode(F.array_distinct("lines")).alias("digest")).join(known, "digest").groupBy("row").agg(F.array_sort(F.collect_set("license")).alias("notices"))
    out = rows.drop("lines").join(known, "digest", "left").join(said, "row", "left")
    return out.select(F.col("id").alias(id_col), "digest", "license", F.coalesce("notices", F.array().cast("array<string>")).alias("notices"))
