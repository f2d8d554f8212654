"""Licence scans by canonical digests.

Texts are brought to one form (lower case, letters and digits only, equivalent spellings unified,
copyright lines left out) and their digests are joined with those of known licences, brought to the
same form. That is done for whole documents, which finds licence files, and for every single line, which
finds notices inside documents. No text is compared with another one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Licence texts and notices, as their authors publish them.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
KNOWN = [
    ("MIT", _MIT), ("MIT", "MIT License\n\n" + _MIT), ("MIT", "The MIT License (MIT)\n\n" + _MIT),
    ("0BSD", f"{_GRANT}.\n\n{_AS_IS}"), ("0BSD", f"BSD Zero Clause License\n\n{_GRANT}.\n\n{_AS_IS}"),
    ("ISC", f"{_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_AS_IS}"),
    ("ISC", f"ISC License\n\n{_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_AS_IS}"),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"), ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("all-rights-reserved", "All rights reserved."),
]
# Spellings that count as one, after lower-casing.
SPELLINGS = (
    ("licence", "license"), ("licenced", "licensed"), ("sub license", "sublicense"), ("non infringement", "noninfringement"),
    ("non commercial", "noncommercial"), ("organisation", "organization"), ("favour", "favor"), ("fulfil", "fulfill"),
    ("copyright holder", "copyright owner"), ("copyright holders", "copyright owners"), ("per cent", "percent"),
)
_COPYRIGHT_LINE = r"(?m)^[\x20\t#*/;-]*(?:copyright[\x20\t]+(?:\(c\)|©|[0-9])|\(c\)|©)[^\n]*$"
#: Known texts at most: their digests are part of the plan.
MAX_KNOWN = 2_000
#: Words that every notice in ``KNOWN`` has; the SQL form of the query asks for them first.
_SPEAKS = r"(?i)licen[cs]e|rights reserved|public domain|hereby granted"


def canonical(text: Column) -> Column:
    """The form that is digested; a null text counts as empty."""
    kept = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), _COPYRIGHT_LINE, "")
    words = F.btrim(F.regexp_replace(F.replace(kept, F.lit("&"), F.lit(" and ")), r"[^\p{L}\p{N}]++", " "))
    padded = F.concat(F.lit(" "), words, F.lit(" "))
    for one, other in SPELLINGS:
        padded = F.replace(padded, F.lit(f" {one} "), F.lit(f" {other} "))
    return F.btrim(padded)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(licences: DataFrame) -> DataFrame:
    """(digest, licence) of (licence, text) rows; of equal texts the first licence by name counts."""
    named = licences.where(F.length(canonical(F.col("text"))) > 0)
    return named.select(digest(F.col("text")).alias("digest"), "licence").groupBy("digest").agg(F.min("licence").alias("licence"))


def builtin(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(KNOWN, "licence string, text string")


def scan(docs: DataFrame, licences: DataFrame, carry: list[str]) -> DataFrame:
    """``carry``, text_digest, licence (of the whole text, or null) and notices of every row.

    notices lists the licences of lines, by name, comma-joined; none is "". Null, empty and blank
    texts have neither. Copyright lines never count. Columns of these names in ``carry`` give way.
    Every line is digested; one that is the whole text, and does not speak of rights, is its licence
    and no notice. Whole texts are joined by digest; the known side
    has one row per digest, so a digest of many documents is hot on one side only. Lines look theirs
    up in a map of the known digests, of which ``MAX_KNOWN`` are allowed.
    """
    known = known_digests(licences)
    carry = [c for c in carry if c not in ("text_digest", "licence", "notices")]
    pairs = known.limit(MAX_KNOWN + 1).collect()
    if len(pairs) > MAX_KNOWN:
        raise ValueError(f"more than {MAX_KNOWN} known licences")
    lines = F.transform(F.split(F.coalesce(docs["text"], F.lit("")), "\n", -1), digest)
    names = F.create_map().cast("map<string,string>")
    if pairs:
        names = F.create_map(*[F.lit(x) for r in pairs for x in (r.digest, r.licence)])
    hits = F.filter(lines, lambda d: d.isin([r.digest for r in pairs]) if pairs else F.lit(False))
    rows = docs.select(
        F.struct(*[docs[c] for c in carry]).alias("_doc"), digest(docs["text"]).alias("text_digest"),
        hits.alias("_hits"), F.coalesce(docs["text"], F.lit("")).rlike(_SPEAKS).alias("_speaks"),
    )
    own = F.filter("_hits", lambda d: F.col("_speaks") | (d != F.col("text_digest")))
    named = F.array_sort(F.array_distinct(F.transform(own, lambda d: F.try_element_at(names, d))))
    whole = rows.join(known.withColumnRenamed("digest", "text_digest"), "text_digest", "left")
    return whole.select(
        *[F.col("_doc")[c].alias(c) for c in carry], "text_digest", "licence", F.array_join(named, ",").alias("notices")
    )
