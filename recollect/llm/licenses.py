"""Licence scan (DataFrame operations only).

Each passage of a file that speaks of licences is a sparse TF-IDF vector, compared by cosine with notice templates; the best
passage at or above `threshold` gives the file's own licence. Passages are lines, windows of up to `WRAPPED` lines around
them (headers wrapped over lines), paragraphs, and licence files as a whole; templates are references in one line, standard
headers, opening paragraphs and titles. Inverse document frequencies of the words of passages and templates count all files,
cut into words in the same way. A file without a licence of its own takes that of the nearest ancestor directory that
has a licence file (LICENSE, LICENCE, COPYING, NOTICE and names that begin so), by joining directories' ancestor paths.

Bounds: the templates' vocabulary is fixed here; the words of passages and their frequencies are broadcast up to
`broadcast_terms`, by a count made before, and joined by the word beyond. Directories, not
files, are joined with ancestors; files are dealt over `salts` when they take the result, so one directory may hold a third
of all files.

Defined results: a null text has no licence of its own and may inherit; a null path is a file without directory; of equal
cosines the template first in order wins, of several licence files in one directory the best cosine, then the least path;
rows that repeat a path share the best licence of that path; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, let

# Notices as projects commonly write them, by SPDX identifier: references, standard headers, opening paragraphs and titles.
_APACHE = "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD_TWO = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THIRD = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_REST = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
_MIT_REST = "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_GNU = "This {0} is free software; you can redistribute it and/or modify it under the terms of the GNU {1} Public License as published by the Free Software Foundation; "
_LATER = "either version {0} of the License, or (at your option) any later version."
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", _APACHE, "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    ),
    "MIT": ("Released under the MIT License.", _MIT + ".", _MIT + " " + _MIT_REST, "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3.",
        _GNU.format("program", "General") + _LATER.format(3), "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    ),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", _GNU.format("program", "General") + "version 2.", _GNU.format("program", "General") + _LATER.format(2), "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    "LGPL-3.0": ("This library is licensed under the GNU Lesser General Public License, version 3.", _GNU.format("library", "Lesser General") + _LATER.format(3), "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    "AGPL-3.0": ("Licensed under the GNU Affero General Public License, version 3.", _GNU.format("program", "Affero General") + _LATER.format(3), "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License.", _BSD + ".", _BSD_THIRD, _BSD + " " + _BSD_TWO + " " + _BSD_THIRD),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "Mozilla Public License Version 2.0"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC0-1.0": ("Released into the public domain under CC0 1.0.",),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License.", _BSD + " " + _BSD_TWO),
    "ISC": ("Licensed under the ISC License.", _ISC, _ISC + " " + _ISC_REST),
    "LGPL-2.1": ("This library is licensed under the GNU Lesser General Public License, version 2.1.", _GNU.format("library", "Lesser General") + _LATER.format("2.1"), "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}
TRIGGER_WORDS = ("licens", "licenc", "copyright", "spdx", "redistribut", "public domain", "permission is hereby")
TRIGGER = r"(?i)licen[sc]|copyright|spdx|redistribut|public domain|permission is hereby"
#: What lies between words, with the full stops at their ends.
NOT_TERM = r"(?<!\.)\.*+(?:[^a-z0-9.]++\.*+)++|^\.++|(?<!\.)\.++$"
#: Between paragraphs: lines without a letter or digit.
BLANK = r"\n(?:[^A-Za-z0-9\n]*+\n)++"
WRAPPED = 4
LICENSE_FILE = r"(?i)(?:^|/)(?:LICEN[CS]E|COPYING|NOTICE)[^/]*$"
TEMPLATE_ROWS = [(name, text) for name, texts in TEMPLATES.items() for text in texts]


def _terms(text: str) -> list[str]:
    return [w for w in re.split(NOT_TERM, text.lower()) if w]


VOCABULARY = sorted({t for _, text in TEMPLATE_ROWS for t in _terms(text)})


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), NOT_TERM), lambda w: w != "")


def _passages(path: Column, text: Column) -> Column:
    spans = [(back, n) for n in range(1, WRAPPED + 1) for back in range(n)]

    def windows(lines: Column) -> Column:
        window = lambda i, back, n: F.when((i >= back) & (i - back + n <= F.size(lines)), F.array_join(F.slice(lines, F.greatest(i - back, F.lit(0)) + 1, n), " "))
        at = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.get(lines, i).rlike(TRIGGER))
        return F.flatten(F.transform(at, lambda i: F.array(*(window(i, back, n) for back, n in spans))))

    blocks = F.filter(F.split(text, BLANK), lambda b: b.rlike(TRIGGER))
    whole = F.when(F.coalesce(path, F.lit("")).rlike(LICENSE_FILE), F.array(text)).otherwise(F.array().cast("array<string>"))
    return F.filter(F.array_distinct(F.concat(let(F.split(text, "\n"), windows), blocks, whole)), lambda x: x.isNotNull())


def _template_counts(spark) -> DataFrame:
    """term and tf (array over templates): a constant relation."""
    counted = [Counter(_terms(text)) for _, text in TEMPLATE_ROWS]
    rows = ", ".join(f"('{t}', array({', '.join(f'{float(c[t])}D' for c in counted)}))" for t in VOCABULARY)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(term, tf)")


def scan_licenses(files: DataFrame, path_col: str = "path", text_col: str = "text", threshold: float = 0.6, salts: int = 16, broadcast_terms: int = 300_000) -> DataFrame:
    """One row per row of `files`: path, own_license, own_score, license, license_from (the file itself or its licence file)."""
    spark = files.sparkSession
    rows = files.select(F.col(path_col).alias("path"), F.col(text_col).alias("text"))
    # plain tests leave out most files before the pattern reads lines
    small = F.lower("text")
    lines = rows.where(reduce(lambda a, b: a | b, (small.contains(w) for w in TRIGGER_WORDS))).select("path", F.explode(_passages(F.col("path"), F.col("text"))).alias("line"))
    # a passage is known by its hash: whole files are not carried along
    lines = lines.select("path", F.unhex(F.sha2(F.col("line").cast("binary"), 256)).alias("line"), terms(F.col("line")).alias("terms"))
    counts = _template_counts(spark)
    asked = checkpointed(lines.select(F.explode(F.array_distinct("terms")).alias("term")).unionAll(counts.select("term")).distinct())
    # only words of passages and templates are counted, over all files; their number decides how they meet
    few = asked.count() <= broadcast_terms
    near = F.broadcast if few else lambda side: side
    met = rows.where("text IS NOT NULL").select(F.explode(F.array_distinct(F.split(F.lower("text"), NOT_TERM))).alias("term"))
    df = checkpointed(met.join(near(asked), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    total = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    weighed = (
        counts.join(near(df), "term", "left")
        .select("term", "tf", (F.log((F.lit(1) + total) / (F.lit(1) + F.coalesce("df", F.lit(0)))) + 1).alias("idf"))
    )
    n = len(TEMPLATE_ROWS)
    size = weighed.agg(F.array(*(F.sqrt(F.sum(F.pow(F.get("tf", F.lit(i)) * F.col("idf"), 2))) for i in range(n))).alias("size")).scalar()
    lines = lines.dropDuplicates(["path", "line"])
    words = lines.select("path", "line", F.explode("terms").alias("term")).groupBy("path", "line", "term").agg(F.count(F.lit(1)).alias("n"))
    counted = words.join(near(df), "term").withColumn("own_idf", F.log((F.lit(1) + total) / (F.lit(1) + F.col("df"))) + 1)
    scored = counted.join(F.broadcast(weighed), "term", "left").withColumn("w", F.col("n") * F.col("own_idf"))
    dots = F.array(*(F.coalesce(F.sum(F.col("w") * F.get("tf", F.lit(i)) * F.col("idf")), F.lit(0.0)) for i in range(n)))
    cosines = scored.groupBy("path", "line").agg(dots.alias("dots"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    cosines = cosines.withColumn("size", size).withColumn("c", F.zip_with("dots", "size", lambda d, s: F.round(d / s / F.col("norm"), 9)))
    best = cosines.select("path", F.array_max("c").alias("score"), (F.array_position("c", F.array_max("c")) - 1).cast("int").alias("which")).where(F.col("score") >= threshold)
    names = F.array(*(F.lit(name) for name, _ in TEMPLATE_ROWS))
    own = best.groupBy("path").agg(F.max(F.struct(F.col("score"), (-F.col("which")).alias("order"))).alias("b"))
    own = own.select("path", F.get(names, -F.col("b.order")).alias("own_license"), F.col("b.score").alias("own_score"))

    directory = lambda c: F.regexp_extract(c, r"^(.*)/[^/]*$", 1)
    narrow = rows.select("path", directory(F.coalesce("path", F.lit(""))).alias("dir"))
    held = own.where(F.col("path").rlike(LICENSE_FILE)).select(directory(F.col("path")).alias("above"), "path", "own_license", "own_score")
    held = held.groupBy("above").agg(F.min(F.struct((-F.col("own_score")).alias("s"), "path", "own_license")).alias("h"))
    depth = F.size(F.split("dir", "/"))
    chain = F.array_distinct(F.concat(F.transform(F.sequence(F.lit(1), depth), lambda k: F.array_join(F.slice(F.split("dir", "/"), 1, k), "/")), F.array(F.lit(""))))
    dirs = narrow.select("dir").distinct().select("dir", F.explode(chain).alias("above"))
    nearest = dirs.join(held, "above").groupBy("dir").agg(F.max_by("h", F.length("above")).alias("h"))
    dealt = nearest.select("dir", F.col("h.own_license").alias("near_license"), F.col("h.path").alias("near_path"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    mine = narrow.join(own, "path", "left").withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(salts)).cast("int"))
    return mine.join(dealt, ["dir", "salt"], "left").select("path", "own_license", "own_score", F.coalesce("own_license", "near_license").alias("license"), F.when(F.col("own_license").isNotNull(), F.col("path")).otherwise(F.col("near_path")).alias("license_from"))


def licenses_of_documents(docs: DataFrame) -> DataFrame:
    """Documents as files: `source/m<doc_id mod 7>/f<doc_id>`, and every 25th as `source/LICENSE-<doc_id>`."""
    name = F.when(F.col("doc_id") % 25 == 0, F.concat(F.lit("LICENSE-"), F.col("doc_id").cast("string"))).otherwise(F.concat(F.lit("m"), (F.col("doc_id") % 7).cast("string"), F.lit("/f"), F.col("doc_id").cast("string")))
    files = docs.select(F.concat_ws("/", F.coalesce("source", F.lit("none")), name).alias("path"), "text")
    found = scan_licenses(files)
    return found.select(F.regexp_extract("path", r"(\d+)$", 1).cast("bigint").alias("doc_id"), "path", "own_license", F.round("own_score", 6).alias("own_score"), "license", "license_from")
