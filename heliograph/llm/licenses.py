"""License scans: sparse TF-IDF cosine to templates, and inheritance along directories.

Each document is compared with the templates, of headers and of whole licence files, as a whole
and by its windows of one to ``LINES`` lines (headers are wrapped), as sparse TF-IDF vectors: terms are runs
of a-z and 0-9; document frequencies are counted over all documents; a term that no template has
counts in a vector's length as if no document had it. A document's own licence is its best
window's. A document that as a whole is like a template, or has a licence and is named like a licence
file, sets its directory's licence; a document without its own licence inherits from the nearest
directory above it that has one.

Only windows that can reach the threshold are looked at. Of a template's terms the lightest, whose
weights together have less than ``LIGHT`` of its length, bring a cosine to less than that; the others,
the heavy ones, must bring ``COSINE - LIGHT``, so their share of the window's length is as large. The
length is at least the root of the number of the window's words that no template has, times their
weight; the heavy words' is at most the sum of their weights, which classes bound. This loses nothing.

Texts of the GPL, LGPL, AGPL, MPL and Apache licences are too long to be templates here: such files
are known by their titles and notices, or by their names.

Everything is DataFrame operations. Broadcast are only tables made from ``TEMPLATES``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.llm.common import Shelf, table

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_NAME = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""


def _gnu(name: str) -> str:
    return f"""This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details.
You should have received a copy of the GNU {name} along with this program. If not, see http://www.gnu.org/licenses/."""


#: Licence (SPDX name) and a header line, a notice, or the text of its licence file.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", _MIT.split("\n")[0]),
    ("MIT", _MIT),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("ISC", "ISC License"),
    ("ISC", _ISC),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", _APACHE),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", _gnu("General Public License")),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0-only"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", _gnu("Lesser General Public License")),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0-only"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("AGPL-3.0", _gnu("Affero General Public License")),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("BSD-3-Clause", _BSD.split("\n")[0]),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "\n".join([_BSD, _BSD_NAME, _BSD_END])),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-2-Clause", "\n".join([_BSD, _BSD_END])),
    ("Zlib", "SPDX-License-Identifier: Zlib"),
    ("Zlib", _ZLIB),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", _UNLICENSE),
]
COSINE, LIGHT, LINES = 0.6, 0.3, 3
#: Bounds of the classes of weights; a term of the templates weighs no more than an unknown word.
CLASSES = (0.1, 0.2, 0.3, 0.45, 0.6, 0.8, 1.0)
FILE_NAME = r"(?i)(^|/)(licen[sc]e|copying|unlicense)([.\-][^/]*)?$"
TERM = "[a-z0-9]+"


def _terms(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(TERM), F.lit(0))


def _vocabulary() -> list[str]:
    import re

    return sorted({t for _, text in TEMPLATES for t in re.findall(TERM, text.lower())})


def _heavy(weights: DataFrame, terms: DataFrame) -> dict[float, list[str]]:
    """Each template's terms but the lightest, which together stay below ``LIGHT`` of its length, by classes of weight: at most as many as the templates have terms.

    A class is named by the largest weight in it, as a share of an unknown word's.
    """
    below = F.aggregate(
        "all",
        F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<string>").alias("out")),
        lambda s, x: F.struct((s["sum"] + x["tw"] * x["tw"]).alias("sum"), F.when(s["sum"] + x["tw"] * x["tw"] < (LIGHT * F.col("tn")) ** 2, s["out"]).otherwise(F.concat(s["out"], F.array(x["term"]))).alias("out")),
    )["out"]
    lists = weights.groupBy("k", "tn").agg(F.array_sort(F.collect_list(F.struct("tw", "term"))).alias("all"))
    found = lists.select(F.explode(below).alias("term")).distinct().join(F.broadcast(terms), "term")
    out: dict[float, list[str]] = {}
    for r in found.select("term", (F.col("idf") / F.log(1 + F.col("n"))).alias("share")).orderBy("term").collect():
        out.setdefault(next(c for c in CLASSES if r["share"] <= c or c == 1.0), []).append(r["term"])
    return out


def _windows() -> Column:
    """Structs (at, size, terms) of the windows of a text's lines (lines, heavy, other: terms, bound of the heavy words' weights and number of unknown words) that can reach the threshold; size 0 is the whole text."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    # a little below the bound, as cosines are rounded
    fits = lambda heavy, other: (total(heavy) > 0) & (total(heavy) >= (COSINE - 1e-5 - LIGHT) * F.sqrt(total(other)))
    whole = F.when(fits(F.col("heavy"), F.col("other")), F.array(F.struct(F.lit(0).alias("at"), F.lit(0).alias("size"), F.flatten("lines").alias("terms"))))
    whole = F.coalesce(whole, F.array().cast("array<struct<at:int,size:int,terms:array<string>>>"))

    def of(n: int) -> Column:
        starts = F.when(F.size("lines") >= n, F.sequence(F.lit(1), F.size("lines") - (n - 1))).otherwise(F.array().cast("array<int>"))
        some = F.filter(starts, lambda i: fits(F.slice("heavy", i, n), F.slice("other", i, n)))
        return F.transform(some, lambda i: F.struct(i.alias("at"), F.lit(n).alias("size"), F.flatten(F.slice("lines", i, n)).alias("terms")))

    return F.concat(whole, *[of(n) for n in range(1, LINES + 1)])


def _repeats(files: DataFrame) -> bool:
    """Whether an id has several rows; their texts are then moved once, so that no window counts twice."""
    return not files.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").isEmpty()


def scan(files: DataFrame) -> DataFrame:
    """(doc_id, path, license, how, cosine, from_path) for each row of files (doc_id, path, text).

    how: header (an own window), file (the document is a licence file), inherited, or null; of
    several best windows or files the alphabetically first licence, then the first path. Null and
    empty texts have no window, null paths no directory; they inherit nothing. Null ids get no licence of their own. Rows should have
    different ids; repeated ones get the same licence. Other columns are ignored.
    """
    spark = files.sparkSession
    shelf = Shelf(spark, "licenses")
    files = files.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("path").cast("string").alias("path"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    vocabulary = _vocabulary()
    held = F.array_intersect(F.array_distinct(_terms(F.col("text"))), F.array(*map(F.lit, vocabulary)))
    df = files.select(F.explode(F.concat(held, F.array(F.lit("")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    # one row a term of the templates; the empty term counts the documents
    df = shelf.put("df", df)
    n = df.filter("term = ''").select(F.col("df").alias("n"))
    terms = spark.range(1).select(F.explode(F.array(*map(F.lit, vocabulary))).alias("term")).join(df, "term", "left").crossJoin(F.broadcast(n)).select("term", F.log((1 + F.col("n")) / (1 + F.coalesce("df", F.lit(0)))).alias("idf"), "n")
    terms = shelf.put("terms", terms)
    rows = [F.struct(F.lit(k).alias("k"), F.lit(name).alias("license"), F.lit(text).alias("line")) for k, (name, text) in enumerate(TEMPLATES)]
    lines_of = spark.range(1).select(F.inline(F.array(*rows)))
    weights = lines_of.select("k", "license", F.explode(_terms(F.col("line"))).alias("term")).groupBy("k", "license", "term").count().join(F.broadcast(terms), "term").select("k", "license", "term", (F.col("count") * F.col("idf")).alias("tw"))
    norms = weights.groupBy("k").agg(F.sqrt(F.sum(F.col("tw") * F.col("tw"))).alias("tn"))
    weights = shelf.put("weights", weights.join(F.broadcast(norms), "k").filter("tn > 0"))

    classes = _heavy(weights, terms)
    heavy = sorted(t for c in classes.values() for t in c)
    have = F.array(*map(F.lit, heavy)) if heavy else F.array().cast("array<string>")
    own = files.filter("doc_id is not null")
    own = own.groupBy("doc_id", "text").count().drop("count") if _repeats(own) else own
    lines = F.transform(F.split("text", "\n"), _terms)
    among = lambda c: lambda t: t.isin(c)
    weigh = lambda x: reduce(Column.__add__, [F.size(F.filter(x, among(c))) * F.lit(share) for share, c in sorted(classes.items())], F.lit(0.0))
    other = lambda x: F.size(F.filter(x, lambda t: ~t.isin(vocabulary))).cast("double")
    # of texts with a heavy term only, and written: what follows refers to the lines many times
    some = own.filter(F.arrays_overlap(_terms(F.col("text")), have))
    numbered = shelf.put("numbered", some.select("doc_id", lines.alias("lines"), F.transform(lines, weigh).alias("heavy"), F.transform(lines, other).alias("other")))
    windows = numbered.select("doc_id", F.explode(_windows()).alias("w")).select("doc_id", "w.at", "w.size", "w.terms")
    # counted before the shuffle, as a window is in one task
    tf = windows.select("doc_id", "at", "size", F.explode("terms").alias("term")).groupBy("doc_id", "at", "size", "term").agg(F.count("*").alias("tf"))
    unknown = F.log(1 + F.col("all_n"))
    count_ = terms.agg(F.max("n").alias("all_n"))
    weighted = tf.join(F.broadcast(terms.select("term", "idf")), "term", "left").crossJoin(F.broadcast(count_)).select("doc_id", "at", "size", "term", (F.col("tf") * F.coalesce("idf", unknown)).alias("w"))
    weighted = shelf.put("weighted", weighted)
    length = weighted.groupBy("doc_id", "at", "size").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = weighted.join(F.broadcast(weights), "term").groupBy("doc_id", "at", "size", "k", "license", "tn").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
    cosine = F.round(F.col("dot") / (F.col("norm") * F.col("tn")), 6)
    best = dots.join(length, ["doc_id", "at", "size"]).select("doc_id", "size", "license", cosine.alias("cosine")).filter(F.col("cosine") >= COSINE)
    own = best.groupBy("doc_id").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "license")).alias("b"), F.min(F.when(F.col("size") == 0, F.struct((-F.col("cosine")).alias("c"), "license"))).alias("whole"))
    own = own.withColumn("b", F.coalesce("whole", "b"))
    own = shelf.put("own", own.select("doc_id", F.col("b.license").alias("license"), (-F.col("b.c")).alias("cosine"), F.col("whole").isNotNull().alias("mostly")))
    shelf.drop("weighted", "numbered")

    places = files.select("doc_id", "path", F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).when(F.col("path").isNotNull(), F.lit("")).alias("dir"))
    marked = places.join(own, "doc_id", "left").withColumn("is_file", F.col("license").isNotNull() & (F.coalesce("mostly", F.lit(False)) | F.coalesce(F.col("path").rlike(FILE_NAME), F.lit(False))))
    marked = shelf.put("marked", marked)
    of_dir = marked.filter("is_file and dir is not null").groupBy("dir").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "license", "path")).alias("f")).select(F.col("dir").alias("above"), "f")
    depths = F.sequence(F.lit(0), F.size(F.split("dir", "/")))
    above = F.transform(depths, lambda d: F.struct(d.alias("depth"), F.array_join(F.slice(F.split("dir", "/"), 1, d), "/").alias("above")))
    dirs = marked.filter("license is null and dir is not null").select("dir").distinct().select("dir", F.explode(above).alias("a")).select("dir", "a.depth", "a.above")
    nearest = shelf.put("nearest", dirs.join(of_dir, "above").groupBy("dir").agg(F.max_by("f", "depth").alias("f")))
    # a large directory's documents are dealt with their directory's row, several times where there are many
    out = marked.join(nearest.withColumnRenamed("dir", "at"), (F.col("dir") == F.col("at")) & F.col("license").isNull(), "left")
    how = F.when(F.col("is_file"), "file").when(F.col("license").isNotNull(), "header").when(F.col("f").isNotNull(), "inherited")
    return out.select("doc_id", "path", F.coalesce("license", "f.license").alias("license"), how.alias("how"), F.coalesce("cosine", -F.col("f.c")).alias("cosine"), F.when(F.col("license").isNotNull(), F.col("path")).otherwise(F.col("f.path")).alias("from_path"))


def with_paths(docs: DataFrame) -> DataFrame:
    """Documents as files: source/lang/doc_id.txt."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown"))
    return docs.select("doc_id", F.concat_ws("/", part("source"), part("lang"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), "text")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(with_paths(table(spark, sf_dir, "documents")))


def _sql() -> str:
    values = ", ".join("({}, '{}', '{}')".format(k, name, text.replace("'", "''")) for k, (name, text) in enumerate(TEMPLATES))
    windows = " UNION ALL ".join([f"SELECT doc_id, unnest(range(1, len(l) - {n - 2})) AS at_, {n} AS size, l FROM l" for n in range(1, LINES + 1)])
    return f"""
WITH t(k, license, line) AS (VALUES {values}),
tt AS (SELECT k, license, term, count(*) AS tf FROM (SELECT k, license, unnest(regexp_extract_all(lower(line), '{TERM}')) AS term FROM t) GROUP BY ALL),
files AS (SELECT doc_id, coalesce(source, 'unknown') || '/' || coalesce(lang, 'unknown') || '/' || doc_id || '.txt' AS path, coalesce(text, '') AS text FROM documents),
n AS (SELECT count(*) AS n FROM files),
df AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, term FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{TERM}')) AS term FROM files) WHERE term IN (SELECT term FROM tt)) GROUP BY term),
terms AS (SELECT v.term, ln((1 + n)::DOUBLE / (1 + coalesce(df, 0))) AS idf FROM (SELECT DISTINCT term FROM tt) v LEFT JOIN df USING (term), n),
w AS (SELECT k, license, term, tf * idf AS tw FROM tt JOIN terms USING (term)),
tn AS (SELECT k, sqrt(sum(tw * tw)) AS tn FROM w GROUP BY k),
l AS (SELECT doc_id, string_split(lower(text), chr(10)) AS l FROM files),
win AS (SELECT doc_id, 0 AS at_, 0 AS size, l AS part FROM l UNION ALL SELECT doc_id, at_, size, l[at_:at_ + size - 1] AS part FROM ({windows})),
tf AS (SELECT doc_id, at_, size, term, count(*) AS tf FROM (SELECT doc_id, at_, size, unnest(regexp_extract_all(array_to_string(part, ' '), '{TERM}')) AS term FROM win) GROUP BY ALL),
weighted AS (SELECT doc_id, at_, size, term, tf * coalesce(idf, ln(1 + n)) AS w FROM tf LEFT JOIN terms USING (term), n),
len AS (SELECT doc_id, at_, size, sqrt(sum(w * w)) AS norm FROM weighted GROUP BY ALL),
best AS (SELECT doc_id, size, license, round(sum(w * tw) / (norm * tn), 6) AS cosine FROM weighted JOIN w USING (term) JOIN tn USING (k) JOIN len USING (doc_id, at_, size) WHERE tn > 0 GROUP BY doc_id, at_, size, k, license, norm, tn),
own AS (SELECT doc_id, coalesce(min({{'c': -cosine, 'l': license}}) FILTER (WHERE size = 0), min({{'c': -cosine, 'l': license}})) AS b, bool_or(size = 0) AS whole FROM best WHERE cosine >= {COSINE} GROUP BY doc_id),
marked AS (SELECT f.doc_id, path, regexp_replace(path, '/[^/]*$', '') AS dir, b.l AS license, -(b.c) AS cosine, b IS NOT NULL AND whole AS is_file FROM files f LEFT JOIN own USING (doc_id)),
of_dir AS (SELECT dir AS above, min({{'c': -cosine, 'l': license, 'p': path}}) AS f FROM marked WHERE is_file GROUP BY dir),
dirs AS (SELECT dir, d AS depth, array_to_string(string_split(dir, '/')[1:d], '/') AS above FROM (SELECT DISTINCT dir FROM marked WHERE license IS NULL), range(0, 10) r(d) WHERE d <= len(string_split(dir, '/'))),
nearest AS (SELECT dir, arg_max(f, depth) AS f FROM dirs JOIN of_dir USING (above) GROUP BY dir)
SELECT doc_id, path, coalesce(license, f.l) AS license,
  CASE WHEN is_file THEN 'file' WHEN license IS NOT NULL THEN 'header' WHEN f IS NOT NULL THEN 'inherited' END AS how,
  coalesce(cosine, -(f.c)) AS cosine, CASE WHEN license IS NOT NULL THEN path ELSE f.p END AS from_path
FROM marked m LEFT JOIN nearest x ON m.dir = x.dir AND m.license IS NULL"""


OP4_SQL = _sql()
