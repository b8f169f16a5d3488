"""License scans: headers and licence files against templates, then inheritance by directory.

A file's lines, its paragraphs and, as a licence file, its whole text are compared
with each template (the notices and headers of licences and the full texts of short
ones) by the cosine of sparse TF-IDF vectors; document frequencies of all terms come
from all files. Units without any of the templates' rarest terms are left out, as
they can't reach ``min_cosine``. The best match above ``min_cosine`` is the file's own
licence. A licence file (one whose first or last line that has a word is the match,
or whose whole text is) also speaks for its directory, and a file without own licence
takes that of the nearest ancestor directory, found by joining on the paths of its
ancestors.

Defined results: a null text is empty and has no own licence; a null path is the
root; null is a file like others; rows that share a file have the best licence of
any of them; equal cosines go to the smallest licence name; several licence files of
a directory: the highest cosine, then the smallest name; repeated rows are each
returned; other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwell.llm.flat import checkpointed
from tarnwell.llm.text import SPACES, ascii_lower, pick

#: Fixed templates: licence name and the usual wordings of its notices.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)
#: Fixed texts of licences and of the headers that licences ask for, as their authors publish them, without names and years.
MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation "
    "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE "
    "OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
BSD_TERMS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR "
    "PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF "
    "SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
    "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
GPL_HEADER = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {v} of the License, or (at your "
    "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU "
    "General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/."
)
TEXTS = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
     "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License "
     "for the specific language governing permissions and limitations under the License."),
    ("BSD-2-Clause", BSD_TERMS + BSD_END),
    ("BSD-3-Clause", BSD_TERMS + BSD_THIRD + BSD_END),
    ("GPL-2.0", GPL_HEADER.format(v=2)),
    ("GPL-3.0", GPL_HEADER.format(v=3)),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
     "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
     "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH "
     "THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("MIT", MIT_GRANT),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
)
ALL = TEMPLATES + TEXTS
TERM = re.compile(r"[a-z0-9]+")


def _terms(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(text), "[^a-z0-9]+"), lambda t: t != "")


def marks(rows: list[tuple[int, str, str, float]], df: dict[str, int], min_cosine: float) -> list[str]:
    """Terms of which a text needs one to reach ``min_cosine`` with a template: by Cauchy-Schwarz, the weights of a template's
    other terms have a norm that is smaller. ``rows``: (template, licence, term, weight); of each template the rarest terms go in."""
    least = max(0.0, min_cosine - 1e-6) ** 2
    out: set[str] = set()
    for k in {r[0] for r in rows}:
        terms = sorted((df.get(t, 0), t, w) for j, _, t, w in rows if j == k)
        rest = sum(w * w for _, _, w in terms)
        for i, (_, t, w) in enumerate(terms):
            if rest < least:
                break
            out.add(t)
            rest = sum(x * x for _, _, x in terms[i + 1 :])
    return sorted(out)


def own_licenses(files: DataFrame, *, min_cosine: float = 0.6) -> DataFrame:
    """file, license, cosine, edge (the match is the first or last line that has a word, or the whole text) of the files with an own licence."""
    spark = files.sparkSession
    vocabulary = sorted({t for _, body in ALL for t in TERM.findall(body.lower())})
    # How many files have each term, by its hash: one row a term and task is shuffled.
    present = F.array_distinct(F.transform(_terms(F.coalesce(F.col("text"), F.lit(""))), lambda t: F.xxhash64(t)))
    found = checkpointed(files.select(F.explode(present).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    n = files.count()
    named = spark.createDataFrame([(t,) for t in vocabulary], "name string").select("name", F.xxhash64("name").alias("term"))
    df = {r["name"]: r["df"] for r in found.join(F.broadcast(named), "term").collect()}
    idf = {t: _idf(n, df.get(t, 0)) for t in vocabulary}
    rows = []
    for k, (name, body) in enumerate(ALL):
        tf = Counter(TERM.findall(body.lower()))
        norm = sum((c * idf[t]) ** 2 for t, c in tf.items()) ** 0.5
        rows += [(k, name, t, c * idf[t] / norm) for t, c in tf.items()]
    needed = marks(rows, df, min_cosine)
    mark = rf"(?i)(?<![a-z0-9])(?:{'|'.join(needed)})(?![a-z0-9])"
    weights = F.broadcast(spark.createDataFrame(rows, "template int, license string, name string, weight double").select("template", "license", F.xxhash64("name").alias("term"), "weight"))

    body = F.col("text")
    paragraphs = F.split(body, r"\n[ \t]*\n")
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(f"[^{SPACES}]"))
    some = F.filter(paragraphs, lambda p: F.contains(p, F.lit("\n")))
    whole = F.when(F.size(paragraphs) > 1, F.array(body)).otherwise(F.array().cast("array<string>"))
    units = F.concat(lines, some, whole)
    edge = (F.col("body") == F.col("_first")) | (F.col("body") == F.col("_last")) | (F.col("body") == F.col("text"))
    marked = files.where(F.coalesce(body.rlike(mark), F.lit(False)))
    # The null file has a name of its own here, as nulls are not joined.
    marked = marked.select(F.struct("file").alias("file"), "text", F.get(lines, F.lit(0)).alias("_first"), F.element_at(lines, -1).alias("_last"), F.explode(F.array_distinct(F.filter(units, lambda u: u.rlike(mark)))).alias("body"))
    marked = marked.select("file", F.xxhash64("body").alias("unit"), edge.alias("edge"), F.transform(_terms(F.col("body")), lambda t: F.xxhash64(t)).alias("terms")).distinct()
    tf = marked.select("file", "unit", "edge", F.explode("terms").alias("term")).groupBy("file", "unit", "term").agg(F.count(F.lit(1)).alias("tf"), F.max("edge").alias("edge"))
    tf = checkpointed(tf.join(found, "term").withColumn("x", F.col("tf") * (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1)).select("file", "unit", "term", "x", "edge"))
    norms = tf.groupBy("file", "unit").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"), F.max("edge").alias("edge"))
    dots = tf.join(weights, "term").groupBy("file", "unit", "template", "license").agg(F.sum(F.col("x") * F.col("weight")).alias("dot"))
    scored = dots.join(norms, ["file", "unit"]).select("file", "license", F.round(F.col("dot") / F.col("norm"), 6).alias("cosine"), "edge").where(F.col("cosine") >= min_cosine)
    best = scored.groupBy("file").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "license", (~F.col("edge")).alias("inside"))).alias("b"))
    return best.select("file.file", "b.license", (-F.col("b.c")).alias("cosine"), (~F.col("b.inside")).alias("edge"))


def _idf(n: int, df: int) -> float:
    return math.log((1 + n) / (1 + df)) + 1


def ancestors(path: Column) -> Column:
    """The directories above a file, nearest first, ending in the root, which is ''."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(k.alias("up"), F.array_join(F.slice(parts, F.lit(1), F.size(parts) - k), "/").alias("dir")))


def scan(files: DataFrame, **options) -> DataFrame:
    """Of each row of ``files`` (file, path, text): license, how (own, inherited, none), cosine and from_dir."""
    files = files.select("file", F.coalesce("path", F.lit("")).alias("path"), "text")
    own = checkpointed(own_licenses(files, **options)).withColumnRenamed("file", "_file")
    same = F.col("file").eqNullSafe(F.col("_file"))
    spoken = files.select("file", "path").join(own.where("edge"), same).select(F.element_at(ancestors(F.col("path")), 1)["dir"].alias("dir"), "license", "cosine")
    spoken = spoken.groupBy("dir").agg(F.min_by("license", F.struct(-F.col("cosine"), F.col("license"))).alias("dir_license"))
    # Directories, not files, are joined with the directories that speak: few rows however many files share one.
    dirs = files.select(F.element_at(ancestors(F.col("path")), 1)["dir"].alias("own_dir")).distinct()
    up = dirs.select("own_dir", F.explode(ancestors(F.concat("own_dir", F.when(F.col("own_dir") == "", "").otherwise("/"), F.lit("x")))).alias("a")).select("own_dir", "a.up", "a.dir")
    near = up.join(spoken, "dir").groupBy("own_dir").agg(F.min_by(F.struct("dir", "dir_license"), "up").alias("near"))
    out = files.select("file", "path", F.element_at(ancestors(F.col("path")), 1)["dir"].alias("own_dir")).join(own, same, "left").join(near, "own_dir", "left")
    has = F.col("license").isNotNull()
    return out.select(
        "file",
        "path",
        F.coalesce("license", F.col("near.dir_license")).alias("license"),
        F.when(has, "own").when(F.col("near").isNotNull(), "inherited").otherwise("none").alias("how"),
        F.coalesce("cosine", F.lit(0.0)).alias("cosine"),
        F.when(~has, F.col("near.dir")).alias("from_dir"),
    )


def op8_license_scans(spark, sf_dir: str) -> DataFrame:
    """Documents as files ``source/lang/doc_id``; a document that begins with its licence speaks for its directory."""
    docs = pick(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", "lang", "source")
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("unknown")), F.col("doc_id").cast("string"))
    return scan(docs.select(F.col("doc_id").alias("file"), path.alias("path"), "text")).withColumnRenamed("file", "doc_id")
