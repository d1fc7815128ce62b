"""License scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest ancestor directory.

DataFrame functions only. Units are the lines of a file, its paragraphs (runs of lines that hold a letter or digit) and, of a licence
file, its whole text. A template's anchors are terms without which the rest of it is shorter
than the threshold: a unit that has none of them can't reach it (Cauchy-Schwarz), so others are passed over at no loss.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialize

#: Least cosine of a match.
COSINE = 0.6
_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute,
sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"""
_MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_MIT_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR
OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN
THE SOFTWARE."""
_BSD_START = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_TWO = """1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or
other materials provided with the distribution."""
_BSD_NAME = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this
software without specific prior written permission."""
_BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR
CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF
SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT,
STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH
DAMAGE."""
_GPL_NOTICE = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} Public License as published by the
Free Software Foundation, either version 3 of the License, or (at your option) any later version."""
_GPL_COPY = "You should have received a copy of the GNU {0} Public License along with this program. If not, see <https://www.gnu.org/licenses/>."
#: Short statements, file headers, titles and texts of licences, as (licence, template). Of equal scores the longer template wins.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may
obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"""),
    ("Apache-2.0", """Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under
the License."""),
    ("MIT", "Released under the MIT License."),
    ("MIT", _MIT_GRANT),
    ("MIT", f"{_MIT_GRANT} {_MIT_NOTICE} {_MIT_WARRANTY}"),
    ("GPL", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL", _GPL_NOTICE.format("General")),
    ("GPL", _GPL_COPY.format("General")),
    ("LGPL", "This library is licensed under the GNU Lesser General Public License, version 3"),
    ("LGPL", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL", _GPL_NOTICE.format("Lesser General")),
    ("LGPL", _GPL_COPY.format("Lesser General")),
    ("AGPL", "This program is licensed under the GNU Affero General Public License, version 3"),
    ("AGPL", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("AGPL", _GPL_NOTICE.format("Affero General")),
    ("AGPL", _GPL_COPY.format("Affero General")),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD License"),
    ("BSD-2-Clause", f"{_BSD_START} {_BSD_TWO} {_BSD_WARRANTY}"),
    ("BSD-3-Clause", _BSD_NAME),
    ("BSD-3-Clause", f"{_BSD_START} {_BSD_TWO} {_BSD_NAME} {_BSD_WARRANTY}"),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
above copyright notice and this permission notice appear in all copies."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages
arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it
and redistribute it freely, subject to the following restrictions:"""),
    ("MPL-2.0", "This file is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
    ("CC-BY", "Licensed under CC BY 4.0"),
    ("CC-BY-SA", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC", "Licensed under CC BY-NC 4.0"),
    ("CC-BY", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC0", "Dedicated to the public domain under CC0 1.0 Universal"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("Proprietary", "All rights reserved."),
    ("Proprietary", "Copyright (c) All rights reserved."),
    *((name, f"SPDX-License-Identifier: {tag}") for name, tag in (
        ("Apache-2.0", "Apache-2.0"), ("MIT", "MIT"), ("GPL", "GPL-3.0"), ("GPL", "GPL-2.0"), ("LGPL", "LGPL-3.0"), ("LGPL", "LGPL-2.1"), ("AGPL", "AGPL-3.0"),
        ("BSD-2-Clause", "BSD-2-Clause"), ("BSD-3-Clause", "BSD-3-Clause"), ("ISC", "ISC"), ("Zlib", "Zlib"), ("MPL-2.0", "MPL-2.0"), ("CC-BY", "CC-BY-4.0"),
        ("CC-BY-SA", "CC-BY-SA-4.0"), ("CC-BY-NC", "CC-BY-NC-4.0"), ("CC0", "CC0-1.0"), ("Unlicense", "Unlicense"),
    )),
)
#: Everyday words, which are no anchors where a template can do without them.
EVERYDAY = frozenset("a an and are as at be by do for from in is it no not of on only or so that the this to was with".split())
TERM = r"[a-z0-9]+"
#: What parts paragraphs: line ends with nothing between them but signs and blanks.
GAP = r"\n(?:[^A-Za-z0-9\n]*\n)+"


def damped(n: int) -> float:
    """What n occurrences of a term count, so that a long text's everyday words don't outweigh its telling ones."""
    return 1 + math.log(n)


def template_terms(templates: tuple[tuple[str, str], ...] = TEMPLATES) -> tuple[list[tuple[int, str, float]], dict[str, float], float]:
    """(template number, term, unit weight) rows, the idf of each template term, and the idf of any other term."""
    bags = [Counter(re.findall(TERM, text.lower())) for _, text in templates]
    df = Counter(term for bag in bags for term in bag)
    idf = {term: math.log((1 + len(bags)) / (1 + n)) for term, n in df.items()}
    rows = []
    for number, bag in enumerate(bags):
        norm = math.sqrt(sum((damped(n) * idf[t]) ** 2 for t, n in bag.items()))
        rows += [(number, t, damped(n) * idf[t] / norm) for t, n in sorted(bag.items())]
    return rows, idf, math.log(1 + len(bags))


def preference(templates: tuple[tuple[str, str], ...] = TEMPLATES) -> list[int]:
    """Each template's place among equal scores, from 1: the longer is higher, then the one named first."""
    size = [len(re.findall(TERM, text.lower())) for _, text in templates]
    order = sorted(range(len(templates)), key=lambda k: (size[k], [-ord(c) for c in templates[k][0]], -k))
    return [order.index(k) + 1 for k in range(len(templates))]


def anchors(rows: list[tuple[int, str, float]], least: float = COSINE) -> list[str]:
    """Terms of which a unit must hold one to reach ``least`` with any template: each template goes without its everyday words and
    then its lightest terms as long as what it goes without is shorter than ``least``."""
    chosen: set[str] = set()
    for number in {r[0] for r in rows}:
        parts = sorted((t not in EVERYDAY, w, t) for n, t, w in rows if n == number)
        spare = 0.0
        for _, w, t in parts:
            if spare + w * w < least * least:
                spare += w * w
            else:
                chosen.add(t)
    return sorted(chosen)


def _branch(words: list[str]) -> str:
    """A pattern for any of the words that tries each first letter once."""
    if words == [""]:
        return ""
    heads = sorted({w[0] for w in words if w})
    parts = [h + _branch([w[1:] for w in words if w[:1] == h]) for h in heads]
    return f"(?:{'|'.join(parts)}){'?' if '' in words else ''}"


def match_units(units: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., place, score): each unit's best template by ``preference`` with a cosine of at least ``COSINE``, rounded to 9 digits.

    ``units`` holds keys, of which the first is unique to a file, and unit. Only terms and counts are shuffled, once, by file; the
    templates' terms are a fixed table.
    """
    rows, idf, other = template_terms()
    dense = {t: [0.0] * len(TEMPLATES) for t in idf}
    for number, term, w in rows:
        dense[term][number] = w
    table = [(t, idf[t], dense[t]) for t in sorted(idf)]
    table = F.broadcast(units.sparkSession.createDataFrame(table, "term string, idf double, w array<double>"))
    terms = units.select(*keys, F.explode(F.regexp_extract_all(F.lower("unit"), F.lit(TERM), F.lit(0))).alias("term"))
    terms = terms.repartition(keys[0]).groupBy(*keys, "term").agg((F.log(F.count(F.lit(1)).cast("double")) + 1.0).alias("n"))
    terms = terms.join(table, "term", "left").withColumn("x", F.col("n") * F.coalesce("idf", F.lit(other)))
    dots = [F.sum(F.col("x") * F.get("w", F.lit(k))).alias(f"d{k}") for k in range(len(TEMPLATES))]
    sums = terms.groupBy(*keys).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"), *dots)
    scored = (F.struct(F.round(F.col(f"d{k}") / F.col("norm"), 9).alias("score"), F.lit(p).alias("place")) for k, p in enumerate(preference()))
    best = sums.select(*keys, F.array_max(F.array(*scored)).alias("best"))
    return best.select(*keys, "best.place", "best.score").where(F.col("score") >= COSINE)


def scan(files: DataFrame, licence_name: str = r"(?i)^(licen[cs]e|copying|unlicense)") -> DataFrame:
    """(file_id, path, license, score, origin, from_path) for each row of ``files`` (file_id, path, text; others are not read).

    ``origin`` is ``own`` if a line or a paragraph of the file, or the whole of a licence file (by its base name), matches a template:
    the best score wins, then the longer template, then the first name. Otherwise ``inherited`` from the nearest directory at or above
    the file's that holds a matched licence file (of several, the best score, then the first path), else ``none``. A null path has no
    directory, a null or empty text no units. Whole texts are read, however long. Repeated rows stay repeated; an empty table gives an
    empty result.
    """
    anchored = f"(?i)(?<![a-z0-9]){_branch(anchors(template_terms()[0]))}(?![a-z0-9])"  # one pass over a text, whatever the number of anchors
    text, path = F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("path").cast("string")
    licence_file = F.coalesce(F.regexp_extract(path, r"[^/]*$", 0).rlike(licence_name), F.lit(False))
    base = files.select("file_id", path.alias("path"), text.alias("text"), licence_file.alias("licence_file"))
    base = base.select("file_id", "path", "licence_file", "text", F.when(F.col("text").rlike(anchored), F.sha2(F.concat_ws("/", F.col("file_id").cast("string"), "path", "text"), 256)).alias("uid"))
    held = lambda parts: F.filter(parts, lambda u: u.rlike(anchored))
    whole = F.when(F.col("licence_file"), F.array("text")).otherwise(F.array().cast("array<string>"))
    units = F.array_distinct(F.concat(held(F.split("text", r"\n")), held(F.split("text", GAP)), whole))
    units = base.where("uid is not null").select("uid", F.posexplode(units).alias("pos", "unit"))
    best = match_units(units, ["uid", "pos"]).groupBy("uid").agg(F.max(F.struct("score", "place")).alias("best"))
    names = F.array(*(F.lit(n) for _, n in sorted(zip(preference(), (n for n, _ in TEMPLATES), strict=True))))
    own = best.select("uid", F.get(names, F.col("best.place") - 1).alias("license"), "best.score")
    slim = base.select("file_id", "path", "licence_file", "uid", F.regexp_replace("path", r"/?[^/]*$", "").alias("dir"))
    slim = materialize(slim.join(own, "uid", "left").drop("uid"), "license-own")  # a row a file, without its text: what follows reads it several times

    first = Window.partitionBy("dir").orderBy(F.desc("score"), "path", "license")
    held = slim.where("licence_file and license is not null").withColumn("at", F.row_number().over(first)).where("at = 1")
    held = held.select(F.col("dir").alias("up"), F.col("license").alias("d_license"), F.col("score").alias("d_score"), F.col("path").alias("from_path"))
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    dirs = slim.select("dir").where("dir is not null").distinct().select("dir", F.explode(F.array_distinct(F.concat(above, F.array("dir")))).alias("up"))
    near = Window.partitionBy("dir").orderBy(F.desc(F.length("up")))
    given = dirs.join(held, "up").withColumn("at", F.row_number().over(near)).where("at = 1").drop("at", "up")
    out = slim.join(given, "dir", "left")
    origin = F.when(F.col("license").isNotNull(), "own").when(F.col("d_license").isNotNull(), "inherited").otherwise("none")
    return out.select(
        "file_id",
        "path",
        F.coalesce("license", "d_license").alias("license"),
        F.coalesce("score", "d_score").alias("score"),
        origin.alias("origin"),
        F.when(origin == "inherited", F.col("from_path")).alias("from_path"),
    )


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    """The documents table names no files, so paths are made from source and doc_id: every seventh document is its directory's licence
    file, every 49th that of the directory above, every 343rd that of the source."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = F.expr(
        "concat(source, case when doc_id % 343 = 0 then '' when doc_id % 49 = 0 then concat('/', doc_id div 5000) else concat('/', doc_id div 5000, '/', doc_id div 500) end, "
        "case when doc_id % 7 = 0 then concat('/LICENSE-', doc_id) else concat('/', doc_id, '.txt') end)"
    )
    found = scan(docs.select(F.col("doc_id").alias("file_id"), path.alias("path"), "text"))
    return found.withColumnRenamed("file_id", "doc_id")


def _op2_sql() -> str:
    rows, idf, other = template_terms()
    weights = ", ".join(f"({n}, '{t}', {w!r})" for n, t, w in rows)
    idfs = ", ".join(f"('{t}', {x!r})" for t, x in sorted(idf.items()))
    names = ", ".join(f"({k}, '{name}', {p})" for k, ((name, _), p) in enumerate(zip(TEMPLATES, preference(), strict=True)))
    return rf"""
WITH weights AS (SELECT template, term, CAST(w AS DOUBLE) AS w FROM (VALUES {weights}) AS v(template, term, w)),
idfs AS (SELECT term, CAST(idf AS DOUBLE) AS idf FROM (VALUES {idfs}) AS v(term, idf)),
names AS (SELECT template, license, place FROM (VALUES {names}) AS v(template, license, place)),
f AS (
  SELECT doc_id, text, doc_id % 7 = 0 AS licence_file,
    source || CASE WHEN doc_id % 343 = 0 THEN '' WHEN doc_id % 49 = 0 THEN '/' || (doc_id // 5000)
                   ELSE '/' || (doc_id // 5000) || '/' || (doc_id // 500) END AS dir
  FROM documents
), p AS (
  SELECT *, dir || CASE WHEN licence_file THEN '/LICENSE-' || doc_id ELSE '/' || doc_id || '.txt' END AS path FROM f
), u AS (
  SELECT DISTINCT doc_id, unit FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS unit FROM p UNION ALL SELECT doc_id, unnest(regexp_split_to_array(text, '{GAP}')) FROM p
    UNION ALL SELECT doc_id, text FROM p WHERE licence_file)
), t AS (
  SELECT doc_id, unit, term, count(*) AS n FROM (SELECT doc_id, unit, unnest(regexp_extract_all(lower(unit), '[a-z0-9]+')) AS term FROM u) GROUP BY ALL
), x AS (
  SELECT doc_id, unit, t.term, (1 + ln(n)) * coalesce(idf, CAST({other!r} AS DOUBLE)) AS x FROM t LEFT JOIN idfs ON t.term = idfs.term
), m AS (SELECT doc_id, unit, sqrt(sum(x * x)) AS norm FROM x GROUP BY ALL),
s AS (
  SELECT x.doc_id, x.unit, license, place, round(sum(x * w) / any_value(norm), 9) AS score
  FROM x JOIN weights ON x.term = weights.term JOIN names USING (template) JOIN m ON x.doc_id = m.doc_id AND x.unit = m.unit GROUP BY x.doc_id, x.unit, template, license, place
), own AS (
  SELECT doc_id, license, score FROM s WHERE score >= {COSINE}
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, place DESC) = 1
), held AS (
  SELECT dir AS up, license, score, path FROM p JOIN own USING (doc_id) WHERE licence_file
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, path, license) = 1
), given AS (
  SELECT p.doc_id, held.license, held.score, held.path FROM p JOIN held ON p.dir = held.up OR starts_with(p.dir, held.up || '/')
  QUALIFY row_number() OVER (PARTITION BY p.doc_id ORDER BY length(held.up) DESC) = 1
)
SELECT p.doc_id, p.path, coalesce(own.license, given.license) AS license, coalesce(own.score, given.score) AS score,
  CASE WHEN own.license IS NOT NULL THEN 'own' WHEN given.license IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
  CASE WHEN own.license IS NULL THEN given.path END AS from_path
FROM p LEFT JOIN own ON p.doc_id = own.doc_id LEFT JOIN given ON p.doc_id = given.doc_id
"""


OP2_SQL = _op2_sql()
