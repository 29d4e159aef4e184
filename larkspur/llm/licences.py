"""Licence scans: TF-IDF cosine of notices to templates, then inheritance from the nearest directory.

Only DataFrame functions. In a text of any length that holds a cue (a word that every template has),
candidates are the whole text, each line and each block of lines with a cue, which are compared with
every template (notices, tags, header blocks and whole licence files), and each run of words around
a cue word that is as long as some notice, which is compared with the notices of its length. Runs
and blocks go over line ends and comment signs, so wrapped headers and notices inside paragraphs are
found. Each becomes a sparse TF-IDF vector, weighted by the templates; the best cosine at or above
`least` gives the file's own licence. A directory's licence is that of its best-matching file, then of the first by
path. A file without a licence of its own takes that of the nearest ancestor directory that has
one: the ancestors of each distinct directory are joined with the licensed directories by path, so
the join is over directories, not files.

Templates and their terms are constants of this module, a few hundred rows, and the only broadcast
by hint; directories are joined as their measured size allows.

Defined cases: null and empty texts have no licence of their own and may inherit; very long texts
are compared whole like any other; a null path is the root; ties between templates go to the id that
sorts first; repeated rows get equal results; an empty table gives no rows; columns of the input
that have the result's names are replaced, others stay.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: fixed values: licence ids and their usual notices, headings and tags
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("BSD-3-Clause", "This source code is governed by a BSD-style license"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C)"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "SPDX-License-Identifier: CC-BY-4.0"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-or-later"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0-or-later"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
)
#: fixed values: licence ids and the words of whole licence files and header blocks
TEXTS = (
    ("MIT", """MIT License Copyright (c) Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be
included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO
EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT
OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("BSD-3-Clause", """Copyright (c) All rights reserved. Redistribution and use in source and binary forms, with or without modification, are
permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this
list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list
of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the
name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software
without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR
IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR
BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("ISC", """ISC License Copyright (c) Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS
AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN
NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION
WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the
License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed
to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is
distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS
FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public
License along with this program. If not, see http://www.gnu.org/licenses/"""),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
with this file, You can obtain one at http://mozilla.org/MPL/2.0/"""),
)
TEMPLATES = NOTICES + TEXTS
CUE = r"(?i)licen[cs]e|copyright|permission is hereby|redistribution and use"
WORD = r"[a-z0-9]+(?:[.\-][a-z0-9]+)*"
LEAST = 0.6
CUE_TERM = r"licen[cs]e|copyright|^permission$|^redistribution$"
#: blocks of lines, which lines without a letter or digit part, comment signs or not
BLOCK_END = r"\n[^A-Za-z0-9\n]*(?=\n)"
RUN = 5  # shorter notices stand on lines of their own
SIZES = [len(re.findall(WORD, notice.lower())) for _, notice in TEMPLATES]
RUNS = sorted({n for n in SIZES[: len(NOTICES)] if n >= RUN})


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def _values() -> str:
    return ", ".join(f"({k}, '{name}', '{text}')" for k, (name, text) in enumerate(TEMPLATES))


def _vectors() -> tuple[dict[str, float], list[dict[str, float]]]:
    """idf of every term of the templates, and each template's weights: tf * idf over the vector's length."""
    counts = [Counter(re.findall(WORD, notice.lower())) for _, notice in TEMPLATES]
    idf = {t: math.log((1 + len(TEMPLATES)) / (1 + sum(t in c for c in counts))) + 1 for c in counts for t in c}
    out = []
    for c in counts:
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in c.items()))
        out.append({t: n * idf[t] / norm for t, n in c.items()})
    return idf, out


IDF, WEIGHTS = _vectors()
RARE = math.log(1 + len(TEMPLATES)) + 1  # of a term that no template has


def templates(spark: SparkSession) -> DataFrame:
    """term, idf and its weight in each template: a few hundred constant rows."""
    rows = ", ".join(f"('{t}', {x!r}D, array({', '.join(f'{w.get(t, 0.0)!r}D' for w in WEIGHTS)}))" for t, x in IDF.items())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(term, idf, weights)")


def _lookup(values: dict[str, float], other: float, term: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), term), F.lit(other))


def of_runs(held: DataFrame, least: float) -> DataFrame:
    """path and the best (-cosine, licence) of its runs of words: each run that holds a cue word and is as long as some notice, against the notices of its length.

    Worked out within the row: the words around a cue get their weights once, and each run is a slice of them.
    """
    far = RUNS[-1] - 1
    words = held.select("path", _terms(F.col("text")).alias("terms"))
    at = F.filter(F.transform("terms", lambda x, i: F.when(x.rlike(CUE_TERM), i)), lambda i: i.isNotNull())
    # the words around each cue, equal surroundings of a text once, and where the cue is in them
    near = F.transform(at, lambda i: F.struct(F.slice("terms", F.greatest(i - far, F.lit(0)) + 1, F.least(i, F.lit(far)) + 1 + far).alias("near"), F.least(i, F.lit(far)).alias("cue")))
    near = words.select("path", F.inline(F.array_distinct(near)))
    of = [k for k in range(len(NOTICES)) if SIZES[k] in RUNS]
    # a cosine is at most the length of the notice's vector over the words that are there at all, which rules most notices out
    there = lambda k: sum((F.when(F.array_contains("near", t), w * w).otherwise(0.0) for t, w in WEIGHTS[k].items()), F.lit(0.0))
    possible = F.array_compact(F.array(*[F.when(there(k) >= least * least - 1e-9, F.lit(k)) for k in of]))
    weights = ", ".join(f"({k}, {SIZES[k]}, '{TEMPLATES[k][0]}', map({', '.join(f'{t!r}, {w!r}D' for t, w in WEIGHTS[k].items())}))" for k in of)
    notices = held.sparkSession.sql(f"SELECT * FROM VALUES {weights} AS t(k, size, licence, weights)")
    near = near.select("path", "near", "cue", F.explode(possible).alias("k")).join(F.broadcast(notices), "k")
    near = near.withColumn("idf", F.transform("near", lambda t: _lookup({t_: IDF[t_] for k in of for t_ in WEIGHTS[k]}, RARE, t)))
    near = near.withColumn("dots", F.transform("near", lambda t, i: F.get("idf", i) * F.coalesce(F.element_at("weights", t), F.lit(0.0))))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    starts = F.sequence(F.greatest(F.col("cue") - F.col("size") + 1, F.lit(0)), F.col("cue"))
    runs = near.select("path", "licence", F.explode(starts).alias("p"), "near", "idf", "dots", "size")
    runs = runs.select("path", "licence", total(F.slice("dots", F.col("p") + 1, F.col("size"))).alias("dot"), F.slice("idf", F.col("p") + 1, F.col("size")).alias("idf"), F.slice("near", F.col("p") + 1, F.col("size")).alias("run"))
    square = total(F.transform("run", lambda t, i: F.get("idf", i) * F.get("idf", i) * F.size(F.filter("run", lambda y: y == t))))
    scored = runs.select("path", F.struct((-F.round(F.col("dot") / F.sqrt(square), 9)).alias("c"), "licence").alias("b")).where(F.col("b.c") <= -least)
    return scored.groupBy("path").agg(F.min("b").alias("b"))


def of_pieces(held: DataFrame, least: float) -> DataFrame:
    """path and the best (-cosine, licence) of its whole text, lines and blocks with a cue, against every template.

    Only the words that some template has are exploded; the others count in the length, by the sum of
    the squares of how often each stands there, which is folded over the sorted words.
    """
    known = templates(held.sparkSession)
    pieces = F.array_union(F.split("text", "\n"), F.split("text", BLOCK_END))
    parts = held.select("path", F.explode(F.array_union(F.filter(pieces, lambda x: x.rlike(CUE)), F.array("text"))).alias("part")).select("path", F.array_sort(_terms(F.col("part"))).alias("terms"))
    start = F.struct(F.lit("").alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))

    def step(s: Column, x: Column) -> Column:
        run = F.when(x == s["last"], s["run"] + 1.0).otherwise(F.lit(1.0))
        return F.struct(x.alias("last"), run.alias("run"), (s["sum"] + 2.0 * run - 1.0).alias("sum"))

    squares = F.aggregate("terms", start, step, lambda s: s["sum"])
    parts = parts.select("path", squares.alias("squares"), F.filter("terms", lambda t: t.isin(*IDF)).alias("terms")).withColumn("part", F.monotonically_increasing_id())
    tf = parts.select("path", "part", "squares", F.explode("terms").alias("term")).groupBy("path", "part", "squares", "term").agg(F.count("*").cast("double").alias("tf"))
    w = tf.join(F.broadcast(known), "term").withColumn("w", F.col("tf") * F.col("idf"))
    dots = [F.sum(F.col("w") * F.col("weights")[k]) for k in range(len(TEMPLATES))]
    square = F.sum(F.col("w") * F.col("w")) + RARE * RARE * (F.first("squares") - F.sum(F.col("tf") * F.col("tf")))
    vector = w.groupBy("path", "part").agg(F.sqrt(square).alias("norm"), F.array(*dots).alias("dots"))
    names = F.array(*[F.lit(name) for name, _ in TEMPLATES])
    fits = F.filter(F.transform("dots", lambda x, k: F.struct((-F.round(x / F.col("norm"), 9)).alias("c"), F.get(names, k).alias("licence"))), lambda x: x["c"] <= -least)
    return vector.select("path", F.array_min(fits).alias("b")).where("b is not null").groupBy("path").agg(F.min("b").alias("b"))


def own(files: DataFrame, least: float = LEAST) -> DataFrame:
    """path, licence and cosine of the files that have a licence of their own; one row for each path."""
    held = files.where(F.col("text").rlike(CUE))
    best = of_pieces(held, least).unionByName(of_runs(held, least)).groupBy("path").agg(F.min("b").alias("b"))
    return best.select("path", F.col("b.licence").alias("licence"), (-F.col("b.c")).alias("cosine"))


def _dir(path: str = "path") -> Column:
    return F.regexp_extract(F.col(path), r"^(.*)/[^/]*$", 1)


FOUND = ("dir", "licence", "cosine", "origin", "licence_dir")


def scan(files: DataFrame, least: float = LEAST) -> DataFrame:
    """files' rows with dir, licence, cosine, and origin: own, inherited or none, and licence_dir, where it comes from.

    These replace columns of files that have their names.
    """
    files = files.drop(*FOUND).withColumn("path", F.coalesce("path", F.lit(""))).withColumn("dir", _dir())
    columns = [c for c in files.columns if c != "text"]
    mine = own(files.select("path", "text"), least)
    licensed = mine.withColumn("dir", _dir()).groupBy("dir").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "path", "licence")).alias("b")).select(F.col("dir").alias("licence_dir"), F.col("b.licence").alias("from_dir"))
    dirs = files.select("dir").distinct()
    parts = F.split("dir", "/")
    ancestors = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    # one row for each of a directory's ancestors; the root, which all have, is one row and met apart
    root = licensed.where("licence_dir = ''").select(F.col("licence_dir").alias("_root"), F.col("from_dir").alias("root_licence"))
    near = dirs.select("dir", F.posexplode(F.array_distinct(ancestors)).alias("depth", "licence_dir")).where("licence_dir <> ''").join(licensed, "licence_dir")
    near = near.groupBy("dir").agg(F.max(F.struct("depth", "licence_dir", "from_dir")).alias("b")).select("dir", F.col("b.licence_dir").alias("licence_dir"), F.col("b.from_dir").alias("from_dir"))
    out = files.select(columns).join(mine, "path", "left").join(near, "dir", "left").join(F.broadcast(root), F.substring("dir", 1, 0) == F.col("_root"), "left")
    has, under = F.col("licence").isNotNull(), F.col("from_dir").isNotNull()
    return out.select(
        *columns, F.coalesce("licence", "from_dir", "root_licence").alias("licence"), "cosine",
        F.when(has, "own").when(under | F.col("root_licence").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(has, F.col("dir")).when(under, F.col("licence_dir")).when(F.col("root_licence").isNotNull(), "").alias("licence_dir"),
    )


def digest(docs: DataFrame) -> DataFrame:
    """documents as files: a directory for each source, language in it, and shelf of 64 ids in that."""
    path = F.concat_ws("/", F.coalesce("source", F.lit("_")), F.coalesce("lang", F.lit("_")), F.coalesce(F.expr("doc_id div 64").cast("string"), F.lit("_")), F.coalesce(F.col("doc_id").cast("string"), F.lit("_")))
    return scan(docs.select("doc_id", path.alias("path"), "text"))


def oracle() -> str:
    n = len(TEMPLATES)
    return rf"""
WITH t(template, licence, notice) AS (VALUES {_values()}),
ttf AS (SELECT template, licence, term, count(*) AS tf FROM (SELECT template, licence, unnest(regexp_extract_all(lower(notice), '{WORD}')) AS term FROM t) GROUP BY ALL),
tsize AS (SELECT template, sum(tf) AS n FROM ttf GROUP BY template),
idf AS (SELECT term, ln({n + 1}.0 / (1 + count(DISTINCT template))) + 1 AS idf FROM ttf GROUP BY term),
tw AS (SELECT template, licence, term, tf * idf AS w FROM ttf JOIN idf USING (term)),
tn AS (SELECT template, sqrt(sum(w * w)) AS norm FROM tw GROUP BY template),
known AS (SELECT template, licence, term, n, w / norm AS weight FROM tw JOIN tn USING (template) JOIN tsize USING (template)),
f AS (SELECT doc_id, concat_ws('/', coalesce(source, '_'), coalesce(lang, '_'), coalesce((doc_id // 64)::VARCHAR, '_')) AS dir, coalesce(text, '') AS text FROM documents),
files AS (SELECT *, dir || '/' || coalesce(doc_id::VARCHAR, '_') AS path FROM f),
held AS (SELECT path, text, regexp_extract_all(lower(text), '{WORD}') AS terms FROM files WHERE regexp_matches(text, '{CUE}')),
pieces AS (SELECT path, unnest(list_filter(list_concat(string_split(text, chr(10)), string_split_regex(regexp_replace(text, '\n(?:[^A-Za-z0-9\n]*\n)+', chr(1), 'g'), chr(1))), lambda x: regexp_matches(x, '{CUE}'))) AS piece FROM held
  UNION SELECT path, text FROM held),
cues AS (SELECT path, terms, unnest(list_filter(range(len(terms)), lambda i: regexp_matches(terms[i + 1], '{CUE_TERM}'))) AS i FROM held),
sizes AS (SELECT unnest([{", ".join(map(str, RUNS))}]) AS n),
starts AS (SELECT DISTINCT path, terms, n, unnest(range(greatest(i - n + 1, 0), i + 1)) AS k FROM cues, sizes),
cand AS (SELECT path, NULL AS size, regexp_extract_all(lower(piece), '{WORD}') AS terms FROM pieces
  UNION SELECT path, n AS size, list_slice(terms, k + 1, k + n) FROM starts),
parts AS (SELECT path, size, terms, row_number() OVER () AS part FROM cand),
htf AS (SELECT path, part, size, term, count(*) AS tf FROM (SELECT path, part, size, unnest(terms) AS term FROM parts) GROUP BY ALL),
hw AS (SELECT path, part, size, term, tf * coalesce(idf, ln({n + 1}.0) + 1) AS w FROM htf LEFT JOIN idf USING (term)),
hn AS (SELECT path, part, sqrt(sum(w * w)) AS norm FROM hw GROUP BY ALL),
scored AS (SELECT path, licence, round(sum(w * weight) / any_value(norm), 9) AS cosine FROM hw JOIN hn USING (path, part) JOIN known USING (term) WHERE size IS NULL OR size = n GROUP BY path, part, template, licence),
mine AS (SELECT path, licence, cosine FROM scored WHERE cosine >= {LEAST} QUALIFY row_number() OVER (PARTITION BY path ORDER BY cosine DESC, licence) = 1),
licensed AS (SELECT dir, licence FROM mine JOIN files USING (path) QUALIFY row_number() OVER (PARTITION BY dir ORDER BY cosine DESC, path) = 1),
near AS (SELECT d.dir, l.dir AS licence_dir, l.licence AS from_dir FROM (SELECT DISTINCT dir FROM files) d JOIN licensed l ON d.dir = l.dir OR starts_with(d.dir, l.dir || '/') OR l.dir = ''
  QUALIFY row_number() OVER (PARTITION BY d.dir ORDER BY length(l.dir) DESC) = 1)
SELECT f.doc_id, f.path, f.dir, coalesce(m.licence, n.from_dir) AS licence, m.cosine, CASE WHEN m.licence IS NOT NULL THEN 'own' WHEN n.from_dir IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
       CASE WHEN m.licence IS NOT NULL THEN f.dir ELSE n.licence_dir END AS licence_dir
FROM files f LEFT JOIN mine m USING (path) LEFT JOIN near n ON n.dir = f.dir
"""
