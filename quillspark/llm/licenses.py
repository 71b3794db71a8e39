"""Licence scans: TF-IDF cosine of notices to templates, then inheritance from directories, in DataFrame functions only.

Every line that could be a notice is compared with every template by sparse vectors joined on words; word frequencies are
counted over all such lines of all files. Every header (comment block or first paragraph) and every whole licence file is
one vector too, without a filter, compared with usual headers and whole texts; its words weigh as in those. A file without a licence of its own gets that of the licence file in the nearest
directory above it.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from functools import cache
from math import log, sqrt
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Licence and a notice or an opening sentence of its text.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("proprietary", "All rights reserved."),
)
#: A line with one of these may be a notice: fixed values.
MAYBE = r"(?i)\b(licen[cs]ed?|copyright|rights reserved|permission is hereby|redistribution and use|released under)\b"
#: Names of files that hold a directory's licence: fixed values.
FILE_NAMES = r"(?i)^(licen[cs]e|copying|notice|unlicense)(\.(txt|md|rst))?$"
#: Licence and a usual header, title or short text. Those of long texts are counted in ``license_words.json``.
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. {} THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0}General Public License for more details. You should have received a copy of the GNU {0}General Public License along with this program. If not, see https://www.gnu.org/licenses/."
_APACHE = "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
HEADERS = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); " + _APACHE),
    ("Apache-2.0", "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership. The ASF licenses this file to You under the Apache License, Version 2.0 (the License); " + _APACHE),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("MIT", "MIT License " + _MIT),
    ("BSD-2-Clause", _BSD.format("")),
    ("BSD-3-Clause", _BSD.format("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.")),
    ("ISC", "ISC License Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("GPL-2.0", _GPL.format("", "2")),
    ("GPL-3.0", _GPL.format("", "3")),
    ("LGPL-2.1", _GPL.format("Lesser ", "2.1")),
    ("LGPL-3.0", _GPL.format("Lesser ", "3")),
    ("AGPL-3.0", _GPL.format("Affero ", "3")),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL", "GNU GENERAL PUBLIC LICENSE"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("proprietary", "Copyright (c) Inc. All rights reserved."),
    *((x, f"SPDX-License-Identifier: {x}") for x in ("Apache-2.0", "MIT", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0")),
)
#: What begins a line of comment, and what may end it: fixed values.
COMMENT = r"^[ \t]*(?:#+|//+|/?\*+/?|--+|;+|%+|<!--|\"\"\"|REM\b)"
WORD = "[a-z0-9]+"
THRESHOLD = 0.7


def _vectors(lines: DataFrame, key: str) -> DataFrame:
    """(key, word, tf) of ``lines(key, line)``."""
    return lines.select(key, F.explode(F.expr(f"regexp_extract_all(lower(line), '{WORD}', 0)")).alias("word")).groupBy(key, "word").agg(F.count("*").alias("tf"))


def notices(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(path, license, score): for each file of ``files(path, text)`` with a notice the likeliest licence, by score and name."""
    spark = files.sparkSession
    found = files.where("path IS NOT NULL AND text IS NOT NULL").select("path", F.explode(F.filter(F.split("text", "\n"), lambda x: x.rlike(MAYBE))).alias("line"))
    found = written(found, "notices")
    distinct = written(found.groupBy("line").agg(F.count("*").alias("n")), "lines")
    words = written(_vectors(distinct, "line"), "words")
    total = distinct.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    spread = words.join(distinct, "line").groupBy("word").agg(F.sum("n").alias("df"))
    idf = lambda df: F.log((F.lit(1.0) + total) / (F.lit(1.0) + df)) + 1.0
    spread = written(spread.select("word", idf(F.col("df")).alias("idf")), "idf")
    # fixed templates: eleven, at most a few dozen words each
    model = spark.createDataFrame([(k, lic, text) for k, (lic, text) in enumerate(TEMPLATES)], "template int, license string, line string")
    tw = _vectors(model, "template").join(spread, "word", "left").select("template", "word", (F.col("tf") * F.coalesce("idf", idf(F.lit(0)))).alias("tw"))
    tn = tw.groupBy("template").agg(F.sqrt(F.sum(F.col("tw") * F.col("tw"))).alias("tn"))
    templates = written(tw.join(tn, "template").join(model.select("template", "license"), "template").select("template", "license", "word", (F.col("tw") / F.col("tn")).alias("tw")), "templates")
    weighted = words.join(spread, "word").select("line", "word", (F.col("tf") * F.col("idf")).alias("w"))
    norms = weighted.groupBy("line").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = weighted.join(F.broadcast(templates), "word").groupBy("line", "template", "license").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
    scored = dots.join(norms, "line").select("line", "license", F.round(F.col("dot") / F.col("norm"), 6).alias("score")).where(F.col("score") >= threshold)
    best = written(scored.groupBy("line").agg(F.min(F.struct((-F.col("score")).alias("minus"), "license")).alias("b")).select("line", "b"), "best")
    return found.join(best, "line").groupBy("path").agg(F.min("b").alias("b")).select("path", F.col("b.license").alias("license"), (-F.col("b.minus")).alias("score"))


@cache
def whole_templates() -> tuple[list[tuple[int, str, str, float]], list[tuple[str, float]], float]:
    """(template, license, word, weight) of headers and whole texts as unit vectors, each word's weight, and that of others."""
    counts = [(lic, Counter(re.findall(WORD, text.lower()))) for lic, text in (*TEMPLATES, *HEADERS)]
    counts += [(lic, Counter(words)) for lic, words in json.loads(Path(__file__).with_name("license_words.json").read_text())]
    df = Counter(w for _, c in counts for w in c)
    idf = {w: log((1 + len(counts)) / (1 + n)) + 1 for w, n in df.items()}
    rows = []
    for k, (lic, c) in enumerate(counts):
        norm = sqrt(sum((n * idf[w]) ** 2 for w, n in c.items()))
        rows += [(k, lic, w, n * idf[w] / norm) for w, n in c.items()]
    return rows, sorted(idf.items()), log(1 + len(counts)) + 1


def headers_of(path: Column, text: Column) -> Column:
    """The blocks of a file: each run of comment lines, each comment between marks, the first paragraph, a whole licence file."""
    runs = F.split(F.array_join(F.transform(F.split(text, "\n"), lambda x: F.when(x.rlike(COMMENT), F.regexp_replace(x, COMMENT, " ")).otherwise("\0")), "\n"), "\0")
    marked = F.regexp_extract_all(text, F.lit(r"(?s)/\*(.*?)\*/|<!--(.*?)-->"), F.lit(0))
    first = F.split(F.regexp_replace(text, r"^\s+", ""), r"\n[ \t\r]*\n", 2)[0]
    whole = F.when(F.regexp_extract(path, "[^/]*$", 0).rlike(FILE_NAMES), F.array(text)).otherwise(F.array())
    return F.array_distinct(F.filter(F.concat(runs, marked, F.array(first), whole), lambda x: x.rlike("[A-Za-z0-9]")))


def _blocks(files: DataFrame) -> DataFrame:
    """(id, path, block) of ``files(path, text)``; equal blocks of equal paths have one id."""
    return files.select("path", F.explode(headers_of(F.col("path"), F.col("text"))).alias("block")).select(F.xxhash64("path", "block").alias("id"), "path", "block")


def _words(blocks: DataFrame) -> DataFrame:
    """(id, path, lines, word, tf, first) for each different word of each of ``_blocks``, counted without a shuffle: equal words of the sorted text are one match."""
    text = F.concat(F.array_join(F.sort_array(F.regexp_extract_all(F.lower("block"), F.lit(WORD), F.lit(0))), " "), F.lit(" "))
    runs = F.regexp_extract_all(text, F.lit(rf"({WORD} )\1*"), F.lit(0))
    # once a block: what stands beside an explode is computed again for each word
    made = F.struct("id", "path", (F.size(F.regexp_extract_all("block", F.lit(r"[A-Za-z0-9][^\n]*"), F.lit(0))) > 1).alias("lines"), runs.alias("runs"))
    words = blocks.select(F.explode(F.array(made)).alias("x")).select("x.id", "x.path", "x.lines", F.posexplode("x.runs").alias("i", "run"))
    return words.select("id", "path", "lines", F.substring_index("run", " ", 1).alias("word"), (F.length("run") / F.instr("run", " ")).alias("tf"), (F.col("i") == 0).alias("first"))


def header_notices(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(path, license, score, lines): for each file of ``files(path, text)`` the likeliest licence of a header or of the whole."""
    spark = files.sparkSession
    rows, weights, other = whole_templates()
    vectors = F.broadcast(spark.createDataFrame(rows, "template int, license string, word string, tw double"))  # fixed: some thousand rows
    most = {}
    for _, _, word, weight in rows:
        most[word] = max(weight, most.get(word, 0.0))
    idf = F.broadcast(spark.createDataFrame([(w, x, most[w]) for w, x in weights], "word string, idf double, most double"))
    files = files.where("path IS NOT NULL AND text IS NOT NULL").select("path", "text")
    # no cosine exceeds the share of the norm that known words have, and no template's product with a block the sum of its words' weights times the largest that any template gives each
    w = F.col("tf") * F.coalesce("idf", F.lit(other))
    known = F.col("idf").isNotNull()
    sums = [F.sum(x).alias(n) for n, x in (("copies", F.col("first").cast("long")), ("square", w * w), ("known", F.when(known, w * w).otherwise(0.0)), ("bound", F.when(known, w * F.col("most")).otherwise(0.0)))]
    # numbers only: an aggregate of a string would sort all words
    bounds = _words(_blocks(files)).join(idf, "word", "left").groupBy("id", "path", "lines").agg(*sums)
    # equal blocks of one path are one block: sums are divided by their number
    bounds = bounds.select("id", "path", "lines", "copies", F.sqrt(F.col("square") / F.col("copies")).alias("norm"), F.sqrt(F.col("known") / F.col("copies")).alias("known"), (F.col("bound") / F.col("copies")).alias("bound"))
    able = written(bounds.where(F.least("bound", "known") >= (threshold - 1e-5) * F.col("norm")).select("id", "path", "lines", "copies", "norm"), "headers")
    again = _blocks(files.join(able.select("path").distinct(), "path", "left_semi")).join(able.select("id"), "id", "left_semi")
    dots = _words(again).join(vectors, "word").join(idf.select("word", "idf"), "word").groupBy("id", "template", "license").agg(F.sum(F.col("tf") * F.col("idf") * F.col("tw")).alias("dot"))
    scored = dots.join(able, "id").select("path", "lines", "license", F.round(F.col("dot") / F.col("copies") / F.col("norm"), 6).alias("score")).where(F.col("score") >= threshold)
    best = scored.groupBy("path").agg(F.min(F.struct((~F.col("lines")).alias("one"), (-F.col("score")).alias("minus"), "license")).alias("b"))
    return best.select("path", F.col("b.license").alias("license"), (-F.col("b.minus")).alias("score"), (~F.col("b.one")).alias("lines"))


def scan(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """path, own_license, own_score, inherited_from and license for every row of ``files(path, text)``.

    Without a notice, ``own_license`` is null; ``license`` then is that of the nearest directory at or above the file that
    has a licence file with a notice (of several in one directory the best score, then name), ``inherited_from`` that
    directory ('' is the root); null where there is none. Null paths have no licence. Repeated rows stay; of files with
    one path the best notice counts for each. Other columns are kept unless they have one of these names.
    """
    added = ["own_license", "own_score", "inherited_from", "license"]
    files = files.drop(*added, "__dir", "__b")
    # a header or file of several lines outranks single lines, which may be parts of it; one of one line is a line
    single = notices(files.select("path", "text"), threshold).withColumnsRenamed({"license": "l1", "score": "s1"})
    both = single.join(header_notices(files.select("path", "text"), threshold), "path", "full")
    header = F.col("license").isNotNull() & (F.col("lines") | F.col("l1").isNull())
    own = both.select("path", F.when(header, F.col("license")).otherwise(F.col("l1")).alias("license"), F.when(header, F.col("score")).otherwise(F.col("s1")).alias("score"))
    own = written(own, "own")
    folder = F.regexp_replace("path", "(^|/)[^/]*$", "")
    base = F.regexp_extract("path", "[^/]*$", 0)
    holders = written(own.where(base.rlike(FILE_NAMES)).groupBy(folder.alias("holder")).agg(F.min(F.struct((-F.col("score")).alias("minus"), "license")).alias("b")).select("holder", F.col("b.license").alias("inherited")), "holders")
    # distinct directories are joined with those above them; a file then meets one row
    dirs = files.where("path IS NOT NULL").select(folder.alias("__dir")).distinct()
    above = dirs.select("__dir", F.explode(F.expr("transform(sequence(0, size(split(__dir, '/'))), k -> array_join(slice(split(__dir, '/'), 1, k), '/'))")).alias("holder"))
    nearest = above.join(holders, "holder").groupBy("__dir").agg(F.max(F.struct(F.length("holder").alias("n"), "holder", "inherited")).alias("__b"))
    nearest = written(nearest, "nearest")
    out = files.withColumn("__dir", folder).join(own.withColumnsRenamed({"license": "own_license", "score": "own_score"}), "path", "left").join(nearest, "__dir", "left")
    inherits = F.col("own_license").isNull() & F.col("__b").isNotNull()
    out = out.withColumn("inherited_from", F.when(inherits, F.col("__b.holder"))).withColumn("license", F.coalesce("own_license", "__b.inherited"))
    return out.select(*files.columns, *added)
