"""Licence scan: normalised lines compared with licence notices by the Dice coefficient of word bigrams.

A line is lower-cased, everything but a-z and 0-9 becomes a blank. With n distinct bigrams it can reach
the threshold t only with templates of n*t/(2-t) to n*(2-t)/t bigrams; a table of template and size makes
that bound an equi-join, so that lines of other sizes are compared with nothing. DataFrame operations only.
A text without any mark (words of which a match must have one) can match nothing and is left out before that.

Notices that are wrapped over lines or stand inside longer ones, and full licence texts, are found by windows of
words that run across lines: of the stretches that hold as many bigrams as the bound allows, the best ones that
don't overlap. A text without any of a template's own marks has no such window.
A window that touches a line which matches the template by itself is left to that line.

Returns a row for each line and licence that match: doc_id, line (from 0; a window's first), license, dice. Null and empty
texts have no rows; rows that repeat a doc_id each give theirs.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.llm.common import parts, stage, table, texts

#: Common licence notices.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)
#: Full texts and longer notices, compared by windows only.
FULL = (
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT
WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES
OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this
list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND
CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE
LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY
THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT
OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED
"AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES
OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER
TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
permissions and limitations under the License."""),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
)
THRESHOLD = 0.8


def _words(text: str) -> list[str]:
    return re.sub(r"[^a-z0-9]+", " ", text.lower()).split()


def _bigrams(words: list[str]) -> list[str]:
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def _strings(values: list[str]) -> Column:
    """An array of strings without line ends as one literal, which Spark folds; a literal for each made plans of thousands of nodes."""
    return F.split(F.lit("\n".join(values)), "\n")


def _tokens(text: Column) -> Column:
    return F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " ")


def bounds(n: int, t: float) -> range:
    """Sizes that a line may have to reach t with a template of n bigrams."""
    return range(math.ceil(n * t / (2 - t) - 1e-9), math.floor(n * (2 - t) / t + 1e-9) + 1)


def templates(spark: SparkSession, given=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """n, license, own: each template under every size that it allows; bounded by the templates given."""
    rows = [(n, name, own) for name, text in given for own in [_bigrams(_words(text))] for n in bounds(len(own), threshold)]
    made = F.array(*(F.struct(F.lit(n).alias("n"), F.lit(name).alias("license"), _strings(own).alias("own")) for n, name, own in rows))
    return spark.range(1).select(F.inline(made))


def bigrams(words: Column) -> Column:
    return F.array_distinct(F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b)))


def candidates(docs: DataFrame, given=TEMPLATES + FULL, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, text of the rows that have a mark of any template, dealt anew, as few texts have one."""
    every = sorted({w for _, text in given for w in marks(_words(text), threshold)})
    found = texts(docs).where(F.arrays_overlap(_tokens(F.col("text")), _strings(every)))
    return stage(found).repartition(parts(docs.sparkSession))


def scan(docs: DataFrame, given=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, line, license, dice of lines that match by themselves."""
    most = max(bounds(len(_bigrams(_words(t))), threshold)[-1] for _, t in given)
    lines = texts(docs).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    norm = F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " "))
    words = lines.select("doc_id", F.col("line").cast("long").alias("line"), F.split(norm, " ").alias("w"))
    # a line of many words has more bigrams than any template allows only if they differ: repeats are counted once
    sized = words.where(F.size("w") > 1).select("doc_id", "line", bigrams(F.col("w")).alias("b")).where(F.size("b") <= most)
    pairs = sized.withColumn("n", F.size("b")).join(F.broadcast(templates(docs.sparkSession, given, threshold)), "n")
    dice = 2.0 * F.size(F.array_intersect("b", "own")) / (F.size("b") + F.size("own"))
    return pairs.select("doc_id", "line", "license", dice.alias("dice")).where(F.col("dice") >= threshold).groupBy("doc_id", "line", "license").agg(F.max("dice").alias("dice"))


_COMMON = frozenset("a an and any are as at be by for from if in is it may not of on or that the this to under use with work you".split())


def marks(words: list[str], threshold: float) -> list[str]:
    """Words, long and less common ones first, without all of which too few of the bigrams are left to reach the threshold."""
    own, out = _bigrams(words), []
    need = bounds(len(own), threshold)[0]
    for w in sorted(set(words), key=lambda w: (w in _COMMON, -len(w), w)):
        out.append(w)
        if sum(not set(b.split()) & set(out) for b in own) < need:
            return out
    return out


def _dice(b: Column, own: Column) -> Column:
    return 2.0 * F.size(F.array_intersect(b, own)) / (F.size(b) + F.size(own))


def _best(win: Column, own: Column) -> Column:
    """dice, size: the best stretch from the window's first bigram on, the shortest of equal ones."""
    state = lambda d, h, k, dice, size: F.struct(d.alias("d"), h.alias("h"), k.alias("k"), dice.alias("dice"), size.alias("size"))

    def step(x: Column, b: Column) -> Column:
        k = x["k"] + F.lit(1)
        new = F.array_position(win, b) == k
        d = x["d"] + F.when(new, 1).otherwise(0)
        h = x["h"] + F.when(new & F.array_contains(own, b), 1).otherwise(0)
        dice = F.lit(2.0) * h / (d + F.size(own))
        return state(d, h, k, F.greatest(x["dice"], dice), F.when(dice > x["dice"], k).otherwise(x["size"]))

    zero = F.lit(0)
    return F.aggregate(win, state(zero, zero, zero, F.lit(0.0), zero), step)


def windows(docs: DataFrame, given=TEMPLATES + FULL, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, line, license, dice of stretches across or inside lines."""
    known = [(name, _bigrams(_words(text)), marks(_words(text), threshold)) for name, text in given]

    def templates_of(words: Column) -> Column:
        made = []
        for name, own, own_marks in known:
            sizes = bounds(len(own), threshold)
            made.append(F.when(F.arrays_overlap(words, _strings(own_marks)), F.struct(F.lit(name).alias("license"), _strings(own).alias("own"), F.lit(sizes[0]).alias("need"), F.lit(sizes[-1]).alias("most"))))
        return F.filter(F.array(*made), lambda x: x.isNotNull())

    # one token array for all templates
    asked = texts(docs).select("doc_id", "text", F.transform(F.array(_tokens(F.col("text"))), templates_of)[0].alias("asked"))
    split = lambda x: F.filter(_tokens(x), lambda w: w != "")
    words = F.flatten(F.transform(F.split("text", "\n"), lambda x, i: F.transform(split(x), lambda w: F.struct(i.alias("line"), w.alias("w")))))
    rows = asked.select("doc_id", "asked", words.alias("words")).where(F.size("words") > 1)
    pairs = F.zip_with(F.slice("words.w", F.lit(1), F.size("words") - 1), F.slice("words.w", F.lit(2), F.size("words") - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    # below the explode, or Spark would write the pairs into each later expression that reads them
    rows = rows.select("doc_id", "asked", "words", pairs.alias("b")).select("doc_id", "words", "b", F.explode("asked").alias("t")).select("doc_id", "words", "b", "t.*")
    rows = rows.where(F.size(F.array_intersect("b", "own")) >= F.col("need"))
    hits = F.filter(F.transform("b", lambda x, i: F.when(F.array_contains("own", x), i + 1)), lambda x: x.isNotNull())
    rows = rows.withColumn("hits", hits)
    from_ = lambda a: F.slice("b", a, F.col("most"))
    rows = rows.withColumn("hits", F.filter("hits", lambda a: F.size(F.array_intersect(from_(a), F.col("own"))) >= F.col("need")))
    tried = F.transform(F.transform("hits", lambda a: F.struct(a.alias("a"), _best(from_(a), F.col("own")).alias("x"))), lambda y: F.struct((-y["x"]["dice"]).alias("m"), y["a"].alias("a"), (y["a"] + y["x"]["size"]).alias("z")))
    rows = rows.withColumn("tried", F.array_sort(F.filter(tried, lambda y: y["m"] <= -threshold)))
    none = F.slice("tried", 1, 0)
    apart = F.aggregate("tried", none, lambda out, y: F.when(F.exists(out, lambda o: (o["a"] <= y["z"]) & (y["a"] <= o["z"])), out).otherwise(F.concat(out, F.array(y))))
    rows = rows.where(F.size("tried") > 0).select("doc_id", "license", "own", "words", F.explode(apart).alias("y"))
    at = lambda k: F.element_at("words", k)["line"]
    rows = rows.select("doc_id", "license", "own", "words", (-F.col("y.m")).alias("dice"), at(F.col("y.a")).alias("line"), at(F.col("y.z")).alias("end"))
    own_line = lambda k: bigrams(F.transform(F.filter("words", lambda w: w["line"] == k), lambda w: w["w"]))
    alone = F.exists(F.sequence("line", "end"), lambda k: _dice(own_line(k), F.col("own")) >= threshold)
    return rows.where(~alone).select("doc_id", F.col("line").cast("long").alias("line"), "license", "dice")


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = candidates(table(spark, sf_dir, "documents"))
    return scan(docs).unionByName(windows(docs)).groupBy("doc_id", "line", "license").agg(F.max("dice").alias("dice"))


def _sql() -> str:
    rows = ", ".join(f"('{name}', [{', '.join(repr(b) for b in _bigrams(_words(text)))}])" for name, text in TEMPLATES)
    return f"""
WITH t(license, own) AS (VALUES {rows}),
lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS text, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line FROM documents),
w AS (SELECT doc_id, line, string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM lines),
b AS (SELECT doc_id, line, list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS b FROM w WHERE len(w) > 1),
d AS (SELECT doc_id, line, license, 2.0 * len(list_intersect(b, own)) / (len(b) + len(own)) AS dice FROM b, t WHERE len(b) BETWEEN 0.6 * len(own) AND 1.6 * len(own))
SELECT doc_id, CAST(line AS BIGINT) AS line, license, CAST(max(dice) AS DOUBLE) AS dice FROM d WHERE dice >= {THRESHOLD} GROUP BY 1, 2, 3"""


QUERIES = {"op4_licenses": op4_licenses}
ORACLES = {"op4_licenses": _sql()}
