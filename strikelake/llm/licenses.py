"""Licence scan by an exact set-similarity join of text blocks with licence templates."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import NOT_WORD, words_of

#: Phrases whose words stand consecutively, and their labels.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

#: Sentences that name or grant a licence and whole licence texts, by label.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is
        distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See
        the License for the specific language governing permissions and limitations under the License.""",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted "
        "provided that the following conditions are met",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
        the following conditions are met: 1. Redistributions of source code must retain the above copyright notice,
        this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the
        above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
        materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS
        "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
        MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR
        CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
        (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR
        BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR
        TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF
        THE POSSIBILITY OF SUCH DAMAGE.""",
    ],
    "cc-by-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0"],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
        option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
        WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU
        General Public License for more details. You should have received a copy of the GNU General Public License
        along with this program. If not, see https://www.gnu.org/licenses/""",
    ],
    "isc": [
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE
        IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
        WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
        INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
        WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE
        USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ],
    "mit": [
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
        to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above
        copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
        LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
        SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION
        OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
        DEALINGS IN THE SOFTWARE.""",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
        not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    ],
}


def _template_words(spark, texts: Sequence[str]) -> list[list[str]]:
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [r["words"] for r in rows.select("i", words_of(F.col("text")).alias("words")).orderBy("i").collect()]


def template_matches(docs: DataFrame, templates: Mapping[str, Sequence[str]] = TEMPLATES, threshold: float = 0.9) -> DataFrame:
    """Text blocks of every whole text that hold at least ``threshold`` of a template's different words.

    A block is as many consecutive words as the template has (the whole text, if it is shorter), line
    ends and other marks between words do not count. Returns doc_id, text_hash (of the text; rows of
    one id and text share their matches), label, template (its number), start (in words), containment:
    for each stretch of the text between multiples of twice the template's length, the first of its
    best blocks.

    The template words, rarest in the corpus first, are one global order. A match of a template of n
    words holds c = ceil(threshold n) of them, so it holds one of the first n - c + 1 (prefix). Only
    stretches around such words are looked at; they need c words at all (length), c of which stand in
    the template from their first common word on (position); in those that pass, every block is
    counted out. The order and the prefixes hold the templates' words alone: their size does not
    depend on the corpus.
    """
    spark = docs.sparkSession
    named = [(label, text) for label, texts in templates.items() for text in texts]
    split = _template_words(spark, [text for _, text in named])
    if not all(split):
        raise ValueError("a template without words")
    vocabulary = sorted({w for words in split for w in words})
    counted = docs.select(F.explode(F.array_intersect(_strings(vocabulary), words_of(F.col("text")))).alias("word"))
    counts = {r["word"]: r["count"] for r in counted.groupBy("word").count().collect()}

    index, leading = [], set()
    for number, ((label, _), words) in enumerate(zip(named, split)):
        order = sorted(set(words), key=lambda w: (counts.get(w, 0), w))
        need = math.ceil(threshold * len(order) - 1e-9)
        first = order[: len(order) - need + 1]
        leading.update(first)
        index.append(
            F.struct(
                F.lit(label).alias("label"), F.lit(number).alias("template"), F.lit(len(words)).alias("length"), F.lit(need).alias("need"),
                _strings(first).alias("first"), _strings(order).alias("words"),
            )
        )

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words_of(F.col("text")).alias("words"))
    rows = rows.withColumn("met", F.array_intersect(_strings(sorted(leading)), F.col("words"))).where(F.size("met") > 0)
    asked = F.explode(F.filter(F.array(*index), lambda t: F.arrays_overlap(t["first"], F.col("met")))).alias("t")
    rows = rows.select("doc_id", "text_hash", "words", "met", asked)
    words, span = F.col("words"), F.col("t.length")
    here = F.array_intersect("met", F.col("t.first"))
    places = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.array_contains(here, F.get(words, i)))
    stretches = F.array_distinct(F.flatten(F.transform(places, lambda p: F.array(F.floor(p / span).cast("int"), F.floor(p / span).cast("int") - 1))))
    rows = rows.select("doc_id", "text_hash", "words", "t", F.explode(F.filter(stretches, lambda b: b >= 0)).alias("stretch"))
    rows = rows.select("doc_id", "text_hash", "t", "stretch", F.slice(words, F.col("stretch") * span + 1, 2 * span).alias("words"))
    held = F.array_intersect("t.words", "words")
    rows = rows.select("*", held.alias("held")).where(F.size("held") >= F.col("t.need"))
    place = F.array_position("t.words", F.get("held", F.lit(0)))
    rows = rows.where(F.size("t.words") - place + 1 >= F.col("t.need"))

    def shared(at: Column) -> Column:
        return F.size(F.array_intersect("t.words", F.slice("words", at + 1, span)))

    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - span, F.lit(0)))
    best = F.array_max(F.transform(starts, lambda at: F.struct(shared(at).alias("n"), (-at).alias("before"))))
    rows = rows.withColumn("best", best).where(F.col("best.n") >= F.col("t.need"))
    start = F.col("stretch") * span - F.col("best.before")
    share = F.col("best.n") / F.size("t.words")
    return rows.select("doc_id", "text_hash", "t.label", "t.template", start.alias("start"), share.alias("containment")).distinct()


def _strings(words: Sequence[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def phrase_places(words: Column, phrase: str) -> Column:
    """Array of the places (from 0) in ``words`` where the words of ``phrase`` stand consecutively."""
    first, *rest = phrase.split(" ")

    def stands(i: Column) -> Column:
        here = F.get(words, i) == first
        for k, word in enumerate(rest, 1):
            here = here & (F.get(words, i + k) == word)
        return here

    places = F.filter(F.sequence(F.lit(0), F.size(words) - 1), stands)
    holds = F.array_contains(words, first)
    for word in rest:
        holds = holds & F.array_contains(words, word)
    return F.when(holds, places).otherwise(F.array().cast("array<int>"))


def scan_licenses(
    docs: DataFrame, templates: Mapping[str, Sequence[str]] = TEMPLATES, threshold: float = 0.9
) -> DataFrame:
    """Licence phrases and template matches of every row of ``docs`` (doc_id, text).

    Returns doc_id, n_words, n_base (places of ``PHRASES``), first_word and last_word (smallest and
    largest such place, else null), base_labels, labels (with those of the templates; both distinct,
    sorted, comma-joined, empty if none) and score: 1 with a base phrase, else the largest
    containment of a matching template, else 0. Null and empty texts have no words and score 0;
    repeated rows have a result each, an empty table none; other columns are not read.
    """
    found = template_matches(docs, templates, threshold).groupBy("doc_id", "text_hash")
    found = found.agg(F.collect_set("label").alias("found"), F.max("containment").alias("containment"))
    found = found.select(F.col("doc_id").alias("of_id"), F.col("text_hash").alias("of_text"), "found", "containment")
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words_of(F.col("text")).alias("words"))
    words = F.col("words")
    rows = rows.select(
        "doc_id",
        "text_hash",
        F.size(words).cast("long").alias("n_words"),
        *[phrase_places(words, p).alias(f"p{k}") for k, p in enumerate(PHRASES)],
    )
    base = [F.col(f"p{k}") for k in range(len(PHRASES))]
    starts = F.concat(*base)
    named = F.array_compact(F.array(*[F.when(F.size(p) > 0, F.lit(label)) for p, label in zip(base, PHRASES.values())]))
    rows = rows.select(
        "doc_id",
        "text_hash",
        "n_words",
        F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        named.alias("named"),
    )
    both = rows.join(found, F.col("doc_id").eqNullSafe(F.col("of_id")) & F.col("text_hash").eqNullSafe(F.col("of_text")), "left")
    every = F.array_union("named", F.coalesce("found", F.array().cast("array<string>")))
    return both.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.array_sort("named"), ",").alias("base_labels"),
        F.array_join(F.array_sort(every), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"),
    )


def scan_sql(templates: Mapping[str, Sequence[str]] = TEMPLATES, threshold: float = 0.9) -> str:
    """DuckDB text of ``scan_licenses`` over ``documents``: every template against every block of its length."""
    texts = [(label, " ".join(text.split()).replace("'", "''")) for label, some in templates.items() for text in some]
    quoted = ",\n  ".join(f"('{label}', '{text}')" for label, text in texts)
    phrases = ",\n  ".join(f"({len(p.split())}, '{p}', '{label}')" for p, label in PHRASES.items())
    word = NOT_WORD.replace("[", "[^", 1)
    low = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = f"regexp_extract_all({low}, '{word}')"
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {words.format("text")} AS w FROM documents),
templates(label, sentence) AS (VALUES
  {quoted}),
t AS (SELECT label, {words.format("sentence")} AS s, list_distinct({words.format("sentence")}) AS t FROM templates),
-- A text that does not hold enough of a template's words has no block that does.
c AS MATERIALIZED (SELECT r, label, w, t, len(s) AS n FROM d, t WHERE len(list_intersect(t, w)) >= {threshold} * len(t) - 1e-9),
b AS (SELECT r, label, t, w[i + 1 : i + n] AS w FROM (SELECT *, unnest(range(0, greatest(len(w) - n, 0) + 1)) AS i FROM c)),
m AS (
  SELECT r, label, max(len(list_intersect(t, w)) / len(t)) AS share FROM b
  WHERE len(list_intersect(t, w)) >= {threshold} * len(t) - 1e-9 GROUP BY r, label),
phrases(n, phrase, label) AS (VALUES
  {phrases}),
p AS (
  SELECT r, label, i AS place FROM (SELECT r, w, unnest(range(0, len(w))) AS i FROM d WHERE list_has_any(w, ['cc', 'general', 'all'])), phrases
  WHERE array_to_string(w[i + 1 : i + n], ' ') = phrase),
pb AS (
  SELECT r, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
  FROM p GROUP BY r),
al AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM p UNION SELECT r, label FROM m) GROUP BY r),
ms AS (SELECT r, max(share) AS share FROM m GROUP BY r)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
       last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0)::DOUBLE END AS score
FROM d LEFT JOIN pb USING (r) LEFT JOIN al USING (r) LEFT JOIN ms USING (r)
"""
