"""License scans by diagonal voting: word k-grams joined to template positions, votes summed by offset diagonal.

Everything is a DataFrame expression; the templates are a fixed table, so that side is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weir.llm.common import stash

# Base phrases and their labels.
PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}

# Public license notices, as their owners word them, by label.
TEMPLATES = {
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": "The Software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the Software or the use or other dealings in the Software.",
    "mit-release": "Released under the MIT License.",
    "apache-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "bsd-terms": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "mpl-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
}

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of text in lower case; null has none. Letters beyond A-Z change too, which alters neither the number of
    words nor what equals a phrase."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _gram(words: Column, at: Column, k: int) -> Column:
    return F.xxhash64(*[F.get(words, at + j) for j in range(k)])


def template_grams(spark: SparkSession, templates: dict[str, str], k: int) -> DataFrame:
    """(label, at, gram, t_len): a row per template position; as many rows as the fixed templates have words."""
    rows = spark.createDataFrame(sorted(templates.items()), "label string, notice string")
    rows = rows.select("label", words_of(F.col("notice")).alias("t")).where(F.size("t") >= k)
    rows = rows.select("label", "t", F.explode(F.sequence(F.lit(0), F.size("t") - k)).alias("at"))
    return rows.select("label", "at", _gram(F.col("t"), F.col("at"), k).alias("gram"), F.size("t").alias("t_len"))


def phrase_places(words: Column, phrases: dict[str, str] = PHRASES) -> Column:
    """array<struct<at, label>> of the places where a phrase's words stand consecutively."""
    def places(parts: list[str], label: str) -> Column:
        def stands(i: Column) -> Column:
            cond = F.get(words, i) == parts[0]
            for j, p in enumerate(parts[1:], 1):
                cond = cond & (F.get(words, i + j) == p)
            return F.coalesce(cond, F.lit(False))

        spots = F.filter(F.sequence(F.lit(0), F.greatest(F.size(words) - len(parts), F.lit(0))), stands)
        spots = F.when(F.array_contains(words, parts[-1]), spots).otherwise(F.array().cast("array<int>"))
        return F.transform(spots, lambda i: F.struct(i.alias("at"), F.lit(label).alias("label"))).cast("array<struct<at:int,label:string>>")

    out = [places(phrase.split(" "), label) for phrase, label in phrases.items()]
    return F.concat(*out).cast("array<struct<at:int,label:string>>")


def votes(docs: DataFrame, templates: dict[str, str] | None = None, k: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A written table with a row per text: (row, id, n_words, places, hits). hits are the (label, t_len, i, at) where the
    word k-gram at i equals the template's at `at`; they come from a join of all rolling k-grams with the templates.

    Each text also sends one row with i = -1 through the join, so a text is scanned and cut into words once.
    """
    grams = template_grams(docs.sparkSession, TEMPLATES if templates is None else templates, k)
    none = docs.sparkSession.range(1).select(F.lit(None).cast("string").alias("label"), F.lit(-1).alias("at"), F.lit(0).cast("long").alias("gram"), F.lit(0).alias("t_len"))
    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    own = own.select("row", "id", words_of(F.col("text")).alias("w"), F.contains(F.lower("text"), F.lit("license")).alias("maybe"))
    own = own.select("row", "id", "w", F.when(F.col("maybe"), phrase_places(F.col("w"))).alias("p"))
    own = own.select("row", "id", "w", "p", F.explode(F.sequence(F.lit(-1), F.greatest(F.size("w") - k, F.lit(-1)))).alias("i"))
    gram = F.when(F.col("i") < 0, F.lit(0).cast("long")).otherwise(_gram(F.col("w"), F.col("i"), k))
    rows = own.select("row", "id", "i", F.when(F.col("i") < 0, F.size("w")).alias("n"), F.when(F.col("i") < 0, F.col("p")).alias("p"), gram.alias("gram"))
    rows = rows.join(F.broadcast(grams.unionByName(none)), "gram").where("(i < 0) = (label is null)")
    hit = F.when(F.col("i") >= 0, F.struct("label", "t_len", "i", "at"))
    table = rows.groupBy("row").agg(F.first("id", True).alias("id"), F.max("n").cast("long").alias("n_words"), F.first("p", True).alias("places"), F.collect_list(hit).alias("hits"))
    return stash(table, "votes")


def license_spans(table: DataFrame, k: int = 4, near: int = 3, least: float = 0.6) -> DataFrame:
    """Verified license spans of votes(): (row, label, start, stop, votes, score).

    Votes are counted by (text, label, diagonal), a diagonal being text position minus template position; diagonals
    at most `near` apart are merged (words inserted or left out inside a notice). A merged span is verified: the share
    of the template's words that its matching k-grams cover, counting a template position once, must reach `least`.
    """
    hits = table.where(F.size("hits") > 0).select("row", F.inline("hits")).withColumn("diagonal", F.col("i") - F.col("at"))
    lines = hits.groupBy("row", "label", "t_len", "diagonal").agg(
        F.count(F.lit(1)).alias("votes"), F.min("i").alias("lo"), F.max("i").alias("hi"), F.collect_set("at").alias("ats")
    )
    of = Window.partitionBy("row", "label").orderBy("diagonal")
    lines = lines.withColumn("gap", F.coalesce((F.col("diagonal") - F.lag("diagonal").over(of) > near).cast("int"), F.lit(1)))
    lines = lines.withColumn("run", F.sum("gap").over(of))
    spans = lines.groupBy("row", "label", "t_len", "run").agg(
        F.sum("votes").alias("votes"), F.min("lo").alias("start"), (F.max("hi") + k).alias("stop"), F.flatten(F.collect_list("ats")).alias("ats")
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform(F.array_distinct("ats"), lambda a: F.sequence(a, a + (k - 1))))))
    spans = spans.withColumn("score", covered / F.col("t_len"))
    return spans.where(F.col("score") >= least).select("row", "label", "start", "stop", "votes", "score")


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", k: int = 4, near: int = 3, least: float = 0.6) -> DataFrame:
    """One row per row of docs: (id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_spans).

    base_* hold the places of PHRASES; labels adds those of license_spans; score is 1 where a phrase stands,
    else the best span's. Null or empty: no words, no labels, null first and last, score 0. Repeated notices give a
    span each; repeated ids are scanned row by row.
    """
    table = votes(docs, templates, k, id_col, text_col)
    found = license_spans(table, k, near, least)
    found = found.groupBy("row").agg(F.collect_set("label").alias("more"), F.max("score").alias("best"), F.count(F.lit(1)).alias("n_spans"))
    none = F.array().cast("array<string>")
    at, base = F.transform("places", lambda x: x["at"]), F.transform("places", lambda x: x["label"])
    both = table.join(found, "row", "left").withColumn("n_base", F.coalesce(F.size("places"), F.lit(0)))
    both = both.withColumn("n_base", F.greatest("n_base", F.lit(0)).cast("long")).withColumn("base", F.coalesce(F.array_sort(F.array_distinct(base)), none))
    return both.select(
        "id",
        "n_words",
        "n_base",
        F.array_min(at).cast("long").alias("first_word"),
        F.array_max(at).cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("base", F.coalesce("more", none)))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.least(F.coalesce("best", F.lit(0.0)), F.lit(1.0))).alias("score"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
    )
