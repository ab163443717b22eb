"""License scanning by diagonal voting, with DataFrame functions only.

Every word 2-gram of a text is joined to the positions where a template has it (and the two words
are compared, not only their hash). A hit at text word p and template word q votes for the diagonal
p - q. Base phrases count where one diagonal holds all of the phrase's 2-grams. For the longer
templates neighbouring diagonals (at most ``slack`` apart, hits within one template length) are
merged, so that an inserted or missing word does not break a match. A merged span is verified: of the
template's positions that it hits, each once at its first place, those count that come in the template's
order; it gives its label when they are at least ``cover`` of the template's 2-grams and lie within ``stretch``
times its length.

Words are runs of ASCII letters and digits and of all non-ASCII characters. ``lower`` is used for
A-Z: it changes other letters too, but moves no word boundary and makes no other letter into one of
the phrases' letters. The template table is a fixed list, so its broadcast has a fixed size;
``templates`` of more than ``BROADCAST_POSITIONS`` positions are shuffled instead.

Defined results: a null text counts as empty (no word, no label, score 0.0). Repeated rows come
back one for one, whatever their ids; the id is only carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BROADCAST_POSITIONS = 100_000
SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases whose every place is counted, and their labels.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

# Paragraphs of well-known public licences and their notices, in words, and their labels.
NOTICES = (
    ("mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "mit"),
    ("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software", "mit"),
    ("the software is provided as is without warranty of any kind express or implied", "mit"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "isc"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-2"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", "apache-2"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "bsd"),
    ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "bsd"),
    ("this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", "mpl-2"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("licensed under the creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("licensed under the creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("licensed under the creative commons attribution 4 0 international license", "cc-by"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", "unlicense"),
)
_END = -1  # the template number of the row that stands for the document itself


def template_positions(spark, phrases, notices) -> tuple[DataFrame, DataFrame]:
    """(g, w1, w2, template, at) for all 2-grams of all templates, and (template, label, grams, base)."""
    grams, about = [("", "", _END, 0)], []
    for number, (text, label, base) in enumerate([(*x, True) for x in phrases] + [(*x, False) for x in notices]):
        words = text.split()
        about.append((number, label, len(words) - 1, base))
        grams += [(a, b, number, i) for i, (a, b) in enumerate(zip(words, words[1:]))]
    table = spark.createDataFrame(grams, "w1 string, w2 string, template int, at int").withColumn("g", F.xxhash64("w1", "w2"))
    return table, spark.createDataFrame(about, "template int, label string, grams int, base boolean")


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, notices=NOTICES, slack: int = 2, cover: float = 0.75, stretch: float = 1.5) -> DataFrame:
    """One row per input row: id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    spark = docs.sparkSession
    table, about = template_positions(spark, phrases, notices)
    if sum(len(t.split()) for t, _ in (*phrases, *notices)) <= BROADCAST_POSITIONS:
        table, about = F.broadcast(table), F.broadcast(about)

    words = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.split(F.lower(F.coalesce(text_col, F.lit(""))), SPLIT).alias("w"))
    words = words.withColumn("w", F.filter("w", lambda x: x != ""))
    grams = F.concat(F.array(F.xxhash64(F.lit(""), F.lit(""))), F.transform("w", lambda x, i: F.xxhash64(x, F.get("w", i + 1))))
    hits = words.select("row", "id", F.size("w").cast("long").alias("n_words"), "w", F.posexplode(grams).alias("p", "g"))
    same = (F.col("p") == 0) & (F.col("template") == _END) | (F.get("w", F.col("p") - 1) == F.col("w1")) & (F.get("w", F.col("p")) == F.col("w2"))
    hits = hits.join(table, "g").where(same).select("row", "id", "n_words", "template", (F.col("p") - 1).cast("long").alias("p"), F.when(F.col("template") != _END, F.col("p") - 1 - F.col("at")).cast("long").alias("diagonal"))

    # a diagonal has at most one place for each position of the template
    votes = hits.groupBy("row", "id", "n_words", "template", "diagonal").agg(F.count("*").alias("n"), F.min("p").alias("lo"), F.max("p").alias("hi"), F.collect_list("p").alias("ps"))
    votes = votes.join(about, "template", "left")
    along = W.partitionBy("row", "template").orderBy("diagonal")
    apart = (F.col("diagonal") - F.lag("diagonal").over(along) > slack) | (F.col("lo") - F.lag("hi").over(along) > F.col("grams"))
    spans = votes.withColumn("cut", F.coalesce(apart.cast("int"), F.lit(0)))
    spans = spans.withColumn("span", F.sum("cut").over(along.rowsBetween(W.unboundedPreceding, 0)))
    full = F.col("base") & (F.col("n") == F.col("grams"))
    spans = spans.groupBy("row", "id", "n_words", "template", "span").agg(
        F.any_value("label").alias("label"),
        F.any_value("base").alias("base"),
        F.any_value("grams").alias("grams"),
        F.sort_array(F.flatten(F.collect_list(F.transform("ps", lambda p: F.struct((p - F.col("diagonal")).alias("at"), p.alias("p")))))).alias("met"),
        F.sum(full.cast("long")).alias("places"),
        F.min(F.when(full, F.col("diagonal"))).alias("first"),
        F.max(F.when(full, F.col("diagonal"))).alias("last"),
    )
    spans = spans.withColumn("met", F.when(~F.col("base"), F.filter("met", lambda x, i: (i == 0) | (x["at"] != F.get("met", i - 1)["at"]))))  # each position at its first place
    spans = spans.withColumn("met", F.filter("met", lambda x, i: (i == 0) | (x["p"] > F.get("met", i - 1)["p"])))
    length = F.array_max(F.transform("met", lambda x: x["p"])) - F.array_min(F.transform("met", lambda x: x["p"])) + 1
    verified = F.when(length <= F.col("grams") * stretch, F.size("met") / F.col("grams"))
    covered = F.when(F.col("base"), F.when(F.col("places") > 0, 1.0).otherwise(0.0)).otherwise(verified)
    spans = spans.withColumn("covered", F.coalesce(covered, F.lit(0.0)))
    base_label = F.when(F.col("places") > 0, F.col("label"))
    any_label = F.when(F.col("covered") >= cover, F.col("label"))
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    out = spans.groupBy("row", "id", "n_words").agg(
        F.coalesce(F.sum("places"), F.lit(0)).cast("long").alias("n_base"),
        F.min("first").alias("first_word"),
        F.max("last").alias("last_word"),
        listed(base_label).alias("base_labels"),
        listed(any_label).alias("labels"),
        F.max("covered").alias("score"),
    )
    return out.select(F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def license_query(spark, sf_dir: str) -> DataFrame:
    """The scan of every document."""
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
