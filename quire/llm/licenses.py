"""License scans by diagonal voting, in DataFrame operations alone.

All rolling word k-grams of all documents join the positions of the same k-grams in license templates.  A
hit votes for its diagonal, document position less template position.  Diagonals that lie side by side are
merged (words slipped in or left out shift the rest by a few), and a merged span stands if enough of the
template's words are verified in it.  A base phrase stands where every k-gram of its own diagonal is hit.

The template side is a fixed list, broadcast; only hits and one row a document are shuffled.

Defined results: null and empty texts have no words, no labels, and score 0.  Repeated rows each get a row.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.session import column, partitions

K = 3
#: Diagonals this near are one span; the share of a template's words that must be verified.
NEAR, LEAST_SHARE = 2, 0.75
#: Phrases whose exact places count, and their labels.
BASE = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))
#: Openings of well-known license notices, and labels.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("lgpl-3", "licensed under the gnu lesser general public license version 3"),
    ("agpl-3", "licensed under the gnu affero general public license version 3"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_NONE = -1


def template_positions(spark: SparkSession, base=BASE, templates=TEMPLATES) -> DataFrame:
    """gram, template, at, size, grams, base, label, words; and the row that every document's last element joins."""
    rows = [(n, label, text.split(), n < len(base)) for n, (label, text) in enumerate([*base, *templates])]
    flat = [(n, label, b, len(w), len(w) - K + 1, at, w[at : at + K]) for n, label, w, b in rows for at in range(len(w) - K + 1)]
    table = spark.createDataFrame(flat, "template int, label string, base boolean, size int, grams int, at int, words array<string>")
    table = table.select("*", F.xxhash64(*(F.xxhash64(F.element_at("words", n + 1)) for n in range(K))).alias("gram"))
    mark = spark.range(1).select(F.lit(_NONE).alias("template"), F.lit("").alias("label"), F.lit(False).alias("base"), F.lit(0).alias("size"), F.lit(0).alias("grams"), F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("words"), F.lit(_NONE).cast("bigint").alias("gram"))
    return table.unionByName(mark)


def scan(docs: DataFrame, base=BASE, templates=TEMPLATES) -> DataFrame:
    """One row a document: doc_id, n_words, ``places array<struct<start, label>>`` of the base phrases and
    ``spans array<struct<start, end, label, share>>`` of the templates."""
    spark = docs.sparkSession
    rows = docs.select(column(docs, "doc_id").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.explode(F.array(F.regexp_extract_all(F.coalesce(column(docs, "text").cast("string"), F.lit("")), F.lit(_WORD), F.lit(0)))).alias("text_words"))
    # Generators between the steps keep each array from being computed again at each of its elements.
    rows = rows.select("*", F.explode(F.array(F.transform("text_words", lambda x: F.xxhash64(F.lower(x))))).alias("hashes"))
    h = F.col("hashes")
    grams = F.transform(F.slice(h, F.lit(1), F.greatest(F.size(h) - (K - 1), F.lit(0))), lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)))
    every = rows.select("doc_id", "row", "text_words", F.posexplode(F.array_append(grams, F.lit(_NONE).cast("bigint"))).alias("pos", "gram"))
    hits = every.join(F.broadcast(template_positions(spark, base, templates)), "gram")
    low = F.transform(F.slice("text_words", F.col("pos") + 1, F.lit(K)), lambda x: F.translate(x, string.ascii_uppercase, string.ascii_lowercase))
    hits = hits.where((F.col("template") == _NONE) | (low == F.col("words")))
    hits = hits.select("doc_id", "row", F.size("text_words").cast("bigint").alias("n_words"), "template", "label", "base", "size", "grams", "at", F.when(F.col("template") == _NONE, F.lit(0)).otherwise(F.col("pos") - F.col("at")).alias("diagonal"))
    voted = hits.repartition(partitions(spark), "row").groupBy("row", "doc_id", "n_words", "template", "label", "base", "size", "grams", "diagonal").agg(F.collect_set("at").alias("ats"))
    line = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(line) > NEAR, F.lit(True)) | F.col("base")
    voted = voted.withColumn("apart", apart.cast("int")).withColumn("span", F.sum("apart").over(line))
    covered = F.flatten(F.transform("ats", lambda a: F.sequence(a, a + (K - 1))))
    spans = voted.groupBy("row", "doc_id", "n_words", "template", "label", "base", "size", "grams", "span").agg(
        F.min(F.col("diagonal") + F.array_min("ats")).alias("start"),
        F.max(F.col("diagonal") + F.array_max("ats") + K).alias("end"),
        F.sum(F.size("ats")).alias("n_ats"),
        F.size(F.array_distinct(F.flatten(F.collect_list(covered)))).alias("n_covered"),
    )
    spans = spans.withColumn("share", F.col("n_covered") / F.greatest(F.col("size"), F.lit(1)))
    # Of templates that begin at one word, those with the largest share stand.
    spans = spans.withColumn("best", F.max(F.when(~F.col("base") & (F.col("template") != _NONE), F.col("share"))).over(Window.partitionBy("row", "start")))
    share = F.col("share")
    real = F.col("template") != _NONE
    place = F.when(real & F.col("base") & (F.col("n_ats") == F.col("grams")), F.struct(F.col("start").cast("bigint").alias("start"), F.col("label")))
    span = F.when(real & ~F.col("base") & (share >= LEAST_SHARE) & (share == F.col("best")), F.struct(F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), F.col("label"), share.alias("share")))
    return spans.groupBy("row", "doc_id", "n_words").agg(F.array_sort(F.collect_list(place)).alias("places"), F.array_sort(F.collect_list(span)).alias("spans")).drop("row")


def report(found: DataFrame) -> DataFrame:
    """The digest columns of ``scan``'s rows."""
    labels = lambda *c: F.array_join(F.array_sort(F.array_distinct(F.concat(*(F.col(f"{x}.label") for x in c)))), ",")
    return found.select(
        "doc_id", "n_words", F.size("places").cast("bigint").alias("n_base"),
        F.array_min("places.start").alias("first_word"), F.array_max("places.start").alias("last_word"),
        labels("places").alias("base_labels"), labels("places", "spans").alias("labels"),
        F.greatest(F.when(F.size("places") > 0, 1.0).otherwise(0.0), F.coalesce(F.array_max("spans.share"), F.lit(0.0))).alias("score"),
    )
