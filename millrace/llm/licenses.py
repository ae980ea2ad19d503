"""License scans by diagonal voting, in DataFrame operations only.

Words are lower-cased; each pair of consecutive words is joined by its hash (and compared word by word) with the
pairs of the templates. A match votes for its diagonal, the text position less the template position. A base phrase
stands where its diagonal has every pair. For the longer templates, neighbouring diagonals (at most ``GAP`` apart,
so a missing or added word doesn't split a span) are merged, and a span is verified when it has at least ``COVERAGE``
of the template's pairs.

An edited copy that keeps fewer than COVERAGE of a template's pairs isn't labelled by it: each changed word costs two pairs, so one word in
five may be changed.

Defined cases: a null text counts as empty (no words, no labels, score 0); rows that share doc_id and text give the
same result each; a null doc_id is kept; texts of any length are read whole; labels are distinct, so equal scores need no order; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import documents, whole_text

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Label and text of each longer template, in words: the openings of public notices, and usual short forms. Fixed values.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit", "released under the mit license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("proprietary", "all rights reserved no part of this publication may be reproduced"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
#: Pairs whose places fit one number.
BITS = 60
GAP, COVERAGE = 2, 0.6


def word_list(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, ascii_uppercase, ascii_lowercase), NOT_WORD), "")


def template_pairs() -> list[tuple[int, str, bool, int, int, str, str]]:
    """(template, label, base, pairs in it, position, first word, second word); a fixed table of some hundred rows."""
    whole = [(label, phrase, True) for phrase, label in BASE.items()] + [(label, phrase, False) for label, phrase in TEMPLATES]
    out = []
    for t, (label, phrase, base) in enumerate(whole):
        words = phrase.split()
        out += [(t, label, base, len(words) - 1, k, *words[k : k + 2]) for k in range(len(words) - 1)]
    return out


def license_scan(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    words = read.select("doc_id", F.xxhash64("text").alias("th"), word_list(F.col("text")).alias("w"))
    pairs = F.greatest(F.size("w") - 1, F.lit(0))
    zipped = F.arrays_zip(F.slice("w", F.lit(1), pairs).alias("a"), F.slice("w", F.lit(2), pairs).alias("b"))
    grams = words.select("doc_id", "th", F.posexplode(zipped).alias("pos", "g"))
    grams = grams.select("doc_id", "th", "pos", F.col("g.a").alias("a"), F.col("g.b").alias("b")).withColumn("h", F.xxhash64("a", "b"))
    shape = "t int, label string, base boolean, m int, tpos int, ta string, tb string"
    known = spark.createDataFrame(template_pairs(), shape).withColumn("th_", F.xxhash64("ta", "tb"))
    hits = grams.join(F.broadcast(known), F.col("h") == F.col("th_")).where("a = ta and b = tb")
    votes = hits.groupBy("doc_id", "th", "t", "label", "base", "m", (F.col("pos") - F.col("tpos")).alias("at"))
    masks = [f"mask{k}" for k in range(-(-max(row[4] + 1 for row in template_pairs()) // BITS))]
    votes = votes.agg(*[F.bit_or(F.expr(f"if(tpos div {BITS} = {k}, shiftleft(1L, tpos % {BITS}), 0L)")).alias(m) for k, m in enumerate(masks)])
    order = Window.partitionBy("doc_id", "th", "t").orderBy("at")
    apart = (F.col("at") - F.lag("at").over(order) <= GAP) & ~F.col("base")
    span = F.sum(F.when(F.coalesce(apart, F.lit(False)), 0).otherwise(1)).over(order)
    merged = votes.withColumn("span", span).groupBy("doc_id", "th", "t", "label", "base", "m", "span")
    merged = merged.agg(F.min("at").alias("at"), *[F.bit_or(m).alias(m) for m in masks])
    merged = merged.withColumn("share", sum(F.bit_count(m) for m in masks) / F.col("m")).where(f"share >= if(base, 1, {COVERAGE})")
    place = F.when(F.col("base"), F.col("at").cast("long"))
    found = merged.groupBy("doc_id", "th").agg(
        F.count(place).alias("n_base"), F.min(place).alias("first_word"), F.max(place).alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"), F.round(F.max("share"), 6).alias("score"),
    )
    counted = words.select("doc_id", "th", F.size("w").cast("long").alias("n_words")).alias("d")
    found = found.alias("f")
    joined = counted.join(found, F.expr("d.doc_id <=> f.doc_id and d.th = f.th"), "left")
    empty = {"n_base": 0, "base_labels": "", "labels": "", "score": 0.0}
    return joined.select(
        "d.doc_id", "n_words", *[F.coalesce(F.col(c), F.lit(v).cast("long") if c == "n_base" else F.lit(v)).alias(c) for c, v in empty.items()], "first_word", "last_word",
    )


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))


_ROWS = ", ".join(f"({t}, '{label}', {str(base).upper()}, {m}, {k}, '{a}', '{b}')" for t, label, base, m, k, a, b in template_pairs())
ORACLE_SQL = f"""
    WITH known(t, label, base, m, tpos, a, b) AS (VALUES {_ROWS}),
    listed AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
    pairs AS (SELECT doc_id, unnest(range(1, len(w))) AS i, w FROM listed WHERE len(w) > 1),
    hits AS (SELECT doc_id, t, label, base, m, tpos, i - 1 - tpos AS place FROM pairs JOIN known ON w[i] = a AND w[i + 1] = b),
    marked AS (SELECT *, CASE WHEN NOT base AND place - lag(place) OVER o <= {GAP} THEN 0 WHEN base AND place = lag(place) OVER o THEN 0 ELSE 1 END AS fresh
        FROM hits WINDOW o AS (PARTITION BY doc_id, t ORDER BY place, tpos)),
    spans AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, t ORDER BY place, tpos) AS span FROM marked),
    merged AS (SELECT doc_id, label, base, min(place) AS place, count(DISTINCT tpos) / m AS share
        FROM spans GROUP BY doc_id, t, label, base, m, span HAVING count(DISTINCT tpos) / m >= CASE WHEN base THEN 1 ELSE {COVERAGE} END),
    found AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(place) FILTER (base) AS first_word, max(place) FILTER (base) AS last_word,
        string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
        round(max(share), 6) AS score FROM merged GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, coalesce(base_labels, '') AS base_labels,
        coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word
    FROM listed LEFT JOIN found USING (doc_id)"""
