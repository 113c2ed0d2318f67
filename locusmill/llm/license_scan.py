"""License scans by diagonal voting: word bigrams joined to template positions (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ALNUM_WORD, ascii_lower

#: Phrases that always name their license: (words, label).
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
# Sentences of public licenses and notices, matched approximately: (words, label).
TEMPLATES = (
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("you may not use this file except in compliance with the license", "apache-2.0-notice"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "apache-2.0-warranty"),
    ("this work is licensed under the gnu general public license version", "gpl-versioned"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl-notice"),
    ("this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose", "gpl-warranty"),
    ("you should have received a copy of the gnu general public license along with this program", "gpl-copy"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("this work is licensed under a creative commons attribution", "cc-attribution"),
    ("to the extent possible under law the author has waived all copyright and related or neighboring rights", "cc0"),
    ("released under the mit license", "mit-release"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit-text"),
    ("to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", "mit-rights"),
    ("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", "mit-warranty"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd-text"),
    ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "bsd-conditions"),
    ("may be used to endorse or promote products derived from this software without specific prior written permission", "bsd-names"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("this program and the accompanying materials are made available under the terms of the eclipse public license", "epl"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("in no event will the authors be held liable for any damages arising from the use of this software", "zlib"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("distributed under the boost software license version 1 0", "bsl-1.0"),
    ("all rights reserved", "all-rights-reserved"),
)
K = 2


def template_grams(spark: SparkSession, base=BASE, templates=TEMPLATES) -> DataFrame:
    """One row per template and word position: template, label, base, need (bigrams of it), tpos, w0, w1, gram."""
    rows = []
    for n, (phrase, label, is_base) in enumerate([(*x, True) for x in base] + [(*x, False) for x in templates]):
        w = phrase.split()
        rows += [(n, label, is_base, len(w) - K + 1, i, w[i], w[i + 1]) for i in range(len(w) - K + 1)]
    df = spark.createDataFrame(rows, "template int, label string, base boolean, need int, tpos int, w0 string, w1 string")
    return df.withColumn("gram", F.xxhash64("w0", "w1"))


def drift_of(need: int, is_base: bool) -> int:
    """How many words may be put in or left out within one place of a template: none in a base phrase."""
    return 0 if is_base else max(2, need // 4)


def license_scan(docs: DataFrame, base=BASE, templates=TEMPLATES, coverage: float = 0.75) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of each document.

    Every rolling word bigram of every text is hashed; those among the templates' hashes (a
    fixed list of a few hundred) are joined to the template positions, where their words are
    compared. Hits vote for the diagonal (text position minus template position). From each
    diagonal on, those up to drift_of() further are merged: words put in or left out. The span
    is verified word by word: in order of the text, hits count that go on in the template, and
    these must be all of a base phrase, or the share coverage of another template. score is the
    largest share reached by any template (base phrases: 1), 0 without a hit.
    Null and empty texts have no words and no label. Rows are told apart by position, not by
    doc_id, so null, repeated and equal rows are fine; very long texts are scanned whole; other
    columns of docs, whatever their names, are not read; an empty table gives no rows.
    """
    spark, sizes = docs.sparkSession, [(len(p.split()) - K + 1, True) for p, _ in base] + [(len(p.split()) - K + 1, False) for p, _ in templates]
    grams = template_grams(spark, base, templates)
    wanted = sorted({r.gram for r in grams.select("gram").collect()})  # as many as the templates have words
    d = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.coalesce(F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(ALNUM_WORD), 0), F.array().cast("array<string>")).alias("words"))
    d = d.withColumn("n_words", F.size("words").cast("long"))
    gram = lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1))
    hits = F.when(F.col("n_words") >= K, F.filter(F.sequence(F.lit(0), F.col("n_words").cast("int") - K), lambda i: gram(i).isin(wanted)))
    x = d.select("rid", "doc_id", "n_words", "words", F.explode_outer(hits).alias("pos"))
    x = x.select("rid", "doc_id", "n_words", "pos", gram(F.col("pos")).alias("gram"), F.get("words", F.col("pos")).alias("x0"), F.get("words", F.col("pos") + 1).alias("x1"))
    x = x.join(F.broadcast(grams), (x["gram"] == grams["gram"]) & (F.col("x0") == F.col("w0")) & (F.col("x1") == F.col("w1")), "left")
    keys = ["rid", "doc_id", "n_words", "template", "label", "base", "need"]
    diag = x.groupBy(*keys, (F.col("pos") - F.col("tpos")).alias("diag")).agg(F.collect_list(F.struct("pos", "tpos")).alias("at"))
    farthest = max((drift_of(*n) for n in sizes), default=0)
    near = Window.partitionBy("rid", "template").orderBy("diag").rangeBetween(0, farthest)
    allowed = F.when(F.col("base"), 0).otherwise(F.greatest(F.lit(2), F.floor(F.col("need") / 4)))
    merged = F.array_sort(F.filter(F.flatten(F.collect_list("at").over(near)), lambda p: p["pos"] - p["tpos"] <= F.col("diag") + F.col("allowed")))
    # of the hits in order of the text, those count that lie further on in the template than all before
    onwards = F.aggregate("places", F.struct(F.lit(-1).alias("top"), F.lit(0).alias("n")), lambda a, p: F.struct(F.greatest(a["top"], p["tpos"]).alias("top"), (a["n"] + (p["tpos"] > a["top"]).cast("int")).alias("n")))["n"]
    band = diag.withColumn("allowed", allowed).withColumn("places", merged).withColumn("votes", F.when(F.col("template").isNotNull(), onwards))
    band = band.withColumn("share", F.col("votes") / F.col("need"))
    ok_base = F.col("base") & (F.col("votes") == F.col("need"))
    ok = ok_base | (~F.col("base") & (F.col("share") >= coverage))
    joined = lambda cond: F.array_join(F.array_sort(F.collect_set(F.when(cond, F.col("label")))), ",")
    return band.groupBy("rid", "doc_id", "n_words").agg(
        F.sum(F.when(ok_base, 1).otherwise(0)).cast("long").alias("n_base"),
        F.min(F.when(ok_base, F.col("diag"))).cast("long").alias("first_word"),
        F.max(F.when(ok_base, F.col("diag"))).cast("long").alias("last_word"),
        joined(ok_base).alias("base_labels"),
        joined(ok).alias("labels"),
        F.coalesce(F.max(F.when(ok | ~F.col("base"), F.col("share"))), F.lit(0.0)).alias("score"),
    ).drop("rid")
