"""License scans by diagonal voting, in DataFrame operations only.

Every place of every whole text gives a k-gram (``K`` words; its first ``SEED`` words are hashed, the rest is compared). All of them are
joined with the places of the templates, a table bounded by the templates themselves and so broadcast. A match votes for a diagonal: the
document's place less the template's. Votes are summed by diagonal; diagonals up to ``BAND`` apart, where words were put in or left out,
are merged into the strongest of them. A span is verified where the words that its votes cover, each compared and counted once, make up
``LEAST`` of the template and of the span.

Base phrases are short templates of which every word must stand on one diagonal; each such place counts. Texts are scanned once; positions
meet the templates where they are read, and only matches and one row for each document are shuffled, by a number of the row.

Cases. Null and empty texts have no word and no label, and keep a row; null ids and repeated rows keep a row each. Only A-Z are lower-cased
(two characters whose lower case is ASCII are put aside first). Of neighbouring diagonals with as many votes the lowest stands. Places of
one phrase may overlap, and all count. Very long texts are one row, of work in proportion to their words. Empty tables give no rows;
columns besides doc_id and text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pageline.llm.common import documents

#: Words of a k-gram, how many of them are hashed, diagonals that count as neighbours, least share of template and span.
K, SEED, BAND, LEAST = 3, 2, 4, 0.75
#: What stands between words: ASCII without digits and letters.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]++"

#: Characters beyond ASCII whose lower case begins in ASCII (Kelvin sign, dotted capital I), and what stands for them.
FOLDING, INSTEAD = "\u212a\u0130", "\u0138\u0131"

# The base phrases and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# Short notices and sentences of well-known public licenses, and their labels.
TEMPLATES = (
    ("licensed under the apache license version 2 0", "apache"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "apache"),
    ("released under the mit license", "mit"),
    ("licensed under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("has waived all copyright and related or neighboring rights to this work", "cc0"),
    ("no part of this publication may be reproduced stored in a retrieval system or transmitted in any form or by any means", "reserved"),
)


@dataclass(frozen=True)
class Template:
    words: tuple[str, ...]
    label: str
    base: bool


def templates(phrases=PHRASES, notices=TEMPLATES) -> list[Template]:
    """Phrases (of ``SEED`` words or more) and notices (of ``K`` or more) as lists of words."""
    found = [Template(tuple(text.split()), label, base) for rows, base in ((phrases, True), (notices, False)) for text, label in rows]
    for t in found:
        if len(t.words) < (SEED if t.base else K):
            raise ValueError(f"too short: {' '.join(t.words)}")
    return found


def template_places(spark: SparkSession, known: list[Template]) -> DataFrame:
    """A row for each k-gram of each template; one shorter than ``K`` has a single gram, with nulls behind its words."""
    rows = []
    for n, t in enumerate(known):
        size = min(K, len(t.words))
        grams = len(t.words) - size + 1
        rows += [(n, i, grams, len(t.words), t.label, t.base, *t.words[i : i + size], *[None] * (K - size)) for i in range(grams)]
    own = ", ".join(f"t{i} string" for i in range(K))
    kind = f"template int, t_pos int, grams int, t_words int, label string, base boolean, {own}"
    return spark.createDataFrame(rows, kind).withColumn("t_hash", F.xxhash64(*(f"t{i}" for i in range(SEED))))


def word_places(df: DataFrame) -> DataFrame:
    """row, doc_id, n_words, pos and the words w0, w1, ... from pos on; a text without words keeps a row whose pos is null."""
    # lower() folds all of Unicode; of characters beyond ASCII only two fold into it, the others never equal ASCII
    raw = F.coalesce(F.col("text"), F.lit(""))
    low = F.when(raw.rlike(f"[{FOLDING}]"), F.lower(F.translate(raw, FOLDING, INSTEAD))).otherwise(F.lower(raw))
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.split(low, GAP, -1).alias("w"))
    first = (F.element_at("w", 1) == "").cast("int")
    last = ((F.element_at("w", -1) == "") & (F.size("w") > 1)).cast("int")
    rows = rows.select("row", "doc_id", (F.size("w") - first - last).cast("long").alias("n_words"), F.slice("w", first + 1, F.size("w") - first - last).alias("w"))
    ahead = F.arrays_zip(*(F.slice("w", F.lit(i + 1), F.size("w")).alias(f"w{i}") for i in range(K)))
    placed = rows.select("row", "doc_id", "n_words", F.posexplode_outer(ahead).alias("pos", "x"))
    return placed.select("row", "doc_id", "n_words", "pos", "x.*")


def votes(df: DataFrame, known: list[Template]) -> DataFrame:
    """Votes by row, template and diagonal, with the places they come from; a row without any keeps one, whose template is null."""
    table = template_places(df.sparkSession, known)
    places = word_places(df).withColumn("hash", F.xxhash64(*(f"w{i}" for i in range(SEED))))
    alike = F.col("hash") == F.col("t_hash")
    for i in range(K):
        alike = alike & ((F.col(f"w{i}") == F.col(f"t{i}")) if i < SEED else (F.col(f"t{i}").isNull() | (F.col(f"w{i}") == F.col(f"t{i}"))))
    # a few hundred rows, given by the templates
    met = places.join(F.broadcast(table), alike, "left").filter(F.col("template").isNotNull() | F.col("pos").isNull() | (F.col("pos") == 0))
    met = met.select("row", "doc_id", "n_words", "template", "label", "base", "grams", "t_words", "pos", "t_pos").repartition("row")
    return met.groupBy("row", "doc_id", "n_words", "template", "label", "base", "grams", "t_words", (F.col("pos") - F.col("t_pos")).alias("diagonal")).agg(
        F.collect_list("t_pos").alias("t_places"), F.count("t_pos").alias("n_votes"), F.min("pos").alias("lo"), F.max("pos").alias("hi")
    )


def license_spans(df: DataFrame, known: list[Template] | None = None) -> DataFrame:
    """row, doc_id, n_words, label, base, start_word, end_word (exclusive), score of every verified span; a row without any keeps one with a null label."""
    found = votes(df, known or templates())
    near = Window.partitionBy("row", "template").orderBy("diagonal").rangeBetween(-BAND, BAND)
    found = found.withColumns(
        {
            "strongest": F.max(F.struct("n_votes", (-F.col("diagonal")).alias("back"))).over(near),
            "merged": F.flatten(F.collect_list("t_places").over(near)),
            "start": F.min("lo").over(near),
            "end": F.max("hi").over(near) + K,
        }
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("merged", lambda t: F.array(*(t + i for i in range(K)))))))
    found = found.withColumn("covered", F.when(~F.col("base"), covered))
    peak = (F.col("strongest.n_votes") == F.col("n_votes")) & (F.col("strongest.back") == -F.col("diagonal"))
    holds = peak & (F.col("covered") >= LEAST * F.col("t_words")) & (F.col("covered") >= LEAST * (F.col("end") - F.col("start")))
    verified = F.coalesce(F.when(F.col("base"), F.col("n_votes") == F.col("grams")).otherwise(holds), F.lit(False))
    told = {
        "label": F.col("label"),
        "base": F.col("base"),
        "start_word": F.when(F.col("base"), F.col("diagonal")).otherwise(F.col("start")).cast("long"),
        "end_word": F.when(F.col("base"), F.col("diagonal") + F.col("t_words")).otherwise(F.col("end")).cast("long"),
        "score": F.when(F.col("base"), F.lit(1.0)).otherwise(F.col("covered") / F.col("t_words")),
    }
    return found.select("row", "doc_id", "n_words", *(F.when(verified, c).alias(k) for k, c in told.items()))


def op11_licenses(spark, sf_dir: str) -> DataFrame:
    """Labels and places of licenses in every whole text."""
    spans = license_spans(documents(spark, sf_dir).select("doc_id", "text"))
    base = F.col("base")

    def joined(which):
        return F.array_join(F.array_sort(F.collect_set(which)), ",")

    out = spans.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("start_word"))).alias("first_word"),
        F.max(F.when(base, F.col("start_word"))).alias("last_word"),
        joined(F.when(base, F.col("label"))).alias("base_labels"),
        joined(F.col("label")).alias("labels"),
        F.coalesce(F.max("score"), F.lit(0.0)).alias("score"),
        F.count("label").alias("n_spans"),
    )
    return out.drop("row")


_ROWS = ", ".join(
    f"({n}, {i}, {len(t.words) - min(K, len(t.words)) + 1}, {len(t.words)}, '{t.label}', {str(t.base).lower()}, {', '.join(f"'{w}'" if w else 'NULL' for w in [*t.words[i : i + min(K, len(t.words))], *[None] * K][:K])})"
    for n, t in enumerate(templates())
    for i in range(len(t.words) - min(K, len(t.words)) + 1)
)
#: The same over words instead of hashes; one letter at a time is lower-cased by translate.
ORACLE = f"""WITH t(template, t_pos, grams, t_words, label, base, t0, t1, t2) AS (VALUES {_ROWS}),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
p AS (SELECT r, unnest(range(len(w))) AS pos, unnest(w) AS w0, unnest(w[2:] || [NULL]) AS w1, unnest(w[3:] || [NULL, NULL]) AS w2 FROM d WHERE len(w) > 0),
v AS (SELECT r, template, label, base, grams, t_words, pos - t_pos AS diagonal, list(t_pos) AS places, count(*) AS n, min(pos) AS lo, max(pos) AS hi
  FROM p JOIN t ON w0 = t0 AND w1 = t1 AND (t2 IS NULL OR w2 = t2) GROUP BY ALL),
m AS (SELECT v.*, max(n) OVER near AS most, flatten(list(places) OVER near) AS merged, min(lo) OVER near AS s, max(hi) OVER near + {K} AS e,
  list({{'n': n, 'd': diagonal}}) OVER near AS all_near FROM v WINDOW near AS (PARTITION BY r, template ORDER BY diagonal RANGE BETWEEN {BAND} PRECEDING AND {BAND} FOLLOWING)),
c AS (SELECT m.*, diagonal = list_min(list_transform(list_filter(all_near, lambda x: x.n = most), lambda x: x.d)) AS peak,
  len(list_distinct(flatten(list_transform(merged, lambda x: [x, x + 1, x + 2])))) AS covered FROM m),
f AS (SELECT r, label, base, diagonal, CASE WHEN base THEN 1.0 ELSE CAST(covered AS DOUBLE) / t_words END AS score FROM c
  WHERE CASE WHEN base THEN n = grams ELSE peak AND covered >= {LEAST} * t_words AND covered >= {LEAST} * (e - s) END)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, count(*) FILTER (base) AS n_base, CAST(min(diagonal) FILTER (base) AS BIGINT) AS first_word, CAST(max(diagonal) FILTER (base) AS BIGINT) AS last_word,
  coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (base)), ','), '') AS base_labels, coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (label IS NOT NULL)), ','), '') AS labels,
  CAST(coalesce(max(score), 0) AS DOUBLE) AS score, count(label) AS n_spans FROM d LEFT JOIN f USING (r) GROUP BY r, doc_id, w"""
