"""License scan: exact phrases, and an exact set-similarity join with license templates, with SQL functions only.

Base labels: places where a phrase's words stand one after the other. Labels of the method: a text block whose word set holds at least the share
``CONTAINMENT`` of a template's word set. A block of a template's class is a window of 2 S words that starts at a multiple of S, S being the class's
length, so a passage of up to S words lies whole in a block.

The join, for templates T and blocks B over the templates' vocabulary (other words can't match): words are ordered by how many documents hold
them, rarest first, counted over all documents. With need = ceil(share |T|): a text or block with fewer than need words is passed over (length
filter, first on whole texts, which settles nearly all); B and T must share one of the first |B| - need + 1 words of B and one of the first |T| - need + 1
of T (prefix filter, an equi-join); with i and j words before the shared one, min(|T| - i, |B| - j) + min(i, j) >= need (positional filter); survivors are
verified by their whole intersection.

Results by case. A null text is empty; an empty one, or one without words, has no label and score 0. Texts of any length are read whole, block by block. Repeated rows, repeated ids and null
ids are rows like any other, each with the result of its own text. Ties between templates of one label go to the greater containment. An empty table gives no rows. Columns beyond the
id and the text are not read, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decafix.llm.words import row_key, words
from decafix.plans.lineage import cut

CONTAINMENT = 0.9

# Phrases and labels of the base scan.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Public license notices, as (words of a passage at most, label, notice).
TEMPLATES = [
    (16, "mit", "released under the mit license"),
    (16, "mit", "licensed under the mit license"),
    (16, "apache-2", "licensed under the apache license version 2 0"),
    (16, "gpl-3", "licensed under the gnu general public license version 3"),
    (16, "lgpl", "licensed under the gnu lesser general public license"),
    (16, "mpl-2", "subject to the terms of the mozilla public license v 2 0"),
    (16, "cc-by-nc", "licensed under cc by nc 4 0"),
    (16, "cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    (80, "mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    (80, "bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    (80, "apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    (80, "gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
]


def _sets(templates=TEMPLATES) -> list[tuple[int, str, list[str], int]]:
    """(class, label, words, need) of each template."""
    return [(s, label, sorted(set(t.split())), math.ceil(CONTAINMENT * len(set(t.split())) - 1e-9)) for s, label, t in templates]


def _strings(xs: list[str]) -> Column:
    return F.array(*[F.lit(x) for x in xs])


def _places(w: Column, phrase: str) -> Column:
    """Starts of a phrase in a word array, counted from 0; only texts that hold its rarest word are walked."""
    p = phrase.split()
    walk = F.filter(F.sequence(F.lit(0), F.size(w) - len(p)), lambda i: F.slice(w, i + 1, F.lit(len(p))) == _strings(p))
    return F.when((F.size(w) >= len(p)) & F.array_contains(w, max(p, key=lambda x: (x in ("nc", "license"), len(x)))), walk).otherwise(F.array().cast("array<int>"))


def base(rows: DataFrame) -> DataFrame:
    """Adds n_words, n_base, first_word, last_word, base_labels (an array) to rows with the word array ``w``."""
    out = rows.withColumns({f"__p{i}": _places(F.col("w"), p) for i, p in enumerate(PHRASES)})
    every = F.concat(*[f"__p{i}" for i in range(len(PHRASES))])
    labels = F.filter(F.array(*[F.when(F.size(f"__p{i}") > 0, F.lit(label)) for i, label in enumerate(PHRASES.values())]), lambda x: x.isNotNull())
    out = out.withColumns({"n_words": F.size("w").cast("long"), "n_base": F.size(every).cast("long"), "first_word": F.array_min(every).cast("long"), "last_word": F.array_max(every).cast("long"), "base_labels": F.array_sort(F.array_distinct(labels))})
    return out.drop(*[f"__p{i}" for i in range(len(PHRASES))])


def similar(rows: DataFrame, templates=TEMPLATES) -> DataFrame:
    """(key, label, containment) of all blocks that meet a template; rows of (key, w, v), v being a text's words within the vocabulary.
    Only texts that pass the length filter for some template need ``w``."""
    spark, sets = rows.sparkSession, _sets(templates)
    vocabulary = sorted({x for _, _, t, _ in sets for x in t})
    counted = {r["x"]: r["n"] for r in rows.select(F.explode("v").alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each word of the vocabulary at most
    rank = {x: i for i, x in enumerate(sorted(vocabulary, key=lambda x: (counted.get(x, 0), x)))}
    ranks = F.create_map(*[F.lit(y) for x, i in rank.items() for y in (x, i)])
    index = [(n, s, label, len(t), need, i, sorted(rank[x] for x in t)[i]) for n, (s, label, t, need) in enumerate(sets) for i in range(len(t) - need + 1)]
    prefixes = spark.createDataFrame(index, "template int, class int, label string, size int, need int, i int, r int")
    whole = spark.createDataFrame([(n, sorted(rank[x] for x in t)) for n, (_, _, t, _) in enumerate(sets)], "template int, t array<int>")
    classes = sorted({s for s, _, _, _ in sets})
    least = {s: min(need for c, _, _, need in sets if c == s) for s in classes}
    held = rows.where("w IS NOT NULL").select("key", "w").distinct()
    starts = F.array(*[F.struct(F.lit(s).alias("class"), F.sequence(F.lit(0), F.size("w") - 1, F.lit(s)).alias("at")) for s in classes])
    blocks = held.where(F.size("w") > 0).select("key", "w", F.inline(starts)).select("key", "w", "class", F.explode("at").alias("at"))
    b = F.array_intersect(F.slice("w", F.col("at") + 1, 2 * F.col("class")), _strings(vocabulary))
    blocks = blocks.select("key", "class", "at", F.array_sort(F.transform(b, lambda x: ranks[x])).alias("b"))
    blocks = blocks.where(F.size("b") >= F.element_at(F.create_map(*[F.lit(y) for s in classes for y in (s, least[s])]), F.col("class")))
    least_need = F.element_at(F.create_map(*[F.lit(y) for s in classes for y in (s, least[s])]), F.col("class"))
    probes = blocks.select("key", "class", "at", "b", F.posexplode(F.slice("b", F.lit(1), F.size("b") - least_need + 1)).alias("j", "r"))
    met = probes.join(F.broadcast(prefixes), ["class", "r"])
    met = met.where((F.size("b") >= F.col("need")) & (F.col("j") <= F.size("b") - F.col("need")) & (F.least(F.col("size") - F.col("i"), F.size("b") - F.col("j")) + F.least("i", "j") >= F.col("need")))
    met = met.select("key", "template", "label", "size", "need", "b").join(F.broadcast(whole), "template").withColumn("common", F.size(F.array_intersect("b", "t"))).where("common >= need")
    return met.groupBy("key", "label").agg(F.max(F.col("common") / F.col("size")).alias("containment"))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score. The score is 1 with a base
    label, else the greatest containment that met a template, else 0."""
    sets = _sets()
    rows = docs.select(F.col(doc_id).alias("doc_id"), row_key(F.col(doc_id), F.col(text)).alias("key"), words(F.col(text)).alias("w"))
    rows = base(rows).withColumn("v", F.array_intersect("w", _strings(sorted({x for _, _, t, _ in sets for x in t}))))
    passes = F.lit(False)
    for _, _, t, need in sets:
        passes = passes | (F.size(F.array_intersect("v", _strings(t))) >= need)
    rows = cut(rows.withColumn("w", F.when(passes, F.col("w"))))
    more = similar(rows).groupBy("key").agg(F.collect_set("label").alias("more"), F.max("containment").alias("containment"))
    out = rows.join(more, "key", "left")
    labels = F.array_sort(F.array_union("base_labels", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.when(F.size("base_labels") > 0, 1.0).otherwise(F.coalesce("containment", F.lit(0.0)))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))
