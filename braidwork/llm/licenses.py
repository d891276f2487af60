"""License scans: exact set-similarity join of text blocks with license templates, in DataFrame operations only.

A block is a line, or a paragraph where the caller says so. A template of m distinct tokens matches a block that holds at least
ceil(threshold * m) of them. Tokens are ordered by their document frequency over the whole corpus,
rarest first. Only prefixes are joined (a template's first m - need + 1 tokens, a block's first
b - need + 1), under the length filter b >= need and the positional filter on what may still
follow; survivors are verified on full sets, so that no block is missed.

The templates are a parameter; their vocabulary, frequencies and prefixes are bounded by it and
are the only things broadcast. One pass reads all texts; a text goes on to the line level only if
it holds `need` tokens of some template anywhere, which every matching line implies.

Defined results. Null or empty text: no words, no places, empty labels, score 0. Lines join on
(id, tag of the text), so repeated rows get the same result each. A null id is an id. An empty
table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.llm.columns import LOWER, UPPER, text_tag
from braidwork.llm.scratch import Scratch

#: What separates words, and the base phrases with their labels.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Opening words of public licenses.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "You may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("all-rights-reserved", "All rights reserved"),
)
THRESHOLD = 0.8
#: What separates blocks: lines, or paragraphs, for texts with hard-wrapped lines.
LINES, PARAGRAPHS = "\n", r"\n[\x20\x09-\x0D]*\n"


@dataclass(frozen=True)
class Template:
    label: str
    tokens: frozenset[str]
    need: int
    must: frozenset[str] = frozenset()


def _tokens(text: str) -> frozenset[str]:
    return frozenset(x for x in re.split(r"[^0-9a-z\u0080-\U0010ffff]+", text.lower()) if x)


def compiled(templates=TEMPLATES, threshold: float = THRESHOLD, must: dict[str, str] | None = None) -> list[Template]:
    """Templates as token sets; `must` names, by a template's text, words of it that no block may lack."""
    out = []
    for label, text in templates:
        tokens = _tokens(text)
        out.append(Template(label, tokens, math.ceil(threshold * len(tokens) - 1e-9), tokens & _tokens((must or {}).get(text, ""))))
    return out


def _words(text):
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), SEPARATORS), "")


def _strings(items):
    return F.array(*[F.lit(x) for x in sorted(items)])


def _places(phrase: str):
    """Word numbers at which a phrase starts; looked for only where its last word occurs at all."""
    parts = phrase.split()
    at = F.sequence(F.lit(0), F.size("_words") - len(parts))

    def here(i):
        found = F.get(F.col("_words"), i) == parts[0]
        for k, p in enumerate(parts[1:], 1):
            found = found & (F.get(F.col("_words"), i + k) == p)
        return found

    possible = (F.size("_words") >= len(parts)) & F.col("_hint")
    return F.when(possible, F.filter(at, here)).otherwise(F.array().cast("array<int>"))


def _scan(docs: DataFrame, id_col: str, text_col: str, templates: list[Template]) -> DataFrame:
    """The pass over all texts: base places, template words, and the text where a line may match."""
    vocabulary = set().union(*[t.tokens for t in templates])
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), text_tag(text_col).alias("_tag"), text.alias("_text"), _words(text).alias("_words"))
    hint = " or ".join(f"array_contains(_words, '{x}')" for x in sorted({p.split()[-1] for p, _ in PHRASES}))
    rows = rows.withColumn("_hint", F.expr(hint)).withColumn("_known", F.array_intersect("_words", _strings(vocabulary)))
    found = [_places(p).alias(f"_p{i}") for i, (p, _) in enumerate(PHRASES)]
    rows = rows.select("_id", "_tag", "_text", F.size("_words").cast("long").alias("n_words"), "_known", *found)
    everywhere = F.concat(*[F.col(f"_p{i}") for i in range(len(PHRASES))])
    labels = F.array_compact(F.array(*[F.when(F.size(f"_p{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(PHRASES)]))
    possible = F.lit(False)
    for t in templates:
        possible = possible | (F.size(F.array_intersect("_known", _strings(t.tokens))) >= t.need)
    return rows.withColumn("_all", everywhere).select(
        "_id", "_tag", "n_words", "_known",
        F.size("_all").cast("long").alias("n_base"), F.array_min("_all").cast("long").alias("first_word"), F.array_max("_all").cast("long").alias("last_word"),
        labels.alias("_base"), F.when(possible, F.col("_text")).alias("_text"),
    )


def _matches(spark: SparkSession, scanned: DataFrame, templates: list[Template], breaks: str) -> DataFrame:
    """(_id, _tag, _label, _share): the prefix join of lines and templates, verified."""
    counted = scanned.select(F.explode("_known").alias("t")).groupBy("t").count().collect()  # the vocabulary at most
    frequency = {r["t"]: r["count"] for r in counted}
    order = {t: i for i, t in enumerate(sorted(set().union(*[x.tokens for x in templates]), key=lambda t: (frequency.get(t, 0), t)))}
    prefix = []
    for k, t in enumerate(templates):
        ranks = sorted(order[x] for x in t.tokens)
        prefix += [(r, k, pos, t.need, len(ranks)) for pos, r in enumerate(ranks[: len(ranks) - t.need + 1])]
    values = ", ".join(f"({', '.join(map(str, row))})" for row in prefix)
    left = spark.sql(f"select * from values {values} as v(rank, tmpl, tpos, need, m)")
    full = ", ".join(f"({k}, array({', '.join(str(order[x]) for x in sorted(t.tokens))}), cast(array({', '.join(str(order[x]) for x in sorted(t.must))}) as array<int>), '{t.label}')" for k, t in enumerate(templates))
    sets = spark.sql(f"select * from values {full} as v(tmpl, tokens, must, label)")
    ranks = F.create_map(*[F.lit(x) for t, i in order.items() for x in (t, i)])
    least = min(t.need for t in templates)
    lines = scanned.where("_text is not null").select("_id", "_tag", F.posexplode(F.split("_text", breaks)).alias("_line", "_block"))
    known = F.array_intersect(_words(F.col("_block")), _strings(order))
    blocks = lines.withColumn("_known", known).where(F.size("_known") >= least).select("_id", "_tag", "_line", F.array_sort(F.transform("_known", lambda x: F.element_at(ranks, x))).alias("_ranks"))
    heads = blocks.select("_id", "_tag", "_line", "_ranks", F.posexplode(F.slice("_ranks", 1, F.size("_ranks") - least + 1)).alias("bpos", "rank"))
    b = F.size("_ranks")
    fits = (F.col("bpos") <= b - F.col("need")) & (F.least(F.col("m") - F.col("tpos"), b - F.col("bpos")) >= F.col("need"))
    pairs = heads.join(F.broadcast(left), "rank").where(fits).dropDuplicates(["_id", "_tag", "_line", "tmpl"])
    both = F.size(F.array_intersect("_ranks", "tokens"))
    return pairs.join(F.broadcast(sets), "tmpl").where((both >= F.col("need")) & (F.size(F.array_except("must", "_ranks")) == 0)).select("_id", "_tag", F.col("label").alias("_label"), (both / F.col("m")).alias("_share"))


def license_scan(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD, breaks: str = LINES, must: dict[str, str] | None = None) -> DataFrame:
    """One row per document: base phrase places, all labels, and a score: 1 with a base phrase, else the best containment.

    `breaks` separates blocks (LINES, PARAGRAPHS or another expression); `must` asks for words of short templates, by their texts.
    """
    scratch = Scratch(spark, "license")
    held = compiled(templates, threshold, must)
    scanned = scratch.keep(_scan(docs, id_col, text_col, held))
    found = _matches(spark, scanned, held, breaks).groupBy("_id", "_tag").agg(F.collect_set("_label").alias("_more"), F.max("_share").alias("_share"))
    found = found.select(F.col("_id").alias("_i"), F.col("_tag").alias("_t"), "_more", "_share")
    joined = scanned.drop("_text", "_known").join(found, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_tag") == F.col("_t")), "left")
    labels = F.array_sort(F.array_distinct(F.concat("_base", F.coalesce("_more", F.array().cast("array<string>")))))
    return joined.select(
        F.col("_id").alias(id_col), "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("_base"), ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("_share", F.lit(0.0))).alias("score"),
    )
