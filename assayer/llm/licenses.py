"""License scans: an exact set-similarity join of text blocks with license templates, and places of short phrases.

A template is the set of its words.  Blocks of a template's size class overlap so that any stretch as long as the template
lies in one of them.  Words are ordered by the number of documents that have them, rarest first.  A block that holds the
wanted share of a template must share one of the template's first (rarest) words among its own first words; blocks and
templates meet by an equi-join on those prefixes, under a length and a positional filter, and whole sets confirm.
Everything is DataFrame operations.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, functions as F

from assayer.llm.shared import small_or_shuffled
from assayer.llm.urls import LOWER, UPPER
from assayer.operators.joins import once
from assayer.session import written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PERCENT = 80
#: Templates are parameters that every task holds; more than this many is an error.
TEMPLATES_AT_MOST = 1000

#: Phrases whose words stand one after the other.
PHRASES = [("gpl", "gnu general public license"), ("apache", "apache license"), ("cc-by", "cc by"), ("mit", "mit license")]

#: Usual notices of public licenses.
TEMPLATES = [
    ("mit-notice", "Released under the MIT License."),
    ("mit-notice", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, "
                   "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
                   "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("apache-notice", "Licensed under the Apache License, Version 2.0."),
    ("apache-notice", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
                      "You may obtain a copy of the License"),
    ("gnu-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("gnu-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
                   "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("cc-notice", "Licensed under CC BY-NC 4.0."),
    ("cc-notice", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("bsd-notice", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc-notice", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
                   "copyright notice and this permission notice appear in all copies."),
    ("mpl-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("public-domain-notice", "This is free and unencumbered software released into the public domain."),
]


def words_of(text: Column) -> Column:
    """Lower-cased words of a text, in order; none of a null text.

    Two letters outside ASCII (U+0130, U+212A) have lower-case forms inside it; in texts with one of them A-Z alone are lowered.
    """
    text = F.coalesce(text.cast("string"), F.lit(""))
    low = F.when(text.contains("İ") | text.contains("K"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))
    return F.regexp_extract_all(low, F.lit(WORD), F.lit(0))


def template_sets(templates: list[tuple[str, str]], percent: int = PERCENT) -> list[dict]:
    """Each template's words, how many of them a block needs, and the step of its blocks, a power of two of at least its length."""
    out = []
    for i, (label, text) in enumerate(templates):
        words = re.findall(WORD, text.lower())
        if words:
            own = sorted(set(words))
            out.append({"no": i, "label": label, "words": own, "need": -(-percent * len(own) // 100), "step": max(8, 1 << (len(words) - 1).bit_length())})
    if len(out) > TEMPLATES_AT_MOST:
        raise ValueError(f"more than {TEMPLATES_AT_MOST} templates")
    return out


def places(words: Column, phrases: list[tuple[str, str]]) -> Column:
    """(start, label) wherever the words of a phrase stand consecutively; starts count from 0."""
    def one(label, phrase):
        want = phrase.split()
        here = lambda i: F.lit(True) if not want[1:] else _all([F.get(words, i + k) == w for k, w in enumerate(want)])
        at = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: (F.get(words, i) == want[0]) & here(i))
        return F.when(F.array_contains(words, want[0]) & F.array_contains(words, want[-1]), F.transform(at, lambda i: F.struct(i.alias("start"), F.lit(label).alias("label"))))

    empty = F.array().cast("array<struct<start: int, label: string>>")
    return F.concat(empty, *[F.coalesce(one(*p), empty) for p in phrases])


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return F.coalesce(out, F.lit(False))


def _read(docs: DataFrame, sets: list[dict], phrases, id_col: str, text_col: str) -> DataFrame:
    """Each row once: number of words, phrase places, which template words it has, and where, if it can hold a template at all."""
    vocabulary = sorted({w for t in sets for w in t["words"]})
    known = F.from_json(F.lit(json.dumps([{k: t[k] for k in ("words", "need", "step")} for t in sets])), "array<struct<words: array<string>, need: int, step: int>>")
    df = once(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("t")), words=words_of(F.col("t"))).select("id", "words")
    df = once(df, n_words=F.size("words").cast("long"), found=places(F.col("words"), phrases),
              has=F.array_intersect("words", F.lit(vocabulary).cast("array<string>")))
    steps = F.filter(known, lambda t: F.size(F.array_intersect(t.words, F.col("has"))) >= t.need)
    df = once(df, steps=F.when(F.size("has") >= min([t["need"] for t in sets], default=1), F.array_distinct(F.transform(steps, lambda t: t.step))))
    at = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("at"), w.alias("word"))), lambda x: x.word.isin(vocabulary or [""]))
    df = df.select("id", "n_words", "found", "has", "steps", F.when(F.size("steps") > 0, at).alias("hits"))
    return written(df.withColumn("row", F.monotonically_increasing_id()), "license-words")


def matching_blocks(read: DataFrame, sets: list[dict]) -> DataFrame:
    """(row, template, label, start, words, containment): every block that holds the wanted share of a template's words."""
    spark = read.sparkSession
    seen = {r.w: r.n for r in read.select(F.explode("has").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}  # one row a template word
    order = {w: i for i, w in enumerate(sorted({w for t in sets for w in t["words"]}, key=lambda w: (seen.get(w, 0), w)))}
    least, entries, prefixes = {}, set(), []
    for t in sets:
        own = sorted(order[w] for w in t["words"])
        least[t["step"]] = min(t["need"], least.get(t["step"], t["need"]))
        entries |= {(t["step"], w) for w in t["words"]}
        prefixes += [(t["step"], r, i, len(own), t["need"], t["no"], t["label"], own) for i, r in enumerate(own[:len(own) - t["need"] + 1])]
    entries = spark.createDataFrame([(s, w, order[w], least[s]) for s, w in sorted(entries)], "step int, word string, rank int, least int")
    prefixes = spark.createDataFrame(prefixes, "step int, rank int, i int, size int, need int, template int, label string, own array<int>")

    hits = read.where("size(steps) > 0").select("row", "steps", F.explode("hits").alias("hit")).select("row", "steps", "hit.at", "hit.word")
    hits = hits.join(F.broadcast(entries), "word").where(F.array_contains("steps", F.col("step")))
    block = F.floor(F.col("at") / F.col("step"))
    hits = hits.select("row", "step", "least", "rank", F.explode(F.when(block > 0, F.array(block - 1, block)).otherwise(F.array(block))).alias("block"))
    blocks = hits.groupBy("row", "step", "block").agg(F.sort_array(F.collect_set("rank")).alias("set"), F.max("least").alias("least"))
    blocks = blocks.withColumn("n", F.size("set")).where("n >= least")
    first = blocks.select("row", "step", "block", "set", "n", F.posexplode(F.slice(F.col("set"), F.lit(1), F.col("n") - F.col("least") + 1)).alias("j", "rank"))
    pairs = first.join(F.broadcast(prefixes), ["step", "rank"]).where("n >= need and 1 + least(size - i - 1, n - j - 1) >= need")
    pairs = pairs.dropDuplicates(["row", "step", "block", "template"]).withColumn("both", F.size(F.array_intersect("set", "own"))).where("both >= need")
    return pairs.select("row", "template", "label", (F.col("block") * F.col("step")).alias("start"), (2 * F.col("step")).alias("words"),
                        (F.col("both") / F.col("size")).alias("containment"))


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, phrases: list[tuple[str, str]] | None = None, percent: int = PERCENT,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, places, blocks) for each row of docs.

    places: (start, label) of every phrase, starts from word 0.  blocks: (label, template, start, words, containment) of
    every block that holds at least `percent` of a template's distinct words; template counts from 0 in `templates`.  Null
    and empty texts have no word, and empty lists; texts are taken whole; repeated rows and null ids keep their row; further
    columns are ignored, whatever their names.  A template without words is never found.
    """
    sets = template_sets(TEMPLATES if templates is None else templates, percent)
    read = _read(docs, sets, PHRASES if phrases is None else phrases, id_col, text_col)
    found = matching_blocks(read, sets).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("label", "template", "start", "words", "containment"))).alias("blocks"))
    found = written(found, "license-blocks")
    rows = read.join(small_or_shuffled(found, found.count() * 16), "row", "left")
    return rows.select(F.col("id").alias(id_col), "n_words", F.col("found").alias("places"),
                       F.coalesce("blocks", F.array().cast(found.schema["blocks"].dataType)).alias("blocks"))
