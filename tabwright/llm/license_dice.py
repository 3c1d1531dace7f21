"""License scan: text segments against license templates by the Dice coefficient of their word bigrams.
DataFrame functions only.

A segment is a sentence, a line, a paragraph or the whole of a text. Words are runs of letters and digits in lower
case; a segment's bigrams form a set. Dice = 2 |shared| / (|segment| + |template|).

Pruning loses nothing:
* Dice >= s needs |segment| between s / (2 - s) and (2 - s) / s times |template|, so segments outside every
  template's bounds go before anything is exploded, and a pair outside its own bounds is no candidate.
* Dice >= s also needs s / (2 - s) |template| shared bigrams, so a segment must hold one of any
  |template| - ceil(s / (2 - s) |template|) + 1 of the template's bigrams. For each template the most telling
  ones are taken (long words first); a document with none of them is never split into segments.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MIN_DICE = 0.8

# Notices by which texts declare a license.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
            "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
            "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
            "subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except "
                   "in compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation, either version 3 of the "
                "License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation; either version 2 of the "
                "License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU "
                 "Lesser General Public License as published by the Free Software Foundation; either version 2.1 of "
                 "the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                 "Affero General Public License as published by the Free Software Foundation, either version 3 of "
                 "the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the "
                "MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                     "provided that the following conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all "
            "copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring "
                "rights to this work."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International "
                     "License."),
    ("proprietary", "All rights reserved."),
]

_SENTENCE = r"(?<=[.!?;:])\s+"


def _plain_bigrams(text: str) -> list[str]:
    w = re.findall(r"[^\W_]+", text.lower())
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:], strict=False)))


def words(text: Column) -> Column:
    """Runs of letters and digits of a text in lower case; none for a null or empty text."""
    plain = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return F.when(F.length(plain) > 0, F.split(plain, " ")).otherwise(F.array().cast("array<string>"))


def bigrams(w: Column) -> Column:
    """Set of the neighbouring word pairs of an array of words."""
    pairs = F.arrays_zip(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))).alias("a"),
                         F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))).alias("b"))
    return F.array_distinct(F.transform(pairs, lambda p: F.concat(p["a"], F.lit(" "), p["b"])))


def segments(text: Column) -> Column:
    """The different sentences, lines, paragraphs and the whole of a text, trimmed."""
    lines = F.split(text, r"[\r\n]+")
    sentences = F.flatten(F.transform(lines, lambda x: F.split(x, _SENTENCE)))
    parts = F.concat(F.array(text), F.split(text, r"\r?\n[ \t]*\r?\n"), lines, sentences)
    return F.array_distinct(F.transform(parts, lambda x: F.trim(x)))


def template_table(spark: SparkSession, templates: list[tuple[str, str]]) -> DataFrame:
    """(template, license, bigrams, n): the list given, its size is the broadcast's bound."""
    rows = [(i, name, b, len(b)) for i, (name, text) in enumerate(templates) if (b := _plain_bigrams(text))]
    return spark.createDataFrame(rows, "template int, license string, bigrams array<string>, n int")


def _telling(templates: list[tuple[str, str]], min_dice: float) -> list[str]:
    """Bigrams of which a segment must hold one to reach ``min_dice`` with any template."""
    out = set()
    for _, text in templates:
        b = _plain_bigrams(text)
        need = math.ceil(min_dice / (2 - min_dice) * len(b) - 1e-9)
        out.update(sorted(b, key=lambda x: (-len(x), x))[:len(b) - need + 1])
    return sorted(out)


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, min_dice: float = MIN_DICE) -> DataFrame:
    """License notices in ``docs`` (doc_id, text): a row per document and license.

    Columns: doc_id, license, dice (of the best segment, rounded to six places), segment_words (of the shortest such
    segment), n_segments (different segments of the text that reach ``min_dice`` with a template of the license). Null
    and empty texts hold no license; rows with a null doc_id are one document; rows with equal doc_ids are one
    document as well. Other columns are not read.
    """
    templates = TEMPLATES if templates is None else templates
    spark = docs.sparkSession
    known = template_table(spark, templates)
    sizes = [len(b) for _, t in templates if (b := _plain_bigrams(t))]
    shape = "doc_id", "license", "dice", "segment_words", "n_segments"
    least, most = min_dice / (2 - min_dice), (2 - min_dice) / min_dice
    low, high = min(sizes, default=1) * least, max(sizes, default=0) * most
    telling = F.array(*[F.lit(b) for b in _telling(templates, min_dice)]).cast("array<string>")
    text = F.col("text").cast("string")
    possible = (docs.select("doc_id", text.alias("text")).where("text is not null")
                .where(F.arrays_overlap(bigrams(words(F.col("text"))), telling)))
    parts = (possible.select("doc_id", F.explode(segments(F.col("text"))).alias("segment"))
             .select("doc_id", "segment", words(F.col("segment")).alias("w"))
             .select("doc_id", "segment", F.size("w").alias("n_words"), bigrams(F.col("w")).alias("b"))
             .where(F.size("b").between(math.floor(low), math.ceil(high)))
             .where(F.arrays_overlap("b", telling)))
    # joined with the templates by a shared telling bigram, so that no pair without one is made
    keys = F.broadcast(known.select("template", "license", F.col("bigrams").alias("t"), "n",
                                    F.explode(F.array_intersect("bigrams", telling)).alias("key")))
    pairs = (parts.select("*", F.explode(F.array_intersect("b", telling)).alias("key")).join(keys, "key")
             .where(F.size("b").between(least * F.col("n") - 1e-9, most * F.col("n") + 1e-9))
             .withColumn("dice", 2.0 * F.size(F.array_intersect("b", "t")) / (F.size("b") + F.col("n")))
             .where(F.col("dice") >= min_dice))
    best = pairs.groupBy("doc_id", "license", "segment").agg(F.max("dice").alias("dice"),
                                                             F.first("n_words").alias("n_words"))
    return best.groupBy("doc_id", "license").agg(
        F.round(F.max("dice"), 6).alias("dice"),
        F.min(F.struct(-F.col("dice"), F.col("n_words")))["n_words"].alias("segment_words"),
        F.count("*").alias("n_segments")).select(*shape)


def scan_sql(templates: list[tuple[str, str]] | None = None, min_dice: float = MIN_DICE) -> str:
    """The same scan as DuckDB SQL over a view ``documents``, without the pruning."""
    templates = TEMPLATES if templates is None else templates
    rows = ", ".join("({}, '{}', '{}')".format(i, n, t.replace("'", "''")) for i, (n, t) in enumerate(templates))
    norm = r"trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
    pairs = ("list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))")
    return f"""
WITH templates(template, license, t) AS (VALUES {rows}),
tw AS (SELECT template, license, string_split({norm.format('t')}, ' ') AS w FROM templates),
tb AS (SELECT template, license, {pairs} AS tb FROM tw),
keys AS (SELECT DISTINCT unnest(tb) AS key, template, license, tb FROM tb),
lines AS (SELECT doc_id, text, string_split_regex(text, '[\\r\\n]+') AS ls FROM documents
          WHERE text IS NOT NULL),
parts AS (SELECT doc_id, unnest(list_distinct(list_transform(list_concat([text],
            string_split_regex(text, '\\r?\\n[ \\t]*\\r?\\n'), ls,
            flatten(list_transform(ls, lambda x: string_split_regex(regexp_replace(x, '([.!?;:])\\s+', '\\1' || chr(1),
            'g'), chr(1))))), lambda x: trim(x, ' ')))) AS segment FROM lines),
pw AS (SELECT doc_id, segment, string_split({norm.format('segment')}, ' ') AS w FROM parts
       WHERE {norm.format('segment')} <> ''),
pb AS (SELECT doc_id, segment, len(w) AS n_words, {pairs} AS b FROM pw),
cand AS (SELECT DISTINCT p.doc_id, p.segment, p.n_words, p.b, k.template, k.license, k.tb
         FROM (SELECT *, unnest(b) AS key FROM pb) p JOIN keys k USING (key)),
scored AS (SELECT *, 2.0::DOUBLE * len(list_intersect(b, tb)) / (len(b) + len(tb)) AS dice FROM cand),
best AS (SELECT doc_id, license, segment, max(dice) AS dice, max(n_words) AS n_words FROM scored
         WHERE dice >= {min_dice} GROUP BY ALL)
SELECT doc_id, license, round(max(dice), 6) AS dice, arg_min(n_words, (-dice, n_words))::INTEGER AS segment_words,
       count(*) AS n_segments
FROM best GROUP BY doc_id, license"""
