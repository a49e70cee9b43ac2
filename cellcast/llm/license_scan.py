"""License scans as an exact set-similarity join of text blocks with license templates.

Blocks are windows of words that start every half window, so any passage of up to half a window lies whole in one of them. Half
a window is ``STRIDE`` words, and for longer templates the next power of two that holds them. A block matches a template when it
holds at least the template's share of its distinct words, and all of its telling words: those that tell a license from its
siblings. The join is exact: template words are ordered by how many
documents hold them, rarest first; a match must share a word of the template's prefix (prefix
filter), have enough template words (length filter), and leave enough words after the first
shared one on both sides (positional filter); survivors are counted in full.

Fixed phrases are templates of which every word is needed; blocks that pass are then searched for
the places where the words stand in a row.

The index has one row per prefix word of a template: its size is set by the template list, not by the
data, and so is the vocabulary whose counts reach the driver. One shuffle brings at most one
pre-aggregated row per document and task.

Defined results: null or empty text has no words and no labels; each row is answered by itself, so repeated
rows and equal ids give a row each; an empty table gives no rows; columns other than id and text are not
read, so clashing names do no harm.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a text after A-Z are lower-cased: runs of digits, letters and anything beyond ASCII.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
STRIDE = 32
#: Shares of distinct words that a notice and a whole license text must hold.
THRESHOLD, WHOLE = 0.8, 0.7

#: Fixed phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Wording of public licenses.
MIT_TEXT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or
substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT
NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING
FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD_TEXT = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT
HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF
SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE,
EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ISC_TEXT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE
AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT
SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF
USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE
USE OR PERFORMANCE OF THIS SOFTWARE."""

#: License notices and texts: wording, label, telling words, share of distinct words.
TEMPLATES = (
    ("licensed under the apache license version 2 0", "apache-2.0", "apache license", THRESHOLD),
    ("you may not use this file except in compliance with the license", "apache-2.0", "file except compliance license", THRESHOLD),
    ("released under the mit license", "mit", "mit license", THRESHOLD),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit", "permission granted charge copy", THRESHOLD),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd", "redistribution binary forms permitted", THRESHOLD),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0", "gnu general public license 3", THRESHOLD),
    ("you can redistribute it and or modify it under the terms of the gnu general public license", "gpl", "gnu general public license", THRESHOLD),
    ("under the terms of the gnu lesser general public license", "lgpl", "gnu lesser license", THRESHOLD),
    ("under the terms of the gnu affero general public license", "agpl", "gnu affero license", THRESHOLD),
    ("subject to the terms of the mozilla public license", "mpl-2.0", "mozilla public license", THRESHOLD),
    ("this work is licensed under a creative commons attribution license", "cc-by", "creative commons attribution", THRESHOLD),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0", "cc by nc 4", THRESHOLD),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0", "cc by sa 4", THRESHOLD),
    ("dedicated to the public domain under cc0 1 0 universal", "cc0-1.0", "cc0 public domain", THRESHOLD),
    ("this is free and unencumbered software released into the public domain", "unlicense", "unencumbered public domain", THRESHOLD),
    ("permission to use copy modify and or distribute this software for any purpose", "isc", "permission distribute software purpose", THRESHOLD),
    ("eclipse public license version 2 0", "epl-2.0", "eclipse public license", THRESHOLD),
    ("no part of this publication may be reproduced without prior written permission", "proprietary", "publication reproduced permission", THRESHOLD),
    (MIT_TEXT, "mit", "sublicense noninfringement merchantability", WHOLE),
    (BSD_TEXT, "bsd", "redistributions disclaimer merchantability", WHOLE),
    (ISC_TEXT, "isc", "disclaims merchantability whatsoever", WHOLE),
)


def words_of(text: str) -> Column:
    """Words of a text column. The Kelvin sign is the one character that lower() would turn into a-z."""
    body = F.lower(F.replace(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit("K"), F.lit("ķ")))
    return F.filter(F.split(body, SEPARATORS), lambda w: w != "")


def _tokens(phrase: str) -> list[str]:
    return [w for w in re.split(SEPARATORS, phrase.lower()) if w]


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def stride_of(words: int) -> int:
    """Half a window: ``STRIDE``, or the next power of two that holds the words."""
    return max(STRIDE, 1 << max(0, words - 1).bit_length())


def build_index(templates, phrases, order: dict[str, int]) -> list[tuple]:
    """Rows (token, stride, place, size, needed, tokens, telling, phrase, label) for every prefix word."""
    rank = lambda w: (order.get(w, 0), w)
    rows = []
    for words, label, telling, share, exact in [(*t, False) for t in templates] + [(p, lab, "", 1.0, True) for p, lab in phrases.items()]:
        sequence = _tokens(words)
        if not sequence:
            continue
        tokens = sorted(set(sequence), key=rank)
        needed = math.ceil(share * len(tokens) - 1e-9)
        for place, token in enumerate(tokens[: len(tokens) - needed + 1]):
            rows.append((
                token, stride_of(len(sequence)), place, len(tokens), needed, tokens, sorted(set(_tokens(telling))),
                sequence if exact else None, label,
            ))
    return rows


INDEX = (
    "token string, stride int, place int, size int, needed int, tokens array<string>, telling array<string>, phrase array<string>, "
    "label string"
)


def scan(
    df: DataFrame, doc: str = "doc_id", text: str = "text", templates=TEMPLATES, phrases: dict[str, str] = PHRASES,
) -> DataFrame:
    """One row per row of ``df``: id, n_words, places of phrases, their labels, all labels, best containment.

    Templates are (wording, label, telling words, share) of any length; telling words must be words of the wording.
    """
    spark = df.sparkSession
    source = df.select(F.col(doc).alias("doc_id"), words_of(text).alias("words"))
    vocabulary = sorted({w for t, *_ in templates for w in _tokens(t)} | {w for p in phrases for w in _tokens(p)})

    # Documents per template word. array_intersect leaves each word once per document.
    present = source.select(F.explode(F.array_intersect(_strings(vocabulary), F.col("words"))).alias("token"))
    order = {r["token"]: r["count"] for r in present.groupBy("token").count().collect()}
    ordered = sorted(vocabulary, key=lambda w: (order.get(w, 0), w))
    rows = build_index(templates, phrases, order)
    prefixes = {k: _strings(sorted({r[0] for r in rows if r[1] == k})) for k in sorted({r[1] for r in rows})}
    entries = [F.struct(*[F.lit(list(v) if isinstance(v, list) else v) for v in r]) for r in rows]
    kind = "array<struct<" + ",".join(c.strip().replace(" ", ":", 1) for c in INDEX.split(",")) + ">>"
    index = spark.range(1).select(F.inline(F.array(*entries).cast(kind)))

    n = F.size("words")

    def blocks(stride: int, prefix: Column) -> Column:
        """Blocks of one width that hold a prefix word of a template of that width."""
        every = F.transform(
            F.sequence(F.lit(0), F.floor((n - 1) / stride).cast("int")),
            lambda b: F.struct(
                F.lit(stride).alias("stride"), b.alias("block"), F.slice("words", b * stride + 1, F.lit(2 * stride)).alias("held")
            ),
        )
        none = F.array().cast("array<struct<stride:int,block:int,held:array<string>>>")
        return F.when(F.arrays_overlap("words", prefix), F.filter(every, lambda b: F.arrays_overlap(b["held"], prefix))).otherwise(none)

    candidates = F.concat(*[blocks(k, p) for k, p in prefixes.items()])
    # The row number is set before blocks are taken apart; in one step it would number blocks.
    numbered = source.withColumn("row", F.monotonically_increasing_id())
    rows_of = numbered.select(
        "row", "doc_id", n.cast("long").alias("n_words"),
        F.explode_outer(candidates).alias("b"),
    )
    # array_intersect keeps the order of its first argument: the global order of words.
    held = rows_of.withColumn("known", F.array_intersect(_strings(ordered), F.col("b.held")))
    hits = F.filter(
        F.transform("known", lambda t, j: F.struct(t.alias("token"), j.alias("at"))),
        lambda x: F.array_contains(_strings(sorted({r[0] for r in rows})), x["token"]),
    )
    probes = held.withColumn("hit", F.explode_outer(hits)).withColumn("probe", F.col("hit.token"))
    room = F.least(F.col("size") - F.col("place"), F.size("known") - F.col("hit.at"))
    joined = probes.join(
        F.broadcast(index),  # as many rows as the template list has prefix words
        (F.col("probe") == F.col("token")) & (F.col("b.stride") == F.col("stride"))
        & (F.size("known") >= F.col("needed")) & (room >= F.col("needed")), "left",
    )
    # No block that lacks a telling word counts.
    told = F.size(F.array_except("telling", "known")) == 0
    overlap = F.when(told, F.size(F.array_intersect("known", "tokens"))).otherwise(F.lit(0))
    length = F.size("phrase")
    block_words = F.col("b.held")
    owned = F.filter(
        F.sequence(F.lit(0), F.least(F.lit(STRIDE), F.size(block_words)) - 1),
        lambda i: F.slice(block_words, i + 1, length) == F.col("phrase"),
    )
    starts = F.when(
        F.col("phrase").isNotNull() & (overlap >= F.col("needed")),
        F.transform(owned, lambda i: i + F.col("b.block") * STRIDE),
    )
    checked = joined.select(
        "row", "doc_id", "n_words", "label", starts.alias("starts"), F.col("phrase").isNotNull().alias("exact"),
        F.when(overlap >= F.col("needed"), overlap / F.col("size")).alias("share"),
    )
    based = F.when(F.col("exact") & (F.size("starts") > 0), F.col("label"))
    alike = F.when(~F.col("exact"), F.when(F.col("share").isNotNull(), F.col("label")))
    best = F.when(~F.col("exact"), F.col("share")).when(F.size("starts") > 0, F.lit(1.0))
    found = checked.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
        F.coalesce(F.sum(F.when(F.col("exact"), F.size("starts"))), F.lit(0)).alias("n_base"),
        F.min(F.array_min("starts")).cast("long").alias("first_word"),
        F.max(F.array_max("starts")).cast("long").alias("last_word"),
        F.collect_set(based).alias("base"), F.collect_set(alike).alias("like"),
        F.coalesce(F.max(best), F.lit(0.0)).alias("score"),
    )
    joined_labels = lambda a: F.array_join(F.array_sort(a), ",")
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", joined_labels(F.col("base")).alias("base_labels"),
        joined_labels(F.array_union("base", "like")).alias("labels"), "score",
    )


def oracle_sql(templates=TEMPLATES, phrases: dict[str, str] = PHRASES) -> str:
    """The same by counting every template in every block, as DuckDB SQL."""
    quoted = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    notices = ", ".join(
        f"({i}, '{lab}', {quoted(sorted(set(_tokens(t))))}, {quoted(sorted(set(_tokens(telling))))}, {share}::DOUBLE, {stride_of(len(_tokens(t)))})"
        for i, (t, lab, telling, share) in enumerate(templates)
    )
    exact = ", ".join(f"('{lab}', {quoted(_tokens(p))})" for p, lab in phrases.items())
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
    WITH t AS (SELECT row_number() OVER () AS r, doc_id,
        list_filter(regexp_split_to_array({lower}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
    notice(id, label, words, telling, part, stride) AS (VALUES {notices}), phrase(label, words) AS (VALUES {exact}),
    place AS (SELECT r, label, i FROM (SELECT r, w, unnest(range(len(w))) AS i FROM t), phrase
        WHERE list_slice(w, i + 1, i + len(words)) = words),
    base AS (SELECT r, count(*) AS n, min(i) AS a, max(i) AS z, list(DISTINCT label) AS labels FROM place GROUP BY r),
    vocab AS (SELECT DISTINCT unnest(words) AS word FROM notice),
    width AS (SELECT DISTINCT stride FROM notice),
    token AS (SELECT DISTINCT r, stride, b, word FROM (SELECT r, stride, unnest([i // stride, i // stride - 1]) AS b, word
        FROM (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS i FROM t) SEMI JOIN vocab USING (word), width) WHERE b >= 0),
    term AS (SELECT id, label, stride, part, len(words) AS size, len(telling) AS n_telling, telling, unnest(words) AS word FROM notice),
    hit AS (SELECT r, label, count(*) / max(size) AS share FROM token JOIN term USING (word, stride) GROUP BY r, b, id, label
        HAVING count(*) >= ceil(max(part) * max(size) - 1e-9) AND count(*) FILTER (list_contains(telling, word)) = max(n_telling)),
    alike AS (SELECT r, list(DISTINCT label) AS labels, max(share) AS share FROM hit GROUP BY r)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base,
        CAST(a AS BIGINT) AS first_word, CAST(z AS BIGINT) AS last_word,
        coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
        coalesce(array_to_string(list_sort(list_distinct(list_concat(base.labels, alike.labels))), ','), '') AS labels,
        greatest(CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END, coalesce(share, 0)) AS score
    FROM t LEFT JOIN base USING (r) LEFT JOIN alike USING (r)"""
