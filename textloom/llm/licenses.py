"""License scans: phrase places, and an exact set-similarity join of text blocks with notice templates.

Text: A-Z lower-cased; words are runs of characters other than ASCII marks, blanks and controls. A block is a line, or
a sentence of it, or a window of the text's words wherever its lines and sentences end, as notices are wrapped: a window
is as long as its template, with a word more for each that may be missing. A block matches a template where it contains
at least THRESHOLD of the template's distinct words. Of a window, only the words of its own template go on.
A null, empty or wordless text has zero words, no label and score 0. Repeated rows are each judged. Columns other than
doc_id and text are not read. An empty table gives no rows.

Texts are read once and not shuffled: per row only counts, phrase places and the blocks' words that occur in templates
go on. The join orders words by global frequency, rare first. A block can match only if it has one of a template's
first size - least + 1 words (prefix filter), enough template words at all (length filter) and enough words left from
the place of the shared word on in both orders (positional filter); what passes is verified. Templates are an argument
that the driver holds, with a collection of usual notices as default, so their index is broadcast whatever the corpus.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.common import lower_ascii
from textloom.session import written

WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
SENTENCE_END = "([.!?])[ \\t]+"
#: Of the usual 0.8, a fifth of a five-word notice may be what tells it from another licence's; hence 0.9.
THRESHOLD = 0.9
#: Phrases whose places count, with their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notices in words, with their labels. The opening or the core sentence of each licence's usual notice.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license"),
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "gnu lesser general public license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
]


def least(size: int) -> int:
    """Template words that a block must have."""
    return -(-int(round(THRESHOLD * size * 1000)) // 1000)


def _strings(values: list[str]) -> Column:
    return F.array(*(F.lit(v) for v in values))


def vocabulary(templates: list[tuple[str, str]] = TEMPLATES) -> list[str]:
    return sorted({w for _, t in templates for w in t.split()})


def _places(phrase: str) -> Column:
    """Word numbers where the phrase starts; the words are looked at one by one only in texts that have its last word."""
    parts = phrase.split()
    here = lambda i: reduce(lambda a, b: a & b, (F.get("__w", i + k).eqNullSafe(F.lit(p)) for k, p in enumerate(parts)))
    found = F.filter(F.sequence(F.lit(0), F.greatest(F.size("__w") - 1, F.lit(0))), here)
    return F.when(F.array_contains("__w", parts[-1]) & F.array_contains("__w", parts[0]), found).otherwise(F.array().cast("array<int>"))


def _window(template: str) -> Column:
    """The words of the template in the text's window that has most of them; null where no window has enough.

    A window that has enough has them from its first template word on, so windows start at template words only."""
    words = template.split()
    own = _strings(sorted(set(words)))
    enough = least(len(set(words)))
    length = len(words) + len(set(words)) - enough
    starts = F.filter(F.transform("__w", lambda w, i: F.when(F.array_contains(own, w), i)), lambda i: i.isNotNull())
    found = F.transform(starts, lambda i: F.array_intersect(F.slice("__w", i + 1, length), own))
    best = F.array_max(F.transform(F.filter(found, lambda x: F.size(x) >= enough), lambda x: F.struct(F.size(x).alias("n"), x.alias("x"))))
    return F.when(F.size(F.array_intersect("__k", own)) >= enough, best["x"])


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(doc_id, n_words, places per phrase, blocks): blocks are the template words of each block that has enough."""
    text = lower_ascii(F.coalesce(F.col("text"), F.lit("")))
    fewest = min(least(len(set(t.split()))) for _, t in templates)
    words = lambda t: F.regexp_extract_all(t, F.lit(WORD), F.lit(0))
    a = docs.select("doc_id", text.alias("__t")).select("doc_id", "__t", words(F.col("__t")).alias("__w"))
    lines = F.split(F.regexp_replace("__t", SENTENCE_END, "$1\n"), "\n")
    known = _strings(vocabulary(templates))
    blocks = F.filter(F.transform(lines, lambda x: F.array_intersect(words(x), known)), lambda x: F.size(x) >= fewest)
    # A text without enough template words as a whole has no such block, so its lines are not split; nor are windows of a
    # template looked for where the whole text has not enough of its words.
    a = a.withColumn("__k", F.array_intersect("__w", known))
    some = F.size("__k") >= fewest
    blocks = F.concat(blocks, F.array_compact(F.array(*(_window(t) for _, t in templates))))
    places = [_places(p).alias(f"__p{i}") for i, p in enumerate(PHRASES)]
    return a.select("doc_id", F.size("__w").cast("bigint").alias("n_words"), *places, F.when(some, blocks).otherwise(F.array().cast("array<array<string>>")).alias("blocks"))


def _templates(spark: SparkSession, templates: list[tuple[str, str]]) -> DataFrame:
    rows = [(i, label, w, len(set(t.split()))) for i, (label, t) in enumerate(templates) for w in sorted(set(t.split()))]
    values = [F.struct(F.lit(i).alias("template"), F.lit(label).alias("label"), F.lit(w).alias("word"), F.lit(n).alias("size"), F.lit(least(n)).alias("least")) for i, label, w, n in rows]
    return spark.range(1).select(F.inline(F.array(*values)))


def containment_join(blocks: DataFrame, notices: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(rid, label, containment) of every (row, template) with a matching block; blocks: (rid, words)."""
    templates = _templates(blocks.sparkSession, notices)
    counts = blocks.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    counted = templates.join(F.broadcast(counts), "word", "left").withColumn("df", F.coalesce("df", F.lit(0)))  # template words only
    order = counted.select("df", "word").distinct().agg(F.sort_array(F.collect_list(F.struct("df", "word"))).alias("o"))
    order = order.select(F.transform("o", lambda x: x["word"]).alias("order"))
    rank = Window.partitionBy("template").orderBy("df", "word")
    ranked = counted.withColumn("pos", F.row_number().over(rank) - 1)
    prefix = ranked.where("pos < size - least + 1").select("template", "label", "size", "least", "word", "pos")
    whole = templates.groupBy("template").agg(F.collect_list("word").alias("template_words"))
    sorted_ = blocks.join(F.broadcast(order)).select("rid", F.array_intersect("order", "words").alias("words"))
    probes = sorted_.select("rid", "words", F.posexplode("words").alias("at", "word"))
    met = probes.join(F.broadcast(prefix), "word")
    n = F.size("words")
    met = met.where((n >= F.col("least")) & (F.least("pos", "at") + 1 + F.least(F.col("size") - F.col("pos") - 1, n - F.col("at") - 1) >= F.col("least")))
    shared = met.join(F.broadcast(whole), "template").withColumn("n_shared", F.size(F.array_intersect("words", "template_words")))
    return shared.where("n_shared >= least").select("rid", "label", (F.col("n_shared").cast("double") / F.col("size")).alias("containment"))


def license_scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    templates: (label, notice as lower-case words with a space between), one at least."""
    rows = written(scan(docs, templates).withColumn("rid", F.monotonically_increasing_id()), "licenses")
    found = containment_join(rows.select("rid", F.explode("blocks").alias("words")), templates)
    found = found.groupBy("rid").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    places = F.concat(*(f"__p{i}" for i in range(len(PHRASES))))
    base = F.array_compact(F.array(*(F.when(F.size(f"__p{i}") > 0, F.lit(label)) for i, label in enumerate(PHRASES.values()))))
    light = rows.select(
        "rid", "doc_id", "n_words", F.size(places).cast("bigint").alias("n_base"), F.array_min(places).cast("bigint").alias("first_word"),
        F.array_max(places).cast("bigint").alias("last_word"), F.sort_array(base).alias("base"),
    )
    none = F.array().cast("array<string>")
    both = light.join(found, "rid", "left").withColumn("all", F.sort_array(F.array_union("base", F.coalesce("more", none))))
    return both.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join("all", ",").alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def oracle() -> str:
    """DuckDB SQL of license_scan() over documents, by comparing every line, sentence and window with every template."""
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    word = WORD
    spots = []
    for phrase in PHRASES:
        parts = phrase.split()
        same = " AND ".join(f"w[i + {k + 1}] IS NOT DISTINCT FROM '{p}'" for k, p in enumerate(parts))
        spots.append(f"list_filter(range(0, len(w)), lambda i: {same})")
    names = [f"p{i}" for i in range(len(PHRASES))]
    base = "list_filter([" + ", ".join(f"CASE WHEN len({n}) > 0 THEN '{label}' END" for n, label in zip(names, PHRASES.values(), strict=True)) + "], lambda x: x IS NOT NULL)"
    size = lambda t: len(t.split()) + len(set(t.split())) - least(len(set(t.split())))
    values = ", ".join(f"({i}, '{label}', {sorted(set(t.split()))!r}, {least(len(set(t.split())))}, {size(t)})" for i, (label, t) in enumerate(TEMPLATES))
    return f"""
        WITH a AS (SELECT doc_id, {low} AS t FROM documents),
        b AS (SELECT doc_id, regexp_extract_all(t, '{word}') AS w, string_split(regexp_replace(t, '{SENTENCE_END}', '\\1' || chr(10), 'g'), chr(10)) AS l FROM a),
        c AS (SELECT doc_id, len(w) AS n_words, {", ".join(f"{s} AS {n}" for s, n in zip(spots, names, strict=True))} FROM b),
        t(number, label, ws, least, size) AS (VALUES {values}),
        near AS MATERIALIZED (SELECT doc_id, number, w, ws, least, size FROM b, t WHERE len(list_intersect(w, ws)) >= least),
        windows AS (SELECT doc_id, number, least, list_intersect(w[i:i + size - 1], ws) AS s FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM near)),
        best AS (SELECT doc_id, arg_max(s, len(s)) AS s FROM windows WHERE len(s) >= least GROUP BY doc_id, number),
        e AS (SELECT doc_id, regexp_extract_all(unnest(l), '{word}') AS s FROM b UNION ALL SELECT doc_id, s FROM best),
        f AS (SELECT doc_id, label, len(list_intersect(s, ws)) AS k, len(ws) AS n, least FROM e, t),
        g AS (SELECT doc_id, list(DISTINCT label) AS more, max(CAST(k AS DOUBLE) / n) AS best FROM f WHERE k >= least GROUP BY doc_id),
        h AS (SELECT *, list_concat({", ".join(names)}) AS p, {base} AS base FROM c LEFT JOIN g USING (doc_id))
        SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(p) AS BIGINT) AS n_base, CAST(list_min(p) AS BIGINT) AS first_word,
            CAST(list_max(p) AS BIGINT) AS last_word, array_to_string(list_sort(base), ',') AS base_labels,
            array_to_string(list_sort(list_distinct(list_concat(base, coalesce(more, [])))), ',') AS labels,
            CASE WHEN len(base) > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0::DOUBLE) END AS score
        FROM h"""
