"""Licence scans, DataFrame functions only: a positional index of licence texts, asked for each file's rarest licence words.

Words are numbered over the whole text. Base labels are phrases whose words stand consecutively. The method adds labels of
``TEMPLATES``, stretches of well-known licence texts without variable parts, each with mandatory key phrases:

1. The inverse document frequency of every template word is counted over all documents (at most as many numbers as there are
   template words reach the driver and become literals).
2. Per template, the ``ANCHORS`` rarest of its words that a file holds are looked up: every place of an anchor in the
   file, less each place of it in the template (its postings), is a possible start of the template. Starts that all
   anchors share remain (an intersection of arrays; no pairs of places are made).
3. At a remaining start all key phrases must stand word for word at their places. The share of the template's IDF found at its
   places must reach ``LEAST_SHARE``.

The score is 1 with a base label, else the largest share found (0 without any). Work per file is linear in its words.

Defined results: null and empty texts have no words, no labels and score 0; repeated rows are scanned alike; extra columns are
ignored; with an empty table the result is empty.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
ANCHORS, LEAST_SHARE = 3, 0.6

# Phrases of the contract.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Fixed values: (label, stretch of a licence text, mandatory key phrases).
TEMPLATES = [
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", ["gnu affero general public license"]),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
     ["apache license version 2 0", "in compliance with the license"]),
    ("apache-2.0", "licensed under the apache license version 2", ["apache license version 2"]),
    ("artistic", "you may copy and distribute verbatim copies of the source form of the standard version of this package", ["verbatim copies of the source form"]),
    ("boost", "boost software license version 1 0 permission is hereby granted free of charge to any person or organization obtaining a copy of the software",
     ["boost software license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
     ["redistribution and use in source and binary forms", "following conditions are met"]),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0 international"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", ["creative commons attribution noncommercial"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", ["creative commons attribution sharealike"]),
    ("cc0", "has waived all copyright and related or neighboring rights to this work", ["waived all copyright"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free "
     "software foundation", ["you can redistribute it and or modify it", "gnu general public license"]),
    ("gpl-3", "licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
     ["permission to use copy modify and or distribute", "with or without fee is hereby granted"]),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ["gnu lesser general public license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in "
     "the software without restriction", ["permission is hereby granted free of charge", "deal in the software without restriction"]),
    ("mit", "released under the mit license", ["the mit license"]),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
]
VOCABULARY = sorted({w for _, text, _ in TEMPLATES for w in text.split()})


def flat(text: Column) -> Column:
    """The words of a text, one space before, between and behind them; one space if there is none."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.regexp_replace(F.concat(F.lit(" "), lowered, F.lit(" ")), NOT_WORD, " ")


def spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def words_of(line: Column) -> Column:
    return F.split(F.trim(line), " ")


def phrase_places(line: Column, phrase: str, n_words: Column) -> Column:
    """(n, first, last) of a phrase's places, null without one. Phrases cannot overlap themselves."""
    pieces = F.split(line, f"(?<= ){phrase}(?= )", -1)
    found = F.struct(
        (F.size(pieces) - 1).cast("long").alias("n"), (spaces(F.get(pieces, F.lit(0))) - 1).cast("long").alias("first"),
        (n_words - len(phrase.split()) - spaces(F.element_at(pieces, -1)) + 1).cast("long").alias("last"),
    )
    return F.when(F.contains(line, F.lit(f" {phrase} ")), found)


def frequencies(lines: DataFrame) -> tuple[int, dict[str, int]]:
    """Number of documents, and in how many of them each template word stands."""
    held = F.array_intersect(F.array(*map(F.lit, VOCABULARY)), words_of(F.col("line")))
    counts = lines.select(F.explode(F.concat(F.array(F.lit("")), held)).alias("word")).groupBy("word").count().collect()
    counted = {r.word: r["count"] for r in counts}
    return counted.pop("", 0), counted


def weights(n: int, counted: dict[str, int]) -> dict[str, float]:
    return {w: round(math.log((1 + n) / (1 + counted.get(w, 0))) + 1, 6) for w in VOCABULARY}


def template_share(words: Column, present: Column, text: str, keys: list[str], idf: dict[str, float]) -> Column:
    """Largest IDF share of a template at a start where its anchors agree and its key phrases stand; 0 without one."""
    own = text.split()
    rare = F.slice(F.array_intersect(F.array(*[F.lit(w) for w in sorted(set(own), key=lambda w: (-idf[w], w))]), present), 1, ANCHORS)
    postings = {w: F.array(*[F.lit(j) for j, v in enumerate(own) if v == w]) for w in dict.fromkeys(own)}
    index = F.create_map(*[x for w, places in postings.items() for x in (F.lit(w), places)])

    def starts(anchor: Column) -> Column:
        at = F.filter(F.transform(words, lambda w, i: F.when(w == anchor, i)), lambda i: i.isNotNull())
        return F.flatten(F.transform(F.element_at(index, anchor), lambda j: F.transform(at, lambda i: i - j)))

    agreed = starts(F.get(rare, F.lit(0)))
    for k in range(1, ANCHORS):
        agreed = F.array_intersect(agreed, starts(F.get(rare, F.lit(k))))

    def stands(start: Column, key: str) -> Column:
        at = start + next(j for j in range(len(own)) if own[j:j + len(key.split())] == key.split())
        return (at >= 0) & (F.array_join(F.slice(words, F.greatest(at, F.lit(0)) + 1, len(key.split())), " ") == key)

    def verified(start: Column) -> Column:
        out = stands(start, keys[0])
        for key in keys[1:]:
            out = out & stands(start, key)
        return out

    table = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(w).alias("w"), F.lit(idf[w]).alias("idf")) for j, w in enumerate(own)])

    def share(start: Column) -> Column:
        hit = lambda t: F.when((start + t["j"] >= 0) & (F.get(words, F.greatest(start + t["j"], F.lit(0))) == t["w"]), t["idf"]).otherwise(0.0)
        return F.aggregate(table, F.lit(0.0), lambda acc, t: acc + hit(t)) / F.lit(sum(idf[w] for w in own))

    best = F.array_max(F.transform(F.filter(agreed, verified), share))
    # A file without some word of the key phrases need not be asked for starts.
    lacking = F.array_except(F.array(*map(F.lit, sorted({w for key in keys for w in key.split()}))), present)
    return F.when((F.size(lacking) == 0) & (F.size(rare) == ANCHORS), F.coalesce(best, F.lit(0.0))).otherwise(0.0)


def scanned(docs: DataFrame, *keep: str) -> DataFrame:
    """The kept columns, n_words, base places and labels, and the share of each template."""
    lines = docs.select(*keep, flat(F.col("text")).alias("line"))
    n, counted = frequencies(lines)
    idf = weights(n, counted)
    line, empty = F.col("line"), F.array().cast("array<string>")
    rows = lines.withColumn("n_words", spaces(line).cast("long") - 1)
    base = {p: phrase_places(line, p, F.col("n_words")) for p in PHRASES}
    rows = rows.withColumns({f"_p{i}": c for i, c in enumerate(base.values())})
    places = [F.col(f"_p{i}") for i in range(len(base))]
    # A template needs its first key phrase, so a text without the rarest word of any first phrase is passed by.
    telling = [min(keys[0].split(), key=lambda w: (-idf[w], w)) for _, _, keys in TEMPLATES]
    asked = line.rlike(f" (?:{'|'.join(sorted(set(telling)))}) ")
    rows = rows.withColumn("_words", F.when(asked, words_of(line)).otherwise(empty))
    rows = rows.withColumn("_present", F.array_intersect(F.array(*map(F.lit, VOCABULARY)), F.col("_words")))
    shares = [template_share(F.col("_words"), F.col("_present"), text, keys, idf) for _, text, keys in TEMPLATES]
    rows = rows.withColumn("_shares", F.when(F.size("_present") >= ANCHORS, F.array(*shares)).otherwise(F.array().cast("array<double>")))
    of_base = F.filter(F.array(*[F.when(p.isNotNull(), F.lit(label)) for p, label in zip(places, PHRASES.values(), strict=True)]), lambda x: x.isNotNull())
    names = F.array(*[F.lit(label) for label, _, _ in TEMPLATES])
    added = F.filter(F.transform("_shares", lambda s, i: F.when(s >= LEAST_SHARE, F.get(names, i))), lambda x: x.isNotNull())
    numbers = lambda field, start: F.array(*[F.coalesce(p[field], F.lit(start)) for p in places])
    return rows.select(
        *keep, "n_words",
        F.aggregate(numbers("n", 0), F.lit(0).cast("long"), lambda a, x: a + x).alias("n_base"),
        F.least(*[p["first"] for p in places]).alias("first_word"), F.greatest(*[p["last"] for p in places]).alias("last_word"),
        F.array_sort(F.array_distinct(of_base)).alias("base"), F.array_sort(F.array_distinct(F.concat(of_base, added))).alias("found"),
        F.coalesce(F.array_max("_shares"), F.lit(0.0)).alias("share"),
    )


def op12_license_scan(docs: DataFrame) -> DataFrame:
    """Contract columns for every document."""
    found = scanned(docs, "doc_id")
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.round("share", 6))
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"), "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"), F.array_join("found", ",").alias("labels"), score.alias("score"),
    )


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql() -> str:
    words = ", ".join(f"({t}, {_quoted(label)}, {j}, {_quoted(w)})" for t, (label, text, _) in enumerate(TEMPLATES) for j, w in enumerate(text.split()))
    keys = []
    for t, (_, text, phrases) in enumerate(TEMPLATES):
        own = text.split()
        for phrase in phrases:
            start = next(j for j in range(len(own)) if own[j:j + len(phrase.split())] == phrase.split())
            keys += [f"({t}, {start + k}, {_quoted(w)})" for k, w in enumerate(phrase.split())]
    phrases = ", ".join(f"({_quoted(label)}, {_quoted(p)}, {len(p.split())})" for p, label in PHRASES.items())
    # A document's phrase places: words that follow each other, joined by spaces.
    return rf"""
WITH template(t, label, j, word) AS (VALUES {words}
), needed(t, j, word) AS (VALUES {", ".join(keys)}
), phrase(label, words, n) AS (VALUES {phrases}
), docs AS (
  SELECT row_number() OVER () AS id, doc_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words
  FROM documents
), place AS (SELECT id, unnest(words) AS word, unnest(range(len(words))) AS i FROM docs
), base AS (
  SELECT id, label, i FROM phrase JOIN place ON place.word = split_part(phrase.words, ' ', 1) JOIN docs USING (id)
  WHERE array_to_string(docs.words[i + 1:i + n], ' ') = phrase.words
), based AS (SELECT id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS labels FROM base GROUP BY id
), idf AS (
  SELECT v.word, round(ln((1 + (SELECT count(*) FROM docs)) / (1 + count(DISTINCT id))) + 1, 6) AS idf
  FROM (SELECT DISTINCT word FROM template) v LEFT JOIN place USING (word) GROUP BY v.word
), rare AS (
  SELECT id, t, word FROM (SELECT DISTINCT id, t, word FROM place JOIN template USING (word)) JOIN idf USING (word)
  QUALIFY row_number() OVER (PARTITION BY id, t ORDER BY idf DESC, word) <= {ANCHORS}
), start AS (
  SELECT id, t, i - j AS start FROM rare JOIN place USING (id, word) JOIN template USING (t, word)
  GROUP BY id, t, i - j HAVING count(DISTINCT word) = {ANCHORS}
), verified AS (
  SELECT id, t, start FROM start JOIN (SELECT *, count(*) OVER (PARTITION BY t) AS held FROM needed) USING (t) JOIN place USING (id, word) WHERE i = start + j
  GROUP BY id, t, start HAVING count(*) = any_value(held)
), share AS (
  SELECT id, t, start, sum(idf) / (SELECT sum(idf) FROM template x JOIN idf USING (word) WHERE x.t = v.t) AS share
  FROM verified v JOIN template USING (t) JOIN place USING (id, word) JOIN idf USING (word) WHERE i = start + j GROUP BY id, v.t, start
), best AS (
  SELECT id, max(share) AS share, list(DISTINCT label) FILTER (WHERE share >= {LEAST_SHARE}) AS labels
  FROM share JOIN (SELECT DISTINCT t, label FROM template) USING (t) GROUP BY id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       array_to_string(list_sort(coalesce(based.labels, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(based.labels, []), coalesce(best.labels, [])))), ',') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE round(coalesce(share, 0), 6)::DOUBLE END AS score
FROM docs LEFT JOIN based USING (id) LEFT JOIN best USING (id)
"""


SQL = _sql()
