"""License scans by a positional rare-token index, in DataFrame functions only.

A template is a notice, its label and the key phrase that it can't do without. The index holds the words of all key phrases,
how many documents have each, and where each stands in which notices. A text is looked up by the words of the index that it
holds: templates of which it lacks a key word are out, and of the others the words of highest inverse document frequency are
followed to their places. Every place gives, by the posting, the position at which the notice would start; starts on which the
two rarest words of a template agree are candidates. A candidate is verified by its key phrase, word for word, so that no mention
is lost or made up; its score is the share of the whole notice that stands there, so that a notice that was shortened or altered
outside its key phrase scores less and is found all the same.

Everything about one text happens in its row: no text is shuffled, and only the document frequencies of the few indexed
words, a bounded table, are gathered beforehand from all documents. Null and empty texts have no words. Words are compared
after lower-casing A-Z only. Rows without a doc_id, repeated rows and extra columns change nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """``notice``: its words; ``key``: the phrase in it that is mandatory; ``base``: counted by place."""

    label: str
    notice: str
    key: str
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.notice.split()

    @property
    def key_at(self) -> int:
        return next(i for i in range(len(self.words)) if self.words[i : i + len(self.key.split())] == self.key.split())


# Words of the notices of common licences, as they are published.
_MIT = (
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the "
    "software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software "
    "and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice "
    "shall be included in all copies or substantial portions of the software"
)
_BSD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other "
    "materials provided with the distribution"
)
_APACHE = (
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
    "http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an "
    "as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and "
    "limitations under the license"
)
_GPL = (
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software "
    "foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any "
    "warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"
)
_MPL = "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"
_ISC = (
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and "
    "this permission notice appear in all copies"
)
_UNLICENSE = (
    "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either "
    "in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"
)
_ZLIB = (
    "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this "
    "software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"
)
_BOOST = (
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license "
    "the software to use reproduce display distribute execute and transmit the software"
)
TEMPLATES = (
    Template("mit", "released under the mit license", "under the mit license", True),
    Template("apache-2", _APACHE, "apache license version 2", True),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc", True),
    Template("mit", _MIT, "free of charge to any person obtaining a copy of this software"),
    Template("gpl", "this work is licensed under the gnu general public license", "gnu general public license"),
    Template("gpl", _GPL, "redistribute it and or modify it under the terms of the gnu general public license"),
    Template("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    Template("agpl", "licensed under the gnu affero general public license", "gnu affero general public license"),
    Template("bsd", _BSD, "redistribution and use in source and binary forms"),
    Template("bsd", "released under the bsd license", "bsd license"),
    Template("mpl-2", _MPL, "mozilla public license"),
    Template("epl-2", "made available under the terms of the eclipse public license 2 0", "eclipse public license"),
    Template("isc", _ISC, "permission to use copy modify and or distribute"),
    Template("unlicense", _UNLICENSE, "free and unencumbered software"),
    Template("unlicense", "released under the unlicense", "unlicense"),
    Template("zlib", _ZLIB, "in no event will the authors be held liable"),
    Template("bsl", _BOOST, "any person or organization obtaining a copy of the software"),
    Template("cc0", "cc0 1 0 universal public domain dedication", "cc0 1 0 universal"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("cc-by-nc", "licensed under a creative commons attribution noncommercial license", "creative commons attribution noncommercial"),
)
#: Words of a key phrase that are indexed.
ANCHORS = 2


def words_of(text: Column) -> Column:
    """Words after lower-casing A-Z. The Kelvin sign is the one other character whose lower case is ASCII by itself."""
    lower = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u0138")))
    return F.array_remove(F.split(lower, NOT_WORD), "")


def document_frequencies(words: DataFrame, templates: tuple[Template, ...]) -> dict[str, int]:
    """Documents that hold each word of the key phrases; at most as many rows as there are such words."""
    known = sorted({w for t in templates for w in t.key.split()})
    found = words.select(F.explode(F.array_intersect("words", F.array(*map(F.lit, known)))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    return dict.fromkeys(known, 0) | {r["w"]: r["n"] for r in found.collect()}


def rarest(template: Template, frequency: dict[str, int]) -> list[list[tuple[str, int]]]:
    """For each of the rarest words of the key phrase, the word and every place of it there, as places of the notice.

    A key phrase of one word has only that to agree with.
    """
    key = template.key.split()
    chosen = sorted(dict.fromkeys(key), key=lambda w: (frequency[w], key.index(w)))
    chosen = (chosen * ANCHORS)[:ANCHORS] if len(chosen) < ANCHORS else chosen[:ANCHORS]
    return [[(w, template.key_at + i) for i, x in enumerate(key) if x == w] for w in chosen]


_SHIFT = 1 << 32  # a template and a start of its notice are one long; starts before the text are negative


def _postings(entries: list[tuple[str, int, int]], at: Column, word: Column) -> Column:
    """The candidates that a word at a place stands for: template * 2^32 + place - offset."""
    by_word: dict[str, list[int]] = {}
    for w, template, offset in entries:
        by_word.setdefault(w, []).append(template * _SHIFT - offset)
    table = F.create_map(*[x for w, v in sorted(by_word.items()) for x in (F.lit(w), F.array(*[F.lit(i).cast("long") for i in v]))])
    return F.transform(F.element_at(table, word), lambda v: v + at)


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row of ``docs`` (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words_of(F.col("text")).alias("words"))
    frequency = document_frequencies(rows, templates)
    chosen = [rarest(t, frequency) for t in templates]
    groups = [[(w, i, o) for i, c in enumerate(chosen) for w, o in c[k]] for k in range(ANCHORS)]
    # The index words of a text, the templates that have all their key words in it, and their rarest words, which are looked up.
    indexed = sorted({w for t in templates for w in t.key.split()})
    keys = F.array(*[F.array(*map(F.lit, t.key.split())) for t in templates])
    rare = F.array(*[F.array(*[F.lit(c[k][0][0]) for k in range(ANCHORS)]) for c in chosen])
    rows = rows.withColumn("_have", F.array_intersect("words", F.array(*map(F.lit, indexed))))
    live = F.filter(F.sequence(F.lit(0), F.lit(len(templates) - 1)), lambda t: F.forall(F.get(keys, t), lambda w: F.array_contains("_have", w)))
    rows = rows.withColumn("_look", F.when(F.size("_have") > 0, F.array_distinct(F.flatten(F.transform(live, lambda t: F.get(rare, t))))))
    places = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.array_contains("_look", F.get("words", i)))
    rows = rows.withColumn("_at", F.when(F.size("_look") > 0, places))

    def candidates(entries: list[tuple[str, int, int]]) -> Column:
        own = sorted({w for w, _, _ in entries})
        hits = F.filter("_at", lambda i: F.get("words", i).isin(own))
        return F.flatten(F.transform(hits, lambda i: _postings(entries, i.cast("long"), F.get("words", i))))

    # Where no indexed word stands, nothing else is computed.
    both = F.array_intersect(candidates(groups[0]), candidates(groups[1]))
    rows = rows.withColumn("_both", F.when(F.size("_at") > 0, both))
    key_at = F.array(*[F.lit(t.key_at) for t in templates])
    notices = F.array(*[F.array(*map(F.lit, t.words)) for t in templates])
    labels = F.array(*[F.lit(t.label) for t in templates])

    # A start before the text borrows from the template's number, so half the range is added before division.
    template = lambda c: F.floor((c + _SHIFT // 2) / F.lit(_SHIFT)).cast("int")
    split = F.transform("_both", lambda c: F.struct(template(c).alias("t"), (c - template(c).cast("long") * _SHIFT).cast("int").alias("start")))
    rows = rows.withColumn("_split", split)
    start = lambda x: x["start"] + F.get(key_at, x["t"])
    phrase = lambda x: F.slice(F.col("words"), start(x) + 1, F.size(F.get(keys, x["t"])))
    rows = rows.withColumn("_found", F.coalesce(F.filter("_split", lambda x: (start(x) >= 0) & (phrase(x) == F.get(keys, x["t"]))), F.expr("array()").cast("array<struct<t:int,start:int>>")))

    def share(x: Column) -> Column:
        notice = F.get(notices, x["t"])
        there = F.filter(F.sequence(F.lit(0), F.size(notice) - 1), lambda j: F.coalesce(F.get("words", x["start"] + j) == F.get(notice, j), F.lit(False)))
        return F.size(there).cast("double") / F.size(notice).cast("double")

    base = F.filter("_found", lambda x: x["t"].isin([i for i, t in enumerate(templates) if t.base]))
    named = lambda found: F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda x: F.get(labels, x["t"])))), ",")
    rows = rows.withColumn("_base", F.transform(base, start))
    return rows.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.size("_base").cast("long").alias("n_base"),
        F.array_min("_base").cast("long").alias("first_word"),
        F.array_max("_base").cast("long").alias("last_word"),
        named(base).alias("base_labels"),
        named(F.col("_found")).alias("labels"),
        F.coalesce(F.array_max(F.transform("_found", share)), F.lit(0.0)).alias("score"),
    )


def scan_sql(templates: tuple[Template, ...] = TEMPLATES) -> str:
    """The same result in DuckDB's SQL, without an index: every phrase is tried at every place."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    table = ", ".join(f"({i}, '{t.label}', {t.words!r}, {t.key.split()!r}, {t.key_at}, {str(t.base).lower()})" for i, t in enumerate(templates))
    return rf"""
WITH templates(t, label, notice, key, key_at, base) AS (VALUES {table}),
words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{letters}', '{letters.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
starts AS (
  SELECT doc_id, t, label, base, i, w, notice, i - key_at AS start
  FROM (SELECT doc_id, w, unnest(range(len(w))) AS i FROM words) JOIN templates ON w[i + 1] = key[1] AND w[i + 1 : i + len(key)] = key),
scored AS (
  SELECT *, list_sum([CASE WHEN start + j >= 0 AND w[start + j + 1] = notice[j + 1] THEN 1 ELSE 0 END FOR j IN range(len(notice))])::DOUBLE / len(notice)::DOUBLE AS share
  FROM starts),
found AS (
  SELECT doc_id, count(*) FILTER (base) AS n_base, min(i) FILTER (base) AS first_word, max(i) FILTER (base) AS last_word,
    array_to_string(list_sort(list_distinct(list(label) FILTER (base))), ',') AS base_labels,
    array_to_string(list_sort(list_distinct(list(label))), ',') AS labels, max(share) AS score
  FROM scored GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM words LEFT JOIN found USING (doc_id)"""
