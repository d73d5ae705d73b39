"""Licence scan: a positional index of rare licence words. DataFrame functions only.

Templates are notices with mandatory key phrases. Each phrase is indexed by its ``ANCHORS`` words of highest IDF
over all documents, with their positions in the phrase. A document's indexed words are looked up; each gives the
relative position where its phrase would start, the postings of a phrase are intersected by that position, and
the words there are compared with the whole phrase. All occurrences are looked up, so no place is missed.

A template is found where its first key phrase stands and each further one stands within ``SLACK`` words of its
place relative to some stand of the first. Base phrases are templates of one key phrase.

Words are runs of characters other than ASCII non-alphanumerics, A-Z lowered. Score: 1 for a template of one
phrase; for longer ones the largest share of the template's words that stand around one of its places; without any
template, half the largest share of a template's key phrases that were found.

Defined results: null and wordless texts have no words, places or labels, and score 0. Repeated rows get equal
results. Nothing depends on ids, so null and repeated ids are as good as any. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from serupa.functions.binding import bind

ANCHORS = 2
SLACK = 40
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Phrases and labels of the scan, and the wording of public licences and their notices.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ["permission is hereby granted free of charge to any person obtaining a copy", "to deal in the software without restriction"]),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ["licensed under the apache license version 2 0", "may not use this file except in compliance with the license"]),
    ("gpl-3", "gnu general public license version 3", ["gnu general public license version 3"]),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", ["gnu general public license as published by the free software foundation", "version 3 of the license"]),
    ("gpl-2", "gnu general public license version 2", ["gnu general public license version 2"]),
    ("lgpl-3", "gnu lesser general public license version 3", ["gnu lesser general public license version 3"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms", "are permitted provided that the following conditions are met"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["permission to use copy modify and or distribute this software", "with or without fee is hereby granted"]),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license v 2 0"]),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0 international"]),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ["creative commons attribution noncommercial 4 0"]),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ["waived all copyright and related or neighboring rights"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software released into the public domain"]),
]


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    phrases: tuple[tuple[str, ...], ...]
    base: bool

    def offset(self, phrase: tuple[str, ...]) -> int:
        return next(i for i in range(len(self.words)) if self.words[i : i + len(phrase)] == phrase)


TEMPLATES = [Template(label, tuple(p.split()), (tuple(p.split()),), True) for p, label in BASE.items()]
TEMPLATES += [Template(label, tuple(t.split()), tuple(tuple(p.split()) for p in phrases), False) for label, t, phrases in NOTICES]


def document_words(text: str) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def rare_first(docs: DataFrame, text: str, templates: list[Template]) -> dict[str, int]:
    """How many documents hold each word of the templates' phrases: one row per such word comes back."""
    known = sorted({w for t in templates for p in t.phrases for w in p})
    held = docs.select(F.explode(F.array_intersect(document_words(text), F.array(*map(F.lit, known)))).alias("word"))
    return dict.fromkeys(known, 0) | {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count("*").alias("n")).collect()}


def _array(words) -> Column:
    return F.array(*map(F.lit, words))


def scan(docs: DataFrame, keep: list[str], text: str = "text", templates: list[Template] = TEMPLATES) -> DataFrame:
    """``keep`` columns with n_words, n_base, first_word, last_word, base_labels and labels (sorted arrays) and score."""
    made = {"n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"}
    keep = [c for c in keep if c.lower() not in made]
    held = rare_first(docs, text, templates)
    phrases = list(dict.fromkeys(p for t in templates for p in t.phrases))
    postings = {p: sorted(sorted(range(len(p)), key=lambda i: (held[p[i]], i))[:ANCHORS]) for p in phrases}  # noqa: B023
    indexed = _array(sorted({p[i] for p in phrases for i in postings[p]}))

    kept = [F.col(c).alias(f"_keep_{c}") for c in keep]
    df = docs.select(*kept, document_words(text).alias("words"))
    found = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("at"))), lambda x: F.array_contains(indexed, x["word"]))
    none = F.array().cast("array<struct<word:string,at:int>>")
    df = df.withColumn("hits", F.when(F.arrays_overlap("words", indexed), found).otherwise(none))

    def places(phrase) -> Column:
        by_position = [
            F.transform(F.filter("hits", lambda h: h["word"] == phrase[i]), lambda h: h["at"] - i)  # noqa: B023
            for i in postings[phrase]
        ]
        agreed = reduce(F.array_intersect, by_position)
        stands = lambda s: (s >= 0) & (F.slice("words", F.greatest(s, F.lit(0)) + 1, len(phrase)) == _array(phrase))
        return F.when(F.size("hits") > 0, F.filter(agreed, stands)).otherwise(F.array().cast("array<int>"))

    df = df.select("*", *[places(p).alias(f"p{n}") for n, p in enumerate(phrases)])
    place = {p: F.col(f"p{n}") for n, p in enumerate(phrases)}

    def suited(t: Template, phrase) -> Column:
        """Where the first key phrase may stand for the places of a further one."""
        gap = t.offset(phrase) - t.offset(t.phrases[0])
        return F.flatten(F.transform(place[phrase], lambda e: F.sequence(e - gap - SLACK, e - gap + SLACK)))

    def stands(t: Template) -> Column:
        return reduce(F.array_intersect, [suited(t, p) for p in t.phrases[1:]], place[t.phrases[0]])

    df = df.select("*", *[stands(t).alias(f"t{n}") for n, t in enumerate(templates)])
    present = [F.size(f"t{n}") > 0 for n in range(len(templates))]

    def share(n: int, t: Template) -> Column:
        if len(t.phrases) == 1:
            return F.when(present[n], 1.0)
        distinct = sorted(set(t.words))
        begin = lambda s: F.greatest(F.lit(0), s - t.offset(t.phrases[0]))
        there = lambda s: F.size(F.array_intersect(F.slice("words", begin(s) + 1, len(t.words) + SLACK), _array(distinct)))
        return F.when(present[n], F.array_max(F.transform(f"t{n}", there)) / len(distinct))

    def part(t: Template) -> Column:
        return sum((F.size(place[p]) > 0).cast("int") for p in t.phrases) / (2.0 * len(t.phrases))

    scores = [F.coalesce(share(n, t), part(t)) for n, t in enumerate(templates)]
    base = [n for n, t in enumerate(templates) if t.base]
    starts = F.flatten(F.array(*[place[templates[n].phrases[0]] for n in base]))
    labels = lambda numbers: F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(present[n], F.lit(templates[n].label)) for n in numbers]))))
    return df.select(
        *[F.col(f"_keep_{c}").alias(c) for c in keep],
        F.size("words").cast("long").alias("n_words"),
        F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        labels(base).alias("base_labels"),
        labels(range(len(templates))).alias("labels"),
        F.when(F.size("hits") > 0, bind(F.array(*scores), F.array_max)).otherwise(F.lit(0.0)).alias("score"),
    )


def op1(spark: SparkSession, folder: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{folder}/documents.parquet"), ["doc_id"])
    return found.withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")})


def _sql() -> str:
    phrases = list(dict.fromkeys(p for t in TEMPLATES for p in t.phrases))
    number = {p: n for n, p in enumerate(phrases)}
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    place = [
        f"CASE WHEN contains(line, ' {' '.join(p)} ') THEN list_filter(range(0, len(w)), lambda i: w[i + 1:i + {len(p)}] = {quoted(p)}) ELSE [] END AS p{n}"
        for n, p in enumerate(phrases)
    ]

    def stands(t: Template) -> str:
        first = f"p{number[t.phrases[0]]}"
        near = " AND ".join(
            f"len(list_filter(p{number[p]}, lambda e: abs(e - s - {t.offset(p) - t.offset(t.phrases[0])}) <= {SLACK})) > 0"
            for p in t.phrases[1:]
        )
        return f"list_filter({first}, lambda s: {near})" if near else first

    def score(n: int, t: Template) -> str:
        distinct = sorted(set(t.words))
        begin = f"greatest(0, s - {t.offset(t.phrases[0])})"
        there = f"len(list_intersect(list_distinct(w[{begin} + 1:{begin} + {len(t.words) + SLACK}]), {quoted(distinct)}))"
        best = f"list_max(list_transform(t{n}, lambda s: {there})) / {len(distinct)}"
        parts = " + ".join(f"(len(p{number[p]}) > 0)::INT" for p in t.phrases)
        return f"CASE WHEN len(t{n}) > 0 THEN {'1.0::DOUBLE' if len(t.phrases) == 1 else best} ELSE ({parts}) / (2.0 * {len(t.phrases)}) END"

    base = [n for n, t in enumerate(TEMPLATES) if t.base]
    labels = lambda ns: "list_aggregate(list_sort(list_distinct(list_filter([" + ", ".join(f"CASE WHEN len(t{n}) > 0 THEN '{TEMPLATES[n].label}' END" for n in ns) + "], lambda x: x IS NOT NULL))), 'string_agg', ',')"
    starts = "flatten([" + ", ".join(f"p{number[TEMPLATES[n].phrases[0]]}" for n in base) + "])"
    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
l AS (SELECT *, ' ' || array_to_string(w, ' ') || ' ' AS line FROM d),
p AS (SELECT doc_id, w, {", ".join(place)} FROM l),
t AS (SELECT *, {starts} AS starts, {", ".join(f"{stands(t)} AS t{n}" for n, t in enumerate(TEMPLATES))} FROM p)
SELECT doc_id, len(w)::BIGINT AS n_words, len(starts)::BIGINT AS n_base, list_min(starts)::BIGINT AS first_word, list_max(starts)::BIGINT AS last_word,
       coalesce({labels(base)}, '') AS base_labels, coalesce({labels(range(len(TEMPLATES)))}, '') AS labels,
       greatest({", ".join(score(n, t) for n, t in enumerate(TEMPLATES))})::DOUBLE AS score
FROM t
"""


OP1_SQL = _sql()
