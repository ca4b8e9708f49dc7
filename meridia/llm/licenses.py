"""License scans with a positional index of rare words.

One pass counts in how many documents each word of the license templates occurs; the inverse document frequency
ranks the words and picks each template's rarest. All of those that a file holds then vote, however many templates it
holds: a word at place p of the file and place q of a template votes for that template starting at p - q. Starts with
enough distinct votes are verified: the template's words must line up there and its mandatory key phrases must stand
in that stretch.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.llm._shared import read_table, text_slices

# Phrases whose consecutive words give a label by themselves.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Fixed values: (label, notice, mandatory key phrases), in words as the scan takes them.
TEMPLATES = [
    ("apache", "licensed under the apache license version 2 0", ["apache license"]),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at",
     ["except in compliance with the license"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
     "documentation files to deal in the software without restriction", ["permission is hereby granted free of charge"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
     "granted provided that the above copyright notice and this permission notice appear in all copies",
     ["with or without fee is hereby granted"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that "
     "the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("gpl", "this work is licensed under the gnu general public license version 3", ["gnu general public license"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
     "public license as published by the free software foundation", ["gnu general public license"]),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license",
     ["gnu lesser general public license"]),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license",
     ["creative commons attribution"]),
    ("cc-by", "this text is shared under cc by 4 0", ["cc by"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software"]),
]

RARE_PER_TEMPLATE = 6  # words of a template that can call it up
MIN_COVER = 0.6  # share of a template's words that must line up
DRIFT = 2  # places that a word may be off

_SPLIT = bytes(
    c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256)
)


def license_words(text: bytes) -> list[bytes]:
    """Lower-cased longest runs of 0-9, a-z and everything beyond ASCII."""
    return text.translate(_SPLIT).split()


def places(words: list[bytes], phrase: list[bytes]) -> list[int]:
    """Where the phrase's words stand consecutively."""
    found, at, n = [], -1, len(phrase)
    try:
        while True:
            at = words.index(phrase[0], at + 1)
            if words[at : at + n] == phrase:
                found.append(at)
    except ValueError:
        return found


@dataclass
class Index:
    """Postings of template words, and their weights."""

    labels: list[str]
    words: list[list[bytes]]
    keys: list[list[list[bytes]]]
    idf: dict[bytes, float]
    rare: list[set[bytes]]
    postings: dict[bytes, list[tuple[int, int]]] = field(default_factory=dict)


def build_index(templates: list[tuple[str, str, list[str]]], frequency: dict[str, int], documents: int) -> Index:
    split = [license_words(t.encode()) for _, t, _ in templates]
    idf = {w: math.log((documents + 1) / (frequency.get(w.decode(), 0) + 1)) for w in {w for ws in split for w in ws}}
    rare = [set(sorted(set(ws), key=lambda w: (-idf[w], w))[:RARE_PER_TEMPLATE]) for ws in split]
    postings = defaultdict(list)
    for t, ws in enumerate(split):
        for q, w in enumerate(ws):
            if w in rare[t]:
                postings[w].append((t, q))
    keys = [[license_words(k.encode()) for k in ks] for *_, ks in templates]
    return Index([x[0] for x in templates], split, keys, idf, rare, dict(postings))


def match_templates(words: list[bytes], index: Index) -> dict[str, float]:
    """Label -> best share of a template's words that line up, over verified templates."""
    here = index.postings.keys() & set(words)
    votes: dict[tuple[int, int], set[int]] = defaultdict(set)
    for w in here:
        for p in places(words, [w]):
            for t, q in index.postings[w]:
                votes[t, p - q].add(q)
    found: dict[str, float] = {}
    for (t, start), seen in votes.items():
        own = index.words[t]
        if len(seen) < min(3, len(index.rare[t])) or found.get(index.labels[t], 0) >= 1:
            continue
        low = max(0, start - DRIFT)
        stretch = words[low : start + len(own) + DRIFT]
        if not all(places(stretch, k) for k in index.keys[t]):
            continue
        cover = sum(w in words[max(0, start + q - DRIFT) : start + q + DRIFT + 1] for q, w in enumerate(own)) / len(own)
        if cover >= MIN_COVER:
            found[index.labels[t]] = max(found.get(index.labels[t], 0), cover)
    return found


def word_frequencies(docs: DataFrame, text_column: str, vocabulary: set[str]) -> tuple[dict[str, int], int]:
    """In how many rows each word of the (small, fixed) vocabulary occurs, over all rows; and the number of rows."""
    wanted = frozenset(w.encode() for w in vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        rows = 0
        for batch in batches:
            for _, _, texts in text_slices(batch.column(0)):
                rows += len(texts)
                for text in texts:
                    seen.update(wanted.intersection(license_words(text)))
        seen[b""] = rows
        yield pa.RecordBatch.from_pydict({"word": [w.decode() for w in seen], "n": list(seen.values())})

    total = docs.select(text_column).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = {r.word: r.n for r in total.collect()}  # at most one row for each word of the vocabulary
    return found, found.pop("", 0)


SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double"
)


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str, list[str]]] | None = None) -> DataFrame:
    """Base places and labels, and the labels and score of the index, of every document.

    Null and empty texts have no words, no labels and score 0; repeated rows repeat their result; an empty table
    gives none. Only doc_id and text are read, so other columns may have any names. A label of a base phrase
    scores 1, a template scores the share of its words that line up.
    """
    templates = TEMPLATES if templates is None else templates
    vocabulary = {w.decode() for _, t, _ in templates for w in license_words(t.encode())}
    frequency, rows = word_frequencies(docs, "text", vocabulary)
    index = build_index(templates, frequency, rows)
    phrases = [(license_words(p.encode()), label) for p, label in BASE_PHRASES.items()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for a, b, texts in text_slices(batch.column(1)):
                out = []
                for key, text in zip(keys[a:b], texts, strict=True):
                    words = license_words(text)
                    starts, base = [], set()
                    for phrase, label in phrases:
                        if found := places(words, phrase):
                            starts += found
                            base.add(label)
                    method = match_templates(words, index)
                    score = 1.0 if base else max(method.values(), default=0.0)
                    out.append(
                        (key, len(words), len(starts), min(starts, default=None), max(starts, default=None),
                         ",".join(sorted(base)), ",".join(sorted(base | set(method))), score)
                    )
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), ARROW, strict=True)], schema=ARROW
                )

    return docs.select("doc_id", "text").mapInArrow(scan, SCHEMA)


ARROW = pa.schema(
    [(x, pa.int64()) for x in ("doc_id", "n_words", "n_base", "first_word", "last_word")]
    + [("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]
)


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read_table(spark, sf_dir, "documents"))
