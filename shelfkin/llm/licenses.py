"""Licences in texts, by fixed phrases and by a positional index of rare licence words.

Templates are short licence notices. The index holds each template's words of the highest inverse
document frequency over all templates, with their places. A text's occurrences of index words are
looked up; subtracting places gives the offset at which a template would lie, and offsets that
enough of a template's rare words agree on are candidates. A candidate counts when the template's
mandatory key phrase stands inside it and enough of its words stand in their places.

Words are runs of letters, digits and non-ASCII characters, A to Z in small letters; places count
words from 0. A null text is empty and has no words. Repeated rows get equal answers; other
columns of the input are not looked at.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfkin.llm.arrow import ALNUM, flat, lower, slices, word_hashes, words
from shelfkin.shipping import ship

# The phrases of the contract and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Licence notices as (label, mandatory key phrase, notice).
TEMPLATES = [
    ("mit", "the mit license", "released under the mit license"),
    ("mit", "the mit license", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge",
     "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
     "documentation files the software to deal in the software without restriction"),
    ("apache-2", "apache license version 2", "licensed under the apache license version 2 0"),
    ("apache-2", "apache license version 2",
     "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("cc-by-nc", "cc by nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "attribution noncommercial",
     "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by", "cc by", "licensed under cc by 4 0"),
    ("cc-by-sa", "cc by sa", "licensed under cc by sa 4 0"),
    ("gpl-2", "gnu general public license version 2", "this work is licensed under the gnu general public license version 2"),
    ("gpl-3", "gnu general public license version 3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-2", "the gnu general public license as published by the free software foundation either version 2 of the license",
     "you can redistribute it and or modify it under the terms of the gnu general public license as published by the "
     "free software foundation either version 2 of the license"),
    ("gpl-3", "the gnu general public license as published by the free software foundation either version 3 of the license",
     "you can redistribute it and or modify it under the terms of the gnu general public license as published by the "
     "free software foundation either version 3 of the license"),
    ("lgpl-3", "gnu lesser general public license version 3", "licensed under the gnu lesser general public license version 3"),
    ("lgpl-2.1", "the gnu lesser general public license as published by the free software foundation either version 2 1 of the license",
     "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the "
     "free software foundation either version 2 1 of the license"),
    ("lgpl-3", "the gnu lesser general public license as published by the free software foundation either version 3 of the license",
     "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the "
     "free software foundation either version 3 of the license"),
    ("agpl-3", "the gnu affero general public license as published by the free software foundation either version 3 of the license",
     "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the "
     "free software foundation either version 3 of the license"),
    ("mpl-2", "mozilla public license v 2 0",
     "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("bsd", "redistribution and use in source and binary forms",
     "redistribution and use in source and binary forms with or without modification are permitted provided that the "
     "following conditions are met"),
    ("bsd-3", "endorse or promote products derived from this software",
     "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
     "products derived from this software without specific prior written permission"),
    ("epl-2", "eclipse public license v 2 0",
     "this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0"),
    ("epl-2", "eclipse public license 2 0",
     "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
    ("isc", "permission to use copy modify and or distribute this software",
     "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "unencumbered software", "this is free and unencumbered software released into the public domain"),
]
#: Rare words of a template in the index, the share of them that must agree on an offset, and the
#: share of the template's words that must stand in their places.
RARE, AGREE, ALIKE = 6, 0.6, 0.75
FOUND = "array<struct<label: string, first_word: long, n_words: long, score: double>>"


def _hashes(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    start, end, _ = words(data, np.array([0, len(data)]), ALNUM)
    return word_hashes(data, start, end)


@dataclass
class Index:
    """Templates as word hashes, and postings ``word -> (template, place)`` of rare words."""

    labels: list[str]
    templates: list[np.ndarray]
    keys: list[np.ndarray]
    needed: np.ndarray
    vocabulary: np.ndarray = field(init=False)
    postings: list[list[tuple[int, int]]] = field(init=False)

    def __post_init__(self):
        held = Counter(h for t in self.templates for h in set(t.tolist()))
        idf = {h: math.log(len(self.templates) / n) for h, n in held.items()}
        by_word: dict[int, list[tuple[int, int]]] = {}
        for k, t in enumerate(self.templates):
            places = sorted(range(len(t)), key=lambda i: (-idf[int(t[i])], i))[:RARE]
            self.needed[k] = max(2, math.ceil(AGREE * len(places)))
            for i in places:
                by_word.setdefault(int(t[i]), []).append((k, i))
        self.vocabulary = np.array(sorted(by_word), np.uint64)
        self.postings = [by_word[int(h)] for h in self.vocabulary]


def build(templates: list[tuple[str, str, str]]) -> Index:
    return Index(
        [t[0] for t in templates], [_hashes(t[2]) for t in templates], [_hashes(t[1]) for t in templates],
        np.zeros(len(templates), np.int64),
    )


def _among(hashes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of words in the sorted ``wanted``; a small table of leading bits goes first."""
    table = np.zeros(1 << 16, bool)
    table[(wanted >> np.uint64(48)).astype(np.int64)] = True
    at = np.flatnonzero(table[(hashes >> np.uint64(48)).astype(np.int64)])
    found = np.searchsorted(wanted, hashes[at])
    return at[(found < len(wanted)) & (wanted[np.minimum(found, len(wanted) - 1)] == hashes[at])]


def phrase_places(hashes: np.ndarray, row: np.ndarray, phrase: np.ndarray, near: np.ndarray, anchor: int) -> np.ndarray:
    """First words of a phrase's places; ``near`` are the places of its word ``anchor``."""
    first = near - anchor
    first = first[(first >= 0) & (first + len(phrase) <= len(hashes))]
    for k, h in enumerate(phrase):
        first = first[hashes[first + k] == h]
    return first[row[first] == row[first + len(phrase) - 1]] if len(first) else first


def _template_finds(index: Index, hashes: np.ndarray, row: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list[tuple[int, int, int, float]]:
    """``(row, template, first word, share of words in place)`` of all templates found."""
    at = _among(hashes, index.vocabulary)
    if not len(at):
        return []
    word = np.searchsorted(index.vocabulary, hashes[at])
    count = np.array([len(p) for p in index.postings])[word]
    flat_postings = np.array([x for p in index.postings for x in p], np.int64)
    begin = np.cumsum([0, *[len(p) for p in index.postings]])[word]
    pick = np.repeat(begin - np.cumsum(count) + count, count) + np.arange(count.sum())
    template, place = flat_postings[pick].T
    offset = np.repeat(at, count) - place
    votes = np.stack([np.repeat(row[at], count), template, offset])
    votes, agree = np.unique(votes, axis=1, return_counts=True)
    out = []
    for r, k, first in votes[:, agree >= index.needed[votes[1]]].T.tolist():
        words_, key = index.templates[k], index.keys[k]
        a, b = max(first, int(lo[r])), min(first + len(words_), int(hi[r]))
        here = hashes[a:b]
        same = int((here == words_[a - first : b - first]).sum())
        score = same / len(words_)
        has_key = any(np.array_equal(here[i : i + len(key)], key) for i in np.flatnonzero(here == key[0]))
        if has_key and score >= ALIKE:
            out.append((r, k, first, score))
    return out


def _scan(index: Index, phrases: dict[str, str]):
    coded = [(_hashes(p), label) for p, label in phrases.items()]
    held = Counter(int(h) for p, _ in coded for h in set(p.tolist()))
    coded = [(p, label, max(range(len(p)), key=lambda i: (-held[int(p[i])], i))) for p, label in coded]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column("text")):
                data, at = flat(batch.column("text").slice(a, b - a))
                data = lower(data)
                start, end, row = words(data, at, ALNUM)
                hashes = word_hashes(data, start, end)
                n = b - a
                count = np.bincount(row, minlength=n)
                hi = np.cumsum(count)
                lo = hi - count
                places: list[list[int]] = [[] for _ in range(n)]
                labels: list[set[str]] = [set() for _ in range(n)]
                for phrase, label, anchor in coded:
                    near = _among(hashes, phrase[anchor : anchor + 1])
                    for p in phrase_places(hashes, row, phrase, near, anchor).tolist():
                        places[row[p]].append(p - int(lo[row[p]]))
                        labels[row[p]].add(label)
                found: list[list[dict]] = [[] for _ in range(n)]
                for r, k, first, score in _template_finds(index, hashes, row, lo, hi):
                    found[r].append({"label": index.labels[k], "first_word": first - int(lo[r]),
                                     "n_words": len(index.templates[k]), "score": round(score, 6)})
                kind = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("score", pa.float64())]))
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(a, n), pa.array(count, pa.int64()),
                    pa.array([sorted(p) for p in places], pa.list_(pa.int64())),
                    pa.array([sorted(x) for x in labels], pa.list_(pa.string())), pa.array(found, kind),
                ], names=["doc_id", "n_words", "places", "base_labels", "found"])

    return run


def scan(docs: DataFrame, templates: list[tuple[str, str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """``(doc_id, n_words, places, base_labels, found)``: the phrases' places and labels, and the
    templates found with their first word, number of words and share of words in place."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        _scan(build(templates), phrases),
        f"doc_id {kind}, n_words long, places array<long>, base_labels array<string>, found {FOUND}",
    )


def report(docs: DataFrame) -> DataFrame:
    """Counts, places and labels of every row; the score is 1 with a phrase of the contract, else
    the best template's."""
    labels = F.array_sort(F.array_union("base_labels", F.transform("found", lambda f: f["label"])))
    best = F.coalesce(F.array_max(F.transform("found", lambda f: f["score"])), F.lit(0.0))
    return scan(docs).select(
        "doc_id", "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").alias("first_word"),
        F.array_max("places").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(best).alias("score"),
    )
