"""License notices in documents: an exact set-similarity join of text blocks with templates, and fixed phrases."""

from collections.abc import Sequence
from dataclasses import dataclass, field
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from plumbline.llm.text import Words, positional, text_slices

# Share of a template's distinct words that a block has to hold, and words of a block for each word of the template.
CONTAINMENT, STRETCH = 0.8, 1.25

# Bytes that words are made of: digits, small letters, everything beyond ASCII. Capital letters count as small ones.
SEPARATES = np.ones(256, bool)
SEPARATES[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
SMALL = np.arange(256, dtype=np.uint8)
SMALL[0x41:0x5B] += 32

# Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Notices as the licenses themselves tell authors to write them.
TEMPLATES = (
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
            "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License "
             "as published by the Free Software Foundation"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
               "You may obtain a copy of the License at"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
            "(the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
            "publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "Released under the MIT License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
            "conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("all-rights-reserved", "All rights reserved."),
)


def words_of(column: pa.Array) -> Words:
    return Words(column, SEPARATES, SMALL)


@dataclass
class Template:
    """A notice as a set of word hashes: how many a block of ``length`` words must hold, and their ``rank`` from rare to common."""

    label: str
    tokens: np.ndarray
    length: int
    least: int
    rank: np.ndarray = field(default=None)


def read_templates(templates: Sequence[tuple[str, str]], containment: float = CONTAINMENT) -> list[Template]:
    """Templates of at least one word."""
    words = words_of(pa.array([text for _, text in templates], pa.large_string()))
    hashes, out = words.hashes(), []
    for i, (label, _) in enumerate(templates):
        own = hashes[words.first[i] : words.first[i + 1]]
        if len(own):
            tokens = np.unique(own)
            out.append(Template(label, tokens, ceil(len(own) * STRETCH), max(ceil(len(tokens) * containment - 1e-9), 1)))
    return out


def word_counts(docs: DataFrame, vocabulary: np.ndarray, text: str) -> np.ndarray:
    """How often each word hash of the vocabulary occurs in all texts; as many rows as it has words reach the driver."""

    def count(batches):
        total = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for part in text_slices(iter([batch]), text):
                place, known = _places(words_of(part.column(text)).hashes(), vocabulary)
                total += np.bincount(place[known], minlength=len(vocabulary))
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total)), pa.array(total[total > 0])], ["place", "n"])

    found = docs.select(text).mapInArrow(count, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(len(vocabulary), np.int64)
    for row in found:
        out[row["place"]] = row["n"]
    return out


def _places(hashes: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each hash in the sorted vocabulary, and whether it is there."""
    place = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    return place, vocabulary[place] == hashes


def candidates(ranks: np.ndarray, first: np.ndarray, template: Template) -> np.ndarray:
    """First words of the blocks that may hold enough of the template.

    ``ranks`` has the rank in the template of each word (-1: none), ``first`` the first word of each row. A block that shares
    ``least`` of m words has one of the m - least + 1 rarest (prefix filter). If its rarest shared word has rank i, it shares at most
    m - i words, and no more than the words of rank i or above that stand in it (positional and length filter).
    """
    m, size, need = len(template.tokens), template.length, template.least
    rare = np.flatnonzero((ranks >= 0) & (ranks <= m - need))
    if not len(rare):
        return rare
    row = np.searchsorted(first, rare, "right") - 1
    low = np.maximum(rare - size + 1, first[row])
    # a row that is shorter than a block is one block
    high = np.maximum(np.minimum(rare, first[row + 1] - size), first[row])
    spans = np.maximum(high - low + 1, 0)
    starts = np.repeat(low - np.concatenate([[0], np.cumsum(spans)[:-1]]), spans) + np.arange(spans.sum())
    least = np.repeat(ranks[rare], spans)
    order = np.lexsort((least, starts))
    starts, least = starts[order], least[order]
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] != starts[:-1]
    starts, least = starts[new], least[new]
    ends = np.minimum(starts + size, first[np.searchsorted(first, starts, "right")])
    possible = np.zeros(len(starts), bool)
    for i in np.unique(least):
        own = least == i
        sums = np.concatenate([[0], np.cumsum(ranks >= i)])
        possible[own] = np.minimum(sums[ends[own]] - sums[starts[own]], m - i) >= need
    return starts[possible]


def shared_words(ranks: np.ndarray, first: np.ndarray, starts: np.ndarray, template: Template) -> np.ndarray:
    """How many distinct words of the template each of the blocks holds."""
    at = np.flatnonzero(ranks >= 0)
    row = np.searchsorted(first, at, "right") - 1
    order = np.lexsort((at, ranks[at], row))
    before = np.full(len(at), -1)
    same = (ranks[at[order[1:]]] == ranks[at[order[:-1]]]) & (row[order[1:]] == row[order[:-1]])
    before[order[1:][same]] = at[order[:-1][same]]
    # a word counts in the blocks where it stands first
    steps = np.zeros(len(ranks) + 1, np.int64)
    np.add.at(steps, np.maximum(np.maximum(before + 1, at - template.length + 1), first[row]), 1)
    np.add.at(steps, at + 1, -1)
    return np.cumsum(steps)[starts]


def _phrase_places(words: Words, hashes: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """First words of all places where the words of a phrase stand one after the other in one row."""
    at = np.flatnonzero(hashes == phrase[0])
    at = at[at + len(phrase) <= len(hashes)]
    for i in range(1, len(phrase)):
        at = at[(hashes[at + i] == phrase[i]) & (words.doc[at + i] == words.doc[at])]
    return at


def license_notices(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES,
                    text: str = "text", containment: float = CONTAINMENT) -> DataFrame:
    """``docs`` with ``n_words``, ``places``, ``blocks``, ``base_labels``, ``labels`` and ``score``.

    Words are runs of digits, letters a-z (A-Z count as these) and all characters beyond ASCII. ``places`` holds (word, label) of every
    place where the words of a phrase stand consecutively. ``blocks`` holds (label, template, word, n_words, share): for each template the
    runs of overlapping blocks that hold at least ``containment`` of its distinct words, each given by its best block, the earliest of
    equals. A block is ``STRETCH`` times as long as the template in words and starts at any word; a text shorter than that is one block.
    ``base_labels`` are those of the phrases, ``labels`` those of blocks too, both distinct, sorted and comma-joined. ``score`` is 1 where
    a phrase was found, else the largest share of a template in a block, 0 without any.

    The join is exact: templates' words are ordered from rare to common by their counts over all texts (one job, whose result is as
    large as the templates), and prefix, positional and length filters leave out only blocks that can't reach the threshold.

    A null text is empty: no words, places or blocks, empty labels, score 0. Equal rows have equal results, no columns but the text
    are read, and columns with the name of an added one are replaced. An empty table gives an empty result.
    """
    added = ["n_words", "places", "blocks", "base_labels", "labels", "score"]
    docs = docs.drop(*[c for c in added if c != text])
    names = docs.columns
    docs, (column,) = positional(docs, text)
    plan = read_templates(templates, containment)
    vocabulary = np.unique(np.concatenate([t.tokens for t in plan])) if plan else np.zeros(0, np.uint64)
    if plan:
        counts = word_counts(docs, vocabulary, column)
        for t in plan:
            t.tokens = t.tokens[np.lexsort((t.tokens, counts[np.searchsorted(vocabulary, t.tokens)]))]
            t.rank = np.full(len(vocabulary), -1)
            t.rank[np.searchsorted(vocabulary, t.tokens)] = np.arange(len(t.tokens))
    parsed = words_of(pa.array(list(phrases), pa.large_string()))
    hashed = parsed.hashes()
    wanted = [(hashed[parsed.first[i] : parsed.first[i + 1]], label) for i, label in enumerate(phrases.values())]
    wanted = [(phrase, label) for phrase, label in wanted if len(phrase)]

    place = pa.struct([("word", pa.int64()), ("label", pa.string())])
    block = pa.struct([("label", pa.string()), ("template", pa.int32()), ("word", pa.int64()), ("n_words", pa.int64()), ("share", pa.float64())])

    def find(batches):
        for batch in text_slices(batches, column):
            words = words_of(batch.column(column))
            hashes = words.hashes()
            places, blocks = [[] for _ in range(batch.num_rows)], [[] for _ in range(batch.num_rows)]
            for phrase, label in wanted:
                for at in _phrase_places(words, hashes, phrase).tolist():
                    places[words.doc[at]].append({"word": at - int(words.first[words.doc[at]]), "label": label})
            if plan and len(hashes):
                known_place, known = _places(hashes, vocabulary)
                for number, template in enumerate(plan):
                    ranks = np.where(known, template.rank[known_place], -1)
                    starts = candidates(ranks, words.first, template)
                    if not len(starts):
                        continue
                    shared = shared_words(ranks, words.first, starts, template)
                    enough = shared >= template.least
                    for start, n in _best_of_runs(starts[enough], shared[enough], template.length, words.doc):
                        row = words.doc[start]
                        length = min(template.length, int(words.first[row + 1]) - start)
                        blocks[row].append({
                            "label": template.label, "template": number, "word": start - int(words.first[row]), "n_words": length,
                            "share": n / len(template.tokens),
                        })
            for found in places:
                found.sort(key=lambda p: (p["word"], p["label"]))
            base = [",".join(sorted({p["label"] for p in found})) for found in places]
            every = [",".join(sorted({p["label"] for p in own} | {b["label"] for b in more})) for own, more in zip(places, blocks)]
            score = [1.0 if own else max((b["share"] for b in more), default=0.0) for own, more in zip(places, blocks)]
            yield pa.RecordBatch.from_arrays([
                *batch.columns, pa.array(words.counts.astype(np.int64)), pa.array(places, pa.list_(place)), pa.array(blocks, pa.list_(block)),
                pa.array(base, pa.string()), pa.array(every, pa.string()), pa.array(score, pa.float64()),
            ], [*batch.schema.names, *(f"new_{c}" for c in added)])

    long, string = T.LongType(), T.StringType()
    kinds = [
        long, T.ArrayType(T.StructType([T.StructField("word", long), T.StructField("label", string)])),
        T.ArrayType(T.StructType([
            T.StructField("label", string), T.StructField("template", T.IntegerType()), T.StructField("word", long),
            T.StructField("n_words", long), T.StructField("share", T.DoubleType()),
        ])), string, string, T.DoubleType(),
    ]
    schema = T.StructType([*docs.schema.fields, *(T.StructField(f"new_{c}", kind) for c, kind in zip(added, kinds))])
    return docs.mapInArrow(find, schema).toDF(*names, *added)


def _best_of_runs(starts: np.ndarray, shared: np.ndarray, length: int, doc: np.ndarray):
    """Of each run of blocks of one row that overlap the one before: the first of those that share most, with what it shares."""
    best = None
    for i, (start, n) in enumerate(zip(starts.tolist(), shared.tolist())):
        if best is not None and (start - starts[i - 1] >= length or doc[start] != doc[starts[i - 1]]):
            yield best
            best = None
        if best is None or n > best[1]:
            best = (start, n)
    if best is not None:
        yield best
