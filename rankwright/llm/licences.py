"""Licences named or quoted in whole texts, by a positional index of rare words.

Templates are short texts of licences. A word's weight grows with its rarity (inverse document
frequency over all documents). A place fits a template if words that carry at least ``percent`` of
the template's weight stand at their relative positions, and the template's key phrases stand
within it, word by word. Such a place holds one of the template's rarest words, namely of those
that carry more than the rest may lack, so only these words are in the index: the occurrences of a
text's rare licence words give (template, place), the postings of the other words are intersected
with them by relative position, and what reaches the limit is verified. A phrase is a template
that must fit in full, found by its rarest word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankwright.llm.runs import ALNUM, Runs, split_runs
from rankwright.llm.words import slices

#: Phrases that are reported wherever they stand. Fixed values.
PHRASES = (
    ("cc-by", "cc by"),
    ("gpl", "general public license"),
    ("reserved", "all rights reserved"),
)

#: Label, text and key phrases of each template, as published with the licences. Fixed values.
TEMPLATES = (
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
     ("affero general public license",)),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"
     " http://www.apache.org/licenses/LICENSE-2.0", ("apache org licenses license 2 0",)),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided"
     " that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License",
     ("creative commons attribution 4 0",)),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", ("cc by nc",)),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
     ("creative commons attribution noncommercial",)),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
     ("creative commons attribution sharealike",)),
    ("cc0", "has waived all copyright and related or neighboring rights to this work",
     ("waived all copyright and related or neighboring rights",)),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General"
     " Public License as published by the Free Software Foundation", ("gnu general public license",)),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3",
     ("general public license version 3",)),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is"
     " hereby granted", ("permission to use copy modify",)),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
     ("lesser general public license",)),
    ("mit", "Released under the MIT License", ("mit license",)),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
     " documentation files (the \"Software\"), to deal in the Software without restriction",
     ("permission is hereby granted free of charge", "deal in the software without restriction")),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
     ("mozilla public license",)),
    ("unlicense", "This is free and unencumbered software released into the public domain",
     ("free and unencumbered software",)),
)


@dataclass(frozen=True)
class LicenceSpec:
    """``templates`` are (label, text, key phrases), ``phrases`` (label, text); none may be empty."""

    templates: Sequence[tuple[str, str, Sequence[str]]] = TEMPLATES
    phrases: Sequence[tuple[str, str]] = PHRASES
    percent: int = 80


def words_of(text: str) -> list[str]:
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def vocabulary(spec: LicenceSpec) -> list[str]:
    """The words of all templates and phrases, sorted."""
    texts = [t for _, t, _ in spec.templates] + [t for _, t in spec.phrases]
    texts += [key for _, _, keys in spec.templates for key in keys]
    return sorted({w for t in texts for w in words_of(t)})


def _word_ids(words: Runs, known: pa.Array) -> np.ndarray:
    """The number of each word in ``known``, which has a space behind each word; -1 for others."""
    begin = np.append(words.starts, len(words.data)).astype(np.int64)
    column = pa.LargeStringArray.from_buffers(words.count, pa.py_buffer(begin), pa.py_buffer(words.data))
    found = pc.fill_null(pc.index_in(column, value_set=known), -1)
    return found.to_numpy(zero_copy_only=False).astype(np.int32)


def _spaced(names: Sequence[str]) -> pa.Array:
    return pa.array([f"{n} " for n in names], pa.large_string())


def _count(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total, rows = _spaced(names), np.zeros(len(names) + 1, dtype=np.int64), 0
        for batch in batches:
            for part in slices(batch, "text"):
                words = split_runs(part.column("text"), ALNUM)
                ids, of = _word_ids(words, known), words.rows()
                once = np.unique(of[ids >= 0] * len(names) + ids[ids >= 0]) % len(names)
                total[:-1] += np.bincount(once, minlength=len(names))
                rows += part.num_rows
        total[-1] = rows
        yield pa.RecordBatch.from_arrays([pa.array([*names, None]), pa.array(total)], ["word", "n"])

    return run


def word_weights(docs: DataFrame, spec: LicenceSpec = LicenceSpec()) -> dict[str, int]:
    """The weight of each word of the templates: 1 + floor(1000 ln((N + 1) / (n + 1))).

    N counts all rows of ``docs`` and n those that hold the word. What comes to the driver has the
    size of the templates' vocabulary.
    """
    names = vocabulary(spec)
    counts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_count(names), "word string, n long")
    seen = {r.word: r.n for r in counts.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    rows = seen.get(None, 0)
    return {w: 1 + int(np.floor(1000 * np.log((rows + 1) / (seen.get(w, 0) + 1)))) for w in names}


@dataclass
class _Template:
    label: str
    ids: np.ndarray
    weights: np.ndarray
    keys: list[np.ndarray]
    least: int  # in hundredths of the weight of all
    phrase: bool
    anchors: list[int] = field(default_factory=list)

    def rarest(self) -> list[int]:
        """Places of the rarest words, as many as no fit can lack; one word is enough for a phrase."""
        total, held, found = int(self.weights.sum()), 0, []
        for w in sorted(set(self.ids.tolist()), key=lambda w: (-self.weights[self.ids == w][0], w)):
            found += np.flatnonzero(self.ids == w).tolist()
            held += int(self.weights[self.ids == w].sum())
            if 100 * (total - held) < self.least * total:
                break
        return found[:1] if self.phrase else found


class _Index:
    """Templates, and the postings (template, place) of their rarest words."""

    def __init__(self, spec: LicenceSpec, weights: dict[str, int]) -> None:
        self.names = vocabulary(spec)
        number = {w: i for i, w in enumerate(self.names)}
        self.templates = []
        given = [(label, text, (), 100, True) for label, text in spec.phrases]
        given += [(label, text, keys, spec.percent, False) for label, text, keys in spec.templates]
        for label, text, keys, least, phrase in given:
            ids = np.array([number[w] for w in words_of(text)], dtype=np.int32)
            sizes = np.array([weights[w] for w in words_of(text)], dtype=np.int64)
            wanted = [np.array([number[w] for w in words_of(k)], dtype=np.int32) for k in keys]
            self.templates.append(_Template(label, ids, sizes, wanted, least, phrase))
        self.postings: dict[int, list[tuple[int, int]]] = {}
        for t, template in enumerate(self.templates):
            for place in template.rarest():
                self.postings.setdefault(int(template.ids[place]), []).append((t, place))

    def candidates(self, ids: np.ndarray, row: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Per template the places, and their rows, where one of its rarest words stands right.

        A place is the position that the template's first word would have, so it may lie outside
        the text that holds the rare word.
        """
        found: dict[int, list[np.ndarray]] = {}
        rare = np.flatnonzero(np.isin(ids, list(self.postings)))
        at = ids[rare]
        for word in np.unique(at).tolist():
            here = rare[at == word]
            for t, place in self.postings[word]:
                found.setdefault(t, []).append(np.stack([here - place, row[here]]))
        pairs = {t: np.unique(np.concatenate(each, axis=1), axis=1) for t, each in found.items()}
        return {t: (each[0], each[1]) for t, each in pairs.items()}

    def fits(
        self, t: int, places: np.ndarray, rows: np.ndarray, ids: np.ndarray, row: np.ndarray
    ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Row, place and share of the weight of the places that fit, in blocks."""
        template = self.templates[t]
        total = int(template.weights.sum())
        for block in np.array_split(np.arange(len(places)), 1 + len(places) * len(template.ids) // 1_000_000):
            at = places[block][:, None] + np.arange(len(template.ids))
            inside = np.clip(at, 0, len(ids) - 1)
            own = np.where((at == inside) & (row[inside] == rows[block][:, None]), ids[inside], -1)
            held = (own == template.ids) @ template.weights
            good = 100 * held >= template.least * total
            for key in template.keys:
                good &= _holds(own, key)
            yield rows[block][good], places[block][good], held[good] / total


def _holds(own: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether the words of ``key`` stand in a row of ``own`` one after the other."""
    shifts = own.shape[1] - len(key) + 1
    found = np.zeros(len(own), dtype=bool)
    for s in range(shifts):
        found |= (own[:, s : s + len(key)] == key).all(axis=1)
    return found


def _scan(spec: LicenceSpec, weights: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _Index(spec, weights)
        known = _spaced(index.names)
        for batch in batches:
            for part in slices(batch, "text"):
                words = split_runs(part.column("text"), ALNUM)
                ids, n = _word_ids(words, known), part.num_rows
                base: list[list[tuple[int, str]]] = [[] for _ in range(n)]
                labels: list[set[str]] = [set() for _ in range(n)]
                score = np.zeros(n)
                of = words.rows()
                for t, (places, rows) in index.candidates(ids, of).items():
                    template = index.templates[t]
                    for fitting in index.fits(t, places, rows, ids, of):
                        for row, place, share in zip(*(a.tolist() for a in fitting)):
                            labels[row].add(template.label)
                            score[row] = max(score[row], share)
                            if template.phrase:
                                base[row].append((place - int(words.first[row]), template.label))
                columns = [
                    part.column("doc_id"),
                    pa.array(np.diff(words.first), pa.int64()),
                    pa.array([len(b) for b in base], pa.int64()),
                    pa.array([min(b)[0] if b else None for b in base], pa.int64()),
                    pa.array([max(b)[0] if b else None for b in base], pa.int64()),
                    pa.array([",".join(sorted({label for _, label in b})) for b in base]),
                    pa.array([",".join(sorted(found)) for found in labels]),
                    pa.array(score),
                ]
                names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def find_licences(docs: DataFrame, spec: LicenceSpec = LicenceSpec()) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` per row of ``docs``.

    Needs ``doc_id`` and ``text``; other columns are ignored. ``n_base`` counts the places of the
    phrases, ``first_word`` and ``last_word`` are the smallest and largest of them (null without).
    ``labels`` has those of the phrases and of the templates that fit. ``score`` is the largest
    share of a template's weight among the fits, 1 with a phrase and 0 without a fit. Null and empty
    texts have no words; repeated rows are judged alike; an empty table gives no rows.
    """
    weights = word_weights(docs, spec)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = (
        "doc_id long, n_words long, n_base long, first_word long, last_word long,"
        " base_labels string, labels string, score double"
    )
    return docs.mapInArrow(_scan(spec, weights), schema)
