"""Licence scans with a generalised suffix automaton of licence tokens.

The automaton holds every run of words of the templates. Streaming a text through it gives
its matching statistics: at each word, the longest run ending there that some template
holds. Long matches are chained per template in the order of both text and template, and the
share of the template that a chain covers decides on its label.

A text is lower-cased (A-Z) and cut into words of letters, digits and non-ASCII characters.
Nulls: a null text is empty: no words, no labels, score 0. Rows are scanned one by one.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillstone.llm import common

#: Phrases and their labels (fixed values).
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Notices and opening clauses of public licences, by label.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software "
            "and associated documentation files to deal in the software without restriction"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the "
            "gnu general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted "
            "provided that the following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("reserved", "all rights reserved"),
)
MIN_MATCH = 3
MAX_GAP = 10
MIN_COVER = 0.6

_KEEP = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_KEEP).split()


class Automaton:
    """Suffix automaton over the word numbers of all templates (1 and up; 0 is any other word)."""

    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> None:
        self.labels = [label for label, _ in templates]
        tokens = [words_of(text.encode()) for _, text in templates]
        self.number = {w: i for i, w in enumerate(dict.fromkeys(w for words in tokens for w in words), 1)}
        self.sizes = [len(words) for words in tokens]
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[dict[int, int]] = [{}]  # template: place of the last word, at its first occurrence
        size = len(self.number) + 1
        self.pairs = np.zeros((size, size), bool)
        for k, words in enumerate(tokens):
            last, before = 0, 0
            for place, word in enumerate(words):
                number = self.number[word]
                if place:
                    self.pairs[before, number] = True
                last, before = self._add(last, number), number
                self.ends[last].setdefault(k, place)
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            for k, place in self.ends[state].items():
                up = self.ends[self.link[state]]
                up[k] = min(up.get(k, place), place)

    def _new(self, length: int, follow: dict[int, int], link: int) -> int:
        self.next.append(follow)
        self.length.append(length)
        self.link.append(link)
        self.ends.append({})
        return len(self.next) - 1

    def _split(self, p: int, q: int, number: int) -> int:
        clone = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(number) == q:
            self.next[p][number] = clone
            p = self.link[p]
        return clone

    def _add(self, last: int, number: int) -> int:
        if (q := self.next[last].get(number)) is not None:  # another template has this run already
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, number)
        new, p = self._new(self.length[last] + 1, {}, 0), last
        while p >= 0 and number not in self.next[p]:
            self.next[p][number] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][number]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, number)
        return new

    def statistics(self, numbers: list[int]) -> list[tuple[int, int]]:
        """(state, length) of the longest run of any template that ends at each word."""
        state = length = 0
        out = []
        for number in numbers:
            while state and number not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if number in self.next[state]:
                state, length = self.next[state][number], length + 1
            out.append((state, length))
        return out

    def matches(self, numbers: np.ndarray, min_match: int = MIN_MATCH) -> list[tuple[int, int, int, int]]:
        """Maximal matches (text place, template, template place, length) of a text.

        A match of three words or more holds two neighbouring pairs of some template, so the
        automaton runs only where such pairs follow one another.
        """
        good = np.flatnonzero(self.pairs[numbers[:-1], numbers[1:]])
        if len(good) < min_match - 1:
            return []
        out = []
        for run in np.split(good, np.flatnonzero(np.diff(good) != 1) + 1):
            if len(run) < min_match - 1:
                continue
            first, stop = int(run[0]), int(run[-1]) + 2
            seen = self.statistics(numbers[first:stop].tolist())
            for at, (state, length) in enumerate(seen):
                if length >= min_match and (at + 1 == len(seen) or seen[at + 1][1] <= length):
                    out += [(first + at - length + 1, k, place - length + 1, length) for k, place in self.ends[state].items()]
        return out

    def spans(self, numbers: np.ndarray, min_match: int = MIN_MATCH, max_gap: int = MAX_GAP) -> list[tuple[int, float, int, int]]:
        """(template, share covered, first word, last word) of the best chain of each template met.

        A chain takes matches whose places rise in text and template, ``max_gap`` words of text
        apart at most; words counted twice by overlapping matches count once.
        """
        by: dict[int, list[tuple[int, int, int]]] = {}
        for at, k, place, length in self.matches(numbers, min_match):
            by.setdefault(k, []).append((at, place, length))
        out = []
        for k, found in by.items():
            found.sort()
            best: list[tuple[int, int]] = []  # words covered, first word of the chain
            for i, (at, place, length) in enumerate(found):
                value, begin = length, at
                for j in range(i - 1, -1, -1):
                    at2, place2, length2 = found[j]
                    if at2 < at - max_gap - self.sizes[k]:  # a match is no longer than its template
                        break
                    overlap = max(0, at2 + length2 - at, place2 + length2 - place)
                    if at2 < at and place2 < place and at - at2 - length2 <= max_gap and overlap < length and best[j][0] + length - overlap > value:
                        value, begin = best[j][0] + length - overlap, best[j][1]
                best.append((value, begin))
            top = max(range(len(best)), key=lambda i: (best[i][0], -found[i][0]))
            out.append((k, best[top][0] / self.sizes[k], best[top][1], found[top][0] + found[top][2] - 1))
        return sorted(out)


def places(numbers: np.ndarray, phrase: list[int]) -> np.ndarray:
    """Where the words of a phrase stand one after another."""
    n = len(numbers) - len(phrase) + 1
    if n <= 0:
        return np.empty(0, np.int64)
    hit = numbers[:n] == phrase[0]
    for k, number in enumerate(phrase[1:], 1):
        hit &= numbers[k:n + k] == number
    return np.flatnonzero(hit)


SCHEMA = (
    "id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
    "labels string, score double, templates array<int>, covers array<double>, begins array<int>, ends array<int>"
)


def scan(df: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, min_cover: float = MIN_COVER,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Labels of every row with the covered spans of each template met.

    ``templates``, ``covers``, ``begins`` and ``ends`` list the template's place in
    ``templates``, the share covered and the first and last word of the span.
    """
    def work(batch: pa.RecordBatch) -> dict[str, object]:
        automaton = Automaton(templates)
        phrases = [([automaton.number.setdefault(w.encode(), len(automaton.number) + 1) for w in text.split()], label) for text, label in PHRASES]
        size = len(automaton.number) + 1
        pairs = np.zeros((size, size), bool)
        pairs[:automaton.pairs.shape[0], :automaton.pairs.shape[1]] = automaton.pairs
        automaton.pairs = pairs
        known = automaton.number.get
        rows = []
        for key, text in zip(batch.column("id").to_pylist(), common.texts_of(batch)):
            words = words_of(text)
            numbers = np.fromiter(map(known, words, repeat(0)), np.int64, len(words))
            found = [(label, at) for phrase, label in phrases if len(at := places(numbers, phrase))]
            base = sorted({label for label, _ in found})
            covered = automaton.spans(numbers)
            labels = sorted({*base, *(automaton.labels[k] for k, cover, _, _ in covered if cover >= min_cover)})
            rows.append((
                key, len(words), sum(len(at) for _, at in found),
                min((int(at[0]) for _, at in found), default=None), max((int(at[-1]) for _, at in found), default=None),
                ",".join(base), ",".join(labels), min(1.0, max((c for _, c, _, _ in covered), default=0.0)),
                [k for k, *_ in covered], [c for _, c, _, _ in covered], [a for *_, a, _ in covered], [b for *_, b in covered],
            ))
        return dict(zip((x.split()[0] for x in SCHEMA.split(", ")), map(list, zip(*rows))))

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return common.map_batches(rows, work, SCHEMA)


def labelled(df: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of documents."""
    return scan(df).select(
        F.col("id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
