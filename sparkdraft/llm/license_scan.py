"""Licence scans with a generalised suffix automaton over licence words.

The templates below go into one automaton.  A file's words run through it, which
gives the matching statistics: at each word the longest run of words ending there
that stands in some template.  Runs that cannot be made longer and are long enough
are placed in their templates and chained: a chain that covers most of a template
is a span.  Base phrases are templates too, and all places where their words stand
one after the other are reported, whatever chains exist.

The automaton depends on the templates alone.  A text is walked once; runs without
a word of any template are stepped over.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkdraft.llm.common import query, text_or_empty
from sparkdraft.session import importable


class Template(NamedTuple):
    label: str
    text: str


# Base phrases, and the usual notices of public licences.
BASE_PHRASES = (
    Template("mit", "under the mit license"),
    Template("apache-2", "apache license version 2"),
    Template("cc-by-nc", "cc by nc"),
)
TEMPLATES = (
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the Software), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so",
    ),
    Template(
        "apache-2",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at",
    ),
    Template("gpl-2", "licensed under the GNU General Public License, version 2"),
    Template("gpl-3", "licensed under the GNU General Public License, version 3"),
    Template(
        "gpl-3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
    ),
    Template(
        "gpl-2",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
        "option) any later version.",
    ),
    Template("lgpl-3", "licensed under the GNU Lesser General Public License, version 3"),
    Template("agpl-3", "licensed under the GNU Affero General Public License, version 3"),
    Template(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met",
    ),
    Template("bsd", "under the terms of the BSD license"),
    Template("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    Template("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    Template("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    Template("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    Template("unlicense", "This is free and unencumbered software released into the public domain"),
)

#: Words of a run that counts as a long match.
LONG = 4
#: Words between two runs of a chain, in the text and in the template.
GAP = 8
#: Part of a template that a chain must cover.
COVERED = 0.8

_SPACES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_in(text: str) -> list[bytes]:
    """Runs of digits, letters a-z (A-Z in lower case) and everything outside ASCII."""
    return text.encode("utf-8").translate(_SPACES).split()


class Span(NamedTuple):
    label: str
    first: int
    last: int
    coverage: float
    base: bool


class Automaton:
    """Generalised suffix automaton: all runs of words of all templates."""

    def __init__(self, templates: Iterable[Template], phrases: Iterable[Template], long: int, gap: int, covered: float):
        self.long, self.gap, self.covered = long, gap, covered
        self.labels, self.sizes, self.is_base = [], [], []
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        ends: dict[int, set[tuple[int, int]]] = defaultdict(set)
        bodies = []
        for base, group in ((True, phrases), (False, templates)):
            for template in group:
                words = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_in(template.text)]
                if not words:
                    continue
                bodies.append(words)
                self.labels.append(template.label)
                self.sizes.append(len(words))
                self.is_base.append(base)
                state = 0
                for word in words:
                    state = self._extend(state, word)
        for number, words in enumerate(bodies):
            state = 0
            for place, word in enumerate(words):
                state = self.next[state][word]
                ends[state].add((number, place))
        # Longer runs pass their places on to the runs they end in.
        for state in sorted(range(1, len(self.length)), key=lambda s: -self.length[s]):
            ends[self.link[state]] |= ends[state]
        self.places = [sorted(ends[s]) for s in range(len(self.length))]
        # Base phrases that end a state's run, the state's own one needs its whole length.
        self.phrases = [[n for n, place in self.places[s] if self.is_base[n] and place == self.sizes[n] - 1] for s in range(len(self.length))]
        self.ending: list[list[int]] = [[] for _ in self.length]
        for state in sorted(range(1, len(self.length)), key=lambda s: self.length[s]):
            above = self.length[self.link[state]]
            own = [n for n in self.phrases[state] if above < self.sizes[n] <= self.length[state]]
            self.ending[state] = self.ending[self.link[state]] + own
        self.shortest = min([long, *(n for n, b in zip(self.sizes, self.is_base) if b)])

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            known = self.next[last][word]
            if self.length[known] == self.length[last] + 1:
                return known
            return self._clone(last, known, word)
        state = len(self.length)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        at = last
        while at != -1 and word not in self.next[at]:
            self.next[at][word] = state
            at = self.link[at]
        if at != -1:
            known = self.next[at][word]
            exact = self.length[known] == self.length[at] + 1
            self.link[state] = known if exact else self._clone(at, known, word)
        return state

    def _clone(self, at: int, known: int, word: int) -> int:
        copy = len(self.length)
        self.next.append(dict(self.next[known]))
        self.length.append(self.length[at] + 1)
        self.link.append(self.link[known])
        self.link[known] = copy
        while at != -1 and self.next[at].get(word) == known:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def statistics(self, words: list[int]) -> list[tuple[int, int]]:
        """State and length of the longest run that ends at each word."""
        out, state, length = [], 0, 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state = self.next[state][word]
                length += 1
            else:
                state, length = 0, 0
            out.append((state, length))
        return out

    def scan(self, text: str) -> tuple[int, list[Span]]:
        """The number of words, and spans by their first word."""
        words = words_in(text)
        numbers = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        known = np.concatenate([[False], numbers >= 0, [False]])
        edges = np.flatnonzero(known[1:] != known[:-1])
        starts, stops = edges[::2], edges[1::2]
        enough = stops - starts >= self.shortest
        spans: list[Span] = []
        runs: list[tuple[int, int, int]] = []
        for start, stop in zip(starts[enough].tolist(), stops[enough].tolist()):
            found = self.statistics(numbers[start:stop].tolist())
            for i, (state, length) in enumerate(found):
                for n in self.ending[state]:
                    if self.sizes[n] <= length:
                        at = start + i
                        spans.append(Span(self.labels[n], at - self.sizes[n] + 1, at, 1.0, True))
                longer = i + 1 < len(found) and found[i + 1][1] > length
                if length >= self.long and not longer:
                    runs.append((start + i, state, length))
        spans += self._chains(runs)
        return len(words), sorted(spans, key=lambda s: (s.first, s.last, s.label, not s.base))

    def _chains(self, runs: list[tuple[int, int, int]]) -> list[Span]:
        """Long matches in text order, chained where template and text go on together."""
        done: list[list] = []
        open_: dict[int, list[list]] = defaultdict(list)
        for end, state, length in runs:
            start = end - length + 1
            for template, place in self.places[state]:
                if self.is_base[template]:
                    continue
                begin = place - length + 1
                best, joined = None, 0
                live = []
                for chain in open_[template]:
                    first, last, at, covered = chain
                    if start - last > self.gap + 1:
                        done.append([template, *chain])
                        continue
                    live.append(chain)
                    # Where the two overlap, the words count once.
                    overlap = max(0, last - start + 1, at - begin + 1)
                    if place > at and end > last and begin - at <= self.gap + 1 and overlap < length:
                        if covered + length - overlap > joined:
                            best, joined = chain, covered + length - overlap
                if best is None:
                    live.append([start, end, place, length])
                else:
                    best[1], best[2], best[3] = end, place, joined
                open_[template] = live
        done += [[template, *chain] for template, chains in open_.items() for chain in chains]
        best_spans: dict[tuple, Span] = {}
        for template, first, last, _, covered in done:
            part = min(1.0, covered / self.sizes[template])
            if part >= self.covered:
                key = (self.labels[template], first, last)
                if key not in best_spans or part > best_spans[key].coverage:
                    best_spans[key] = Span(self.labels[template], first, last, part, False)
        return list(best_spans.values())


_RESULT = "struct<n_words bigint, spans array<struct<label string, first bigint, last bigint, coverage double, base boolean>>>"


def scan_column(
    text: Column,
    templates: tuple[Template, ...] = TEMPLATES,
    phrases: tuple[Template, ...] = BASE_PHRASES,
    long: int = LONG,
    gap: int = GAP,
    covered: float = COVERED,
) -> Column:
    """``n_words`` and ``spans`` of whole texts; a null text counts as empty."""
    automaton = Automaton(templates, phrases, long, gap, covered)

    def run(texts: pd.Series) -> pd.DataFrame:
        found = [automaton.scan(t or "") for t in texts]
        return pd.DataFrame(
            {"n_words": [n for n, _ in found], "spans": [[s._asdict() for s in spans] for _, spans in found]}
        )

    return F.pandas_udf(run, _RESULT)(text)


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``doc_id, n_words, spans``, one row per input row, spans by first word.

    Null and repeated keys are kept as they are; other columns are not looked at.
    Spans may overlap, as licences quote each other.
    """
    importable(docs.sparkSession)
    rows = docs.select(F.col(key).alias("doc_id"), scan_column(text_or_empty(text), **options).alias("found"))
    return rows.select("doc_id", "found.n_words", "found.spans")


@query("op7_license_scan")
def op7(documents: DataFrame) -> DataFrame:
    """The contract's columns of every document, from the operator's spans."""
    base = F.filter("spans", lambda s: s["base"])

    def names(spans: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")

    return scan_licenses(documents).select(
        "doc_id",
        "n_words",
        F.size(base).cast("bigint").alias("n_base"),
        F.array_min(F.transform(base, lambda s: s["first"])).alias("first_word"),
        F.array_max(F.transform(base, lambda s: s["first"])).alias("last_word"),
        names(base).alias("base_labels"),
        names(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["coverage"])), F.lit(0.0)).alias("score"),
    )
