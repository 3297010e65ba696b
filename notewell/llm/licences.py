"""License scans with a generalised suffix automaton of licence template words.

The templates are whole licence texts (``licence_texts``) and short notices. They go to the tasks,
where each Python worker builds their automaton once (its size is bounded by the templates). Every
text is streamed through it: the matching statistics give, at each word, the longest run of words
ending there that stands in some template. Runs that can't grow and have at least ``min_match``
words are placed wherever their templates have them and chained in order, with at most ``max_gap``
words left out on either side; runs that overlap count the shared words once. A template is found
where a chain covers at least ``min_covered`` of it, and, wherever in it the passage stands, where
a chain of at least ``min_passage`` words covers that share of the passage from its first word to
its last. Of found spans that overlap the one that covers most words stays, so that what licences
have in common counts for the one that goes on; equal ones all stay.

Words that no template has only reset the automaton, so just runs of template words are walked.
One scan, no shuffle.

Defined results: null and empty texts have no words, places or labels and score 0; repeated rows
are scanned one by one; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from functools import lru_cache
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame

from notewell.llm.common import alnum_words, with_struct

# Phrases and labels that every scan reports, by consecutive words.
PHRASES = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)

# Short licence notices, by label.
NOTICES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("reserved", "All rights reserved"),
    ("apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("isc", "SPDX-License-Identifier: ISC"),
    ("mit", "Licensed under the MIT License"),
    ("isc", "Released under the ISC License"),
    ("isc", "Licensed under the ISC License"),
    ("bsd", "Released under the BSD License"),
    ("bsd", "Licensed under the BSD License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("lgpl-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License"),
    ("lgpl-3.0", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("lgpl", "GNU Lesser General Public License"),
    ("agpl-3.0", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("agpl-3.0", "if you modify the Program, your modified version must prominently offer all users interacting with it remotely through a computer network"),
    ("agpl", "GNU Affero General Public License"),
    ("epl", "Eclipse Public License"),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
)

# Whole licence texts, by label.
TEXTS = tuple((path.stem, path.read_text(encoding="utf-8")) for path in sorted((Path(__file__).parent / "licence_texts").glob("*.txt")))
TEMPLATES = NOTICES + TEXTS

MIN_MATCH = 3
MIN_COVERED = 0.8
MIN_PASSAGE = 30
MAX_GAP = 8

FOUND = (
    "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels array<string>, labels array<string>, score double, "
    "spans array<struct<label:string,template:bigint,doc_start:bigint,doc_end:bigint,covered:double>>"
)


class SuffixAutomaton:
    """Generalised suffix automaton of word-number sequences, with the ends of every state.

    The ends of a state are those of its prefixes and of all states below it in the tree of links,
    a range of ``ends`` in the order of that tree.
    """

    def __init__(self, sequences: list[list[int]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        held: dict[int, list[tuple[int, int]]] = {}
        for k, sequence in enumerate(sequences):
            last = 0
            for at, symbol in enumerate(sequence):
                last = self._extend(last, symbol)
                held.setdefault(last, []).append((k, at + 1))
        below: list[list[int]] = [[] for _ in self.next]
        for state in range(1, len(self.next)):
            below[self.link[state]].append(state)
        self.ends: list[tuple[int, int]] = []
        self.first, self.stop = [0] * len(self.next), [0] * len(self.next)
        waiting = [0]
        while waiting:
            state = waiting.pop()
            if state < 0:
                self.stop[~state] = len(self.ends)
                continue
            self.first[state] = len(self.ends)
            self.ends += held.get(state, ())
            waiting += [~state, *below[state]]

    def places(self, state: int) -> list[tuple[int, int]]:
        """(sequence, end) of every occurrence of the state's words, in order."""
        return sorted(self.ends[self.first[state] : self.stop[state]])

    def _state(self, length: int, link: int, arcs: dict[int, int]) -> int:
        self.next.append(arcs)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, parent: int, symbol: int) -> int:
        """The target of parent's arc, cloned if it stands for longer words too."""
        target = self.next[parent][symbol]
        if self.length[target] == self.length[parent] + 1:
            return target
        clone = self._state(self.length[parent] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = clone
        while parent >= 0 and self.next[parent].get(symbol) == target:
            self.next[parent][symbol] = clone
            parent = self.link[parent]
        return clone

    def _extend(self, last: int, symbol: int) -> int:
        if symbol in self.next[last]:
            return self._split(last, symbol)
        made = self._state(self.length[last] + 1, 0, {})
        while last >= 0 and symbol not in self.next[last]:
            self.next[last][symbol] = made
            last = self.link[last]
        if last >= 0:
            self.link[made] = self._split(last, symbol)
        return made

    def maximal_matches(self, symbols: list[int], least: int) -> list[tuple[int, int, int]]:
        """(end, length, state) of the matching statistics that the next symbol doesn't extend."""
        state = length = 0
        found = []
        for at, symbol in enumerate([*symbols, -1]):
            if symbol in self.next[state]:
                state, length = self.next[state][symbol], length + 1
                continue
            if length >= least:
                found.append((at, length, state))
            while state and symbol not in self.next[state]:
                state = self.link[state]
            length = self.length[state]
            if symbol in self.next[state]:
                state, length = self.next[state][symbol], length + 1
        return found


class TemplateIndex:
    def __init__(self, templates=TEMPLATES, phrases=PHRASES) -> None:
        self.numbers: dict[bytes, int] = {}
        number = lambda text: [self.numbers.setdefault(w, len(self.numbers) + 1) for w in alnum_words(text.encode())]
        rows = [number(text) for _, text in templates]
        self.labels, self.sizes = [label for label, _ in templates], [len(r) for r in rows]
        self.phrases = [(number(text), label) for text, label in phrases]
        self.automaton = SuffixAutomaton(rows)
        self.places = lru_cache(maxsize=4096)(self.automaton.places)

    def chains(self, matches: list[tuple[int, int, int]], max_gap: int) -> list[tuple[int, int, int, int, int]]:
        """(template, start, end, covered words, template words from first to last) of the best chains.

        ``open_`` has, for each template and each match that ends near enough, the chains that end
        with it by their end in the template: (end there, covered, start, begin there). A chain
        that another one goes on from isn't given itself.
        """
        open_: dict[int, list[tuple[int, list[list]]]] = {}
        done = []

        def close(template: int, groups: list[tuple[int, list[list]]]) -> None:
            done.extend((template, c[2], end, c[1], c[0] - c[3]) for end, chains in groups for c in chains if not c[4])

        for end, length, state in matches:
            start = end - length
            places: dict[int, list[int]] = {}
            for template, stop in self.places(state):
                places.setdefault(template, []).append(stop)
            for template, stops in places.items():
                groups = open_.get(template, [])
                near = [g for g in groups if g[0] >= start - max_gap]
                if len(near) < len(groups):
                    close(template, [g for g in groups if g[0] < start - max_gap])
                made = [[stop, length, start, stop - length, False] for stop in stops]
                for reach, chains in near:
                    shared = max(0, reach - start)
                    at, waiting = 0, []  # chains that can come before, most covered first
                    for new in made:
                        begin = new[0] - length + shared
                        while at < len(chains) and chains[at][0] <= begin:
                            while waiting and waiting[-1][1] <= chains[at][1]:
                                waiting.pop()
                            waiting.append(chains[at])
                            at += 1
                        # the most covered of those within the gap
                        while waiting and begin - waiting[0][0] > max_gap:
                            waiting.pop(0)
                        if waiting and shared < length and waiting[0][1] + length - shared > new[1]:
                            new[1:4] = waiting[0][1] + length - shared, waiting[0][2], waiting[0][3]
                            waiting[0][4] = True
                open_[template] = [*near, (end, made)]
        for template, groups in open_.items():
            close(template, groups)
        return done


@lru_cache(maxsize=4)
def _index(templates: tuple[tuple[str, str], ...]) -> TemplateIndex:
    return TemplateIndex(templates)


def _widest(spans: list[tuple]) -> list[tuple]:
    """Spans without those that overlap a span ahead of them by (covered words, share of the template).

    Spans of one label that are kept never overlap, so each label's are a sorted list, in which what
    a span overlaps is found by bisection.
    """
    kept: list[tuple] = []
    starts: dict[str, list[int]] = {}
    held: dict[str, list[tuple]] = {}

    def beaten(span: tuple) -> bool:
        for label, at in starts.items():
            j = bisect_left(at, span[3]) - 1
            while j >= 0 and held[label][j][3] > span[2]:
                if label == span[0] or held[label][j][4:] != span[4:]:
                    return True
                j -= 1
        return False

    for span in sorted(spans, key=lambda s: (-s[5], -s[4], s[2], s[0], s[1])):
        if not beaten(span):
            kept.append(span)
            at = bisect_left(starts.setdefault(span[0], []), span[2])
            starts[span[0]].insert(at, span[2])
            held.setdefault(span[0], []).insert(at, span)
    return kept


def _scan(index: TemplateIndex, texts: list[bytes | None], min_match: int, min_covered: float, max_gap: int, min_passage: int = MIN_PASSAGE) -> list[tuple]:
    get = index.numbers.get
    rows = []
    for text in texts:
        words = alnum_words(text)
        rows.append(np.fromiter((get(w, 0) for w in words), np.int64, len(words)))
    out = []
    for row in rows:
        places, base = [], set()
        for symbols, label in index.phrases:
            n = len(row) - len(symbols) + 1
            if n > 0 and (at := np.flatnonzero(np.logical_and.reduce([row[k : k + n] == s for k, s in enumerate(symbols)]))).size:
                places.append(at)
                base.add(label)
        at = np.concatenate(places) if places else np.empty(0, np.int64)
        spans = []
        known = np.flatnonzero(np.diff(np.concatenate(([0], (row > 0).astype(np.int8), [0]))))
        matches = [
            (end + start, length, state)
            for start, stop in zip(known[::2].tolist(), known[1::2].tolist(), strict=True)
            if stop - start >= min_match
            for end, length, state in index.automaton.maximal_matches(row[start:stop].tolist(), min_match)
        ]
        best = 0.0
        for template, start, end, covered, reached in index.chains(matches, max_gap):
            fraction, dense = covered / index.sizes[template], covered / reached
            passage = covered >= min_passage and dense >= min_covered
            best = max(best, fraction, dense if passage else 0.0)
            if passage or fraction >= min_covered:
                spans.append((index.labels[template], template, start, end, fraction, covered))
        spans = [s[:5] for s in _widest(spans)]
        spans.sort(key=lambda s: (s[2], s[3], s[0], s[1]))
        score = 1.0 if base else min(1.0, best)
        out.append((
            len(row), len(at), int(at.min()) if len(at) else None, int(at.max()) if len(at) else None,
            sorted(base), sorted(base | {s[0] for s in spans}), score, spans,
        ))
    return out


def license_spans(
    docs: DataFrame, name: str, templates=TEMPLATES, min_match: int = MIN_MATCH, min_covered: float = MIN_COVERED, max_gap: int = MAX_GAP, keep: list[str] | None = None, min_passage: int = MIN_PASSAGE
) -> DataFrame:
    """``docs`` with a struct column ``name``: phrase places, template spans, labels and score."""
    held = tuple(map(tuple, templates))
    return with_struct(docs, name, FOUND, lambda texts: _scan(_index(held), texts, min_match, min_covered, max_gap, min_passage), keep=keep)
