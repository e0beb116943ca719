"""Licence scans: matching statistics of documents against a generalised suffix automaton of licence texts."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.llm.store import bound_batches
from tradewind.llm.words import ALNUM, LOWER, Powers, byte_values, documents, words

# The phrases that name a licence, and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Sentences by which the licences are recognised, and the label of each.
TEMPLATES = (
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
        "and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    ),
    (
        "apache",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on "
        "an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    ),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: Redistributions of source code must retain the above copyright notice, this "
        "list of conditions and the following disclaimer",
    ),
    (
        "mpl",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    ),
)


@dataclass
class Automaton:
    """Suffix automaton of several token sequences: every run of tokens of any of them is a path from state 0.

    ``of[v]`` lists the sequences that state v is a run of, with the place after the run's first occurrence.
    """

    next: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    of: list[dict[int, int]] = field(default_factory=lambda: [{}])

    def state(self, length: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        self.of.append({})
        return len(self.next) - 1

    def split(self, p: int, token: int, q: int) -> int:
        clone = self.state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def extend(self, last: int, token: int) -> int:
        q = self.next[last].get(token)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self.split(last, token, q)
        new, p = self.state(self.length[last] + 1, 0, {}), last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][token]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self.split(p, token, q)
        return new

    def add(self, number: int, tokens: list[int]) -> None:
        last = 0
        for t in tokens:
            last = self.extend(last, t)

    def mark(self, number: int, tokens: list[int]) -> None:
        """After all sequences were added: which states are runs of this one, and where they end in it."""
        v = 0
        for end, t in enumerate(tokens, 1):
            v = self.next[v][t]
            u = v
            while u > 0 and number not in self.of[u]:
                self.of[u][number] = end
                u = self.link[u]


class Scanner:
    """The automaton of phrases and templates, and how a stream of tokens is read with it."""

    def __init__(self, phrases, templates, min_match: int, gap: int):
        self.min_match, self.gap = min_match, gap
        self.labels = [label for _, label in phrases] + [label for label, _ in templates]
        texts = [p for p, _ in phrases] + [t for _, t in templates]
        powers, values = Powers(), byte_values()[LOWER]
        hashes = []
        for t in texts:
            raw = np.frombuffer(t.encode(), np.uint8)
            hashes.append(words(raw, np.array([0, len(raw)]), powers, ALNUM, values).hash)
        self.vocabulary = np.unique(np.concatenate(hashes))
        self.tokens = [np.searchsorted(self.vocabulary, h).tolist() for h in hashes]
        self.n_phrases = len(phrases)
        self.shortest = min([min_match, *map(len, self.tokens[: self.n_phrases])])
        self.automaton = Automaton()
        for k, t in enumerate(self.tokens):
            self.automaton.add(k, t)
        for k, t in enumerate(self.tokens):
            self.automaton.mark(k, t)
        # The phrases that are suffixes of a state's runs, as (phrase, its length); the longest run of the state may be
        # needed, which is why a scan compares lengths.
        self.ending = []
        where = []
        for k in range(self.n_phrases):
            v = 0
            for t in self.tokens[k]:
                v = self.automaton.next[v][t]
            where.append((v, k, len(self.tokens[k])))
        for v in range(len(self.automaton.next)):
            up, u = set(), v
            while u >= 0:
                up.add(u)
                u = self.automaton.link[u]
            self.ending.append([(k, n) for s, k, n in where if s in up])
        self.present = np.zeros(1 << 16, bool)
        self.present[(self.vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True

    def numbers(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words that licences have, and their token numbers."""
        at = np.flatnonzero(self.present[(h & np.uint64(0xFFFF)).astype(np.int64)])
        slot = np.minimum(np.searchsorted(self.vocabulary, h[at]), len(self.vocabulary) - 1)
        hit = self.vocabulary[slot] == h[at]
        return at[hit], slot[hit]

    def run(self, tokens: list[int], at: int, places: list, matches: list) -> None:
        """Streams one run of licence words, the first of them word ``at``. Adds places (word, phrase) and long matches
        (template, begin, end, end in the template) that can't be made longer to the right."""
        a, v, n = self.automaton, 0, 0
        for i, t in enumerate([*tokens, -1]):
            follow = a.next[v].get(t)
            if follow is None:
                if n >= self.min_match:
                    for k, end in a.of[v].items():
                        if k >= self.n_phrases:
                            matches.append((k - self.n_phrases, at + i - n, at + i, end))
                while v > 0 and follow is None:
                    v = a.link[v]
                    n = a.length[v]
                    follow = a.next[v].get(t)
                if follow is None:
                    n = 0
                    continue
            v, n = follow, n + 1
            for k, size in self.ending[v]:
                if size <= n:
                    places.append((at + i + 1 - size, k))

    def chain(self, matches: list) -> list[tuple[int, int, int, float]]:
        """Spans (template, begin, end, share of the template covered): matches of one template in its order, with at
        most ``gap`` foreign words between them."""
        spans, open_ = [], {}
        for k, begin, end, to in sorted(matches, key=lambda m: (m[1], m[2])):
            size = len(self.tokens[self.n_phrases + k])
            o = open_.get(k)
            if o and begin - o[1] <= self.gap and to > o[2]:
                new = min(end - max(begin, o[1]), to - o[2])
                if new > 0:
                    open_[k] = (o[0], max(end, o[1]), to, o[3] + new)
                continue
            if o:
                spans.append((k, o[0], o[1], o[3] / size))
            open_[k] = (begin, end, to, end - begin)
        spans += [(k, o[0], o[1], o[3] / len(self.tokens[self.n_phrases + k])) for k, o in open_.items()]
        return sorted(spans)


SCHEMA = "n_words bigint, places array<bigint>, phrases array<int>, spans array<struct<label:string,begin:bigint,end:bigint,covered:double>>"


def license_scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    phrases=PHRASES,
    templates=TEMPLATES,
    min_match: int = 6,
    gap: int = 12,
    share: float = 0.3,
) -> DataFrame:
    """One row per row of ``docs``: id, ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels``, ``score``, ``spans``.

    Words are lower-cased runs of ASCII letters, digits and all other than ASCII. They are streamed through the suffix
    automaton of all phrases and templates, which knows after each word the longest run of licence words that ends
    there. A phrase is found wherever such a run ends with it. Runs of ``min_match`` words or more that can't go on
    are matches; matches of one template are chained into a span over gaps of up to ``gap`` words. A span that
    covers ``share`` of its template adds the template's label. The score is the largest share covered, or 1 if a
    phrase was found. Only runs of licence words are streamed: nothing matches across another word.

    NULL texts have no words. Rows that share id and text get the same result; extra columns are ignored; an empty table
    gives an empty result.
    """
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("content"))
    bound_batches(docs.sparkSession)
    scanner_args = (tuple(phrases), tuple(templates), min_match, gap)

    def scan(batches):
        scanner, powers, values = Scanner(*scanner_args), Powers(), byte_values()[LOWER]
        for batch, data, offsets, i, j in documents(batches):
            w = words(data, offsets, powers, ALNUM, values)
            at, token = scanner.numbers(w.hash)
            doc = np.searchsorted(w.first, at, "right") - 1
            cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(doc) != 0)) + 1
            begins, ends = np.append(0, cut), np.append(cut, len(at))
            long = np.flatnonzero(ends - begins >= scanner.shortest) if len(at) else []
            found = {}
            for k in long:
                a, b = int(begins[k]), int(ends[k])
                places, matches = found.setdefault(int(doc[a]), ([], []))
                scanner.run(token[a:b].tolist(), int(at[a] - w.first[doc[a]]), places, matches)
            rows = []
            for d, n in enumerate(np.diff(w.first).tolist()):
                places, matches = found.get(d, ((), ()))
                spans = scanner.chain(matches) if matches else []
                rows.append(
                    (n, [p for p, _ in places], [k for _, k in places], [
                        {"label": scanner.labels[scanner.n_phrases + k], "begin": b, "end": e, "covered": min(1.0, c)} for k, b, e, c in spans
                    ])
                )
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.struct({"label": pa.string(), "begin": pa.int64(), "end": pa.int64(), "covered": pa.float64()}))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]],
                ["id", "n_words", "places", "phrases", "spans"],
            )

    found = base.mapInArrow(scan, f"id {base.schema['id'].dataType.simpleString()}, {SCHEMA}")
    names = F.array(*[F.lit(label) for _, label in phrases]).cast("array<string>")
    base_labels = F.array_sort(F.array_distinct(F.transform("phrases", lambda k: F.get(names, k))))
    covered = F.transform(F.filter("spans", lambda s: s["covered"] >= share), lambda s: s["label"])
    most = F.coalesce(F.array_max(F.transform("spans", lambda s: s["covered"])), F.lit(0.0))
    return found.select(
        F.col("id").alias(id_col),
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").alias("first_word"),
        F.array_max("places").alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, covered)), ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(most).alias("score"),
        "spans",
    )
