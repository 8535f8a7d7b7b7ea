"""License scans by template-markup matching.

Method: a template is a license's wording in words with two kinds of markup:
``<<optional>> ... <</optional>>`` regions, which may be left out and may nest,
and ``<<var words=A-B>>`` regions, which stand for A to B words of any kind.  All
templates are compiled into one token automaton whose states are made as texts
ask for them; a passage is accepted if every word outside of such regions is
there, in order and nothing else between.  Matching starts at each word that can
begin a template and covers whole texts; for each start the longest accepted
passage counts.

Besides, base phrases are found where their words stand consecutively.

Defined cases: null is an empty text; a text without words has n_words 0, no
labels and score 0; overlapping places of a phrase all count; words are runs of
digits, letters and characters beyond ASCII, of which only A-Z are lower-cased;
long texts are cut into words slice by slice and kept as two bytes a word.
Repeated rows are scanned one by one and other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
#: What stands between words, before letters are lower-cased.
GAP = re.compile(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]")
MARK = re.compile(r"<<(.*?)>>")
#: Bytes of a text that are cut into words at a time.
SLICE = 1 << 20
#: Transitions that a worker keeps before it starts anew.
KEPT_STEPS = 1_000_000

PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Wording of public licenses and notices.
TEMPLATES = [
    ("mit-notice", "released under the mit license"),
    ("mit-notice", "<<optional>>this <<var words=1-3>> is <</optional>>licensed under the <<optional>>terms of the <</optional>>mit license"),
    (
        "mit-text",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files <<optional>>the software <</optional>>"
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software "
        "and to permit persons to whom the software is furnished to do so subject to the following conditions <<optional>>the above copyright notice and this permission notice "
        "<<optional>>including the next paragraph <</optional>>shall be included in all copies or substantial portions of the software<</optional>>",
    ),
    ("apache-2.0", "licensed under the apache license <<optional>>version <</optional>>2 0 <<optional>>the license you may not use this <<var words=1-2>> except in compliance with the license<</optional>>"),
    ("gpl-2.0", "licensed under the <<optional>>terms of the <</optional>><<optional>>gnu <</optional>>general public license <<optional>>as published by the free software foundation either <</optional>>version 2"),
    ("gpl-3.0", "licensed under the <<optional>>terms of the <</optional>><<optional>>gnu <</optional>>general public license <<optional>>as published by the free software foundation either <</optional>>version 3"),
    (
        "gpl-notice",
        "this <<var words=1-3>> is free software you can redistribute it and or modify it under the terms of the gnu <<optional>>lesser <</optional>>general public license "
        "<<optional>>as published by the free software foundation either version <<var words=1-2>> of the license or at your option any later version<</optional>>",
    ),
    ("cc-by", "licensed under <<optional>>a <</optional>><<optional>>the <</optional>><<optional>>creative commons <</optional>>cc by <<optional>>license <</optional>>4 0"),
    ("cc-by-nc", "licensed under <<optional>>a <</optional>><<optional>>the <</optional>><<optional>>creative commons <</optional>>cc by nc <<optional>>license <</optional>>4 0"),
    ("cc-by-sa", "licensed under <<optional>>a <</optional>><<optional>>the <</optional>><<optional>>creative commons <</optional>>cc by sa <<optional>>license <</optional>>4 0"),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "<<optional>><<optional>>1 <</optional>>redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer <</optional>>"
        "<<optional>><<optional>>2 <</optional>>redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution<</optional>>",
    ),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license <<optional>>v <</optional>>2 0"),
    ("all-rights-reserved", "<<optional>>copyright <<optional>>c <</optional>><<var words=1-8>> <</optional>>all rights reserved"),
]


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The words of a whole text, slice by slice; a slice ends at a gap."""
    at = 0
    while at < len(text):
        gap = GAP.search(text, at + SLICE)
        end = gap.end() if gap else len(text)
        yield WORD.findall(text[at:end].lower())
        at = end


def parsed(template: str) -> list:
    """The template as a list of words (bytes), (least, most) and inner lists."""
    out: list[list] = [[]]
    for k, piece in enumerate(MARK.split(template)):
        if k % 2 == 0:
            out[-1].extend(WORD.findall(piece.lower().encode()))
        elif piece == "optional":
            out.append([])
        elif piece == "/optional":
            if len(out) == 1:
                raise ValueError(f"an optional region ends that did not begin: {template}")
            out[-2].append(out.pop())
        elif m := re.fullmatch(r"var words=(\d+)-(\d+)", piece):
            least, most = int(m[1]), int(m[2])
            if not 0 <= least <= most or not most:
                raise ValueError(f"{piece}: no words")
            out[-1].append((least, most))
        else:
            raise ValueError(f"unknown markup: {piece}")
    if len(out) > 1:
        raise ValueError(f"an optional region does not end: {template}")
    return out[0]


class Automaton:
    """All templates as one automaton over words.

    A position is the number of a place between two words of a template.  ``skip``
    has the positions that are reached without a word, ``step`` the word that
    leads on from a position (None: any) and where to.
    """

    def __init__(self, templates: list[tuple[str, str]], phrases: dict[str, str]):
        self.skip: list[list[int]] = []
        self.step: list[tuple[bytes | None, int] | None] = []
        self.ends: dict[int, str] = {}
        begins = []
        for label, text in templates:
            first = self._place()
            last = self._chain(parsed(text), first)
            self.ends[last] = label
            begins.append(first)
        self.first = self._closed(begins)
        if any(p in self.ends or self.step[p] and self.step[p][0] is None for p in self.first):
            raise ValueError("a template must begin with words of its own")
        used = sorted({s[0] for s in self.step if s and s[0] is not None} | {w for p in phrases for w in p.encode().split()})
        #: Number of each word that a template or phrase has; 0 is any other word.
        self.number = {w: i + 1 for i, w in enumerate(used)}
        self.phrases = {tuple(self.number[w] for w in p.encode().split()): label for p, label in phrases.items()}
        self.starts = np.zeros(len(used) + 1, bool)
        self.starts[[self.number[self.step[p][0]] for p in self.first if self.step[p]]] = True
        self._fresh()

    def _fresh(self) -> None:
        self.states: list[frozenset[int]] = [self.first]
        self.known = {self.first: 0}
        self.accepts: list[tuple[str, ...]] = [()]
        self.moves: dict[tuple[int, int], int] = {}

    def _place(self) -> int:
        self.skip.append([])
        self.step.append(None)
        return len(self.skip) - 1

    def _chain(self, parts: list, at: int) -> int:
        for part in parts:
            if isinstance(part, bytes):
                at = self._after(at, part)
            elif isinstance(part, tuple):
                ways = []
                for n in range(part[1]):
                    if n >= part[0]:
                        ways.append(at)
                    at = self._after(at, None)
                for way in ways:
                    self.skip[way].append(at)
            else:
                before, at = at, self._chain(part, self._joined(at))
                self.skip[before].append(at)
        return at

    def _joined(self, at: int) -> int:
        new = self._place()
        self.skip[at].append(new)
        return new

    def _after(self, at: int, word: bytes | None) -> int:
        """A new place that the word leads to from ``at``, which keeps its own way."""
        at = self._joined(at)
        new = self._place()
        self.step[at] = word, new
        return new

    def _closed(self, places) -> frozenset[int]:
        todo, found = list(places), set(places)
        while todo:
            for p in self.skip[todo.pop()]:
                if p not in found:
                    found.add(p)
                    todo.append(p)
        return frozenset(found)

    def _move(self, state: int, number: int) -> int:
        """The state after a word, -1 if no template goes on."""
        if len(self.moves) >= KEPT_STEPS:
            own = self.states[state]
            self._fresh()
            state = self._state(own)
        to = self._closed([s[1] for p in self.states[state] if (s := self.step[p]) and (s[0] is None or self.number[s[0]] == number)])
        self.moves[state, number] = new = self._state(to) if to else -1
        return new

    def _state(self, places: frozenset[int]) -> int:
        if places not in self.known:
            self.known[places] = len(self.states)
            self.states.append(places)
            self.accepts.append(tuple(sorted({self.ends[p] for p in places if p in self.ends})))
        return self.known[places]

    def found(self, ids: np.ndarray) -> list[tuple[int, int, set[str]]]:
        """(start, end, labels) for each start of an accepted passage; end is that
        of the longest, labels those of all that are accepted there."""
        out, n, words = [], len(ids), memoryview(np.ascontiguousarray(ids))
        for start in np.flatnonzero(self.starts[ids]).tolist():
            state, at, end, labels = 0, start, 0, set()
            while at < n:
                to = self.moves.get((state, words[at]))
                state = self._move(state, words[at]) if to is None else to
                if state < 0:
                    break
                at += 1
                if self.accepts[state]:
                    end = at
                    labels.update(self.accepts[state])
            if end:
                out.append((start, end, labels))
        return out

    def base(self, ids: np.ndarray) -> list[tuple[int, int, str]]:
        """(start, end, label) of each place of a phrase, in no order."""
        out = []
        for phrase, label in self.phrases.items():
            n = len(ids) - len(phrase) + 1
            if n > 0:
                here = ids[:n] == phrase[0]
                for k, w in enumerate(phrase[1:], 1):
                    here &= ids[k : k + n] == w
                out += [(i, i + len(phrase), label) for i in np.flatnonzero(here).tolist()]
        return out


def scanned(text: bytes, automaton: Automaton) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, passages."""
    get = automaton.number.get
    parts = [np.array([get(w, 0) for w in some], np.int16) for some in words_of(text)]
    ids = np.concatenate(parts) if parts else np.zeros(0, np.int16)
    base, found = automaton.base(ids), automaton.found(ids)
    starts = [b[0] for b in base]
    own = {b[2] for b in base}
    labels = own.union(*(f[2] for f in found))
    covered = upto = 0
    for start, end in sorted((x[0], x[1]) for x in (*base, *found)):
        covered += max(0, end - max(start, upto))
        upto = max(upto, end)
    passages = [{"first_word": a, "n_words": e - a, "labels": sorted(x)} for a, e, x in found]
    return len(ids), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)), ",".join(sorted(labels)), covered / len(ids) if len(ids) else 0.0, passages


KIND = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, passages array<struct<first_word: long, n_words: long, labels: array<string>>>"


def scan(documents: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """doc_id and what ``scanned`` says of every document's text.

    score is the share of the text's words that lie in a base phrase or in an
    accepted passage; passages has each accepted passage's start, length and
    labels.
    """
    rows = documents.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    passage = pa.list_(pa.struct([("first_word", pa.int64()), ("n_words", pa.int64()), ("labels", pa.list_(pa.string()))]))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), passage]
    names = ["doc_id", *(c.split()[0] for c in KIND.split(", ")[:7]), "passages"]

    def run(batches):
        automaton = Automaton(templates, phrases)
        for batch in batches:
            told = [scanned(t.as_py(), automaton) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([x[k] for x in told], kind) for k, kind in enumerate(kinds))], names=names)

    return map_arrow(rows, run, f"doc_id {dict(documents.dtypes)['doc_id']}, {KIND}")


def pattern(parts: list) -> str:
    """A template as a regular expression over words that each end in a blank."""
    out = ""
    for part in parts:
        out += part.decode() + " " if isinstance(part, bytes) else f"(?:[^ ]+ ){{{part[0]},{part[1]}}}" if isinstance(part, tuple) else f"(?:{pattern(part)})?"
    return out


def longest(parts: list) -> int:
    """Most words that a template can match."""
    return sum(1 if isinstance(p, bytes) else p[1] if isinstance(p, tuple) else longest(p) for p in parts)


def oracle(templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> str:
    """The digest columns in SQL: templates as regular expressions, tried at each
    word that can begin one, on as many words as the longest template has."""
    trees = [(label, parsed(text)) for label, text in templates]
    automaton = Automaton(templates, phrases)
    first = ", ".join(f"'{w.decode()}'" for w, i in automaton.number.items() if automaton.starts[i])
    most = max(longest(t) for _, t in trees)
    tried = ", ".join(f"('{label}', '^(?:{pattern(t)})')" for label, t in trees)
    wanted = ", ".join(f"('{p} ', {len(p.split())}, '{label}')" for p, label in phrases.items())
    return rf"""WITH d AS (SELECT row_number() OVER () AS i, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
w AS (SELECT i, unnest(ws) AS word, unnest(range(0, len(ws))) AS pos FROM d),
here AS MATERIALIZED (SELECT w.i, pos, array_to_string(ws[pos + 1 : pos + {most}], ' ') || ' ' AS upto FROM w JOIN d USING (i) WHERE word IN ({first}, {", ".join(repr(p.split()[0]) for p in phrases)})),
b AS (SELECT i, pos, pos + n AS stop, label FROM here, (VALUES {wanted}) p(phrase, n, label) WHERE starts_with(upto, phrase)),
f AS (SELECT i, pos, pos + len(m) - len(replace(m, ' ', '')) AS stop, label FROM (SELECT i, pos, label, regexp_extract(upto, form) AS m FROM here, (VALUES {tried}) t(label, form)) WHERE m <> ''),
spans AS (SELECT i, pos, stop FROM b UNION ALL SELECT i, pos, stop FROM f),
cover AS (SELECT i, count(DISTINCT p) AS n FROM (SELECT i, unnest(range(pos, stop)) AS p FROM spans) GROUP BY i),
bl AS (SELECT i, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b GROUP BY i),
al AS (SELECT i, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT i, label FROM b UNION SELECT i, label FROM f) GROUP BY i)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CASE WHEN len(ws) > 0 THEN coalesce(cover.n, 0)::DOUBLE / len(ws) ELSE 0 END AS score
FROM d LEFT JOIN bl USING (i) LEFT JOIN al USING (i) LEFT JOIN cover USING (i)"""
