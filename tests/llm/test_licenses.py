"""License scans against brute force with regular expressions, on odd and empty tables."""

import random
import re

import pytest

from quillgrid.llm import licenses

KIND = "doc_id long, text string, lang string, n_words long, labels string"
TEMPLATES = [
    ("plain", "alpha beta gamma"),
    ("option", "alpha <<optional>>very <<optional>>much <</optional>><</optional>>delta"),
    ("variable", "<<optional>>the <</optional>>omega <<var words=0-3>> alpha"),
    ("least", "omega <<var words=2-4>> delta <<optional>><<var words=1-2>> end<</optional>>"),
    ("ends", "beta <<optional>>beta <</optional>>gamma <<optional>>alpha<</optional>>"),
]


def words(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def brute_force(text, templates, phrases):
    own = words(text)
    spans, labels, base = [], set(), []
    for at in range(len(own)):
        for phrase, label in phrases.items():
            p = phrase.split()
            if own[at : at + len(p)] == p:
                base.append((at, label))
                spans.append((at, at + len(p)))
        for label, template in templates:
            form = re.compile(licenses.pattern(licenses.parsed(template)))
            ends = [e for e in range(at + 1, len(own) + 1) if form.fullmatch(" ".join(own[at:e]) + " ")]
            if ends:
                labels.add(label)
                spans.append((at, max(ends)))
    covered = {i for a, e in spans for i in range(a, e)}
    names = {x for _, x in base}
    return len(own), len(base), min((a for a, _ in base), default=None), max((a for a, _ in base), default=None), ",".join(sorted(names)), ",".join(sorted(names | labels)), len(covered) / len(own) if own else 0.0


def texts():
    rnd = random.Random(9)
    some = ["alpha", "beta", "gamma", "delta", "omega", "very", "much", "the", "end", "other", "MIT", "License"]
    return [" ".join(rnd.choice(some) + rnd.choice(["", "", ",", ". "]) for _ in range(rnd.randrange(0, 25))) for _ in range(400)]


def test_small_templates_against_brute_force():
    automaton = licenses.Automaton(TEMPLATES, licenses.PHRASES)
    seen = set()
    for text in texts():
        got = licenses.scanned(text.encode(), automaton)
        assert got[:7] == brute_force(text, TEMPLATES, licenses.PHRASES), text
        seen.update(got[5].split(","))
    assert {label for label, _ in TEMPLATES} | {"mit"} <= seen


def test_states_that_are_made_anew_change_nothing(monkeypatch):
    monkeypatch.setattr(licenses, "KEPT_STEPS", 3)
    monkeypatch.setattr(licenses, "SLICE", 10)
    automaton = licenses.Automaton(TEMPLATES, licenses.PHRASES)
    for text in texts()[:150]:
        assert licenses.scanned(text.encode(), automaton)[:7] == brute_force(text, TEMPLATES, licenses.PHRASES)


MIT = (
    "Copyright (c) 2021 Jane Doe & Sons. All rights reserved.\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
    "and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
)


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        (MIT, "all-rights-reserved,mit-text"),
        (MIT.replace("free of charge", "for a fee"), "all-rights-reserved"),
        ("Released under the MIT License.", "mit,mit-notice"),
        ("Released under an MIT License.", "mit"),
        ("This work is licensed under the GNU General Public License, version 3.", "gpl,gpl-3.0"),
        ("licensed under the General Public License version 2", "gpl,gpl-2.0"),
        ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License", "apache,apache-2.0"),
        ("Licensed under CC BY-NC 4.0", "cc-by-nc"),
        ("Licensed under a Creative Commons CC BY-SA license 4.0", "cc-by-sa"),
        ("the committee licensed a general public park", ""),
    ],
)
def test_wordings(text, labels):
    assert licenses.scanned(text.encode(), licenses.Automaton(licenses.TEMPLATES, licenses.PHRASES))[5] == labels


def test_odd_and_empty_tables(spark):
    long_ = ("filler words 日本 " * 100_000) + "Released under the MIT License"
    rows = [(1, None), (2, ""), (3, "!?"), (4, long_), (5, "mit license mit license"), (5, "mit license mit license"), (None, "All rights reserved"), (6, "MIT\x00License"), (7, "mitlicense é")]
    got = {(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)) for r in licenses.scan(spark.createDataFrame([(i, t, "x", 7, "y") for i, t in rows], KIND)).collect()}
    assert got == {
        (1, 0, 0, None, None, "", "", 0.0), (2, 0, 0, None, None, "", "", 0.0), (3, 0, 0, None, None, "", "", 0.0), (4, 300_005, 1, 300_003, 300_003, "mit", "mit,mit-notice", round(5 / 300_005, 9)),
        (5, 4, 2, 0, 2, "mit", "mit", 1.0), (None, 3, 0, None, None, "", "all-rights-reserved", 1.0), (6, 2, 1, 0, 0, "mit", "mit", 1.0), (7, 2, 0, None, None, "", "", 0.0),
    }
    assert licenses.scan(spark.createDataFrame([], KIND)).count() == 0


def test_passages_are_told(spark):
    (r,) = licenses.scan(spark.createDataFrame([(1, "so: Released under the MIT License, all rights reserved", "x", 1, "y")], KIND)).collect()
    assert [(p.first_word, p.n_words, p.labels) for p in r.passages] == [(1, 5, ["mit-notice"]), (6, 3, ["all-rights-reserved"])]


@pytest.mark.parametrize("template", ["<<var words=1-2>> a", "<<optional>>a<</optional>> <<var words=1-2>> b", "<<optional>>a", "a<</optional>>", "a <<var words=3-2>>", "a <<strange>>", "<<optional>>a<</optional>>"])
def test_templates_that_are_none(template):
    with pytest.raises(ValueError):
        licenses.Automaton([("x", template)], {})
