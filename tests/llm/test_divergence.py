"""Source divergence audit against brute force, on odd and empty tables."""

import random
import re
from collections import Counter, defaultdict
from math import floor

import pytest

from quillgrid.llm import divergence

KIND = "doc_id long, text string, lang string, source string, n_chars long, term string, df long, bucket int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, 1, "x", 9, 3) for i, (t, lang, source) in enumerate(rows)], KIND)


def lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def brute_force(rows, least=3):
    docs = [(lang or "", source or "", Counter(re.findall(r"[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lower(text)))) for text, lang, source in rows]
    df, count, groups = Counter(), defaultdict(Counter), {(a, b) for a, b, _ in docs}
    for lang, source, terms in docs:
        for t, n in terms.items():
            df[lang, t] += 1
            count[lang, source][t] += n
    out = []
    for lang in {a for a, _ in groups}:
        kept = sorted(t for (a, t), n in df.items() if a == lang and n >= least)
        sources = sorted(s for a, s in groups if a == lang)

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}

        p = {s: shares(count[lang, s]) for s in sources}
        whole = shares(sum((count[lang, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) * (a - b) // b
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(p[s][t], whole[t]), t) for t in kept if count[lang, s][t] > 0 and p[s][t] > whole[t]]
            for part, told in (("pair", pairs), ("term", terms)):
                told.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(told, 1) if part == "pair" or k <= 200]
    return sorted(out)


def got(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r.rank) for r in df.collect())


def corpus(seed, n=160):
    rnd = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)] + ["Ünï", "漢字", "A1b", "UPPER", "upper", "x" * 5_000]
    out = [(" ".join(rnd.choice(words[: rnd.randrange(5, len(words))]) for _ in range(rnd.randrange(0, 40))), rnd.choice(["en", "en", "de", None, ""]), rnd.choice(["a", "a", "a", "b", "c", None])) for _ in range(n)]
    return out + [(None, "en", "silent"), ("", "en", "silent"), ("12 34 !", "no", "one"), (None, "no", "two"), ("zz zz", "fr", "only"), out[0], out[0], ("Tab\there\x00there", "en", "a")]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = corpus(seed)
    assert got(divergence.audit(frame(spark, rows).repartition(5))) == brute_force(rows)


def test_spills_buckets_and_blocks_change_nothing(spark, monkeypatch):
    rows = corpus(3)
    for name, value in (("HELD", 20), ("CELLS", 30), ("WIDER", 1), ("BLOCK", 2), ("ROWS", 7), ("SLICE", 11)):
        monkeypatch.setattr(divergence, name, value)
    assert got(divergence.audit(frame(spark, rows).repartition(7))) == brute_force(rows)


def test_hot_languages_beyond_broadcast(spark, monkeypatch):
    from quillgrid.functions import joins

    rows = corpus(4)
    monkeypatch.setattr(joins, "HOT_ROWS", 10)
    monkeypatch.setattr(divergence, "MAX_BROADCAST_KEYS", 0)
    assert got(divergence.audit(frame(spark, rows))) == brute_force(rows)


def test_ranks_end_at_two_hundred_with_ties_by_bytes(spark):
    words = [f"t{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{c}" for i in range(130) for c in ("", "é")]
    rows = [(" ".join(words), "en", "a")] * 3 + [("other words here", "en", "b")] * 3
    out = got(divergence.audit(frame(spark, rows)))
    assert out == brute_force(rows)
    assert sum(r[1:3] == ("a", "term") for r in out) == 200


def test_empty_and_termless_tables(spark):
    assert divergence.audit(frame(spark, corpus(5)).limit(0)).count() == 0
    rows = [(None, None, "a"), ("1 2 3", "", "b"), ("rare", "", None)]
    assert got(divergence.audit(frame(spark, rows))) == brute_force(rows)
    assert all(r[4] == 0 for r in brute_force(rows))


def test_shares_are_exact_for_large_counts():
    import numpy as np

    for count, total in ((0, 1), (10**15 - 1, 10**15), (123_456_789_012, 9_876_543_210_987), (7, 3 * 10**14)):
        assert int(divergence.shares(np.array([count]), total)[0]) == 1 + floor(10**9 * (count + 1) // total)
