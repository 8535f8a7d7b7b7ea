"""Language-model scoring by subword lattice likelihood.

Method: the pieces of an existing vocabulary file are the symbols of a unigram
model.  A word is a lattice of all its segmentations into pieces; a forward
recursion in log space sums over them, so a text's probability is marginal, not
that of one segmentation.  A text's pieces never cross words, hence its log
probability is the sum over its words plus the end symbol.

The vocabulary is taken as it is; its scores give the piece probabilities that
``score`` is made of.  The file at hand scores pieces by rank (minus the place in
the order of merges), which is no log probability: p is taken as 1 / (10 + rank),
normalised.  With ``fitted`` there are two more scores, which learn from the
training texts.  ``fitted_score`` is by the probabilities that one step of
expectation maximisation over the counts of all training words, their segmentations
weighted by the vocabulary's scores, makes of these, smoothed by them.
``learned_score`` adds one arc to the lattice of a training word, the word as a
whole: a token is a word seen c times with (c - d) / (N + 1), N tokens in all, and
with what is left, (d V + 1) / (N + 1), spelt by the fitted lattice, whatever the
word.  The discount d follows from the words seen once and twice.  The words' and
the end's probabilities add up to 1 at most.

Spark's part: word counts of the whole corpus (counted in each task, summed by
key), expected piece counts per partition, a lattice score for every distinct
word, and the texts' sums.  The ``frequent`` most frequent words of at most
``WORD_BYTES`` bytes (a fixed bound of both) are broadcast with their scores; a
text's other words go by a join on the word, so no table that grows with the corpus
is broadcast or collected.  Words beyond ``LONG`` characters go through the recursion
window by window; what is kept of them is a few numbers a window.

Tokens: ASCII lower case, split at ASCII white space; each text has one end
token more.  Defined cases: null text is the empty text (one token); characters
outside the vocabulary are spelt in byte pieces; no training text gives the
vocabulary's own probabilities in all scores and a base score of log10(1/1) a token; rows with
equal id and text are scored once and returned as often as they occur; other
columns are not read.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_join, map_arrow, remainder, written

MARK = "▁"
#: Distinct words that a task counts before it passes them on.
HELD_WORDS = 400_000
#: Words of the table of counts that are scored together.
WORD_ROWS = 10_000
#: Longer words are not broadcast.
WORD_BYTES = 64
#: Characters of a word that goes by itself, and of a window of it.
LONG = 2_000
WINDOW = 1 << 14
LOG10 = np.log(10.0)
#: Columns of a word's or text's log probabilities: by the vocabulary, fitted, learned.
LOGS = ("lp", "lp2", "lp3")
BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: bytes | None) -> list[bytes]:
    """ASCII lower case, split at the bytes 32 and 9 to 13."""
    return (text or b"").lower().split()


class Vocabulary:
    """Pieces by hash, for lookups of many substrings at once."""

    def __init__(self, path: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        self.size = n + 1
        self.end = n
        rank = np.full(n, n, np.float64)
        self.byte = np.zeros(256, np.int64)
        pieces: dict[str, int] = {}
        for i in range(n):
            piece = m.id_to_piece(i)
            if m.is_byte(i):
                self.byte[int(piece[3:-1], 16)] = i
            elif not (m.is_control(i) or m.is_unknown(i)):
                pieces[piece] = i
                rank[i] = min(-m.get_score(i), n)
        prior = 1.0 / (10.0 + rank)
        self.prior = np.append(prior, prior.max())
        self.prior /= self.prior.sum()
        self.longest = max(map(len, pieces))
        keys = np.array([self._hash(p) for p in pieces], np.uint64)
        ids = np.fromiter(pieces.values(), np.int64, len(pieces))
        bits = 18
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.ids = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int64)
        for k, i in zip(keys, ids):
            slot = int(self._slot(np.array([k]))[0])
            while self.ids[slot] >= 0:
                slot = (slot + 1) & self.mask
            self.keys[slot], self.ids[slot] = k, i

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0xC2B2AE3D27D4EB4F)) >> self.shift).astype(np.int64)

    def _hash(self, piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(BASE) + ord(c) + 1) & (2**64 - 1)
        return h

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Piece of each hash, -1 where there is none."""
        out = np.full(keys.size, -1, np.int64)
        open_, slot = np.arange(keys.size), self._slot(keys)
        while open_.size:
            ids = self.ids[slot]
            hit = (ids >= 0) & (self.keys[slot] == keys[open_])
            out[open_[hit]] = ids[hit]
            go = ~hit & (ids >= 0)
            open_, slot = open_[go], (slot[go] + 1) & self.mask
        return out


@lru_cache(maxsize=1)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _lattices(v: Vocabulary, own: list[str]):
    """For words of one length L: for each piece length the ids (n x starts, -1:
    none), and the characters that must be spelt in bytes (row, start, ids)."""
    length = len(own[0])
    code = np.frombuffer("".join(own).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(own), length).astype(np.uint64) + np.uint64(1)
    table, spelt = [], []
    h = np.zeros((len(own), length), np.uint64)
    for size in range(1, min(length, v.longest) + 1):
        starts = length - size + 1
        h = h[:, :starts] * BASE + code[:, size - 1 :]
        ids = v.find(h.ravel()).reshape(h.shape)
        if size == 1:
            spelt = [(row, col, v.byte[list(own[row][col].encode("utf-8", "surrogatepass"))]) for row, col in zip(*np.nonzero(ids < 0))]
        table.append(ids)
    return table, spelt


def _weighted(lattices, logp: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The ids with their log probabilities."""
    table, spelt = lattices
    out = [(ids, np.where(ids >= 0, logp[ids], -np.inf)) for ids in table]
    for row, col, ids in spelt:
        out[0][1][row, col] = logp[ids].sum()
    return out


def _lse(parts: np.ndarray) -> np.ndarray:
    """log-sum-exp over the first axis."""
    top = parts.max(0)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(np.isfinite(top), top + np.log(np.exp(parts - np.where(np.isfinite(top), top, 0)).sum(0)), -np.inf)


def _forward(table, n: int, length: int) -> np.ndarray:
    a = np.full((length + 1, n), -np.inf)
    a[0] = 0
    for j in range(1, length + 1):
        a[j] = _lse(np.stack([a[j - s] + table[s - 1][1][:, j - s] for s in range(1, min(j, len(table)) + 1)]))
    return a


def _by_length(own: list[str], most: int = 20_000):
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(own):
        groups.setdefault(len(w), []).append(i)
    for length, at in sorted(groups.items()):
        step = max(1, min(most, 400_000 // length))
        for lo in range(0, len(at), step):
            yield length, at[lo : lo + step]


def word_logs(v: Vocabulary, logps: list[np.ndarray], own: list[str]) -> np.ndarray:
    """Natural logs of each marked word's marginal probability, by each of the
    piece probabilities."""
    out = np.zeros((len(logps), len(own)))
    for length, at in _by_length(own):
        if length > LONG:
            for i in at:
                out[:, i] = [LongWord(v, logp, own[i]).log for logp in logps]
            continue
        lattices = _lattices(v, [own[i] for i in at])
        for k, logp in enumerate(logps):
            out[k, at] = _forward(_weighted(lattices, logp), len(at), length)[length]
    return out


class LongWord:
    """The recursion over one long word, window by window.

    Pieces reach back ``longest`` places at most, so a window needs the values of so
    many places before it; these are kept for each window, and the windows are gone
    through again, from the last, for expected uses.
    """

    def __init__(self, v: Vocabulary, logp: np.ndarray, word: str):
        self.v, self.logp, self.word = v, logp, word
        self.before: list[list[float]] = []
        last = [-math.inf] * (v.longest - 1) + [0.0]
        for lo in range(0, len(word), WINDOW):
            self.before.append(last)
            last = self._forward(self._ending(lo), last)[-v.longest :]
        self.log = last[-1]

    def _ending(self, lo: int) -> list[list[tuple[int, float, object]]]:
        """(size, log probability, id or ids of bytes) of the pieces that end at
        each place of a window, the first one behind ``lo``."""
        hi, first = min(len(self.word), lo + WINDOW), max(0, lo - self.v.longest + 1)
        table, spelt = _lattices(self.v, [self.word[first:hi]])
        out: list[list] = [[] for _ in range(hi - lo)]
        for size, ids in enumerate(table, 1):
            for i in np.flatnonzero(ids[0] >= 0).tolist():
                if (end := first + i + size) > lo:
                    out[end - lo - 1].append((size, float(self.logp[ids[0, i]]), int(ids[0, i])))
        for _, i, ids in spelt:
            if first + i >= lo:
                out[first + i - lo].append((1, float(self.logp[ids].sum()), ids))
        return out

    def _forward(self, ending: list, last: list[float]) -> list[float]:
        """The values of the places before the window and of its own."""
        a = list(last)
        for own in ending:
            a.append(_log_sum([a[-size] + lp for size, lp, _ in own]))
        return a

    def expected(self, count: float, out: np.ndarray) -> None:
        """Adds the expected uses of each piece, ``count`` times, to ``out``."""
        back = self.v.longest
        after = [-math.inf] * (back - 1) + [0.0]
        for k in range(len(self.before) - 1, -1, -1):
            ending = self._ending(k * WINDOW)
            a = self._forward(ending, self.before[k])
            b = [-math.inf] * len(ending) + after
            for x in range(len(ending) - 1, -1, -1):
                own = b[x + back]
                for size, lp, ids in ending[x]:
                    i = x + back - size
                    b[i] = _log_sum([b[i], lp + own])
                    uses = math.exp(a[i] + lp + own - self.log) * count
                    if isinstance(ids, int):
                        out[ids] += uses
                    else:
                        np.add.at(out, ids, uses)
            after = b[:back]


def _log_sum(terms: list[float]) -> float:
    top = max(terms, default=-math.inf)
    return top if top == -math.inf else top + math.log(sum(math.exp(t - top) for t in terms))


def expected(v: Vocabulary, logp: np.ndarray, own: list[str], counts: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in the words, over all segmentations."""
    out = np.zeros(v.size)
    for length, at in _by_length(own):
        if length > LONG:
            for i in at:
                LongWord(v, logp, own[i]).expected(float(counts[i]), out)
            continue
        some, c = [own[i] for i in at], counts[at]
        lattices = _lattices(v, some)
        table = _weighted(lattices, logp)
        a = _forward(table, len(some), length)
        b = np.full((length + 1, len(some)), -np.inf)
        b[length] = 0
        for j in range(length - 1, -1, -1):
            b[j] = _lse(np.stack([b[j + s] + table[s - 1][1][:, j] for s in range(1, min(length - j, len(table)) + 1)]))
        for size, (ids, lp) in enumerate(table, 1):
            post = np.exp(a[: length - size + 1].T + lp + b[size:].T - a[length][:, None]) * c[:, None]
            known = ids >= 0
            out += np.bincount(ids[known], post[known], v.size)
            if size == 1:
                for row, col, spelt in lattices[1]:
                    np.add.at(out, spelt, post[row, col])
    return out


def _marked(column) -> list[str]:
    return [MARK + w.decode("utf-8", "replace") for w in column.to_pylist()]


def word_counts(documents: DataFrame) -> DataFrame:
    """(word, c): every word of the table, as bytes, with its count in training
    texts (0 if it is in held-out texts only).  documents: text as bytes, held."""

    def told(counts: Counter):
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(counts.values(), pa.int64())], names=["word", "c"])

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for text, held in zip(batch.column("text"), batch.column("held")):
                if held.as_py():
                    for w in words(text.as_py()):
                        counts.setdefault(w, 0)
                else:
                    counts.update(words(text.as_py()))
                if len(counts) > HELD_WORDS:
                    yield told(counts)
                    counts = Counter()
        yield told(counts)

    return map_arrow(documents.select("text", "held"), run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def own_logs(vocab_path: str) -> np.ndarray:
    """Natural-log piece probabilities by the vocabulary's scores alone."""
    return np.log(vocabulary(vocab_path).prior)


def train(counted: DataFrame, ends: int, vocab_path: str) -> np.ndarray:
    """Natural-log piece probabilities after one expectation step over all words
    with c > 0; what reaches the driver is one number per piece."""

    def run(batches):
        v = vocabulary(vocab_path)
        total = np.zeros(v.size)
        for b in batches:
            total += expected(v, np.log(v.prior), _marked(b.column("word")), b.column("c").to_numpy(zero_copy_only=False).astype(np.float64))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.float64())], names=["piece", "n"])

    v = vocabulary(vocab_path)
    n = np.zeros(v.size)
    for r in map_arrow(counted.where("c > 0"), run, "piece int, n double", WORD_ROWS).groupBy("piece").agg(F.sum("n").alias("n")).collect():
        n[r["piece"]] = round(r["n"], 6)  # rounded: sums arrive in any order
    n[v.end] += ends
    n += v.prior * max(1.0, n.sum() * 1e-4)  # smoothed by the vocabulary's own probabilities
    return np.log(n / n.sum())


def learned(counts: np.ndarray, lp: np.ndarray, tokens: int, kinds: int, discount: float) -> np.ndarray:
    """log10 of the probability of words seen so often, spelt with 10**lp, among so
    many training tokens of so many kinds."""
    with np.errstate(divide="ignore"):  # no arc of its own for a word that was not seen
        whole = np.log(np.maximum(counts - discount, 0))
    return (np.logaddexp(whole, np.log(discount * kinds + 1) + lp * LOG10) - np.log(tokens + 1)) / LOG10


def with_logs(counted: DataFrame, logps: list[np.ndarray], vocab_path: str, seen: tuple[int, int, float]) -> DataFrame:
    """(word, c, lp, lp2, lp3): log10 of each word's marginal probability by one or two
    kinds of piece probabilities, and learned from the second (``seen``: tokens, kinds
    and discount); lp2 and lp3 are 0 where there is one."""

    def run(batches):
        v = vocabulary(vocab_path)
        for b in batches:
            logs = word_logs(v, logps, _marked(b.column("word"))) / LOG10
            more = [logs[1], learned(b.column("c").to_numpy(zero_copy_only=False), logs[1], *seen)] if len(logs) > 1 else [np.zeros(b.num_rows)] * 2
            yield pa.RecordBatch.from_arrays([b.column("word"), b.column("c"), *map(pa.array, (logs[0], *more))], names=["word", "c", *LOGS])

    return map_arrow(counted, run, "word binary, c long, lp double, lp2 double, lp3 double", WORD_ROWS)


def score(documents: DataFrame, vocab_path: str, frequent: int = 300_000, fitted: bool = False) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and, with
    ``fitted``, fitted_score and learned_score."""
    spark = documents.sparkSession
    held = remainder(F.col("doc_id"), 5) == 1
    docs = documents.select("doc_id", F.col("text").cast("binary").alias("text"), held.alias("held"))
    counted = written(word_counts(docs), "word-counts")
    ends = docs.where(~F.col("held")).select("doc_id").count()
    total = counted.agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v"), *(F.count_if(F.col("c") == k).alias(f"n{k}") for k in (1, 2))).first()
    n = (total["n"] or 0) + ends
    kinds = total["v"] + (1 if ends else 0)
    denominator = float(np.log10(n + 0.5 * (kinds + 1)))
    seen = (n, kinds, total["n1"] / max(1, total["n1"] + 2 * total["n2"]))
    logps = [own_logs(vocab_path), *([train(counted, ends, vocab_path)] if fitted else [])]
    known = written(with_logs(counted, logps, vocab_path, seen), "word-scores")
    top = known.where(F.octet_length("word") <= WORD_BYTES).orderBy(F.desc("c"), "word").limit(frequent).toArrow()
    bound = spark.sparkContext.broadcast((uuid.uuid4().hex, dict(zip(top.column("word").to_pylist(), zip(*(top.column(c).to_pylist() for c in ("c", *LOGS)))))))
    spelt = [float(logps[min(k, len(logps) - 1)][-1] / LOG10) for k in (0, 1)]
    end = [float(np.log10(ends + 0.5)), *spelt, float(learned(np.array([ends]), np.array(spelt[1:]), *seen)[0])]

    def run(batches):
        import xxhash

        table = _ready(bound)
        for batch in batches:
            cols: list[list] = [[] for _ in range(8)]
            for value in batch.column("text"):
                text = value.as_py()
                own = Counter(words(text))
                logs, known_, rare = [[x] for x in end], int(ends > 0), []
                for w, tf in own.items():
                    hit = table.get(w)
                    if hit is None:
                        rare.append({"word": w, "tf": tf})
                    else:
                        for x, lp in zip(logs, hit[1:]):
                            x.append(tf * lp)
                        known_ += tf * hit[0]
                for c, x in zip(cols, (xxhash.xxh3_64_intdigest(text or b"") - (1 << 63), own.total() + 1, known_, *(float(np.sum(x)) for x in logs), rare)):
                    c.append(x)
            types = (*[pa.int64()] * 3, *[pa.float64()] * 4, pa.list_(pa.struct([("word", pa.binary()), ("tf", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held"), *(pa.array(c, k) for c, k in zip(cols, types))], names=["doc_id", "held", "h", "n", "known", "base", *LOGS, "rare"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    first = written(map_arrow(docs, run, f"doc_id {kind}, held boolean, h long, n long, known long, base double, lp double, lp2 double, lp3 double, rare array<struct<word:binary,tf:long>>"), "first-sums")
    rest = first.select("doc_id", "held", "h", F.explode("rare").alias("r")).select("doc_id", "held", "h", "r.word", "r.tf")
    # a long word may be in very many texts; its training count tells
    rest = hot_join(rest, known.withColumn("copies", F.col("c")), "word", F.col("h"))
    rest = rest.select("doc_id", "held", "h", F.lit(0).cast("long").alias("m"), F.lit(0).cast("long").alias("n"), F.expr("IF(c > 0, tf, 0L)").alias("known"), (F.col("tf") * F.log10(F.col("c") + 0.5)).alias("base"), *((F.col("tf") * F.col(c)).alias(c) for c in LOGS))
    both = first.select("doc_id", "held", "h", F.lit(1).cast("long").alias("m"), "n", "known", "base", *LOGS).unionByName(rest)
    sums = both.groupBy("doc_id", "held", "h").agg(*(F.sum(c).alias(c) for c in ("m", "n", "known", "base", *LOGS)))
    each = sums.select("doc_id", "held", *((F.col(c) / F.col("m")).alias(c) for c in ("n", "known", "base", *LOGS)), F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))))
    return each.select(
        "doc_id",
        F.col("held").alias("held_out"),
        F.col("n").cast("long").alias("n_tokens"),
        F.col("known").cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") - F.round("n") * F.lit(denominator)).alias("base_score"),
        F.col("lp").alias("score"),
        *([F.col("lp2").alias("fitted_score"), F.col("lp3").alias("learned_score")] if fitted else []),
    )


_tables: dict[str, dict] = {}


def _ready(bound) -> dict:
    """The broadcast words with (known, log10(c + 0.5), lp, lp2, lp3), made once a worker
    and broadcast; the key goes with the value, as workers serve many queries."""
    key, rows = bound.value
    if key not in _tables:
        _tables.clear()
        logs = np.log10(np.array([r[0] for r in rows.values()], np.float64) + 0.5).tolist()
        _tables[key] = {w: (int(n > 0), b, *lps) for (w, (n, *lps)), b in zip(rows.items(), logs)}
    return _tables[key]
