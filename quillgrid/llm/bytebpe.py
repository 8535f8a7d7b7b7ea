"""Byte-level BPE encoding and decoding over a given rank file.

Method: the pieces of a text (matches of the split pattern) are encoded in
length-bucketed, padded numpy matrices, one piece a row.  In every round each
row merges its leftmost pair of minimum rank; pairs are looked up in an
open-addressing hash table held in numpy arrays, finished rows are compacted
away and the matrix loses one column.

Pieces beyond ``LONG`` bytes (runs without a break) are cut into segments of
``SEGMENT`` bytes, which are rows like any other, and their ids are joined at
proven seams.  A seam between ids t and u holds if the bytes of t and u together
encode to just t, u.  If all seams of a sequence of ids hold, it is the encoding
of the whole: up to the first merge across a boundary, the whole's merges are
those of the ids taken alone, in the same order, so the pair at that boundary
would be merged in its two ids alone, too.  Where a seam does not hold, the ids
about it are encoded anew as one row, of twice as many ids each time, until its
edges hold; rows that come again (runs of one letter) are taken from a cache.

Spark partitions the texts; a task holds the vocabulary, one slice of an Arrow
batch and a bounded cache of encoded pieces, which it drops at its end.  Nothing
is shuffled.

Defined cases: null text encodes like the empty text (no ids); empty tables
give empty results; repeated rows are encoded alike; an input column named like
an output column is replaced by it.
"""

from __future__ import annotations

import base64
import hashlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_arrow

NONE = np.int32(2**31 - 1)
LONG = 256
SEGMENT = 64
#: Encoded pieces that a task keeps at most, and their characters.
CACHE_PIECES = 250_000
CACHE_CHARS = 4_000_000
#: Rows times bytes of a matrix.
CELLS = 1 << 19


class Tokens:
    """The bytes of each id."""

    def __init__(self, vocab_path: str):
        with open(vocab_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.ranks = ranks

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


class Codec(Tokens):
    """Vocabulary, pair table and cache of one Python worker."""

    def __init__(self, vocab_path: str, pattern: str):
        import regex

        super().__init__(vocab_path)
        ranks = self.ranks
        del self.ranks
        self.findall = regex.compile(pattern).findall
        self.base = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.n = np.int64(len(self.tokens))
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a * int(self.n) + b)
                    values.append(rank)
        self._fill(np.array(keys, np.int64), np.array(values, np.int32))
        self.forget()

    def forget(self) -> None:
        self.cache: dict[str, bytes] = {}
        self.cached_chars = 0
        self.rows: dict[bytes, tuple[int, ...]] = {}

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _fill(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(8, int(len(keys) * 4).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32)
        slot = self._slot(keys)
        while keys.size:
            free = np.flatnonzero(self.keys[slot] < 0)
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            left = np.ones(keys.size, bool)
            left[put] = False
            keys, values, slot = keys[left], values[left], (slot[left] + 1) & self.mask

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where it does not merge; ids below 0 are padding."""
        keys = a.astype(np.int64) * self.n + b
        keys[(a < 0) | (b < 0)] = -2
        flat = keys.ravel()
        slot, out = self._slot(flat), np.full(flat.size, NONE, np.int32)
        open_ = np.flatnonzero(flat >= 0)
        slot = slot[open_]
        while open_.size:
            there = self.keys[slot]
            hit = there == flat[open_]
            out[open_[hit]] = self.values[slot[hit]]
            go = ~hit & (there >= 0)
            open_, slot = open_[go], (slot[go] + 1) & self.mask
        return out.reshape(keys.shape)

    def _bucket(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Leftmost minimum-rank merge of every row, round by round."""
        ids = self.base[np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)]
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids[np.arange(width) >= size[:, None]] = -1
        out: list[bytes] = [b""] * len(pieces)
        at, rank = np.arange(len(pieces)), self.rank_of(ids[:, :-1], ids[:, 1:])
        while at.size:
            best = rank.argmin(1) if rank.shape[1] else np.zeros(at.size, np.int64)
            low = rank[np.arange(at.size), best] if rank.shape[1] else np.full(at.size, NONE)
            over = low == NONE
            if over.any():
                n = size[over]
                flat = ids[over][np.arange(ids.shape[1]) < n[:, None]].astype("<u4").tobytes()
                ends = (np.cumsum(n) * 4).tolist()
                for k, lo, hi in zip(at[over].tolist(), [0, *ends], ends):
                    out[k] = flat[lo:hi]
                ids, at, rank, best, low, size = (x[~over] for x in (ids, at, rank, best, low, size))
                if not at.size:
                    break
            ids[np.arange(at.size), best] = low
            cols = np.arange(ids.shape[1], dtype=np.int64)
            ids = ids[cols != (best + 1)[:, None]].reshape(at.size, -1)
            size = size - 1
            rank = rank[cols[:-1] != best[:, None]].reshape(at.size, -1)
            for j in (best - 1, best):
                ok = np.flatnonzero((j >= 0) & (j < rank.shape[1]))
                rank[ok, j[ok]] = self.rank_of(ids[ok, j[ok]], ids[ok, j[ok] + 1])
        return out

    def _rows(self, raw: list[bytes]) -> list[bytes]:
        """Packed ids of each row of bytes, by buckets of length."""
        buckets: dict[int, list[int]] = defaultdict(list)
        for i, p in enumerate(raw):
            buckets[len(p) if len(p) <= 1 else 1 << (len(p) - 1).bit_length()].append(i)
        out: list[bytes] = [b""] * len(raw)
        for width, own in buckets.items():
            step = max(1, CELLS // max(width, 1))
            for lo in range(0, len(own), step):
                some = own[lo : lo + step]
                for i, ids in zip(some, self._bucket([raw[i] for i in some], max(width, 1))):
                    out[i] = ids
        return out

    def _known(self, raw: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of rows that belong to long pieces, each encoded once."""
        new = [p for p in dict.fromkeys(raw) if p not in self.rows]
        self.rows.update((p, tuple(np.frombuffer(ids, "<u4").tolist())) for p, ids in zip(new, self._rows(new)))
        return [self.rows[p] for p in raw]

    def _holds(self, pairs: list[tuple[int, int]]) -> list[bool]:
        """Whether each two ids, side by side, stay what they are."""
        found = self._known([self.tokens[t] + self.tokens[u] for t, u in pairs])
        return [x == pair for x, pair in zip(found, pairs)]

    def _window(self, left, right, q: int) -> bytes:
        return b"".join(map(self.tokens.__getitem__, (*left[-q:], *right[:q])))

    def _long(self, piece: bytes) -> bytes:
        """A long piece by segments joined at proven seams."""
        self.rows.clear()
        segments = self._known([piece[i : i + SEGMENT] for i in range(0, len(piece), SEGMENT)])
        # what most seams need, encoded for all at once
        seams = list(zip(segments, segments[1:]))
        open_ = [s for s, ok in zip(seams, self._holds([(a[-1], b[0]) for a, b in seams])) if not ok]
        for q in (2, 4):
            mended = self._known([self._window(a, b, q) for a, b in open_])
            edges = [[*((a[-q - 1], w[0]) for _ in "." if len(a) > q), *((w[-1], b[q]) for _ in "." if len(b) > q)] for (a, b), w in zip(open_, mended)]
            holds = dict(zip(flat := [e for own in edges for e in own], self._holds(flat)))
            open_ = [s for s, own in zip(open_, edges) if not all(holds[e] for e in own)]
        out = list(segments[0])
        for segment in segments[1:]:
            if not self._holds([(out[-1], segment[0])])[0]:
                q = 2
                while True:
                    row = self._known([self._window(out, segment, q)])[0]
                    if (len(out) <= q or self._holds([(out[-q - 1], row[0])])[0]) and (len(segment) <= q or self._holds([(row[-1], segment[q])])[0]):
                        break
                    q *= 2
                del out[-q:]
                out += row
                segment = segment[q:]
            out += segment
        self.rows.clear()
        return np.array(out, "<u4").tobytes()

    def learn(self, pieces) -> dict[str, bytes]:
        """Packed ids of each of the pieces."""
        raw = {p: p.encode("utf-8", "surrogatepass") for p in pieces}
        short = [p for p, x in raw.items() if len(x) <= LONG]
        out = dict(zip(short, self._rows([raw[p] for p in short])))
        out.update((p, self._long(x)) for p, x in raw.items() if len(x) > LONG)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, packed as little-endian unsigned 32-bit integers."""
        split = [self.findall(t) for t in texts]
        new = set().union(*split)
        new.difference_update(self.cache)
        if new:
            if len(self.cache) + len(new) > CACHE_PIECES or self.cached_chars > CACHE_CHARS:
                self.forget()
                new = set().union(*split)
            self.cache.update(self.learn(new))
            self.cached_chars += sum(map(len, new))
        get = self.cache.__getitem__
        out = [b"".join(map(get, pieces)) for pieces in split]
        for p in new:
            if len(p) > LONG:  # not worth keeping
                self.cached_chars -= len(p)
                del self.cache[p]
        return out


@lru_cache(maxsize=1)
def codec(vocab_path: str, pattern: str) -> Codec:
    return Codec(vocab_path, pattern)


@lru_cache(maxsize=1)
def tokens(vocab_path: str) -> Tokens:
    return Tokens(vocab_path)


def _added(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    keep = [i for i, n in enumerate(batch.schema.names) if n != name]
    return pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), values], names=[*(batch.schema.names[i] for i in keep), name])


def _schema(df: DataFrame, name: str) -> T.StructType:
    return T.StructType([*(f for f in df.schema.fields if f.name != name), T.StructField(name, T.BinaryType())])


def encode(df: DataFrame, vocab_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``df`` with ``ids_col``: the token ids of the whole text, packed as
    little-endian unsigned 32-bit integers (the usual shard format)."""

    def run(batches):
        c = codec(vocab_path, pattern)
        for batch in batches:
            ids = c.encode([x.as_py() or "" for x in batch.column(text_col)])
            yield _added(batch, ids_col, pa.array(ids, pa.binary()))
        c.forget()

    return map_arrow(df, run, _schema(df, ids_col))


def decode(df: DataFrame, vocab_path: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """``df`` with ``bytes_col``: the bytes that the packed ids stand for."""

    def run(batches):
        t = tokens(vocab_path)
        for batch in batches:
            yield _added(batch, bytes_col, pa.array([t.decode(x.as_py() or b"") for x in batch.column(ids_col)], pa.binary()))

    return map_arrow(df, run, _schema(df, bytes_col))


def digests(documents: DataFrame, vocab_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text.

    Texts are encoded and their ids decoded in one pass of one worker a task.
    """

    def run(batches):
        c = codec(vocab_path, pattern)
        for batch in batches:
            ids = c.encode([x.as_py() or "" for x in batch.column("text")])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(c.decode(x)).hexdigest() for x in ids], pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )
        c.forget()

    kind = documents.schema["doc_id"].dataType.simpleString()
    return map_arrow(documents.select("doc_id", "text"), run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
