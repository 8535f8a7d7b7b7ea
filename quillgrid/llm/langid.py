"""Language identification with hyperdimensional profiles.

Method: every letter has a random +1/-1 vector.  A letter trigram is the
product (binding) of its letters' vectors, each permuted by its place; a text's
vector is the sum (bundle) of its trigrams' vectors, a language's prototype the
sum of the unit vectors of its training texts.  A text gets the language whose
prototype has the largest cosine with it; the score is that cosine, cut to 0..1.

Training takes a bounded sample: of each language about ``train_rows`` labelled
documents, chosen by a hash of the id, of the ``max_langs`` labels with most
documents.  Prediction covers every whole text and needs no shuffle: prototypes
are (languages x dim) numbers.

Defined cases: null text or no letter gives ``und`` with score 0; a text of any
length is counted the same way, slice by slice; rows with null lang or null id
are predicted but not learned from; if nothing can be learned, every text is
``und``; equal cosines go to the alphabetically first language; only doc_id,
text and lang are read, whatever other columns there are.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, remainder

UNKNOWN = "und"
DIM = 1024
SEED = 20_173
SYMBOLS = 4096
#: Code points of a text that are turned into symbols at a time.
SLICE = 1 << 20
#: Trigrams whose vectors are held at a time.
KEYS = 4096


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Symbol of every code point: 0 for all but letters; letters beyond the
    first 4,095 code points share symbols by remainder."""
    out = np.zeros(0x110000, np.int16)
    for cp in range(0x110000):
        if chr(cp).isalpha():
            out[cp] = cp % (SYMBOLS - 1) + 1
    return out


@lru_cache(maxsize=2)
def _vectors(dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letter vectors, permuted for each place of a trigram."""
    v = np.random.default_rng(SEED).integers(0, 2, (SYMBOLS, dim), dtype=np.int8) * 2 - 1
    return np.roll(v, 2, 1), np.roll(v, 1, 1), v


def _symbols(low: str):
    """The text's symbols slice by slice, runs of non-letters squeezed to one
    across slices, one blank before and after all."""
    last = 0
    yield np.zeros(1, np.int64)
    for at in range(0, len(low), SLICE):
        s = _letters()[np.frombuffer(low[at : at + SLICE].encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)
        s = s[(s != 0) | (np.concatenate(([last], s[:-1])) != 0)]
        if s.size:
            last = int(s[-1])
            yield s
    if last:
        yield np.zeros(1, np.int64)


def _trigrams(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    """Distinct trigrams of the whole text and how often each occurs; words are
    bounded by one blank symbol.  A slice begins with the two last symbols of
    the one before it, so that every trigram is counted once."""
    found: tuple[np.ndarray, np.ndarray] | None = None
    before = np.zeros(0, np.int64)
    for part in _symbols(text.lower()):
        s = np.concatenate((before, part))
        before = s[-2:]
        if s.size < 3:
            continue
        keys, n = np.unique(s[:-2] << 24 | s[1:-1] << 12 | s[2:], return_counts=True)
        if found is None:
            found = keys, n
        else:
            keys, where = np.unique(np.concatenate((found[0], keys)), return_inverse=True)
            found = keys, np.bincount(where, np.concatenate((found[1], n))).astype(np.int64)
    return found


def _encode(texts: list[str | None], dim: int) -> np.ndarray:
    """Unit vectors of the texts; zero where there is no letter.  Sums of +1/-1
    are whole numbers, so the order of blocks changes nothing."""
    out = np.zeros((len(texts), dim), np.float32)
    grams = [(i, g) for i, t in enumerate(texts) if t and (g := _trigrams(t))]
    a, b, c = _vectors(dim)
    for lo in range(0, len(grams), 128):
        some = grams[lo : lo + 128]
        keys = np.unique(np.concatenate([g[0] for _, g in some]))
        v = np.zeros((len(some), dim))
        at = [np.searchsorted(keys, k) for _, (k, _) in some]
        for first in range(0, len(keys), KEYS):
            own = keys[first : first + KEYS]
            bound = (a[own >> 24] * b[own >> 12 & 4095] * c[own & 4095]).astype(np.float32)
            counts = np.zeros((len(some), len(own)), np.float32)
            for row, (_, (_, n)) in enumerate(some):
                i, j = np.searchsorted(at[row], (first, first + len(own)))
                counts[row, at[row][i:j] - first] = n[i:j]
            v += counts @ bound
        out[[i for i, _ in some]] = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    return out


def train(labelled: DataFrame, train_rows: int = 5_000, dim: int = DIM, max_langs: int = 1_000) -> tuple[list[str], np.ndarray]:
    """Prototypes from (doc_id, text, lang): the languages and a (languages x dim) matrix.

    Each task returns one partial sum per language, so what reaches the driver
    is at most max_langs x dim numbers.
    """
    rows = labelled.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text", "lang")
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_langs)
    share = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1_000_003)) / F.lit(1_000_003.0)
    sample = rows.join(F.broadcast(counts), "lang").where(share * F.col("n") < train_rows).select("lang", "text")

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, v in zip(batch.column("lang").to_pylist(), _encode(batch.column("text").to_pylist(), dim)):
                sums[lang] = sums.get(lang, 0) + v.astype(np.float64)
        langs = sorted(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array([x for x in langs for _ in range(dim)], pa.string()), pa.array([j for _ in langs for j in range(dim)], pa.int32()), pa.array([float(y) for x in langs for y in sums[x]], pa.float64())],
            names=["lang", "j", "v"],
        )

    total = map_arrow(sample, run, "lang string, j int, v double").groupBy("lang", "j").agg(F.sum("v").alias("v"))
    rows_ = total.collect()
    langs = sorted({r["lang"] for r in rows_})
    place, m = {x: i for i, x in enumerate(langs)}, np.zeros((len(langs), dim))
    for r in rows_:
        m[place[r["lang"]], r["j"]] = r["v"]
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    keep = norm[:, 0] > 0
    # rounded: the order in which partial sums arrive must not change a prediction
    return [x for x, k in zip(langs, keep) if k], np.round(m[keep] / norm[keep], 9)


def predict(df: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text") -> DataFrame:
    """``df`` with ``lang_pred`` and ``score``."""
    langs, protos = model
    protos = protos.astype(np.float32)
    dim = protos.shape[1] if langs else DIM
    names = [f for f in df.columns if f not in ("lang_pred", "score")]

    def run(batches):
        for batch in batches:
            pred, score = [UNKNOWN] * batch.num_rows, [0.0] * batch.num_rows
            v = _encode(batch.column(text_col).to_pylist(), dim)
            if langs:
                cos = np.round((v @ protos.T).astype(np.float64), 5)
                best = cos.argmax(1)
                for i in np.flatnonzero(v.any(1)).tolist():
                    pred[i], score[i] = langs[best[i]], float(min(1.0, max(0.0, cos[i, best[i]])))
            own = [batch.column(batch.schema.names.index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*own, pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*names, "lang_pred", "score"])

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return map_arrow(df, run, ", ".join([*(f"`{n}` {kinds[n]}" for n in names), "lang_pred string", "score double"]))


def identify(documents: DataFrame, train_rows: int = 5_000) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; learned from the
    documents whose crc32(id) mod 4 is not 2."""
    held = remainder(F.col("doc_id"), 4) == 2
    model = train(documents.where(~held).select("doc_id", "text", "lang"), train_rows)
    out = predict(documents.select("doc_id", "text"), model)
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")
