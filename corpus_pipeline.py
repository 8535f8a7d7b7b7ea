"""Corpus pipeline over ``documents``: language ID, near-duplicate removal,
mixing to target weights, tokenising.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before
it kept.  All but the last return the columns of their input.

- ``language_id`` rejects documents in which no language can be recognised: those
  without a letter.  A low cosine rejects nothing: that of a clean text of one or
  two words lies within the noise of the vectors.
- ``near_dedup`` keeps one row, that of the smallest doc_id, of each group of
  documents whose sets of five-word shingles are similar to 0.8 or more; rows are
  told apart by id and text.  Candidates are linked by SimHash with anchor-point
  covering, as in ``op6_simhash``, and beyond its reach by samples of shingles.
- ``mix`` puts the rows into the order of the mixture; the files that are written
  from it hold the mixture from first to last.  No row is dropped or repeated.
- ``tokenise`` encodes and decodes every text.  Files that are read again come in
  no order, so it places its rows in the mixture anew, which depends on nothing but
  the rows, returns the place (slot, start_char), and orders the output by it.

Defined cases are those of the operators; null text has no letter and is
rejected by the first stage.
"""

import public_tokenizers

from quillgrid.llm import bytebpe, langid, mixing, simhash
from quillgrid.llm.common import dropped, table, written
from quillgrid.llm.registry import BLOCK_CHARS, OTHER_WEIGHT, WEIGHTS


def language_id(spark, docs, sf_dir):
    model = langid.train(docs)
    known = langid.predict(docs, model).where(f"lang_pred <> '{langid.UNKNOWN}'")
    return known.select(*docs.columns)


def near_dedup(spark, docs, sf_dir):
    return simhash.near_duplicates_removed(docs)


def mix(spark, docs, sf_dir):
    return mixing.in_mixed_order(docs, WEIGHTS, OTHER_WEIGHT, BLOCK_CHARS)


def tokenise(spark, docs, sf_dir):
    told = bytebpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    # written: range partitioning samples its input, which must not encode twice
    at = mixing.places(docs, WEIGHTS, OTHER_WEIGHT, BLOCK_CHARS)
    placed = written(mixing.with_places(written(told, "digests"), at), "placed")
    order = ["slot", "start_char", "doc_id"]
    return placed.repartitionByRange(*order).sortWithinPartitions(*order)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("mix", mix), ("tokenise", tokenise)]

#: No SQL: hyperdimensional vectors and byte pair merges are beyond it.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        if before is not None:  # the stage's result stands for it now
            dropped(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
