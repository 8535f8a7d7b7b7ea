"""Queries of the training-data operators, and their SQL where SQL has it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import bytebpe, centroids, divergence, html_text, isomedia, langid, latticelm, licenses, mixing, simhash, syncmers, urltree, warc
from .common import table

#: Target weights of the mixture; sources that are not listed share the rest.
WEIGHTS = {"src0": 15} | {f"src{i}": 4 for i in range(1, 20)}
OTHER_WEIGHT = 9
BLOCK_CHARS = 65_536
RULES: list[urltree.Rule] = [("block", "net", ""), ("allow", "example.net", "en/"), ("block", "example.com", "de/"), ("allow", "org", "fr/")]
#: A page's label: that of the document whose id its path names (1: low quality or toxic).
LABELLED_SQL = """
SELECT page_id, url, bad FROM pages LEFT JOIN (
  SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id) ON doc_id = TRY_CAST(regexp_extract(url, '/[a-z]+/([0-9]+)', 1) AS BIGINT)
"""


def vocabulary(name: str) -> str:
    return public_tokenizers.path(name)


def op1_html_text(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages").select("page_id", "html"))


def op2_mix_sources(spark, sf_dir):
    return mixing.mixed(table(spark, sf_dir, "documents"), WEIGHTS, OTHER_WEIGHT, BLOCK_CHARS)


def op3_langid(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"))


def op4_syncmers(spark, sf_dir):
    return syncmers.fingerprints(table(spark, sf_dir, "documents"))


def op5_iso_media(spark, sf_dir):
    return isomedia.digests(table(spark, sf_dir, "documents"))


def op6_simhash(spark, sf_dir):
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark, sf_dir):
    return bytebpe.digests(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_url_filter(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("bad"))
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.expr("try_cast(regexp_extract(url, '/[a-z]+/([0-9]+)', 1) AS BIGINT)").alias("doc_id"))
    # pages that name no document would be one key of the join
    named = pages.where("doc_id IS NOT NULL").join(labels, "doc_id", "left").select("page_id", "url", "bad")
    other = pages.where("doc_id IS NULL").select("page_id", "url", F.lit(None).cast("int").alias("bad"))
    return urltree.judge(named.unionByName(other), RULES, ["page_id"])


def op9_warc(spark, sf_dir):
    return warc.read(warc.write(table(spark, sf_dir, "pages")))


def op10_lattice_lm(spark, sf_dir):
    scored = latticelm.score(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), fitted=True)
    own, learned = F.col("score").alias("vocabulary_score"), F.col("learned_score").alias("score")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", learned, "fitted_score", own)


def op11_divergence(spark, sf_dir):
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_licenses(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents")).drop("passages")


def op13_centroids(spark, sf_dir):
    return centroids.clusters(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_html_text, op2_mix_sources, op3_langid, op4_syncmers, op5_iso_media, op6_simhash, op7_byte_bpe, op8_url_filter, op9_warc, op10_lattice_lm, op11_divergence, op12_licenses, op13_centroids)}
ORACLES = {
    "op2_mix_sources": mixing.oracle(WEIGHTS, OTHER_WEIGHT, BLOCK_CHARS),
    "op8_url_filter": urltree.oracle(RULES, LABELLED_SQL),
    "op9_warc": warc.oracle(),
    "op11_divergence": divergence.oracle(),
    "op12_licenses": licenses.oracle(),
    "op13_centroids": centroids.oracle(),
}
