"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import bpe, decontamination, fingerprints, html_extract, langid, merkle, mixing, negatives, ngram_join, quality, sharding, suffix_dedup, url_filters
from .common import tables


def op1_suffix_dedup(spark, sf_dir):
    return suffix_dedup.dedup_documents(tables(spark, sf_dir, "documents"))


def op2_decontamination(spark, sf_dir):
    return decontamination.score_documents(tables(spark, sf_dir, "documents"), tables(spark, sf_dir, "benchmark"))


def op3_sharding(spark, sf_dir):
    return sharding.shard_documents(tables(spark, sf_dir, "documents"))


def op4_ngram_join(spark, sf_dir):
    return ngram_join.near_components(tables(spark, sf_dir, "documents"))


def op5_html_extract(spark, sf_dir):
    return html_extract.extract_pages(tables(spark, sf_dir, "pages"))


def op6_url_filters(spark, sf_dir):
    return url_filters.judge_pages(tables(spark, sf_dir, "pages"))


def op7_quality(spark, sf_dir):
    return quality.score_documents(tables(spark, sf_dir, "documents"), tables(spark, sf_dir, "labels"))


def op8_language_id(spark, sf_dir):
    return langid.predict_documents(tables(spark, sf_dir, "documents"))


def op9_mixing(spark, sf_dir):
    return mixing.mix_documents(tables(spark, sf_dir, "documents"))


def op10_fingerprints(spark, sf_dir):
    return fingerprints.fingerprint_documents(tables(spark, sf_dir, "documents"))


def op11_merkle(spark, sf_dir):
    return merkle.verify_documents(tables(spark, sf_dir, "documents"))


def op12_hard_negatives(spark, sf_dir):
    return negatives.mine_embeddings(tables(spark, sf_dir, "embeddings"))


def op13_bpe(spark, sf_dir, path: str | None = None):
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.digest_documents(tables(spark, sf_dir, "documents"), path)


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_decontamination, op3_sharding, op4_ngram_join, op5_html_extract, op6_url_filters, op7_quality, op8_language_id, op9_mixing, op10_fingerprints, op11_merkle, op12_hard_negatives, op13_bpe)}
ORACLE = {
    "op2_decontamination": decontamination.ORACLE,
    "op3_sharding": sharding.ORACLE,
    "op6_url_filters": url_filters.ORACLE,
    "op9_mixing": mixing.ORACLE,
    "op10_fingerprints": fingerprints.ORACLE,
    "op11_merkle": merkle.ORACLE,
    "op12_hard_negatives": negatives.ORACLE,
}
