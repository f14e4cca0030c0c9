"""Queries of the subpackage: every one over its whole table, nothing limited."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate as _decon
from . import divergence as _divergence
from . import langid as _langid
from . import mixing as _mixing
from . import near_dedup as _near
from . import sharding as _sharding
from . import token_counts as _tokens
from . import toxicity as _toxicity
from . import url_reputation as _urls
from . import warc as _warc
from .common import materialise, shared_dir, table


def op1_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _divergence.divergence(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens.token_counts(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decon.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near.near_duplicates(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows in shards, written and read back."""
    return _sharding.write_shards(table(spark, sf_dir, "documents"), shared_dir(spark, "shards"))


def op6_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _urls.judge_pages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixing.mix(table(spark, sf_dir, "documents"))


def op8_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as monolithic WARC files, normalised, and read back by offset."""
    return _warc.pages_through_warc(table(spark, sf_dir, "pages"), shared_dir(spark, "warc"), materialise=materialise)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _langid.identify(docs, _langid.train(docs))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxic documents, each with all its significant passages."""
    docs = table(spark, sf_dir, "documents")
    model = _toxicity.train(docs, table(spark, sf_dir, "labels"))
    return _toxicity.detect(docs, model).where("toxic")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_divergence": op1_divergence,
    "op2_token_counts": op2_token_counts,
    "op3_decontamination": op3_decontamination,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_sharding": op5_sharding,
    "op6_url_reputation": op6_url_reputation,
    "op7_mixing": op7_mixing,
    "op8_warc_normaliser": op8_warc_normaliser,
    "op9_language_id": op9_language_id,
    "op10_toxicity": op10_toxicity,
}

ORACLES: dict[str, str] = {
    "op1_divergence": _divergence.oracle(),
    "op6_url_reputation": _urls.ORACLE,
    "op7_mixing": _mixing.ORACLE,
    "op8_warc_normaliser": _warc.ORACLE,
}
