"""The queries of this subpackage and their SQL, for the entry module."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import exact_dedup as _exact
from corvane.llm import mixing as _mixing
from corvane.llm import oracle as _oracle
from corvane.llm import packing as _packing
from corvane.llm import secret_scan as _secrets
from corvane.llm import sentence_spans as _spans
from corvane.llm import simhash as _simhash
from corvane.llm import simhash_dedup as _near
from corvane.llm import token_counts as _tokens
from corvane.llm import toxicity as _toxicity
from corvane.llm import warc as _warc
from corvane.llm.common import Scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exact.exact_dedup(_table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packing.best_fit(_table(spark, sf_dir, "documents"))


def op4_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans.span_dedup(_table(spark, sf_dir, "documents"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _simhash.edit_fingerprints(_table(spark, sf_dir, "documents"), halves=True)
    rows = Scratch(spark, "fingerprints").table(rows, "rows")
    return _simhash.count_near(rows, F.col("doc_id") % 50 == 0).drop("f0", "f1")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixing.mix(_table(spark, sf_dir, "documents")).drop("source")


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near.simhash_dedup(_table(spark, sf_dir, "documents")).drop("component_size")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "warc").path("bundles")
    _warc.write_warc(_table(spark, sf_dir, "pages"), path)
    return _warc.read_warc(spark, path)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _secrets.scan(_table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens.token_counts(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_exact_dedup, op3_packing, op4_sentence_spans, op5_fingerprints, op6_mixing, op7_simhash_dedup, op8_warc, op9_secrets, op10_token_counts)}

ORACLE_SQL: dict[str, str] = dict(_oracle.ORACLE_SQL)
