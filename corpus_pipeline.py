"""The corpus pipeline: five stages over documents, each written and read again.

language ID drops texts without a language of most of their words; SimHash keeps one document of
each group of near copies; decontamination drops documents that hold benchmark
items; PII rewrites texts; SentencePiece encodes, decodes and reports.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapwright.llm import decontam, langid, pieces, pii, simhash
from gapwright.llm.common import written

#: Rows of an Arrow batch while a stage is written: bounds what Python workers hold of whole texts.
BATCH_ROWS = 1000
#: The key of the registered run; a deployment sets its own.
PII_KEY = "corpus-pipeline"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every row whose Viterbi labels give one language to half of its lettered
    words or more; ``und`` (null, empty, no letters) and mixtures without one go."""
    found = langid.filter_known(docs, langid.train(docs))
    return found.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies: that of the smallest id
    (null ids last); of equal rows of that id, one."""
    return simhash.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows whose text holds a benchmark item in whatever order."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.clean(docs, benchmark)


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rewrites personal data in every text; no row goes."""
    return pii.pseudonymise(docs, PII_KEY)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a document: pieces of the best segmentation, digest of its ids,
    scores of the best three, and whether decoding gives the text back."""
    return pieces.digest(docs, pieces.load())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("pii_pseudonyms", pseudonymise),
    ("sentencepiece", encode),
]

#: No stage but the order of steps can be said in SQL; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to documents, writing what each but the last keeps."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name, BATCH_ROWS)
    return STAGES[-1][1](spark, docs, sf_dir)
