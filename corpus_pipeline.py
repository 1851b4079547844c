"""A training corpus from raw documents: toxic ones go, near copies go, secrets are masked, sources are mixed, and texts encoded.

Every stage takes what its predecessor kept and returns the columns of ``documents``; the last returns ids. A document
that the mix takes twice is two rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from faresight.llm import bpe, mixing, ngram_join, secret_scan, toxicity
from faresight.llm.common import stage, stored
from faresight.llm.queries import prepare, tokenizer_path


def _tidy(run: Callable[[SparkSession, DataFrame, str], DataFrame], first: bool = False) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage whose helper tables go when the next stage begins, its result being written by then."""

    @wraps(run)
    def inside(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with stage(docs, first):
            return run(spark, docs, sf_dir)

    return inside


def _with_length(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))


@partial(_tidy, first=True)
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pattern grammar, learned from ``labels``, does not reject. Null and empty texts match nothing; repeated rows
    and rows without id are judged one by one.
    """
    prepare(spark)
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))


@_tidy
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group linked by a shingle Jaccard similarity of 0.75 or more.

    Of repeated rows one stays, whatever their ids; texts without words, null ones included, all stay.
    """
    prepare(spark)
    return ngram_join.keep_first(docs)


@_tidy
def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reported credential parts are replaced by a mark; no document goes. A null text stays null."""
    return _with_length(secret_scan.redact(docs))


@_tidy
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The copies that the weighted mix takes, in its order, none of them cut; documents without words stay, once.

    Null sources are one source. Rows that share an id are documents of their own.
    """
    return _with_length(mixing.mixture(docs, whole=True))


@_tidy
def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, number of tokens, ids as little-endian unsigned 32-bit integers, and their hash. A null text has no ids."""
    prepare(spark)
    ids = bpe.encoded(docs.select("doc_id", "source", "text"), tokenizer_path())
    return ids.select("doc_id", "source", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("secret_scans", mask_secrets),
    ("mixing", mix_sources),
    ("bpe", encode_texts),
]

#: SQL can express neither the learned toxicity stage nor the encoding; the tests compare stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stored(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
