"""Corpus pipeline: from raw documents to packed training sequences.

Each stage takes all that its predecessor kept and returns the columns of documents, but
for the last, which returns packed pieces.  Between stages the rows are written as
Parquet and read again, so a lost executor never costs more than one stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteweave.llm import line_dedup, mixing, near_copies, packing, quality_model, queries
from noteweave.llm.common import scratch_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near duplicates: shingles of five words, a Jaccard similarity of 0.8 or more.
#: Fingerprints of four words (256 bits) find the groups in which sets are compared.
SHINGLE_WORDS = 5
SIMILARITY = 0.8
PRINT_WORDS = 4


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts.  Rows with a null or empty text are scored
    like any other, by the bias alone."""
    score = quality_model.scorer(spark, queries.quality_fit(spark, sf_dir))
    return docs.where(score(F.col("text")) >= queries.ACCEPTED).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more share; n_chars follows the text."""
    left = line_dedup.dedup_lines(docs.select(*COLUMNS))
    return left.withColumns({"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long")}).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that with the smallest doc_id, a null one
    only where the group has no other; of several with that id, one."""
    found = near_copies.near_copies(docs, SHINGLE_WORDS, SIMILARITY, PRINT_WORDS)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row_id")
    first = found.groupBy("component").agg(F.min(order).alias("first")).select("first.row_id")
    kept = near_copies.with_row_id(docs).join(first, "row_id", "left_semi")
    return kept.dropDuplicates(["row_id"]).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix draws them; those without words are never drawn."""
    return mixing.mixed_documents(docs, COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens, with their ids; repeated documents, which
    the mix makes, are packed one by one."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("simhash near-dedup", near_duplicates),
    ("mixing", mix),
    ("packing", pack),
]

#: The classifier, the fingerprints and the tokens are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
