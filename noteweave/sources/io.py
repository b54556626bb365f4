"""Reading and writing texts, samples, results and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLE = (
    "id string, text string, entities array<struct<text:string,start:int,end:int,type:string,assertions:array<string>,candidates:array<string>>>, "
    "source string, review_status string"
)


def decoded(content: Column) -> Column:
    """UTF-8 without a byte-order mark, or Latin-1 where the bytes are no UTF-8; trimmed."""
    text = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "iso-8859-1"))
    return F.regexp_replace(F.regexp_replace(text, "^﻿", ""), r"(?U)^\s+|\s+$", "")


def content_error(text: Column) -> Column:
    """empty, nul or null."""
    return F.when(F.coalesce(text, F.lit("")) == "", "empty").when(F.contains(text, F.lit("\u0000")), "nul")


def read_texts(spark: SparkSession, path: str, pattern: str = "*.txt", strict: bool = False) -> DataFrame:
    """doc_id (file stem), text and error of the files in a folder; strict raises on a bad one."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    rows = files.select(F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1).alias("doc_id"), decoded(F.col("content")).alias("text"))
    rows = rows.withColumn("error", content_error(F.col("text")))
    if strict:
        rows = rows.withColumn("text", F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.lit("bad text: "), "doc_id"))).otherwise(F.col("text")))
    return rows


def write_texts(rows: DataFrame, path: str, text: str = "text") -> None:
    rows.select(text).write.mode("overwrite").text(path)


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of samples: defaults filled in, unknown keys in metadata."""
    raw = spark.read.text(path).where(F.trim("value") != "")
    known = [f.split(" ")[0] for f in SAMPLE.replace("<", " ").split(", ") if f.split(" ")[0] in ("id", "text", "entities", "source", "review_status")]
    parsed = raw.select(F.from_json("value", SAMPLE).alias("s"), F.from_json("value", "map<string,string>").alias("m"))
    return parsed.select(
        "s.id",
        "s.text",
        F.coalesce("s.entities", F.expr("array()")).alias("entities"),
        F.coalesce("s.source", F.lit("template")).alias("source"),
        F.coalesce("s.review_status", F.lit("auto_validated")).alias("review_status"),
        F.map_filter("m", lambda k, _: ~k.isin([*known, "metadata"])).alias("metadata"),
    )


def read_named(spark: SparkSession, path: str) -> DataFrame:
    """id and text of JSON lines that call them id or sample_id, and text or content."""
    rows = spark.read.schema("id string, sample_id string, text string, content string").json(path)
    return rows.select(F.coalesce("id", "sample_id").alias("id"), F.coalesce("text", "content").alias("text"))


def write_json_lines(rows: DataFrame, path: str, append: bool = False) -> None:
    rows.write.mode("append" if append else "overwrite").json(path)


def write_results(results: DataFrame, path: str) -> None:
    """One JSON array of entities for each document, in a folder of its own."""
    results.select("doc_id", F.to_json("entities", {"pretty": "true"}).alias("value")).write.mode("overwrite").partitionBy("doc_id").text(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with a header; lists joined by a bar."""
    flat = [F.array_join(c, "|").alias(c) if t.startswith("array") else F.col(c) for c, t in rows.dtypes]
    rows.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def run_statistics(results: DataFrame) -> DataFrame:
    """kind, name, n: documents, entities by type and by assertion."""
    each = results.select("doc_id", F.explode("entities").alias("e"))
    types = each.groupBy(F.col("e.type").alias("name")).agg(F.count("*").alias("n")).select(F.lit("type").alias("kind"), "name", "n")
    flags = each.select(F.explode("e.assertions").alias("name")).groupBy("name").agg(F.count("*").alias("n")).select(F.lit("assertion").alias("kind"), "name", "n")
    filled = F.when(F.size("entities") > 0, "with_entities").otherwise("empty")
    docs = results.groupBy(filled.alias("name")).agg(F.count("*").alias("n")).select(F.lit("documents").alias("kind"), "name", "n")
    return types.unionByName(flags).unionByName(docs)
