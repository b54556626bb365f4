"""The knowledge bases as DataFrames; small and fixed, or read from JSON."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import knowledge_bases as K

ICD_SCHEMA = (
    "seq int, code string, name_vi string, name_en string, parent_code string, chapter string, description string, "
    "synonyms array<string>, aliases array<string>, include_terms array<string>, exclude_terms array<string>"
)
DRUG_SCHEMA = (
    "seq int, rxcui string, name string, name_short string, ingredient string, strength_value double, strength_unit string, "
    "dose_form string, brand string, synonyms array<string>, category string"
)
BASE_DRUG_SCHEMA = "seq int, rxcui string, name string, ingredient string, strength string, unit string, dose_form string, brand string, tty string"
LISTS = ("synonyms", "aliases", "include_terms", "exclude_terms")


def _icd_row(k: int, e: dict) -> tuple:
    name = e.get("name_en") or e.get("name")
    return (k, e["code"], e.get("name_vi"), name, e.get("parent_code"), e.get("chapter"), e.get("description"), *(e.get(c) or [] for c in LISTS))


def icd(spark: SparkSession, path: str | None = None, base: bool = False) -> DataFrame:
    """ICD-10 entries: built in (38, or 15 with base), or a JSON array at path."""
    if path:
        read = spark.read.schema(ICD_SCHEMA).option("multiLine", True).json(path)
        return read.withColumn("seq", F.monotonically_increasing_id().cast("int"))
    rows = [_icd_row(k, e) for k, e in enumerate(K.ICD_BASE if base else K.ICD)]
    return spark.createDataFrame(rows, ICD_SCHEMA)


def drugs(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Drugs: the 28 built-in ones, or a JSON array at path."""
    if path:
        read = spark.read.schema(DRUG_SCHEMA).option("multiLine", True).json(path)
        return read.withColumn("seq", F.monotonically_increasing_id().cast("int"))
    rows = []
    for k, (rxcui, name, short, ingredient, strength, brands, category) in enumerate(K.DRUGS):
        dose = re.search(r"(\d+(?:[.,]\d+)?)\s*(MG|G|MCG|ML|IU|%)", strength, re.I)
        value, unit = (float(dose[1].replace(",", ".")), dose[2].upper()) if dose else (None, None)
        rows.append((k, rxcui, name, short, ingredient, value, unit, "tablet", brands[0] if brands else None, brands, category))
    return spark.createDataFrame(rows, DRUG_SCHEMA)


def base_drugs(spark: SparkSession) -> DataFrame:
    names = ("rxcui", "name", "ingredient", "strength", "unit", "dose_form", "brand", "tty")
    return spark.createDataFrame([(k, *(e.get(n) for n in names)) for k, e in enumerate(K.DRUGS_BASE)], BASE_DRUG_SCHEMA)


def icd_texts(entries: DataFrame) -> DataFrame:
    """code, seq, pos, kind, text: what retrieval looks at, in order."""
    one = lambda c, kind: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.array(F.struct(F.lit(kind).alias("kind"), F.col(c).alias("text"))))
    many = lambda c, kind: F.transform(c, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("text")))
    none = F.array().cast("array<struct<kind:string,text:string>>")
    parts = [one("name_vi", "canonical"), one("name_en", "canonical"), many("synonyms", "synonym"), many("aliases", "alias"), one("description", "description"), many("include_terms", "include")]
    texts = F.concat(*(F.coalesce(p, none) for p in parts))
    return entries.select("code", "seq", F.posexplode(texts).alias("pos", "t")).select("code", "seq", "pos", "t.kind", "t.text")


def drug_texts(entries: DataFrame) -> DataFrame:
    texts = F.concat(F.array("name", "name_short", "ingredient"), "synonyms", F.array("brand"))
    return entries.select("rxcui", "seq", F.posexplode(F.filter(texts, lambda t: F.coalesce(t, F.lit("")) != "")).alias("pos", "text"))


def save(entries: DataFrame, path: str) -> None:
    """Write a knowledge base as one JSON array, which icd() and drugs() read at that path;
    entries keep their order, missing fields are left out."""
    own = F.struct(*(c for c in entries.columns if c != "seq"))
    rows = F.array_sort(F.collect_list(F.struct("seq", own.alias("entry"))))  # a knowledge base: few rows
    whole = entries.agg(F.transform(rows, lambda x: x["entry"]).alias("rows"))
    whole.select(F.to_json("rows").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def cached(entries: DataFrame, path: str, name: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """build(entries), written as Parquet under path the first time and read again as long
    as the entries are the same: the folder is named by the name and a digest of all rows."""
    spark = entries.sparkSession
    digest = entries.agg(F.md5(F.concat_ws("", F.array_sort(F.collect_list(F.md5(F.to_json(F.struct("*"))))))).alias("d")).first()["d"]  # a knowledge base: few rows
    folder = f"{path.rstrip('/')}/{name}-{digest}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        build(entries).write.mode("overwrite").parquet(folder)
    return spark.read.parquet(folder)
