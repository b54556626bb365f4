"""Checks of samples and outputs: one row for each finding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TYPES = ["TRIỆU_CHỨNG", "TÊN_XÉT_NGHIỆM", "KẾT_QUẢ_XÉT_NGHIỆM", "CHẨN_ĐOÁN", "THUỐC"]
ASSERTIONS = ["isNegated", "isFamily", "isHistorical"]
WITH_ASSERTIONS = ["TRIỆU_CHỨNG", "CHẨN_ĐOÁN", "THUỐC"]
WITH_CANDIDATES = ["CHẨN_ĐOÁN", "THUỐC"]
ICD_CODE = r"^[A-Z]\d{2}(\.\d+)?$"
#: text, start, end, type, assertions, candidates.
ENTITY = "struct<text:string,start:int,end:int,type:string,assertions:array<string>,candidates:array<string>>"


def _findings(rows: DataFrame, tests: list[tuple[str, str, Column]], *keys: str) -> DataFrame:
    """severity and field of each test that holds; tests: (severity, field, condition)."""
    made = [F.when(F.coalesce(t, F.lit(False)), F.struct(F.lit(s).alias("severity"), F.lit(f).alias("field"))) for s, f, t in tests]
    found = rows.select(*keys, F.explode(F.filter(F.array(*made), lambda x: x.isNotNull())).alias("f"))
    return found.select(*keys, "f.severity", "f.field")


def _slices(text: Column, e: Column) -> Column:
    return F.substring(text, e["start"] + 1, e["end"] - e["start"])


def validate_samples(samples: DataFrame, strict: bool = True) -> DataFrame:
    """id, number, severity, field of samples (id, text, entities); number is the entity's
    place, null for the sample."""
    text = F.coalesce("text", F.lit(""))
    whole = _findings(
        samples.withColumn("number", F.lit(None).cast("int")),
        [("error", "id", F.coalesce("id", F.lit("")) == ""), ("error", "text", text == ""), ("warning", "entities", F.coalesce(F.size("entities"), F.lit(0)) < 1)],
        "id",
        "number",
    )
    each = samples.select("id", "text", F.posexplode("entities").alias("number", "e"))
    e, n = F.col("e"), F.char_length("text")
    valid = (e["start"] >= 0) & (e["start"] < e["end"]) & (e["end"] <= n)
    tests = [
        ("error", "start", (text != "") & (e["start"] < 0)),
        ("error", "end", (text != "") & (e["end"] > n)),
        ("error", "span", (text != "") & (e["start"] >= e["end"])),
        ("error", "text", valid & (_slices(F.col("text"), e) != e["text"])),
        ("error", "type", ~e["type"].isin(TYPES)),
        ("error", "assertions", F.exists(e["assertions"], lambda a: ~a.isin(ASSERTIONS))),
        ("error", "width", e["start"] == e["end"]),
    ]
    if strict:
        tests.append(("warning", "candidates", (e["type"] == "CHẨN_ĐOÁN") & F.exists(e["candidates"], lambda c: ~F.rlike(c, F.lit(ICD_CODE)))))
        tests.append(("warning", "candidates", (e["type"] == "THUỐC") & F.exists(e["candidates"], lambda c: ~F.rlike(c, F.lit(r"^\d+$")))))
    return whole.unionByName(_findings(each, tests, "id", "number"))


def validate_outputs(docs: DataFrame, icd_codes: list[str], drug_codes: list[str]) -> DataFrame:
    """doc_id, number, severity, field of outputs (doc_id, text, entities)."""
    each = docs.select("doc_id", "text", F.posexplode("entities").alias("number", "e"), "entities")
    e, n = F.col("e"), F.char_length("text")
    bad = (e["start"] < 0) | (e["end"] <= e["start"]) | (e["end"] > n)
    known = {"CHẨN_ĐOÁN": icd_codes, "THUỐC": drug_codes}

    def unknown(kind: str) -> Column:
        codes = F.array(*map(F.lit, known[kind])) if known[kind] else F.array().cast("array<string>")
        return (e["type"] == kind) & (F.size(F.array_except(e["candidates"], codes)) > 0) & F.lit(bool(known[kind]))

    same = F.filter("entities", lambda o, i: (o["start"] == e["start"]) & (o["end"] == e["end"]) & (i < F.col("number")))
    cross = F.filter("entities", lambda o, i: (o["start"] < e["end"]) & (e["start"] < o["end"]) & (i < F.col("number")))
    tests = [
        ("error", "position", bad),
        ("error", "text", ~bad & (_slices(F.col("text"), e) != e["text"])),
        ("error", "type", ~e["type"].isin(TYPES)),
        ("error", "assertions", e["type"].isin(TYPES) & ~e["type"].isin(WITH_ASSERTIONS) & (F.size(e["assertions"]) > 0)),
        ("error", "candidates", e["type"].isin(TYPES) & ~e["type"].isin(WITH_CANDIDATES) & (F.size(e["candidates"]) > 0)),
        ("error", "assertion_values", F.exists(e["assertions"], lambda a: ~a.isin(ASSERTIONS))),
        ("error", "assertion_count", F.size(e["assertions"]) > 3),
        ("warning", "codes", unknown("CHẨN_ĐOÁN") | unknown("THUỐC")),
        ("warning", "duplicate_position", F.size(same) > 0),
        ("warning", "overlap", F.size(cross) > 0),
    ]
    return _findings(each, tests, "doc_id", "number")


def overlap_pairs(spans: DataFrame) -> DataFrame:
    """doc_id, a, b of overlapping spans (doc_id, seq, start, end) with a before b in seq."""
    a, b = spans.alias("a"), spans.alias("b")
    meet = (F.col("a.start") < F.col("b.end")) & (F.col("b.start") < F.col("a.end")) & (F.col("a.seq") < F.col("b.seq"))
    return a.join(b, (F.col("a.doc_id") == F.col("b.doc_id")) & meet).select("a.doc_id", F.col("a.seq").alias("a"), F.col("b.seq").alias("b"))


def linking_findings(samples: DataFrame, code_pattern: str) -> DataFrame:
    """id, severity, field of linking samples (id, query_text, mention, positive, negatives)."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    tests = [
        ("error", "id", empty("id")),
        ("error", "query_text", empty("query_text")),
        ("error", "mention", empty("mention")),
        ("error", "positive", empty("positive")),
        ("warning", "positive", ~empty("positive") & ~F.rlike("positive", F.lit(code_pattern))),
        ("warning", "mention", ~empty("mention") & ~F.contains(F.lower("query_text"), F.lower("mention"))),
        ("error", "negatives", F.array_contains("negatives", F.col("positive"))),
    ]
    return _findings(samples, tests, "id")


def leaked(train: DataFrame, other: DataFrame, text: str = "text") -> DataFrame:
    """Rows of `other` whose text `train` also has."""
    return other.join(train.select(F.col(text).alias("_t")).distinct(), F.col(text) == F.col("_t"), "left_semi")
