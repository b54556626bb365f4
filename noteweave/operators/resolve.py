"""Merging entities of several sources: same spans first, then overlaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import overlaps

#: Weights by section and type, in the order in which sections are tried.
SECTION_WEIGHTS = {
    "chẩn đoán": {"CHẨN_ĐOÁN": 1.2, "TRIỆU_CHỨNG": 0.8},
    "triệu chứng": {"TRIỆU_CHỨNG": 1.2, "CHẨN_ĐOÁN": 0.8},
    "điều trị": {"THUỐC": 1.2},
    "xét nghiệm": {"TÊN_XÉT_NGHIỆM": 1.2, "KẾT_QUẢ_XÉT_NGHIỆM": 1.1},
    "kết quả": {"KẾT_QUẢ_XÉT_NGHIỆM": 1.2},
}
#: Base confidences and bonuses.
BASE_CONFIDENCE = {"regex": 0.80, "dictionary": 0.85, "ner_model": 0.5, "merged": 0.90}
AGREEMENT_BONUS, CONTEXT_BONUS = 0.10, 0.05
NEVER_MERGED = ("TÊN_XÉT_NGHIỆM", "KẾT_QUẢ_XÉT_NGHIỆM")
ENTITY = "struct<start:int,end:int,type:string,confidence:double,source:string,source_scores:map<string,double>,outcome:string>"


def section_weight(section: Column, kind: Column) -> Column:
    """Weight of a type in a section: the first section name that it contains decides."""
    out = F.lit(1.0)
    for name, weights in reversed(SECTION_WEIGHTS.items()):
        own = F.lit(1.0)
        for k, w in weights.items():
            own = F.when(kind == k, w).otherwise(own)
        out = F.when(F.contains(F.lower(section), F.lit(name)), own).otherwise(out)
    return F.when(F.coalesce(section, F.lit("")) == "", 1.0).otherwise(out)


def context_confidence(confidence: Column, section: Column, kind: Column) -> Column:
    known = F.coalesce(section, F.lit("")) != ""
    return F.when(known, F.least(confidence * section_weight(section, kind), F.lit(1.0))).otherwise(confidence)


def entity_confidence(confidence: Column, n_sources: Column, context: Column) -> Column:
    bonus = F.when(n_sources > 1, AGREEMENT_BONUS).otherwise(0.0)
    return F.least(F.lit(1.0), confidence + bonus + F.coalesce(context, F.lit(0.0)) * CONTEXT_BONUS)


def merge_same_spans(entities: DataFrame) -> DataFrame:
    """One row for each (doc_id, start, end).

    entities: doc_id, seq, start, end, type, confidence, source, section.  A test name and
    a test result on one span are never merged: the surer stays.  Other types compete by
    confidence in their section.  One type is merged: mean confidence, with a bonus if
    more than one source found it.  Of equals the first (lowest seq) wins.
    """
    rows = entities.withColumn("context", context_confidence(F.col("confidence"), F.col("section"), F.col("type")))
    sure = F.max_by(F.struct("type", "confidence", "source"), F.struct("confidence", -F.col("seq")))
    apt = F.max_by(F.struct("type", "context", "source"), F.struct("context", -F.col("seq")))
    grouped = rows.groupBy("doc_id", "start", "end").agg(
        F.min("seq").alias("seq"),
        F.count("*").alias("n"),
        F.collect_set("type").alias("types"),
        F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"),
        F.avg("confidence").alias("mean"),
        sure.alias("sure"),
        apt.alias("apt"),
        F.collect_list(F.struct("source", "confidence")).alias("scores"),
    )
    split = F.array_contains("types", NEVER_MERGED[0]) & F.array_contains("types", NEVER_MERGED[1])
    many = F.size("types") > 1
    merged = F.when(F.col("n") > 1, F.least(F.col("mean") + AGREEMENT_BONUS, F.lit(1.0))).otherwise(F.col("mean"))
    zero = F.expr("map()").cast("map<string,double>")
    best = lambda m, s: F.map_zip_with(m, F.create_map(s["source"], s["confidence"]), lambda _, x, y: F.greatest(x, y))
    return grouped.select(
        "doc_id",
        "seq",
        "start",
        "end",
        F.when(many & ~split, F.col("apt.type")).otherwise(F.col("sure.type")).alias("type"),
        F.when(split, F.col("sure.confidence")).when(many, F.col("apt.context")).otherwise(merged).alias("confidence"),
        F.when(split, F.col("sure.source")).otherwise(F.col("sources")).alias("source"),
        F.aggregate("scores", zero, best).alias("source_scores"),
        F.when(split, "pair_conflict").when(many, "type_conflict").when(F.col("n") > 1, "merged").otherwise("single").alias("outcome"),
    )


def drop_overlaps(entities: DataFrame) -> DataFrame:
    """Greedy in order of seq: an entity joins the first group whose head it overlaps,
    else it heads a new one; the surest of a group stays, of equals the first."""
    item = F.struct("seq", "start", "end", "type", "confidence", "source", "source_scores", "outcome")
    by_seq = lambda a, b: F.signum(a["x"]["seq"] - b["x"]["seq"]).cast("int")
    rows = entities.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(item.alias("x"))), by_seq).alias("found"))
    kind = f"struct<seq:bigint,{ENTITY[7:]}"
    zero = F.array().cast(f"array<struct<head:{kind},best:{kind}>>")

    def step(groups: Column, row: Column) -> Column:
        x = row["x"]
        hits = F.transform(groups, lambda g: overlaps(g["head"], x))
        at = F.array_position(hits, True)
        joined = F.transform(
            groups,
            lambda g, i: F.when((i + 1 == at) & (x["confidence"] > g["best"]["confidence"]), F.struct(g["head"].alias("head"), x.alias("best"))).otherwise(g),
        )
        return F.when(at > 0, joined).otherwise(F.concat(groups, F.array(F.struct(x.alias("head"), x.alias("best")))))

    kept = F.aggregate(F.transform("found", lambda r: F.struct(r["x"].cast(kind).alias("x"))), zero, step)
    return rows.select("doc_id", F.explode(F.transform(kept, lambda g: g["best"])).alias("e")).select("doc_id", "e.*")


def conflict_counts(merged: DataFrame) -> DataFrame:
    """How often each kind of conflict came up."""
    return merged.where("outcome like '%conflict'").groupBy("outcome").agg(F.count("*").alias("n"))


def floor_confidence(entities: DataFrame, floors: dict[str, float]) -> DataFrame:
    """Raise low confidences to their source's floor; nothing is dropped."""
    floor = F.lit(0.0)
    for source, value in floors.items():
        floor = F.when(F.col("source") == source, value).otherwise(floor)
    return entities.withColumn("confidence", F.greatest("confidence", floor))


def conflict_log(merged: DataFrame) -> DataFrame:
    """doc_id, start, end, outcome, type, confidence and logged_at of every conflict."""
    rows = merged.where("outcome like '%conflict'")
    return rows.select("doc_id", "start", "end", "outcome", "type", "confidence", F.current_timestamp().alias("logged_at"))


def union_once(sources: list[DataFrame]) -> DataFrame:
    """Entities of several sources, each (doc_id, start, end, type) once: that of the first
    source in the list, of one source the lowest seq."""
    rows = None
    for k, s in enumerate(sources):
        own = s.withColumn("_place", F.lit(k))
        rows = own if rows is None else rows.unionByName(own)
    kept = [c for c in rows.columns if c not in ("doc_id", "start", "end", "type", "_place")]
    first = rows.groupBy("doc_id", "start", "end", "type").agg(F.min_by(F.struct(*kept), F.struct("_place", "seq")).alias("_first"))
    return first.select("doc_id", "start", "end", "type", *(F.col(f"_first.{c}") for c in kept))
