"""Combining rule assertions with a classifier's, and what needs a second look."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLAGS = ("negated", "historical", "family")
#: Strategies that weigh in the classifier; all others keep the rules' verdict.
WITH_MODEL = ("rule_then_classifier", "rule_override", "voting")


def model_scores(default: float = 0.5) -> dict[str, Column]:
    """The scores of a model that is not there."""
    return {f"p_{f}": F.lit(default) for f in FLAGS} | {"p_confidence": F.lit(default)}


def combine(rows: DataFrame, strategy: str = "rule_only", threshold: float = 0.5, min_confidence: float = 0.5) -> DataFrame:
    """Add negated, historical, family, sure, origin and disagreement.

    rows: is_negated, is_historical, is_family and confidence of the rules, and p_negated,
    p_historical, p_family and p_confidence of a classifier (all null: there is none).
    Voting takes either's flag and the mean confidence; rule_then_classifier asks the
    classifier only where the rules are unsure; rule_override votes unless the classifier
    denies a flag that the rules have.
    """
    rule = {f: F.col(f"is_{f}") for f in FLAGS}
    model = {f: F.coalesce(F.col(f"p_{f}") >= threshold, F.lit(False)) for f in FLAGS}
    known = F.col("p_confidence").isNotNull()
    denied = F.lit(False)
    for f in FLAGS:
        denied = denied | (rule[f] & ~model[f])
    denied = known & denied
    unsure = known & (F.col("confidence") <= min_confidence)
    origin = {
        "voting": F.when(known, "ensemble"),
        "rule_then_classifier": F.when(unsure, "classifier"),
        "rule_override": F.when(known & ~denied, "ensemble"),
    }.get(strategy, F.lit(None).cast("string"))
    rows = rows.withColumn("origin", F.coalesce(origin, F.lit("rule")))
    pick = lambda a, b, c: F.when(F.col("origin") == "ensemble", c).when(F.col("origin") == "classifier", b).otherwise(a)
    made = {f: pick(rule[f], model[f], rule[f] | model[f]) for f in FLAGS}
    made["sure"] = pick(F.col("confidence"), F.col("p_confidence"), (F.col("confidence") + F.col("p_confidence")) / 2)
    return rows.withColumns(made | {"disagreement": denied & F.lit(strategy in WITH_MODEL)})


def disagreements(combined: DataFrame) -> DataFrame:
    return combined.where("disagreement")


def to_review(samples: DataFrame, gold: DataFrame, found: DataFrame, gap: int = 2, short: int = 3) -> DataFrame:
    """sample_id, trigger, entity_text: samples whose counts of gold and found entities are
    `gap` or more apart, found drugs and symptoms that gold lacks, and very short entities.
    gold and found: sample_id, text, type; each case once."""
    n = lambda df, c: df.groupBy("sample_id").agg(F.count("*").alias(c))
    counts = samples.select("sample_id").join(n(gold, "g"), "sample_id", "left").join(n(found, "p"), "sample_id", "left")
    apart = counts.where(F.abs(F.coalesce("g", F.lit(0)) - F.coalesce("p", F.lit(0))) >= gap)
    named = F.col("type").isin("THUỐC", "TRIỆU_CHỨNG")
    extra = found.where(named).join(gold.select("sample_id", "text"), ["sample_id", "text"], "left_anti")
    brief = found.where(F.char_length("text") < short)
    none = F.lit(None).cast("string").alias("entity_text")
    parts = [
        apart.select("sample_id", F.lit("count_gap").alias("trigger"), none),
        extra.select("sample_id", F.lit("unmatched_entity").alias("trigger"), F.col("text").alias("entity_text")),
        brief.select("sample_id", F.lit("short_span").alias("trigger"), F.col("text").alias("entity_text")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()
