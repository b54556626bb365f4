"""Rule rerankers and ontology checks: features are columns of one candidate row.

A candidate row has id, mention, score (of the retrieval) and the entry's columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import normalize as N
from ..functions.spans import any_of
from .retrieve import jaccard, word_set

#: Feature weights.
ICD_WEIGHTS = {"lexical_similarity": 0.02, "exact_alias": 0.02, "context_include": 0.01, "specificity_penalty": -0.01, "parent_child_boost": 0.01, "retrieval_score": 0.94}
DRUG_WEIGHTS = {"ingredient": 0.40, "strength_exact": 0.20, "strength_close": 0.10, "unit_match": 0.10, "dose_form": 0.10, "brand": 0.05, "retrieval_score": 0.05}
NONE = "array<string>"


def _low(c: Column) -> Column:
    return F.lower(F.btrim(c))


def child_penalty(code: Column, parent: Column, has_detail: Column, description: Column) -> Column:
    """.25 for a child code when neither the mention nor a long description gives detail."""
    is_child = parent.isNotNull() & (parent != code)
    detailed = has_detail | F.coalesce(F.char_length(description) > 80, F.lit(False))
    return F.when(is_child & ~detailed, V.CHILD_PENALTY).otherwise(0.0)


def _within(terms: Column, text: Column) -> Column:
    return F.filter(F.coalesce(terms, F.array().cast(NONE)), lambda t: (_low(t) != "") & F.contains(F.lower(text), _low(t)))


def exclude_penalty(text: Column, terms: Column) -> Column:
    return F.when(F.size(_within(terms, text)) > 0, V.EXCLUDE_PENALTY).otherwise(0.0)


def include_boost(text: Column, terms: Column) -> Column:
    hits, n = F.size(_within(terms, text)), F.size(F.coalesce(terms, F.array().cast(NONE)))
    return F.when(hits > 0, F.least(V.INCLUDE_SHARE * hits / n + V.INCLUDE_HIT * F.least(hits, F.lit(3)), F.lit(V.INCLUDE_MOST))).otherwise(0.0)


def in_milligrams(value: Column, unit: Column) -> Column:
    u = F.upper(F.coalesce(unit, F.lit("")))
    return F.when(u.isin("G", "GRAM", "GRAMS"), value * 1000).when(u.isin("UG", "MCG", "MICROGRAM", "MICROGRAMS"), value / 1000).otherwise(value)


def strength_penalty(value: Column, unit: Column, other: Column, other_unit: Column) -> Column:
    """.5, .3 or .15 by how far strengths are apart once their units agree."""
    a, b = in_milligrams(value, unit), in_milligrams(other, other_unit)
    apart = F.abs(a - b) / F.greatest(a, b, F.lit(0.01))
    graded = F.when(F.abs(a - b) < 0.01, 0.0)
    for least, penalty in V.STRENGTH_PENALTIES.items():
        graded = graded.when(apart > least, penalty)
    return F.when(a.isNull() | b.isNull(), 0.0).otherwise(graded)


def form_penalty(form: Column, other: Column) -> Column:
    clash = F.lit(False)
    for a, b in V.CONFLICTING_FORMS:
        clash = clash | ((_low(form) == a) & (_low(other) == b))
    return F.when(F.coalesce(clash, F.lit(False)), V.FORM_PENALTY).otherwise(0.0)


def _ranked(rows: DataFrame, features: dict[str, Column], weights: dict[str, float], total, k: int, code: str) -> DataFrame:
    before = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), code))
    scored = rows.withColumns(features).withColumn("rank_before", before)
    weighted = sum((weights[f] * F.col(f) for f in weights), F.lit(0.0))
    scored = scored.withColumn("rerank_score", F.round(F.greatest(F.lit(0.0), total(weighted)), 6))
    after = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("rerank_score"), "rank_before"))
    return scored.withColumn("rank_after", after).where(F.col("rank_after") <= k)


def rerank_icd(candidates: DataFrame, k: int = 10) -> DataFrame:
    """Rerank ICD candidates: the retrieval score rules, lexical and ontology features break ties."""
    rows = candidates.withColumns({"text": N.for_fuzzy(F.col("mention")), "texts": F.concat(
        F.filter(F.array("name_vi", "name_en"), lambda x: F.coalesce(x, F.lit("")) != ""), "synonyms", "aliases",
        F.filter(F.array("description"), lambda x: F.coalesce(x, F.lit("")) != ""), "include_terms")})
    # Texts of entries are normalised once each, before they meet the mentions.
    entries = rows.select("code", F.explode("texts").alias("t")).distinct().withColumn("norm", N.for_fuzzy(F.col("t")))
    norms = entries.groupBy("code").agg(F.collect_set("norm").alias("norms"))
    rows = rows.join(norms, "code", "left").withColumn("words", word_set(F.col("text")))
    own = F.col("words")
    best = F.array_max(F.transform("norms", lambda t: F.greatest(jaccard(own, word_set(t)), F.size(F.filter(own, lambda w: F.contains(t, w))) / F.greatest(F.size(own), F.lit(1)))))
    said = _low(F.col("mention"))
    alias = F.when(F.exists("aliases", lambda a: _low(a) == said), 1.0).when(F.exists("synonyms", lambda s: _low(s) == said), 0.9).otherwise(0.0)
    is_child = F.col("parent_code").isNotNull() & (F.col("parent_code") != F.col("code"))
    brief = (F.size(F.filter(F.split("mention", r"\s+"), lambda w: w != "")) <= 2) & (F.char_length("mention") < 25)
    detail = any_of(V.DETAIL_SIGNALS, lambda s: F.contains(F.lower("mention"), F.lit(s)))
    count = lambda terms: F.size(F.filter(F.coalesce(terms, F.array().cast(NONE)), lambda t: F.contains(F.col("text"), F.lower(t))))
    top = F.max("score").over(Window.partitionBy("id"))
    features = {
        "lexical_similarity": F.coalesce(best, F.lit(0.0)),
        "exact_alias": alias,
        "context_include": F.least(0.1 * count(F.col("include_terms")), F.lit(0.25)) + include_boost(F.col("text"), F.col("include_terms")),
        "specificity_penalty": F.least(0.15 * count(F.col("exclude_terms")), F.lit(0.30)),
        "parent_child_boost": F.when(~is_child, 0.05).when(brief, -0.10).otherwise(0.0),
        "retrieval_score": F.when(top == 0, F.when(F.col("score") > 0, 1.0).otherwise(0.0)).otherwise(F.least(F.col("score") / top, F.lit(1.0))),
        "constraint_penalty": child_penalty(F.col("code"), F.col("parent_code"), detail, F.col("description")) + exclude_penalty(F.col("text"), F.col("exclude_terms")),
    }
    scale = F.when(F.col("retrieval_score") > 0.9, 0.3).otherwise(0.8)
    return _ranked(rows.drop("texts"), features, ICD_WEIGHTS, lambda w: w - F.col("constraint_penalty") * scale, k, "code")


def _parsed(candidates: DataFrame) -> DataFrame:
    p = candidates.withColumn("p", N.parse_drug(F.col("mention")))
    return p.withColumns(
        {
            "m_ing": F.get("p.ingredients", F.lit(0)),
            "m_value": F.get("p.strength_values", F.lit(0)),
            "m_unit": F.get("p.strength_units", F.lit(0)),
            "m_form": F.col("p.dose_form"),
            "m_brand": F.col("p.brand"),
            "k_m": N.drug_for_matching(F.get("p.ingredients", F.lit(0))),
            "k_e": N.drug_for_matching(F.col("ingredient")),
        }
    ).drop("p")


def _likeness(a: Column, b: Column, part: float) -> Column:
    """1 if equal, `part` if one holds the other."""
    x, y = _low(a), _low(b)
    return F.coalesce(F.when((x == "") | (y == ""), 0.0).when(x == y, 1.0).when(F.contains(x, y) | F.contains(y, x), part), F.lit(0.0))


def rerank_drugs_by_rules(candidates: DataFrame, k: int = 10) -> DataFrame:
    """Rerank drugs by ingredient, strength, unit, form and brand.  The ontology penalty is a
    column of its own and weighs nothing, as the rule has it."""
    rows = _parsed(candidates)
    m, v = F.col("m_value"), F.col("strength_value")
    exact = F.coalesce(F.abs(m - v) < 0.01, F.lit(False))
    mu, eu = _low(F.col("m_unit")), _low(F.col("strength_unit"))
    features = {
        "retrieval_score": F.when(F.col("score") > 0, F.least(F.col("score") / 3, F.lit(1.0))).otherwise(0.0),
        "constraint_penalty": strength_penalty(m, F.col("m_unit"), v, F.col("strength_unit")) + form_penalty(F.col("m_form"), F.col("dose_form")),
        "strength_exact": F.when(exact, 1.0).otherwise(0.0),
        "strength_close": F.when(~exact & F.coalesce((m > 0) & (F.abs(m - v) / m < 0.15), F.lit(False)), 1.0).otherwise(0.0),
        "unit_match": F.when(mu == eu, 1.0).when(mu.isin("g", "mg") & eu.isin("g", "mg"), 0.5).otherwise(0.0),
        "dose_form": _likeness(F.col("m_form"), F.col("dose_form"), 0.5),
        "brand": _likeness(F.col("m_brand"), F.col("brand"), 0.7),
        "ingredient": _likeness(F.col("k_m"), F.col("k_e"), 0.8),
    }
    return _ranked(rows.withColumns({"entry_form": F.col("dose_form")}), features, DRUG_WEIGHTS, lambda w: w, k, "rxcui")


def rerank_drugs_by_dose(candidates: DataFrame, k: int = 10, cross_encoder: Column | None = None) -> DataFrame:
    """Rerank drugs: .45 dose, .25 cross-encoder (if there is one), .15 ingredient, .15 retrieval.

    A dose that the mention names counts if it fits; without one the usual dose does.
    """
    rows = _parsed(candidates)
    usual = F.create_map(*(F.lit(x) for name, dose in V.STANDARD_STRENGTHS.items() for x in (name, dose[0])))
    units = F.create_map(*(F.lit(x) for name, dose in V.STANDARD_STRENGTHS.items() for x in (name, dose[1])))
    key = F.lower(F.col("ingredient"))
    m, v, std = F.col("m_value"), F.col("strength_value"), F.try_element_at(usual, key)
    same_unit = F.col("m_unit") == F.col("strength_unit")
    named = F.when(F.abs(v - m) < 0.01, 0.3).when(same_unit & (m > 0) & (F.abs(v - m) / m < 0.15), 0.15).otherwise(0.0)
    silent = F.when((F.abs(v - std) < 0.01) & (F.col("strength_unit") == F.try_element_at(units, key)), 0.2).when((std > 0) & (F.abs(v - std) / std < 0.15), 0.12).otherwise(0.0)
    canonical = F.startswith(F.lower(F.col("name_short")), key)
    features = {
        "dosage_specificity": F.when(m.isNotNull(), named).otherwise(silent),
        "cross_encoder": F.lit(0.0) if cross_encoder is None else cross_encoder,
        "ingredient_context": F.when(m.isNull() & (F.col("k_m") == F.col("k_e")) & canonical, 0.1).otherwise(0.0),
        "retrieval_norm": F.least(F.col("score") / 3, F.lit(1.0)),
    }
    weights = {"dosage_specificity": 0.45, "cross_encoder": 0.25, "ingredient_context": 0.15, "retrieval_norm": 0.15}
    return _ranked(rows, features, weights, lambda w: w, k, "rxcui")


def blend(candidates: DataFrame, model_score: Column, alpha: float = 0.5) -> DataFrame:
    """Blend a model's raw score, brought to (0, 1], with the retrieval score."""
    return candidates.withColumn("blended", alpha * (1 / (1 + F.abs(model_score - 3) / 3)) + (1 - alpha) * F.col("score"))


def rerank_either(candidates: DataFrame, k: int = 10) -> dict[str, DataFrame]:
    """Rerank candidates of both code systems by their rules: rows with an rxcui as drugs,
    the others as diagnoses.  candidates: the columns of both, those of the other system
    null.  A reranker by the name of each system that the columns allow."""
    out = {}
    if "rxcui" in candidates.columns:
        out["drug"] = rerank_drugs_by_rules(candidates.where("rxcui is not null"), k)
    if "code" in candidates.columns:
        own = candidates.where("rxcui is null") if out else candidates
        out["icd"] = rerank_icd(own, k)
    if not out:
        raise ValueError("candidates have neither rxcui nor code")
    return out
