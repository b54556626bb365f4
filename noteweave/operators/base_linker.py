"""The baseline drug linker: lookups in the base table, one parsed mention, tiered scores.

Mentions are rows of id and mention; entries are those of `kb.base_drugs`, a fixed and
small table, which is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as V


def tidy(text: Column) -> Column:
    """Lower-cased, with single blanks; null counts as empty."""
    return F.btrim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+", " "))


def parse_base(text: Column) -> Column:
    """Struct original, ingredient, strength, strength_value, unit, dose_form, route,
    frequency of a mention: the first match of each pattern, the ingredient in front of the
    strength, else of the form; null without text."""

    def word(alternatives: str) -> Column:
        found = F.regexp_extract(text, rf"(?i)\b({alternatives})\b", 1)
        return F.when(found != "", F.lower(found))

    strength = F.regexp_extract(text, V.BASE_STRENGTH, 0)
    form_text = F.regexp_extract(text, rf"(?i)\b({V.BASE_FORMS})\b", 1)
    # What stands in front of the first match is what a lazy group in front of it takes.
    ahead = F.regexp_extract(text, rf"(?s)^(.*?){V.BASE_STRENGTH}", 1)
    ahead_form = F.regexp_extract(text, rf"(?is)^(.*?)\b(?:{V.BASE_FORMS})\b", 1)
    head = F.when(strength != "", F.btrim(ahead)).when(form_text != "", F.btrim(ahead_form)).otherwise(text)
    value = F.replace(F.regexp_extract(text, V.BASE_STRENGTH, 1), F.lit(","), F.lit(".")).try_cast("double")
    parsed = F.struct(
        text.alias("original"),
        F.btrim(F.regexp_replace(head, r"\d+\s*$", "")).alias("ingredient"),
        F.when(strength != "", strength).alias("strength"),
        value.alias("strength_value"),
        F.when(strength != "", F.upper(F.regexp_extract(text, V.BASE_STRENGTH, 2))).alias("unit"),
        word(V.BASE_FORMS).alias("dose_form"),
        word(V.BASE_ROUTES).alias("route"),
        word(V.BASE_FREQUENCIES).alias("frequency"),
    )
    return F.when(F.coalesce(text, F.lit("")) != "", parsed)


def lookup(queries: DataFrame, entries: DataFrame, by: str) -> DataFrame:
    """id, rxcui, rank of entries whose `by` (name, ingredient, brand or rxcui) is the
    query's text, blanks and case aside; of equal names the first entry is held."""
    keys = entries.select("rxcui", "seq", (F.col(by) if by == "rxcui" else tidy(F.col(by))).alias("key")).where("key <> ''")
    if by == "name":
        keys = keys.groupBy("key").agg(F.min_by("rxcui", "seq").alias("rxcui"), F.min("seq").alias("seq"))
    asked = queries.select("id", (F.col("mention") if by == "rxcui" else tidy(F.col("mention"))).alias("key"))
    found = asked.join(F.broadcast(keys), "key")
    return found.select("id", "rxcui", F.row_number().over(Window.partitionBy("id").orderBy("seq")).alias("rank"))


def search_ingredients(queries: DataFrame, entries: DataFrame) -> DataFrame:
    """id, rxcui, rank of entries whose ingredient holds the query's text or lies in it:
    ingredients in the order of their first entry, then entries in theirs."""
    keys = _by_ingredient(entries)
    q, k = F.col("q"), F.col("key")
    found = queries.select("id", tidy(F.col("mention")).alias("q")).where("q <> ''").join(F.broadcast(keys), F.contains(k, q) | F.contains(q, k))
    return found.select("id", "rxcui", F.row_number().over(Window.partitionBy("id").orderBy("place", "seq")).alias("rank"))


def _by_ingredient(entries: DataFrame) -> DataFrame:
    keys = entries.withColumn("key", tidy(F.col("ingredient"))).where("key <> ''")
    return keys.withColumn("place", F.min("seq").over(Window.partitionBy("key")))  # a knowledge base: few rows


def base_score(p: Column, ingredient: Column, strength: Column, form: Column) -> Column:
    """.5 or .3 for the ingredient, .3 or .2 for the strength, .2 for the form."""
    a, b = F.lower(p["ingredient"]), F.lower(ingredient)
    same = F.when((a == "") | (b == ""), 0.0).when(a == b, 0.5).when(F.contains(b, a), 0.3)
    m, v = p["strength_value"], F.replace(F.regexp_extract(strength, V.BASE_STRENGTH, 1), F.lit(","), F.lit(".")).try_cast("double")
    close = F.when((m == 0) | v.isNull(), 0.0).when(F.abs(m - v) < 0.01, 0.3).when(F.abs(m - v) / F.greatest(m, F.lit(1.0)) < 0.1, 0.2)
    fits = F.when(p["dose_form"] == F.lower(form), 0.2)
    return sum((F.coalesce(x, F.lit(0.0)) for x in (same, close, fits)), F.lit(0.0))


def link_base(mentions: DataFrame, entries: DataFrame, limit: int = 5) -> DataFrame:
    """id, rxcui, score, rank: the exact name (1.0); entries of the ingredient by their
    score, if the mention names a strength; else, if nothing was found, entries whose
    ingredient holds the mention's or lies in it (0.6)."""
    parsed = mentions.select("id", "mention", parse_base(F.col("mention")).alias("p")).where("p is not null")
    names = lookup(parsed, entries, "name").select("id", "rxcui", F.lit(0).alias("tier"), F.lit(0).alias("place"), F.lit(0).alias("seq"), F.lit(1.0).alias("score"))
    keys = F.broadcast(_by_ingredient(entries).select("rxcui", "seq", "place", "key", "ingredient", F.col("strength").alias("e_strength"), F.col("dose_form").alias("e_form")))
    own = tidy(F.col("p.ingredient"))
    dosed = (F.col("p.strength_value") != 0) & (F.col("p.ingredient") != "")
    fit = parsed.where(dosed).join(keys, own == F.col("key"))
    fit = fit.select("id", "rxcui", F.lit(1).alias("tier"), F.lit(0).alias("place"), "seq", base_score(F.col("p"), F.col("ingredient"), F.col("e_strength"), F.col("e_form")).alias("score"))
    first = names.unionByName(fit.where("score > 0"))
    rest = parsed.where(own != "").join(first.select("id").distinct(), "id", "left_anti")
    wide = rest.join(keys, F.contains(F.col("key"), own) | F.contains(own, F.col("key")))
    found = first.unionByName(wide.select("id", "rxcui", F.lit(2).alias("tier"), "place", "seq", F.lit(0.6).alias("score")))
    once = found.groupBy("id", "rxcui").agg(F.min(F.struct("tier", "place", "seq")).alias("o"), F.min_by("score", F.struct("tier", "place", "seq")).alias("score"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "o"))
    return once.withColumn("rank", rank).where(F.col("rank") <= limit).select("id", "rxcui", "score", "rank")
