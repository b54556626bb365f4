"""Candidate retrieval: exact, tiers, BM25, fuzzy, dense and structured, and rank fusion.

Mentions are rows of id and mention.  Knowledge bases are fixed and small, so their sides
are broadcast; corpora are not.
"""

from __future__ import annotations

from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import normalize as N
from ..sources import kb

#: Source weights and score ceilings of the fusion.
SOURCE_WEIGHTS = {"exact": 1.0, "normalized": 0.95, "alias": 0.9, "fuzzy": 0.8, "bm25": 0.7, "dense": 0.75}
CEILINGS = {"fuzzy": 100.0, "bm25": 20.0, "dense": 1.0}
DRUG_WEIGHTS = {"structured": 1.0, "fuzzy": 0.8, "dense": 0.7}


def _case(c: Column, values: Mapping[str, float], default: float) -> Column:
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def top_k(rows: DataFrame, k: int, by: str, score: str, *ties: str) -> DataFrame:
    """The k best rows of each value of `by`, with their rank; ties name a total order."""
    w = Window.partitionBy(by).orderBy(F.desc(score), *ties)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def exact_icd(mentions: DataFrame, entries: DataFrame) -> DataFrame:
    """id, code, rank: names, then aliases, then synonyms; the first entry holds a text."""
    order = F.when(F.col("kind") == "canonical", 0).when(F.col("kind") == "alias", 1).when(F.col("kind") == "synonym", 2)
    texts = kb.icd_texts(entries).withColumn("tier", order).where("tier is not null").withColumn("norm", N.for_alias(F.col("text")))
    index = texts.where("norm <> ''").groupBy("tier", "norm").agg(F.min_by("code", F.struct("seq", "pos")).alias("code"))
    found = mentions.withColumn("norm", N.for_alias(F.col("mention"))).join(F.broadcast(index), "norm")
    first = found.groupBy("id", "code").agg(F.min("tier").alias("tier"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("tier"))).select("id", "code", "rank")


def search_tiers(mentions: DataFrame, entries: DataFrame, limit: int = 10) -> DataFrame:
    """id, code, tier, rank: same name, same synonym, name starts with, name or synonym contains."""
    tidy = lambda c: F.btrim(F.regexp_replace(F.lower(c), r"(?U)\s+", " "))
    keys = entries.select("code", "seq", tidy(F.col("name_en")).alias("name"), F.transform("synonyms", tidy).alias("others"))
    q = F.col("q")
    tier = (
        F.when(F.col("name") == q, 0)
        .when(F.array_contains("others", q), 1)
        .when(F.startswith("name", q), 2)
        .when(F.contains("name", q) | F.exists("others", lambda s: F.contains(s, q)), 3)
    )
    found = mentions.withColumn("q", tidy(F.col("mention"))).join(F.broadcast(keys), tier.isNotNull()).withColumn("tier", tier)
    rank = F.row_number().over(Window.partitionBy("id").orderBy("tier", "seq"))
    return found.withColumn("rank", rank).where(F.col("rank") <= limit).select("id", "code", "tier", "rank")


def children(entries: DataFrame) -> DataFrame:
    return entries.select(F.col("parent_code").alias("code"), F.col("code").alias("child")).where("code is not null")


def ancestors(entries: DataFrame) -> DataFrame:
    """code, depth, ancestor up the tree, by a recursive query; a code seen before ends it."""
    entries.createOrReplaceTempView("_code_tree")
    return entries.sparkSession.sql(
        """WITH RECURSIVE up(code, depth, ancestor, seen) AS (
             SELECT code, 1, parent_code, array(code, parent_code) FROM _code_tree WHERE parent_code IS NOT NULL AND parent_code <> code
             UNION ALL
             SELECT up.code, up.depth + 1, t.parent_code, array_append(up.seen, t.parent_code)
             FROM up JOIN _code_tree t ON t.code = up.ancestor
             WHERE t.parent_code IS NOT NULL AND NOT array_contains(up.seen, t.parent_code))
           SELECT code, depth, ancestor FROM up"""
    )


def bm25(queries: DataFrame, corpus: DataFrame, k: int = 10, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """id, doc_id, score, rank of the k best documents for each query.

    queries: id and tokens; corpus: doc_id and tokens (arrays of strings).  Okapi weights;
    words in more than half of the documents get epsilon times the mean weight.  A word
    counts as often as the query has it.  Documents that share no word with a query do not
    show up.  For the statistics of words only (word, 1) is shuffled, added up before;
    postings are made for words that queries ask for, and no others.
    """
    size = corpus.agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("mean"))
    df = corpus.select(F.explode(F.array_distinct("tokens")).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    one = size.select(F.struct("n", "mean").alias("s")).scalar()
    raw = F.log(one["n"] - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    idf = df.withColumn("raw", raw)
    floor = idf.agg((F.avg("raw") * epsilon).alias("f")).scalar()
    asked = queries.select("id", F.explode("tokens").alias("word")).groupBy("id", "word").agg(F.count("*").alias("times"))
    weights = idf.join(asked.select("word").distinct(), "word", "left_semi").withColumn("idf", F.when(F.col("raw") < 0, floor).otherwise(F.col("raw")))
    part = F.col("times") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / one["mean"]))
    words = asked.select("word").distinct()
    docs = corpus.select("doc_id", F.size("tokens").alias("length"), F.explode("tokens").alias("word"))
    tf = docs.join(words, "word", "left_semi").groupBy("doc_id", "word", "length").agg(F.count("*").alias("tf"))
    hits = tf.join(weights.select("word", "idf"), "word").join(asked, "word").withColumn("part", part)
    scored = hits.groupBy("id", "doc_id").agg(F.round(F.sum("part"), 6).alias("score"))
    return top_k(scored, k, "id", "score", "doc_id")


def indel_ratio(a: str, b: str) -> float:
    """100 * (1 - insertions and deletions / total length)."""
    total = len(a) + len(b)
    if not total:
        return 100.0
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            row[j], last = (last + 1 if x == y else max(row[j], row[j - 1])), row[j]
    return 200.0 * row[-1] / total


def _token_sort(a: str, b: str) -> float:
    return indel_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def _token_set(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    left, right = (" ".join(filter(None, (both, " ".join(sorted(own))))) for own in (x - y, y - x))
    if both and (left == both or right == both):
        return 100.0
    scores = [indel_ratio(left, right)]
    if both:
        scores += [indel_ratio(both, left), indel_ratio(both, right)]
    return max(scores)


def _partial(a: str, b: str) -> float:
    """Best ratio of the shorter text with a window of the longer, cut off at its ends too."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 100.0 if not long else 0.0
    n = len(short)
    return max(indel_ratio(short, long[max(0, k) : k + n]) for k in range(1 - n, len(long)))


def weighted_ratio(a: str, b: str) -> float:
    """The published weighted ratio: plain, token and partial ratios, scaled by lengths."""
    if not a or not b:
        return 0.0
    plain, share = indel_ratio(a, b), max(len(a), len(b)) / min(len(a), len(b))
    tokens = max(_token_sort(a, b), _token_set(a, b))
    if share < 1.5:
        return max(plain, 0.95 * tokens)
    scale = 0.9 if share <= 8 else 0.6
    sorted_words = [" ".join(sorted(t.split())) for t in (a, b)]
    parts = max(_partial(*sorted_words), 100.0 if set(a.split()) & set(b.split()) else 0.0)
    return max(plain, scale * _partial(a, b), 0.95 * scale * parts)


@F.arrow_udf(DoubleType())
def fuzzy_score(left: pa.Array, right: pa.Array) -> pa.Array:
    pairs = zip(left.to_pylist(), right.to_pylist(), strict=True)
    return pa.array([weighted_ratio(a, b) if a is not None and b is not None else None for a, b in pairs], pa.float64())


def fuzzy(mentions: DataFrame, texts: DataFrame, code: str, k: int = 30, cutoff: float = 50, depth: int | None = 3) -> DataFrame:
    """id, code, score, rank by the weighted ratio of distinct mentions and texts.

    texts: code, seq, pos, norm.  The best depth * k texts of a mention count (all if depth
    is null), and of a code the best; a text that several entries have belongs to the first.
    """
    index = texts.where("norm <> ''").groupBy("norm").agg(F.min_by(code, F.struct("seq", "pos")).alias(code), F.min("seq").alias("seq"), F.min("pos").alias("pos"))
    asked = mentions.select(N.for_fuzzy(F.col("mention")).alias("q")).where("q <> ''").distinct()
    # The second side is a knowledge base: a fixed number of rows.
    scored = asked.join(F.broadcast(index), F.lit(True)).withColumn("score", fuzzy_score("q", "norm")).where(F.col("score") >= cutoff)
    if depth:
        scored = top_k(scored, depth * k, "q", "score", "seq", "pos").drop("rank")
    best = scored.groupBy("q", code).agg(F.max("score").alias("score"), F.min("seq").alias("seq"))
    ranked = top_k(best, k, "q", "score", "seq")
    return mentions.select("id", N.for_fuzzy(F.col("mention")).alias("q")).join(ranked, "q").select("id", code, "score", "rank")


#: Query vectors are broadcast in blocks of so many rows at most.
QUERY_BLOCK = 10_000


def dense(queries: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """id, vec_id, score, rank: the k vectors with the largest cosine for each query vector.

    queries: id and q (array of floats), a stated set, which meets all vectors block by
    block; vectors: vec_id and v.
    """

    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)

    norm = lambda c: F.sqrt(dot(c, c))
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    left = queries.select("id", "q", norm(F.col("q")).alias("nq"), F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"))
    right = vectors.select("vec_id", "v", norm(F.col("v")).alias("nv")).where("nv > 0")
    found = None
    for n in range(blocks):
        own = left.where(F.col("block") == n)
        scored = right.join(F.broadcast(own), F.lit(True)).select("id", "vec_id", (dot(F.col("q"), F.col("v")) / (F.col("nq") * F.col("nv"))).alias("score"))
        best = top_k(scored, k, "id", "score", "vec_id")
        found = best if found is None else found.unionByName(best)
    return found


def structured(mentions: DataFrame, entries: DataFrame, k: int = 20) -> DataFrame:
    """id, rxcui, score, rank of parsed drug mentions: exact name; ingredient, strength and
    unit; ingredient and strength if nothing so far; ingredient and form; ingredient alone
    if still nothing; brand."""
    keys = entries.select(
        *(F.col(c) for c in entries.columns),
        N.drug_for_matching(F.col("name")).alias("k_name"),
        N.drug_for_matching(F.col("ingredient")).alias("k_ing"),
        N.drug_for_matching(F.col("brand")).alias("k_brand"),
    )
    last = Window.partitionBy("k_name").orderBy(F.desc("seq"))
    last_brand = Window.partitionBy("k_brand").orderBy(F.desc("seq"))
    keys = keys.withColumns({"name_held": F.row_number().over(last) == 1, "brand_held": F.row_number().over(last_brand) == 1})
    p = mentions.select("id", "mention", N.parse_drug(F.col("mention")).alias("p")).where("p is not null")
    p = p.select(
        "id",
        N.drug_for_matching(F.col("p.original")).alias("m_name"),
        N.drug_for_matching(F.get("p.ingredients", F.lit(0))).alias("m_ing"),
        F.get("p.strength_values", F.lit(0)).alias("m_value"),
        F.get("p.strength_units", F.lit(0)).alias("m_unit"),
        F.col("p.dose_form").alias("m_form"),
        F.when(F.col("p.brand").isNotNull(), N.drug_for_matching(F.col("p.brand"))).alias("m_brand"),
    )
    c = {n: F.coalesce(x, F.lit(False)) for n, x in _tier_tests().items()}
    rows = p.join(F.broadcast(keys), c["name"] | c["ingredient"] | c["brand"]).withColumns({f"t_{n}": x for n, x in c.items()})
    rows = rows.withColumn("score", structured_score())
    every = Window.partitionBy("id")
    early = F.max(F.col("t_name") | F.col("t_dose")).over(every)
    rows = rows.withColumn("early", early)
    rows = rows.withColumn("later", F.max(~F.col("early") & F.col("t_strength") | F.col("t_form")).over(every))
    keep = F.col("t_name") | F.col("t_dose") | (F.col("t_strength") & ~F.col("early")) | F.col("t_form") | F.col("t_brand")
    keep = keep | (F.col("t_ingredient") & ~F.col("early") & ~F.col("later"))
    total = F.when(F.col("t_name"), F.greatest(F.lit(1.0), "score")).otherwise(F.col("score"))
    return top_k(rows.where(keep).select("id", "rxcui", "seq", total.alias("score")), k, "id", "score", "seq").drop("seq")


def _tier_tests() -> dict[str, Column]:
    same_ing = (F.col("m_ing") != "") & (F.col("m_ing") == F.col("k_ing"))
    close = F.abs(F.col("strength_value") - F.col("m_value")) < 0.01
    unit = F.col("m_unit").isNull() | (F.col("m_unit") == F.col("strength_unit"))
    return {
        "name": (F.col("m_name") == F.col("k_name")) & F.col("name_held"),
        "ingredient": same_ing,
        "dose": same_ing & (F.col("strength_value") == F.col("m_value")) & (F.col("m_unit") == F.col("strength_unit")),
        "strength": same_ing & close & unit,
        "form": same_ing & (F.col("m_form") == F.col("dose_form")),
        "brand": (F.col("m_brand") == F.col("k_brand")) & F.col("brand_held") & (F.col("k_brand") != ""),
    }


def structured_score() -> Column:
    """Weights for ingredient, strength, unit, form and brand, with penalties, within 0 and 1."""
    m, v = F.col("m_value"), F.col("strength_value")
    has = F.coalesce(F.col("m_ing"), F.lit("")) != ""
    within = F.contains(F.col("k_ing"), F.col("m_ing")) | F.contains(F.col("m_ing"), F.col("k_ing"))
    ingredient = F.when(has & (F.col("m_ing") == F.col("k_ing")), 0.5).when(has & (F.col("k_ing") != "") & within, 0.35).otherwise(0.0)
    strength = F.when(m.isNull(), 0.0).when(v.isNull(), -0.2).when(F.abs(v - m) < 0.01, 0.25).when((m > 0) & (F.abs(v - m) / m < 0.1), 0.10).otherwise(-0.3)
    unit = F.when(F.col("m_unit").isNull(), 0.0).when(F.col("strength_unit").isNull(), -0.05).when(F.col("m_unit") == F.col("strength_unit"), 0.10).otherwise(-0.1)
    form = F.when(F.col("m_form") == F.col("dose_form"), 0.05).otherwise(0.0)
    brand = F.when((F.col("m_brand") == F.col("k_brand")) & (F.col("k_brand") != ""), 0.05).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), ingredient + strength + unit + form + brand))


def fuse_ranks(found: DataFrame, code: str, k: int = 20, rrf_k: int = 60, weights: Mapping[str, float] = SOURCE_WEIGHTS) -> DataFrame:
    """id, code, score, sources, rank by reciprocal ranks.  found: id, code, source, rank, score.
    Parts are added up in the order of sources, so that sums do not depend on the tasks."""
    source = F.col("source")
    norm = F.when(source.isin(*CEILINGS), F.least(F.col("score") / _case(source, CEILINGS, 1.0), F.lit(1.0))).otherwise(F.col("score"))
    part = 1 / (rrf_k + F.col("rank")) * _case(source, weights, 0.5) * (0.5 + 0.5 * norm)
    return _fused(found.withColumn("part", part), code, k, weights)


def fuse_weighted(found: DataFrame, code: str, k: int = 20, weights: Mapping[str, float] = SOURCE_WEIGHTS) -> DataFrame:
    """As fuse_ranks, by weighted scores."""
    source = F.col("source")
    norm = F.when(source.isin(*CEILINGS), F.least(F.col("score") / _case(source, CEILINGS, 1.0), F.lit(1.0))).otherwise(F.col("score"))
    return _fused(found.withColumn("part", norm * _case(source, weights, 0.5)), code, k, weights)


def fuse_drugs(found: DataFrame, k: int = 10) -> DataFrame:
    """As fuse_weighted, with scores relative to the best of their source and mention."""
    top = F.max("score").over(Window.partitionBy("id", "source"))
    norm = F.col("score") / F.when(top == 0, 1.0).otherwise(top)
    return _fused(found.withColumn("part", (0.5 + 0.5 * norm) * _case(F.col("source"), DRUG_WEIGHTS, 0.7)), "rxcui", k, DRUG_WEIGHTS)


def _fused(rows: DataFrame, code: str, k: int, weights: Mapping[str, float]) -> DataFrame:
    place = _case(F.col("source"), {s: float(i) for i, s in enumerate(weights)}, float(len(weights)))
    parts = F.array_sort(F.collect_list(F.struct(place.alias("o"), "rank", "part", "source")))
    grouped = rows.groupBy("id", code).agg(parts.alias("parts"))
    total = F.aggregate("parts", F.lit(0.0), lambda s, p: s + p["part"])
    out = grouped.select("id", code, F.round(total, 9).alias("score"), F.array_distinct(F.transform("parts", lambda p: p["source"])).alias("sources"))
    return top_k(out, k, "id", "score", code)


def known_codes(codes: Column, known: list[str]) -> Column:
    return F.array_intersect(codes, F.array(*map(F.lit, known)))


def word_set(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Shared words over all words of two word sets; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / F.size(F.array_union(a, b))).otherwise(0.0)


