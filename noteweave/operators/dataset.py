"""Sample sets: hashes, dedup, splits, profiles, variants and generated samples."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import fixed_values as V
from ..functions.lineage import cut
from ..functions.normalize import squeeze_blanks

BLANK = r"[\x09-\x0D\x1C-\x20\x85\xA0]+"


def text_hash(text: Column) -> Column:
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 16)


def normalized_hash(text: Column) -> Column:
    """Hash of the lower-cased text, seven letters without their marks, letters, digits and blanks only."""
    plain = F.translate(F.lower(text), "ăâđêôơư", "aadeoou")
    return text_hash(squeeze_blanks(F.regexp_replace(plain, r"(?U)[^\p{L}\p{N}_\s]", "")))


def entity_hash(entities: Column, with_spans: bool = False) -> Column:
    """Hash of the sorted signatures of entities (start, end, text, type)."""
    ordered = F.array_sort(F.transform(entities, lambda e: F.struct(e["start"], e["end"], e["text"], e["type"])))
    sign = lambda e: F.concat_ws("|", *([e["start"], e["end"], e["type"]] if with_spans else [e["text"], e["type"]]))
    return text_hash(F.array_join(F.transform(ordered, sign), ";"))


def keep_first(rows: DataFrame, key: Column, seq: str) -> DataFrame:
    """First row (by seq) of each key, with the number of rows that had it.

    Keys that many rows share are aggregated before the shuffle; only seq travels.
    """
    keyed = rows.withColumn("_key", key)
    first = keyed.groupBy("_key").agg(F.min(seq).alias("_first"), F.count("*").alias("copies"))
    return keyed.join(first, (keyed[seq] == F.col("_first")) & keyed["_key"].eqNullSafe(first["_key"])).drop("_first", "_key")


def dedup_chain(rows: DataFrame, keys: Sequence[tuple[str, Column]], seq: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Apply keys one after the other; also what each stage left."""
    left, stages = rows, {}
    for name, key in keys:
        left = keep_first(left, key, seq).drop("copies")
        stages[name] = left
    return left, stages


def _cuts(place: Column, n: Column, train: float, dev: float) -> Column:
    a = F.floor(n * train)
    b = a + F.floor(n * dev)
    return F.when(place <= a, "train").when(place <= b, "dev").otherwise("internal_test")


def split(rows: DataFrame, key: str, stratum: Column | None = None, train: float = 0.8, dev: float = 0.1, seed: int = 42, buckets: int = 256) -> DataFrame:
    """Add split: floors of the ratios in each stratum, in the order of a seeded hash.

    Places are counted in buckets of the hash and then summed over buckets, so that no
    stratum passes through one task.
    """
    h = F.xxhash64(F.lit(seed), key)
    s = F.lit("all") if stratum is None else F.coalesce(stratum, F.lit("no_entity"))
    placed = rows.withColumns({"_h": h, "_s": s, "_b": F.shiftright(h, 56)})
    sizes = placed.groupBy("_s", "_b").agg(F.count("*").alias("n"))
    w = Window.partitionBy("_s").orderBy("_b")
    ahead = F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("n").over(Window.partitionBy("_s"))
    bases = sizes.select("_s", "_b", ahead.alias("_ahead"), total.alias("_n"))
    place = F.row_number().over(Window.partitionBy("_s", "_b").orderBy("_h", key)) + F.col("_ahead")
    joined = placed.join(bases, ["_s", "_b"]).withColumn("split", _cuts(place, F.col("_n"), train, dev))
    return joined.drop("_h", "_s", "_b", "_ahead", "_n")


def group_components(pairs: DataFrame, max_rounds: int = 40) -> DataFrame:
    """id and group of samples linked through shared values (id, value): smallest id.

    Labels go from samples to their values and back until none changes; each round is two
    aggregations.  Labels are cut from their lineage with checkpoint().
    """
    links = cut(pairs.where("value is not null").distinct())
    label = cut(pairs.select("id").distinct().withColumn("group", F.col("id")))
    for _ in range(max_rounds):
        of_value = links.join(label, "id").groupBy("value").agg(F.min("group").alias("group"))
        offered = links.join(of_value, "value").groupBy("id").agg(F.min("group").alias("new"))
        moved = label.join(offered, "id", "left").withColumn("new", F.least("group", F.coalesce("new", "group")))
        # A label's own label may be smaller still.
        jump = moved.select(F.col("id").alias("group"), F.col("new").alias("far"))
        nxt = moved.select("id", F.col("new").alias("group")).join(jump, "group", "left")
        nxt = cut(nxt.select("id", F.coalesce("far", "group").alias("group")))
        changed = nxt.join(label.withColumnRenamed("group", "old"), "id").where("group <> old").limit(1).count()
        label = nxt
        if not changed:
            return label
    raise RuntimeError(f"labels still change after {max_rounds} rounds")


def split_groups(pairs: DataFrame, train: float = 0.8, dev: float = 0.1, seed: int = 42) -> DataFrame:
    """id, group, split: groups stay whole, and ratios count groups."""
    groups = group_components(pairs)
    parts = split(groups.select("group").distinct(), "group", None, train, dev, seed)
    return groups.join(parts, "group").select("id", "group", "split")


def split_groups_by_type(pairs: DataFrame, train: float = 0.8, dev: float = 0.1, seed: int = 42) -> DataFrame:
    """id, stratum, group, split of samples (id, stratum, value): within each stratum (null:
    no_entity) samples that share a value stay together, and ratios count groups.  Samples
    of different strata never form a group."""
    own = pairs.withColumn("stratum", F.coalesce("stratum", F.lit("no_entity")))
    groups = group_components(own.select("id", F.when(F.col("value").isNotNull(), F.struct("stratum", "value")).alias("value")))
    named = own.select("id", "stratum").distinct().join(groups, "id")
    parts = split(named.select("group", "stratum").distinct(), "group", F.col("stratum"), train, dev, seed)
    return named.join(parts, ["group", "stratum"]).select("id", "stratum", "group", "split")


def candidate_text(entries: DataFrame) -> DataFrame:
    """code and text (code, names and description, joined by bars) of ICD entries."""
    parts = F.filter(F.array("code", "name_en", "name_vi", "description"), lambda x: F.coalesce(x, F.lit("")) != "")
    return entries.select("code", F.array_join(parts, " | ").alias("text"))


def drug_candidate_text(entries: DataFrame) -> DataFrame:
    """rxcui and text of drug entries: name, ingredient, strength, form and brand, with labels."""
    labelled = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label), c))
    strength = F.when(F.col("strength_value").isNotNull(), F.concat_ws(" ", F.col("strength_value").cast("string"), F.coalesce("strength_unit", F.lit("mg"))))
    parts = [
        labelled("RxCUI: ", F.col("rxcui")),
        labelled("", F.col("name_short")),
        labelled("ingredient: ", F.col("ingredient")),
        labelled("strength: ", strength),
        labelled("dose form: ", F.col("dose_form")),
        labelled("brand: ", F.col("brand")),
    ]
    return entries.select("rxcui", F.concat_ws(" | ", *parts).alias("text"))


def _chosen(rows: DataFrame, n: int, order: Column, negative_type: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("id").orderBy(order, "seq"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= n).select("id", "candidate", F.lit(0.0).alias("label"), F.lit(negative_type).alias("negative_type"))


def cross_encoder_icd(samples: DataFrame, entries: DataFrame, n: int = 4, others: bool = True, seed: int = 42) -> DataFrame:
    """id, candidate, text, label, negative_type: training pairs for a cross-encoder.

    samples: id, mention, positive; those whose code is unknown are left out.  entries: the
    ICD knowledge base, fixed and small.  Negatives: of the 2 n entries of the same chapter
    with the most words of the name in common, n by a seeded hash; up to n that have an
    alias or synonym of the right entry that the mention holds; and, with others, n / 2 of
    other chapters (one at least) by a seeded hash.
    """
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+"), lambda w: w != ""))
    terms = F.array_distinct(F.transform(F.concat("aliases", "synonyms"), lambda a: F.btrim(F.lower(a))))
    known = entries.select("code", "seq", F.coalesce("chapter", F.lit("unknown")).alias("chapter"), words(F.col("name_en")).alias("words"), terms.alias("terms"))
    gold = known.select(*(F.col(c).alias(f"g_{c}") for c in known.columns))
    asked = samples.select("id", "mention", "positive").join(F.broadcast(gold), F.col("positive") == F.col("g_code"))
    right = asked.select("id", F.col("positive").alias("candidate"), F.lit(1.0).alias("label"), F.lit("positive").alias("negative_type"))
    paired = asked.join(F.broadcast(known.withColumnRenamed("code", "candidate")), F.col("candidate") != F.col("positive"))
    chance = F.xxhash64(F.lit(seed), "id", "candidate")
    alike = F.size(F.array_intersect("words", "g_words")) / F.greatest(F.size("words"), F.size("g_words"), F.lit(1))
    near = paired.where("chapter = g_chapter")
    first = F.row_number().over(Window.partitionBy("id").orderBy(F.desc(alike), "seq"))
    near = _chosen(near.withColumn("first", first).where(F.col("first") <= 2 * n), n, chance, "hard_same_chapter")
    said = F.filter("g_terms", lambda t: (t != "") & F.contains(F.lower("mention"), t))
    shared = F.array_min(F.transform(F.array_intersect(said, F.col("terms")), lambda t: F.array_position(said, t)))
    named = _chosen(paired.withColumn("shared", shared).where("shared is not null"), n, F.col("shared"), "hard_same_alias")
    out = right.unionByName(near).unionByName(named)
    if others:
        out = out.unionByName(_chosen(paired.where("chapter <> g_chapter"), max(1, n // 2), chance, "random"))
    return out.join(F.broadcast(candidate_text(entries).withColumnRenamed("code", "candidate")), "candidate").select("id", "candidate", "text", "label", "negative_type")


def cross_encoder_drugs(samples: DataFrame, entries: DataFrame, n: int = 4, seed: int = 42) -> DataFrame:
    """As cross_encoder_icd, for drugs: negatives are the first n other entries of the same
    ingredient, and n / 2 of other ingredients (one at least) by a seeded hash."""
    known = entries.select("rxcui", "seq", F.btrim(F.lower(F.coalesce("ingredient", F.lit("")))).alias("ing"))
    gold = known.select(F.col("rxcui").alias("g_code"), F.col("ing").alias("g_ing"))
    asked = samples.select("id", "positive").join(F.broadcast(gold), F.col("positive") == F.col("g_code"))
    right = asked.select("id", F.col("positive").alias("candidate"), F.lit(1.0).alias("label"), F.lit("positive").alias("negative_type"))
    paired = asked.join(F.broadcast(known.withColumnRenamed("rxcui", "candidate")), F.col("candidate") != F.col("positive"))
    same = _chosen(paired.where("ing = g_ing and ing <> ''"), n, F.col("seq"), "hard_same_ingredient")
    other = _chosen(paired.where("ing <> g_ing"), max(1, n // 2), F.xxhash64(F.lit(seed), "id", "candidate"), "random")
    texts = F.broadcast(drug_candidate_text(entries).withColumnRenamed("rxcui", "candidate"))
    return right.unionByName(same).unionByName(other).join(texts, "candidate").select("id", "candidate", "text", "label", "negative_type")


def profile(rows: DataFrame, *by: str, value: str = "n_chars") -> DataFrame:
    """Count, smallest, largest, mean, median and sample deviation (0 for one row) of a column."""
    v = F.col(value)
    stats = [
        F.count("*").alias("n"),
        F.min(v).alias("low"),
        F.max(v).alias("high"),
        F.round(F.avg(v), 4).alias("mean"),
        F.round(F.median(v), 4).alias("median"),
        F.round(F.coalesce(F.stddev_samp(v), F.lit(0.0)), 4).alias("deviation"),
    ]
    return rows.groupBy(*by).agg(*stats)


def upper_case(text: Column) -> Column:
    return F.upper(text)


def title_case(text: Column) -> Column:
    return F.array_join(F.transform(F.split(text, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.char_length(w))))), " ")


def tidy_punctuation(text: Column) -> Column:
    """No blanks after full stops, one after commas, semicolons and colons, blanks squeezed."""
    out = F.regexp_replace(text, r"\.\s*", ".")
    for mark in ",;:":
        out = F.regexp_replace(out, rf"{mark}\s*", f"{mark} ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def close_sentence(text: Column) -> Column:
    return F.when(F.rlike(text, F.lit(r"\.\s*$")), text).otherwise(F.concat(text, F.lit(".")))


def drop_last_stop(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r"\.\s*$", ""))


def double_blanks(text: Column) -> Column:
    return F.array_join(F.filter(F.split(text, r"\s+"), lambda w: w != ""), "  ")


def without_blanks(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", "")


def plain_letters(text: Column) -> Column:
    """Vietnamese letters without marks, đ as d."""
    from ..functions.normalize import remove_tones

    return F.translate(remove_tones(text), "đĐ", "dD")


def _pick(n: Column, seed: int, *key: str) -> Column:
    """A seeded number from 0 to n - 1."""
    return F.pmod(F.xxhash64(F.lit(seed), *key), n).cast("int")


def typo(text: Column, kind: str, seed: int, key: str) -> Column:
    """One typing error at a place that the hash of key decides: insertion, deletion, swap or keyboard."""
    n = F.char_length(text)
    at = _pick(F.greatest(n - (1 if kind == "swap" else 0), F.lit(1)), seed, key)
    head, here, rest = F.substring(text, F.lit(1), at), F.substring(text, at + 1, F.lit(1)), F.substring(text, at + 2, n)
    letters = "abcdefghijklmnopqrstuvwxyzăâđêôơư"
    if kind == "insertion":
        letter = F.substring(F.lit(letters), _pick(F.lit(len(letters)), seed + 1, key) + 1, F.lit(1))
        return F.concat(head, letter, here, rest)
    if kind == "deletion":
        return F.when(n > 1, F.concat(head, rest)).otherwise(text)
    if kind == "swap":
        return F.when(n > 2, F.concat(head, F.substring(rest, 1, 1), here, F.substring(rest, F.lit(2), n))).otherwise(text)
    near = F.create_map(*(F.lit(x) for c, own in V.KEYBOARD_NEIGHBOURS.items() for x in (c, "".join(own))))
    own = F.try_element_at(near, F.lower(here))
    other = F.substring(own, _pick(F.char_length(own), seed + 1, key) + 1, F.lit(1))
    cased = F.when(F.lower(here) != here, F.upper(other)).otherwise(other)
    return F.when(own.isNotNull(), F.concat(head, cased, rest)).otherwise(text)


@F.arrow_udf(StringType())
def compose(texts: pa.Array) -> pa.Array:
    """Unicode NFC."""
    return pa.array([unicodedata.normalize("NFC", t) if t is not None else None for t in texts.to_pylist()], pa.string())


def with_pronoun(text: Column, seed: int, key: str) -> Column:
    pronouns = F.array(*map(F.lit, V.PATIENT_PRONOUNS))
    one = F.get(pronouns, _pick(F.lit(len(V.PATIENT_PRONOUNS)), seed, key))
    known = F.rlike(text, F.lit(r"^\s*(Bệnh|BN|Người)(\s|$)"))
    return F.when(known | (text == ""), text).otherwise(F.concat(one, F.lit(" "), F.lower(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.char_length(text))))


def diacritic_error(text: Column, rate: float, seed: int, key: str) -> Column:
    """Letters with marks, each with probability rate, as another variant of theirs; which
    ones is decided by hashes of key and place."""
    variants = F.create_map(*(F.lit(x) for c, own in V.DIACRITIC_VARIANTS.items() for x in (c, "".join(o for o in own if o != c))))
    hashed = lambda k, i: F.xxhash64(F.lit(seed + k), F.col(key), i)

    def one(c: Column, i: Column) -> Column:
        own = F.try_element_at(variants, c)
        hit = F.pmod(hashed(0, i), F.lit(1_000_000)) < round(rate * 1_000_000)
        other = F.substring(own, (F.pmod(hashed(1, i), F.char_length(own)) + 1).cast("int"), F.lit(1))
        return F.when(own.isNotNull() & (own != "") & hit, other).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def paraphrase(text: Column, seed: int, key: str) -> Column:
    """Known words, whatever their case, as one of their paraphrases, one word after the
    other; a word is looked for as it is spelled."""
    for k, (word, options) in enumerate(V.PARAPHRASES.items()):
        other = F.get(F.array(*map(F.lit, options)), _pick(F.lit(len(options)), seed + k, key))
        text = F.when(F.contains(text, F.lit(word)), F.regexp_replace(text, F.lit(f"(?iu){word}"), other)).otherwise(text)
    return text


def relocate(text: Column, entities: Column) -> Column:
    """Entities at the first place of their texts in a changed text; those it lacks go."""
    found = F.transform(entities, lambda e: F.struct((F.call_function("locate", e["text"], text) - 1).alias("start"), e["text"].alias("text"), e["type"].alias("type")))
    return F.transform(
        F.filter(found, lambda e: e["start"] >= 0), lambda e: F.struct(e["start"], (e["start"] + F.char_length(e["text"])).alias("end"), e["text"], e["type"])
    )


def fill_templates(spark: SparkSession, templates: Sequence[str], slot: str, values: Sequence[str], kind: str, n: int, seed: int = 42) -> DataFrame:
    """n samples: a template with its {slot} filled, and where the value stands."""
    rows = spark.range(n).withColumns(
        {
            "template": F.get(F.array(*map(F.lit, templates)), _pick(F.lit(len(templates)), seed, "id")),
            "value": F.get(F.array(*map(F.lit, values)), _pick(F.lit(len(values)), seed + 1, "id")),
        }
    )
    text = F.replace(F.col("template"), F.lit("{" + slot + "}"), F.col("value"))
    start = F.call_function("locate", F.col("value"), text) - 1
    entity = F.struct(start.alias("start"), (start + F.char_length("value")).alias("end"), F.col("value").alias("text"), F.lit(kind).alias("type"))
    return rows.select("id", text.alias("text"), F.array(entity).alias("entities"))


def fill_slots(spark: SparkSession, templates: Sequence[str], slots: Mapping[str, tuple[Sequence[str], str | None]], n: int, seed: int = 42) -> DataFrame:
    """n samples (id, text, entities) of templates with any number of {slots}.

    slots: values and entity type by name; a slot without a type makes no entity, one that
    is not known stays as it is.  Each place draws its own value, by a seeded hash.
    """

    def build(template: str) -> Column:
        pieces, at, texts, found = re.split(r"\{(\w+)\}", template), F.lit(0), [], []
        for k, piece in enumerate(pieces):
            values, kind = slots.get(piece, ([], None)) if k % 2 else ([piece], None)
            own = F.get(F.array(*map(F.lit, values)), _pick(F.lit(len(values)), seed + 1 + k, "id")) if values else F.lit("{" + piece + "}")
            end = at + F.char_length(own)
            if kind:
                found.append(F.struct(at.alias("start"), end.alias("end"), own.alias("text"), F.lit(kind).alias("type")))
            texts.append(own)
            at = end
        none = F.array().cast("array<struct<start:int,end:int,text:string,type:string>>")
        return F.struct(F.concat(*texts).alias("text"), F.concat(none, F.array(*found)).alias("entities") if found else none.alias("entities"))

    turn, made = _pick(F.lit(len(templates)), seed, "id"), F.lit(None)
    for k, template in enumerate(templates):
        made = F.when(turn == k, build(template)).otherwise(made)
    return spark.range(n).select("id", made.alias("s")).select("id", "s.text", "s.entities")


def linking_samples(spark: SparkSession, entries: DataFrame, contexts: Sequence[str], n: int, negatives: int = 4, seed: int = 42) -> DataFrame:
    """n samples of id, query_text, mention, positive, negatives.

    entries: code, family, mentions.  Negatives come from the same family first, then from
    the others, by a seeded hash.
    """
    known = entries.withColumn("place", F.row_number().over(Window.orderBy("code")) - 1)  # a knowledge base: few rows
    size = known.count()
    drawn = spark.range(n).withColumn("place", _pick(F.lit(size), seed, "id")).join(F.broadcast(known), "place")
    mention = F.get("mentions", _pick(F.size("mentions"), seed + 1, "id"))
    context = F.get(F.array(*map(F.lit, contexts)), _pick(F.lit(len(contexts)), seed + 2, "id"))
    drawn = drawn.select("id", F.col("code").alias("positive"), "family", mention.alias("mention"), context.alias("context"))
    others = known.select(F.col("code").alias("other"), F.col("family").alias("other_family"))
    paired = drawn.join(F.broadcast(others), F.col("positive") != F.col("other"))
    order = F.struct(F.when(F.col("family") == F.col("other_family"), 0).otherwise(1), F.xxhash64(F.lit(seed), "id", "other"), "other")
    rejected = F.slice(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["other"]), 1, negatives)
    made = paired.groupBy("id", "positive", "mention", "context").agg(rejected.alias("negatives"))
    text = F.regexp_replace(F.col("context"), r"\{[a-z_]+\}", "\u0001")
    return made.select("id", F.replace(text, F.lit("\u0001"), F.col("mention")).alias("query_text"), "mention", "positive", "negatives")
