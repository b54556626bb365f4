"""Lab, drug and disease scans: arrays of matches of each document, without a shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.scan import RuleSet
from ..functions.spans import before, constant_map, flat, gap_between, holds_any, keep_longest, overlaps, piece, unicode_pattern

NUMBER = r"\d+(?:[.,]\d+)?"
DOSE = rf"{NUMBER}\s*(?:mg|g|ml|mcg|iu|%)"
#: Patterns.  The empty alternative among the units is part of the rule:
#: units behind it never match.
RULES = RuleSet(
    {
        "lab_name": rf"\b({'|'.join(V.LAB_TEST_NAMES)})\b",
        **{f"lab_phrase{k}": p for k, (p, _) in enumerate(V.LAB_PHRASES)},
        "lab_value": rf"({NUMBER})\s*(?:[-–]\s*({NUMBER}))?\s*(%|g\/dL|g\/L|mg\/dL|mg\/L|mmol\/L|mmol\/l|u\/L|u\/l|IU\/L|ng\/mL|pg\/mL|mg\/mL||UNT|%|mEq\/L)?",
        "drug_dose": rf"\b([A-Za-z]+(?:\s+[A-Za-z]+)?)\s+({DOSE})\b",
        "drug_known": rf"\b({'|'.join(V.COMMON_DRUGS)})(?:\s+{DOSE})?\b",
        **{f"drug_context{k}": p for k, p in enumerate(V.DRUG_CONTEXTS)},
        "disease": "|".join([*V.DISEASE_KEYWORDS, *V.ENGLISH_DISEASES]),
    }
)
DIAGNOSTIC = unicode_pattern("|".join(V.DIAGNOSTIC_MARKERS))
NEAR = 50
PANEL_GAP = 20
LOOK_BACK = 100
DRUG = "struct<start:int,end:int,text:string,ingredient:string,strength:string,confidence:double>"
DISEASE = "struct<start:int,end:int,text:string,context:string,is_diagnosed:boolean,confidence:double>"


def lab_tests(matches: Column) -> Column:
    """start, end, text, normalized_name; names first, then phrases, repeats kept."""
    names = constant_map(V.LAB_SYNONYMS)

    def named(found: Column, name: Callable[[Column], Column]) -> Column:
        return F.transform(found, lambda x: F.struct(x["start"], x["end"], x["text"], name(x).alias("normalized_name")))

    own = named(RULES.of(matches, "lab_name"), lambda x: F.coalesce(F.try_element_at(names, F.lower(x["text"])), x["text"]))
    return flat([own, *RULES.each(matches, "lab_phrase", lambda found, k: named(found, lambda x: F.lit(V.LAB_PHRASES[k][1])))])


def lab_results(text: Column, matches: Column, tests: Column, near: int = NEAR, fix_units: bool = False) -> Column:
    """start, end, text, value, unit, is_abnormal of numbers within `near` characters of a test.

    The unit is the upper bound of a range, as the rule has it; fix_units gives the unit.
    """
    spans = F.filter(RULES.of(matches, "lab_value"), lambda r: F.exists(tests, lambda t: gap_between(r, t) <= near))

    def row(r: Column) -> Column:
        after = F.upper(F.substring(text, r["end"] + 1, F.lit(5)))
        unit = r["groups"][2 if fix_units else 1]
        return F.struct(
            r["start"],
            r["end"],
            r["text"],
            F.replace(r["groups"][0], F.lit(","), F.lit(".")).cast("double").alias("value"),
            F.when(unit != "", unit).alias("unit"),
            F.rlike(after, F.lit("[HL*]")).alias("is_abnormal"),
        )

    return F.transform(spans, row)


def lab_panel(tests: Column, results: Column, gap: int = PANEL_GAP) -> Column:
    """An as-of join inside the row: each result with the nearest test that ends before it
    (of equal gaps the first), if closer than `gap`: normalized_name and the result."""

    def nearest(r: Column) -> Column:
        gaps = F.transform(tests, lambda t, i: F.struct((r["start"] - t["end"]).alias("gap"), i.alias("i"), t["normalized_name"].alias("name")))
        return F.array_min(F.filter(gaps, lambda g: g["gap"] >= 0))

    rows = F.transform(results, lambda r: F.struct(nearest(r).alias("test"), r.alias("result")))
    close = F.filter(rows, lambda x: x["test"]["gap"] < gap)
    return F.transform(close, lambda x: F.struct(x["test"]["name"].alias("normalized_name"), x["result"].alias("result")))


def _drug(start: Column, end: Column, text: Column, ingredient: Column, strength: Column, confidence: float) -> Column:
    return F.struct(
        start.alias("start"),
        end.alias("end"),
        text.alias("text"),
        ingredient.alias("ingredient"),
        strength.cast("string").alias("strength"),
        F.lit(confidence).alias("confidence"),
    )


def _add_free(found: Column, more: Column) -> Column:
    """found, and those of more, in turn, that overlap nothing so far."""
    return F.aggregate(more, found, lambda kept, x: F.when(F.exists(kept, lambda k: overlaps(k, x)), kept).otherwise(F.concat(kept, F.array(x))))


def drugs(text: Column, matches: Column, fix_ends: bool = False) -> Column:
    """start, end, text, ingredient, strength, confidence: names with a dose, then known
    names, then words after a drug context; longest of what overlaps.

    Ends of the third kind leave out blanks after the context, as the rule has it;
    fix_ends puts them right.
    """
    none = F.lit(None).cast("string")
    dosed = F.filter(RULES.of(matches, "drug_dose"), lambda x: F.char_length(F.btrim(x["groups"][0])) >= 4)
    first = F.transform(dosed, lambda x: _drug(x["start"], x["end"], x["text"], F.btrim(x["groups"][0]), x["groups"][1], 0.9))
    known = F.transform(RULES.of(matches, "drug_known"), lambda x: _drug(x["start"], x["end"], x["text"], x["groups"][0], none, 0.85))

    def named(x: Column) -> Column:
        rest = F.substring(text, x["end"] + 1, F.lit(50))
        name = F.regexp_extract(rest, r"(?U)^\s*([A-Za-z]+(?:\s+[A-Za-z]+)?)", 1)
        skipped = F.char_length(F.regexp_extract(rest, r"(?U)^\s*", 0)) if fix_ends else F.lit(0)
        end = x["end"] + skipped + F.char_length(name)
        return _drug(x["start"], end, piece(text, x["start"], end), name, none, 0.8)

    after = flat(RULES.each(matches, "drug_context", lambda found, k: F.transform(found, named)))
    after = F.filter(after, lambda x: F.char_length(x["ingredient"]) >= 4)
    rest = F.concat(known.cast(f"array<{DRUG}>"), after.cast(f"array<{DRUG}>"))
    return keep_longest(_add_free(first.cast(f"array<{DRUG}>"), rest), DRUG)


def drug_parts(text: Column) -> Column:
    """First dose, route and frequency of a mention, and what stands before the dose."""
    dose = F.regexp_extract(text, unicode_pattern(rf"({NUMBER})\s*(mg|g|ml|mcg|iu|%)"), 0)
    route = F.regexp_extract(text, unicode_pattern(r"\b(po|oral|ngậm|tiêm|ở|tại)\b"), 1)
    often = F.regexp_extract(text, unicode_pattern(r"\b(q\d+h?|qd|bid|tid|qid|daily|ngày|ngày\s*\d+|lần|tối|sáng|chiều|prn|tùy\s*tình\s*trạng)\b"), 1)
    at = F.call_function("locate", dose, text)
    ingredient = F.when(dose != "", F.btrim(F.substring(text, F.lit(1), at - 1)))
    return F.struct(
        ingredient.alias("ingredient"),
        F.when(dose != "", dose).alias("strength"),
        F.when(route != "", route).alias("route"),
        F.when(often != "", often).alias("frequency"),
    )


def mention_context(back: Column, own: Column) -> Column:
    """CHẨN_ĐOÁN or TRIỆU_CHỨNG, by the first rule that fits; back: what stands before a
    mention, own: the mention, both lower-cased."""
    tail = F.substring(back, F.greatest(F.lit(1), F.char_length(back) - 14), F.lit(15))
    return (
        F.when(F.rlike(back, F.lit(DIAGNOSTIC)), "CHẨN_ĐOÁN")
        .when(holds_any(own, V.KNOWN_DIAGNOSES), "CHẨN_ĐOÁN")
        .when(holds_any(back, V.SYMPTOM_MARKERS), "TRIỆU_CHỨNG")
        .when(holds_any(tail, V.SYMPTOM_WORDS), "TRIỆU_CHỨNG")
        .when(holds_any(back, ["loại trừ", "không"]), "CHẨN_ĐOÁN")
        .otherwise("TRIỆU_CHỨNG")
    )


def diseases(text: Column, matches: Column) -> Column:
    """start, end, text, context, is_diagnosed, confidence; keywords also match inside words."""

    # In stages: the text in front of a mention is cut out once, not for each marker.
    def cut(x: Column) -> Column:
        back = F.lower(before(text, x["start"], LOOK_BACK))
        return F.struct(x.alias("x"), back.alias("back"), F.lower(x["text"]).alias("own"))

    def judge(c: Column) -> Column:
        diagnosed = holds_any(c["back"], V.DIAGNOSED_MARKERS)
        return F.struct(c["x"], mention_context(c["back"], c["own"]).alias("context"), diagnosed.alias("is_diagnosed"))

    def row(j: Column) -> Column:
        x = j["x"]
        sure = F.when(j["context"] == "TRIỆU_CHỨNG", 0.8).otherwise(0.9)
        return F.struct(x["start"], x["end"], F.btrim(x["text"]).alias("text"), j["context"], j["is_diagnosed"], sure.alias("confidence"))

    found = F.transform(F.transform(F.transform(RULES.of(matches, "disease"), cut), judge), row)
    return keep_longest(found.cast(f"array<{DISEASE}>"), DISEASE)
