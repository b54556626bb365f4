"""Search views of clinical text: normalisers and the drug parser, as column expressions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping
from functools import cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .fixed_values import ABBREVIATIONS, BRAND_ALIASES, BRAND_INDICATORS, DOSE_FORMS, INGREDIENT_SYNONYMS, SYNONYMS

DASHES = "‐‑‒–—―−"


def squeeze_blanks(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", "")


def dashes_to_blanks(text: Column) -> Column:
    return F.translate(text, DASHES + "-", " " * (len(DASHES) + 1))


@cache
def _marks() -> tuple[str, str]:
    """Precomposed Latin letters whose decomposition is one letter and marks, and these letters."""
    plain = []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        parts = unicodedata.normalize("NFD", chr(code))
        base = [c for c in parts if unicodedata.category(c) != "Mn"]
        if len(parts) > 1 and len(base) == 1:
            plain.append((chr(code), base[0]))
    return "".join(a for a, _ in plain), "".join(b for _, b in plain)


def remove_tones(text: Column) -> Column:
    """Letters without their marks; đ has none to lose."""
    found, plain = _marks()
    return F.translate(F.regexp_replace(text, r"\p{Mn}", ""), found, plain)


def expand(text: Column, *dictionaries: Mapping[str, str]) -> Column:
    """Replace whole terms one after the other; each pass sees what those before it made.

    That is a fold over a hundred patterns, each applied to the last one's result: as nested
    expressions it outgrows generated code, so it is one Arrow function.
    """

    @F.arrow_udf(StringType())
    def rewrite(texts: pa.Array) -> pa.Array:
        rules = [(re.compile(rf"\b{re.escape(term)}\b"), other) for terms in dictionaries for term, other in terms.items()]
        out = []
        for t in texts.to_pylist():
            if t is not None:
                t = t.lower()
                for rule, other in rules:
                    t = rule.sub(lambda _, other=other: other, t)
            out.append(t)
        return pa.array(out, pa.string())

    return rewrite(text)


def _tidy(text: Column) -> Column:
    return squeeze_blanks(dashes_to_blanks(F.lower(F.coalesce(text, F.lit("")))))


def for_alias(text: Column) -> Column:
    return expand(_tidy(text), ABBREVIATIONS)


def normalize(text: Column) -> Column:
    return expand(_tidy(text), ABBREVIATIONS, SYNONYMS)


def for_fuzzy(text: Column) -> Column:
    return remove_tones(normalize(text))


def drug_for_matching(text: Column) -> Column:
    return expand(_tidy(text), BRAND_ALIASES)


def normalize_drug(text: Column) -> Column:
    return expand(F.regexp_replace(_tidy(text), r"(\d+),(\d+)", "$1.$2"), BRAND_ALIASES, INGREDIENT_SYNONYMS)


DRUG = "struct<original:string,ingredients:array<string>,strength_values:array<double>,strength_units:array<string>,dose_form:string,brand:string>"
_STRENGTH = re.compile(r"(\d+(?:[.,]\d+)?)\s*(mg|g|ml|mcg|iu|%)", re.IGNORECASE)
_FORMS = [(term, re.compile(rf"\b{term}\b"), form) for term, form in DOSE_FORMS.items()]
_COUNTED = re.compile(r"^(viên|tablet|capsule|mg|g|ml)\s+", re.IGNORECASE)


def drug_of(text: str | None) -> dict | None:
    """The parts of a drug mention: all strengths, the first known form, the ingredients in
    front of the first strength and form, and what follows a word for brands."""
    text = (text or "").strip()
    if not text:
        return None
    low, found = text.lower(), list(_STRENGTH.finditer(text))
    form = next((f for _, rule, f in _FORMS if rule.search(low)), None)
    head = (text[: found[0].start()] if found else text).strip(" ")
    places = [p for term, _, _ in _FORMS if (p := head.lower().find(term)) >= 0]
    if form and places:
        head = head[: min(places)].strip(" ")
    mark = next((m for m in "+/&" if m in head), None)
    parts = (re.sub(r"^[0-9]+\s*$", "", p.strip(" ")).strip(" ") for p in (head.split(mark) if mark else [head]))
    brand = next((text[p:].strip(" ") for w in BRAND_INDICATORS if (p := low.find(w)) >= 0), None)
    return {
        "original": text,
        "ingredients": [p for p in (_COUNTED.sub("", p).strip(" ") for p in parts) if p],
        "strength_values": [float(m[1].replace(",", ".")) for m in found],
        "strength_units": [m[2].upper() for m in found],
        "dose_form": form,
        "brand": brand,
    }


def parse_drug(text: Column) -> Column:
    """Struct original, ingredients, strength_values, strength_units, dose_form, brand; null
    without text.  Each part depends on those before it, which as nested expressions takes
    longer to compile than to run, so it is one Arrow function."""

    @F.arrow_udf(DRUG)
    def parse(texts: pa.Array) -> pa.Array:
        names = pa.list_(pa.string())
        kind = pa.struct([("original", pa.string()), ("ingredients", names), ("strength_values", pa.list_(pa.float64())), ("strength_units", names), ("dose_form", pa.string()), ("brand", pa.string())])
        return pa.array([drug_of(t) for t in texts.to_pylist()], kind)

    return parse(text)
