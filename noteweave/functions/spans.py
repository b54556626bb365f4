"""Regex matches with offsets, interval algebra and folds over spans, as column expressions.

Offsets are 0-based code points, ends exclusive.  A span is a struct of start, end, text,
type, confidence and source; spans of a document are an array, so that finding, filtering
and resolving them needs no shuffle.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,text:string,type:string,confidence:double,source:string>"
#: Which type wins, most specific first.
TYPE_PRIORITY = {"THUỐC": 5, "CHẨN_ĐOÁN": 4, "TRIỆU_CHỨNG": 3, "KẾT_QUẢ_XÉT_NGHIỆM": 2, "TÊN_XÉT_NGHIỆM": 1}


def unicode_pattern(pattern: str) -> str:
    """Case-insensitive, with Unicode classes and boundaries."""
    return f"(?iU){pattern}"


def find_spans(text: Column, pattern: str, groups: int = 0) -> Column:
    """All matches of a literal pattern that never matches nothing: an array of structs
    start, end, text and g1, g2, ...; null text gives an empty array."""
    whole = F.coalesce(text, F.lit(""))
    names = ["text", *(f"g{k}" for k in range(1, groups + 1))]
    found = [F.regexp_extract_all(whole, F.lit(pattern), F.lit(k)) for k in range(groups + 1)]
    gaps = F.transform(F.split(whole, pattern, -1), F.char_length)
    rows = F.arrays_zip(*(f.alias(n) for f, n in zip(found, names, strict=True)))
    # start of match i: the gaps up to it, and the matches before it.
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + pair["gap"]
        return F.struct((start + pair["size"]).alias("at"), F.concat(state["starts"], F.array(start)).alias("starts"))

    sizes = F.transform(found[0], F.char_length)
    pairs = F.arrays_zip(F.slice(gaps, 1, F.size(sizes)).alias("gap"), sizes.alias("size"))
    starts = F.aggregate(pairs, zero, step, lambda s: s["starts"])

    def row(x: Column, i: Column) -> Column:
        start = F.get(starts, i)
        end = start + F.char_length(x["text"])
        return F.struct(start.alias("start"), end.alias("end"), *(x[n].alias(n) for n in names))

    return F.when(F.size(found[0]) > 0, F.transform(rows, row)).otherwise(F.transform(F.slice(rows, 1, 0), row))


def span(start: Column, end: Column, text: Column, kind: Column | str, confidence: Column | float, source: str) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    confidence = F.lit(confidence) if isinstance(confidence, float) else confidence
    return F.struct(
        start.cast("int").alias("start"),
        end.cast("int").alias("end"),
        text.alias("text"),
        kind.alias("type"),
        confidence.cast("double").alias("confidence"),
        F.lit(source).alias("source"),
    )


def piece(text: Column, start: Column, end: Column) -> Column:
    """text[start:end]."""
    return F.substring(text, start + 1, F.greatest(F.lit(0), end - start))


def before(text: Column, start: Column, width: int) -> Column:
    """Up to width characters in front of start."""
    low = F.greatest(F.lit(0), start - width)
    return piece(text, low, start)


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def contains(a: Column, b: Column) -> Column:
    return (a["start"] <= b["start"]) & (b["end"] <= a["end"])


def intersection(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a["end"], b["end"]) - F.greatest(a["start"], b["start"]))


def hull_iou(a: Column, b: Column) -> Column:
    """Intersection over the hull of both."""
    hull = F.greatest(a["end"], b["end"]) - F.least(a["start"], b["start"])
    return F.when(hull > 0, intersection(a, b) / hull).otherwise(F.lit(0.0))


def gap_between(a: Column, b: Column) -> Column:
    """Characters between a and the span b, on the side where a lies."""
    return F.when(a["start"] >= b["end"], F.abs(a["start"] - b["end"])).otherwise(F.abs(b["start"] - a["end"]))


def _is_near(start: int, end: int, starts: list[int], ends: list[int], reach: int) -> int | None:
    """0 if `gap_between` is at most reach for one of the others, which are in order and apart."""
    k = bisect_right(ends, start)
    if k and start - ends[k - 1] <= reach:
        return 0
    j = bisect_left(starts, end - reach, k)
    return 0 if j < len(starts) and starts[j] <= end + reach else None


def _last_end(start: int, end: int, starts: list[int], ends: list[int], reach: int) -> int | None:
    """The last end of the others at or before start, if it is at most reach away."""
    k = bisect_right(ends, start)
    return ends[k - 1] if k and start - ends[k - 1] <= reach else None


def _beside(text: Column, pattern: str, other: str, reach: int, meet: Callable[..., int | None]) -> Column:
    """start and meet()'s number of the matches for which there is one.  One Arrow function
    finds both patterns once and searches by bisection, so a text takes time in proportion;
    as column expressions, the other pattern is matched again for each match."""

    @F.arrow_udf("array<struct<start:int,other:int>>")
    def find(texts: pa.Array) -> pa.Array:
        own, others = re.compile(pattern), re.compile(other)
        sizes, at, numbers = [0], [], []
        for t in texts.to_pylist():
            found = [m.span() for m in own.finditer(t)] if t else []
            spans = [m.span() for m in others.finditer(t)] if found else []
            if spans:
                starts, ends = ([x[k] for x in spans] for k in (0, 1))
                for a, b in found:
                    number = meet(a, b, starts, ends, reach)
                    if number is not None:
                        at.append(a)
                        numbers.append(number)
            sizes.append(len(at))
        rows = pa.StructArray.from_arrays([pa.array(at, pa.int32()), pa.array(numbers, pa.int32())], ["start", "other"])
        return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), rows)

    return find.asNondeterministic()(text)  # else a filter on the result would compute it twice


def near_spans(text: Column, pattern: str, other: str, reach: int) -> Column:
    """Matches (start) with a `gap_between` of at most reach to a match of the other pattern.
    Patterns mean the same to Python and never match nothing; null text has no matches."""
    return _beside(text, pattern, other, reach, _is_near)


def spans_after(text: Column, pattern: str, other: str, reach: int) -> Column:
    """Matches (start) that follow a match of the other pattern by at most reach, with the
    nearest one's end (other)."""
    return _beside(text, pattern, other, reach, _last_end)


def in_order(spans: Column) -> Column:
    """Sorted by start, then longest first, then by place in the array."""
    keyed = F.transform(spans, lambda x, i: F.struct(x["start"].alias("a"), (-x["end"]).alias("b"), i.alias("c"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda k: k["x"])


def keep_longest(spans: Column, kind: str) -> Column:
    """In order; a span that overlaps the last one kept replaces it if it is longer."""

    def step(kept: Column, x: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        longer = x["end"] - x["start"] > last["end"] - last["start"]
        clash = last.isNotNull() & (x["start"] < last["end"])
        head = F.slice(kept, 1, F.greatest(F.lit(0), F.size(kept) - 1))
        return F.when(clash & longer, F.concat(head, F.array(x))).when(clash, kept).otherwise(F.concat(kept, F.array(x)))

    return F.aggregate(in_order(spans), F.array().cast(f"array<{kind}>"), step)


def _score(x: Column, strategy: str, priority: dict[str, int]) -> Column:
    rank = F.lit(0)
    for k, v in priority.items():
        rank = F.when(x["type"] == k, v).otherwise(rank)
    length, confidence = x["end"] - x["start"], x["confidence"]
    parts = {"longest": [length], "confidence": [confidence], "type_priority": [rank], "hybrid": [length, confidence, rank]}
    return F.struct(*(p.cast("double").alias(f"s{k}") for k, p in enumerate(parts.get(strategy, [F.lit(0)]))))


def resolve_anchored(spans: Column, strategy: str = "hybrid", priority: dict[str, int] | None = None) -> Column:
    """One winner for each group of spans that overlap the group's first span.

    Groups are runs in order, not chains: a span that overlaps only a later member opens
    a new group.  Of equal scores the first wins.
    """
    order = TYPE_PRIORITY if priority is None else priority
    none = F.lit(None).cast(SPAN)
    zero = F.struct(F.array().cast(f"array<{SPAN}>").alias("out"), none.alias("anchor"), none.alias("best"))

    def step(s: Column, x: Column) -> Column:
        same = s["anchor"].isNotNull() & overlaps(s["anchor"], x)
        better = _score(x, strategy, order) > _score(s["best"], strategy, order)
        done = F.when(s["anchor"].isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(s["best"])))
        return F.struct(
            F.when(same, s["out"]).otherwise(done).alias("out"),
            F.when(same, s["anchor"]).otherwise(x).alias("anchor"),
            F.when(same, F.when(better, x).otherwise(s["best"])).otherwise(x).alias("best"),
        )

    finish = lambda s: F.when(s["anchor"].isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(s["best"])))
    return F.aggregate(in_order(spans), zero, step, finish)


def merge_adjacent(spans: Column) -> Column:
    """Join touching spans of one type: lowest confidence, source `merged`, texts with a blank."""

    def step(kept: Column, x: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        touch = last.isNotNull() & (last["end"] == x["start"]) & (last["type"] == x["type"])
        joined = span(last["start"], x["end"], F.concat_ws(" ", last["text"], x["text"]), x["type"], F.least(last["confidence"], x["confidence"]), "merged")
        head = F.slice(kept, 1, F.greatest(F.lit(0), F.size(kept) - 1))
        return F.when(touch, F.concat(head, F.array(joined))).otherwise(F.concat(kept, F.array(x)))

    return F.aggregate(spans, F.array().cast(f"array<{SPAN}>"), step)


def resolve_spans(spans: Column, strategy: str = "hybrid", priority: dict[str, int] | None = None) -> Column:
    return merge_adjacent(resolve_anchored(spans, strategy, priority))


def flat(parts: Sequence[Column]) -> Column:
    return F.concat(*parts)


def _quoted(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def constant_array(items: Sequence[str]) -> Column:
    """An array of strings, parsed as one expression: a call for each item would take longer
    than the query."""
    return F.expr("array(" + ", ".join(map(_quoted, items)) + ")")


def constant_map(items: Mapping[str, str]) -> Column:
    return F.expr("map(" + ", ".join(_quoted(x) for pair in items.items() for x in pair) + ")")


def holds_any(text: Column, items: Sequence[str]) -> Column:
    """Whether a text holds one of the items."""
    return F.exists(constant_array(items), lambda x: F.contains(text, x))


def any_of(items: Sequence[str], test: Callable[[str], Column]) -> Column:
    out = F.lit(False)
    for x in items:
        out = out | test(x)
    return out
