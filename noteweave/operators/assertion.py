"""Sentences, clauses, cues and the three assertions of an entity."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.scan import RuleSet
from ..functions.spans import flat, piece

CLAUSE = "struct<start:int,end:int,kind:string>"
#: Cues by priority, as they are looked for.
CUES = sorted(V.CUES, key=lambda c: -c[2])
RULES = RuleSet(
    {
        **{f"cue{k}": pattern for k, (pattern, _, _) in enumerate(CUES)},
        **{f"conjunction{k}": pattern for k, (pattern, _) in enumerate(V.CONJUNCTIONS)},
        "delimiter": "|".join(V.DELIMITERS),
        "header": r"(?m:^)[ \t]*\d+[\.\)][ \t]+",
    }
)


def cues(matches: Column) -> Column:
    """start, number, end, text, kind, priority of all cues, overlaps kept: by start, then priority."""

    def found(own: Column, k: int) -> Column:
        facts = [F.lit(CUES[k][1]).alias("kind"), F.lit(CUES[k][2]).alias("priority")]
        return F.transform(own, lambda x: F.struct(x["start"], F.lit(k).alias("number"), x["end"], x["text"], *facts))

    return F.array_sort(flat(RULES.each(matches, "cue", found)))


def conjunctions(matches: Column) -> Column:
    """start, number, kind and end of clause conjunctions, by start."""

    def found(own: Column, k: int) -> Column:
        return F.transform(own, lambda x: F.struct(x["start"], F.lit(k).alias("number"), F.lit(V.CONJUNCTIONS[k][1]).alias("kind"), x["end"]))

    return F.array_sort(flat(RULES.each(matches, "conjunction", found)))


def is_historical_section(text: Column) -> Column:
    """Whether a sentence opens a history section, at its start or after a line break.
    The first pattern that stands there decides; a numbered or bare header does not count."""
    low = F.regexp_replace(F.lower(text), r"(?U)^\s+", "")
    header = F.rlike(low, F.lit(V.SECTION_HEADER))
    out = F.lit(False)
    for p in reversed(V.HISTORICAL_SECTIONS):
        hit = F.regexp_extract(low, f"(?sU)^(.*?)({p})", 2) != ""
        front = F.regexp_extract(low, f"(?sU)^(.*?)({p})", 1)
        out = F.when(hit & ((front == "") | F.endswith(front, F.lit("\n"))), ~header).otherwise(out)
    return out


def _rtrim(text: Column, chars: str) -> Column:
    return F.rtrim(text, F.lit(chars))


def clauses(sentence: Column, start: Column, marks: Column) -> Column:
    """Clauses of a sentence that begins at start: cut at conjunctions (marks: their places
    in the sentence), commas trimmed."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{CLAUSE}>").alias("out"))

    def step(s: Column, m: Column) -> Column:
        own = piece(sentence, s["at"], m)
        end = s["at"] + F.char_length(_rtrim(own, ",;"))
        clause = F.struct((start + s["at"]).alias("start"), (start + end).alias("end"), F.lit("contrast").alias("kind"))
        rest = F.substring(sentence, m + 1, F.char_length(sentence))
        skipped = F.char_length(rest) - F.char_length(F.ltrim(rest, F.lit(",;")))
        cut = F.struct((m + skipped).alias("at"), F.concat(s["out"], F.array(clause)).alias("out"))
        return F.when(m > s["at"], cut).otherwise(s)

    def finish(s: Column) -> Column:
        rest = F.substring(sentence, s["at"] + 1, F.char_length(sentence))
        end = s["at"] + F.char_length(_rtrim(rest, ",;."))
        last = F.struct((start + s["at"]).alias("start"), (start + end).alias("end"), F.lit("main").alias("kind"))
        out = F.when(rest != "", F.concat(s["out"], F.array(last))).otherwise(s["out"])
        whole = F.struct(start.alias("start"), (start + F.char_length(sentence)).alias("end"), F.lit("main").alias("kind"))
        return F.when(F.size(out) == 0, F.array(whole)).otherwise(out)

    return F.aggregate(marks, zero, step, finish)


def sentences(text: Column, matches: Column, marks: Column) -> Column:
    """start, end, text, historical, clauses: cut behind delimiters and before numbered
    headers.  marks: the conjunctions of the text.

    Clauses of a trimmed sentence are placed as if nothing had been trimmed in front, as
    the rule has it.
    """
    text = F.coalesce(text, F.lit(""))
    n = F.char_length(text)
    cuts = F.concat(
        F.transform(RULES.of(matches, "delimiter"), lambda x: x["end"]), F.transform(RULES.of(matches, "header"), lambda x: x["start"])
    )
    inner = F.array_sort(F.array_distinct(F.filter(cuts, lambda c: (c > 0) & (c < n))))
    whole = F.arrays_zip(F.concat(F.array(F.lit(0)), inner).alias("start"), F.concat(inner, F.array(n)).alias("end"))

    def cut(x: Column) -> Column:
        return F.struct(x["start"], x["end"], piece(text, x["start"], x["end"]).alias("raw"))

    def trim(x: Column) -> Column:
        # What ends at a boundary is trimmed; a rest without one stays as it is.
        bounded = (x["end"] < n) | F.array_contains(cuts, n)
        own = F.when(bounded, F.rtrim(F.btrim(x["raw"], F.lit(" \t\n")), F.lit(".!?"))).otherwise(x["raw"])
        lead = F.when(bounded, F.char_length(x["raw"]) - F.char_length(F.ltrim(x["raw"], F.lit(" \t\n")))).otherwise(F.lit(0))
        base = x["start"] + lead
        inside = F.filter(marks, lambda m: (m["start"] >= base) & (m["end"] <= x["end"]))
        return F.struct(x["start"], x["end"], own.alias("text"), F.transform(inside, lambda m: m["start"] - base).alias("places"))

    def judge(x: Column) -> Column:
        own = is_historical_section(x["text"]).alias("historical")
        return F.struct(x["start"], x["end"], x["text"], own, clauses(x["text"], x["start"], x["places"]).alias("clauses"))

    return F.transform(F.transform(F.transform(F.filter(whole, lambda x: x["end"] > x["start"]), cut), trim), judge)


def first_around(segments: Column, at: Column) -> Column:
    """First segment with start <= at < end, or null."""
    return F.get(F.filter(segments, lambda s: (s["start"] <= at) & (at < s["end"])), F.lit(0))


KINDS = ("NEGATION", "HISTORICAL", "FAMILY")
_HEADED = re.compile(V.SECTION_CUE.removeprefix("(?imU)"), re.IGNORECASE | re.MULTILINE)
_HEADER = re.compile(V.SECTION_HEADER.removeprefix("(?imU)"), re.IGNORECASE | re.MULTILINE)
_SECTIONS = [re.compile(p) for p in V.HISTORICAL_SECTIONS]


class Note:
    """The cues, conjunctions, sentences and clauses of one text, for verdicts on places in it."""

    def __init__(self, text: str, compiled: tuple):
        self.text = text
        self.cues: dict[str, list[tuple[int, int, int]]] = {k: [] for k in KINDS}  # start, end, priority
        self.marks: list[tuple[int, int, int]] = []  # start, end, number
        cuts, first = set(), len(CUES)
        delimiter = RULES.names["delimiter"]
        for k, m in RULES.matches(text, compiled):
            a, b = m.span()
            if k < first:
                self.cues[CUES[k][1]].append((a, k, b))
            elif k < delimiter:
                self.marks.append((a, k - first, b))
            else:
                cuts.add(b if k == delimiter else a)
        self.marks = [(a, b, k) for a, k, b in sorted(self.marks)]
        for kind, own in self.cues.items():
            self.cues[kind] = [(a, b, CUES[k][2]) for a, k, b in sorted(own)]
        kin = self.cues["FAMILY"]
        self.cues["HISTORICAL"] = [c for c in self.cues["HISTORICAL"] if not _HEADED.search(text[max(0, c[0] - 20) : c[1] + 20])]
        told = [a for a, b, _ in self.cues["HISTORICAL"] if text[a:b].strip(" ").removeprefix("có ").startswith("tiền sử")]
        self.of_kin = any(0 < a - b <= 10 for a in told for _, b, _ in kin)
        self.cut_at_end = len(text) in cuts
        self.bounds = [0, *sorted(c for c in cuts if 0 < c < len(text)), len(text)]
        self.sentences: dict[int, tuple[bool, list[tuple[int, int, str]]]] = {}

    def sentence(self, at: int) -> tuple[bool, list[tuple[int, int, str]]]:
        """Whether the sentence around a place opens a history section, and its clauses."""
        k = bisect_right(self.bounds, at) - 1
        if k not in self.sentences:
            a, b = self.bounds[k], self.bounds[k + 1]
            own, base = self.text[a:b], a
            if b < len(self.text) or self.cut_at_end:
                base += len(own) - len(own.lstrip(" \t\n"))
                own = own.strip(" \t\n").rstrip(".!?")
            places = [m - base for m, end, _ in self.marks if m >= base and end <= b]
            self.sentences[k] = self._historical(own), self._clauses(own, a, places)
        return self.sentences[k]

    @staticmethod
    def _historical(sentence: str) -> bool:
        low = sentence.lower().lstrip()
        for p in _SECTIONS:
            hit = p.search(low)
            if hit and (not hit.start() or low[hit.start() - 1] == "\n"):
                return not _HEADER.search(low)
        return False

    @staticmethod
    def _clauses(sentence: str, start: int, places: list[int]) -> list[tuple[int, int, str]]:
        at, out = 0, []
        for m in places:
            if m > at:
                out.append((start + at, start + at + len(sentence[at:m].rstrip(",;")), "contrast"))
                rest = sentence[m:]
                at = m + len(rest) - len(rest.lstrip(",;"))
        if rest := sentence[at:]:
            out.append((start + at, start + at + len(rest.rstrip(",;.")), "main"))
        return out or [(start, start + len(sentence), "main")]

    def verdict(self, at: int, end: int) -> tuple[bool, bool, bool, float, list[str]]:
        flags = {k: False for k in KINDS}
        if 0 <= at < len(self.text):
            history, own = self.sentence(at)
            low, high = next(((a, b) for a, b, _ in own if a <= at < b), (at, end))
            ahead = {kind for _, b, kind in own if low < b <= at}
            for kind in KINDS:
                flags[kind] = any(
                    "main" in ahead or (b <= at and (b > low or ("contrast" in ahead and b == low))) or (history and kind == "HISTORICAL" and not self._blocked(b, low, high, at))
                    for _, b, _ in self.cues[kind]
                )
            flags["HISTORICAL"] &= not self.of_kin
        sure, used = 1.0, []
        for kind in KINDS:
            if flags[kind]:
                sure = min(sure, 0.7 + max(p for _, _, p in self.cues[kind]) / 100, 0.99)
                used += dict.fromkeys(self.text[a:b] for a, b, _ in self.cues[kind])
        return flags["NEGATION"], flags["HISTORICAL"], flags["FAMILY"], sure, used

    def _blocked(self, cue_end: int, low: int, high: int, at: int) -> bool:
        """Whether the first of some conjunction in the clause stands between cue and place."""
        seen = set()
        for a, b, number in self.marks:
            if a >= low and b <= high and number not in seen:
                seen.add(number)
                if cue_end <= a < at:
                    return True
        return False


FLAGS = "n int, start int, end int, text string, type string, confidence double, is_negated boolean, is_historical boolean, is_family boolean, sure double, cues_used array<string>"


def judged(rows: DataFrame) -> DataFrame:
    """doc_id, n (place in the row), start, end, text, type, confidence, is_negated,
    is_historical, is_family, sure and cues_used of each entity.

    rows: doc_id, text and found, an array of structs start, end, text, type, confidence; a
    null array has none, and a null text no cues.  A cue governs an entity that it stands
    in front of in its clause; through an earlier clause of the sentence; or, for cues of
    history, by the section that the sentence opens.  One pass over a text finds its cues;
    texts without entities are not looked at.
    """
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *(f.split(" ")[0] for f in FLAGS.split(", "))]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = RULES.compiled()
        for batch in batches:
            found = batch.column(2)
            owner, fields = pc.list_parent_indices(found), found.flatten()
            starts, ends, owners = fields.field(0).to_pylist(), fields.field(1).to_pylist(), owner.to_pylist()
            places, made, last, note = [], [], None, None
            for k, i in enumerate(owners):
                if i != last:
                    last, first, note = i, k, Note(batch.column(1)[i].as_py() or "", compiled)
                places.append(k - first)
                made.append(note.verdict(starts[k], ends[k]))
            flags = list(zip(*made, strict=True)) if made else [()] * 5
            types = [pa.bool_()] * 3 + [pa.float64(), pa.list_(pa.string())]
            columns = [pa.array(places, pa.int32()), *fields.flatten(), *(pa.array(list(c), t) for c, t in zip(flags, types, strict=True))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), *columns], names)

    item = F.transform("found", lambda x: F.struct(x["start"], x["end"], x["text"], x["type"], x["confidence"].cast("double").alias("confidence")))
    return rows.select("doc_id", "text", item.alias("found")).mapInArrow(task, f"doc_id {kind}, {FLAGS}")
