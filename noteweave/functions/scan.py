"""One pass over a text for many regex rules, with offsets.

Spark can find all matches of a pattern but not where they are, and working that out
from the gaps evaluates each pattern several times.  So the raw matches of a whole rule
set come from one Arrow function; all that is done with them is column expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

MATCHES = "array<struct<rule:int,start:int,end:int,text:string,groups:array<string>>>"


def needed(pattern: str) -> list[str] | None:
    """Lower-case letters of which any match has one run, by alternative; None if that
    cannot be told from the pattern's beginning."""
    parts, depth, last, inside = [], 0, 0, False
    for k, c in enumerate(pattern):
        if k and pattern[k - 1] == "\\" and (k < 2 or pattern[k - 2] != "\\"):
            continue
        if c in "[]":
            inside = c == "["
        depth += 0 if inside else (c == "(") - (c == ")")
        if c == "|" and not depth and not inside:
            parts.append(pattern[last:k])
            last = k + 1
    out = []
    for p in [*parts, pattern[last:]]:
        found = re.match(r"(?:\\b)?(?:\(\?:)?([^\W\d_]+)(.?)", p)
        # A group is looked into only if it is the whole rest and has no alternatives.
        if not found or (p.startswith((r"(?:", r"\b(?:")) and "|" in p):
            return None
        word = found[1][:-1] if found[2] in ("?", "*", "{") and found[2] else found[1]
        if not word:
            return None
        out.append(word.lower())
    return out


class RuleSet:
    """Named patterns; `scan` finds them all, `of` picks the matches of one."""

    def __init__(self, patterns: Mapping[str, str], flags: int = re.IGNORECASE):
        if any(re.search(r"\\[A-Z]", p) for p in patterns.values()):
            raise ValueError("escapes in upper case would not survive lower-casing")
        self.names = {name: k for k, name in enumerate(patterns)}
        self.patterns = list(patterns.values())
        self.flags = flags
        self.needs = [needed(p) for p in self.patterns]

    def compiled(self) -> tuple[list[re.Pattern], list[re.Pattern]]:
        """Patterns for lower-cased texts, and for texts that lower-casing would shift.
        Alternations of literals are many times faster when case matters."""
        exact = [re.compile(p.lower(), self.flags & ~re.IGNORECASE) for p in self.patterns]
        return exact, [re.compile(p, self.flags) for p in self.patterns]

    def matches(self, text: str, compiled: tuple[list[re.Pattern], list[re.Pattern]]) -> Iterator[tuple[int, re.Match]]:
        """(rule number, match) of each rule in turn."""
        exact, folded = compiled
        low = text.lower()
        if len(low) != len(text):
            for k, rule in enumerate(folded):
                for m in rule.finditer(text):
                    yield k, m
            return
        for k, rule in enumerate(exact):
            need = self.needs[k]
            if need is None or any(x in low for x in need):
                for m in rule.finditer(low):
                    yield k, m

    def scan(self, text: Column) -> Column:
        """All matches: rule, start, end, text, groups (missing ones null); null text has none."""
        rules = self

        @F.arrow_udf(MATCHES)
        def find(texts: pa.Array) -> pa.Array:
            compiled = rules.compiled()
            ends, numbers, starts, stops, found, group_ends, groups = [0], [], [], [], [], [0], []
            for t in texts.to_pylist():
                for k, m in rules.matches(t, compiled) if t else ():
                    a, b = m.span()
                    numbers.append(k)
                    starts.append(a)
                    stops.append(b)
                    found.append(t[a:b])
                    groups += [t[x:y] if x >= 0 else None for x, y in m.regs[1:]]
                    group_ends.append(len(groups))
                ends.append(len(numbers))
            columns = [pa.array(x, pa.int32()) for x in (numbers, starts, stops)]
            columns += [pa.array(found, pa.string()), pa.ListArray.from_arrays(pa.array(group_ends, pa.int32()), pa.array(groups, pa.string()))]
            rows = pa.StructArray.from_arrays(columns, ["rule", "start", "end", "text", "groups"])
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)

        return find(text)

    def of(self, matches: Column, name: str) -> Column:
        number = self.names[name]
        return F.filter(matches, lambda m: m["rule"] == number)

    def each(self, matches: Column, prefix: str, build: Callable[[Column, int], Column]) -> list[Column]:
        """build(matches, k) for each rule prefix0, prefix1, ..."""
        out, k = [], 0
        while f"{prefix}{k}" in self.names:
            out.append(build(self.of(matches, f"{prefix}{k}"), k))
            k += 1
        return out
