"""Edge-case documents and plain-Python versions that the operators are held against."""

from __future__ import annotations

import collections
import re

BLANKS = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

PASSAGE = "a passage that some documents share word for word, longer than fifty bytes, with ümläuts"
EDGE_TEXTS = [
    None,
    "",
    " \t\n",
    "one",
    "One\n\nTWO\n  two \t\nthree\x1cfour",
    "x" * 5000,
    "lorem ipsum dolor sit amet " * 400,
    PASSAGE,
    f"before it {PASSAGE} and after it, something else entirely",
    f"{PASSAGE}\n{PASSAGE}",
    "naïve café — 日本語 😀 don't we'll 'tis  <|endoftext|>\r\n\r\n",
    "ab " * 30,
    "### *** $$$ %%% &&& ||| <<< >>>",
    "The cat sat on the mat while the dog ran off to find a bone.",
    "The cat sat on the mat while the dog ran off to find a bone.",
    "the CAT sat on the mat while the dog ran off to find a bone.",
    "nul\x00bytes\x00inside",
]


def edge_rows() -> list[tuple]:
    """(doc_id, text, source, n_words): repeated and null ids, a clashing extra column."""
    rows = [(3 * i - 5, t, f"s{i % 3}" if i % 5 else None, "extra") for i, t in enumerate(EDGE_TEXTS)]
    return [*rows, rows[8], (7, "same id as another row", "s1", None), (None, "no id", None, None), (None, PASSAGE, "s0", "x")]


def edge_docs(spark, rows=None):
    return spark.createDataFrame(edge_rows() if rows is None else rows, "doc_id long, text string, source string, n_words string").repartition(3)


def thue_morse(n: int, a: str, b: str) -> tuple[str, str]:
    """Two strings of n letters or more whose polynomial hashes modulo 2**64 agree, whatever
    the base, from 1024 letters on."""
    while len(a) < n:
        a, b = a + b, b + a
    return a, b


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def components(n: int, edges) -> list[int]:
    label = list(range(n))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        label[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]


def line_key(line: str) -> str:
    return line.strip(BLANKS).translate(LOWER)


def frequent_lines(texts, threshold: int) -> set[str]:
    counts: collections.Counter = collections.Counter()
    for t in texts:
        counts.update({k for k in map(line_key, (t or "").split("\n")) if k})
    return {k for k, n in counts.items() if n >= threshold}
