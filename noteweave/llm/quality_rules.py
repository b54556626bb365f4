"""Repetition rules: how much of a text lies inside repeated n-grams and lines.

Everything runs over whole Arrow batches in numpy.  Words and lines get rolling hashes
from prefix sums of a polynomial modulo 2^61 - 1 at a random point, so that no text can
be made to collide (two different lines of n bytes agree with a probability of n / 2^61
at most); the hash of an n-gram is a slice of prefix sums over its words' hashes, modulo
2^64; equal hashes inside one text are repetitions.  Words are runs of anything but ASCII
white space, so texts are looked at as UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from types import MappingProxyType

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PrimeHash, RollingHash, binary_column, mix64, runs_of, text_bytes

#: Largest share of a text's word characters inside repeated n-grams, by n, and of
#: characters inside repeated lines.  Fixed values: published limits of this rule.
NGRAM_LIMITS: Mapping[int, float] = MappingProxyType({5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10})
LINE_LIMIT = 0.20
SYMBOLS = b"#*$%&|<>"
CHUNK_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    return twice[at] == keys


def _covered(hit: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n places lie in a window of `width` that begins at a hit."""
    change = np.zeros(n + 1, np.int32)
    begin = np.flatnonzero(hit)
    np.add.at(change, begin, 1)
    np.add.at(change, begin + width, -1)
    return np.cumsum(change[:-1]) > 0


def _sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive edges."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[edges[1:]] - total[edges[:-1]]


def measure(raw: np.ndarray, offsets: np.ndarray, ngrams: tuple[int, ...]) -> dict[str, np.ndarray]:
    """Counts for each text; raw: the texts' bytes end to end, offsets: their ends."""
    n_docs = len(offsets) - 1
    out = {k: np.zeros(n_docs, np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars")}
    out |= {f"dup_{n}gram_chars": np.zeros(n_docs, np.int64) for n in ngrams}
    n = len(raw)
    if not n:
        return out
    space = _SPACE[raw]
    letter = ((raw & 0xC0) != 0x80) & ~space  # counts code points
    out["word_chars"] = _sums(letter, offsets)
    out["n_symbols"] = _sums(_SYMBOL[raw], offsets)
    opens = np.empty(n, bool)
    opens[0] = True
    opens[1:] = space[:-1]
    begins = offsets[:-1][offsets[:-1] < n]
    opens[begins] = True
    starts = np.flatnonzero(opens & ~space)
    if not len(starts):
        return out
    # A word ends at white space or where its text does.
    closes = np.ones(n, bool)
    closes[:-1] = space[1:]
    lasts = offsets[1:] - 1
    closes[lasts[lasts >= 0]] = True
    ends = np.flatnonzero(closes & ~space) + 1
    rolling = PrimeHash(raw)
    words = rolling.slices(starts, ends)
    edges = np.searchsorted(starts, offsets)  # of each text's words
    out["n_words"] = np.diff(edges)
    chars = np.concatenate(([0], np.cumsum(letter, dtype=np.int64)))
    size = chars[ends] - chars[starts]
    doc_of = np.repeat(np.arange(n_docs), out["n_words"])
    salt = mix64(np.arange(1, n_docs + 1, dtype=np.uint64))
    grams, total = RollingHash(words), len(words)
    for k in sorted({5, *ngrams}):
        if total < k:
            continue
        at = np.arange(total - k + 1)
        same = doc_of[at] == doc_of[at + k - 1]
        at = at[same]
        hit = np.zeros(total, bool)
        hit[at] = _repeated(grams.slices(at, at + k) ^ salt[doc_of[at]])
        inside = _covered(hit, k, total)
        if k == 5:
            out["n_repeat_words"] = _sums(inside, edges)
        if k in ngrams:
            out[f"dup_{k}gram_chars"] = _sums(np.where(inside, size, 0), edges)
    # Lines: cut at newlines and at ends of texts; those without a word do not count.
    breaks = np.flatnonzero(raw == 0x0A)
    line_from = np.unique(np.concatenate((begins, breaks + 1)))
    line_from = line_from[line_from < n]
    line_to = np.append(line_from[1:], n)
    line_to = line_to - ((raw[line_to - 1] == 0x0A) & (line_to > line_from))
    full = np.searchsorted(starts, line_to) > np.searchsorted(starts, line_from)
    line_from, line_to = line_from[full], line_to[full]
    owner = np.searchsorted(offsets, line_from, side="right") - 1
    key = rolling.slices(line_from, line_to) ^ salt[owner]
    order = np.argsort(key, kind="stable")  # the first of equal lines stays first
    again = np.zeros(len(key), bool)
    again[order[1:]] = key[order[1:]] == key[order[:-1]]
    np.add.at(out["n_dup_lines"], owner[again], 1)
    every = _repeated(key)
    np.add.at(out["dup_line_chars"], owner[every], (chars[line_to] - chars[line_from])[every])
    return out


def repetition_rules(
    docs: DataFrame,
    ngram_limits: Mapping[int, float] = NGRAM_LIMITS,
    line_limit: float = LINE_LIMIT,
    min_words: int = 10,
    max_repeat_percent: int = 20,
) -> DataFrame:
    """Judge every whole text by its counts and by its repetition coverage.

    docs needs doc_id and text; other columns are ignored.  A null or empty text has no
    words, so it fails the base rule.  Rows with null or repeated doc_ids are judged one
    by one.  Returns doc_id, the counts, dup_line_chars and dup_<n>gram_chars (word
    characters inside lines or n-grams that occur twice or more, the first included),
    base_failed, and kept: false if base_failed or if a coverage is above its limit.
    """
    limits = dict(ngram_limits)
    lengths = tuple(sorted(limits))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *(f"dup_{n}gram_chars" for n in lengths)]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = binary_column(batch.column(1))
            parts = [
                measure(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], lengths)
                for a, b in runs_of(np.diff(offsets), CHUNK_BYTES)
            ]
            columns = [pa.array(np.concatenate([p[c] for p in parts] or [np.zeros(0, np.int64)])) for c in counts]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *counts])

    measured = docs.select(F.col("doc_id").cast("long"), text_bytes().alias("text")).mapInArrow(
        task, "doc_id long, " + ", ".join(f"{c} long" for c in counts)
    )
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    within = F.col("dup_line_chars") <= line_limit * F.col("word_chars")
    for n, limit in limits.items():
        within &= F.col(f"dup_{n}gram_chars") <= limit * F.col("word_chars")
    return measured.withColumn("base_failed", failed).withColumn("kept", ~failed & within)
