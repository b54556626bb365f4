"""Supervised subword embeddings: a linear text classifier over hashed n-gram vectors.

A document is the mean of the vectors of its words, word pairs and character n-grams,
all hashed into one table; a softmax layer on top gives the class.  Both are learned by
stochastic gradient descent in numpy on the driver, from a bounded sample of labelled
rows.  To score, the layer is folded into the table, which leaves one number for each
bucket: a text's logit is the mean of its buckets' numbers, taken over whole Arrow
batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import RollingHash, binary_column, mix64, runs_of, text_bytes

CHAR_NGRAMS = (3, 4, 5)
CHUNK_BYTES = 1 << 19
#: Small samples are gone through more often, until so many steps are done.
MIN_STEPS = 6000

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE_VALUE = mix64(np.arange(1, 257, dtype=np.uint64))


def _slot(keys: np.ndarray, bits: int, salt: int) -> np.ndarray:
    """Bucket of each key by multiplicative hashing."""
    return ((keys + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int32)


def features(raw: np.ndarray, offsets: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, number of them in each text), for each kind of feature in turn.

    Two equal words in a row make the same pair whatever the word: a pair's hash is that
    of the difference of its words' hashes.
    """
    n, n_docs = len(raw), len(offsets) - 1
    sizes = np.diff(offsets)
    wide = raw.astype(np.uint64)
    packed = wide.copy()
    for k in range(1, max(CHAR_NGRAMS)):
        if n > k:
            packed = packed[: n - k] | (wide[k:] << np.uint64(8 * k))
        else:
            packed = packed[:0]
        if k + 1 in CHAR_NGRAMS:
            inside = np.maximum(sizes - k, 0)
            keep = np.ones(len(packed), bool)  # n-grams stay inside their text
            for back in range(k):
                at = offsets[1:-1] - 1 - back
                keep[at[(at >= 0) & (at < len(packed)) & (back < sizes[:-1])]] = False
            if np.count_nonzero(keep) != inside.sum():  # texts shorter than an n-gram: place by place
                owner = np.searchsorted(offsets, np.arange(len(packed)), side="right")
                keep = np.arange(len(packed)) + k < offsets[owner]
            yield _slot(packed[keep], bits, k), inside
    space = _SPACE[raw]
    begins = offsets[:-1][sizes > 0]
    opens = np.ones(n, bool)
    opens[1:] = space[:-1]
    opens[begins] = True
    closes = np.ones(n, bool)
    closes[:-1] = space[1:]
    closes[offsets[1:][sizes > 0] - 1] = True
    starts, ends = np.flatnonzero(opens & ~space), np.flatnonzero(closes & ~space) + 1
    words = RollingHash(_BYTE_VALUE[raw]).slices(starts, ends)
    edges = np.searchsorted(starts, offsets)
    n_words = np.diff(edges)
    yield _slot(words, bits, 11), n_words
    pairs = mix64(words[1:] - words[:-1])
    keep = np.ones(len(pairs), bool)
    cut = edges[1:-1] - 1
    keep[cut[(cut >= 0) & (cut < len(pairs))]] = False
    yield _slot(pairs[keep], bits, 13), np.maximum(n_words - 1, 0)


@dataclass(frozen=True)
class Model:
    """bucket_logits: what each bucket adds for class 1 over class 0; bias: on top."""

    bucket_logits: np.ndarray
    bias: float
    bits: int

    def logits(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n_docs = len(offsets) - 1
        total, count = np.zeros(n_docs), np.zeros(n_docs, np.int64)
        if len(raw):
            for slots, sizes in features(raw, offsets, self.bits):
                sums = np.concatenate(([0.0], np.cumsum(self.bucket_logits[slots], dtype=np.float64)))
                ends = np.cumsum(sizes)
                total += sums[ends] - sums[ends - sizes]
                count += sizes
        return total / np.maximum(count, 1) + self.bias


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], bits: int, dim: int, epochs: int, rate: float, seed: int) -> Model:
    """rows: label, distinct buckets and their shares of the document's features."""
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim)).astype(np.float32)
    layer, bias = np.zeros((2, dim), np.float32), np.zeros(2, np.float32)
    layer[1] = rng.uniform(-1, 1, dim)
    layer[0] = -layer[1]
    n = np.bincount([y for y, _, _ in rows], minlength=2)
    if not n.all():  # one class only, or no rows: its share is all there is to learn
        share = 0.5 if not n.sum() else (n[1] + 0.5) / (n.sum() + 1)
        return Model(np.zeros(1 << bits, np.float32), float(np.log(share / (1 - share))), bits)
    weight = n.sum() / (2 * n)
    epochs = max(epochs, -(-MIN_STEPS // len(rows)))
    step, steps = 0, epochs * len(rows)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            y, slots, shares = rows[i]
            vectors = table[slots]
            mean = shares @ vectors
            z = layer @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            error = (p * weight[y] * rate * (1 - step / steps)).astype(np.float32)
            table[slots] = vectors - (shares * np.float32(len(slots) ** 0.5))[:, None] * (error @ layer)[None, :]
            layer -= error[:, None] * mean[None, :]
            bias -= error * np.float32(0.1)
            step += 1
    return Model(table @ (layer[1] - layer[0]), float(bias[1] - bias[0]), bits)


def training_sample(labels: DataFrame, max_per_class: int, seed: int) -> DataFrame:
    """doc_id and label (0 or 1) of at most max_per_class documents of each class, by a
    hash of doc_id.  Null ids or labels are left out; a document labelled more than once
    has its highest label."""
    known = labels.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    order = F.xxhash64(F.lit(seed), "doc_id")
    parts = [known.where(F.col("label") == y).orderBy(order, "doc_id").limit(max_per_class) for y in (0, 1)]
    return parts[0].unionByName(parts[1])


def fit(
    docs: DataFrame,
    labels: DataFrame,
    max_per_class: int = 800,
    bits: int = 18,
    dim: int = 8,
    epochs: int = 6,
    rate: float = 2.0,
    seed: int = 7,
) -> Model:
    """Fit on a sample of labels (doc_id, label), at most max_per_class rows a class.

    The sample bounds what reaches the driver; its texts are taken whole.  Of the texts of
    a repeated doc_id one counts, that with the smallest hash; null and empty texts have no
    features and teach the bias alone.  Rows are put in an order of their content, so the
    same tables give the same model.  No labels, or those of one class, give a constant.
    """
    sample = F.broadcast(training_sample(labels, max_per_class, seed))  # 2 * max_per_class rows

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = binary_column(batch.column(1))
            slots_out, shares_out = [], []
            for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                own = [s for s, _ in features(raw[a:b], np.array([0, b - a]), bits)] if b > a else []
                slots, counts = np.unique(np.concatenate(own or [np.zeros(0, np.int32)]), return_counts=True)
                slots_out.append(slots.astype("<i4").tobytes())
                shares_out.append((counts / max(1, counts.sum())).astype("<f4").tobytes())
            columns = [batch.column(0), pa.array(slots_out, pa.binary()), pa.array(shares_out, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["label", "slots", "shares"])

    own = docs.select("doc_id", text_bytes().alias("text")).join(sample, "doc_id")
    texts = own.groupBy("doc_id").agg(F.first("label").cast("int").alias("label"), F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    found = texts.select("label", "text").mapInArrow(task, "label int, slots binary, shares binary").collect()
    rows = [(r["label"], np.frombuffer(r["slots"], "<i4"), np.frombuffer(r["shares"], "<f4")) for r in found]
    # The order of collected rows depends on the tasks; their content does not.
    rows.sort(key=lambda r: (r[0], len(r[1]), r[1].tobytes(), r[2].tobytes()))
    return train(rows, bits, dim, epochs, rate, seed)


def scorer(spark: SparkSession, model: Model) -> Callable[[Column], Column]:
    """A column function: the probability of class 1 of each row's whole text."""
    held = spark.sparkContext.broadcast(model)  # 4 bytes for each of 2**bits buckets

    @F.arrow_udf("double")
    def probability(texts: pa.Array) -> pa.Array:
        raw, offsets = binary_column(texts)
        parts = [
            held.value.logits(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            for a, b in runs_of(np.diff(offsets), CHUNK_BYTES)
        ]
        logits = np.concatenate(parts or [np.zeros(0)])
        return pa.array(1 / (1 + np.exp(-np.clip(logits, -500, 500))))

    return lambda text: probability(F.coalesce(text.cast("binary"), F.lit(b"")))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (the probability of class 1) of every row's whole text.

    docs needs doc_id and text; other columns are ignored.  A null or empty text has no
    features, so its score comes from the bias.  Rows are scored one by one, whatever
    their doc_id; an empty table gives no rows.
    """
    return docs.select(F.col("doc_id").cast("long"), scorer(docs.sparkSession, model)(F.col("text")).alias("score"))
