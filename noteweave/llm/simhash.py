"""SimHash fingerprints, and exact near-duplicate search with vantage-point trees.

Fingerprints are partitioned by Hamming distance: a tree of vantage points with median
radii, built from a bounded sample, deals every distinct fingerprint to the shard where
it falls, and sends it as a query to those other shards that a ball of the search radius
around it touches (triangle inequality).  Of two shards only one sends to the other, by
a rule that balances them.  Inside a shard the search goes down a second vantage-point
tree, whole arrays of queries at a time: branches that the ball cannot reach are pruned,
and branches that it contains are linked without looking at pairs.  A shard returns a
spanning forest of its links, so a group of copies never becomes all its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, materialize, mix64, text_bytes
from .components import connected_components, star_forest

LEAF = 192
PAIRS_AT_ONCE = 1 << 21
GOLDEN = 0x9E3779B97F4A7C15


def shingle_hashes(text: bytes, width: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each of the text's word shingles, repeated ones included."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > width:
        starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    bounds = zip(starts.tolist(), ends.tolist(), strict=True)
    return np.fromiter((xxh64_intdigest(joined[s:e], seed) for s, e in bounds), np.uint64, len(starts))


def fingerprint_of(hashes: np.ndarray, n_words: int = 1) -> np.ndarray:
    """SimHash of shingle hashes: n_words unsigned 64-bit numbers, of which the first takes
    the hashes themselves and the others further mixes of them."""
    n, ones = len(hashes), np.zeros(64 * n_words, np.int64)
    for a in range(0, n, 1 << 14):
        h = hashes[a : a + (1 << 14)]
        every = np.stack([h, *(mix64(h + np.uint64(k * GOLDEN % (1 << 64))) for k in range(1, n_words))], axis=1)
        bits = np.unpackbits(every.view(np.uint8).reshape(len(h), -1), axis=1, bitorder="little")
        for b in range(0, len(bits), 255):  # sums of 255 rows fit a byte
            ones += np.add.reduce(bits[b : b + 255], axis=0, dtype=np.uint8)
    return np.packbits((2 * ones > n).astype(np.uint8), bitorder="little").view("<u8")


def fingerprint(text: bytes, width: int, seed: int = 42, n_words: int = 1) -> np.ndarray:
    """SimHash of the text's word shingles, each as often as the text has it."""
    return fingerprint_of(shingle_hashes(text, width, seed), n_words)


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42, n_words: int = 1) -> DataFrame:
    """doc_id and fp (the fingerprint's words, big-endian bytes) of every row's whole text."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t.as_py(), width, seed, n_words).astype(">u8").tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.binary())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), text_bytes().alias("text")).mapInArrow(task, "doc_id long, fp binary")


def as_words(raw: bytes, n_words: int) -> np.ndarray:
    return np.frombuffer(raw, ">u8").astype(np.uint64).reshape(-1, n_words)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of fingerprints whose last axis is their words."""
    out = np.bitwise_count(a[..., 0] ^ b[..., 0]).astype(np.int16)
    for k in range(1, a.shape[-1]):
        out += np.bitwise_count(a[..., k] ^ b[..., k])
    return out


def pairs_within(asked: np.ndarray, points: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j) with asked[i] and points[j] at distance reach or less; the last words are
    looked at only where the first, so many that chance pairs seldom pass, leave room."""
    head = points.shape[1]
    while head > 1 and 32 * (head - 1) - 14 * math.sqrt(head - 1) >= reach:
        head -= 1
    d = hamming(asked[:, None, :head], points[None, :, :head])
    i, j = np.nonzero(d <= reach)
    if points.shape[1] > head and len(i):
        close = hamming(asked[i], points[j]) <= reach
        i, j = i[close], j[close]
    return i, j


def reach_for(similarity: float, n_words: int, deviations: float = 0.5) -> int:
    """Hamming distance that stands for a Jaccard similarity of shingle sets: two texts of
    one length have the cosine 2 s / (1 + s), and differ in angle / pi of the bits; some
    standard deviations are added for those at the very limit."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    bits = 64 * n_words
    return round(bits * share + deviations * math.sqrt(bits * share * (1 - share)))


@dataclass
class Partition:
    """A full binary tree of vantage points: node i has children 2 i + 1 (distance at most
    its radius) and 2 i + 2; its 2**depth leaves are the shards."""

    depth: int
    points: np.ndarray
    radii: np.ndarray

    @classmethod
    def of(cls, sample: np.ndarray, depth: int, seed: int = 11) -> Partition:
        rng = np.random.default_rng(seed)
        n, n_words = (1 << depth) - 1, sample.shape[1]
        points, radii = np.zeros((n, n_words), np.uint64), np.zeros(n, np.int64)
        groups = {0: sample}
        for i in range(n):
            own = groups.pop(i, sample[:0])
            points[i] = own[rng.integers(len(own))] if len(own) else rng.integers(0, 1 << 63, n_words, dtype=np.uint64)
            d = hamming(own, points[i])
            radii[i] = int(np.median(d)) if len(own) else 32 * n_words
            groups[2 * i + 1], groups[2 * i + 2] = own[d <= radii[i]], own[d > radii[i]]
        return cls(depth, points, radii)

    def homes(self, prints: np.ndarray, depth: int | None = None) -> np.ndarray:
        """The shard of each of prints; depth cuts the tree off before its leaves."""
        depth, node = self.depth if depth is None else depth, np.zeros(len(prints), np.int64)
        for _ in range(depth):
            far = hamming(prints, self.points[node]) > self.radii[node]
            node = 2 * node + 1 + far
        return node - ((1 << depth) - 1)

    def visits(self, prints: np.ndarray, reach: int, depth: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """For each shard, which of prints have a ball of radius `reach` that touches it."""
        depth = self.depth if depth is None else depth
        stack, inner = [(0, np.arange(len(prints)))], (1 << depth) - 1
        while stack:
            node, own = stack.pop()
            if not len(own):
                continue
            if node >= inner:
                yield node - inner, own
                continue
            d = hamming(prints[own], self.points[node])
            stack.append((2 * node + 1, own[d - reach <= self.radii[node]]))
            stack.append((2 * node + 2, own[d + reach > self.radii[node]]))


class _Links:
    """Edges between positions, kept as a forest when there are many."""

    def __init__(self, n: int, limit: int = 1 << 21):
        self.n, self.limit, self.held = n, limit, 0
        self.a: list[np.ndarray] = []
        self.b: list[np.ndarray] = []

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            self.a.append(a)
            self.b.append(b)
            self.held += len(a)
            if self.held > self.limit:
                a, b = self.forest()
                self.a, self.b, self.held = [a], [b], len(a)
                self.limit = max(self.limit, 2 * len(a))

    def forest(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.a:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        label = star_forest(np.concatenate(self.a), np.concatenate(self.b), self.n)
        own = np.flatnonzero(label != np.arange(self.n))
        return own, label[own]


def linked_within(points: np.ndarray, queries: np.ndarray, reach: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Forest (in positions of points followed by queries) over all links between points
    and points, and between queries and points, at Hamming distance `reach` or less."""
    every = np.concatenate((points, queries))
    links = _Links(len(every))
    start = np.random.default_rng(seed).permutation(len(points))
    stack = [(start, np.arange(len(points), len(every)), False)]
    while stack:  # links inside a branch (unless it is joined already), and between it and those that ask it
        own, asking, joined = stack.pop()
        if not len(own):
            continue
        if len(own) > LEAF:
            vantage = every[own[0]]
            d_own, d_ask = hamming(every[own], vantage), hamming(every[asking], vantage)
            if not joined and d_own.max() <= reach:
                links.add(own[1:], np.full(len(own) - 1, own[0]))
                joined = True
            whole = asking[d_ask + d_own.max() <= reach]  # their balls contain the branch
            if len(whole):
                links.add(own, np.full(len(own), whole[0]))
                links.add(whole[1:], np.full(len(whole) - 1, own[0]))
                asking, d_ask = asking[(rest := d_ask + d_own.max() > reach)], d_ask[rest]
            middle = int(np.median(d_own))
            if (d_own > middle).any():
                near = d_own <= middle
                far_asking = asking[d_ask + reach > middle]
                if not joined:  # the two halves meet once
                    far_asking = np.concatenate((far_asking, own[near][d_own[near] + reach > middle]))
                stack.append((own[near], asking[d_ask - reach <= middle], joined))
                stack.append((own[~near], far_asking, joined))
                continue
        if not joined:
            asking = np.concatenate((asking, own))
        step = max(1, PAIRS_AT_ONCE // len(own))
        for k in range(0, len(asking), step):
            part = asking[k : k + step]
            i, j = pairs_within(every[part], every[own], reach)
            links.add(part[i], own[j])
    return links.forest()


def near_links(
    prints: DataFrame, reach: int, n_words: int = 1, shard_size: int = 200_000, min_depth: int = 5, sample: int = 8192
) -> DataFrame:
    """Edges (a, b) of nodes that connect all distinct fingerprints at distance `reach` or
    less; each connected group is spanned, not every pair is listed.

    prints: fp, node and, optionally, level.  With levels, only fingerprints whose levels
    differ by one at most are compared: each level has its own shards, and sends its
    fingerprints as queries to those of the next one that their balls touch.
    """
    levelled = "level" in prints.columns
    prints = prints.select("fp", "node", (F.col("level") if levelled else F.lit(0)).cast("int").alias("level"))
    # A row for each level; levels are logarithms of sizes, so there are some dozens.
    counts = {r["level"]: r["n"] for r in prints.groupBy("level").agg(F.count("*").alias("n")).collect()}
    depths = {k: max(min_depth, math.ceil(math.log2(max(1, n / shard_size)))) for k, n in counts.items()}
    # At most `sample` fingerprints reach the driver, to place the vantage points.
    chosen = b"".join(bytes(r["fp"]) for r in prints.orderBy("node").limit(sample).collect())
    tree = Partition.of(as_words(chosen, n_words), max(depths.values(), default=0))
    names = ["level", "shard", "home", "prints", "nodes"]
    kinds = (pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary())

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = as_words(b"".join(batch.column(0).to_pylist()), n_words)
            ids, levels = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
            rows: list[tuple] = []
            for level in np.unique(levels).tolist():
                mine = np.flatnonzero(levels == level)
                own, nodes = every[mine], ids[mine]
                home = tree.homes(own, depths[level])

                def add(to: int, shard: int, is_home: bool, pick: np.ndarray, own: np.ndarray = own, nodes: np.ndarray = nodes) -> None:
                    if len(pick):
                        rows.append((to, shard, is_home, own[pick].astype(">u8").tobytes(), nodes[pick].tobytes()))

                for shard, which in tree.visits(own, reach, depths[level]):
                    at_home = home[which] == shard
                    sends = (home[which] < shard) == ((home[which] + shard) % 2 == 1)
                    add(level, shard, True, which[at_home])
                    add(level, shard, False, which[~at_home & sends])
                if level + 1 in depths:
                    for shard, which in tree.visits(own, reach, depths[level + 1]):
                        add(level + 1, shard, False, which)
            columns = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

    def search(table: pa.Table) -> pa.Table:
        home = np.array(table.column("home").to_pylist(), bool)
        raw, ids = table.column("prints").to_pylist(), table.column("nodes").to_pylist()
        at_home, visiting = np.flatnonzero(home), np.flatnonzero(~home)
        points, queries = (as_words(b"".join(raw[i] for i in own), n_words) for own in (at_home, visiting))
        nodes = np.frombuffer(b"".join(ids[i] for own in (at_home, visiting) for i in own), np.int64)
        a, b = linked_within(points, queries, reach)
        give_back()
        return pa.table({"a": nodes[a], "b": nodes[b]})

    dealt = prints.mapInArrow(deal, "level int, shard int, home boolean, prints binary, nodes binary")
    return dealt.groupBy("level", "shard").applyInArrow(search, "a long, b long")


def near_groups(docs: DataFrame, width: int = 4, reach: int = 4, seed: int = 42, n_words: int = 1) -> DataFrame:
    """doc_id, fp and component_id of every row.

    docs needs doc_id and text; other columns are ignored.  A text without words (null,
    empty, blank) has fingerprint zero and links like any other; one with fewer than
    `width` words is one shingle.  Repeated rows link like any other.  component_id is
    the smallest doc_id reachable over links, null ids left aside (null if there is no
    other).  An empty table gives an empty result.
    """
    prints = materialize(fingerprints(docs, width, seed, n_words))
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    classes = materialize(classes.withColumn("node", F.xxhash64("fp")))
    roots = connected_components(near_links(classes, reach, n_words))
    placed = classes.join(roots, "node", "left").select("fp", "first_id", F.coalesce("root", "node").alias("root"))
    smallest = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_print = placed.select("fp", "root").join(smallest, "root").select("fp", "component_id")
    return prints.join(of_print, "fp").select("doc_id", "fp", "component_id")
