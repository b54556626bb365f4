"""Near copies by the Jaccard similarity of word-shingle sets.

SimHash finds where to look: fingerprints of distinct shingles within a wide reach make
coarse groups, which hold all but a few of the pairs at the similarity asked for.  Sets at
that similarity are alike in size too, so fingerprints are searched in levels of sizes,
each against its own level and the next.  Inside a coarse group the shingle sets
themselves decide: its texts meet in one task, where an inverted index of their rarest
shingles finds what to count, and only pairs at the similarity or more are links.  A group
too large for a task is cut by levels and blocks, and each two blocks meet in a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, materialize, mix64, ranges, runs_of, text_bytes
from .components import connected_components
from .simhash import GOLDEN, fingerprint_of, near_links, reach_for

#: The coarse reach lies so many standard deviations beyond the mean distance of pairs at
#: the limit: sets of four and five shingles differ in more bits than long ones.
DEVIATIONS = 5.0
#: Shingles of a block of a coarse group; shingles of whole small groups taken at once.
BLOCK_SHINGLES = 1 << 20
HELD_SHINGLES = 1 << 19
SALTS = 16


def set_labels(tokens: np.ndarray, sizes: np.ndarray, similarity: float) -> np.ndarray:
    """For each set a member of its component, where sets with a Jaccard similarity of
    `similarity` or more are linked.  tokens: the sets end to end, distinct in each.

    Tokens are ordered from rare to frequent.  Two sets of sizes a and b that are linked
    share similarity * max(a, b) tokens or more, so each has a shared one among its first
    size - ceil(similarity * size) + 1: only these are indexed and looked up, and what is
    found there is counted in full.  A set of no tokens is linked to its like.
    """
    n, label = len(sizes), np.full(len(sizes), -1, np.int64)
    _, ids, times = np.unique(tokens, return_inverse=True, return_counts=True)
    rank = np.empty(len(times), np.int64)
    rank[np.argsort(times, kind="stable")] = np.arange(len(times))
    owner, starts = np.repeat(np.arange(n), sizes), np.cumsum(sizes) - sizes
    ids = (np.sort(owner * len(times) + rank[ids]) % max(1, len(times))).astype(np.int32)
    first_of = sizes - np.ceil(similarity * sizes - 1e-9).astype(np.int64) + 1
    first_of = np.minimum(first_of, sizes)
    heads = ranges(starts, first_of)
    head_owner = np.repeat(np.arange(n, dtype=np.int32), first_of)
    shared = np.sort(times)[ids[heads]] > 1
    heads, head_owner = heads[shared], head_owner[shared]

    def index() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Open sets by token, and where each token's run begins and how long it is."""
        live = label[head_owner] < 0
        own = ids[heads[live]]
        held = np.bincount(own, minlength=len(times))
        return head_owner[live][np.argsort(own, kind="stable")], np.cumsum(held) - held, held

    posted, begin, held = index()
    marked, wasted = np.zeros(len(times), bool), 0
    empty = np.flatnonzero(sizes == 0)
    label[empty] = empty[:1] if len(empty) else 0
    for first in range(n):
        if label[first] >= 0:
            continue
        label[first] = first
        queue = [first]
        while queue:
            k = queue.pop()
            if wasted > len(posted):  # sets already placed make most of the work
                posted, begin, held = index()
                wasted = 0
            own = ids[starts[k] : starts[k] + sizes[k]]
            asked = own[: first_of[k]]
            met = posted[ranges(begin[asked], held[asked])]
            open_ = np.unique(met[label[met] < 0])
            wasted += len(met) - len(open_)
            open_ = open_[np.minimum(sizes[open_], sizes[k]) >= similarity * np.maximum(sizes[open_], sizes[k])]
            marked[own] = True
            found = []
            for a, b in runs_of(sizes[open_], 1 << 18):
                part = open_[a:b]
                size = sizes[part]
                both = np.add.reduceat(marked[ids[ranges(starts[part], size)]], np.cumsum(size) - size, dtype=np.int64)
                found.append(part[both / (sizes[k] + size - both) >= similarity])
            marked[own] = False
            for part in found:
                label[part] = first
                queue.extend(part.tolist())
    return label


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Distinct shingles of the text as sorted 64-bit hashes of its words' hashes; A-Z are
    lower-cased, words parted by ASCII white space; fewer words than width are one shingle."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h, k = np.array([xxh64_intdigest(w, 11) for w in words], np.uint64), min(width, len(words))
    n = len(words) - k + 1
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = mix64(out * np.uint64(GOLDEN) ^ h[j : j + n])
    return np.unique(out)


def shingle_sets(docs: DataFrame, width: int, n_words: int) -> DataFrame:
    """doc_id, row_id, node (a hash of the shingle set), size (of the set) and fp (of the
    distinct shingles) of every row."""
    names = ["doc_id", "row_id", "node", "size", "fp"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            nodes, sizes, prints = np.zeros(len(batch), np.uint64), np.zeros(len(batch), np.int64), []
            for i, text in enumerate(batch.column(2)):
                h = shingle_set(text.as_py(), width)
                nodes[i], sizes[i] = xxh64_intdigest(h.tobytes(), 7), len(h)
                prints.append(fingerprint_of(h, n_words).astype(">u8").tobytes())
            made = [pa.array(nodes.view(np.int64)), pa.array(sizes), pa.array(prints, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names)
        give_back()

    return with_row_id(docs).select(F.col("doc_id").cast("long"), "row_id", text_bytes().alias("text")).mapInArrow(
        task, "doc_id long, row_id long, node long, size long, fp binary"
    )


def with_row_id(docs: DataFrame) -> DataFrame:
    """docs with row_id, which only rows with one doc_id and one text share."""
    return docs.withColumn("row_id", F.xxhash64("doc_id", "text"))


def size_level(size: str, similarity: float) -> Column:
    """Number of the size's order of magnitude: sets as similar as asked for differ by one
    at most, since the smaller one has `similarity` times the other's size or more."""
    return F.floor(F.log(F.greatest(F.col(size), F.lit(1))) / (1e-9 - math.log(similarity))).cast("int")


def set_links(members: DataFrame, width: int, similarity: float) -> DataFrame:
    """Edges (a, b) that connect the sets of each group at the similarity or more.
    members: root, piece, low, high (the group), node, text."""
    group = ["root", "piece", "low", "high"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, sets, held = None, [], [], 0

        def links() -> pa.RecordBatch:
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            label, own = set_labels(np.concatenate(sets), sizes, similarity), np.array(nodes, np.int64)
            moved = label != np.arange(len(own))
            return pa.RecordBatch.from_arrays([pa.array(own[moved]), pa.array(own[label[moved]])], ["a", "b"])

        for whole in batches:
            for at in range(0, len(whole), 256):
                batch = whole.slice(at, 256)
                for *own, node, text in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                    if own != key:
                        if held > HELD_SHINGLES:
                            yield links()
                            nodes, sets, held = [], [], 0
                            give_back()
                        key = own
                        # Groups that are taken at once have no shingle in common.
                        salt = mix64(np.array(own, np.int64).view(np.uint64) + np.arange(1, 5, dtype=np.uint64))
                        salt = np.bitwise_xor.reduce(salt)
                    h = shingle_set(text, width)
                    nodes.append(node)
                    sets.append(mix64(h ^ salt))
                    held += len(h)
        if sets:
            yield links()
        give_back()

    dealt = members.select(*group, "node", "text").repartition(*group)
    return dealt.sortWithinPartitions(*group).mapInArrow(task, "a long, b long")


def near_copies(docs: DataFrame, width: int, similarity: float, n_words: int) -> DataFrame:
    """doc_id, row_id and component of every row; rows are of one component if a chain of
    links joins them.

    docs needs doc_id and text; other columns are ignored.  Texts without words (null,
    empty, blank) are copies of each other; one with fewer than `width` words is one
    shingle.  Links are exact inside a coarse group of SimHash; pairs whose fingerprints
    lie beyond its reach are missed.  Rows that repeat are of one component, null ids
    among them.  An empty table gives an empty result.
    """
    rows = materialize(shingle_sets(docs, width, n_words).withColumn("level", size_level("size", similarity)))
    prints = materialize(rows.select("fp", "level").distinct().withColumn("node", F.xxhash64("fp", "level")))
    reach = reach_for(similarity, n_words, DEVIATIONS)
    coarse = connected_components(near_links(prints, reach, n_words, shard_size=50_000, min_depth=2))
    roots = prints.join(coarse, "node", "left").select("fp", "level", F.coalesce("root", "node").alias("root"))
    sets = rows.groupBy("node", "fp", "level").agg(F.min("row_id").alias("row_id"), F.first("size").alias("size"))
    placed = materialize(sets.join(roots, ["fp", "level"]).select("node", "row_id", "size", "level", "root"))
    # A large group is taken in pieces of two neighbouring levels, a large piece in blocks.
    groups = placed.groupBy("root").agg(F.count("*").alias("n"), F.sum("size").alias("all")).where("n > 1")
    # A group may hold a third of all rows: its rows meet what is said of it in SALTS places.
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    large = groups.select("root", (F.col("all") > BLOCK_SHINGLES).alias("large"), salts)
    placed = placed.withColumn("salt", F.pmod("node", F.lit(SALTS)).cast("int"))
    pieces = F.when(F.col("large"), F.array(F.col("level") - 1, "level")).otherwise(F.array(F.lit(0)))
    dealt = materialize(placed.join(large, ["root", "salt"]).withColumn("piece", F.explode(pieces)).drop("level", "large"))
    blocks = dealt.groupBy("root", "piece").agg(F.greatest(F.lit(1), F.ceil(F.sum("size") / BLOCK_SHINGLES)).alias("k"))
    met = dealt.join(blocks.select("*", salts), ["root", "piece", "salt"]).withColumn("own", F.pmod(F.xxhash64("node"), "k"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).where("k = 1 or own <> other")
    met = met.select("root", "piece", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "node", "row_id")
    texts = with_row_id(docs).select("row_id", text_bytes().alias("text"))
    components = connected_components(set_links(met.join(texts, "row_id"), width, similarity))
    return rows.join(components, "node", "left").select("doc_id", "row_id", F.coalesce("root", "node").alias("component"))
