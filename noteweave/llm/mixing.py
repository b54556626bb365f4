"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source's documents lie in blocks (by a hash of the row), and blocks in a permuted
order, anew for every pass over the source.  A mix draws whole passes and a last part of
one.  Which block draws go to which output shard is decided exactly before any row
moves: a binary tree over the shards splits the vector of per-source block counts, at
each node by a multivariate hypergeometric draw, so that shards get equal numbers of
blocks and every draw lands in one shard.  A source's permuted draws are then dealt out
in that order, disjointly, and each shard shuffles its rows locally, by hash.

The driver holds a few numbers for each source and shard, never rows or blocks.  Words
are counted once, into a narrow table from which all quotas come; texts move only when
the drawn documents are dealt to their shards.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize

MAX_REPEATS = 3
#: Words of a shard, and the most shards; beyond that, shards grow with the input.
SHARD_WORDS = 1 << 22
MOST_SHARDS = 1 << 16
#: Rows of a block, and the most blocks: the exact sampler takes urns of fewer than 10^9
#: draws, and a block is drawn four times at most, so blocks grow with larger inputs.
BLOCK_ROWS = 256
MOST_BLOCKS = 200_000_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def reshared_targets(sizes: Mapping[object, int], weights: Mapping[object, float], cap: float = MAX_REPEATS) -> dict[object, float]:
    """Share the sum of sizes by weight; what a source would get above cap times its size
    goes to the others by weight, until none is above."""
    open_, left, out = set(sizes), float(sum(sizes.values())), {}
    while open_:
        total = sum(weights[s] for s in open_)
        over = {s for s in open_ if left * weights[s] > cap * sizes[s] * total}
        if not over:
            return out | {s: left * weights[s] / total if total else 0.0 for s in open_}
        for s in over:
            out[s] = float(cap * sizes[s])
            left -= out[s]
        open_ -= over
    return out


def hypergeometric_tree(counts: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Split counts[s] block draws of each source among shards: an array (shards, sources)
    whose columns sum to counts and whose rows' sums differ by one at most.  Every way to
    deal all draws into the shards' places is equally likely."""
    out = np.zeros((shards, len(counts)), np.int64)
    total = int(counts.sum())
    sizes = np.full(shards, total // shards, np.int64)
    sizes[: total % shards] += 1
    stack = [(0, shards, np.asarray(counts, np.int64))]
    while stack:
        a, b, own = stack.pop()
        if b - a == 1:
            out[a] = own
            continue
        mid = (a + b) // 2
        rng = np.random.default_rng([seed, a, b])
        left = _draw(rng, own, int(sizes[a:mid].sum()))
        stack += [(a, mid, left), (mid, b, own - left)]
    return out


def _draw(rng: np.random.Generator, counts: np.ndarray, n: int) -> np.ndarray:
    """Multivariate hypergeometric, source by source."""
    out, rest = np.zeros_like(counts), int(counts.sum())
    for s, c in enumerate(counts.tolist()):
        rest -= c
        out[s] = int(rng.hypergeometric(c, rest, n)) if n else 0
        n -= int(out[s])
    return out


@dataclass(frozen=True)
class SourcePlan:
    source: str | None
    size: int
    target: float
    blocks: int
    passes: int
    part: float
    draws: int


def plan_sources(sizes: Mapping[str | None, int], counts: Mapping[str | None, int], targets: Mapping[str | None, float], block_rows: int) -> list[SourcePlan]:
    plans = []
    for s, size in sizes.items():
        words = round(targets[s])
        passes = min(MAX_REPEATS, words // size) if size else 0
        part = words - passes * size if passes < MAX_REPEATS else 0
        blocks = max(1, -(-counts[s] // block_rows))
        plans.append(SourcePlan(s, size, targets[s], blocks, passes, part, 0))
    return plans


def mix_sources(
    docs: DataFrame,
    weights: Mapping[str | None, float] | None = None,
    shards: int | None = None,
    block_rows: int = BLOCK_ROWS,
    seed: int = 17,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Draw a mix as large as docs, in which each source has its target of words.

    docs needs doc_id, text and source; its other columns are kept (or those named in
    `columns`), but those added here are replaced.  weights: by source; by default 1, 2,
    3, repeating over the sources by code point, null last.  A source's target is at most
    3 times its size; no row is drawn more than 3 times in whole, and the last pass over a
    source ends inside one row.  A null text has size 0 and is never drawn; so is every
    text without words; a very long text is a row like any other.  A source of size 0 has
    the target 0.  Repeated rows (also in doc_id) are drawn one by one; ties in the order
    of draws are between equal rows only.  An empty table gives an empty table.  Adds
    size, source_size, target, taken, and draws: an array of (pass, shard, place, words),
    one entry for each time that the row is drawn; place orders the rows of a shard, words
    is less than size only in the row that a last pass ends in.  shards: by default one
    for each `SHARD_WORDS` words, 16 at least.
    """
    return _mixed(docs, weights, shards, block_rows, seed, columns)[0]


def _mixed(
    docs: DataFrame,
    weights: Mapping[str | None, float] | None,
    shards: int | None,
    block_rows: int,
    seed: int,
    columns: Sequence[str] | None,
) -> tuple[DataFrame, int]:
    spark = docs.sparkSession
    added = ("size", "source_size", "target", "taken", "draws")
    docs = docs.select(*(c for c in docs.columns if c not in added))
    wanted = [c for c in (docs.columns if columns is None else columns) if c not in added]

    def measured(df: DataFrame) -> DataFrame:
        return df.withColumns({"size": word_count(F.col("text")), "_hash": F.xxhash64(F.lit(seed), "doc_id", "text")})

    # All that is counted comes from a narrow table; it also is the result's rows if no text is wanted.
    kept = [c for c in dict.fromkeys(["source", *([] if "text" in wanted else wanted)])]
    narrow = materialize(measured(docs).select(*kept, "size", "_hash"))
    totals = narrow.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()  # a row a source
    order = sorted(totals, key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8", "surrogatepass")))
    sizes = {r["source"]: int(r["size"]) for r in order}
    given = weights or {s: 1 + k % 3 for k, s in enumerate(sizes)}
    targets = reshared_targets(sizes, given)
    block_rows = max(block_rows, -(-sum(r["n"] for r in order) // MOST_BLOCKS))
    shards = shards or max(16, min(MOST_SHARDS, -(-sum(sizes.values()) // SHARD_WORDS)))
    plans = plan_sources(sizes, {r["source"]: r["n"] for r in order}, targets, block_rows)
    schema = "source string, source_size long, target double, blocks int, passes int, part long, number int"
    table = [(p.source, p.size, p.target, p.blocks, p.passes, int(p.part), k) for k, p in enumerate(plans)]
    sources = F.broadcast(spark.createDataFrame(table, schema))  # a row a source

    def placed(rows: DataFrame) -> DataFrame:
        found = rows.join(sources, rows.source.eqNullSafe(sources.source)).drop(sources.source)
        return found.withColumn("_block", F.pmod(F.xxhash64("_hash", F.lit("block")), F.col("blocks")).cast("int"))

    # Where each block begins in the permuted order of each pass, from block totals alone.
    blocks = placed(narrow).groupBy("number", "_block").agg(F.sum("size").alias("words"), F.first("passes").alias("passes"), F.first("part").alias("part"))
    blocks = blocks.withColumn("_pass", F.explode(F.sequence(F.lit(0), F.col("passes"))))
    # A hot source's blocks are summed in stripes of their permuted order, then stripe by stripe.
    blocks = blocks.withColumn("_order", F.xxhash64(F.lit(seed), "number", "_block", "_pass"))
    blocks = materialize(blocks.withColumn("_stripe", F.shiftright("_order", 54)))
    stripes = blocks.groupBy("number", "_pass", "_stripe").agg(F.sum("words").alias("w"), F.count("*").alias("k"))
    ahead = Window.partitionBy("number", "_pass").orderBy("_stripe").rowsBetween(Window.unboundedPreceding, -1)
    stripes = stripes.select("number", "_pass", "_stripe", F.coalesce(F.sum("w").over(ahead), F.lit(0)).alias("w0"), F.coalesce(F.sum("k").over(ahead), F.lit(0)).alias("k0"))
    inside = Window.partitionBy("number", "_pass", "_stripe").orderBy("_order", "_block").rowsBetween(Window.unboundedPreceding, -1)
    begun = (
        blocks.withColumns({"w1": F.coalesce(F.sum("words").over(inside), F.lit(0)), "k1": F.coalesce(F.count("*").over(inside), F.lit(0))})
        .join(stripes, ["number", "_pass", "_stripe"])
        .select("number", "_block", "_pass", "words", "part", "passes", (F.col("w0") + F.col("w1")).alias("begin"), (F.col("k0") + F.col("k1")).alias("rank"))
        .where((F.col("_pass") < F.col("passes")) | (F.col("begin") < F.col("part")))
    )
    begun = materialize(begun)

    # Exact quotas of block draws for each shard.
    n_draws = {(r["number"], r["_pass"]): r["n"] for r in begun.groupBy("number", "_pass").agg(F.count("*").alias("n")).collect()}
    per_source = np.zeros(len(plans), np.int64)
    for (i, _), n in n_draws.items():
        per_source[i] += n
    quotas = hypergeometric_tree(per_source, shards, seed)
    before = np.cumsum(quotas, axis=0)
    first_draw, limits = [], []
    for i in range(len(plans)):
        at = 0
        for p in range(plans[i].passes + 1):
            first_draw.append((i, p, at))
            at += n_draws.get((i, p), 0)
        limits.append((i, before[:, i].tolist()))
    starts = F.broadcast(spark.createDataFrame(first_draw, "number int, _pass int, first long"))
    ends = F.broadcast(spark.createDataFrame(limits, "number int, upto array<long>"))
    drawn = begun.join(starts, ["number", "_pass"]).join(ends, "number")
    shard = F.size(F.filter("upto", lambda u: u <= F.col("first") + F.col("rank")))
    per_block = drawn.groupBy("number", "_block").agg(F.collect_list(F.struct("_pass", shard.alias("shard"), "begin")).alias("_passes"))

    # A row's place inside its block matters only in the block, one a source, where the last pass ends.
    last = (F.col("_pass") == F.col("passes")) & (F.col("begin") + F.col("words") > F.col("part"))
    ending = F.broadcast(materialize(begun.where(last).select("number", "_block")))
    rows = placed(narrow if "text" not in wanted else measured(docs.select(*dict.fromkeys(["doc_id", "text", "source", *wanted]))))
    ordered = Window.partitionBy("number", "_block").orderBy("_hash", "size").rowsBetween(Window.unboundedPreceding, -1)
    there = rows.join(ending, ["number", "_block"], "left_semi").withColumn("_in", F.coalesce(F.sum("size").over(ordered), F.lit(0)))
    elsewhere = rows.join(ending, ["number", "_block"], "left_anti").withColumn("_in", F.lit(0).cast("long"))
    joined = elsewhere.unionByName(there).join(per_block, ["number", "_block"], "left")
    size, passes = F.col("size"), F.coalesce("_passes", F.array())

    def draw(x: Column) -> Column:
        partial = F.greatest(F.lit(0), F.least(size, F.col("part") - x["begin"] - F.col("_in")))
        words = F.when(x["_pass"] < F.col("passes"), size).otherwise(partial)
        place = F.xxhash64(F.lit(seed), F.lit("place"), x["_pass"], "_hash")
        return F.struct(x["_pass"].alias("pass"), x["shard"].alias("shard"), place.alias("place"), words.cast("long").alias("words"))

    draws = F.array_sort(F.filter(F.transform(passes, draw), lambda d: d["words"] > 0))
    out = joined.withColumn("draws", draws)
    out = out.withColumn("taken", F.aggregate("draws", F.lit(0).cast("long"), lambda n, d: n + d["words"]))
    return out.select(*wanted, "size", "source_size", "target", "draws", "taken"), shards


def mixed_documents(docs: DataFrame, columns: Sequence[str], shards: int | None = None, seed: int = 17) -> DataFrame:
    """The documents of the mix of mix_sources, in its shards and shuffled inside them, one
    partition a shard: each row as often as it is drawn, in whole.  The draw that a last
    pass ends in counts if it takes half of its row or more.

    docs needs doc_id, text and source, and the columns asked for.  Rows without words are
    never drawn.  An empty table gives no rows.
    """
    mixed, shards = _mixed(docs, None, shards, BLOCK_ROWS, seed, columns)
    drawn = mixed.withColumn("_draw", F.explode("draws")).where("2 * _draw.words >= size")
    dealt = drawn.repartitionById(shards, F.col("_draw.shard")).sortWithinPartitions("_draw.place")
    return dealt.select(*columns)
