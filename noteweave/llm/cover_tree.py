"""Exact near-duplicate vectors by dual traversal of cover trees.

Vectors are compared only under one label.  Equal vectors are one class, so copies cost
nothing.  On the unit sphere cosine c is the distance sqrt(2 - 2 c).  Each label has a root vector;
rings of distance to it cut the label into blocks of bounded size, and by the triangle
inequality only those pairs of blocks whose rings come within the search distance are
looked at.  Each pair of blocks is one unit of work: both get a cover tree (nested levels of centres, radii halving from level to level), and a
dual traversal drops a pair of nodes as soon as their covering radii cannot bridge the
distance of their centres.  What is left is decided by the cosine in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .components import connected_components, star_forest

#: Distances are computed in floating point; bounds leave this much room.
SLACK = 1e-6
LEAF = 48
TRIED = 64
BLOCK_ROWS = 4096


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


class CoverTree:
    """Nodes are rows of arrays: centre, covering radius, and either children or points."""

    def __init__(self, unit: np.ndarray):
        self.unit = unit
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.children: list[list[int]] = []
        self.points: list[np.ndarray] = []
        if len(unit):
            own = np.arange(len(unit))
            self._grow(own, 0, _distances(unit[:1], unit)[0], 1.0)

    def _grow(self, own: np.ndarray, centre: int, d: np.ndarray, scale: float) -> int:
        """A node for the points `own` at distances d from the centre, which is one of
        them; its children's centres are `scale` apart or more."""
        node = len(self.centre)
        self.centre.append(centre)
        self.radius.append(float(d.max()))
        self.children.append([])
        self.points.append(own)
        if len(own) <= LEAF or self.radius[node] == 0.0:
            return node
        while scale >= self.radius[node]:
            scale /= 2
        if scale < 1e-3:
            return node
        near, best, centres = d.copy(), np.zeros(len(own), np.int64), [centre]
        # Farthest point first: every point ends within `scale` of a centre.
        while near.max() > scale and len(centres) <= len(own) // 2:
            if len(centres) == TRIED and np.count_nonzero(near <= scale) * 2 < len(own):
                break
            far = int(near.argmax())
            new = _distances(self.unit[own[far]][None, :], self.unit[own])[0]
            closer = new < near
            near[closer], best[closer] = new[closer], len(centres)
            centres.append(int(own[far]))
        if near.max() > scale:  # nothing to gain: the points are as far apart as the scale
            return node
        self.points[node] = own[:0]
        for k, c in enumerate(centres):
            mine = best == k
            self.children[node].append(self._grow(own[mine], c, near[mine], scale / 2))
        return node


def linked_pairs(a: CoverTree, b: CoverTree, distance: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate pairs of points by dual traversal; all pairs within distance are among
    them (if a is b, each pair comes once, and no point with itself)."""
    same = a is b
    stack = [(0, 0)] if len(a.unit) and len(b.unit) else []
    reach = distance + SLACK
    while stack:
        i, j = stack.pop()
        gap = float(_distances(a.unit[a.centre[i]][None, :], b.unit[b.centre[j]][None, :])[0, 0])
        if gap - a.radius[i] - b.radius[j] > reach:
            continue
        split_a = bool(a.children[i]) and (not b.children[j] or a.radius[i] >= b.radius[j])
        if not a.children[i] and not b.children[j]:
            p, q = a.points[i], b.points[j]
            for k in range(0, len(p), 1024):
                x, y = np.nonzero(_distances(a.unit[p[k : k + 1024]], b.unit[q]) <= reach)
                x, y = p[k + x], q[y]
                if same and i == j:
                    x, y = x[x < y], y[x < y]
                if len(x):
                    yield x, y
        elif same and i == j:
            own = a.children[i]
            kids = np.array([a.centre[c] for c in own])
            radii = np.array([a.radius[c] for c in own])
            open_ = _distances(a.unit[kids], a.unit[kids]) - radii[:, None] - radii[None, :] <= reach
            for x, y in zip(*np.nonzero(np.triu(open_)), strict=True):
                stack.append((own[x], own[y]))
        else:
            node, tree, other, at = (i, a, b, j) if split_a else (j, b, a, i)
            own = tree.children[node]
            kids = tree.unit[[tree.centre[c] for c in own]]
            d = _distances(kids, other.unit[other.centre[at]][None, :])[:, 0]
            for c, x in zip(own, d, strict=True):
                if x - tree.radius[c] - other.radius[at] <= reach:
                    stack.append((c, at) if split_a else (at, c))


def _matrix(column: pa.Array | pa.ChunkedArray, n: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(n, -1)


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v * v).sum(axis=1))[:, None]


def _cosines(v: np.ndarray, x: np.ndarray, w: np.ndarray, y: np.ndarray) -> np.ndarray:
    norm = np.sqrt((v * v).sum(axis=1)), np.sqrt((w * w).sum(axis=1))
    return (v[x] * w[y]).sum(axis=1) / (norm[0][x] * norm[1][y])


def near_vectors(vectors: DataFrame, cosine: float = 0.98, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Links of all rows with equal labels whose cosine is `cosine` or more.

    vectors needs vec_id, embedding and label; other columns are ignored.  Rows with a
    null label, and vectors that are null, empty, zero or hold null or non-finite
    components, link with nothing; vectors of different lengths do not link.  Repeated
    rows link like any other; component_id is the smallest vec_id reachable, null ids
    left aside.  An empty table gives an empty result.  Returns one row per row: vec_id,
    n_links, component_id, kept.
    """
    wide = F.transform("embedding", lambda x: x.cast("double"))
    sound = (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long"), "label", F.size("embedding").alias("dim"), wide.alias("v"), (F.col("label").isNotNull() & F.coalesce(sound, F.lit(False))).alias("sound"))
    # Norms must be finite and not zero in double precision; scaling by the largest component sees to that.
    big = F.array_max(F.transform("v", F.abs))
    rows = rows.withColumn("v", F.when(F.col("sound"), F.transform("v", lambda x: x / big)))
    # Equal vectors (after scaling) under one label are one class.
    classes = rows.where("sound").groupBy("label", "dim", "v").agg(F.count("*").alias("n"), F.min("vec_id").alias("first_id"))
    classes = materialize(classes.withColumn("node", F.xxhash64("label", "v")))
    links = materialize(_links(classes, cosine, block_rows))
    roots = connected_components(links.where("kind = 1").select("a", F.col("n").alias("b")))
    counts = links.where("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    placed = classes.join(counts, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = materialize(placed.select("label", "v", "root", "first_id", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links")))
    smallest = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    found = placed.join(smallest, "root").select(F.xxhash64("label", "v").alias("node"), "n_links", "component_id")
    out = rows.withColumn("node", F.when(F.col("sound"), F.xxhash64("label", "v"))).join(found, "node", "left")
    component = F.when(F.col("sound"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )


def _links(classes: DataFrame, cosine: float, block_rows: int) -> DataFrame:
    """Rows of kind 0: class a is linked with n rows of other classes; of kind 1: an edge
    from class a to class n, of a forest over all links."""
    distance = float(np.sqrt(2.0 - 2.0 * cosine))
    label = ["label", "dim"]
    roots = classes.groupBy(*label).agg(F.min_by("v", "node").alias("root"), F.count("*").alias("rows"))

    def ring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gap = np.zeros(batch.num_rows)
            dims = np.asarray(batch.column("dim"))
            for dim in np.unique(dims):
                own = pa.array(np.flatnonzero(dims == dim))
                v, r = (_unit(_matrix(batch.column(c).take(own), len(own))) for c in ("v", "root"))
                gap[np.asarray(own)] = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (v * r).sum(axis=1)))
            names = ["label", "dim", "node", "n", "v", "rows"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(gap)], [*names, "gap"])

    kinds = dict(classes.dtypes)
    schema = f"label {kinds['label']}, dim int, node long, n long, v array<double>, rows long, gap double"
    ringed = classes.join(roots, label).select("label", "dim", "node", "n", "v", "root", "rows").mapInArrow(ring, schema)
    ringed = materialize(ringed)
    # Bounds of blocks with about block_rows rows, in the order of distance to the root.
    bounds = ringed.groupBy(*label).agg(F.percentile_approx("gap", [k / 1024 for k in range(1, 1024)], 10_000).alias("q"), F.first("rows").alias("rows"))
    wanted = F.least(F.ceil(F.col("rows") / block_rows), F.lit(1024)).cast("int")
    every = F.filter("q", lambda q, k: (k + 1) % F.greatest(F.lit(1), F.floor(F.lit(1024) / wanted)) == 0)
    bounds = bounds.select("label", "dim", F.when(wanted > 1, every).otherwise(F.array().cast("array<double>")).alias("q"))
    at = F.size(F.filter("q", lambda q: q < F.col("gap")))
    # Labels of more than 1024 blocks get them by hash inside their ring.
    extra = F.pmod("node", F.greatest(F.lit(1), F.ceil(F.col("rows") / (1024 * block_rows))))
    blocks = ringed.join(bounds, label).select("label", "dim", "node", "n", "v", "gap", F.struct(at.alias("ring"), extra.alias("part")).alias("block"))
    extent = blocks.groupBy(*label, "block").agg(F.min("gap").alias("low"), F.max("gap").alias("high"))
    x, y = extent.alias("x"), extent.alias("y")
    near = (F.col("x.block") <= F.col("y.block")) & (F.col("y.low") - F.col("x.high") <= distance + SLACK) & (F.col("x.low") - F.col("y.high") <= distance + SLACK)
    same = (F.col("x.label") == F.col("y.label")) & (F.col("x.dim") == F.col("y.dim"))
    pairs = x.join(y, same & near).select("x.label", "x.dim", F.col("x.block").alias("i"), F.col("y.block").alias("j"))
    sides = F.when(F.col("i") == F.col("j"), F.array(F.struct(F.col("i").alias("block"), F.lit(0).alias("side")))).otherwise(
        F.array(F.struct(F.col("i").alias("block"), F.lit(0).alias("side")), F.struct(F.col("j").alias("block"), F.lit(1).alias("side")))
    )
    members = pairs.select("label", "dim", "i", "j", F.inline(sides))
    work = blocks.join(members, [*label, "block"]).select("label", "dim", "i", "j", "side", "node", "n", "v")

    def search(table: pa.Table) -> pa.Table:
        side, nodes, sizes = (np.asarray(table.column(c)) for c in ("side", "node", "n"))
        v = _matrix(table.column("v"), len(nodes))
        unit = _unit(v)
        first, second = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        a = CoverTree(unit[first])
        b = CoverTree(unit[second]) if len(second) else a
        second = second if len(second) else first
        others, ends = np.zeros(len(nodes), np.int64), ([np.zeros(0, np.int64)], [np.zeros(0, np.int64)])
        for p, q in linked_pairs(a, b, distance):
            p, q = first[p], second[q]
            linked = _cosines(v, p, v, q) >= cosine
            p, q = p[linked], q[linked]
            np.add.at(others, p, sizes[q])
            np.add.at(others, q, sizes[p])
            ends[0].append(p)
            ends[1].append(q)
        tree = star_forest(np.concatenate(ends[0]), np.concatenate(ends[1]), len(nodes))
        own, some = np.flatnonzero(tree != np.arange(len(nodes))), np.flatnonzero(others)
        kind = np.repeat(np.array([0, 1], np.int32), [len(some), len(own)])
        return pa.table({"kind": kind, "a": np.concatenate((nodes[some], nodes[own])), "n": np.concatenate((others[some], nodes[tree[own]]))})

    return work.groupBy("label", "dim", "i", "j").applyInArrow(search, "kind int, a long, n long")
