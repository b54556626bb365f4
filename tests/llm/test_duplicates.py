"""Near and exact duplicate operators against brute force."""

import collections
import hashlib
import random
import time

import numpy as np
import pytest
import xxhash

from noteweave.llm import components as cc
from noteweave.llm import cover_tree, queries, simhash, substring_dedup

from .helpers import LOWER, PASSAGE, components, edge_docs, edge_rows, thue_morse, words


def plain_print(text, width):
    w = [x.translate(LOWER) for x in words(text)]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + width]).encode(), 42) for k in range(max(1, len(w) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(rows, width=4, reach=4):
    prints = [plain_print(t, width) for _, t in rows]
    edges = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= reach]
    roots = components(len(rows), edges)
    first = collections.defaultdict(list)
    for (doc_id, _), r in zip(rows, roots, strict=True):
        if doc_id is not None:
            first[r].append(doc_id)
    return collections.Counter((d, f"{p:016x}", min(first[r], default=None)) for (d, _), p, r in zip(rows, prints, roots, strict=True))


def test_simhash_edge_cases(spark):
    got = simhash.near_groups(edge_docs(spark)).collect()
    assert collections.Counter((r.doc_id, r.fp.hex(), r.component_id) for r in got) == plain_groups([r[:2] for r in edge_rows()])
    assert simhash.near_groups(edge_docs(spark, [])).count() == 0


def test_simhash_query(spark, sf_dir):
    rows = [tuple(r) for r in queries.table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    assert collections.Counter(tuple(r) for r in queries.op5_simhash_vantage(spark, sf_dir).collect()) == plain_groups(rows)


@pytest.mark.parametrize("n_words", [1, 3])
def test_vantage_search_loses_no_link(n_words):
    rng = np.random.default_rng(n_words)
    base = rng.integers(0, 1 << 63, (40, n_words), dtype=np.uint64)
    near = base[rng.integers(0, 40, 1500)] ^ (np.uint64(1) << rng.integers(0, 64, (1500, n_words)).astype(np.uint64))
    prints = np.unique(np.concatenate((base, near, rng.integers(0, 1 << 63, (1500, n_words), dtype=np.uint64))), axis=0)
    points, queries_ = prints[::2], prints[1::2]
    every = np.concatenate((points, queries_))
    a, b = simhash.linked_within(points, queries_, 4 * n_words)
    d = simhash.hamming(every[:, None], points[None, :])
    want = components(len(every), zip(*np.nonzero(d <= 4 * n_words), strict=True))
    assert components(len(every), zip(a, b, strict=True)) == want


def test_partition_sends_every_link():
    rng = np.random.default_rng(2)
    prints = np.unique(rng.integers(0, 1 << 63, (2000, 1), dtype=np.uint64), axis=0)
    tree = simhash.Partition.of(prints[:300], 4)
    other = prints ^ (np.uint64(1) << rng.integers(0, 64, prints.shape).astype(np.uint64))
    home = tree.homes(other)
    reached = np.zeros((len(prints), 16), bool)
    for shard, which in tree.visits(prints, 4):
        reached[which, shard] = True
    assert reached[np.arange(len(prints)), home].all()


def test_wide_prints_tell_similarity():
    rng = random.Random(3)
    text = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    near = text.copy()
    for k in (50, 150, 250, 350):
        near[k] = "changed"
    far = text[:200] + [f"v{rng.randrange(10**6)}" for _ in range(200)]
    a, b, c = (simhash.fingerprint(" ".join(t).encode(), 5, n_words=4) for t in (text, near, far))
    reach = simhash.reach_for(0.8, 4)
    assert simhash.hamming(a, b) <= reach < simhash.hamming(a, c)


def test_components_of_chains_and_stars(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 300)] + [(500, 500)]
    edges += [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(300)]
    rng.shuffle(edges)
    got = dict(cc.connected_components(spark.createDataFrame([*edges, (None, 3)], "a long, b long")).collect())
    roots = components(1400, edges)
    assert got == {k: roots[k] for e in edges for k in e if e[0] != e[1]}
    assert cc.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_vectors(rows, cosine=0.98):
    def sound(v, label):
        return label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    n, edges, links = len(rows), [], [0] * len(rows)
    unit = [np.array(v, float) / np.linalg.norm(v) if sound(v, x) else None for _, v, x in rows]
    for i in range(n):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine:
                edges.append((i, j))
                links[i] += 1
                links[j] += 1
    roots = components(n, edges)
    first = collections.defaultdict(list)
    for (v, _, _), r in zip(rows, roots, strict=True):
        if v is not None:
            first[r].append(v)
    out = collections.Counter()
    for (v, _, _), r, k in zip(rows, roots, links, strict=True):
        c = min(first[r], default=None)
        out[(v, k, c, v is not None and v == c)] += 1
    return out


VECTORS = "vec_id long, embedding array<float>, label int"


def test_vectors_edge_cases(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [1.0, 0.1], 0), (4, [1.0, 0.1], 1), (5, [1.0, 0.1], None), (6, None, 0), (7, [], 0),
        (8, [0.0, 0.0], 0), (9, [nan, 1.0], 0), (10, [inf, 1.0], 0), (11, [None, 1.0], 0), (12, [1.0], 0), (1, [1.0, 0.0], 0), (None, [0.0, 1.0], 0),
        (13, [-1.0, 0.0], 0), (14, [1e-30, 0.0], 0), (15, [3e38, 0.0], 0),
    ]
    df = spark.createDataFrame(rows, VECTORS).withColumnRenamed("x", "y").selectExpr("*", "'z' as n", "1 as root")
    assert collections.Counter(tuple(r) for r in cover_tree.near_vectors(df).collect()) == plain_vectors(rows)
    assert cover_tree.near_vectors(spark.createDataFrame([], VECTORS)).count() == 0


def test_vectors_in_many_blocks(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(30, 12))
    v = np.concatenate((centres[rng.integers(0, 30, 300)] + 0.08 * rng.normal(size=(300, 12)), rng.normal(size=(200, 12)), centres)).astype(np.float32)
    v = np.concatenate((v, v[:40]))
    rows = [(i, x.tolist(), int(i % 7 == 0)) for i, x in enumerate(v)]
    got = cover_tree.near_vectors(spark.createDataFrame(rows, VECTORS), block_rows=64).collect()
    assert collections.Counter(tuple(r) for r in got) == plain_vectors(rows)


def test_cover_tree_prunes_and_keeps_all_pairs():
    rng = np.random.default_rng(7)
    base = rng.normal(size=(20, 3))
    v = np.repeat(base, 60, axis=0) + 0.05 * rng.normal(size=(1200, 3))
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    tree, other = cover_tree.CoverTree(unit), cover_tree.CoverTree(unit[::3])
    assert len(tree.centre) > 20
    d = np.sqrt(np.maximum(0, 2 - 2 * unit @ unit.T))
    pairs = [(min(a, b), max(a, b)) for x, y in cover_tree.linked_pairs(tree, tree, 0.1) for a, b in zip(x.tolist(), y.tolist(), strict=True)]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) >= {(a, b) for a, b in zip(*np.nonzero(d <= 0.1), strict=True) if a < b}
    cross = {(a, b) for x, y in cover_tree.linked_pairs(tree, other, 0.1) for a, b in zip(x.tolist(), y.tolist(), strict=True)}
    assert cross >= set(zip(*(k.tolist() for k in np.nonzero(d[:, ::3] <= 0.1)), strict=True))


def plain_removal(rows, window=50):
    """Counter of (doc_id, n_bytes, spans, kept bytes)."""
    starts = collections.defaultdict(set)
    for doc_id, text in rows:
        b = (text or "").encode()
        if doc_id is not None:
            for p in range(len(b) - window + 1):
                starts[b[p : p + window]].add(doc_id)
    least = {w: min(ids) for w, ids in starts.items()}
    out = collections.Counter()
    for doc_id, text in rows:
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - window + 1):
            if doc_id is not None and least[b[p : p + window]] < doc_id:
                gone[p : p + window] = True
        edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(int), [0])))).tolist()
        out[(doc_id, len(b), tuple(edges), bytes(np.frombuffer(b, np.uint8)[~gone]))] += 1
    return out


def removal_rows(df):
    return collections.Counter((r.doc_id, r.n_bytes, tuple(x for s in r.spans for x in s), bytes(r.kept)) for r in df.collect())


def random_corpus(seed, alphabet="ab", n=60):
    rng = random.Random(seed)
    pool = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 90))) for _ in range(12)]
    rows = [(rng.randint(0, 40), "".join(rng.choice(pool) + rng.choice(["", " ", "é", "\x00"]) for _ in range(rng.randint(0, 6)))) for _ in range(n)]
    return [*rows, (50, "a" * 700), (51, "a" * 300), (52, "b" + "a" * 300), (None, "a" * 300), (53, PASSAGE * 3), (2, PASSAGE)]


@pytest.mark.parametrize("seed", range(3))
def test_removal_of_random_texts(spark, seed):
    rows = random_corpus(seed, "ab" if seed else "abcdefgh \n")
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, starts string").repartition(5)
    assert removal_rows(substring_dedup.remove_repeats(df)) == plain_removal(rows)
    assert removal_rows(substring_dedup.remove_repeats(df, shard_bytes=150)) == plain_removal(rows)


def test_removal_edge_cases(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BROADCAST_ROWS", -1)
    rows = [r[:2] for r in edge_rows()]
    assert removal_rows(substring_dedup.remove_repeats(edge_docs(spark))) == plain_removal(rows)
    assert substring_dedup.remove_repeats(edge_docs(spark, [])).count() == 0


@pytest.mark.parametrize("n", [1024, 4096])
def test_removal_of_texts_with_one_hash(spark, n):
    a, b = thue_morse(n, "a", "b")
    rows = [(1, a), (2, b), (3, f"x{a}y{b}"), (4, b), (5, f"{b}{a}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert removal_rows(substring_dedup.remove_repeats(docs)) == collections.Counter(plain_removal(rows))


def test_removal_query(spark, sf_dir):
    rows = [tuple(r) for r in queries.table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    want = {(d, n, sum(e[1::2]) - sum(e[::2]), len(e) // 2, hashlib.sha256(k).hexdigest()) for d, n, e, k in plain_removal(rows)}
    assert {tuple(r) for r in queries.op3_suffix_arrays(spark, sf_dir).collect()} == want


def test_parts_of_a_shard_merge():
    rng = np.random.default_rng(8)
    pool = [rng.integers(97, 100, 120).astype(np.uint8) for _ in range(10)]
    own = [pool[k][a : a + 60 + k] for k in range(10) for a in (0, 10, 30)]
    lengths, ids = np.array([len(x) for x in own]), rng.permutation(len(own))
    whole = substring_dedup.smallest_ids(np.concatenate(own), lengths, ids, 50)
    assert np.array_equal(whole, substring_dedup.smallest_ids(np.concatenate(own), lengths, ids, 50, shard_bytes=150))
    least = {}
    for x, i in zip(own, ids, strict=True):
        for p in range(len(x) - 49):
            w = x[p : p + 50].tobytes()
            least[w] = min(least.get(w, i), i)
    assert whole.tolist() == [least[x[p : p + 50].tobytes()] for x in own for p in range(len(x) - 49)]


def test_many_shards_of_a_bucket_are_not_compared_pair_by_pair():
    rng = np.random.default_rng(9)
    pool = rng.integers(97, 123, (2500, 60)).astype(np.uint8)
    own = pool[rng.integers(0, len(pool), 6000)].reshape(-1)
    lengths, ids = np.full(6000, 60), rng.permutation(6000)
    whole = substring_dedup.smallest_ids(own, lengths, ids, 50, shard_bytes=1 << 20)
    start = time.process_time()
    assert np.array_equal(whole, substring_dedup.smallest_ids(own, lengths, ids, 50, shard_bytes=150))
    assert time.process_time() - start < 20


def test_shards_are_cut_between_hashes():
    rng = np.random.default_rng(10)
    pool = rng.integers(97, 100, (30, 80)).astype(np.uint8)
    keys = np.sort(rng.integers(0, 30, 400)).astype(np.uint32)
    own = [pool[k][a : a + 55] for k, a in zip(keys, rng.integers(0, 20, 400), strict=True)]
    lengths, ids = np.full(400, 55), rng.permutation(400)
    whole = substring_dedup.smallest_ids(np.concatenate(own), lengths, ids, 50)
    for size in (150, 1000, 5000):
        assert np.array_equal(whole, substring_dedup.smallest_ids(np.concatenate(own), lengths, ids, 50, size, keys))


def test_windows_of_one_hash_are_compared_by_their_bytes():
    a, b = (np.frombuffer(x.encode(), np.uint8) for x in thue_morse(1024, "a", "b"))
    raw = np.concatenate((a, b, b, a, b))
    got = substring_dedup._merged(raw, np.arange(5) * 1024, np.array([5, 4, 3, 2, 1]), 1024)
    assert got.tolist() == [2, 1, 1, 2, 1]


def test_buckets_are_filled_alike():
    rng = np.random.default_rng(11)
    raw = rng.integers(97, 123, 400_000).astype(np.uint8)
    h = substring_dedup.segments(raw, np.array([0, len(raw)]), 50, 20)[0]
    sizes = np.bincount(np.searchsorted(substring_dedup.bucket_edges(64, 31), h, side="right"), minlength=64)
    assert len(sizes) == 64 and sizes.max() < 4 * sizes.mean()


@pytest.mark.parametrize("seed", range(40))
def test_suffix_arrays(seed):
    rng = np.random.default_rng(seed)
    text = (rng.integers(0, int(rng.integers(1, 5)), int(rng.integers(1, 150))) + 97 * (seed % 2)).astype(np.uint8)
    raw, order = text.tobytes(), substring_dedup.suffix_array(text)
    assert order.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])

    def common(a, b):
        return next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))

    want = [0] + [common(raw[a:], raw[b:]) for a, b in zip(order[:-1], order[1:], strict=True)]
    assert substring_dedup.common_prefixes(text, order).tolist() == want
