"""Mixing, and the pipeline's stages, against plain versions of what they promise."""

import collections

import numpy as np
import pytest

import corpus_pipeline
from noteweave.llm import mixing, queries

from .helpers import edge_docs, edge_rows, frequent_lines, line_key, words
from .test_near_copies import plain_components


def test_targets_are_reshared():
    got = mixing.reshared_targets({"a": 10, "b": 1000, "c": 10, None: 980}, {"a": 1, "b": 1, "c": 100, None: 2})
    assert got["a"] == got["c"] == 30 and sum(got.values()) == pytest.approx(2000)
    assert got[None] == pytest.approx(2 * got["b"])
    assert mixing.reshared_targets({}, {}) == {} and mixing.reshared_targets({"a": 0}, {"a": 1}) == {"a": 0.0}


@pytest.mark.parametrize("shards", [1, 3, 16])
def test_splitting_tree_is_exact(shards):
    counts = np.array([5, 0, 100, 7, 1], np.int64)
    got = mixing.hypergeometric_tree(counts, shards, 3)
    assert (got >= 0).all() and got.sum(axis=0).tolist() == counts.tolist()
    assert got.sum(axis=1).max() - got.sum(axis=1).min() <= 1
    assert np.array_equal(got, mixing.hypergeometric_tree(counts, shards, 3))


def test_splitting_tree_mean():
    total = sum(mixing.hypergeometric_tree(np.array([60, 40], np.int64), 4, seed)[0] for seed in range(200))
    assert total[0] / total.sum() == pytest.approx(0.6, abs=0.03)


def test_urns_stay_within_the_exact_sampler():
    assert (1 + mixing.MAX_REPEATS) * mixing.MOST_BLOCKS < 10**9
    got = mixing.hypergeometric_tree(np.array([6 * 10**8, 2 * 10**8], np.int64), 4, 1)
    assert got.sum(axis=0).tolist() == [6 * 10**8, 2 * 10**8] and abs(got[0, 0] / got[0].sum() - 0.75) < 1e-3


def check_mix(got, docs, shards):
    sizes = collections.Counter()
    for _, text, source in docs:
        sizes[source] += len(words(text))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = mixing.reshared_targets({s: sizes[s] for s in order}, {s: 1 + k % 3 for k, s in enumerate(order)})
    taken, blocks = collections.Counter(), collections.Counter()
    assert collections.Counter((r.doc_id, r.size) for r in got) == collections.Counter((d, len(words(t))) for d, t, _ in docs)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source])
        assert 0 <= r.taken <= 3 * r["size"] and r.taken == sum(d.words for d in r.draws)
        taken[r.source] += r.taken
        for d in r.draws:
            assert 0 <= d.shard < shards
            blocks[d.shard] += 1
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= 0.5


def test_mix_edge_cases(spark):
    docs = edge_docs(spark).withColumnRenamed("n_words", "target")
    rows = [r[:3] for r in edge_rows()]
    got = mixing.mix_sources(docs, shards=4, block_rows=2).collect()
    check_mix(got, rows, 4)
    again = mixing.mix_sources(docs.repartition(7), shards=4, block_rows=2).collect()
    assert collections.Counter(map(str, got)) == collections.Counter(map(str, again))
    assert mixing.mix_sources(edge_docs(spark, [])).count() == 0


def test_mix_query(spark, sf_dir):
    docs = [tuple(r) for r in queries.table(spark, sf_dir, "documents").select("doc_id", "text", "source").collect()]
    check_mix(queries.op7_hypergeometric_mix(spark, sf_dir).collect(), docs, 16)


def test_pipeline_stage_by_stage(spark, tmp_path):
    sf_dir = "/root/testdata/sf0.01"
    docs, kept = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := str(tmp_path / str(k)))
        docs = spark.read.parquet(path)
        kept.append(docs.collect())
        if k < 4:
            assert docs.columns == columns
    quality, lines, near, mixed, packed = kept
    labels = {r.doc_id: r.quality for r in queries.table(spark, sf_dir, "labels").collect()}
    passed = {r.doc_id for r in quality}
    assert sum((d in passed) == bool(q) for d, q in labels.items()) >= 0.97 * len(labels)
    gone = frequent_lines([r.text for r in quality], 10)
    want = {r.doc_id: "\n".join(x for x in (r.text or "").split("\n") if line_key(x) not in gone) for r in quality}
    assert {r.doc_id: r.text for r in lines} == want and all(r.n_chars == len(r.text) for r in lines)
    ids = sorted(want)  # links of the near-duplicate stage: five-word shingle sets with a similarity of 0.8 or more
    assert {r.doc_id for r in near} == {ids[k] for k in plain_components([want[d] for d in ids])}
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in near} and max(collections.Counter(r.doc_id for r in mixed).values()) <= 3
    assert {r.doc_id for r in packed} == {r.doc_id for r in mixed}


def run_pipeline(spark, sf_dir, rows, labels):
    """Rows that each stage kept; rows: documents, with an extra column whose name clashes."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, size string"
    spark.createDataFrame([(*r, "x") for r in rows], schema).write.parquet(f"{sf_dir}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf_dir}/labels.parquet")
    docs, kept = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{sf_dir}/stage{k}")
        docs = spark.read.parquet(f"{sf_dir}/stage{k}")
        kept.append(docs.collect())
    return kept


def test_pipeline_edge_cases(spark, tmp_path):
    rows = [(d, t, "en", s, len(t or "")) for d, t, s, _ in edge_rows()]
    kept = run_pipeline(spark, str(tmp_path / "edge"), rows, [(1, 1, 0), (4, 0, 1), (None, 1, 0)])
    quality, lines, near, mixed, packed = kept
    pairs = [collections.Counter((r.doc_id, r.text) for r in k) for k in kept[:4]]
    assert pairs[0] <= collections.Counter((d, t) for d, t, *_ in rows)
    assert collections.Counter(r.doc_id for r in lines) == collections.Counter(r.doc_id for r in quality)  # no line is in ten documents
    want = collections.defaultdict(list)
    for r, c in zip(lines, plain_components([r.text for r in lines]), strict=True):
        want[c].append(r)
    order = [min(((r.doc_id is None, r.doc_id or 0) for r in own)) for own in want.values()]
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in near) == sorted(order)
    assert set(pairs[3]) <= set(pairs[2]) and max(pairs[3].values(), default=0) <= 3 and all(words(t) for _, t in pairs[3])
    assert {r.doc_id for r in packed} == {r.doc_id for r in mixed}
    assert sum(r.length for r in packed if r.start == 0) > 0


def test_pipeline_of_nothing(spark, tmp_path):
    assert all(not k for k in run_pipeline(spark, str(tmp_path / "none"), [], []))
