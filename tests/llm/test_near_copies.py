"""Near copies against brute-force Jaccard similarity."""

import random

import numpy as np

import corpus_pipeline
from noteweave.llm import near_copies

from .helpers import LOWER, components, edge_docs, edge_rows, words


def shingles(text, width=5):
    w = [x.translate(LOWER) for x in words(text)]
    return {" ".join(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()


def linked(a, b):
    return (len(a & b) / len(a | b) if a | b else 1.0) >= 0.8


def plain_components(texts):
    sets = [shingles(t) for t in texts]
    return components(len(sets), [(i, j) for i in range(len(sets)) for j in range(i) if linked(sets[i], sets[j])])


def copies_at(rng, n, similarity):
    """Two texts of n shingles each whose sets have about that similarity: the tail differs."""
    own = round(n * (1 - similarity) / (1 + similarity))
    text = [f"w{rng.randrange(10**6)}" for _ in range(n + 4)]
    return " ".join(text), " ".join(text[: n + 4 - own] + [f"v{rng.randrange(10**6)}" for _ in range(own)])


def parted(rows):
    """Components as a set of sets of row numbers, from (number, component) pairs."""
    out = {}
    for k, c in rows:
        out.setdefault(c, set()).add(k)
    return {frozenset(s) for s in out.values()}


def test_links_are_those_of_the_shingle_sets(spark):
    rng = random.Random(6)
    texts = [t for n in (8, 30, 100, 400) for s in (0.6, 0.7, 0.75, 0.78, 0.8, 0.82, 0.85) for _ in range(8) for t in copies_at(rng, n, s)]
    want = plain_components(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = near_copies.near_copies(docs, 5, 0.8, 4).collect()
    assert parted((r.doc_id, r.component) for r in got) == parted(enumerate(want))
    kept = corpus_pipeline.near_duplicates(spark, docs.selectExpr("*", "'en' as lang", "'s' as source", "0L as n_chars"), "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want))


def test_blocks_of_a_large_group_meet(spark, monkeypatch):
    rng = random.Random(7)
    text = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    texts = []
    for k in range(40):  # a chain: each text changes the last one a little
        text[(7 * k) % 60] = f"v{k}"
        texts.append(" ".join(text))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(near_copies, "BLOCK_SHINGLES", 500)
    got = near_copies.near_copies(docs, 5, 0.8, 4).collect()
    assert parted((r.doc_id, r.component) for r in got) == parted(enumerate(plain_components(texts)))


def test_edge_cases(spark):
    rows = [(k, t) for k, (_, t, *_) in enumerate(edge_rows())]
    got = near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), 5, 0.8, 4).collect()
    assert parted((r.doc_id, r.component) for r in got) == parted(enumerate(plain_components([t for _, t in rows])))
    assert near_copies.near_copies(edge_docs(spark, []), 5, 0.8, 4).count() == 0


def test_set_labels_of_dense_and_sparse_sets():
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40))) for _ in range(150)]
    sets += [np.unique(np.append(np.arange(100, 140), rng.integers(140, 150, 2))) for _ in range(150)]
    label = near_copies.set_labels(np.concatenate(sets), np.array([len(s) for s in sets]), 0.8)
    plain = [set(s.tolist()) for s in sets]
    want = components(len(sets), [(i, j) for i in range(len(sets)) for j in range(i) if linked(plain[i], plain[j])])
    assert parted(enumerate(label.tolist())) == parted(enumerate(want))


def test_one_row_of_each_group_stays(spark):
    a, b, c, d = ("".join(f"{k}{i} " for i in range(60)) for k in "abcd")
    rows = [(3, b), (5, a), (5, b + "more"), (None, c), (None, c + "more"), (None, a + "more"), (7, d), (7, d), (7, d + "more")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert len(kept) == 4 and {t[0] for _, t in kept} == set("abcd")
    assert {(i, t[0]) for i, t in kept} == {(3, "b"), (5, "a"), (None, "c"), (7, "d")} and (3, b) in kept and (5, a) in kept
