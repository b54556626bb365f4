"""BPE ids, packing and token files against the tokenizers library."""

import collections
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from noteweave.llm import packing, queries, token_files
from noteweave.llm.bpe import ByteBpe, default_tokenizer

from .helpers import edge_docs, edge_rows, thue_morse

LIBRARY = Tokenizer.from_file(default_tokenizer())
FAST = ByteBpe(default_tokenizer())


def ids_of(text, end):
    return np.array([*LIBRARY.encode(text or "", add_special_tokens=False).ids, end], "<u4")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("abs t'mlrevd \n\t!1é　字"), st.characters(exclude_categories=["Cs"])), max_size=30), max_size=4))
def test_ids_equal_the_library(texts):
    assert [x.tolist() for x in FAST.encode(texts)] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("n", [64, 256, 1024, 2048, 4096])
def test_ids_of_words_with_one_hash(n):
    a, b = thue_morse(n, "a", "b")
    texts = [f"{a} {b}", b, a, f"{b}!{a}", f"{a}<|endoftext|>{b}"]
    assert [x.tolist() for x in ByteBpe(default_tokenizer()).encode(texts)] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_found_word_is_compared(monkeypatch):
    class OneHash:
        def __init__(self, values):
            pass

        def slices(self, start, end):
            return np.full(len(start), 9, np.uint64)

    monkeypatch.setattr("noteweave.llm.bpe.RollingHash", OneHash)
    texts = ["some words", "share one hash", "some words share one hash"]
    assert [x.tolist() for x in ByteBpe(default_tokenizer()).encode(texts)] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


def test_ids_survive_a_full_table(monkeypatch):
    small = ByteBpe(default_tokenizer())
    small.table.room = 5
    texts = [f"word{i} and word{i % 7}" for i in range(50)]
    for _ in range(2):
        assert [x.tolist() for x in small.encode(texts)] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("seed", range(5))
def test_closest_counts_is_optimal(seed):
    rng = random.Random(seed)
    counts = {rng.randint(1, 40): rng.randint(1, 3) for _ in range(6)}
    capacity = rng.randint(10, 120)
    chosen = packing.closest_counts(counts, capacity)
    assert all(chosen[k] <= counts[k] for k in chosen)
    sums = {0}
    for k, n in counts.items():
        sums = {s + k * i for s in sums for i in range(n + 1) if s + k * i <= capacity}
    assert sum(k * n for k, n in chosen.items()) == max(sums)


def check_pieces(rows, docs, window):
    """docs: list of (doc_id, text).  Every id in one piece; sequences gapless and full or a power of two."""
    want = collections.Counter()
    for doc_id, text in docs:
        want[(doc_id, zlib.crc32(ids_of(text, 0).tobytes()))] += 1
    got = collections.defaultdict(list)
    for r in rows:
        got[r.doc_id].append(r)
        assert r.ids_crc32 == zlib.crc32(bytes(r.ids)) and len(r.ids) == 4 * r.length
    for doc_id in {d for d, _ in docs}:
        own = [ids_of(t, 0) for d, t in docs if d == doc_id]
        assert sum(r.length for r in got[doc_id]) == sum(map(len, own))
        for r in got[doc_id]:
            assert any(len(o) == r.doc_tokens and o[r.start : r.start + r.length].tobytes() == bytes(r.ids) for o in own)
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == window or (at < window and at & (at - 1) == 0)


def test_packing_edge_cases(spark):
    docs = [(d, t) for d, t, _, _ in edge_rows()]
    check_pieces(packing.pack_documents(edge_docs(spark), window=64, pool_items=8).collect(), docs, 64)
    assert packing.pack_documents(edge_docs(spark, [])).count() == 0


def test_packing_query(spark, sf_dir):
    docs = [tuple(r) for r in queries.table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    check_pieces(packing.pack_documents(queries.table(spark, sf_dir, "documents")).collect(), docs, 1024)
    assert "ids" not in queries.op1_pack_bin_slack(spark, sf_dir).columns


@pytest.mark.parametrize("mode", ["byte", "bit"])
def test_planes_round_trip(mode):
    for n in (1, 7, 8, 1000):
        ids = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint32)
        assert np.array_equal(token_files.from_planes(token_files.to_planes(ids, mode), n, mode), ids)


def test_crc32_combine():
    a, b = b"some bytes", b"\x00more of them" * 99
    assert token_files.crc32_combine(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def expected_digests(docs):
    at, out = 0, []
    for doc_id, text in docs:
        ids = ids_of(text, 2)
        out.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


@pytest.mark.parametrize("mode", ["byte", "bit"])
def test_token_files_edge_cases(spark, tmp_path, mode):
    path = str(tmp_path / "files")
    token_files.write_token_files(edge_docs(spark), path, mode=mode, block_ids=256)
    got = sorted(token_files.document_digests(spark, path).collect(), key=lambda r: r.start)
    order = {}
    for r in got:
        order.setdefault(r.doc_id, []).append(r)
    docs = [(d, t) for d, t, _, _ in edge_rows()]
    assert [(r.doc_id is not None, r.doc_id or 0) for r in got] == sorted((d is not None, d or 0) for d, _ in docs)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert sorted((r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == sorted((d or 0, n, c) for d, _, n, c in expected_digests(docs))


def test_token_files_of_nothing(spark, tmp_path):
    path = str(tmp_path / "none")
    token_files.write_token_files(edge_docs(spark, []), path)
    assert token_files.document_digests(spark, path).count() == 0


def test_token_files_query(spark, sf_dir):
    docs = sorted(tuple(r) for r in queries.table(spark, sf_dir, "documents").select("doc_id", "text").collect())
    got = sorted(tuple(r) for r in queries.op10_bit_plane_files(spark, sf_dir).collect())
    assert got == expected_digests(docs)
