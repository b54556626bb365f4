"""Repetition rules, URL filters, line dedup and the quality model against plain versions."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest

from noteweave.llm import common, line_dedup, quality_model, quality_rules, queries, url_filter

from .helpers import edge_docs, edge_rows, frequent_lines, line_key, thue_morse, words


def plain_rules(text):
    w = words(text)
    size = [len(x) for x in w]
    out = {"n_words": len(w), "word_chars": sum(size), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or ""))}

    def covered(n):
        grams = collections.Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
        return {i for k in range(len(w) - n + 1) if grams[tuple(w[k : k + n])] > 1 for i in range(k, k + n)}

    out["n_repeat_words"] = len(covered(5))
    for n in quality_rules.NGRAM_LIMITS:
        out[f"dup_{n}gram_chars"] = sum(size[i] for i in covered(n))
    lines = [x for x in (text or "").split("\n") if words(x)]
    counts = collections.Counter(lines)
    out["n_dup_lines"] = len(lines) - len(counts)
    out["dup_line_chars"] = sum(sum(map(len, words(x))) for x in lines if counts[x] > 1)
    out["base_failed"] = len(w) < 10 or 100 * out["n_repeat_words"] > 20 * len(w)
    fine = out["dup_line_chars"] <= quality_rules.LINE_LIMIT * out["word_chars"] and all(
        out[f"dup_{n}gram_chars"] <= x * out["word_chars"] for n, x in quality_rules.NGRAM_LIMITS.items()
    )
    out["kept"] = not out["base_failed"] and fine
    return out


def as_key(row):
    return repr(sorted((k, v) for k, v in row.items() if k != "doc_id"))


def test_rules_edge_cases(spark):
    got = [r.asDict() for r in quality_rules.repetition_rules(edge_docs(spark)).collect()]
    want = [(d, as_key(plain_rules(t))) for d, t, _, _ in edge_rows()]
    assert collections.Counter((r["doc_id"], as_key(r)) for r in got) == collections.Counter(want)
    assert quality_rules.repetition_rules(edge_docs(spark, [])).count() == 0


def test_rules_query(spark, sf_dir):
    texts = dict(queries.table(spark, sf_dir, "documents").select("doc_id", "text").collect())
    for r in queries.op8_repetition_coverage(spark, sf_dir).collect():
        assert as_key(r.asDict()) == as_key(plain_rules(texts[r.doc_id]))


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_rules_of_texts_with_one_hash(spark, n):
    a, b = thue_morse(n, "a", "b")
    c, d = thue_morse(n, "w x ", "y z ")
    texts = [f"{a}\n{b}", f"{a} {b} " * 6, f"{c}\n{d}\n{c}", " ".join([a, "u", "v", "w", "x", b, "u", "v", "w", "x"])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: as_key(r.asDict()) for r in quality_rules.repetition_rules(docs).collect()}
    assert got == {k: as_key(plain_rules(t)) for k, t in enumerate(texts)}


def test_prime_hash_is_the_polynomial():
    raw = np.random.default_rng(1).integers(0, 256, 40_000, dtype=np.uint8)
    made, base, power, total = common.PrimeHash(raw), int(common.PrimeHash.BASE), 1, 0
    for k, v in enumerate(raw.tolist()):
        assert int(made.power[k]) == power and int(made.sums[k]) == total
        total, power = (total + (v + 1) * power) % common.PRIME, power * base % common.PRIME
    twice = common.PrimeHash(np.concatenate((raw, raw)))
    at = np.arange(0, 39_000, 7)
    assert np.array_equal(twice.slices(at, at + 900), twice.slices(at + 40_000, at + 40_900))
    assert len(np.unique(twice.slices(at, at + 900))) == len(at)


URLS = [
    None,
    "",
    "no scheme",
    "://",
    "http://EXAMPLE.com/en/1",
    "http://example.com/en/77?x",
    "https://a.b.example.com/en/7",
    "http://notexample.net/de/8",
    "http://example.net/de/81#f",
    "http://net/de/",
    "x://http://org/es/",
    "http://org?/es/",
    "http://ÉXAMPLE.org/es/",
    "http://com/en",
    "http://listed.io/a",
    "http://listed.io/b",
    "http://sub.listed.io/",
    "https://mixed.io/1",
    "HTTP://mixed.io/2",
]


def plain_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest, re.S)[0]
    path = re.match(r"[^?#]*", rest[len(host) :], re.S)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def plain_verdict(url, listed):
    host, path = plain_url(url)
    fits = [r for r in queries.URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return host, path, best and best.name, best.verdict if best else ("block" if host in listed else "allow")


def test_urls_edge_cases(spark):
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(URLS)] + [(14, "http://listed.io/a", None)], "page_id long, url string, host string")
    assert {r.key for r in url_filter.plain_http_hosts(pages).collect()} == {"listed.io", "example.com"}
    got = url_filter.judge_urls(pages, queries.URL_RULES, url_filter.plain_http_hosts(pages)).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == plain_verdict(r.url, {"listed.io", "example.com"})
    empty = pages.limit(0)
    assert url_filter.judge_urls(empty, queries.URL_RULES, url_filter.plain_http_hosts(empty)).count() == 0


@pytest.mark.parametrize("segment_bits", [1 << 26, 2048])
def test_cascade_is_exact(spark, monkeypatch, segment_bits):
    monkeypatch.setattr(url_filter, "MAX_FILTER_BITS", segment_bits)
    universe = spark.range(6000).selectExpr("concat('host', id) as key")
    listed = spark.range(0, 9000, 7).selectExpr("concat('host', id) as key").unionByName(spark.sql("select string(null) as key"))
    cascade = url_filter.build_cascade(universe, listed)
    wrong = universe.withColumn("got", cascade.listed(universe.key)).where("got <> (int(substr(key, 5)) % 7 = 0)")
    assert wrong.count() == 0
    assert (len(cascade.segments) > 1) == (segment_bits == 2048)


def plain_lines(rows, threshold):
    gone = frequent_lines([t for _, t in rows], threshold)
    out = collections.Counter()
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if line_key(x) not in gone]
        out[(doc_id, len(lines), len(lines) - len(kept), "\n".join(kept))] += 1
    return out


@pytest.mark.parametrize("salted", [False, True])
def test_lines_edge_cases(spark, monkeypatch, salted):
    if salted:
        monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", -1)
    rows = [(i, f"{'Common' if i % 2 else ' common '}\nown {i}\n\nCOMMON\t", "s", None) for i in range(5)] + edge_rows()
    got = line_dedup.dedup_lines(edge_docs(spark, rows), threshold=3).collect()
    assert collections.Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got) == plain_lines([r[:2] for r in rows], 3)
    assert {"source", "n_words"} <= set(got[0].asDict())
    assert line_dedup.dedup_lines(edge_docs(spark, [])).count() == 0


def test_lines_query(spark, sf_dir):
    rows = [tuple(r) for r in queries.table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    want = {(d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in plain_lines(rows, 10)}
    assert {tuple(r) for r in queries.op9_line_runs(spark, sf_dir).collect()} == want


def test_features_do_not_depend_on_neighbours():
    texts = [b"", b"a", b"ab cd", b"same same same", "é x".encode(), b"abcdefgh ijk"]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    together = [[] for _ in texts]
    for slots, sizes in quality_model.features(raw, offsets, 16):
        ends = np.cumsum(sizes)
        for k in range(len(texts)):
            together[k] += sorted(slots[ends[k] - sizes[k] : ends[k]].tolist())
    for k, t in enumerate(texts):
        alone = []
        if t:
            for slots, _ in quality_model.features(np.frombuffer(t, np.uint8), np.array([0, len(t)]), 16):
                alone += sorted(slots.tolist())
        assert together[k] == alone


def plain_features(text, bits):
    """Buckets of a text, n-gram by n-gram: characters (bytes), words and word pairs."""
    def mix(x):
        for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            x = ((x ^ x >> 33) * m) % 2**64
        return x ^ x >> 33

    def slot(x, kind):
        return int(quality_model._slot(np.array([x], np.uint64), bits, kind)[0])

    def word(w):
        base = common.RollingHash.BASE
        return mix(sum(mix(c + 1) * pow(base, k, 2**64) for k, c in enumerate(w)) % 2**64)

    out = []
    for n in quality_model.CHAR_NGRAMS:
        out += sorted(slot(int.from_bytes(text[k : k + n], "little"), n - 1) for k in range(len(text) - n + 1))
    own = [word(w) for w in re.findall(rb"[^\x20\x09-\x0D]+", text)]
    out += sorted(slot(w, 11) for w in own)
    return out + sorted(slot(mix((b - a) % 2**64), 13) for a, b in zip(own, own[1:], strict=False))


@pytest.mark.parametrize("text", [b"a", b"ab cd", b"same same same", "é x\ny".encode(), b"one two  three four " * 9])
def test_features_against_plain_ones(text):
    got = []
    for slots, _ in quality_model.features(np.frombuffer(text, np.uint8), np.array([0, len(text)]), 16):
        got += sorted(slots.tolist())
    assert got == plain_features(text, 16)


def test_score_is_the_mean_of_the_buckets(spark):
    rng = np.random.default_rng(3)
    model = quality_model.Model(rng.normal(size=1 << 16).astype(np.float32), 0.25, 16)
    rows = [(d, t) for d, t, *_ in edge_rows()]
    docs = spark.createDataFrame(list(enumerate(t for _, t in rows)), "doc_id long, text string")
    for r in quality_model.score(docs, model).collect():
        own = plain_features((rows[r.doc_id][1] or "").encode(), 16)
        z = 0.25 + (model.bucket_logits[own].astype(float).mean() if own else 0)
        assert r.score == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)


def test_fit_does_not_depend_on_partitions(spark):
    rows = [(k % 40, f"{'good words here' if k % 2 else 'bad bad junk'} {k % 40} {k // 80}") for k in range(200)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, label int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    a, b = (quality_model.fit(docs.repartition(n), labels, bits=12, epochs=2) for n in (1, 5))
    assert np.array_equal(a.bucket_logits, b.bucket_logits) and a.bias == b.bias


def test_model_edge_cases(spark):
    labels = spark.createDataFrame([(1, 1), (4, 0), (7, 1), (7, 0), (None, 1), (10, None), (999, 1)], "doc_id long, label int")
    model = quality_model.fit(edge_docs(spark), labels)
    got = quality_model.score(edge_docs(spark), model).collect()
    assert len(got) == len(edge_rows()) and all(0 <= r.score <= 1 for r in got)
    none = quality_model.fit(edge_docs(spark), labels.limit(0))
    assert {r.score for r in quality_model.score(edge_docs(spark), none).collect()} == {0.5}
    assert quality_model.score(edge_docs(spark, []), model).count() == 0


def test_quality_query_held_out(spark):
    sf_dir = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op2_subword_quality(spark, sf_dir).collect()}
    labels = queries.table(spark, sf_dir, "labels").collect()
    held = [r for r in labels if got[r.doc_id].held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got.values())
    assert sum(got[r.doc_id].predicted == r.quality for r in held) >= 0.95 * len(held)
