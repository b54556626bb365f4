"""Extraction, assertions, resolution, linking and the rest on small clinical fixtures."""

import json
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from noteweave.functions import normalize, spans
from noteweave.functions.fixed_values import CUES, DISEASE_KEYWORDS, LAB_TEST_NAMES
from noteweave.operators import dataset, extract, metrics, rerank, resolve, retrieve, tokens, validate
from noteweave.plans import pipeline, registry, table_queries  # noqa: F401
from noteweave.sources import io, kb, templates
from noteweave.streaming import notes

NOTES = [
    (1, "WBC 14,43 H, Glucose 126 mg/dL (3.5-5.0); đường huyết: 7."),
    (2, "Bệnh nhân dùng thuốc paracetamol 500 mg, Aspirin 81mg po daily. Uống metformin"),
    (3, "Chẩn đoán viêm phổi cộng đồng. BN ho khan, đau ngực. Không hen suyễn"),
    (4, None),
    (5, ""),
    (6, "Bệnh nhân không ho khan nhưng đau ngực. Bố có tiền sử đau tim"),
    (7, "Tiền sử bệnh\n- tăng huyết áp\n1. Thuốc: x"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(NOTES, "doc_id long, text string")


@pytest.fixture(scope="module")
def found(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("e") / "entities")
    pipeline.entities(docs).write.parquet(path)
    return spark.read.parquet(path)


def test_fixed_values_are_whole(spark):
    assert (len(CUES), len(DISEASE_KEYWORDS), len(LAB_TEST_NAMES)) == (88, 186, 85)
    assert (kb.icd(spark).count(), kb.icd(spark, base=True).count(), kb.drugs(spark).count(), kb.base_drugs(spark).count()) == (38, 15, 28, 19)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab1.,0 đ😀\n"), max_size=25), min_size=1, max_size=5))
def test_find_spans_equals_finditer(spark, texts):
    pattern = r"[0-9]+(?:[.,][0-9]+)?"
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: [(s.start, s.end, s.text) for s in r.s] for r in df.select("i", spans.find_spans(F.col("t"), pattern).alias("s")).collect()}
    assert got == {i: [(*m.span(), m[0]) for m in re.finditer(pattern, t)] for i, t in enumerate(texts)}


def test_entities_of_notes(found):
    got = {(r.doc_id, r.text, r.type, tuple(r.assertions)) for r in found.collect()}
    assert {
        (1, "WBC", "TÊN_XÉT_NGHIỆM", ()),
        (1, "14,43 ", "KẾT_QUẢ_XÉT_NGHIỆM", ()),
        (2, "Aspirin 81mg", "THUỐC", ()),
        (2, "metformin", "THUỐC", ()),
        (3, "viêm phổi cộng đồng", "CHẨN_ĐOÁN", ()),
        (3, "hen suyễn", "CHẨN_ĐOÁN", ("isNegated",)),
        (6, "ho khan", "CHẨN_ĐOÁN", ("isNegated",)),
        (6, "đau ngực", "TRIỆU_CHỨNG", ()),
        (6, "đau tim", "CHẨN_ĐOÁN", ("isFamily",)),
        (7, "tăng huyết áp", "CHẨN_ĐOÁN", ("isHistorical",)),
    } <= got


def test_entities_are_slices_in_order(docs, found):
    text = dict(NOTES)
    last = {}
    for r in found.orderBy("doc_id", "n").collect():
        assert text[r.doc_id][r.start : r.end] == r.text and r.start >= last.get(r.doc_id, 0)
        last[r.doc_id] = r.end


def test_codes_are_known_and_right(spark, docs, found):
    rows = pipeline.linked(found).collect()
    best = {r.text: (r.candidates or [None])[0] for r in rows}
    assert best["viêm phổi cộng đồng"] == "J18.9" and best["tăng huyết áp"] == "I10" and best["Aspirin 81mg"] == "1191"
    codes = {r.code for r in kb.icd(spark).collect()} | {r.rxcui for r in kb.drugs(spark).collect()}
    assert all(set(r.candidates) <= codes and len(r.candidates) <= 5 for r in rows)


def test_lab_panel_and_units(docs):
    t, m = F.col("text"), F.col("m")
    rows = docs.withColumn("m", extract.RULES.scan(t)).withColumn("tests", extract.lab_tests(m))
    rows = rows.withColumn("r", extract.lab_results(t, m, F.col("tests"), fix_units=True)).where("doc_id = 1")
    one = rows.select("r", extract.lab_panel(F.col("tests"), F.col("r")).alias("p")).first()
    assert [(x.value, x.unit) for x in one.r][:2] == [(14.43, None), (126.0, "mg/dL")] and one.r[0].is_abnormal
    assert {x.normalized_name for x in one.p} >= {"WBC", "Glucose", "đường huyết"}


def test_drug_parser(spark):
    cases = {"Alprazolam 0.5 MG": ([0.5], ["MG"]), "Ceftriaxone 1g": ([1.0], ["G"]), "Aspirin 0,5 MG": ([0.5], ["MG"]), "Amoxicillin + Ibuprofen 1 g tablet": ([1.0], ["G"])}
    df = spark.createDataFrame([(k,) for k in [*cases, ""]], "t string")
    got = {r.t: r.p for r in df.select("t", normalize.parse_drug(F.col("t")).alias("p")).collect()}
    assert got.pop("") is None
    assert {k: (p.strength_values, p.strength_units) for k, p in got.items()} == cases
    assert got["Amoxicillin + Ibuprofen 1 g tablet"].ingredients == ["Amoxicillin", "Ibuprofen"]
    row = df.limit(1).select(normalize.remove_tones(F.lit("đau Ế ờ")).alias("a"), normalize.for_fuzzy(F.lit("Ho—Khan")).alias("b")).first()
    assert row.a == "đau E o" and "ho khan" in row.b


def test_resolution_fixtures(spark):
    rows = [(1, [(12, 19, "ho đờm", "TRIỆU_CHỨNG", 0.9, "r"), (16, 24, "đờm xanh", "TRIỆU_CHỨNG", 0.8, "r"), (12, 17, "ho", "TRIỆU_CHỨNG", 0.7, "r")])]
    df = spark.createDataFrame(rows, f"i int, s array<{spans.SPAN}>")
    pick = lambda strategy: [(x.start, x.end) for x in df.select(spans.resolve_spans(F.col("s"), strategy).alias("s")).first().s]
    assert pick("longest") == [(16, 24)] and pick("confidence") == [(12, 19)]
    two = spark.createDataFrame([(1, [(0, 10, "x", "TRIỆU_CHỨNG", 0.9, "r"), (0, 10, "x", "CHẨN_ĐOÁN", 0.7, "r")])], df.schema)
    assert two.select(spans.resolve_spans(F.col("s"), "type_priority").alias("s")).first().s[0].type == "CHẨN_ĐOÁN"
    near = spark.createDataFrame([(1, [(0, 2, "ho", "A", 0.9, "r"), (2, 5, "đờm", "A", 0.8, "r")])], df.schema)
    merged = near.select(spans.resolve_spans(F.col("s")).alias("s")).first().s
    assert [(x.start, x.end, x.text, x.source) for x in merged] == [(0, 5, "ho đờm", "merged")]


def test_same_span_merging(spark):
    schema = "doc_id int, seq long, start int, end int, type string, confidence double, source string, section string"
    rows = [
        (1, 1, 0, 4, "THUỐC", 0.6, "a", None), (1, 2, 0, 4, "THUỐC", 0.8, "b", None),
        (2, 1, 0, 4, "CHẨN_ĐOÁN", 0.7, "a", "Triệu chứng"), (2, 2, 0, 4, "TRIỆU_CHỨNG", 0.65, "b", "Triệu chứng"),
        (3, 1, 0, 4, "TÊN_XÉT_NGHIỆM", 0.7, "a", None), (3, 2, 0, 4, "KẾT_QUẢ_XÉT_NGHIỆM", 0.9, "b", None),
    ]
    merged = resolve.merge_same_spans(spark.createDataFrame(rows, schema))
    got = {r.doc_id: (r.type, round(r.confidence, 4), r.outcome) for r in merged.collect()}
    assert got == {1: ("THUỐC", 0.8, "merged"), 2: ("TRIỆU_CHỨNG", 0.78, "type_conflict"), 3: ("KẾT_QUẢ_XÉT_NGHIỆM", 0.9, "pair_conflict")}
    assert resolve.conflict_counts(merged).count() == 2
    assert resolve.drop_overlaps(merged).count() == 3


def test_retrieval_and_rerankers(spark):
    assert retrieve.weighted_ratio("viem phoi", "viem phoi") == 100 and retrieve.weighted_ratio("", "x") == 0
    entries = kb.drugs(spark)
    mentions = spark.createDataFrame([(1, "Aspirin 81mg"), (2, "Metformin")], "id long, mention string")
    fit = retrieve.structured(mentions, entries)
    assert fit.where("id = 1 and rank = 1").first().rxcui == "1191"
    rows = fit.drop("rank").join(mentions, "id").join(entries, "rxcui")
    assert rerank.rerank_drugs_by_rules(rows).where("id = 1 and rank_after = 1").first().rxcui == "1191"
    dosed = rerank.rerank_drugs_by_dose(rows).where("id = 2 and rank_after = 1").first()
    assert dosed.strength_value == 1000.0
    icd = kb.icd(spark)
    exact = retrieve.exact_icd(spark.createDataFrame([(1, "viêm phổi")], "id long, mention string"), icd)
    ranked = exact.join(icd, "code").withColumns({"mention": F.lit("viêm phổi"), "score": F.lit(1.0)})
    assert rerank.rerank_icd(ranked).first().code == exact.first().code
    penalties = spark.range(1).select(
        rerank.strength_penalty(F.lit(1.0), F.lit("G"), F.lit(1000.0), F.lit("MG")).alias("same"),
        rerank.strength_penalty(F.lit(500.0), F.lit("MG"), F.lit(1000.0), F.lit("MG")).alias("half"),
        rerank.form_penalty(F.lit("tablet"), F.lit("Injection")).alias("form"),
        rerank.include_boost(F.lit("đau dạ dày"), F.array(F.lit("dạ dày"), F.lit("x"))).alias("boost"),
    ).first()
    assert (penalties.same, penalties.half, penalties.form, round(penalties.boost, 3)) == (0.0, 0.3, 0.2, 0.125)


def test_ancestors_end(spark):
    tree = spark.createDataFrame([("A", "A"), ("B", "A"), ("C", "B"), ("X", "Y"), ("Y", "X")], "code string, parent_code string")
    got = {(r.code, r.depth, r.ancestor) for r in retrieve.ancestors(tree).collect()}
    assert {("B", 1, "A"), ("C", 1, "B"), ("C", 2, "A"), ("X", 1, "Y")} <= got and len(got) < 8


def test_validators(spark):
    entity = "struct<text:string,start:int,end:int,type:string,assertions:array<string>,candidates:array<string>>"
    rows = [
        ("a", "ho khan", [("ho", 0, 2, "TRIỆU_CHỨNG", ["isNegated"], [])]),
        ("b", "ho khan", [("ho", 0, 9, "X", ["no"], []), ("ho", 1, 1, "CHẨN_ĐOÁN", [], ["J1"]), ("kh", 3, 5, "THUỐC", [], ["abc"]), ("xx", 0, 2, "THUỐC", [], [])]),
        (None, "", []),
    ]
    df = spark.createDataFrame(rows, f"id string, text string, entities array<{entity}>")
    got = {(r.id, r.number, r.severity, r.field) for r in validate.validate_samples(df).collect()}
    assert not [g for g in got if g[0] == "a"]
    assert {("b", 0, "error", "end"), ("b", 0, "error", "type"), ("b", 0, "error", "assertions"), ("b", 1, "error", "width"), ("b", 1, "warning", "candidates"), ("b", 2, "warning", "candidates"), ("b", 3, "error", "text"), (None, None, "error", "id")} <= got
    out = {(r.number, r.field) for r in validate.validate_outputs(df.withColumnRenamed("id", "doc_id"), ["J18.9"], ["161"]).where("doc_id = 'b'").collect()}
    assert {(0, "position"), (1, "codes"), (2, "codes"), (3, "overlap")} <= out
    links = spark.createDataFrame([("1", "đau hen", "hen", "J45.9", ["I10"]), ("2", "đau", "hen", "x", ["x"])], "id string, query_text string, mention string, positive string, negatives array<string>")
    assert {(r.id, r.field) for r in validate.linking_findings(links, validate.ICD_CODE).collect()} == {("2", "positive"), ("2", "mention"), ("2", "negatives")}


def test_splits_groups_and_samples(spark):
    pairs = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (3, "b"), (4, "c"), (5, None)], "id long, value string")
    assert dict(dataset.group_components(pairs).collect()) == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}
    assert dataset.split_groups(pairs).groupBy("group").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    rows = spark.range(100)
    first = {r.id: r.split for r in dataset.split(rows, "id").collect()}
    assert sorted(map(list(first.values()).count, ("train", "dev", "internal_test"))) == [10, 10, 80]
    assert first == {r.id: r.split for r in dataset.split(rows.repartition(7), "id").collect()}
    made = dataset.fill_templates(spark, ["BN bị {diagnosis}."], "diagnosis", list(templates.DIAGNOSES), "CHẨN_ĐOÁN", 20).collect()
    assert all(r.text[r.entities[0].start : r.entities[0].end] == r.entities[0].text for r in made)
    entries = kb.icd(spark).select("code", F.col("chapter").alias("family"), F.array("name_vi").alias("mentions"))
    drawn = dataset.linking_samples(spark, entries, templates.ICD_CONTEXTS, 15).collect()
    assert len(drawn) == 15 and all(r.mention in r.query_text and r.positive not in r.negatives and len(r.negatives) == 4 for r in drawn)


def test_variants(spark):
    df = spark.createDataFrame([(1, "Đau bụng"), (2, "x"), (3, "")], "id long, t string")
    for kind in ("insertion", "deletion", "swap", "keyboard"):
        got = {r.id: r.v for r in df.select("id", dataset.typo(F.col("t"), kind, 3, "id").alias("v")).collect()}
        assert abs(len(got[1]) - 8) <= 1
    row = df.where("id = 1").select(dataset.plain_letters(F.col("t")).alias("a"), dataset.compose(F.lit("é")).alias("b"), dataset.with_pronoun(F.col("t"), 1, "id").alias("c")).first()
    assert (row.a, row.b) == ("Dau bung", "é") and row.c.endswith(" đau bụng")


def test_token_round_trip_and_threshold(spark):
    rows = [([1, 6, 0, 5], [(0, 2), (2, 4), (5, 6), (7, 9)], [0.9, 0.5, 1.0, 0.2])]
    df = spark.createDataFrame(rows, "p array<int>, o array<struct<start:int,end:int>>, c array<double>")
    one = df.select(
        tokens.decode(F.col("p"), F.col("o"), F.col("c"), 0.3).alias("mean"),
        tokens.decode(F.col("p"), F.col("o"), F.col("c"), 0.3, pairwise=True).alias("pair"),
        tokens.align(F.col("o"), tokens.decode(F.col("p"), F.col("o"))).alias("back"),
        tokens.softmax_at(F.array(F.lit(0.0), F.lit(0.0)), F.lit(1)).alias("s"),
    ).first()
    assert [(e.start, e.end, round(e.confidence, 2)) for e in one.mean] == [(0, 4, 0.7)] == [(e.start, e.end, round(e.confidence, 2)) for e in one.pair]
    assert one.back == [1, 6, 0, 5] and one.s == 0.5


def test_levels_and_assertion_metrics(spark):
    schema = "doc_id int, text string, start int, end int, type string, assertions array<string>, candidates array<string>"
    gold = spark.createDataFrame([(1, "ho", 0, 2, "T", ["isNegated"], ["A"]), (1, "x", 3, 4, "T", [], [])], schema)
    out = spark.createDataFrame([(1, "ho", 0, 2, "T", ["isNegated"], ["A", "B"]), (1, "x", 3, 4, "T", ["isFamily"], [])], schema)
    assert {r.level: r.tp for r in metrics.strict_levels(gold, out).collect()} == {1: 2, 2: 2, 3: 1, 4: 1, 5: 0}
    pairs = gold.select(F.col("assertions").alias("gold"), "start").join(out.select(F.col("assertions").alias("found"), "start"), "start")
    assert {r.label: (r.tp, r.fp, r.fn) for r in metrics.assertion_metrics(pairs).collect()} == {"isNegated": (1, 0, 0), "isFamily": (0, 1, 0), "isHistorical": (0, 0, 0)}
    ranks = spark.createDataFrame([(1, 1), (3, 1), (1, None)], "rank_before int, rank_after int")
    row = metrics.before_after(ranks).first()
    assert (row.better, row.worse, row.same) == (1, 1, 1)


def test_sources_and_sinks(spark, tmp_path, docs):
    folder = tmp_path / "notes"
    folder.mkdir()
    (folder / "a.txt").write_bytes("  ho khan \n".encode())
    (folder / "b.txt").write_bytes("caf\xe9".encode("latin-1"))
    (folder / "c.txt").write_bytes(b"")
    got = {r.doc_id: (r.text, r.error) for r in io.read_texts(spark, str(folder)).collect()}
    assert got == {"a": ("ho khan", None), "b": ("café", None)} | ({"c": ("", "empty")} if "c" in got else {})
    lines = tmp_path / "s.jsonl"
    lines.write_text(json.dumps({"id": "1", "text": "ho", "entities": [], "extra": "e"}) + "\n\n" + json.dumps({"id": "2", "text": "x", "source": "s"}) + "\n")
    rows = {r.id: r for r in io.read_samples(spark, str(lines)).collect()}
    assert rows["1"].metadata == {"extra": "e"} and rows["1"].source == "template" and rows["2"].source == "s" and rows["2"].entities == []
    results = spark.createDataFrame([(1, [("ho", [0, 2], "T", ["isNegated"], [])]), (2, [])], "doc_id long, entities array<struct<text:string,position:array<int>,type:string,assertions:array<string>,candidates:array<string>>>")
    io.write_results(results, str(tmp_path / "out"))
    assert {(r.kind, r.name, r.n) for r in io.run_statistics(results).collect()} == {("type", "T", 1), ("assertion", "isNegated", 1), ("documents", "with_entities", 1), ("documents", "empty", 1)}
    io.write_csv(results.select("doc_id", F.array(F.lit("a"), F.lit("b")).alias("l")), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().l == "a|b"


def test_stream_equals_batch(spark, tmp_path, docs, found):
    source = str(tmp_path / "in")
    docs.coalesce(1).write.parquet(source)
    stream = notes.stream_entities(spark, source)
    notes.link_stream(stream, str(tmp_path / "out"), str(tmp_path / "state"), pipeline.Config(link_icd=False, link_drugs=False)).awaitTermination()
    key = ["doc_id", "start", "end", "type"]
    got = spark.read.parquet(str(tmp_path / "out")).select(*key)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, found.select(*key).collect()))


def test_config():
    c = pipeline.Config.from_dict({"top_k": 3, "unknown": 1, "merge": None})
    assert c.n_candidates == 3 and c.merge == "rrf"


FAST = [q for q in registry.ORACLE_SQL if q not in ("span_proximity", "nearest_preceding", "ablation_notes", "clinical_notes")]


@pytest.mark.parametrize("name", FAST)
def test_query_matches_sql(spark, sf_dir, name):
    import os

    import duckdb

    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf_dir}/{f}'")
    got, want = registry.QUERIES[name](spark, sf_dir).toPandas(), con.execute(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    tidy = lambda df: sorted(str([round(float(x), 5) if isinstance(x, float) else x for x in r]) for r in df[sorted(df.columns)].itertuples(index=False))
    assert tidy(got) == tidy(want)


def test_assertion_strategies(spark):
    from noteweave.operators import ensemble

    schema = "id int, is_negated boolean, is_historical boolean, is_family boolean, confidence double, p_negated double, p_historical double, p_family double, p_confidence double"
    rows = [(1, True, False, False, 0.9, 0.2, 0.8, 0.1, 0.7), (2, False, False, False, 0.4, 0.9, 0.1, 0.1, 0.6), (3, True, False, False, 0.9, None, None, None, None)]
    df = spark.createDataFrame(rows, schema)
    got = lambda s: {r.id: (r.negated, r.historical, r.origin, r.disagreement) for r in ensemble.combine(df, s).collect()}
    assert got("rule_only") == {1: (True, False, "rule", False), 2: (False, False, "rule", False), 3: (True, False, "rule", False)}
    assert got("voting")[1] == (True, True, "ensemble", True) and got("voting")[3] == (True, False, "rule", False)
    assert got("rule_then_classifier")[2] == (True, False, "classifier", False) and got("rule_then_classifier")[1][2] == "rule"
    assert got("rule_override")[1] == (True, False, "rule", True) and got("rule_override")[2] == (True, False, "ensemble", False)
    entities = "sample_id int, text string, type string"
    gold = spark.createDataFrame([(1, "ho", "TRIỆU_CHỨNG")], entities)
    found = spark.createDataFrame([(1, "ho", "TRIỆU_CHỨNG"), (2, "aspirin", "THUỐC"), (2, "aspirin", "THUỐC")], entities)
    review = ensemble.to_review(spark.range(1, 3).selectExpr("int(id) as sample_id"), gold, found)
    assert {tuple(r) for r in review.collect()} == {(2, "count_gap", None), (2, "unmatched_entity", "aspirin"), (1, "short_span", "ho")}
