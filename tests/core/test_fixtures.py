"""Operators on small fixtures with expected rows."""

import pytest
from pyspark.sql import functions as F

from noteweave.functions import normalize, scan
from noteweave.functions.fixed_values import DIACRITIC_VARIANTS, PARAPHRASES
from noteweave.operators import assertion, base_linker, dataset, metrics, rerank, resolve, retrieve, tokens, validate
from noteweave.plans import pipeline, table_queries
from noteweave.sources import kb

SPANS = [
    (1, 1, 12, 19, "TRIỆU_CHỨNG", 0.9, "regex"), (1, 2, 16, 24, "TRIỆU_CHỨNG", 0.8, "regex"), (1, 3, 12, 17, "TRIỆU_CHỨNG", 0.7, "dictionary"),
    (2, 1, 0, 10, "TRIỆU_CHỨNG", 0.9, "regex"), (2, 2, 0, 10, "CHẨN_ĐOÁN", 0.7, "dictionary"), (2, 3, 30, 35, "THUỐC", 0.6, "regex"),
    (3, 1, 0, 16, "KẾT_QUẢ_XÉT_NGHIỆM", 0.9, "regex"), (3, 2, 8, 11, "KẾT_QUẢ_XÉT_NGHIỆM", 0.7, "regex"), (3, 3, 8, 11, "KẾT_QUẢ_XÉT_NGHIỆM", 0.8, "dictionary"),
    (4, 1, 5, 9, "THUỐC", 0.5, "regex"), (4, 2, 5, 9, "THUỐC", 0.7, "dictionary"),
]


@pytest.fixture(scope="module")
def spans(spark):
    return spark.createDataFrame([(*r, None) for r in SPANS], "doc_id int, seq long, start int, end int, type string, confidence double, source string, section string")


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_resolution(spans):
    merged = resolve.merge_same_spans(spans)
    got = rows(resolve.drop_overlaps(merged), "doc_id", "start", "end", "type")
    assert got == [(1, 12, 19, "TRIỆU_CHỨNG"), (2, 0, 10, "TRIỆU_CHỨNG"), (2, 30, 35, "THUỐC"), (3, 0, 16, "KẾT_QUẢ_XÉT_NGHIỆM"), (4, 5, 9, "THUỐC")]
    assert rows(validate.overlap_pairs(spans).where("doc_id = 1"), "a", "b") == [(1, 2), (1, 3), (2, 3)]
    log = resolve.conflict_log(merged).collect()
    assert [(r.doc_id, r.outcome) for r in log] == [(2, "type_conflict")] and log[0].logged_at is not None
    once = resolve.union_once([spans.where("source = 'regex'"), spans.where("source = 'dictionary'")])
    assert rows(once.where("doc_id = 4"), "seq", "source") == [(1, "regex")] and once.count() == 9


def test_errors_and_ratios(spark):
    schema = "doc_id int, text string, start int, end int, type string"
    gold = spark.createDataFrame([(1, "ho", 0, 2, "T"), (1, "aspirin", 5, 12, "D"), (2, "hen", 3, 6, "C"), (2, "sốt", 9, 12, "T"), (3, "ho", 4, 6, "T")], schema)
    found = spark.createDataFrame([(1, "ho", 0, 2, "T"), (1, "aspirin", 5, 12, "C"), (2, "hen", 3, 6, "C"), (2, "sốt", 8, 11, "T"), (3, "đau", 7, 10, "T")], schema)
    kinds = rows(metrics.error_kinds(gold, found), "doc_id", "text", "error")
    assert kinds == [(1, "aspirin", "wrong_type"), (2, "sốt", "wrong_boundary"), (3, "ho", "missed"), (3, "đau", "false_positive")]
    assert rows(metrics.prf(gold, found, ["doc_id", *metrics.KEY]), "tp", "fp", "fn") == [(2, 3, 3)]


def test_classified_errors(spark):
    schema = "doc_id int, seq int, text string, start int, end int, type string, assertions array<string>, candidates array<string>"
    gold = [(1, 1, "ho", 0, 2, "T", [], []), (1, 2, "ho", 9, 11, "T", [], []), (1, 3, "hen", 20, 23, "CHẨN_ĐOÁN", ["isNegated"], ["J45.9"]), (2, 1, "x", 0, 1, "T", [], []), (2, 2, "x", 0, 1, "T", [], [])]
    found = [(1, 1, "ho", 0, 2, "T", [], []), (1, 2, "ho", 5, 7, "T", [], []), (1, 3, "hen", 20, 23, "CHẨN_ĐOÁN", [], []), (3, 1, "y", 0, 1, "T", None, [])]
    got = rows(metrics.classified_errors(spark.createDataFrame(gold, schema), spark.createDataFrame(found, schema)), "doc_id", "text", "error", "start")
    assert got == sorted(
        [(1, "ho", "missed_entity", 9), (2, "x", "missed_entity", 0), (1, "ho", "false_positive", 5), (3, "y", "false_positive", 0)]
        + [(1, "ho", "wrong_boundary", 5), (1, "ho", "wrong_boundary", 0), (1, "hen", "wrong_assertion", 20), (1, "hen", "icd_gold_missing", 20)]
    )


def test_filled_slots(spark):
    slots = {"drug": (["aspirin", "metformin"], "THUỐC"), "n": (["1", "22"], None)}
    made = dataset.fill_slots(spark, ["BN dùng {drug} {n} viên, {drug}.", "Không {other} {drug}", "chữ"], slots, 60).collect()
    assert len(made) == 60 and {len(r.entities) for r in made} == {0, 1, 2} and any("{other}" in r.text for r in made)
    assert all(r.text[e.start : e.end] == e.text and e.type == "THUỐC" for r in made for e in r.entities)


def test_tokens(spark):
    data = [(1, [0, 4, 9, 0], [(0, 0), (0, 4), (5, 10), (11, 12)]), (2, [1, 6, 9, 1, 5], [(0, 2), (2, 4), (5, 7), (8, 9), (10, 12)]), (3, [6, 0, 2], [(0, 2), (3, 4), (5, 9)])]
    df = spark.createDataFrame(data, "id int, pred array<int>, offsets array<struct<start:int,end:int>>").withColumn("e", tokens.decode(F.col("pred"), F.col("offsets")))
    got = rows(df.select("id", F.explode("e").alias("e")), "id", "e.start", "e.end", "e.type")
    assert got == [(1, 0, 10, "CHẨN_ĐOÁN"), (2, 0, 4, "TRIỆU_CHỨNG"), (2, 5, 7, "CHẨN_ĐOÁN"), (2, 8, 9, "TRIỆU_CHỨNG"), (2, 10, 12, "THUỐC"), (3, 5, 9, "TÊN_XÉT_NGHIỆM")]
    assert [r.a for r in df.orderBy("id").select(tokens.align(F.col("offsets"), F.col("e")).alias("a")).collect()] == [[-100, 4, 9, 0], [1, 6, 4, 1, 5], [0, 0, 2]]


def test_base_linker(spark):
    entries = kb.base_drugs(spark)
    said = [(1, "Aspirin 81 MG oral tablet"), (2, "amlodipine 10,4 mg po daily"), (3, "metoprolol"), (4, "nothing known 5"), (5, ""), (6, None), (7, "senna")]
    mentions = spark.createDataFrame(said, "id int, mention string")
    got = {}
    for r in base_linker.link_base(mentions, entries).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append((r.rxcui, round(r.score, 4)))
    assert got[1] == [("243670", 1.0), ("212033", 0.7)]
    assert got[2] == [("308135", 0.7), ("308136", 0.5)]
    assert got[3] == [("866436", 0.6), ("866924", 0.6)] and got[7] == [("312935", 0.6)] and not {4, 5, 6} & set(got)
    p = {r.id: r.p for r in mentions.select("id", base_linker.parse_base(F.col("mention")).alias("p")).collect()}
    assert p[5] is None and p[6] is None and (p[2].strength_value, p[2].unit, p[2].route, p[2].frequency, p[2].ingredient) == (10.4, "MG", "po", "daily", "amlodipine")
    assert p[4].ingredient == "nothing known" and p[1].dose_form == "tablet"


def test_splits_by_type(spark):
    data = [(k, "a" if k % 2 else None, f"v{k // 4}") for k in range(200)]
    got = dataset.split_groups_by_type(spark.createDataFrame(data, "id long, stratum string, value string"))
    assert got.count() == 200 and got.groupBy("group").agg(F.count_distinct("split", "stratum").alias("n")).where("n > 1").count() == 0
    n = {(r.stratum, r.split): r.n for r in got.groupBy("stratum", "split").agg(F.count_distinct("group").alias("n")).collect()}
    assert n == {(s, p): k for s in ("a", "no_entity") for p, k in (("train", 40), ("dev", 5), ("internal_test", 5))}


def test_cross_encoder_samples(spark):
    icd = kb.icd(spark)
    samples = spark.createDataFrame([(1, "tăng huyết áp", "I10"), (2, "x", "nowhere")], "id long, mention string, positive string")
    made = dataset.cross_encoder_icd(samples, icd).collect()
    kinds = [r.negative_type for r in made]
    assert {r.id for r in made} == {1} and kinds.count("positive") == 1 and kinds.count("random") == 2 and len({(r.candidate, r.negative_type) for r in made}) == len(made)
    assert all(r.label == (r.candidate == "I10") and r.text.startswith(r.candidate) for r in made)
    chapter = {r.code: r.chapter for r in icd.collect()}
    assert all((chapter[r.candidate] == chapter["I10"]) == (r.negative_type in ("positive", "hard_same_chapter")) for r in made if r.negative_type != "hard_same_alias")
    drugs = dataset.cross_encoder_drugs(spark.createDataFrame([(1, "6809")], "id long, positive string"), kb.drugs(spark)).collect()
    assert sorted(r.candidate for r in drugs if r.negative_type == "hard_same_ingredient") == ["860975", "861007"]
    assert "RxCUI: 6809 | Metformin 500mg | ingredient: Metformin | strength: 500.0 MG | dose form: tablet | brand: Glucophage" in {r.text for r in drugs}


def test_changed_texts(spark):
    df = spark.createDataFrame([(k, "Bệnh nhân bị sốt, đau đầu và ho; đường ổn. bệnh nhân") for k in range(40)], "id long, t string")
    got = [r.t for r in df.select(dataset.diacritic_error(F.col("t"), 0.5, 3, "id").alias("t")).collect()]
    known = {c: {c, *own} for c, own in DIACRITIC_VARIANTS.items()}
    assert len(set(got)) > 20 and all(b in known.get(a, {a}) for t in got for a, b in zip("Bệnh nhân bị sốt, đau đầu và ho; đường ổn. bệnh nhân", t, strict=True))
    assert df.select(dataset.diacritic_error(F.col("t"), 0.0, 3, "id").alias("t")).distinct().count() == 1
    said = [r.t for r in df.select(dataset.paraphrase(F.col("t"), 3, "id").alias("t")).collect()]
    assert len(set(said)) > 5 and all(any(x in t for x in PARAPHRASES["sốt"]) for t in said)


def test_suspicious_and_reports(spark):
    entities = spark.createDataFrame(
        [(1, "x 126 y", 2, 5, "126", "KẾT_QUẢ_XÉT_NGHIỆM", []), (1, "x 126 y", 2, 5, "126", "KẾT_QUẢ_XÉT_NGHIỆM", []), (2, "bệnh viện", 0, 9, "bệnh viện", "TRIỆU_CHỨNG", []), (3, "đau", 0, 3, "đau", "TRIỆU_CHỨNG", None)],
        "doc_id int, note string, start int, end int, text string, type string, assertions array<string>",
    )
    found = metrics.suspicious(entities)
    assert rows(found, "doc_id", "category") == [(1, "false_positive_lab_numbers"), (2, "false_positive_symptoms"), (2, "truncated_entities")]
    report = metrics.markdown("Errors", {"By category": found.groupBy("category").agg(F.count("*").alias("n"), F.lit(0.5).alias("share"))})
    assert report.splitlines()[:7] == ["# Errors", "", "## By category", "", "| category | n | share |", "| --- | --- | --- |", "| false_positive_lab_numbers | 1 | 0.5000 |"]


def test_caches_and_configs(spark, tmp_path):
    calls = []

    def build(entries):
        calls.append(1)
        return entries.select("code", F.length("name_en").alias("n"))

    icd = kb.icd(spark)
    for _ in range(2):
        assert kb.cached(icd, str(tmp_path), "lengths", build).count() == 38
    kb.cached(icd.where("code <> 'I10'"), str(tmp_path), "lengths", build)
    assert len(calls) == 2
    kb.save(icd, str(tmp_path / "kb"))
    assert rows(kb.icd(spark, str(tmp_path / "kb")).orderBy("seq"), "code", "name_en") == rows(icd, "code", "name_en")
    (tmp_path / "c.yaml").write_text("pipeline:\n  top_k: 4\n  merge: weighted\n  other: 1\n")
    config = pipeline.Config.from_yaml(str(tmp_path / "c.yaml"))
    assert (config.top_k, config.merge, config.rerank) == (4, "weighted", False)


def test_rerankers_by_system(spark):
    drugs = retrieve.structured(spark.createDataFrame([(2, "Metformin 500 mg")], "id long, mention string"), kb.drugs(spark)).drop("rank")
    rx = drugs.join(spark.createDataFrame([(2, "Metformin 500 mg")], "id long, mention string"), "id").join(kb.drugs(spark), "rxcui")
    got = rerank.rerank_either(rx)
    assert set(got) == {"drug"} and got["drug"].where("rank_after = 1").first().rxcui == "6809"
    with pytest.raises(ValueError):
        rerank.rerank_either(spark.range(1))


def test_drug_evaluation_of_nothing(spark):
    schema = "id long, mention string, gold string, codes array<string>"
    made = metrics.judged_drugs(spark.createDataFrame([(1, "", "1191", []), (2, None, "1191", ["161"]), (3, "Aspirin 81 mg", "none", []), (4, "Aspirin 81 mg", "1191", [])], schema), kb.drugs(spark))
    assert rows(made, "id", "error") == [(1, "parse_failed"), (2, "parse_failed"), (3, "gold_not_in_kb"), (4, "no_candidates")]
    assert metrics.drug_evaluation(made.limit(0)).first().n == 0


def test_needed_letters():
    assert scan.needed(r"không\b") == ["không"] and scan.needed(r"tiền\s+sử") == ["tiền"] and scan.needed("ab?c|xy") == ["a", "xy"]
    assert scan.needed(r"[.。]") is None and scan.needed(r"(?:a|b)c") is None and scan.needed(r"\b(x1|y)\b") is None and scan.needed(r"a|\d") is None


def test_filtered_scan_finds_what_the_patterns_find():
    text = "Không có tiền sử hen. K ho; chưa sốt nhưng ko đau\n1. Tiền sử bệnh"
    compiled = assertion.RULES.compiled()
    fast = [(k, m.span()) for k, m in assertion.RULES.matches(text, compiled)]
    assert fast == [(k, m.span()) for k, rule in enumerate(compiled[0]) for m in rule.finditer(text.lower())]


def test_verdicts_of_nothing(spark):
    entity = lambda a, b: (a, b, "x", "T", 1.0)
    data = [(1, None, [entity(0, 2)]), (2, "", []), (3, "ho", None), (4, "không ho", [entity(6, 8), entity(99, 100), entity(-1, 2)]), (None, "không ho", [entity(6, 8)])]
    df = spark.createDataFrame(data, "doc_id long, text string, found array<struct<start:int,end:int,text:string,type:string,confidence:double>>")
    got = sorted(((r.doc_id or 0, r.n, r.is_negated, round(r.sure, 4)) for r in assertion.judged(df).collect()))
    assert [g[:3] for g in got] == [(0, 0, True), (1, 0, False), (4, 0, True), (4, 1, False), (4, 2, False)]
    assert all(g[3] == 1.0 for g in got if not g[2]) and assertion.judged(df.limit(0)).count() == 0


def test_cases_are_those_of_the_rules(spark):
    for text, entity, *want in table_queries.CASES:
        at = text.index(entity)
        own = assertion.Note(text, assertion.RULES.compiled()).verdict(at, at + len(entity))
        assert list(own[:3]) == want, text


def test_views(spark):
    df = spark.createDataFrame([("Đau—BỤNG  nhiều",)], "t string")
    row = df.select(normalize.squeeze_blanks(F.col("t")).alias("a"), normalize.for_alias(F.col("t")).alias("b")).first()
    assert (row.a, row.b) == ("Đau—BỤNG nhiều", "đau bụng nhiều")
