"""Registered queries of clinical operators over whole tables, with their DuckDB SQL.

The documents of the test data are not Vietnamese notes.  So each document gets a note,
a mention or a set of spans that its number and its length make, and the operators run on
those of all documents; the SQL makes the same and works out the answers by itself.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import normalize as N
from ..functions import spans as S
from ..functions.lineage import scratch
from ..operators import assertion, base_linker, dataset, ensemble, extract, metrics, rerank, resolve, retrieve, tokens, validate
from ..sources import io, kb
from ..sources import knowledge_bases as K
from . import pipeline
from .registry import COUNTS, NUMBER, RATIOS, TABLE_PAIR, WHOLE, _found, _table_pair, documents, query, span_sql, table, values


def doc_id() -> Column:
    return F.col("doc_id")


def n_chars() -> Column:
    return F.col("n_chars")


def pick(items: list, by: Column | None = None) -> Column:
    """The item whose turn it is, by the document's number."""
    return F.get(F.array(*map(F.lit, items)), F.pmod(doc_id() if by is None else by, F.lit(len(items))).cast("int"))


def pick_sql(items: list, by: str = "doc_id") -> str:
    return "([" + ", ".join("'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x) for x in items) + f"])[{by} % {len(items)} + 1]"


# --- labs, drugs, diseases ---------------------------------------------------------------


def lab_note() -> Column:
    return F.concat(F.lit("Glucose "), n_chars().cast("string"), F.lit(" mmol/L, WBC "), F.pmod(doc_id(), F.lit(90)).cast("string"), F.lit(",5 H " + "." * 60 + " 77"))


LAB_SQL = "l AS (SELECT doc_id, CAST(n_chars AS VARCHAR) AS n, CAST(doc_id % 90 AS VARCHAR) AS w FROM documents)"


def _labs(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", lab_note().alias("text")).select("doc_id", "text", extract.RULES.scan(F.col("text")).alias("m"))
    rows = rows.withColumn("tests", extract.lab_tests(F.col("m")))
    return rows.withColumn("results", extract.lab_results(F.col("text"), F.col("m"), F.col("tests")))


@query(
    f"""WITH {LAB_SQL} SELECT doc_id, 0 AS start, 7 AS "end", 'Glucose' AS text, 'Glucose' AS normalized_name FROM l
    UNION ALL SELECT doc_id, CAST(17 + length(n) AS INTEGER), CAST(20 + length(n) AS INTEGER), 'WBC', 'WBC' FROM l"""
)
def lab_tests_notes(spark, sf_dir):
    return _labs(spark, sf_dir).select("doc_id", F.explode("tests").alias("t")).select("doc_id", "t.*")


@query(
    f"""WITH {LAB_SQL} SELECT doc_id, 8 AS start, CAST(15 + length(n) AS INTEGER) AS "end", n || ' mmol/L' AS text, CAST(n AS DOUBLE) AS value,
      CAST(NULL AS VARCHAR) AS unit, false AS is_abnormal FROM l
    UNION ALL SELECT doc_id, CAST(21 + length(n) AS INTEGER), CAST(24 + length(n) + length(w) AS INTEGER), w || ',5 ', CAST(w || '.5' AS DOUBLE), NULL, true FROM l"""
)
def lab_results_notes(spark, sf_dir):
    return _labs(spark, sf_dir).select("doc_id", F.explode("results").alias("r")).select("doc_id", "r.*")


@query(f"WITH {LAB_SQL} SELECT doc_id, 'Glucose' AS normalized_name, CAST(n AS DOUBLE) AS value FROM l UNION ALL SELECT doc_id, 'WBC', CAST(w || '.5' AS DOUBLE) FROM l")
def lab_panels_notes(spark, sf_dir):
    each = _labs(spark, sf_dir).select("doc_id", F.explode(extract.lab_panel(F.col("tests"), F.col("results"))).alias("p"))
    return each.select("doc_id", "p.normalized_name", "p.result.value")


DOSED = ["Alprazolam", "Ceftriaxone", "Omeprazole"]


def dose() -> Column:
    return F.concat(pick(DOSED), F.lit(" "), (F.pmod(doc_id(), F.lit(500)) + 1).cast("string"), F.lit(" mg"))


DOSE_SQL = f"d AS (SELECT doc_id, {pick_sql(DOSED)} AS name, (doc_id % 500 + 1) || ' mg' AS dose FROM documents)"


@query(
    f"""WITH {DOSE_SQL} SELECT doc_id, 5 AS start, 14 AS "end", 'metformin' AS text, 'metformin' AS ingredient, CAST(NULL AS VARCHAR) AS strength, 0.85::DOUBLE AS confidence FROM d
    UNION ALL SELECT doc_id, 16, CAST(17 + length(name) + length(dose) AS INTEGER), name || ' ' || dose, name, dose, 0.9 FROM d"""
)
def drug_mentions_notes(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", F.concat(F.lit("Uống metformin, "), dose(), F.lit(" po bid")).alias("text"))
    rows = rows.select("doc_id", "text", extract.RULES.scan(F.col("text")).alias("m"))
    return rows.select("doc_id", F.explode(extract.drugs(F.col("text"), F.col("m"))).alias("d")).select("doc_id", "d.*")


@query(f"WITH {DOSE_SQL} SELECT doc_id, name AS ingredient, dose AS strength, {pick_sql(['po', 'oral'])} AS route, {pick_sql(['bid', 'daily', 'q8h'])} AS frequency FROM d")
def drug_parts_mentions(spark, sf_dir):
    text = F.concat(dose(), F.lit(" "), pick(["po", "oral"]), F.lit(" "), pick(["bid", "daily", "q8h"]))
    return documents(spark, sf_dir).select("doc_id", extract.drug_parts(text).alias("p")).select("doc_id", "p.*")


@query(
    """WITH d AS (SELECT doc_id, length('Chẩn đoán viêm phổi. Ghi chú ' || n_chars) + 110 + 4 AS b FROM documents)
    SELECT doc_id, 10 AS start, 19 AS "end", 'viêm phổi' AS text, 'CHẨN_ĐOÁN' AS context, true AS is_diagnosed, 0.9::DOUBLE AS confidence FROM d
    UNION ALL SELECT doc_id, CAST(b AS INTEGER), CAST(b + 8 AS INTEGER), 'đau ngực', 'TRIỆU_CHỨNG', false, 0.8 FROM d"""
)
def disease_mentions_notes(spark, sf_dir):
    text = F.concat(F.lit("Chẩn đoán viêm phổi. Ghi chú "), n_chars().cast("string"), F.lit("." * 110 + " BN đau ngực"))
    rows = documents(spark, sf_dir).select("doc_id", text.alias("text")).select("doc_id", "text", extract.RULES.scan(F.col("text")).alias("m"))
    return rows.select("doc_id", F.explode(extract.diseases(F.col("text"), F.col("m"))).alias("d")).select("doc_id", "d.*")


@query(
    f"""WITH {LAB_SQL} SELECT doc_id, 0 AS start, 7 AS "end", 'Glucose' AS text, 'TÊN_XÉT_NGHIỆM' AS type, 0.85::DOUBLE AS confidence FROM l
    UNION ALL SELECT doc_id, 8, CAST(15 + length(n) AS INTEGER), n || ' mmol/L', 'KẾT_QUẢ_XÉT_NGHIỆM', 0.85 FROM l
    UNION ALL SELECT doc_id, CAST(17 + length(n) AS INTEGER), CAST(26 + length(n) AS INTEGER), 'metformin', 'THUỐC', 0.9 FROM l"""
)
def baseline_entities_notes(spark, sf_dir):
    text = F.concat(F.lit("Glucose "), n_chars().cast("string"), F.lit(" mmol/L; metformin"))
    return pipeline.baseline_entities(documents(spark, sf_dir).select("doc_id", text.alias("text")))


#: Words of conversations, to be found in their sentences.
LONG_WORD = "[a-z]{9,}"


# --- assertions --------------------------------------------------------------------------

#: text, entity, whether it is negated, historical, a relative's.
CASES = [
    ("Bệnh nhân không ho.", "ho", True, False, False),
    ("Bệnh nhân chưa sốt.", "sốt", True, False, False),
    ("Không có dấu hiệu ho.", "ho", True, False, False),
    ("Không ho nhưng đau ngực.", "ho", True, False, False),
    ("Không ho nhưng đau ngực.", "đau ngực", False, False, False),
    ("Không sốt tuy nhiên đau đầu.", "sốt", True, False, False),
    ("Không sốt tuy nhiên đau đầu.", "đau đầu", False, False, False),
    ("Không ho. Bệnh nhân sốt.", "sốt", False, False, False),
    ("Bố bị đái tháo đường.", "đái tháo đường", False, False, True),
    ("Mẹ bị hen.", "hen", False, False, True),
    ("Đã từng bị viêm phổi.", "viêm phổi", False, True, False),
    ("Trước đây mắc hen.", "hen", False, True, False),
    ("Bệnh nhân đau ngực.", "đau ngực", False, False, False),
    ("Bố có tiền sử đau tim.", "đau tim", False, False, True),
]
CASES_SQL = values([(k, *c) for k, c in enumerate(CASES)], "k, text, entity, negated, historical, family")


@query(f'SELECT doc_id, CAST(instr(c.text, c.entity) - 1 AS INTEGER) AS start, negated, historical, family FROM documents JOIN (SELECT * FROM {CASES_SQL}) c ON c.k = doc_id % {len(CASES)}')
def assertion_flags_notes(spark, sf_dir):
    cases = pick([c[0] for c in CASES]).alias("text"), pick([c[1] for c in CASES]).alias("entity")
    rows = documents(spark, sf_dir).select("doc_id", *cases)
    start = F.call_function("locate", F.col("entity"), F.col("text")) - 1
    found = F.array(F.struct(start.alias("start"), (start + F.char_length("entity")).alias("end"), F.col("entity").alias("text"), F.lit("TRIỆU_CHỨNG").alias("type"), F.lit(1.0).alias("confidence")))
    flags = [F.col(f"is_{c}").alias(c) for c in ("negated", "historical", "family")]
    return assertion.judged(rows.withColumn("found", found)).select("doc_id", "start", *flags)


CUED = [("Bệnh nhân không ho", [(10, 15, "NEGATION", 10), (10, 18, "NEGATION", 25)]), ("Bệnh nhân chưa sốt", [(10, 14, "NEGATION", 10)])]
CUED_SQL = values([(k, *c) for k, (_, own) in enumerate(CUED) for c in own], 'k, start, "end", kind, priority')


@query(f'SELECT doc_id, start, "end", kind, priority FROM documents JOIN (SELECT * FROM {CUED_SQL}) c ON c.k = doc_id % {len(CUED)}')
def assertion_cues_notes(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", pick([c[0] for c in CUED]).alias("text"))
    found = F.explode(assertion.cues(assertion.RULES.scan(F.col("text")))).alias("c")
    return rows.select("doc_id", found).select("doc_id", "c.start", "c.end", "c.kind", "c.priority")


@query(
    f"""WITH t AS (SELECT conv_id * 1000 + turn AS doc_id, coalesce(text, '') AS text FROM conversations), {span_sql("[.。;；!！?？]", "t")}, {span_sql("(?m)^[ \t]*[0-9]+[.)][ \t]+", "t", name="h")},
    {span_sql(LONG_WORD, "t", name="w")},
    cuts AS (SELECT DISTINCT doc_id, c FROM (SELECT doc_id, end_ AS c FROM s UNION ALL SELECT doc_id, start FROM h) JOIN t USING (doc_id) WHERE c > 0 AND c < length(text)),
    lows AS (SELECT doc_id, 0 AS c FROM t WHERE text <> '' UNION ALL SELECT doc_id, c FROM cuts)
    SELECT w.doc_id, w.start, max(c) AS sentence FROM w JOIN lows ON lows.doc_id = w.doc_id AND c <= w.start GROUP BY w.doc_id, w.start"""
)
def point_in_sentence(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    rows = rows.withColumn("_m", assertion.RULES.scan(F.col("text"))).withColumn("_k", assertion.conjunctions(F.col("_m")))
    rows = rows.withColumn("s", assertion.sentences(F.col("text"), F.col("_m"), F.col("_k")))
    found = F.transform(S.find_spans(F.col("text"), LONG_WORD), lambda x: F.struct(x["start"], assertion.first_around(F.col("s"), x["start"])["start"].alias("sentence")))
    return rows.select("doc_id", F.explode(found).alias("f")).select("doc_id", "f.start", "f.sentence")


P = [round(k / 10, 1) for k in range(10)]
FUSED_FLAGS = """d AS (SELECT doc_id, doc_id % 2 = 0 AS n, doc_id % 3 = 0 AS h, doc_id % 5 = 0 AS f, (doc_id % 10) / 10.0 AS c,
    CASE WHEN doc_id % 7 > 0 THEN (n_chars % 10) / 10.0 END AS pn, CASE WHEN doc_id % 7 > 0 THEN (n_chars % 9) / 10.0 END AS ph, CASE WHEN doc_id % 7 > 0 THEN (n_chars % 8) / 10.0 END AS pf,
    CASE WHEN doc_id % 7 > 0 THEN (n_chars % 6) / 10.0 END AS pc FROM documents),
  e AS (SELECT *, coalesce(pn >= 0.5, false) AS mn, coalesce(ph >= 0.5, false) AS mh, coalesce(pf >= 0.5, false) AS mf, pc IS NOT NULL AS k FROM d),
  g AS (SELECT *, k AND ((n AND NOT mn) OR (h AND NOT mh) OR (f AND NOT mf)) AS denied FROM e),
  o AS (SELECT doc_id, 'voting' AS strategy, CASE WHEN k THEN 'ensemble' ELSE 'rule' END AS origin, g.* EXCLUDE (doc_id) FROM g
    UNION ALL SELECT doc_id, 'rule_then_classifier', CASE WHEN k AND c <= 0.5 THEN 'classifier' ELSE 'rule' END, g.* EXCLUDE (doc_id) FROM g
    UNION ALL SELECT doc_id, 'rule_override', CASE WHEN k AND NOT denied THEN 'ensemble' ELSE 'rule' END, g.* EXCLUDE (doc_id) FROM g
    UNION ALL SELECT doc_id, 'rule_only', 'rule', g.* EXCLUDE (doc_id) FROM g)"""


@query(
    f"""WITH {FUSED_FLAGS} SELECT doc_id, strategy, origin,
      CASE origin WHEN 'rule' THEN n WHEN 'classifier' THEN mn ELSE n OR mn END AS negated, CASE origin WHEN 'rule' THEN h WHEN 'classifier' THEN mh ELSE h OR mh END AS historical,
      CASE origin WHEN 'rule' THEN f WHEN 'classifier' THEN mf ELSE f OR mf END AS family,
      round(CAST(CASE origin WHEN 'rule' THEN c WHEN 'classifier' THEN pc ELSE (c + pc) / 2 END AS DOUBLE), 6) AS sure, denied AND strategy <> 'rule_only' AS disagreement FROM o"""
)
def assertion_strategies_documents(spark, sf_dir):
    some = lambda k: F.when(F.pmod(doc_id(), F.lit(7)) > 0, F.pmod(n_chars(), F.lit(k)) / 10)
    rows = documents(spark, sf_dir).select(
        "doc_id",
        *((F.pmod(doc_id(), F.lit(k)) == 0).alias(f"is_{f}") for f, k in zip(ensemble.FLAGS, (2, 3, 5), strict=True)),
        (F.pmod(doc_id(), F.lit(10)) / 10).alias("confidence"),
        *(some(k).alias(f"p_{f}") for f, k in zip((*ensemble.FLAGS, "confidence"), (10, 9, 8, 6), strict=True)),
    )
    out = None
    for strategy in ("voting", "rule_then_classifier", "rule_override", "rule_only"):
        made = ensemble.combine(rows, strategy)
        own = made.select("doc_id", F.lit(strategy).alias("strategy"), "origin", *ensemble.FLAGS, F.round("sure", 6).alias("sure"), "disagreement")
        out = own if out is None else out.unionByName(own)
    return out


# --- spans and resolution ----------------------------------------------------------------

#: Numbers (surer) and words with digits of every document, in one order.
VIEWED = f"""{WHOLE}, v AS (SELECT doc_id, start, end_, match, CASE WHEN contains(match, '.') OR contains(match, ',') THEN 'decimal' ELSE 'whole' END AS type, 0.9::DOUBLE AS confidence, 'regex' AS source, 2 * i AS seq FROM s
  UNION ALL SELECT doc_id, start, end_, match, CASE WHEN contains(match, '.') OR contains(match, ',') THEN 'decimal' ELSE 'whole' END, 0.8, 'dictionary', 2 * i + 1 FROM c)"""


def _viewed(spark, sf_dir):
    numbers, coded = _table_pair(spark, sf_dir)
    a = numbers.withColumns({"seq": 2 * F.col("i"), "confidence": F.lit(0.9), "source": F.lit("regex")})
    return a.unionByName(coded.withColumns({"seq": 2 * F.col("i") + 1, "confidence": F.lit(0.8), "source": F.lit("dictionary")})).drop("i")


def _as_spans(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", S.find_spans(F.col("text"), NUMBER).alias("n"), S.find_spans(F.col("text"), r"[^ \t\n]*[0-9][^ \t\n]*").alias("c"))
    kind = lambda x: F.when(F.rlike(x["text"], F.lit("[.,]")), "decimal").otherwise("whole")
    part = lambda c, sure, source: F.transform(c, lambda x: S.span(x["start"], x["end"], x["text"], kind(x), sure, source))
    return rows.select("doc_id", F.concat(part("n", 0.9, "regex"), part("c", 0.8, "dictionary")).alias("s"))


GROUPED = f"""WITH RECURSIVE {VIEWED}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start, end_ DESC, confidence DESC) AS n FROM v),
  g(doc_id, n, a, b, grp) AS (SELECT doc_id, n, start, end_, 1 FROM o WHERE n = 1
    UNION ALL SELECT o.doc_id, o.n, CASE WHEN o.start < g.b AND g.a < o.end_ THEN g.a ELSE o.start END, CASE WHEN o.start < g.b AND g.a < o.end_ THEN g.b ELSE o.end_ END,
      g.grp + CASE WHEN o.start < g.b AND g.a < o.end_ THEN 0 ELSE 1 END FROM g JOIN o ON o.doc_id = g.doc_id AND o.n = g.n + 1)"""


@query(
    f"""{GROUPED}, w AS (SELECT 'longest' AS strategy, o.*, row_number() OVER (PARTITION BY o.doc_id, grp ORDER BY end_ - start DESC, o.n) AS place FROM o JOIN g ON g.doc_id = o.doc_id AND g.n = o.n
      UNION ALL SELECT 'confidence', o.*, row_number() OVER (PARTITION BY o.doc_id, grp ORDER BY confidence DESC, o.n) FROM o JOIN g ON g.doc_id = o.doc_id AND g.n = o.n
      UNION ALL SELECT 'type_priority', o.*, row_number() OVER (PARTITION BY o.doc_id, grp ORDER BY CASE type WHEN 'decimal' THEN 2 ELSE 1 END DESC, o.n) FROM o JOIN g ON g.doc_id = o.doc_id AND g.n = o.n)
    SELECT strategy, doc_id, start, end_ AS "end", source FROM w WHERE place = 1"""
)
def span_resolve(spark, sf_dir):
    rows, out = _as_spans(spark, sf_dir), None
    for strategy in ("longest", "confidence", "type_priority"):
        kept = S.resolve_anchored(F.col("s"), strategy, {"decimal": 2, "whole": 1})
        own = rows.select(F.lit(strategy).alias("strategy"), "doc_id", F.explode(kept).alias("x")).select("strategy", "doc_id", "x.start", "x.end", "x.source")
        out = own if out is None else out.unionByName(own)
    return out


@query(
    f"""WITH {span_sql("[0-9]+")} SELECT doc_id, start, end_ AS "end", trim(regexp_replace(match, '(.)', '\\1 ', 'g')) AS text,
    CASE WHEN length(match) > 1 THEN 'merged' ELSE 'regex' END AS source FROM s"""
)
def merge_adjacent_digits(spark, sf_dir):
    digits = F.transform(S.find_spans(F.col("text"), "[0-9]"), lambda x: S.span(x["start"], x["end"], x["text"], "digit", 0.5, "regex"))
    rows = documents(spark, sf_dir).select("doc_id", F.explode(S.merge_adjacent(digits)).alias("x"))
    return rows.select("doc_id", "x.start", "x.end", "x.text", "x.source")


@query(
    f"""WITH {VIEWED} SELECT doc_id, start, end_ AS "end", CASE WHEN count(DISTINCT type) > 1 THEN arg_max(type, confidence) ELSE any_value(type) END AS type,
    round(CAST(CASE WHEN count(DISTINCT type) > 1 THEN max(confidence) WHEN count(*) > 1 THEN least(avg(confidence) + 0.1, 1) ELSE avg(confidence) END AS DOUBLE), 6) AS confidence,
    string_agg(DISTINCT source, ',' ORDER BY source) AS source FROM v GROUP BY doc_id, start, end_"""
)
def merge_same_span_documents(spark, sf_dir):
    merged = resolve.merge_same_spans(_viewed(spark, sf_dir).withColumn("section", F.lit(None).cast("string")))
    return merged.select("doc_id", "start", "end", "type", F.round("confidence", 6).alias("confidence"), "source")


@query(
    f"""WITH {VIEWED}, heads AS (SELECT doc_id, start, end_ FROM c),
    m AS (SELECT h.doc_id, h.start AS hs, v.start, v.end_, v.confidence, v.source, row_number() OVER (PARTITION BY h.doc_id, h.start ORDER BY v.confidence DESC, v.source <> 'dictionary', v.start) AS place
      FROM heads h JOIN v ON v.doc_id = h.doc_id AND v.start < h.end_ AND h.start < v.end_)
    SELECT doc_id, start, end_ AS "end", source FROM m WHERE place = 1"""
)
def drop_overlaps_documents(spark, sf_dir):
    rows = _viewed(spark, sf_dir).withColumn("seq", F.when(F.col("source") == "dictionary", F.col("start")).otherwise(F.col("start") + 10**9))
    rows = rows.withColumns({"source_scores": F.expr("map()").cast("map<string,double>"), "outcome": F.lit("single")})
    return resolve.drop_overlaps(rows).select("doc_id", "start", "end", "source")


@query(
    f"""WITH {VIEWED}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, start, end_, type ORDER BY CASE source WHEN 'dictionary' THEN 0 ELSE 1 END, seq) AS place FROM v)
    SELECT source, type, count(*) AS n FROM r WHERE place = 1 GROUP BY source, type"""
)
def union_once_documents(spark, sf_dir):
    rows = _viewed(spark, sf_dir)
    kept = resolve.union_once([rows.where("source = 'dictionary'"), rows.where("source = 'regex'")])
    return kept.groupBy("source", "type").agg(F.count("*").alias("n"))


SECTIONS, KINDS = ["Chẩn đoán", "TRIỆU CHỨNG chính", "Điều trị", "Xét nghiệm", "Kết quả", "", "khác"], ["CHẨN_ĐOÁN", "TRIỆU_CHỨNG", "THUỐC", "TÊN_XÉT_NGHIỆM", "KẾT_QUẢ_XÉT_NGHIỆM"]


@query(
    f"""WITH d AS (SELECT doc_id, {pick_sql(SECTIONS)} AS s, {pick_sql(KINDS, "n_chars")} AS t, (doc_id % 100) / 100.0 AS c FROM documents),
    w AS (SELECT *, CASE WHEN s = 'Chẩn đoán' THEN CASE t WHEN 'CHẨN_ĐOÁN' THEN 1.2 WHEN 'TRIỆU_CHỨNG' THEN 0.8 ELSE 1 END
      WHEN s = 'TRIỆU CHỨNG chính' THEN CASE t WHEN 'TRIỆU_CHỨNG' THEN 1.2 WHEN 'CHẨN_ĐOÁN' THEN 0.8 ELSE 1 END WHEN s = 'Điều trị' THEN CASE t WHEN 'THUỐC' THEN 1.2 ELSE 1 END
      WHEN s = 'Xét nghiệm' THEN CASE t WHEN 'TÊN_XÉT_NGHIỆM' THEN 1.2 WHEN 'KẾT_QUẢ_XÉT_NGHIỆM' THEN 1.1 ELSE 1 END WHEN s = 'Kết quả' THEN CASE t WHEN 'KẾT_QUẢ_XÉT_NGHIỆM' THEN 1.2 ELSE 1 END ELSE 1 END AS weight FROM d)
    SELECT doc_id, CAST(weight AS DOUBLE) AS weight, round(CAST(CASE WHEN s = '' THEN c ELSE least(c * weight, 1) END AS DOUBLE), 6) AS context,
      round(CAST(least(1, c + CASE WHEN doc_id % 3 > 1 THEN 0.1 ELSE 0 END + 0.05 * (doc_id % 4)) AS DOUBLE), 6) AS sure FROM w"""
)
def section_confidence(spark, sf_dir):
    section, kind, c = pick(SECTIONS), pick(KINDS, n_chars()), F.pmod(doc_id(), F.lit(100)) / 100
    sure = resolve.entity_confidence(c, F.pmod(doc_id(), F.lit(3)), F.pmod(doc_id(), F.lit(4)).cast("double"))
    return documents(spark, sf_dir).select(
        "doc_id", resolve.section_weight(section, kind).alias("weight"), F.round(resolve.context_confidence(c, section, kind), 6).alias("context"), F.round(sure, 6).alias("sure")
    )


# --- metrics on the two views of numbers -------------------------------------------------


def _facts(df, k: int):
    flags = F.when(F.pmod(F.col("start"), F.lit(k)) == 0, F.array(F.lit("isNegated"))).otherwise(F.array().cast("array<string>"))
    codes = F.when(F.pmod(F.col("start"), F.lit(k + 2)) == 0, F.array(F.lit("A"), F.lit("B"))).otherwise(F.array(F.lit("A")))
    return df.select("doc_id", *metrics.KEY, flags.alias("assertions"), codes.alias("candidates")).distinct()


LEVELS = f"""WITH {WHOLE}, {TABLE_PAIR.split("m AS (")[0].rstrip().rstrip(",")},
  b AS (SELECT g.start % 3 = 0 AS gn, g.start % 4 = 0 AS pn, CASE WHEN g.start % 5 = 0 THEN 2 ELSE 1 END AS gc, CASE WHEN g.start % 6 = 0 THEN 2 ELSE 1 END AS pc
    FROM g JOIN p ON (g.doc_id, g.text, g.start, g.end_, g.type) = (p.doc_id, p.text, p.start, p.end_, p.type))"""


@query(
    f"""{LEVELS}, n AS (SELECT (SELECT count(*) FROM g) AS ng, (SELECT count(*) FROM p) AS np),
    l AS (SELECT 1 AS level, count(*) AS tp FROM b UNION ALL SELECT 2, count(*) FROM b UNION ALL SELECT 3, count(*) FILTER (gn = pn) FROM b
      UNION ALL SELECT 4, count(*) FILTER (gn = pn) FROM b UNION ALL SELECT 5, count(*) FILTER (gn = pn AND gc = pc) FROM b)
    SELECT level, tp, round(tp / np, 4) AS precision, round(tp / ng, 4) AS recall, round(2.0 * tp / (ng + np), 4)::DOUBLE AS f1 FROM l, n"""
)
def e2e_levels(spark, sf_dir):
    gold, found = _table_pair(spark, sf_dir)
    out = metrics.strict_levels(_facts(gold, 3), _facts(found, 4))
    f1 = F.when(F.col("precision") + F.col("recall") > 0, F.col("f1")).otherwise(0.0)
    return out.select("level", "tp", "precision", "recall", f1.alias("f1"))


@query(
    f"""{LEVELS}, c3 AS (SELECT 'isNegated' AS label, count(*) FILTER (gn AND pn) AS tp, count(*) FILTER (NOT gn AND pn) AS fp, count(*) FILTER (gn AND NOT pn) AS fn FROM b
      UNION ALL SELECT 'isHistorical', 0, 0, 0 UNION ALL SELECT 'isFamily', 0, 0, 0) SELECT *, {RATIOS} FROM c3"""
)
def assertion_metrics_documents(spark, sf_dir):
    gold, found = (_facts(df, k) for df, k in zip(_table_pair(spark, sf_dir), (3, 4), strict=True))
    key = ["doc_id", *metrics.KEY]
    pairs = gold.select(*key, F.col("assertions").alias("gold")).join(found.select(*key, F.col("assertions").alias("found")), key)
    return metrics.assertion_metrics(pairs)


@query(
    f"""WITH {WHOLE}, {TABLE_PAIR.split("m AS (")[0].rstrip().rstrip(",")},
    go AS (SELECT g.* FROM g WHERE NOT EXISTS (SELECT 1 FROM p WHERE (g.doc_id, g.text, g.start, g.end_, g.type) = (p.doc_id, p.text, p.start, p.end_, p.type))),
    po AS (SELECT p.* FROM p WHERE NOT EXISTS (SELECT 1 FROM g WHERE (g.doc_id, g.text, g.start, g.end_, g.type) = (p.doc_id, p.text, p.start, p.end_, p.type)))
    SELECT error, count(*) AS n FROM (
      SELECT CASE WHEN EXISTS (SELECT 1 FROM po WHERE (po.doc_id, po.text, po.start, po.end_) = (go.doc_id, go.text, go.start, go.end_)) THEN 'wrong_type'
        WHEN EXISTS (SELECT 1 FROM po WHERE (po.doc_id, po.text, po.type) = (go.doc_id, go.text, go.type)) THEN 'wrong_boundary' ELSE 'missed' END AS error FROM go
      UNION ALL SELECT 'false_positive' FROM po WHERE NOT EXISTS (SELECT 1 FROM go WHERE (po.doc_id, po.text) = (go.doc_id, go.text))) GROUP BY error"""
)
def error_kinds_documents(spark, sf_dir):
    return metrics.error_kinds(*_table_pair(spark, sf_dir)).groupBy("error").agg(F.count("*").alias("n"))


@query(
    """WITH r AS (SELECT CASE WHEN doc_id % 7 > 0 THEN doc_id % 7 END AS b, CASE WHEN n_chars % 5 > 0 THEN n_chars % 5 END AS a FROM documents)
    SELECT count(*) FILTER (coalesce(a, 1000000000) < coalesce(b, 1000000000)) AS better, count(*) FILTER (coalesce(a, 1000000000) > coalesce(b, 1000000000)) AS worse,
      count(*) FILTER (coalesce(a, 1000000000) = coalesce(b, 1000000000)) AS same, round(avg(coalesce(1.0 / b, 0)), 6) AS mrr_before, round(avg(coalesce(1.0 / a, 0)), 6) AS mrr_after FROM r"""
)
def rerank_before_after(spark, sf_dir):
    some = lambda c, k: F.when(F.pmod(c, F.lit(k)) > 0, F.pmod(c, F.lit(k)))
    return metrics.before_after(documents(spark, sf_dir).select(some(doc_id(), 7).alias("rank_before"), some(n_chars(), 5).alias("rank_after")))


@query(
    f"""WITH {WHOLE}, n AS (SELECT doc_id, (SELECT count(*) FROM s WHERE s.doc_id = d.doc_id) AS g, (SELECT count(*) FROM c WHERE c.doc_id = d.doc_id) AS p FROM documents d)
    SELECT doc_id AS sample_id, 'count_gap' AS trigger, CAST(NULL AS VARCHAR) AS entity_text FROM n WHERE abs(g - p) >= 2
    UNION ALL SELECT DISTINCT doc_id, 'unmatched_entity', match FROM c WHERE (contains(match, '.') OR contains(match, ',')) AND NOT EXISTS (SELECT 1 FROM s WHERE s.doc_id = c.doc_id AND s.match = c.match)
    UNION ALL SELECT DISTINCT doc_id, 'short_span', match FROM c WHERE length(match) < 3"""
)
def review_triggers(spark, sf_dir):
    kind = F.when(F.col("type") == "decimal", "THUỐC").otherwise("CHẨN_ĐOÁN").alias("type")
    gold, found = (df.select(F.col("doc_id").alias("sample_id"), "text", kind) for df in _table_pair(spark, sf_dir))
    return ensemble.to_review(documents(spark, sf_dir).select(F.col("doc_id").alias("sample_id")), gold, found)


SUSPECTS = [
    ("KẾT_QUẢ_XÉT_NGHIỆM", "126", [], "", "false_positive_lab_numbers"),
    ("TÊN_XÉT_NGHIỆM", "Na", [], "", "false_positive_lab_numbers"),
    ("KẾT_QUẢ_XÉT_NGHIỆM", "mạch 80 nhiệt độ 37", [], "", "vital_signs_clusters"),
    ("TRIỆU_CHỨNG", "Bệnh nhân", [], "", "false_positive_symptoms"),
    ("TRIỆU_CHỨNG", "đau bụng vùn", [], "", "truncated_entities"),
    ("THUỐC", "oxycodone", [], "", "truncated_entities"),
    ("THUỐC", "aspirin", ["isHistorical"], "đang uống ", "overmarked_historical"),
    ("TRIỆU_CHỨNG", "h1", [], "", "noisy_entities"),
    ("TRIỆU_CHỨNG", "đau đầu", [], "", None),
]


@query(f"SELECT doc_id, text, category FROM documents JOIN (SELECT * FROM {values([(k, c[1], c[4]) for k, c in enumerate(SUSPECTS)], 'k, text, category')}) c ON c.k = doc_id % {len(SUSPECTS)} WHERE category IS NOT NULL".replace("SELECT doc_id, text", "SELECT doc_id, c.text"))
def suspicious_entities(spark, sf_dir):
    flags = F.when(pick([len(c[2]) for c in SUSPECTS]) > 0, F.array(F.lit("isHistorical"))).otherwise(F.array().cast("array<string>"))
    head, text = pick([c[3] for c in SUSPECTS]), pick([c[1] for c in SUSPECTS])
    start = F.char_length(head)
    rows = documents(spark, sf_dir).select("doc_id", F.concat(head, text).alias("note"), start.alias("start"), (start + F.char_length(text)).alias("end"), text.alias("text"), pick([c[0] for c in SUSPECTS]).alias("type"), flags.alias("assertions"))
    return metrics.suspicious(rows).select("doc_id", "text", "category")


# --- mentions against the knowledge bases ------------------------------------------------

MENTIONS = ["viêm phổi", "hypertension", "Gout", "đái tháo đường", "ulcer", "GERD", "suy  tim", "no such thing"]
ICD_SQL = values([(k, e["code"], e.get("name_en"), e.get("synonyms") or [""]) for k, e in enumerate(K.ICD)], "seq, code, name, others")


@query(
    f"""WITH e AS (SELECT seq, code, lower(name) AS name, list_transform(others, lambda x: lower(x)) AS others FROM {ICD_SQL}),
    m AS (SELECT doc_id AS id, trim(regexp_replace(lower({pick_sql(MENTIONS)}), '\\s+', ' ', 'g')) AS q FROM documents),
    f AS (SELECT id, code, seq, CASE WHEN name = q THEN 0 WHEN list_contains(others, q) THEN 1 WHEN starts_with(name, q) THEN 2
      WHEN contains(name, q) OR len(list_filter(others, lambda x: contains(x, q))) > 0 THEN 3 END AS tier FROM m, e)
    SELECT id, code, tier, row_number() OVER (PARTITION BY id ORDER BY tier, seq) AS rank FROM f WHERE tier IS NOT NULL QUALIFY rank <= 10"""
)
def kb_search_tiers_mentions(spark, sf_dir):
    mentions = documents(spark, sf_dir).select(doc_id().alias("id"), pick(MENTIONS).alias("mention"))
    return retrieve.search_tiers(mentions, kb.icd(spark)).withColumn("rank", F.col("rank").cast("long"))


@query()
def fuzzy_topk_mentions(spark, sf_dir):
    texts = kb.icd_texts(kb.icd(spark)).withColumn("norm", N.for_fuzzy(F.col("text")))
    mentions = documents(spark, sf_dir).select(doc_id().alias("id"), pick(MENTIONS).alias("mention"))
    return retrieve.fuzzy(mentions, texts, "code", 5).withColumn("score", F.round("score", 4))


NAMED = [(k, e["code"], [x for x in (e.get("name_vi"), e.get("name_en")) if x] or [""], e.get("aliases") or [""], e.get("synonyms") or [""]) for k, e in enumerate(K.ICD)]


@query(
    f"""WITH e AS (SELECT * FROM {values(NAMED, "seq, code, names, aliases, synonyms")}),
    t AS (SELECT seq, code, 0 AS tier, unnest(names) AS text FROM e UNION ALL SELECT seq, code, 1, unnest(aliases) FROM e UNION ALL SELECT seq, code, 2, unnest(synonyms) FROM e),
    x AS (SELECT tier, trim(regexp_replace(translate(lower(text), '-–', '  '), '\\s+', ' ', 'g')) AS norm, arg_min(code, seq) AS code FROM t GROUP BY 1, 2),
    m AS (SELECT doc_id AS id, trim(regexp_replace(lower({pick_sql(MENTIONS[:5])}), '\\s+', ' ', 'g')) AS norm FROM documents)
    SELECT id, code, min(tier) AS tier FROM m JOIN x USING (norm) WHERE norm <> '' GROUP BY id, code"""
)
def kb_exact_alias_mentions(spark, sf_dir):
    mentions = documents(spark, sf_dir).select(doc_id().alias("id"), pick(MENTIONS[:5]).alias("mention"))
    found = retrieve.exact_icd(mentions, kb.icd(spark))
    texts = kb.icd_texts(kb.icd(spark)).withColumn("norm", N.for_alias(F.col("text")))
    tier = F.when(F.col("kind") == "canonical", 0).when(F.col("kind") == "alias", 1).when(F.col("kind") == "synonym", 2)
    own = mentions.withColumn("norm", N.for_alias(F.col("mention"))).join(F.broadcast(texts.withColumn("tier", tier).where("tier is not null")), "norm")
    tiers = own.groupBy("id", "code").agg(F.min("tier").alias("tier"))
    return found.join(tiers, ["id", "code"]).select("id", "code", "tier")


#: name, its form in mentions, unit, form and what the parser should make of it.
PARSED = [("Aspirin", "MG", "tablet"), ("Metformin", "mg", "tab"), ("Omeprazole", "MG", "capsule"), ("Ceftriaxone", "g", "injection"), ("Zopiclone", "mg", "")]
STRENGTHS = [81.0, 500.0, 20.0, 1.0, 7.5, 325.0, 10.0]


def drug_mention() -> Column:
    return F.btrim(F.concat_ws(" ", pick([p[0] for p in PARSED]), F.concat(F.regexp_replace(pick(STRENGTHS).cast("string"), r"\.0$", ""), pick([p[1] for p in PARSED])), pick([p[2] for p in PARSED])))


MENTION_SQL = f"""m AS (SELECT doc_id AS id, {pick_sql([p[0] for p in PARSED])} AS ing, {pick_sql(STRENGTHS)}::DOUBLE AS value, upper({pick_sql([p[1] for p in PARSED])}) AS unit,
  {pick_sql(["tablet", "tablet", "capsule", "injection", ""])} AS form_, n_chars FROM documents)"""


@query(f"WITH {MENTION_SQL} SELECT id, [ing] AS ingredients, [value] AS strength_values, [unit] AS strength_units, nullif(form_, '') AS dose_form FROM m".replace("[ing]", "ing").replace("[value]", "value").replace("[unit]", "unit"))
def parse_drug_mentions(spark, sf_dir):
    p = documents(spark, sf_dir).select(doc_id().alias("id"), N.parse_drug(drug_mention()).alias("p"))
    joined = [F.array_join(F.col(f"p.{c}"), "+").alias(c) for c in ("ingredients", "strength_units")]
    return p.select("id", *joined, F.element_at("p.strength_values", 1).alias("strength_values"), "p.dose_form")


@query("SELECT doc_id AS id, 'paracetamol extra ' || (doc_id % 90) || '.5' AS a, 'panadol extra ' || (doc_id % 90) || ',5' AS b FROM documents")
def norm_drug_mentions(spark, sf_dir):
    text = F.concat(F.lit("  PANADOL–Extra\t"), F.pmod(doc_id(), F.lit(90)).cast("string"), F.lit(",5 "))
    return documents(spark, sf_dir).select(doc_id().alias("id"), N.normalize_drug(text).alias("a"), N.drug_for_matching(text).alias("b"))


TIDY = "trim(regexp_replace(translate(lower(coalesce(text, '')), '‐‑‒–—―−-', '        '), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))"


@query(f"SELECT doc_id, md5({TIDY}) AS tidy, md5(strip_accents({TIDY}) || ' dau đ') AS plain FROM documents")
def norm_views(spark, sf_dir):
    text = F.regexp_replace(F.col("text"), "[ \u0085]", " ")
    tidy = N.squeeze_blanks(N.dashes_to_blanks(F.lower(F.coalesce(text, F.lit("")))))
    plain = N.remove_tones(F.concat(tidy, F.lit(" dấu đ")))
    return documents(spark, sf_dir).select("doc_id", F.md5(tidy.cast("binary")).alias("tidy"), F.md5(plain.cast("binary")).alias("plain"))


BASE = values([(k, e["rxcui"], e["name"], e["ingredient"], e["strength"], e["dose_form"]) for k, e in enumerate(K.DRUGS_BASE)], "seq, rxcui, name, ingredient, strength, form")
BASE_SAID = [("Aspirin", "tablet"), ("amlodipine", ""), ("Metoprolol", "tablet"), ("Clonazepam", "tab"), ("guaifenesin", "solution"), ("senna", "tablet"), ("unknown", "")]
BASE_DOSES = [81, 10, 50, 200, 0]


def base_mention() -> Column:
    return F.when(F.pmod(doc_id(), F.lit(11)) == 0, "Aspirin 81 mg  oral TABLET").otherwise(
    F.concat(pick([b[0] for b in BASE_SAID]), F.lit(" "), pick(BASE_DOSES, n_chars()).cast("string"), F.lit(" mg "), pick([b[1] for b in BASE_SAID]))
)


BASE_SQL = f"""m AS (SELECT doc_id AS id, doc_id % 11 = 0 AS whole, CASE WHEN doc_id % 11 = 0 THEN 'aspirin' ELSE lower({pick_sql([b[0] for b in BASE_SAID])}) END AS ing,
    CASE WHEN doc_id % 11 = 0 THEN 81 ELSE {pick_sql(BASE_DOSES, "n_chars")} END AS value, CASE WHEN doc_id % 11 = 0 THEN 'tablet' ELSE nullif({pick_sql([b[1] for b in BASE_SAID])}, '') END AS form FROM documents),
  e AS (SELECT *, lower(ingredient) AS k, TRY_CAST(regexp_extract(strength, '(?i)([0-9]+(?:[.,][0-9]+)?)\\s*(mg|g|ml|mcg|iu|%)', 1) AS DOUBLE) AS v FROM {BASE}),
  p AS (SELECT *, min(seq) OVER (PARTITION BY k) AS place FROM e)"""


@query(f"WITH {BASE_SQL} SELECT id, ing AS ingredient, value::DOUBLE AS strength_value, 'MG' AS unit, form AS dose_form, CASE WHEN whole THEN 'oral' END AS route FROM m")
def parse_base_mentions(spark, sf_dir):
    p = documents(spark, sf_dir).select(doc_id().alias("id"), base_linker.parse_base(base_mention()).alias("p"))
    return p.select("id", F.lower("p.ingredient").alias("ingredient"), "p.strength_value", "p.unit", "p.dose_form", "p.route")


@query(
    f"""WITH {BASE_SQL},
    a AS (SELECT id, rxcui, 0 AS tier, 0 AS place, 0 AS seq, 1.0 AS score FROM m JOIN p ON whole AND p.name = 'aspirin 81 MG Oral Tablet'),
    b AS (SELECT id, rxcui, 1 AS tier, 0 AS place, seq, 0.5 + CASE WHEN v IS NULL THEN 0 WHEN abs(value - v) < 0.01 THEN 0.3 WHEN abs(value - v) / greatest(value, 1) < 0.1 THEN 0.2 ELSE 0 END
      + CASE WHEN m.form = p.form THEN 0.2 ELSE 0 END AS score FROM m JOIN p ON m.ing = p.k WHERE value <> 0),
    f AS (SELECT * FROM a UNION ALL SELECT * FROM b),
    c AS (SELECT id, rxcui, 2 AS tier, place, seq, 0.6 AS score FROM m JOIN p ON contains(p.k, m.ing) OR contains(m.ing, p.k) WHERE id NOT IN (SELECT id FROM f)),
    u AS (SELECT id, rxcui, min((tier, place, seq)) AS o, arg_min(score, (tier, place, seq)) AS score FROM (SELECT * FROM f UNION ALL SELECT * FROM c) GROUP BY id, rxcui)
    SELECT id, rxcui, round(CAST(score AS DOUBLE), 6) AS score, row_number() OVER (PARTITION BY id ORDER BY score DESC, o) AS rank FROM u QUALIFY rank <= 5"""
)
def base_links(spark, sf_dir):
    mentions = documents(spark, sf_dir).select(doc_id().alias("id"), base_mention().alias("mention"))
    found = base_linker.link_base(mentions, kb.base_drugs(spark))
    return found.select("id", "rxcui", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


ASKED = ["Aspirin", "CLONAZEPAM", "senna 8.6  MG Oral Tablet", "metoprolol", "243670"]


@query(
    f"""WITH e AS (SELECT *, lower(ingredient) AS k, lower(name) AS nm FROM {BASE}), m AS (SELECT doc_id AS id, {pick_sql(ASKED)} AS t, trim(regexp_replace(lower({pick_sql(ASKED)}), '\\s+', ' ', 'g')) AS q FROM documents)
    SELECT 'name' AS how, id, rxcui FROM m JOIN e ON nm = q UNION ALL SELECT 'ingredient', id, rxcui FROM m JOIN e ON k = q UNION ALL SELECT 'rxcui', id, rxcui FROM m JOIN e ON rxcui = t
    UNION ALL SELECT 'part', id, rxcui FROM m JOIN e ON contains(k, q) OR contains(q, k)"""
)
def base_lookups(spark, sf_dir):
    asked, entries = documents(spark, sf_dir).select(doc_id().alias("id"), pick(ASKED).alias("mention")), kb.base_drugs(spark)
    parts = {k: base_linker.lookup(asked, entries, k) for k in ("name", "ingredient", "rxcui")} | {"part": base_linker.search_ingredients(asked, entries)}
    out = None
    for how, found in parts.items():
        own = found.select(F.lit(how).alias("how"), "id", "rxcui")
        out = own if out is None else out.unionByName(own)
    return out


def _drug_rows() -> list[tuple]:
    import re

    rows = []
    for k, (rxcui, name, short, ingredient, strength, brands, _) in enumerate(K.DRUGS):
        dose = re.search(r"([0-9.]+)([a-z]+)", strength)
        rows.append((k, rxcui, name.lower(), short.lower(), ingredient.lower(), float(dose[1]), dose[2].upper(), "tablet", brands[0].lower()))
    return rows


KB_DRUGS = values(_drug_rows(), "seq, rxcui, name, short, ing, v, u, form, brand")
FIT = """least(1, greatest(0, CASE WHEN lower(m.ing) = e.ing THEN 0.5 WHEN contains(e.ing, lower(m.ing)) OR contains(lower(m.ing), e.ing) THEN 0.35 ELSE 0 END
  + CASE WHEN abs(v - value) < 0.01 THEN 0.25 WHEN abs(v - value) / value < 0.1 THEN 0.10 ELSE -0.3 END + CASE WHEN unit = u THEN 0.10 ELSE -0.1 END + CASE WHEN form_ = form THEN 0.05 ELSE 0 END))"""


@query(
    f"""WITH {MENTION_SQL}, e AS (SELECT * FROM {KB_DRUGS}),
    t AS (SELECT id, rxcui, seq, {FIT} AS score, v = value AND unit = u AS dose, abs(v - value) < 0.01 AND unit = u AS strength, form_ = form AS f FROM m JOIN e ON lower(m.ing) = e.ing),
    w AS (SELECT *, max(dose) OVER (PARTITION BY id) AS early FROM t), x AS (SELECT *, max((NOT early AND strength) OR f) OVER (PARTITION BY id) AS later FROM w)
    SELECT id, rxcui, round(CAST(score AS DOUBLE), 4) AS score, row_number() OVER (PARTITION BY id ORDER BY score DESC, seq) AS rank FROM x
    WHERE dose OR (strength AND NOT early) OR f OR (NOT early AND NOT later) QUALIFY rank <= 20"""
)
def drug_structured_mentions(spark, sf_dir):
    mentions = documents(spark, sf_dir).select(doc_id().alias("id"), drug_mention().alias("mention"))
    found = retrieve.structured(mentions, kb.drugs(spark))
    return found.select("id", "rxcui", F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"))


RX = f"""{MENTION_SQL}, e AS (SELECT * FROM {KB_DRUGS}), c AS (SELECT *, ((id * 7 + seq) % 30) / 10.0 AS score FROM m, e),
  r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, rxcui) AS rank_before FROM c)"""


def _drug_candidates(spark, sf_dir):
    mentions = documents(spark, sf_dir).select(doc_id().alias("id"), drug_mention().alias("mention"))
    rows = mentions.join(F.broadcast(kb.drugs(spark)), F.lit(True))  # all candidates: a knowledge base of 28 rows
    return rows.withColumn("score", F.pmod(F.col("id") * 7 + F.col("seq"), F.lit(30)) / 10)


@query(
    f"""WITH {RX}, f AS (SELECT id, rxcui, rank_before, 0.40 * CASE WHEN lower(c.ing) = c.ing_1 THEN 1.0 WHEN contains(lower(c.ing), c.ing_1) OR contains(c.ing_1, lower(c.ing)) THEN 0.8 ELSE 0 END
      + 0.20 * CASE WHEN abs(value - v) < 0.01 THEN 1 ELSE 0 END + 0.10 * CASE WHEN abs(value - v) >= 0.01 AND abs(value - v) / value < 0.15 THEN 1 ELSE 0 END
      + 0.10 * CASE WHEN unit = u THEN 1 WHEN unit IN ('G', 'MG') AND u IN ('G', 'MG') THEN 0.5 ELSE 0 END
      + 0.10 * CASE WHEN form_ = '' THEN 0 WHEN form_ = form THEN 1 WHEN contains(form, form_) OR contains(form_, form) THEN 0.5 ELSE 0 END
      + 0.05 * CASE WHEN score > 0 THEN least(score / 3, 1) ELSE 0 END AS total FROM r c)
    SELECT id, rxcui, round(CAST(total AS DOUBLE), 6) AS rerank_score, row_number() OVER (PARTITION BY id ORDER BY round(CAST(total AS DOUBLE), 6) DESC, rank_before) AS rank_after FROM f QUALIFY rank_after <= 10"""
)
def rerank_rx_mentions(spark, sf_dir):
    out = rerank.rerank_drugs_by_rules(_drug_candidates(spark, sf_dir))
    return out.select("id", "rxcui", "rerank_score", F.col("rank_after").cast("long").alias("rank_after"))


USUAL = values([(k, *v) for k, v in V.STANDARD_STRENGTHS.items()], "std_name, std, std_unit")


@query(
    f"""WITH {RX}, f AS (SELECT id, rxcui, rank_before, 0.45 * CASE WHEN abs(v - value) < 0.01 THEN 0.3 WHEN unit = u AND abs(v - value) / value < 0.15 THEN 0.15 ELSE 0 END + 0.15 * least(score / 3, 1) AS total FROM r)
    SELECT id, rxcui, round(CAST(total AS DOUBLE), 6) AS rerank_score, row_number() OVER (PARTITION BY id ORDER BY round(CAST(total AS DOUBLE), 6) DESC, rank_before) AS rank_after FROM f QUALIFY rank_after <= 10"""
)
def rerank_rx_dose_mentions(spark, sf_dir):
    out = rerank.rerank_drugs_by_dose(_drug_candidates(spark, sf_dir))
    return out.select("id", "rxcui", "rerank_score", F.col("rank_after").cast("long").alias("rank_after"))


#: code, parent, names, synonyms, aliases, description, include and exclude terms.
ENTRIES = [
    ("A10", None, "alpha syndrome", ["alpha one"], ["alfa"], "wide alpha", ["river"], ["mountain"]),
    ("A10.1", "A10", "alpha syndrome type one", ["alpha minor"], ["alfa one"], None, ["lake", "river"], []),
    ("B20", "B20", "beta disorder", ["beta"], [], "of the beta", [], ["lake"]),
    ("B20.9", "B20", "beta disorder of the hill", [], ["betta"], None, [], []),
]
ICD_SAID = ["alfa", "alpha syndrome with river", "Beta", "beta disorder near the lake and hill 5 mg", "alpha one mountain"]
ICD_WORDS = "list_distinct(list_filter(string_split(lower({}), ' '), lambda w: w <> ''))"
ENTRY_SQL = values([(k, c, p, n, s or [""], a or [""], d, i or [""], x or [""]) for k, (c, p, n, s, a, d, i, x) in enumerate(ENTRIES)], "seq, code, parent, name, synonyms, aliases, description, includes, excludes")


@query(
    f"""WITH e AS (SELECT * FROM {ENTRY_SQL}), m AS (SELECT doc_id AS id, {pick_sql(ICD_SAID)} AS mention FROM documents),
    c AS (SELECT *, lower(mention) AS t, ((id * 3 + seq) % 10) / 10.0 AS score FROM m, e),
    w AS (SELECT *, {ICD_WORDS.format("mention")} AS own, list_filter(list_concat([name], synonyms, aliases, [coalesce(description, '')], includes), lambda x: x <> '') AS texts,
      max(score) OVER (PARTITION BY id) AS top, row_number() OVER (PARTITION BY id ORDER BY score DESC, code) AS rank_before,
      list_filter(includes, lambda x: x <> '' AND contains(t, x)) AS inc, list_filter(excludes, lambda x: x <> '' AND contains(t, x)) AS exc, len(list_filter(includes, lambda x: x <> '')) AS n_inc FROM c),
    f AS (SELECT *, list_max(list_transform(texts, lambda x: greatest(len(list_intersect(own, {ICD_WORDS.format("x")})) / len(list_distinct(list_concat(own, {ICD_WORDS.format("x")}))),
        len(list_filter(own, lambda y: contains(x, y))) / len(own)))) AS lexical,
      CASE WHEN list_contains(aliases, t) THEN 1.0 WHEN list_contains(synonyms, t) THEN 0.9 ELSE 0 END AS alias,
      least(0.1 * len(inc), 0.25) + CASE WHEN len(inc) > 0 THEN least(0.15 * len(inc) / n_inc + 0.05 * least(len(inc), 3), 0.25) ELSE 0 END AS include,
      least(0.15 * len(exc), 0.30) AS penalty, coalesce(parent <> code, false) AS child,
      len(own) <= 2 AND length(mention) < 25 AS brief, contains(t, 'mg') AS detail, CASE WHEN top = 0 THEN CASE WHEN score > 0 THEN 1.0 ELSE 0 END ELSE least(score / top, 1) END AS retrieval FROM w),
    g AS (SELECT *, greatest(0, 0.02 * lexical + 0.02 * alias + 0.01 * include - 0.01 * penalty + 0.01 * CASE WHEN NOT child THEN 0.05 WHEN brief THEN -0.10 ELSE 0 END + 0.94 * retrieval
      - (CASE WHEN child AND NOT detail THEN 0.25 ELSE 0 END + CASE WHEN len(exc) > 0 THEN 1.0 ELSE 0 END) * CASE WHEN retrieval > 0.9 THEN 0.3 ELSE 0.8 END) AS total FROM f)
    SELECT id, code, round(CAST(total AS DOUBLE), 6) AS rerank_score, row_number() OVER (PARTITION BY id ORDER BY round(CAST(total AS DOUBLE), 6) DESC, rank_before) AS rank_after FROM g"""
)
def rerank_icd_mentions(spark, sf_dir):
    rows = [(k, c, "", n, p, s, a, d, i, x) for k, (c, p, n, s, a, d, i, x) in enumerate(ENTRIES)]
    kinds = "seq int, code string, name_vi string, name_en string, parent_code string, synonyms array<string>, aliases array<string>, description string, include_terms array<string>, exclude_terms array<string>"
    entries = spark.createDataFrame(rows, kinds)
    asked = documents(spark, sf_dir).select(doc_id().alias("id"), pick(ICD_SAID).alias("mention"))
    rows = asked.join(F.broadcast(entries), F.lit(True)).withColumn("score", F.pmod(F.col("id") * 3 + F.col("seq"), F.lit(10)) / 10)
    return rerank.rerank_icd(rows).select("id", "code", "rerank_score", F.col("rank_after").cast("long").alias("rank_after"))


@query(
    """WITH d AS (SELECT doc_id, (n_chars % 1000)::DOUBLE AS a, (doc_id % 400)::DOUBLE AS b, (['MG', 'G', 'mcg', ''])[doc_id % 4 + 1] AS ua, (['MG', 'ug'])[n_chars % 2 + 1] AS ub,
      (['tablet', 'Syrup ', 'cream', 'patch'])[doc_id % 4 + 1] AS fa, (['Tablet', 'injection', 'cream'])[n_chars % 3 + 1] AS fb, n_chars FROM documents),
    m AS (SELECT *, CASE WHEN ua = 'G' THEN a * 1000 WHEN ua = 'mcg' THEN a / 1000 ELSE a END AS x, CASE WHEN ub = 'ug' THEN b / 1000 ELSE b END AS y, lower(trim(fa)) AS p, lower(fb) AS q FROM d)
    SELECT doc_id, CASE WHEN abs(x - y) < 0.01 THEN 0.0 WHEN abs(x - y) / greatest(x, y, 0.01) > 0.5 THEN 0.5 WHEN abs(x - y) / greatest(x, y, 0.01) > 0.2 THEN 0.3 ELSE 0.15 END::DOUBLE AS strength,
      CASE WHEN (p, q) IN (('tablet', 'injection'), ('cream', 'tablet'), ('tablet', 'cream'), ('syrup', 'tablet')) THEN 0.2 ELSE 0 END::DOUBLE AS form,
      CASE WHEN doc_id % 3 = 0 THEN 1.0 ELSE 0 END::DOUBLE AS exclude, round(CASE WHEN doc_id % 2 = 0 THEN 0.15 / 2 + 0.05 ELSE 0 END::DOUBLE, 6) AS include,
      CASE WHEN doc_id % 5 > 0 AND n_chars % 2 = 0 THEN 0.25 ELSE 0 END::DOUBLE AS child FROM m"""
)
def ontology_checks(spark, sf_dir):
    text = F.concat(F.when(F.pmod(doc_id(), F.lit(2)) == 0, "Gần SÔNG ").otherwise("xa "), F.when(F.pmod(doc_id(), F.lit(3)) == 0, "núi").otherwise("biển"))
    a, b = F.pmod(n_chars(), F.lit(1000)).cast("double"), F.pmod(doc_id(), F.lit(400)).cast("double")
    terms = lambda *x: F.array(*map(F.lit, x))
    return documents(spark, sf_dir).select(
        "doc_id",
        rerank.strength_penalty(a, pick(["MG", "G", "mcg", ""]), b, pick(["MG", "ug"], n_chars())).alias("strength"),
        rerank.form_penalty(pick(["tablet", "Syrup ", "cream", "patch"]), pick(["Tablet", "injection", "cream"], n_chars())).alias("form"),
        rerank.exclude_penalty(text, terms("Núi", " ")).alias("exclude"),
        F.round(rerank.include_boost(text, terms("sông", "hồ")), 6).alias("include"),
        rerank.child_penalty(F.lit("A10.1"), pick(["A10.1", "A10", "A10", "A10", "A10"]), F.pmod(n_chars(), F.lit(2)) == 1, F.lit("short")).alias("child"),
    )


GOLD_CODES = ["1191", "6809", "7646", "8628", "nowhere"]
GOT_CODES = [["1191", "1192"], ["860975", "6809"], [], ["161"], ["6809"], ["7646", "8628", "1191"], ["206977"]]


@query(
    f"""WITH {MENTION_SQL}, j AS (SELECT m.*, (['1191', '6809', '7646', '8628', 'nowhere'])[id % 5 + 1] AS gold,
        ([{", ".join("[" + ", ".join(f"'{c}'" for c in own) + "]" if own else "CAST([] AS VARCHAR[])" for own in GOT_CODES)}])[n_chars % {len(GOT_CODES)} + 1] AS codes FROM m),
    k AS (SELECT j.*, coalesce(list_position(codes, gold), 0) AS rank, e.ing AS g_ing, e.v, e.form AS g_form, e.rxcui IS NOT NULL AS known FROM j LEFT JOIN {KB_DRUGS.replace(" AS v(", " AS e(")} ON e.rxcui = gold)
    SELECT count(*) AS n, round(avg((rank > 0)::INT), 6) AS coverage, round(avg((rank = 1)::INT), 6) AS top1, round(avg(CASE WHEN rank > 0 THEN 1.0 / rank ELSE 0 END), 6) AS mrr,
      {", ".join(f"round(avg((rank > 0 AND rank <= {c})::INT), 6) AS recall_{c}" for c in (1, 3, 5, 10))},
      round(avg(coalesce(lower(ing) = g_ing, false)::INT), 6) AS ingredient_accuracy, round(avg(coalesce(abs(value - v) < 0.01, false)::INT), 6) AS strength_accuracy,
      round(avg(coalesce(form_ = g_form, false)::INT), 6) AS form_accuracy,
      count(*) FILTER (rank = 0 AND NOT known) AS gold_not_in_kb, count(*) FILTER (rank = 0 AND known AND lower(ing) <> g_ing) AS ingredient_mismatch,
      count(*) FILTER (rank = 0 AND known AND lower(ing) = g_ing AND abs(value - v) >= 0.01) AS strength_mismatch,
      count(*) FILTER (rank = 0 AND known AND lower(ing) = g_ing AND abs(value - v) < 0.01 AND len(codes) > 0) AS lexical_mismatch FROM k"""
)
def drug_evaluation_mentions(spark, sf_dir):
    codes = F.get(F.array(*(F.array(*map(F.lit, own)).cast("array<string>") for own in GOT_CODES)), F.pmod(n_chars(), F.lit(len(GOT_CODES))).cast("int"))
    rows = documents(spark, sf_dir).select(doc_id().alias("id"), drug_mention().alias("mention"), pick(GOLD_CODES).alias("gold"), codes.alias("codes"))
    judged = metrics.judged_drugs(rows, kb.drugs(spark))
    kinds = ("gold_not_in_kb", "ingredient_mismatch", "strength_mismatch", "lexical_mismatch")
    errors = judged.agg(*(F.count_if(F.coalesce(F.col("error") == k, F.lit(False))).alias(k) for k in kinds))
    return metrics.drug_evaluation(judged).join(errors, F.lit(True))  # one row each


CODED_GOLD, CODED_SAID = ["I10", "J18.9", "E11.9", "Z99", "J45.9"], ["cao huyết áp", "viêm phổi", "ABC", "hen", "something"]
CODED_GOT = [["I10"], ["J18.0", "I10"], [], ["E11.9", "I64"], ["K21.9", "J45.9"], ["Z9"]]
ICD_NAMES = values([(e["code"], e.get("name_vi") or "", e.get("name_en") or "", [a.lower().strip() for a in e.get("aliases") or []] or [""], [a.lower().strip() for a in e.get("synonyms") or []] or [""]) for e in K.ICD], "code, vi, en, aliases, synonyms")


@query(
    f"""WITH m AS (SELECT doc_id AS id, {pick_sql(CODED_GOLD)} AS gold, {pick_sql(CODED_SAID, "n_chars")} AS mention,
        ([{", ".join("[" + ", ".join(f"'{c}'" for c in own) + "]" if own else "CAST([] AS VARCHAR[])" for own in CODED_GOT)}])[doc_id % {len(CODED_GOT)} + 1] AS codes FROM documents),
    e AS (SELECT * FROM {ICD_NAMES})
    SELECT id, coalesce(list_position(codes, gold), 0)::INTEGER AS rank, CASE WHEN list_contains(codes, gold) THEN NULL WHEN list_contains(aliases, lower(mention)) THEN 'exact_alias_missing'
      WHEN list_contains(synonyms, lower(mention)) THEN 'synonym_missing' WHEN vi <> '' AND en <> '' THEN 'translation_issue' WHEN mention = 'ABC' THEN 'abbreviation_issue'
      WHEN len(list_filter(codes, lambda c: starts_with(c, substr(gold, 1, 3)) OR starts_with(gold, substr(c, 1, 3)))) > 0 THEN 'wrong_granularity' ELSE 'dense_mismatch' END AS error
    FROM m LEFT JOIN e ON e.code = m.gold"""
)
def icd_errors_mentions(spark, sf_dir):
    codes = F.get(F.array(*(F.array(*map(F.lit, own)).cast("array<string>") for own in CODED_GOT)), F.pmod(doc_id(), F.lit(len(CODED_GOT))).cast("int"))
    rows = documents(spark, sf_dir).select(doc_id().alias("id"), pick(CODED_SAID, n_chars()).alias("mention"), pick(CODED_GOLD).alias("gold"), codes.alias("codes"))
    return metrics.judged_codes(rows, kb.icd(spark)).select("id", "rank", "error")


CHAPTERS = values([(k, e["code"], e.get("chapter") or "unknown", [a.lower().strip() for a in [*(e.get("aliases") or []), *(e.get("synonyms") or [])]] or [""]) for k, e in enumerate(K.ICD)], "seq, code, chapter, terms")
GOLD_ICD = ["I10", "J18.9", "K21.9", "E11.9", "nowhere"]


@query(
    f"""WITH e AS (SELECT * FROM {CHAPTERS}), m AS (SELECT doc_id AS id, {pick_sql(GOLD_ICD)} AS gold, lower({pick_sql(MENTIONS)}) AS mention FROM documents),
    a AS (SELECT id, gold, mention, e.* FROM m JOIN e ON e.code = gold)
    SELECT id, negative_type, count(*) AS n FROM (
      SELECT id, 'positive' AS negative_type, 0 AS place FROM a
      UNION ALL SELECT a.id, 'hard_same_chapter', row_number() OVER (PARTITION BY a.id) AS place FROM a JOIN e o ON o.code <> gold AND o.chapter = a.chapter QUALIFY place <= 4
      UNION ALL SELECT a.id, 'hard_same_alias', row_number() OVER (PARTITION BY a.id) AS place FROM a JOIN e o ON o.code <> gold AND len(list_filter(list_intersect(a.terms, o.terms), lambda t: t <> '' AND contains(mention, t))) > 0 QUALIFY place <= 4
      UNION ALL SELECT a.id, 'random', row_number() OVER (PARTITION BY a.id) AS place FROM a JOIN e o ON o.code <> gold AND o.chapter <> a.chapter QUALIFY place <= 2) GROUP BY id, negative_type"""
)
def cross_encoder_icd_counts(spark, sf_dir):
    samples = documents(spark, sf_dir).select(doc_id().alias("id"), pick(MENTIONS).alias("mention"), pick(GOLD_ICD).alias("positive"))
    made = dataset.cross_encoder_icd(samples, kb.icd(spark))
    return made.groupBy("id", "negative_type").agg(F.count("*").alias("n"))


DRUG_TEXT = "'RxCUI: ' || rxcui || ' | ' || short || ' | ingredient: ' || ing || ' | strength: ' || v || ' ' || u || ' | dose form: tablet | brand: ' || brand"
CASED = values([(k, r[0], r[2], r[3], d[5], d[6], r[5][0]) for k, (r, d) in enumerate(zip(K.DRUGS, _drug_rows(), strict=True))], "seq, rxcui, short, ing, v, u, brand")


@query(
    f"""WITH e AS (SELECT * FROM {CASED}), m AS (SELECT doc_id AS id, {pick_sql(GOLD_CODES)} AS gold FROM documents), a AS (SELECT id, gold, ing AS g FROM m JOIN e ON rxcui = gold)
    SELECT id, rxcui AS candidate, {DRUG_TEXT} AS text, 1.0::DOUBLE AS label FROM a JOIN e ON rxcui = gold
    UNION ALL SELECT id, rxcui, {DRUG_TEXT}, 0 FROM a JOIN e ON rxcui <> gold AND ing = g QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq) <= 4"""
)
def cross_encoder_drug_pairs(spark, sf_dir):
    samples = documents(spark, sf_dir).select(doc_id().alias("id"), pick(GOLD_CODES).alias("positive"))
    made = dataset.cross_encoder_drugs(samples, kb.drugs(spark))
    return made.where("negative_type <> 'random'").select("id", "candidate", "text", "label")


@query(f"SELECT doc_id, list_filter(['I10', 'A00', 'J18.9', {pick_sql(GOLD_ICD)}], lambda c: c IN ({', '.join(repr(e['code']) for e in K.ICD)})) AS codes FROM documents".replace("list_filter(", "array_to_string(list_sort(list_distinct(list_filter(", 1).replace(") AS codes", "))), ',') AS codes"))
def known_codes_documents(spark, sf_dir):
    codes = F.array(F.lit("I10"), F.lit("A00"), F.lit("J18.9"), pick(GOLD_ICD))
    own = retrieve.known_codes(codes, [e["code"] for e in K.ICD])
    return documents(spark, sf_dir).select("doc_id", F.array_join(F.array_sort(F.array_distinct(own)), ",").alias("codes"))


# --- samples -----------------------------------------------------------------------------

#: Number spans as entities, some of them broken by their place.
BROKEN = f"""{span_sql(NUMBER)}, e AS (SELECT s.doc_id, i - 1 AS number, d.text, CASE WHEN start % 7 = 1 THEN -1 ELSE start END AS a, CASE WHEN start % 7 = 2 THEN length(d.text) + 5 WHEN start % 7 = 3 THEN start ELSE end_ END AS b,
  CASE WHEN start % 7 = 4 THEN 'other' ELSE match END AS t, CASE WHEN start % 7 = 5 THEN 'X' WHEN start % 2 = 0 THEN 'THUỐC' ELSE 'TÊN_XÉT_NGHIỆM' END AS type, start % 7 = 6 AS flagged FROM s JOIN documents d USING (doc_id))"""


def _samples(spark, sf_dir):
    n = F.char_length("text")

    def entity(x: Column) -> Column:
        k = F.pmod(x["start"], F.lit(7))
        return F.struct(
            F.when(k == 4, "other").otherwise(x["text"]).alias("text"),
            F.when(k == 1, -1).otherwise(x["start"]).alias("start"),
            F.when(k == 2, n + 5).when(k == 3, x["start"]).otherwise(x["end"]).alias("end"),
            F.when(k == 5, "X").when(F.pmod(x["start"], F.lit(2)) == 0, "THUỐC").otherwise("TÊN_XÉT_NGHIỆM").alias("type"),
            F.when(k == 6, F.array(F.lit("isFamily"), F.lit("no"))).otherwise(F.array().cast("array<string>")).alias("assertions"),
            F.when(k == 0, F.array(F.lit("12"), F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("candidates"),
        )

    rows = documents(spark, sf_dir).where("text is not null")
    return rows.select(doc_id().cast("string").alias("id"), "text", F.transform(S.find_spans(F.col("text"), NUMBER), entity).cast(f"array<{validate.ENTITY}>").alias("entities"))


FINDINGS = "SELECT doc_id::VARCHAR AS id, number::INTEGER AS number, '{severity}' AS severity, '{field}' AS field FROM e WHERE {test}"
SAMPLE_TESTS = [
    ("error", "start", "a < 0"), ("error", "end", "b > length(text)"), ("error", "span", "a >= b"), ("error", "text", "a >= 0 AND a < b AND b <= length(text) AND substr(text, a + 1, b - a) <> t"),
    ("error", "type", "type = 'X'"), ("error", "assertions", "flagged"), ("error", "width", "a = b"), ("warning", "candidates", "type = 'THUỐC' AND a % 7 = 0"),
]


@query(
    f"WITH {BROKEN} SELECT severity, field, count(*) AS n FROM (" + " UNION ALL ".join(FINDINGS.format(severity=s, field=f, test=t) for s, f, t in SAMPLE_TESTS)
    + " UNION ALL SELECT doc_id::VARCHAR, NULL, 'error', 'text' FROM documents WHERE text = '' UNION ALL SELECT doc_id::VARCHAR, NULL, 'warning', 'entities' FROM documents WHERE text IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM s)) GROUP BY severity, field"
)
def validate_samples_documents(spark, sf_dir):
    return validate.validate_samples(_samples(spark, sf_dir)).groupBy("severity", "field").agg(F.count("*").alias("n"))


OUTPUT_TESTS = [
    ("error", "position", "a < 0 OR b <= a OR b > length(text)"), ("error", "text", "NOT (a < 0 OR b <= a OR b > length(text)) AND substr(text, a + 1, b - a) <> t"), ("error", "type", "type = 'X'"),
    ("error", "assertions", "flagged AND type = 'TÊN_XÉT_NGHIỆM'"), ("error", "candidates", "type = 'TÊN_XÉT_NGHIỆM' AND a % 7 = 0 AND a > 0"), ("error", "assertion_values", "flagged"),
    ("warning", "codes", "type = 'THUỐC' AND a % 7 = 0"),
    ("warning", "duplicate_position", "EXISTS (SELECT 1 FROM e o WHERE o.doc_id = e.doc_id AND o.number < e.number AND o.a = e.a AND o.b = e.b)"),
    ("warning", "overlap", "EXISTS (SELECT 1 FROM e o WHERE o.doc_id = e.doc_id AND o.number < e.number AND o.a < e.b AND e.a < o.b)"),
]


@query(f"WITH {BROKEN} SELECT severity, field, count(*) AS n FROM (" + " UNION ALL ".join(FINDINGS.format(severity=s, field=f, test=t) for s, f, t in OUTPUT_TESTS) + ") GROUP BY severity, field")
def validate_outputs_documents(spark, sf_dir):
    found = validate.validate_outputs(_samples(spark, sf_dir).withColumnRenamed("id", "doc_id"), ["I10"], ["12"])
    return found.groupBy("severity", "field").agg(F.count("*").alias("n"))


@query(
    f"""WITH d AS (SELECT doc_id::VARCHAR AS id, CASE WHEN doc_id % 4 = 0 THEN '' ELSE {pick_sql(MENTIONS)} END AS mention, {pick_sql(GOLD_ICD)} AS gold, {pick_sql(GOLD_ICD, "n_chars")} AS neg FROM documents)
    SELECT id, 'error' AS severity, 'mention' AS field FROM d WHERE mention = '' UNION ALL SELECT id, 'warning', 'positive' FROM d WHERE gold = 'nowhere'
    UNION ALL SELECT id, 'warning', 'mention' FROM d WHERE mention NOT IN ('', 'viêm phổi') UNION ALL SELECT id, 'error', 'negatives' FROM d WHERE gold = neg"""
)
def linking_findings_documents(spark, sf_dir):
    mention = F.when(F.pmod(doc_id(), F.lit(4)) == 0, "").otherwise(pick(MENTIONS))
    rows = documents(spark, sf_dir).select(doc_id().cast("string").alias("id"), F.lit("BN bị Viêm phổi nặng").alias("query_text"), mention.alias("mention"), pick(GOLD_ICD).alias("positive"), F.array(pick(GOLD_ICD, n_chars())).alias("negatives"))
    return validate.linking_findings(rows, validate.ICD_CODE)


@query(
    f"""WITH {span_sql(NUMBER)}, h AS (SELECT d.doc_id, substr(sha256(coalesce((SELECT string_agg(match || '|n', ';' ORDER BY start) FROM s WHERE s.doc_id = d.doc_id), '')), 1, 16) AS h FROM documents d)
    SELECT min(doc_id) AS doc_id, count(*) AS copies FROM h GROUP BY h"""
)
def dedup_entity_sets(spark, sf_dir):
    entities = F.transform(S.find_spans(F.col("text"), NUMBER), lambda x: F.struct(x["start"], x["end"], x["text"], F.lit("n").alias("type")))
    return dataset.keep_first(documents(spark, sf_dir).select("doc_id", entities.alias("e")), dataset.entity_hash(F.col("e")), "doc_id").select("doc_id", "copies")


@query(
    """WITH g AS (SELECT lang, count(DISTINCT text) AS n FROM documents GROUP BY lang)
    SELECT lang AS stratum, split, n FROM (SELECT lang, 'train' AS split, CAST(floor(n * 0.8) AS BIGINT) AS n FROM g UNION ALL SELECT lang, 'dev', CAST(floor(n * 0.1) AS BIGINT) FROM g
      UNION ALL SELECT lang, 'internal_test', CAST(n - floor(n * 0.8) - floor(n * 0.1) AS BIGINT) FROM g) WHERE n > 0"""
)
def split_groups_by_type_counts(spark, sf_dir):
    rows = documents(spark, sf_dir).select(doc_id().alias("id"), F.col("lang").alias("stratum"), F.col("text").alias("value"))
    made = dataset.split_groups_by_type(rows)
    return made.groupBy("stratum", "split").agg(F.count_distinct("group").alias("n"))


@query("SELECT doc_id FROM documents d WHERE source <> 'src0' AND NOT EXISTS (SELECT 1 FROM documents t WHERE t.source = 'src0' AND t.text = d.text)")
def leakage_anti(spark, sf_dir):
    docs = documents(spark, sf_dir)
    other = docs.where("source <> 'src0'")
    return other.join(validate.leaked(docs.where("source = 'src0'"), other).select("doc_id"), "doc_id", "left_anti").select("doc_id")


@query("SELECT doc_id, md5(translate(strip_accents(text), 'đĐ', 'dD')) AS same, length(text) AS n FROM documents WHERE text IS NOT NULL")
def diacritic_errors(spark, sf_dir):
    """Letters change among variants of one letter, so without marks the text is as before."""
    made = dataset.diacritic_error(F.concat(F.col("text"), F.lit("")), 0.5, 7, "doc_id")
    rows = documents(spark, sf_dir).where("text is not null")
    return rows.select("doc_id", F.md5(dataset.plain_letters(made).cast("binary")).alias("same"), F.char_length(made).cast("long").alias("n"))


@query("SELECT doc_id, true AS known FROM documents")
def paraphrases(spark, sf_dir):
    made = dataset.paraphrase(F.concat(F.lit("bệnh nhân sốt "), doc_id().cast("string")), 7, "doc_id")
    heads = [f"{a} {b} " for a in V.PARAPHRASES["bệnh nhân"] for b in V.PARAPHRASES["sốt"]]
    return documents(spark, sf_dir).select("doc_id", F.exists(F.array(*map(F.lit, heads)), lambda h: made == F.concat(h, doc_id().cast("string"))).alias("known"))


# --- tokens ------------------------------------------------------------------------------

TOKEN = r"[^ \t\n]*[0-9][^ \t\n]*"


@query(
    f"""WITH {span_sql(TOKEN)}, l AS (SELECT doc_id, i, start, end_, lead(end_) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM s)
    SELECT doc_id, start, coalesce(nxt, end_) AS "end", 'TRIỆU_CHỨNG' AS type FROM l WHERE (i - 1) % 4 = 0"""
)
def bio_decode_documents(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", F.transform(S.find_spans(F.col("text"), TOKEN), lambda x: F.struct(x["start"], x["end"])).alias("o"))
    labels = F.transform("o", lambda _, i: F.get(F.array(*map(F.lit, (1, 6, 0, 9))), F.pmod(i, F.lit(4))))
    rows = rows.withColumn("p", labels).where(F.size("o") > 0)
    return rows.select("doc_id", F.explode(tokens.decode(F.col("p"), F.col("o"))).alias("e")).select("doc_id", "e.start", "e.end", "e.type")


@query(
    f"""WITH {span_sql(TOKEN)}, {span_sql(NUMBER, name="n")}, a AS (SELECT s.doc_id, s.i, s.start, s.end_, min(n.start) AS e FROM s LEFT JOIN n ON n.doc_id = s.doc_id AND s.start < n.end_ AND s.end_ > n.start GROUP BY ALL)
    SELECT doc_id, string_agg(CASE WHEN e IS NULL THEN '0' WHEN start <= e THEN '5' ELSE '10' END, ',' ORDER BY i) AS labels FROM a GROUP BY doc_id"""
)
def bio_align_documents(spark, sf_dir):
    drug = lambda x: F.struct(x["start"], x["end"], F.lit("THUỐC").alias("type"))
    rows = documents(spark, sf_dir).select("doc_id", F.transform(S.find_spans(F.col("text"), TOKEN), lambda x: F.struct(x["start"], x["end"])).alias("o"), F.transform(S.find_spans(F.col("text"), NUMBER), drug).alias("e"))
    labels = tokens.align(F.col("o"), F.col("e")).cast("array<string>")
    return rows.where(F.size("o") > 0).select("doc_id", F.array_join(labels, ",").alias("labels"))


@query("SELECT doc_id, round(exp((n_chars % 5) - m) / (exp((n_chars % 5) - m) + exp((n_chars % 7) - m) + exp(1 - m)), 9) AS p FROM (SELECT doc_id, n_chars, greatest(n_chars % 5, n_chars % 7, 1) AS m FROM documents)")
def softmax_documents(spark, sf_dir):
    logits = F.array(F.pmod(n_chars(), F.lit(5)).cast("double"), F.pmod(n_chars(), F.lit(7)).cast("double"), F.lit(1.0))
    return documents(spark, sf_dir).select("doc_id", F.round(tokens.softmax_at(logits, F.lit(0)), 9).alias("p"))


# --- files -------------------------------------------------------------------------------


@query("SELECT doc_id::VARCHAR AS id, md5(text) AS text, lang, 'template' AS source, 'auto_validated' AS review_status FROM documents WHERE text IS NOT NULL")
def samples_round_trip(spark, sf_dir):
    path = scratch(spark, "samples")
    io.write_json_lines(documents(spark, sf_dir).where("text is not null").select(doc_id().cast("string").alias("id"), "text", "lang"), path)
    read = io.read_samples(spark, path)
    return read.select("id", F.md5(F.col("text").cast("binary")).alias("text"), F.element_at("metadata", F.lit("lang")).alias("lang"), "source", "review_status")


@query("SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY lang")
def csv_round_trip(spark, sf_dir):
    path = scratch(spark, "csv")
    io.write_csv(documents(spark, sf_dir).select("doc_id", "n_chars", "lang", F.array("lang", "source").alias("both")), path)
    read = spark.read.option("header", True).csv(path)
    return read.groupBy(F.split("both", r"\|")[0].alias("lang")).agg(F.count("*").alias("n"), F.sum(F.col("n_chars").cast("long")).alias("chars"))


@query(f"SELECT code, parent_code FROM {values([(e['code'], e.get('parent_code')) for e in K.ICD], 'code, parent_code')}")
def kb_round_trip(spark, sf_dir):
    path = scratch(spark, "kb")
    kb.save(kb.icd(spark), path)
    return kb.icd(spark, path).select("code", "parent_code")


#: Notes, and their entities with type, assertion and best code.
LINKED = [
    ("Bệnh nhân không viêm phổi. Bố có tiền sử hen suyễn", [("viêm phổi", "CHẨN_ĐOÁN", "isNegated", "J18.9"), ("hen suyễn", "CHẨN_ĐOÁN", "isFamily", "J45.9")]),
    ("Tiền sử bệnh\n- tăng huyết áp", [("tăng huyết áp", "CHẨN_ĐOÁN", "isHistorical", "I10")]),
    ("Chẩn đoán viêm phổi cộng đồng. Không hen suyễn", [("viêm phổi cộng đồng", "CHẨN_ĐOÁN", "", "J18.9"), ("hen suyễn", "CHẨN_ĐOÁN", "isNegated", "J45.9")]),
    ("Dùng Aspirin 81mg po daily", [("Aspirin 81mg", "THUỐC", "", "1191")]),
]
LINKED_SQL = values([(k, t.index(e[0]), t.index(e[0]) + len(e[0]), *e) for k, (t, own) in enumerate(LINKED) for e in own], 'k, start, "end", text, type, assertions, code')


@query(f'SELECT doc_id, v.start, v."end", v.text, v.type, v.assertions, v.code FROM documents JOIN {LINKED_SQL} ON v.k = doc_id % {len(LINKED)}')
def clinical_notes(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", pick([t for t, _ in LINKED]).alias("text"))
    found = pipeline.linked(pipeline.entities(docs))
    code = F.coalesce(F.get("candidates", F.lit(0)), F.lit("")).alias("code")
    return found.select("doc_id", "start", "end", "text", "type", F.array_join("assertions", ",").alias("assertions"), code)


@query(
    f"""WITH d AS (SELECT v.* FROM documents JOIN {LINKED_SQL} ON v.k = doc_id % {len(LINKED)})
    SELECT 'type' AS kind, type AS name, count(*) AS n FROM d GROUP BY type UNION ALL SELECT 'assertion', assertions, count(*) FROM d WHERE assertions <> '' GROUP BY assertions
    UNION ALL SELECT 'documents', 'with_entities', count(*) FROM documents"""
)
def run_statistics_notes(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", pick([t for t, _ in LINKED]).alias("text"))
    return io.run_statistics(pipeline.process(docs, pipeline.Config(link_icd=False, link_drugs=False)))


ABLATED = {"all": pipeline.Config(assertions=False), "no_labs": pipeline.Config(assertions=False, labs=False), "no_drugs": pipeline.Config(assertions=False, drugs=False)}


@query(
    f"""WITH {LAB_SQL}, g AS (SELECT count(*) AS n FROM l) SELECT config, (n * k)::BIGINT AS tp, 0::BIGINT AS fp, (n * (3 - k))::BIGINT AS fn, CASE WHEN k > 0 THEN 1.0 ELSE 0 END::DOUBLE AS precision, round(k / 3, 4) AS recall, round(2 * k / (k + 3), 4) AS f1
    FROM g, (VALUES ('all', 3), ('no_labs', 1), ('no_drugs', 2)) AS v(config, k)"""
)
def ablation_notes(spark, sf_dir):
    text = F.concat(F.lit("Glucose "), n_chars().cast("string"), F.lit(" mmol/L; metformin"))
    docs = documents(spark, sf_dir).select("doc_id", text.alias("text"))
    end = 15 + F.char_length(n_chars().cast("string"))
    spans = F.array(
        F.struct(F.lit("Glucose").alias("text"), F.lit(0).alias("start"), F.lit(7).alias("end"), F.lit("TÊN_XÉT_NGHIỆM").alias("type")),
        F.struct(F.concat(n_chars().cast("string"), F.lit(" mmol/L")).alias("text"), F.lit(8).alias("start"), end.alias("end"), F.lit("KẾT_QUẢ_XÉT_NGHIỆM").alias("type")),
        F.struct(F.lit("metformin").alias("text"), (end + 2).alias("start"), (end + 11).alias("end"), F.lit("THUỐC").alias("type")),
    )
    gold = documents(spark, sf_dir).select("doc_id", F.explode(spans).alias("g")).select("doc_id", "g.*")
    return pipeline.ablation(docs, gold, ABLATED)


@query(f"WITH {span_sql(NUMBER)} SELECT doc_id, i - 1 AS seq, start, end_ AS \"end\", match AS text, 'number' AS type, greatest(0.5, 0.6)::DOUBLE AS confidence, 'user' AS source FROM s")
def user_extractors(spark, sf_dir):
    import re

    number = re.compile(NUMBER)

    def find(text: str) -> list[dict]:
        return [{"start": m.start(), "end": m.end(), "type": "number"} for m in number.finditer(text)]

    def fails(text: str) -> list[dict]:
        raise ValueError(text)

    return pipeline.with_extractors(documents(spark, sf_dir), {"user": find, "broken": fails}, {"user": 0.6})
