"""The clinical pipeline: documents to entities with assertions and codes.

One pass of two rule sets over the texts gives raw matches; extraction, overlap
resolution and assertions are column expressions on them, so a document never leaves its
partition.  Only distinct mentions travel, to meet the knowledge bases, and come back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field, fields

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..functions.lineage import cut, spread
from ..functions.spans import flat, piece, resolve_spans, span
from ..operators import assertion as A
from ..operators import extract as X
from ..operators import metrics, rerank, resolve, retrieve, validate
from ..sources import kb

ENTITY = "struct<start:int,end:int,text:string,type:string,assertions:array<string>,candidates:array<string>>"


@dataclass(frozen=True)
class Config:
    """Options of a run.  min_confidence: by kind; allowed_assertions: None keeps all, an
    empty tuple none.  priority: of types when spans overlap; empty as the live rule has it."""

    labs: bool = True
    drugs: bool = True
    diseases: bool = True
    min_lab: float = 0.7
    min_drug: float = 0.6
    min_disease: float = 0.6
    min_symptom: float = 0.6
    resolve: bool = True
    strategy: str = "hybrid"
    priority: dict[str, int] = field(default_factory=dict)
    assertions: bool = True
    min_assertion: float = 0.5
    allowed_assertions: tuple[str, ...] | None = ("isNegated", "isFamily", "isHistorical")
    link_icd: bool = True
    link_drugs: bool = True
    top_k: int = 10
    max_candidates: int = 5
    merge: str = "rrf"
    rrf_k: int = 60
    icd_path: str | None = None
    drug_path: str | None = None
    rerank: bool = False

    @classmethod
    def from_dict(cls, options: dict) -> Config:
        """Known options that are not None; others are ignored."""
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in options.items() if k in known and v is not None})

    @classmethod
    def from_yaml(cls, path: str) -> Config:
        """Options in a YAML file; a section named pipeline is taken if there is one."""
        import yaml

        with open(path, encoding="utf-8") as f:
            read = yaml.safe_load(f) or {}
        return cls.from_dict(read.get("pipeline", read))

    @property
    def n_candidates(self) -> int:
        return min(self.max_candidates, self.top_k)


def extract_spans(docs: DataFrame, config: Config) -> DataFrame:
    """Add spans (labs, results, drugs, diseases, in this order) above their thresholds."""
    text, m = F.coalesce("text", F.lit("")), F.col("_matches")
    rows = docs.withColumn("_matches", X.RULES.scan(F.col("text"))).withColumn("_tests", X.lab_tests(m))
    parts: list[Column] = []
    if config.labs and config.min_lab <= 1.0:  # lab matches have no confidence of their own
        rows = rows.withColumn("_results", X.lab_results(text, m, F.col("_tests")))
        parts += [
            F.transform("_tests", lambda x: span(x["start"], x["end"], x["text"], "TÊN_XÉT_NGHIỆM", 1.0, "lab_rule")),
            F.transform("_results", lambda x: span(x["start"], x["end"], x["text"], "KẾT_QUẢ_XÉT_NGHIỆM", 1.0, "lab_rule")),
        ]
    if config.drugs:
        found = F.filter(X.drugs(text, m), lambda x: x["confidence"] >= config.min_drug)
        parts.append(F.transform(found, lambda x: span(x["start"], x["end"], x["text"], "THUỐC", x["confidence"], "drug_rule")))
    if config.diseases:
        least = lambda x: F.when(x["is_diagnosed"], config.min_disease).otherwise(config.min_symptom)
        found = F.filter(X.diseases(text, m), lambda x: x["confidence"] >= least(x))
        parts.append(F.transform(found, lambda x: span(x["start"], x["end"], x["text"], x["context"], x["confidence"], "disease_rule")))
    none = F.array().cast("array<struct<start:int,end:int,text:string,type:string,confidence:double,source:string>>")
    return rows.withColumn("spans", flat([none, *parts])).drop("_matches", "_tests", "_results")


def resolved(rows: DataFrame, config: Config) -> DataFrame:
    """Spans without overlaps, in order, one for each place, with the text of the document."""
    spans = resolve_spans(F.col("spans"), config.strategy, config.priority) if config.resolve else F.col("spans")
    rows = rows.withColumn("_kept", spans)
    text, n = F.coalesce("text", F.lit("")), F.char_length(F.coalesce("text", F.lit("")))
    inside = F.filter("_kept", lambda x: (x["start"] >= 0) & (x["end"] <= n) & (x["start"] < x["end"]))
    ordered = F.array_sort(F.transform(inside, lambda x, i: F.struct(x["start"], x["end"], i.alias("i"), x["type"], x["confidence"])))
    same = lambda x, o: (o["start"] == x["start"]) & (o["end"] == x["end"])
    first = lambda x, i: (i == 0) | ~same(x, F.get(F.col("_in"), i - 1))
    rows = rows.withColumn("_in", ordered).withColumn("_once", F.filter("_in", first))
    own = F.transform("_once", lambda x: F.struct(x["start"], x["end"], piece(text, x["start"], x["end"]).alias("text"), x["type"], x["confidence"]))
    return rows.withColumn("found", own).drop("_kept", "_in", "_once", "spans")


def with_assertions(rows: DataFrame, config: Config) -> DataFrame:
    """Add assertions to each entity of `found` that may have them."""
    if not config.assertions:
        return rows.withColumn("found", F.transform("found", lambda x: x.withField("assertions", F.array().cast("array<string>"))))
    each = A.judged(rows)
    flags = [F.when(F.col(c), name) for c, name in (("is_negated", "isNegated"), ("is_historical", "isHistorical"), ("is_family", "isFamily"))]
    held = F.filter(F.array(*flags), lambda f: f.isNotNull())
    if config.allowed_assertions is not None:
        allowed = F.array(*map(F.lit, config.allowed_assertions)) if config.allowed_assertions else F.array().cast("array<string>")
        held = F.array_intersect(held, allowed)
    may = F.col("type").isin(validate.WITH_ASSERTIONS) & (F.col("sure") >= config.min_assertion)
    none = F.array().cast("array<string>")
    return each.select("doc_id", "n", "start", "end", "text", "type", "confidence", F.when(may, held).otherwise(none).alias("assertions"))


def link_icd(mentions: DataFrame, entries: DataFrame, config: Config) -> DataFrame:
    """id and codes of diagnoses, through exact, fuzzy and BM25 candidates."""
    texts = kb.icd_texts(entries).withColumn("norm", N.for_fuzzy(F.col("text")))
    exact = retrieve.exact_icd(mentions, entries).select("id", "code", F.lit("exact").alias("source"), "rank", F.lit(1.0).alias("score"))
    near = retrieve.fuzzy(mentions, texts, "code").select("id", "code", F.lit("fuzzy").alias("source"), "rank", "score")
    words = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    corpus = kb.icd_texts(entries).withColumn("norm", N.normalize(F.col("text")))
    corpus = corpus.groupBy("code").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "norm"))), lambda x: x["norm"]), " ").alias("t"))
    corpus = corpus.select(F.col("code").alias("doc_id"), words(F.col("t")).alias("tokens"))
    queries = mentions.select("id", words(N.normalize(F.col("mention"))).alias("tokens"))
    # Entries that share no word with a mention count with score 0, in their order; a knowledge base has few.
    every = queries.where(F.size("tokens") > 0).select("id").join(F.broadcast(entries.select("code", "seq")), F.lit(True))
    hits = retrieve.bm25(queries, corpus, 1_000_000).select("id", F.col("doc_id").alias("code"), "score")
    scored = every.join(hits, ["id", "code"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    bm25 = retrieve.top_k(scored, 30, "id", "score", "seq").select("id", "code", F.lit("bm25").alias("source"), "rank", "score")
    found = exact.unionByName(near).unionByName(bm25)
    fuse = retrieve.fuse_ranks if config.merge == "rrf" else retrieve.fuse_weighted
    fused = fuse(found, "code", config.top_k, config.rrf_k) if config.merge == "rrf" else fuse(found, "code", config.top_k)
    order = "rank"
    if config.rerank:
        fused = rerank.rerank_icd(fused.join(mentions, "id").join(F.broadcast(entries), "code"), config.top_k)
        order = "rank_after"
    return _codes(fused, "code", order, config)


def link_drugs(mentions: DataFrame, entries: DataFrame, config: Config) -> DataFrame:
    """id and codes of drugs, through structured and fuzzy candidates."""
    texts = kb.drug_texts(entries).withColumn("norm", N.drug_for_matching(F.col("text")))
    k = 2 * config.top_k
    fit = retrieve.structured(mentions, entries, k).select("id", "rxcui", F.lit("structured").alias("source"), "rank", "score")
    near = retrieve.fuzzy(mentions, texts, "rxcui", k, cutoff=40, depth=None).select("id", "rxcui", F.lit("fuzzy").alias("source"), "rank", "score")
    fused, order = retrieve.fuse_drugs(fit.unionByName(near), config.top_k), "rank"
    if config.rerank:
        fused = rerank.rerank_drugs_by_dose(fused.join(mentions, "id").join(F.broadcast(entries), "rxcui"), config.top_k)
        order = "rank_after"
    return _codes(fused, "rxcui", order, config)


def _codes(ranked: DataFrame, code: str, order: str, config: Config) -> DataFrame:
    best = F.slice(F.array_sort(F.collect_list(F.struct(order, code))), 1, config.n_candidates)
    return ranked.groupBy("id").agg(F.transform(best, lambda x: x[code]).alias("codes"))


def entities(docs: DataFrame, config: Config | None = None) -> DataFrame:
    """doc_id, n, start, end, text, type, confidence, assertions of every entity in docs
    (doc_id, text), before linking.  All steps are row-local, so docs may be a stream."""
    config = config or Config()
    rows = resolved(extract_spans(spread(docs.select("doc_id", "text")), config), config)
    found = with_assertions(rows, config)
    if "found" in found.columns:
        found = found.select("doc_id", F.posexplode("found").alias("n", "x")).select("doc_id", "n", "x.*")
    return found.where("start is not null")


def linked(found: DataFrame, config: Config | None = None) -> DataFrame:
    """Add candidates: codes of diagnoses and drugs.  Retrieval sees distinct mentions only."""
    config, spark = config or Config(), found.sparkSession
    found = cut(found)  # it is read for the mentions of each kind, and once more to take their codes
    mentions = found.where(F.col("type").isin(validate.WITH_CANDIDATES)).select("type", "text").distinct()
    mentions = cut(mentions.select(F.xxhash64("type", "text").alias("id"), "type", F.col("text").alias("mention")))
    codes = spark.createDataFrame([], "id long, codes array<string>")
    if config.link_icd:
        codes = codes.unionByName(link_icd(mentions.where("type = 'CHẨN_ĐOÁN'").drop("type"), kb.icd(spark, config.icd_path), config))
    if config.link_drugs:
        codes = codes.unionByName(link_drugs(mentions.where("type = 'THUỐC'").drop("type"), kb.drugs(spark, config.drug_path), config))
    rows = found.withColumn("id", F.xxhash64("type", "text")).join(codes, "id", "left")
    return rows.withColumn("candidates", F.coalesce("codes", F.array().cast("array<string>"))).drop("id", "codes")


def process(docs: DataFrame, config: Config | None = None) -> DataFrame:
    """doc_id and entities of every document, as the sink writes them."""
    rows = linked(entities(docs, config), config)
    item = F.struct("n", "text", F.array("start", "end").alias("position"), "type", "assertions", "candidates")
    grouped = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("e"))
    out = F.transform("e", lambda x: F.struct(x["text"], x["position"], x["type"], x["assertions"], x["candidates"]))
    done = docs.select("doc_id").join(grouped.select("doc_id", out.alias("entities")), "doc_id", "left")
    kind = "array<struct<text:string,position:array<int>,type:string,assertions:array<string>,candidates:array<string>>>"
    return done.select("doc_id", F.coalesce("entities", F.array().cast(kind)).alias("entities"))


def ablation(docs: DataFrame, gold: DataFrame, configs: dict[str, Config]) -> DataFrame:
    """config, tp, fp, fn, precision, recall, f1 of the entities that each configuration
    finds in docs against gold (doc_id, text, start, end, type); one plan for all."""
    key = ["doc_id", *metrics.KEY]
    found = None
    for name, config in configs.items():
        own = entities(docs, config).select(F.lit(name).alias("config"), *key)
        found = own if found is None else found.unionByName(own)
    names = gold.sparkSession.createDataFrame([(n,) for n in configs], "config string")
    return metrics.prf(gold.select(*key).join(F.broadcast(names), F.lit(True)), found, key=["config", *key], by=["config"])


def baseline_entities(docs: DataFrame) -> DataFrame:
    """doc_id, start, end, text, type, confidence of the baseline extractor: lab tests and
    results (.85) and drugs (.90), overlaps kept."""
    text, m = F.coalesce("text", F.lit("")), F.col("_m")
    rows = docs.select("doc_id", "text", X.RULES.scan(F.col("text")).alias("_m")).withColumn("_tests", X.lab_tests(m))
    part = lambda found, kind, sure: F.transform(found, lambda x: span(x["start"], x["end"], x["text"], kind, sure, "regex"))
    spans = flat(
        [
            part(F.col("_tests"), "TÊN_XÉT_NGHIỆM", 0.85),
            part(X.lab_results(text, m, F.col("_tests")), "KẾT_QUẢ_XÉT_NGHIỆM", 0.85),
            part(X.drugs(text, m), "THUỐC", 0.90),
        ]
    )
    return rows.select("doc_id", F.explode(spans).alias("e")).select("doc_id", "e.start", "e.end", "e.text", "e.type", "e.confidence")


def with_extractors(docs: DataFrame, extractors: Mapping[str, Callable[[str], list[dict]]], floors: dict[str, float] | None = None) -> DataFrame:
    """doc_id, seq, start, end, text, type, confidence, source of user-defined extractors.

    An extractor takes a text and returns dicts of start, end, type and, optionally, text
    and confidence (0.5 without one); one that fails on a text finds nothing there.  A null
    text has nothing.  Confidences below a source's floor are raised to it.
    """
    named = dict(extractors)
    schema = "doc_id string, seq long, start int, end int, text string, type string, confidence double, source string"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.string()]
        names = [f.split(" ")[0] for f in schema.split(", ")]
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(*(batch.column(k).to_pylist() for k in (0, 1)), strict=True):
                n = 0
                for source, extract in named.items() if text is not None else ():
                    try:
                        found = extract(text)
                    except Exception:  # the contract: a failing extractor finds nothing
                        found = []
                    for e in found:
                        a, b = int(e["start"]), int(e["end"])
                        rows.append((doc_id, n, a, b, e.get("text", text[a:b]), e["type"], float(e.get("confidence", 0.5)), source))
                        n += 1
            columns = zip(*rows, strict=True) if rows else ((),) * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

    found = docs.select(F.col("doc_id").cast("string"), "text").mapInArrow(task, schema)
    found = found.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
    return resolve.floor_confidence(found, floors) if floors else found
