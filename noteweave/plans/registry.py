"""Registered queries on the reference operators, and DuckDB SQL for those SQL can express.

All of them run on whole tables.  `table_queries` adds those of clinical operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.lineage import spread
from ..functions.spans import find_spans, hull_iou, near_spans, spans_after
from ..operators import assertion, dataset, extract, metrics, resolve, retrieve, tokens, validate
from ..sources import io, kb
from ..sources import knowledge_bases as K
from . import pipeline

NUMBER = r"[0-9]+(?:[.,][0-9]+)?"
ARTICLE = r" (?:the|de|la|der) "


LONG_RANK = "CAST(rank AS BIGINT) AS rank"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def values(rows: list[tuple], names: str) -> str:
    """A SQL table of rows."""

    def one(x: object) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return str(x).lower()
        if isinstance(x, (list, tuple)):
            return "[" + ", ".join(map(one, x)) + "]"
        return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x)

    return f"(VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS v({names})"


def span_sql(pattern: str, source: str = "documents", key: str = "doc_id", name: str = "s") -> str:
    """CTEs that end in `name`: key, i, start, end_, match of a pattern's matches."""
    p = pattern.replace("'", "''")
    return (
        f"{name}_m AS (SELECT {key}, regexp_extract_all(text, '{p}') AS hits, string_split_regex(text, '{p}') AS gaps FROM {source} WHERE text IS NOT NULL), "
        f"{name}_e AS (SELECT {key}, hits, gaps, unnest(range(1, len(hits) + 1)) AS i FROM {name}_m), "
        f"{name} AS (SELECT {key}, i, hits[i] AS match, "
        "CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS INTEGER) AS start, "
        f"start + CAST(length(hits[i]) AS INTEGER) AS end_ FROM {name}_e)"
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


# --- profiles, dedup, splits -------------------------------------------------------------

STATS = (
    "count(*) AS n, min(n_chars) AS low, max(n_chars) AS high, round(avg(n_chars), 4) AS mean, round(median(n_chars), 4) AS median, "
    "round(coalesce(stddev_samp(n_chars), 0), 4) AS deviation"
)


@query(f"SELECT lang, {STATS} FROM documents GROUP BY lang")
def doc_profile(spark, sf_dir):
    return dataset.profile(documents(spark, sf_dir), "lang")


@query("SELECT lang, source, count(*) AS n, round(avg(n_chars), 4) AS mean FROM documents GROUP BY GROUPING SETS ((lang), (lang, source), ())")
def doc_profile_sets(spark, sf_dir):
    sets = [[], [F.col("lang")], [F.col("lang"), F.col("source")]]
    rows = documents(spark, sf_dir).groupingSets(sets, "lang", "source")
    return rows.agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 4).alias("mean")).select("lang", "source", "n", "mean")


@query("SELECT CASE WHEN coalesce(text, '') = '' THEN 'empty' WHEN contains(text, chr(0)) THEN 'nul' ELSE 'fine' END AS error, count(*) AS n FROM documents GROUP BY 1")
def content_validity(spark, sf_dir):
    error = F.coalesce(io.content_error(F.col("text")), F.lit("fine"))
    return documents(spark, sf_dir).groupBy(error.alias("error")).agg(F.count("*").alias("n"))


EXACT = "substr(sha256(text), 1, 16)"
NORMAL = (
    "substr(sha256(trim(regexp_replace(regexp_replace(translate(lower(text), 'ăâđêôơư', 'aadeoou'), '[^\\p{L}\\p{N}_\\s]', '', 'g'), '\\s+', ' ', 'g'))), 1, 16)"
)


@query(f"SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY {EXACT}")
def dedup_exact(spark, sf_dir):
    return dataset.keep_first(documents(spark, sf_dir), dataset.text_hash(F.col("text")), "doc_id").select("doc_id", "copies")


@query(f"SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY {NORMAL}")
def dedup_normalized(spark, sf_dir):
    return dataset.keep_first(documents(spark, sf_dir), dataset.normalized_hash(F.col("text")), "doc_id").select("doc_id", "copies")


@query(f"SELECT 'exact' AS stage, count(DISTINCT {EXACT}) AS n FROM documents UNION ALL SELECT 'normalized', count(DISTINCT {NORMAL}) FROM documents")
def dedup_chain(spark, sf_dir):
    keys = [("exact", dataset.text_hash(F.col("text"))), ("normalized", dataset.normalized_hash(F.col("text")))]
    _, stages = dataset.dedup_chain(documents(spark, sf_dir), keys, "doc_id")
    counts = [rows.agg(F.lit(name).alias("stage"), F.count("*").alias("n")) for name, rows in stages.items()]
    return counts[0].unionByName(counts[1])


@query("SELECT doc_id FROM documents d WHERE source <> 'src0' AND EXISTS (SELECT 1 FROM documents t WHERE t.source = 'src0' AND t.text = d.text)")
def leakage(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return validate.leaked(docs.where("source = 'src0'"), docs.where("source <> 'src0'")).select("doc_id")


SPLIT = "SELECT {s} 'train' AS split, CAST(floor(n * 0.8) AS BIGINT) AS n FROM c UNION ALL SELECT {s} 'dev', CAST(floor(n * 0.1) AS BIGINT) FROM c UNION ALL SELECT {s} 'internal_test', CAST(n - floor(n * 0.8) - floor(n * 0.1) AS BIGINT) FROM c"


@query("WITH c AS (SELECT count(*) AS n FROM documents) " + SPLIT.format(s=""))
def split_random(spark, sf_dir):
    return dataset.split(documents(spark, sf_dir), "doc_id").groupBy("split").agg(F.count("*").alias("n"))


@query("WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang) " + SPLIT.format(s="lang,"))
def split_stratified(spark, sf_dir):
    return dataset.split(documents(spark, sf_dir), "doc_id", F.col("lang")).groupBy("lang", "split").agg(F.count("*").alias("n"))


@query(
    """WITH RECURSIVE p AS (SELECT DISTINCT doc_id AS id, text AS value FROM documents),
       l AS (SELECT DISTINCT a.id AS x, b.id AS y FROM p a JOIN p b ON a.value = b.value),
       r(id, root) AS (SELECT x, y FROM l UNION SELECT r.id, l.y FROM r JOIN l ON r.root = l.x)
       SELECT id, min(root) AS "group" FROM r GROUP BY id"""
)
def split_group_components(spark, sf_dir):
    return dataset.group_components(documents(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("text").alias("value")))


@query()
def split_groups(spark, sf_dir):
    return dataset.split_groups(documents(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("text").alias("value")))


@query(
    r"""SELECT doc_id, md5(lower(text)) AS lower, md5(trim(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '\.\s*$', ''))) AS open_end,
        md5(CASE WHEN regexp_matches(text, '\.\s*$') THEN text ELSE text || '.' END) AS closed, md5(regexp_replace(text, '\s+', '', 'g')) AS dense,
        md5(array_to_string(list_filter(string_split_regex(text, '\s+'), lambda w: w <> ''), '  ')) AS wide,
        md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\.\s*', '.', 'g'), ',\s*', ', ', 'g'), ';\s*', '; ', 'g'), ':\s*', ': ', 'g'), '\s+', ' ', 'g'))) AS tidy
        FROM documents"""
)
def variants(spark, sf_dir):
    t = F.col("text")
    made = {
        "lower": F.lower(t),
        "open_end": dataset.drop_last_stop(t),
        "closed": dataset.close_sentence(t),
        "dense": dataset.without_blanks(t),
        "wide": dataset.double_blanks(t),
        "tidy": dataset.tidy_punctuation(t),
    }
    return documents(spark, sf_dir).select("doc_id", *(F.md5(c.cast("binary")).alias(k) for k, c in made.items()))


@query()
def typos(spark, sf_dir):
    rows = documents(spark, sf_dir)
    return rows.select("doc_id", *(F.md5(dataset.typo(F.col("text"), k, 42, "doc_id").cast("binary")).alias(k) for k in ("insertion", "deletion", "swap", "keyboard")))


# --- spans -------------------------------------------------------------------------------


@query(f"WITH {span_sql(NUMBER)} SELECT doc_id, start, end_ AS \"end\", match AS text FROM s")
def span_numbers(spark, sf_dir):
    found = F.explode(find_spans(F.col("text"), NUMBER)).alias("s")
    return documents(spark, sf_dir).select("doc_id", found).select("doc_id", "s.start", "s.end", "s.text")


def _with_numbers(spark, sf_dir):
    return spread(documents(spark, sf_dir).select("doc_id", "text").where(F.col("doc_id").isNotNull() & F.col("text").rlike("[0-9]")))


@query(
    f"""WITH {span_sql(NUMBER)}, {span_sql(ARTICLE, name="a")}
    SELECT s.doc_id, s.start FROM s WHERE EXISTS (SELECT 1 FROM a WHERE a.doc_id = s.doc_id AND
      CASE WHEN s.start >= a.end_ THEN abs(s.start - a.end_) ELSE abs(a.start - s.end_) END <= 50)"""
)
def span_proximity(spark, sf_dir):
    rows = _with_numbers(spark, sf_dir).select("doc_id", near_spans(F.col("text"), NUMBER, ARTICLE, 50).alias("n"))
    return rows.select("doc_id", F.explode("n").alias("s")).select("doc_id", "s.start")


@query(
    f"""WITH {span_sql(NUMBER)}, {span_sql(ARTICLE, name="a")}
    SELECT s.doc_id, s.start, max(a.end_) AS before FROM s JOIN a ON a.doc_id = s.doc_id AND a.end_ <= s.start AND s.start - a.end_ < 20 GROUP BY 1, 2"""
)
def nearest_preceding(spark, sf_dir):
    rows = _with_numbers(spark, sf_dir).select("doc_id", spans_after(F.col("text"), NUMBER, ARTICLE, 19).alias("n"))
    return rows.select("doc_id", F.explode("n").alias("s")).select("doc_id", "s.start", F.col("s.other").alias("before"))


DELIMITERS = "[.。;；!！?？]"
HEADERS = r"(?m)^[ \t]*[0-9]+[.)][ \t]+"


@query(
    f"""WITH t AS (SELECT conv_id * 1000 + turn AS doc_id, coalesce(text, '') AS text FROM conversations), {span_sql(DELIMITERS, "t")}, {span_sql(HEADERS, "t", name="h")},
    cuts AS (SELECT DISTINCT doc_id, c FROM (SELECT doc_id, end_ AS c FROM s UNION ALL SELECT doc_id, start FROM h) JOIN t USING (doc_id) WHERE c > 0 AND c < length(text)),
    lows AS (SELECT doc_id, 0 AS start FROM t WHERE text <> '' UNION ALL SELECT doc_id, c FROM cuts)
    SELECT doc_id, start, coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY start), CAST(length(text) AS INTEGER)) AS "end" FROM lows JOIN t USING (doc_id)"""
)
def sentence_segments(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    rows = rows.withColumn("_m", assertion.RULES.scan(F.col("text"))).withColumn("_k", assertion.conjunctions(F.col("_m")))
    found = F.explode(assertion.sentences(F.col("text"), F.col("_m"), F.col("_k"))).alias("s")
    return rows.select("doc_id", found).select("doc_id", "s.start", "s.end")


def _scanned(spark, sf_dir):
    return spread(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "text", extract.RULES.scan(F.col("text")).alias("m"))


@query()
def disease_mentions(spark, sf_dir):
    return _scanned(spark, sf_dir).select("doc_id", F.explode(extract.diseases(F.col("text"), F.col("m"))).alias("d")).select("doc_id", "d.*")


@query()
def assertion_cues(spark, sf_dir):
    rows = spread(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", assertion.RULES.scan(F.col("text")).alias("m"))
    return rows.select("doc_id", F.explode(assertion.cues(F.col("m"))).alias("c")).select("doc_id", "c.start", "c.end", "c.kind", "c.priority")


@query()
def clinical_entities(spark, sf_dir):
    return pipeline.entities(documents(spark, sf_dir)).select("doc_id", "start", "end", "text", "type", "confidence", F.array_join("assertions", ",").alias("assertions"))


@query()
def clinical_results(spark, sf_dir):
    found = pipeline.linked(pipeline.entities(documents(spark, sf_dir)))
    return found.select("doc_id", "start", "end", "type", F.array_join("assertions", ",").alias("assertions"), F.array_join("candidates", ",").alias("candidates"))


# --- retrieval ---------------------------------------------------------------------------

WORDS = "list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '')"


def _words(text):
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


@query(
    f"""WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents WHERE text IS NOT NULL), q AS (SELECT item_id AS id, unnest({WORDS}) AS word FROM benchmark),
    asked AS (SELECT id, word, count(*) AS times FROM q GROUP BY 1, 2), s AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM d),
    tf AS (SELECT doc_id, word, len(any_value(w)) AS length, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS word FROM d) GROUP BY doc_id, word),
    df AS (SELECT word, count(*) AS df FROM tf GROUP BY word), r AS (SELECT word, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df, s),
    i AS (SELECT word, CASE WHEN raw < 0 THEN (SELECT avg(raw) * 0.25 FROM r) ELSE raw END AS idf FROM r),
    c AS (SELECT id, doc_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * length / mean))), 6) AS score
          FROM tf JOIN i USING (word) JOIN asked USING (word), s GROUP BY id, doc_id)
    SELECT id, doc_id, round(score, 4) AS score, row_number() OVER (PARTITION BY id ORDER BY score DESC, doc_id) AS rank FROM c QUALIFY rank <= 5"""
)
def bm25_topk(spark, sf_dir):
    return _bm25_ranks(spark, sf_dir).select("id", "doc_id", F.round("score", 4).alias("score"), F.expr(LONG_RANK))


def _bm25_ranks(spark, sf_dir):
    docs = documents(spark, sf_dir).where("text is not null").select("doc_id", _words("text").alias("tokens"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), _words("text").alias("tokens"))
    return retrieve.bm25(asked, docs, 5)


TOP = """c AS (SELECT q.vec_id AS id, v.vec_id, q.label AS gold, v.label, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score
  FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0)"""


@query(f"WITH {TOP} SELECT id, vec_id, round(score, 6) AS score, row_number() OVER (PARTITION BY id ORDER BY score DESC, vec_id) AS rank FROM c QUALIFY rank <= 10")
def dense_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    asked = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("id"), F.col("v").alias("q"))  # the stated query set
    return retrieve.dense(asked, vectors, 10).select("id", "vec_id", F.round("score", 6).alias("score"), F.expr(LONG_RANK))


@query(
    f"""WITH {TOP}, r AS (SELECT id, gold, label, row_number() OVER (PARTITION BY id ORDER BY score DESC, vec_id) AS rank FROM c WHERE id <> vec_id QUALIFY rank <= 10),
    g AS (SELECT id, any_value(gold) AS gold, list(label ORDER BY rank) AS codes FROM r GROUP BY id), p AS (SELECT coalesce(list_position(codes, gold), 0) AS rank FROM g)
    SELECT count(*) AS n, 1.0::DOUBLE AS coverage, round(avg(CASE WHEN rank > 0 THEN 1.0 / rank ELSE 0 END), 6) AS mrr,
      {", ".join(f"round(avg(CASE WHEN rank > 0 AND rank <= {k} THEN 1.0 ELSE 0 END), 6) AS recall_{k}" for k in (1, 3, 5, 10))} FROM p"""
)
def recall_mrr(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("id"), F.col("embedding").alias("q"))
    found = retrieve.dense(asked, vectors.select("vec_id", F.col("embedding").alias("v")), 11).where("id <> vec_id").where("rank <= 11")
    labelled = found.join(vectors.select("vec_id", "label"), "vec_id")
    order = F.row_number().over(Window.partitionBy("id").orderBy("rank"))
    best = labelled.withColumn("rank", order).where("rank <= 10").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "label"))), lambda x: x["label"]).alias("codes"))
    return metrics.ranking(best.join(vectors.select(F.col("vec_id").alias("id"), F.col("label").alias("gold")), "id"), (1, 3, 5, 10))


@query(
    f"""WITH t AS (SELECT conv_id, turn, list_distinct({WORDS}) AS w FROM conversations),
    p AS (SELECT conv_id, turn, w, lag(w) OVER (PARTITION BY conv_id ORDER BY turn) AS o FROM t)
    SELECT conv_id, turn, round(CASE WHEN len(w) > 0 AND len(o) > 0 THEN len(list_intersect(w, o)) / len(list_distinct(list_concat(w, o))) ELSE 0 END, 6) AS score FROM p WHERE o IS NOT NULL"""
)
def jaccard_words(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", retrieve.word_set(F.col("text")).alias("w"))
    last = F.lag("w").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = rows.withColumn("o", last).where("o is not null")
    return rows.select("conv_id", "turn", F.round(retrieve.jaccard(F.col("w"), F.col("o")), 6).alias("score"))


@query(
    f"""WITH w AS (SELECT lang, unnest({WORDS}) AS word FROM documents), c AS (SELECT lang, word, count(*) AS score FROM w GROUP BY 1, 2)
    SELECT lang, word, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, word) AS rank FROM c QUALIFY rank <= 5"""
)
def word_topk(spark, sf_dir):
    words = documents(spark, sf_dir).select("lang", F.explode(_words("text")).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("score"))
    return retrieve.top_k(words, 5, "lang", "score", "word").withColumn("rank", F.col("rank").cast("long"))


CODES = values([(e["code"], e.get("parent_code")) for e in K.ICD_BASE], "code, parent_code")


@query(
    f"""WITH RECURSIVE t AS (SELECT * FROM {CODES}),
    up(code, depth, ancestor, seen) AS (SELECT code, 1, parent_code, [code, parent_code] FROM t WHERE parent_code IS NOT NULL AND parent_code <> code
      UNION ALL SELECT up.code, up.depth + 1, t.parent_code, list_append(up.seen, t.parent_code) FROM up JOIN t ON t.code = up.ancestor
      WHERE t.parent_code IS NOT NULL AND NOT list_contains(up.seen, t.parent_code)) SELECT code, depth, ancestor FROM up"""
)
def kb_ancestors(spark, sf_dir):
    return retrieve.ancestors(kb.icd(spark, base=True))


# --- resolution, metrics, tokens ---------------------------------------------------------


COUNTS = "count(*) FILTER (ig AND ip) AS tp, count(*) FILTER (NOT ig) AS fp, count(*) FILTER (NOT ip) AS fn"
RATIOS = "round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 4) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 4) AS recall, round(CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END, 4)::DOUBLE AS f1"


# The operators above on spans and ranks that whole tables give.

#: Words with a digit, and numbers: spans that overlap.
CODED = r"[^ \t\n]*[0-9][^ \t\n]*"
WHOLE = f"{span_sql(NUMBER)}, {span_sql(CODED, name='c')}"
TABLE_PAIR = """g AS (SELECT DISTINCT doc_id, match AS text, start, end_, CASE WHEN contains(match, '.') OR contains(match, ',') THEN 'decimal' ELSE 'whole' END AS type FROM s),
  p AS (SELECT DISTINCT doc_id, match AS text, start, end_, CASE WHEN contains(match, '.') OR contains(match, ',') THEN 'decimal' ELSE 'whole' END AS type FROM c),
  m AS (SELECT coalesce(g.type, p.type) AS type, g.doc_id IS NOT NULL AS ig, p.doc_id IS NOT NULL AS ip FROM g FULL JOIN p ON (g.doc_id, g.text, g.start, g.end_, g.type) = (p.doc_id, p.text, p.start, p.end_, p.type))"""


def _found(spark, sf_dir, pattern):
    rows = documents(spark, sf_dir).select("doc_id", F.posexplode(find_spans(F.col("text"), pattern)).alias("i", "s"))
    kind = F.when(F.col("s.text").rlike("[.,]"), "decimal").otherwise("whole").alias("type")
    return rows.select("doc_id", (F.col("i") + 1).cast("long").alias("i"), "s.text", "s.start", "s.end", kind)


@query(
    f"""WITH {WHOLE}, v AS (SELECT doc_id, 2 * i AS seq, start, end_ FROM s UNION ALL SELECT doc_id, 2 * i + 1, start, end_ FROM c)
    SELECT a.doc_id, a.seq AS a, b.seq AS b,
    round(CAST(least(a.end_, b.end_) - greatest(a.start, b.start) AS DOUBLE) / (greatest(a.end_, b.end_) - least(a.start, b.start)), 6) AS iou
    FROM v a JOIN v b ON a.doc_id = b.doc_id AND a.seq < b.seq AND a.start < b.end_ AND b.start < a.end_"""
)
def span_overlap_pairs_documents(spark, sf_dir):
    numbers, coded = _found(spark, sf_dir, NUMBER), _found(spark, sf_dir, CODED)
    spans = numbers.withColumn("seq", 2 * F.col("i")).unionByName(coded.withColumn("seq", 2 * F.col("i") + 1))
    item = spans.select("doc_id", "seq", F.struct("start", "end").alias("s"))
    pairs = validate.overlap_pairs(spans).join(item.select("doc_id", F.col("seq").alias("a"), F.col("s").alias("x")), ["doc_id", "a"])
    pairs = pairs.join(item.select("doc_id", F.col("seq").alias("b"), F.col("s").alias("y")), ["doc_id", "b"])
    return pairs.select("doc_id", "a", "b", F.round(hull_iou(F.col("x"), F.col("y")), 6).alias("iou"))


def _table_pair(spark, sf_dir):
    return _found(spark, sf_dir, NUMBER), _found(spark, sf_dir, CODED)


@query(f"WITH {WHOLE}, {TABLE_PAIR}, c2 AS (SELECT {COUNTS} FROM m) SELECT *, {RATIOS} FROM c2")
def prf_overall_documents(spark, sf_dir):
    return metrics.prf(*_table_pair(spark, sf_dir), key=["doc_id", *metrics.KEY])


@query(f"WITH {WHOLE}, {TABLE_PAIR}, c2 AS (SELECT type, {COUNTS} FROM m GROUP BY type) SELECT *, {RATIOS} FROM c2")
def prf_per_class_documents(spark, sf_dir):
    return metrics.prf(*_table_pair(spark, sf_dir), key=["doc_id", *metrics.KEY], by=["type"])


def _table_ranks(spark, sf_dir):
    """The five best documents by BM25 for each benchmark item, and the 20 nearest vectors
    for each vec_id that is an item_id; a doc_id and an equal vec_id are one code."""
    lexical = _bm25_ranks(spark, sf_dir).select("id", F.col("doc_id").alias("code"), F.lit("bm25").alias("source"), F.expr(LONG_RANK), "score")
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("vec_id"))
    asked = vectors.join(items, "vec_id", "left_semi").select(F.col("vec_id").alias("id"), F.col("v").alias("q"))
    near = retrieve.dense(asked, vectors, 20).select("id", F.col("vec_id").alias("code"), F.lit("dense").alias("source"), "rank", F.round("score", 9).alias("score"))
    return lexical.unionByName(near)


#: Scores are rounded once, at the end, and coarsely: weights of few digits times scores of
#: few digits often end in the 5 that engines round differently.
TABLE_RANKS = f"""b AS ({ORACLE_SQL["bm25_topk"].replace("round(score, 4) AS score", "score")}), dn AS (SELECT q.vec_id AS id, v.vec_id AS code, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score
  FROM embeddings q, embeddings v WHERE q.vec_id IN (SELECT item_id FROM benchmark)),
  dr AS (SELECT id, code, row_number() OVER (PARTITION BY id ORDER BY score DESC, code) AS rank, round(score, 9) AS score FROM dn QUALIFY rank <= 20),
  p AS (SELECT id, doc_id AS code, rank, least(score / 20, 1) AS norm, 0.7::DOUBLE AS weight FROM b UNION ALL SELECT id, code, rank, least(score, 1), 0.75::DOUBLE FROM dr)"""
TABLE_FUSED = "SELECT id, code, round(score, 6) AS score, row_number() OVER (PARTITION BY id ORDER BY round(score, 9) DESC, code) AS rank FROM f QUALIFY rank <= 20"


@query(f"WITH {TABLE_RANKS}, f AS (SELECT id, code, sum(1.0::DOUBLE / (60 + rank) * weight * (0.5 + 0.5 * norm)) AS score FROM p GROUP BY 1, 2) {TABLE_FUSED}")
def rrf_fuse_tables(spark, sf_dir):
    return retrieve.fuse_ranks(_table_ranks(spark, sf_dir), "code").select("id", "code", F.round("score", 6).alias("score"), F.expr(LONG_RANK))


@query(f"WITH {TABLE_RANKS}, f AS (SELECT id, code, sum(weight * norm) AS score FROM p GROUP BY 1, 2) {TABLE_FUSED.replace("round(score, 6) AS score", "round(score, 3) AS score")}")
def weighted_fuse_tables(spark, sf_dir):
    return retrieve.fuse_weighted(_table_ranks(spark, sf_dir), "code").select("id", "code", F.round("score", 3).alias("score"), F.expr(LONG_RANK))


@query()
def run_statistics(spark, sf_dir):
    return io.run_statistics(pipeline.process(documents(spark, sf_dir), pipeline.Config(link_icd=False, link_drugs=False)))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k FROM events")
def event_props_json(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities with assertions of every document."""
    return clinical_entities(spark, sf_dir)
