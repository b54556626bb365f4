"""Registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cover_tree, line_dedup, mixing, packing, quality_model, quality_rules, simhash, substring_dedup, token_files, url_filter
from .common import scratch_path

URL_RULES = (
    url_filter.Rule("block", "com", "/en/"),
    url_filter.Rule("allow", "example.com", "/en/7"),
    url_filter.Rule("block", "net", "/de/"),
    url_filter.Rule("block", "example.net", "/de/8"),
    url_filter.Rule("block", "org", "/es/"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pack_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents")).drop("ids")


#: The documents of one fold in five are held out of training.
FOLDS = 5
ACCEPTED = 0.3


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0


def quality_fit(spark: SparkSession, sf_dir: str) -> quality_model.Model:
    """A model fitted to the labelled documents of the folds for training."""
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").alias("label"))
    return quality_model.fit(table(spark, sf_dir, "documents").select("doc_id", "text"), labels)


def op2_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_model.score(table(spark, sf_dir, "documents"), quality_fit(spark, sf_dir))
    out = F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= ACCEPTED).cast("int").alias("predicted"))


def op3_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["high"] - s["low"])
    n_spans = F.size("spans").cast("long").alias("n_spans")
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), n_spans, F.sha2("kept", 256).alias("kept_sha256"))


def op4_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_filter.judge_urls(pages, URL_RULES, url_filter.plain_http_hosts(pages))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op5_simhash_vantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def op6_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_vectors(table(spark, sf_dir, "embeddings"))


def op7_hypergeometric_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"), columns=["doc_id", "source"])
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "draws")


def op8_repetition_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.repetition_rules(table(spark, sf_dir, "documents"))
    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged.select(*first, *(c for c in judged.columns if c not in first))


def op9_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = F.sha2(F.col("kept_text").cast("binary"), 256)
    return left.select("doc_id", "n_lines", "n_dropped", digest.alias("kept_sha256"))


def op10_bit_plane_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), path)
    return token_files.document_digests(spark, path)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pack_bin_slack": op1_pack_bin_slack,
    "op2_subword_quality": op2_subword_quality,
    "op3_suffix_arrays": op3_suffix_arrays,
    "op4_url_cascade": op4_url_cascade,
    "op5_simhash_vantage": op5_simhash_vantage,
    "op6_cover_tree": op6_cover_tree,
    "op7_hypergeometric_mix": op7_hypergeometric_mix,
    "op8_repetition_coverage": op8_repetition_coverage,
    "op9_line_runs": op9_line_runs,
    "op10_bit_plane_files": op10_bit_plane_files,
}

_RULE_SQL = " ".join(
    f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN {{{k}}}"
    for k, r in enumerate(sorted(URL_RULES, key=lambda r: -len(r.name)))
)
_ORDERED = sorted(URL_RULES, key=lambda r: -len(r.name))
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

ORACLE_SQL: dict[str, str] = {
    "op4_url_cascade": f"""WITH u AS (SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), {_LOWER}), '') AS host,
          coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path, translate(split_part(url, '://', 1), {_LOWER}) AS scheme FROM pages),
        b AS (SELECT host FROM u WHERE host <> '' GROUP BY host HAVING count(*) >= 2 AND NOT bool_or(scheme = 'https'))
        SELECT page_id, host, path, CASE {_RULE_SQL.format(*(f"'{r.name}'" for r in _ORDERED))} END AS rule,
          CASE {_RULE_SQL.format(*(f"'{r.verdict}'" for r in _ORDERED))} WHEN host IN (SELECT host FROM b) THEN 'block' ELSE 'allow' END AS verdict FROM u""",
    "op6_cover_tree": """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
        l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98),
        r(id, other) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.id, l.y FROM r JOIN l ON r.other = l.x),
        c AS (SELECT id, min(other) AS component_id FROM r GROUP BY id), n AS (SELECT x, count(*) AS n FROM l GROUP BY x)
        SELECT id AS vec_id, coalesce(n, 0) AS n_links, component_id, id = component_id AS kept FROM c LEFT JOIN n ON n.x = c.id""",
    "op9_line_runs": f"""WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        k AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM s),
        t AS (SELECT doc_id, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), {_LOWER}) AS key FROM k),
        f AS (SELECT key FROM t WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
        SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
          sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
        FROM t LEFT JOIN f USING (key) GROUP BY doc_id""",
}
