"""Queries on fixtures have counterparts that take whole tables."""

import time

import duckdb
import pytest

from noteweave.plans import registry

NAMES = ["span_overlap_pairs_documents", "prf_overall_documents", "prf_per_class_documents", "rrf_fuse_tables", "weighted_fuse_tables"]


def by_key(rows):
    """Rows by what is not a float, with their floats."""
    parts = [(tuple(x for x in r if not isinstance(x, float)), [x for x in r if isinstance(x, float)]) for r in rows]
    keys, floats = zip(*sorted(parts), strict=True)
    return keys, [x for f in floats for x in f]


@pytest.mark.parametrize("name", NAMES)
def test_whole_table_queries_equal_their_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS FROM '{sf_dir}/{t}.parquet'")
    got = registry.QUERIES[name](spark, sf_dir)
    want = con.execute(registry.ORACLE_SQL[name])
    assert got.columns == [c[0] for c in want.description]
    rows = got.collect()
    (keys, floats), (want_keys, want_floats) = by_key(map(tuple, rows)), by_key(want.fetchall())
    assert keys == want_keys and floats == pytest.approx(want_floats, abs=2e-6)
    if not name.startswith("prf"):  # more rows than the fixture has
        assert len(rows) > 11


def dense(n):
    """n numbers and n articles, near and far from each other, touching and apart."""
    return "".join(f"{k}{' ' * (k % 60)} {('the', 'de', 'la', 'der')[k % 4]} {'é' * (k % 23)}" for k in range(n))


def beside_rows(spark, tmp_path, name, n=2000):
    """Rows and seconds of a query on a table with long texts, its columns, and the SQL's rows and columns."""
    odd = [None, "", "7", " the ", " the 1", "1 the ", " the the 2", "1,5.3 de 4" + "x" * 48 + "9", " la " + "𝒳" * 19 + "6", " la " + "x" * 20 + "6", "\n the \n3"]
    rows = [(k, t) for k, t in enumerate(odd)] + [(100 + k, dense(n)) for k in range(3)] + [(None, "1 the 2")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{tmp_path}/documents.parquet/*.parquet'")
    start = time.time()
    got = registry.QUERIES[name](spark, str(tmp_path))
    found = sorted(map(tuple, got.collect()))
    took = time.time() - start
    want = con.execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    return found, took, got.columns, sorted(want.fetchall()), columns


def test_span_proximity_of_long_texts(spark, tmp_path):
    found, took, columns, want, names = beside_rows(spark, tmp_path, "span_proximity")
    assert found == want and len(found) > 2000 and columns == names
    assert took < 30  # quadratic in the matches of a text, this took minutes


def test_nearest_preceding_of_long_texts(spark, tmp_path):
    found, took, columns, want, names = beside_rows(spark, tmp_path, "nearest_preceding")
    assert found == want and len(found) > 2000 and columns == names
    assert took < 30  # quadratic in the matches of a text, this took minutes
