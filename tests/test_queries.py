"""Every registered query runs on the smallest tables, and its rows equal those of its SQL."""

import math

import pytest

from lectern.plans.catalog import ORACLE_SQL, QUERIES


def rows(df):
    df = df[sorted(df.columns)]

    def plain(v):
        if v is None or isinstance(v, float) and math.isnan(v) or str(v) == "<NA>":
            return ""
        try:
            return f"{float(v):.6f}"
        except (TypeError, ValueError):
            return str(v)

    return list(df.columns), sorted(tuple(map(plain, r)) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in "documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    found = QUERIES[name](spark, sf).toPandas()
    if name in ORACLE_SQL:
        assert rows(found) == rows(duck.execute(ORACLE_SQL[name]).df())
    else:
        assert len(found) > 0


def test_similarity_percent_keeps_the_sign_of_zero(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    vectors = [[1.0, 0.0], [-1e-5, 1.0], [1e-5, 1.0], [0.0, 1.0], [-0.5, 1.0], [0.0, 0.0], None, [-4e-5, 1.0], [-6e-5, 1.0]]
    spark.createDataFrame([(i, v, 0) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    found = QUERIES["similarity_percent"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found)) == sorted(con.execute(ORACLE_SQL["similarity_percent"]).fetchall())
    assert {r.vec_id: r.shown for r in found}[1] == "-0.00%"


def test_rounded_halves(spark):
    from pyspark.sql import functions as F

    from lectern.functions.vectors import rounded

    values = [0.5, 1.5, 2.5, -0.5, -1.5, -2.5, 0.49999999999999994, -0.2, 0.0, 3.0, math.inf, None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").select(rounded(F.col("x"), 0)).collect()]
    assert list(map(str, got)) == list(map(str, [1.0, 2.0, 3.0, -1.0, -2.0, -3.0, 0.0, -0.0, 0.0, 3.0, math.inf, None]))


def test_entry_names_queries_once():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and set(QUERIES) <= set(e.queries())
