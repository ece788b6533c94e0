"""The pipeline's rows against a stage-by-stage brute force."""

import base64
import hashlib
import re

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from lectern.llm import quality
from lectern.llm.queries import ORACLE_SQL, QUERIES

from .test_jaccard import brute as near
from .test_lines import brute as cut


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def leaks(text, items):
    w = words(text)
    for item in items:
        n = len(item)
        if n and any(w[i : i + n] == item for i in range(len(w) - n + 1)):
            return True
    return False


def test_stages_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    scores = {r.doc_id: r.score for r in quality.classify(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source", "lang").collect()]
    kept = [r for r in rows if scores[r[0]] >= 0.3]
    texts = [(k, t, s) for k, t, s, _ in kept]
    lined = {k: t for k, t, _, _ in cut(texts, 0.05, 3)}
    kept = [(k, lined[k], s, la) for k, _, s, la in kept]
    classes = near([(k, t) for k, t, _, _ in kept])
    kept = [r for r, (c, n) in zip(kept, classes, strict=True) if n == 0 or c == r[0]]
    items = [words(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    kept = [r for r in kept if not leaks(r[1], items)]
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    code = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((k, la, s, code.encode_ordinary(t), hashlib.sha256(t.encode()).hexdigest()) for k, t, s, la in kept)
    got = sorted((r.doc_id, r.lang, r.source, r.ids, r.decoded_sha256) for r in corpus_pipeline.run(spark, sf).collect())
    assert got == want and 0 < len(got) < len(rows)


def test_stages_keep_the_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns, name


def test_stages_take_nulls_repeats_and_empty_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = docs.limit(3).unionByName(docs.limit(3)).unionByName(docs.limit(2).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema]))
    for table in (odd, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            found = stage(spark, table, sf).collect()
            assert len(found) <= table.count(), name
    left = [r.doc_id for r in corpus_pipeline.drop_near_copies(spark, odd, sf).collect()]
    assert len([k for k in left if k is not None]) == len({k for k in left if k is not None}) and left.count(None) == 2


def test_stages_take_columns_with_their_own_names(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    clash = ["score", "stats", "_bad", "class_id", "key", "rep", "label", "ids", "decoded", "n_lines", "hash", "_text", "_doc"]
    odd = docs.select("*", *[F.lit("extra").alias(c) for c in clash])
    for name, stage in corpus_pipeline.STAGES:
        plain, found = stage(spark, docs, sf), stage(spark, odd, sf)
        assert found.count() == plain.count(), name
        if stage is not corpus_pipeline.encode:
            assert found.columns == odd.columns and found.where(F.col("score") != "extra").count() == 0, name


def test_run_leaves_only_what_its_rows_are_read_from(spark, sf):
    from lectern.llm.common import watched

    with watched() as paths:
        out = corpus_pipeline.run(spark, sf)
    fs = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    left = [p for p in paths if fs(p).getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs(p))]
    assert len(left) == 1 and "stage-benchmark" in left[0] and out.count() > 0


def test_queries_are_complete():
    assert [f"op{n}" for n in range(1, 11)] == sorted((k.split("_")[0] for k in QUERIES), key=lambda k: int(k[2:])) and set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in "documents pages benchmark labels".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(ORACLE_SQL[name]).df()
    got = QUERIES[name](spark, sf).toPandas()[list(want.columns)]
    plain = lambda df: sorted(map(str, df.itertuples(index=False, name=None)))
    assert plain(got) == plain(want)
