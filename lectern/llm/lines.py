"""Line dedup by site-relative frequency, in DataFrame functions only.

A line is boilerplate on a host if the share of the host's pages that contain it exceeds ``max_ratio`` and at least
``min_pages`` pages do. Such lines are dropped from all pages of that host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, unused

MAX_RATIO = 0.05
MIN_PAGES = 3
BROADCAST_LINES = 200_000
SALTS = 64


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, without user, port and a leading "www."; null where there is none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(?:www\.)?(\[[^]]*\]|[^/?#:]+)", 1)
    return F.when(host != "", host)


def _key(line: Column) -> Column:
    """128 bits of a line: two 64-bit hashes of different seeds."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(7), line).alias("b"))


def boilerplate(df: DataFrame, host_col: str = "source", text_col: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """Rows (host, bad): the keys of each host's boilerplate lines.

    Lines are counted once a page, blank lines never; null hosts are one host, null texts pages without lines. Counts are
    combined before the shuffle, so neither a hot host nor a hot line gathers its pages. A host has at most (mean lines of a
    page / ``max_ratio``) such lines, however many pages it has.
    """
    pages = df.select(F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("total"))
    lines = F.filter(F.array_distinct(F.split("text", "\n", -1)), lambda x: x != "")
    each = pages.select("host", F.explode(lines).alias("line")).select("host", _key(F.col("line")).alias("key"))
    counts = each.groupBy("host", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    h = totals.withColumnRenamed("host", "h")
    bad = counts.join(h, F.col("host").eqNullSafe(F.col("h"))).where(F.col("n") > F.lit(float(max_ratio)) * F.col("total"))
    return bad.groupBy("host").agg(F.collect_list("key").alias("bad"))


def drop_boilerplate(df: DataFrame, host_col: str = "source", text_col: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, counts: bool = True) -> DataFrame:
    """``df`` with boilerplate lines cut out of ``text_col``; with ``counts`` also ``n_lines`` and ``n_dropped`` (long).

    Every row stays, repeated ones too; a text all of whose lines go is empty; a null text stays null with no lines; an
    empty table stays empty. Columns named like the new ones are replaced. The table of boilerplate keys is written first; up to
    BROADCAST_LINES keys it is broadcast, so pages aren't shuffled; beyond that pages and keys join on host and a salt.
    """
    found = materialize(boilerplate(df, host_col, text_col, max_ratio, min_pages), "boilerplate")
    size = found.agg(F.coalesce(F.sum(F.size("bad")), F.lit(0))).first()[0]
    host, bad, salt, copy, kept = unused(df, "host", "bad", "salt", "copy", "kept")
    found = found.withColumnsRenamed({"host": host, "bad": bad})
    same = F.col(host_col).eqNullSafe(F.col(host))
    if size <= BROADCAST_LINES:
        joined = df.join(F.broadcast(found), same, "left")
    else:
        salted = df.withColumn(salt, F.pmod(F.xxhash64(text_col), F.lit(SALTS)))
        copies = found.withColumn(copy, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        joined = salted.join(copies, same & (F.col(salt) == F.col(copy)), "left").drop(salt, copy)
    lines = F.split(text_col, "\n", -1)
    rest = F.when(F.col(bad).isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.array_contains(F.col(bad), _key(x))))
    out = joined.withColumn(kept, rest)
    if counts:
        gone = F.coalesce(F.size(lines) - F.size(kept), F.lit(0))
        out = out.withColumn("n_lines", F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)).cast("long"))
        out = out.withColumn("n_dropped", F.when(F.col(text_col).isNull(), 0).otherwise(gone).cast("long"))
    return out.withColumn(text_col, F.array_join(kept, "\n")).drop(kept, host, bad)


def sql(max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> str:
    """The rows (doc_id, text, n_lines, n_dropped) of ``drop_boilerplate`` over ``documents``, for DuckDB."""
    return f"""
WITH lines AS (
  SELECT rowid AS r, source, unnest(list_distinct(string_split(text, chr(10)))) AS line FROM (SELECT row_number() OVER () AS rowid, * FROM documents) d
), totals AS (SELECT source, count(*) AS total FROM documents GROUP BY source),
bad AS (
  SELECT l.source, list(l.line) AS bad FROM (SELECT source, line, count(*) AS n FROM lines WHERE line <> '' GROUP BY source, line) l
  JOIN totals t ON l.source IS NOT DISTINCT FROM t.source WHERE l.n >= {min_pages} AND l.n > CAST({max_ratio} AS DOUBLE) * t.total GROUP BY l.source
), split AS (
  SELECT d.doc_id, d.text, string_split(d.text, chr(10)) AS all_lines, b.bad FROM documents d LEFT JOIN bad b ON d.source IS NOT DISTINCT FROM b.source
), kept AS (
  SELECT doc_id, text, all_lines, CASE WHEN bad IS NULL THEN all_lines ELSE list_filter(all_lines, lambda x: NOT list_contains(bad, x)) END AS kept FROM split
)
SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE array_to_string(kept, chr(10)) END AS text,
  coalesce(len(all_lines), 0) AS n_lines, coalesce(len(all_lines) - len(kept), 0) AS n_dropped
FROM kept"""
