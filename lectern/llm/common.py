"""Helpers shared by the operators of this package."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

BATCH_ROWS = 512
ARROW_ROWS = 1000
ARROW_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where that is unset, a local master (tests, one machine) gets a new local folder; on a cluster it is an error, since executors
    don't see each other's disks.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not found and not context._jsc.sc().getCheckpointDir().isDefined():
        if not re.fullmatch(r"local(\[[^]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="lectern-"))
    return (found or context._jsc.sc().getCheckpointDir().get()).rstrip("/")


_watching: list[list[str]] = []


def scratch(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no other run uses; ``clear`` deletes those of an application."""
    path = f"{_own_dir(spark)}/{label}-{uuid.uuid4().hex}"
    for paths in _watching:
        paths.append(path)
    return path


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/lectern/{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Delete all scratch of this application: when no result of an operator is read any more."""
    _delete(spark, _own_dir(spark))


@contextmanager
def watched() -> Iterator[list[str]]:
    """The scratch paths that are made inside, for ``discard_paths`` once what was read from them is written elsewhere."""
    paths: list[str] = []
    _watching.append(paths)
    try:
        yield paths
    finally:
        _watching.pop()  # the innermost


def discard_paths(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, and losing executors loses nothing."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what ``materialize`` wrote for these tables, once nothing reads them any more."""
    for df in tables:
        _delete(df.sparkSession, df.scratch_path)


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, after the session's limits on an Arrow batch were lowered to ARROW_ROWS rows and ARROW_BYTES bytes.

    Texts can be long; buffers on both sides of a Python worker are as large as a batch.
    """
    conf = df.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        if not 0 < _bytes(conf.get(f"spark.sql.execution.arrow.{name}")) <= most:
            conf.set(f"spark.sql.execution.arrow.{name}", most)
    return df


def _bytes(value: str) -> int:
    """A setting's number; sizes may have a unit."""
    found = re.fullmatch(r"(-?\d+)\s*([kmgt]?)b?", value.strip().lower())
    return int(found[1]) << 10 * " kmgt".index(found[2] or " ") if found else -1


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, after which a Python worker, which outlives the task, gives free memory back to the system."""

    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            import ctypes

            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except OSError:  # another C library
            pass

    return whole


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt out evenly if its scan has fewer partitions than there are cores (a small file in one row group)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def open_fs(uri: str):
    """(filesystem, path) of a URI; a bare path is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as it takes not to be a column of ``df`` in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def append_columns(
    df: DataFrame,
    fields: list[T.StructField],
    compute: Callable[..., list[pa.Array]],
    needs: list[str],
    rows: int = BATCH_ROWS,
) -> DataFrame:
    """``df`` with ``fields`` appended, made from the columns ``needs`` in Arrow batches of at most ``rows`` rows.

    A narrow map: no shuffle, memory bounded by a batch. ``compute`` takes one Arrow array per needed column. Columns
    of ``df`` whose names are those of ``fields`` (in any case) are replaced; all others pass through.
    """
    taken = {f.name.lower() for f in fields}
    keep = [i for i, c in enumerate(df.columns) if c.lower() not in taken]
    at = [df.columns.index(c) for c in needs]
    schema = T.StructType([df.schema[i] for i in keep] + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, rows):
                part = whole.slice(start, rows)
                made = compute(*[part.column(i) for i in at])
                yield pa.RecordBatch.from_arrays([part.column(i) for i in keep] + made, names=[f.name for f in schema])

    return small_batches(df).mapInArrow(released(run), schema)
