"""Streaming ingestion: files that arrive in a folder go through the same batch job, exactly once by content."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.functions.text import clean_lines, title_of_path
from lectern.operators.store import Store


def arriving_texts(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of rows (title, text) of the text files that appear below ``path``."""
    raw = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path, wholetext=True)
    return raw.select(title_of_path(F.regexp_replace(F.col("_metadata.file_path"), r"\.(md|txt)$", ".pdf")).alias("title"), clean_lines(F.col("value")).alias("text"))


def arriving_files(spark: SparkSession, path: str, files_per_batch: int = 100, clean: str = "off", archive: str | None = None) -> DataFrame:
    """A stream of rows (path, modificationTime, length, content) of the files that appear below ``path``.

    ``clean``: "delete" removes a file once its batch is done and the next one begins, "archive" moves it below ``archive``, "off" leaves it.
    """
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    raw = raw.option("maxFilesPerTrigger", files_per_batch).option("cleanSource", clean)
    return (raw.option("sourceArchiveDir", archive) if archive else raw).load(path)


def ingest_stream(docs: DataFrame, store: Store, chunker: Callable[[DataFrame], DataFrame], checkpoint: str, name: str = "ingest", prepare: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Run ``Store.ingest`` on each micro-batch until what is there has been read. ``prepare`` makes a batch's rows (title, text).

    A batch that is delivered again finds its files known, so nothing is stored twice; several streams may fill one store.
    """

    def write(batch: DataFrame, number: int) -> None:
        store.ingest(prepare(batch) if prepare else batch, f"{name}-{number}", chunker)

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
