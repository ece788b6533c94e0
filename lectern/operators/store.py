"""The catalogue of files and chunks: content-addressed inserts, look-ups, deletes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import content_hash, trim_ws

FILES = "id STRING NOT NULL, title STRING NOT NULL, extracted_text STRING NOT NULL"
CHUNKS = "id STRING NOT NULL, file_id STRING, chunk_index BIGINT NOT NULL, text_data STRING NOT NULL, embeddings ARRAY<DOUBLE>"


def as_files(docs: DataFrame, title_col: str = "title", text_col: str = "text") -> DataFrame:
    """Rows (id, title, extracted_text); the id is the hash of the text."""
    return docs.select(content_hash(F.col(text_col)).alias("id"), F.col(title_col).alias("title"), F.col(text_col).alias("extracted_text"))


def split_empty(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows with text, rows refused because their text is null or blank)."""
    full = F.coalesce(F.char_length(trim_ws(F.col(text_col))) > 0, F.lit(False))
    return docs.where(full), docs.where(~full)


def new_files(incoming: DataFrame, files: DataFrame) -> DataFrame:
    """The incoming files whose id isn't known yet, one of each; of several titles the least stays.

    Ids and titles alone decide which; only then are the texts of these fetched, and none of the files that are known.
    """
    least = incoming.groupBy("id").agg(F.min("title").alias("_least")).join(files.select("id"), "id", "left_anti")
    return incoming.join(least, "id").where(F.col("title").eqNullSafe(F.col("_least"))).dropDuplicates(["id"]).select("id", "title", "extracted_text")


def duplicates(incoming: DataFrame, files: DataFrame) -> DataFrame:
    """The incoming files that are known already."""
    return incoming.join(files.select("id"), "id", "left_semi")


def get_document(files: DataFrame, file_id: str) -> DataFrame:
    return files.where(F.col("id") == file_id).limit(1)


def list_documents(files: DataFrame) -> DataFrame:
    return files.select("id", "title")


def read_chunk(chunks: DataFrame, chunk_id: str) -> DataFrame:
    return chunks.where(F.col("id") == chunk_id).select("id", "file_id", "chunk_index", F.col("text_data").alias("text"))


def resolve(files: DataFrame, identifier: str) -> DataFrame:
    """One row (id, title) at most: the file of that id, else the first (by length of title, then id) whose title holds the identifier.

    ``%`` and ``_`` in the identifier are wildcards.
    """
    exact = F.col("id") == identifier
    like = F.col("title").ilike(f"%{identifier}%")
    tier = F.when(exact, 0).otherwise(1)
    return files.where(exact | like).orderBy(tier, F.char_length("title"), "id").limit(1).select("id", "title")


def of_strategy(files: DataFrame, strategy: str) -> DataFrame:
    return files.where(F.col("id").startswith(f"eval_{strategy}_"))


def delete_documents(files: DataFrame, chunks: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, chunks) without those of ``ids`` (id): children and parents alike; unknown ids change nothing."""
    gone = ids.select(F.col("id").alias("_gone")).distinct()
    return files.join(gone, files["id"] == gone["_gone"], "left_anti"), chunks.join(gone, chunks["file_id"] == gone["_gone"], "left_anti")


def cleanup_eval(files: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, chunks, removed ids) without the evaluation corpus."""
    gone = files.where(F.col("id").startswith("eval_")).select("id")
    return *delete_documents(files, chunks, gone), gone


def cited_but_missing(cited: DataFrame, chunks: DataFrame) -> DataFrame:
    """The cited chunk ids (column ``chunk_id``) that don't exist."""
    return cited.select("chunk_id").distinct().join(chunks.select(F.col("id").alias("chunk_id")), "chunk_id", "left_anti")


class Store:
    """Tables ``files``, ``doc_chunks``, ``files_removed`` and ``ingest_audit`` of a database.

    Each ingestion is a run of its own name and writes partitions that no other run writes: first its chunks, then its files.
    A file's row (id, run) is the commit mark: only that run's chunks of the file are read. What a crash between the writes
    leaves behind is never read. A text that two runs store at once counts once, by the lesser run. Deleting appends a row to ``files_removed``;
    ``vacuum`` takes the removed rows off the disk.
    """

    def __init__(self, spark: SparkSession, database: str = "lectern"):
        self.spark, self.database = spark, database

    def name(self, table: str) -> str:
        return f"{self.database}.{table}"

    def create_tables(self) -> None:
        """Create the tables that are missing; a vacuum that broke off while it put rows back is finished."""
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS {self.database}")
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name('files')} ({FILES}, run STRING) USING parquet PARTITIONED BY (run)")
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name('doc_chunks')} ({CHUNKS}, run STRING) USING parquet PARTITIONED BY (run)")
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name('files_removed')} (id STRING, run STRING) USING parquet")
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name('ingest_audit')} (batch STRING, status STRING, documents BIGINT, chunks BIGINT, seconds DOUBLE, error STRING, at TIMESTAMP) USING parquet")
        self._put_back()

    def wipe(self) -> None:
        for table in ("files", "doc_chunks", "files_removed", "ingest_audit", "files_kept", "doc_chunks_kept"):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name(table)}")
        self.create_tables()

    def ping(self) -> bool:
        return self.spark.sql("SELECT 1").first()[0] == 1

    def _table(self, table: str) -> DataFrame:
        """A table as it is now: a stream writes in a session of its own."""
        self.spark.catalog.refreshTable(self.name(table))
        return self.spark.table(self.name(table))

    def _committed(self) -> DataFrame:
        """Rows (file_id, run) of the files that are there; only these two columns are scanned."""
        every = self._table("files").select("id", "run").join(self._table("files_removed"), ["id", "run"], "left_anti")
        return every.groupBy(F.col("id").alias("file_id")).agg(F.min("run").alias("run"))

    def _present(self, table: str) -> DataFrame:
        """The rows of ``files`` or ``doc_chunks`` that count, with their run."""
        key = "id" if table == "files" else "file_id"
        return self._table(table).join(self._committed().withColumnRenamed("file_id", key), [key, "run"], "left_semi")

    def files(self) -> DataFrame:
        return self._present("files").select("id", "title", "extracted_text")

    def chunks(self) -> DataFrame:
        """The chunks of files that are there."""
        return self._present("doc_chunks").select("id", "file_id", "chunk_index", "text_data", "embeddings")

    def ingest(self, docs: DataFrame, batch: str, chunker) -> dict:
        """Insert the new ones of ``docs`` (title, text). ``chunker`` maps (file_id, text) to chunks. Returns counts.

        A batch that fails leaves no file; running it again, or another batch with the same texts, completes the work. ``batch``
        names the audit row only: batches of one name, of one stream or several, don't touch each other's rows.
        """
        import time
        import uuid

        began, run = time.time(), f"{batch}-{uuid.uuid4().hex}"
        try:
            full, _ = split_empty(docs)
            fresh = new_files(as_files(full), self.files())
            made = chunker(fresh.select(F.col("id").alias("file_id"), F.col("extracted_text").alias("text")))
            made.select(F.col("chunk_id").alias("id"), "file_id", "chunk_index", "text_data", "embeddings", F.lit(run).alias("run")).write.mode("append").insertInto(self.name("doc_chunks"))
            fresh.select("id", "title", "extracted_text", F.lit(run).alias("run")).write.mode("append").insertInto(self.name("files"))
            n_files, n_chunks = (self._table(t).where(F.col("run") == run).count() for t in ("files", "doc_chunks"))
            self._log(batch, "SUCCESS", n_files, n_chunks, time.time() - began, None)
            return {"documents": n_files, "chunks": n_chunks}
        except Exception as e:
            self._log(batch, "FAILURE", 0, 0, time.time() - began, str(e)[:500])
            raise

    def _log(self, batch: str, status: str, documents: int, chunks: int, seconds: float, error: str | None) -> None:
        row = self.spark.createDataFrame([(batch, status, documents, chunks, seconds, error)], "batch string, status string, documents long, chunks long, seconds double, error string")
        row.withColumn("at", F.current_timestamp()).write.mode("append").insertInto(self.name("ingest_audit"))

    def status(self, batch: str) -> DataFrame:
        return self._table("ingest_audit").where(F.col("batch") == batch)

    def delete(self, file_id: str) -> None:
        """Remove a file and its chunks, by one appended row for each run that stored it; an unknown id changes nothing."""
        stored = self._table("files").where(F.col("id") == file_id).select("id", "run")
        stored.join(self._table("files_removed"), ["id", "run"], "left_anti").write.mode("append").insertInto(self.name("files_removed"))

    def vacuum(self) -> None:
        """Write both tables anew without rows that don't count: removed files, chunks of runs that failed. Not beside other writers.

        What stays is first written to a table of its own, which exists only once it is whole, and then put back; a vacuum that
        broke off in between is finished by ``create_tables``.
        """
        for table in ("doc_chunks", "files"):
            kept = self.name(f"{table}_kept")
            self._present(table).select(*self._table(table).columns).write.saveAsTable(kept)
            self._put_back()

    def _put_back(self) -> None:
        mode = "spark.sql.sources.partitionOverwriteMode"
        before = self.spark.conf.get(mode)
        for table in ("doc_chunks", "files"):
            kept = self.name(f"{table}_kept")
            if self.spark.catalog.tableExists(kept):
                self.spark.conf.set(mode, "static")
                self.spark.table(kept).write.mode("overwrite").insertInto(self.name(table), overwrite=True)
                self.spark.conf.set(mode, before)
                self.spark.sql(f"DROP TABLE {kept}")
