"""Chunks: rendering of blocks, merging of small ones, and the whole pipeline from text to embedded chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.config import DEFAULT, Settings
from lectern.functions import text as TX
from lectern.functions.embedding import Provider, with_embedding
from lectern.functions.tokens import count_for, windows_for
from lectern.operators.boundary import greedy_flush, window_bounds
from lectern.operators.structure import blocks

PROSE = ["PARAGRAPH", "LIST_ITEM"]


def render(path: Column, body: Column, node_type: str) -> Column:
    """A chunk's text: its heading path, then its content; without headings just the content."""
    label = {"LIST": "\nContent:\n", "TABLE": "\nTable Data:\n"}.get(node_type, "\nContent: ")
    return F.when(F.size(path) > 0, F.concat(F.lit("Context: "), F.array_join(path, " > "), F.lit(label), body)).otherwise(body)


def sentences_of(blocks_df: DataFrame, key: str = "file_id") -> DataFrame:
    """Rows (key, block, idx, sentence) of the prose blocks."""
    prose = blocks_df.where(F.col("node_type").isin(PROSE))
    # Outer, as Spark tests the array of an inner explode in a filter of its own and so makes it twice.
    return prose.select(key, "block", F.posexplode_outer(TX.sentences(F.col("text"))).alias("idx", "sentence")).where("idx IS NOT NULL")


def merge_undersized(chunks: DataFrame, key: str, order: list[str], min_words: int = 50) -> DataFrame:
    """Fold prose chunks of fewer than ``min_words`` words of content into the prose chunk before them.

    Needs columns node_type, text, embeddings; the first chunk's other columns stay. A chunk folds whenever the one before
    it is prose, as what that one was folded into is prose too, so runs are gaps and islands and need no fold. A merged
    chunk's vector becomes null. ``n_merged`` counts the chunks in a row.
    """
    rank = W.partitionBy(key).orderBy(*order)
    prose = F.col("node_type").isin(PROSE)
    content = TX.strip_context(F.col("text"))
    folds = prose & F.coalesce(F.lag(prose).over(rank), F.lit(False)) & (TX.word_count(content) < min_words)
    marked = chunks.withColumn("_at", F.row_number().over(rank)).withColumn("_new", F.when(folds, 0).otherwise(1)).withColumn("_content", content)
    numbered = marked.withColumn("_run", F.sum("_new").over(rank.rowsBetween(W.unboundedPreceding, W.currentRow)))
    rows = F.array_sort(F.collect_list(F.struct("_at", F.when(F.col("_new") == 1, F.col("text")).otherwise(F.col("_content")).alias("t"))))
    others = [c for c in chunks.columns if c not in (key, "text", "embeddings")]
    grouped = numbered.groupBy(key, "_run").agg(
        F.array_join(F.transform(rows, lambda r: r["t"]), " ").alias("text"),
        F.count(F.lit(1)).alias("n_merged"),
        *[F.min_by(c, "_at").alias(c) for c in others],
        F.min_by("embeddings", "_at").alias("_e"),
    )
    return grouped.withColumn("embeddings", F.when(F.col("n_merged") == 1, F.col("_e"))).drop("_e", "_run")


def chunk_documents(docs: DataFrame, s: Settings = DEFAULT, provider: Provider | None = None, key: str = "file_id", text_col: str = "text") -> DataFrame:
    """Rows (key, chunk_id, chunk_index, node_type, structural_path, line_number, row_count, token_count, text_data, embeddings).

    Blocks; sentences of prose, embedded; topic boundaries; pieces cut to token windows; heading paths in front; small prose
    chunks merged; vectors of the texts (``hybrid``) or means of the sentence vectors (``vector_math``, texts where there are
    none). A heading without content gives no chunk, a table is never cut. Empty and null texts give no chunks.
    """
    provider = provider or Provider("hashing", dim=s.dim)
    pooled = s.chunk_embedding_strategy == "vector_math"
    found = blocks(docs.where(F.col(text_col).isNotNull()), key, text_col).withColumnRenamed("path", "structural_path")
    prose = F.col("node_type").isin(PROSE)
    # All kinds of blocks go one way, a list or table as a single sentence without a vector, and carry what is known of them.
    block = [key, "block", "node_type", "structural_path", "line_number", "row_count"]
    units = F.when(prose, TX.sentences(F.col("text"))).otherwise(F.array("text"))
    spoken = found.where("node_type <> 'HEADING'").select(*block, F.posexplode_outer(units).alias("idx", "sentence")).where("idx IS NOT NULL")
    spoken = with_embedding(spoken.withColumn("_said", F.when(prose, F.col("sentence"))), [*block, "idx"], "_said", provider, "embedding").drop("_said")
    flagged = window_bounds(spoken, block, window=s.window_size, factor=s.threshold_factor)
    pieces = greedy_flush(flagged, block, min_sentences=s.min_sentences, min_words=s.min_words, vector="embedding" if pooled else None)
    if not s.keep_remainder:
        pieces = pieces.where(~prose | (F.col("n_sentences") >= s.min_sentences) | (F.col("n_words") >= s.min_words))
    vector = F.when(prose, F.col("pooled")) if pooled else F.lit(None).cast("array<double>")
    whole = F.col("node_type") == "TABLE"
    cut = pieces.withColumn("_cut", F.when(whole, F.array("text")).otherwise(windows_for(F.col("text"), s)))
    every = cut.select(*block, "piece", vector.alias("embeddings"), F.posexplode_outer("_cut").alias("sub", "body")).where("sub IS NOT NULL")
    path, body, kind = F.col("structural_path"), F.col("body"), F.col("node_type")
    text = F.when(kind == "TABLE", render(path, body, "TABLE")).when(kind == "LIST", render(path, body, "LIST")).otherwise(render(path, body, "PARAGRAPH"))
    merged = merge_undersized(every.withColumn("text", text).withColumn("token_count", F.when(~whole, count_for(body, s))).drop("body"), key, ["block", "piece", "sub"], s.min_words)
    merged = merged.withColumn("token_count", F.when(F.col("n_merged") > 1, count_for(F.col("text"), s)).otherwise(F.col("token_count")))
    index = (F.row_number().over(W.partitionBy(key).orderBy("block", "piece", "sub")) - 1).cast("long")
    chunks = merged.withColumn("chunk_index", index).withColumn("chunk_id", TX.chunk_id(F.col(key), F.col("chunk_index"))).withColumnRenamed("embeddings", "_pooled")
    # Only texts without a pooled vector go to the model.
    ready = with_embedding(chunks.withColumn("_said", F.when(F.col("_pooled").isNull(), F.col("text"))), [key, "chunk_index"], "_said", provider)
    ready = ready.withColumn("embeddings", F.coalesce("_pooled", "embeddings"))
    return ready.select(key, "chunk_id", "chunk_index", "node_type", "structural_path", "line_number", "row_count", "token_count", F.col("text").alias("text_data"), "embeddings")


def baseline_chunks(docs: DataFrame, s: Settings = DEFAULT, key: str = "file_id", text_col: str = "text") -> DataFrame:
    """Rows (key, chunk_index, text_data): token windows over the whole text, without structure."""
    return docs.select(key, windows_for(F.col(text_col), s).alias("_cut")).select(key, F.posexplode_outer("_cut").alias("chunk_index", "text_data")).where("chunk_index IS NOT NULL")
