"""A corpus-cleaning pipeline over ``documents``: reject poor texts, cut boilerplate lines, keep one of each group of near
duplicates, drop documents that hold benchmark passages, and encode what is left.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from lectern.llm import bpe, decontam, jaccard, lines, quality
from lectern.llm.common import discard, discard_paths, materialize, unused, watched

QUALITY = 0.3
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose quality score is at least QUALITY, by a classifier learnt from the labelled documents of ``docs``.

    Without labels of both classes every score is 0.5 and all rows stay; an empty text is scored as any other.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    stats = materialize(quality.with_statistics(docs.select("doc_id", "text")).drop("text"), "stats")
    model = quality.train(stats, labels)
    (score,) = unused(docs, "score")
    scored = quality.score_texts(docs, model, "text", score)
    return scored.where(F.col(score) >= QUALITY).select(*docs.columns)


def cut_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the lines that are boilerplate on their source; ``n_chars`` is counted again."""
    cut = lines.drop_boilerplate(docs, "source", "text", counts=False)
    return cut.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of the least doc_id of each near-duplicate class.

    Of repeated rows (equal doc_id and text) one stays. Rows that share a doc_id but not the text stand or fall together, by
    the better of them; rows without a doc_id, and texts without words, stay.
    """
    found = materialize(jaccard.near_duplicates(docs.select("doc_id", "text")).where("doc_id IS NOT NULL"), "classes")
    kept = found.where("doc_id = class_id").select("doc_id").distinct()
    gone = materialize(found.where("doc_id <> class_id").select("doc_id").distinct().join(kept, "doc_id", "left_anti"), "copies")
    few = gone.count() <= jaccard.BROADCAST_ROWS
    rest = docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(*docs.columns)
    repeated = not found.groupBy("doc_id").count().where("count > 1").isEmpty()
    if not repeated:
        return rest
    return rest.where("doc_id IS NOT NULL").dropDuplicates(["doc_id", "text"]).unionByName(rest.where("doc_id IS NULL"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows without a verified overlap with a benchmark item; see ``decontam.drop_contaminated``.

    Null and empty texts have no overlap; rows that share a doc_id (or have none) go together; other columns pass through.
    """
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows (doc_id, lang, source, n_tokens, ids, decoded_sha256): the token ids, and the digest of the text they decode to.

    One for each row, repeated ones too; null and empty texts have no ids and the digest of nothing; other columns are not read.
    """
    both = bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), RANKS, public_tokenizers.PATTERN)
    return both.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", cut_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("byte-level BPE", encode),
]

# Minhash classes and BPE have no SQL form; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``; each stage's rows are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        with watched() as made:
            rows = stage(spark, docs, sf_dir)
        docs = materialize(rows, "stage-" + name.replace(" ", "-"))
        # Nothing reads the stage's own tables any more, nor those of the stage before.
        discard_paths(spark, made)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
