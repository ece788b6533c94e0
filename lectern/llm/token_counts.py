"""Token counts from flat token files that have no index.

A token file holds little-endian 16- or 32-bit ids, each document's followed by an end-of-document id. The scan cuts the
files into blocks, finds the separators of a block with one vectorised comparison, and stitches the blocks of a file with
prefix scans (windows) over a number and a place for each block: the separators before a block give its first document's
number, the last of them where it began.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import bpe
from .common import materialize, open_fs, released, scratch, small_batches

BLOCK_TOKENS = 1 << 20


def width_for(path: str, eod: int) -> int:
    """The bytes of an id, 2 or 4, for a vocabulary and an end-of-document id, which must not be a token's."""
    n = len(bpe.read_ranks(path))
    if not n <= eod < 1 << 32:
        raise ValueError(f"the end-of-document id {eod} must lie beyond the {n} ids of the vocabulary, and below 2 ** 32")
    return 2 if eod < 1 << 16 else 4


def write_token_files(df: DataFrame, folder: str, path: str, pattern: str, eod: int, key_col: str, text_col: str) -> DataFrame:
    """Encode every whole text into one token file per input partition; rows (file, ordinal, key), written and read back.

    Null and empty texts are a lone separator. Each attempt at a task writes a file of its own and only files named in
    the returned rows count, so a lost or repeated task leaves nothing that is read. Other columns are not read.
    """
    kind = f"<u{width_for(path, eod)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        codec = bpe.load(path, pattern)
        fs, root = open_fs(folder)
        name, out, n = f"{root}/{uuid.uuid4().hex}.tokens", None, 0
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                out = out or fs.open_output_stream(name)
                for text in batch.column(1):
                    out.write(np.append(np.frombuffer(codec.encode(text.as_py() or ""), "<i4"), eod).astype(kind).tobytes())
                rows = batch.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([name] * rows), pa.array(range(n, n + rows), pa.int64()), batch.column(0)], names=["file", "ordinal", "key"])
                n += rows
        if out:
            out.close()

    fs, root = open_fs(folder)
    fs.create_dir(root, recursive=True)
    kind_of_key = df.select(key_col).schema[0].dataType.simpleString()
    return materialize(small_batches(df.select(key_col, text_col)).mapInArrow(released(run), f"file string, ordinal long, key {kind_of_key}"), "token-index")


def scan(files: DataFrame, folder: str, eod: int, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Rows (file, ordinal, start, n_tokens) for each document of the token files in column ``file``.

    Tokens after the last separator are a document too. An empty file has none. Repeated file names count once.
    """
    wide = 2 if eod < 1 << 16 else 4

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = open_fs(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                n = fs.get_file_info(name).size // wide
                starts = list(range(0, n, block_tokens))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(starts), pa.string()), pa.array(starts, pa.int64()), pa.array([n] * len(starts), pa.int64())], names=["file", "at", "size"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = open_fs(folder)
        for batch in batches:
            for name, at, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with fs.open_input_file(name) as f:
                    f.seek(at * wide)
                    ids = np.frombuffer(f.read(min(block_tokens, size - at) * wide), f"<u{wide}")
                ends = np.flatnonzero(ids == eod) + at
                if at + len(ids) == size and ids[-1] != eod:
                    ends = np.append(ends, size)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([at], pa.int64()), pa.array([ends], pa.list_(pa.int64()))], names=["file", "at", "ends"])

    blocks = files.select("file").distinct().mapInArrow(cut, "file string, at long, size long")
    found = materialize(blocks.repartition("file", "at").mapInArrow(search, "file string, at long, ends array<long>"), "ends")
    before = W.partitionBy("file").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    # A file of any size is one task here, of two numbers a block; the places of the separators stay where they are.
    each_block = found.select("file", "at", F.size("ends").alias("n"), F.when(F.size("ends") > 0, F.element_at("ends", -1)).alias("last"))
    scanned = each_block.select(
        "file", "at",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"),
        (F.coalesce(F.last("last", True).over(before), F.lit(-1)) + 1).alias("begin"),
    )
    stitched = found.join(scanned, ["file", "at"])
    each = stitched.select("file", "first", "begin", "ends", F.posexplode("ends").alias("i", "end"))
    start = F.when(F.col("i") == 0, F.col("begin")).otherwise(F.get("ends", F.col("i") - 1) + 1)
    return each.select("file", (F.col("first") + F.col("i")).alias("ordinal"), start.alias("start"), (F.col("end") - start).alias("n_tokens"))


def count_tokens(df: DataFrame, path: str, pattern: str, eod: int, key_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Rows (key, n_tokens, ...) for each row of ``df``: texts are written as token files and their separators counted.

    Null and empty texts have no tokens; repeated rows are counted each; null keys stay null; an empty table gives an empty one.
    """
    folder = scratch(df.sparkSession, "tokens")
    index = write_token_files(df, folder, path, pattern, eod, key_col, text_col)
    counts = scan(index, folder, eod, block_tokens)
    # Both sides have a row for each document, however small the index's file is: no broadcast.
    return index.hint("merge").join(counts, ["file", "ordinal"]).select("key", "file", "ordinal", "start", "n_tokens")
