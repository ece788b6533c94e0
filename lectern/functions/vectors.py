"""Vector functions over ``array<float>`` or ``array<double>`` columns, computed in double precision."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a vector is zero."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine as a vector database has it; NaN where a vector is zero, null where one is null."""
    similarity = F.try_divide(dot(a, b), norm(a) * norm(b))
    return F.when(a.isNotNull() & b.isNotNull(), 1.0 - F.coalesce(similarity, F.lit(float("nan"))))


def rounded(value: Column, digits: int) -> Column:
    """``value`` to so many digits as SQL engines round doubles: the scaled binary number, halves away from zero.

    Unlike Spark's ``round``, which goes through decimals, small negative numbers give -0.0.
    """
    scaled_up = value * 10.0**digits
    even = F.rint(scaled_up)
    return (even + F.when(F.abs(scaled_up) - F.abs(even) == 0.5, F.signum(scaled_up)).otherwise(F.lit(-0.0))) / 10.0**digits


def l2_normalize(a: Column) -> Column:
    """The vector at unit length; a zero vector stays."""
    return scaled(a, norm(a))


def scaled(a: Column, length: Column) -> Column:
    """The vector divided by a length, 0 counting as 1.

    The length is an argument beside the vector, not inside the lambda, where it would be computed for each element.
    """
    return F.zip_with(a, F.array_repeat(length, F.size(a)), lambda x, n: x.cast("double") / F.when(n == 0, 1.0).otherwise(n))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") + y.cast("double"))


def mean_pool(df: DataFrame, keys: list[str], vector: str, out: str = "pooled") -> DataFrame:
    """Rows (keys, out): the element-wise mean of each group's vectors; null vectors are passed over.

    Sums of each element are combined before the shuffle, so a large group is not gathered.
    """
    each = df.select(*keys, F.posexplode(vector).alias("_d", "_x"))
    means = each.groupBy(*keys, "_d").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    ordered = F.array_sort(F.collect_list(F.struct("_d", "_m")))
    return means.groupBy(*keys).agg(F.transform(ordered, lambda p: p["_m"]).alias(out))


MATRIX_ROWS = 1024  # of a tile, on each side, on average
CELLS = 1 << 16  # similarities that are made at a time


def _matrix(vectors: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(elements as doubles, behind the end 0; lengths, -1 for a null vector and one with nulls) of an array of vectors."""
    flat, length = vectors.flatten(), np.where(vectors.is_valid(), vectors.value_lengths().fill_null(0), 0)
    values = flat.to_numpy(zero_copy_only=False).astype(float)
    row, width = np.repeat(np.arange(len(length)), length), int(length.max(initial=0))
    out = np.zeros((len(length), width))
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)] = values
    return out, np.where(vectors.is_valid() & (np.bincount(row[np.asarray(flat.is_null())], minlength=len(length)) == 0), length, -1)


def _similarities(left: pa.ListArray, right: pa.ListArray, digits: int | None) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, similarities) of blocks of rows of ``left``; sums run from the first element to the last, as SQL's do."""
    (a, size_a), (b, size_b) = _matrix(left), _matrix(right)
    width = min(a.shape[1], b.shape[1])
    norm_a, norm_b = ((np.cumsum(x * x, 1)[:, -1] if x.shape[1] else np.zeros(len(x))) for x in (a, b))
    lengths = np.r_[norm_a, norm_b]
    lengths = lengths[lengths > 0]
    within = not len(lengths) or (1e-150 < lengths.min() and lengths.max() < 1e150)  # products stay normal numbers
    columns, step = np.ascontiguousarray(b.T), max(1, CELLS // max(1, len(b)))
    for at in range(0, len(a), step):
        block, n = a[at : at + step], norm_a[at : at + step, None]
        out = np.zeros((len(block), len(b)))
        for d in range(width):
            out += block[:, d, None] * columns[d]
        length = np.sqrt(n * norm_b) if within else np.sqrt(n) * np.sqrt(norm_b)
        own = size_a[at : at + step, None]
        out = np.where((own == size_b) & (own >= 0) & (length != 0), np.clip(out / length, -1.0, 1.0), 0.0)
        if digits is not None:
            up = np.abs(out) * 10.0**digits
            whole = np.trunc(up)
            out = np.copysign(whole + (up - whole >= 0.5), out) / 10.0**digits  # as ``rounded``
        yield at, out


def similarity_matrix(df: DataFrame, group: str, key: str, vector: str, digits: int | None = None) -> DataFrame:
    """Rows (group, key_a, key_b, similarity) for all pairs within each group, as a matrix is asked for; zero and null vectors give 0.

    A group's matrix is made in tiles of some MATRIX_ROWS rows and columns, so that a large group is many tasks, and in Arrow
    batches of CELLS pairs: a vector is sent once for each tile of its row and its column, not for each pair.
    ``digits``: what similarities are rounded to.
    """
    spark = df.sparkSession
    strips = df.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / MATRIX_ROWS).cast("int").alias("_n"))
    rows = df.select(group, F.col(key).alias("_key"), F.col(vector).alias("_vector")).join(strips, group)
    own, each = F.pmod(F.xxhash64("_key", "_vector"), "_n").cast("int"), F.sequence(F.lit(0), F.col("_n") - 1)
    tile = lambda a, b, side: F.struct(a.alias("a"), b.alias("b"), F.lit(side).alias("right"))
    tiles = F.concat(F.transform(each, lambda i: tile(own, i, False)), F.transform(each, lambda i: tile(i, own, True)))
    dealt = rows.select(group, F.explode(tiles).alias("_t"), "_key", "_vector").select(group, "_t.*", "_key", "_vector")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    # A fixed number: the output is larger than the input by far, so small partitions must not be put together.
    dealt = dealt.repartition(n, group, "a", "b").sortWithinPartitions(group, "a", "b")
    kinds = dealt.schema
    schema = T.StructType([kinds[0], T.StructField("key_a", kinds[4].dataType), T.StructField("key_b", kinds[4].dataType), T.StructField("similarity", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None  # the last tile may go on in the next batch
        for batch in batches:
            there = pa.Table.from_batches([batch])
            rest = (pa.concat_tables([rest, there]) if rest else there).combine_chunks()
            if not rest.num_rows:
                continue
            marks = [rest.column(0).combine_chunks().dictionary_encode().indices.to_numpy(), *(rest.column(i).to_numpy() for i in (1, 2))]
            edges = np.flatnonzero(np.any([np.diff(m) != 0 for m in marks], axis=0)) + 1
            for start, end in zip(np.r_[0, edges[:-1]], edges, strict=False):
                yield from solve(rest.slice(start, end - start))
            rest = rest.slice(edges[-1]) if len(edges) else rest
        if rest:
            yield from solve(rest)

    def solve(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        right = rows.column(3).to_numpy()
        one, other = (rows.take(np.flatnonzero(side)).combine_chunks() for side in (~right, right))
        if not (one.num_rows and other.num_rows):
            return
        names, a, b = one.column(0).chunk(0), one.column(4).chunk(0), other.column(4).chunk(0)
        with np.errstate(all="ignore"):
            for at, part in _similarities(one.column(5).chunk(0), other.column(5).chunk(0), digits):
                i, j = np.divmod(np.arange(part.size), part.shape[1])
                yield pa.RecordBatch.from_arrays([names.take(pa.array(np.zeros(part.size, int))), a.take(pa.array(i + at)), b.take(pa.array(j)), pa.array(part.ravel())], names=schema.names)

    return dealt.mapInArrow(run, schema)
