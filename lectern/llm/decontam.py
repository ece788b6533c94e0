"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

A mask ignores some places of a stretch of words; the hash of the others is a seed. The masks of a family, laid at every place
of the benchmark items, meet every window that has enough equal words (``complete`` proves it), so nothing is lost. The items'
seeds meet those of the training texts; around each hit the item and the text are laid side by side, and all windows of
the item that contain the hit are verified: a window counts if enough of its words stand at the same places of the text.
"""

from __future__ import annotations

from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

# Families of masks; a mask looks at the words marked 1. Items take the first family that is complete for their windows.
FAMILIES = (("11011",), ("11101", "100111"), ("1101", "1011"), ("101",), ("11",), ("1",))
WINDOW = 24
MIN_SHARE = 0.8
SEGMENT = 2048
BROADCAST_SEEDS = 200_000
BLOOM_SLOTS = 1 << 21  # of each of two tables, at most some 50 MB as a broadcast


def word_hashes(text: Column) -> Column:
    """The 64-bit hashes of a text's words (runs of letters and digits, in lower case)."""
    return F.transform(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1), lambda w: w != ""), lambda w: F.xxhash64(w))


def need_words(size: int, min_share: float) -> int:
    """The least number of equal words in a window of ``size`` words."""
    return next((m for m in range(size) if m / size >= min_share), size)


def complete(masks: tuple[str, ...], size: int, changed: int) -> bool:
    """Whether every window of ``size`` words, ``changed`` of them at most not equal, has a place where a mask sees equal words only.

    Goes through the places with the least number of changes for each pattern of the last words that has met no mask.
    """
    last = (1 << max(map(len, masks))) - 1
    sees = [(len(m), int(m, 2)) for m in masks]
    least = {0: 0}
    for n in range(1, size + 1):
        after: dict[int, int] = {}
        for seen, k in least.items():
            for equal in (0, 1):
                now, cost = (seen << 1 | equal) & last, k + 1 - equal
                if cost <= changed and not any(n >= length and now & m == m for length, m in sees):
                    after[now] = min(cost, after.get(now, cost))
        least = after
    return not least


@lru_cache
def family_for(size: int, min_share: float) -> int:
    """The number of the first complete family for windows of ``size`` words."""
    changed = size - need_words(size, min_share)
    return next((f for f, masks in enumerate(FAMILIES) if complete(masks, size, changed)), len(FAMILIES) - 1)


def _segments(df: DataFrame, h: str, window: int, span: int) -> DataFrame:
    """Cut the hashes in ``h`` into rows of at most SEGMENT places each, so that long texts make small rows.

    ``part`` also has the words around a segment that its places need, ``low`` is where it begins in the text and ``skip``
    the number of its words before the segment.
    """
    start = F.sequence(F.lit(0), F.size(h) - 1, F.lit(SEGMENT))

    def cut(at: Column) -> Column:
        low = F.greatest(F.lit(0), at - window)
        return F.struct(low.alias("low"), (at - low).alias("skip"), F.slice(h, low + 1, at - low + SEGMENT + window + span).alias("part"))

    return df.where(F.size(h) > 0).withColumn("_c", F.explode(F.transform(start, cut))).select(*[c for c in df.columns if c != h], "_c.*")


def _seed(h: str, at: Column, mask: str) -> Column:
    """The hash of the mask and of the words that it sees when it is laid at place ``at``."""
    return F.xxhash64(F.lit(mask), *[F.get(h, at + i) for i, bit in enumerate(mask) if bit == "1"])


def _folds(key: Column) -> list[tuple[str, Column]]:
    return [("_f0", F.pmod(key, F.lit(BLOOM_SLOTS))), ("_f1", F.pmod(F.shiftright(key, 32), F.lit(BLOOM_SLOTS)))]


def _met(texts: DataFrame, seeds: DataFrame, masks: list[str], window: int, small: bool) -> DataFrame:
    """Rows (_doc, _text, key, at, first, around): the words about each place of a text where a mask gives one of the seeds' keys.

    This is the only step that touches every word: one generated loop with a look-up for each mask in use. Seeds that are too
    many for a broadcast are first met through two tables of BLOOM_SLOTS slots, so that only likely places are shuffled.
    """
    span = max(map(len, masks), default=1)
    rows = _segments(texts, "_h", window, span)
    last = F.least(F.col("skip") + SEGMENT, F.size("part") - min(map(len, masks), default=1) + 1) - 1
    every = rows.where(last >= F.col("skip")).select("_doc", "_text", "low", "part", F.explode(F.sequence("skip", last)).alias("i"))
    keys = [_seed("part", F.col("i"), m) for m in masks] or [F.lit(None).cast("long")]
    every = every.withColumn("key", keys[0]) if len(keys) == 1 else every.withColumn("key", F.explode(F.array(*keys)))
    known = seeds.select("key").distinct()
    if small:
        met = every.join(F.broadcast(known), "key", "left_semi")
    else:
        likely = every.select("_doc", "_text", "low", "i", "key")
        for name, slot in _folds(F.col("key")):
            likely = likely.withColumn(name, slot).join(F.broadcast(known.select(slot.alias(name)).distinct()), name, "left_semi").drop(name)
        likely = likely.distinct().join(known, "key", "left_semi")
        likely = likely.select(F.col("_doc").alias("_d"), F.col("_text").alias("_t"), F.col("low").alias("_l"), "i", "key")
        met = rows.join(likely, F.col("_doc").eqNullSafe(F.col("_d")) & (F.col("_text") == F.col("_t")) & (F.col("low") == F.col("_l")))
    first = F.greatest(F.lit(0), F.col("i") - window)
    # The identity keeps this projection out of the generated loop above.
    around = F.transform(F.slice("part", first + 1, F.lit(2 * window + span)), lambda x: x)
    return met.select("_doc", "_text", "key", (F.col("low") + F.col("i")).alias("at"), (F.col("low") + first).alias("first"), around.alias("around"))


def find_overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_key: str = "doc_id",
    doc_text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    min_share: float = MIN_SHARE,
) -> DataFrame:
    """Rows (doc key, item key, n_windows, overlap_words, overlap_share, doc_word) for each pair with a verified overlap.

    An overlap is a window of ``window`` words of an item (all of a shorter item) of which at least ``min_share`` stand in the
    text at the same relative places. ``n_windows`` counts all such windows of the pair; the other columns tell of the best one,
    ties by the first place. Substituted words are allowed, inserted or left out ones shift the places behind them; every
    overlap is found (with the families here, for any window that FAMILIES[-2] or an earlier one is complete for, or of one word equal).
    Null and empty texts and items have no words and no overlaps; rows that share a key are one document and equal rows
    count once, and so it is with items. Null keys are keys like others. Other columns are not read.

    Texts are not shuffled while the seeds number at most BROADCAST_SEEDS (they are counted first and broadcast); beyond that, the
    likely places and the keys meet in a shuffled join and their texts are joined again, with the same result.
    """
    items = benchmark.select(F.col(item_key).alias("_item"), word_hashes(F.col(item_text)).alias("_words")).where(F.size("_words") > 0).distinct()
    items = items.withColumn("_n", F.size("_words")).withColumn("_i", F.xxhash64("_words")).withColumn("_size", F.least("_n", F.lit(window)))
    items = materialize(items, "items")
    families: dict[int, list[int]] = {}
    for (size,) in items.select("_size").distinct().collect():  # at most ``window`` rows
        families.setdefault(family_for(size, min_share), []).append(size)
    masks = sorted({m for f in families for m in FAMILIES[f]})
    span = max(map(len, masks), default=1)
    laid = [_laid(items.where(F.col("_size").isin(sizes)), m, window, span) for f, sizes in sorted(families.items()) for m in FAMILIES[f]]
    seeds = materialize(reduce(DataFrame.unionByName, laid or [_laid(items, "1", window, span)]), "seeds")
    discard(items)
    small = seeds.count() <= BROADCAST_SEEDS
    texts = docs.select(F.col(doc_key).alias("_doc"), word_hashes(F.col(doc_text)).alias("_h")).withColumn("_text", F.xxhash64("_h"))
    met = _met(texts, seeds, masks, window, small).join(F.broadcast(seeds) if small else seeds, "key").withColumn("_shift", F.col("at") - F.col("_at"))
    behind = F.col("_begin") + F.col("_shift") - F.col("first")
    same = F.transform("_beside", lambda a, j: F.when(a == F.get("around", behind + j), 1).otherwise(0))
    met = met.select("_doc", "_text", "_item", "_i", "_n", "_size", "_at", "_begin", "_mask", "_shift", same.alias("_same"))
    met = met.where(F.aggregate("_same", F.lit(0), lambda s, x: s + x) / F.col("_size") >= min_share)
    # Where the same mask meets at the place before, too, that hit has all windows but the one that begins here.
    before = F.col("_at") - F.col("_begin") - 1
    again = reduce(Column.__and__, [(F.substring("_mask", i + 1, F.lit(1)) != "1") | (F.coalesce(F.get("_same", before + i), F.lit(0)) == 1) for i in range(span)], before >= 0)
    low, high = F.when(again, F.col("_at")).otherwise(F.col("_begin")), F.least(F.col("_at"), F.col("_n") - F.col("_size"))
    words = lambda b: F.aggregate(F.slice("_same", b - F.col("_begin") + 1, F.col("_size")), F.lit(0), lambda s, x: s + x)
    each = F.transform(F.sequence(low, high), lambda b: F.struct(b.alias("begin"), words(b).alias("words")))
    found = met.where(low <= high).select("_doc", "_text", "_item", "_i", "_size", "_shift", F.explode(F.filter(each, lambda x: x["words"] / F.col("_size") >= min_share)).alias("w"))
    found = found.select("_doc", "_text", "_item", "_i", "_size", "_shift", "w.begin", "w.words").distinct()
    best = F.struct((F.col("words") / F.col("_size")).alias("share"), F.col("words").alias("words"), (-F.greatest(F.lit(0), F.col("begin") + F.col("_shift"))).alias("place"))
    pairs = found.groupBy("_doc", "_item").agg(F.count(F.lit(1)).alias("n_windows"), F.max(best).alias("b"))
    return pairs.select(
        F.col("_doc").alias(doc_key), F.col("_item").alias(item_key), "n_windows",
        F.col("b.words").cast("long").alias("overlap_words"), F.col("b.share").alias("overlap_share"), (-F.col("b.place")).cast("long").alias("doc_word"),
    )


def _laid(items: DataFrame, mask: str, window: int, span: int) -> DataFrame:
    """Rows (_item, _i, _n, _size, _at, _begin, _beside, _mask, key): a mask at every place of the items, with all windows that contain it."""
    parts = _segments(items, "_words", window, span)
    last = F.least(F.col("skip") + SEGMENT - 1, F.col("_n") - len(mask) - F.col("low"))
    laid = parts.where(last >= F.col("skip")).withColumn("i", F.explode(F.sequence("skip", last))).withColumn("_at", F.col("low") + F.col("i"))
    laid = laid.withColumn("_begin", F.greatest(F.lit(0), F.col("_at") + len(mask) - F.col("_size")))
    beside = F.slice("part", F.col("_begin") - F.col("low") + 1, F.least(F.col("_n"), F.col("_at") + F.col("_size")) - F.col("_begin"))
    return laid.select("_item", "_i", "_n", "_size", "_at", "_begin", beside.alias("_beside"), F.lit(mask).alias("_mask"), _seed("part", F.col("i"), mask).alias("key"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, doc_key: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the rows whose key has an overlap with a benchmark item; see ``find_overlaps``.

    Rows without a key are one document, so all of them go if one has an overlap; null and empty texts alone have none.
    Rows that repeat go or stay together, and columns of any names pass through.
    """
    bad = materialize(find_overlaps(docs, benchmark, doc_key, **options).select(F.col(doc_key).alias("_bad")).distinct(), "contaminated")
    return docs.join(bad, docs[doc_key].eqNullSafe(bad["_bad"]), "left_anti")
