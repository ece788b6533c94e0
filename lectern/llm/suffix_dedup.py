"""Removal of long repeated byte strings by merging shard Burrows-Wheeler transforms.

A byte goes if a string of LENGTH bytes that covers it also starts elsewhere. Only suffixes that can begin such a string
are ordered: texts are winnowed (the least hash of the GRAM-byte strings in each LENGTH-byte window is an anchor), so two
equal LENGTH-byte strings have an anchor with the same hash at the same place. Anchors whose hash occurs once are
dropped; the others' surroundings, of all shards, meet by hash.

There, the surroundings come in shards. A shard's transform is built once, as its surroundings arrive: for each place the
symbols before the shard's suffixes, in the order of these suffixes. The transforms are then merged as by Holt and McMillan: the
interleaving tells which shard each suffix of the merged order is of, a step takes the next symbol of that shard's transform
for each, and deals the interleaving stably by the symbols. Order by longer and longer prefixes follows without comparing or
sorting suffixes of the whole again. The common prefix of two that become neighbours is one more than the least one between
their former places; runs of suffixes whose common prefixes reach LENGTH are the repeated intervals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, released, small_batches

LENGTH = 400
GRAM = 128
SHARD = 8192  # surroundings that a shard's transform is built of
CAP = 50_000  # suffix groups up to this size are merged in one task; larger ones are counted window by window
STEP = 1 << 20  # windows of a text that are winnowed at a time
DENSE = 64  # a text with an anchor for fewer bytes than this first drops windows it repeats itself
BROADCAST_ROWS = 200_000
BROADCAST_ITEMS = 1_500_000  # of about 45 bytes: 70 MB at most

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]


def _powers(base: np.uint64, n: int) -> np.uint64:
    out = 1
    for _ in range(n):
        out = out * int(base) & 0xFFFFFFFFFFFFFFFF
    return np.uint64(out)


def window_hashes(raw: np.ndarray, n: int, base: np.uint64) -> np.ndarray:
    """Polynomial hashes of all ``n``-byte strings of ``raw``: from those of a string's halves, by the bits of ``n``."""
    part, size = raw.astype(np.uint64) + np.uint64(1), 1  # hashes of the strings of ``size`` bytes
    out, done = np.zeros(len(raw) + 1, np.uint64), 0
    while True:
        if n & size:
            keep = len(raw) - done - size + 1
            out, done = out[:keep] * _powers(base, size) + part[done : done + keep], done + size
        if done == n:
            return out[: len(raw) - n + 1]
        part = part[: len(part) - size] * _powers(base, size) + part[size:]
        size *= 2


def _sliding_min(values: np.ndarray, n: int) -> np.ndarray:
    size, out = 1, values
    while size * 2 <= n:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[: len(values) - n + 1], out[n - size : len(values) - size + 1])


def anchors(raw: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, places) of a text's anchors, and the places of windows that the text itself repeats (see DENSE).

    The first of the least hashes in a window counts; ties are settled by the place, hence alike in equal windows.
    """
    n = len(raw) - length + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int64)
    width, low = length - gram + 1, np.uint64((1 << 31) - 1)
    own = np.empty(0, np.int64)
    fresh = None

    def winnow(fresh: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        hashes, places = [], []
        for start in range(0, n, STEP):
            piece = raw[start : start + STEP + length - 1]
            h = window_hashes(piece, gram, _ODD[0])
            h = (h ^ (h >> np.uint64(29))) * _ODD[1]
            ranked = h & ~low | np.arange(len(h), dtype=np.uint64)
            least = (_sliding_min(ranked, width) & low).astype(np.int64)
            if fresh is not None:
                least = least[fresh[start : start + STEP]]
            at = np.unique(least)
            hashes.append(h[at].view(np.int64))
            places.append(at + start)
        places = np.concatenate(places)
        places, first = np.unique(places, return_index=True)
        return np.concatenate(hashes)[first], places

    hashes, places = winnow(None)
    if len(places) > len(raw) / DENSE and len(raw) > length:
        a, b = (window_hashes(raw, length, base) for base in _ODD)
        order = np.lexsort((b, a))
        same = (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])
        fresh = np.ones(n, bool)
        fresh[order[1:][same]] = False  # lexsort is stable: the first of equal windows stays
        own = np.unique(np.r_[order[1:][same], order[:-1][same]])
        hashes, places = winnow(fresh)
    return hashes, places.astype(np.int32), own


def cover(starts: np.ndarray, length: int = LENGTH) -> list[tuple[int, int]]:
    """The maximal runs of bytes in strings that begin at the sorted ``starts``."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > length)
    return list(zip(starts[np.r_[0, cut + 1]].tolist(), (starts[np.r_[cut, len(starts) - 1]] + length).tolist(), strict=True))


def _dealt(groups: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """The places in stable order of (group, symbol), by two counting sorts; ``groups`` are numbers from 0."""
    by_symbol = np.argsort(symbols, kind="stable")
    narrow = groups.astype(np.uint16) if len(groups) and groups.max() < 1 << 16 else groups
    return by_symbol[np.argsort(narrow[by_symbol], kind="stable")]


def transform(groups: np.ndarray, left: np.ndarray, texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """A shard's transform, a row for each place of the surroundings: the symbols there (byte plus one, 0: outside the text).

    ``groups``: sorted group numbers, ``left``: bytes before the anchor. A row's symbols stand in the order of the suffixes that
    begin behind the place, those of each group in its part.
    """
    m, before = len(texts), length - gram
    wide = before + length
    table = np.zeros((m, wide), np.uint16)
    size = np.array([len(t) for t in texts])
    flat = np.frombuffer(b"".join(texts), np.uint8)
    row = np.repeat(np.arange(m), size)
    table[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size) + (before - left)[row]] = flat.astype(np.uint16) + 1
    out = np.ascontiguousarray(table.T)
    groups = groups - groups[0] if m else groups
    order = np.arange(m)
    for at in range(wide - 1, -1, -1):
        out[at] = out[at][order]
        order = order[_dealt(groups, out[at])]
    return out


def merge(groups: np.ndarray, shards: list[np.ndarray], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) start, relative to its anchor, of a repeated string of each surroundings; first > last: none.

    ``groups``: sorted group numbers of all shards' surroundings, which follow each other. One interleaving has the suffixes of all
    groups, each in its part.
    """
    m, before = len(groups), length - gram
    wide = before + length
    symbols = np.concatenate(shards, 1)
    shard = np.repeat(np.arange(len(shards), dtype=np.uint16), [s.shape[1] for s in shards])
    inner = np.r_[False, groups[1:] == groups[:-1]]
    order, common = np.arange(m), np.zeros(m + 1, np.int32)
    first, last = np.full(m, wide, np.int32), np.full(m, -wide, np.int32)
    symbol = np.empty(m, np.uint16)
    for at in range(wide - 1, -1, -1):
        # A shard's transform has its symbols in the order in which the interleaving takes them.
        symbol[np.argsort(shard[order], kind="stable")] = symbols[at]
        mixed = inner[1:] & (symbol[1:] != symbol[:-1])
        grown = np.where(inner & (symbol > 0), common[:m] + 1, 0)
        if mixed.any():
            part = np.flatnonzero(np.isin(groups, np.unique(groups[1:][mixed])))
            came = part[_dealt(np.cumsum(np.r_[False, groups[part][1:] != groups[part][:-1]]), symbol[part])]
            now = np.zeros(len(part), np.int32)
            alike = inner[part][1:] & (symbol[came][1:] == symbol[came][:-1]) & (symbol[came][1:] > 0)
            k = np.flatnonzero(alike) + 1
            i, j = came[k - 1] + 1, came[k]
            value = common[j]
            far = np.flatnonzero(j > i)
            if len(far):
                bounds = np.column_stack([i[far], j[far] + 1]).ravel()
                value[far] = np.minimum.reduceat(common, bounds)[::2]
            now[k] = value + 1
            grown[part] = now
            order[part] = order[came]
        common[:m] = grown
        if at <= before:
            hit = np.flatnonzero(grown >= length)
            if len(hit):
                who = order[np.r_[hit, hit - 1]]
                first[who] = at - before
                last[who] = np.maximum(last[who], at - before)
    return first, last


def _digest(text_col: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))


def _winnowed(df: DataFrame, key_col: str, text_col: str) -> DataFrame:
    """Rows (doc, digest, n_bytes, hashes, places, own) of all rows; ``own`` are spans the text repeats by itself."""
    kind = df.select(key_col).schema[0].dataType.simpleString()
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                size, hashes, places, own = [], [], [], []
                for text in batch.column(1):
                    raw = np.frombuffer((text.as_py() or "").encode(), np.uint8)
                    h, p, o = anchors(raw)
                    size.append(len(raw))
                    hashes.append(h)
                    places.append(p)
                    own.append([{"start": a, "end": b} for a, b in cover(o)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), pa.array(size, pa.int64()), pa.array(hashes, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32())), pa.array(own, pa.list_(span))],
                    names=["doc", "digest", "n_bytes", "hashes", "places", "own"],
                )

    out = f"doc {kind}, digest binary, n_bytes long, hashes array<long>, places array<int>, own array<struct<start: long, end: long>>"
    return small_batches(df.select(key_col, text_col, _digest(text_col).alias("digest"))).mapInArrow(released(run), out)


def _surroundings(texts: DataFrame) -> DataFrame:
    """Rows (hash, hot, digest, place, left, around) from rows (text, digest, wanted)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = LENGTH - GRAM
        for whole in batches:
            for start in range(0, whole.num_rows, 64):
                rows = []
                for text, digest, wanted in zip(*(c.to_pylist() for c in whole.slice(start, 64).columns), strict=True):
                    raw = (text or "").encode()
                    for w in wanted:
                        p = w["place"]
                        rows.append((w["hash"], w["hot"], digest, p, min(p, before), raw[max(0, p - before) : p + LENGTH]))
                        if len(rows) == 4096:
                            yield pack(rows)
                            rows = []
                if rows:
                    yield pack(rows)

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.bool_(), pa.binary(), pa.int32(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["hash", "hot", "digest", "place", "left", "around"])

    return texts.mapInArrow(released(run), "hash long, hot boolean, digest binary, place int, left int, around binary")


def _merged(around: DataFrame) -> DataFrame:
    """Rows (digest, start, end) of the bytes that strings around each anchor repeat, by the merge of each hash's suffixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        total = 0
        for batch in batches:
            # Rows come sorted by hash; what follows the last change of the hash may go on in the next batch.
            while batch.num_rows:
                edges = np.flatnonzero(np.diff(batch.column(0).to_numpy())) + 1
                if held and held[-1].column(0)[-1].as_py() != batch.column(0)[0].as_py():
                    edges = np.r_[0, edges]
                if not len(edges) or total + edges[-1] < CAP:
                    break
                cut = int(edges[np.searchsorted(edges, max(0, CAP - total))]) if total + edges[-1] >= CAP else int(edges[-1])
                yield from solve([*held, batch.slice(0, cut)])
                held, total, batch = [], 0, batch.slice(cut)
            if batch.num_rows:
                held.append(batch)
                total += batch.num_rows
        if held:
            yield from solve(held)

    def solve(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(parts)
        if not rows.num_rows:
            return
        hashes, places = rows.column("hash").to_numpy(), rows.column("place").to_numpy().astype(np.int64)
        groups = np.cumsum(np.r_[False, hashes[1:] != hashes[:-1]])
        left, texts = rows.column("left").to_numpy(), rows.column("around")
        shards = [transform(groups[a : a + SHARD], left[a : a + SHARD], texts.slice(a, SHARD).to_pylist()) for a in range(0, len(groups), SHARD)]
        first, last = merge(groups, shards)
        found = np.flatnonzero(first <= last)
        if len(found):
            yield pa.RecordBatch.from_arrays(
                [rows.column("digest").take(pa.array(found)).combine_chunks(), pa.array(places[found] + first[found]), pa.array(places[found] + last[found] + LENGTH)],
                names=["digest", "start", "end"],
            )

    ordered = around.drop("hot").repartition("hash").sortWithinPartitions("hash")
    return ordered.mapInArrow(released(run), "digest binary, start long, end long")


def _counted(around: DataFrame) -> DataFrame:
    """The same rows for hashes of more than CAP places: every window with its hash, hashes that occur twice, by shuffles only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            for row in batch.to_pylist():
                text, origin = row["around"], row["place"] - row["left"]
                starts = range(0, min(row["left"], len(text) - LENGTH) + 1)
                hashes = [xxh3_128_digest(text[a : a + LENGTH]) for a in starts]
                yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.binary()), pa.array([row["digest"]] * len(hashes), pa.binary()), pa.array([origin + a for a in starts], pa.int64())], names=["window", "digest", "start"])

    windows = materialize(around.mapInArrow(run, "window binary, digest binary, start long").distinct(), "windows")
    twice = windows.groupBy("window").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("window")
    return windows.join(twice, "window", "left_semi").select("digest", "start", (F.col("start") + LENGTH).alias("end"))


def repeated_spans(df: DataFrame, key_col: str = "doc_id", text_col: str = "text", cap: int | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """Rows (digest, spans) of the different texts with repeated strings, and the written tables they are read from.

    Spans are sorted and may overlap. See ``remove_repeats``.
    """
    cap = CAP if cap is None else cap
    found = _winnowed(df, key_col, text_col)
    texts = found.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.min("doc").alias("rep"), *(F.first(c).alias(c) for c in ("n_bytes", "hashes", "places", "own")))
    texts = materialize(texts, "texts")
    places = texts.select("digest", "rep", F.explode(F.arrays_zip(F.col("hashes").alias("hash"), F.col("places").alias("place"))).alias("a")).select("digest", "rep", F.col("a")["hash"].alias("hash"), F.col("a")["place"].alias("place"))
    shared = places.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash", (F.col("n") > cap).alias("hot"))
    shared = materialize(shared, "shared")
    few = shared.count() <= BROADCAST_ROWS
    wanted = places.join(F.broadcast(shared) if few else shared, "hash").groupBy("digest", "rep").agg(F.collect_list(F.struct("hash", "place", "hot")).alias("wanted"))
    wanted = materialize(wanted.withColumnsRenamed({"digest": "want"}), "wanted")
    written = [texts, shared, wanted]
    rows, items = wanted.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("wanted")), F.lit(0))).first()
    small = rows <= BROADCAST_ROWS and items <= BROADCAST_ITEMS
    there = df.select(F.col(key_col).alias("doc"), F.col(text_col).alias("text"), _digest(text_col).alias("digest"))
    joined = there.join(F.broadcast(wanted) if small else wanted, F.col("doc").eqNullSafe(F.col("rep")) & (F.col("digest") == F.col("want")))
    joined = joined.select("text", "digest", "wanted")
    if joined.count() > rows:  # rows of the table repeat; a text's surroundings count once
        joined = joined.dropDuplicates(["digest"])
    around = _surroundings(joined)
    spans = _merged(around.where("NOT hot"))
    if not shared.where("hot").isEmpty():
        spans = spans.unionByName(_counted(around.where("hot")))
    whole = texts.where((F.col("copies") > 1) & (F.col("n_bytes") >= LENGTH)).select("digest", F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end"))
    own = texts.select("digest", F.explode("own").alias("s")).select("digest", "s.start", "s.end")
    every = spans.unionByName(whole).unionByName(own)
    return every.groupBy("digest").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans")), written


def remove_repeats(df: DataFrame, key_col: str = "doc_id", text_col: str = "text", cap: int | None = None) -> DataFrame:
    """Rows (key, n_bytes, removed, kept, kept_text): the maximal runs of removed bytes (array of start, end) and the rest.

    ``kept`` is binary; ``kept_text`` has its whole characters (a cut may leave a part of one at the edge of a run).     Texts are judged as UTF-8 bytes, on the whole table and on the input: copies of a text of LENGTH bytes or more lose everything,
    shorter ones nothing. Null texts count as empty. Repeated rows are copies; rows that share a key (or have none) are
    treated each by its own text. An empty table gives an empty one; other columns are not read.
    """
    spans, written = repeated_spans(df, key_col, text_col, cap)
    spans = materialize(spans.withColumnsRenamed({"digest": "d"}), "spans")
    discard(*written)
    rows, items = spans.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()
    small = rows <= BROADCAST_ROWS and items <= BROADCAST_ITEMS
    kind = df.select(key_col).schema[0].dataType.simpleString()
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                size, removed, kept, whole_text = [], [], [], []
                for text, found in zip(batch.column(1), batch.column(2), strict=True):
                    raw, runs, at, rest = (text.as_py() or "").encode(), [], 0, []
                    for s in found.as_py() or ():
                        if runs and s["start"] <= runs[-1]["end"]:
                            runs[-1]["end"] = max(runs[-1]["end"], s["end"])
                        else:
                            runs.append(dict(s))
                    for r in runs:
                        rest.append(raw[at : r["start"]])
                        at = r["end"]
                    size.append(len(raw))
                    removed.append(runs)
                    rest.append(raw[at:])
                    kept.append(b"".join(rest))
                    whole_text.append("".join(r.decode(errors="ignore") for r in rest))
                columns = [batch.column(0), pa.array(size, pa.int64()), pa.array(removed, pa.list_(span)), pa.array(kept, pa.binary()), pa.array(whole_text, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[key_col, "n_bytes", "removed", "kept", "kept_text"])

    there = df.select(key_col, text_col, _digest(text_col).alias("digest"))
    joined = there.join(F.broadcast(spans) if small else spans, F.col("digest") == F.col("d"), "left").select(key_col, text_col, "spans")
    return joined.mapInArrow(released(run), f"`{key_col}` {kind}, n_bytes long, removed array<struct<start: long, end: long>>, kept binary, kept_text string")
