"""N-gram Jaccard join: a MinHash LSH forest proposes, exact Jaccard similarity decides.

1. Texts become sets of 64-bit hashes of five-word shingles. Texts with equal sets are one class; only class
   representatives go on, so copies are never paired.
2. The forest has TREES tries of labels of MAX_DEPTH 16-bit minhashes. A task holds a trie's branch below one of the shortest
   prefixes, its labels sorted, and shortens the matched prefix from MAX_DEPTH hash by hash: members that meet at a depth
   and aren't linked yet are compared by their whole signatures. A branch stops as soon as its members are all linked; at
   the latest it stops at the depth where a pair at the threshold has met in some trie with the target recall
   (``shortest_prefix``). Only a star of links leaves the task.
3. The stars' connected components are groups. Within a group all pairs that can reach the threshold by their sizes are
   verified exactly, on the shingle sets, in blocks bounded by members and bytes; a task gives each representative's number of
   verified links and again a star of them. Components of the verified stars are the near-duplicate classes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, materialize, released, small_batches

WORDS = 5
THRESHOLD = 0.8
TREES = 24
MAX_DEPTH = 8
RECALL = 0.99999
SKETCH_SLACK = 0.15  # a pair is proposed if its share of equal minhashes is at least THRESHOLD minus this
BLOCK = 512  # members
BLOCK_BYTES = 4 << 20  # of shingle hashes
COLUMNS = 2048  # shingles that are counted at a time
SPARSE = 16  # shingles of at most so many members are counted pair by pair
PAIRS = 1 << 20  # that are counted at a time
BROADCAST_ROWS = 200_000
MEMO_WORDS = 300_000
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)
_memo: dict[str, int] = {}


def shortest_prefix(recall: float = RECALL, threshold: float = THRESHOLD, trees: int = TREES, max_depth: int = MAX_DEPTH) -> int:
    """The deepest prefix, from ``max_depth`` down, at which a pair of similarity ``threshold`` meets with chance ``recall``."""
    depth = max_depth
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles.

    Words are split at white space and lower-cased. A text of fewer than five words has one shingle of all of them; a null or blank text has none.
    """
    from xxhash import xxh3_64_intdigest

    units = (text or "").lower().split()
    if not units:
        return np.empty(0, np.uint64)
    if len(_memo) > MEMO_WORDS:
        _memo.clear()
    hashes = list(map(_memo.get, units))
    if None in hashes:
        for i, h in enumerate(hashes):
            if h is None:
                hashes[i] = _memo.setdefault(units[i], xxh3_64_intdigest(units[i]))
    return combine(np.array(hashes, np.uint64))


def combine(hashes: np.ndarray) -> np.ndarray:
    """Distinct hashes of all runs of five word hashes (or of all of fewer)."""
    k = min(WORDS, len(hashes))
    n = len(hashes) - k + 1
    total = np.full(n, k, np.uint64)
    for i in range(k):
        total = (total ^ (hashes[i : i + n] * np.uint64(_FACTORS[i]))) * np.uint64(0x9FB21C651E98DF25)
        total ^= total >> np.uint64(29)
    return np.unique(total)


def hash_functions(count: int) -> tuple[np.ndarray, np.ndarray]:
    """(masks, odd multipliers) of 32 bits, from a fixed seed."""
    drawn = np.random.default_rng(20240607).integers(0, 1 << 32, (2, count, 1), dtype=np.uint32)
    return drawn[0], drawn[1] | np.uint32(1)


def minhashes(found: np.ndarray, functions: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """16 bits of the least value of each hash function over a set that isn't empty."""
    masks, multipliers = functions
    folded = (found ^ (found >> np.uint64(32))).astype(np.uint32)
    low = np.full(len(masks), np.iinfo(np.uint32).max, np.uint32)
    for start in range(0, len(folded), 1024):
        np.minimum(low, ((folded[None, start : start + 1024] ^ masks) * multipliers).min(1), out=low)
    low = (low ^ (low >> np.uint32(15))) * np.uint32(0x9E3779B1)
    return (low >> np.uint32(16)).astype("<u2")


def signatures(df: DataFrame, key_col: str, text_col: str, trees: int = TREES) -> DataFrame:
    """Rows (doc, key, n, sig): a text's class key (128 bits of its shingle set; null if it has none), its size, its labels."""
    kind = df.select(key_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        functions = hash_functions(MAX_DEPTH * trees)
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                keys, sizes, sigs = [], [], []
                for text in batch.column(1):
                    found = shingles(text.as_py())
                    keys.append(xxh3_128_digest(found.tobytes()) if len(found) else None)
                    sizes.append(len(found))
                    sigs.append(minhashes(found, functions).tobytes() if len(found) else None)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary())], names=["doc", "key", "n", "sig"])
        _memo.clear()

    return small_batches(df.select(key_col, text_col)).mapInArrow(released(run), f"doc {kind}, key binary, n long, sig binary")


def _star(roots: np.ndarray, keys: list[bytes]) -> list[tuple[bytes, bytes]]:
    """Links (member, least key) within the members of equal ``roots``."""
    least: dict[int, bytes] = {}
    for r, k in zip(roots.tolist(), keys, strict=True):
        least[r] = min(k, least.get(r, k))
    return [(k, least[r]) for r, k in zip(roots.tolist(), keys, strict=True) if k != least[r]]


def _grouped(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """The runs of rows equal in ``by`` of sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.names.index(c)).to_numpy(zero_copy_only=False) for c in by]
        edge = np.zeros(batch.num_rows, bool)
        for c in columns:
            edge[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(edge).tolist(), batch.num_rows]
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            now = tuple(c[a] for c in columns)
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def walk(labels: np.ndarray, sigs: np.ndarray, shortest: int, least: float) -> np.ndarray:
    """Numbers, equal for the linked members, of a branch: sorted ``labels`` (members x depth) and whole signatures.

    Linked are those that share a prefix of ``shortest`` hashes or more and at least ``least`` of their signatures, and what these join.
    """
    m, depth = labels.shape
    root = np.arange(m)
    shared = (labels[1:] == labels[:-1]).cumprod(1).sum(1)  # of neighbours in the trie
    below = np.arange(m)  # the node one step deeper that a member is in
    for d in range(depth, shortest - 1, -1):
        node = np.r_[0, np.cumsum(shared < d)]
        edges = np.r_[np.flatnonzero(np.diff(node, prepend=-1)), m]
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            for p in range(a, b):
                if (root[a:b] == root[a]).all():
                    break
                # Members of p's node one step deeper have been compared with p there.
                far = p + 1 + np.flatnonzero((root[p + 1 : b] != root[p]) & (below[p + 1 : b] != below[p]))
                alike = far[(sigs[far] == sigs[p]).mean(1) >= least] if len(far) else far
                if len(alike):
                    root[np.isin(root, root[alike])] = root[p]
        if (root == root[0]).all():
            break
        below = node
    return root


def propose(reps: DataFrame, trees: int = TREES, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """Links (a, b) between representatives' keys that join all pairs that meet in the forest and have enough equal minhashes."""
    shortest, width, least = shortest_prefix(recall, threshold, trees), 2 * MAX_DEPTH, threshold - SKETCH_SLACK
    tries = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(F.xxhash64(t, F.substring("sig", t * width + 1, F.lit(2 * shortest))).alias("prefix"), F.substring("sig", t * width + 1, F.lit(width)).alias("label")))
    spread = reps.select("key", "sig", F.explode(tries).alias("_t")).select("key", "sig", "_t.prefix", "_t.label")
    crowded = materialize(spread.groupBy("prefix").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "prefixes")
    few = crowded.count() <= BROADCAST_ROWS
    rows = spread.join(F.broadcast(crowded) if few else crowded, "prefix").withColumn("_n", F.ceil(F.col("members") / BLOCK).cast("int"))
    rows = rows.withColumn("_mine", F.pmod(F.xxhash64("key"), "_n").cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    dealt = rows.select("prefix", F.least("_mine", "_other").alias("i"), F.greatest("_mine", "_other").alias("j"), "label", "key", "sig")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges: set[tuple[bytes, bytes]] = set()
        for group in _grouped(batches, ["prefix", "i", "j"]):
            keys = group.column("key").to_pylist()
            labels, sigs = (np.frombuffer(b"".join(group.column(c).to_pylist()), "<u2").reshape(len(keys), -1) for c in ("label", "sig"))
            edges.update(_star(walk(labels, sigs, shortest, least), keys))
            if len(edges) > 50_000:
                yield _edges(edges)
                edges = set()
        if edges:
            yield _edges(edges)

    ordered = dealt.repartition("prefix", "i", "j").sortWithinPartitions("prefix", "i", "j", "label")
    return small_batches(ordered).mapInArrow(released(run), "a binary, b binary").distinct()


def _edges(edges) -> pa.RecordBatch:
    a, b = zip(*edges, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, label) of the nodes of ``edges`` (a, b); the label is the least node of the component.

    Least labels spread along the edges, and each round a node also takes its label's label, so rounds grow with the logarithm of
    a component's width. Each round is written, so that it can be read again if an executor is lost.
    """
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("low"))
        own = labels.join(near, labels["node"] == near["a"]).select("node", F.least("label", "low").alias("label"), F.col("label").alias("was"))
        up = labels.select(F.col("node").alias("n2"), F.col("label").alias("l2"))
        new = own.join(up, own["label"] == up["n2"]).select("node", F.least("label", "l2").alias("label"), (F.least("label", "l2") != F.col("was")).alias("moved"))
        before, labels = labels, materialize(new, "labels")
        discard(before)
        if labels.where("moved").isEmpty():
            discard(both)
            return labels.select("node", "label")


def with_tasks(members: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Append ``tasks``, the (low, cross, i, j, block) of the pairs of blocks that a member (grp, n, key, ...) is in.

    A group's members fall into bands of set sizes; only those of one band or (``cross``) of neighbouring bands, of which
    ``low`` is the lower, can reach the threshold. A band has as many blocks as its members and bytes need; ``block`` tells a
    task's two blocks apart.
    """
    width = -math.log(threshold) * 1.000001 if threshold < 1 else 1e-6
    rows = members.withColumn("band", F.floor(F.log("n") / width).cast("long"))
    bands = rows.groupBy("grp", "band").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(8 * F.sum("n") / BLOCK_BYTES)).cast("int").alias("blocks"))
    by = W.partitionBy("grp").orderBy("band")
    beside = lambda f, step: F.when(f("band").over(by) == F.col("band") + step, f("blocks").over(by)).otherwise(0)
    bands = bands.select("grp", "band", "blocks", beside(F.lead, 1).alias("above"), beside(F.lag, -1).alias("under"))
    rows = rows.join(bands, ["grp", "band"]).withColumn("_m", F.pmod(F.xxhash64("key"), "blocks").cast("int"))

    def tasks(count, make):
        return F.when(F.col(count) > 0, F.transform(F.sequence(F.lit(0), F.col(count) - 1), make)).otherwise(F.array().cast("array<struct<low:bigint,cross:boolean,i:int,j:int,block:int>>"))

    def task(low, cross, i, j, block):
        return F.struct(low.alias("low"), F.lit(cross).alias("cross"), i.alias("i"), j.alias("j"), block.alias("block"))

    own = tasks("blocks", lambda o: task(F.col("band"), False, F.least("_m", o), F.greatest("_m", o), F.col("_m")))
    above = tasks("above", lambda o: task(F.col("band"), True, F.col("_m"), o, F.lit(0)))
    under = tasks("under", lambda o: task(F.col("band") - 1, True, o, F.col("_m"), F.lit(1)))
    return rows.select(*members.columns, F.concat(own, above, under).alias("tasks"))


def verify(members: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Exact similarities within groups. ``members``: (grp, tasks, key, copies, set), ``set`` the bytes of the shingle hashes.

    Rows (a, b, links, texts): for each task a row per member with its links counted there (b null; ``links`` counts the
    linked classes' copies, ``texts`` the classes), and star links (a, b, 0, 0) between linked members.
    """
    by = ["grp", "low", "cross", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(batches, by):
            keys, copies = group.column("key").to_pylist(), group.column("copies").to_numpy()
            block = group.column("block").to_numpy()
            sets = [np.frombuffer(s.as_buffer(), "<u8") for s in group.column("set")]
            cross, i, j = (group.column(c)[0].as_py() for c in ("cross", "i", "j"))
            a, b = linked(sets, block, not cross and i == j, threshold)
            links, texts = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
            root = np.arange(len(keys))
            for x, y in ((a, b), (b, a)):
                np.add.at(links, x, copies[y])
                np.add.at(texts, x, 1)
            bounds = np.searchsorted(a, np.arange(len(keys) + 1)).tolist()
            for x in range(len(keys)):
                if bounds[x] < bounds[x + 1]:
                    root[np.isin(root, root[b[bounds[x] : bounds[x + 1]]])] = root[x]
            some = np.flatnonzero(texts).tolist()
            rows = [(keys[k], None, int(links[k]), int(texts[k])) for k in some] + [(x, y, 0, 0) for x, y in _star(root, keys)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.binary(), pa.binary(), pa.int64(), pa.int64()), strict=True)], names=["a", "b", "links", "texts"])

    dealt = members.withColumn("_t", F.explode("tasks")).select("grp", "_t.low", "_t.cross", "_t.i", "_t.j", "_t.block", "key", "copies", "set")
    return small_batches(dealt.repartition(*by).sortWithinPartitions(*by)).mapInArrow(released(run), "a binary, b binary, links long, texts long")


def linked(sets: list[np.ndarray], block: np.ndarray, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places (a < b) whose sets have a Jaccard similarity of at least ``threshold``; pairs across two blocks, or within one.

    Shingles of few members are counted for each of their pairs, others as products of 0-1 matrices of COLUMNS shingles.
    """
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(m, dtype=np.int32), sizes)
    _, ids, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(ids, kind="stable")
    ids, owner = ids[order], owner[order]
    times = count[ids]
    shared = np.zeros((m, m), np.float32)
    few = SPARSE if m > 4 * SPARSE else 1  # small groups are one product
    for k in np.unique(count[(count > 1) & (count <= few)]).tolist():
        meet = owner[times == k].reshape(-1, k).astype(np.int64)
        x, y = np.triu_indices(k, 1)
        step = max(1, PAIRS // len(x))
        for start in range(0, len(meet), step):
            part = meet[start : start + step]
            shared += np.bincount((part[:, x] * m + part[:, y]).ravel(), minlength=m * m).reshape(m, m)
    often = np.flatnonzero(count > few)
    column = np.full(len(count), -1)
    column[often] = np.arange(len(often))
    at, owner = column[ids[times > few]], owner[times > few]
    for start in range(0, len(often), COLUMNS):
        low, high = np.searchsorted(at, [start, start + COLUMNS])
        member = np.zeros((m, min(COLUMNS, len(often) - start)), np.float32)
        member[owner[low:high], at[low:high] - start] = 1
        shared += member @ member.T
    a, b = np.triu_indices(m, 1)
    if not same:
        a, b = (x[block[a] != block[b]] for x in (a, b))
    # Counts below 2 ** 24 are whole numbers in 32-bit floats too; shared / union is compared in double arithmetic.
    hit = shared[a, b].astype(np.int64)
    good = (hit > 0) & (hit / np.maximum(1, sizes[a] + sizes[b] - hit) >= threshold)
    return a[good], b[good]


def shingle_sets(df: DataFrame, key_col: str, text_col: str) -> DataFrame:
    """Rows (doc, key2, set) of texts that have shingles."""
    kind = df.select(key_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                sets = [shingles(t.as_py()).tobytes() for t in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([xxh3_128_digest(s) for s in sets], pa.binary()), pa.array(sets, pa.binary())], names=["doc", "key2", "set"])
        _memo.clear()

    return small_batches(df.select(key_col, text_col)).mapInArrow(released(run), f"doc {kind}, key2 binary, set binary")


def near_duplicates(df: DataFrame, key_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL) -> DataFrame:
    """Rows (key, class_id, n_links, n_text_links), one for each row of ``df``.

    ``class_id`` is the least key among the documents connected by links (pairs of similarity ``threshold`` or more, copies included),
    ``n_links`` the number of documents linked to the row's, ``n_text_links`` that of different linked shingle sets. Null and
    blank texts have no shingles: no links, and their own key as class. Repeated rows are copies of each other. Null keys
    stay null and are passed over as class ids where a class has another. An empty table gives an empty one; other columns are not read.
    """
    sigs = materialize(signatures(df, key_col, text_col, trees), "signatures")
    reps = sigs.where("key IS NOT NULL").groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.min("doc").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    reps = materialize(reps, "classes")
    groups = components(propose(reps.select("key", "sig"), trees, threshold, recall))
    wanted = groups.join(reps.select("key", "copies", "rep", "n"), groups["node"] == F.col("key"))
    wanted = materialize(with_tasks(wanted.select("key", "copies", "rep", "n", F.xxhash64("label").alias("grp")), threshold), "members")
    known = wanted.select(F.col("rep").alias("r")).distinct()
    known = F.broadcast(known) if wanted.count() <= BROADCAST_ROWS else known
    texts = df.join(known, df[key_col].eqNullSafe(known["r"]), "left_semi")
    # Rows that share a key may differ in text, hence the second condition; one set for each class.
    sets = shingle_sets(texts, key_col, text_col)
    found = wanted.join(sets, wanted["rep"].eqNullSafe(sets["doc"]) & (wanted["key"] == sets["key2"]))
    found = found.dropDuplicates(["key"]).select("grp", "tasks", "key", "copies", "set")
    checked = materialize(verify(found, threshold), "links")
    discard(wanted)
    classes = components(checked.where("b IS NOT NULL").select("a", "b"))
    counts = checked.where("b IS NULL").groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"))
    whole = reps.select("key", "copies", "rep").join(classes, reps["key"] == classes["node"], "left").join(counts, "key", "left")
    label = F.coalesce("label", "key")
    least = whole.groupBy(label.alias("label")).agg(F.min("rep").alias("class_id"))
    named = whole.withColumn("label", label).join(least, "label").select("key", "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("texts", F.lit(0)).alias("texts"))
    out = sigs.select("doc", "key").join(named, "key", "left")
    return out.select(
        F.col("doc").alias(key_col),
        F.when(F.col("key").isNull(), F.col("doc")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(F.col("key").isNull(), 0).otherwise(F.col("copies") - 1 + F.col("links")).cast("long").alias("n_links"),
        F.when(F.col("key").isNull(), 0).otherwise(F.col("texts")).cast("long").alias("n_text_links"),
    )
