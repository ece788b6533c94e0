import random

import numpy as np
import pytest

from lectern.llm import jaccard


def sets_of(text):
    w = (text or "").lower().split()
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def brute(rows, threshold=0.8):
    """(class, number of links) of each row, by comparing all pairs."""
    sets = [sets_of(t) for _, t in rows]
    link = [[i != j and bool(a) and bool(b) and len(a & b) / len(a | b) >= threshold for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            x = todo.pop()
            for j, yes in enumerate(link[x]):
                if yes and j not in seen:
                    seen.add(j)
                    todo.append(j)
        keys = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((min(keys) if keys else None, sum(link[i])))
    return out


def corpus(n, seed):
    rng = random.Random(seed)
    base = [[f"w{rng.randint(0, 400)}" for _ in range(rng.randint(20, 90))] for _ in range(8)]
    rows = []
    for i in range(n):
        words = list(rng.choice(base)) if rng.random() < 0.85 else [f"u{rng.random()}" for _ in range(30)]
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            words[rng.randrange(len(words))] = f"e{rng.randint(0, 50)}"
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize(("block", "size", "broadcast"), [(512, 4 << 20, 200_000), (7, 4 << 20, -1), (512, 3000, 200_000)])
def test_equals_all_pairs(spark, monkeypatch, block, size, broadcast):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "BLOCK_BYTES", size)
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", broadcast)
    rows = corpus(220, 4) + [(1000, "short one"), (1001, "Short  ONE"), (1002, "other"), (1003, ""), (1004, None), (3, "w1 w2")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in jaccard.near_duplicates(df.repartition(5)).collect())
    assert got == sorted((k, c, n) for (k, _), (c, n) in zip(rows, brute(rows), strict=True))
    assert sum(n for _, _, n in got) > 200


def test_messy(spark, messy, texts):
    got = sorted(map(str, ((r.doc_id, r.class_id, r.n_links) for r in jaccard.near_duplicates(messy).collect())))
    assert got == sorted(map(str, ((k, c, n) for (k, _, _), (c, n) in zip(texts, brute([t[:2] for t in texts]), strict=True))))
    assert jaccard.near_duplicates(messy.limit(0)).count() == 0


def test_shortest_prefix_meets_the_recall():
    assert jaccard.shortest_prefix(0.99999, 0.8, 24, 8) == 4 and jaccard.shortest_prefix(0.5, 0.8, 24, 8) == 8 and jaccard.shortest_prefix(0.999999999, 0.3, 4, 8) == 1
    for d in range(1, 9):
        if 1 - (1 - 0.8**d) ** 24 >= 0.99999:
            assert jaccard.shortest_prefix(0.99999, 0.8, 24, d) == d


def closure(m, pairs):
    root = list(range(m))
    for a, b in pairs:
        root = [root[a] if r == root[b] else r for r in root]
    return {(i, j) for i in range(m) for j in range(m) if root[i] == root[j]}


def test_walk_links_all_that_share_a_prefix_and_enough_minhashes():
    rng = np.random.default_rng(8)
    for _ in range(200):
        m, shortest = int(rng.integers(1, 30)), int(rng.integers(1, 4))
        sigs = rng.integers(0, 3, (m, 12)).astype("<u2")
        sigs = sigs[np.lexsort(sigs[:, 4::-1].T)]
        labels = np.ascontiguousarray(sigs[:, :5])
        root = jaccard.walk(labels, sigs, shortest, 0.5)
        pairs = [(i, j) for i in range(m) for j in range(i + 1, m) if (labels[i, :shortest] == labels[j, :shortest]).all() and (sigs[i] == sigs[j]).mean() >= 0.5]
        assert {(i, j) for i in range(m) for j in range(m) if root[i] == root[j]} == closure(m, pairs)


def test_walk_compares_no_more_once_a_branch_is_linked():
    class Counted(np.ndarray):
        rows = 0

        def __getitem__(self, at):
            out = np.asarray(super().__getitem__(at))
            Counted.rows += len(out) if out.ndim == 2 else 0
            return out

    sigs = np.zeros((1000, 16), "<u2")
    root = jaccard.walk(np.zeros((1000, 4), "<u2"), sigs.view(Counted), 1, 0.5)
    assert (root == root[0]).all() and Counted.rows < 2000


@pytest.mark.parametrize(("sparse", "columns"), [(16, 2048), (5, 3), (100, 7)])
def test_linked_equals_sets(monkeypatch, sparse, columns):
    monkeypatch.setattr(jaccard, "SPARSE", sparse)
    monkeypatch.setattr(jaccard, "COLUMNS", columns)
    monkeypatch.setattr(jaccard, "PAIRS", 50)
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 40, rng.integers(1, 40)).astype(np.uint64)) for _ in range(60)]
    block = np.array([i % 2 for i in range(60)])
    for same in (True, False):
        a, b = jaccard.linked(sets, block, same, 0.5)
        want = {(i, j) for i in range(60) for j in range(i + 1, 60) if (same or block[i] != block[j]) and len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j])) >= 0.5}
        assert set(zip(a.tolist(), b.tolist())) == want


def test_components_of_a_chain(spark):
    n = 40
    key = lambda i: i.to_bytes(4, "big")
    order = list(range(n))
    random.Random(3).shuffle(order)
    df = spark.createDataFrame([(bytearray(key(order[i])), bytearray(key(order[i + 1]))) for i in range(n - 1)] + [(bytearray(key(100)), bytearray(key(101)))], "a binary, b binary")
    rows = {bytes(r.node): bytes(r.label) for r in jaccard.components(df).collect()}
    assert all(rows[key(i)] == key(0) for i in range(n)) and rows[key(101)] == key(100)
    assert jaccard.components(df.limit(0)).count() == 0
