import math
import random

import numpy as np
from pyspark.sql import functions as F

from lectern.functions import vectors as V
from lectern.operators import boundary


def rows(spark, groups):
    data = [(g, i, f"S{i}.", [float(x) for x in v]) for g, vs in groups.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(data, "g int, idx int, sentence string, embedding array<double>")


def flags(df):
    return {(r.g, r.idx): (round(r.distance, 6), r.is_boundary) for r in df.collect()}


def test_topic_shift(spark):
    a, b = np.eye(8)[0], np.eye(8)[1]
    got = flags(boundary.window_bounds(rows(spark, {1: [a, a, a, b, b, b]}), ["g"], window=2))
    assert [i for (_, i), (_, f) in got.items() if f] == [2]


def test_too_short_for_windows(spark):
    got = flags(boundary.window_bounds(rows(spark, {1: np.eye(3), 2: np.eye(8)[:1]}), ["g"]))
    assert set(got.values()) == {(0.0, False)} and len(got) == 4


def model(vs, w, f):
    out = [(0.0, False)] * len(vs)
    at = range(w - 1, len(vs) - w)
    far = []
    for i in at:
        left, right = np.mean(vs[i - w + 1 : i + 1], axis=0), np.mean(vs[i + 1 : i + 1 + w], axis=0)
        nl, nr = np.linalg.norm(left) or 1.0, np.linalg.norm(right) or 1.0
        far.append(round(1 - float(left @ right) / (nl * nr), 9))
    if len(vs) >= 2 * w and far:
        limit = round(float(np.mean(far)) + f * float(np.std(far)), 9)
        for i, d in zip(at, far, strict=True):
            out[i] = (round(d, 6), d > limit)
    return out


def test_random_windows_equal_numpy(spark):
    rng = np.random.default_rng(5)
    groups = {n: rng.standard_normal((n, 6)).tolist() for n in range(1, 25)}
    groups[30] = [[0.0] * 6] * 9
    got = flags(boundary.window_bounds(rows(spark, groups), ["g"]))
    for g, vs in groups.items():
        assert [got[g, i] for i in range(len(vs))] == model(np.array(vs), 3, 0.8)


def test_adjacent(spark):
    same = [[1.0, 0.0], [0.8, 0.6], [1.0, 0.0]]
    got = flags(boundary.adjacent_bounds(rows(spark, {1: same, 2: [[1.0, 0.0]], 3: [[0.0, 0.0], [1.0, 0.0]]}), ["g"]))
    assert not any(f for _, f in got.values())
    assert got[2, 0] == (0.0, False) and got[3, 0][0] == 1.0 and got[1, 2] == (0.0, False)


def flush(cuts, min_s, min_w, keep):
    out, held = [], []
    for i, (b, w) in enumerate(cuts):
        held.append((i, w))
        if b and (len(held) >= min_s or sum(x for _, x in held) >= min_w):
            out.append([i for i, _ in held])
            held = []
    if held and (keep or len(held) >= min_s or sum(x for _, x in held) >= min_w):
        out.append([i for i, _ in held])
    return out


def test_greedy_flush_equals_the_loop(spark):
    random.seed(9)
    blocks = {g: [(random.random() < 0.5, random.choice([1, 2, 30, 60])) for _ in range(random.randint(1, 12))] for g in range(150)}
    data = [(g, i, f"{i}" + " x" * (w - 1), b) for g, cuts in blocks.items() for i, (b, w) in enumerate(cuts)]
    df = spark.createDataFrame(data, "g int, idx int, sentence string, is_boundary boolean")
    for keep in (True, False):
        got: dict[int, list] = {g: [] for g in blocks}
        for r in boundary.greedy_flush(df, ["g"], min_sentences=2, min_words=50, keep_remainder=keep).orderBy("g", "piece").collect():
            got[r.g].append([int(w) for w in r.text.split() if w != "x"])
        assert got == {g: flush(c, 2, 50, keep) for g, c in blocks.items()}


def test_drop_remainder_fixture(spark):
    df = spark.createDataFrame([(1, 0, "Tiny.", True)], "g int, idx int, sentence string, is_boundary boolean")
    assert boundary.greedy_flush(df, ["g"], keep_remainder=False).count() == 0
    assert boundary.greedy_flush(df, ["g"]).first().text == "Tiny."


def test_cluster(spark):
    df = spark.createDataFrame([(1, i, f"S{i + 1}.", i == 1) for i in range(4)], "g int, idx int, sentence string, is_boundary boolean")
    assert [r.text for r in boundary.cluster(df, ["g"]).orderBy("cluster").collect()] == ["S1. S2.", "S3. S4."]


def test_pooled_vectors(spark):
    df = rows(spark, {1: [[1.0, 0.0], [0.0, 1.0], [2.0, 0.0]]}).withColumn("is_boundary", F.col("idx") == 1)
    got = [r.pooled for r in boundary.greedy_flush(df, ["g"], vector="embedding").orderBy("piece").collect()]
    assert np.allclose(got, [[math.sqrt(0.5)] * 2, [1.0, 0.0]])


def test_vector_conventions(spark):
    df = spark.createDataFrame([(1, 1, [0.0, 0.0]), (1, 2, [1.0, 1.0])], "g int, k int, v array<double>")
    pair = df.where("k = 1").select(F.col("v").alias("a")).join(df.where("k = 2").select(F.col("v").alias("b")))
    assert pair.select(V.cosine(F.col("a"), F.col("b"))).first()[0] == 0.0
    assert math.isnan(pair.select(V.cosine_distance(F.col("a"), F.col("b"))).first()[0])
    assert pair.select(V.l2_normalize(F.col("a"))).first()[0] == [0.0, 0.0]
    matrix = {(r.key_a, r.key_b): r.similarity for r in V.similarity_matrix(df, "g", "k", "v").collect()}
    assert len(matrix) == 4 and matrix[1, 1] == 0.0 and abs(matrix[2, 2] - 1) < 1e-9


def test_similarity_matrix_in_tiles(spark, monkeypatch):
    rng = np.random.default_rng(5)
    data = [(i % 3, i, rng.normal(size=8).tolist()) for i in range(60)] + [(7, 60, [1.0, 2.0])]
    data += [(1, 61, [0.0] * 8), (1, 62, None), (1, 63, [1.0, 2.0]), (1, 64, [1.0, None] * 4), (1, 65, []), (1, 1, [1.0] * 8), (None, 66, [1.0]), (1, None, [1e-90] * 8), (1, 67, [1e90] * 8)]
    df = spark.createDataFrame(data, "g int, k long, v array<double>")
    left, right = df.selectExpr("g", "k AS key_a", "v AS a"), df.selectExpr("g", "k AS key_b", "v AS b")
    brute = left.join(right, "g").select("g", "key_a", "key_b", F.round(V.cosine(F.col("a"), F.col("b")), 6) + 0.0).collect()
    for rows, cells in ((1024, 1 << 16), (7, 20), (1, 1)):
        monkeypatch.setattr(V, "MATRIX_ROWS", rows)
        monkeypatch.setattr(V, "CELLS", cells)
        made = V.similarity_matrix(df, "g", "k", "v", digits=6)
        got = made.select("g", "key_a", "key_b", (F.col("similarity") + 0.0).alias("s")).collect()
        assert sorted(str(tuple(r)) for r in got) == sorted(str(tuple(r)) for r in brute)
        # No join pairs the rows: the only one is with the groups' counts.
        assert made._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    assert V.similarity_matrix(df.limit(0), "g", "k", "v").count() == 0
