import random
import zlib

import numpy as np

from lectern.llm import quality


def corpus(n):
    rng = random.Random(8)
    rows = []
    for i in range(n):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(20, 80))]
        good = rng.random() < 0.6
        text = " ".join(words) if good else rng.choice([" ".join(w.upper() + "!!" for w in words), " ".join(w + "###" for w in words), " ".join([words[0]] * 60)])
        rows.append((i, text, int(good)))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus(800)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    out = [(r, q) for i, _, q in rows if (r := got[i]).held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got.values())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    assert 100 < len(out) < 220 and np.mean([r.predicted == q for r, q in out]) > 0.97


def test_held_out_labels_are_not_learnt(spark):
    rows = corpus(300)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q) for i, _, q in rows]
    a, b = ({r.doc_id: round(r.score, 12) for r in quality.classify(docs, spark.createDataFrame(x, "doc_id long, quality int")).collect()} for x in ([(i, q) for i, _, q in rows], turned))
    assert a == b


def test_scores_are_densities(spark):
    rng = np.random.default_rng(0)
    d = len(quality.NAMES)
    x = [rng.standard_normal((500, d)), rng.standard_normal((700, d)) * 2 + 1]
    m = quality.fit(np.array([500.0, 700.0]), np.array([v.sum(0) for v in x]), np.array([v.T @ v for v in x]), 0.0, 0.0)
    p = rng.standard_normal((5, d))
    logs = []
    for v, share in zip(x, (500, 700), strict=True):
        mean, cov = v.mean(0), np.cov(v.T)
        logs.append([-0.5 * (r - mean) @ np.linalg.solve(cov, r - mean) - 0.5 * np.linalg.slogdet(cov)[1] + np.log(share) for r in p])
    assert np.allclose(m.scores(p), 1 / (1 + np.exp(np.array(logs[0]) - np.array(logs[1]))), atol=1e-6)


def test_messy(spark, messy, texts):
    labels = messy.select("doc_id", (messy.doc_id % 2).cast("int").alias("quality"))
    for some in (labels, labels.limit(0), labels.where("quality = 1")):
        rows = quality.classify(messy, some).collect()
        assert sorted(str(r.doc_id) for r in rows) == sorted(str(k) for k, _, _ in texts) and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in quality.classify(messy, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(messy.limit(0), labels).count() == 0
    assert quality.statistics("") == [0.0] * len(quality.NAMES)


def test_null_statistics_are_those_of_an_empty_text(spark):
    size = len(quality.NAMES)
    model = quality.fit(np.array([5.0, 5.0]), np.ones((2, size)), np.stack([np.eye(size) * 9] * 2))
    df = spark.createDataFrame([(1, None, "x"), (2, [0.0] * size, "y"), (3, [1.0] * size, None)], "doc_id long, stats array<double>, Score string")
    got = {r.doc_id: r.score for r in quality.score(df, model).collect()}
    assert got[1] == got[2] and got.keys() == {1, 2, 3} and {r.score for r in quality.score(df, None).collect()} == {0.5}
