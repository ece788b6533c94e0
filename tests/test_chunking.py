import random

import pytest
from pyspark.sql import functions as F

from lectern.config import Settings
from lectern.functions import embedding as E
from lectern.operators import chunking


def test_headings_table_and_prose(spark):
    text = "# Main Topic\n## Subtopic A\nFirst sentence here. Second sentence here.\n\n| a | b |\n|---|---|\n| 1 | 2 |"
    df = spark.createDataFrame([("f", text), ("e", ""), ("n", None), ("h", "# Only a heading")], "file_id string, text string")
    rows = chunking.chunk_documents(df).orderBy("chunk_index").collect()
    assert [r.text_data for r in rows] == [
        "Context: Main Topic > Subtopic A\nContent: First sentence here. Second sentence here.",
        "Context: Main Topic > Subtopic A\nTable Data:\n| a | b |\n|---|---|\n| 1 | 2 |",
    ]
    assert [r.node_type for r in rows] == ["PARAGRAPH", "TABLE"] and rows[1].row_count == 3 and rows[1].token_count is None
    assert all(abs(sum(x * x for x in r.embeddings) - 1) < 1e-9 for r in rows) and [r.chunk_index for r in rows] == [0, 1]


@pytest.mark.parametrize("strategy", ["hybrid", "vector_math"])
def test_lists_are_cut_with_their_path(spark, strategy):
    text = "# L\n" + "\n".join(f"- item number {i}" for i in range(4))
    df = spark.createDataFrame([("f", text)], "file_id string, text string")
    rows = chunking.chunk_documents(df, Settings(max_tokens=5, overlap_tokens=2, chunk_embedding_strategy=strategy)).collect()
    assert len(rows) > 1 and all(r.node_type == "LIST" and r.text_data.startswith("Context: L\nContent:\n") for r in rows)


def test_vector_math_has_unit_vectors_shared_by_windows(spark):
    text = " ".join(f"Word{i} is here." for i in range(40))
    df = spark.createDataFrame([("f", text)], "file_id string, text string")
    s = Settings(max_tokens=20, overlap_tokens=0, chunk_embedding_strategy="vector_math", min_words=1, min_sentences=1000)
    rows = chunking.chunk_documents(df, s).orderBy("chunk_index").collect()
    assert all(abs(sum(x * x for x in r.embeddings) - 1) < 1e-5 for r in rows)


def merge(chunks, n):
    out = []
    for kind, text in chunks:
        body = text.split("\nContent:", 1)[1].strip() if text.startswith("Context: ") and "\nContent:" in text else text
        if out and kind == "PARAGRAPH" == out[-1][0] and len(body.split()) < n:
            out[-1] = (kind, f"{out[-1][1]} {body}", out[-1][2] + 1)
        else:
            out.append((kind, text, 1))
    return out


def merged(spark, docs, n):
    data = [(g, i, k, t, [1.0]) for g, cs in docs.items() for i, (k, t) in enumerate(cs)]
    df = spark.createDataFrame(data, "file_id int, pos int, node_type string, text string, embeddings array<double>")
    out = {g: [] for g in docs}
    for r in chunking.merge_undersized(df, "file_id", ["pos"], n).orderBy("file_id", "pos").collect():
        assert (r.embeddings is None) == (r.n_merged > 1)
        out[r.file_id].append((r.node_type, r.text, r.n_merged))
    return out


def test_merge_fixture(spark):
    long = "w " * 59 + "w"
    docs = {1: [("PARAGRAPH", long), ("PARAGRAPH", "Context: Chapter I\nContent: “Dive!”"), ("PARAGRAPH", long)], 2: [("PARAGRAPH", "lead"), ("TABLE", "t"), ("PARAGRAPH", "x")]}
    got = merged(spark, docs, 10)
    assert got == {g: merge(c, 10) for g, c in docs.items()} and got[1][0][1].endswith(" “Dive!”") and len(got[1]) == 2


def test_merge_equals_the_loop(spark):
    random.seed(11)
    docs = {g: [(random.choice(["PARAGRAPH", "PARAGRAPH", "TABLE", "LIST"]), "w " * random.randint(1, 9)) for _ in range(random.randint(1, 9))] for g in range(200)}
    docs = {g: [(k, t.strip()) for k, t in c] for g, c in docs.items()}
    assert merged(spark, docs, 5) == {g: merge(c, 5) for g, c in docs.items()}


def test_hash_embedding_equals_the_driver_side(spark):
    texts = ["The cat sat, the cat.", "", None, "ÄÖ 42", "—"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = {r.i: r.embeddings for r in E.with_hash_embedding(df, ["i"], "t", 16).collect()}
    for i, t in enumerate(texts):
        assert rows[i] is None if t is None else all(abs(a - b) < 1e-12 for a, b in zip(rows[i], E.hash_vector(t, 16), strict=True))


def scripted(answers, log):
    it = iter(answers)

    def post(url, headers, body):
        log.append((url, body))
        return next(it)

    return post


def test_openai_provider(spark):
    log, waits = [], []
    good = (200, {"data": [{"index": 1, "embedding": [0.0, 2.0]}, {"index": 0, "embedding": [3.0, 4.0]}]})
    p = E.Provider("jina", "m", "http://x", dim=2, post=scripted([(429, {}), (503, {}), good], log), wait=waits.append, clip_chars=3)
    assert E.build(p)(["abcdef", "b"]) == [[0.6, 0.8], [0.0, 1.0]]
    assert waits == [1.0, 2.0] and log[-1][1] == {"model": "m", "input": ["abc", "b"]}
    with pytest.raises(E.ProviderError):
        E.build(E.Provider("openai", post=scripted([(400, {})], []), wait=waits.append))(["a"])
    with pytest.raises(E.ProviderError):
        E.build(E.Provider("openai", attempts=2, post=scripted([(500, {}), (500, {})], []), wait=waits.append))(["a"])
    sent = []
    E.build(E.Provider("openai", dim=7, send_dimensions=True, post=scripted([(200, {"data": []})], sent)))([])
    assert sent[0][1]["dimensions"] == 7


def test_gemini_provider_falls_back_to_single_calls():
    log = []
    one = (200, {"embedding": {"values": [2.0, 0.0]}})
    run = E.build(E.Provider("google", "m", "http://x", dim=2, post=scripted([(404, {}), one, one, one], log)))
    assert run(["a", "b"]) == [[1.0, 0.0]] * 2 and run(["c"]) == [[1.0, 0.0]]
    assert [u.rsplit(":", 1)[1] for u, _ in log] == ["batchEmbedContents", "embedContent", "embedContent", "embedContent"]


def test_custom_provider_as_udf(spark):
    p = E.Provider("custom", embed=lambda texts: [[float(len(t)), 0.0] for t in texts], batch=2)
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "ccc")], "i int, t string")
    assert [r.e for r in df.select("i", E.embed_udf(p)(F.col("t")).alias("e")).orderBy("i").collect()] == [[1.0, 0.0], None, [3.0, 0.0]]
    with pytest.raises(ValueError):
        E.build(E.Provider("nobody"))
    report = E.check_provider(E.Provider("hashing", dim=64))
    assert report["dim_ok"] and report["unit"] and report["closer"]


def test_byte_pair_budget(spark):
    """The windows and counts of chunks are those of a rank file where the settings name one."""
    import public_tokenizers as P

    from lectern.functions.tokens import _encoding

    path = P.path("byte_bpe_50k.tiktoken")
    code = _encoding(path, P.PATTERN)
    text = "# A\n" + "\n".join(f"- item number {i} of the uncommonly long list" for i in range(30))
    docs = spark.createDataFrame([("f", text)], "file_id string, text string")
    s = Settings(max_tokens=50, overlap_tokens=10, ranks=path, pattern=P.PATTERN)
    rows = chunking.chunk_documents(docs, s).orderBy("chunk_index").collect()
    body = text.split("\n", 1)[1]
    ids = code.encode_ordinary(body)
    want = [code.decode(ids[a : a + 50]) for a in range(0, len(ids) - 50 + 40, 40)]
    assert [r.text_data.split("Content:\n", 1)[1] for r in rows] == want and [r.token_count for r in rows] == [len(code.encode_ordinary(w)) for w in want]
    whole = chunking.baseline_chunks(docs, s).orderBy("chunk_index").collect()
    assert "".join(code.decode(code.encode_ordinary(r.text_data)[: 40 if i < len(whole) - 1 else None]) for i, r in enumerate(whole)) == text
