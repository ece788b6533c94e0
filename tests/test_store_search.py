import json
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.config import Settings
from lectern.functions.embedding import ProviderError, hash_vector
from lectern.operators import agent, chunking, evaluate, search, store
from lectern.sources import files as sources
from lectern.streaming.ingest import arriving_files, arriving_texts, ingest_stream


@pytest.fixture(scope="module")
def vectors(spark):
    random.seed(2)
    data = [(f"c{i}", f"f{i % 3}", i, f"text {i}", [random.gauss(0, 1) for _ in range(8)]) for i in range(60)]
    data += [("z", "f0", 99, "zero", [0.0] * 8), ("n", "f0", 98, "null", None), ("o", "orphan", 97, "orphan", [1.0] * 8), ("c0b", "f0", 0, "tie", data[0][4])]
    return spark.createDataFrame(data, "chunk_id string, file_id string, chunk_index long, text_data string, embeddings array<double>").cache()


@pytest.fixture(scope="module")
def catalog(spark):
    return spark.createDataFrame([(f"f{i}", f"Title {i}", "x") for i in range(3)], "id string, title string, extracted_text string")


def brute(rows, q, k):
    def far(v):
        a, b = math.sqrt(sum(x * x for x in v)), math.sqrt(sum(x * x for x in q))
        return math.inf if a * b == 0 else round(1 - sum(x * y for x, y in zip(v, q, strict=True)) / (a * b), 9)

    return [r.chunk_id for r in sorted((r for r in rows if r.embeddings is not None), key=lambda r: (far(r.embeddings), r.chunk_id))[:k]]


def test_top_k(spark, vectors, catalog):
    rows = vectors.collect()
    q = rows[0].embeddings
    hits = search.top_k(vectors, q, 5, "f0")
    assert "TakeOrderedAndProject" in hits._jdf.queryExecution().executedPlan().toString()
    assert [r.chunk_id for r in hits.collect()] == brute([r for r in rows if r.file_id == "f0"], q, 5) and hits.first().chunk_id == "c0"
    known = [r for r in rows if r.file_id != "orphan"]
    got = search.search_all(vectors, catalog, q, 7).collect()
    assert [r.chunk_id for r in got] == brute(known, q, 7) and got[0].document_title == "Title 0" and abs(got[0].similarity - 1) < 1e-9
    everything = search.top_k(vectors, q, 100).collect()
    assert len(everything) == len(rows) - 1 and everything[-1].chunk_id == "z"


@pytest.mark.parametrize("limit", [20_000, 3])
def test_batch_top_k(spark, vectors, monkeypatch, limit):
    monkeypatch.setattr(search, "BROADCAST_QUERIES", limit)
    rows = vectors.collect()
    asked = spark.createDataFrame([(i, rows[i].embeddings) for i in range(10)] + [(11, None)], "query_id int, query_vector array<double>")
    got: dict = {}
    for r in search.batch_top_k(vectors.repartition(4), asked, 4, by=["file_id"]).orderBy("query_id", "file_id", "rank").collect():
        got.setdefault((r.query_id, r.file_id), []).append(r.chunk_id)
    for i in range(10):
        for f in ("f0", "f1", "f2", "orphan"):
            assert got[i, f] == brute([r for r in rows if r.file_id == f], rows[i].embeddings, 4)
    assert 11 not in {i for i, _ in got}


def test_window_group_limit(spark, vectors):
    pairs = vectors.select("chunk_id", "file_id", F.col("chunk_index").alias("distance"))
    ranked = search.rank_pairs(pairs, 2, "file_id", "chunk_id")
    assert "WindowGroupLimit" in ranked._jdf.queryExecution().executedPlan().toString() and ranked.where("file_id = 'f1'").count() == 2


def test_lsh_finds_most(spark, vectors):
    rows = [r for r in vectors.collect() if r.embeddings and any(r.embeddings)]
    index, planes = search.lsh_index(vectors, 8, tables=16, bits=3)
    found = total = 0
    for r in rows[:8]:
        got = {x.chunk_id for x in search.lsh_top_k(index, planes, r.embeddings, 5).collect()}
        found, total = found + len(got & set(brute(rows, r.embeddings, 5))), total + 5
    assert found / total > 0.8


def test_lsh_defaults_find_nine_of_ten(spark):
    path = "/root/testdata/sf0.1/embeddings.parquet"
    if not os.path.exists(path):
        pytest.skip("the driver's tables are not here")
    table = spark.read.parquet(path).select("vec_id", "embedding")
    ids, x = zip(*table.orderBy("vec_id").collect(), strict=True)
    x = np.array(x, float)
    index, _ = search.lsh_index(table, x.shape[1], vector="embedding")
    rows = index.orderBy("vec_id", "table").select("bucket").toPandas()["bucket"].to_numpy().reshape(len(ids), -1)
    met = np.zeros((len(ids), len(ids)), bool)
    for code in rows.T:
        met |= code[:, None] == code[None]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = np.argsort(-(unit @ unit.T), axis=1)[:, 1:10]  # the vector itself is left out
    assert np.take_along_axis(met, near, 1).mean() >= 0.9


def test_lookups(spark, catalog, vectors):
    many = spark.createDataFrame([("id1", "Alpha Beta"), ("id2", "beta"), ("beta", "zzz"), ("id3", "a_c"), ("id4", "abc")], "id string, title string")
    assert store.resolve(many, "beta").first().id == "beta" and store.resolve(many, "BETA").first().id == "id2"
    assert store.resolve(many, "a_c").first().id == "id3" and store.resolve(many, "nothing").count() == 0
    assert store.get_document(catalog, "f1").first().title == "Title 1" and store.get_document(catalog, "no").count() == 0


def test_new_files(spark):
    docs = spark.createDataFrame([("b", "same"), ("a", "same"), ("c", "old"), ("d", " "), ("e", None)], "title string, text string")
    full, refused = store.split_empty(docs)
    assert full.count() == 3 and refused.count() == 2
    known = store.as_files(docs.where("title = 'c'"))
    assert [(r.title, r.extracted_text) for r in store.new_files(store.as_files(full), known).collect()] == [("a", "same")]
    assert store.duplicates(store.as_files(full), known).count() == 1


def test_store_ingest_is_repeatable(spark):
    s = store.Store(spark, "lectern_test")
    s.create_tables()
    s.wipe()
    assert s.ping()
    docs = spark.createDataFrame([("T1", "# A\nSome words here. More words."), ("T2", "Other text.")], "title string, text string")
    chunker = chunking.chunk_documents
    assert s.ingest(docs, "b1", chunker) == {"documents": 2, "chunks": 2}
    assert s.ingest(docs, "b1", chunker)["documents"] == 0 and s.chunks().count() == 2

    def broken(df):
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        s.ingest(spark.createDataFrame([("T3", "New.")], "title string, text string"), "b2", broken)
    assert s.files().count() == 2 and [r.status for r in s.status("b2").collect()] == ["FAILURE"]
    s.delete("no such id")
    s.delete(s.files().where("title = 'T1'").first().id)
    assert s.files().count() == 1 and s.chunks().count() == 1
    assert s.ingest(docs, "b4", chunker) == {"documents": 1, "chunks": 1} and s.files().count() == 2 and s.chunks().count() == 2
    s.wipe()
    assert s.files().count() == 0


def test_batches_of_one_name_keep_their_chunks(spark):
    s = store.Store(spark, "lectern_names")
    s.create_tables()
    s.wipe()
    one = lambda text: spark.createDataFrame([(text[:3], text)], "title string, text string")
    for text in ("First words.", "Second words.", "First words."):
        s.ingest(one(text), "x", chunking.chunk_documents)
    assert s.files().count() == 2 and {r.text_data for r in s.chunks().collect()} == {"First words.", "Second words."}
    assert [r.documents for r in s.status("x").orderBy("at").collect()] == [1, 1, 0]
    s.wipe()


def test_a_crash_between_the_writes_leaves_nothing_that_is_read(spark, monkeypatch):
    s = store.Store(spark, "lectern_crash")
    s.create_tables()
    s.wipe()
    docs = spark.createDataFrame([("A", "Some text."), ("B", "More text.")], "title string, text string")
    names, real = [], store.Store.name

    def failing(self, table):
        names.append(table)
        if names[-2:] == ["doc_chunks", "files"]:
            raise RuntimeError("crash")
        return real(self, table)

    monkeypatch.setattr(store.Store, "name", failing)
    with pytest.raises(RuntimeError):
        s.ingest(docs, "b", chunking.chunk_documents)
    monkeypatch.setattr(store.Store, "name", real)
    assert spark.table("lectern_crash.doc_chunks").count() == 2 and s.files().count() == 0 and s.chunks().count() == 0
    assert s.ingest(docs, "b", chunking.chunk_documents) == {"documents": 2, "chunks": 2} and s.chunks().count() == 2
    # Two runs that store the same text at once.
    twin = spark.table("lectern_crash.files").withColumn("run", F.lit("zzz"))
    twin.write.mode("append").insertInto("lectern_crash.files")
    assert s.files().count() == 2 and s.chunks().count() == 2
    s.delete(s.files().where("title = 'A'").first().id)
    assert [r.title for r in s.files().collect()] == ["B"] and s.chunks().count() == 1
    s.vacuum()
    assert s.chunks().count() == 1 == spark.table("lectern_crash.doc_chunks").count() == spark.table("lectern_crash.files").count()
    spark.table("lectern_crash.files").write.saveAsTable("lectern_crash.files_kept")
    spark.sql("TRUNCATE TABLE lectern_crash.files")
    s.create_tables()
    assert [r.title for r in s.files().collect()] == ["B"] and s.ingest(docs, "b", chunking.chunk_documents)["documents"] == 1
    s.wipe()


def test_streams_ingest_each_text_once(spark, tmp_path):
    s = store.Store(spark, "lectern_stream")
    s.create_tables()
    s.wipe()
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "first_doc.md").write_text("# A\nHello there. Good day.")
    (folder / "second.md").write_text("1 of 2\nOther words here.")
    run = lambda check: ingest_stream(arriving_texts(spark, str(folder), 1), s, chunking.chunk_documents, str(tmp_path / check)).awaitTermination()
    run("check")
    assert {r.title for r in s.files().collect()} == {"First_Doc", "Second"} and s.chunks().count() == 2
    (folder / "copy.md").write_text("Other words here.")
    run("check")
    assert s.files().count() == 2 and s.chunks().count() == 2
    (folder / "third.md").write_text("A third one.")
    run("another stream's")
    assert s.files().count() == 3 and s.chunks().count() == 3
    s.wipe()


def test_pdf_stream_cleans_its_folder(spark, tmp_path):
    s = store.Store(spark, "lectern_pdf")
    s.create_tables()
    s.wipe()
    folder = tmp_path / "in"
    folder.mkdir()
    pages, count = lambda c, a, z, fast: f"{c.decode()} {a}-{z}.", lambda c: 1
    render = lambda files: sources.parse_pdfs(files, pages=pages, count=count)
    for n, name in enumerate(("one.pdf", "two.PDF", "notes.txt", "large.pdf")):
        (folder / name).write_text("x" * 100 if name == "large.pdf" else f"Text {n}")
        ingest_stream(arriving_files(spark, str(folder), 1, "delete"), s, chunking.chunk_documents, str(tmp_path / "check"), prepare=lambda b: render(sources.judge_uploads(b, Settings(max_upload_bytes=50))[0])).awaitTermination()
    assert {(r.title, r.extracted_text) for r in s.files().collect()} == {("One", "Text 0 0-1."), ("Two.Pdf", "Text 1 0-1.")}
    assert not (folder / "one.pdf").exists()
    s.wipe()


def test_sources(spark, tmp_path):
    (tmp_path / "a_b.md").write_text("Firefox\n# H\ntext")
    row = sources.read_texts(spark, str(tmp_path)).first()
    assert (row.title, row.text) == ("A_B", "# H\ntext")
    (tmp_path / "x.PDF").write_bytes(b"1234")
    (tmp_path / "big.pdf").write_bytes(b"12345678")
    (tmp_path / "q.json").write_text(json.dumps([{"query": "q", "document_title": "B", "expected_substrings": ["x"], "reference_answer": "r"}, {"query": "p", "document_title": "A", "expected_substrings": [], "reference_answer": ""}]))
    good, bad = sources.accept_uploads(spark, str(tmp_path), Settings(max_upload_bytes=5))
    assert [r.name for r in good.collect()] == ["x.PDF"] and {r.name: r.reason for r in bad.collect()}["big.pdf"] == "too large"
    assert [r.document_title for r in sources.question_titles(sources.read_questions(spark, str(tmp_path / "q.json"))).collect()] == ["A", "B"]
    parsed = sources.parse_pdfs(good, pages=lambda c, a, z, fast: f"p{a}-{z}", count=lambda c: 7, step=3).first()
    assert parsed.text == "p0-3\n\np3-6\n\np6-7" and parsed.title == "X.PDF".title().replace(".Pdf", ".Pdf")


def test_evaluation(spark):
    questions = spark.createDataFrame([(1, "A", ["needle"]), (2, "A", ["absent"]), (3, "B", ["x"])], "query_id int, document_title string, expected_substrings array<string>")
    ranked = spark.createDataFrame([(1, "s", 1, "A", "hay"), (1, "s", 2, "A", "Needle!"), (2, "s", 1, "A", "hay"), (3, "s", 1, "A", "x"), (3, "b", 1, "B", "X")], "query_id int, strategy string, rank long, title string, text string")
    names = spark.createDataFrame([("s",), ("b",)], "strategy string")
    hits = evaluate.first_hits(ranked, questions, names).cache()
    assert {(r.query_id, r.strategy): r.first_hit_rank for r in hits.collect()} == {(1, "s"): 2, (1, "b"): None, (2, "s"): None, (2, "b"): None, (3, "s"): None, (3, "b"): 1}
    rates = {(r.strategy, r.k): r.hit_rate for r in evaluate.hit_rates(hits).collect()}
    assert rates["s", 1] == 0 and abs(rates["s", 3] - 1 / 3) < 1e-12 and abs(rates["b", 1] - 1 / 3) < 1e-12
    assert {r.strategy: round(r.mrr, 6) for r in evaluate.mrr(hits).collect()} == {"s": round(1 / 6, 6), "b": round(1 / 3, 6)}
    assert evaluate.misses(hits).count() == 4 and "| b | 33.3% |" in evaluate.report(evaluate.hit_rates(hits), evaluate.mrr(hits))
    assert evaluate.hit_rates(hits.limit(0)).count() == 0


@pytest.fixture(scope="module")
def talk(spark):
    files = spark.createDataFrame([("f1", "Harbour-Log.pdf", "t")], "id string, title string, extracted_text string")
    chunks = spark.createDataFrame([("chk_aaaaaa", "f1", 0, "The ferry reached Lowhaven", hash_vector("The ferry reached Lowhaven"))], "id string, file_id string, chunk_index long, text_data string, embeddings array<double>")
    return files, chunks


def run(spark, talk, answers, **options):
    it = iter(answers)
    return agent.Agent(spark, *talk, llm=lambda instruction, context: next(it), **options)


SEARCH = 'Thought: t\nAction: search_all_documents\nAction Input: {"query": "Lowhaven"}'


def test_agent_answers_after_a_search(spark, talk):
    got = run(spark, talk, ["Final Answer: early", SEARCH, "Final Answer: By ferry [chk_aaaaaa] [chk_aaaaaa1] [chk_ffffff]"]).ask("Where?")
    assert [s["type"] for s in got["steps"]] == ["premature_final_answer", "action", "final_answer"]
    assert got["answer"] == f"By ferry [chk_aaaaaa] [{agent.REMOVED}] [{agent.REMOVED}]" and got["unverified_citations"] == ["chk_aaaaaa1", "chk_ffffff"]
    assert json.loads(got["steps"][1]["observation"])[0]["document_title"] == "Harbour-Log.pdf"


def test_agent_errors_and_limits(spark, talk):
    both = SEARCH + "\nFinal Answer: both"
    answer, steps = run(spark, talk, [both, both]).run("q")
    assert answer == "both" and [s["type"] for s in steps] == ["action", "final_answer"]
    script = ["nonsense", 'Action: read_chunk\nAction Input: {"a": {"b": 1}}', "Action: nope\nAction Input: {}", "Action: list_documents\nAction Input: {}", 'Action: read_chunk\nAction Input: {"chunk_id": "no"}', "Action: search_document\nAction Input: {}", 'Action: search_document\nAction Input: {"query": "a", "file_id": "zz"}', "Final Answer: x"]
    answer, steps = run(spark, talk, script).run("q")
    assert answer == agent.TIMEOUT and steps[-1]["type"] == "timeout" and steps[7]["type"] == "premature_final_answer"
    seen = [s["observation"][:20] for s in steps[:7]]
    assert seen[0].startswith("Error: Your output") and seen[1].startswith("Error: the input") and "nope" in steps[2]["observation"] and "Harbour-Log" in steps[3]["observation"]


def test_listings_come_in_pages(spark):
    files = spark.createDataFrame([(f"f{i}", f"T{i // 2}", "t") for i in range(5)], "id string, title string, extracted_text string")
    tool = agent.library_tools(files, files, hash_vector, page=2)["list_documents"]
    given, seen = "{}", []
    while given:
        rows, _, more = tool.call(given).partition("\nThere are more: ask with ")
        given = more
        seen += [r["id"] for r in json.loads(rows)]
    assert seen == ["f0", "f1", "f2", "f3", "f4"] and "added first" in agent.library_tools(files.limit(0), files, hash_vector)["list_documents"].call("{}")


def test_transcripts_are_typed_like_the_loop(spark, talk):
    script = ["Final Answer: early", "junk", SEARCH, SEARCH + "\nFinal Answer: done"]
    _, steps = run(spark, talk, script).run("q")
    rows = [("r", s["iteration"], s["llm_raw_response"], s.get("observation")) for s in steps]
    df = spark.createDataFrame(rows, "run_id string, iteration int, llm_raw_response string, observation string")
    typed = agent.type_steps(agent.parse_transcript(df)).orderBy("iteration").collect()
    assert [r.step_type for r in typed] == [s["type"] for s in steps]


def test_chat_clients():
    waits, log = [], []
    answers = iter([(429, {"error": "try again in 2.5s"}), (200, {"choices": [{"message": {"content": "hi"}}]})])
    assert agent.chat("http://x", "m", post=lambda *a: log.append(a) or next(answers), wait=waits.append)("i", "c") == "hi" and waits == [3.5]
    assert agent.chat("u", "m", style="ollama", post=lambda *a: (200, {"response": "o"}))("i", "c") == "o"
    assert agent.chat("u", "m", style="gemini", post=lambda *a: (200, {"candidates": [{"content": {"parts": [{"text": "g"}]}}]}))("i", "c") == "g"
    with pytest.raises(ProviderError):
        agent.chat("u", "m", style="ollama", post=lambda *a: (429, {}))("i", "c")
    with pytest.raises(ValueError):
        agent.chat("u", "m", style="other")("i", "c")
