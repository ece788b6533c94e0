import json

import pytest

from lectern.__main__ import main
from lectern.api import Library


@pytest.fixture(scope="module")
def library(spark):
    lib = Library(spark, "lectern_api")
    lib.create_tables()
    lib.wipe()
    docs = spark.createDataFrame(
        [("Ferry Log", "# Crossing\nThe ferry sailed over the sea to Lowhaven. The night crew waited there.\n\n# Quay\nMarta stayed in Highport with her mother."), ("Ledger", "Nora sold her lamp. Otto sold his watch."), ("Empty", " ")],
        "title string, text string",
    )
    assert lib.ingest(docs, "b1")["documents"] == 2
    yield lib
    lib.wipe()


def test_lookups_and_search(spark, library):
    assert library.ping() and library.list_documents().count() == 2
    log = library.resolve("ferry")
    assert library.get_document(log).first().title == "Ferry Log" and library.resolve("nobody") is None
    hit = library.search_all("Who sold a watch?", 1).first()
    assert hit.document_title == "Ledger" and library.read_chunk(hit.chunk_id).first().text == hit.text_data
    assert library.search_document("Lowhaven sea", "Ferry Log", 1).first().text_data.startswith("Context: Crossing")
    assert library.search_document("x", "nobody").count() == 0
    asked = spark.createDataFrame([(1, "night crew of Lowhaven"), (2, "lamp and watch")], "query_id int, query string")
    best = {r.query_id: r.text_data for r in library.search_batch(asked, 1).collect()}
    assert "Lowhaven" in best[1] and "watch" in best[2]
    assert library.ingest_status("b1").first().status == "SUCCESS" and library.check_embeddings()["dim_ok"]


def test_ask(library):
    script = iter(['Action: search_all_documents\nAction Input: {"query": "watch"}', "Final Answer: Otto sold it [chk_000000]."])
    got = library.ask("Who?", lambda instruction, context: next(script))
    assert got["answer"] == "Otto sold it [[unverified citation removed]]." and got["unverified_citations"] == ["chk_000000"]


def test_evaluation(spark, library):
    docs = spark.createDataFrame([("A.pdf", "Needles are sharp. Hay is soft."), ("B.pdf", "Boats float on water.")], "title string, text string")
    made = {r.strategy: (r.documents, r.chunks, r.skipped) for r in library.prepare_corpus(docs).collect()}
    assert made == {"semantic": (2, 2, 0), "baseline": (2, 2, 0)}
    again = {r.strategy: (r.documents, r.skipped) for r in library.prepare_corpus(docs).collect()}
    assert again == {"semantic": (0, 2), "baseline": (0, 2)}
    forced = {r.strategy: (r.documents, r.skipped) for r in library.prepare_corpus(docs, force=True).collect()}
    assert forced == {"semantic": (2, 0), "baseline": (2, 0)} and library.corpus().count() == 4
    asked = spark.createDataFrame([("sharp needles", "A.pdf", ["SHARP"]), ("water", "A.pdf", ["water"])], "query string, document_title string, expected_substrings array<string>")
    found = library.evaluate(asked)
    assert {(r.strategy, r.k): r.hit_rate for r in found["hit_rates"].collect()} == {(s, k): 0.5 for s in ("semantic", "baseline") for k in (1, 3, 5)}
    assert library.list_documents().count() == 2
    assert library.cleanup_corpus() == 4 and library.corpus().count() == 0


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "sea_story.md").write_text("# Sea\nThe whale swam in the deep blue sea.")
    (tmp_path / "q.json").write_text(json.dumps([{"query": "whale", "document_title": "Sea_Story", "expected_substrings": ["deep blue"], "reference_answer": ""}]))
    run = lambda *args: main(["--database", "lectern_cli", *args], spark)
    run("init-db", "--wipe")
    run("ingest", str(tmp_path / "docs"))
    run("query", "sea_story", "whale", "--top", "1")
    run("check-embeddings")
    run("evaluate", "--dataset", str(tmp_path / "q.json"), "--corpus", str(tmp_path / "docs"), "--markdown", str(tmp_path / "r.md"), "--cleanup")
    said = capsys.readouterr().out
    assert '"documents": 1' in said and "whale swam" in said and "100.0%" in (tmp_path / "r.md").read_text()
    run("init-db", "--wipe")
