import random

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as TX
from lectern.functions.tokens import bpe_count, bpe_windows, regex_tokens, stride, token_windows


def values(spark, texts, column):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("t"))).collect()]


def test_clean_lines(spark):
    cases = {
        "Firefox \nRain fell on the harbour.": "Rain fell on the harbour.",
        "3 of 12 \nNobody heard the bell.": "Nobody heard the bell.",
        "4/9/25, 07:15 \nThe ferry came late.": "The ferry came late.",
        "http://www.gutenberg.org/ebooks/2701 \nA line that stays.": "A line that stays.",
        "firefox\n1 of 10\n\n6/6/26, 12:00": "",
        "  indented  \n \t \nfirefox is a browser": "  indented  \n\nfirefox is a browser",
    }
    assert values(spark, cases, TX.clean_lines) == list(cases.values())


def test_titles(spark):
    paths = ["/data/in/annual_report_draft.pdf", "/a-b/c.d/quarterly.cash-flow-v3.1.pdf", "été_ÀB9c.pdf"]
    assert values(spark, paths, TX.title_of_path) == ["Annual_Report_Draft", "Quarterly.Cash-Flow-V3.1", "été_àb9c".title()]


def test_sentences(spark):
    texts = ["Dr. Okafor sailed from the U.K. She came back.", "", "  ", None, "J. Doe left! Why? Mr. X knows.  No end"]
    found = values(spark, texts, TX.sentences)
    assert found == [["Dr. Okafor sailed from the U.K.", "She came back."], [], [], None, ["J. Doe left!", "Why?", "Mr. X knows.", "No end"]]


def test_white_space_is_pythons(spark):
    texts = ["\x1c a\x1fb  ", "\x0b\x85", "a  b\tc\n"]
    assert values(spark, texts, TX.trim_ws) == [t.strip() for t in texts]
    assert values(spark, texts, TX.word_count) == [len(t.split()) for t in texts]


def test_strip_context_and_shorten(spark):
    texts = ["Context: A > B\nContent: body ", "Context: A\nContent:\n- x\n- y", "Context: A\nTable Data:\n|", "plain"]
    assert values(spark, texts, TX.strip_context) == ["body", "- x\n- y", texts[2], "plain"]
    long = "x" * 1201
    assert values(spark, ["y", long], lambda c: TX.shorten(c, 1200)) == ["y", "x" * 1200 + TX.CONTEXT_SUFFIX]


def test_citations_are_sorted_and_distinct(spark):
    assert values(spark, ["chk_bbbbbb chk_aaaaaa1 chk_bbbbbb chk_12345 none"], TX.citations) == [["chk_aaaaaa1", "chk_bbbbbb"]]


def windows(tokens, size, overlap):
    """The sequential model."""
    if len(tokens) <= size:
        return ["".join(tokens)]
    out, at = [], 0
    while at < len(tokens):
        end = min(at + size, len(tokens))
        out.append("".join(tokens[at:end]))
        if end == len(tokens):
            break
        at, was = end - overlap, at
        if at >= end or at <= was:
            at = end
    return out


TOOLS = "anvil bellows chisel drill emery file gouge hammer iron jig knife lathe mallet"


@pytest.mark.parametrize(("size", "overlap"), [(10, 3), (10, 12), (10, 10), (5, 0), (13, 3), (3, 1)])
def test_token_windows_equal_the_loop(spark, size, overlap):
    random.seed(size)
    texts = [TOOLS, "", "one", "  lead", "trail \n ", "你好，世界！ 😊🤖 x y"] + [" ".join("w" * random.randint(1, 3) for _ in range(n)) for n in range(0, 60, 3)]
    tokens = values(spark, texts, regex_tokens)
    assert ["".join(t) for t in tokens] == texts
    assert values(spark, texts, lambda c: token_windows(c, size, overlap)) == [windows(t, size, overlap) for t in tokens]


def test_stride():
    assert [stride(10, o) for o in (3, 0, 10, 12, -1)] == [7, 10, 10, 10, 10]


def test_bpe_windows(spark):
    P = pytest.importorskip("public_tokenizers")
    path = P.path("byte_bpe_50k.tiktoken")
    counts = values(spark, [TOOLS, "", None, "<|endoftext|>"], bpe_count(path, P.PATTERN))
    assert counts[1:3] == [0, None] and counts[0] > 13 and counts[3] > 1
    found = values(spark, [TOOLS, "Short text.", ""], bpe_windows(path, P.PATTERN, 10, 3))
    assert len(found[0]) > 1 and found[1:] == [["Short text."], [""]] and found[0][0] == TOOLS[: len(found[0][0])]


def test_bands_and_hits(spark):
    df = spark.createDataFrame([(0.6,), (0.5,), (0.3,), (0.31,)], "s double")
    assert [r[0] for r in df.select(TX.similarity_band(F.col("s"))).collect()] == ["green", "yellow", "red", "yellow"]
    rows = spark.createDataFrame([("Harbour-Log.pdf [x]", "The LOST boys", "Harbour-Log.pdf", ["lost Boys"]), ("Other", "lost boys", "Harbour", ["lost"]), ("P", "t", "P", [])], "t string, x string, d string, s array<string>")
    assert [r[0] for r in rows.select(TX.is_hit(F.col("t"), F.col("x"), F.col("d"), F.col("s"))).collect()] == [True, False, False]
