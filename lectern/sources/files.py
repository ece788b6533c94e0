"""Readers of documents and evaluation sets."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.config import DEFAULT, Settings
from lectern.functions.text import clean_lines, title_of_path

QUESTIONS = "query string, document_title string, expected_substrings array<string>, reference_answer string"
PAGES_A_RANGE = 50


def read_texts(spark: SparkSession, path: str, glob: str = "*.{md,txt}") -> DataFrame:
    """Rows (path, title, text) of text or markdown files, boilerplate lines removed."""
    raw = spark.read.option("pathGlobFilter", glob).text(path, wholetext=True).withColumn("path", F.col("_metadata.file_path"))
    return raw.select("path", title_of_path(F.regexp_replace("path", r"\.(md|txt)$", ".pdf")).alias("title"), clean_lines(F.col("value")).alias("text"))


def judge_uploads(files: DataFrame, s: Settings = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused) of rows (path, length, content, ...): ``.pdf`` in any case, and not beyond the size cap."""
    reason = F.when(~F.lower("path").endswith(".pdf"), "not a PDF file").when(F.col("length") > s.max_upload_bytes, "too large")
    judged = files.withColumn("name", F.regexp_extract("path", r"([^/]*)$", 1)).withColumn("reason", reason)
    return judged.where("reason IS NULL").drop("reason"), judged.where("reason IS NOT NULL").drop("content")


def accept_uploads(spark: SparkSession, path: str, s: Settings = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused) files of a landing folder."""
    return judge_uploads(spark.read.format("binaryFile").load(path), s)


def pdf_pages(content: bytes, first: int, last: int, fast: bool) -> str:
    """The markdown (or plain text) of a page range; needs PyMuPDF on the executors."""
    import pymupdf

    with pymupdf.open(stream=content, filetype="pdf") as doc:
        if fast:
            return "\n\n".join(doc[i].get_text() for i in range(first, last))
        import pymupdf4llm

        return pymupdf4llm.to_markdown(doc, pages=list(range(first, last)))


def pdf_page_count(content: bytes) -> int:
    import pymupdf

    with pymupdf.open(stream=content, filetype="pdf") as doc:
        return doc.page_count


def parse_pdfs(files: DataFrame, fast: bool = False, pages: Callable = pdf_pages, count: Callable = pdf_page_count, step: int = PAGES_A_RANGE) -> DataFrame:
    """Rows (path, title, text) of PDF files (path, content). Ranges of ``step`` pages are tasks of their own and joined in order."""

    def ranges(batches):
        for b in batches:
            rows = [(p, c, a, min(a + step, n)) for p, c, n in ((p, bytes(c), count(bytes(c))) for p, c in zip(b.path, b.content, strict=True)) for a in range(0, max(n, 1), step)]
            yield pd.DataFrame(rows, columns=["path", "content", "first", "last"])

    def render(batches):
        for b in batches:
            yield pd.DataFrame({"path": b.path, "first": b["first"], "part": [pages(bytes(c), a, z, fast) for c, a, z in zip(b.content, b["first"], b["last"], strict=True)]})

    cut = files.select("path", "content").mapInPandas(ranges, "path string, content binary, first int, last int")
    parts = cut.repartition("path", "first").mapInPandas(render, "path string, first int, part string")
    whole = parts.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "part"))), lambda r: r["part"]), "\n\n").alias("raw"))
    return whole.select("path", title_of_path(F.col("path")).alias("title"), clean_lines(F.col("raw")).alias("text"))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """An evaluation set: a JSON array of entries."""
    return spark.read.schema(QUESTIONS).option("multiLine", True).json(path)


def question_titles(questions: DataFrame) -> DataFrame:
    return questions.select("document_title").distinct().orderBy("document_title")
