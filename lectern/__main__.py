"""``python -m lectern``: init-db, ingest, query, check-embeddings, evaluate."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from lectern.api import Library
from lectern.operators.evaluate import report
from lectern.sources.files import read_questions, read_texts


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="lectern")
    parser.add_argument("--database", default="lectern")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("init-db").add_argument("--wipe", action="store_true")
    commands.add_parser("check-embeddings")
    one = commands.add_parser("ingest")
    one.add_argument("path")
    one.add_argument("--pdf", action="store_true")
    one.add_argument("--fast", action="store_true")
    one = commands.add_parser("query")
    one.add_argument("document")
    one.add_argument("text")
    one.add_argument("--top", type=int, default=3)
    one = commands.add_parser("evaluate")
    one.add_argument("--dataset", required=True)
    one.add_argument("--corpus", required=True)
    one.add_argument("--force", action="store_true")
    one.add_argument("--cleanup", action="store_true")
    one.add_argument("--markdown")
    args = parser.parse_args(argv)

    spark = spark or SparkSession.builder.appName("lectern").getOrCreate()
    library = Library(spark, args.database)
    library.create_tables()
    if args.command == "init-db":
        if args.wipe:
            library.wipe()
    elif args.command == "check-embeddings":
        print(json.dumps(library.check_embeddings(), indent=2))
    elif args.command == "ingest":
        print(json.dumps(library.ingest_folder(args.path, args.pdf, args.fast)))
    elif args.command == "query":
        for r in library.search_document(args.text, args.document, args.top).collect():
            print(f"{r.similarity:.2%} {r.chunk_id} {r.text_data[:200]}")
    else:
        library.prepare_corpus(read_texts(spark, args.corpus), args.force).show()
        found = library.evaluate(read_questions(spark, args.dataset))
        table = report(found["hit_rates"], found["mrr"])
        print(table)
        if args.markdown:
            with open(args.markdown, "w") as f:
                f.write(table + "\n")
        if args.cleanup:
            print(library.cleanup_corpus())


if __name__ == "__main__":
    main()
