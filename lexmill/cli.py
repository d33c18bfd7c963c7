"""``python -m lexmill.cli build|search …``: builds a store from a folder of page texts, and searches it."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from lexmill import pipeline
from lexmill.operators.retrieval import search_text
from lexmill.sources.titles import read_pages


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lexmill")
    sub = top.add_subparsers(dest="command", required=True)
    build = sub.add_parser("build", help="extract, chunk, index and encode titles")
    build.add_argument("pages", help="folder of texts, pages parted by form feeds")
    build.add_argument("--titles", type=int, nargs="+", default=[23])
    build.add_argument("--output", default="store")
    build.add_argument("--max-chars", type=int, default=900)
    find = sub.add_parser("search", help="ranked full-text search")
    find.add_argument("query")
    find.add_argument("--store", default="store")
    find.add_argument("--title", type=int)
    find.add_argument("--citation")
    find.add_argument("--limit", type=int, default=5)
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("lexmill").getOrCreate()
    if args.command == "build":
        pages = read_pages(spark, args.pages)
        for name, n in pipeline.run(spark, pages, args.titles, args.output, max_chars=args.max_chars).items():
            print(f"{name}: {n}")
        return 0
    rows, index = pipeline.open_text(spark, args.store)
    found = search_text(spark, rows, index, args.query, title=args.title, citation=args.citation, limit=args.limit).collect()
    for r in found:
        print(f"{r['citation']}  {r['section_heading']}\n{r['title_label']}\n{r['text']}\n{'-' * 40}")
    if not found:
        print("No matches found.")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
