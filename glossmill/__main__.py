"""Command line: runs over a table of documents."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from glossmill import drivers


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="glossmill")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, text in (("vocabulary", "documents to a ranked deck"), ("sample", "a seeded sample of sentences")):
        command = commands.add_parser(name, help=text)
        command.add_argument("--documents", required=True, help="parquet table with doc_id and text")
        command.add_argument("--book", required=True, help="name of the run's files")
        command.add_argument("--out", required=True, help="folder of the run's files")
        command.add_argument("--n", type=int, default=100, help="cards or sentences")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    docs, paths = spark.read.parquet(args.documents), drivers.Paths(args.out)
    if args.command == "vocabulary":
        drivers.vocabulary(docs, args.book, paths, args.n)
    else:
        drivers.sample(docs, args.book, paths, args.n).show()


if __name__ == "__main__":
    main()
