"""Command line: ``ingest-chunks``, ``ingest``, ``query``, ``qa`` and ``export`` over tables in one folder."""

from __future__ import annotations

import argparse
import importlib
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweave import plugins
from graphweave.config import EngineConfig
from graphweave.errors import EngineError
from graphweave.operators import graph
from graphweave.plans import pipeline
from graphweave.sources import files

#: The key of each table of the graph, checked before the tables are written.
KEYS = {"chunk_nodes": ["chunk_id"], "entity_nodes": ["name"], "document_nodes": ["file_hash"], "chunks": ["chunk_id"]}


def _plugin(path: str | None, default: Callable) -> Callable:
    """``module:function``, or the default."""
    if not path:
        return default
    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name)


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="graphweave")
    verbs = parser.add_subparsers(dest="verb", required=True)
    chunks = verbs.add_parser("ingest-chunks", help="clean, chunk and store the markdown files of a folder")
    whole = verbs.add_parser("ingest", help="the same, with entities, edges and the graph's tables")
    for verb in (chunks, whole):
        verb.add_argument("source")
        verb.add_argument("output")
        verb.add_argument("--clear-graph", action="store_true", help="overwrite the stored tables instead of adding to them")
        verb.add_argument("--json", action="store_true", help="also write the JSON exports")
    whole.add_argument("--extractor", help="module:function from a chunk's id and text to a reply")
    whole.add_argument("--embedder", help="module:function from a text to a vector")
    find = verbs.add_parser("query", help="answer a question from the stored tables")
    find.add_argument("question")
    find.add_argument("output")
    many = verbs.add_parser("qa", help="answer every line of a file, or of the standard input; failures are kept with their question")
    many.add_argument("output")
    many.add_argument("questions", nargs="?")
    for verb in (find, many):
        verb.add_argument("--generator", help="module:function from a prompt to an answer")
        verb.add_argument("--embedder", help="module:function from a text to a vector")
    export = verbs.add_parser("export", help="write the stored tables as JSON")
    export.add_argument("output")
    return parser


def _ingest(spark: SparkSession, args: argparse.Namespace) -> None:
    documents = files.read_markdown(spark, args.source)
    if args.verb == "ingest":
        embedder = _plugin(args.embedder, plugins.hashed_words)
        tables = pipeline.ingest(documents, _plugin(args.extractor, plugins.capitalised_names), embedder)
    else:
        tables = pipeline.ingest_chunks(documents, EngineConfig.from_environment())
    for name, key in KEYS.items():
        if name in tables:
            graph.check_key(tables[name], key)
    files.write_tables(tables, args.output, "overwrite" if args.clear_graph else "append")
    print(spark.read.parquet(f"{args.output}/chunks").count(), "chunks")
    if args.json:
        files.write_json(spark, args.output)


def _answers(spark: SparkSession, args: argparse.Namespace, questions: DataFrame) -> DataFrame:
    generate = plugins.with_retries(_plugin(args.generator, plugins.extractive_answer))
    return pipeline.answer(questions, files.read_stored(spark, args.output), _plugin(args.embedder, plugins.hashed_words), generate)


def main(arguments: list[str] | None = None) -> int:
    args = _parser().parse_args(arguments)
    spark = SparkSession.builder.appName("graphweave").getOrCreate()
    try:
        if args.verb in ("ingest", "ingest-chunks"):
            _ingest(spark, args)
        elif args.verb == "export":
            files.write_json(spark, args.output)
        elif args.verb == "query":
            row = _answers(spark, args, spark.createDataFrame([(0, args.question)], "question_id bigint, question string")).first()
            print(row.error or row.answer, row.context, sep="\n\n")
        else:
            if args.questions:
                lines = spark.read.text(args.questions).select(F.trim("value").alias("question"))
            else:
                lines = spark.createDataFrame([(x.strip(),) for x in sys.stdin], "question string")
            lines = lines.where("question != ''").distinct().select(F.xxhash64("question").alias("question_id"), "question")
            _answers(spark, args, lines).write.mode("overwrite").parquet(f"{args.output}/answers")
            for row in spark.read.parquet(f"{args.output}/answers").orderBy("question").limit(20).collect():
                print(f"{row.question}\n  {row.error or row.answer}")
    except EngineError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
