"""Command line: reindex, rebuild-index, compact, evaluate, propose-config, parse, documents. Spark's own settings come from the environment or spark-submit."""

from __future__ import annotations

import argparse
import importlib
import json
import os
import sys

from pyspark.sql import SparkSession

from .config import ConfigError, load_config


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lakescribe")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, about: str) -> argparse.ArgumentParser:
        p = commands.add_parser(name, help=about)
        p.add_argument("--config", default="corpus_config.yaml")
        p.add_argument("--base", default=os.environ.get("CORPUS_DB_PATH", "data"), help="where the tables lie")
        return p

    p = command("reindex", "index what has changed")
    p.add_argument("--full", action="store_true", help="index everything anew")
    p.add_argument("--dry-run", action="store_true", help="only say what would change; a full run is done all the same")
    p = command("rebuild-index", "build the full-text index anew")
    p.add_argument("--query", default="inundaciones", help="tried on the new index")
    p = command("compact", "rewrite the table without deleted rows and the index as one segment")
    p.add_argument("--vacuum", action="store_true", help="delete what older versions hold")
    p = command("evaluate", "retrieval quality over a data set of queries")
    p.add_argument("dataset")
    p.add_argument("--mode", default="hybrid", choices=["hybrid", "semantic", "fts"])
    p.add_argument("--limit", type=int, default=10)
    p.add_argument("--label", default="eval")
    p.add_argument("--output", default="results")
    p.add_argument("--rerank", metavar="MODULE:FUNCTION", help="rank results anew by this scorer: a function of the query and the shown results")
    p = command("propose-config", "ask a model for a configuration, from a sample of files")
    p.add_argument("directories", nargs="+")
    p.add_argument("--model", metavar="MODULE:FUNCTION", required=True, help="a function of the prompt")
    p.add_argument("--output", default="corpus_config.yaml")
    p.add_argument("--max-files", type=int, default=5)
    p = command("parse", "Markdown, JSON and images of PDF files")
    p.add_argument("directory")
    p.add_argument("output")
    p.add_argument("--file", help="only this file of the directory")
    p.add_argument("--extractor", metavar="MODULE:FUNCTION", required=True, help="a function of a file's bytes that gives its pages")
    p.add_argument("--recognise", metavar="MODULE:FUNCTION", help="a function of a picture and a language that gives words and confidences")
    p.add_argument("--language", default="spa")
    p = command("documents", "how many chunks of each document type there are")
    return top


def function(name: str):
    """The function ``module:name``."""
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    given = parser().parse_args(arguments)
    if given.command == "propose-config":
        from .plans.analyse import propose_config

        try:
            print(propose_config(spark or SparkSession.builder.appName("lakescribe").getOrCreate(), given.directories, function(given.model), given.output, given.max_files))
        except ConfigError as e:
            print(e, file=sys.stderr)
            return 1
        return 0
    if given.command == "parse":
        from .plans.parse import parse_files

        spark = spark or SparkSession.builder.appName("lakescribe").getOrCreate()
        done = parse_files(spark, given.directory, given.output, function(given.extractor), function(given.recognise) if given.recognise else None, given.file, given.language)
        done.orderBy("doc").show(1000, truncate=False)
        return 1 if done.filter("error IS NOT NULL").head(1) else 0
    try:
        config = load_config(given.config)
    except ConfigError as e:
        print(e, file=sys.stderr)
        return 1
    spark = spark or SparkSession.builder.appName("lakescribe").getOrCreate()
    from .plans import evaluate, reindex
    from .plans.engine import Engine
    from .sources.files import scan_evaluation

    if given.command == "reindex":
        print(reindex.run(spark, config, given.base, full_run=given.full, dry_run=given.dry_run))
    elif given.command == "rebuild-index":
        try:
            n, found = reindex.rebuild_text_index(spark, config, given.base, given.query)
        except ValueError as e:
            print(e, file=sys.stderr)
            return 1
        print(f"{n} chunks, {found.count()} found for {given.query!r}")
    elif given.command == "compact":
        print(f"version {reindex.compact(spark, config, given.base, given.vacuum)}")
    elif given.command == "evaluate":
        scorer = function(given.rerank) if given.rerank else None
        per_query = evaluate.evaluate(Engine.open(spark, given.base, config=config, scorer=scorer), scan_evaluation(spark, given.dataset), given.mode, given.limit, scorer is not None)
        values = evaluate.report(per_query, given.mode, given.limit, scorer is not None, given.rerank)
        print(json.dumps({k: v for k, v in values.items() if k != "per_query"}, indent=2))
        print(evaluate.save_report(values, given.label, given.output))
    else:
        Engine.open(spark, given.base, config=config).list_document_types().show(truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
