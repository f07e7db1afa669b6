"""python -m lectern COMMAND ...: split, search, rank, raw, pretty, yellow and manifest over files.

With --model ROLE a step asks the model that LECTERN_MODEL_<ROLE> names; without it, it goes by words and delimiters.
"""

from __future__ import annotations

import argparse
import json
from pathlib import Path


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lectern", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    p = commands.add_parser("split", help="split text files into chunk files")
    group = p.add_mutually_exclusive_group(required=True)
    group.add_argument("--files", nargs="+")
    group.add_argument("--files-list")
    p.add_argument("--output-dir", default="split")
    p = commands.add_parser("search", help="judge every chunk of a directory, or the positives of the last pass")
    p.add_argument("--ctx", required=True)
    p.add_argument("--query", required=True)
    p.add_argument("--dir", default="split/chunks")
    p.add_argument("--outdir", default="search_runs")
    p.add_argument("--budget", type=int, default=8192)
    p.add_argument("--least", type=int, default=1)
    p = commands.add_parser("rank", help="order the positives of the last pass")
    p.add_argument("--query", required=True)
    p.add_argument("--dir", default="split/chunks")
    p.add_argument("--runs", default="search_runs")
    p.add_argument("--output", default="rank/order.csv")
    p = commands.add_parser("raw", help="the positives of the last pass as one text")
    p.add_argument("--dir", default="split/chunks")
    p.add_argument("--runs", default="search_runs")
    p.add_argument("--output", default="relevant_raw.txt")
    p = commands.add_parser("pretty", help="a readable file for each group of neighbouring positives")
    p.add_argument("--dir", default="split/chunks")
    p.add_argument("--runs", default="search_runs")
    p.add_argument("--order", default="rank/order.csv")
    p.add_argument("--output", default="pretty")
    p = commands.add_parser("yellow", help="highlight what serves a query in readable files")
    p.add_argument("--query", required=True)
    p.add_argument("--dir", default="pretty")
    p.add_argument("--output", default="yellow")
    for p in commands.choices.values():
        p.add_argument("--model", metavar="ROLE", help="ask the model of this role")
    p = commands.add_parser("manifest", help="list the PDF files of a folder")
    p.add_argument("base")
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    if args.command == "manifest":
        from lectern.sources.files import manifest, visible_pdfs

        print(json.dumps(manifest(visible_pdfs(args.base), args.base), ensure_ascii=False))
        return
    from pyspark.sql import SparkSession

    from lectern import chat
    from lectern.config import Config
    from lectern.models import ChatJudge
    from lectern.plans import commands

    client = Config.from_environment().client(args.model) if args.model else None
    ask = lambda most, as_json=False: chat.chat_with(client, most, as_json)
    spark = SparkSession.builder.appName("lectern").getOrCreate()
    if args.command == "split":
        paths = args.files or [x.strip() for x in Path(args.files_list).read_text(encoding="utf-8").splitlines() if x.strip()]
        more = {"propose": chat.Splitter([ask(256, True)] * 6)} if client else {}
        print(commands.split(spark, paths, args.output_dir, **more))
    elif args.command == "search":
        print(commands.search(spark, args.dir, args.outdir, args.query, args.ctx, args.budget, args.least, ChatJudge(client, args.query, args.ctx) if client else None))
    elif args.command == "raw":
        print(commands.raw(spark, args.dir, args.runs, args.output))
    elif args.command == "pretty":
        print(commands.pretty(spark, args.dir, args.runs, args.order, args.output, chat.Cleaner(ask(8192)) if client else None))
    elif args.command == "yellow":
        print(commands.yellow(spark, args.dir, args.query, args.output, chat.Highlighter((ask(8192), ask(8192)), args.query) if client else None))
    else:
        print(commands.rank(spark, args.dir, args.runs, args.query, args.output, chat.PairJudge(ask(2048, True), args.query) if client else None))


if __name__ == "__main__":
    main()
