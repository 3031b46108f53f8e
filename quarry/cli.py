"""Command line: ``python -m quarry.cli STAGE [options]``."""

from __future__ import annotations

import argparse
import logging
from dataclasses import MISSING, fields

from pyspark.sql import SparkSession

from quarry.config import Config
from quarry.plans.engine import Engine

_STAGES = {"preprocess": "preprocess", "extract": "extract", "import": "import_all", "embed": "embed", "build-kg": "build_graph", "merge-task": "link_tasks", "merge-dataset": "merge_datasets", "separate-task": "separate_tasks", "build": "build", "stats": "statistics"}


def parser() -> argparse.ArgumentParser:
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("--log-level", default="INFO")
    common.add_argument("--log-file")
    for f in fields(Config):
        if f.type in ("str", "int", "float", "str | None") and f.default is not MISSING:
            common.add_argument(f"--{f.name.replace('_', '-')}", type={"int": int, "float": float}.get(f.type, str), default=argparse.SUPPRESS)
    top = argparse.ArgumentParser(prog="quarry", description="Finds datasets for described tasks.")
    sub = top.add_subparsers(dest="stage", required=True)
    for name in _STAGES:
        p = sub.add_parser(name, parents=[common])
        if name == "preprocess":
            p.add_argument("path", nargs="?")
        if name in ("extract", "import"):
            p.add_argument("fingerprint", nargs="?")
    for name in ("search", "qa"):
        p = sub.add_parser(name, parents=[common])
        p.add_argument("task")
        p.add_argument("--top-k", type=int)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = vars(parser().parse_args(argv))
    handlers = [logging.StreamHandler(), *([logging.FileHandler(args["log_file"], mode="a")] if args["log_file"] else [])]
    logging.basicConfig(level=args["log_level"].upper(), handlers=handlers, force=True)
    names = {f.name for f in fields(Config)}
    engine = Engine(spark or SparkSession.builder.appName("quarry").getOrCreate(), Config(**{k: v for k, v in args.items() if k in names}))
    if args["stage"] == "search":
        engine.search(args["task"], args["top_k"]).show(truncate=False)
    elif args["stage"] == "qa":
        print(engine.qa(args["task"], args["top_k"]))
    else:
        extra = [args[k] for k in ("path", "fingerprint") if args.get(k)]
        out = getattr(engine, _STAGES[args["stage"]])(*extra)
        if out is not None:
            out.show(truncate=False)


if __name__ == "__main__":
    main()
