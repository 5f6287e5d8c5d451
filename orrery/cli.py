"""Command line: ``python -m orrery inventory | replay-pairs | replay-hard-negatives | export``. Reports are JSON."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .operators import pair_benchmark
from .plans import replay
from .sources import caches, jsonl


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="orrery")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, *options: tuple, out: bool = True) -> None:
        c = commands.add_parser(name)
        for flag, kwargs in options:
            c.add_argument(flag, **kwargs)
        if out:
            c.add_argument("--output", help="also write the report here")

    need = {"required": True}
    command("inventory", ("root", {}), ("--cache-db", {}))
    command("replay-pairs", ("--snapshot", need), ("--manifest-dir", need), ("--seed", {"type": int, "default": 118}))
    command("replay-hard-negatives", ("--root", need), ("--cache-a", need), ("--cache-b", need))
    command("export", ("--root", need), ("--cache", need), ("--archive", need))
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("orrery").getOrCreate()
    if args.command == "inventory":
        report = caches.inventory(spark, args.root, args.cache_db)
    elif args.command == "replay-pairs":
        report = pair_benchmark.replay_pairs(spark, args.snapshot, args.manifest_dir, args.seed)
    elif args.command == "replay-hard-negatives":
        report = replay.replay_hard_negatives(spark, args.root, args.cache_a, args.cache_b)
    else:
        report = replay.export_projection(spark, args.root, args.cache, args.archive)
    print(jsonl.write_report(report, args.output), end="")
    return 0
