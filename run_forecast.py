"""Submit with spark-submit --py-files seqcast.zip run_forecast.py [world size] [--set name=value ...]"""

from __future__ import annotations

import argparse
import json
import logging

from pyspark.sql import SparkSession

from seqcast import Settings
from seqcast.plans.run import run_repeatedly


def parsed(text: str) -> tuple[str, object]:
    """``name=value``, the value as JSON or else as text."""
    name, _, value = text.partition("=")
    try:
        return name, json.loads(value)
    except json.JSONDecodeError:
        return name, value


def main() -> None:
    parser = argparse.ArgumentParser(description="Train on a bar table, forecast its test period and measure.")
    parser.add_argument("world_size", type=int, nargs="?", help="ranks; otherwise from the environment")
    parser.add_argument("--single", action="store_true", help="one rank, loss averaged over samples")
    parser.add_argument("--format", default="csv", help="format of the bar table")
    parser.add_argument("--runs", type=int, default=1, help="repeat the run and report the spread of its times")
    parser.add_argument("--set", type=parsed, action="append", default=[], metavar="NAME=VALUE", help="any setting")
    args = parser.parse_args()
    logging.basicConfig(level=logging.INFO)

    changes = dict(args.set)
    if args.world_size is not None:
        changes["world_size"] = args.world_size
    settings = Settings.from_mapping(changes)
    if "world_size" not in changes:
        settings = settings.override(world_size=Settings.from_env().world_size)

    spark = SparkSession.builder.appName("seqcast").getOrCreate()
    try:
        stats = run_repeatedly(spark, settings, args.runs, args.format, args.single)
        if stats is not None:
            stats.show(truncate=False)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
