"""``python -m temploom.cli FILE...``: mine files and print the catalog."""
from __future__ import annotations

import argparse
import sys

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Observation, SparkSession
from pyspark.sql import functions as F

from temploom.errors import TemploomError
from temploom.functions.event_time import parse_event_ms
from temploom.functions.json_path import extract_field
from temploom.functions.masks import parse_mask_list
from temploom.operators.catalog import SORTS, min_size, render
from temploom.operators.mine import mine
from temploom.operators.options import MinerOptions
from temploom.sources.records import drop_blank, read_records


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="temploom")
    p.add_argument("files", nargs="*")
    p.add_argument("--format", default="text", choices=["text", "json", "jsonl", "ndjson", "csv"])
    p.add_argument("--min-size", type=int, default=0)
    p.add_argument("--sort", default="size", choices=list(SORTS))
    p.add_argument("--sim-th", type=float, default=0.4)
    p.add_argument("--depth", type=int, default=4)
    p.add_argument("--path-delimiters", default="")
    p.add_argument("--masks", default="")
    p.add_argument("--first-line-only", action="store_true")
    framing = p.add_mutually_exclusive_group()
    framing.add_argument("--record-separator", metavar="SEP")
    framing.add_argument("--multiline-start", metavar="REGEX")
    p.add_argument("--key")
    p.add_argument("--time-key")
    p.add_argument("--time-format")
    return p


def run(args: argparse.Namespace, spark: SparkSession) -> str:
    opts = MinerOptions(sim_threshold=args.sim_th, depth=args.depth, path_delimiters=args.path_delimiters, first_line_only=args.first_line_only, masks=parse_mask_list(args.masks))
    rec = read_records(spark, args.files, separator=args.record_separator, multiline_start=args.multiline_start)
    seen = None
    if args.time_key:
        # Failures are counted before blank or keyless records are dropped.
        seen = Observation()
        rec = rec.withColumn("event_ms", parse_event_ms(extract_field(F.col("record"), args.time_key), args.time_format)).observe(seen, F.count_if(F.col("event_ms").isNull()).alias("failed"))
    if args.key:
        rec = rec.withColumn("record", extract_field(F.col("record"), args.key)).filter(F.col("record").isNotNull())
    else:
        rec = drop_blank(rec)
    out = render(min_size(mine(rec, opts).catalog, args.min_size), args.format, args.sort)
    if seen is not None and (n := seen.get["failed"]):
        print(f"warning: {n} records without a usable event time", file=sys.stderr)
    return out


def main(argv: list[str] | None = None) -> int:
    p = parser()
    args = p.parse_args(argv)
    if args.time_format is not None and args.time_key is None:
        p.error("--time-format requires --time-key")
    spark = SparkSession.builder.appName("temploom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        sys.stdout.write(run(args, spark))
    except (TemploomError, OSError, PySparkException, Py4JError) as e:
        print(f"error: {str(e).strip().splitlines()[0] if str(e).strip() else type(e).__name__}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
