"""Command line: build, list and remove indexes, geocode a file, reverse geocode, run a benchmark."""

from __future__ import annotations

import argparse
import sys


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="waymark", description=__doc__)
    p.add_argument("--root", default="waymark-indexes", help="folder of the indexes")
    sub = p.add_subparsers(dest="command", required=True)
    build = sub.add_parser("build", help="build an index from a YAML configuration")
    build.add_argument("config")
    sub.add_parser("list", help="names of the indexes")
    remove = sub.add_parser("remove", help="delete an index")
    remove.add_argument("name")
    code = sub.add_parser("geocode", help="match a file with a column of addresses")
    code.add_argument("index")
    code.add_argument("input")
    code.add_argument("output")
    code.add_argument("--column", default="address")
    code.add_argument("--how", default="standard")
    code.add_argument("--top-n", type=int, default=1)
    back = sub.add_parser("reverse", help="nearest addresses of a file with query_id, latitude, longitude")
    back.add_argument("index")
    back.add_argument("input")
    back.add_argument("output")
    bench = sub.add_parser("benchmark", help="accuracy on a file with input_address and best_match")
    bench.add_argument("index")
    bench.add_argument("input")
    bench.add_argument("--how", default="standard")
    bench.add_argument("--threshold", type=float, default=0.5)
    bench.add_argument("--output", help="folder for the rows as CSV")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from waymark import matcher as m
    from waymark.sources import tables

    spark = SparkSession.builder.getOrCreate()
    if args.command == "build":
        print(m.build_index(spark, m.BuildConfig.from_yaml(args.config), args.root))
    elif args.command == "list":
        print("\n".join(tables.list_indexes(spark, args.root)))
    elif args.command == "remove":
        return 0 if tables.remove_index(spark, args.name, args.root) else 1
    elif args.command == "geocode":
        inputs = tables.read_addresses(spark, args.input).select(F.col(args.column).alias("address"))
        own = m.Matcher(spark, args.index, args.how, root=args.root)
        own.match(tables.with_row_ids(inputs, "address_id"), args.top_n).write.mode("overwrite").parquet(args.output)
    elif args.command == "reverse":
        own = m.Matcher(spark, args.index, root=args.root)
        own.reverse_geocode(tables.read_addresses(spark, args.input)).write.mode("overwrite").parquet(args.output)
    else:
        pairs = tables.with_row_ids(tables.read_addresses(spark, args.input).select("input_address", F.col("best_match").alias("expected_address")), "address_id")
        rows, summary = m.run_benchmark(m.Matcher(spark, args.index, args.how, args.threshold, args.root), pairs)
        if args.output:
            m.write_benchmark(rows, args.output)
        print(summary.first().asDict())
    return 0


if __name__ == "__main__":
    sys.exit(main())
