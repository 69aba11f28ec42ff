"""Command line: ``python -m ordersight <command> [options]``.

    export   write the published result tables as one-file CSVs
    summary  print the hypothesis-test summary (and optionally write it)

The input is a directory of raw tables (``--source csv|parquet``) or of the
TPC-H-like test tables (``--source testdata``).
"""

from __future__ import annotations

import argparse

from ordersight.functions.columns import DEFAULT_CUTOFF


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="ordersight")
    parser.add_argument("command", choices=["export", "summary"])
    parser.add_argument("--location", required=True, help="directory of the input tables")
    parser.add_argument("--source", default="csv", choices=["csv", "parquet", "testdata"])
    parser.add_argument("--out", help="output directory (export) or CSV folder (summary)")
    parser.add_argument("--cutoff", default=DEFAULT_CUTOFF, help="first-order purchase cut-off")
    parser.add_argument("--min-state-orders", type=int, default=200)
    parser.add_argument("--master", default=None, help="Spark master (default: from the environment)")
    args = parser.parse_args(argv)

    from ordersight.session import get_spark

    spark = get_spark(args.master)
    if args.command == "export":
        if not args.out:
            parser.error("export needs --out")
        from ordersight.plans.exports import export_results

        for path in export_results(spark, args.location, args.out, args.cutoff, args.source, args.min_state_orders):
            print(path)
    else:
        from ordersight.plans.context import workspace
        from ordersight.plans.summary import hypothesis_summary
        from ordersight.sources.sinks import report, write_result_csv

        ws = workspace(spark, args.location, args.source)
        table = hypothesis_summary(ws.mart, ws.raw, args.cutoff, args.min_state_orders)
        if args.out:
            write_result_csv(table, args.out)
        report(table)


if __name__ == "__main__":
    main()
