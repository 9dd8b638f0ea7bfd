"""The command line: python -m siftwell search SYMBOL, python -m siftwell bench, and python -m siftwell serve."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from siftwell.operators import observe
from siftwell.plans.scenarios import append_report, read_scenarios, run_scenarios
from siftwell.plans.search import SearchSpec, search
from siftwell.plans.serve import Service


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="siftwell", description="Staged search over trees of files on Spark")
    out.add_argument("--disable-telemetry", action="store_true", help="no logs")
    commands = out.add_subparsers(dest="command", required=True)
    find = commands.add_parser("search", help="search for a symbol and print a summary as JSON")
    find.add_argument("symbol")
    find.add_argument("--path", dest="root", default=".")
    find.add_argument("--language")
    find.add_argument("--timeout-secs", type=float, default=60.0)
    find.add_argument("--max-matches", type=int, default=20)
    find.add_argument("--context-before", type=int, default=0)
    find.add_argument("--context-after", type=int, default=0)
    find.add_argument("--body", action="store_true")
    find.add_argument("--enable-index", dest="use_index", action="store_true")
    find.add_argument("--enable-rga", dest="use_pages", action="store_true")
    find.add_argument("--disable-fd", dest="use_names", action="store_false")
    find.add_argument("--disable-ast-grep", dest="use_structure", action="store_false")
    for folder in ("state-path", "log-dir", "index-dir"):
        find.add_argument(f"--{folder}")
    serve = commands.add_parser("serve", help="answer searches over HTTP")
    serve.add_argument("--path", dest="root", default=".")
    serve.add_argument("--host", default="127.0.0.1")
    serve.add_argument("--port", type=int, default=8080)
    serve.add_argument("--max-matches", type=int, default=20)
    for folder in ("state-path", "log-dir", "index-dir"):
        serve.add_argument(f"--{folder}")
    bench = commands.add_parser("bench", help="time the searches of a scenario file")
    bench.add_argument("--scenarios", required=True)
    bench.add_argument("--path", dest="root", default=".")
    bench.add_argument("--iterations", type=int, default=3)
    bench.add_argument("--output", help="file or folder that gets one JSON line for the report")
    return out


def main(argv: list[str] | None = None) -> int:
    args = vars(parser().parse_args(argv))
    command, telemetry = args.pop("command"), not args.pop("disable_telemetry")
    spark = SparkSession.builder.appName("siftwell").getOrCreate()
    if command == "search":
        try:
            spec = SearchSpec(**args, telemetry=telemetry)
        except ValueError as e:
            print(e, file=sys.stderr)
            return 2
        print(json.dumps(json.loads(search(spark, spec).to_json()), indent=2))
        return 0
    if command == "serve":
        with Service(spark, {k: args[k] for k in ("root", "max_matches", "state_path", "log_dir", "index_dir")} | {"telemetry": telemetry}, (args["host"], args["port"])) as service:
            service.serve_forever()
    report = observe.scenario_report(run_scenarios(spark, read_scenarios(spark, args["scenarios"]), args["root"], args["iterations"])).persist()
    print(json.dumps([r.asDict() for r in report.collect()], indent=2))
    if args["output"]:
        append_report(report, args["output"])
    return 0


if __name__ == "__main__":
    sys.exit(main())
