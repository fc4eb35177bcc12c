"""Command line: compact files, report savings on samples, fetch originals, check the installation."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import __version__
from .functions.tokens import DEFAULT_PRICE, PRICES
from .options import Options
from .plans.pipeline import compact, store_rows
from .plans.report import perf_report, savings_by_kind, telemetry
from .samples import SAMPLES
from .sources.readers import payload_files
from .sources.store import Store


def _spark() -> SparkSession:
    spark = SparkSession.builder.appName("brevia").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _compact(args: argparse.Namespace, o: Options) -> int:
    spark = _spark()
    o = o.merged(level=args.level, min_tokens=args.min_tokens)
    if args.path and args.path != "-":
        rows = payload_files(spark, args.path)
    else:
        rows = spark.createDataFrame([("stdin", sys.stdin.read())], "id string, text string")
    out = compact(rows, "id", "text", o)
    if o.reversible:
        Store(spark, o.store_dir, o.store_ttl).put(store_rows(out, F.current_timestamp()))
    if args.out:
        out.write.mode("overwrite").parquet(args.out)
        return 0
    for r in out.toLocalIterator():
        print(r["text"])
        print(f"kind={r['kind']} {r['original_tokens']} -> {r['compressed_tokens']} tokens ({100 * r['ratio']:.1f}% saved)", file=sys.stderr)
    return 0


def _perf(args: argparse.Namespace, o: Options) -> int:
    spark = _spark()
    o = o.merged(level=args.level, model=args.model, min_tokens=0)
    out = compact(spark.createDataFrame(list(SAMPLES.items()), "id string, text string"), "id", "text", o)
    price = o.price_per_mtok if o.price_per_mtok is not None else PRICES.get(o.model.strip().lower(), DEFAULT_PRICE)
    for r in perf_report(out, price).orderBy(F.col("kind") == "TOTAL", "kind").collect():
        print(f"{r['kind']:<9}{r['before']:>9}{r['after']:>9}{r['saved_pct']:>8.1f}%{'' if r['quality'] is None else round(r['quality'], 2):>8}{r['usd_saved']:>10.5f}{r['usd_month']:>12.2f} a month")
    return 0


def _retrieve(args: argparse.Namespace, o: Options) -> int:
    spark = _spark()
    asked = spark.createDataFrame([(args.ref,)], "asked string")
    found = Store(spark, o.store_dir, o.store_ttl).get(asked, "asked").first()["content"]
    if found is None:
        print(f"no entry for '{args.ref}' (expired or unknown)", file=sys.stderr)
        return 1
    print(found)
    return 0


def _stats(args: argparse.Namespace, o: Options) -> int:
    out = _spark().read.parquet(args.results)
    row = telemetry(out).first().asDict() | {"by_kind": {r["kind"]: r["saved"] for r in savings_by_kind(out).collect()}}
    print(json.dumps(row, indent=2))
    return 0


def _doctor(args: argparse.Namespace, o: Options) -> int:
    spark = _spark()
    kind = compact(spark.createDataFrame([("log", SAMPLES["log"])], "id string, text string"), "id", "text", o.merged(min_tokens=0)).first()["kind"]
    print(f"brevia {__version__}, Spark {spark.version}, options {o}\nself-test: {'fine' if kind == 'log' else 'a log was taken for ' + kind}")
    return int(kind != "log")


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="brevia", description=__doc__)
    sub = p.add_subparsers(dest="command")
    c = sub.add_parser("compact", help="compact a file, a folder or standard input")
    c.add_argument("path", nargs="?")
    c.add_argument("--level")
    c.add_argument("--min-tokens", type=int, default=0)
    c.add_argument("--out", help="write results as Parquet instead of text")
    c.set_defaults(run=_compact)
    c = sub.add_parser("perf", help="savings on sample payloads")
    c.add_argument("--level")
    c.add_argument("--model")
    c.set_defaults(run=_perf)
    c = sub.add_parser("retrieve", help="the original of a reference")
    c.add_argument("ref")
    c.set_defaults(run=_retrieve)
    c = sub.add_parser("stats", help="totals of written results")
    c.add_argument("results")
    c.set_defaults(run=_stats)
    sub.add_parser("doctor", help="check the installation").set_defaults(run=_doctor)
    sub.add_parser("version").set_defaults(run=lambda a, o: print(__version__) or 0)
    args = p.parse_args(argv)
    if not args.command:
        p.print_help()
        return 0
    return args.run(args, Options.from_env())


if __name__ == "__main__":
    sys.exit(main())
