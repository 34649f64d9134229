"""Command line: ``build`` exports into tables, ``score`` the tables, ``benchmark``
a labelled register.

    python -m workrisk build --data-dir exports --outdir tables
    python -m workrisk score --data-dir tables --outdir scored --top 0 --details flagged
    python -m workrisk benchmark --n 1200 --outdir benchmark
"""

from __future__ import annotations

import argparse
from datetime import date

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from workrisk.config import IngestConfig, RiskConfig
from workrisk.operators import benchmark, datagen, evaluation, rollups
from workrisk.plans import register
from workrisk.plans.storage import stored
from workrisk.sources import exports, sinks


def build(spark: SparkSession, args: argparse.Namespace) -> None:
    config = IngestConfig(as_of=date.fromisoformat(args.as_of)) if args.as_of else IngestConfig()
    out = exports.ingest(spark, args.data_dir, config)
    for name in ("works", "payments", "allocation", "pipeline"):
        if out[name] is not None:
            sinks.write_parquet(out[name], f"{args.outdir}/{name}")
    works = spark.read.parquet(f"{args.outdir}/works")
    rejected = out["quarantine"].rows()
    if rejected is not None and not rejected.isEmpty():
        sinks.write_csv(rejected.select([F.col(c).cast("string") for c in rejected.columns]), f"{args.outdir}/quarantine")
    report = exports.reports(out, works, config)
    sinks.write_report(spark, report, f"{args.outdir}/ingest_report.json")
    for name in ("coverage", "recommendation_pipeline", "matching", "dates", "amounts"):
        print(sinks.listed(name, report.get(name, {})))
    print(sinks.listed("quarantine", {f"{r['source']}: {r['reason']}": r["rows"] for r in report["quarantine"]}))


def score(spark: SparkSession, args: argparse.Namespace) -> None:
    scored = stored(register.score_works(sinks.read_table(spark, f"{args.data_dir}/works"), RiskConfig()))
    top = args.top or scored.where("risk_band <> 'Low'").count()
    limits, open_ = (sinks.read_table(spark, f"{args.data_dir}/{n}", optional=True) for n in ("allocation", "pipeline"))
    report = sinks.read_report(spark, f"{args.data_dir}/ingest_report.json")
    sinks.export_register(scored, args.outdir, report, args.details, top, RiskConfig(), limits, open_)
    for name, keys, least in (("state", ["state"], 0), ("district", ["state", "district"], 0), ("member", ["mp_name", "state"], 0), ("vendor", ["primary_vendor", "district"], 5)):
        sinks.write_csv(rollups.capped(rollups.rollup(scored, keys, least), name), f"{args.outdir}/rollup_{name}")
    sinks.write_csv(rollups.monthly(scored), f"{args.outdir}/months")
    if open_ is not None:
        sinks.write_csv(rollups.pipeline_by_state(open_), f"{args.outdir}/pipeline")
    print(sinks.console_report(scored))


def run_benchmark(spark: SparkSession, args: argparse.Namespace) -> None:
    table = sinks.read_csv(spark, args.csv, benchmark.REQUIRED, benchmark.TYPES) if args.csv else datagen.generate(spark, args.n, args.seed)
    scored = stored(benchmark.run(stored(table)))
    measures = evaluation.evaluate(scored, "risk_score", "is_anomaly", "project_id")
    found = {"available": False} if measures is None else {"available": True, **measures.head().asDict()}
    sinks.export_benchmark(scored, args.outdir, found)
    sinks.write_report(spark, found, f"{args.outdir}/benchmark.json")
    print(found)


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="workrisk", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(required=True)
    for name, f in (("build", build), ("score", score), ("benchmark", run_benchmark)):
        own = commands.add_parser(name)
        own.set_defaults(f=f)
        own.add_argument("--outdir", required=True)
        if name != "benchmark":
            own.add_argument("--data-dir", required=True)
    commands.choices["build"].add_argument("--as-of")
    commands.choices["score"].add_argument("--top", type=int, default=0, help="works in the queue; 0: as many as are flagged")
    commands.choices["score"].add_argument("--details", choices=("flagged", "all"), default="all")
    for option, kind, value in (("--csv", str, None), ("--n", int, 1200), ("--seed", int, 42)):
        commands.choices["benchmark"].add_argument(option, type=kind, default=value)
    args = parser.parse_args(arguments)
    args.f(spark or SparkSession.builder.appName("workrisk").getOrCreate(), args)


if __name__ == "__main__":
    main()
