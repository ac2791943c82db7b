"""Command line: ``python -m riskframe <stage> --data DIR --models DIR --reports DIR``."""

from __future__ import annotations

import argparse

from riskframe.plans import stages
from riskframe.session import build_session
from riskframe.sources import tables


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="riskframe")
    names = ["ingest", "profile", "clean", "baseline", "boosting", "calibrate", "explain", "score", "drift"]
    parser.add_argument("stage", choices=names)
    parser.add_argument("--data", required=True)
    parser.add_argument("--models", required=True)
    parser.add_argument("--reports", required=True)
    parser.add_argument("--source", help="table to ingest, to score, or to hold against the training table")
    parser.add_argument("--format", default="csv")
    parser.add_argument("--out", help="where scores are written")
    parser.add_argument("--force", action="store_true")
    args = parser.parse_args(argv)

    spark = build_session()
    settings = stages.Settings(args.data, args.models, args.reports)
    if args.stage == "ingest":
        print(stages.ingest_stage(spark, settings, args.source, args.format, args.force))
    elif args.stage == "score":
        stages.score_stage(spark, settings, args.source, args.out)
    elif args.stage == "drift":
        stages.drift_stage(spark, settings, tables.load_clean(spark, args.source)).show(truncate=False)
    elif args.stage in ("profile", "explain"):
        for name, table in getattr(stages, f"{args.stage}_stage")(spark, settings).items():
            print(name)
            table.show(50, truncate=False)
    else:
        result = getattr(stages, f"{args.stage}_stage")(spark, settings)
        result.show(truncate=False) if hasattr(result, "show") else print(result)


if __name__ == "__main__":
    main()
