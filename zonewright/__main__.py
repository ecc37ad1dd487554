"""``python -m zonewright train|predict|evaluate``: the jobs from the shell."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from zonewright.plans import jobs
from zonewright.sources import sinks
from zonewright.sources.readers import Source


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="zonewright")
    parser.add_argument("job", choices=("train", "predict", "evaluate"))
    parser.add_argument("--input", required=True)
    parser.add_argument("--format", default="csv")
    parser.add_argument("--models", required=True, help="folder of the model store")
    parser.add_argument("--version")
    parser.add_argument("--output", help="folder for predictions or reports")
    parser.add_argument("--key", help="unique key column")
    parser.add_argument("--folds", type=int)
    parser.add_argument("--trials", type=int)
    parser.add_argument("--versioning", default="semantic")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName(f"zonewright-{args.job}").getOrCreate()
    source = Source(args.format, args.input)
    if args.job == "train":
        store = sinks.ModelStore(spark, args.models, args.versioning)
        result = jobs.train(source.load(spark), args.key, folds=args.folds, trials=args.trials, store=store)
        result.metrics.show(truncate=False)
        print(f"version {result.version}; {result.unmapped_rows} rows of unmapped classes")
        if args.output:
            jobs.save_report(result.report, args.output)
        return
    model = jobs.load(spark, args.models, version=args.version)
    if args.job == "predict":
        jobs.predict_file(model, source.load(spark), args.output).show(truncate=False)
    else:
        report = jobs.evaluate_stored(model, source.load_labeled(spark), args.key)
        report["metrics"].show(truncate=False)
        if args.output:
            jobs.save_report(report, args.output)


if __name__ == "__main__":
    main()
