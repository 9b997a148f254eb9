"""Command line for the batch jobs (``spark-submit -m`` or ``python -m slotwise.cli``).

Subcommands mirror the steps of the original pipeline:

  build-features   trips -> feature table (date-partitioned) [+ lookup]
  lookups          feature table -> serving lookup table
  train            fit OLS / ridge / forests on the temporal split, score validation; --model-out saves one
  forecast         saved model + lookup -> forecast of every zone and slot, in buckets by zone
  ask              forecast of one zone from its bucket: a week, or one day
  cv               time-series or shuffled K-fold CV of one model
  split-experiments  temporal CV, two hold-outs and shuffled CV side by side
  tune             random search + honest retrain; saves the final model
  query            run a registered query on a driver-table directory, write Parquet

All outputs go to the paths given (shared storage on a cluster); nothing is
collected beyond the printed one-row profiles and metric tables.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from slotwise.operators import models as M
from slotwise.operators import splits as SP
from slotwise.operators.lookup import build_lookup
from slotwise.operators.metrics import fold_summary
from slotwise.operators.serve import forecast_table, heatmap, timeline
from slotwise.profiles import EVENTS, TRIPS_JAN_2025
from slotwise.session import configure, get_session
from slotwise.schemas import TUNED_VAL_MAE
from slotwise.sources.io import load_model, read_feature_table, read_trips, read_zone_csv, save_model, write_table
from slotwise.sources.serving_store import SERVING_BUCKETS, open_bucketed, write_bucketed

PROFILES = {p.name: p for p in (TRIPS_JAN_2025, EVENTS)}


def _model(name: str, args) -> M.EstimatorFactory:
    if name == "lr":
        return M.linear_regression()
    if name == "ridge":
        return M.ridge(args.alpha)
    if name == "rf":
        return M.random_forest(num_trees=args.trees, max_depth=args.depth, max_bins=args.max_bins)
    if name == "rf-tuned":
        return M.tuned_forest(args.max_bins)
    raise SystemExit(f"unknown model {name!r} (lr, ridge, rf, rf-tuned)")


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="slotwise")
    ap.add_argument("--master", default=None, help="Spark master (default: launcher's)")
    ap.add_argument("--profile", default=TRIPS_JAN_2025.name, choices=sorted(PROFILES))
    sub = ap.add_subparsers(dest="cmd", required=True)

    b = sub.add_parser("build-features")
    b.add_argument("--trips", required=True, help="trip Parquet path, or a driver-table dir with --events")
    b.add_argument("--events", action="store_true", help="read the driver's events table as trips")
    b.add_argument("--out", required=True)
    b.add_argument("--lookup-out")

    lk = sub.add_parser("lookups")
    lk.add_argument("--features", required=True)
    lk.add_argument("--out", required=True)
    lk.add_argument("--as-of")

    for name in ("train", "cv", "split-experiments", "tune"):
        p = sub.add_parser(name)
        p.add_argument("--features", required=True)
        p.add_argument("--alpha", type=float, default=1.0)
        p.add_argument("--trees", type=int, default=100)
        p.add_argument("--depth", type=int, default=30)
        p.add_argument("--max-bins", type=int, default=128)
        if name == "train":
            p.add_argument("--models", default="lr,rf,ridge")
            p.add_argument("--model-out", help="folder of the first of --models, fitted on the training rows")
        if name in ("cv", "split-experiments"):
            p.add_argument("--model", default="rf")
        if name == "cv":
            p.add_argument("--shuffled", action="store_true")
        if name == "tune":
            p.add_argument("--trials", type=int, default=15)
            p.add_argument("--model-out", required=True)

    fc = sub.add_parser("forecast")
    fc.add_argument("--model", required=True)
    fc.add_argument("--lookup", required=True)
    fc.add_argument("--zones", required=True, help="zone CSV; names fall back to ids where it is missing")
    fc.add_argument("--error-band", type=float, default=TUNED_VAL_MAE)
    fc.add_argument("--buckets", type=int, default=SERVING_BUCKETS)
    fc.add_argument("--out", required=True)

    ak = sub.add_parser("ask")
    ak.add_argument("--forecast", required=True)
    ak.add_argument("--zone", type=int, required=True)
    ak.add_argument("--dow", type=int, choices=range(7))

    q = sub.add_parser("query")
    q.add_argument("name")
    q.add_argument("--sf-dir", required=True)
    q.add_argument("--out", required=True)

    args = ap.parse_args(argv)
    spark = configure(get_session(args.master))
    profile = PROFILES[args.profile]

    if args.cmd == "build-features":
        from slotwise.plans.feature_build import run
        from slotwise.sources.testdata import load, trips_from_events

        trips = trips_from_events(load(spark, args.trips, "events")) if args.events else read_trips(spark, args.trips)
        run(spark, trips, args.out, profile, lookup_path=args.lookup_out).show(truncate=False)
        return 0
    if args.cmd == "lookups":
        write_table(build_lookup(read_feature_table(spark, args.features).drop("date"), as_of=args.as_of), args.out)
        return 0
    if args.cmd == "query":
        from slotwise.plans.registry import QUERIES, load_all

        load_all()
        write_table(QUERIES[args.name](spark, args.sf_dir), args.out)
        return 0

    if args.cmd == "forecast":
        table = forecast_table(spark.read.parquet(args.lookup), load_model(args.model), read_zone_csv(spark, args.zones), args.error_band)
        write_bucketed(table, args.out, "zone_id", args.buckets)
        return 0
    if args.cmd == "ask":
        table = open_bucketed(spark, args.forecast)
        out = heatmap(table, args.zone) if args.dow is None else timeline(table, args.zone, args.dow)
        out.orderBy(*out.columns[:-1]).show(168, truncate=False)
        return 0

    feats = read_feature_table(spark, args.features).drop("date")
    if args.cmd == "train":
        labelled = SP.temporal_split(feats, profile.val_start, profile.test_start)
        SP.check_split(labelled, profile.val_start, profile.test_start)
        models = {m: _model(m, args) for m in args.models.split(",")}
        M.compare_models(labelled, models).show(truncate=False)
        if args.model_out:
            save_model(M.fit(next(iter(models.values())), labelled.filter(F.col("split") == "train")), args.model_out)
    elif args.cmd == "cv":
        trainval = feats.filter(F.col("hour") < F.lit(profile.test_start).cast("timestamp_ntz"))
        factory = _model(args.model, args)
        if args.shuffled:
            res = M.shuffled_cv(SP.shuffled_folds(trainval, profile.folds, profile.seed), factory, profile.folds, args.model)
        else:
            res = M.time_series_cv(SP.time_series_blocks(trainval, profile.folds), factory, profile.folds, args.model)
        res.show(truncate=False)
        fold_summary(res).show(truncate=False)
    elif args.cmd == "split-experiments":
        from slotwise.plans.evaluation import split_method_comparison

        split_method_comparison(feats, _model(args.model, args), profile).show(truncate=False)
    elif args.cmd == "tune":
        from slotwise.plans.evaluation import tune_and_retrain

        trials, metrics, model = tune_and_retrain(feats, profile, n_trials=args.trials, max_bins=args.max_bins)
        trials.show(truncate=False)
        metrics.show(truncate=False)
        save_model(model, args.model_out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
