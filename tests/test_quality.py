import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from slotwise.operators import quality as Q
from slotwise.schemas import TRIP_RULES

SCHEMA = "tpep_pickup_datetime timestamp_ntz, tpep_dropoff_datetime timestamp_ntz, PULocationID int, trip_distance double, fare_amount double, passenger_count double, total_amount double"
T0 = dt.datetime(2025, 1, 10, 9, 0)
T1 = dt.datetime(2025, 1, 10, 9, 20)


def micro(spark):
    base = dict(p=T0, d=T1, z=5, dist=2.0, fare=10.0, pax=1.0, tot=12.0)
    variants = [
        {}, {"dist": 0.0}, {"dist": 50.0}, {"dist": 50.01}, {"fare": 2.49}, {"fare": 2.50}, {"fare": 200.0},
        {"fare": 200.01}, {"pax": None}, {"pax": 0.0}, {"pax": 6.0}, {"pax": 7.0}, {"p": T1, "d": T0},
        {"z": None}, {"z": 0}, {"fare": -3.0, "tot": -4.0},
    ]
    data = []
    for v in variants:
        r = {**base, **v}
        data.append((r["p"], r["d"], r["z"], r["dist"], r["fare"], r["pax"], r["tot"]))
    data.append(data[0])  # exact duplicate
    return spark.createDataFrame(data, SCHEMA)


def test_clean_boundaries(spark):
    df = micro(spark)
    kept = Q.clean_trips(df, TRIP_RULES).count()
    # kept: base, dist 50, fare 2.50, fare 200, pax 6, reversed times, zone null, zone 0, duplicate
    assert kept == 9
    rep = {r["rule"]: r for r in Q.clean_report(df, TRIP_RULES).collect()}
    assert rep["trip_distance (0, 50]"]["rows_removed"] == 2
    assert rep["fare_amount [2.5, 200]"]["rows_removed"] == 3
    assert rep["passenger_count [1, 6]"]["rows_removed"] == 3
    assert rep["all rules"]["rows_removed"] == 8 and rep["all rules"]["rows_after"] == 9


def test_audits(spark):
    df = micro(spark)
    assert Q.duplicate_rows(df).first()["duplicate_rows"] == 1
    ts = Q.time_sanity(df).first()
    assert (ts["pickup_after_dropoff"], ts["nonpositive_duration"]) == (1, 1)
    kv = Q.key_validity(df).first()
    assert (kv["invalid_key"], kv["missing_key"], kv["invalid_or_missing_key"]) == (1, 1, 2)
    jm = Q.joint_missingness(df, ["passenger_count", "PULocationID"]).first()
    assert (jm["all_missing"], jm["any_missing"], jm["partly_missing"]) == (0, 2, 2)
    nulls = {r["column"]: r["null_count"] for r in Q.null_audit(df).collect()}
    assert nulls["passenger_count"] == 1 and nulls["PULocationID"] == 1 and nulls["fare_amount"] == 0
    audit = {r["issue"]: r["count"] for r in Q.quality_audit(df, ["passenger_count"]).collect()}
    assert audit["Negative fare_amount"] == 1 and audit["Negative total_amount"] == 1
    assert audit["Invalid or missing PULocationID"] == 2
    vc = Q.value_counts(df, "passenger_count", by="key").collect()
    assert vc[-1]["passenger_count"] is None


def test_describe_matches_linear_interpolation(spark):
    vals = [1.0, 2.0, 2.0, 3.0, 10.0, 45.5, 7.25]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = {r["statistic"]: r["value"] for r in Q.describe(df, ["x"], (0.01, 0.5, 0.99)).collect()}
    arr = np.array(vals)
    assert abs(got["p1"] - np.percentile(arr, 1)) < 1e-6
    assert abs(got["p50"] - np.percentile(arr, 50)) < 1e-6
    assert abs(got["p99"] - np.percentile(arr, 99)) < 1e-6
    assert abs(got["std"] - arr.std(ddof=1)) < 1e-6


def test_exact_quantiles_distributed_with_hot_value(spark):
    from slotwise.operators.quantiles import exact_quantiles, value_ranks

    rng = np.random.default_rng(7)
    vals = np.concatenate([rng.exponential(3.0, 4000), np.full(3000, 2.5), rng.integers(0, 50, 2000).astype(float)])
    df = spark.createDataFrame([(float(v),) for v in vals], "x double").repartition(7)
    probs = [0.0, 0.01, 0.33, 0.5, 0.9, 0.999, 1.0]
    got = spark.range(1).select(*[c.alias(f"q{i}") for i, c in enumerate(exact_quantiles(df, "x", probs, ranges=5))]).first()
    assert np.allclose(list(got), np.percentile(vals, [p * 100 for p in probs]), rtol=0, atol=1e-12)
    ranks = value_ranks(df, "x", ranges=5)
    hot = ranks.filter("v = 2.5").first()
    assert hot["last_rank"] - hot["first_rank"] + 1 >= 3000
    assert ranks.agg(F.max("last_rank")).first()[0] == len(vals) - 1


def test_describe_approximate_mode_and_sparse_drop(spark):
    vals = [float(v) for v in range(1, 1001)]
    df = spark.createDataFrame([(v, None if v % 2 else v) for v in vals], "x double, mostly_null double")
    got = {r["statistic"]: r["value"] for r in Q.describe(df, ["x"], (0.5,), exact=False).collect()}
    assert abs(got["p50"] - 500.0) <= 1.0 and got["count"] == 1000.0
    kept = Q.drop_sparse_columns(df, max_null_pct=30.0).columns
    assert kept == ["x"]


def test_bracketed_quantiles_equal_numpy(spark):
    import numpy as np

    from slotwise.operators.quantiles import bracketed_quantiles

    rng = np.random.default_rng(3)
    rows = [(float(a), None if k % 7 == 0 else float(b), float("nan") if k % 5 == 0 else 4.0, None) for k, (a, b) in enumerate(zip(rng.normal(size=4000), rng.integers(0, 9, 4000)))]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(5)
    probs = [0.0, 0.01, 0.25, 0.5, 0.5, 0.99, 1.0]
    want = {c: [v for v in (r[k] for r in rows) if v is not None and v == v] for k, c in enumerate("abcd")}
    for how in ({}, {"accuracy": 20, "room": 150}, {"accuracy": 50, "room": 10}):  # wide brackets are narrowed first
        got = bracketed_quantiles(df, {c: probs for c in "abcd"}, **how)
        assert got["d"] == [None] * len(probs)
        for c in "abc":
            assert np.allclose(got[c], np.quantile(want[c], probs), rtol=1e-12, atol=1e-12), (c, how)
    assert bracketed_quantiles(df.limit(0), {"a": [0.5]}) == {"a": [None]}
    assert bracketed_quantiles(df, {"a": []}) == {"a": []}


def test_ranks_outside_their_bracket_are_found(spark, monkeypatch):
    from slotwise.operators import quantiles as QT

    df = spark.range(1000).selectExpr("cast(id as double) x")
    real, tries = QT._values_at, []

    def misled(data, x, brackets, ranks):
        tries.append(1)
        if len(tries) == 1:  # a sketch that points elsewhere
            for b in brackets:
                b.low, b.high = 10.0, 20.0
        return real(data, x, brackets, ranks)

    monkeypatch.setattr(QT, "_values_at", misled)
    assert QT.bracketed_quantiles(df, {"x": [0.5, 0.015]})["x"] == [499.5, 14.985]
    assert len(tries) == 2


def test_duplicates_by_hash_are_exact(spark, monkeypatch):
    nan = float("nan")
    rows = [(1, None, 0.0), (1, None, -0.0), (None, 1, 0.0), (2, 2, nan), (2, 2, nan), (2, 2, nan), (3, 3, 1.0), (None, None, None), (None, None, None)]
    df = spark.createDataFrame(rows, "a int, b int, c double")
    plain = lambda d: d.groupBy(*d.columns).count().selectExpr("sum(count - 1)").first()[0]
    assert Q.duplicate_rows(df).first()[0] == plain(df) == 4
    monkeypatch.setattr(Q, "_row_hashes", lambda d, c: (F.lit(7).cast("long"), F.lit(7).cast("long")))  # every row collides
    assert Q.duplicate_rows(df).first()[0] == 4
    monkeypatch.setattr(Q, "REPEATED_BROADCAST", 0)
    assert Q.duplicate_rows(df).first()[0] == 4
    assert Q.duplicate_rows(df.limit(0)).first()[0] == 0
