import pytest
from pyspark.sql import functions as F

from slotwise.operators import serve as S
from slotwise.operators import splits as SP
from slotwise.plans import common as C
from slotwise.session import configure
from tests.conftest import SF01


@pytest.fixture(scope="module")
def feats(spark):
    configure(spark)
    return C.features(spark, SF01).select("PULocationID", "hour", "demand").cache()


def test_positions_are_a_permutation(feats):
    pos = SP.time_positions(feats)
    n = feats.count()
    agg = pos.agg(F.min("pos"), F.max("pos"), F.count_distinct("pos")).first()
    assert (agg[0], agg[1], agg[2]) == (0, n - 1, n)
    # earlier hours come first
    bad = pos.groupBy("hour").agg(F.min("pos").alias("a"), F.max("pos").alias("b"))
    from pyspark.sql import Window

    w = Window.orderBy("hour")
    assert bad.select((F.col("a") - F.lag("b").over(w)).alias("gap")).filter("gap != 1").count() == 0


def test_random_split_sizes(feats):
    n = feats.count()
    got = {r["split"]: r["count"] for r in SP.random_split(feats).groupBy("split").count().collect()}
    tr, va, te = SP.split_sizes(n)
    assert got == {"train": tr, "val": va, "test": te}


def test_fold_sizes(feats):
    n = feats.count()
    sh = {r["fold"]: r["count"] for r in SP.shuffled_folds(feats, 5).groupBy("fold").count().collect()}
    assert [sh[i] for i in range(5)] == SP.fold_sizes(n, 5)
    ts = SP.time_series_folds(feats, 5)
    sizes = {r["test_fold"]: r["count"] for r in ts.groupBy("test_fold").count().collect()}
    assert all(sizes[f] == n // 6 for f in range(1, 6))
    assert sizes[None] == n - 5 * (n // 6)


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_deterministic_across_partitionings(spark, feats, parts):
    base = SP.random_split(feats).select("PULocationID", "hour", "split")
    moved = SP.random_split(feats.repartition(parts)).select("PULocationID", "hour", "split")
    assert base.exceptAll(moved).count() == 0
    f1 = SP.shuffled_folds(feats).select("PULocationID", "hour", "fold")
    f2 = SP.shuffled_folds(feats.repartition(parts, "hour")).select("PULocationID", "hour", "fold")
    assert f1.exceptAll(f2).count() == 0
    p1 = SP.time_positions(feats)
    p2 = SP.time_positions(feats.repartition(parts))
    assert p1.exceptAll(p2).count() == 0


def test_split_leak_check(spark, feats):
    labelled = SP.temporal_split(feats, C.PROFILE.val_start, C.PROFILE.test_start)
    SP.check_split(labelled, C.PROFILE.val_start, C.PROFILE.test_start)
    empty = SP.temporal_split(feats, "2023-01-01", "2023-02-01")
    with pytest.raises(ValueError):
        SP.check_split(empty, "2023-01-01", "2023-02-01")


def test_rank_ties_go_to_smaller_zone(spark):
    fc = spark.createDataFrame(
        [(3, 8, 0, 0, 5.0), (1, 8, 0, 0, 5.0), (2, 8, 0, 0, 7.0), (4, 8, 0, 0, 1.0)],
        "zone_id int, hour_of_day int, day_of_week int, is_weekend int, prediction double",
    ).withColumn("zone_name", F.concat(F.lit("Zone "), F.col("zone_id")))
    ranks = {r["zone_id"]: (r["rank"], r["of_zones"]) for r in S.zone_ranks(fc).collect()}
    assert ranks == {2: (1, 4), 1: (2, 4), 3: (3, 4), 4: (4, 4)}
    top = [r["zone_id"] for r in S.top_zones(fc, 2).orderBy("rank").collect()]
    assert top == [2, 1]
    inten = {r["zone_id"]: r["map_intensity"] for r in S.zone_intensity(fc).collect()}
    assert inten[2] == 1.0 and abs(inten[4] - (1 / 7) ** 0.5) < 1e-12


def test_labels_equal_positions(feats):
    n, k = feats.count(), 7
    pos = SP.hash_positions(feats).join(SP.random_split(feats), feats.columns).join(SP.shuffled_folds(feats, k), feats.columns)
    tr, va, te = SP.split_sizes(n)
    want = F.when(F.col("pos") < te, "test").when(F.col("pos") < te + va, "val").otherwise("train")
    assert pos.filter(want != F.col("split")).count() == 0
    edges = [sum(SP.fold_sizes(n, k)[:f]) for f in range(1, k)]
    assert pos.filter(sum((F.col("pos") >= e).cast("int") for e in edges) != F.col("fold")).count() == 0
    blocks = SP.time_series_blocks(feats, 5)
    folds = SP.time_series_folds(feats, 5).select(*feats.columns, "test_fold")
    assert blocks.schema["test_fold"].dataType == folds.schema["test_fold"].dataType
    assert blocks.exceptAll(folds).count() == 0 and folds.exceptAll(blocks).count() == 0


def test_labels_without_a_window_over_the_table(feats):
    def nodes(plan):
        yield plan.nodeName()
        children = plan.children()
        for i in range(children.size()):
            yield from nodes(children.apply(i))

    for labelled in (SP.random_split(feats), SP.shuffled_folds(feats), SP.time_series_blocks(feats)):
        names = list(nodes(labelled._jdf.queryExecution().sparkPlan()))  # subqueries are no children
        assert not [n for n in names if "Window" in n or "Join" in n or "Sort" in n or "Exchange" in n], names


def test_labels_of_few_repeated_and_no_rows(spark):
    schema = "PULocationID int, hour timestamp_ntz, demand int"
    none = spark.createDataFrame([], schema)
    assert SP.random_split(none).count() == SP.shuffled_folds(none, 5).count() == SP.time_series_blocks(none, 5).count() == 0
    import datetime as dt

    twice = spark.createDataFrame([(z, dt.datetime(2024, 1, 1, h), 0) for h in range(12) for z in (1, 1, 2, None)], schema)
    for labelled, name in ((SP.random_split(twice), "split"), (SP.shuffled_folds(twice, 5), "fold"), (SP.time_series_blocks(twice, 5), "test_fold")):
        assert labelled.count() == 48
        together = labelled.groupBy("PULocationID", "hour").agg(F.count_distinct(F.coalesce(F.col(name).cast("string"), F.lit("-"))).alias("n"))
        assert together.filter("n > 1").count() == 0  # equal rows stay together
    three = twice.filter("PULocationID = 2 AND hour < '2024-01-01 03:00:00'")
    assert [r[0] for r in SP.shuffled_folds(three, 5).select("fold").orderBy("fold").collect()] == [0, 1, 2]
