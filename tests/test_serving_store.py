"""Serving tables in buckets: pruning, joins without a shuffle of the table, reopening."""

import pytest
from pyspark.sql import functions as F

from slotwise.operators.lookup import attach_lookup, build_lookup
from slotwise.plans import common as C
from slotwise.schemas import ZONE
from slotwise.session import configure
from slotwise.sources.serving_store import deal_requests, open_bucketed, write_bucketed
from tests.conftest import SF001

BUCKETS = 8


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    configure(spark)
    path = str(tmp_path_factory.mktemp("store") / "lookup")
    lookup = build_lookup(C.features(spark, SF001), digits=9).cache()
    write_bucketed(lookup, path, ZONE, BUCKETS)
    return lookup, path


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_reopened_table_is_whole(spark, stored):
    lookup, path = stored
    again = open_bucketed(spark, path)
    assert again.columns == lookup.columns
    assert again.exceptAll(lookup).count() == lookup.exceptAll(again).count() == 0


def test_one_zone_reads_one_bucket(spark, stored):
    lookup, path = stored
    zone = lookup.first()[ZONE]
    # files of other buckets are skipped in either kind of scan; only the bucketed one prints it
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", False)
    try:
        one = open_bucketed(spark, path).filter(F.col(ZONE) == zone)
        shown = one._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        assert f"SelectedBucketsCount: 1 out of {BUCKETS}" in shown
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    one = open_bucketed(spark, path).filter(F.col(ZONE) == zone)
    assert one.count() == lookup.filter(F.col(ZONE) == zone).count()


def test_requests_meet_the_table_without_its_shuffle(spark, stored):
    lookup, path = stored
    table = open_bucketed(spark, path)
    requests = spark.read.parquet(path).select(ZONE, "hour_of_day", "day_of_week").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(3))))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        both = attach_lookup(deal_requests(requests, ZONE, BUCKETS), table)
        plan = executed(both)
        # dealt once are the requests, the table is read in its buckets
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
        assert both.count() == 3 * lookup.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_empty_table(spark, stored, tmp_path):
    lookup, _ = stored
    path = str(tmp_path / "none")
    assert write_bucketed(lookup.limit(0), path, ZONE, 2).count() == 0
    assert open_bucketed(spark, path).filter(F.col(ZONE) == 1).count() == 0
