import json
import os
import tempfile

import pytest

from slotwise.sources import io as IO


def _write(path, text):
    with open(path, "w") as f:
        f.write(text)


def test_geojson_id_spellings(spark):
    d = tempfile.mkdtemp(prefix="slotwise-geo-")
    feats = [
        {"type": "Feature", "properties": {"location_id": "7", "zone": "Astoria", "borough": "Queens"}},
        {"type": "Feature", "properties": {"LocationID": 12, "zone": "Battery Park"}},
        {"type": "Feature", "properties": {"locationid": "13", "borough": "Manhattan"}},
        {"type": "Feature", "properties": {"location_id": "", "LocationID": 0, "locationid": "21", "zone": "Bath Beach", "borough": "Brooklyn"}},
    ]
    p = os.path.join(d, "zones.geojson")
    _write(p, json.dumps({"type": "FeatureCollection", "features": feats}))
    got = {r["LocationID"]: (r["Zone"], r["Borough"]) for r in IO.read_zone_geojson(spark, p).collect()}
    assert got == {
        7: ("Astoria", "Queens"),
        12: ("Battery Park", "Unknown"),
        13: ("Zone 13", "Manhattan"),
        21: ("Bath Beach", "Brooklyn"),
    }


def test_zone_csv_present_and_degraded(spark):
    d = tempfile.mkdtemp(prefix="slotwise-csv-")
    good = os.path.join(d, "good.csv")
    _write(good, "LocationID,Borough,Zone,service_zone\n1,EWR,Newark Airport,EWR\n2,Queens,Jamaica Bay,Boro Zone\n")
    assert {r["LocationID"]: r["Zone"] for r in IO.read_zone_csv(spark, good).collect()} == {1: "Newark Airport", 2: "Jamaica Bay"}
    bad = os.path.join(d, "bad.csv")
    _write(bad, "id,name\n1,x\n")
    assert IO.read_zone_csv(spark, bad).count() == 0
    assert IO.read_zone_csv(spark, os.path.join(d, "missing.csv")).count() == 0


def test_feature_table_roundtrip_and_missing(spark):
    d = tempfile.mkdtemp(prefix="slotwise-ft-")
    df = spark.createDataFrame([(1, "2025-01-01 00:00:00", 3)], "PULocationID int, hour string, demand long")
    IO.write_table(df, os.path.join(d, "features"), sort_within=["PULocationID"])
    back = IO.read_feature_table(spark, os.path.join(d, "features"))
    assert dict(back.dtypes)["hour"] == "timestamp_ntz" and back.count() == 1
    with pytest.raises(FileNotFoundError):
        IO.read_feature_table(spark, os.path.join(d, "nope"))
