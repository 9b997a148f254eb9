import tempfile

from slotwise.cli import main


def test_cli_build_lookups_query(spark):
    d = tempfile.mkdtemp(prefix="slotwise-cli-")
    assert main(["--profile", "events_jan_2024", "build-features", "--trips", "/root/testdata/sf0.001", "--events", "--out", d + "/f"]) == 0
    assert main(["--profile", "events_jan_2024", "lookups", "--features", d + "/f", "--out", d + "/l"]) == 0
    assert main(["query", "zone_listing", "--sf-dir", "/root/testdata/sf0.001", "--out", d + "/q"]) == 0
    assert spark.read.parquet(d + "/l").count() == spark.read.parquet(d + "/f").select("PULocationID").distinct().count() * 168
    assert spark.read.parquet(d + "/q").count() > 0


def test_cli_train_forecast_ask(spark, tmp_path, capsys):
    at = str(tmp_path)
    profile = ["--profile", "events_jan_2024"]
    main([*profile, "build-features", "--trips", "/root/testdata/sf0.001", "--events", "--out", at + "/f", "--lookup-out", at + "/l"])
    assert main([*profile, "train", "--features", at + "/f", "--models", "ridge", "--model-out", at + "/m"]) == 0
    assert main(["forecast", "--model", at + "/m", "--lookup", at + "/l", "--zones", at + "/none.csv", "--buckets", "4", "--out", at + "/fc"]) == 0
    table = spark.read.parquet(at + "/fc")
    assert table.count() == spark.read.parquet(at + "/l").count()
    zone = table.first()["zone_id"]
    capsys.readouterr()
    assert main(["ask", "--forecast", at + "/fc", "--zone", str(zone), "--dow", "0"]) == 0
    shown = capsys.readouterr().out
    assert shown.count("\n|") == 25  # the heading and 24 hours
