import tempfile

from postlab.sources import sinks


def test_write_table_counts_rows(spark):
    out = tempfile.mkdtemp(prefix="t-")
    assert sinks.write_table(spark.range(123), f"{out}/t") == 123
    assert spark.read.parquet(f"{out}/t").count() == 123


def test_sanitize_metrics(spark):
    df = spark.createDataFrame([(0.5, "1.0", float("nan"), "cpu")], "mae double, rmse string, r2 double, device_used string")
    r = sinks.sanitize_metrics(df, ["mae", "rmse", "r2", "training_seconds"]).first().asDict()
    assert r == {"mae": 0.5, "rmse": 1.0, "r2": 0.0}


def test_manifest_freshness(spark):
    out = tempfile.mkdtemp(prefix="t-")
    spark.range(5).write.parquet(f"{out}/src")
    src = spark.read.parquet(f"{out}/src")
    fp = sinks.input_fingerprint(src, {"seed": 42})
    m = sinks.StageManifest(spark, out)
    assert not m.is_fresh("s", fp)
    m.mark("s", fp, ["a"])
    assert m.is_fresh("s", fp)
    assert not m.is_fresh("s", sinks.input_fingerprint(src, {"seed": 43}))
