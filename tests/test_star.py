from pyspark.sql import functions as F

from postlab.operators import star


def test_dense_index_is_dense_and_ordered(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7 % 1000).alias("k")).repartition(5)
    out = star.dense_index(df, ["k"], "key").orderBy("k").collect()
    assert [r["key"] for r in out] == list(range(1, 1001))


def test_dimension_first_seen_order(spark):
    df = spark.createDataFrame([(5, "x"), (1, "y"), (3, "x"), (2, "z"), (4, None)], "post_id long, platform string")
    dim = {r["platform"]: r["platform_id"] for r in star.make_dimension(df, ["platform"], "platform_id").collect()}
    assert dim == {"y": 1, "z": 2, "x": 3, None: 4}


def test_fact_keys_complete(spark):
    from postlab.plans.catalog import silver
    s = silver(spark, "/root/testdata/sf0.001")
    fact = star.build_fact(s, star.build_dimensions(s))
    r = star.star_checks(s, fact).first()
    assert r["fact_rows"] == r["silver_rows"] == r["distinct_post_ids"]
    assert r["rows_with_null_key"] == 0
