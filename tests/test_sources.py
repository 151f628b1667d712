import os
import tempfile

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from postlab.operators import clean, prep
from postlab.schema import RAW_COLUMNS
from postlab.sources import sinks
from postlab.sources.posts import load_posts_csv, posts_view, read_tagged


def test_typed_csv_load_with_bad_values(spark):
    base = tempfile.mkdtemp(prefix="csv-")
    posts = posts_view(spark, "/root/testdata/sf0.001").limit(50)
    raw = posts.select(*[F.col(c).cast("string").alias(c) for c in RAW_COLUMNS])
    bad = raw.limit(1).withColumn("timestamp", F.lit("not a date")).withColumn("verified_flag", F.lit("yes"))
    raw.unionByName(bad).coalesce(1).write.option("header", True).csv(os.path.join(base, "data"))
    df = load_posts_csv(spark, os.path.join(base, "data"))
    assert dict(df.dtypes)["verified_flag"] == "int" and dict(df.dtypes)["post_id"] == "bigint"
    assert df.count() == 51
    assert df.where(F.col("verified_flag").isNull()).count() == 1
    dated = clean.add_date_parts(df)
    assert dated.where(F.col("year").isNull()).count() == 1


def test_read_tagged_by_file_name(spark):
    base = tempfile.mkdtemp(prefix="tag-")
    for t in ("credibility_score", "misinformation_probability"):
        spark.createDataFrame([(0.1, 0.2)], "mae double, rmse double").coalesce(1).write.option("header", True) \
            .csv(os.path.join(base, f"metrics_{t}"))
    df = read_tagged(spark, os.path.join(base, "metrics_*"), fmt="csv", tag="model",
                     pattern=r"metrics_(\w+)/", of="file_path")
    assert sorted(r["model"] for r in df.collect()) == ["credibility_score", "misinformation_probability"]


def test_json_export_and_model_persistence(spark):
    base = tempfile.mkdtemp(prefix="snk-")
    df = spark.createDataFrame([(1, "a", 2.0), (2, "b", None)], "post_id long, c string, v double")
    assert sinks.write_json(df, os.path.join(base, "j")) == 2
    assert spark.read.json(os.path.join(base, "j")).count() == 2
    model = Pipeline(stages=prep.preprocessing_stages(["v"], ["c"])).fit(df)
    sinks.save_model(model, os.path.join(base, "m"))
    again = PipelineModel.load(os.path.join(base, "m"))
    a = [r["features"].toArray().tolist() for r in model.transform(df).orderBy("post_id").collect()]
    b = [r["features"].toArray().tolist() for r in again.transform(df).orderBy("post_id").collect()]
    assert a == b
    unseen = spark.createDataFrame([(3, "zzz", 1.0)], "post_id long, c string, v double")
    vec = again.transform(unseen).first()["features"].toArray().tolist()
    assert vec[1:] == [0.0, 0.0]  # unseen category -> all-zero one-hot
