import os
import tempfile

from pyspark.sql import functions as F

from postlab.operators import calendar as cal
from tools.compare import difference
from postlab.plans.catalog import silver
from postlab.streaming import start_daily_metrics


def test_stream_equals_batch_for_closed_days(spark):
    s = silver(spark, "/root/testdata/sf0.001").select("post_id", "event_ts", "engagement_velocity",
                                                         "misinformation_probability", "credibility_score")
    base = tempfile.mkdtemp(prefix="stream-")
    src = os.path.join(base, "src")
    s.repartition(4).write.parquet(src)
    q = start_daily_metrics(spark, src, s.schema, os.path.join(base, "out"), os.path.join(base, "ckpt"),
                            watermark="0 seconds", available_now=True)
    q.awaitTermination(300)
    got = spark.read.parquet(os.path.join(base, "out"))
    batch = cal.real_daily_metrics(s)
    last = batch.agg(F.max("analysis_date")).first()[0]
    exp = batch.where(F.col("analysis_date") < last)  # the last day is still open under the watermark
    assert got.count() == exp.count()
    assert difference([tuple(r) for r in got.collect()], got.columns, [tuple(r) for r in exp.collect()], exp.columns) is None
