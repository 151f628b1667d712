"""Plan shape guards: pruning reaches the scans, top-k filters run before the shuffle, no cartesian products."""

import contextlib
import io
import time

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def plan_text(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


def test_scan_is_pruned_to_used_columns(spark):
    from postlab.operators import eda
    from postlab.sources.posts import posts_view
    p = posts_view(spark, SF).select("post_id", "topic", "misinformation_probability", "credibility_score",
                                     "toxicity_score")
    text = plan_text(eda.topic_risk(p))
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in text
    assert "TakeOrderedAndProject" in text and "HashAggregate" in text


def test_synthetic_day_uses_partial_group_limit(spark):
    text = plan_text(E.queries()["cal_02_analysis_date"](spark, SF))
    assert text.count("WindowGroupLimit") >= 2  # partial (before the exchange) and final


@pytest.mark.parametrize("name", ["agg_01_platform_engagement", "agg_06_daily_metrics", "agg_11_correlation_matrix",
                                  "prf_05_value_counts", "fct_03_fact_posts", "agg_15_scatter_bins"])
def test_no_cartesian_product(spark, name):
    text = plan_text(E.queries()[name](spark, SF))
    assert "CartesianProduct" not in text


def test_fill_table_makes_the_posts_once(spark):
    """Every pass reads the written columns; the posts' joins and shuffles are not behind the result again."""
    for name in ("cln_04_median_fill", "cln_05_mode_fill"):
        df = E.queries()[name](spark, SF)
        assert not any(f.endswith(("orders.parquet", "lineitem.parquet")) for f in df.inputFiles())


def test_a_written_table_leaves_no_shuffle_files(spark):
    from pyspark.sql import functions as F

    from postlab.session import CLEANUP, written

    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()

    def shuffled():
        found = files.getAllFiles()
        return {f.getName() for f in (found.apply(i) for i in range(found.size())) if f.getName().startswith("shuffle_")}

    before = shuffled()
    table = written(spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count().repartition(3))
    until = time.time() + 10  # files go in the background
    while shuffled() - before and time.time() < until:
        time.sleep(0.1)
    assert not shuffled() - before and table.count() == 10 and spark.conf.get(CLEANUP) == "false"
