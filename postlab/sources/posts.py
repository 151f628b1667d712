"""Readers.

``posts_view`` reshapes the driver's TPC-H-like tables into the 31-column bronze post layout
(orders x customer x nation x region, plus line items aggregated per order). It is a plain
DataFrame plan: Catalyst prunes the scans to the columns used and AQE picks the join strategy
from runtime sizes. Only ``nation`` and ``region`` are broadcast by hint: their size is fixed
(25 and 5 rows) by the TPC-H definition.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlab.functions.exprs import finite
from postlab.schema import FLAG_COLUMNS, RAW_SCHEMA

BOUNDED_TABLES = {"nation": 25, "region": 5}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def line_item_stats(lineitem: DataFrame) -> DataFrame:
    """Per-order line-item aggregate; partial aggregation runs map-side before the shuffle."""
    return lineitem.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("l_quantity").alias("qty"),
        F.avg("l_discount").alias("disc"),
        F.avg("l_tax").alias("tax"),
        F.sum("l_extendedprice").alias("ext"),
        F.count_if(F.col("l_returnflag") == "R").alias("ret"),
    )


def posts_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One post per order, in the bronze column order (``timestamp`` is the order date)."""
    orders = read_table(spark, sf_dir, "orders")
    customer = read_table(spark, sf_dir, "customer")
    nation = read_table(spark, sf_dir, "nation")
    region = read_table(spark, sf_dir, "region")
    li = line_item_stats(read_table(spark, sf_dir, "lineitem"))

    geo = (nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey)
           .select("n_nationkey", "r_name"))
    base = (orders.join(customer, orders.o_custkey == customer.c_custkey)
            .join(F.broadcast(geo), F.col("c_nationkey") == F.col("n_nationkey"))
            .join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left"))

    k = F.col("o_orderkey")
    ck = F.col("c_custkey")

    def frac1000(mult: int) -> F.Column:
        return ((k * mult) % 1000).cast("double") / 1000

    sentiment_idx = F.floor(k / 5.0).cast("bigint") % 3
    return base.select(
        k.alias("post_id"),
        F.col("o_orderdate").alias("timestamp"),
        F.floor((F.col("c_acctbal") + 1000) * 10).cast("bigint").alias("follower_count"),
        (ck % 997).cast("bigint").alias("following_count"),
        (30 + (ck * 37) % 3000).cast("bigint").alias("account_age_days"),
        F.when(ck % 5 == 0, 1).otherwise(0).cast("int").alias("verified_flag"),
        F.col("c_mktsegment").alias("source_type"),
        F.when(k % 17 == 0, F.lit(None)).otherwise(F.col("o_orderstatus")).alias("platform"),
        F.col("o_orderpriority").alias("crisis_phase"),
        F.concat(F.lit("topic_"), ((k * 31) % 7).cast("string")).alias("topic"),
        F.when(sentiment_idx == 0, "Neutral").when(sentiment_idx == 1, "Negative")
        .otherwise("Positive").alias("sentiment_label"),
        (((k * 101) % 2001 - 1000).cast("double") / 1000).alias("sentiment_score"),
        F.concat(F.lit("emotion_"), (F.floor(k / 12.0).cast("bigint") % 6).cast("string")).alias("emotion"),
        F.concat(F.lit("stance_"), ((k * 11) % 4).cast("string")).alias("stance_label"),
        F.concat(F.lit("claim_"), (F.floor(k / 16.0).cast("bigint") % 4).cast("string")).alias("claim_type"),
        F.col("qty").cast("bigint").alias("likes"),
        F.col("n").cast("bigint").alias("shares"),
        F.col("ret").cast("bigint").alias("comments"),
        F.when(k % 97 == 0, F.lit(0).cast("bigint"))
        .otherwise(F.floor(F.col("ext") / 100).cast("bigint")).alias("impressions_estimate"),
        F.floor(F.col("o_totalprice") / 100).cast("bigint").alias("reach_estimate"),
        (F.col("qty") * 1.7).alias("engagement_velocity"),
        F.when(F.col("disc").isNull(), F.lit(None).cast("double"))
        .otherwise(F.least(F.lit(1.0), 5.0 * F.col("disc") + 0.0005 * ((k * 211) % 1000).cast("double")))
        .alias("misinformation_probability"),
        (1.0 - 10.0 * F.col("tax")).alias("credibility_score"),
        frac1000(401).alias("uncertainty_index"),
        frac1000(503).alias("subjectivity_score"),
        frac1000(307).alias("toxicity_score"),
        F.col("r_name").alias("region"),
        F.lit("English").alias("language"),
        F.when(k % 3 == 0, 1).otherwise(0).cast("int").alias("is_share"),
        F.when(k % 3 == 0, k - 1).cast("bigint").alias("parent_post_id"),
        (k % 6).cast("int").alias("cascade_depth"),
    )


def bronze_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bronze variant with planted exact duplicates (every 50th order twice) for de-duplication."""
    posts = posts_view(spark, sf_dir)
    return posts.unionByName(posts.where(F.col("post_id") % 50 == 0))


def load_posts_csv(spark: SparkSession, path: str, corrupt_column: str | None = None) -> DataFrame:
    """SRC-01/SRC-04: typed CSV load with a fixed schema (never inferred).

    Flags are read as text and coerced with ``try_cast`` (bad -> null); numeric NaN/inf become null.
    A missing path raises ``AnalysisException`` from Spark itself.
    """
    schema = RAW_SCHEMA
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
    if corrupt_column:
        schema = T.StructType([*RAW_SCHEMA.fields, T.StructField(corrupt_column, T.StringType())])
        reader = reader.option("columnNameOfCorruptRecord", corrupt_column)
    df = reader.schema(schema).csv(path)
    return coerce_flags(df)


def coerce_flags(df: DataFrame) -> DataFrame:
    """CLN-06: flag columns to integers; unparsable text -> null."""
    cols = {c: F.expr(f"try_cast({c} as int)") for c in FLAG_COLUMNS if c in df.columns}
    dbl = {f.name: finite(f.name) for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
    return df.withColumns({**cols, **dbl})


def read_stage(spark: SparkSession, path: str) -> DataFrame:
    """SRC-02/03/06: read back a stage output written by ``postlab.sources.sinks``."""
    return spark.read.parquet(path)


def read_tagged(spark: SparkSession, glob_path: str, fmt: str = "parquet", tag: str = "model",
                pattern: str = r"([^/]+?)(\.[a-z]+)?$", of: str = "file_name") -> DataFrame:
    """SRC-05: read many files by glob and tag each row with (part of) its file's name, or of its path."""
    df = spark.read.format(fmt).option("header", True).load(glob_path)
    return df.withColumn(tag, F.regexp_extract(F.col(f"_metadata.{of}"), pattern, 1))
