"""Gold star schema (DIM-01..09, FCT-01..04) and dense surrogate numbering.

Dimension rows are the distinct attribute combinations, numbered 1..n in first-seen order, where
"first seen" is the smallest ``order_by`` value (``post_id``) - Spark has no file order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlab.functions.exprs import bounded_broadcast
from postlab.schema import FACT_COLUMNS, SIMPLE_DIMENSIONS, TIME_COLUMNS, USER_COLUMNS
from postlab.session import cut_lineage

# size bound under which a dimension is broadcast into the fact joins
DIM_BROADCAST_ROWS = 1_000_000


def dense_index(df: DataFrame, order_cols: list[str], key: str, start: int = 1,
                num_partitions: int | None = None) -> DataFrame:
    """Dense keys start..start+n-1 in ``order_cols`` order without a single-task global sort.

    Range-partition on the order columns, number rows inside each partition, then add the row
    count of all earlier partitions (a table of one row per partition, broadcast). The
    range-partitioned frame is checkpointed so both passes see the same partition boundaries
    even if an executor is lost.
    """
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(df.repartitionByRange(n, *order_cols).withColumn("__pid", F.spark_partition_id()))
    local = ranged.withColumn("__rn", F.row_number().over(Window.partitionBy("__pid").orderBy(*order_cols)))
    counts = ranged.groupBy("__pid").agg(F.count(F.lit(1)).alias("__c"))
    offsets = counts.select(
        "__pid",
        (F.sum("__c").over(Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1))).alias("__off"))
    # one row per partition: a proven size bound
    out = local.join(F.broadcast(offsets), "__pid")
    return (out.withColumn(key, (F.coalesce(F.col("__off"), F.lit(0)) + F.col("__rn") + (start - 1)).cast("bigint"))
            .drop("__pid", "__rn", "__off"))


def make_dimension(df: DataFrame, columns: list[str], key: str, order_by: str = "post_id") -> DataFrame:
    """DIM-01..09: distinct combinations of ``columns`` with key 1..n by first appearance."""
    distinct = df.groupBy(*columns).agg(F.min(order_by).alias("__first"))
    return dense_index(distinct, ["__first"], key).select(*columns, key)


def build_dimensions(silver: DataFrame, order_by: str = "post_id") -> dict[str, DataFrame]:
    dims = {"dim_users": make_dimension(silver, USER_COLUMNS, "user_id", order_by)}
    for col, key in SIMPLE_DIMENSIONS:
        dims[f"dim_{col}"] = make_dimension(silver, [col], key, order_by)
    dims["dim_time"] = make_dimension(silver, TIME_COLUMNS, "time_id", order_by)
    return dims


def attach_key(fact: DataFrame, dim: DataFrame, columns: list[str], key: str,
               max_broadcast_rows: int = DIM_BROADCAST_ROWS) -> DataFrame:
    """FCT-01/02: left lookup of a surrogate key on null-safe equality of ``columns``.

    The dimension is broadcast only after a bounded row-count check; a large one (users)
    stays a sort-merge join on the attribute columns.
    """
    d = dim.select(*[F.col(c).alias(f"__d_{c}") for c in columns], key)
    d = bounded_broadcast(d, max_broadcast_rows)
    cond = [F.col(c).eqNullSafe(F.col(f"__d_{c}")) for c in columns]
    return fact.join(d, cond, "left").drop(*[f"__d_{c}" for c in columns])


def build_fact(silver: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
    """FCT-03: the 27-column fact table."""
    fact = attach_key(silver, dims["dim_users"], USER_COLUMNS, "user_id")
    for col, key in SIMPLE_DIMENSIONS:
        fact = attach_key(fact, dims[f"dim_{col}"], [col], key)
    fact = attach_key(fact, dims["dim_time"], TIME_COLUMNS, "time_id")
    return fact.select(*FACT_COLUMNS)


def star_checks(silver: DataFrame, fact: DataFrame) -> DataFrame:
    """FCT-04: referential checks in one row (fact rows = silver rows, no null key, unique post)."""
    keys = [c for c in FACT_COLUMNS if c.endswith("_id") and c not in ("post_id", "parent_post_id")]
    null_any = F.greatest(*[F.col(k).isNull().cast("int") for k in keys])
    f = fact.agg(F.count(F.lit(1)).alias("fact_rows"),
                 F.sum(null_any).cast("bigint").alias("rows_with_null_key"),
                 F.count_distinct("post_id").alias("distinct_post_ids"))
    return f.withColumn("silver_rows", F.lit(silver.count()).cast("bigint"))
