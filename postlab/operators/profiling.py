"""Profiling (PRF-01..05): preview, numeric profile, schema profile, column-type split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlab.functions.exprs import finite, numeric_columns
from postlab.operators.stats import exact_quantiles
from postlab.plans.sqltext import INT32, SILVER_DOUBLE, SILVER_INTEGRAL, SILVER_TEXT

QUARTILES = [0.25, 0.5, 0.75]
MOMENTS = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
#: Columns whose moments share a scan.
AT_ONCE = 8


def preview(df: DataFrame, n: int = 5, order_by: str = "post_id") -> DataFrame:
    """PRF-01: first n rows in ``order_by`` order (a top-k, not a sort of the table)."""
    return df.orderBy(order_by).limit(n)


def split_columns(df: DataFrame) -> tuple[list[str], list[str]]:
    """PRF-04: (numeric columns, other columns)."""
    num = numeric_columns(df)
    return num, [c for c in df.columns if c not in num]


def describe(df: DataFrame, columns: list[str] | None = None, approx: bool = False) -> DataFrame:
    """PRF-02: count, mean, sample std, min, quartiles, max for each numeric column (one row each).

    Moments are plain aggregates of ``AT_ONCE`` columns a scan, no row is multiplied; quartiles come from the exact
    order-statistic search (or ``percentile_approx`` with ``approx=True``). A table without rows gives none.
    """
    cols = columns or numeric_columns(df)
    out, n = [], 0
    vals = {} if approx else exact_quantiles(df, cols, QUARTILES)
    for at in range(0, len(cols), AT_ONCE):
        some = cols[at:at + AT_ONCE]
        v = df.select(*[finite(F.col(c).cast("double")).alias(f"v{i}") for i, c in enumerate(some)])
        aggs = [f(f"v{i}").alias(f"{name}{i}") for i in range(len(some)) for name, f in MOMENTS.items()]
        if approx:
            aggs += [F.percentile_approx(f"v{i}", QUARTILES, 10000).alias(f"q{i}") for i in range(len(some))]
        row = v.agg(F.count(F.lit(1)).alias("n"), *aggs).first()
        n = row["n"]
        for i, c in enumerate(some):
            quartiles = (row[f"q{i}"] or [None] * len(QUARTILES)) if approx else [vals[(c, p)] for p in QUARTILES]
            out.append((c, *[row[f"{name}{i}"] for name in ("count", "mean", "std", "min")],
                        *[None if x is None else float(x) for x in quartiles], row[f"max{i}"]))
    # one row per column: bounded by the schema
    return df.sparkSession.createDataFrame(out if n else [], "column_name string, count long, mean double, std double, min double, p25 double, "
                                                             "p50 double, p75 double, max double")


def describe_sql(cols: list[str]) -> str:
    parts = []
    for c in cols:
        v = f"CAST({c} AS DOUBLE)"
        parts.append(
            f"SELECT '{c}' AS column_name, count({v}) AS count, avg({v}) AS mean, "
            f"stddev_samp({v}) AS std, min({v}) AS min, "
            f"quantile_cont({v}, 0.25) AS p25, quantile_cont({v}, 0.5) AS p50, "
            f"quantile_cont({v}, 0.75) AS p75, max({v}) AS max FROM silver")
    return "\nUNION ALL\n".join(parts)


def null_count_table(df: DataFrame, cols: list[str]) -> DataFrame:
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    arr = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("bigint").alias("nulls")) for c in cols])
    return row.select(F.explode(arr).alias("p")).select("p.column_name", "p.nulls")


def schema_profile(df: DataFrame, approx: bool = False) -> DataFrame:
    """PRF-03: column, type, non-null count, distinct count (nulls not counted) and the row count.

    Rows are unpivoted to (column, value) and counted by both, partly before the shuffle, then by column; ``approx``
    replaces the exact distinct counts by sketches in one aggregate."""
    types = dict(df.dtypes)
    names = df.sparkSession.createDataFrame(list(enumerate(df.columns)), "i int, column_name string")
    if approx:
        row = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(f"nn{i}") for i, c in enumerate(df.columns)],
                     *[F.approx_count_distinct(c).alias(f"u{i}") for i, c in enumerate(df.columns)])
        per = row.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"nn{i}").alias("non_null_count"), F.col(f"u{i}").alias("unique_values"),
                                                      F.col("rows").alias("table_rows")) for i in range(len(df.columns))])).alias("p")).select("p.*")
    else:
        cells = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("string").alias("v")) for i, c in enumerate(df.columns)]))
        counted = df.select(cells.alias("p")).select("p.i", "p.v").groupBy("i", "v").agg(F.count(F.lit(1)).alias("n"))
        per = counted.groupBy("i").agg(F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("n"))), F.lit(0)).alias("non_null_count"),
                                       F.count("v").alias("unique_values"), F.sum("n").alias("table_rows"))
    kinds = F.create_map(*[F.lit(x) for c in df.columns for x in (c, types[c])])
    # one row per column: bounded by the schema
    return per.join(F.broadcast(names), "i").select("column_name", kinds[F.col("column_name")].alias("dtype"), F.col("non_null_count").cast("bigint").alias("non_null_count"),
                                                    F.col("unique_values").cast("bigint").alias("unique_values"), F.col("table_rows").cast("bigint").alias("table_rows"))


def schema_profile_sql() -> str:
    def dtype(c):
        if c in SILVER_INTEGRAL:
            return "int" if c in INT32 else "bigint"
        if c in SILVER_DOUBLE:
            return "double"
        return "string"
    cols = SILVER_INTEGRAL + SILVER_DOUBLE + SILVER_TEXT
    parts = [f"SELECT '{c}' AS column_name, '{dtype(c)}' AS dtype, count({c}) AS non_null_count, "
             f"count(DISTINCT {c}) AS unique_values, count(*) AS table_rows FROM silver" for c in cols]
    parts.append("SELECT 'event_ts', 'timestamp_ntz', count(event_ts), count(DISTINCT event_ts), count(*) FROM silver")
    return "\nUNION ALL\n".join(parts)


