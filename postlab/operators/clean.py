"""Silver cleaning (CLN-01..12): de-duplication, calendar parts, median / mode filling, coercion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlab.functions.exprs import finite, is_integral, numeric_columns, text_columns
from postlab.operators.stats import exact_medians, modes, null_counts


def drop_exact_duplicates(df: DataFrame) -> DataFrame:
    """CLN-01: identical rows collapse to one (a hash aggregate on all columns, map-side combined)."""
    return df.dropDuplicates()


def add_date_parts(df: DataFrame, timestamp_column: str = "timestamp", keep_as: str | None = "event_ts") -> DataFrame:
    """CLN-02: year, English month name and weekday name; the raw column is dropped.

    Text is parsed with ``try_to_timestamp`` (bad -> null). ``keep_as`` keeps the parsed
    timestamp under another name so real-date aggregates stay possible.
    """
    dtype = df.schema[timestamp_column].dataType
    raw = F.col(timestamp_column)
    ts = F.try_to_timestamp(raw) if isinstance(dtype, T.StringType) else raw
    out = df.withColumns({
        "__ts": ts,
    })
    out = out.withColumns({
        "year": F.year("__ts").cast("int"),
        "month": F.date_format("__ts", "MMMM"),
        "day": F.date_format("__ts", "EEEE"),
    })
    if keep_as:
        out = out.withColumn(keep_as, F.col("__ts"))
    return out.drop(timestamp_column, "__ts")


def fill_parent(df: DataFrame, column: str = "parent_post_id") -> DataFrame:
    """CLN-03: a missing parent means an original post -> 0 (before any median is taken)."""
    return df.fillna({column: 0}) if column in df.columns else df


def numeric_fill_values(df: DataFrame, exclude=(), approx: bool = False) -> dict:
    """Exact column medians of the numeric columns that contain nulls (one null-count pass first)."""
    cols = numeric_columns(df, exclude)
    nulls = null_counts(df, cols)
    need = [c for c in cols if nulls[c]]
    if approx:
        row = df.agg(*[F.percentile_approx(finite(F.col(c).cast("double")), 0.5, 10000).alias(c) for c in need]).first()
        return {c: row[c] for c in need} if need else {}
    return exact_medians(df, need)


def fill_numeric_median(df: DataFrame, exclude=(), approx: bool = False, values: dict | None = None) -> DataFrame:
    """CLN-04: numeric nulls -> column median. Integer columns get the median rounded half-to-even."""
    values = numeric_fill_values(df, exclude, approx) if values is None else values
    repl = {}
    for c, m in values.items():
        if m is None:
            continue
        if is_integral(df, c):
            fill = F.lit(m).cast("double")
            repl[c] = F.coalesce(F.col(c), F.bround(fill, 0).cast(df.schema[c].dataType))
        else:
            repl[c] = F.coalesce(F.col(c), F.lit(float(m)).cast(df.schema[c].dataType))
    return df.withColumns(repl) if repl else df


def text_fill_values(df: DataFrame, exclude=()) -> dict:
    cols = text_columns(df, exclude)
    nulls = null_counts(df, cols)
    return modes(df, [c for c in cols if nulls[c]])


def fill_text_mode(df: DataFrame, exclude=(), values: dict | None = None) -> DataFrame:
    """CLN-05: text nulls -> most frequent value (smallest value on ties)."""
    values = text_fill_values(df, exclude) if values is None else values
    repl = {c: F.coalesce(F.col(c), F.lit(v)) for c, v in values.items() if v is not None}
    return df.withColumns(repl) if repl else df


def fill_values(df: DataFrame, approx: bool = False) -> tuple[dict, dict]:
    """Median fill values of numeric columns and mode fill values of text columns that have nulls.

    One aggregate counts the nulls of every column; only columns with nulls get a median / mode.
    """
    num, txt = numeric_columns(df), text_columns(df)
    nulls = null_counts(df, num + txt)
    need_num = [c for c in num if nulls[c]]
    need_txt = [c for c in txt if nulls[c]]
    if approx and need_num:
        row = df.agg(*[F.percentile_approx(finite(F.col(c).cast("double")), 0.5, 10000).alias(c)
                       for c in need_num]).first()
        med = {c: row[c] for c in need_num}
    else:
        med = exact_medians(df, need_num)
    return med, modes(df, need_txt)


def to_silver(bronze: DataFrame, approx: bool = False, cache: bool = False) -> DataFrame:
    """Bronze -> silver: de-duplicate, calendar parts, parent fill, median fill, mode fill.

    The fill values are computed by bounded Spark jobs and enter the plan as literals, so the
    returned plan is a single narrow projection over the de-duplicated scan. In the pipeline the
    bronze input is a written table, so the statistics passes are pruned parquet scans; ``cache``
    writes the de-duplicated rows as a columnar table in the shared folder, so the passes do not repeat the shuffle
    and read their own columns alone.
    """
    from postlab.session import written

    df = fill_parent(add_date_parts(drop_exact_duplicates(bronze)))
    if cache:
        df = written(df)
    med, mo = fill_values(df, approx)
    return fill_text_mode(fill_numeric_median(df, values=med), values=mo)


def nonfinite_to_null(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """CLN-09: NaN / +-inf -> null on floating columns."""
    cols = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: finite(c) for c in cols}) if cols else df


def valid_target_rows(df: DataFrame, target: str) -> DataFrame:
    """CLN-10: keep rows whose target parses to a finite number."""
    return df.where(finite(F.expr(f"try_cast({target} as double)")).isNotNull())


def drop_id_and_target(df: DataFrame, target: str) -> DataFrame:
    """CLN-11: identifiers and the current target are never features."""
    return df.drop(*[c for c in ("post_id", "parent_post_id", target) if c in df.columns])


def coerce_behaviour_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """CLN-12: keep the listed columns that exist, coerced to double (bad -> null)."""
    present = [c for c in columns if c in df.columns]
    return df.select(*[finite(F.expr(f"try_cast({c} as double)")).alias(c) for c in present])


def narrow_to_float(df: DataFrame) -> DataFrame:
    """CLN-07 (optional): 32-bit floats for the floating columns (ids stay exact)."""
    return df.withColumns({f.name: F.col(f.name).cast("float") for f in df.schema.fields
                           if isinstance(f.dataType, T.DoubleType)})


def categorical_codes(df: DataFrame, column: str, code_column: str | None = None) -> DataFrame:
    """CLN-08: alphabetical category codes 0..k-1 (null -> null).

    The distinct values are numbered with a window over the *distinct* values only; the numbering
    is joined back (a shuffle join unless AQE sees a small side).
    """
    from postlab.operators.star import dense_index

    code_column = code_column or f"{column}_code"
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    coded = dense_index(values, [column], code_column, start=0)
    return df.join(coded, column, "left")


