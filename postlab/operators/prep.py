"""Machine-learning preparation (MLP-01..06).

Splits and samples are by hash of the row id, so they do not change with partitioning or retries
(``randomSplit`` / ``rand`` would). Scaling uses the population standard deviation with a constant
column divided by 1, and imputation uses exact medians, as the behaviour being reproduced does;
``pyspark.ml.feature.StandardScaler`` (sample std) and ``Imputer`` (approximate / lower median)
would give other numbers.
"""

from __future__ import annotations

from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlab.functions.exprs import finite, numeric_columns, text_columns
from postlab.operators.features import LEAKY
from postlab.operators.stats import exact_medians, modes

ID_COLUMNS = ("post_id", "parent_post_id")


def hash_bucket(key: str, seed: int, buckets: int = 100) -> F.Column:
    return F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(buckets))


def feature_target_split(df: DataFrame, target: str, exclude_leaky: bool = True, key: str = "post_id"):
    """MLP-01 (CLN-10 + CLN-11): rows with a finite target; features = all but ids and the target.

    Returns (frame with ``key``, ``label`` and the feature columns, numeric features, categorical features).
    ``exclude_leaky`` also drops features computed from the targets.
    """
    label = finite(F.expr(f"try_cast({target} as double)"))
    excluded = set(ID_COLUMNS) | {target, "event_ts"} | (set(LEAKY) if exclude_leaky else set())
    feats = [c for c in df.columns if c not in excluded]
    out = df.select(F.col(key), label.alias("label"), *feats).where(F.col("label").isNotNull())
    num = [c for c in numeric_columns(out) if c in feats]
    cat = [c for c in text_columns(out) if c in feats]
    return out, num, cat


def train_test_split(df: DataFrame, seed: int = 42, test_percent: int = 20, key: str = "post_id"):
    """MLP-02: deterministic 80/20 split by ``pmod(xxhash64(id, seed), 100)``."""
    b = hash_bucket(key, seed)
    return df.where(b >= test_percent), df.where(b < test_percent)


def fold_column(df: DataFrame, folds: int = 2, seed: int = 42, key: str = "post_id", name: str = "fold") -> DataFrame:
    return df.withColumn(name, F.pmod(F.xxhash64(F.col(key), F.lit(seed + 1)), F.lit(folds)).cast("int"))


def subsample(df: DataFrame, max_rows: int, seed: int = 42, key: str = "post_id") -> DataFrame:
    """MLP-06: exactly min(n, max_rows) rows, chosen by hash order (TakeOrderedAndProject, no full sort)."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), F.col(key)).limit(max_rows)


# ------------------------------------------------------------------ fill + scale estimator (MLP-03)
class _FillScaleParams(Params):
    numericCols = Param(Params._dummy(), "numericCols", "numeric input columns", TypeConverters.toListString)
    categoricalCols = Param(Params._dummy(), "categoricalCols", "text input columns", TypeConverters.toListString)
    scale = Param(Params._dummy(), "scale", "standardise numerics", TypeConverters.toBoolean)
    onlyNullColumns = Param(Params._dummy(), "onlyNullColumns", "medians only of columns with nulls, as fit and apply see the "
                            "same rows", TypeConverters.toBoolean)


class FillScale(Estimator, _FillScaleParams, DefaultParamsReadable, DefaultParamsWritable):
    """Numerics: exact median fill then (x - mean) / population std (std 0 -> 1), written in place.
    Text: mode fill (smallest value on ties). Stats are fitted per training set, so cross-validation
    refits them per fold."""

    def __init__(self, numericCols=None, categoricalCols=None, scale=True, onlyNullColumns=False):
        super().__init__()
        self._setDefault(numericCols=[], categoricalCols=[], scale=True, onlyNullColumns=False)
        self._set(numericCols=numericCols or [], categoricalCols=categoricalCols or [], scale=scale,
                  onlyNullColumns=onlyNullColumns)

    def _fit(self, df: DataFrame):
        num = self.getOrDefault("numericCols")
        cat = self.getOrDefault("categoricalCols")
        if self.getOrDefault("onlyNullColumns") and num:
            from postlab.operators.stats import null_counts
            nulls = null_counts(df, num)
            med = {c: 0.0 for c in num}
            med.update(exact_medians(df, [c for c in num if nulls[c]]))
        else:
            med = exact_medians(df, num) if num else {}
        filled = {c: F.coalesce(finite(F.col(c).cast("double")), F.lit(med[c])) for c in num}
        row = df.select(*[filled[c].alias(c) for c in num]).agg(
            *[F.avg(c).alias(f"m{i}") for i, c in enumerate(num)],
            *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(num)]).first() if num else None
        means = [float(row[f"m{i}"] or 0.0) for i in range(len(num))] if num else []
        stds = [float(row[f"s{i}"] or 0.0) for i in range(len(num))] if num else []
        mo = modes(df, cat) if cat else {}
        return FillScaleModel(num, cat, [float(med[c]) if med[c] is not None else 0.0 for c in num], means,
                              [s if s > 0 else 1.0 for s in stds], [mo[c] or "" for c in cat],
                              self.getOrDefault("scale"))


class _FillScaleModelParams(_FillScaleParams):
    medians = Param(Params._dummy(), "medians", "fill values", TypeConverters.toListFloat)
    means = Param(Params._dummy(), "means", "means", TypeConverters.toListFloat)
    stds = Param(Params._dummy(), "stds", "population std (0 -> 1)", TypeConverters.toListFloat)
    modeValues = Param(Params._dummy(), "modeValues", "text fill values", TypeConverters.toListString)


class FillScaleModel(Model, _FillScaleModelParams, DefaultParamsReadable, DefaultParamsWritable):
    def __init__(self, numericCols=None, categoricalCols=None, medians=None, means=None, stds=None,
                 modeValues=None, scale=True):
        super().__init__()
        self._set(numericCols=numericCols or [], categoricalCols=categoricalCols or [], medians=medians or [],
                  means=means or [], stds=stds or [], modeValues=modeValues or [], scale=scale)

    def _transform(self, df: DataFrame) -> DataFrame:
        num = self.getOrDefault("numericCols")
        cat = self.getOrDefault("categoricalCols")
        med, mu, sd = self.getOrDefault("medians"), self.getOrDefault("means"), self.getOrDefault("stds")
        scale = self.getOrDefault("scale")
        out = {}
        for i, c in enumerate(num):
            v = F.coalesce(finite(F.col(c).cast("double")), F.lit(med[i]))
            out[c] = (v - F.lit(mu[i])) / F.lit(sd[i]) if scale else v
        for c, m in zip(cat, self.getOrDefault("modeValues")):
            out[c] = F.coalesce(F.col(c), F.lit(m))
        return df.withColumns(out) if out else df


#: Distinct values of a text column up to which it is one-hot encoded; the indexer holds them on the driver.
MAX_CATEGORIES = 10_000


def check_categories(df: DataFrame, cat: list[str]) -> None:
    """Raise if a text column has too many values to be one-hot encoded."""
    if cat:
        row = df.agg(*[F.approx_count_distinct(c).alias(c) for c in cat]).first()
        wide = [c for c in cat if row[c] > MAX_CATEGORIES]
        if wide:
            raise ValueError(f"more than {MAX_CATEGORIES} values in {', '.join(wide)}")


def preprocessing_stages(num: list[str], cat: list[str], output: str = "features") -> list:
    """MLP-03: fill/scale, then alphabetical one-hot with an unseen-category slot that is dropped
    (unseen -> all zeros), then one assembled vector. Feature names are kept in the vector's ML
    attributes (MLP-04)."""
    stages = [FillScale(num, cat)]
    ohe_cols = []
    for c in cat:
        stages.append(StringIndexer(inputCol=c, outputCol=f"{c}__idx", handleInvalid="keep",
                                    stringOrderType="alphabetAsc"))
        ohe_cols.append(f"{c}__ohe")
    if cat:
        # the indexer's extra "unknown" index is the last category, which dropLast removes
        stages.append(OneHotEncoder(inputCols=[f"{c}__idx" for c in cat], outputCols=ohe_cols, dropLast=True,
                                    handleInvalid="error"))
    stages.append(VectorAssembler(inputCols=num + ohe_cols, outputCol=output, handleInvalid="keep"))
    return stages


def processed_feature_names(df: DataFrame, vector_col: str = "features") -> list[str]:
    """MLP-04: names of the assembled features in vector order, from the column's ML metadata."""
    meta = df.schema[vector_col].metadata.get("ml_attr", {}).get("attrs", {})
    slots = []
    for group in meta.values():
        for a in group:
            slots.append((a["idx"], a["name"]))
    names = [n for _i, n in sorted(slots)]
    return [n.replace("__ohe_", "_") for n in names]


# ------------------------------------------------------------------ scaled behaviour matrix (MLP-05)
def scaled_matrix(df: DataFrame, columns: list[str], key: str = "post_id", vector_col: str = "features_scaled",
                  keep: list[str] | None = None) -> DataFrame:
    """MLP-05: exact-median imputed columns (same names), scaled copies ``z_<col>`` and one vector.

    Fill values and moments are computed by bounded aggregates and enter the plan as literals.
    """
    present = [c for c in columns if c in df.columns]
    base = df.select(F.col(key), *[finite(F.expr(f"try_cast({c} as double)")).alias(c) for c in present],
                     *[c for c in (keep or []) if c not in present and c != key])
    # the fill is applied to the rows it is fitted on, so only columns with nulls need a median
    model = FillScale(present, [], scale=False, onlyNullColumns=True).fit(base)
    med, mu, sd = (model.getOrDefault("medians"), model.getOrDefault("means"), model.getOrDefault("stds"))
    imputed = {c: F.coalesce(F.col(c), F.lit(med[i])) for i, c in enumerate(present)}
    out = base.withColumns(imputed)
    out = out.withColumns({f"z_{c}": (F.col(c) - F.lit(mu[i])) / F.lit(sd[i]) for i, c in enumerate(present)})
    return out.withColumn(vector_col, array_to_vector(F.array(*[F.col(f"z_{c}") for c in present])))


def fit_pipeline(stages: list, df: DataFrame):
    return Pipeline(stages=stages).fit(df)
