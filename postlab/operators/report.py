"""Report data products (REP-01..05): the numbers behind the written reports, as tables."""

from __future__ import annotations

import time
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def long_metrics(section: str, model: str, wide: DataFrame) -> DataFrame:
    """REP-01: one-row metric table -> (section, model, metric, value) with values rounded to 4."""
    num = [f.name for f in wide.schema.fields if f.dataType.typeName() in ("double", "float", "long", "integer")]
    return (wide.select(*[F.col(c).cast("double").alias(c) for c in num])
            .unpivot([], num, "metric", "value")
            .select(F.lit(section).alias("section"), F.lit(model).alias("model"), "metric",
                    F.round("value", 4).alias("value")))


def union_all(frames: list[DataFrame]) -> DataFrame | None:
    """SET-01: row-wise concatenation by column name."""
    out = None
    for f in frames:
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return out


def forecast_section(directions: DataFrame) -> DataFrame:
    """REP-01: recent and forecast means of every series as metric rows."""
    return directions.unpivot("metric", ["recent_mean", "forecast_mean"], "name", "value").select(
        F.lit("forecast").alias("section"), F.col("metric").alias("model"), F.col("name").alias("metric"), F.round("value", 4).alias("value"))


def findings(forecasts: DataFrame, drivers: DataFrame) -> DataFrame:
    """REP-03: (kind, subject, value): mean of the forecast days per series, strongest driver of either sign per target."""
    ahead = forecasts.where("is_future").groupBy(F.col("metric").alias("subject")).agg(F.avg("yhat").alias("value"))
    ahead = ahead.select(F.lit("mean_forecast").alias("kind"), "subject", "value")
    top = drivers.groupBy("target").agg(F.max_by("feature", "directional_effect").alias("up"), F.max("directional_effect").alias("up_effect"),
                                        F.min_by("feature", "directional_effect").alias("down"), F.min("directional_effect").alias("down_effect"))
    rows = F.explode(F.array(*[F.struct(F.concat(F.lit(f"{k}_driver_of_"), "target").alias("kind"), F.col(n).alias("subject"), F.col(f"{n}_effect").alias("value"))
                               for k, n in (("positive", "up"), ("negative", "down"))]))
    return ahead.unionByName(top.select(rows.alias("p")).select("p.*"))


def fact_type(value) -> str:
    """SQL type of a scalar fact; whatever is no number or flag is text."""
    return "boolean" if isinstance(value, bool) else "bigint" if isinstance(value, int) else "double" if isinstance(value, float) else "string"


def executive_facts(spark: SparkSession, facts: dict) -> DataFrame:
    """REP-02/03: one-row summary from scalar facts gathered by the stages; numbers and flags keep their type."""
    keys = sorted(facts)
    row = tuple(v if v is None or fact_type(v) != "string" else str(v) for v in map(facts.get, keys))
    return spark.createDataFrame([row], ", ".join(f"`{k}` {fact_type(facts[k])}" for k in keys))


def top_drivers(drivers: DataFrame) -> DataFrame:
    """REP-02: per target the feature of largest absolute directional effect (ties: the first by name)."""
    size = F.abs("directional_effect")
    return drivers.groupBy("target").agg(F.min_by("feature", F.struct((-size).alias("less"), "feature")).alias("top_driver"),
                                         F.max(size).alias("effect"))


class StageSkipped(Exception):
    """Raised inside a stage that the caller left out."""


class StageTimer:
    """REP-05: wall-clock seconds per stage, with a status (ok / failed / reused / skipped)."""

    def __init__(self):
        self.rows: list[tuple] = []

    @contextmanager
    def stage(self, name: str):
        t0 = time.perf_counter()
        status = {"value": "ok", "error": None}
        try:
            yield status
        except StageSkipped:
            status["value"] = "skipped"
        except Exception as exc:  # noqa: BLE001 - a failed stage must not stop the pipeline
            status["value"], status["error"] = "failed", f"{type(exc).__name__}: {str(exc)[:300]}"
        self.rows.append((name, round(time.perf_counter() - t0, 2), status["value"], status["error"]))

    def table(self, spark: SparkSession) -> DataFrame:
        total = round(sum(r[1] for r in self.rows), 2)
        return spark.createDataFrame(self.rows + [("total", total, "ok", None)],
                                     "stage string, seconds double, status string, error string")
