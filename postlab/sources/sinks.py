"""Sinks (SNK-01..07): table writes, JSON export, model persistence, resumable stages, metric sanitising."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from postlab.functions.exprs import finite


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite",
                fmt: str = "parquet") -> int:
    """SNK-01/02/03: write one table and return its row count, observed during the write (no second pass)."""
    obs = Observation(f"rows_{abs(hash(path))}")
    w = df.observe(obs, F.count(F.lit(1)).alias("rows")).write.mode(mode).format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w = w.option("header", True)
    w.save(path)
    return int(obs.get["rows"])


def write_json(df: DataFrame, path: str) -> int:
    """SNK-04: JSON-lines export (one record per row)."""
    return write_table(df, path, fmt="json")


def save_model(model, path: str) -> str:
    """SNK-05: Spark ML persistence (overwrite)."""
    model.write().overwrite().save(path)
    return path


def load_pipeline_model(path: str):
    from pyspark.ml import PipelineModel
    return PipelineModel.load(path)


RESULT_TABLES = ("metrics", "importance", "drivers", "predictions")


def load_model_result(spark: SparkSession, out_dir: str, target: str) -> dict | None:
    """SNK-07: a target's saved model and its four tables, or None unless all five are there and hold the target.

    The metrics are sanitised; the tables are checkpointed, as a run may overwrite their folders."""
    from postlab.session import cut_lineage

    store = spark._jvm.org.apache.hadoop.fs.Path(out_dir).getFileSystem(spark._jsc.hadoopConfiguration())
    model_dir = f"{out_dir}/models/gbt_{target}"
    folders = {k: f"{out_dir}/model_{k}/target={target}" for k in RESULT_TABLES}
    if not all(store.exists(spark._jvm.org.apache.hadoop.fs.Path(p)) for p in [model_dir, *folders.values()]):
        return None
    found = {k: cut_lineage(spark.read.parquet(p).withColumn("target", F.lit(target))) for k, p in folders.items()}
    if any(t.isEmpty() for t in found.values()):
        return None
    keys = ["mae", "rmse", "r2", "best_cv_rmse", "training_seconds"]
    found["metrics"] = sanitize_metrics(found["metrics"], keys).withColumn("target", F.lit(target))
    return found | {"model": load_pipeline_model(model_dir)}


def input_fingerprint(df: DataFrame, params: dict | None = None) -> str | None:
    """Fingerprint of a file-based input: (path, size, mtime) of every file the plan reads, plus params.

    File metadata is listed by Spark (``binaryFile`` without content) and folded into one
    order-independent sum of hashes, so only one number reaches the driver.
    """
    spark = df.sparkSession
    files = df.inputFiles()
    if not files:
        return None  # rows from memory have no identity that a later run could check
    meta = spark.read.format("binaryFile").load(files).select("path", "length", "modificationTime")
    h = meta.agg(F.sum(F.xxhash64("path", "length", F.col("modificationTime").cast("long")).cast("decimal(38,0)"))
                 .alias("h"), F.count(F.lit(1)).alias("n")).first()
    extra = json.dumps(params or {}, sort_keys=True, default=str)
    return f"{h['h']}:{h['n']}:{extra}"


class StageManifest:
    """SNK-06: resumable stages keyed by (stage, input fingerprint); stale outputs are recomputed (D7).

    The manifest is a small JSON table next to the outputs (one record per completed stage).
    """

    def __init__(self, spark: SparkSession, out_dir: str):
        self.spark = spark
        self.path = os.path.join(out_dir, "_manifest")

    def _rows(self) -> list[dict]:
        try:
            return [r.asDict() for r in self.spark.read.json(self.path).collect()]
        except Exception:  # noqa: BLE001 - no manifest yet
            return []

    def is_fresh(self, stage: str, fingerprint: str) -> bool:
        return any(r.get("stage") == stage and r.get("fingerprint") == fingerprint for r in self._rows())

    def mark(self, stage: str, fingerprint: str | None, outputs: list[str]) -> None:
        rows = [r for r in self._rows() if r.get("stage") != stage]
        if fingerprint is not None:
            rows.append({"stage": stage, "fingerprint": fingerprint, "outputs": ",".join(outputs),
                         "updated_at": time.strftime("%Y-%m-%dT%H:%M:%S")})
        self.spark.createDataFrame(rows, "stage string, fingerprint string, outputs string, updated_at string") \
            .coalesce(1).write.mode("overwrite").json(self.path)


def sanitize_metrics(df: DataFrame, numeric_keys: list[str]) -> DataFrame:
    """SNK-07: keep only the known metric columns; text / NaN / inf / null -> 0.0."""
    present = [k for k in numeric_keys if k in df.columns]
    return df.select(*[F.coalesce(finite(F.expr(f"try_cast({k} as double)")), F.lit(0.0)).alias(k) for k in present])
