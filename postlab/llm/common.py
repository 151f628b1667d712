"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlab.session import ensure_checkpoint_dir, prepare_session

#: Rows handed to a Python worker at once; keeps a batch of long texts far below a worker's memory.
ARROW_ROWS = 1000


def prepare(spark: SparkSession) -> None:
    """Checkpoint folder, package shipping and Arrow batch size; idempotent."""
    prepare_session(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder name inside the checkpoint folder all machines share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts the lineage and survives
    the loss of any executor."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def id_remainder(col: Column | str, modulus: int) -> Column:
    """``crc32(id as text) mod modulus``; null ids hash like the empty text."""
    c = F.col(col) if isinstance(col, str) else col
    return F.crc32(F.coalesce(c.cast("string"), F.lit(""))) % modulus


def id_remainder_py(value, modulus: int) -> int:
    """Python twin of :func:`id_remainder`."""
    return zlib.crc32(b"" if value is None else str(value).encode()) % modulus
