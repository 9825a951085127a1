"""Feature tables in and out: files by format, and numpy arrays."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = ("parquet", "orc", "csv", "json")


def read(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """A table, of which only ``columns`` are read where the format allows it. CSV has a header."""
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    r = spark.read.option("header", True) if fmt == "csv" else spark.read
    if schema is not None:
        r = r.schema(schema)
    df = r.format(fmt).load(path)
    return df.select(*columns) if columns else df


def write(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    w = df.write.mode(mode).partitionBy(*partition_by) if partition_by else df.write.mode(mode)
    (w.option("header", True) if fmt == "csv" else w).format(fmt).save(path)


def from_numpy(spark: SparkSession, x: np.ndarray, y: np.ndarray | None = None, names: Sequence[str] | None = None) -> DataFrame:
    """Columns _rid, f0.. (or ``names``) and y."""
    import pyarrow as pa

    names = list(names or (f"f{j}" for j in range(x.shape[1])))
    cols = {"_rid": pa.array(np.arange(len(x)))} | {n: pa.array(np.asarray(x[:, j], float)) for j, n in enumerate(names)}
    if y is not None:
        cols["y"] = pa.array(y)
    return spark.createDataFrame(pa.table(cols))


def to_numpy(df: DataFrame, features: Sequence[str], limit: int = 1_000_000) -> np.ndarray:
    rows = df.select(*(F.col(f).cast("double").alias(f) for f in features)).limit(limit + 1).toArrow()
    if rows.num_rows > limit:
        raise ValueError(f"over {limit} rows")
    return np.stack([rows[f].to_numpy() for f in features], 1)
