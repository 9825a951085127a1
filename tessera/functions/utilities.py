"""Checks, weights and samples over tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.core import col
from tessera.operators.splitters import positions, shuffled, train_test_split


def unique_labels(df: DataFrame, *labels: str) -> list:
    return sorted({r[0] for c in labels for r in df.select(col(c)).dropna().distinct().collect()})


def type_of_target(df: DataFrame, label: str) -> str:
    """binary for {0, 1} or less, multiclass for more than two whole numbers, else continuous."""
    x = col(label).cast("double")
    r = df.agg(F.count_distinct(x).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.max((x != F.floor(x)).cast("int")).alias("broken")).first()
    if r["broken"]:
        return "continuous"
    if r["n"] <= 2 and r["lo"] in (0.0, 1.0) and r["hi"] in (0.0, 1.0):
        return "binary"
    return "multiclass" if r["n"] > 2 else "continuous"


def is_multiclass(df: DataFrame, label: str) -> bool:
    return type_of_target(df, label) == "multiclass"


def _any(df: DataFrame, columns: Sequence[str], test) -> bool:
    return bool(df.agg(F.max(F.greatest(*(test(col(c).cast("double")).cast("int") for c in columns), F.lit(0)))).first()[0])


def check_has_nan(df: DataFrame, columns: Sequence[str]) -> bool:
    return _any(df, columns, lambda x: x.isNull() | F.isnan(x))


def check_has_inf(df: DataFrame, columns: Sequence[str]) -> bool:
    return _any(df, columns, lambda x: F.abs(x) == float("inf"))


def check_finite(df: DataFrame, columns: Sequence[str]) -> bool:
    return not check_has_nan(df, columns) and not check_has_inf(df, columns)


def compute_class_weight(df: DataFrame, label: str, mode: str = "balanced") -> DataFrame:
    """(label, weight): n / (k n_c), or 1 / k."""
    c = df.groupBy(col(label).alias("label")).agg(F.count("*").alias("n"))
    total = F.broadcast(c.agg(F.sum("n").alias("total"), F.count("*").alias("k")))  # one row
    w = F.col("total") / (F.col("k") * F.col("n")) if mode == "balanced" else 1 / F.col("k")
    return c.crossJoin(total).select("label", w.cast("double").alias("weight"))


def compute_sample_weight(df: DataFrame, key: str, weights: DataFrame, name: str = "sample_weight") -> DataFrame:
    """``weights`` (key, weight) beside the rows; 1 where there is none."""
    w = weights.toDF("k#", "w#")
    return df.join(w, col(key) == F.col("k#"), "left").withColumn(name, F.coalesce("w#", F.lit(1.0))).drop("k#", "w#")


def resample(df: DataFrame, random_state: int = 0) -> DataFrame:
    from tessera.operators.compose import bootstrap

    return bootstrap(df, random_state)


def shuffle(df: DataFrame, key: str, random_state: int = 0) -> DataFrame:
    """``df`` with ``position``, its rows' places in a seeded order."""
    return positions(df, shuffled(random_state, col(key)), "position")


def train_test_split_stratified(df: DataFrame, key: str, label: str, test_size: float = 0.25, random_state: int = 0) -> tuple[DataFrame, DataFrame]:
    return train_test_split(df, key, test_size, True, random_state, label)


def issparse(df: DataFrame) -> bool:
    return False


def shape(df: DataFrame) -> tuple[int, int]:
    return df.count(), len(df.columns)


def safe_index(n: int, i: int) -> int:
    """A place that may count from the end."""
    j = i + n if i < 0 else i
    if not 0 <= j < n:
        raise IndexError(i)
    return j
