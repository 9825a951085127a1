"""Tables and helpers that the registered queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def value(spark: SparkSession, **values: float) -> DataFrame:
    """One row of results that a driver loop ended with."""
    return spark.createDataFrame([tuple(float(v) for v in values.values())], ", ".join(f"{k} double" for k in values))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that sums in another order compare equal."""
    return df.select(*(F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


#: The columns that most queries learn from: numbers of a line item on like scales, and two labels.
LINE_SQL = """(SELECT l_orderkey, l_linenumber, l_quantity AS q, l_extendedprice / 1000.0 AS price, l_discount * 100.0 AS d, l_tax * 100.0 AS t,
    CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS flag, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS status FROM lineitem)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return li.select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("q"), (F.col("l_extendedprice").cast("double") / 1000.0).alias("price"), (F.col("l_discount").cast("double") * 100.0).alias("d"), (F.col("l_tax").cast("double") * 100.0).alias("t"), flag.alias("flag"), (F.col("l_linestatus") == "F").cast("int").alias("status"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", (F.col("o_totalprice").cast("double") / 1000.0).alias("total"), "o_orderpriority", "o_orderstatus", F.year("o_orderdate").cast("double").alias("year"), F.month("o_orderdate").cast("double").alias("month"), F.dayofmonth("o_orderdate").cast("double").alias("day"))


ORDERS_SQL = "(SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) / 1000.0 AS total, o_orderpriority, o_orderstatus, CAST(year(o_orderdate) AS DOUBLE) AS year, CAST(month(o_orderdate) AS DOUBLE) AS month, CAST(day(o_orderdate) AS DOUBLE) AS day FROM orders)"
