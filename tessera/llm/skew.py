"""Joins to a table of one row a key, where a key may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys whose row is broadcast; none of the others has more than this part of all rows.
TOP = 1000


def join_one(rows: DataFrame, one: DataFrame, keys: list[str], values: list[str], weight: str, salt: Column, hint: str | None = None) -> DataFrame:
    """``rows`` with the ``values`` of the row of ``one`` with the same ``keys``; rows without one go.

    ``one`` has a row a key, and its number of rows as ``weight``. The ``TOP`` heaviest keys get their values from a
    broadcast of these few rows, and are dealt by ``salt`` in the join that finds the others'. ``values`` aren't null.
    """
    top = one.orderBy(F.desc(weight), *keys).limit(TOP).select(*(F.col(k).alias(f"t_{k}") for k in keys), *(F.col(v).alias(f"t_{v}") for v in values))
    wide = rows.join(F.broadcast(top), _same(keys, "", "t_"), "left")
    wide = wide.withColumn("s_salt", F.when(F.col(f"t_{values[0]}").isNotNull(), F.pmod(F.xxhash64(salt), F.lit(1 << 20)) + 1).otherwise(F.lit(0).cast("long")))
    # 0 for all, but not a literal, with which the planner would take the salt out of the join's keys again
    salt0 = F.when(F.col(weight) > 0, F.lit(0)).otherwise(F.lit(-1)).cast("long")
    each = one.select(*(F.col(k).alias(f"o_{k}") for k in keys), *(F.col(v).alias(f"o_{v}") for v in values), salt0.alias("o_salt"))
    out = wide.join(each.hint(hint) if hint else each, _same(keys, "", "o_") & (F.col("s_salt") == F.col("o_salt")), "left")
    return out.select(*rows.columns, *(F.coalesce(f"t_{v}", f"o_{v}").alias(v) for v in values)).filter(F.col(values[0]).isNotNull())


def _same(keys: list[str], a: str, b: str) -> Column:
    out = F.col(a + keys[0]) == F.col(b + keys[0])
    for k in keys[1:]:
        out = out & (F.col(a + k) == F.col(b + k))
    return out
