"""Saved estimators: JSON parameters and arrays in a one-row Parquet table, by any path that Spark can write."""

from __future__ import annotations

import base64
import importlib
import io
import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession

VERSION = 1


def _plain(v):
    """A JSON form of parameters and fitted values."""
    if isinstance(v, np.ndarray):
        b = io.BytesIO()
        np.save(b, v, allow_pickle=False)
        return {"@array": base64.b64encode(b.getvalue()).decode()}
    if isinstance(v, np.generic):
        return v.item()
    if isinstance(v, dict):
        return {"@dict": [[_plain(k), _plain(x)] for k, x in v.items()]}
    if isinstance(v, tuple):
        return {"@tuple": [_plain(x) for x in v]}
    if isinstance(v, list):
        return [_plain(x) for x in v]
    if v is None or isinstance(v, (bool, int, float, str)):
        return v
    if type(v).__module__.startswith("tessera."):
        return {"@class": f"{type(v).__module__}:{type(v).__qualname__}", "state": _plain({k: x for k, x in vars(v).items() if not isinstance(x, DataFrame)})}
    raise TypeError(f"{type(v).__name__} can't be saved")


def _back(v):
    if isinstance(v, list):
        return [_back(x) for x in v]
    if not isinstance(v, dict):
        return v
    if "@array" in v:
        return np.load(io.BytesIO(base64.b64decode(v["@array"])), allow_pickle=False)
    if "@dict" in v:
        return {_back(k): _back(x) for k, x in v["@dict"]}
    if "@tuple" in v:
        return tuple(_back(x) for x in v["@tuple"])
    module, _, name = v["@class"].partition(":")
    if not module.startswith("tessera."):
        raise ValueError("not a saved estimator")
    cls = getattr(importlib.import_module(module), name)
    out = cls.__new__(cls)
    out.__dict__.update(_back(v["state"]))
    return out


def save(spark: SparkSession, model, path: str) -> None:
    spark.createDataFrame([(VERSION, json.dumps(_plain(model)))], "version int, model string").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str):
    r = spark.read.parquet(path).first()
    if r["version"] != VERSION:
        raise ValueError(f"saved by version {r['version']}")
    return _back(json.loads(r["model"]))
