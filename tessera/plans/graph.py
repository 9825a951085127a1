"""Connected components for clusterings over tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SET_HERE: dict[str, str] = {}


#: Edges (8 MB) up to which the driver takes them: a round of stars is some ten shuffles, whatever the number of edges.
LOCAL_EDGES = 500_000


def smallest_of(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of the edges (u, v), and the smallest one of each one's component."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        open_ = low < high
        a, b, low, high = a[open_], b[open_], low[open_], high[open_]
        np.minimum.at(root, high, low)
        while (jump := root[root]).tobytes() != root.tobytes():
            root = jump
    return nodes, nodes[root]


def smallest_reachable(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, root) for edges (a, b) given both ways and with loops: each node takes the least root of its neighbours.

    Up to ``LOCAL_EDGES`` edges are joined on the driver. Else rounds also jump to the root's root, so they follow the logarithm of the diameter; each is a reliable checkpoint.
    """
    spark = edges.sparkSession
    edges = edges.persist()
    if edges.count() <= LOCAL_EDGES:
        found = edges.toArrow().combine_chunks()
        node, root = smallest_of(found["a"].to_numpy(), found["b"].to_numpy())
        kind = found["a"].type
        return spark.createDataFrame(pa.table({"node": pa.array(node, kind), "root": pa.array(root, kind)}))
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(spark))
    labels = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).checkpoint()
    before = None
    for _ in range(max_rounds):
        near = edges.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("root"))
        jump = labels.select(F.col("node").alias("n2"), F.col("root").alias("r2"))
        labels = near.join(jump, F.col("root") == F.col("n2")).select(F.col("a").alias("node"), F.least("root", "r2").alias("root")).checkpoint()
        now = tuple(labels.agg(F.count("*"), F.sum(F.xxhash64("node", "root").cast("decimal(20,0)"))).first())
        if now == before:
            return labels
        before = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def shared_folder(spark) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only where that is unset on one machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", "") or ""
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    import tempfile

    if "dir" not in _SET_HERE:
        _SET_HERE["dir"] = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return _SET_HERE["dir"]
