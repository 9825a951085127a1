"""Nearest neighbours.

Queries meet the reference rows block by block: blocks of reference rows are joined to each task of queries, a task keeps
the k best of each query, and the best of the blocks are merged by one grouped aggregate. So neither side has to fit
anywhere as a whole, and no row per pair leaves a task. Radius searches emit the pairs within the radius only.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.core import Classifier, Data, Estimator, Regressor, apply, col, number

#: Reference rows of a block.
BLOCK = 4096


#: Differences that are held at a time.
CELLS = 4_000_000


def distances(q: np.ndarray, r: np.ndarray, metric: str = "euclidean", p: float = 2) -> np.ndarray:
    """Of all rows of ``q`` and ``r``, from their differences: equal rows are at 0, whatever else is compared with them."""
    if metric not in ("euclidean", "manhattan", "minkowski"):
        raise ValueError(f"no metric {metric}")
    order = {"euclidean": 2, "manhattan": 1}.get(metric, p)
    out, step = np.empty((len(q), len(r))), max(1, CELLS // max(1, r.size))
    for i in range(0, len(q), step):
        d = q[i : i + step, None] - r[None]
        out[i : i + step] = np.sqrt((d * d).sum(2)) if order == 2 else np.abs(d).sum(2) if order == 1 else (np.abs(d) ** order).sum(2) ** (1 / order)
    return out


def near_pairs(q: np.ndarray, r: np.ndarray, metric: str, p: float, k: int | None, radius: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in q, place in r, distance) of the k nearest rows of ``r``, ties to the first, or of all within the radius.

    Euclidean distances come from inner products first, which are quick and have an error bound; those that may matter by
    it are computed from differences, so that the result is that of ``distances``.
    """
    if not len(q) or not len(r):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    if metric == "euclidean" or (metric == "minkowski" and p == 2):
        a, b = (q * q).sum(1)[:, None], (r * r).sum(1)[None]
        about = a + b - 2 * q @ r.T
        slack = 4 * np.finfo(float).eps * (q.shape[1] + 4) * (a + b)
        if k is not None:
            n = min(k, len(r)) - 1
            most = about + slack
            maybe = about - slack <= (most.min(1, keepdims=True) if n == 0 else np.partition(most, n, axis=1)[:, n : n + 1])
        else:
            maybe = about - slack <= radius * radius * (1 + 1e-9)
        rows, cols = np.nonzero(maybe)
        dist = np.empty(len(rows))
        step = max(1, CELLS // q.shape[1])
        for i in range(0, len(rows), step):
            d = q[rows[i : i + step]] - r[cols[i : i + step]]
            dist[i : i + step] = np.sqrt((d * d).sum(1))
    else:
        d = distances(q, r, metric, p)
        rows, cols = np.nonzero(np.ones(d.shape, bool))
        dist = d.ravel()
    if k is None:
        ok = dist <= radius
        return rows[ok], cols[ok], dist[ok]
    order = np.lexsort((cols, dist, rows))
    rows, cols, dist = rows[order], cols[order], dist[order]
    first = np.searchsorted(rows, np.arange(len(q)))
    ok = np.arange(len(rows)) - first[rows] < k
    return rows[ok], cols[ok], dist[ok]


def search(queries: DataFrame, query_key: str, reference: DataFrame, reference_key: str, features: Sequence[str], *, k: int | None = None, radius: float | None = None, metric: str = "euclidean", p: float = 2, value: str | None = None) -> DataFrame:
    """(qid, rid, dist[, value]): the k nearest, or all within the radius. Ties go to the smaller reference key."""
    dim = len(features)
    vector = lambda df, key, more: df.select(col(key).alias("id"), F.array(*(number(f) for f in features)).alias("v"), *more).filter(~F.exists("v", lambda x: x.isNull()))
    ref = vector(reference, reference_key, [number(value).alias("y")] if value else [F.lit(0.0).alias("y")])
    key_type = reference.schema[reference_key].dataType.simpleString()
    q_type = queries.schema[query_key].dataType.simpleString()
    n = reference.count()
    blocks = max(1, -(-n // BLOCK))
    packed = ref.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks))).groupBy("b").agg(F.array_sort(F.collect_list(F.struct("id", "v", "y"))).alias("rows"))
    # a stated query set against all rows, in blocks: every chunk of queries meets every block of reference rows
    asked = vector(queries, query_key, []).withColumn("c", F.spark_partition_id()).groupBy("c", F.pmod(F.xxhash64("id"), F.lit(max(1, queries.count() // 2048))).alias("c2")).agg(F.collect_list(F.struct("id", "v")).alias("asked"))
    meet = asked.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).join(packed, "b").select("asked", "rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a, r = batch.column(0)[i].values, batch.column(1)[i].values
                qv = a.field("v").flatten().to_numpy().reshape(-1, dim)
                rv = r.field("v").flatten().to_numpy().reshape(-1, dim)
                for at in range(0, len(qv), 256):
                    # rows are in the order of their keys, so ties go to the smaller key
                    rows, cols, dist = near_pairs(qv[at : at + 256], rv, metric, p, k, radius)
                    take = pa.array(cols, pa.int64())
                    yield pa.RecordBatch.from_arrays([a.field("id").take(pa.array(rows + at, pa.int64())), r.field("id").take(take), pa.array(dist), r.field("y").take(take)], names=["qid", "rid", "dist", "value"])

    pairs = meet.mapInArrow(run, f"qid {q_type}, rid {key_type}, dist double, value double")
    if k is not None:
        best = pairs.groupBy("qid").agg(F.slice(F.array_sort(F.collect_list(F.struct("dist", "rid", "value"))), 1, k).alias("near"))
        pairs = best.select("qid", F.explode("near").alias("n")).select("qid", "n.rid", "n.dist", "n.value")
    return pairs if value else pairs.drop("value")


class _Neighbours:
    DEFAULTS = {"n_neighbors": 5, "radius": 1.0, "weights": "uniform", "algorithm": "auto", "metric": "euclidean", "p": 2, "n_jobs": 1, "limit": 50_000}

    def _rows(self, data: Data) -> None:
        """Reference rows for scoring without a query key: of bounded number, sent to the executors once."""
        self.rows_, self.targets_, _ = data.local(self.limit)
        if isinstance(self, (KNeighborsClassifier, KNeighborsRegressor)) and self.n_neighbors > len(self.rows_):
            raise ValueError("n_neighbors is greater than the number of rows")

    def _near(self, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each row the places of its neighbours and their weights."""
        for at in range(0, len(x), 256):
            d = distances(x[at : at + 256], self.rows_, self.metric, self.p)
            for row in d:
                if self.BY_RADIUS:
                    j = np.flatnonzero(row <= self.radius)
                    j = j if len(j) else np.array([int(row.argmin())])
                else:
                    j = np.argsort(row, kind="stable")[: self.n_neighbors]
                if self.weights == "distance":
                    w = np.where(row[j] == 0, 1.0, 0.0) if (row[j] == 0).any() else 1 / row[j]
                else:
                    w = np.ones(len(j))
                yield j, w

    BY_RADIUS = False


class KNeighborsClassifier(_Neighbours, Classifier):
    """Votes of the k nearest; ties go to the smaller label."""

    def _fit(self, data):
        self._rows(data)

    def proba_rows(self, x):
        k = np.searchsorted(self.classes_, self.targets_.astype(int))
        out = np.zeros((len(x), len(self.classes_)))
        for i, (j, w) in enumerate(self._near(x)):
            np.add.at(out[i], k[j], w)
        return out / out.sum(1, keepdims=True)


class RadiusNeighborsClassifier(KNeighborsClassifier):
    """Votes of all rows within the radius, or of the nearest if there are none."""

    BY_RADIUS = True


class KNeighborsRegressor(_Neighbours, Regressor):
    def _fit(self, data):
        self._rows(data)

    def predict_rows(self, x):
        return np.array([np.average(self.targets_[j], weights=w) for j, w in self._near(x)])


class RadiusNeighborsRegressor(KNeighborsRegressor):
    BY_RADIUS = True


class NearestNeighbors(Estimator):
    """Searches of tables of any size; ``fit`` keeps the table and its key."""

    DEFAULTS = {"n_neighbors": 5, "radius": 1.0, "algorithm": "auto", "metric": "euclidean", "p": 2.0, "n_jobs": 1}

    def fit(self, df, features, label=None, key="id", **options):
        self.df_, self.key_, self.features_ = df, key, list(features)
        return self

    def kneighbors(self, queries: DataFrame, key: str, n_neighbors: int | None = None) -> DataFrame:
        self._check(queries)
        k = n_neighbors or self.n_neighbors
        if k > self.df_.count():
            raise ValueError("n_neighbors is greater than the number of rows")
        return search(queries, key, self.df_, self.key_, self.features_, k=k, metric=self.metric, p=self.p)

    def radius_neighbors(self, queries: DataFrame, key: str, radius: float | None = None) -> DataFrame:
        self._check(queries)
        return search(queries, key, self.df_, self.key_, self.features_, radius=self.radius if radius is None else radius, metric=self.metric, p=self.p)


class KNeighborsTransformer(NearestNeighbors):
    """The graph of the k nearest as (qid, rid, value) edges; pairs that aren't there are 0."""

    DEFAULTS = {"mode": "distance"}

    def transform(self, df: DataFrame, key: str) -> DataFrame:
        return self._edges(self.kneighbors(df, key))

    def _edges(self, pairs):
        if self.mode not in ("distance", "connectivity"):
            raise ValueError("mode must be distance or connectivity")
        return pairs.select("qid", "rid", (F.col("dist") if self.mode == "distance" else F.lit(1.0)).alias("value"))


class RadiusNeighborsTransformer(KNeighborsTransformer):
    def transform(self, df, key):
        return self._edges(self.radius_neighbors(df, key))


class NearestCentroid(Classifier):
    """The class of the nearest mean; probabilities in proportion to the inverse distance."""

    DEFAULTS = {"metric": "euclidean", "p": 2.0}

    def _fit(self, data):
        classes = self.classes_

        def fn(x, y, w):
            k = np.searchsorted(classes, y.astype(int))
            s = np.zeros((len(classes), x.shape[1]))
            np.add.at(s, k, x)
            return np.bincount(k, minlength=len(classes)), s

        n, s = data.sum(fn)
        self.centroids_ = s / n[:, None]

    def proba_rows(self, x):
        q = 1 / (distances(x, self.centroids_, self.metric, self.p) + 1e-12)
        return q / q.sum(1, keepdims=True)

    def decision_function(self, df):
        out = apply(df, self.features_, lambda x: {"decision": -distances(x, self.centroids_, self.metric, self.p).min(1)}, {"decision": "double"})
        return out
