"""What every estimator is built on: passes over a feature table, and columns from fitted parameters.

A fit is a driver loop over passes. A pass sums a numpy function over all rows: on a table that is known to be small the
rows are read once and the function runs on the driver; otherwise it runs on the executors' Arrow batches, a partition
emits (position, value) rows, and Spark adds them up by position, so that what reaches the driver has the size of the
result and not of the data or of the number of partitions.
"""

from __future__ import annotations

import ctypes
import json
import os
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells (rows x columns) up to which a table is read to the driver once instead of being scanned in each pass.
LOCAL_CELLS = 1_000_000
#: Rows up to which methods that need all pairs of rows hold them on the driver; more meet in blocks on the executors.
PAIR_ROWS = 5_000
#: Fitted rows from which on scoring is dealt to all cores, however few files a table has.
SPREAD_ROWS = 1_000


class NotFittedError(RuntimeError):
    pass


def one_thread() -> None:
    """Holds this task's matrix products to one thread: tasks run beside each other, and OpenBLAS's threads would spin against theirs."""
    global _held
    if _held:
        return
    _held = True
    if not os.path.exists("/proc/self/maps"):
        return
    with open("/proc/self/maps") as f:
        loaded = {m.split(maxsplit=5)[5].strip() for m in f if "openblas" in m or "_multiarray_umath" in m}
    for path in loaded:
        lib = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(lib, name):
                getattr(lib, name)(1)
                break


_held = False


def col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def number(name: str) -> Column:
    """A column as a double whose missing values, null or NaN, are null."""
    return F.nanvl(col(name).cast("double"), F.lit(None).cast("double"))


def split_block(m: np.ndarray, p: int, q: int, single: bool, weighted: bool) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """The columns of a block: p features, q labels (one of them alone if ``single``), and weights."""
    y = m[:, p] if single else (m[:, p : p + q] if q else None)
    return m[:, :p], y, m[:, p + q] if weighted else np.ones(len(m))


class Data:
    """Features, and a label and a weight if given, of a table. Rows with a missing value are left out unless ``keep_missing``."""

    def __init__(self, df: DataFrame, features: Sequence[str], label: str | Sequence[str] | None = None, weight: str | None = None, keep_missing: bool = False, key: str | None = None):
        if not features:
            raise ValueError("no features")
        absent = [c for c in [*features, *([label] if isinstance(label, str) else label or []), *([weight] if weight else [])] if c not in df.columns]
        if absent:
            raise ValueError(f"no such columns: {absent}")
        self.features = list(features)
        self.labels = [label] if isinstance(label, str) else list(label or [])
        self.single = isinstance(label, str)
        self.weight = weight
        cols = [*self.features, *self.labels, *([weight] if weight else [])]
        self.width = len(cols)
        out = df.select(*(number(c).alias(f"x{i}") for i, c in enumerate(cols)), *([col(key).alias("key")] if key else []))
        self.keyed = key is not None
        self.table = out if keep_missing else out.dropna(subset=[f"x{i}" for i in range(self.width)])
        self._rows: np.ndarray | None = None
        self._n: int | None = None

    @property
    def n(self) -> int:
        if self._n is None:
            self._n = self.table.count()
            if not self._n:
                raise ValueError("no rows to fit on")
        return self._n

    @property
    def is_local(self) -> bool:
        return self.n * self.width <= LOCAL_CELLS

    def _read(self) -> np.ndarray:
        if self._rows is None:
            t = (self.table.orderBy("key") if self.keyed else self.table).toArrow()
            self._rows = np.stack([t[f"x{i}"].to_numpy() for i in range(self.width)], 1) if t.num_rows else np.zeros((0, self.width))
        return self._rows

    def split(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
        """X, y and weights of a block of rows."""
        return split_block(m, *self._layout)

    @property
    def _layout(self) -> tuple[int, int, bool, bool]:
        return len(self.features), len(self.labels), self.single, self.weight is not None

    def local(self, limit: int = PAIR_ROWS) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
        """All rows, for methods that need them together; raises if there are more than ``limit``."""
        if self.n > limit:
            raise ValueError(f"this method compares all pairs of rows and takes at most {limit}; the table has {self.n}. Fit it on a sample")
        return self.split(self._read())

    def sum(self, fn: Callable[[np.ndarray, np.ndarray | None, np.ndarray], np.ndarray | Sequence[np.ndarray]], how: str = "sum") -> list[np.ndarray]:
        """The sums (or the greatest, with how="max") over all rows of the arrays that ``fn(X, y, w)`` returns for a block of rows."""
        join = np.add if how == "sum" else np.maximum
        layout = self._layout  # what goes to the executors must not hold this table
        if self.is_local:
            got = fn(*split_block(self._read(), *layout))
            return [np.asarray(x, float) for x in (got if isinstance(got, (tuple, list)) else [got])]
        width = self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            one_thread()
            total: list[np.ndarray] | None = None
            for b in batches:
                m = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(width)], 1)
                got = fn(*split_block(m, *layout))
                got = [np.asarray(x, float) for x in (got if isinstance(got, (tuple, list)) else [got])]
                total = got if total is None else [join(s, x) for s, x in zip(total, got, strict=True)]
            if total is not None:
                flat = np.concatenate([x.ravel() for x in total])
                shape = json.dumps([list(x.shape) for x in total])
                at = np.arange(len(flat)) if how == "max" else np.union1d(np.flatnonzero(flat), [0] if len(flat) else [])  # zeros add nothing
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(flat[at]), pa.array([shape if i == 0 else None for i in range(len(at))], pa.string())], names=["pos", "v", "shape"])

        rows = self.table.mapInArrow(run, "pos long, v double, shape string").groupBy("pos").agg((F.sum if how == "sum" else F.max)("v").alias("v"), F.max("shape").alias("shape")).toArrow().sort_by("pos")
        shapes, out, at = json.loads(rows["shape"][0].as_py()), [], 0
        flat = np.zeros(sum(int(np.prod(s)) if s else 1 for s in shapes))
        flat[rows["pos"].to_numpy()] = rows["v"].to_numpy()
        for s in shapes:
            k = int(np.prod(s)) if s else 1
            out.append(flat[at : at + k].reshape(s))
            at += k
        return out

    def first(self, k: int, seed: int = 0) -> np.ndarray:
        """``k`` rows in a pseudo-random order that depends on their values, their places in the table and the seed: copies of a row are drawn as often as they are there."""
        h = F.xxhash64(F.lit(seed), *(F.col(f"x{i}") for i in range(self.width)), F.monotonically_increasing_id())
        t = self.table.withColumn("h#", h).orderBy("h#", *(F.col(f"x{i}") for i in range(self.width))).limit(k).toArrow()
        return np.stack([t[f"x{i}"].to_numpy() for i in range(self.width)], 1)

    def classes(self) -> np.ndarray:
        """Sorted label values, as whole numbers."""
        c = F.col(f"x{len(self.features)}").cast("int")
        return np.array(sorted(r[0] for r in self.table.select(c).distinct().collect()), int)

    def quantiles(self, qs: Sequence[float], of: Callable | None = None) -> np.ndarray:
        """Exact quantiles with linear interpolation: columns x qs, of the features or of the columns that ``of(X, y, w)`` gives."""
        at = np.asarray(qs, float) * (self.n - 1)
        low = np.floor(at).astype(np.int64)
        high = np.minimum(low + 1, self.n - 1)
        found = self.ranked(np.concatenate([low, high]), of)
        a, b = found[:, : len(low)], found[:, len(low) :]
        return np.where(a == b, a, a + (b - a) * (at - low))

    def ranked(self, ranks: Sequence[int], of: Callable | None = None) -> np.ndarray:
        """columns x ranks: the values at these places, from 0, of each column in order; exact at any size.

        A radix search: doubles map to whole numbers in the same order, and each pass counts the next digit of the values
        that begin like one of those searched for. So a pass brings back a row of counts for each rank, whatever the data.
        """
        ranks = np.asarray(ranks, np.int64)
        take = of or (lambda x, y, w: x)
        if self.is_local:
            return np.sort(take(*self.split(self._read())), axis=0)[ranks].T
        bits, done = 11, 0
        prefix, left = None, None
        while done < 64:
            step = min(bits, 64 - done)

            def fn(x, y, w, prefix=prefix, done=done, step=step):
                keys = sortable(take(x, y, w))
                p = keys.shape[1]
                digit = (keys >> np.uint64(64 - done - step) & np.uint64((1 << step) - 1)).astype(np.int64)
                if prefix is None:
                    return np.stack([np.bincount(digit[:, j], minlength=1 << step) for j in range(p)])[:, None]
                head = keys >> np.uint64(64 - done)
                out = np.zeros((p, prefix.shape[1], 1 << step))
                for j in range(p):
                    for k, want in enumerate(prefix[j]):
                        out[j, k] = np.bincount(digit[head[:, j] == want, j], minlength=1 << step)
                return out

            (counts,) = self.sum(fn)
            if prefix is None:
                counts = np.repeat(counts, len(ranks), axis=1)
                prefix, left = np.zeros((len(counts), len(ranks)), np.uint64), np.tile(ranks, (len(counts), 1))
            below = np.cumsum(counts, axis=2)
            digit = (below <= left[:, :, None]).sum(2)
            left = left - np.where(digit > 0, np.take_along_axis(below, np.maximum(digit - 1, 0)[:, :, None], 2)[:, :, 0], 0).astype(np.int64)
            prefix = prefix << np.uint64(step) | digit.astype(np.uint64)
            done += step
        return unsortable(prefix)


def sortable(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the doubles; both zeros are one."""
    u = np.ascontiguousarray(x + 0.0, np.float64).view(np.uint64)
    top = np.uint64(1 << 63)
    return np.where(u & top, ~u, u | top)


def unsortable(u: np.ndarray) -> np.ndarray:
    top = np.uint64(1 << 63)
    return np.where(u & top, u & ~top, ~u).astype(np.uint64).view(np.float64)


# -- moments ----------------------------------------------------------------------------------------------------------
def moments(data: Data) -> tuple[float, np.ndarray, np.ndarray]:
    """Weight, means and centred cross products of all columns (features, then labels), from sums about a pilot row."""
    pilot = data._read()[0] if data.is_local else np.array(list(data.table.first())[: data.width], float)
    p = len(data.features) + len(data.labels)
    pilot = pilot[:p]

    def fn(x, y, w):
        z = x if y is None else np.column_stack([x, y])
        z = z - pilot
        return w.sum(), w @ z, (z * w[:, None]).T @ z

    n, s, g = data.sum(fn)
    n = float(n)
    return n, pilot + s / n, g - np.outer(s, s) / n


def class_moments(data: Data, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each class its count, means, and centred cross products."""
    pilot = data._read()[0] if data.is_local else np.array(list(data.table.first())[: data.width], float)
    pilot, p = pilot[: len(data.features)], len(data.features)

    def fn(x, y, w):
        k = np.searchsorted(classes, y.astype(int))
        z = x - pilot
        c, s, g = np.zeros(len(classes)), np.zeros((len(classes), p)), np.zeros((len(classes), p, p))
        for i in range(len(classes)):
            at = k == i
            c[i], s[i], g[i] = w[at].sum(), w[at] @ z[at], (z[at] * w[at][:, None]).T @ z[at]
        return c, s, g

    c, s, g = data.sum(fn)
    return c, pilot + s / c[:, None], g - np.einsum("ki,kj->kij", s, s) / c[:, None, None]


# -- columns from parameters ------------------------------------------------------------------------------------------
def linear(features: Sequence[str], coef: Sequence[float], intercept: float = 0.0) -> Column:
    out = F.lit(float(intercept))
    for f, c in zip(features, coef, strict=True):
        out = out + number(f) * float(c)
    return out


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def argmax(scores: Sequence[Column], values: Sequence) -> Column:
    """The value of the greatest score, the first of equal ones."""
    best, at = scores[0], F.lit(values[0])
    for s, v in zip(scores[1:], values[1:], strict=True):
        at = F.when(s > best, F.lit(v)).otherwise(at)
        best = F.greatest(best, s)
    return at


def apply(df: DataFrame, features: Sequence[str], fn: Callable[[np.ndarray], dict[str, np.ndarray]], outputs: dict[str, str], met: int = 0) -> DataFrame:
    """``df`` with the columns that ``fn`` makes from blocks of feature rows; 2-d results are array columns.

    ``met`` is the number of fitted rows that each row meets.
    """
    n = len(df.columns)
    plain = df.toDF(*(f"c{i}" for i in range(n)))
    at = [df.columns.index(f) for f in features]
    plain = plain.select("*", *(F.coalesce(F.col(f"c{i}").cast("double"), F.lit(float("nan"))).alias(f"x{k}") for k, i in enumerate(at)))
    if met > SPREAD_ROWS:
        plain = plain.repartition(2 * df.sparkSession.sparkContext.defaultParallelism)
    schema = ", ".join([*(f"c{i} {plain.schema[i].dataType.simpleString()}" for i in range(n)), *(f"o{k} {t}" for k, t in enumerate(outputs.values()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        for b in batches:
            x = np.stack([b.column(n + k).to_numpy(zero_copy_only=False) for k in range(len(at))], 1)
            got = fn(x)
            cols = []
            for name, kind in outputs.items():
                v = got[name]
                if kind.startswith("array"):
                    v = np.asarray(v, float)
                    cols.append(pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, max(1, v.shape[1])), pa.int32()), pa.array(v.ravel())) if len(v) else pa.array([], pa.list_(pa.float64())))
                else:
                    cols.append(pa.array(v, {"double": pa.float64(), "int": pa.int32(), "long": pa.int64()}[kind]))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(n)), *cols], names=[*(f"c{i}" for i in range(n)), *(f"o{k}" for k in range(len(cols)))])

    keep = [c for c in df.columns if c not in outputs]
    out = plain.mapInArrow(run, schema).toDF(*[f"c{i}" for i in range(n)], *[f"o{k}" for k in range(len(outputs))])
    return out.select(*(F.col(f"c{df.columns.index(c)}").alias(c) for c in keep), *(F.col(f"o{k}").alias(c) for k, c in enumerate(outputs)))


# -- estimators -------------------------------------------------------------------------------------------------------
class Params:
    """Keyword parameters with defaults in ``DEFAULTS``; unknown names and wrong types raise."""

    DEFAULTS: dict = {}

    def __init__(self, **params):
        defaults: dict = {}
        for c in reversed(type(self).__mro__):
            defaults |= getattr(c, "DEFAULTS", {})
        self.params = dict(defaults)
        self.set_params(**params)

    def __getattr__(self, name):
        params = self.__dict__.get("params", {})
        if name in params:
            return params[name]
        if name.endswith("_") and not name.startswith("_"):
            raise NotFittedError(f"{type(self).__name__} isn't fitted")
        raise AttributeError(name)

    @property
    def is_fitted(self) -> bool:
        """Whether there are results, which end in an underscore."""
        return any(k.endswith("_") and not k.startswith("_") for k in self.__dict__)

    def predict_proba(self, df: DataFrame) -> DataFrame:
        """``df`` with ``probability``, an array in the order of ``classes_``."""
        out = self.predict(df)
        if "probability" not in out.columns:
            raise AttributeError(f"{type(self).__name__} has no probabilities")
        return out.drop(*({"prediction"} - set(df.columns)))

    def predict_log_proba(self, df: DataFrame) -> DataFrame:
        return self.predict_proba(df).withColumn("probability", F.transform("probability", F.log))

    def get_params(self) -> dict:
        return dict(self.params)

    def set_params(self, **params):
        for k, v in params.items():
            if k not in self.params:
                raise ValueError(f"{type(self).__name__} has no parameter {k}")
            self.params[k] = v
        return self

    def clone(self, **changes):
        return type(self)(**(self.params | changes))


class Estimator(Params):
    """``fit(df, features, label)`` returns the estimator itself, fitted; results end in an underscore."""

    features_: list[str]

    @property
    def is_fitted(self) -> bool:
        return "features_" in self.__dict__

    def fit(self, df: DataFrame, features: Sequence[str], label: str | None = None, **options):
        self._fit(Data(df, features, label, **options))
        self.features_ = list(features)
        return self

    def _fit(self, data: Data) -> None:
        raise NotImplementedError

    def _check(self, df: DataFrame) -> None:
        if not self.is_fitted:
            raise NotFittedError(f"{type(self).__name__} isn't fitted")
        absent = [f for f in self.features_ if f not in df.columns]
        if absent:
            raise ValueError(f"fitted features are absent: {absent}")


class Transformer(Estimator):
    """``transform`` replaces the features by, or adds, output columns."""

    def fit_transform(self, df: DataFrame, features: Sequence[str], label: str | None = None, **options) -> DataFrame:
        return self.fit(df, features, label, **options).transform(df)

    def transform(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def outputs(self) -> list[str]:
        """Names of the columns that ``transform`` leaves in place of the features."""
        return list(self.features_)


class Regressor(Estimator):
    """``predict`` adds the column ``prediction``."""

    def predict(self, df: DataFrame) -> DataFrame:
        self._check(df)
        return self._predict(df)

    def _predict(self, df: DataFrame) -> DataFrame:
        return apply(df, self.features_, lambda x, f=self.predict_rows: {"prediction": f(x)}, {"prediction": "double"}, len(self.__dict__.get("rows_", ())))

    def predict_rows(self, x: np.ndarray) -> np.ndarray:
        raise NotImplementedError


class Classifier(Estimator):
    """``predict`` adds ``prediction`` (int) and ``probability`` (array, in the order of ``classes_``)."""

    def fit(self, df: DataFrame, features: Sequence[str], label: str | None = None, **options):
        data = Data(df, features, label, **options)
        self.classes_ = data.classes()
        if len(self.classes_) < 2 and not getattr(self, "ONE_CLASS", False):
            raise ValueError("a classifier needs at least two classes")
        self._fit(data)
        self.features_ = list(features)
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        self._check(df)
        return self._predict(df)

    def _predict(self, df: DataFrame) -> DataFrame:
        classes, proba = self.classes_, self.proba_rows

        def fn(x):
            p = proba(x)
            return {"prediction": classes[p.argmax(1)] if len(p) else np.zeros(0, int), "probability": p}

        return apply(df, self.features_, fn, {"prediction": "int", "probability": "array<double>"}, len(self.__dict__.get("rows_", ())))

    def proba_rows(self, x: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def decision_function(self, df: DataFrame) -> DataFrame:
        """Adds ``decision``: the log odds of the second of two classes, or the greatest class's probability."""
        out = self.predict(df)
        p = F.col("probability")
        if len(self.classes_) == 2:
            q = F.least(F.greatest(p[1], F.lit(1e-15)), F.lit(1 - 1e-15))
            return out.withColumn("decision", F.log(q / (1 - q)))
        return out.withColumn("decision", F.array_max(p))


def codes(classes: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.searchsorted(classes, y.astype(int))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def expit(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))
