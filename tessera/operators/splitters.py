"""Splitters: each gives (split, key, is_test) rows, or a fold column where the test sets don't overlap.

Rows have no order of their own, so every splitter takes a ``key`` with distinct values. Shuffles order rows by a hash of
seed and key. Positions in the key's order are counted in ranges: row numbers within a range plus the sizes of the ranges
before, so no task holds all rows.
"""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.core import Params, col


def positions(df: DataFrame, order: list[Column], name: str = "pos") -> DataFrame:
    """``df`` with each row's place (from 0) in the order, which must have no ties."""
    rows = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_c")).select(F.col("_part").alias("_p"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy("_part").orderBy(*order)
    out = rows.join(F.broadcast(sizes), F.col("_part") == F.col("_p"))
    return out.withColumn(name, F.row_number().over(own) - 1 + F.col("_before")).drop("_part", "_p", "_before")


def shuffled(seed: int, key: Column, *more: Column) -> list[Column]:
    return [F.xxhash64(F.lit(seed), *more, key), key]


class Splitter(Params):
    DEFAULTS: dict = {}

    def split(self, df: DataFrame, key: str, label: str | None = None, groups: str | None = None) -> DataFrame:
        """(split, key, is_test); rows of neither side are left out."""
        raise NotImplementedError

    def get_n_splits(self) -> int:
        return self.n_splits

    def pairs(self, df: DataFrame, key: str, label: str | None = None, groups: str | None = None) -> Iterator[tuple[DataFrame, DataFrame]]:
        """Train and test rows of each split."""
        rows = self.split(df, key, label, groups)
        ids = sorted(r[0] for r in rows.select("split").distinct().collect())
        for s in ids:
            one = rows.filter(F.col("split") == s).select(F.col("key").alias("_k"), "is_test")
            both = df.join(one, col(key) == F.col("_k")).drop("_k")
            yield both.filter("not is_test").drop("is_test"), both.filter("is_test").drop("is_test")


class FoldSplitter(Splitter):
    """A splitter whose test sets are the folds of one column."""

    def folds(self, df: DataFrame, key: str, label: str | None = None, groups: str | None = None) -> DataFrame:
        """``df`` with ``fold`` (int)."""
        raise NotImplementedError

    def split(self, df, key, label=None, groups=None):
        rows = self.folds(df, key, label, groups).select(col(key).alias("key"), "fold")
        n = df.sparkSession.range(self.get_n_splits()).select(F.col("id").cast("int").alias("split"))
        return rows.crossJoin(F.broadcast(n)).select("split", "key", (F.col("fold") == F.col("split")).alias("is_test"))  # n_splits rows


class KFold(FoldSplitter):
    """Folds of n // k rows in order; what remains is in the last."""

    DEFAULTS = {"n_splits": 5, "shuffle": False, "random_state": 0}

    def folds(self, df, key, label=None, groups=None):
        n = df.count()
        if self.n_splits < 1 or n < self.n_splits:
            raise ValueError("n_splits must be from 1 to the number of rows")
        order = shuffled(self.random_state, col(key)) if self.shuffle else [col(key)]
        return positions(df, order, "_pos").withColumn("fold", F.least(F.floor(F.col("_pos") / (n // self.n_splits)), F.lit(self.n_splits - 1)).cast("int")).drop("_pos")


class _Repeated(Splitter):
    DEFAULTS = {"n_splits": 5, "n_repeats": 10, "random_state": 0}
    INNER: type

    def get_n_splits(self):
        return self.n_splits * self.n_repeats

    def split(self, df, key, label=None, groups=None):
        out = None
        for r in range(self.n_repeats):
            one = self.INNER(n_splits=self.n_splits, shuffle=True, random_state=self.random_state + r).split(df, key, label, groups)
            one = one.withColumn("split", F.col("split") + r * self.n_splits)
            out = one if out is None else out.unionByName(one)
        return out


class RepeatedKFold(_Repeated):
    INNER = KFold


class StratifiedKFold(FoldSplitter):
    """In each class chunks in order; the first n_c mod k folds have one row more."""

    DEFAULTS = {"n_splits": 5, "shuffle": False, "random_state": 0}

    def folds(self, df, key, label=None, groups=None):
        order = shuffled(self.random_state, col(key)) if self.shuffle else [col(key)]
        # a row's place in its class is its place among all rows in (class, order) less the rows of the classes before
        counts = {r[0]: r[1] for r in df.groupBy(col(label)).count().collect()}
        at, m = 0, []
        for y in sorted(counts):
            m.append((y, at, counts[y]))
            at += counts[y]
        k = self.n_splits
        first = F.create_map(*itertools.chain.from_iterable((F.lit(y), F.lit(a)) for y, a, _ in m))
        size = F.create_map(*itertools.chain.from_iterable((F.lit(y), F.lit(c)) for y, _, c in m))
        rows = positions(df, [col(label), *order], "_pos").withColumns({"_r": F.col("_pos") - first[col(label)], "_n": size[col(label)]})
        big, small, extra = F.floor(F.col("_n") / k) + 1, F.floor(F.col("_n") / k), F.col("_n") % k
        fold = F.when(F.col("_r") < extra * big, F.floor(F.col("_r") / big)).otherwise(extra + F.floor((F.col("_r") - extra * big) / F.greatest(small, F.lit(1))))
        return rows.withColumn("fold", fold.cast("int")).drop("_pos", "_r", "_n")


class RepeatedStratifiedKFold(_Repeated):
    INNER = StratifiedKFold


class GroupKFold(FoldSplitter):
    """Groups in order, in chunks by their number; the first G mod k folds have one group more."""

    DEFAULTS = {"n_splits": 5}

    def folds(self, df, key, label=None, groups=None):
        g = df.select(col(groups).alias("_g")).distinct()
        n, k = g.count(), self.n_splits
        if n < k:
            raise ValueError("fewer groups than splits")
        big, small, extra = n // k + 1, n // k, n % k
        placed = positions(g, [F.col("_g")], "_pos")
        fold = F.when(F.col("_pos") < extra * big, F.floor(F.col("_pos") / big)).otherwise(extra + F.floor((F.col("_pos") - extra * big) / small))
        return df.join(placed.select("_g", fold.cast("int").alias("fold")), col(groups) == F.col("_g")).drop("_g")


class TimeSeriesSplit(Splitter):
    """Test windows one after another, each with the rows before it, less a gap, to train on."""

    DEFAULTS = {"n_splits": 5, "max_train_size": -1, "test_size": -1, "gap": 0}

    def split(self, df, key, label=None, groups=None):
        n, k = df.count(), self.n_splits
        size = self.test_size if self.test_size > 0 else n // (k + 1)
        spans = []
        for i in range(k):
            start = (i + 1) * n // (k + 1)
            end = start - self.gap
            spans.append((i, max(0, end - self.max_train_size) if self.max_train_size > 0 else 0, end, start, min(n, start + size)))
        table = df.sparkSession.createDataFrame(spans, "split int, a long, b long, c long, d long")
        pos = F.col("_pos")
        rows = positions(df.select(col(key).alias("key")), [F.col("key")], "_pos").crossJoin(F.broadcast(table))  # n_splits rows
        test, train = (pos >= F.col("c")) & (pos < F.col("d")), (pos >= F.col("a")) & (pos < F.col("b"))
        return rows.filter(test | train).select("split", "key", test.alias("is_test"))


def _sizes(n: int, test: float, train: float) -> int:
    k = n - round(n * train) if train > 0 else round(n * test)
    if not 0 < k < n:
        raise ValueError("both sides of a split need rows")
    return k


class ShuffleSplit(Splitter):
    DEFAULTS = {"n_splits": 10, "test_size": 0.1, "train_size": -1.0, "random_state": 0}

    def split(self, df, key, label=None, groups=None):
        n = df.count()
        k = _sizes(n, self.test_size, self.train_size)
        out = None
        for s in range(self.n_splits):
            one = positions(df.select(col(key).alias("key")), shuffled(self.random_state, F.col("key"), F.lit(s)), "_pos").select(F.lit(s).alias("split"), "key", (F.col("_pos") < k).alias("is_test"))
            out = one if out is None else out.unionByName(one)
        return out


class StratifiedShuffleSplit(Splitter):
    """Test rows of each class by largest remainders, at most all but one."""

    DEFAULTS = {"n_splits": 10, "test_size": 0.1, "train_size": -1.0, "random_state": 0}

    def split(self, df, key, label=None, groups=None):
        counts = {r[0]: r[1] for r in df.groupBy(col(label)).count().collect()}
        n = sum(counts.values())
        k = _sizes(n, self.test_size, self.train_size)
        share = {y: c * k / n for y, c in counts.items()}
        take = {y: min(int(s), counts[y] - 1) for y, s in share.items()}
        for y in sorted(counts, key=lambda y: (-(share[y] - int(share[y])), y)):
            if sum(take.values()) < k and take[y] < counts[y] - 1:
                take[y] += 1
        starts = dict(zip(sorted(counts), itertools.accumulate([0, *(counts[y] for y in sorted(counts))]), strict=False))
        limit = F.create_map(*itertools.chain.from_iterable((F.lit(y), F.lit(take[y] + starts[y])) for y in counts))
        out = None
        for s in range(self.n_splits):
            rows = positions(df.select(col(key).alias("key"), col(label).alias("_y")), [F.col("_y"), *shuffled(self.random_state, F.col("key"), F.lit(s))], "_pos")
            one = rows.select(F.lit(s).alias("split"), "key", (F.col("_pos") < limit[F.col("_y")]).alias("is_test"))
            out = one if out is None else out.unionByName(one)
        return out


class GroupShuffleSplit(Splitter):
    DEFAULTS = {"n_splits": 5, "test_size": 0.2, "train_size": -1.0, "random_state": 0}

    def split(self, df, key, label=None, groups=None):
        g = df.select(col(groups).alias("_g")).distinct()
        k = _sizes(g.count(), self.test_size, self.train_size)
        out = None
        for s in range(self.n_splits):
            placed = positions(g, shuffled(self.random_state, F.col("_g"), F.lit(s)), "_pos")
            one = df.join(placed, col(groups) == F.col("_g")).select(F.lit(s).alias("split"), col(key).alias("key"), (F.col("_pos") < k).alias("is_test"))
            out = one if out is None else out.unionByName(one)
        return out


class PredefinedSplit(Splitter):
    """The folds of a column; -1 is always trained on."""

    DEFAULTS = {"test_fold": "fold"}

    def split(self, df, key, label=None, groups=None):
        fold = col(self.test_fold).cast("int")
        ids = df.select(fold.alias("split")).filter("split >= 0").distinct()
        return df.select(col(key).alias("key"), fold.alias("_f")).crossJoin(F.broadcast(ids)).select("split", "key", (F.col("_f") == F.col("split")).alias("is_test"))  # a row a fold


class LeaveOneOut(FoldSplitter):
    """Each row is a fold."""

    def folds(self, df, key, label=None, groups=None):
        return positions(df, [col(key)], "fold").withColumn("fold", F.col("fold").cast("int"))

    def split(self, df, key, label=None, groups=None, limit: int = 5000):
        n = df.count()
        if n > limit:
            raise ValueError(f"leave one out makes n x n rows; at most {limit} rows, use folds() beyond")
        self._n = n
        return super().split(df, key, label, groups)

    def get_n_splits(self):
        return self._n


class LeavePOut(Splitter):
    """All sets of p rows, in order."""

    DEFAULTS = {"p": 2}

    def split(self, df, key, label=None, groups=None, limit: int = 200_000):
        n = df.count()
        if math.comb(n, self.p) * n > limit * 100:
            raise ValueError("too many sets of rows")
        sets = [(i, list(c)) for i, c in enumerate(itertools.combinations(range(n), self.p))]
        table = df.sparkSession.createDataFrame(sets, "split int, test array<long>")
        rows = positions(df.select(col(key).alias("key")), [F.col("key")], "_pos").crossJoin(F.broadcast(table))  # the sets, of checked number
        return rows.select("split", "key", F.array_contains("test", F.col("_pos").cast("long")).alias("is_test"))


def train_test_split(df: DataFrame, key: str, test_size: float = 0.25, shuffle: bool = True, random_state: int = 0, stratify: str | None = None) -> tuple[DataFrame, DataFrame]:
    """floor(n * test_size) rows are the test; the first others are trained on. Stratified: per class the first n_c - floor(n_c * t) train."""
    if stratify is not None:
        counts = {r[0]: r[1] for r in df.groupBy(col(stratify)).count().collect()}
        starts = dict(zip(sorted(counts), itertools.accumulate([0, *(counts[y] for y in sorted(counts))]), strict=False))
        limit = F.create_map(*itertools.chain.from_iterable((F.lit(y), F.lit(starts[y] + c - int(c * test_size))) for y, c in counts.items()))[col(stratify)]
        order = [col(stratify), *(shuffled(random_state, col(key)) if shuffle else [col(key)])]
    else:
        n = df.count()
        limit = F.lit(n - int(n * test_size))
        order = shuffled(random_state, col(key)) if shuffle else [col(key)]
    rows = positions(df, order, "_pos").withColumn("_train", F.col("_pos") < limit).drop("_pos")
    return rows.filter("_train").drop("_train"), rows.filter("not _train").drop("_train")


class ParameterGrid:
    """All combinations, keys in order."""

    def __init__(self, grid: dict[str, list]):
        self.grid = grid

    def __iter__(self):
        names = sorted(self.grid)
        for values in itertools.product(*(self.grid[n] for n in names)):
            yield dict(zip(names, values, strict=True))

    def __len__(self):
        return math.prod(len(v) for v in self.grid.values())


class ParameterSampler:
    """Uniform choices, seeded."""

    def __init__(self, distributions: dict[str, list], n_iter: int = 10, random_state: int = 0):
        self.distributions, self.n_iter, self.random_state = distributions, n_iter, random_state

    def __iter__(self):
        rng = random.Random(self.random_state)
        for _ in range(self.n_iter):
            yield {n: rng.choice(self.distributions[n]) for n in sorted(self.distributions)}

    def __len__(self):
        return self.n_iter
