"""Scalers, encoders, discretisers and imputers.

A fit is one or two aggregates; a transform is a projection of column expressions, so chained transformers fuse into one.
Outputs replace the features unless they have other names. Missing values (null or NaN) don't enter statistics and stay
missing, but for the imputers.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.core import Data, NotFittedError, Transformer, apply, col, number


def replace(df: DataFrame, new: dict[str, Column], drop: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``new`` columns, in place where they exist, and without ``drop``."""
    keep = [new[c].alias(c) if c in new else col(c) for c in df.columns if c not in drop or c in new]
    return df.select(*keep, *(v.alias(k) for k, v in new.items() if k not in df.columns))


class _Columns(Transformer):
    """A transformer whose outputs are one expression a feature."""

    def fit(self, df: DataFrame, features: Sequence[str], label: str | None = None, **options):
        data = Data(df, features, keep_missing=True)
        if not data.n:
            raise ValueError("no rows to fit on")
        self._stats(df, list(features))
        self.features_ = list(features)
        return self

    def _stats(self, df: DataFrame, features: list[str]) -> None:
        pass

    def _expr(self, f: str, x: Column) -> Column:
        raise NotImplementedError

    def _inverse(self, f: str, x: Column) -> Column:
        raise NotImplementedError(f"{type(self).__name__} has no inverse")

    def transform(self, df: DataFrame) -> DataFrame:
        self._check(df)
        return replace(df, {f: self._expr(f, number(f)) for f in self.features_})

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        self._check(df)
        return replace(df, {f: self._inverse(f, number(f)) for f in self.features_})


class StandardScaler(_Columns):
    """(x - mean) / population deviation; deviation 0 counts as 1."""

    DEFAULTS = {"with_mean": True, "with_std": True}

    def _stats(self, df, features):
        a = aggregate(df, {**{("m", f): F.avg(number(f)) for f in features}, **{("s", f): F.stddev_pop(number(f)) for f in features}, **{("q", f): F.avg(number(f) * number(f)) for f in features}})
        self.mean_ = {f: a["m", f] if self.with_mean else 0.0 for f in features}
        spread = {f: a["s", f] if self.with_mean else math.sqrt(a["q", f]) for f in features}
        self.scale_ = {f: (spread[f] or 1.0) if self.with_std else 1.0 for f in features}

    def _expr(self, f, x):
        return (x - self.mean_[f]) / self.scale_[f]

    def _inverse(self, f, x):
        return x * self.scale_[f] + self.mean_[f]


def aggregate(df: DataFrame, wanted: dict) -> dict:
    """Values of aggregates under their keys, from one pass."""
    r = df.agg(*(v.alias(f"a{i}") for i, v in enumerate(wanted.values()))).first()
    return dict(zip(wanted, r, strict=True))


class MinMaxScaler(_Columns):
    """To the range; a constant feature moves by its low end."""

    DEFAULTS = {"feature_range_min": 0.0, "feature_range_max": 1.0}

    def _stats(self, df, features):
        a = aggregate(df, {(k, f): g(number(f)) for k, g in (("lo", F.min), ("hi", F.max)) for f in features})
        width = self.feature_range_max - self.feature_range_min
        self.min_ = {f: a["lo", f] for f in features}
        self.constant_ = {f: a["hi", f] == a["lo", f] for f in features}
        self.scale_ = {f: 1.0 if self.constant_[f] else width / (a["hi", f] - a["lo", f]) for f in features}

    def _expr(self, f, x):
        return x + self.feature_range_min if self.constant_[f] else (x - self.min_[f]) * self.scale_[f] + self.feature_range_min

    def _inverse(self, f, x):
        return x - self.feature_range_min if self.constant_[f] else (x - self.feature_range_min) / self.scale_[f] + self.min_[f]


class MaxAbsScaler(_Columns):
    def _stats(self, df, features):
        a = aggregate(df, {f: F.max(F.abs(number(f))) for f in features})
        self.scale_ = {f: a[f] or 1.0 for f in features}

    def _expr(self, f, x):
        return x / self.scale_[f]

    def _inverse(self, f, x):
        return x * self.scale_[f]


class RobustScaler(_Columns):
    """(x - median) / interquartile range; a range under 1e-12 counts as 1."""

    DEFAULTS = {"with_centering": True, "with_scaling": True}

    def _stats(self, df, features):
        q = Data(df, features).quantiles([0.25, 0.5, 0.75])
        self.center_ = {f: float(q[i, 1]) if self.with_centering else 0.0 for i, f in enumerate(features)}
        self.scale_ = {f: float(q[i, 2] - q[i, 0]) if self.with_scaling and q[i, 2] - q[i, 0] >= 1e-12 else 1.0 for i, f in enumerate(features)}

    def _expr(self, f, x):
        return (x - self.center_[f]) / self.scale_[f]

    def _inverse(self, f, x):
        return x * self.scale_[f] + self.center_[f]


class Normalizer(_Columns):
    """Rows to length 1 in the l1, l2 or max norm; shorter ones than 1e-8 stay."""

    DEFAULTS = {"norm": "l2"}

    def transform(self, df):
        self._check(df)
        xs = [number(f) for f in self.features_]
        if self.norm == "l2":
            n = F.sqrt(sum((x * x for x in xs), F.lit(0.0)))
        elif self.norm == "l1":
            n = sum((F.abs(x) for x in xs), F.lit(0.0))
        elif self.norm == "max":
            n = F.greatest(*(F.abs(x) for x in xs), F.lit(0.0))
        else:
            raise ValueError("norm must be l1, l2 or max")
        return replace(df, {f: F.when(n > 1e-8, number(f) / n).otherwise(number(f)) for f in self.features_})


class Binarizer(_Columns):
    DEFAULTS = {"threshold": 0.0}

    def _expr(self, f, x):
        return (x > self.threshold).cast("double")


class PolynomialFeatures(_Columns):
    """Monomials up to a degree, by degree and then in order; named by their factors."""

    DEFAULTS = {"degree": 2, "interaction_only": False, "include_bias": True}

    def monomials(self) -> list[tuple[str, ...]]:
        pick = itertools.combinations if self.interaction_only else itertools.combinations_with_replacement
        return [m for d in range(0 if self.include_bias else 1, self.degree + 1) for m in pick(self.features_, d)]

    def outputs(self):
        return ["*".join(m) or "1" for m in self.monomials()]

    def transform(self, df):
        self._check(df)
        new = {}
        for m in self.monomials():
            x = F.lit(1.0)
            for f in m:
                x = x * number(f)
            new["*".join(m) or "1"] = x
        return replace(df, new, self.features_)


def distinct(df: DataFrame, features: Sequence[str], limit: int = 100_000) -> dict[str, list]:
    """Sorted values of each feature; raises beyond ``limit``, since they become columns or a map."""
    out = {}
    for f in features:
        got = df.select(col(f).alias("v")).dropna().distinct().limit(limit + 1).collect()
        if len(got) > limit:
            raise ValueError(f"{f} has over {limit} values")
        out[f] = sorted(r[0] for r in got)
    return out


class OneHotEncoder(_Columns):
    """A column for each value, ``feature=value``; a value that wasn't seen gives zeros."""

    def _stats(self, df, features):
        self.categories_ = distinct(df, features, 10_000)

    def outputs(self):
        return [f"{f}={v}" for f in self.features_ for v in self.categories_[f]]

    def transform(self, df):
        self._check(df)
        new = {f"{f}={v}": F.coalesce((col(f) == F.lit(v)).cast("double"), F.lit(0.0)) for f in self.features_ for v in self.categories_[f]}
        return replace(df, new, self.features_)

    def inverse_transform(self, df):
        new = {f: F.coalesce(*(F.when(col(f"{f}={v}") == 1, F.lit(v)) for v in self.categories_[f])) for f in self.features_}
        return replace(df, new, self.outputs())


def lookup(values: Sequence, x: Column, default) -> Column:
    """The place of x in ``values``."""
    if not values:
        return F.lit(default)
    m = F.create_map(*itertools.chain.from_iterable((F.lit(v), F.lit(float(i))) for i, v in enumerate(values)))
    return F.coalesce(F.try_element_at(m, x), F.lit(default))


class OrdinalEncoder(_Columns):
    """Places among the sorted values; -1 for others."""

    def _stats(self, df, features):
        self.categories_ = distinct(df, features)

    def transform(self, df):
        self._check(df)
        return replace(df, {f: lookup(self.categories_[f], col(f), -1.0) for f in self.features_})

    def inverse_transform(self, df):
        self._check(df)
        return replace(df, {f: F.get(F.array(*(F.lit(v) for v in self.categories_[f])), col(f).cast("int")) for f in self.features_})


class LabelEncoder(OrdinalEncoder):
    """One column's places among its sorted values; other values raise."""

    def transform(self, df):
        self._check(df)
        (f,) = self.features_
        known = lookup(self.categories_[f], col(f), -1.0)
        return replace(df, {f: F.when(known < 0, F.raise_error(F.lit("a label that wasn't seen in fit")).cast("int")).otherwise(known.cast("int"))})

    @property
    def classes_(self):
        if not self.is_fitted:
            raise NotFittedError("LabelEncoder isn't fitted")
        return self.categories_[self.features_[0]]


class LabelBinarizer(_Columns):
    """Two values: one column for the second. More: a column each."""

    DEFAULTS = {"neg_label": 0, "pos_label": 1}

    def _stats(self, df, features):
        self.categories_ = distinct(df, features, 10_000)

    def outputs(self):
        (f,) = self.features_
        v = self.categories_[f]
        return [f"{f}={x}" for x in (v[1:] if len(v) == 2 else v)]

    def transform(self, df):
        self._check(df)
        (f,) = self.features_
        v = self.categories_[f]
        return replace(df, {f"{f}={x}": F.when(col(f) == F.lit(x), F.lit(self.pos_label)).otherwise(F.lit(self.neg_label)) for x in (v[1:] if len(v) == 2 else v)}, [f])

    def inverse_transform(self, df):
        (f,) = self.features_
        v = self.categories_[f]
        if len(v) == 2:
            x = F.when(col(f"{f}={v[1]}") == self.pos_label, F.lit(v[1])).otherwise(F.lit(v[0]))
        else:
            x = F.coalesce(*(F.when(col(f"{f}={y}") == self.pos_label, F.lit(y)) for y in v))
        return replace(df, {f: x}, self.outputs())


class MultiLabelBinarizer(_Columns):
    """An array column becomes a 0/1 column for each of its values; a value that wasn't seen raises, and so do more than ``max_values`` of them."""

    DEFAULTS = {"max_values": 10_000}

    def fit(self, df, features, label=None, **options):
        (f,) = features
        found = sorted(r[0] for r in df.select(F.explode(col(f)).alias("v")).dropna().distinct().limit(self.max_values + 1).collect())
        if len(found) > self.max_values:
            raise ValueError(f"{f} holds more than {self.max_values} values, each of which would be a column")
        self.values_ = found
        self.features_ = [f]
        return self

    def outputs(self):
        return [f"{self.features_[0]}={v}" for v in self.values_]

    def transform(self, df):
        self._check(df)
        (f,) = self.features_
        known = F.array(*(F.lit(v) for v in self.values_))
        bad = F.exists(col(f), lambda x: x.isNotNull() & ~F.array_contains(known, x))
        return replace(df, {f"{f}={v}": F.when(bad, F.raise_error(F.lit("a label that wasn't seen in fit")).cast("int")).otherwise(F.coalesce(F.array_contains(col(f), F.lit(v)).cast("int"), F.lit(0))) for v in self.values_}, [f])

    def inverse_transform(self, df):
        (f,) = self.features_
        parts = F.array(*(F.when(col(f"{f}={v}") == 1, F.lit(v)) for v in self.values_))
        return replace(df, {f: F.filter(parts, lambda x: x.isNotNull())}, self.outputs())


def _nested(edges: Sequence[float], x: Column) -> Column:
    """The number of inner edges at or below x."""
    return sum(((x >= float(e)).cast("int") for e in edges), F.lit(0))


class KBinsDiscretizer(_Columns):
    """Bins of equal width or equal count; places (ordinal) or a 0/1 column for each bin (onehot)."""

    DEFAULTS = {"n_bins": 5, "encode": "onehot", "strategy": "uniform"}

    def _stats(self, df, features):
        k = self.n_bins
        if self.strategy == "uniform":
            a = aggregate(df, {(n, f): g(number(f)) for n, g in (("lo", F.min), ("hi", F.max)) for f in features})
            self.edges_ = {f: [a["lo", f] + (a["hi", f] - a["lo", f]) * i / k for i in range(k + 1)] for f in features}
        elif self.strategy == "quantile":
            q = Data(df, features).quantiles([i / k for i in range(k + 1)])
            self.edges_ = {f: q[i].tolist() for i, f in enumerate(features)}
        else:
            raise ValueError("strategy must be uniform or quantile")

    def _bin(self, f: str) -> Column:
        x = number(f)
        return F.when(x.isNotNull(), F.least(_nested(self.edges_[f][1:-1], x), F.lit(self.n_bins - 1)).cast("double"))

    def outputs(self):
        return list(self.features_) if self.encode == "ordinal" else [f"{f}:{b}" for f in self.features_ for b in range(self.n_bins)]

    def transform(self, df):
        self._check(df)
        if self.encode == "ordinal":
            return replace(df, {f: self._bin(f) for f in self.features_})
        return replace(df, {f"{f}:{b}": (self._bin(f) == b).cast("double") for f in self.features_ for b in range(self.n_bins)}, self.features_)

    def inverse_transform(self, df):
        mids = {f: [(a + b) / 2 for a, b in itertools.pairwise(self.edges_[f])] for f in self.features_}
        if self.encode == "ordinal":
            return replace(df, {f: F.get(F.array(*map(F.lit, mids[f])), col(f).cast("int")) for f in self.features_})
        return replace(df, {f: F.coalesce(*(F.when(col(f"{f}:{b}") == 1, F.lit(m)) for b, m in enumerate(mids[f]))) for f in self.features_}, self.outputs())


def normal_quantile(p: np.ndarray) -> np.ndarray:
    """The inverse of the normal distribution by bisection on erf, to double precision."""
    lo, hi = np.full(p.shape, -9.0), np.full(p.shape, 9.0)
    cdf = np.vectorize(lambda z: 0.5 * math.erfc(-z / math.sqrt(2)))
    for _ in range(60):
        mid = (lo + hi) / 2
        up = cdf(mid) < p
        lo, hi = np.where(up, mid, lo), np.where(up, hi, mid)
    return (lo + hi) / 2


class QuantileTransformer(_Columns):
    """Interpolated ranks among at most ``n_quantiles`` quantiles, uniform or normal (clipped at 1e-6)."""

    DEFAULTS = {"n_quantiles": 1000, "output_distribution": "uniform"}

    def _stats(self, df, features):
        data = Data(df, features)
        k = max(2, min(self.n_quantiles, data.n))
        self.levels_ = np.linspace(0, 1, k)
        self.quantiles_ = data.quantiles(self.levels_.tolist())

    def transform(self, df):
        self._check(df)
        levels, quantiles, normal = self.levels_, self.quantiles_, self.output_distribution == "normal"
        grid = np.linspace(-5, 5, 20001)
        cdf = np.array([0.5 * math.erfc(-z / math.sqrt(2)) for z in grid])

        def fn(x):
            out = {}
            for i, f in enumerate(names):
                # the middle of the ranks that equal quantiles have
                u = (np.interp(x[:, i], quantiles[i], levels) - np.interp(-x[:, i], -quantiles[i][::-1], -levels[::-1])) / 2
                out[f] = np.interp(np.clip(u, 1e-6, 1 - 1e-6), cdf, grid) if normal else u
            return out

        names = self.features_
        return apply(df, names, fn, dict.fromkeys(names, "double")).select(*df.columns)

    def inverse_transform(self, df):
        levels, quantiles, normal, names = self.levels_, self.quantiles_, self.output_distribution == "normal", self.features_
        grid = np.linspace(-5, 5, 20001)
        cdf = np.array([0.5 * math.erfc(-z / math.sqrt(2)) for z in grid])

        def fn(x):
            return {f: np.interp(np.interp(x[:, i], grid, cdf) if normal else x[:, i], levels, quantiles[i]) for i, f in enumerate(names)}

        return apply(df, names, fn, dict.fromkeys(names, "double")).select(*df.columns)


class PowerTransformer(_Columns):
    """Yeo-Johnson or Box-Cox with the exponent of greatest likelihood on a grid, all exponents from one pass; then standardised."""

    DEFAULTS = {"method": "yeo-johnson", "standardize": True}

    def _power(self, x: Column, lam: float) -> Column:
        if self.method == "box-cox":
            y = F.when(x > 0, x).when(x.isNotNull(), F.raise_error(F.lit("box-cox needs positive values")).cast("double"))
            return F.log(y) if abs(lam) < 1e-9 else (F.pow(y, F.lit(lam)) - 1) / lam
        up = F.log1p(x) if abs(lam) < 1e-9 else (F.pow(x + 1, F.lit(lam)) - 1) / lam
        down = -F.log1p(-x) if abs(lam - 2) < 1e-9 else -(F.pow(1 - x, F.lit(2 - lam)) - 1) / (2 - lam)
        return F.when(x >= 0, up).otherwise(down)

    def _stats(self, df, features):
        if self.method not in ("yeo-johnson", "box-cox"):
            raise ValueError("method must be yeo-johnson or box-cox")
        grid = [round(-2 + 0.1 * i, 1) for i in range(41)]
        logs = {f: F.sum(F.log(number(f)) if self.method == "box-cox" else F.signum(number(f)) * F.log1p(F.abs(number(f)))) for f in features}
        self.lambdas_, self.mean_, self.scale_ = {}, {}, {}
        for f in features:
            a = aggregate(df, {"n": F.count(number(f)), "log": logs[f], **{("m", x): F.avg(self._power(number(f), x)) for x in grid}, **{("v", x): F.var_pop(self._power(number(f), x)) for x in grid}})
            like = {x: -a["n"] / 2 * math.log(max(a["v", x], 1e-300)) + (x - 1) * a["log"] for x in grid}
            best = max(grid, key=lambda x: like[x])
            self.lambdas_[f], self.mean_[f], self.scale_[f] = best, a["m", best], math.sqrt(a["v", best]) or 1.0

    def _expr(self, f, x):
        y = self._power(x, self.lambdas_[f])
        return (y - self.mean_[f]) / self.scale_[f] if self.standardize else y

    def _inverse(self, f, x):
        y, lam = (x * self.scale_[f] + self.mean_[f] if self.standardize else x), self.lambdas_[f]
        if self.method == "box-cox":
            return F.exp(y) if abs(lam) < 1e-9 else F.pow(y * lam + 1, F.lit(1 / lam))
        up = F.expm1(y) if abs(lam) < 1e-9 else F.pow(y * lam + 1, F.lit(1 / lam)) - 1
        down = -F.expm1(-y) if abs(lam - 2) < 1e-9 else 1 - F.pow(1 - y * (2 - lam), F.lit(1 / (2 - lam)))
        return F.when(y >= 0, up).otherwise(down)


class FunctionTransformer(_Columns):
    """A named function of each feature; values outside its domain raise."""

    DEFAULTS = {"func": "identity", "inverse_func": "identity", "validate": True}
    FUNCTIONS = {"identity": (lambda x: x, None), "log1p": (F.log1p, lambda x: x > -1), "expm1": (F.expm1, None), "log": (F.log, lambda x: x > 0), "exp": (F.exp, None), "sqrt": (F.sqrt, lambda x: x >= 0), "square": (lambda x: x * x, None), "abs": (F.abs, None), "negative": (lambda x: -x, None)}

    def _named(self, name: str, x: Column) -> Column:
        if name not in self.FUNCTIONS:
            raise ValueError(f"no function {name}")
        fn, domain = self.FUNCTIONS[name]
        if domain is None or not self.validate:
            return fn(x)
        return F.when(domain(x) | x.isNull(), fn(x)).otherwise(F.raise_error(F.lit(f"a value outside the domain of {name}")).cast("double"))

    def _expr(self, f, x):
        return self._named(self.func, x)

    def _inverse(self, f, x):
        return self._named(self.inverse_func, x)


class SplineTransformer(_Columns):
    """B-spline bases on uniform knots from the least to the greatest value, as expressions."""

    DEFAULTS = {"n_knots": 5, "degree": 3, "include_bias": True}

    def _stats(self, df, features):
        a = aggregate(df, {(n, f): g(number(f)) for n, g in (("lo", F.min), ("hi", F.max)) for f in features})
        d = self.degree
        self.knots_ = {f: [a["lo", f]] * d + np.linspace(a["lo", f], a["hi", f], self.n_knots).tolist() + [a["hi", f]] * d for f in features}

    def n_bases(self) -> int:
        return self.n_knots + self.degree - 1

    def outputs(self):
        return [f"{f}:{i}" for f in self.features_ for i in range(0 if self.include_bias else 1, self.n_bases())]

    def transform(self, df):
        self._check(df)
        names, knots, d, first = self.features_, self.knots_, self.degree, 0 if self.include_bias else 1

        def fn(x):
            out = {}
            for i, f in enumerate(names):
                t = np.array(knots[f])
                v = np.clip(x[:, i], t[0], t[-1])
                # the piece that holds the greatest value is closed
                k = np.clip(np.searchsorted(t, v, "right") - 1, d, len(t) - d - 2)
                b = np.zeros((len(v), len(t) - 1))
                b[np.arange(len(v)), k] = 1
                for p in range(1, d + 1):
                    nxt = np.zeros((len(v), len(t) - 1 - p))
                    for j in range(nxt.shape[1]):
                        lo, hi = t[j + p] - t[j], t[j + p + 1] - t[j + 1]
                        nxt[:, j] = ((v - t[j]) / lo * b[:, j] if lo else 0) + ((t[j + p + 1] - v) / hi * b[:, j + 1] if hi else 0)
                    b = nxt
                out |= {f"{f}:{j}": b[:, j] for j in range(first, b.shape[1])}
            return out

        out = apply(df, names, fn, dict.fromkeys(self.outputs(), "double"))
        return out.drop(*names)

    def inverse_transform(self, df):
        """The mean of the knots under each basis, weighted by the bases."""
        new = {}
        for f in self.features_:
            t = self.knots_[f]
            sites = [sum(t[j + 1 : j + 1 + self.degree]) / self.degree for j in range(self.n_bases())]
            new[f] = sum((col(f"{f}:{j}") * float(s) for j, s in enumerate(sites)), F.lit(0.0))
        return replace(df, new, self.outputs())


class SimpleImputer(_Columns):
    """Missing and infinite values become the mean or median of the others, or a constant."""

    DEFAULTS = {"strategy": "mean", "fill_value": 0.0}

    @staticmethod
    def _finite(x: Column) -> Column:
        return F.when(F.abs(x) != float("inf"), x)

    def _stats(self, df, features):
        pick = {"mean": F.avg, "median": lambda x: F.percentile(x, F.lit(0.5)), "constant": lambda x: F.lit(float(self.fill_value))}
        if self.strategy not in pick:
            raise ValueError("strategy must be mean, median or constant")
        a = aggregate(df, {f: pick[self.strategy](self._finite(number(f))) for f in features})
        self.statistics_ = {f: self.fill_value if a[f] is None else a[f] for f in features}

    def _expr(self, f, x):
        return F.coalesce(self._finite(x), F.lit(float(self.statistics_[f])))


class MissingIndicator(_Columns):
    """``missing:feature`` is 1 where it is missing, for the features with any (or all)."""

    DEFAULTS = {"features": "missing-only"}

    def _stats(self, df, features):
        a = aggregate(df, {f: F.max(number(f).isNull().cast("int")) for f in features})
        self.with_missing_ = [f for f in features if self.params["features"] == "all" or a[f]]

    def outputs(self):
        return [f"missing:{f}" for f in self.with_missing_]

    def transform(self, df):
        self._check(df)
        return replace(df, {f"missing:{f}": number(f).isNull().cast("double") for f in self.with_missing_})


class KNNImputer(Transformer):
    """A missing value is the mean of the nearest rows that have it, by distances over the dimensions both rows have."""

    DEFAULTS = {"n_neighbors": 5, "metric": "euclidean"}

    def _fit(self, data):
        raise NotImplementedError

    def fit(self, df, features, label=None, **options):
        data = Data(df, features, keep_missing=True, key=options.get("key"))
        self.rows_ = data.local(data.n)[0]
        self.features_ = list(features)
        return self

    def transform(self, df):
        self._check(df)
        rows, k, names, l1 = self.rows_, self.n_neighbors, self.features_, self.metric == "manhattan"
        seen = ~np.isnan(rows)

        def fn(x):
            out, known = x.copy(), {}
            for i in np.flatnonzero(np.isnan(x).any(1)):
                if (same := x[i].tobytes()) not in known:  # rows alike have neighbours alike
                    d = np.abs(rows - x[i])
                    none = np.isnan(d).all(1)
                    d = np.where(np.isnan(d), 0, d if l1 else d * d).sum(1)
                    d[none] = np.inf
                    row = x[i].copy()
                    for j in np.flatnonzero(np.isnan(x[i])):
                        at = np.flatnonzero(seen[:, j])
                        if len(at) > k:  # those that may be among the nearest; ties go to the first row
                            at = at[d[at] <= np.partition(d[at], k - 1)[k - 1]]
                        near = at[np.argsort(d[at], kind="stable")[:k]]
                        row[j] = rows[near, j].mean() if len(near) else 0.0
                    known[same] = row
                out[i] = known[same]
            return {f: out[:, j] for j, f in enumerate(names)}

        return apply(df, names, fn, dict.fromkeys(names, "double"), len(rows)).select(*df.columns)


class IterativeImputer(Transformer):
    """Means first; then each feature with missing values from a least-squares fit on the others, in turns until they settle."""

    DEFAULTS = {"max_iter": 10, "tol": 1e-3, "random_state": -1}

    def fit(self, df, features, label=None, **options):
        data = Data(df, features, keep_missing=True)
        p = len(features)
        s, n = data.sum(lambda x, y, w: (np.nansum(x, 0), (~np.isnan(x)).sum(0)))
        self.mean_ = s / np.maximum(1, n)
        holes = [j for j in range(p) if n[j] < data.n]
        coef = np.zeros((p, p + 1))
        coef[:, -1] = self.mean_
        for _ in range(self.max_iter):
            before = coef.copy()
            for j in holes:
                def gram(x, y, w, j=j, coef=coef.copy()):
                    z = np.column_stack([_filled(x, self.mean_, coef, holes), np.ones(len(x))])
                    seen = ~np.isnan(x[:, j])
                    z = np.delete(z, j, 1)[seen]
                    return z.T @ z, z.T @ x[seen, j]

                g, v = data.sum(gram)
                b = np.linalg.lstsq(g, v, rcond=None)[0]
                coef[j] = np.insert(b, j, 0.0)
            if np.abs(coef - before).max() < self.tol:
                break
        self.coef_, self.holes_, self.features_ = coef, holes, list(features)
        return self

    def transform(self, df):
        self._check(df)
        names, mean, coef, holes = self.features_, self.mean_, self.coef_, self.holes_

        def fn(x):
            out = _filled(x, mean, coef, holes)
            return {f: out[:, j] for j, f in enumerate(names)}

        return apply(df, names, fn, dict.fromkeys(names, "double")).select(*df.columns)


def _filled(x: np.ndarray, mean: np.ndarray, coef: np.ndarray, holes: Sequence[int], sweeps: int = 3) -> np.ndarray:
    missing = np.isnan(x)
    out = np.where(missing, mean, x)
    for _ in range(sweeps):
        for j in holes:
            at = missing[:, j]
            out[at, j] = out[at] @ coef[j, :-1] + coef[j, -1]
    return out
