"""Feature scores and selectors. A selector's fit ends in the names that stay; its transform is a projection."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.core import Data, Transformer, class_moments, col, number
from tessera.operators.preprocessing import aggregate

Score = Callable[[DataFrame, Sequence[str], str], dict[str, float]]


def beta_tail(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_tail(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f = c = 1.0
    d = 0.0
    for i in range(400):
        m = i // 2
        num = 1.0 if i == 0 else (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)))
        d = 1 / (1 + num * d or 1e-300)
        c = 1 + num / c or 1e-300
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def f_tail(f: float, d1: float, d2: float) -> float:
    """P(F > f)."""
    return 1.0 if f <= 0 or d2 <= 0 else beta_tail(d2 / (d2 + d1 * f), d2 / 2, d1 / 2)


def chi2_tail(x: float, k: float) -> float:
    """P(chi square > x) by series or continued fraction."""
    a, x = k / 2, x / 2
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        for _ in range(1000):
            n += 1
            term *= x / n
            total += term
            if term < total * 1e-15:
                break
        return max(0.0, 1 - front * total)
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return min(1.0, front * h)


def f_classif(df: DataFrame, features: Sequence[str], label: str) -> dict[str, float]:
    """One-way analysis of variance F; infinite where the classes have no spread of their own."""
    data = Data(df, features, label)
    n, mean, g = class_moments(data, data.classes())
    total = (n[:, None] * mean).sum(0) / n.sum()
    between, within = (n[:, None] * (mean - total) ** 2).sum(0), np.einsum("kii->i", g)
    k = len(n)
    with np.errstate(divide="ignore", invalid="ignore"):
        f = (between / max(1, k - 1)) / (within / max(1.0, n.sum() - k))
    return dict(zip(features, np.where(within > 0, f, np.inf).tolist(), strict=True))


def r_squared(df: DataFrame, features: Sequence[str], label: str) -> dict[str, float]:
    a = aggregate(df, {f: F.corr(number(f), number(label)) for f in features})
    return {f: 0.0 if a[f] is None or a[f] != a[f] else a[f] ** 2 for f in features}


def f_regression(df: DataFrame, features: Sequence[str], label: str) -> dict[str, float]:
    """F of the one-feature regression, r2 / (1 - r2) * (n - 2)."""
    n = Data(df, features, label).n
    return {f: math.inf if r >= 1 else r / (1 - r) * (n - 2) for f, r in r_squared(df, features, label).items()}


def _binned(df: DataFrame, features: Sequence[str], bins: int) -> tuple[DataFrame, list[str]]:
    a = aggregate(df, {(k, f): g(number(f)) for k, g in (("lo", F.min), ("hi", F.max)) for f in features})
    out = []
    for i, f in enumerate(features):
        lo, hi = a["lo", f], a["hi", f]
        out.append((F.least(F.floor((number(f) - lo) * bins / (hi - lo)), F.lit(bins - 1)) if hi > lo else F.lit(0)).cast("int").alias(f"b{i}"))
    return df.select("*", *out), [f"b{i}" for i in range(len(features))]


def _tables(df: DataFrame, features: Sequence[str], label: str, bins: int) -> dict[str, np.ndarray]:
    """Contingency tables of binned features against the label, from one aggregation."""
    rows, names = _binned(df, features, bins)
    long = rows.select(col(label).alias("y"), F.explode(F.array(*(F.struct(F.lit(i).alias("f"), col(b).alias("b")) for i, b in enumerate(names)))).alias("x")).select("y", "x.f", "x.b").dropna()
    got = long.groupBy("f", "b", "y").agg(F.count("*").alias("n")).collect()
    ys = sorted({r["y"] for r in got})
    out = {f: np.zeros((bins, len(ys))) for f in features}
    for r in got:
        out[features[r["f"]]][r["b"], ys.index(r["y"])] = r["n"]
    return out


def _mutual(t: np.ndarray) -> float:
    p = t / t.sum()
    q = p.sum(1, keepdims=True) * p.sum(0, keepdims=True)
    return float((p[p > 0] * np.log(p[p > 0] / q[p > 0])).sum())


def mutual_info_classif(df: DataFrame, features: Sequence[str], label: str, bins: int = 10) -> dict[str, float]:
    """Mutual information of binned features and the label, in nats."""
    return {f: _mutual(t) for f, t in _tables(df, features, label, bins).items()}


def mutual_info_regression(df: DataFrame, features: Sequence[str], label: str, bins: int = 10) -> dict[str, float]:
    rows, (b,) = _binned(df, [label], bins)
    return mutual_info_classif(rows.withColumnRenamed(b, "target bin"), features, "target bin", bins)


def chi2(df: DataFrame, features: Sequence[str], label: str, bins: int = 10) -> dict[str, float]:
    """Chi square of features in ten bins of equal width against the label, over the cells that occur."""
    out = {}
    for f, t in _tables(df, features, label, bins).items():
        e = t.sum(1, keepdims=True) * t.sum(0, keepdims=True) / t.sum()
        at = t > 0
        out[f] = float(((t[at] - e[at]) ** 2 / e[at]).sum())
    return out


def p_values(df: DataFrame, features: Sequence[str], label: str, score: Score, scores: dict[str, float]) -> dict[str, float]:
    """Tails of the score's distribution; for a callback without one, 1 minus the scaled score."""
    data = Data(df, features, label)
    if score is f_classif:
        k = len(data.classes())
        return {f: f_tail(s, k - 1, data.n - k) if math.isfinite(s) else 0.0 for f, s in scores.items()}
    if score is f_regression:
        return {f: f_tail(s, 1, data.n - 2) if math.isfinite(s) else 0.0 for f, s in scores.items()}
    if score is chi2:
        return {f: chi2_tail(s, 9 * (len(data.classes()) - 1)) for f, s in scores.items()}
    v = {f: s if math.isfinite(s) else 0.0 for f, s in scores.items()}
    lo, hi = min(v.values()), max(v.values())
    return {f: 1 - (s - lo) / (hi - lo) if hi > lo else 1.0 for f, s in v.items()}


class Selector(Transformer):
    """Keeps ``selected_``, in the order of the features, and the columns that aren't features."""

    def outputs(self):
        return list(self.selected_)

    def transform(self, df):
        self._check(df)
        gone = set(self.features_) - set(self.selected_)
        return df.select(*(col(c) for c in df.columns if c not in gone))

    def inverse_transform(self, df):
        """The features that were dropped come back as 0."""
        return df.select("*", *(F.lit(0.0).alias(f) for f in self.features_ if f not in df.columns))

    def get_support(self) -> list[bool]:
        return [f in self.selected_ for f in self.features_]

    def _keep(self, features: Sequence[str], chosen) -> None:
        chosen = set(chosen)
        self.selected_, self.features_ = [f for f in features if f in chosen], list(features)


class VarianceThreshold(Selector):
    """Population variance over the threshold."""

    DEFAULTS = {"threshold": 0.0}

    def fit(self, df, features, label=None, **options):
        a = aggregate(df, {f: F.var_pop(number(f)) for f in features})
        self.variances_ = a
        self._keep(features, [f for f in features if (a[f] or 0.0) > self.threshold])
        if not self.selected_:
            raise ValueError("no feature's variance is over the threshold")
        return self


class _Univariate(Selector):
    DEFAULTS = {"score_func": f_classif}

    def fit(self, df, features, label=None, **options):
        raw = self.score_func(df, list(features), label)
        self.scores_ = {f: s if math.isfinite(s) or self.score_func in (f_classif, f_regression) else 0.0 for f, s in raw.items()}
        self.pvalues_ = p_values(df, list(features), label, self.score_func, self.scores_) if self.P_VALUES else {}
        self._keep(features, self._choose(list(features)))
        return self

    P_VALUES = False

    def _top(self, k: int) -> list[str]:
        order = sorted(self.scores_, key=lambda f: -self.scores_[f])
        return order[: max(1, min(k, len(order)))]

    def _or_best(self, chosen: list[str]) -> list[str]:
        return chosen or self._top(1)


class SelectKBest(_Univariate):
    DEFAULTS = {"k": 10}

    def _choose(self, features):
        return self._top(self.k)


class SelectPercentile(_Univariate):
    DEFAULTS = {"percentile": 10}

    def _choose(self, features):
        return self._top(math.ceil(len(features) * self.percentile / 100))


class SelectFpr(_Univariate):
    DEFAULTS = {"alpha": 0.05}
    P_VALUES = True

    def _choose(self, features):
        return self._or_best([f for f in features if self.pvalues_[f] <= self.alpha])


class SelectFwe(_Univariate):
    DEFAULTS = {"alpha": 0.05}
    P_VALUES = True

    def _choose(self, features):
        return self._or_best([f for f in features if self.pvalues_[f] <= self.alpha / len(features)])


class SelectFdr(_Univariate):
    """Benjamini-Hochberg."""

    DEFAULTS = {"alpha": 0.05}
    P_VALUES = True

    def _choose(self, features):
        order = sorted(features, key=lambda f: self.pvalues_[f])
        last = max((i for i, f in enumerate(order) if self.pvalues_[f] <= self.alpha * (i + 1) / len(order)), default=-1)
        return self._or_best(order[: last + 1])


class GenericUnivariateSelect(_Univariate):
    DEFAULTS = {"mode": "percentile", "param": 10.0}
    P_VALUES = True

    def _choose(self, features):
        kinds = {"k_best": (SelectKBest, "k", int), "percentile": (SelectPercentile, "percentile", float), "fpr": (SelectFpr, "alpha", float), "fdr": (SelectFdr, "alpha", float), "fwe": (SelectFwe, "alpha", float)}
        if self.mode not in kinds:
            raise ValueError(f"no mode {self.mode}")
        cls, name, kind = kinds[self.mode]
        inner = cls(score_func=self.score_func, **{name: kind(self.param)})
        inner.scores_, inner.pvalues_ = self.scores_, self.pvalues_
        return inner._choose(features)


def importances(model, features: Sequence[str]) -> np.ndarray:
    """Absolute coefficients (their greatest over outputs) or feature importances of a fitted model."""
    for name in ("feature_importances_", "coef_"):
        v = model.__dict__.get(name)
        if v is not None:
            v = np.abs(np.asarray(v, float))
            return v.max(0) if v.ndim == 2 else v
    raise ValueError(f"{type(model).__name__} has neither coefficients nor importances")


class SelectFromModel(Selector):
    DEFAULTS = {"estimator": None, "threshold": 0.0, "max_features": -1}

    def fit(self, df, features, label=None, **options):
        v = importances(self.estimator.clone().fit(df, features, label), features)
        limit = self.threshold if self.threshold > 0 else v.mean()
        order = sorted(range(len(v)), key=lambda i: -v[i])
        chosen = [i for i in order if v[i] >= limit]
        if self.max_features > 0:
            chosen = chosen[: self.max_features]
        self._keep(features, [features[i] for i in chosen or order[:1]])
        return self


def _weakest(estimator, df: DataFrame, names: list[str], label: str, step: int) -> list[str]:
    v = importances(estimator.clone().fit(df, names, label), names)
    gone = {names[i] for i in sorted(range(len(names)), key=lambda i: v[i])[:step]}
    return [f for f in names if f not in gone]


class RFE(Selector):
    """Drops the features of least weight, ``step`` at a time."""

    DEFAULTS = {"estimator": None, "n_features_to_select": -1, "step": 1}

    def fit(self, df, features, label=None, **options):
        n = self.n_features_to_select if self.n_features_to_select > 0 else max(1, len(features) // 2)
        names = list(features)
        while len(names) > n:
            names = _weakest(self.estimator, df, names, label, min(self.step, len(names) - n))
        self._keep(features, names)
        return self


class RFECV(Selector):
    """RFE at each size; the size of best mean score stays."""

    DEFAULTS = {"estimator": None, "cv": None, "step": 1, "scoring": "accuracy", "min_features_to_select": 1}

    def fit(self, df, features, label=None, key=None, **options):
        from tessera.operators.search import cross_val_score

        names, best = list(features), None
        self.cv_scores_ = {}
        while True:
            s = float(np.mean(cross_val_score(self.estimator, df, names, label, self.cv, self.scoring, key=key)))
            self.cv_scores_[len(names)] = s
            if best is None or s > best[0]:
                best = s, names
            if len(names) <= self.min_features_to_select:
                break
            names = _weakest(self.estimator, df, names, label, min(self.step, len(names) - self.min_features_to_select))
        self._keep(features, best[1])
        return self


class SequentialFeatureSelector(Selector):
    """Greedy forward or backward by mean cross-validated score; of equal ones the first feature."""

    DEFAULTS = {"estimator": None, "cv": None, "n_features_to_select": -1, "direction": "forward", "scoring": "accuracy"}

    def fit(self, df, features, label=None, key=None, **options):
        from tessera.operators.search import cross_val_score

        n = self.n_features_to_select if self.n_features_to_select > 0 else max(1, len(features) // 2)
        forward = self.direction == "forward"
        names = [] if forward else list(features)
        while len(names) != n:
            best = None
            for f in features:
                if (f in names) == forward:
                    continue
                trial = [x for x in features if (x in names) != (x == f)]
                s = float(np.mean(cross_val_score(self.estimator, df, trial, label, self.cv, self.scoring, key=key)))
                if best is None or s > best[0]:
                    best = s, trial
            names = best[1]
        self._keep(features, names)
        return self
