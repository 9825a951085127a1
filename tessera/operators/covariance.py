"""Covariances, densities, outliers and Gaussian processes."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

import tessera.core as core
from tessera.core import Classifier, Data, Estimator, Regressor, apply, codes, expit, moments
from tessera.operators.neighbors import distances
from tessera.operators.pairs import Pairs, against, nearest_place, nearest_rows
from tessera.operators.svm import dual, kernel_of


class EmpiricalCovariance(Estimator):
    """location_, covariance_ (over n) and precision_; ``mahalanobis`` adds squared distances."""

    DEFAULTS = {"assume_centered": False}

    def _fit(self, data):
        n, mean, g = moments(data)
        if self.assume_centered:
            g, mean = g + n * np.outer(mean, mean), np.zeros_like(mean)
        self.location_ = mean
        self._set(self._shrunk(g / n, n, data))

    def _shrunk(self, s, n, data):
        return s

    def _set(self, c):
        self.covariance_, self.precision_ = c, np.linalg.pinv(c)

    def distance_rows(self, x):
        d = x - self.location_
        return np.einsum("ni,ij,nj->n", d, self.precision_, d)

    def mahalanobis(self, df):
        self._check(df)
        return apply(df, self.features_, lambda x: {"mahalanobis": self.distance_rows(x)}, {"mahalanobis": "double"})

    def score_samples(self, df):
        """Gaussian log densities."""
        self._check(df)
        det = np.linalg.slogdet(self.covariance_)[1]
        return apply(df, self.features_, lambda x: {"score": -0.5 * (self.distance_rows(x) + det + x.shape[1] * math.log(2 * math.pi))}, {"score": "double"})


def towards_identity(s: np.ndarray, shrinkage: float) -> np.ndarray:
    return (1 - shrinkage) * s + shrinkage * np.trace(s) / len(s) * np.eye(len(s))


class ShrunkCovariance(EmpiricalCovariance):
    DEFAULTS = {"shrinkage": 0.1}

    def _shrunk(self, s, n, data):
        self.shrinkage_ = self.shrinkage
        return towards_identity(s, self.shrinkage)


class LedoitWolf(EmpiricalCovariance):
    def _shrunk(self, s, n, data):
        p, centre = len(s), self.location_

        def fourth(x, y, w):
            z = x - centre
            return np.array([((z * z).sum(1) ** 2).sum()])

        (q,) = data.sum(fourth)
        mu = np.trace(s) / p
        delta = ((s - mu * np.eye(p)) ** 2).sum()
        beta = (float(q[0]) / n - (s * s).sum()) / n
        self.shrinkage_ = min(max(beta, 0.0) / delta, 1.0) if delta else 1.0
        return towards_identity(s, self.shrinkage_)


class OAS(EmpiricalCovariance):
    def _shrunk(self, s, n, data):
        p = len(s)
        tr, tr2 = np.trace(s), (s * s).sum()
        low = (n + 1 - 2 / p) * (tr2 - tr * tr / p)
        self.shrinkage_ = min(max(((1 - 2 / p) * tr2 + tr * tr) / low, 0.0), 1.0) if low else 1.0
        return towards_identity(s, self.shrinkage_)


class MinCovDet(EmpiricalCovariance):
    """The covariance of the share of rows that are nearest by it; each step is a quantile and a sum."""

    DEFAULTS = {"support_fraction": 0.75, "max_iter": 100, "tol": 1e-3, "random_state": 0}

    def _fit(self, data):
        super()._fit(data)
        h, before = max(len(data.features) + 1, int(self.support_fraction * data.n)), math.inf
        named = data.table.toDF(*data.features, *data.table.columns[len(data.features) :])
        for _ in range(self.max_iter):
            limit = self._quantile(data, named, h / data.n)

            def fn(x, y, w, t=limit):
                x = x[self.distance_rows(x) <= t]
                z = x - self.location_
                return np.array([float(len(x))]), z.sum(0), z.T @ z

            n, s, g = data.sum(fn)
            n = max(float(n[0]), 1.0)
            self.location_ = self.location_ + (0 if self.assume_centered else s / n)
            self._set(g / n - (0 if self.assume_centered else np.outer(s, s) / n / n) + 1e-12 * np.eye(len(s)))
            now = np.linalg.slogdet(self.covariance_)[1]
            if abs(before - now) < self.tol:
                break
            before = now
        self.support_ = n

    def _quantile(self, data, named, q: float) -> float:
        if data.is_local:
            return float(np.quantile(self.distance_rows(data._read()[:, : len(data.features)]), q, method="lower"))
        d = apply(named, data.features, lambda x: {"d": self.distance_rows(x)}, {"d": "double"})
        return d.agg(F.percentile_approx("d", F.lit(q), F.lit(10000))).first()[0]


class EllipticEnvelope(MinCovDet):
    """Rows beyond the quantile 1 - contamination of the robust distances are -1."""

    DEFAULTS = {"contamination": 0.1}

    def _fit(self, data):
        super()._fit(data)
        self.threshold_ = self._quantile(data, data.table.toDF(*data.features, *data.table.columns[len(data.features) :]), 1 - self.contamination)

    def decision_function(self, df):
        return self.mahalanobis(df).withColumn("decision", self.threshold_ - F.col("mahalanobis"))

    def predict(self, df):
        return self.decision_function(df).withColumn("prediction", F.when(F.col("decision") >= 0, 1).otherwise(-1))


class KernelDensity(Estimator):
    """Log densities by a Gaussian kernel on a bounded number of rows."""

    DEFAULTS = {"bandwidth": 1.0, "kernel": "gaussian", "limit": 50_000}

    def _fit(self, data):
        if self.kernel != "gaussian":
            raise ValueError("only the Gaussian kernel")
        if self.bandwidth <= 0:
            raise ValueError("the bandwidth must be positive")
        self.rows_ = data.local(self.limit)[0]

    def score_rows(self, x):
        h, p, out = self.bandwidth, self.rows_.shape[1], []
        for at in range(0, len(x), 256):
            z = -0.5 * (distances(x[at : at + 256], self.rows_) / h) ** 2
            top = z.max(1)
            out.append(top + np.log(np.exp(z - top[:, None]).sum(1)))
        return np.concatenate(out or [np.zeros(0)]) - math.log(len(self.rows_)) - p * math.log(h) - 0.5 * p * math.log(2 * math.pi)

    def score_samples(self, df):
        self._check(df)
        return apply(df, self.features_, lambda x: {"score": self.score_rows(x)}, {"score": "double"})


class _Outliers(Estimator):
    """``score`` is greater for outliers; over the quantile 1 - contamination of the fitted rows a row is -1."""

    DEFAULTS = {"contamination": 0.1}

    def _threshold(self, data: Data) -> None:
        rank = int((data.n - 1) * (1 - self.contamination))
        self.offset_ = float(data.ranked([rank], lambda x, y, w: self.score_rows(x)[:, None])[0, 0])

    def decision_function(self, df):
        self._check(df)
        return apply(df, self.features_, lambda x: {"decision": self.offset_ - self.score_rows(x)}, {"decision": "double"}, len(self.__dict__.get("rows_", ())))

    def predict(self, df):
        return self.decision_function(df).withColumn("prediction", F.when(F.col("decision") >= 0, 1).otherwise(-1))

    def fit_predict(self, df, features):
        return self.fit(df, features).predict(df)


def path_length(n: float) -> float:
    """The mean depth of an unsuccessful search among n."""
    return 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n if n > 2 else float(n == 2)


class IsolationForest(_Outliers):
    """Trees cut at random, each on rows of its own, ``max_samples`` of them; score 2 ** -(mean depth / expected depth)."""

    DEFAULTS = {"n_estimators": 100, "max_samples": 256, "random_state": 0}

    def _fit(self, data):
        rng = np.random.default_rng(max(0, self.random_state))
        m = min(self.max_samples if self.max_samples > 0 else 256, data.n)
        pool = data.first(min(data.n, m * self.n_estimators), max(0, self.random_state))[:, : len(data.features)]
        self.depth_, self.trees_ = math.ceil(math.log2(max(2, m))), []
        for _ in range(self.n_estimators):
            self.trees_.append(self._tree(pool[rng.choice(len(pool), m, replace=False)], 0, rng))
        self.expected_ = path_length(m) or 1.0
        self._threshold(data)

    def _tree(self, x, depth, rng):
        if depth >= self.depth_ or len(x) <= 1 or not (x.max(0) > x.min(0)).any():
            return depth + path_length(len(x))
        j = int(rng.choice(np.flatnonzero(x.max(0) > x.min(0))))
        cut = rng.uniform(x[:, j].min(), x[:, j].max())
        left = x[:, j] <= cut
        return j, cut, self._tree(x[left], depth + 1, rng), self._tree(x[~left], depth + 1, rng)

    def score_rows(self, x):
        total = np.zeros(len(x))

        def walk(t, at):
            if not isinstance(t, tuple):
                total[at] += t
                return
            left = x[at, t[0]] <= t[1]
            walk(t[2], at[left])
            walk(t[3], at[~left])

        for t in self.trees_:
            walk(t, np.arange(len(x)))
        return 2 ** (-total / len(self.trees_) / self.expected_)


class LocalOutlierFactor(_Outliers):
    """The neighbours' mean local density over a row's own."""

    DEFAULTS = {"n_neighbors": 20, "metric": "euclidean"}

    def _fit(self, data):
        self.rows_ = data.local(data.n)[0]
        if data.n > core.PAIR_ROWS:
            d, i = Pairs(data.table.sparkSession, self.rows_).nearest(self.n_neighbors, self.metric)
        else:
            d, i = nearest_rows(self.rows_, self.rows_, self.n_neighbors, self.metric, 0)
        self.k_distance_ = d[:, -1]
        self.lrd_ = 1 / np.maximum(np.maximum(d, self.k_distance_[i]).mean(1), 1e-10)
        self.negative_outlier_factor_ = -self.lrd_[i].mean(1) / self.lrd_
        self.offset_ = float(np.quantile(-self.negative_outlier_factor_, 1 - self.contamination, method="lower"))

    def score_rows(self, x):
        if not len(x):
            return np.zeros(0)
        d, i = nearest_rows(x, self.rows_, self.n_neighbors, self.metric)
        return self.lrd_[i].mean(1) * np.maximum(d, self.k_distance_[i]).mean(1)


class GaussianProcessRegressor(Regressor):
    """RBF kernel."""

    DEFAULTS = {"length_scale": 1.0, "alpha": 1e-10, "normalize_y": True}

    def _fit(self, data):
        x, y, _ = data.local(data.n)
        self.mean_ = float(y.mean()) if self.normalize_y else 0.0
        self.gamma_ = 0.5 / self.length_scale**2
        self.rows_, self.dual_ = dual(data, x, kernel_of("rbf", self.gamma_, 0, 0), self.alpha + 1e-12, y - self.mean_)

    def predict_rows(self, x):
        return against(kernel_of("rbf", self.gamma_, 0, 0), x, self.rows_, self.dual_) + self.mean_


class GaussianProcessClassifier(Classifier):
    """A process for each class's indicator; probabilities are sigmoids of them about one half."""

    DEFAULTS = {"length_scale": 1.0, "alpha": 1e-6}

    def _fit(self, data):
        x, y, _ = data.local(data.n)
        self.gamma_ = 0.5 / self.length_scale**2
        t = np.eye(len(self.classes_))[codes(self.classes_, y)] - 0.5
        self.rows_, self.dual_ = dual(data, x, kernel_of("rbf", self.gamma_, 0, 0), self.alpha + 1e-12, t)

    def proba_rows(self, x):
        q = expit(against(kernel_of("rbf", self.gamma_, 0, 0), x, self.rows_, self.dual_))
        return q / q.sum(1, keepdims=True)


class LabelPropagation(Classifier):
    """Labels under 0 are unknown. Known ones spread along the affinity of all rows and stay as they are."""

    DEFAULTS = {"gamma": 20.0, "max_iter": 30, "tol": 1e-3, "kernel": "rbf", "n_neighbors": 7}

    def fit(self, df, features, label=None, **options):
        data = Data(df, features, label)
        self.classes_ = np.array([c for c in data.classes() if c >= 0])
        if not len(self.classes_):
            raise ValueError("no row has a label")
        self._fit(data)
        self.features_ = list(features)
        return self

    def _affinity(self, data, x, own):
        """Products with the affinity of all rows, a row's with itself only if ``own``."""
        few = len(x) <= core.PAIR_ROWS
        if self.kernel == "rbf":
            if few:
                w = np.exp(-self.gamma * distances(x, x) ** 2)
                w[np.diag_indices(len(x))] *= own
                return lambda f: w @ f
            far, tile = Pairs(data.table.sparkSession, x), kernel_of("rbf", self.gamma, 0, 0)
            return lambda f: far.product(tile, f, own)
        if self.kernel != "knn":
            raise ValueError("kernel must be rbf or knn")
        k = self.n_neighbors
        at = nearest_rows(x, x, k)[1] if few else Pairs(data.table.sparkSession, x).map(lambda b, z, _: nearest_rows(z[b], z, k)[1]).astype(np.int64)
        w = np.where(at == np.arange(len(x))[:, None], float(own), 1.0)
        return lambda f: np.einsum("nk,nkc->nc", w, f[at])

    def _fit(self, data):
        x, y, _ = data.local(data.n)
        known = y >= 0
        start = np.zeros((len(x), len(self.classes_)))
        start[known, codes(self.classes_, y[known])] = 1
        f = self._spread(data, x, start, known)
        total = f.sum(1, keepdims=True)
        self.rows_, self.label_distributions_ = x, np.where(total > 0, f / np.maximum(total, 1e-300), 1 / f.shape[1])

    def _spread(self, data, x, start, known):
        times, f = self._affinity(data, x, True), start.copy()
        total = np.maximum(times(np.ones((len(x), 1))), 1e-300)
        for _ in range(self.max_iter):
            new = times(f) / total
            new[known] = start[known]
            done = np.abs(new - f).sum() < self.tol
            f = new
            if done:
                break
        return f

    def proba_rows(self, x):
        return self.label_distributions_[nearest_place(x, self.rows_)]


class LabelSpreading(LabelPropagation):
    """Known labels give way by alpha."""

    DEFAULTS = {"alpha": 0.2}

    def _spread(self, data, x, start, known):
        times, f = self._affinity(data, x, False), start.copy()
        s = 1 / np.sqrt(np.maximum(times(np.ones((len(x), 1))), 1e-300))
        for _ in range(self.max_iter):
            new = self.alpha * s * times(s * f) + (1 - self.alpha) * start
            done = np.abs(new - f).sum() < self.tol
            f = new
            if done:
                break
        return f


class SelfTrainingClassifier(Classifier):
    """Nearest neighbours that take on their surest predictions as labels."""

    DEFAULTS = {"n_neighbors": 5, "threshold": 0.75, "max_iter": 10}
    fit = LabelPropagation.fit

    def _votes(self, q, x, y):
        near = codes(self.classes_, y)[nearest_rows(q, x, self.n_neighbors)[1]]
        return np.stack([(near == c).mean(1) for c in range(len(self.classes_))], 1)

    def _fit(self, data):
        x, y, _ = data.local(data.n)
        y, far = y.copy(), Pairs(data.table.sparkSession, x) if data.n > core.PAIR_ROWS else None
        m = type(self)(**self.params)
        m.classes_ = self.classes_

        def open_votes(at, x, state):
            (y,), z = state, np.full((at.stop - at.start, len(m.classes_)), np.nan)
            left = np.flatnonzero(y[at] < 0)
            z[left] = m._votes(x[at][left], x[y >= 0], y[y >= 0])
            return z

        for _ in range(self.max_iter):
            open_ = np.flatnonzero(y < 0)
            if not len(open_):
                break
            p = self._votes(x[open_], x[y >= 0], y[y >= 0]) if far is None else far.map(open_votes, y, rows=1024)[open_]
            sure = p.max(1) >= self.threshold
            if not sure.any():
                break
            y[open_[sure]] = self.classes_[p[sure].argmax(1)]
        self.rows_, self.labels_ = x[y >= 0], y[y >= 0]

    def proba_rows(self, x):
        return self._votes(x, self.rows_, self.labels_)
