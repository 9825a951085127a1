"""Naive Bayes, discriminant analysis and dummies: grouped sums, then log densities of blocks of rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessera.core import Classifier, Data, Regressor, class_moments, codes, softmax


class _Scores(Classifier):
    """A classifier by the greatest log score."""

    def scores(self, x: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def proba_rows(self, x):
        return softmax(self.scores(x))


class GaussianNB(_Scores):
    """Means and population variances of each class, floored at var_smoothing."""

    DEFAULTS = {"var_smoothing": 1e-9}

    def _fit(self, data):
        n, self.theta_, g = class_moments(data, self.classes_)
        self.var_ = np.maximum(np.einsum("kii->ki", g) / n[:, None], self.var_smoothing)
        self.class_prior_ = n / n.sum()

    def scores(self, x):
        d = (x[:, None] - self.theta_[None]) ** 2 / self.var_
        return np.log(self.class_prior_) - 0.5 * (d + np.log(2 * np.pi * self.var_)).sum(2)


class _Counts(_Scores):
    DEFAULTS = {"alpha": 1.0, "fit_prior": True}

    def _rows(self, x: np.ndarray) -> np.ndarray:
        if (x < 0).any():
            raise ValueError("counts can't be negative")
        return x

    def _fit(self, data):
        classes = self.classes_

        def fn(x, y, w):
            k, s = codes(classes, y), np.zeros((len(classes), x.shape[1]))
            np.add.at(s, k, self._rows(x))
            return np.bincount(k, minlength=len(classes)), s

        n, s = data.sum(fn)
        self.class_log_prior_ = np.log(n / n.sum()) if self.fit_prior else np.full(len(n), -np.log(len(n)))
        self._weights(n, s)


class MultinomialNB(_Counts):
    def _weights(self, n, s):
        s = s + self.alpha
        self.feature_log_prob_ = np.log(s) - np.log(s.sum(1, keepdims=True))

    def scores(self, x):
        return x @ self.feature_log_prob_.T + self.class_log_prior_


class ComplementNB(_Counts):
    """Weights from the other classes' counts; the class they fit least wins."""

    def _weights(self, n, s):
        c = s.sum(0) - s + self.alpha
        self.feature_log_prob_ = np.log(c) - np.log(c.sum(1, keepdims=True))

    def scores(self, x):
        return -(x @ self.feature_log_prob_.T)


class BernoulliNB(_Counts):
    DEFAULTS = {"binarize": 0.0}

    def _rows(self, x):
        return (x > self.binarize).astype(float)

    def _weights(self, n, s):
        self.feature_prob_ = (s + self.alpha) / (n[:, None] + 2 * self.alpha)

    def scores(self, x):
        b = self._rows(x)
        return b @ np.log(self.feature_prob_).T + (1 - b) @ np.log1p(-self.feature_prob_).T + self.class_log_prior_


class CategoricalNB(_Scores):
    """Features are whole numbers from 0; a category that wasn't seen counts as alpha."""

    DEFAULTS = {"alpha": 1.0, "fit_prior": True}

    def _fit(self, data):
        classes, p = self.classes_, len(data.features)
        top = int(max(r or 0 for r in data.table.agg(*(F.max(f"x{i}") for i in range(p))).first())) + 1

        def fn(x, y, w):
            if (x < 0).any() or (np.abs(x - x.round()) > 1e-6).any():
                raise ValueError("categories must be whole numbers from 0")
            k, c = codes(classes, y), np.zeros((p, len(classes), top))
            for j in range(p):
                np.add.at(c[j], (k, x[:, j].round().astype(int)), 1)
            return np.bincount(k, minlength=len(classes)), c

        n, c = data.sum(fn)
        self.class_log_prior_ = np.log(n / n.sum()) if self.fit_prior else np.full(len(n), -np.log(len(n)))
        size = [int(np.flatnonzero(c[j].sum(0)).max()) + 1 for j in range(p)]
        self.tables_ = [np.log((c[j][:, : size[j]] + self.alpha) / (n[:, None] + self.alpha * size[j])) for j in range(p)]
        self.unseen_ = [np.log(self.alpha / (n + self.alpha * s)) for s in size]

    def scores(self, x):
        out = np.tile(self.class_log_prior_, (len(x), 1))
        for j, t in enumerate(self.tables_):
            v = x[:, j].round().astype(int)
            ok = (v >= 0) & (v < t.shape[1])
            out += np.where(ok[:, None], t[:, np.clip(v, 0, t.shape[1] - 1)].T, self.unseen_[j])
        return out


class LinearDiscriminantAnalysis(_Scores):
    """Pooled covariance over n - k, plus the regularisation on its diagonal."""

    DEFAULTS = {"regularization": 0.0}

    def _fit(self, data):
        n, self.means_, g = class_moments(data, self.classes_)
        self.priors_ = n / n.sum()
        self.covariance_ = g.sum(0) / max(1.0, n.sum() - len(n)) + self.regularization * np.eye(g.shape[1])
        inv = np.linalg.pinv(self.covariance_)
        self.coef_ = self.means_ @ inv
        self.intercept_ = np.log(self.priors_) - 0.5 * np.einsum("ki,ki->k", self.coef_, self.means_)

    def scores(self, x):
        return x @ self.coef_.T + self.intercept_


class QuadraticDiscriminantAnalysis(_Scores):
    """A covariance over n_c - 1 for each class."""

    DEFAULTS = {"regularization": 0.0}

    def _fit(self, data):
        n, self.means_, g = class_moments(data, self.classes_)
        if (n < 2).any():
            raise ValueError("each class needs two rows")
        self.priors_ = n / n.sum()
        cov = g / (n - 1)[:, None, None] + self.regularization * np.eye(g.shape[1])
        self.inverse_ = np.linalg.pinv(cov)
        self.logdet_ = np.linalg.slogdet(cov)[1]

    def scores(self, x):
        d = x[:, None] - self.means_
        q = np.einsum("nki,kij,nkj->nk", d, self.inverse_, d)
        return -0.5 * (q + self.logdet_) + np.log(self.priors_)


class DummyClassifier(Classifier):
    """most_frequent (of equal ones the smallest label), prior, or uniform by a hash of the row."""

    DEFAULTS = {"strategy": "most_frequent"}
    ONE_CLASS = True

    def _fit(self, data):
        classes = self.classes_
        (n,) = data.sum(lambda x, y, w: np.bincount(codes(classes, y), minlength=len(classes)))
        self.class_prior_ = n / n.sum()

    def proba_rows(self, x):
        k = len(self.classes_)
        if self.strategy == "uniform":
            from tessera.operators.linear import fold_of

            return np.eye(k)[fold_of(x, np.zeros(len(x)), k)] if len(x) else np.zeros((0, k))
        if self.strategy == "prior":
            return np.tile(self.class_prior_, (len(x), 1))
        if self.strategy != "most_frequent":
            raise ValueError("strategy must be most_frequent, prior or uniform")
        return np.tile(np.eye(k)[int(self.class_prior_.argmax())], (len(x), 1))


class DummyRegressor(Regressor):
    """The mean, median, a quantile or a constant."""

    DEFAULTS = {"strategy": "mean", "quantile": 0.5, "constant": 0.0}

    def _fit(self, data: Data):
        y = F.col(f"x{len(data.features)}")
        kinds = {"mean": F.avg(y), "median": F.percentile(y, F.lit(0.5)), "quantile": F.percentile(y, F.lit(float(self.quantile))), "constant": F.lit(float(self.constant))}
        if self.strategy not in kinds:
            raise ValueError("strategy must be mean, median, quantile or constant")
        self.value_ = float(data.table.agg(kinds[self.strategy]).first()[0])

    def _predict(self, df):
        return df.withColumn("prediction", F.lit(self.value_))

    def predict_rows(self, x):
        return np.full(len(x), self.value_)
