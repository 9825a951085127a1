"""Support vector machines: linear ones by passes over all rows, kernel ones by passes over blocks of all pairs."""

from __future__ import annotations


import numpy as np
from pyspark.sql import functions as F

import tessera.core as core
from tessera.core import Classifier, Data, Estimator, apply, codes, expit
from tessera.core import moments as all_moments
from tessera.operators.linear import LinearModel, Ridge, newton
from tessera.operators.pairs import Pairs, against, solve

KERNELS = ("linear", "rbf", "poly", "sigmoid")


def kernel(kind: str, a: np.ndarray, b: np.ndarray, gamma: float, degree: float, coef0: float) -> np.ndarray:
    if kind == "linear":
        return a @ b.T
    if kind == "rbf":
        return np.exp(-gamma * np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0))
    if kind == "poly":
        return (gamma * a @ b.T + coef0) ** degree
    if kind == "sigmoid":
        return np.tanh(gamma * a @ b.T + coef0)
    raise ValueError(f"no kernel {kind}; there are {KERNELS}")


def kernel_of(kind: str, gamma: float, degree: float, coef0: float):
    return lambda a, b: kernel(kind, a, b, gamma, degree, coef0)


def dual(data: Data, x: np.ndarray, tile, ridge: float, t: np.ndarray, definite: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Rows and their weights by (K + ridge I) a = t: at once for few rows, else by passes over blocks of pairs.

    Copies of a row, which make K singular, are one row of the passes, with their sum of weights and mean of t.
    """
    if len(x) <= core.PAIR_ROWS:
        return x, np.linalg.solve(tile(x, x) + ridge * np.eye(len(x)), t)
    rows, at, n = np.unique(x, axis=0, return_inverse=True, return_counts=True)
    mean = np.zeros((len(rows), *t.shape[1:]))
    np.add.at(mean, at.ravel(), t)
    mean /= n.reshape(-1, *[1] * (t.ndim - 1))
    pairs = Pairs(data.table.sparkSession, rows)
    out = rows, solve(pairs, tile, ridge / n, mean, definite)
    pairs.close()
    return out


def _scaled(data: Data) -> tuple[np.ndarray, np.ndarray, float]:
    n, mean, g = all_moments(data)
    p = len(data.features)
    s = np.sqrt(np.maximum(np.diag(g)[:p] / n, 0))
    s[s == 0] = 1.0
    return mean[:p], s, n


def _definite(m) -> bool:
    """Whether the kernel's matrices have no negative eigenvalue."""
    return m.kernel in ("linear", "rbf") or (m.kernel == "poly" and m.coef0 >= 0 and m.gamma >= 0 and float(m.degree).is_integer())


class LinearSVC(Classifier):
    """Squared hinge with penalty 1/C, one against the rest; probabilities are sigmoids of the scores."""

    DEFAULTS = {"C": 1.0, "max_iter": 50, "tol": 1e-6, "lr": 0.01, "random_state": 0}

    def _penalty(self, n: float) -> float:
        return 1 / self.C

    def _fit(self, data):
        m, s, n = _scaled(data)
        classes, p = self.classes_, len(data.features)
        targets = [classes[1]] if len(classes) == 2 else list(classes)
        coef, intercept = [], []
        for c in targets:
            def grad(t, x1, y, w, c=c):
                z = np.column_stack([(x1[:, :-1] - m) / s, x1[:, -1]])
                v = np.where(y.astype(int) == c, 1.0, -1.0)
                r = np.maximum(1 - v * (z @ t), 0)
                at = w * (r > 0)
                return (w * r * r).sum(), -2 * z.T @ (w * r * v), 2 * (z * at[:, None]).T @ z

            t = newton(data, grad, p + 1, np.r_[np.full(p, self._penalty(n)), 1e-8], self.max_iter, self.tol)
            coef.append(t[:-1] / s)
            intercept.append(t[-1] - (t[:-1] / s) @ m)
        self.coef_, self.intercept_ = np.array(coef), np.array(intercept)

    def scores(self, x):
        z = x @ self.coef_.T + self.intercept_
        return np.column_stack([-z[:, 0], z[:, 0]]) if len(self.coef_) == 1 else z

    def proba_rows(self, x):
        q = expit(self.scores(x))
        return q / q.sum(1, keepdims=True)


class NuSVC(LinearSVC):
    """A linear machine with penalty nu * n."""

    DEFAULTS = {"nu": 0.5}

    def _penalty(self, n):
        if not 0 < self.nu <= 1:
            raise ValueError("nu must be over 0 and at most 1")
        return self.nu * n


class SVC(Classifier):
    """Kernel ridge on +-1 for each class."""

    DEFAULTS = {"kernel": "rbf", "C": 1.0, "gamma": 1.0, "degree": 3.0, "coef0": 0.0, "max_iter": 1000, "lr": 0.01, "random_state": 0}

    def _fit(self, data):
        x, y, _ = data.local(data.n)
        t = np.where(codes(self.classes_, y)[:, None] == np.arange(len(self.classes_)), 1.0, -1.0)
        self.rows_, self.dual_ = dual(data, x, kernel_of(self.kernel, self.gamma, self.degree, self.coef0), 1 / self.C, t, _definite(self))

    def proba_rows(self, x):
        q = expit(against(kernel_of(self.kernel, self.gamma, self.degree, self.coef0), x, self.rows_, self.dual_))
        return q / q.sum(1, keepdims=True)


class SVR(LinearModel):
    """Linear: ridge with penalty 1/C over all rows. Other kernels: kernel ridge."""

    DEFAULTS = {"kernel": "linear", "C": 1.0, "epsilon": 0.1, "gamma": 1.0, "degree": 3.0, "coef0": 0.0, "max_iter": 1000, "lr": 0.01, "random_state": 0}

    def _fit(self, data):
        if self.kernel == "linear":
            inner = Ridge(alpha=1 / self.C, fit_intercept=True)
            inner._fit(data)
            self.coef_, self.intercept_ = inner.coef_, inner.intercept_
            return
        x, y, _ = data.local(data.n)
        self.mean_ = float(y.mean())
        self.rows_, self.dual_ = dual(data, x, kernel_of(self.kernel, self.gamma, self.degree, self.coef0), 1 / self.C, y - self.mean_, _definite(self))

    def predict_rows(self, x):
        if self.kernel == "linear":
            return super().predict_rows(x)
        return against(kernel_of(self.kernel, self.gamma, self.degree, self.coef0), x, self.rows_, self.dual_) + self.mean_

    def _predict(self, df):
        if self.kernel == "linear":
            return super()._predict(df)
        return apply(df, self.features_, lambda x: {"prediction": self.predict_rows(x)}, {"prediction": "double"}, len(self.rows_))


class LinearSVR(LinearModel):
    """Squared epsilon-insensitive loss with penalty 1/C."""

    DEFAULTS = {"C": 1.0, "epsilon": 0.1, "max_iter": 50, "tol": 1e-6, "lr": 0.01, "random_state": 0}

    def _setting(self, n: float) -> tuple[float, float]:
        return self.epsilon, 1 / self.C

    def _fit(self, data):
        m, s, n = _scaled(data)
        p, (eps, penalty) = len(data.features), self._setting(n)
        (total,) = data.sum(lambda x, y, w: np.array([(w * y).sum()]))

        def grad(t, x1, y, w):
            z = np.column_stack([(x1[:, :-1] - m) / s, x1[:, -1]])
            r = z @ t - y
            over = np.sign(r) * np.maximum(np.abs(r) - eps, 0)
            return (w * over * over).sum(), 2 * z.T @ (w * over), 2 * (z * (w * (over != 0))[:, None]).T @ z

        t = newton(data, grad, p + 1, np.r_[np.full(p, penalty), 1e-8], self.max_iter, self.tol, np.r_[np.zeros(p), total[0] / n])
        self.coef_ = t[:-1] / s
        self.intercept_ = float(t[-1] - self.coef_ @ m)


class NuSVR(LinearSVR):
    DEFAULTS = {"nu": 0.5}

    def _setting(self, n):
        return 0.1 * self.nu, self.nu / (2 * self.C)


class OneClassSVM(Estimator):
    """Rows that score under the nu quantile are -1, others 1.

    linear: minus the distance to the centre; other kernels: the mean kernel to a pseudo-random share nu of the rows,
    however many, or to raise beyond ``max_support`` if that is given.
    """

    DEFAULTS = {"nu": 0.5, "gamma": 1.0, "kernel": "rbf", "max_support": None, "max_iter": 1000, "lr": 0.01, "random_state": 0}

    def _fit(self, data):
        if not 0 < self.nu <= 1:
            raise ValueError("nu must be over 0 and at most 1")
        if self.kernel == "linear":
            self.support_ = _scaled(data)[0][None]
        else:
            share = max(1, int(data.n * self.nu))
            if self.max_support is not None and share > self.max_support:
                raise ValueError(f"a share of {self.nu} is {share} rows, and a kernel machine takes at most max_support = {self.max_support}: lower nu, raise max_support, or fit on a sample")
            self.support_ = data.first(share, max(0, self.random_state))
        if data.is_local:
            self.offset_ = float(data.quantiles([self.nu], lambda x, y, w: self.score_rows(x)[:, None])[0, 0])
            return
        # the search for a rank reads a column some times: scores are made once
        names = [f"x{i}" for i in range(len(data.features))]
        scores = apply(data.table, names, lambda x: {"score": self.score_rows(x)}, {"score": "double"}, len(self.support_)).select("score").persist()
        self.offset_ = float(Data(scores, ["score"]).quantiles([self.nu])[0, 0])
        scores.unpersist()

    def score_rows(self, x):
        if self.kernel == "linear":
            return -np.sqrt(((x - self.support_[0]) ** 2).sum(1))
        return against(kernel_of(self.kernel, self.gamma, 3.0, 0.0), x, self.support_, np.full(len(self.support_), 1 / len(self.support_)))

    def score_samples(self, df):
        self._check(df)
        return apply(df, self.features_, lambda x: {"score": self.score_rows(x)}, {"score": "double"}, len(self.support_))

    def decision_function(self, df):
        return self.score_samples(df).withColumn("decision", F.col("score") - self.offset_)

    def predict(self, df):
        return self.decision_function(df).withColumn("prediction", F.when(F.col("decision") >= 0, 1).otherwise(-1))


