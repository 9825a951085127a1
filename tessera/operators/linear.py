"""Linear models.

Least squares and all that follows from the Gram matrix (ridge, lasso, elastic net, greedy, Bayesian) is one pass over
the data and a solve on the driver; the cross-validated forms sum one Gram matrix a fold in that pass, and train on the
total less the fold, so no grid point scans again. Models without such sums iterate: each step is one pass that sums a
gradient or a weighted Gram matrix. Online learners average what one epoch over each block of rows gives.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import functions as F

from tessera.core import Classifier, Data, Regressor, argmax, codes, expit, linear, sigmoid, softmax
from tessera.core import moments as all_moments

FOLDS_SEED = 42


class LinearModel(Regressor):
    """coef_ and intercept_; predictions are one expression."""

    DEFAULTS = {"fit_intercept": True}

    def _predict(self, df):
        return df.withColumn("prediction", self._link(linear(self.features_, self.coef_, self.intercept_)))

    def _link(self, z):
        return z

    def predict_rows(self, x):
        return x @ self.coef_ + self.intercept_


class Gram:
    """n, means and centred products, split in features and target; without an intercept about zero."""

    def __init__(self, n: float, mean: np.ndarray, g: np.ndarray, intercept: bool, targets: int = 1):
        if not intercept:
            g, mean = g + n * np.outer(mean, mean), np.zeros_like(mean)
        p = len(mean) - targets
        self.n, self.p, self.x_mean, self.y_mean = n, p, mean[:p], mean[p:]
        self.xx, self.xy, self.yy = g[:p, :p], g[:p, p:], g[p:, p:]
        if targets == 1:
            self.y_mean, self.xy, self.yy = float(self.y_mean[0]), self.xy[:, 0], float(self.yy[0, 0])

    def intercept(self, b: np.ndarray) -> float | np.ndarray:
        return self.y_mean - self.x_mean @ b

    def rss(self, b: np.ndarray) -> float:
        return float(self.yy - 2 * b @ self.xy + b @ self.xx @ b)


def gram(data: Data, intercept: bool) -> Gram:
    return Gram(*all_moments(data), intercept, len(data.labels))


def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.linalg.lstsq(a, b, rcond=None)[0]


def ridge(g: Gram, alpha: float) -> np.ndarray:
    return solve(g.xx + alpha * np.eye(g.p), g.xy)


def descend(g: Gram, alpha: float, l1_ratio: float, max_iter: int = 1000, tol: float = 1e-4) -> np.ndarray:
    """Coordinate descent for rss/(2n) + alpha (l1_ratio |b| + (1 - l1_ratio) b2/2)."""
    b, l1, l2 = np.zeros(g.p), alpha * l1_ratio * g.n, alpha * (1 - l1_ratio) * g.n
    d = np.diag(g.xx)
    for _ in range(max_iter):
        most = 0.0
        for j in range(g.p):
            if d[j] + l2 <= 0:
                continue
            r = g.xy[j] - g.xx[j] @ b + d[j] * b[j]
            new = math.copysign(max(abs(r) - l1, 0.0), r) / (d[j] + l2)
            most, b[j] = max(most, abs(new - b[j])), new
        if most < tol * max(1e-12, np.abs(b).max(initial=0)):
            break
    return b


def pursue(g: Gram, k: int, tol: float = 0.0) -> np.ndarray:
    """Orthogonal matching pursuit on the Gram matrix: at most k features."""
    b, active = np.zeros(g.p), []
    for _ in range(min(k, g.p)):
        r = np.abs(g.xy - g.xx @ b) / np.sqrt(np.maximum(np.diag(g.xx), 1e-300))
        r[active] = -1
        j = int(r.argmax())
        if r[j] <= 1e-12 or (tol and g.rss(b) <= tol * tol):
            break
        active.append(j)
        b = np.zeros(g.p)
        b[active] = solve(g.xx[np.ix_(active, active)], g.xy[active])
    return b


class _Gram(LinearModel):
    def _solve(self, g: Gram) -> np.ndarray:
        raise NotImplementedError

    def _fit(self, data):
        g = gram(data, self.fit_intercept)
        self.coef_ = self._solve(g)
        self.intercept_ = float(g.intercept(self.coef_))


class LinearRegression(_Gram):
    def _solve(self, g):
        return solve(g.xx, g.xy)


class Ridge(_Gram):
    DEFAULTS = {"alpha": 1.0}

    def _solve(self, g):
        if self.alpha <= 0:
            raise ValueError("alpha must be positive")
        return ridge(g, self.alpha)


class ElasticNet(_Gram):
    DEFAULTS = {"alpha": 1.0, "l1_ratio": 0.5, "max_iter": 1000, "tol": 1e-8}

    def _solve(self, g):
        return descend(g, self.alpha, self.l1_ratio, self.max_iter, self.tol)


class Lasso(ElasticNet):
    DEFAULTS = {"l1_ratio": 1.0}


class LassoLars(Lasso):
    """The lasso's optimum, which its path also ends in."""


class OrthogonalMatchingPursuit(_Gram):
    DEFAULTS = {"n_nonzero_coefs": 0, "tol": 0.0}

    def _solve(self, g):
        return pursue(g, self.n_nonzero_coefs or g.p, self.tol)


class Lars(OrthogonalMatchingPursuit):
    """Greedy by correlation with the residual, refitted at each step, of which there are ``max_iter`` at most; correlations up to ``eps`` end it."""

    DEFAULTS = {"max_iter": 500, "eps": 2.220446049250313e-16}

    def _solve(self, g):
        return pursue(g, min(self.n_nonzero_coefs or g.p, self.max_iter), max(self.tol, self.eps))


class LassoLarsIC(_Gram):
    """The alpha of least AIC or BIC."""

    DEFAULTS = {"alphas": (0.1, 1.0, 10.0), "criterion": "aic", "max_iter": 1000, "tol": 1e-8}

    def _solve(self, g):
        best = None
        for a in self.alphas:
            b = descend(g, a, 1.0, self.max_iter, self.tol)
            k = 1 + np.count_nonzero(b)
            c = g.n * math.log(max(g.rss(b), 1e-300) / g.n) + (2 if self.criterion == "aic" else math.log(g.n)) * k
            if best is None or c < best[0]:
                best = c, a, b
        self.criterion_, self.alpha_ = best[0], best[1]
        return best[2]


class BayesianRidge(_Gram):
    """Noise and weight precisions by evidence maximisation on the Gram matrix."""

    DEFAULTS = {"alpha_1": 1e-6, "alpha_2": 1e-6, "lambda_1": 1e-6, "lambda_2": 1e-6, "max_iter": 300, "tol": 1e-3}

    def _solve(self, g):
        noise, weight, b = 1 / max(g.yy / g.n, 1e-12), np.ones(g.p), np.zeros(g.p)
        for _ in range(self.max_iter):
            cov = np.linalg.pinv(noise * g.xx + np.diag(weight))
            new = noise * cov @ g.xy
            gamma = 1 - weight * np.diag(cov)
            weight = self._weights(gamma, new, cov)
            noise = (g.n - gamma.sum() + 2 * self.alpha_1) / (max(g.rss(new), 1e-300) + 2 * self.alpha_2)
            done = np.abs(new - b).sum() < self.tol * max(1e-12, np.abs(new).sum())
            b = new
            if done:
                break
        self.alpha_, self.lambda_ = noise, weight
        return b

    def _weights(self, gamma, b, cov):
        return np.full(len(b), (gamma.sum() + 2 * self.lambda_1) / (b @ b + 2 * self.lambda_2))


class ARDRegression(BayesianRidge):
    """With a precision for each weight."""

    def _weights(self, gamma, b, cov):
        return np.minimum((np.maximum(gamma, 1e-12) + 2 * self.lambda_1) / (b * b + 2 * self.lambda_2), 1e12)


# -- cross-validated --------------------------------------------------------------------------------------------------
def fold_of(x: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
    """A fold for each row by a hash of its values, the same in every pass and partitioning."""
    z = np.ascontiguousarray(np.column_stack([x, y])).view(np.uint64)
    h = np.full(len(z), FOLDS_SEED, np.uint64)
    for j in range(z.shape[1]):
        h = (h ^ z[:, j]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(33)).astype(np.int64) % k


def fold_grams(data: Data, k: int, intercept: bool) -> tuple[Gram, list[tuple[Gram, Gram]]]:
    """The whole, and (train, test) of each fold, from one pass."""
    pilot = (data._read()[0] if data.is_local else np.array(list(data.table.first())[: data.width], float))[: len(data.features) + len(data.labels)]
    t = len(data.labels)

    def fn(x, y, w):
        f = fold_of(x, y, k)
        z = np.column_stack([x, y]) - pilot
        n, s, g = np.zeros(k), np.zeros((k, z.shape[1])), np.zeros((k, z.shape[1], z.shape[1]))
        for i in range(k):
            at = f == i
            n[i], s[i], g[i] = at.sum(), z[at].sum(0), z[at].T @ z[at]
        return n, s, g

    n, s, g = data.sum(fn)

    def make(n, s, g):
        m = s / max(n, 1)
        return Gram(n, pilot + m, g - n * np.outer(m, m), intercept, t)

    whole = make(n.sum(), s.sum(0), g.sum(0))
    return whole, [(make(n.sum() - n[i], s.sum(0) - s[i], g.sum(0) - g[i]), make(n[i], s[i], g[i])) for i in range(k) if 0 < n[i] < n.sum()]


def test_error(train: Gram, test: Gram, b: np.ndarray, intercept: bool) -> float:
    """Mean squared error on the test sums."""
    off = (train.intercept(b) - (test.y_mean - test.x_mean @ b)) if intercept else 0.0
    return test.rss(b) / test.n + float(np.sum(np.square(off)))


class _GramCV(LinearModel):
    DEFAULTS = {"cv": 5}

    def _grid(self, p: int) -> list:
        raise NotImplementedError

    def _at(self, g: Gram, point) -> np.ndarray:
        raise NotImplementedError

    def _fit(self, data):
        whole, folds = fold_grams(data, self.cv, self.fit_intercept)
        errors = {pt: np.mean([test_error(a, b, self._at(a, pt), self.fit_intercept) for a, b in folds]) for pt in self._grid(whole.p)}
        self.errors_, self.best_ = errors, min(errors, key=errors.get)
        self.coef_ = self._at(whole, self.best_)
        self.intercept_ = float(whole.intercept(self.coef_))


class RidgeCV(_GramCV):
    DEFAULTS = {"alphas": (0.1, 1.0, 10.0)}

    def _grid(self, p):
        return [a for a in self.alphas if a > 0]

    def _at(self, g, a):
        return ridge(g, a)


class LassoCV(_GramCV):
    DEFAULTS = {"alphas": (0.1, 1.0, 10.0), "max_iter": 1000, "tol": 1e-8}

    def _grid(self, p):
        return list(self.alphas)

    def _at(self, g, a):
        return descend(g, a, 1.0, self.max_iter, self.tol)


class LassoLarsCV(LassoCV):
    """The lasso at the cross-validated alpha."""


class ElasticNetCV(_GramCV):
    DEFAULTS = {"alphas": (0.1, 1.0, 10.0), "l1_ratios": (0.1, 0.5, 0.9), "max_iter": 1000, "tol": 1e-8}

    def _grid(self, p):
        return [(a, r) for a in self.alphas for r in self.l1_ratios]

    def _at(self, g, point):
        return descend(g, *point, self.max_iter, self.tol)


class OrthogonalMatchingPursuitCV(_GramCV):
    def _grid(self, p):
        return list(range(1, p + 1))

    def _at(self, g, k):
        return pursue(g, k)


class LarsCV(OrthogonalMatchingPursuitCV):
    """Greedy selection at the cross-validated number of features."""


# -- several targets --------------------------------------------------------------------------------------------------
def descend_rows(g: Gram, alpha: float, l1_ratio: float, max_iter: int, tol: float) -> np.ndarray:
    """Block coordinate descent: the penalty is on the length of each feature's row of coefficients."""
    b, l1, l2, d = np.zeros_like(g.xy), alpha * l1_ratio * g.n, alpha * (1 - l1_ratio) * g.n, np.diag(g.xx)
    for _ in range(max_iter):
        most = 0.0
        for j in range(g.p):
            if d[j] + l2 <= 0:
                continue
            r = g.xy[j] - g.xx[j] @ b + d[j] * b[j]
            size = np.linalg.norm(r)
            new = r * max(0.0, 1 - l1 / size) / (d[j] + l2) if size else np.zeros_like(r)
            most, b[j] = max(most, np.abs(new - b[j]).max()), new
        if most < tol * max(1e-12, np.abs(b).max(initial=0)):
            break
    return b


class MultiTaskElasticNet(Regressor):
    """Labels are a list of columns; predictions are ``prediction_<label>``."""

    DEFAULTS = {"alpha": 1.0, "l1_ratio": 0.5, "fit_intercept": True, "max_iter": 1000, "tol": 1e-8}

    def fit(self, df, features, label=None, **options):
        self.labels_ = [label] if isinstance(label, str) else list(label)
        data = Data(df, features, self.labels_, **options)
        self._set(data)
        self.features_ = list(features)
        return self

    def _set(self, data):
        g = gram_many(data, self.fit_intercept)
        self.coef_ = descend_rows(g, self.alpha, self.l1_ratio, self.max_iter, self.tol).T
        self.intercept_ = g.intercept(self.coef_.T)

    def _predict(self, df):
        for k, y in enumerate(self.labels_):
            df = df.withColumn(f"prediction_{y}", linear(self.features_, self.coef_[k], float(self.intercept_[k])))
        return df


class _Many(Gram):
    """A Gram whose targets stay a matrix, also if there is one."""

    def __init__(self, n, mean, g, intercept, targets):
        super().__init__(n, mean, g, intercept, targets)
        if targets == 1:
            self.y_mean, self.xy, self.yy = np.array([self.y_mean]), self.xy[:, None], np.array([[self.yy]])

    def rss(self, b):
        return float(np.trace(self.yy - 2 * b.T @ self.xy + b.T @ self.xx @ b))


def gram_many(data: Data, intercept: bool) -> Gram:
    return _Many(*all_moments(data), intercept, len(data.labels))


class MultiTaskLasso(MultiTaskElasticNet):
    DEFAULTS = {"l1_ratio": 1.0}


class MultiTaskElasticNetCV(MultiTaskElasticNet):
    DEFAULTS = {"alphas": (0.1, 1.0, 10.0), "l1_ratios": (0.1, 0.5, 0.9), "cv": 5}

    def _set(self, data):
        whole, folds = fold_grams(data, self.cv, self.fit_intercept)
        for g in (whole, *(x for f in folds for x in f)):
            if len(data.labels) == 1:
                g.y_mean, g.xy, g.yy = np.array([g.y_mean]), g.xy[:, None], np.array([[g.yy]])
            g.__class__ = _Many
        grid = [(a, r) for a in self.alphas for r in self.l1_ratios]
        fit = lambda g, pt: descend_rows(g, *pt, self.max_iter, self.tol)
        self.best_ = min(grid, key=lambda pt: np.mean([test_error(a, b, fit(a, pt), self.fit_intercept) for a, b in folds]))
        self.coef_ = fit(whole, self.best_).T
        self.intercept_ = whole.intercept(self.coef_.T)


class MultiTaskLassoCV(MultiTaskElasticNetCV):
    DEFAULTS = {"l1_ratios": (1.0,)}


# -- iterated ---------------------------------------------------------------------------------------------------------
def newton(data: Data, grad: Callable, p: int, penalty: np.ndarray, max_iter: int, tol: float, start: np.ndarray | None = None) -> np.ndarray:
    """Newton's method with halved steps; ``grad(theta, X1, y, w)`` gives loss, gradient and Hessian of a block."""
    theta = np.zeros(p) if start is None else start
    best = None
    for _ in range(max_iter):
        def fn(x, y, w, t=theta):
            return grad(t, np.column_stack([x, np.ones(len(x))]), y, w)

        loss, g, h = data.sum(fn)
        loss, g, h = float(loss) + 0.5 * float(penalty @ theta**2), g + penalty * theta, h + np.diag(penalty)
        if best is not None and loss > best[0] + 1e-12 * abs(best[0]):
            theta = (theta + best[1]) / 2  # back towards the last point that was better
            if np.abs(theta - best[1]).max() < tol * 1e-3:
                return best[1]
            continue
        step = np.linalg.lstsq(h + 1e-10 * np.eye(len(h)), g, rcond=None)[0]
        best = loss, theta
        theta = theta - step
        if np.abs(step).max() < tol:
            break
    return theta


def _start(data: Data, intercept: bool):
    p = len(data.features)
    return p + 1, np.r_[np.zeros(p), 0.0 if intercept else 1e12]


class LogisticRegression(Classifier):
    """Multinomial with an L2 penalty 1/C on the weights; the intercept is free. Two classes have one weight vector."""

    DEFAULTS = {"C": 1.0, "fit_intercept": True, "max_iter": 100, "tol": 1e-6, "random_state": 0}

    def _fit(self, data):
        n, mean, g = all_moments(data)
        p = len(data.features)
        m, s = mean[:p], np.sqrt(np.maximum(np.diag(g)[:p] / n, 0))
        s[s == 0] = 1.0
        classes, k = self.classes_, len(self.classes_)
        free = 1e-8 if self.fit_intercept else 1e12
        if not self.fit_intercept:
            m = np.zeros(p)
        outs = 1 if k == 2 else k
        # the penalty is on the weights of the features as they are, so in scaled units it differs by feature
        penalty = np.tile(np.r_[1 / (self.C * s * s), free], outs)

        def grad(t, x1, y, w):
            z = np.column_stack([(x1[:, :-1] - m) / s, x1[:, -1]])
            c = codes(classes, y)
            if outs == 1:
                q = expit(z @ t)
                r = np.clip(np.where(c == 1, q, 1 - q), 1e-300, 1)
                return -(w * np.log(r)).sum(), z.T @ (w * (q - c)), (z * (w * q * (1 - q))[:, None]).T @ z
            q = softmax(z @ t.reshape(k, -1).T)
            e = q - np.eye(k)[c]
            d = z.shape[1]
            h = np.zeros((k * d, k * d))
            for a in range(k):
                for b in range(a, k):
                    v = w * q[:, a] * ((a == b) - q[:, b])
                    h[a * d : a * d + d, b * d : b * d + d] = (z * v[:, None]).T @ z
                    h[b * d : b * d + d, a * d : a * d + d] = h[a * d : a * d + d, b * d : b * d + d].T
            return -(w * np.log(np.clip(q[np.arange(len(c)), c], 1e-300, 1))).sum(), ((e * w[:, None]).T @ z).ravel(), h

        t = newton(data, grad, outs * (p + 1), penalty, self.max_iter, self.tol).reshape(outs, p + 1)
        self.coef_ = t[:, :-1] / s
        self.intercept_ = t[:, -1] - self.coef_ @ m

    def proba_rows(self, x):
        z = x @ self.coef_.T + self.intercept_
        return softmax(z) if len(self.coef_) > 1 else np.column_stack([1 - expit(z[:, 0]), expit(z[:, 0])])

    def _predict(self, df):
        z = [linear(self.features_, c, float(b)) for c, b in zip(self.coef_, self.intercept_, strict=True)]
        if len(z) == 1:
            p = [1 - sigmoid(z[0]), sigmoid(z[0])]
            pred = F.when(z[0] >= 0, F.lit(int(self.classes_[1]))).otherwise(F.lit(int(self.classes_[0])))
        else:
            top = F.greatest(*z)
            e = [F.exp(x - top) for x in z]
            total = sum(e[1:], e[0])
            p, pred = [x / total for x in e], argmax(z, [int(c) for c in self.classes_])
        return df.withColumns({"prediction": pred, "probability": F.array(*p)})


class LogisticRegressionCV(LogisticRegression):
    """The C of best mean accuracy over folds by a hash of the rows."""

    DEFAULTS = {"Cs": (0.1, 1.0, 10.0), "cv": 5, "scoring": "accuracy"}

    def _fit(self, data):
        self.scores_ = {c: _fold_score(data, self.cv, self.scoring, lambda d, c=c: _inner(LogisticRegression(C=c, fit_intercept=self.fit_intercept, max_iter=self.max_iter, tol=self.tol), d, self.classes_)) for c in self.Cs}
        self.params["C"] = self.C_ = max(self.scores_, key=self.scores_.get)
        super()._fit(data)


def _inner(model: Classifier, data: Data, classes: np.ndarray) -> Classifier:
    model.classes_ = classes
    model._fit(data)
    return model


class _Fold:
    """A table without, or with only, the rows of one fold, by weights."""

    def __init__(self, data: Data, k: int, i: int):
        self.data, self.k, self.i = data, k, i
        self.features, self.labels, self.width, self.n = data.features, data.labels, data.width, data.n
        self.is_local, self.table, self._read, self.single = data.is_local, data.table, data._read, data.single

    def sum(self, fn, test: bool = False):
        k, i = self.k, self.i

        def run(x, y, w):
            at = (fold_of(x, y, k) == i) == test
            return fn(x[at], y[at], w[at])

        return self.data.sum(run)


def _fold_score(data: Data, k: int, scoring: str, make: Callable) -> float:
    """The mean over folds of the accuracy, or of minus the log loss."""
    if scoring not in ("accuracy", "neg_log_loss"):
        raise ValueError(f"no scoring {scoring}")
    out = []
    for i in range(k):
        fold = _Fold(data, k, i)
        model = make(fold)

        def hits(x, y, w, m=model):
            if not len(x):
                return 0.0, 0.0
            p = m.proba_rows(x)
            if scoring == "accuracy":
                return (m.classes_[p.argmax(1)] == y.astype(int)).sum(), float(len(x))
            return np.log(np.clip(p[np.arange(len(x)), codes(m.classes_, y)], 1e-15, 1)).sum(), float(len(x))

        h, n = fold.sum(hits, test=True)
        if n:
            out.append(float(h) / float(n))
    return float(np.mean(out))


class RidgeClassifier(Classifier):
    """Ridge on +-1 for each class; probabilities are sigmoids of the scores."""

    DEFAULTS = {"alpha": 1.0, "fit_intercept": True}

    def _fit(self, data):
        self._from(self._gram(data), self.alpha)

    def _gram(self, data):
        classes, k, p = self.classes_, len(self.classes_), len(data.features)

        def fn(x, y, w):
            t = np.where(codes(classes, y)[:, None] == np.arange(k), 1.0, -1.0)
            z = np.column_stack([x, t, np.ones(len(x))])
            return (z * w[:, None]).T @ z

        (m,) = data.sum(fn)
        n, mean = m[-1, -1], m[-1, :-1] / m[-1, -1]
        return _Many(n, mean, m[:-1, :-1] - n * np.outer(mean, mean), self.fit_intercept, k) if p else None

    def _from(self, g, alpha):
        self.coef_ = ridge(g, alpha).T
        self.intercept_ = np.asarray(g.intercept(self.coef_.T))

    def proba_rows(self, x):
        s = expit(x @ self.coef_.T + self.intercept_)
        return s / s.sum(1, keepdims=True)


class RidgeClassifierCV(RidgeClassifier):
    DEFAULTS = {"alphas": (0.1, 1.0, 10.0), "cv": 5, "scoring": "accuracy"}

    def _fit(self, data):
        self.scores_ = {a: _fold_score(data, self.cv, self.scoring, lambda d, a=a: _inner(RidgeClassifier(alpha=a, fit_intercept=self.fit_intercept), d, self.classes_)) for a in self.alphas}
        self.alpha_ = max(self.scores_, key=self.scores_.get)
        self._from(self._gram(data), self.alpha_)


class HuberRegressor(LinearModel):
    """Residuals beyond epsilon count linearly: ridge by reweighted least squares."""

    DEFAULTS = {"epsilon": 1.35, "alpha": 0.0001, "max_iter": 100, "tol": 1e-5}

    def _weights(self, r):
        return np.where(np.abs(r) <= self.epsilon, 1.0, self.epsilon / np.maximum(np.abs(r), 1e-300))

    def _fit(self, data):
        theta = np.zeros(len(data.features) + 1)
        for _ in range(self.max_iter):
            def fn(x, y, w, t=theta):
                z = np.column_stack([x, np.ones(len(x)) if self.fit_intercept else np.zeros(len(x))])
                v = w * self._weights(y - z @ t)
                return (z * v[:, None]).T @ z, z.T @ (v * y)

            a, b = data.sum(fn)
            new = solve(a + np.diag(np.r_[np.full(len(b) - 1, self.alpha), 0.0]), b)
            done = np.abs(new - theta).max() < self.tol
            theta = new
            if done:
                break
        self.coef_, self.intercept_ = theta[:-1], float(theta[-1])


class QuantileRegressor(LinearModel):
    """Pinball loss with an L2 penalty, by reweighted least squares on a smoothed loss that sharpens as it settles."""

    DEFAULTS = {"quantile": 0.5, "alpha": 0.0, "max_iter": 60, "tol": 1e-6, "learning_rate": 0.01}

    def _fit(self, data):
        n, mean, g = all_moments(data)
        theta, spread = np.r_[np.zeros(len(data.features)), mean[-1]], math.sqrt(max(g[-1, -1] / n, 1e-12))
        for step in range(self.max_iter):
            eps = spread * max(1e-6, 0.5**step)

            def fn(x, y, w, t=theta, e=eps):
                z = np.column_stack([x, np.ones(len(x)) if self.fit_intercept else np.zeros(len(x))])
                r = y - z @ t
                v = w / (2 * np.maximum(np.abs(r), e))
                return (z * v[:, None]).T @ z, z.T @ (v * y + w * (self.quantile - 0.5))

            a, b = data.sum(fn)
            new = solve(a + np.diag(np.r_[np.full(len(b) - 1, self.alpha * n), 0.0]), b)
            done = step > 20 and np.abs(new - theta).max() < self.tol * max(1.0, np.abs(new).max())
            theta = new
            if done:
                break
        self.coef_, self.intercept_ = theta[:-1], float(theta[-1])


class TweedieRegressor(LinearModel):
    """Log link, variance mu**power, penalty alpha/2 on the weights of a mean loss."""

    DEFAULTS = {"power": 1.5, "alpha": 0.0, "max_iter": 100, "tol": 1e-7, "learning_rate": 0.01}

    def _link(self, z):
        return F.exp(z)

    def predict_rows(self, x):
        return np.exp(super().predict_rows(x))

    def _fit(self, data):
        q = self.power
        if not 0 <= q <= 2:
            raise ValueError("power must be from 0 to 2")
        n, mean, g = all_moments(data)
        (low,) = data.sum(lambda x, y, w: np.array([(y < 0).sum() + (y <= 0).sum() * (q == 2)]))
        if low[0]:
            raise ValueError("y is out of the distribution's range")
        p = len(data.features)
        m, s = mean[:p], np.sqrt(np.maximum(np.diag(g)[:p] / n, 0))
        s[s == 0] = 1.0
        if not self.fit_intercept:
            m = np.zeros(p)

        def grad(t, x1, y, w):
            z = np.column_stack([(x1[:, :-1] - m) / s, x1[:, -1]])
            eta = np.clip(z @ t, -30, 30)
            mu = np.exp(eta)
            if q == 0:
                loss = (mu - y) ** 2 / 2
            elif q == 1:
                loss = mu - y * eta
            elif q == 2:
                loss = eta + y / mu
            else:
                loss = mu ** (2 - q) / (2 - q) - y * mu ** (1 - q) / (1 - q)
            d = mu ** (2 - q) - y * mu ** (1 - q)
            h = np.maximum(mu ** (2 - q), 1e-12)  # expected information
            return (w * loss).sum(), z.T @ (w * d), (z * (w * h)[:, None]).T @ z

        penalty = np.r_[self.alpha * n / (s * s), 1e-8 if self.fit_intercept else 1e12]
        start = np.r_[np.zeros(p), math.log(max(mean[-1], 1e-9)) if self.fit_intercept else 0.0]
        t = newton(data, grad, p + 1, penalty, self.max_iter, self.tol, start)
        self.coef_ = t[:-1] / s
        self.intercept_ = float(t[-1] - self.coef_ @ m)


class PoissonRegressor(TweedieRegressor):
    DEFAULTS = {"power": 1}


class GammaRegressor(TweedieRegressor):
    DEFAULTS = {"power": 2}


# -- by subsets -------------------------------------------------------------------------------------------------------
def _subsets(data: Data, k: int, m: int, seed: int, intercept: bool) -> np.ndarray:
    """Least-squares fits (coefficients, then the intercept) on k disjoint or reused subsets of m rows."""
    rows = data.first(min(data.n, k * m), seed)
    rng = np.random.default_rng(seed)
    out = []
    for i in range(k):
        at = rng.choice(len(rows), min(m, len(rows)), replace=False)
        x, y = rows[at, : len(data.features)], rows[at, len(data.features)]
        z = np.column_stack([x, np.ones(len(x)) if intercept else np.zeros(len(x))])
        out.append(solve(z, y))
    return np.array(out)


class RANSACRegressor(LinearModel):
    """The fit on a random subset that most rows agree with; all candidates are counted in one pass."""

    DEFAULTS = {"max_trials": 100, "min_samples": -1, "residual_threshold": -1.0, "random_state": 0}

    def _fit(self, data):
        m = self.min_samples if self.min_samples > 0 else len(data.features) + 1
        cand = _subsets(data, self.max_trials, m, max(0, self.random_state), self.fit_intercept)
        limit = self.residual_threshold
        if limit <= 0:
            mid = data.quantiles([0.5], lambda x, y, w: y[:, None])[0, 0]
            limit = max(1e-3, 1.4826 * float(data.quantiles([0.5], lambda x, y, w: np.abs(y - mid)[:, None])[0, 0]))

        def fn(x, y, w):
            return (np.abs(y[:, None] - np.column_stack([x, np.ones(len(x))]) @ cand.T) <= limit).sum(0)

        (hits,) = data.sum(fn)
        best = cand[int(hits.argmax())]
        self.inliers_, self.threshold_ = int(hits.max()), limit
        self.coef_, self.intercept_ = best[:-1], float(best[-1])


class TheilSenRegressor(LinearModel):
    """Medians over the fits on random subsets."""

    DEFAULTS = {"n_subsamples": 100, "random_state": 0}

    def _fit(self, data):
        cand = np.sort(_subsets(data, self.n_subsamples, len(data.features) + 1, max(0, self.random_state), self.fit_intercept), axis=0)
        mid = cand[len(cand) // 2]
        self.coef_, self.intercept_ = mid[:-1], float(mid[-1])


# -- online -----------------------------------------------------------------------------------------------------------
def averaged_epochs(data: Data, step: Callable, p: int, max_iter: int, tol: float, seed: int, block: int = 256) -> np.ndarray:
    """Epochs of updates: every block of rows goes on from the same weights, and their ends are averaged by rows.

    ``step(theta, x1, y, t)`` updates on a block of rows as a whole or row by row and returns the new weights.
    """
    theta, t = np.zeros(p + 1), 0
    for epoch in range(max_iter):
        def fn(x, y, w, theta=theta, t=t):
            # rows in a pseudo-random order of their values
            h = fold_of(x, y, 1 << 31)
            at = np.argsort((h * (2 * (seed + epoch) + 1)) & ((1 << 31) - 1), kind="stable")
            x1, own = np.column_stack([x, np.ones(len(x))])[at], theta.copy()
            for i in range(0, len(at), block):
                own = step(own, x1[i : i + block], y[at[i : i + block]], t + i)
            return own * len(x), float(len(x))

        s, n = data.sum(fn)
        new = s / float(n)
        t += data.n
        done = np.abs(new - theta).max() < tol * max(1.0, np.abs(theta).max())
        theta = new
        if done:
            break
    return theta


class _Online(LinearModel):
    DEFAULTS = {"max_iter": 20, "tol": 1e-4, "shuffle": True, "random_state": 0}

    def _fit(self, data):
        n, mean, g = all_moments(data)
        p = len(data.features)
        m, s = mean[:p], np.sqrt(np.maximum(np.diag(g)[:p] / n, 0))
        s[s == 0] = 1.0
        inner = self._step(n)

        def step(theta, x1, y, t):
            z = np.column_stack([(x1[:, :-1] - m) / s, x1[:, -1] if self.fit_intercept else np.zeros(len(x1))])
            return inner(theta, z, y, t)

        theta = averaged_epochs(data, step, p, self.max_iter, self.tol, max(0, self.random_state))
        self.coef_ = theta[:-1] / s
        self.intercept_ = float(theta[-1] - self.coef_ @ m)


class _OnlineClassifier(Classifier):
    """Two classes; probabilities are sigmoids of the score."""

    def _fit(self, data):
        if len(self.classes_) != 2:
            raise ValueError("this classifier takes two classes")
        n, mean, g = all_moments(data)
        p = len(data.features)
        m, s = mean[:p], np.sqrt(np.maximum(np.diag(g)[:p] / n, 0))
        s[s == 0] = 1.0
        inner, top = self._step(n), self.classes_[1]

        def step(theta, x1, y, t):
            z = np.column_stack([(x1[:, :-1] - m) / s, x1[:, -1] if self.fit_intercept else np.zeros(len(x1))])
            return inner(theta, z, np.where(y.astype(int) == top, 1.0, -1.0), t)

        theta = averaged_epochs(data, step, p, self.max_iter, self.tol, max(0, self.random_state))
        self.coef_ = (theta[:-1] / s)[None]
        self.intercept_ = np.array([theta[-1] - self.coef_[0] @ m])

    proba_rows = LogisticRegression.proba_rows
    _predict = LogisticRegression._predict
    DEFAULTS = {"fit_intercept": True, "max_iter": 20, "tol": 1e-4, "shuffle": True, "random_state": 0}


def _rate(kind: str, eta0: float, power: float, t: int, block: int = 256) -> float:
    if kind == "constant":
        return eta0
    if kind == "invscaling":
        return eta0 / (t / block + 1) ** power
    if kind == "optimal":
        return 1 / (1 / eta0 + t / block)
    raise ValueError(f"no learning rate {kind}")


def _shrink(theta: np.ndarray, kind: str, alpha: float, ratio: float, eta: float) -> np.ndarray:
    if kind in ("none", None):
        return theta
    l1 = {"l1": 1.0, "l2": 0.0, "elasticnet": ratio}[kind]
    w = theta[:-1] * (1 - eta * alpha * (1 - l1))
    return np.r_[np.sign(w) * np.maximum(np.abs(w) - eta * alpha * l1, 0), theta[-1]]


class SGDRegressor(_Online):
    DEFAULTS = {"loss": "squared_loss", "penalty": "l2", "alpha": 0.0001, "l1_ratio": 0.15, "learning_rate": "invscaling", "eta0": 0.1, "power_t": 0.25, "epsilon": 0.1}

    def _step(self, n):
        slopes = {"squared_loss": lambda r: r, "huber": lambda r: np.clip(r, -self.epsilon, self.epsilon), "epsilon_insensitive": lambda r: np.sign(r) * (np.abs(r) > self.epsilon)}
        if self.loss not in slopes:
            raise ValueError(f"no loss {self.loss}")

        def step(theta, z, y, t):
            eta = _rate(self.learning_rate, self.eta0, self.power_t, t)
            return _shrink(theta - eta * z.T @ slopes[self.loss](z @ theta - y) / len(z), self.penalty, self.alpha, self.l1_ratio, eta)

        return step


class SGDClassifier(_OnlineClassifier):
    DEFAULTS = {"loss": "hinge", "penalty": "l2", "alpha": 0.0001, "l1_ratio": 0.15, "learning_rate": "invscaling", "eta0": 0.1, "power_t": 0.25}

    def _step(self, n):
        slopes = {"hinge": lambda s, y: -y * (y * s < 1), "log": lambda s, y: -y * expit(-y * s), "perceptron": lambda s, y: -y * (y * s <= 0)}
        if self.loss not in slopes:
            raise ValueError(f"no loss {self.loss}")

        def step(theta, z, y, t):
            eta = _rate(self.learning_rate, self.eta0, self.power_t, t)
            return _shrink(theta - eta * z.T @ slopes[self.loss](z @ theta, y) / len(z), self.penalty, self.alpha, self.l1_ratio, eta)

        return step


class PassiveAggressiveRegressor(_Online):
    """Row by row: as far as the loss calls for, at most C."""

    DEFAULTS = {"C": 1.0, "epsilon": 0.1, "loss": "epsilon_insensitive"}

    def _step(self, n):
        def step(theta, z, y, t):
            for row, target in zip(z, y, strict=True):
                r = target - row @ theta
                loss, size = abs(r) - self.epsilon, row @ row
                if loss > 0 and size > 0:
                    tau = min(self.C, loss / size) if self.loss == "epsilon_insensitive" else loss / (size + 0.5 / self.C)
                    theta = theta + math.copysign(tau, r) * row
            return theta

        return step


class PassiveAggressiveClassifier(_OnlineClassifier):
    DEFAULTS = {"C": 1.0}

    def _step(self, n):
        def step(theta, z, y, t):
            for row, s in zip(z, y, strict=True):
                loss, size = 1 - s * (row @ theta), row @ row
                if loss > 0 and size > 0:
                    theta = theta + min(self.C, loss / size) * s * row
            return theta

        return step


class Perceptron(_OnlineClassifier):
    def _step(self, n):
        def step(theta, z, y, t):
            for row, s in zip(z, y, strict=True):
                if s * (row @ theta) <= 0:
                    theta = theta + s * row
            return theta

        return step
