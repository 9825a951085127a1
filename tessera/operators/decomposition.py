"""Decompositions, projections, cross decompositions and manifolds.

What follows from covariances is one pass and an eigen-decomposition on the driver; factorisations iterate passes of sums
over rows whose codes are recomputed in place. Manifolds compare all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np

import tessera.core as core
from tessera.core import Data, Transformer, apply, class_moments, col, linear, moments
from tessera.operators.neighbors import distances
from tessera.operators.pairs import ROWS, Far, Graph, Pairs, bottom_of, closed_classes, least_squares, nearest_place, squares, tiles, top_of
from tessera.operators.svm import kernel, kernel_of


def _sign(v: np.ndarray) -> np.ndarray:
    """Rows with their greatest coefficient positive."""
    s = np.sign(v[np.arange(len(v)), np.abs(v).argmax(1)])
    return v * np.where(s == 0, 1, s)[:, None]


def top_eigen(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    v, q = np.linalg.eigh((a + a.T) / 2)
    return np.maximum(v[::-1][:k], 0), _sign(q[:, ::-1][:, :k].T)


class _Linear(Transformer):
    """Outputs ``prefix0``, ... = (x - mean_) . components_."""

    PREFIX = "pc"
    DEFAULTS = {"n_components": -1}

    def _k(self, p: int) -> int:
        k = self.n_components if self.n_components and self.n_components > 0 else p
        if k > p:
            raise ValueError("more components than features")
        return k

    def outputs(self):
        return [f"{self.PREFIX}{i}" for i in range(len(self.components_))]

    def transform(self, df):
        self._check(df)
        new = [linear(self.features_, c, -float(c @ self.mean_)).alias(n) for n, c in zip(self.outputs(), self.components_, strict=True)]
        return df.select(*(col(c) for c in df.columns if c not in self.features_), *new)

    def inverse_transform(self, df):
        back = np.linalg.pinv(self.components_)
        new = [linear(self.outputs(), back[j], float(self.mean_[j])).alias(f) for j, f in enumerate(self.features_)]
        return df.select(*(col(c) for c in df.columns if c not in self.outputs()), *new)


class PCA(_Linear):
    """Eigenvectors of the population covariance."""

    DEFAULTS = {"whiten": False}

    def _fit(self, data):
        self._from(*moments(data))

    def _from(self, n, mean, g):
        k = self._k(len(mean))
        self.n_, self.mean_ = n, mean
        self.explained_variance_, c = top_eigen(g / n, k)
        total = np.trace(g) / n
        self.explained_variance_ratio_ = self.explained_variance_ / total if total else self.explained_variance_
        self.components_ = c / np.sqrt(np.maximum(self.explained_variance_, 1e-300))[:, None] if self.whiten else c


class IncrementalPCA(PCA):
    """Batches add their counts, means and products; the result is that of all of them together."""

    DEFAULTS = {"batch_size": 0}

    def partial_fit(self, df, features: Sequence[str]):
        n, mean, g = moments(Data(df, features))
        if self.__dict__.get("_held") is not None:
            n0, m0, g0 = self._held
            d = mean - m0
            g = g0 + g + np.outer(d, d) * n0 * n / (n0 + n)
            mean, n = m0 + d * n / (n0 + n), n0 + n
        self._held = (n, mean, g)
        self._from(n, mean, g)
        self.features_ = list(features)
        return self

    def _fit(self, data):
        self._held = moments(data)
        self._from(*self._held)


class SparsePCA(_Linear):
    """PCA components with their coefficients shrunk by alpha, as far as the greatest stays, and scaled to length 1."""

    DEFAULTS = {"alpha": 1.0, "max_iter": 1000, "tol": 1e-4}

    def _fit(self, data):
        n, self.mean_, g = moments(data)
        _, c = top_eigen(g / n, self._k(len(self.mean_)))
        s = np.sign(c) * np.maximum(np.abs(c) - self.alpha, 0)
        size = np.linalg.norm(s, axis=1, keepdims=True)
        self.components_ = np.divide(s, size, out=np.zeros_like(s), where=size > 0)


class MiniBatchSparsePCA(SparsePCA):
    """From the covariance of one pseudo-random batch, about the mean of all rows."""

    DEFAULTS = {"batch_size": 100, "random_state": 0}

    def _fit(self, data):
        _, self.mean_, _ = moments(data)
        x = data.first(min(data.n, self.batch_size), max(0, self.random_state))[:, : len(data.features)]
        z = x - x.mean(0)
        _, c = top_eigen(z.T @ z / len(z), self._k(len(self.mean_)))
        s = np.sign(c) * np.maximum(np.abs(c) - self.alpha, 0)
        size = np.linalg.norm(s, axis=1, keepdims=True)
        self.components_ = np.divide(s, size, out=np.zeros_like(s), where=size > 0)


class TruncatedSVD(_Linear):
    """Eigenvectors of the products about zero; variances are squared singular values."""

    PREFIX = "sv"
    DEFAULTS = {"n_components": 2}

    def _fit(self, data):
        n, mean, g = moments(data)
        self.explained_variance_, self.components_ = top_eigen(g + n * np.outer(mean, mean), self._k(len(mean)))
        self.singular_values_, self.mean_ = np.sqrt(self.explained_variance_), np.zeros(len(mean))


class FactorAnalysis(_Linear):
    """Loadings and noise variances by expectation-maximisation on the covariance."""

    PREFIX = "factor"
    DEFAULTS = {"tol": 1e-2, "max_iter": 1000, "random_state": 0}

    def _fit(self, data):
        n, self.mean_, g = moments(data)
        s, k = g / n, self._k(len(self.mean_))
        v, c = top_eigen(s, k)
        w, psi, before = (c * np.sqrt(np.maximum(v, 1e-12))[:, None]).T, np.maximum(np.diag(s) * 0.5, 1e-6), -math.inf
        for _ in range(self.max_iter):
            m = np.linalg.inv(np.eye(k) + (w / psi[:, None]).T @ w)
            b = m @ (w / psi[:, None]).T
            e = m + b @ s @ b.T
            w = s @ b.T @ np.linalg.inv(e)
            psi = np.maximum(np.diag(s - w @ b @ s), 1e-6)
            full = w @ w.T + np.diag(psi)
            now = -0.5 * (np.linalg.slogdet(full)[1] + np.trace(np.linalg.solve(full, s)))
            if abs(now - before) < self.tol * 1e-3:
                break
            before = now
        self.loadings_, self.noise_variance_ = w, psi
        self.components_ = np.linalg.inv(np.eye(k) + (w / psi[:, None]).T @ w) @ (w / psi[:, None]).T


class FastICA(_Linear):
    """Whitened, then one direction after another by fixed-point steps, each a pass."""

    PREFIX = "ic"
    DEFAULTS = {"algorithm": "deflation", "fun": "logcosh", "max_iter": 200, "tol": 1e-4, "random_state": 0}

    def _fit(self, data):
        kinds = {"logcosh": (np.tanh, lambda u: 1 - np.tanh(u) ** 2), "exp": (lambda u: u * np.exp(-u * u / 2), lambda u: (1 - u * u) * np.exp(-u * u / 2)), "cube": (lambda u: u**3, lambda u: 3 * u * u)}
        if self.fun not in kinds:
            raise ValueError("fun must be logcosh, exp or cube")
        g_, d_ = kinds[self.fun]
        n, self.mean_, g = moments(data)
        k = self._k(len(self.mean_))
        v, c = top_eigen(g / n, k)
        white = c / np.sqrt(np.maximum(v, 1e-12))[:, None]
        rng, w = np.random.default_rng(max(0, self.random_state)), np.zeros((k, k))
        for i in range(k):
            u = rng.standard_normal(k)
            for _ in range(self.max_iter):
                u -= w[:i].T @ (w[:i] @ u)
                u /= np.linalg.norm(u)

                def fn(x, y, wt, u=u):
                    z = (x - self.mean_) @ white.T
                    s = z @ u
                    return z.T @ g_(s), np.array([d_(s).sum()])

                a, b = data.sum(fn)
                new = a / n - float(b[0]) / n * u
                new -= w[:i].T @ (w[:i] @ new)
                new /= max(np.linalg.norm(new), 1e-300)
                done = abs(abs(new @ u) - 1) < self.tol
                u = new
                if done:
                    break
            w[i] = u
        self.components_ = _sign(w @ white)


class LDA(_Linear):
    """Fisher's discriminants: between- over within-class scatter; at most one less than the classes."""

    PREFIX = "ld"

    def _fit(self, data):
        classes = data.classes()
        n, means, g = class_moments(data, classes)
        self.mean_ = (n[:, None] * means).sum(0) / n.sum()
        d = means - self.mean_
        sb, sw = np.einsum("k,ki,kj->ij", n, d, d), g.sum(0) + 1e-9 * np.eye(g.shape[1])
        k = min(len(classes) - 1, g.shape[1])
        if self.n_components and self.n_components > 0:
            k = min(k, self.n_components)
        v, q = np.linalg.eigh(sw)
        half = q / np.sqrt(np.maximum(v, 1e-12)) @ q.T
        self.explained_, c = top_eigen(half @ sb @ half, k)
        self.components_ = _sign(c @ half)


class GaussianRandomProjection(_Linear):
    """Normal directions of variance 1 over their number."""

    PREFIX = "rp"
    DEFAULTS = {"random_state": 0}

    def _matrix(self, rng, k, p):
        return rng.standard_normal((k, p)) / math.sqrt(k)

    def _fit(self, data):
        p = len(data.features)
        k = self.n_components if self.n_components > 0 else min(data.n, p)
        self.components_, self.mean_ = self._matrix(np.random.default_rng(max(0, self.random_state)), k, p), np.zeros(p)


class SparseRandomProjection(GaussianRandomProjection):
    """Plus or minus sqrt(1 / density / k), or 0; the density is 1 / sqrt(p) by default."""

    DEFAULTS = {"density": -1.0}

    def _matrix(self, rng, k, p):
        d = self.density if self.density > 0 else 1 / math.sqrt(p)
        return np.where(rng.random((k, p)) < d, np.sign(rng.random((k, p)) - 0.5), 0.0) * math.sqrt(1 / d) / math.sqrt(k)


# -- factorisations whose codes are recomputed ------------------------------------------------------------------------
class _Codes(Transformer):
    DEFAULTS = {"n_components": 2, "max_iter": 100, "tol": 1e-4, "alpha": 0.0, "random_state": 0}
    PREFIX = "code"

    def outputs(self):
        return [f"{self.PREFIX}{i}" for i in range(len(self.components_))]

    def _codes(self, x: np.ndarray, d: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def _update(self, d, cc, cx):
        raise NotImplementedError

    def _start(self, data):
        rng = np.random.default_rng(max(0, self.random_state))
        x = data.first(min(data.n, 1000), max(0, self.random_state))[:, : len(data.features)]
        return x[rng.choice(len(x), self.n_components, replace=len(x) < self.n_components)] + 1e-3 * rng.random((self.n_components, x.shape[1]))

    def _batches(self, data):
        while True:
            yield data

    def _fit(self, data):
        self._validate(data)
        d, batches = self._start(data), self._batches(data)
        for _ in range(self.max_iter):
            def fn(x, y, w, d=d):
                c = self._codes(x, d)
                return c.T @ c, c.T @ x

            new = self._update(d, *next(batches).sum(fn))
            done = np.abs(new - d).max() < self.tol * max(1e-12, np.abs(d).max())
            d = new
            if done:
                break
        self.components_ = d
        (e,) = data.sum(lambda x, y, w: np.array([((x - self._codes(x, d) @ d) ** 2).sum()]))
        self.reconstruction_err_ = math.sqrt(float(e[0]))

    def _validate(self, data):
        pass

    def transform(self, df):
        self._check(df)
        d = self.components_
        return apply(df, self.features_, lambda x: dict(zip(self.outputs(), self._codes(x, d).T, strict=True)), dict.fromkeys(self.outputs(), "double")).drop(*self.features_)

    def inverse_transform(self, df):
        new = [linear(self.outputs(), self.components_[:, j]).alias(f) for j, f in enumerate(self.features_)]
        return df.select(*(col(c) for c in df.columns if c not in self.outputs()), *new)


class _Batch:
    """Rounds on pseudo-random batches."""

    DEFAULTS = {"batch_size": 100}

    def _batches(self, data):
        rows, at = data.first(min(data.n, self.batch_size * self.max_iter), max(0, self.random_state)), 0

        class Part:
            def __init__(self, m):
                self.m = m

            def sum(self, fn):
                return [np.asarray(v, float) for v in fn(*data.split(self.m))]

        while True:
            yield Part(rows[at : at + self.batch_size])
            at = at + self.batch_size if at + self.batch_size < len(rows) else 0


class NMF(_Codes):
    """Non-negative factors: codes by multiplicative steps from equal weights, components by one step a round."""

    DEFAULTS = {"max_iter": 200, "steps": 30}

    def _validate(self, data):
        (low,) = data.sum(lambda x, y, w: np.array([(x < 0).sum()]))
        if low[0]:
            raise ValueError("NMF needs values of at least 0")

    def _codes(self, x, d):
        c = np.full((len(x), len(d)), math.sqrt(max(x.mean(), 1e-12) / len(d)) if len(x) else 1.0)
        top, low = x @ d.T, d @ d.T
        for _ in range(self.steps):
            c *= top / (c @ low + self.alpha + 1e-12)
        return c

    def _update(self, d, cc, cx):
        for _ in range(5):
            d = d * cx / (cc @ d + self.alpha + 1e-12)
        return d


class MiniBatchNMF(_Batch, NMF):
    pass


class DictionaryLearning(_Codes):
    """Codes are shrunk products with unit atoms; atoms solve the least squares of the codes."""

    DEFAULTS = {"alpha": 1.0}

    def _start(self, data):
        d = super()._start(data)
        return d / np.maximum(np.linalg.norm(d, axis=1, keepdims=True), 1e-12)

    def _codes(self, x, d):
        z = x @ d.T
        return np.sign(z) * np.maximum(np.abs(z) - self.alpha, 0)

    def _update(self, d, cc, cx):
        new = np.linalg.lstsq(cc + 1e-9 * np.eye(len(cc)), cx, rcond=None)[0]
        size = np.linalg.norm(new, axis=1, keepdims=True)
        return np.where(size > 1e-12, new / np.maximum(size, 1e-12), d)


class MiniBatchDictionaryLearning(_Batch, DictionaryLearning):
    pass


class LatentDirichletAllocation(_Codes):
    """Topics of count rows by variational expectation-maximisation; codes are topic shares."""

    PREFIX = "topic"
    DEFAULTS = {"n_components": 10, "max_iter": 10, "doc_topic_prior": 0.1, "topic_word_prior": 0.01, "steps": 20}

    def _validate(self, data):
        NMF._validate(self, data)

    def _start(self, data):
        d = np.random.default_rng(max(0, self.random_state)).gamma(100, 0.01, (self.n_components, len(data.features)))
        return d / d.sum(1, keepdims=True)

    def _shares(self, x, d):
        t = np.full((len(x), len(d)), 1 / len(d))
        for _ in range(self.steps):
            t = self.doc_topic_prior + t * ((x / np.maximum(t @ d, 1e-300)) @ d.T)
            t /= t.sum(1, keepdims=True)
        return t

    _codes = _shares

    def _fit(self, data):
        self._validate(data)
        d = self._start(data)
        for _ in range(self.max_iter):
            def fn(x, y, w, d=d):
                t = self._shares(x, d)
                return d * (t.T @ (x / np.maximum(t @ d, 1e-300)))

            (s,) = data.sum(fn)
            d = s + self.topic_word_prior
            d /= d.sum(1, keepdims=True)
        self.components_ = d


# -- two views --------------------------------------------------------------------------------------------------------
class _TwoViews(Transformer):
    """``fit(df, features, targets)``: scores ``x_score0``, ... and ``y_score0``, ..."""

    DEFAULTS = {"n_components": 2, "scale": True, "max_iter": 500, "tol": 1e-6}

    def fit(self, df, features, label=None, **options):
        self.targets_ = [label] if isinstance(label, str) else list(label)
        data = Data(df, features, self.targets_)
        n, mean, g = moments(data)
        p = len(features)
        if not 0 < self.n_components <= min(p, len(self.targets_), int(n) - 1):
            raise ValueError("n_components must be from 1 to the least number of columns of either side")
        s = np.sqrt(np.maximum(np.diag(g) / (n - 1), 0)) if self.scale else np.ones(len(mean))
        s[s == 0] = 1.0
        self.x_mean_, self.y_mean_, self.x_scale_, self.y_scale_ = mean[:p], mean[p:], s[:p], s[p:]
        c = g / np.outer(s, s) / (n - 1)
        self._solve(c[:p, :p], c[:p, p:], c[p:, p:])
        self.features_ = list(features)
        return self

    def transform(self, df):
        self._check(df)
        new = []
        for side, names, mean, scale, r in (("x", self.features_, self.x_mean_, self.x_scale_, self.x_rotations_), ("y", self.targets_, self.y_mean_, self.y_scale_, self.y_rotations_)):
            if all(c in df.columns for c in names):
                w = r / scale[:, None]
                new += [linear(names, w[:, k], -float(w[:, k] @ mean)).alias(f"{side}_score{k}") for k in range(w.shape[1])]
        return df.select("*", *new)


    def transform_y(self, df):
        """``df`` with the targets' scores alone."""
        self._check_targets(df)
        out = self.transform(df.select("*", *(F.lit(0.0).alias(f) for f in self.features_ if f not in df.columns)))
        return out.select(*df.columns, *(f"y_score{k}" for k in range(self.y_rotations_.shape[1])))

    def _check_targets(self, df):
        absent = [t for t in self.targets_ if t not in df.columns]
        if absent:
            raise ValueError(f"fitted targets are absent: {absent}")

    def inverse_transform(self, df):
        """The features that the scores ``x_score0``, ... stand for: by loadings, or the least squares of the rotations without."""
        load = self.x_loadings_.T if "x_loadings_" in self.__dict__ else np.linalg.pinv(self.x_rotations_)
        scores = [f"x_score{k}" for k in range(load.shape[0])]
        return df.select(*(c for c in df.columns if c not in self.features_), *(linear(scores, load[:, j] * self.x_scale_[j], float(self.x_mean_[j])).alias(f) for j, f in enumerate(self.features_)))


class PLSSVD(_TwoViews):
    """Singular vectors of the cross covariance."""

    def _solve(self, xx, xy, yy):
        u, s, v = np.linalg.svd(xy, full_matrices=False)
        k = self.n_components
        sign = np.sign(u[np.abs(u).argmax(0), np.arange(u.shape[1])])
        self.x_rotations_, self.y_rotations_, self.singular_values_ = (u * sign)[:, :k], (v.T * sign)[:, :k], s[:k]


class PLSCanonical(_TwoViews):
    """Pairs of directions of greatest covariance, each side deflated by its own scores."""

    SYMMETRIC = True

    def _solve(self, xx, xy, yy):
        p, q = xy.shape
        ax, ay, cxx, cxy, cyy = np.eye(p), np.eye(q), xx.copy(), xy.copy(), yy.copy()
        ws, cs, ps, qs, rx, ry = [], [], [], [], [], []
        for _ in range(self.n_components):
            u, s, v = np.linalg.svd(cxy, full_matrices=False)
            w, c = u[:, 0], v[0]
            sign = np.sign(w[np.abs(w).argmax()]) or 1.0
            w, c = w * sign, c * sign
            tt = max(w @ cxx @ w, 1e-300)
            load = cxx @ w / tt
            if self.SYMMETRIC:
                uu = max(c @ cyy @ c, 1e-300)
                yload = cyy @ c / uu
            else:
                yload = cxy.T @ w / tt
            rx.append(ax @ w)
            ry.append(ay @ c)
            for held, v_ in ((ws, w), (cs, c), (ps, load), (qs, yload)):
                held.append(v_)
            dx = np.eye(p) - np.outer(w, load)
            dy = np.eye(q) - np.outer(c, yload) if self.SYMMETRIC else np.eye(q)
            if self.SYMMETRIC:
                cxy, cyy = dx.T @ cxy @ dy, dy.T @ cyy @ dy
            else:
                cxy = dx.T @ cxy
            cxx, ax, ay = dx.T @ cxx @ dx, ax @ dx, ay @ dy
        self.x_weights_, self.y_weights_, self.x_loadings_, self.y_loadings_ = (np.array(v).T for v in (ws, cs, ps, qs))
        self.x_rotations_, self.y_rotations_ = np.array(rx).T, np.array(ry).T
        b = self.x_rotations_ @ self.y_loadings_.T
        self.coef_ = (b / self.x_scale_[:, None] * self.y_scale_).T
        self.intercept_ = self.y_mean_ - self.coef_ @ self.x_mean_


class PLSRegression(PLSCanonical):
    """Both sides deflated by the features' scores; ``predict`` adds ``prediction_<target>``."""

    SYMMETRIC = False

    def predict(self, df):
        self._check(df)
        for k, t in enumerate(self.targets_):
            df = df.withColumn(f"prediction_{t}", linear(self.features_, self.coef_[k], float(self.intercept_[k])))
        return df


class CCA(_TwoViews):
    """Directions of greatest correlation."""

    def _solve(self, xx, xy, yy):
        def half(m):
            v, q = np.linalg.eigh(m + 1e-10 * np.eye(len(m)))
            return q / np.sqrt(np.maximum(v, 1e-12)) @ q.T

        hx, hy = half(xx), half(yy)
        u, s, v = np.linalg.svd(hx @ xy @ hy, full_matrices=False)
        k = self.n_components
        a, b = hx @ u[:, :k], hy @ v.T[:, :k]
        sign = np.sign(a[np.abs(a).argmax(0), np.arange(k)])
        self.x_rotations_, self.y_rotations_, self.correlations_ = a * sign, b * sign, np.minimum(s[:k], 1.0)


# -- all pairs of rows --------------------------------------------------------------------------------------------------
class KernelPCA(Transformer):
    """Rows meet the fitted ones by the kernel, centred."""

    DEFAULTS = {"n_components": -1, "kernel": "rbf", "gamma": 1.0, "degree": 3, "coef0": 1}

    def _fit(self, data):
        x, _, _ = data.local(data.n)
        if len(x) > core.PAIR_ROWS and self.n_components > 0:
            return self._fit_many(data, x)
        k = kernel(self.kernel, x, x, self.gamma, self.degree, self.coef0)
        self.rows_, self.column_means_, self.total_ = x, k.mean(0), k.mean()
        v, q = np.linalg.eigh(k - k.mean(0) - k.mean(1)[:, None] + k.mean())
        v, q = v[::-1], q[:, ::-1]
        keep = np.flatnonzero(v > 1e-8)[: self.n_components if self.n_components > 0 else None]
        self.eigenvalues_, a = v[keep], _sign(q[:, keep].T).T
        self.alphas_ = a / np.sqrt(v[keep])

    def _fit_many(self, data, x):
        n, far, tile = len(x), Pairs(data.table.sparkSession, x), kernel_of(self.kernel, self.gamma, self.degree, self.coef0)
        self.rows_, self.column_means_ = x, far.product(tile, np.full((n, 1), 1 / n))[:, 0]
        self.total_ = self.column_means_.mean()

        def centred(v):
            v = far.product(tile, v - v.mean(0))
            return v - v.mean(0)

        v, q = top_of(centred, n, min(self.n_components, n - 1))
        far.close()
        keep = np.flatnonzero(v > 1e-8)
        self.eigenvalues_ = v[keep]
        self.alphas_ = _sign(q[:, keep].T).T / np.sqrt(v[keep])

    def outputs(self):
        return [f"kpc{i}" for i in range(self.alphas_.shape[1])]

    def transform(self, df):
        self._check(df)

        def fn(x):
            z = np.zeros((len(x), self.alphas_.shape[1]))
            for t in tiles(len(x), ROWS):
                k = kernel(self.kernel, x[t], self.rows_, self.gamma, self.degree, self.coef0)
                z[t] = (k - k.mean(1)[:, None] - self.column_means_ + self.total_) @ self.alphas_
            return dict(zip(self.outputs(), z.T, strict=True))

        return apply(df, self.features_, fn, dict.fromkeys(self.outputs(), "double"), len(self.rows_)).drop(*self.features_)


class _Embedding(Transformer):
    """An embedding of the fitted rows; ``transform`` gives a row that of the nearest fitted one."""

    DEFAULTS = {"n_components": 2}
    #: Whether ``_embed`` takes any number of rows.
    ALL_ROWS = False

    def _fit(self, data):
        x, _, _ = data.local(data.n) if self.ALL_ROWS else data.local()
        if not 0 < self.n_components < len(x):
            raise ValueError("n_components must be under the number of rows")
        self.rows_, self.embedding_ = x, self._embed(x, data.table.sparkSession)

    def outputs(self):
        return [f"embed{i}" for i in range(self.n_components)]

    def transform(self, df):
        self._check(df)
        rows, e = self.rows_, self.embedding_

        def fn(x):
            return dict(zip(self.outputs(), e[nearest_place(x, rows)].T, strict=True))

        return apply(df, self.features_, fn, dict.fromkeys(self.outputs(), "double"), len(rows)).drop(*self.features_)


def classical_scaling(d: np.ndarray, k: int) -> np.ndarray:
    c = np.eye(len(d)) - 1 / len(d)
    v, q = top_eigen(-0.5 * c @ (d * d) @ c, k)
    return q.T * np.sqrt(v)


class MDS(_Embedding):
    """Classical scaling of Euclidean distances: with many rows by the covariances, whose axes give the same places."""

    ALL_ROWS = True

    def _embed(self, x, spark=None):
        if len(x) <= core.PAIR_ROWS:
            return classical_scaling(distances(x, x), self.n_components)
        z = x - x.mean(0)
        v, q = top_eigen(z.T @ z, min(self.n_components, z.shape[1]))
        out = np.zeros((len(x), self.n_components))
        out[:, : len(v)] = _sign((z @ q.T).T).T
        return out


def neighbour_graph(d: np.ndarray, k: int) -> np.ndarray:
    """Which rows are among each other's k nearest, either way."""
    near = np.argsort(d + np.where(np.eye(len(d), dtype=bool), np.inf, 0), axis=1, kind="stable")[:, :k]
    out = np.zeros(d.shape, bool)
    out[np.arange(len(d))[:, None], near] = True
    return out | out.T


class Isomap(_Embedding):
    """Distances along the neighbour graph; parts that aren't connected are ten times the greatest apart."""

    ALL_ROWS = True

    DEFAULTS = {"n_neighbors": 5}

    def _embed(self, x, spark=None):
        if len(x) > core.PAIR_ROWS:
            return self._many(x, spark)
        d = distances(x, x)
        g = np.where(neighbour_graph(d, self.n_neighbors), d, np.inf)
        np.fill_diagonal(g, 0)
        for k in range(len(g)):
            g = np.minimum(g, g[:, [k]] + g[[k]])
        g[~np.isfinite(g)] = 10 * g[np.isfinite(g)].max()
        return classical_scaling(g, self.n_components)

    def _many(self, x, spark):
        near = Pairs(spark, x)
        dist, at = near.nearest(self.n_neighbors)
        near.close()
        far = Far(spark, Graph(len(x), at, dist))

        def times(v):
            v = -0.5 * far.product(v - v.mean(0))
            return v - v.mean(0)

        v, q = top_of(times, len(x), self.n_components, more=40)
        far.close()
        return _sign(q.T).T * np.sqrt(np.maximum(v, 0))


class LocallyLinearEmbedding(_Embedding):
    """Rows as weighted sums of their neighbours, in few dimensions."""

    ALL_ROWS = True

    DEFAULTS = {"n_neighbors": 5}

    def _embed(self, x, spark=None):
        n, k = len(x), self.n_neighbors
        if n > core.PAIR_ROWS:
            return self._many(x, spark)
        d = distances(x, x) + np.where(np.eye(n, dtype=bool), np.inf, 0)
        m = np.eye(n)
        for i in range(n):
            near = np.argsort(d[i], kind="stable")[:k]
            z = x[near] - x[i]
            c = z @ z.T
            w = np.linalg.solve(c + np.eye(k) * (1e-3 * np.trace(c) or 1e-3), np.ones(k))
            m[i, near] -= w / w.sum()
        _, q = np.linalg.eigh(m.T @ m)
        return _sign(q[:, 1 : self.n_components + 1].T).T

    def _many(self, x, spark):
        n, far = len(x), Pairs(spark, x)
        at = far.nearest(self.n_neighbors)[1]
        far.close()
        w = np.empty(at.shape)
        for t in tiles(n, ROWS):
            z = x[at[t]] - x[t][:, None]
            c = z @ z.transpose(0, 2, 1)
            trace = 1e-3 * np.einsum("nii->n", c)
            c = c + np.eye(at.shape[1]) * np.where(trace == 0, 1e-3, trace)[:, None, None]
            w[t] = np.linalg.solve(c, np.ones((len(z), at.shape[1], 1)))[..., 0]
        w /= w.sum(1, keepdims=True)
        order = np.argsort(at.ravel(), kind="stable")
        back, of = order // at.shape[1], np.unique(at.ravel()[order], return_index=True)
        weight = w.ravel()[order][:, None]

        def left(v):
            out = v.copy()
            for j in range(at.shape[1]):
                out -= w[:, j, None] * v[at[:, j]]
            return out

        def returned(r):
            out = r.copy()
            out[of[0]] -= np.add.reduceat(r[back] * weight, of[1], axis=0)
            return out

        closed = closed_classes(at, w)
        if len(closed) > self.n_components:
            # each closed class has a vector of the eigenvalue 0: 1 on it, 0 on the others, and weighted sums on the rest
            inner = np.concatenate(closed)
            fixed, rest = np.zeros((n, self.n_components)), np.ones((n, 1))
            for j, c in enumerate(closed[: self.n_components]):
                fixed[c, j] = 1
            rest[inner] = 0
            diagonal = 1 + np.bincount(at.ravel(), (w * w * rest).ravel(), n)
            v = fixed + rest * least_squares(lambda v: rest * left(rest * v), lambda r: rest * returned(rest * r), diagonal, rest * -left(fixed))
            return _sign(np.linalg.qr(np.column_stack([np.ones(n), v]))[0][:, 1:].T).T

        def times(v):
            return returned(left(v))

        norm = float((1 + np.abs(w).sum(1)).max() * (1 + np.bincount(at.ravel(), np.abs(w).ravel(), n).max()))
        return _sign(bottom_of(times, n, self.n_components + 1, norm)[:, 1:].T).T


class SpectralEmbedding(_Embedding):
    ALL_ROWS = True

    DEFAULTS = {"n_neighbors": 5}

    def _embed(self, x, spark=None):
        if len(x) > core.PAIR_ROWS:
            far = Pairs(spark, x)
            dist, at = far.nearest(self.n_neighbors)
            far.close()
            g = Graph(len(x), at, np.exp(-dist * dist))
            s = 1 / np.sqrt(np.maximum(g.times(np.ones((len(x), 1))), 1e-12))
            q = bottom_of(lambda v: v - g.times(v * s) * s, len(x), self.n_components + 1, 2.0)
            return _sign((q[:, 1:] * s).T).T
        d = distances(x, x)
        w = np.where(neighbour_graph(d, self.n_neighbors), np.exp(-d * d), 0)
        np.fill_diagonal(w, 0)
        s = 1 / np.sqrt(np.maximum(w.sum(1), 1e-12))
        _, q = np.linalg.eigh(np.eye(len(x)) - w * s[:, None] * s)
        return _sign((q[:, 1 : self.n_components + 1] * s[:, None]).T).T


class TSNE(_Embedding):
    """Neighbour probabilities of a perplexity, matched by Student's in few dimensions by gradient steps with momentum."""

    DEFAULTS = {"perplexity": 30.0, "early_exaggeration": 12.0, "learning_rate": 200.0, "max_iter": 500, "random_state": 0}

    ALL_ROWS = True

    def _embed(self, x, spark=None):
        n = len(x)
        if n > core.PAIR_ROWS:
            far = Pairs(spark, x - x.mean(0))
            y = self._many(far)
            far.close()
            return y
        d2, p = distances(x, x) ** 2, np.zeros((n, n))
        goal = math.log(min(self.perplexity, (n - 1) / 3))
        for i in range(n):
            lo, hi, b = 0.0, math.inf, 1.0
            row = np.delete(d2[i], i)
            for _ in range(60):
                e = np.exp(-b * (row - row.min()))
                q = e / e.sum()
                h = -(q * np.log(np.maximum(q, 1e-300))).sum()
                if abs(h - goal) < 1e-5:
                    break
                lo, hi = (b, hi) if h > goal else (lo, b)
                b = b * 2 if hi == math.inf else (lo + hi) / 2
            p[i, np.arange(n) != i] = q
        p = np.maximum((p + p.T) / (2 * n), 1e-12)
        y = np.random.default_rng(max(0, self.random_state)).standard_normal((n, self.n_components)) * 1e-4
        v, gain = np.zeros_like(y), np.ones_like(y)
        for it in range(self.max_iter):
            t = 1 / (1 + distances(y, y) ** 2)
            np.fill_diagonal(t, 0)
            q = np.maximum(t / t.sum(), 1e-12)
            f = (p * self.early_exaggeration if it < self.max_iter // 4 else p) - q
            g = 4 * ((f * t).sum(1)[:, None] * y - (f * t) @ y)
            gain = np.where(np.sign(g) != np.sign(v), gain + 0.2, np.maximum(gain * 0.8, 0.01))
            v = (0.5 if it < self.max_iter // 4 else 0.8) * v - min(self.learning_rate, n) * gain * g
            y = y + v
            y -= y.mean(0)
        self.kl_divergence_ = float((p * np.log(p / q)).sum())
        return y

    def _many(self, far):
        """The same steps; each row's precision is kept, and a pass makes the probabilities of its pairs anew."""
        n, c, goal = far.n, self.n_components, math.log(min(self.perplexity, (far.n - 1) / 3))

        def precision(at, x, state):
            d = np.concatenate([squares(x[at], x[t]) for t in tiles(n)], 1)
            d = d[np.arange(n) != np.arange(at.start, at.stop)[:, None]].reshape(-1, n - 1)
            least = d.min(1)
            d -= least[:, None]
            lo, hi, b, z = np.zeros(len(d)), np.full(len(d), np.inf), np.ones(len(d)), np.empty(len(d))
            left = np.arange(len(d))
            for _ in range(60):
                near = d[left]
                e = np.exp(-b[left, None] * near)
                z[left] = e.sum(1)
                h = np.log(z[left]) + b[left] * np.einsum("ij,ij->i", e, near) / z[left]
                open_ = np.abs(h - goal) >= 1e-5
                left, up = left[open_], h[open_] > goal
                if not len(left):
                    break
                lo[left], hi[left] = np.where(up, b[left], lo[left]), np.where(up, hi[left], b[left])
                b[left] = np.where(np.isinf(hi[left]), b[left] * 2, (lo[left] + hi[left]) / 2)
            if len(left):  # the probabilities are those of the last precision that was tried
                b[left] = np.where(np.isinf(hi[left]), b[left] / 2, np.where(up, lo[left], hi[left]))
            return np.column_stack([b, least, z])

        b, least, z = far.map(precision, rows=max(1, min(ROWS, 2_000_000 // n))).T
        high = b * least - np.log(2 * n * z)

        def met(at, x, y, b, high):
            """For tiles of a block's rows: their place, probabilities p, Student's t, and differences in y."""
            for t in tiles(n, 512):
                d = squares(x[at], x[t])
                p, s = d * -b[at, None], np.ones_like(d)
                p += high[at, None]
                np.exp(p, out=p)
                d *= -b[t]
                d += high[t]
                p += np.exp(d, out=d)
                np.maximum(p, 1e-12, out=p)
                for k in range(c):
                    np.subtract(y[at, k, None], y[t, k], out=d)
                    d *= d
                    s += d
                np.divide(1, s, out=s)
                own = np.arange(max(at.start, t.start), min(at.stop, t.stop))
                p[own - at.start, own - t.start], s[own - at.start, own - t.start] = 1e-12, 0
                yield t, p, s

        def pulls(at, x, state):
            """Sums of p t and q t, alone and times y, then of t, and the least t; q is not divided by its sum unless that is given."""
            *state, total = state
            y, out = state[0], np.zeros((at.stop - at.start, 2 * c + 4))
            out[:, -1] = np.inf
            for t, p, s in met(at, x, *state):
                out[:, -2] += s.sum(1)
                out[:, -1] = np.minimum(out[:, -1], np.where(s == 0, np.inf, s).min(1))
                p *= s
                q = s * (np.maximum(s / total, 1e-12) if total > 0 else s)
                for i, f in enumerate((p, q)):
                    out[:, i * (c + 1)] += f.sum(1)
                    out[:, i * (c + 1) + 1 : (i + 1) * (c + 1)] += f @ y[t]
            return out

        def gap(at, x, state):
            *state, total = state
            return sum((p * np.log(p / np.maximum(s / total, 1e-12))).sum(1) for _, p, s in met(at, x, *state))[:, None]

        y = np.random.default_rng(max(0, self.random_state)).standard_normal((n, c)) * 1e-4
        v, gain = np.zeros_like(y), np.ones_like(y)
        for it in range(self.max_iter):
            at = y
            got = far.map(pulls, y, b, high, np.array(0.0))
            total, by = float(got[:, -2].sum()), 1.0
            if got[:, -1].min() < 1e-12 * total:  # the least probabilities are raised
                got = far.map(pulls, y, b, high, np.array(total))
            else:
                by = 1 / total
            f = got[:, : c + 1] * (self.early_exaggeration if it < self.max_iter // 4 else 1.0) - got[:, c + 1 : 2 * c + 2] * by
            g = 4 * (f[:, :1] * y - f[:, 1:])
            gain = np.where(np.sign(g) != np.sign(v), gain + 0.2, np.maximum(gain * 0.8, 0.01))
            v = (0.5 if it < self.max_iter // 4 else 0.8) * v - min(self.learning_rate, n) * gain * g
            y = y + v
            y -= y.mean(0)
        self.kl_divergence_ = float(far.map(gap, at, b, high, np.array(total)).sum())
        return y
