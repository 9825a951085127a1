"""Trees, forests and boosting from histograms.

Features are cut at observed values, all of them up to ``max_bins`` and quantiles beyond. A level of all trees that grow
together is one pass: each block of rows is sent down the trees grown so far and adds its statistics by (tree, node,
feature, bin); the sums decide the splits. So the passes follow the depth and not the number of nodes or rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import functions as F

from tessera.core import Classifier, Data, Regressor, Transformer, apply, codes, expit, softmax
from tessera.operators.linear import fold_of

MAX_BINS = 256
DEPTH_LIMIT = 30


@dataclass
class Tree:
    """Nodes in arrays; a leaf's feature is -1. Rows with x <= threshold go left."""

    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    stats: list[np.ndarray] = field(default_factory=list)
    value: np.ndarray | None = None

    def add(self, stats: np.ndarray) -> int:
        for x, v in ((self.feature, -1), (self.threshold, 0.0), (self.left, -1), (self.right, -1), (self.stats, stats)):
            x.append(v)
        return len(self.feature) - 1

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        at = np.zeros(len(x), np.int64)
        f, t, a, b = (np.array(v) for v in (self.feature, self.threshold, self.left, self.right))
        live = np.flatnonzero(f[at] >= 0)
        while len(live):
            n = at[live]
            at[live] = np.where(x[live, f[n]] <= t[n], a[n], b[n])
            live = live[f[at[live]] >= 0]
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.value[self.leaf(x)]


def edges_of(data: Data, max_bins: int = MAX_BINS) -> list[np.ndarray]:
    """For each feature the values at which it may be cut; the greatest is none.

    All its values if there are at most ``max_bins``, else those at the ranks that part the rows into as many equal parts.
    """
    names = [f"x{j}" for j in range(len(data.features))]
    values: list[np.ndarray | None] = []
    if data.is_local:
        for j in range(len(names)):
            v = np.unique(data._read()[:, j])
            values.append(v if len(v) <= max_bins else None)
    else:
        about = data.table.agg(*(F.approx_count_distinct(c) for c in names)).first()
        for c, n in zip(names, about, strict=True):
            found = data.table.select(c).distinct().limit(max_bins + 1).collect() if n <= 2 * max_bins else []
            values.append(np.array(sorted(r[0] for r in found)) if 0 < len(found) <= max_bins else None)
    many = [j for j, v in enumerate(values) if v is None]
    if many:
        ranks = np.floor(np.linspace(0, 1, max_bins + 1)[1:-1] * (data.n - 1)).astype(np.int64)
        cut = data.ranked(ranks, lambda x, y, w: x[:, many])
    return [v[:-1] if v is not None else np.unique(cut[many.index(j)]) for j, v in enumerate(values)]


def uniform(x: np.ndarray, y: np.ndarray | None, salt: int) -> np.ndarray:
    """A number in (0, 1) for each row by a hash of its values."""
    k = (1 << 31) - 1
    h = fold_of(np.column_stack([x, np.full(len(x), float(salt))]), np.zeros(len(x)) if y is None else y, k)
    return (h + 0.5) / k


def poisson(u: np.ndarray) -> np.ndarray:
    """Poisson(1) counts from uniform numbers: a bootstrap that needs no row numbers."""
    steps = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(12)])
    return np.searchsorted(steps, u).astype(float)


@dataclass
class Growth:
    """How trees grow. ``cost``: of statistics (..., s), of which the first is the weight of rows; a split is worth what it saves."""

    cost: Callable[[np.ndarray], np.ndarray]
    max_depth: int = -1
    min_split: float = 2
    min_leaf: float = 1
    min_gain: float = 1e-12
    features: int = 0  # tried at a node, 0: all
    random_cut: bool = False
    oblivious: bool = False
    child: Callable[[np.ndarray], np.ndarray] | None = None  # which children are allowed
    seed: int = 0


def grow(data: Data, edges: list[np.ndarray], stat: Callable, how: Growth, trees: int = 1, allowed: list[np.ndarray] | None = None) -> list[Tree]:
    """``stat(x, y, w, t)`` gives the statistics of rows (rows x s) for tree t."""
    p, bins = len(edges), max(len(e) for e in edges) + 1
    rng = np.random.default_rng(how.seed)
    (total,) = data.sum(lambda x, y, w: np.stack([stat(x, y, w, t).sum(0) for t in range(trees)]))
    out = [Tree() for _ in range(trees)]
    live = []
    for t in range(trees):
        out[t].add(total[t])
        live.append([0])
    depth, limit = 0, DEPTH_LIMIT if how.max_depth < 0 else how.max_depth
    while any(live) and depth < limit:
        where = []
        for t in range(trees):
            m = np.full(len(out[t].feature), -1)
            m[live[t]] = np.arange(len(live[t]))
            where.append(m)
        start = np.concatenate([[0], np.cumsum([len(v) for v in live])]).astype(int)
        s = total.shape[1]

        def fn(x, y, w, where=where, start=start):
            b = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
            h = np.zeros((start[-1] * p * bins, s))
            for t in range(trees):
                if start[t] == start[t + 1]:
                    continue
                node = where[t][out[t].leaf(x)]
                at = np.flatnonzero(node >= 0)
                if not len(at):
                    continue
                v = stat(x, y, w, t)[at]
                flat = ((start[t] + node[at])[:, None] * p + np.arange(p)) * bins + b[at]
                for k in range(s):
                    h[:, k] += np.bincount(flat.ravel(), np.repeat(v[:, k], p), len(h))
            return h

        (h,) = data.sum(fn)
        h = h.reshape(start[-1], p, bins, s)
        for t in range(trees):
            mine = h[start[t] : start[t + 1]]
            nodes, live[t] = live[t], []
            if not nodes:
                continue
            picks = _oblivious(mine, out[t], nodes, edges, how) if how.oblivious else [_best(mine[i], edges, how, rng, allowed[t] if allowed else None) for i in range(len(nodes))]
            for i, node in enumerate(nodes):
                if picks[i] is None:
                    continue
                j, cut = picks[i]
                lo = mine[i, j, : cut + 1].sum(0)
                hi = mine[i, j].sum(0) - lo
                if how.oblivious and (lo[0] <= 0 or hi[0] <= 0):
                    lo, hi = (out[t].stats[node], hi * 0 + 1e-12) if hi[0] <= 0 else (lo * 0 + 1e-12, out[t].stats[node])
                a, b = out[t].add(lo), out[t].add(hi)
                out[t].feature[node], out[t].threshold[node], out[t].left[node], out[t].right[node] = j, float(edges[j][cut]), a, b
                live[t] += [c for c in (a, b) if out[t].stats[c][0] >= how.min_split and how.cost(out[t].stats[c][None])[0] > -np.inf]
        depth += 1
    return out


def _gains(h: np.ndarray, how: Growth) -> np.ndarray:
    """features x cuts: what each cut saves, -inf where it isn't allowed."""
    lo = np.cumsum(h, axis=1)
    whole = lo[:, -1:]
    hi = whole - lo
    ok = (lo[..., 0] >= how.min_leaf) & (hi[..., 0] >= how.min_leaf)
    if how.child is not None:
        ok &= how.child(lo) & how.child(hi)
    gain = how.cost(whole) - how.cost(lo) - how.cost(hi)
    return np.where(ok, gain, -np.inf)[:, :-1]


def _best(h: np.ndarray, edges: list[np.ndarray], how: Growth, rng: np.random.Generator, allowed: np.ndarray | None) -> tuple[int, int] | None:
    names = np.arange(len(edges)) if allowed is None else allowed
    if how.random_cut:
        for j in rng.permutation(names):
            full = np.flatnonzero(h[j, :, 0] > 0)
            cuts = [c for c in range(full[0], full[-1])] if len(full) > 1 else []
            cuts = [c for c in cuts if h[j, : c + 1, 0].sum() >= how.min_leaf and h[j, c + 1 :, 0].sum() >= how.min_leaf]
            if cuts and how.cost(h[j].sum(0)[None])[0] > how.min_gain:
                # uniform between the node's least and greatest value, then down to a cut
                lo, hi = edges[j][cuts[0]], edges[j][min(cuts[-1], len(edges[j]) - 1)]
                c = int(np.searchsorted(edges[j], rng.uniform(lo, hi), "right")) - 1
                return int(j), min(max(c, cuts[0]), cuts[-1])
        return None
    if how.features and how.features < len(names):
        names = np.sort(rng.choice(names, how.features, replace=False))
    gain = _gains(h[names], how)
    if not gain.size:
        return None
    k = int(np.argmax(gain))  # the first of equal ones: lowest feature, then lowest value
    j, c = divmod(k, gain.shape[1])
    return (int(names[j]), c) if gain[j, c] > how.min_gain and c < len(edges[names[j]]) else None


def _oblivious(h: np.ndarray, tree: Tree, nodes: list[int], edges: list[np.ndarray], how: Growth) -> list:
    """One cut for all nodes of a level."""
    gain = np.stack([_gains(x, how) for x in h])
    total = np.where(np.isfinite(gain), gain, 0.0).sum(0)
    if not total.size or total.max() <= how.min_gain:
        return [None] * len(nodes)
    j, c = divmod(int(np.argmax(total)), total.shape[1])
    return [(j, c)] * len(nodes) if c < len(edges[j]) else [None] * len(nodes)


# -- costs ------------------------------------------------------------------------------------------------------------
def gini(s: np.ndarray) -> np.ndarray:
    n = s[..., 0]
    return n - (s[..., 1:] ** 2).sum(-1) / np.maximum(n, 1e-300)


def entropy(s: np.ndarray) -> np.ndarray:
    n = np.maximum(s[..., :1], 1e-300)
    q = s[..., 1:] / n
    return -(s[..., 1:] * np.log2(np.maximum(q, 1e-300))).sum(-1)


def squared(s: np.ndarray) -> np.ndarray:
    return s[..., 2] - s[..., 1] ** 2 / np.maximum(s[..., 0], 1e-300) if s.shape[-1] > 2 else -(s[..., 1] ** 2) / np.maximum(s[..., 0], 1e-300)


def class_stat(classes: np.ndarray, weigh: Callable | None = None) -> Callable:
    def stat(x, y, w, t):
        v = w if weigh is None else w * weigh(x, y, t)
        return np.column_stack([v, v[:, None] * (codes(classes, y)[:, None] == np.arange(len(classes)))])

    return stat


def value_stat(weigh: Callable | None = None) -> Callable:
    def stat(x, y, w, t):
        v = w if weigh is None else w * weigh(x, y, t)
        return np.column_stack([v, v * y, v * y * y])

    return stat


def shares(tree: Tree) -> Tree:
    s = np.array(tree.stats)
    tree.value = s[:, 1:] / np.maximum(s[:, :1], 1e-300)
    return tree


def means(tree: Tree) -> Tree:
    s = np.array(tree.stats)
    tree.value = s[:, 1] / np.maximum(s[:, 0], 1e-300)
    return tree


def gains_by_feature(trees: list[Tree], cost: Callable, p: int) -> np.ndarray:
    out = np.zeros(p)
    for t in trees:
        for i, f in enumerate(t.feature):
            if f >= 0:
                a, b, c = (float(cost(t.stats[k][None])[0]) for k in (i, t.left[i], t.right[i]))
                out[f] += max(0.0, a - b - c)
    return out / out.sum() if out.sum() else out


# -- single trees and forests -----------------------------------------------------------------------------------------
class _Forest:
    """Parameters and growth that trees and forests share."""

    DEFAULTS = {"max_depth": -1, "min_samples_split": 2, "min_samples_leaf": 1, "min_impurity_decrease": 0.0, "max_bins": MAX_BINS, "random_state": 0, "max_features": -1}
    RANDOM = False

    def _how(self, cost: Callable, p: int) -> Growth:
        f = self.max_features
        return Growth(cost, self.max_depth, self.min_samples_split, self.min_samples_leaf, max(1e-12, self.min_impurity_decrease), 0 if f < 0 else min(f, p), self.RANDOM, seed=max(0, self.random_state))

    def _n(self) -> int:
        return self.params.get("n_estimators", 1)

    def _weigh(self) -> Callable | None:
        return (lambda x, y, t: poisson(uniform(x, y, t + 1009 * max(0, self.random_state)))) if self.params.get("bootstrap") else None

    def _grow(self, data: Data, stat: Callable, cost: Callable, finish: Callable) -> None:
        edges, out = edges_of(data, self.max_bins), []
        chunk = 16  # trees that share a pass
        for at in range(0, self._n(), chunk):
            how = self._how(cost, len(edges))
            how.seed += at
            shift = (lambda x, y, w, t, at=at: stat(x, y, w, t + at))
            out += grow(data, edges, shift, how, min(chunk, self._n() - at))
        self.trees_ = [finish(t) for t in out]
        self.feature_importances_ = gains_by_feature(self.trees_, cost, len(edges))


class DecisionTreeClassifier(_Forest, Classifier):
    DEFAULTS = {"criterion": "gini"}

    def _fit(self, data):
        kinds = {"gini": gini, "entropy": entropy}
        if self.criterion not in kinds:
            raise ValueError("criterion must be gini or entropy")
        self._grow(data, class_stat(self.classes_, self._weigh()), kinds[self.criterion], shares)

    def proba_rows(self, x):
        return np.mean([t.predict(x) for t in self.trees_], axis=0)


class DecisionTreeRegressor(_Forest, Regressor):
    DEFAULTS = {"criterion": "mse"}

    def _fit(self, data):
        self._grow(data, value_stat(self._weigh()), squared, means)

    def predict_rows(self, x):
        return np.mean([t.predict(x) for t in self.trees_], axis=0)


class ExtraTreeClassifier(DecisionTreeClassifier):
    """The first feature in random order that isn't constant, cut at random."""

    RANDOM = True


class ExtraTreeRegressor(DecisionTreeRegressor):
    RANDOM = True


class RandomForestClassifier(DecisionTreeClassifier):
    """Bootstrapped trees with ``max_features`` (default: the root of their number) tried at a node; votes."""

    DEFAULTS = {"n_estimators": 100, "bootstrap": True}

    def _how(self, cost, p):
        how = super()._how(cost, p)
        if self.max_features < 0:
            how.features = max(1, int(math.sqrt(p)))
        return how

    def proba_rows(self, x):
        k = len(self.classes_)
        return np.mean([np.eye(k)[t.predict(x).argmax(1)] for t in self.trees_], axis=0)


class RandomForestRegressor(DecisionTreeRegressor):
    DEFAULTS = {"n_estimators": 100, "bootstrap": True}

    def _how(self, cost, p):
        how = super()._how(cost, p)
        if self.max_features < 0:
            how.features = max(1, p // 3)
        return how


class ExtraTreesClassifier(RandomForestClassifier):
    DEFAULTS = {"bootstrap": False}
    RANDOM = True


class ExtraTreesRegressor(RandomForestRegressor):
    DEFAULTS = {"bootstrap": False}
    RANDOM = True


class RandomTreesEmbedding(_Forest, Transformer):
    """Each row's leaf in trees that are cut at random: columns ``leaf_0``, ``leaf_1``, ..."""

    DEFAULTS = {"n_estimators": 100, "max_depth": 5, "bootstrap": False}
    RANDOM = True

    def _fit(self, data):
        # a target that is a hash of the row, so that every node has something to cut
        def stat(x, y, w, t):
            r = uniform(x, None, t)
            return np.column_stack([w, w * r, w * r * r])

        self._grow(data, stat, squared, means)

    def outputs(self):
        return [f"leaf_{k}" for k in range(self.n_estimators)]

    def transform(self, df):
        self._check(df)
        trees = self.trees_
        return apply(df, self.features_, lambda x: {f"leaf_{k}": t.leaf(x).astype(float) for k, t in enumerate(trees)}, dict.fromkeys(self.outputs(), "double"))


# -- boosting ---------------------------------------------------------------------------------------------------------
class _Boosting:
    """Rounds of trees on the slopes of a loss at what the trees so far predict."""

    DEFAULTS = {"n_estimators": 100, "learning_rate": 0.1, "max_depth": 3, "min_samples_split": 2, "min_samples_leaf": 1, "min_impurity_decrease": 0.0, "max_bins": MAX_BINS, "random_state": 0, "subsample": 1.0}
    SECOND_ORDER = False

    def _raw(self, x: np.ndarray) -> np.ndarray:
        out = np.tile(self.init_, (len(x), 1))
        for stage in self.stages_:
            for k, t in enumerate(stage):
                out[:, k] += self.learning_rate * t.predict(x)
        return out

    def _cost(self) -> Callable:
        return squared

    def _leaf(self, t: Tree) -> Tree:
        return means(t)

    def _growth(self, k: int) -> Growth:
        return Growth(self._cost(), self.max_depth, self.min_samples_split, self.min_samples_leaf, max(1e-12, self.min_impurity_decrease), seed=k)

    def _weight(self, x: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
        return (uniform(x, y, k) < self.subsample).astype(float) if self.subsample < 1 else np.ones(len(x))

    def _columns(self, p: int, k: int) -> list[np.ndarray] | None:
        return None

    def _boost(self, data: Data, outputs: int, slopes: Callable) -> None:
        """``slopes(raw, y)``: residuals and curvatures, rows x outputs."""
        edges, self.stages_ = edges_of(data, self.max_bins), []
        for k in range(self.n_estimators):
            cache: dict = {}

            def stat(x, y, w, t, k=k, cache=cache):
                key = id(x)
                if key not in cache:
                    cache.clear()
                    cache[key] = (x, *slopes(self._raw(x), y))
                r, h = cache[key][1][:, t], cache[key][2][:, t]
                v = w * self._weight(x, y, k)
                return np.column_stack([v, v * r, v * h]) if self.SECOND_ORDER else np.column_stack([v, v * r, v * r * r])

            cols = self._columns(len(edges), k)
            self.stages_.append([self._leaf(t) for t in grow(data, edges, stat, self._growth(k), outputs, cols and cols * outputs)])
        self.feature_importances_ = gains_by_feature([t for s in self.stages_ for t in s], self._cost(), len(edges))


class GradientBoostingRegressor(_Boosting, Regressor):
    def _fit(self, data):
        (s,) = data.sum(lambda x, y, w: np.array([w.sum(), (w * y).sum()]))
        self.init_ = np.array([s[1] / s[0]])
        self._boost(data, 1, lambda raw, y: ((y[:, None] - raw), np.ones_like(raw)))

    def predict_rows(self, x):
        return self._raw(x)[:, 0]


class GradientBoostingClassifier(_Boosting, Classifier):
    """A tree a class and round on the indicator less the softmax; two classes have one."""

    def _fit(self, data):
        classes, k = self.classes_, len(self.classes_)
        (n,) = data.sum(lambda x, y, w: np.bincount(codes(classes, y), w, k))
        q = np.clip(n / n.sum(), 1e-12, 1 - 1e-12)
        if k == 2:
            self.init_ = np.array([math.log(q[1] / q[0])])

            def slopes(raw, y):
                p = expit(raw)
                return (codes(classes, y) == 1)[:, None] - p, np.maximum(p * (1 - p), 1e-12)
        else:
            self.init_ = np.log(q / (1 - q))

            def slopes(raw, y):
                p = softmax(raw)
                return np.eye(k)[codes(classes, y)] - p, np.maximum(p * (1 - p), 1e-12)

        self._boost(data, len(self.init_), slopes)

    def proba_rows(self, x):
        raw = self._raw(x)
        return np.column_stack([1 - expit(raw[:, 0]), expit(raw[:, 0])]) if raw.shape[1] == 1 else softmax(raw)


class _Hist:
    DEFAULTS = {"max_iter": 100, "n_estimators": None}

    def _fit(self, data):
        self.params["n_estimators"] = self.max_iter
        super()._fit(data)


class HistGradientBoostingRegressor(_Hist, GradientBoostingRegressor):
    """The same by ``max_iter`` rounds; all boosting here is on histograms."""


class HistGradientBoostingClassifier(_Hist, GradientBoostingClassifier):
    """The same by ``max_iter`` rounds; all boosting here is on histograms."""


class _SecondOrder:
    """Newton leaves with L1 and L2 penalties, a least gain and a least curvature of children."""

    DEFAULTS = {"max_depth": 6, "gamma": 0.0, "reg_alpha": 0.0, "reg_lambda": 1.0, "min_child_weight": 1.0, "colsample_bytree": 1.0}
    SECOND_ORDER = True

    def _soft(self, g):
        return np.sign(g) * np.maximum(np.abs(g) - self.reg_alpha, 0)

    def _cost(self):
        return lambda s: -0.5 * self._soft(s[..., 1]) ** 2 / (s[..., 2] + self.reg_lambda + 1e-300)

    def _leaf(self, t):
        s = np.array(t.stats)
        t.value = self._soft(s[:, 1]) / (s[:, 2] + self.reg_lambda + 1e-300)
        return t

    def _growth(self, k):
        how = super()._growth(k)
        how.min_gain = max(1e-12, self.gamma)
        how.child = lambda s: s[..., 2] >= self.min_child_weight
        return how

    def _columns(self, p, k):
        if self.colsample_bytree >= 1:
            return None
        rng = np.random.default_rng(k)
        return [np.sort(rng.choice(p, max(1, int(p * self.colsample_bytree)), replace=False))]


class XGBRegressor(_SecondOrder, GradientBoostingRegressor):
    pass


class XGBClassifier(_SecondOrder, GradientBoostingClassifier):
    pass


class _Symmetric(_SecondOrder):
    """One cut for all nodes of a level, Bayesian weights of rows, and an L2 penalty."""

    DEFAULTS = {"learning_rate": 0.03, "l2_leaf_reg": 3.0, "border_count": 32.0, "bagging_temperature": 1.0, "min_child_weight": 0.0}

    def _fit(self, data):
        self.params["reg_lambda"], self.params["max_bins"] = self.l2_leaf_reg, int(self.border_count)
        super()._fit(data)

    def _growth(self, k):
        how = super()._growth(k)
        how.oblivious, how.min_split, how.child = True, 0, None
        return how

    def _weight(self, x, y, k):
        return (-np.log(uniform(x, y, k))) ** self.bagging_temperature if self.bagging_temperature > 0 else np.ones(len(x))


class CatBoostRegressor(_Symmetric, GradientBoostingRegressor):
    pass


class CatBoostClassifier(_Symmetric, GradientBoostingClassifier):
    pass


class AdaBoostClassifier(Classifier):
    """Weighted stumps; a stump's weight is the log odds of its accuracy, with log(k - 1) more for k classes."""

    DEFAULTS = {"n_estimators": 50, "learning_rate": 1.0, "random_state": 0, "max_bins": MAX_BINS}

    def _votes(self, x: np.ndarray) -> np.ndarray:
        k = len(self.classes_)
        out = np.zeros((len(x), k))
        for a, t in zip(self.alphas_, self.trees_, strict=True):
            out += a * np.eye(k)[t.predict(x).argmax(1)]
        return out

    def _fit(self, data):
        classes, k = self.classes_, len(self.classes_)
        edges, self.alphas_, self.trees_ = edges_of(data, self.max_bins), [], []
        for _ in range(self.n_estimators):
            def weigh(x, y, t):
                # the weight of a row is what the stumps that missed it have multiplied it by
                c, out = codes(classes, y), np.zeros(len(x))
                for a, tree in zip(self.alphas_, self.trees_, strict=True):
                    out += a * (tree.predict(x).argmax(1) != c)
                return np.exp(out)

            (tree,) = grow(data, edges, class_stat(classes, weigh), Growth(gini, max_depth=1, min_leaf=1e-9, min_split=0))
            shares(tree)
            leaves = [i for i, f in enumerate(tree.feature) if f < 0]
            total = sum(tree.stats[i][0] for i in leaves)
            error = sum(tree.stats[i][0] - tree.stats[i][1:].max() for i in leaves) / total
            if error >= 1 - 1 / k:
                break
            self.trees_.append(tree)
            self.alphas_.append(self.learning_rate * (math.log((1 - error) / max(error, 1e-10)) + math.log(k - 1)))
            if error <= 1e-10:
                break
        if not self.trees_:
            self.trees_, self.alphas_ = [shares(tree)], [1.0]

    def proba_rows(self, x):
        v = self._votes(x)
        return v / v.sum(1, keepdims=True)


class AdaBoostRegressor(Regressor):
    """Trees on rows weighted by earlier errors; the prediction is the weighted median."""

    DEFAULTS = {"n_estimators": 50, "learning_rate": 1.0, "loss": "linear", "max_depth": 3, "random_state": 0, "max_bins": MAX_BINS}

    def _loss(self, r: np.ndarray) -> np.ndarray:
        kinds = {"linear": lambda v: v, "square": lambda v: v * v, "exponential": lambda v: 1 - np.exp(-v)}
        if self.loss not in kinds:
            raise ValueError("loss must be linear, square or exponential")
        return kinds[self.loss](r)

    def _weigh(self, x, y, t=0):
        out = np.zeros(len(x))
        for tree, b, most in zip(self.trees_, self.logs_, self.most_, strict=True):
            out += b * (1 - self._loss(np.abs(tree.predict(x) - y) / most))
        return np.exp(-self.learning_rate * out)

    def _fit(self, data):
        edges, self.trees_, self.logs_, self.most_ = edges_of(data, self.max_bins), [], [], []
        for _ in range(self.n_estimators):
            (tree,) = grow(data, edges, value_stat(self._weigh), Growth(squared, max_depth=self.max_depth, min_leaf=1e-9, min_split=0))
            means(tree)
            (most,) = data.sum(lambda x, y, w, t=tree: np.array([np.abs(t.predict(x) - y).max(initial=0)]), how="max")
            most = float(most[0])
            if most <= 1e-12:
                self.trees_, self.logs_, self.most_ = [tree], [1.0], [1.0]
                break
            e = data.sum(lambda x, y, w, t=tree, m=most: (np.array([(w * self._weigh(x, y) * self._loss(np.abs(t.predict(x) - y) / m)).sum(), (w * self._weigh(x, y)).sum()])))[0]
            error = float(e[0] / e[1])
            if error >= 0.5 and self.trees_:
                break
            self.trees_.append(tree)
            self.logs_.append(math.log(max(1 - error, 1e-10) / max(error, 1e-10)))
            self.most_.append(most)
            if error >= 0.5:
                break

    def predict_rows(self, x):
        p = np.stack([t.predict(x) for t in self.trees_], 1)
        w = np.maximum(np.array(self.logs_), 1e-12)
        order = np.argsort(p, axis=1, kind="stable")
        run = np.cumsum(w[order], axis=1)
        k = (run >= 0.5 * run[:, -1:]).argmax(1)
        return p[np.arange(len(p)), order[np.arange(len(p)), k]]
