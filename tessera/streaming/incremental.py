"""Fits over streams: every micro-batch adds its sums to a state that gives the same model as all rows at once.

A batch's sums are stored under its number before they are added up, and the state is read from what is stored, so a
batch that is run again after a failure counts once.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.core import Data, moments, number
from tessera.operators.bayes import GaussianNB
from tessera.operators.decomposition import PCA
from tessera.operators.linear import Gram, LinearRegression, Ridge, ridge, solve
from tessera.operators.preprocessing import StandardScaler


def merged(a: tuple, b: tuple) -> tuple:
    """Counts, means and centred products of two sets of rows together."""
    (n, m, g), (k, c, h) = a, b
    if not n:
        return b
    if not k:
        return a
    d = c - m
    return n + k, m + d * k / (n + k), g + h + np.outer(d, d) * n * k / (n + k)


_BEFORE = -1


class StreamingMoments:
    """``stream.writeStream.foreachBatch(state.add)``: sums of features and labels, by groups of a label if asked for.

    Only the last batch can run again, so what it holds is the sums of the last and of all before it.
    """

    def __init__(self, features: Sequence[str], label: str | None = None, by_class: bool = False):
        self.features, self.label, self.by_class = list(features), label, by_class
        #: By batch; under ``_BEFORE`` those of all batches up to ``merged_to``.
        self.batches: dict[int, dict] = {}
        self.merged_to = _BEFORE

    def add(self, df: DataFrame, batch_id: int) -> None:
        if batch_id <= self.merged_to:
            return
        older = sorted(b for b in self.batches if b < batch_id)
        if older and older != [_BEFORE]:
            self.batches[_BEFORE] = {g: self.total(g, older) for g in {g for b in older for g in self.batches[b]}}
            self.merged_to = older[-1]
            self.batches = {b: v for b, v in self.batches.items() if b == _BEFORE or b not in older}
        if df.isEmpty():
            return
        if self.by_class:
            classes = sorted(r[0] for r in df.select(F.col(self.label).cast("int")).distinct().collect())
            self.batches[batch_id] = {c: moments(Data(df.filter(F.col(self.label).cast("int") == c), self.features)) for c in classes}
        else:
            self.batches[batch_id] = {None: moments(Data(df, self.features, self.label))}

    def total(self, group=None, batches: Sequence[int] | None = None) -> tuple:
        out: tuple = (0.0, None, None)
        for k in sorted(self.batches if batches is None else batches):
            if group in self.batches[k]:
                out = merged(out, self.batches[k][group])
        if not out[0]:
            raise ValueError("no rows yet")
        return out

    def groups(self) -> list:
        return sorted({g for b in self.batches.values() for g in b}, key=str)

    # -- models of the rows so far ------------------------------------------------------------------------------------
    def scaler(self) -> StandardScaler:
        n, mean, g = self.total()
        m, p = StandardScaler(), len(self.features)
        s = np.sqrt(np.diag(g)[:p] / n)
        m.mean_ = dict(zip(self.features, mean[:p].tolist(), strict=True))
        m.scale_ = dict(zip(self.features, np.where(s == 0, 1, s).tolist(), strict=True))
        m.features_ = self.features
        return m

    def pca(self, n_components: int = -1) -> PCA:
        m = PCA(n_components=n_components)
        n, mean, g = self.total()
        p = len(self.features)
        m._from(n, mean[:p], g[:p, :p])
        m.features_ = self.features
        return m

    def regression(self, alpha: float = 0.0) -> LinearRegression:
        g = Gram(*self.total(), True)
        m = Ridge(alpha=alpha) if alpha else LinearRegression()
        m.coef_ = ridge(g, alpha) if alpha else solve(g.xx, g.xy)
        m.intercept_, m.features_ = float(g.intercept(m.coef_)), self.features
        return m

    def naive_bayes(self, var_smoothing: float = 1e-9) -> GaussianNB:
        m, groups = GaussianNB(var_smoothing=var_smoothing), self.groups()
        parts = [self.total(g) for g in groups]
        n = np.array([p[0] for p in parts])
        m.classes_, m.theta_ = np.array(groups), np.stack([p[1] for p in parts])
        m.var_ = np.maximum(np.stack([np.diag(p[2]) / p[0] for p in parts]), var_smoothing)
        m.class_prior_, m.features_ = n / n.sum(), self.features
        return m

    def to_json(self) -> str:
        return json.dumps([[b, [[g, n, m.tolist(), c.tolist()] for g, (n, m, c) in parts.items()]] for b, parts in self.batches.items()])

    @classmethod
    def from_json(cls, text: str, features: Sequence[str], label: str | None = None, by_class: bool = False) -> StreamingMoments:
        out = cls(features, label, by_class)
        for b, parts in json.loads(text):
            out.batches[b] = {g: (n, np.array(m), np.array(c)) for g, n, m, c in parts}
        if _BEFORE in out.batches:
            out.merged_to = max((b for b in out.batches if b != _BEFORE), default=0) - 1
        return out


def windowed(stream: DataFrame, time: str, value: str, by: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts, sums and means by window and group; rows later than the watermark are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), F.col(by).alias("by")).agg(F.count("*").alias("n"), F.sum(number(value)).alias("total"), F.avg(number(value)).alias("mean")).select(F.col("w.start").alias("start"), "by", "n", "total", "mean")
