"""Cross-validated scores and searches over parameters."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.core import Params, col
from tessera.functions import metrics as M
from tessera.operators.splitters import KFold, ParameterGrid, ParameterSampler, positions


def score(df: DataFrame, label: str, scoring: str, prediction: str = "prediction") -> float:
    """Of predictions; errors are negative, so that greater is better."""
    label_scores = {"precision": M.precision_score_df, "recall": M.recall_score_df, "f1": M.f1_score_df}
    if scoring in label_scores:
        return label_scores[scoring](df, label, prediction).first()[0]
    aggregates: dict[str, Column] = {"accuracy": M.accuracy_score(label, prediction), "r2": M.r2_score(label, prediction), "mse": -M.mean_squared_error(label, prediction), "mae": -M.mean_absolute_error(label, prediction)}
    if scoring not in aggregates:
        raise ValueError(f"no scoring {scoring}")
    return df.agg(aggregates[scoring]).first()[0]


def cross_val_score(estimator, df: DataFrame, features: Sequence[str], label: str, cv=None, scoring: str = "accuracy", key: str | None = None) -> list[float]:
    """A clone's score on each test set. ``key`` orders the rows; without it a hash of all columns does."""
    df, key = _keyed(df, key)
    out = []
    for train, test in (cv or KFold()).pairs(df, key, label):
        out.append(score(estimator.clone().fit(train, features, label).predict(test), label, scoring))
    return out


def _keyed(df: DataFrame, key: str | None) -> tuple[DataFrame, str]:
    if key is not None:
        return df, key
    return positions(df.withColumn("_h", F.xxhash64(*map(col, df.columns))), [F.col("_h"), *map(col, df.columns)], "_key").drop("_h"), "_key"


class _Search(Params):
    DEFAULTS = {"estimator": None, "cv": None, "scoring": "accuracy", "key": None}

    def _candidates(self) -> list[dict]:
        raise NotImplementedError

    def fit(self, df: DataFrame, features: Sequence[str], label: str):
        df, key = _keyed(df, self.key)
        self.results_ = []
        best = None
        for p in self._candidates():
            s = cross_val_score(self.estimator.clone(**p), df, features, label, self.cv, self.scoring, key)
            mean = sum(s) / len(s)
            self.results_.append({"params": p, "scores": s, "mean": mean})
            if best is None or mean > best[0]:
                best = mean, p
        self.best_score_, self.best_params_ = best
        self.best_estimator_ = self.estimator.clone(**best[1]).fit(df, features, label)
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        return self.best_estimator_.predict(df)

    def get_n_splits(self) -> int:
        return (self.cv or KFold()).get_n_splits()


class GridSearchCV(_Search):
    DEFAULTS = {"param_grid": None}

    def _candidates(self):
        return list(ParameterGrid(self.param_grid) if isinstance(self.param_grid, dict) else self.param_grid)


class RandomizedSearchCV(_Search):
    DEFAULTS = {"param_distributions": None, "n_iter": 10, "random_state": 0}

    def _candidates(self):
        return list(ParameterSampler(self.param_distributions, self.n_iter, self.random_state))


class _Halving(_Search):
    """Scores all candidates on a few rows, then the best of them on more."""

    DEFAULTS = {"factor": 3, "min_resources": 1, "aggressive_elimination": False}

    def fit(self, df, features, label):
        df, key = _keyed(df, self.key)
        n, left = df.count(), self._candidates()
        folds = (self.cv or KFold()).get_n_splits()
        rounds = max(1, math.ceil(math.log(max(2, len(left)), self.factor)))
        resources = min(n, max(self.min_resources, 4 * folds, n // self.factor**rounds))
        ranked = positions(df, [F.xxhash64(F.lit(0), col(key)), col(key)], "_rank")
        self.results_ = []
        while True:
            part = ranked.filter(F.col("_rank") < resources).drop("_rank")
            scored = []
            for p in left:
                s = cross_val_score(self.estimator.clone(**p), part, features, label, self.cv, self.scoring, key)
                scored.append((sum(s) / len(s), p))
                self.results_.append({"params": p, "resources": resources, "mean": scored[-1][0]})
            scored.sort(key=lambda x: -x[0])
            left = [p for _, p in scored[: math.ceil(len(scored) / self.factor)]]
            if len(scored) <= self.factor or len(left) == 1:
                break
            if not self.aggressive_elimination or resources * self.factor <= n:
                resources = min(n, resources * self.factor)
        self.best_score_, self.best_params_ = scored[0]
        self.best_estimator_ = self.estimator.clone(**self.best_params_).fit(df, features, label)
        return self


class HalvingGridSearchCV(_Halving):
    DEFAULTS = {"param_grid": None}
    _candidates = GridSearchCV._candidates


class HalvingRandomSearchCV(_Halving):
    DEFAULTS = {"param_distributions": None, "n_candidates": 10, "random_state": 0}

    def _candidates(self):
        return list(ParameterSampler(self.param_distributions, self.n_candidates, self.random_state))
