"""Composition: pipelines, meta-estimators, ensembles of estimators, calibration and inspection."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.core import Classifier, Data, NotFittedError, Params, Regressor, Transformer, col, number
from tessera.operators.search import score
from tessera.operators.splitters import positions


# -- chains -----------------------------------------------------------------------------------------------------------
class Pipeline(Params):
    """Named transformers and an estimator; each step gets the outputs of the one before."""

    DEFAULTS = {"steps": ()}

    def __init__(self, steps: Sequence[tuple[str, object]]):
        super().__init__(steps=list(steps))
        if not steps:
            raise ValueError("a pipeline needs steps")

    def clone(self, **changes):
        """``step__parameter`` changes a step's parameter."""
        return Pipeline([(n, e.clone(**{k.partition("__")[2]: v for k, v in changes.items() if k.startswith(n + "__")})) for n, e in self.steps])

    def fit(self, df, features, label=None):
        names = list(features)
        for _, step in self.steps[:-1]:
            step.fit(df, names, label)
            df, names = step.transform(df), step.outputs()
        self.steps[-1][1].fit(df, names, label)
        self.features_ = list(features)
        return self

    def _through(self, df):
        if "features_" not in self.__dict__:
            raise NotFittedError("the pipeline isn't fitted")
        for _, step in self.steps[:-1]:
            df = step.transform(df)
        return df

    def predict(self, df):
        return self.steps[-1][1].predict(self._through(df))

    def transform(self, df):
        return self.steps[-1][1].transform(self._through(df))

    def fit_transform(self, df, features, label=None):
        return self.fit(df, features, label).transform(df)

    def outputs(self):
        return self.steps[-1][1].outputs()

    def __getitem__(self, name):
        return dict(self.steps)[name]

    get_step = __getitem__


class FeatureUnion(Transformer):
    """The outputs of several transformers side by side, as ``name.output``."""

    DEFAULTS = {"transformers": ()}

    def clone(self, **changes):
        return FeatureUnion(transformers=[(n, t.clone()) for n, t in self.transformers])

    def fit(self, df, features, label=None, **options):
        for _, t in self.transformers:
            t.fit(df, features, label)
        self.features_ = list(features)
        return self

    def outputs(self):
        return [f"{n}.{o}" for n, t in self.transformers for o in t.outputs()]

    def transform(self, df):
        self._check(df)
        return side_by_side(df, [(n, t, self.features_) for n, t in self.transformers], self.features_)


def side_by_side(df: DataFrame, parts: Sequence[tuple[str, Transformer, list[str]]], drop: Sequence[str]) -> DataFrame:
    """Each transformer works on copies of its features, so that they don't get in each other's way."""
    kept = [c for c in df.columns if c not in drop]
    out = df
    made = []
    for n, t, features in parts:
        saved = {f: f"{n}#{f}" for f in features}
        out = out.select("*", *(col(f).alias(s) for f, s in saved.items()))
        before = set(out.columns)
        changed = t.transform(out)
        names = t.outputs()
        out = changed.select(*(col(saved.get(c, c)).alias(c) if c in saved else col(c) for c in df.columns if c in before), *(col(c) for c in made), *(col(o).alias(f"{n}.{o}") for o in names))
        made += [f"{n}.{o}" for o in names]
    return out.select(*(col(c) for c in kept), *(col(c) for c in made))


class ColumnTransformer(Transformer):
    """Transformers by columns; the others are dropped or pass."""

    DEFAULTS = {"transformers": (), "remainder": "drop", "sparse_threshold": 0.3}

    def clone(self, **changes):
        return ColumnTransformer(transformers=[(n, t.clone(), c) for n, t, c in self.transformers], remainder=self.remainder)

    def fit(self, df, features, label=None, **options):
        if self.remainder not in ("drop", "passthrough"):
            raise ValueError("remainder must be drop or passthrough")
        for _, t, c in self.transformers:
            t.fit(df, c, label)
        self.features_ = list(features)
        return self

    def _rest(self):
        used = {c for _, _, cs in self.transformers for c in cs}
        return [f for f in self.features_ if f not in used] if self.remainder == "passthrough" else []

    def outputs(self):
        return [f"{n}.{o}" for n, t, _ in self.transformers for o in t.outputs()] + self._rest()

    def transform(self, df):
        self._check(df)
        return side_by_side(df, list(self.transformers), [f for f in self.features_ if f not in self._rest()])


class TransformedTargetRegressor(Params):
    """A regressor of the transformed target; predictions are transformed back."""

    DEFAULTS = {"regressor": None, "transformer": None}

    def clone(self, **changes):
        return TransformedTargetRegressor(regressor=self.regressor.clone(), transformer=self.transformer and self.transformer.clone())

    def fit(self, df, features, label):
        self.label_, self.features_ = label, list(features)
        if self.transformer is not None:
            df = self.transformer.fit(df, [label]).transform(df)
        self.regressor.fit(df, features, label)
        return self

    def predict(self, df):
        out = self.regressor.predict(df)
        if self.transformer is None:
            return out
        back = self.transformer.inverse_transform(out.withColumn("y#", col(self.label_) if self.label_ in out.columns else F.lit(None)).withColumn(self.label_, F.col("prediction")))
        return back.withColumn("prediction", col(self.label_)).withColumn(self.label_, F.col("y#")).drop("y#") if self.label_ in df.columns else back.withColumn("prediction", col(self.label_)).drop("y#", self.label_)


# -- several classes or targets ---------------------------------------------------------------------------------------
def _second(df: DataFrame, name: str) -> DataFrame:
    """The probability of class 1 under another name, without the other outputs."""
    return df.withColumn(name, F.col("probability")[1]).drop("prediction", "probability", "decision")


class _Meta(Classifier):
    DEFAULTS = {"estimator_factory": None, "n_jobs": 1}

    def fit(self, df, features, label=None, **options):
        self.classes_ = Data(df, features, label).classes()
        self.features_, self.label_ = list(features), label
        self._models(df)
        return self

    def _binary(self, df: DataFrame, target) -> object:
        return self.estimator_factory().fit(df.withColumn("y#", target.cast("int")), self.features_, "y#")

    def _finish(self, df, scores, names):
        out = df.withColumn("probability", F.array(*scores))
        total = F.aggregate("probability", F.lit(0.0), lambda a, b: a + b)
        out = out.withColumn("probability", F.transform("probability", lambda p: F.when(total > 0, p / total).otherwise(1.0 / len(scores))))
        best = F.array_position("probability", F.array_max("probability"))
        return out.withColumn("prediction", F.element_at(F.array(*(F.lit(int(c)) for c in self.classes_)), best.cast("int"))).drop(*names)


class OneVsRestClassifier(_Meta):
    def _models(self, df):
        self.models_ = [self._binary(df, col(self.label_).cast("int") == int(c)) for c in self.classes_]

    def _predict(self, df):
        names = [f"p#{i}" for i in range(len(self.models_))]
        for n, m in zip(names, self.models_, strict=True):
            df = _second(m.predict(df), n)
        return self._finish(df, [F.col(n) for n in names], names)


class OneVsOneClassifier(_Meta):
    """Votes of the pairs; equal ones are told apart by the summed confidence."""

    def _models(self, df):
        self.models_ = []
        for i, a in enumerate(self.classes_):
            for j in range(i + 1, len(self.classes_)):
                b = self.classes_[j]
                two = df.filter(col(self.label_).cast("int").isin(int(a), int(b)))
                self.models_.append((i, j, self._binary(two, col(self.label_).cast("int") == int(b))))

    def _predict(self, df):
        names = [f"p#{k}" for k in range(len(self.models_))]
        for n, (_, _, m) in zip(names, self.models_, strict=True):
            df = _second(m.predict(df), n)
        k = len(self.classes_)
        votes = [F.lit(0.0)] * k
        for n, (i, j, _) in zip(names, self.models_, strict=True):
            p = F.col(n)
            votes[j] = votes[j] + F.when(p >= 0.5, 1.0).otherwise(0.0) + (p - 0.5) * 1e-3
            votes[i] = votes[i] + F.when(p < 0.5, 1.0).otherwise(0.0) - (p - 0.5) * 1e-3
        return self._finish(df, [F.greatest(v, F.lit(0.0)) for v in votes], names)


class OutputCodeClassifier(_Meta):
    """A random code of bits for each class; the nearest code wins."""

    DEFAULTS = {"code_size": 0, "random_state": 0}

    def _models(self, df):
        k = len(self.classes_)
        rng, m = np.random.default_rng(max(0, self.random_state)), self.code_size or max(2, 2 * k)
        while True:
            book = rng.integers(0, 2, (k, m))
            book = book[:, (book.min(0) == 0) & (book.max(0) == 1)]
            if book.size and len(np.unique(book, axis=0)) == k:
                break
        self.code_book_ = book
        ones = [[int(c) for c, bit in zip(self.classes_, book[:, b], strict=True) if bit] for b in range(book.shape[1])]
        self.models_ = [self._binary(df, col(self.label_).cast("int").isin(s)) for s in ones]

    def _predict(self, df):
        names = [f"p#{i}" for i in range(len(self.models_))]
        for n, m in zip(names, self.models_, strict=True):
            df = _second(m.predict(df), n)
        far = [sum((F.abs(F.col(n) - int(b)) for n, b in zip(names, code, strict=True)), F.lit(0.0)) for code in self.code_book_]
        return self._finish(df, [1 / (d + 1e-9) for d in far], names)


class MultiOutputClassifier(Params):
    """A model for each label column; predictions are ``prediction_<label>``."""

    DEFAULTS = {"estimator_factory": None}
    CHAIN = False

    def _order(self, labels):
        return list(labels)

    def fit(self, df, features, labels):
        self.features_, self.labels_, self.models_ = list(features), self._order(labels), []
        names = list(features)
        for y in self.labels_:
            self.models_.append(self.estimator_factory().fit(df, names, y))
            if self.CHAIN:
                names = [*names, y]
        return self

    def predict(self, df):
        if "models_" not in self.__dict__:
            raise NotFittedError("not fitted")
        before, out = df.columns, df.drop(*(y for y in self.labels_ if self.CHAIN))
        for y, m in zip(self.labels_, self.models_, strict=True):
            out = m.predict(out)
            extra = [F.col("probability").alias(f"probability_{y}")] if "probability" in out.columns else []
            # a chain's later models read earlier predictions under the labels' names
            again = [F.col("prediction").alias(y)] if self.CHAIN else []
            out = out.select(*(col(c) for c in out.columns if c not in ("prediction", "probability")), F.col("prediction").alias(f"prediction_{y}"), *extra, *again)
        if self.CHAIN:
            out = out.drop(*self.labels_)
        return out.select(*(col(c) for c in before if c in out.columns), *(col(c) for c in out.columns if c not in before))


class MultiOutputRegressor(MultiOutputClassifier):
    pass


class ClassifierChain(MultiOutputClassifier):
    """Each label is a feature of the next: the true one in fit, the predicted one in predict."""

    DEFAULTS = {"order": ()}
    CHAIN = True

    def _order(self, labels):
        labels = list(labels)
        return [labels[i] for i in self.order] if self.order else labels


class RegressorChain(ClassifierChain):
    pass


# -- ensembles of estimators ------------------------------------------------------------------------------------------
def bootstrap(df: DataFrame, seed: int, fraction: float = 1.0) -> DataFrame:
    """Each row a Poisson number of times by a hash of its values: with replacement, and the same however it is partitioned."""
    u = (F.pmod(F.xxhash64(F.lit(seed), *map(col, df.columns)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    steps = np.cumsum([math.exp(-fraction) * fraction**i / math.factorial(i) for i in range(10)])
    n = sum(((u > float(s)).cast("int") for s in steps), F.lit(0))
    return df.withColumn("n#", n).filter("`n#` > 0").withColumn("n#", F.explode(F.sequence(F.lit(1), F.col("n#")))).drop("n#")


class _Bagging(Params):
    DEFAULTS = {"base_estimator": None, "n_estimators": 10, "max_samples": -1, "max_features": -1, "random_state": 0}

    def fit(self, df, features, label=None):
        rng, self.models_ = np.random.default_rng(max(0, self.random_state)), []
        n = df.count() if self.max_samples > 0 else 1
        for i in range(self.n_estimators):
            k = self.max_features if 0 < self.max_features < len(features) else len(features)
            mine = [features[j] for j in sorted(rng.choice(len(features), k, replace=False))]
            part = bootstrap(df.select(*map(col, [*features, label])), 7919 * max(0, self.random_state) + i, min(1.0, self.max_samples / n) if self.max_samples > 0 else 1.0)
            self.models_.append(self.base_estimator.clone().fit(part, mine, label))
        self.features_ = list(features)
        self._after()
        return self

    def _after(self):
        pass


class BaggingRegressor(_Bagging):
    def predict(self, df):
        return mean_prediction(df, self.models_)


class BaggingClassifier(_Bagging):
    def _after(self):
        self.classes_ = np.array(sorted({int(c) for m in self.models_ for c in m.classes_}))

    def predict(self, df):
        return mean_probability(df, self.models_, self.classes_)


def mean_prediction(df: DataFrame, models: Sequence) -> DataFrame:
    names = [f"m#{i}" for i in range(len(models))]
    for n, m in zip(names, models, strict=True):
        df = m.predict(df).withColumnRenamed("prediction", n)
    return df.withColumn("prediction", sum((F.col(n) for n in names[1:]), F.col(names[0])) / len(names)).drop(*names)


def mean_probability(df: DataFrame, models: Sequence, classes: np.ndarray, hard: bool = False) -> DataFrame:
    names = [f"m#{i}" for i in range(len(models))]
    for n, m in zip(names, models, strict=True):
        df = m.predict(df)
        place = {int(c): i for i, c in enumerate(m.classes_)}
        if hard:
            parts = [(F.col("prediction") == int(c)).cast("double") for c in classes]
        else:
            parts = [F.col("probability")[place[int(c)]] if int(c) in place else F.lit(0.0) for c in classes]
        df = df.withColumn(n, F.array(*parts)).drop("prediction", "probability")
    p = F.array(*(sum((F.col(n)[k] for n in names[1:]), F.col(names[0])[k]) / len(names) for k in range(len(classes))))
    df = df.withColumn("probability", p).drop(*names)
    return df.withColumn("prediction", F.element_at(F.array(*(F.lit(int(c)) for c in classes)), F.array_position("probability", F.array_max("probability")).cast("int")))


class VotingRegressor(Params):
    DEFAULTS = {"estimators": ()}

    def fit(self, df, features, label=None):
        self.models_ = [e.clone().fit(df, features, label) for _, e in self.estimators]
        self.features_ = list(features)
        return self

    def predict(self, df):
        return mean_prediction(df, self.models_)


class VotingClassifier(VotingRegressor):
    DEFAULTS = {"voting": "hard"}

    def predict(self, df):
        if self.voting not in ("hard", "soft"):
            raise ValueError("voting must be hard or soft")
        return mean_probability(df, self.models_, self.models_[0].classes_, self.voting == "hard")


class _Stacking(Params):
    """A meta-estimator on what the others predict for rows that they weren't fitted on."""

    DEFAULTS = {"base_estimators": (), "meta": None, "cv": 3, "key": None}

    def _columns(self, df, models):
        raise NotImplementedError

    def fit(self, df, features, label=None):
        fold = F.pmod(F.xxhash64(F.lit(17), *map(col, [*features, label])), F.lit(self.cv))
        df = df.select(*map(col, [*features, label])).withColumn("fold#", fold)
        parts = None
        for k in range(self.cv):
            train, test = df.filter(F.col("fold#") != k), df.filter(F.col("fold#") == k)
            models = [e.clone().fit(train, features, label) for _, e in self.base_estimators]
            one, names = self._columns(test, models)
            parts = one if parts is None else parts.unionByName(one)
        self.meta.fit(parts, names, label)
        self.models_ = [e.clone().fit(df, features, label) for _, e in self.base_estimators]
        self.features_ = list(features)
        return self

    def predict(self, df):
        out, names = self._columns(df, self.models_)
        return self.meta.predict(out).drop(*names)


class StackingRegressor(_Stacking):
    def _columns(self, df, models):
        names = [f"s#{i}" for i in range(len(models))]
        for n, m in zip(names, models, strict=True):
            df = m.predict(df).withColumnRenamed("prediction", n)
        return df, names


class StackingClassifier(_Stacking):
    def _columns(self, df, models):
        names = []
        for i, m in enumerate(models):
            df = m.predict(df)
            for k in range(1, len(m.classes_)):
                names.append(f"s#{i}_{k}")
                df = df.withColumn(names[-1], F.col("probability")[k])
            df = df.drop("prediction", "probability")
        return df, names


# -- calibration ------------------------------------------------------------------------------------------------------
def pool(x: np.ndarray, y: np.ndarray, w: np.ndarray, increasing: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators on sorted points of distinct x: thresholds and values."""
    y = y if increasing else -y
    blocks: list[list[float]] = []
    for i in range(len(x)):
        blocks.append([y[i] * w[i], w[i], i, i])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            b = blocks.pop()
            blocks[-1] = [blocks[-1][0] + b[0], blocks[-1][1] + b[1], blocks[-1][2], b[3]]
    out = np.empty(len(x))
    for s, n, i, j in blocks:
        out[int(i) : int(j) + 1] = s / n
    return x, out if increasing else -out


def pooled(blocks: list[tuple], s: np.ndarray, n: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list[tuple]:
    """``blocks`` (sum, weight, from, to) of increasing means, and further ones after them, pooled where the order is violated."""
    out = list(blocks)
    for one in zip(s.tolist(), n.tolist(), lo.tolist(), hi.tolist(), strict=True):
        out.append(one)
        while len(out) > 1 and out[-2][0] / out[-2][1] >= out[-1][0] / out[-1][1]:
            b, a = out.pop(), out.pop()
            out.append((a[0] + b[0], a[1] + b[1], a[2], b[3]))
    return out


class IsotonicRegression(Regressor):
    """Pooled means of y by x, linear between.

    Neighbours that violate the order are pooled in ranges of x first, which leaves what pooling them all gives the same,
    and the ranges' pools on the driver. What comes there are the ends of the pools, the model.
    """

    DEFAULTS = {"increasing": True}

    def _fit(self, data):
        if len(data.features) != 1:
            raise ValueError("isotonic regression takes one feature")
        sign = 1.0 if self.increasing else -1.0

        def pools(batches):
            blocks = []
            for b in batches:
                blocks = pooled(blocks, *(c.to_numpy(zero_copy_only=False) for c in b.columns))
            yield pa.RecordBatch.from_arrays([pa.array([v[k] for v in blocks], pa.float64()) for k in range(4)], names=["s", "n", "lo", "hi"])

        t = data.table.groupBy("x0").agg(F.sum(F.col("x1") * sign).alias("s"), F.count("*").cast("double").alias("n"))
        t = t.repartitionByRange("x0").sortWithinPartitions("x0").select("s", "n", F.col("x0").alias("lo"), F.col("x0").alias("hi")).mapInArrow(pools, "s double, n double, lo double, hi double")
        a = t.orderBy("lo").toArrow()
        blocks = pooled([], *(a[c].to_numpy() for c in ("s", "n", "lo", "hi")))
        self.x_, at = np.unique([x for _, _, lo, hi in blocks for x in (lo, hi)], return_index=True)
        self.y_ = sign * np.array([v for s, n, *_ in blocks for v in (s / n, s / n)])[at]

    def predict_rows(self, x):
        return np.interp(x[:, 0], self.x_, self.y_)

    def transform(self, df):
        return self.predict(df)


class CalibratedClassifierCV(Params):
    """Probabilities of two classes mapped by a sigmoid or an isotonic fit on folds that the base wasn't fitted on."""

    DEFAULTS = {"base_estimator": None, "method": "sigmoid", "cv": 3}

    def fit(self, df, features, label=None):
        from tessera.operators.linear import LogisticRegression

        if self.method not in ("sigmoid", "isotonic"):
            raise ValueError("method must be sigmoid or isotonic")
        fold = F.pmod(F.xxhash64(F.lit(29), *map(col, [*features, label])), F.lit(self.cv))
        rows = df.select(*map(col, [*features, label])).withColumn("fold#", fold)
        parts = None
        for k in range(self.cv):
            m = self.base_estimator.clone().fit(rows.filter(F.col("fold#") != k), features, label)
            one = m.predict(rows.filter(F.col("fold#") == k)).withColumn("p#", F.col("probability")[1])
            one = one.select(number("p#").alias("p#"), (col(label).cast("int") == int(m.classes_[1])).cast("double").alias("y#"))
            parts = one if parts is None else parts.unionByName(one)
        self.model_ = self.base_estimator.clone().fit(df, features, label)
        self.classes_ = self.model_.classes_
        if len(self.classes_) != 2:
            raise ValueError("calibration takes two classes")
        if self.method == "sigmoid":
            p = F.least(F.greatest(F.col("p#"), F.lit(1e-9)), F.lit(1 - 1e-9))
            self.map_ = LogisticRegression(C=1e6).fit(parts.select(F.log(p / (1 - p)).alias("z#"), "y#"), ["z#"], "y#")
        else:
            self.map_ = IsotonicRegression().fit(parts, ["p#"], "y#")
        self.features_ = list(features)
        return self

    def predict(self, df):
        out = self.model_.predict(df).withColumn("p#", F.col("probability")[1]).drop("prediction", "probability")
        if self.method == "sigmoid":
            p = F.least(F.greatest(F.col("p#"), F.lit(1e-9)), F.lit(1 - 1e-9))
            out = self.map_.predict(out.withColumn("z#", F.log(p / (1 - p)))).withColumn("q#", F.col("probability")[1]).drop("z#", "prediction", "probability")
        else:
            out = self.map_.predict(out).withColumnRenamed("prediction", "q#")
        return out.withColumn("probability", F.array(1 - F.col("q#"), F.col("q#"))).withColumn("prediction", F.when(F.col("q#") >= 0.5, int(self.classes_[1])).otherwise(int(self.classes_[0]))).drop("p#", "q#")


# -- inspection -------------------------------------------------------------------------------------------------------
class PermutationImportance(Params):
    """How much a score falls when a feature's values are dealt anew: mean and population deviation over repeats."""

    DEFAULTS = {"estimator": None, "scoring": "accuracy", "n_repeats": 5, "random_state": 0}

    def fit(self, df, features, label, key):
        model = self.estimator.clone().fit(df, features, label)
        base = score(model.predict(df), label, self.scoring)
        self.importances_ = {}
        for f in features:
            falls = []
            for r in range(self.n_repeats):
                seed = 7919 * max(0, self.random_state) + r
                a = positions(df, [col(key)], "a#")
                b = positions(df.select(col(key), col(f).alias("v#")), [F.xxhash64(F.lit(seed), col(key)), col(key)], "b#").select("b#", "v#")
                mixed = a.join(b, F.col("a#") == F.col("b#")).withColumn(f, F.col("v#")).drop("a#", "b#", "v#")
                falls.append(base - score(model.predict(mixed), label, self.scoring))
            self.importances_[f] = falls
        self.importances_mean_ = {f: float(np.mean(v)) for f, v in self.importances_.items()}
        self.importances_std_ = {f: float(np.std(v)) for f, v in self.importances_.items()}
        return self


class PartialDependence(Params):
    """Mean predictions with one feature set to each of the points between its least and greatest value."""

    DEFAULTS = {"estimator": None, "features": (), "grid": 50}

    def compute(self, df: DataFrame) -> DataFrame:
        """(feature, value, mean)."""
        out = None
        for f in self.features:
            r = df.agg(F.min(number(f)).alias("lo"), F.max(number(f)).alias("hi")).first()
            points = df.sparkSession.createDataFrame([(float(v),) for v in np.linspace(r["lo"], r["hi"], self.grid)], "`v#` double")
            each = df.crossJoin(F.broadcast(points)).withColumn(f, F.col("v#"))  # ``grid`` points
            one = self.estimator.predict(each).groupBy("v#").agg(F.avg("prediction").alias("mean")).select(F.lit(f).alias("feature"), F.col("v#").alias("value"), "mean")
            out = one if out is None else out.unionByName(one)
        return out


