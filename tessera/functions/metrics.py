"""Evaluation metrics as aggregates.

Regression metrics are aggregate columns: ``df.agg(mean_squared_error("y", "p"))``. Label metrics come from one contingency
table, ranking metrics from one table of distinct scores, clustering metrics from cluster sums; each function takes a
DataFrame and returns a float, its ``_df`` form the one-row DataFrame. Rows with a missing value are left out.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.core import Data, col, number

EPS = 1e-15


def _value(df: DataFrame) -> float | None:
    r = df.first()
    return None if r is None else r[0]


# -- regression: aggregate columns ------------------------------------------------------------------------------------
def _yp(y: str, p: str) -> tuple[Column, Column]:
    return number(y), number(p)


def mean_squared_error(y: str, p: str) -> Column:
    a, b = _yp(y, p)
    return F.avg((a - b) * (a - b))


def root_mean_squared_error(y: str, p: str) -> Column:
    return F.sqrt(mean_squared_error(y, p))


def mean_absolute_error(y: str, p: str) -> Column:
    a, b = _yp(y, p)
    return F.avg(F.abs(a - b))


def median_absolute_error(y: str, p: str) -> Column:
    a, b = _yp(y, p)
    return F.percentile(F.abs(a - b), F.lit(0.5))


def max_error(y: str, p: str) -> Column:
    a, b = _yp(y, p)
    return F.max(F.abs(a - b))


def r2_score(y: str, p: str) -> Column:
    """NaN where y is constant."""
    a, b = _yp(y, p)
    rest, total = F.avg((a - b) * (a - b)), F.var_pop(F.when(b.isNotNull(), a))
    return F.when(total == 0, F.lit(float("nan"))).otherwise(1 - rest / total)


def explained_variance_score(y: str, p: str) -> Column:
    """0 where y is constant."""
    a, b = _yp(y, p)
    total = F.var_pop(F.when(b.isNotNull(), a))
    return F.when(total == 0, F.lit(0.0)).otherwise(1 - F.var_pop(a - b) / total)


def mean_absolute_percentage_error(y: str, p: str) -> Column:
    """In per cent, over rows with |y| > 1e-8; 0 without any."""
    a, b = _yp(y, p)
    return F.coalesce(100 * F.avg(F.when(F.abs(a) > 1e-8, F.abs((a - b) / a))), F.lit(0.0))


def _positive(x: Column, what: str) -> Column:
    return F.when(x > 0, x).when(x.isNull(), x).otherwise(F.raise_error(F.lit(f"{what} must be positive")).cast("double"))


def mean_poisson_deviance(y: str, p: str) -> Column:
    a, b = _positive(number(y), "y"), _positive(number(p), "predictions")
    return F.avg(2 * (a * F.log(a / b) - (a - b)))


def mean_gamma_deviance(y: str, p: str) -> Column:
    a, b = _positive(number(y), "y"), _positive(number(p), "predictions")
    return F.avg(2 * (F.log(b / a) + (a - b) / b))


def _tweedie(a: Column, b: Column, power: float) -> Column:
    if power == 0:
        return (a - b) * (a - b)
    if power == 1:
        return 2 * (F.when(a > 0, a * F.log(a / b)).otherwise(0.0) - (a - b))
    if power == 2:
        return 2 * (F.log(b / a) + (a - b) / b)
    if not 0 < power < 2:
        raise ValueError("power must be from 0 to 2")
    q = 1 - power
    return 2 * (F.pow(a, F.lit(2 - power)) / (q * (2 - power)) - a * F.pow(b, F.lit(q)) / q + F.pow(b, F.lit(2 - power)) / (2 - power))


def mean_tweedie_deviance(y: str, p: str, power: float = 0.0) -> Column:
    return F.avg(_tweedie(*_yp(y, p), power))


# -- regression: against a null model, two passes ---------------------------------------------------------------------
def _against(df: DataFrame, y: str, p: str, null: Column, loss: Callable[[Column, Column], Column]) -> DataFrame:
    rows = df.select(number(y).alias("y"), number(p).alias("p")).dropna()
    both = rows.crossJoin(F.broadcast(rows.agg(null.alias("m"))))  # one row
    top, low = F.avg(loss(F.col("y"), F.col("p"))), F.avg(loss(F.col("y"), F.col("m")))
    return both.agg(F.when(low == 0, F.lit(0.0)).otherwise(1 - top / low).alias("value"))


def d2_tweedie_score_df(df: DataFrame, y: str, p: str, power: float = 0.0) -> DataFrame:
    return _against(df, y, p, F.avg("y"), lambda a, b: _tweedie(a, b, power))


def d2_pinball_score_df(df: DataFrame, y: str, p: str, alpha: float = 0.5) -> DataFrame:
    """The null model is the alpha quantile."""
    return _against(df, y, p, F.percentile(F.col("y"), F.lit(float(alpha))), lambda a, b: F.when(a >= b, alpha * (a - b)).otherwise((1 - alpha) * (b - a)))


def d2_absolute_error_score_df(df: DataFrame, y: str, p: str) -> DataFrame:
    """The null model is the median."""
    return _against(df, y, p, F.percentile(F.col("y"), F.lit(0.5)), lambda a, b: F.abs(a - b))


# -- labels: one contingency table ------------------------------------------------------------------------------------
def contingency(df: DataFrame, y: str, p: str) -> DataFrame:
    """(t, p, n) for the pairs that occur."""
    return df.select(col(y).cast("int").alias("t"), col(p).cast("int").alias("p")).dropna().groupBy("t", "p").agg(F.count("*").cast("double").alias("n"))


confusion_matrix = contingency


def _per_class(df: DataFrame, y: str, p: str) -> DataFrame:
    """(c, support, predicted, hit) for the classes that occur in y."""
    c = contingency(df, y, p)
    t = c.groupBy(F.col("t").alias("c")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0.0)).alias("hit"))
    q = c.groupBy(F.col("p").alias("q")).agg(F.sum("n").alias("predicted"))
    return t.join(q, F.col("c") == F.col("q"), "left").select("c", "support", "hit", F.coalesce("predicted", F.lit(0.0)).alias("predicted"))


def _averaged(per: DataFrame, top: Column, low: Column, average: str) -> Column:
    ratio = F.when(low == 0, F.lit(0.0)).otherwise(top / low)
    if average == "macro":
        return F.avg(ratio)
    if average == "weighted":
        return F.sum(ratio * F.col("support")) / F.sum("support")
    if average == "micro":
        return F.sum(top) / F.sum(low)
    raise ValueError(f"average must be macro, micro or weighted, not {average}")




def precision_score_df(df: DataFrame, y: str, p: str, average: str = "macro") -> DataFrame:
    per = _per_class(df, y, p)
    return per.agg(_averaged(per, F.col("hit"), F.col("predicted"), average).alias("value"))


def recall_score_df(df: DataFrame, y: str, p: str, average: str = "macro") -> DataFrame:
    per = _per_class(df, y, p)
    return per.agg(_averaged(per, F.col("hit"), F.col("support"), average).alias("value"))


def f1_score_df(df: DataFrame, y: str, p: str, average: str = "macro") -> DataFrame:
    """The harmonic mean of the averaged precision and the averaged recall."""
    per = _per_class(df, y, p)
    a, b = _averaged(per, F.col("hit"), F.col("predicted"), average), _averaged(per, F.col("hit"), F.col("support"), average)
    return per.agg(a.alias("a"), b.alias("b")).select(F.when(F.col("a") + F.col("b") == 0, F.lit(0.0)).otherwise(2 * F.col("a") * F.col("b") / (F.col("a") + F.col("b"))).alias("value"))


def f1_per_class_df(df: DataFrame, y: str, p: str) -> DataFrame:
    per = _per_class(df, y, p)
    return per.select("c", (2 * F.col("hit") / (F.col("support") + F.col("predicted"))).alias("value"))


def jaccard_score_df(df: DataFrame, y: str, p: str, average: str = "macro") -> DataFrame:
    per = _per_class(df, y, p)
    return per.agg(_averaged(per, F.col("hit"), F.col("support") + F.col("predicted") - F.col("hit"), average).alias("value"))


def balanced_accuracy_score_df(df: DataFrame, y: str, p: str) -> DataFrame:
    return recall_score_df(df, y, p, "macro")


def accuracy_score(y: str, p: str) -> Column:
    a, b = col(y).cast("int"), col(p).cast("int")
    return F.avg((a == b).cast("double"))


def zero_one_loss(y: str, p: str) -> Column:
    return 1 - accuracy_score(y, p)


hamming_loss = zero_one_loss


def classification_report_df(df: DataFrame, y: str, p: str) -> DataFrame:
    """measure, value: macro precision, recall and F1, and accuracy."""
    one = lambda name, d: d.select(F.lit(name).alias("measure"), F.round(F.col(d.columns[0]), 3).alias("value"))
    parts = [one("precision", precision_score_df(df, y, p)), one("recall", recall_score_df(df, y, p)), one("f1", f1_score_df(df, y, p)), one("accuracy", df.agg(accuracy_score(y, p)))]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def _marginals(df: DataFrame, y: str, p: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    c = contingency(df, y, p)
    return c, c.groupBy("t").agg(F.sum("n").alias("a")), c.groupBy("p").agg(F.sum("n").alias("b"))


def cohen_kappa_score_df(df: DataFrame, y: str, p: str) -> DataFrame:
    """0 where chance agreement is complete."""
    c, a, b = _marginals(df, y, p)
    po = c.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0.0)).alias("hit"))
    pe = a.join(b, F.col("t") == F.col("p")).agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0.0)).alias("e"))
    n, hit, e = F.col("n"), F.col("hit"), F.col("e") / (F.col("n") * F.col("n"))
    return po.crossJoin(F.broadcast(pe)).select(F.when(e == 1, F.lit(0.0)).otherwise((hit / n - e) / (1 - e)).alias("value"))  # one row each


def matthews_corrcoef_df(df: DataFrame, y: str, p: str) -> DataFrame:
    """Of two or more classes; 0 where either side is constant."""
    c, a, b = _marginals(df, y, p)
    s = c.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0.0)).alias("hit"))
    ab = a.join(b, F.col("t") == F.col("p")).agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0.0)).alias("ab"))
    aa, bb = a.agg(F.sum(F.col("a") * F.col("a")).alias("aa")), b.agg(F.sum(F.col("b") * F.col("b")).alias("bb"))
    one = s.crossJoin(F.broadcast(ab)).crossJoin(F.broadcast(aa)).crossJoin(F.broadcast(bb))  # one row each
    n = F.col("n")
    low = F.sqrt((n * n - F.col("aa")) * (n * n - F.col("bb")))
    return one.select(F.when(low == 0, F.lit(0.0)).otherwise((F.col("hit") * n - F.col("ab")) / low).alias("value"))


# -- scores -----------------------------------------------------------------------------------------------------------
def brier_score_loss(y: str, p: str) -> Column:
    a, b = number(y), F.least(F.greatest(number(p), F.lit(0.0)), F.lit(1.0))
    return F.avg((b - a) * (b - a))


def log_loss(y: str, probabilities: Sequence[str], classes: Sequence[int]) -> Column:
    """Mean of -ln of the true class's probability, clipped; ``probabilities`` are columns in the order of ``classes``."""
    p = F.lit(None).cast("double")
    for c, k in zip(probabilities, classes, strict=True):
        p = F.when(col(y).cast("int") == k, number(c)).otherwise(p)
    return F.avg(-F.log(F.greatest(F.least(p, F.lit(1 - EPS)), F.lit(EPS))))


def hinge_loss(y: str, score: str) -> Column:
    """Labels above 0 count as +1, others as -1."""
    s = F.when(number(y) > 0, 1.0).otherwise(-1.0)
    return F.avg(F.greatest(F.lit(0.0), 1 - s * number(score)))


def top_k_accuracy_score(y: str, scores: Sequence[str], k: int = 5) -> Column:
    """Column i scores class i; of equal scores the higher class comes first."""
    if k > len(scores):
        raise ValueError("k is greater than the number of score columns")
    ranked = F.slice(F.array_sort(F.array(*(F.struct((-number(s)).alias("s"), F.lit(-i).alias("i")) for i, s in enumerate(scores)))), 1, k)
    return F.avg(F.exists(ranked, lambda r: -r["i"] == col(y).cast("int")).cast("double"))


def _by_score(df: DataFrame, y: str, s: str) -> DataFrame:
    """(s, pos, neg) by distinct score, with the running sums (tp, fp) of scores at least as great.

    The running sums need the scores in order. Scores are dealt to ranges; sums over ranges are small and are added first.
    """
    rows = df.select(number(y).alias("y"), number(s).alias("s")).dropna().groupBy("s").agg(F.sum((F.col("y") > 0).cast("double")).alias("pos"), F.sum((F.col("y") <= 0).cast("double")).alias("neg"))
    part = rows.repartitionByRange(F.desc("s")).withColumn("part", F.spark_partition_id())
    sums = part.groupBy("part").agg(F.sum("pos").alias("pp"), F.sum("neg").alias("pn"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    sums = sums.select(F.col("part").alias("k"), F.coalesce(F.sum("pp").over(before), F.lit(0.0)).alias("bp"), F.coalesce(F.sum("pn").over(before), F.lit(0.0)).alias("bn"))
    own = Window.partitionBy("part").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    return part.join(F.broadcast(sums), F.col("part") == F.col("k")).select("s", "pos", "neg", (F.sum("pos").over(own) + F.col("bp")).alias("tp"), (F.sum("neg").over(own) + F.col("bn")).alias("fp"))


def roc_auc_score_df(df: DataFrame, y: str, s: str) -> DataFrame:
    """Equal scores count one half; null with one class only."""
    r = _by_score(df, y, s)
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2))
    low = F.sum("pos") * F.sum("neg")
    return r.agg(F.when(low > 0, area / low).alias("value"))


def roc_auc_score_multiclass_df(df: DataFrame, y: str, scores: Sequence[str]) -> DataFrame:
    """Mean of one class against the rest; column i scores class i."""
    parts = [roc_auc_score_df(df.select((col(y).cast("int") == i).cast("double").alias("y"), col(c).alias("s")), "y", "s") for i, c in enumerate(scores)]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.agg(F.avg("value").alias("value"))


def average_precision_score_df(df: DataFrame, y: str, s: str) -> DataFrame:
    """Equal scores are one threshold."""
    r = _by_score(df, y, s)
    return r.agg((F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.sum("pos")).alias("value"))


# -- clusterings against labels ---------------------------------------------------------------------------------------
def _pairs(n: Column) -> Column:
    return n * (n - 1) / 2


def adjusted_rand_score_df(df: DataFrame, y: str, p: str) -> DataFrame:
    c, a, b = _marginals(df, y, p)
    one = c.agg(F.sum(_pairs(F.col("n"))).alias("i"), F.sum("n").alias("n")).crossJoin(F.broadcast(a.agg(F.sum(_pairs(F.col("a"))).alias("a")))).crossJoin(F.broadcast(b.agg(F.sum(_pairs(F.col("b"))).alias("b"))))  # one row each
    e = F.col("a") * F.col("b") / _pairs(F.col("n"))
    low = (F.col("a") + F.col("b")) / 2 - e
    return one.select(F.when(low == 0, F.lit(1.0)).otherwise((F.col("i") - e) / low).alias("value"))


def fowlkes_mallows_score_df(df: DataFrame, y: str, p: str) -> DataFrame:
    c, a, b = _marginals(df, y, p)
    one = c.agg(F.sum(_pairs(F.col("n"))).alias("i")).crossJoin(F.broadcast(a.agg(F.sum(_pairs(F.col("a"))).alias("a")))).crossJoin(F.broadcast(b.agg(F.sum(_pairs(F.col("b"))).alias("b"))))  # one row each
    low = F.sqrt(F.col("a") * F.col("b"))
    return one.select(F.when(low == 0, F.lit(0.0)).otherwise(F.col("i") / low).alias("value"))


def _entropies(df: DataFrame, y: str, p: str) -> DataFrame:
    """hy, hp, mi: entropies of both sides and their mutual information, in nats; one row."""
    c, a, b = _marginals(df, y, p)
    total = F.broadcast(c.agg(F.sum("n").alias("total")))  # one row
    h = lambda t, v, name: t.crossJoin(total).agg((-F.sum(F.col(v) / F.col("total") * F.log(F.col(v) / F.col("total")))).alias(name))
    return h(a, "a", "hy").crossJoin(F.broadcast(h(b, "b", "hp"))).crossJoin(F.broadcast(h(c, "n", "hj"))).select("hy", "hp", (F.col("hy") + F.col("hp") - F.col("hj")).alias("mi"))


def _ratio(top: Column, low: Column) -> Column:
    return F.when(F.abs(low) < 1e-12, F.lit(1.0)).otherwise(top / low)


def normalized_mutual_info_score_df(df: DataFrame, y: str, p: str) -> DataFrame:
    return _entropies(df, y, p).select(_ratio(F.col("mi"), (F.col("hy") + F.col("hp")) / 2).alias("value"))


def homogeneity_score_df(df: DataFrame, y: str, p: str) -> DataFrame:
    return _entropies(df, y, p).select(_ratio(F.col("mi"), F.col("hy")).alias("value"))


def completeness_score_df(df: DataFrame, y: str, p: str) -> DataFrame:
    return _entropies(df, y, p).select(_ratio(F.col("mi"), F.col("hp")).alias("value"))


def v_measure_score_df(df: DataFrame, y: str, p: str) -> DataFrame:
    return _entropies(df, y, p).select(_ratio(F.col("mi"), F.col("hy")).alias("h"), _ratio(F.col("mi"), F.col("hp")).alias("c")).select(F.when(F.col("h") + F.col("c") == 0, F.lit(0.0)).otherwise(2 * F.col("h") * F.col("c") / (F.col("h") + F.col("c"))).alias("value"))


def adjusted_mutual_info_score(df: DataFrame, y: str, p: str) -> float:
    """With the expectation under random labels of the same sizes; the cluster sizes come to the driver."""
    _, a, b = _marginals(df, y, p)
    e = _entropies(df, y, p).first()
    rows, cols = [r["a"] for r in a.collect()], [r["b"] for r in b.collect()]
    n, lg = sum(rows), math.lgamma
    expected = 0.0
    for i in rows:
        for j in cols:
            lo, hi = int(max(1, i + j - n)), int(min(i, j))
            k = np.arange(lo, hi + 1, dtype=float)
            base = lg(i + 1) + lg(j + 1) + lg(n - i + 1) + lg(n - j + 1) - lg(n + 1)
            logs = np.array([base - lg(x + 1) - lg(i - x + 1) - lg(j - x + 1) - lg(n - i - j + x + 1) for x in k])
            expected += float((k / n * np.log(n * k / (i * j)) * np.exp(logs)).sum())
    low = (e["hy"] + e["hp"]) / 2 - expected
    return 1.0 if abs(low) < 1e-12 else float((e["mi"] - expected) / low)


# -- clusterings by themselves ----------------------------------------------------------------------------------------
def _cluster_sums(df: DataFrame, features: Sequence[str], label: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each cluster: label, count, mean, and sum of squared deviations; and (by a second pass) the mean distance to its mean."""
    data = Data(df, features, label)
    classes = data.classes()

    def fn(x, y, w):
        k = np.searchsorted(classes, y.astype(int))
        s = np.zeros((len(classes), x.shape[1]))
        np.add.at(s, k, x)
        return np.bincount(k, minlength=len(classes)).astype(float), s

    n, s = data.sum(fn)
    mean = s / n[:, None]

    def spread(x, y, w):
        k = np.searchsorted(classes, y.astype(int))
        d2 = ((x - mean[k]) ** 2).sum(1)
        return np.bincount(k, d2, len(classes)), np.bincount(k, np.sqrt(d2), len(classes))

    within, dist = data.sum(spread)
    return n, mean, within, dist / n


def calinski_harabasz_score(df: DataFrame, features: Sequence[str], label: str) -> float:
    n, mean, within, _ = _cluster_sums(df, features, label)
    k, total = len(n), n.sum()
    if k < 2 or total == k:
        return 0.0
    centre = (n[:, None] * mean).sum(0) / total
    between = float((n * ((mean - centre) ** 2).sum(1)).sum())
    return math.inf if within.sum() == 0 else between / (k - 1) / (within.sum() / (total - k))


def davies_bouldin_score(df: DataFrame, features: Sequence[str], label: str) -> float:
    n, mean, _, s = _cluster_sums(df, features, label)
    worst = []
    for i in range(len(n)):
        d = np.sqrt(((mean - mean[i]) ** 2).sum(1))
        r = [(s[i] + s[j]) / d[j] for j in range(len(n)) if j != i and d[j] > 0]
        worst.append(max(r, default=0.0))
    return float(np.mean(worst)) if worst else 0.0


def silhouette_samples(df: DataFrame, features: Sequence[str], label: str, block: int = 256) -> DataFrame:
    """``df`` with ``silhouette`` by Euclidean distances to all rows; rows alone in their cluster have 0.

    Every row meets all rows, which are sent to the executors, in tiles.
    """
    from tessera.core import apply
    from tessera.operators.neighbors import distances

    data = Data(df, features, label)
    x, y, _ = data.local(data.n)
    y = y.astype(int)
    classes = data.classes()
    member = (y[:, None] == classes).astype(float)

    def fn(q):
        z, own = q[:, :-1], q[:, -1].astype(int)
        out = np.zeros(len(q))
        for at in range(0, len(q), block):
            sums = sum(distances(z[at : at + block], x[t : t + 4096]) @ member[t : t + 4096] for t in range(0, len(x), 4096))
            n = member.sum(0)
            k = np.searchsorted(classes, own[at : at + block])
            i = np.arange(len(k))
            a = sums[i, k] / np.maximum(1, n[k] - 1)
            other = sums / n
            other[i, k] = np.inf
            b = other.min(1)
            out[at : at + block] = np.where(n[k] == 1, 0.0, (b - a) / np.maximum(np.maximum(a, b), 1e-300))
        return {"silhouette": out}

    return apply(df, [*features, label], fn, {"silhouette": "double"}, len(x))


def silhouette_score(df: DataFrame, features: Sequence[str], label: str) -> float:
    return _value(silhouette_samples(df, features, label).agg(F.avg("silhouette")))


def _eager(f: Callable[..., DataFrame]) -> Callable[..., float]:
    def run(*args, **kwargs) -> float:
        return _value(f(*args, **kwargs))

    run.__name__ = f.__name__.removesuffix("_df")
    run.__doc__ = f.__doc__
    return run


for _name in [n for n in dict(globals()) if n.endswith("_score_df") or n.endswith("_corrcoef_df")]:
    globals()[_name.removesuffix("_df")] = _eager(globals()[_name])
