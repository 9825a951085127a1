"""Queries whose models of two features, or of neighbours, have a closed form in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import bayes as B
from tessera.operators import compose as O
from tessera.operators import feature_selection as S
from tessera.operators import linear as L
from tessera.plans.q_models import _B2, _ROWS
from tessera.plans.registry import query
from tessera.plans.shared import lines, rounded

_TWO = ["q", "d"]


def _gram(x: str, y: str, target: str, rows: str = _ROWS) -> str:
    """Moments of two features and a target under the names that ``_B2`` takes."""
    return f"(SELECT covar_pop({x}, {x}) AS a, covar_pop({x}, {y}) AS b, covar_pop({y}, {y}) AS c, covar_pop({x}, {target}) AS u, covar_pop({y}, {target}) AS v, avg({x}) AS mq, avg({y}) AS md, avg({target}) AS mp, count(*) AS n FROM {rows})"


def _fit(target: str, alpha: str = "0.0", rows: str = _ROWS, x: str = "q", y: str = "d") -> str:
    return _B2.format(alpha=alpha, g=_gram(x, y, target, rows))


def _votes(make, features=_TWO, label="status"):
    return lambda s, d: make().fit(lines(s, d), features, label).predict(lines(s, d)).groupBy(label, "prediction").agg(F.count("*").alias("n"))


# -- classifiers of two features --------------------------------------------------------------------------------------
_PM = f"(SELECT q, d, status, CASE WHEN status = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS y FROM {_ROWS})"
query("ridge_classifier_two", f"SELECT status, CASE WHEN mp + b1 * (q - mq) + b2 * (d - md) > 0 THEN 1 ELSE 0 END AS prediction, count(*) AS n FROM {_ROWS} x, {_fit('y', '1.0', _PM)} z GROUP BY 1, 2")(_votes(L.RidgeClassifier))
_CLASSES = f"(SELECT status AS c, avg(q) AS mq, avg(d) AS md, var_pop(q) AS a, covar_pop(q, d) AS b, var_pop(d) AS e, CAST(count(*) AS DOUBLE) AS n FROM {_ROWS} GROUP BY 1)"
_LDA = f"""WITH z AS (SELECT sum(a * n) / (sum(n) - 2) AS a, sum(b * n) / (sum(n) - 2) AS b, sum(e * n) / (sum(n) - 2) AS e, max(CASE WHEN c = 1 THEN mq END) AS q1, max(CASE WHEN c = 0 THEN mq END) AS q0,
        max(CASE WHEN c = 1 THEN md END) AS d1, max(CASE WHEN c = 0 THEN md END) AS d0, ln(max(CASE WHEN c = 1 THEN n END) / max(CASE WHEN c = 0 THEN n END)) AS o FROM {_CLASSES}),
    w AS (SELECT *, (e * (q1 - q0) - b * (d1 - d0)) / (a * e - b * b) AS w1, (a * (d1 - d0) - b * (q1 - q0)) / (a * e - b * b) AS w2 FROM z)
    SELECT status, CASE WHEN w1 * (q - (q1 + q0) / 2) + w2 * (d - (d1 + d0) / 2) + o > 0 THEN 1 ELSE 0 END AS prediction, count(*) AS n FROM (SELECT q, d, status FROM {_ROWS}) x, w GROUP BY 1, 2"""
query("linear_discriminant_analysis_two", _LDA)(_votes(B.LinearDiscriminantAnalysis))
_QDA = f"""WITH z AS (SELECT c, mq, md, a * n / (n - 1) AS a, b * n / (n - 1) AS b, e * n / (n - 1) AS e, ln(n) AS o FROM {_CLASSES}), x AS (SELECT row_number() OVER () AS i, q, d, status FROM {_ROWS}),
    s AS (SELECT i, status, c, o - 0.5 * ((e * pow(q - mq, 2) - 2 * b * (q - mq) * (d - md) + a * pow(d - md, 2)) / (a * e - b * b) + ln(a * e - b * b)) AS s FROM x, z)
    SELECT status, CASE WHEN s1 > s0 THEN 1 ELSE 0 END AS prediction, count(*) AS n FROM (SELECT i, status, max(CASE WHEN c = 1 THEN s END) AS s1, max(CASE WHEN c = 0 THEN s END) AS s0 FROM s GROUP BY 1, 2) GROUP BY 1, 2"""
query("quadratic_discriminant_analysis_two", _QDA)(_votes(B.QuadraticDiscriminantAnalysis))
_NB = f"""WITH z AS (SELECT c, mq, md, a, e, ln(n) AS o FROM {_CLASSES}), x AS (SELECT row_number() OVER () AS i, q, d, status FROM {_ROWS}),
    s AS (SELECT i, status, c, o - 0.5 * (pow(q - mq, 2) / a + ln(a) + pow(d - md, 2) / e + ln(e)) AS s FROM x, z),
    p AS (SELECT i, status, CASE WHEN max(CASE WHEN c = 1 THEN s END) > max(CASE WHEN c = 0 THEN s END) THEN 1 ELSE 0 END AS prediction FROM s GROUP BY 1, 2)"""
_NB_VOTES = f"{_NB} SELECT status, prediction, count(*) AS n FROM p GROUP BY 1, 2"
query("voting_classifier_hard", _NB_VOTES)(_votes(lambda: O.VotingClassifier(estimators=(("a", B.GaussianNB()), ("b", B.GaussianNB()), ("c", B.DummyClassifier())), voting="hard")))
query("one_vs_one_classifier_two", _NB_VOTES)(_votes(lambda: O.OneVsOneClassifier(estimator_factory=B.GaussianNB)))


@query("multi_output_classifier_two", f"{_NB} SELECT round(avg(CASE WHEN prediction = status THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS status FROM p")
def _multi_output_classifier(s, d):
    df = lines(s, d)
    out = O.MultiOutputClassifier(estimator_factory=B.GaussianNB).fit(df, _TWO, ["status", "flag"]).predict(df)
    return rounded(out.agg(F.avg((F.col("prediction_status") == F.col("status")).cast("double")).alias("status")))


# -- regressors of two features ---------------------------------------------------------------------------------------
@query("voting_regressor_two", f"SELECT flag, round(avg((l.mp + l.b1 * (q - l.mq) + l.b2 * (d - l.md) + r.mp + r.b1 * (q - r.mq) + r.b2 * (d - r.md)) / 2), 4) AS mean, count(*) AS n FROM {_ROWS} x, {_fit('price')} l, {_fit('price', '50000.0')} r GROUP BY 1")
def _voting(s, d):
    df = lines(s, d)
    out = O.VotingRegressor(estimators=(("a", L.LinearRegression()), ("b", L.Ridge(alpha=50000.0)))).fit(df, _TWO, "price").predict(df)
    return rounded(out.groupBy("flag").agg(F.avg("prediction").alias("mean"), F.count("*").alias("n")), 4)


_ST = f"(SELECT q, d, price, CAST(status AS DOUBLE) AS s FROM {_ROWS})"


@query("multi_output_regressor_two", f"SELECT round(1 - avg(pow(price - p.mp - p.b1 * (q - p.mq) - p.b2 * (d - p.md), 2)) / var_pop(price), 4) AS price, round(1 - avg(pow(s - z.mp - z.b1 * (q - z.mq) - z.b2 * (d - z.md), 2)) / var_pop(s), 4) AS status FROM {_ST} x, {_fit('price')} p, {_fit('s', rows=_ST)} z")
def _multi_output(s, d):
    from tessera.functions import metrics as M

    df = lines(s, d)
    out = O.MultiOutputRegressor(estimator_factory=L.LinearRegression).fit(df, _TWO, ["price", "status"]).predict(df)
    return rounded(out.agg(M.r2_score("price", "prediction_price").alias("price"), M.r2_score("status", "prediction_status").alias("status")), 4)


@query("regressor_chain_two", f"""WITH f AS (SELECT regr_slope(price, q) AS b, regr_intercept(price, q) AS a FROM {_ROWS})
    SELECT flag, round(avg(a + b * q), 4) AS price, round(avg(mp + b1 * (q - mq) + b2 * (a + b * q - md)), 4) AS d FROM {_ROWS} x, f, {_fit('d', x='q', y='price')} z GROUP BY 1""")
def _chain(s, d):
    df = lines(s, d)
    out = O.RegressorChain(estimator_factory=L.LinearRegression).fit(df, ["q"], ["price", "d"]).predict(df)
    return rounded(out.groupBy("flag").agg(F.avg("prediction_price").alias("price"), F.avg("prediction_d").alias("d")), 4)


@query("isotonic_regression", f"""WITH g AS (SELECT q, sum(price) AS s, CAST(count(*) AS DOUBLE) AS n FROM {_ROWS} GROUP BY q), c AS (SELECT q, sum(s) OVER (ORDER BY q) AS s, sum(n) OVER (ORDER BY q) AS n, row_number() OVER (ORDER BY q) AS i FROM g),
    z AS (SELECT i, s, n FROM c UNION ALL SELECT 0, 0.0, 0.0), m AS (SELECT x.q, j.i, min((k.s - j.s) / (k.n - j.n)) AS m FROM c x JOIN z j ON j.i < x.i JOIN c k ON k.i >= x.i GROUP BY 1, 2) SELECT q, round(max(m), 4) AS prediction FROM m GROUP BY q""")
def _isotonic(s, d):
    df = lines(s, d)
    return rounded(O.IsotonicRegression().fit(df, ["q"], "price").predict(df).groupBy("q").agg(F.max("prediction").alias("prediction")), 4)


# the lasso's criterion over three penalties, from moments
_IC = f"""WITH m AS (SELECT covar_pop(q, price) AS c, var_pop(q) AS v, var_pop(price) AS w, avg(q) AS mq, avg(price) AS mp, CAST(count(*) AS DOUBLE) AS n FROM {_ROWS}), a AS (SELECT unnest([0.1, 1.0, 10.0])::DOUBLE AS a),
    b AS (SELECT *, sign(c) * greatest(abs(c) - a, 0) / v AS b FROM m, a), k AS (SELECT * FROM (SELECT *, n * ln((w - 2 * b * c + b * b * v)) + 2 * (1 + (b <> 0)::INT) AS k FROM b) ORDER BY k, a LIMIT 1)"""
query("lasso_lars_ic_single", f"{_IC} SELECT 'q' AS term, round(b, 4) AS value FROM k UNION ALL SELECT 'intercept', round(mp - b * mq, 4) FROM k")(
    lambda s, d: (lambda m: s.createDataFrame([("q", round(float(m.coef_[0]), 4)), ("intercept", round(m.intercept_, 4))], "term string, value double"))(L.LassoLarsIC(alphas=(0.1, 1.0, 10.0)).fit(lines(s, d), ["q"], "price"))
)


def _tasks(make):
    def run(s, d):
        m = make().fit(lines(s, d), ["q"], ["price", "d"])
        return s.createDataFrame([(y, round(float(m.coef_[k][0]), 5)) for k, y in enumerate(m.labels_)], "target string, value double")

    return run


def _tasks_sql(alpha: float, ratio: float) -> str:
    c = f"(SELECT covar_pop(q, price) AS c1, covar_pop(q, d) AS c2, var_pop(q) AS v, greatest(0, 1 - {alpha * ratio} / sqrt(pow(covar_pop(q, price), 2) + pow(covar_pop(q, d), 2))) / (var_pop(q) + {alpha * (1 - ratio)}) AS f FROM {_ROWS})"
    return f"SELECT 'price' AS target, round(c1 * f, 5) AS value FROM {c} UNION ALL SELECT 'd', round(c2 * f, 5) FROM {c}"


query("multi_task_lasso_single", _tasks_sql(20.0, 1.0))(_tasks(lambda: L.MultiTaskLasso(alpha=20.0)))
query("multi_task_elastic_net_single", _tasks_sql(20.0, 0.5))(_tasks(lambda: L.MultiTaskElasticNet(alpha=20.0, l1_ratio=0.5)))
_PICK = f"SELECT CASE WHEN abs(b1) >= abs(b2) THEN 'q' ELSE 'd' END AS feature FROM {_fit('price')}"


def _chosen(make):
    return lambda s, d: s.createDataFrame([(f,) for f in make().fit(lines(s, d), _TWO, "price").selected_], "feature string")


query("rfe_two", _PICK)(_chosen(lambda: S.RFE(estimator=L.LinearRegression(), n_features_to_select=1)))
query("select_from_model_two", _PICK)(_chosen(lambda: S.SelectFromModel(estimator=L.LinearRegression())))
