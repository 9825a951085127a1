"""Queries for models, clusterings, decompositions, composition, persistence and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.functions import metrics as M
from tessera.operators import bayes as B
from tessera.operators import cluster as C
from tessera.operators import compose as O
from tessera.operators import covariance as V
from tessera.operators import decomposition as D
from tessera.operators import linear as L
from tessera.operators import neighbors as N
from tessera.operators import neural as R
from tessera.operators import svm as W
from tessera.operators import trees as T
from tessera.operators.preprocessing import MinMaxScaler, StandardScaler
from tessera.plans.graph import shared_folder
from tessera.plans.registry import query
from tessera.plans.shared import LINE_SQL, lines, orders, rounded, table, value
from tessera.sources import models as saved
from tessera.streaming.incremental import StreamingMoments, windowed

X = ["q", "d", "t"]


# -- regressors -------------------------------------------------------------------------------------------------------
def _coef(make, features=X, digits=4, label="price"):
    def run(s, d):
        m = make().fit(lines(s, d), features, label)
        return s.createDataFrame([(f, round(float(c), digits)) for f, c in zip([*features, "intercept"], [*m.coef_, m.intercept_], strict=True)], "term string, value double")

    return run


def _coef_sql(slope, intercept):
    return f"SELECT 'q' AS term, round({slope}, 4) AS value FROM {LINE_SQL} UNION ALL SELECT 'intercept', round({intercept}, 4) FROM {LINE_SQL}"


query("linear_regression", _coef_sql("regr_slope(price, q)", "regr_intercept(price, q)"))(_coef(L.LinearRegression, ["q"]))
# two features by the normal equations
_G = f"(SELECT covar_pop(q, q) AS a, covar_pop(q, d) AS b, covar_pop(d, d) AS c, covar_pop(q, price) AS u, covar_pop(d, price) AS v, avg(q) AS mq, avg(d) AS md, avg(price) AS mp, count(*) AS n FROM {LINE_SQL})"
_B2 = "(SELECT ((c + k) * u - b * v) / ((a + k) * (c + k) - b * b) AS b1, ((a + k) * v - b * u) / ((a + k) * (c + k) - b * b) AS b2, mq, md, mp FROM (SELECT *, {alpha} / n AS k FROM {g}))"


def _two(alpha):
    s = _B2.format(alpha=alpha, g=_G)
    return f"SELECT 'q' AS term, round(b1, 4) AS value FROM {s} UNION ALL SELECT 'd', round(b2, 4) FROM {s} UNION ALL SELECT 'intercept', round(mp - b1 * mq - b2 * md, 4) FROM {s}"


query("linear_regression_two", _two("0.0"))(_coef(L.LinearRegression, ["q", "d"]))
query("ridge", _two("50000.0"))(_coef(lambda: L.Ridge(alpha=50000.0), ["q", "d"]))
_SOFT = "sign({c}) * greatest(abs({c}) - {l1}, 0) / (covar_pop(q, q) + {l2})"
_LASSO = _SOFT.format(c="covar_pop(q, price)", l1="10.0", l2="0.0")
query("lasso", _coef_sql(_LASSO, f"avg(price) - avg(q) * ({_LASSO})"))(_coef(lambda: L.Lasso(alpha=10.0), ["q"]))
_EN = _SOFT.format(c="covar_pop(q, price)", l1="5.0", l2="5.0")
query("elastic_net", _coef_sql(_EN, f"avg(price) - avg(q) * ({_EN})"))(_coef(lambda: L.ElasticNet(alpha=10.0, l1_ratio=0.5), ["q"]))
query("lasso_lars", _coef_sql(_LASSO, f"avg(price) - avg(q) * ({_LASSO})"))(_coef(lambda: L.LassoLars(alpha=10.0), ["q"]))
query("lars", _coef_sql("regr_slope(price, q)", "regr_intercept(price, q)"))(_coef(L.Lars, ["q"]))
query("orthogonal_matching_pursuit", _two("0.0"))(_coef(lambda: L.OrthogonalMatchingPursuit(n_nonzero_coefs=2), ["q", "d"]))
for _n, _m in {
    "lasso_lars_ic": lambda: L.LassoLarsIC(alphas=(0.1, 1.0, 10.0)), "lars_cv": L.LarsCV, "lasso_lars_cv": L.LassoLarsCV, "lasso_cv": L.LassoCV, "elastic_net_cv": L.ElasticNetCV, "ridge_cv": L.RidgeCV, "orthogonal_matching_pursuit_cv": L.OrthogonalMatchingPursuitCV,
    "bayesian_ridge": L.BayesianRidge, "ard_regression": L.ARDRegression, "huber_regressor": L.HuberRegressor, "quantile_regressor": L.QuantileRegressor, "ransac_regressor": lambda: L.RANSACRegressor(max_trials=30), "theil_sen_regressor": lambda: L.TheilSenRegressor(n_subsamples=60),
    "sgd_regressor": lambda: L.SGDRegressor(max_iter=3), "passive_aggressive_regressor": lambda: L.PassiveAggressiveRegressor(max_iter=1), "poisson_regressor": L.PoissonRegressor, "gamma_regressor": L.GammaRegressor, "tweedie_regressor": L.TweedieRegressor,
    "linear_svr": W.LinearSVR, "nu_svr": W.NuSVR, "svr_linear": W.SVR,
}.items():
    query(_n)(_coef(_m))


def _many(make):
    def run(s, d):
        m = make().fit(lines(s, d), X, ["price", "status"])
        return s.createDataFrame([(y, f, round(float(m.coef_[k][j]), 4)) for k, y in enumerate(m.labels_) for j, f in enumerate(X)], "target string, term string, value double")

    return run


for _n, _m in {"multi_task_lasso": lambda: L.MultiTaskLasso(alpha=0.5), "multi_task_lasso_cv": L.MultiTaskLassoCV, "multi_task_elastic_net": lambda: L.MultiTaskElasticNet(alpha=0.5), "multi_task_elastic_net_cv": L.MultiTaskElasticNetCV}.items():
    query(_n)(_many(_m))


def _regress(make, features=X, rows=lines, label="price"):
    """Scores of predictions for all rows."""

    def run(s, d):
        df = rows(s, d)
        out = make().fit(df, features, label).predict(df)
        return rounded(out.agg(M.r2_score(label, "prediction").alias("r2"), M.mean_absolute_error(label, "prediction").alias("mae"), F.count("*").alias("n")), 4)

    return run


E = [f"e{i}" for i in range(64)]


def vectors(s, d):
    """All embeddings by coordinate, their label, and a number that depends on them."""
    e = table(s, d, "embeddings").select("vec_id", F.col("label").cast("int").alias("label"), *(F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)))
    return e.withColumn("target", F.col("e0") * 2 - F.col("e1") + F.col("e2") * F.col("e3") * 5)


for _n, _m in {
    "decision_tree_regressor": lambda: T.DecisionTreeRegressor(max_depth=4), "extra_tree_regressor": lambda: T.ExtraTreeRegressor(max_depth=4), "random_forest_regressor": lambda: T.RandomForestRegressor(n_estimators=5, max_depth=4), "extra_trees_regressor": lambda: T.ExtraTreesRegressor(n_estimators=5, max_depth=4),
    "gradient_boosting_regressor": lambda: T.GradientBoostingRegressor(n_estimators=10), "hist_gradient_boosting_regressor": lambda: T.HistGradientBoostingRegressor(max_iter=10), "ada_boost_regressor": lambda: T.AdaBoostRegressor(n_estimators=5), "xgb_regressor": lambda: T.XGBRegressor(n_estimators=10, max_depth=3), "cat_boost_regressor": lambda: T.CatBoostRegressor(n_estimators=10, max_depth=3),
    "mlp_regressor": lambda: R.MLPRegressor(hidden_layer_sizes=(8,), max_iter=3),
    "voting_regressor": lambda: O.VotingRegressor(estimators=(("a", L.LinearRegression()), ("b", L.Ridge(alpha=10.0)))), "bagging_regressor": lambda: O.BaggingRegressor(base_estimator=L.LinearRegression(), n_estimators=3), "stacking_regressor": lambda: O.StackingRegressor(base_estimators=(("a", L.LinearRegression()), ("b", T.DecisionTreeRegressor(max_depth=3))), meta=L.Ridge()),
    "transformed_target_regressor": lambda: O.TransformedTargetRegressor(regressor=L.LinearRegression(), transformer=StandardScaler()), "pipeline_regression": lambda: O.Pipeline([("scale", StandardScaler()), ("model", L.Ridge())]),
}.items():
    query(_n)(_regress(_m))
for _n, _m in {"svr_rbf": lambda: W.SVR(kernel="rbf", C=100.0), "gaussian_process_regressor": lambda: V.GaussianProcessRegressor(alpha=1e-3)}.items():
    query(_n)(_regress(_m, E, vectors, "target"))
query("dummy_regressor", f"SELECT round(avg(price), 6) AS prediction, count(*) AS n FROM {LINE_SQL}")(lambda s, d: rounded(B.DummyRegressor().fit(lines(s, d), X, "price").predict(lines(s, d)).groupBy("prediction").agg(F.count("*").alias("n"))))
query("dummy_regressor_quantile", f"SELECT round(quantile_cont(price, 0.9), 6) AS prediction, count(*) AS n FROM {LINE_SQL}")(lambda s, d: rounded(B.DummyRegressor(strategy="quantile", quantile=0.9).fit(lines(s, d), X, "price").predict(lines(s, d)).groupBy("prediction").agg(F.count("*").alias("n"))))


# -- classifiers ------------------------------------------------------------------------------------------------------
def _classify(make, label="status", features=("q", "price", "d"), rows=lines):
    def run(s, d):
        df = rows(s, d)
        out = make().fit(df, list(features), label).predict(df)
        return rounded(out.agg(M.accuracy_score(label, "prediction").alias("accuracy"), F.avg(F.array_max("probability")).alias("confidence"), F.count("*").alias("n")), 4)

    return run


for _n, _m in {
    "logistic_regression": L.LogisticRegression, "logistic_regression_cv": lambda: L.LogisticRegressionCV(cv=2), "ridge_classifier": L.RidgeClassifier, "ridge_classifier_cv": lambda: L.RidgeClassifierCV(cv=2), "sgd_classifier": lambda: L.SGDClassifier(max_iter=3), "passive_aggressive_classifier": lambda: L.PassiveAggressiveClassifier(max_iter=1), "perceptron": lambda: L.Perceptron(max_iter=1),
    "linear_svc": W.LinearSVC, "nu_svc": W.NuSVC, "linear_discriminant_analysis": B.LinearDiscriminantAnalysis, "quadratic_discriminant_analysis": B.QuadraticDiscriminantAnalysis, "complement_nb": B.ComplementNB, "categorical_nb": B.CategoricalNB,
    "decision_tree_classifier": lambda: T.DecisionTreeClassifier(max_depth=4), "extra_tree_classifier": lambda: T.ExtraTreeClassifier(max_depth=4), "random_forest_classifier": lambda: T.RandomForestClassifier(n_estimators=5, max_depth=4), "extra_trees_classifier": lambda: T.ExtraTreesClassifier(n_estimators=5, max_depth=4),
    "gradient_boosting_classifier": lambda: T.GradientBoostingClassifier(n_estimators=5), "hist_gradient_boosting_classifier": lambda: T.HistGradientBoostingClassifier(max_iter=5), "ada_boost_classifier": lambda: T.AdaBoostClassifier(n_estimators=5), "xgb_classifier": lambda: T.XGBClassifier(n_estimators=5, max_depth=3), "cat_boost_classifier": lambda: T.CatBoostClassifier(n_estimators=5, max_depth=3),
    "mlp_classifier": lambda: R.MLPClassifier(hidden_layer_sizes=(8,), max_iter=2),
    "voting_classifier": lambda: O.VotingClassifier(estimators=(("a", B.GaussianNB()), ("b", L.LogisticRegression())), voting="soft"), "bagging_classifier": lambda: O.BaggingClassifier(base_estimator=B.GaussianNB(), n_estimators=3), "stacking_classifier": lambda: O.StackingClassifier(base_estimators=(("a", B.GaussianNB()), ("b", T.DecisionTreeClassifier(max_depth=3))), meta=L.LogisticRegression()),
    "calibrated_classifier_cv": lambda: O.CalibratedClassifierCV(base_estimator=B.GaussianNB()), "calibrated_classifier_cv_isotonic": lambda: O.CalibratedClassifierCV(base_estimator=B.GaussianNB(), method="isotonic"),
}.items():
    query(_n)(_classify(_m, features=("q", "d", "t") if _n == "categorical_nb" else ("q", "price", "d")))
for _n, _m in {"one_vs_rest_classifier": lambda: O.OneVsRestClassifier(estimator_factory=L.LogisticRegression), "one_vs_one_classifier": lambda: O.OneVsOneClassifier(estimator_factory=B.GaussianNB), "output_code_classifier": lambda: O.OutputCodeClassifier(estimator_factory=B.GaussianNB), "logistic_regression_multinomial": L.LogisticRegression}.items():
    query(_n)(_classify(_m, "flag"))
for _n, _m in {
    "svc": W.SVC, "gaussian_process_classifier": V.GaussianProcessClassifier,
}.items():
    query(_n)(_classify(_m, "label", E, vectors))


def _half(s, d):
    return vectors(s, d).withColumn("known", F.when(F.col("vec_id") % 3 == 0, -1).otherwise(F.col("label")))


for _n, _m in {"label_propagation": V.LabelPropagation, "label_spreading": V.LabelSpreading, "self_training_classifier": V.SelfTrainingClassifier}.items():
    query(_n)(lambda s, d, m=_m: rounded(m().fit(_half(s, d), E, "known").predict(_half(s, d)).agg(M.accuracy_score("label", "prediction").alias("accuracy"), F.count("*").alias("n")), 4))

_NB = f"""WITH x AS (SELECT l_orderkey, l_linenumber, CAST(q AS DOUBLE) AS q, CAST(price AS DOUBLE) AS price, status FROM {LINE_SQL}), m AS (SELECT status, avg(q) AS mq, var_pop(q) AS vq, avg(price) AS mp, var_pop(price) AS vp, ln(count(*) / (SELECT count(*) FROM x)) AS pr FROM x GROUP BY status),
    z AS (SELECT x.*, m.status AS c, pr - 0.5 * (pow(q - mq, 2) / vq + ln(2 * pi() * vq) + pow(price - mp, 2) / vp + ln(2 * pi() * vp)) AS s FROM x, m),
    w AS (SELECT max(CASE WHEN c = 1 THEN s END) - max(CASE WHEN c = 0 THEN s END) AS odds, q, price, status FROM z GROUP BY l_orderkey, l_linenumber, q, price, status)
    SELECT status, CASE WHEN odds > 0 THEN 1 ELSE 0 END AS prediction, count(*) AS n FROM w GROUP BY 1, 2"""


def _distinct_lines(s, d):
    return lines(s, d).select("l_orderkey", "l_linenumber", "q", "price", "status").distinct()


@query("gaussian_nb", _NB)
def _gaussian_nb(s, d):
    m = B.GaussianNB().fit(lines(s, d), ["q", "price"], "status")
    return m.predict(_distinct_lines(s, d)).groupBy("status", "prediction").agg(F.count("*").alias("n"))


_CNT = "(SELECT flag, sum(q) AS q, sum(d) AS d, sum(t) AS t, count(*) AS n FROM {l} GROUP BY flag)".format(l=LINE_SQL)
query("multinomial_nb", f"SELECT flag, round(ln((q + 1) / (q + d + t + 3)), 6) AS q, round(ln((d + 1) / (q + d + t + 3)), 6) AS d, round(ln((t + 1) / (q + d + t + 3)), 6) AS t FROM {_CNT}")(lambda s, d: (lambda m: s.createDataFrame([(int(c), *(round(float(v), 6) for v in r)) for c, r in zip(m.classes_, m.feature_log_prob_, strict=True)], "flag int, q double, d double, t double"))(B.MultinomialNB().fit(lines(s, d), X, "flag")))
_BER = "(SELECT flag, sum(CASE WHEN q > 25 THEN 1.0 ELSE 0.0 END) AS q, sum(CASE WHEN d > 25 THEN 1.0 ELSE 0.0 END) AS d, count(*) AS n FROM {l} GROUP BY flag)".format(l=LINE_SQL)
query("bernoulli_nb", f"SELECT flag, round((q + 1) / (n + 2), 6)::DOUBLE AS q, round((d + 1) / (n + 2), 6)::DOUBLE AS d FROM {_BER}")(lambda s, d: (lambda m: s.createDataFrame([(int(c), *(round(float(v), 6) for v in r)) for c, r in zip(m.classes_, m.feature_prob_, strict=True)], "flag int, q double, d double"))(B.BernoulliNB(binarize=25.0).fit(lines(s, d), ["q", "d"], "flag")))
query("nearest_centroid", f"""WITH x AS (SELECT DISTINCT l_orderkey, l_linenumber, CAST(q AS DOUBLE) AS q, CAST(price AS DOUBLE) AS price, status FROM {LINE_SQL}), m AS (SELECT status AS c, avg(q) AS mq, avg(price) AS mp FROM {LINE_SQL} GROUP BY 1),
    z AS (SELECT x.*, max(CASE WHEN c = 1 THEN v END) AS d1, max(CASE WHEN c = 0 THEN v END) AS d0 FROM (SELECT x.*, c, sqrt(pow(q - mq, 2) + pow(price - mp, 2)) AS v FROM x, m) x GROUP BY ALL)
    SELECT status, CASE WHEN d1 < d0 THEN 1 ELSE 0 END AS prediction, count(*) AS n FROM (SELECT l_orderkey, l_linenumber, q, price, status, min(d1) AS d1, min(d0) AS d0 FROM z GROUP BY 1, 2, 3, 4, 5) GROUP BY 1, 2""")(lambda s, d: N.NearestCentroid().fit(lines(s, d), ["q", "price"], "status").predict(_distinct_lines(s, d)).groupBy("status", "prediction").agg(F.count("*").alias("n")))
query("dummy_classifier", f"SELECT flag AS prediction, (SELECT count(*) FROM lineitem) AS n FROM (SELECT flag, count(*) AS c FROM {LINE_SQL} GROUP BY flag ORDER BY c DESC, flag LIMIT 1)")(lambda s, d: B.DummyClassifier().fit(lines(s, d), X, "flag").predict(lines(s, d)).groupBy("prediction").agg(F.count("*").alias("n")))


@query("multi_output_regressor")
def _multi_output(s, d):
    df = lines(s, d)
    out = O.MultiOutputRegressor(estimator_factory=L.LinearRegression).fit(df, ["q", "d"], ["price", "t"]).predict(df)
    return rounded(out.agg(M.r2_score("price", "prediction_price").alias("price"), M.r2_score("t", "prediction_t").alias("t")), 4)


@query("multi_output_classifier")
def _multi_class(s, d):
    df = lines(s, d)
    out = O.MultiOutputClassifier(estimator_factory=B.GaussianNB).fit(df, ["q", "price"], ["status", "flag"]).predict(df)
    return rounded(out.agg(M.accuracy_score("status", "prediction_status").alias("status"), M.accuracy_score("flag", "prediction_flag").alias("flag")), 4)


def _chain(cls, factory, labels, metric):
    def run(s, d):
        df = lines(s, d).withColumns({f"true_{y}": F.col(y) for y in labels})
        out = cls(estimator_factory=factory).fit(df, ["q", "d"], labels).predict(df)
        return rounded(out.agg(*(metric(f"true_{y}", f"prediction_{y}").alias(y) for y in labels)), 4)

    return run


query("classifier_chain")(_chain(O.ClassifierChain, B.GaussianNB, ["status", "flag"], M.accuracy_score))
query("regressor_chain")(_chain(O.RegressorChain, L.LinearRegression, ["price", "t"], M.r2_score))

# -- neighbours -------------------------------------------------------------------------------------------------------
_NEAR = "(SELECT a.vec_id AS qid, b.vec_id AS rid, list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS dist FROM embeddings a, embeddings b)"
_KNN = f"(SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, rid) AS k FROM {_NEAR})"
query("nearest_neighbors", f"SELECT qid, rid, round(dist, 6) AS dist FROM {_KNN} WHERE k <= 5")(lambda s, d: rounded(N.NearestNeighbors().fit(vectors(s, d), E, key="vec_id").kneighbors(vectors(s, d), "vec_id")))
query("radius_neighbors", f"SELECT qid, rid, round(dist, 6) AS dist FROM {_NEAR} WHERE dist <= 1.12")(lambda s, d: rounded(N.NearestNeighbors(radius=1.12).fit(vectors(s, d), E, key="vec_id").radius_neighbors(vectors(s, d), "vec_id")))
query("kneighbors_transformer", f"SELECT qid, rid, 1.0::DOUBLE AS value FROM {_KNN} WHERE k <= 3")(lambda s, d: N.KNeighborsTransformer(n_neighbors=3, mode="connectivity").fit(vectors(s, d), E, key="vec_id").transform(vectors(s, d), "vec_id"))
query("radius_neighbors_transformer", f"SELECT qid, rid, round(dist, 6) AS value FROM {_NEAR} WHERE dist <= 1.1")(lambda s, d: rounded(N.RadiusNeighborsTransformer(radius=1.1).fit(vectors(s, d), E, key="vec_id").transform(vectors(s, d), "vec_id")))


_TARGET = "(embedding[1]::DOUBLE * 2 - embedding[2]::DOUBLE + embedding[3]::DOUBLE * embedding[4]::DOUBLE * 5)"


def _vote_sql(near):
    return f"""WITH v AS (SELECT qid, label, count(*) AS c, sum(count(*)) OVER (PARTITION BY qid) AS z FROM {near} k JOIN embeddings e ON e.vec_id = rid GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY c DESC, label) AS r FROM v)
    SELECT round(avg(CASE WHEN b.label = e.label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS accuracy, round(avg(CAST(c AS DOUBLE) / z), 4) AS confidence, count(*) AS n FROM b JOIN embeddings e ON e.vec_id = qid WHERE r = 1"""


def _mean_sql(near):
    return f"""WITH t AS (SELECT vec_id, {_TARGET} AS y FROM embeddings), p AS (SELECT qid, avg(y) AS p FROM {near} k JOIN t ON vec_id = rid GROUP BY 1)
    SELECT round(1 - avg(pow(y - p, 2)) / var_pop(y), 4) AS r2, round(avg(abs(y - p)), 4) AS mae, count(*) AS n FROM p JOIN t ON vec_id = qid"""


_FIVE, _BALL = f"(SELECT * FROM {_KNN} WHERE k <= 5)", f"(SELECT * FROM {_NEAR} WHERE dist <= 1.2)"
query("kneighbors_classifier", _vote_sql(_FIVE))(_classify(N.KNeighborsClassifier, "label", E, vectors))
query("radius_neighbors_classifier", _vote_sql(_BALL))(_classify(lambda: N.RadiusNeighborsClassifier(radius=1.2), "label", E, vectors))
query("kneighbors_regressor", _mean_sql(_FIVE))(_regress(N.KNeighborsRegressor, E, vectors, "target"))
query("radius_neighbors_regressor", _mean_sql(_BALL))(_regress(lambda: N.RadiusNeighborsRegressor(radius=1.2), E, vectors, "target"))


# -- clusterings ------------------------------------------------------------------------------------------------------
def _sizes(df):
    return df.groupBy("prediction").agg(F.count("*").alias("n"))


for _n, _m in {"kmeans": lambda: C.KMeans(n_clusters=4, max_iter=20), "mini_batch_kmeans": lambda: C.MiniBatchKMeans(n_clusters=4), "bisecting_kmeans": lambda: C.BisectingKMeans(n_clusters=4, max_iter=20), "birch": lambda: C.Birch(n_clusters=4, threshold=10.0), "spectral_biclustering": lambda: C.SpectralBiclustering(n_clusters=2), "spectral_coclustering": lambda: C.SpectralCoclustering(n_clusters=2)}.items():
    query(_n)(lambda s, d, m=_m: _sizes(m().fit(lines(s, d), ["q", "price", "d"]).predict(lines(s, d))))
query("gaussian_mixture")(lambda s, d: _sizes(C.GaussianMixture(n_components=2, max_iter=10).fit(lines(s, d), ["q", "price"]).predict(lines(s, d))))
query("gaussian_mixture_single", f"SELECT round(avg(-0.5 * (pow(q - m, 2) / (v + 1e-6) + ln(v + 1e-6) + ln(2 * pi()))), 4) AS score FROM {LINE_SQL} x, (SELECT avg(q) AS m, var_pop(q) AS v FROM {LINE_SQL})")(lambda s, d: rounded(C.GaussianMixture(max_iter=3).fit(lines(s, d), ["q"]).score_samples(lines(s, d)).agg(F.avg("score").alias("score")), 4))
query("bayesian_gaussian_mixture")(lambda s, d: _sizes(C.BayesianGaussianMixture(n_components=2, max_iter=10).fit(lines(s, d), ["q", "price"]).predict(lines(s, d))))
for _n, _m in {
    "agglomerative_clustering": lambda: C.AgglomerativeClustering(n_clusters=5), "optics": lambda: C.OPTICS(eps=1.15), "mean_shift": lambda: C.MeanShift(bandwidth=1.3, max_iter=30), "affinity_propagation": lambda: C.AffinityPropagation(max_iter=50), "spectral_clustering": lambda: C.SpectralClustering(n_clusters=4),
}.items():
    query(_n)(lambda s, d, m=_m: _sizes(m().fit(vectors(s, d), E, key="vec_id").predict(vectors(s, d))))
query("dbscan", """WITH RECURSIVE x AS (SELECT s_suppkey AS id, CAST(s_acctbal AS DOUBLE) AS v FROM supplier), e AS (SELECT a.id AS a, b.id AS b FROM x a, x b WHERE abs(a.v - b.v) <= 150),
    core AS (SELECT a AS id FROM e GROUP BY a HAVING count(*) >= 4), o AS (SELECT x.id, v, CASE WHEN v - lag(v) OVER (ORDER BY v) <= 150 THEN 0 ELSE 1 END AS fresh FROM x JOIN core ON x.id = core.id),
    g AS (SELECT id, sum(fresh) OVER (ORDER BY v) AS g FROM o), r AS (SELECT id, min(id) OVER (PARTITION BY g) AS root FROM g), n AS (SELECT root, row_number() OVER (ORDER BY root) - 1 AS k FROM (SELECT DISTINCT root FROM r)),
    p AS (SELECT e.a AS id, min(CASE WHEN e.a = e.b THEN r.root END) AS own, min(r.root) AS reached FROM e JOIN r ON e.b = r.id GROUP BY e.a)
    SELECT x.id, CAST(coalesce(n.k, -1) AS INTEGER) AS prediction FROM x LEFT JOIN p ON x.id = p.id LEFT JOIN n ON n.root = coalesce(p.own, p.reached)""")(lambda s, d: C.DBSCAN(eps=150.0, min_samples=4).fit_predict(table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").cast("double").alias("v")), ["v"], "id").select("id", "prediction"))
query("feature_agglomeration", f"SELECT round(avg(CAST(q AS DOUBLE)), 4) AS hi, round(avg((CAST(d AS DOUBLE) + t) / 2), 4) AS lo FROM {LINE_SQL}")(lambda s, d: rounded(C.FeatureAgglomeration(n_clusters=2).fit_transform(lines(s, d).select(*X), X).agg(F.greatest(F.avg("cluster_0"), F.avg("cluster_1")).alias("hi"), F.least(F.avg("cluster_0"), F.avg("cluster_1")).alias("lo")), 4))


# -- decompositions ---------------------------------------------------------------------------------------------------
def _spread(make, features=("q", "price", "d", "t"), rows=lines, label=None, key=None):
    """The population variances of the outputs."""

    def run(s, d):
        df = rows(s, d)
        t = make()
        out = t.fit(df, list(features), label, **({"key": key} if key else {})).transform(df)
        names = t.outputs()
        return rounded(s.createDataFrame([tuple(out.agg(*(F.var_pop(F.col(f"`{n}`")) for n in names)).first())], ", ".join(f"v{i} double" for i in range(len(names)))), 4)

    return run


query("pca", f"SELECT round((a + c) / 2 + sqrt(pow((a - c) / 2, 2) + b * b), 4) AS v0, round((a + c) / 2 - sqrt(pow((a - c) / 2, 2) + b * b), 4) AS v1 FROM (SELECT var_pop(q) AS a, covar_pop(q, price) AS b, var_pop(price) AS c FROM {LINE_SQL})")(_spread(D.PCA, ("q", "price")))
query("incremental_pca", f"SELECT round((a + c) / 2 + sqrt(pow((a - c) / 2, 2) + b * b), 4) AS v0, round((a + c) / 2 - sqrt(pow((a - c) / 2, 2) + b * b), 4) AS v1 FROM (SELECT var_pop(q) AS a, covar_pop(q, price) AS b, var_pop(price) AS c FROM {LINE_SQL})")(lambda s, d: (lambda df: (lambda m: rounded(m.transform(df).agg(F.var_pop("pc0").alias("v0"), F.var_pop("pc1").alias("v1")), 4))(D.IncrementalPCA().partial_fit(df.filter("status = 0"), ["q", "price"]).partial_fit(df.filter("status = 1"), ["q", "price"])))(lines(s, d)))
query("truncated_svd", f"SELECT round(sqrt((a + c) / 2 + sqrt(pow((a - c) / 2, 2) + b * b)), 3) AS s0, round(sqrt((a + c) / 2 - sqrt(pow((a - c) / 2, 2) + b * b)), 3) AS s1 FROM (SELECT CAST(sum(q * q) AS DOUBLE) AS a, CAST(sum(q * price) AS DOUBLE) AS b, CAST(sum(price * price) AS DOUBLE) AS c FROM {LINE_SQL})")(lambda s, d: (lambda m: value(s, s0=round(m.singular_values_[0], 3), s1=round(m.singular_values_[1], 3)))(D.TruncatedSVD(n_components=2).fit(lines(s, d), ["q", "price"])))
for _n, _m in {
    "sparse_pca": lambda: D.SparsePCA(n_components=2, alpha=0.1), "mini_batch_sparse_pca": lambda: D.MiniBatchSparsePCA(n_components=2, alpha=0.1), "factor_analysis": lambda: D.FactorAnalysis(n_components=2), "fast_ica": lambda: D.FastICA(n_components=2, max_iter=30), "nmf": lambda: D.NMF(max_iter=20), "mini_batch_nmf": lambda: D.MiniBatchNMF(max_iter=20),
    "dictionary_learning": lambda: D.DictionaryLearning(max_iter=10), "mini_batch_dictionary_learning": lambda: D.MiniBatchDictionaryLearning(max_iter=10), "latent_dirichlet_allocation": lambda: D.LatentDirichletAllocation(n_components=2, max_iter=5), "gaussian_random_projection": lambda: D.GaussianRandomProjection(n_components=2), "sparse_random_projection": lambda: D.SparseRandomProjection(n_components=2),
    "bernoulli_rbm": lambda: R.BernoulliRBM(n_components=3, n_iter=3), "random_trees_embedding": lambda: T.RandomTreesEmbedding(n_estimators=3, max_depth=3),
}.items():
    query(_n)(_spread(_m))
query("lda")(_spread(D.LDA, ("q", "price", "d"), label="flag"))
for _n, _m in {"kernel_pca": lambda: D.KernelPCA(n_components=2), "mds": D.MDS, "locally_linear_embedding": D.LocallyLinearEmbedding, "spectral_embedding": D.SpectralEmbedding, "isomap": D.Isomap}.items():
    query(_n)(_spread(_m, E, vectors, key="vec_id"))
query("tsne")(lambda s, d: rounded(D.TSNE(max_iter=60).fit(vectors(s, d), E, key="vec_id").transform(vectors(s, d)).agg(F.count("embed0").alias("n"), (F.abs(F.avg("embed0")) < 1).cast("int").alias("centred"))))


def _views(make):
    def run(s, d):
        m = make().fit(lines(s, d), ["q", "d"], ["price", "t"])
        out = m.transform(lines(s, d))
        return rounded(out.agg(F.abs(F.corr("x_score0", "y_score0")).alias("r0"), F.var_samp("x_score0").alias("vx"), F.var_samp("y_score0").alias("vy")), 4)

    return run


for _n, _m in {"pls_canonical": D.PLSCanonical, "pls_regression": D.PLSRegression, "pls_svd": D.PLSSVD, "cca": D.CCA}.items():
    query(_n)(_views(_m))
query("cca_single", f"SELECT round(abs(corr(q, price)), 6) AS r FROM {LINE_SQL}")(lambda s, d: value(s, r=round(float(D.CCA(n_components=1).fit(lines(s, d), ["q"], ["price"]).correlations_[0]), 6)))


# -- covariances, densities, outliers ---------------------------------------------------------------------------------
def _cov(make):
    def run(s, d):
        m = make().fit(lines(s, d), ["q", "price"])
        c = m.covariance_
        return value(s, qq=round(c[0, 0], 4), qp=round(c[0, 1], 4), pp=round(c[1, 1], 4))

    return run


_S = f"(SELECT var_pop(q) AS a, covar_pop(q, price) AS b, var_pop(price) AS c FROM {LINE_SQL})"
query("empirical_covariance", f"SELECT round(a, 4) AS qq, round(b, 4) AS qp, round(c, 4) AS pp FROM {_S}")(_cov(V.EmpiricalCovariance))
query("shrunk_covariance", f"SELECT round(0.9 * a + 0.1 * (a + c) / 2, 4) AS qq, round(0.9 * b, 4) AS qp, round(0.9 * c + 0.1 * (a + c) / 2, 4) AS pp FROM {_S}")(_cov(V.ShrunkCovariance))
_LW = f"""WITH s AS {_S}, m AS (SELECT avg(q) AS mq, avg(price) AS mp, CAST(count(*) AS DOUBLE) AS n FROM {LINE_SQL}), f AS (SELECT avg(pow(pow(q - mq, 2) + pow(price - mp, 2), 2)) AS f FROM {LINE_SQL} x, m),
    w AS (SELECT a, b, c, least(greatest((f - (a * a + 2 * b * b + c * c)) / n, 0) / (pow(a - (a + c) / 2, 2) + 2 * b * b + pow(c - (a + c) / 2, 2)), 1) AS w FROM s, m, f)"""
query("ledoit_wolf", f"{_LW} SELECT round((1 - w) * a + w * (a + c) / 2, 4) AS qq, round((1 - w) * b, 4) AS qp, round((1 - w) * c + w * (a + c) / 2, 4) AS pp FROM w")(_cov(V.LedoitWolf))
_OAS = f"WITH s AS {_S}, n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM lineitem), w AS (SELECT a, b, c, least(greatest(pow(a + c, 2) / (n * ((a * a + 2 * b * b + c * c) - pow(a + c, 2) / 2)), 0), 1) AS w FROM s, n)"
query("oas", f"{_OAS} SELECT round((1 - w) * a + w * (a + c) / 2, 4) AS qq, round((1 - w) * b, 4) AS qp, round((1 - w) * c + w * (a + c) / 2, 4) AS pp FROM w")(_cov(V.OAS))
query("min_cov_det")(_cov(V.MinCovDet))
query("mahalanobis", f"SELECT round(avg(v), 4) AS mean, round(max(v), 4) AS most FROM (SELECT pow(q - m, 2) / s AS v FROM {LINE_SQL} x, (SELECT avg(q) AS m, var_pop(q) AS s FROM {LINE_SQL}))")(lambda s, d: rounded(V.EmpiricalCovariance().fit(lines(s, d), ["q"]).mahalanobis(lines(s, d)).agg(F.avg("mahalanobis").alias("mean"), F.max("mahalanobis").alias("most")), 4))
for _n, _m in {"elliptic_envelope": V.EllipticEnvelope, "isolation_forest": lambda: V.IsolationForest(n_estimators=20), "one_class_svm": lambda: W.OneClassSVM(nu=0.1, kernel="linear")}.items():
    query(_n)(lambda s, d, m=_m: _sizes(m().fit(lines(s, d), ["q", "price"]).predict(lines(s, d))))
query("one_class_svm_rbf")(lambda s, d: _sizes(W.OneClassSVM(nu=0.2).fit(vectors(s, d), E).predict(vectors(s, d))))
query("local_outlier_factor")(lambda s, d: _sizes(V.LocalOutlierFactor().fit(vectors(s, d), E).predict(vectors(s, d))))
query("kernel_density", "WITH x AS (SELECT s_suppkey AS id, CAST(s_acctbal AS DOUBLE) / 1000 AS v FROM supplier) SELECT a.id, round(ln(avg(exp(-0.5 * pow(a.v - b.v, 2)))) - 0.5 * ln(2 * pi()), 6) AS score FROM x a, x b GROUP BY a.id")(lambda s, d: (lambda df: rounded(V.KernelDensity().fit(df, ["v"]).score_samples(df).select("id", "score")))(table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal").cast("double") / 1000).alias("v"))))


# -- composition, inspection, persistence, streams --------------------------------------------------------------------
@query("feature_union", f'WITH z AS (SELECT avg(q) AS m, stddev_pop(q) AS s, min(q) AS lo, max(q) AS hi FROM {LINE_SQL}) SELECT round(avg((q - m) / s), 4) + 0.0 AS a, round(avg((q - lo) / (hi - lo)), 4) AS b, count(*) AS n FROM {LINE_SQL} x, z')
def _union(s, d):
    out = O.FeatureUnion(transformers=[("a", StandardScaler()), ("b", MinMaxScaler())]).fit_transform(lines(s, d).select("q"), ["q"])
    return out.agg((F.round(F.avg(F.col("`a.q`")), 4) + 0.0).alias("a"), F.round(F.avg(F.col("`b.q`")), 4).alias("b"), F.count("*").alias("n"))


@query("column_transformer", f'WITH z AS (SELECT min(q) AS lo, max(q) AS hi FROM {LINE_SQL}) SELECT round(avg((q - lo) / (hi - lo)), 4) AS q, round(avg(CAST(d AS DOUBLE)), 4) AS d, count(*) AS n FROM {LINE_SQL} x, z')
def _columns(s, d):
    out = O.ColumnTransformer(transformers=[("scaled", MinMaxScaler(), ["q"])], remainder="passthrough").fit_transform(lines(s, d).select("q", "d"), ["q", "d"])
    return out.agg(F.round(F.avg(F.col("`scaled.q`")), 4).alias("q"), F.round(F.avg("d"), 4).alias("d"), F.count("*").alias("n"))


@query("permutation_importance")
def _permutation(s, d):
    df = orders(s, d).withColumn("y", F.col("total") * 2 + F.col("month"))
    m = O.PermutationImportance(estimator=L.LinearRegression(), scoring="r2", n_repeats=2).fit(df, ["total", "month"], "y", "o_orderkey")
    return s.createDataFrame([(f, round(m.importances_mean_[f], 4), round(m.importances_std_[f], 4)) for f in ("total", "month")], "feature string, mean double, std double")


@query("partial_dependence", f"SELECT 'q' AS feature, round(lo + (hi - lo) * i / 4.0, 6) AS value, round(a + b * (lo + (hi - lo) * i / 4.0), 4) AS mean FROM (SELECT min(q) AS lo, max(q) AS hi, regr_slope(price, q) AS b, regr_intercept(price, q) AS a FROM {LINE_SQL}), range(5) t(i)")
def _dependence(s, d):
    m = L.LinearRegression().fit(lines(s, d), ["q"], "price")
    out = O.PartialDependence(estimator=m, features=("q",), grid=5).compute(lines(s, d))
    return out.select("feature", F.round("value", 6).alias("value"), F.round("mean", 4).alias("mean"))


@query("model_persistence", _coef_sql("regr_slope(price, q)", "regr_intercept(price, q)"))
def _persist(s, d):
    m = L.LinearRegression().fit(lines(s, d), ["q"], "price")
    path = f"{shared_folder(s)}/model-{uuid.uuid4().hex}"
    saved.save(s, m, path)
    back = saved.load(s, path)
    return s.createDataFrame([("q", round(float(back.coef_[0]), 4)), ("intercept", round(back.intercept_, 4))], "term string, value double")


def _stream_source(s, d, name):
    """Tables that are one file are read as a stream through their folder, by the file's name."""
    return s.readStream.schema(table(s, d, name).schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{d}/{name}.parquet*")


@query("streaming_regression", "SELECT 'q' AS term, round(regr_slope(l_extendedprice / 1000.0, l_quantity), 4) AS value FROM lineitem UNION ALL SELECT 'intercept', round(regr_intercept(l_extendedprice / 1000.0, l_quantity), 4) FROM lineitem")
def _stream_regression(s, d):
    state = StreamingMoments(["q"], "price")
    rows = _stream_source(s, d, "lineitem").select(F.col("l_quantity").cast("double").alias("q"), (F.col("l_extendedprice").cast("double") / 1000.0).alias("price"))
    rows.writeStream.foreachBatch(state.add).option("checkpointLocation", f"{shared_folder(s)}/stream-{uuid.uuid4().hex}").trigger(availableNow=True).start().awaitTermination()
    m = state.regression()
    return s.createDataFrame([("q", round(float(m.coef_[0]), 4)), ("intercept", round(m.intercept_, 4))], "term string, value double")


@query("streaming_windows", "SELECT date_trunc('hour', ts) AS start, event_type AS by, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _stream_windows(s, d):
    folder = f"{shared_folder(s)}/windows-{uuid.uuid4().hex}"
    out = windowed(_stream_source(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "value", "event_type")
    # the complete result of the last batch stays in a table; nothing of it comes to the driver
    keep = lambda batch, _: batch.write.mode("overwrite").parquet(f"{folder}/rows")
    out.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(f"{folder}/rows").select(F.col("start").cast("timestamp_ntz").alias("start"), "by", "n", F.round("total", 4).alias("total"))


# -- models of one feature or one step, whose results have a closed form ----------------------------------------------
_ROWS = f"(SELECT CAST(q AS DOUBLE) AS q, CAST(d AS DOUBLE) AS d, CAST(price AS DOUBLE) AS price, status, flag FROM {LINE_SQL})"
_BY = f"(SELECT status AS c, avg(q) AS m, var_pop(q) AS v, CAST(count(*) AS DOUBLE) AS n FROM {_ROWS} GROUP BY status)"


def _votes(make):
    return lambda s, d: make().fit(lines(s, d), ["q"], "status").predict(lines(s, d)).groupBy("status", "prediction").agg(F.count("*").alias("n"))


_LDA = f"WITH z AS (SELECT sum(v * n) / (sum(n) - 2) AS p, max(CASE WHEN c = 1 THEN m END) AS m1, max(CASE WHEN c = 0 THEN m END) AS m0, ln(max(CASE WHEN c = 1 THEN n END) / max(CASE WHEN c = 0 THEN n END)) AS o FROM {_BY})"
query("linear_discriminant_analysis_single", f"{_LDA} SELECT status, CASE WHEN q * (m1 - m0) / p - (m1 * m1 - m0 * m0) / (2 * p) + o > 0 THEN 1 ELSE 0 END AS prediction, count(*) AS n FROM {_ROWS} x, z GROUP BY 1, 2")(_votes(B.LinearDiscriminantAnalysis))
_QDA = f"""WITH z AS (SELECT c, m, v * n / (n - 1) AS v, ln(n) AS o FROM {_BY}), w AS (SELECT a.m AS m1, a.v AS v1, a.o AS o1, b.m AS m0, b.v AS v0, b.o AS o0 FROM z a, z b WHERE a.c = 1 AND b.c = 0)"""
query("quadratic_discriminant_analysis_single", f"{_QDA} SELECT status, CASE WHEN -0.5 * (pow(q - m1, 2) / v1 + ln(v1)) + o1 > -0.5 * (pow(q - m0, 2) / v0 + ln(v0)) + o0 THEN 1 ELSE 0 END AS prediction, count(*) AS n FROM {_ROWS} x, w GROUP BY 1, 2")(_votes(B.QuadraticDiscriminantAnalysis))
query("complement_nb_weights", f"WITH a AS (SELECT sum(q) AS q, sum(d) AS d, sum(t) AS t FROM {_CNT}), c AS (SELECT flag, a.q - x.q + 1 AS q, a.d - x.d + 1 AS d, a.t - x.t + 1 AS t FROM {_CNT} x, a) SELECT flag, round(ln(q / (q + d + t)), 6) AS q, round(ln(d / (q + d + t)), 6) AS d, round(ln(t / (q + d + t)), 6) AS t FROM c")(lambda s, d: (lambda m: s.createDataFrame([(int(c), *(round(float(v), 6) for v in r)) for c, r in zip(m.classes_, m.feature_log_prob_, strict=True)], "flag int, q double, d double, t double"))(B.ComplementNB().fit(lines(s, d), X, "flag")))
query("categorical_nb_table", f"WITH g AS (SELECT flag, CAST(count(*) AS DOUBLE) AS n FROM {_ROWS} GROUP BY flag), k AS (SELECT CAST(max(d) + 1 AS DOUBLE) AS k FROM {_ROWS}), v AS (SELECT DISTINCT CAST(round(d) AS BIGINT) AS v FROM {_ROWS}), c AS (SELECT flag, CAST(round(d) AS BIGINT) AS v, CAST(count(*) AS DOUBLE) AS c FROM {_ROWS} GROUP BY 1, 2) SELECT g.flag, v.v AS value, round(ln((coalesce(c, 0) + 1) / (n + k)), 6) AS logp FROM g CROSS JOIN v CROSS JOIN k LEFT JOIN c ON c.flag = g.flag AND c.v = v.v")(lambda s, d: (lambda m: s.createDataFrame([(int(c), j, round(float(m.tables_[0][i, j]), 6)) for i, c in enumerate(m.classes_) for j in range(m.tables_[0].shape[1])], "flag int, value long, logp double"))(B.CategoricalNB().fit(lines(s, d), ["d"], "flag")))
query("pls_svd_single", f"SELECT round(sqrt(pow(corr(q, price), 2) + pow(corr(d, price), 2)), 6) AS s FROM {_ROWS}")(lambda s, d: value(s, s=round(float(D.PLSSVD(n_components=1).fit(lines(s, d), ["q", "d"], ["price"]).singular_values_[0]), 6)))
query("pls_regression_single", _coef_sql("regr_slope(price, q)", "regr_intercept(price, q)"))(lambda s, d: (lambda m: s.createDataFrame([("q", round(float(m.coef_[0][0]), 4)), ("intercept", round(float(m.intercept_[0]), 4))], "term string, value double"))(D.PLSRegression(n_components=1).fit(lines(s, d), ["q"], ["price"])))
query("pls_canonical_single", f"SELECT round(abs(corr(q, price)), 6) AS r FROM {_ROWS}")(lambda s, d: rounded(D.PLSCanonical(n_components=1).fit(lines(s, d), ["q"], ["price"]).transform(lines(s, d)).agg(F.abs(F.corr("x_score0", "y_score0")).alias("r"))))
_SVR = "covar_pop(q, price) / (var_pop(q) + 100.0 / count(*))"
query("svr_linear_single", _coef_sql(_SVR, f"avg(price) - avg(q) * {_SVR}"))(_coef(lambda: W.SVR(C=0.01), ["q"]))
_R2 = f"SELECT round(regr_r2(price, q), 4) AS r2, round((SELECT avg(abs(price - a - b * q)) FROM {_ROWS}, (SELECT regr_slope(price, q) AS b, regr_intercept(price, q) AS a FROM {_ROWS})), 4) AS mae, count(*) AS n FROM {_ROWS}"
for _n, _m in {
    "voting_regressor_single": lambda: O.VotingRegressor(estimators=(("a", L.LinearRegression()), ("b", L.Lars()))), "transformed_target_regressor_single": lambda: O.TransformedTargetRegressor(regressor=L.LinearRegression(), transformer=StandardScaler()),
    "pipeline_single": lambda: O.Pipeline([("scale", MinMaxScaler()), ("model", L.LinearRegression())]),
}.items():
    query(_n, _R2)(_regress(_m, ["q"]))
query("multi_output_regressor_single", f"SELECT round(regr_r2(price, q), 4) AS price, round(regr_r2(d, q), 4) AS d FROM {_ROWS}")(lambda s, d: rounded(O.MultiOutputRegressor(estimator_factory=L.LinearRegression).fit(lines(s, d), ["q"], ["price", "d"]).predict(lines(s, d)).agg(M.r2_score("price", "prediction_price").alias("price"), M.r2_score("d", "prediction_d").alias("d")), 4))
query("kmeans_single", f"SELECT round(avg(q), 3) AS q, round(avg(price), 3) AS price, round((var_pop(q) + var_pop(price)) * count(*) / 1000, 2) AS inertia FROM {_ROWS}")(lambda s, d: (lambda m: value(s, q=round(m.centers_[0][0], 3), price=round(m.centers_[0][1], 3), inertia=round(m.inertia_ / 1000, 2)))(C.KMeans(n_clusters=1).fit(lines(s, d), ["q", "price"])))
# the best cut of one feature, by sums below and above every value
_STUMP = f"""WITH g AS (SELECT q, CAST(count(*) AS DOUBLE) AS n, sum(price) AS s FROM {_ROWS} GROUP BY q), c AS (SELECT q, sum(n) OVER (ORDER BY q) AS n, sum(s) OVER (ORDER BY q) AS s, sum(n) OVER () AS zn, sum(s) OVER () AS zs FROM g),
    b AS (SELECT * FROM c WHERE n < zn ORDER BY s * s / n + pow(zs - s, 2) / (zn - n) DESC, q LIMIT 1)"""


def _stump(make):
    def run(s, d):
        m = make().fit(lines(s, d), ["q"], "price")
        t = m.trees_[0] if "trees_" in vars(m) else m.stages_[0][0]
        return value(s, cut=t.threshold[0], low=round(float(t.value[t.left[0]]), 4), high=round(float(t.value[t.right[0]]), 4))

    return run


query("decision_tree_regressor_stump", f"{_STUMP} SELECT q AS cut, round(s / n, 4) AS low, round((zs - s) / (zn - n), 4) AS high FROM b")(_stump(lambda: T.DecisionTreeRegressor(max_depth=1)))
query("gradient_boosting_regressor_stump", f"{_STUMP} SELECT q AS cut, round(s / n - zs / zn, 4) AS low, round((zs - s) / (zn - n) - zs / zn, 4) AS high FROM b")(_stump(lambda: T.GradientBoostingRegressor(n_estimators=1, max_depth=1)))
query("hist_gradient_boosting_regressor_stump", f"{_STUMP} SELECT q AS cut, round(s / n - zs / zn, 4) AS low, round((zs - s) / (zn - n) - zs / zn, 4) AS high FROM b")(_stump(lambda: T.HistGradientBoostingRegressor(max_iter=1, max_depth=1)))
_XG = f"""WITH g AS (SELECT q, CAST(count(*) AS DOUBLE) AS n, sum(price - m) AS s FROM {_ROWS}, (SELECT avg(price) AS m FROM {_ROWS}) GROUP BY q), c AS (SELECT q, sum(n) OVER (ORDER BY q) AS n, sum(s) OVER (ORDER BY q) AS s, sum(n) OVER () AS zn, sum(s) OVER () AS zs FROM g),
    b AS (SELECT * FROM c WHERE n < zn ORDER BY s * s / (n + 50) + pow(zs - s, 2) / (zn - n + 50) DESC, q LIMIT 1)"""
query("xgb_regressor_stump", f"{_XG} SELECT q AS cut, round(s / (n + 50), 4) AS low, round((zs - s) / (zn - n + 50), 4) AS high FROM b")(_stump(lambda: T.XGBRegressor(n_estimators=1, max_depth=1, reg_lambda=50.0)))
_GINI = f"""WITH g AS (SELECT q, CAST(count(*) AS DOUBLE) AS n, CAST(sum(status) AS DOUBLE) AS s FROM {_ROWS} GROUP BY q), c AS (SELECT q, sum(n) OVER (ORDER BY q) AS n, sum(s) OVER (ORDER BY q) AS s, sum(n) OVER () AS zn, sum(s) OVER () AS zs FROM g),
    b AS (SELECT * FROM c WHERE n < zn ORDER BY (s * s + pow(n - s, 2)) / n + (pow(zs - s, 2) + pow(zn - n - zs + s, 2)) / (zn - n) DESC, q LIMIT 1)"""
query("decision_tree_classifier_stump", f"{_GINI} SELECT q AS cut, round(s / n, 6) AS low, round((zs - s) / (zn - n), 6) AS high FROM b")(lambda s, d: (lambda t: value(s, cut=t.threshold[0], low=round(float(t.value[t.left[0]][1]), 6), high=round(float(t.value[t.right[0]][1]), 6)))(T.DecisionTreeClassifier(max_depth=1).fit(lines(s, d), ["q"], "status").trees_[0]))
query("ridge_classifier_single", f"WITH y AS (SELECT q, status, CASE WHEN status = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS y FROM {_ROWS}), m AS (SELECT covar_pop(q, y) / (var_pop(q) + 1.0 / count(*)) AS b, avg(y) AS a, avg(q) AS mq FROM y) SELECT status, CASE WHEN a + b * (q - mq) > 0 THEN 1 ELSE 0 END AS prediction, count(*) AS n FROM y, m GROUP BY 1, 2")(_votes(L.RidgeClassifier))
