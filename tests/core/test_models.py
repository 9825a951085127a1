"""Estimators against numpy, on tables that are read once and on the distributed passes, and their contracts."""

import numpy as np
import pytest

import tessera.core as core
from tessera.functions import metrics as M
from tessera.operators import bayes, cluster, compose, covariance, decomposition, linear, neighbors, neural, svm, trees
from tessera.operators.preprocessing import MinMaxScaler, StandardScaler
from tessera.sources import models as saved
from tessera.sources.tables import from_numpy, read, to_numpy, write
from tessera.streaming.incremental import StreamingMoments

X = ["f0", "f1", "f2"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(42)
    x = rng.standard_normal((200, 3))
    y = x @ [1.0, -2.0, 0.5] + 3 + 0.1 * rng.standard_normal(200)
    df = from_numpy(spark, x, y).withColumn("c", (core.F.col("f0") + core.F.col("f1") > 0).cast("int")).withColumn("k", (core.F.col("f0") > 0.5).cast("int") + (core.F.col("f0") > -0.5).cast("int")).repartition(3).cache()
    return df, x, y


@pytest.fixture(params=["local", "passes"])
def mode(request, monkeypatch):
    if request.param == "passes":
        monkeypatch.setattr(core, "LOCAL_CELLS", 0)
    return request.param


def test_least_squares_and_ridge(data, mode):
    df, x, y = data
    z = np.column_stack([x, np.ones(len(x))])
    want = np.linalg.lstsq(z, y, rcond=None)[0]
    m = linear.LinearRegression().fit(df, X, "y")
    assert np.allclose([*m.coef_, m.intercept_], want)
    r = linear.Ridge(alpha=5.0).fit(df, X, "y")
    c = x - x.mean(0)
    assert np.allclose(r.coef_, np.linalg.solve(c.T @ c + 5 * np.eye(3), c.T @ (y - y.mean())))
    bare = linear.LinearRegression(fit_intercept=False).fit(df, X, "y")
    assert np.allclose(bare.coef_, np.linalg.lstsq(x, y, rcond=None)[0]) and abs(bare.intercept_) < 1e-9


def test_lasso_meets_its_optimality_conditions(data, mode):
    df, x, y = data
    m = linear.Lasso(alpha=0.3).fit(df, X, "y")
    c, r = x - x.mean(0), y - y.mean()
    g = c.T @ (r - c @ m.coef_) / len(y)
    assert (np.abs(g) <= 0.3 + 1e-6).all() and np.allclose(g[m.coef_ != 0], 0.3 * np.sign(m.coef_[m.coef_ != 0]), atol=1e-5)
    assert (linear.Lasso(alpha=10.0).fit(df, X, "y").coef_ == 0).all()


def test_cross_validated_ridge_picks_by_the_folds(data, mode):
    df, x, y = data
    m = linear.RidgeCV(alphas=(0.01, 1e4), cv=4).fit(df, X, "y")
    fold = linear.fold_of(x, y, 4)
    errors = {}
    for a in (0.01, 1e4):
        e = []
        for k in range(4):
            t = fold != k
            mx, my = x[t].mean(0), y[t].mean()
            b = np.linalg.solve((x[t] - mx).T @ (x[t] - mx) + a * np.eye(3), (x[t] - mx).T @ (y[t] - my))
            e.append((((y[~t] - my) - (x[~t] - mx) @ b) ** 2).mean())
        errors[a] = np.mean(e)
    assert m.best_ == 0.01 and np.allclose([m.errors_[a] for a in errors], list(errors.values()))


def test_logistic_regression_is_at_its_optimum(data, mode):
    df, x, _ = data
    c = (x[:, 0] + x[:, 1] > 0).astype(float)
    m = linear.LogisticRegression(C=0.5).fit(df, X, "c")
    p = 1 / (1 + np.exp(-(x @ m.coef_[0] + m.intercept_[0])))
    assert np.allclose(x.T @ (p - c) + m.coef_[0] / 0.5, 0, atol=1e-3) and abs((p - c).sum()) < 1e-3
    many = linear.LogisticRegression().fit(df, X, "k")
    got = many.predict(df).toPandas()
    assert (got.prediction == got.k).mean() > 0.9 and np.allclose([sum(v) for v in got.probability], 1)


def test_glm_scores_vanish(data, spark, mode):
    df, x, _ = data
    rng = np.random.default_rng(1)
    y = rng.poisson(np.exp(x @ [0.3, -0.2, 0.1] + 0.5)).astype(float)
    t = from_numpy(spark, x, y)
    m = linear.PoissonRegressor().fit(t, X, "y")
    mu = np.exp(x @ m.coef_ + m.intercept_)
    assert np.allclose(np.column_stack([x, np.ones(len(x))]).T @ (mu - y), 0, atol=1e-3)
    with pytest.raises(ValueError):
        linear.GammaRegressor().fit(t, X, "y")


def test_quantile_and_huber(data, mode):
    df, x, y = data
    q = linear.QuantileRegressor(quantile=0.8).fit(df, X, "y")
    assert abs((y <= x @ q.coef_ + q.intercept_).mean() - 0.8) < 0.03
    assert np.allclose(linear.HuberRegressor().fit(df, X, "y").coef_, [1, -2, 0.5], atol=0.05)


@pytest.mark.parametrize("make", [lambda: linear.BayesianRidge(), lambda: linear.ARDRegression(), lambda: linear.OrthogonalMatchingPursuit(), lambda: linear.RANSACRegressor(max_trials=50), lambda: linear.TheilSenRegressor(), lambda: linear.SGDRegressor(max_iter=50), lambda: linear.PassiveAggressiveRegressor(max_iter=3), lambda: svm.LinearSVR(), lambda: svm.SVR(C=100.0), lambda: trees.GradientBoostingRegressor(n_estimators=40), lambda: trees.XGBRegressor(n_estimators=30, max_depth=3), lambda: trees.CatBoostRegressor(n_estimators=60, learning_rate=0.2, max_depth=3), lambda: trees.AdaBoostRegressor(n_estimators=15), lambda: trees.RandomForestRegressor(n_estimators=10, max_features=3), lambda: neighbors.KNeighborsRegressor(), lambda: covariance.GaussianProcessRegressor(alpha=0.01), lambda: neural.MLPRegressor(hidden_layer_sizes=(16,), max_iter=80, batch_size=20, learning_rate=0.01)])
def test_regressors_fit(data, make):
    df, _, _ = data
    out = make().fit(df, X, "y").predict(df)
    assert out.agg(M.r2_score("y", "prediction")).first()[0] > 0.85


@pytest.mark.parametrize("make", [lambda: linear.RidgeClassifier(), lambda: linear.SGDClassifier(max_iter=50), lambda: linear.Perceptron(max_iter=5), lambda: linear.PassiveAggressiveClassifier(max_iter=5), lambda: svm.LinearSVC(), lambda: svm.SVC(), lambda: bayes.GaussianNB(), lambda: bayes.LinearDiscriminantAnalysis(), lambda: bayes.QuadraticDiscriminantAnalysis(), lambda: trees.DecisionTreeClassifier(), lambda: trees.ExtraTreesClassifier(n_estimators=20), lambda: trees.RandomForestClassifier(n_estimators=10), lambda: trees.GradientBoostingClassifier(n_estimators=20), lambda: trees.XGBClassifier(n_estimators=20, max_depth=3), lambda: trees.CatBoostClassifier(n_estimators=40, learning_rate=0.3, max_depth=3), lambda: trees.AdaBoostClassifier(n_estimators=30), lambda: neighbors.KNeighborsClassifier(), lambda: covariance.GaussianProcessClassifier(), lambda: neural.MLPClassifier(hidden_layer_sizes=(8,), max_iter=60, batch_size=20, learning_rate=0.02)])
def test_classifiers_fit(data, make):
    df, _, _ = data
    got = make().fit(df, X, "c").predict(df).toPandas()
    assert (got.prediction == got.c).mean() > 0.85
    p = np.array(got.probability.tolist())
    assert np.allclose(p.sum(1), 1) and (p >= 0).all() and set(got.prediction) <= {0, 1}


def test_a_tree_is_the_exhaustive_one(data, mode):
    df, x, _ = data
    c = (x[:, 0] + x[:, 1] > 0).astype(int)
    t = trees.DecisionTreeClassifier(max_depth=1).fit(df, X, "c").trees_[0]

    def cost(at):
        return sum(len(v) * (1 - sum((v == k).mean() ** 2 for k in (0, 1))) for v in (c[at], c[~at]) if len(v))

    best = min((cost(x[:, j] <= v), j, v) for j in range(3) for v in np.sort(x[:, j])[:-1])
    assert (t.feature[0], t.threshold[0]) == (best[1], best[2])


def test_contracts(data, spark):
    df, _, _ = data
    m = linear.Ridge()
    assert not m.is_fitted and m.get_params()["alpha"] == 1.0 and m.clone(alpha=2.0).alpha == 2.0
    with pytest.raises(core.NotFittedError):
        m.predict(df)
    with pytest.raises(ValueError):
        m.set_params(nonsense=1)
    with pytest.raises(ValueError):
        m.fit(df, ["absent"], "y")
    with pytest.raises(ValueError):
        m.fit(df.filter("false"), X, "y")
    with pytest.raises(ValueError):
        m.fit(df, X, "y").predict(df.drop("f1"))
    with pytest.raises(ValueError):
        bayes.GaussianNB().fit(df.filter("c = 1"), X, "c")
    with pytest.raises(ValueError):
        neighbors.KNeighborsClassifier(n_neighbors=500).fit(df, X, "c")


def test_clusters(spark, mode):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.standard_normal((40, 2)) * 0.3 + c for c in ([4, 4], [-4, -4], [0, 0])])
    df = from_numpy(spark, x, np.repeat([0, 1, 2], 40))
    for make in (lambda: cluster.KMeans(n_clusters=3), lambda: cluster.BisectingKMeans(n_clusters=3), lambda: cluster.MiniBatchKMeans(n_clusters=3), lambda: cluster.GaussianMixture(n_components=3), lambda: cluster.Birch(n_clusters=3)):
        assert M.adjusted_rand_score(make().fit(df, ["f0", "f1"]).predict(df), "y", "prediction") > 0.95
    for make in (lambda: cluster.AgglomerativeClustering(n_clusters=3), lambda: cluster.SpectralClustering(n_clusters=3), lambda: cluster.MeanShift(bandwidth=1.5), lambda: cluster.OPTICS(eps=1.0)):
        assert M.adjusted_rand_score(make().fit(df, ["f0", "f1"], key="_rid").predict(df), "y", "prediction") > 0.95
    got = cluster.DBSCAN(eps=0.8, min_samples=4).fit_predict(df, ["f0", "f1"], "_rid")
    assert M.adjusted_rand_score(got, "y", "prediction") > 0.95


def test_components_and_covariances(data, mode):
    df, x, y = data
    c = np.cov(x.T, bias=True)
    p = decomposition.PCA(n_components=2).fit(df, X)
    assert np.allclose(p.explained_variance_, np.sort(np.linalg.eigvalsh(c))[::-1][:2])
    assert np.allclose(covariance.EmpiricalCovariance().fit(df, X).covariance_, c)
    full = decomposition.PCA().fit(df, X)
    back = full.inverse_transform(full.transform(df))
    r = back.toPandas().sort_values("_rid")
    assert np.allclose(r[X].to_numpy(), x)
    s = np.linalg.svd(x, compute_uv=False)
    assert np.allclose(decomposition.TruncatedSVD(n_components=3).fit(df, X).singular_values_, s)
    cca = decomposition.CCA(n_components=1).fit(df, X, ["y"])
    fit = np.column_stack([x, np.ones(len(x))]) @ np.linalg.lstsq(np.column_stack([x, np.ones(len(x))]), y, rcond=None)[0]
    assert abs(cca.correlations_[0] - np.corrcoef(fit, y)[0, 1]) < 1e-6
    pls = decomposition.PLSRegression(n_components=1).fit(df, X, ["y"]).predict(df)
    assert pls.agg(M.r2_score("y", "prediction_y")).first()[0] > 0.9


def test_composition(data):
    df, x, y = data
    pipe = compose.Pipeline([("scale", StandardScaler()), ("m", linear.LinearRegression())]).fit(df, X, "y")
    plain = linear.LinearRegression().fit(df, X, "y")
    a, b = (m.predict(df).toPandas().sort_values("_rid").prediction for m in (pipe, plain))
    assert np.allclose(a, b)
    t = compose.TransformedTargetRegressor(regressor=linear.LinearRegression(), transformer=MinMaxScaler()).fit(df, X, "y").predict(df).toPandas().sort_values("_rid")
    assert np.allclose(t.prediction, b) and np.allclose(t.y, y)
    vote = compose.VotingRegressor(estimators=(("a", linear.LinearRegression()), ("b", linear.LinearRegression()))).fit(df, X, "y").predict(df).toPandas().sort_values("_rid")
    assert np.allclose(vote.prediction, b)
    iso = compose.IsotonicRegression().fit(df, ["f1"], "y")
    assert (np.diff(iso.y_) >= 0).all()


def test_saved_models(data, spark, tmp_path):
    df, _, _ = data
    for m in (StandardScaler().fit(df, X), linear.LogisticRegression().fit(df, X, "c"), trees.RandomForestClassifier(n_estimators=3).fit(df, X, "c"), bayes.GaussianNB().fit(df, X, "c"), neighbors.KNeighborsRegressor().fit(df, X, "y"), trees.GradientBoostingRegressor(n_estimators=3).fit(df, X, "y"), svm.LinearSVC().fit(df, X, "c")):
        saved.save(spark, m, f"{tmp_path}/m")
        back = saved.load(spark, f"{tmp_path}/m")
        use = "transform" if hasattr(m, "transform") else "predict"
        a, b = (getattr(v, use)(df).toPandas().sort_values("_rid" if use == "predict" else "y") for v in (m, back))
        assert a.astype(str).to_numpy().tolist() == b.astype(str).to_numpy().tolist()


def test_streams_equal_batches(data, spark):
    df, x, y = data
    state = StreamingMoments(X, "y")
    for k in range(4):
        state.add(df.filter(f"_rid % 4 = {k}"), k)
    state.add(df.filter("_rid % 4 = 1"), 1)  # a batch that runs again counts once
    state = StreamingMoments.from_json(state.to_json(), X, "y")
    m = linear.LinearRegression().fit(df, X, "y")
    assert np.allclose(state.regression().coef_, m.coef_)
    assert np.allclose(state.pca().explained_variance_, decomposition.PCA().fit(df, X).explained_variance_)
    by = StreamingMoments(X, "c", by_class=True)
    for k in range(3):
        by.add(df.filter(f"_rid % 3 = {k}"), k)
    assert np.allclose(by.naive_bayes().theta_, bayes.GaussianNB().fit(df, X, "c").theta_)


@pytest.mark.parametrize("fmt", ["parquet", "orc", "csv", "json"])
def test_sources(data, spark, tmp_path, fmt):
    df, x, _ = data
    write(df.select("_rid", *X), f"{tmp_path}/t", fmt)
    back = read(spark, f"{tmp_path}/t", fmt, "_rid long, f0 double, f1 double, f2 double", ["_rid", "f1"])
    assert np.allclose(to_numpy(back.orderBy("_rid"), ["f1"])[:, 0], x[:, 1])
