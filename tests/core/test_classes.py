"""One check by name for each class that no SQL covers: numpy's result, an optimality condition, or an invariant."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import metrics as M
from tessera.operators import bayes, cluster, compose, covariance, decomposition, linear, neighbors, neural, svm, trees
from tessera.operators import feature_selection as select
from tessera.operators import preprocessing as prep
from tessera.operators import search as find
from tessera.operators.random import PCG64
from tessera.operators.splitters import KFold, ParameterSampler
from tessera.sources.tables import from_numpy

X = ["f0", "f1", "f2"]
RNG = np.random.default_rng(7)
N = 160
A = RNG.standard_normal((N, 3))
Y = A @ [1.5, -2.0, 0.0] + 1 + 0.1 * RNG.standard_normal(N)


@pytest.fixture(scope="module")
def df(spark):
    t = from_numpy(spark, A, Y).withColumn("c", (F.col("f0") - F.col("f1") > 0).cast("int")).withColumn("k", (F.col("f0") > 0.4).cast("int") + (F.col("f0") > -0.4).cast("int"))
    return t.withColumns({"pos": F.exp(F.col("f0") * 0.4 + 0.2), "y2": F.col("f1") * 2 + F.col("f0")}).cache()


def cols(out, names):
    return np.array(out.orderBy("_rid").select(*names).collect(), float)


def hit(model, df, label):
    out = model.fit(df, X, label).predict(df)
    return out.agg(F.avg((F.col(label) == F.col("prediction")).cast("double"))).first()[0]


# -- transformers -----------------------------------------------------------------------------------------------------
def test_quantile_transformer(df):
    m = prep.QuantileTransformer(n_quantiles=N).fit(df, X)
    got = cols(m.transform(df), X)
    assert np.allclose(got, A.argsort(0).argsort(0) / (N - 1))
    assert np.allclose(cols(m.inverse_transform(m.transform(df)), X), A)
    normal = cols(prep.QuantileTransformer(n_quantiles=N, output_distribution="normal").fit(df, X).transform(df), X)
    inner = (got > 0) & (got < 1)
    assert np.allclose([0.5 * math.erfc(-z / math.sqrt(2)) for z in normal[inner]], got[inner], atol=1e-4)


def test_power_transformer(df):
    m = prep.PowerTransformer(standardize=False).fit(df.withColumn("e", F.exp("f0")), ["e"])
    e = np.exp(A[:, 0])

    def likelihood(lam):
        z = ((e + 1) ** lam - 1) / lam if abs(lam) > 1e-12 else np.log(e + 1)
        return -N / 2 * np.log(z.var()) + (lam - 1) * np.log(e + 1).sum()

    best = max(np.linspace(-3, 2, 2001), key=likelihood)
    assert abs(m.lambdas_["e"] - best) < 0.06  # the grid is in steps of 0.1
    z = cols(prep.PowerTransformer().fit(df.withColumn("e", F.exp("f0")), ["e"]).transform(df.withColumn("e", F.exp("f0"))), ["e"])
    assert abs(z.mean()) < 1e-6 and abs(z.std() - 1) < 1e-6


def test_spline_transformer(df):
    m = prep.SplineTransformer(n_knots=6, degree=3).fit(df, ["f0"])
    b = cols(m.transform(df), [f"`{c}`" for c in m.outputs()])
    assert b.shape[1] == 8 and np.allclose(b.sum(1), 1) and (b >= -1e-12).all() and ((b > 1e-12).sum(1) <= 4).all()
    # cubic splines hold every straight line
    z = np.linalg.lstsq(b, A[:, 0], rcond=None)[0]
    assert np.allclose(b @ z, A[:, 0])


def test_iterative_imputer(df):
    holes = df.withColumn("f3", F.when(F.col("_rid") % 5 == 0, F.lit(None)).otherwise(F.col("f0") * 2 - F.col("f1") + 3))
    got = cols(prep.IterativeImputer().fit(holes, [*X, "f3"]).transform(holes), ["f3"])[:, 0]
    assert np.allclose(got, A[:, 0] * 2 - A[:, 1] + 3, atol=1e-2)


# -- selection --------------------------------------------------------------------------------------------------------
def test_select_by_p_values(df):
    p = None
    for make, keep in (
        (select.SelectFpr, lambda p, a: {f for f in p if p[f] < a}),
        (select.SelectFwe, lambda p, a: {f for f in p if p[f] < a / len(p)}),
        (select.SelectFdr, lambda p, a: {f for f in p if p[f] <= max([v for i, v in enumerate(sorted(p.values()), 1) if v <= a * i / len(p)], default=-1)}),
    ):
        m = make(score_func=select.f_regression, alpha=0.05).fit(df, X, "y")
        p = m.pvalues_
        assert set(m.selected_) == keep(p, 0.05) and {"f0", "f1"} <= set(m.selected_)
    # the F distribution's tail by its beta integral
    r = np.corrcoef(A[:, 2], Y)[0, 1]
    f = r * r / (1 - r * r) * (N - 2)
    t = np.linspace(0, 1, 200_001)[1:-1]
    x = (N - 2) / (N - 2 + f)
    g = t ** ((N - 2) / 2 - 1) * (1 - t) ** -0.5
    assert abs(p["f2"] - g[t <= x].sum() / g.sum()) < 5e-3


def test_rfecv_and_sequential_selection(df):
    m = select.RFECV(estimator=linear.LinearRegression(), cv=KFold(n_splits=2), scoring="r2").fit(df, X, "y")
    assert {"f0", "f1"} <= set(m.selected_)
    for way, n in (("forward", 1), ("backward", 2)):
        s = select.SequentialFeatureSelector(estimator=linear.LinearRegression(), cv=KFold(n_splits=2), n_features_to_select=n, direction=way, scoring="r2").fit(df, X, "y")
        assert s.selected_ == ["f0", "f1"][-n:]


def test_parameter_sampler():
    got = list(ParameterSampler({"a": [1, 2, 3], "b": [4, 5]}, 5, 3))
    assert len(got) == 5 and all(g["a"] in (1, 2, 3) and g["b"] in (4, 5) for g in got) and got == list(ParameterSampler({"a": [1, 2, 3], "b": [4, 5]}, 5, 3))


# -- linear models ----------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("make", [linear.LassoCV, linear.ElasticNetCV, linear.LarsCV, linear.LassoLarsCV, linear.OrthogonalMatchingPursuitCV, linear.LassoLarsIC], ids=lambda m: m.__name__)
def test_cross_validated_paths(df, make):
    grid = {} if make in (linear.LarsCV, linear.OrthogonalMatchingPursuitCV) else {"alphas": (0.001, 5.0)}
    m = make(**grid).fit(df, X, "y")
    assert m.predict(df).agg(M.r2_score("y", "prediction")).first()[0] > 0.98 and np.allclose(m.coef_[:2], [1.5, -2], atol=0.05) and abs(m.coef_[2]) < 0.05


def test_tweedie_regressor_scores_vanish(df):
    m = linear.TweedieRegressor(power=1.5).fit(df, X, "pos")
    mu, y = np.exp(A @ m.coef_ + m.intercept_), np.exp(A[:, 0] * 0.4 + 0.2)
    assert np.allclose(np.column_stack([A, np.ones(N)]).T @ ((y - mu) * mu**-0.5), 0, atol=2e-2)


@pytest.mark.parametrize(("make", "ratio"), [(linear.MultiTaskLasso, 1.0), (linear.MultiTaskElasticNet, 0.5)], ids=["MultiTaskLasso", "MultiTaskElasticNet"])
def test_multi_task_models_meet_their_conditions(df, make, ratio):
    m = make(alpha=0.2).fit(df, X, ["y", "y2"])
    b, t = np.array(m.coef_).T, np.column_stack([Y, A[:, 1] * 2 + A[:, 0]])
    c, r = A - A.mean(0), t - t.mean(0)
    g = c.T @ (r - c @ b) / N - 0.2 * (1 - ratio) * b
    size, live = np.linalg.norm(b, axis=1), np.linalg.norm(b, axis=1) > 1e-9
    assert live.any() and np.allclose(g[live], 0.2 * ratio * b[live] / size[live, None], atol=1e-4) and (np.linalg.norm(g[~live], axis=1) <= 0.2 * ratio + 1e-6).all()


@pytest.mark.parametrize("make", [linear.MultiTaskLassoCV, linear.MultiTaskElasticNetCV], ids=lambda m: m.__name__)
def test_multi_task_cross_validation(df, make):
    m = make(alphas=(0.001, 5.0)).fit(df, X, ["y", "y2"])
    assert np.allclose(np.array(m.coef_), [[1.5, -2, 0], [1, 2, 0]], atol=0.05)


# -- support vectors, neighbours --------------------------------------------------------------------------------------
def test_nu_machines_and_one_class(df):
    assert hit(svm.NuSVC(), df, "c") > 0.9
    assert svm.NuSVR().fit(df, X, "y").predict(df).agg(M.r2_score("y", "prediction")).first()[0] > 0.9
    for kernel in ("linear", "rbf"):
        m = svm.OneClassSVM(nu=0.2, kernel=kernel).fit(df, X)
        assert 0.17 <= m.predict(df).agg(F.avg((F.col("prediction") == -1).cast("double"))).first()[0] <= 0.23
    with pytest.raises(ValueError):
        svm.OneClassSVM(nu=0.5, max_support=10).fit(df, X)


def test_radius_neighbours_by_hand(df):
    d = np.sqrt(((A[:, None] - A[None]) ** 2).sum(2))
    near = d <= 0.9
    got = cols(neighbors.RadiusNeighborsRegressor(radius=0.9).fit(df, X, "y").predict(df), ["prediction"])[:, 0]
    assert np.allclose(got, [Y[n].mean() for n in near])
    c = (A[:, 0] - A[:, 1] > 0).astype(int)
    votes = cols(neighbors.RadiusNeighborsClassifier(radius=0.9).fit(df, X, "c").predict(df), ["prediction"])[:, 0]
    assert np.array_equal(votes, [int(c[n].mean() > 0.5) for n in near])


# -- trees ------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("make", [lambda: trees.ExtraTreeClassifier(), lambda: trees.HistGradientBoostingClassifier(max_iter=20), lambda: compose.BaggingClassifier(base_estimator=trees.DecisionTreeClassifier(max_depth=4), n_estimators=4)], ids=["ExtraTreeClassifier", "HistGradientBoostingClassifier", "BaggingClassifier"])
def test_tree_classifiers(df, make):
    assert hit(make(), df, "c") > 0.9
    p = np.array([r[0] for r in make().fit(df, X, "c").predict_proba(df).select("probability").collect()])
    assert np.allclose(p.sum(1), 1) and (p >= 0).all()


@pytest.mark.parametrize("make", [lambda: trees.ExtraTreeRegressor(), lambda: trees.ExtraTreesRegressor(n_estimators=5), lambda: compose.BaggingRegressor(base_estimator=linear.LinearRegression(), n_estimators=3)], ids=["ExtraTreeRegressor", "ExtraTreesRegressor", "BaggingRegressor"])
def test_tree_regressors(df, make):
    assert make().fit(df, X, "y").predict(df).agg(M.r2_score("y", "prediction")).first()[0] > 0.9


def test_bernoulli_rbm(df):
    bits = df.select("_rid", *((F.col(f) > 0).cast("double").alias(f) for f in X))
    m = neural.BernoulliRBM(n_components=4, n_iter=30).fit(bits, X)
    h = cols(m.transform(bits), m.outputs())
    want = 1 / (1 + np.exp(-((A > 0) @ m.components_ + m.intercept_hidden_)))
    assert np.allclose(h, want) and m.intercept_visible_.shape == (3,)


# -- clusters ---------------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def blobs(spark):
    x = np.concatenate([RNG.standard_normal((30, 2)) * 0.3 + c for c in ([5, 5], [-5, -5], [5, -5])])
    return from_numpy(spark, x, np.repeat([0, 1, 2], 30)).cache(), x


@pytest.mark.parametrize("make", [cluster.SpectralBiclustering, cluster.SpectralCoclustering], ids=lambda m: m.__name__)
def test_spectral_biclusters(spark, make):
    """Blocks of rows and columns that go together."""
    x = np.full((40, 6), 0.2) + RNG.random((40, 6)) * 0.05
    x[:20, :3] += 5
    x[20:, 3:] += 5
    t = from_numpy(spark, x, np.repeat([0, 1], 20))
    m = make(n_clusters=2).fit(t, [f"f{i}" for i in range(6)], key="_rid")
    assert M.adjusted_rand_score(m.predict(t), "y", "prediction") > 0.95


def test_optics_results(blobs):
    df, x = blobs
    m = cluster.OPTICS(min_samples=4, eps=1.5).fit(df, ["f0", "f1"], key="_rid")
    d = np.sort(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), axis=1)
    assert sorted(m.ordering_) == list(range(90)) and np.allclose(m.core_distances_, d[:, 4]) and np.isinf(m.reachability_[m.ordering_[0]])
    assert M.adjusted_rand_score(m.predict(df), "y", "prediction") > 0.95


# -- decompositions ---------------------------------------------------------------------------------------------------
def test_kernel_pca_with_a_linear_kernel_is_pca(df):
    k = decomposition.KernelPCA(n_components=2, kernel="linear").fit(df, X, key="_rid")
    p = decomposition.PCA(n_components=2).fit(df, X)
    a, b = cols(k.transform(df), k.outputs()), cols(p.transform(df), p.outputs())
    assert np.allclose(np.abs(a), np.abs(b), atol=1e-6)


def test_sparse_pca(df):
    wide = df.withColumn("f3", F.col("f0") * 3)
    m = decomposition.SparsePCA(n_components=1, alpha=0.5).fit(wide, [*X, "f3"])
    c = np.abs(m.components_[0])
    assert c[3] > 0.9 and (c[[1, 2]] < 1e-6).all() and abs(np.linalg.norm(m.components_[0]) - 1) < 1e-9
    b = decomposition.MiniBatchSparsePCA(n_components=1, alpha=0.5, batch_size=150).fit(wide, [*X, "f3"])
    assert np.abs(b.components_[0])[3] > 0.9


def test_fast_ica_unmixes(spark):
    s = np.column_stack([np.sign(RNG.standard_normal(400)) * RNG.random(400), RNG.random(400) ** 3])
    t = from_numpy(spark, s @ [[1.0, 0.5], [0.4, 1.0]])
    m = decomposition.FastICA(n_components=2).fit(t, ["f0", "f1"])
    r = np.abs(np.corrcoef(cols(m.transform(t), m.outputs()).T, s.T)[:2, 2:])
    assert (r.max(1) > 0.95).all() and set(r.argmax(1)) == {0, 1}


def test_factor_analysis_explains_the_covariance(spark):
    load = np.array([[1.0, 0.8, 0.6, 0.0], [0.0, 0.3, 0.9, 1.0]])
    x = RNG.standard_normal((3000, 2)) @ load + RNG.standard_normal((3000, 4)) * 0.3
    m = decomposition.FactorAnalysis(n_components=2, tol=1e-6).fit(from_numpy(spark, x), [f"f{i}" for i in range(4)])
    assert np.allclose(m.loadings_ @ m.loadings_.T + np.diag(m.noise_variance_), np.cov(x.T, bias=True), atol=0.03)


@pytest.mark.parametrize("make", [decomposition.NMF, decomposition.MiniBatchNMF], ids=lambda m: m.__name__)
def test_nmf_finds_a_low_rank(spark, make):
    x = RNG.random((120, 2)) @ RNG.random((2, 5))
    names = [f"f{i}" for i in range(5)]
    t = from_numpy(spark, x)
    m = make(n_components=2, max_iter=400).fit(t, names)
    h = cols(m.transform(t), m.outputs())
    assert (h >= 0).all() and (m.components_ >= 0).all() and np.linalg.norm(x - h @ m.components_) < 0.1 * np.linalg.norm(x)


def test_latent_dirichlet_allocation_finds_topics(spark):
    t = np.repeat([[1, 0], [0, 1]], 60, 0)
    x = RNG.poisson(t @ np.array([[8, 8, 0.1, 0.1], [0.1, 0.1, 8, 8]])).astype(float)
    df = from_numpy(spark, x, t[:, 0].astype(float))
    m = decomposition.LatentDirichletAllocation(n_components=2, max_iter=30).fit(df, [f"f{i}" for i in range(4)])
    h = cols(m.transform(df), m.outputs())
    side = h.argmax(1)
    assert max((side == t[:, 0]).mean(), (side != t[:, 0]).mean()) > 0.97


def test_discriminant_axes(df):
    m = decomposition.LDA(n_components=1).fit(df, X, "c")
    z = cols(m.transform(df), m.outputs())[:, 0]
    c = A[:, 0] - A[:, 1] > 0
    w = sum(np.cov(A[v].T, bias=True) * v.sum() for v in (c, ~c))
    want = np.linalg.solve(w, A[c].mean(0) - A[~c].mean(0))
    assert abs(np.corrcoef(z, A @ want)[0, 1]) > 1 - 1e-9


@pytest.mark.parametrize("make", [decomposition.GaussianRandomProjection, decomposition.SparseRandomProjection], ids=lambda m: m.__name__)
def test_random_projections_keep_distances(spark, make):
    x = RNG.standard_normal((40, 30))
    t, names = from_numpy(spark, x), [f"f{i}" for i in range(30)]
    m = make(n_components=200).fit(t, names)
    z = cols(m.transform(t), m.outputs())
    d = lambda v: np.sqrt(((v[:, None] - v[None]) ** 2).sum(2))[np.triu_indices(40, 1)]
    assert abs(np.mean(d(z) / d(x)) - 1) < 0.1
