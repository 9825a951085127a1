"""Methods that compare all pairs of rows: past the limit of what the driver holds they give what they give below it."""

import time

import numpy as np
import pytest

import tessera.core as core
from tessera.operators import cluster, covariance, decomposition, preprocessing, svm
from tessera.sources.tables import from_numpy

X = [f"f{i}" for i in range(4)]


def table(spark, n=600, label=None, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 4)) + rng.integers(0, 3, n)[:, None] * 2
    x[n // 2 : n // 2 + 20] = x[:20]  # copies
    df = from_numpy(spark, x, label(x) if label else None)
    return x, df.withColumnRenamed("y", "label")


def both(monkeypatch, run):
    """Results with all pairs on the driver, and with blocks of pairs on the executors."""
    out = []
    for limit in (10**6, 50):
        monkeypatch.setattr(core, "PAIR_ROWS", limit)
        monkeypatch.setattr(core, "SPREAD_ROWS", limit)
        out.append(run())
    return out


def column(df, *names):
    return np.array(sorted(tuple(r) for r in df.select(*names).collect()), float)


def test_local_outlier_factor_in_blocks(spark, monkeypatch):
    x, df = table(spark)
    for k in (5, 20):
        a, b = both(monkeypatch, lambda: covariance.LocalOutlierFactor(n_neighbors=k).fit(df, X))
        assert np.allclose(a.negative_outlier_factor_, b.negative_outlier_factor_, rtol=1e-12)
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) + np.diag(np.full(len(x), np.inf))
        i = np.argsort(d, axis=1, kind="stable")[:, :k]
        reach = np.maximum(np.take_along_axis(d, i, 1), np.sort(d, axis=1)[:, k - 1][i]).mean(1)
        lrd = 1 / np.maximum(reach, 1e-10)
        assert np.allclose(-b.negative_outlier_factor_, lrd[i].mean(1) / lrd)


def test_knn_imputer_of_more_rows_than_the_limit(spark, monkeypatch):
    """Ties go to the smaller key, however the table lies."""
    x = np.random.default_rng(4).integers(0, 4, (700, 3)).astype(float)
    x[np.random.default_rng(5).random(x.shape) < 0.2] = np.nan
    df = spark.createDataFrame([(i, *(None if np.isnan(v) else float(v) for v in r)) for i, r in enumerate(x)], "id long, f0 double, f1 double, f2 double").orderBy("f0", "f1").repartition(3)
    monkeypatch.setattr(core.Data.local, "__defaults__", (50,))
    got = np.array([tuple(r) for r in preprocessing.KNNImputer().fit(df, X[:3], key="id").transform(df).orderBy("id").select(*X[:3]).collect()])
    want = x.copy()
    for i in np.flatnonzero(np.isnan(x).any(1)):
        gap = x - x[i]
        d = np.where(np.isnan(gap).all(1), np.inf, np.nansum(gap**2, axis=1))
        for j in np.flatnonzero(np.isnan(x[i])):
            want[i, j] = np.mean([x[r, j] for r in np.argsort(d, kind="stable") if not np.isnan(x[r, j])][:5])
    assert np.allclose(got, want)


def silhouettes(x, y):
    d, out = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), []
    for i in range(len(x)):
        own = (y == y[i]).sum()
        a, b = d[i, y == y[i]].sum() / max(1, own - 1), min(d[i, y == c].mean() for c in set(y) - {y[i]})
        out.append(0.0 if own == 1 else (b - a) / max(a, b))
    return np.array(out)


def test_silhouette_samples_of_more_rows_than_the_limit(spark, monkeypatch):
    from tessera.functions import metrics

    x, df = table(spark, label=class_of)
    monkeypatch.setattr(core, "SPREAD_ROWS", 100)
    monkeypatch.setattr(core.Data.local, "__defaults__", (50,))
    assert np.allclose(column(metrics.silhouette_samples(df, X, "label"), "silhouette")[:, 0], np.sort(silhouettes(x, class_of(x))))


def test_silhouette_score_of_more_rows_than_the_limit(spark, monkeypatch):
    from tessera.functions import metrics

    x, df = table(spark, 5200, label=class_of)
    monkeypatch.setattr(core.Data.local, "__defaults__", (50,))
    assert len(x) > core.PAIR_ROWS and np.isclose(metrics.silhouette_score(df, X, "label"), silhouettes(x, class_of(x)).mean())


def class_of(x):
    return (x[:, 0] + x[:, 1] > 2).astype(float) + (x[:, 2] > 3)


def test_svc_in_blocks(spark, monkeypatch):
    x, df = table(spark, label=class_of)
    a, b = both(monkeypatch, lambda: svm.SVC(gamma=0.5).fit(df, X, "label").proba_rows(x))
    assert np.allclose(a, b, atol=1e-7) and a.shape == (len(x), 3)


def some(x):
    return np.where(np.arange(len(x)) % 3 == 0, -1.0, class_of(x))


@pytest.mark.parametrize("kernel", ["rbf", "knn"])
def test_label_propagation_in_blocks(spark, monkeypatch, kernel):
    x, df = table(spark, label=some)
    a, b = both(monkeypatch, lambda: covariance.LabelPropagation(kernel=kernel).fit(df, X, "label"))
    assert np.allclose(a.label_distributions_, b.label_distributions_, atol=1e-9)
    assert np.array_equal(column(a.predict(df), "f0", "f1", "prediction"), column(b.predict(df), "f0", "f1", "prediction"))


@pytest.mark.parametrize("kernel", ["rbf", "knn"])
def test_label_spreading_in_blocks(spark, monkeypatch, kernel):
    """Far rows' affinities, of which a row's with itself would leave no digit, count."""
    x, df = table(spark, label=some)
    a, b = both(monkeypatch, lambda: covariance.LabelSpreading(kernel=kernel, gamma=60.0).fit(df, X, "label").label_distributions_)
    assert np.allclose(a, b, atol=1e-9)
    if kernel == "rbf":
        w = np.exp(-60.0 * ((x[:, None] - x[None]) ** 2).sum(2)) * (1 - np.eye(len(x)))
        s, y = 1 / np.sqrt(np.maximum(w.sum(1), 1e-300)), some(x)
        start = (y[:, None] == [0, 1, 2]).astype(float)
        f = start
        for _ in range(200):
            f = 0.2 * (w * s[:, None] * s) @ f + 0.8 * start
        total = f.sum(1, keepdims=True)
        assert np.allclose(b, np.where(total > 0, f / np.maximum(total, 1e-300), 1 / 3), atol=1e-3)


def test_self_training_in_blocks(spark, monkeypatch):
    x, df = table(spark, label=some)
    a, b = both(monkeypatch, lambda: covariance.SelfTrainingClassifier().fit(df, X, "label"))
    assert np.array_equal(a.rows_, b.rows_) and np.array_equal(a.labels_, b.labels_) and len(a.rows_) > 400
    assert np.array_equal(column(a.predict(df), "f0", "f1", "prediction"), column(b.predict(df), "f0", "f1", "prediction"))


def test_one_class_svm_of_many_columns(spark):
    """The threshold is the quantile of all rows' scores; its plan doesn't grow with the columns' null checks."""
    x = np.random.default_rng(6).standard_normal((300, 64)) / 8
    df, names = from_numpy(spark, x), [f"f{i}" for i in range(64)]
    m = svm.OneClassSVM(nu=0.2).fit(df, names)
    scores = column(m.score_samples(df), "score")[:, 0]
    s = np.exp(-((x[:, None] - m.support_[None]) ** 2).sum(2)).mean(1)
    assert np.allclose(scores, np.sort(s)) and np.isclose(m.offset_, np.quantile(s, 0.2)) and m.support_.shape == (60, 64)


def test_one_class_svm_of_more_support_than_20000(spark, monkeypatch):
    """Any share of the rows is met, and their scores are made once."""
    monkeypatch.setattr(core, "LOCAL_CELLS", 1000)
    x = np.random.default_rng(7).integers(0, 40, (42_000, 1)) / 8.0
    df, _ = from_numpy(spark, x), None
    m = svm.OneClassSVM(nu=0.5).fit(df, X[:1])
    values, at, count = np.unique(m.support_, return_inverse=True, return_counts=True)
    s = np.exp(-((x - values) ** 2)) @ (count / len(m.support_))
    assert len(m.support_) == 21_000 and np.isclose(m.offset_, np.quantile(s, 0.5))


def test_mds_of_more_rows_than_the_limit(spark, monkeypatch):
    x, df = table(spark)
    monkeypatch.setattr(core.Data.local, "__defaults__", (50,))
    a, b = both(monkeypatch, lambda: decomposition.MDS(n_components=3).fit(df, X).embedding_)
    assert np.allclose(a, b, atol=1e-8)


def test_agglomerative_clustering_of_more_rows_than_the_limit(spark, monkeypatch):
    x, df = table(spark)
    a = cluster.AgglomerativeClustering(n_clusters=4).fit(df, X)
    monkeypatch.setattr(core.Data.local, "__defaults__", (50,))
    monkeypatch.setattr(core, "SPREAD_ROWS", 50)
    b = cluster.AgglomerativeClustering(n_clusters=4).fit(df, X)
    assert np.array_equal(a.labels_, b.labels_)
    assert np.array_equal(column(a.predict(df), "f0", "f1", "prediction"), column(b.predict(df), "f0", "f1", "prediction"))


@pytest.mark.parametrize("max_eps", [np.inf, 0.9])
def test_optics_of_more_rows_than_the_limit(spark, monkeypatch, max_eps):
    x, df = table(spark)
    monkeypatch.setattr(core.Data.local, "__defaults__", (50,))
    m = cluster.OPTICS(eps=0.8, max_eps=max_eps).fit(df, X)
    off = np.sqrt(((m.rows_[:, None] - m.rows_[None]) ** 2).sum(2)) + np.diag(np.full(len(x), np.inf))
    kth = np.sort(off, axis=1)[:, 4]
    kernel = np.where(kth <= max_eps, kth, np.inf)
    reach, left, order = np.full(len(x), np.inf), list(range(len(x))), []
    while left:
        i = min(left, key=lambda j: (reach[j], j))
        left.remove(i)
        order.append(i)
        if np.isfinite(kernel[i]):
            for j in left:
                if off[i, j] <= max_eps:
                    reach[j] = min(reach[j], max(kernel[i], off[i, j]))
    assert m.ordering_.tolist() == order and np.allclose(m.reachability_, reach) and np.array_equal(m.core_distances_, kernel)


@pytest.mark.parametrize("scale", [1.0, 1e-25, 1e25])
def test_walks_of_any_scale(spark, scale):
    """Bounds of single precision leave out no row that is nearer, whatever the scale and the place of the rows."""
    x = (np.random.default_rng(8).standard_normal((300, 3)) + [1e6, 0, -3]) * scale
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    left, best, total = list(range(1, 300)), d[0].copy(), []
    while left:
        j = min(left, key=lambda r: (best[r], r))
        left.remove(j)
        total.append(best[j])
        best = np.minimum(best, d[j])
    labels = cluster.single_linkage(x, 6)
    cut, root = np.sort(total)[-6], np.arange(300)
    for _ in range(300):
        root = np.where(d <= cut * (1 + 1e-9), root, 999).min(1)
    assert np.array_equal(labels, np.unique(root, return_inverse=True)[1])


def test_long_walks_compare_few_rows():
    """12,000 rows of 64 columns: 9 billion differences if every row were compared with all."""
    x = np.random.default_rng(8).standard_normal((12_000, 64))
    began = time.time()
    assert len(set(cluster.single_linkage(x, 5))) == 5 and time.time() - began < 8
    m = cluster.OPTICS()
    began = time.time()
    m._labels(x[:4000])
    assert sorted(m.ordering_) == list(range(4000)) and time.time() - began < 15


@pytest.mark.parametrize("d", [1, 2, 4])
def test_dbscan_is_that_of_all_pairs(spark, d):
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(rng.integers(0, 4, (400, 1)) * 3, 0.7, (400, d)), 1)
    x[:40] = x[40]
    eps = 0.1 if d == 1 else 0.6
    df = spark.createDataFrame([(1000 - i, *map(float, r)) for i, r in enumerate(x)], "id long, " + ", ".join(f"f{i} double" for i in range(d)))
    got = dict(tuple(r) for r in cluster.DBSCAN(eps=eps, min_samples=4).fit_predict(df, X[:d], "id").select("id", "prediction").collect())
    x = x[::-1]  # by id
    near = ((x[:, None] - x[None]) ** 2).sum(2) <= eps * eps
    core = near.sum(1) >= 4
    root = np.arange(400)
    for _ in range(400):
        new = np.where(core, np.where(near & core, root, 999).min(1), root)
        if (new == root).all():
            break
        root = new
    names = sorted(set(root[core]))
    least = np.where(near & core, root, 999).min(1)
    want = [names.index(root[i]) if core[i] else names.index(least[i]) if least[i] < 999 else -1 for i in range(400)]
    assert [got[601 + i] for i in range(400)] == want and len(names) > 1 and -1 in want


def test_dbscan_of_one_dense_column_makes_no_pairs(spark):
    """60,000 rows of which each has 2,500 within eps: 150 million pairs."""
    df = spark.range(60_000).selectExpr("id", "(id * 7919 % 60000) / 5.5 as v")
    began = time.time()
    assert cluster.DBSCAN(eps=150.0, min_samples=4).fit_predict(df, ["v"], "id").filter("prediction <> 0").count() == 0
    assert time.time() - began < 60


def smooth(x):
    return np.sin(x[:, 0]) + x[:, 1] * x[:, 2] / 5


@pytest.mark.parametrize("make", [lambda: svm.SVR(kernel="rbf", C=100.0), lambda: covariance.GaussianProcessRegressor(alpha=1e-3)])
def test_kernel_regressors_in_blocks(spark, monkeypatch, make):
    """Copies of rows with other labels have the mean of their labels."""
    x, df = table(spark, label=lambda x: smooth(x) + (np.arange(len(x)) % 2) / 10)
    a, b = both(monkeypatch, lambda: make().fit(df, X, "label").predict_rows(x))
    assert np.allclose(a, b, atol=1e-6) and np.abs(a - smooth(x)).mean() < 0.2


def test_gaussian_process_classifier_in_blocks(spark, monkeypatch):
    x, df = table(spark, label=class_of)
    a, b = both(monkeypatch, lambda: covariance.GaussianProcessClassifier().fit(df, X, "label").proba_rows(x))
    assert np.allclose(a, b, atol=1e-4) and a.shape == (len(x), 3)


def test_mean_shift_in_blocks(spark, monkeypatch):
    x, df = table(spark)
    a, b = both(monkeypatch, lambda: cluster.MeanShift(bandwidth=2.5).fit(df, X))
    assert np.array_equal(a.labels_, b.labels_) and np.allclose(a.centers_, b.centers_) and 1 < len(a.centers_) < 100


@pytest.mark.parametrize("affinity", ["rbf", "knn"])
def test_spectral_clustering_in_blocks(spark, monkeypatch, affinity):
    """The same parts, whatever their numbers."""
    x, df = table(spark)
    a, b = both(monkeypatch, lambda: cluster.SpectralClustering(n_clusters=3, affinity=affinity, gamma=0.05, n_neighbors=40).fit(df, X).labels_)
    same = lambda y: y[:, None] == y[None]
    assert (same(a) == same(b)).mean() > 0.99 and len(set(b)) == 3


def test_kernel_pca_in_blocks(spark, monkeypatch):
    x, df = table(spark)
    a, b = both(monkeypatch, lambda: column(decomposition.KernelPCA(n_components=2, gamma=0.3).fit(df, X).transform(df), "kpc0", "kpc1"))
    assert np.allclose(a, b, atol=1e-6) and a.std(0).min() > 0.01


@pytest.mark.parametrize("kind", ["LocallyLinearEmbedding", "SpectralEmbedding"])
def test_neighbour_embeddings_in_blocks(spark, monkeypatch, kind):
    x = np.random.default_rng(5).random((300, 4)) * [3, 1, 0.1, 0.1]
    df, _ = from_numpy(spark, x), None
    a, b = both(monkeypatch, lambda: getattr(decomposition, kind)(n_neighbors=12).fit(df, X).embedding_)
    assert np.allclose(np.abs(a), np.abs(b), atol=1e-4 * np.abs(a).max())


def test_tsne_in_blocks(spark, monkeypatch):
    x, df = table(spark, 300)
    a, b = both(monkeypatch, lambda: decomposition.TSNE(perplexity=10.0, max_iter=6).fit(df, X))
    assert np.allclose(a.embedding_, b.embedding_, atol=1e-4 * np.abs(a.embedding_).max()) and np.isclose(a.kl_divergence_, b.kl_divergence_, rtol=1e-4)
    assert np.abs(a.embedding_).max() > 1e-3


@pytest.mark.parametrize("kept", [2e9, 0])
@pytest.mark.parametrize("parts", [1, 3])
def test_isomap_in_blocks(spark, monkeypatch, parts, kept):
    """One part and several that no path joins; lengths kept and made anew."""
    from tessera.operators import pairs

    x = np.random.default_rng(5).random((300, 4)) * [3, 1, 0.1, 0.1]
    x[:, 0] += np.arange(300) % parts * 50
    x[100:110] = x[:10] if parts == 1 else x[100:110]
    df, _ = from_numpy(spark, x), None
    monkeypatch.setattr(pairs.Far.__init__, "__defaults__", (10.0, kept))
    a, b = both(monkeypatch, lambda: decomposition.Isomap(n_neighbors=8).fit(df, X).embedding_)
    assert np.allclose(np.abs(a), np.abs(b), atol=1e-6 * np.abs(a).max()) and a.std(0).min() > 0.01


@pytest.mark.parametrize("n", [300, 301])
def test_affinity_propagation_in_blocks(spark, monkeypatch, n):
    x = np.random.default_rng(5).random((n, 4)) * [9, 5, 1, 1]
    df, _ = from_numpy(spark, x), None
    far = cluster.Pairs(spark, x)
    assert np.isclose(cluster.median_square(far), np.median(((x[:, None] - x[None]) ** 2).sum(2)), rtol=1e-12)
    for options in ({}, {"damping": 0.8, "preference": -3.0, "max_iter": 12}):
        a, b = both(monkeypatch, lambda: cluster.AffinityPropagation(**options).fit(df, X))
        assert np.array_equal(a.exemplars_, b.exemplars_) and np.array_equal(a.labels_, b.labels_) and len(a.exemplars_) > 5


def test_locally_linear_embedding_with_several_null_vectors(spark, monkeypatch):
    """Far groups, links between which go one way: any vectors that all rows' neighbours make up exactly are right, and settle."""
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.random((40, 2)) * 1e-3 + rng.random(2) * 50 for _ in range(12)] + [rng.random((600, 2)) * 50])
    df, _ = from_numpy(spark, x), None
    monkeypatch.setattr(core, "PAIR_ROWS", 50)
    m = decomposition.LocallyLinearEmbedding(n_neighbors=5).fit(df, X[:2])
    x, e = m.rows_, m.embedding_
    near = np.argsort(((x[:, None] - x[None]) ** 2).sum(2) + np.diag(np.full(len(x), np.inf)), axis=1, kind="stable")[:, :5]
    z = x[near] - x[:, None]
    c = z @ z.transpose(0, 2, 1)
    w = np.linalg.solve(c + np.eye(5) * 1e-3 * np.einsum("nii->n", c)[:, None, None], np.ones((len(x), 5, 1)))[..., 0]
    w /= w.sum(1, keepdims=True)
    assert np.abs(e - np.einsum("nk,nkc->nc", w, e[near])).max() < 1e-8
    assert np.allclose(e.T @ e, np.eye(2), atol=1e-8) and np.abs(e.sum(0)).max() < 1e-6


@pytest.mark.parametrize("max_eps", [np.inf, 0.9])
def test_optics_with_neighbours_from_the_executors(spark, monkeypatch, max_eps):
    _, df = table(spark)
    a, b = both(monkeypatch, lambda: cluster.OPTICS(eps=0.8, max_eps=max_eps).fit(df, X))
    assert np.array_equal(a.ordering_, b.ordering_) and np.array_equal(a.reachability_, b.reachability_) and np.array_equal(a.labels_, b.labels_)


def test_kernels_meet_in_tiles_that_fit_a_cache(spark):
    from tessera.operators import pairs

    x, seen = np.random.default_rng(3).standard_normal((5000, 2)), []

    def tile(a, b):
        seen.append(a.size // 2 * (b.size // 2))
        return svm.kernel("rbf", a, b, 1.0, 0, 0)

    v = np.random.default_rng(4).standard_normal((5000, 3))
    assert np.allclose(pairs.against(tile, x[:300], x, v), svm.kernel("rbf", x[:300], x, 1.0, 0, 0) @ v) and max(seen) * 8 <= 2**20
