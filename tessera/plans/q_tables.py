"""Queries for preprocessing, selection, splitting and utilities, over orders and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import utilities as U
from tessera.operators import feature_selection as S
from tessera.operators import preprocessing as P
from tessera.operators import search as X
from tessera.operators import splitters as K
from tessera.operators.linear import LinearRegression, Ridge
from tessera.operators.random import PCG64
from tessera.plans.registry import query
from tessera.plans.shared import LINE_SQL, ORDERS_SQL, lines, orders, rounded, table, value

FEATURES = ["total", "month"]


def _fit(make, features=FEATURES, digits=6, rows=orders, key="o_orderkey", inverse=False):
    """The key and the outputs of a transformer over all rows."""

    def run(s, d):
        df = rows(s, d).select(key, *features)
        t = make()
        out = t.fit_transform(df, features)
        if inverse:
            return rounded(t.inverse_transform(out).select(key, *features), digits)
        return rounded(out.select(key, *(F.col("`" + o + "`") for o in t.outputs())), digits)

    return run


_STATS = "WITH z AS (SELECT " + ", ".join(f"avg({f}) AS m_{f}, stddev_pop({f}) AS s_{f}, min({f}) AS lo_{f}, max({f}) AS hi_{f}, max(abs({f})) AS a_{f}, quantile_cont({f}, 0.25) AS q1_{f}, quantile_cont({f}, 0.5) AS q2_{f}, quantile_cont({f}, 0.75) AS q3_{f}" for f in FEATURES) + f" FROM {ORDERS_SQL})"


def _scaled(template):
    cols = [f"round({template.format(f=f)}, 6) AS {f}" for f in FEATURES]
    return f"{_STATS} SELECT o_orderkey, {', '.join(cols)} FROM {ORDERS_SQL} x CROSS JOIN z"


query("standard_scaler", _scaled("({f} - m_{f}) / s_{f}"))(_fit(P.StandardScaler))
query("minmax_scaler", _scaled("({f} - lo_{f}) / (hi_{f} - lo_{f})"))(_fit(P.MinMaxScaler))
query("maxabs_scaler", _scaled("{f} / a_{f}"))(_fit(P.MaxAbsScaler))
query("robust_scaler", _scaled("({f} - q2_{f}) / (q3_{f} - q1_{f})"))(_fit(P.RobustScaler))
query("standard_scaler_inverse", _scaled("{f}"))(_fit(P.StandardScaler, inverse=True))
query("normalizer", f"SELECT o_orderkey, round(total / sqrt(total * total + month * month), 6) AS total, round(month / sqrt(total * total + month * month), 6) AS month FROM {ORDERS_SQL}")(_fit(P.Normalizer))
query("binarizer", f"SELECT o_orderkey, CASE WHEN total > 100 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS total, CASE WHEN month > 100 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS month FROM {ORDERS_SQL}")(_fit(lambda: P.Binarizer(threshold=100.0)))


@query("polynomial_features", f'SELECT o_orderkey, 1.0::DOUBLE AS "1", round(total, 7) AS total, month, round(total * total, 1) AS "total*total", round(total * month, 7) AS "total*month", month * month AS "month*month" FROM {ORDERS_SQL}')
def _polynomials(s, d):
    t = P.PolynomialFeatures()
    out = t.fit_transform(orders(s, d).select("o_orderkey", *FEATURES), FEATURES)
    # digits at which no product of these numbers lies half way
    return out.select("o_orderkey", *(F.round(F.col("`" + o + "`"), 1 if o == "total*total" else 7).alias(o) for o in t.outputs()))


_STATUS = ("F", "O", "P")
query("one_hot_encoder", "SELECT o_orderkey, " + ", ".join(f"CASE WHEN o_orderstatus = '{v}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS \"o_orderstatus={v}\"" for v in _STATUS) + " FROM orders")(_fit(P.OneHotEncoder, ["o_orderstatus"]))
_CODE = "CAST(dense_rank() OVER (ORDER BY {f}) - 1 AS {t})"
query("ordinal_encoder", f"SELECT o_orderkey, {_CODE.format(f='o_orderpriority', t='DOUBLE')} AS o_orderpriority, {_CODE.format(f='o_orderstatus', t='DOUBLE')} AS o_orderstatus FROM orders")(_fit(P.OrdinalEncoder, ["o_orderpriority", "o_orderstatus"]))
query("label_encoder", f"SELECT o_orderkey, {_CODE.format(f='o_orderpriority', t='INTEGER')} AS o_orderpriority FROM orders")(_fit(P.LabelEncoder, ["o_orderpriority"]))
query("label_binarizer", "SELECT o_orderkey, " + ", ".join(f"CASE WHEN o_orderstatus = '{v}' THEN 1 ELSE 0 END AS \"o_orderstatus={v}\"" for v in _STATUS) + " FROM orders")(_fit(P.LabelBinarizer, ["o_orderstatus"]))


@query("multilabel_binarizer", """SELECT o_custkey, max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS "labels=F", max(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS "labels=O", max(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS "labels=P" FROM orders GROUP BY o_custkey""")
def _multilabel(s, d):
    df = table(s, d, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("labels"))
    return P.MultiLabelBinarizer().fit(df, ["labels"]).transform(df)


_UNI = ["CAST(least(" + " + ".join(f"CASE WHEN {f} >= lo_{f} + (hi_{f} - lo_{f}) * {i} / 5.0 THEN 1 ELSE 0 END" for i in range(1, 5)) + f", 4) AS DOUBLE) AS {f}" for f in ["total"]]
query("kbins_discretizer_uniform", f"{_STATS} SELECT o_orderkey, {', '.join(_UNI)} FROM {ORDERS_SQL} x CROSS JOIN z")(_fit(lambda: P.KBinsDiscretizer(encode="ordinal"), ["total"]))
_QB = "WITH q AS (SELECT " + ", ".join(f"quantile_cont(total, {i / 4}) AS e{i}" for i in range(1, 4)) + f" FROM {ORDERS_SQL}) SELECT o_orderkey, CAST(" + " + ".join(f"CASE WHEN total >= e{i} THEN 1 ELSE 0 END" for i in range(1, 4)) + f" AS DOUBLE) AS total FROM {ORDERS_SQL} x CROSS JOIN q"
query("kbins_discretizer_quantile", _QB)(_fit(lambda: P.KBinsDiscretizer(n_bins=4, encode="ordinal", strategy="quantile"), ["total"]))
query("kbins_discretizer_onehot", "WITH z AS (SELECT min(month) AS lo, max(month) AS hi FROM {o}) SELECT o_orderkey, CASE WHEN month < lo + (hi - lo) / 2.0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS \"month:0\", CASE WHEN month < lo + (hi - lo) / 2.0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS \"month:1\" FROM {o} x CROSS JOIN z".format(o=ORDERS_SQL))(_fit(lambda: P.KBinsDiscretizer(n_bins=2), ["month"]))
query("function_transformer", f"SELECT o_orderkey, round(ln(1 + total), 6) AS total, round(ln(1 + month), 6) AS month FROM {ORDERS_SQL}")(_fit(lambda: P.FunctionTransformer(func="log1p")))
query("quantile_transformer")(_fit(lambda: P.QuantileTransformer(n_quantiles=100)))
query("quantile_transformer_normal")(_fit(lambda: P.QuantileTransformer(n_quantiles=100, output_distribution="normal")))
query("power_transformer")(_fit(P.PowerTransformer))
query("power_transformer_boxcox")(_fit(lambda: P.PowerTransformer(method="box-cox"), ["total"]))
query("spline_transformer")(_fit(P.SplineTransformer, ["month"]))

_EV = "(SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(value AS DOUBLE) END AS a, CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(user_id AS DOUBLE) END AS b FROM events)"


def holes(s, d):
    e = table(s, d, "events")
    return e.select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("value").cast("double")).alias("a"), F.when(F.col("event_id") % 11 != 0, F.col("user_id").cast("double")).alias("b"))


def _filled(make, digits=6):
    return _fit(make, ["a", "b"], digits, holes, "event_id")


query("simple_imputer_mean", f"SELECT event_id, round(coalesce(a, avg(a) OVER ()), 6) AS a, round(coalesce(b, avg(b) OVER ()), 6) AS b FROM {_EV}")(_filled(P.SimpleImputer))
query("simple_imputer_median", f"SELECT event_id, round(coalesce(a, ma), 6) AS a, round(coalesce(b, mb), 6) AS b FROM {_EV} x, (SELECT quantile_cont(a, 0.5) AS ma, quantile_cont(b, 0.5) AS mb FROM {_EV}) m")(_filled(lambda: P.SimpleImputer(strategy="median")))
query("simple_imputer_constant", f"SELECT event_id, round(coalesce(a, -1.0), 6) AS a, coalesce(b, -1.0) AS b FROM {_EV}")(_filled(lambda: P.SimpleImputer(strategy="constant", fill_value=-1.0)))
query("missing_indicator", f'SELECT event_id, CASE WHEN a IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS "missing:a", CASE WHEN b IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS "missing:b" FROM {_EV}')(_filled(P.MissingIndicator))
query("iterative_imputer")(_filled(P.IterativeImputer, 4))


@query("knn_imputer", """WITH x AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE CAST(s_acctbal AS DOUBLE) END AS a, CAST(s_nationkey AS DOUBLE) AS b FROM supplier),
    n AS (SELECT q.id, r.a, row_number() OVER (PARTITION BY q.id ORDER BY abs(q.b - r.b), r.id) AS k FROM x q JOIN x r ON r.a IS NOT NULL WHERE q.a IS NULL)
    SELECT x.id, round(coalesce(x.a, m.a), 6) AS a, x.b FROM x LEFT JOIN (SELECT id, avg(a) AS a FROM n WHERE k <= 5 GROUP BY id) m ON x.id = m.id""")
def _knn_imputer(s, d):
    df = table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 5 != 0, F.col("s_acctbal").cast("double")).alias("a"), F.col("s_nationkey").cast("double").alias("b"))
    return rounded(P.KNNImputer().fit(df, ["a", "b"], key="id").transform(df))


# -- selection --------------------------------------------------------------------------------------------------------
_CAND = ["q", "price", "d", "t"]


def _chosen(s, names):
    return s.createDataFrame([(n,) for n in names] or [], "feature string")


def _select(make, label="flag"):
    return lambda s, d: _chosen(s, make().fit(lines(s, d), _CAND, label).selected_)


query("variance_threshold", f"SELECT feature FROM (SELECT var_pop(q) AS q, var_pop(price) AS price, var_pop(d) AS d, var_pop(t) AS t FROM {LINE_SQL}) UNPIVOT (v FOR feature IN (q, price, d, t)) WHERE v > 10")(_select(lambda: S.VarianceThreshold(threshold=10.0)))
_R2 = "SELECT feature FROM (SELECT " + ", ".join(f"pow(corr({f}, status), 2) AS {f}" for f in _CAND) + f" FROM {LINE_SQL}) UNPIVOT (v FOR feature IN (q, price, d, t)) ORDER BY v DESC LIMIT {{k}}"
query("select_k_best", _R2.format(k=2))(_select(lambda: S.SelectKBest(k=2, score_func=S.f_classif), "status"))
query("select_percentile", _R2.format(k=2))(_select(lambda: S.SelectPercentile(percentile=50, score_func=S.f_classif), "status"))
query("select_fpr")(_select(lambda: S.SelectFpr(alpha=0.05)))
query("select_fdr")(_select(lambda: S.SelectFdr(alpha=0.05)))
query("select_fwe")(_select(lambda: S.SelectFwe(alpha=0.05)))
query("generic_univariate_select", _R2.format(k=1))(_select(lambda: S.GenericUnivariateSelect(mode="k_best", param=1, score_func=S.f_classif), "status"))
query("select_from_model")(_select(lambda: S.SelectFromModel(estimator=Ridge()), "status"))
query("rfe")(_select(lambda: S.RFE(estimator=LinearRegression(), n_features_to_select=2), "price"))


def _cv_select(cls, **kw):
    def run(s, d):
        df = orders(s, d).withColumn("y", F.col("total") * 2 + F.col("month"))
        return _chosen(s, cls(estimator=LinearRegression(), cv=K.KFold(n_splits=2), scoring="r2", **kw).fit(df, ["total", "month", "year"], "y", key="o_orderkey").selected_)

    return run


query("rfecv")(_cv_select(S.RFECV))
query("sequential_feature_selector")(_cv_select(S.SequentialFeatureSelector, n_features_to_select=2))

# -- splitters --------------------------------------------------------------------------------------------------------
_POS = "(SELECT o_orderkey, o_orderpriority, o_custkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM orders)"


def _orders(s, d):
    return table(s, d, "orders").select("o_orderkey", "o_orderpriority", "o_custkey", "o_orderstatus")


query("kfold", f"SELECT o_orderkey, CAST(least(floor(pos / floor(n / 4)), 3) AS INTEGER) AS fold FROM {_POS}")(lambda s, d: K.KFold(n_splits=4).folds(_orders(s, d), "o_orderkey").select("o_orderkey", "fold"))
_STR = """(SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS r, count(*) OVER (PARTITION BY o_orderpriority) AS c FROM orders)"""
query("stratified_kfold", f"SELECT o_orderkey, CAST(CASE WHEN r < (c % 4) * (c // 4 + 1) THEN r // (c // 4 + 1) ELSE c % 4 + (r - (c % 4) * (c // 4 + 1)) // (c // 4) END AS INTEGER) AS fold FROM {_STR}")(lambda s, d: K.StratifiedKFold(n_splits=4).folds(_orders(s, d), "o_orderkey", "o_orderpriority").select("o_orderkey", "fold"))
query("group_kfold", """WITH g AS (SELECT o_custkey, row_number() OVER (ORDER BY o_custkey) - 1 AS r, count(*) OVER () AS c FROM (SELECT DISTINCT o_custkey FROM orders))
    SELECT o_orderkey, CAST(CASE WHEN r < (c % 4) * (c // 4 + 1) THEN r // (c // 4 + 1) ELSE c % 4 + (r - (c % 4) * (c // 4 + 1)) // (c // 4) END AS INTEGER) AS fold FROM orders o JOIN g ON o.o_custkey = g.o_custkey""")(lambda s, d: K.GroupKFold(n_splits=4).folds(_orders(s, d), "o_orderkey", groups="o_custkey").select("o_orderkey", "fold"))


def _sizes(df):
    return df.groupBy("split").agg(F.sum(F.col("is_test").cast("long")).alias("test"), F.sum((~F.col("is_test")).cast("long")).alias("train"))


_TS = f"""WITH p AS (SELECT o_orderkey, pos, n FROM {_POS}), s AS (SELECT CAST(i AS INTEGER) AS split, i FROM range(4) t(i))
    SELECT split, CAST(sum(CASE WHEN pos >= st AND pos < least(n, st + sz) THEN 1 ELSE 0 END) AS BIGINT) AS test, CAST(sum(CASE WHEN pos < st - 3 THEN 1 ELSE 0 END) AS BIGINT) AS train
    FROM (SELECT split, pos, n, ((i + 1) * n) // 5 AS st, n // 5 AS sz FROM p, s) GROUP BY split"""
query("time_series_split", _TS)(lambda s, d: _sizes(K.TimeSeriesSplit(n_splits=4, gap=3).split(_orders(s, d), "o_orderkey")))
_N = "(SELECT count(*) AS n FROM orders)"
query("repeated_kfold", f"SELECT CAST(i AS INTEGER) AS split, CAST(CASE WHEN i % 3 = 2 THEN n - 2 * (n // 3) ELSE n // 3 END AS BIGINT) AS test, CAST(n - CASE WHEN i % 3 = 2 THEN n - 2 * (n // 3) ELSE n // 3 END AS BIGINT) AS train FROM {_N}, range(6) t(i)")(lambda s, d: _sizes(K.RepeatedKFold(n_splits=3, n_repeats=2).split(_orders(s, d), "o_orderkey")))
query("repeated_stratified_kfold", f"""WITH c AS (SELECT o_orderpriority, count(*) AS c FROM orders GROUP BY 1), f AS (SELECT i, sum(c // 3 + CASE WHEN i % 3 < c % 3 THEN 1 ELSE 0 END) AS t FROM c, range(6) r(i) GROUP BY i)
    SELECT CAST(i AS INTEGER) AS split, CAST(t AS BIGINT) AS test, CAST(n - t AS BIGINT) AS train FROM f, {_N}""")(lambda s, d: _sizes(K.RepeatedStratifiedKFold(n_splits=3, n_repeats=2).split(_orders(s, d), "o_orderkey", "o_orderpriority")))
query("shuffle_split", f"SELECT CAST(i AS INTEGER) AS split, CAST(round(n * 0.2) AS BIGINT) AS test, CAST(n - round(n * 0.2) AS BIGINT) AS train FROM {_N}, range(3) t(i)")(lambda s, d: _sizes(K.ShuffleSplit(n_splits=3, test_size=0.2).split(_orders(s, d), "o_orderkey")))
query("stratified_shuffle_split", f"SELECT CAST(i AS INTEGER) AS split, CAST(round(n * 0.2) AS BIGINT) AS test, CAST(n - round(n * 0.2) AS BIGINT) AS train FROM {_N}, range(3) t(i)")(lambda s, d: _sizes(K.StratifiedShuffleSplit(n_splits=3, test_size=0.2).split(_orders(s, d), "o_orderkey", "o_orderpriority")))


@query("group_shuffle_split", "SELECT CAST(i AS INTEGER) AS split, CAST(round(n * 0.2) AS BIGINT) AS test_groups, CAST(0 AS BIGINT) AS in_both FROM (SELECT count(DISTINCT o_custkey) AS n FROM orders), range(3) t(i)")
def _group_shuffle(s, d):
    o = _orders(s, d)
    sides = K.GroupShuffleSplit(n_splits=3, test_size=0.2).split(o, "o_orderkey", groups="o_custkey").join(o, F.col("key") == F.col("o_orderkey")).groupBy("split", "o_custkey").agg(F.max(F.col("is_test").cast("int")).alias("hi"), F.min(F.col("is_test").cast("int")).alias("lo"))
    return sides.groupBy("split").agg(F.sum(F.col("hi").cast("long")).alias("test_groups"), F.sum((F.col("hi") != F.col("lo")).cast("long")).alias("in_both"))


query("predefined_split", "SELECT CAST(f AS INTEGER) AS split, CAST(sum(CASE WHEN k = f THEN 1 ELSE 0 END) AS BIGINT) AS test, CAST(sum(CASE WHEN k <> f THEN 1 ELSE 0 END) AS BIGINT) AS train FROM (SELECT o_orderkey % 4 - 1 AS k FROM orders), range(3) t(f) GROUP BY f")(lambda s, d: _sizes(K.PredefinedSplit(test_fold="k").split(_orders(s, d).withColumn("k", F.col("o_orderkey") % 4 - 1), "o_orderkey")))
query("leave_one_out", "SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS INTEGER) AS fold FROM orders")(lambda s, d: K.LeaveOneOut().folds(_orders(s, d), "o_orderkey").select("o_orderkey", "fold"))
query("leave_p_out", "SELECT CAST(300 AS BIGINT) AS splits, CAST(2 AS BIGINT) AS least, CAST(2 AS BIGINT) AS most")(lambda s, d: _sizes(K.LeavePOut(p=2).split(table(s, d, "nation"), "n_nationkey")).agg(F.count("*").alias("splits"), F.min("test").alias("least"), F.max("test").alias("most")))
query("train_test_split", f"SELECT o_orderkey, CASE WHEN pos < n - CAST(floor(n * 0.25) AS BIGINT) THEN 0 ELSE 1 END AS test FROM {_POS}")(lambda s, d: (lambda a, b: a.select("o_orderkey", F.lit(0).alias("test")).unionByName(b.select("o_orderkey", F.lit(1).alias("test"))))(*K.train_test_split(_orders(s, d), "o_orderkey", 0.25, shuffle=False)))
query("train_test_split_stratified", "SELECT o_orderpriority, CAST(floor(count(*) * 0.25) AS BIGINT) AS test FROM orders GROUP BY 1")(lambda s, d: U.train_test_split_stratified(_orders(s, d), "o_orderkey", "o_orderpriority", 0.25)[1].groupBy("o_orderpriority").agg(F.count("*").alias("test")))
query("parameter_grid", "SELECT CAST(a AS BIGINT) AS a, b FROM (VALUES (1), (2), (3)) x(a), (VALUES ('u'), ('v')) y(b)")(lambda s, d: s.createDataFrame([(p["a"], p["b"]) for p in K.ParameterGrid({"b": ["u", "v"], "a": [1, 2, 3]})], "a long, b string"))
query("parameter_sampler")(lambda s, d: s.createDataFrame([(i, p["a"]) for i, p in enumerate(K.ParameterSampler({"a": [1, 2, 3]}, 5, 7))], "i long, a long"))

# -- searches ---------------------------------------------------------------------------------------------------------
_XF, _XY = ["total", "month"], "y"


def _noisy(s, d):
    return orders(s, d).withColumn("y", F.col("total") * 0.5 + F.col("day") * 3).select("o_orderkey", *_XF, "y")


def _folds_sql():
    parts = []
    for k in range(3):
        parts.append(f"SELECT {k} AS split, (SELECT regr_slope(y, total) FROM f WHERE fold <> {k}) AS b, (SELECT regr_intercept(y, total) FROM f WHERE fold <> {k}) AS a")
    return f"""WITH o AS (SELECT o_orderkey, total, total * 0.5 + day * 3 AS y FROM {ORDERS_SQL}), f AS (SELECT *, least(floor((row_number() OVER (ORDER BY o_orderkey) - 1) / floor(count(*) OVER () / 3)), 2) AS fold FROM o),
    m AS ({' UNION ALL '.join(parts)}) SELECT CAST(split AS BIGINT) AS split, round(1 - avg(pow(y - a - b * total, 2)) / var_pop(y), 6) AS r2 FROM f JOIN m ON f.fold = m.split GROUP BY split"""


query("cross_val_score", _folds_sql())(lambda s, d: rounded(s.createDataFrame(list(enumerate(X.cross_val_score(LinearRegression(), _noisy(s, d), ["total"], "y", K.KFold(n_splits=3), "r2", key="o_orderkey"))), "split long, r2 double")))


def _search(cls, **kw):
    def run(s, d):
        m = cls(estimator=Ridge(), cv=K.KFold(n_splits=2), scoring="r2", key="o_orderkey", **kw).fit(_noisy(s, d), _XF, _XY)
        return value(s, alpha=m.best_params_["alpha"], score=round(m.best_score_, 6))

    return run


_ALPHAS = {"alpha": [0.1, 10.0, 1e7]}
query("grid_search_cv")(_search(X.GridSearchCV, param_grid=_ALPHAS))
query("randomized_search_cv")(_search(X.RandomizedSearchCV, param_distributions=_ALPHAS, n_iter=3))
query("halving_grid_search_cv")(_search(X.HalvingGridSearchCV, param_grid=_ALPHAS))
query("halving_random_search_cv")(_search(X.HalvingRandomSearchCV, param_distributions=_ALPHAS, n_candidates=3))

# -- utilities --------------------------------------------------------------------------------------------------------
query("compute_class_weight", "SELECT o_orderpriority AS label, round(sum(count(*)) OVER () / (count(*) OVER () * count(*))::DOUBLE, 6) AS weight FROM orders GROUP BY o_orderpriority")(lambda s, d: rounded(U.compute_class_weight(_orders(s, d), "o_orderpriority")))
query("compute_sample_weight", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS sample_weight FROM orders")(lambda s, d: U.compute_sample_weight(_orders(s, d).select("o_orderkey"), "o_orderkey", _orders(s, d).filter("o_orderkey % 3 = 0").select("o_orderkey", F.lit(2.0).alias("w"))))
query("type_of_target", "SELECT 'binary' AS status, 'multiclass' AS flag, 'continuous' AS price")(lambda s, d: s.createDataFrame([tuple(U.type_of_target(lines(s, d), c) for c in ("status", "flag", "price"))], "status string, flag string, price string"))
query("check_finite", "SELECT true AS whole, false AS holes, true AS has_nan")(lambda s, d: s.createDataFrame([(U.check_finite(orders(s, d), ["total"]), U.check_finite(holes(s, d), ["a"]), U.check_has_nan(holes(s, d), ["a"]))], "whole boolean, holes boolean, has_nan boolean"))
query("unique_labels", "SELECT DISTINCT o_orderstatus AS label FROM orders")(lambda s, d: s.createDataFrame([(v,) for v in U.unique_labels(_orders(s, d), "o_orderstatus")], "label string"))
query("shuffle", "SELECT count(*) AS n, CAST(count(*) AS BIGINT) AS places, CAST(count(*) - 1 AS BIGINT) AS last FROM orders")(lambda s, d: U.shuffle(_orders(s, d), "o_orderkey").agg(F.count("*").alias("n"), F.count_distinct("position").alias("places"), F.max("position").cast("long").alias("last")))
query("resample")(lambda s, d: U.resample(_orders(s, d)).groupBy("o_orderstatus").agg(F.count("*").alias("n")))


@query("pcg64")
def _pcg(s, d):
    g = PCG64(42)
    return s.createDataFrame([(i, g.uniform(), g.normal(), g.randint(0, 100)) for i in range(100)], "i long, u double, z double, k long")


