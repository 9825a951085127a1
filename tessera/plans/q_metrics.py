"""Queries for the metrics, over labels and predictions that are expressions of line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import metrics as M
from tessera.operators import feature_selection as S
from tessera.plans.registry import query
from tessera.plans.shared import LINE_SQL, lines, rounded, table, value

#: y, p: two classes; y3, p3: three; s: a score; r, g: a number and its guess.
_ROWS = f"""rows AS (SELECT status AS y, CASE WHEN q > 25 THEN 1 ELSE 0 END AS p, flag AS y3, CASE WHEN q < 17 THEN 0 WHEN q < 34 THEN 1 ELSE 2 END AS p3,
    CAST(q / 50.0 AS DOUBLE) AS s, CAST(price AS DOUBLE) AS r, CAST(q * 1.5 + 1 AS DOUBLE) AS g, CAST(q AS DOUBLE) AS q, CAST(d AS DOUBLE) AS d, CAST(t AS DOUBLE) AS t FROM {LINE_SQL})"""


def rows(spark, sf):
    q = F.col("q")
    return lines(spark, sf).select(
        F.col("status").alias("y"), (q > 25).cast("int").alias("p"), F.col("flag").alias("y3"), F.when(q < 17, 0).when(q < 34, 1).otherwise(2).alias("p3"),
        (q / 50.0).alias("s"), F.col("price").alias("r"), (q * 1.5 + 1).alias("g"), "q", "d", "t",
    )


def _one(sql: str) -> str:
    return f"WITH {_ROWS} SELECT round(CAST({sql} AS DOUBLE), 6) AS value FROM rows"


# -- regression -------------------------------------------------------------------------------------------------------
_D = "(r - g)"
_AGG = {
    "mean_squared_error": (M.mean_squared_error, f"avg({_D} * {_D})"),
    "root_mean_squared_error": (M.root_mean_squared_error, f"sqrt(avg({_D} * {_D}))"),
    "mean_absolute_error": (M.mean_absolute_error, f"avg(abs{_D})"),
    "median_absolute_error": (M.median_absolute_error, f"quantile_cont(abs{_D}, 0.5)"),
    "max_error": (M.max_error, f"max(abs{_D})"),
    "r2_score": (M.r2_score, f"1 - avg({_D} * {_D}) / var_pop(r)"),
    "explained_variance_score": (M.explained_variance_score, f"1 - var_pop{_D} / var_pop(r)"),
    "mean_absolute_percentage_error": (M.mean_absolute_percentage_error, f"100 * avg(abs({_D} / r)) FILTER (WHERE abs(r) > 1e-8)"),
    "mean_poisson_deviance": (M.mean_poisson_deviance, "avg(2 * (r * ln(r / g) - (r - g)))"),
    "mean_gamma_deviance": (M.mean_gamma_deviance, "avg(2 * (ln(g / r) + (r - g) / g))"),
}
for _name, (_f, _sql) in _AGG.items():
    query(f"metric_{_name}", _one(_sql))(lambda s, d, f=_f: rounded(rows(s, d).agg(f("r", "g").alias("value"))))

query("metric_mean_tweedie_deviance", _one("avg(2 * (pow(r, 0.5) / (-0.25) - r * pow(g, -0.5) / (-0.5) + pow(g, 0.5) / 0.5))"))(lambda s, d: rounded(rows(s, d).agg(M.mean_tweedie_deviance("r", "g", 1.5).alias("value"))))
_NULL = "WITH {rows}, m AS (SELECT {null} AS m FROM rows) SELECT round(1 - avg({top}) / avg({low}), 6) AS value FROM rows, m"
_TW = "2 * (CASE WHEN r > 0 THEN r * ln(r / {0}) ELSE 0 END - (r - {0}))"
query("metric_d2_tweedie_score", _NULL.format(rows=_ROWS, null="avg(r)", top=_TW.format("g"), low=_TW.format("m")))(lambda s, d: rounded(M.d2_tweedie_score_df(rows(s, d), "r", "g", 1.0)))
_PIN = "CASE WHEN r >= {0} THEN 0.3 * (r - {0}) ELSE 0.7 * ({0} - r) END"
query("metric_d2_pinball_score", _NULL.format(rows=_ROWS, null="quantile_cont(r, 0.3)", top=_PIN.format("g"), low=_PIN.format("m")))(lambda s, d: rounded(M.d2_pinball_score_df(rows(s, d), "r", "g", 0.3)))
query("metric_d2_absolute_error_score", _NULL.format(rows=_ROWS, null="quantile_cont(r, 0.5)", top="abs(r - g)", low="abs(r - m)"))(lambda s, d: rounded(M.d2_absolute_error_score_df(rows(s, d), "r", "g")))

# -- labels -----------------------------------------------------------------------------------------------------------
query("metric_accuracy_score", _one("avg(CASE WHEN y3 = p3 THEN 1.0 ELSE 0.0 END)"))(lambda s, d: rounded(rows(s, d).agg(M.accuracy_score("y3", "p3").alias("value"))))
query("metric_zero_one_loss", _one("1 - avg(CASE WHEN y3 = p3 THEN 1.0 ELSE 0.0 END)"))(lambda s, d: rounded(rows(s, d).agg(M.zero_one_loss("y3", "p3").alias("value"))))
query("metric_hamming_loss", _one("avg(CASE WHEN y3 <> p3 THEN 1.0 ELSE 0.0 END)"))(lambda s, d: rounded(rows(s, d).agg(M.hamming_loss("y3", "p3").alias("value"))))
query("metric_confusion_matrix", f"WITH {_ROWS} SELECT y3 AS t, p3 AS p, CAST(count(*) AS DOUBLE) AS n FROM rows GROUP BY 1, 2")(lambda s, d: M.confusion_matrix(rows(s, d), "y3", "p3"))
_PER = f"""WITH {_ROWS}, per AS (SELECT c.c, CAST(sum(CASE WHEN y3 = c.c THEN 1 ELSE 0 END) AS DOUBLE) AS support, CAST(sum(CASE WHEN p3 = c.c THEN 1 ELSE 0 END) AS DOUBLE) AS predicted,
    CAST(sum(CASE WHEN y3 = c.c AND p3 = c.c THEN 1 ELSE 0 END) AS DOUBLE) AS hit FROM rows, (SELECT DISTINCT y3 AS c FROM rows) c GROUP BY c.c)"""
_KINDS = {"precision": ("hit", "predicted", M.precision_score_df), "recall": ("hit", "support", M.recall_score_df), "jaccard": ("hit", "(support + predicted - hit)", M.jaccard_score_df)}
_HOW = {"macro": "avg({t} / {l})", "weighted": "sum({t} / {l} * support) / sum(support)", "micro": "sum({t}) / sum({l})"}
for _k, (_t, _l, _f) in _KINDS.items():
    for _h, _e in _HOW.items():
        query(f"metric_{_k}_score_{_h}", f"{_PER} SELECT round({_e.format(t=_t, l=_l)}, 6) AS value FROM per")(lambda s, d, f=_f, h=_h: rounded(f(rows(s, d), "y3", "p3", h)))
for _h, _e in _HOW.items():
    _a, _b = _e.format(t="hit", l="predicted"), _e.format(t="hit", l="support")
    query(f"metric_f1_score_{_h}", f"{_PER} SELECT round(2 * ({_a}) * ({_b}) / (({_a}) + ({_b})), 6) AS value FROM per")(lambda s, d, h=_h: rounded(M.f1_score_df(rows(s, d), "y3", "p3", h)))
query("metric_f1_per_class", f"{_PER} SELECT c, round(2 * hit / (support + predicted), 6) AS value FROM per")(lambda s, d: rounded(M.f1_per_class_df(rows(s, d), "y3", "p3")))
query("metric_balanced_accuracy_score", f"{_PER} SELECT round(avg(hit / support), 6) AS value FROM per")(lambda s, d: rounded(M.balanced_accuracy_score_df(rows(s, d), "y3", "p3")))
query("metric_classification_report", f"""{_PER} SELECT 'precision' AS measure, round(avg(hit / predicted), 3) AS value FROM per UNION ALL SELECT 'recall', round(avg(hit / support), 3) FROM per
    UNION ALL SELECT 'f1', round(2 * avg(hit / predicted) * avg(hit / support) / (avg(hit / predicted) + avg(hit / support)), 3) FROM per UNION ALL SELECT 'accuracy', round(sum(hit) / sum(support), 3) FROM per""")(lambda s, d: M.classification_report_df(rows(s, d), "y3", "p3"))
_MARG = f"WITH {_ROWS}, c AS (SELECT y3 AS t, p3 AS p, CAST(count(*) AS DOUBLE) AS n FROM rows GROUP BY 1, 2), a AS (SELECT t, sum(n) AS a FROM c GROUP BY t), b AS (SELECT p, sum(n) AS b FROM c GROUP BY p), z AS (SELECT sum(n) AS n FROM c)"
query("metric_cohen_kappa_score", f"""{_MARG}, e AS (SELECT sum(a.a * b.b) AS e FROM a JOIN b ON a.t = b.p), h AS (SELECT sum(n) AS h FROM c WHERE t = p)
    SELECT round((h.h / z.n - e.e / z.n / z.n) / (1 - e.e / z.n / z.n), 6) AS value FROM e, h, z""")(lambda s, d: rounded(M.cohen_kappa_score_df(rows(s, d), "y3", "p3")))
query("metric_matthews_corrcoef", f"""WITH {_ROWS}, m AS (SELECT CAST(sum(CASE WHEN y = 1 AND p = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS tp, CAST(sum(CASE WHEN y = 0 AND p = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS tn,
    CAST(sum(CASE WHEN y = 0 AND p = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS fp, CAST(sum(CASE WHEN y = 1 AND p = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS fn FROM rows)
    SELECT round((tp * tn - fp * fn) / (sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn)), 6) AS value FROM m""")(lambda s, d: rounded(M.matthews_corrcoef_df(rows(s, d), "y", "p")))

# -- scores -----------------------------------------------------------------------------------------------------------
query("metric_brier_score_loss", _one("avg((s - y) * (s - y))"))(lambda s, d: rounded(rows(s, d).agg(M.brier_score_loss("y", "s").alias("value"))))
_CL = "greatest(least({0}, 1 - 1e-15), 1e-15)"
query("metric_log_loss", _one(f"avg(-ln(CASE WHEN y = 1 THEN {_CL.format('s')} ELSE {_CL.format('(1 - s)')} END))"))(lambda s, d: rounded(rows(s, d).withColumn("s0", 1 - F.col("s")).agg(M.log_loss("y", ["s0", "s"], [0, 1]).alias("value"))))
query("metric_hinge_loss", _one("avg(greatest(0.0, 1 - CASE WHEN y > 0 THEN 1.0 ELSE -1.0 END * (s * 2 - 1)))"))(lambda s, d: rounded(rows(s, d).withColumn("h", F.col("s") * 2 - 1).agg(M.hinge_loss("y", "h").alias("value"))))
query("metric_top_k_accuracy_score", f"""WITH {_ROWS}, x AS (SELECT y3, CAST(1 - s AS DOUBLE) AS a, CAST(0.5 AS DOUBLE) AS b, s AS c FROM rows), k AS (SELECT y3,
    CASE WHEN b >= a THEN 1 ELSE 0 END + CASE WHEN c >= a THEN 1 ELSE 0 END AS over0, CASE WHEN a > b THEN 1 ELSE 0 END + CASE WHEN c >= b THEN 1 ELSE 0 END AS over1, CASE WHEN a > c THEN 1 ELSE 0 END + CASE WHEN b > c THEN 1 ELSE 0 END AS over2 FROM x)
    SELECT round(avg(CASE WHEN (CASE y3 WHEN 0 THEN over0 WHEN 1 THEN over1 ELSE over2 END) < 2 THEN 1.0 ELSE 0.0 END), 6) AS value FROM k""")(lambda s, d: rounded(rows(s, d).select("y3", (1 - F.col("s")).alias("a"), F.lit(0.5).alias("b"), F.col("s").alias("c")).agg(M.top_k_accuracy_score("y3", ["a", "b", "c"], 2).alias("value"))))
_AUC = """(SELECT sum(neg * (tp - pos / 2.0)) / (sum(pos) * sum(neg)) AS v FROM (SELECT pos, neg, sum(pos) OVER (ORDER BY s DESC) AS tp FROM
    (SELECT {s} AS s, sum(CASE WHEN {y} THEN 1.0 ELSE 0.0 END) AS pos, sum(CASE WHEN {y} THEN 0.0 ELSE 1.0 END) AS neg FROM rows GROUP BY 1)))"""
query("metric_roc_auc_score", f"WITH {_ROWS} SELECT round(CAST(v AS DOUBLE), 6) AS value FROM {_AUC.format(s='s', y='y = 1')}")(lambda s, d: rounded(M.roc_auc_score_df(rows(s, d), "y", "s")))
query("metric_roc_auc_score_multiclass", f"WITH {_ROWS} SELECT round(CAST((a.v + b.v + c.v) / 3 AS DOUBLE), 6) AS value FROM {_AUC.format(s='(1 - s)', y='y3 = 0')} a, {_AUC.format(s='d', y='y3 = 1')} b, {_AUC.format(s='s', y='y3 = 2')} c")(lambda s, d: rounded(M.roc_auc_score_multiclass_df(rows(s, d).withColumn("a", 1 - F.col("s")), "y3", ["a", "d", "s"])))
query("metric_average_precision_score", f"""WITH {_ROWS} SELECT round(CAST(sum(pos * tp / (tp + fp)) / sum(pos) AS DOUBLE), 6) AS value FROM (SELECT pos, sum(pos) OVER (ORDER BY s DESC) AS tp, sum(neg) OVER (ORDER BY s DESC) AS fp FROM
    (SELECT s, CAST(sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS pos, CAST(sum(CASE WHEN y = 1 THEN 0 ELSE 1 END) AS DOUBLE) AS neg FROM rows GROUP BY s))""")(lambda s, d: rounded(M.average_precision_score_df(rows(s, d), "y", "s")))

# -- clusterings ------------------------------------------------------------------------------------------------------
_P2 = f"{_MARG}, i AS (SELECT sum(n * (n - 1) / 2) AS i FROM c), pa AS (SELECT sum(a * (a - 1) / 2) AS a FROM a), pb AS (SELECT sum(b * (b - 1) / 2) AS b FROM b)"
query("metric_adjusted_rand_score", f"{_P2} SELECT round((i.i - pa.a * pb.b / (z.n * (z.n - 1) / 2)) / ((pa.a + pb.b) / 2 - pa.a * pb.b / (z.n * (z.n - 1) / 2)), 6) AS value FROM i, pa, pb, z")(lambda s, d: rounded(M.adjusted_rand_score_df(rows(s, d), "y3", "p3")))
query("metric_fowlkes_mallows_score", f"{_P2} SELECT round(i.i / sqrt(pa.a * pb.b), 6) AS value FROM i, pa, pb")(lambda s, d: rounded(M.fowlkes_mallows_score_df(rows(s, d), "y3", "p3")))
_H = f"{_MARG}, hy AS (SELECT -sum(a / z.n * ln(a / z.n)) AS h FROM a, z), hp AS (SELECT -sum(b / z.n * ln(b / z.n)) AS h FROM b, z), hj AS (SELECT -sum(c.n / z.n * ln(c.n / z.n)) AS h FROM c, z), e AS (SELECT hy.h AS y, hp.h AS p, hy.h + hp.h - hj.h AS m FROM hy, hp, hj)"
query("metric_normalized_mutual_info_score", f"{_H} SELECT round(m / ((y + p) / 2), 6) AS value FROM e")(lambda s, d: rounded(M.normalized_mutual_info_score_df(rows(s, d), "y3", "p3")))
query("metric_homogeneity_score", f"{_H} SELECT round(m / y, 6) AS value FROM e")(lambda s, d: rounded(M.homogeneity_score_df(rows(s, d), "y3", "p3")))
query("metric_completeness_score", f"{_H} SELECT round(m / p, 6) AS value FROM e")(lambda s, d: rounded(M.completeness_score_df(rows(s, d), "y3", "p3")))
query("metric_v_measure_score", f"{_H} SELECT round(2 * m / y * m / p / (m / y + m / p), 6) AS value FROM e")(lambda s, d: rounded(M.v_measure_score_df(rows(s, d), "y3", "p3")))
query("metric_adjusted_mutual_info_score")(lambda s, d: value(s, value=round(M.adjusted_mutual_info_score(rows(s, d), "y3", "p3"), 6)))
_CS = f"""WITH {_ROWS}, m AS (SELECT p3, avg(q) AS mq, avg(r) AS mr, CAST(count(*) AS DOUBLE) AS n FROM rows GROUP BY p3), a AS (SELECT avg(q) AS aq, avg(r) AS ar FROM rows),
    w AS (SELECT m.p3, sum(pow(rows.q - mq, 2) + pow(r - mr, 2)) AS w, avg(sqrt(pow(rows.q - mq, 2) + pow(r - mr, 2))) AS s FROM rows JOIN m ON rows.p3 = m.p3 GROUP BY m.p3)"""
query("metric_calinski_harabasz_score", f"{_CS} SELECT round((SELECT sum(n * (pow(mq - aq, 2) + pow(mr - ar, 2))) FROM m, a) / 2 / ((SELECT sum(w) FROM w) / ((SELECT sum(n) FROM m) - 3)), 4) AS value")(lambda s, d: value(s, value=round(M.calinski_harabasz_score(rows(s, d), ["q", "r"], "p3"), 4)))
query("metric_davies_bouldin_score", f"""{_CS}, c AS (SELECT m.p3, mq, mr, s FROM m JOIN w ON m.p3 = w.p3)
    SELECT round(avg(v), 6) AS value FROM (SELECT x.p3, max((x.s + y.s) / sqrt(pow(x.mq - y.mq, 2) + pow(x.mr - y.mr, 2))) AS v FROM c x JOIN c y ON x.p3 <> y.p3 GROUP BY x.p3)""")(lambda s, d: value(s, value=round(M.davies_bouldin_score(rows(s, d), ["q", "r"], "p3"), 6)))
_SIL = """WITH x AS (SELECT s_suppkey AS id, CAST(s_acctbal AS DOUBLE) AS v, CAST(s_nationkey % 3 AS INTEGER) AS c FROM supplier), k AS (SELECT c, CAST(count(*) AS DOUBLE) AS n FROM x GROUP BY c),
    m AS (SELECT a.id, a.c AS own, b.c AS other, sum(abs(a.v - b.v)) AS s FROM x a, x b GROUP BY 1, 2, 3), j AS (SELECT m.id, m.own, max(CASE WHEN m.other = m.own THEN s / (n - 1) END) AS a, min(CASE WHEN m.other <> m.own THEN s / n END) AS b FROM m JOIN k ON m.other = k.c GROUP BY 1, 2)"""


def _suppliers(s, d):
    return table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").cast("double").alias("v"), (F.col("s_nationkey") % 3).cast("int").alias("c"))


query("metric_silhouette_samples", f"{_SIL} SELECT id, round((b - a) / greatest(a, b), 6) AS silhouette FROM j")(lambda s, d: rounded(M.silhouette_samples(_suppliers(s, d), ["v"], "c").select("id", "silhouette")))
query("metric_silhouette_score", f"{_SIL} SELECT round(avg((b - a) / greatest(a, b)), 6) AS value FROM j")(lambda s, d: value(s, value=round(M.silhouette_score(_suppliers(s, d), ["v"], "c"), 6)))

# -- feature scores ---------------------------------------------------------------------------------------------------
def _scores(f):
    return lambda s, d: rounded(s.createDataFrame([(k, float(v)) for k, v in f(rows(s, d), ["q", "d", "r"], "y3" if f is not S.f_regression else "r").items()], "feature string, value double"), 4)


_ANOVA = "SELECT '{f}' AS feature, round((b / 2) / (w / (n - 3)), 4) AS value FROM (SELECT sum(c.n * pow(c.m - a.m, 2)) AS b, sum(c.v) AS w, sum(c.n) AS n FROM (SELECT y3, avg({f}) AS m, CAST(count(*) AS DOUBLE) AS n, var_pop({f}) * count(*) AS v FROM rows GROUP BY y3) c, (SELECT avg({f}) AS m FROM rows) a)"
query("score_f_classif", f"WITH {_ROWS} " + " UNION ALL ".join(_ANOVA.format(f=f) for f in ("q", "d", "r")))(_scores(S.f_classif))
_BIN = "b_{f} AS (SELECT y3, least(floor(({f} - lo) * 10 / (hi - lo)), 9) AS b, CAST(count(*) AS DOUBLE) AS n FROM rows, (SELECT min({f}) AS lo, max({f}) AS hi FROM rows) GROUP BY 1, 2)"
_E = "SELECT '{f}' AS feature, round({e}, 4) AS value FROM (SELECT n, sum(n) OVER (PARTITION BY b) AS r, sum(n) OVER (PARTITION BY y3) AS c, sum(n) OVER () AS z FROM b_{f})"
_BINS = ", ".join(_BIN.format(f=f) for f in ("q", "d", "r"))
query("score_chi2", f"WITH {_ROWS}, {_BINS} " + " UNION ALL ".join(_E.format(f=f, e="sum(pow(n - r * c / z, 2) / (r * c / z))") for f in ("q", "d", "r")))(_scores(S.chi2))
query("score_mutual_info_classif", f"WITH {_ROWS}, {_BINS} " + " UNION ALL ".join(_E.format(f=f, e="sum(n / z * ln(n * z / r / c))") for f in ("q", "d", "r")))(_scores(S.mutual_info_classif))
query("score_f_regression", f"WITH {_ROWS} " + " UNION ALL ".join(f"SELECT '{f}' AS feature, round(pow(corr({f}, r), 2) / (1 - pow(corr({f}, r), 2)) * (count(*) - 2), 4) AS value FROM rows" for f in ("q", "d")))(lambda s, d: rounded(s.createDataFrame([(k, float(v)) for k, v in S.f_regression(rows(s, d), ["q", "d"], "r").items()], "feature string, value double"), 4))
query("score_mutual_info_regression")(lambda s, d: rounded(s.createDataFrame([(k, float(v)) for k, v in S.mutual_info_regression(rows(s, d), ["q", "d"], "r").items()], "feature string, value double"), 4))
