"""ML queries (E1-E7, R-*, K-*, X-1..X-3).

Classification data: the shopping view of ``events`` (features: session
duration, purchase history, event and category codes; label: the purchase
rule).  Regression data: line items with their part (``l_extendedprice`` from
``l_quantity`` and ``p_retailprice``).  Split: key arithmetic, 70/30.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.ml import metrics, models, prepare
from tessera.operators import events as ev
from tessera.plans.events import SHOP_CODES, SHOP_SQL, shopping_events
from tessera.plans.prep import EF_SQL, events_features
from tessera.plans.registry import register
from tessera.session import materialize
from tessera.sources.tables import load_table

SHOP_FEATURES = ["session_duration", "user_total_purchases", "event_code", "category_code"]
LINE_FEATURES = ["l_quantity", "p_retailprice"]


def shop_data(spark, sf):
    s = shopping_events(spark, sf)
    return s.select(
        "event_id",
        F.col("session_duration").cast("double").alias("session_duration"),
        F.col("user_total_purchases").cast("double").alias("user_total_purchases"),
        ev.code_of(F.col("event_type"), SHOP_CODES).cast("double").alias("event_code"),
        ev.category_code(F.col("product_category")).cast("double").alias("category_code"),
        ev.purchase_rule(F.col("event_type"), F.col("session_duration"),
                         F.col("user_total_purchases")).cast("double").alias("purchase"),
        prepare.split_flag(F.col("event_id")).alias("split"))


def line_data(spark, sf):
    li = load_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey",
                                                  "l_quantity", "l_extendedprice")
    p = load_table(spark, sf, "part").select("p_partkey", "p_retailprice")
    key = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    return li.join(p, li.l_partkey == p.p_partkey).select(
        "l_orderkey", "l_linenumber", "l_quantity", "p_retailprice", "l_extendedprice",
        prepare.split_flag(key).alias("split"))


_SPLIT_SQL = "CASE WHEN (({key}) * 2654435761 + 42) % 1000 < 700 THEN 'train' ELSE 'test' END"

_SHOP_DATA_SQL = SHOP_SQL + f"""
, d AS (SELECT event_id, CAST(session_duration AS DOUBLE) AS x1, CAST(user_total_purchases AS DOUBLE) AS x2,
               CAST(CASE WHEN (event_type = 'view' AND session_duration > 12 AND user_total_purchases > 10)
                    OR (event_type = 'add_to_cart' AND session_duration > 5 AND user_total_purchases > 4)
                    OR (event_type = 'click' AND session_duration > 7 AND user_total_purchases > 6)
                    THEN 1 ELSE 0 END AS DOUBLE) AS y,
               {_SPLIT_SQL.format(key='event_id')} AS split FROM s)
"""

_LINE_DATA_SQL = f"""
WITH d AS (SELECT l.l_orderkey, l.l_linenumber, l.l_quantity AS x, p.p_retailprice AS x2,
                  l.l_extendedprice AS y, {_SPLIT_SQL.format(key='l.l_orderkey * 8 + l.l_linenumber')} AS split
           FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey)
"""


def _r(df, cols):
    return df.select(*[F.round(F.col(c), 6).alias(c) if c in cols else F.col(c) for c in df.columns])


# ------------------------------------------------------------------ preparation
@register("ml_prepare", EF_SQL + """
, d AS (SELECT DISTINCT value, k, minute, log_value, event_type FROM ef),
m AS (SELECT AVG(value) AS mv, AVG(k) AS mk,
             (SELECT event_type FROM d WHERE event_type IS NOT NULL GROUP BY event_type
              ORDER BY COUNT(*) DESC, event_type LIMIT 1) AS mt FROM d),
f AS (SELECT COALESCE(value, m.mv) AS value, COALESCE(CAST(k AS DOUBLE), m.mk) AS k, minute, log_value,
             COALESCE(event_type, m.mt) AS event_type FROM d, m),
e AS (SELECT f.*, CAST(DENSE_RANK() OVER (ORDER BY event_type) - 1 AS INTEGER) AS code FROM f),
b AS (SELECT MIN(value) a1, MAX(value) b1, MIN(k) a2, MAX(k) b2, MIN(minute) a3, MAX(minute) b3,
             MIN(log_value) a4, MAX(log_value) b4 FROM e)
SELECT ROUND((value - a1) / (b1 - a1), 6) AS value, ROUND((k - a2) / (b2 - a2), 6) AS k,
       ROUND((minute - a3) / (b3 - a3), 6) AS minute, ROUND((log_value - a4) / (b4 - a4), 6) AS log_value,
       code AS event_type
FROM e, b""")
def ml_prepare(spark, sf):
    df = events_features(spark, sf).drop("event_id", "user_id")
    out = prepare.prepare(df, target=None)
    return _r(out, ["value", "k", "minute", "log_value"])


_PT_COLS = ["l_returnflag", "l_linenumber", "l_discount", "l_quantity", "l_extendedprice"]


@register("problem_type", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS target, CASE WHEN {('TRUE' if c == 'l_returnflag' else 'FALSE')} "
    f"OR COUNT(DISTINCT {c}) <= 20 THEN 'classification' ELSE 'regression' END AS problem_type FROM lineitem"
    for c in _PT_COLS))
def problem_type(spark, sf):
    """Problem type of each candidate target column, from one aggregate."""
    li = load_table(spark, sf, "lineitem")
    types = dict(li.dtypes)
    row = li.agg(*[F.count_distinct(c).alias(c) for c in _PT_COLS])
    rows = [F.struct(F.lit(c).alias("target"),
                     (F.lit("classification") if types[c] == "string" else
                      F.when(F.col(c) <= prepare.MAX_CLASSES, "classification").otherwise("regression"))
                     .alias("problem_type")) for c in _PT_COLS]
    return row.select(F.inline(F.array(*rows)))


@register("label_encode", """
SELECT l_orderkey, l_linenumber,
       CAST(DENSE_RANK() OVER (ORDER BY l_returnflag) - 1 AS INTEGER) AS l_returnflag,
       CAST(DENSE_RANK() OVER (ORDER BY l_linestatus) - 1 AS INTEGER) AS l_linestatus
FROM lineitem""")
def label_encode(spark, sf):
    li = load_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag",
                                                  "l_linestatus")
    return prepare.encode_labels(li, ["l_returnflag", "l_linestatus"])


@register("standardize", """
SELECT l_orderkey, l_linenumber,
       ROUND((l_quantity - AVG(l_quantity) OVER ()) / STDDEV_POP(l_quantity) OVER (), 6) AS l_quantity,
       ROUND((l_extendedprice - AVG(l_extendedprice) OVER ()) / STDDEV_POP(l_extendedprice) OVER (), 6)
         AS l_extendedprice,
       ROUND((l_discount - AVG(l_discount) OVER ()) / STDDEV_POP(l_discount) OVER (), 6) AS l_discount
FROM lineitem""")
def standardize(spark, sf):
    li = load_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity",
                                                  "l_extendedprice", "l_discount")
    cols = ["l_quantity", "l_extendedprice", "l_discount"]
    return _r(prepare.standardize(li, cols), cols)


@register("train_test_split", f"SELECT event_id, {_SPLIT_SQL.format(key='event_id')} AS split FROM events")
def train_test_split(spark, sf):
    e = load_table(spark, sf, "events")
    return e.select("event_id", prepare.split_flag(F.col("event_id")).alias("split"))


@register("pca_2d")
def pca_2d(spark, sf):
    """Standardise the shopping features and project on 2 components."""
    d = prepare.standardize(shop_data(spark, sf), SHOP_FEATURES)
    return _r(prepare.pca(d, SHOP_FEATURES, 2).select("event_id", "pc1", "pc2"), ["pc1", "pc2"])


# ------------------------------------------------------------------ closed-form models
def _nb_predictions(spark, sf):
    d = shop_data(spark, sf)
    feats = ["session_duration", "user_total_purchases"]
    return models.fit_predict(d.where("split = 'train'"), d.where("split = 'test'"), feats, "purchase",
                              "Naive Bayes", "classification")


_NB_SQL = _SHOP_DATA_SQL + """
, tr AS (SELECT * FROM d WHERE split = 'train'),
eps AS (SELECT 1e-9 * greatest(var_pop(x1), var_pop(x2)) AS e FROM tr),
cs AS (SELECT y AS c, COUNT(*) / (SELECT COUNT(*) FROM tr) AS prior, AVG(x1) AS m1, AVG(x2) AS m2,
              var_pop(x1) + (SELECT e FROM eps) AS v1, var_pop(x2) + (SELECT e FROM eps) AS v2
       FROM tr GROUP BY y),
sc AS (SELECT d.event_id, d.y, cs.c,
              ln(cs.prior) - 0.5 * ln(2 * pi() * v1) - (x1 - m1) * (x1 - m1) / (2 * v1)
              - 0.5 * ln(2 * pi() * v2) - (x2 - m2) * (x2 - m2) / (2 * v2) AS ll
       FROM d, cs WHERE d.split = 'test'),
pr AS (SELECT event_id, y AS purchase, arg_max(c, ll) AS prediction FROM sc GROUP BY event_id, y)
"""


@register("clf_gaussian_nb", _NB_SQL + "SELECT * FROM pr")
def clf_gaussian_nb(spark, sf):
    """Gaussian naive Bayes (variance smoothing 1e-9 x largest variance)."""
    return _nb_predictions(spark, sf).select("event_id", "purchase", "prediction")


@register("metrics_classification", _NB_SQL + """
, conf AS (SELECT purchase AS y, prediction AS p, COUNT(*) AS c FROM pr GROUP BY 1, 2),
per AS (SELECT s.y, s.support, s.tp, COALESCE(q.predicted, 0) AS predicted FROM
          (SELECT y, SUM(c) AS support, SUM(CASE WHEN y = p THEN c ELSE 0 END) AS tp FROM conf GROUP BY y) s
          LEFT JOIN (SELECT p AS y, SUM(c) AS predicted FROM conf GROUP BY p) q ON s.y = q.y),
pm AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS pr,
              CASE WHEN support > 0 THEN tp / support ELSE 0 END AS rc FROM per),
pf AS (SELECT *, CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END AS f FROM pm)
SELECT ROUND(SUM(tp) / SUM(support), 6) AS accuracy, ROUND(SUM(support * pr) / SUM(support), 6) AS precision,
       ROUND(SUM(support * rc) / SUM(support), 6) AS recall, ROUND(SUM(support * f) / SUM(support), 6) AS f1
FROM pf""")
def metrics_classification(spark, sf):
    m = metrics.classification_metrics(_nb_predictions(spark, sf), "purchase", "prediction")
    return _r(m, ["accuracy", "precision", "recall", "f1"])


def _ols(spark, sf, feature):
    d = line_data(spark, sf)
    return models.fit_predict(d.where("split = 'train'"), d.where("split = 'test'"), [feature],
                              "l_extendedprice", "Linear Regression", "regression")


def _ols_sql(x: str) -> str:
    return _LINE_DATA_SQL + f"""
, fit AS (SELECT regr_slope(y, {x}) AS b, regr_intercept(y, {x}) AS a FROM d WHERE split = 'train'),
pr_{x} AS (SELECT l_orderkey, l_linenumber, y, fit.a + fit.b * {x} AS prediction FROM d, fit
           WHERE split = 'test')
"""


_MET_REG = """SELECT ROUND(AVG(abs(prediction - y)), 6) AS mae, ROUND(AVG((prediction - y) * (prediction - y)), 6) AS mse,
       ROUND(1 - SUM((prediction - y) * (prediction - y)) / (var_pop(y) * COUNT(*)), 6) AS r2 FROM {t}"""


@register("reg_linear", _ols_sql("x") + """
SELECT l_orderkey, l_linenumber, ROUND(prediction, 6) AS prediction FROM pr_x""")
def reg_linear(spark, sf):
    """Least squares of ``l_extendedprice`` on ``l_quantity`` (train rows),
    predictions for the test rows."""
    p = _ols(spark, sf, "l_quantity")
    return _r(p.select("l_orderkey", "l_linenumber", "prediction"), ["prediction"])


@register("metrics_regression", _ols_sql("x") + _MET_REG.format(t="pr_x"))
def metrics_regression(spark, sf):
    m = metrics.regression_metrics(_ols(spark, sf, "l_quantity"), "l_extendedprice", "prediction")
    return _r(m, ["mae", "mse", "r2"])


@register("metrics_long", _LINE_DATA_SQL + """
, f1 AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM d WHERE split = 'train'),
f2 AS (SELECT regr_slope(y, x2) AS b, regr_intercept(y, x2) AS a FROM d WHERE split = 'train'),
pr_x AS (SELECT y, f1.a + f1.b * x AS prediction FROM d, f1 WHERE split = 'test'),
pr_x2 AS (SELECT y, f2.a + f2.b * x2 AS prediction FROM d, f2 WHERE split = 'test'),
w AS (SELECT 'Linear Regression (l_quantity)' AS model, * FROM (""" + _MET_REG.format(t="pr_x") + """)
      UNION ALL
      SELECT 'Linear Regression (p_retailprice)' AS model, * FROM (""" + _MET_REG.format(t="pr_x2") + """))
SELECT model, metric, score FROM (UNPIVOT w ON mae, mse, r2 INTO NAME metric VALUE score)""")
def metrics_long(spark, sf):
    """Two models side by side, unpivoted to ``(model, metric, score)``."""
    a = metrics.regression_metrics(_ols(spark, sf, "l_quantity"), "l_extendedprice", "prediction")
    b = metrics.regression_metrics(_ols(spark, sf, "p_retailprice"), "l_extendedprice", "prediction")
    wide = _r(a, ["mae", "mse", "r2"]).select(F.lit("Linear Regression (l_quantity)").alias("model"), "*") \
        .unionByName(_r(b, ["mae", "mse", "r2"]).select(
            F.lit("Linear Regression (p_retailprice)").alias("model"), "*"))
    return metrics.metrics_long(wide)


# ------------------------------------------------------------------ model comparison (no oracle)
def _reference_flow(spark, sf, problem):
    """Standardise (population std) -> PCA(2) -> split, as the comparison does.

    Input and projection are stored once: a fit reads its rows many times."""
    if problem == "classification":
        d, feats, label, key = shop_data(spark, sf), SHOP_FEATURES, "purchase", ["event_id"]
    else:
        d, feats, label, key = line_data(spark, sf), LINE_FEATURES, "l_extendedprice", \
            ["l_orderkey", "l_linenumber"]
    z = prepare.standardize(materialize(d, "model-input"), feats)
    p = materialize(prepare.pca(z, feats, 2), "model-points")
    return p.where("split = 'train'"), p.where("split = 'test'"), ["pc1", "pc2"], label


def _model_metrics(spark, sf, model, problem, params=None):
    tr, te, feats, label = _reference_flow(spark, sf, problem)
    pred = models.fit_predict(tr, te, feats, label, model, problem, params)
    m = (metrics.classification_metrics(pred, label, "prediction") if problem == "classification"
         else metrics.regression_metrics(pred, label, "prediction"))
    return _r(m, m.columns).select(F.lit(model).alias("model"), "*")


_REG_MODELS = {"reg_ridge": ("Ridge", {"alpha": 0.1}), "reg_lasso": ("Lasso", {"alpha": 0.1}),
               "reg_tree": ("Decision Tree Regressor", {"max_depth": 10}),
               "reg_forest": ("Random Forest", {"n_estimators": 100, "max_depth": 10}),
               "reg_adaboost": ("AdaBoost", {"n_estimators": 10}),
               "reg_svr": ("SVM Regressor", {"C": 1.0, "kernel": "rbf"}),
               "reg_linear_pca": ("Linear Regression", {})}
_CLF_MODELS = {"clf_logistic": ("Logistic Regression", {"C": 1.0}),
               "clf_tree": ("Decision Tree Classifier", {"max_depth": 10}),
               "clf_forest": ("Random Forest", {"n_estimators": 100, "max_depth": 10}),
               "clf_svm": ("SVM Classifier", {"C": 1.0, "kernel": "rbf"}),
               "clf_nb_pca": ("Naive Bayes", {})}


def _make(model, params, problem):
    return lambda spark, sf: _model_metrics(spark, sf, model, problem, params)


for _k, (_m, _p) in _REG_MODELS.items():
    register(_k)(_make(_m, _p, "regression"))
for _k, (_m, _p) in _CLF_MODELS.items():
    register(_k)(_make(_m, _p, "classification"))


@register("model_compare")
def model_compare(spark, sf):
    """Two classifiers compared on the same split, long form."""
    a = _model_metrics(spark, sf, "Decision Tree Classifier", "classification", {"max_depth": 5})
    b = _model_metrics(spark, sf, "Logistic Regression", "classification", {"C": 1.0})
    return metrics.metrics_long(a.unionByName(b))
