"""Metrics, confusion, ROC and weight tables."""

from pyspark.sql import functions as F

from wirelark.operators import evaluate as ev
from wirelark.plans.catalog import query
from wirelark.sources import tables

BINARY_SQL = """base AS (
  SELECT ((l_orderkey * 20000 + l_partkey) * 1000 + l_suppkey) * 8 + l_linenumber AS row_id,
    CASE WHEN l_returnflag <> 'N' THEN 1 ELSE 0 END AS y_true, round(l_discount * 100)::INTEGER AS d,
    round(l_tax * 100)::INTEGER AS x, l_linestatus FROM lineitem),
pred AS (SELECT row_id, y_true, l_linestatus, model, score, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS y_pred FROM (
    SELECT *, 'A' AS model, d / 10.0::DOUBLE AS score FROM base
    UNION ALL SELECT *, 'B', (10 - d) / 10.0::DOUBLE FROM base
    UNION ALL SELECT *, 'C', x / 10.0::DOUBLE FROM base))"""

MULTI_SQL = """mbase AS (SELECT l_returnflag AS y_true, l_linenumber AS ln, round(l_discount * 100)::INTEGER AS d,
    round(l_tax * 100)::INTEGER AS x FROM lineitem),
mpred AS (SELECT 'A' AS model, y_true, CASE ln % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS y_pred,
    (d + 1)::DOUBLE / (d + x + 2 + ln) AS pa, (x + 1)::DOUBLE / (d + x + 2 + ln) AS pn,
    ln::DOUBLE / (d + x + 2 + ln) AS pr FROM mbase)"""


def _class_sql(pred, name="cls"):
    return f""", {name}_l AS (SELECT DISTINCT model, y_true AS label FROM {pred} UNION SELECT DISTINCT model, y_pred FROM {pred}),
  {name} AS (SELECT l.model, l.label,
    count(*) FILTER (p.y_true = l.label) AS support, count(*) FILTER (p.y_pred = l.label) AS called,
    count(*) FILTER (p.y_true = l.label AND p.y_pred = l.label) AS hits
    FROM {name}_l l JOIN {pred} p ON p.model = l.model GROUP BY 1, 2),
  {name}_m AS (SELECT *, CASE WHEN called = 0 THEN 0.0 ELSE hits::DOUBLE / called END AS precision,
    CASE WHEN support = 0 THEN 0.0 ELSE hits::DOUBLE / support END AS recall,
    CASE WHEN called + support = 0 THEN 0.0 ELSE (2 * hits)::DOUBLE / (called + support) END AS f1 FROM {name}),
  {name}_a AS (SELECT model, count(*) FILTER (y_true = y_pred)::DOUBLE / count(*) AS accuracy, count(*) AS n
    FROM {pred} GROUP BY 1)"""


@query("metrics_binary", "WITH " + BINARY_SQL + _class_sql("pred") + """
  SELECT model, accuracy, precision, recall, f1 FROM cls_m JOIN cls_a USING (model) WHERE label = 1""")
def metrics_binary(spark, sf_dir):
    return ev.metrics(tables.binary_predictions(spark, sf_dir))


@query("metrics_macro", "WITH " + MULTI_SQL + _class_sql("mpred") + """
  SELECT model, any_value(accuracy) AS accuracy, round(avg(precision), 12) AS precision,
    round(avg(recall), 12) AS recall, round(avg(f1), 12) AS f1 FROM cls_m JOIN cls_a USING (model) GROUP BY 1""")
def metrics_macro(spark, sf_dir):
    m = ev.metrics(tables.multiclass_predictions(spark, sf_dir))
    return m.select("model", "accuracy", *[F.round(c, 12).alias(c) for c in ev.METRICS[1:]])


@query("classification_report", "WITH " + MULTI_SQL + _class_sql("mpred") + """, r AS (
  SELECT model, label, precision, recall, f1, support FROM cls_m
  UNION ALL SELECT model, 'accuracy', NULL, NULL, accuracy, n FROM cls_a
  UNION ALL SELECT model, 'macro avg', avg(precision), avg(recall), avg(f1), sum(support)::BIGINT FROM cls_m GROUP BY 1
  UNION ALL SELECT model, 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
    sum(f1 * support) / sum(support), sum(support)::BIGINT FROM cls_m GROUP BY 1)
  SELECT model, label, round(precision, 10) AS precision, round(recall, 10) AS recall, round(f1, 10) AS f1, support FROM r""")
def classification_report(spark, sf_dir):
    r = ev.classification_report(tables.multiclass_predictions(spark, sf_dir))
    return r.select("model", "label", *[F.round(c, 10).alias(c) for c in ev.METRICS[1:]], "support")


@query("confusion_matrix", "WITH " + BINARY_SQL + """, c AS (SELECT DISTINCT model, y_true AS label FROM pred
    UNION SELECT DISTINCT model, y_pred FROM pred),
  cells AS (SELECT a.model, a.label AS y_true, b.label AS y_pred FROM c a JOIN c b ON a.model = b.model),
  n AS (SELECT model, y_true, y_pred, count(*) AS n FROM pred GROUP BY ALL),
  f AS (SELECT model, y_true, y_pred, coalesce(n, 0) AS n FROM cells LEFT JOIN n USING (model, y_true, y_pred))
  SELECT model, y_true, y_pred, n, n::DOUBLE / sum(n) OVER (PARTITION BY model, y_true) AS share,
    CASE y_true WHEN 0 THEN 'Benigno' ELSE 'Maligno' END AS true_name,
    CASE y_pred WHEN 0 THEN 'Benigno' ELSE 'Maligno' END AS pred_name FROM f""")
def confusion_matrix(spark, sf_dir):
    return ev.confusion_matrix(tables.binary_predictions(spark, sf_dir))


def _scored(spark, sf_dir):
    return tables.binary_predictions(spark, sf_dir).select("model", F.col("y_true").alias("y"), "score")


_ROC = "WITH " + BINARY_SQL + """,
  g AS (SELECT model, score, sum(y_true) AS pos, sum(1 - y_true) AS neg FROM pred GROUP BY ALL),
  r AS (SELECT model, score AS threshold,
    (sum(neg) OVER w)::DOUBLE / (sum(neg) OVER t) AS fpr, (sum(pos) OVER w)::DOUBLE / (sum(pos) OVER t) AS tpr
    FROM g WINDOW w AS (PARTITION BY model ORDER BY score DESC), t AS (PARTITION BY model)
    UNION ALL SELECT DISTINCT model, 'Infinity'::DOUBLE, 0.0, 0.0 FROM g)"""


@query("roc_curve", _ROC + " SELECT model, threshold, fpr, tpr FROM r")
def roc_curve(spark, sf_dir):
    return ev.roc_curve(_scored(spark, sf_dir))


@query("roc_auc", _ROC + """, s AS (SELECT model, (fpr - lag(fpr) OVER w) * (tpr + lag(tpr) OVER w) / 2 AS a
    FROM r WINDOW w AS (PARTITION BY model ORDER BY threshold DESC))
  SELECT model, round(sum(a), 10) AS auc FROM s GROUP BY 1""")
def roc_auc(spark, sf_dir):
    return ev.roc_auc(_scored(spark, sf_dir)).select("model", F.round("auc", 10).alias("auc"))


_MACRO = "WITH " + MULTI_SQL + """,
  o AS (SELECT y_true, unnest(['A', 'N', 'R']) AS class, unnest([pa, pn, pr]) AS score FROM mpred),
  g AS (SELECT class, score, count(*) FILTER (y_true = class) AS pos, count(*) FILTER (y_true <> class) AS neg FROM o GROUP BY ALL),
  c AS (SELECT class, (sum(neg) OVER w)::DOUBLE / (sum(neg) OVER t) AS fpr, (sum(pos) OVER w)::DOUBLE / (sum(pos) OVER t) AS tpr
    FROM g WINDOW w AS (PARTITION BY class ORDER BY score DESC), t AS (PARTITION BY class)
    UNION ALL SELECT DISTINCT class, 0.0, 0.0 FROM g),
  k AS (SELECT class, fpr, min(tpr) AS low, max(tpr) AS high FROM c GROUP BY ALL),
  k2 AS (SELECT *, lead(fpr) OVER w AS nx, lead(low) OVER w AS ny FROM k WINDOW w AS (PARTITION BY class ORDER BY fpr)),
  grid AS (SELECT class, x FROM (SELECT DISTINCT fpr AS x FROM k), (SELECT DISTINCT class FROM k)),
  v AS (SELECT g.class, g.x, CASE WHEN g.x = k2.fpr OR nx IS NULL THEN high
      ELSE high + (ny - high) * (g.x - k2.fpr) / (nx - k2.fpr) END AS y
    FROM grid g ASOF JOIN k2 ON g.class = k2.class AND g.x >= k2.fpr),
  m AS (SELECT x, avg(y) AS y FROM v GROUP BY 1)"""


@query("roc_macro", _MACRO + " SELECT 'A' AS model, round(x, 9) AS fpr, round(y, 9) AS tpr FROM m")
def roc_macro(spark, sf_dir):
    curve = ev.roc_macro(tables.multiclass_predictions(spark, sf_dir))
    return curve.select("model", F.round("fpr", 9).alias("fpr"), F.round("tpr", 9).alias("tpr"))


@query("roc_macro_auc", _MACRO + """, s AS (SELECT (x - lag(x) OVER (ORDER BY x)) * (y + lag(y) OVER (ORDER BY x)) / 2 AS a FROM m)
  SELECT 'A' AS model, round(sum(a), 9) AS auc FROM s""")
def roc_macro_auc(spark, sf_dir):
    area = ev.curve_area(ev.roc_macro(tables.multiclass_predictions(spark, sf_dir)))
    return area.select("model", F.round("auc", 9).alias("auc"))


@query("metrics_comparison", "WITH " + BINARY_SQL + _class_sql("pred") + """,
  w AS (SELECT model, accuracy, precision, recall, f1 FROM cls_m JOIN cls_a USING (model) WHERE label = 1),
  l AS (UNPIVOT w ON accuracy, precision, recall, f1 INTO NAME metric VALUE value)
  SELECT metric, max(value * 100) FILTER (model = 'A') AS "A", max(value * 100) FILTER (model = 'B') AS "B",
    max(value * 100) FILTER (model = 'C') AS "C" FROM l GROUP BY 1""")
def metrics_comparison(spark, sf_dir):
    return ev.comparison(ev.metrics(tables.binary_predictions(spark, sf_dir)), ["A", "B", "C"])


@query("overfit_gap", "WITH " + BINARY_SQL
       + ", tr AS (SELECT * FROM pred WHERE l_linestatus = 'F'), te AS (SELECT * FROM pred WHERE l_linestatus = 'O')"
       + _class_sql("tr", "a") + _class_sql("te", "b") + """,
  ta AS (SELECT model, accuracy, precision, recall, f1 FROM a_m JOIN a_a USING (model) WHERE label = 1),
  tb AS (SELECT model, accuracy, precision, recall, f1 FROM b_m JOIN b_a USING (model) WHERE label = 1),
  la AS (UNPIVOT ta ON accuracy, precision, recall, f1 INTO NAME metric VALUE train),
  lb AS (UNPIVOT tb ON accuracy, precision, recall, f1 INTO NAME metric VALUE test)
  SELECT model, metric, train, test, train - test AS gap, CASE WHEN ta.f1 - tb.f1 > 0.10 THEN 'severe'
    WHEN ta.f1 - tb.f1 > 0.05 THEN 'moderate' ELSE 'good' END AS verdict
  FROM la JOIN lb USING (model, metric) JOIN ta USING (model) JOIN tb USING (model)""")
def overfit_gap(spark, sf_dir):
    rows = tables.binary_predictions(spark, sf_dir)
    return ev.overfit_gap(ev.metrics(rows.where("l_linestatus = 'F'")), ev.metrics(rows.where("l_linestatus = 'O'")))


def _weights(spark, sf_dir, *keys):
    return (tables.table(spark, sf_dir, "lineitem")
            .groupBy(F.concat(F.lit("supp_"), F.col("l_suppkey") % 100).alias("feature"), *keys)
            .agg(((F.sum(F.round(F.col("l_discount") * 100).cast("int")) - 5 * F.count("*"))
                  / F.count("*")).alias("coefficient")))


_WEIGHT = "(sum(round(l_discount * 100)::INTEGER) - 5 * count(*))::DOUBLE / count(*) AS coefficient"


@query("svm_top_weights", f"""WITH w AS (SELECT 'supp_' || (l_suppkey % 100) AS feature, {_WEIGHT} FROM lineitem GROUP BY 1)
  SELECT feature, coefficient, CASE WHEN coefficient > 0 THEN 'Ataque' ELSE 'Benigna' END AS tendency
  FROM w ORDER BY abs(coefficient) DESC, feature LIMIT 25""")
def svm_top_weights(spark, sf_dir):
    return ev.top_weights(_weights(spark, sf_dir))


@query("svm_top_weights_mc", f"""WITH w AS (SELECT 'supp_' || (l_suppkey % 100) AS feature, l_returnflag AS class, {_WEIGHT}
    FROM lineitem GROUP BY 1, 2),
  t AS (SELECT feature, max(abs(coefficient)) AS peak FROM w GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25)
  SELECT feature, peak, max(coefficient) FILTER (class = 'A') AS "A", max(coefficient) FILTER (class = 'N') AS "N",
    max(coefficient) FILTER (class = 'R') AS "R" FROM w JOIN t USING (feature) GROUP BY 1, 2""")
def svm_top_weights_mc(spark, sf_dir):
    weights = _weights(spark, sf_dir, F.col("l_returnflag").alias("class"))
    return ev.top_weights_by_class(weights, ["A", "N", "R"])
