"""Cleaning, sampling, splitting and preprocessing of the labelled flow table."""

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from wirelark.operators import prep, sampling
from wirelark.plans.catalog import query
from wirelark.sources import flowtable, tables
from wirelark.sources.scratch import cut_lineage, shared_folder

_COLUMNS = ["row_id", "Flow ID", "Src IP", "Dst IP", "Timestamp", "Protocol", "Flow Packets",
            "Flow Bytes", "Down Ratio", "Idle Ratio", "Bwd PSH Flags", "Label"]
_NUMERIC = ["Flow Packets", "Flow Bytes", "Down Ratio", "Idle Ratio"]

FLOW_TABLE_SQL = """ids AS (
  SELECT *, ((l_orderkey * 20000 + l_partkey) * 1000 + l_suppkey) * 8 + l_linenumber AS row_id FROM lineitem),
once AS (
  SELECT row_id, l_orderkey || '-' || l_linenumber AS "Flow ID", '10.0.0.' || (l_suppkey % 250) AS "Src IP",
    '10.1.0.' || (l_partkey % 250) AS "Dst IP", strftime(l_shipdate, '%Y-%m-%d') AS "Timestamp",
    CASE l_linenumber % 3 WHEN 0 THEN 'TCP' WHEN 1 THEN '17' ELSE '6.0' END AS "Protocol",
    CASE WHEN row_id % 97 = 0 THEN 'NaN'::DOUBLE ELSE l_quantity END AS "Flow Packets",
    CASE WHEN row_id % 101 = 0 THEN 'Infinity'::DOUBLE ELSE l_extendedprice END AS "Flow Bytes",
    l_discount AS "Down Ratio", l_tax AS "Idle Ratio", 0.0::DOUBLE AS "Bwd PSH Flags",
    CASE WHEN l_orderkey = 10 THEN 'Worms' WHEN l_orderkey = 5 THEN 'Shellcode'
         WHEN l_returnflag = 'N' THEN ' BENIGN ' WHEN l_returnflag = 'A' THEN 'DoS'
         ELSE 'Reconnaissance' END AS "Label" FROM ids),
flow_table AS (SELECT * FROM once UNION ALL SELECT * REPLACE (row_id + 1152921504606846976 AS row_id) FROM once WHERE row_id % 53 = 0),
f32 AS (SELECT * REPLACE ("Flow Packets"::FLOAT AS "Flow Packets", "Flow Bytes"::FLOAT AS "Flow Bytes",
  "Down Ratio"::FLOAT AS "Down Ratio", "Idle Ratio"::FLOAT AS "Idle Ratio",
  "Bwd PSH Flags"::FLOAT AS "Bwd PSH Flags") FROM flow_table),
blanked AS (SELECT * REPLACE (CASE WHEN isfinite("Flow Packets") THEN "Flow Packets" END AS "Flow Packets",
  CASE WHEN isfinite("Flow Bytes") THEN "Flow Bytes" END AS "Flow Bytes") FROM f32),
complete AS (SELECT * FROM blanked WHERE "Flow Packets" IS NOT NULL AND "Flow Bytes" IS NOT NULL),
cleaned AS (SELECT min(row_id) AS row_id, * EXCLUDE (row_id) FROM complete GROUP BY ALL),
kept AS (SELECT * FROM cleaned WHERE "Label" IN (SELECT "Label" FROM cleaned GROUP BY 1 HAVING count(*) >= 5)),
targeted AS (SELECT *, CASE WHEN upper(trim("Label")) = 'BENIGN' THEN 0 ELSE 1 END AS target FROM kept),
hashed AS (SELECT *, (row_id % 2147483647 * 2654435761 + 42 * 40503) % 4294967296 AS h FROM targeted)"""
_WITH = "WITH " + FLOW_TABLE_SQL


def cleaned(spark, sf_dir):
    return flowtable.clean(tables.flow_table(spark, sf_dir), keep=("row_id",))


def kept_rows(spark, sf_dir):
    """The cleaned table, stored because what follows reads it several times."""
    return flowtable.drop_rare_classes(cut_lineage(cleaned(spark, sf_dir), "cleaned"))


def targeted(spark, sf_dir, mode="binary"):
    return flowtable.with_target(kept_rows(spark, sf_dir), mode)


def _quoted(names):
    return ", ".join(f'"{n}"' for n in names)


@query("load_flows", _WITH + f" SELECT {_quoted(_COLUMNS)} FROM f32")
def load_flows(spark, sf_dir):
    """Through a CSV file with padded column names."""
    path = shared_folder(spark, "flows") + "/flows.csv"
    padded = tables.flow_table(spark, sf_dir)
    padded = padded.toDF(*[f" {c} " for c in padded.columns])
    padded.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False).csv(path)
    return flowtable.to_float32(flowtable.read(spark, path, padded.schema), keep=("row_id",)).select(
        *[F.col(f"`{c}`") for c in _COLUMNS])


@query("float32_cast", _WITH + f" SELECT row_id, {_quoted(_NUMERIC)} FROM f32")
def float32_cast(spark, sf_dir):
    return flowtable.to_float32(tables.flow_table(spark, sf_dir), keep=("row_id",)).select(
        "row_id", *[F.col(f"`{c}`") for c in _NUMERIC])


@query("drop_irrelevant", _WITH + """ SELECT row_id, "Protocol", "Flow Packets", "Flow Bytes", "Down Ratio",
  "Idle Ratio", "Label" FROM flow_table""")
def drop_irrelevant(spark, sf_dir):
    return flowtable.drop_irrelevant(tables.flow_table(spark, sf_dir))


@query("clean_rows", _WITH + f" SELECT {_quoted(_COLUMNS)} FROM complete")
def clean_rows(spark, sf_dir):
    return flowtable.drop_incomplete(flowtable.to_float32(tables.flow_table(spark, sf_dir), keep=("row_id",)))


@query("dedupe_rows", _WITH + f" SELECT {_quoted(_COLUMNS)} FROM cleaned")
def dedupe_rows(spark, sf_dir):
    return cleaned(spark, sf_dir)


@query("class_counts", _WITH + ' SELECT "Label", count(*) AS n FROM cleaned GROUP BY 1')
def class_counts(spark, sf_dir):
    return flowtable.class_counts(cleaned(spark, sf_dir))


@query("rare_class_filter", _WITH + ' SELECT row_id, "Label" FROM kept')
def rare_class_filter(spark, sf_dir):
    return kept_rows(spark, sf_dir).select("row_id", "Label")


@query("binary_target", _WITH + " SELECT row_id, target FROM targeted")
def binary_target(spark, sf_dir):
    return targeted(spark, sf_dir).select("row_id", "target")


@query("multiclass_target", _WITH + ' SELECT row_id, trim("Label") AS target FROM kept')
def multiclass_target(spark, sf_dir):
    return targeted(spark, sf_dir, "multiclass").select("row_id", "target")


@query("class_weights", _WITH + ', c AS (SELECT "Label", count(*) AS n FROM kept GROUP BY 1)'
       ' SELECT row_id, "Label", (SELECT sum(n) FROM c)::DOUBLE / ((SELECT count(*) FROM c) * n) AS weight '
       'FROM kept JOIN c USING ("Label")')
def class_weights(spark, sf_dir):
    kept = kept_rows(spark, sf_dir)
    return flowtable.with_class_weights(kept, "Label").select("row_id", "Label", "weight")


@query("stratified_sample", _WITH + """, r AS (SELECT *, row_number() OVER (PARTITION BY "Label" ORDER BY h, row_id) AS rk,
    count(*) OVER (PARTITION BY "Label") AS n FROM hashed)
  SELECT row_id, "Label" FROM r WHERE rk <= round_even(0.1::DOUBLE * n, 0)""")
def stratified_sample(spark, sf_dir):
    kept = kept_rows(spark, sf_dir)
    return sampling.stratified_sample(kept, 0.1).select("row_id", "Label")


@query("simple_sample", _WITH + """, r AS (SELECT *, row_number() OVER (ORDER BY h, row_id) AS rk, count(*) OVER () AS n FROM hashed)
  SELECT row_id FROM r WHERE rk <= round_even(0.1::DOUBLE * n, 0)""")
def simple_sample(spark, sf_dir):
    return sampling.simple_sample(targeted(spark, sf_dir), 0.1).select("row_id")


@query("train_test_split", "WITH " + FLOW_TABLE_SQL + """,
  m AS (SELECT *, trim("Label") AS cls FROM hashed),
  c AS (SELECT cls, count(*) AS n FROM m GROUP BY 1),
  t AS (SELECT *, (SELECT sum(n) FROM c)::BIGINT AS total, ceil(0.2 * (SELECT sum(n) FROM c))::BIGINT AS tests FROM c),
  q AS (SELECT *, tests * n // total AS base, row_number() OVER (ORDER BY tests * n % total DESC, cls) AS place FROM t),
  a AS (SELECT cls, base + CASE WHEN place <= tests - (SELECT sum(base) FROM q) THEN 1 ELSE 0 END AS quota FROM q),
  r AS (SELECT row_id, cls, row_number() OVER (PARTITION BY cls ORDER BY h, row_id) AS rk FROM m)
  SELECT row_id, cls AS target, rk <= quota AS is_test FROM r JOIN a USING (cls)""")
def train_test_split(spark, sf_dir):
    return sampling.train_test_marks(targeted(spark, sf_dir, "multiclass")).select("row_id", "target", "is_test")


@query("stratified_kfold", _WITH + """ SELECT row_id, target,
  ((row_number() OVER (PARTITION BY target ORDER BY h, row_id) - 1) % 5)::INTEGER AS fold,
  ((row_number() OVER (PARTITION BY target ORDER BY row_id) - 1) % 3)::INTEGER AS fold3 FROM hashed""")
def stratified_kfold(spark, sf_dir):
    five = sampling.stratified_folds(targeted(spark, sf_dir), 5)
    return sampling.stratified_folds(five, 3, shuffled=False, name="fold3").select(
        "row_id", "target", "fold", "fold3")


@query("learning_curve_subsets", _WITH + """, r AS (SELECT row_id, row_number() OVER (ORDER BY row_id) AS rk,
    count(*) OVER () AS n FROM hashed)
  SELECT f AS fraction, count(*) AS n, sum(row_id % 1000003)::BIGINT AS check_sum
  FROM r, (SELECT unnest([0.2, 0.4, 0.6, 0.8, 1.0])::DOUBLE AS f) WHERE rk <= floor(f * n) GROUP BY f""")
def learning_curve_subsets(spark, sf_dir):
    fractions = [0.2, 0.4, 0.6, 0.8, 1.0]
    steps = sampling.growing_subsets(targeted(spark, sf_dir), fractions).groupBy("first_step").agg(
        F.count("*").alias("n"), F.sum(F.col("row_id") % 1000003).alias("s"))
    prefixes = F.explode(F.sequence(F.col("first_step"), F.lit(len(fractions) - 1)))
    return (steps.withColumn("step", prefixes).groupBy("step")
            .agg(F.sum("n").alias("n"), F.sum("s").alias("check_sum"))
            .select(F.get(F.array(*map(F.lit, fractions)), F.col("step")).alias("fraction"), "n", "check_sum"))


def _blanked(spark, sf_dir):
    raw = flowtable.drop_repeats(flowtable.to_float32(tables.flow_table(spark, sf_dir), keep=("row_id",)), ("row_id",))
    return flowtable.blank_non_finite(raw)


_BLANK = _WITH + ", b AS (SELECT min(row_id) AS row_id, * EXCLUDE (row_id) FROM blanked GROUP BY ALL), m AS (SELECT " + ", ".join(
    f'quantile_cont("{c}"::DOUBLE, 0.5) AS m{i}, quantile_cont("{c}"::DOUBLE, 0.25) AS l{i}, '
    f'quantile_cont("{c}"::DOUBLE, 0.75) AS u{i}' for i, c in enumerate(_NUMERIC)) + " FROM b), filled AS (SELECT row_id, "\
    + '"Protocol", "Label", ' + ", ".join(f'coalesce("{c}"::DOUBLE, m{i}) AS x{i}' for i, c in enumerate(_NUMERIC)) + " FROM b, m)"


@query("impute_median", _BLANK + " SELECT row_id, x0, x1, x2, x3 FROM filled")
def impute_median(spark, sf_dir):
    b = cut_lineage(_blanked(spark, sf_dir), "blanked")
    median = {c: q[0] for c, q in prep.exact_quantiles(b, _NUMERIC, [0.5]).items()}
    return b.select("row_id", *[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(median[c])).alias(f"x{i}")
                                for i, c in enumerate(_NUMERIC)])


@query("impute_missing", """SELECT event_id, CASE WHEN event_type = 'click' THEN 'missing' ELSE event_type END AS kind FROM events""")
def impute_missing(spark, sf_dir):
    gaps = tables.table(spark, sf_dir, "events").select("event_id", F.when(
        F.col("event_type") != "click", F.col("event_type")).alias("kind"))
    return gaps.na.fill({"kind": prep.MISSING})


@query("variance_threshold", _WITH + """ SELECT name FROM (SELECT unnest(['Flow Packets', 'Flow Bytes',
  'Down Ratio', 'Idle Ratio', 'Bwd PSH Flags']) AS name, unnest([var_pop("Flow Packets"), var_pop("Flow Bytes"),
  var_pop("Down Ratio"), var_pop("Idle Ratio"), var_pop("Bwd PSH Flags")]) AS v FROM kept) WHERE v > 0""")
def variance_threshold(spark, sf_dir):
    kept = kept_rows(spark, sf_dir)
    names = prep.varying_columns(kept, _NUMERIC + ["Bwd PSH Flags"])
    return spark.createDataFrame([(n,) for n in names], "name string")


@query("log1p_clip", _WITH + """ SELECT row_id, round(ln(1 + greatest("Flow Bytes"::DOUBLE - 30000, 0.0)), 6) AS v FROM kept""")
def log1p_clip(spark, sf_dir):
    kept = kept_rows(spark, sf_dir)
    return kept.select("row_id", F.round(prep.log1p_clip(F.col("`Flow Bytes`").cast("double") - 30000), 6).alias("v"))


@query("standard_scale", _WITH + """, m AS (SELECT avg("Flow Bytes"::DOUBLE) AS a, stddev_pop("Flow Bytes"::DOUBLE) AS s FROM kept)
  SELECT row_id, round(("Flow Bytes"::DOUBLE - a) / s, 6) AS v FROM kept, m""")
def standard_scale(spark, sf_dir):
    kept = kept_rows(spark, sf_dir)
    mean, dev = prep.mean_and_deviation(kept, {"x": "CAST(`Flow Bytes` AS DOUBLE)"})["x"]
    return kept.select("row_id", F.round((F.col("`Flow Bytes`").cast("double") - mean) / dev, 6).alias("v"))


@query("robust_scale", _WITH + """, m AS (SELECT quantile_cont("Flow Bytes"::DOUBLE, 0.5) AS a,
    quantile_cont("Flow Bytes"::DOUBLE, 0.75) - quantile_cont("Flow Bytes"::DOUBLE, 0.25) AS s FROM kept)
  SELECT row_id, round(("Flow Bytes"::DOUBLE - a) / s, 6) AS v FROM kept, m""")
def robust_scale(spark, sf_dir):
    kept = kept_rows(spark, sf_dir)
    low, mid, high = prep.exact_quantiles(kept, ["Flow Bytes"], [0.25, 0.5, 0.75])["Flow Bytes"]
    return kept.select("row_id", F.round((F.col("`Flow Bytes`").cast("double") - mid) / (high - low), 6).alias("v"))


def _vector_columns(df, n):
    values = vector_to_array("features")
    return df.select("row_id", *[F.round(F.get(values, F.lit(i)), 6).alias(f"f{i}") for i in range(n)])


@query("one_hot", _WITH + """ SELECT row_id, ("Protocol" = '17')::INTEGER::DOUBLE AS f0,
  ("Protocol" = '6.0')::INTEGER::DOUBLE AS f1 FROM kept""")
def one_hot(spark, sf_dir):
    """Fitted without 'TCP', which is therefore unseen and encodes to zeros."""
    kept = kept_rows(spark, sf_dir)
    model = prep.fit_preprocessor(kept.where("Protocol <> 'TCP'"), [], ["Protocol"])
    return _vector_columns(prep.transform(model, kept.select("row_id", "Protocol")), 2)


def _preprocess(spark, sf_dir, scale):
    rows = flowtable.with_protocol(_blanked(spark, sf_dir)).select(
        "row_id", "Protocol", *[F.col(f"`{c}`") for c in [*_NUMERIC, "Bwd PSH Flags"]])
    rows = cut_lineage(rows, "rows")
    model = prep.fit_preprocessor(rows, [*_NUMERIC, "Bwd PSH Flags"], ["Protocol"], scale)
    return _vector_columns(prep.transform(model, rows), 6)


def _preprocess_sql(expression, fit):
    fits = ", ".join(f"{a.format(x=expression.format(x=f'x{i}'))} AS a{i}, {s.format(x=expression.format(x=f'x{i}'))} AS s{i}"
                     for i in range(4) for a, s in [fit])
    cols = ", ".join(f"round(({expression.format(x=f'x{i}')} - a{i}) / s{i}, 6) AS f{i}" for i in range(4))
    return (_BLANK + f", p AS (SELECT {fits} FROM filled) SELECT row_id, {cols}, "
            "(\"Protocol\" = '17')::INTEGER::DOUBLE AS f4, (\"Protocol\" <> '17')::INTEGER::DOUBLE AS f5 FROM filled, p")


_MOMENTS = ("avg({x})", "stddev_pop({x})")
_QUARTILES = ("quantile_cont({x}, 0.5)", "(quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25))")


@query("preprocess_log_standard", _preprocess_sql("ln(1 + greatest({x}, 0.0))", _MOMENTS))
def preprocess_log_standard(spark, sf_dir):
    return _preprocess(spark, sf_dir, "log_standard")


@query("preprocess_robust", _preprocess_sql("{x}", _QUARTILES))
def preprocess_robust(spark, sf_dir):
    return _preprocess(spark, sf_dir, "robust")


@query("preprocess_standard", _preprocess_sql("{x}", _MOMENTS))
def preprocess_standard(spark, sf_dir):
    return _preprocess(spark, sf_dir, "standard")


_ANOVA = _WITH + ", u AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {i} AS place, \"Label\" AS g, \"{c}\"::DOUBLE AS x FROM kept"
    for i, c in enumerate(_NUMERIC)) + """),
  g AS (SELECT feature, place, g, count(*) AS n, avg(x) AS m, sum(x) AS s FROM u GROUP BY ALL),
  a AS (SELECT feature, sum(s) / sum(n) AS gm FROM g GROUP BY 1),
  b AS (SELECT feature, place, count(*) AS k, sum(n) AS n, sum(n * (m - gm) * (m - gm)) AS ssb FROM g JOIN a USING (feature) GROUP BY ALL),
  w AS (SELECT u.feature, sum((x - m) * (x - m)) AS ssw FROM u JOIN g USING (feature, g) GROUP BY 1),
  f AS (SELECT feature, place, round((ssb / (k - 1)) / (ssw / (n - k)), 5) AS f_value FROM b JOIN w USING (feature))"""


@query("anova_f", _ANOVA + " SELECT feature, f_value FROM f")
def anova_f(spark, sf_dir):
    kept = kept_rows(spark, sf_dir)
    return prep.anova_f(kept, _NUMERIC, "Label").select("feature", F.round("f_value", 5).alias("f_value"))


@query("anova_topk", _ANOVA + " SELECT feature, f_value FROM f ORDER BY f_value DESC, place DESC LIMIT 2")
def anova_topk(spark, sf_dir):
    kept = kept_rows(spark, sf_dir)
    return prep.top_features(prep.anova_f(kept, _NUMERIC, "Label"), 2).select(
        "feature", F.round("f_value", 5).alias("f_value"))
