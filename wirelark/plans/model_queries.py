"""Training, stacking and model diagnostics on the labelled flow table.

The learners run with the library's defaults. FIT_ROWS bounds the labelled rows of one fit, with
every class in it; all rows are scored. `latency_f1`, `tree_complexity` and
`detect_multiclass` fit all rows. The labels follow from the flows' own features, apart from a few rows, so that there is something to
learn. Figures of a fit cannot be stated in SQL: they are the results of the queries that end in
`_figures`, and the SQL of the others states what must hold of them: which rows were scored, that
probabilities are sound, and that all classes are told apart.
"""

import math

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, Window, functions as F

from wirelark.operators import decide, detect, evaluate as ev, learners, prep
from wirelark.operators import flows as fl
from wirelark.operators.sampling import stratified_folds
from wirelark.operators.training import unique_classes
from wirelark.plans.catalog import query
from wirelark.plans import packet_sql
from wirelark.plans.flow_queries import MARKS, MARKS_SQL, clean_packets
from wirelark.plans.training_queries import _ANOVA, _NUMERIC, _WITH, FLOW_TABLE_SQL, targeted
from wirelark.sources import flowtable
from wirelark.sources.scratch import cut_lineage, shared_folder

FIT_ROWS = 2_000
SETTINGS = learners.Settings(fit_rows=FIT_ROWS)
LEARNED = 0.7                    # balanced accuracy at least, over all rows

# a flow's behaviour, with one row in 37 mislabelled
_KIND = """CASE WHEN row_id % 37 = 0 THEN 'DoS' WHEN "Flow Packets" > 40 THEN 'DoS'
  WHEN "Flow Packets" > 25 AND "Down Ratio" > 0.055 THEN 'Reconnaissance' ELSE 'Benign' END"""
_BEHAVED = _WITH + f""", behaved AS (SELECT * REPLACE ((kind <> 'Benign')::INTEGER AS target) FROM (SELECT *, {_KIND} AS kind FROM hashed))"""


def behaviour() -> Column:
    packets = F.col("Flow Packets")
    return (F.when(F.col("row_id") % 37 == 0, F.lit("DoS")).when(packets > 40, F.lit("DoS"))
            .when((packets > 25) & (F.col("Down Ratio") > F.lit(0.055)), F.lit("Reconnaissance")).otherwise(F.lit("Benign")))


def training_rows(spark, sf_dir, mode="binary", scale="log_standard"):
    """(preprocessed rows with `label` and `features`, number of classes)."""
    rows = flowtable.with_protocol(flowtable.drop_irrelevant(targeted(spark, sf_dir, mode)))
    rows = cut_lineage(rows.withColumn("target", behaviour() if mode == "multiclass" else (behaviour() != "Benign").cast("int")), "rows")
    classes = unique_classes(rows)
    rows = rows.withColumn("label", (F.array_position(F.array(*map(F.lit, classes)), F.col("target")) - 1).cast("double"))
    numeric, categorical = flowtable.feature_columns(rows, leave=("target", "row_id", "label"))
    model = prep.fit_preprocessor(rows, numeric, categorical, scale)
    return cut_lineage(prep.transform(model, rows).select("row_id", "target", "label", "features"), "features"), len(classes)


def _judged(scored, name, sound):
    """Per target its rows, whether they are sound, and whether the classes were told apart."""
    each = scored.groupBy("target").agg(F.count("*").alias("n"), F.min(sound).alias("sound"),
                                        F.avg((F.col("label") == F.col(f"{name}_prediction")).cast("double")).alias("recall"))
    every = Window.partitionBy()
    return each.select("target", "n", "sound", (F.avg("recall").over(every) >= LEARNED).alias("learned"))


def _sound(rows, model, name, classes):
    p = vector_to_array(f"{name}_probability")
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    return _judged(model.transform(rows), name, (F.size(p) == classes) & (F.abs(total - 1) < 1e-6))


_SOUND = _BEHAVED + " SELECT target, count(*) AS n, true AS sound, true AS learned FROM behaved GROUP BY 1"
_SOUND_MC = _BEHAVED + " SELECT kind AS target, count(*) AS n, true AS sound, true AS learned FROM behaved GROUP BY 1"


def _train_query(name, mode="binary"):
    def run(spark, sf_dir):
        rows, classes = training_rows(spark, sf_dir, mode)
        return _sound(rows, learners.fit_learner(name, rows, classes, SETTINGS), name, classes)
    return run


for _key, _learner in (("train_rf", "rf"), ("train_et", "et"), ("train_dt", "dt"), ("train_mlp", "mlp"),
                       ("train_hgb", "hgb"), ("train_svc_calibrated", "linearsvcCalibrated")):
    query(_key, _SOUND)(_train_query(_learner))
query("train_hgb_multiclass", _SOUND_MC)(_train_query("hgb", "multiclass"))
query("train_svc_calibrated_multiclass", _SOUND_MC)(_train_query("linearsvcCalibrated", "multiclass"))


@query("train_linearsvc", _SOUND)
def train_linearsvc(spark, sf_dir):
    rows, _ = training_rows(spark, sf_dir)
    model = learners.fit_learner("linearsvc", rows, 2, SETTINGS)
    margin = F.get(vector_to_array("linearsvc_raw"), F.lit(1))
    return _judged(model.transform(rows), "linearsvc", (margin > 0) == (F.col("linearsvc_prediction") == 1))


@query("train_stacking", _SOUND)
def train_stacking(spark, sf_dir):
    """The edge profile: calibrated SVM, boosting and forest under a logistic regression."""
    rows, _ = training_rows(spark, sf_dir)
    return _sound(rows, learners.fit_stacking(rows, 2, profile="edge", passthrough=True, settings=SETTINGS), "stacking", 2)


_FOLDS = """((row_number() OVER (PARTITION BY target ORDER BY h, row_id) - 1) % 5)::INTEGER AS fold"""


@query("oof_meta_features", _BEHAVED + f" SELECT row_id, target::DOUBLE AS label, {_FOLDS}, 2 AS width, true AS sound FROM behaved")
def oof_meta_features(spark, sf_dir):
    rows, _ = training_rows(spark, sf_dir)
    values = vector_to_array("meta_features")
    oof = learners.out_of_fold(rows, learners.profile_learners("padrao"), 2, 5, SETTINGS)
    return oof.select("row_id", "label", "fold", F.size(values).alias("width"), F.forall(values, lambda x: x.between(0, 1)).alias("sound"))


@query("stacking_weights_figures")
def stacking_weights_figures(spark, sf_dir):
    """(class, estimator, coefficient, intercept) of the meta learner."""
    names = learners.profile_learners("padrao")
    rows, _ = training_rows(spark, sf_dir)
    model = learners.fit_stacking(rows, 2, names=names, settings=SETTINGS)
    return spark.createDataFrame(learners.stacking_weights(model, names, 2), "class int, estimator string, coefficient double, intercept double")


@query("stacking_weights", "SELECT * FROM (VALUES (0, 'linearsvcCalibrated', true), (0, 'dt', true)) AS t(class, estimator, counts) "
       "WHERE (SELECT count(*) FROM lineitem) > 0")
def stacking_weights(spark, sf_dir):
    """Both estimators' chances of an attack must speak for one."""
    return stacking_weights_figures(spark, sf_dir).select("class", "estimator", F.col("coefficient").between(0.01, 1e6).alias("counts"))


@query("svm_feature_weights_figures")
def svm_feature_weights_figures(spark, sf_dir):
    """(feature, coefficient, tendency) of the linear SVM, under the features' display names."""
    rows, _ = training_rows(spark, sf_dir)
    model = learners.fit_learner("linearsvc", rows, 2, SETTINGS)
    names = prep.feature_names(rows, len(rows.select("features").first()[0]))
    return ev.top_weights(spark.createDataFrame(learners.svm_coefficients(model, names), "class int, feature string, coefficient double").drop("class"))


@query("svm_feature_weights", _WITH + """ SELECT feature, true AS finite, feature = 'Flow Packets' AS heaviest FROM (
  SELECT unnest(['Flow Packets', 'Flow Bytes', 'Down Ratio', 'Idle Ratio']) AS feature
  UNION ALL SELECT DISTINCT 'Protocol_' || CASE "Protocol" WHEN '17' THEN '17' ELSE '6' END FROM kept)""")
def svm_feature_weights(spark, sf_dir):
    """The number of packets, on which the labels rest most, must weigh most."""
    size = F.abs("coefficient")
    return svm_feature_weights_figures(spark, sf_dir).select(
        "feature", (size < float("inf")).alias("finite"), (size == F.max(size).over(Window.partitionBy())).alias("heaviest"))


@query("model_roundtrip", _WITH + " SELECT row_id, true AS same FROM targeted")
def model_roundtrip(spark, sf_dir):
    """Preprocessor and tree saved and loaded again; both must score every row alike."""
    rows = flowtable.with_protocol(flowtable.drop_irrelevant(targeted(spark, sf_dir)))
    rows = cut_lineage(rows.withColumn("label", F.col("target").cast("double")), "rows")
    numeric, categorical = flowtable.feature_columns(rows, leave=("target", "row_id", "label"))
    preprocessor = prep.fit_preprocessor(rows, numeric, categorical)
    tree = learners.fit_learner("dt", prep.transform(preprocessor, rows), 2, SETTINGS)
    folder = shared_folder(spark, "models")
    learners.save(preprocessor, folder, "scaler", "binary")
    learners.save(learners.with_preprocessor(preprocessor, tree), folder, "dt_pipeline", "binary")
    whole = learners.load(folder, "dt_pipeline", "binary")
    again = learners.with_preprocessor(learners.load(folder, "scaler", "binary"), tree)
    first = whole.transform(rows).withColumn("p", vector_to_array("dt_probability"))
    kept = first.select(*[F.col(f"`{c}`") for c in rows.columns], "p")
    return again.transform(kept).select("row_id", (vector_to_array("dt_probability") == F.col("p")).alias("same"))


@query("selected_features", _WITH + _ANOVA.removeprefix(_WITH).replace('"Label" AS g', "target::VARCHAR AS g").replace("FROM kept", "FROM targeted") + """,
  best AS (SELECT place FROM f ORDER BY f_value DESC, place DESC LIMIT 2)
  SELECT row_id, """ + ", ".join(f"EXISTS (SELECT 1 FROM best WHERE place = {i}) AS has_{i}" for i in range(4)) + " FROM targeted")
def selected_features(spark, sf_dir):
    """The two best numeric places by F value, as the slicer of a fitted selector keeps them."""
    rows = cut_lineage(targeted(spark, sf_dir), "rows")
    assembled = prep.VectorAssembler(inputCols=_NUMERIC, outputCol="features").transform(rows)
    slicer = prep.fit_selector(assembled, 2, "target")
    places = slicer.getIndices()
    return slicer.transform(assembled).select("row_id", *[(F.lit(i in places) & (F.size(vector_to_array("selected")) == 2)).alias(f"has_{i}") for i in range(4)])


@query("latency_f1_figures")
def latency_f1_figures(spark, sf_dir):
    """(model, ms_per_1000, f1): wall time to score a thousand rows, and F1 over all rows, which the fits read too."""
    rows, _ = training_rows(spark, sf_dir)
    n, names, settings = rows.count(), ("dt", "rf", "linearsvc"), learners.Settings()
    models = learners.fit_learners(rows, [(m, settings.of(m), None) for m in names], 2, settings)
    out = []
    for name, model in zip(names, models):
        scored = model.transform(rows)
        out.append((name, ev.latency_ms_per_1000(scored, n), learners.f1_of(scored, f"{name}_prediction", 2)))
    return spark.createDataFrame(out, "model string, ms_per_1000 double, f1 double")


@query("latency_f1", "SELECT model, true AS timed, true AS scored, true AS learned FROM (SELECT unnest(['dt', 'rf', 'linearsvc']) AS model) "
       "WHERE (SELECT count(*) FROM lineitem) > 0")
def latency_f1(spark, sf_dir):
    return latency_f1_figures(spark, sf_dir).select("model", (F.col("ms_per_1000") > 0).alias("timed"), F.col("f1").between(0, 1).alias("scored"),
                                                    F.col("f1").between(0.6, 1).alias("learned"))


@query("tree_complexity_figures")
def tree_complexity_figures(spark, sf_dir):
    """(max_depth, depth, leaves, rows_per_leaf, few_rows) of a tree that was fitted on all rows."""
    rows, _ = training_rows(spark, sf_dir)
    s = learners.tree_complexity(learners.fit_learner("dt", rows, 2, learners.Settings()))
    return spark.createDataFrame([(s["max_depth"], s["depth"], s["leaves"], s["rows_per_leaf"], s["few_rows"])],
                                 "max_depth int, depth int, leaves int, rows_per_leaf double, few_rows boolean")


@query("tree_complexity", _WITH + """ SELECT 12 AS max_depth, true AS within, count(*) AS leaf_rows, true AS few_rows_agrees FROM targeted""")
def tree_complexity(spark, sf_dir):
    depth, leaves = F.col("depth"), F.col("leaves")
    return tree_complexity_figures(spark, sf_dir).select(
        "max_depth", (depth.between(1, F.col("max_depth")) & (depth < leaves) & (leaves <= F.pow(F.lit(2), depth))).alias("within"),
        F.round(leaves * F.col("rows_per_leaf")).cast("long").alias("leaf_rows"),
        (F.col("few_rows") == (F.col("rows_per_leaf") < ev.FEW_ROWS_PER_LEAF)).alias("few_rows_agrees"))


def _cv_scores(spark, sf_dir):
    rows, _ = training_rows(spark, sf_dir)
    return rows, learners.cv_scores(rows, 2, 5, SETTINGS)


@query("cv_scores_figures")
def cv_scores_figures(spark, sf_dir):
    """(fold, score, mean, std, unstable) of the tree's cross-validation."""
    _, scores = _cv_scores(spark, sf_dir)
    table = spark.createDataFrame([("dt", *s) for s in scores], "model string, fold int, score double")
    summary = ev.fold_summary(table).select("model", "mean", "std", "unstable")
    return table.join(F.broadcast(summary), "model").drop("model")


@query("cv_scores", _BEHAVED + f", f AS (SELECT {_FOLDS} FROM behaved) SELECT fold, count(*) AS n, true AS learned, true AS summed FROM f GROUP BY 1")
def cv_scores(spark, sf_dir):
    """Scores of the folds, the folds' sizes, and the summary held against mean and deviation of the scores."""
    rows, scores = _cv_scores(spark, sf_dir)
    table = spark.createDataFrame([("dt", *s) for s in scores], "model string, fold int, score double")
    summary = ev.fold_summary(table).first()
    mean = sum(s for _, s in scores) / len(scores)
    std = math.sqrt(sum((s - mean) ** 2 for _, s in scores) / len(scores))
    agrees = abs(summary["mean"] - mean) < 1e-9 and abs(summary["std"] - std) < 1e-9 and summary["unstable"] == (std > ev.UNSTABLE_STD)
    sizes = stratified_folds(rows, 5, "label", seed=SETTINGS.seed).groupBy("fold").agg(F.count("*").alias("n"))
    return sizes.join(table, "fold").select("fold", "n", F.col("score").between(0.6, 1).alias("learned"), F.lit(agrees).alias("summed"))


def _points(spark, rows, what):
    """(point, folds, mean and deviation of the scores of both sides)."""
    long = spark.createDataFrame(rows, f"{what} double, fold int, train double, validation double")
    return long.groupBy(what).agg(F.count_distinct("fold").alias("folds"), F.avg("train").alias("train"), F.stddev_pop("train").alias("train_std"),
                                  F.avg("validation").alias("validation"), F.stddev_pop("validation").alias("validation_std"))


def _curve(points, what):
    """Whether each point's scores tell the classes apart, and the folds agree with each other."""
    scores = [F.col(c).between(0.3, 1) & (F.col(f"{c}_std") <= 0.25) for c in ("train", "validation")]
    return points.select(what, "folds", (scores[0] & scores[1]).alias("sound"))


@query("validation_curve_figures")
def validation_curve_figures(spark, sf_dir):
    points = learners.validation_curve(training_rows(spark, sf_dir)[0], 2, settings=SETTINGS)
    return _points(spark, [(float(d), *r) for d, *r in points], "depth")


@query("validation_curve", "SELECT unnest([2, 4, 6, 8, 10, 12, 15, 18, 22])::DOUBLE AS depth, 3::BIGINT AS folds, true AS sound "
       "WHERE (SELECT count(*) FROM lineitem) > 0")
def validation_curve(spark, sf_dir):
    return _curve(validation_curve_figures(spark, sf_dir), "depth")


@query("learning_curve_figures")
def learning_curve_figures(spark, sf_dir):
    return _points(spark, learners.learning_curve(training_rows(spark, sf_dir)[0], 2, settings=SETTINGS), "fraction")


@query("learning_curve", "SELECT unnest([0.2, 0.4, 0.6, 0.8, 1.0])::DOUBLE AS fraction, 3::BIGINT AS folds, true AS sound "
       "WHERE (SELECT count(*) FROM lineitem) > 0")
def learning_curve(spark, sf_dir):
    return _curve(learning_curve_figures(spark, sf_dir), "fraction")


@query("unique_classes", _WITH + ' SELECT DISTINCT trim("Label") AS class FROM kept')
def unique_class_names(spark, sf_dir):
    classes = unique_classes(targeted(spark, sf_dir, "multiclass"))
    return spark.createDataFrame([(c,) for c in classes], "class string")


@query("column_kinds", _WITH + """ SELECT name, kind FROM (SELECT unnest(['Flow Packets', 'Flow Bytes', 'Down Ratio', 'Idle Ratio', 'Protocol']) AS name,
  unnest(['numeric', 'numeric', 'numeric', 'numeric', 'categorical']) AS kind) WHERE (SELECT count(*) FROM kept) > 0""")
def column_kinds(spark, sf_dir):
    """Which columns of the cleaned table the preprocessor takes as numbers and which as categories."""
    rows = flowtable.drop_irrelevant(targeted(spark, sf_dir))
    numeric, categorical = flowtable.feature_columns(rows)
    return spark.createDataFrame([(c, "numeric") for c in numeric] + [(c, "categorical") for c in categorical], "name string, kind string")


ATTACK_CLASSES = ["Benign", "DoS", "Reconnaissance"]
VERDICT_SQL = """rst + fin > 0 OR is_conn_flood OR is_port_scan AS is_attack, CASE WHEN is_port_scan THEN 'Reconnaissance'
  WHEN is_conn_flood THEN 'DoS' WHEN rst > 0 THEN 'DoS'
  WHEN fin > 0 THEN 'Reconnaissance' ELSE 'Benign' END AS attack_type"""


def _labelled(flows):
    """(fitted preprocessor, preprocessed rows with `kind`). The training labels are the flows' own closing
    flags, which can be learned without error."""
    kind = (F.when(F.col("rst") > 0, F.lit("DoS")).when(F.col("fin") > 0, F.lit("Reconnaissance"))
            .otherwise(F.lit("Benign")))
    names = F.array(*map(F.lit, ATTACK_CLASSES))
    rows = flows.withColumn("kind", F.array_position(names, kind) - 1).withColumn("row_id", F.col("start_seq"))
    numeric = [c for c in fl.FEATURE_NAMES if c != "Protocol"]
    preprocessor = prep.fit_preprocessor(rows, numeric, ["Protocol"])
    return preprocessor, cut_lineage(preprocessor.transform(rows).select("kind", "row_id", "features"), "ready")


def two_stages(flows):
    """Two trained stages on the flows themselves: first attack or not, then which attack."""
    preprocessor, ready = _labelled(flows)
    first = learners.with_preprocessor(preprocessor, learners.fit_learner(
        "dt", ready.withColumn("label", (F.col("kind") > 0).cast("double")), 2, SETTINGS))
    second = learners.with_preprocessor(preprocessor, learners.fit_learner(
        "rf", ready.withColumn("label", F.col("kind").cast("double")), 3, SETTINGS))
    return first, second


def one_stage(flows):
    """One trained model for all classes, fitted on all flows. A tree looks at every feature in every node, so it
    splits by the flags; trees of a forest look at a few, and their mean can stay under the threshold."""
    preprocessor, ready = _labelled(flows)
    return learners.with_preprocessor(preprocessor, learners.fit_learner(
        "dt", ready.withColumn("label", F.col("kind").cast("double")), 3, learners.Settings()))


@query("detect_with_models", packet_sql.live_flows(MARKS_SQL) + f" SELECT flow_key, start_us, start_seq, {VERDICT_SQL} FROM flow")
def detect_with_models(spark, sf_dir):
    flows = cut_lineage(fl.build_flows(clean_packets(spark, sf_dir), marks=MARKS), "flows")
    first, second = two_stages(flows)
    decided = detect.score_flows(flows, first, "dt", ["0", "1"], "cascade", second=second, second_name="rf", second_classes=ATTACK_CLASSES)
    return decided.select(*fl.FLOW, "is_attack", "attack_type")


@query("detect_multiclass", packet_sql.live_flows(MARKS_SQL) + f""" SELECT flow_key, start_us, start_seq,
  rst + fin > 0 OR is_port_scan OR is_conn_flood AS is_attack, CASE WHEN is_conn_flood THEN '{decide.FLOOD_LABEL}'
  WHEN is_port_scan AND rst + fin = 0 THEN '{decide.SCAN_LABEL}' WHEN rst > 0 THEN 'DoS' WHEN fin > 0 THEN 'Reconnaissance'
  ELSE '{decide.BENIGN}' END AS attack_type FROM flow""")
def detect_multiclass(spark, sf_dir):
    """One trained model that names the attack at once."""
    flows = cut_lineage(fl.build_flows(clean_packets(spark, sf_dir), marks=MARKS), "flows")
    return detect.score_flows(flows, one_stage(flows), "dt", ATTACK_CLASSES, "multiclass").select(*fl.FLOW, "is_attack", "attack_type")
