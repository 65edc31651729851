"""Attack decision from class probabilities and the scan / flood marks of a flow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

PROBABILITIES = T.MapType(T.StringType(), T.DoubleType())

# Labels and the confidence given to rule-based decisions.
BENIGN, ERROR = "Benign", "Error"
FLOOD_LABEL, SCAN_LABEL, RULE_CONFIDENCE = "DoS", "Reconnaissance", 0.99
UNKNOWN_ATTACK = "Maligno (Ataque Detectado)"
UNDETERMINED_ATTACK = "Maligno (Indeterminado)"


def usable(proba: Column, classes: Column) -> Column:
    """False where scoring failed: no vector, a wrong length, or a value that is not a number."""
    sane = ~F.exists(proba, lambda p: p.isNull() | F.isnan(p)) & (F.size(proba) == F.size(classes))
    return F.coalesce(sane & (F.size(proba) > 0), F.lit(False))


def _ranked(classes: Column, proba: Column) -> Column:
    return F.transform(proba, lambda p, i: F.struct(
        p.alias("p"), (-i).alias("back"), F.get(classes, i).alias("label")))


def best(classes: Column, proba: Column) -> Column:
    """struct(p, back, label) of the largest probability; the first class wins a tie."""
    return F.array_max(_ranked(classes, proba))


def probability_map(classes: Column, proba: Column) -> Column:
    return F.map_from_arrays(classes, proba)


def is_benign(label: Column) -> Column:
    return F.upper(F.trim(label)) == "BENIGN"


def malicious_place(classes: Column) -> Column:
    """Place of class '1', or the last place if there is no such class."""
    found = F.array_position(classes, F.lit("1")).cast("int")
    return F.when(found > 0, found).otherwise(F.size(classes))


def _let(value: Column, body) -> Column:
    """body(value) with the value worked out once, also after the optimizer has merged projections."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def with_second_stage(df: DataFrame, wanted: Column | None = None) -> DataFrame:
    """Adds `second`, the label and confidence of the attack classifier, for rows known to be
    attacks: its first choice, or its best attack class when the first choice is benign."""
    classes, proba = F.col("dt_classes"), F.col("dt_proba")
    named = usable(proba, classes)
    if wanted is not None:
        named = wanted & named

    def outcome(label, p):
        return F.struct(label.alias("label"), p.alias("confidence"))

    def choose(tops):
        first, attack = tops["first"], tops["attack"]
        return (F.when(attack.isNull(), outcome(F.lit(UNKNOWN_ATTACK), F.lit(0.0)))
                .when((attack["p"] > 0) | ~is_benign(first["label"]), outcome(attack["label"], attack["p"]))
                .otherwise(outcome(F.lit(UNDETERMINED_ATTACK), F.lit(0.0))))

    def tops(ranked):
        return F.struct(F.array_max(ranked).alias("first"), F.array_max(
            F.filter(ranked, lambda x: ~is_benign(x["label"]))).alias("attack"))

    chosen = _let(_let(_ranked(classes, proba), tops), choose)
    return df.withColumn("second", F.when(named, chosen))


def decide_binary(scored: DataFrame, threshold: float = 0.5, second_stage: bool = True) -> DataFrame:
    """Expects `classes`, `proba`, `is_port_scan`, `is_conn_flood` and, for the second stage,
    `dt_classes`, `dt_proba` (null where it was not run or failed)."""
    classes, proba = F.col("classes"), F.col("proba")
    scan, flood = F.col("is_port_scan"), F.col("is_conn_flood")
    works = usable(proba, classes)
    malicious = F.when(F.col("_works"), F.get(proba, malicious_place(classes) - 1))
    by_model = F.col("_malicious") >= threshold
    attack = by_model | scan | flood
    by_rule = flood | (scan & ~by_model)
    rule_label = F.when(flood, F.lit(FLOOD_LABEL)).otherwise(F.lit(SCAN_LABEL))
    none = F.create_map().cast(PROBABILITIES)
    decided = scored.withColumn("_works", works).withColumn("_malicious", malicious).withColumns({
        "_attack": attack, "_by_rule": by_rule})
    ok, by_rule = F.col("_works"), F.col("_by_rule")
    if second_stage:
        decided = with_second_stage(decided, F.coalesce(F.col("_attack") & ~by_rule, F.lit(False)))
        second_map = F.when(F.col("second").isNotNull(),
                            probability_map(F.col("dt_classes"), F.col("dt_proba")))
    else:
        decided = decided.withColumn("second", F.lit(None).cast("struct<label:string,confidence:double>"))
        second_map = F.lit(None).cast(PROBABILITIES)
    second = F.col("second")
    attack = F.col("_attack")
    label = (F.when(by_rule, rule_label)
             .otherwise(F.coalesce(second["label"], F.lit(UNKNOWN_ATTACK))))
    raised = F.when(by_rule, F.lit(RULE_CONFIDENCE)).otherwise(F.col("_malicious"))
    return decided.withColumns({
        "is_attack": F.coalesce(ok & attack, F.lit(False)),
        "attack_type": F.when(~ok, F.lit(ERROR)).when(attack, label).otherwise(F.lit(BENIGN)),
        "probability": F.when(~ok, F.lit(0.0)).when(attack, raised).otherwise(F.get(proba, F.lit(0))),
        "binary_probability": F.when(ok, F.when(attack, raised).otherwise(F.col("_malicious"))),
        "dt_attack_type": F.when(ok & attack, label),
        "dt_confidence": F.when(ok, F.when(attack & by_rule, F.lit(RULE_CONFIDENCE))
                                .otherwise(F.coalesce(second["confidence"], F.lit(0.0)))),
        "dt_probabilities": F.when(ok, F.when(attack & ~by_rule, F.coalesce(second_map, none)).otherwise(none)),
        "all_probabilities": F.when(ok, probability_map(classes, proba)),
    }).drop("_works", "_malicious", "_attack", "_by_rule", "second")


def decide_multiclass(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    classes, proba = F.col("classes"), F.col("proba")
    scan, flood = F.col("is_port_scan"), F.col("is_conn_flood")
    scored = scored.withColumn("_works", usable(proba, classes))
    scored = scored.withColumn("_top", F.when(F.col("_works"), best(classes, proba)))
    works, label, chance = F.col("_works"), F.col("_top.label"), F.col("_top.p")
    by_model = ~is_benign(label) & (chance >= threshold)
    attack = by_model | scan | flood
    by_scan = scan & ~by_model
    return scored.withColumns({
        "is_attack": F.coalesce(works & attack, F.lit(False)),
        "attack_type": (F.when(~works, F.lit(ERROR)).when(flood, F.lit(FLOOD_LABEL))
                        .when(by_scan, F.lit(SCAN_LABEL)).when(attack, label).otherwise(F.lit(BENIGN))),
        "probability": (F.when(~works, F.lit(0.0)).when(flood | by_scan, F.lit(RULE_CONFIDENCE))
                        .otherwise(chance)),
        "all_probabilities": F.when(works, probability_map(classes, proba)),
    }).drop("_works", "_top")


def detector_stats(decided: DataFrame) -> DataFrame:
    return decided.agg(F.count("*").alias("total_flows_evaluated"),
                       F.count_if("is_attack").alias("total_attacks_detected"))


def attack_type_counts(decided: DataFrame) -> DataFrame:
    return decided.where("is_attack").groupBy("attack_type").agg(F.count("*").alias("n"))
