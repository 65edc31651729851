"""From packets to decided flows with trained models, in batch and on a stream."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from wirelark.functions import net
from wirelark.operators import decide
from wirelark.operators import flows as fl

# How many distinct ports / attempts in five seconds make a scan / a flood.
DEFAULT_MARKS = dict(scan_threshold=15, flood_threshold=20)


def relevant(packets: DataFrame, ignore_broadcast: bool = True, ignore_ports=net.DISCOVERY_PORTS) -> DataFrame:
    """TCP and UDP without broadcast, multicast and discovery traffic. Applied before anything is
    kept or shuffled."""
    kept = net.tcp_udp_only(packets)
    if ignore_broadcast:
        kept = net.unicast_only(kept)
    return net.without_ports(kept, ignore_ports)


def _proba(df: DataFrame, model: PipelineModel, name: str, out: str) -> DataFrame:
    keep = [F.col(f"`{c}`") for c in df.columns]
    return model.transform(df).select(*keep, vector_to_array(f"{name}_probability").alias(out))


def score_flows(flows: DataFrame, model: PipelineModel, name: str, classes, mode: str = "binary",
                threshold: float = 0.5, second: PipelineModel | None = None, second_name: str = "dt",
                second_classes=()) -> DataFrame:
    """Decisions on flows. `model` and `second` take raw feature columns (preprocessor included) and
    give `<name>_probability`; in the modes 'binary' and 'cascade' the second one only counts for the
    flows that are attacks, and in a batch only runs on them."""
    scored = _proba(flows, model, name, "proba").withColumn("classes", F.array(*[F.lit(str(c)) for c in classes]))
    if mode == "multiclass":
        return decide.decide_multiclass(scored, threshold).drop("classes", "proba")
    if mode not in ("binary", "cascade"):
        raise ValueError("mode must be 'binary', 'cascade' or 'multiclass'")
    if second is None:
        return decide.decide_binary(scored, threshold, second_stage=False).drop("classes", "proba")
    attack = ((F.get("proba", decide.malicious_place(F.col("classes")) - 1) >= threshold)
              | F.col("is_port_scan") | F.col("is_conn_flood"))
    attack = F.coalesce(attack, F.lit(False))
    if flows.isStreaming:               # two branches would run the stream's operators, and keep their state, twice
        named = _proba(scored, second, second_name, "dt_proba")
        both = named.withColumn("dt_proba", F.when(attack, F.col("dt_proba")))
    else:
        named = _proba(scored.where(attack), second, second_name, "dt_proba")
        both = named.unionByName(scored.where(~attack).withColumn("dt_proba", F.lit(None).cast("array<double>")))
    both = both.withColumn("dt_classes", F.array(*[F.lit(str(c)) for c in second_classes]))
    return decide.decide_binary(both, threshold).drop("classes", "proba", "dt_classes", "dt_proba")


def detect(packets: DataFrame, model: PipelineModel, name: str, classes, limits: fl.FlowLimits = fl.LIVE,
           marks: dict | None = None, ignore_broadcast: bool = True, ignore_ports=net.DISCOVERY_PORTS,
           **scoring) -> DataFrame:
    """A bounded set of packets to decided flows; every flow that is open at the end is decided."""
    kept = relevant(packets, ignore_broadcast, ignore_ports)
    flows = fl.build_flows(kept, limits, DEFAULT_MARKS if marks is None else marks)
    return score_flows(flows, model, name, classes, **scoring)


def detect_stream(packets: DataFrame, model: PipelineModel, name: str, classes, limits: fl.FlowLimits = fl.LIVE,
                  marks: dict | None = None, ignore_broadcast: bool = True, ignore_ports=net.DISCOVERY_PORTS,
                  **scoring) -> DataFrame:
    """The same on a packet stream with event time `ts`; flows are decided as they finish."""
    from wirelark.streaming import processors
    kept = relevant(packets, ignore_broadcast, ignore_ports)
    marked = processors.mark_stream(kept, **(DEFAULT_MARKS if marks is None else marks))
    return score_flows(processors.stream_flows(marked, limits), model, name, classes, **scoring)
