"""Throttled alerts: at most one per source and attack type in each cooldown period."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from wirelark.operators.cuts import greedy_cuts


def throttle_key(src_ip: Column, attack_type: Column) -> Column:
    return F.concat_ws("_", src_ip, attack_type)


def throttle(events: DataFrame, cooldown_us: int = 60_000_000, key: str = "alert_key",
             chunk_rows: int | None = None) -> DataFrame:
    """Adds `sent` and `suppressed_count`. The cooldown counts from the last alert that was sent.
    On a sent row the count is what was held back since the one before; on a held-back row it is
    the running number of held-back events."""
    cut = greedy_cuts(events, key, "ts_us", "seq", active=cooldown_us, chunk_rows=chunk_rows)
    sent = F.col("run_pos") == 0
    out = cut.withColumn("sent", sent).withColumn(
        "suppressed_count", F.when(sent, F.coalesce(F.col("prev_run_pos"), F.lit(0)))
                             .otherwise(F.col("run_pos")))
    return out.select(*events.columns, "sent", "suppressed_count")


def throttle_totals(throttled: DataFrame) -> DataFrame:
    return throttled.agg(F.count_if("sent").alias("alerts_sent"),
                         F.count_if(~F.col("sent")).alias("alerts_suppressed"))


@dataclass(frozen=True)
class AlertStyle:
    product: str = "Sensor"
    device: str = "sensor"
    hostname: str = "localhost"
    cooldown_seconds: int = 60


# Fields of an alert and what stands in for a missing one.
ALERT_DEFAULTS = {
    "attack_type": "Maligno (Desconhecido)", "probability": 1.0, "src_ip": "0.0.0.0", "src_port": 0,
    "dst_ip": "0.0.0.0", "dst_port": 0, "protocol_name": "TCP/UDP", "duration_sec": 0.0,
    "total_packets": 0, "total_bytes": 0, "interface": "eth0/wlan0",
}


def alert_payload(detections: DataFrame, interface: str) -> DataFrame:
    """The attack rows, reduced to what an alert shows."""
    rows = detections.where("is_attack").withColumn("interface", F.lit(interface))
    return rows.select("seq", "ts_us", *ALERT_DEFAULTS)


def _filled(df: DataFrame) -> dict[str, Column]:
    return {name: F.coalesce(F.col(name), F.lit(value)) if name in df.columns else F.lit(value)
            for name, value in ALERT_DEFAULTS.items()}


def render(alerts: DataFrame, style: AlertStyle = AlertStyle()) -> DataFrame:
    """Adds `subject`, `text` and `html`; `suppressed_count` may be absent."""
    c = _filled(alerts)
    held = F.coalesce(F.col("suppressed_count"), F.lit(0)) if "suppressed_count" in alerts.columns else F.lit(0)
    held_text = held.cast("string")
    confidence = F.concat(F.format_string("%.2f", c["probability"] * 100), F.lit("%"))
    duration = F.concat(F.format_string("%.4f", c["duration_sec"]), F.lit(" s"))
    volume = F.concat(F.format_number(c["total_bytes"], 0), F.lit(" bytes"))
    packets = c["total_packets"].cast("string")
    source = F.concat(c["src_ip"], F.lit(":"), c["src_port"].cast("string"))
    target = F.concat(c["dst_ip"], F.lit(":"), c["dst_port"].cast("string"))
    when = F.date_format(F.timestamp_micros(F.col("ts_us")), "yyyy-MM-dd HH:mm:ss")
    rule, thin = "=" * 53, "-" * 53
    seconds = int(style.cooldown_seconds)
    # Wording and layout of the plain-text alert.
    note = F.when(held > 0, F.concat(
        F.lit("\n[AVISO ANTI-FLOOD]: "), held_text,
        F.lit(" evento(s) semelhante(s) foram agregados durante a janela de cooldown "
              f"de {seconds}s.\n"))).otherwise(F.lit(""))
    text = F.concat_ws("\n", *[x if isinstance(x, Column) else F.lit(x) for x in (
        rule, f"🚨 [{style.product}] ALERTA DE INTRUSÃO DETECTADA", rule,
        f"Dispositivo : {style.device} ({style.hostname})",
        F.concat(F.lit("Interface   : "), c["interface"]),
        F.concat(F.lit("Timestamp   : "), when),
        "", "DETALHES DO ATAQUE:", thin,
        F.concat(F.lit("Classificação : "), c["attack_type"]),
        F.concat(F.lit("Confiança     : "), confidence),
        F.concat(F.lit("Origem        : "), source),
        F.concat(F.lit("Destino       : "), target),
        F.concat(F.lit("Protocolo     : "), c["protocol_name"]),
        "", "ESTATÍSTICAS DO FLUXO:", thin,
        F.concat(F.lit("Duração Total : "), duration),
        F.concat(F.lit("Total Pacotes : "), packets),
        F.concat(F.lit("Total Volume  : "), volume),
        note,
        F.concat(F.lit("Ação Recomendada: Verificar regras de firewall (iptables/nftables) para o IP "),
                 c["src_ip"], F.lit(".")),
        rule, "")])
    cells = [("Classificação", F.concat(c["attack_type"], F.lit(" (Confiança: "), confidence, F.lit(")"))),
             ("Origem", source), ("Destino", target), ("Protocolo", c["protocol_name"]),
             ("Duração do Fluxo", duration),
             ("Pacotes / Volume", F.concat(packets, F.lit(" pacotes ("), volume, F.lit(")"))),
             ("Interface / Timestamp", F.concat_ws(" • ", c["interface"], when))]
    held_html = F.when(held > 0, F.concat(
        F.lit("<p class='held'>"), held_text,
        F.lit(f" alerta(s) semelhante(s) suprimido(s) nos últimos {seconds} segundos</p>"))
    ).otherwise(F.lit(""))
    html = F.concat(
        F.lit("<html><body><h2>"), F.lit(style.product), F.lit(": Intrusão Detectada</h2>"), held_html,
        F.lit("<table>"),
        *[F.concat(F.lit(f"<tr><th>{label}</th><td>"), value, F.lit("</td></tr>"))
          for label, value in cells],
        F.lit("</table><code>sudo iptables -A INPUT -s "), c["src_ip"],
        F.lit(" -j DROP</code></body></html>"))
    subject = F.concat(F.lit(f"🚨 [{style.product}] Alerta de Segurança: "), c["attack_type"],
                       F.lit(" detectado de "), c["src_ip"])
    return alerts.withColumns({"subject": subject, "text": text, "html": html})


def recipients(text: Column) -> Column:
    """'a@x, b@y,' -> [a@x, b@y]."""
    return F.filter(F.transform(F.split(text, ","), lambda r: F.trim(r)), lambda r: r != "")


def hand_over(alerts: DataFrame, send, dry_run: bool = False) -> None:
    """Gives each partition of rendered alerts to `send(iterator of rows)`; nothing on a dry run."""
    if not dry_run:
        alerts.foreachPartition(send)
