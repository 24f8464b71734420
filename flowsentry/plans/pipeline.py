"""All detectors over one packet table: alerts, deduplicated alerts, pipeline figures."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import alerts as al
from ..operators import anomaly, features, flood, flows, payload, rules, scan
from ..operators.baseline import Baseline
from ..operators.traffic import port_usage, protocol_distribution, side_by_side
from ..params import CustomRule, Thresholds
from ..session import cut


@dataclass(frozen=True)
class PipelineResult:
    """Alerts of all detectors, those stored after deduplication, and the flows."""

    packets: DataFrame
    raised: DataFrame
    stored: DataFrame
    flows: DataFrame


def raise_alerts(packets: DataFrame, p: Thresholds = Thresholds(), custom: list[CustomRule] | None = None,
                 model: tuple[anomaly.Forest, Baseline] | None = None) -> DataFrame:
    """Alerts of every detector, each after its own cooldown."""
    parts = [scan.scan_alerts(packets, p), flood.flood_alerts(packets, p), payload.payload_alerts(packets, p)]
    if custom:
        parts.append(rules.rule_alerts(packets, custom, p))
    if model:
        forest, baseline = model
        scored = anomaly.score(features.features(packets), forest)
        parts.append(anomaly.anomaly_alerts(scored, baseline, p))
    return al.union_alerts(*parts)


def run(packets: DataFrame, p: Thresholds = Thresholds(), custom: list[CustomRule] | None = None,
        model: tuple[anomaly.Forest, Baseline] | None = None) -> PipelineResult:
    raised = cut(raise_alerts(packets, p, custom, model))
    return PipelineResult(packets, raised, al.deduplicate(raised, p.dedup_window),
                          flows.flow_sessions(packets, p.connection_timeout))


def statistics(result: PipelineResult) -> DataFrame:
    """Packets, packets with alerts, detection rate, and alerts processed, stored and suppressed."""
    c = F.col
    packets = result.packets.agg(F.count(F.lit(1)).alias("packets_processed"))
    raised = result.raised.groupBy("packet_id").agg(F.count(F.lit(1)).alias("n")).agg(
        F.count(F.lit(1)).alias("threats_detected"), F.coalesce(F.sum("n"), F.lit(0)).alias("alerts_processed"))
    stored = result.stored.agg(F.count(F.lit(1)).alias("alerts_stored"))
    return side_by_side(packets, raised, stored).withColumn(
        "alerts_suppressed", c("alerts_processed") - c("alerts_stored")).withColumn(
        "detection_rate", c("threats_detected") / F.greatest(c("packets_processed"), F.lit(1)) * 100)


def active_threats(packets: DataFrame, as_of: datetime, p: Thresholds = Thresholds()) -> dict[str, DataFrame]:
    """Sources scanning or sending at `as_of`, top talkers, active flows and protocols."""
    live = flows.active_flows(flows.flow_sessions(packets, p.connection_timeout), as_of, p.connection_timeout)
    return {"active_port_scans": scan.active_scans(packets, as_of, p),
            "active_ddos_attacks": flood.active_floods(packets, as_of, p),
            "top_talkers": flows.top_talkers(live), "connection_count": live.agg(
                F.count(F.lit(1)).alias("connection_count")),
            "protocol_distribution": protocol_distribution(packets), "top_ports": port_usage(packets)}
