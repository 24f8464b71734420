"""Security summary, trends and compliance reports, one DataFrame per section."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import hours_between, percent_of, period_label, round2, time_bucket
from ..operators.traffic import in_range, last_hours, protocol_distribution, side_by_side, traffic_totals
from ..schema import NETWORK_ANOMALY, SEVERITIES

SEVERE = ("Critical", "High")
COMPLIANCE_REPORTS = ("security_audit", "incident_summary", "network_activity")


# ---- alerts ----------------------------------------------------------------------------------

def alert_grouping_sets(alerts: DataFrame) -> DataFrame:
    """Counts per type and severity, per type, per severity and in all, as (metric, alert_count)."""
    c = F.col
    sets = alerts.groupingSets(
        [["alert_type", "severity"], ["alert_type"], ["severity"], []], "alert_type", "severity",
    ).agg(F.count(F.lit(1)).alias("alert_count"), F.grouping_id().alias("g"))
    metric = F.when(c("g") == 0, F.concat("alert_type", F.lit("_"), "severity")) \
        .when(c("g") == 1, c("alert_type")).when(c("g") == 2, c("severity")).otherwise(F.lit("total"))
    return sets.select(metric.alias("metric"), "alert_count")


def severity_counts(alerts: DataFrame) -> DataFrame:
    """One row, one column per severity, zeros included."""
    return alerts.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])


def severity_distribution(alerts: DataFrame) -> DataFrame:
    """The four severities with their counts, zeros included."""
    entries = F.array(*[F.struct(F.lit(s).alias("severity"), F.col(s).alias("alert_count")) for s in SEVERITIES])
    return severity_counts(alerts).select(F.inline(entries))


def type_distribution(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("alert_type").agg(F.count(F.lit(1)).alias("alert_count"))


def top_alert_sources(alerts: DataFrame, limit: int = 10) -> DataFrame:
    return alerts.groupBy("source_ip").agg(F.count(F.lit(1)).alias("alert_count")).orderBy(
        F.desc("alert_count"), "source_ip").limit(limit)


def top_threats(alerts: DataFrame, limit: int = 10) -> DataFrame:
    return alerts.groupBy("alert_type", "severity", "source_ip").agg(
        F.count(F.lit(1)).alias("alert_count")).orderBy(
        F.desc("alert_count"), "alert_type", "severity", "source_ip").limit(limit)


def alert_statistics(alerts: DataFrame, as_of: datetime, hours: float = 24) -> dict[str, DataFrame]:
    """Total, severities, types and top sources of the last `hours`."""
    recent = last_hours(alerts, as_of, hours)
    return {"total": recent.agg(F.count(F.lit(1)).alias("total_alerts")),
            "severity_distribution": severity_distribution(recent),
            "type_distribution": type_distribution(recent),
            "top_source_ips": top_alert_sources(recent)}


# ---- connections -----------------------------------------------------------------------------

def connection_statistics(connections: DataFrame) -> DataFrame:
    return connections.agg(
        F.count(F.lit(1)).alias("total_connections"),
        F.coalesce(F.avg("connection_duration"), F.lit(0.0)).alias("avg_duration_seconds"),
        F.coalesce(F.sum(F.col("bytes_sent") + F.col("bytes_received")), F.lit(0)).alias("total_bytes_transferred"))


# ---- security summary ------------------------------------------------------------------------

def risk(total_packets: Column, total: Column, critical: Column, high: Column, medium: Column) -> Column:
    """0 to 100: alerts per thousand packets ×10 plus the mean severity weight ×20."""
    one = F.lit(1)
    per_thousand = total / F.greatest(total_packets, one) * 1000
    weight = critical * 10 + high * 5 + medium * 2
    return F.least(F.lit(100.0), per_thousand * 10 + weight / F.greatest(total, one) * 20)


def risk_score(packets: DataFrame, alerts: DataFrame) -> DataFrame:
    c = F.col
    counts = alerts.agg(F.count(F.lit(1)).alias("total"), *[
        F.count_if(c("severity") == s).alias(s.lower()) for s in SEVERITIES])
    totals = packets.agg(F.count(F.lit(1)).alias("total_packets"))
    score = risk(c("total_packets"), c("total"), c("critical"), c("high"), c("medium"))
    return side_by_side(totals, counts).select(round2(score).alias("risk_score"))


def security_summary(packets: DataFrame, alerts: DataFrame, connections: DataFrame,
                     start: datetime, end: datetime) -> dict[str, DataFrame]:
    """The sections of the summary over a closed range (connections by first_seen)."""
    p, a = in_range(packets, start, end), in_range(alerts, start, end)
    k = in_range(connections, start, end, "first_seen")
    moment = lambda t: F.lit(t).cast("timestamp")
    anomalies = a.agg(F.count_if(F.col("alert_type") == NETWORK_ANOMALY).alias("anomaly_count"))
    scalars = side_by_side(traffic_totals(p), anomalies, risk_score(p, a)).withColumn(
        "time_period", period_label(moment(start), moment(end)))
    return {"summary": scalars, "protocol_distribution": protocol_distribution(p),
            "alert_summary": alert_grouping_sets(a), "top_threats": top_threats(a),
            "connection_summary": connection_statistics(k)}


def flat_summary(sections: dict[str, DataFrame]) -> DataFrame:
    """The summary as (category, metric, value, index) text rows, the shape of its CSV export."""
    none = F.lit(None).cast("int")

    def row(category, metric, value, index=none):
        return F.struct(F.lit(category).alias("category"), metric.alias("metric"),
                        value.cast("string").alias("value"), index.alias("index"))

    def wide(df, category, names):
        return df.select(F.inline(F.array(*[row(category, F.lit(n), F.col(n)) for n in names])))

    long = {"protocol_distribution": ("protocol", "packet_count"), "alert_summary": ("metric", "alert_count")}
    out = wide(sections["summary"], "summary", sections["summary"].columns)
    for name, (key, value) in long.items():
        out = out.unionByName(sections[name].select(F.inline(F.array(row(name, F.col(key), F.col(value))))))
    # the top list has at most ten rows, so its numbering needs no partition
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc("alert_count"), "alert_type", "severity", "source_ip")
    threats = sections["top_threats"].withColumn("i", F.row_number().over(order) - 1)
    names = {"threat_type": "alert_type", "severity": "severity", "source_ip": "source_ip", "count": "alert_count"}
    out = out.unionByName(threats.select(F.inline(F.array(*[
        row("top_threats", F.lit(m), F.col(x), F.col("i")) for m, x in names.items()]))))
    return out.unionByName(wide(sections["connection_summary"], "connection_summary",
                                sections["connection_summary"].columns))


# ---- trends ----------------------------------------------------------------------------------

def traffic_trend(packets: DataFrame, granularity: str) -> DataFrame:
    return packets.groupBy(time_bucket(F.col("timestamp"), granularity).alias("bucket")).agg(
        F.count(F.lit(1)).alias("packet_count"),
        F.coalesce(F.sum(F.col("size").cast("long")), F.lit(0)).alias("total_bytes"))


def alert_trend(alerts: DataFrame, granularity: str) -> DataFrame:
    """Alerts per bucket and severity, four columns; only buckets with alerts appear."""
    return alerts.groupBy(time_bucket(F.col("timestamp"), granularity).alias("bucket")).agg(
        *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])


def _counts_by(df: DataFrame, granularity: str, value: str, count: str) -> DataFrame:
    return df.groupBy(time_bucket(F.col("timestamp"), granularity).alias("bucket"), value).agg(
        F.count(F.lit(1)).alias(count))


def protocol_trend(packets: DataFrame, granularity: str) -> DataFrame:
    return _counts_by(packets, granularity, "protocol", "packet_count")


def threat_evolution(alerts: DataFrame, granularity: str) -> DataFrame:
    return _counts_by(alerts, granularity, "alert_type", "threat_count")


def as_maps(trend: DataFrame, value: str, count: str) -> DataFrame:
    """A long trend as one row per bucket with a map; values that did not occur stay absent."""
    return trend.groupBy("bucket").agg(F.map_from_entries(
        F.array_sort(F.collect_list(F.struct(value, count)))).alias("counts"))


def talkers_by_period(packets: DataFrame, start: datetime, end: datetime, limit: int = 5,
                      closed: bool = False) -> DataFrame:
    """Top sources of up to 24 equal periods, the last one cut at `end`.

    Periods are half-open. With `closed`, a packet on an inner boundary counts in both periods.
    """
    c = F.col
    hours = max(1, int((end - start).total_seconds() / 3600 / 24))
    length = hours * 3600 * 1_000_000
    span = int((end - start) / timedelta(microseconds=1))
    last = max(0, -(-span // length) - 1)
    since_start = F.unix_micros("timestamp") - F.unix_micros(F.lit(start).cast("timestamp"))
    offset = F.pmod(since_start, F.lit(length))
    index = F.least(((since_start - offset) / length).cast("long"), F.lit(last))
    rows = in_range(packets, start, end)
    if closed:
        both = (offset == 0) & (since_start > 0) & (since_start <= F.lit(last * length))
        rows = rows.withColumn("period", F.explode(
            F.when(both, F.array(index - 1, index)).otherwise(F.array(index))))
    else:
        rows = rows.withColumn("period", index)
    counts = rows.groupBy("period", "src_ip").agg(
        F.count(F.lit(1)).alias("packet_count"), F.sum(c("size").cast("long")).alias("total_bytes"))
    rank = Window.partitionBy("period").orderBy(F.desc("packet_count"), "src_ip")
    begins = F.unix_micros(F.lit(start).cast("timestamp")) + c("period") * length
    finish = F.unix_micros(F.lit(end).cast("timestamp"))
    return counts.withColumn("rank", F.row_number().over(rank)).filter(c("rank") <= limit).select(
        F.timestamp_micros(begins).alias("period_start"),
        F.timestamp_micros(F.least(begins + length, finish)).alias("period_end"),
        "rank", "src_ip", "packet_count", "total_bytes")


def trend_summary(traffic: DataFrame, alerts: DataFrame) -> DataFrame:
    """Mean and peak per bucket on both sides; `insufficient_data` when either side is empty."""
    c = F.col
    per_bucket = alerts.select("bucket", sum((c(s) for s in SEVERITIES), F.lit(0)).alias("n"))
    t = traffic.agg(F.count(F.lit(1)).alias("t_n"), F.avg("packet_count").alias("t_avg"),
                    F.max("packet_count").alias("t_max"))
    a = per_bucket.agg(F.count(F.lit(1)).alias("a_n"), F.avg("n").alias("a_avg"), F.max("n").alias("a_max"),
                       F.max_by("n", "bucket").alias("a_last"))
    ready = (c("t_n") > 0) & (c("a_n") > 0)
    text = lambda test, yes, no: F.when(ready, F.when(test, yes).otherwise(no))
    return side_by_side(t, a).select(
        F.when(ready, F.lit("ok")).otherwise(F.lit("insufficient_data")).alias("status"),
        F.when(ready, c("t_avg").cast("long")).alias("average_packets_per_period"),
        F.when(ready, c("t_max")).alias("peak_traffic_packets"),
        text(c("t_max") > c("t_avg") * 2, "high", "normal").alias("traffic_variance"),
        F.when(ready, round2(c("a_avg"))).alias("average_alerts_per_period"),
        F.when(ready, c("a_max")).alias("peak_alerts"),
        text(c("a_last") > c("a_avg"), "increasing", "stable").alias("alert_trend"))


def trend_analysis(packets: DataFrame, alerts: DataFrame, as_of: datetime, days: int = 7,
                   granularity: str = "hour") -> dict[str, DataFrame]:
    start = as_of - timedelta(days=days)
    p, a = in_range(packets, start, as_of), in_range(alerts, start, as_of)
    traffic, alert = traffic_trend(p, granularity), alert_trend(a, granularity)
    return {"traffic_trends": traffic, "alert_trends": alert,
            "protocol_trends": protocol_trend(p, granularity),
            "top_talkers_trends": talkers_by_period(packets, start, as_of),
            "threat_evolution": threat_evolution(a, granularity),
            "summary": trend_summary(traffic, alert)}


# ---- compliance ------------------------------------------------------------------------------

def security_audit(alerts: DataFrame) -> DataFrame:
    """Critical and High alerts: counts, resolution rate, response hours, status, recommendations."""
    c = F.col
    severe = alerts.filter(c("severity").isin(*SEVERE))
    done = c("resolved")
    response = F.when(done & c("resolved_at").isNotNull(), hours_between(c("timestamp"), c("resolved_at")))

    def open_type(*spellings):
        return F.count_if(~done & c("alert_type").isin(*spellings))

    zero = F.lit(0.0)
    m = severe.agg(
        F.count(F.lit(1)).alias("total_critical_high_alerts"), F.count_if(done).alias("resolved_count"),
        F.count_if(~done).alias("unresolved_count"),
        F.coalesce(F.avg(response), zero).alias("avg_hours"),
        F.coalesce(F.min(response), zero).alias("fastest_response_hours"),
        F.coalesce(F.max(response), zero).alias("slowest_response_hours"),
        open_type("port_scan", "Port Scan").alias("open_scans"),
        open_type("ddos", "DDoS Attack").alias("open_floods"))
    advice = F.array_compact(F.array(
        F.when(c("unresolved_count") > 0, F.format_string(
            "Resolve %d outstanding critical/high severity alerts", c("unresolved_count"))),
        F.when(c("avg_hours") > 24, F.lit(
            "Improve incident response time - current average exceeds 24 hours")),
        F.when(c("open_scans") > 0, F.lit("Implement additional port scan protection measures")),
        F.when(c("open_floods") > 0, F.lit("Review DDoS mitigation strategies"))))
    healthy = F.array(F.lit("Security posture appears healthy - maintain current monitoring practices"))
    return m.select(
        "total_critical_high_alerts", "resolved_count", "unresolved_count",
        percent_of(c("resolved_count"), c("total_critical_high_alerts")).alias("resolution_rate"),
        c("avg_hours").alias("average_response_hours_exact"),
        round2(c("avg_hours")).alias("average_response_time_hours"),
        "fastest_response_hours", "slowest_response_hours",
        F.when(c("unresolved_count") == 0, F.lit("compliant")).otherwise(F.lit("non_compliant"))
        .alias("compliance_status"),
        F.when(F.size(advice) > 0, advice).otherwise(healthy).alias("recommendations"))


def incident_breakdown(alerts: DataFrame) -> DataFrame:
    """Per type: count and a map from severity to count."""
    per = alerts.groupBy("alert_type", "severity").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("alert_type").agg(
        F.sum("n").alias("incident_count"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("severity", "n")))).alias("severities"))


def incident_summary(alerts: DataFrame) -> dict[str, DataFrame]:
    return {"total": alerts.agg(F.count(F.lit(1)).alias("total_incidents")),
            "incident_breakdown": incident_breakdown(alerts),
            "top_incident_sources": top_alert_sources(alerts),
            "severity_distribution": severity_distribution(alerts)}


def network_activity(packets: DataFrame, connections: DataFrame) -> dict[str, DataFrame]:
    """Traffic totals with health, protocols, and the connections' bandwidth and mean duration."""
    totals = traffic_totals(packets).withColumn("network_health", F.when(
        F.col("total_packets") > 0, F.lit("healthy")).otherwise(F.lit("no_traffic")))
    k = connection_statistics(connections).select(
        "total_connections", F.col("total_bytes_transferred").alias("total_bandwidth_bytes"),
        F.col("avg_duration_seconds").alias("average_duration_exact"),
        round2(F.col("avg_duration_seconds")).alias("average_connection_duration"))
    return {"traffic_summary": totals, "protocol_distribution": protocol_distribution(packets),
            "connection_analysis": k}


def compliance_report(kind: str, packets: DataFrame, alerts: DataFrame, connections: DataFrame,
                      as_of: datetime, days: int = 30) -> dict[str, DataFrame]:
    start = as_of - timedelta(days=days)
    if kind == "security_audit":
        return {"security_audit": security_audit(in_range(alerts, start, as_of))}
    if kind == "incident_summary":
        return incident_summary(in_range(alerts, start, as_of))
    if kind == "network_activity":
        return network_activity(in_range(packets, start, as_of),
                                in_range(connections, start, as_of, "first_seen"))
    raise ValueError(f"Unknown report type: {kind}")


# ---- status ----------------------------------------------------------------------------------

def system_rollup(packets: DataFrame, alerts: DataFrame, connections: DataFrame, as_of: datetime) -> DataFrame:
    """Last day and last hour of traffic, open alerts, active connections; one pass per table."""
    c = F.col
    moment = F.lit(as_of).cast("timestamp")
    recent = (c("timestamp") >= moment - F.expr("INTERVAL 1 HOUR"))
    per_source = last_hours(packets, as_of, 24).groupBy("src_ip").agg(
        F.count(F.lit(1)).alias("n"), F.sum(c("size").cast("long")).alias("b"), F.count_if(recent).alias("n1"),
        F.sum(F.when(recent, c("size").cast("long")).otherwise(0)).alias("b1"))
    zero = F.lit(0)
    traffic = per_source.agg(
        F.coalesce(F.sum("n"), zero).alias("packets_24h"), F.coalesce(F.sum("b"), zero).alias("bytes_24h"),
        F.count(F.lit(1)).alias("unique_sources_24h"),
        F.coalesce(F.sum("n1"), zero).alias("packets_1h"), F.coalesce(F.sum("b1"), zero).alias("bytes_1h"),
        F.count_if(c("n1") > 0).alias("unique_sources_1h"))
    open_alerts = alerts.filter(~c("resolved")).agg(
        F.count(F.lit(1)).alias("unresolved_count"),
        F.count_if(c("severity") == "Critical").alias("critical_unresolved"))
    active = connections.agg(F.count_if(
        (c("last_seen") >= moment - F.expr("INTERVAL 5 MINUTES")) & (c("state") == "ACTIVE")).alias("active_count"))
    return side_by_side(traffic, open_alerts, active)
