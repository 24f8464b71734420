"""Named queries over a folder of test tables: each operator with fixed parameters.

Moments come out as epoch microseconds and doubles rounded, so that results compare across engines.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import decode, scalars
from ..functions.patterns import PATTERNS
from ..operators import (alerts as al, anomaly, baseline, features, flood, flows, maintenance, payload, rules,
                         scan, search, suppress, traffic)
from ..params import (AlertCriteria, CaptureFilter, ConnectionCriteria, CustomRule, PacketCriteria, Thresholds)
from ..plans import dashboard, pipeline, reports
from ..schema import PACKETS
from ..session import cut, ensure_checkpoint_dir
from ..sources import mapping, sinks, tables
from ..streaming import live, stateful, windows

AS_OF = datetime(2024, 1, 31)
START = datetime(2024, 1, 1)
FAST_AS_OF = datetime(2024, 1, 1, 7, 12)
FAST_START = datetime(2024, 1, 1)
RANGE = (datetime(2024, 1, 10), datetime(2024, 1, 20))

# At these table sizes the default thresholds of 10 ports and 100 packets per second never fire.
TEST = Thresholds(port_scan_threshold=3, ddos_threshold=0.05)

RULES = [
    CustomRule("sql probe", "classic injection", r"or\s+1=1", "regex", "High", True, "tcp", (80, 8080)),
    CustomRule("ssh login", "plain password", "ADMIN:", "string", "Medium", True, "any", ()),
    CustomRule("get bytes", "request line", "47 45 54", "bytes", "Low", True, "TCP", ()),
    CustomRule("bad hex", "never matches", "zz", "bytes", "Low", True, "any", ()),
    CustomRule("switched off", "disabled", ".*", "regex", "Critical", False, "any", ()),
]

Query = Callable[[SparkSession, str], DataFrame]
P, PF, A, C = mapping.packets, mapping.packets_fast, mapping.alerts, mapping.connections

QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def r6(*names: str):
    return {n: F.round(n, 6) for n in names}


def micros(df: DataFrame, *names: str) -> DataFrame:
    """Timestamps as `<name>_us`."""
    for n in names:
        df = df.withColumn(f"{n}_us", F.unix_micros(n)).drop(n)
    return df


def map_text(m):
    entries = F.array_sort(F.map_entries(m))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")


def sections(parts: dict[str, DataFrame], columns: dict[str, tuple[str, str]]) -> DataFrame:
    """Chosen (key, value) columns of several sections stacked under their names."""
    return reduce(lambda a, b: a.unionByName(b), [
        parts[name].select(F.lit(name).alias("section"), F.col(k).cast("string").alias("item"),
                           F.col(v).cast("long").alias("n")) for name, (k, v) in columns.items()])


PACKET_COLUMNS = ["id", "timestamp_us", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "size",
                  "tcp_flags", "payload_size"]
CONNECTION_COLUMNS = ["src_ip", "dst_ip", "src_port", "dst_port", "protocol", "first_seen_us", "last_seen_us",
                      "packet_count", "bytes_sent", "bytes_received", "state", "connection_duration"]
ALERT_COLUMNS = ["id", "timestamp_us", "alert_type", "severity", "source_ip", "destination_ip", "description",
                 "resolved", "resolved_at_us", "resolved_by"]


def packet_rows(df):
    return micros(df, "timestamp").select(*PACKET_COLUMNS)


def connection_rows(df):
    return micros(df, "first_seen", "last_seen").withColumns(r6("connection_duration")).select(*CONNECTION_COLUMNS)


def alert_rows(df):
    return micros(df, "timestamp", "resolved_at").select(*ALERT_COLUMNS)


# ---- sources and searches --------------------------------------------------------------------

@query
def packets_scan(spark, d):
    return packet_rows(P(spark, d))


@query
def alerts_scan(spark, d):
    return alert_rows(A(spark, d))


@query
def connections_scan(spark, d):
    return connection_rows(C(spark, d))


@query
def packet_search(spark, d):
    c = PacketCriteria(protocol="tcp", min_size=200, max_size=1200)
    return packet_rows(search.packet_search(P(spark, d), c, 100))


@query
def packet_search_ports(spark, d):
    c = PacketCriteria(src_ip="203.0.113.3", dst_port=8080, start_time=RANGE[0], end_time=RANGE[1])
    return packet_rows(search.packet_search(P(spark, d), c, None))


@query
def recent_packets(spark, d):
    return packet_rows(search.recent_packets(P(spark, d), AS_OF, 48, 100))


@query
def connection_search(spark, d):
    return connection_rows(search.connection_search(C(spark, d), ConnectionCriteria(min_duration=10), 100))


@query
def connection_analysis(spark, d):
    found = search.connection_search(C(spark, d), ConnectionCriteria(state="SYN_SENT"), 200)
    return search.connection_analysis(found).withColumns({
        **r6("average_duration_seconds"), "protocol_distribution": map_text(F.col("protocol_distribution"))})


@query
def alert_search(spark, d):
    return alert_rows(search.alert_search(A(spark, d), AlertCriteria(severity="High", resolved=False), 100))


@query
def resolved_alerts_large(spark, d):
    """A limit above a thousand, with resolved alerts that have no time of resolution."""
    a = A(spark, d)
    a = a.withColumn("resolved_at", F.when(F.col("id") % 10 != 0, F.col("resolved_at")))
    return alert_rows(search.resolved_alerts(a, 1500))


@query
def alert_view_all(spark, d):
    """Every sort in both directions without a limit; `n` is the place in it."""
    return reduce(lambda a, b: a.unionByName(b), [
        _placed(search.alert_view(A(spark, d), sort=sort, descending=down).select("id")).select(
            F.lit(sort).alias("sort"), F.lit(down).alias("descending"), "id", "n")
        for sort in search.SORT_FIELDS for down in (True, False)])


def _placed(rows):
    """Ordered rows with their place `n`: the place in the partition behind the sizes of all partitions before it."""
    found = cut(rows.withColumn("at", F.monotonically_increasing_id()))
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    before = F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # one row per partition
    sizes = found.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("size")).select(
        "part", F.coalesce(before, F.lit(0)).alias("before"))
    return found.join(F.broadcast(sizes), part == sizes["part"]).withColumn("n", (F.col("before") + place + 1).cast("int"))


@query
def raw_export_packets(spark, d):
    return micros(sinks.raw_export("packets", P(spark, d), AS_OF, 120), "timestamp").select(*PACKET_COLUMNS)


@query
def raw_export_connections(spark, d):
    found = sinks.raw_export("connections", C(spark, d), FAST_AS_OF, 1)
    return found.groupBy("protocol", "state").agg(F.count(F.lit(1)).alias("n"), F.sum("packet_count").alias("packets"))


@query
def alert_view(spark, d):
    return alert_rows(search.alert_view(A(spark, d), "SCAN", sort="severity", limit=50))


@query
def alerts_by_source(spark, d):
    return alert_rows(search.alerts_by_source(A(spark, d), "203.0.113.3", AS_OF, 240))


@query
def alert_listing(spark, d):
    return alert_rows(search.alert_listing(A(spark, d), AS_OF, 50, severity="Critical", resolved=True, hours=480))


@query
def recent_alerts(spark, d):
    return alert_rows(search.recent_alerts(A(spark, d), 50, "Medium"))


@query
def unresolved_alerts(spark, d):
    return alert_rows(search.unresolved_alerts(A(spark, d)))


@query
def resolved_alerts(spark, d):
    return alert_rows(search.resolved_alerts(A(spark, d), 50))


@query
def active_connections(spark, d):
    return connection_rows(search.active_connections(C(spark, d), FAST_AS_OF, minutes=60))


@query
def forensic_all(spark, d):
    found = search.forensic_search(PF(spark, d), C(spark, d), A(spark, d), src_ip="203.0.113.3", limit=1000)
    parts = {"packet": packet_rows(found["packet"]), "connection": connection_rows(found["connection"]),
             "alert": alert_rows(found["alert"])}
    return search.stacked(parts)


@query
def forensic_counts(spark, d):
    found = search.forensic_search(PF(spark, d), C(spark, d), A(spark, d), src_ip="203.0.113.3",
                                   protocol=None, limit=1000)
    return search.match_counts(found)


@query
def capture_filter(spark, d):
    f = CaptureFilter(protocols=("TCP", "udp", "bogus"), excluded_ips=("203.0.113.7",), excluded_ports=(443,))
    return packet_rows(traffic.capture_filter(P(spark, d), f))


@query
def raw_export(spark, d):
    return alert_rows(sinks.raw_export("alerts", A(spark, d), AS_OF, 120))


# ---- decoding and scalars --------------------------------------------------------------------

def _events(spark, d):
    return spark.read.schema(mapping.EVENTS).parquet(f"{d}/events.parquet")


@query
def decode_flags(spark, d):
    return _events(spark, d).select("event_id", decode.tcp_flag_names(
        (F.col("event_id") % 256).cast("int")).alias("flags"))


@query
def decode_protocol(spark, d):
    return _events(spark, d).select("event_id", decode.protocol_name(
        (F.col("event_id") % 60).cast("int")).alias("protocol"))


@query
def decode_packets(spark, d):
    """Records decoded from header columns; some frames are not IP, some carry no known transport."""
    c = F.col
    p = PF(spark, d)
    other = c("id") % 37 == 0
    is_ = lambda name: (c("protocol") == name) & ~other
    headers = p.select(
        "id", "timestamp", F.when(c("id") % 41 != 0, c("src_ip")).alias("src_ip"), "dst_ip",
        (c("id") % 64).cast("int").alias("ttl"),
        F.when(other, 47).when(is_("TCP"), 6).when(is_("UDP"), 17).otherwise(1).alias("proto_num"),
        F.when(is_("TCP"), c("src_port")).alias("tcp_sport"), F.when(is_("TCP"), c("dst_port")).alias("tcp_dport"),
        (c("id") % 256).cast("int").alias("tcp_flag_bits"),
        F.when(is_("UDP"), c("src_port")).alias("udp_sport"), F.when(is_("UDP"), c("dst_port")).alias("udp_dport"),
        F.when(is_("ICMP"), 8).alias("icmp_type"), F.when(is_("ICMP"), 0).alias("icmp_code"),
        c("size").alias("frame_size"), "payload_size")
    return micros(decode.decode_packets(headers), "timestamp")


@query
def packet_ids(spark, d):
    c = F.col
    return P(spark, d).select("id", decode.packet_id(
        c("timestamp"), c("src_ip"), c("dst_ip"), c("src_port"), c("dst_port"), c("protocol")).alias("packet_id"))


@query
def flow_keys(spark, d):
    c = F.col
    return P(spark, d).select(
        "id", decode.flow_key(c("src_ip"), c("src_port"), c("dst_ip"), c("dst_port"), c("protocol")).alias("flow_key"),
        decode.flow_key(c("dst_ip"), c("dst_port"), c("src_ip"), c("src_port"), c("protocol")).alias("reverse_key"))


@query
def datetime_parse(spark, d):
    c = F.col
    ts = c("ts").cast("timestamp")
    kind = c("event_id") % 6
    text = F.when(kind == 0, F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).when(
        kind == 1, F.date_format(ts, "yyyy-MM-dd HH:mm")).when(kind == 2, F.date_format(ts, "yyyy-MM-dd")).when(
        kind == 3, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")).when(
        kind == 4, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.lit("around noon"))
    return _events(spark, d).select("event_id", F.unix_micros(scalars.parse_datetime(text)).alias("parsed_us"))


@query
def alert_ranks(spark, d):
    return A(spark, d).select("id", scalars.severity_rank(F.col("severity")).alias("rank"),
                              scalars.words(F.lower("alert_type")).alias("label"))


@query
def byte_texts(spark, d):
    c = F.col
    t = P(spark, d).groupBy("src_ip").agg(F.sum(c("size").cast("long")).alias("b"), F.count(F.lit(1)).alias("n"))
    return t.select("src_ip", scalars.human_bytes(c("b")).alias("bytes_text"),
                    scalars.short_number(c("n")).alias("packets_text"), scalars.kilobytes(c("b")).alias("kb"))


# ---- traffic ---------------------------------------------------------------------------------

@query
def traffic_totals(spark, d):
    return traffic.traffic_totals(traffic.in_range(P(spark, d), *RANGE))


@query
def traffic_stats_totals(spark, d):
    return dashboard.traffic_stats(P(spark, d), AS_OF, 168)["totals"].withColumns(
        r6("packets_per_hour", "bytes_per_hour"))


@query
def traffic_stats_protocols(spark, d):
    return dashboard.traffic_stats(P(spark, d), AS_OF, 168)["protocol_distribution"]


@query
def traffic_stats_top_sources(spark, d):
    return dashboard.traffic_stats(P(spark, d), AS_OF, 168)["top_sources"]


@query
def system_rollup(spark, d):
    return reports.system_rollup(PF(spark, d), A(spark, d), C(spark, d), FAST_AS_OF)


@query
def top_ports(spark, d):
    return traffic.port_usage(PF(spark, d))


@query
def analyzer_statistics(spark, d):
    live_flows = flows.active_flows(flows.flow_sessions(PF(spark, d)), FAST_AS_OF)
    return traffic.analyzer_statistics(PF(spark, d), live_flows)


@query
def talker_share(spark, d):
    return traffic.talker_share(P(spark, d)).withColumns(r6("share"))


@query
def talkers(spark, d):
    return dashboard.talkers(P(spark, d), AS_OF, 240).withColumns(r6("share"))


@query
def trend_analysis(spark, d):
    """The bundle of trends over ten days by day: every figure of all sections as (section, moment, item, value)."""
    c = F.col
    t = reports.trend_analysis(P(spark, d), A(spark, d), AS_OF, 10, "day")

    def figures(section, at, *items):
        return t[section].select(F.lit(section).alias("section"), F.unix_micros(at).alias("at_us"), F.explode(F.array(*[
            F.struct(item.alias("item"), value.cast("double").alias("value")) for item, value in items])).alias("x")).select(
            "section", "at_us", "x.*")

    at, none = c("bucket"), F.lit(0).cast("timestamp")
    each = lambda *names: [(F.lit(n), c(n)) for n in names]
    return reduce(lambda a, b: a.unionByName(b), [
        figures("traffic_trends", at, *each("packet_count", "total_bytes")),
        figures("protocol_trends", at, (c("protocol"), c("packet_count"))),
        figures("alert_trends", at, *each("Low", "Medium", "High", "Critical")),
        figures("threat_evolution", at, (c("alert_type"), c("threat_count"))),
        figures("top_talkers_trends", c("period_start"), *[
            (F.concat_ws(" ", c("rank").cast("string"), c("src_ip"), F.lit(n)), c(n)) for n in ("packet_count", "total_bytes")]),
        figures("summary", none, *each("average_packets_per_period", "peak_traffic_packets", "average_alerts_per_period",
                                       "peak_alerts"))])


@query
def stat_cards(spark, d):
    return dashboard.stat_cards(P(spark, d), A(spark, d), C(spark, d), AS_OF)


@query
def chart_points(spark, d):
    return micros(dashboard.chart_points(P(spark, d)), "bucket")


# ---- alerts and reports ----------------------------------------------------------------------

@query
def alert_grouping_sets(spark, d):
    return reports.alert_grouping_sets(traffic.in_range(A(spark, d), START, AS_OF))


@query
def alert_statistics(spark, d):
    s = reports.alert_statistics(A(spark, d), AS_OF, 168)
    s["total"] = s["total"].withColumn("all", F.lit("all"))
    return sections(s, {"total": ("all", "total_alerts"), "severity_distribution": ("severity", "alert_count"),
                        "type_distribution": ("alert_type", "alert_count"),
                        "top_source_ips": ("source_ip", "alert_count")})


@query
def distinct_alert_types(spark, d):
    return A(spark, d).select("alert_type").distinct()


@query
def top_threats(spark, d):
    return reports.top_threats(A(spark, d))


@query
def traffic_trend_hour(spark, d):
    return micros(reports.traffic_trend(P(spark, d), "hour"), "bucket")


@query
def traffic_trend_day(spark, d):
    return micros(reports.traffic_trend(P(spark, d), "day"), "bucket")


@query
def alert_trend_pivot(spark, d):
    return micros(reports.alert_trend(A(spark, d), "day"), "bucket")


@query
def protocol_trend(spark, d):
    return micros(reports.protocol_trend(P(spark, d), "day"), "bucket")


@query
def protocol_trend_maps(spark, d):
    t = reports.as_maps(reports.protocol_trend(P(spark, d), "day"), "protocol", "packet_count")
    return micros(t, "bucket").withColumn("counts", map_text(F.col("counts")))


@query
def threat_evolution(spark, d):
    return micros(reports.threat_evolution(A(spark, d), "day"), "bucket")


@query
def talkers_by_period(spark, d):
    return micros(reports.talkers_by_period(P(spark, d), datetime(2024, 1, 24), AS_OF), "period_start", "period_end")


@query
def trend_summary(spark, d):
    t = reports.trend_summary(reports.traffic_trend(P(spark, d), "day"), reports.alert_trend(A(spark, d), "day"))
    return t


@query
def risk_score(spark, d):
    c = F.col
    p, a = P(spark, d), A(spark, d)
    # per source, so that the whole range of the score is exercised
    by_source = a.groupBy("source_ip").agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(c("severity") == s).alias(s.lower())
                                            for s in ("Critical", "High", "Medium")])
    packets = p.groupBy(c("src_ip").alias("source_ip")).agg((F.count(F.lit(1)) * 1000).alias("packets"))
    score = reports.risk(c("packets"), c("total"), c("critical"), c("high"), c("medium"))
    return by_source.join(packets, "source_ip").select("source_ip", F.round(score, 6).alias("risk"))


@query
def security_summary_flat(spark, d):
    s = reports.security_summary(P(spark, d), A(spark, d), C(spark, d), START, AS_OF)
    s["connection_summary"] = s["connection_summary"].withColumn(
        "avg_duration_seconds", F.round("avg_duration_seconds", 3).cast("decimal(18,3)"))
    s["summary"] = s["summary"].withColumn("risk_score", F.col("risk_score").cast("decimal(18,2)"))
    return reports.flat_summary(s)


@query
def security_audit(spark, d):
    t = reports.compliance_report("security_audit", P(spark, d), A(spark, d), C(spark, d), AS_OF)["security_audit"]
    return t.drop("recommendations", "average_response_time_hours").withColumns(
        r6("resolution_rate", "average_response_hours_exact", "fastest_response_hours", "slowest_response_hours"))


@query
def audit_recommendations(spark, d):
    return reports.security_audit(A(spark, d)).select(F.posexplode("recommendations").alias("position", "advice"))


@query
def incident_breakdown(spark, d):
    t = reports.compliance_report("incident_summary", P(spark, d), A(spark, d), C(spark, d), AS_OF)
    return t["incident_breakdown"].withColumn("severities", map_text(F.col("severities")))


@query
def incident_summary(spark, d):
    t = reports.incident_summary(A(spark, d))
    t["total"] = t["total"].withColumn("all", F.lit("all"))
    return sections(t, {"total": ("all", "total_incidents"), "incident_breakdown": ("alert_type", "incident_count"),
                        "top_incident_sources": ("source_ip", "alert_count"),
                        "severity_distribution": ("severity", "alert_count")})


@query
def network_activity(spark, d):
    t = reports.compliance_report("network_activity", PF(spark, d), A(spark, d), C(spark, d), FAST_AS_OF, 1)
    return traffic.side_by_side(t["traffic_summary"], t["connection_analysis"].drop(
        "average_connection_duration").withColumns(r6("average_duration_exact")))


# ---- flows -----------------------------------------------------------------------------------

@query
def flow_sessions(spark, d):
    return connection_rows(flows.flow_sessions(PF(spark, d)))


@query
def tcp_states(spark, d):
    return flows.flow_sessions(PF(spark, d)).groupBy("protocol", "state").agg(
        F.count(F.lit(1)).alias("flows"), F.sum("packet_count").alias("packets"))


@query
def directed_connections(spark, d):
    t = micros(flows.directed_connections(PF(spark, d)), "first_seen", "last_seen")
    return t.withColumns(r6("avg_packet_size", "connection_duration"))


@query
def merged_connections(spark, d):
    """The first half of the day stored, the second half merged into it."""
    p, noon = PF(spark, d), F.lit(datetime(2024, 1, 1, 3, 36)).cast("timestamp")
    old = flows.directed_connections(p.filter(F.col("timestamp") < noon))
    new = flows.directed_connections(p.filter(F.col("timestamp") >= noon))
    return micros(flows.merge_connections(old, new), "first_seen", "last_seen").withColumns(
        r6("avg_packet_size", "connection_duration"))


@query
def active_flows(spark, d):
    return connection_rows(flows.active_flows(flows.flow_sessions(PF(spark, d)), FAST_AS_OF))


def _pairs_text(t):
    t = micros(t, "first_seen", "last_seen")
    return t.withColumns({**r6("duration"), "protocols": F.array_join("protocols", ","),
                          "ports": F.array_join(F.col("ports").cast("array<string>"), ",")})


@query
def host_pair_summary(spark, d):
    return _pairs_text(flows.host_pairs(flows.flow_sessions(PF(spark, d))))


@query
def flow_summary(spark, d):
    return _pairs_text(flows.flow_summary(flows.flow_sessions(PF(spark, d)), "203.0.113.3", "192.168.1.2"))


@query
def top_talkers_both_ends(spark, d):
    return flows.top_talkers(flows.flow_sessions(PF(spark, d)))


# ---- detectors -------------------------------------------------------------------------------

@query
def scan_sessions(spark, d):
    return scan.scan_sessions(PF(spark, d), TEST).withColumns(r6("duration", "rate"))


@query
def scan_candidates(spark, d):
    return scan.scan_candidates(PF(spark, d), TEST).withColumns(r6("duration", "rate"))


DETAILS = {
    "scan": "scanned_ports array<int>, target_ips array<string>, scan_count long, failed_connections long, "
            "scan_duration double, scan_rate double",
    "flood": "connection_rate double, total_connections long, bytes_sent long, target_count long, "
             "target_ips array<string>, attack_duration double",
    "rule": "rule_name string, rule_description string, pattern_type string, matched_pattern string, target_port long, "
            "protocol string, payload_size long",
    "payload": "pattern_category string, target_port long, protocol string, payload_size long, matched_pattern string"}


def _with_details(t, kind):
    """Alerts with all their details as columns: lists as text, doubles rounded."""
    found = []
    for field in DETAILS[kind].split(", "):
        name, of = field.split(" ")
        value = F.col("j")[name]
        if of.startswith("array"):
            value = F.array_join(value.cast("array<string>"), ",")
        found.append((F.round(value, 6) if of == "double" else value).alias(name))
    return t.withColumn("j", F.from_json("details", DETAILS[kind])).select(
        "packet_id", "us", "alert_type", "severity", "source_ip", "destination_ip", "description", *found)


@query
def scan_alerts(spark, d):
    return _with_details(scan.scan_alerts(PF(spark, d), TEST), "scan")


@query
def flood_rate(spark, d):
    return flood.flood_progress(PF(spark, d), TEST).withColumns(r6("duration", "rate", "bytes_per_second"))


@query
def flood_candidates(spark, d):
    return flood.flood_candidates(PF(spark, d), TEST).select(
        "id", "us", "src_ip", "in_window", "packets", "bytes", "targets", "severity",
        F.round("rate", 6).alias("rate"))


@query
def flood_alerts(spark, d):
    return _with_details(flood.flood_alerts(PF(spark, d), TEST), "flood")


@query
def active_threats(spark, d):
    t = pipeline.active_threats(PF(spark, d), FAST_AS_OF, TEST)
    s, f = t["active_port_scans"], t["active_ddos_attacks"]
    s = s.select(F.lit("scan").alias("kind"), "source_ip", F.col("ports_scanned").alias("ports"), "targets",
                 F.col("scan_count").alias("packets"), F.lit(0).cast("long").alias("bytes"),
                 F.lit(0.0).alias("rate"), F.round("duration", 6).alias("duration"))
    f = f.select(F.lit("flood").alias("kind"), "source_ip", F.lit(0).cast("long").alias("ports"),
                 F.col("target_count").alias("targets"), F.col("total_connections").alias("packets"),
                 F.col("bytes_sent").alias("bytes"), F.round("connection_rate", 6).alias("rate"),
                 F.round("duration", 6).alias("duration"))
    return s.unionByName(f)


@query
def payload_matches(spark, d):
    return payload.payload_matches(PF(spark, d)).select(
        "id", "us", "src_ip", "dst_ip", "dst_port", "protocol", "payload_size",
        F.array_join("matches.category", ",").alias("categories"), F.array_join("matches.severity", ",").alias("severities"),
        F.size("matches.pattern").alias("patterns"))


@query
def payload_alerts(spark, d):
    return _with_details(payload.payload_alerts(PF(spark, d), TEST), "payload")


@query
def html_pattern_scan(spark, d):
    t = spark.read.parquet(f"{d}/pages.parquet")
    return payload.text_matches(t, "page_id", "html").select("page_id", "category", "severity")


@query
def document_pattern_scan(spark, d):
    """Rows of documents and pages by category, categories without any included."""
    def scanned(name, key, text):
        found = payload.text_matches(spark.read.parquet(f"{d}/{name}.parquet"), key, text)
        counts = found.groupBy("category").agg(F.count(F.lit(1)).alias("found"), F.sum(key).alias("ids"))
        every = spark.createDataFrame([(x,) for x in PATTERNS], "category string")
        return every.join(counts, "category", "left").select(
            F.lit(name).alias("searched"), "category", F.coalesce("found", F.lit(0)).alias("found"),
            F.coalesce("ids", F.lit(0)).alias("ids"))

    return scanned("documents", "doc_id", "text").unionByName(scanned("pages", "page_id", "html"))


@query
def custom_rule_matches(spark, d):
    return rules.rule_matches(PF(spark, d), RULES).select(
        "id", "us", "src_ip", "dst_ip", "dst_port", "rule_name", "severity")


@query
def custom_rule_alerts(spark, d):
    return _with_details(rules.rule_alerts(PF(spark, d), RULES, TEST), "rule")


@query
def rule_errors(spark, d):
    """Rules made from the benchmark texts, some of them faulty."""
    c = F.col
    t = spark.read.parquet(f"{d}/benchmark.parquet").select(
        F.when(c("item_id") % 5 == 0, "").when(c("item_id") % 5 == 1, "twin").otherwise(
            F.concat(F.lit("rule "), c("item_id").cast("string"))).alias("name"),
        c("text").alias("description"), F.when(c("item_id") % 8 == 0, "(?P<x>a)").when(
            c("item_id") % 7 != 0, c("text")).alias("pattern"),
        F.when(c("item_id") % 8 == 0, "regex").when(c("item_id") % 3 == 0, "glob").otherwise("string").alias(
            "pattern_type"),
        F.when(c("item_id") % 4 == 0, "severe").otherwise("High").alias("severity"),
        F.when(c("item_id") % 6 == 0, "sctp").otherwise("TCP").alias("protocol"))
    return rules.rule_errors(t).groupBy("name", F.array_join("errors", "; ").alias("errors")).agg(
        F.count(F.lit(1)).alias("n"))


@query
def custom_rules_many(spark, d):
    """Three hundred literal rules, the numbers below 300; the regex of one does not compile."""
    t = spark.range(300).select(
        F.concat(F.lit("rule "), F.col("id").cast("string")).alias("name"), F.lit("a number").alias("description"),
        F.when(F.col("id") == 7, "(?P<x>7)").otherwise(F.col("id").cast("string")).alias("pattern"),
        F.when(F.col("id") == 7, "regex").otherwise("string").alias("pattern_type"), F.lit("Low").alias("severity"),
        F.lit(True).alias("enabled"), F.lit("any").alias("protocol"), F.lit(None).cast("array<int>").alias("ports"))
    found = rules.rule_matches(PF(spark, d), tables.rules_from_table(t))
    return found.groupBy("rule_name").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("src_ip").alias("sources"))


@query
def alerts_cooled(spark, d):
    """A five-minute cooldown per source over all squeezed packets."""
    p = PF(spark, d).select("id", F.unix_micros("timestamp").alias("us"), "src_ip")
    return suppress.thin(p, ["src_ip"], 300)


@query
def alerts_cooled_hot(spark, d):
    """The same over every packet as one key, by pointer jumping."""
    p = PF(spark, d).select("id", F.unix_micros("timestamp").alias("us"), F.lit("all").alias("key"))
    return suppress.thin(p, ["key"], 60)


@query
def alerts_deduped(spark, d):
    a = A(spark, d).select(
        F.col("id").alias("seq"), F.unix_micros("timestamp").alias("us"), "alert_type", "source_ip",
        "destination_ip")
    return al.deduplicate(a, 12 * 3600)


@query
def pipeline_alerts(spark, d):
    t = pipeline.run(PF(spark, d), TEST, RULES)
    return t.stored.select("packet_id", "us", "detector", "alert_type", "severity", "source_ip", "destination_ip",
                           "description")


@query
def pipeline_alert_ids(spark, d):
    """Stored alerts and their ids, with two rules that fire on the same packets."""
    twice = [*RULES, CustomRule("get again", "request line", "get", "string", "Low", True, "any", ())]
    stored = al.to_table(pipeline.run(PF(spark, d), TEST, twice).stored)
    return stored.agg((F.count_distinct("id") == F.count(F.lit(1))).alias("unique"), (F.count(F.lit(1)) > 0).alias("any"))


@query
def pipeline_statistics(spark, d):
    return pipeline.statistics(pipeline.run(PF(spark, d), TEST, RULES)).withColumns(r6("detection_rate"))


@query
def alert_log(spark, d):
    return al.log_lines(payload.payload_alerts(PF(spark, d), TEST))


# ---- anomalies -------------------------------------------------------------------------------

@query
def traffic_features(spark, d):
    t = features.features(PF(spark, d)).drop("timestamp")
    return t.withColumns(r6("packets_per_second", "bytes_per_second"))


@query
def feature_vectors(spark, d):
    t = features.features(PF(spark, d))
    cols = [F.round(c.cast("double"), 3).alias(n) for n, c in features.feature_columns().items()]
    return t.select("id", *cols)


@query
def baseline_scalars(spark, d):
    return baseline.baseline_scalars(P(spark, d)).withColumns(
        r6("avg_packet_size", "std_packet_size", "weekday_avg_traffic", "weekend_avg_traffic"))


@query
def baseline_protocols(spark, d):
    return baseline.baseline_protocols(P(spark, d)).withColumns(r6("frequency"))


@query
def baseline_ports(spark, d):
    return baseline.baseline_ports(P(spark, d)).withColumns(r6("frequency"))


@query
def baseline_hours(spark, d):
    return baseline.baseline_hours(P(spark, d)).withColumns(r6("frequency"))


@query
def baseline_compare(spark, d):
    p = P(spark, d)
    t = baseline.compare(features.features(PF(spark, d)), baseline.learn(p))
    return t.select("id", "is_rare_protocol", "is_rare_port", "is_unusual_time", *[
        F.round(n, 6).alias(n) for n in ("packet_size_deviation", "protocol_frequency", "port_frequency",
                                         "hourly_frequency")])


OPEN_GATE = Thresholds(anomaly_threshold=0.0, min_baseline_samples=500)


def _scored(spark, d):
    f = features.features(PF(spark, d))
    return anomaly.score(f, anomaly.fit(f, OPEN_GATE))


@query
def anomaly_scores(spark, d):
    return _scored(spark, d).select("id", "us", "src_ip", "score").withColumns(r6("score"))


def _alert_figures(rows):
    """Anomaly alerts with the figures of the packet in their details."""
    get = lambda path: F.get_json_object("details", f"$.{path}")
    return rows.select(
        "packet_id", "us", "alert_type", "severity", "source_ip", "destination_ip", "description",
        F.round(get("anomaly_score").cast("double"), 6).alias("score"), get("packet_size").cast("long").alias("packet_size"),
        get("dst_port").cast("long").alias("dst_port"),
        F.round(get("packets_per_second").cast("double"), 6).alias("packets_per_second"),
        F.round(get("baseline_comparison.protocol_frequency").cast("double"), 6).alias("protocol_frequency"))


@query
def anomaly_alerts(spark, d):
    rows = anomaly.anomaly_alerts(_scored(spark, d), baseline.learn(PF(spark, d)), OPEN_GATE)
    return _alert_figures(rows).drop("description")


@query
def anomaly_feed(spark, d):
    found = anomaly.anomalies(_scored(spark, d), OPEN_GATE)
    marks = found.filter(F.col("id") % 2 == 0).select("timestamp", F.col("src_ip").alias("source_ip"))
    marked = anomaly.mark_false_positives(found, marks)
    newest = micros(anomaly.recent_anomalies(marked.filter(~F.col("false_positive"))), "timestamp")
    return newest.drop("description").withColumns(r6("anomaly_score"))


@query
def anomaly_statistics(spark, d):
    return anomaly.anomaly_statistics(_scored(spark, d), OPEN_GATE).withColumns(
        r6("score_mean", "score_std", "score_min", "score_max", "detection_rate"))


@query
def score_quantiles(spark, d):
    """Exact quantiles of given scores, as the offset is taken."""
    c = F.col
    rows = cut(features.features(PF(spark, d)).select(
        (c("packets_per_second") * 1000 + c("packet_size") / F.lit(7.0)).alias("s")))
    shares = [0.0, 0.1, 0.37, 0.5, 0.9, 1.0]
    return spark.createDataFrame([(q, round(anomaly.quantile(rows, "s", q), 9)) for q in shares], "share double, value double")


def _marked_scores(spark, d):
    """Features with a score that SQL can make as well: what follows the model is then exact."""
    c = F.col
    return features.features(PF(spark, d)).withColumn("score", -((c("id") * 37) % 100).cast("double") / 100)


@query
def anomaly_found(spark, d):
    return anomaly.anomalies(_marked_scores(spark, d)).select("id", "us", "src_ip", "severity")


@query
def anomaly_marked_feed(spark, d):
    found = anomaly.anomalies(_marked_scores(spark, d))
    marks = found.filter(F.col("id") % 2 == 0).select("timestamp", F.col("src_ip").alias("source_ip"))
    open_ = anomaly.mark_false_positives(found, marks).filter(~F.col("false_positive"))
    return micros(anomaly.recent_anomalies(open_, 200), "timestamp")


@query
def anomaly_totals(spark, d):
    return anomaly.anomaly_statistics(_marked_scores(spark, d)).withColumns(
        r6("score_mean", "score_std", "score_min", "score_max", "detection_rate"))


@query
def anomaly_alert_details(spark, d):
    """Alerts of given scores, with the figures of the packet in their details."""
    return _alert_figures(anomaly.anomaly_alerts(_marked_scores(spark, d), baseline.learn(PF(spark, d))))


# ---- maintenance -----------------------------------------------------------------------------

@query
def retention(spark, d):
    cut_at = AS_OF
    doomed = {"packets": (P(spark, d), maintenance.old_packets(cut_at, 10)),
              "alerts": (A(spark, d), maintenance.old_resolved_alerts(cut_at, 10)),
              "all_alerts": (A(spark, d), maintenance.old_alerts(cut_at, 10)),
              "connections": (maintenance.time_out_connections(C(spark, d), cut_at, 24),
                              maintenance.old_closed_connections(cut_at, 10))}
    return maintenance.deletion_counts(doomed)


@query
def retention_kept(spark, d):
    return alert_rows(maintenance.split(A(spark, d), maintenance.old_resolved_alerts(AS_OF, 10)).kept)


@query
def retention_applied(spark, d):
    """Packets written by day, ten days kept, read back; most days expire completely."""
    path = f"{ensure_checkpoint_dir(spark)}/retention/{uuid.uuid4().hex}"
    sinks.append_packets(P(spark, d), path)
    old = maintenance.split(tables.read_packets(spark, path), maintenance.old_packets(AS_OF, 10))
    sinks.rewrite_kept(old.kept, old.dropped, path)
    return tables.read_packets(spark, path).groupBy(F.date_format("timestamp", "yyyy-MM-dd").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


@query
def timeout_connections(spark, d):
    t = maintenance.time_out_connections(C(spark, d), FAST_AS_OF, 2)
    return t.groupBy("state").agg(F.count(F.lit(1)).alias("connections"))


@query
def resolve_alerts(spark, d):
    """Every third open alert resolved, some of them twice: the newest resolution counts."""
    a = A(spark, d)
    c = F.col
    open_ = a.filter(~c("resolved") & (c("id") % 3 == 0))
    first = open_.select(c("id").alias("alert_id"), (c("timestamp") + F.expr("INTERVAL 1 HOUR")).alias("resolved_at"),
                         F.lit("first").alias("resolved_by"))
    second = open_.filter(c("id") % 2 == 0).select(
        c("id").alias("alert_id"), (c("timestamp") + F.expr("INTERVAL 2 HOURS")).alias("resolved_at"),
        F.lit("second").alias("resolved_by"))
    return alert_rows(maintenance.resolve_alerts(a, first.unionByName(second)))


@query
def purge_like(spark, d):
    c = F.col
    a = A(spark, d).withColumn("description", F.when(c("id") % 4 == 0, F.concat(F.lit("demo "), c("description")))
                               .otherwise(c("description")))
    doomed = {"alerts": (a, maintenance.sample_alert()),
              "alert_hosts": (a, maintenance.sample_address("source_ip", "destination_ip")),
              "packets": (P(spark, d), maintenance.sample_address())}
    return maintenance.deletion_counts(doomed)


@query
def row_counts(spark, d):
    return maintenance.row_counts({"packets": P(spark, d), "alerts": A(spark, d), "connections": C(spark, d)})


# ---- streams ---------------------------------------------------------------------------------

def _stream(spark, d):
    stateful.use_rocksdb(spark)
    return PF(spark, d, stream=True)


_ARRIVALS: dict[tuple[str, str], str] = {}
ARRIVAL_FILES = 4


def _arriving(spark, d):
    """The squeezed packets as they may arrive: four parts of `ARRIVAL_FILES` files, rows up to nine minutes out of order,
    and last two packets of two days later, behind which everything is due. No detector and no rule looks at these."""
    stateful.use_rocksdb(spark)
    at = (spark.sparkContext.applicationId, d)
    if at not in _ARRIVALS:
        path = f"{ensure_checkpoint_dir(spark)}/arrivals/{uuid.uuid4().hex}"
        arrival = F.unix_micros("timestamp") + F.pmod(F.xxhash64("id"), F.lit(540)) * 1_000_000
        rows = sinks.conform(PF(spark, d), PACKETS).withColumn("part", F.least(F.lit(3), F.floor(
            (arrival - mapping.T0_US) / (2 * 3600 * 1_000_000))))
        late = sinks.conform(PF(spark, d).orderBy("id").limit(2).withColumns({
            "timestamp": F.lit(FAST_AS_OF) + F.expr("INTERVAL 2 DAYS"), "src_ip": F.lit("198.51.100.1"),
            "protocol": F.lit("UDP"), "tcp_flags": F.lit(None).cast("string"), "payload_size": F.lit(0),
            "dst_port": F.lit(9)}), PACKETS)
        parted = f"{ensure_checkpoint_dir(spark)}/arrivals/{uuid.uuid4().hex}"
        rows.write.partitionBy("part").parquet(parted)  # the packets are made once for all parts
        there = spark.read.schema(T.StructType([*PACKETS, T.StructField("part", T.LongType())])).parquet(parted)
        for part in [there.filter(F.col("part") == i).drop("part") for i in range(4)] + [late]:
            part.repartition(ARRIVAL_FILES).write.mode("append").parquet(path)
        _ARRIVALS[at] = path
    return tables.stream_packets(spark, _ARRIVALS[at], files_per_trigger=ARRIVAL_FILES)


@query
def stream_trend(spark, d):
    return micros(live.run_to_end(windows.stream_trend(_stream(spark, d)), "complete"), "bucket")


@query
def stream_rate(spark, d):
    t = live.run_to_end(windows.stream_rate(_stream(spark, d), TEST), "complete")
    return micros(t, "window_start").withColumns(r6("rate"))


@query
def stream_flows(spark, d):
    return micros(live.run_to_end(windows.stream_flows(_stream(spark, d))), "first_seen", "last_seen")


@query
def stream_flow_states(spark, d):
    return live.run_to_end(stateful.stream_flow_states(_arriving(spark, d), TEST))


@query
def stream_scan_sessions(spark, d):
    return live.run_to_end(stateful.stream_scan_sessions(_arriving(spark, d), TEST))


@query
def stream_scan_alerts(spark, d):
    return _with_details(live.run_to_end(stateful.stream_scan_records(_arriving(spark, d), TEST)), "scan")


@query
def stream_dedup(spark, d):
    matches = stateful.stream_payload_matches(_arriving(spark, d)).select("us", "id", "src_ip", "timestamp")
    return live.run_to_end(stateful.stream_suppress(matches, ["src_ip"], 600, inclusive=True))


@query
def stream_features(spark, d):
    found = live.run_to_end(stateful.stream_features(_arriving(spark, d)))
    return found.drop("timestamp").withColumns(
        r6("packets_per_second", "bytes_per_second"))


@query
def stream_flood_alerts(spark, d):
    return _with_details(live.run_to_end(stateful.stream_flood_alerts(_arriving(spark, d), TEST)), "flood")


@query
def stream_payload_alerts(spark, d):
    return live.run_to_end(stateful.stream_payload_alerts(_arriving(spark, d))).select(
        "packet_id", "us", "alert_type", "severity", "source_ip", "destination_ip", "description", "details")


_LIVE: dict[tuple[str, str], str] = {}


def _live(spark, d):
    """The folder of a live loop that has taken all packets, out of order: stored packets, flows and alerts, with a
    published model and the live feed."""
    at = (spark.sparkContext.applicationId, d)
    if at not in _LIVE:
        folder = f"{ensure_checkpoint_dir(spark)}/live/{uuid.uuid4().hex}"
        now, rows = {"availableNow": True}, features.features(PF(spark, d))
        live.publish_model(spark, f"{folder}/models", anomaly.fit(rows, OPEN_GATE), baseline.learn(PF(spark, d)))
        arriving = _arriving(spark, d)
        started = live.run_pipeline(arriving, folder, replace(TEST, anomaly_threshold=0.0), RULES, now, f"{folder}/models")
        started["feed"] = live.live_feed(arriving, f"{folder}/view", f"{folder}/feed", f"{folder}/state/feed", now)
        for query_ in started.values():
            query_.awaitTermination()
        _LIVE[at] = folder
    return _LIVE[at]


@query
def stream_pipeline_alerts(spark, d):
    """What the live loop has stored of all detectors in the end."""
    return spark.read.parquet(f"{_live(spark, d)}/alerts").filter("stream = 'detectors'").select(
        "packet_id", "us", "detector", "alert_type", "severity", "source_ip", "destination_ip", "description")


@query
def stream_anomaly_alerts(spark, d):
    """What the live loop has stored of the published model's anomalies."""
    stored = spark.read.parquet(f"{_live(spark, d)}/alerts").filter("stream = 'anomalies'")
    return _alert_figures(stored).drop("description")


@query
def live_feed_figures(spark, d):
    """One refresh of the live feed as of the newest packet of the table."""
    newest = PF(spark, d).agg(F.max(F.unix_micros("timestamp"))).first()[0]
    return live.live_view(spark, f"{_live(spark, d)}/view", newest)["traffic"]


@query
def stream_rule_matches(spark, d):
    return live.run_to_end(rules.rule_matches(_stream(spark, d), RULES)).select("id", "src_ip", "rule_name")
