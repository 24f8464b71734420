"""Packets, alerts and connections made deterministically from an `events` table.

The stored tables of a deployment are read by `sources.tables`; this mapping gives the same tables
over a generic event log (see FIXTURES.md), so that every query can run on it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import from_us
from ..operators.flows import connections_from_flows, flow_sessions

T0_US = 1_704_067_200_000_000
SQUEEZE = 100


EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _events(spark: SparkSession, folder: str, stream: bool = False) -> DataFrame:
    if stream:
        e = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(folder)
    else:
        e = spark.read.schema(EVENTS).parquet(f"{folder}/events.parquet")
    return e.withColumn("ts", F.col("ts").cast("timestamp")).withColumn(
        "k", F.get_json_object("props", "$.k").cast("int"))


def _packets(e: DataFrame, ts) -> DataFrame:
    c = F.col
    turn = c("event_id") % 6
    reply = turn.isin(1, 3)
    icmp = (c("event_type") == "signup") & (c("event_id") % 5 == 0)
    client = F.concat(F.lit("203.0.113."), (c("user_id") % 20).cast("string"))
    server = F.concat(F.lit("192.168.1."), (c("user_id") % 7).cast("string"))
    client_port = (F.lit(40000) + c("user_id") % 5).cast("int")
    server_port = (F.when((c("event_type") == "error") & (c("user_id") % 20 < 4), F.lit(8000) + c("k"))
                   .when(c("event_type") == "signup", 80).when(c("event_type") == "purchase", 443)
                   .when(c("event_type") == "view", 53).when(c("event_type") == "click", 8080)
                   .otherwise(22)).cast("int")
    protocol = F.when(c("event_type") == "view", "UDP").when(icmp, "ICMP").otherwise("TCP")
    flags = F.element_at(F.array(*[F.lit(x) for x in (
        "SYN", "SYN|ACK", "ACK", "PSH|ACK", "FIN|ACK", "RST")]), (turn + 1).cast("int"))
    either = lambda x, y: F.when(reply, y).otherwise(x)
    return e.select(
        c("event_id").alias("id"), ts.alias("timestamp"),
        either(client, server).alias("src_ip"), either(server, client).alias("dst_ip"),
        F.when(~icmp, either(client_port, server_port)).alias("src_port"),
        F.when(~icmp, either(server_port, client_port)).alias("dst_port"),
        protocol.alias("protocol"),
        (F.lit(64) + F.floor(c("value") * 100) % 1437).cast("int").alias("size"),
        F.when(protocol == "TCP", flags).alias("tcp_flags"),
        (F.floor(c("value")) % 400).cast("int").alias("payload_size"))


def packets(spark: SparkSession, folder: str) -> DataFrame:
    """Packets over 30 days, for reports."""
    return _packets(_events(spark, folder), F.col("ts"))


def packets_fast(spark: SparkSession, folder: str, stream: bool = False) -> DataFrame:
    """The same packets squeezed into 7.2 hours, for detectors, flows and features."""
    since = F.unix_micros("ts") - T0_US
    return _packets(_events(spark, folder, stream), from_us(F.floor(since / SQUEEZE) + T0_US))


def alerts(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col
    e = _events(spark, folder).filter(c("event_type") == "error")
    pick = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), (i + 1).cast("int"))
    resolved = c("k") % 3 == 0
    return e.select(
        c("event_id").alias("id"), c("ts").alias("timestamp"),
        pick(("Port Scan", "DDoS Attack", "Suspicious Payload", "Network Anomaly", "Brute Force"),
             c("event_id") % 5).alias("alert_type"),
        pick(("Critical", "High", "High", "Medium", "Medium", "Low", "Low"), c("event_id") % 7).alias("severity"),
        F.concat(F.lit("203.0.113."), (c("user_id") % 20).cast("string")).alias("source_ip"),
        F.when(c("event_id") % 11 != 0, F.concat(F.lit("192.168.1."), (c("user_id") % 7).cast("string")))
        .alias("destination_ip"),
        F.concat(F.lit("sample alert "), c("event_id").cast("string")).alias("description"),
        c("props").alias("details"), resolved.alias("resolved"),
        F.when(resolved, from_us(F.unix_micros("ts") + c("k").cast("long") * 1_800_000_000)).alias("resolved_at"),
        F.when(resolved, F.concat(F.lit("analyst"), (c("user_id") % 3).cast("string"))).alias("resolved_by"))


def connections(spark: SparkSession, folder: str) -> DataFrame:
    return connections_from_flows(flow_sessions(packets_fast(spark, folder)))
