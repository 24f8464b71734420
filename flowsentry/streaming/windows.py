"""Windowed aggregates over packet streams, on event time with a watermark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import from_us
from ..operators.flows import FLOW, canonical
from ..params import Thresholds

LATENESS = "10 minutes"


def on_time(packets: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Packets with the event-time watermark; rows later than `lateness` are dropped and counted. A stream that has
    its watermark keeps it, so that all that is made of one stream goes by one watermark."""
    return packets if watermarked(packets) else packets.withWatermark("timestamp", lateness)


def watermarked(df: DataFrame) -> bool:
    """Whether `timestamp` carries a watermark."""
    return any(f.name == "timestamp" and "spark.watermarkDelayMs" in f.metadata for f in df.schema)


def only(timed: DataFrame, condition: Column) -> DataFrame:
    """The rows of a stream for which `condition` holds, filtered above the watermark: a filter that does not read
    the event time would be moved below it, and then only the rows it keeps would move the watermark on."""
    return timed.filter(F.when(F.col("timestamp").isNotNull(), condition).otherwise(F.lit(False)))


def stream_flows(packets: DataFrame, p: Thresholds = Thresholds(), lateness: str = LATENESS) -> DataFrame:
    """Flow sessions once they are closed, without the TCP state (see stateful.FlowStates for that).

    Sessions are merged per task before the shuffle, so a long flow arrives pre-aggregated.
    """
    c = F.col
    rows = canonical(on_time(packets, lateness), "timestamp")
    order = F.struct("us", "id")
    s = rows.groupBy(
        *FLOW, F.session_window("timestamp", f"{p.connection_timeout} seconds").alias("w")).agg(
        F.min_by("fwd", order).alias("fwd"), F.min("us").alias("first_us"), F.max("us").alias("last_us"),
        F.count(F.lit(1)).alias("packet_count"),
        F.sum(F.when(c("fwd"), c("size")).otherwise(0)).alias("bytes_fwd"),
        F.sum(F.when(c("fwd"), 0).otherwise(c("size"))).alias("bytes_rev"))
    port = lambda x, y: F.nullif(F.when(c("fwd"), c(x)).otherwise(c(y)), F.lit(-1))
    return s.select(
        F.when(c("fwd"), c("ip_a")).otherwise(c("ip_b")).alias("src_ip"),
        F.when(c("fwd"), c("ip_b")).otherwise(c("ip_a")).alias("dst_ip"),
        port("port_a", "port_b").alias("src_port"), port("port_b", "port_a").alias("dst_port"), "protocol",
        from_us(c("first_us")).alias("first_seen"), from_us(c("last_us")).alias("last_seen"), "packet_count",
        F.when(c("fwd"), c("bytes_fwd")).otherwise(c("bytes_rev")).alias("bytes_sent"),
        F.when(c("fwd"), c("bytes_rev")).otherwise(c("bytes_fwd")).alias("bytes_received"))


def stream_rate(packets: DataFrame, p: Thresholds = Thresholds(), slide_seconds: int = 10,
                lateness: str = LATENESS) -> DataFrame:
    """Packets per source over sliding windows; counts are combined before the shuffle."""
    width = p.ddos_time_window
    return on_time(packets, lateness).groupBy(
        "src_ip", F.window("timestamp", f"{width} seconds", f"{slide_seconds} seconds").alias("w")).agg(
        F.count(F.lit(1)).alias("packets"), F.sum(F.col("size").cast("long")).alias("bytes")).select(
        "src_ip", F.col("w.start").alias("window_start"), "packets", "bytes",
        (F.col("packets") / F.lit(float(width))).alias("rate"))


def stream_trend(packets: DataFrame, width: str = "1 hour", lateness: str = LATENESS) -> DataFrame:
    """Traffic per tumbling window."""
    return on_time(packets, lateness).groupBy(F.window("timestamp", width).alias("w")).agg(
        F.count(F.lit(1)).alias("packet_count"), F.sum(F.col("size").cast("long")).alias("total_bytes")).select(
        F.col("w.start").alias("bucket"), "packet_count", "total_bytes")


def stream_alert_trend(alerts: DataFrame, width: str = "1 hour", lateness: str = LATENESS) -> DataFrame:
    """Alerts per tumbling window and severity."""
    return alerts.withWatermark("timestamp", lateness).groupBy(
        F.window("timestamp", width).alias("w"), "severity").agg(F.count(F.lit(1)).alias("alert_count")).select(
        F.col("w.start").alias("bucket"), "severity", "alert_count")
