"""Traffic totals, distributions, top lists."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import human_bytes


def side_by_side(*rows: DataFrame) -> DataFrame:
    """One-row tables with different columns as one row, without a join."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    return stacked.agg(*[F.first(c, ignorenulls=True).alias(c) for c in stacked.columns])


def since(as_of: datetime, hours: float) -> Column:
    """The moment `hours` before `as_of`, folded to a literal so that the scan can use it."""
    return F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {float(hours) * 3600:.0f} SECONDS")


def last_hours(df: DataFrame, as_of: datetime, hours: float, ts: str = "timestamp") -> DataFrame:
    begin = since(as_of, hours)
    return _on_days(df, ts, begin).filter(F.col(ts) >= begin)


def in_range(df: DataFrame, start: datetime, end: datetime, ts: str = "timestamp") -> DataFrame:
    """Closed range."""
    first, last = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    return _on_days(df, ts, first, last).filter(F.col(ts).between(first, last))


def _on_days(df: DataFrame, ts: str, first: Column, last: Column | None = None) -> DataFrame:
    """The date partitions that a time range can touch, where `df` has the day of `ts` as a column."""
    if "date" not in df.columns or ts != "timestamp":
        return df
    df = df.filter(F.col("date") >= F.to_date(first))
    return df if last is None else df.filter(F.col("date") <= F.to_date(last))


def traffic_totals(packets: DataFrame, approximate: bool = False) -> DataFrame:
    """Packets, bytes, distinct sources and destinations as one row.

    Packets are first summed per host pair, so the two distinct counts work on pairs and not on
    packets. `approximate` replaces them by sketches of fixed size.
    """
    if approximate:
        return packets.agg(
            F.count(F.lit(1)).alias("total_packets"),
            F.coalesce(F.sum(F.col("size").cast("long")), F.lit(0)).alias("total_bytes"),
            F.approx_count_distinct("src_ip").alias("unique_sources"),
            F.approx_count_distinct("dst_ip").alias("unique_destinations"))
    pairs = packets.groupBy("src_ip", "dst_ip").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("size").cast("long")).alias("bytes"))
    return pairs.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_packets"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_bytes"),
        F.count_distinct("src_ip").alias("unique_sources"),
        F.count_distinct("dst_ip").alias("unique_destinations"))


def protocol_distribution(packets: DataFrame) -> DataFrame:
    return packets.groupBy("protocol").agg(F.count(F.lit(1)).alias("packet_count"))


def top_sources(packets: DataFrame, limit: int = 10) -> DataFrame:
    return packets.groupBy("src_ip").agg(
        F.count(F.lit(1)).alias("packet_count"), F.sum(F.col("size").cast("long")).alias("total_bytes")
    ).orderBy(F.desc("packet_count"), "src_ip").limit(limit)


def talker_share(packets: DataFrame, limit: int = 10) -> DataFrame:
    """Top sources with their bytes as a share of the largest of them, and as text."""
    top = top_sources(packets, limit)
    # at most `limit` rows are left here
    most = F.max("total_bytes").over(Window.partitionBy(F.lit(1)))
    return top.select("src_ip", "packet_count", "total_bytes",
                      (F.col("total_bytes") / most * 100).alias("share"),
                      human_bytes(F.col("total_bytes"), 1, ("B", "KB", "MB", "GB")).alias("bytes_text"))


def hourly_averages(totals: DataFrame, hours: float) -> DataFrame:
    per = F.nullif(F.lit(float(hours)), F.lit(0.0))
    return totals.withColumn("packets_per_hour", F.col("total_packets") / per).withColumn(
        "bytes_per_hour", F.col("total_bytes") / per)


def port_usage(packets: DataFrame, limit: int | None = 20) -> DataFrame:
    """Ports above 0 by use at either end."""
    used = packets.select(F.explode(F.array("src_port", "dst_port")).alias("port")).filter("port > 0")
    counts = used.groupBy("port").agg(F.count(F.lit(1)).alias("uses"))
    return counts if limit is None else counts.orderBy(F.desc("uses"), "port").limit(limit)


def analyzer_statistics(packets: DataFrame, active_flows: DataFrame) -> DataFrame:
    """Packets, bytes, distinct protocols and ports, and the flows still active."""
    grouped = packets.groupBy("protocol", "src_port", "dst_port").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("size").cast("long")).alias("bytes"))
    totals = grouped.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("packets_analyzed"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_bytes"),
        F.count_distinct("protocol").alias("unique_protocols"))
    ports = grouped.select(F.explode(F.array("src_port", "dst_port")).alias("port")).filter(
        "port > 0").agg(F.count_distinct("port").alias("unique_ports"))
    flows = active_flows.agg(F.count(F.lit(1)).alias("active_connections"))
    return side_by_side(totals, ports, flows)


def capture_filter(packets: DataFrame, f) -> DataFrame:
    """Packets a CaptureFilter lets through; unknown protocol names are dropped from the list."""
    out = packets
    wanted = [p.upper() for p in f.protocols if p.lower() in f.allowed]
    if wanted:
        out = out.filter(F.col("protocol").isin(wanted))
    if f.included_ips:
        out = out.filter(F.col("src_ip").isin(*f.included_ips) | F.col("dst_ip").isin(*f.included_ips))
    if f.excluded_ips:
        out = out.filter(~(F.col("src_ip").isin(*f.excluded_ips) | F.col("dst_ip").isin(*f.excluded_ips)))
    either = lambda ports: F.coalesce(F.col("src_port").isin(*ports), F.lit(False)) | F.coalesce(
        F.col("dst_port").isin(*ports), F.lit(False))
    if f.included_ports:
        out = out.filter(either(f.included_ports))
    if f.excluded_ports:
        out = out.filter(~either(f.excluded_ports))
    if f.max_packet_size is not None:
        out = out.filter(F.col("size") <= f.max_packet_size)
    return out
