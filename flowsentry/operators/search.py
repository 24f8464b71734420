"""Forensic searches over packets, connections and alerts: all filters first, then newest-first limit."""

from __future__ import annotations

import re
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import severity_rank
from ..params import AlertCriteria, ConnectionCriteria, PacketCriteria
from .traffic import in_range, last_hours, since

SORT_FIELDS = ("severity", "alert_type", "source_ip", "timestamp")


def _equal(df: DataFrame, criteria, names: list[str]) -> DataFrame:
    for name in names:
        wanted = getattr(criteria, name)
        if wanted is not None:
            df = df.filter(F.col(name) == (wanted.upper() if name == "protocol" else wanted))
    return df


def _ranged(df: DataFrame, criteria, ts: str) -> DataFrame:
    """The time range counts only when both ends are given."""
    if criteria.start_time is None or criteria.end_time is None:
        return df
    return in_range(df, criteria.start_time, criteria.end_time, ts)


def _last_days(df: DataFrame, limit: int, ts: str) -> DataFrame:
    """The newest date partitions that hold at least `limit` rows of `df`, where it has such partitions.

    Walks back from the newest day by 1, 2, 4, … days, so that the days read are less than twice those needed; the days
    there are come from the names of the files. Rows without a day count only where all days do not suffice.
    """
    if "date" not in df.columns or ts != "timestamp":
        return df
    days = sorted({m[1] for m in map(re.compile(r"/date=(\d{4}-\d\d-\d\d)/").search, df.inputFiles()) if m}, reverse=True)
    back = 1
    while back < len(days):
        part = df.filter(F.col("date") >= F.lit(days[back - 1]).cast("date"))
        if part.limit(limit).count() >= limit:
            return part
        back *= 2
    return df


def _edge(df: DataFrame, limit: int, ts: str) -> tuple[Column, Column]:
    """The minute in which the newest `limit` rows begin, and whether rows without a time are among them: both from one
    pass, beside the one that takes the rows.

    Taken from the number of rows per minute: one small row per minute of the time span, whatever the traffic.
    Without it every task would hand `limit` rows to the one that merges them.
    """
    minutes = df.groupBy(F.date_trunc("minute", ts).alias("m")).agg(F.count(F.lit(1)).alias("n"))
    newer = Window.orderBy(F.desc_nulls_last("m")).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(newer), F.lit(0))
    within = minutes.select("m", before.alias("before")).filter(F.col("before") < limit)
    edge = within.agg(F.struct(F.min("m").alias("begin"), F.max(F.col("m").isNull()).alias("timeless"))).scalar()
    return edge["begin"], edge["timeless"]


def newest(df: DataFrame, limit: int | None, ts: str = "timestamp") -> DataFrame:
    """Newest first, rows without a time last; ties by the larger id."""
    order = [F.desc_nulls_last(ts), F.desc("id")]
    if limit is None:
        return df.orderBy(*order)
    df = _last_days(df, limit, ts)
    begin, timeless = _edge(df, limit, ts)
    return df.filter((F.col(ts) >= begin) | (F.col(ts).isNull() & timeless)).orderBy(*order).limit(limit)


def packet_search(packets: DataFrame, c: PacketCriteria, limit: int | None = 1000) -> DataFrame:
    df = _equal(packets, c, ["src_ip", "dst_ip", "protocol", "src_port", "dst_port"])
    df = _ranged(df, c, "timestamp")
    if c.min_size is not None:
        df = df.filter(F.col("size") >= c.min_size)
    if c.max_size is not None:
        df = df.filter(F.col("size") <= c.max_size)
    return newest(df, limit)


def connection_search(connections: DataFrame, c: ConnectionCriteria, limit: int | None = 1000) -> DataFrame:
    df = _ranged(_equal(connections, c, ["src_ip", "dst_ip", "protocol", "state"]), c, "first_seen")
    if c.min_duration is not None:
        df = df.filter(F.col("connection_duration") >= c.min_duration)
    return newest(df, limit, "last_seen")


def alert_search(alerts: DataFrame, c: AlertCriteria, limit: int | None = 1000) -> DataFrame:
    return newest(_ranged(_equal(
        alerts, c, ["alert_type", "severity", "source_ip", "resolved"]), c, "timestamp"), limit)


def recent_packets(packets: DataFrame, as_of: datetime, hours: float = 24, limit: int = 100) -> DataFrame:
    return newest(last_hours(packets, as_of, hours), limit)


def recent_alerts(alerts: DataFrame, limit: int = 100, severity: str | None = None) -> DataFrame:
    return alert_search(alerts, AlertCriteria(severity=severity), limit)


def unresolved_alerts(alerts: DataFrame, limit: int | None = None) -> DataFrame:
    return newest(alerts.filter(~F.col("resolved")), limit)


def resolved_alerts(alerts: DataFrame, limit: int = 100) -> DataFrame:
    return newest(alerts.filter(F.col("resolved")), limit, "resolved_at")


def alerts_by_source(alerts: DataFrame, source_ip: str, as_of: datetime, hours: float = 24,
                     limit: int | None = None) -> DataFrame:
    return newest(last_hours(alerts, as_of, hours).filter(F.col("source_ip") == source_ip), limit)


def alert_listing(alerts: DataFrame, as_of: datetime, limit: int = 100, severity: str | None = None,
                  resolved: bool | None = None, hours: float | None = None) -> DataFrame:
    """Alerts under any mix of severity, resolution and age, all applied before the limit."""
    df = _equal(alerts, AlertCriteria(severity=severity, resolved=resolved), ["severity", "resolved"])
    if hours is not None:
        df = last_hours(df, as_of, hours)
    return newest(df, limit)


def active_connections(connections: DataFrame, as_of: datetime, minutes: float = 5,
                       limit: int | None = 100) -> DataFrame:
    """Stored connections in state ACTIVE seen in the last five minutes."""
    return newest(connections.filter(
        (F.col("last_seen") >= since(as_of, minutes / 60)) & (F.col("state") == "ACTIVE")), limit, "last_seen")


def alert_view(alerts: DataFrame, text: str = "", severity: str | None = None,
               sort: str = "timestamp", descending: bool = True, limit: int | None = None) -> DataFrame:
    """Alerts whose type or description (any case) or source address contains `text`.

    Severities sort by rank, everything else by value; ties by id.
    """
    if sort not in SORT_FIELDS:
        raise ValueError(f"cannot sort by {sort}")
    df = alerts
    if text:
        low = text.lower()
        df = df.filter(reduce(lambda a, b: a | b, [
            F.lower("alert_type").contains(low), F.lower("description").contains(low),
            F.col("source_ip").contains(text)]))
    if severity is not None:
        df = df.filter(F.col("severity") == severity)
    key = severity_rank(F.col("severity")) if sort == "severity" else F.col(sort)
    df = df.orderBy(key.desc() if descending else key.asc(), F.desc("id") if descending else F.asc("id"))
    return df if limit is None else df.limit(limit)


def forensic_search(packets: DataFrame, connections: DataFrame, alerts: DataFrame, *,
                    src_ip: str | None = None, dst_ip: str | None = None, protocol: str | None = None,
                    start_time: datetime | None = None, end_time: datetime | None = None,
                    packet: dict | None = None, connection: dict | None = None,
                    alert: dict | None = None, limit: int = 1000) -> dict[str, DataFrame]:
    """The three searches under shared criteria; `src_ip` narrows alerts by their source as well."""
    span = {"start_time": start_time, "end_time": end_time}
    hosts = {"src_ip": src_ip, "dst_ip": dst_ip, "protocol": protocol}
    return {
        "packet": packet_search(packets, PacketCriteria(**hosts, **span, **(packet or {})), limit),
        "connection": connection_search(
            connections, ConnectionCriteria(**hosts, **span, **(connection or {})), limit),
        "alert": alert_search(alerts, AlertCriteria(source_ip=src_ip, **span, **(alert or {})), limit),
    }


def stacked(results: dict[str, DataFrame]) -> DataFrame:
    """All hits in one table tagged by `data_type`, absent columns null."""
    tagged = [df.withColumn("data_type", F.lit(name)) for name, df in results.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def match_counts(results: dict[str, DataFrame]) -> DataFrame:
    """Hits per data type and their total, after the limit of each search."""
    each = reduce(lambda a, b: a.unionByName(b), [
        df.agg(F.count(F.lit(1)).alias("matches")).withColumn("data_type", F.lit(name))
        for name, df in results.items()])
    total = each.agg(F.sum("matches").alias("matches")).withColumn("data_type", F.lit("total"))
    return each.unionByName(total)


def connection_analysis(found: DataFrame) -> DataFrame:
    """Totals over a connection search: rows, bytes, mean duration, connections per protocol."""
    per = found.groupBy("protocol").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("bytes_sent") + F.col("bytes_received")).alias("bytes"),
        F.sum("connection_duration").alias("seconds"))
    n = F.coalesce(F.sum("n"), F.lit(0))
    return per.agg(
        n.alias("total_connections"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_bytes_transferred"),
        F.coalesce(F.sum("seconds") / n, F.lit(0.0)).alias("average_duration_seconds"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("protocol", "n")))).alias("protocol_distribution"))
