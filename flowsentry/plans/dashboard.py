"""Figures a dashboard shows: stat cards, talkers with shares, chart points."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import human_bytes, kilobytes, short_number, time_bucket
from ..operators.traffic import (hourly_averages, last_hours, protocol_distribution, side_by_side,
                                 talker_share, top_sources, traffic_totals)

CHART_POINTS = 50
ALERTS_SHOWN = 100


def traffic_stats(packets: DataFrame, as_of: datetime, hours: float = 24, limit: int = 10) -> dict[str, DataFrame]:
    """Totals with hourly means, protocols and top sources of the last `hours`."""
    recent = last_hours(packets, as_of, hours)
    return {"totals": hourly_averages(traffic_totals(recent), hours),
            "protocol_distribution": protocol_distribution(recent), "top_sources": top_sources(recent, limit)}


def stat_cards(packets: DataFrame, alerts: DataFrame, connections: DataFrame, as_of: datetime,
               hours: float = 24) -> DataFrame:
    """Packets, bytes, active connections and open alerts, raw and as text."""
    c = F.col
    moment = F.lit(as_of).cast("timestamp")
    traffic = last_hours(packets, as_of, hours).agg(
        F.count(F.lit(1)).alias("total_packets"),
        F.coalesce(F.sum(c("size").cast("long")), F.lit(0)).alias("total_bytes"))
    active = connections.agg(F.count_if(
        (c("last_seen") >= moment - F.expr("INTERVAL 5 MINUTES")) & (c("state") == "ACTIVE"))
        .alias("active_connections"))
    open_alerts = alerts.agg(F.count_if(~c("resolved")).alias("open_alerts"))
    return side_by_side(traffic, active, open_alerts).select(
        "*", short_number(c("total_packets")).alias("packets_text"), human_bytes(c("total_bytes")).alias("bytes_text"),
        short_number(c("active_connections")).alias("connections_text"),
        short_number(c("open_alerts")).alias("alerts_text"))


def chart_points(packets: DataFrame, granularity: str = "hour", limit: int = CHART_POINTS) -> DataFrame:
    """The last points of the traffic chart: packets and whole kilobytes per bucket."""
    return packets.groupBy(time_bucket(F.col("timestamp"), granularity).alias("bucket")).agg(
        F.count(F.lit(1)).alias("packets"), kilobytes(F.sum(F.col("size").cast("long"))).alias("kilobytes")
    ).orderBy(F.desc("bucket")).limit(limit)


def talkers(packets: DataFrame, as_of: datetime, hours: float = 24, limit: int = 10) -> DataFrame:
    return talker_share(last_hours(packets, as_of, hours), limit)
