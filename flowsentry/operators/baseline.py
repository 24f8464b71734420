"""Baseline statistics of normal traffic and the comparison of packets with them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import hour_of_day, is_weekend
from ..session import cut

TOP_PORTS = 20


@dataclass(frozen=True)
class Baseline:
    """One-row scalars and three lookup tables (value, frequency)."""

    scalars: DataFrame
    protocols: DataFrame
    ports: DataFrame
    hours: DataFrame


def _summary(packets: DataFrame) -> DataFrame:
    """Counts per (protocol, port, hour, day): the one pass over the packets all parts start from."""
    size = F.col("size").cast("long")
    return packets.groupBy(
        "protocol", F.coalesce("dst_port", F.lit(0)).alias("dst_port"),
        hour_of_day(F.col("timestamp")).alias("hour"), F.to_date("timestamp").alias("day"),
        is_weekend(F.col("timestamp")).alias("weekend")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes"),
        F.sum((size * size).cast("decimal(38,0)")).alias("squares"))


def baseline_scalars(packets: DataFrame) -> DataFrame:
    return _scalars(_summary(packets))


def _scalars(summary: DataFrame) -> DataFrame:
    """Rows, mean and population deviation of the size, mean packets per weekday and weekend day."""
    c = F.col
    n, mean = c("n"), c("bytes") / c("n")
    per_day = summary.groupBy("day", "weekend").agg(
        F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.sum("squares").alias("squares"))
    total = per_day.agg(
        F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.sum("squares").alias("squares"),
        (F.sum(F.when(~c("weekend"), c("n"))) / F.count_if(~c("weekend"))).alias("weekday_avg_traffic"),
        (F.sum(F.when(c("weekend"), c("n"))) / F.count_if(c("weekend"))).alias("weekend_avg_traffic"))
    # n·Σx² − (Σx)² stays exact in decimals, unlike a difference of means
    spread = (n.cast("decimal(18,0)") * c("squares").cast("decimal(20,0)")
              - c("bytes").cast("decimal(18,0)") * c("bytes").cast("decimal(18,0)"))
    zero = F.lit(0.0)
    return total.select(
        F.coalesce(n, F.lit(0)).alias("samples"), F.coalesce(mean, zero).alias("avg_packet_size"),
        F.coalesce(F.sqrt(spread.cast("double")) / n, zero).alias("std_packet_size"),
        F.coalesce("weekday_avg_traffic", zero).alias("weekday_avg_traffic"),
        F.coalesce("weekend_avg_traffic", zero).alias("weekend_avg_traffic"))


def _shares(summary: DataFrame, value: str) -> DataFrame:
    counts = summary.groupBy(value).agg(F.sum("n").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.select(value, (F.col("n") / total).alias("frequency"))


def baseline_protocols(packets: DataFrame) -> DataFrame:
    return _shares(_summary(packets), "protocol")


def baseline_ports(packets: DataFrame, limit: int = TOP_PORTS) -> DataFrame:
    """The most used destination ports above 0, as a share of all packets."""
    return _top_ports(_summary(packets), limit)


def _top_ports(summary: DataFrame, limit: int) -> DataFrame:
    return _shares(summary, "dst_port").filter(F.col("dst_port") > 0).orderBy(
        F.desc("frequency"), "dst_port").limit(limit)


def baseline_hours(packets: DataFrame) -> DataFrame:
    return _shares(_summary(packets), "hour")


def learn(packets: DataFrame) -> Baseline:
    """All parts from one pass over the packets."""
    summary = cut(_summary(packets))
    return Baseline(_scalars(summary), _shares(summary, "protocol"),
                    _top_ports(summary, TOP_PORTS), _shares(summary, "hour"))


def compare(features: DataFrame, baseline: Baseline) -> DataFrame:
    """Features with their deviation from the baseline; a value the baseline lacks has frequency 0.

    The hours are at most 24 rows and the ports at most 20, so these are broadcast; the protocol
    table is left to the size Spark measures.
    """
    c = F.col
    freq: Column = F.lit(0.0)
    joined = (features
              .join(baseline.protocols.select("protocol", c("frequency").alias("_p")), "protocol", "left")
              .join(F.broadcast(baseline.ports.select("dst_port", c("frequency").alias("_d"))), "dst_port", "left")
              .join(F.broadcast(baseline.hours.select(
                  c("hour").alias("hour_of_day"), c("frequency").alias("_h"))), "hour_of_day", "left"))
    joined = joined.withColumn("_avg", baseline.scalars.select("avg_packet_size").scalar())
    out = joined.withColumn("packet_size_deviation", F.when(
        c("_avg") > 0, F.abs(c("packet_size") - c("_avg")) / c("_avg")))
    for name, short, rare, limit in (("protocol_frequency", "_p", "is_rare_protocol", 0.01),
                                     ("port_frequency", "_d", "is_rare_port", 0.001),
                                     ("hourly_frequency", "_h", "is_unusual_time", 0.01)):
        out = out.withColumn(name, F.coalesce(c(short), freq)).withColumn(rare, c(name) < limit)
    return out.select(*features.columns, "packet_size_deviation", "protocol_frequency", "is_rare_protocol",
                      "port_frequency", "is_rare_port", "hourly_frequency", "is_unusual_time")
