"""Rate floods: packets per source over a rolling window."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import fixed, ratio_guarded, us
from ..params import Thresholds
from ..schema import DDOS, SECOND_US
from ..session import cut
from . import alerts
from .ordered import SLICE_US, first_occurrences, running, slice_start
from .suppress import thin

TARGETS_SHOWN = 10
MEASURES = {"in_window": F.sum, "packets": F.sum, "bytes": F.sum, "targets": F.sum, "first_us": F.min}


def flood_severity(rate: Column, targets: Column, bytes_per_second: Column) -> Column:
    return F.when((rate > 500) | (bytes_per_second > 10_000_000), F.lit("Critical")) \
        .when((rate > 200) | (targets > 10) | (bytes_per_second > 1_000_000), F.lit("High")) \
        .when((rate > 100) | (targets > 3), F.lit("Medium")) \
        .otherwise(F.lit("Low"))


def flood_progress(packets: DataFrame, p: Thresholds = Thresholds(), *,
                   only_over: float | None = None) -> DataFrame:
    """Each packet with its source's rolling rate and totals since the source was first seen.

    A packet adds one to the window when it arrives and takes it away one microsecond after the
    window has passed, so the rolling count is a running sum over both kinds of events and any
    slice width will do. With `only_over` (a rate) rows that cannot exceed it are not sorted:
    per-slice counts bound the rolling count from above.
    """
    c = F.col
    window_us = p.ddos_time_window * SECOND_US
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    rows = packets.select("id", us(c("timestamp")).alias("us"), "src_ip", "dst_ip",
                          c("size").cast("long").alias("size"))
    slices = rows.groupBy("src_ip", slice_start("us", SLICE_US).alias("slice")).agg(
        F.count(F.lit(1)).alias("packets"), F.sum("size").alias("bytes"), F.min("us").alias("first_us"))

    if only_over is None:
        followed, opening = rows, None
    else:
        back = Window.partitionBy("src_ip").orderBy("slice").rangeBetween(-(window_us + SLICE_US), 0)
        hot = slices.withColumn("bound", F.sum("packets").over(back)).filter(
            c("bound") > only_over * p.ddos_time_window).select("src_ip", c("slice").alias("hot"))
        # a followed slice also needs the rows that may still count in its window
        reach = -(-window_us // SLICE_US) + 1
        needed = hot.select("src_ip", F.explode(F.sequence(
            c("hot") - reach * SLICE_US, c("hot"), F.lit(SLICE_US))).alias("slice")).distinct()
        rows = rows.withColumn("slice", slice_start("us", SLICE_US))
        followed = rows.join(needed, ["src_ip", "slice"], "left_semi").drop("slice")
        # totals of the rows left out still count: one event per skipped slice, at its end
        skipped = slices.join(needed, ["src_ip", "slice"], "left_anti").join(
            hot.select("src_ip").distinct(), "src_ip", "left_semi")
        opening = skipped.select(
            "src_ip", (c("slice") + SLICE_US - 1).alias("us"), F.lit(-1).cast("long").alias("id"),
            F.lit(0).alias("step"), zero.alias("in_window"), "packets", "bytes", zero.alias("targets"),
            "first_us")

    # one row per host pair, read twice below; packets are brought down to pairs before anything goes by source
    targets = first_occurrences(rows, ["src_ip"], "dst_ip", "us", "id")
    if only_over is not None:
        targets = targets.join(hot.select("src_ip").distinct(), "src_ip", "left_semi")
    targets = cut(targets)
    no_time = F.lit(None).cast("long")
    event = F.explode(F.array(
        F.struct(c("us").alias("us"), F.lit(1).alias("step"), one.alias("in_window"),
                 one.alias("packets"), c("size").alias("bytes"), c("us").alias("first_us")),
        F.struct((c("us") + window_us + 1).alias("us"), F.lit(-1).alias("step"), (-one).alias("in_window"),
                 zero.alias("packets"), zero.alias("bytes"), no_time.alias("first_us"))))
    events = followed.select("src_ip", "id", "dst_ip", event.alias("e")).select(
        "src_ip", "id", "dst_ip", "e.*", zero.alias("targets"))
    events = events.unionByName(targets.select(
        "src_ip", "us", "id", F.lit(0).alias("step"), zero.alias("in_window"), zero.alias("packets"),
        zero.alias("bytes"), one.alias("targets"), no_time.alias("first_us")), allowMissingColumns=True)
    if opening is not None:
        events = events.unionByName(opening, allowMissingColumns=True)
    # expiries come first at their microsecond whatever their id, so they sort below every real id
    events = events.withColumn("turn", F.when(c("step") == -1, 0).otherwise(1))
    out = running(events, ["src_ip"], ["us", "turn", "id", "step"], MEASURES, SLICE_US).filter("step = 1")

    n = c("in_window") if p.rate_history_cap is None else F.least(c("in_window"), F.lit(p.rate_history_cap))
    out = out.withColumn("rate", n / F.lit(float(p.ddos_time_window)))
    out = out.withColumn("duration", (c("us") - c("first_us")) / F.lit(1e6))
    out = out.withColumn("bytes_per_second", ratio_guarded(c("bytes"), c("duration")))
    return out.withColumn("severity", flood_severity(
        c("rate"), c("targets"), c("bytes_per_second"))).drop("turn", "step")


def flood_candidates(packets: DataFrame, p: Thresholds = Thresholds()) -> DataFrame:
    """Packets at which the source's rate exceeds the threshold."""
    return flood_progress(packets, p, only_over=p.ddos_threshold).filter(
        F.col("rate") > p.ddos_threshold)


def flood_alerts(packets: DataFrame, p: Thresholds = Thresholds(), **kw) -> DataFrame:
    """Flood alerts after the per-source cooldown; they name no destination.

    The details list the first 10 targets of the source seen so far, sorted.
    """
    c = F.col
    fired = cut(thin(flood_candidates(packets, p), ["src_ip"], p.alert_cooldown, **kw))
    rows = packets.select("id", us(c("timestamp")).alias("us"), "src_ip", "dst_ip")
    firsts = first_occurrences(rows, ["src_ip"], "dst_ip", "us", "id").join(
        fired.select("src_ip").distinct(), "src_ip", "left_semi")
    rank = Window.partitionBy("src_ip").orderBy("us", "id")
    shown = firsts.withColumn("rank", F.row_number().over(rank)).filter(
        c("rank") <= TARGETS_SHOWN).groupBy("src_ip").agg(
        F.collect_list(F.struct("us", "id", "dst_ip")).alias("seen"))
    fired = fired.join(shown, "src_ip")
    so_far = F.filter(c("seen"), lambda x: (x["us"] < c("us")) | (
        (x["us"] == c("us")) & (x["id"] <= c("id"))))
    details = F.struct(
        c("rate").alias("connection_rate"), c("packets").alias("total_connections"),
        c("bytes").alias("bytes_sent"), c("targets").alias("target_count"),
        F.array_sort(F.transform(so_far, lambda x: x["dst_ip"])).alias("target_ips"),
        c("duration").alias("attack_duration"))
    text = F.format_string(
        "Potential DDoS attack detected from %s. Connection rate: %s connections/second.",
        c("src_ip"), fixed(c("rate"), 1))
    return alerts.alert_rows(fired, alerts.FLOOD, F.lit(DDOS), c("severity"), c("src_ip"),
                             F.lit(""), text, details)


def active_floods(packets: DataFrame, as_of: datetime, p: Thresholds = Thresholds()) -> DataFrame:
    """Per source at `as_of`: rate over the last window and totals since first seen."""
    c = F.col
    moment = us(F.lit(as_of).cast("timestamp"))
    # one row per (source, target) before distinct targets are counted
    pairs = packets.filter(c("timestamp") <= F.lit(as_of).cast("timestamp")).groupBy("src_ip", "dst_ip").agg(
        F.count_if(us(c("timestamp")) >= moment - p.ddos_time_window * SECOND_US).alias("recent"),
        F.count(F.lit(1)).alias("n"), F.sum(c("size").cast("long")).alias("bytes"),
        F.min(us(c("timestamp"))).alias("first_us"))
    n = F.sum("recent") if p.rate_history_cap is None else F.least(F.sum("recent"), F.lit(p.rate_history_cap))
    return pairs.groupBy(c("src_ip").alias("source_ip")).agg(
        (n / F.lit(float(p.ddos_time_window))).alias("connection_rate"),
        F.sum("n").alias("total_connections"), F.sum("bytes").alias("bytes_sent"),
        F.count(F.lit(1)).alias("target_count"),
        ((moment - F.min("first_us")) / F.lit(1e6)).alias("duration"))
