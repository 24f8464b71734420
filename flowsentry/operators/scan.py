"""Port scans: distinct destination ports per source inside an idle-gap session."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import from_us, ratio_guarded, us
from ..params import Thresholds
from ..schema import COMMON_PORTS, PORT_SCAN, SECOND_US
from ..session import cut
from . import alerts
from .ordered import number_sessions, running, slice_start, slice_width
from .suppress import thin

PORTS_SHOWN = 20
TARGETS_SHOWN = 10


def is_attempt() -> Column:
    """TCP packets with SYN towards a port that is not a common service."""
    flags = F.coalesce(F.col("tcp_flags"), F.lit(""))
    return ((F.col("protocol") == "TCP") & flags.contains("SYN")
            & ~F.coalesce(F.col("dst_port").isin(*COMMON_PORTS), F.lit(False)))


def attempt_columns() -> list[Column]:
    failed = F.coalesce(F.col("tcp_flags"), F.lit("")).contains("RST").cast("long").alias("failed")
    return [F.col("id"), us(F.col("timestamp")).alias("us"), *map(F.col, ("src_ip", "dst_ip", "dst_port")), failed]


def scan_attempts(packets: DataFrame) -> DataFrame:
    return packets.filter(is_attempt()).select(*attempt_columns())


def _slice(window_s: int) -> Column:
    return slice_start("us", slice_width(window_s * SECOND_US))


def _grouped(attempts: DataFrame, window_s: int) -> DataFrame:
    """One row per (source, slice, port, target); sessions and first occurrences come from these.

    Slices are no wider than the idle gap, so no session ends inside one.
    """
    return attempts.groupBy("src_ip", _slice(window_s).alias("slice"), "dst_port", "dst_ip").agg(
        F.count(F.lit(1)).alias("n"), F.sum("failed").alias("failed"),
        F.max("us").alias("last_us"), F.min(F.struct("us", "id")).alias("at"))


def _sessions(grouped: DataFrame, window_s: int) -> DataFrame:
    slices = grouped.groupBy("src_ip", "slice").agg(
        F.min("at.us").alias("first_us"), F.max("last_us").alias("last_us"))
    return number_sessions(slices, ["src_ip"], window_s * SECOND_US).select(
        "src_ip", "slice", "session_us")


def _first_seen(in_session: DataFrame, value: str) -> DataFrame:
    """(src_ip, session_us, value, us, id): where a session first meets each distinct value."""
    first = in_session.groupBy("src_ip", "session_us", value).agg(F.min("at").alias("at"))
    return first.select("src_ip", "session_us", value, "at.us", "at.id")


def _distinct_ports() -> Column:
    """A missing port is one of the distinct values, as it is for the running count."""
    return F.count_distinct("dst_port") + F.max(F.col("dst_port").isNull().cast("long"))


def scan_severity(ports: Column, targets: Column, rate: Column) -> Column:
    return F.when((rate > 10) | (targets > 5) | (ports > 100), F.lit("Critical")) \
        .when((rate > 5) | (targets > 2) | (ports > 50), F.lit("High")) \
        .when((ports > 20) | (targets > 1), F.lit("Medium")) \
        .otherwise(F.lit("Low"))


def scan_sessions(packets: DataFrame, p: Thresholds = Thresholds()) -> DataFrame:
    """One row per source and session: distinct ports and targets, attempts, rate, severity."""
    c = F.col
    attempts = scan_attempts(packets)
    grouped = _grouped(attempts, p.scan_time_window)
    out = grouped.join(_sessions(grouped, p.scan_time_window), ["src_ip", "slice"]).groupBy(
        "src_ip", "session_us").agg(
        _distinct_ports().alias("ports"), F.count_distinct("dst_ip").alias("targets"),
        F.sum("n").alias("attempts"), F.sum("failed").alias("failed"),
        F.min("at.us").alias("first_us"), F.max("last_us").alias("last_us"))
    out = out.withColumn("duration", (c("last_us") - c("first_us")) / F.lit(1e6))
    out = out.withColumn("rate", ratio_guarded(c("attempts"), c("duration")))
    return out.withColumn("severity", scan_severity(c("ports"), c("targets"), c("rate")))


def scan_progress(packets: DataFrame, p: Thresholds = Thresholds(), *,
                  min_ports: int | None = None) -> DataFrame:
    """Each attempt with the session's running ports, targets, attempts and failures.

    With `min_ports`, only sessions that reach that many distinct ports in the end are followed;
    the others cannot yield a candidate, and skipping them avoids sorting their rows.
    """
    # sessions, thresholds and first occurrences all read this small table
    grouped = cut(_grouped(scan_attempts(packets), p.scan_time_window))
    return _progress(packets, grouped, p, min_ports)


def _progress(packets: DataFrame, grouped: DataFrame, p: Thresholds, min_ports: int | None) -> DataFrame:
    c = F.col
    attempts = scan_attempts(packets)
    sessions = _sessions(grouped, p.scan_time_window)
    in_session = grouped.join(sessions, ["src_ip", "slice"])
    key = ["src_ip", "session_us"]
    if min_ports is not None:
        wide = in_session.groupBy(*key).agg(_distinct_ports().alias("ports")).filter(
            c("ports") >= min_ports).select(*key)
        in_session = in_session.join(wide, key, "left_semi")
        sessions = sessions.join(wide, key, "left_semi")
    rows = attempts.withColumn("slice", _slice(p.scan_time_window)).join(
        sessions, ["src_ip", "slice"]).drop("slice")

    zero = F.lit(0).cast("long")
    one = F.lit(1).cast("long")
    new_port = _first_seen(in_session, "dst_port").select(
        *key, "us", "id", F.lit(0).alias("step"), one.alias("ports"), zero.alias("targets"),
        zero.alias("attempts"), zero.alias("failures"))
    new_target = _first_seen(in_session, "dst_ip").select(
        *key, "us", "id", F.lit(0).alias("step"), zero.alias("ports"), one.alias("targets"),
        zero.alias("attempts"), zero.alias("failures"))
    attempt = rows.select(
        *key, "us", "id", F.lit(1).alias("step"), zero.alias("ports"), zero.alias("targets"),
        one.alias("attempts"), c("failed").alias("failures"), "dst_ip", "dst_port")
    events = attempt.unionByName(new_port, allowMissingColumns=True).unionByName(
        new_target, allowMissingColumns=True)
    totals = running(events, key, ["us", "id", "step"],
                     {m: F.sum for m in ("ports", "targets", "attempts", "failures")})
    out = totals.filter("step = 1").drop("step")
    out = out.withColumn("duration", (c("us") - c("session_us")) / F.lit(1e6))
    out = out.withColumn("rate", ratio_guarded(c("attempts"), c("duration")))
    return out.withColumn("severity", scan_severity(c("ports"), c("targets"), c("rate")))


def scan_candidates(packets: DataFrame, p: Thresholds = Thresholds()) -> DataFrame:
    """Attempts at which the session's distinct ports have reached the threshold."""
    return scan_progress(packets, p, min_ports=p.port_scan_threshold).filter(
        F.col("ports") >= p.port_scan_threshold)


def _first_rows(in_session: DataFrame, fired: DataFrame) -> DataFrame:
    return in_session.join(fired.select("src_ip", "session_us").distinct(), ["src_ip", "session_us"], "left_semi")


def _shown(in_session: DataFrame, value: str, n: int) -> DataFrame:
    """(src_ip, session_us, <value>s): the first `n` distinct values of a session with their moment."""
    key = ["src_ip", "session_us"]
    rank = Window.partitionBy(*key).orderBy("us", "id")
    firsts = _first_seen(in_session, value).withColumn(
        "rank", F.row_number().over(rank)).filter(F.col("rank") <= n)
    return firsts.groupBy(*key).agg(F.collect_list(F.struct("us", "id", value)).alias(f"{value}s"))


def scan_alerts(packets: DataFrame, p: Thresholds = Thresholds(), **kw) -> DataFrame:
    """Port-scan alerts after the per-source cooldown.

    The details list the first 20 ports and the first 10 targets seen so far, sorted.
    """
    c = F.col
    key = ["src_ip", "session_us"]
    grouped = cut(_grouped(scan_attempts(packets), p.scan_time_window))
    candidates = _progress(packets, grouped, p, p.port_scan_threshold).filter(
        c("ports") >= p.port_scan_threshold)
    fired = cut(thin(candidates, ["src_ip"], p.alert_cooldown, **kw))
    in_session = _first_rows(grouped.join(_sessions(grouped, p.scan_time_window), ["src_ip", "slice"]), fired)
    fired = fired.join(_shown(in_session, "dst_port", PORTS_SHOWN), key).join(
        _shown(in_session, "dst_ip", TARGETS_SHOWN), key)

    def so_far(column, field):
        seen = F.filter(c(column), lambda x: (x["us"] < c("us")) | (
            (x["us"] == c("us")) & (x["id"] <= c("id"))))
        return F.array_sort(F.transform(seen, lambda x: x[field]))

    details = F.struct(
        so_far("dst_ports", "dst_port").alias("scanned_ports"),
        so_far("dst_ips", "dst_ip").alias("target_ips"),
        c("attempts").alias("scan_count"), c("failures").alias("failed_connections"),
        c("duration").alias("scan_duration"), c("rate").alias("scan_rate"))
    text = F.format_string("Port scan detected from %s. Scanned %d ports on %d target(s).",
                           c("src_ip"), c("ports"), c("targets"))
    return alerts.alert_rows(fired, alerts.SCAN, F.lit(PORT_SCAN), c("severity"), c("src_ip"),
                             c("dst_ip"), text, details)


def active_scans(packets: DataFrame, as_of: datetime, p: Thresholds = Thresholds()) -> DataFrame:
    """The running scan session of every source that is not yet idle at `as_of`."""
    c = F.col
    moment = us(F.lit(as_of).cast("timestamp"))
    past = packets.filter(c("timestamp") <= F.lit(as_of).cast("timestamp"))
    return scan_sessions(past, p).filter(moment - c("last_us") <= p.scan_time_window * SECOND_US).select(
        c("src_ip").alias("source_ip"), c("ports").alias("ports_scanned"), "targets",
        c("attempts").alias("scan_count"), "duration", from_us(c("last_us")).alias("last_activity"))
