"""The common alert record all detectors produce."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import from_us
from ..schema import ALERTS
from .suppress import thin

# Order in which detectors look at one packet.
SCAN, FLOOD, PAYLOAD, RULE, ANOMALY = range(1, 6)

COLUMNS = ["packet_id", "us", "detector", "alert_type", "severity", "source_ip",
           "destination_ip", "description", "details"]


def alert_columns(id_: Column, us: Column, detector: int, alert_type: Column, severity: Column, source_ip: Column,
                  destination_ip: Column, description: Column, details: Column) -> list[Column]:
    """The columns of an alert; an empty destination becomes null, details a JSON string."""
    dst = F.when(destination_ip != "", destination_ip)
    return [id_.alias("packet_id"), us.alias("us"), F.lit(detector).alias("detector"),
            alert_type.alias("alert_type"), severity.alias("severity"), source_ip.alias("source_ip"),
            dst.alias("destination_ip"), description.alias("description"), F.to_json(details).alias("details")]


def alert_rows(rows: DataFrame, detector: int, alert_type: Column, severity: Column,
               source_ip: Column, destination_ip: Column, description: Column,
               details: Column) -> DataFrame:
    """Detector rows as alerts."""
    return rows.select(*alert_columns(F.col("id"), F.col("us"), detector, alert_type, severity, source_ip,
                                      destination_ip, description, details))


def union_alerts(*parts: DataFrame) -> DataFrame:
    """Alerts of all detectors; `seq` orders them by packet, then by detector, then by type (a rule's name is
    part of it), and no two alerts share it."""
    both = reduce(lambda a, b: a.unionByName(b), [p.select(*COLUMNS) for p in parts])
    return both.withColumn("seq", F.struct("packet_id", "detector", "alert_type"))


def deduplicate(alerts: DataFrame, window_seconds: int = 600, **kw) -> DataFrame:
    """Alerts stored when the same type, source and destination repeats within the window."""
    return thin(alerts, ["alert_type", "source_ip", "destination_ip"], window_seconds,
                us="us", row_id="seq", inclusive=True, **kw)


def to_table(alerts: DataFrame) -> DataFrame:
    """Alerts in the stored table's columns, open; the id is a 64-bit hash of `seq`."""
    names = [f.name for f in ALERTS]
    return alerts.select(
        F.xxhash64("seq").alias("id"), from_us(F.col("us")).alias("timestamp"), "alert_type", "severity",
        "source_ip", "destination_ip", "description", "details",
        F.lit(False).alias("resolved"), F.lit(None).cast("timestamp").alias("resolved_at"),
        F.lit(None).cast("string").alias("resolved_by")).select(*names)


def log_lines(alerts: DataFrame) -> DataFrame:
    """One compact JSON line per alert behind `ALERT: `."""
    head = F.to_json(F.struct(
        F.date_format(from_us(F.col("us")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        F.col("alert_type").alias("type"), "severity", "source_ip",
        F.coalesce("destination_ip", F.lit("")).alias("destination_ip"), "description"))
    # the details are JSON already, so they go in as they are
    return alerts.select(F.concat(
        F.lit("ALERT: "), F.regexp_replace(head, r"\}$", ""), F.lit(',"details":'),
        F.coalesce("details", F.lit("null")), F.lit("}")).alias("value"))
