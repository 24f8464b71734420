"""Retention, timeouts, purges and resolutions, as new tables instead of in-place updates."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .traffic import side_by_side, since

# What marks rows as sample data.
PURGE_TEXTS = ("%Mock%", "%mock%", "%test%", "%development%", "%Test%", "%demo%", "%Demo%")
PURGE_NETWORKS = ("192.168.%", "10.0.%")


@dataclass(frozen=True)
class Split:
    """A table divided by a retention rule."""

    kept: DataFrame
    dropped: DataFrame

    def counts(self) -> DataFrame:
        one = F.count(F.lit(1))
        return side_by_side(self.kept.agg(one.alias("kept")), self.dropped.agg(one.alias("dropped")))


def split(df: DataFrame, drop: Column) -> Split:
    """Rows for which `drop` is true leave; an unknown (null) verdict keeps the row."""
    verdict = F.coalesce(drop, F.lit(False))
    return Split(df.filter(~verdict), df.filter(verdict))


def old_packets(as_of: datetime, days: int = 30) -> Column:
    return F.col("timestamp") < since(as_of, days * 24)


def old_resolved_alerts(as_of: datetime, days: int = 30) -> Column:
    return (F.col("timestamp") < since(as_of, days * 24)) & F.col("resolved")


def old_alerts(as_of: datetime, days: int = 30) -> Column:
    return F.col("timestamp") < since(as_of, days * 24)


def old_closed_connections(as_of: datetime, days: int = 30) -> Column:
    return (F.col("last_seen") < since(as_of, days * 24)) & F.col("state").isin("CLOSED", "TIMEOUT")


def retention(packets: DataFrame, alerts: DataFrame, connections: DataFrame, as_of: datetime,
              days: int = 30) -> dict[str, Split]:
    return {"packets": split(packets, old_packets(as_of, days)),
            "alerts": split(alerts, old_resolved_alerts(as_of, days)),
            "connections": split(connections, old_closed_connections(as_of, days))}


def deletion_counts(tables: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """(table_name, kept, dropped) in one pass over each table."""
    parts = [df.agg(F.count_if(~F.coalesce(drop, F.lit(False))).alias("kept"),
                    F.count_if(F.coalesce(drop, F.lit(False))).alias("dropped"))
             .withColumn("table_name", F.lit(name)) for name, (df, drop) in tables.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def time_out_connections(connections: DataFrame, as_of: datetime, hours: float = 24) -> DataFrame:
    """ACTIVE connections not seen for `hours` become TIMEOUT."""
    idle = (F.col("last_seen") < since(as_of, hours)) & (F.col("state") == "ACTIVE")
    return connections.withColumn("state", F.when(idle, "TIMEOUT").otherwise(F.col("state")))


def _like_any(column: str, patterns: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(column).like(p), F.lit(False)) for p in patterns])


def sample_alert() -> Column:
    return _like_any("description", PURGE_TEXTS)


def sample_address(src: str = "src_ip", dst: str = "dst_ip") -> Column:
    return _like_any(src, PURGE_NETWORKS) | _like_any(dst, PURGE_NETWORKS)


def resolve_alerts(alerts: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Alerts with the newest resolution per id (alert_id, resolved_at, resolved_by) applied."""
    newest = Window.partitionBy("alert_id").orderBy(F.desc("resolved_at"), F.desc("resolved_by"))
    latest = resolutions.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").select(
        F.col("alert_id").alias("_id"), F.col("resolved_at").alias("_at"), F.col("resolved_by").alias("_by"))
    joined = alerts.join(latest, alerts["id"] == latest["_id"], "left")
    hit = F.col("_id").isNotNull()
    return joined.withColumn("resolved", F.col("resolved") | hit) \
        .withColumn("resolved_at", F.when(hit, F.col("_at")).otherwise(F.col("resolved_at"))) \
        .withColumn("resolved_by", F.when(hit, F.col("_by")).otherwise(F.col("resolved_by"))) \
        .select(*alerts.columns)


def unknown_resolutions(alerts: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Resolutions that name no stored alert."""
    return resolutions.join(alerts.select("id"), resolutions["alert_id"] == F.col("id"), "left_anti")


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [
        df.agg(F.count(F.lit(1)).alias("row_count")).withColumn("table_name", F.lit(name))
        for name, df in tables.items()])
