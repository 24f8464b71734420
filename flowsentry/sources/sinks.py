"""Writers: table appends, alert log, report and search exports."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import alerts as al
from ..operators.search import active_connections, alert_listing, newest, stacked
from ..operators.traffic import last_hours
from ..plans.reports import flat_summary
from ..schema import ALERTS, CONNECTIONS, PACKETS
from ..session import cut

FORMATS = ("json", "csv")

# What a packet, alert or connection lacks on arrival; a missing time is the time of writing.
DEFAULTS = {"payload_size": 0, "resolved": False, "bytes_sent": 0, "bytes_received": 0, "packet_count": 1,
            "state": "ACTIVE", "avg_packet_size": 0.0, "connection_duration": 0.0}
ARRIVAL = ("timestamp", "first_seen", "last_seen")


def conform(df: DataFrame, schema) -> DataFrame:
    """The columns of a stored table, defaults filled in."""
    out = []
    for f in schema:
        value = F.col(f.name) if f.name in df.columns else F.lit(None)
        if f.name in DEFAULTS:
            value = F.coalesce(value, F.lit(DEFAULTS[f.name]))
        elif f.name in ARRIVAL:
            value = F.coalesce(value, F.current_timestamp())
        out.append(value.cast(f.dataType).alias(f.name))
    return df.select(*out)


def _append(df: DataFrame, path: str, schema, day_of: str) -> None:
    rows = conform(df, schema).withColumn("date", F.to_date(day_of))
    # days are brought together in files of the advisory size; a heavy day is split over many tasks
    rows.hint("rebalance", "date").write.mode("append").partitionBy("date").parquet(path)


def append_packets(df: DataFrame, path: str) -> None:
    _append(df, path, PACKETS, "timestamp")


def append_alerts(df: DataFrame, path: str) -> None:
    _append(df, path, ALERTS, "timestamp")


def append_connections(df: DataFrame, path: str) -> None:
    _append(df, path, CONNECTIONS, "first_seen")


def rewrite_kept(kept: DataFrame, dropped_days: DataFrame, path: str) -> None:
    """Rewrite only the date partitions a retention rule touched, and delete those that keep no row, these first: a crash in
    between leaves expired rows in days that keep some, and the same call again removes them.

    `kept` must not read `path` lazily while it is overwritten, so it is cut first.
    """
    day = F.to_date("timestamp").alias("date")
    touched = cut(dropped_days.select(day).distinct())
    rows = cut(kept.drop("date").withColumn("date", F.to_date("timestamp")).join(touched, "date", "left_semi"))
    # a dynamic overwrite leaves partitions alone that get no row; one small row per day
    empty = [r["date"] for r in touched.join(rows, "date", "left_anti").collect()]
    _drop_days(kept.sparkSession, path, empty)
    (rows.hint("rebalance", "date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("date").parquet(path))
    kept.sparkSession.catalog.refreshByPath(path)


def _drop_days(spark: SparkSession, path: str, days: list) -> None:
    jvm = spark._jvm
    for d in days:
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/date={'__HIVE_DEFAULT_PARTITION__' if d is None else d}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    spark.catalog.refreshByPath(path)


def write_alert_log(alerts: DataFrame, path: str, mode: str = "append") -> None:
    al.log_lines(alerts).write.mode(mode).text(path)


def _check(file_format: str) -> None:
    if file_format not in FORMATS:
        raise ValueError(f"Unsupported export format: {file_format}")


def report_lines(sections: dict[str, DataFrame]) -> DataFrame:
    """The lines of a report as one JSON document, in the order of (section, part, id); each section is a list of its rows.

    A line holds one row at most. Rows keep their section's order: their numbers rise with partition and place.
    """
    c = F.col
    lines = None
    for i, (name, df) in enumerate(sorted(sections.items())):
        # numbers are needed twice, for the first row and for the order
        rows = cut(df.select(F.to_json(F.struct(*df.columns)).alias("row"), F.monotonically_increasing_id().alias("id")))
        first = rows.agg(F.min("id")).scalar()
        body = rows.select(F.lit(i).alias("section"), F.lit(1).alias("part"), "id",
                           F.concat(F.when(c("id") == first, "").otherwise(","), "row").alias("value"))
        start = f'{"," if i else "{"}{json.dumps(name)}:['
        frame = df.sparkSession.createDataFrame([(i, 0, 0, start), (i, 2, 0, "]")], body.schema)
        lines = body.unionByName(frame) if lines is None else lines.unionByName(body).unionByName(frame)
    end = lines.sparkSession.createDataFrame([(len(sections), 0, 0, "}")], lines.schema)
    return lines.unionByName(end)


def write_report(sections: dict[str, DataFrame], path: str) -> None:
    """The report in part files written side by side; put one after another by name they are the document."""
    order = ["section", "part", "id"]
    (report_lines(sections).repartitionByRange(*order).sortWithinPartitions(*order).select("value")
     .write.mode("overwrite").text(path))


def report_parts(spark: SparkSession, path: str) -> list[str]:
    """The part files of a written report, in the order in which they make the document."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    return sorted(f.getPath().toString() for f in found if f.getPath().getName().startswith("part-"))


def export_report(sections: dict[str, DataFrame], path: str, file_format: str = "json") -> None:
    """A report as one JSON document in parts, or a security summary as flat CSV rows."""
    _check(file_format)
    if file_format == "json":
        write_report(sections, path)
    else:
        flat_summary(sections).write.mode("overwrite").option("header", True).csv(path)


def export_search(results: dict[str, DataFrame], path: str, file_format: str = "csv") -> None:
    """Forensic hits stacked with `data_type`."""
    _check(file_format)
    writer = stacked(results).write.mode("overwrite").option("header", True)
    writer.csv(path) if file_format == "csv" else writer.json(path)


def export_rows(df: DataFrame, path: str, exported_at: datetime, file_format: str = "json") -> None:
    """Rows as JSON lines carrying `exported_at`, or as CSV."""
    _check(file_format)
    if file_format == "json":
        df.select(F.struct(*df.columns).alias("data"), F.lit(exported_at).cast("timestamp").alias("exported_at")) \
            .write.mode("overwrite").json(path)
    else:
        df.write.mode("overwrite").option("header", True).csv(path)


def raw_export(kind: str, df: DataFrame, as_of: datetime, hours: float = 24,
               limit: int | None = None) -> DataFrame:
    """Rows of one table for an export, newest first; `hours` counts for all three tables."""
    if kind == "packets":
        return newest(last_hours(df, as_of, hours), limit)
    if kind == "alerts":
        return alert_listing(df, as_of, limit, hours=hours)
    if kind == "connections":
        return active_connections(last_hours(df, as_of, hours, "last_seen"), as_of, limit=limit)
    raise ValueError(f"Unknown data type: {kind}")
