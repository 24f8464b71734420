"""Running streams: table sinks, live feed, processing figures."""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..functions.scalars import from_us, kilobytes, time_bucket
from ..operators import alerts as al
from ..operators import anomaly, baseline, rules
from ..operators.search import alert_listing
from ..operators.suppress import thin
from ..operators.traffic import side_by_side, traffic_totals
from ..params import CustomRule, Thresholds
from ..plans.dashboard import ALERTS_SHOWN, CHART_POINTS, chart_points
from ..schema import SECOND_US
from ..session import cut, ensure_checkpoint_dir
from ..sources.tables import read_rules
from . import stateful
from .windows import LATENESS, on_time

log = logging.getLogger(__name__)


@contextmanager
def _partitions(spark: SparkSession, most: int) -> Iterator[None]:
    """At most so many shuffle partitions for what is planned meanwhile. The session of a stream does not merge small ones,
    for its state lies in a fixed number of them; the stream's own plan is made before a micro-batch is handed over."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, min(most, int(before)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def store_packets(packets: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append a packet stream to its table by date, exactly once."""
    return (packets.withColumn("date", F.to_date("timestamp")).writeStream.format("parquet")
            .partitionBy("date").option("path", path).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(**(trigger or {"processingTime": "30 seconds"})).start())


def write_batches(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None,
                  transform: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Write each micro-batch to its own folder, so that a repeated batch replaces itself."""
    def one(batch: DataFrame, batch_id: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(**(trigger or {"processingTime": "30 seconds"})).start())


def _hour(us: Column) -> Column:
    return F.date_format(from_us(us), "yyyy-MM-dd-HH")


def _write_hours(rows: DataFrame, path: str, stream: str, batch_id: int) -> None:
    """Write the rows of a micro-batch by the hour of `us`; a repeated batch replaces its own partitions alone."""
    (rows.withColumns({"hour": _hour(F.col("us")), "stream": F.lit(stream), "batch": F.lit(batch_id).cast("long")})
     .write.partitionBy("hour", "stream", "batch").mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .parquet(path))


def _read_hours(spark: SparkSession, path: str, schema: T.StructType, first: datetime, last: datetime,
                stream: str | None = None) -> DataFrame | None:
    """Rows of the hours from `first` to `last`, with `batch`; only these partitions are listed."""
    hours = [first.replace(minute=0, second=0, microsecond=0)]
    while hours[-1] + timedelta(hours=1) <= last:
        hours.append(hours[-1] + timedelta(hours=1))
    places = [f"{path}/hour={h:%Y-%m-%d-%H}" + (f"/stream={stream}" if stream else "") for h in hours]
    there = [x for x in places if _exists(spark, x)]
    if not there:
        return None
    full = T.StructType([*schema.fields, T.StructField("hour", T.StringType()), T.StructField("stream", T.StringType()),
                         T.StructField("batch", T.LongType())])
    return spark.read.schema(full).option("basePath", path).parquet(*there)


def _moment(us: int) -> datetime:
    return datetime(1970, 1, 1) + timedelta(microseconds=us)


#: Alerts of a micro-batch that one task looks at, and features that one task writes.
ALERTS_PER_TASK, FEATURES_PER_FILE = 20_000, 100_000


def keep_alerts(new: DataFrame, batch_id: int, path: str, window_seconds: int = 600, stream: str = "detectors") -> DataFrame:
    """Store the alerts of one micro-batch that no stored alert of the same type, source and destination precedes within
    the window; returns what was stored. Batches follow one another in event time (see stateful.stream_alerts), so only
    the hours that the window reaches back to are read; a repeated batch replaces itself."""
    spark = new.sparkSession
    new = cut(new.select(*al.COLUMNS))
    first, n = new.agg(F.min("us"), F.count(F.lit(1))).first()
    if first is None:
        return new
    # a partition of the state has few alerts or none
    tasks = 1 + n // ALERTS_PER_TASK
    new = new.coalesce(tasks)
    both = new.withColumn("stored", F.lit(False))
    since = first - window_seconds * SECOND_US
    before = _read_hours(spark, path, new.schema, _moment(since), _moment(first), stream)
    if before is not None:
        before = before.filter((F.col("batch") < batch_id) & (F.col("us") > since))
        both = both.unionByName(before.select(*al.COLUMNS).withColumn("stored", F.lit(True)))
    both = both.withColumn("seq", F.struct("packet_id", "detector", "alert_type"))
    with _partitions(spark, tasks):
        kept = cut(thin(both, ["alert_type", "source_ip", "destination_ip"], window_seconds, row_id="seq", inclusive=True)
                   .filter(~F.col("stored")).select(*al.COLUMNS))
    _write_hours(kept, path, stream, batch_id)
    return kept


def store_alerts(raised: DataFrame, path: str, checkpoint: str, window_seconds: int = 600,
                 trigger: dict | None = None, view: str | None = None) -> StreamingQuery:
    """Store the deduplicated alerts of a stream by the hour; with `view`, keep its open alerts up to date."""
    def one(batch: DataFrame, batch_id: int) -> None:
        kept = keep_alerts(batch, batch_id, path, window_seconds)
        if view:
            _note_open(raised.sparkSession, kept, batch_id, f"{view}/detectors")

    return (raised.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(**(trigger or {"processingTime": "30 seconds"})).start())


def publish_model(spark: SparkSession, models: str, forest: anomaly.Forest, learned: baseline.Baseline) -> int:
    """Save a model as the next version below `models`; running streams take it up with their next micro-batch."""
    version = (newest_model(spark, models) or 0) + 1
    anomaly.save(forest, learned, spark, f"{models}/version={version:09d}")
    # a version counts once its marker is there
    spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{models}/ready/version={version:09d}")
    return version


def newest_model(spark: SparkSession, models: str) -> int | None:
    """The newest version whose marker has been written."""
    if not _exists(spark, f"{models}/ready"):
        return None
    names = [f.getPath().getName() for f in _folder(spark, f"{models}/ready")[1]]
    return max((int(n.split("=")[1]) for n in names if n.startswith("version=")), default=None)


class Models:
    """The newest model of a folder, read again when there is a newer one."""

    def __init__(self, spark: SparkSession, models: str):
        self.spark, self.models, self.version, self.model = spark, models, None, None

    def current(self) -> tuple[anomaly.Forest, baseline.Baseline] | None:
        version = newest_model(self.spark, self.models)
        if version != self.version:
            self.version, self.model = version, anomaly.load(self.spark, f"{self.models}/version={version:09d}")
        return self.model


def store_anomalies(found: DataFrame, models: str, path: str, training: str, checkpoint: str, p: Thresholds = Thresholds(),
                    trigger: dict | None = None, view: str | None = None) -> StreamingQuery:
    """Score the features of a packet stream with the newest model, store its deduplicated alerts by the hour, and add
    the features to the training table. Before there is a model, rows are only gathered."""
    newest = Models(found.sparkSession, models)

    def one(batch: DataFrame, batch_id: int) -> None:
        rows = cut(batch)
        _write_hours(rows.coalesce(1 + rows.count() // FEATURES_PER_FILE), training, "features", batch_id)
        model = newest.current()
        raised = None
        if model:
            raised = keep_alerts(anomaly.anomaly_alerts(anomaly.score(rows, model[0]), model[1], p), batch_id, path,
                                 p.dedup_window, "anomalies")
        if view:
            _note_open(found.sparkSession, raised, batch_id, f"{view}/anomalies")

    return (found.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(**(trigger or {"processingTime": "30 seconds"})).start())


def retrain(spark: SparkSession, training: str, models: str, as_of: datetime, p: Thresholds = Thresholds()) -> int | None:
    """Learn baseline and model anew from the training rows of the last `p.baseline_window_hours` before `as_of` and
    publish them; returns the version, or None where there are too few rows. Run it beside the stream, as often as wanted."""
    since = as_of - timedelta(hours=p.baseline_window_hours)
    stored = _read_hours(spark, training, stateful.FEATURES, since, as_of)
    if stored is None:
        return None
    moment = F.col("timestamp")
    rows = cut(stored.filter((moment >= F.lit(since).cast("timestamp")) & (moment <= F.lit(as_of).cast("timestamp"))))
    forest = anomaly.fit(rows, p)
    if forest is None:
        return None
    return publish_model(spark, models, forest, baseline.learn(rows.withColumn("size", F.col("packet_size"))))


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return files, files.listStatus(folder) if files.exists(folder) else []


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def run_pipeline(packets: DataFrame, folder: str, p: Thresholds = Thresholds(), custom: list[CustomRule] | None = None,
                 trigger: dict | None = None, models: str | None = None,
                 lateness: str = LATENESS) -> dict[str, StreamingQuery]:
    """The live loop over a packet stream: packets by date, closed flows, deduplicated alerts of all detectors, traffic
    and open alerts for the live feed, each in its own folder below `folder`. With `models`, anomaly alerts of the newest
    model in that folder are stored beside the others, and features are gathered for `retrain`.

    All of it goes by one watermark, set on the packets before any filter."""
    timed = on_time(packets, lateness)
    view = f"{folder}/view"
    started = {
        "packets": store_packets(packets, f"{folder}/packets", f"{folder}/state/packets", trigger),
        "flows": write_batches(stateful.stream_flow_states(timed, p), f"{folder}/flows", f"{folder}/state/flows", trigger),
        "alerts": store_alerts(stateful.stream_alerts(timed, p, custom), f"{folder}/alerts", f"{folder}/state/alerts",
                               p.dedup_window, trigger, view)}
    if models:
        found = stateful.stream_features(timed, forget_source_after=p.forget_source_after)
        started["anomalies"] = store_anomalies(found, models, f"{folder}/alerts", f"{folder}/training",
                                               f"{folder}/state/anomalies", p, trigger, view)
    return started


def match_stream(packets: DataFrame, rules_path: str, path: str, checkpoint: str,
                 trigger: dict | None = None) -> StreamingQuery:
    """Rule matches of a packet stream; the rules are read again for every micro-batch."""
    spark = packets.sparkSession
    return write_batches(packets, path, checkpoint, trigger,
                         lambda batch: rules.rule_matches(batch, read_rules(spark, rules_path)))


def feed(packets: DataFrame, alerts: DataFrame, as_of: datetime) -> dict[str, DataFrame]:
    """One refresh: traffic of the last hour, open and critical alerts, last points and alerts."""
    hour = packets.filter(F.col("timestamp") >= F.lit(as_of).cast("timestamp") - F.expr("INTERVAL 1 HOUR"))
    counts = alerts.filter(~F.col("resolved")).agg(
        F.count(F.lit(1)).alias("unresolved_count"),
        F.count_if(F.col("severity") == "Critical").alias("critical_count"))
    return {"traffic": side_by_side(traffic_totals(hour), counts), "chart": chart_points(hour, "hour"),
            "alerts": alert_listing(alerts, as_of, ALERTS_SHOWN)}


GRAIN_SECONDS = 30
OPEN_COUNTS = "severity string, n long"
ALERT_VIEW = "alert_type string, severity string, source_ip string, destination_ip string, description string, us long, packet_id long"
GRAINS = T.StructType([T.StructField("us", T.LongType()), T.StructField("src_ip", T.StringType()),
                       T.StructField("dst_ip", T.StringType()), T.StructField("n", T.LongType()),
                       T.StructField("bytes", T.LongType())])


def _note_open(spark: SparkSession, kept: DataFrame | None, batch_id: int, path: str) -> None:
    """Open alerts by severity and the newest of them after one more micro-batch: the totals of the batch before plus
    its own alerts. Two batches stay, the last one and the one that a repeated batch starts from."""
    names = [x.split()[0] for x in ALERT_VIEW.split(", ")]
    before = f"{path}/batch={batch_id - 1}"
    counts = spark.createDataFrame([], OPEN_COUNTS)
    latest = spark.createDataFrame([], ALERT_VIEW)
    if batch_id and _exists(spark, before):
        # with the schema given no job looks for it in the files
        counts = spark.read.schema(OPEN_COUNTS).parquet(f"{before}/counts")
        latest = spark.read.schema(ALERT_VIEW).parquet(f"{before}/latest")
    if kept is not None:
        counts = counts.unionByName(kept.select("severity", F.lit(1).cast("long").alias("n")))
        latest = latest.unionByName(kept.select(*names))
    now = f"{path}/batch={batch_id}"
    counts.groupBy("severity").agg(F.sum("n").alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{now}/counts")
    (latest.orderBy(F.desc("us"), F.desc("packet_id"), "alert_type").limit(ALERTS_SHOWN).coalesce(1)
     .write.mode("overwrite").parquet(f"{now}/latest"))
    files, entries = _folder(spark, path)
    for e in entries:
        if int(e.getPath().getName().split("=")[1]) < batch_id - 1:
            files.delete(e.getPath(), True)


def note_resolved(spark: SparkSession, view: str, resolved: DataFrame, run: str) -> None:
    """Take alerts that have been resolved (rows with `severity`) off the open ones; a repeated `run` replaces itself."""
    resolved.groupBy("severity").agg((-F.count(F.lit(1))).alias("n")).coalesce(1).write.mode("overwrite").parquet(
        f"{view}/resolved/run={run}")


def open_alerts(spark: SparkSession, view: str) -> tuple[DataFrame, DataFrame]:
    """(severity, n) of the open alerts, and the newest alerts, from the small tables that the streams keep."""
    counts, latest = spark.createDataFrame([], OPEN_COUNTS), spark.createDataFrame([], ALERT_VIEW)
    for stream in ("detectors", "anomalies"):
        batches = sorted(int(e.getPath().getName().split("=")[1]) for e in _folder(spark, f"{view}/{stream}")[1])
        # the last one may still be written; one before it is whole
        done = [b for b in batches if _exists(spark, f"{view}/{stream}/batch={b}/latest/_SUCCESS")]
        if done:
            last = f"{view}/{stream}/batch={done[-1]}"
            counts = counts.unionByName(spark.read.schema(OPEN_COUNTS).parquet(f"{last}/counts"))
            latest = latest.unionByName(spark.read.schema(ALERT_VIEW).parquet(f"{last}/latest"))
    if _exists(spark, f"{view}/resolved"):
        counts = counts.unionByName(spark.read.schema(OPEN_COUNTS).parquet(f"{view}/resolved").select("severity", "n"))
    latest = latest.orderBy(F.desc("us"), F.desc("packet_id"), "alert_type").limit(ALERTS_SHOWN)
    return counts.groupBy("severity").agg(F.sum("n").alias("n")), latest


def note_traffic(batch: DataFrame, batch_id: int, path: str) -> int | None:
    """Add one micro-batch to the table of packets and bytes per host pair and `GRAIN_SECONDS`, by the hour; returns the
    moment of its newest packet."""
    grain = GRAIN_SECONDS * SECOND_US
    us = F.unix_micros("timestamp")
    sums = cut(batch.groupBy((us - F.pmod(us, F.lit(grain))).alias("us"), "src_ip", "dst_ip").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("size").cast("long")).alias("bytes"), F.max(us).alias("newest")))
    _write_hours(sums.drop("newest"), path, "traffic", batch_id)
    return sums.agg(F.max("newest")).first()[0]


def live_view(spark: SparkSession, view: str, newest_us: int) -> dict[str, DataFrame]:
    """One refresh of the live feed: traffic of the hour up to `newest_us`, in whole grains, open and critical alerts, chart
    points and newest alerts. It reads two hours of grains and the open-alert tables, whatever the stored tables hold."""
    c = F.col
    grain = GRAIN_SECONDS * SECOND_US
    first = newest_us // grain * grain - 3600 * SECOND_US + grain
    hour = _read_hours(spark, f"{view}/traffic", GRAINS, _moment(first), _moment(newest_us))
    hour = spark.createDataFrame([], GRAINS) if hour is None else hour.filter((c("us") >= first) & (c("us") <= newest_us))
    pairs = hour.groupBy("src_ip", "dst_ip").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    traffic = pairs.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_packets"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_bytes"),
        F.count_distinct("src_ip").alias("unique_sources"), F.count_distinct("dst_ip").alias("unique_destinations"))
    counts, latest = open_alerts(spark, view)
    alerts = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("unresolved_count"),
        F.coalesce(F.sum(F.when(c("severity") == "Critical", c("n"))), F.lit(0)).alias("critical_count"))
    chart = hour.groupBy(time_bucket(from_us(c("us")), "hour").alias("bucket")).agg(
        F.sum("n").alias("packets"), kilobytes(F.sum("bytes")).alias("kilobytes")).orderBy(F.desc("bucket")).limit(CHART_POINTS)
    return {"traffic": side_by_side(traffic, alerts), "chart": chart, "alerts": latest}


def live_feed(packets: DataFrame, view: str, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Every 30 seconds write the figures of `live_view`, as of the newest packet so far. `view` is the folder in which
    `run_pipeline` keeps the open alerts; traffic is gathered in it by grains."""
    spark = packets.sparkSession

    def one(batch: DataFrame, batch_id: int) -> None:
        newest = note_traffic(batch, batch_id, f"{view}/traffic")
        seen = f"{view}/newest/batch={batch_id - 1}"
        if batch_id and _exists(spark, seen):
            newest = max((x for x in (newest, spark.read.schema("us long").parquet(seen).first()["us"]) if x is not None), default=None)
        spark.createDataFrame([(newest,)], "us long").coalesce(1).write.mode("overwrite").parquet(f"{view}/newest/batch={batch_id}")
        if newest is None:
            return
        for name, df in live_view(spark, view, newest).items():
            df.coalesce(1).write.mode("overwrite").json(f"{out}/{name}/batch={batch_id}")

    return (packets.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "30 seconds"})).start())


def with_counters(packets: DataFrame, name: str = "packets") -> DataFrame:
    """Packets and bytes per micro-batch as observed metrics."""
    return packets.observe(name, F.count(F.lit(1)).alias("packets"), F.sum(F.col("size").cast("long")).alias("bytes"))


def late_rows(progress) -> int:
    """Rows dropped by the watermark in one progress report."""
    return sum(op.numRowsDroppedByWatermark for op in progress.stateOperators)


class RateListener(StreamingQueryListener):
    """Keeps totals and the processing rate per minute of the streams it is added for."""

    def __init__(self):
        self.packets = self.bytes = self.late = 0
        self.rate_per_minute = 0.0

    def onQueryStarted(self, event):
        log.info("stream %s started", event.name or event.id)

    def onQueryProgress(self, event):
        p = event.progress
        self.rate_per_minute = (p.processedRowsPerSecond or 0.0) * 60
        self.late += late_rows(p)
        for row in p.observedMetrics.values():
            self.packets += row["packets"] or 0
            self.bytes += row["bytes"] or 0

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        log.info("stream %s ended after %d packets", event.id, self.packets)


def run_to_end(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all available input and return what it wrote.

    The output lies in the shared checkpoint folder, a folder per run. In complete mode the last
    micro-batch holds everything.
    """
    spark: SparkSession = stream.sparkSession
    base = f"{ensure_checkpoint_dir(spark)}/streams/{uuid.uuid4().hex}"

    def one(batch: DataFrame, batch_id: int) -> None:
        target = f"{base}/out/all" if mode == "complete" else f"{base}/out/batch={batch_id}"
        batch.write.mode("overwrite").parquet(target)

    query = (stream.writeStream.foreachBatch(one).outputMode(mode).option("checkpointLocation", f"{base}/state")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    if not _exists(spark, f"{base}/out"):  # no batch was written
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{base}/out")
