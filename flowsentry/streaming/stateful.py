"""Keyed state for what windows cannot express: suppression, early alerts, TCP state, features.

Two levels. First the rows of a key are gathered by slices of ten seconds with Spark's own windowed aggregation,
keyed by (key, slice): a source that sends a third of all traffic is spread over its slices, rows are combined
before the shuffle, and state is dropped with each slice. A slice is handed on, sorted by (us, id), when the
watermark has passed it, so a micro-batch gives the second level all slices up to a moment and none later. There
a small state per key (totals, the open session, the last alert) takes the slices in order; it holds no rows. So
results come one lateness and at most one slice after the event, do not depend on how rows were split into
micro-batches, and equal those of the batch operators. Rows pass between Spark and Python as rows: a key may have one
slice or none, and a data frame for each key costs more than all that is done with it.

The watermark is set once, on the packets, before any filter: a query's watermark is the least of all it has, so one
below a filter would stand still while nothing passes the filter. `stream_suppress` refuses candidates without one.
"""

from __future__ import annotations

import json
import sys
from collections import Counter, deque
from collections.abc import Callable, Iterator
from functools import reduce
from operator import itemgetter

import numpy as np
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame, GroupedData, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..functions.patterns import PATTERNS
from ..functions.scalars import fixed, from_us, hour_of_day, is_weekend, ratio_guarded, words
from ..operators import alerts, rules
from ..operators.anomaly import Forest, score
from ..operators.features import WINDOW_S
from ..operators.flood import TARGETS_SHOWN, flood_severity
from ..operators.flows import FLOW, KEEP, STATES, SYN_RECEIVED, SYN_SENT, canonical, slice_effect
from ..operators.ordered import SLICE_US
from ..operators.payload import is_suspicious, match_columns
from ..operators.scan import PORTS_SHOWN, attempt_columns, is_attempt, scan_severity
from ..operators.scan import TARGETS_SHOWN as SCAN_TARGETS_SHOWN
from ..params import CustomRule, Thresholds
from ..schema import DDOS, PORT_SCAN, SECOND_US, SUSPICIOUS_PAYLOAD
from .windows import LATENESS, on_time, only, watermarked

register_pickle_by_value(sys.modules[__name__])

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark) -> None:
    """State in RocksDB. A micro-batch commits what it has changed; whole snapshots follow in the background."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def in_slices(timed: DataFrame, keys: list[str], width_us: int = SLICE_US) -> DataFrame:
    """One row per key and slice of time that the watermark has passed, with the columns `us`, `id` and the others as
    arrays in the order of (us, id); `timestamp` is the slice's last moment and carries the watermark on."""
    names = ["us", "id", *(c for c in timed.columns if c not in ("us", "id", "timestamp", *keys))]
    slices = timed.groupBy(*keys, F.window("timestamp", f"{width_us} microseconds").alias("_slice")).agg(
        F.sort_array(F.collect_list(F.struct(*names))).alias("_rows"))
    return slices.select(*keys, F.window_time("_slice").alias("timestamp"), *[F.col("_rows")[n].alias(n) for n in names])


class Value:
    """A value of a key's state. Each call of the state store is a message to the JVM and back: what is as it was read
    is not written again."""

    def __init__(self, handle, name: str, schema: str):
        self.state = handle.getValueState(name, schema)

    def get(self) -> tuple | None:
        self.read = self.state.get()
        return self.read

    def put(self, row: tuple | None) -> None:
        if row is None and self.read is not None:
            self.state.clear()
        elif row is not None and row != self.read:
            self.state.update(row)
        self.read = row


class InOrder(StatefulProcessor):
    """Takes the slices of a key in their order.

    `load` reads the key's state, `take` is called slice by slice, `store` writes the state back or drops what can no
    longer matter, and a timer calls `store` again at `due`.
    """

    names: list[str]  # what a slice holds: arrays, the first of which is `us`
    columns: list[str] | None = None  # the columns they lie in, if these have other names
    out: T.StructType
    width_us = SLICE_US

    def init(self, handle):
        self.handle = handle
        self.open(handle)

    def open(self, handle):
        """Declare the processor's own state."""

    def load(self) -> None:
        raise NotImplementedError

    def take(self, key, *columns: list) -> list[tuple]:
        """Rows to emit for one slice."""
        raise NotImplementedError

    def store(self, passed: int) -> None:
        """Write the state; no row up to the moment `passed` will follow."""
        raise NotImplementedError

    def due(self) -> int | None:
        """The moment at which `store` has something to drop, as of the last `store`."""
        return None

    def handleInputRows(self, key, rows, timerValues):
        slices = sorted(self._slices(rows), key=lambda r: -r[0][0])
        self.load()
        while slices:
            yield from self._rows(self.take(key, *slices.pop()))
        yield from self._rows(self._settle(key, timerValues))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.load()
        yield from self._rows(self._settle(key, timerValues))

    def _slices(self, rows) -> Iterator[tuple]:
        picked = None
        for row in rows:
            picked = picked or itemgetter(*map(row.__fields__.index, self.columns or self.names))
            yield picked(row)

    def ended(self, key, passed: int) -> list[tuple]:
        """Rows to emit for what no row after the moment `passed` can belong to any more; called before `store`."""
        return []

    def _settle(self, key, timerValues) -> list[tuple]:
        width = self.width_us
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        passed = watermark // width * width - 1
        found = self.ended(key, passed)
        self.store(passed)
        due = self.due()
        # the end of the slice in which it falls
        wanted = None if due is None else max((due // width + 1) * width, watermark) // 1000 + 1
        waiting = False
        for timer in list(self.handle.listTimers()):
            timer = timer[0] if isinstance(timer, tuple) else timer
            if wanted is not None and not waiting and watermark // 1000 < timer <= wanted:
                waiting = True  # one that comes sooner sets the next one
            else:
                self.handle.deleteTimer(timer)
        if wanted is not None and not waiting:
            self.handle.registerTimer(wanted)
        return found

    def _rows(self, found: list[tuple]) -> Iterator[Row]:
        return (Row(**dict(zip(self.out.names, values))) for values in found)

    def close(self):
        pass


class Suppress(InOrder):
    """Cooldown or deduplication per key."""

    def __init__(self, window_us: int, inclusive: bool, names: list[str], out: T.StructType):
        self.window_us, self.inclusive, self.names, self.out = window_us, inclusive, names, out

    def open(self, handle):
        self.kept = Value(handle, "last", "us long")

    def load(self):
        self.last = (self.kept.get() or (None,))[0]

    def take(self, key, *columns):
        fields, found = dict(zip(self.names, columns)), []
        for i, us in enumerate(columns[0]):
            waited = None if self.last is None else us - self.last
            if waited is None or waited > self.window_us or self.inclusive and waited == self.window_us:
                self.last = us
                row = dict(zip(self.keys, key)) | {n: c[i] for n, c in fields.items()}
                found.append(tuple(row[n] for n in self.out.names))
        return found

    def store(self, passed):
        if self.last is not None and passed > self.last + self.window_us:
            self.last = None
        self.kept.put(None if self.last is None else (self.last,))

    def due(self):
        return None if self.last is None else self.last + self.window_us + 1


def stream_suppress(candidates: DataFrame, keys: list[str], window_seconds: int, inclusive: bool = False) -> DataFrame:
    """Streaming twin of operators.suppress.thin; needs `us`, `id`, non-null keys, and `timestamp` with a watermark."""
    watch = _suppress(candidates, keys, window_seconds, inclusive)
    return in_slices(candidates, keys).groupBy(*keys).transformWithState(watch, watch.out, "append", "eventTime")


def _suppress(candidates: DataFrame, keys: list[str], window_seconds: int, inclusive: bool = False) -> Suppress:
    if not watermarked(candidates):
        raise ValueError("set the watermark on the packets, before they are filtered (windows.on_time)")
    out = T.StructType([T.StructField(f.name, f.dataType) for f in candidates.schema if f.name != "timestamp"])
    names = ["us", "id", *(f.name for f in out if f.name not in ("us", "id", *keys))]
    watch = Suppress(window_seconds * SECOND_US, inclusive, names, out)
    watch.keys = list(keys)
    return watch


def _longs(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.LongType()) for n in names]


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


SCAN_OUT = T.StructType(_longs("us", "id", "session_us", "ports", "targets", "attempts", "failures")
                        + _strings("src_ip", "dst_ip") + [
                            T.StructField("scanned_ports", T.ArrayType(T.IntegerType())),
                            T.StructField("target_ips", T.ArrayType(T.StringType()))])


class ScanWatch(InOrder):
    """Running scan session of a source; emits the attempt that passes threshold and cooldown.

    All ports and targets lie in map state, and only those of the slice at hand are looked up; the first few, which
    an alert lists, lie in the totals.
    """

    names, out = ["us", "id", "dst_ip", "dst_port", "failed"], SCAN_OUT

    def __init__(self, threshold: int, gap_us: int, cooldown_us: int):
        self.threshold, self.gap_us, self.cooldown_us = threshold, gap_us, cooldown_us

    def open(self, handle):
        self.totals = Value(
            handle, "totals", "start long, last long, attempts long, failures long, ports long, targets long, "
                      "first_ports array<int>, first_targets array<string>")
        self.cooled = Value(handle, "fired", "us long")
        self.seen = {"ports": handle.getMapState("ports", "port int", "seen boolean"),
                     "targets": handle.getMapState("targets", "ip string", "seen boolean")}

    def load(self):
        totals = self.totals.get()
        if totals is not None:
            *numbers, ports, targets = totals
            self.start, self.last, self.attempts, self.failures, *counts = numbers
            self.count = dict(zip(("ports", "targets"), counts))
            self.shown = {"ports": list(ports), "targets": list(targets)}
        else:
            self.start = self.last = None
        self.fired = (self.cooled.get() or (None,))[0]
        self.met = set()

    def _clear(self):
        self.totals.put(None)
        for state in self.seen.values():
            state.clear()
        self.met = set()

    def _meet(self, kind, value, most):
        if (kind, value) in self.met:
            return
        self.met.add((kind, value))
        if not self.seen[kind].containsKey((value,)):
            self.seen[kind].updateValue((value,), (True,))
            self.count[kind] += 1
            if len(self.shown[kind]) < most:
                self.shown[kind].append(value)

    def take(self, key, *columns):
        found = []
        for us, id_, ip, port, failed in zip(*columns):
            if self.last is None or us - self.last > self.gap_us:
                self._clear()
                self.start, self.attempts, self.failures = us, 0, 0
                self.count, self.shown = {"ports": 0, "targets": 0}, {"ports": [], "targets": []}
            self.last, self.attempts, self.failures = us, self.attempts + 1, self.failures + failed
            self._meet("ports", port, PORTS_SHOWN)
            self._meet("targets", ip, SCAN_TARGETS_SHOWN)
            if self.count["ports"] >= self.threshold and (self.fired is None or us - self.fired > self.cooldown_us):
                self.fired = us
                found.append((us, id_, self.start, self.count["ports"], self.count["targets"], self.attempts,
                              self.failures, key[0], ip, sorted(self.shown["ports"]), sorted(self.shown["targets"])))
        return found

    def store(self, passed):
        if self.last is not None and passed > self.last + self.gap_us:
            self._clear()
            self.last = None
        elif self.last is not None:
            self.totals.put((self.start, self.last, self.attempts, self.failures, self.count["ports"],
                             self.count["targets"], self.shown["ports"], self.shown["targets"]))
        if self.fired is not None and passed > self.fired + self.cooldown_us:
            self.fired = None
        self.cooled.put(None if self.fired is None else (self.fired,))

    def due(self):
        ends = [] if self.last is None else [self.last + self.gap_us + 1]
        ends += [] if self.fired is None else [self.fired + self.cooldown_us + 1]
        return min(ends, default=None)


SESSION_OUT = T.StructType(_longs("ports", "targets", "attempts", "failed", "first_us", "last_us") + _strings("src_ip"))


class ScanSessions(ScanWatch):
    """Emits the scan sessions of a source once they are over."""

    out = SESSION_OUT

    def __init__(self, gap_us: int):
        super().__init__(0, gap_us, 0)

    def _session(self, key):
        return (self.count["ports"], self.count["targets"], self.attempts, self.failures, self.start, self.last, key[0])

    def take(self, key, *columns):
        found = []
        for row in zip(*columns):
            if self.last is not None and row[0] - self.last > self.gap_us:
                found.append(self._session(key))
            super().take(key, *[[x] for x in row])
        return found

    def ended(self, key, passed):
        return [self._session(key)] if self.last is not None and passed > self.last + self.gap_us else []


def _attempt_rows(packets: DataFrame, lateness: str) -> DataFrame:
    rows = only(on_time(packets, lateness), is_attempt()).select(*attempt_columns(), "timestamp")
    return rows.withColumn("dst_port", F.coalesce("dst_port", F.lit(-1)))


def _attempts(packets: DataFrame, lateness: str) -> GroupedData:
    return in_slices(_attempt_rows(packets, lateness), ["src_ip"]).groupBy("src_ip")


def _scan_watch(p: Thresholds) -> ScanWatch:
    return ScanWatch(p.port_scan_threshold, p.scan_time_window * SECOND_US, p.alert_cooldown * SECOND_US)


def _scanned_ports(ports: Column) -> Column:
    return F.array_sort(F.transform(ports, lambda x: F.nullif(x, F.lit(-1))))


def stream_scan_sessions(packets: DataFrame, p: Thresholds = Thresholds(), lateness: str = LATENESS) -> DataFrame:
    """Closed scan sessions per source with exact distinct ports and targets."""
    return _attempts(packets, lateness).transformWithState(
        ScanSessions(p.scan_time_window * SECOND_US), SESSION_OUT, "append", "eventTime")


def stream_scan_alerts(packets: DataFrame, p: Thresholds = Thresholds(), lateness: str = LATENESS) -> DataFrame:
    """Scan alerts when the threshold is reached, after the cooldown. A missing port is one distinct port."""
    found = _attempts(packets, lateness).transformWithState(_scan_watch(p), SCAN_OUT, "append", "eventTime")
    return found.withColumn("scanned_ports", _scanned_ports(F.col("scanned_ports")))


def stream_scan_records(packets: DataFrame, p: Thresholds = Thresholds(), lateness: str = LATENESS) -> DataFrame:
    """Streaming twin of operators.scan.scan_alerts, as common alert records."""
    return stream_scan_alerts(packets, p, lateness).select(*_scan_alert(F.col))


def _scan_alert(c: Callable[[str], Column], ports: Callable[[Column], Column] = lambda x: x) -> list[Column]:
    """The alert of a scan whose columns `c` gives; `ports` puts in order what it lists."""
    duration = (c("us") - c("session_us")) / F.lit(1e6)
    rate = ratio_guarded(c("attempts"), duration)
    details = F.struct(ports(c("scanned_ports")).alias("scanned_ports"), c("target_ips").alias("target_ips"),
                       c("attempts").alias("scan_count"), c("failures").alias("failed_connections"),
                       duration.alias("scan_duration"), rate.alias("scan_rate"))
    text = F.format_string("Port scan detected from %s. Scanned %d ports on %d target(s).",
                           c("src_ip"), c("ports"), c("targets"))
    return alerts.alert_columns(c("id"), c("us"), alerts.SCAN, F.lit(PORT_SCAN),
                                scan_severity(c("ports"), c("targets"), rate), c("src_ip"), c("dst_ip"), text, details)


def stream_rule_alerts(packets: DataFrame, custom: list[CustomRule], p: Thresholds = Thresholds(),
                       lateness: str = LATENESS) -> DataFrame:
    """Streaming twin of operators.rules.rule_alerts."""
    return rules.as_alerts(stream_suppress(
        rules.timed_matches(on_time(packets, lateness), custom), ["rule_name", "src_ip"], p.alert_cooldown))


FLOOD_OUT = T.StructType(_longs("us", "id", "in_window", "packets", "bytes", "targets", "first_us")
                         + _strings("src_ip") + [T.StructField("target_ips", T.ArrayType(T.StringType()))])


class FloodWatch(InOrder):
    """Rolling rate of a source; emits the packet that passes threshold and cooldown.

    A slice is taken as arrays, and its rows are looked at one by one only where the rolling count is over the
    threshold. The totals since a source was first seen stay, as the batch operator's do, unless `forget_us` ends
    them that long after its last packet; the window does not.
    """

    names, out = ["us", "id", "dst_ip", "size"], FLOOD_OUT

    def __init__(self, least: float, window_us: int, cooldown_us: int, shown: int, forget_us: int | None = None):
        self.least, self.window_us, self.cooldown_us, self.most, self.forget_us = (
            least, window_us, cooldown_us, shown, forget_us)

    def open(self, handle):
        self.totals = Value(
            handle, "totals", "packets long, bytes long, targets long, first long, last long, fired long, shown array<string>")
        self.recent = Value(handle, "window", "us binary")
        self.seen = handle.getMapState("targets", "ip string", "seen boolean")

    def load(self):
        self.packets, self.bytes, self.targets, self.first, self.last, self.fired, self.shown = (
            self.totals.get() or (0, 0, 0, None, None, None, []))
        self.shown = list(self.shown)
        self.window = np.frombuffer((self.recent.get() or (b"",))[0], np.int64)
        self.met = set()

    def take(self, key, us, ids, ips, sizes):
        if self.forget_us is not None and self.last is not None and us[0] - self.last > self.forget_us:
            self._forget()
        new = []  # places in the slice at which a target is met first
        for i, ip in enumerate(ips):
            if ip not in self.met:
                self.met.add(ip)
                if not self.seen.containsKey((ip,)):
                    self.seen.updateValue((ip,), (True,))
                    new.append(i)
        at = np.array(us)
        times = np.concatenate([self.window, at])
        in_window = len(self.window) + 1 + np.arange(len(at)) - np.searchsorted(times, at - self.window_us)
        first = us[0] if self.first is None else self.first
        found, shown, over = [], 0, np.flatnonzero(in_window > self.least)
        if len(over):
            total = np.cumsum(sizes)
        while len(over):
            if self.fired is not None:
                over = over[np.searchsorted(at[over], self.fired + self.cooldown_us, "right"):]
                if not len(over):
                    break
            i = int(over[0])
            self.fired = us[i]
            shown = sum(x <= i for x in new)
            listed = (self.shown + [ips[x] for x in new[:shown]])[:self.most]
            found.append((us[i], ids[i], int(in_window[i]), self.packets + i + 1, self.bytes + int(total[i]),
                          self.targets + shown, first, key[0], sorted(listed)))
        self.packets, self.bytes, self.targets = self.packets + len(us), self.bytes + sum(sizes), self.targets + len(new)
        self.shown = (self.shown + [ips[x] for x in new[:self.most]])[:self.most]
        self.first, self.last = first, us[-1]
        self.window = times[np.searchsorted(times, us[-1] - self.window_us):]
        return found

    def _forget(self):
        self.totals.put(None)
        self.recent.put(None)
        self.seen.clear()
        self.load()

    def store(self, passed):
        if self.last is not None and self.forget_us is not None and passed > self.last + self.forget_us:
            self._forget()
        if self.last is None:
            return
        self.window = self.window[np.searchsorted(self.window, passed - self.window_us):]
        self.recent.put((self.window.tobytes(),) if len(self.window) else None)
        self.totals.put((self.packets, self.bytes, self.targets, self.first, self.last, self.fired, self.shown))

    def due(self):
        if len(self.window):
            return int(self.window[-1]) + self.window_us + 1
        return None if self.last is None or self.forget_us is None else self.last + self.forget_us + 1


def _microseconds(seconds: int | None) -> int | None:
    return None if seconds is None else seconds * SECOND_US


def _flood_rows(packets: DataFrame, lateness: str) -> DataFrame:
    return on_time(packets.select("timestamp", F.unix_micros("timestamp").alias("us"), "id", "src_ip", "dst_ip",
                                  F.col("size").cast("long").alias("size")), lateness)


def _flood_watch(p: Thresholds) -> FloodWatch:
    return FloodWatch(p.ddos_threshold * p.ddos_time_window, p.ddos_time_window * SECOND_US,
                      p.alert_cooldown * SECOND_US, TARGETS_SHOWN, _microseconds(p.forget_source_after))


def stream_flood_alerts(packets: DataFrame, p: Thresholds = Thresholds(), lateness: str = LATENESS) -> DataFrame:
    """Streaming twin of operators.flood.flood_alerts, as common alert records. `p.forget_source_after` bounds the
    state: a source that comes back after so long a silence begins anew."""
    fired = in_slices(_flood_rows(packets, lateness), ["src_ip"]).groupBy("src_ip").transformWithState(
        _flood_watch(p), FLOOD_OUT, "append", "eventTime")
    return fired.select(*_flood_alert(F.col, p))


def _flood_alert(c: Callable[[str], Column], p: Thresholds) -> list[Column]:
    """The alert of a flood whose columns `c` gives."""
    n = c("in_window") if p.rate_history_cap is None else F.least(c("in_window"), F.lit(p.rate_history_cap))
    rate, duration = n / F.lit(float(p.ddos_time_window)), (c("us") - c("first_us")) / F.lit(1e6)
    severity = flood_severity(rate, c("targets"), ratio_guarded(c("bytes"), duration))
    details = F.struct(
        rate.alias("connection_rate"), c("packets").alias("total_connections"), c("bytes").alias("bytes_sent"),
        c("targets").alias("target_count"), c("target_ips").alias("target_ips"), duration.alias("attack_duration"))
    text = F.format_string("Potential DDoS attack detected from %s. Connection rate: %s connections/second.",
                           c("src_ip"), fixed(rate, 1))
    return alerts.alert_columns(c("id"), c("us"), alerts.FLOOD, F.lit(DDOS), severity, c("src_ip"), F.lit(""), text,
                                details)


PAYLOAD_OUT = T.StructType(_longs("us", "id") + _strings(
    "src_ip", "dst_ip", "protocol", "category", "severity", "pattern") + _longs("dst_port", "payload_size"))


class PayloadWatch(InOrder):
    """At most one alert per packet: the first matched category whose cooldown at this source has passed."""

    names, out = ["us", "id", "dst_ip", "protocol", "dst_port", "payload_size", "found"], PAYLOAD_OUT

    def __init__(self, cooldown_us: int):
        self.cooldown_us = cooldown_us

    def open(self, handle):
        self.cooled = Value(handle, "fired", "categories map<string, long>")

    def load(self):
        self.fired = dict((self.cooled.get() or ({},))[0])  # one entry per category

    def take(self, key, *columns):
        found = []
        for us, id_, ip, protocol, port, size, matched in zip(*columns):
            for m in json.loads(matched):
                last = self.fired.get(m["category"])
                if last is None or us - last > self.cooldown_us:
                    self.fired[m["category"]] = us
                    found.append((us, id_, key[0], ip, protocol, m["category"], m["severity"], m["pattern"], port, size))
                    break
        return found

    def store(self, passed):
        self.fired = {k: us for k, us in self.fired.items() if passed <= us + self.cooldown_us}
        self.cooled.put((self.fired,) if self.fired else None)

    def due(self):
        return min(self.fired.values()) + self.cooldown_us + 1 if self.fired else None


def stream_payload_matches(packets: DataFrame, patterns: dict = PATTERNS, lateness: str = LATENESS) -> DataFrame:
    """Streaming twin of operators.payload.payload_matches, with `timestamp` and its watermark."""
    timed = only(on_time(packets, lateness), is_suspicious(packets.columns, patterns))
    return timed.select(*match_columns(packets.columns, patterns), "timestamp")


def _payload_rows(packets: DataFrame, patterns: dict, lateness: str) -> DataFrame:
    return stream_payload_matches(packets, patterns, lateness).select(
        "timestamp", "us", "id", "src_ip", "dst_ip", "protocol",
        F.coalesce("dst_port", F.lit(-1)).cast("long").alias("dst_port"),
        F.col("payload_size").cast("long").alias("payload_size"), F.to_json("matches").alias("found"))


def stream_payload_alerts(packets: DataFrame, p: Thresholds = Thresholds(), patterns: dict = PATTERNS,
                          lateness: str = LATENESS) -> DataFrame:
    """Streaming twin of operators.payload.payload_alerts, as common alert records."""
    fired = in_slices(_payload_rows(packets, patterns, lateness), ["src_ip"]).groupBy("src_ip").transformWithState(
        PayloadWatch(p.alert_cooldown * SECOND_US), PAYLOAD_OUT, "append", "eventTime")
    return fired.select(*_payload_alert(F.col))


def _payload_alert(c: Callable[[str], Column]) -> list[Column]:
    """The alert of a payload match whose columns `c` gives."""
    text = F.concat(F.lit("Suspicious "), words(c("category")), F.lit(" pattern detected in traffic from "),
                    c("src_ip"), F.lit("."))
    details = F.struct(
        c("category").alias("pattern_category"), F.nullif(c("dst_port"), F.lit(-1)).cast("int").alias("target_port"),
        c("protocol").alias("protocol"), c("payload_size").cast("int").alias("payload_size"),
        F.substring(c("pattern"), 1, 100).alias("matched_pattern"))
    return alerts.alert_columns(c("id"), c("us"), alerts.PAYLOAD, F.lit(SUSPICIOUS_PAYLOAD), c("severity"), c("src_ip"),
                                c("dst_ip"), text, details)


class Prefixed:
    """A processor's handle for one of several watches, whose states are told apart by their names."""

    def __init__(self, handle, prefix: str):
        self.handle, self.prefix = handle, prefix

    def getValueState(self, name, *schema):
        return self.handle.getValueState(self.prefix + name, *schema)

    def getMapState(self, name, *schemas):
        return self.handle.getMapState(self.prefix + name, *schemas)

    def __getattr__(self, name):
        return getattr(self.handle, name)


class Detectors(StatefulProcessor):
    """Several watches in one processor, each with keys of its own: the first part of a key is the watch's name."""

    def __init__(self, watches: dict[str, InOrder]):
        self.watches = watches

    def init(self, handle):
        for name, watch in self.watches.items():
            watch.init(Prefixed(handle, f"{name}_"))

    def handleInputRows(self, key, rows, timerValues):
        for row in self.watches[key[0]].handleInputRows(key[1:], rows, timerValues):
            yield Row(**{key[0]: row})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        for row in self.watches[key[0]].handleExpiredTimer(key[1:], timerValues, expiredTimerInfo):
            yield Row(**{key[0]: row})

    def close(self):
        pass


def stream_alerts(packets: DataFrame, p: Thresholds = Thresholds(), custom: list[CustomRule] | None = None,
                  lateness: str = LATENESS) -> DataFrame:
    """Alerts of every detector as one stream, each after its own cooldown; a micro-batch holds what the
    watermark has passed, so the batches follow one another in event time.

    The rows of all detectors are gathered and watched together: each partition of a state costs every micro-batch the
    same, whatever it holds, so one state with a key for each detector and source stands for one state per detector."""
    packets = on_time(packets, lateness)
    offered = {"scan": _attempt_rows(packets, lateness), "flood": _flood_rows(packets, lateness),
               "payload": _payload_rows(packets, PATTERNS, lateness)}
    watches = {"scan": _scan_watch(p), "flood": _flood_watch(p), "payload": PayloadWatch(p.alert_cooldown * SECOND_US)}
    as_alert = {"scan": lambda c: _scan_alert(c, _scanned_ports), "flood": lambda c: _flood_alert(c, p),
                "payload": _payload_alert}
    if custom:
        offered["rule"] = rules.timed_matches(packets, custom)
        watches["rule"] = _suppress(offered["rule"], ["src_ip", "rule_name"], p.alert_cooldown)
        as_alert["rule"] = rules.rule_alert
    keys, common = ["detector", "src_ip", "rule_name"], ["us", "id"]
    parts, columns = [], []
    for name, rows in offered.items():
        own = [n for n in watches[name].names if n not in common]
        watches[name].columns = [n if n in common else f"{name}_{n}" for n in watches[name].names]
        columns += [(name, n) for n in own]
        parts.append(rows.select(
            "timestamp", F.lit(name).alias("detector"), "src_ip",
            (F.col("rule_name") if name == "rule" else F.lit("")).alias("rule_name"), *common,
            F.struct(*own).alias(name)))
    together = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    slices = in_slices(together, keys)
    slices = slices.select(*keys, "timestamp", *common, *[
        F.when(F.col("detector") == name, F.col(name)[n]).alias(f"{name}_{n}") for name, n in columns])
    out = T.StructType([T.StructField(name, watch.out) for name, watch in watches.items()])
    fired = slices.groupBy(*keys).transformWithState(Detectors(watches), out, "append", "eventTime")
    records = [F.when(F.col(name).isNotNull(), F.struct(*as_alert[name](lambda n, name=name: F.col(name)[n])))
               for name in watches]
    return fired.select(F.coalesce(*records).alias("alert")).select("alert.*")


FLOW_OUT = T.StructType(
    _longs("first_us", "last_us", "packet_count", "bytes_sent", "bytes_received")
    + _strings("src_ip", "dst_ip", "protocol", "state")
    + [T.StructField(n, T.IntegerType()) for n in ("src_port", "dst_port")])


class FlowStates(InOrder):
    """One open flow per key; emitted with its TCP state when it has been idle too long.

    A slice comes as its totals and its effect on the state (see operators.flows), not as packets.
    """

    fields = ["first_us", "last_us", "packets", "bytes_fwd", "bytes_rev", "first_fwd", "begin", "mid_handshake", "mid_other"]
    names, out = ["entry"], FLOW_OUT

    def __init__(self, gap_us: int):
        self.gap_us = gap_us

    def open(self, handle):
        self.flow = Value(
            handle, "flow", "first long, last long, packets long, fwd_bytes long, rev_bytes long, fwd boolean, state int")

    def _closed(self, key, f):
        first, last, packets, fwd_bytes, rev_bytes, fwd, state = f
        a, b = (key[0], key[1]), (key[2], key[3])
        src, dst = (a, b) if fwd else (b, a)
        sent, received = (fwd_bytes, rev_bytes) if fwd else (rev_bytes, fwd_bytes)
        port = lambda x: None if x < 0 else int(x)
        return (first, last, packets, sent, received, src[0], dst[0], key[4],
                STATES[state] if key[4] == "TCP" else "ACTIVE", port(src[1]), port(dst[1]))

    def handleInputRows(self, key, rows, timerValues):
        slices = sorted(self._slices(rows))  # each its `fields` in one array: a column costs Python more than its value
        self.load()
        found = []
        for first, last, packets, fwd_bytes, rev_bytes, fwd, begin, shaking, other in slices:
            f = self.open_flow
            if f is not None and first - f[1] > self.gap_us:
                found.append(self._closed(key, f))
                f = None
            if f is None:
                f = [first, last, 0, 0, 0, bool(fwd), begin]
            else:
                moved = shaking if f[6] in (SYN_SENT, SYN_RECEIVED) else other
                f[6] = f[6] if moved == KEEP else moved
            f[1], f[2], f[3], f[4] = last, f[2] + packets, f[3] + fwd_bytes, f[4] + rev_bytes
            self.open_flow = f
        yield from self._rows(found + self._settle(key, timerValues))

    def ended(self, key, passed):
        f = self.open_flow
        return [self._closed(key, f)] if f is not None and passed > f[1] + self.gap_us else []

    def load(self):
        f = self.flow.get()
        self.open_flow = None if f is None else list(f)

    def store(self, passed):
        f = self.open_flow
        if f is not None and passed > f[1] + self.gap_us:
            self.open_flow = None
        self.flow.put(None if self.open_flow is None else tuple(x if isinstance(x, bool) else int(x) for x in f))

    def due(self):
        return None if self.open_flow is None else self.open_flow[1] + self.gap_us + 1


def stream_flow_states(packets: DataFrame, p: Thresholds = Thresholds(), lateness: str = LATENESS) -> DataFrame:
    """Closed flows with the same columns and TCP state as the batch operator."""
    timed = on_time(packets, lateness)
    rows = canonical(timed, "timestamp").withColumn("size", F.col("size").cast("long"))
    slices = in_slices(rows, FLOW)
    entry = slice_effect(F.arrays_zip("us", "size", "fwd", "syn", "ack", "fin", "rst"))
    slices = slices.select(*FLOW, "timestamp", entry.alias("e")).select(
        *FLOW, "timestamp", F.array(*[F.col(f"e.{n}").cast("long") for n in FlowStates.fields]).alias("entry"))
    return slices.groupBy(*FLOW).transformWithState(
        FlowStates(p.connection_timeout * SECOND_US), FLOW_OUT, "append", "eventTime")


FEATURE_OUT = T.StructType(
    _longs("us", "id") + _strings("src_ip", "dst_ip", "protocol", "tcp_flags")
    + _longs("packet_size", "payload_size", "src_port", "dst_port")
    + [T.StructField(n, T.DoubleType()) for n in ("packets_per_second", "bytes_per_second")]
    + _longs("unique_ports_accessed"))


#: Columns of `stream_features`.
FEATURES = T.StructType([*FEATURE_OUT, T.StructField("timestamp", T.TimestampType()),
                         T.StructField("hour_of_day", T.IntegerType()), T.StructField("is_weekend", T.BooleanType())])


class RecentActivity(InOrder):
    """The last 60 seconds of a source, read by each packet before it is added.

    How many packets a source has sent stays (it decides whether its rates count) until `forget_us` after its last
    one, the packets do not.
    """

    names = ["us", "id", "dst_ip", "protocol", "tcp_flags", "packet_size", "payload_size", "src_port", "dst_port"]
    out = FEATURE_OUT

    def __init__(self, forget_us: int | None = None):
        self.forget_us = forget_us

    def open(self, handle):
        self.counted = Value(handle, "seen", "n long, last long")
        self.window = Value(handle, "recent", "us binary, size binary, port binary")

    def load(self):
        self.seen, self.last = self.counted.get() or (0, None)
        parts = self.window.get() or (b"", b"", b"")
        self.recent = deque(zip(*[np.frombuffer(x, np.int64).tolist() for x in parts]))
        self.ports = Counter(x[2] for x in self.recent)
        self.total = sum(x[1] for x in self.recent)

    def take(self, key, *columns):
        width, recent, ports, found = WINDOW_S * SECOND_US, self.recent, self.ports, []
        if self.forget_us is not None and self.last is not None and columns[0][0] - self.last > self.forget_us:
            self.seen = 0
        for us, id_, ip, protocol, flags, size, payload, src_port, dst_port in zip(*columns):
            while recent and us - recent[0][0] > width:
                _, gone, port = recent.popleft()
                self.total -= gone
                ports[port] -= 1
                if not ports[port]:
                    del ports[port]
            warm = self.seen > 1
            found.append((us, id_, key[0], ip, protocol, flags, size, payload, src_port, dst_port,
                          len(recent) / WINDOW_S if warm else 0.0, self.total / WINDOW_S if warm else 0.0,
                          len(ports) if warm else 0))
            self.seen += 1
            self.total += size
            ports[dst_port] += 1
            recent.append((us, size, dst_port))
        self.last = columns[0][-1]
        return found

    def store(self, passed):
        while self.recent and passed - self.recent[0][0] > WINDOW_S * SECOND_US:
            self.recent.popleft()
        self.window.put(tuple(np.array(x, np.int64).tobytes() for x in zip(*self.recent)) if self.recent else None)
        if self.last is not None and self.forget_us is not None and passed > self.last + self.forget_us:
            self.seen, self.last = 0, None
        self.counted.put(None if self.last is None else (self.seen, self.last))

    def due(self):
        if self.recent:
            return self.recent[-1][0] + WINDOW_S * SECOND_US + 1
        return None if self.last is None or self.forget_us is None else self.last + self.forget_us + 1


def stream_features(packets: DataFrame, lateness: str = LATENESS, forget_source_after: int | None = None) -> DataFrame:
    """Streaming twin of operators.features.features: every packet with all inputs of the feature vector."""
    c = F.col
    port = lambda name: F.coalesce(c(name), F.lit(0)).cast("long").alias(name)
    rows = packets.select(
        "id", "timestamp", F.unix_micros("timestamp").alias("us"), "src_ip", "dst_ip", "protocol",
        F.coalesce("tcp_flags", F.lit("")).alias("tcp_flags"), c("size").cast("long").alias("packet_size"),
        c("payload_size").cast("long").alias("payload_size"), port("src_port"), port("dst_port"))
    found = in_slices(on_time(rows, lateness), ["src_ip"]).groupBy("src_ip").transformWithState(
        RecentActivity(_microseconds(forget_source_after)), FEATURE_OUT, "append", "eventTime")
    moment: Column = from_us(c("us"))
    return found.select("*", moment.alias("timestamp"), hour_of_day(moment).alias("hour_of_day"),
                        is_weekend(moment).alias("is_weekend"))


def stream_scores(packets: DataFrame, forest: Forest, lateness: str = LATENESS) -> DataFrame:
    """Features of a stream with the anomaly score of a fitted model."""
    return score(stream_features(packets, lateness), forest)
