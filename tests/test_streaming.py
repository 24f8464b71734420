"""Streams over several micro-batches give what the batch operators give."""

import json
from dataclasses import replace

import brute
import pytest
from brute import S, frame, packet, rel
from pyspark.sql import functions as F

from flowsentry.operators import alerts as al
from flowsentry.operators import anomaly, baseline, features, flood, flows, payload, scan
from flowsentry.operators.suppress import thin
from flowsentry.params import CustomRule, Thresholds
from flowsentry.plans import pipeline
from flowsentry.sources import tables
from flowsentry.streaming import live, stateful, windows

P = Thresholds(port_scan_threshold=3)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Packets in time order, one file per quarter, and a late sentinel that lets everything expire."""
    import time
    stateful.use_rocksdb(spark)
    path = tmp_path_factory.mktemp("stream")
    ps = brute.random_packets(400, 11, 8000, hot=0.5)
    for i in range(4):
        part = ps[i * 100:(i + 1) * 100]
        frame(spark, part).coalesce(1).write.mode("append").parquet(str(path))
        time.sleep(1.1)
    return str(path), ps


@pytest.fixture(scope="module")
def shuffled(spark, tmp_path_factory):
    """The same packets in five files, each row up to nine minutes later than its place, and then a file of a much
    later moment, behind which everything is due."""
    import random
    import time
    stateful.use_rocksdb(spark)
    path = tmp_path_factory.mktemp("shuffled")
    ps = brute.random_packets(400, 11, 8000, hot=0.5)
    rng = random.Random(3)
    arrival = {p["id"]: p["us"] + rng.randrange(540) * S for p in ps}
    edge = (max(arrival.values()) - ps[0]["us"]) / 5
    for i in range(5):
        part = [p for p in ps if i * edge <= arrival[p["id"]] - ps[0]["us"] <= (i + 1) * edge]
        rng.shuffle(part)
        frame(spark, part).coalesce(1).write.mode("append").parquet(str(path))
        time.sleep(1.1)
    end = [{**packet(-1, 90_000 * S, dport=9999, flags="SYN"), "src": "198.51.100.1"}]
    frame(spark, end).coalesce(1).write.mode("append").parquet(str(path))
    return str(path), ps


def stream(spark, folder):
    return tables.stream_packets(spark, folder, files_per_trigger=1)


def test_suppression(spark, shuffled):
    path, ps = shuffled
    s = windows.on_time(stream(spark, path)).select("id", "timestamp", F.unix_micros("timestamp").alias("us"), "src_ip")
    with pytest.raises(ValueError, match="watermark"):
        stateful.stream_suppress(stream(spark, path).select("id", "src_ip"), ["src_ip"], 120)
    got = live.run_to_end(stateful.stream_suppress(s, ["src_ip"], 120)).collect()
    b = frame(spark, ps).select("id", F.unix_micros("timestamp").alias("us"), "src_ip")
    assert sorted((r.us, r.id) for r in got) == sorted((r.us, r.id) for r in thin(b, ["src_ip"], 120).collect())


def test_scan_alerts(spark, shuffled):
    path, ps = shuffled
    got = live.run_to_end(stateful.stream_scan_alerts(stream(spark, path), P)).collect()
    assert sorted((r.id, r.ports, r.targets, r.attempts, r.failures) for r in got) == sorted(brute.scan(ps, 3))


def test_scan_records_equal_batch_with_ports_and_targets(spark, shuffled):
    path, ps = shuffled
    names = ["packet_id", "us", "severity", "source_ip", "destination_ip", "description", "details"]
    got = live.run_to_end(stateful.stream_scan_records(stream(spark, path), P)).select(*names).collect()
    want = scan.scan_alerts(frame(spark, ps), P).select(*names).collect()
    assert want and sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert all(json.loads(r.details)["scanned_ports"] for r in got)


def test_features(spark, shuffled):
    path, ps = shuffled
    got = {r.id: (round(r.packets_per_second, 9), round(r.bytes_per_second, 9), r.unique_ports_accessed)
           for r in live.run_to_end(stateful.stream_features(stream(spark, path))).collect()}
    assert got == brute.features(ps)


def test_flow_states(spark, shuffled):
    path, ps = shuffled
    got = {(r.src_ip, r.dst_ip, r.src_port, r.dst_port, r.protocol, rel(r.first_us), r.packet_count, r.bytes_sent, r.state)
           for r in live.run_to_end(stateful.stream_flow_states(stream(spark, path))).collect()}
    want = {(f["src"][0], f["dst"][0], f["src"][1], f["dst"][1], f["proto"], f["first"], f["n"], f["sent"], f["state"])
            for f in brute.flows(ps)}
    assert got == want


def test_flood_alerts(spark, shuffled):
    path, ps = shuffled
    p = Thresholds(ddos_threshold=0.05)
    names = ["packet_id", "us", "severity", "source_ip", "description", "details"]
    got = live.run_to_end(stateful.stream_flood_alerts(stream(spark, path), p)).select(*names).collect()
    want = flood.flood_alerts(frame(spark, ps), p).select(*names).collect()
    assert want and sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_payload_alerts(spark, shuffled):
    path, ps = shuffled
    names = ["packet_id", "us", "severity", "source_ip", "destination_ip", "description", "details"]
    got = live.run_to_end(stateful.stream_payload_alerts(stream(spark, path))).select(*names).collect()
    want = payload.payload_alerts(frame(spark, ps)).select(*names).collect()
    assert want and sorted(map(str, got)) == sorted(map(str, want))


def probe(spark, folder):
    """40 SYN packets of one source, 20 more two hours later, and one packet of two days later that no rule matches."""
    import time
    packets = [packet(i, i * S, dport=8000 + i, flags="SYN") for i in range(40)]
    packets += [packet(100 + i, 7200 * S + i * S, dport=8000 + i, flags="SYN") for i in range(20)]
    for part in (packets[:40], packets[40:], [{**packet(999, 172_800 * S, dport=443, flags="ACK"), "src": "198.51.100.1"}]):
        frame(spark, part).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)
    return packets


def test_a_rule_that_does_not_match_delays_no_alert(spark, tmp_path):
    probe(spark, str(tmp_path / "s"))
    p = Thresholds(port_scan_threshold=3, ddos_threshold=0.2)
    idle = [CustomRule("idle", "matches nothing", "no such text", "string", "High")]
    found = []
    for rules in (None, idle):
        raised = stateful.stream_alerts(stream(spark, str(tmp_path / "s")), p, rules)
        found.append(sorted((r.packet_id, r.alert_type) for r in live.run_to_end(raised).collect()))
    assert [t for _, t in found[0]].count("Port Scan") == 2 and [t for _, t in found[0]].count("DDoS Attack") == 2
    assert found[1] == found[0]


def test_a_silent_source_is_forgotten_when_asked(spark, tmp_path):
    probe(spark, str(tmp_path / "s"))
    p = Thresholds(ddos_threshold=0.2)
    totals = []
    for after in (None, 3600):
        got = live.run_to_end(stateful.stream_flood_alerts(
            stream(spark, str(tmp_path / "s")), replace(p, forget_source_after=after))).collect()
        totals.append([json.loads(r.details)["total_connections"] for r in sorted(got, key=lambda r: r.us)])
    assert totals == [[13, 53], [13, 13]]


def test_scores_equal_batch(spark, shuffled):
    path, ps = shuffled
    rows = features.features(frame(spark, ps))
    forest = anomaly.fit(rows, p=Thresholds(min_baseline_samples=10))
    got = {r.id: round(r.score, 9) for r in live.run_to_end(stateful.stream_scores(stream(spark, path), forest)).collect()}
    assert got == {r.id: round(r.score, 9) for r in anomaly.score(rows, forest).collect()}


def test_a_flow_out_of_order_is_one_flow(spark, tmp_path):
    import time
    flow = [packet(1, 100 * S, flags="ACK"), packet(2, 0, flags="SYN"), packet(3, 350 * S, flags="ACK")]
    for part in ([flow[0]], [flow[1]], [flow[2]], [packet(4, 9000 * S, dport=7)]):
        frame(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "s"))
        time.sleep(1.1)
    got = live.run_to_end(stateful.stream_flow_states(stream(spark, str(tmp_path / "s")))).collect()
    assert [(rel(r.first_us), rel(r.last_us), r.packet_count) for r in got] == [(0, 350 * S, 3)]


def test_windowed_flows_are_a_part_of_batch(spark, folder):
    path, ps = folder
    cols = ["src_ip", "dst_ip", "src_port", "dst_port", "protocol", "first_seen", "packet_count", "bytes_received"]
    got = set(map(tuple, live.run_to_end(windows.stream_flows(stream(spark, path))).select(*cols).collect()))
    want = set(map(tuple, flows.flow_sessions(frame(spark, ps)).select(*cols).collect()))
    assert got and got <= want


def test_trend_and_rate(spark, folder):
    path, ps = folder
    t = live.run_to_end(windows.stream_trend(stream(spark, path)), "complete")
    assert t.agg(F.sum("packet_count")).first()[0] == 400
    r = live.run_to_end(windows.stream_rate(stream(spark, path)), "complete")
    assert r.agg(F.sum("packets")).first()[0] == 400 * 6


def test_tables(spark, folder, tmp_path):
    path, ps = folder
    now = {"availableNow": True}
    q = live.store_packets(stream(spark, path), f"{tmp_path}/p", f"{tmp_path}/c1", now)
    q.awaitTermination()
    assert tables.read_packets(spark, f"{tmp_path}/p").count() == 400
    assert {r.date.isoformat() for r in spark.read.parquet(f"{tmp_path}/p").select("date").distinct().collect()}


def test_live_loop_with_model_and_view(spark, shuffled, tmp_path):
    """Anomaly alerts of the published model equal the batch's; the view's figures equal what is stored."""
    path, ps = shuffled
    p = Thresholds(port_scan_threshold=3, ddos_threshold=0.05, min_baseline_samples=10, anomaly_threshold=0.0)
    rows = features.features(frame(spark, ps))
    forest, learned = anomaly.fit(rows, p=p), baseline.learn(frame(spark, ps))
    models, folder, now = str(tmp_path / "models"), str(tmp_path / "live"), {"availableNow": True}
    assert live.newest_model(spark, models) is None and live.publish_model(spark, models, forest, learned) == 1
    for q in live.run_pipeline(stream(spark, path), folder, p, None, now, models).values():
        q.awaitTermination()
    stored = spark.read.parquet(f"{folder}/alerts")
    raised = al.union_alerts(anomaly.anomaly_alerts(anomaly.score(rows, forest), learned, p))
    want = al.deduplicate(raised, p.dedup_window).select(*al.COLUMNS).collect()
    got = stored.filter("stream = 'anomalies'").select(*al.COLUMNS).collect()
    assert want and sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str)
    others = pipeline.run(frame(spark, ps), p).stored.select("packet_id", "us", "alert_type").collect()
    assert sorted(map(tuple, others)) == sorted(map(tuple, stored.filter("stream = 'detectors'").select(
        "packet_id", "us", "alert_type").collect()))

    # the open alerts
    counts, latest = live.open_alerts(spark, f"{folder}/view")
    assert {r.severity: r.n for r in counts.collect()} == {r.severity: r["count"] for r in stored.groupBy("severity").count().collect()}
    newest = stored.orderBy(F.desc("us"), F.desc("packet_id"), "alert_type").limit(100).select("us", "packet_id").collect()
    assert sorted(map(tuple, latest.select("us", "packet_id").collect())) == sorted(map(tuple, newest))
    for _ in range(2):  # a repeated run counts once
        live.note_resolved(spark, f"{folder}/view", stored.limit(2), "first")
    assert live.open_alerts(spark, f"{folder}/view")[0].agg(F.sum("n")).first()[0] == stored.count() - 2

    # training again from what the stream gathered, as of its last packet
    from datetime import datetime, timedelta
    last = datetime(1970, 1, 1) + timedelta(microseconds=rows.agg(F.max("us")).first()[0])
    again = replace(p, baseline_window_hours=1)
    assert live.retrain(spark, f"{folder}/training", models, last, again) == 2
    since = F.lit(last - timedelta(hours=1)).cast("timestamp")
    recent = anomaly.fit(rows.filter(F.col("timestamp") >= since), again)
    newer, baseline_again = live.Models(spark, models).current()
    assert newer.nodes.equals(recent.nodes) and newer.offset == recent.offset
    assert baseline_again.scalars.first()["samples"] == rows.filter(F.col("timestamp") >= since).count()
    assert live.retrain(spark, f"{folder}/none", models, last, again) is None


def test_a_running_stream_takes_up_a_new_model(spark, tmp_path):
    ps = brute.random_packets(300, 4, 4000)
    p = Thresholds(min_baseline_samples=10)
    rows = features.features(frame(spark, ps))
    learned, models = baseline.learn(frame(spark, ps)), live.Models(spark, str(tmp_path / "m"))
    assert models.current() is None
    for version, seed in ((1, 1), (2, 2)):
        forest = anomaly.fit(rows, p=p, seed=seed)
        assert live.publish_model(spark, str(tmp_path / "m"), forest, learned) == version
        assert models.current()[0].nodes.equals(forest.nodes) and models.version == version
    (tmp_path / "m" / "version=000000003").mkdir()  # not ready
    assert models.current() and models.version == 2


def test_live_feed_reads_grains_and_deltas(spark, folder, tmp_path):
    path, ps = folder
    view = str(tmp_path / "view")
    q = live.live_feed(stream(spark, path), view, f"{tmp_path}/feed", f"{tmp_path}/c2", {"availableNow": True})
    q.awaitTermination()
    got = spark.read.json(f"{tmp_path}/feed/traffic/batch=3").first()
    grain = live.GRAIN_SECONDS * S
    from datetime import timezone
    base = int(brute.T0.replace(tzinfo=timezone.utc).timestamp()) * S
    first = (base + ps[-1]["us"]) // grain * grain - 3600 * S + grain
    hour = [p for p in ps if base + p["us"] >= first]
    assert (got.total_packets, got.total_bytes) == (len(hour), sum(p["size"] for p in hour))
    assert (got.unique_sources, got.unique_destinations) == (len({p["src"] for p in hour}), len({p["dst"] for p in hour}))
    assert (got.unresolved_count, got.critical_count) == (0, 0)
    chart = spark.read.json(f"{tmp_path}/feed/chart/batch=3")
    assert chart.agg(F.sum("packets")).first()[0] == len(hour)


def test_alert_trend_of_a_stream(spark, tmp_path):
    from datetime import datetime, timedelta
    a = [(datetime(2024, 1, 1) + timedelta(minutes=7 * i), ("High", "Low")[i % 2]) for i in range(40)]
    spark.createDataFrame(a, "timestamp timestamp, severity string").coalesce(1).write.parquet(f"{tmp_path}/a")
    rows = spark.readStream.schema("timestamp timestamp, severity string").parquet(f"{tmp_path}/a")
    got = live.run_to_end(windows.stream_alert_trend(rows), "complete").collect()
    assert sum(r.alert_count for r in got) == 40 and {r.severity for r in got} == {"High", "Low"} and len(got) == 10


def test_rules_are_read_again(spark, folder, tmp_path):
    path, ps = folder
    rule = dict(name="n", description="d", pattern="get", pattern_type="string", severity="High", enabled=True,
                protocol="any", ports=[])
    (tmp_path / "r.json").write_text(json.dumps({"rules": {"custom_rules": [rule]}}))
    q = live.match_stream(stream(spark, path), str(tmp_path / "r.json"), f"{tmp_path}/m", f"{tmp_path}/c", {"availableNow": True})
    q.awaitTermination()
    want = sum(p["dport"] in (80, 8080) and p["payload"] > 100 for p in ps)
    assert spark.read.parquet(f"{tmp_path}/m").count() == want


def test_counters(spark, folder, tmp_path):
    path, _ = folder
    listener = live.RateListener()
    spark.streams.addListener(listener)
    q = live.write_batches(live.with_counters(stream(spark, path)), f"{tmp_path}/o", f"{tmp_path}/c", {"availableNow": True})
    q.awaitTermination()
    import time
    for _ in range(50):
        if listener.packets >= 400:
            break
        time.sleep(0.1)
    spark.streams.removeListener(listener)
    assert listener.packets == 400 and listener.late == 0


def test_late_rows_are_dropped(spark, tmp_path):
    import time
    first = [packet(1, 10_000 * S)]
    frame(spark, first).coalesce(1).write.mode("append").parquet(str(tmp_path / "s"))
    time.sleep(1.1)
    frame(spark, [packet(2, 10_001 * S)]).coalesce(1).write.mode("append").parquet(str(tmp_path / "s"))
    time.sleep(1.1)
    frame(spark, [packet(3, 0)]).coalesce(1).write.mode("append").parquet(str(tmp_path / "s"))
    time.sleep(1.1)
    frame(spark, [packet(4, 20_000 * S)]).coalesce(1).write.mode("append").parquet(str(tmp_path / "s"))
    got = live.run_to_end(stateful.stream_features(stream(spark, str(tmp_path / "s"))))
    assert sorted(r.id for r in got.collect()) == [1, 2]


def test_batch_features_agree_with_scan(spark):
    ps = [packet(i, i * S, dport=8000 + i) for i in range(5)]
    assert scan.scan_sessions(frame(spark, ps)).first().ports == 5
    assert features.features(frame(spark, ps)).count() == 5
