"""What a micro-batch of the live loop costs besides its rows: states, passes over its packets, files."""

import glob
import os

import brute
import pytest
from brute import S, frame, packet

from flowsentry.operators import alerts as al
from flowsentry.params import CustomRule, Thresholds
from flowsentry.sources import tables
from flowsentry.streaming import live, stateful

NOW = {"availableNow": True}
P = Thresholds(port_scan_threshold=3, ddos_threshold=0.05)
RULES = [CustomRule("get", "request line", "get", "string", "High"), CustomRule("or", "or", "or", "string", "Low")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Packets in one file and a late one in another, behind which everything is due."""
    import time
    stateful.use_rocksdb(spark)
    path = str(tmp_path_factory.mktemp("cost"))
    frame(spark, brute.random_packets(300, 5, 6000, hot=0.5)).coalesce(1).write.mode("append").parquet(path)
    time.sleep(1.1)
    frame(spark, [packet(999, 90_000 * S, dport=9)]).coalesce(1).write.mode("append").parquet(path)
    return path


def stream(spark, path):
    return tables.stream_packets(spark, path, files_per_trigger=1)


def ended(query):
    query.awaitTermination()
    assert query.exception() is None
    return query.recentProgress


def test_all_detectors_share_one_state(spark, folder, tmp_path):
    raised = stateful.stream_alerts(stream(spark, folder), P, RULES)
    progress = ended(live.write_batches(raised, f"{tmp_path}/out", f"{tmp_path}/state", NOW))
    # slices and the watches over them; it was a pair for each detector
    assert {len(p.stateOperators) for p in progress} == {2}
    got = spark.read.parquet(f"{tmp_path}/out").select(*al.COLUMNS).collect()
    apart = [stateful.stream_scan_records(stream(spark, folder), P), stateful.stream_flood_alerts(stream(spark, folder), P),
             stateful.stream_payload_alerts(stream(spark, folder), P),
             stateful.stream_rule_alerts(stream(spark, folder), RULES, P)]
    want = [r for x in apart for r in live.run_to_end(x).select(*al.COLUMNS).collect()]
    assert {r.detector for r in want} == {al.SCAN, al.FLOOD, al.PAYLOAD, al.RULE}
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str)


def test_the_features_of_an_hour_are_one_file_a_batch(spark, folder, tmp_path):
    found = stateful.stream_features(stream(spark, folder))
    ended(live.store_anomalies(found, f"{tmp_path}/models", f"{tmp_path}/alerts", f"{tmp_path}/training", f"{tmp_path}/state",
                               trigger=NOW))
    written = [os.path.dirname(f) for f in glob.glob(f"{tmp_path}/training/hour=*/stream=features/batch=*/*.parquet")]
    assert written and len(written) == len(set(written))  # there was one for each partition of the state
    assert spark.read.parquet(f"{tmp_path}/training").count() == 300


def test_the_feed_reads_a_batch_once(spark, folder, tmp_path):
    progress = ended(live.live_feed(stream(spark, folder), f"{tmp_path}/view", f"{tmp_path}/feed", f"{tmp_path}/state", NOW))
    assert [p.numInputRows for p in progress if p.numInputRows] == [300, 1]
    assert spark.read.json(f"{tmp_path}/feed/traffic/batch=1").first().total_packets == 1


def test_the_feed_takes_a_file_without_packets(spark, tmp_path):
    import time
    path = str(tmp_path / "s")
    frame(spark, [packet(1, 0), packet(2, 5 * S)]).coalesce(1).write.mode("append").parquet(path)
    time.sleep(1.1)
    frame(spark, [packet(3, 0)]).filter("id < 0").coalesce(1).write.mode("append").parquet(path)
    ended(live.live_feed(stream(spark, path), f"{tmp_path}/view", f"{tmp_path}/feed", f"{tmp_path}/state", NOW))
    assert [spark.read.json(f"{tmp_path}/feed/traffic/batch={b}").first().total_packets for b in (0, 1)] == [2, 2]
