"""The whole pipeline against sequential folds."""

from datetime import datetime, timedelta

import brute
from brute import S, frame

from flowsentry.operators import anomaly, baseline, features
from flowsentry.params import CustomRule, Thresholds
from flowsentry.plans import pipeline

P = Thresholds(port_scan_threshold=4, ddos_threshold=0.1, anomaly_threshold=0.0, min_baseline_samples=100)
RULE = CustomRule("get", "a request", "GET", "string", "Low")


def test_stored_alerts_equal_fold(spark):
    ps = brute.random_packets(900, 21, 7000, hot=0.5)
    result = pipeline.run(frame(spark, ps), P, [RULE])
    by_id = {p["id"]: p for p in ps}
    raised = [(i, 1, "Port Scan", by_id[i]["dst"]) for i, *_ in brute.scan(ps, 4)]
    raised += [(i, 2, "DDoS Attack", None) for i, *_ in brute.flood(ps, 0.1)]
    http = [p for p in ps if p["dport"] in (80, 8080) and p["payload"] > 100]
    for n, name in ((3, "Suspicious Payload"), (4, "Custom Rule: get")):
        raised += [(p["id"], n, name, p["dst"]) for p in brute.cooldown(http, lambda p: p["src"], 300 * S)]
    raised.sort()
    rows = [dict(us=by_id[i]["us"], key=(name, by_id[i]["src"], dst), row=(i, n, name, dst)) for i, n, name, dst in raised]
    want = [r["row"] for r in brute.cooldown(rows, lambda r: r["key"], 600 * S, inclusive=True)]
    got = sorted((r.packet_id, r.detector, r.alert_type, r.destination_ip) for r in result.stored.collect())
    assert got == sorted(want)
    s = pipeline.statistics(result).first()
    assert (s.packets_processed, s.alerts_processed, s.alerts_stored) == (900, len(raised), len(want))
    assert s.threats_detected == len({r[0] for r in raised})


def test_with_model(spark):
    df = frame(spark, brute.random_packets(300, 2, 2000)).cache()
    model = anomaly.fit(features.features(df), P, trees=20), baseline.learn(df)
    kinds = {r.alert_type for r in pipeline.raise_alerts(df, P, [RULE], model).select("alert_type").distinct().collect()}
    assert "Network Anomaly" in kinds


def test_active_threats(spark):
    ps = brute.random_packets(300, 2, 2000)
    t = pipeline.active_threats(frame(spark, ps), datetime(2024, 1, 1) + timedelta(seconds=2000), P)
    live = {r.source_ip: r.total_connections for r in t["active_ddos_attacks"].collect()}
    assert live == {s: sum(p["src"] == s for p in ps) for s in {p["src"] for p in ps}}
    assert t["connection_count"].first().connection_count > 0
