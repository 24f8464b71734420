"""Detectors against sequential folds over random packets, and their boundary rules."""

import brute
import pytest
from brute import S, frame, packet, rel
from pyspark.sql import functions as F

from flowsentry.functions.patterns import PATTERNS
from flowsentry.operators import alerts, features, flood, flows, payload, rules, scan
from flowsentry.operators.suppress import thin
from flowsentry.params import CustomRule, Thresholds, validate_rules

BODIES = (None, "x", "' or 1=1 <script>", "<iframe a> ; cat x", "trojan union select a", "; ls  virus", "alert (1)")


def moments(spark, times, key="k"):
    return spark.createDataFrame([(i, t * S // 1, key) for i, t in enumerate(times)], "id long, us long, k string")


def test_cooldown_edges(spark):
    df = moments(spark, [0, 100, 300, 301, 601, 602])
    assert sorted(r.us // S for r in thin(df, ["k"], 300).collect()) == [0, 301, 602]


def test_dedup_edges(spark):
    df = moments(spark, [0, 599, 600, 1200])
    assert sorted(r.us // S for r in thin(df, ["k"], 600, inclusive=True).collect()) == [0, 600, 1200]


@pytest.mark.parametrize("inclusive", [False, True])
def test_thin_equals_fold_with_a_hot_key(spark, inclusive):
    ps = brute.random_packets(600, 5, 4000, hot=0.7)
    want = {(p["src"], p["us"]) for p in brute.cooldown(ps, lambda p: p["src"], 50 * S, inclusive)}
    df = frame(spark, ps).select("id", F.unix_micros("timestamp").alias("us"), "src_ip")
    got = thin(df, ["src_ip"], 50, inclusive=inclusive).collect()
    assert {(r.src_ip, rel(r.us)) for r in got} == want and len(got) == len(want)


def test_thin_keeps_null_keys_apart(spark):
    df = spark.createDataFrame([(1, 0, None), (2, 1, None), (3, 2, "x")], "id long, us long, k string")
    assert sorted(r.id for r in thin(df, ["k"], 300).collect()) == [1, 3]


def test_equal_moments_pass_by_lowest_id(spark):
    df = spark.createDataFrame([(5, 0, "x"), (4, 0, "x"), (6, 0, "x")], "id long, us long, k string")
    assert [r.id for r in thin(df, ["k"], 300).collect()] == [4]


@pytest.mark.parametrize("seed", [1, 2])
def test_flows_equal_fold(spark, seed):
    ps = brute.random_packets(500, seed, 30000, hosts=3)
    want = sorted((f["src"][0], f["dst"][0], str(f["src"][1]), str(f["dst"][1]), f["proto"], f["first"], f["last"],
                   f["n"], f["sent"], f["received"], f["state"]) for f in brute.flows(ps))
    got = sorted((r.src_ip, r.dst_ip, str(r.src_port), str(r.dst_port), r.protocol, rel(r.f), rel(r.l), r.packet_count,
                  r.bytes_sent, r.bytes_received, r.state) for r in flows.flow_sessions(frame(spark, ps)).withColumns(
        {"f": F.unix_micros("first_seen"), "l": F.unix_micros("last_seen")}).collect())
    assert got == want


def test_flow_spanning_many_slices(spark):
    """One flow that never falls silent, so its state is carried over hundreds of slices."""
    import random
    rng = random.Random(3)
    flags = ["SYN", "SYN|ACK", "ACK", "FIN|ACK", "RST", "PSH", "RST|ACK"]
    ps = [packet(i, i * 3 * S, *(("a", "b", 1, 2) if rng.random() < .5 else ("b", "a", 2, 1)), flags=rng.choice(flags))
          for i in range(600)]
    for n in (600, 599, 598, 597, 590):
        got = flows.flow_sessions(frame(spark, ps[:n])).collect()
        want = brute.flows(ps[:n])
        assert len(got) == len(want) == 1 and got[0].state == want[0]["state"]


def test_flow_gap_and_direction(spark):
    ps = [packet(1, 0), packet(2, 300 * S), packet(3, 600 * S + 1)]
    assert sorted(r.packet_count for r in flows.flow_sessions(frame(spark, ps)).collect()) == [1, 2]
    ps = [packet(1, 0, size=100), packet(2, 1, "b", "a", 2, 1, size=40), packet(3, 2, size=60)]
    r = flows.flow_sessions(frame(spark, ps)).first()
    assert (r.src_ip, r.bytes_sent, r.bytes_received, r.packet_count) == ("a", 160, 40, 3)


@pytest.mark.parametrize("flags,state", [
    (["SYN", "SYN|ACK", "ACK", "FIN|ACK"], "FIN_WAIT"), (["SYN", "FIN|ACK"], "ESTABLISHED"),
    (["ACK"], "UNKNOWN"), (["ACK", "RST"], "RESET"), (["FIN"], "UNKNOWN"), (["SYN", "ACK", "ACK"], "ESTABLISHED"),
    (["SYN,ACK", "ACK"], "ESTABLISHED"), (["RST", "FIN|ACK"], "FIN_WAIT")])
def test_tcp_fold(spark, flags, state):
    ps = [packet(i, i, flags=f) for i, f in enumerate(flags)]
    assert flows.flow_sessions(frame(spark, ps)).first().state == state


def test_host_pairs_and_talkers(spark):
    ps = brute.random_packets(300, 9, 5000)
    fs, want = flows.flow_sessions(frame(spark, ps)), brute.flows(ps)
    assert {r.ip: r.packets for r in flows.top_talkers(fs).collect()} == dict(brute.talkers(want))
    both = [f for f in want if {f["src"][0], f["dst"][0]} == {"h0", "h1"}]
    r = flows.flow_summary(fs, "h1", "h0").first()
    assert r.total_packets == sum(f["n"] for f in both)
    assert r.total_bytes == sum(f["sent"] + f["received"] for f in both)
    assert r.ports == sorted({p for f in both for p in (f["src"][1], f["dst"][1]) if p})
    assert flows.flow_summary(fs, "h1", "nobody").count() == 0


def test_scan_predicate(spark):
    ps = [packet(1, 0, dport=22), packet(2, 1, dport=8001, flags="SYN|ACK"), packet(3, 2, dport=8002, flags="ACK"),
          packet(4, 3, dport=8003, proto="UDP", flags=None), packet(5, 4, dport=8004, flags=None)]
    assert [r.dst_port for r in scan.scan_attempts(frame(spark, ps)).collect()] == [8001]


def test_scan_threshold(spark):
    ps = [packet(i, i, dport=9000 + i % 10) for i in range(20)]
    got = sorted(r.id for r in scan.scan_candidates(frame(spark, ps)).collect())
    assert got == list(range(9, 20))


@pytest.mark.parametrize("seed", [1, 2])
def test_scan_alerts_equal_fold(spark, seed):
    ps = brute.random_packets(1500, seed, 6000, hot=0.6)
    got = scan.scan_alerts(frame(spark, ps), Thresholds(port_scan_threshold=4))
    j = F.from_json("details", "scan_count long, failed_connections long, scanned_ports array<int>, target_ips array<string>")
    rows = sorted((r.packet_id, r.description.split("Scanned ")[1], r.j.scan_count, r.j.failed_connections)
                  for r in got.withColumn("j", j).collect())
    assert rows == sorted((i, f"{p} ports on {t} target(s).", n, bad)
                          for i, p, t, n, bad in brute.scan(ps, 4))
    first = min(got.withColumn("j", j).collect(), key=lambda r: r.us)
    assert len(first.j.scanned_ports) == int(first.description.split("Scanned ")[1].split()[0])


@pytest.mark.parametrize("ports,targets,rate,want", [
    (10, 1, 10.0, "High"), (10, 1, 10.1, "Critical"), (10, 5, 1.0, "High"), (10, 6, 1.0, "Critical"),
    (100, 1, 1.0, "High"), (101, 1, 1.0, "Critical"), (50, 1, 1.0, "Medium"), (51, 1, 1.0, "High"),
    (20, 1, 1.0, "Low"), (21, 1, 1.0, "Medium"), (20, 2, 1.0, "Medium"), (20, 3, 1.0, "High"), (1, 1, 5.1, "High")])
def test_scan_severity(spark, ports, targets, rate, want):
    got = spark.range(1).select(scan.scan_severity(F.lit(ports), F.lit(targets), F.lit(rate)).alias("s")).first().s
    assert got == want


@pytest.mark.parametrize("rate,targets,bps,want", [
    (500, 1, 0, "High"), (501, 1, 0, "Critical"), (1, 1, 10_000_001, "Critical"), (200, 1, 0, "Medium"),
    (1, 11, 0, "High"), (1, 10, 0, "Medium"), (1, 1, 1_000_001, "High"), (100, 3, 0, "Low"), (101, 3, 0, "Medium"),
    (1, 4, 0, "Medium")])
def test_flood_severity(spark, rate, targets, bps, want):
    got = spark.range(1).select(flood.flood_severity(F.lit(rate), F.lit(targets), F.lit(bps)).alias("s")).first().s
    assert got == want


@pytest.mark.parametrize("seed", [1, 4])
def test_flood_alerts_equal_fold(spark, seed):
    ps = brute.random_packets(1500, seed, 9000, hot=0.4)
    got = flood.flood_alerts(frame(spark, ps), Thresholds(ddos_threshold=0.1))
    j = F.from_json("details", "connection_rate double, total_connections long, bytes_sent long, target_count long")
    assert sorted((r.packet_id, round(r.j.connection_rate, 9), r.j.total_connections, r.j.bytes_sent, r.j.target_count)
                  for r in got.withColumn("j", j).collect()) == sorted(brute.flood(ps, 0.1))


def test_flood_history_cap(spark):
    ps = brute.random_packets(800, 8, 600, hot=0.9)
    p = Thresholds(ddos_threshold=0.3, rate_history_cap=20)
    got = flood.flood_alerts(frame(spark, ps), p).collect()
    assert sorted(r.packet_id for r in got) == sorted(x[0] for x in brute.flood(ps, 0.3, cap=20))


def test_flood_window_edge(spark):
    for gap, n in ((60 * S, 2), (60 * S + 1, 1)):
        rows = flood.flood_progress(frame(spark, [packet(1, 0), packet(2, gap)])).collect()
        assert {r.id: r.in_window for r in rows}[2] == n


@pytest.mark.parametrize("seed", [1, 2])
def test_payload_alerts_equal_fold(spark, seed):
    ps = brute.random_packets(800, seed, 6000, bodies=BODIES)
    ps = [{**p, "dport": 1} for p in ps]
    df = frame(spark, ps, with_payload=True)
    got = payload.payload_alerts(df)
    j = F.from_json("details", "pattern_category string, matched_pattern string")
    assert sorted((r.packet_id, r.j.pattern_category, r.j.matched_pattern)
                  for r in got.withColumn("j", j).collect()) == sorted(brute.payload(ps, PATTERNS))


def test_payload_categories_are_coupled(spark):
    body = "' or 1=1 <script>"
    ps = [packet(i, i * S, dport=1, payload=50, body=body) for i in range(3)]
    got = {r.packet_id: r.description for r in payload.payload_alerts(frame(spark, ps, True)).collect()}
    assert set(got) == {0, 1} and "sql injection" in got[0] and "xss" in got[1]


def test_payload_size_gate(spark):
    ps = [packet(1, 0, dport=21, payload=9), packet(2, 1, dport=21, payload=10)]
    assert payload.payload_matches(frame(spark, ps)).count() == 0      # the login text matches nothing
    ps = [{**p, "body": "union select"} for p in ps]
    assert [r.id for r in payload.payload_matches(frame(spark, ps, True)).collect()] == [2]


def test_rules(spark):
    http = dict(dport=80, payload=200)
    ps = [packet(1, 0, **http), packet(2, 1, dport=22, payload=60), packet(3, 2, dport=8080, payload=200, proto="UDP")]
    rs = [CustomRule("re", "d", "INDEX\\.php", "regex"), CustomRule("st", "d", "openssh", "string"),
          CustomRule("by", "d", "47 45 54", "bytes", protocol="tcp"), CustomRule("hex", "d", "4", "bytes"),
          CustomRule("off", "d", ".", "regex", enabled=False), CustomRule("udp", "d", "get", "string", protocol="udp"),
          CustomRule("port", "d", "get", "string", ports=(8080,))]
    got = sorted((r.rule_name, r.id) for r in rules.rule_matches(frame(spark, ps), rs).collect())
    assert got == [("by", 1), ("port", 3), ("re", 1), ("re", 3), ("st", 2), ("udp", 3)]


def test_many_rules_read_the_packets_once(spark):
    ps = [packet(1, 0, dport=80, payload=200)]
    rs = [CustomRule(f"r{i}", "d", "get", "string") for i in range(300)]
    found = rules.rule_matches(frame(spark, ps), rs)
    assert found.count() == 300
    assert rules.rule_matches(frame(spark, ps), []).count() == 0


def test_a_regex_that_does_not_compile_matches_nothing_and_spares_the_others(spark):
    ps = [packet(1, 0, dport=80, payload=200)]
    rs = [CustomRule("named group of another dialect", "d", "(?P<x>GET)", "regex"), CustomRule("open", "d", "(", "regex"),
          CustomRule("this dialect only", "d", "G\\p{Alpha}+", "regex"), CustomRule("st", "d", "get", "string")]
    assert sorted(r.rule_name for r in rules.rule_matches(frame(spark, ps), rs).collect()) == ["st", "this dialect only"]
    assert set(rules.faulty(spark, rs)) == {"named group of another dialect", "open"}
    t = spark.createDataFrame([(r.name, "d", r.pattern, r.pattern_type, "High", "any") for r in rs],
                              "name string, description string, pattern string, pattern_type string, severity string, "
                              "protocol string")
    got = {r["name"]: r["errors"] for r in rules.rule_errors(t).collect()}
    assert got == {"named group of another dialect": [rules.BAD_REGEX], "open": [rules.BAD_REGEX],
                   "this dialect only": [], "st": []}


def test_alert_ids_differ_for_rules_on_one_packet(spark):
    ps = [packet(1 << 61, 0, dport=80, payload=200)]
    rs = [CustomRule(f"r{i}", "d", "get", "string") for i in range(3)]
    both = alerts.union_alerts(rules.rule_alerts(frame(spark, ps), rs))
    assert len({r.id for r in alerts.to_table(alerts.deduplicate(both)).collect()}) == 3


def test_a_missing_port_is_one_distinct_port(spark):
    ps = [{**packet(i, i, dport=8000 + i, flags="SYN"), "dport": None if i == 2 else 8000 + i} for i in range(1, 4)]
    df = frame(spark, ps)
    t = Thresholds(port_scan_threshold=3)
    assert scan.scan_sessions(df, t).first().ports == 3
    assert max(r.ports for r in scan.scan_candidates(df, t).collect()) == 3


def test_rule_validation():
    bad = validate_rules([CustomRule("", "d", "x", "string"), CustomRule("a", "d", "x", "string", "none"),
                          CustomRule("b", "d", "x", "glob", "Severe", protocol="sctp"),
                          CustomRule("c", "d", "x", "string"), CustomRule("c", "d", "y", "string")])
    assert bad["a"] == ["unknown severity"] and bad["c"] == ["duplicate name"]
    assert len(bad["b"]) == 3 and bad[""] == ["name is empty"]


def test_invalid_rules_are_refused(spark):
    with pytest.raises(ValueError):
        rules.rule_matches(frame(spark, [packet(1, 0)]), [CustomRule("a", "d", "", "string")])


@pytest.mark.parametrize("seed", [1, 2])
def test_features_equal_fold(spark, seed):
    ps = brute.random_packets(800, seed, 4000)
    got = {r.id: (round(r.packets_per_second, 9), round(r.bytes_per_second, 9), r.unique_ports_accessed)
           for r in features.features(frame(spark, ps)).collect()}
    assert got == brute.features(ps)


def test_feature_window_edges(spark):
    ps = [packet(1, 0, dport=5), packet(2, 1, dport=6), packet(3, 60 * S, dport=7), packet(4, 60 * S + 2, dport=7)]
    got = {r.id: round(r.packets_per_second * 60) for r in features.features(frame(spark, ps)).collect()}
    assert got == {1: 0, 2: 0, 3: 2, 4: 1}


def test_alert_log_line(spark):
    ps = [packet(1, 0, dport=80, payload=200)]
    line = alerts.log_lines(payload.payload_alerts(frame(spark, ps))).first().value
    import json
    body = json.loads(line.removeprefix("ALERT: "))
    assert list(body) == ["timestamp", "type", "severity", "source_ip", "destination_ip", "description", "details"]
    assert body["details"]["pattern_category"] == "sql_injection"
