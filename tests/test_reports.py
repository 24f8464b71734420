"""Report boundaries, maintenance rules, searches and exports."""

import json
from datetime import datetime, timedelta

import brute
import pytest
from brute import S, T0, frame, packet
from pyspark.sql import functions as F

from flowsentry import session
from flowsentry.operators import maintenance, search, traffic
from flowsentry.params import AlertCriteria, CaptureFilter, CustomRule, PacketCriteria
from flowsentry.plans import dashboard, reports
from flowsentry.schema import ALERTS, CONNECTIONS
from flowsentry.sources import sinks, tables

AS_OF = datetime(2024, 2, 1)


def alert(i, hours_ago=1.0, kind="Port Scan", severity="High", src="1.1.1.1", dst=None, resolved=False, after=None, text="x"):
    ts = AS_OF - timedelta(hours=hours_ago)
    done = ts + timedelta(hours=after) if after is not None else None
    return (i, ts, kind, severity, src, dst, text, None, resolved, done, "me" if done else None)


def alerts(spark, *rows):
    return spark.createDataFrame(list(rows), ALERTS)


def connections(spark, *rows):
    base = ("a", "b", 1, 2, "TCP")
    return spark.createDataFrame([(i, *base, last, last, 1, 10, 5, state, None, 1.0, 2.0) for i, last, state in rows],
                                 CONNECTIONS)


def test_risk_score(spark):
    empty = frame(spark, [])
    assert reports.risk_score(empty, alerts(spark)).first().risk_score == 0.0
    thousand = frame(spark, [packet(i, i) for i in range(1000)])
    assert reports.risk_score(thousand, alerts(spark, alert(1, severity="Critical"))).first().risk_score == 100.0
    assert reports.risk_score(thousand, alerts(spark, alert(1, severity="Low"))).first().risk_score == 10.0


def test_trend_summary(spark):
    t = lambda *n: spark.createDataFrame([(datetime(2024, 1, i + 1), x, 0) for i, x in enumerate(n)],
                                         "bucket timestamp, packet_count long, total_bytes long")
    a = lambda *n: spark.createDataFrame([(datetime(2024, 1, i + 1), 0, 0, 0, x) for i, x in enumerate(n)],
                                         "bucket timestamp, Low long, Medium long, High long, Critical long")
    assert reports.trend_summary(t(), a(1)).first().status == "insufficient_data"
    assert reports.trend_summary(t(1), a()).first().traffic_variance is None
    r = reports.trend_summary(t(0, 2), a(2, 2)).first()          # peak = 2 × mean, last = mean
    assert (r.traffic_variance, r.alert_trend, r.average_packets_per_period) == ("normal", "stable", 1)
    r = reports.trend_summary(t(0, 0, 4), a(1, 2)).first()
    assert (r.traffic_variance, r.alert_trend, r.average_alerts_per_period) == ("high", "increasing", 1.5)


def test_audit(spark):
    clean = reports.security_audit(alerts(spark)).first()
    assert clean.compliance_status == "compliant" and clean.resolution_rate == 0.0
    assert clean.recommendations == ["Security posture appears healthy - maintain current monitoring practices"]
    r = reports.security_audit(alerts(
        spark, alert(1, 100, resolved=True, after=30), alert(2, kind="ddos"), alert(3, kind="port_scan"),
        alert(4, severity="Low"), alert(5, 100, resolved=True, after=None))).first()
    assert (r.total_critical_high_alerts, r.resolved_count, r.unresolved_count) == (4, 2, 2)
    assert r.average_response_time_hours == 30.0 and r.compliance_status == "non_compliant"
    assert len(r.recommendations) == 4


def test_unknown_report(spark):
    with pytest.raises(ValueError):
        reports.compliance_report("other", None, None, None, AS_OF)


def test_closed_periods_count_boundary_packets_twice(spark):
    start = datetime(2024, 1, 1)
    df = frame(spark, [packet(1, 0), packet(2, 3600 * S), packet(3, 5400 * S), packet(4, 7200 * S)])
    run = lambda closed: sorted((r.period_start.hour, r.packet_count) for r in reports.talkers_by_period(
        df, start, start + timedelta(hours=2), closed=closed).withColumn(
        "period_start", F.col("period_start").cast("timestamp_ntz")).collect())
    assert run(False) == [(0, 1), (1, 3)] and run(True) == [(0, 2), (1, 3)]


def test_retention(spark):
    old = 40 * 24
    a = alerts(spark, alert(1, old), alert(2, old, resolved=True, after=1), alert(3, 1, resolved=True, after=0.1))
    s = maintenance.split(a, maintenance.old_resolved_alerts(AS_OF))
    assert sorted(r.id for r in s.kept.collect()) == [1, 3] and s.counts().first().dropped == 1
    assert maintenance.split(a, maintenance.old_alerts(AS_OF)).kept.count() == 1
    long_ago = AS_OF - timedelta(days=40)
    k = connections(spark, (1, long_ago, "ACTIVE"), (2, long_ago, "CLOSED"), (3, AS_OF, "TIMEOUT"))
    assert sorted(r.id for r in maintenance.split(k, maintenance.old_closed_connections(AS_OF)).kept.collect()) == [1, 3]
    assert {r.id: r.state for r in maintenance.time_out_connections(k, AS_OF).collect()} == {
        1: "TIMEOUT", 2: "CLOSED", 3: "TIMEOUT"}


def test_purge_keeps_null_destination(spark):
    a = alerts(spark, alert(1, src="9.9.9.9"), alert(2, src="192.168.0.1"), alert(3, src="9.9.9.9", dst="10.0.0.1"),
               alert(4, src="9.9.9.9", text="a Demo"))
    kept = maintenance.split(a, maintenance.sample_address("source_ip", "destination_ip") | maintenance.sample_alert()).kept
    assert [r.id for r in kept.collect()] == [1]


def test_resolutions(spark):
    a = alerts(spark, alert(1), alert(2))
    res = spark.createDataFrame([(1, AS_OF, "x"), (1, AS_OF + timedelta(hours=1), "y"), (9, AS_OF, "z")],
                                "alert_id long, resolved_at timestamp, resolved_by string")
    got = {r.id: (r.resolved, r.resolved_by) for r in maintenance.resolve_alerts(a, res).collect()}
    assert got == {1: (True, "y"), 2: (False, None)}
    assert [r.alert_id for r in maintenance.unknown_resolutions(a, res).collect()] == [9]


def test_search_criteria(spark):
    df = frame(spark, [packet(1, 0, dport=0), packet(2, 5 * S, size=50), packet(3, 9 * S, proto="UDP")])
    ids = lambda c, n=10: [r.id for r in search.packet_search(df, c, n).collect()]
    assert ids(PacketCriteria(dst_port=0)) == [1]
    assert ids(PacketCriteria(protocol="udp")) == [3]
    assert ids(PacketCriteria(), 2) == [3, 2]
    assert ids(PacketCriteria(max_size=50)) == [2]
    start = T0.replace(tzinfo=None)
    assert ids(PacketCriteria(start_time=start)) == [3, 2, 1]        # one end alone does not narrow
    assert ids(PacketCriteria(start_time=start, end_time=start + timedelta(seconds=5))) == [2, 1]


def test_alert_view_sorts_by_rank(spark):
    a = alerts(spark, alert(1, severity="Low"), alert(2, severity="Critical"), alert(3, severity="High", kind="DDoS Attack"))
    view = lambda **k: [r.id for r in search.alert_view(a, limit=5, **k).collect()]
    assert view(sort="severity") == [2, 3, 1] and view(sort="severity", descending=False) == [1, 3, 2]
    assert view(text="ddos") == [3]
    with pytest.raises(ValueError):
        search.alert_view(a, sort="details")
    assert search.alert_search(a, AlertCriteria(severity="Low")).first().id == 1


def test_capture_filter(spark):
    df = frame(spark, [packet(1, 0, dport=80), packet(2, 1, src="z"), packet(3, 2, proto="GRE", sport=None, dport=None)])
    ids = lambda **k: sorted(r.id for r in traffic.capture_filter(df, CaptureFilter(**k)).collect())
    assert ids() == [1, 2, 3] and ids(protocols=("tcp", "gre")) == [1, 2]
    assert ids(excluded_ports=(80,)) == [2, 3] and ids(included_ports=(80,)) == [1]
    assert ids(included_ips=("z",)) == [2] and ids(excluded_ips=("z",)) == [1, 3]


def document(spark, path):
    return "".join(open(x.removeprefix("file:")).read() for x in sinks.report_parts(spark, path))


def test_a_report_of_many_rows_is_written_in_parts(spark, tmp_path):
    rows = spark.range(30_000).withColumn("text", F.concat(F.lit('a "quoted" name '), F.col("id").cast("string")))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sinks.write_report({"rows": rows.orderBy(F.desc("id")), "none": rows.limit(0), "a": rows.limit(1)}, f"{tmp_path}/r")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(sinks.report_parts(spark, f"{tmp_path}/r")) > 1
    doc = json.loads(document(spark, f"{tmp_path}/r"))
    assert list(doc) == ["a", "none", "rows"] and doc["none"] == [] and doc["a"][0]["text"].endswith(" 0")
    assert [r["id"] for r in doc["rows"]] == list(range(29_999, -1, -1))


def test_newest_rows_are_sought_from_the_newest_day_back(spark, tmp_path):
    ps = [packet(i, i * 4 * 3600 * S, "h1" if i < 12 else "h2") for i in range(60)]  # ten days
    sinks.append_packets(frame(spark, ps), f"{tmp_path}/p")
    table = tables.read_packets(spark, f"{tmp_path}/p")
    for limit, days in ((1, 1), (6, 1), (7, 2), (13, 4), (60, 10), (99, 10)):
        assert search._last_days(table, limit, "timestamp").select("date").distinct().count() == days
        assert [r.id for r in search.newest(table, limit).collect()] == list(range(59, max(-1, 59 - limit), -1))
    # the rows sought lie in the oldest two days
    found = search.packet_search(table, PacketCriteria(src_ip="h1"), 5)
    assert [r.id for r in found.collect()] == [11, 10, 9, 8, 7]
    inside = search.packet_search(table, PacketCriteria(start_time=datetime(2024, 1, 2), end_time=datetime(2024, 1, 3)), None)
    assert "date" in str(inside._jdf.queryExecution().optimizedPlan()) and inside.count() == 7


def test_exports_round_trip(spark, tmp_path):
    p = frame(spark, brute.random_packets(50, 1, 100))
    sinks.append_packets(p, f"{tmp_path}/p")
    sinks.append_packets(p, f"{tmp_path}/p")
    back = tables.read_packets(spark, f"{tmp_path}/p", start=datetime(2024, 1, 1), end=datetime(2024, 1, 1))
    assert back.count() == 100 and tables.read_packets(spark, f"{tmp_path}/p", start=datetime(2024, 1, 2)).count() == 0
    a = alerts(spark, alert(1), alert(2, kind="Network Anomaly"))
    sinks.append_alerts(a, f"{tmp_path}/a")
    assert tables.read_alerts(spark, f"{tmp_path}/a").count() == 2
    k = connections(spark, (1, AS_OF, "ACTIVE"))
    sinks.append_connections(k, f"{tmp_path}/k")
    assert tables.read_connections(spark, f"{tmp_path}/k").count() == 1
    logged = a.withColumn("us", F.unix_micros("timestamp"))
    sinks.write_alert_log(logged, f"{tmp_path}/log")
    lines = [r.value for r in spark.read.text(f"{tmp_path}/log").collect()]
    assert len(lines) == 2 and all(json.loads(x.removeprefix("ALERT: "))["severity"] for x in lines)
    s = reports.security_summary(p, a, k, datetime(2024, 1, 1), AS_OF)
    sinks.export_report(s, f"{tmp_path}/r", "json")
    doc = json.loads(document(spark, f"{tmp_path}/r"))
    assert set(doc) == set(s) and all(len(doc[n]) == df.count() for n, df in s.items())
    assert doc["summary"][0]["total_packets"] == 50 and doc["summary"][0]["anomaly_count"] == 1
    sinks.export_report(s, f"{tmp_path}/c", "csv")
    flat = spark.read.option("header", True).csv(f"{tmp_path}/c")
    assert flat.columns == ["category", "metric", "value", "index"]
    assert flat.filter("metric = 'total_packets'").first().value == "50"
    found = search.forensic_search(p, k, a, src_ip="h0")
    sinks.export_search(found, f"{tmp_path}/f", "csv")
    assert {r.data_type for r in spark.read.option("header", True).csv(f"{tmp_path}/f").collect()} == {"packet"}
    sinks.export_rows(sinks.raw_export("alerts", a, AS_OF), f"{tmp_path}/e", AS_OF)
    assert spark.read.json(f"{tmp_path}/e").select("data.alert_type").count() == 2
    with pytest.raises(ValueError):
        sinks.export_report(s, f"{tmp_path}/x", "pdf")


def test_retention_rewrites_touched_days(spark, tmp_path):
    ps = [packet(i, i * 12 * 3600 * S) for i in range(6)]
    sinks.append_packets(frame(spark, ps), f"{tmp_path}/p")
    table = tables.read_packets(spark, f"{tmp_path}/p")
    s = maintenance.split(table, F.col("id") == 1)
    sinks.rewrite_kept(s.kept, s.dropped, f"{tmp_path}/p")
    assert sorted(r.id for r in tables.read_packets(spark, f"{tmp_path}/p").collect()) == [0, 2, 3, 4, 5]


def test_rules_from_config(spark, tmp_path):
    rule = dict(name="n", description="d", pattern="p", pattern_type="string", severity="High", enabled=True,
                protocol="tcp", ports=[80, 443], created_date="", last_modified="")
    (tmp_path / "c.json").write_text(json.dumps({"other": 1, "rules": {"custom_rules": [rule]}}, indent=1))
    assert tables.read_rules(spark, str(tmp_path / "c.json")) == [
        CustomRule("n", "d", "p", "string", "High", True, "tcp", (80, 443))]


def test_dashboard(spark):
    df = frame(spark, [packet(i, i * 3600 * S, size=1024) for i in range(60)])
    chart = dashboard.chart_points(df).collect()
    assert len(chart) == 50 and chart[0].kilobytes == 1
    cards = dashboard.stat_cards(df, alerts(spark, alert(1)), connections(spark, (1, AS_OF, "ACTIVE")), AS_OF, 24 * 40).first()
    assert (cards.packets_text, cards.bytes_text, cards.active_connections, cards.open_alerts) == ("60", "60 KB", 1, 1)


def test_defaults_fill_missing_columns(spark):
    df = sinks.conform(spark.createDataFrame([("a", "b")], "src_ip string, dst_ip string"), CONNECTIONS)
    r = df.first()
    assert (r.state, r.packet_count, r.bytes_sent) == ("ACTIVE", 1, 0) and r.first_seen is not None


def test_newest_is_the_same_for_every_limit(spark):
    df = frame(spark, brute.random_packets(300, 4, 3000))
    df = df.withColumn("timestamp", F.when(F.col("id") % 7 != 0, F.col("timestamp")))  # some rows have no time
    want = [r.id for r in df.orderBy(F.desc_nulls_last("timestamp"), F.desc("id")).collect()]
    for limit in (1, 40, 256, 258, 280, 10_000):
        assert [r.id for r in search.newest(df, limit).collect()] == want[:limit]
    assert [r.id for r in search.newest(df, None).collect()] == want
    assert search.newest(df.filter("id < 0"), 5).count() == 0


def test_alert_view_sorts_without_a_limit(spark):
    a = spark.createDataFrame([(i, "t", "d", f"10.0.0.{i}", "High") for i in (3, 1, 2)],
                              "id int, alert_type string, description string, source_ip string, severity string")
    got = [r.id for r in search.alert_view(a, sort="source_ip", descending=False).collect()]
    assert got == [1, 2, 3]


def test_retention_deletes_days_that_expire_completely(spark, tmp_path):
    path = f"{tmp_path}/packets"
    day = datetime(2024, 1, 10)
    rows = [(i, day - timedelta(days=i), "1.1.1.1", "2.2.2.2") for i in range(4)]
    sinks.append_packets(spark.createDataFrame(rows, "id long, timestamp timestamp, src_ip string, dst_ip string"), path)
    stored = tables.read_packets(spark, path)
    old = maintenance.split(stored, maintenance.old_packets(day, 1))
    assert old.counts().first().asDict() == {"kept": 2, "dropped": 2}
    sinks.rewrite_kept(old.kept, old.dropped, path)
    assert sorted(r.id for r in tables.read_packets(spark, path).collect()) == [0, 1]


def test_time_filters_prune_days(spark, tmp_path):
    path = f"{tmp_path}/packets"
    rows = [(i, datetime(2024, 1, 1) + timedelta(days=i), "1.1.1.1", "2.2.2.2") for i in range(5)]
    sinks.append_packets(spark.createDataFrame(rows, "id long, timestamp timestamp, src_ip string, dst_ip string"), path)
    found = traffic.last_hours(tables.read_packets(spark, path), datetime(2024, 1, 5), 24)
    assert sorted(r.id for r in found.collect()) == [3, 4]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan


def test_checkpoints_need_a_shared_folder_on_a_cluster(monkeypatch):
    class Conf:
        get = staticmethod(lambda key, default=None: default)

    class Context:
        master = "spark://host:7077"

        class _jsc:
            class sc:
                class getCheckpointDir:
                    isDefined = staticmethod(lambda: False)

    class Session:
        conf, sparkContext = Conf, Context

    with pytest.raises(ValueError):
        session.ensure_checkpoint_dir(Session)
