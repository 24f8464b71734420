"""Properties of the isolation forest, and its persistence."""

import random

import numpy as np
import pytest
from brute import S, frame, packet
from pyspark.sql import functions as F

from flowsentry.operators import anomaly, baseline, features
from flowsentry.params import Thresholds

OPEN = Thresholds(anomaly_threshold=0.0, min_baseline_samples=200)


@pytest.fixture(scope="module")
def packets(spark):
    rng = random.Random(1)
    ps = [packet(i, i * S, f"h{i % 5}", "s", 40000 + i % 7, rng.choice([80, 443]), size=int(rng.gauss(500, 50)),
                 flags="ACK", payload=100) for i in range(600)]
    ps.append(packet(600, 600 * S, "odd", "s", 1, 65000, "UDP", 60000, None, 59000))
    return frame(spark, ps).cache()


@pytest.fixture(scope="module")
def fitted(spark, packets):
    f = features.features(packets).cache()
    return f, anomaly.fit(f, OPEN, trees=50)


def test_outlier_scores_lowest_and_share_is_near_contamination(fitted):
    f, forest = fitted
    rows = anomaly.score(f, forest).orderBy("score").collect()
    assert rows[0].id == 600
    assert 0.05 < sum(r.score < 0 for r in rows) / len(rows) < 0.15


def test_fit_does_not_depend_on_row_order(spark, fitted):
    f, forest = fitted
    again = anomaly.fit(f.repartition(7, F.rand(3)), OPEN, trees=50)
    order = lambda m: m.nodes.sort_values(["tree", "node"]).reset_index(drop=True)
    assert order(again).equals(order(forest))
    assert again.offset == forest.offset


def test_offset_is_the_quantile_of_the_sorted_scores(fitted):
    f, forest = fitted
    raw = sorted(r.score + forest.offset for r in anomaly.score(f, forest).collect())
    assert forest.offset == pytest.approx(np.percentile(raw, 10), abs=1e-12)


@pytest.mark.parametrize("kind", ["spread", "equal", "ties", "tiny"])
def test_quantiles_are_exact(spark, monkeypatch, kind):
    monkeypatch.setattr(anomaly, "SORTED", 10)
    monkeypatch.setattr(anomaly, "BINS", 7)
    rng = random.Random(5)
    values = {"spread": [rng.lognormvariate(0, 3) for _ in range(2000)], "equal": [0.25] * 500,
              "ties": [float(rng.randint(0, 3)) for _ in range(900)] + [1e9], "tiny": [1 + i * 2.0 ** -52 for i in range(300)]}[kind]
    rows = spark.createDataFrame([(v,) for v in values], "s double").repartition(5).cache()
    for q in (0.0, 0.1, 0.5, 0.777, 1.0):
        assert anomaly.quantile(rows, "s", q) == pytest.approx(np.percentile(values, 100 * q), rel=1e-15)
    assert anomaly.order_statistics(rows, "s", [0, 5, 77]) == {k: sorted(values)[k] for k in (0, 5, 77)}


def test_too_few_rows(fitted):
    assert anomaly.fit(fitted[0], Thresholds(min_baseline_samples=10_000)) is None


def test_recontamination_moves_the_offset_only(fitted):
    f, forest = fitted
    wider = anomaly.recontaminate(forest, f, 0.3)
    assert wider.offset > forest.offset and wider.nodes is forest.nodes
    assert anomaly.score(f, wider).filter("score < 0").count() > anomaly.score(f, forest).filter("score < 0").count()


def test_save_and_load(spark, packets, fitted, tmp_path):
    f, forest = fitted
    b = baseline.learn(packets)
    anomaly.save(forest, b, spark, str(tmp_path))
    loaded, lb = anomaly.load(spark, str(tmp_path))
    assert loaded.offset == forest.offset
    key = lambda m: {r.id: r.score for r in anomaly.score(f, m).collect()}
    assert key(loaded) == key(forest)
    assert lb.scalars.first() == b.scalars.first()


def test_alerts_feed_and_marks(spark, packets, fitted):
    f, forest = fitted
    scored = anomaly.score(f, forest)
    found = anomaly.anomalies(scored, OPEN)
    out = anomaly.anomaly_alerts(scored, baseline.learn(packets), OPEN)
    assert out.count() == found.count()
    assert '"baseline_comparison"' in out.first().details
    marks = found.filter("id = 600").select("timestamp", F.col("src_ip").alias("source_ip"))
    assert anomaly.mark_false_positives(found, marks).filter("false_positive").first().id == 600
    recent = anomaly.recent_anomalies(found, 3).collect()
    assert recent[0].id == 600 and len(recent) == 3
    s = anomaly.anomaly_statistics(scored, OPEN).first()
    assert s.packets_processed == 601 and s.anomalies_detected == found.count() and s.score_count == 601


def test_default_gate_is_strict(fitted):
    f, forest = fitted
    assert anomaly.anomalies(anomaly.score(f, forest)).filter("score >= -0.5").count() == 0


@pytest.mark.parametrize("score,want", [(-0.81, "Critical"), (-0.8, "High"), (-0.6, "Medium"), (-0.4, "Low")])
def test_severity(spark, score, want):
    assert spark.range(1).select(anomaly.severity(F.lit(score)).alias("s")).first().s == want


def test_training_rows_window(spark, fitted):
    from datetime import datetime
    f = fitted[0]
    kept = anomaly.update_training_rows(f, f.limit(0), datetime(2024, 1, 2, 0, 5), 24)
    assert kept.count() == f.filter(F.col("us") >= 1704067200000000 + 300 * S).count()


def test_pool_is_a_sample_of_the_asked_size(spark):
    rows = spark.range(200_000)
    pool = anomaly.sample_pool(rows, 200_000, 1000)
    assert pool.count() == 1000 and pool.distinct().count() == 1000
    assert 80_000 < pool.agg(F.avg("id")).first()[0] < 120_000
    assert anomaly.sample_pool(spark.range(50), 50, 1000).count() == 50
