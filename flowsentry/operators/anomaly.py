"""Isolation-forest anomaly scores over traffic features.

Trees are grown in parallel tasks from one small sample, and rows are scored over Arrow batches.
The model is two tables (tree nodes, scaling) and a few numbers; its size is fixed by the number of
trees, so it travels with the scoring tasks.

All random choices are digests of what they are made for (seed, tree, node, row), so a forest depends on the
training rows alone, not on where they lie, and any engine can grow it again. Scores are kept to twelve
digits, below which the order of additions would show. The offset is the exact quantile of the training scores.
"""

from __future__ import annotations

import json
import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass, replace
from datetime import datetime
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import fixed
from ..params import Thresholds
from ..schema import NETWORK_ANOMALY
from ..session import cut
from . import alerts
from .baseline import Baseline, compare
from .features import VECTOR, feature_vector
from .traffic import side_by_side

TREES = 100
SAMPLE = 256
SEED = 42
RECENT_SCORES = 1000
#: Intervals into which scores are counted at a time, and how many of them are sorted in the end.
BINS, SORTED = 4096, 20_000
DIGITS = 12

# workers get the functions below by value, so this package need not be installed on them
register_pickle_by_value(sys.modules[__name__])

NODES = "tree int, node int, feature int, threshold double, left int, right int, path double"
NODE_COLUMNS = ("feature", "threshold", "left", "right", "path")


@dataclass(frozen=True)
class Forest:
    """Grown trees, feature scaling and the score offset."""

    nodes: pd.DataFrame
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    sample: int
    offset: float
    contamination: float


def _expected_path(n):
    """Mean path length of an unsuccessful search in a binary search tree of n rows."""
    n = np.asarray(n, dtype=float)
    big = 2.0 * (np.log(np.maximum(n - 1.0, 1.0)) + np.euler_gamma) - 2.0 * (n - 1.0) / np.maximum(n, 1.0)
    return np.where(n > 2, big, np.where(n == 2, 1.0, 0.0))


def _chance(*what) -> float:
    """A number in [0, 1) that the digest of `what` gives."""
    return int(md5(":".join(map(str, what)).encode()).hexdigest()[:8], 16) / 2.0 ** 32


def _drawn(ids: np.ndarray, tree: int, sample: int, seed: int) -> np.ndarray:
    """Places of the rows that a tree draws without replacement: those with the smallest digests."""
    digests = np.array([int(md5(f"{seed}:{tree}:{i}".encode()).hexdigest()[:8], 16) for i in ids.tolist()])
    return np.lexsort((ids, digests))[:sample]


def _grow(x: np.ndarray, ids: np.ndarray, tree: int, sample: int, seed: int) -> list[tuple]:
    """One isolation tree over `sample` rows drawn from the pool; leaves hold the mean path length. Node n has the
    children 2n and 2n + 1."""
    x = x[_drawn(ids, tree, sample, seed)]
    limit = math.ceil(math.log2(max(len(x), 2)))
    rows, todo = [], [(np.arange(len(x)), 1, 0)]
    while todo:
        members, node, depth = todo.pop()
        part = x[members]
        low, high = part.min(axis=0), part.max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth >= limit or len(members) <= 1 or len(usable) == 0:
            rows.append((tree, node, -1, 0.0, -1, -1, depth + float(_expected_path(len(members)))))
            continue
        feature = int(usable[int(_chance(seed, tree, node, "feature") * len(usable))])
        threshold = float(low[feature] + _chance(seed, tree, node, "threshold") * (high[feature] - low[feature]))
        below = part[:, feature] <= threshold
        rows.append((tree, node, feature, threshold, 2 * node, 2 * node + 1, 0.0))
        todo.append((members[below], 2 * node, depth + 1))
        todo.append((members[~below], 2 * node + 1, depth + 1))
    return rows


def vectors(features: DataFrame) -> DataFrame:
    """(id, v): the feature vector of every row."""
    return features.select("id", feature_vector().alias("v"))


def scaling(rows: DataFrame) -> DataFrame:
    """One row: number of rows, mean and population deviation of each vector entry."""
    aggregates = []
    for i, name in enumerate(VECTOR):
        value = F.get("v", F.lit(i)).cast("double")
        aggregates += [F.avg(value).alias(f"m_{name}"), F.stddev_pop(value).alias(f"s_{name}")]
    return rows.agg(F.count(F.lit(1)).alias("n"), *aggregates)


def _stable(x: float | None) -> float:
    """Twelve significant digits, so that the order in which partial sums meet leaves no trace."""
    return float(f"{x or 0.0:.12g}")


def sample_pool(rows: DataFrame, total: int, size: int, seed: int = SEED) -> DataFrame:
    """A uniform sample of `size` out of `total` rows: those with the smallest seeded hashes.

    A threshold on the hash leaves half as many again as are needed, wherever the rows lie, so that
    the final ordering sees a fixed number of rows and not `size` of every task.
    """
    share = min(1.0, (1.5 * size + 1000) / max(total, 1))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"))
    hashed = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return rows.filter(hashed < int(share * (1 << 32))).orderBy(hashed, "id").limit(size)


def fit(features: DataFrame, p: Thresholds = Thresholds(), trees: int = TREES,
        sample: int = SAMPLE, seed: int = SEED) -> Forest | None:
    """Grow the forest; None when there are too few rows to train on."""
    training = cut(vectors(features))
    s = scaling(training).first()
    if s["n"] < p.min_baseline_samples:
        return None
    mean = tuple(_stable(s[f"m_{v}"]) for v in VECTOR)
    scale = tuple(_stable(s[f"s_{v}"]) or 1.0 for v in VECTOR)
    # trees × sample rows at most, whatever the number of training rows; every tree draws from them
    pool = sample_pool(training, s["n"], trees * sample, seed).select("id", "v").toPandas()
    scaled = training.sparkSession.sparkContext.broadcast(
        ((np.stack(pool["v"].to_numpy()).astype(float) - mean) / scale, pool["id"].to_numpy()))

    def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for tree in batch["id"] for r in _grow(*scaled.value, int(tree), sample, seed)]
            yield pd.DataFrame(rows, columns=["tree", "node", "feature", "threshold", "left", "right", "path"])

    # at most 2 × sample − 1 nodes per tree
    nodes = training.sparkSession.range(trees).mapInPandas(grow, NODES).toPandas()
    grown = Forest(nodes, mean, scale, min(sample, s["n"]), 0.0, p.anomaly_contamination)
    return _with_offset(grown, training, p.anomaly_contamination)


def recontaminate(forest: Forest, features: DataFrame, contamination: float) -> Forest:
    """The same trees with the offset taken at another quantile of the training scores."""
    return _with_offset(forest, vectors(features), contamination)


def _with_offset(forest: Forest, training: DataFrame, contamination: float) -> Forest:
    scores = cut(training.select(_score_udf(replace(forest, offset=0.0))("v").alias("score")))
    return replace(forest, offset=quantile(scores, "score", contamination), contamination=contamination)


def quantile(rows: DataFrame, column: str, share: float) -> float:
    """The exact quantile with linear interpolation between neighbours, as a sort of all rows would give it."""
    n = rows.count()
    at = share * (n - 1)
    low, high = math.floor(at), math.ceil(at)
    found = order_statistics(rows, column, [low, high])
    return found[low] + (found[high] - found[low]) * (at - low)


def order_statistics(rows: DataFrame, column: str, ranks: list[int]) -> dict[int, float]:
    """The values at some ranks (from 0) of the sorted column.

    Rows are counted in `BINS` equal intervals of the range that holds a rank, then in those of the interval that
    holds it, until few rows are left or all are equal; only these are sorted. A pass reads the column once and
    returns one small row per interval.
    """
    c = F.col(column)
    rows = rows.filter(c.isNotNull())
    low, high = rows.agg(F.min(c), F.max(c)).first()
    todo, found = [(low, high, 0, rows.count(), sorted(set(ranks)))], {}
    while todo:
        low, high, before, n, wanted = todo.pop()
        part = rows.filter(c.between(low, high))
        width = (high - low) / BINS
        if low == high or low + width == low:
            found |= dict.fromkeys(wanted, low)
        elif n <= SORTED:
            values = sorted(r[0] for r in part.select(c).collect())
            found |= {r: values[r - before] for r in wanted}
        else:
            place = F.least(F.floor((c - low) / width), F.lit(BINS - 1))
            bins = part.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(c).alias("low"), F.max(c).alias("high"))
            for b in sorted(bins.collect()):
                inside = [r for r in wanted if before <= r < before + b["n"]]
                if inside:
                    todo.append((b["low"], b["high"], before, b["n"], inside))
                before += b["n"]
    return found


def _scorer(forest: Forest):
    arrays = []
    for _, t in forest.nodes.groupby("tree"):
        columns = [np.full(int(t["node"].max()) + 1, -1, dtype=t[n].dtype) for n in NODE_COLUMNS]
        for column, name in zip(columns, NODE_COLUMNS):
            column[t["node"].to_numpy()] = t[name].to_numpy()
        arrays.append(columns)
    mean, scale = np.array(forest.mean), np.array(forest.scale)
    norm, offset = float(_expected_path(forest.sample)), forest.offset
    depth = math.ceil(math.log2(max(forest.sample, 2)))

    def batch_scores(vectors: pd.Series) -> np.ndarray:
        x = (np.stack(vectors.to_numpy()).astype(float) - mean) / scale
        rows, total = np.arange(len(x)), np.zeros(len(x))
        for feature, threshold, left, right, path in arrays:
            at = np.ones(len(x), dtype=np.int64)
            for _ in range(depth):
                f = feature[at]
                down = np.where(x[rows, f] <= threshold[at], left[at], right[at])
                at = np.where(f >= 0, down, at)
            total += path[at]
        return np.round(-np.exp2(-total / len(arrays) / norm), DIGITS) - offset

    return batch_scores


def _score_udf(forest: Forest):
    batch_scores = _scorer(forest)

    @F.pandas_udf("double")
    def score_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in batches:
            yield pd.Series(batch_scores(vectors)) if len(vectors) else pd.Series([], dtype=float)

    return score_udf


def score(features: DataFrame, forest: Forest) -> DataFrame:
    """The features with `score`: lower is more anomalous, below 0 counts as an anomaly."""
    return features.withColumn("score", _score_udf(forest)(feature_vector()))


def severity(score: Column) -> Column:
    return F.when(score < -0.8, F.lit("Critical")).when(score < -0.6, F.lit("High")) \
        .when(score < -0.4, F.lit("Medium")).otherwise(F.lit("Low"))


def anomalies(scored: DataFrame, p: Thresholds = Thresholds()) -> DataFrame:
    """Scored packets predicted anomalous whose score is also under the gate."""
    return scored.filter((F.col("score") < 0) & (F.col("score") < p.anomaly_threshold)).withColumn(
        "severity", severity(F.col("score")))


def _description() -> Column:
    return F.format_string("Anomalous network behavior detected from %s. Anomaly score: %s",
                           F.col("src_ip"), fixed(F.col("score"), 3))


def anomaly_alerts(scored: DataFrame, baseline: Baseline, p: Thresholds = Thresholds()) -> DataFrame:
    c = F.col
    found = anomalies(scored, p)
    compared = compare(found, baseline)
    details = F.struct(
        c("score").alias("anomaly_score"), "packet_size", "protocol", "src_port", "dst_port",
        "packets_per_second", "bytes_per_second", "unique_ports_accessed", "hour_of_day", "is_weekend",
        F.struct("packet_size_deviation", "protocol_frequency", "is_rare_protocol", "port_frequency",
                 "is_rare_port", "hourly_frequency", "is_unusual_time").alias("baseline_comparison"))
    text = _description()
    return alerts.alert_rows(compared, alerts.ANOMALY, F.lit(NETWORK_ANOMALY), c("severity"),
                             c("src_ip"), c("dst_ip"), text, details)


def update_training_rows(stored: DataFrame, new: DataFrame, as_of: datetime, hours: int = 24) -> DataFrame:
    """Feature rows to retrain on: old and new ones of the last `hours`."""
    since = F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {int(hours)} HOURS")
    return stored.unionByName(new).filter(F.col("timestamp") >= since)


def mark_false_positives(found: DataFrame, marks: DataFrame) -> DataFrame:
    """Anomalies with `false_positive`; a mark (timestamp, source_ip) hits the first match only."""
    first = found.join(marks.select("timestamp", F.col("source_ip").alias("src_ip")).distinct(),
                       ["timestamp", "src_ip"]).groupBy("timestamp", "src_ip").agg(F.min("id").alias("id"))
    hit = first.select(F.col("id").alias("_hit"))
    return found.join(hit, found["id"] == hit["_hit"], "left").withColumn(
        "false_positive", F.col("_hit").isNotNull()).drop("_hit")


def recent_anomalies(found: DataFrame, limit: int = 10) -> DataFrame:
    """Newest anomalies first."""
    c = F.col
    return found.select(
        "timestamp", c("src_ip").alias("source_ip"), c("dst_ip").alias("destination_ip"),
        c("score").alias("anomaly_score"), "severity", "packet_size", "protocol", "id",
        _description().alias("description"),
    ).orderBy(F.desc("timestamp"), F.desc("id")).limit(limit)


def anomaly_statistics(scored: DataFrame, p: Thresholds = Thresholds()) -> DataFrame:
    """Totals, detection rate, and count, mean, deviation and range of the newest 1000 scores."""
    c = F.col
    found = (c("score") < 0) & (c("score") < p.anomaly_threshold)
    totals = scored.agg(F.count(F.lit(1)).alias("packets_processed"), F.count_if(found).alias("anomalies_detected"))
    newest = scored.select("timestamp", "id", "score").orderBy(F.desc("timestamp"), F.desc("id")).limit(RECENT_SCORES)
    recent = newest.agg(
        F.count("score").alias("score_count"), F.coalesce(F.avg("score"), F.lit(0.0)).alias("score_mean"),
        F.coalesce(F.stddev_pop("score"), F.lit(0.0)).alias("score_std"),
        F.coalesce(F.min("score"), F.lit(0.0)).alias("score_min"),
        F.coalesce(F.max("score"), F.lit(0.0)).alias("score_max"))
    return side_by_side(totals, recent).withColumn(
        "detection_rate", c("anomalies_detected") / F.greatest(c("packets_processed"), F.lit(1)))


def save(forest: Forest, baseline: Baseline, spark: SparkSession, folder: str) -> None:
    """Model, scaling and baseline as Parquet and JSON tables."""
    spark.createDataFrame(forest.nodes, NODES).coalesce(1).write.mode("overwrite").parquet(f"{folder}/nodes")
    params = {"mean": forest.mean, "scale": forest.scale, "sample": forest.sample,
              "offset": forest.offset, "contamination": forest.contamination}
    spark.createDataFrame([(json.dumps(params),)], "value string").coalesce(1).write.mode(
        "overwrite").text(f"{folder}/params")
    for name in ("scalars", "protocols", "ports", "hours"):
        getattr(baseline, name).write.mode("overwrite").parquet(f"{folder}/baseline_{name}")


def load(spark: SparkSession, folder: str) -> tuple[Forest, Baseline]:
    nodes = spark.read.schema(NODES).parquet(f"{folder}/nodes").toPandas()
    params = json.loads(spark.read.text(f"{folder}/params").first()["value"])
    params["mean"], params["scale"] = tuple(params["mean"]), tuple(params["scale"])
    tables = {n: spark.read.parquet(f"{folder}/baseline_{n}") for n in ("scalars", "protocols", "ports", "hours")}
    return Forest(nodes, **params), Baseline(**tables)
