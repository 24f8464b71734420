"""Suspicious payloads: pattern categories over payload text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import PATTERNS, any_match, matched_patterns, payload_text
from ..functions.scalars import us, words
from ..params import Thresholds
from ..schema import SUSPICIOUS_PAYLOAD
from ..session import cut
from . import alerts
from .suppress import thin

MIN_PAYLOAD = 10


def is_suspicious(columns: list[str], patterns: dict = PATTERNS) -> Column:
    """Whether a packet's payload is long enough and matches any pattern."""
    text = payload_text(columns)
    return (F.col("payload_size") >= MIN_PAYLOAD) & text.isNotNull() & any_match(text, patterns)


def match_columns(columns: list[str], patterns: dict = PATTERNS) -> list[Column]:
    return [F.col("id"), us(F.col("timestamp")).alias("us"),
            *map(F.col, ("src_ip", "dst_ip", "dst_port", "protocol", "payload_size")),
            matched_patterns(payload_text(columns), patterns).alias("matches")]


def payload_matches(packets: DataFrame, patterns: dict = PATTERNS) -> DataFrame:
    """Packets whose payload matches, with all matched categories in category order."""
    return packets.filter(is_suspicious(packets.columns, patterns)).select(*match_columns(packets.columns, patterns))


def text_matches(table: DataFrame, key: str, text: str, patterns: dict = PATTERNS) -> DataFrame:
    """The same categories over any text column: one row per (key, category) found."""
    found = table.filter(any_match(F.col(text), patterns)).select(
        key, matched_patterns(F.col(text), patterns).alias("m"))
    return found.select(key, F.inline_outer("m"))


def payload_alerts(packets: DataFrame, p: Thresholds = Thresholds(), patterns: dict = PATTERNS,
                   **kw) -> DataFrame:
    """At most one alert per packet: the first matched category whose cooldown has passed.

    The categories are coupled, because a packet that fired one is not offered to the next. But a
    category depends only on those before it: its candidates are the packets matching it that no
    earlier category fired. So the cooldown runs once per category, each time without the packets
    that have fired.
    """
    c = F.col
    matches = cut(payload_matches(packets, patterns))
    # at most one row per category; those that no packet matches have nothing to cool down
    met = {r["category"] for r in matches.select(F.explode("matches.category").alias("category")).distinct().collect()}
    fired = None
    for category in [x for x in patterns if x in met] or list(patterns)[:1]:
        offered = matches.withColumn("m", F.get(F.filter(
            "matches", lambda m: m["category"] == category), F.lit(0))).filter(c("m").isNotNull())
        if fired is not None:
            offered = offered.join(fired.select("id"), "id", "left_anti")
        passed = thin(offered, ["src_ip"], p.alert_cooldown, **kw)
        fired = passed if fired is None else fired.unionByName(passed)
    category = c("m.category")
    text = F.concat(F.lit("Suspicious "), words(category),
                    F.lit(" pattern detected in traffic from "), c("src_ip"), F.lit("."))
    details = F.struct(
        category.alias("pattern_category"), c("dst_port").alias("target_port"), "protocol",
        "payload_size", F.substring("m.pattern", 1, 100).alias("matched_pattern"))
    return alerts.alert_rows(fired, alerts.PAYLOAD, F.lit(SUSPICIOUS_PAYLOAD), c("m.severity"),
                             c("src_ip"), c("dst_ip"), text, details)
