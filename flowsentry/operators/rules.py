"""User-defined payload rules."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.patterns import DIALECT, payload_text
from ..functions.scalars import us
from ..params import CustomRule, Thresholds, validate_rules
from ..schema import CUSTOM_RULE_PREFIX, RULE_PATTERN_TYPES, RULE_PROTOCOLS, SEVERITIES
from . import alerts
from .suppress import thin

BAD_REGEX = "regex does not compile"


def _pattern_found(rule: CustomRule, text: Column) -> Column:
    if rule.pattern_type == "regex":
        return text.rlike(DIALECT + "(?i)" + rule.pattern)
    if rule.pattern_type == "string":
        return F.lower(text).contains(rule.pattern.lower())
    if rule.pattern_type == "bytes":
        try:
            raw = bytes.fromhex(rule.pattern.replace(" ", ""))
        except ValueError:
            return F.lit(False)
        return F.contains(F.encode(text, "UTF-8"), F.lit(bytearray(raw)))
    return F.lit(False)


def _applies(rule: CustomRule, text: Column) -> Column:
    tests = [_pattern_found(rule, text)]
    if rule.protocol.lower() != "any":
        tests.insert(0, F.lower("protocol") == rule.protocol.lower())
    if rule.ports:
        tests.insert(0, F.col("dst_port").isin(*rule.ports))
    return reduce(lambda a, b: a & b, tests)


def compiles(spark: SparkSession, pattern: str) -> bool:
    """Whether the engine that will run a regex rule accepts its pattern."""
    try:
        spark._jvm.java.util.regex.Pattern.compile(DIALECT + "(?i)" + pattern)
    except IllegalArgumentException:
        return False
    return True


def faulty(spark: SparkSession, rules: list[CustomRule]) -> dict[str, list[str]]:
    """Errors by rule name, regexes that do not compile included."""
    bad = validate_rules(rules)
    for r in rules:
        if r.pattern_type == "regex" and r.pattern and not compiles(spark, r.pattern):
            bad.setdefault(r.name, []).append(BAD_REGEX)
    return bad


def rule_matches(packets: DataFrame, rules: list[CustomRule]) -> DataFrame:
    """One row per packet and enabled rule that applies to it.

    Each rule becomes a literal condition, so its pattern is compiled once and the packets are neither joined
    nor shuffled, and read once for any number of rules. A rule whose regex does not compile matches nothing
    (`rule_errors` reports it); other faults are refused.
    """
    return timed_matches(packets, rules).drop("timestamp")


def timed_matches(packets: DataFrame, rules: list[CustomRule]) -> DataFrame:
    """`rule_matches` with the packets' `timestamp`. The conditions name it, so that in a stream they stay above the
    watermark, and packets that match no rule move it on too."""
    spark = packets.sparkSession
    bad = validate_rules(rules)
    if bad:
        raise ValueError(f"invalid rules: {bad}")
    usable = [(i, r) for i, r in enumerate(rules) if r.enabled and (
        r.pattern_type != "regex" or compiles(spark, r.pattern))]
    text = payload_text(packets.columns)
    timed = F.col("timestamp").isNotNull()
    rows = packets.withColumn("_text", text).filter(F.when(timed, F.col("_text") != "").otherwise(F.lit(False))).select(
        "id", "timestamp", us(F.col("timestamp")).alias("us"), "src_ip", "dst_ip", "dst_port", "protocol",
        "payload_size", "_text")
    hits = [F.when(_applies(r, F.col("_text")), F.lit(i)) for i, r in usable] or [F.lit(None).cast("int")]
    fired = rows.select(*[c for c in rows.columns if c != "_text"],
                        F.explode(F.when(timed, F.array_compact(F.array(*hits)))).alias("rule_no"))
    # as many rows as there are rules in the list
    named = spark.createDataFrame(
        [(i, r.name, r.description, r.pattern_type, r.pattern, r.severity) for i, r in usable],
        "rule_no int, rule_name string, rule_description string, pattern_type string, pattern string, severity string")
    return fired.join(F.broadcast(named), "rule_no").select(
        *[c for c in rows.columns if c != "_text"], *named.columns)


def rule_alerts(packets: DataFrame, rules: list[CustomRule], p: Thresholds = Thresholds(),
                **kw) -> DataFrame:
    """Rule alerts after the cooldown per rule and source; one packet may fire several rules."""
    return as_alerts(thin(rule_matches(packets, rules), ["rule_name", "src_ip"], p.alert_cooldown, **kw))


def as_alerts(fired: DataFrame) -> DataFrame:
    """Rule matches that passed their cooldown as common alert records."""
    return fired.select(*rule_alert(F.col))


def rule_alert(c: Callable[[str], Column]) -> list[Column]:
    """The alert of a rule match whose columns `c` gives."""
    text = F.concat(F.lit("Custom rule '"), c("rule_name"), F.lit("' triggered: "), c("rule_description"))
    details = F.struct(
        *[c(n).alias(n) for n in ("rule_name", "rule_description", "pattern_type")],
        F.substring(c("pattern"), 1, 100).alias("matched_pattern"),
        c("dst_port").alias("target_port"), *[c(n).alias(n) for n in ("protocol", "payload_size")])
    return alerts.alert_columns(c("id"), c("us"), alerts.RULE, F.concat(F.lit(CUSTOM_RULE_PREFIX), c("rule_name")),
                                c("severity"), c("src_ip"), c("dst_ip"), text, details)


def rule_errors(rules: DataFrame) -> DataFrame:
    """Column checks over a rules table: name and an `errors` array, empty for a usable rule.

    Regexes are compiled by the engine that runs them; their patterns, part of the configuration, are read for it.
    """
    c = F.col
    regexes = rules.filter("pattern_type = 'regex' and length(pattern) > 0").select("pattern").distinct().collect()
    broken = [r["pattern"] for r in regexes if not compiles(rules.sparkSession, r["pattern"])]
    empty = lambda x: F.coalesce(F.length(c(x)) == 0, F.lit(True))
    known = lambda x, values: F.coalesce(x.isin(*values), F.lit(False))
    copies = rules.groupBy("name").agg(F.count(F.lit(1)).alias("copies"))
    checked = rules.join(copies, "name", "left")
    return checked.select("name", F.array_compact(F.array(
        F.when(empty("name"), F.lit("name is empty")),
        F.when(F.length("name") > 100, F.lit("name is longer than 100")),
        F.when(F.length("description") > 500, F.lit("description is longer than 500")),
        F.when(empty("pattern"), F.lit("pattern is empty")),
        F.when(F.length("pattern") > 1000, F.lit("pattern is longer than 1000")),
        F.when(~known(c("pattern_type"), RULE_PATTERN_TYPES), F.lit("unknown pattern type")),
        F.when((c("pattern_type") == "regex") & c("pattern").isin(broken), F.lit(BAD_REGEX)),
        F.when(~known(c("severity"), SEVERITIES), F.lit("unknown severity")),
        F.when(~known(F.lower("protocol"), RULE_PROTOCOLS), F.lit("unknown protocol")),
        F.when(c("copies") > 1, F.lit("duplicate name")))).alias("errors"))
