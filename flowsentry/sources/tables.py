"""Readers for the stored tables, custom rules and packet streams."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..params import CustomRule
from ..schema import ALERTS, CONNECTIONS, PACKETS, RULES


def read_table(spark: SparkSession, path: str, schema, start: datetime | None = None,
               end: datetime | None = None) -> DataFrame:
    """A stored table; `start` and `end` prune its date partitions where it has any, and so do the time
    filters of the operators: the partition column stays, behind the table's own."""
    df = spark.read.parquet(path)
    if "date" in df.columns:
        if start is not None:
            df = df.filter(F.col("date") >= F.lit(start).cast("date"))
        if end is not None:
            df = df.filter(F.col("date") <= F.lit(end).cast("date"))
    day = ["date"] if "date" in df.columns and "date" not in schema.names else []
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema], *day)


def read_packets(spark: SparkSession, path: str, **span) -> DataFrame:
    return read_table(spark, path, PACKETS, **span)


def read_alerts(spark: SparkSession, path: str, **span) -> DataFrame:
    return read_table(spark, path, ALERTS, **span)


def read_connections(spark: SparkSession, path: str, **span) -> DataFrame:
    return read_table(spark, path, CONNECTIONS, **span)


def read_rules_table(spark: SparkSession, path: str) -> DataFrame:
    """Custom rules from a JSON configuration document, `rules.custom_rules`."""
    shape = "rules struct<custom_rules: array<{}>>".format(RULES.simpleString())
    config = spark.read.schema(shape).json(path, multiLine=True)
    return config.select(F.explode("rules.custom_rules").alias("r")).select("r.*")


def rules_from_table(table: DataFrame, most: int | None = None) -> list[CustomRule]:
    """The rules as parameters: configuration, one small row each. With `most`, more rows are an error."""
    rows = (table if most is None else table.limit(most + 1)).collect()
    if most is not None and len(rows) > most:
        raise ValueError(f"more than {most} rules")
    return [CustomRule(
        name=r["name"], description=r["description"] or "", pattern=r["pattern"],
        pattern_type=r["pattern_type"], severity=r["severity"] or "Medium",
        enabled=True if r["enabled"] is None else r["enabled"], protocol=r["protocol"] or "any",
        ports=tuple(r["ports"] or ())) for r in rows]


def read_rules(spark: SparkSession, path: str) -> list[CustomRule]:
    return rules_from_table(read_rules_table(spark, path))


def stream_packets(spark: SparkSession, path: str, file_format: str = "parquet",
                   files_per_trigger: int = 100) -> DataFrame:
    """Packets arriving as files; `files_per_trigger` bounds a micro-batch."""
    return (spark.readStream.schema(PACKETS).option("maxFilesPerTrigger", files_per_trigger)
            .format(file_format).load(path))


def stream_kafka(spark: SparkSession, servers: str, topic: str, offsets_per_trigger: int = 1_000_000) -> DataFrame:
    """Packets as JSON records from Kafka (needs the Kafka connector on the class path)."""
    raw = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
           .option("subscribe", topic).option("maxOffsetsPerTrigger", offsets_per_trigger).load())
    return raw.select(F.from_json(F.col("value").cast("string"), PACKETS).alias("p")).select("p.*")
