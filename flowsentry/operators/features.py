"""Traffic features per packet from the recent activity of its source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import hour_of_day, is_weekend, us
from ..schema import SECOND_US
from ..session import cut
from .ordered import SLICE_US, number_sessions, running, slice_start

WINDOW_S = 60

VECTOR = ("packet_size", "payload_size", "src_port", "dst_port", "hour_of_day", "is_weekend",
          "packets_per_second", "bytes_per_second", "unique_ports_accessed",
          "is_tcp", "is_udp", "is_icmp", "has_syn", "has_ack", "has_fin", "has_rst")


def _port_spells(rows: DataFrame) -> DataFrame:
    """Spells in which a source keeps using one destination port, never pausing longer than the window.

    A port counts for a later packet exactly while a spell has begun and its last use is at most the
    window ago, so distinct ports over a rolling window become one begin and one end per spell.
    """
    width = WINDOW_S * SECOND_US
    slices = rows.groupBy("src_ip", "port", slice_start("us", width).alias("slice")).agg(
        F.min(F.struct("us", "id")).alias("at"), F.max("us").alias("last_us"))
    slices = slices.withColumn("first_us", F.col("at.us"))
    spells = number_sessions(slices, ["src_ip", "port"], width)
    return spells.groupBy("src_ip", "port", "session_us").agg(
        F.min("at").alias("at"), F.max("last_us").alias("last_us"))


def features(packets: DataFrame) -> DataFrame:
    """The packets with time features and the source's last 60 seconds before each packet.

    Rates and distinct ports cover packets of the same source that came earlier, the moment exactly
    60 s back included; they are zero until a source has two earlier packets. Null ports count as 0.
    """
    c = F.col
    width = WINDOW_S * SECOND_US
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    port = F.coalesce(c("dst_port"), F.lit(0))
    rows = packets.select(
        "id", "timestamp", us(c("timestamp")).alias("us"), "src_ip", "dst_ip",
        c("size").alias("packet_size"), "protocol", F.coalesce("src_port", F.lit(0)).alias("src_port"),
        port.alias("dst_port"), "tcp_flags", "payload_size")

    # an event counts for packets after it: what a packet adds itself is taken off again where it reads the totals
    size = c("packet_size").cast("long")
    add = F.struct(c("us").alias("at_us"), F.lit(1).alias("turn"), F.lit(1).alias("step"),
                   one.alias("seen"), one.alias("recent"), size.alias("recent_bytes"))
    leave = F.struct((c("us") + width + 1).alias("at_us"), F.lit(0).alias("turn"), F.lit(2).alias("step"),
                     zero.alias("seen"), (-one).alias("recent"), (-size).alias("recent_bytes"))
    carried = ["timestamp", "us", "dst_ip", "packet_size", "protocol", "src_port", "dst_port",
               "tcp_flags", "payload_size"]
    events = rows.select("id", "src_ip", *carried, F.explode(F.array(add, leave)).alias("e")).select(
        "id", "src_ip", *[F.when(c("e.step") == 1, c(x)).alias(x) for x in carried], "e.*",
        zero.alias("ports"))
    # one row per spell, read twice below
    spells = cut(_port_spells(rows.select("id", "us", "src_ip", c("dst_port").alias("port"))))
    marks = F.explode(F.array(
        F.struct(c("at.us").alias("at_us"), F.lit(1).alias("turn"), c("at.id").alias("id"), one.alias("ports")),
        F.struct((c("last_us") + width + 1).alias("at_us"), F.lit(0).alias("turn"),
                 zero.alias("id"), (-one).alias("ports"))))
    spell_events = spells.select("src_ip", marks.alias("m")).select(
        "src_ip", "m.*", F.lit(3).alias("step"), zero.alias("seen"), zero.alias("recent"),
        zero.alias("recent_bytes"))
    out = running(events.unionByName(spell_events, allowMissingColumns=True), ["src_ip"],
                  ["at_us", "turn", "id", "step"],
                  {m: F.sum for m in ("seen", "recent", "recent_bytes", "ports")}, SLICE_US)
    out = out.filter("step = 1").withColumns({
        "seen": c("seen") - 1, "recent": c("recent") - 1, "recent_bytes": c("recent_bytes") - c("packet_size")})
    warm = c("seen") > 1
    flags = F.coalesce(c("tcp_flags"), F.lit(""))
    return out.select(
        "id", "timestamp", "us", "src_ip", "dst_ip", "packet_size", "protocol", "src_port", "dst_port",
        flags.alias("tcp_flags"), "payload_size",
        hour_of_day(c("timestamp")).alias("hour_of_day"), is_weekend(c("timestamp")).alias("is_weekend"),
        F.when(warm, c("recent") / F.lit(float(WINDOW_S))).otherwise(0.0).alias("packets_per_second"),
        F.when(warm, c("recent_bytes") / F.lit(float(WINDOW_S))).otherwise(0.0).alias("bytes_per_second"),
        F.when(warm, c("ports")).otherwise(0).alias("unique_ports_accessed"))


def feature_columns() -> dict[str, Column]:
    """The 16 numbers of the feature vector by name, in order."""
    c = F.col
    has = lambda f: c("tcp_flags").contains(f).cast("int")
    derived = {
        "is_weekend": c("is_weekend").cast("int"),
        "is_tcp": (c("protocol") == "TCP").cast("int"), "is_udp": (c("protocol") == "UDP").cast("int"),
        "is_icmp": (c("protocol") == "ICMP").cast("int"),
        "has_syn": has("SYN"), "has_ack": has("ACK"), "has_fin": has("FIN"), "has_rst": has("RST")}
    return {name: derived.get(name, c(name)).cast("float") for name in VECTOR}


def feature_vector() -> Column:
    return F.array(*feature_columns().values())
