"""Bidirectional flow sessions with TCP state, and connection tables derived from packets."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import from_us, us
from ..schema import SECOND_US
from .ordered import SLICE_US, number_sessions, slice_start

# State numbers used while folding; the order is ours, the names are fixed.
STATES = ("UNKNOWN", "SYN_SENT", "SYN_RECEIVED", "ESTABLISHED", "FIN_WAIT", "RESET")
UNKNOWN, SYN_SENT, SYN_RECEIVED, ESTABLISHED, FIN_WAIT, RESET = range(6)
KEEP = -1

FLOW = ["ip_a", "port_a", "ip_b", "port_b", "protocol"]
FLOW_SLICE_US = SLICE_US
HOUR_US = 3600 * SECOND_US
DAY_US = 24 * HOUR_US


def _has(flag: str) -> Column:
    return F.coalesce(F.col("tcp_flags"), F.lit("")).contains(flag)


def canonical(packets: DataFrame, *more: str) -> DataFrame:
    """Both directions under one key: (ip_a, port_a) is the smaller endpoint, `fwd` the direction; with the columns `more`.

    A null port stays null and compares as port -1.
    """
    src = F.struct(F.col("src_ip").alias("ip"), F.coalesce("src_port", F.lit(-1)).alias("port"))
    dst = F.struct(F.col("dst_ip").alias("ip"), F.coalesce("dst_port", F.lit(-1)).alias("port"))
    a, b = F.least(src, dst), F.greatest(src, dst)
    return packets.select(
        a["ip"].alias("ip_a"), a["port"].alias("port_a"),
        b["ip"].alias("ip_b"), b["port"].alias("port_b"), "protocol",
        (src <= dst).alias("fwd"), us(F.col("timestamp")).alias("us"), "id", "size",
        _has("SYN").alias("syn"), _has("ACK").alias("ack"),
        _has("FIN").alias("fin"), _has("RST").alias("rst"), *more)


def _slice_summaries(packets: DataFrame) -> DataFrame:
    """One row per (flow, slice): counts, bytes per direction, and what the slice does to the state.

    A packet either sets the state whatever it was (SYN, SYN+ACK, FIN or RST without ACK), or is an
    ACK, which completes a handshake first and only then looks at FIN and RST, or changes nothing.
    Positions are row numbers inside the slice, so all aggregates below are plain numbers.
    """
    c = F.col
    sets = F.when(c("syn"), F.when(c("ack"), SYN_RECEIVED).otherwise(SYN_SENT)) \
        .when(~c("ack") & c("fin"), FIN_WAIT).when(~c("ack") & c("rst"), RESET)
    acks = ~c("syn") & c("ack")
    closes = F.when(acks & c("fin"), FIN_WAIT).when(acks & c("rst"), RESET)
    first_sets = F.when(c("syn"), F.when(c("ack"), SYN_RECEIVED).otherwise(SYN_SENT)).otherwise(UNKNOWN)

    rows = canonical(packets).withColumn("slice", slice_start("us", FLOW_SLICE_US))
    inside = Window.partitionBy(*FLOW, "slice").orderBy("us", "id")
    rows = rows.withColumn("pos", F.row_number().over(inside)).withColumn("is_ack", acks)
    rows = rows.withColumn(
        "ack_before", F.max(F.when(c("is_ack"), c("pos"))).over(
            inside.rowsBetween(Window.unboundedPreceding, -1)))
    at_first = c("pos") == 1
    return rows.groupBy(*FLOW, "slice").agg(
        F.min("us").alias("first_us"), F.max("us").alias("last_us"),
        F.max(F.when(at_first, c("fwd"))).alias("first_fwd"),
        F.max(F.when(at_first, first_sets)).alias("initial"),
        F.count(F.lit(1)).alias("packets"),
        F.sum(F.when(c("fwd"), c("size")).otherwise(0)).alias("bytes_fwd"),
        F.sum(F.when(c("fwd"), 0).otherwise(c("size"))).alias("bytes_rev"),
        F.max(F.when(sets.isNotNull(), c("pos") * 8 + sets)).alias("set_at"),
        F.max(F.when(closes.isNotNull(), c("pos") * 8 + closes)).alias("close_at"),
        F.max(F.when(closes.isNotNull(), c("ack_before"))).alias("ack_before_close"),
        F.min(F.when(c("is_ack"), c("pos"))).alias("first_ack"),
        F.max(F.when(c("is_ack"), c("pos"))).alias("last_ack"))


def _with_effects(s: DataFrame) -> DataFrame:
    """`begin`: the state after the slice when it opens the session; `mid_handshake`/`mid_other`: the
    state after it when a handshake was open before it, or not (KEEP leaves the state as it was)."""
    c = F.col
    zero = F.lit(0)
    set_pos = F.coalesce(F.floor(c("set_at") / 8), zero)
    set_state = F.pmod(c("set_at"), F.lit(8))
    close_pos = F.coalesce(F.floor(c("close_at") / 8), zero)
    close_state = F.pmod(c("close_at"), F.lit(8))
    last_ack = F.coalesce(c("last_ack"), zero)
    ack_before_close = F.coalesce(c("ack_before_close"), zero)

    def after(state: Column, pos: Column) -> Column:
        handshake = state.isin(SYN_SENT, SYN_RECEIVED)
        closed = close_pos > pos
        return (F.when(handshake & (last_ack <= pos), state)
                .when(handshake & closed & (ack_before_close > pos), close_state)
                .when(handshake, F.lit(ESTABLISHED))
                .when(closed, close_state)
                .otherwise(state))

    begin = F.when(set_pos > 1, after(set_state, set_pos)).otherwise(after(c("initial"), F.lit(1)))
    settled = c("set_at").isNotNull()
    open_shake = F.when(c("first_ack").isNull(), F.lit(KEEP)) \
        .when((close_pos > 0) & (c("first_ack") < close_pos), close_state).otherwise(F.lit(ESTABLISHED))
    other = F.when(close_pos > 0, close_state).otherwise(F.lit(KEEP))
    return s.select(
        *FLOW, "slice", "first_us", "last_us", "first_fwd", "packets", "bytes_fwd", "bytes_rev",
        begin.cast("int").alias("begin"),
        F.when(settled, after(set_state, set_pos)).otherwise(open_shake).cast("int").alias("mid_handshake"),
        F.when(settled, after(set_state, set_pos)).otherwise(other).cast("int").alias("mid_other"))


def _moved(state: Column, effect: Column) -> Column:
    """The state, or the effect on it so far, after one more effect (`mid_handshake`, `mid_other`)."""
    to = F.when(state.isin(SYN_SENT, SYN_RECEIVED), effect["mid_handshake"]).otherwise(effect["mid_other"])
    return F.when(to == KEEP, state).otherwise(to)


def _composed(first: Column, then: Column) -> Column:
    """The effect of two stretches of packets, one after the other. An effect is a map from state to state that
    tells handshakes from all other states, and so is what two of them do."""
    def part(name):
        return F.when(first[name] == KEEP, then[name]).otherwise(_moved(first[name], then)).alias(name)

    return F.struct(_moved(first["begin"], then).alias("begin"), part("mid_handshake"), part("mid_other"))


def slice_effect(rows: Column) -> Column:
    """Totals and effect of a slice from its packets in order: an array of (us, size, fwd, syn, ack, fin, rst)."""
    number = lambda n: F.lit(n).cast("int")

    def effect(r):
        opened = F.when(r["ack"], number(SYN_RECEIVED)).otherwise(number(SYN_SENT))
        ends = F.when(r["fin"], number(FIN_WAIT)).when(r["rst"], number(RESET)).otherwise(number(KEEP))
        return F.struct(
            F.when(r["syn"], opened).otherwise(number(UNKNOWN)).alias("begin"),
            F.when(r["syn"], opened).when(r["ack"], number(ESTABLISHED)).otherwise(ends).alias("mid_handshake"),
            F.when(r["syn"], opened).otherwise(ends).alias("mid_other"))

    steps = F.transform(rows, effect)
    whole = F.aggregate(F.slice(steps, 2, F.size(steps)), F.element_at(steps, 1), _composed)
    zero = F.lit(0).cast("long")
    sent = lambda fwd: F.aggregate(rows, zero, lambda n, r: n + F.when(r["fwd"] == fwd, r["size"]).otherwise(0))
    first, last = F.element_at(rows, 1), F.element_at(rows, -1)
    return F.struct(
        first["us"].alias("first_us"), last["us"].alias("last_us"), F.size(rows).cast("long").alias("packets"),
        sent(True).alias("bytes_fwd"), sent(False).alias("bytes_rev"), first["fwd"].alias("first_fwd"),
        *[whole[n].alias(n) for n in ("begin", "mid_handshake", "mid_other")])


def _merged(stretches: DataFrame, keys: list[str]) -> DataFrame:
    """Stretches of packets merged to one per key: totals, and the effect of one after the other.

    The array that is folded holds one small entry per stretch.
    """
    c = F.col
    steps = F.array_sort(F.collect_list(F.struct("first_us", "begin", "mid_handshake", "mid_other")))
    found = stretches.groupBy(*keys).agg(
        F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"), F.sum("packets").alias("packets"),
        F.sum("bytes_fwd").alias("bytes_fwd"), F.sum("bytes_rev").alias("bytes_rev"),
        F.min_by("first_fwd", "first_us").alias("first_fwd"), steps.alias("steps"))
    start = F.element_at("steps", 1)
    effect = F.aggregate(
        F.slice("steps", 2, F.size("steps")), F.struct(start["begin"], start["mid_handshake"], start["mid_other"]), _composed)
    return found.withColumn("effect", effect).select(
        *keys, "first_us", "last_us", "packets", "bytes_fwd", "bytes_rev", "first_fwd",
        *[c("effect")[n].alias(n) for n in ("begin", "mid_handshake", "mid_other")])


def flow_sessions(packets: DataFrame, idle_seconds: int = 300) -> DataFrame:
    """Flows in either direction, ended by more than `idle_seconds` of silence.

    The first packet's direction gives source and destination, bytes sent and bytes received.
    TCP flows carry the folded state, others `ACTIVE`.
    """
    gap = idle_seconds * SECOND_US
    if gap < FLOW_SLICE_US:
        raise ValueError("idle_seconds must be at least 10")
    slices = number_sessions(_with_effects(_slice_summaries(packets)), FLOW, gap)
    names = F.array(*[F.lit(s) for s in STATES])
    c = F.col
    # slices to hours, hours to days, days to sessions: no array is longer than the parts of the next larger stretch.
    # All go by the flow, as the slices are dealt already
    key = [*FLOW, "session_us"]
    hours = _merged(slices.withColumn("hour", slice_start("slice", HOUR_US)), [*key, "hour"])
    days = _merged(hours.withColumn("day", slice_start("hour", DAY_US)), [*key, "day"])
    s = _merged(days, key).select(
        *key, "last_us", c("first_fwd").alias("fwd"), c("packets").alias("packet_count"), "bytes_fwd", "bytes_rev",
        c("begin").alias("state_no"))

    def port(x, y):
        p = F.when(c("fwd"), c(x)).otherwise(c(y))
        return F.when(p >= 0, p)

    return s.select(
        F.when(c("fwd"), c("ip_a")).otherwise(c("ip_b")).alias("src_ip"),
        F.when(c("fwd"), c("ip_b")).otherwise(c("ip_a")).alias("dst_ip"),
        port("port_a", "port_b").alias("src_port"), port("port_b", "port_a").alias("dst_port"),
        "protocol",
        from_us(c("session_us")).alias("first_seen"), from_us(c("last_us")).alias("last_seen"),
        "packet_count",
        F.when(c("fwd"), c("bytes_fwd")).otherwise(c("bytes_rev")).alias("bytes_sent"),
        F.when(c("fwd"), c("bytes_rev")).otherwise(c("bytes_fwd")).alias("bytes_received"),
        F.when(c("protocol") == "TCP", F.element_at(names, c("state_no") + 1))
        .otherwise(F.lit("ACTIVE")).alias("state"),
        ((c("last_us") - c("session_us")) / F.lit(1e6)).alias("connection_duration"))


def connections_from_flows(flows: DataFrame) -> DataFrame:
    """The stored connections table: flows with a stable id and the mean packet size."""
    total = F.col("bytes_sent") + F.col("bytes_received")
    return flows.withColumn("avg_packet_size", total / F.col("packet_count")).withColumn(
        "id", F.xxhash64("src_ip", "dst_ip", "src_port", "dst_port", "protocol", "first_seen"))


def directed_connections(packets: DataFrame) -> DataFrame:
    """Connection rows per directed 5-tuple, reverse traffic kept apart; null ports are one group."""
    c = F.col
    return _with_averages(packets.groupBy("src_ip", "dst_ip", "src_port", "dst_port", "protocol").agg(
        F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"),
        F.count(F.lit(1)).alias("packet_count"), F.sum(c("size").cast("long")).alias("bytes_sent"),
        F.lit(0).cast("long").alias("bytes_received")))


def merge_connections(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Apply an increment of directed connections: union and aggregate again instead of updating."""
    keys = ["src_ip", "dst_ip", "src_port", "dst_port", "protocol"]
    cols = [*keys, "first_seen", "last_seen", "packet_count", "bytes_sent", "bytes_received"]
    return _with_averages(stored.select(*cols).unionByName(new.select(*cols)).groupBy(*keys).agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.sum("packet_count").alias("packet_count"), F.sum("bytes_sent").alias("bytes_sent"),
        F.sum("bytes_received").alias("bytes_received")))


def _with_averages(df: DataFrame) -> DataFrame:
    total = F.col("bytes_sent") + F.col("bytes_received")
    return df.withColumn("avg_packet_size", total / F.col("packet_count")).withColumn(
        "connection_duration",
        (us(F.col("last_seen")) - us(F.col("first_seen"))) / F.lit(1e6))


def active_flows(flows: DataFrame, as_of: datetime, idle_seconds: int = 300) -> DataFrame:
    """Flows not yet idle for longer than the timeout at `as_of`."""
    moment = F.lit(as_of).cast("timestamp")
    return flows.filter((F.col("last_seen") <= moment) & (
        us(moment) - us(F.col("last_seen")) <= idle_seconds * SECOND_US))


def host_pairs(flows: DataFrame) -> DataFrame:
    """Traffic summary per unordered host pair; protocols and ports as sorted sets.

    Flows are summed per port pair first, so a busy host pair reaches its task pre-aggregated; a set
    of ports holds 65,535 entries at most.
    """
    c = F.col
    by_port = flows.groupBy(
        F.least("src_ip", "dst_ip").alias("host_a"), F.greatest("src_ip", "dst_ip").alias("host_b"),
        "protocol", "src_port", "dst_port").agg(
        F.sum("packet_count").alias("packets"),
        F.sum(c("bytes_sent") + c("bytes_received")).alias("bytes"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))

    def used(name):
        return F.collect_set(F.when(c(name) > 0, c(name)))

    return by_port.groupBy("host_a", "host_b").agg(
        F.sum("packets").alias("total_packets"), F.sum("bytes").alias("total_bytes"),
        F.array_sort(F.collect_set("protocol")).alias("protocols"),
        F.array_sort(F.array_union(used("src_port"), used("dst_port"))).alias("ports"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
    ).withColumn("duration", (us(c("last_seen")) - us(c("first_seen"))) / F.lit(1e6))


def flow_summary(flows: DataFrame, ip_1: str, ip_2: str) -> DataFrame:
    """The host-pair summary of two addresses, in either direction; empty when they never spoke."""
    a, b = sorted((ip_1, ip_2))
    both = flows.filter(((F.col("src_ip") == a) & (F.col("dst_ip") == b)) |
                        ((F.col("src_ip") == b) & (F.col("dst_ip") == a)))
    return host_pairs(both)


def top_talkers(flows: DataFrame, limit: int = 10) -> DataFrame:
    """Addresses by packets of the flows they take part in, at either end."""
    return (flows.select(F.explode(F.array("src_ip", "dst_ip")).alias("ip"), "packet_count")
            .groupBy("ip").agg(F.sum("packet_count").alias("packets"))
            .orderBy(F.desc("packets"), "ip").limit(limit))
