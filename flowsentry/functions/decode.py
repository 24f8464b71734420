"""Header columns to packet records, and the string keys derived from a packet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import PROTOCOL_NAMES, TCP_FLAG_BITS


def protocol_name(proto_num: Column) -> Column:
    """IP protocol number to its name, `PROTO_<n>` where it has none."""
    names = F.create_map(*[F.lit(x) for pair in PROTOCOL_NAMES.items() for x in pair])
    return F.coalesce(names[proto_num], F.concat(F.lit("PROTO_"), proto_num.cast("string")))


def tcp_flag_names(bits: Column) -> Column:
    """Flag bits to names in bit order joined by a pipe; `NONE` when no bit is set."""
    named = F.array_compact(F.array(*[
        F.when(bits.bitwiseAND(F.lit(bit)) != 0, F.lit(name)) for bit, name in TCP_FLAG_BITS
    ]))
    return F.when(F.size(named) == 0, F.lit("NONE")).otherwise(F.array_join(named, "|"))


def timestamp_text(ts: Column) -> Column:
    """`YYYY-MM-DD HH:MM:SS[.ffffff]`, the fraction left out when it is zero."""
    fraction = F.pmod(F.unix_micros(ts), F.lit(1_000_000))
    return F.when(fraction == 0, F.date_format(ts, "yyyy-MM-dd HH:mm:ss")) \
        .otherwise(F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("None"))


def packet_id(ts, src_ip, dst_ip, src_port, dst_port, protocol) -> Column:
    """First 16 hex digits of the md5 over the identifying fields."""
    return F.substring(F.md5(F.concat(
        timestamp_text(ts), src_ip, dst_ip, _text(src_port), _text(dst_port), protocol,
    )), 1, 16)


def flow_key(src_ip, src_port, dst_ip, dst_port, protocol) -> Column:
    """`src:port->dst:port:protocol`; swap the endpoints for the reverse key."""
    return F.concat(src_ip, F.lit(":"), _text(src_port), F.lit("->"),
                    dst_ip, F.lit(":"), _text(dst_port), F.lit(":"), protocol)


def decode_packets(headers: DataFrame) -> DataFrame:
    """Packet records from decoded header columns (see schema.HEADERS).

    Frames without an IP layer are dropped. The transport is the first present of TCP, UDP and
    ICMP; ICMP type and code take the port columns; anything else has ports 0 and empty flags.
    """
    c = F.col
    is_tcp, is_udp, is_icmp = (c(x).isNotNull() for x in ("tcp_sport", "udp_sport", "icmp_type"))
    src_port = F.when(is_tcp, c("tcp_sport")).when(is_udp, c("udp_sport")) \
        .when(is_icmp, c("icmp_type")).otherwise(F.lit(0))
    dst_port = F.when(is_tcp, c("tcp_dport")).when(is_udp, c("udp_dport")) \
        .when(is_icmp, c("icmp_code")).otherwise(F.lit(0))
    known = is_tcp | is_udp | is_icmp
    out = headers.filter(c("src_ip").isNotNull() & c("dst_ip").isNotNull()).select(
        "id", "timestamp", "src_ip", "dst_ip",
        src_port.alias("src_port"), dst_port.alias("dst_port"),
        protocol_name(c("proto_num")).alias("protocol"),
        c("frame_size").alias("size"),
        F.when(is_tcp, tcp_flag_names(F.coalesce(c("tcp_flag_bits"), F.lit(0))))
        .otherwise(F.lit("")).alias("tcp_flags"),
        F.when(known, F.coalesce(c("payload_size"), F.lit(0))).otherwise(F.lit(0))
        .alias("payload_size"),
        "ttl",
    )
    return out.withColumn("packet_id", packet_id(
        c("timestamp"), c("src_ip"), c("dst_ip"), c("src_port"), c("dst_port"), c("protocol")))
