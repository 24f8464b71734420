"""Table schemas and fixed values shared by every operator."""

from __future__ import annotations

from pyspark.sql import types as T

PACKETS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("timestamp", T.TimestampType(), False),
    T.StructField("src_ip", T.StringType(), False),
    T.StructField("dst_ip", T.StringType(), False),
    T.StructField("src_port", T.IntegerType(), True),
    T.StructField("dst_port", T.IntegerType(), True),
    T.StructField("protocol", T.StringType(), False),
    T.StructField("size", T.IntegerType(), False),
    T.StructField("tcp_flags", T.StringType(), True),
    T.StructField("payload_size", T.IntegerType(), False),
])

ALERTS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("timestamp", T.TimestampType(), False),
    T.StructField("alert_type", T.StringType(), False),
    T.StructField("severity", T.StringType(), False),
    T.StructField("source_ip", T.StringType(), False),
    T.StructField("destination_ip", T.StringType(), True),
    T.StructField("description", T.StringType(), False),
    T.StructField("details", T.StringType(), True),
    T.StructField("resolved", T.BooleanType(), False),
    T.StructField("resolved_at", T.TimestampType(), True),
    T.StructField("resolved_by", T.StringType(), True),
])

CONNECTIONS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("src_ip", T.StringType(), False),
    T.StructField("dst_ip", T.StringType(), False),
    T.StructField("src_port", T.IntegerType(), True),
    T.StructField("dst_port", T.IntegerType(), True),
    T.StructField("protocol", T.StringType(), False),
    T.StructField("first_seen", T.TimestampType(), False),
    T.StructField("last_seen", T.TimestampType(), False),
    T.StructField("packet_count", T.LongType(), False),
    T.StructField("bytes_sent", T.LongType(), False),
    T.StructField("bytes_received", T.LongType(), False),
    T.StructField("state", T.StringType(), False),
    T.StructField("tcp_flags_seen", T.StringType(), True),
    T.StructField("avg_packet_size", T.DoubleType(), False),
    T.StructField("connection_duration", T.DoubleType(), False),
])

# Decoded header columns, the input of functions.decode.decode_packets.
HEADERS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("timestamp", T.TimestampType(), False),
    T.StructField("src_ip", T.StringType(), True),
    T.StructField("dst_ip", T.StringType(), True),
    T.StructField("ttl", T.IntegerType(), True),
    T.StructField("proto_num", T.IntegerType(), True),
    T.StructField("tcp_sport", T.IntegerType(), True),
    T.StructField("tcp_dport", T.IntegerType(), True),
    T.StructField("tcp_flag_bits", T.IntegerType(), True),
    T.StructField("udp_sport", T.IntegerType(), True),
    T.StructField("udp_dport", T.IntegerType(), True),
    T.StructField("icmp_type", T.IntegerType(), True),
    T.StructField("icmp_code", T.IntegerType(), True),
    T.StructField("frame_size", T.IntegerType(), True),
    T.StructField("payload_size", T.IntegerType(), True),
])

RULES = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("pattern", T.StringType()),
    T.StructField("pattern_type", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("enabled", T.BooleanType()),
    T.StructField("protocol", T.StringType()),
    T.StructField("ports", T.ArrayType(T.IntegerType())),
    T.StructField("created_date", T.StringType()),
    T.StructField("last_modified", T.StringType()),
])

# ---- fixed values: these must stay as they are for results to agree ----------
SEVERITIES = ("Low", "Medium", "High", "Critical")

PORT_SCAN = "Port Scan"
DDOS = "DDoS Attack"
SUSPICIOUS_PAYLOAD = "Suspicious Payload"
NETWORK_ANOMALY = "Network Anomaly"
CUSTOM_RULE_PREFIX = "Custom Rule: "

PROTOCOL_NAMES = {1: "ICMP", 6: "TCP", 17: "UDP", 47: "GRE", 50: "ESP", 51: "AH"}

TCP_FLAG_BITS = (
    (0x01, "FIN"), (0x02, "SYN"), (0x04, "RST"), (0x08, "PSH"),
    (0x10, "ACK"), (0x20, "URG"), (0x40, "ECE"), (0x80, "CWR"),
)

# Destination ports that never count towards a scan.
COMMON_PORTS = (21, 22, 25, 53, 80, 110, 143, 443, 993, 995)

RULE_PROTOCOLS = ("tcp", "udp", "icmp", "any")
RULE_PATTERN_TYPES = ("regex", "string", "bytes")
# ------------------------------------------------------------------------------

SECOND_US = 1_000_000
