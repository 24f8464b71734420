"""SQL twins of the named queries for DuckDB, over the same tables."""

from __future__ import annotations

MINUTE, HOUR, DAY = 60_000_000, 3_600_000_000, 86_400_000_000


def moment(text: str) -> str:
    return f"epoch_us(TIMESTAMP '{text}')"


AS_OF, START = moment("2024-01-31 00:00:00"), moment("2024-01-01 00:00:00")
FAST_AS_OF = moment("2024-01-01 07:12:00")
RANGE = f"{moment('2024-01-10 00:00:00')} AND {moment('2024-01-20 00:00:00')}"

# Common table expressions by name; a query names those it needs, in order.
CTE = {
    "base": """
  ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, epoch_us(ts) AS raw_us FROM events),
  parts AS (
    SELECT event_id AS id, raw_us, 1704067200000000 + (raw_us - 1704067200000000) // 100 AS fast_us,
      event_id % 6 IN (1, 3) AS rev, event_type = 'signup' AND event_id % 5 = 0 AS icmp,
      '203.0.113.' || (user_id % 20) AS client, '192.168.1.' || (user_id % 7) AS server,
      CAST(40000 + user_id % 5 AS INTEGER) AS cport,
      CAST(CASE WHEN event_type = 'error' AND user_id % 20 < 4 THEN 8000 + k WHEN event_type = 'signup' THEN 80
        WHEN event_type = 'purchase' THEN 443 WHEN event_type = 'view' THEN 53
        WHEN event_type = 'click' THEN 8080 ELSE 22 END AS INTEGER) AS sport,
      CASE WHEN event_type = 'view' THEN 'UDP' WHEN event_type = 'signup' AND event_id % 5 = 0 THEN 'ICMP'
        ELSE 'TCP' END AS protocol,
      CAST(64 + CAST(floor(value * 100) AS BIGINT) % 1437 AS INTEGER) AS size,
      ['SYN', 'SYN|ACK', 'ACK', 'PSH|ACK', 'FIN|ACK', 'RST'][CAST(event_id % 6 AS INTEGER) + 1] AS flag,
      CAST(CAST(floor(value) AS BIGINT) % 400 AS INTEGER) AS payload_size FROM ev),
  allp AS (
    SELECT id, raw_us, fast_us, CASE WHEN rev THEN server ELSE client END AS src_ip,
      CASE WHEN rev THEN client ELSE server END AS dst_ip,
      CASE WHEN NOT icmp THEN CASE WHEN rev THEN sport ELSE cport END END AS src_port,
      CASE WHEN NOT icmp THEN CASE WHEN rev THEN cport ELSE sport END END AS dst_port,
      protocol, size, CASE WHEN protocol = 'TCP' THEN flag END AS tcp_flags, payload_size FROM parts),
  p AS (SELECT * EXCLUDE (raw_us, fast_us), raw_us AS us FROM allp),
  pf AS (SELECT * EXCLUDE (raw_us, fast_us), fast_us AS us FROM allp),
  a AS (
    SELECT event_id AS id, raw_us AS us,
      ['Port Scan', 'DDoS Attack', 'Suspicious Payload', 'Network Anomaly', 'Brute Force'][
        CAST(event_id % 5 AS INTEGER) + 1] AS alert_type,
      ['Critical', 'High', 'High', 'Medium', 'Medium', 'Low', 'Low'][CAST(event_id % 7 AS INTEGER) + 1] AS severity,
      '203.0.113.' || (user_id % 20) AS source_ip,
      CASE WHEN event_id % 11 <> 0 THEN '192.168.1.' || (user_id % 7) END AS destination_ip,
      'sample alert ' || event_id AS description, k % 3 = 0 AS resolved,
      CASE WHEN k % 3 = 0 THEN raw_us + k * 1800000000::BIGINT END AS resolved_us,
      CASE WHEN k % 3 = 0 THEN 'analyst' || (user_id % 3) END AS resolved_by
    FROM ev WHERE event_type = 'error')""",
    "flows": """
  can AS (
    SELECT *, src_ip < dst_ip OR (src_ip = dst_ip AND coalesce(src_port, -1) <= coalesce(dst_port, -1)) AS fwd,
      (CASE WHEN contains(coalesce(tcp_flags, ''), 'SYN') THEN 1 ELSE 0 END)
      + (CASE WHEN contains(coalesce(tcp_flags, ''), 'ACK') THEN 2 ELSE 0 END)
      + (CASE WHEN contains(coalesce(tcp_flags, ''), 'FIN') THEN 4 ELSE 0 END)
      + (CASE WHEN contains(coalesce(tcp_flags, ''), 'RST') THEN 8 ELSE 0 END) AS bits FROM pf),
  keyed AS (
    SELECT *, CASE WHEN fwd THEN src_ip ELSE dst_ip END AS ip_a, CASE WHEN fwd THEN dst_ip ELSE src_ip END AS ip_b,
      coalesce(CASE WHEN fwd THEN src_port ELSE dst_port END, -1) AS port_a,
      coalesce(CASE WHEN fwd THEN dst_port ELSE src_port END, -1) AS port_b FROM can),
  gaps AS (
    SELECT *, CASE WHEN us - lag(us) OVER w <= 300000000 THEN 0 ELSE 1 END AS starts FROM keyed
    WINDOW w AS (PARTITION BY ip_a, port_a, ip_b, port_b, protocol ORDER BY us, id)),
  numbered AS (
    SELECT *, sum(starts) OVER (PARTITION BY ip_a, port_a, ip_b, port_b, protocol ORDER BY us, id
      ROWS UNBOUNDED PRECEDING) AS sid FROM gaps),
  sess AS (
    SELECT ip_a, port_a, ip_b, port_b, protocol, sid, min(us) AS first_us, max(us) AS last_us,
      count(*) AS packet_count, first(fwd ORDER BY us, id) AS ffwd,
      CAST(coalesce(sum(size) FILTER (fwd), 0) AS BIGINT) AS bf,
      CAST(coalesce(sum(size) FILTER (NOT fwd), 0) AS BIGINT) AS br,
      list(bits ORDER BY us, id) AS bl FROM numbered GROUP BY ALL),
  folded AS (
    SELECT *, sid < max(sid) OVER (PARTITION BY ip_a, port_a, ip_b, port_b, protocol) AS closed,
      list_reduce(list_concat([CASE WHEN bl[1] & 1 = 0 THEN 0 WHEN bl[1] & 2 = 0 THEN 1 ELSE 2 END], bl[2:]),
      lambda s, x: CASE WHEN x & 1 > 0 AND x & 2 = 0 THEN 1 WHEN x & 1 > 0 THEN 2
        WHEN x & 2 > 0 AND s IN (1, 2) THEN 3 WHEN x & 4 > 0 THEN 4 WHEN x & 8 > 0 THEN 5 ELSE s END) AS st FROM sess),
  c AS (
    SELECT CASE WHEN ffwd THEN ip_a ELSE ip_b END AS src_ip, CASE WHEN ffwd THEN ip_b ELSE ip_a END AS dst_ip,
      nullif(CASE WHEN ffwd THEN port_a ELSE port_b END, -1) AS src_port,
      nullif(CASE WHEN ffwd THEN port_b ELSE port_a END, -1) AS dst_port, protocol,
      first_us AS first_seen_us, last_us AS last_seen_us, packet_count,
      CASE WHEN ffwd THEN bf ELSE br END AS bytes_sent, CASE WHEN ffwd THEN br ELSE bf END AS bytes_received,
      CASE WHEN protocol = 'TCP' THEN ['UNKNOWN', 'SYN_SENT', 'SYN_RECEIVED', 'ESTABLISHED', 'FIN_WAIT', 'RESET'][
        CAST(st AS INTEGER) + 1] ELSE 'ACTIVE' END AS state, (last_us - first_us) / 1e6 AS connection_duration, closed
    FROM folded)""",
    "scan": """
  syn AS (
    SELECT id, us, src_ip, dst_ip, dst_port, CAST(contains(tcp_flags, 'RST') AS BIGINT) AS failed FROM pf
    WHERE protocol = 'TCP' AND contains(tcp_flags, 'SYN')
      AND dst_port NOT IN (21, 22, 25, 53, 80, 110, 143, 443, 993, 995)),
  scan_gaps AS (
    SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY src_ip ORDER BY us, id) <= 300000000 THEN 0 ELSE 1 END AS starts
    FROM syn),
  scan_rows AS (
    SELECT *, sum(starts) OVER (PARTITION BY src_ip ORDER BY us, id ROWS UNBOUNDED PRECEDING) AS sid FROM scan_gaps),
  scan_marks AS (
    SELECT *, min(us) OVER (PARTITION BY src_ip, sid) AS session_us,
      CASE WHEN row_number() OVER (PARTITION BY src_ip, sid, dst_port ORDER BY us, id) = 1 THEN 1 ELSE 0 END AS np,
      CASE WHEN row_number() OVER (PARTITION BY src_ip, sid, dst_ip ORDER BY us, id) = 1 THEN 1 ELSE 0 END AS nt
    FROM scan_rows),
  scan_prog AS (
    SELECT id, us, src_ip, dst_ip, dst_port, session_us, CAST(sum(np) OVER w AS BIGINT) AS ports,
      CAST(sum(nt) OVER w AS BIGINT) AS targets, count(*) OVER w AS attempts,
      CAST(sum(failed) OVER w AS BIGINT) AS failures, (us - session_us) / 1e6 AS duration
    FROM scan_marks WINDOW w AS (PARTITION BY src_ip, sid ORDER BY us, id ROWS UNBOUNDED PRECEDING)),
  scan_rated AS (SELECT *, attempts / greatest(1.0, duration) AS rate FROM scan_prog),
  scan_cand AS (
    SELECT *, CASE WHEN rate > 10 OR targets > 5 OR ports > 100 THEN 'Critical'
      WHEN rate > 5 OR targets > 2 OR ports > 50 THEN 'High' WHEN ports > 20 OR targets > 1 THEN 'Medium'
      ELSE 'Low' END AS severity FROM scan_rated WHERE ports >= 3)""",
    "flood": """
  flood_marks AS (
    SELECT *, CASE WHEN row_number() OVER (PARTITION BY src_ip, dst_ip ORDER BY us, id) = 1 THEN 1 ELSE 0 END AS nt
    FROM pf),
  flood_prog AS (
    SELECT id, us, src_ip, dst_ip,
      count(*) OVER o - count(*) OVER (PARTITION BY src_ip ORDER BY us
        RANGE BETWEEN UNBOUNDED PRECEDING AND 60000001 PRECEDING) AS in_window,
      count(*) OVER o AS packets, CAST(sum(size) OVER o AS BIGINT) AS bytes,
      CAST(sum(nt) OVER o AS BIGINT) AS targets, min(us) OVER o AS first_us
    FROM flood_marks WINDOW o AS (PARTITION BY src_ip ORDER BY us, id ROWS UNBOUNDED PRECEDING)),
  flood_rated AS (
    SELECT *, in_window / 60.0::DOUBLE AS rate, (us - first_us) / 1e6 AS duration,
      bytes / greatest(1.0, (us - first_us) / 1e6) AS bytes_per_second FROM flood_prog),
  flood_all AS (
    SELECT *, CASE WHEN rate > 500 OR bytes_per_second > 10000000 THEN 'Critical'
      WHEN rate > 200 OR targets > 10 OR bytes_per_second > 1000000 THEN 'High'
      WHEN rate > 100 OR targets > 3 THEN 'Medium' ELSE 'Low' END AS severity FROM flood_rated)""",
    "payload": r"""
  texts AS (
    SELECT *, CASE WHEN dst_port IN (80, 8080) AND payload_size > 100 THEN 'GET /index.php?id=1'' OR 1=1-- HTTP/1.1'
      WHEN dst_port = 22 AND payload_size > 50 THEN 'SSH-2.0-OpenSSH_7.4 admin:password123'
      WHEN dst_port IN (21, 23, 25) THEN 'USER admin' || chr(10) || 'PASS password' || chr(10) || 'SYST' || chr(10)
      END AS body FROM pf)""",
}

# The four categories as one alternation each.
CATEGORY = {
    "sql_injection": ("High", r"(?i)(union\s+select|select\s+.*\s+from|insert\s+into|delete\s+from|drop\s+table"
                      r"|create\s+table|alter\s+table|\'\s*or\s+\d+\s*=\s*\d+|\'\s*or\s+\'.*\'=\'|exec\s*\("
                      r"|execute\s*\(|sp_executesql)"),
    "xss": ("Medium", r"(?i)(<script[^>]*>|</script>|javascript:|vbscript:|onload\s*=|onclick\s*=|onerror\s*="
            r"|onmouseover\s*=|alert\s*\(|confirm\s*\(|prompt\s*\(|<iframe[^>]*>|<object[^>]*>|<embed[^>]*>)"),
    "command_injection": ("High", r"(?i)(;\s*cat\s+|;\s*ls\s+|;\s*pwd|;\s*id\s*;|&&\s*cat\s+|&&\s*ls\s+|&&\s*pwd"
                          r"|&&\s*id|\|\s*cat\s+|\|\s*ls\s+|\|\s*pwd|\|\s*id|rm\s+-rf|chmod\s+777|wget\s+http"
                          r"|curl\s+http)"),
    "malware_communication": ("Critical", r"(?i)(bot\d+|infected|zombie|backdoor|c&c|command.*control|botnet|payload"
                              r"|shellcode|exploit|trojan|virus|malware|rootkit)"),
}


def found(column: str, category: str) -> str:
    pattern = CATEGORY[category][1].replace("'", "''")
    return f"regexp_matches({column}, '{pattern}')"


def greedy(name: str, source: str, key: str, wait: str) -> str:
    """CTE text: the rows of `source` (key expression, us, id) that pass `us <wait> last`."""
    return f"""
  {name}_c AS (SELECT {key} AS gk, us, min(id) AS id FROM {source} GROUP BY ALL),
  {name}_t AS (
    SELECT gk, min(us) AS us FROM {name}_c GROUP BY gk
    UNION ALL
    SELECT g.gk, min(n.us) FROM {name}_t g JOIN {name}_c n ON n.gk = g.gk AND n.us {wait} GROUP BY g.gk),
  {name} AS (SELECT t.gk, t.us, n.id FROM {name}_t t JOIN {name}_c n ON n.gk = t.gk AND n.us = t.us)"""


COOL = "> g.us + 300000000"
RULE_HITS = """
  rule_hits AS (
    SELECT id, us, src_ip, dst_ip, dst_port, 'sql probe' AS rule_name, 'High' AS severity, 0 AS rule_no,
      'classic injection' AS about, 'regex' AS pattern_type, 'or\\\\s+1=1' AS pattern, protocol, payload_size FROM texts
      WHERE protocol = 'TCP' AND dst_port IN (80, 8080) AND regexp_matches(body, '(?i)or\\s+1=1')
    UNION ALL SELECT id, us, src_ip, dst_ip, dst_port, 'ssh login', 'Medium', 1, 'plain password',
      'string', 'ADMIN:', protocol, payload_size FROM texts
      WHERE contains(lower(body), 'admin:')
    UNION ALL SELECT id, us, src_ip, dst_ip, dst_port, 'get bytes', 'Low', 2, 'request line',
      'bytes', '47 45 54', protocol, payload_size FROM texts
      WHERE protocol = 'TCP' AND contains(body, 'GET'))""".replace("\\\\", "\\")

SCAN_FIRED = greedy("scan_g", "scan_cand", "src_ip", COOL)
FLOOD_CAND = "\n  flood_cand AS (SELECT * FROM flood_all WHERE rate > 0.05)"
FLOOD_FIRED = greedy("flood_g", "flood_cand", "src_ip", COOL)
PAYLOAD_HITS = f"""
  payload_hits AS (SELECT * FROM texts WHERE payload_size >= 10 AND {found('body', 'sql_injection')})"""
PAYLOAD_FIRED = greedy("payload_g", "payload_hits", "src_ip", COOL)
RULE_FIRED = greedy("rule_g", "rule_hits", "rule_name || '|' || src_ip", COOL)

ALL_ALERTS = """
  raised AS (
    SELECT k.id AS packet_id, k.us, 1 AS detector, 'Port Scan' AS alert_type, k.severity, k.src_ip AS source_ip,
      k.dst_ip AS destination_ip, format('Port scan detected from {}. Scanned {} ports on {} target(s).',
        k.src_ip, k.ports, k.targets) AS description
    FROM scan_cand k JOIN scan_g g ON g.gk = k.src_ip AND g.us = k.us AND g.id = k.id
    UNION ALL SELECT k.id, k.us, 2, 'DDoS Attack', k.severity, k.src_ip, NULL,
      format('Potential DDoS attack detected from {}. Connection rate: {:.1f} connections/second.', k.src_ip, k.rate)
    FROM flood_cand k JOIN flood_g g ON g.gk = k.src_ip AND g.us = k.us AND g.id = k.id
    UNION ALL SELECT k.id, k.us, 3, 'Suspicious Payload', 'High', k.src_ip, k.dst_ip,
      'Suspicious sql injection pattern detected in traffic from ' || k.src_ip || '.'
    FROM payload_hits k JOIN payload_g g ON g.gk = k.src_ip AND g.us = k.us AND g.id = k.id
    UNION ALL SELECT k.id, k.us, 4, 'Custom Rule: ' || k.rule_name, k.severity, k.src_ip, k.dst_ip,
      'Custom rule ''' || k.rule_name || ''' triggered: ' || k.about
    FROM rule_hits k JOIN rule_g g ON g.gk = k.rule_name || '|' || k.src_ip AND g.us = k.us AND g.id = k.id),
  keyed_alerts AS (
    SELECT *, packet_id * 8 + detector AS id,
      alert_type || '|' || source_ip || '|' || coalesce(destination_ip, '-') AS ak FROM raised)"""
STORED = greedy("stored_g", "keyed_alerts", "ak", ">= g.us + 600000000")

PIPELINE = (CTE["scan"], SCAN_FIRED, CTE["flood"], FLOOD_CAND, FLOOD_FIRED, CTE["payload"], PAYLOAD_HITS,
            PAYLOAD_FIRED, RULE_HITS, RULE_FIRED, ALL_ALERTS, STORED)


def sql(body: str, *ctes: str) -> str:
    """A statement over the base tables and the named (or literal) CTEs."""
    texts = [CTE["base"]] + [CTE.get(x, x) for x in ctes]
    return "WITH RECURSIVE" + ",".join(texts) + "\n" + body


ALERT_HEAD = "k.id AS packet_id, k.us, {} AS alert_type, k.severity, k.src_ip AS source_ip, {} AS destination_ip, {} AS description"


def shown(marks: str, mark: str, value: str, most: int, *keys: str) -> str:
    """The first `most` distinct values that the alert k's group has met so far, sorted, as text."""
    same = " AND ".join(f"f.{x} = k.{x}" for x in keys)
    return (f"(SELECT array_to_string(list_sort(list(f.{value})), ',') FROM (SELECT *, row_number() OVER (PARTITION BY "
            f"{', '.join(keys)} ORDER BY us, id) AS place FROM {marks} WHERE {mark} = 1) f WHERE {same} AND f.place <= {most} "
            "AND (f.us < k.us OR (f.us = k.us AND f.id <= k.id)))")


SCAN_ALERTS = (
    "SELECT " + ALERT_HEAD.format("'Port Scan'", "k.dst_ip", """format('Port scan detected from {}. Scanned {} ports on {} target(s).',
    k.src_ip, k.ports, k.targets)""") + f""", {shown('scan_marks', 'np', 'dst_port', 20, 'src_ip', 'session_us')} AS scanned_ports,
  {shown('scan_marks', 'nt', 'dst_ip', 10, 'src_ip', 'session_us')} AS target_ips, k.attempts AS scan_count,
  k.failures AS failed_connections, round(k.duration, 6) AS scan_duration, round(k.rate, 6) AS scan_rate
FROM scan_cand k JOIN scan_g g ON g.gk = k.src_ip AND g.us = k.us AND g.id = k.id""")
FLOOD_ALERTS = (
    "SELECT " + ALERT_HEAD.format("'DDoS Attack'", "NULL::VARCHAR", """format(
    'Potential DDoS attack detected from {}. Connection rate: {:.1f} connections/second.', k.src_ip, k.rate)""") + f""",
  round(k.rate, 6) AS connection_rate, k.packets AS total_connections, k.bytes AS bytes_sent, k.targets AS target_count,
  {shown('flood_marks', 'nt', 'dst_ip', 10, 'src_ip')} AS target_ips, round(k.duration, 6) AS attack_duration
FROM flood_cand k JOIN flood_g g ON g.gk = k.src_ip AND g.us = k.us AND g.id = k.id""")
RULE_ALERTS = (
    "SELECT " + ALERT_HEAD.format("'Custom Rule: ' || k.rule_name", "k.dst_ip",
                                  "'Custom rule \'\'' || k.rule_name || '\'\' triggered: ' || k.about") + """,
  k.rule_name, k.about AS rule_description, k.pattern_type, k.pattern AS matched_pattern, CAST(k.dst_port AS BIGINT) AS target_port,
  k.protocol, CAST(k.payload_size AS BIGINT) AS payload_size
FROM rule_hits k JOIN rule_g g ON g.gk = k.rule_name || '|' || k.src_ip AND g.us = k.us AND g.id = k.id""")
PAYLOAD_ALERTS = r"""SELECT k.id AS packet_id, k.us, 'Suspicious Payload' AS alert_type, 'High' AS severity, k.src_ip AS source_ip,
  k.dst_ip AS destination_ip, 'Suspicious sql injection pattern detected in traffic from ' || k.src_ip || '.' AS description,
  'sql_injection' AS pattern_category, CAST(k.dst_port AS BIGINT) AS target_port, k.protocol,
  CAST(k.payload_size AS BIGINT) AS payload_size,
  '(?i)(\''\s*or\s+\d+\s*=\s*\d+|\''\s*or\s+\''.*\''=\'')' AS matched_pattern
FROM payload_hits k JOIN payload_g g ON g.gk = k.src_ip AND g.us = k.us AND g.id = k.id"""


PACKET = "id, us AS timestamp_us, src_ip, dst_ip, src_port, dst_port, protocol, size, tcp_flags, payload_size"
CONNECTION = ("src_ip, dst_ip, src_port, dst_port, protocol, first_seen_us, last_seen_us, packet_count, bytes_sent, "
              "bytes_received, state, round(connection_duration, 6) AS connection_duration")
ALERT = ("id, us AS timestamp_us, alert_type, severity, source_ip, destination_ip, description, resolved, "
         "resolved_us AS resolved_at_us, resolved_by")
RANK = "CASE severity WHEN 'Low' THEN 1 WHEN 'Medium' THEN 2 WHEN 'High' THEN 3 WHEN 'Critical' THEN 4 END"


def bucket(unit: str) -> str:
    return f"epoch_us(date_trunc('{unit}', make_timestamp(us)))"


def text_of(us: str) -> str:
    return (f"CASE WHEN {us} % 1000000 = 0 THEN strftime(make_timestamp({us}), '%Y-%m-%d %H:%M:%S') "
            f"ELSE strftime(make_timestamp({us}), '%Y-%m-%d %H:%M:%S.%f') END")


def none(c: str) -> str:
    return f"coalesce(CAST({c} AS VARCHAR), 'None')"


FLAGS = "coalesce(nullif(concat_ws('|', " + ", ".join(
    f"CASE WHEN (id % 256) & {bit} <> 0 THEN '{name}' END" for bit, name in (
        (1, "FIN"), (2, "SYN"), (4, "RST"), (8, "PSH"), (16, "ACK"), (32, "URG"), (64, "ECE"), (128, "CWR"))
) + "), ''), 'NONE')"


def protocol_of(n: str) -> str:
    return (f"CASE {n} WHEN 1 THEN 'ICMP' WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' WHEN 47 THEN 'GRE' "
            f"WHEN 50 THEN 'ESP' WHEN 51 THEN 'AH' ELSE 'PROTO_' || ({n}) END")


def packet_id(protocol: str = "protocol") -> str:
    return (f"substr(md5({text_of('us')} || src_ip || dst_ip || {none('src_port')} || {none('dst_port')} || "
            f"{protocol}), 1, 16)")


def severity_columns() -> str:
    return ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in ("Low", "Medium", "High", "Critical"))


def half_up(n: str, unit: int, digits: int) -> str:
    """n / unit with fixed decimals; printf rounds a true half to the even digit, here it goes up."""
    tie = f"CASE WHEN {n} * {10 ** digits} % {unit} * 2 = {unit} THEN {0.1 ** (digits + 1):.4f} ELSE 0 END"
    return f"printf('%.{digits}f', {n} / {float(unit)}::DOUBLE + {tie})"


def human(b: str, digits: int, units: tuple[str, ...]) -> str:
    cases = "".join(f" WHEN {b} >= {1024 ** i} THEN regexp_replace({half_up(b, 1024 ** i, digits)}, '\\.?0+$', '') "
                    f"|| ' {units[i]}'" for i in range(len(units) - 1, 0, -1))
    return f"CASE{cases} ELSE {b} || ' B' END"


def short(n: str) -> str:
    return (f"CASE WHEN {n} >= 1000000 THEN {half_up(n, 1000000, 1)} || 'M' "
            f"WHEN {n} >= 1000 THEN {half_up(n, 1000, 1)} || 'K' ELSE CAST({n} AS VARCHAR) END")


TOTALS = ("count(*) AS total_packets, CAST(coalesce(sum(size), 0) AS BIGINT) AS total_bytes, "
          "count(DISTINCT src_ip) AS unique_sources, count(DISTINCT dst_ip) AS unique_destinations")
LAST_WEEK = f"us >= {AS_OF} - {168 * HOUR}"
IN_MONTH = f"us BETWEEN {START} AND {AS_OF}"
DIRECTED = """
SELECT src_ip, dst_ip, src_port, dst_port, protocol, min(us) AS first_seen_us, max(us) AS last_seen_us,
  count(*) AS packet_count, CAST(sum(size) AS BIGINT) AS bytes_sent, 0::BIGINT AS bytes_received,
  round(sum(size) / count(*), 6) AS avg_packet_size, round((max(us) - min(us)) / 1e6, 6) AS connection_duration
FROM pf GROUP BY ALL"""
RISK = ("least(100.0, {t} / greatest({n}, 1) * 1000 * 10 + (({c}) * 10 + ({h}) * 5 + ({m}) * 2) / greatest({t}, 1) * 20)")
PORT_SPELLS = """
  port_gaps AS (
    SELECT id, us, src_ip, coalesce(dst_port, 0) AS port, CASE WHEN us - lag(us) OVER (
      PARTITION BY src_ip, coalesce(dst_port, 0) ORDER BY us, id) <= 60000000 THEN 0 ELSE 1 END AS starts FROM pf),
  recent AS (
    SELECT x.id, count(y.id) AS n, CAST(coalesce(sum(y.size), 0) AS BIGINT) AS b,
      count(DISTINCT coalesce(y.dst_port, 0)) FILTER (y.id IS NOT NULL) AS ports
    FROM pf x LEFT JOIN pf y ON y.src_ip = x.src_ip AND y.us >= x.us - 60000000
      AND (y.us < x.us OR (y.us = x.us AND y.id < x.id)) GROUP BY x.id),
  feat AS (
    SELECT f.id, f.us, f.src_ip, f.dst_ip, f.size AS packet_size, f.protocol, coalesce(f.src_port, 0) AS src_port,
      coalesce(f.dst_port, 0) AS dst_port, coalesce(f.tcp_flags, '') AS tcp_flags, f.payload_size,
      CAST(hour(make_timestamp(f.us)) AS INTEGER) AS hour_of_day, isodow(make_timestamp(f.us)) >= 6 AS is_weekend,
      CASE WHEN row_number() OVER (PARTITION BY f.src_ip ORDER BY f.us, f.id) > 2 THEN r.n / 60.0::DOUBLE ELSE 0.0 END
        AS packets_per_second,
      CASE WHEN row_number() OVER (PARTITION BY f.src_ip ORDER BY f.us, f.id) > 2 THEN r.b / 60.0::DOUBLE ELSE 0.0 END
        AS bytes_per_second,
      CASE WHEN row_number() OVER (PARTITION BY f.src_ip ORDER BY f.us, f.id) > 2 THEN r.ports ELSE 0 END
        AS unique_ports_accessed
    FROM pf f JOIN recent r ON r.id = f.id)"""
#: The numbers of a feature vector, in order.
VECTOR = [*("packet_size payload_size src_port dst_port hour_of_day is_weekend packets_per_second bytes_per_second "
            "unique_ports_accessed").split(), *[f"(protocol = '{x}')" for x in ("TCP", "UDP", "ICMP")],
          *[f"contains(tcp_flags, '{x}')" for x in ("SYN", "ACK", "FIN", "RST")]]


def forest(trees: int = 100, sample: int = 256, seed: int = 42, contamination: float = 0.1) -> str:
    """An isolation forest grown level by level and walked, down to `scored`: features with their score.

    Every choice is the digest of what it is made for, so the trees are the ones the engine grows."""
    depth = (sample - 1).bit_length()

    def chance(what, *names):
        text = " || ':' || ".join([str(seed), *names, f"'{what}'"])
        return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"

    path = ("CASE WHEN n > 2 THEN 2.0 * (ln(n - 1.0::DOUBLE) + 0.5772156649015329::DOUBLE) - 2.0 * (n - 1.0::DOUBLE) / n "
            "WHEN n = 2 THEN 1.0 ELSE 0.0 END")
    digits = "format('{{:.12g}}', {})::DOUBLE"
    each = range(1, len(VECTOR) + 1)
    parts = [
        "vec AS (SELECT id, [" + ", ".join(f"CAST(CAST({x} AS FLOAT) AS DOUBLE)" for x in VECTOR) + "] AS v FROM feat)",
        "scaling AS (SELECT count(*) AS total, [" + ", ".join(digits.format(f"avg(v[{i}])") for i in each) + "] AS m, ["
        + ", ".join(f"CASE WHEN {digits.format(f'stddev_pop(v[{i}])')} = 0 THEN 1.0 ELSE {digits.format(f'stddev_pop(v[{i}])')} END"
                    for i in each) + "] AS s FROM vec)",
        "scaled AS MATERIALIZED (SELECT id, [" + ", ".join(f"(v[{i}] - m[{i}]) / s[{i}]" for i in each) + "] AS x FROM vec, scaling)",
        f"pool AS (SELECT * FROM scaled ORDER BY substr(md5('{seed}:' || id), 1, 8), id LIMIT {trees * sample})",
        f"trees AS (SELECT unnest(range(0, {trees})) AS tree)",
        "g0 AS (SELECT tree, 1::BIGINT AS node, id, x FROM (SELECT tree, id, x, row_number() OVER (PARTITION BY tree ORDER BY "
        f"substr(md5('{seed}:' || tree || ':' || id), 1, 8), id) AS place FROM pool, trees) WHERE place <= {sample})",
    ]
    for k in range(depth + 1):
        parts += [
            f"h{k} AS (SELECT *, count(*) OVER w AS n, [" + ", ".join(f"min(x[{i}]) OVER w" for i in each) + "] AS lo, ["
            + ", ".join(f"max(x[{i}]) OVER w" for i in each) + f"] AS hi FROM g{k} WINDOW w AS (PARTITION BY tree, node))",
            f"i{k} AS (SELECT *, list_filter({list(each)}, lambda i: hi[i] > lo[i]) AS usable FROM h{k})",
            f"j{k} AS (SELECT *, CASE WHEN {k} < (SELECT ceil(log2(greatest(least({sample}, total), 2))) FROM scaling) AND n > 1 "
            f"AND len(usable) > 0 THEN usable[1 + floor({chance('feature', 'tree', 'node')} * len(usable))::INT] END AS f FROM i{k})",
            f"s{k} AS MATERIALIZED (SELECT *, lo[f] + {chance('threshold', 'tree', 'node')} * (hi[f] - lo[f]) AS cut FROM j{k})",
            f"g{k + 1} AS (SELECT tree, CASE WHEN x[f] <= cut THEN 2 * node ELSE 2 * node + 1 END AS node, id, x "
            f"FROM s{k} WHERE f IS NOT NULL)"]
    parts.append("nodes AS MATERIALIZED (" + " UNION ALL ".join(
        f"SELECT DISTINCT tree, node, f, cut, {k} + {path} AS path FROM s{k}" for k in range(depth + 1)) + ")")
    parts.append("w0 AS (SELECT id, x, tree, 1::BIGINT AS node FROM scaled, trees)")
    for k in range(depth):
        parts.append(f"w{k + 1} AS (SELECT id, x, tree, CASE WHEN n.f IS NULL THEN node WHEN x[n.f] <= n.cut THEN 2 * node "
                     f"ELSE 2 * node + 1 END AS node FROM w{k} JOIN nodes n USING (tree, node))")
    parts += [
        f"raw AS MATERIALIZED (SELECT id, round(-pow(2.0, -sum(path) / {trees} / (SELECT {path} FROM (SELECT least({sample}, total) AS n "
        f"FROM scaling))), 12) AS score FROM w{depth} JOIN nodes USING (tree, node) GROUP BY id)",
        "ranked AS (SELECT score, row_number() OVER (ORDER BY score) - 1 AS place FROM raw)",
        f"spot AS (SELECT {contamination}::DOUBLE * (total - 1) AS pos FROM scaling)",
        "ends AS (SELECT any_value(pos) AS pos, min(score) AS a, max(score) AS b FROM ranked, spot WHERE place IN (floor(pos), ceil(pos)))",
        "scored AS MATERIALIZED (SELECT feat.*, raw.score - (SELECT a + (b - a) * (pos - floor(pos)) FROM ends) AS score "
        "FROM feat JOIN raw USING (id))"]
    return ",\n  ".join(["", *parts])[1:]


FOREST = forest()
# the scores that queries of the anomaly family are given, in place of a model's
MARKED = "\n  marked AS (SELECT *, -((id * 37) % 100)::DOUBLE / 100 AS score FROM feat)"
MARKED_SEVERITY = ("CASE WHEN score < -0.8 THEN 'Critical' WHEN score < -0.6 THEN 'High' "
                   "WHEN score < -0.4 THEN 'Medium' ELSE 'Low' END")
BASELINES = """
  bp AS (SELECT protocol, count(*) / (SELECT count(*) FROM p) AS f FROM p GROUP BY ALL),
  bd AS (SELECT dst_port, count(*) / (SELECT count(*) FROM p) AS f FROM p WHERE dst_port > 0 GROUP BY ALL
    ORDER BY f DESC, dst_port LIMIT 20),
  bh AS (SELECT CAST(hour(make_timestamp(us)) AS INTEGER) AS hour, count(*) / (SELECT count(*) FROM p) AS f
    FROM p GROUP BY ALL)"""

ORACLES: dict[str, str] = {
    # searches
    "packets_scan": sql(f"SELECT {PACKET} FROM p"),
    "alerts_scan": sql(f"SELECT {ALERT} FROM a"),
    "connections_scan": sql(f"SELECT {CONNECTION} FROM c", "flows"),
    "packet_search": sql(f"SELECT {PACKET} FROM p WHERE protocol = 'TCP' AND size BETWEEN 200 AND 1200 "
                         "ORDER BY us DESC, id DESC LIMIT 100"),
    "packet_search_ports": sql(f"SELECT {PACKET} FROM p WHERE src_ip = '203.0.113.3' AND dst_port = 8080 "
                               f"AND us BETWEEN {RANGE}"),
    "recent_packets": sql(f"SELECT {PACKET} FROM p WHERE us >= {AS_OF} - {48 * HOUR} "
                          "ORDER BY us DESC, id DESC LIMIT 100"),
    "connection_search": sql(f"SELECT {CONNECTION} FROM c WHERE c.connection_duration >= 10 "
                             "ORDER BY last_seen_us DESC LIMIT 100", "flows"),
    "connection_analysis": sql("""SELECT count(*) AS total_connections,
  CAST(coalesce(sum(bytes_sent + bytes_received), 0) AS BIGINT) AS total_bytes_transferred,
  round(coalesce(avg(connection_duration), 0), 6) AS average_duration_seconds,
  (SELECT coalesce(string_agg(protocol || '=' || n, ',' ORDER BY protocol), '') FROM (
     SELECT protocol, count(*) AS n FROM hits GROUP BY protocol)) AS protocol_distribution FROM hits""", "flows", """
  hits AS (SELECT * FROM c WHERE state = 'SYN_SENT' ORDER BY last_seen_us DESC LIMIT 200)"""),
    "alert_search": sql(f"SELECT {ALERT} FROM a WHERE severity = 'High' AND NOT resolved "
                        "ORDER BY us DESC, id DESC LIMIT 100"),
    "alert_view": sql(f"SELECT {ALERT} FROM a WHERE contains(lower(alert_type), 'scan') "
                      f"OR contains(lower(description), 'scan') OR contains(source_ip, 'SCAN') "
                      f"ORDER BY {RANK} DESC, id DESC LIMIT 50"),
    "resolved_alerts_large": sql(f"SELECT {ALERT} FROM (SELECT * REPLACE (CASE WHEN id % 10 <> 0 THEN resolved_us END "
                                 "AS resolved_us) FROM a) WHERE resolved ORDER BY resolved_us DESC NULLS LAST, id DESC LIMIT 1500"),
    "alert_view_all": sql(" UNION ALL ".join(
        f"SELECT '{name}' AS sort, {down} AS descending, id, row_number() OVER (ORDER BY {key} {way}, id {way}) AS n FROM a"
        for name, key in (("severity", RANK), ("alert_type", "alert_type"), ("source_ip", "source_ip"), ("timestamp", "us"))
        for down, way in ((True, "DESC"), (False, "ASC")))),
    "raw_export_packets": sql(f"SELECT {PACKET} FROM p WHERE us >= {AS_OF} - {120 * HOUR}"),
    "raw_export_connections": sql(f"""SELECT protocol, state, count(*) AS n, CAST(sum(packet_count) AS BIGINT) AS packets
FROM c WHERE last_seen_us >= {FAST_AS_OF} - {5 * MINUTE} AND state = 'ACTIVE' GROUP BY 1, 2""", "flows"),
    "alerts_by_source": sql(f"SELECT {ALERT} FROM a WHERE source_ip = '203.0.113.3' AND us >= {AS_OF} - {240 * HOUR}"),
    "alert_listing": sql(f"SELECT {ALERT} FROM a WHERE severity = 'Critical' AND resolved "
                         f"AND us >= {AS_OF} - {480 * HOUR} ORDER BY us DESC, id DESC LIMIT 50"),
    "recent_alerts": sql(f"SELECT {ALERT} FROM a WHERE severity = 'Medium' ORDER BY us DESC, id DESC LIMIT 50"),
    "unresolved_alerts": sql(f"SELECT {ALERT} FROM a WHERE NOT resolved"),
    "resolved_alerts": sql(f"SELECT {ALERT} FROM a WHERE resolved ORDER BY resolved_us DESC, id DESC LIMIT 50"),
    "active_connections": sql(f"SELECT {CONNECTION} FROM c WHERE last_seen_us >= {FAST_AS_OF} - {60 * MINUTE} "
                              "AND state = 'ACTIVE' ORDER BY last_seen_us DESC LIMIT 100", "flows"),
    "forensic_all": sql(f"""SELECT * FROM (
  SELECT 'packet' AS data_type, * FROM (SELECT {PACKET} FROM pf WHERE src_ip = '203.0.113.3'
    ORDER BY us DESC, id DESC LIMIT 1000)
  UNION ALL BY NAME SELECT 'connection' AS data_type, * FROM (SELECT {CONNECTION} FROM c WHERE src_ip = '203.0.113.3'
    ORDER BY last_seen_us DESC LIMIT 1000)
  UNION ALL BY NAME SELECT 'alert' AS data_type, * FROM (SELECT {ALERT} FROM a WHERE source_ip = '203.0.113.3'
    ORDER BY us DESC, id DESC LIMIT 1000))""", "flows"),
    "forensic_counts": sql("""SELECT * FROM n UNION ALL SELECT CAST(sum(matches) AS BIGINT), 'total' FROM n""",
                           "flows", """
  n AS (SELECT least(1000, count(*)) AS matches, 'packet' AS data_type FROM pf WHERE src_ip = '203.0.113.3'
    UNION ALL SELECT least(1000, count(*)), 'connection' FROM c WHERE src_ip = '203.0.113.3'
    UNION ALL SELECT least(1000, count(*)), 'alert' FROM a WHERE source_ip = '203.0.113.3')"""),
    "capture_filter": sql(f"SELECT {PACKET} FROM p WHERE protocol IN ('TCP', 'UDP') AND src_ip <> '203.0.113.7' "
                          "AND dst_ip <> '203.0.113.7' AND src_port <> 443 AND dst_port <> 443"),
    "raw_export": sql(f"SELECT {ALERT} FROM a WHERE us >= {AS_OF} - {120 * HOUR} "
                      "ORDER BY us DESC, id DESC LIMIT 10000"),
    # decoding and scalars
    "decode_flags": sql(f"SELECT id AS event_id, {FLAGS} AS flags FROM p"),
    "decode_protocol": sql(f"SELECT id AS event_id, {protocol_of('id % 60')} AS protocol FROM p"),
    "decode_packets": sql(f"SELECT id, us AS timestamp_us, src_ip, dst_ip, src_port, dst_port, protocol, size, "
                          f"tcp_flags, payload_size, ttl, {packet_id()} AS packet_id FROM d", f"""
  d AS (
    SELECT id, us, src_ip, dst_ip, size, CAST(id % 64 AS INTEGER) AS ttl,
      CASE WHEN id % 37 = 0 THEN 'GRE' ELSE protocol END AS protocol,
      CAST(CASE WHEN id % 37 = 0 AND protocol <> 'ICMP' THEN 0 WHEN id % 37 = 0 THEN 0
        WHEN protocol = 'ICMP' THEN 8 ELSE src_port END AS INTEGER) AS src_port,
      CAST(CASE WHEN id % 37 = 0 OR protocol = 'ICMP' THEN 0 ELSE dst_port END AS INTEGER) AS dst_port,
      CASE WHEN id % 37 <> 0 AND protocol = 'TCP' THEN {FLAGS} ELSE '' END AS tcp_flags,
      CASE WHEN id % 37 = 0 THEN 0 ELSE payload_size END AS payload_size
    FROM pf WHERE id % 41 <> 0)"""),
    "packet_ids": sql(f"SELECT id, {packet_id()} AS packet_id FROM p"),
    "flow_keys": sql(f"""SELECT id,
  src_ip || ':' || {none('src_port')} || '->' || dst_ip || ':' || {none('dst_port')} || ':' || protocol AS flow_key,
  dst_ip || ':' || {none('dst_port')} || '->' || src_ip || ':' || {none('src_port')} || ':' || protocol AS reverse_key
FROM p"""),
    "datetime_parse": """WITH t AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
  WHEN 1 THEN strftime(ts, '%Y-%m-%d %H:%M') WHEN 2 THEN strftime(ts, '%Y-%m-%d')
  WHEN 3 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') WHEN 4 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ')
  ELSE 'around noon' END AS s FROM events)
SELECT event_id, epoch_us(CAST(try_strptime(s, ['%Y-%m-%d %H:%M:%S', '%Y-%m-%d %H:%M', '%Y-%m-%d', '%Y-%m-%dT%H:%M:%S',
  '%Y-%m-%dT%H:%M:%SZ']) AS TIMESTAMP)) AS parsed_us FROM t""",
    "alert_ranks": sql(f"SELECT id, {RANK} AS rank, replace(lower(alert_type), '_', ' ') AS label FROM a"),
    "byte_texts": sql(f"""SELECT src_ip, {human('b', 2, ('B', 'KB', 'MB', 'GB', 'TB'))} AS bytes_text,
  {short('n')} AS packets_text, CAST(floor(b / 1024 + 0.5) AS BIGINT) AS kb
FROM (SELECT src_ip, CAST(sum(size) AS BIGINT) AS b, count(*) AS n FROM p GROUP BY src_ip)"""),
    # traffic
    "traffic_totals": sql(f"SELECT {TOTALS} FROM p WHERE us BETWEEN {RANGE}"),
    "traffic_stats_totals": sql(f"SELECT *, round(total_packets / 168.0::DOUBLE, 6) AS packets_per_hour, "
                                f"round(total_bytes / 168.0::DOUBLE, 6) AS bytes_per_hour FROM "
                                f"(SELECT {TOTALS} FROM p WHERE {LAST_WEEK})"),
    "traffic_stats_protocols": sql(f"SELECT protocol, count(*) AS packet_count FROM p WHERE {LAST_WEEK} GROUP BY ALL"),
    "traffic_stats_top_sources": sql(f"""SELECT src_ip, count(*) AS packet_count, CAST(sum(size) AS BIGINT) AS total_bytes
FROM p WHERE {LAST_WEEK} GROUP BY ALL ORDER BY packet_count DESC, src_ip LIMIT 10"""),
    "system_rollup": sql(f"""SELECT d.*, h.*, u.*, k.* FROM
  (SELECT count(*) AS packets_24h, CAST(sum(size) AS BIGINT) AS bytes_24h, count(DISTINCT src_ip) AS unique_sources_24h
   FROM pf WHERE us >= {FAST_AS_OF} - {DAY}) d,
  (SELECT count(*) AS packets_1h, CAST(sum(size) AS BIGINT) AS bytes_1h, count(DISTINCT src_ip) AS unique_sources_1h
   FROM pf WHERE us >= {FAST_AS_OF} - {HOUR}) h,
  (SELECT count(*) AS unresolved_count, count(*) FILTER (severity = 'Critical') AS critical_unresolved
   FROM a WHERE NOT resolved) u,
  (SELECT count(*) FILTER (last_seen_us >= {FAST_AS_OF} - {5 * MINUTE} AND state = 'ACTIVE') AS active_count FROM c) k""",
                         "flows"),
    "top_ports": sql("""SELECT port, count(*) AS uses FROM (SELECT src_port AS port FROM pf UNION ALL SELECT dst_port FROM pf)
WHERE port > 0 GROUP BY port ORDER BY uses DESC, port LIMIT 20"""),
    "analyzer_statistics": sql(f"""SELECT count(*) AS packets_analyzed, CAST(sum(size) AS BIGINT) AS total_bytes,
  count(DISTINCT protocol) AS unique_protocols,
  (SELECT count(DISTINCT x) FROM (SELECT src_port AS x FROM pf UNION ALL SELECT dst_port FROM pf) WHERE x > 0) AS unique_ports,
  (SELECT count(*) FROM c WHERE {FAST_AS_OF} - last_seen_us BETWEEN 0 AND {5 * MINUTE}) AS active_connections FROM pf""",
                               "flows"),
    "talker_share": sql(f"""SELECT src_ip, packet_count, total_bytes,
  round(total_bytes / max(total_bytes) OVER () * 100, 6) AS share,
  {human('total_bytes', 1, ('B', 'KB', 'MB', 'GB'))} AS bytes_text
FROM (SELECT src_ip, count(*) AS packet_count, CAST(sum(size) AS BIGINT) AS total_bytes FROM p GROUP BY ALL
  ORDER BY packet_count DESC, src_ip LIMIT 10)"""),
    "talkers": sql(f"""SELECT src_ip, packet_count, total_bytes,
  round(total_bytes / max(total_bytes) OVER () * 100, 6) AS share,
  {human('total_bytes', 1, ('B', 'KB', 'MB', 'GB'))} AS bytes_text
FROM (SELECT src_ip, count(*) AS packet_count, CAST(sum(size) AS BIGINT) AS total_bytes FROM p WHERE us >= {AS_OF} - {240 * HOUR} GROUP BY ALL
  ORDER BY packet_count DESC, src_ip LIMIT 10)"""),
    "stat_cards": sql(f"""SELECT *, {short('total_packets')} AS packets_text,
  {human('total_bytes', 2, ('B', 'KB', 'MB', 'GB', 'TB'))} AS bytes_text,
  {short('active_connections')} AS connections_text, {short('open_alerts')} AS alerts_text FROM
  (SELECT count(*) AS total_packets, CAST(coalesce(sum(size), 0) AS BIGINT) AS total_bytes FROM p
   WHERE us >= {AS_OF} - {DAY}),
  (SELECT count(*) FILTER (last_seen_us >= {AS_OF} - {5 * MINUTE} AND state = 'ACTIVE') AS active_connections FROM c),
  (SELECT count(*) FILTER (NOT resolved) AS open_alerts FROM a)""", "flows"),
    "chart_points": sql(f"""SELECT {bucket('hour')} AS bucket_us, count(*) AS packets,
  CAST(floor(CAST(sum(size) AS BIGINT) / 1024 + 0.5) AS BIGINT) AS kilobytes FROM p GROUP BY 1 ORDER BY 1 DESC LIMIT 50"""),
    # alerts and reports
    "alert_grouping_sets": sql(f"""SELECT CASE grouping(alert_type, severity) WHEN 0 THEN alert_type || '_' || severity
  WHEN 1 THEN alert_type WHEN 2 THEN severity ELSE 'total' END AS metric, count(*) AS alert_count
FROM a WHERE {IN_MONTH} GROUP BY GROUPING SETS ((alert_type, severity), (alert_type), (severity), ())"""),
    "alert_statistics": sql(f"""SELECT 'total' AS section, 'all' AS item, count(*) AS n FROM w
UNION ALL SELECT 'severity_distribution', s, (SELECT count(*) FROM w WHERE severity = s)
  FROM unnest(['Low', 'Medium', 'High', 'Critical']) AS u(s)
UNION ALL SELECT 'type_distribution', alert_type, count(*) FROM w GROUP BY alert_type
UNION ALL SELECT * FROM (SELECT 'top_source_ips', source_ip, count(*) AS n FROM w GROUP BY source_ip
  ORDER BY n DESC, source_ip LIMIT 10)""", f"\n  w AS (SELECT * FROM a WHERE {LAST_WEEK})"),
    "distinct_alert_types": sql("SELECT DISTINCT alert_type FROM a"),
    "top_threats": sql("""SELECT alert_type, severity, source_ip, count(*) AS alert_count FROM a GROUP BY ALL
ORDER BY alert_count DESC, alert_type, severity, source_ip LIMIT 10"""),
    "trend_analysis": sql(f"""SELECT 'traffic_trends' AS section, b AS at_us, unnest(['packet_count', 'total_bytes']) AS item,
  unnest([k::DOUBLE, bytes::DOUBLE]) AS value FROM days
UNION ALL SELECT 'protocol_trends', b, protocol, count(*) FROM span GROUP BY 2, 3
UNION ALL SELECT 'alert_trends', b, unnest(['Low', 'Medium', 'High', 'Critical']), unnest([count(*) FILTER (severity = 'Low'),
  count(*) FILTER (severity = 'Medium'), count(*) FILTER (severity = 'High'), count(*) FILTER (severity = 'Critical')]::DOUBLE[])
  FROM alarms GROUP BY b
UNION ALL SELECT 'threat_evolution', b, alert_type, count(*) FROM alarms GROUP BY 2, 3
UNION ALL SELECT 'top_talkers_trends', {AS_OF} - {10 * DAY} + period * {10 * HOUR},
  unnest([rank || ' ' || src_ip || ' packet_count', rank || ' ' || src_ip || ' total_bytes']), unnest([k::DOUBLE, bytes::DOUBLE])
  FROM (SELECT *, row_number() OVER (PARTITION BY period ORDER BY k DESC, src_ip) AS rank FROM (
    SELECT (us - ({AS_OF} - {10 * DAY})) // {10 * HOUR} AS period, src_ip, count(*) AS k, sum(size) AS bytes FROM span GROUP BY 1, 2))
  WHERE rank <= 5
UNION ALL SELECT 'summary', 0, unnest(['average_packets_per_period', 'peak_traffic_packets', 'average_alerts_per_period', 'peak_alerts']),
  unnest([floor(tm), tx, round(am, 2), ax]::DOUBLE[]) FROM (SELECT avg(k) AS tm, max(k) AS tx FROM days),
  (SELECT avg(k) AS am, max(k) AS ax FROM (SELECT count(*) AS k FROM alarms GROUP BY b))""", f"""
  span AS (SELECT *, {bucket('day')} AS b FROM p WHERE us BETWEEN {AS_OF} - {10 * DAY} AND {AS_OF}),
  days AS (SELECT b, count(*) AS k, sum(size) AS bytes FROM span GROUP BY 1),
  alarms AS (SELECT *, {bucket('day')} AS b FROM a WHERE us BETWEEN {AS_OF} - {10 * DAY} AND {AS_OF})"""),
    "traffic_trend_hour": sql(f"SELECT {bucket('hour')} AS bucket_us, count(*) AS packet_count, "
                              "CAST(sum(size) AS BIGINT) AS total_bytes FROM p GROUP BY 1"),
    "traffic_trend_day": sql(f"SELECT {bucket('day')} AS bucket_us, count(*) AS packet_count, "
                             "CAST(sum(size) AS BIGINT) AS total_bytes FROM p GROUP BY 1"),
    "alert_trend_pivot": sql(f"SELECT {bucket('day')} AS bucket_us, {severity_columns()} FROM a GROUP BY 1"),
    "protocol_trend": sql(f"SELECT {bucket('day')} AS bucket_us, protocol, count(*) AS packet_count FROM p GROUP BY 1, 2"),
    "protocol_trend_maps": sql(f"""SELECT bucket_us, string_agg(protocol || '=' || n, ',' ORDER BY protocol) AS counts
FROM (SELECT {bucket('day')} AS bucket_us, protocol, count(*) AS n FROM p GROUP BY 1, 2) GROUP BY 1"""),
    "threat_evolution": sql(f"SELECT {bucket('day')} AS bucket_us, alert_type, count(*) AS threat_count "
                            "FROM a GROUP BY 1, 2"),
    "talkers_by_period": sql(f"""SELECT s + period * {7 * HOUR} AS period_start_us,
  least(s + (period + 1) * {7 * HOUR}, {AS_OF}) AS period_end_us, CAST(rank AS INTEGER) AS rank, src_ip, packet_count, total_bytes
FROM (SELECT *, row_number() OVER (PARTITION BY period ORDER BY packet_count DESC, src_ip) AS rank FROM (
  SELECT s, (us - s) // {7 * HOUR} AS period, src_ip, count(*) AS packet_count, CAST(sum(size) AS BIGINT) AS total_bytes
  FROM (SELECT *, {moment('2024-01-24 00:00:00')} AS s FROM p) WHERE us BETWEEN s AND {AS_OF} GROUP BY ALL))
WHERE rank <= 5"""),
    "trend_summary": sql(f"""SELECT CASE WHEN t_n > 0 AND a_n > 0 THEN 'ok' ELSE 'insufficient_data' END AS status,
  CAST(floor(t_avg) AS BIGINT) AS average_packets_per_period, t_max AS peak_traffic_packets,
  CASE WHEN t_max > t_avg * 2 THEN 'high' ELSE 'normal' END AS traffic_variance,
  round(a_avg, 2) AS average_alerts_per_period, a_max AS peak_alerts,
  CASE WHEN a_last > a_avg THEN 'increasing' ELSE 'stable' END AS alert_trend FROM
  (SELECT count(*) AS t_n, avg(n) AS t_avg, max(n) AS t_max FROM (SELECT count(*) AS n FROM p GROUP BY {bucket('day')})),
  (SELECT count(*) AS a_n, avg(n) AS a_avg, max(n) AS a_max, arg_max(n, b) AS a_last
   FROM (SELECT {bucket('day')} AS b, count(*) AS n FROM a GROUP BY 1))"""),
    "risk_score": sql(f"""SELECT source_ip, round({RISK.format(t='t', n='n', c='cr', h='hi', m='me')}, 6) AS risk FROM (
  SELECT source_ip, count(*) AS t, count(*) FILTER (severity = 'Critical') AS cr, count(*) FILTER (severity = 'High') AS hi,
    count(*) FILTER (severity = 'Medium') AS me FROM a GROUP BY 1) JOIN (
  SELECT src_ip, count(*) * 1000 AS n FROM p GROUP BY 1) ON src_ip = source_ip"""),
    "security_summary_flat": sql(f"""SELECT 'summary' AS category, 'total_packets' AS metric, CAST(count(*) AS VARCHAR) AS value,
  NULL::INTEGER AS index FROM p WHERE {IN_MONTH}
UNION ALL SELECT 'summary', 'total_bytes', CAST(sum(size) AS VARCHAR), NULL FROM p WHERE {IN_MONTH}
UNION ALL SELECT 'summary', 'unique_sources', CAST(count(DISTINCT src_ip) AS VARCHAR), NULL FROM p WHERE {IN_MONTH}
UNION ALL SELECT 'summary', 'unique_destinations', CAST(count(DISTINCT dst_ip) AS VARCHAR), NULL FROM p WHERE {IN_MONTH}
UNION ALL SELECT 'summary', 'anomaly_count', CAST(count(*) AS VARCHAR), NULL FROM am WHERE alert_type = 'Network Anomaly'
UNION ALL SELECT 'summary', 'time_period', '2024-01-01 00:00 to 2024-01-31 00:00', NULL
UNION ALL SELECT 'summary', 'risk_score', CAST(CAST(round({RISK.format(
        t='t', n="(SELECT count(*) FROM p WHERE " + IN_MONTH + ")", c='cr', h='hi', m='me')}, 2) AS DECIMAL(18,2)) AS VARCHAR), NULL
  FROM (SELECT count(*) AS t, count(*) FILTER (severity = 'Critical') AS cr, count(*) FILTER (severity = 'High') AS hi,
    count(*) FILTER (severity = 'Medium') AS me FROM am)
UNION ALL SELECT 'protocol_distribution', protocol, CAST(count(*) AS VARCHAR), NULL FROM p WHERE {IN_MONTH} GROUP BY protocol
UNION ALL SELECT 'alert_summary', CASE grouping(alert_type, severity) WHEN 0 THEN alert_type || '_' || severity
    WHEN 1 THEN alert_type WHEN 2 THEN severity ELSE 'total' END, CAST(count(*) AS VARCHAR), NULL
  FROM am GROUP BY GROUPING SETS ((alert_type, severity), (alert_type), (severity), ())
UNION ALL SELECT 'top_threats', m, CASE m WHEN 'threat_type' THEN alert_type WHEN 'severity' THEN severity
    WHEN 'source_ip' THEN source_ip ELSE CAST(n AS VARCHAR) END, i
  FROM (SELECT *, CAST(row_number() OVER (ORDER BY n DESC, alert_type, severity, source_ip) - 1 AS INTEGER) AS i FROM (
    SELECT alert_type, severity, source_ip, count(*) AS n FROM am GROUP BY ALL)) t,
    unnest(['threat_type', 'severity', 'source_ip', 'count']) AS u(m) WHERE i < 10
UNION ALL SELECT 'connection_summary', 'total_connections', CAST(count(*) AS VARCHAR), NULL FROM c
UNION ALL SELECT 'connection_summary', 'avg_duration_seconds',
  CAST(CAST(round(avg(connection_duration), 3) AS DECIMAL(18,3)) AS VARCHAR), NULL FROM c
UNION ALL SELECT 'connection_summary', 'total_bytes_transferred', CAST(sum(bytes_sent + bytes_received) AS VARCHAR), NULL FROM c""",
                                 "flows", f"\n  am AS (SELECT * FROM a WHERE {IN_MONTH})"),
    "security_audit": sql(f"""SELECT count(*) AS total_critical_high_alerts, count(*) FILTER (resolved) AS resolved_count,
  count(*) FILTER (NOT resolved) AS unresolved_count,
  round(count(*) FILTER (resolved) / count(*) * 100, 6) AS resolution_rate,
  round(avg(h), 6) AS average_response_hours_exact, round(min(h), 6) AS fastest_response_hours,
  round(max(h), 6) AS slowest_response_hours,
  CASE WHEN count(*) FILTER (NOT resolved) = 0 THEN 'compliant' ELSE 'non_compliant' END AS compliance_status
FROM (SELECT *, (resolved_us - us) / 1e6 / 3600.0::DOUBLE AS h FROM a
  WHERE severity IN ('Critical', 'High') AND {IN_MONTH})"""),
    "audit_recommendations": sql("""SELECT CAST(row_number() OVER (ORDER BY o) - 1 AS INTEGER) AS position, advice FROM (
  SELECT 1 AS o, 'Resolve ' || count(*) || ' outstanding critical/high severity alerts' AS advice FROM x WHERE NOT resolved
    HAVING count(*) > 0
  UNION ALL SELECT 2, 'Improve incident response time - current average exceeds 24 hours' FROM x WHERE resolved
    HAVING avg(resolved_us - us) / 3.6e9 > 24
  UNION ALL SELECT 3, 'Implement additional port scan protection measures' FROM x
    WHERE NOT resolved AND alert_type IN ('port_scan', 'Port Scan') HAVING count(*) > 0
  UNION ALL SELECT 4, 'Review DDoS mitigation strategies' FROM x
    WHERE NOT resolved AND alert_type IN ('ddos', 'DDoS Attack') HAVING count(*) > 0)""",
                                 "\n  x AS (SELECT * FROM a WHERE severity IN ('Critical', 'High'))"),
    "incident_breakdown": sql(f"""SELECT alert_type, CAST(sum(n) AS BIGINT) AS incident_count,
  string_agg(severity || '=' || n, ',' ORDER BY severity) AS severities
FROM (SELECT alert_type, severity, count(*) AS n FROM a WHERE {IN_MONTH} GROUP BY ALL) GROUP BY 1"""),
    "incident_summary": sql("""SELECT 'total' AS section, 'all' AS item, count(*) AS n FROM a
UNION ALL SELECT 'severity_distribution', s, (SELECT count(*) FROM a WHERE severity = s)
  FROM unnest(['Low', 'Medium', 'High', 'Critical']) AS u(s)
UNION ALL SELECT 'incident_breakdown', alert_type, count(*) FROM a GROUP BY alert_type
UNION ALL SELECT * FROM (SELECT 'top_incident_sources', source_ip, count(*) AS n FROM a GROUP BY source_ip
  ORDER BY n DESC, source_ip LIMIT 10)"""),
    "network_activity": sql(f"""SELECT *, 'healthy' AS network_health FROM
  (SELECT {TOTALS} FROM pf WHERE us BETWEEN {FAST_AS_OF} - {DAY} AND {FAST_AS_OF}),
  (SELECT count(*) AS total_connections, CAST(sum(bytes_sent + bytes_received) AS BIGINT) AS total_bandwidth_bytes,
     round(avg(connection_duration), 6) AS average_duration_exact FROM c
   WHERE first_seen_us BETWEEN {FAST_AS_OF} - {DAY} AND {FAST_AS_OF})""", "flows"),
    # flows
    "flow_sessions": sql(f"SELECT {CONNECTION} FROM c", "flows"),
    "tcp_states": sql("SELECT protocol, state, count(*) AS flows, CAST(sum(packet_count) AS BIGINT) AS packets "
                      "FROM c GROUP BY ALL", "flows"),
    "directed_connections": sql(DIRECTED),
    "merged_connections": sql(DIRECTED),
    "active_flows": sql(f"SELECT {CONNECTION} FROM c WHERE {FAST_AS_OF} - last_seen_us BETWEEN 0 AND {5 * MINUTE}", "flows"),
    "host_pair_summary": sql("""SELECT host_a, host_b, CAST(sum(packet_count) AS BIGINT) AS total_packets,
  CAST(sum(bytes_sent + bytes_received) AS BIGINT) AS total_bytes,
  array_to_string(list_sort(list(DISTINCT protocol)), ',') AS protocols,
  coalesce(array_to_string(list_transform(list_sort(list_distinct(list_filter(
    list_concat(list(src_port), list(dst_port)), lambda x: x > 0))), lambda x: CAST(x AS VARCHAR)), ','), '') AS ports,
  min(first_seen_us) AS first_seen_us, max(last_seen_us) AS last_seen_us,
  round((max(last_seen_us) - min(first_seen_us)) / 1e6, 6) AS duration
FROM (SELECT *, least(src_ip, dst_ip) AS host_a, greatest(src_ip, dst_ip) AS host_b FROM c) GROUP BY 1, 2""", "flows"),
    "flow_summary": sql("""SELECT host_a, host_b, CAST(sum(packet_count) AS BIGINT) AS total_packets,
  CAST(sum(bytes_sent + bytes_received) AS BIGINT) AS total_bytes,
  array_to_string(list_sort(list(DISTINCT protocol)), ',') AS protocols,
  coalesce(array_to_string(list_transform(list_sort(list_distinct(list_filter(
    list_concat(list(src_port), list(dst_port)), lambda x: x > 0))), lambda x: CAST(x AS VARCHAR)), ','), '') AS ports,
  min(first_seen_us) AS first_seen_us, max(last_seen_us) AS last_seen_us,
  round((max(last_seen_us) - min(first_seen_us)) / 1e6, 6) AS duration
FROM (SELECT *, least(src_ip, dst_ip) AS host_a, greatest(src_ip, dst_ip) AS host_b FROM c)
  WHERE host_a = '192.168.1.2' AND host_b = '203.0.113.3' GROUP BY 1, 2""", "flows"),
    "top_talkers_both_ends": sql("""SELECT ip, CAST(sum(packet_count) AS BIGINT) AS packets FROM (
  SELECT src_ip AS ip, packet_count FROM c UNION ALL SELECT dst_ip, packet_count FROM c)
GROUP BY ip ORDER BY packets DESC, ip LIMIT 10""", "flows"),
    # detectors
    "scan_sessions": sql("""SELECT *, CASE WHEN rate0 > 10 OR targets > 5 OR ports > 100 THEN 'Critical'
  WHEN rate0 > 5 OR targets > 2 OR ports > 50 THEN 'High' WHEN ports > 20 OR targets > 1 THEN 'Medium' ELSE 'Low' END AS severity
FROM (SELECT src_ip, min(us) AS session_us, count(DISTINCT dst_port) AS ports, count(DISTINCT dst_ip) AS targets,
  count(*) AS attempts, CAST(sum(failed) AS BIGINT) AS failed, min(us) AS first_us, max(us) AS last_us,
  round((max(us) - min(us)) / 1e6, 6) AS duration, count(*) / greatest(1.0, (max(us) - min(us)) / 1e6) AS rate0,
  round(count(*) / greatest(1.0, (max(us) - min(us)) / 1e6), 6) AS rate
FROM scan_rows GROUP BY src_ip, sid)""".replace("SELECT *, CASE", "SELECT * EXCLUDE (rate0), CASE", 1), "scan"),
    "scan_candidates": sql("SELECT * REPLACE (round(duration, 6) AS duration, round(rate, 6) AS rate) FROM scan_cand", "scan"),
    "scan_alerts": sql(SCAN_ALERTS, "scan", SCAN_FIRED),
    "flood_rate": sql("SELECT * REPLACE (round(duration, 6) AS duration, round(rate, 6) AS rate, "
                      "round(bytes_per_second, 6) AS bytes_per_second) FROM flood_all", "flood"),
    "flood_candidates": sql("SELECT id, us, src_ip, in_window, packets, bytes, targets, severity, round(rate, 6) AS rate "
                            "FROM flood_cand", "flood", FLOOD_CAND),
    "flood_alerts": sql(FLOOD_ALERTS, "flood", FLOOD_CAND, FLOOD_FIRED),
    "active_threats": sql(f"""SELECT 'scan' AS kind, src_ip AS source_ip, count(DISTINCT dst_port) AS ports,
  count(DISTINCT dst_ip) AS targets, count(*) AS packets, 0::BIGINT AS bytes, 0.0::DOUBLE AS rate,
  round((max(us) - min(us)) / 1e6, 6) AS duration
FROM scan_rows WHERE us <= {FAST_AS_OF} GROUP BY src_ip, sid HAVING {FAST_AS_OF} - max(us) <= {5 * MINUTE}
UNION ALL SELECT 'flood', src_ip, 0, count(DISTINCT dst_ip), count(*), CAST(sum(size) AS BIGINT),
  round(count(*) FILTER (us >= {FAST_AS_OF} - {MINUTE}) / 60.0::DOUBLE, 6), round(({FAST_AS_OF} - min(us)) / 1e6, 6)
FROM pf WHERE us <= {FAST_AS_OF} GROUP BY src_ip""", "scan"),
    "payload_matches": sql("SELECT id, us, src_ip, dst_ip, dst_port, protocol, payload_size, c AS categories, s AS severities, "
                           "len(string_split(c, ',')) AS patterns FROM (SELECT *, concat_ws(',', "
                           + ", ".join(f"CASE WHEN {found('body', n)} THEN '{n}' END" for n in CATEGORY) + ") AS c, concat_ws(',', "
                           + ", ".join(f"CASE WHEN {found('body', n)} THEN '{s}' END" for n, (s, _) in CATEGORY.items())
                           + ") AS s FROM texts WHERE payload_size >= 10) WHERE c <> ''", "payload"),
    "payload_alerts": sql(PAYLOAD_ALERTS, "payload", PAYLOAD_HITS, PAYLOAD_FIRED),
    "alert_log": sql(r"""SELECT 'ALERT: {"timestamp":"' || strftime(make_timestamp(k.us), '%Y-%m-%dT%H:%M:%S.%f')
  || '","type":"Suspicious Payload","severity":"High","source_ip":"' || k.src_ip || '","destination_ip":"' || k.dst_ip
  || '","description":"Suspicious sql injection pattern detected in traffic from ' || k.src_ip
  || '.","details":{"pattern_category":"sql_injection","target_port":' || k.dst_port || ',"protocol":"' || k.protocol
  || '","payload_size":' || k.payload_size
  || ',"matched_pattern":"(?i)(\\''\\s*or\\s+\\d+\\s*=\\s*\\d+|\\''\\s*or\\s+\\''.*\\''=\\'')"}}' AS value
FROM payload_hits k JOIN payload_g g ON g.gk = k.src_ip AND g.us = k.us AND g.id = k.id""", "payload", PAYLOAD_HITS, PAYLOAD_FIRED),
    "html_pattern_scan": " UNION ALL ".join(
        f"SELECT page_id, '{n}' AS category, '{s}' AS severity FROM pages WHERE {found('html', n)}"
        for n, (s, _) in CATEGORY.items()),
    "document_pattern_scan": " UNION ALL ".join(
        f"SELECT '{t}' AS searched, '{n}' AS category, count(*) FILTER ({found(column, n)}) AS found, "
        f"coalesce(CAST(sum({key}) FILTER ({found(column, n)}) AS BIGINT), 0) AS ids FROM {t}"
        for t, key, column in (("documents", "doc_id", "text"), ("pages", "page_id", "html")) for n in CATEGORY),
    "custom_rule_matches": sql("SELECT id, us, src_ip, dst_ip, dst_port, rule_name, severity FROM rule_hits",
                               "payload", RULE_HITS),
    "custom_rule_alerts": sql(RULE_ALERTS, "payload", RULE_HITS, RULE_FIRED),
    "rule_errors": """WITH t AS (SELECT *, count(*) OVER (PARTITION BY name) AS copies FROM (
  SELECT CASE item_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'twin' ELSE 'rule ' || item_id END AS name, text AS description,
    CASE WHEN item_id % 8 = 0 THEN '(?P<x>a)' WHEN item_id % 7 <> 0 THEN text END AS pattern, item_id FROM benchmark))
SELECT name, errors, count(*) AS n FROM (SELECT name, concat_ws('; ', CASE WHEN name = '' THEN 'name is empty' END,
  CASE WHEN length(description) > 500 THEN 'description is longer than 500' END,
  CASE WHEN coalesce(pattern, '') = '' THEN 'pattern is empty' END,
  CASE WHEN length(pattern) > 1000 THEN 'pattern is longer than 1000' END,
  CASE WHEN item_id % 3 = 0 AND item_id % 8 <> 0 THEN 'unknown pattern type' END,
  CASE WHEN item_id % 8 = 0 THEN 'regex does not compile' END, CASE WHEN item_id % 4 = 0 THEN 'unknown severity' END,
  CASE WHEN item_id % 6 = 0 THEN 'unknown protocol' END, CASE WHEN copies > 1 THEN 'duplicate name' END) AS errors FROM t)
GROUP BY ALL""",
    "custom_rules_many": sql("""SELECT 'rule ' || r AS rule_name, count(*) AS n, count(DISTINCT src_ip) AS sources
FROM texts, (SELECT unnest(range(300)) AS r) WHERE r <> 7 AND contains(lower(body), CAST(r AS VARCHAR)) GROUP BY r""", "payload"),
    "alerts_cooled": sql("SELECT id, us, gk AS src_ip FROM cooled", greedy("cooled", "pf", "src_ip", COOL)),
    "alerts_cooled_hot": sql("SELECT id, us, gk AS key FROM cooled", greedy("cooled", "pf", "'all'", "> g.us + 60000000")),
    "alerts_deduped": sql("""SELECT k.id AS seq, k.us, k.alert_type, k.source_ip, k.destination_ip FROM ka k
JOIN kept g ON g.gk = k.ak AND g.us = k.us AND g.id = k.id""", """
  ka AS (SELECT *, alert_type || '|' || source_ip || '|' || coalesce(destination_ip, '-') AS ak FROM a)""",
                          greedy("kept", "ka", "ak", f">= g.us + {12 * HOUR}")),
    "pipeline_alerts": sql("""SELECT k.packet_id, k.us, k.detector, k.alert_type, k.severity, k.source_ip, k.destination_ip,
  k.description FROM keyed_alerts k JOIN stored_g g ON g.gk = k.ak AND g.us = k.us AND g.id = k.id""", *PIPELINE),
    "pipeline_alert_ids": 'SELECT true AS "unique", true AS "any"',
    "pipeline_statistics": sql("""SELECT n AS packets_processed, t AS threats_detected, r AS alerts_processed, s AS alerts_stored,
  r - s AS alerts_suppressed, round(t / n * 100, 6) AS detection_rate FROM (SELECT (SELECT count(*) FROM pf) AS n,
  (SELECT count(DISTINCT packet_id) FROM keyed_alerts) AS t, (SELECT count(*) FROM keyed_alerts) AS r,
  (SELECT count(*) FROM stored_g) AS s)""", *PIPELINE),
    # anomalies
    "traffic_features": sql("SELECT * REPLACE (round(packets_per_second, 6) AS packets_per_second, "
                            "round(bytes_per_second, 6) AS bytes_per_second, CAST(unique_ports_accessed AS BIGINT) "
                            "AS unique_ports_accessed) FROM feat", PORT_SPELLS),
    "anomaly_scores": sql("SELECT id, us, src_ip, round(score, 6) AS score FROM scored", PORT_SPELLS, FOREST),
    "anomaly_alerts": sql(f"""SELECT id AS packet_id, us, 'Network Anomaly' AS alert_type, {MARKED_SEVERITY} AS severity,
  src_ip AS source_ip, dst_ip AS destination_ip, round(score, 6) AS score, CAST(packet_size AS BIGINT) AS packet_size,
  CAST(dst_port AS BIGINT) AS dst_port, round(packets_per_second, 6) AS packets_per_second,
  round((SELECT count(*) FROM pf q WHERE q.protocol = scored.protocol) / (SELECT count(*) FROM pf), 6) AS protocol_frequency
FROM scored WHERE score < 0""", PORT_SPELLS, FOREST),
    "anomaly_feed": sql(f"""SELECT us AS timestamp_us, src_ip AS source_ip, dst_ip AS destination_ip,
  round(score, 6) AS anomaly_score, {MARKED_SEVERITY} AS severity, packet_size, protocol, id
FROM (SELECT *, id = min(id) OVER (PARTITION BY us, src_ip) AND bool_or(id % 2 = 0) OVER (PARTITION BY us, src_ip) AS hit
  FROM scored WHERE score < 0) WHERE NOT hit ORDER BY us DESC, id DESC LIMIT 10""", PORT_SPELLS, FOREST),
    "anomaly_statistics": sql("""SELECT n AS packets_processed, k AS anomalies_detected, round(k / n, 6) AS detection_rate, score_count,
  score_mean, score_std, score_min, score_max FROM (SELECT count(*) AS n, count(*) FILTER (score < 0) AS k FROM scored),
  (SELECT count(score) AS score_count, round(avg(score), 6) AS score_mean, round(stddev_pop(score), 6) AS score_std,
    round(min(score), 6) AS score_min, round(max(score), 6) AS score_max
   FROM (SELECT score FROM scored ORDER BY us DESC, id DESC LIMIT 1000))""", PORT_SPELLS, FOREST),
    "score_quantiles": sql("""SELECT q AS share, round(a + (b - a) * (pos - floor(pos)), 9) AS value FROM (
  SELECT q, any_value(pos) AS pos, min(s) AS a, max(s) AS b FROM (
    SELECT packets_per_second * 1000 + packet_size / 7.0::DOUBLE AS s,
      row_number() OVER (ORDER BY packets_per_second * 1000 + packet_size / 7.0::DOUBLE) - 1 AS place FROM feat),
  (SELECT q, q * (SELECT count(*) - 1 FROM feat) AS pos FROM (SELECT unnest([0.0, 0.1, 0.37, 0.5, 0.9, 1.0])::DOUBLE AS q))
  WHERE place IN (floor(pos), ceil(pos)) GROUP BY q)""", PORT_SPELLS),
    "anomaly_found": sql(f"SELECT id, us, src_ip, {MARKED_SEVERITY} AS severity FROM marked WHERE score < -0.5", PORT_SPELLS, MARKED),
    "anomaly_marked_feed": sql(f"""SELECT us AS timestamp_us, src_ip AS source_ip, dst_ip AS destination_ip, score AS anomaly_score,
  {MARKED_SEVERITY} AS severity, packet_size, protocol, id,
  format('Anomalous network behavior detected from {{}}. Anomaly score: {{:.3f}}', src_ip, score) AS description
FROM (SELECT *, id = min(id) OVER (PARTITION BY us, src_ip) AND bool_or(id % 2 = 0) OVER (PARTITION BY us, src_ip) AS hit
  FROM marked WHERE score < -0.5) WHERE NOT hit ORDER BY us DESC, id DESC LIMIT 200""", PORT_SPELLS, MARKED),
    "anomaly_totals": sql("""SELECT n AS packets_processed, k AS anomalies_detected, round(k / n, 6) AS detection_rate, score_count,
  score_mean, score_std, score_min, score_max FROM (SELECT count(*) AS n, count(*) FILTER (score < -0.5) AS k FROM marked),
  (SELECT count(score) AS score_count, round(avg(score), 6) AS score_mean, round(stddev_pop(score), 6) AS score_std,
    round(min(score), 6) AS score_min, round(max(score), 6) AS score_max
   FROM (SELECT score FROM marked ORDER BY us DESC, id DESC LIMIT 1000))""", PORT_SPELLS, MARKED),
    "anomaly_alert_details": sql(f"""SELECT id AS packet_id, us, 'Network Anomaly' AS alert_type, {MARKED_SEVERITY} AS severity,
  src_ip AS source_ip, dst_ip AS destination_ip,
  format('Anomalous network behavior detected from {{}}. Anomaly score: {{:.3f}}', src_ip, score) AS description,
  round(score, 6) AS score, CAST(packet_size AS BIGINT) AS packet_size, CAST(dst_port AS BIGINT) AS dst_port,
  round(packets_per_second, 6) AS packets_per_second,
  round((SELECT count(*) FROM pf q WHERE q.protocol = marked.protocol) / (SELECT count(*) FROM pf), 6) AS protocol_frequency
FROM marked WHERE score < -0.5""", PORT_SPELLS, MARKED),
    "feature_vectors": sql("SELECT id, " + ", ".join(
        f"round(CAST(CAST({e} AS FLOAT) AS DOUBLE), 3) AS {n}" for n, e in [
            *[(x, x) for x in ("packet_size", "payload_size", "src_port", "dst_port", "hour_of_day", "is_weekend",
                               "packets_per_second", "bytes_per_second", "unique_ports_accessed")],
            *[(f"is_{x.lower()}", f"(protocol = '{x}')") for x in ("TCP", "UDP", "ICMP")],
            *[(f"has_{x.lower()}", f"contains(tcp_flags, '{x}')") for x in ("SYN", "ACK", "FIN", "RST")]]) + " FROM feat",
                           PORT_SPELLS),
    "baseline_scalars": sql("""SELECT count(*) AS samples, round(avg(size), 6) AS avg_packet_size,
  round(stddev_pop(size), 6) AS std_packet_size,
  round(count(*) FILTER (NOT we) / greatest(1, count(DISTINCT d) FILTER (NOT we)), 6) AS weekday_avg_traffic,
  round(count(*) FILTER (we) / greatest(1, count(DISTINCT d) FILTER (we)), 6) AS weekend_avg_traffic
FROM (SELECT *, isodow(make_timestamp(us)) >= 6 AS we, CAST(make_timestamp(us) AS DATE) AS d FROM p)"""),
    "baseline_protocols": sql("SELECT protocol, round(f, 6) AS frequency FROM bp", BASELINES),
    "baseline_ports": sql("SELECT dst_port, round(f, 6) AS frequency FROM bd", BASELINES),
    "baseline_hours": sql("SELECT hour, round(f, 6) AS frequency FROM bh", BASELINES),
    "baseline_compare": sql("""SELECT feat.id, coalesce(bp.f, 0) < 0.01 AS is_rare_protocol, coalesce(bd.f, 0) < 0.001 AS is_rare_port,
  coalesce(bh.f, 0) < 0.01 AS is_unusual_time, round(abs(packet_size - m) / m, 6) AS packet_size_deviation,
  round(coalesce(bp.f, 0), 6) AS protocol_frequency, round(coalesce(bd.f, 0), 6) AS port_frequency,
  round(coalesce(bh.f, 0), 6) AS hourly_frequency
FROM feat LEFT JOIN bp USING (protocol) LEFT JOIN bd ON bd.dst_port = feat.dst_port LEFT JOIN bh ON bh.hour = feat.hour_of_day,
  (SELECT avg(size) AS m FROM p)""", PORT_SPELLS, BASELINES),
    # maintenance
    "retention": sql(f"""SELECT 'packets' AS table_name, count(*) FILTER (us >= {AS_OF} - {10 * DAY}) AS kept,
  count(*) FILTER (us < {AS_OF} - {10 * DAY}) AS dropped FROM p
UNION ALL SELECT 'alerts', count(*) FILTER (us >= {AS_OF} - {10 * DAY} OR NOT resolved),
  count(*) FILTER (us < {AS_OF} - {10 * DAY} AND resolved) FROM a
UNION ALL SELECT 'all_alerts', count(*) FILTER (us >= {AS_OF} - {10 * DAY}), count(*) FILTER (us < {AS_OF} - {10 * DAY}) FROM a
UNION ALL SELECT 'connections', count(*) FILTER (state <> 'ACTIVE'), count(*) FILTER (state = 'ACTIVE') FROM c""", "flows"),
    "retention_kept": sql(f"SELECT {ALERT} FROM a WHERE us >= {AS_OF} - {10 * DAY} OR NOT resolved"),
    "retention_applied": sql(f"""SELECT strftime(make_timestamp(us), '%Y-%m-%d') AS day, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids
FROM p WHERE us >= {AS_OF} - {10 * DAY} GROUP BY 1"""),
    "timeout_connections": sql(f"""SELECT CASE WHEN state = 'ACTIVE' AND last_seen_us < {FAST_AS_OF} - {2 * HOUR} THEN 'TIMEOUT'
  ELSE state END AS state, count(*) AS connections FROM c GROUP BY 1""", "flows"),
    "resolve_alerts": sql(f"""SELECT id, us AS timestamp_us, alert_type, severity, source_ip, destination_ip, description,
  resolved OR hit AS resolved, CASE WHEN hit THEN us + CASE WHEN id % 2 = 0 THEN 2 ELSE 1 END * {HOUR}::BIGINT
    ELSE resolved_us END AS resolved_at_us,
  CASE WHEN hit THEN CASE WHEN id % 2 = 0 THEN 'second' ELSE 'first' END ELSE resolved_by END AS resolved_by
FROM (SELECT *, NOT resolved AND id % 3 = 0 AS hit FROM a)"""),
    "purge_like": sql("""SELECT 'alerts' AS table_name, count(*) FILTER (id % 4 <> 0) AS kept, count(*) FILTER (id % 4 = 0) AS dropped FROM a
UNION ALL SELECT 'alert_hosts', count(*) FILTER (destination_ip IS NULL), count(*) FILTER (destination_ip LIKE '192.168.%') FROM a
UNION ALL SELECT 'packets', count(*) FILTER (NOT m), count(*) FILTER (m) FROM (SELECT src_ip LIKE '192.168.%'
  OR src_ip LIKE '10.0.%' OR dst_ip LIKE '192.168.%' OR dst_ip LIKE '10.0.%' AS m FROM p)"""),
    "row_counts": sql("""SELECT 'packets' AS table_name, count(*) AS row_count FROM p UNION ALL SELECT 'alerts', count(*) FROM a
UNION ALL SELECT 'connections', count(*) FROM c""", "flows"),
    # streams
    "stream_trend": sql(f"SELECT {bucket('hour')} AS bucket_us, count(*) AS packet_count, "
                        "CAST(sum(size) AS BIGINT) AS total_bytes FROM pf GROUP BY 1"),
    "stream_rate": sql("""SELECT src_ip, s AS window_start_us, count(*) AS packets, CAST(sum(size) AS BIGINT) AS bytes,
  round(count(*) / 60.0::DOUBLE, 6) AS rate
FROM (SELECT src_ip, size, (us // 10000000 - j) * 10000000 AS s FROM pf, unnest([0, 1, 2, 3, 4, 5]) AS u(j)) GROUP BY 1, 2"""),
    "stream_scan_sessions": sql("""SELECT src_ip, count(DISTINCT dst_port) AS ports, count(DISTINCT dst_ip) AS targets,
  count(*) AS attempts, CAST(sum(failed) AS BIGINT) AS failed, min(us) AS first_us, max(us) AS last_us
FROM scan_rows GROUP BY src_ip, sid""", "scan"),
    "stream_flows": sql("""SELECT * EXCLUDE (state, connection_duration, closed) FROM c
WHERE last_seen_us + 300000000 <= (SELECT max(us) // 1000 * 1000 - 600000000 FROM pf)""", "flows"),
    "stream_flow_states": sql("""SELECT first_seen_us AS first_us, last_seen_us AS last_us, * EXCLUDE (first_seen_us, last_seen_us,
  connection_duration, closed) FROM c""", "flows"),
    "stream_dedup": sql("SELECT us, id, gk AS src_ip FROM kept", "payload", PAYLOAD_HITS,
                        greedy("kept", "payload_hits", "src_ip", ">= g.us + 600000000")),
    "stream_scan_alerts": sql(SCAN_ALERTS, "scan", SCAN_FIRED),
    "stream_features": sql("SELECT * EXCLUDE (timestamp_us) REPLACE (round(packets_per_second, 6) AS packets_per_second, "
                           "round(bytes_per_second, 6) AS bytes_per_second, CAST(unique_ports_accessed AS BIGINT) "
                           "AS unique_ports_accessed) FROM (SELECT *, 0 AS timestamp_us FROM feat)", PORT_SPELLS),
    "stream_flood_alerts": sql(FLOOD_ALERTS, "flood", FLOOD_CAND, FLOOD_FIRED),
    "stream_payload_alerts": sql(r"""SELECT k.id AS packet_id, k.us, 'Suspicious Payload' AS alert_type, 'High' AS severity,
  k.src_ip AS source_ip, k.dst_ip AS destination_ip,
  'Suspicious sql injection pattern detected in traffic from ' || k.src_ip || '.' AS description,
  '{"pattern_category":"sql_injection","target_port":' || k.dst_port || ',"protocol":"' || k.protocol
  || '","payload_size":' || k.payload_size
  || ',"matched_pattern":"(?i)(\\''\\s*or\\s+\\d+\\s*=\\s*\\d+|\\''\\s*or\\s+\\''.*\\''=\\'')"}' AS details
FROM payload_hits k JOIN payload_g g ON g.gk = k.src_ip AND g.us = k.us AND g.id = k.id""", "payload", PAYLOAD_HITS, PAYLOAD_FIRED),
    "stream_pipeline_alerts": sql("""SELECT k.packet_id, k.us, k.detector, k.alert_type, k.severity, k.source_ip, k.destination_ip,
  k.description FROM keyed_alerts k JOIN stored_g g ON g.gk = k.ak AND g.us = k.us AND g.id = k.id""", *PIPELINE),
    "stream_anomaly_alerts": sql(f"""SELECT k.id AS packet_id, k.us, 'Network Anomaly' AS alert_type, {MARKED_SEVERITY} AS severity,
  src_ip AS source_ip, dst_ip AS destination_ip, round(score, 6) AS score, CAST(packet_size AS BIGINT) AS packet_size,
  CAST(dst_port AS BIGINT) AS dst_port, round(packets_per_second, 6) AS packets_per_second,
  round((SELECT count(*) FROM pf q WHERE q.protocol = k.protocol) / (SELECT count(*) FROM pf), 6) AS protocol_frequency
FROM odd k JOIN odd_g g ON g.gk = k.src_ip || '|' || k.dst_ip AND g.us = k.us AND g.id = k.id""", PORT_SPELLS, FOREST,
                                 "\n  odd AS MATERIALIZED (SELECT * FROM scored WHERE score < 0)",
                                 greedy("odd_g", "odd", "src_ip || '|' || dst_ip", ">= g.us + 600000000")),
    "live_feed_figures": sql("""SELECT count(*) AS total_packets, CAST(coalesce(sum(size), 0) AS BIGINT) AS total_bytes,
  count(DISTINCT src_ip) AS unique_sources, count(DISTINCT dst_ip) AS unique_destinations,
  any_value(n) AS unresolved_count, any_value(critical) AS critical_count
FROM pf, (SELECT max(us) // 30000000 * 30000000 - 3570000000 AS first FROM pf),
  (SELECT count(*) + (SELECT count(*) FROM odd_g) AS n,
    count(*) FILTER (k.severity = 'Critical') + (SELECT count(*) FROM odd k JOIN odd_g g ON g.gk = k.src_ip || '|' || k.dst_ip
      AND g.us = k.us AND g.id = k.id WHERE k.score < -0.8) AS critical
   FROM keyed_alerts k JOIN stored_g g ON g.gk = k.ak AND g.us = k.us AND g.id = k.id) WHERE us >= first""",
                             *PIPELINE, PORT_SPELLS, FOREST, "\n  odd AS MATERIALIZED (SELECT * FROM scored WHERE score < 0)",
                             greedy("odd_g", "odd", "src_ip || '|' || dst_ip", ">= g.us + 600000000")),
    "stream_rule_matches": sql("SELECT id, src_ip, rule_name FROM rule_hits", "payload", RULE_HITS),
}
