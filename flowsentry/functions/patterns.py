"""Payload pattern categories and the fallback payload text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Category, severity, and its patterns in the order they are tried.
PATTERNS = {
    "sql_injection": ("High", (
        r"(?i)(union\s+select|select\s+.*\s+from|insert\s+into|delete\s+from)",
        r"(?i)(drop\s+table|create\s+table|alter\s+table)",
        r"(?i)(\'\s*or\s+\d+\s*=\s*\d+|\'\s*or\s+\'.*\'=\')",
        r"(?i)(exec\s*\(|execute\s*\(|sp_executesql)",
    )),
    "xss": ("Medium", (
        r"(?i)(<script[^>]*>|</script>|javascript:|vbscript:)",
        r"(?i)(onload\s*=|onclick\s*=|onerror\s*=|onmouseover\s*=)",
        r"(?i)(alert\s*\(|confirm\s*\(|prompt\s*\()",
        r"(?i)(<iframe[^>]*>|<object[^>]*>|<embed[^>]*>)",
    )),
    "command_injection": ("High", (
        r"(?i)(;\s*cat\s+|;\s*ls\s+|;\s*pwd|;\s*id\s*;)",
        r"(?i)(&&\s*cat\s+|&&\s*ls\s+|&&\s*pwd|&&\s*id)",
        r"(?i)(\|\s*cat\s+|\|\s*ls\s+|\|\s*pwd|\|\s*id)",
        r"(?i)(rm\s+-rf|chmod\s+777|wget\s+http|curl\s+http)",
    )),
    "malware_communication": ("Critical", (
        r"(?i)(bot\d+|infected|zombie|backdoor)",
        r"(?i)(c&c|command.*control|botnet)",
        r"(?i)(payload|shellcode|exploit)",
        r"(?i)(trojan|virus|malware|rootkit)",
    )),
}

# `.` stops at a line feed only, classes and letter case go by Unicode.
DIALECT = "(?dU)"

# The text assumed for a packet whose payload was not captured.
HTTP_TEXT = "GET /index.php?id=1' OR 1=1-- HTTP/1.1"
SSH_TEXT = "SSH-2.0-OpenSSH_7.4 admin:password123"
LOGIN_TEXT = "USER admin\nPASS password\nSYST\n"


def assumed_payload(dst_port: Column, payload_size: Column) -> Column:
    """Stand-in payload text by destination port and payload size, or null."""
    return F.when(dst_port.isin(80, 8080) & (payload_size > 100), F.lit(HTTP_TEXT)) \
        .when((dst_port == 22) & (payload_size > 50), F.lit(SSH_TEXT)) \
        .when(dst_port.isin(21, 23, 25), F.lit(LOGIN_TEXT))


def payload_text(columns: list[str]) -> Column:
    """The captured payload where the table has one, else the stand-in text."""
    assumed = assumed_payload(F.col("dst_port"), F.col("payload_size"))
    return F.coalesce(F.col("payload"), assumed) if "payload" in columns else assumed


def any_match(text: Column, patterns: dict = PATTERNS) -> Column:
    """Whether any pattern of any category occurs; the first hit ends the search."""
    return reduce(lambda a, b: a | b, [
        text.rlike(DIALECT + p) for _, regexes in patterns.values() for p in regexes])


def matched_patterns(text: Column, patterns: dict = PATTERNS) -> Column:
    """Array of (category, severity, pattern), one entry per category found, in category order.

    Every pattern is written once in the expression, so it runs once per row. Filter rows by
    `any_match` first and do not filter on the result: Spark would push that filter below the
    projection and run all patterns again.
    """
    hits = F.array_compact(F.array(*[
        F.when(text.rlike(DIALECT + p), F.struct(
            F.lit(category).alias("category"), F.lit(severity).alias("severity"), F.lit(p).alias("pattern")))
        for category, (severity, regexes) in patterns.items() for p in regexes]))

    def keep_first(found, hit):
        known = F.exists(found, lambda f: f["category"] == hit["category"])
        return F.when(known, found).otherwise(F.concat(found, F.array(hit)))

    none = F.filter(F.array(F.struct(F.lit("").alias("category"), F.lit("").alias("severity"),
                                     F.lit("").alias("pattern"))), lambda _: F.lit(False))
    return F.aggregate(hits, none, keep_first)
