"""Frozen parameter records. Every time-dependent call takes `as_of` explicitly."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from .schema import RULE_PATTERN_TYPES, RULE_PROTOCOLS, SEVERITIES


@dataclass(frozen=True)
class Thresholds:
    """Detector settings; windows are in seconds. The defaults are fixed values."""

    port_scan_threshold: int = 10
    ddos_threshold: float = 100.0
    scan_time_window: int = 300
    ddos_time_window: int = 60
    connection_timeout: int = 300
    alert_cooldown: int = 300
    dedup_window: int = 600
    rate_history_cap: int | None = None
    anomaly_contamination: float = 0.1
    anomaly_threshold: float = -0.5
    min_baseline_samples: int = 1000
    baseline_window_hours: int = 24
    #: Streams forget the totals of a source so long after its last packet; None keeps them for good.
    forget_source_after: int | None = None


@dataclass(frozen=True)
class CustomRule:
    """One user-defined payload rule."""

    name: str
    description: str
    pattern: str
    pattern_type: str
    severity: str = "Medium"
    enabled: bool = True
    protocol: str = "any"
    ports: tuple[int, ...] = ()

    def errors(self) -> list[str]:
        """Reasons why this rule is invalid; empty when it is usable. Whether a regex compiles is for
        `operators.rules.faulty` to say, which asks the engine that runs it."""
        found = []
        if not self.name:
            found.append("name is empty")
        elif len(self.name) > 100:
            found.append("name is longer than 100")
        if len(self.description or "") > 500:
            found.append("description is longer than 500")
        if not self.pattern:
            found.append("pattern is empty")
        elif len(self.pattern) > 1000:
            found.append("pattern is longer than 1000")
        if self.pattern_type not in RULE_PATTERN_TYPES:
            found.append("unknown pattern type")
        if self.severity not in SEVERITIES:
            found.append("unknown severity")
        if (self.protocol or "").lower() not in RULE_PROTOCOLS:
            found.append("unknown protocol")
        return found


def validate_rules(rules: list[CustomRule]) -> dict[str, list[str]]:
    """Errors by rule name, duplicates included; only faulty rules appear."""
    bad: dict[str, list[str]] = {}
    seen: set[str] = set()
    for rule in rules:
        errors = rule.errors()
        if rule.name in seen:
            errors.append("duplicate name")
        seen.add(rule.name)
        if errors:
            bad.setdefault(rule.name, []).extend(errors)
    return bad


@dataclass(frozen=True)
class PacketCriteria:
    src_ip: str | None = None
    dst_ip: str | None = None
    protocol: str | None = None
    src_port: int | None = None
    dst_port: int | None = None
    start_time: datetime | None = None
    end_time: datetime | None = None
    min_size: int | None = None
    max_size: int | None = None


@dataclass(frozen=True)
class ConnectionCriteria:
    src_ip: str | None = None
    dst_ip: str | None = None
    protocol: str | None = None
    start_time: datetime | None = None
    end_time: datetime | None = None
    min_duration: float | None = None
    state: str | None = None


@dataclass(frozen=True)
class AlertCriteria:
    alert_type: str | None = None
    severity: str | None = None
    source_ip: str | None = None
    resolved: bool | None = None
    start_time: datetime | None = None
    end_time: datetime | None = None


@dataclass(frozen=True)
class CaptureFilter:
    """Which packets enter the analysis; empty tuples mean no restriction."""

    protocols: tuple[str, ...] = ()
    included_ips: tuple[str, ...] = ()
    excluded_ips: tuple[str, ...] = ()
    included_ports: tuple[int, ...] = ()
    excluded_ports: tuple[int, ...] = ()
    max_packet_size: int | None = None
    allowed: tuple[str, ...] = field(default=("tcp", "udp", "icmp"))
