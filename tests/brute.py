"""Sequential folds over packet lists: the slow, obvious form of the detectors, for tests only."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from datetime import datetime, timedelta, timezone

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
S = 1_000_000
COMMON = {80, 443, 22, 21, 25, 53, 110, 143, 993, 995}
SCHEMA = ("id long, timestamp timestamp, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, "
          "size int, tcp_flags string, payload_size int")


def packet(i, us, src="a", dst="b", sport=1, dport=2, proto="TCP", size=100, flags="SYN", payload=0, body=None):
    return dict(id=i, us=int(us), src=src, dst=dst, sport=sport, dport=dport, proto=proto, size=size, flags=flags,
                payload=payload, body=body)


def frame(spark, packets, with_payload=False):
    rows = [(p["id"], T0 + timedelta(microseconds=p["us"]), p["src"], p["dst"], p["sport"], p["dport"], p["proto"],
             p["size"], p["flags"], p["payload"], p["body"]) for p in packets]
    df = spark.createDataFrame(rows, SCHEMA + ", payload string")
    return df if with_payload else df.drop("payload")


def rel(us):
    """Epoch microseconds back to the offsets used in the lists."""
    return us - int(T0.timestamp()) * S


def random_packets(n, seed, span_s, hosts=4, hot=0.5, bodies=(None,)):
    rng = random.Random(seed)
    times = sorted(rng.sample(range(int(span_s * S)), n))
    out = []
    for i, us in enumerate(times):
        src = "h0" if rng.random() < hot else f"h{rng.randrange(hosts)}"
        dst = f"h{rng.randrange(hosts)}"
        proto = rng.choice(["TCP", "TCP", "TCP", "UDP", "ICMP"])
        flags = rng.choice(["SYN", "SYN|ACK", "ACK", "FIN|ACK", "FIN", "RST", "RST|ACK", "PSH", "SYN|RST"]) \
            if proto == "TCP" else None
        ports = (None, None) if proto == "ICMP" else (rng.choice([1000, 1001, 80]), rng.choice(
            [22, 80, 8080, 8001, 8002, 8003, 8004, 1000]))
        out.append(packet(i, us, src, dst, *ports, proto, rng.randrange(40, 1500), flags, rng.randrange(0, 300),
                          rng.choice(bodies)))
    return out


def cooldown(rows, key, window_us, inclusive=False):
    last, out = {}, []
    for r in rows:
        k = key(r)
        gone = r["us"] - last[k] if k in last else None
        if gone is None or (gone >= window_us if inclusive else gone > window_us):
            last[k] = r["us"]
            out.append(r)
    return out


def next_state(state, flags):
    if "SYN" in flags:
        return "SYN_RECEIVED" if "ACK" in flags else "SYN_SENT"
    if "ACK" in flags and state in ("SYN_SENT", "SYN_RECEIVED"):
        return "ESTABLISHED"
    if "FIN" in flags:
        return "FIN_WAIT"
    return "RESET" if "RST" in flags else state


def flows(packets, gap_us=300 * S):
    live, done = {}, []
    for p in packets:
        a, b = (p["src"], p["sport"]), (p["dst"], p["dport"])
        key = (a, b, p["proto"]) if (a, b, p["proto"]) in live else (
            (b, a, p["proto"]) if (b, a, p["proto"]) in live else None)
        if key and p["us"] - live[key]["last"] > gap_us:
            done.append(live.pop(key))
            key = None
        flags = p["flags"] or ""
        if key is None:
            state = "ACTIVE" if p["proto"] != "TCP" else (next_state("", flags) if "SYN" in flags else "UNKNOWN")
            live[(a, b, p["proto"])] = dict(src=a, dst=b, proto=p["proto"], first=p["us"], last=p["us"], n=1,
                                            sent=p["size"], received=0, state=state)
            continue
        f = live[key]
        f["n"] += 1
        f["last"] = p["us"]
        f["sent" if key[0] == a and key[1] == b else "received"] += p["size"]
        if p["proto"] == "TCP":
            f["state"] = next_state(f["state"], flags)
    return done + list(live.values())


def scan(packets, threshold, gap_us=300 * S, cool_us=300 * S):
    live, last, out = {}, {}, []
    for p in packets:
        if p["proto"] != "TCP" or "SYN" not in (p["flags"] or "") or p["dport"] in COMMON:
            continue
        t = live.get(p["src"])
        if t is None or p["us"] - t["last"] > gap_us:
            t = live[p["src"]] = dict(ports=set(), targets=set(), first=p["us"], n=0, failed=0)
        t["ports"].add(p["dport"])
        t["targets"].add(p["dst"])
        t["last"] = p["us"]
        t["n"] += 1
        t["failed"] += "RST" in p["flags"]
        if len(t["ports"]) >= threshold and (p["src"] not in last or p["us"] - last[p["src"]] > cool_us):
            last[p["src"]] = p["us"]
            out.append((p["id"], len(t["ports"]), len(t["targets"]), t["n"], t["failed"]))
    return out


def flood(packets, threshold, window_us=60 * S, cool_us=300 * S, cap=None):
    seen, last, out = defaultdict(list), {}, []
    for p in packets:
        s = seen[p["src"]]
        s.append(p)
        recent = sum(1 for x in (s if cap is None else s[-cap:]) if x["us"] >= p["us"] - window_us)
        rate = recent / (window_us / S)
        if rate > threshold and (p["src"] not in last or p["us"] - last[p["src"]] > cool_us):
            last[p["src"]] = p["us"]
            out.append((p["id"], round(rate, 9), len(s), sum(x["size"] for x in s), len({x["dst"] for x in s})))
    return out


def payload(packets, patterns, cool_us=300 * S):
    last, out = {}, []
    for p in packets:
        if p["payload"] < 10 or not p["body"]:
            continue
        for category, (_, regexes) in patterns.items():
            hit = next((r for r in regexes if re.search(r, p["body"])), None)
            key = (p["src"], category)
            if hit and (key not in last or p["us"] - last[key] > cool_us):
                last[key] = p["us"]
                out.append((p["id"], category, hit[:100]))
                break
    return out


def features(packets, window_us=60 * S):
    seen, out = defaultdict(list), {}
    for p in packets:
        s = seen[p["src"]]
        r = [x for x in s if p["us"] - x["us"] <= window_us] if len(s) > 1 else []
        out[p["id"]] = (round(len(r) / 60, 9), round(sum(x["size"] for x in r) / 60, 9),
                        len({x["dport"] or 0 for x in r}))
        s.append(p)
    return out


def talkers(fs):
    c = Counter()
    for f in fs:
        c[f["src"][0]] += f["n"]
        c[f["dst"][0]] += f["n"]
    return c
