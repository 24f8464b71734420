"""Conversation repair against a search over all edits, and against a plain reading of the rules."""

import random
import re
import zlib
from hashlib import sha256
from heapq import heappop, heappush

from pyspark.sql import functions as F

from flowsentry.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string, present boolean, plan int, fault string, conv string"
SPACE = " \t\n\x0b\x0c\r"


def faults(rows):
    """(role, text, fault) in order; rows are (turn, role, text)."""
    seen, out = set(), []
    for turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])):
        end = text.rstrip(SPACE)[-1:]
        fault = "blank" if not end else "duplicate" if (role, text) in seen else None if end in ".!?" else "truncated"
        seen.add((role, text))
        out.append((turn, role, text, fault))
    return out


def searched(rows):
    """(cost, audit, turns) by uniform-cost search over every edit, insertions without a limit; heap order breaks ties."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, letters, turns = heappop(heap)
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", letters):
            return cost, audit, list(turns)
        # what is ahead depends on the place and the form so far only
        form = "" if not letters else letters[-1]
        if (at, form) in done or not re.fullmatch("(s?(ua)*u?)?", letters):
            continue
        if len(audit) > 3 * len(rows) + 3:
            continue
        done.add((at, form))
        for role in ("user", "assistant"):
            heappush(heap, (cost + 3, audit + "I", at, letters + role[0], turns + (f"{role}:",)))
        if at < len(rows):
            _, role, text, fault = rows[at]
            heappush(heap, (cost + 4, audit + "D", at + 1, letters, turns))
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                heappush(heap, (cost + more, audit + "K", at + 1, letters + (role[:1] or "?"), turns + (f"{role}:{text}",)))
                for new in ("user", "assistant"):
                    heappush(heap, (cost + more + 3, audit + "R", at + 1, letters + new[0], turns + (f"{new}:{text}",)))
    raise AssertionError


def plain(rows):
    found = faults([(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows])
    cost, audit, turns = searched(found)
    times = [t for t, *_ in found if t is not None]
    letters = [r[:1] for _, r, _, _ in found]
    return (max(times) - min(times) + 1 - len(set(times)) if times else 0,
            *[sum(f == k for *_, f in found) for k in ("blank", "duplicate", "truncated")],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:])), cost, audit,
            sha256("\n".join(turns).encode()).hexdigest())


def random_rows(rng):
    rows = []
    for _ in range(rng.randint(0, 7)):
        rows.append((rng.choice([None, *range(6)]), rng.choice(["system", "user", "user", "assistant", "tool", "", "s", None]),
                     rng.choice(["", " \t", None, "a.", "b? ", "c", "d,\n", "a.", "e!"])))
    return rows


def results(df):
    return {r.conv: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256)
            for r in df.collect()}


def test_cheapest_edits_equal_an_exhaustive_search(spark):
    rng = random.Random(4)
    convs = {i: random_rows(rng) for i in range(250)} | {None: random_rows(rng) + [(9, "user", "x.")]}
    flat = [(c, *r, True, 1, "x", "y") for c, rows in convs.items() for r in rows]
    flat += [(c, 1, "user", "gone", False, 1, "x", "y") for c, rows in convs.items() if not rows or c == 3]
    flat += [(998, None, None, None, None, 1, "x", "y")]
    rng.shuffle(flat)
    df = spark.createDataFrame(flat, SCHEMA).repartition(6)
    got = results(cr.summary(cr.edits(df, F.col("present"))))
    want = {None if c is None else str(c): plain(rows) for c, rows in convs.items()}
    want["998"] = (0, 0, 0, 0, 0, 0, "", sha256(b"").hexdigest())
    assert got == want


def test_edits_are_rows_in_order(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi."), (1, 1, "user", "cut"), (1, 2, "tool", "")],
                               "conv_id long, turn long, role string, text string")
    got = [(r.place, r.edit, r.turn, r.was_role, r.role, r.text, r.fault) for r in cr.edits(df).collect()]
    assert got == [(0, "K", "0", "user", "user", "hi.", None), (1, "R", "1", "user", "assistant", "cut", "truncated"),
                   (2, "D", "2", "tool", None, "", "blank")]
    got = [(r.place, r.edit, r.role, r.text) for r in cr.edits(df.filter("turn <> 1")).collect()]
    assert got == [(0, "K", "user", "hi."), (1, "D", None, ""), (2, "I", "assistant", "")]


def test_a_giant_conversation_streams_over_many_batches(spark):
    rng = random.Random(8)
    rows = [(7, t, rng.choice(["user", "assistant"]), f"turn {t}{rng.choice(['.', '!', ''])} ") for t in range(5000)]
    rows += [(8, 0, "user", "x" * 2_000_000 + "."), (8, 1, "assistant", "y" * 2_000_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(8)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 97)
    try:
        got = results(cr.summary(cr.edits(df)))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    found = faults([r[1:] for r in rows[:5000]])
    ahead, cost, at = {"": 0, "u": 3, "a": 0}, None, None
    for _, role, _, fault in reversed(found):  # the two roles alone: the cheapest cost by a plain recursion
        extra, now = 3 if fault == "truncated" else 0, {}
        for form in ahead:
            due = "a" if form == "u" else "u"
            other = "u" if due == "a" else "a"
            now[form] = min(4 + ahead[form], extra + (0 if role[0] == due else 3) + ahead[due],
                            3 + extra + (0 if role[0] == other else 3) + ahead[other])
        ahead = now
    assert got["7"][5] == ahead[""] and got["7"][0] == 0
    assert got["8"][5:7] == (3, "KK")


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert cr.summary(cr.edits(cr.damaged(df), F.col("present"))).isEmpty()


def test_damage_goes_by_conversation_and_turn(spark):
    rows = [(c, t, "assistant", f"text {c}.{t}! ok?") for c in range(40) for t in [*range(9), None]]
    rows += [(None, 3, None, None), (None, None, "user", "a.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    want = []
    for c, t, role, text in rows:
        code = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", " " if text is None else text
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        want += [(c, t, "user" if code == 4 else role, text, code != 0)] * (2 if code == 3 else 1)
    got = [(r.conv_id, r.turn, r.role, r.text, r.present) for r in cr.damaged(df).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
