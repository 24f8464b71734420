"""Repair of conversations whose turns are lost, blank, repeated, cut off or under a wrong role.

A conversation is well formed when the first letters of its roles read `(s?(ua)+)?`. Every row gets one edit, and
turns may be inserted anywhere; of all edits that end well formed the cheapest are taken, of equally cheap ones
those whose letters come first in ASCII order:

    K  keep                                      0
    R  make it a user's or an assistant's turn   3
    D  delete; a must for blank and repeated     4
    I  insert an empty user or assistant turn    3
    a row that is cut off and not deleted        3 more

Rows are dealt to tasks by conversation and stream through them in Arrow batches, twice. From the last turn to the
first, the state that is carried is the cost to go from each of the four places a conversation can be at (nothing
yet, after a system, a user's, an assistant's turn); each row gets the best edit from each place as four small
numbers in one short. These back pointers are a column, so for a giant conversation it is Spark's sort that spills
them. From the first turn to the last the carried state is the place alone, and edits come out as rows. The heads
of the edits that leave a place are no prefixes of each other, so the ASCII order is settled row by row. No
conversation is ever held as a whole; repeated rows are numbered by a window that sorts inside the same partitions.

Defined results: a null role or text is one space. Rows go by turn, null turns first, then by role and text; equal
rows are repeats of each other. Null conversation ids are one conversation. An empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

import sys
from hashlib import sha256

import pandas as pd
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsentry.llm.common import SPACES

register_pickle_by_value(sys.modules[__name__])

RETYPE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
#: From each place (nothing yet, after s, after u, after a): where a role's first letter leads.
LEADS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: The only role that can be inserted or given at each place, and the cost of ending there.
DUE = ("user", "user", "assistant", "user")
TO_END = (0, 2 * INSERT, INSERT, 0)
#: What may happen at a row: turns inserted before it, then its own edit. Four bits name one.
HEADS = tuple("I" * n + e for n in range(3) for e in "DKR")
EDIT_ROWS = "conv string, place long, edit string, turn string, was_role string, role string, text string, fault string"
SUMMARY = ("conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
           "audit string, repaired_sha256 string")


def _due(place: int) -> int:
    return LEADS[place][DUE[place][0]]


def best_edits(ahead: tuple, initial: str, fault: str | None) -> tuple[tuple, int]:
    """Costs to go before a row from those behind it, less their minimum, and the heads that give them."""
    costs, packed = [], 0
    for place in range(4):
        options, at = [], place
        for n in range(3):
            options.append((INSERT * n + DELETE + ahead[at], HEADS[3 * n]))
            if fault not in ("blank", "duplicate"):
                kept = INSERT * n + (CUT_OFF if fault == "truncated" else 0)
                if initial in LEADS[at]:
                    options.append((kept + ahead[LEADS[at][initial]], HEADS[3 * n + 1]))
                options.append((kept + RETYPE + ahead[_due(at)], HEADS[3 * n + 2]))
            at = _due(at)
        cost, head = min(options)
        costs.append(cost)
        packed |= HEADS.index(head) << 4 * place
    least = min(costs)
    return tuple(c - least for c in costs), packed


def _backwards(batches):
    known, conv, ahead = {}, [], TO_END
    for rows in batches:
        plans = []
        for c, present, initial, fault in zip(rows["conv"], rows["present"], rows["initial"], rows["fault"]):
            if c != conv:
                conv, ahead = c, TO_END
            plan = 0
            if present:
                key = (ahead, initial, fault)
                if key not in known:  # costs differ by little, so there are few situations
                    known[key] = best_edits(*key)
                ahead, plan = known[key]
            plans.append(plan)
        yield rows.assign(plan=plans)


def _forwards(batches):
    conv, place, at, any_row = [], 0, 0, False
    columns = [c.split()[0] for c in EDIT_ROWS.split(", ")]

    def inserted():
        nonlocal at, place
        row = (conv, place, "I", None, None, DUE[at], "", None)
        at, place = _due(at), place + 1
        return row

    def ended():
        if conv == []:
            return
        if not any_row:
            yield (conv, None, None, None, None, None, None, None)
        for _ in range(TO_END[at] // INSERT):
            yield inserted()

    for rows in batches:
        out = []
        for c, present, plan, turn, role, text, fault in zip(
                rows["conv"], rows["present"], rows["plan"], rows["turn"], rows["role"], rows["text"], rows["fault"]):
            if c != conv:
                out.extend(ended())
                conv, place, at, any_row = c, 0, 0, False
            if not present:
                continue
            any_row = True
            head = HEADS[plan >> 4 * at & 15]
            for _ in head[:-1]:
                out.append(inserted())
            edit, new = head[-1], None
            if edit == "K":
                new, at = role, LEADS[at][role[:1]]
            elif edit == "R":
                new, at = DUE[at], _due(at)
            out.append((conv, place, edit, turn, role, new, text, fault))
            place += 1
        yield pd.DataFrame(out, columns=columns)
    yield pd.DataFrame(list(ended()), columns=columns)


def _columns(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, *more: Column) -> DataFrame:
    return df.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").alias("turn"),
                     F.coalesce(F.col(f"`{role_col}`"), F.lit(" ")).alias("role"),
                     F.coalesce(F.col(f"`{text_col}`"), F.lit(" ")).alias("text"), *more)


def _faults(rows: DataFrame) -> DataFrame:
    """Adds `nth` (of equal rows) and `fault`, inside the partitions by conversation."""
    equal = Window.partitionBy("conv", "present", "role", "text").orderBy(F.asc_nulls_first("turn"))
    end = F.substring(F.rtrim("text", F.lit(SPACES)), -1, 1)
    return (rows.withColumn("nth", F.row_number().over(equal))
            .withColumn("fault", F.when(end == "", "blank").when(F.col("nth") > 1, "duplicate")
                        .when(~end.isin(".", "!", "?"), "truncated")))


def edits(df: DataFrame, present: Column | None = None, conv_col: str = "conv_id", turn_col: str = "turn",
          role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per edit: conv (as text), place among the edits, edit, turn (as text), was_role, role, text, fault.

    Rows where `present` does not hold only name their conversation; one that has no others gives one row whose
    edit is null. The rows of a conversation are in one partition, in order, and conversations follow each other.
    """
    here = F.lit(True) if present is None else F.coalesce(present, F.lit(False))
    rows = _columns(df, conv_col, turn_col, role_col, text_col, here.alias("present"))
    kind = rows.schema["turn"].dataType
    dealt = _faults(rows.repartition("conv"))
    turn = F.col("turn").cast(kind)
    down = [F.asc("conv"), turn.desc_nulls_last(), F.desc("role"), F.desc("text"), F.desc("nth")]
    up = [F.asc("conv"), turn.asc_nulls_first(), F.asc("role"), F.asc("text"), F.asc("nth")]
    texts = dealt.sortWithinPartitions(*down).select(
        F.col("conv").cast("string").alias("conv"), "present", F.col("turn").cast("string").alias("turn"), "role",
        "text", F.substring("role", 1, 1).alias("initial"), "nth", "fault")
    planned = texts.mapInPandas(_backwards, T.StructType([*texts.schema.fields, T.StructField("plan", T.IntegerType())]))
    return planned.sortWithinPartitions(*up).mapInPandas(_forwards, EDIT_ROWS)


class _Totals:
    def __init__(self):
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal = self.cost = self.distinct = 0
        self.first = self.last = self.initial = None
        self.audit, self.text, self.any = [], sha256(), False

    def add(self, edit, turn, was_role, role, text, fault):
        self.audit.append(edit)
        if edit != "I":
            if turn is not None and turn != self.last:
                self.first, self.last = turn if self.first is None else self.first, turn
                self.distinct += 1
            if fault:
                self.counts[fault] += 1
            if self.initial is not None and self.initial + was_role[:1] not in ("su", "ua", "au"):
                self.illegal += 1
            self.initial = was_role[:1]
        self.cost += {"K": 0, "R": RETYPE, "D": DELETE, "I": INSERT}[edit]
        if edit != "D":
            self.cost += CUT_OFF if fault == "truncated" else 0
            self.text.update(("\n" if self.any else "").encode() + f"{role}:{text}".encode())
            self.any = True

    def row(self, conv):
        gaps = 0 if self.first is None else int(self.last) - int(self.first) + 1 - self.distinct
        return (conv, gaps, *self.counts.values(), self.illegal, self.cost, "".join(self.audit), self.text.hexdigest())


def _summed(batches):
    conv, totals = [], None
    columns = [c.split()[0] for c in SUMMARY.split(", ")]
    for rows in batches:
        out = []
        for c, edit, *row in zip(rows["conv"], rows["edit"], rows["turn"], rows["was_role"], rows["role"],
                                 rows["text"], rows["fault"]):
            if c != conv:
                if totals:
                    out.append(totals.row(conv))
                conv, totals = c, _Totals()
            if edit is not None:
                totals.add(edit, *row)
        yield pd.DataFrame(out, columns=columns)
    if totals:
        yield pd.DataFrame([totals.row(conv)], columns=columns)


def summary(found: DataFrame) -> DataFrame:
    """One row per conversation of what `edits` returns, read in its order: faults, cost, audit, repaired text's hash.

    The text that is hashed is the repaired turns as `role:text`, joined by line feeds; only the letters of the
    edits are held, one byte a turn.
    """
    return found.mapInPandas(_summed, SUMMARY)


def damaged(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
            text_col: str = "text") -> DataFrame:
    """Test damage by the crc32 of `conv:turn`, modulo 20: columns conv_id, turn, role, text, present.

    0 the row is lost (`present` is false), 1 its text is emptied, 2 loses `.!?`, 3 it comes twice, 4 it is a user's.
    """
    rows = _columns(df, conv_col, turn_col, role_col, text_col)
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv", "turn")])
    code = F.crc32(key.cast("binary")) % 20
    rows = rows.select(
        F.col("conv").alias("conv_id"), "turn", F.when(code == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(code == 1, "").when(code == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (code != 0).alias("present"), F.explode(F.when(code == 3, F.array(F.lit(1), F.lit(2)))
                                                .otherwise(F.array(F.lit(1)))).alias("copy"))
    return rows.drop("copy")
