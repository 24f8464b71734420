"""Greedy alert suppression: cooldown and deduplication.

An alert passes when no earlier *passed* alert of its key lies within the window. Which alerts pass
depends on the order, so this is no plain window function. It is computed exactly by pointers: gaps
between neighbouring candidates that exceed the window cut every key into independent islands, the
first candidate of an island passes, and every candidate points to the one that would pass after it.
The chain from the first candidate is marked by doubling the pointers, which takes log2(longest chain)
equi-joins on unique (key, moment) pairs and ends when no pointer is left. A key that never falls
silent is spread over all tasks like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..schema import SECOND_US
from ..session import cut
from .ordered import running, session_slices, slice_start, slice_width


def thin(candidates: DataFrame, keys: list[str], window_seconds: float, *, us: str = "us",
         row_id: str = "id", inclusive: bool = False) -> DataFrame:
    """Rows of `candidates` that pass the suppression, all columns kept.

    inclusive=False passes when the elapsed time is longer than the window (cooldown),
    inclusive=True when it is longer or equal (deduplication). Equal moments pass by lowest id.
    """
    window_us = int(round(window_seconds * SECOND_US))
    # read several times below, and the detectors that make the candidates are costly
    candidates = cut(candidates)
    passed = passing_moments(candidates, keys, window_us, us=us, row_id=row_id, inclusive=inclusive)
    same = [candidates[k].eqNullSafe(passed[f"_{k}"]) for k in keys]
    return candidates.join(
        passed, on=same + [candidates[us] == passed["_us"], candidates[row_id] == passed["_id"]],
        how="left_semi")


def passing_moments(candidates, keys, window_us, *, us, row_id, inclusive) -> DataFrame:
    """(_key…, _us, _id) of the rows that pass."""
    names = [f"_{k}" for k in keys]
    moments = (candidates.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names)],
                                  F.col(us).alias("_us"))
               .agg(F.min(row_id).alias("_id")))
    islands = session_slices(moments, names, "_us", window_us, split_at_gap=inclusive)
    # (key, slice) -> island; a slice lies in one island, so this is one row per slice
    return _jump(_place(moments, islands, names, window_us), names, window_us, inclusive)


def _place(moments, islands, names, window_us):
    of_slice = islands.select(*[F.col(n).alias(f"s{n}") for n in names],
                              F.col("slice").alias("s_slice"), "session_us")
    start = slice_start(moments["_us"], slice_width(window_us))
    on = [moments[n].eqNullSafe(of_slice[f"s{n}"]) for n in names] + [start == of_slice["s_slice"]]
    return moments.join(of_slice, on).select(*names, "_us", "_id", "session_us")


def _jump(placed, names, window_us, inclusive):
    """Mark the chain of every island by doubling pointers; marks and pointers of a round are one table."""
    nxt = _next_pointers(placed, names, window_us, inclusive)
    first = F.col("_us") == F.col("session_us")
    state, left = _counted(nxt.select(*names, "session_us", "_us", "_id", "next_us", "next_id", first.alias("marked")))
    while True:
        marked = state.filter("marked").select(*names, "session_us", "_us", "_id")
        if not left:
            return marked.select(*names, "_us", "_id")
        jump = state.filter("next_us is not null")
        hop = _renamed(jump, names)
        on = [marked[n].eqNullSafe(hop[f"h{n}"]) for n in names] + [marked["_us"] == hop["h_us"]]
        reached = marked.join(hop, on).select(*names, F.col("h_next_us").alias("r_us"))
        reached = reached.select(*[F.col(n).alias(f"r{n}") for n in names], "r_us")
        on = [state[n].eqNullSafe(hop[f"h{n}"]) for n in names] + [state["next_us"] == hop["h_us"]]
        doubled = state.join(hop, on, "left").select(
            *names, "session_us", "_us", "_id", F.col("h_next_us").alias("next_us"),
            F.col("h_next_id").alias("next_id"), "marked")
        on = [doubled[n].eqNullSafe(reached[f"r{n}"]) for n in names] + [doubled["_us"] == reached["r_us"]]
        state, left = _counted(doubled.join(reached, on, "left").select(
            *names, "session_us", "_us", "_id", "next_us", "next_id",
            (F.col("marked") | F.col("r_us").isNotNull()).alias("marked")))


def _counted(state):
    """The table cut off from its lineage, and how many pointers it holds, counted while it is written."""
    seen = Observation()
    return cut(state.observe(seen, F.count("next_us").alias("left"))), seen.get["left"]


def _renamed(jump, names):
    return jump.select(*[F.col(n).alias(f"h{n}") for n in names], F.col("_us").alias("h_us"),
                       F.col("next_us").alias("h_next_us"), F.col("next_id").alias("h_next_id"))


def _next_pointers(placed, names, window_us, inclusive):
    """For each moment the first one of its island that would pass after it.

    Walks time backwards: the running minimum over candidates already seen at a probe is the first
    candidate at or after the probed moment.
    """
    wait = window_us if inclusive else window_us + 1
    candidate = placed.select(
        *names, "session_us", (-F.col("_us")).alias("back"), F.lit(0).alias("probe"),
        F.struct("_us", "_id").alias("origin"), F.struct("_us", "_id").alias("target"))
    probe = placed.select(
        *names, "session_us", (-(F.col("_us") + wait)).alias("back"), F.lit(1).alias("probe"),
        F.struct("_us", "_id").alias("origin"), F.lit(None).cast(candidate.schema["target"].dataType).alias("target"))
    swept = running(candidate.unionByName(probe), [*names, "session_us"], ["back", "probe"],
                    {"target": F.min})
    return swept.filter("probe = 1").select(
        *names, "session_us", F.col("origin._us").alias("_us"), F.col("origin._id").alias("_id"),
        F.col("target._us").alias("next_us"), F.col("target._id").alias("next_id"))
