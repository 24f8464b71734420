"""Secret scans by fixed rules and by inferred formats.

Three rules mark secrets (see `RULES`). What they mark is a set of labelled credentials: for each rule its
values, as strings of character classes, make a prefix tree whose statistically compatible states are merged
(red-blue order, Hoeffding bounds on every transition and ending) into a probabilistic automaton. Runs
that no rule marks make one more automaton, the background. Every run of `RUN` or more credential characters
with a digit is then a candidate, and one that no rule marks becomes a span of kind `format` when the best
credential automaton gives its whole string `MARGIN` more log likelihood than the background does.

An automaton has a fixed alphabet and is fitted on at most `TRAINING_VALUES` distinct values of a kind, those
with the smallest hashes, and values of at most `TRAINING_CHARS` characters; rules and scores read every
character of every text.

Defined results: null and empty texts have no spans; a kind without values has no automaton and adds no
spans, without background the candidate characters count as equally likely; repeated rows have equal spans;
null ids are kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import sys
from collections import deque

import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsentry.llm.common import whole_texts, written

register_pickle_by_value(sys.modules[__name__])

# fixed values: the rules' patterns and least lengths
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                     re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
RULES = ("assign", "access", "hex")
KINDS = (*RULES, "format")

RUN = 16
MARGIN = math.log(1000)
TRAINING_VALUES, TRAINING_CHARS = 1_000, 128
ALPHA = 0.05
_PSEUDO = 0.5
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % RUN)
_KEYWORDS = ("passw", "secret", "token", "api")
_CLASSES = str.maketrans({c: s for s, members in (
    ("0", "0123456789"), ("a", "abcdef"), ("g", "ghijklmnopqrstuvwxyz"), ("A", "ABCDEF"),
    ("G", "GHIJKLMNOPQRSTUVWXYZ")) for c in members})
_SYMBOLS = "0agAG+/_.=-"
_RUN_BYTES = bytes(2 if 48 <= b <= 57 else 1 if chr(b) in "+/_.=-" or 65 <= b <= 90 or 97 <= b <= 122 else 0
                   for b in range(256))
_HEX_BYTES = bytes(1 if 48 <= b <= 57 or 97 <= b <= 102 else 0 for b in range(256))


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, number of the rule, end, credential) of each rule's leftmost non-overlapping matches that are long
    enough, ordered by start, then rule. The tests before the patterns only spare texts without a match."""
    found = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS) or not text.isascii():
        found += [(m.start(), 0, m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    if b"\1" * 24 in text.encode().translate(_HEX_BYTES):
        found += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, str]]:
    """Runs of credential characters with a digit that no rule's span overlaps."""
    shape = text.encode().translate(_RUN_BYTES)
    if b"\2" not in shape or not re.search(b"[\1\2]{%d}" % RUN, shape):
        return []
    return [(m.start(), m.end(), m[0]) for m in _CANDIDATE.finditer(text)
            if any(map(str.isdigit, m[0])) and not any(s < m.end() and m.start() < e for s, _, e, _ in base)]


class Automaton:
    """A probabilistic automaton inferred from strings of character classes."""

    def __init__(self, strings: list[str], alpha: float = ALPHA):
        self.next: list[dict[str, int]] = [{}]
        self.seen: list[dict[str, int]] = [{}]  # how often each symbol follows
        self.ends = [0]
        self.visits = [0]
        for s in strings:
            self._add(s)
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge_states()
        self._take_logs()

    def _add(self, s: str) -> None:
        state = 0
        self.visits[0] += 1
        for c in s:
            if c not in self.next[state]:
                self.next[state][c] = len(self.next)
                for part, empty in ((self.next, {}), (self.seen, {}), (self.ends, 0), (self.visits, 0)):
                    part.append(empty)
            self.seen[state][c] = self.seen[state].get(c, 0) + 1
            state = self.next[state][c]
            self.visits[state] += 1
        self.ends[state] += 1

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return n1 > 0 and n2 > 0 and abs(f1 / n1 - f2 / n2) > self.bound * (n1 ** -0.5 + n2 ** -0.5)

    def _compatible(self, a: int, b: int) -> bool:
        """Whether two states agree in how strings end and go on, and so do the states after them."""
        waiting, met = [(a, b)], set()
        while waiting:
            a, b = pair = waiting.pop()
            if pair in met:
                continue
            met.add(pair)
            if self._differ(self.ends[a], self.visits[a], self.ends[b], self.visits[b]):
                return False
            for c in self.next[a].keys() | self.next[b].keys():
                if self._differ(self.seen[a].get(c, 0), self.visits[a], self.seen[b].get(c, 0), self.visits[b]):
                    return False
                if c in self.next[a] and c in self.next[b]:
                    waiting.append((self.next[a][c], self.next[b][c]))
        return True

    def _fold(self, into: int, state: int) -> None:
        """Add the counts of the tree below `state` to `into` and to what follows it."""
        waiting = [(into, state)]
        while waiting:
            into, state = waiting.pop()
            self.visits[into] += self.visits[state]
            self.ends[into] += self.ends[state]
            for c, target in self.next[state].items():
                self.seen[into][c] = self.seen[into].get(c, 0) + self.seen[state][c]
                if c in self.next[into]:
                    waiting.append((self.next[into][c], target))
                else:
                    self.next[into][c] = target

    def _merge_states(self) -> None:
        red, blue = [0], deque((0, c) for c in sorted(self.next[0]))
        while blue:
            parent, c = blue.popleft()
            state = self.next[parent][c]
            if state in red:
                continue
            for r in red:
                if self._compatible(r, state):
                    self.next[parent][c] = r
                    self._fold(r, state)
                    # folding may have hung unmerged states below red ones
                    blue = deque((q, x) for q in red for x in sorted(self.next[q]) if self.next[q][x] not in red)
                    break
            else:
                red.append(state)
                blue.extend((state, x) for x in sorted(self.next[state]))
        number = {s: i for i, s in enumerate(red)}
        self.next = [{c: number[t] for c, t in self.next[s].items()} for s in red]
        self.seen, self.ends, self.visits = ([part[s] for s in red] for part in (self.seen, self.ends, self.visits))

    def _take_logs(self) -> None:
        width = len(_SYMBOLS) + 1
        total = [math.log(n + _PSEUDO * width) for n in self.visits]
        self.log = [{c: math.log(seen.get(c, 0) + _PSEUDO) - t for c in _SYMBOLS} for seen, t in zip(self.seen, total)]
        self.log_end = [math.log(f + _PSEUDO) - t for f, t in zip(self.ends, total)]

    def log_likelihood(self, s: str) -> float:
        """Of the whole string; a symbol that never followed leads back to the first state."""
        state, total = 0, 0.0
        for c in s:
            total += self.log[state][c]
            state = self.next[state].get(c, 0)
        return total + self.log_end[state]


def classes(value: str) -> str:
    return value.translate(_CLASSES)


def learn(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> dict[str, Automaton]:
    """An automaton for each rule with values in `df`, and one named `format` for unmarked candidates."""
    def run(batches):
        for batch in batches:
            kinds, values = [], []
            for text in batch.column("text").to_pylist():
                base = base_spans(text)
                for kind, value in [(RULES[k], v) for _, k, _, v in base] + [
                        ("format", v) for _, _, v in candidates(text, base)]:
                    kinds.append(kind)
                    values.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(values, pa.string())],
                                             names=["kind", "value"])

    found = whole_texts(df, id_col, text_col).mapInArrow(run, "kind string, value string")
    distinct = written(found.filter(F.length("value") <= TRAINING_CHARS).distinct(), "credentials")
    automata = {}
    for kind in KINDS:
        rows = (distinct.filter(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value")
                .limit(TRAINING_VALUES).collect())  # bounded by its parameter
        if rows:
            automata[kind] = Automaton([classes(r["value"]) for r in rows])
    return automata


def all_spans(text: str, automata: dict[str, Automaton]) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end): the rules' spans and the candidates of a learned format."""
    base = base_spans(text)
    spans = [(s, k, e) for s, k, e, _ in base]
    formats = [automata[k] for k in RULES if k in automata]
    if formats:
        background = automata.get("format") or Automaton([])
        for start, end, value in candidates(text, base):
            shape = classes(value)
            if max(a.log_likelihood(shape) for a in formats) - background.log_likelihood(shape) >= MARGIN:
                spans.append((start, 3, end))
    return sorted(spans)


def scan(df: DataFrame, automata: dict[str, Automaton], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans (array of kind, start, end in code points) of every row."""
    def run(batches):
        for batch in batches:
            spans = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in all_spans(t, automata)]
                     for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, _SPANS)],
                                             names=["doc_id", "spans"])

    return whole_texts(df, id_col, text_col).mapInArrow(
        run, "doc_id long, spans array<struct<kind: string, start: long, end: long>>")


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (as text) of scanned rows."""
    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "format")
    return found.select("doc_id", *[of(k) for k in KINDS], F.sha2(listed(base), 256).alias("base_sha256"),
                        listed(F.col("spans")).alias("spans"))
