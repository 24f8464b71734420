"""Removal of repeated byte strings by a common-prefix-aware distributed merge sort of suffixes.

Every byte is removed that a string of `LENGTH` bytes covers which also starts earlier: in a document of a
smaller id, or in the same one before. All occurrences count, overlapping ones too, and strings are judged on
the input. The texts are dealt into blocks, which stay the unit of all later steps.

1. Suffixes. Each window of `LENGTH` bytes is represented by the suffix at its anchor, the leftmost of its
   `GRAM`-byte strings with the least hash. Equal windows have their anchors at the same offset, so nothing is
   lost, and one suffix serves all windows around it, about forty.
2. Filter. Suffixes whose first `GRAM` bytes occur once in the whole corpus have no partner: hashes alone are
   exchanged, those that occur again return to their blocks, and the other suffixes go no further.
3. Sorted runs. Each block sorts its remaining suffixes by (hash, bytes). Those that are equal in all bytes
   that matter are combined inside the block: the first stands for all, the others are repeats for certain.
   The run is front-coded (length of the prefix shared with the one before, and the rest), cut at
   equal ranges of the hash, and exchanged.
4. Merge. A loser tree merges the runs of a range. It keeps for each run the prefix its head shares with the
   last output, decides by these lengths alone where they differ, and compares bytes beyond them only where
   they agree. The shared prefixes come out beside the sorted suffixes, and with the sorted bytes in front of the
   anchors they tell for each window offset which windows are equal. All but the first are repeats.
5. Repeats return to their blocks, where they are removed.

A group of copies reaches a range as one suffix per block and anchor. Hashes are compared only to bring equal
strings together; what is equal is decided on bytes.

Defined results: a null or empty text has no bytes and no spans; a null id counts as the smallest; texts with
equal ids are ordered by hash; rows that repeat id and text are one document and get the same result; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import pickle
import sys

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsentry.llm.common import text_bytes, whole_texts

register_pickle_by_value(sys.modules[__name__])

LENGTH, GRAM = 100, 24
BLOCK_BYTES = 1_500_000
_AT_ONCE = 200_000  # bytes whose hashes are held at a time, unless one text is longer
_PLACE = 28  # bits of a position among these, below the hash
_NO_ID = -(1 << 63)
_MUL = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A mixed 64-bit hash of the GRAM = 24 bytes from each position, by doubling."""
    def wide(h, m, shift):
        return h[:-shift] * m + h[shift:]

    with np.errstate(over="ignore"):
        powers = {1: _MUL}
        for n in (2, 4, 8, 16):
            powers[n] = powers[n // 2] * powers[n // 2]
        h = data.astype(np.uint64) + np.uint64(1)
        for n in (1, 2, 4):
            h = wide(h, powers[n], n)
        eight = h
        sixteen = wide(eight, powers[8], 8)
        whole = sixteen[:-8] * powers[8] + eight[16:]
        whole = (whole ^ (whole >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return whole ^ (whole >> np.uint64(29))


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    out, have = v, 1
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[:-rest], out[rest:]) if rest else out


class Block:
    """The distinct documents of a block, their bytes one after another, and their windows' anchors."""

    def __init__(self, table: pa.Table):
        seen: dict[tuple[int, int], int] = {}
        raw: list[bytes] = []
        self.row_doc = []
        for i, h, t in zip(table.column("doc_id").to_pylist(), table.column("hash").to_pylist(),
                           table.column("text").to_pylist()):
            key = (_NO_ID if i is None else i, h)
            if key not in seen:
                seen[key] = len(raw)
                raw.append(t.encode())
            self.row_doc.append(seen[key])
        self.keys, self.raw = list(seen), raw
        self.starts = np.cumsum([0, *map(len, raw)])
        self.data = np.frombuffer(b"".join(raw), np.uint8)

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Position of each anchor, first and last window start it stands for, and its 48-bit hash."""
        found = [(np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)]
        begin = 0
        for d in range(1, len(self.starts)):  # some documents at a time, which bounds the arrays in between
            if self.starts[d] - self.starts[begin] >= _AT_ONCE or d == len(self.starts) - 1:
                low, high = self.starts[begin], self.starts[d]
                at, first, last, hashes = _anchors(self.data[low:high], np.diff(self.starts[begin:d + 1]))
                found.append((at + low, first + low, last + low, hashes))
                begin = d
        return tuple(np.concatenate(x) for x in zip(*found))


def _anchors(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The anchors of documents that lie one after another in `data`."""
    empty = np.empty(0, np.int64)
    if len(data) < LENGTH:
        return empty, empty, empty, empty.astype(np.uint64)
    hashes = gram_hashes(data)
    place = np.arange(len(hashes), dtype=np.uint64)
    low = np.uint64(_PLACE)
    least = _sliding_min(hashes >> low << low | place, LENGTH - GRAM + 1)
    anchor = (least & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
    window = np.arange(len(anchor))
    inside = window + LENGTH <= np.repeat(np.cumsum(sizes), sizes)[:len(anchor)]
    window, anchor = window[inside], anchor[inside]
    if not len(window):
        return empty, empty, empty, empty.astype(np.uint64)
    new = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    at = anchor[new]
    with np.errstate(over="ignore"):  # anchors have small hashes; mixed once more, these are even again
        spread = (hashes[at] ^ (hashes[at] >> np.uint64(32))) * _MUL
    return at, window[new], window[np.r_[new[1:] - 1, len(window) - 1]], (spread ^ (spread >> np.uint64(29))) >> np.uint64(16)


def _pack(hashes: np.ndarray) -> bytes:
    """48-bit numbers in six bytes each."""
    return np.ascontiguousarray(hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    out = np.zeros((len(packed) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(packed, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel().astype(np.uint64)


def _dealer(parts: int):
    """Which of `parts` equal ranges a 48-bit hash is in."""
    return lambda h: (h >> np.uint64(16)) * np.uint64(parts) >> np.uint64(32)


def _each(values, of):
    """The slices of `values` for each distinct value of the ascending array `of`."""
    cuts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else []
    for a, b in zip(cuts, [*cuts[1:], len(of)]):
        yield int(of[a]), values[a:b]


def _hash_rows(parts: int):
    deal = _dealer(parts)

    def run(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        hashes = np.sort(Block(table).anchors()[3])
        # twice is as good as often
        hashes = hashes[~np.r_[np.zeros(min(2, len(hashes)), bool), hashes[2:] == hashes[:-2]]]
        rows = [(p, _pack(h)) for p, h in _each(hashes, deal(hashes))]
        return pa.table({"part": pa.array([p for p, _ in rows], pa.int64()),
                         "block": pa.array([block] * len(rows), pa.int64()),
                         "hashes": pa.array([h for _, h in rows], pa.binary())})

    return run


def _repeated(table: pa.Table) -> pa.Table:
    """From each block's hashes of one range those that occur twice, in one block or in two."""
    lists = [_unpack(h) for h in table.column("hashes").to_pylist()]
    _, where, counts = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    again = np.split(counts[where] > 1, np.cumsum([len(h) for h in lists])[:-1])
    kept = [np.unique(h[a]) for h, a in zip(lists, again)]
    some = [i for i, h in enumerate(kept) if len(h)]
    return pa.table({"block": table.column("block").take(pa.array(some, pa.int64())).combine_chunks(),
                     "hashes": pa.array([_pack(kept[i]) for i in some], pa.binary())})


def _run_rows(parts: int):
    deal = _dealer(parts)

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        rows = []
        if docs.num_rows and answers.num_rows:
            number = docs.column("block")[0].as_py()
            block = Block(docs)
            at, first, last, hashes = block.anchors()
            wanted = np.concatenate([_unpack(h) for h in answers.column("hashes").to_pylist()])
            own = np.flatnonzero(np.isin(hashes, wanted))
            rows = [(p, number, part) for p, part in _runs(block, at[own], first[own], last[own], hashes[own], deal)]
        return pa.table({"part": pa.array([r[0] for r in rows], pa.int64()),
                         "block": pa.array([r[1] for r in rows], pa.int64()),
                         "run": pa.array([r[2] for r in rows], pa.binary())})

    return run


def _runs(block: Block, at, first, last, hashes, deal):
    """The block's sorted run cut by ranges of the hash: front-coded suffixes with the bytes in front of them."""
    text = block.data.tobytes()
    doc = np.searchsorted(block.starts, at, "right") - 1
    keys = np.array(block.keys, np.int64).reshape(-1, 2)
    key, place = keys[doc], at - block.starts[doc]
    # occurrences in document order, so that the first of equal ones comes first after the stable sort
    order = np.lexsort((place, key[:, 1], key[:, 0]))
    heads = hashes.astype(">u8").tobytes()
    entries = sorted(((heads[8 * i + 2:8 * i + 8] + text[at[i]:last[i] + LENGTH], text[first[i]:at[i]], n, i)
                      for n, i in enumerate(order.tolist())))
    groups: list[list[int]] = []
    strings: list[tuple[bytes, bytes]] = []
    for suffix, front, _, i in entries:
        if strings and strings[-1] == (suffix, front):
            groups[-1].append(i)
        else:
            strings.append((suffix, front))
            groups.append([i])
    lead = np.array([g[0] for g in groups], np.int64)
    for part, numbers in _each(np.arange(len(groups)), deal(hashes[lead]) if len(lead) else lead):
        coded, before = [], b""
        for n in numbers.tolist():
            suffix, front = strings[n]
            shared = common_prefix(before, suffix, 0)
            coded.append((shared, suffix[shared:], front))
            before = suffix
        members = [i for n in numbers.tolist() for i in groups[n]]
        yield part, pickle.dumps((
            coded, [len(groups[n]) for n in numbers.tolist()],
            (at - last)[lead[numbers]].astype(np.uint8).tobytes(),
            (at - first)[lead[numbers]].astype(np.uint8).tobytes(),
            key[members].tobytes(), place[members].astype(np.int64).tobytes()), 5)


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the prefix that `a` and `b` share, given that `known` bytes of it are."""
    n = min(len(a), len(b))
    differs = int.from_bytes(a[known:n]) ^ int.from_bytes(b[known:n])
    return n - (differs.bit_length() + 7) // 8


class LoserTree:
    """Merges sorted runs of (shared with the one before, string, entry) into (shared with the last output,
    string, entry)."""

    def __init__(self, runs):
        self.runs = [iter(r) for r in runs]
        self.width = 1 << max(0, len(self.runs) - 1).bit_length()
        self.shared, self.heads, self.entries = ([None] * self.width for _ in range(3))
        for leaf in range(self.width):
            self._advance(leaf)
            self.shared[leaf] = 0  # nothing is output yet
        self.losers = [0] * self.width
        self.winner = self._build(1)

    def _advance(self, leaf: int) -> None:
        got = next(self.runs[leaf], None) if leaf < len(self.runs) else None
        self.shared[leaf], self.heads[leaf], self.entries[leaf] = got or (-1, None, None)

    def _build(self, node: int) -> int:
        if node >= self.width:
            return node - self.width
        winner, self.losers[node] = self._play(self._build(2 * node), self._build(2 * node + 1))
        return winner

    def _play(self, a: int, b: int) -> tuple[int, int]:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        known, other = self.shared[a], self.shared[b]
        if known != other:  # the one that shares more with the last output is the smaller
            return (a, b) if known > other else (b, a)
        n = common_prefix(x, y, known)
        smaller = n == len(x) or n < len(y) and x[n] < y[n]
        winner, loser = (a, b) if smaller else (b, a)
        self.shared[loser] = n
        return winner, loser

    def __iter__(self):
        while self.heads[self.winner] is not None:
            leaf = self.winner
            yield self.shared[leaf], self.heads[leaf], self.entries[leaf]
            self._advance(leaf)
            node = (leaf + self.width) // 2
            while node:
                leaf, self.losers[node] = self._play(leaf, self.losers[node])
                node //= 2
            self.winner = leaf


def _decoded(coded, base: int):
    string = b""
    for n, (shared, rest, front) in enumerate(coded):
        string = string[:shared] + rest
        yield shared, string, (base + n, front)


def _marks(table: pa.Table) -> pa.Table:
    """Merge the runs of one range and say which windows are repeats: per block document keys and first and
    last start of each row of repeated windows."""
    blocks = table.column("block").to_pylist()
    runs, sizes, lows, highs, keys, places = zip(*(pickle.loads(r) for r in table.column("run").to_pylist()))
    bases = np.cumsum([0, *map(len, runs)])
    order, shared, fronts = [], [], []
    for n, _, (entry, front) in LoserTree([_decoded(r, b) for r, b in zip(runs, bases.tolist())]):
        shared.append(max(0, n - 6))  # without the hash
        order.append(entry)
        fronts.append(front)
    sizes = np.array([n for s in sizes for n in s])
    low, high = (np.frombuffer(b"".join(x), np.uint8).astype(np.int64) for x in (lows, highs))
    key = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
    place = np.frombuffer(b"".join(places), np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    lead = np.cumsum(sizes) - sizes
    home = np.repeat(np.repeat(np.array(blocks), np.diff(bases)), sizes)
    # all but the first of a combined group are repeats in all their windows
    rest = np.ones(len(place), bool)
    rest[lead] = False
    found = [(np.flatnonzero(rest), place[rest] - high[owner[rest]], place[rest] - low[owner[rest]])]
    order = np.array(order)
    first = lead[order]
    rank = np.empty(len(order), np.int64)
    rank[np.lexsort((place[first], key[first, 1], key[first, 0]))] = np.arange(len(order))
    again = _repeats(np.array(shared), fronts, low[order], high[order], rank)
    entry, offset = np.nonzero(again)
    if len(entry):
        cut = np.flatnonzero(np.r_[True, (entry[1:] != entry[:-1]) | (offset[1:] != offset[:-1] + 1)])
        to = np.r_[cut[1:] - 1, len(entry) - 1]
        at = first[entry[cut]]
        found.append((at, place[at] - offset[to], place[at] - offset[cut]))
    at, begin, end = (np.concatenate(x) for x in zip(*found))
    by = np.argsort(home[at], kind="stable")
    rows = [(b, np.column_stack([key[at[i]], begin[i], end[i]]).astype("<i8").tobytes())
            for b, i in _each(by, home[at[by]])]
    return pa.table({"block": pa.array([r[0] for r in rows], pa.int64()),
                     "marks": pa.array([r[1] for r in rows], pa.binary())})


def _repeats(shared: np.ndarray, fronts: list[bytes], low: np.ndarray, high: np.ndarray,
             rank: np.ndarray) -> np.ndarray:
    """For each suffix and offset of a window before it, whether an equal window has a smaller rank.

    Windows at offset o are equal if their suffixes share LENGTH - o bytes, which the merge has told for
    neighbours, and the o bytes in front of them are equal, which is told by sorting these backwards.
    """
    n = len(shared)
    back = [f[::-1] for f in fronts]
    by_front = sorted(range(n), key=back.__getitem__)
    agree = np.zeros(n, np.int64)
    for i in range(1, n):
        a, b = back[by_front[i - 1]], back[by_front[i]]
        agree[i] = len(a) if a == b else common_prefix(a, b, 0)
    by_front = np.array(by_front, np.int64)
    out = np.zeros((n, LENGTH - GRAM + 1), bool)
    front_class = np.empty(n, np.int64)
    for o in range(int(low.min(initial=0)), int(high.max(initial=-1)) + 1):
        here = np.flatnonzero((low <= o) & (o <= high))
        if len(here) < 2:
            continue
        front_class[by_front] = np.cumsum(agree < o)
        kind = np.cumsum(shared < LENGTH - o)[here] * (n + 1) + front_class[here]
        by = np.lexsort((rank[here], kind))
        repeat = np.r_[False, kind[by[1:]] == kind[by[:-1]]]
        out[here[by[repeat]], o] = True
    return out


def _removed(docs: pa.Table, marks: pa.Table) -> pa.Table:
    block = Block(docs)
    number = {k: i for i, k in enumerate(block.keys)}
    change = [np.zeros(len(t) + 1, np.int32) for t in block.raw]
    for packed in marks.column("marks").to_pylist():
        for i, h, begin, end in np.frombuffer(packed, "<i8").reshape(-1, 4).tolist():
            d = change[number[i, h]]
            d[begin] += 1
            d[end + LENGTH] -= 1
    spans, kept = [], []
    for raw, d in zip(block.raw, change):
        gone = np.cumsum(d[:-1]) > 0
        edge = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
        spans.append([{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2])])
        kept.append(np.frombuffer(raw, np.uint8)[~gone].tobytes())
    rows = block.row_doc
    return pa.table({
        "doc_id": docs.column("doc_id").combine_chunks() if docs.num_rows else pa.array([], pa.int64()),
        "n_bytes": pa.array([len(block.raw[r]) for r in rows], pa.int64()),
        "spans": pa.array([spans[r] for r in rows], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        "kept": pa.array([kept[r] for r in rows], pa.binary())})


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, spans (removed byte ranges, end exclusive) and kept (the other bytes) of every row."""
    texts = whole_texts(df, id_col, text_col)
    # several blocks and ranges for each task of a shuffle, and none larger than its bound
    several = 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = text_bytes(texts)
    blocks = max(several, -(-size // BLOCK_BYTES))
    parts = max(several, -(-size // (4 * BLOCK_BYTES)))
    keyed = texts.withColumn("hash", F.xxhash64("text"))
    docs = keyed.select(F.pmod(F.xxhash64("doc_id", "hash"), F.lit(blocks)).alias("block"), "doc_id", "hash", "text")
    hashes = docs.groupBy("block").applyInArrow(_hash_rows(parts), "part long, block long, hashes binary")
    again = hashes.groupBy("part").applyInArrow(_repeated, "block long, hashes binary")
    runs = docs.groupBy("block").cogroup(again.groupBy("block")).applyInArrow(
        _run_rows(parts), "part long, block long, run binary")
    marks = runs.groupBy("part").applyInArrow(_marks, "block long, marks binary")
    return docs.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(
        _removed, "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")
