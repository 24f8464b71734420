"""Benchmark decontamination: every passage of every text is a query to a BM25 index of the test items.

The index is inverted: for each term the items that hold it with their BM25 impacts, and the largest
impact in each block of items. Impacts are divided by the item's full score, so that a score says which share of an
item a passage has, and one threshold serves all items. Block-max WAND finds all items above it: it skips items whose
terms cannot reach the threshold together, first by their blocks' largest impacts, then by the terms'; the
most frequent terms have one joint bound and no list to walk. Items are numbered by length, so that those of a
block have similar impacts. What is found is verified by the share of the question's and of the answer's word n-grams that the passage holds.

Passages are windows of twice the longest item, each beginning half a window after the last, so that an item
that stands in a text lies whole in one of them. The postings of at most `SHARD_POSTINGS` entries travel to
the executors at a time: more items make more such shards, and the texts are read once for each.

Defined results: words are runs outside [\\x20\\x09-\\x0D] in lower case without punctuation at their ends;
null and empty texts or items match nothing; an item's last sentence is its answer, of a single sentence the
last third of its words; equal items are all reported; rows of equal texts all match; an empty benchmark or
table gives no rows. Other columns are ignored by `matches` and kept by `drop_contaminated`.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_left
from dataclasses import dataclass, field
from string import punctuation

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsentry.llm.common import Shipped, whole_texts

register_pickle_by_value(sys.modules[__name__])

K1, B = 1.2, 0.75
#: Least share of an item's full score, and of its question's and answer's n-grams.
MIN_SCORE, MIN_QUESTION, MIN_ANSWER = 0.6, 0.6, 0.6
NGRAM = 3
SHARD_POSTINGS = 2_000_000
#: Items in a block, block bounds computed at a time, and raw words whose term a task remembers.
BLOCK, BOUNDS, REMEMBERED = 8, 1 << 20, 1_000_000
#: Most of an item's full score that the terms bounded together may hold.
COMMON_MASS = 0.25
_MARKS = punctuation.encode()
_SCHEMA = "item_id long, passage int, score double, question_overlap double, answer_overlap double"


def words(text: str) -> list[bytes]:
    return [w for w in (r.strip(_MARKS) for r in text.lower().encode().split()) if w]


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    sentences = [w for w in map(words, re.split(r"(?<=[.!?])\s+", text)) if w]
    if len(sentences) > 1:
        return [w for s in sentences[:-1] for w in s], sentences[-1]
    every = sentences[0] if sentences else []
    cut = len(every) - len(every) // 3
    return every[:cut], every[cut:]


def _grams(ids: list[int]) -> set[tuple[int, ...]]:
    n = min(NGRAM, len(ids))
    return {tuple(ids[i:i + n]) for i in range(len(ids) - n + 1)} if n else set()


@dataclass
class Index:
    """Postings of one shard of items; items are numbered within the shard."""

    item_ids: list[int]
    terms: dict[bytes, int]
    postings: list[list[int]]          # by term: item numbers, ascending
    impacts: list[list[float]]
    question: list[set]
    answer: list[set]
    window: int
    largest: np.ndarray = field(init=False)
    blocks: int = field(init=False)                     # of BLOCK items each
    block_of: tuple = field(init=False)                 # by term: where its blocks start; block numbers; their largest
    common: list[dict[int, float]] = field(init=False)  # by item: impacts of the most frequent terms
    common_most: float = field(init=False, default=0.0)
    known: dict = field(init=False, default_factory=dict)

    def __post_init__(self):
        self.largest = np.array([max(i) for i in self.impacts] + [0.0])  # the last stands for unknown words
        # the most frequent terms are bounded together: no item gets more than `common_most` from all of them
        self.common, mass = [{} for _ in self.item_ids], np.zeros(len(self.item_ids))
        for t in sorted(range(len(self.postings)), key=lambda t: -len(self.postings[t])):
            grown = mass.copy()
            grown[self.postings[t]] += self.impacts[t]
            if grown.max() > COMMON_MASS:
                break
            mass = grown
            for item, gain in zip(self.postings[t], self.impacts[t]):
                self.common[item][t] = gain
            self.largest[t] = 0.0
        self.common_most = float(mass.max(initial=0.0))
        self.blocks = -(-len(self.item_ids) // BLOCK)
        starts, numbers, tops = [0], [], []
        for t, items in enumerate(self.postings):
            if self.largest[t] > 0:
                most: dict[int, float] = {}
                for item, gain in zip(items, self.impacts[t]):
                    most[item // BLOCK] = max(most.get(item // BLOCK, 0.0), gain)
                numbers += most
                tops += most.values()
            starts.append(len(numbers))
        self.block_of = np.array(starts), np.array(numbers, np.int64), np.array(tops)

    def term_ids(self, text: str) -> np.ndarray:
        """The term of each word, -1 for a word that no item has; the text's words keep their places."""
        known, raw = self.known, text.lower().encode().split()
        if len(known) > REMEMBERED:
            known.clear()
        for r in set(raw).difference(known):
            word = r.strip(_MARKS)
            known[r] = self.terms.get(word, -1) if word else -2
        ids = np.array([known[r] for r in raw], np.int64)
        return ids[ids != -2] if len(ids) and ids.min() == -2 else ids

    def block_bounds(self, passage: np.ndarray, term: np.ndarray, passages: int) -> np.ndarray:
        """For each passage and block the most that an item of the block can get from the passage's terms."""
        starts, numbers, tops = self.block_of
        each = np.unique(passage * len(self.largest) + term)
        passage, term = each // len(self.largest), each % len(self.largest)
        count = starts[term + 1] - starts[term]
        ends = np.cumsum(count)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[term] - (ends - count), count)
        return np.bincount(np.repeat(passage, count) * self.blocks + numbers[at], tops[at],
                           passages * self.blocks).reshape(passages, self.blocks)

    def above(self, query: list[int], threshold: float, live: np.ndarray) -> list[tuple[int, float]]:
        """Block-max WAND: every item whose impacts for the query's distinct terms reach the threshold.

        Only the lists of the less frequent terms are walked, since the frequent ones can add `common_most`
        at most, and only within `live` blocks, those whose largest impacts can reach the rest.
        """
        least, asked, blocks = threshold - self.common_most, set(query), np.flatnonzero(live).tolist()
        lists = [[t, 0] for t in query if self.largest[t] > 0]  # term and place in its postings
        found = []
        while lists:
            lists.sort(key=lambda x: self.postings[x[0]][x[1]])
            bound, pivot = 0.0, -1
            for i, (t, _) in enumerate(lists):
                bound += self.largest[t]
                if bound >= least:
                    pivot = i
                    break
            if pivot < 0:
                break
            item = self.postings[lists[pivot][0]][lists[pivot][1]]
            while pivot + 1 < len(lists) and self.postings[lists[pivot + 1][0]][lists[pivot + 1][1]] == item:
                pivot += 1
            block = bisect_left(blocks, item // BLOCK)
            if block == len(blocks):
                break
            to = max(item, blocks[block] * BLOCK)
            if to == item and self.postings[lists[0][0]][lists[0][1]] == item:
                score = sum(self.impacts[t][at] for t, at in lists[:pivot + 1])
                score += sum(gain for t, gain in self.common[item].items() if t in asked)
                if score >= threshold:
                    found.append((item, score))
                to = item + 1
            for x in lists[:pivot + 1]:
                x[1] = bisect_left(self.postings[x[0]], to, x[1])
            lists = [x for x in lists if x[1] < len(self.postings[x[0]])]
        return found

    def search(self, text: str) -> list[tuple[int, int, float, float, float]]:
        """(item number, passage, score, question overlap, answer overlap) of each verified item, at its best passage."""
        ids = self.term_ids(text)
        half = self.window // 2
        count = max(1, -(-(len(ids) - half) // half))
        places = np.flatnonzero(self.largest[ids] > 0)
        best: dict[int, tuple] = {}
        step = max(1, BOUNDS // self.blocks)
        for low in range(0, count if len(places) else 0, step):
            high = min(count, low + step)
            # a word is in the passage that begins in its half window and in the one before
            passage = np.concatenate([places // half, places // half - 1])
            inside = (passage >= low) & (passage < high)
            term = ids[np.concatenate([places, places])[inside]]
            bounds = self.block_bounds(passage[inside] - low, term, high - low)
            live = bounds >= MIN_SCORE - self.common_most - 1e-9
            for p in np.flatnonzero(live.any(1)).tolist():
                self._verify(ids[(low + p) * half:(low + p) * half + self.window].tolist(), low + p, live[p], best)
        return sorted(best.values())

    def _verify(self, inside: list[int], passage: int, live: np.ndarray, best: dict[int, tuple]) -> None:
        grams = None
        for item, score in self.above(sorted(set(inside) - {-1}), MIN_SCORE, live):
            if grams is None:
                grams = {n: {tuple(inside[i:i + n]) for i in range(len(inside) - n + 1)} for n in range(1, NGRAM + 1)}
            q, a = (sum(g in grams[len(g)] for g in part) / len(part) if part else 1.0
                    for part in (self.question[item], self.answer[item]))
            if q >= MIN_QUESTION and a >= MIN_ANSWER and (item not in best or best[item][2] < score):
                best[item] = (item, passage, score, q, a)


def build_indexes(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text"):
    """The shards of the index, one at a time; document frequencies and mean length are those of all items."""
    items = (benchmark.select(F.col(f"`{id_col}`").cast("long").alias("item_id"),
                              F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")))

    def split(batches):
        for batch in batches:
            rows = [words(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), batch.column("text"), pa.array(
                rows, pa.list_(pa.binary()))], names=["item_id", "text", "words"])

    split_items = items.mapInArrow(split, "item_id long, text string, words array<binary>")
    n, total, longest, postings = split_items.agg(
        F.count("*"), F.sum(F.size("words")), F.max(F.size("words")),
        F.sum(F.size(F.array_distinct("words")))).first()
    if not total:
        return
    shards = -(-postings // SHARD_POSTINGS)
    frequency = split_items.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(
        F.count("*").alias("items"))
    for shard in range(shards):
        here = split_items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == shard)
        rows = sorted((r for r in here.collect() if r["words"]), key=lambda r: (len(r["words"]), r["text"], r["item_id"] or 0))
        own = here.select(F.explode("words").alias("term")).distinct()
        counts = {bytes(r["term"]): r["items"] for r in frequency.join(own, "term").collect()}
        yield _index(rows, counts, n, total / n, max(64, 2 * longest))


def _index(rows, counts: dict[bytes, int], n: int, mean: float, window: int) -> Index:
    terms: dict[bytes, int] = {}
    postings, impacts, question, answer = [], [], [], []
    for number, row in enumerate(rows):
        own: dict[bytes, int] = {}
        for w in map(bytes, row["words"]):
            own[w] = own.get(w, 0) + 1
        length = len(row["words"])
        gains = {w: np.log(1 + (n - counts[w] + 0.5) / (counts[w] + 0.5)) * tf * (K1 + 1)
                 / (tf + K1 * (1 - B + B * length / mean)) for w, tf in own.items()}
        full = sum(gains.values())
        for w, gain in gains.items():
            t = terms.setdefault(w, len(terms))
            if t == len(postings):
                postings.append([])
                impacts.append([])
            postings[t].append(number)
            impacts[t].append(float(gain / full))
        for parts, out in zip(question_and_answer(row["text"]), (question, answer)):
            out.append(_grams([terms[w] for w in parts]))
    return Index([r["item_id"] for r in rows], terms, postings, impacts, question, answer, window)


def matches(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, passage, score, question_overlap, answer_overlap: one row per text and item it holds."""
    texts = whole_texts(df, id_col, text_col)
    found = None
    for index in build_indexes(benchmark, item_col, item_text):
        part = texts.mapInArrow(_searcher(Shipped(df.sparkSession, index)), f"doc_id long, {_SCHEMA}")
        found = part if found is None else found.unionByName(part)
    return found if found is not None else df.sparkSession.createDataFrame([], f"doc_id long, {_SCHEMA}")


def _searcher(shipped):
    def run(batches):
        index = shipped.value
        for batch in batches:
            rows = [(d, index.item_ids[m[0]], *m[1:]) for d, t in
                    zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()) for m in index.search(t)]
            columns = list(zip(*rows)) or [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                names=["doc_id", "item_id", "passage", "score", "question_overlap", "answer_overlap"])

    return run


def drop_contaminated(df: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of `df` in which no item is found, with all their columns."""
    kept = df
    for index in build_indexes(benchmark):
        shipped = Shipped(df.sparkSession, index)

        kept = kept.filter(_cleared(shipped)(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))
    return kept


def _cleared(shipped):
    @F.pandas_udf("boolean")
    def clear(texts: pd.Series) -> pd.Series:
        return pd.Series([not shipped.value.search(t) for t in texts], dtype="bool")

    return clear
