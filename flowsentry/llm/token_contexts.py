"""Contexts of one and two whole tokens for the suffix tree, with their next tokens, as rows.

A context is a node below the byte context that its last token leaves, so the chain of suffixes is: two tokens, one
token, the token's last bytes, nothing. Its next tokens are counted one by one, whatever their share: a sequence is
looked at from `LEAST` sightings on, as fewer are never further above what its suffix expects than the test of
`far_from_expected` asks for, and a sequence that occurs as often has parts that do. What is kept is a value for each
context, log10 of what its suffix's chances are multiplied by, and one for each kept next token, log10 of what is
left to its own chance. So a text's score is that of the byte contexts plus the values of the sequences in it.

Counts, tests and values are rows that are joined by 64-bit keys of the sequences. Common words have numbers, and
a sequence of them only has these side by side as its key, which takes little room in a shuffle; other keys are
hashes. Keys of different sequences are taken as different. For contexts of one token and of two, the `TRAVEL_MOST` values of
the most frequent sequences, at most, travel to the executors, once each, as files that their workers map, and the others are joined as rows: up to four for a token, none where all values travel. A
filter of 2 ** `FILTER_BITS` bits tells which sequences can be known at all. Both only save rows: whatever does not
travel and may be known is joined by key.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsentry.llm.common import Mapped, Shipped, release, written

register_pickle_by_value(sys.modules[__name__])

LEAST = 4
TRAVEL_MOST = 4_000_000
FILTER_BITS = 27
#: Rows of texts that are cut at a time, sequences that a task gathers before it hands their counts on, and rows handed on at a time.
PART_ROWS, GATHERED, _HANDED = 500, 1_500_000, 100_000
#: Words that are hashed at a time.
HASHED_WORDS = 50_000
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Bits of a common word's number, from 1 on; numbers side by side are below every hash, as these have `_HASHED` set.
WORD_BITS = np.uint64(20)
_WORDS, _HASHED = np.uint64(1) << WORD_BITS, np.uint64(1 << 62)


def parts(batch: pa.RecordBatch):
    """Rows of a batch, their distinct tokens, the tokens' numbers among these, and how many each row has. Each text
    is cut at [\\x20\\x09-\\x0D] with A-Z in lower case, and ends with the empty token."""
    for at in range(0, batch.num_rows, PART_ROWS):
        rows = batch.slice(at, PART_ROWS)
        text = pc.ascii_trim_whitespace(pc.ascii_lower(rows.column("text")))
        text = pc.if_else(pc.equal(text, ""), text, pc.binary_join_element_wise(text, "", " "))
        found = pc.ascii_split_whitespace(text)
        coded = found.flatten().dictionary_encode()
        yield (rows, coded.dictionary, coded.indices.to_numpy().astype(np.int64),
               found.value_lengths().to_numpy().astype(np.int64))


def before(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The token before each one; before a text's first token stands an end."""
    out = np.r_[ids[-1:], ids[:-1]]
    out[np.cumsum(sizes) - sizes] = ids[-1]
    return out


def raw(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all words, and where each begins and ends in them."""
    if not len(words):
        return np.zeros(1, np.uint8), np.zeros(1, np.int64)
    _, ends, data = words.buffers()
    ends = np.frombuffer(ends, np.int32)[words.offset:words.offset + len(words) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8), ends


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashes(words: pa.Array) -> np.ndarray:
    """Keys of words: sums of their bytes, each times a number for its place."""
    if len(words) > HASHED_WORDS:  # a number for every byte takes many times the words' room
        return np.concatenate([hashes(words.slice(i, HASHED_WORDS)) for i in range(0, len(words), HASHED_WORDS)])
    data, ends = raw(words)
    sizes, data = np.diff(ends), data[ends[0]:ends[-1]]
    place = np.arange(len(data)) - np.repeat(ends[:-1] - ends[0], sizes)
    of_place = mixed(np.arange(1, sizes.max(initial=0) + 1, dtype=np.uint64) * _FACTOR)
    sums = np.cumsum((data.astype(np.uint64) + np.uint64(1)) * of_place[place], dtype=np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), sums])[ends - ends[0]]
    return mixed(sums[1:] - sums[:-1] + _FACTOR) | _HASHED


def joined(context: np.ndarray, token: np.ndarray) -> np.ndarray:
    """The key of a context's sequence with one more token."""
    key = context << WORD_BITS | token
    hashed = np.flatnonzero((context >= _WORDS * _WORDS) | (token >= _WORDS))
    key[hashed] = mixed(context[hashed] * _FACTOR + token[hashed]) | _HASHED
    return key


def is_common(words: np.ndarray) -> np.ndarray:
    """Whether keys of words are common words' numbers."""
    return words < _WORDS


class Filter:
    """Bits of the keys of a table; `has` may be true of others, never false of these."""

    def __init__(self, keys: DataFrame):
        folded = F.expr("key ^ shiftleft(key, 7) ^ shiftrightunsigned(key, 17) ^ shiftrightunsigned(key, 34)")
        slot = keys.select((folded.bitwiseAND((1 << FILTER_BITS) - 1) + 1).alias("slot"))
        rows = (slot.select("slot", F.expr("bitmap_bucket_number(slot)").alias("bucket")).repartition("bucket")
                .groupBy("bucket").agg(F.expr("bitmap_construct_agg(bitmap_bit_position(slot))").alias("bits")).toArrow())
        self.bits = np.zeros(1 << FILTER_BITS - 3, np.uint8)
        for bucket, bits in zip(rows.column("bucket").to_pylist(), rows.column("bits").to_pylist()):
            self.bits[(bucket - 1) * 4096:][:4096] = np.frombuffer(bits, np.uint8)

    def has(self, keys: np.ndarray) -> np.ndarray:
        slot = (keys ^ keys << np.uint64(7) ^ keys >> np.uint64(17) ^ keys >> np.uint64(34)) & np.uint64((1 << FILTER_BITS) - 1)
        return (self.bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _spread(keys: np.ndarray) -> np.ndarray:
    return (keys ^ keys >> np.uint64(32)) * _FACTOR  # different keys stay different


class Found:
    """Columns by key. The keys are in order of spread numbers, whose first bits tell where to look."""

    def __init__(self, keys: np.ndarray, *columns: np.ndarray):
        spread = _spread(keys)
        order = np.argsort(spread)
        self.spread, self.columns, self.files = spread[order], [c[order] for c in columns], None

    def __len__(self):
        return len(self.spread)

    def travel_mapped(self, spark) -> Found:
        """From now on the columns and places travel as files."""
        if len(self):
            shift, first = self._places()
            self.files = shift, [Mapped(spark, x) for x in (first, self.spread, *self.columns)]
            self.__setstate__({"files": self.files})  # the driver lets its own go
        return self

    def __getstate__(self):
        return {"files": self.files} if self.files else {"spread": self.spread, "columns": self.columns, "files": None}

    def __setstate__(self, state):
        self.__dict__.update(state)
        if self.files:
            shift, files = self.files
            first, self.spread, *self.columns = (f.array for f in files)
            self.places = shift, first

    def _places(self) -> tuple[np.uint64, np.ndarray]:
        """How far a spread number is shifted, and where the numbers begin that have so many first bits."""
        if "places" not in self.__dict__:
            bits = max(1, len(self).bit_length())
            shift = np.uint64(64 - bits)
            count = np.bincount((self.spread >> shift).astype(np.int64), minlength=1 << bits)
            self.places = shift, np.minimum(np.cumsum(count) - count, len(self) - 1).astype(np.int32)
        return self.places

    def at(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each key stands, and whether it is there."""
        if not len(self):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        shift, first = self._places()
        spread = _spread(keys)
        at = first[spread >> shift]
        met = self.spread[at]
        there, waiting = met == spread, np.flatnonzero((met < spread) & (at < len(self) - 1))
        while len(waiting):
            at[waiting] += 1
            met, sought = self.spread[at[waiting]], spread[waiting]
            there[waiting] = met == sought
            waiting = waiting[(met < sought) & (at[waiting] < len(self) - 1)]
        return at, there

    def values(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first column's values, 0 where a key is not there, and whether it is there."""
        at, there = self.at(keys)
        return np.where(there, self.columns[0][at], 0.0) if len(self) else np.zeros(len(keys)), there


class Numbered:
    """Distinct words, and the number of each."""

    def __init__(self, words: pa.Array):
        self.words = words
        self.by_hash = Found(hashes(words), np.arange(len(words), dtype=np.int32))
        self.clash = bool((self.by_hash.spread[1:] == self.by_hash.spread[:-1]).any())

    def find(self, words: pa.Array, hashed: np.ndarray | None = None) -> np.ndarray:
        """The number of each word, -1 for others; `hashed` are the words' hashes where they are there already."""
        if self.clash:
            return pc.index_in(words, value_set=self.words).fill_null(-1).to_numpy().astype(np.int64)
        at, there = self.by_hash.at(hashes(words) if hashed is None else hashed)
        number, there = np.full(len(words), -1), np.flatnonzero(there)
        found = self.by_hash.columns[0][at[there]]
        same = pc.equal(words.take(pa.array(there)), self.words.take(pa.array(found))).to_numpy(zero_copy_only=False)
        number[there[same]] = found[same]
        return number


def _long(keys: np.ndarray) -> pa.Array:
    return pa.array(keys.view(np.int64))


def _keys(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy().view(np.uint64)


def _counted(held: list[tuple[np.ndarray, np.ndarray]]):
    """Rows of context, token, n of sequences; `held` is emptied."""
    numbers, others = [], []
    while held:
        context, token = held.pop()
        key = joined(context, token)
        common = key < _HASHED
        numbers.append(key[common])
        others.append((context[~common], token[~common], key[~common]))
    numbers = np.concatenate(numbers)
    numbers.sort()
    context, token, key = (np.concatenate(x) for x in zip(*others))
    del others
    order = np.argsort(key)
    key = key[order]
    for sequences in (numbers, key):
        first = np.flatnonzero(np.r_[True, sequences[1:] != sequences[:-1]][:len(sequences)])
        n = np.diff(np.r_[first, len(sequences)])
        for at in range(0, len(first), _HANDED):
            some = first[at:at + _HANDED]
            two = (context[order[some]], token[order[some]]) if sequences is key else (
                numbers[some] >> WORD_BITS, numbers[some] & (_WORDS - np.uint64(1)))
            yield pa.RecordBatch.from_arrays([_long(two[0]), _long(two[1]), pa.array(n[at:at + _HANDED])],
                                             names=["context", "token", "n"])


def _sequences(shipped, depth: int):
    """Counts of (context of `depth` tokens, next token) over texts, where both ends of the sequence can be known."""
    def run(batches):
        (known, common), held, size = shipped.value, [], 0
        for batch in batches:
            for _, words, ids, sizes in parts(batch):
                h, prev = common.keys(words), before(ids, sizes)
                if depth == 1:
                    here = known.has(h)
                    use = here[ids] & here[prev]
                    context, token = h[prev], h[ids]
                else:
                    one, token = joined(h[prev], h[ids]), h[ids]
                    here, context = known.has(one), np.r_[one[:1], one[:-1]]
                    use = here & np.r_[here[:1], here[:-1]]
                    use[np.cumsum(sizes) - sizes] = False  # a text's first token has only an end before it
                held.append((context[use], token[use]))
                size += int(use.sum())
                if size > GATHERED:
                    yield from _counted(held)
                    size = 0
        if held:
            yield from _counted(held)

    return run


def _looked_up(depth: int):
    """What rows of words are to be joined with: a common word's row is given any other key, so that no key has many."""
    def run(batches):
        for batch in batches:
            context, token = _keys(batch, "context"), _keys(batch, "token")
            key = joined(context, token)
            token_look = np.where(is_common(token), key, token)
            context_look = np.where(is_common(context), key, context) if depth == 1 else context
            yield pa.RecordBatch.from_arrays(
                [_long(key), *(batch.column(c) for c in ("context", "token", "n")), _long(token_look), _long(context_look)],
                names=["key", "context", "token", "n", "token_look", "context_look"])

    return run


def _expected(shipped, depth: int):
    """log10 of the chance that the byte contexts give to each next token; for two tokens, also the keys that the
    shorter context's values have, and those values that travel."""
    def run(batches):
        known = shipped.value
        tree = known.tree
        n_of, state_of, kind_of, alone_of = known.words
        for batch in batches:
            token, last = _keys(batch, "token"), _keys(batch, "last")

            def chosen(keys, column, own):
                there, out = is_common(keys), batch.column(column).fill_null(1).to_numpy().copy()
                out[there] = own[keys[there].astype(np.int64) - 1]
                return out

            common = is_common(token)
            at = token[common].astype(np.int64) - 1
            n = chosen(token, "token_n", n_of)
            kind, alone = np.full(len(token), tree.width - 2), np.full(len(token), known.class_log)
            kind[common], alone[common] = kind_of[at], alone_of[at]
            below = tree.score(chosen(last, "last_state", state_of).astype(np.int64), kind, alone)
            below[~common] += np.log10(n[~common] / known.others)
            total = chosen(last, "total", n_of) if depth == 1 else batch.column("total").to_numpy()
            state = chosen(token, "token_state", state_of).astype(np.int64)
            names = ["key", "context", "token", "n", "total", "state", "below"]
            out = [*(batch.column(c) for c in names[:4]), pa.array(total.astype(np.int64)), pa.array(state)]
            if depth > 1:
                for keys in (~last, joined(last, token)):
                    value, there = known.values.values(keys)
                    below += value
                    out.append(_long(np.where(there, _keys(batch, "key"), keys)))
                names = names[:6] + ["rest_look", "pair_look", "below"]
            yield pa.RecordBatch.from_arrays([*out, pa.array(below)], names=names)

    return run


def far_from_expected(n, expected):
    return F.abs(n - expected) > 3 * F.sqrt(expected + 1)


def fitted(rows: DataFrame, pseudo: float, least_divergence: float) -> DataFrame:
    """key, value, n of the contexts that pass the tests and of their kept next tokens. `rows` has key, context, n,
    total (of the context) and below, log10 of what the suffix expects."""
    below, n, total = F.pow(F.lit(10.0), "below"), F.col("n"), F.col("total")
    own = rows.filter(far_from_expected(n, total * below)).select(
        "key", "context", "n", "total", "below", ((n + pseudo * below) / (total + pseudo)).alias("chance"))
    left, left_below = (F.greatest(F.lit(1e-9), 1 - F.col(c)) for c in ("chances", "belows"))
    states = (own.groupBy("context")
              .agg(F.count("*").alias("k"), F.sum("chance").alias("chances"), F.sum(below).alias("belows"),
                   F.sum(F.col("chance") * (F.ln("chance") - F.col("below") * math.log(10))).alias("nats"),
                   F.first("total").alias("total"))
              .withColumn("nats", F.col("nats") + left * F.ln(left / left_below))
              .filter((F.col("nats") >= least_divergence)
                      & (F.col("nats") > (F.col("k") + 3 * F.sqrt(2 * F.col("k"))) / 2 / F.col("total")))
              .select("context", F.log10(left / left_below).alias("rest"), "total"))
    pairs = own.join(states.select("context", "rest"), "context").select(
        "key", (F.log10("chance") - F.col("below") - F.col("rest")).alias("value"), "n")
    return pairs.unionByName(states.select(F.bitwise_not("context").alias("key"), F.col("rest").alias("value"),
                                           F.col("total").alias("n")))


class Known:
    """What travels: the byte contexts, what is known of the common words by their numbers (count, state, symbol,
    chance), and the values that are common."""

    def __init__(self, tree, words: tuple[np.ndarray, ...], class_log: float, others: float):
        self.tree, self.words, self.class_log, self.others = tree, words, class_log, others
        self.values = Found(np.empty(0, np.uint64), np.empty(0))


def _travelling(values: DataFrame) -> tuple[Found, int, bool]:
    """The values that travel, the count from which they do, and whether these are all."""
    bins = values.groupBy(F.floor(8 * F.log2("n")).alias("bin")).agg(F.count("*").alias("rows"), F.min("n").alias("least")).collect()
    floor, room = 1 << 62, TRAVEL_MOST
    for r in sorted(bins, key=lambda r: -r["bin"]):
        room -= r["rows"]
        if room < 0:
            break
        floor = r["least"]
    rows = values.filter(F.col("n") >= floor).select("key", "value").toArrow()
    key, value = rows.column("key").to_numpy().view(np.uint64), rows.column("value").to_numpy()
    del rows
    found = Found(key, value)
    return found.travel_mapped(values.sparkSession), floor, room >= 0


def learn(texts: DataFrame, words: DataFrame, rare_below: int, known: Known, common, pseudo: float,
          least_divergence: float) -> tuple[DataFrame | None, list[Found], Filter]:
    """The values that do not travel as rows (key, value), if there are any, those that travel of contexts of one and of two
    tokens, and a filter of all keys. `words` has key, n, state of the training words; `common` gives words their keys."""
    spark, seldom = texts.sparkSession, None
    rare = words.filter(F.col("n") < rare_below)
    known_before, ones, values, travelling = words, None, None, []
    for depth in (1, 2):
        may = Shipped(spark, (Filter(known_before.select("key")), common))
        shipped = Shipped(spark, known)
        counts = (texts.mapInArrow(_sequences(may, depth), "context long, token long, n long")
                  .repartition("context", "token").groupBy("context", "token").agg(F.sum("n").alias("n"))
                  .filter(F.col("n") >= LEAST))
        rows = counts.mapInArrow(_looked_up(depth), "key long, context long, token long, n long, "
                                                             "token_look long, context_look long")
        rows = rows.join(rare.select(F.col("key").alias("token_look"), F.col("n").alias("token_n"),
                                     F.col("state").alias("token_state")), "token_look", "left")
        if depth == 1:
            rows = rows.join(rare.select(F.col("key").alias("context_look"), F.col("n").alias("total"),
                                         F.col("state").alias("last_state")), "context_look", "left")
            rows = rows.withColumn("last", F.col("context"))
        else:
            rows = rows.join(ones.select(F.col("key").alias("context_look"), F.col("n").alias("total"),
                                         F.col("token").alias("last"), F.col("state").alias("last_state")), "context_look")
        placed = rows.mapInArrow(
            _expected(shipped, depth), "key long, context long, token long, n long, total long, state long, "
            + "rest_look long, pair_look long, " * (depth > 1) + "below double")
        if depth == 1:
            placed = ones = known_before = written(placed, "sequences")
        else:
            for look in ("rest_look", "pair_look") if seldom is not None else ():
                placed = placed.join(seldom.select(F.col("key").alias(look), F.col("value").alias(f"{look}_value")), look, "left")
                placed = placed.withColumn("below", F.col("below") + F.coalesce(f"{look}_value", F.lit(0.0)))
            placed = written(placed, "sequences")
        found = written(fitted(placed, pseudo, least_divergence), "values")
        values = found if values is None else values.unionByName(found)
        known.values, floor, complete = _travelling(found)
        travelling.append(known.values)
        if not complete:
            left = found.filter(F.col("n") < floor).select("key", "value")
            seldom = left if seldom is None else seldom.unionByName(left)
        release(spark)
    return seldom, travelling, Filter(values.select("key"))


def score(h: np.ndarray, ids: np.ndarray, sizes: np.ndarray, travelling: list[Found], may: Filter, complete: bool):
    """The travelling values of each token's contexts, added up, and the places and keys of those that may be rows: none
    if `complete`, when all values travel."""
    prev = before(ids, sizes)
    one = joined(h[prev], h[ids])
    two_context, inner = np.r_[one[:1], one[:-1]], np.ones(len(ids), bool)
    inner[np.cumsum(sizes) - sizes] = False
    added, places, keys = np.zeros(len(ids)), [], []
    of_word, word_there = travelling[0].values(~h)  # a word is looked up once, not wherever it stands
    for values, context, pair, at in (
            (travelling[0], h[prev], one, np.flatnonzero(may.has(~h)[prev])),
            (travelling[1], two_context, joined(two_context, h[ids]), np.flatnonzero(inner))):
        for key in (~context, pair):  # a pair is known only if its context is
            if context is not two_context and key is not pair:
                value, there = of_word[prev[at]], word_there[prev[at]]
            else:
                at = at[may.has(key[at])]
                value, there = values.values(key[at])
            added[at] += value
            if complete:
                at = at[there]
            else:
                places.append(at[~there])
                keys.append(key[at[~there]])
    return added, np.concatenate([np.empty(0, np.int64), *places]), np.concatenate([np.empty(0, np.uint64), *keys])
