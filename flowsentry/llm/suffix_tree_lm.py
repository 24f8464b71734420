"""Language-model scoring by a probabilistic suffix tree.

A text is its words, ASCII letters in lower case, and one end. Its symbols are tokens. As in the base score, all
words that training has not met are one unknown word; it has the share of the words met once. A token's contexts
are, from long to short, the two tokens before it, the one before it, and that one's last bytes.

A context becomes a state if its kept next tokens, those whose count is further from what the suffix state expects
than chance allows, make it diverge from its longest suffix state by `LEAST_DIVERGENCE` nats and by more than
chance. Kept chances are smoothed with the suffix state's, as if that had been seen `PSEUDO` times more; the other
tokens share what is left as they do in the suffix state, down to the counts of the tokens alone. Scoring takes
for every token the longest context that is a state.

Contexts of whole tokens are judged by their counts, not by their share, so they grow with the corpus: they and
their next tokens are rows, see token_contexts.py. Below them stands a small tree that travels: contexts of up to
`TAIL` bytes with a share of `CONTEXT_SHARE` or more, at most 1 / `CONTEXT_SHARE` at each length, and next
tokens that are common words or the class of all others, whose members are told apart by their counts. It is what
the rows of a rare context fall back to; its shares bound what travels, not what is learned of a token's context.

The count of every word is needed. Common words (at most 1 / `COMMON_SHARE`) travel to the executors; the others
are joined with the counts as rows.

Defined results: a null or empty text is one end; a null id counts as the empty text for the split; repeated
rows count as often as they stand there and have equal scores; with no training text counts are 0 and every
token is the unknown word for certain; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsentry.llm import token_contexts
from flowsentry.llm.common import Shipped, crc_of_id, release, small_batches, whole_texts, written
from flowsentry.llm.token_contexts import Found, Numbered, before, hashes, parts, raw

register_pickle_by_value(sys.modules[__name__])

COMMON_SHARE = 1e-6
TAIL, CONTEXT_SHARE = 6, 2e-3
#: Words of this share are counted in pairs with byte contexts; pairs of this share are kept.
PAIR_SHARE, PAIR_KEPT = 2e-5, 1e-6
LEAST_DIVERGENCE = 0.01
PSEUDO = 20.0
#: Distinct words, or pairs, that a task gathers before it hands their counts on.
GATHERED = 300_000
_PAIRS = 3_000_000


def count_tokens(texts: DataFrame) -> DataFrame:
    """word, n over all rows of doc_id, text; the empty word counts the ends."""
    def run(batches):
        held, size = [], 0

        def rows():
            found = pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")]).combine_chunks()
            return pa.table({"word": found.column("word"), "n": found.column("n_sum")})

        for batch in batches:
            for _, words, ids, _ in parts(batch):
                held.append(pa.table({"word": words, "n": pa.array(np.bincount(ids, minlength=len(words)).astype(np.int64))}))
                size += len(words)
                if size > 3 * GATHERED:
                    held = [rows()]
                    size = held[0].num_rows
                    if size > GATHERED:
                        yield from held[0].to_batches()
                        held, size = [], 0
        if held:
            yield from rows().to_batches()

    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter("n > 0")


def tails(words: pa.Array):
    """For each length the last bytes of the space and the token, as a number, and which tokens have as many."""
    data, ends = raw(words)
    sizes, ends = np.diff(ends), ends[1:]
    empty = sizes == 0  # the end: a space and a line end
    value = np.zeros(len(words), np.uint64)
    for d in range(1, TAIL + 1):
        byte = np.where(d <= sizes, data[np.clip(ends - d, 0, len(data) - 1)], np.uint8(32))
        if d == 1:
            byte = np.where(empty, np.uint8(10), byte)
        value = value | byte.astype(np.uint64) << np.uint64(8 * (d - 1))
        yield d, value, d <= sizes + 1 + empty


class Common(Numbered):
    """The words that travel, and how often each occurs."""

    def __init__(self, words: pa.Array, n: np.ndarray):
        super().__init__(words)
        self.n = n

    def keys(self, words: pa.Array) -> np.ndarray:
        """What sequences know words by: numbers from 1 on of those that travel, hashes of others."""
        return self.numbers_and_keys(words)[1]

    def numbers_and_keys(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        hashed = hashes(words)
        number = self.find(words, hashed)
        return number, np.where(number >= 0, (number + 1).astype(np.uint64), hashed)

    def counts(self, number: np.ndarray) -> np.ndarray:
        return np.r_[self.n, 0][number]


class States:
    """Contexts with numbers from 1 on, shorter ones first; 0 is the empty context."""

    def __init__(self, by_depth: dict[int, np.ndarray]):
        self.by_depth, self.first, count = by_depth, {}, 1
        for d in range(1, TAIL + 1):
            self.first[d] = count
            count += len(by_depth[d])
        self.parent = np.zeros(count, np.int64)
        for d in range(2, TAIL + 1):
            known = by_depth[d]
            self.parent[self.first[d]:self.first[d] + len(known)] = self._find(
                ((e, known & np.uint64((1 << 8 * e) - 1), np.ones(len(known), bool)) for e in range(1, d)), len(known))

    def _find(self, values, n: int) -> np.ndarray:
        state = np.zeros(n, np.int64)
        for d, value, long_enough in values:
            known = self.by_depth[d]
            if len(known) and n:
                at = np.minimum(np.searchsorted(known, value), len(known) - 1)
                found = (known[at] == value) & long_enough
                state[found] = self.first[d] + at[found]
        return state

    def after(self, words: pa.Array) -> np.ndarray:
        """The longest context that each token leaves behind."""
        return self._find(tails(words), len(words))


def _tail_counts(batches):
    for batch in batches:
        words, n = batch.column("word"), batch.column("n").to_numpy()
        for d, value, long_enough in tails(words):
            found, where = np.unique(value[long_enough], return_inverse=True)
            total = np.zeros(len(found), np.int64)
            np.add.at(total, where, n[long_enough])
            yield pa.RecordBatch.from_arrays(
                [pa.array([d] * len(found), pa.int32()), pa.array(found.view(np.int64)), pa.array(total)],
                names=["depth", "context", "n"])


class TokenTree:
    """The states that passed the tests, the chances of their kept pairs, and what they leave to their suffix."""

    def __init__(self, states: States, symbol: np.ndarray, width: int):
        self.states, self.width = states, width      # width: paired words, the class of the others, and the rest
        self.symbol = np.r_[symbol, width - 2]       # of each common word, -1 if it is in no pair; then of others
        self.rest = np.zeros(len(states.parent))     # log10 of what the suffix state's chances are multiplied by
        self.parent = states.parent.copy()
        self.pairs = Found(np.empty(0, np.uint64), np.empty(0))

    def fit(self, root: np.ndarray, state: np.ndarray, symbol: np.ndarray, n: np.ndarray, total: np.ndarray) -> None:
        """`root` has the chances of the paired words and of the class; the pairs are of all candidate states."""
        kept, retained = {}, np.zeros(len(total), bool)
        order = np.lexsort((symbol, state))
        state, symbol, n = state[order], symbol[order], n[order]
        cuts = np.searchsorted(state, np.arange(len(total) + 1))
        whole = {0: root}  # distributions over the symbols of states that others may lean on
        for s in range(1, len(total)):
            parent = int(self.states.parent[s])
            while parent and not retained[parent]:
                parent = int(self.states.parent[parent])
            self.parent[s] = parent
            here = slice(cuts[s], cuts[s + 1])
            if total[s] == 0 or cuts[s] == cuts[s + 1]:
                continue
            below = whole[parent]
            expected = total[s] * below[symbol[here]]
            far = np.abs(n[here] - expected) > 3 * np.sqrt(expected + 1)
            own, seen = symbol[here][far], n[here][far]
            if not len(own):
                continue
            chance = (seen + PSEUDO * below[own]) / (total[s] + PSEUDO)
            left, left_below = max(1e-9, 1 - chance.sum()), max(1e-9, 1 - below[own].sum())
            nats = float((chance * np.log(chance / below[own])).sum() + left * math.log(left / left_below))
            if nats < LEAST_DIVERGENCE or nats <= (len(own) + 3 * math.sqrt(2 * len(own))) / 2 / total[s]:
                continue
            retained[s] = True
            whole[s] = below * (left / left_below)
            whole[s][own], self.rest[s] = chance, math.log10(left / left_below)
            kept[s] = (s * self.width + own, chance)
        # a context that is no state stands for its longest suffix that is one
        self.home = np.arange(len(total))
        for s in range(1, len(total)):
            if not retained[s]:
                self.home[s] = self.parent[s]
        if kept:
            self.pairs = Found(np.concatenate([k for k, _ in kept.values()]).view(np.uint64),
                               np.log10(np.concatenate([c for _, c in kept.values()])))

    @property
    def keys(self) -> np.ndarray:
        return self.pairs.spread

    def score(self, state: np.ndarray, symbol: np.ndarray, alone: np.ndarray) -> np.ndarray:
        """log10 chance of each token after its context; `alone` is the one without context, and symbol -1 is in no
        pair. For a word that is not common both are those of the class."""
        out, state = np.zeros(len(state)), self.home[state]
        waiting = np.arange(len(state))
        while len(waiting):
            s, x = state[waiting], symbol[waiting]
            done = s == 0
            out[waiting[done]] += alone[waiting[done]]
            waiting, s, x = waiting[~done], s[~done], x[~done]
            if not len(waiting):
                break
            chances, found = self.pairs.values((s * self.width + x).view(np.uint64))
            found &= x >= 0
            out[waiting[found]] += chances[found]
            out[waiting[~found]] += self.rest[s[~found]]
            state[waiting[~found]] = self.parent[s[~found]]
            waiting = waiting[~found]
        return out


def train_tokens(texts: DataFrame, vocabulary: DataFrame, total: int, common: Common, others: float,
                 unknown: int) -> TokenTree:
    """The tree of byte contexts from training texts; `others` are the tokens of all words that are not common, and
    `unknown` is what the unknown word counts as."""
    spark = texts.sparkSession
    tail_rows = (vocabulary.mapInArrow(_tail_counts, "depth int, context long, n long").groupBy("depth", "context")
                 .agg(F.sum("n").alias("n")).filter(F.col("n") >= max(2, CONTEXT_SHARE * total))
                 .collect())  # at most TAIL / CONTEXT_SHARE rows
    states = States({d: np.sort(np.array([r["context"] for r in tail_rows if r["depth"] == d], np.int64).view(np.uint64))
                     for d in range(1, TAIL + 1)})
    paired = np.flatnonzero(common.n >= PAIR_SHARE * total)
    symbol = np.full(len(common.n), -1, np.int64)
    symbol[paired] = np.arange(len(paired))
    tree = TokenTree(states, symbol, len(paired) + 2)
    shipped = Shipped(spark, (states, tree.symbol, common, tree.width))
    pairs = (texts.mapInArrow(_pair_counts(shipped), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
             .mapInArrow(_with_suffixes(shipped), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")))
    pairs = written(pairs, "pairs")
    sums = {r["state"]: r["n"] for r in pairs.groupBy(F.expr(f"key div {tree.width}").alias("state"))
            .agg(F.sum("n").alias("n")).collect()}
    kept = pairs.filter((F.col("n") >= max(2, PAIR_KEPT * total)) & (F.col("key") % tree.width != tree.width - 1)
                        ).toArrow()  # at most (TAIL + 1) / PAIR_KEPT rows
    key, n = kept.column("key").to_numpy(), kept.column("n").to_numpy()
    root = np.r_[common.n[paired], others + unknown, 0.0] / (total + unknown)
    root = np.maximum(root, 1e-12)
    every = np.array([sums.get(s, 0) for s in range(len(states.parent))], np.int64)
    tree.fit(root, key // tree.width, key % tree.width, n, every)
    return tree


def _pair_counts(shipped):
    """Counts of (longest context, next symbol) over texts."""
    def run(batches):
        states, symbol, common, width = shipped.value
        keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            for _, words, ids, sizes in parts(batch):
                kind = symbol[common.find(words)]
                kind[kind < 0] = width - 1
                key = states.after(words)[before(ids, sizes)] * width + kind[ids]
                new, n = np.unique(key, return_counts=True)
                keys, where = np.unique(np.concatenate([keys, new]), return_inverse=True)
                counts = np.bincount(where, np.concatenate([counts, n]), len(keys)).astype(np.int64)
                if len(keys) > _PAIRS:
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["key", "n"])
                    keys, counts = keys[:0], counts[:0]
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["key", "n"])

    return run


def _with_suffixes(shipped):
    """Each pair also counts for every shorter context."""
    def run(batches):
        states, _, _, width = shipped.value
        for batch in batches:
            key, n = batch.column("key").to_numpy(), batch.column("n").to_numpy()
            state, symbol = key // width, key % width
            while True:
                yield pa.RecordBatch.from_arrays([pa.array(state * width + symbol), pa.array(n)], names=["key", "n"])
                up = state > 0
                if not up.any():
                    break
                state, symbol, n = states.parent[state[up]], symbol[up], n[up]

    return run


def _hashed(shipped):
    """key, n, state of words."""
    def run(batches):
        for batch in batches:
            words, (tree, common) = batch.column("word"), shipped.value
            yield pa.RecordBatch.from_arrays(
                [pa.array(common.keys(words).view(np.int64)), batch.column("n"), pa.array(tree.states.after(words))],
                names=["key", "n", "state"])

    return run


def score_texts(df: DataFrame, learns: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row; `learns` is a condition on doc_id."""
    small_batches(df.sparkSession)
    texts = whole_texts(df, id_col, text_col)
    vocabulary = written(count_tokens(texts.filter(learns)), "vocabulary")
    total, distinct, once = vocabulary.agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.count(F.when(F.col("n") == 1, 1))).first()
    floor = max(1, math.ceil(COMMON_SHARE * total))
    found = vocabulary.filter(F.col("n") >= floor).toArrow().combine_chunks()  # at most 1 / COMMON_SHARE rows
    common = Common(pa.concat_arrays([pa.array([], pa.string()), *found.column("word").chunks]), found.column("n").to_numpy())
    others = total - int(common.n.sum())
    unknown = max(1, once)
    tree = train_tokens(texts.filter(learns), vocabulary, total, common, others, unknown)
    # what is known of common words: alone is their chance without a context
    alone = np.log10(common.n / (total + unknown))
    of_common = common.n, tree.states.after(common.words), tree.symbol[:-1], alone
    known = token_contexts.Known(tree, of_common, math.log10((others + unknown) / (total + unknown)), others + unknown)
    release(df.sparkSession)
    words = vocabulary.filter(F.col("n") >= token_contexts.LEAST).mapInArrow(
        _hashed(Shipped(df.sparkSession, (tree, common))), "key long, n long, state long")
    seldom, travelling, may = token_contexts.learn(
        texts.filter(learns), words, floor, known, common, PSEUDO, LEAST_DIVERGENCE)
    shipped = Shipped(df.sparkSession, (tree, common, alone, known.class_log, travelling, may, seldom is None))
    scored = written(texts.mapInArrow(
        _scoring(shipped), "row long, doc_id long, n_tokens long, n_common long, base double, score double, "
                           "rare array<struct<word: string, n: long>>, deep array<long>"), "scored")
    rare_words = vocabulary.filter(F.col("n") < floor).select("word", F.col("n").alias("c"))
    counted = (scored.select("row", F.inline("rare")).join(rare_words, "word").groupBy("row")
               .agg(F.sum("n").alias("n_rare"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("gain"),
                    F.sum(F.col("n") * F.log10("c")).alias("within")))
    if seldom is not None:
        deeper = (scored.select("row", F.explode("deep").alias("key")).join(seldom, "key")
                  .groupBy("row").agg(F.sum("value").alias("deeper")))
        scored = scored.join(deeper, "row", "left")
    else:
        scored = scored.withColumn("deeper", F.lit(0.0))
    n_rare, gain, within, deep = (F.coalesce(F.col(c), F.lit(0)) for c in ("n_rare", "gain", "within", "deeper"))
    strange = F.col("n_tokens") - F.col("n_common") - n_rare
    return scored.join(counted, "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_common") + n_rare).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + gain - F.col("n_tokens") * math.log10(total + distinct + 1)).alias("base_score"),
        # inside the class: a word by its count, the unknown word by its share
        (F.col("score") + deep + within - n_rare * math.log10(others + unknown)
         + strange * math.log10(unknown / (others + unknown))).alias("score"))


def _scoring(shipped):
    def run(batches):
        tree, common, alone_of, class_log, travelling, may, complete = shipped.value
        row = TaskContext.get().partitionId() << 40
        alone_of = np.r_[alone_of, class_log]
        for batch in batches:
            for part, words, ids, sizes in parts(batch):
                number, keys = common.numbers_and_keys(words)
                is_common, gain = number >= 0, np.log10(common.counts(number) + 1.0)
                doc = np.repeat(np.arange(len(sizes)), sizes)
                log = tree.score(tree.states.after(words)[before(ids, sizes)], tree.symbol[number][ids], alone_of[number][ids])
                added, at, deep = token_contexts.score(keys, ids, sizes, travelling, may, complete)
                order = np.argsort(at, kind="stable")
                deep_ends = np.r_[0, np.cumsum(np.bincount(doc[at], minlength=len(sizes)))].astype(np.int32)
                rare = ~is_common[ids]
                pair, n = np.unique(doc[rare] * len(words) + ids[rare], return_counts=True)
                ends = np.cumsum(np.r_[0, np.bincount(pair // len(words), minlength=len(sizes))]).astype(np.int32)
                entries = pa.StructArray.from_arrays(
                    [words.take(pa.array(pair % len(words))), pa.array(n.astype(np.int64))], names=["word", "n"])
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.arange(row, row + part.num_rows)), part.column("doc_id"), pa.array(sizes),
                    pa.array(np.bincount(doc, is_common[ids], len(sizes)).astype(np.int64)),
                    pa.array(np.bincount(doc, gain[ids], len(sizes))),
                    pa.array(np.bincount(doc, log + added, len(sizes))), pa.ListArray.from_arrays(ends, entries),
                    pa.ListArray.from_arrays(deep_ends, pa.array(deep[order].view(np.int64)))],
                    names=["row", "doc_id", "n_tokens", "n_common", "base", "score", "rare", "deep"])
                row += part.num_rows

    return run


def held_out(doc_id: Column) -> Column:
    return crc_of_id(doc_id) % 7 == 2
