"""Byte-level BPE: encoding by folding ranked merges, decoding by concatenating binary pieces.

Documents are packed into blocks of bounded size, one row each: the block's distinct words as arrays of their
bytes' ids, each with the rank of joining it to the next, and for every document which words it is made of.
Spark's higher-order functions then fold the merges over each distinct word once, `aggregate` doing one merge
a step, and put the documents' ids together by position. No text is shuffled, and a task holds one block.
Words that are frequent in a bounded sample of the documents are folded first, once for all blocks, and their forms
(ids, packed ids, bytes) are read by every worker from the shared folder; this saves time only, as every other word is
folded in its block.

The rank map is a literal: the pairs of each left id as a row, and all rows laid over one another in one
array, built from the vocabulary alone, so that a lookup is two positions and not a search. A pair is in the
map if joining it is how its token is built from the lower ranks; as all merges of lower rank come first, no
other split of a token's bytes is ever the best. The map and the tokens' bytes are one literal row that is
broadcast to the blocks, not expressions of the plan: the driver makes texts of a plan again and again.

Defined results: a null or empty text has no ids and decodes to no bytes; null ids, repeated rows and other
columns do not matter to a text's ids; a text longer than a block is a block by itself; an empty table gives
an empty result.
"""

from __future__ import annotations

import base64
import sys
from itertools import chain
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import regex
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsentry.llm import pieces as cutting
from flowsentry.llm.common import Shipped, file_store, release, shared_folder, small_batches, whole_texts, written
from flowsentry.llm.token_contexts import Numbered, raw

register_pickle_by_value(sys.modules[__name__])

#: Characters of text in a block, unless one text is longer.
BLOCK_CHARS = 2_000_000
#: Documents in the sample whose words are folded first, and about how many of its words are remembered at most.
SAMPLE_DOCS, KNOWN_WORDS = 60_000, 600_000
#: Pieces that need no closer look: Latin letters with at most a space in front, then punctuation.
LETTERS = r"^(?P<stem> ?[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]+)(?P<end>[!-/:-@\[-`{-~]*)$"
_BITS = 17  # of an id
_ID = (1 << _BITS) - 1
_ALL = 2**30  # more parts than a string can have words or bytes in one block
_NONE = 1 << 2 * _BITS + 1  # above every rank << _BITS | id


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from a `.tiktoken` file."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    if max(ranks.values()) > _ID:
        raise ValueError(f"ranks above {_ID} do not fit")
    return ranks


def merges(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """(left id, right id) -> id for each token: the last two parts that lower ranks leave of its bytes."""
    found = {}
    for token, rank in ranks.items():
        parts = [token[i:i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = min((ranks.get(parts[i] + parts[i + 1], rank), i) for i in range(len(parts) - 1))
            if best >= rank:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2:
            found[ranks[parts[0]], ranks[parts[1]]] = rank
        elif len(parts) > 2:  # a token that lower ranks do not lead to: any split of it counts
            for i in range(1, len(token)):
                if token[:i] in ranks and token[i:] in ranks:
                    found[ranks[token[:i]], ranks[token[i:]]] = rank
    return found


def displaced(pairs: dict[tuple[int, int], int], width: int) -> tuple[list[int], list[int]]:
    """The pairs as rows laid over one another: the entry of (left, right) is at shift[left] + right and holds
    merged << _BITS | left, so that an entry of another row shows by its left id. `width` ids and one more,
    which is no part of any pair, can be looked up."""
    rows: dict[int, list[int]] = {}
    for left, right in pairs:
        rows.setdefault(left, []).append(right)
    room = max(3 * len(pairs), 64) | 1
    table, shift = np.full(room + width, -1, np.int64), np.zeros(width + 1, np.int64)
    for left, rights in sorted(rows.items(), key=lambda r: (-len(r[1]), r[0])):
        right, at = np.array(rights), left
        while (table[at + right] >= 0).any():  # the long rows come first, while there is most room
            at = (at + 8192) % room  # a power of two and an odd room: every place in turn
        shift[left] = at
        table[at + right] = [pairs[left, r] << _BITS | left for r in rights]
    return shift.tolist(), table.tolist()


def _once(value: Column, then) -> Column:
    """`then(value)` with the value computed once, not wherever it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _either(condition: Column, then: Column, otherwise: Column) -> Column:
    return F.call_function("if", condition, then, otherwise)


def _numbers(values: list[int]) -> Column:
    """A literal array; as text, as one literal per number would make a plan of as many nodes."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def fold_word(word: Column, shift: Column, table: Column) -> Column:
    """The ids of a word. The state has, for each part, the rank of joining it with the next one above the
    part's id, so that its least entry is the next merge, the leftmost of equals; in front of them is an entry
    that never merges, so that there is always a part before."""
    def joined(left: Column, right: Column) -> Column:
        entry = F.get(table, (F.get(shift, left.cast("int")) + right).cast("int"))
        return _either(entry.bitwiseAND(_ID) == left, entry, left.bitwiseOR(F.lit(_NONE)))

    def step(state, _):
        def merge(p):
            new = F.shiftright(F.get(state, p - 1), _BITS)
            # flatten puts arrays together faster than concat does
            return F.flatten(F.array(
                F.slice(state, F.lit(1), p - 2),
                F.array(joined(F.get(state, p - 2).bitwiseAND(_ID), new),
                        joined(new, F.get(state, p + 1).bitwiseAND(_ID))),
                F.slice(state, p + 2, F.lit(_ALL))))

        least = F.array_min(state)
        return _either(least >= _NONE, state, _once(F.array_position(state, least).cast("int"), merge))

    folded = _either(F.size(word) < 3, word, F.aggregate(F.sequence(F.lit(3), F.size(word)), word, step))
    return F.transform(F.slice(folded, F.lit(2), F.lit(_ALL)), lambda x: x.bitwiseAND(_ID))


class Packer:
    """Rows of the known words' `forms`, the other words and the documents, from batches of documents."""

    def __init__(self, pattern: str, ranks: dict[bytes, int], block_chars: int, known=None, forms: tuple[str, ...] = ()):
        self.known, self.forms = known, forms  # a broadcast of where words and their forms are
        self.pattern, self.block_chars, self.edge = regex.compile(pattern), block_chars, max(ranks.values()) + 1
        ids = [ranks[bytes([b])] for b in range(256)]
        #: the state's entry of a byte before another one, and at a word's end
        self.pairs = np.array([[ranks.get(bytes([a, b]), _NONE >> _BITS) << _BITS | ids[a] for b in range(256)]
                               for a in range(256)], np.int64)
        self.last = np.array(ids, np.int64) | _NONE

    def dealt(self, batches, chars: int):
        """Ids and texts of a block of `chars`."""
        ids, texts, size = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                if texts and size + len(text) > chars:
                    yield ids, texts
                    ids, texts, size = [], [], 0
                ids.append(doc_id)
                texts.append(text)
                size += len(text)
        if texts:
            yield ids, texts

    def blocks(self, batches):
        for ids, texts in self.dealt(batches, self.block_chars):
            yield self.pack(ids, texts)

    def pack(self, ids: list, texts: list[str]) -> pa.RecordBatch:
        rows = cutting.lists(texts)
        flat = rows.flatten().dictionary_encode()
        piece = flat.indices.to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(texts)), rows.value_lengths().to_numpy(zero_copy_only=False))
        used, length = self.words_of(flat.dictionary)  # the words of each distinct piece
        used = used.dictionary_encode()
        ready = self.known.value.find(used.dictionary)
        folded = ready >= 0
        # known words come first, then the others
        number = np.where(folded, np.cumsum(folded) - 1, folded.sum() + np.cumsum(~folded) - 1).astype(np.int32)
        numbers = number[used.indices.to_numpy(zero_copy_only=False)]
        first, count = (np.cumsum(length) - length)[piece], length[piece]
        ends = np.cumsum(count)
        at = numbers[np.arange(count.sum()) + np.repeat(first - (ends - count), count)]
        offsets = np.cumsum(np.r_[0, np.bincount(row, count, len(texts))]).astype(np.int32)
        starts, state = self.states(used.dictionary.take(pa.array(np.flatnonzero(~folded))))
        docs = pa.StructArray.from_arrays(
            [pa.array(ids, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(at))],
            names=["doc_id", "at"])
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        return pa.RecordBatch.from_arrays(
            [*(one(self.known.value.forms[f].take(pa.array(ready[folded]))) for f in self.forms),
             one(pa.ListArray.from_arrays(starts, pa.array(state))), one(docs)], names=[*self.forms, "words", "docs"])

    def words_of(self, pieces: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
        """The words of all pieces, one after another, and how many each has; an empty piece has none."""
        plain = pc.extract_regex(pieces, LETTERS)
        is_plain = plain.is_valid().to_numpy(zero_copy_only=False)
        end = plain.field("end")
        closed = is_plain & pc.fill_null(pc.not_equal(end, ""), False).to_numpy(zero_copy_only=False)
        odd = np.flatnonzero(~is_plain)
        others = [self.split(p) if p else [] for p in pieces.take(pa.array(odd)).to_pylist()]
        length = is_plain.astype(np.int64) + closed
        length[odd] = np.fromiter(map(len, others), np.int64, len(odd))
        first = np.cumsum(length) - length
        chosen = np.empty(int(length.sum()), np.int64)
        chosen[first[is_plain]] = np.flatnonzero(is_plain)
        chosen[first[closed] + 1] = len(pieces) + np.flatnonzero(closed)
        left = np.ones(len(chosen), bool)
        left[first[is_plain]] = left[first[closed] + 1] = False
        chosen[left] = 2 * len(pieces) + np.arange(left.sum())
        every = pa.concat_arrays([plain.field("stem"), end, pa.array(list(chain.from_iterable(others)), pa.string())])
        return every.take(pa.array(chosen)), length

    def split(self, piece: str) -> list[str]:
        """The pattern's matches in a piece: letters with at most a space in front are one, punctuation after
        letters is another; the pattern itself cuts everything else."""
        if piece[piece[0] == " ":].isalpha():
            return [piece]
        stem = piece.rstrip(punctuation)
        if stem and len(stem) < len(piece) and stem[stem[0] == " ":].isalpha():
            return [stem, piece[len(stem):]]
        return self.pattern.findall(piece)

    def counted(self, batches):
        """word, n of some blocks' texts."""
        for _, texts in self.dealt(batches, 2 * self.block_chars):
            flat = cutting.lists(texts).flatten().dictionary_encode()
            used, length = self.words_of(flat.dictionary)
            used, n = used.dictionary_encode(), np.repeat(np.bincount(
                flat.indices.to_numpy(zero_copy_only=False), minlength=len(flat.dictionary)), length)
            n = np.bincount(used.indices.to_numpy(zero_copy_only=False), n, len(used.dictionary)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([used.dictionary, pa.array(n)], names=["word", "n"])

    def stated(self, batches):
        """One row for a batch of words: the words and their first states."""
        for batch in batches:
            starts, state = self.states(batch.column("word"))
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            yield pa.RecordBatch.from_arrays(
                [one(batch.column("word")), one(pa.ListArray.from_arrays(starts, pa.array(state)))],
                names=["names", "words"])

    def states(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The folds' first states, one after another: an edge and an entry for each byte."""
        data, at = raw(words)
        sizes, data = np.diff(at), data[at[0]:at[-1]]
        starts = np.cumsum(np.r_[0, sizes + 1]).astype(np.int32)
        entry = self.pairs[data, np.r_[data[1:], np.uint8(0)]] if len(data) else self.last[:0]
        ends = np.cumsum(sizes) - 1
        entry[ends] = self.last[data[ends]]
        state = np.full(int(starts[-1]), self.edge | _NONE, np.int64)
        inner = np.ones(len(state), bool)
        inner[starts[:-1]] = False
        state[inner] = entry
        return starts, state


#: What can be put together for a text from its words: the ids, the ids as little-endian unsigned 32-bit
#: integers, and the bytes that the ids decode to.
FORMS = ("ids", "packed", "bytes")


def encode(df: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text",
           forms: tuple[str, ...] = ("ids",), block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id and the `forms` of every row: ids (array of long), packed and bytes (binary).

    The binary forms are made once for each distinct word from its ids and then concatenated.
    """
    _short_plans(df.sparkSession)
    small_batches(df.sparkSession)
    release(df.sparkSession)
    texts = whole_texts(df, id_col, text_col)
    maps = F.broadcast(_map_row(df.sparkSession, ranks))
    folded = _once(F.col("shifts"), lambda shifts: _once(F.col("entries"), lambda entries: F.transform(
        "words", lambda w: fold_word(w, shifts, entries))))
    made = {"ids": lambda ids: ids,
            "packed": lambda ids: _once(F.col("numbers"), lambda every: F.transform(
                ids, lambda w: _packed(w, every).cast("string"))),
            "bytes": lambda ids: _once(F.col("starts"), lambda starts: _once(F.col("tokens"), lambda every: F.transform(
                ids, lambda w: _unpacked(w, starts, every).cast("string"))))}

    def of_words(ids: Column, left: tuple[str, ...], have: dict[str, Column], then) -> Column:
        if left:  # bind the words' next form, then go on
            form = made[left[0]](ids)
            return _once(F.concat(before[left[0]], form) if before else form,
                         lambda x: of_words(ids, left[1:], have | {left[0]: x}, then))
        return then(have)

    before = {}
    known = Shipped(df.sparkSession, _known_words(texts, Packer(pattern, ranks, block_chars), forms, maps, lambda then: _once(
        folded, lambda ids: of_words(ids, tuple(forms), {}, then))))
    packer = Packer(pattern, ranks, block_chars, known, tuple(forms))
    kinds = {"ids": "array<array<bigint>>", "packed": "array<binary>", "bytes": "array<binary>"}
    blocks = texts.mapInArrow(
        lambda batches: packer.blocks(batches), ", ".join(f"{f} {kinds[f]}" for f in forms)
        + ", words array<array<bigint>>, docs array<struct<doc_id: bigint, at: array<int>>>")
    before = {f: F.col(f) if f == "ids" else F.col(f).cast("array<string>") for f in forms}

    def together(words: Column, form: str, at: Column) -> Column:
        parts = F.transform(at, lambda i: F.get(words, i))
        return F.flatten(parts) if form == "ids" else F.array_join(parts, "").cast("binary")

    def rows(have: dict[str, Column]) -> Column:
        return F.transform("docs", lambda d: F.struct(
            d["doc_id"].alias("doc_id"), *[together(have[f], f, d["at"]).alias(f) for f in forms]))

    return blocks.crossJoin(maps).select(F.inline(_once(folded, lambda ids: of_words(ids, tuple(forms), {}, rows))))


def _map_row(spark, ranks: dict[bytes, int]) -> DataFrame:
    """One row: the rank map, and what the ids' forms are made of."""
    width = max(ranks.values()) + 1
    shifts, entries = displaced(merges(ranks), width)
    starts, tokens = _token_bytes(ranks)
    lists = {k: pa.array([v], pa.list_(pa.int64())) for k, v in (("shifts", shifts), ("entries", entries), ("starts", starts))}
    return spark.createDataFrame(pa.table(lists | {"tokens": pa.array([tokens]), "numbers": pa.array([_every_id(width)])}))


def _short_plans(spark) -> None:
    """The driver keeps the texts of plans; they are cut where the session has set no length of its own."""
    if int(spark.conf.get("spark.sql.maxPlanStringLength").rstrip("b")) > 1 << 30:
        spark.conf.set("spark.sql.maxPlanStringLength", 1 << 16)


def _known_words(texts: DataFrame, packer: Packer, forms: tuple[str, ...], maps: DataFrame,
                 with_forms) -> KnownWords:
    """The forms of the most frequent words in the sample. The sample's size is what it is expected to be, by the
    hashes of the ids; `KNOWN_WORDS` bounds their number, by the hashes of those words that are just frequent enough."""
    spark = texts.sparkSession
    share = max(1, texts.count() // SAMPLE_DOCS)
    sample = texts.filter(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0)
    counts = written(sample.mapInArrow(lambda batches: packer.counted(batches), "word string, n long")
                     .groupBy("word").agg(F.sum("n").alias("n")), "sample-words")
    frequency = F.floor(8 * F.log2("n"))
    room, taken = KNOWN_WORDS, F.lit(False)
    for r in sorted(counts.groupBy(frequency.alias("at")).count().collect(), key=lambda r: -r["at"]):
        places = F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < int(min(1, room / r["count"]) * (1 << 20))
        if r["count"] >= room:
            taken = (frequency > r["at"]) | (frequency == r["at"]) & places
            break
        room -= r["count"]
        taken = F.lit(True)

    def one_row(have: dict[str, Column]) -> Column:
        return F.struct(F.col("names").alias("names"), *[
            (have[f] if f == "ids" else have[f].cast("array<binary>")).alias(f) for f in forms])

    folder = shared_folder(spark, "known-words")
    (counts.filter(taken).select("word").repartition(spark.sparkContext.defaultParallelism, "word")
     .mapInArrow(lambda batches: packer.stated(batches), "names array<string>, words array<array<bigint>>")
     .crossJoin(maps).select(F.inline(F.array(with_forms(one_row)))).write.parquet(folder))
    release(spark)
    return KnownWords(folder)


class KnownWords:
    """Words and their forms in a folder. What travels is its address; a worker reads it once."""

    def __init__(self, folder: str):
        self.folder, self.held = folder, None

    def __getstate__(self):
        return {"folder": self.folder, "held": None}

    def _read(self) -> tuple[Numbered, dict[str, pa.Array]]:
        if self.held is None:
            store, path = file_store(self.folder)
            table = pq.read_table(path, filesystem=store, use_threads=False)

            def column(name):
                parts = [c.flatten() for c in table.column(name).chunks]
                return pa.concat_arrays(parts) if parts else pa.array([], table.schema.field(name).type.value_type)

            self.held = Numbered(column("names")), {f: column(f) for f in table.column_names if f != "names"}
            del table
            pa.default_memory_pool().release_unused()
        return self.held

    @property
    def names(self) -> pa.Array:
        return self._read()[0].words

    @property
    def forms(self) -> dict[str, pa.Array]:
        return self._read()[1]

    def find(self, words: pa.Array) -> np.ndarray:
        """Where each word's forms are, -1 for words that are not known."""
        return self._read()[0].find(words)


def _pieces_of(ids: Column, every: Column, start, size) -> Column:
    """The pieces of one long binary for each id, one after another."""
    # the string type only carries the bytes: neither this cast nor the join looks at them
    return F.array_join(F.transform(ids, lambda i: F.substr(every, start(i), size(i)).cast("string")), "").cast("binary")


def _token_bytes(ranks: dict[bytes, int]) -> tuple[list[int], bytes]:
    """Where each id's bytes start, from 1 on, and all of them."""
    by_rank = {r: t for t, r in ranks.items()}
    tokens = [by_rank.get(i, b"") for i in range(max(by_rank) + 1)]
    return [1, *(1 + np.cumsum([len(t) for t in tokens])).tolist()], b"".join(tokens)


def _unpacked(ids: Column, starts: Column, tokens: Column) -> Column:
    def start(i):
        return F.get(starts, i.cast("int")).cast("int")

    return _pieces_of(ids, tokens, start, lambda i: start(i + 1) - start(i))


def decoded(ids: Column, ranks: dict[bytes, int]) -> Column:
    """The ids' pieces one after another. An id outside the vocabulary gives no bytes; null ids give null."""
    starts, tokens = _token_bytes(ranks)
    return _unpacked(ids, _numbers(starts), F.lit(bytearray(tokens)))


def decode(df: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids", out: str = "bytes") -> DataFrame:
    """`df` with the bytes that its ids decode to."""
    return df.withColumn(out, decoded(F.col(ids_col), ranks))


def _every_id(width: int) -> bytes:
    """Ids below `width` as little-endian unsigned 32-bit integers, one after another."""
    return np.arange(width, dtype="<u4").tobytes()


def _packed(ids: Column, every: Column) -> Column:
    return _pieces_of(ids, every, lambda i: (i * 4 + 1).cast("int"), lambda i: F.lit(4))


def little_endian(ids: Column, width: int) -> Column:
    """Ids below `width` as little-endian unsigned 32-bit integers."""
    return _packed(ids, F.lit(bytearray(_every_id(width))))
