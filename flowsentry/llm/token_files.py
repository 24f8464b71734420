"""Token ids in flat binary files with 64-bit document offsets.

A folder holds, for each part p in ascending order of ids:

* `p.ids`      the ids of its documents one after another, little-endian unsigned 16-bit where the vocabulary
  fits, else 32-bit;
* `p.docs`     the documents' ids, little-endian signed 64-bit; `nulls` of them at the front have none;
* `p.offsets`  little-endian unsigned 64-bit: where each document starts, counted in ids over the whole
  folder, and where the last one ends;
* `manifest`   Parquet: part, base (ids in all earlier parts), n_tokens, n_docs, nulls, width.

Texts are dealt to parts by ranges of (doc_id, text hash), so that a repeated id can be split, and sorted
inside a part. A task writes its files under a name of its own and renames them, so a repeated task leaves
the same files. Bases are the prefix sums of the parts' totals, one row per part; the offsets are written
once the bases are known. Files are read by memory mapping where the folder is a mounted one.

Defined results: a null or empty text is the end id alone; null ids come first; rows with equal ids are
ordered by text hash, then text; repeated rows are repeated documents; an empty table gives no files and an
empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from string import punctuation
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowsentry.llm import pieces as cutting
from flowsentry.llm.common import whole_texts, written

register_pickle_by_value(sys.modules[__name__])

#: Distinct pieces a worker remembers before it starts anew.
REMEMBERED = 1_000_000
#: How byte-level vocabularies show bytes: printable ones as themselves, the others from U+0100 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SHOWN = {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(_PRINTED)))}
_COUNTS = "part int, n_tokens long, n_docs long, nulls long"


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", folder))


def _put(folder: str, name: str, blocks) -> None:
    """Write `blocks` to a name of this attempt, then give the file its own name."""
    store, path = _store(folder)
    store.create_dir(path, recursive=True)
    attempt = TaskContext.get().taskAttemptId()
    with store.open_output_stream(f"{path}/.{name}-{attempt}") as out:
        for b in blocks:
            out.write(b)
    store.move(f"{path}/.{name}-{attempt}", f"{path}/{name}")


def _get(folder: str, name: str, dtype: str) -> np.ndarray:
    store, path = _store(folder)
    file = f"{path}/{name}"
    if store.get_file_info(file).size == 0:
        return np.empty(0, dtype)
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(file, dtype, "r")
    with store.open_input_file(file) as f:
        return np.frombuffer(f.read(), dtype)


class _Known(dict):
    """Ids of words behind a fixed prefix, learned when they are first asked for."""

    def __init__(self, learn, prefix: str):
        self.learn, self.prefix = learn, prefix

    def __missing__(self, word: str) -> bytes:
        found = self[word] = self.learn(self.prefix + word)
        return found


class Encoder:
    """Ids of texts as bytes; every distinct word goes to the tokenizers library once.

    The bytes are in the machine's order, which is little-endian wherever Spark runs its JVM and Arrow.

    A piece that ends in punctuation after a letter is cut once more, since no match goes on from a letter to
    something else. What is then letters with at most a space in front is one match of the pattern and goes
    straight to the library's BPE model; all else goes through its whole pipeline. So does a text that holds one of
    the tokenizer's added tokens, which the library looks for before its pattern cuts.
    """

    def __init__(self, tokenizer: str, dtype: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(tokenizer)
        added = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)) or "(?!)")
        self.dtype = {2: "H", 4: "I"}[np.dtype(dtype).itemsize]
        self.first, self.spaced = _Known(self._learn, ""), _Known(self._learn, " ")

    def __call__(self, text: str) -> bytes:
        if len(self.first) + len(self.spaced) > REMEMBERED:
            self.first.clear()
            self.spaced.clear()
        if self.added.search(text):
            return self._whole(text)
        if cutting.TWO_SPACES.search(text):
            return b"".join(map(self.first.__getitem__, cutting.pieces(text)))
        # the same pieces, without putting the space before each word
        spaced, lines = self.spaced.__getitem__, []
        for line in text.split("\n"):
            head, *rest = line.split(" ")
            lines.append(self.first[head] + b"".join(map(spaced, rest)))
        return self.first["\n"].join(lines)

    def _whole(self, text: str) -> bytes:
        return array(self.dtype, self.model.encode(text, add_special_tokens=False).ids).tobytes()

    def _learn(self, piece: str) -> bytes:
        stem = piece.rstrip(punctuation)
        if len(stem) < len(piece) and stem and stem[-1].isalpha():
            known = self.spaced[stem[1:]] if stem[0] == " " else self.first[stem]
            return known + self.first[piece[len(stem):]]
        word = piece[1:] if piece[:1] == " " else piece
        if word.isalpha():  # one match of the pattern: the library's model takes it as it is
            text = piece.replace(" ", "\u0120") if piece.isascii() else piece.encode().decode("latin-1").translate(_SHOWN)
            return array(self.dtype, [t.id for t in self.model.model.tokenize(text)]).tobytes()
        return self._whole(piece)


def _encoder(tokenizer: str, dtype: str) -> Encoder:
    """The encoder of this worker process: the words that one task has learned serve those after it."""
    kept = sys.modules.setdefault("_token_encoders", ModuleType("_token_encoders")).__dict__
    key = f"{tokenizer} {dtype}"
    if key not in kept:
        kept[key] = Encoder(tokenizer, dtype)
    return kept[key]


def write_token_files(df: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """Write the folder; returns its manifest."""
    from tokenizers import Tokenizer

    width = 2 if max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    dtype = f"<u{width}"

    def save(batches):
        part = TaskContext.get().partitionId()
        encode, lengths, docs, nulls = _encoder(tokenizer, dtype), [], [], 0
        end = np.array([end_id], dtype).tobytes()

        def blocks():
            nonlocal nulls
            for batch in batches:
                texts, ids = batch.column("text"), batch.column("doc_id")
                nulls += ids.null_count
                docs.append(ids.fill_null(0).to_numpy(zero_copy_only=False))
                for at in range(0, len(texts), 500):
                    for row in map(encode, texts.slice(at, 500).to_pylist()):
                        lengths.append(len(row) // width + 1)
                        yield row + end

        _put(folder, f"{part:07d}.ids", blocks())
        _put(folder, f"{part:07d}.docs", [np.concatenate([np.empty(0, np.int64), *docs]).astype("<i8").tobytes()])
        _put(folder, f"{part:07d}.lengths", [np.array(lengths, "<u8").tobytes()])
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([part], pa.int32()), "n_tokens": [sum(lengths)], "n_docs": [len(lengths)],
            "nulls": [nulls]})

    dealt = (whole_texts(df, id_col, text_col).withColumn("h", F.xxhash64("text"))
             .repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text"))
    parts = written(dealt.select("doc_id", "text").mapInArrow(save, _COUNTS), "token-parts").filter("n_docs > 0")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    manifest = (parts.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
                .withColumn("width", F.lit(width)))
    manifest.write.parquet(f"{folder}/manifest")
    bases = _bases(df.sparkSession, folder)

    def offsets(batches):
        for batch in batches:
            for i in batch.column("id").to_pylist():
                part, base, _, _ = bases[i]
                ends = np.cumsum(_get(folder, f"{part:07d}.lengths", "<u8"), dtype=np.uint64) + np.uint64(base)
                _put(folder, f"{part:07d}.offsets", [np.array([base], "<u8").tobytes(), ends.astype("<u8").tobytes()])
            yield batch

    _each_part(df.sparkSession, len(bases)).mapInArrow(offsets, "id long").write.format("noop").mode("overwrite").save()
    return df.sparkSession.read.parquet(f"{folder}/manifest")


def _bases(spark: SparkSession, folder: str) -> list[tuple[int, int, int, int]]:
    """(part, base, nulls, width) of every part: one small row per file."""
    rows = spark.read.parquet(f"{folder}/manifest").select("part", "base", "nulls", "width").orderBy("part").collect()
    return [tuple(r) for r in rows]


def _each_part(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(0, n, 1, max(1, n))


def read_token_files(spark: SparkSession, folder: str, slice_docs: int = 2_000) -> DataFrame:
    """doc_id, start, n_tokens, ids (binary, little-endian unsigned 32-bit) of every document in the folder."""
    bases = _bases(spark, folder)

    def load(batches):
        for batch in batches:
            for i in batch.column("id").to_pylist():
                part, base, nulls, width = bases[i]
                ids = _get(folder, f"{part:07d}.ids", f"<u{width}")
                docs = _get(folder, f"{part:07d}.docs", "<i8")
                offsets = _get(folder, f"{part:07d}.offsets", "<u8").astype(np.int64)
                for at in range(0, len(docs), slice_docs):
                    to = min(at + slice_docs, len(docs))
                    bounds = offsets[at:to + 1]
                    block = np.array(ids[bounds[0] - base:bounds[-1] - base]).astype("<u4")
                    ends = ((bounds - bounds[0]) * 4).astype("<i8")
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.array(docs[at:to]), mask=np.arange(at, to) < nulls),
                        pa.array(bounds[:-1]), pa.array(np.diff(bounds)),
                        pa.LargeBinaryArray.from_buffers(
                            pa.large_binary(), to - at, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(block.tobytes())]
                        ).cast(pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    return _each_part(spark, len(bases)).mapInArrow(load, "doc_id long, start long, n_tokens long, ids binary")
