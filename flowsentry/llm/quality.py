"""A quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of `WORDS` words, all of them, up to its end. Each passage is encoded by a
learned layer over its histogram of neighbouring character classes and of hashed words. Gated attention
weights over the passages are learned from document labels alone, and the weighted mean of the encodings is
scored by a logistic unit.

Training takes at most `TRAINING_DOCS` labelled documents, those with the smallest hashes of their ids, since
the model has a fixed number of parameters; this bound is the only one. Scoring reads every whole text.

Defined results: a null or empty text is one passage without content and is scored like any other; a
document with several labels counts as their mean; null labels and ids are not learned from; without any
label, or any labelled document, every score is 0.5. A text's score depends on the text and the model only.
Rows with equal texts have equal scores; other columns pass through untouched.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsentry.llm.common import crc_of_id, release, whole_texts

register_pickle_by_value(sys.modules[__name__])

#: Most labelled documents that a model is fitted on.
TRAINING_DOCS = 4_000
WORDS = 64
KEEP_FROM = 0.3
_CLASSES, _BUCKETS, _ENCODED, _GATE = 16, 128, 24, 12
_WIDTH = _CLASSES * _CLASSES + _BUCKETS


def _class_of_byte() -> np.ndarray:
    table = np.full(256, 5, np.uint8)
    for number, members in enumerate((
            "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", "", ".", ",", "!?",
            "\"'", "()[]{}<>", "|/\\_-+=", "#@$%^&*~`", ":;")):
        table[[ord(c) for c in members]] = number
    table[0x80:0xC0], table[0xC0:] = 15, 14
    return table


_CLASS = _class_of_byte()
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint64)
_POWERS = np.cumprod(np.full(64, 0x9E3779B1, np.uint64), dtype=np.uint64)


def passages(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of `texts`, one after another, and where each text's passages start."""
    raw = [t.encode() + b"\n" for t in texts]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    data = np.frombuffer(b"".join(raw), np.uint8)
    doc = np.repeat(np.arange(len(raw)), sizes)
    space = _SPACE[data]
    first = np.r_[True, doc[1:] != doc[:-1]]
    begins = ~space & np.r_[True, space[:-1]]  # every text ends in a space, so words do not cross texts
    word_at = np.flatnonzero(begins)
    words_of = np.bincount(doc[word_at], minlength=len(raw))
    count = np.maximum(1, -(-words_of // WORDS))
    starts = np.cumsum(count) - count
    ordinal = np.arange(len(word_at)) - np.repeat(np.cumsum(words_of) - words_of, words_of)
    home = starts[doc[word_at]] + ordinal // WORDS  # the passage of each word
    n = int(count.sum())
    # a character that is no part of a word belongs to the word before it, or to the text's first passage
    seen = np.cumsum(begins) - 1
    inside = seen >= (np.cumsum(words_of) - words_of)[doc]
    where = np.where(inside, home[np.maximum(seen, 0)] if len(home) else 0, starts[doc])
    kind = _CLASS[data].astype(np.int64)
    pair = kind[:-1] * _CLASSES + kind[1:]
    same = ~first[1:]
    square = _CLASSES * _CLASSES
    shape = np.bincount(where[:-1][same] * square + pair[same], minlength=n * square).reshape(n, square)
    out = np.zeros((n, _WIDTH), np.float32)
    out[:, :square] = np.sqrt(shape / np.maximum(1, shape.sum(1, keepdims=True)))
    if len(word_at):
        place = np.arange(len(data)) - np.repeat(word_at, np.diff(np.r_[word_at, len(data)])) \
            if word_at[0] == 0 else np.maximum(0, np.arange(len(data)) - word_at[np.maximum(seen, 0)])
        value = np.where(space, 0, _LOWER[data] * _POWERS[place & 63])
        hashed = np.add.reduceat(value, word_at)
        bucket = ((hashed * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(57)).astype(np.int64)
        bag = np.bincount(home * _BUCKETS + bucket, minlength=n * _BUCKETS).reshape(n, _BUCKETS)
        out[:, square:] = np.sqrt(bag / np.maximum(1, bag.sum(1, keepdims=True)))
    return out, starts


@dataclass
class Model:
    encode: np.ndarray
    encode_bias: np.ndarray
    tanh_gate: np.ndarray
    sigmoid_gate: np.ndarray
    attend: np.ndarray
    output: np.ndarray
    bias: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [self.encode, self.encode_bias, self.tanh_gate, self.sigmoid_gate, self.attend, self.output, self.bias]

    def forward(self, x: np.ndarray, starts: np.ndarray):
        """Everything between the passages and the documents' scores."""
        h = np.tanh(x @ self.encode + self.encode_bias)
        t, s = np.tanh(h @ self.tanh_gate), _sigmoid(h @ self.sigmoid_gate)
        e = (t * s) @ self.attend
        sizes = np.diff(np.r_[starts, len(x)])
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
        a = e / np.repeat(np.add.reduceat(e, starts), sizes)
        z = np.add.reduceat(a[:, None] * h, starts)
        return h, t, s, a, z, _sigmoid(z @ self.output + self.bias[0]), sizes

    def score(self, texts: list[str]) -> np.ndarray:
        out = []
        for at in range(0, len(texts), 128):
            x, starts = passages(texts[at:at + 128])
            out.append(self.forward(x, starts)[5])
        return np.concatenate(out) if out else np.empty(0)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _gradients(model: Model, x, starts, y) -> list[np.ndarray]:
    h, t, s, a, z, p, sizes = model.forward(x, starts)
    d_logit = (p - y) / len(y)
    d_z = np.repeat(d_logit[:, None] * model.output, sizes, axis=0)
    d_a = (d_z * h).sum(1)
    d_e = a * (d_a - np.repeat(np.add.reduceat(a * d_a, starts), sizes))
    d_gate = d_e[:, None] * model.attend
    d_t, d_s = d_gate * s * (1 - t * t), d_gate * t * s * (1 - s)
    d_h = a[:, None] * d_z + d_t @ model.tanh_gate.T + d_s @ model.sigmoid_gate.T
    d_in = d_h * (1 - h * h)
    return [x.T @ d_in, d_in.sum(0), h.T @ d_t, h.T @ d_s, (t * s).T @ d_e, z.T @ d_logit, np.array([d_logit.sum()])]


def train(x: np.ndarray, sizes: np.ndarray, y: np.ndarray, epochs: int = 25, batch: int = 64, rate: float = 0.01,
          seed: int = 7) -> Model:
    """Adam on the documents' log loss; `sizes` has the number of passages of each document."""
    rng = np.random.default_rng(seed)
    share = float(np.clip(y.mean(), 0.01, 0.99))
    draw = lambda *shape: rng.normal(0, shape[0] ** -0.5, shape).astype(np.float32)
    model = Model(draw(_WIDTH, _ENCODED) * 2, np.zeros(_ENCODED, np.float32), draw(_ENCODED, _GATE),
                  draw(_ENCODED, _GATE), draw(_GATE), draw(_ENCODED), np.array([np.log(share / (1 - share))], np.float32))
    begin = np.cumsum(sizes) - sizes
    first, second, step = [np.zeros_like(p) for p in model.parameters()], [np.zeros_like(p) for p in model.parameters()], 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(order), batch):
            docs = order[at:at + batch]
            rows = np.concatenate([np.arange(begin[d], begin[d] + sizes[d]) for d in docs])
            starts = np.cumsum(sizes[docs]) - sizes[docs]
            step += 1
            pace = rate * (1 - epoch / epochs) * np.sqrt(1 - 0.999 ** step) / (1 - 0.9 ** step)
            for p, g, m, v in zip(model.parameters(), _gradients(model, x[rows].astype(np.float32), starts, y[docs]), first, second):
                g = g + 1e-4 * p
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (pace * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
    return model


def fit(df: DataFrame, labels: DataFrame, may_learn: Column | None = None, training_docs: int = TRAINING_DOCS,
        id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """A model of `labels` (doc_id, quality) over the texts of `df`. `may_learn` is a condition on doc_id."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").dropna()
    if may_learn is not None:
        usable = usable.filter(may_learn)
    target = usable.groupBy("doc_id").agg(F.avg("quality").alias("quality"))
    # the order by hash spreads the choice over all ids; the chosen rows are at most `training_docs`
    chosen = target.orderBy(F.xxhash64("doc_id"), "doc_id").limit(training_docs)

    def encoded(batches):
        for batch in batches:
            ids, quality = batch.column("doc_id"), batch.column("quality")
            texts = batch.column("text").to_pylist()
            for at in range(0, len(texts), 64):
                x, starts = passages(texts[at:at + 64])
                bounds = np.r_[starts, len(x)]
                yield pa.RecordBatch.from_arrays([
                    ids.slice(at, 64), quality.slice(at, 64),
                    pa.array([x[a:b].astype(np.float16).tobytes() for a, b in zip(bounds[:-1], bounds[1:])])],
                    names=["doc_id", "quality", "passages"])

    found = (whole_texts(df, id_col, text_col).join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")
             .mapInArrow(encoded, "doc_id long, quality double, passages binary"))
    release(df.sparkSession)
    rows = sorted(found.collect())  # bounded by training_docs
    if not rows:
        return None
    bags = [np.frombuffer(r[2], np.float16).reshape(-1, _WIDTH) for r in rows]
    return train(np.concatenate(bags), np.array([len(b) for b in bags]),
                 np.array([r[1] for r in rows], np.float32))


def score(model: Model | None, text: Column) -> Column:
    """The probability that a text is labelled 1."""
    if model is None:
        return F.lit(0.5)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(texts.fillna("").tolist()), dtype="float64")

    return scored(F.coalesce(text, F.lit("")))


def held_out(doc_id: Column) -> Column:
    return crc_of_id(doc_id) % 5 == 0


def keep_good(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `df` whose score is `KEEP_FROM` or more."""
    model = fit(df, labels, ~held_out(F.col("doc_id")), id_col=id_col, text_col=text_col)
    return df.filter(score(model, F.col(f"`{text_col}`")) >= KEEP_FROM)
