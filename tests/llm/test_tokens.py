"""Byte-level BPE and token files against the tokenizer libraries."""

import base64
import pickle
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import regex
import tiktoken
from conftest import corpus
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from flowsentry.llm import byte_bpe, token_contexts, token_files
from flowsentry.llm.common import shared_folder
from flowsentry.llm.pieces import MARKS, lists, pieces

RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
ODD = [" \n a", "a \n b  c\n\nd ", "it's  it'S 'll\n\n\nx", " a  b　", "12 345,6 7\t8 ", "\n", " ", "a\n", "\nb",
       "x\x1c y", "word.\nNext (one) \"two\"", "<|endoftext|> a<|endoftext|>b"]


def test_pieces_put_the_text_together_again():
    for t in ODD + [t or "" for _, t in corpus()]:
        assert "".join(pieces(t)) == t


def test_pieces_and_words_of_a_block_are_those_of_one_text():
    latin = [" word'\n x..", "naïve×2 b÷", "ªb Ünï.), ſ", "\x01a b\x02"]
    for texts in (ODD + latin + [t or "" for _, t in corpus()], [MARKS + " a\nb", "c"], [""], []):
        cut = lists(texts)
        assert [[p for p in row if p] for row in cut.to_pylist()] == [pieces(t) for t in texts]
        packer = byte_bpe.Packer(P.PATTERN, RANKS, 1000)
        distinct = cut.flatten().unique()
        words, length = packer.words_of(distinct)
        want = [packer.split(p) if p else [] for p in distinct.to_pylist()]
        assert words.to_pylist() == [w for ws in want for w in ws] and length.tolist() == [len(ws) for ws in want]


def test_known_words_come_with_their_forms(docs, monkeypatch):
    seen, made = [], byte_bpe.KnownWords
    monkeypatch.setattr(byte_bpe, "KnownWords", lambda table: seen.append(made(table)) or seen[-1])
    byte_bpe.encode(docs, RANKS, P.PATTERN, forms=("ids", "packed", "bytes"))
    (known,) = seen
    names, forms = known.names.to_pylist(), {f: c.to_pylist() for f, c in known.forms.items()}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    assert len(names) > 50 and forms["bytes"] == [w.encode() for w in names]
    assert all(i == own.encode_ordinary(w) and p == np.array(i, "<u4").tobytes()
               for w, i, p in zip(names, forms["ids"], forms["packed"]))


def test_encode_and_decode(spark, docs, none):
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    rows = corpus() + list(enumerate(ODD, 5000))
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows[len(corpus()):], "doc_id long, text string"))
    found = byte_bpe.encode(df, RANKS, P.PATTERN, forms=("ids", "packed", "bytes"), block_chars=3000)
    got = byte_bpe.decode(found, RANKS, out="again").collect()
    want = sorted((str(i), tuple(own.encode_ordinary(t or "")), (t or "").encode()) for i, t in rows)
    assert sorted((str(r.doc_id), tuple(r.ids), bytes(r.bytes)) for r in got) == want
    assert all(r.again == r.bytes and r.packed == np.array(r.ids, "<u4").tobytes() for r in got)
    assert byte_bpe.encode(none, RANKS, P.PATTERN).count() == 0


def test_the_rank_map_is_in_no_plan(spark, docs):
    spark.conf.set("spark.sql.maxPlanStringLength", 1 << 29)
    try:
        plan = byte_bpe.encode(docs, RANKS, P.PATTERN, forms=("ids", "packed", "bytes"))._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.maxPlanStringLength")
    assert "BroadcastNestedLoopJoin" in plan and len(plan) < 100_000


def test_words_outside_the_sample_are_folded_too(docs, monkeypatch):
    whole = {tuple(r.ids) for r in byte_bpe.encode(docs, RANKS, P.PATTERN).collect()}
    monkeypatch.setattr(byte_bpe, "KNOWN_WORDS", 3)
    assert {tuple(r.ids) for r in byte_bpe.encode(docs, RANKS, P.PATTERN).collect()} == whole


def test_the_most_frequent_words_are_known_up_to_a_bound(docs, monkeypatch):
    seen, made = [], byte_bpe.KnownWords
    monkeypatch.setattr(byte_bpe, "KnownWords", lambda folder: seen.append(made(folder)) or seen[-1])
    count = Counter()
    for _, t in corpus():
        count.update(regex.findall(P.PATTERN, t or ""))
    for most in (0, 20, 1_000_000):
        monkeypatch.setattr(byte_bpe, "KNOWN_WORDS", most)
        byte_bpe.encode(docs, RANKS, P.PATTERN, forms=("packed",))
        known = set(seen[-1].names.to_pylist())
        assert known <= set(count) and len(known) <= 2 * most and (most < 1000 or len(known) == len(count))
        others = max((n for w, n in count.items() if w not in known), default=0)
        assert min(map(count.get, known), default=others) * 2 ** (1 / 8) >= others


def test_what_travels_of_the_known_words_does_not_grow_with_them(docs, monkeypatch):
    seen, made = [], byte_bpe.KnownWords
    monkeypatch.setattr(byte_bpe, "KnownWords", lambda folder: seen.append(made(folder)) or seen[-1])
    byte_bpe.encode(docs, RANKS, P.PATTERN, forms=("packed", "bytes"))
    assert len(seen[-1].names) > 50 and len(pickle.dumps(seen[-1].__getstate__())) < 1000
    odd = pa.array(["\x00", "none of these", *seen[-1].names.to_pylist()[::-1]])
    assert seen[-1].find(odd).tolist() == [-1, -1, *range(len(seen[-1].names))[::-1]]


def test_hashing_many_words_takes_little_more_room_than_the_words(monkeypatch):
    words = pa.array(["", *(f"some word {i}" for i in range(300_000))])
    tracemalloc.start()
    try:
        found = token_contexts.hashes(words)
        assert tracemalloc.get_traced_memory()[1] < 100 << 20
    finally:
        tracemalloc.stop()
    monkeypatch.setattr(token_contexts, "HASHED_WORDS", len(words))
    assert (token_contexts.hashes(words) == found).all()


def test_token_files(spark, docs, none):
    model = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    marks = [(6000, "x<|endoftext|>y"), (6001, "<|endoftext|>"), (6002, "a  <|endoftext|> b\n"), (6003, "a |endoftext|> ")]
    assert model.encode(marks[0][1], add_special_tokens=False).ids == [87, 50256, 88]
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame(marks, "doc_id long, text string"))
    corpus_and_marks = corpus() + marks
    folder = shared_folder(spark, "files")
    manifest = token_files.write_token_files(docs, folder, P.path("byte_bpe_50k.json"), end_id=2)
    got = token_files.read_token_files(spark, folder).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((i for i, _ in corpus_and_marks), key=lambda i: (i is not None, i))
    place = 0
    texts = {}
    for i, t in corpus_and_marks:
        texts.setdefault(i, []).append(model.encode(t or "", add_special_tokens=False).ids + [2])
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert r.start == place and r.n_tokens == len(ids) and ids in texts[r.doc_id]
        texts[r.doc_id].remove(ids)
        place += len(ids)
    assert not any(texts.values())
    assert manifest.agg(F.sum("n_tokens")).first()[0] == place
    assert {r.width for r in manifest.collect()} == {2}
    crc = token_files.read_token_files(spark, folder).select("ids", F.crc32("ids").alias("crc")).first()
    assert crc.crc == zlib.crc32(crc.ids)
    empty = shared_folder(spark, "files")
    token_files.write_token_files(none, empty, P.path("byte_bpe_50k.json"), end_id=2)
    assert token_files.read_token_files(spark, empty).count() == 0


def test_wide_ids_take_four_bytes(spark, docs):
    folder = shared_folder(spark, "files")
    token_files.write_token_files(docs.filter("doc_id = 11"), folder, P.path("byte_bpe_50k.json"), end_id=70_000)
    assert np.frombuffer(token_files.read_token_files(spark, folder).first().ids, "<u4").tolist()[-1] == 70_000
