"""Near-duplicate groups by SimHash fingerprints and pigeonhole blocks.

A fingerprint has 64 bits; a bit is 1 if it is set in over half of the hashes of the text's word shingles,
repeats included. Fingerprints that differ in at most `distance` bits are linked. The 64 bits are cut into
`distance + 3` blocks: close fingerprints agree in at least three of them, so every choice of three blocks
is a key on which they are joined, and the Hamming distance is verified on what the join finds. Only distinct
fingerprints are joined; rows with equal fingerprints are one node.

Very similar documents can crowd one key with thousands of distinct fingerprints. Keys with more than
`CROWDED` members are not joined pairwise. Their members are linked in an exact and linear way: fingerprints
within two bits are those that share a value after flipping at most one bit of each, so each is sent to its
65 values within one bit, and those that meet (65 at most) are linked to the smallest of them.

Groups are the connected components of the links, found by passing the smallest label along links and
following labels of labels; every round is written to the shared folder.

Defined results: a null or empty text has fingerprint zero and is linked like any other; a text with fewer
words than a shingle is one shingle of all its words. A component's id is its smallest id that is not null;
it is null if it has none. Repeated rows give repeated results. An empty table gives none.
"""

from __future__ import annotations

import sys
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsentry.llm.common import whole_texts, written

register_pickle_by_value(sys.modules[__name__])

#: Members of a key that are still compared in pairs.
CROWDED = 64
SEED = 42


def shingle_hashes(text: str, words_in_shingle: int) -> np.ndarray:
    """The hashes of a text's shingles; words are the runs outside [\\x20\\x09-\\x0D]."""
    words = text.encode().lower().split()  # bytes: only A-Z fold, only these six characters split
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    k = min(words_in_shingle, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1:].tolist())], np.uint64)


def fingerprint(text: str, words_in_shingle: int) -> int:
    """The 64-bit SimHash of one text; zero if it has no words."""
    return majority(shingle_hashes(text, words_in_shingle))


def majority(hashes: np.ndarray) -> int:
    """Bit i is set if it is set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at:at + (1 << 16)].astype("<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, words_in_shingle: int = 3, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint (as signed long) of every row."""
    return whole_texts(df, id_col, text_col).mapInArrow(
        _printer(words_in_shingle, ["doc_id"]), "doc_id long, fingerprint long")


def _printer(words_in_shingle: int, carried: list[str]):
    def run(batches):
        for batch in batches:
            prints = [fingerprint(t, words_in_shingle) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in carried), pa.array(np.array(prints, np.uint64).view(np.int64), pa.int64())],
                names=[*carried, "fingerprint"])

    return run


def _masks(bits: int, blocks: int, kept: int) -> list[int]:
    """For each choice of `kept` of `blocks` blocks, the mask of their bits."""
    edges = [bits * i // blocks for i in range(blocks + 1)]
    block = [((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in range(blocks)]
    return [sum(block[i] for i in chosen) for chosen in combinations(range(blocks), kept)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _distance(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def links(nodes: DataFrame, distance: int = 2) -> DataFrame:
    """Links (a < b) among the distinct values of `fingerprint` that differ in 1..`distance` bits, up to
    connectivity: members of a crowded key may be linked through a third."""
    if not 1 <= distance <= 2:
        raise ValueError("the way for crowded keys is exact for a distance of 1 or 2 only")
    masks = _masks(64, distance + 3, 3)
    keys = F.array(*[F.struct(F.lit(i).alias("blocks"), F.col("fingerprint").bitwiseAND(F.lit(_signed(m))).alias("key"))
                     for i, m in enumerate(masks)])
    keyed = nodes.select("fingerprint", F.explode(keys).alias("k")).select("fingerprint", "k.blocks", "k.key")
    shared = keyed.groupBy("blocks", "key").agg(F.count("*").alias("members")).filter("members > 1")
    keyed = written(keyed.join(shared, ["blocks", "key"]), "simhash-keys")
    fit = keyed.filter(F.col("members") <= CROWDED)
    pairs = (fit.select("blocks", "key", F.col("fingerprint").alias("a"))
             .join(fit.select("blocks", "key", F.col("fingerprint").alias("b")), ["blocks", "key"])
             .filter((F.col("a") < F.col("b")) & (_distance("a", "b") <= distance)).select("a", "b"))
    crowd = keyed.filter(F.col("members") > CROWDED).select("fingerprint").distinct()
    return pairs.unionByName(_crowd_links(crowd, distance)).distinct()


def _crowd_links(crowd: DataFrame, distance: int) -> DataFrame:
    """Exact links for fingerprints of crowded keys: each is sent to its 65 neighbours within one bit, and
    those that meet there are linked to the smallest."""
    near = F.concat(F.array(F.col("fingerprint")), F.transform(
        F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fingerprint").bitwiseXOR(_bit(i))))
    met = crowd.select("fingerprint", F.explode(near).alias("at"))
    first = met.groupBy("at").agg(F.min("fingerprint").alias("a"), F.count("*").alias("n")).filter("n > 1")
    if distance == 1:  # those that meet at a value within one bit of both need not be within one bit of each other
        return (met.join(crowd.withColumnRenamed("fingerprint", "a"), F.col("at") == F.col("a"))
                .select("a", F.col("fingerprint").alias("b")).filter("a < b"))
    return met.join(first, "at").filter(F.col("fingerprint") != F.col("a")).select("a", F.col("fingerprint").alias("b"))


def _bit(i):
    return F.call_function("shiftleft", F.lit(1).cast("long"), i)


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """node, root: the smallest node reachable from each node that has an edge.

    Each round sends every node the smallest label among its neighbours and itself, then replaces labels by
    the labels of the labelled nodes, so that distances halve. It ends when no label changes.
    """
    both = written(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select(
        "node", F.least("node", "least").alias("root"))
    labels = written(labels, "labels")
    for _ in range(rounds):
        seen = (both.join(labels, both["b"] == labels["node"]).groupBy(both["a"].alias("node"))
                .agg(F.min("root").alias("seen")))
        stepped = labels.join(seen, "node", "left").select(
            "node", F.col("root").alias("was"), F.least("root", "seen").alias("root"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("further"))
        moved = written(stepped.join(jump, "root", "left").select(
            "node", "was", F.least("root", "further").alias("root")), "labels")
        labels = moved.select("node", "root")
        if moved.filter("root < was").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def keep_one(df: DataFrame, words_in_shingle: int = 3, distance: int = 2, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """The rows of `df` that stay, with all their columns: of each group the smallest id (null last), of rows
    with that id the smallest text hash. Rows that repeat both are one document, which stays as it is."""
    keyed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
                      F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                      F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    prints = written(
        keyed.select("doc_id", "hash", "text").mapInArrow(_printer(words_in_shingle, ["doc_id", "hash"]),
                                                          "doc_id long, hash long, fingerprint long"), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "hash")).alias("first")
    nodes = prints.groupBy("fingerprint").agg(first)
    member = components(links(nodes.select("fingerprint"), distance)).withColumnRenamed("node", "fingerprint")
    stay = (nodes.join(member, "fingerprint", "left").groupBy(F.coalesce("root", "fingerprint").alias("root"))
            .agg(F.min("first").alias("first")).select("first.doc_id", "first.hash"))
    stay = written(stay.select(F.col("doc_id").alias("stay_id"), F.col("hash").alias("stay_hash")), "stay")
    return keyed.join(stay, (keyed["hash"] == stay["stay_hash"]) & keyed["doc_id"].eqNullSafe(stay["stay_id"]),
                      "left_semi").select("row.*")


def near_duplicates(df: DataFrame, words_in_shingle: int = 3, distance: int = 2, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (signed long), component_id: one row per row of `df`."""
    prints = written(fingerprints(df, words_in_shingle, id_col, text_col), "fingerprints")
    nodes = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least_id"))
    edges = links(nodes.select("fingerprint"), distance)
    member = components(edges).withColumnRenamed("node", "fingerprint")
    named = nodes.join(member, "fingerprint", "left").select(
        "fingerprint", "least_id", F.coalesce("root", "fingerprint").alias("root"))
    least = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    by_print = written(named.join(least, "root").select("fingerprint", "component_id"), "components")
    return prints.join(by_print, "fingerprint").select("doc_id", "fingerprint", "component_id")
