"""Exact and near duplicates and repeated strings against brute force."""

import hashlib
import itertools
import random
import re
from collections import defaultdict

import numpy as np
import xxhash
from conftest import corpus

from flowsentry.llm import exact_dedup, queries, simhash, suffix_dedup


def spaceless(t):
    return re.sub("[\x20\x09-\x0d]", "", t or "")


def test_equal_text_groups(docs, none):
    groups = defaultdict(list)
    for i, t in corpus():
        groups[spaceless(t)].append((-len(t or ""), i is None, i or 0, i))
    got = exact_dedup.equal_text_groups(docs).collect()
    assert len(got) == len(corpus())
    by_hash = {hashlib.sha256(k.encode()).hexdigest(): sorted(v) for k, v in groups.items()}
    for r in got:
        members = by_hash[r.text_sha256]
        assert r.keep_id == members[0][3] and r.group_size == len(members)
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) and {r.text_sha256 for r in kept} == set(by_hash)
    assert exact_dedup.equal_text_groups(none).count() == 0


def test_drop_equal_texts_keeps_one_row_of_each_content(docs, none):
    kept = exact_dedup.drop_equal_texts(docs)
    assert kept.columns == docs.columns
    contents = [spaceless(r.text) for r in kept.collect()]
    assert len(contents) == len(set(contents)) == len({spaceless(t) for _, t in corpus()})
    assert exact_dedup.drop_equal_texts(none).count() == 0


def simple_print(text, k=3):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    s = [" ".join(w[i:i + k]) for i in range(max(1, len(w) - k + 1))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    """Smallest linked value of each distinct print."""
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a, b in itertools.combinations(sorted(root), 2):
        if bin(a ^ b).count("1") <= 2:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {p: find(p) for p in root}


def test_simhash_groups(spark, docs, none, tmp_path):
    rows = corpus()
    prints = [simple_print(t) for _, t in rows]
    root = brute_components(set(prints))
    least = defaultdict(list)
    for (i, _), p in zip(rows, prints):
        if i is not None:
            least[root[p]].append(i)
    want = sorted((str(i), f"{p:016x}", str(min(least[root[p]], default=None))) for (i, _), p in zip(rows, prints))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op8_simhash(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want
    assert simhash.near_duplicates(none).count() == 0
    stay = simhash.keep_one(docs)
    assert stay.columns == docs.columns
    assert len({root[simple_print(r.text)] for r in stay.collect()}) == len(set(root.values()))
    assert stay.select("doc_id", "text").distinct().count() == len(set(root.values()))
    assert simhash.keep_one(none).count() == 0


def test_links_are_exact_where_one_key_is_crowded(spark):
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    values = {centre}
    while len(values) < 400:  # all within a few bits of one another, so that keys have hundreds of members
        values.add(rng.choice(sorted(values)) ^ 1 << rng.randrange(64))
    values |= {rng.getrandbits(64) for _ in range(50)}
    signed = {int(np.uint64(v).astype(np.int64)): v for v in values}
    edges = simhash.links(spark.createDataFrame([(v,) for v in signed], "fingerprint long"))
    assert all(bin(signed[r.a] ^ signed[r.b]).count("1") <= 2 for r in edges.collect())
    got = {signed[r.node]: signed[r.root] for r in simhash.components(edges).collect()}
    want = brute_components(values)
    alone = {v for v in values if sum(w == want[v] for w in want.values()) == 1}
    assert set(got) == values - alone
    groups = defaultdict(set), defaultdict(set)
    for v in got:
        groups[0][got[v]].add(v)
        groups[1][want[v]].add(v)
    assert sorted(map(sorted, groups[0].values())) == sorted(map(sorted, groups[1].values()))


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    assert {r.root for r in simhash.components(edges).collect()} == {0}


def test_links_within_one_bit_on_crowded_keys(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CROWDED", 2)
    x = 15 << 40
    rng = random.Random(6)
    values = [x, x ^ 1 << 40, x ^ 1 << 43, x ^ 1 << 40 ^ 1 << 42] + [
        x ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for _ in range(60)]
    signed = {int(np.uint64(v).astype(np.int64)) for v in values}
    edges = simhash.links(spark.createDataFrame([(v,) for v in signed], "fingerprint long"), 1).collect()
    want = {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") == 1}
    assert {(r.a, r.b) for r in edges} == want


def brute_removed(rows):
    seen, out = set(), {}
    order = sorted({(-1 << 63 if i is None else i, xxh(t or ""), t or "") for i, t in rows})
    for i, _, t in order:
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            w = b[p:p + 100]
            if w in seen:
                gone[p:p + 100] = True
            seen.add(w)
        out[i, t] = gone
    return out


def xxh(t):
    return int(np.uint64(xxhash.xxh64_intdigest(t.encode(), 42)).astype(np.int64))


def test_remove_repeats(docs, none):
    want = brute_removed(corpus())
    got = suffix_dedup.remove_repeats(docs).collect()
    expected = []
    for i, t in corpus():
        gone = want[-1 << 63 if i is None else i, t or ""]
        b = np.frombuffer((t or "").encode(), np.uint8)
        edge = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(int)))
        expected.append((str(i), len(b), tuple(zip(edge[::2].tolist(), edge[1::2].tolist())), b[~gone].tobytes()))
    assert sorted((str(r.doc_id), r.n_bytes, tuple((s.start, s.end) for s in r.spans), bytes(r.kept)) for r in got) \
        == sorted(expected)
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_loser_tree_merges_and_tells_shared_prefixes():
    rng = random.Random(1)
    runs = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(0, 30)))
            for _ in range(7)]

    def coded(run):
        before = b""
        for s in run:
            yield suffix_dedup.common_prefix(before, s, 0), s, None
            before = s

    got = list(suffix_dedup.LoserTree([coded(r) for r in runs]))
    want = sorted(s for r in runs for s in r)
    assert [s for _, s, _ in got] == want
    assert [n for n, _, _ in got][1:] == [suffix_dedup.common_prefix(a, b, 0) for a, b in zip(want, want[1:])]
