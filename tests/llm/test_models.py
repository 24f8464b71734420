"""Language model, quality classifier, secret scan and decontamination."""

import hashlib
import math
import pickle
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import corpus, prose
from pyspark.sql import functions as F

from flowsentry.llm import decontaminate, quality, secret_scan, suffix_tree_lm, token_contexts
from flowsentry.llm.common import Shipped


def test_scores(docs, none):
    rows = corpus()
    held = {i: zlib.crc32(str("" if i is None else i).encode()) % 7 == 2 for i, _ in rows}
    words = {t: (t or "").encode().lower().split() + [None] for _, t in rows}
    c = Counter(w for i, t in rows if not held[i] for w in words[t])
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), len(words[t]), sum(c[w] > 0 for w in words[t]),
                   round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words[t]), 5)) for i, t in rows)
    found = suffix_tree_lm.score_texts(docs, ~suffix_tree_lm.held_out(F.col("doc_id"))).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 5)) for r in found) == want
    assert {r.train_tokens for r in found} == {n}
    assert all(r.score <= 1e-9 for r in found)
    assert suffix_tree_lm.score_texts(none, F.lit(True)).count() == 0


def test_without_training_text_every_token_is_unknown(docs):
    found = suffix_tree_lm.score_texts(docs, F.lit(False)).collect()
    assert all(r.score == 0 and r.base_score == 0 and r.n_known == r.train_tokens == 0 for r in found)


def test_chances_of_a_state_sum_to_one_and_contexts_help(spark):
    """Words of two kinds that follow words of their own kind only: contexts tell the kind."""
    rng = random.Random(2)
    kinds = [[f"{w}{e}" for w in ("ba", "do", "ki", "lu", "me", "pa", "ro", "su")] for e in ("ing", "ez")]
    rows = [(i, " ".join(rng.choice(kinds[i % 2]) for _ in range(200))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    seen = {}
    fit = suffix_tree_lm.TokenTree.fit

    def watched(self, root, *rest):
        fit(self, root, *rest)
        seen["tree"], seen["root"] = self, root

    suffix_tree_lm.TokenTree.fit = watched
    try:
        found = suffix_tree_lm.score_texts(df, F.col("doc_id") < 80).filter("doc_id >= 80").collect()
    finally:
        suffix_tree_lm.TokenTree.fit = fit
    assert sum(r.score for r in found) > sum(r.base_score for r in found) + 200 * 40 * 0.2
    tree, root = seen["tree"], seen["root"]
    assert len(tree.keys)
    symbols = np.arange(tree.width - 1)
    for s in range(len(tree.parent)):
        chance = 10 ** tree.score(np.full(len(symbols), s), symbols, np.log10(root[:-1]))
        assert chance.sum() == pytest.approx(1, abs=1e-6)


def test_score_is_that_of_a_model_counted_in_one_place(spark, monkeypatch):
    """Words told by the one or two before them, each context far below 0.2 % of the tokens, against dictionaries."""
    rng = random.Random(8)
    pairs = {f"k{i}": f"v{rng.randrange(40)}" for i in range(900)}
    rows = []
    for i in range(400):
        words = []
        for _ in range(25):
            key, sign = rng.choice(list(pairs)), rng.choice("xyz")
            words += [sign, f"m{rng.randrange(3)}", f"{sign}{rng.randrange(2)}", key, pairs[key]]
        rows.append((i, " ".join(words)))
    rows += [(400, ""), (401, "k1"), (402, "never seen k1 v1 k2")]
    df, learns = spark.createDataFrame(rows, "doc_id long, text string"), 300
    trees, train = [], suffix_tree_lm.train_tokens
    monkeypatch.setattr(suffix_tree_lm, "train_tokens", lambda *a: trees.append((train(*a), a[3])) or trees[-1][0])
    monkeypatch.setattr(suffix_tree_lm, "COMMON_SHARE", 1e-3)  # most words are rare ones, joined as rows
    found = {}
    for most in (1_000_000, 20):
        monkeypatch.setattr(token_contexts, "TRAVEL_MOST", most)
        found[most] = {r.doc_id: r for r in suffix_tree_lm.score_texts(df, F.col("doc_id") < learns).collect()}
    (tree, known), texts = trees[0], {i: t.encode().lower().split() + [b""] for i, t in rows}
    count = Counter(w for i in range(learns) for w in texts[i])
    total, once = sum(count.values()), max(1, sum(n == 1 for n in count.values()))
    common = [w for w, n in count.items() if n >= math.ceil(1e-3 * total)]
    paired = sorted(w for w in common if count[w] >= suffix_tree_lm.PAIR_SHARE * total)
    assert len(paired) == len(common) < len(count) / 2
    others = total - sum(count[w] for w in common) + once
    symbols = {w.encode(): s for w, s in zip(known.words.to_pylist(), tree.symbol.tolist())}

    def byte_chance(context, token):
        state = tree.states.after(pa.array([context.decode()]))
        if token in common:
            symbol, alone = symbols[token], count[token] / (total + once)
        else:
            symbol, alone = tree.width - 2, others / (total + once)
        chance = 10 ** tree.score(state, np.array([symbol]), np.log10([alone]))[0]
        return chance if token in common else chance * (count.get(token, 0) or once) / others

    seen = {1: Counter(), 2: Counter()}
    for i in range(learns):
        t = [b"", *texts[i]]
        seen[1].update(((t[j - 1],), t[j]) for j in range(1, len(t)))
        seen[2].update(((t[j - 2], t[j - 1]), t[j]) for j in range(2, len(t)))
    states = {}

    def chance(context, token):
        below = byte_chance(context[0], token) if len(context) == 1 else chance(context[1:], token)
        if context not in states:
            return below
        own, rest = states[context]
        return own[token] if token in own else below * rest

    for depth in (1, 2):
        by, made = {}, {}
        for (context, token), n in seen[depth].items():
            by.setdefault(context, {})[token] = n
        for context, after in by.items():
            whole, own = sum(after.values()), {}
            for token, n in after.items():
                below = byte_chance(context[0], token) if depth == 1 else chance(context[1:], token)
                if n >= 4 and abs(n - whole * below) > 3 * math.sqrt(whole * below + 1):
                    own[token] = (n + 20 * below) / (whole + 20), below
            left, left_below = (max(1e-9, 1 - sum(c[k] for c in own.values())) for k in (0, 1))
            nats = sum(c * math.log(c / b) for c, b in own.values()) + left * math.log(left / left_below)
            if own and nats >= 0.01 and nats > (len(own) + 3 * math.sqrt(2 * len(own))) / 2 / whole:
                made[context] = {t: c for t, (c, _) in own.items()}, left / left_below
        states.update(made)
    assert sum(len(c) == 1 for c in states) > 300 and sum(len(c) == 2 for c in states) >= 9
    unknown = b"never"
    for context in list(states)[:40] + list(states)[-40:]:
        assert sum(chance(context, w) for w in [*count, unknown]) == pytest.approx(1, abs=1e-6)
    for i, _ in rows:
        t = [b"", *texts[i]]
        want = sum(math.log10(chance(tuple(t[max(0, j - 2):j]), t[j])) for j in range(1, len(t)))
        assert found[1_000_000][i].score == pytest.approx(want, abs=1e-6)
        assert found[20][i].score == pytest.approx(want, abs=1e-6)
    held = [found[20][i] for i in range(learns, 400)]
    # of five words one follows from the word before it; of nine hundred keys nothing else tells the value
    assert sum(r.score - r.base_score for r in held) > 100 * 25 * 1.2


def test_what_travels_is_made_once_and_its_packed_form_let_go(spark):
    shipped = Shipped(spark, {"a": 1})

    def run(batches):
        for _ in batches:
            first = shipped.value
            packed = any(isinstance(x, bytes) for x in (shipped.sent.value, *shipped.sent.value))
            yield pa.RecordBatch.from_pydict({"once": [first is shipped.sent.value[0]], "packed": [packed]})

    got = spark.range(40).repartition(4).mapInArrow(run, "once boolean, packed boolean").collect()
    assert {(r.once, r.packed) for r in got} == {(True, False)}


def test_sequences_of_common_words_are_numbers_and_all_keys_are_found(spark):
    rng = np.random.default_rng(5)
    words = pa.array([f"w{i}" for i in range(3000)] + [""])
    common = suffix_tree_lm.Common(words.slice(0, 2000), np.ones(2000, np.int64))
    keys = common.keys(words)
    assert keys[:2000].tolist() == list(range(1, 2001)) and (keys[2000:] >> np.uint64(62)).all()
    assert common.find(words).tolist() == [*range(2000), *[-1] * 1001]
    common.clash = True  # words of one hash are told apart by the words
    assert common.find(words).tolist() == [*range(2000), *[-1] * 1001]
    context, token = keys[rng.integers(1900, 2100, 4000)], keys[rng.integers(1900, 2100, 4000)]
    want = Counter(zip(context.tolist(), token.tolist()))
    rows = pa.Table.from_batches(token_contexts._counted([(context[:900], token[:900]), (context[900:], token[900:])]))
    as_keys = [rows.column(c).to_numpy().view(np.uint64).tolist() for c in ("context", "token")]
    assert Counter(dict(zip(zip(*as_keys), rows.column("n").to_pylist()))) == want and rows.num_rows == len(want)
    both = (context < 2001) & (token < 2001)
    pair = token_contexts.joined(context, token)
    assert (pair[both] < 1 << 40).all() and (pair[~both] >= 1 << 62).all()
    held = np.unique(np.r_[pair, ~context, keys])
    found = token_contexts.Found(held, np.arange(len(held)))
    at, there = found.at(np.r_[held, held + np.uint64(1 << 61)])
    assert there[:len(held)].all() and (found.columns[0][at[:len(held)]] == np.arange(len(held))).all()
    assert there[len(held):].tolist() == np.isin(held + np.uint64(1 << 61), held).tolist()
    table = spark.createDataFrame([(int(k),) for k in held.view(np.int64)], "key long")
    may = token_contexts.Filter(table)
    assert may.has(held).all() and may.has(rng.integers(0, 1 << 63, 10_000).astype(np.uint64)).mean() < 0.01


def test_values_that_all_travel_are_mapped_and_make_no_rows(spark, docs):
    plan = suffix_tree_lm.score_texts(docs, F.lit(True))._jdf.queryExecution().toString()
    assert "inline" in plan and "explode" not in plan
    keys = np.arange(9000, dtype=np.uint64) * np.uint64(977)
    found = token_contexts.Found(keys, np.arange(9000.0)).travel_mapped(spark)
    packed = pickle.dumps(found)
    again = pickle.loads(packed)
    assert len(packed) < 2000 and isinstance(again.spread.base, np.memmap)
    value, there = again.values(np.r_[keys, keys + np.uint64(1)])
    assert (value[:9000] == np.arange(9000)).all() and there.tolist() == [True] * 9000 + [False] * 9000


def test_quality(spark):
    rng = random.Random(4)

    def bad(text):
        return " ".join(w.upper() + rng.choice(["!!", "###", "$$$"]) for w in text.split())

    texts = [prose(rng, rng.randint(5, 300)) for _ in range(240)]
    rows = [(i, bad(t) if i % 4 == 0 else t, "x") for i, t in enumerate(texts)] + [(900, None, "x"), (901, "", "x"), (None, "a b", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame(
        [(i, int(i % 4 != 0)) for i in range(240)] + [(5, 1), (None, 1), (7, None)], "doc_id long, quality int")
    model = quality.fit(df, labels, ~quality.held_out(F.col("doc_id")))
    got = df.select("doc_id", quality.held_out(F.col("doc_id")).alias("held"), quality.score(model, F.col("text")).alias("s")).collect()
    assert len(got) == len(rows) and all(0 <= r.s <= 1 for r in got)
    held = [r for r in got if r.held and r.doc_id is not None and r.doc_id < 240]
    assert np.mean([(r.s >= quality.KEEP_FROM) == (r.doc_id % 4 != 0) for r in held]) > 0.95
    kept = quality.keep_good(df, labels)
    assert kept.columns == df.columns
    assert df.select(quality.score(quality.fit(df, labels.limit(0)), F.col("text")).alias("s")).distinct().collect()[0].s == 0.5
    assert quality.keep_good(df.limit(0), labels).count() == 0


def test_a_score_does_not_depend_on_the_other_texts():
    model = quality.train(*_bags())
    texts = ["A b\nc.", "", "x" * 3000, " ", "one two  three\n", prose(random.Random(1), 500)]
    together = model.score(texts)
    assert np.allclose(together, np.concatenate([model.score([t]) for t in texts]), atol=1e-6)


def _bags():
    rng = random.Random(1)
    x, starts = quality.passages([prose(rng, 100) for _ in range(20)])
    sizes = np.diff(np.r_[starts, len(x)])
    return x, sizes, np.array([i % 2 for i in range(20)], np.float32)


def test_gradients_agree_with_differences():
    x, sizes, y = _bags()
    model = quality.train(x, sizes, y, epochs=1)
    for part in model.parameters():
        part[...] = part.astype(np.float64)
    starts = np.cumsum(sizes) - sizes

    def loss():
        p = model.forward(x.astype(np.float64), starts)[5]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for part, gradient in zip(model.parameters(), quality._gradients(model, x.astype(np.float64), starts, y)):
        at = np.unravel_index(np.abs(gradient).argmax(), gradient.shape)
        was = part[at].copy()
        part[at] = was + 1e-2
        up = loss()
        part[at] = was - 1e-2
        down = loss()
        part[at] = was
        assert gradient[at] == pytest.approx((up - down) / 2e-2, rel=0.05, abs=1e-4)


BASE = ((0, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
        (1, r"AKIA[A-Z0-9]+", 0, 20), (2, r"[0-9a-f]+", 0, 24))


def test_secret_scan(spark, none):
    rng = random.Random(6)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(60)]
    keys = ["AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(16)) for _ in range(40)]
    texts = [prose(rng, 20) + f" token = '{h}' " + prose(rng, 5) for h in hexes[:30]]
    texts += [f"PassWord:{h[:18]} {prose(rng, 9)} {k}, é\U0001f600 {k}" for h, k in zip(hexes[30:], keys)]
    texts += [f"call {4000000000000000 + i * 7919} or mail{i}.example.com {prose(rng, 5)}" for i in range(60)]
    texts += [f"left alone: {hexes[1][:20]}", f"api_key=abc.. AKIASHORT {hexes[2]} secret: x", "ſecret=abcdefgh toKen=abcdefgh",
              None, "", "a" * 30, "f" * 24, "token=" * 50, "0123456789abcdef" * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("spans", F.lit(1))
    automata = secret_scan.learn(df)
    got = {r.doc_id: r for r in secret_scan.digests(secret_scan.scan(df, automata)).collect()}
    for i, t in enumerate(texts):
        want = []
        for k, pattern, group, least in BASE:
            for m in re.finditer(pattern, t or "", re.ASCII | (re.IGNORECASE if k == 0 else 0)):
                if len(m[group]) >= least:
                    want.append((m.start(), k, m.end()))
        text = ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in sorted(want))
        r = got[i]
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for _, k, _ in want) for x in range(3))
        assert set(filter(None, text.split(","))) <= set(r.spans.split(","))
    first = len(hexes) + 60
    assert got[first].n_format == 1                                     # a bare credential of a learned format
    assert not any(got[i].n_format for i in range(len(hexes), first))   # numbers and hosts are not
    assert secret_scan.scan(none, secret_scan.learn(none)).count() == 0


def test_automaton_is_a_distribution_and_merges_states():
    rng = random.Random(8)
    a = secret_scan.Automaton([secret_scan.classes("".join(rng.choice("0123456789abcdef") for _ in range(rng.randint(20, 40))))
                               for _ in range(300)])
    assert len(a.next) < 60
    for logs, end in zip(a.log, a.log_end):
        assert sum(map(math.exp, logs.values())) + math.exp(end) == pytest.approx(1)
    assert secret_scan.Automaton([]).log_likelihood("0a") < 0


def test_decontamination_finds_what_brute_force_finds(spark, docs, none):
    rng = random.Random(9)
    items = [(i, prose(rng, 25) + ". " + prose(rng, 8) + f" answer{i}.") for i in range(30)]
    items += [(30, None), (31, ""), (32, items[3][1]), (None, prose(rng, 20) + " nowhere.")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit("x"))
    planted = [(9000 + i, prose(rng, 150) + " " + items[i][1] + " " + prose(rng, 90)) for i in range(12)]
    half = [(9100 + i, prose(rng, 50) + " " + items[i][1][:60] + " " + prose(rng, 50)) for i in range(5)]
    df = docs.select("doc_id", "text", "lang").unionByName(
        spark.createDataFrame([(*r, "en") for r in planted + half], "doc_id long, text string, lang string"))
    found = {(r.doc_id, r.item_id) for r in decontaminate.matches(df, bench).collect()}
    want = {(9000 + i, i) for i in range(12)} | {(9003, 32)}
    assert found == want
    kept = decontaminate.drop_contaminated(df, bench)
    assert kept.columns == df.columns and kept.count() == df.count() - 12
    assert decontaminate.matches(none, bench).count() == 0
    assert decontaminate.matches(df, bench.limit(0)).count() == 0
    assert decontaminate.drop_contaminated(df, bench.limit(0)).count() == df.count()


def test_several_shards_find_the_same(spark, docs, monkeypatch):
    items = [(i, t) for i, t in corpus() if t and len(t) > 100][:20]
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(str, decontaminate.matches(docs, bench).drop("passage").collect()))
    monkeypatch.setattr(decontaminate, "SHARD_POSTINGS", 100)
    assert len(list(decontaminate.build_indexes(bench))) > 1
    again = decontaminate.matches(docs, bench)
    assert {(r.doc_id, r.item_id) for r in again.collect()} and len(whole) == again.count()


def test_wand_returns_all_above_the_threshold(spark):
    rng = random.Random(3)
    items = [{"item_id": i, "text": t, "words": decontaminate.words(t)} for i, t in enumerate(prose(rng, rng.randint(3, 60)) for _ in range(90))]
    items.sort(key=lambda r: len(r["words"]))
    counts = Counter(w for r in items for w in set(r["words"]))
    lengths = [len(r["words"]) for r in items]
    index = decontaminate._index(items, counts, len(items), sum(lengths) / len(items), 2 * max(lengths))
    for _ in range(60):
        query = sorted({index.terms[w] for w in decontaminate.words(prose(rng, 40)) if w in index.terms})
        for threshold in (0.3, 0.5, 0.8):
            live = index.block_bounds(np.zeros(len(query), int), np.array(query), 1)[0] >= threshold - index.common_most - 1e-9
            scores = Counter()
            for t in query:
                for item, gain in zip(index.postings[t], index.impacts[t]):
                    scores[item] += gain
            want = {i for i, s in scores.items() if s >= threshold + 1e-9}
            assert want <= {i for i, _ in index.above(query, threshold, live)} <= {
                i for i, s in scores.items() if s >= threshold - 1e-9}


def test_values_of_both_depths_travel_once_as_files_and_batches_are_small(spark, docs, monkeypatch):
    learn, seen, files = token_contexts.learn, [], []
    made = token_contexts.Mapped
    monkeypatch.setattr(token_contexts, "learn", lambda *a: seen.append((a[3], learn(*a))) or seen[-1][1])
    monkeypatch.setattr(token_contexts, "Mapped", lambda session, array: files.append(array) or made(session, array))
    suffix_tree_lm.score_texts(docs, F.lit(True))
    ((_, (seldom, travelling, _)),) = seen
    assert seldom is None and len(travelling) == 2 and all(x.files for x in travelling if len(x))
    assert len(files) == 3 * sum(len(x) > 0 for x in travelling)  # where to look, keys and values: nothing travels twice
    assert len(pickle.dumps(travelling)) < 4000
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) < 1 << 23


def test_words_are_hashed_once_for_their_numbers_and_keys(monkeypatch):
    words, calls, hashes = pa.array(["", "a", "bc", "é" * 70, "none"]), [], token_contexts.hashes
    common = suffix_tree_lm.Common(words.slice(0, 4), np.ones(4, np.int64))
    for module in (token_contexts, suffix_tree_lm):
        monkeypatch.setattr(module, "hashes", lambda x: calls.append(x) or hashes(x))
    keys = common.keys(words)
    assert len(calls) == 1 and keys[:4].tolist() == [1, 2, 3, 4] and keys[4] == hashes(words)[4]
    assert [hashes(words.slice(i, 1))[0] for i in range(5)] == hashes(words).tolist()
