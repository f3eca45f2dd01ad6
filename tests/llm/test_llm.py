"""Operators of the llm subpackage against brute-force versions and on odd rows."""

import hashlib
import itertools
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from traitloom.llm import ann, chat, decontam, langid, licenses, near_dup, packing, quality, suffix_dedup, suffix_tree_lm
from traitloom.llm.common import written
from traitloom.llm.components import connected

SF = "/root/testdata/sf0.001"
ODD = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, " \n\t ", None, "s", 4), (4, "word", "en", None, 4), (None, "no id here at all", "en", "s", 5), (6, "same text twice in a row", "en", "s", 9), (6, "same text twice in a row", "en", "s", 9), (7, "lone " * 3000, "en", "s", 15000)]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def odd(spark):
    extra = ["digest", "cls", "n", "v", "root", "start", "spans", "items", "score", "block", "kind"]
    df = spark.createDataFrame(ODD, SCHEMA)
    return df.select("*", *[F.lit(7).alias(c) for c in extra])


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts(docs):
    return {r.doc_id: (r.text or "").encode() for r in docs.select("doc_id", "text").collect()}


# 1


def tokenizer():
    public = pytest.importorskip("public_tokenizers")
    return public.path("byte_bpe_50k.json")


def test_ids_equal_the_files_own_tokenizer(docs):
    from tokenizers import Tokenizer

    own, fast = Tokenizer.from_file(tokenizer()), packing.ByteTokenizer(tokenizer())
    cases = [t.decode() for t in texts(docs).values()] + ["", " ", "a  b", "it's\n\n x\t\ty ", "<|endoftext|> hi", " " * 9000 + "x", "a b 　c 12 3.4", "\U0001f600é"]
    for c in cases:
        assert np.frombuffer(fast.encode(c), "<u4").tolist() == own.encode(c, add_special_tokens=False).ids


def test_tree_takes_the_tightest_window():
    rng = random.Random(1)
    for _ in range(50):
        lengths = [rng.randint(1, 64) for _ in range(rng.randint(1, 60))]
        got = packing.best_fit_decreasing(lengths, 64)
        rooms = []
        for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):  # brute force: scan all open windows
            fits = [r for r in rooms if r >= lengths[i]]
            if fits:
                rooms[rooms.index(min(fits))] -= lengths[i]
            else:
                rooms.append(64 - lengths[i])
        assert 1 + max(w for w, _ in got) == len(rooms)
        used = {}
        for (w, o), n in sorted(zip(got, lengths, strict=True)):
            assert used.get(w, 0) == o
            used[w] = o + n
        assert max(used.values()) <= 64


def test_packing_is_a_round_trip(spark, docs, odd, empty):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokenizer())
    for df in (docs, odd):
        rows = packing.pack(df, tokenizer(), block_tokens=20_000).collect()
        by_doc, by_sequence = {}, {}
        for r in rows:
            by_doc.setdefault(r.doc_id, []).append(r)
            by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for places in by_sequence.values():
            assert sum(n for _, n in places) <= 1024
            assert all(a[0] + a[1] == b[0] for a, b in itertools.pairwise(sorted(places))) and min(places)[0] == 0
        for d in df.select("doc_id", "text").distinct().collect():
            want = own.encode(d.text or "", add_special_tokens=False).ids + [0]
            pieces = sorted({(r.start, bytes(r.ids)) for r in by_doc[d.doc_id]})
            assert np.frombuffer(b"".join(p for _, p in pieces), "<u4").tolist() == want
    assert packing.pack(empty, tokenizer()).count() == 0


# 2


def test_backpropagation_matches_differences():
    net = langid.ByteTagger(["a", "b", "c"], hidden=3, span=5)
    net.params = {k: v.astype(np.float64) for k, v in net.params.items()}
    x = np.array([[97, 98, 99, 100, 101], [5, 6, 7, langid.PAD, langid.PAD]], np.uint16).T.copy()
    y = np.array([0, 2])

    def loss():
        f, b = net.states(x, ">").astype(float), net.states(x, "<").astype(float)
        real = x != langid.PAD
        return -sum(np.log(net.probabilities(f[t], b[t])[y[i], i]) for t in range(5) for i in range(2) if real[t, i]) / real.sum()

    grads = net.gradients(x, y)
    rng = np.random.default_rng(1)
    for k, g in grads.items():
        for _ in range(6):
            at = (rng.integers(g.shape[0]), x.ravel()[rng.integers(8)] if k[0] == "W" else rng.integers(g.shape[1]))
            old = net.params[k][at]
            step = 1e-2
            net.params[k][at] = old + step
            up = loss()
            net.params[k][at] = old - step
            down = loss()
            net.params[k][at] = old
            assert g[at] == pytest.approx((up - down) / (2 * step), abs=2e-3)


def test_language_of_held_out_and_odd_texts(docs, odd, empty):
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = langid.fit(docs.where(~held))
    rows = langid.predict(docs.where(held), model, more=(F.col("lang"),)).collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) >= 0.9
    got = [(r.doc_id, r.lang_pred) for r in langid.predict(odd, model).collect()]
    assert len(got) == len(ODD) and {x for i, x in got if i in (1, 2, 3)} == {"und"}
    assert langid.fit(empty) is None and {r.lang_pred for r in langid.predict(odd, None).collect()} == {"und"}
    kept = langid.keep_identified(odd, model)
    assert kept.columns == odd.columns and not {1, 2, 3} & {r.doc_id for r in kept.collect()}
    assert langid.predict(empty, model).count() == 0


# 3


def components_by_brute_force(rows, words, least):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]) - 1e-9:
            parent[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    return [min([x for x in groups[find(i)] if x is not None], default=None) for i in range(len(rows))], [len(s) for s in sets]


@pytest.mark.parametrize("words", [2, 5])
def test_components_match_all_pairs(spark, docs, words):
    rng = random.Random(words)
    base = [[f"w{rng.randint(0, 60)}" for _ in range(rng.randint(3, 60))] for _ in range(12)]
    rows = []
    for i in range(160):
        t = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            t[rng.randrange(len(t))] = f"w{rng.randint(0, 60)}"
        rows.append((i, " ".join(t)))
    rows += [(1000 + r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want, sizes = components_by_brute_force(rows, words, 0.8)
    for options in ({}, {"frequent_local": 1, "frequent_total": 2, "crowded": 0.0}):
        got = {r.doc_id: (r.component_id, r.n_shingles) for r in near_dup.link(spark.createDataFrame(rows, "doc_id bigint, text string"), words=words, least=0.8, **options).collect()}
        assert [got[i] for i, _ in rows] == list(zip(want, sizes, strict=True))


def test_near_dup_odd_rows(odd, empty):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_dup.link(odd, words=2).collect()), key=str)
    assert len(got) == len(ODD) and (1, 0, 1) in got and (4, 1, 4) in got and got.count((6, 5, 6)) == 2 and (7, 1, 7) in got
    assert near_dup.link(empty).count() == 0


def test_label_propagation_on_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(200, 100), (100, 150)], "a bigint, b bigint")
    got = {r.node: r.root for r in connected(edges).collect()}
    assert {got[i] for i in range(61)} == {0} and {got[i] for i in (100, 150, 200)} == {100}


# 4


def test_attention_gradients_match_differences():
    net = quality.AttentionBag(hidden=4, attention=3)
    net.params = {k: v.astype(np.float64) for k, v in net.params.items()}
    x = quality.encode([b"one two three", b"!!! ???", b"a a a a", b""]).astype(float)
    starts, y, weight = np.array([0, 3]), np.array([1.0, 0.0]), np.array([1.0, 2.0])

    def loss():
        s = net.forward(x, starts)["score"]
        return float((-(y * np.log(s) + (1 - y) * np.log(1 - s)) * weight).mean())

    rng = np.random.default_rng(2)
    for k, g in net.gradients(x, starts, y, weight).items():
        flat = net.params[k].reshape(-1)
        for i in rng.choice(flat.size, min(8, flat.size), replace=False):
            old = flat[i]
            flat[i] = old + 1e-5
            up = loss()
            flat[i] = old - 1e-5
            down = loss()
            flat[i] = old
            assert g.reshape(-1)[i] == pytest.approx((up - down) / 2e-5, abs=1e-5)


def test_quality_of_held_out_documents(spark, odd, empty):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = quality.fit(docs, labels.where(~held))
    rows = quality.score(docs.where(held), model).join(labels, "doc_id").collect()
    assert np.mean([(r.score >= 0.7) == (r.quality == 1) for r in rows]) >= 0.9
    got = quality.score(odd, model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert quality.fit(docs, labels.where("false")) is None and quality.score(odd, None).first().score == 0.5
    # a text scores alike in any company
    t = [b"x y z " * 300, b"", b"short"]
    assert np.allclose(model.scores(t), [model.scores([x])[0] for x in t], atol=1e-6)


# 5


def test_recall_and_exact_scores(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = e.select("vec_id", "embedding").collect()
    x = np.array([r.embedding for r in rows], float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    at = {r.vec_id: i for i, r in enumerate(rows)}
    got = {}
    for r in ann.search(e, F.col("vec_id") % 10 == 0, block_queries=9).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = 0
    for q, found in got.items():
        s = u @ u[at[q]]
        s[at[q]] = -2
        best = np.argsort(-s, kind="stable")[:5]
        hits += len({rows[i].vec_id for i in best} & {v for _, v, _ in found})
        assert [r for r, _, _ in sorted(found)] == [1, 2, 3, 4, 5] and all(abs(s[at[v]] - c) < 1e-12 for _, v, c in found)
    assert hits / (5 * len(got)) >= 0.9


def test_vectors_that_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [float("inf"), 1.0]), (8, [1.0]), (9, [0.0, 2.0]), (9, [0.0, 2.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in ann.search(df, F.col("vec_id").isin(0, 3, 4, 9)).collect())
    assert got == [(0, 1, 1), (0, 2, 2), (0, 3, 9), (9, 1, 0), (9, 2, 1), (9, 3, 2)]
    assert ann.search(df.where("false"), F.col("vec_id") >= 0).count() == 0


# 6


def test_repairs_cost_as_much_however_they_are_cut():
    rng = random.Random(4)
    for _ in range(300):
        roles = [rng.choice(["system", "user", "assistant", None]) for _ in range(rng.randint(1, 7))]
        path = chat.repair(roles)
        cost, state = 0, chat.START
        for r, (s, action, inserted) in zip(roles, path, strict=True):
            cost += min(c for a, b, c, act, ins in chat.OPTIONS[r] if (a, b, act, ins) == (state, s, action, inserted))
            state = s
        cut = rng.randint(0, len(roles))
        m = chat.compose(chat.stretch_matrix(roles[:cut]), chat.stretch_matrix(roles[cut:]))
        assert m[chat.START].min() == cost


def test_rendering_is_the_same_however_it_is_cut(spark):
    rows = [("a", 0, "user", "hi"), ("a", 1, "user", "again"), ("a", 2, "assistant", "yes <|im_end|>"), ("b", 0, "assistant", "hello"), ("b", 1, "bot", "?"), (None, None, None, None)]
    rows += [("long", i, ["user", "assistant", "assistant"][i % 3], f"t{i}") for i in range(200)]
    df = spark.createDataFrame(rows, "conv_id string, turn bigint, role string, text string")

    def joined(n):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            out = {}
            for r in sorted(chat.format_chats(df).collect(), key=lambda r: r.ordinal):
                out.setdefault(r.conv_id, []).append(r.piece)
            return {k: "".join(v) for k, v in out.items()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")

    whole = joined(1)
    assert whole["a"] == "<|im_start|>user\nhi\nagain<|im_end|>\n<|im_start|>assistant\nyes <| im_end|><|im_end|>\n"
    assert joined(9) == whole
    assert chat.format_chats(df.where("false")).count() == 0


# 7


def hits_by_brute_force(text, items, n):
    w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())
    hit, names = set(), set()
    for name, item in items:
        v = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (item or "").encode().lower())
        m = min(n, len(v))
        for i in range(len(v) - m + 1 if m else 0):
            for j in range(len(w) - m + 1):
                if w[j : j + m] == v[i : i + m]:
                    hit.update(range(j, j + m))
                    names.add(name)
    return len(w), hit, sorted(names)


@pytest.mark.parametrize("block", [32 << 20, 60])
def test_windows_match_brute_force(spark, odd, block):
    rng = random.Random(5)
    words = ["Alpha", "beta", "gamma,", "été", "d4", "x-y"]
    items = [(str(i), " ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 5, 12])))) for i in range(3, 12)] + [("e", ""), ("nul", None)]
    items = [x for x in items if len((x[1] or "").split()) != 1]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 3, 30])))) for i in range(40)] + [(90, None)]
    bench = spark.createDataFrame([*items, (None, "alpha beta")], "item_id string, text string")
    got = {r.doc_id: r for r in decontam.annotate(spark.createDataFrame(rows, "doc_id bigint, text string"), bench, n=4, max_block_bytes=block).collect()}
    for i, t in rows:
        n, hit, names = hits_by_brute_force(t, items, 4)
        r = got[i]
        assert (r.n_words, {k for s in r.spans for k in range(s.start, s.stop)}, list(r["items"])) == (n, hit, names)
        assert all(a.stop < b.start for a, b in itertools.pairwise(r.spans))
    kept = decontam.clean(odd, spark.createDataFrame([("1", "same text twice")], "item_id string, text string"), max_block_bytes=block)
    assert kept.columns == odd.columns and kept.count() == len(ODD) - 2
    assert decontam.annotate(odd, bench.where("false")).where("size(spans) > 0").count() == 0


# 8


def test_phrases_match_brute_force(spark, odd):
    lines = ["MIT License mit-license", "the GNU General Public License, v3", "cc by CC-BY-NC 4.0", "apache license", "nothing", "gnu general mit license public license"]
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(lines) for _ in range(rng.randint(0, 5)))) for i in range(60)]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for i, t in rows:
        w = re.findall(r"[0-9a-z]+", t.lower())
        want = sorted((k, label) for p, label in licenses.BASE_PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        assert (got[i].n_words, [(p.word, p.label) for p in got[i].places]) == (len(w), want)
    assert licenses.scan_licenses(odd).count() == len(ODD)


def test_licence_expressions():
    value = lambda t: licenses.evaluate(licenses.postfix(t))
    assert value("MIT OR Apache-2.0 AND BSD-3-Clause */") == ("permissive", {"mit", "apache-2.0", "bsd-3-clause"})
    assert value("MIT OR GPL-3.0-only AND BSD-3-Clause") == ("permissive", {"mit"})
    assert value("(MIT OR GPL-3.0-only) AND LGPL-2.1") == ("weak-copyleft", {"mit", "lgpl-2.1"})
    assert value("GPL-2.0-only WITH Classpath-exception-2.0 OR AGPL-3.0") == ("weak-copyleft", {"gpl-2.0-only with classpath-exception-2.0"})
    assert value("((MIT))") == ("permissive", {"mit"}) and value("My-Own AND MIT")[0] == "restricted" and value("cc-by-sa-4.0")[0] == "copyleft"
    assert licenses.postfix("MIT and more text") == ["MIT", "more", "AND"] and licenses.postfix("AND") is None and licenses.postfix("(MIT") is None
    assert licenses.postfix("MIT OR ISC) AND X") == ["MIT", "ISC", "OR"] and licenses.postfix("MIT OR (ISC AND") == ["MIT"]
    assert licenses.Scanner().scan(b"# SPDX-License-Identifier: MIT OR Zlib\n// spdx-license-identifier:GPL-2.0")[3] == ["gpl-2.0", "mit", "terms-copyleft", "terms-permissive", "zlib"]


# 9


def test_base_scores_match_counts(spark, docs, odd, empty):
    from collections import Counter
    from math import log10

    for df, block in ((docs, 20_000), (odd, 16 << 20)):
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        words = lambda t: [*(t or "").encode().lower().split(), None]
        trains = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 != 2
        c = Counter(w for i, t in rows if trains(i) for w in words(t))
        n, v = sum(c.values()), len(c)
        use = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2
        got = sorted(((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in suffix_tree_lm.score(df, use, block_bytes=block).collect()))
        want = sorted((str(i), len(words(t)), sum(c[w] > 0 for w in words(t)), n, round(sum(log10((c[w] + 1) / (n + v + 1)) for w in words(t)), 6)) for i, t in rows)
        assert got == want
    assert suffix_tree_lm.score(empty, F.lit(True)).count() == 0


def test_tree_walk_matches_longest_suffixes():
    rng = np.random.default_rng(7)
    seen = [[b"the", b"cat", b"sat"], [b"the", b"hat"], [b"", b"that"]]
    symbols, _, counts = suffix_tree_lm.stream([w for w in seen for _ in range(3)])
    code, n = np.unique(suffix_tree_lm.grams(symbols, counts), return_counts=True)
    contexts = {}
    for d in range(1, suffix_tree_lm.DEPTH + 1):
        for c, k in zip(code.tolist(), n.tolist(), strict=True):
            key = (d, (c >> suffix_tree_lm.BITS) & ((1 << suffix_tree_lm.BITS * d) - 1))
            contexts.setdefault(key, {}).setdefault(c & 63, 0)
            contexts[key][c & 63] += k
    root = {}
    for c, k in zip(code.tolist(), n.tolist(), strict=True):
        root[c & 63] = root.get(c & 63, 0) + k
    kept = {k: v for k, v in contexts.items() if rng.random() < 0.5}
    tree = suffix_tree_lm.SuffixTree(root, kept)

    def probability(history, x):
        p = (np.array([root.get(i, 0) for i in range(suffix_tree_lm.N_SYMBOLS)]) + 1) / (sum(root.values()) + suffix_tree_lm.N_SYMBOLS)
        # the state is the longest suffix that is in the tree, with its ancestors' smoothing on the way
        names = {(0, 0)} | set(kept)
        todo = list(names)
        while todo:
            d, c = todo.pop()
            if d:
                for o in ((d - 1, c >> 6), (d - 1, c & ((1 << 6 * (d - 1)) - 1))):
                    if o not in names:
                        names.add(o)
                        todo.append(o)
        for d in range(1, suffix_tree_lm.DEPTH + 1):
            c = 0
            for s in history[-d:]:
                c = c << 6 | int(s)
            if (d, c) not in names:
                break
            n = np.array([kept.get((d, c), {}).get(i, 0) for i in range(suffix_tree_lm.N_SYMBOLS)])
            p = (n + 4 * p) / (n.sum() + 4)
        return np.log10(p[x] / suffix_tree_lm.SIZES[x])

    for words in ([b"the", b"cat"], [b"zz9", b"hat"], []):
        s, _, c = suffix_tree_lm.stream([words])
        want = sum(probability(s[:i], s[i]) for i in range(len(s)) if c[i])
        assert tree.scores([words], window=3)[0] == pytest.approx(want, abs=1e-4)


def test_all_contexts_that_pass_the_test_score(spark):
    """More than 25,000 contexts pass; scores equal a walk of the whole tree, with texts dealt into blocks and without."""
    rng = np.random.default_rng(11)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)
    lines = [b" ".join(letters[rng.integers(0, 26, 9)].tobytes() for _ in range(100)) for _ in range(36)]
    rows = [(i, t.decode()) for i, t in enumerate(lines * 24)] + [(-1, "held out words zz"), (-2, None)]
    symbols, _, counts = suffix_tree_lm.stream([t.split() for t in lines * 24])
    codes, n = np.unique(suffix_tree_lm.grams(symbols, counts), return_counts=True)
    below, kept = {}, {}
    for d in range(suffix_tree_lm.DEPTH + 1):
        level = {}
        for c, k in zip(codes.tolist(), n.tolist(), strict=True):
            own = level.setdefault((c >> 6) & ((1 << 6 * d) - 1), {})
            own[c & 63] = own.get(c & 63, 0) + k
        for context, own in level.items() if d else ():
            m, all_own = below[context & ((1 << 6 * (d - 1)) - 1)], sum(own.values())
            gain = sum(k * np.log((k / all_own) / (m[x] / sum(m.values()))) for x, k in own.items())
            if all_own >= 8 and gain >= 12:
                kept[d, context] = own
        below, root = level, level[0] if not d else root
    assert len(kept) > 25_000
    sample = [0, 7, 35, len(rows) - 2, len(rows) - 1]
    want = suffix_tree_lm.SuffixTree(root, kept).scores([(rows[i][1] or "").encode().split() for i in sample])
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for block in (16 << 20, 100_000):
        got = {r.doc_id: r.score for r in suffix_tree_lm.score(df, F.col("doc_id") >= 0, block_bytes=block).collect()}
        assert [got[rows[i][0]] for i in sample] == pytest.approx(want.tolist(), abs=1e-2)


# 10


def repeats_by_brute_force(rows, size):
    seen = {}
    for t in rows:
        for i in range(len(t) - size + 1):
            seen[t[i : i + size]] = seen.get(t[i : i + size], 0) + 1
    out = []
    for t in rows:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - size + 1):
            if seen[t[i : i + size]] > 1:
                gone[i : i + size] = True
        gone = gone[:-1]
        out.append((int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), bytes(np.frombuffer(t, np.uint8)[~gone])))
    return out


def test_two_stage_order_matches_sorting():
    rng = random.Random(8)
    for _ in range(200):
        data = bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 70))) * rng.randint(1, 2)
        for depth in (5, 200):
            order = suffix_dedup.two_stage_order(data, depth).tolist()
            keys = [data[i : i + depth] for i in order]
            assert keys == sorted(keys) and sorted(order) == list(range(len(data)))


@pytest.mark.parametrize("group", [6000, 3])
def test_removed_bytes_match_brute_force(spark, group):
    rng = random.Random(9)
    letters = "abcdefghij é"
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    passages = [word(rng.randint(60, 300)) for _ in range(5)]
    rows = [word(rng.randint(0, 200)) + rng.choice(passages)[rng.randint(0, 30) :] + word(rng.randint(0, 200)) for _ in range(60)]
    rows += ["", rows[0], rows[0], "ab" * 200, "x" * 300, passages[0] + passages[0], None]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    found = {bytes(r.digest): r.spans for r in suffix_dedup.find(df, size=80, group_contexts=group).collect()}
    want = repeats_by_brute_force([(t or "").encode() for t in rows], 80)
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(df, size=80).collect()}
    for i, (n, runs, kept) in enumerate(want):
        s = found.get(hashlib.md5((rows[i] or "").encode()).digest(), [])
        assert (sum(x.stop - x.start for x in s), len(s)) == (n, runs)
        assert bytes(got[i].kept) == kept
    for r in suffix_dedup.remove_repeats(df, size=80, whole_characters=True).collect():
        bytes(r.kept).decode()


def test_suffix_dedup_odd_rows(odd, empty):
    done = suffix_dedup.remove_repeats(odd, size=80)
    assert done.columns[:-3] == odd.columns and done.count() == len(ODD)
    assert suffix_dedup.remove_repeats(empty).count() == 0


# pipeline


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_pipeline_keeps_what_it_should(spark, docs):
    import corpus_pipeline

    d, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, d, SF)
        if name != "packing":
            assert out.columns == columns
            out = written(out)
        d = out
    assert d.count() > 0
    bench = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    assert bench


def test_pipeline_cuts_short_passages_of_over_fifty_words(spark):
    """A repeat of 51 words in 101 bytes goes; one of 50 words, and the same words with another blank between, stay."""
    import corpus_pipeline

    rng = random.Random(12)
    passage = lambda n: " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    far, near, spaced, alone = passage(51), passage(50), passage(51), passage(51)
    texts = [f"Alphaaaa {far} Betaaaaa", f"Gammaaaa {far}", f"Deltaaaa {near} Epsilonn", f"Zetaaaaa {near}", f"Etaaaaaa {spaced}", f"Thetaaaa {spaced.replace(' ', '  ', 1)}", alone, alone]
    assert len(far) == 101
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in corpus_pipeline.repeated_passages(spark, df, SF).collect()}
    assert got == {0: "Alphaaaa  Betaaaaa", 1: "Gammaaaa ", **{i: texts[i] for i in range(2, 6)}}


def test_one_row_of_each_component_passes_both_stages(spark):
    """Repeated rows, null-id copies and one id for different texts: a text stays once, and isn't cut as its own copy."""
    import corpus_pipeline

    rng = random.Random(13)
    a, b, c, d, e = (" ".join(f"{chr(97 + k)}{rng.randint(0, 10**6)}" for _ in range(60)) for k in range(5))
    rows = [(1, a), (1, a), (2, b), (None, b), (None, c), (None, c), (3, d), (4, d), (4, e), (1, a), (9, None), (9, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    one = corpus_pipeline.near_duplicates(spark, df, SF)
    assert one.columns == df.columns
    left = corpus_pipeline.repeated_passages(spark, written(one.where("length(text) > 0")), SF)
    want = sorted([(1, a), (2, b), (None, c), (3, d), (4, e)], key=str)
    assert sorted(map(tuple, left.collect()), key=str) == want
    assert one.count() == len(want) + 2
