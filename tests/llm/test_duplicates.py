"""Exact, near and passage duplicates, near vectors, against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marlstone.llm import exact_dedup, shingle_join, suffix_dedup, vector_join
from marlstone.llm.common import connected_components

DOC = "doc_id long, text string, h string, norm string"


def docs(spark, texts, parts=3):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], DOC).repartition(parts)


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randint(100, 300), rng.randint(100, 300)) for _ in range(150)] + [(7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r["id"]: r["component_id"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("colliding", [False, True])
def test_exact(spark, colliding):
    rng = random.Random(4)
    texts = ["", None, " \n", "a b", "ab", "a\tb ", "A b", "é  e", "x" * 5000, "x" * 4999 + " x"] + [rng.choice(["p q", "pq", "p  q", "r", "s t"]) for _ in range(60)]
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)] + [(3, "a b", "x", "y"), (None, "ab", None, None)]
    df = spark.createDataFrame(rows, DOC).repartition(4)
    key = F.shiftleft(F.xxhash64("norm") % 2, 62) if colliding else None
    got = exact_dedup.exact_dedup(df, key=key, depth=6, capacity=5).collect()
    norm = lambda t: (t or "").translate(dict.fromkeys((9, 10, 11, 12, 13, 32)))
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), i is None, i or 0, i))
    text_of = {hashlib.sha256(k.encode()).hexdigest(): k for k in groups}
    assert len(got) == len(rows)
    for r in got:
        g = groups[text_of[r["text_sha256"]]]
        assert r["group_size"] == len(g) and r["keep_id"] == min(g)[3]
    assert sum(r["kept"] for r in got) == len(groups)
    chains = {(r["text_sha256"], r["chain"]) for r in got}
    assert len(chains) == len(groups) and (max(c for _, c in chains) > 2) == colliding
    assert len({r["bucket"] for r in got}) > 1
    assert exact_dedup.exact_dedup(df.limit(0)).count() == 0


def test_exact_with_a_hot_text_and_a_very_long_one(spark):
    long = "ab " * 400_000
    rows = [(i, "hot  text" if i % 3 else "hot text", "x", "y") for i in range(900)] + [(i, f"own {i}", "x", "y") for i in range(900, 1000)] + [(2000, long, "x", "y"), (2001, long.replace(" ", ""), "x", "y")]
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(spark.createDataFrame(rows, DOC).repartition(7), capacity=20).collect()}
    assert {(r["keep_id"], r["group_size"]) for i, r in got.items() if i < 900} == {(1, 900)}
    assert got[2001]["keep_id"] == 2000 and not got[2001]["kept"] and sum(r["kept"] for r in got.values()) == 102


def test_directory_splits(spark):
    rng = random.Random(1)
    keys = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(3000)] + [5] * 400 + [rng.randrange(1 << 50) for _ in range(300)]
    buckets = exact_dedup.split_buckets(spark.createDataFrame([(k,) for k in keys], "h long"), 24, 50)
    depth, slots = exact_dedup.directory(buckets)
    assert [s for s, *_ in slots] == list(range(1 << depth))  # the buckets cover all keys
    for prefix, local in buckets:
        inside = [k for k in keys if (k % (1 << 64)) >> (64 - local) == prefix] if local else keys
        assert len(inside) <= 50 or len(set(inside)) == 1 or local == 24
    assert len({d for _, d in buckets}) > 3
    assert exact_dedup.directory(exact_dedup.split_buckets(spark.createDataFrame([], "h long"), 24, 50)) == (0, [(0, 0, 0)])


def brute_components(texts):
    sets = [shingle_join.shingles((t or "").encode()) for t in texts]
    low = list(range(len(texts)))
    find = lambda x: x if low[x] == x else find(low[x])
    for i in range(len(sets)):
        for j in range(i):
            if len(sets[i]) and len(sets[j]) and shingle_join.similar(sets[i], sets[j]):
                a, b = find(i), find(j)
                low[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


def near_texts(chain):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choices(words, k=60))
    texts = ["", None, "  \n", "one two", "one  TWO", "a b c d", "a b c d e", passage]
    for _ in range(12):
        base = rng.choices(words, k=rng.choice([8, 30, 90, 300]))
        for _ in range(rng.choice([1, 2, 5])):
            copy = list(base)
            for _ in range(int(len(copy) * rng.uniform(0, 0.05))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            cut = int(len(copy) * rng.uniform(0, 0.2))
            texts.append(" ".join(copy[cut:]))
    texts += [" ".join(rng.choices(words, k=40)) + " " + passage for _ in range(25 if chain > 20 else 5)]
    base = rng.choices(words, k=120)
    for k in range(chain):  # a chain of near copies
        base[(7 * k) % 120] = f"v{k}"
        texts.append(" ".join(base))
    return texts


@pytest.mark.parametrize(("rounds", "large", "sketch", "chain"), [(3, 64, True, 70), (1, 1, False, 6), (1, 3, True, 30)])
def test_near(spark, rounds, large, sketch, chain):
    texts = near_texts(chain)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in shingle_join.jaccard_components(docs(spark, texts), rounds=rounds, large=large, sketch=sketch).collect()}
    assert got == brute_components(texts)


def cut_into_batches(rows, names, size=7):
    return [pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows[k : k + size], strict=True)], names=names) for k in range(0, len(rows), size)]


def told(found):
    return [(a, b) for x in found for a, b in zip(x["a"].to_pylist(), x["b"].to_pylist(), strict=True)]


def test_pairs_across_batches():
    rng = random.Random(3)
    members = {b: rng.sample(range(100), 40) for b in (5, 6)}
    rows = [(b, rep, rep % 3) for b, reps in members.items() for rep in reps]
    got = told(shingle_join._pairs(50)(iter(cut_into_batches(rows, ["bucket", "rep", "c"]))))
    assert set(got) == {(a, b) for reps in members.values() for a in reps for b in reps if a < b and (a - b) % 3}


def test_links_between_blocks_join_what_is_linked():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 100, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(100) > 0.12], rng.integers(0, 1 << 63, 5, dtype=np.uint64)])) for _ in range(60)]
    parts = np.array([i % 50 for i in range(60)])
    rows = []
    for i, s in enumerate(sets):
        for other in range(3):
            own = i % 3
            rows.append((9, min(own, other), max(own, other), 2 if own == other else 0 if own < other else 1, i, int(parts[i]), s.tobytes()))
    rows.sort(key=lambda r: r[:3])
    got = told(shingle_join._between(75)(iter(cut_into_batches(rows, ["cluster", "i", "j", "side", "rep", "c", "shingles"]))))

    def classes(links):
        low = list(range(60))
        find = lambda x: x if low[x] == x else find(low[x])
        for a, b in [*links, *((i, i - 50) for i in range(50, 60))]:
            a, b = find(a), find(b)
            low[max(a, b)] = min(a, b)
        return [find(i) for i in range(60)]

    every = [(i, j) for i in range(60) for j in range(i) if shingle_join.similar(sets[i], sets[j])]
    assert classes(got) == classes(every) and len(set(classes(every))) < 50 and all(shingle_join.similar(sets[a], sets[b]) for a, b in got)


def test_near_about_the_size_of_a_sketch(spark):
    texts = []
    for n, more in ((31, 10), (31, 8), (31, 9), (30, 10), (25, 8), (28, 9), (24, 8), (32, 10), (41, 13)):
        for k in range(12):  # n shingles, and a copy with words appended
            words = [f"{n}.{more}.{k}.{i}" for i in range(n + 4 + more)]
            texts += [" ".join(words[: n + 4]), " ".join(words)]
    for k in range(12):  # 31 and 39 shingles, 30 shared
        words = [f"s{k}.{i}" for i in range(43)]
        texts += [" ".join(["other", *words[1:35]]), " ".join(words)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in shingle_join.jaccard_components(docs(spark, texts)).collect()}
    want = brute_components(texts)
    assert got == want and sum(c != i for i, (_, c) in want.items()) == len(texts) // 2


def test_near_edges(spark):
    df = spark.createDataFrame([(1, "a b c", "x", "y"), (1, "a b c", "x", "y"), (2, "A  b c", None, None), (None, "a b c", None, None), (1, "other words", None, None)], DOC)
    got = sorted(((r["doc_id"], r["component_id"]) for r in shingle_join.jaccard_components(df).collect()), key=str)
    assert got == sorted([(1, 1), (1, 1), (2, 1), (None, None), (1, 1)], key=str)
    assert shingle_join.jaccard_components(df.limit(0)).count() == 0


def test_large_bucket_that_ends_one_row_into_a_batch():
    batches = [pa.RecordBatch.from_arrays([pa.array([7] * len(reps) + more, pa.int64()), pa.array([*reps, *range(50, 50 + len(more))], pa.int64())], names=["signature", "rep"]) for reps, more in ((range(6), []), ([6], [8, 8, 9]), ([], [10]))]
    got = {(b, r) for x in shingle_join._buckets(iter(batches), most=4) for b, r in zip(x["bucket"].to_pylist(), x["rep"].to_pylist(), strict=True)}
    assert got == {(7, r) for r in range(7)} | {(8, 50), (8, 51)}


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(3)
    tried = 0
    for _ in range(600):
        n = int(np.exp(rng.uniform(1, 7))) + 1
        a = rng.integers(0, 1 << 64, n, dtype=np.uint64)
        d = int(n / 7 * rng.uniform(0.8, 1))
        b = [np.concatenate([a[d:], rng.integers(0, 1 << 64, d, dtype=np.uint64)]), a[int(n * 0.25 * rng.uniform(0.8, 1)) :]][rng.integers(2)]
        a, b = np.unique(a), np.unique(b)
        both = np.unique(np.concatenate([a, b]))
        frequent = np.sort(rng.permutation(both)[: int(rng.choice([0, 0.3, 0.6, 0.9, 1]) * len(both))])
        if len(b) and shingle_join.similar(a, b) and len(np.setxor1d(a, b)):
            tried += 1
            assert len(np.intersect1d(shingle_join.signatures(a, frequent), shingle_join.signatures(b, frequent)))
    assert tried > 300


def brute_removal(texts, length):
    data = [(t or "").encode() for t in texts]
    counts = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if counts[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        out.append((len(d), len(d) - len(kept), sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return out


def test_passages(spark):
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("abcdefé ") for _ in range(n))
    p, q = text(70), text(45)
    texts = ["", None, "short", text(300), "z" * 200, p + text(5), p + p]
    texts += [text(rng.randint(0, 60)) + rng.choice([p, p[3:], q, p[:50], q + q]) + text(rng.randint(0, 60)) for _ in range(40)] + [texts[3], texts[3][2:]]
    df = docs(spark, texts)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(df, length=40, gram=8).collect()}
    assert got == dict(enumerate(brute_removal(texts, 40)))


def test_passage_edges(spark):
    t = "abcdefgh" * 6
    df = spark.createDataFrame([(1, t, "x", "y"), (1, t, "x", "y"), (None, "q" + t + "r", None, None)], DOC)
    got = suffix_dedup.remove_repeats(df, length=20, gram=8).collect()
    assert sorted(r["n_removed"] for r in got) == [48, 48, 48] and {bytes(r["kept"]) for r in got} == {b"", b"qr"}
    assert [list(s) for r in got if r["doc_id"] is None for s in r["spans"]] == [[1, 49]]
    assert suffix_dedup.remove_repeats(df.limit(0)).count() == 0


def test_long_texts_are_cut_into_chunks(spark, monkeypatch):
    rng = random.Random(1)
    big = "".join(rng.choice("abcdefgh") for _ in range(3 << 19))
    texts = [big[: 1 << 20] + "!" + big[1 << 20 :], "x" + big[1000 : (1 << 20) + 5000]]
    got = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.remove_repeats(docs(spark, texts)).collect()}
    assert got[0] == (1 << 20) + 5000 - 1000 and got[1] == got[0]


def brute_passages(texts, words, length):
    """The kept bytes, by words and by bytes."""
    data = [(t or "").encode() for t in texts]
    places = [[m.span() for m in re.finditer(rb"[^ \t\n\x0b\x0c\r]+", d)] for d in data]
    runs = [[tuple(d[a:b] for a, b in p[i : i + words]) for i in range(len(p) - words + 1)] for d, p in zip(data, places, strict=True)]
    by_word = Counter(r for doc in runs for r in doc)
    by_byte = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d, p, doc in zip(data, places, runs, strict=True):
        gone = bytearray(len(d))
        spans = [(i, i + length) for i in range(len(d) - length + 1) if by_byte[d[i : i + length]] > 1]
        spans += [(p[i][0], p[i + words - 1][1]) for i, r in enumerate(doc) if by_word[r] > 1]
        for a, b in spans:
            gone[a:b] = b"\1" * (b - a)
        out.append(bytes(x for x, g in zip(d, gone, strict=True) if not g))
    return out


def test_passages_of_short_words(spark):
    rng = random.Random(9)
    words = lambda n, most=4: [rng.choice("abcdefghé") * rng.randint(1, 2) + rng.choice("klmnop") * rng.randint(0, most - 2) for _ in range(n)]
    texts = ["", None, " \n", "a", "z " * 60, " ".join(words(30)) + "x" * 450, "x" * 450 + " y"]
    for n in (49, 50, 51, 52, 55, 60):
        p = words(n)
        texts += [" ".join(words(rng.randint(0, 40)) + ["u"] + p + ["v"] + words(rng.randint(0, 40))) for _ in range(2)] + ["  ".join(["q", *p[:-1], p[-1] + "!"])]
    p, q = words(51), words(51)
    texts += [" ".join([*p, *q]), "\t".join([*p, "w", *q]), " ".join(words(300, 9))]
    got = {r["doc_id"]: bytes(r["kept"]) for r in suffix_dedup.remove_passages(docs(spark, texts), keep=("h",)).collect()}
    want = brute_passages(texts, 51, 400)
    for i, w in enumerate(want):
        assert got[i].split() == w.split(), i
    assert max(len(" ".join(p).encode()), len(" ".join(q).encode())) < 300 and got[len(texts) - 1] == want[-1] == texts[-1].encode()
    assert suffix_dedup.remove_passages(docs(spark, texts).limit(0)).count() == 0


def test_pipeline_cuts_passages_of_51_short_words(spark):
    import corpus_pipeline

    rng = random.Random(12)
    words = lambda n: [rng.choice("abcdefgh") + rng.choice("klmnop") * rng.randint(0, 2) for _ in range(n)]
    rows, passages = [], {}
    for n in range(51, 61):
        passages[n] = " ".join(words(n))
        rows += [(10 * n + k, " ".join(words(20)) + f" u{n}{k} " + passages[n] + f" v{n}{k} " + " ".join(words(20)), "en", "s", 0) for k in range(2)]
    clean = [(k, " ".join(words(120)), "en", "s", 0) for k in range(20)]
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.cut_passages(spark, spark.createDataFrame(rows + clean, "doc_id long, text string, lang string, source string, n_chars long"), "").collect()}
    for i, text, *_ in rows:
        n = i // 10
        assert got[i] == text.replace(passages[n], "")
    assert all(got[i] == text for i, text, *_ in clean)


def test_vectors(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 8))
    rows = []
    for i in range(500):
        v = (centres[i % 12] + rng.normal(scale=0.12, size=8)) * rng.uniform(0.5, 3)
        rows.append((i, [float(x) for x in v], i % 3 if i % 17 else None))
    rows += [(500 + k, rows[k % 5][1], rows[k % 5][2]) for k in range(40)]
    rows += [(600, None, 1), (601, [0.0] * 8, 1), (602, [float("nan")] + [1.0] * 7, 1), (603, [None] + [1.0] * 7, 1), (604, [1.0] * 4, 1), (605, [2.0] * 4, 1), (606, [], 1), (607, [float("inf")] + [1.0] * 7, 1), (608, [1e-200] * 4, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vector_join.link_vectors(df, block=32, group=2).collect()}
    fine = [(i, np.array(v, float), g) for i, v, g in rows if g is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    low, links = {i: i for i, *_ in rows}, Counter()
    find = lambda x: x if low[x] == x else find(low[x])
    for a in range(len(fine)):
        for b in range(a):
            (i, v, g), (j, w, h) = fine[a], fine[b]
            v, w = v / np.abs(v).max(), w / np.abs(w).max()
            if g == h and len(v) == len(w) and v @ w / (np.sqrt(v @ v) * np.sqrt(w @ w)) >= 0.93:
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                low[max(x, y)] = min(x, y)
    assert got == {i: (links[i], find(i), find(i) == i) for i in low}
    assert vector_join.link_vectors(df.limit(0)).count() == 0


def test_vectors_with_clashing_columns_and_long_ones(spark):
    rng = np.random.default_rng(6)
    long = [float(x) for x in rng.normal(size=5000)]
    rows = [(1, long, "a", 1, 2, 3, 4), (2, [2 * x for x in long], "a", 1, 2, 3, 4), (3, long, "b", 1, 2, 3, 4), (4, long[::-1], "a", 1, 2, 3, 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string, rep int, unit int, weight int, block int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vector_join.link_vectors(df).collect()}
    assert got == {1: (1, 1, True), 2: (1, 1, False), 3: (0, 3, True), 4: (0, 4, True)}


def test_repeated_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 0), (1, [1.0, 2.0], 0), (None, [1.0, 2.0], 0)], "vec_id long, embedding array<double>, label int")
    got = sorted(((r["vec_id"], r["n_links"]) for r in vector_join.link_vectors(df).collect()), key=str)
    assert got == [(1, 1), (1, 1), (None, 0)]
