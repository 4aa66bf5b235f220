"""Tokenizing, packing and language-model scores."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marlstone.llm import bpe, context_mixing, packing

ODD = ["", " ", "  a  b ", "a\n b", "x<|endoftext|> y", "\x1c a \x1f b\x85 c\xa0 d", "it's we'll  'S", "é à̀ x ́y", "İ ǅ Σς", "日本語 テキスト 👩‍👩‍👧", "a b 　 c", "\t\t a\r\n", "<|startoftext|>x<|", "ﬃ ½ ²3", "x" * 5000, "l'été..a1b22 ÀÉ × ÷ ß"]
DOC = "doc_id long, text string, lang string, note string"


def random_texts(n, seed):
    rng = random.Random(seed)
    letters = list(" \n\t'ab1é\x1c\x85\xa0<|.,́ 日")
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def rows(texts):
    return [(i, t, None, "n") for i, t in enumerate(texts)]


def test_certain_cuts_lie_in_no_token():
    code = bpe.coder()
    a = random.Random(1).sample(sorted(a + b for a, followers in code.certain.items() for b in followers), 50)
    tokens = set(code.tokenizer.get_vocab())
    assert not any(pair in token for pair in a for token in tokens)


def test_bpe_equals_the_tokenizer():
    code, tok = bpe.coder(), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in ODD + random_texts(1500, 2):
        ids = tok.encode(text, add_special_tokens=False).ids
        assert code.encode(text) == ids
        assert code.decode(ids) == tok.decode(ids, skip_special_tokens=False)
    assert code.decode([200, 255, 1]) == tok.decode([200, 255, 1], skip_special_tokens=False)


def test_bpe_rows(spark):
    df = spark.createDataFrame([*rows(ODD), (None, None, None, None), (1, " ", None, None)], DOC)
    got = bpe.encode_decode(df).collect()
    assert len(got) == len(ODD) + 2
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in got:
        text = ODD[r["doc_id"]] if r["doc_id"] is not None else ""
        ids = tok.encode(text, add_special_tokens=False).ids
        assert (r["ids"], r["n_tokens"], r["ids_sha256"]) == (ids, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded"] == tok.decode(ids, skip_special_tokens=False) and r["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest()
    assert bpe.encode_decode(df.limit(0)).count() == 0


def test_words_equal_the_tokenizer():
    encode, tok = packing.encoder(packing.VOCABULARY), Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for text in ODD + random_texts(1500, 3):
        assert np.frombuffer(encode(text), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(4))
def test_plan_is_whole_and_tight(seed):
    rng = random.Random(seed)
    counts = Counter(min(2048, max(1, int(rng.lognormvariate(6 + seed / 4, 1)))) for _ in range(3000))
    plan = packing.plan(dict(counts), 2048)
    placed = Counter()
    for pattern, n in plan:
        assert sum(pattern) <= 2048 and sum(x > 2048 / 3 for x in pattern) <= 2
        for x in pattern:
            placed[x] += n
    assert placed == counts
    # No better than the least possible and no worse than first fit, longest first.
    gaps = []
    for x in sorted(counts.elements(), reverse=True):
        k = next((k for k, g in enumerate(gaps) if g >= x), None)
        if k is None:
            gaps.append(2048 - x)
        else:
            gaps[k] -= x
    total = sum(n for _, n in plan)
    assert -(-sum(k * v for k, v in counts.items()) // 2048) <= total <= len(gaps) * 1.01 + 1


def test_packing(spark):
    rng = random.Random(5)
    texts = [*ODD, None, None, *(" ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.choice([1, 3, 20, 90, 300]))) for _ in range(120))]
    df = spark.createDataFrame([*rows(texts), (None, "no id", None, None)], DOC).repartition(3)
    got = packing.pack(df, capacity=128).collect()
    encode = packing.encoder(packing.VOCABULARY)
    docs, bins = defaultdict(list), defaultdict(list)
    for r in got:
        docs[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append(r)
    assert len(docs) == len(texts) + 1
    for i, parts in docs.items():
        parts.sort(key=lambda r: r["piece"])
        whole = encode((texts[i] or "") if i is not None else "no id") + b"\0\0\0\0"
        assert b"".join(r["ids"] for r in parts) == whole
        assert [r["start"] for r in parts] == [128 * k for k in range(len(parts))] and all(r["length"] == 128 for r in parts[:-1])
        assert all(r["ids_crc32"] == zlib.crc32(r["ids"]) for r in parts)
    for parts in bins.values():
        end = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == end
            end += r["length"]
        assert end <= 128
    assert packing.pack(df.limit(0)).count() == 0


def test_packing_of_repeated_rows_and_long_words(spark):
    long = "z9" * 40_000
    df = spark.createDataFrame([(1, "a b", "x", "y"), (1, "a b", "x", "y"), (None, None, None, None), (None, "a b", None, None), (2, f"{long} {long}", "x", "y")], DOC)
    got = packing.pack(df).collect()
    whole = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    whole.no_truncation()
    sizes = Counter((r["doc_id"], r["piece"]) for r in got)
    assert sizes[1, 0] == 2 and sizes[None, 0] == 2
    assert sum(r["length"] for r in got if r["doc_id"] == 2) == len(whole.encode(f"{long} {long}", add_special_tokens=False).ids) + 1
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == len(got)


def test_base_scores_and_better_than_base(spark):
    rng = random.Random(9)
    tongues = [[f"{a}{b}" for a in "bcdfg" for b in ("a", "eo", "i")], [f"{a}{b}" for a in "lmnpr" for b in ("é", "ou", "ä")]]
    vocabulary = [["".join(rng.choices(t, k=rng.randint(1, 3))) for _ in range(120)] for t in tongues]
    texts = [" ".join(rng.choices(vocabulary[i % 2], weights=[1 / (k + 1) for k in range(120)], k=150)) for i in range(120)] + ["", None, "A\x0bB é"]
    df = spark.createDataFrame(rows(texts), DOC)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    got = {r["doc_id"]: r for r in context_mixing.score(df, held).collect()}
    tokens = [(t or "").encode().translate(context_mixing.LOWER).split() + [b""] for t in texts]
    c = Counter(w for i, ws in enumerate(tokens) if zlib.crc32(str(i).encode()) % 10 for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in enumerate(tokens):
        r = got[i]
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws))
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert r["score"] < 0 and r["held_out"] == (zlib.crc32(str(i).encode()) % 10 == 0)
    out = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_scores_without_training_rows(spark):
    df = spark.createDataFrame(rows(["a b", "c"]), DOC)
    got = context_mixing.score(df, F.lit(True)).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and math.isfinite(r["score"]) for r in got)
    assert context_mixing.score(df.limit(0), F.lit(False)).count() == 0


def test_scores_do_not_depend_on_partitions(spark):
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choices("abcdé", k=rng.randint(1, 15))) for _ in range(80)) for _ in range(40)] + ["x y " * 40, None, "x" * 300_000]
    df = spark.createDataFrame([*rows(texts), (None, "a b", "h", "n"), *rows(texts)[:2]], DOC)
    held = F.col("doc_id") % 5 == 0
    found = [sorted((str(r["doc_id"]), r["score"], r["base_score"]) for r in context_mixing.score(df.repartition(n), held, documents_a_bucket=10).collect()) for n in (1, 5)]
    for (i, a, b), (j, c, d) in zip(*found, strict=True):
        assert i == j and a == pytest.approx(c, rel=1e-9) and b == pytest.approx(d, rel=1e-9)
    assert len(found[0]) == len(texts) + 3


def test_repetition_against_brute_force():
    rng = random.Random(2)
    for _ in range(60):
        seq = [rng.randrange(4) for _ in range(rng.randint(1, 40))]
        context, hit = context_mixing.repeats_of(np.array(seq), np.argsort(seq, kind="stable"))
        run = 0
        for t, word in enumerate(seq):
            q = max((i for i in range(t - 1) if seq[i] == seq[t - 1]), default=-1) if t else -1
            if q < 0:
                assert context[t] == -1 and not hit[t]
                run = 0
                continue
            size = sum(run >= x for x in (1, 2, 3, 4, 8, 16))
            agrees = q >= 1 and t >= 2 and seq[q - 1] == seq[t - 2]
            assert context[t] == (size * 2 + agrees) * 2 + (q + 1 == t - 1)
            assert hit[t] == (seq[q + 1] == word)
            run = run + 1 if hit[t] else 0


def spelt_by_hand(mixer, words, counts, word, z):
    """Bits of one word, by counting anew for each bit."""
    cm = context_mixing
    coded = [w + b" " if w else b"\n" for w in words]
    data = word + b" " if word else b"\n"
    long, total = len(word) > cm.LONG, 0.0
    for at, byte in enumerate(data):
        for j in range(7, -1, -1):
            node = (byte | 256) >> (j + 1)

            def seen(width, own):
                n = [0, 0]
                for w, c in zip(coded, counts, strict=True):
                    if (len(w) - 1 > cm.LONG) == long:
                        for i, b in enumerate(w):
                            if w[max(0, i - width) : i] == data[max(0, at - width) : at] and (b | 256) >> (j + 1) == node and (width < 99 or i == at):
                                n[b >> j & 1] += c[z] if own else sum(c)
                return n

            found = [seen(k, True) for k in cm.ORDERS] + [seen(99, True), seen(99, False)]
            inputs = [math.log((b + 0.02) / (a + 0.02)) for a, b in found] + [0.3]
            known = [sum(sum(n) > x for x in (0, 2, 15)) for n in found[-2:]]
            gate = (known[0] * cm.LEVELS + known[1]) * (len(cm.ORDERS) + 1) + sum(sum(n) > 0 for n in found[: len(cm.ORDERS)])
            weights = mixer.first[gate] + mixer.second[j * 4 + min(at // 2, 3)]
            odds = min(max(float(np.float32(inputs) @ weights), -cm.FAR), cm.FAR)
            p, x = 1 / (1 + math.exp(-odds)), (odds + cm.FAR) * (cm.CELLS - 1) / (2 * cm.FAR)
            low = min(int(x), cm.CELLS - 2)
            n0, n1 = mixer.cells[gate, low] * (1 - x + low) + mixer.cells[gate, low + 1] * (x - low)
            p = 0.5 * p + 0.5 * (n1 + 8 * p) / (n0 + n1 + 8)
            total -= math.log2(p if byte >> j & 1 else 1 - p)
    return total


def small_mixer():
    rng = random.Random(8)
    words = sorted({"".join(rng.choices("ab\x01", k=rng.randint(1, 7))).encode() for _ in range(40)} | {b"", b"a", b"a\x01", b"ab", b"a" * 13, b"a" * 12 + b"bb", b"a" * 12 + b"bc", b"x" * 12}, key=context_mixing.order_of)
    counts = np.array([[rng.choice([0, 1, 5, 30]) if z in (0, 3) else 0 for z in range(context_mixing.CLASSES)] for _ in words])
    tables = np.zeros((context_mixing.TABLES, 1 << context_mixing.TABLE_BITS, 2), np.float32)
    trained = context_mixing.edges_of(words, counts, *np.nonzero(counts))
    context_mixing.count_bits(trained, tables)
    mixer = context_mixing.Mixer.fresh(tables)
    for _ in range(5):
        context_mixing.learn(mixer, trained, np.arange(len(trained.byte)), 0.02)
    return mixer, words, counts


def test_bits_against_brute_force(monkeypatch):
    slots = {}  # none collide

    def slots_of(contexts, node):
        keys = zip(contexts.ravel().tolist(), np.broadcast_to(node, contexts.shape).ravel().tolist(), strict=True)
        return np.array([slots.setdefault(k, len(slots)) for k in keys]).reshape(contexts.shape)

    def look_up(table, contexts, salt):
        # the salt is that of a node: found again by trying all
        nodes = {n * 0x9E3779B97F4A7C15 % (1 << 64): n for n in range(1, 256)}
        found = table[slots_of(contexts, np.array([nodes[int(x)] for x in salt], np.int64))]
        return found[:, 0], found[:, 1]

    monkeypatch.setattr(context_mixing, "slots_of", slots_of)
    monkeypatch.setattr(context_mixing, "_look_up", look_up)
    mixer, words, counts = small_mixer()
    pairs = np.array([(i, z) for i in range(0, len(words), 3) for z in (0, 3)]).T
    got = context_mixing.costs(mixer, context_mixing.edges_of(words, counts, *pairs))
    for i, z, bits in zip(*pairs.tolist(), got, strict=True):
        assert bits == pytest.approx(spelt_by_hand(mixer, words, counts, words[i], z), rel=1e-4)


def test_costs_are_a_distribution():
    """Bits of all one-byte words, and of two-byte ones that begin alike, sum to at most 1 in probability (whether a word is long is coded apart)."""
    mixer, words, counts = small_mixer()
    more = [bytes([a]) for a in range(256) if a not in (10, 32)] + [b"a" + bytes([a]) for a in range(256) if a not in (10, 32)]
    every = sorted({w for w in {*words, *more} if len(w) <= context_mixing.LONG}, key=context_mixing.order_of)
    known = dict(zip(words, counts, strict=True))
    counts = np.array([known.get(w, np.zeros(context_mixing.CLASSES, np.int64)) for w in every])
    pairs = np.arange(len(every)), np.full(len(every), 3)
    bits = context_mixing.costs(mixer, context_mixing.edges_of(every, counts, *pairs))
    assert (2.0**-bits).sum() <= 1.0001
