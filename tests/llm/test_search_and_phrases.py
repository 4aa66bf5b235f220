"""Ranked search, removal of earlier passages and collocations, against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest

from marlstone.llm import collocations, lexical_search, relative_lz

DOC = "doc_id long, text string, lang string, term string, seg string, n long, rank int, score string"
LETTERS = {c: c + 32 for c in range(65, 91)}


def table(spark, rows, parts=4):
    return spark.createDataFrame([(i, t, lang, "x", "y", 1, 2, "z") for i, t, lang in rows], DOC).repartition(parts)


# --- search
def ranked(docs, items, k):
    found = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (t or "").translate(LETTERS))
    texts = [(i, Counter(found(t))) for i, t in docs]
    texts = [(i, c) for i, c in texts if c]
    total, length = len(texts), sum(c.total() for _, c in texts)
    df = Counter(t for _, c in texts for t in c)
    asked = defaultdict(set)
    for item, t in items:
        asked[item] |= set(found(t))
    out = {}
    for item, terms in asked.items():
        scores = []
        for i, c in texts:
            m = 50 + 50 * c.total() * total // length
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if s > 0:
                scores.append((-s, i is None, i))
        scores.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        for n, (s, _, i) in enumerate(scores[:k], 1):
            out[item, n] = (i, -s)
    return out


@pytest.mark.parametrize("pairs", [200_000, 10])
def test_search(spark, monkeypatch, pairs):
    monkeypatch.setattr(lexical_search, "_PAIRS", pairs)  # so many (item, term) pairs at once
    rng = random.Random(pairs)
    words = ["the", "The", "und", "été", "日本", "x1", "a-b", "zz", *(f"w{n}" for n in range(60))]
    text = lambda n: " ".join(rng.choices(words, [40, 20, 20, 5, 2, 2, 2, 1] + [1] * 60, k=n))
    docs = [(i, text(rng.choice([1, 3, 20, 200]))) for i in range(150)]
    docs += [(7, docs[7][1]), (8, "the"), (None, "zz w1 w2"), (200, None), (201, ""), (202, " .,;\x7f"), (203, "the " * 4000)] + [(300 + i, "same text zz") for i in range(12)]
    items = [(0, "the"), (1, "zz w1 W2!"), (2, text(30)), (3, text(60)), (4, None), (5, "unseen"), (6, ""), (2, "zz"), (None, "w3 w4"), (9, "été,日本")]
    got = lexical_search.search(table(spark, [(i, t, "en") for i, t in docs]), spark.createDataFrame(items, "item_id long, text string"), 9).collect()
    assert {(r["item_id"], r["rank"]): (r["doc_id"], r["score"]) for r in got} == ranked(docs, items, 9)
    assert len(got) == len({(r["item_id"], r["rank"]) for r in got})


def test_search_without_documents_or_items(spark):
    none, items = table(spark, [(1, None, "en")]), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical_search.search(none, items).count() == 0 == lexical_search.search(none.where("doc_id > 5"), items).count()
    assert lexical_search.search(table(spark, [(1, "a b", "en")]), items.where("item_id > 5")).count() == 0


def test_index_leaves_what_lies_below_the_threshold(spark):
    """Of a word in all documents only the heads are read once the other terms decide."""
    docs = [(i, f"the w{i % 40} w{i % 40} w{i % 40}") for i in range(400)]
    index, _ = lexical_search.build_index(table(spark, [(i, t, "en") for i, t in docs]))
    found = {r["term"]: r for r in index.groupBy("term").agg({"size": "sum", "top": "max"}).collect()}
    pairs = spark.createDataFrame([(1, "the", 1, found["the"]["max(top)"]), (1, "w3", 3000, found["w3"]["max(top)"])], "item_id long, term string, weight long, top long")
    block = lexical_search.Block(pairs.toArrow())
    best = ranked(docs, [(1, "the w3")], 5)[1, 5][1]
    assert list(block.set_thresholds({1: best})) == ["w3"] and found["the"]["sum(size)"] == 400


# --- passages
def first_windows(docs, window):
    """(words, kept words) of each document: id and text."""
    distinct = sorted(set(docs), key=lambda d: (d[0] is None, d[0] or 0))
    seen, out = set(), {}
    for key in distinct:
        words = re.findall("[^\x20\x09-\x0d]+", key[1] or "")
        gone = set()
        for at in range(len(words) - window + 1):
            w = tuple(words[at : at + window])
            gone |= set(range(at, at + window)) if w in seen else set()
            seen.add(w)
        out[key] = (words, [w for n, w in enumerate(words) if n not in gone])
    return out


def rebuilt(row, texts):
    """The words of a document, from what it kept and its factors."""
    kept, words = iter(row["kept"].split(" ") if row["kept"] else []), []
    for f in [*row["factors"], None]:
        while len(words) < (f["at"] if f else row["n_words"]):
            words.append(next(kept))
        if f:
            source = words if (f["from_doc"], f["from_key"]) == (row["doc_id"], row["tkey"]) else texts[f["from_doc"], f["from_key"]]
            for n in range(f["words"]):
                words.append(source[f["from_at"] + n])
    return words


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_passages(spark, seed):
    rng = random.Random(seed)
    texts = [" ".join(rng.choices("abc", k=rng.choice([0, 3, 4, 5, 30, 90]))) for _ in range(40)]
    passage = " ".join(f"p{n}" for n in range(12))
    texts += [f"{rng.random()} {passage}\n{rng.random()}" for _ in range(30)]  # one block in many documents
    texts += [" ".join(f"p{n}" for n in range(rng.randint(0, 4), rng.randint(6, 12))) + f" u{i}" for i in range(30)]  # parts of it, at the borders of blocks
    texts += [None, "", " \t\n", "x " * 50, "é ü " * 9, "A B C D", "a b c d"]
    docs = [(i * 7 % 101, t) for i, t in enumerate(texts)]
    docs = [(i, t) for i, t in docs if i % 10] + [(None, "a b c a b c a"), docs[3], docs[3]]
    docs = [d for d in docs if docs.count(d) == 1 or d == docs[-1]]
    df = table(spark, [(i, t, "en") for i, t in docs])
    got = relative_lz.remove_earlier(df, window=4, gram=2).collect()
    want = first_windows(docs, 4)
    assert len(got) == len(docs)
    by_hash = defaultdict(Counter)
    for r in got:
        by_hash[r["doc_id"]][r["n_words"], r["n_removed"], r["kept_sha256"], r["kept"]] += 1
    expected = defaultdict(Counter)
    for i, t in docs:
        words, kept = want[i, t]
        joined = " ".join(kept)
        expected[i][len(words), len(words) - len(kept), hashlib.sha256(joined.encode()).hexdigest(), joined] += 1
    assert by_hash == expected
    keys = {(r["doc_id"], r["tkey"]): (r["text"] or "").split() for r in df.selectExpr("doc_id", "text", "xxhash64(cast(coalesce(text, '') AS binary)) AS tkey").collect() if " " not in (r["text"] or "")}
    for r in got:
        own = [k for k, words in keys.items() if k[0] == r["doc_id"] and len(words) == r["n_words"]]
        if len(own) == 1 and " " not in r["kept"]:
            assert rebuilt({**r.asDict(), "tkey": own[0][1], "factors": [f.asDict() for f in r["factors"]]}, keys) == keys[own[0]]


def test_long_texts_are_hashed_in_chunks(spark):
    words = [str(n) for n in range(relative_lz._CHUNK + 5000)]
    at = relative_lz._CHUNK - 15
    rows = [(1, " ".join(words), "en"), (2, " ".join(["q", *words[at : at + 30], "r"]), "en"), (3, " ".join(words[:19]), "en")]
    got = {r["doc_id"]: r for r in relative_lz.remove_earlier(table(spark, rows)).collect()}
    assert got[1]["n_removed"] == 0 and got[2]["kept"] == "q r" and [f["from_at"] for f in got[2]["factors"]] == [at] and got[3]["n_removed"] == 0
    assert relative_lz.remove_earlier(table(spark, rows).where("doc_id > 5")).count() == 0


def test_factors_are_the_longest_at_hand():
    a, b = (1, 11), (2, 22)
    assert relative_lz.factors_of([(0, 3, *a, 5), (3, 2, *a, 8), (1, 9, *b, 0)], 4) == [(0, 8, 1, 11, 5), (8, 5, 2, 22, 7)]
    assert relative_lz.factors_of([(4, 1, *a, 0), (20, 1, *a, 16)], 4) == [(4, 4, 1, 11, 0), (20, 4, 1, 11, 16)] and relative_lz.factors_of([], 4) == []


# --- collocations
def mined(docs, max_words, least, top):
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in docs:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LETTERS)):
            w = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for k in range(1, max_words + 1):
                counts[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    rows = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and 100 * b >= 50 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in candidates.items()):
                continue
            score, k = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]], k))
        for n, (s, a, p, left, right, k) in enumerate(sorted(found)[:top], 1):
            rows.append((lang, n, p.decode(), -a, left, right, totals[lang], -s, k))
    return sorted(rows)


@pytest.mark.parametrize(("max_words", "least", "top"), [(3, 10, 2000), (4, 2, 50), (2, 1, 30)])
def test_collocations(spark, max_words, least, top):
    rng = random.Random(max_words)
    words = ["the", "The", "of", "New", "York", "City", "é", "日本", "\x1c", "b"]
    sentence = lambda: "".join(rng.choice(words) + rng.choice([" ", " ", "\t", "  ", ". ", "\n", ",", " new york "]) for _ in range(rng.randint(0, 30)))
    docs = [(sentence(), rng.choice(["en", "de", None, "und"])) for _ in range(150)]
    docs += [(None, "en"), ("", "fr"), ("...", "fr"), docs[3], docs[3], ("the of " * 3000, "la")]
    got = collocations.mine(table(spark, [(i, t, lang) for i, (t, lang) in enumerate(docs)]), max_words, least, 50, top).collect()
    assert sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"], r["k"]) for r in got) == mined(docs, max_words, least, top)
    assert collocations.mine(table(spark, [(1, None, None)])).count() == 0 == collocations.mine(table(spark, [(1, "a", "b")]).where("doc_id > 3")).count()


def test_large_counts_are_exact(spark):
    row = spark.sql("SELECT 3000000000000L AS n, array(9000000000001L) AS lefts, array(7000000000003L) AS rights").select(collocations._cut_scores(2).alias("c")).first()["c"]
    assert row["score"] == 10**6 * 3000000000000**2 // (9000000000001 * 7000000000003)


def test_slices_end_at_borders():
    text = ("Ab c, " * 400_000).encode() + b"x" * (3 << 20) + b"!y"
    parts = list(collocations.slices(text))
    assert len(parts) > 2 and b"".join(parts) == text.translate(collocations._PIECES) and all(p.endswith(b"\xff") for p in parts[:-1])
    shard = collocations.Shard("en")
    shard.add(text)
    rows = {p["path"]: p["n"] for p in shard.level(2, None).to_pylist()}
    assert rows == {"en\nab c": 400_000}
