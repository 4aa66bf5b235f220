"""Toxicity, chats, URL rules and the pipeline."""

import json
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import chat_format, toxicity, url_filter

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def toxic_corpus(n=400, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        text = rng.choices(words, k=rng.randint(3, 80))
        bad = i % 4 == 0
        if bad:
            text.insert(rng.randrange(len(text)), rng.choice(["Vile,", "NASTY", "(rotten)"]))
        rows.append((i, " ".join(text), rng.choice(["en", "de"]), "s", 0))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = toxic_corpus()
    docs = spark.createDataFrame([*rows, (None, None, None, None, None), (900, "", "fr", "s", 0)], DOC)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    held = toxicity.remainder(F.col("doc_id"), 3) == 1
    model = toxicity.fit(docs, marks, bits=12, learn_from=~held)
    truth = {i: t for i, _, t in labels}
    got = [r for r in toxicity.score(docs, model, bits=12).withColumn("held", held).collect()]
    assert len(got) == len(rows) + 2 and all(0 <= r["score"] <= 1 for r in got)
    late = [r for r in got if r["doc_id"] in truth and r["held"]]
    assert sum((r["score"] >= 0.7) == (truth[r["doc_id"]] == 1) for r in late) >= 0.97 * len(late)
    empty = {r["score"] for r in got if r["doc_id"] in (None, 900)}
    assert len(empty) == 1 and empty.pop() < 0.7
    assert set(model.thresholds) == {"de", "en"}


def test_toxicity_is_learnt_from_noise():
    rows, labels = toxic_corpus(1200, seed=3)
    texts = [toxicity.rows_of(toxicity.tokens_of(t.encode()), 12) for _, t, *_ in rows]
    truth = np.array([x[-1] for x in labels], float)
    model = toxicity.train(texts[:900], truth[:900], 12)
    scores = toxicity.score_rows(model, texts[900:])
    assert ((scores >= 0.7) == (truth[900:] == 1)).mean() >= 0.98


def test_calibration_is_drawn_to_the_default():
    few = toxicity.calibrated(np.array([0.1, 0.2, 0.9, 0.95]), np.array([False, True, True, True]), 0.7)
    assert 0.6 < few < 0.7  # three toxic rows against twenty
    many = toxicity.calibrated(np.tile([0.1, 0.2, 0.9], 500), np.tile([False, True, True], 500), 0.7)
    assert 0.1 < many < 0.25
    assert toxicity.calibrated(np.array([0.1, 0.9]), np.array([False, True]), 0.7) == pytest.approx(0.7)
    assert toxicity.calibrated(np.array([0.1]), np.array([False]), 0.7) == 0.7


def test_toxicity_gathers_bounded_words(spark):
    rows, labels = toxic_corpus(60)
    rows += [(i, "long " * 5000, "en", "s", 0) for i in (4, 8)]  # ids again, with very long texts
    docs = spark.createDataFrame(rows, DOC)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, marks, bits=12, sample_words=2000)
    assert model is not None and toxicity.fit(docs, marks, bits=12, sample_words=0) is None
    got = toxicity.score(docs, model, bits=12).collect()
    assert len(got) == len(rows)


def area(scores, labels):
    """Share of pairs of a toxic and another row whose scores are in order."""
    gaps = scores[labels > 0][:, None] - scores[labels <= 0][None]
    return ((gaps > 0) + (gaps == 0) / 2).mean()


def test_toxicity_of_the_given_labels(spark):
    """Whole table, from noise, on rows that training may not see."""
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    held = toxicity.remainder(F.col("doc_id"), 3) == 1
    model = toxicity.fit(docs, labels, learn_from=~held)
    late = toxicity.score(docs, model).where(held).join(labels.where("toxic IS NOT NULL").withColumnRenamed("toxic", "label"), "doc_id").collect()
    assert len(late) > 100 and area(np.array([r["score"] for r in late]), np.array([r["label"] for r in late])) >= 0.9


@pytest.mark.parametrize("giant", [0, 1])
def test_one_long_labelled_text_leaves_the_model(spark, giant):
    rows, labels = toxic_corpus(60)
    first = min((i for i, *_ in rows), key=lambda i: zlib.crc32(b"order%d" % i))
    rows[first] = (first, "long " * 5000, "en", "s", 0)
    labels[first] = (first, 1, giant)
    model = toxicity.fit(spark.createDataFrame(rows, DOC), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), bits=12, sample_words=1500)
    assert model is not None and len({round(float(s), 6) for s in toxicity.score_rows(model, [toxicity.rows_of([b"vile"], 12), toxicity.rows_of([b"w1"], 12)])}) == 2


@pytest.mark.parametrize("depth", [900, 1200, 3000, 20_000])
def test_deeply_nested_arguments(spark, depth):
    deep = '{"a":' * depth + '"$x"' + "}" * depth
    flat = "[" * depth + "]" * depth
    texts = [f'{{"tool_calls": [{{"name": "search", "id": "c", "arguments": {a}}}]}}' for a in (deep, flat, json.dumps(deep), json.dumps(flat))] + [deep, '{"tool_call_id": "c", "content": ' + flat + "}"]
    rows = [(1, n, "tool" if n == 5 else "assistant", t) for n, t in enumerate(texts)]
    got = chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    kinds = [[r["kind"] for r in sorted(got, key=lambda r: r["item"]) if r["turn"] == n] for n in range(6)]
    within = depth < 950
    assert kinds == [["message", "call"] if within else ["message"]] * 2 + [["message", "call"]] * 2 + [["message"], ["result"] if within else ["message"]]
    assert all(json.loads(r["json"]) for r in got)


def test_toxicity_without_a_class(spark):
    docs = spark.createDataFrame([(1, "a", "en", "s", 1)], DOC)
    marks = spark.createDataFrame([(1, 1, 0), (1, 1, None)], "doc_id long, quality int, toxic int")
    assert toxicity.fit(docs, marks) is None
    assert toxicity.score(docs, None).first()["score"] == 0
    assert toxicity.score(docs.drop("lang").limit(0), None).count() == 0


CHAT = "conv_id long, turn long, role string, text string, json string"


def call(*calls):
    return json.dumps({"content": "c", "tool_calls": [{"id": i, "name": n, "arguments": a} for i, n, a in calls]})


def test_chats(spark):
    rows = [
        (1, 0, "user", "hé {"),
        (1, 1, "assistant", call(("a", "search", {"query": "x", "limit": 3}), ("b", "calculate", {"expression": "$a"}), ("c", "search", {"limit": 1}), ("d", "nothing", {}))),
        (1, 2, "tool", json.dumps({"tool_call_id": "b", "content": {"z": 1, "a": 2}})),
        (1, 3, "tool", json.dumps({"tool_call_id": "a", "content": "r"})),
        (1, 4, "tool", json.dumps({"tool_call_id": "zz", "content": 1})),
        (1, 5, "assistant", call(("a", "search", {"query": "again"}), ("e", "calculate", {"expression": "$f"}), ("f", "calculate", {"expression": "$e"}), ("g", "search", '{"query": "s", "limit": true}'))),
        (2, 0, "assistant", None),
        (2, 1, "tool", json.dumps({"tool_call_id": "a", "content": 1})),
        (None, None, None, None),
        (3, 0, "assistant", '{"tool_calls": [1, {"id": 5}]}'),
        (3, 1, "user", "{" * 3000),
    ]
    got = chat_format.format_chats(spark.createDataFrame([(*r, "x") for r in rows], CHAT)).collect()
    status = {(r["conv_id"], r["turn"], r["item"]): r["status"] for r in got}
    assert [status[1, 1, i] for i in range(5)] == ["ok", "ok", "ok", "invalid: missing query", "invalid: unknown tool"]
    assert [status[1, 5, i] for i in range(1, 5)] == ["invalid: repeated id", "cyclic", "cyclic", "invalid: limit is no integer"]
    assert status[1, 2, 0] == status[1, 3, 0] == "ok" and status[1, 4, 0] == status[2, 1, 0] == "orphan"
    by = {(r["conv_id"], r["turn"], r["item"]): r for r in got}
    assert by[1, 2, 0]["json"] == '{"content":{"a":2,"z":1},"role":"tool","tool_call_id":"b"}' and by[1, 2, 0]["linked_turn"] == 1 and by[1, 1, 2]["linked_turn"] == 2
    order = [(r["kind"], r["call_id"]) for r in sorted((r for r in got if r["conv_id"] == 1), key=lambda r: (r["anchor"], r["depth"], r["turn"], r["item"]))]
    place = {x: i for i, x in reversed(list(enumerate(order)))}
    assert place["call", "a"] < place["result", "a"] and place["call", "a"] < place["call", "b"] < place["result", "b"]
    assert by[1, 0, 0]["json"] == '{"content":"hé {","role":"user"}' and len(got) == len(rows) + 10
    assert chat_format.format_chats(spark.createDataFrame([], CHAT)).count() == 0


def fits(host, path, rules):
    found = [(len(h) + len(p), h, p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(found, default=None)


@pytest.mark.parametrize("ranges", [1, 4, 32])
def test_url_rules(spark, ranges):
    rng = random.Random(ranges)
    labels = ["a", "b", "net", "org", "a-b", "x1"]
    host = lambda: ".".join(rng.choice(labels) for _ in range(rng.randint(1, 4)))
    rules = [*url_filter.RULES, *{(h, p): (rng.choice(["block", "allow"]), h, p) for h, p in ((host(), rng.choice(["", "/", "/en/", "/en/x"])) for _ in range(40))}.values()]
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.NET/en/1?q=://z", "ftp://net", "http://net?x/", "http://a.net./", "http://example.com:80/de/", "x://y\n.net/"] + [f"https://{host().upper() if i % 5 == 0 else host()}{rng.choice(['', '/', '/en/', '/en/xy', '/fr/1#a', '?a'])}" for i in range(300)]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(3, urls[3], "h")], "page_id long, url string, host string")
    got = url_filter.filter_urls(df, rules, ranges=ranges).collect()
    assert len(got) == len(urls) + 1
    for r in got:
        best = fits(r["host"], r["path"], rules)
        assert (r["rule"], r["verdict"]) == ((best[1] + best[2], best[3]) if best and sum(fits(r["host"], r["path"], [x]) is not None and len(x[1]) + len(x[2]) == best[0] for x in rules) == 1 else (r["rule"], r["verdict"]))
        assert (r["rule"] is None) == (best is None)
    by = {r["page_id"]: r for r in got}
    assert (by[4]["host"], by[4]["path"]) == ("www.example.net", "/en/1") and by[0]["host"] == by[0]["path"] == by[2]["host"] == ""
    assert url_filter.filter_urls(df.limit(0)).count() == 0
    assert {r["verdict"] for r in url_filter.filter_urls(df, []).collect()} == {"allow"}
    twice = [("allow", "NET", "/"), ("block", "net", "/"), ("allow", "net", "/")]
    long = spark.createDataFrame([(k, f"http://{'a.' * 50_000}net/{k}", "h") for k in range(40)], "page_id long, url string, host string")
    assert {(r["rule"], r["verdict"]) for r in url_filter.filter_urls(long, twice, urls_a_task=2).collect()} == {("net/", "block")}


def test_sweep_pushes_and_pops():
    got = {key: [r[1] + r[2] for r in stack] for key, _, stack in url_filter.swept([("block", "net", ""), ("allow", "a.net", "/"), ("allow", "b.a.net", ""), ("block", "c.net", ""), ("allow", "netx", ""), ("block", "net", "/x")])}
    assert got == {"net.": ["net", "net/x"], "net.a.": ["net", "net/x", "a.net/"], "net.a.b.": ["net", "net/x", "a.net/", "b.a.net"], "net.c.": ["net", "net/x", "c.net"], "netx.": ["netx"]}


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(3)
    words = [f"w{i}" for i in range(500)]
    rows, labels = toxic_corpus()
    rows = [(i, t + " " + " ".join(rng.choices(words, k=60)), *x) for i, t, *x in rows]
    clean = [r for r in rows if r[0] % 4]
    passage = " ".join(rng.choices(words, k=150))
    rows += [(1000, clean[0][1], "en", "s", 0), (1001, clean[1][1].replace(" ", "  "), "en", "s", 0), (1002, clean[2][1] + " more", "en", "s", 0), (1003, "u1 " + passage, "en", "s", 0), (1004, passage + " u2 u3 u4 " + " ".join(rng.choices(words, k=90)), "en", "s", 0)]
    docs = spark.createDataFrame(rows, DOC)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    seen = {}
    frame = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, str(tmp_path))
        assert frame.columns == corpus_pipeline.COLUMNS
        frame = spark.createDataFrame(frame.collect(), DOC)
        seen[name] = {r["doc_id"]: r["text"] for r in frame.collect()}
    assert all(i % 4 or i >= 1000 for i in seen["toxicity"]) and len(seen["toxicity"]) >= 0.97 * (len(clean) + 5)
    assert len({clean[0][0], 1000} & set(seen["exact_dedup"])) == 1 and clean[1][0] not in seen["exact_dedup"]
    assert 1002 not in seen["near_dedup"] and clean[2][0] in seen["near_dedup"]
    assert passage not in seen["passages"][1003] and passage not in seen["passages"][1004] and "u2 u3 u4" in seen["passages"][1004]
    assert corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().count() == len(seen["passages"])


def test_pipeline_with_repeated_rows_and_null_ids(spark, tmp_path, monkeypatch):
    import corpus_pipeline

    rng = random.Random(5)
    text = lambda: " ".join(f"w{rng.randrange(5000)}" for _ in range(120))
    same, lone, shared, near, other = text(), text(), text(), text(), text()
    rows = [(1, same), (1, same), (1, same), (None, lone), (None, shared), (None, shared), (7, shared.replace(" ", "  ", 1)), (5, other), (5, near), (3, near + " more"), (None, near + " yet"), (None, None), (9, "")]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in rows]
    spark.createDataFrame(rows, DOC).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    seen, keep = {}, corpus_pipeline.materialise
    monkeypatch.setattr(corpus_pipeline, "materialise", lambda df, name: seen.setdefault(name, keep(df, name)))
    corpus_pipeline.run(spark, str(tmp_path))
    texts = lambda name: sorted(((r["doc_id"], r["text"]) for r in seen[name].collect()), key=str)
    known = [(1, same), (None, lone), (7, shared.replace(" ", "  ", 1)), (5, other), (3, near + " more"), (9, "")]
    assert texts("stage-exact_dedup") == sorted([*known, (5, near), (None, near + " yet")], key=str)
    assert texts("stage-near_dedup") == texts("stage-passages") == sorted(known, key=str)


def test_chats_against_brute_force(spark):
    rng = random.Random(11)
    rows = []
    for conv in range(40):
        ids = [f"k{i}" for i in range(rng.randint(1, 9))]
        for turn in range(rng.randint(1, 10)):
            if rng.random() < 0.6:
                some = rng.sample(ids, rng.randint(1, min(3, len(ids))))
                rows.append((conv, turn, "assistant", call(*((i, "search", {"query": " ".join(["q"]), "limit": 1} if rng.random() < 0.3 else {"query": f"${rng.choice(ids)}"}) for i in some))))
            else:
                rows.append((conv, turn, "tool", json.dumps({"tool_call_id": rng.choice([*ids, "none"]), "content": turn})))
    rows += [(90, t, "assistant", call((f"c{t}", "search", {"query": f"$c{t - 1}" if t else "x"}))) for t in range(60)]  # each names the one before
    rows += [(91, t, "assistant", call((f"c{t}", "search", {"query": f"$c{t + 1}"}))) for t in range(6)]  # each names the next
    got = chat_format.format_chats(spark.createDataFrame([(*r, "x") for r in rows], CHAT)).collect()
    items = [(c, t, i, kind, key, set(names)) for c, t, role, text in rows for i, kind, key, _, _, names, _ in chat_format.items_of(role, text, chat_format.SCHEMAS)]
    first, answered = {}, {}
    for c, t, i, kind, key, names in sorted(items, key=lambda x: x[:3]):
        if kind == "call":
            first.setdefault((c, key), (t, i, names))
        elif kind == "result":
            answered.setdefault((c, key), t)

    def reached(start):
        seen, todo = set(), [start]
        while todo:
            for name in first[todo.pop()][2]:
                x = (start[0], name)
                if x in first and x not in seen:
                    seen.add(x)
                    todo.append(x)
        return seen

    anchor = {x: max(first[y][0] for y in {x} | reached(x)) for x in first}
    near = {x: {(x[0], n) for n in first[x][2] if anchor.get((x[0], n)) == anchor[x]} for x in first}
    depth = {}
    while ready := [x for x in first if x not in depth and near[x] <= set(depth)]:
        depth.update({x: 1 + max((depth[y] for y in near[x]), default=-1) for x in ready})
    for r in got:
        x, place = (r["conv_id"], r["call_id"]), (r["turn"], r["item"])
        if r["kind"] == "call":
            want = "invalid: repeated id" if first[x][:2] != place else "cyclic" if x not in depth else "ok" if x in answered else "unanswered"
            assert r["status"] == want
            if first[x][:2] == place:
                assert (r["anchor"], r["linked_turn"]) == (anchor[x], answered.get(x)) and (x not in depth or r["depth"] == 2 * depth[x] + 1)
        elif r["kind"] == "result":
            assert (r["status"], r["linked_turn"]) == (("ok", first[x][0]) if x in first else ("orphan", None))
    assert len(got) == len(items)
    assert len({r["status"] for r in got}) == 5


def test_chats_that_json_cannot_hold(spark):
    calls = lambda arguments: json.dumps({"tool_calls": [{"id": "a", "name": "search", "arguments": arguments}]})
    texts = [calls('{"query": NaN}'), calls("\ud800"), calls('{"query": "\\ud800"}'), '{"tool_calls": [{"id": "a", "name": "search", "arguments": {"query": Infinity}}]}', '{"tool_call_id": "\\udfff"}']
    rows = [(k, 0, "tool" if k == 4 else "assistant", t, "x") for k, t in enumerate(texts)]
    rows += [rows[0], (7, 0, "assistant", calls({"query": "long " * 200_000}), "x")]
    got = chat_format.format_chats(spark.createDataFrame(rows, CHAT)).collect()
    kinds = {(r["conv_id"], r["item"]): (r["kind"], r["status"]) for r in got}
    assert kinds[0, 1][0] == kinds[2, 1][0] == "call" and kinds[1, 0] == kinds[3, 0] == kinds[4, 0] == ("message", "ok") and (1, 1) not in kinds
    assert sorted(r["status"] for r in got if r["conv_id"] == 0 and r["item"]) == ["invalid: arguments are no object"] * 2
    assert max(len(r["json"]) for r in got) > 1_000_000


def test_pipeline_of_empty_tables_and_of_documents_without_labels(spark, tmp_path):
    import corpus_pipeline

    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for name, rows in (("none", []), ("odd", [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "a b", "en", "s", 3), (2, " ", None, None, None)])):
        d = tmp_path / name
        frame = spark.createDataFrame(rows, DOC).withColumn("row", F.lit("x")).withColumn("score", F.lit(1))
        frame.write.parquet(str(d / "documents.parquet"))
        labels.write.parquet(str(d / "labels.parquet"))
        got = corpus_pipeline.run(spark, str(d)).collect()
        assert sorted(r["length"] for r in got) == ([] if name == "none" else [1, 3])


def test_toxicity_of_a_very_long_text(spark):
    rows, labels = toxic_corpus(60)
    docs = spark.createDataFrame([*rows, (500, "w1 " * 200_000 + "vile", "en", "s", 0)], DOC)
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), bits=12)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model, bits=12).collect()}
    assert len(got) == 61 and 0 <= got[500] <= 1
