"""Row numbers, stores, letters, queue states, record checks and the whole search path."""

import random

import pytest
from pyspark.sql import functions as F

from marlstone.functions import records
from marlstone.operators import documents, filings, letters, ordering, portfolio, search, theses, timing
from marlstone.sources import tables
from marlstone.streaming import queue


@pytest.mark.parametrize("ranges", [1, 4, 64])
def test_row_numbers(spark, ranges):
    rng = random.Random(ranges)
    rows = [(i, rng.choice([1.5, 2.0, -3.0, 1e9, rng.random()]), rng.random() < 0.3) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, x double, flag boolean").repartition(5)
    got = {r["id"]: r["n"] for r in ordering.row_numbers(df, "n", F.col("x"), [F.col("id")], ranges=ranges).collect()}
    want = {i: k for k, (_, i) in enumerate(sorted((x, i) for i, x, _ in rows), 1)}
    assert got == want
    by = {r["id"]: r["n"] for r in ordering.row_numbers(df, "n", F.col("x"), [F.col("id")], group="flag", ranges=ranges).collect()}
    for flag in (True, False):
        own = sorted((x, i) for i, x, f in rows if f == flag)
        assert {i: by[i] for _, i in own} == {i: k for k, (_, i) in enumerate(own, 1)}
    assert ordering.row_numbers(df.limit(0), "n", F.col("x"), []).count() == 0


def test_sorted_rows_carry_no_counts_of_ranges(spark):
    df = spark.range(50).select("id", (F.col("id") % 7).alias("x"), (F.col("id") % 2 == 0).alias("flag"))
    for more in ({}, {"group": "flag"}):
        lines = ordering.row_numbers(df, "n", F.col("x"), [F.col("id")], **more)._jdf.queryExecution().optimizedPlan().toString().splitlines()
        at = next(i for i, line in enumerate(lines) if "Window [" in line)
        assert "_counts" not in lines[at + 1] and "_before" in lines[at + 1], lines[at + 1]


def test_bar_files(spark, tmp_path):
    bars = spark.sql("SELECT 'A' AS ticker, DATE '2024-01-02' AS date, 1.5D AS open, 2D AS high, 1D AS low, 1.25D AS close, 7L AS volume UNION ALL SELECT 'B', DATE '2024-01-03', 1D, 2D, 1D, 1D, 8L")
    tables.write_bars(bars, str(tmp_path / "bars"))
    tables.write_bars(bars.where("ticker = 'B'").withColumn("volume", F.lit(9).cast("long")), str(tmp_path / "bars"))
    got = {r["ticker"]: (r["close"], r["volume"]) for r in tables.read_written_bars(spark, str(tmp_path / "bars")).collect()}
    assert got == {"A": (1.25, 7), "B": (1.0, 9)}


def test_sidecars_that_cannot_be_read_are_left_out(spark):
    rows = [('{"accession": "1", "ticker": "A", "filed": "2024-01-02"}',), ('{"accession": "2", "tick',), ('{"accession": "3"}',), (None,), ("[]",)]
    got = filings.listing(spark.createDataFrame(rows, "json string")).collect()
    assert [(r["accession"], str(r["filed"])) for r in got] == [("1", "2024-01-02")]


def letter(spark, *written):
    text = spark.range(1).select(letters.skeleton(F.lit(2024)).alias("c")).first()["c"]
    for q in written:
        head, rest = text.split(f"## Q{q}:", 1)
        text = head + f"## Q{q}:" + rest.replace("[To be populated.]", "### Regime\nred", 1)
    return text


def test_letters(spark):
    rows = [("a", letter(spark), 2, "### New\n$1"), ("b", letter(spark, 2), 2, "### New"), ("c", "no letter", 2, "x"), ("d", letter(spark, 1, 2, 3, 4), 4, "### Last"), ("e", None, 1, "x")]
    df = spark.createDataFrame(rows, "name string, content string, quarter int, body string")
    got = {r["name"]: r for r in letters.updated(df).collect()}
    assert {k: r["outcome"] for k, r in got.items()} == {"a": "written", "b": "refused", "c": "missing", "d": "refused", "e": "missing"}
    assert got["a"]["content"] == rows[0][1].replace("## Q2: April — June\n\n[To be populated.]", "## Q2: April — June\n\n### New\n$1") and got["b"]["content"] == rows[1][1]
    forced = {r["name"]: r["content"] for r in letters.updated(df, force=True).collect()}
    assert forced["d"] == rows[3][1].replace("September", "September", 1).replace("## Q4: October — December\n\n### Regime\nred", "## Q4: October — December\n\n### Last")
    state = {r["name"]: (r["quarters"], r["finalized"], r["may_finalize"]) for r in letters.status(df).collect()}
    assert state["a"] == ([], False, False) and state["d"] == ([1, 2, 3, 4], False, True) and state["c"] == ([], False, False)


def test_thesis_updates(spark):
    text = "```yaml\nhealth_score: 10\nshares: 5  # held\n```\n\n## Thesis Health\n\n| Component | Weight | Score | Notes |\n|---|---|---|---|\n| Old | 10% | 1/100 | |\n\n## Next\n| a | b |\n"
    new = F.array(F.struct(F.lit("A$1").alias("name"), F.lit(60).alias("weight"), F.lit(7).alias("score"), F.lit("n\\b").alias("notes")))
    out = spark.range(1).select(theses.with_scores(theses.with_value(F.lit(text), "shares", F.lit("$9")), new, F.lit(55)).alias("c")).first()["c"]
    assert out == text.replace("health_score: 10", "health_score: 55").replace("shares: 5  #", "shares: $9  #").replace("| Old | 10% | 1/100 | |", "| A$1 | 60% | 7/100 | n\\b |")
    assert spark.range(1).select(theses.with_value(F.lit("a: 1"), "b", F.lit(2)).alias("c")).first()["c"] == "a: 1"


def test_queue_states(spark):
    log = [("a", "claim", 1, 0), ("a", "enqueue", 9, 1), ("a", "claim", 1, 2), ("a", "claim", 2, 3), ("a", "done", 2, 4), ("a", "failed", 1, 5), ("a", "done", 1, 6), ("b", "enqueue", 9, 1), ("c", "enqueue", 9, 1), ("c", "claim", 3, 2), ("d", "done", 1, 2)]
    rows = [(i, k, w, t, n) for n, (i, k, w, t) in enumerate(log)]
    df = spark.createDataFrame(rows, "id string, kind string, worker int, s int, seq int").withColumn("at", F.timestamp_seconds("s"))
    got = {r["id"]: (r["state"], r["claimed_by"]) for r in queue.states(df).collect()}
    assert got == {"a": ("failed", 1), "b": ("pending", None), "c": ("claimed", 3)}
    versions = spark.createDataFrame([(1, "x"), (3, "y"), (5, None)], "worker int, commit string")
    health = {r["worker"]: (r["done"], r["failed"], r["late"], r["outdated"]) for r in queue.health(df, versions, "x", F.timestamp_seconds(F.lit(8)), 3).collect()}
    assert health == {1: (2, 1, False, False), 3: (0, 0, True, True), 5: (0, 0, True, True)}


def test_records(spark):
    rows = [('{"gist": "g", "summary": "s", "x": "1"}',), ('{"overview": "o"}',), (None,), ("bad",)]
    m = spark.createDataFrame(rows, "j string").select(records.repaired(F.col("j"), {"gist": "summary", "overview": "summary"}, {"severity": "0"}).alias("m"))
    assert [dict(r["m"]) for r in m.collect()] == [{"x": "1", "summary": "s", "severity": "0"}, {"summary": "o", "severity": "0"}, {"severity": "0"}, {"severity": "0"}]
    shapes = ['{"n": 1, "s": "x", "b": true, "a": [], "o": {}}', '{"n": "1", "s": 2, "b": "x", "a": {}, "o": []}', '{"n": null}', "[1]", "", None]
    wanted = {"n": "number", "s": "string", "b": "boolean", "a": "array", "o": "object"}
    got = [r["p"] for r in spark.createDataFrame([(x,) for x in shapes], "j string").select(records.problems(F.col("j"), wanted).alias("p")).collect()]
    assert got[0] == [] and got[1] == [f"wrongtype:{k} (want {t})" for k, t in wanted.items()]
    assert got[2] == ["wrongtype:n (want number)", *(f"missing:{k}" for k in "sbao")] and got[3:] == [["not an object"]] * 3


def test_stage_totals(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (1, "a", None), (1, "b", 6.0), (2, "a", None)], "run int, stage string, seconds double")
    got = {(r["run"], r["stage"]): (r["n"], r["failed"], r["total"], r["longest"], r["share"]) for r in timing.stage_totals(df).collect()}
    assert got == {(1, "a"): (1, 1, 2.0, 2.0, 0.25), (1, "b"): (1, 0, 6.0, 6.0, 0.75), (2, "a"): (0, 1, 0.0, None, None)}


NODE = "node int, ticker string, form string, label string, title string, questions string, summary string, text string"


def test_weak_queries_are_fused(spark):
    nodes = spark.createDataFrame([(i, "T", "10-K", "business", "", "", "", t) for i, t in enumerate(["alpha words here", "beta words there", "gamma", "alpha beta", "far " * 100])], NODE)
    queries = spark.createDataFrame([(1, "alpha"), (2, "nothing of it")], "query_id int, query string")
    paraphrases = spark.createDataFrame([(1, "beta"), (2, "gamma"), (2, "absent")], "query_id int, paraphrase string")
    picks = spark.createDataFrame([(2, 0, 4)], "query_id int, place int, node int")
    strong = search.search(nodes, queries, paraphrases, picks, weak=0.1).collect()
    assert {(r["query_id"], r["node"], r["weak"]) for r in strong} == {(1, 0, False), (1, 3, False), (2, 2, True), (2, 4, True)}
    weak = {r["node"]: r["rank"] for r in search.search(nodes, queries, paraphrases, picks, weak=99.0).where("query_id = 1").collect()}
    assert set(weak) == {0, 1, 3} and weak[3] == 0  # both the query and its paraphrase find it
    rows = {r["node"]: r["snippet"] for r in search.hit_rows(search.search(nodes, queries, paraphrases, picks, weak=99.0).where("query_id = 2"), nodes, queries, F.lit("2024-01-31")).collect()}
    assert rows[4] == ("far " * 60).rstrip() + "…" and rows[2] == "gamma"


def test_phrases_and_passages(spark):
    nodes = spark.createDataFrame([(1, "T", "10-K", "b", "the red house fell", "", "", "xx"), (2, "T", "10-K", "b", "", "", "", "a redhouse market. The red house"), (3, "T", "10-K", "b", "", "", "", "bred house felt")], NODE)
    queries = spark.createDataFrame([(1, "red house fel"), (2, "house")], "query_id int, query string")
    plain = {(r["query_id"], r["node"]): r["score"] for r in search.scores(nodes, queries, with_phrase=False).collect()}
    found = {(r["query_id"], r["node"]): r["score"] for r in search.scores(nodes, queries).collect()}
    assert {k for k in found if found[k] > plain[k]} == {(1, 1), (1, 3)}  # verbatim, parts of words at its ends included
    held = search.holding(nodes, spark.createDataFrame([(7, "red house fel"), (8, "no such house here")], "query_id int, passage string"), search.index_of(nodes.withColumn("text", F.concat_ws(" ", "title", "text")))).collect()
    assert [(r["query_id"], r["node"]) for r in held] == [(7, 3)]


@pytest.mark.parametrize("name", ["str16_thesis_metadata", "str15_metadata_json", "str18_components", "str18_kill_conditions", "str19_health_update", "sec15_letter_update"])
def test_files_of_one_table_file_are_parsed_by_many_tasks(spark, name):
    from marlstone.plans import catalog

    assert catalog.QUERIES[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 4


def test_metadata_with_tabs_is_refused_as_before():
    assert documents.metadata("```yaml\na: \t b\n```") is None and documents.metadata("```yaml\na: b # c\n```") == '{"a": "b"}'


def test_fetched_bodies(spark):
    df = spark.createDataFrame([(200, "x"), (404, "y")], "status int, body string")
    assert [r["b"] for r in df.select(records.fetched(F.col("status"), F.col("body")).alias("b")).collect()] == ["x", None]
    for status in (500, None):
        with pytest.raises(Exception, match="fetch failed with status"):
            spark.createDataFrame([(status, "z")], "status int, body string").select(records.fetched(F.col("status"), F.col("body"))).collect()


def test_records_have_defaults(spark):
    texts = ['{"n": 5, "s": "a"}', '{"n": "5x", "other": []}', '{"s": null}', "[1]", "{bad", "", None, '{"n": 7.0, "s": 2}']
    got = [r["r"] for r in spark.createDataFrame([(t,) for t in texts], "j string").select(records.decoded(F.col("j"), {"n": ("bigint", 1), "s": ("string", "none")}).alias("r")).collect()]
    assert [tuple(r) if r else None for r in got] == [(5, "a"), (1, "none"), (1, "none"), None, None, None, None, (7, "2")]


def test_questions_of_users(spark):
    t = {"t": spark.createDataFrame([(1, "a"), (2, "b")], "n int, v string"), "u": spark.createDataFrame([(2,)], "n int")}
    ask = lambda q, **args: sorted(tuple(r) for r in portfolio.ask(spark, q, t, args).collect())
    assert ask("SELECT v FROM t WHERE n = :n", n=2) == [("b",)] == ask("-- with a remark\nWITH w AS (SELECT n FROM u) SELECT v FROM t JOIN w USING (n);")
    assert ask("with recursive r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 3) SELECT count(*) FROM r") == [(3,)]
    for command in ("DROP TABLE t", "INSERT INTO t VALUES (1, 'x')", " ", "/* SELECT */ SET a = 1"):
        with pytest.raises(ValueError, match="only queries"):
            portfolio.ask(spark, command, t)
