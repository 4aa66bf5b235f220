"""Documents, sections, search, theses, the queue."""

import datetime as dt
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from marlstone.operators import documents, filings, ownership, search, sections, theses, trees
from marlstone.streaming import queue

PROSE = "We design and sell products in many places and this sentence goes on to be long enough for a body. " * 8


def report(contents=True):
    toc = "Item 1. Business 4 - 9\nItem 1A. Risk Factors 10 - 24\nItem 7. Management's Discussion and Analysis 30 - 40\nItem 8. Financial Statements 41 - 90\n" if contents else ""
    return toc + f"PART I\nItem 1. Business\n{PROSE}\nItem 1A. Risk Factors\n{PROSE} as told in Item 7, Management's Discussion and Analysis, and so on. {PROSE}\nItem 7. Management's Discussion and Analysis\n{PROSE}\nItem 8. Financial Statements\nSee pages 50 to 80.\nItem 9. Other\n{PROSE}"


def found(spark, rows):
    """Sections of (content, form, kind) by the row's number."""
    df = spark.createDataFrame([(n, *row) for n, row in enumerate(rows)], "id long, content string, form string, kind string")
    out = {}
    for r in sections.sections(df).orderBy("id", "pos").collect():
        out.setdefault(r["id"], []).append(r)
    return out


def test_curated_sections(spark):
    unlike = "PART I\nlineitem 1 business\n" + PROSE + "\nItem 1a.\nRisk\u00a0Factors\n(quoted) " + PROSE + "\nPART II Item 7: Management item 7. Analysis\n" + PROSE
    rows = [(f"<pre>{report()}</pre>", "10-K", "html"), (None, None, None), ("<p>Item 1. Business 4 - 9</p>", "10-K", None), (f"<pre>{unlike}</pre>", " 10-q/a ", "html"), (f"<pre>{report(False)}</pre>", "10-K", "html"), ("# a\nItem 1. Business", "10-K", "text")]
    got = found(spark, rows)
    assert [s["label"] for s in got[0]] == ["business", "risk_factors", "mdna", "financial_statements"]
    assert got[0][1]["text"].count("products") >= 16 and got[0][3]["target"] == "unknown" and not got[0][0]["is_pointer"]
    text = documents.html_text(f"<pre>{report()}</pre>")
    for s in got[0]:
        assert text[s["char_start"] : s["char_end"]].strip() == f"{s['title']}\n{s['text']}"
    assert got[1][0]["label"] == "filing-content" == got[2][0]["label"] and got[2][0]["pos"] == 0
    # A word runs into the first header, the second has a bracket after it, the third's name holds another item.
    assert [(s["label"], s["title"]) for s in got[3]] == [("business", "item 1 business"), ("risk_factors", "Item 1a.\nRisk\u00a0Factors"), ("mdna", "Item 7: Management item 7. Analysis")]
    assert [s["label"] for s in got[4]] == [s["label"] for s in got[0]] and got[4][0]["char_start"] == 7
    assert [s["label"] for s in got[5]] == ["a"]


def test_entries_of_contents(spark):
    bodies = [("4 - 9", True), (" 10-12 and more words 14-17 " + "x" * 90, True), ("12345 67890 1 a", True), ("prose of a section", False), ("", False), ("10 - 12 " + "x" * 120, False), ("1 - 2 " * 100, False)]
    got = spark.createDataFrame(bodies, "b string, want boolean").select(sections.is_contents(F.col("b")).alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in got)
    assert found(spark, [("<pre>Item 1. Business 4 - 9\nItem 1A. Risk Factors 10 - 24\n</pre>", "10-K", "html")])[0][0]["label"] == "filing-content"


def test_html():
    html = "<html><body><h2>Risk &amp; more</h2><p>One <b>two</b></p><div><h3>flat</h3>x</div><script>no</script><p>  </p></body></html>"
    assert documents.html_markdown(html) == "## Risk & more\n\nOne two\n\nflat x"
    assert "no" not in documents.html_text(html).split()
    assert documents.html_markdown("just text") == "just text" and documents.html_text(None) == ""


def test_ownership_report(spark):
    xml = '<ownershipDocument xmlns="u"><documentType>4</documentType><issuer><issuerName>Co</issuerName></issuer><reportingOwner><rptOwnerName>Ann</rptOwnerName><reportingOwnerRelationship><isOfficer>true</isOfficer><officerTitle>CFO</officerTitle></reportingOwnerRelationship></reportingOwner><nonDerivativeTransaction><transactionShares><value>120000</value></transactionShares><transactionPricePerShare><value>140.50</value></transactionPricePerShare></nonDerivativeTransaction><footnotes><footnote id="F1">note</footnote></footnotes></ownershipDocument>'
    rows = [xml, "<a><b>x</b></a>", "<a", None, "<a/>junk", "<a><![CDATA[x<y & z]]></a>", "<?xml version='1.0'?><!-- <a> --><a>t &amp; u<b/></a>", "<ownershipDocument><reportingOwner/></ownershipDocument>"]
    df = spark.createDataFrame(list(enumerate(rows)), "id int, x string").select("id", ownership.xml_report("x").alias("r"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    text, *more = (r["r"] for r in df.orderBy("id").collect())
    assert more == ["# a\n\nx\n", "", "", "", "# a\n\nx<y & z\n", "# a\n\nt & u\n", "# Form Ownership — Insider Transaction Report\n\n## Reporting owner(s)\n- (unnamed)\n"]
    assert "Ann — Officer (CFO)" in text and "| 120000 |" in text and "- (F1) note" in text


def test_plain_ownership_reports_are_not_walked(spark, monkeypatch):
    own = lambda body: f"<ownershipDocument>{body}</ownershipDocument>"
    plain = own("<documentType a='>'>4</documentType><periodOfReport><value>2024 &amp; on</value><footnoteId id='F1'/></periodOfReport><issuer><issuerName>Co</issuerName></issuer><issuerNameX>no</issuerNameX>")
    odd = {"tail": own("<documentType><b>x</b>tail</documentType><documentType>5</documentType>"), "7": own("<documentType><value/><value>7</value></documentType>"), "A&amp;": own("<documentType>&#65;&amp;amp;</documentType>"), "yes": own("<?p <documentType>no</documentType>?><documentType>yes</documentType>")}
    report = lambda rows: [r["r"] for r in spark.createDataFrame(list(enumerate(rows)), "id int, x string").select("id", ownership.xml_report("x").alias("r")).orderBy("id").collect()]
    assert [r.split(" — ")[0] for r in report(odd.values())] == [f"# Form {kind}" for kind in odd]
    monkeypatch.setattr(ownership, "_walked", lambda xml, path: F.raise_error(F.lit("walked")).cast("string"))
    assert report([plain]) == ["# Form 4 — Insider Transaction Report\n\n**Period of report:** 2024 & on\n\n## Issuer\n- Name: Co\n"]


@pytest.mark.parametrize(("body", "want"), [("and", "parser_bug"), ("see Exhibit 13", "annual_report_same_doc"), ("Refer to the proxy statement", "def14a"), ("see pages 5 to 8", "unknown"), ("see " + "x" * 600, None)])
def test_pointers(spark, body, want):
    assert spark.range(1).select(filings.pointer_target(F.lit(body)).alias("t")).first()["t"] == want


def filled(text, tokens):
    """Chunks, one unit after another."""
    out, open_ = [], None
    for p in (p.strip() for p in text.split("\n\n")):
        long = len(p) // 4 > tokens
        for u in (re.split(r"(?<=[.!?])\s+(?=[A-Z])", p) if long else [p] if p else []):
            size = len(u) // 4
            if open_ is None or open_[1] != (long and p) or open_[2] + size > tokens:
                open_ = [[], long and p, 0]
                out.append(open_)
            open_[0].append(u)
            open_[2] += size
        if long:
            open_ = None
    return [(" " if x[1] else "\n\n").join(x[0]) for x in out]


def test_chunks(spark):
    rng = random.Random(5)
    parts = ["Word one.", "two three!", "And", "Alpha beta gamma? ", "x" * 30, "\n\n", "\n\n\n\n", " ", "Z" * 70 + ". "]
    texts = ["", " \n\n ", "a" * 500, *("".join(rng.choice(parts) for _ in range(rng.randint(0, 80))) for _ in range(60))]
    df = sections.chunks(spark.createDataFrame([(n, t) for n, t in enumerate(texts)] + [(-1, None)], "id long, text string"), 10)
    got = {}
    for r in df.orderBy("id", "pos").collect():
        got.setdefault(r["id"], []).append(r["chunk"])
    assert got == {n: filled(t, 10) for n, t in enumerate(texts) if filled(t, 10)}
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_stems_and_tokens(spark):
    text = "The Risks and factors reported operating RISK cash 10-K non-GAAP é"
    got = spark.range(1).select(search.tokens(F.lit(text)).alias("t")).first()["t"]
    assert got == ["risk", "factor", "report", "operat", "risk", "cash", "non-gaap"]


def test_fusion(spark):
    rows = [(1, "a", 0, 1.0, 5.0), (1, "b", 1, 1.0, 4.0), (1, "c", 0, 1.0, 3.0), (1, "b", 1, 1.0, 6.0), (1, "z", 0, 0.0, 9.0)]
    got = search.fuse(spark.createDataFrame(rows, "query_id int, node string, rank int, weight double, score double")).orderBy(F.desc("fused")).collect()
    assert got[0]["node"] == "b" and got[0]["score"] == 6.0 and "z" not in {r["node"] for r in got}


def test_structural_place(spark):
    nodes = spark.createDataFrame([(1, "T", "business", "cash flow", "", "", "cash balance sheet"), (2, "T", "financial_statements", "x", "", "", "y"), (3, "T", "financial_statements", "x", "", "", "y")], "node int, ticker string, label string, title string, questions string, summary string, text string")
    queries = spark.createDataFrame([(1, "balance sheet")], "query_id int, query string")
    got = search.with_structural(search.scores(nodes, queries), nodes, queries, 5).orderBy("rank").collect()
    assert [(r["node"], r["rank"]) for r in got] == [(1, 0), (3, 1)]


def test_health(spark):
    c = spark.createDataFrame([("a", 1, "x", 50, 80), ("a", 2, "y", 50, 60), ("b", 1, "x", 30, 90), ("b", 2, "y", 70, 50), ("c", 1, "x", 0, 90)], "thesis string, pos int, name string, weight int, score int")
    got = {r["thesis"]: (r["overall"], r["weakest"]) for r in theses.overall(c).collect()}
    assert got == {"a": (70, "y"), "b": (62, "y"), "c": (0, "x")}
    act = lambda s, b, k: spark.range(1).select(theses.action(F.lit(s), F.lit(b), F.lit(k)).alias("a")).first()["a"]
    assert [act(s, "value", "green") for s in (0, 39, 40, 54, 55, 74, 75, 100)] == ["EXIT", "EXIT", "REDUCE", "REDUCE", "HOLD", "HOLD", "ADD", "ADD"]
    assert act(60, "value", "danger") == "REDUCE" and act(60, "short", "RED") == "ADD" and act(20, "yolo", "red") == "EXIT"


def test_thesis_documents(spark):
    doc = "# T\n\n```yaml\nticker: abc\nbucket: Value\nstatus: Active\nopened: 2024-02-03\nshares: 5 # held\n```\n\n## Kill Conditions\n| Kill condition | Monitor | Last checked |\n|---|---|---|\n| falls | daily | 2024-01-01 |\n| [x] | y | z |\n"
    parsed = theses.parsed(spark.createDataFrame([("abc.md", doc), ("none.md", "text")], "name string, content string"))
    rows = {r["name"]: r for r in parsed.collect()}
    assert rows["abc.md"]["ticker"] == "ABC" and rows["abc.md"]["opened"] == dt.date(2024, 2, 3) and rows["none.md"]["ticker"] is None
    assert [r["description"] for r in theses.kill_conditions_of(parsed).collect()] == ["falls"]
    changed = documents.with_metadata(doc, {"shares": 7, "health_score": 60})
    assert "shares: 7 # held" in changed and "health_score: 60\n```" in changed
    raws = ['x {"business_health": {"score": 140}, "y": 1} z', 'a ```json\n{"business_health": {"score": 12.9}, "y": {"score": "5"}}\n``` {', "5", "null", "", None, '{"y": {"score": true}, "business_health": {"score": -3}}', "{bad"]
    scores = spark.createDataFrame(list(enumerate(raws)), "i int, r string").select("i", theses.loose_scores("r", ("business_health", "y")).alias("s"))
    assert [json.loads(r["s"]) for r in scores.orderBy("i").collect()] == [{"business_health": 100}, {"business_health": 12}, {}, {}, {}, {}, {"business_health": 0}, {}]
    files = ["# A\n## Kill Conditions\n| a | b |\n|---|---|\n| 1 | 2 |\n| [x] | 3 |\n|4|5|\n\n| 6 | 7 |\n", "## Kill conditions x\nno\n## Kill Conditions\n | a |\n |---|\n  | v \t|\r\n", None, "# kill conditions\n| only |\n"]
    cells = spark.createDataFrame(list(enumerate(files)), "i int, d string").select("i", theses.table_cells("d", F.lit("Kill Conditions")).alias("c"))
    assert [r["c"] for r in cells.orderBy("i").collect()] == [[["1", "2"], ["4", "5"]], [["v"]], [], []]
    assert "Python" not in cells._jdf.queryExecution().executedPlan().toString() + scores._jdf.queryExecution().executedPlan().toString()


def test_trees(spark):
    nodes = spark.createDataFrame([("d", 0, 1, "a" * 40), ("d", 1, 2, "a" * 40), ("d", 2, 3, "a" * 4), ("d", 3, 1, "a" * 40)], "doc string, node int, level int, text string")
    t = trees.subtree_tokens(nodes).orderBy("node").collect()
    assert [r["tokens"] for r in t] == [21, 11, 1, 10]
    assert [r["node"] for r in trees.thinned(trees.subtree_tokens(nodes), 12).orderBy("node").collect()] == [0, 1, 3]
    assert {r["node"] for r in trees.leaves(trees.parents_by_level(nodes)).collect()} == {2, 3}


def test_queue_stream(spark, tmp_path):
    for i, (form, text) in enumerate([("S-8", None), ("10-K", None), (None, "{bad"), ("10-K", None)]):
        body = text or json.dumps({"id": f"r{i}", "ticker": "T", "form": form, "requested_at": f"2024-01-0{i + 1}T00:00:00"})
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{i}.json").write_text(body)
    done = []
    empty = spark.createDataFrame([], "ticker string, form string, commit string")

    def work(batch, n):
        done.extend((r["id"], r["place"], r["state"]) for r in queue.outcome(batch, empty, "c").orderBy("place").collect())

    for _ in range(2):  # a restart finds nothing new
        queue.run(spark, str(tmp_path / "in"), str(tmp_path / "check"), work).awaitTermination(120)
    assert done == [("r1", 1, "indexed"), ("r3", 2, "skipped"), ("r0", 3, "indexed")]


def test_views_and_queries_take_every_row(spark, tmp_path):
    import duckdb

    from marlstone.plans import catalog

    d = str(tmp_path)
    spark.range(1200).selectExpr("id AS c_custkey", "CASE id % 5 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'MACHINERY' ELSE 'FURNITURE' END AS c_mktsegment", "CAST(id % 25 AS INT) AS c_nationkey", "id * 7.5D - 900 AS c_acctbal").write.parquet(f"{d}/customer.parquet")
    spark.range(140).selectExpr("id AS doc_id", "repeat(concat('see page ', id, ' of the exhibit 13\n'), CAST(id + 1 AS INT)) AS text", "'en' AS lang", "concat('s', id % 3) AS source", "0L AS n_chars").write.parquet(f"{d}/documents.parquet")
    con = duckdb.connect()
    for t in ("customer", "documents"):
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet/*.parquet'")
    rows = {"jn12_risk_matrix": 1200, "str21_formats": 1200, "agg28_monitoring": 432, "jn09_chosen_paths": 140, "str13_manifest": 420, "flt13_statements": 140, "sec05_pointers": 140, "sec06_recovery": 140, "agg25_page_offset": 7, "jn10_title_pairs": None, "sec10_flatten": None}
    for name, n in rows.items():
        df = catalog.QUERIES[name](spark, d)
        got = [tuple(r) for r in df.collect()]
        want = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in df.columns)} FROM ({catalog.ORACLE_SQL[name]})").fetchall()
        assert sorted(got, key=repr) == sorted(want, key=repr), name
        assert n is None or len(got) == n, name
    whole = {r["accession"]: r["text"] for r in catalog.QUERIES["sec10_flatten"](spark, d).groupBy("accession").agg(F.expr("array_join(transform(array_sort(collect_list(struct(chunk, text))), x -> x.text), '') AS text")).collect()}
    assert whole == {str(r["doc_id"]): r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
