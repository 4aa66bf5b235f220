"""Queries of stores, letters, record checks, queue states, the stock view and the whole search path, with their SQL."""

from __future__ import annotations

import uuid
import zlib

from pyspark.sql import functions as F

from ..functions import records, scalar
from ..operators import filings, letters, screener, search, sections, theses, timing, trees
from ..sources import scratch, tables
from ..streaming import lifecycle, queue
from . import finding
from .bindings import view
from .registry import query


def written(spark, d):
    return view(spark, d, "theses")


def nodes(spark, d):
    return view(spark, d, "nodes")


# --- stores
def stored_bars(spark, d):
    """Bars as CSV files by ticker, written and read again."""
    path = f"{scratch.shared_root(spark)}/marlstone-{spark.sparkContext.applicationId}/bars-{zlib.crc32(d.encode())}"
    tables.write_bars(view(spark, d, "bars"), path)
    return tables.read_written_bars(spark, path)


query("src02_bar_files", "SELECT ticker, date, close, volume FROM bars")(lambda spark, d: stored_bars(spark, d).select("ticker", "date", "close", "volume"))


def raw_filings(spark, d):
    return scratch.stored(spark, ("raw-filings", d), lambda: tables.read(spark, d, "pages").select(F.col("page_id").cast("string").alias("accession"), "html"))


query("src12_raw_filings", "SELECT CAST(page_id AS VARCHAR) AS accession, sha256(html) AS html_sha256 FROM pages")(lambda spark, d: raw_filings(spark, d).select("accession", F.sha2("html", 256).alias("html_sha256")))


def trees_and_sidecars(spark, d):
    """Trees of filings, and their sidecars as JSON text, some of them broken."""
    n = nodes(spark, d)
    made = scratch.stored(spark, ("trees", d), lambda: n.select("accession", "ticker", F.array(F.struct("label", "title", "summary")).alias("sections")))
    sidecar = F.to_json(F.struct("accession", "ticker", "form", F.date_add(F.to_date(F.lit("2024-01-01")), (F.col("node") % 300).cast("int")).cast("string").alias("filed"), F.lit(1).alias("sections")))
    side = scratch.stored(spark, ("sidecars", d), lambda: n.select(F.when(F.col("node") % 7 == 0, F.substring(sidecar, 1, 25)).otherwise(sidecar).alias("json")))
    return made, side


def listed(spark, d):
    return filings.listing(trees_and_sidecars(spark, d)[1])


query("src13_tree_records", "SELECT accession, ticker, label, title, form FROM nodes WHERE node % 7 <> 0")(lambda spark, d: trees_and_sidecars(spark, d)[0].join(listed(spark, d).select("accession", "form"), "accession").select("accession", "ticker", F.explode("sections").alias("s"), "form").select("accession", "ticker", "s.label", "s.title", "form"))
query("src14_index_listing", "SELECT ticker, accession, DATE '2024-01-01' + CAST(node % 300 AS INT) AS filed FROM nodes WHERE node % 7 <> 0 ORDER BY ticker DESC, filed DESC")(lambda spark, d: listed(spark, d).select("ticker", "accession", "filed").orderBy(F.desc("ticker"), F.desc("filed")))


def caches(spark, d):
    """Cached statement files: of each filing the first or both of two, of some none."""
    n = nodes(spark, d)
    files = n.select("accession", F.explode(F.sequence(F.lit(1), F.lit(2))).alias("i"), "node").where("node % 3 >= i")
    return scratch.stored(spark, ("statement-files", d), lambda: files.select("accession", F.concat(F.lit("R"), "i", F.lit(".htm")).alias("file"), F.concat(F.lit("table "), "i", F.lit(" of "), "accession").alias("text")))


query("src15_cached_files", "SELECT accession, 'R' || i || '.htm' AS file, CASE WHEN node % 3 >= i THEN 'table ' || i || ' of ' || accession END AS text FROM nodes, (VALUES (1), (2)) v(i)")(
    lambda spark, d: nodes(spark, d).select("accession", F.explode(F.array(F.lit("R1.htm"), F.lit("R2.htm"))).alias("file")).join(caches(spark, d), ["accession", "file"], "left").select("accession", "file", "text")
)
query("src27_screen_contexts", "SELECT thesis, CAST(CAST(number % 10 AS DOUBLE) + CASE lower(color) WHEN 'green' THEN 4 WHEN 'blue' THEN 4 WHEN 'orange' THEN 6 WHEN 'red' THEN 8 ELSE 10 END AS DOUBLE) AS hurdle_pct, CASE WHEN lower(color) IN ('red', 'danger') THEN 'Maximum Value Only' WHEN lower(color) = 'orange' THEN 'Tightened' ELSE 'Standard' END AS stance FROM theses")(
    lambda spark, d: screener.contexts(written(spark, d).select("thesis", F.lower("color").alias("color"), (F.col("number") % 10).cast("double").alias("rate_pct"))).select("thesis", "hurdle_pct", "stance")
)

# --- timing and rendering
query("agg27_stage_totals", "SELECT user_id % 10 AS run, event_type AS stage, count(*) FILTER (WHERE event_id % 9 > 0) AS n, count(*) FILTER (WHERE event_id % 9 = 0) AS failed, CAST(coalesce(sum(CASE WHEN event_id % 9 > 0 THEN event_id % 50 END), 0) AS BIGINT) AS total, max(CASE WHEN event_id % 9 > 0 THEN event_id % 50 END) AS longest FROM events GROUP BY 1, 2")(
    lambda spark, d: timing.stage_totals(tables.read(spark, d, "events").select((F.col("user_id") % 10).alias("run"), F.col("event_type").alias("stage"), F.when(F.col("event_id") % 9 > 0, F.col("event_id") % 50).alias("seconds"))).select("run", "stage", "n", "failed", "total", "longest")
)
query("str23_table_lines", "SELECT '| ' || thesis || ' | ' || replace(bucket || '|' || status, '|', '\\|') || ' | ' || CAST(number AS VARCHAR) || ' |' AS line FROM theses")(lambda spark, d: theses.markdown_rows(written(spark, d).withColumn("both", F.concat_ws("|", "bucket", "status")), ["thesis", "both", "number"]).select("line"))

# --- records
query("jsn01_key_repair", "SELECT thesis, 'S' || thesis AS summary, CASE WHEN number % 3 = 0 THEN CAST(number % 7 AS DOUBLE) ELSE 0.0 END AS severity, CASE WHEN number % 2 = 0 THEN thesis END AS extra FROM theses")(
    lambda spark, d: written(spark, d)
    .select("thesis", F.when(F.col("number") % 5 == 0, F.to_json(F.struct(F.concat(F.lit("S"), "thesis").alias("summary"), F.lit("no").alias("gist")))).otherwise(F.to_json(F.struct(F.when(F.col("number") % 2 == 0, F.concat(F.lit("S"), "thesis")).alias("gist"), F.when(F.col("number") % 2 == 1, F.concat(F.lit("S"), "thesis")).alias("overview")))).alias("j"), "number")
    .select("thesis", F.concat(F.expr("substring(j, 1, length(j) - 1)"), F.when(F.col("number") % 3 == 0, F.format_string(',"level":%d', F.col("number") % 7)).otherwise(""), F.when(F.col("number") % 2 == 0, F.format_string(',"extra":"%s"', "thesis")).otherwise(""), F.lit("}")).alias("j"))
    .select("thesis", records.repaired(F.col("j"), {"gist": "summary", "overview": "summary", "level": "severity"}, {"severity": "0"}).alias("m"))
    .select("thesis", F.col("m")["summary"].alias("summary"), F.col("m")["severity"].try_cast("double").alias("severity"), F.try_element_at("m", F.lit("extra")).alias("extra"))
)
query("jsn02_shape_check", "SELECT thesis, CASE number % 6 WHEN 0 THEN ['missing:score', 'missing:name'] WHEN 1 THEN ['wrongtype:score (want number)'] WHEN 2 THEN [] WHEN 3 THEN ['not an object'] WHEN 4 THEN ['not an object'] ELSE ['missing:score', 'wrongtype:name (want string)'] END AS problems, CAST(number % 3 AS INT) AS integers FROM theses")(
    lambda spark, d: written(spark, d)
    .select("thesis", F.element_at(F.array(F.lit('{"a": 1}'), F.lit('{"score": "x", "name": "n"}'), F.format_string('{"score": %d.5, "name": "%s"}', "number", "thesis"), F.lit("[1]"), F.lit("nonsense"), F.format_string('{"name": %d}', "number")), (F.col("number") % 6 + 1).cast("int")).alias("j"), F.format_string('{"properties": {"a": {"type": "number"}, "b": {"type": "%s"}, "c": {"type" : "%s"}}}', F.when(F.col("number") % 3 > 0, "integer").otherwise("string"), F.when(F.col("number") % 3 > 1, "integer").otherwise("array")).alias("schema"))
    .select("thesis", records.problems(F.col("j"), {"score": "number", "name": "string"}).alias("problems"), records.integer_types(F.col("schema")).alias("integers"))
)


# --- pages: HTML made of columns, so that what it says is known
def markup(spark, d):
    level = (1 + F.col("node") % 4).cast("string")
    head = lambda text: F.concat(F.lit("<h"), level, F.lit(">"), text, F.lit("</h"), level, F.lit(">"))
    deeper = F.when(F.col("node") % 3 == 0, F.concat(F.lit("<h6>Deep "), "form", F.lit("</h6>"))).otherwise("")
    return nodes(spark, d).select("node", F.concat(F.lit("<html><head><title>Page "), "accession", F.lit("</title><style>p {x: y}</style></head><body><div>"), head(F.concat(F.lit("First "), "label")), F.lit("</div><p>Text of <b>"), "ticker", F.lit("</b> here</p><script>var no = 1;</script>"), deeper, F.lit("<ul><li>one</li><li>two "), "accession", F.lit("</li></ul>"), head(F.concat(F.lit("Last &amp; "), "ticker")), F.lit("<noscript>no</noscript><br/>\n<p>end   of\tit</p></body></html>")).alias("html"))


NL, NN = "chr(10)", "chr(10) || chr(10)"
DEEP = "CASE WHEN node % 3 = 0 THEN"
query("str07_html_text", f"SELECT node, 'Page ' || accession || {NL} || 'First ' || label || {NL} || 'Text of' || {NL} || ticker || {NL} || 'here' || {NL} || {DEEP} 'Deep ' || form || {NL} ELSE '' END || 'one' || {NL} || 'two ' || accession || {NL} || 'Last & ' || ticker || {NL} || {NL} || 'end of it' AS text FROM nodes")(lambda spark, d: markup(spark, d).select("node", F.regexp_replace(filings.html_text("html"), "\n{2,}", "\n\n").alias("text")))
query("str08_html_markdown", f"SELECT node, 'First ' || label || {NN} || 'Text of ' || ticker || ' here' || {NN} || {DEEP} '###### Deep ' || form || {NN} ELSE '' END || 'one' || {NN} || 'two ' || accession || {NN} || repeat('#', CAST(1 + node % 4 AS INT)) || ' Last & ' || ticker || {NN} || 'end of it' AS markdown FROM nodes")(lambda spark, d: markup(spark, d).select("node", filings.html_markdown("html").alias("markdown")))
query("sec03_page_sections", f"SELECT node AS id, 'last-' || ticker AS label, 'Last & ' || ticker AS title, 'end of it' AS text FROM nodes")(lambda spark, d: filings.generic_sections(markup(spark, d).select(F.col("node").alias("id"), filings.html_markdown("html").alias("markdown"))).select("id", "label", "title", "text"))


def reports(spark, d):
    """Annual reports with a table of contents and four sections, one of which may be a pointer; every seventh has the contents only."""
    body = lambda name, more: F.rtrim(F.repeat(F.concat(F.lit(f"{name} of "), "ticker", F.lit(" goes on and on. ")), (20 + F.col("node") % more).cast("int")))
    risk = F.when(F.col("node") % 4 == 0, "See the Annual Report to Shareholders.").when(F.col("node") % 4 == 1, "Refer to our Proxy Statement.").otherwise(body("Risk", 5))
    text = F.concat(F.lit("\nPART I\nItem 1. Business\n"), body("Business", 3), F.lit("\nItem 1A - Risk Factors\n"), risk, F.lit("\nItem 7: Management's Discussion and Analysis\n"), body("Talk", 7), F.lit("\nITEM 8. FINANCIAL STATEMENTS\n"), body("Money", 4), F.lit("\nItem 9. Other\nnothing more"))
    return nodes(spark, d).select("node", F.concat(F.lit("<p>Item 1. Business 4 - 9</p><p>Item 1A. Risk Factors 10 - 24</p>"), F.when(F.col("node") % 7 == 0, "").otherwise(F.concat(F.lit("<pre>"), text, F.lit("</pre>")))).alias("content"))


_BODY = lambda name, more: f"rtrim(repeat('{name} of ' || ticker || ' goes on and on. ', CAST(20 + node % {more} AS INT)))"
CURATED_SQL = f"""rp AS (SELECT node, 0 AS pos, 'business' AS label, 'Item 1. Business' AS title, {_BODY("Business", 3)} AS text, CAST(NULL AS VARCHAR) AS target FROM nodes WHERE node % 7 > 0
UNION ALL SELECT node, 1, 'risk_factors', 'Item 1A - Risk Factors', CASE node % 4 WHEN 0 THEN 'See the Annual Report to Shareholders.' WHEN 1 THEN 'Refer to our Proxy Statement.' ELSE {_BODY("Risk", 5)} END, CASE node % 4 WHEN 0 THEN 'annual_report_same_doc' WHEN 1 THEN 'def14a' END FROM nodes WHERE node % 7 > 0
UNION ALL SELECT node, 2, 'mdna', 'Item 7: Management''s Discussion and Analysis', {_BODY("Talk", 7)}, NULL FROM nodes WHERE node % 7 > 0
UNION ALL SELECT node, 3, 'financial_statements', 'ITEM 8. FINANCIAL STATEMENTS', {_BODY("Money", 4)}, NULL FROM nodes WHERE node % 7 > 0
UNION ALL SELECT node, 0, 'filing-content', 'Filing content', 'Item 1. Business 4 - 9' || chr(10) || chr(10) || 'Item 1A. Risk Factors 10 - 24', NULL FROM nodes WHERE node % 7 = 0)"""


def report_sections(spark, d, form, kind="html"):
    found = sections.sections(reports(spark, d).select(F.col("node").alias("id"), "content", F.lit(form).alias("form"), F.lit(kind).alias("kind")))
    return found.select(F.col("id").alias("node"), "pos", "label", "title", "text", "target")


query("sec01_curated_sections", f"WITH {CURATED_SQL} SELECT node, pos, label, title, text, target FROM rp WHERE label <> 'filing-content'")(lambda spark, d: report_sections(spark, d, "10-K").where("label <> 'filing-content'"))
query("sec02_sections_after_contents", f"WITH {CURATED_SQL} SELECT node, pos, label, title, text, target FROM rp")(lambda spark, d: report_sections(spark, d, " 10-q "))
query("sec04_sections_by_form", f"WITH {CURATED_SQL} SELECT node, 0 AS pos, 'filing-content' AS label, length(text) AS size FROM (SELECT n.node, 'Item 1. Business 4 - 9' || chr(10) || chr(10) || 'Item 1A. Risk Factors 10 - 24' || CASE WHEN n.node % 7 > 0 THEN chr(10) || chr(10) || 'PART I' || chr(10) || string_agg(rp.title || chr(10) || rp.text, chr(10) ORDER BY pos) || chr(10) || 'Item 9. Other' || chr(10) || 'nothing more' ELSE '' END AS text FROM nodes n LEFT JOIN rp ON rp.node = n.node GROUP BY n.node)")(lambda spark, d: report_sections(spark, d, "8-K").select("node", "pos", "label", F.length("text").cast("bigint").alias("size")))
query("pix05_page_groups", "WITH pg AS (SELECT node // 20 AS doc, node % 20 AS page, length(text) // 4 AS tokens FROM nodes), g AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY doc ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(tokens) OVER (PARTITION BY doc) AS whole FROM pg), h AS (SELECT doc, page, tokens, CAST(floor(before * greatest(1, ceil(whole / 2000.0)) / greatest(1, whole)) AS BIGINT) AS grp FROM g), n AS (SELECT *, lead(grp) OVER (PARTITION BY doc ORDER BY page) AS nx FROM h) SELECT doc, page, tokens, grp AS \"group\", false AS overlap FROM n UNION ALL SELECT doc, page, tokens, nx, true FROM n WHERE nx > grp")(lambda spark, d: trees.page_groups(nodes(spark, d).select(F.floor(F.col("node") / 20).alias("doc"), (F.col("node") % 20).alias("page"), F.floor(F.length("text") / 4).alias("tokens")), 2000))

# --- theses
def files(spark, d):
    """Thesis files: a fence with metadata, components in the fence or in a table, kill conditions in a table."""
    t = tables.spread(written(spark, d), "thesis")
    listed = F.when(F.col("number") % 2 == 0, F.format_string("health_components:\n  - {name: Risk %s, weight: 40, score: %d}\n", "bucket", F.col("number") % 100)).otherwise("")
    table = F.format_string("\n## Thesis Health\n\n| Component | Weight | Score | Notes |\n| --- | --- | --- | --- |\n| Value %s | 30%% | %d/100 | ok |\n| [name] | 1%% | 2/100 | |\n", "bucket", F.col("number") % 90)
    kills = F.format_string("\n## Kill Conditions\n\n| # | Kill condition | Monitor | Last checked |\n| --- | --- | --- | --- |\n| 1 | falls %s | daily | 2024-01-01 |\n| 2 | [placeholder] | x | y |\n", "thesis")
    head = F.format_string("# Thesis\n\n```yaml\nticker: t%s\ncompany: C%s\nbucket: %s\nstatus: %s\nopened: 2024-01-05\nhealth_score: %d\ncost_basis: %s\nshares: %d  # held\n", "thesis", "thesis", "bucket", "status", F.col("number") % 50, F.col("balance").cast("string"), "number")
    return t.select(F.concat("thesis", F.lit(".md")).alias("name"), F.concat(head, listed, F.lit("```\n"), table, kills).alias("content"), "number", "thesis", "bucket")


query("str17_table_cells", "SELECT thesis || '.md' AS name, [['1', 'falls ' || thesis, 'daily', '2024-01-01']] AS cells FROM theses")(lambda spark, d: files(spark, d).select("name", theses.table_cells("content", F.lit("Kill Conditions")).alias("cells")))
query("str18_components", "SELECT thesis || '.md' AS name, CASE WHEN number % 2 = 0 THEN 'Risk ' ELSE 'Value ' END || bucket AS component, CASE WHEN number % 2 = 0 THEN 40 ELSE 30 END AS weight, CAST(CASE WHEN number % 2 = 0 THEN number % 100 ELSE number % 90 END AS INT) AS score FROM theses")(lambda spark, d: theses.components_of(theses.parsed(files(spark, d))).select("name", "component", "weight", "score"))
query("str18_kill_conditions", "SELECT thesis || '.md' AS name, 'falls ' || thesis AS description, 'daily' AS monitoring FROM theses")(lambda spark, d: theses.kill_conditions_of(theses.parsed(files(spark, d))).select("name", "description", "monitoring"))
query("str22_cost_basis", "SELECT thesis || '.md' AS name, balance AS cost_basis FROM theses")(lambda spark, d: files(spark, d).select("name", theses.cost_basis(F.col("content")).alias("cost_basis")))
query("str19_metadata_update", "SELECT thesis || '.md' AS name, 'shares: ' || CAST(number + 1 AS VARCHAR) || '  # held' AS shares, 'health_score: ' || CAST(number % 50 AS VARCHAR) AS score FROM theses")(
    lambda spark, d: files(spark, d).select("name", theses.with_value(F.col("content"), "shares", F.col("number") + 1).alias("c")).select("name", F.regexp_extract("c", r"(?m)^(shares:.*)$", 1).alias("shares"), F.regexp_extract("c", r"(?m)^(health_score:.*)$", 1).alias("score"))
)
query("str19_health_update", "SELECT thesis || '.md' AS name, [['A ' || bucket, '60%', CAST(number % 80 AS VARCHAR) || '/100', 'n$' || thesis], ['B', '40%', '7/100', '']] AS cells, 'health_score: ' || CAST(number % 77 AS VARCHAR) AS score, ['1', 'falls ' || thesis, 'daily', '2024-01-01'] AS kill FROM theses")(
    lambda spark, d: files(spark, d)
    .withColumn("new", F.array(F.struct(F.concat(F.lit("A "), "bucket").alias("name"), F.lit(60).alias("weight"), (F.col("number") % 80).cast("int").alias("score"), F.concat(F.lit("n$"), "thesis").alias("notes")), F.struct(F.lit("B").alias("name"), F.lit(40).alias("weight"), F.lit(7).alias("score"), F.lit(None).cast("string").alias("notes"))))
    .select("name", theses.with_scores(F.col("content"), F.col("new"), F.col("number") % 77).alias("c"))
    .select("name", theses.table_cells("c", F.lit("Thesis Health")).alias("cells"), F.regexp_extract("c", r"(?m)^(health_score:.*)$", 1).alias("score"), theses.table_cells("c", F.lit("Kill Conditions"))[0].alias("kill"))
)
query("src19_thesis_files", "SELECT thesis || '.md' AS name FROM theses ORDER BY name")(lambda spark, d: theses.listed_documents(files(spark, d).select("name").union(spark.createDataFrame([("_template.md",), ("notes.txt",)], "name string")), "template"))


# --- letters
def letter_files(spark, d):
    """A letter per thesis: as many quarters written as its number says, of some the summary too."""
    t = tables.spread(written(spark, d), "thesis")
    content = letters.skeleton(2000 + F.col("number") % 5)
    for q in letters.QUARTERS:
        content = F.when(F.col("number") % 5 >= q, F.regexp_replace(content, F.lit(rf"(## Q{q}:[^\n]*\n\n)\[To be populated\.\]"), F.concat(F.lit("$1### Regime\n"), F.lower("color")))).otherwise(content)
    content = F.when(F.col("number") % 7 == 0, F.replace(content, F.lit("[To be written at year-end finalization.]"), F.lit("All is said."))).otherwise(content)
    return t.select("thesis", F.col("thesis").alias("name"), content.alias("content"), "number")


QUARTER_SQL = "qs(k, header) AS (VALUES (1, 'Q1: January — March'), (2, 'Q2: April — June'), (3, 'Q3: July — September'), (4, 'Q4: October — December'), (8, 'Year in Context'), (9, 'Full Year Summary'))"
query("sec13_letter_sections", f"WITH {QUARTER_SQL} SELECT thesis, header, k <= number % 5 AS written FROM theses, qs")(lambda spark, d: letter_files(spark, d).select("thesis", F.explode(letters.sections(F.col("content"))).alias("s")).select("thesis", "s.header", "s.written"))
query("sec15_letter_status", "SELECT thesis, CAST(range(1, number % 5 + 1) AS INT[]) AS quarters, number % 7 = 0 AS finalized, number % 5 = 4 AND number % 7 <> 0 AS may_finalize FROM theses")(lambda spark, d: letters.status(letter_files(spark, d)).select(F.col("name").alias("thesis"), "quarters", "finalized", "may_finalize"))
query("sec15_letter_update", "SELECT thesis, CASE WHEN number % 6 + 1 > 4 THEN 'missing' WHEN number % 5 >= number % 6 + 1 THEN 'refused' ELSE 'written' END AS outcome, CASE WHEN number % 6 + 1 > 4 THEN NULL WHEN number % 5 >= number % 6 + 1 THEN '### Regime' || chr(10) || lower(color) ELSE '### New' || chr(10) || thesis END || chr(10) || chr(10) || '---' AS body, 6::BIGINT AS sections FROM theses")(
    lambda spark, d: letters.updated(letter_files(spark, d).withColumn("quarter", (F.col("number") % 6 + 1).cast("int")).withColumn("body", F.concat(F.lit("### New\n"), "thesis")))
    .select(F.col("name").alias("thesis"), "outcome", letters.quarter_of_letter(F.col("content"), F.col("quarter"))["body"].alias("body"), F.size(letters.sections(F.col("content"))).cast("bigint").alias("sections"))
)
query("sec15_letter_forced", "SELECT thesis, 'written' AS outcome, '### New' || chr(10) || thesis || chr(10) || chr(10) || '---' AS body FROM theses")(
    lambda spark, d: letters.updated(letter_files(spark, d).withColumn("quarter", (F.col("number") % 4 + 1).cast("int")).withColumn("body", F.concat(F.lit("### New\n"), "thesis")), force=True).select(F.col("name").alias("thesis"), "outcome", letters.quarter_of_letter(F.col("content"), F.col("quarter"))["body"].alias("body"))
)
query("src25_letters", "SELECT DISTINCT CAST(year(date) AS VARCHAR) || '-letter.md' AS name, '# ' || CAST(year(date) AS VARCHAR) || ' Investor Letter' AS title FROM bars")(
    lambda spark, d: view(spark, d, "bars").select(F.year("date").alias("year")).distinct().select(F.concat(F.col("year").cast("string"), F.lit("-letter.md")).alias("name"), F.split(letters.skeleton(F.col("year")), "\n")[0].alias("title"))
)


# --- queue
LOG_SQL = "lg AS (SELECT user_id AS id, CASE event_type WHEN 'view' THEN 'enqueue' WHEN 'click' THEN 'claim' WHEN 'purchase' THEN 'done' WHEN 'signup' THEN 'failed' ELSE 'other' END AS kind, event_id % 3 AS worker, ts AS tm, event_id AS seq FROM events)"


def log(spark, d):
    kind = scalar.lookup(F.col("event_type"), {"view": "enqueue", "click": "claim", "purchase": "done", "signup": "failed"}, F.lit("other"))
    return tables.read(spark, d, "events").select(F.col("user_id").alias("id"), kind.alias("kind"), (F.col("event_id") % 3).alias("worker"), F.col("ts").alias("at"), F.col("event_id").alias("seq"))


STATES_SQL = f"WITH {LOG_SQL}, pt AS (SELECT id, min(struct_pack(a := tm, s := seq)) AS p FROM lg WHERE kind = 'enqueue' GROUP BY id), lt AS (SELECT lg.*, struct_pack(a := tm, s := seq) AS w FROM lg JOIN pt ON lg.id = pt.id WHERE struct_pack(a := tm, s := seq) > p), cl AS (SELECT id, arg_min(worker, w) AS claimed_by, min(w) AS c FROM lt WHERE kind = 'claim' GROUP BY id), en AS (SELECT lt.id, arg_min(kind, w) AS ended, min(w).a AS ended_at FROM lt JOIN cl ON lt.id = cl.id WHERE kind IN ('done', 'failed') AND worker = claimed_by AND w > c GROUP BY lt.id) SELECT pt.id, coalesce(ended, CASE WHEN claimed_by IS NOT NULL THEN 'claimed' ELSE 'pending' END) AS state, claimed_by, ended_at FROM pt LEFT JOIN cl ON cl.id = pt.id LEFT JOIN en ON en.id = pt.id"
query("stm02_states", STATES_SQL)(lambda spark, d: queue.states(log(spark, d)))
query("stm06_health", f"WITH {LOG_SQL}, sn AS (SELECT worker, max(tm) AS last_at, count(*) FILTER (WHERE kind = 'done') AS done, count(*) FILTER (WHERE kind = 'failed') AS failed FROM lg GROUP BY worker) SELECT v.worker, last_at, coalesce(done, 0) AS done, coalesce(failed, 0) AS failed, coalesce(epoch(TIMESTAMP '2024-01-30 12:00:00')::BIGINT - floor(epoch(last_at))::BIGINT > 600, true) AS late, v.worker <> 1 AS outdated FROM (VALUES (0), (1), (2), (7)) v(worker) LEFT JOIN sn ON sn.worker = v.worker")(
    lambda spark, d: queue.health(log(spark, d), spark.createDataFrame([(0, "old"), (1, "new"), (2, None), (7, "old")], "worker bigint, commit string"), "new", F.to_timestamp(F.lit("2024-01-30 12:00:00")), 600).select(F.col("worker").cast("int").alias("worker"), "last_at", "done", "failed", "late", "outdated")
)


def followed(spark, d, rows, changes, schema):
    """The last changes of the log in two runs of a stream: the earlier half of it, and after a restart the rest."""
    folder = f"{scratch.shared_root(spark)}/marlstone-{spark.sparkContext.applicationId}/log-{uuid.uuid4().hex}"
    rows = rows.select("id", "kind", F.col("worker").cast("long").alias("worker"), F.col("at").cast("timestamp").alias("at"), "seq")
    middle = rows.agg(F.timestamp_micros(((F.min(F.unix_micros("at")) + F.max(F.unix_micros("at"))) / 2).cast("long"))).first()[0]
    for part in (F.col("at") < F.lit(middle), F.col("at") >= F.lit(middle)):
        rows.where(part).write.mode("append").parquet(f"{folder}/log")
        lifecycle.follow(spark, lambda: changes(lifecycle.log_stream(spark, f"{folder}/log", "5 days")), folder, partitions=8).awaitTermination()
    return lifecycle.latest(spark, folder, schema)


query("stm02_stream", STATES_SQL)(lambda spark, d: followed(spark, d, log(spark, d), lifecycle.request_changes, lifecycle.REQUESTS).select("id", "state", "claimed_by", F.col("ended_at").cast("timestamp_ntz").alias("ended_at")))
query("stm06_stream", "WITH w AS (SELECT user_id AS worker, max(ts) AS last_at, count(*) FILTER (WHERE event_type = 'purchase') AS done, count(*) FILTER (WHERE event_type = 'signup') AS failed FROM events GROUP BY user_id) SELECT *, epoch_ms(last_at) + 43200000 < (SELECT max(epoch_ms(ts)) FROM events) - 432000000 AS late FROM w")(
    lambda spark, d: followed(spark, d, log(spark, d).withColumn("worker", F.col("id")), lambda rows: lifecycle.worker_changes(rows, 43_200), lifecycle.WORKERS).select("worker", F.col("last_at").cast("timestamp_ntz").alias("last_at"), "done", "failed", "late")
)


# --- the stock view
def stock_view(spark, d):
    t = written(spark, d).select("thesis", F.lower("color").alias("color"), "number")
    covered = filings.coverage(view(spark, d, "requests")).select(F.col("ticker").alias("thesis"), "indexed")
    numbers = view(spark, d, "candidates").select(F.col("ticker").alias("thesis"), "pe", "roe")
    hurdles = t.select("color").distinct().select("color", scalar.hurdle(F.lit(4.0), F.col("color")).alias("hurdle_pct"))
    n = nodes(spark, d).select(F.regexp_replace("ticker", "^src", "").alias("thesis"), F.col("label").alias("dimension"), "node", F.length("text").alias("size"))
    lens = search.best_of_each(n, ["thesis", "dimension"], [F.desc("size"), F.col("node")], 2)
    return theses.stock_view(t, covered, numbers, hurdles, lens)


query("sec16_stock_view", "WITH r AS (SELECT ticker, count(*) AS n FROM requests GROUP BY 1), v AS (SELECT thesis, list(struct_pack(dimension := label, rank := k, node := node) ORDER BY label, k, node) AS views FROM (SELECT regexp_replace(ticker, '^src', '') AS thesis, label, node, row_number() OVER (PARTITION BY ticker, label ORDER BY length(text) DESC, node) - 1 AS k FROM nodes) WHERE k < 2 GROUP BY 1) SELECT t.thesis, coalesce(n, 0) AS filings, n IS NULL AS empty, CASE WHEN n IS NOT NULL THEN pe END AS pe, CASE WHEN n IS NOT NULL THEN roe END AS roe, CASE WHEN n IS NOT NULL THEN 4.0 + CASE lower(color) WHEN 'green' THEN 4 WHEN 'blue' THEN 4 WHEN 'orange' THEN 6 WHEN 'red' THEN 8 ELSE 10 END END::DOUBLE AS hurdle_pct, CASE WHEN n IS NOT NULL THEN list_transform(views, lambda x : x.dimension || '/' || x.rank || '/' || x.node) END AS views FROM theses t LEFT JOIN r ON r.ticker = t.thesis LEFT JOIN candidates c ON c.ticker = t.thesis LEFT JOIN v ON v.thesis = t.thesis")(
    lambda spark, d: stock_view(spark, d).withColumn("views", F.transform("views", lambda x: F.concat_ws("/", x["dimension"], x["rank"].cast("string"), x["node"].cast("string"))))
)


# --- the whole search path: every third query comes with two paraphrases, every second one with picked nodes
def words(low: int):
    return F.array_join(F.slice(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " "), low, 2), " ")


LIMIT = 26.0


def searched(spark, d, k=5):
    b = tables.read(spark, d, "benchmark")
    q = finding.mixed_queries(spark, d)
    p = b.where("item_id % 3 = 0").select(F.col("item_id").alias("query_id"), F.explode(F.array(words(5), words(7))).alias("paraphrase"))
    picks = b.where("item_id % 2 = 0").select(F.col("item_id").alias("query_id"), F.posexplode(F.array(F.col("item_id") % 50, F.col("item_id") % 50 + 60)).alias("place", "node"))
    asked = q.select("query_id", "query").unionByName(p.select("query_id", F.col("paraphrase").alias("query")))
    return search.search(nodes(spark, d), q, p, picks, k, LIMIT, finding.index(spark, d, asked, "lists"))


_LISTS = finding.search_sql(
    "qs AS (SELECT CAST(item_id AS VARCHAR) || '/-1' AS query_id, array_to_string(list_slice(string_split(replace(text, chr(10), ' '), ' '), 1, 4), ' ') || CASE WHEN item_id % 2 = 0 THEN ' balance sheet' ELSE '' END AS query FROM benchmark"
    " UNION ALL SELECT CAST(item_id AS VARCHAR) || '/' || CAST(row_number() OVER (PARTITION BY item_id ORDER BY p) - 1 AS VARCHAR), p FROM (SELECT item_id, unnest([array_to_string(list_slice(string_split(replace(text, chr(10), ' '), ' '), x, x + 1), ' ') FOR x IN [5, 7]]) AS p FROM benchmark WHERE item_id % 3 = 0))"
)
SEARCHED_SQL = f"""{_LISTS},
ls AS (SELECT split_part(query_id, '/', 1) AS q, split_part(query_id, '/', 2) AS place, node, score, rank, ticker, label FROM rk WHERE score > 0),
bs AS (SELECT CAST(item_id AS VARCHAR) AS q, item_id, coalesce(max(score), 0) < {LIMIT} AS weak FROM benchmark LEFT JOIN ls ON ls.q = CAST(item_id AS VARCHAR) AND place = '-1' GROUP BY 1, 2),
st AS (SELECT q, item_id, weak, (SELECT max(node) FROM nodes WHERE label = 'financial_statements') AS node FROM bs WHERE item_id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM ls WHERE ls.q = bs.q AND place = '-1' AND label = 'financial_statements')),
fl AS (SELECT ls.q, node, rank, score, CASE WHEN place = '-1' THEN 1.0 ELSE 0.7 END AS weight FROM ls JOIN bs ON bs.q = ls.q WHERE weak
  UNION ALL SELECT q, node, 0, 0.0, 1.0 FROM st WHERE weak AND node IS NOT NULL
  UNION ALL SELECT q, item_id % 50 + 60 * i, i, 2.0, 1.0 FROM bs, (VALUES (0), (1)) v(i) WHERE weak AND item_id % 2 = 0),
fu AS (SELECT q, node, floor(sum(weight / (61 + rank)) * 1e9 + 0.5) / 1e9 AS fused, max(score) AS score FROM fl GROUP BY 1, 2),
wk AS (SELECT q, node, score, row_number() OVER (PARTITION BY q ORDER BY fused DESC, node) - 1 AS rank, true AS weak FROM fu),
ez AS (SELECT ls.q, ls.node, ls.score, ls.rank, false AS weak FROM ls JOIN bs ON bs.q = ls.q WHERE place = '-1' AND NOT weak AND rank < 5 AND NOT (rank = 4 AND ls.q IN (SELECT q FROM st))
  UNION ALL SELECT st.q, st.node, 0.0, least(4, (SELECT count(*) FROM ls WHERE ls.q = st.q AND place = '-1')), false FROM st WHERE NOT weak AND node IS NOT NULL),
fo AS (SELECT * FROM wk WHERE rank < 5 UNION ALL SELECT * FROM ez)"""
query("sec11_search", f"WITH {SEARCHED_SQL} SELECT CAST(q AS BIGINT) AS query_id, node, score, rank, weak FROM fo")(lambda spark, d: searched(spark, d))
query("sec17_hit_rows", f"WITH {SEARCHED_SQL} SELECT CAST(q AS BIGINT) AS query_id, fo.node, rank, n.ticker || ' 10-K filed 2024-01-31 → ' || n.label AS citation, CASE WHEN weak AND score = 2.0 THEN CASE WHEN length(n.text) > 240 THEN rtrim(left(n.text, 240), ' ') || '…' ELSE n.text END END AS head FROM fo JOIN nodes n ON n.node = fo.node")(
    lambda spark, d: (lambda f: search.hit_rows(f, nodes(spark, d), finding.mixed_queries(spark, d), F.lit("2024-01-31")).join(f.select("query_id", "node", "score", "weak"), ["query_id", "node"]).select("query_id", "node", "rank", "citation", F.when(F.col("weak") & (F.col("score") == 2.0), F.col("snippet")).alias("head")))(searched(spark, d))
)
query("top02_structural", f"WITH {finding.search_sql(finding.MIXED_QS)}, hh AS (SELECT query_id, node, score, ticker FROM rk WHERE label <> 'financial_statements' AND score > 0), hr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ticker DESC, node) - 1 AS rank FROM hh), ex AS (SELECT item_id AS query_id, (SELECT max(node) FROM nodes WHERE label = 'financial_statements') AS node, least(4, (SELECT count(*) FROM hh WHERE hh.query_id = item_id)) AS rank FROM benchmark WHERE item_id % 2 = 0) SELECT query_id, node, score, rank FROM hr WHERE rank < 5 AND NOT (rank = 4 AND query_id IN (SELECT query_id FROM ex)) UNION ALL SELECT query_id, node, 0.0, rank FROM ex")(lambda spark, d: search.with_structural(*finding.no_statements(spark, d), 5).select("query_id", "node", "score", "rank"))
