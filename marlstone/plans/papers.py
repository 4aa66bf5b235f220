"""Queries of filings, theses, the queue and document trees, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import records, scalar
from ..operators import filings, letters, sections, theses, trees
from ..operators.ownership import xml_report
from ..sources import merge, scratch, store, tables
from ..streaming import queue
from .bindings import view
from .registry import query

# --- forms and feeds
FORMS_SQL = "nf AS (SELECT *, upper(replace(form, ' ', '')) AS feed, trim(regexp_replace(rtrim(regexp_replace(trim(form), '/A$', '')), '^form ', '', 'i')) AS section, trim(regexp_replace(rtrim(regexp_replace(trim(upper(form)), '/A$', '')), '^FORM ', '')) AS queue, rtrim(regexp_replace(trim(upper(form)), '/A$', '')) AS status FROM requests)"
PRIORITY_SQL = "CASE WHEN queue IN ('10-K', '10-Q', '20-F', '40-F') THEN 1 WHEN queue IN ('DEF 14A', 'DEFA14A', 'DEF 14C', '8-K') THEN 2 WHEN queue IN ('3', '4', '5') THEN 3 ELSE 4 END"


def asked(spark, d):
    return view(spark, d, "requests")


def filed(spark, d):
    r = asked(spark, d)
    return r.select("ticker", F.col("id").cast("string").alias("accession"), "form", F.to_date("requested_at").alias("filed"))


FILED_SQL = "fi AS (SELECT ticker, CAST(id AS VARCHAR) AS accession, form, CAST(requested_at AS DATE) AS filed FROM requests)"


def feed(spark, d):
    """A submissions feed: one row per ticker with parallel arrays, in order of id."""
    r = asked(spark, d).groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct("id", "form", "requested_at"))).alias("a"))
    pick = lambda f: F.transform("a", f)
    return r.select("ticker", F.col("ticker").cast("int").alias("cik"), F.struct(pick(lambda x: x["form"]).alias("form"), pick(lambda x: x["id"].cast("string")).alias("accessionNumber"), pick(lambda x: F.date_format(x["requested_at"], "yyyy-MM-dd")).alias("filingDate"), pick(lambda x: F.when(x["id"] % 2 == 0, "").otherwise(F.date_format(x["requested_at"], "yyyy-MM-dd"))).alias("reportDate"), pick(lambda x: F.concat(F.when(x["id"] % 3 == 0, "xslF345X06/").otherwise(""), F.lit("doc.xml"))).alias("primaryDocument")).alias("recent"))


query("flt02_recent_filings", f"WITH {FORMS_SQL} SELECT ticker, CAST(id AS VARCHAR) AS accession, k AS place FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY CAST(requested_at AS DATE) DESC, id) AS k FROM nf WHERE feed = '10-K' AND CAST(requested_at AS DATE) >= DATE '2024-01-20' - 10) WHERE k <= 5")(lambda spark, d: filings.recent_filings(filings.submissions(feed(spark, d)), "10-K", 10, 5, F.to_date(F.lit("2024-01-20"))).select("ticker", "accession", "place"))
query("flt03_first_of_form", f"WITH {FORMS_SQL} SELECT ticker, CAST(min(id) AS VARCHAR) AS accession FROM nf WHERE feed = 'DEF14A' GROUP BY ticker")(lambda spark, d: filings.first_of_form(filings.submissions(feed(spark, d)), "DEF 14A").select("ticker", "accession"))
query("flt04_by_accession", "SELECT ticker, lpad(CAST(CAST(ticker AS INT) AS VARCHAR), 10, '0') AS cik, CAST(id AS VARCHAR) AS accession FROM requests WHERE id IN (5, 77, 901)")(lambda spark, d: filings.submissions(feed(spark, d)).where(F.col("accession").isin("5", "77", "901")).select("ticker", "cik", "accession"))
query("flt05_form_names", f"WITH {FORMS_SQL} SELECT id, feed, section, queue, status FROM nf")(lambda spark, d: asked(spark, d).select("id", filings.form_of_feed(F.col("form")).alias("feed"), filings.form_of_section(F.col("form")).alias("section"), filings.form_of_queue(F.col("form")).alias("queue"), filings.form_of_status(F.col("form")).alias("status")))
query("flt07_full_index", f"WITH {FORMS_SQL} SELECT id, section IN ('10-K', '10-Q', 'DEF 14A') OR id * 7 > 15000 AS full_index FROM nf")(lambda spark, d: asked(spark, d).select("id", filings.full_index(F.col("form"), F.col("id") * 7).alias("full_index")))
query("flt08_priority", f"WITH {FORMS_SQL} SELECT id, {PRIORITY_SQL} AS priority, {PRIORITY_SQL} <= 2 AS high_signal, {PRIORITY_SQL} = 4 AS administrative FROM nf")(lambda spark, d: asked(spark, d).select("id", filings.priority(F.col("form")).alias("priority"), (filings.priority(F.col("form")) <= 2).alias("high_signal"), (filings.priority(F.col("form")) == 4).alias("administrative")))
query("flt09_coverage", f"WITH {FORMS_SQL}, c AS (SELECT ticker, bool_or(status = '10-K') AS core, bool_or(status = '10-Q') AS has_quarterly, bool_or(status = 'DEF 14A') AS has_proxy, count(*) AS indexed FROM nf WHERE NOT (CAST(ticker AS INT) % 3 = 0 AND status = '10-K') AND NOT (CAST(ticker AS INT) % 4 = 0 AND status = '10-Q') GROUP BY ticker) SELECT ticker, CASE WHEN core THEN '10-K' END AS core_form, core AS ready, has_quarterly, has_proxy, indexed, list_filter([CASE WHEN NOT core THEN 'annual report (10-K / 20-F)' END, CASE WHEN NOT has_quarterly THEN 'latest quarterly (10-Q)' END, CASE WHEN NOT has_proxy THEN 'proxy (DEF 14A)' END], lambda x : x IS NOT NULL) AS gaps FROM c")(
    lambda spark, d: filings.coverage(asked(spark, d).where((~((F.col("ticker").cast("int") % 3 == 0) & (filings.form_of_status(F.col("form")) == "10-K"))) & (~((F.col("ticker").cast("int") % 4 == 0) & (filings.form_of_status(F.col("form")) == "10-Q")))))
)
query("flt14_document_names", "SELECT id, CASE WHEN id % 3 = 1 THEN 'forms/xsl/' ELSE '' END || ticker || '-' || id || '.xml' AS document FROM requests")(lambda spark, d: asked(spark, d).select("id", scalar.without_style_prefix(F.concat(F.when(F.col("id") % 3 == 0, F.concat(F.lit("xslF345X0"), F.col("id") % 7, F.lit("/"))).when(F.col("id") % 3 == 1, "forms/xsl/").otherwise(""), "ticker", F.lit("-"), F.col("id").cast("string"), F.lit(".xml"))).alias("document")))
query("flt16_stale_trees", "SELECT id, CASE WHEN id % 3 = 0 THEN false ELSE id % 2 = 1 OR id % 5 = 0 END AS stale FROM requests")(lambda spark, d: asked(spark, d).select("id", filings.stale_tree(F.when(F.col("id") % 3 > 0, F.lit("a")), F.when(F.col("id") % 5 > 0, F.when(F.col("id") % 2 == 1, "b").otherwise("a"))).alias("stale")))
query("src10_ticker_map", "SELECT DISTINCT ticker, lpad(ticker, 10, '0') AS cik FROM requests")(lambda spark, d: feed(spark, d).select("ticker", F.lpad(F.col("cik").cast("string"), 10, "0").alias("cik")))


def cached_maps(spark, d):
    """The map as it was kept, although it would be another now; and the other, with the cache disabled."""
    path = f"{scratch.shared_root(spark)}/marlstone-{spark.sparkContext.applicationId}/ticker-map-{uuid.uuid4().hex}"
    padded = lambda digit: lambda: feed(spark, d).select("ticker", F.lpad(F.concat(F.lit(digit), F.col("cik").cast("string")), 10, "0").alias("cik"))
    calls = [store.cached(spark, path, padded(digit), hours).select(F.lit(n).alias("call"), "ticker", "cik") for n, (digit, hours) in enumerate((("", 24), ("9", 24), ("9", 0)))]
    return calls[0].unionByName(calls[1]).unionByName(calls[2])


query("src10_cached_map", "SELECT call, ticker, lpad(CASE WHEN call = 2 THEN '9' ELSE '' END || ticker, 10, '0') AS cik FROM (SELECT DISTINCT ticker FROM requests), (VALUES (0), (1), (2)) v(call)")(cached_maps)
query("src11_latest_filing", f"WITH {FORMS_SQL} SELECT ticker, CAST(arg_max(id, struct_pack(f := CAST(requested_at AS DATE), i := -id)) AS VARCHAR) AS accession FROM nf WHERE feed = '10-K' GROUP BY ticker")(lambda spark, d: filings.recent_filings(filings.submissions(feed(spark, d)), "10-K", None, 1, F.current_date()).select("ticker", "accession"))
query("src28_missing_manifests", "SELECT CAST(id AS VARCHAR) AS accession, CASE WHEN id % 4 = 0 THEN 'manifest' END AS manifest FROM requests")(lambda spark, d: filed(spark, d).select("accession").join(filed(spark, d).where("accession % 4 = 0").select("accession", F.lit("manifest").alias("manifest")), "accession", "left"))
query("src29_indexed", "SELECT CAST(id AS VARCHAR) AS accession FROM requests WHERE id % 4 = 0")(lambda spark, d: filed(spark, d).select("accession").join(filed(spark, d).where("accession % 4 = 0").select("accession"), "accession", "left_semi"))
query("src28_fetched_manifests", "SELECT CAST(id AS VARCHAR) AS accession, CASE WHEN id % 4 = 0 THEN 'manifest ' || id END AS manifest FROM requests")(lambda spark, d: filed(spark, d).select("accession", records.fetched(F.when(F.col("accession") % 4 == 0, 200).otherwise(404), F.concat(F.lit("manifest "), "accession")).alias("manifest")))
query("src29_decoded_records", "SELECT CAST(id AS VARCHAR) AS accession, CASE WHEN id % 5 < 3 THEN CASE WHEN id % 5 = 1 THEN 3 ELSE id % 7 END END AS priority, CASE WHEN id % 5 < 3 THEN CASE WHEN id % 5 = 2 THEN 'pending' ELSE 's' || id END END AS state FROM requests")(
    lambda spark, d: filed(spark, d)
    .select("accession", F.col("accession").cast("long").alias("n"))
    .select("accession", F.when(F.col("n") % 5 == 0, F.format_string('{"priority": %d, "state": "s%d", "more": 1}', F.col("n") % 7, "n")).when(F.col("n") % 5 == 1, F.format_string('{"priority": "soon", "state": "s%d"}', "n")).when(F.col("n") % 5 == 2, F.format_string('{"state": null, "priority": %d}', F.col("n") % 7)).when(F.col("n") % 5 == 3, "[1]").otherwise('{"broken').alias("json"))
    .select("accession", records.decoded(F.col("json"), {"priority": ("bigint", 3), "state": ("string", "pending")}).alias("r"))
    .select("accession", "r.priority", "r.state")
)
query("mrg04_filing_status", "SELECT ticker, form, CAST(max(id) AS BIGINT) AS id FROM requests GROUP BY 1, 2")(lambda spark, d: (lambda r: merge.newer_wins(r.where("id % 2 = 0").groupBy("ticker", "form").agg(F.max("id").alias("id")), r.groupBy("ticker", "form").agg(F.max("id").alias("id")), ["ticker", "form"]))(asked(spark, d)))
query("mrg05_targets", f"WITH {FILED_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY ticker, form ORDER BY filed DESC, accession DESC) AS k FROM fi) SELECT ticker, accession FROM n WHERE k <= CASE form WHEN '10-K' THEN 2 WHEN '10-q/A' THEN 3 WHEN ' DEF 14A ' THEN 1 ELSE 0 END OR filed >= DATE '2024-01-30' - 2")(lambda spark, d: merge.top_per_form(filed(spark, d), {"10-K": 2, "10-q/A": 3, " DEF 14A ": 1}, 2, F.to_date(F.lit("2024-01-30"))).select("ticker", "accession"))

# --- pages and sections


BODY_SQL = "bd AS (SELECT node, label, CASE node % 6 WHEN 0 THEN 'See the Annual Report to Shareholders.' WHEN 1 THEN 'Refer to our Proxy Statement' WHEN 2 THEN 'and' WHEN 3 THEN 'see pages 5 to 8' ELSE text END AS body FROM nodes), tg AS (SELECT *, CASE WHEN node % 6 = 0 THEN 'annual_report_same_doc' WHEN node % 6 = 1 THEN 'def14a' WHEN node % 6 = 2 THEN 'parser_bug' WHEN node % 6 = 3 THEN 'unknown' WHEN length(body) >= 500 THEN NULL WHEN NOT regexp_matches(body, '(?i)\\brefer\\b|\\bsee\\b|\\bincorporat(?:ed|ing)\\b|\\bset\\s+forth\\b|\\binformation\\s+required\\b|\\bpages?\\s+\\d') THEN 'parser_bug' WHEN regexp_matches(body, '(?i)annual\\s+report\\s+to\\s+(?:stockholders|shareholders)|exhibit\\s+13\\b') THEN 'annual_report_same_doc' WHEN regexp_matches(body, '(?i)proxy\\s+statement|schedule\\s+14a|def\\s*14a') THEN 'def14a' ELSE 'unknown' END AS target FROM bd)"


def bodies(spark, d):
    n = view(spark, d, "nodes")
    cases = ["See the Annual Report to Shareholders.", "Refer to our Proxy Statement", "and", "see pages 5 to 8"]
    body = F.col("text")
    for i, c in enumerate(cases):
        body = F.when(F.col("node") % 6 == i, c).otherwise(body)
    n = n.withColumn("body", body)
    return n.withColumn("target", filings.pointer_target(F.col("body")))


query("sec05_pointers", f"WITH {BODY_SQL} SELECT node, target FROM tg")(lambda spark, d: bodies(spark, d).select("node", "target"))
query("flt10_recoverable", f"WITH {BODY_SQL} SELECT node FROM tg WHERE label IN ('mdna', 'financial_statements') AND target IN ('annual_report_same_doc', 'unknown')")(lambda spark, d: bodies(spark, d).where(filings.recoverable(F.col("label"), F.col("target"))).select("node"))


def manifests(spark, d):
    n = view(spark, d, "nodes")
    r = lambda i, cat: F.format_string(f"<Report><ShortName>S{i} %d</ShortName><LongName>L</LongName><HtmlFileName>R{i}.htm</HtmlFileName><MenuCategory>{cat}</MenuCategory><Position>{i}</Position></Report>", "node")
    return n.select("accession", F.concat(F.lit("<FilingSummary><MyReports>"), r(1, "Cover"), r(2, "Statements"), r(3, "Statements"), F.lit("</MyReports></FilingSummary>")).alias("xml"))


query("str13_manifest", "SELECT accession, i AS pos, 'S' || CAST(i AS VARCHAR) || ' ' || accession AS name, 'R' || CAST(i AS VARCHAR) || '.htm' AS file FROM nodes, (VALUES (1), (2), (3)) v(i)")(lambda spark, d: manifests(spark, d).select("accession", F.explode(filings.manifest_reports(F.col("xml"))).alias("r")).select("accession", F.col("r.Position").cast("int").alias("pos"), F.col("r.ShortName").alias("name"), F.col("r.HtmlFileName").alias("file")))
query("flt13_statements", "SELECT accession, 2 AS n FROM nodes")(lambda spark, d: manifests(spark, d).select("accession", F.size(filings.statements(filings.manifest_reports(F.col("xml")))).alias("n")))


def recovered(spark, d):
    m = manifests(spark, d).select("accession", F.explode(filings.manifest_reports(F.col("xml"))).alias("r"))
    reps = m.select("accession", F.col("r.Position").cast("int").alias("pos"), F.col("r.ShortName").alias("name"), F.col("r.HtmlFileName").alias("file"), F.col("r.MenuCategory").alias("category"))
    pages = reps.where("accession % 5 > 0").select("accession", "file", F.concat(F.lit("table "), "file").alias("text"))
    return filings.recover(bodies(spark, d).select("accession", "label", F.col("body").alias("text"), "target"), reps, pages)


query("sec06_recovery", f"WITH {BODY_SQL} SELECT CAST(node AS VARCHAR) AS accession, target, CASE WHEN label IN ('mdna', 'financial_statements') AND target IN ('annual_report_same_doc', 'unknown') AND node % 5 > 0 THEN '# S2 ' || node || chr(10) || chr(10) || 'table R2.htm' || chr(10) || chr(10) || '# S3 ' || node || chr(10) || chr(10) || 'table R3.htm' ELSE body END AS text, CASE WHEN label IN ('mdna', 'financial_statements') AND target IN ('annual_report_same_doc', 'unknown') AND node % 5 > 0 THEN 'filing_summary_r_files' END AS recovered_via FROM tg")(lambda spark, d: recovered(spark, d).select("accession", "target", "text", "recovered_via"))
#: Paragraphs, those over 200 tokens cut at sentences; runs of the others, and the sentences of each long one, are filled greedily up to 200 tokens.
CHUNK_SQL = r"""WITH RECURSIVE pa AS (SELECT node, row_number() OVER (PARTITION BY node ORDER BY k) AS k, trim(p, ' ' || chr(9) || chr(10) || chr(13)) AS p FROM (SELECT node, unnest(string_split(text, chr(10) || chr(10))) AS p, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) AS k FROM nodes) WHERE trim(p, ' ' || chr(9) || chr(10) || chr(13)) <> ''),
lg AS (SELECT *, length(p) // 4 > 200 AS long FROM pa),
gr AS (SELECT *, 2 * sum(CASE WHEN long THEN 1 ELSE 0 END) OVER (PARTITION BY node ORDER BY k) - CASE WHEN long THEN 1 ELSE 0 END AS grp FROM lg),
un AS (SELECT node, grp, long, k, unnest(CASE WHEN long THEN string_split(regexp_replace(p, '([.!?])\s+([A-Z])', '\1' || chr(57344) || '\2', 'g'), chr(57344)) ELSE [p] END) AS u, CASE WHEN long THEN generate_subscripts(string_split(regexp_replace(p, '([.!?])\s+([A-Z])', '\1' || chr(57344) || '\2', 'g'), chr(57344)), 1) ELSE generate_subscripts([p], 1) END AS j FROM gr),
od AS (SELECT node, grp, long, u, length(u) // 4 AS size, row_number() OVER (PARTITION BY node, grp ORDER BY k, j) AS idx FROM un),
f AS (SELECT node, grp, idx, 1 AS c, size AS used FROM od WHERE idx = 1 UNION ALL SELECT od.node, od.grp, od.idx, CASE WHEN used + size > 200 THEN c + 1 ELSE c END, CASE WHEN used + size > 200 THEN size ELSE used + size END FROM f JOIN od ON od.node = f.node AND od.grp = f.grp AND od.idx = f.idx + 1),
ch AS (SELECT f.node, f.grp, c, CASE WHEN any_value(long) THEN string_agg(u, ' ' ORDER BY f.idx) ELSE string_agg(u, chr(10) || chr(10) ORDER BY f.idx) END AS chunk FROM f JOIN od ON od.node = f.node AND od.grp = f.grp AND od.idx = f.idx GROUP BY f.node, f.grp, c)
SELECT node, CAST(row_number() OVER (PARTITION BY node ORDER BY grp, c) - 1 AS INT) AS pos, chunk FROM ch"""
query("sec07_chunks", CHUNK_SQL)(lambda spark, d: sections.chunks(view(spark, d, "nodes").select(F.col("node").alias("id"), "text"), 200).withColumnRenamed("id", "node"))
query("sec08_raw_trees", "SELECT ticker, count(*) AS sections, false AS full FROM nodes GROUP BY ticker")(lambda spark, d: filings.raw_tree(view(spark, d, "nodes").groupBy("ticker").agg(F.collect_list(F.struct("label", "title", "text")).alias("sections"))).select("ticker", F.size("sections").cast("bigint").alias("sections"), "full"))

query("sec08_raw_tree_contents", "SELECT ticker, CAST(row_number() OVER (PARTITION BY ticker ORDER BY node) - 1 AS INT) AS pos, label, title, sha256(text) AS text_sha256, '' AS summary, false AS full FROM nodes")(
    lambda spark, d: filings.raw_tree(view(spark, d, "nodes").groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct("node", "label", "title", "text"))).alias("sections"))).select("ticker", "full", F.posexplode("sections").alias("pos", "s")).select("ticker", "pos", "s.label", "s.title", F.sha2("s.text", 256).alias("text_sha256"), "s.summary", "full")
)


def full_trees(spark, d):
    n = view(spark, d, "nodes").withColumn("accession", F.floor(F.col("node") / 4).cast("string")).withColumn("pos", F.col("node") % 4)
    return filings.full_tree(n.select("accession", "pos", "label", "title", "text"), n.where("node % 3 > 0").select("accession", "label", F.concat(F.lit("about "), "label").alias("made")))


query("sec09_full_trees", "SELECT CAST(node // 4 AS VARCHAR) AS accession, list(CASE WHEN node % 3 > 0 THEN 'about ' || label ELSE '' END ORDER BY node) AS summaries FROM nodes GROUP BY 1")(lambda spark, d: full_trees(spark, d).select("accession", F.transform("sections", lambda s: s["summary"]).alias("summaries")))
query("agg19_summary_health", "SELECT count(*) AS n_full, count(*) FILTER (WHERE k = 0) AS n_empty, count(*) FILTER (WHERE k = 0) >= 0.1 * count(*) AS degraded FROM (SELECT node // 4 AS a, count(*) FILTER (WHERE node % 3 > 0) AS k FROM nodes GROUP BY 1)")(lambda spark, d: filings.summary_health(full_trees(spark, d).select("full", F.transform("sections", lambda s: s["summary"]).alias("summaries"))))
query("win13_header_spans", "SELECT node, node % 10 * 100 AS start, coalesce(lead(node % 10 * 100) OVER (PARTITION BY node // 10 ORDER BY node), 5000) AS \"end\" FROM nodes")(lambda spark, d: filings.header_spans(view(spark, d, "nodes").select(F.floor(F.col("node") / 10).alias("id"), "node", (F.col("node") % 10 * 100).alias("start"), F.lit(5000).cast("bigint").alias("limit"))).select("node", "start", "end"))
query("str06_slugs", "SELECT node, trim(regexp_replace(lower(summary), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM nodes")(lambda spark, d: view(spark, d, "nodes").select("node", scalar.slug(F.col("summary")).alias("slug")))
query("str11_headed_text", "SELECT node, '# Document' || chr(10) || chr(10) || summary AS text FROM nodes WHERE NOT regexp_matches(summary, '(?m)^#{1,6}\\s')")(lambda spark, d: view(spark, d, "nodes").where(~F.rlike("summary", F.lit(r"(?m)^#{1,6}\s"))).select("node", scalar.headed_text(F.col("summary")).alias("text")))
query("str12_content_types", "SELECT id, CASE id % 6 WHEN 0 THEN 'html' WHEN 1 THEN 'xml' WHEN 3 THEN 'html' ELSE 'text' END AS kind FROM requests")(lambda spark, d: asked(spark, d).select("id", scalar.content_type(F.concat("ticker", F.lit("."), "form", F.element_at(F.array(*map(F.lit, (".htm", ".XML", ".txt", ".HTML", ".xml.bak", ""))), (F.col("id") % 6 + 1).cast("int")))).alias("kind")))
query("str14_inline_metadata", "SELECT node, regexp_replace(CASE WHEN node % 4 = 3 THEN summary || ' X - Definition ' || label ELSE summary END, '^\\s+|\\s+$', '', 'g') AS text FROM nodes")(lambda spark, d: view(spark, d, "nodes").select("node", scalar.without_inline_metadata(F.concat("summary", F.when(F.col("node") % 4 == 0, F.concat(F.lit("\nX - Definition\nus-gaap "), "label")).when(F.col("node") % 4 == 1, F.concat(F.lit("\n\nX - References "), "accession", F.lit("\nX - Details"))).when(F.col("node") % 4 == 3, F.concat(F.lit(" X - Definition "), "label")).otherwise("  \n"))).alias("text")))


def ownership(spark, d):
    f = tables.spread(view(spark, d, "fills"), "id")
    role = F.when(F.col("id") % 3 == 0, "<isDirector>true</isDirector>").when(F.col("id") % 3 == 1, F.format_string("<isDirector>1</isDirector><isOfficer>1</isOfficer><officerTitle>Chief %s</officerTitle>", "account_number")).otherwise("")
    return f.select("id", F.format_string('<ownershipDocument xmlns="x"><documentType>4</documentType><issuer><issuerName>N%s</issuerName></issuer><reportingOwner><rptOwnerName>Owner %d</rptOwnerName>%s</reportingOwner><nonDerivativeTransaction><transactionShares><value>%d</value></transactionShares></nonDerivativeTransaction></ownershipDocument>', "symbol", "id", role, "quantity").alias("xml"))


query("str09_ownership_reports", "SELECT id, '# Form 4 — Insider Transaction Report' || chr(10) || chr(10) || '## Issuer' || chr(10) || '- Name: N' || symbol || chr(10) || chr(10) || '## Reporting owner(s)' || chr(10) || '- Owner ' || id || CASE id % 3 WHEN 0 THEN ' — Director' WHEN 1 THEN ' — Director, Officer (Chief ' || account_number || ')' ELSE '' END || chr(10) || chr(10) || '## Non-derivative transactions' || chr(10) || chr(10) || '| Date | Code | Shares | Acquired/Disposed | Price | Post-tx holdings | Security |' || chr(10) || '| --- | --- | --- | --- | --- | --- | --- |' || chr(10) || '| — | — | ' || quantity || ' | — | — | — | — |' || chr(10) AS report FROM fills")(lambda spark, d: ownership(spark, d).select("id", xml_report("xml").alias("report")))
query("str10_xml_values", "SELECT id, 'N' || symbol AS issuer, CAST(quantity AS VARCHAR) AS shares, id % 3 < 2 AS director FROM fills")(lambda spark, d: ownership(spark, d).select("id", F.xpath_string(F.replace("xml", F.lit(' xmlns="x"'), F.lit("")), F.lit("//issuer/issuerName")).alias("issuer"), F.xpath_string(F.replace("xml", F.lit(' xmlns="x"'), F.lit("")), F.lit("//transactionShares/value")).alias("shares"), F.lower(F.xpath_string(F.replace("xml", F.lit(' xmlns="x"'), F.lit("")), F.lit("//isDirector"))).isin("1", "true", "yes").alias("director")))

# --- theses
OVERALL_SQL = "ov AS (SELECT thesis, coalesce(sum(score * weight)::DOUBLE / nullif(sum(weight), 0), 0) AS m, arg_min(name, struct_pack(s := score, p := pos)) AS weakest FROM components GROUP BY thesis), ovr AS (SELECT *, CAST(CASE WHEN m - floor(m) = 0.5 THEN CASE WHEN floor(m) % 2 = 0 THEN floor(m) ELSE floor(m) + 1 END ELSE floor(m + 0.5) END AS INT) AS overall FROM ov)"
RISK_SQL = "rs AS (SELECT *, CASE WHEN bucket = 'value' THEN CASE lower(color) WHEN 'green' THEN 80 WHEN 'blue' THEN 80 WHEN 'orange' THEN 60 WHEN 'red' THEN 40 ELSE 30 END WHEN bucket = 'systematic' THEN CASE lower(color) WHEN 'green' THEN 70 WHEN 'blue' THEN 70 WHEN 'orange' THEN 60 WHEN 'red' THEN 50 ELSE 40 END WHEN bucket = 'short' THEN CASE lower(color) WHEN 'green' THEN 40 WHEN 'blue' THEN 40 WHEN 'orange' THEN 65 ELSE 85 END WHEN bucket = 'yolo' THEN CASE lower(color) WHEN 'green' THEN 70 WHEN 'blue' THEN 70 WHEN 'orange' THEN 50 WHEN 'red' THEN 35 ELSE 30 END ELSE 55 END AS risk FROM theses)"
ACTION_SQL = f"{OVERALL_SQL}, th AS (SELECT t.*, coalesce(overall, 0) AS overall, weakest, ovr.thesis IS NOT NULL AS has FROM theses t LEFT JOIN ovr ON t.thesis = ovr.thesis), ac AS (SELECT *, ['EXIT', 'REDUCE', 'HOLD', 'ADD'][1 + greatest(0, least(3, CASE WHEN overall < 40 THEN 0 WHEN overall < 55 THEN 1 WHEN overall < 75 THEN 2 ELSE 3 END + CASE WHEN bucket = 'short' AND lower(color) IN ('danger', 'red') THEN 1 WHEN lower(color) = 'danger' OR (lower(color) = 'red' AND bucket = 'yolo') THEN -1 ELSE 0 END))] AS action FROM th)"


def written(spark, d):
    return view(spark, d, "theses")


def parts(spark, d):
    return view(spark, d, "components")


query("jn12_risk_matrix", f"WITH {RISK_SQL} SELECT thesis, risk FROM rs")(lambda spark, d: written(spark, d).select("thesis", theses.risk_score(F.col("bucket"), F.col("color")).alias("risk")))
query("agg04_overall", f"WITH {OVERALL_SQL} SELECT thesis, overall FROM ovr")(lambda spark, d: theses.overall(parts(spark, d)).select("thesis", "overall"))
query("agg08_weakest", f"WITH {OVERALL_SQL} SELECT thesis, weakest FROM ovr")(lambda spark, d: theses.overall(parts(spark, d)).select("thesis", "weakest"))
query("agg05_evaluation", f"WITH {ACTION_SQL} SELECT thesis, overall, CASE WHEN number % 9 = 0 THEN 'EXIT' ELSE action END AS action, CASE WHEN number % 9 = 0 THEN ['a', 'b'] ELSE [] END AS kill_reasons FROM ac")(
    lambda spark, d: (lambda t: theses.evaluate(t, parts(spark, d), t.where("number % 9 = 0").select("thesis", F.explode(F.array(F.lit("b"), F.lit("a"))).alias("description"), F.lit("triggered").alias("status")).union(t.select("thesis", F.lit("c"), F.lit("active")))))(written(spark, d)).select("thesis", "overall", "action", "kill_reasons")
)
query("agg06_band_scores", "SELECT thesis, CASE WHEN balance / 100 > 40 THEN 90 WHEN balance / 100 > 25 THEN 75 WHEN balance / 100 > 10 THEN 60 WHEN balance / 100 > 0 THEN 45 WHEN balance / 100 > -20 THEN 30 ELSE 15 END AS safety, CASE WHEN number % 11 = 0 THEN 50 WHEN number - 50 < 0 THEN 35 WHEN number - 50 <= 30 THEN 85 WHEN number - 50 <= 90 THEN 75 WHEN number - 50 <= 180 THEN 60 ELSE 55 END AS catalyst FROM theses")(lambda spark, d: written(spark, d).select("thesis", theses.safety_score(F.col("balance") / 100).alias("safety"), theses.catalyst_score(F.when(F.col("number") % 11 > 0, F.col("number") - 50)).alias("catalyst")))


def refreshed(spark, d):
    names = F.element_at(F.array(*map(F.lit, ("Risk Environment", "Valuation Safety", "Catalyst Proximity", "Business Health", "Thesis Integrity", "Insider Alignment", "Other"))), (F.col("pos") % 7 + 1).cast("int"))
    t = written(spark, d).select("thesis", "bucket", "color", F.col("balance").alias("fair_value"), F.lit(5000.0).alias("price"), F.when(F.col("number") % 2 == 0, F.col("number") - 50).alias("days_to_catalyst"))
    return theses.refreshed(parts(spark, d).withColumn("name", names), t)


query("agg07_refreshed", f"WITH {RISK_SQL} SELECT c.thesis, c.pos, CASE c.pos % 7 WHEN 0 THEN risk WHEN 1 THEN CASE WHEN (balance - 5000.0) / 5000.0 * 100 > 40 THEN 90 WHEN (balance - 5000.0) / 5000.0 * 100 > 25 THEN 75 WHEN (balance - 5000.0) / 5000.0 * 100 > 10 THEN 60 WHEN (balance - 5000.0) / 5000.0 * 100 > 0 THEN 45 WHEN (balance - 5000.0) / 5000.0 * 100 > -20 THEN 30 ELSE 15 END WHEN 2 THEN CASE WHEN number % 2 = 1 THEN score WHEN number - 50 < 0 THEN 35 WHEN number - 50 <= 30 THEN 85 WHEN number - 50 <= 90 THEN 75 WHEN number - 50 <= 180 THEN 60 ELSE 55 END ELSE score END AS score FROM components c JOIN rs ON rs.thesis = c.thesis")(lambda spark, d: refreshed(spark, d).select("thesis", "pos", "score"))
query("agg28_monitoring", f"WITH {ACTION_SQL} SELECT thesis, overall, action, CASE WHEN has THEN 'scored' ELSE 'unscored' END AS outcome FROM ac WHERE status = 'active'")(lambda spark, d: theses.monitored(written(spark, d).withColumn("score_before", F.col("number") % 100), parts(spark, d)).select("thesis", "overall", "action", "outcome"))
query("agg23_by_status", "SELECT status, count(*) AS n, array_to_string(list(thesis ORDER BY thesis), ', ') AS members FROM theses GROUP BY status")(lambda spark, d: written(spark, d).groupBy("status").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("thesis")), ", ").alias("members")))
query("flt12_active", "SELECT thesis FROM theses WHERE status = 'active'")(lambda spark, d: theses.of_status(written(spark, d), "active").select("thesis"))
MOVES_SQL = "mv AS (SELECT thesis, CASE WHEN balance > 0 THEN (balance - number) / nullif(CAST(number AS DOUBLE), 0) * 100 END AS move_pct FROM theses)"


def moved(spark, d):
    return theses.moves(written(spark, d).select("thesis", F.col("balance").alias("price"), F.col("number").cast("double").alias("before")), 5000.0)


query("flt11_big_movers", f"WITH {MOVES_SQL} SELECT thesis, move_pct FROM mv WHERE abs(move_pct) >= 5000")(lambda spark, d: moved(spark, d).where("big").select("thesis", "move_pct"))
query("mth07_moves", f"WITH {MOVES_SQL} SELECT thesis, move_pct, CASE WHEN move_pct IS NULL THEN 'no price' WHEN move_pct >= 5000 THEN 'up' WHEN move_pct <= -5000 THEN 'down' ELSE 'flat' END AS note FROM mv")(lambda spark, d: moved(spark, d).select("thesis", "move_pct", "note"))
query("dat01_quarters", "SELECT ticker, date, CAST(quarter(date) AS INT) AS quarter FROM bars")(lambda spark, d: view(spark, d, "bars").select("ticker", "date", scalar.quarter_of(F.col("date")).alias("quarter")))
query("dat02_file_dates", "SELECT date, CAST(DATE '1998-01-15' - date AS INT) AS age, (DATE '1998-01-15' - date) > 14 AS stale FROM bars WHERE ticker = 'EQ'")(lambda spark, d: view(spark, d, "bars").where("ticker = 'EQ'").select(scalar.name_date(F.concat(F.lit("watch-"), F.col("date").cast("string"), F.lit(".md"))).alias("date")).select("date", F.datediff(F.to_date(F.lit("1998-01-15")), "date").alias("age"), scalar.stale(F.col("date"), F.to_date(F.lit("1998-01-15"))).alias("stale")))
query("mth06_numbers", "SELECT thesis, CASE WHEN number % 4 < 2 THEN balance END AS x, CASE WHEN balance > 1 THEN balance / 100 ELSE balance END AS share FROM theses")(lambda spark, d: written(spark, d).select("thesis", scalar.number(F.when(F.col("number") % 4 < 2, F.col("balance").cast("string")).when(F.col("number") % 4 == 2, "NaN").otherwise("n/a")).alias("x"), scalar.yield_fraction(F.col("balance")).alias("share")))
query("str21_formats", "SELECT thesis, CASE WHEN number + 1 >= 1000000 THEN format('${:.1f}T', ((number + 50001) // 100000) / 10.0) WHEN number + 1 >= 1000 THEN format('${:.1f}B', ((number + 51) // 100) / 10.0) ELSE format('${:.1f}M', number + 1.0) END AS short, format('{:+.1f}%', number + 0.3) AS pct FROM theses")(lambda spark, d: written(spark, d).select("thesis", scalar.short_money((F.col("number") + 1) * 1e6).alias("short"), scalar.percent(F.col("number") + 0.3).alias("pct")))
query("str20_watchlists", "SELECT CAST(number AS INT) AS rank, thesis AS ticker, bucket AS sector, CAST(number AS DOUBLE) AS score, number * 1e6 AS price FROM theses")(
    lambda spark, d: theses.watchlist(written(spark, d).select(F.lit("w.md").alias("name"), F.concat(F.lit("| Rank | Ticker | Sector | Score |\n| --- | --- | --- | --- |\n| "), F.concat_ws(" | ", F.col("number").cast("string"), "thesis", "bucket", F.concat(F.lit("**"), F.col("number").cast("string"), F.lit("**")), *[F.lit("x")] * 9, F.concat(F.lit("$"), F.col("number").cast("string"), F.lit("M"))), F.lit(" |")).alias("content"))).drop("name")
)


def files(spark, d):
    t = tables.spread(written(spark, d), "thesis")
    yaml = F.format_string("# Thesis\n\n```yaml\nticker: t%s\ncompany: C%s\nbucket: %s\nstatus: %s\nopened: 2024-01-05\ncost_basis: %s\nshares: %d  # held\nhealth_components:\n  - {name: Risk, weight: 40, score: %d}\n```\n\n## Kill Conditions\n\n| # | Kill condition | Monitor | Last checked |\n| --- | --- | --- | --- |\n| 1 | falls | daily | 2024-01-01 |\n| 2 | [placeholder] | x | y |\n", "thesis", "thesis", "bucket", "status", F.col("balance").cast("string"), "number", F.col("number") % 100)
    return t.select(F.concat("thesis", F.lit(".md")).alias("name"), yaml.alias("content"), "number")


query("str16_thesis_metadata", "SELECT thesis || '.md' AS name, 'T' || thesis AS ticker, bucket, status, DATE '2024-01-05' AS opened, CAST(number AS INT) AS shares FROM theses")(lambda spark, d: theses.parsed(files(spark, d)).select("name", "ticker", "bucket", "status", "opened", "shares"))
query("str15_metadata_json", "SELECT thesis || '.md' AS name, thesis AS company FROM theses")(lambda spark, d: theses.parsed(files(spark, d)).select("name", F.substring(F.get_json_object("json", "$.company"), 2, 99).alias("company")))
query("src20_latest_watchlist", "SELECT 'watch-' || CAST(max(date) AS VARCHAR) || '.md' AS name FROM bars")(lambda spark, d: theses.latest_document(view(spark, d, "bars").select(F.concat(F.lit("watch-"), F.col("date").cast("string"), F.lit(".md")).alias("name")).distinct()).select("name"))
query("jsn03_loose_scores", "SELECT thesis, CAST(least(100, number) AS INT) AS business FROM theses")(lambda spark, d: written(spark, d).select("thesis", F.get_json_object(theses.loose_scores(F.format_string('Sure:\n```json\n{"business_health": {"score": %d}}\n```', "number")), "$.business_health").cast("int").alias("business")))

# --- the queue
query("top04_pending", f"WITH {FORMS_SQL} SELECT CAST(id AS VARCHAR) AS id, row_number() OVER (ORDER BY {PRIORITY_SQL}, requested_at, CAST(id AS VARCHAR)) AS place FROM nf")(lambda spark, d: queue.pending(asked(spark, d).select(F.col("id").cast("string").alias("id"), "ticker", "form", "requested_at", F.lit(None).cast("int").alias("priority"), F.lit(False).alias("force"))).select("id", "place"))


def worked(spark, d):
    r = asked(spark, d).select(F.col("id").cast("string").alias("id"), "ticker", "form", "requested_at", F.lit(None).cast("int").alias("priority"), F.lit(False).alias("force"))
    index = r.where("ticker < '15'").select("ticker", "form").distinct().withColumn("commit", F.when(F.col("form") == "10-K", "old").otherwise("new"))
    return queue.outcome(queue.sound(r), index.where("form <> 'S-8'"), "new")


query("stm03_outcomes", f"WITH {FORMS_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY ticker, status ORDER BY {PRIORITY_SQL}, requested_at, CAST(id AS VARCHAR)) AS k FROM nf) SELECT CAST(id AS VARCHAR) AS id, CASE WHEN ticker < '15' AND form NOT IN ('S-8', '10-K') THEN 'skipped' WHEN k > 1 THEN 'skipped' ELSE 'indexed' END AS state FROM k")(lambda spark, d: worked(spark, d).select("id", "state"))
query("stm04_status", "SELECT ticker, CAST(max(id) AS VARCHAR) AS accession FROM requests GROUP BY ticker")(lambda spark, d: (lambda r: queue.upsert_status(r.where("id % 2 = 0").groupBy("ticker").agg(F.lit("x").alias("key"), F.max("id").alias("id")).select("ticker", F.col("key").alias("accession"), "id"), r.groupBy("ticker").agg(F.max("id").alias("id")).select("ticker", F.lit("x").alias("accession"), "id", F.lit(1).alias("place"))).select("ticker", F.col("id").cast("string").alias("accession")))(asked(spark, d)))
query("stm05_requeue", f"WITH {FORMS_SQL} SELECT 'again-' || ticker || '-' || CAST(id AS VARCHAR) AS id, {PRIORITY_SQL} AS priority FROM nf")(lambda spark, d: queue.requeue(filed(spark, d), "2024-02-01 00:00:00").select("id", "priority"))
query("stm07_report", f"WITH {FORMS_SQL} SELECT ticker, count(*) AS indexed, arg_max('s' || CAST(id AS VARCHAR), struct_pack(a := requested_at, b := CAST(id AS VARCHAR))) AS last_state FROM nf GROUP BY ticker")(lambda spark, d: queue.report(asked(spark, d).select("ticker", "form", "requested_at", F.col("id").cast("string").alias("accession"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("state"))).select("ticker", "indexed", "last_state"))

# --- trees
OUTLINE_SQL = "ol AS (SELECT node // 20 AS doc, node % 20 AS node, 1 + (node * 7) % 4 AS level, summary AS text FROM nodes)"


def outline(spark, d):
    return view(spark, d, "nodes").select(F.floor(F.col("node") / 20).alias("doc"), (F.col("node") % 20).alias("node"), (1 + F.col("node") * 7 % 4).alias("level"), F.col("summary").alias("text"))


def pages(spark, d):
    return view(spark, d, "nodes").select(F.floor(F.col("node") / 20).alias("doc"), (F.col("node") % 20).alias("page"), F.floor(F.length("text") / 4).alias("tokens"))


query("pix01_markdown_nodes", "SELECT node AS doc, i AS node, CASE i WHEN 1 THEN 1 ELSE CAST(1 + node % 5 AS INT) END AS level, CASE i WHEN 1 THEN 'One ' || label ELSE 'Two ' || accession END AS title, CASE i WHEN 1 THEN '# One ' || label || chr(10) || 'text' || CASE WHEN node % 3 > 0 THEN chr(10) || '```' || chr(10) || '# no heading ' || accession || chr(10) || '```' ELSE '' END ELSE repeat('#', CAST(1 + node % 5 AS INT)) || ' Two ' || accession || chr(10) || ticker END AS text FROM nodes, (VALUES (1), (2)) v(i)")(
    lambda spark, d: trees.markdown_nodes(view(spark, d, "nodes").select(F.col("node").alias("doc"), F.concat(F.lit("intro\n# One "), "label", F.lit("\ntext"), F.when(F.col("node") % 3 > 0, F.concat(F.lit("\n```\n# no heading "), "accession", F.lit("\n```"))).otherwise(""), F.lit("\n"), F.repeat(F.lit("#"), (1 + F.col("node") % 5).cast("int")), F.lit(" Two "), "accession", F.lit("\n"), "ticker").alias("content")))
)
query("pix02_subtree_tokens", f"WITH {OUTLINE_SQL}, e AS (SELECT a.doc, a.node, (SELECT min(b.node) FROM ol b WHERE b.doc = a.doc AND b.node > a.node AND b.level <= a.level) AS stop FROM ol a) SELECT e.doc, e.node, sum(length(c.text) // 4)::BIGINT AS tokens FROM e JOIN ol c ON c.doc = e.doc AND c.node >= e.node AND (stop IS NULL OR c.node < stop) GROUP BY 1, 2")(lambda spark, d: trees.subtree_tokens(outline(spark, d)).select("doc", "node", "tokens"))
query("pix03_parents", f"WITH {OUTLINE_SQL} SELECT a.doc, a.node, lpad(CAST(a.node AS VARCHAR), 4, '0') AS id, (SELECT max(b.node) FROM ol b WHERE b.doc = a.doc AND b.node < a.node AND b.level < a.level) AS parent FROM ol a")(lambda spark, d: trees.parents_by_level(outline(spark, d)).select("doc", "node", "id", "parent"))
query("pix04_codes", "SELECT doc, code, CASE WHEN code LIKE '%.%' THEN split_part(code, '.', 1) END AS parent FROM (SELECT node // 20 AS doc, CASE WHEN node % 5 = 0 THEN CAST(node % 20 // 5 AS VARCHAR) ELSE CAST(node % 20 // 5 AS VARCHAR) || '.' || CAST(node % 5 AS VARCHAR) END AS code FROM nodes)")(lambda spark, d: trees.parents_by_code(view(spark, d, "nodes").select(F.floor(F.col("node") / 20).alias("doc"), F.when(F.col("node") % 5 == 0, F.floor(F.col("node") % 20 / 5).cast("string")).otherwise(F.concat_ws(".", F.floor(F.col("node") % 20 / 5).cast("string"), (F.col("node") % 5).cast("string"))).alias("code"))))
query("pix06_valid_pages", "SELECT node, CASE WHEN node - 20 BETWEEN 1 AND 500 THEN node - 20 END AS start FROM nodes")(lambda spark, d: trees.valid_pages(view(spark, d, "nodes").select("node", F.col("node").alias("start")), F.lit(500), F.lit(-20)))
query("pix07_leaves", f"WITH {OUTLINE_SQL}, pr AS (SELECT a.doc, a.node, (SELECT max(b.node) FROM ol b WHERE b.doc = a.doc AND b.node < a.node AND b.level < a.level) AS parent FROM ol a) SELECT doc, node FROM pr p WHERE NOT EXISTS (SELECT 1 FROM pr q WHERE q.doc = p.doc AND q.parent = p.node)")(lambda spark, d: trees.leaves(trees.parents_by_level(outline(spark, d))).select("doc", "node"))
TITLES_SQL = "toc AS (SELECT node // 20 AS doc, node % 20 AS pos, label AS title, node % 20 + 3 AS page, node % 20 + 3 + CASE WHEN node % 7 = 0 THEN 9 ELSE 5 END AS physical FROM nodes), tp AS (SELECT a.doc, a.title, a.pos, a.page, b.physical FROM toc a JOIN toc b ON a.doc = b.doc AND a.title = b.title)"


def contents(spark, d):
    n = view(spark, d, "nodes").select(F.floor(F.col("node") / 20).alias("doc"), (F.col("node") % 20).alias("pos"), F.col("label").alias("title"), (F.col("node") % 20 + 3).alias("page"), F.col("node"))
    return n.select("doc", "pos", "title", "page"), n.select("doc", "title", (F.col("page") + F.when(F.col("node") % 7 == 0, 9).otherwise(5)).alias("physical"))


query("jn10_title_pairs", f"WITH {TITLES_SQL} SELECT doc, title, page, physical FROM tp WHERE physical >= 9")(lambda spark, d: trees.matching_titles(*contents(spark, d), 9).select("doc", "title", "page", "physical"))
query("agg25_page_offset", f"WITH {TITLES_SQL}, f AS (SELECT doc, physical - page AS o, count(*) AS n, min(pos) AS p FROM tp GROUP BY 1, 2) SELECT doc, arg_max(o, struct_pack(n := n, p := -p, o := -o)) AS \"offset\" FROM f GROUP BY doc")(lambda spark, d: trees.page_offset(trees.matching_titles(*contents(spark, d), 0)))
query("win14_page_spans", "SELECT doc, pos, CASE WHEN nx IS NULL THEN 999 WHEN nopen THEN greatest(start, nx - 1) ELSE nx END AS \"end\" FROM (SELECT node // 20 AS doc, node % 20 AS pos, node % 20 // 2 AS start, lead(node % 20 // 2) OVER w AS nx, lead(node % 3 = 0) OVER w AS nopen FROM nodes WINDOW w AS (PARTITION BY node // 20 ORDER BY node))")(lambda spark, d: trees.page_spans(view(spark, d, "nodes").select(F.floor(F.col("node") / 20).alias("doc"), (F.col("node") % 20).alias("pos"), F.floor(F.col("node") % 20 / 2).alias("start"), (F.col("node") % 3 == 0).alias("opens_page")), F.lit(999)).select("doc", "pos", "end"))

# --- letters
query("sec14_quarter_bodies", "SELECT lower(color) AS color, '## Q2' || chr(10) || chr(10) || '### Regime & Environment' || chr(10) || 'Regime: ' || upper(lower(color)) || chr(10) || chr(10) || '### Active Theses' || chr(10) || string_agg('- ' || thesis || ' (' || bucket || ')', chr(10) ORDER BY thesis) AS body FROM theses WHERE status = 'active' GROUP BY lower(color)")(lambda spark, d: letters.quarter_bodies(written(spark, d), 2))
query("sec18_scaffolds", "SELECT thesis, '# ' || thesis || chr(10) || chr(10) || '```yaml' || chr(10) || 'ticker: ' || thesis || chr(10) || 'bucket: ' || bucket || chr(10) || 'status: draft' || chr(10) || '```' || chr(10) || chr(10) || '## Kill Conditions' || chr(10) || chr(10) || '## Evidence' || CASE WHEN number % 2 = 0 THEN chr(10) || '1. a' || chr(10) || '2. b' ELSE '' END AS content FROM theses")(
    lambda spark, d: (lambda t: letters.scaffold(t, t.where("number % 2 = 0").select("thesis", F.explode(F.array(F.struct(F.lit(2).alias("place"), F.lit("b").alias("citation")), F.struct(F.lit(1).alias("place"), F.lit("a").alias("citation")))).alias("x")).select("thesis", "x.*")))(written(spark, d))
)
