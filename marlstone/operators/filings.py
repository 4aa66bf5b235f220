"""Filings: HTML to text, generic sections, pointers and their recovery, submission feeds and routing.

HTML is parsed once, in Arrow batches, by the functions of `documents`; all that follows is DataFrame work on typed rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import lookup
from . import documents

# Forms that are indexed in full, and those that never are.
FULL_FORMS = ["10-K", "10-Q", "S-1", "S-3", "S-4", "S-11", "20-F", "40-F", "DEF 14A", "DEFA14A", "DEF 14C", "6-K", "F-1", "F-3", "F-4", "N-CSR", "N-CSRS"]
RAW_FORMS = ["ARS"]
# Priority by form.
PRIORITY = {"10-K": 1, "10-Q": 1, "20-F": 1, "40-F": 1, "DEF 14A": 2, "DEFA14A": 2, "DEF 14C": 2, "8-K": 2, "3": 3, "4": 3, "5": 3}
CORE_FORMS = ["10-K", "20-F", "40-F"]


@F.pandas_udf(T.StringType())
def html_text(html: pd.Series) -> pd.Series:
    return html.map(documents.html_text)


@F.pandas_udf(T.StringType())
def html_markdown(html: pd.Series) -> pd.Series:
    return html.map(documents.html_markdown)


def form_of_feed(form: Column) -> Column:
    """As the feed is searched: no spaces, upper case, amendments kept."""
    return F.upper(F.regexp_replace(form, " ", ""))


def _base(form: Column, prefix: bool) -> Column:
    f = F.regexp_replace(F.trim(F.coalesce(form, F.lit(""))), r"/A$", "")
    return F.ltrim(F.regexp_replace(F.rtrim(f), r"(?i)^form ", "")) if prefix else F.rtrim(f)


def form_of_section(form: Column) -> Column:
    """As full indexing is decided: without '/A' and 'Form ', case kept."""
    return _base(form, True)


def form_of_queue(form: Column) -> Column:
    return _base(F.upper(form), True)


def form_of_status(form: Column) -> Column:
    return _base(F.upper(form), False)


def full_index(form: Column, tokens: Column, limit: int = 15_000) -> Column:
    f = form_of_section(form)
    return F.when(form.isNull(), True).when(f.isin(*RAW_FORMS), False).when(f.isin(*FULL_FORMS), True).otherwise(tokens > limit)


def priority(form: Column) -> Column:
    return lookup(form_of_queue(form), PRIORITY, F.lit(4))


def coverage(filings: DataFrame) -> DataFrame:
    """Per ticker: which annual report there is (10-K before 20-F before 40-F), quarterly, proxy, and what is missing."""
    f = filings.withColumn("base", form_of_status(F.col("form")))
    rank = lookup(F.col("base"), {form: i for i, form in enumerate(CORE_FORMS)})
    g = f.groupBy(F.upper("ticker").alias("ticker")).agg(F.min_by("base", rank).alias("core_form"), F.min(rank).alias("r"), F.bool_or(F.col("base") == "10-Q").alias("has_quarterly"), F.bool_or(F.col("base") == "DEF 14A").alias("has_proxy"), F.count("*").alias("indexed"))
    core = F.when(F.col("r").isNotNull(), F.col("core_form"))
    gaps = F.array_compact(F.array(F.when(core.isNull(), F.lit("annual report (10-K / 20-F)")), F.when(~F.col("has_quarterly"), F.lit("latest quarterly (10-Q)")), F.when(~F.col("has_proxy"), F.lit("proxy (DEF 14A)"))))
    return g.select("ticker", core.alias("core_form"), core.isNotNull().alias("ready"), "has_quarterly", "has_proxy", "indexed", gaps.alias("gaps"))


def pointer_target(body: Column) -> Column:
    """NULL for bodies of 500 characters or more, else what a short body points to."""
    language = r"(?i)\brefer\b|\bsee\b|\bincorporat(?:ed|ing)\b|\bset\s+forth\b|\binformation\s+required\b|\bpages?\s+\d"
    return (
        F.when(F.length(body) >= 500, None)
        .when(~F.rlike(body, F.lit(language)), "parser_bug")
        .when(F.rlike(body, F.lit(r"(?i)annual\s+report\s+to\s+(?:stockholders|shareholders)|exhibit\s+13\b")), "annual_report_same_doc")
        .when(F.rlike(body, F.lit(r"(?i)proxy\s+statement|schedule\s+14a|def\s*14a")), "def14a")
        .otherwise("unknown")
    )


def recoverable(label: Column, target: Column) -> Column:
    return F.coalesce(label.isin("mdna", "financial_statements") & target.isin("annual_report_same_doc", "unknown"), F.lit(False))


def manifest_reports(xml: Column) -> Column:
    """The reports of a filing's manifest."""
    return F.from_xml(xml, "MyReports struct<Report: array<struct<ShortName:string,LongName:string,HtmlFileName:string,MenuCategory:string,Position:string>>>")["MyReports"]["Report"]


def statements(reports: Column) -> Column:
    return F.filter(reports, lambda r: r["MenuCategory"] == "Statements")


def recover(secs: DataFrame, reports: DataFrame, pages: DataFrame) -> DataFrame:
    """Short pointer sections get the text of the filing's statements, each under its name, in the manifest's order.

    secs: accession, label, text, target; reports: accession, pos, name, file, category; pages: accession, file, text.
    """
    s = reports.where("category = 'Statements'").join(pages.where("text <> ''"), ["accession", "file"])
    piece = F.struct("pos", F.concat(F.lit("# "), "name", F.lit("\n\n"), "text").alias("body"))
    whole = s.groupBy("accession").agg(F.array_sort(F.collect_list(piece)).alias("p"))  # one filing's statements
    whole = whole.select("accession", F.array_join(F.transform("p", lambda p: p["body"]), "\n\n").alias("found"))
    j = secs.join(whole, "accession", "left").withColumn("swap", recoverable(F.col("label"), F.col("target")) & F.col("found").isNotNull())
    return j.withColumn("text", F.when(F.col("swap"), F.col("found")).otherwise(F.col("text"))).withColumn("recovered_via", F.when(F.col("swap"), "filing_summary_r_files")).drop("found", "swap")


def submissions(feed: DataFrame) -> DataFrame:
    """Filings of a feed of parallel arrays; a blank report date falls back to the filing date, bad dates drop out."""
    r = feed.select("ticker", F.lpad(F.col("cik").cast("string"), 10, "0").alias("cik"), F.posexplode(F.arrays_zip(*(F.col(f"recent.{c}") for c in ("form", "accessionNumber", "filingDate", "reportDate", "primaryDocument")))).alias("pos", "f"))
    filed = F.try_to_date("f.filingDate", "yyyy-MM-dd")
    return r.select("ticker", "cik", "pos", F.col("f.form").alias("form"), F.col("f.accessionNumber").alias("accession"), filed.alias("filed"), F.coalesce(F.try_to_date("f.reportDate", "yyyy-MM-dd"), filed).alias("period"), F.regexp_replace("f.primaryDocument", r"^xsl[^/]+/", "").alias("document")).where("filed IS NOT NULL")


def recent_filings(subs: DataFrame, form: str | None, since_days: int | None, limit: int, asof: Column) -> DataFrame:
    """Newest first, of each ticker at most limit; ties in the feed's order."""
    if form:
        subs = subs.where(form_of_feed(F.col("form")) == form.replace(" ", "").upper())
    if since_days is not None:
        subs = subs.where(F.datediff(asof, "filed") <= since_days)
    w = Window.partitionBy("ticker").orderBy(F.desc("filed"), "pos")
    return subs.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)


def first_of_form(subs: DataFrame, form: str) -> DataFrame:
    """The first of a form in the feed's order, unsorted."""
    s = subs.where(form_of_feed(F.col("form")) == form.replace(" ", "").upper())
    return s.groupBy("ticker").agg(F.min_by(F.struct("accession", "filed", "pos"), "pos").alias("f")).select("ticker", "f.*")


def stale_tree(current: Column, existing: Column) -> Column:
    return current.isNotNull() & ~existing.eqNullSafe(current)


def generic_sections(markdown: DataFrame) -> DataFrame:
    """id, pos, label, title, text, char_start, char_end: the document cut at its shallowest heading level; all of it if it has none."""
    lines = markdown.select("id", F.length("markdown").alias("size"), F.posexplode(F.split("markdown", "\n")).alias("line", "s"))
    mark = F.regexp_extract("s", r"^(#{1,6})\s+\S", 1)
    lines = lines.withColumn("level", F.nullif(F.length(mark), F.lit(0)))
    whole, w = Window.partitionBy("id"), Window.partitionBy("id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("top", F.min("level").over(whole)).withColumn("starts", F.coalesce(F.col("level") == F.col("top"), F.lit(False)))
    lines = lines.withColumns({"pos": F.sum(F.col("starts").cast("int")).over(w), "place": F.sum(F.length("s") + 1).over(w) - F.length("s") - 1}).where("top IS NULL OR pos > 0")
    g = lines.groupBy("id", "pos").agg(F.min("place").alias("place"), F.max("size").alias("size"), F.max(F.when(F.col("starts"), F.trim(F.regexp_replace("s", r"^#{1,6}\s+", "")))).alias("title"), F.array_sort(F.collect_list(F.when(~F.col("starts"), F.struct("line", "s")))).alias("body"))
    text = F.regexp_replace(F.array_join(F.transform("body", lambda x: x["s"]), "\n"), r"^\s+|\s+$", "")
    label = F.regexp_replace(F.regexp_replace(F.lower("title"), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    end = F.coalesce(F.lead("place").over(Window.partitionBy("id").orderBy("pos")), F.col("size"))
    first = F.when(F.col("title").isNull(), F.col("pos")).otherwise(F.col("pos") - 1)  # sections are counted from 0
    return g.select("id", first.cast("int").alias("pos"), F.when(F.col("title").isNull(), "filing-content").when(label == "", "section").otherwise(label).alias("label"), F.coalesce("title", F.lit("Filing content")).alias("title"), text.alias("text"), F.col("place").cast("int").alias("char_start"), end.cast("int").alias("char_end"))


def header_spans(headers: DataFrame) -> DataFrame:
    """Each chosen header ends where the next one starts; the last at the next header of any kind (column limit)."""
    w = Window.partitionBy("id").orderBy("start")
    return headers.withColumn("end", F.coalesce(F.lead("start").over(w), F.col("limit")))


def summary_health(trees: DataFrame) -> DataFrame:
    """Of trees indexed in full, how many have only empty summaries; degraded from a tenth on."""
    empty = F.forall("summaries", lambda s: F.coalesce(s, F.lit("")) == "")
    t = trees.agg(F.count_if(F.col("full")).alias("n_full"), F.count_if(F.col("full") & empty).alias("n_empty"))
    return t.withColumn("degraded", (F.col("n_full") > 0) & (F.col("n_empty") >= 0.1 * F.col("n_full")))


def raw_tree(filings: DataFrame) -> DataFrame:
    """Sections with empty summaries and no chunks."""
    node = lambda s: F.struct(s["label"].alias("label"), s["title"].alias("title"), s["text"].alias("text"), F.lit("").alias("summary"))
    return filings.withColumn("sections", F.transform("sections", node)).withColumn("full", F.lit(False))


def full_tree(nodes: DataFrame, summaries: DataFrame) -> DataFrame:
    """Sections in order with the summaries that were made for them; missing ones are empty."""
    j = nodes.join(summaries, ["accession", "label"], "left")
    s = F.struct("pos", "label", "title", "text", F.coalesce("made", F.lit("")).alias("summary"))
    return j.groupBy("accession").agg(F.array_sort(F.collect_list(s)).alias("sections")).withColumn("full", F.lit(True))


def listing(sidecars: DataFrame) -> DataFrame:
    """Indexed filings from their sidecars (json) alone; those that can't be read, or name no filing, are left out."""
    r = sidecars.select(F.from_json("json", "accession string, ticker string, form string, filed date, sections int").alias("r")).select("r.*")
    return r.where("accession IS NOT NULL AND ticker IS NOT NULL AND filed IS NOT NULL")
