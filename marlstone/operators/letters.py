"""Letters and thesis files written from typed rows, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lines(*parts: Column | str) -> Column:
    return F.concat_ws("\n", *(F.lit(p) if isinstance(p, str) else p for p in parts))


def quarter_bodies(theses: DataFrame, quarter: int) -> DataFrame:
    """A quarter's section for each regime: the regime, and the active theses under it with their buckets."""
    t = theses.where("status = 'active'").groupBy(F.lower("color").alias("color"))
    listed = t.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("thesis", "bucket"))), lambda x: F.concat(F.lit("- "), x["thesis"], F.lit(" ("), x["bucket"], F.lit(")"))), "\n").alias("listed"))
    return listed.select("color", lines(f"## Q{quarter}", "", "### Regime & Environment", F.concat(F.lit("Regime: "), F.upper("color")), "", "### Active Theses", F.col("listed")).alias("body"))


def scaffold(theses: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """A new thesis file for each row; evidence (thesis, place, citation) is numbered and goes to its end."""
    head = lines(F.concat(F.lit("# "), "thesis"), "", "```yaml", F.concat(F.lit("ticker: "), "thesis"), F.concat(F.lit("bucket: "), "bucket"), "status: draft", "```", "", "## Kill Conditions", "", "## Evidence")
    if evidence is None:
        return theses.select("thesis", head.alias("content"))
    e = evidence.groupBy("thesis").agg(F.array_sort(F.collect_list(F.struct("place", "citation"))).alias("e"))
    shown = F.array_join(F.transform("e", lambda x: F.concat(x["place"].cast("string"), F.lit(". "), x["citation"])), "\n")
    return theses.join(e, "thesis", "left").select("thesis", F.concat_ws("\n", head, shown).alias("content"))


QUARTERS = {1: "Q1: January — March", 2: "Q2: April — June", 3: "Q3: July — September", 4: "Q4: October — December"}  # fixed values: headers of a letter's quarters
PLACEHOLDER = "[To be populated.]"  # fixed value


def skeleton(year: Column) -> Column:
    """An empty letter: the year's context, four quarters and the summary, each with a placeholder."""
    quarters = [part for label in QUARTERS.values() for part in (f"## {label}", "", PLACEHOLDER, "", "---", "")]
    return lines(F.concat(F.lit("# "), year.cast("string"), F.lit(" Investor Letter")), "", "## Year in Context", "", "[Year-end only.]", "", "---", "", *quarters, "## Full Year Summary", "", "[To be written at year-end finalization.]", "")


def sections(content: Column) -> Column:
    """Second-level sections of a letter: header, body, and whether anything has been written there (a third-level header)."""
    parts = F.regexp_extract_all(F.coalesce(content, F.lit("")), F.lit(r"(?ms)^## .*?(?=^## |\z)"), 0)
    cut = lambda p: F.struct(F.trim(F.regexp_extract(p, r"\A## ([^\n]*)", 1)).alias("header"), F.regexp_replace(F.regexp_replace(p, r"\A## [^\n]*", ""), r"^\s+|\s+$", "").alias("body"), F.contains(p, F.lit("\n### ")).alias("written"))
    return F.transform(parts, cut)


def quarter_of_letter(content: Column, quarter: Column) -> Column:
    """The section of a quarter, NULL without one."""
    return F.get(F.filter(sections(content), lambda s: s["header"].startswith(F.concat(F.lit("Q"), quarter.cast("string"), F.lit(":")))), 0)


def updated(letters: DataFrame, force: bool = False) -> DataFrame:
    """letters (name, content, quarter, body) with a quarter's section replaced: outcome written, refused (populated, and no force) or missing (no such section)."""
    old = quarter_of_letter(F.col("content"), F.col("quarter"))
    may = old.isNotNull() & (F.lit(force) | ~old["written"])
    first = F.substring_index(F.expr("substring(content, locate(concat('## Q', cast(quarter AS string), ':'), content))"), "\n", 1)
    after = F.expr("substring(content, locate(concat('## Q', cast(quarter AS string), ':'), content) + 1)")
    beyond = F.regexp_extract(after, r"(?s)\n(## .*)", 1)
    new = F.concat(F.expr("substring(content, 1, locate(concat('## Q', cast(quarter AS string), ':'), content) - 1)"), first, F.lit("\n\n"), F.col("body"), F.lit("\n\n---\n\n"), beyond)
    outcome = F.when(old.isNull(), "missing").when(may, "written").otherwise("refused")
    return letters.select("name", "quarter", outcome.alias("outcome"), F.when(may, new).otherwise(F.col("content")).alias("content"))


def status(letters: DataFrame) -> DataFrame:
    """Of each letter (name, content): its populated quarters, and whether it may be finalized (all four are, and the summary isn't written)."""
    s = letters.withColumn("s", sections(F.col("content")))
    done = F.transform(F.filter("s", lambda x: F.rlike(x["header"], F.lit(r"^Q[1-4]:")) & x["written"]), lambda x: F.substring(x["header"], 2, 1).cast("int"))
    summary = F.exists("s", lambda x: x["header"].startswith("Full Year Summary") & ~F.contains(x["body"], F.lit("[To be written at year-end finalization.]")))
    return s.select("name", F.array_sort(done).alias("quarters"), summary.alias("finalized"), ((F.size(done) == 4) & ~summary).alias("may_finalize"))
