"""Sections of filings on rows: places where an item begins, candidate headers among them, ends by the next place, and a choice by rank; chunks of sections.

HTML becomes text in Arrow batches; all else is column expressions and windows within one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import filings, ownership

# Forms with curated sections, and headers of the sections of annual and quarterly reports (Unicode white space and case).
CURATED = ["10-K", "10-Q", "10-K/A", "10-Q/A"]
_HEADERS = {
    "business": r"item\s*1\b(?!a)[\.\s\-:–—]*business\b",
    "risk_factors": r"item\s*1a\b[\.\s\-:–—]*risk\s+factors\b",
    "mdna": r"item\s*7\b(?!a)[\.\s\-:–—]*management.{0,80}analysis",
    "financial_statements": r"item\s*8\b[\.\s\-:–—]*(?:financial\s+statements|consolidated\s+financial)",
}
# Any item's header, part labels, and characters that no section begins with.
_ANY_ITEM = r"^item\s*\d+[a-z]?\b[\.\s\-:–—]"
_PART, _PART_ONE = r"^(part\s+[ivxlcdm]+\b[\.\s\-:–—]*)?$", r"^\s*PART\s+I\b"
_NO_BEGINNING = "\"“”’':;)]}"
# Characters a section must have to follow its own header; most characters of an entry of a table of contents, few of one with a page range, share of digits.
_LEAST_BODY, _MOST_ENTRY, _FEW, _DIGITS = 120, 500, 100, 0.4
_FLAGS = "(?iusU)"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _from(text: str, start: Column, end: Column | None = None) -> Column:
    """Characters start (from 0) to end of a column."""
    return F.substr(text, start + 1, F.greatest(end - start, F.lit(0)) if end is not None else F.length(text))


def item_places(texts: DataFrame) -> DataFrame:
    """A row for each place of `text` where "item" and a digit stand: id, start, line (what stands before it on its line), label and title of the header it begins (or NULL), head_end, next_item.

    next_item is where the next header of any item begins after this header, or the length of the text.
    """
    p = texts.select("id", F.posexplode(F.split("text", r"(?iU)(?=item\s*\d)")).alias("k", "piece"))
    w = Window.partitionBy("id").orderBy("k")
    p = p.withColumns(
        {
            "start": F.coalesce(F.sum(F.length("piece")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "size": F.sum(F.length("piece")).over(Window.partitionBy("id")),
            "ahead": F.concat_ws("", "piece", F.lead("piece", 1).over(w), F.lead("piece", 2).over(w)),
            "behind": F.coalesce(F.lag("piece").over(w), F.lit("")),
            "only": F.col("k") < 2,
        }
    )
    p = p.where(F.rlike("piece", F.lit(r"(?iU)^item\s*\d")))
    line = F.substring_index("behind", "\n", -1)
    line = F.when(F.col("only") | F.contains("behind", F.lit("\n")), line).otherwise(F.lit("item"))  # an item before it on its line
    word = F.rlike("behind", F.lit(r"(?U)\w\z"))
    found = F.array_compact(F.array(*(F.when(F.rlike("ahead", F.lit(f"{_FLAGS}^{x}")), F.struct(F.lit(label).alias("label"), F.regexp_extract("ahead", f"{_FLAGS}^{x}", 0).alias("title"))) for label, x in _HEADERS.items())))
    p = p.withColumns({"line": line, "any": F.rlike("ahead", F.lit(_FLAGS + _ANY_ITEM)) & ~word, "header": F.get(found, F.lit(0))})
    p = p.withColumn("head_end", F.col("start") + F.length("header.title"))
    place = F.when(F.col("any"), F.col("start"))
    near = F.filter(F.collect_list(place).over(w.rowsBetween(1, 4)), lambda s: s >= F.col("head_end"))
    far = F.min(place).over(w.rowsBetween(5, Window.unboundedFollowing))
    return p.withColumn("next_item", F.coalesce(F.get(near, F.lit(0)), far, F.col("size"))).select("id", "start", "line", "header.label", "header.title", "head_end", "next_item")


def is_contents(body: Column) -> Column:
    """Whether a section is only an entry of a table of contents: short, and made of page numbers."""
    s = _strip(body)
    head = F.regexp_replace(F.substr(s, F.lit(1), F.lit(100)), "[ \n]", "")
    ranges = F.regexp_count(s, F.lit(r"\b\d+\s*[-–]\s*\d+\b"))
    numbers_only = F.rlike(s, F.lit(r"(?U)^[\s\.\-–—,;\d]+$"))
    mostly_digits = F.length(F.regexp_replace(head, r"(?U)\d", "")) < (1 - _DIGITS) * F.length(head)
    pages = F.when(F.length(s) < _FEW, ranges >= 1).otherwise(ranges >= 2)
    return (F.length(body) <= _MOST_ENTRY) & (s != "") & (numbers_only | pages | mostly_digits)


def curated(texts: DataFrame) -> DataFrame:
    """id, pos, label, title, text, char_start, char_end, is_pointer, target of the curated sections of each text (id, text).

    For each label the first header counts that stands alone on its line, after a part label at most, and has enough prose after it; where there is none, the last one. A section ends where the
    next one begins, the last at the next item. Where all sections found are entries of a table of contents, only what follows PART I is gone through; where that ends no better, there are none.
    """
    earlier = Window.partitionBy("id", "label").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    places = item_places(texts).where("label IS NOT NULL").withColumn("taken", F.max("head_end").over(earlier))
    places = places.where("taken IS NULL OR taken <= start").drop("taken")  # a header inside one of its own kind is part of that
    part = F.regexp_instr("text", F.lit(r"(?imU)" + _PART_ONE))
    after_part = F.when(part > 0, part - 1 + F.length(F.regexp_extract("text", r"(?imU)" + _PART_ONE, 0)))
    c = places.join(texts.select("id", "text", after_part.alias("after_part")), "id")
    body = _strip(_from("text", F.col("head_end"), F.col("next_item")))
    first = F.substr(body, F.lit(1), F.lit(1))
    alone = F.rlike(F.trim(_strip("line")), F.lit(_FLAGS + _PART))
    proper = alone & (F.length(body) >= _LEAST_BODY) & ~F.rlike(first, F.lit(r"(?U)\d")) & ~F.contains(F.lit(_NO_BEGINNING), first)
    passes = F.when(F.col("start") >= F.col("after_part"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    c = c.select("id", "start", "label", "title", "head_end", "next_item", proper.alias("proper"), F.explode(passes).alias("pass"))
    rank = Window.partitionBy("id", "pass", "label").orderBy(F.desc("proper"), F.when(F.col("proper"), F.col("start")).otherwise(-F.col("start")))
    c = c.withColumn("at", F.row_number().over(rank)).where("at = 1")
    order = Window.partitionBy("id", "pass").orderBy("start")
    c = c.withColumns({"char_end": F.coalesce(F.lead("start").over(order), F.col("next_item")), "pos": F.row_number().over(order) - 1})
    s = c.join(texts.select("id", F.col("text").alias("whole")), "id").withColumn("text", _strip(_from("whole", F.col("head_end"), F.col("char_end")))).drop("whole")
    s = s.withColumn("useless", F.min(is_contents(F.col("text"))).over(Window.partitionBy("id", "pass"))).where("NOT useless")
    s = s.withColumn("best", F.min("pass").over(Window.partitionBy("id"))).where("pass = best")
    target = filings.pointer_target(F.col("text"))
    return s.select("id", F.col("pos").cast("int").alias("pos"), "label", _strip("title").alias("title"), "text", F.col("start").cast("int").alias("char_start"), F.col("char_end").cast("int").alias("char_end"), target.isNotNull().alias("is_pointer"), target.alias("target"))


def markdown_of(content: Column, kind: Column) -> Column:
    """What generic sections are cut from."""
    headed = F.when(F.rlike(content, F.lit(r"(?mU)^#{1,6}\s")), content).otherwise(F.concat(F.lit("# Document\n\n"), content))
    return F.when(kind == "html", filings.html_markdown(content)).when(kind == "xml", ownership.xml_report(content)).otherwise(headed)


def sections(docs: DataFrame) -> DataFrame:
    """Sections of filings (id, content, form, kind; html where that is NULL): curated ones of annual and quarterly HTML reports, else, or if there are none, generic ones."""
    d = docs.select("id", F.coalesce("content", F.lit("")).alias("content"), F.upper(F.trim("form")).alias("form"), F.coalesce("kind", F.lit("html")).alias("kind"))
    curated_form = F.col("form").isin(*CURATED) & (F.col("kind") == "html")
    found = curated(d.where(curated_form).select("id", filings.html_text("content").alias("text")))
    rest = d.join(found.select("id").distinct(), "id", "left_anti").select("id", markdown_of(F.col("content"), F.col("kind")).alias("markdown"))
    plain = filings.generic_sections(rest).select("id", "pos", "label", "title", "text", "char_start", "char_end", F.lit(False).alias("is_pointer"), F.lit(None).cast("string").alias("target"))
    return found.unionByName(plain)


def chunks(texts: DataFrame, tokens: int = 4000) -> DataFrame:
    """id, pos, chunk: paragraphs of `text` filled greedily up to so many tokens (four characters each); longer ones by sentences.

    Where a chunk that begins at a unit would end is the last unit whose tokens before it lie within reach, by a window over these sums; the chunks that there are follow from the first of each run.
    """
    size = lambda c: F.floor(F.length(c) / 4)
    p = texts.select("id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n\n")).alias("k", "raw")).select("id", "k", _strip("raw").alias("p")).where("p <> ''")
    p = p.withColumn("long", size("p") > tokens)
    p = p.withColumn("run", 2 * F.sum(F.col("long").cast("int")).over(Window.partitionBy("id").orderBy("k")) - F.col("long").cast("int"))
    u = p.select("id", "run", "long", "k", F.posexplode(F.when(F.col("long"), F.split("p", r"(?U)(?<=[.!?])\s+(?=[A-Z])")).otherwise(F.array("p"))).alias("j", "u"))
    order = Window.partitionBy("id", "run").orderBy("k", "j")
    u = u.withColumns({"n": F.row_number().over(order), "before": F.sum(size("u")).over(order) - size("u")})
    ends = u.groupBy("id", "run").agg(F.max("n").alias("m"), F.max(F.col("before") + size("u")).alias("total"))
    marks = u.select("id", "run", "n", "before").unionByName(ends.select("id", "run", (F.col("m") + 1).alias("n"), F.col("total").alias("before")))
    reach = F.max("n").over(Window.partitionBy("id", "run").orderBy("before").rangeBetween(0, tokens))
    nexts = marks.withColumn("next", F.greatest(reach, F.col("n") + 1)).groupBy("id", "run").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "next"))), lambda x: x["next"]).alias("next"), F.max("before").alias("total"))  # a document's own units
    # Two chunks in a row exceed the limit, so there are no more than this.
    most = (2 * F.col("total") / tokens).cast("int") + 2
    step = lambda s, _: F.when(F.element_at(s, -1) < F.size("next"), F.array_append(s, F.element_at("next", F.element_at(s, -1)))).otherwise(s)
    starts = nexts.select("id", "run", F.aggregate(F.sequence(F.lit(1), most), F.array(F.lit(1)), step).alias("starts"))
    c = u.join(starts, ["id", "run"]).withColumn("c", F.size(F.filter("starts", lambda s: s <= F.col("n"))))
    g = c.groupBy("id", "run", "c").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "u"))), lambda x: x["u"]).alias("units"), F.max("long").alias("long"))
    chunk = F.when(F.col("long"), F.array_join("units", " ")).otherwise(F.array_join("units", "\n\n"))
    return g.select("id", (F.row_number().over(Window.partitionBy("id").orderBy("run", "c")) - 1).alias("pos"), chunk.alias("chunk"))
