"""Document trees from flat lists: Markdown headings, levels, dotted codes, page groups, spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def markdown_nodes(docs: DataFrame) -> DataFrame:
    """doc, node, level, title, text: headings outside code fences, each with the text up to the next one."""
    lines = docs.select("doc", F.posexplode(F.split("content", "\n")).alias("line", "s"))
    w = Window.partitionBy("doc").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    fences = F.sum(F.when(F.ltrim("s").startswith("```"), 1).otherwise(0)).over(w)
    head = F.regexp_extract("s", r"^(#{1,6})\s+(.+)$", 1)
    lines = lines.withColumn("fenced", fences % 2 == 1).withColumn("level", F.when(~F.col("fenced"), F.nullif(F.length(head), F.lit(0))))
    lines = lines.withColumn("node", F.sum(F.col("level").isNotNull().cast("int")).over(w)).where("node > 0")
    g = lines.groupBy("doc", "node").agg(F.max("level").alias("level"), F.max(F.when(F.col("level").isNotNull(), F.trim(F.regexp_replace("s", r"^#{1,6}\s+", "")))).alias("title"), F.array_sort(F.collect_list(F.struct("line", "s"))).alias("body"))
    return g.select("doc", "node", "level", "title", F.array_join(F.transform("body", lambda x: x["s"]), "\n").alias("text"))


def parents_by_level(nodes: DataFrame, deepest: int = 6) -> DataFrame:
    """parent: the last node before with a smaller level; id: the node's number in four digits."""
    w = Window.partitionBy("doc").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.max(F.when(F.col("level") == k, F.col("node"))).over(w) for k in range(1, deepest)]
    candidates = [F.when(F.col("level") > k, c) for k, c in enumerate(last, 1)]
    return nodes.withColumn("parent", F.greatest(*candidates)).withColumn("id", F.lpad(F.col("node").cast("string"), 4, "0"))


def parents_by_code(nodes: DataFrame) -> DataFrame:
    """parent of '1.2.3' is '1.2' if there is such a code, else none."""
    up = F.when(F.contains("code", F.lit(".")), F.regexp_replace("code", r"\.[^.]*$", ""))
    n = nodes.withColumn("up", up)
    return n.join(nodes.select("doc", F.col("code").alias("up"), F.lit(True).alias("there")), ["doc", "up"], "left").select(*nodes.columns, F.when(F.col("there"), F.col("up")).alias("parent"))


def subtree_tokens(nodes: DataFrame) -> DataFrame:
    """Tokens of each node with all below it: those up to the next node of the same level or a smaller one. Windows only, per level."""
    t = nodes.withColumn("own", F.floor(F.length("text") / 4)).withColumn("sofar", F.sum(F.floor(F.length("text") / 4)).over(Window.partitionBy("doc").orderBy("node").rowsBetween(Window.unboundedPreceding, 0)))
    after = Window.partitionBy("doc").orderBy(F.desc("node")).rowsBetween(Window.unboundedPreceding, -1)
    ends = [F.last(F.when(F.col("level") <= k, F.col("sofar") - F.col("own")), ignorenulls=True).over(after) for k in range(1, 7)]
    total = F.max("sofar").over(Window.partitionBy("doc"))
    end = F.coalesce(F.element_at(F.array(*ends), F.col("level").cast("int")), total)
    return t.select(*nodes.columns, (end - F.col("sofar") + F.col("own")).alias("tokens"))


def thinned(nodes: DataFrame, least: int) -> DataFrame:
    """Without the nodes below one whose whole subtree is under `least` tokens (column tokens); that one stands for them."""
    w = Window.partitionBy("doc").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    under = F.lit(False)
    for k in range(1, 6):  # the last node of level k or less must be a small one of level k for what follows to be below it
        last = F.last(F.when(F.col("level") <= k, F.struct("level", "tokens")), ignorenulls=True).over(w)
        under = under | F.coalesce((F.col("level") > k) & (last["level"] == k) & (last["tokens"] < least), F.lit(False))
    return nodes.withColumn("under", under).where("NOT under").drop("under")


def page_groups(pages: DataFrame, most: int) -> DataFrame:
    """Groups of consecutive pages of about equal tokens, none much over most; each starts with the last page of the one before."""
    whole = Window.partitionBy("doc")
    n = F.greatest(F.lit(1), F.ceil(F.sum("tokens").over(whole) / most))
    before = F.coalesce(F.sum("tokens").over(whole.orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    g = pages.withColumn("group", F.floor(before * n / F.greatest(F.lit(1), F.sum("tokens").over(whole))))
    both = g.withColumn("again", F.when(F.lead("group").over(whole.orderBy("page")) > F.col("group"), F.lead("group").over(whole.orderBy("page"))))
    own = both.select("doc", "page", "tokens", "group", F.lit(False).alias("overlap"))
    return own.union(both.where("again IS NOT NULL").select("doc", "page", "tokens", F.col("again"), F.lit(True)))


def page_spans(items: DataFrame, last_page: Column) -> DataFrame:
    """end: the next item's start, one less if that one opens its page; the document's last page at the end."""
    w = Window.partitionBy("doc").orderBy("pos")
    following = F.lead("start").over(w)
    end = F.when(F.lead("opens_page").over(w), F.greatest("start", following - 1)).otherwise(following)
    return items.withColumn("end", F.coalesce(end, last_page))


def valid_pages(items: DataFrame, pages: Column, offset: Column) -> DataFrame:
    shifted = F.col("start") + offset
    return items.withColumn("start", F.when((shifted >= 1) & (shifted <= pages), shifted))


def matching_titles(toc: DataFrame, found: DataFrame, least: int) -> DataFrame:
    """Page pairs of items with one title; found pages from `least` on."""
    return toc.join(found.where(F.col("physical") >= least), ["doc", "title"]).select("doc", "title", "pos", "page", "physical")


def page_offset(pairs: DataFrame) -> DataFrame:
    """The commonest difference, the one seen first of several: at the least place, then the least."""
    d = pairs.withColumn("offset", F.col("physical") - F.col("page")).groupBy("doc", "offset").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    return d.groupBy("doc").agg(F.max_by("offset", F.struct("n", -F.col("first"), -F.col("offset"))).alias("offset"))


def leaves(nodes: DataFrame) -> DataFrame:
    """Nodes that are no one's parent."""
    return nodes.join(nodes.select("doc", F.col("parent").alias("node")).where("node IS NOT NULL").distinct(), ["doc", "node"], "left_anti")
