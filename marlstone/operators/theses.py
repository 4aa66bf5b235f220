"""Written theses, their health scores, watchlists and letters."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import lookup, money
from . import documents

# Score by bucket and regime colour.
RISK = {
    "value": {"green": 80, "blue": 80, "orange": 60, "red": 40, "danger": 30},
    "systematic": {"green": 70, "blue": 70, "orange": 60, "red": 50, "danger": 40},
    "short": {"green": 40, "blue": 40, "orange": 65, "red": 85, "danger": 85},
    "yolo": {"green": 70, "blue": 70, "orange": 50, "red": 35, "danger": 30},
}
# Actions from worst to best, and the least score of each.
ACTIONS = ["EXIT", "REDUCE", "HOLD", "ADD"]
LEAST = [40, 55, 75]
METADATA = "ticker string, company string, bucket string, status string, opened string, last_reviewed string, health_score string, cost_basis string, shares string, portfolio_weight string"
COMPONENT = "array<struct<name:string,weight:int,score:int,notes:string>>"
KILL = "array<struct<description:string,monitoring:string,last_checked:string,status:string>>"


def risk_score(bucket: Column, color: Column) -> Column:
    table = {f"{b}/{c}": s for b, row in RISK.items() for c, s in row.items()}
    return lookup(F.concat_ws("/", bucket, F.lower(color)), table, F.lit(55))


def safety_score(margin: Column) -> Column:
    return F.when(margin.isNull(), 55).when(margin > 40, 90).when(margin > 25, 75).when(margin > 10, 60).when(margin > 0, 45).when(margin > -20, 30).otherwise(15)


def catalyst_score(days: Column) -> Column:
    return F.when(days.isNull(), 50).when(days < 0, 35).when(days <= 30, 85).when(days <= 90, 75).when(days <= 180, 60).otherwise(55)


def margin_of_safety(fair: Column, price: Column) -> Column:
    return F.when(price > 0, (fair - price) / price * 100)


def overall(components: DataFrame, key: str = "thesis") -> DataFrame:
    """Weighted mean of the scores, halves to even; 0 without weights."""
    mean = F.try_divide(F.sum(F.col("score") * F.col("weight")).cast("double"), F.sum("weight").cast("double"))
    return components.groupBy(key).agg(F.coalesce(F.bround(mean, 0), F.lit(0.0)).cast("int").alias("overall"), F.min_by("name", F.struct("score", "pos")).alias("weakest"))


def action_level(score: Column) -> Column:
    return F.when(score < LEAST[0], 0).when(score < LEAST[1], 1).when(score < LEAST[2], 2).otherwise(3)


def regime_shift(bucket: Column, color: Column) -> Column:
    c = F.lower(color)
    return F.when((bucket == "short") & c.isin("danger", "red"), 1).when((c == "danger") | ((c == "red") & (bucket == "yolo")), -1).otherwise(0)


def action(score: Column, bucket: Column, color: Column, killed: Column | None = None) -> Column:
    level = F.greatest(F.lit(0), F.least(F.lit(3), action_level(score) + regime_shift(bucket, color)))
    named = F.element_at(F.array(*map(F.lit, ACTIONS)), level + 1)
    return named if killed is None else F.when(killed, "EXIT").otherwise(named)


def evaluate(theses: DataFrame, components: DataFrame, kills: DataFrame | None = None) -> DataFrame:
    """thesis, overall, weakest, action, kill_reasons: a triggered kill condition makes it EXIT whatever the score."""
    h = theses.join(overall(components), "thesis", "left").withColumn("overall", F.coalesce("overall", F.lit(0)))
    if kills is None:
        return h.withColumn("action", action(F.col("overall"), F.col("bucket"), F.col("color")))
    k = kills.where("status = 'triggered'").groupBy("thesis").agg(F.array_sort(F.collect_list("description")).alias("kill_reasons"))  # of one thesis
    h = h.join(k, "thesis", "left").withColumn("kill_reasons", F.coalesce("kill_reasons", F.array().cast("array<string>")))
    return h.withColumn("action", action(F.col("overall"), F.col("bucket"), F.col("color"), F.size("kill_reasons") > 0))


def refreshed(components: DataFrame, theses: DataFrame, quick: bool = False) -> DataFrame:
    """Components with those that can be derived anew; the others keep their score. quick: the risk score only.

    theses: thesis, bucket, color, fair_value, price, days_to_catalyst.
    """
    j = components.join(theses, "thesis")
    margin = margin_of_safety(F.col("fair_value"), F.col("price"))
    new = F.when(F.col("name") == "Risk Environment", risk_score(F.col("bucket"), F.col("color")))
    if not quick:
        new = new.when((F.col("name") == "Valuation Safety") & margin.isNotNull(), safety_score(margin)).when((F.col("name") == "Catalyst Proximity") & F.col("days_to_catalyst").isNotNull(), catalyst_score(F.col("days_to_catalyst")))
    return j.select("thesis", "pos", "name", "weight", F.coalesce(new, "score").alias("score"), (new.isNotNull() & (new != F.col("score"))).alias("changed"))


def monitored(theses: DataFrame, components: DataFrame) -> DataFrame:
    """Active theses with their outcome: scored, unscored (no components) or malformed (no bucket); changed: the action is another than before.

    The action before is adjusted by the regime like the new one, so like is compared with like.
    """
    t = theses.where("status = 'active'")
    e = evaluate(t, components)
    scored = components.select("thesis").distinct().withColumn("has", F.lit(True))
    e = e.join(scored, "thesis", "left")
    outcome = F.when(F.col("bucket").isNull(), "malformed").when(F.col("has").isNull(), "unscored").otherwise("scored")
    before = action(F.col("score_before"), F.col("bucket"), F.col("color"))
    return e.withColumn("outcome", outcome).withColumn("changed", (F.col("outcome") == "scored") & (F.col("action") != before))


@F.pandas_udf(T.StringType())
def metadata_json(content: pd.Series) -> pd.Series:
    return content.map(documents.metadata)


def table_cells(content: Column | str, header: Column) -> Column:
    """Cells of the first table in the sections of that header, without its head and rule; rows with '[' are placeholders and drop out."""
    content = F.col(content) if isinstance(content, str) else content
    parts = F.split(F.coalesce(content, F.lit("")), r"(?m)^(?=#)")
    heading = lambda p: F.lower(F.trim(F.regexp_replace(F.substring_index(p, "\n", 1), "^#+", "")))
    own = F.filter(parts, lambda p: F.startswith(p, F.lit("#")) & F.startswith(heading(p), F.lower(header)))
    tables = F.filter(F.transform(own, lambda p: F.regexp_extract(p, r"(?m)(?:^[ \t]*\|[^\n]*\n?)+", 0)), lambda t: t != "")
    lines = F.filter(F.split(F.coalesce(F.get(tables, F.lit(0)), F.lit("")), "\n"), lambda s: F.trim(s) != "")
    strip = lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")
    rows = F.transform(lines, lambda s: F.transform(F.split(F.regexp_replace(strip(s), r"^\|+|\|+$", ""), r"\|"), strip))
    return F.filter(F.slice(rows, 3, F.greatest(F.size(rows), F.lit(1))), lambda r: ~F.exists(r, lambda c: F.contains(c, F.lit("["))))


#: What a model is asked to score.
SCORED = ("business_health", "insider_alignment", "thesis_integrity")


def loose_scores(raw: Column | str, keys: tuple[str, ...] = SCORED) -> Column:
    """Scores by key, as JSON, from JSON that may stand in a fence or in prose, held to 0 to 100; missing ones are left out."""
    text = F.trim(F.coalesce(F.col(raw) if isinstance(raw, str) else raw, F.lit("")))
    tries = F.concat(F.array(text), F.regexp_extract_all(text, F.lit(r"(?s)```(?:json)?\s*(.*?)```"), F.lit(1)), F.regexp_extract_all(text, F.lit(r"(?s)\{.*\}"), F.lit(0)))
    value = F.try_parse_json(F.get(F.filter(tries, lambda t: F.try_parse_json(t).isNotNull()), F.lit(0)))
    number = lambda key: F.regexp_like(F.schema_of_variant(F.try_variant_get(value, f"$['{key}'].score", "variant")), F.lit("^(BIGINT|DOUBLE|DECIMAL|FLOAT)"))
    score = lambda key: F.greatest(F.lit(0), F.least(F.lit(100), F.try_variant_get(value, f"$['{key}'].score", "double").cast("long")))
    return F.to_json(F.struct(*(F.when(number(key), score(key)).alias(key) for key in keys)))


def read_documents(spark, path: str, but: str = "") -> DataFrame:
    """Whole text files with their names; names that contain `but` (templates) left out."""
    d = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("content"))
    return d.where(~F.contains("name", F.lit(but))) if but else d


def parsed(docs: DataFrame) -> DataFrame:
    """Typed metadata of thesis documents; all NULL where a required key is missing or no date."""
    j = docs.withColumn("json", metadata_json("content")).withColumn("m", F.from_json("json", METADATA))
    m = lambda c: F.col(f"m.{c}")
    opened = F.try_to_date(m("opened"), "yyyy-MM-dd")
    ok = m("ticker").isNotNull() & m("bucket").isNotNull() & m("status").isNotNull() & opened.isNotNull()
    pick = lambda c: F.when(ok, c)
    return j.select(
        "name", "content", "json",
        pick(F.upper(m("ticker"))).alias("ticker"), pick(F.coalesce(m("company"), F.lit(""))).alias("company"), pick(F.lower(m("bucket"))).alias("bucket"), pick(F.lower(m("status"))).alias("status"), pick(opened).alias("opened"),
        pick(F.try_to_date(m("last_reviewed"), "yyyy-MM-dd")).alias("last_reviewed"), pick(m("health_score").try_cast("double").cast("int")).alias("health_score"), pick(m("cost_basis").try_cast("double")).alias("cost_basis"), pick(F.coalesce(m("shares").try_cast("double").cast("int"), F.lit(0))).alias("shares"), pick(m("portfolio_weight").try_cast("double")).alias("portfolio_weight"),
    )


def components_of(docs: DataFrame) -> DataFrame:
    """Health components: from the metadata if they are there, else from the table."""
    listed = F.from_json(F.get_json_object("json", "$.health_components"), COMPONENT)
    cells = table_cells("content", F.lit("Thesis Health"))
    from_table = F.transform(F.filter(cells, lambda r: F.size(r) >= 3), lambda r: F.struct(r[0].alias("name"), F.regexp_replace(r[1], r"%", "").try_cast("int").alias("weight"), F.regexp_replace(r[2], r"/100|\*", "").try_cast("int").alias("score"), F.get(r, 3).alias("notes")))
    return docs.select("name", F.posexplode(F.coalesce(listed, from_table)).alias("pos", "c")).select("name", "pos", F.col("c.name").alias("component"), "c.weight", "c.score", "c.notes")


def kill_conditions_of(docs: DataFrame) -> DataFrame:
    listed = F.from_json(F.get_json_object("json", "$.kill_conditions"), KILL)
    cells = table_cells("content", F.lit("Kill Conditions"))
    at = lambda r: F.when(F.rlike(r[0], F.lit(r"^\d+$")) & (F.size(r) >= 4), 1).otherwise(0)
    from_table = F.transform(F.filter(cells, lambda r: F.size(r) >= 3), lambda r: F.struct(F.get(r, at(r)).alias("description"), F.get(r, at(r) + 1).alias("monitoring"), F.get(r, at(r) + 2).alias("last_checked"), F.lit("active").alias("status")))
    return docs.select("name", F.posexplode(F.coalesce(listed, from_table)).alias("pos", "k")).select("name", "pos", "k.*")


def watchlist(docs: DataFrame) -> DataFrame:
    """Rows of the ranked table of watchlist documents; the last of 14 cells is the price."""
    lines = docs.select("name", F.explode(F.regexp_extract_all("content", F.lit(r"(?m)^(\|.*\|)\s*$"), 1)).alias("line"))
    cells = F.transform(F.split(F.regexp_replace("line", r"^\||\|\s*$", ""), r"\|"), lambda c: F.trim(c))
    r = lines.withColumn("c", cells).where("size(c) >= 4").select("name", F.col("c")[0].try_cast("int").alias("rank"), F.col("c")[1].alias("ticker"), F.col("c")[2].alias("sector"), F.replace(F.col("c")[3], F.lit("*"), F.lit("")).try_cast("double").alias("score"), F.when(F.size("c") >= 14, money(F.element_at("c", -1))).alias("price"))
    return r.where("rank IS NOT NULL AND score IS NOT NULL")


def listed_documents(names: DataFrame, but: str, suffix: str = ".md") -> DataFrame:
    """Names of documents, sorted, without templates (names that contain `but`) and files of other kinds."""
    return names.where(F.col("name").endswith(suffix) & ~F.contains("name", F.lit(but))).orderBy("name")


def of_status(theses: DataFrame, status: str) -> DataFrame:
    return theses.where(F.lower(F.trim("status")) == status.lower())


def latest_document(docs: DataFrame) -> DataFrame:
    """The one whose name has the last date."""
    from ..functions.scalar import name_date

    return docs.withColumn("date", name_date(F.col("name"))).where("date IS NOT NULL").orderBy(F.desc("date"), F.desc("name")).limit(1)


def moves(rows: DataFrame, threshold: float) -> DataFrame:
    """Move against the price before, note of its direction, and whether it is a big one."""
    move = F.try_divide(F.col("price") - F.col("before"), F.nullif(F.col("before"), F.lit(0.0))) * 100
    r = rows.withColumn("move_pct", F.when(F.col("price") > 0, move))
    note = F.when(F.col("move_pct").isNull(), "no price").when(F.col("move_pct") >= threshold, "up").when(F.col("move_pct") <= -threshold, "down").otherwise("flat")
    return r.withColumn("note", note).withColumn("big", F.coalesce(F.abs("move_pct") >= threshold, F.lit(False)))


def cost_basis(content: Column) -> Column:
    """The cost basis that a thesis file states on a line of its own, in its fence or front matter."""
    return F.regexp_extract(content, r"(?m)^cost_basis:\s*([^\n#]+)", 1).try_cast("double")


def with_value(content: Column, key: str, value: Column) -> Column:
    """The file with another value of a flat metadata key; what stands behind it, a comment, stays. Without the key nothing changes."""
    shown = F.regexp_replace(value.cast("string"), r"([\\$])", r"\\$1")
    return F.regexp_replace(content, F.lit(rf"(?m)^({key}:[ \t]*)[^\n#]*?([ \t]*(?:#[^\n]*)?)$"), F.concat(F.lit("$1"), shown, F.lit("$2")))


def with_scores(content: Column, components: Column, overall: Column) -> Column:
    """The file with other rows in its table of health components, and another score in the metadata. components: structs of name, weight, score, notes."""
    rows = F.array_join(F.transform(components, lambda c: F.concat(F.lit("| "), c["name"], F.lit(" | "), c["weight"].cast("string"), F.lit("% | "), c["score"].cast("string"), F.lit("/100 | "), F.coalesce(c["notes"], F.lit("")), F.lit(" |"))), "\n")
    safe = F.regexp_replace(rows, r"([\\$])", r"\\$1")
    table = F.regexp_replace(content, F.lit(r"(?m)(^#+ *Thesis Health[^\n]*\n\s*^\|[^\n]*\n\|[ :|-]*\n)(?:\|[^\n]*\n)*"), F.concat(F.lit("$1"), safe, F.lit("\n")))
    return with_value(table, "health_score", overall)


def stock_view(theses: DataFrame, covered: DataFrame, fundamentals: DataFrame, hurdles: DataFrame, lens: DataFrame) -> DataFrame:
    """One row per thesis: coverage, fundamentals, the regime's hurdle and the places of the lens's hits by dimension; all but the first NULL where nothing is indexed.

    covered: thesis, indexed. fundamentals: thesis, pe, roe. hurdles: color, hurdle_pct. lens: thesis, dimension, node, rank.
    """
    views = lens.groupBy("thesis").agg(F.array_sort(F.collect_list(F.struct("dimension", "rank", "node"))).alias("views"))  # a few of each dimension
    j = theses.join(covered, "thesis", "left").join(fundamentals, "thesis", "left").join(hurdles, "color", "left").join(views, "thesis", "left")
    there = F.coalesce(F.col("indexed"), F.lit(0)) > 0
    return j.select("thesis", F.coalesce("indexed", F.lit(0)).alias("filings"), (~there).alias("empty"), *(F.when(there, F.col(c)).alias(c) for c in ("pe", "roe", "hurdle_pct", "views")))


def markdown_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows with line, their line of a Markdown table."""
    cells = [F.coalesce(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), F.lit("")) for c in columns]
    return rows.withColumn("line", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")))


def markdown_head(columns: list[str]) -> list[str]:
    return ["| " + " | ".join(columns) + " |", "| " + " | ".join(["---"] * len(columns)) + " |"]
