"""Queries of full-text search, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import search
from ..sources import scratch, tables
from .bindings import view
from .registry import query

STOP = ", ".join(f"'{w}'" for w in search.STOP_WORDS)


def toks(text: str) -> str:
    stem = "CASE WHEN length(w) > 4 AND ends_with(w, 'ing') AND length(w) >= 6 THEN left(w, length(w) - 3) WHEN length(w) > 4 AND ends_with(w, 'ed') AND length(w) >= 5 THEN left(w, length(w) - 2) WHEN length(w) > 4 AND ends_with(w, 'es') AND length(w) >= 5 THEN left(w, length(w) - 2) WHEN length(w) > 4 AND ends_with(w, 's') THEN left(w, length(w) - 1) ELSE w END"
    return f"list_transform(list_filter(list_transform(regexp_extract_all(coalesce({text}, ''), '[A-Za-z][A-Za-z0-9\\-]*'), lambda w : lower(w)), lambda w : length(w) > 1 AND w NOT IN ({STOP})), lambda w : {stem})"


QS = "qs AS (SELECT item_id AS query_id, array_to_string(list_slice(string_split(replace(text, chr(10), ' '), ' '), 1, 4), ' ') AS query FROM benchmark)"
MIXED_QS = "qs AS (SELECT item_id AS query_id, array_to_string(list_slice(string_split(replace(text, chr(10), ' '), ' '), 1, 4), ' ') || CASE WHEN item_id % 2 = 0 THEN ' balance sheet' ELSE '' END AS query FROM benchmark)"
_RANKING = f"""
qt AS (SELECT DISTINCT query_id, unnest({toks('query')}) AS term FROM qs),
fs AS (SELECT node, 'title' AS field, 5.0 AS w, {toks('title')} AS t FROM nodes UNION ALL SELECT node, 'questions', 4.0, {toks('questions')} FROM nodes UNION ALL SELECT node, 'summary', 3.0, {toks('summary')} FROM nodes UNION ALL SELECT node, 'text', 1.0, {toks('text')} FROM nodes),
ml AS (SELECT field, CASE WHEN avg(len(t)) = 0 THEN 1.0 ELSE avg(len(t)) END AS mean FROM fs GROUP BY field),
oc AS (SELECT node, field, w, size, term, count(*) AS tf FROM (SELECT node, field, w, len(t) AS size, unnest(t) AS term FROM fs) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
df AS (SELECT term, count(DISTINCT node) AS df, ln(((SELECT count(DISTINCT node) FROM fs) - count(DISTINCT node) + 0.5) / (count(DISTINCT node) + 0.5) + 1) AS idf FROM oc GROUP BY term),
wt AS (SELECT node, term, sum(w * tf / (0.25 + 0.75 * (size / mean))) AS wtf FROM oc JOIN ml ON oc.field = ml.field GROUP BY 1, 2),
sc AS (SELECT query_id, node, sum(idf * wtf * 2.5 / (wtf + 1.5)) AS s FROM wt JOIN df ON wt.term = df.term JOIN qt ON qt.term = wt.term GROUP BY 1, 2),
ph AS (SELECT sc.query_id, sc.node, (CASE WHEN contains(lower(title), lower(trim(query))) THEN 2.5 ELSE 0 END + CASE WHEN contains(lower(questions), lower(trim(query))) THEN 2.0 ELSE 0 END + CASE WHEN contains(lower(summary), lower(trim(query))) THEN 1.5 ELSE 0 END + CASE WHEN contains(lower(text), lower(trim(query))) THEN 0.5 ELSE 0 END) * (SELECT max(idf) FROM qt JOIN df ON qt.term = df.term WHERE qt.query_id = sc.query_id) AS bonus
  FROM sc JOIN qs ON qs.query_id = sc.query_id JOIN nodes ON nodes.node = sc.node),
hits AS (SELECT sc.query_id, sc.node, floor((s + bonus) * 1000 + 0.5) / 1000 AS score FROM sc JOIN ph ON sc.query_id = ph.query_id AND sc.node = ph.node),
rk AS (SELECT h.*, n.ticker, n.label, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, n.ticker DESC, h.node) - 1 AS rank FROM hits h JOIN nodes n ON n.node = h.node),
gd AS (SELECT q.query_id, list(DISTINCT n.label) AS expected FROM (SELECT item_id AS query_id, text FROM benchmark) q JOIN nodes n ON contains(n.text, q.text) GROUP BY 1)
"""


def search_sql(asked: str) -> str:
    """The CTEs of ranking for the queries of a CTE `qs`."""
    return f"{asked}, {_RANKING}"


SEARCH_SQL = search_sql(QS)



def nodes(spark, d):
    return view(spark, d, "nodes")


def texts(spark, d):
    """The nodes, dealt out to tasks: tokenising costs more than the shuffle of the texts."""
    return tables.spread(nodes(spark, d), "node")


def asked(spark, d):
    return tables.read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(F.slice(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " "), 1, 4), " ").alias("query"))


def index(spark, d, queries=None, name="asked"):
    """The index of what a batch of queries asks for, those of the benchmark if none are given, written once for an application and a folder of tables."""
    queries = asked(spark, d) if queries is None else queries
    return search.batch_index(texts(spark, d), queries, lambda table, rows: scratch.stored(spark, (f"{name}-{table}", d), lambda: rows))


def best(spark, d, k, only=None):
    """The k best hits of each query."""
    n = nodes(spark, d)
    return search.top_hits(hits(spark, d), n if only is None else n.where(only), k)


def hits(spark, d, **more):
    return search.scores(texts(spark, d), asked(spark, d), index=index(spark, d), **more)


def statistics(spark, d):
    return search.frequencies(texts(spark, d), search.query_terms(asked(spark, d)))


def gold(spark, d):
    b = tables.read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"))
    n = nodes(spark, d)
    return search.holding(texts(spark, d), b).join(n.select("node", "label"), "node").groupBy("query_id").agg(F.collect_set("label").alias("expected"))


query("str01_tokens", f"SELECT node, {toks('summary')} AS toks FROM nodes")(lambda spark, d: nodes(spark, d).select("node", search.tokens(F.col("summary")).alias("toks")))
query("str02_stems", f"SELECT DISTINCT unnest({toks('text')}) AS word FROM nodes")(lambda spark, d: nodes(spark, d).select(F.explode(search.tokens(F.col("text"))).alias("word")).distinct())
query("str03_snippet", "SELECT node, CASE WHEN spot = 0 THEN CASE WHEN length(text) > 240 THEN left(text, 240) || '…' ELSE text END ELSE CASE WHEN greatest(1, spot - 120) > 1 THEN '…' ELSE '' END || trim(substr(text, greatest(1, spot - 120), least(length(text) + 1, spot + 120) - greatest(1, spot - 120)), ' ') || CASE WHEN spot + 120 <= length(text) THEN '…' ELSE '' END END AS snippet FROM (SELECT node, text, instr(' ' || lower(replace(text, chr(10), ' ')), ' thand') AS spot FROM nodes)")(
    lambda spark, d: nodes(spark, d).select("node", search.snippet(F.col("text"), F.array(F.lit("thand"))).alias("snippet"))
)
query("str04_citation", "SELECT node, ticker || ' ' || form || ' filed 2024-01-31 → ' || label AS citation FROM nodes")(lambda spark, d: nodes(spark, d).select("node", scalar.citation(F.col("ticker"), F.col("form"), F.to_date(F.lit("2024-01-31")), F.col("label")).alias("citation")))
query("str05_intent", f"SELECT thesis, CASE WHEN number % {len(search.STATEMENT_PHRASES) + 3} < {len(search.STATEMENT_PHRASES)} THEN 'financial_statements' END AS label FROM theses")(
    lambda spark, d: view(spark, d, "theses").select("thesis", search.structural_label(F.concat_ws(" ", "bucket", F.lit("What of"), F.upper(F.element_at(F.array(*map(F.lit, (*search.STATEMENT_PHRASES, "risks", "balance of sheets", "cash"))), (F.col("number") % (len(search.STATEMENT_PHRASES) + 3) + 1).cast("int"))), "thesis")).alias("label"))
)
query("agg14_document_frequency", f"WITH {SEARCH_SQL} SELECT term, df FROM df")(lambda spark, d: statistics(spark, d).select("term", "df"))
query("agg14_field_means", f"WITH {SEARCH_SQL} SELECT field, floor(mean * 1e6 + 0.5) / 1e6 AS mean FROM ml")(lambda spark, d: search.field_sizes(texts(spark, d)).select("field", scalar.r6(F.col("mean")).alias("mean")))
query("agg16_idf", f"WITH {SEARCH_SQL} SELECT term, floor(idf * 1e6 + 0.5) / 1e6 AS idf FROM df")(lambda spark, d: statistics(spark, d).select("term", scalar.r6(F.col("idf")).alias("idf")))
query("agg15_bm25f", f"WITH {SEARCH_SQL} SELECT query_id, node, floor(s * 1000 + 0.5) / 1000 AS score FROM sc")(lambda spark, d: hits(spark, d, with_phrase=False))
query("agg17_phrase_bonus", f"WITH {SEARCH_SQL} SELECT query_id, node, score FROM hits")(lambda spark, d: hits(spark, d))
query("top01_hits", f"WITH {SEARCH_SQL} SELECT query_id, node, score, rank FROM rk WHERE rank < 10")(lambda spark, d: best(spark, d, 10).select("query_id", "node", "score", "rank"))


def mixed_queries(spark, d):
    q = asked(spark, d)
    return q.withColumn("query", F.when(F.col("query_id") % 2 == 0, F.concat("query", F.lit(" balance sheet"))).otherwise(F.col("query")))


def no_statements(spark, d):
    n = nodes(spark, d)
    h = search.scores(texts(spark, d), mixed_queries(spark, d), index=index(spark, d, mixed_queries(spark, d), "mixed"))
    return h.join(n.where("label <> 'financial_statements'").select("node"), "node", "left_semi"), n, mixed_queries(spark, d)


query("top03_fusion", f"WITH {SEARCH_SQL}, rl AS (SELECT query_id, node, rank, score, 1.0 AS weight FROM rk WHERE rank < 20 UNION ALL SELECT query_id, node, 19 - rank, score, 0.7 FROM rk WHERE rank < 20) SELECT query_id, node, floor(sum(weight / (61 + rank)) * 1e9 + 0.5) / 1e9 AS fused, max(score) AS score FROM rl GROUP BY 1, 2")(
    lambda spark, d: (lambda t: search.fuse(t.withColumn("weight", F.lit(1.0)).unionByName(t.withColumn("rank", 19 - F.col("rank")).withColumn("weight", F.lit(0.7)))).withColumn("fused", F.floor(F.col("fused") * 1e9 + 0.5) / 1e9))(best(spark, d, 20).select("query_id", "node", "rank", "score"))
)
query("top08_lens", f"WITH {SEARCH_SQL} SELECT query_id, node, place AS rank FROM (SELECT query_id, node, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ticker DESC, node) - 1 AS place FROM rk WHERE label IN ('business', 'mdna')) WHERE place < 4")(
    lambda spark, d: best(spark, d, 4, "label IN ('business', 'mdna')").select("query_id", "node", "rank")
)
query("agg18_evaluation", f"WITH {SEARCH_SQL}, fr AS (SELECT gd.query_id, min(rank) AS rank FROM gd LEFT JOIN rk ON rk.query_id = gd.query_id AND rk.rank < 5 AND list_contains(expected, label) GROUP BY 1) SELECT count(*) AS queries, floor(avg(CASE WHEN rank IS NULL THEN 0.0 ELSE 1.0 END) * 1e6 + 0.5) / 1e6 AS hit_rate, floor(avg(coalesce(1.0 / (rank + 1), 0)) * 1e6 + 0.5) / 1e6 AS mrr FROM fr")(
    lambda spark, d: search.evaluate(best(spark, d, 5), gold(spark, d)).select("queries", scalar.r6(F.col("hit_rate")).alias("hit_rate"), scalar.r6(F.col("mrr")).alias("mrr"))
)
query("jn09_chosen_paths", "SELECT CAST(number AS BIGINT) AS node, number % 5 AS pos FROM theses WHERE number IN (SELECT node FROM nodes)")(
    lambda spark, d: (lambda t: search.pick_by_path(nodes(spark, d).select("node", F.col("accession").alias("path")), F.col("chosen"), t).select("node", F.col("pos").cast("bigint").alias("pos")))(view(spark, d, "theses").groupBy((F.col("number") - F.col("number") % 5).alias("g")).agg(F.transform(F.array_sort(F.collect_list("number")), lambda x: F.concat(F.lit(" "), x.cast("string"))).alias("chosen")))
)
query("agg20_token_estimate", "SELECT ticker, CAST(sum(length(text)) // 4 AS BIGINT) AS tokens FROM nodes GROUP BY ticker")(lambda spark, d: nodes(spark, d).groupBy("ticker").agg((F.floor(F.sum(F.length("text")) / 4)).alias("tokens")))


def filings(spark, d):
    n = nodes(spark, d)
    chunk = lambda i: F.struct(i.alias("chunk_index"), F.col("text").substr(1 + 500 * i, F.lit(500)).alias("text"), F.concat(F.lit("chunk "), i.cast("string")).alias("summary"))
    chunks = F.when(F.length("text") > 1000, F.transform(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / 500).cast("int")), chunk)).otherwise(F.array().cast("array<struct<chunk_index:int,text:string,summary:string>>"))
    section = F.struct("label", "title", "text", "summary", F.array(F.lit("growth"), F.col("label")).alias("themes"), F.array(F.lit("what is it")).alias("questions"), chunks.alias("chunks"))
    return n.groupBy("ticker", "accession").agg(F.collect_list(section).alias("sections"))


query("sec10_flatten", "SELECT accession, i AS chunk, label, CASE WHEN i IS NULL THEN summary ELSE 'chunk ' || CAST(i AS VARCHAR) END || ' growth ' || label AS summary, CASE WHEN i IS NULL THEN text ELSE substr(text, 1 + 500 * i, 500) END AS text FROM (SELECT *, unnest(CASE WHEN length(text) > 1000 THEN range(0, (length(text) + 499) // 500) ELSE [NULL] END) AS i FROM nodes)")(lambda spark, d: search.flatten_filings(filings(spark, d)).select("accession", "chunk", "label", "summary", "text"))
query("sec11_weak_queries", f"WITH {SEARCH_SQL} SELECT query_id, max(score) < 3.0 AS weak FROM hits GROUP BY 1")(lambda spark, d: hits(spark, d).groupBy("query_id").agg((F.max("score") < 3.0).alias("weak")))
query("sec12_paraphrases", "SELECT thesis, list_filter(['growth of ' || thesis, CASE WHEN number % 2 = 0 THEN bucket || ' ' || status END, CASE WHEN number % 3 = 0 THEN repeat('x', 399) END], lambda x : x IS NOT NULL) AS kept FROM theses")(lambda spark, d: view(spark, d, "theses").select("thesis", search.clean_paraphrases(F.array(F.concat(F.element_at(F.array(*map(F.lit, ("- 1. ", "* ", "• 23. ", ""))), (F.col("number") % 4 + 1).cast("int")), F.lit("growth of "), "thesis"), F.lit("*  "), F.when(F.col("number") % 2 == 0, F.concat_ws(" ", "bucket", "status")).otherwise(F.upper("bucket")), F.when(F.col("number") % 3 == 0, F.repeat(F.lit("x"), F.lit(399))).otherwise(F.repeat(F.lit("x"), F.lit(400)))), F.col("bucket")).alias("kept")))
