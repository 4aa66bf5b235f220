"""The queries of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_format, collocations, context_mixing, exact_dedup, lexical_search, packing, relative_lz, shingle_join, suffix_dedup, toxicity, url_filter, vector_join
from .common import table


def op1_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mixing.score(table(spark, sf_dir, "documents"), toxicity.remainder(F.col("doc_id"), 10) == 0)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), with_text=False, words=51)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), with_ids=False)


def op4_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.jaccard_components(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), with_ids=False)


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat_format.format_chats(table(spark, sf_dir, "conversations"))
    return out.select("conv_id", "turn", "item", "role", "kind", "call_id", "status", "linked_turn", "anchor", "depth", F.sha2("json", 256).alias("json_sha256"))


def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with calls and results, made of the table's, which has none: every fourth turn asks, calls a search, answers it, and calls with arguments missing."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn").where("conv_id IS NOT NULL AND turn IS NOT NULL").distinct()
    name = F.concat(F.lit("c"), F.col("turn").cast("string"))
    asked = F.when((F.col("conv_id") % 3 == 0) & (F.col("turn") >= 4), F.concat(F.lit("$c"), (F.col("turn") - 4).cast("string"))).otherwise(F.concat(F.lit("q"), F.col("conv_id").cast("string")))
    call = lambda tool, arguments: F.concat(F.lit('{"tool_calls": [{"name": "' + tool + '", "id": "'), name, F.lit('", "arguments": '), arguments, F.lit("}]}"))
    text = (
        F.when(F.col("turn") % 4 == 0, F.concat(F.lit("hello "), F.col("conv_id").cast("string")))
        .when(F.col("turn") % 4 == 1, call("search", F.concat(F.lit('{"query": "'), asked, F.lit('", "limit": 3}'))))
        .when(F.col("turn") % 4 == 2, F.concat(F.lit('{"tool_call_id": "'), F.when(F.col("conv_id") % 5 == 0, "zz").otherwise(F.concat(F.lit("c"), (F.col("turn") - 1).cast("string"))), F.lit('", "content": [1]}')))
        .otherwise(call("calculate", F.lit("{}")))
    )
    role = F.element_at(F.array(*map(F.lit, ("user", "assistant", "tool", "assistant"))), (F.col("turn") % 4 + 1).cast("int"))
    out = chat_format.format_chats(c.select("conv_id", "turn", role.alias("role"), text.alias("text")))
    return out.select("conv_id", "turn", "item", "role", "kind", "call_id", "status", "linked_turn", "anchor", "depth", F.sha2("json", 256).alias("json_sha256"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = toxicity.remainder(F.col("doc_id"), 3) == 1
    model = toxicity.fit(docs, labels, learn_from=~held_out)
    out = toxicity.score(docs, model)
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "threshold", "toxic")


def op9_vector_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_join.link_vectors(table(spark, sf_dir, "embeddings"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_filter.filter_urls(table(spark, sf_dir, "pages"))
    return out.select("page_id", "host", "path", "rule", "verdict")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_relative_lz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relative_lz.remove_earlier(table(spark, sf_dir, "documents"), with_text=False).drop("n_factors")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents")).drop("k")


# The table holds plain messages only: no tool calls, no results.
OP6_SQL = r"""
SELECT conv_id, turn, 0 AS item, role, 'message' AS kind, CAST(NULL AS VARCHAR) AS call_id, 'ok' AS status, CAST(NULL AS BIGINT) AS linked_turn,
  turn AS anchor, 0 AS depth, sha256(CAST(to_json(struct_pack(content := coalesce(text, ''), role := role)) AS VARCHAR)) AS json_sha256
FROM conversations
"""

TOOL_CALLS_SQL = r"""
WITH c AS (SELECT DISTINCT conv_id, turn, turn % 4 AS m FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
i AS (
  SELECT c.*, 0 AS item, 'user' AS role, 'message' AS kind, NULL AS call_id, 'ok' AS status, NULL AS linked_turn, turn AS anchor, 0 AS depth,
    '{"content":"hello ' || conv_id || '","role":"user"}' AS json FROM c WHERE m = 0
  UNION ALL SELECT c.*, 0, 'assistant', 'message', NULL, 'ok', NULL, turn, 0, '{"content":null,"role":"assistant"}' FROM c WHERE m IN (1, 3)
  UNION ALL SELECT c.*, 1, 'assistant', 'call', 'c' || c.turn, CASE WHEN c.conv_id % 5 > 0 AND n.turn IS NOT NULL THEN 'ok' ELSE 'unanswered' END, CASE WHEN c.conv_id % 5 > 0 THEN n.turn END, c.turn, 1,
    '{"arguments":{"limit":3,"query":"' || CASE WHEN c.conv_id % 3 = 0 AND c.turn >= 4 THEN '$c' || (c.turn - 4) ELSE 'q' || c.conv_id END || '"},"id":"c' || c.turn || '","name":"search","type":"call"}'
    FROM c LEFT JOIN c n ON n.conv_id = c.conv_id AND n.turn = c.turn + 1 WHERE c.m = 1
  UNION ALL SELECT c.*, 0, 'tool', 'result', CASE WHEN c.conv_id % 5 = 0 THEN 'zz' ELSE 'c' || (c.turn - 1) END, CASE WHEN c.conv_id % 5 > 0 AND b.turn IS NOT NULL THEN 'ok' ELSE 'orphan' END, CASE WHEN c.conv_id % 5 > 0 THEN b.turn END,
    CASE WHEN c.conv_id % 5 > 0 AND b.turn IS NOT NULL THEN b.turn ELSE c.turn END, CASE WHEN c.conv_id % 5 > 0 AND b.turn IS NOT NULL THEN 2 ELSE 0 END,
    '{"content":[1],"role":"tool","tool_call_id":"' || CASE WHEN c.conv_id % 5 = 0 THEN 'zz' ELSE 'c' || (c.turn - 1) END || '"}'
    FROM c LEFT JOIN c b ON b.conv_id = c.conv_id AND b.turn = c.turn - 1 WHERE c.m = 2
  UNION ALL SELECT c.*, 1, 'assistant', 'call', 'c' || turn, 'invalid: missing expression', NULL, turn, 1, '{"arguments":{},"id":"c' || turn || '","name":"calculate","type":"call"}' FROM c WHERE m = 3
)
SELECT conv_id, turn, item, role, kind, call_id, status, linked_turn, anchor, depth, sha256(json) AS json_sha256 FROM i
"""

OP7_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS cp, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), r AS (
  SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
    first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY cp DESC, doc_id) AS keep_id
  FROM n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r
"""

OP10_SQL = r"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), rules(verdict, h, p) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), m AS (
  SELECT u.*, r.*, row_number() OVER (PARTITION BY page_id ORDER BY length(h) + length(p) DESC NULLS LAST) AS k
  FROM u LEFT JOIN rules r ON (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p)
)
SELECT page_id, host, path, h || p AS rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""

OP9_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), r(a, c) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.a
), c AS (
  SELECT a AS vec_id, min(c) AS component_id FROM r GROUP BY a
)
SELECT c.vec_id, count(l.b) AS n_links, c.component_id, c.vec_id = c.component_id AS kept
FROM c LEFT JOIN l ON l.a = c.vec_id GROUP BY c.vec_id, c.component_id
"""

OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents
), s AS (
  SELECT CAST(count(*) AS BIGINT) AS nn, CAST(sum(len(t)) AS BIGINT) AS ll FROM d WHERE len(t) > 0
), p AS (
  SELECT doc_id, len(t) AS n, unnest(t) AS term FROM d
), tf AS (
  SELECT doc_id, n, term, count(*) AS tf FROM p GROUP BY ALL
), q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), w AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * nn + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, s GROUP BY term, nn
), r AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // ll)))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN tf USING (term), s GROUP BY item_id, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM r WHERE score > 0 QUALIFY rank <= 50
"""

OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, w, unnest(generate_series(1, len(w) - 19)) AS j FROM d WHERE len(w) >= 20
), f AS (
  SELECT doc_id, j, row_number() OVER (PARTITION BY array_to_string(w[j:j + 19], ' ') ORDER BY doc_id, j) > 1 AS again FROM s
), p AS (
  SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS j FROM d
), c AS (
  SELECT p.*, coalesce(bool_or(coalesce(again, false)) OVER (PARTITION BY p.doc_id ORDER BY p.j ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), false) AS gone FROM p LEFT JOIN f ON f.doc_id = p.doc_id AND f.j = p.j
), k AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY j) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""

OP13_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), words AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), grams AS (
  SELECT lang, k, unnest(list_transform(generate_series(1, len(w) - k + 1), lambda i : array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM words, (VALUES (1), (2), (3)) d(k) WHERE len(w) >= k
), f AS (
  SELECT lang, k, phrase, CAST(count(*) AS HUGEINT) AS n FROM grams GROUP BY ALL
), totals AS (
  SELECT lang, sum(n) AS total FROM f WHERE k = 1 GROUP BY lang
), c AS (
  SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND n >= 10
), parts AS (
  SELECT lang, k, phrase, n, cut_at, array_to_string(w[1:cut_at], ' ') AS head, array_to_string(w[cut_at + 1:], ' ') AS rest FROM c, (VALUES (1), (2)) d(cut_at) WHERE cut_at < k
), cuts AS (
  SELECT c.lang, c.k, c.phrase, c.n AS a, cut_at, x.n AS l, y.n AS r, (1000000 * c.n * c.n) // (x.n * y.n) AS score
  FROM parts c JOIN f x ON x.lang = c.lang AND x.phrase = head JOIN f y ON y.lang = c.lang AND y.phrase = rest
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut_at) = 1
), held AS (
  SELECT c.lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, n FROM c WHERE k = 3
), longest AS (
  SELECT lang, phrase, max(n) AS longest FROM held GROUP BY ALL
), kept AS (
  SELECT b.* FROM best b LEFT JOIN longest USING (lang, phrase) WHERE b.k = 3 OR longest IS NULL OR 100 * longest < 50 * b.a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
  CAST(total AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_context_mixing": op1_context_mixing,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_bpe": op3_bpe,
    "op4_shingle_join": op4_shingle_join,
    "op5_packing": op5_packing,
    "op6_chat_format": op6_chat_format,
    "tool_calls": tool_calls,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_vector_join": op9_vector_join,
    "op10_url_filter": op10_url_filter,
    "op11_lexical_search": op11_lexical_search,
    "op12_relative_lz": op12_relative_lz,
    "op13_collocations": op13_collocations,
}
ORACLE_SQL: dict[str, str] = {"op6_chat_format": OP6_SQL, "tool_calls": TOOL_CALLS_SQL, "op7_exact_dedup": OP7_SQL, "op9_vector_join": OP9_SQL, "op10_url_filter": OP10_SQL, "op11_lexical_search": OP11_SQL, "op12_relative_lz": OP12_SQL, "op13_collocations": OP13_SQL}
