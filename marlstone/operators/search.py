"""Field-weighted full-text ranking over a batch of queries, rank fusion, structural promotion, evaluation.

Nodes are tokenised once, into an inverted table (term, node, field, tf, size). What a term weighs in a node, over all fields, does not depend on the query, so these weights are stored too, in
blocks of nodes with the largest weight of each term beside them: the k best of a query are found without scoring blocks that cannot hold one. Phrases are looked up in a table of
words with their places and neighbours. All tables can be stored, sorted by term. Query tables are small by nature, but nothing here needs that: the terms are joined, and Spark broadcasts them if
they are small enough. Where one batch of queries is all that is asked, an index of its terms alone is made (`batch_index`), in one pass over the texts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from ..sources.tables import spread

# Words that are no search terms.
STOP_WORDS = ["a", "an", "the", "and", "or", "but", "if", "then", "so", "as", "at", "by", "for", "from", "in", "into", "of", "on", "to", "with", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "this", "that", "these", "those", "it", "its", "which", "who", "whom", "what", "when", "where", "why", "how", "about", "against"]
# Weights of the fields, and the parameters of the score and of rank fusion.
FIELDS = {"title": 5.0, "questions": 4.0, "summary": 3.0, "text": 1.0}
K1, B, RRF_K = 1.5, 0.75, 60
# Phrases that ask for the financial statements.
STATEMENT_PHRASES = ["cash flow statement", "statement of cash flows", "balance sheet", "consolidated balance sheet", "income statement", "statement of operations", "statement of stockholders equity", "statement of stockholders' equity", "capital expenditure", "capital expenditures", "capex", "ppne", "pp&e", "property, plant and equipment", "property plant and equipment", "net ppne", "net pp&e"]


def stem(word: Column) -> Column:
    """Without ing, ed, es or s, the first that fits, where at least three letters stay and the word has over four."""
    out = word
    for suffix in ("s", "es", "ed", "ing"):
        fits = word.endswith(suffix) & (F.length(word) - len(suffix) >= 3)
        out = F.when(fits, word.substr(F.lit(1), F.length(word) - len(suffix))).otherwise(out)
    return F.when(F.length(word) > 4, out).otherwise(word)


def raw_words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([A-Za-z][A-Za-z0-9\-]*)"), 1)


def tokens(text: Column) -> Column:
    words = F.transform(raw_words(text), F.lower)
    kept = F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*STOP_WORDS))
    return F.transform(kept, stem)


def query_terms(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("query")))).alias("term"))


@dataclass(frozen=True)
class Index:
    """postings: term, node, field, tf, size. sizes: field, n (nodes), mean (tokens; 1 if there are none). terms: term, df, idf. weights: term, block, node, wtf. bounds: term, block, top.

    places: word, node, field, pos, before, after, of all pieces between single spaces, lower-cased. An index for a batch of queries has only the terms that they ask for, its weights are dealt out by node, and it has no postings, bounds or places.
    """

    postings: DataFrame | None
    sizes: DataFrame
    terms: DataFrame
    weights: DataFrame
    bounds: DataFrame | None
    places: DataFrame | None


#: Nodes of a block, about; blocks of a query that are scored first.
BLOCK, PROBED = 16, 8


def field_tokens(nodes: DataFrame) -> DataFrame:
    """node, field, toks: one row per node and field."""
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("body")) for f in FIELDS)))
    return nodes.select("node", each.alias("f")).select("node", "f.field", tokens(F.col("f.body")).alias("toks"))


def postings(nodes: DataFrame) -> DataFrame:
    """Every term of every field with its count."""
    words = field_tokens(nodes).select("node", "field", F.size("toks").alias("size"), F.explode("toks").alias("term"))
    return words.groupBy("term", "node", "field", "size").agg(F.count("*").alias("tf")).select("term", "node", "field", "tf", "size")


def field_words(nodes: DataFrame) -> DataFrame:
    """node, field, word: a row for each of a field's tokens, and some whose word is NULL, one for each field at least.

    The same words as of `tokens`, but a row each from the start: functions over arrays are interpreted, expressions of rows are compiled.
    """
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("body")) for f in FIELDS)))
    words = nodes.select("node", each.alias("f")).select("node", "f.field", F.explode_outer(raw_words(F.col("f.body"))).alias("w")).select("node", "field", F.lower("w").alias("w"))
    return words.select("node", "field", F.when((F.length("w") > 1) & ~F.col("w").isin(*STOP_WORDS), stem(F.col("w"))).alias("word"))


def counted(nodes: DataFrame, terms: DataFrame) -> DataFrame:
    """node, the size of each of its fields, found: (term, its count in each field) of the terms (term) that it has. Told in one pass; where nodes are dealt out by node, nothing is shuffled."""
    asked = terms.select("term").distinct()
    words = field_words(nodes).join(asked, F.col("word") == F.col("term"), "left")
    counts = words.groupBy("node", "term").agg(*(F.count(F.when(F.col("field") == f, F.col("word"))).alias(f) for f in FIELDS))
    found = F.collect_list(F.when(F.col("term").isNotNull(), F.struct("term", *FIELDS)))  # at most one for each term of the batch
    return counts.groupBy("node").agg(*(F.sum(f).alias(f) for f in FIELDS), found.alias("found"))


def frequencies(nodes: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, df, idf) of the terms asked for that occur, without an index."""
    has = field_words(nodes).join(terms.select(F.col("term").alias("word")).distinct(), "word", "left_semi").select(F.col("word").alias("term"), "node")
    return term_table(has, nodes.agg(F.count_distinct("node").alias("n")))


def batch_index(nodes: DataFrame, queries: DataFrame, keep: Callable[[str, DataFrame], DataFrame] = lambda _, table: table) -> Index:
    """An index of what a batch of queries asks for: texts are read once, and a row is kept for each node."""
    found = keep("found", counted(nodes, query_terms(queries)))
    totals = found.agg(F.count("*").alias("n"), *(F.sum(f).alias(f) for f in FIELDS)).where("n > 0")
    sizes = keep("sizes", totals.select("n", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("total")) for f in FIELDS))).alias("f")).select("f.field", "n", mean_size(F.col("f.total"), F.col("n")).alias("mean")))
    df = found.select(F.explode("found.term").alias("term")).groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(sizes.agg(F.max("n").alias("n"))))  # one row
    terms = keep("terms", df.select("term", "df", inverse_frequency(F.col("n"), F.col("df")).alias("idf")))
    means = sizes.agg(F.max("n").alias("n"), *(F.max(F.when(F.col("field") == f, F.col("mean"))).alias(f"mean_{f}") for f in FIELDS))
    each = spread(found, "node").crossJoin(F.broadcast(means)).select("node", "n", *FIELDS, *(f"mean_{f}" for f in FIELDS), F.explode("found").alias("t"))  # means: one row
    wtf = sum((w * F.col(f"t.{f}") / (1 - B + B * (F.col(f) / F.col(f"mean_{f}"))) for f, w in FIELDS.items()), F.lit(0.0))
    return Index(None, sizes, terms, each.select("t.term", block_of().alias("block"), "node", wtf.alias("wtf")), None, None)


def mean_size(total: Column, n: Column) -> Column:
    return F.when(total == 0, 1.0).otherwise(total / n)


def field_sizes(nodes: DataFrame) -> DataFrame:
    n = nodes.agg(F.count("*").alias("n"))
    totals = field_words(nodes).groupBy("field").agg(F.count("word").alias("total")).crossJoin(F.broadcast(n))  # one row
    return totals.select("field", "n", mean_size(F.col("total"), F.col("n")).alias("mean"))


def term_table(found: DataFrame, sizes: DataFrame) -> DataFrame:
    """(term, df, idf) of postings."""
    n = sizes.agg(F.max("n").alias("n"))
    df = found.groupBy("term").agg(F.count_distinct("node").alias("df")).crossJoin(F.broadcast(n))  # n: one row
    return df.select("term", "df", inverse_frequency(F.col("n"), F.col("df")).alias("idf"))


def term_weights(found: DataFrame, sizes: DataFrame) -> DataFrame:
    """What each term weighs in each node, over its fields."""
    weight = F.element_at(F.create_map(*[F.lit(x) for p in FIELDS.items() for x in p]), F.col("field"))
    part = weight * F.col("tf") / (1 - B + B * (F.col("size") / F.col("mean")))
    by_node = found.join(F.broadcast(sizes), "field").groupBy("term", "node").agg(F.sum(part).alias("wtf"), F.max("n").alias("n"))  # sizes: one row per field
    return by_node.select("term", block_of().alias("block"), "node", "wtf")


def block_of() -> Column:
    """The block of a node among n."""
    return F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / BLOCK))


def term_bounds(weights: DataFrame) -> DataFrame:
    return weights.groupBy("term", "block").agg(F.max("wtf").alias("top"))


def word_places(nodes: DataFrame) -> DataFrame:
    """Every piece between single spaces of every field, with its neighbours."""
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.split(F.lower(F.coalesce(F.col(f), F.lit(""))), " ").alias("w")) for f in FIELDS)))
    words = nodes.select("node", each.alias("f")).select("node", "f.field", F.col("f.w").alias("w"), F.posexplode("f.w").alias("pos", "word"))
    return words.select("word", "node", "field", "pos", F.get("w", F.col("pos") - 1).alias("before"), F.get("w", F.col("pos") + 1).alias("after"))


def index_of(nodes: DataFrame, keep: Callable[[str, DataFrame], DataFrame] = lambda _, table: table) -> Index:
    """The index of nodes. keep(name, table): each table as it will be used, such as written and read again."""
    found, sizes = keep("postings", by_term(postings(nodes))), keep("sizes", field_sizes(nodes))
    weights = keep("weights", term_weights(found, sizes).sortWithinPartitions("term", "block"))
    return Index(found, sizes, keep("terms", term_table(found, sizes)), weights, keep("bounds", term_bounds(weights)), keep("places", word_places(nodes).sortWithinPartitions("word")))


def by_term(table: DataFrame) -> DataFrame:
    """The postings as they should be stored."""
    return table.sortWithinPartitions("term", "node")


def inverse_frequency(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def statistics(index: Index, terms: DataFrame) -> DataFrame:
    """(term, df, idf) of the terms asked for that occur."""
    return index.terms.join(terms.select("term").distinct(), "term", "left_semi")


def _saturated(wtf: Column) -> Column:
    return F.col("idf") * wtf * (K1 + 1) / (wtf + K1)


def rounded(score: Column) -> Column:
    return F.floor(score * 1000 + 0.5) / 1000


def scores(nodes: DataFrame, queries: DataFrame, with_phrase: bool = True, index: Index | None = None, blocks: DataFrame | None = None, held: DataFrame | None = None) -> DataFrame:
    """query_id, node, score of the nodes a query hits, to three digits. index: that of the nodes, held: the held phrases, if they are at hand. blocks: (query_id, block) to which to keep."""
    index = index or index_of(nodes)
    terms = query_terms(queries).join(index.terms, "term")
    if index.places is None:
        return _batch_scores(nodes, queries, terms, index, with_phrase).select("query_id", "node", rounded(F.col("score")).alias("score")).where("score > 0")
    asked = terms if blocks is None else terms.join(blocks, "query_id")
    # Dealt out by node before they multiply by the queries that ask for them: sums by query and node, and joins by node, need no other shuffle.
    weights = spread(index.weights, "node") if blocks is None else index.weights
    hit = weights.join(asked, ["term"] if blocks is None else ["term", "block"])
    total = hit.groupBy("query_id", "node").agg(F.sum(_saturated(F.col("wtf"))).alias("score"))
    if with_phrase:
        bonus = phrase_bonus(nodes, queries, terms, total, held_phrases(queries, terms, index) if held is None else held)
        total = total.join(bonus, ["query_id", "node"], "left").withColumn("score", F.col("score") + F.coalesce("bonus", F.lit(0.0)))
    return total.select("query_id", "node", rounded(F.col("score")).alias("score")).where("score > 0")


def _lowers_to_ascii(text: Column) -> Column:
    """Whether a text has one of the two characters outside ASCII whose lower case begins with one of ASCII: there, words of the lower-cased text may be others than those of the text."""
    return F.contains(text, F.lit("\u212a")) | F.contains(text, F.lit("\u0130"))


def _batch_scores(nodes: DataFrame, queries: DataFrame, terms: DataFrame, index: Index, with_phrase: bool) -> DataFrame:
    """query_id, node, score (not rounded) by the index of a batch of queries.

    A text that holds a phrase has all terms of its inner words: only the texts of such hits are looked into.
    """
    # Written, so that their sizes are known: small tables are broadcast, and weights and hits stay dealt out by node.
    if not with_phrase:
        return index.weights.join(written(terms, "asked-terms"), "term").groupBy("query_id", "node").agg(F.sum(_saturated(F.col("wtf"))).alias("score"))
    inner = F.when(_lowers_to_ascii(F.col("query")), F.array().cast("array<string>")).otherwise(F.array_distinct(tokens(inner_words(F.col("query")))))
    inner = queries.select("query_id", inner.alias("inner"))
    asked = terms.join(inner, "query_id").select("query_id", "term", "idf", F.array_contains("inner", F.col("term")).alias("is_inner"))
    hit = index.weights.join(written(asked, "asked-terms"), "term").groupBy("query_id", "node").agg(F.sum(_saturated(F.col("wtf"))).alias("score"), F.count_if("is_inner").alias("had"))
    phrases = _phrases(queries, terms).join(inner, "query_id").select("query_id", "phrase", "rarest", F.size("inner").alias("needed"))
    hit = hit.join(written(phrases, "asked-phrases"), "query_id", "left")
    odd = F.greatest(*(F.coalesce(_lowers_to_ascii(F.col(f)), F.lit(False)) for f in FIELDS))
    texts = nodes.select(F.col("node").alias("_node"), *(F.lower(F.coalesce(f, F.lit(""))).alias(f) for f in FIELDS), odd.alias("odd"))
    j = hit.join(texts, (F.col("node") == F.col("_node")) & F.col("phrase").isNotNull() & ((F.col("had") == F.col("needed")) | F.col("odd")), "left")
    total = sum((F.when(F.contains(f, F.col("phrase")), w * 0.5).otherwise(0.0) for f, w in FIELDS.items()), F.lit(0.0))
    return j.select("query_id", "node", (F.col("score") + F.coalesce(total * F.col("rarest"), F.lit(0.0))).alias("score"))


def best_scores(nodes: DataFrame, queries: DataFrame, k: int, index: Index, only: DataFrame | None = None) -> DataFrame:
    """The scores of the k best nodes of each query at least, of `only` (node) if given: blocks that cannot hold one of them are not scored.

    The most that a block can give to a query is the sum of its terms' largest weights there, and the largest bonus for the phrase. The k-th best of the blocks that can give most is what any
    other block must reach.
    """
    terms = query_terms(queries).join(index.terms, "term")
    held = written(held_phrases(queries, terms, index), "held-phrases")
    n = index.sizes.agg(F.max("n").alias("n"))
    bonus = held.crossJoin(F.broadcast(n)).groupBy("query_id", block_of().alias("block")).agg(F.max("bonus").alias("bonus"))  # n: one row
    unknown = _phrases(queries, terms).where(F.size("p") <= 2).select("query_id", (0.5 * sum(FIELDS.values()) * F.col("rarest")).alias("unknown"))
    most = index.bounds.join(terms, "term").groupBy("query_id", "block").agg(F.sum(_saturated(F.col("top"))).alias("most"))
    most = most.join(bonus, ["query_id", "block"], "left").join(unknown, "query_id", "left")
    most = written(most.select("query_id", "block", rounded(F.col("most") + F.coalesce("bonus", "unknown", F.lit(0.0)) + 1e-6).alias("bound")), "bounds-of-blocks")
    first = best_of_each(most, ["query_id"], [F.desc("bound"), F.col("block")], PROBED).select("query_id", "block")
    kept = lambda rows: rows if only is None else rows.join(only, "node", "left_semi")
    probed = best_of_each(kept(scores(nodes, queries, index=index, blocks=first, held=held)), ["query_id"], [F.desc("score")], k)
    bar = probed.where(F.col("rank") == k - 1).select("query_id", F.col("score").alias("bar"))
    open_ = most.join(bar, "query_id", "left").where("bar IS NULL OR bound >= bar").select("query_id", "block")
    return kept(scores(nodes, queries, index=index, blocks=open_, held=held))


def inner_words(query: Column) -> Column:
    """A phrase without its first and last word: where it stands in a text, these may be parts of words, the others are words."""
    return F.regexp_replace(F.trim(query), r"^\S+|\S+$", "")


def _phrases(queries: DataFrame, weighted_terms: DataFrame) -> DataFrame:
    """query_id, phrase, p (its pieces between spaces), rarest (its rarest term's idf) of the queries of two words or more."""
    rarest = weighted_terms.groupBy("query_id").agg(F.max("idf").alias("rarest")).where("rarest > 0")
    phrase = F.lower(F.trim("query"))
    return queries.select("query_id", phrase.alias("phrase")).where(F.size(F.split("phrase", r"\s+")) >= 2).join(rarest, "query_id").withColumn("p", F.split("phrase", " "))


def held_phrases(queries: DataFrame, weighted_terms: DataFrame, index: Index) -> DataFrame:
    """query_id, node, bonus of the nodes that hold a query of three pieces or more verbatim: half a field's weight times the rarest term's idf for each field.

    A text holds a phrase where its inner pieces stand in a row, a piece that ends with its first one before and one that begins with its last one after them. Inner pieces are looked up
    with an inner neighbour, so common words alone bring no rows.
    """
    # Written, so that its size is known: a small table is broadcast, and the places are not shuffled.
    inner = _phrases(queries, weighted_terms).where(F.size("p") > 2).select("query_id", "rarest", "p", F.size("p").alias("m"), F.posexplode("p").alias("j", "word")).where("j > 0 AND j < m - 1")
    inner = written(inner, "inner-pieces")
    piece = lambda step: F.get("p", F.col("j") + step)
    head, tail = F.endswith("before", piece(-1)), F.startswith("after", piece(1))
    single = inner.where("m = 3").join(index.places, "word").where(head & tail)
    first = inner.where("m > 3 AND j = 1").withColumn("after", piece(1)).join(index.places, ["word", "after"]).where(head)
    others = inner.where("m > 3 AND j > 1").withColumn("before", piece(-1)).join(index.places, ["word", "before"]).where((F.col("j") < F.col("m") - 2) | tail)
    at = ["query_id", "rarest", "m", "node", "field", (F.col("pos") - F.col("j")).alias("start")]
    rows = single.select(*at).unionByName(first.select(*at)).unionByName(others.select(*at))
    found = rows.groupBy("query_id", "rarest", "m", "node", "field", "start").agg(F.count("*").alias("c")).where("c = m - 2")
    weight = F.element_at(F.create_map(*[F.lit(x) for p in FIELDS.items() for x in p]), F.col("field"))
    return found.select("query_id", "node", "field", "rarest").distinct().groupBy("query_id", "node").agg(F.sum(0.5 * weight * F.col("rarest")).alias("bonus"))


def phrase_bonus(nodes: DataFrame, queries: DataFrame, weighted_terms: DataFrame, hits: DataFrame, held: DataFrame) -> DataFrame:
    """query_id, node, bonus: the held phrases, and those without an inner piece, which are looked for in the texts of hits."""
    short = hits.select("query_id", "node").join(_phrases(queries, weighted_terms).where(F.size("p") <= 2), "query_id").join(nodes.select("node", *FIELDS), "node")
    total = sum((F.when(F.contains(F.lower(F.coalesce(f, F.lit(""))), F.col("phrase")), w * 0.5).otherwise(0.0) for f, w in FIELDS.items()), F.lit(0.0))
    return held.unionByName(short.select("query_id", "node", (total * F.col("rarest")).alias("bonus")))


def _holders(texts: DataFrame, phrases: DataFrame, holds: Column) -> DataFrame:
    """texts (body: all that is searched) with the phrases (phrase) of a batch that they hold. A phrase's longest inner piece stands in the body between spaces: texts are tried with those whose piece they have.

    All is told where a text is read, so texts stay where they are. Phrases of two pieces or less are tried with every text.
    """
    p = F.split("phrase", " ")
    inner = F.transform(F.slice(p, 2, F.greatest(F.size(p) - 2, F.lit(0))), lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))
    asked = phrases.withColumn("_piece", F.array_max(inner)["w"])
    pieces = texts.select("*", F.explode(F.array_distinct(F.split("body", " "))).alias("_piece"))
    found = pieces.join(F.broadcast(asked.where("_piece IS NOT NULL")), "_piece").where(holds).drop("_piece")  # the phrases of a batch of queries
    return found.unionByName(texts.join(F.broadcast(asked.where("_piece IS NULL").drop("_piece")), holds))


def holding(nodes: DataFrame, passages: DataFrame, index: Index | None = None) -> DataFrame:
    """query_id, node of the nodes whose text holds a passage (query_id, passage). Without an index, texts are tried where they are read.

    Looked for among the nodes that have the passage's rarest inner term. Passages without any (one or two words, or stop words only) are not looked for.
    """
    if index is None:
        phrases = passages.select("query_id", F.col("passage").alias("phrase"))
        return _holders(nodes.select("node", F.col("text").alias("body")), phrases, F.contains("body", F.col("phrase"))).select("query_id", "node")
    terms = passages.select("query_id", F.explode(F.array_distinct(tokens(inner_words(F.col("passage"))))).alias("term"))
    found = index.postings.where("field = 'text'").join(terms.select("term").distinct(), "term", "left_semi").select("term", "node")
    counts = found.groupBy("term").agg(F.count("*").alias("n"))
    rarest = terms.join(counts, "term", "left").groupBy("query_id").agg(F.min_by("term", F.struct(F.coalesce("n", F.lit(0)), "term")).alias("term"))
    likely = rarest.join(found, "term").select("query_id", "node")
    return likely.join(passages, "query_id").join(nodes.select("node", "text"), "node").where(F.contains("text", F.col("passage"))).select("query_id", "node")


def top_hits(hits: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """The k best of each query: by score, then ticker (last first), then node; rank from 0."""
    j = hits.join(nodes.select("node", "ticker", "label"), "node")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("ticker"), "node")
    return j.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < k)


def best_of_each(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The k first rows of each key, with rank from 0."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).where(F.col("rank") < k)


def structural_label(query: Column) -> Column:
    """The section that a query's wording asks for."""
    q = F.lower(query)
    return F.when(F.exists(F.array(*map(F.lit, STATEMENT_PHRASES)), lambda p: F.contains(q, p)), "financial_statements")


def structural_targets(hits: DataFrame, nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """The newest node of the section that a query's wording asks for, where none of its hits is of that section."""
    asked = queries.select("query_id", structural_label(F.col("query")).alias("label")).where("label IS NOT NULL")
    seen = hits.join(nodes.select("node", "label"), "node").select("query_id", "label").distinct()
    missing = asked.join(seen, ["query_id", "label"], "left_anti")
    target = nodes.groupBy("label").agg(F.max("node").alias("node"), F.max_by("ticker", "node").alias("ticker"))
    return missing.join(target, "label").select("node", "query_id", F.lit(0.0).alias("score"), "ticker", "label")


def with_structural(hits: DataFrame, nodes: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Top hits, with the section asked for in the last place if no hit at all is of it; the newest node, by accession, stands for it."""
    extra = structural_targets(hits, nodes, queries)
    top = top_hits(hits, nodes, k)
    counts = top.groupBy("query_id").agg(F.count("*").alias("n"))
    extra = extra.join(counts, "query_id", "left").withColumn("rank", F.least(F.coalesce("n", F.lit(0)), F.lit(k - 1)).cast("int")).drop("n")
    kept = top.join(extra.select("query_id", F.col("rank").alias("taken")), "query_id", "left").where("taken IS NULL OR rank <> taken").drop("taken")
    return kept.unionByName(extra)


def fuse(ranked: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of lists (query_id, list weight, node, rank from 0, score): fused score and best score."""
    part = F.col("weight") / (k + F.col("rank") + 1)
    return ranked.where("weight > 0").groupBy("query_id", "node").agg(F.sum(part).alias("fused"), F.max("score").alias("score"))


#: The score below which a query is weak, what a paraphrase's list weighs, and the score of a node picked from the catalog.
WEAK, PARAPHRASE, PICKED = 3.0, 0.7, 2.0


def search(nodes: DataFrame, queries: DataFrame, paraphrases: DataFrame, picks: DataFrame, k: int = 10, weak: float = WEAK, index: Index | None = None) -> DataFrame:
    """query_id, node, score, rank, weak: the k best of each query.

    A query whose best score is at least `weak` gets its hits, the section that its wording asks for in the last place. For a weak one lists are fused by rank: its hits, that
    section, the hits of its paraphrases (query_id, paraphrase), and the nodes picked from the catalog (query_id, place from 0, node), with a fixed score. A hit keeps its best score.
    """
    index = index or index_of(nodes)
    p = paraphrases.groupBy("query_id").agg(F.array_sort(F.collect_list("paraphrase")).alias("p")).select("query_id", F.posexplode("p").alias("place", "query"))
    lists = queries.select("query_id", F.lit(-1).alias("place"), "query").unionByName(p)
    lists = lists.withColumn("list", F.concat_ws("/", "query_id", "place"))
    hits = scores(spread(nodes, "node"), lists.select(F.col("list").alias("query_id"), "query"), index=index).withColumnRenamed("query_id", "list").join(lists.select("list", "query_id", "place"), "list")
    hits = written(hits, "hits")
    own = hits.where("place = -1")
    best = queries.select("query_id").join(own.groupBy("query_id").agg(F.max("score").alias("best")), "query_id", "left").select("query_id", (F.coalesce("best", F.lit(0.0)) < weak).alias("weak"))
    strong = own.join(best.where("NOT weak"), "query_id", "left_semi").select("query_id", "node", "score")
    easy = with_structural(strong, nodes, queries.join(best.where("NOT weak"), "query_id", "left_semi"), k).select("query_id", "node", "score", "rank", F.lit(False).alias("weak"))
    poor = best.where("weak").select("query_id")
    at = Window.partitionBy("list").orderBy(F.desc("score"), F.desc("ticker"), "node")
    fused = hits.join(poor, "query_id", "left_semi").join(nodes.select("node", "ticker"), "node").withColumn("rank", F.row_number().over(at) - 1)
    fused = fused.select("query_id", "node", "rank", "score", F.when(F.col("place") < 0, 1.0).otherwise(PARAPHRASE).alias("weight"))
    wanted = structural_targets(own.select("query_id", "node", "score"), nodes, queries).join(poor, "query_id", "left_semi")
    fused = fused.unionByName(wanted.select("query_id", "node", F.lit(0).alias("rank"), "score", F.lit(1.0).alias("weight")))
    picked = picks.join(poor, "query_id", "left_semi").select("query_id", "node", F.col("place").cast("int").alias("rank"), F.lit(PICKED).alias("score"), F.lit(1.0).alias("weight"))
    top = Window.partitionBy("query_id").orderBy(F.desc("fused"), "node")
    ranked = fuse(fused.unionByName(picked)).withColumn("fused", F.floor(F.col("fused") * 1e9 + 0.5) / 1e9)
    ranked = ranked.withColumn("rank", F.row_number().over(top) - 1).where(F.col("rank") < k)
    return easy.unionByName(ranked.select("query_id", "node", "score", "rank", F.lit(True).alias("weak")))


def hit_rows(found: DataFrame, nodes: DataFrame, queries: DataFrame, filed: Column) -> DataFrame:
    """Hits with their citation and snippet: around the first query term, or the head of the text for one that was picked from the catalog."""
    from ..functions.scalar import citation

    terms = queries.select("query_id", tokens(F.col("query")).alias("terms"))
    j = found.join(terms, "query_id").join(nodes.select("node", "ticker", "form", "label", "text"), "node")
    head = F.when(F.length("text") > 240, F.concat(F.rtrim(F.substring("text", 1, 240)), F.lit("…"))).otherwise(F.col("text"))
    shown = F.when(F.col("weak") & (F.col("score") == PICKED), head).otherwise(snippet(F.col("text"), F.col("terms")))
    return j.select("query_id", "node", "rank", citation(F.col("ticker"), F.col("form"), filed, F.col("label")).alias("citation"), shown.alias("snippet"))


def evaluate(ranked: DataFrame, gold: DataFrame, k: int = 5) -> DataFrame:
    """hit@k and mean reciprocal rank over all gold queries (query_id, expected labels)."""
    r = ranked.where(F.col("rank") < k).join(gold, "query_id").where(F.array_contains("expected", F.col("label"))).groupBy("query_id").agg(F.min("rank").alias("rank"))
    g = gold.join(r, "query_id", "left")
    return g.agg(F.count("*").alias("queries"), F.avg(F.col("rank").isNotNull().cast("double")).alias("hit_rate"), F.avg(F.coalesce(1 / (F.col("rank") + 1), F.lit(0.0))).alias("mrr"))


def snippet(text: Column, terms: Column, half: int = 120) -> Column:
    """The text around the first place a word starts with one of the terms, or its beginning."""
    at = F.array_min(F.filter(F.transform(terms, lambda t: F.regexp_instr(F.lower(text), F.concat(F.lit(r"(?U)\b"), t))), lambda p: p > 0))
    start = F.greatest(F.lit(1), at - half)
    end = F.least(F.length(text) + 1, at + half)
    cut = F.concat(F.when(start > 1, "…").otherwise(""), F.trim(text.substr(start, end - start)), F.when(end <= F.length(text), "…").otherwise(""))
    head = F.when(F.length(text) > 2 * half, F.concat(text.substr(F.lit(1), F.lit(2 * half)), F.lit("…"))).otherwise(text)
    return F.when(at.isNull(), head).otherwise(cut)


def clean_paraphrases(raw: Column, query: Column) -> Column:
    """Without bullets, empty ones, the query itself, and those of 400 characters or more."""
    stripped = F.transform(raw, lambda p: F.trim(F.regexp_replace(p, r"^[\-\*•\d\.\s]+", "")))
    return F.filter(stripped, lambda p: (p != "") & (F.lower(p) != F.lower(query)) & (F.length(p) < 400))


def pick_by_path(nodes: DataFrame, chosen: Column, paths: DataFrame) -> DataFrame:
    """The nodes of chosen paths, in the order chosen; unknown paths drop out."""
    p = paths.select(F.posexplode(chosen).alias("pos", "path")).withColumn("path", F.trim("path"))
    return p.join(nodes, "path")


def flatten_filings(filings: DataFrame) -> DataFrame:
    """Search nodes of filings with sections: a section's chunks if there are any, else the section; themes are part of the summary."""
    s = filings.select("ticker", "accession", F.posexplode("sections").alias("section", "s"))
    c = s.select("ticker", "accession", "section", "s", F.posexplode_outer("s.chunks").alias("chunk", "c"))
    words = lambda a: F.array_join(F.coalesce(a, F.array().cast("array<string>")), " ")
    summary = F.concat_ws(" ", F.nullif(F.coalesce("c.summary", "s.summary"), F.lit("")), F.nullif(words(F.col("s.themes")), F.lit("")))
    return c.select("ticker", "accession", "section", "chunk", F.col("s.label").alias("label"), F.col("s.title").alias("title"), words(F.col("s.questions")).alias("questions"), summary.alias("summary"), F.coalesce("c.text", "s.text").alias("text"))
