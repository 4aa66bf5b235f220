"""The corpus pipeline: toxicity, exact dedup, near-duplicate dedup, repeated passages, packing."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import exact_dedup, packing, shingle_join, suffix_dedup, toxicity
from marlstone.llm.common import materialise, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the threshold of their language; the classifier learns from all labelled rows it may.

    Null and empty texts are scored as empty ones, very long texts whole. Repeated rows and those without doc_id are judged by their texts as any others. Without labels of
    both classes nothing is toxic. An empty table stays empty. Other columns are dropped.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    marked = toxicity.score(docs, model, keep=COLUMNS)
    return marked.where("NOT toxic").select(COLUMNS)


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """The documents, each with a number `row` that stays: doc_id may be null or repeated."""
    return materialise(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")), name)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, that of the most code points in the original text, then of the smallest doc_id (null last).

    Texts are equal without their white space; null and empty texts are one group. Of fully equal rows one stays, whatever its doc_id. Very long texts are compared
    whole. An empty table stays empty. Other columns are dropped.
    """
    docs = numbered(docs, "numbered-copies")
    kept = exact_dedup.exact_dedup(docs, row=F.col("row")).where("kept").select("row")
    return docs.join(kept, "row", "left_semi").select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies (five words, a similarity of 0.75), that of the smallest doc_id; null comes last.

    Rows without doc_id and repeated ones take part as any others; texts without words, null ones among them, have no near copies. Very long texts are compared whole. An
    empty table stays empty. Other columns are dropped.
    """
    docs = numbered(docs, "numbered-near-copies")
    found = shingle_join.jaccard_components(docs.select(F.col("row").alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("row").alias("c")))
    kept = found.join(docs.select("row", "doc_id"), "row").groupBy("component_id").agg(first.alias("first")).select(F.col("first.c").alias("row"))
    return docs.join(kept, "row", "left_semi").select(COLUMNS)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 51 words, or of 400 bytes, that occur more than once; bytes of a character cut in two go too.

    All rows stay, with a text that may be empty (a null one is); repeated rows lose what they share. Very long texts are gone through in chunks. An empty table stays
    empty. Other columns are dropped; n_chars is that of the new text.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py().decode("utf-8", "ignore") for t in batch["kept"]]
            columns = {c: batch[c] for c in ("doc_id", "lang", "source")} | {"text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())}
            yield pa.RecordBatch.from_arrays([columns[c] for c in COLUMNS], names=COLUMNS)

    cut = suffix_dedup.remove_passages(docs, keep=("lang", "source"))
    return cut.select("doc_id", "kept", "lang", "source").mapInArrow(decode, "doc_id long, text string, lang string, source string, n_chars long")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens: one row for each piece of a document, as packing.pack says, for null, empty and very long texts too."""
    return packing.pack(docs, with_ids=False)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("passages", cut_passages), ("packing", pack)]
#: The classifier and the tokenizer can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
