"""Ranked lexical search: TPUT (three-phase uniform threshold) over term-partitioned postings.

Index: documents are dealt into segments; a term's postings in a segment are one row, highest share first, with the highest share beside it. Rows are
partitioned by term, and a term's by segment besides, so a word that stands in a third of all documents is many rows in many files. A share is what a posting gives to the score but for the
term's weight, a whole number.

Search, for a block of items at a time: (1) the k heads of each list give lower bounds, the k-th best sum of an item being its first bound; (2) that bound divided
by the item's lists is the threshold for every one of them: what lies above is fetched, segments add it up, and the k-th best sum is the second bound; documents that could still pass it,
with all that unread postings could give, are the candidates; (3) their exact scores are looked up in the item's lists of their segments.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .collocations import _BITS, bits_of
from .common import LOWER, materialise, release

_TERMS = bytes(LOWER[c] if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))
#: Documents and terms of a segment, partitions of the index by term, documents a further part of these, and (item, term) pairs searched at once.
_SEGMENT_DOCS, _SEGMENT_TERMS, _BUCKETS, _PART, _PAIRS = 1 << 14, 1 << 20, 32, 1 << 20, 200_000
_LISTS = "term string, seg long, size long, top long, docs binary, shares binary"


def terms_of(text: bytes) -> list[bytes]:
    """The maximal runs of letters, digits and characters beyond ASCII, with A-Z lower-cased."""
    return text.translate(_TERMS).split()


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = [len(terms_of(t.as_py())) for t in batch["text"]]
        yield pa.RecordBatch.from_pydict({"n": pa.array([sum(x > 0 for x in n)], pa.int64()), "terms": pa.array([sum(n)], pa.int64())})


class Segment:
    """Documents with terms: their ids, lengths and numbered terms."""

    def __init__(self) -> None:
        self.numbers = defaultdict(count().__next__)
        self.terms, self.ids, self.lengths = array("i"), [], []

    def add(self, doc_id: int | None, terms: list[bytes]) -> None:
        self.terms.extend(map(self.numbers.__getitem__, terms))
        self.ids.append(doc_id)
        self.lengths.append(len(terms))

    def lists(self, seg: int, total: int, length: int, wanted: np.ndarray | None) -> pa.RecordBatch:
        """One row for each wanted term, and one without a term that has the ids and which of them are null."""
        n = np.array(self.lengths, np.int64)
        names = list(self.numbers)
        term, doc = np.frombuffer(self.terms, np.int32).astype(np.int64), np.repeat(np.arange(len(n)), n)
        if wanted is not None:
            slot = np.fromiter(map(zlib.crc32, names), np.uint64, len(names)) % np.uint64(_BITS)
            keep = ((wanted[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)) == 1)[term]
            term, doc = term[keep], doc[keep]
        pairs, tf = np.unique(term << 32 | doc, return_counts=True)
        term, doc = pairs >> 32, pairs & 0xFFFFFFFF
        m = 50 + 50 * n * total // length
        share = 1_000_000_000 * tf // (1000 * tf + 20 * m[doc])
        order = np.lexsort((doc, -share, term))
        term, doc, share = term[order], doc[order].astype(np.uint16), share[order].astype(np.uint32)
        first = np.flatnonzero(np.diff(term, prepend=-1))
        ends = np.append(first[1:], len(term))[: len(first)].tolist()
        rows = [(names[term[a]].decode(), seg, b - a, int(share[a]), doc[a:b].tobytes(), share[a:b].tobytes()) for a, b in zip(first.tolist(), ends, strict=True)]
        ids = np.array([i or 0 for i in self.ids], np.int64)
        rows.append(("", seg, len(n), 0, ids.tobytes(), bytes(i is None for i in self.ids)))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["term", "seg", "size", "top", "docs", "shares"])


def _postings(total: int, length: int, wanted: np.ndarray | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = count(TaskContext.get().partitionId() << 32)
        segment = Segment()
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                terms = terms_of(text.as_py())
                if terms:
                    segment.add(doc_id, terms)
                    if len(segment.ids) >= _SEGMENT_DOCS or len(segment.terms) >= _SEGMENT_TERMS:
                        yield segment.lists(next(numbers), total, length, wanted)
                        segment = Segment()
        if segment.ids:
            yield segment.lists(next(numbers), total, length, wanted)
        segment = None
        release()

    return run


def build_index(docs: DataFrame, wanted: np.ndarray | None = None) -> tuple[DataFrame, int]:
    """The lists (bucket, term, seg, size, top, docs, shares) of all documents, and how many documents have terms.

    wanted: bits of the terms (crc32) of a batch of items; lists that no item asks for are left out then, while lengths and numbers of documents are those of all.
    Null and empty texts and those without terms are not in the index; repeated rows are there as often as they occur. A null doc_id is kept as such.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    sums = base.select("text").mapInArrow(_counts, "n long, terms long").agg(F.sum("n"), F.sum("terms")).first()
    total, length = sums[0] or 0, sums[1] or 1
    lists = base.mapInArrow(_postings(total, length, wanted), _LISTS)
    lists = lists.withColumn("bucket", (F.crc32(F.col("term").cast("binary")) % _BUCKETS).cast("int"))
    parts = F.pmod(F.xxhash64("seg"), F.lit(total // _PART + 1))
    return materialise(lists.repartition("bucket", parts).sortWithinPartitions("bucket", "term", F.desc("top")), "postings", partition_by="bucket"), total


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term), each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, t.decode()) for i, text in zip(batch["item_id"].to_pylist(), batch["text"], strict=True) for t in set(terms_of(text.as_py()))]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array([t for _, t in found], pa.string())], names=["item_id", "term"])

    base = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return base.mapInArrow(run, "item_id long, term string").distinct()


def _arrays(table: pa.Table) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Documents and shares of the lists of a segment."""
    columns = (table["term"].to_pylist(), table["docs"].to_pylist(), table["shares"].to_pylist())
    return {t: (np.frombuffer(d, np.uint16), np.frombuffer(s, np.uint32)) for t, d, s in zip(*columns, strict=True) if t}


class Block:
    """The items of a block: of each its id and its lists (term, weight, highest share); bounds are set phase by phase."""

    def __init__(self, pairs: pa.Table):
        found: dict[int | None, list] = defaultdict(list)
        for item, term, weight, top in zip(*(pairs[c].to_pylist() for c in ("item_id", "term", "weight", "top")), strict=True):
            found[item].append((term, weight, top))
        self.items = list(found.items())
        self.bounds: dict[int | None, int] = {}
        self.least: dict[int | None, list[int]] = {}

    def set_thresholds(self, bounds: dict[int | None, int]) -> dict[str, int]:
        """The least share that an item's threshold lets pass in each of its lists; of each term the least of all items."""
        of_terms: dict[str, int] = {}
        for item, lists in self.items:
            bound = self.bounds[item] = bounds.get(item, 0)
            self.least[item] = [-(-bound // (weight * len(lists))) for _, weight, _ in lists]
            for (term, _, top), least in zip(lists, self.least[item], strict=True):
                if least <= top:
                    of_terms[term] = min(least, of_terms.get(term, least))
        return of_terms

    def sums(self, lists: dict[str, tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[int | None, np.ndarray, np.ndarray, np.ndarray]]:
        """(item, documents, sums of what was fetched, the most that they can come to) in a segment."""
        size = max((int(d.max()) + 1 for d, _ in lists.values() if len(d)), default=0)
        for item, wanted in self.items:
            got, open_ = np.zeros(size, np.int64), np.zeros(size, np.int64)
            rest = 0
            for (term, weight, top), least in zip(wanted, self.least[item], strict=True):
                unread = weight * min(max(least - 1, 0), top)
                rest += unread
                if term in lists:
                    docs, shares = lists[term]
                    n = len(shares) - int(np.searchsorted(shares[::-1], least))
                    got[docs[:n]] += weight * shares[:n].astype(np.int64)
                    open_[docs[:n]] -= unread
            at = np.flatnonzero(got)
            if len(at):
                yield item, at, got[at], got[at] + open_[at] + rest


_FOUND = pa.schema([("item_id", pa.int64()), ("seg", pa.int64()), ("doc", pa.int64()), ("score", pa.int64())])


def _found(rows: list[tuple], seg: int) -> pa.Table:
    item = [i for i, d, _ in rows for _ in range(len(d))]
    doc = np.concatenate([d for _, d, _ in rows]) if rows else []
    score = np.concatenate([s for *_, s in rows]) if rows else []
    return pa.table([pa.array(item, pa.int64()), pa.array([seg] * len(item), pa.int64()), pa.array(doc, pa.int64()), pa.array(score, pa.int64())], schema=_FOUND)


def _best(block: Block, k: int):
    """The k best sums of a segment, of those above the first bound."""

    def run(table: pa.Table) -> pa.Table:
        rows = []
        for item, docs, got, _ in block.sums(_arrays(table)):
            best = np.argsort(-got, kind="stable")[:k]
            best = best[got[best] >= block.bounds[item]]
            rows.append((item, docs[best], got[best]))
        return _found(rows, table["seg"][0].as_py())

    return run


def _candidates(block: Block, bounds: dict[int | None, int]):
    def run(table: pa.Table) -> pa.Table:
        rows = []
        for item, docs, got, most in block.sums(_arrays(table)):
            may = most >= bounds.get(item, 0)
            rows.append((item, docs[may], got[may]))
        return _found(rows, table["seg"][0].as_py())

    return run


def _exact(block: Block):
    """Scores of the candidates of a segment, with their ids."""
    weights = {item: [(t, w) for t, w, _ in lists] for item, lists in block.items}

    def run(lists: pa.Table, candidates: pa.Table) -> pa.Table:
        rows = {t: (d, s) for t, d, s in zip(lists["term"].to_pylist(), lists["docs"].to_pylist(), lists["shares"].to_pylist(), strict=True)}
        ids, null = np.frombuffer(rows[""][0], np.int64), np.frombuffer(rows[""][1], np.uint8)
        found = _arrays(lists)
        item_ids, docs = candidates["item_id"].to_pylist(), candidates["doc"].to_numpy()
        of_item: dict[int | None, list[int]] = defaultdict(list)
        for i, item in enumerate(item_ids):
            of_item[item].append(i)
        score = np.zeros(len(docs), np.int64)
        for item, places in of_item.items():
            total = np.zeros(len(ids), np.int64)
            for term, weight in weights[item]:
                if term in found:
                    total[found[term][0]] += weight * found[term][1].astype(np.int64)
            score[places] = total[docs[places]]
        return pa.table({"item_id": pa.array(item_ids, pa.int64()), "doc_id": pa.array(ids[docs], pa.int64(), mask=null[docs] == 1), "score": pa.array(score)})

    return run


def _kth(sums: DataFrame, k: int) -> dict[int | None, int]:
    """The k-th best sum of each item that has so many."""
    order = Window.partitionBy("item_id").orderBy(F.desc("score"))
    return {r["item_id"]: r["score"] for r in sums.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k).where(F.col("at") == k).collect()}


def _tput(index: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """(item_id, doc_id, score) of at least the k best documents of each item of a block."""
    spark = index.sparkSession
    pairs = materialise(pairs, "block-of-items")
    block = Block(pairs.toArrow())
    buckets = sorted({0} | {zlib.crc32(t.encode()) % _BUCKETS for _, lists in block.items for t, *_ in lists})
    index = index.where(F.col("bucket").isin(buckets))

    def head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = [np.frombuffer(d.as_py(), np.uint16)[:k] for d in batch["docs"]]
            shares = [np.frombuffer(s.as_py(), np.uint32)[:k] for s in batch["shares"]]
            sizes = [len(d) for d in docs]
            names = [pa.array(np.repeat(np.arange(batch.num_rows), sizes))]
            columns = [batch["term"].take(names[0]), batch["seg"].take(names[0]), pa.array(np.concatenate(docs), pa.int64()), pa.array(np.concatenate(shares), pa.int64())]
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays(columns, names=["term", "seg", "doc", "share"])

    # Phase 1: the k heads of a list lie in the k rows with the highest tops.
    by_top = Window.partitionBy("term").orderBy(F.desc("top"), "seg")
    picked = index.join(pairs.select("term").distinct(), "term", "left_semi").select("term", "seg", "top").withColumn("at", F.row_number().over(by_top)).where(F.col("at") <= k)
    heads = index.join(picked.select("term", "seg"), ["term", "seg"], "left_semi").select("term", "seg", "docs", "shares").mapInArrow(head, "term string, seg long, doc long, share long")
    heads = heads.withColumn("at", F.row_number().over(Window.partitionBy("term").orderBy(F.desc("share"), "seg", "doc"))).where(F.col("at") <= k)
    sums = heads.join(pairs, "term").groupBy("item_id", "seg", "doc").agg(F.sum(F.col("weight") * F.col("share")).alias("score"))
    least = block.set_thresholds(_kth(sums, k))

    # Phase 2: all above the threshold; rows whose highest share lies below it are not read.
    wanted = spark.createDataFrame(pa.table({"term": pa.array(list(least), pa.string()), "least": pa.array(list(least.values()), pa.int64())}))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shares = [np.frombuffer(s.as_py(), np.uint32) for s in batch["shares"]]
            n = [len(s) - int(np.searchsorted(s[::-1], x)) for s, x in zip(shares, batch["least"].to_pylist(), strict=True)]
            docs = pa.array([d.as_py()[: 2 * x] for d, x in zip(batch["docs"], n, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch["term"], batch["seg"], docs, pa.array([s[:x].tobytes() for s, x in zip(shares, n, strict=True)], pa.binary())], names=["term", "seg", "docs", "shares"])

    rows = index.join(wanted, "term").where("top >= least").select("term", "seg", "docs", "shares", "least")
    fetched = materialise(rows.mapInArrow(cut, "term string, seg long, docs binary, shares binary").repartition("seg"), "fetched").groupBy("seg")
    schema = "item_id long, seg long, doc long, score long"
    bounds = block.bounds | _kth(fetched.applyInArrow(_best(block, k), schema), k)
    candidates = materialise(fetched.applyInArrow(_candidates(block, bounds), schema), "candidates")

    # Phase 3: exact scores from the candidates' own lists.
    asked = candidates.select("item_id", "seg").distinct()
    asked_lists = asked.join(pairs, asked["item_id"].eqNullSafe(pairs["item_id"])).select("term", "seg").union(asked.select(F.lit(""), "seg")).distinct()
    lists = index.join(asked_lists, ["term", "seg"], "left_semi").select("term", "seg", "docs", "shares")
    return lists.groupBy("seg").cogroup(candidates.groupBy("seg")).applyInArrow(_exact(block), "item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank, doc_id, score: the k best of all documents for each item, equal scores by doc_id (null last); fewer where fewer have a score above 0.

    A document's score for a term is div(10^9 * tf, 1000 * tf + 20 * m) with m = 50 + div(50 * n * N, L), times the term's weight floor(1000 * ln((2N + 2) / (2df + 1))), in 64 bits. Rows of one item_id,
    null too, are one item with the terms of all its texts. Items without terms that occur get no rows. Null and empty texts have no terms; repeated documents are ranked as often as they
    occur. Very long texts are taken whole. Other columns are not read. Empty tables give an empty result.
    """
    spark = docs.sparkSession
    terms = materialise(item_terms(items), "item-terms")
    wanted = bits_of(terms.select((F.crc32(F.col("term").cast("binary")) % _BITS).alias("slot")).distinct())
    index, total = build_index(docs, wanted)
    found = index.where("term <> ''").groupBy("term").agg(F.sum("size").alias("df"), F.max("top").alias("top"))
    weight = F.floor(1000 * F.log((F.lit(2 * total + 2).cast("double")) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    pairs = materialise(terms.join(found, "term").select("item_id", "term", weight.alias("weight"), "top").where("weight > 0"), "weighted-terms")
    blocks = math.ceil(pairs.count() / _PAIRS)
    scored = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for b in range(blocks):
        of_block = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        scored = scored.union(materialise(_tput(index, of_block, k), "scored"))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = scored.where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
