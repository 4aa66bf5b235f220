"""Best-fit packing of tokenised documents with large-item matching.

Lengths are integers up to the capacity, so the whole plan is made on the histogram of lengths, which has at most
`capacity` entries however many documents there are: a plan is a list of (pattern of lengths, number of sequences).
Pieces longer than a third of the capacity are large: a sequence takes at most two of them, matched greedily, longest
first, each with the largest partner that still fits. Smaller pieces then go, longest first, into the smallest gap
that holds them, and open new sequences only where none does. Pieces of one length are interchangeable; each takes
its place by its rank among them, which needs only counts of lengths per block of documents.
"""

from __future__ import annotations

import bisect
import gc
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import byte_characters
from .common import materialise, release

VOCABULARY = "word_bpe_49k.json"
#: Characters on which Python's and the tokenizer's white space differ, and the start of the special tokens' strings.
_ODD = re.compile("[\x1c-\x1f]|<\\|")
#: Words on which lower-casing and the split below are all that the tokenizer does before its merges.
_PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
_SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")
#: Words kept in a table, and the longest that is, so that a table's bytes are bounded too.
_CACHED, _LONGEST = 250_000, 64
_encoders: dict[str, WordEncoder] = {}


class WordEncoder:
    """Token ids of whole texts. The tokenizer never merges across white space, so ids are kept by word.

    Two tables are kept: when the younger is full it becomes the elder, and words found in the elder move on, so words that recur stay.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.ids: dict[str, bytes] = {}
        self.elder: dict[str, bytes] = {}
        chars = byte_characters()
        self.shown = {c: "".join(chars[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}

    def clear(self) -> None:
        self.ids, self.elder = {}, {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, word: str) -> bytes:
        if not _PLAIN.fullmatch(word):
            return self.whole(word)
        tokenize = self.tokenizer.model.tokenize
        runs = _SPLIT.findall(word.lower())
        if not word.isascii():
            runs = [r.translate(self.shown) for r in runs]
        return array("I", [t.id for r in runs for t in tokenize(r)]).tobytes()

    def __call__(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if _ODD.search(text):
            return self.whole(text)
        words, ids = text.split(), self.ids
        try:
            return b"".join([ids[w] for w in words])
        except KeyError:
            if len(ids) > _CACHED:
                self.elder, self.ids = ids, {}
                ids = self.ids
            elder, missing = self.elder, set(words).difference(ids)
            many, own = len(missing) > _CACHED // 4, {}  # what is kept for the text only
            for w in missing:
                found = elder.get(w) or self.word(w)
                if many or len(w) > _LONGEST:
                    own[w] = found
                else:
                    ids[w] = found
            if own:
                return b"".join([own[w] if w in own else ids[w] for w in words])
            return b"".join([ids[w] for w in words])


def encoder(name: str) -> WordEncoder:
    if name not in _encoders:
        _encoders[name] = WordEncoder(public_tokenizers.path(name))
    return _encoders[name]


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence's pieces, number of such sequences). counts: pieces by length, 1 to capacity."""
    left = {n: c for n, c in counts.items() if c > 0}
    third = capacity / 3
    gaps: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    sizes: list[int] = []  # the gaps there are, ascending

    def add(pattern: tuple[int, ...], number: int) -> None:
        gap = capacity - sum(pattern)
        if gap not in gaps:
            gaps[gap] = []
            bisect.insort(sizes, gap)
        gaps[gap].append((pattern, number))

    large = sorted(n for n in left if n > third)
    while large:
        a = large[-1]
        i = bisect.bisect_right(large, capacity - a) - 1
        if i >= 0 and large[i] == a and left[a] == 1:  # it can't pair with itself
            i -= 1
        if i < 0:
            add((a,), left.pop(a))
            large.pop()
            continue
        b = large[i]
        number = left[a] // 2 if a == b else min(left[a], left[b])
        add((a, b), number)
        for n in (a, b):
            left[n] -= number
        for n in {a, b}:
            if not left[n]:
                del left[n]
                large.pop(bisect.bisect_left(large, n))
    for n in sorted((n for n in left if n <= third), reverse=True):
        count = left[n]
        while count:
            i = bisect.bisect_left(sizes, n)
            if i == len(sizes):
                each = capacity // n
                if count >= each:
                    add((n,) * each, count // each)
                if count % each:
                    add((n,) * (count % each), 1)
                break
            gap = sizes[i]
            pattern, number = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                sizes.pop(i)
            used = min(number, count)
            add((*pattern, n), used)
            if number > used:
                add(pattern, number - used)
            count -= used
    return [x for gap in sizes for x in gaps[gap]]


def _slots(counts: dict[int, int], capacity: int) -> list[tuple]:
    """(length, first rank, number of ranks, first sequence, offset): the place of each run of ranks of a length."""
    ranks: dict[int, int] = {}
    out, first = [], 0
    for pattern, number in plan(counts, capacity):
        offset = 0
        for n in pattern:
            start = ranks.get(n, 0)
            out.append((n, start, number, first, offset))
            ranks[n] = start + number
            offset += n
        first += number
    return out


def pieces(docs: DataFrame, capacity: int = 2048, vocabulary: str = VOCABULARY, with_ids: bool = True, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, block, place and, if asked for, ids: the tokenised pieces of docs."""
    schema = "doc_id long, piece int, start long, length int, ids_crc32 long, block string, place long" + ", ids binary" * with_ids
    end = np.array([end_id], "<u4").tobytes()
    arrow = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64()), ("block", pa.string()), ("place", pa.int64())] + [("ids", pa.binary())] * with_ids)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        block, seen = f"{TaskContext.get().partitionId()}", {}
        gc.disable()  # the tables hold no cycles, and going through them again and again takes time
        try:
            for batch in batches:
                rows = []
                for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                    ids = encode(text.as_py() or "") + end
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        n = len(part) // 4
                        seen[n] = seen.get(n, -1) + 1
                        rows.append((doc_id, piece, at // 4, n, zlib.crc32(part), block, seen[n]) + (part,) * with_ids)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), arrow.types, strict=True)], schema=arrow)
        finally:  # the worker goes on to other tasks
            encode.clear()
            gc.enable()
            release()

    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def pack(docs: DataFrame, capacity: int = 2048, vocabulary: str = VOCABULARY, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, little-endian uint32).

    A document's ids are those of its whole text (null: empty) and then id 0; only documents longer than capacity are
    cut. An empty text is one piece of length 1. Repeated rows are packed as separate documents, null doc_ids are
    kept. Other columns are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    cut = materialise(pieces(docs, capacity, vocabulary, with_ids), "pieces")
    blocks = cut.groupBy("block", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("block", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rank_before"), "n")
    blocks = materialise(blocks, "lengths")
    counts = {r["length"]: r["n"] for r in blocks.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    slots: dict[int, list[tuple]] = {n: [tuple(map(int, x[1:])) for x in rows] for n, rows in groupby(sorted(_slots(counts, capacity)), key=lambda x: x[0])}
    runs = spark.createDataFrame([(n, [x[0] for x in s], s) for n, s in slots.items()], "length int, firsts array<long>, runs array<struct<first:long,number:long,sequence:long,offset:long>>")
    # The slots of a length, narrowed to those that its ranks in this block fall in.
    spans = blocks.join(F.broadcast(runs), "length").select("block", "length", "rank_before", F.filter("runs", lambda x: (x["first"] < F.col("rank_before") + F.col("n")) & (x["first"] + x["number"] > F.col("rank_before"))).alias("runs"))
    placed = cut.join(spans, ["block", "length"]).withColumn("rank", F.col("rank_before") + F.col("place"))
    placed = placed.withColumn("run", F.filter("runs", lambda x: (x["first"] <= F.col("rank")) & (F.col("rank") < x["first"] + x["number"]))[0])
    return placed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", (F.col("run.sequence") + F.col("rank") - F.col("run.first")).alias("sequence_id"), F.col("run.offset").alias("offset"), *["ids"] * with_ids)
