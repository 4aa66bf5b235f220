"""Removal of passages that stand earlier in the corpus, by relative Lempel-Ziv parsing of each document against all reference blocks.

Words are 64-bit codes. A window of `window` words belongs to its anchor: the `gram` words in it with the least hash, leftmost if several. Consecutive windows with
one anchor are a run, and the words of its windows a block of fewer than 2 * window words; so equal passages are cut into equal blocks wherever they stand, and every window lies in just one
block of its document. Steps:

1. Anchors that occur once in the corpus drop out. The first place of each remaining block, by document and position, is its reference; all later ones are pointers to it.
2. Blocks that are new but whose anchor has other blocks too may still hold old windows, at their borders: the index of their windows gives each window's first place,
   and the later ones point to it.
3. A document is parsed from left to right: of the pointers at hand that copy from one place without a break, the longest is the next factor. The words of factors go.

All groups are made by aggregation of rows of fixed size, so a block that a third of all documents share is no large task. Codes and identifiers are 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import RollingHash, _power, forget, materialise, release
from .suffix_dedup import _merged, _word_bounds, sliding_min

#: Words that are hashed at once; positions need 24 bits.
_CHUNK = 1 << 19


class WordHash(RollingHash):
    """Hashes of any runs of words, given the words' codes."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(codes * _power(0, n)[:n], out=self.sums[1:])
        self.inverse = _power(1, n)


def codes_of(text: bytes) -> np.ndarray:
    return RollingHash(np.frombuffer(text, np.uint8))(*_word_bounds(text))


def blocks_of(codes: np.ndarray, sizes: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(document number, first window, number of windows, anchor hash, block hash) of the runs of documents of so many words."""
    begins = np.cumsum(sizes) - sizes
    h = WordHash(codes)
    keyed = (h.windows(gram) >> np.uint64(24) << np.uint64(24)) | np.arange(max(0, len(codes) - gram + 1), dtype=np.uint64)
    least = sliding_min(keyed, window - gram + 1)
    starts = np.maximum(sizes - window + 1, 0)
    at = np.repeat(begins - (np.cumsum(starts) - starts), starts) + np.arange(starts.sum())
    anchor = (least[at] & np.uint64((1 << 24) - 1)).astype(np.int64) if len(at) else np.zeros(0, np.int64)
    number = np.repeat(np.arange(len(sizes)), starts)
    first = np.flatnonzero((np.diff(anchor, prepend=-1) != 0) | (np.diff(number, prepend=-1) != 0))
    last = np.append(first[1:], len(at))[: len(first)] - 1
    a = anchor[first]
    return number[first], at[first] - begins[number[first]], last - first + 1, h(a, a + gram), h(at[first], at[last] + window)


def _chunks(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    """(doc_id and text key of each part, codes, sizes, first words) of chunks; long documents come in parts that overlap."""
    rows, parts, bases, total = [], [], [], 0
    for batch in batches:
        for doc, key, text in zip(batch["doc_id"].to_pylist(), batch["tkey"].to_pylist(), batch["text"], strict=True):
            codes = codes_of(text.as_py())
            for base in range(0, max(len(codes) - window + 1, 0), _CHUNK):
                part = codes[base : base + _CHUNK + window - 1]
                if rows and total + len(part) > _CHUNK:
                    yield rows, np.concatenate(parts), np.array([len(p) for p in parts]), np.array(bases)
                    rows, parts, bases, total = [], [], [], 0
                rows.append((doc, key))
                parts.append(part)
                bases.append(base)
                total += len(part)
    if rows:
        yield rows, np.concatenate(parts), np.array([len(p) for p in parts]), np.array(bases)


_PLACED = "doc_id long, tkey long, at long, width long, akey long, hctx long"


def _blocks(window: int, gram: int, anchors_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, codes, sizes, bases in _chunks(batches, window):
            number, start, width, akey, hctx = blocks_of(codes, sizes, window, gram)
            columns = {"akey": pa.array(akey.view(np.int64))}
            if not anchors_only:
                docs, keys = (pa.array(c, pa.int64()).take(pa.array(number)) for c in zip(*rows, strict=True))
                columns = {"doc_id": docs, "tkey": keys, "at": pa.array(start + bases[number]), "width": pa.array(width), **columns, "hctx": pa.array(hctx.view(np.int64))}
            yield pa.RecordBatch.from_pydict(columns)
        release()

    return run


def _windows(window: int):
    """(doc_id, tkey, at, wkey) of each window of the wanted blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, key, text, wanted in zip(batch["doc_id"].to_pylist(), batch["tkey"].to_pylist(), batch["text"], batch["wanted"], strict=True):
                hashes = WordHash(codes_of(text.as_py())).windows(window)
                at = np.concatenate([np.arange(w["at"], w["at"] + w["width"]) for w in wanted.as_py()])
                n = len(at)
                yield pa.RecordBatch.from_arrays([pa.array([doc] * n, pa.int64()), pa.array([key] * n, pa.int64()), pa.array(at), pa.array(hashes[at].view(np.int64))], names=["doc_id", "tkey", "at", "wkey"])
        release()

    return run


def factors_of(pointers: list[tuple], window: int) -> list[tuple]:
    """(first word, words, document and text key, first word there) of the factors. pointers: (first window, windows, document, text key, first window there)."""
    open_: dict[tuple, list] = {}
    reach = []
    for at, width, doc, key, there in sorted(pointers, key=lambda p: p[0]):
        end = at + width - 1 + window
        run = open_.get((doc, key, there - at))
        if run and at <= run[1]:
            run[1] = max(run[1], end)
        else:
            run = open_[doc, key, there - at] = [at, end, doc, key, there]
            reach.append(run)
    factors, at, i, best = [], 0, 0, None
    while True:
        while i < len(reach) and reach[i][0] <= at:
            if best is None or reach[i][1] > best[1]:
                best = reach[i]
            i += 1
        if best and best[1] > at:
            factors.append((at, best[1] - at, best[2], best[3], best[4] + at - best[0]))
            at = best[1]
        elif i < len(reach):
            at = reach[i][0]
        else:
            return factors


_FACTORS = pa.list_(pa.struct([("at", pa.int64()), ("words", pa.int64()), ("from_doc", pa.int64()), ("from_key", pa.int64()), ("from_at", pa.int64())]))


def _cut(window: int, with_text: bool):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("n_factors", pa.int64())] + [("kept", pa.string()), ("factors", _FACTORS)] * with_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, pointers in zip(batch["doc_id"].to_pylist(), batch["text"], batch["pointers"], strict=True):
                words = text.as_py().split()
                factors = factors_of([tuple(p.values()) for p in pointers.as_py() or []], window)
                spans = _merged([(f[0], f[0] + f[1]) for f in factors])
                kept = [w for a, b in zip([0, *(s[1] for s in spans)], [*(s[0] for s in spans), len(words)], strict=True) for w in words[a:b]]
                joined = b" ".join(kept)
                rows.append((doc, len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), len(factors)) + (joined.decode(), [dict(zip(("at", "words", "from_doc", "from_key", "from_at"), f, strict=True)) for f in factors]) * with_text)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
        release()

    return run, "doc_id long, n_words long, n_removed long, kept_sha256 string, n_factors long" + ", kept string, factors array<struct<at:long,words:long,from_doc:long,from_key:long,from_at:long>>" * with_text


#: The order of places; a document given twice over, with doc_id and text, is one document.
_PLACE = ("no_id", "doc_id", "tkey", "at")


def _place() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("no_id"), *_PLACE[1:])


def _firsts(places: DataFrame, key: list[str]) -> DataFrame:
    return places.groupBy(*key).agg(F.min(_place()).alias("first"), F.first("width").alias("width"), F.count("*").alias("n"))


def _pointers(places: DataFrame, firsts: DataFrame, key: list[str]) -> DataFrame:
    """All places of a key but the first, each with the first."""
    later = places.join(firsts.where("n > 1").select(*key, "first"), key).where(_place() != F.col("first"))
    return later.select("doc_id", "tkey", "at", "width", *(F.col(f"first.{c}").alias(a) for c, a in (("doc_id", "from_doc"), ("tkey", "from_key"), ("at", "from_at"))))


def find_pointers(base: DataFrame, window: int, gram: int) -> DataFrame:
    """(d, k, pointers) of the documents of base (doc_id, tkey, text) that repeat earlier windows."""
    anchors = base.mapInArrow(_blocks(window, gram, True), "akey long")
    shared = materialise(anchors.groupBy("akey").agg(F.count("*").alias("n")).where("n > 1").select("akey"), "shared-anchors")
    runs = base.mapInArrow(_blocks(window, gram, False), _PLACED).join(shared, "akey", "left_semi")
    runs = materialise(runs, "shared-runs")
    firsts = materialise(_firsts(runs, ["akey", "hctx"]), "reference-blocks")
    found = materialise(_pointers(runs, firsts, ["akey", "hctx"]), "pointers")
    forget(runs, shared)
    # New blocks of anchors that have several: their windows one by one.
    several = firsts.groupBy("akey").agg(F.count("*").alias("m")).where("m > 1").select("akey")
    wanted = firsts.join(several, "akey", "left_semi").select(F.col("first.doc_id").alias("d"), F.col("first.tkey").alias("k"), F.struct(F.col("first.at").alias("at"), "width").alias("block"))
    wanted = materialise(wanted.groupBy("d", "k").agg(F.collect_list("block").alias("wanted")), "open-blocks")  # a document's own
    forget(firsts)
    texts = base.join(wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tkey") == F.col("k"))).select("doc_id", "tkey", "text", "wanted")
    windows = materialise(texts.mapInArrow(_windows(window), "doc_id long, tkey long, at long, wkey long").withColumn("width", F.lit(1).cast("long")), "windows")
    found = found.unionByName(materialise(_pointers(windows, _firsts(windows, ["wkey"]), ["wkey"]), "pointers"))
    forget(windows, wanted)
    pointers = F.collect_list(F.struct("at", "width", "from_doc", "from_key", "from_at")).alias("pointers")  # a document's own
    return found.distinct().groupBy(F.col("doc_id").alias("d"), F.col("tkey").alias("k")).agg(pointers)


def remove_earlier(docs: DataFrame, window: int = 20, gram: int = 8, with_text: bool = True) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256, n_factors; if asked for, kept (text) and factors (at, words, from_doc, from_key, from_at).

    Words lie between ASCII white space. A word goes if a window of `window` words that covers it also starts earlier: in a document with a smaller doc_id (null is the largest) or before it in
    its own. Windows are judged on the input. kept has the other words, joined by one space. A factor copies so many words from word from_at of the document with the id from_doc and the text
    key (xxhash64) from_key. Of different texts under one doc_id, or under none, that with the smaller key is the earlier one. Rows that agree in doc_id and text are one document, and all keep
    what it keeps. Null texts and empty ones have no words; texts shorter than a window lose nothing. Very long texts are hashed in chunks that overlap. Other columns are not read. An empty
    table gives an empty result.
    """
    text = F.coalesce("text", F.lit("")).cast("binary").alias("text")
    base = docs.select("doc_id", text).withColumn("tkey", F.xxhash64("text"))
    found = find_pointers(base, window, min(gram, window))
    both = base.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tkey") == F.col("k")), "left")
    run, schema = _cut(window, with_text)
    return both.select("doc_id", "text", "pointers").mapInArrow(run, schema)
