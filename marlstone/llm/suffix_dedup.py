"""Removal of passages that occur more than once, by suffix sorting with bucket-pointer refinement.

A string of `length` bytes is judged at each of its starts. The start belongs to the anchor of that string: the
`gram`-byte substring with the least hash in it, leftmost if several. Equal strings have equal anchors, so only starts
whose anchors agree need comparing, and each anchor owns a run of consecutive starts; the bytes of all strings of a
run are its context. Starts are counted from the anchor: those of a context are an interval of 0 to length - gram. Steps:

1. Each document's runs, with the hash of the anchor and the hash of the context (rows of fixed size, no text).
2. Anchors that occur once drop out. Runs whose whole contexts are equal are settled: all their starts repeat.
3. The distinct contexts of an anchor are the first buckets, of equal q-grams (q = gram). A bucket is refined round by round: the starts are cut into
   intervals, 64 of them at first, then 16, 4 and 1, and an interval's bucket is the identifier of the bucket it was in, with the
   identifiers of the blocks of bytes to the left and right that all strings of the interval share beyond those of the round before. An interval alone in its bucket drops
   out; intervals of equal strings throughout are settled and go on as one, if at all; a bucket whose intervals are all settled is done. A row holds an interval of
   one context and the bytes that later rounds will need, so buckets of any size are refined by grouping, in no one task.
4. Each document's repeated starts, merged to runs, remove the bytes they cover.

Passages of so many words are found the same way, in texts where each word is a code of _CODE bytes, in the same rounds. Identifiers are 64-bit
hashes of content.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, RollingHash, forget, materialise, mix, release

#: Bytes of text hashed at once; positions need 24 bits.
_CHUNK = 1 << 20
#: Bytes that stand for a word where words are compared.
_CODE = 4
_IS_SPACE = np.isin(np.arange(256), np.frombuffer(SPACES.encode(), np.uint8))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive values, by minima from block borders to both sides."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    full = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, values.dtype)
    full[: len(values)] = values
    blocks = full.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


@dataclass(frozen=True)
class Kind:
    """What is compared: strings of so many bytes, of texts or of texts whose words are codes, by anchors of gram bytes."""

    length: int
    gram: int
    words: bool = False

    @property
    def starts(self) -> int:
        return self.length - self.gram + 1


def anchored_runs(texts: list[bytes], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text number, start, number of starts, bytes before the anchor, anchor hash, context hash) of the runs in texts, which have at most 16 MB."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    begins = np.cumsum(sizes) - sizes
    h = RollingHash(data)
    keyed = (h.windows(gram) >> np.uint64(24) << np.uint64(24)) | np.arange(max(0, len(data) - gram + 1), dtype=np.uint64)
    least = sliding_min(keyed, length - gram + 1)
    starts = np.maximum(sizes - length + 1, 0)
    at = np.repeat(begins - (np.cumsum(starts) - starts), starts) + np.arange(starts.sum())
    if not len(at):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    anchor = (least[at] & np.uint64((1 << 24) - 1)).astype(np.int64)
    number = np.repeat(np.arange(len(texts)), starts)
    first = np.flatnonzero(np.concatenate([[True], (np.diff(anchor) != 0) | (np.diff(number) != 0)]))
    last = np.concatenate([first[1:], [len(at)]]) - 1
    a = anchor[first]
    return number[first], at[first] - begins[number[first]], last - first + 1, a - at[first], h(a, a + gram), h(at[first], at[last] + length)


def sizes_of(starts: int) -> list[int]:
    """Sizes of the intervals of each round."""
    sizes = [1]
    while 8 * sizes[0] <= starts:
        sizes.insert(0, 4 * sizes[0])
    return sizes


@dataclass
class Intervals:
    """Of each interval: its kind, bucket, first and beyond last start, and the bytes to the left and right of those its strings share."""

    kind: np.ndarray
    core: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    left: list[bytes]
    right: list[bytes]


def refined(rows: Intervals, kinds: Sequence[Kind], parent: int | None, size: int) -> tuple[np.ndarray, Intervals, np.ndarray]:
    """The row that each smaller interval is of, the intervals, and their identifiers. parent: the size before, None for whole contexts."""
    starts, length = (np.array([getattr(k, x) for k in kinds], np.int64)[rows.kind] for x in ("starts", "length"))
    low = rows.lo // parent * parent if parent else np.zeros_like(rows.lo)
    high = np.minimum(low + parent, starts) if parent else starts
    n = (rows.hi - 1) // size - rows.lo // size + 1
    row = np.repeat(np.arange(len(n)), n)
    cell = (rows.lo // size)[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    first, beyond = cell * size, np.minimum(cell * size + size, high[row])
    lo, hi = np.maximum(rows.lo[row], first), np.minimum(rows.hi[row], beyond)
    hashes, bases = [], []
    for parts in (rows.left, rows.right):
        hashes.append(RollingHash(np.frombuffer(b"".join(parts), np.uint8)))
        sizes = np.array([len(p) for p in parts], np.int64)
        bases.append((np.cumsum(sizes) - sizes)[row])
    # Left bytes are those from lo to high - 1, right ones those from low + length to hi - 1 + length.
    x, y = bases[0] - rows.lo[row], bases[1] - low[row]
    with np.errstate(over="ignore"):
        more = hashes[0](x + beyond - 1, x + high[row] - 1) * np.uint64(0x9E3779B97F4A7C15) + hashes[1](y + low[row], y + first)
        core = mix(rows.core[row] + mix(more) + (cell.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95))
        rest = hashes[0](x + lo, x + beyond - 1) * np.uint64(0x9E3779B97F4A7C15) + hashes[1](y + first, y + hi - 1)
        extent = mix(core + mix(rest) + (lo * (1 << 20) + hi).astype(np.uint64))
    cuts = zip(row.tolist(), (lo - rows.lo[row]).tolist(), (beyond - 1 - rows.lo[row]).tolist(), (first - low[row]).tolist(), (hi - 1 - low[row]).tolist(), strict=True)
    left, right = [], []
    for r, a, b, c, d in cuts:
        left.append(rows.left[r][a:b])
        right.append(rows.right[r][c:d])
    return row, Intervals(rows.kind[row], core, lo, hi, left, right), extent


def _pack(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


_DOC = [("doc_id", pa.int64()), ("tkey", pa.int64())]
_RUNS = pa.schema([("kind", pa.int32()), *_DOC, ("at", pa.int64()), ("width", pa.int64()), ("lead", pa.int64()), ("akey", pa.int64()), ("hctx", pa.int64())])
_RUNS_SQL = "kind int, doc_id long, tkey long, at long, width long, lead long, akey long, hctx long"


def _find_runs(kinds: Sequence[Kind]):
    def flush(k: int, ids: list, texts: list[bytes], bases: list[int]) -> pa.RecordBatch:
        number, start, width, lead, akey, hctx = anchored_runs(texts, kinds[k].length, kinds[k].gram)
        doc, key = zip(*ids, strict=True)
        take = number.tolist()
        akey = mix(akey + np.uint64(k))
        return _pack([np.full(len(take), k), [doc[i] for i in take], [key[i] for i in take], start + np.array(bases, np.int64)[number], width, lead, akey.view(np.int64), hctx.view(np.int64)], _RUNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = [([], [], []) for _ in kinds]
        totals = [0] * len(kinds)
        for batch in batches:
            for doc, key, text in zip(batch["doc_id"].to_pylist(), batch["tkey"].to_pylist(), batch["text"], strict=True):
                text = text.as_py()
                for k, kind in enumerate(kinds):
                    data = _coded(text) if kind.words else text
                    for base in range(0, max(len(data) - kind.length + 1, 0), _CHUNK):
                        part = data[base : base + _CHUNK + kind.length - 1]
                        if waiting[k][0] and totals[k] + len(part) > _CHUNK:
                            yield flush(k, *waiting[k])
                            waiting[k], totals[k] = ([], [], []), 0
                        for column, value in zip(waiting[k], ((doc, key), part, base), strict=True):
                            column.append(value)
                        totals[k] += len(part)
        for k, columns in enumerate(waiting):
            if columns[0]:
                yield flush(k, *columns)
        waiting.clear()
        release()

    return run


_ROWS = pa.schema([("kind", pa.int32()), ("core", pa.int64()), ("extent", pa.int64()), ("once", pa.bool_()), *_DOC, ("origin", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("left", pa.binary()), ("right", pa.binary())])
_ROWS_SQL = "kind int, core long, extent long, once boolean, doc_id long, tkey long, origin long, lo long, hi long, left binary, right binary"
#: Bytes refined at once.
_AT_ONCE = 1 << 21


def _smaller(rows: list[tuple], kinds: Sequence[Kind], parent: int | None, size: int) -> pa.RecordBatch:
    """rows: kind, core, once, doc_id, tkey, origin, lo, hi, left, right."""
    kind, core, once, doc, key, origin, lo, hi, left, right = zip(*rows, strict=True)
    row, found, extent = refined(Intervals(np.array(kind, np.int64), np.array(core, np.int64).view(np.uint64), np.array(lo, np.int64), np.array(hi, np.int64), list(left), list(right)), kinds, parent, size)
    take = row.tolist()
    return _pack([found.kind, found.core.view(np.int64), extent.view(np.int64), *([x[i] for i in take] for x in (once, doc, key, origin)), found.lo, found.hi, found.left, found.right], _ROWS)


def _first_intervals(kinds: Sequence[Kind], size: int):
    """Over documents with their wanted contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, total = [], 0
        for batch in batches:
            for doc, key, text, wanted in zip(batch["doc_id"].to_pylist(), batch["tkey"].to_pylist(), batch["text"], batch["wanted"], strict=True):
                text, coded = text.as_py(), None
                for w in wanted.as_py():
                    kind = kinds[w["kind"]]
                    if kind.words and coded is None:
                        coded = _coded(text)
                    anchor = w["at"] + w["lead"]
                    context = (coded if kind.words else text)[w["at"] : w["at"] + w["width"] + kind.length - 1]
                    lo = kind.starts - 1 - w["lead"]
                    rows.append((w["kind"], w["akey"], w["once"], doc, key, anchor - kind.starts + 1, lo, lo + w["width"], context[: w["lead"]], context[w["lead"] + kind.gram :]))
                    total += len(context)
                    if total > _AT_ONCE:
                        yield _smaller(rows, kinds, None, size)
                        rows, total = [], 0
        if rows:
            yield _smaller(rows, kinds, None, size)
        rows = []
        release()

    return run


def _next_intervals(kinds: Sequence[Kind], parent: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _smaller(list(zip(*(batch[c].to_pylist() for c in ("kind", "core", "once", "doc_id", "tkey", "origin", "lo", "hi", "left", "right")), strict=True)), kinds, parent, size)

    return run


def _word_bounds(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words between ASCII white space."""
    inside = ~_IS_SPACE[np.frombuffer(text, np.uint8)]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], inside.astype(np.int8), [0]])))
    return edges[::2], edges[1::2]


def _coded(text: bytes) -> bytes:
    """The text as the codes of its words: strings of words are strings of bytes."""
    h = RollingHash(np.frombuffer(text, np.uint8))(*_word_bounds(text))
    return h.view(np.uint8).reshape(-1, 8)[:, :_CODE].tobytes()


def _merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _covered(text: bytes, runs: list[dict] | None, kinds: Sequence[Kind]) -> tuple[list[list[int]], list[tuple[int, int]], int]:
    """Spans of repeated bytes, spans of repeated words, and how many words these are."""
    by_byte, by_word, n_words = [], [], 0
    for k, kind in enumerate(kinds):
        spans = _merged([(x["at"], x["at"] + x["width"] - 1 + kind.length) for x in runs or [] if x["kind"] == k])
        if not kind.words:
            by_byte = spans
        elif spans:
            starts, ends = _word_bounds(text)
            for a, b in spans:  # only words covered in full
                first, last = -(-a // _CODE), b // _CODE - 1
                by_word.append((int(starts[first]), int(ends[last])))
                n_words += last - first + 1
    return by_byte, by_word, n_words


def _without(text: bytes, spans: list[list[int]]) -> bytes:
    return b"".join(text[a:b] for a, b in zip([0, *(s[1] for s in spans)], [*(s[0] for s in spans), len(text)], strict=True))


def _cut(kinds: Sequence[Kind], with_text: bool, keep: Sequence[str]):
    passages = any(kind.words for kind in kinds)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())] + [("n_passage_words", pa.int64())] * passages + [("spans", pa.list_(pa.list_(pa.int64()))), ("kept", pa.binary())] * with_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, runs in zip(batch["doc_id"].to_pylist(), batch["text"], batch["runs"], strict=True):
                text = text.as_py()
                spans, _, n_words = _covered(text, runs.as_py(), kinds)
                kept = _without(text, spans)
                rows.append((doc, len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()) + (n_words,) * passages + (spans, kept) * with_text)
            if rows:
                out = _pack(list(zip(*rows, strict=True)), schema)
                yield pa.RecordBatch.from_arrays([*out.columns, *(batch[c] for c in keep)], names=[*schema.names, *keep])

    return run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", n_passage_words long" * passages + ", spans array<array<long>>, kept binary" * with_text


def _cut_both(kinds: Sequence[Kind], keep: Sequence[str]):
    """The text without its runs of repeated bytes and of repeated words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, runs in zip(batch["text"], batch["runs"], strict=True):
                text = text.as_py()
                by_byte, by_word, _ = _covered(text, runs.as_py(), kinds)
                rows.append(_without(text, _merged([*map(tuple, by_byte), *by_word])))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(rows, pa.binary()), *(batch[c] for c in keep)], names=["doc_id", "kept", *keep])

    return run


def _bytes_of(docs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    text = F.coalesce("text", F.lit("")).cast("binary").alias("text")
    return docs.select("doc_id", text, *keep).withColumn("tkey", F.xxhash64("text"))


def _repeated(base: DataFrame, kinds: Sequence[Kind]) -> DataFrame:
    """(d, k, runs) of the documents of base (doc_id, tkey, text) in which strings recur: their starts as (kind, at, width)."""
    place = ["kind", "doc_id", "tkey", "at", "width"]
    every = materialise(base.mapInArrow(_find_runs(kinds), _RUNS_SQL), "runs")
    again = materialise(every.groupBy("akey").agg(F.count("*").alias("n")).where("n > 1").select("akey"), "shared-anchors")
    runs = materialise(every.join(again, "akey", "left_semi"), "shared-runs")
    contexts = runs.groupBy("akey", "hctx").agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in (*place, "lead")))
    contexts = materialise(contexts, "contexts")
    forget(every, again)
    whole = materialise(contexts.where("n > 1").select("akey", "hctx"), "whole-contexts")
    found = [materialise(runs.join(whole, ["akey", "hctx"], "left_semi").select(*place), "repeated")]
    several = contexts.groupBy("akey").agg(F.count("*").alias("m"), F.min("n").alias("least")).where("m > 1 AND least = 1").select("akey")
    several = materialise(several, "open-anchors")
    wanted = contexts.join(several, "akey", "left_semi").groupBy(F.col("doc_id").alias("d"), F.col("tkey").alias("k"))
    wanted = wanted.agg(F.collect_list(F.struct("kind", "akey", (F.col("n") == 1).alias("once"), "at", "width", "lead")).alias("wanted"))  # a document's own
    texts = base.join(wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tkey") == F.col("k"))).select("doc_id", "tkey", "text", "wanted")
    sizes = sizes_of(max(kind.starts for kind in kinds))
    rows = materialise(texts.mapInArrow(_first_intervals(kinds, sizes[0]), _ROWS_SQL), "intervals")
    forget(runs, contexts, whole, several)
    one = F.struct("kind", "doc_id", "tkey", "origin", "lo", "hi", "left", "right")
    for size, following in zip(sizes, [*sizes[1:], None], strict=True):
        groups = rows.groupBy("core", "extent").agg(F.count("*").alias("n"), F.min("once").alias("once"), F.first(one).alias("one"))
        groups = materialise(groups.withColumn("once", F.col("once") & (F.col("n") == 1)), "buckets")
        equal = materialise(groups.where("n > 1").select("core", "extent"), "equal-intervals")
        settled = rows.where("once").join(equal, ["core", "extent"], "left_semi")
        found.append(materialise(settled.select("kind", "doc_id", "tkey", (F.col("origin") + F.col("lo")).alias("at"), (F.col("hi") - F.col("lo")).alias("width")), "repeated"))
        forget(rows, equal)
        if following is None:
            forget(groups)
            break
        alive = groups.groupBy("core").agg(F.count("*").alias("m"), F.max("once").alias("any")).where("m > 1 AND any").select("core")
        alive = materialise(alive, "open-buckets")
        rows = groups.join(alive, "core", "left_semi").select("core", "once", "one.*")
        rows = materialise(rows.mapInArrow(_next_intervals(kinds, size, following), _ROWS_SQL), "intervals")
        forget(groups, alive)
    starts = found[0]
    for more in found[1:]:
        starts = starts.unionByName(more)
    starts = starts.groupBy("doc_id", "tkey").agg(F.collect_list(F.struct("kind", "at", "width")).alias("runs"))  # a document's own runs
    return starts.select(F.col("doc_id").alias("d"), F.col("tkey").alias("k"), "runs")


def kinds_of(length: int, gram: int, words: int | None) -> list[Kind]:
    kinds = [Kind(length, min(gram, length))]
    return kinds if words is None else [*kinds, Kind(words * _CODE, min(words, 10) * _CODE, True)]


def remove_repeats(docs: DataFrame, length: int = 400, gram: int = 64, with_text: bool = True, keep: Sequence[str] = (), words: int | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256; if asked for, n_passage_words; spans ([start, end) pairs) and kept (bytes); then the string columns keep.

    Every byte covered by a string of `length` bytes that also starts anywhere else, in any document or the same one, is
    removed; strings are judged on the input. Null text counts as empty; texts shorter than length lose nothing. Very long texts are gone through in
    chunks that overlap. A repeated row is another document: its strings all recur. doc_id may be null or repeated, since a document is
    known by doc_id and text hash. Other columns are not read. An empty table gives an empty result.
    words: if given, n_passage_words counts the words in runs of so many words (between ASCII white space) that also start anywhere else; they are not removed.
    """
    kinds = kinds_of(length, gram, words)
    found = _repeated(_bytes_of(docs), kinds)
    both = _bytes_of(docs, keep).join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tkey") == F.col("k")), "left")
    run, schema = _cut(kinds, with_text, keep)
    return both.select("doc_id", "text", "runs", *keep).mapInArrow(run, schema + "".join(f", {c} string" for c in keep))


def remove_passages(docs: DataFrame, words: int = 51, length: int = 400, keep: Sequence[str] = ()) -> DataFrame:
    """One row per row of docs: doc_id, kept (bytes), then the string columns keep.

    Removed are the bytes that remove_repeats removes, and every run of `words` words (between ASCII white space, whatever the
    white space) that also starts anywhere else, from its first byte to its last. Words are compared by 32-bit hashes. Null, empty and very long texts, repeated
    rows, other columns and empty tables are as for remove_repeats.
    """
    kinds = kinds_of(length, 64, words)
    found = _repeated(_bytes_of(docs), kinds)
    both = _bytes_of(docs, keep).join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tkey") == F.col("k")), "left")
    return both.select("doc_id", "text", "runs", *keep).mapInArrow(_cut_both(kinds, keep), "doc_id long, kept binary" + "".join(f", {c} string" for c in keep))
