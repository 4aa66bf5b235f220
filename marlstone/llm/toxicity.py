"""Toxicity by a convolutional text classifier trained in numpy.

Words (lower-cased A-Z, outer punctuation off) are embedded as the sum of two rows of a hashed table. Filters one, two
and three words wide slide over a text, each keeps its largest response, and a logistic layer reads these maxima. All of it is trained by Adagrad from noise, on batches with as many toxic
texts as others. At first the maximum is a soft one (the logarithm of the mean exponential), through which every word of a text learns; it hardens step by step, and the last quarter of the
steps trains on the largest response alone, as texts are scored.

A filter of width k responds with a sum of k terms, one for each of its words, so scoring looks up each distinct word's
terms once and adds. Thresholds are set for each language on labelled rows that training has not seen: the one of the best F1, drawn towards
that of all languages, and that towards 0.7, the more the fewer toxic rows it rests on.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, materialise, release

_TRIM = b".,;:!?\"'()[]{}<>*&%#$@~`^_=+|/\\-"
_TOKENS_AT_ONCE = 50_000


@dataclass
class Model:
    table: np.ndarray  # rows by dimensions
    filters: list[np.ndarray]  # by width: (width, dimensions, filters)
    shift: np.ndarray  # by filter of all widths
    weight: np.ndarray
    bias: float
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.7


def tokens_of(text: bytes) -> list[bytes]:
    return text.translate(LOWER).split()


def rows_of(words: list[bytes], bits: int) -> np.ndarray:
    """The two table rows of each word."""
    out = np.empty((len(words), 2), np.int64)
    for i, w in enumerate(words):
        w = w.strip(_TRIM) or w
        h = xxhash.xxh64_intdigest(w)
        out[i] = h & 0xFFFFFFFF, h >> 32
    return out & ((1 << bits) - 1)


def respond(model: Model, parts: list[np.ndarray], vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Filter responses at each position of texts padded with two empty words, and the places where texts start.

    parts: of each text, the indices of its words in vectors, whose last row is the empty word.
    """
    pad = np.full(2, len(vectors) - 1)
    sizes = np.array([len(p) + 1 for p in parts])
    at = np.concatenate([x for p in parts for x in (p, pad[:1])] + [pad])
    columns = []
    for f in model.filters:
        terms = [vectors @ f[j] for j in range(len(f))]
        out = terms[0][at[:-2]]
        for j in range(1, len(f)):
            out = out + terms[j][at[j : len(at) - 2 + j]]
        columns.append(out)
    return np.concatenate(columns, axis=1), np.cumsum(sizes) - sizes


def logits(model: Model, parts: list[np.ndarray], vectors: np.ndarray) -> np.ndarray:
    responses, starts = respond(model, parts, vectors)
    top = np.maximum.reduceat(responses, starts, axis=0)
    return np.maximum(top + model.shift, 0) @ model.weight + model.bias


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def train(texts: list[np.ndarray], labels: np.ndarray, bits: int, seed: int = 7, dims: int = 8, filters: int = 8, steps: int = 600, rate: float = 0.1, batch: int = 32, decay: float = 1e-4, window: int = 1500) -> Model:
    """texts: of each, the (n, 2) table rows of its words; both labels must occur.

    A step sees a random window of so many words of longer texts. Each text is seen at least about twice.
    """
    rng = np.random.default_rng(seed)
    size = 1 << bits
    total, soft, hardness = max(steps, 2 * len(texts) // batch), 0.75, (0.5, 12.0)
    n = 3 * filters
    table = rng.normal(0, 0.1, (size, dims)).astype(np.float32)
    model = Model(table, [rng.normal(0, 0.4 / np.sqrt(w), (w, dims, filters)) for w in (1, 2, 3)], np.zeros(n), np.abs(rng.normal(0, 0.3, n)) * rng.choice([-1, 1], n), 0.0)
    sums = {k: np.full(np.shape(v), 1e-4) for k, v in (("shift", model.shift), ("weight", model.weight), ("bias", 0.0), *((f"f{i}", f) for i, f in enumerate(model.filters)))}
    seen = np.full((size, dims), 1e-4, np.float32)

    def step(name: str, value, gradient):
        sums[name] += gradient**2
        return value - rate * gradient / np.sqrt(sums[name])

    def endless(of: np.ndarray) -> Iterator[int]:
        while True:
            yield from rng.permutation(of)

    toxic, others = endless(np.flatnonzero(labels > 0)), endless(np.flatnonzero(labels <= 0))
    for t in range(total):
        done = t / total
        some = np.array([next(of) for of in (toxic, others) for _ in range(batch // 2)])
        picked = []
        for i in some:
            at = rng.integers(0, max(len(texts[i]) - window, 0) + 1)
            picked.append(texts[i][at : at + window])
        unique, index = np.unique(np.concatenate(picked), axis=0, return_inverse=True)
        empty = len(unique)
        vectors = np.concatenate([model.table[unique[:, 0]] + model.table[unique[:, 1]], np.zeros((1, dims), np.float32)])
        parts = np.split(index.ravel(), np.cumsum([len(x) for x in picked])[:-1])
        responses, starts = respond(model, parts, vectors)
        sizes = np.diff(np.append(starts, len(responses)))
        of = np.repeat(np.arange(len(some)), sizes)
        top = np.maximum.reduceat(responses, starts, axis=0)
        if done < soft:
            hard = hardness[0] * (hardness[1] / hardness[0]) ** (done / soft)
            share = np.exp(hard * (responses - top[of]))
            whole = np.add.reduceat(share, starts, axis=0)
            share /= whole[of]
            top = top + np.log(whole / sizes[:, None]) / hard
        else:
            share = (responses == top[of]).astype(float)
            share /= np.add.reduceat(share, starts, axis=0)[of]
        slope = np.where(top + model.shift > 0, 1.0, 0.1 if done < soft else 0.0)  # filters that are off still learn at first
        active = (top + model.shift) * slope
        error = (sigmoid(active @ model.weight + model.bias) - labels[some]) / len(some)
        back = error[:, None] * model.weight * slope
        spread = share * back[of]
        at = np.concatenate([x for p in parts for x in (p, [empty])] + [[empty, empty]])
        moved = np.zeros_like(vectors, np.float64)
        for k, f in enumerate(model.filters):
            own = spread[:, k * filters : (k + 1) * filters]
            g = np.zeros_like(f)
            for j in range(len(f)):
                words = at[j : len(at) - 2 + j]
                g[j] = vectors[words].T @ own
                to_words = own @ f[j].T
                for d in range(dims):
                    moved[:, d] += np.bincount(words, to_words[:, d], len(vectors))
            model.filters[k] = step(f"f{k}", f, g + decay * f)
        for col in (0, 1):
            rows = unique[:, col]
            g = moved[:-1] + decay * model.table[rows]
            np.add.at(seen, rows, (g**2).astype(np.float32))
            np.add.at(model.table, rows, (-rate * g / np.sqrt(seen[rows])).astype(np.float32))
        model.weight = step("weight", model.weight, error @ active + decay * model.weight)
        model.shift = step("shift", model.shift, back.sum(axis=0))
        model.bias = float(step("bias", model.bias, error.sum()))
    model.filters = [f.astype(np.float32) for f in model.filters]
    return model


def calibrated(scores: np.ndarray, labels: np.ndarray, default: float, drawn: float = 20.0) -> float:
    """The threshold of the best F1, of all that give it the one closest to default, drawn towards default as if by `drawn` toxic rows more; default if a class is missing."""
    if not labels.any() or labels.all():
        return default
    order = np.argsort(scores)
    s, y = scores[order], labels[order]
    cuts = [(2 * y[i:].sum() / (len(y) - i + y.sum()), i) for i in range(len(y)) if not i or s[i] > s[i - 1]]
    best = max(f for f, _ in cuts)
    spans = [(s[i - 1] + (s[i] - s[i - 1]) / 100 if i else 0.0, s[i]) for f, i in cuts if f == best]
    found = min((min(max(default, low), high) for low, high in spans), key=lambda t: abs(t - default))
    return float((y.sum() * found + drawn * default) / (y.sum() + drawn))


def remainder(doc_id: Column, n: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def fit(docs: DataFrame, labels: DataFrame, sample: int = 4000, bits: int = 18, learn_from: Column | None = None, sample_words: int = 8_000_000) -> Model | None:
    """Train on at most `sample` labelled rows of each class (the least hashes of doc_id), each with at most an eighth of sample_words of its words.

    Every fourth of them is kept from training and sets the thresholds. labels: doc_id, toxic; of repeated ids the largest
    label counts, null labels don't; of documents with one id the least text counts. If the rows have over sample_words words together, those that do not fit any more, in the order of
    their hashes, are left out, so what the driver gathers is bounded whatever the lengths. None if a class is missing, or no words may be gathered. learn_from: the rows of labels that may be seen.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (learn_from if learn_from is not None else F.lit(True)))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    by_hash = F.xxhash64("doc_id")
    chosen = known.where("toxic = 1").orderBy(by_hash, "doc_id").limit(sample).union(known.where("toxic = 0").orderBy(by_hash, "doc_id").limit(sample))
    text = F.coalesce("text", F.lit("")).cast("binary")
    most = sample_words // 8
    if most < 1:
        return None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [rows_of(tokens_of(t.as_py())[:most], bits).astype("<i4").tobytes() for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["toxic"], batch["lang"], pa.array(found, pa.binary())], names=["doc_id", "toxic", "lang", "words"])

    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select("doc_id", lang.alias("lang"), text.alias("text")).join(F.broadcast(chosen), "doc_id")  # 2 * sample rows
    rows = rows.groupBy("doc_id", "toxic").agg(F.min(F.struct("text", "lang")).alias("one")).select("doc_id", "toxic", "one.text", "one.lang")
    rows = materialise(rows.mapInArrow(read, "doc_id long, toxic int, lang string, words binary"), "labelled")
    sizes = rows.select("doc_id", "toxic", F.expr("octet_length(words) div 8").alias("n")).collect()  # numbers, 2 * sample of them
    sizes.sort(key=lambda r: zlib.crc32(b"order%d" % r["doc_id"]))
    within, total = [], 0
    for r in sizes:
        if total + r["n"] <= sample_words:
            within.append(r["doc_id"])
            total += r["n"]
    if len(within) < len(sizes):
        rows = rows.join(F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in within], "doc_id long")), "doc_id", "left_semi")
    rows = [(zlib.crc32(b"order%d" % r["doc_id"]), r["doc_id"], r["toxic"], r["lang"], r["words"]) for r in rows.toLocalIterator()]  # a partition's at a time
    rows.sort(key=lambda r: r[:2])
    if len({r[2] for r in rows}) < 2:
        return None
    words = [np.frombuffer(r[4], "<i4").reshape(-1, 2) for r in rows]
    y = np.array([r[2] for r in rows], float)
    held = np.arange(len(rows)) % 4 == 3
    if not 0 < y[~held].sum() < (~held).sum():
        held[:] = False
    seen = np.flatnonzero(~held)
    model = train([words[i] for i in seen], y[seen], bits)
    if held.any():
        late = np.flatnonzero(held)
        scores = np.array([score_rows(model, [words[i]])[0] for i in late])
        model.threshold = calibrated(scores, y[late] > 0, model.threshold)
        spoken = np.array([rows[i][3] or "" for i in late])
        for name in sorted(set(spoken) - {""}):
            own = spoken == name
            model.thresholds[str(name)] = calibrated(scores[own], y[late][own] > 0, model.threshold)
    del rows, words
    release()
    return model


def score_rows(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    rows = np.concatenate([*texts, np.zeros((0, 2), np.int64)])
    vectors = np.concatenate([model.table[rows[:, 0]] + model.table[rows[:, 1]], np.zeros((1, model.table.shape[1]), np.float32)])
    ends = np.cumsum([len(t) for t in texts])
    return sigmoid(logits(model, np.split(np.arange(len(rows)), ends[:-1]), vectors))


def _scorer(model: Model, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: dict[bytes, int] = {}
        vectors = np.zeros((0, model.table.shape[1]), np.float32)

        def scores(group: list[list[bytes]]) -> np.ndarray:
            nonlocal vectors
            if len(ids) > 100_000:
                ids.clear()
                vectors = vectors[:0]
            known = len(ids)
            parts = [np.array([ids.setdefault(w, len(ids)) for w in words], np.int64) for words in group]
            if len(ids) > known:
                rows = rows_of(list(ids)[known:], bits)
                vectors = np.concatenate([vectors, model.table[rows[:, 0]] + model.table[rows[:, 1]]])
            used, at = np.unique(np.concatenate([*parts, np.zeros(0, np.int64)]), return_inverse=True)
            own = np.concatenate([vectors[used], np.zeros((1, vectors.shape[1]), np.float32)])
            return sigmoid(logits(model, np.split(at, np.cumsum([len(p) for p in parts])[:-1]), own))

        for batch in batches:
            out, group, total = [], [], 0
            for text in batch["_text"]:
                words = tokens_of(text.as_py())
                if group and total + len(words) > _TOKENS_AT_ONCE:
                    out.append(scores(group))
                    group, total = [], 0
                group.append(words)
                total += len(words)
            if group:
                out.append(scores(group))
            if out:
                yield pa.RecordBatch.from_arrays([*(batch[c] for c in batch.schema.names if c != "_text"), pa.array(np.concatenate(out), pa.float64())], names=[*(c for c in batch.schema.names if c != "_text"), "score"])
        ids, vectors = {}, vectors[:0]
        release()

    return run


def score(docs: DataFrame, model: Model | None, bits: int = 18, keep: Sequence[str] = ("doc_id", "lang")) -> DataFrame:
    """One row per row of docs: the columns keep, score (0 to 1), threshold of its language, toxic (score >= threshold).

    Only the text decides the score; null and empty texts get that of an empty text. Without a model (a class had no labels) every
    score is 0. Very long texts are scored whole, in groups of their own. Repeated rows and null doc_ids keep their rows; an empty table gives an empty
    result; other columns are not read.
    """
    if "lang" not in docs.columns:
        docs = docs.withColumn("lang", F.lit(None).cast("string"))
    kept = docs.select(*keep)
    base = docs.select(*keep, F.coalesce("text", F.lit("")).cast("binary").alias("_text"))
    if model is None:
        out, limits, default = kept.withColumn("score", F.lit(0.0)), {}, 0.7
    else:
        out, limits, default = base.mapInArrow(_scorer(model, bits), T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType())])), model.thresholds, model.threshold
    if "lang" not in keep:
        limits = {}
    threshold = F.lit(default)
    for name, value in limits.items():
        threshold = F.when(F.col("lang") == name, F.lit(value)).otherwise(threshold)
    return out.withColumn("threshold", threshold).withColumn("toxic", F.col("score") >= F.col("threshold"))
