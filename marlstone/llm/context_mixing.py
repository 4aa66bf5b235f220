"""Language-model scores by logistic context mixing.

A text is coded as its words: the bytes of each and a space, and a line end after the last. Before a word one bit says whether the text repeats
itself, if it can: whether the word is the one that followed when the word before last occurred in this text. Its predictor's context reaches over the words before: how long
the text has been repeating itself so far, and whether the word before that agrees too. A word that isn't told so is spelt, after a bit for whether it is long.

Each bit of a spelt byte is predicted by contexts: the last one, two, three, four and six bytes of the word, all of the word so far in texts of the same class, and
in all texts. Each context has seen a number of zeros and ones; their log odds are combined by weights that two gates select (how often the whole-word
contexts have been seen and how many of the others; the bit's place and the byte's), and the result is refined by an adaptive table of what such predictions came to. The predictors count
all training text; weights and refinement are learnt online over all training words, each predicted as if one occurrence less had been counted and weighed by its
true count.

The short contexts are hashed into tables of a fixed size, without check bytes. Whole-word contexts are exact and grow with the corpus: they stay in the buckets
that hold the vocabulary. A word's family is its first 4 bytes, or 12 if it is long (over 12 bytes); a family is in one bucket, where
contexts longer than that are counted over sorted words; shorter ones are in tables too. A text's class is a hash of its commonest letter outside ASCII, which tells languages and scripts
apart; it is coded first, so probabilities of all texts still sum to at most 1. Within a class no spelt byte's context reaches across words, so a distinct word has
one cost in a class, however often it occurs, and words that begin alike share the costs of what they begin with. Steps:

1. Documents are read once. Each block of them yields its distinct words with their training counts, dealt by family into buckets,
   and for each document the numbers of its words in the block. How many buckets there are depends on the documents alone, so results don't depend on the cluster.
2. Buckets add up the counts of words over all blocks: the vocabulary grows with the corpus and stays distributed.
3. Tables are summed over the vocabulary, weights are learnt chunk by chunk of it and averaged; both have a fixed size and are broadcast.
4. Buckets score their words and answer each block's request; blocks add up their documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, RollingHash, materialise, mix, release

ORDERS = (1, 2, 3, 4, 6)
TABLE_BITS = 20
#: Tables of the orders, and of whole-word contexts within a class and in all texts.
TABLES = len(ORDERS) + 2
INPUTS = TABLES + 1
#: Long words have more bytes than this; bytes that make a family, by whether the word is long.
LONG, FAMILY = 12, (4, 12)
#: The two gates' values, cells of the refinement, and how far log odds go.
LEVELS = 4
GATE_1, GATE_2, CELLS, FAR = LEVELS * LEVELS * (len(ORDERS) + 1), 32, 33, 12.0
CLASSES = 8
#: Contexts of the bit for repetition: seven lengths so far, whether one more word agrees, whether the word is the last one again.
REPEATS = 7 * 2 * 2
_PART = 1 << 16
_LEARN_EDGES = 4096
_CHUNK_WORDS = 20_000


@dataclass
class Mixer:
    tables: np.ndarray  # (tables, slots, 2): zeros and ones seen
    first: np.ndarray  # weights by gate 1
    second: np.ndarray  # by gate 2
    cells: np.ndarray  # (gate 1, cells, 2)
    spread_1: np.ndarray | None = None  # running mean squares of the gradients, while learning
    spread_2: np.ndarray | None = None

    @classmethod
    def fresh(cls, tables: np.ndarray) -> Mixer:
        """Weights to start from: the more often whole-word contexts have been seen, the more they count."""
        first = np.zeros((GATE_1, INPUTS))
        for gate in range(GATE_1):
            own, every, seen = gate // (LEVELS * (len(ORDERS) + 1)), gate // (len(ORDERS) + 1) % LEVELS, gate % (len(ORDERS) + 1)
            short = np.zeros(len(ORDERS))
            short[: max(seen, 1)] = 0.4 * 0.5 ** np.arange(max(seen, 1))[::-1]
            known = max(own, every)
            first[gate, : len(ORDERS)] = short * (1, 0.7, 0.35, 0.1)[known]
            first[gate, len(ORDERS)] = (0, 0.3, 0.5, 0.7)[own]
            first[gate, len(ORDERS) + 1] = (0, 0.3, 0.5, 0.7)[every] * (1, 0.7, 0.5, 0.3)[own]
        return cls(tables, first, np.zeros((GATE_2, INPUTS)), np.zeros((GATE_1, CELLS, 2)), np.full((GATE_1, INPUTS), 0.1), np.full((GATE_2, INPUTS), 0.1))


def family_of(word: bytes) -> bytes:
    long = len(word) > LONG
    return bytes([long]) + word[: FAMILY[long]]


def order_of(word: bytes) -> tuple[bool, bytes]:
    """Long words apart, each as it is spelt: so families are side by side."""
    return len(word) > LONG, word + b" "


def bucket_of(word: bytes, buckets: int) -> int:
    return zlib.crc32(family_of(word)) % buckets


def class_of(text: bytes) -> int:
    """0 without letters outside ASCII, else a hash of the first two bytes of the commonest one."""
    data = np.frombuffer(text, np.uint8)
    lead = np.flatnonzero(data[:-1] >= 0xC0)
    if not len(lead):
        return 0
    pairs = data[lead].astype(np.int64) << 8 | data[lead + 1]
    return 1 + zlib.crc32(int(np.bincount(pairs).argmax()).to_bytes(2, "big")) % (CLASSES - 1)


def repeats_of(seq: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each word: the context of its bit for repetition, or -1 if there is none, and the bit. order: places by word, then as they are."""
    n = len(seq)
    before = np.full(n, -1)
    same = np.flatnonzero(seq[order[1:]] == seq[order[:-1]])
    before[order[same + 1]] = order[same]
    q = np.concatenate([[-1], before[:-1]])  # where the last word occurred before
    can = q >= 0
    hit = can & (seq[np.minimum(q + 1, n - 1)] == seq)
    missed = np.maximum.accumulate(np.where(hit, -1, np.arange(n)))
    run = np.concatenate([[0], np.arange(n) - missed])[:n]  # hits just before
    size = np.searchsorted([1, 2, 3, 4, 8, 16], run, "right")
    t = np.arange(n)
    agrees = can & (q >= 1) & (t >= 2) & (seq[np.maximum(q - 1, 0)] == seq[np.maximum(t - 2, 0)])
    again = can & (q + 1 == t - 1)
    return np.where(can, (size * 2 + agrees) * 2 + again, -1), hit


@dataclass
class Edges:
    """Bytes of words after what precedes them in the word, each distinct one once for each class that asks.

    byte, place: the byte and how many precede it. shallow: whether whole-word contexts are in the tables. contexts: by table. seen: whole-word counts (8
    bits, 2, edges) by class and in all texts. times: how often training text has it, in the class. owner, of: the pair of word and class and the edge of each byte to be spelt.
    """

    byte: np.ndarray
    place: np.ndarray
    shallow: np.ndarray
    contexts: np.ndarray
    seen: tuple[np.ndarray, np.ndarray]
    times: np.ndarray
    owner: np.ndarray
    of: np.ndarray


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the run of equal keys that each is in."""
    change = np.diff(keys, prepend=keys[0] - 1) != 0
    starts = np.flatnonzero(change)
    run = np.cumsum(change) - 1
    return starts[run], np.append(starts[1:], len(keys))[run]


def edges_of(words: list[bytes], counts: np.ndarray, pair_word: np.ndarray, pair_class: np.ndarray, with_seen: bool = True) -> Edges:
    """words: whole families, in their order. counts: (words, classes) of training text. pairs: what is to be spelt. with_seen: whether whole-word counts are wanted."""
    data = np.frombuffer(b"".join([w + b" " if w else b"\n" for w in words]), np.uint8)
    sizes = np.array([len(w) + 1 for w in words], np.int64)
    start = np.cumsum(sizes) - sizes
    word = np.repeat(np.arange(len(words)), sizes)
    at = np.arange(len(data))
    long = sizes - 1 > LONG
    h = RollingHash(data)
    begin = start[word]
    depth = at - begin
    # Words are sorted: what begins alike is side by side, so at each depth a byte is a new one unless the word before has it after the same beginning.
    whole = h(begin, at + 1)
    before = np.maximum(word - 1, 0)
    there = (word > 0) & (depth < sizes[before]) & (long[word] == long[before])
    same = there & (whole[np.minimum(start[before] + depth, len(data) - 1)] == whole)
    by_depth = np.argsort(depth.astype(np.uint16) if len(data) and depth.max() < 1 << 16 else depth, kind="stable")
    index = np.empty(len(data), np.int64)
    fresh = ~same[by_depth]
    index[by_depth] = np.cumsum(fresh) - 1
    first = by_depth[fresh]
    byte = data[first].astype(np.int64)
    up = h(begin[first], first)
    other = np.concatenate([[True], (up[1:] != up[:-1]) | (depth[first[1:]] != depth[first[:-1]]) | (long[word[first[1:]]] != long[word[first[:-1]]])])[: len(first)]
    keys = (np.cumsum(other) - 1) * 256 + byte
    by_class = np.stack([np.bincount(index, counts[word, z], len(first)) for z in range(CLASSES)], axis=1)
    # Pairs of word and class: the bytes each spells.
    n = sizes[pair_word]
    owner = np.repeat(np.arange(len(pair_word)), n)
    spelt = np.repeat(start[pair_word] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    key = index[spelt] * CLASSES + pair_class[owner]
    wanted = np.zeros(len(first) * CLASSES, bool)
    wanted[key] = True
    asked, of = np.flatnonzero(wanted), (np.cumsum(wanted) - 1)[key]
    edge, z = asked // CLASSES, asked % CLASSES
    seen = tuple(np.zeros((8, 2, len(edge) if with_seen else 0), np.float32) for _ in range(2))
    if with_seen and len(first):
        sums = np.concatenate([np.zeros((1, CLASSES)), np.cumsum(by_class, axis=0)])
        total = sums.sum(axis=1)
        low, high = _runs(keys)
        for j in range(8):
            one = byte >> j & 1 > 0
            middle = np.where(one, low, high)
            low, high = _runs(keys >> (j + 1))
            a, b, c = low[edge], middle[edge], high[edge]
            x, y, w = sums[a, z], sums[b, z], sums[c, z]
            seen[0][j, 0], seen[0][j, 1] = y - x, w - y
            x, y, w = total[a], total[b], total[c]
            seen[1][j, 0], seen[1][j, 1] = y - x, w - y
    f, s = first[edge], begin[first[edge]]
    place, is_long = f - s, long[word[f]]
    salt = (z * 2 + is_long).astype(np.uint64)
    contexts = [mix(h(np.maximum(s, f - k), f) + (salt + np.uint64(i * 64)) * np.uint64(0x9E3779B97F4A7C15)) for i, k in enumerate(ORDERS)]
    contexts += [mix(h(s, f) + (salt + np.uint64(1000)) * np.uint64(0x9E3779B97F4A7C15)), mix(h(s, f) + (is_long.astype(np.uint64) + np.uint64(2000)) * np.uint64(0x9E3779B97F4A7C15))]
    return Edges(byte[edge], place, place < np.array(FAMILY)[is_long.astype(int)], np.stack(contexts), seen, by_class[edge, z], owner, of)


def slots_of(contexts: np.ndarray, node: np.ndarray) -> np.ndarray:
    return ((contexts + node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD1342543DE82EF95) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def count_bits(edges: Edges, tables: np.ndarray) -> None:
    """Add the bits of the edges to tables, each as often as training text has it."""
    weight = edges.times.astype(np.float32)
    for j in range(8):
        slots, bit = slots_of(edges.contexts, (edges.byte | 256) >> (j + 1)), edges.byte >> j & 1
        for i in range(TABLES):
            some = slice(None) if i < len(ORDERS) else np.flatnonzero(edges.shallow)
            np.add.at(tables[i].reshape(-1), (slots[i] * 2 + bit)[some], weight[some])


def _predict(mixer: Mixer, e: Edges, some: np.ndarray | slice, j: int, less: bool):
    """Log odds, inputs, gates and bit j of some edges; less: one occurrence of the bit is left out."""
    byte = e.byte[some]
    node, bit = (byte | 256) >> (j + 1), byte >> j & 1
    salt = node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    out = bit.astype(np.float32) if less else None
    shallow = e.shallow[some]
    near = np.flatnonzero(shallow)
    inputs = np.empty((INPUTS, len(byte)), np.float32)
    orders, known = np.zeros(len(byte), np.int64), []
    for i in range(TABLES):
        if i < len(ORDERS):
            n0, n1 = _look_up(mixer.tables[i], e.contexts[i][some], salt)
        else:
            n0, n1 = (e.seen[i - len(ORDERS)][j, x][some].copy() for x in (0, 1))
            n0[near], n1[near] = _look_up(mixer.tables[i], e.contexts[i][some][near], salt[near])
        if less:
            n1 = np.maximum(n1 - out, 0)
            n0 = np.maximum(n0 - (1 - out), 0)
        n = n0 + n1
        if i < len(ORDERS):
            orders += n > 0
        else:
            known.append((n > 0).astype(np.int64) + (n > 2) + (n > 15))
        np.log((n1 + np.float32(0.02)) / (n0 + np.float32(0.02)), out=inputs[i])
    inputs[-1] = 0.3
    gate_1 = (known[0] * LEVELS + known[1]) * (len(ORDERS) + 1) + orders
    gate_2 = j * 4 + np.minimum(e.place[some] // 2, 3)
    odds = np.zeros(len(byte))
    for i in range(INPUTS):
        odds += (mixer.first[:, i][gate_1] + mixer.second[:, i][gate_2]) * inputs[i]
    return np.clip(odds, -FAR, FAR), inputs, gate_1, gate_2, bit


def _look_up(table: np.ndarray, contexts: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones seen, both in one access."""
    slots = (contexts + salt) * np.uint64(0xD1342543DE82EF95) >> np.uint64(64 - TABLE_BITS)
    both = table.reshape(-1).view(np.uint64).take(slots.view(np.int64)).view(np.float32)
    return both[::2], both[1::2]


def _cell(odds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = (odds + FAR) * ((CELLS - 1) / (2 * FAR))
    low = np.minimum(x.astype(np.int64), CELLS - 2)
    return low, x - low


def learn(mixer: Mixer, e: Edges, some: np.ndarray, rate: float) -> None:
    """One online step over some edges; steps are scaled by the gradients' running mean squares."""
    weight = e.times[some].astype(np.float64)
    mixer.cells *= 0.995
    for j in range(8):
        odds, inputs, gate_1, gate_2, bit = _predict(mixer, e, some, j, True)
        low, share = _cell(odds)
        for cell, part in ((low, 1 - share), (low + 1, share)):
            mixer.cells += np.bincount((gate_1 * CELLS + cell) * 2 + bit, weight * part, GATE_1 * CELLS * 2).reshape(mixer.cells.shape)
        push = (bit - 1 / (1 + np.exp(-odds))) * weight
        for gate, size, weights, spread, step in ((gate_1, GATE_1, mixer.first, mixer.spread_1, rate), (gate_2, GATE_2, mixer.second, mixer.spread_2, 0.3 * rate)):
            sums = np.stack([np.bincount(gate, push * inputs[i], size) for i in range(INPUTS)], axis=1)
            total = np.bincount(gate, weight, size)[:, None]
            g = sums / (total + 20)
            used = total[:, 0] > 0
            spread[used] += 0.05 * (g[used] ** 2 - spread[used])
            weights += step * g / np.sqrt(spread + 1e-4)


def costs(mixer: Mixer, e: Edges) -> np.ndarray:
    """Bits that each pair of word and class costs."""
    total = np.zeros(len(e.byte))
    for j in range(8):
        odds, _, gate, _, bit = _predict(mixer, e, slice(None), j, False)
        p = 1 / (1 + np.exp(-odds))
        low, share = _cell(odds)
        cells = mixer.cells[gate, low] * (1 - share)[:, None] + mixer.cells[gate, low + 1] * share[:, None]
        p = 0.5 * p + 0.5 * (cells[:, 1] + 8 * p) / (cells.sum(axis=1) + 8)
        total -= np.log2(np.where(bit, p, 1 - p))
    return np.bincount(e.owner, total[e.of], e.owner.max(initial=-1) + 1)


_FIRST = pa.schema([("kind", pa.int32()), ("block", pa.string()), ("bucket", pa.int32()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n", pa.int64()), ("size", pa.int64()), ("z", pa.int32()), *((c, pa.binary()) for c in "abcd")])
_FIRST_SQL = "kind int, block string, bucket int, doc_id long, held_out boolean, n long, size long, z int, a binary, b binary, c binary, d binary"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def _small(x: np.ndarray) -> bytes:
    """Numbers in two bytes each if they fit, else in four."""
    return x.astype("<u2" if x.max(initial=0) < 1 << 16 else "<u4").tobytes()


def _large(x: bytes, n: int) -> np.ndarray:
    return np.frombuffer(x, "<u2" if len(x) == 2 * n else "<u4")


def _read(buckets: int, most_words: int = 250_000, most_bytes: int = 16 << 20):
    """Blocks: rows of kind 0 for documents, of kind 1 for the block's words of each bucket, of kind 2 for bits of repetition in training text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: dict[bytes, int] = {}
        docs: list[tuple] = []
        repeated = np.zeros(REPEATS * 2, np.int64)
        number, total = 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            block = f"{TaskContext.get().partitionId()}-{number}"
            words = list(ids)
            bucket = np.array([bucket_of(w, buckets) for w in words])
            order = np.argsort(bucket, kind="stable")
            place = np.empty(len(words), np.int64)
            place[order] = np.arange(len(words))
            train = np.zeros((len(words), CLASSES), np.int32)
            asked = np.zeros(len(words), np.uint8)
            rows = []
            for doc_id, held, n, size, z, own, times, spelt, bits in docs:
                if not held:
                    train[own, z] += times
                asked[own] |= np.uint8(1 << z)
                by = np.argsort(place[own])
                rows.append((0, block, -1, doc_id, held, n, size, z, np.diff(place[own][by], prepend=0).astype("<u4").tobytes(), _small(times[by]), _small(spelt[by]), bits))
                if len(rows) == 2000:
                    yield _batch(rows, _FIRST)
                    rows = []
            present, first = np.unique(bucket[order], return_index=True)
            for k, a, b in zip(present.tolist(), first.tolist(), [*first[1:].tolist(), len(order)], strict=True):
                some = order[a:b]
                rows.append((1, block, k, None, None, len(some), 0, 0, b" ".join([words[i] for i in some]), train[some].tobytes(), asked[some].tobytes(), None))
            rows.append((2, block, -1, None, None, 0, 0, 0, repeated.tobytes(), None, None, None))
            yield _batch(rows, _FIRST)

        for batch in batches:
            for doc_id, held, text in zip(batch["doc_id"].to_pylist(), batch["held_out"].to_pylist(), batch["text"], strict=True):
                text = text.as_py()
                words = text.translate(LOWER).split()
                words.append(b"")
                seq = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
                size = sum(map(len, words)) + len(words)
                order = np.argsort(seq, kind="stable")
                context, hit = repeats_of(seq, order)
                bits = np.bincount((context * 2 + hit)[context >= 0], minlength=REPEATS * 2)
                if not held:
                    repeated += bits
                each = seq[order]
                first = np.flatnonzero(np.diff(each, prepend=-1))
                docs.append((doc_id, held, len(words), size, class_of(text), each[first], np.diff(first, append=len(seq)), np.add.reduceat((~hit)[order].astype(np.int64), first), bits.astype("<u4").tobytes()))
                total += size
                if len(ids) > most_words or total > most_bytes:
                    yield from flush()
                    ids, docs, repeated, total, number = {}, [], np.zeros(REPEATS * 2, np.int64), 0, number + 1
        if docs:
            yield from flush()
        ids, docs = {}, []
        release()

    return run


_WORDS = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("part", pa.int32()), ("total", pa.list_(pa.int64())), ("long", pa.list_(pa.int64())), ("distinct", pa.int64()), *((c, pa.binary()) for c in "abc")])
_WORDS_SQL = "kind int, bucket int, part int, total array<long>, long array<long>, distinct long, a binary, b binary, c binary"


def _counts(b: bytes) -> np.ndarray:
    return np.frombuffer(b, np.int64).reshape(-1, CLASSES)


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows of kind 1 sorted by bucket: the vocabulary of each bucket in order of families, in chunks of whole ones."""
    current, place = None, {}
    sums = np.zeros((1024, CLASSES), np.int64)
    asked = np.zeros(1024, np.uint8)

    def flush() -> Iterator[pa.RecordBatch]:
        words = sorted(place, key=order_of)
        first = part = 0
        for i in range(1, len(words) + 1):
            if i == len(words) or (i - first >= _CHUNK_WORDS and family_of(words[i]) != family_of(words[i - 1])):
                some = words[first:i]
                at = [place[w] for w in some]
                counts = sums[at]
                long = np.array([len(w) > LONG for w in some])
                yield _batch([(0, current, part, counts.sum(axis=0).tolist(), counts[long].sum(axis=0).tolist(), int((counts.sum(axis=1) > 0).sum()), b" ".join(some), counts.tobytes(), asked[at].tobytes())], _WORDS)
                first, part = i, part + 1

    for batch in batches:
        for bucket, a, b, c in zip(batch["bucket"].to_pylist(), batch["a"], batch["b"], batch["c"], strict=True):
            if bucket != current:
                yield from flush()
                current, place = bucket, {}
                sums, asked = np.zeros((1024, CLASSES), np.int64), np.zeros(1024, np.uint8)
            at = [place.setdefault(w, len(place)) for w in a.as_py().split(b" ")]
            while len(sums) < len(place):
                sums, asked = np.concatenate([sums, np.zeros_like(sums)]), np.concatenate([asked, np.zeros_like(asked)])
            sums[at] += np.frombuffer(b.as_py(), np.int32).reshape(-1, CLASSES)
            asked[at] |= np.frombuffer(c.as_py(), np.uint8)
    yield from flush()


def _trained(a: bytes, b: bytes, with_seen: bool = True) -> Edges | None:
    """What training text spells of a vocabulary chunk."""
    words, counts = a.split(b" "), _counts(b)
    some = np.flatnonzero(counts.sum(axis=1))
    if not len(some):
        return None
    pairs = np.nonzero(counts[some])
    return edges_of([words[i] for i in some], counts[some], *pairs, with_seen)


def _count_tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tables = np.zeros((TABLES, 1 << TABLE_BITS, 2), np.float32)
    for batch in batches:
        for a, b in zip(batch["a"], batch["b"], strict=True):
            edges = _trained(a.as_py(), b.as_py(), False)
            if edges:
                count_bits(edges, tables)
    flat = tables.reshape(-1)
    for i in range(0, len(flat), _PART):
        used = np.flatnonzero(flat[i : i + _PART])
        if len(used):
            part = zlib.compress(used.astype("<u2").tobytes() + flat[i + used].tobytes(), 1)
            yield pa.RecordBatch.from_arrays([pa.array([i // _PART], pa.int32()), pa.array([part], pa.binary())], names=["part", "sums"])


def _unpack(part: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(part)
    n = len(raw) // 6
    return np.frombuffer(raw, "<u2", n).astype(np.int64), np.frombuffer(raw, "<f4", n, 2 * n)


def _sum_tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    current, sums = None, np.zeros(_PART)

    def flush() -> Iterator[pa.RecordBatch]:
        used = np.flatnonzero(sums)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array([current], pa.int32()), pa.array([zlib.compress(used.astype("<u2").tobytes() + sums[used].astype("<f4").tobytes(), 1)], pa.binary())], names=["part", "sums"])

    for batch in batches:
        for part, packed in zip(batch["part"].to_pylist(), batch["sums"], strict=True):
            if part != current:
                yield from flush()
                current, sums = part, np.zeros(_PART)
            used, values = _unpack(packed.as_py())
            sums[used] += values
    yield from flush()


def _learn(shared):
    """What each chunk of the vocabulary alone learns, whatever the task it is in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, part, a, b in zip(batch["bucket"].to_pylist(), batch["part"].to_pylist(), batch["a"], batch["b"], strict=True):
                edges = _trained(a.as_py(), b.as_py())
                if edges is None:
                    continue
                mixer = Mixer.fresh(shared.value)
                order = np.argsort(mix(edges.contexts[-1] + edges.byte.astype(np.uint64)), kind="stable")  # not in the order of the alphabet
                for done, k in enumerate(range(0, len(order), _LEARN_EDGES)):
                    learn(mixer, edges, order[k : k + _LEARN_EDGES], 0.02 / (1 + done / 50) + 0.002)
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([part], pa.int32()), pa.array([float(edges.times.sum())], pa.float64()), *(pa.array([x.astype(np.float32).tobytes()], pa.binary()) for x in (mixer.first, mixer.second, mixer.cells))], names=["bucket", "part", "weight", "first", "second", "cells"])

    return run


_ANSWER = pa.schema([("kind", pa.int32()), ("block", pa.string()), ("bucket", pa.int32()), *((c, pa.binary()) for c in "abc")])


def _answer(shared, first: np.ndarray, second: np.ndarray, cells: np.ndarray, of_length: np.ndarray):
    """Over rows sorted by bucket, vocabulary before requests: costs by class, training counts and classes asked for of each request's words. of_length: bits by class and whether long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer = Mixer(shared.value, first, second, cells)
        current, place = None, {}
        found: list[list[np.ndarray]] = []
        for batch in batches:
            for kind, bucket, block, a, b, c in zip(batch["kind"].to_pylist(), batch["bucket"].to_pylist(), batch["block"].to_pylist(), batch["a"], batch["b"], batch["c"], strict=True):
                if bucket != current:
                    current, place, found = bucket, {}, []
                words = a.as_py().split(b" ")
                if kind == 0:
                    place.update(zip(words, range(len(place), len(place) + len(words)), strict=True))
                    counts = _counts(b.as_py())
                    asked = np.unpackbits(np.frombuffer(c.as_py(), np.uint8)[:, None], axis=1, bitorder="little")
                    pairs = np.nonzero(asked)
                    bits = np.zeros(asked.shape, np.float32)
                    long = np.array([len(w) > LONG for w in words], np.int64)
                    bits[pairs] = costs(mixer, edges_of(words, counts, *pairs)) + of_length[pairs[1], long[pairs[0]]]
                    found.append([bits, counts.sum(axis=1)])
                else:
                    if len(found) > 1:
                        found = [[np.concatenate(x) for x in zip(*found, strict=True)]]
                    at = np.array([place[w] for w in words])
                    asked = np.unpackbits(np.frombuffer(c.as_py(), np.uint8)[:, None], axis=1, bitorder="little")
                    yield _batch([(1, block, bucket, found[0][0][at][asked > 0].tobytes(), found[0][1][at].tobytes(), c.as_py())], _ANSWER)

    return run


_SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("bits", pa.float64()), ("bits_per_byte", pa.float64())])
_SCORES_SQL = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits double, bits_per_byte double"


def _finish(n: int, v: int, texts: np.ndarray, repeated: np.ndarray):
    """Over rows sorted by block, answers before documents. texts: training texts by class. repeated: bits by context of repetition and bit."""
    of_class = -np.log2((texts + 0.5) / (texts.sum() + 0.5 * CLASSES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, answers, ready = None, [], None
        for batch in batches:
            rows = []
            for kind, block, doc_id, held, tokens, size, z, a, b, c, d in zip(*(batch[x].to_pylist() for x in ("kind", "block", "doc_id", "held_out", "n", "size", "z", "a", "b", "c", "d")), strict=True):
                if block != current:
                    current, answers, ready = block, [], None
                if kind == 1:
                    answers.append((a, b, c))
                    continue
                if ready is None:
                    asked = np.unpackbits(np.frombuffer(b"".join(x[2] for x in answers), np.uint8)[:, None], axis=1, bitorder="little")
                    spelt = np.zeros(asked.shape, np.float64)
                    spelt[asked > 0] = np.frombuffer(b"".join(x[0] for x in answers), np.float32)
                    counts = np.frombuffer(b"".join(x[1] for x in answers), np.int64)
                    ready = spelt, counts, np.log10((counts + 0.1) / (n + 0.1 * (v + 1)))
                spelt, counts, base = ready
                own, told = np.cumsum(np.frombuffer(a, "<u4"), dtype=np.int64), np.frombuffer(d, "<u4")
                times, plain = _large(b, len(own)), _large(c, len(own))
                cost = float(spelt[own, z] @ plain) + float(repeated @ told) + float(of_class[z])
                rows.append((doc_id, held, tokens, int(times[counts[own] > 0].sum()), n, float(base[own] @ times), -cost * float(np.log10(2)), cost, cost / size))
            if rows:
                yield _batch(rows, _SCORES)

    return run


def _repeat_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = np.zeros(REPEATS * 2, np.int64)
    for batch in batches:
        for a in batch["a"]:
            sums += np.frombuffer(a.as_py(), np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums))), pa.array(sums)], names=["at", "n"])


def score(docs: DataFrame, held_out: Column, documents_a_bucket: int = 1000) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits, bits_per_byte.

    held_out: the rows not to learn from. Null text counts as empty: one token, the end. Very long texts make a block of their own. Repeated rows count
    as often as they occur; null doc_ids keep their rows. Other columns are not read. An empty table gives an empty result; without training rows
    the predictors know nothing, and every bit costs about one. Results don't depend on the numbers of tasks and partitions, but for rounding.
    """
    spark = docs.sparkSession
    base = docs.select("doc_id", held_out.alias("held_out"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    buckets = max(48, docs.count() // documents_a_bucket)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    read = materialise(base.mapInArrow(_read(buckets), _FIRST_SQL), "blocks", partition_by="kind")
    requests = read.where("kind = 1").select("kind", "block", "bucket", F.lit(0).alias("part"), "a", "b", "c")
    dealt = requests.repartition(parts, "bucket").sortWithinPartitions("bucket")
    words = materialise(dealt.mapInArrow(_add_up, _WORDS_SQL), "vocabulary")
    by_class = lambda c: [F.coalesce(F.sum(F.col(c)[z]), F.lit(0)).alias(f"{c}{z}") for z in range(CLASSES)]
    sums = words.agg(*by_class("total"), *by_class("long"), F.coalesce(F.sum("distinct"), F.lit(0)).alias("v")).first()
    totals, longs = (np.array([sums[f"{c}{z}"] for z in range(CLASSES)], np.float64) for c in ("total", "long"))
    of_length = -np.log2((np.stack([totals - longs, longs], axis=1) + 0.5) / (totals[:, None] + 1))
    ends = read.where("kind = 0 AND NOT coalesce(held_out, false)").groupBy("z").count().collect()  # at most CLASSES rows
    texts = np.zeros(CLASSES)
    for r in ends:
        texts[r["z"]] = r["count"]
    repeats = np.zeros(REPEATS * 2)
    for r in read.where("kind = 2").select("a").mapInArrow(_repeat_counts, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # 2 * REPEATS rows
        repeats[r["at"]] = r["n"]
    repeats = repeats.reshape(-1, 2) + 0.4
    repeated = -np.log2(repeats / repeats.sum(axis=1, keepdims=True)).reshape(-1)
    # A task's table costs as much as some hundred thousand words, so there are few.
    found = words.select("a", "b").coalesce(max(6, int(sums["v"]) // 500_000)).mapInArrow(_count_tables, "part int, sums binary")
    found = found.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_sum_tables, "part int, sums binary")
    tables = np.zeros((TABLES, 1 << TABLE_BITS, 2), np.float32)
    flat = tables.reshape(-1)
    for r in found.collect():  # the tables: of a fixed size
        used, values = _unpack(r["sums"])
        flat[r["part"] * _PART + used] = values
    shared = spark.sparkContext.broadcast(tables)
    mixer = Mixer.fresh(tables)
    learnt = words.select("bucket", "part", "a", "b").mapInArrow(_learn(shared), "bucket int, part int, weight double, first binary, second binary, cells binary")
    total, first, second, cells = 0.0, np.zeros_like(mixer.first), np.zeros_like(mixer.second), np.zeros_like(mixer.cells)
    for r in materialise(learnt, "learnt").orderBy("bucket", "part").toLocalIterator():  # some 30 KB of each chunk, a partition's at a time
        total += r["weight"]
        first += r["weight"] * np.frombuffer(r["first"], np.float32).reshape(first.shape)
        second += r["weight"] * np.frombuffer(r["second"], np.float32).reshape(second.shape)
        cells += np.frombuffer(r["cells"], np.float32).reshape(cells.shape)
    if total:
        mixer.first, mixer.second, mixer.cells = first / total, second / total, cells
    both = words.select("kind", F.lit(None).cast("string").alias("block"), "bucket", "part", "a", "b", "c").unionByName(requests.drop("b").withColumn("b", F.lit(None).cast("binary")))
    answering = both.repartition(parts, "bucket").sortWithinPartitions("bucket", "kind", "part").mapInArrow(_answer(shared, mixer.first, mixer.second, mixer.cells, of_length), "kind int, block string, bucket int, a binary, b binary, c binary")
    documents = read.where("kind = 0").select("kind", "block", "bucket", "a", "b", "c", "d", "doc_id", "held_out", "n", "size", "z")
    ready = answering.unionByName(documents, allowMissingColumns=True).repartition(parts, "block").sortWithinPartitions("block", F.desc("kind"), "bucket")
    return ready.mapInArrow(_finish(int(totals.sum()), int(sums["v"]), texts, repeated), _SCORES_SQL)
