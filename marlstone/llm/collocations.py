"""Phrase collocations by count tries of shards, merged by ranges of paths.

Each shard, a chunk of one language's texts in a task, builds a count trie level by level: a node is its parent and a word, nodes are numbered in the order of
their paths, and a level is written sorted. The levels of all shards are merged by ranges of paths, so one range may begin inside any word's subtree, and a common
word is no hot key. A path grows on only where both the path and its suffix may be frequent, which bits of a fixed number tell (a bit set by chance
costs a row, never a result). The merged trie is walked from parents to children, who so get the counts of all left parts; a node's suffix link leads to the path without its
first word, which has the counts of all right parts.
"""

from __future__ import annotations

import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import LOWER, forget, materialise, release

#: Stands for a border between pieces; no UTF-8 text has this byte.
_CUT = b"\xff"
_PIECES = bytes(_CUT[0] if chr(c) in ".,;:!?\n\x0b\x0c\r" else LOWER[c] for c in range(256))
#: Words of a shard, and bytes of a text that are split at once.
_SHARD = 1 << 21
_SLICE = 1 << 20
#: Bits that tell frequent paths, and what the slot of a path is multiplied by before its last word's hash is added.
_BITS, _STEP = 1 << 26, 40503
#: A path is the language, a line break (which no word has), and the words.
_ROWS = pa.schema([("path", pa.string()), ("n", pa.int64())])


def slices(text: bytes) -> Iterator[bytes]:
    """The text with borders marked, in slices that end at borders."""
    text = text.translate(_PIECES)
    begin = 0
    while begin < len(text):
        end = begin + _SLICE
        if end < len(text):
            near = text.rfind(_CUT, begin, end)
            near = near if near >= 0 else text.find(_CUT, end)
            end = near + 1 if near >= 0 else len(text)
        yield text[begin:end]
        begin = end


class Shard:
    """The words of a chunk of texts of one language, and the levels of their count trie."""

    def __init__(self, lang: str):
        self.lang = lang
        self.numbers = defaultdict(count().__next__)
        self.words = array("i", [self.numbers[_CUT]])

    def add(self, text: bytes) -> None:
        for part in slices(text):
            self.words.extend(map(self.numbers.__getitem__, part.replace(_CUT, b" \xff ").split()))
        self.words.append(0)

    def level(self, depth: int, frequent: np.ndarray | None) -> pa.RecordBatch:
        """The paths of so many words, sorted, with their counts; frequent: bits of the paths that are one word shorter."""
        order = sorted(self.numbers)  # the border comes last
        rank = np.empty(len(order), np.int64)
        rank[np.fromiter(map(self.numbers.__getitem__, order), np.int64, len(order))] = np.arange(len(order))
        word = rank[np.frombuffer(self.words, np.int32)]
        seed = zlib.crc32(self.lang.encode())
        code = np.fromiter((zlib.crc32(w, seed) for w in order), np.uint64, len(order))[word]
        alive, slot = word < len(order) - 1, code % _BITS
        for k in range(1, depth):
            if k == depth - 1 and frequent is not None:
                alive = alive & ((frequent[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)) == 1)
            alive = alive[:-1] & alive[1:]
            if k < depth - 1:
                slot = (slot[:-1] * np.uint64(_STEP) + code[k:]) % np.uint64(_BITS)
        at = np.flatnonzero(alive)
        node = word[at]
        for k in range(1, depth):
            paths, first, node, n = np.unique(node << 31 | word[at + k], return_index=True, return_inverse=True, return_counts=True)
        if depth == 1:
            _, first, n = np.unique(node, return_index=True, return_counts=True)
        at = at[first]
        names = pa.array(order[:-1], pa.binary()).cast(pa.string())
        path = pc.binary_join_element_wise(self.lang, names, "\n").take(pa.array(word[at]))
        for k in range(1, depth):
            path = pc.binary_join_element_wise(path, names.take(pa.array(word[at + k])), " ")
        return pa.RecordBatch.from_arrays([path, pa.array(n)], schema=_ROWS)


def _levels(depth: int, frequent: np.ndarray | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: dict[str, Shard] = {}

        def close() -> Iterator[pa.RecordBatch]:
            for shard in shards.values():
                yield shard.level(depth, frequent)
            shards.clear()

        waiting = 0
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"], strict=True):
                shard = shards.get(lang) or shards.setdefault(lang, Shard(lang))
                before = len(shard.words)
                shard.add(text.as_py())
                waiting += len(shard.words) - before
                if waiting > _SHARD:
                    yield from close()
                    waiting = 0
        yield from close()
        release()

    return run


def slot_of(lang: str, phrase: str) -> Column:
    """The slot of a path, as the shards count it."""
    code = lambda w: F.crc32(F.concat(lang, w).cast("binary"))
    return F.aggregate(F.split(phrase, " "), F.lit(0).cast("long"), lambda slot, w: (slot * _STEP + code(w)) % _BITS)


def bits_of(paths: DataFrame) -> np.ndarray:
    """The bits of the paths' slots: a fixed number, whatever the number of paths."""
    found = paths.groupBy(F.shiftright("slot", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(slot & 63 AS INT))")).alias("bits")).toArrow()
    out = np.zeros(_BITS // 64, np.uint64)
    out[found["at"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def _cut_scores(words: int) -> Column:
    """The lowest-scoring cut of a path of so many words: (score, k, l, r)."""
    wide = lambda c: c.cast("decimal(19,0)")
    cuts = []
    for k in range(1, words):
        left, right = F.col("lefts")[k - 1], F.col("rights")[words - k - 1]
        square = (wide(F.col("n")) * wide(F.col("n"))).cast("decimal(31,0)") * F.lit(1_000_000).cast("decimal(7,0)")
        score = F.call_function("div", square, wide(left) * wide(right))
        cuts.append(F.struct(score.alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r")))
    return F.array_min(F.array(*cuts))


def count_phrases(docs: DataFrame, max_words: int = 3, least: int = 10) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, total) of all word occurrences, and of each level 1 to max_words the paths (lang, phrase, n) that occur at least `least` times."""
    base = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    totals, levels, frequent = None, [], None
    for depth in range(1, max_words + 1):
        rows = materialise(base.mapInArrow(_levels(depth, frequent), "path string, n long"), "shard-tries")
        phrase = F.substring_index("path", "\n", -1)
        lang = F.substr("path", F.lit(1), F.length("path") - F.length(phrase) - 1).alias("lang")
        if totals is None:
            totals = materialise(rows.groupBy(lang).agg(F.sum("n").alias("total")), "words-of-languages")
        merged = rows.repartitionByRange("path").groupBy("path").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        levels.append(materialise(merged.select(lang, phrase.alias("phrase"), "n"), "merged-trie"))
        forget(rows)
        if depth < max_words:
            frequent = bits_of(levels[-1].select(slot_of("lang", "phrase").alias("slot")))
    return totals, levels


def mine(docs: DataFrame, max_words: int = 3, least: int = 10, inside: int = 50, top: int = 2000) -> DataFrame:
    """The first `top` phrases of each language: lang, rank, phrase, a, l, r, n, score, k.

    Texts are lower-cased (A-Z) and split at `[.,;:!?\\x0A-\\x0D]` into pieces, these at spaces and tabs into words. Candidates are the phrases of 2 to max_words words that occur at
    least `least` times (a) within pieces. Of the ways to cut one in two, with l and r occurrences of the parts, the lowest floor(10^6 * a * a / (l * r)) counts, of
    equal ones that after the fewest words (k). Candidates that lie inside a longer one which occurs at least inside/100 times as often are dropped. n: all words of the language. Ranks
    are by score and a (largest first), then by the bytes of the phrase.

    A null language is `und`, together with one of that name; null and empty texts have no words; repeated rows count as often as they occur, whatever their doc_id. Very long texts
    are counted in slices between borders of pieces. Other columns are not read. An empty table, or one without candidates, gives an empty result.
    """
    totals, levels = count_phrases(docs, max_words, least)
    none = F.array().cast("array<bigint>")
    nodes = [levels[0].select("lang", "phrase", "n", none.alias("lefts"), none.alias("rights"))]
    longer = []
    for depth, level in enumerate(levels[1:], 2):
        parts = (F.substring_index("phrase", " ", depth - 1), F.substring_index("phrase", " ", 1 - depth))
        above = nodes[-1].select("lang", F.col("phrase").alias("parent"), F.concat("lefts", F.array("n")).alias("lefts"))
        suffix = nodes[-1].select("lang", F.col("phrase").alias("suffix"), F.concat("rights", F.array("n")).alias("rights"))
        linked = level.select("lang", "phrase", "n", parts[0].alias("parent"), parts[1].alias("suffix")).join(above, ["lang", "parent"]).join(suffix, ["lang", "suffix"])
        nodes.append(materialise(linked.select("lang", "phrase", "n", "lefts", "rights"), "linked-trie"))
        held = F.explode(F.array(*parts)).alias("phrase")
        longer.append(level.select("lang", held, F.col("n").alias("longest")).groupBy("lang", "phrase").agg(F.max("longest").alias("longest")))
    found = None
    for depth, level in enumerate(nodes[1:], 2):
        if depth < max_words:
            level = level.join(longer[depth - 1], ["lang", "phrase"], "left").where(F.expr(f"longest IS NULL OR 100 * longest < {inside} * n"))
        level = level.select("lang", "phrase", "n", _cut_scores(depth).alias("cut"))
        found = level if found is None else found.unionByName(level)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = found.select("lang", "phrase", F.col("n").alias("a"), "cut.*").withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score", F.col("k").cast("long").alias("k"))
