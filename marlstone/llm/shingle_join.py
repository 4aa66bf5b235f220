"""Near-duplicate documents by Jaccard similarity of word shingles, with PartEnum signatures.

Sets of sizes a and b with Jaccard similarity of at least t differ in at most (a + b) (1 - t) / (1 + t) shingles, and their sizes
within a factor of t. Sizes are cut into bands of that factor; a set takes part in the group of its own band and in that of the
next, so similar sets meet in one group, whose largest size bounds their difference by some k. There the domain of shingles is cut
by hash into n first-level parts, and each of these into three second-level ones. Sets that differ in k shingles differ in at most
one in n - k/2 of the first-level parts at least, so there they agree on two of the three second-level ones: signatures are the subsets of two
second-level parts, with the set's shingles in them. A part in which a set fills under two second-level ones is weak: an agreement there may
be one on nothing. Sets with so few weak parts that one agreement is left share a signature with all similar ones; the others also sign with each shingle as a
part of its own, of which the least of a set do, one more than can be missing in a similar set.

Three things keep buckets small, none of which loses a link. Equal sets are one class from the start. Shingles known to be very frequent stay out of the
domain; the few sets that consist of them by more than can be missing in a similar set also sign over the whole domain.
And a class whose `SKETCH` least shingle hashes are nearly all its own can't be similar to another: of a pair at t = 0.75, under 8 of 32 shared ones are seen
once in 10**9 such pairs (`sketch=False` does without this). Sets of at most 24 shingles, whose partners have whole sketches, must share 3/4 of theirs; sets of 25
to 31 must share 8, and always do, since a partner has at most 9 shingles beyond its sketch.

Buckets give candidates; candidates are verified on whole sets. First each set is held against one pivot of its buckets, for a fixed number of rounds: that
joins large groups at the cost of a pair for each set. Then all pairs of sets that share a bucket and are in different components are verified at
once. Those of large buckets are not written out: overlapping buckets form a cluster, whose sets are dealt out in pairs of blocks, and a task counts what
each set of one block shares with all of the other, so neither a task nor the driver holds a bucket. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, RollingHash, connected_components, materialise, mix, release

SKETCH, SHARED = 32, 8
#: Second-level parts of each first-level part; signatures leave one out.
_SECOND = 3
#: A shingle is frequent from this many classes on; at most so many are told apart.
_FREQUENT, _MOST_FREQUENT = 50, 200_000


def shingles(text: bytes, words: int = 5) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of lower-cased words; all words as one if there are fewer."""
    tokens = text.translate(LOWER).split()
    if not tokens:
        return np.zeros(0, np.uint64)
    sizes = np.array([len(t) for t in tokens])
    starts = np.cumsum(sizes + 1) - sizes - 1
    h = RollingHash(np.frombuffer(b" ".join(tokens), np.uint8))
    last = max(len(tokens) - words, 0)
    return np.unique(h(starts[: last + 1], (starts + sizes)[len(tokens) - last - 1 :]))


def similar(a: np.ndarray, b: np.ndarray, percent: int = 75) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def most_apart(size: int, percent: int) -> int:
    """The most shingles in which a set of this size and one similar to it can differ."""
    return (size + size * 100 // percent) * (100 - percent) // (100 + percent)


@cache
def group_plan(g: int, percent: int) -> tuple[int, int]:
    """(k, n) of group g: the largest difference, the number of first-level parts."""
    ratio = 100 / percent
    largest = int(ratio ** (g + 1) + 1e-9)
    k, n = 2 * largest * (100 - percent) // (100 + percent), 1
    while n <= k:
        n += 1
        for size in (largest * (percent / 100) ** 2, largest * percent / 100, largest):  # enough parts that are not weak
            empty = np.exp(-size / (n * _SECOND))
            weak = empty**_SECOND + _SECOND * (1 - empty) * empty ** (_SECOND - 1)
            if n * (1 - weak) - 2 * np.sqrt(n * weak * (1 - weak)) < min(k, most_apart(int(size), percent)) // 2 + 1:
                break
        else:
            break
    return k, n


def _subsets(s: np.ndarray, n: int, salt: int) -> tuple[np.ndarray, int]:
    """Signatures of the sorted set s under n first-level parts, and how many of these are weak.

    Each first-level part is cut into _SECOND second-level ones; a signature is what is in all but one of them, unless that is nothing.
    """
    part = ((s >> np.uint64(32)) * np.uint64(n * _SECOND) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.diff(part, prepend=-1))
    sums, filled = np.zeros(n * _SECOND, np.uint64), np.zeros(n * _SECOND, np.int8)
    if len(s):
        sums[part[first]] = np.add.reduceat(mix(s), first)
        filled[part[first]] = 1
    sums, filled = sums.reshape(n, _SECOND), filled.reshape(n, _SECOND)
    left, some = sums.sum(axis=1, dtype=np.uint64)[:, None] - sums, filled.sum(axis=1)[:, None] - filled
    place = np.arange(n * _SECOND, dtype=np.uint64).reshape(n, _SECOND) + np.uint64(salt << 40)
    return mix(left + mix(place))[some > 0], int((filled.sum(axis=1) < 2).sum())


def signatures(s: np.ndarray, frequent: np.ndarray, percent: int = 75) -> np.ndarray:
    """Signatures of the sorted set s in its two groups."""
    out = []
    band = int(np.log(len(s)) / np.log(100 / percent) + 1e-9)
    rare = s[~np.isin(s, frequent, assume_unique=True)] if len(frequent) else s
    missing = len(s) * (100 - percent) // 100  # of its own, in any similar set
    for g in (band, band + 1):
        k, n = group_plan(g, percent)
        if not k:
            continue  # only equal sets
        most_weak = n - 1 - min(k, most_apart(len(s), percent)) // 2
        found, weak = _subsets(rare, n, 4 * g)
        out.append(found)
        if weak <= most_weak:
            continue
        out.append(mix(rare[: missing + 1] + np.uint64((4 * g + 1) << 40)))
        if len(rare) > missing:
            continue
        found, weak = _subsets(s, n, 4 * g + 2)
        out.append(found)
        if weak > most_weak:
            out.append(mix(s[: missing + 1] + np.uint64((4 * g + 3) << 40)))
    return np.concatenate([*out, np.zeros(0, np.uint64)])


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, h1, h2, sketch = [], [], [], []
        for text in batch["text"]:
            s = shingles(text.as_py())
            n.append(len(s))
            with np.errstate(over="ignore"):
                h1.append(mix(s).sum(dtype=np.uint64))
                h2.append(mix(mix(s) ^ np.uint64(len(s))).sum(dtype=np.uint64))
            sketch.append(s[:SKETCH].view(np.int64))
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["tkey"], pa.array(n, pa.int64()), *(_long(np.array(h, np.uint64)) for h in (h1, h2)), pa.array(sketch, pa.list_(pa.int64()))], names=["doc_id", "tkey", "n", "h1", "h2", "sketch"])
    release()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch["rep"], pa.array([shingles(t.as_py()).tobytes() for t in batch["text"]], pa.binary())], names=["rep", "shingles"])


def _often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles that recur within a run of sets, with their numbers there."""
    run, total = [], 0

    def flush() -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(run), return_counts=True)
        some = counts > 2
        return pa.RecordBatch.from_arrays([_long(values[some]), pa.array(counts[some])], names=["shingle", "n"])

    for batch in batches:
        for s in batch["shingles"]:
            run.append(np.frombuffer(s.as_py(), np.uint64))
            total += len(run[-1])
            if total > 2_000_000:
                yield flush()
                run, total = [], 0
    if run:
        yield flush()


def _sign(frequent: np.ndarray, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps, found, total = [], [], 0
            for rep, s in zip(batch["rep"].to_pylist(), batch["shingles"], strict=True):
                found.append(signatures(np.frombuffer(s.as_py(), np.uint64), frequent, percent))
                reps.append(np.full(len(found[-1]), rep, np.int64))
                total += len(found[-1])
                if total > 500_000:
                    yield pa.RecordBatch.from_arrays([_long(np.concatenate(found)), pa.array(np.concatenate(reps))], names=["signature", "rep"])
                    reps, found, total = [], [], 0
            if found:
                yield pa.RecordBatch.from_arrays([_long(np.concatenate(found)), pa.array(np.concatenate(reps))], names=["signature", "rep"])

    return run


def _buckets(batches: Iterator[pa.RecordBatch], most: int = 4096, remembered: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by signature and rep: (bucket, rep, m) of buckets with several members, equal buckets once (of those remembered).

    m: how many members the bucket has; of a bucket of over `most`, how many it had when the row came.
    """
    told: set[tuple[int, ...]] = set()
    held = 0
    current, members, streaming, so_far = None, [], False, 0
    out_b: list[int] = []
    out_r: list[int] = []
    out_m: list[int] = []

    def tell(bucket: int, reps: list[int], m: int) -> None:
        out_b.extend([bucket] * len(reps))
        out_r.extend(reps)
        out_m.extend([m] * len(reps))

    def close() -> None:
        nonlocal held
        if streaming or len(members) < 2:
            return
        key = tuple(members)
        if key not in told:
            held += len(key)
            if held > remembered:
                told.clear()
                held = len(key)
            told.add(key)
            tell(current, members, len(members))

    def ready() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (out_b, out_r, out_m)], names=["bucket", "rep", "m"])
        for x in (out_b, out_r, out_m):
            x.clear()
        return batch

    for batch in batches:
        signature, reps = batch["signature"].to_numpy(), batch["rep"].to_numpy()
        edges = np.flatnonzero(np.diff(signature)) + 1
        for i, j in zip([0, *edges.tolist()], [*edges.tolist(), len(signature)], strict=True):
            if i == j:
                continue
            if signature[i] != current:
                close()
                current, members, streaming, so_far = int(signature[i]), [], False, 0
            own = reps[i:j].tolist()
            so_far += len(own)
            if streaming:
                tell(current, own, so_far)
            else:
                members += own
                if len(members) > most:
                    tell(current, members, so_far)
                    members, streaming = [], True
        if out_b:
            yield ready()
    close()
    if out_b:
        yield ready()


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = [similar(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), percent) for x, y in zip(batch["sa"], batch["sb"], strict=True)]
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(same, pa.bool_()))

    return run


def _grouped(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], columns: tuple[str, ...]) -> Iterator[list[tuple]]:
    """The rows of each key, of batches sorted by it."""
    current, rows = None, []
    for batch in batches:
        for key, row in zip(zip(*(batch[x].to_pylist() for x in keys), strict=True), zip(*(batch[x].to_pylist() for x in columns), strict=True), strict=True):
            if key != current:
                if rows:
                    yield rows
                current, rows = key, []
            rows.append(row)
    if rows:
        yield rows


def _links(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _pairs(at_once: int = 1 << 20):
    """Over rows sorted by bucket: the pairs of sets in different components, a pair of some time ago again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, total = [], 0
        for rows in _grouped(batches, ("bucket",), ("rep", "c")):
            rep, c = np.array(rows, np.int64).T
            i, j = np.nonzero((c[:, None] != c) & (rep[:, None] < rep))
            found.append(np.stack([rep[i], rep[j]], axis=1))
            total += len(i)
            if total > at_once:
                yield _links(*np.unique(np.concatenate(found), axis=0).T)
                found, total = [], 0
        if total:
            yield _links(*np.unique(np.concatenate(found), axis=0).T)

    return run


def links_between(left: list[np.ndarray], right: list[np.ndarray], parts: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links (i, j) between the sets of left and of right that join all parts which are linked at all. parts: of left, then of right.

    A set's shared shingles with all of right are counted at once, over the places where its shingles occur.
    """
    sizes = np.array([len(s) for s in right])
    values = np.concatenate(right)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], np.repeat(np.arange(len(right), dtype=np.int32), sizes)[order]
    label = np.unique(parts, return_inverse=True)[1]
    mine, theirs = label[: len(left)], label[len(left) :]  # views: both see what is joined
    links = []
    for i, s in enumerate(left):
        if (theirs == mine[i]).all():
            continue
        first, last = np.searchsorted(values, s, "left"), np.searchsorted(values, s, "right")
        n = last - first
        at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        shared = np.bincount(owner[at], minlength=len(right))
        for j in np.flatnonzero((100 * shared >= percent * (sizes + len(s) - shared)) & (theirs != mine[i])).tolist():
            if theirs[j] != mine[i]:
                links.append((i, j))
                label[label == theirs[j]] = mine[i]
    return links


def _between(percent: int):
    """Over rows sorted by cluster and its blocks i and j. side: 0 for rows of block i, 1 for those of block j, 2 where both are one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches, ("cluster", "i", "j"), ("side", "rep", "c", "shingles")):
            left, right = [r for r in rows if r[0] != 1], [r for r in rows if r[0] != 0]
            if left and right and len({r[2] for r in rows}) > 1:
                sets = [[np.frombuffer(r[3], np.uint64) for r in x] for x in (left, right)]
                found = links_between(*sets, np.array([r[2] for r in left + right]), percent)
                yield _links([left[i][1] for i, _ in found], [right[j][1] for _, j in found])

    return run


def jaccard_components(docs: DataFrame, percent: int = 75, rounds: int = 3, large: int = 16, block_mb: int = 2, sketch: bool = True) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id.

    Documents link when 100 times the shared shingles are at least percent times all of both (percent of 75 or more is what the sketch is sized for).
    component_id is the smallest doc_id reached. Null and empty texts, and those of white space alone, have no shingles and link with nothing; a
    text of under five words is one shingle; a very long one is one set in one task. Rows without doc_id link with nothing and keep a null component_id. Repeated rows are
    equal sets, so one component. Other columns are not read. An empty table gives an empty result.
    rounds: how often each set is held against one pivot first, once at least; large: buckets of more members are compared where their sets are, in
    blocks of block_mb; sketch: whether sets without company in their sketches are left out.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text")).withColumn("tkey", F.xxhash64("text"))
    rows = materialise(base.mapInArrow(_sketches, "doc_id long, tkey long, n long, h1 long, h2 long, sketch array<long>"), "sketches")
    linked = rows.where("n > 0 AND doc_id IS NOT NULL")
    classes = linked.groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("least"), *(F.first(c).alias(c) for c in ("doc_id", "tkey", "sketch")))
    classes = materialise(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    if sketch:
        each = classes.select("rep", "n", F.explode("sketch").alias("shingle"))
        again = each.groupBy("shingle").agg(F.count("*").alias("c")).where("c > 1").select("shingle")
        # Only where the sketch of every similar set is whole, all shared shingles are seen.
        enough = F.when(100 * F.col("n") > percent * SKETCH, F.lit(SHARED)).otherwise(F.ceil(F.col("n") * percent / 100))
        kept = each.join(again, "shingle", "left_semi").groupBy("rep", "n").agg(F.count("*").alias("c")).where(F.col("c") >= enough).select("rep")
    else:
        kept = classes.select("rep")
    kept = materialise(classes.join(kept, "rep", "left_semi").select("rep", "n", "sketch", "doc_id", "tkey"), "about")
    texts = base.join(kept.select("doc_id", "tkey", "rep"), ["doc_id", "tkey"]).select("rep", "text")
    sets = texts.mapInArrow(_sets, "rep long, shingles binary").dropDuplicates(["rep"])
    sets = materialise(sets, "sets")
    often = sets.select("shingles").mapInArrow(_often, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") > _FREQUENT)
    often = often.orderBy(F.desc("n"), "shingle").limit(_MOST_FREQUENT).collect()  # at most that many numbers; more would only be slower
    frequent = np.sort(np.array([r["shingle"] for r in often], np.int64).view(np.uint64))
    signed = sets.mapInArrow(_sign(frequent, percent), "signature long, rep long")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    members = signed.repartition(parts, "signature").sortWithinPartitions("signature", "rep").mapInArrow(_buckets, "bucket long, rep long, m long")
    members = materialise(members, "buckets")
    met = members.groupBy("rep").agg(F.sum("m").alias("met"))
    left = members.select("bucket", "rep", F.col("rep").alias("c"))

    def verified(pairs: DataFrame) -> DataFrame:
        """The links among pairs (a, b)."""
        x, y = (kept.select(*(F.col(c).alias(c + s) for c in ("rep", "n", "sketch"))) for s in ("1", "2"))
        near = pairs.join(x, F.col("a") == F.col("rep1")).join(y, F.col("b") == F.col("rep2"))
        near = near.where(100 * F.least("n1", "n2") >= percent * F.greatest("n1", "n2"))
        if sketch:
            near = near.where((F.least("n1", "n2") < SKETCH) | (F.size(F.array_intersect("sketch1", "sketch2")) >= SHARED))
        both = near.select("a", "b").join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb")), "b").join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa")), "a")
        return materialise(both.select("a", "b", "sa", "sb").mapInArrow(_verify(percent), "a long, b long"), "jaccard-links")

    def mixed(of: DataFrame, components: DataFrame) -> DataFrame:
        """(bucket, rep, c, m) of the buckets that hold several components, with their numbers of members."""
        labelled = of.select("bucket", "rep").join(components, "rep", "left").select("bucket", "rep", F.coalesce("component_id", "rep").alias("c"))
        several = labelled.groupBy("bucket").agg(F.min("c").alias("c1"), F.max("c").alias("c2"), F.count("*").alias("m")).where("c1 <> c2").select("bucket", "m")
        return materialise(labelled.join(several, "bucket"), "mixed-buckets")

    # The first pivot is the member that meets most others, which of a text and its copies is most often the text itself; later ones are so by chance.
    links = docs.sparkSession.createDataFrame([], "a long, b long")
    for r in range(max(rounds, 1)):
        chance = F.pmod(F.xxhash64("rep", F.lit(r)), F.lit(1000)) / 1000
        first = left.join(met, "rep").withColumn("met", F.col("met") if r == 0 else F.col("met") * chance)
        pivots = first.groupBy("bucket").agg(F.max(F.struct("met", "rep", "c")).alias("p"))
        star = left.join(pivots, "bucket").where("c <> p.c").groupBy("rep", F.col("p.rep").alias("pivot")).agg(F.count("*").alias("shared"))
        star = star.groupBy("rep").agg(F.max_by("pivot", F.struct("shared", "pivot")).alias("pivot")).select(F.least("pivot", "rep").alias("a"), F.greatest("pivot", "rep").alias("b")).distinct()
        found = verified(star)
        links = links.union(found)
        components = connected_components(links).withColumnRenamed("id", "rep")
        left = mixed(left, components)
    # The rest: every pair in different components.
    pairs = left.where(F.col("m") <= large).select("bucket", "rep", "c").repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_pairs(), "a long, b long").distinct()
    wide = left.where(F.col("m") > large).select("bucket", "rep", "c")
    ends = wide.join(wide.groupBy("bucket").agg(F.min("rep").alias("first")), "bucket").select(F.col("rep").alias("a"), F.col("first").alias("b")).distinct()
    clusters = connected_components(ends).select(F.col("id").alias("rep"), F.col("component_id").alias("cluster"))
    clustered = materialise(wide.select("rep", "c").distinct().join(clusters, "rep").join(kept.select("rep", "n"), "rep"), "clusters")
    sizes = clustered.groupBy("cluster").agg(F.ceil(F.sum("n") * 8 / (block_mb << 20)).alias("blocks"))
    own = clustered.join(sizes, "cluster").withColumn("own", F.pmod(F.xxhash64("rep"), "blocks"))
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    dealt = own.select("cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), side.alias("side"), "rep", "c").join(sets, "rep")
    between = dealt.repartition(parts, "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j").mapInArrow(_between(percent), "a long, b long")
    links = links.union(verified(pairs)).union(materialise(between, "jaccard-links"))
    components = connected_components(links).withColumnRenamed("id", "rep")
    known = classes.select("n", "h1", "h2", "rep", "least").join(components, "rep", "left").withColumn("c", F.coalesce("component_id", "rep"))
    known = known.join(known.groupBy("c").agg(F.min("least").alias("smallest")), "c").select("n", "h1", "h2", "smallest")
    out = linked.select("doc_id", "n", "h1", "h2").join(known, ["n", "h1", "h2"])
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.col("smallest").alias("component_id"))
    rest = rows.where("n = 0 OR doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return out.union(rest)
