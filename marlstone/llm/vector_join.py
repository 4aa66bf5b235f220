"""Near-duplicate vectors by an epsilon grid order join.

On unit vectors, cosine >= t means a distance of at most eps = sqrt(2 - 2 t), and no projection lengthens a distance. Vectors are
laid on a grid of side eps over the leading principal dimensions and sorted by label and cell, first dimension
first. Sorted sequences are cut into blocks; two blocks can hold a link only if their cell boxes come within one cell of
each other in every dimension. Such pairs of blocks are joined recursively: both are halved in the sort order, halves whose boxes are
provably distant are skipped, and small halves are compared by a matrix product in double precision.

Neighbouring blocks of the sorted sequence form a group. A task joins two groups that have near blocks, and holds no more than these, so a block's vectors are sent
once for each group that is near, not once for each block.

Equal vectors are one class from the start, with their number as its weight. A pair of blocks yields, for each class, its number of
links and the links of a spanning forest only, so a dense group costs rows in proportion to its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Union, connected_components, materialise

_LEAF = 64


def leading_dimensions(units: DataFrame, k: int) -> dict[int, np.ndarray]:
    """By vector size n: the (n, k) leading principal directions of all unit vectors. Each task sends one n by n matrix."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for n, v in _by_size(batch["unit"]):
                m = np.concatenate([v, np.ones((len(v), 1))], axis=1)
                sums[n] = sums.get(n, 0) + m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["n", "sums"])

    total: dict[int, np.ndarray] = {}
    for r in units.select("unit").mapInArrow(moments, "n int, sums binary").toLocalIterator():
        total[r["n"]] = total.get(r["n"], 0) + np.frombuffer(r["sums"]).reshape(r["n"] + 1, -1)
    out = {}
    for n, s in total.items():
        mean = s[n, :n] / s[n, n]
        _, directions = np.linalg.eigh(s[:n, :n] / s[n, n] - np.outer(mean, mean))
        out[n] = directions[:, ::-1][:, :k]
    return out


def _with_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A unit vector beside each v, which has components and is not zero; scaled first, so that no square overflows."""
    for batch in batches:
        if batch.num_rows:
            sizes = batch["v"].value_lengths().to_numpy(zero_copy_only=False)
            flat, ends = batch["v"].flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes)
            starts = ends - sizes
            flat = flat / np.repeat(np.maximum.reduceat(np.abs(flat), starts), sizes)
            flat = flat / np.repeat(np.sqrt(np.add.reduceat(flat * flat, starts)), sizes)
            unit = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*batch.columns, unit], names=[*batch.schema.names, "unit"])


def _by_size(column: pa.Array) -> list[tuple[int, np.ndarray]]:
    """(n, the vectors of n components) of a list column."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    return [(int(n), flat[starts[sizes == n][:, None] + np.arange(n)]) for n in np.unique(sizes)]


def join_blocks(a: tuple, b: tuple, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Weighted links of each row of a and of b, and a spanning forest of (row of a, row of b), b's rows after a's.

    a, b: vectors, cells, weights. The recursion of the grid order join.
    """
    (va, ca, wa), (vb, cb, wb) = a, b
    na, nb = np.sqrt((va * va).sum(axis=1)), np.sqrt((vb * vb).sum(axis=1))
    links_a, links_b, edges = np.zeros(len(va), np.int64), np.zeros(len(vb), np.int64), []
    sets = Union(len(va) + (0 if same else len(vb)))
    shift = 0 if same else len(va)

    def join(i: int, j: int, k: int, m: int) -> None:
        if same and k < i:
            return
        if i >= j or k >= m:
            return
        if ((ca[i:j].min(axis=0) > cb[k:m].max(axis=0) + 1) | (cb[k:m].min(axis=0) > ca[i:j].max(axis=0) + 1)).any():
            return
        if j - i <= _LEAF and m - k <= _LEAF:
            close = (va[i:j] @ vb[k:m].T) / (na[i:j, None] * nb[None, k:m]) >= threshold
            if same and i == k:
                np.fill_diagonal(close, False)
            if close.any():
                links_a[i:j] += close @ wb[k:m]
                if not same:
                    links_b[k:m] += close.T @ wa[i:j]
                elif i != k:
                    links_a[k:m] += close.T @ wa[i:j]
                for x, y in zip(*np.nonzero(close), strict=True):
                    x, y = int(x) + i, int(y) + k + shift
                    if sets.join(x, y):
                        edges.append((x, y))
            return
        p, q = (i + j) // 2 // _LEAF * _LEAF if j - i > _LEAF else j, (k + m) // 2 // _LEAF * _LEAF if m - k > _LEAF else m
        p, q = p if p > i else min(i + _LEAF, j), q if q > k else min(k + _LEAF, m)
        for x, y in ((i, p), (p, j)):
            for u, v in ((k, q), (q, m)):
                join(x, y, u, v)

    join(0, len(va), 0, len(vb))
    return links_a, links_b, edges


def link_vectors(vectors: DataFrame, threshold: float = 0.93, dims: int = 8, block: int = 256, group: int = 32) -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept.

    Rows link when their labels are equal and not null, their vectors have equal sizes and a cosine of at least threshold
    in double precision. Null, empty and zero vectors and those with null or non-finite components link with nothing, nor do rows
    without a vec_id. component_id is the smallest vec_id reached; kept: vec_id = component_id, or true for rows without vec_id. Repeated rows
    are vectors of their own and link with each other. Very long vectors are compared whole. Other columns are not read. An empty table gives an empty result.
    dims: leading dimensions of the grid; block: vectors of a block; group: blocks of a group.
    """
    number = F.col("embedding").cast("array<double>")
    rows = vectors.select("vec_id", "label", number.alias("v"))
    # Null and non-finite components, and zero vectors, fail the test; x - x is 0 for finite x only.
    fine = F.coalesce(F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))) & F.exists("v", lambda x: x != 0), F.lit(False))
    valid = fine & F.col("vec_id").isNotNull() & F.col("label").isNotNull()
    rows = rows.withColumn("v", F.when(valid, F.transform("v", lambda x: x + 0.0)))
    classes = rows.where("v IS NOT NULL").groupBy("label", "v").agg(F.count("*").alias("weight"), F.min("vec_id").alias("rep"))
    label_type = dict(vectors.dtypes)["label"]
    classes = materialise(classes.mapInArrow(_with_units, f"label {label_type}, v array<double>, weight long, rep long, unit array<double>"), "classes")
    axes = leading_dimensions(classes, dims)
    side = float(np.sqrt(2 - 2 * threshold)) + 1e-9

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit, cells = batch["unit"], [None] * batch.num_rows
            sizes = unit.value_lengths().to_numpy(zero_copy_only=False)
            for n, v in _by_size(unit):
                c = np.zeros((len(v), dims), np.int64)
                c[:, : axes[n].shape[1]] = np.floor(v @ axes[n] / side)
                for i, x in zip(np.flatnonzero(sizes == n), c, strict=True):
                    cells[i] = x
            yield pa.RecordBatch.from_arrays([batch["label"], batch["rep"], batch["weight"], unit, pa.array(sizes, pa.int32()), pa.array(cells, pa.list_(pa.int64()))], names=["label", "rep", "weight", "unit", "n", "cell"])

    placed = classes.select("label", "rep", "weight", "unit").mapInArrow(place, f"label {label_type}, rep long, weight long, unit array<double>, n int, cell array<long>")
    ordered = placed.repartitionByRange("label", "n", "cell", "rep").sortWithinPartitions("label", "n", "cell", "rep")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        number = 0

        def flush() -> pa.RecordBatch:
            nonlocal number
            _, n, _, _, _, _ = rows[0]
            own = (TaskContext.get().partitionId() << 32) + number // group
            number += 1
            cells = np.array([r[2] for r in rows])
            return pa.RecordBatch.from_arrays(
                [pa.array([rows[0][0]], label), pa.array([n], pa.int32()), pa.array([own], pa.int64()), pa.array([rows[0][3]], pa.int64()), pa.array([cells.min(axis=0)], pa.list_(pa.int64())), pa.array([cells.max(axis=0)], pa.list_(pa.int64())), *(pa.array([x.tobytes()], pa.binary()) for x in (np.array([r[5] for r in rows], np.float64), cells, np.array([r[4] for r in rows], np.int64), np.array([r[3] for r in rows], np.int64)))],
                names=["label", "n", "grp", "block", "lo", "hi", "vectors", "cells", "weights", "ids"],
            )

        label = None
        for batch in batches:
            label = batch["label"].type
            for row in zip(*(batch[c].to_pylist() for c in ("label", "n", "cell", "rep", "weight", "unit")), strict=True):
                if rows and (len(rows) == block or rows[-1][:2] != row[:2]):
                    yield flush()
                    rows = []
                rows.append(row)
        if rows:
            yield flush()

    blocks = materialise(ordered.mapInArrow(cut, f"label {label_type}, n int, grp long, block long, lo array<long>, hi array<long>, vectors binary, cells binary, weights binary, ids binary"), "blocks")
    boxes = blocks.select("label", "n", "grp", "block", "lo", "hi")
    one = boxes.withColumn("at", F.explode(F.sequence(F.col("lo")[0], F.col("hi")[0])))
    two = boxes.withColumn("at", F.explode(F.sequence(F.col("lo")[0] - 1, F.col("hi")[0] + 1))).select("label", "n", "at", *(F.col(c).alias(c + "2") for c in ("grp", "block", "lo", "hi")))
    near = F.forall(F.arrays_zip("lo", "hi", "lo2", "hi2"), lambda x: (x["lo"] <= x["hi2"] + 1) & (x["lo2"] <= x["hi"] + 1))
    pairs = one.join(two, ["label", "n", "at"]).where("block <= block2").where(near).select("grp", "block", "grp2", "block2").distinct()
    pairs = materialise(pairs.select(F.least("grp", "grp2").alias("g1"), F.greatest("grp", "grp2").alias("g2"), "block", "block2"), "block-pairs")
    data = ["vectors", "cells", "weights", "ids"]
    groups = pairs.select("g1", "g2").distinct()
    sides = groups.select("g1", "g2", F.explode(F.array_distinct(F.array("g1", "g2"))).alias("grp"))
    sent = sides.join(blocks.select("grp", "block", *data), "grp").select("g1", "g2", F.lit(0).alias("kind"), "block", F.lit(None).cast("long").alias("block2"), *data)
    asked = pairs.select("g1", "g2", F.lit(1).alias("kind"), "block", "block2", *(F.lit(None).cast("binary").alias(c) for c in data))
    tasks = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), groups.count())
    joined = sent.unionByName(asked).repartition(tasks, "g1", "g2").sortWithinPartitions("g1", "g2", "kind", "block", "block2")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, {}
        for batch in batches:
            for i, (key, kind, left, right) in enumerate(zip(zip(batch["g1"].to_pylist(), batch["g2"].to_pylist(), strict=True), *(batch[c].to_pylist() for c in ("kind", "block", "block2")), strict=True)):
                if key != current:
                    current, held = key, {}
                if kind == 0:
                    w, ids = (np.frombuffer(batch[c][i].as_py(), np.int64) for c in ("weights", "ids"))
                    held[left] = (np.frombuffer(batch["vectors"][i].as_py()).reshape(len(ids), -1), np.frombuffer(batch["cells"][i].as_py(), np.int64).reshape(len(ids), -1), w), ids
                    continue
                (a, ids), (b, ids2) = held[left], held[right]
                same = left == right
                na, nb, edges = join_blocks(a, b, same, threshold)
                names = ids if same else np.concatenate([ids, ids2])
                counted = na if same else np.concatenate([na, nb])
                some = np.flatnonzero(counted)
                if len(some):
                    e = np.array(edges, np.int64).reshape(-1, 2)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([names[some], names[e[:, 0]]])), pa.array([None] * len(some) + names[e[:, 1]].tolist(), pa.int64()), pa.array(np.concatenate([counted[some], np.zeros(len(e), np.int64)]))], names=["a", "b", "n"])

    found = materialise(joined.mapInArrow(compare, "a long, b long, n long"), "vector-links")
    links = found.where("b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    components = connected_components(found.where("b IS NOT NULL").select("a", "b")).withColumnRenamed("id", "rep")
    known = classes.select("label", "v", "rep", "weight").join(links, "rep", "left").join(components, "rep", "left")
    out = rows.join(known, ["label", "v"], "left")
    n_links = F.coalesce(F.col("weight") - 1 + F.coalesce("others", F.lit(0)), F.lit(0))
    component = F.coalesce("component_id", "rep", "vec_id")
    return out.select("vec_id", n_links.cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
