"""Embedding near-dedup by an epsilon grid order join.

Vectors of length 1 with a cosine of at least c are at most eps = sqrt(2 - 2 c) apart. They are
turned to their principal directions, which keeps distances, and sorted by the cells of a grid of
width eps on the leading ones. The sequence is cut into blocks. Only pairs of blocks whose boxes
are within eps meet; a pair is joined recursively: halves whose boxes lie further apart are
skipped, small rests are compared exactly (Böhm et al., SIGMOD 2001).

Equal vectors are one row with a count. A pair of blocks gives the number of links of each vector
and a forest of them, never all pairs, so the result is linear in the vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import connected_components, spread, store

#: Vectors of a block, and of the rest that is compared at once.
BLOCK, REST = 512, 64
#: Leading directions for the grid, and for boxes.
GRID, BOX = 3, 16
_SLACK = 1e-9


def _vector(value) -> np.ndarray | None:
    """The vector in double precision at length 1; None if it can link with nothing."""
    if not value.is_valid:
        return None
    inner = value.values
    if inner.null_count or not len(inner):
        return None
    x = inner.to_numpy(zero_copy_only=False).astype(np.float64)
    if not np.isfinite(x).all():
        return None
    peak = np.abs(x).max()
    if peak == 0:
        return None
    x = x / peak
    return x / math.sqrt(float(x @ x))


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, label, dims, hi, lo, unit): unit is null where the row can link with nothing."""
    for batch in batches:
        rows = []
        for i, label, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            x = _vector(value) if label is not None and i is not None else None
            if x is None:
                rows.append((i, label, None, None, None, None))
            else:
                raw = x.tobytes()
                h = xxhash.xxh3_128_intdigest(raw)
                rows.append((i, label, len(x), (h >> 64) - (1 << 63), (h & (2**64 - 1)) - (1 << 63), raw))
        if rows:
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["vec_id", "label", "dims", "hi", "lo", "unit"])


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(dims, row, sums) of the second moments of a task's vectors."""
    found: dict[int, np.ndarray] = {}
    for batch in batches:
        by: dict[int, list[bytes]] = {}
        for dims, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            by.setdefault(dims, []).append(raw)
        for dims, raws in by.items():
            x = np.frombuffer(b"".join(raws)).reshape(-1, dims)
            found[dims] = found.get(dims, 0) + x.T @ x
    for dims, m in found.items():
        n = np.arange(dims * dims)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), dims, np.int32)), pa.array(n.astype(np.int32)), pa.array(m.ravel())], names=["dims", "cell", "value"])


def _directions(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For each number of dimensions, the principal directions of all its vectors, in columns."""
    sums = vectors.select("dims", "unit").mapInArrow(_moments, "dims int, cell int, value double").groupBy("dims", "cell").agg(F.sum("value").alias("value")).toPandas()
    out = {}
    for dims, part in sums.groupby("dims"):
        m = part.sort_values("cell").value.to_numpy().reshape(dims, dims)
        out[int(dims)] = np.ascontiguousarray(np.linalg.eigh((m + m.T) / 2)[1][:, ::-1])
    return out


def _turn(batches: Iterator[pa.RecordBatch], turns: dict[int, np.ndarray], eps: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        dims = batch.column(2).to_pylist()
        cells, raws = [], []
        for d, raw in zip(dims, batch.column(4).to_pylist(), strict=True):
            x = np.frombuffer(raw) @ turns[d]
            cells.append([*np.floor(x[:GRID] / eps).astype(int).tolist(), *[0] * GRID][:GRID])
            raws.append(x.tobytes())
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(raws, pa.binary()), pa.array(cells, pa.list_(pa.int32()))], names=["rep", "label", "dims", "n", "unit", "cells"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted vectors to blocks: label, dims, ids, counts, matrix and the box on leading directions."""
    key, ids, counts, raws = None, [], [], []

    def block():
        x = np.frombuffer(b"".join(raws)).reshape(len(ids), -1)[:, :BOX]
        return pa.RecordBatch.from_arrays(
            [pa.array([ids[0]]), pa.array([key[0]]), pa.array([key[1]], pa.int32()), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()),
             pa.array([np.array(counts, np.int64).tobytes()], pa.binary()), pa.array([b"".join(raws)], pa.binary()),
             pa.array([x.min(0).tolist()], pa.list_(pa.float64())), pa.array([x.max(0).tolist()], pa.list_(pa.float64()))],
            names=["block", "label", "dims", "ids", "counts", "matrix", "low", "high"],
        )

    for batch in batches:
        for i, label, dims, n, raw in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            if ids and (key != (label, dims) or len(ids) >= BLOCK):
                yield block()
                ids, counts, raws = [], [], []
            key = (label, dims)
            ids.append(i), counts.append(n), raws.append(raw)
    if ids:
        yield block()


def _near(x: np.ndarray, y: np.ndarray, eps: float) -> bool:
    gap = np.maximum(0, np.maximum(x[:, :BOX].min(0) - y[:, :BOX].max(0), y[:, :BOX].min(0) - x[:, :BOX].max(0)))
    return float(gap @ gap) <= eps * eps + _SLACK


def join_sequences(x: np.ndarray, y: np.ndarray, same: bool, cosine: float, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of all linked pairs of two sorted sequences (i < j if they are the same)."""
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def walk(a: int, b: int, c: int, d: int) -> None:
        if same and d <= a + 1 or a == b or c == d or not _near(x[a:b], y[c:d], eps):
            return
        if b - a <= REST and d - c <= REST:
            i, j = np.nonzero(x[a:b] @ y[c:d].T >= cosine)
            i, j = i + a, j + c
            found.append((i[i < j], j[i < j]) if same else (i, j))
            return
        one = [(a, (a + b) // 2), ((a + b) // 2, b)] if b - a > REST else [(a, b)]
        two = [(c, (c + d) // 2), ((c + d) // 2, d)] if d - c > REST else [(c, d)]
        for p in one:
            for q in two:
                walk(*p, *q)

    walk(0, len(x), 0, len(y))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _forest(i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect as much as all of them, without a circle."""
    up: dict[int, int] = {}

    def root(v: int) -> int:
        while (p := up.setdefault(v, v)) != v:
            up[v] = v = up[p]
        return v

    kept = []
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        ra, rb = root(a), root(b)
        if ra != rb:
            up[max(ra, rb)] = min(ra, rb)
            kept.append((a, b))
    return kept


def _compare(batches: Iterator[pa.RecordBatch], cosine: float, eps: float) -> Iterator[pa.RecordBatch]:
    """Pairs of blocks: (a, b, n), either links of vector a (b null) or a link of the forest."""
    for batch in batches:
        a_out, b_out, n_out = [], [], []
        for same, ia, na, xa, ib, nb, xb in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            ia, ib, na, nb = (np.frombuffer(v, np.int64) for v in (ia, ib, na, nb))
            x, y = np.frombuffer(xa).reshape(len(ia), -1), np.frombuffer(xb).reshape(len(ib), -1)
            i, j = join_sequences(x, y, same, cosine, eps)
            if not len(i):
                continue
            for ids, at, other in ((ia, i, nb[j]), (ib, j, na[i])):
                links = np.bincount(at, other, len(ids)).astype(np.int64)
                some = np.flatnonzero(links)
                a_out += ids[some].tolist()
                b_out += [None] * len(some)
                n_out += links[some].tolist()
            for p, q in _forest(i, j if same else j + len(ia)):
                a_out.append(int(ia[p]))
                b_out.append(int(ia[q] if same else ib[q - len(ia)]))
                n_out.append(0)
        yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64()), pa.array(n_out, pa.int64())], names=["a", "b", "n"])


def near_embeddings(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.93) -> DataFrame:
    """Links vectors of one label whose cosine is at least the given one; exact, not by sample.

    One row for each vector: vec_id, n_links, component_id (smallest id reachable), kept. Vectors
    that are null, empty, zero or hold null or non-finite components, and those with a null label,
    link with nothing; neither do vectors of different lengths. Rows with a null id are returned
    without links and with a null component, and are kept. Rows that repeat an id and vector count
    as copies. Other columns are not read; an empty table gives no rows.
    """
    eps = math.sqrt(max(0.0, 2 - 2 * cosine)) + _SLACK
    given = vectors.select(vectors[id_col].cast("bigint"), vectors[label_col].cast("string"), vectors[vector_col])
    rows = store(given.mapInArrow(_clean, "vec_id bigint, label string, dims int, hi bigint, lo bigint, unit binary"), "vectors")
    valid = rows.where("unit is not null")
    one = ["label", "dims", "hi", "lo"]
    reps = valid.groupBy(*one).agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.any_value("unit").alias("unit"))
    reps = store(reps, "distinct")
    turns = _directions(reps)
    turned = reps.select("rep", "label", "dims", "n", "unit").mapInArrow(
        lambda it: _turn(it, turns, eps), "rep bigint, label string, dims int, n bigint, unit binary, cells array<int>"
    )
    order = ["label", "dims", "cells", "rep"]
    packed = store(turned, "turned").repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        _pack, "block bigint, label string, dims int, ids binary, counts binary, matrix binary, low array<double>, high array<double>"
    )
    blocks = store(packed, "blocks")
    # Blocks meet in cells of the first direction, then by the gaps between their boxes.
    cell = lambda c: F.floor(F.col(c)[0] / eps)
    box = blocks.select("block", "label", "dims", "low", "high")
    mine = box.withColumn("cell", F.explode(F.sequence(cell("low"), cell("high"))))
    theirs = box.select("label", "dims", F.col("block").alias("block2"), F.col("low").alias("low2"), F.col("high").alias("high2"), F.explode(F.sequence(cell("low") - 1, cell("high") + 1)).alias("cell"))
    gap = F.zip_with(
        F.zip_with("low", "high2", lambda p, q: p - q), F.zip_with("low2", "high", lambda p, q: p - q), lambda p, q: F.greatest(p, q, F.lit(0.0))
    )
    apart = F.aggregate(gap, F.lit(0.0), lambda s, v: s + v * v)
    met = mine.join(theirs, ["label", "dims", "cell"]).where((F.col("block") <= F.col("block2")) & (apart <= eps * eps + _SLACK))
    met = met.select("block", "block2").distinct()
    body = ["ids", "counts", "matrix"]
    left, right = blocks.select("block", *body), blocks.select(F.col("block").alias("block2"), *(F.col(c).alias(f"{c}2") for c in body))
    both = met.join(left, "block").join(right, "block2").select((F.col("block") == F.col("block2")).alias("same"), *body, *(f"{c}2" for c in body))
    links = store(both.mapInArrow(lambda it: _compare(it, cosine, eps), "a bigint, b bigint, n bigint"), "links")
    labels = connected_components(links.where("b is not null"), "a", "b")
    counts = links.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links"))
    known = reps.drop("unit").join(spread(counts), "rep", "left").join(spread(labels), F.col("rep") == labels.node, "left")
    known = store(known.select(*one, "rep", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "known")
    out = rows.select("vec_id", *one).join(spread(known), one, "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    )
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
