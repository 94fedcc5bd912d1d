"""PCA whitening of embeddings by a bidiagonal qd solver.

The covariance is never formed. Blocks of centred rows are reduced to triangles by QR, triangles
are stacked and reduced again until one R is left, with R'R the sum of squares of all rows.
Householder reflections make R bidiagonal. The dqds algorithm (Fernando and Parlett, 1994) finds
its singular values to high relative accuracy; twisted factorisations (Dhillon and Parlett, 2004)
give each its right singular vector, and the reflections carry it back to the space of the rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import store

#: Entries become whole numbers: floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
#: Triangles that one task stacks, and rows that are reduced at a time.
FAN_IN, ROWS = 16, 2048
EPS = np.finfo(np.float64).eps
#: Components whose singular value is below this share of the largest have no direction of their own.
FLAT = 1e-13
#: Entries of this size or more count as non-finite, so that sums stay whole 64-bit numbers.
LARGEST = 2.0**30


# The bidiagonal solver: a matrix of the size of the vectors, on the driver.


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal a and superdiagonal b of an upper bidiagonal B with R = U B V', and V."""
    m = np.array(r, np.float64)
    d = len(m)
    v = np.eye(d)
    for k in range(d):
        _reflect(m[k:, k:])
        if k + 2 < d:
            w, tau = _reflect(m[k:, k + 1 :].T)
            v[:, k + 1 :] -= np.outer(tau * (v[:, k + 1 :] @ w), w)
    return np.diag(m).copy(), np.diag(m, 1).copy(), v


def _reflect(m: np.ndarray) -> tuple[np.ndarray, float]:
    """Zeroes the first column of m below its top by I - tau w w', in place."""
    x = m[:, 0].copy()
    top = np.abs(x).max()
    rest = float(np.linalg.norm(x[1:] / top)) * top if top else 0.0
    if rest == 0:
        return np.zeros(len(x)), 0.0
    alpha = -math.copysign(math.hypot(x[0], rest), x[0])
    x[0] -= alpha
    w = x / np.linalg.norm(x)
    m -= np.outer(2 * w, w @ m)
    m[0, 0], m[1:, 0] = alpha, 0.0
    return w, 2.0


def squared_singular_values(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squares of the singular values of a bidiagonal matrix by dqds, in falling order."""
    q, e = (a * a).tolist(), (b * b).tolist()
    found: list[float] = []
    blocks = [(q, e, 0.0)]
    while blocks:
        q, e, shifted = blocks.pop()
        while q:
            n = len(q)
            if n == 1:
                found.append(shifted + max(q[0], 0.0))
                break
            # An entry beside the diagonal that no longer matters splits the block there.
            cut = next((k for k in range(n - 2, -1, -1) if e[k] <= EPS * EPS * (shifted + min(q[k], q[k + 1]))), None)
            if cut is not None:
                if cut < n - 2:
                    blocks.append((q[: cut + 1], e[:cut], shifted))
                    q, e = q[cut + 1 :], e[cut + 1 :]
                else:
                    found.append(shifted + max(q.pop(), 0.0))
                    e.pop()
                continue
            if 1.5 * q[0] < q[-1]:  # the small end goes last, where it converges
                q, e = q[::-1], e[::-1]
                q, e, _ = _dqds(q, e, 0.0)
                continue
            shift = _shift(q, e)
            for _ in range(4):
                nq, ne, least = _dqds(q, e, shift)
                if least >= 0 or shift == 0:
                    break
                shift = max(0.0, shift + least) if nq and len(nq) == n and least > -0.5 * shift else 0.25 * shift
            if least < 0 and shift:
                shift = 0.0
                nq, ne, least = _dqds(q, e, 0.0)
            q, e, shifted = nq, ne, shifted + shift
    return np.array(sorted(found, reverse=True))


def _shift(q: list[float], e: list[float]) -> float:
    """A little less than the least squared singular value of the last two rows' block."""
    # The block of B'B, [[q2 + e, sqrt(e q1)], [., q1]] with the product q2 q1 of its eigenvalues.
    trace, product = q[-2] + e[-1] + q[-1], q[-2] * q[-1]
    root = math.sqrt(max(0.0, trace * trace / 4 - product))
    low = product / (trace / 2 + root) if trace > 0 else 0.0
    return max(0.0, low * 0.98)


def _dqds(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float]:
    """One differential qd transform with shift, and the least pivot d (below 0: shift too large)."""
    nq, ne = [], []
    d = q[0] - shift
    least = d
    for k in range(len(e)):
        if d < 0:
            return [], [], d
        x = d + e[k]
        nq.append(x)
        if x == 0:
            ne.append(0.0)
            d = q[k + 1] - shift
        else:
            t = q[k + 1] / x
            ne.append(e[k] * t)
            d = d * t - shift
        least = min(least, d)
    nq.append(d)
    return nq, ne, least


def right_vectors(a: np.ndarray, b: np.ndarray, squares: np.ndarray) -> np.ndarray:
    """Right singular vectors of a bidiagonal B, one column for each squared singular value.

    Vectors of values that lie close together are made orthogonal to each other as they are found.
    """
    d = len(a)
    big = float(squares[0]) if len(squares) else 0.0
    rng = np.random.default_rng(0)
    out = np.zeros((d, len(squares)))
    for k, s in enumerate(squares.tolist()):
        flat = s <= FLAT * FLAT * big  # any direction that the others leave
        close = out[:, :k] if flat else out[:, [j for j in range(k) if squares[j] - s <= 1e-3 * squares[j]]]
        if flat:
            z = rng.standard_normal(d)
        else:
            twist = _Twisted(a, b, s, big)
            z = twist.vector()
        if close.shape[1] and not flat:
            # Inverse iteration inside what the vectors found so far leave of the cluster's space.
            for turn in range(5):
                for _ in range(2):
                    z = z - close @ (close.T @ z)
                size = float(np.linalg.norm(z))
                if size < 1e-3:  # nothing of its own: any start will do
                    z = rng.standard_normal(d)
                    z = z - close @ (close.T @ z)
                    size = float(np.linalg.norm(z))
                elif turn > 2 and size > 0.5:
                    break
                z = twist.solve(z / size)
        for _ in range(2):
            z = z / np.linalg.norm(z)
            z = z - close @ (close.T @ z)
        out[:, k] = z / np.linalg.norm(z)
    return out


class _Twisted:
    """B'B - s as L+ D+ L+' from the top and as U- D- U-' from the bottom, both straight from B.

    The stationary and the progressive qd transforms never form B'B, so that small singular values
    keep their vectors. The two meet at the row whose twist gamma is closest to 0.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray, s: float, big: float):
        d = len(a)
        q, e = a * a, b * b
        self.tiny = EPS * EPS * max(s, EPS * EPS * big, 1e-290)
        self.off = (a[:-1] * b).tolist()
        self.top, self.bottom = [0.0] * d, [0.0] * d
        gamma = [0.0] * d
        x = -s
        for k in range(d):
            gamma[k] = x
            self.top[k] = p = self._kept(x + q[k])
            if k + 1 < d:
                x = e[k] / p * x - s
        x = q[-1] - s
        for k in range(d - 1, -1, -1):
            gamma[k] += x + s
            if k:
                self.bottom[k] = p = self._kept(e[k - 1] + x)
                x = q[k - 1] / p * x - s
        self.gamma = gamma
        self.r = int(np.argmin(np.abs(gamma)))

    def _kept(self, x: float) -> float:
        return x if abs(x) > self.tiny else -self.tiny

    def vector(self) -> np.ndarray:
        z = [0.0] * len(self.top)
        z[self.r] = 1.0
        return self._spread(z, [0.0] * len(z))

    def solve(self, x: np.ndarray) -> np.ndarray:
        """(B'B - s)^-1 x, scaled to a largest entry of 1."""
        y = x.tolist()
        for k in range(self.r):
            y[k + 1] -= self.off[k] / self.top[k] * y[k]
        for k in range(len(y) - 1, self.r, -1):
            y[k - 1] -= self.off[k - 1] / self.bottom[k] * y[k]
        z = [0.0] * len(y)
        z[self.r] = y[self.r] / self._kept(self.gamma[self.r])
        return self._spread(z, y)

    def _spread(self, z: list[float], y: list[float]) -> np.ndarray:
        for k in range(self.r - 1, -1, -1):
            z[k] = (y[k] - self.off[k] * z[k + 1]) / self.top[k]
        for k in range(self.r + 1, len(z)):
            z[k] = (y[k] - self.off[k - 1] * z[k - 1]) / self.bottom[k]
        out = np.array(z)
        out /= max(float(np.abs(out).max()), 1e-300)
        return out / np.linalg.norm(out)


def whitening_directions(r: np.ndarray, n: int, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues and unit eigenvectors (columns) of R'R / n, the largest first, and its trace."""
    scale = float(np.abs(r).max()) if r.size else 0.0
    trace = float((r * r).sum()) / n
    if scale == 0:
        k = min(most, r.shape[1])
        return np.zeros(k), np.eye(r.shape[1])[:, :k], trace
    a, b, v = bidiagonal(r / scale)
    squares = squared_singular_values(a, b)[:most]
    vectors = v @ right_vectors(a, b, squares)
    return squares * (scale * scale / n), vectors / np.linalg.norm(vectors, axis=0), trace


# Steps over all rows.


def _merge(rows: DataFrame, merge: Callable[[list], np.ndarray]) -> DataFrame:
    """Rows (part, data) merged, about FAN_IN in a task, until one is left.

    ``merge`` takes the float64 arrays of two rows and gives one. Any part numbers will do that
    deal the rows out evenly.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = data.values.to_numpy()
                held[part] = merge([held[part], x]) if part in held else x
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(list(held.values()), pa.list_(pa.float64()))], names=["part", "data"])

    made = store(rows, "blocks")
    left = made.count()
    while left > 1:
        groups = -(-left // FAN_IN)
        dealt = made.select((F.col("part") % groups).alias("part"), "data").repartition(groups, "part")
        made = store(dealt.mapInArrow(run, "part bigint, data array<double>"), "blocks")
        left = made.count()
    return made


def _blocks(batch: pa.RecordBatch, column: int, dim: int) -> Iterator[tuple[int, np.ndarray]]:
    """First row and whole-number matrix of up to ROWS rows at a time."""
    lists = batch.column(column)
    flat = lists.flatten().to_numpy().reshape(-1, dim)
    for begin in range(0, len(flat), ROWS):
        yield begin, flat[begin : begin + ROWS]


def _numbered(vectors: DataFrame, step: Callable) -> DataFrame:
    """One row a task with the array that ``step`` makes of the task's batches; part: the task."""
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = step(batches)
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([out.ravel()], pa.list_(pa.float64()))], names=["part", "data"])

    return vectors.select("x").mapInArrow(run, "part bigint, data array<double>")


def usable(vector: Column) -> Column:
    """Not null and without null, non-finite or enormous entries."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= LARGEST)
    return vector.isNotNull() & ~F.exists(vector, bad)


def whiten(vectors: DataFrame, components: int = 32, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Whitened coordinates of all usable vectors on their leading principal components.

    Vectors that are null or hold null or non-finite entries (or any of 2^30 or more) are left out, as are
    empty ones and, where lengths differ, those not of the most frequent length (the longer of equals).
    Entry c becomes x = floor(SCALE c) + OFFSET. All vectors left are the fit list: n of them with
    sums S. One row for each vector and component (1, 2, 3... by falling eigenvalue, up to
    ``components`` or the dimension): ``vec_id``, ``component``, ``n``, ``deviation`` (sum of
    (n x - S)^2 over dimensions, exact; null above the largest bigint), ``whitened`` (x - S/n
    on the unit eigenvector over the root of the eigenvalue), ``explained`` (eigenvalue over
    the trace), ``identity_error`` (largest entry of the covariance of all whitened values less the
    identity). Components along which nothing varies (n of 1, equal rows, dependent dimensions)
    have a null ``whitened`` and do not count in the error, which is 0 if there are no others; with no
    variance at all ``explained`` is null. Null and repeated ids, and repeated rows, count and are
    returned each. Equal eigenvalues share a space, of which some orthogonal directions are taken.
    An empty table gives no rows. Other columns, whatever their names, are not read.

    The driver sees matrices of the vectors' dimension only. Four passes read the vectors: sums, QR,
    error, result.
    """
    entry = F.transform(vectors[vector_col], lambda c: c.cast("double"))
    whole = F.transform(F.col("v"), lambda c: F.floor(c * SCALE).cast("bigint") + OFFSET)
    given = vectors.select(vectors[id_col].alias("vec_id"), entry.alias("v")).where(usable(F.col("v")) & (F.size("v") > 0))
    lengths = given.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    empty = vectors.sparkSession.createDataFrame([], _result_ddl(given))
    if lengths is None:
        return empty
    dim, n = lengths
    fit = given.where(F.size("v") == dim).select("vec_id", whole.alias("x"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dim, np.int64)
        for batch in batches:
            total += batch.column(0).flatten().to_numpy().reshape(-1, dim).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), pa.array(total)], names=["at", "s"])

    by_place = fit.select("x").mapInArrow(sums, "at bigint, s bigint").groupBy("at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    s = [int(r.s) for r in by_place.orderBy("at").collect()]  # one row a dimension
    # n x - S as whole numbers, split so that no product leaves 64 bits: with S = n m + rest, it is n (x - m) - rest.
    mean, rest = np.array([t // n for t in s], np.int64), np.array([t % n for t in s], np.int64)

    def centred(x: np.ndarray) -> np.ndarray:
        return (x - mean) - rest / n

    def reduce_rows(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        r = None
        for batch in batches:
            for _, x in _blocks(batch, 0, dim):
                r = _triangle([centred(x)] if r is None else [r, centred(x)], dim)
        return r

    triangles = _merge(_numbered(fit, reduce_rows), lambda rs: _triangle([x.reshape(-1, dim) for x in rs], dim).ravel())
    r = np.array(triangles.first().data).reshape(-1, dim)
    values, directions, trace = whitening_directions(r, n, min(components, dim))
    k = len(values)
    varies = values > FLAT * FLAT * values[0] if k and values[0] > 0 else np.zeros(k, bool)
    onto = directions / np.sqrt(np.where(varies, values, 1.0))

    def moments(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        held = None
        for batch in batches:
            for _, x in _blocks(batch, 0, dim):
                w = centred(x) @ onto
                m = w.mean(axis=0)
                c = w - m
                own = np.r_[float(len(w)), m, (c.T @ c).ravel()]
                held = own if held is None else _moments([held, own], k)
        return held

    total = np.array(_merge(_numbered(fit, moments), lambda ms: _moments(ms, k)).first().data)
    off = np.abs(total[1 + k :].reshape(k, k) / n - np.eye(k))[np.ix_(varies, varies)]
    error = float(off.max()) if off.size else 0.0

    share = (values / trace).tolist() if trace > 0 else [None] * k
    kind = fit.schema["vec_id"].dataType.simpleString()
    flat = ~varies

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, x in _blocks(batch, 1, dim):
                rows = len(x)
                w = (centred(x) @ onto).ravel()
                ids = batch.column(0).slice(begin, rows).take(pa.array(np.repeat(np.arange(rows), k)))
                deviation = pa.array(_deviations(x, mean, rest, n), pa.int64()).take(pa.array(np.repeat(np.arange(rows), k)))
                whitened = pa.array(w, pa.float64(), mask=np.tile(flat, rows))
                place = pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows))
                yield pa.RecordBatch.from_arrays([ids, place, deviation, whitened], names=["vec_id", "component", "deviation", "whitened"])

    out = fit.mapInArrow(project, f"vec_id {kind}, component int, deviation bigint, whitened double")
    explained = F.element_at(F.array(*[F.lit(x).cast("double") for x in share]), F.col("component"))
    return out.select("vec_id", "component", F.lit(n).cast("bigint").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))


def _result_ddl(given: DataFrame) -> str:
    return f"vec_id {given.schema['vec_id'].dataType.simpleString()}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def _triangle(parts: list[np.ndarray], dim: int) -> np.ndarray:
    """The R of all rows, always dim by dim."""
    r = np.linalg.qr(np.vstack(parts), mode="r")
    return np.vstack([r, np.zeros((dim - len(r), dim))]) if len(r) < dim else r


def _moments(parts: list[np.ndarray], k: int) -> np.ndarray:
    """Count, mean and centred products of two or more groups of rows together."""
    out = parts[0]
    for y in parts[1:]:
        a, b = out[0], y[0]
        step = y[1 : 1 + k] - out[1 : 1 + k]
        products = out[1 + k :] + y[1 + k :] + (np.outer(step, step) * (a * b / (a + b))).ravel()
        out = np.r_[a + b, out[1 : 1 + k] + step * (b / (a + b)), products]
    return out


def _deviations(x: np.ndarray, mean: np.ndarray, rest: np.ndarray, n: int) -> list[int | None]:
    """Sum of (n x - S)^2 of each row, exact; None if it is no 64-bit number."""
    narrow = x - mean
    most = n * (int(np.abs(narrow).max(initial=0)) + 1)
    if most * most * x.shape[1] < 2**63:
        y = narrow * n - rest
        return (y * y).sum(axis=1).tolist()
    out = [sum((n * a - c) ** 2 for a, c in zip(row, rest.tolist(), strict=True)) for row in narrow.tolist()]
    return [t if t < 2**63 else None for t in out]
