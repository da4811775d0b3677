"""PCA whitening of embeddings. The leading eigenvalues of the covariance are isolated by spectrum slicing: the inertia of V - s I, read off a block
LDL' factorisation, counts the eigenvalues above s. Rayleigh quotient iteration then converges to each one, and counts on either side certify its number.

Everything that grows with the rows is done in the tasks: three passes leave sums (of the vectors, of their centred products, of the whitened
products), which meet by matrix row; the driver sees matrices of d x d numbers, whatever the number of vectors. The last pass writes the rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlog.llm.common import small
from factlog.session import partitions

SCALE, SHIFT = 64, 1_000_000
LIMIT = float(1 << 52)  # entries are held within this, which is far beyond what embeddings hold, so that integers stay exact
OUTPUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


# --- the spectrum of a symmetric matrix ---


def inertia(a: np.ndarray) -> int:
    """How many eigenvalues of the symmetric matrix are positive: of its block-diagonal factor in an LDL' factorisation with the pivots of Bunch and Kaufman,
    which has the same number of them (Sylvester)."""
    a, alpha, positive = a.copy(), (1 + math.sqrt(17)) / 8, 0
    while (n := len(a)) > 0:
        column = np.abs(a[:, 0])
        r = 1 + int(np.argmax(column[1:])) if n > 1 else 0
        most = column[r] if n > 1 else 0.0
        two = False
        if max(column[0], most) > 0 and column[0] < alpha * most:
            other = np.abs(a[:, r]).copy()
            other[r] = 0.0
            sigma = other.max()
            if column[0] * sigma < alpha * most * most:
                if abs(a[r, r]) >= alpha * sigma:
                    a[[0, r]] = a[[r, 0]]
                    a[:, [0, r]] = a[:, [r, 0]]
                else:
                    two = True
                    a[[1, r]] = a[[r, 1]]
                    a[:, [1, r]] = a[:, [r, 1]]
        if two:
            block, side = a[:2, :2], a[2:, :2]
            determinant = block[0, 0] * block[1, 1] - block[0, 1] ** 2
            positive += 1 if determinant < 0 else 2 * int(block[0, 0] > 0)
            inverse = np.array([[block[1, 1], -block[0, 1]], [-block[0, 1], block[0, 0]]]) / determinant
            a = a[2:, 2:] - side @ inverse @ side.T
        else:
            pivot, side = a[0, 0], a[1:, 0]
            positive += int(pivot > 0)
            a = a[1:, 1:] - np.outer(side, side / pivot) if pivot != 0 else a[1:, 1:]
    return positive


class Spectrum:
    """Counts of eigenvalues above a shift, each made once."""

    def __init__(self, v: np.ndarray):
        self.v, self.eye, self.counts = v, np.eye(len(v)), {}
        reach = np.abs(v).sum(axis=1) - np.abs(np.diag(v))
        margin = 1e-9 * max(np.abs(v).sum(axis=1).max(), 1e-300)
        self.low, self.high = float((np.diag(v) - reach).min() - margin), float((np.diag(v) + reach).max() + margin)  # Gershgorin
        self.tiny = 64 * np.finfo(float).eps * max(abs(self.low), abs(self.high))

    def above(self, shift: float) -> int:
        if shift not in self.counts:
            self.counts[shift] = inertia(self.v - shift * self.eye)
        return self.counts[shift]

    def slices(self, most: int) -> list[tuple[float, float, int, int]]:
        """Intervals from above, `(low, high, first, last)`: each holds the eigenvalues numbered first to last (from 1, falling); one each, but for those that
        no double tells apart. They end where the first `most` are covered."""
        out, open_ = [], [(self.low, self.high, 0, len(self.v))]
        while open_:
            low, high, over, total = open_.pop()  # over: how many lie above high; total: above low
            if total == over or over >= most:
                continue
            if total - over == 1 or high - low <= self.tiny:
                out.append((low, high, over + 1, total))
                continue
            middle = (low + high) / 2
            split = min(max(self.above(middle), over), total)
            open_ += [(low, middle, split, total), (middle, high, over, split)]
        return sorted(out, key=lambda s: s[2])

    def pair(self, low: float, high: float, first: int, last: int, known: list[np.ndarray]) -> tuple[float, np.ndarray, bool]:
        """An eigenvalue of the slice that holds those numbered first to last, its unit vector, and whether counts certify the numbers. known: vectors
        found before whose eigenvalues are so near that rounding could lead to them again."""
        rng = np.random.default_rng(first + len(known))
        basis = np.stack(known) if known else np.zeros((0, len(self.v)))

        def clear(x: np.ndarray) -> np.ndarray:
            for _ in range(2):  # what the first subtraction leaves by rounding goes with the second
                x = x / np.linalg.norm(x)
                x = x - basis.T @ (basis @ x)
            return x

        x = clear(rng.normal(size=len(self.v)))
        x /= np.linalg.norm(x)
        ends, shift, settled, left = (low, high), (low + high) / 2, False, 0.0
        for step in range(200):
            x = clear(self._solve(shift, x))
            x /= np.linalg.norm(x)
            quotient = float(x @ self.v @ x)
            left = float(np.linalg.norm(self.v @ x - quotient * x))
            inside = ends[0] <= quotient <= ends[1]
            if left <= self.tiny / 4 and (inside or high - low <= self.tiny):
                if settled:
                    break
                settled = True
            # the quotient is followed once its error bound stays inside the slice; before, the slice is halved by counts and the shift stays within
            if inside and left < min(quotient - low, high - quotient) or high - low <= self.tiny and left < 1e3 * self.tiny:
                shift = quotient
            elif step % 3 == 2 and high - low > self.tiny:
                middle = (low + high) / 2
                low, high = (middle, high) if self.above(middle) >= first else (low, middle)
                shift = (low + high) / 2
        near = max(left, self.tiny)
        certain = self.above(quotient - near) >= first and self.above(quotient + near) < last
        return quotient, x, certain

    def _solve(self, shift: float, x: np.ndarray) -> np.ndarray:
        for nudge in (0.0, self.tiny / 64, self.tiny):
            try:
                y = np.linalg.solve(self.v - (shift + nudge) * self.eye, x)
            except np.linalg.LinAlgError:
                continue
            if np.isfinite(y).all():
                return y
        return x

    def leading(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        """The `most` largest eigenvalues, falling, and their unit vectors as rows."""
        values, vectors, close = [], [], 1e-6 * max(abs(self.low), abs(self.high))
        for low, high, first, last in self.slices(most):
            found: list[tuple[float, np.ndarray]] = []
            for _ in range(min(last, most) - first + 1):
                known = [x for e, x in [*zip(values, vectors, strict=True), *found] if e - high <= close]
                value, vector, certain = self.pair(low, high, first, last, known)
                if not certain:
                    raise ArithmeticError(f"the number of eigenvalue {first} is not certified")
                found.append((value, vector))
            for value, vector in sorted(found, key=lambda p: -p[0]):
                values.append(value)
                vectors.append(vector)
        return np.array(values), np.array(vectors).reshape(len(values), len(self.v))


# --- sums over all vectors ---


def good_vectors(vectors: DataFrame) -> DataFrame:
    """`(vec_id, embedding, size)` of the rows whose vector has entries, all of them finite."""
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~bad).withColumn("size", F.size("embedding"))


def integers(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For every length of vectors in the batch: the length, its rows, and x = floor(64 c) + 1000000 as 64-bit integers."""
    sizes = batch.column("size").to_numpy()
    flat, ends = batch.column("embedding").flatten().to_numpy(), np.cumsum(sizes)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        c = flat[(ends[rows] - size)[:, None] + np.arange(size)]
        with np.errstate(over="ignore"):
            yield int(size), rows, np.floor(np.clip(SCALE * c, -LIMIT, LIMIT)).astype(np.int64) + SHIFT


def totals(vectors: DataFrame, measure: Callable[[int, np.ndarray], list[np.ndarray]]) -> dict[int, list[list[int | float]]]:
    """For every length the sums over all vectors of `measure(length, x)`, a list of rows of numbers. A task sends one list for each row and adds up what
    it holds before; integers stay integers. Rows meet by `(length, row)` in the order of the tasks, so sums do not depend on who comes first."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in small(batches):
            for size, _, x in integers(batch):
                new = measure(size, x)
                held[size] = [a + b for a, b in zip(held[size], new, strict=True)] if size in held else new
        task = TaskContext.get().partitionId()
        for size, rows in held.items():
            for i, r in enumerate(rows):
                whole = r.dtype.kind == "i"
                yield pa.RecordBatch.from_pydict({"size": pa.array([size]), "i": pa.array([i]), "task": pa.array([task], pa.int64()), "whole": pa.array([whole]), "x": pa.array([r.tobytes()], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        for batch in batches:
            for size, i, whole, x in zip(*(batch.column(c).to_pylist() for c in ("size", "i", "whole", "x")), strict=True):
                x = np.frombuffer(x, np.int64 if whole else np.float64)
                if (size, i, whole) == now:
                    held = held + x
                    continue
                if now:
                    yield summed(*now, held)
                now, held = (size, i, whole), x
        if now:
            yield summed(*now, held)

    def summed(size: int, i: int, whole: bool, x: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"size": pa.array([size]), "i": pa.array([i]), "whole": pa.array([whole]), "x": pa.array([x.tobytes()], pa.binary())})

    lists = vectors.mapInArrow(part, "size long, i long, task long, whole boolean, x binary").repartition(partitions(vectors.sparkSession), "size", "i").sortWithinPartitions("size", "i", "task")
    out: dict[int, list] = {}
    for r in lists.mapInArrow(add, "size long, i long, whole boolean, x binary").orderBy("size", "i").toLocalIterator():  # d rows of d numbers for a length d
        out.setdefault(r["size"], []).append(np.frombuffer(r["x"], np.int64 if r["whole"] else np.float64))
    return out


class Fit:
    """The exact sums, the eigenpairs and the shares of the trace for vectors of one length."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.middle = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([(s % n) / n for s in sums])  # S / n = middle + rest
        self.values, self.axes, self.explained, self.identity_error = np.zeros(0), np.zeros((0, len(sums))), np.zeros(0), 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.middle) - self.rest

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return (self.centred(x) @ self.axes.T) / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums over the dimensions of (n x - S)^2; null where one does not fit a long."""
        offset = np.array([s - self.n * int(m) for s, m in zip(self.sums, self.middle.tolist(), strict=True)], np.int64)  # n x - S = n (x - middle) - offset
        y = x - self.middle
        if float(self.n) * (float(np.abs(y).max(initial=0)) + 1) < 2.0**31 / math.sqrt(max(len(self.sums), 1)):
            return ((self.n * y - offset) ** 2).sum(axis=1).tolist()
        exact = [sum((self.n * a - b) ** 2 for a, b in zip(row, offset.tolist(), strict=True)) for row in y.tolist()]
        return [e if e < 1 << 63 else None for e in exact]


def fit(vectors: DataFrame, most: int) -> dict[int, Fit]:
    """For every length of vectors its `Fit`, from three passes over them."""
    high = 26  # sums of the high and the low bits apart, so that neither overflows
    sums = totals(vectors, lambda size, x: [np.array([len(x)]), (x >> high).sum(axis=0), (x & ((1 << high) - 1)).sum(axis=0)])
    fits = {size: Fit(int(s[0][0]), [(int(a) << high) + int(b) for a, b in zip(s[1], s[2], strict=True)]) for size, s in sums.items()}

    def products(size: int, x: np.ndarray) -> list[np.ndarray]:
        y = fits[size].centred(x)
        return [*(y.T @ y)]

    for size, rows in totals(vectors, products).items():
        f = fits[size]
        v = np.stack(rows) / f.n
        v = (v + v.T) / 2
        trace = float(np.trace(v))
        if trace > 0:
            values, axes = Spectrum(v).leading(min(most, size))
            some = values > 1e-12 * trace  # axes without variance cannot be scaled to one
            f.values, f.axes, f.explained = values[some], axes[some], values[some] / trace

    def whitened(size: int, x: np.ndarray) -> list[np.ndarray]:
        w = fits[size].whiten(x)
        return [w.sum(axis=0), *(w.T @ w)]

    for size, (first, *rows) in totals(vectors, whitened).items():
        f = fits[size]
        if len(f.values):
            mean = first / f.n
            f.identity_error = float(np.abs(np.stack(rows) / f.n - np.outer(mean, mean) - np.eye(len(mean))).max())
    return fits


def whiten(vectors: DataFrame, most: int = 32) -> DataFrame:
    """`(vec_id, component, n, deviation, whitened, explained, identity_error)`: a row for every vector and each of the first `most` components.

    Rows whose vector is null, empty, or holds null or non-finite entries are dropped. An entry c becomes x = floor(64 c) + 1000000. n: the vectors; deviation: the
    exact sum over the dimensions of (n x - S)^2, S the sums of x (null if it does not fit a long); whitened: x - S/n on the unit
    eigenvector of the covariance, over the root of its eigenvalue; explained: the eigenvalue's share of the trace; identity_error: the largest
    entry of the whitened vectors' covariance (measured in a pass of its own) less the identity.

    Components without variance are left out: vectors in a plane have two, a single vector or equal ones none, and no rows. Equal eigenvalues
    have some orthogonal axes of their plane. Vectors of different lengths are lists of their own. Repeated rows and ids each count and each give rows; a null
    vec_id is kept; other columns are dropped; no rows give no rows. Entries beyond 2**52 / 64 are taken as that.
    """
    rows = good_vectors(vectors)
    shared = vectors.sparkSession.sparkContext.broadcast(fit(rows, most))  # at most d axes of d numbers for a length d

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 512):
            ids = batch.column("vec_id")
            for size, at, x in integers(batch):
                f = shared.value[size]
                k, m = len(f.values), len(at)
                if k:
                    each = np.repeat(np.arange(m), k)
                    yield pa.RecordBatch.from_arrays([
                        ids.take(pa.array(at)).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, f.n, np.int64)), pa.array(f.deviations(x), pa.int64()).take(pa.array(each)),
                        pa.array(f.whiten(x).ravel()), pa.array(np.tile(f.explained, m)), pa.array(np.full(m * k, f.identity_error)),
                    ], [c.split()[0] for c in OUTPUT.split(", ")])

    return rows.mapInArrow(run, OUTPUT)
