"""Whitening of embeddings by spectral divide and conquer.

Entries become whole numbers, so all sums over the corpus are exact: Spark adds up, per
task and then over tasks, the distinct vectors' sums and, about the rounded mean, their
products. What comes to the driver is one matrix, of the size of the dimension squared,
however many vectors there are. There the polar factor of the covariance minus a shift
(dynamically weighted Halley steps) is the sign of each eigenvalue about the shift, hence
a projector on one invariant subspace and its complement; both are split in the same way
until nothing is left to split. The components go to the tasks that project the rows.

Rows whose vector is null, is shorter than the longest one of the table, or holds an entry
that is null, not finite or beyond 2**53 / 256 are dropped; extra columns are ignored.
Repeated rows are all answered; each distinct vector is fitted once. An empty table gives
an empty result. A component without variance has null for `whitened`, and where all have none
`explained` and `identity_error` are null too. Equal eigenvalues leave the choice of
components within their subspace open; it is the same for all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from cellshift.llm.shared import materialise

SCALE = 256
_LARGEST = float(1 << 53)  # whole numbers up to here are exact as doubles
_ROWS = 512  # at once: so many sums of numbers up to 2**53 fit in 63 bits
_EXACT = pa.decimal128(38, 0)


def whole_numbers(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, x): the rows that can be used, x = floor(256 * entry) as an array of long."""
    rows = vectors.select(F.col(id_column).alias("id"), F.col(vector_column).cast("array<double>").alias("v"))

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            batch = batch.filter(lists.is_valid())
            lists = batch.column("v")
            entries = lists.flatten()
            c = np.floor(entries.to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
            with np.errstate(invalid="ignore"):
                bad = ~(np.abs(c) < _LARGEST)  # null entries come as NaN
            sizes = np.asarray(lists.value_lengths(), np.int64)
            ends = np.cumsum(sizes)
            wrong = np.concatenate([[0], np.cumsum(bad)])
            good = wrong[ends] == wrong[ends - sizes]
            x = pa.array(np.where(bad, 0, c).astype(np.int64))
            offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
            out = pa.record_batch({"id": batch.column("id"), "x": pa.ListArray.from_arrays(offsets, x)})
            yield out.filter(pa.array(good))

    schema = StructType([rows.schema["id"]])
    found = rows.mapInArrow(scale, schema.add("x", ArrayType(LongType())))
    longest = found.agg(F.max(F.size("x"))).first()[0]
    return found.where((F.size("x") == (longest or 0)) & (F.size("x") > 0))


def _matrices(batches: Iterator[pa.RecordBatch], column: str = "x") -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Pieces of the batches with their vectors as the rows of a matrix of long."""
    for batch in batches:
        for first in range(0, batch.num_rows, _ROWS):
            part = batch.slice(first, _ROWS)
            yield part, part.column(column).flatten().to_numpy().reshape(part.num_rows, -1)


def _exactly(numbers) -> pa.Array:
    return pa.array([Decimal(int(a)) for a in numbers], _EXACT)


def _sums(fit_list: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and the sum of each dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for _, x in _matrices(batches):
            n += len(x)
            part = x.sum(axis=0).astype(object)
            total = part if total is None else total + part
        if n:
            yield pa.record_batch({"i": pa.array(np.arange(len(total))), "n": pa.array([n] * len(total)), "s": _exactly(total)})

    parts = fit_list.mapInArrow(add, "i long, n long, s decimal(38,0)")
    rows = parts.groupBy("i").agg(F.sum("n"), F.sum("s").cast("decimal(38,0)")).orderBy("i").collect()
    return (rows[0][1] if rows else 0), [int(r[2]) for r in rows]


def _covariance(fit_list: DataFrame, n: int, s: list[int]) -> np.ndarray:
    """The covariance, each entry rounded once.

    Vectors are centred on the whole number next to their mean before they are multiplied, so
    the sums stay small and exact; what the rounding of the centre left is taken off in
    whole numbers as well.
    """
    centre = np.array([(2 * a + n) // (2 * n) for a in s], np.int64)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(centre)
        total, products = np.zeros(d, object), np.zeros((d, d), object)
        for _, x in _matrices(batches):
            z = x - centre
            total = total + z.sum(axis=0).astype(object)
            if float(np.abs(z).max()) ** 2 * len(z) < _LARGEST:  # exact in doubles
                f = z.astype(np.float64)
                products = products + (f.T @ f).astype(np.int64).astype(object)
            else:
                products = products + z.astype(object).T @ z.astype(object)
        for i in range(d):  # the upper half
            row = pa.ListArray.from_arrays(pa.array([0, d - i], pa.int32()), _exactly(products[i, i:]))
            yield pa.record_batch({"i": pa.array([i], pa.int64()), "z": _exactly(total[i : i + 1]), "zz": row})

    parts = fit_list.mapInArrow(multiply, "i long, z decimal(38,0), zz array<decimal(38,0)>")
    first = parts.groupBy("i").agg(F.sum("z").cast("decimal(38,0)")).collect()
    total = [0] * len(s)
    for i, z in first:
        total[i] = int(z)
    each = parts.select("i", F.posexplode("zz").alias("j", "zz"))
    v = np.zeros((len(s), len(s)))
    for i, j, zz in each.groupBy("i", "j").agg(F.sum("zz").cast("decimal(38,0)")).toLocalIterator():
        j += i
        v[i, j] = v[j, i] = (n * int(zz) - total[i] * total[j]) / (n * n)
    return v


def polar_factor(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix, by QDWH.

    The weights follow a lower bound of the least singular value, so that six or seven
    steps are enough for any matrix that is not singular in double precision.
    """
    eye = np.eye(len(a))
    x = a / np.linalg.norm(a)
    least = max(1 / np.linalg.norm(np.linalg.inv(x)), 1e-17)
    for _ in range(30):
        d = np.cbrt(4 * (1 - least**2) / least**4)
        root = np.sqrt(1 + d)
        wa = root + np.sqrt(8 - 4 * d + 8 * (2 - least**2) / (least**2 * root)) / 2
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        if wc > 100:
            q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, eye]))
            new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * q[: len(a)] @ q[len(a) :].T
        else:
            half = np.linalg.cholesky(eye + wc * x.T @ x)
            back = np.linalg.solve(half.T, np.linalg.solve(half, x.T)).T
            new = wb / wc * x + (wa - wb / wc) * back
        new = (new + new.T) / 2
        step = np.linalg.norm(new - x)
        x, least = new, min(1.0, least * (wa + wb * least**2) / (1 + wc * least**2))
        if step < 1e-14 * len(a) or (1 - least < 1e-15 and step < 1e-8):
            break
    return x


def _split(a: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the invariant subspaces above and below some shift.

    None if no shift tells eigenvalues apart. The mean of the diagonal lies strictly
    between the outer eigenvalues; the others halve the work.
    """
    d, diagonal = len(a), np.sort(np.diag(a))
    eye, rng = np.eye(d), np.random.default_rng(0)
    for shift in (np.median(diagonal), diagonal.mean(), *(diagonal[1:] + diagonal[:-1]) / 2):
        try:
            projector = (polar_factor(a - shift * eye) + eye) / 2
        except np.linalg.LinAlgError:
            continue  # the shift is an eigenvalue
        k = round(np.trace(projector))
        if not 0 < k < d or np.linalg.norm(projector @ projector - projector) > 1e-10 * d:
            continue
        start = np.linalg.qr(rng.standard_normal((d, d)))[0]
        upper, lower = start[:, :k], start[:, k:]
        for _ in range(2):  # the second step removes what a poor start left
            upper = np.linalg.qr(projector @ upper)[0]
            lower = np.linalg.qr(lower - projector @ lower)[0]
        whole = np.linalg.qr(np.hstack([upper, lower]))[0]
        return whole[:, :k], whole[:, k:]
    return None


def spectrum(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix."""
    scale = np.linalg.norm(a)
    found: list[np.ndarray] = []
    open_bases = [np.eye(len(a))]
    while open_bases:
        basis = open_bases.pop()
        inner = basis.T @ a @ basis
        inner = (inner + inner.T) / 2
        d = len(inner)
        # One eigenvalue in double precision: any basis will do.
        alike = d == 1 or np.linalg.norm(inner - np.eye(d) * np.trace(inner) / d) <= 4e-16 * d * scale
        halves = None if alike else _split(inner)
        if halves is None:
            found.append(basis)
        else:
            open_bases += [basis @ half for half in halves]
    vectors = np.hstack(found)
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")
    vectors = vectors[:, order]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(a))])
    return values[order], vectors * signs


@dataclass(frozen=True)
class Whitening:
    """What `fit` learns: n vectors with sums s, eigenvalues and components (columns)."""

    n: int
    s: list[int]
    values: np.ndarray
    components: np.ndarray
    total: float
    identity_error: float | None = None

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - s, exact."""
        largest = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.s))
        if 4 * largest < 1 << 63:
            return self.n * x - np.array(self.s, np.int64)
        return self.n * x.astype(object) - np.array(self.s, object)

    def squares(self, y: np.ndarray) -> list[int | None]:
        """Sums of squares of the rows; null if it is no long."""
        if y.dtype != object and int(np.abs(y).max(initial=0)) ** 2 * y.shape[1] < 1 << 63:
            return (y * y).sum(axis=1).tolist()
        exact = (y.astype(object) ** 2).sum(axis=1)
        return [int(a) if a < 1 << 63 else None for a in exact]

    def project(self, y: np.ndarray) -> np.ndarray:
        """Whitened rows: a column for each component, NaN where it has no variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            scales = np.where(self.values > 0, 1 / np.sqrt(self.values), np.nan)
        return (y.astype(np.float64) / self.n) @ self.components * scales


def fit(x: DataFrame, components: int) -> Whitening | None:
    """From the distinct vectors of `x`, with `identity_error` measured on them; None without."""
    fit_list = materialise(x.select("x").distinct())
    n, s = _sums(fit_list)
    if not n:
        return None
    v = _covariance(fit_list, n, s)
    values, vectors = spectrum(v)
    total = float(np.trace(v))
    # What rounding leaves of a zero is no variance.
    values = np.where(values > len(v) * 1e-15 * total, values, 0.0)
    model = Whitening(n, s, values[:components], vectors[:, :components], total)
    k = int((model.values > 0).sum())
    if not k:
        return model

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, products = np.zeros(k), np.zeros((k, k))
        for _, part in _matrices(batches):
            w = model.project(model.deviations(part))[:, :k]
            sums += w.sum(axis=0)
            products += w.T @ w
        i, j = np.indices((k + 1, k)).reshape(2, -1)
        yield pa.record_batch({"i": pa.array(i), "j": pa.array(j), "a": pa.array(np.vstack([products, sums]).ravel())})

    parts = fit_list.mapInArrow(measure, "i long, j long, a double").groupBy("i", "j").agg(F.sum("a")).collect()
    a = np.zeros((k + 1, k))
    for i, j, value in parts:
        a[i, j] = value / n
    error = np.abs(a[:k] - np.outer(a[k], a[k]) - np.eye(k)).max()
    return Whitening(n, s, model.values, model.components, total, float(error))


def whiten(vectors: DataFrame, components: int = 4, id_column="vec_id", vector_column="embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) per usable row and component.

    deviation is the sum of squares of n * x - s, and null where it exceeds a long.
    """
    rows = whole_numbers(vectors, id_column, vector_column)
    own = rows.schema["id"]
    rest = [("component", IntegerType()), ("n", LongType()), ("deviation", LongType()), ("whitened", DoubleType()),
            ("explained", DoubleType()), ("identity_error", DoubleType())]
    schema = StructType([own, *[StructField(name, kind) for name, kind in rest]])
    model = fit(rows, components)
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    k = len(model.values)
    explained = [float(e / model.total) if model.total > 0 else None for e in model.values]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _matrices(batches):
            y = model.deviations(x)
            w = model.project(y)
            each = pa.array(np.repeat(np.arange(len(x)), k))
            yield pa.record_batch(
                [
                    part.column("id").take(each),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array([model.n] * len(each), pa.int64()),
                    pa.array(model.squares(y), pa.int64()).take(each),
                    pa.array(w.ravel(), mask=np.isnan(w.ravel())),
                    pa.array(explained * len(x), pa.float64()),
                    pa.array([model.identity_error] * len(each), pa.float64()),
                ],
                names=schema.names,
            )

    return rows.mapInArrow(project, schema)
