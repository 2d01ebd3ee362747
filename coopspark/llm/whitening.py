"""Whitening of vectors: exact scatter, pivoted Cholesky, one-sided Jacobi on the factor.

Each entry c becomes the integer ``x = floor(scale * c) + offset``. Spark sums
the x by dimension, then the products of x less the rounded mean: small whole
numbers, so the sums are exact, and with them ``n**2`` times the covariance is a
matrix of whole numbers. Only these ``d * (d + 1) / 2`` sums reach the driver
(a number that depends on the vectors' length and not on the rows). There

1. a Cholesky factor with pivoting, ``P' V P = L L'``, is taken in extended
   precision; it ends where no variance is left, so its columns are V's rank;
2. one-sided Jacobi rotations make the columns of L orthogonal, with disjoint
   pairs of columns in each step: squared column norms are then the eigenvalues
   of V, and normalised columns its eigenvectors (``L J = U D`` gives ``V = U D D U'``).

Working on the factor keeps small eigenvalues accurate. Rows are whitened where
they are scanned; no vector is shuffled or collected. The covariance of the
whitened values is measured over all rows in another scan.

Defined cases: vectors that are null, empty, or hold a null or non-finite entry,
or one whose x is beyond 62 bits, take no part. A covariance needs vectors of one
length: it is the one that most rows have (the longer one, if two have as many),
and rows of other lengths take no part. Rows with a null id and repeated rows are
rows like any other. Directions without variance (constant or dependent
dimensions, a single row) are no components, so there can be fewer than asked
for, or none, which gives no rows. Of a component's two signs, the one with a
positive largest entry is taken. Empty tables give an empty result; extra columns
are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coopspark.llm.common import columns_of, slices
from coopspark.llm.topk import finite

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
ROWS = 2048
_EXACT = 2**53


@dataclass
class Whitening:
    """A fit: exact sums of n vectors, and the leading eigenvectors (columns) of their covariance."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    scale: int
    offset: int

    @property
    def explained(self) -> np.ndarray:
        return self.eigenvalues / self.trace if len(self.eigenvalues) else self.eigenvalues

    @property
    def middle(self) -> np.ndarray:
        """The rounded mean of each dimension, which rows are centred by first."""
        return np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], np.int64)


def usable(vectors: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector as doubles) of the rows that take part, whatever their length."""
    own = columns_of(vectors, id_col, vector_col).select(F.col(id_col).alias("vec_id"), F.transform(F.col(vector_col), lambda x: x.cast("double")).alias("c"))
    fits: Column = F.forall("c", lambda x: F.abs(x) * scale < F.lit(2.0**62))
    return own.where(finite(F.col("c")) & F.coalesce(fits, F.lit(False)))


def _whole(vectors: pa.Array, d: int, scale: int, offset: int) -> np.ndarray:
    """Rows of d entries as x."""
    c = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    return np.floor(scale * c).astype(np.int64) + offset


def _sums(scale: int, offset: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(dim, at, n, s): each length's rows and exact sums by dimension, once for a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[int, int] = {}
        total: dict[int, np.ndarray] = {}
        for batch in slices(batches, ROWS):
            lengths = batch.column(0).value_lengths().to_numpy()
            for d in np.unique(lengths).tolist():
                x = _whole(batch.column(0).take(pa.array(np.flatnonzero(lengths == d))), d, scale, offset)
                safe = int(np.abs(x).max()) * len(x) < 2**63
                s = x.sum(axis=0).astype(object) if safe else x.astype(object).sum(axis=0)
                n[d] = n.get(d, 0) + len(x)
                total[d] = s if d not in total else total[d] + s
        for d, s in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([n[d]] * d, pa.int64()), pa.array([Decimal(int(v)) for v in s], pa.decimal128(38, 0))], names=["dim", "at", "n", "s"])

    return run


def _products(middle: np.ndarray, scale: int, offset: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(i, j, p): exact sums of products of x - middle, upper triangle, once for a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(middle)
        i, j = np.triu_indices(d)
        total = np.zeros(len(i), object)
        seen = False
        for batch in slices(batches, ROWS):
            y = _whole(batch.column(0), d, scale, offset) - middle
            if not len(y):
                continue
            seen = True
            top = int(np.abs(y).max())
            f = y.astype(np.float64) if top * top * len(y) < _EXACT else y.astype(object)
            p = (f.T @ f)[i, j]
            total += p.astype(np.int64) if p.dtype != object else p
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([Decimal(int(v)) for v in total], pa.decimal128(38, 0))], names=["i", "j", "p"])

    return run


def pivoted_cholesky(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(L, order) with ``v[order][:, order] = L L'``; L has as many columns as v has rank."""
    d = len(v)
    rest, order = v.copy(), np.arange(d)
    lower = np.zeros_like(v)
    floor = d * np.finfo(v.dtype).eps * max(v.diagonal().max(initial=0), 0)
    for k in range(d):
        best = k + int(rest.diagonal()[k:].argmax())
        if rest[best, best] <= floor:
            return lower[:, :k], order
        for m in (rest, lower):
            m[[k, best]] = m[[best, k]]
        rest[:, [k, best]] = rest[:, [best, k]]
        order[[k, best]] = order[[best, k]]
        lower[k, k] = np.sqrt(rest[k, k])
        lower[k + 1 :, k] = rest[k + 1 :, k] / lower[k, k]
        rest[k + 1 :, k + 1 :] -= np.outer(lower[k + 1 :, k], lower[k + 1 :, k])
    return lower, order


def one_sided_jacobi(g: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """The columns of g rotated among themselves until all are orthogonal, longest first."""
    columns = np.ascontiguousarray(g.T)
    r = len(columns)
    eps = np.finfo(g.dtype).eps
    players = list(range(r + r % 2))  # an odd number gets a column that isn't there
    for _ in range(sweeps):
        turned = False
        for _ in range(len(players) - 1):
            half = len(players) // 2
            p, q = np.array(players[:half], int), np.array(players[half:][::-1], int)
            there = (p < r) & (q < r)
            p, q = p[there], q[there]
            a, b = (columns[p] ** 2).sum(axis=1), (columns[q] ** 2).sum(axis=1)
            c = (columns[p] * columns[q]).sum(axis=1)
            turn = np.abs(c) > 4 * eps * np.sqrt(a * b)
            if turn.any():
                turned = True
                p, q, c = p[turn], q[turn], c[turn]
                zeta = (b[turn] - a[turn]) / (2 * c)
                t = np.where(zeta >= 0, 1, -1) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta))
                cos = 1 / np.sqrt(1 + t * t)
                sin = (cos * t)[:, None]
                cos = cos[:, None]
                columns[p], columns[q] = cos * columns[p] - sin * columns[q], sin * columns[p] + cos * columns[q]
            players = [players[0], players[-1], *players[1:-1]]
        if not turned:
            break
    norms = (columns**2).sum(axis=1)
    return columns[np.argsort(-norms, kind="stable")].T


def principal(scatter: np.ndarray, n: int, components: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(components, eigenvalues, trace) of the covariance ``scatter / n**2``, a matrix of Python integers."""
    v = scatter.astype(np.longdouble) / np.longdouble(n) / np.longdouble(n)
    lower, order = pivoted_cholesky(v)
    turned = one_sided_jacobi(lower)[:, :components]
    values = (turned**2).sum(axis=0)
    unit = np.empty_like(turned)
    unit[order] = turned / np.sqrt(values)
    if unit.shape[1]:
        unit *= np.sign(unit[np.abs(unit).argmax(axis=0), np.arange(unit.shape[1])])
    return unit.astype(np.float64), values.astype(np.float64), float(v.diagonal().sum())


def fit(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET, id_col: str = "vec_id", vector_col: str = "embedding") -> Whitening | None:
    """The fit of all vectors that take part; None if there are none."""
    own = usable(vectors, scale, id_col, vector_col).select("c")
    sums = own.mapInArrow(_sums(scale, offset), "dim int, at int, n bigint, s decimal(38,0)").groupBy("dim", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    most = F.max(F.struct("n", "dim")).alias("most")
    known = sums.crossJoin(F.broadcast(sums.where("at = 0").agg(most))).where("dim = most.dim").select("at", "n", "s").collect()  # one row a dimension
    if not known:
        return None
    n, s = known[0].n, [int(r.s) for r in sorted(known, key=lambda r: r.at)]
    d = len(s)
    found = Whitening(n, s, np.zeros((d, 0)), np.zeros(0), 0.0, scale, offset)
    middle = found.middle
    products = own.where(F.size("c") == d).mapInArrow(_products(middle, scale, offset), "i int, j int, p decimal(38,0)").groupBy("i", "j").agg(F.sum("p").alias("p")).collect()  # d * (d + 1) / 2 rows
    off = [a - n * int(m) for a, m in zip(s, middle, strict=True)]  # sums of x - middle
    scatter = np.zeros((d, d), object)
    for r in products:
        scatter[r.i, r.j] = scatter[r.j, r.i] = n * int(r.p) - off[r.i] * off[r.j]
    found.components, found.eigenvalues, found.trace = principal(scatter, n, components)
    return found


def _apply(model: Whitening) -> Callable[[np.ndarray], np.ndarray]:
    middle = model.middle
    rest = np.array([float(Decimal(s - model.n * int(m)) / Decimal(model.n)) for s, m in zip(model.sums, middle, strict=True)])
    onto = model.components / np.sqrt(model.eigenvalues)
    return lambda x: ((x - middle).astype(np.float64) - rest) @ onto


def identity_error(vectors: DataFrame, model: Whitening, id_col: str = "vec_id", vector_col: str = "embedding") -> float:
    """Largest absolute entry of the covariance of the whitened values of all rows, less the identity."""
    d, k = model.components.shape
    if not k:
        return 0.0

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whiten = _apply(model)
        total, products = np.zeros(k), np.zeros((k, k))
        for batch in slices(batches, ROWS):
            w = whiten(_whole(batch.column(0), d, model.scale, model.offset))
            total += w.sum(axis=0)
            products += w.T @ w
        flat = np.concatenate([total, products.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(flat)), pa.int32()), pa.array(flat)], names=["at", "v"])

    own = usable(vectors, model.scale, id_col, vector_col).where(F.size("c") == d).select("c")
    got = own.mapInArrow(moments, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()  # k * (k + 1) rows
    flat = np.array([r.v for r in sorted(got, key=lambda r: r.at)]) / model.n
    mean = flat[:k]
    return float(np.abs(flat[k:].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


def transform(vectors: DataFrame, model: Whitening, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, deviation decimal, component, whitened): a row for each vector and component.

    ``deviation`` is the exact squared distance of n * x from the sums.
    """
    d, k = model.components.shape
    kind = usable(vectors, model.scale, id_col, vector_col).schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whiten = _apply(model)
        sums = np.array(model.sums, object)
        number = np.arange(1, k + 1, dtype=np.int32)
        for batch in slices(batches, max(1, ROWS * 32 // max(k, 1))):
            x = _whole(batch.column(1), d, model.scale, model.offset)
            reach = model.n * int(np.abs(x).max(initial=0)) + max(map(abs, model.sums), default=0)
            narrow = reach < 2**62
            gap = (model.n * x - sums.astype(np.int64)) if narrow else model.n * x.astype(object) - sums
            widest = int(np.abs(gap).max(initial=0))
            exact = widest * widest * d < 2**63
            deviation = (gap**2).sum(axis=1) if exact else (gap.astype(object) ** 2).sum(axis=1)
            each = pa.array([Decimal(int(v)) for v in deviation], pa.decimal128(38, 0))
            rows = pa.array(np.repeat(np.arange(len(x)), k))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), each.take(rows), pa.array(np.tile(number, len(x))), pa.array(whiten(x).ravel())], names=["vec_id", "deviation", "component", "whitened"])

    own = usable(vectors, model.scale, id_col, vector_col).where(F.size("c") == d)
    return own.mapInArrow(run, f"vec_id {kind}, deviation decimal(38,0), component int, whitened double")


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for every row and component."""
    model = fit(vectors, components, scale, offset, id_col, vector_col)
    if model is None:
        kind = vectors.schema[id_col].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double")
    shares = F.array(*[F.lit(float(e)) for e in model.explained]) if len(model.explained) else F.array(F.lit(None).cast("double"))
    error = identity_error(vectors, model, id_col, vector_col)
    out = transform(vectors, model, id_col, vector_col)
    return out.select("vec_id", "component", F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened", F.get(shares, F.col("component") - 1).alias("explained"), F.lit(error).alias("identity_error"))
