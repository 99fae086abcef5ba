"""Whitening of embeddings by a one-sided Jacobi singular value decomposition.

Entries become whole numbers, so sums over all vectors are exact and each row is
centred with one rounding.  Each task compresses its centred rows, a block at a
time, to one triangular factor R (TSQR); factors are merged in a tree.  Plane
rotations make the last R's columns orthogonal; the accumulated rotations are the
components and the columns' lengths the singular values, small ones as accurate
as large ones.

Defined results: vectors that are null, or hold null or non-finite entries, are
dropped, and so are vectors whose length is not the most frequent one (of
equally frequent ones the longest); there is a row for each vector that stays
(repeated rows, null ids included) and each component that has any variance, so
one vector, equal vectors or an empty table give an empty result; entries beyond
+-2**55 after scaling count as that; deviations are decimals of 38 digits, null
beyond; other columns are ignored, whatever their names.  A task holds a batch
and FAN_IN d x d factors, the driver as many, whatever the number of vectors.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrapanel.llm.storage import Tables

#: An entry c becomes floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
MOST_COMPONENTS = 32
#: Rows that join a factor at a time, and factors that are merged in one task.
BLOCK_ROWS, FAN_IN = 2048, 16
LARGEST = float(1 << 55)


def usable(vector: Column) -> Column:
    """Not null, and without null or non-finite entries."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(vector, finite), F.lit(False))


def whole_numbers(vectors: pa.Array, dimension: int) -> np.ndarray:
    """The vectors of a batch as rows of 64-bit integers."""
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(values * SCALE), -LARGEST, LARGEST).astype(np.int64) + OFFSET


def _wide(x: np.ndarray, factor: int) -> bool:
    """Whether sums of ``factor`` such numbers may leave 64 bits."""
    return bool(x.size) and int(np.abs(x).max()) * factor >= 1 << 62


def exact_sums(x: np.ndarray) -> np.ndarray:
    return x.astype(object).sum(axis=0) if _wide(x, len(x)) else x.sum(axis=0)


def scaled_deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S, exactly: 64-bit integers, or Python's where they may not do."""
    if not _wide(x, 2 * n):
        return x * np.int64(n) - sums.astype(np.int64)
    return x.astype(object) * n - sums


def squared_lengths(d: np.ndarray) -> list[int]:
    """Sums of squares by row, exactly."""
    most = int(np.abs(d).max()) if d.size else 0
    return ((d if most * most * d.shape[1] < 1 << 62 else d.astype(object)) ** 2).sum(axis=1).tolist()


def jacobi(r: np.ndarray, tolerance: float = 1e-15, most_sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Singular values, falling, and right singular vectors as columns, by rotations of pairs of columns.

    A sweep meets every pair once, in rounds of pairs that have no column in
    common and are rotated together.
    """
    d = r.shape[1]
    even = d + d % 2
    a, v = np.zeros((r.shape[0], even)), np.eye(even)
    a[:, :d] = r
    ring = np.arange(even)
    for _ in range(most_sweeps):
        worst = 0.0
        for _ in range(even - 1):
            p, q = ring[: even // 2], ring[: even // 2 - 1 : -1]
            x, y = a[:, p], a[:, q]
            alpha, beta, gamma = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            scale = np.sqrt(alpha) * np.sqrt(beta)
            cosine = np.divide(np.abs(gamma), scale, out=np.zeros_like(gamma), where=scale > 0)
            turn = cosine > tolerance
            worst = max(worst, cosine.max(initial=0.0))
            zeta = np.divide(beta - alpha, 2 * gamma, out=np.zeros_like(gamma), where=turn)
            t = np.where(turn, np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1, zeta)), 0.0)
            c = 1 / np.hypot(1, t)
            s = c * t
            a[:, p], a[:, q] = c * x - s * y, s * x + c * y
            x, y = v[:, p].copy(), v[:, q].copy()
            v[:, p], v[:, q] = c * x - s * y, s * x + c * y
            ring = np.concatenate([ring[:1], np.roll(ring[1:], 1)])
        if worst <= 4 * tolerance:
            break
    length = np.sqrt((a * a).sum(axis=0))[:d]
    order = np.argsort(-length, kind="stable")
    return length[order], v[:d, :d][:, order]


@dataclass(frozen=True)
class Whitening:
    """n vectors with per-dimension sums; components as columns, their variances, and the variance of all."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    variances: np.ndarray
    total: float

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = scaled_deviations(x, self.n, self.sums)
        return d, d.astype(np.float64) / self.n

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        return centred @ self.components / np.sqrt(self.variances)


def _good(rows: DataFrame, *columns: str, vector: str) -> DataFrame:
    """The columns and, last, the usable vectors, of floats or doubles."""
    kind = rows.schema[vector].dataType.elementType
    own = F.col(f"`{vector}`") if isinstance(kind, T.FloatType | T.DoubleType) else F.col(f"`{vector}`").cast("array<double>")
    return rows.where(usable(F.col(f"`{vector}`"))).select(*[F.col(f"`{c}`").alias(f"c{n}") for n, c in enumerate(columns)], own.alias("vector"))


def _blocks(batches, dimension: int):
    for batch in batches:
        x = whole_numbers(batch.column(batch.num_columns - 1), dimension)
        for at in range(0, len(x), BLOCK_ROWS):
            yield x[at : at + BLOCK_ROWS]


def _row(place: int, *arrays: np.ndarray) -> dict[str, list]:
    return {"place": [place], "parts": [[np.ascontiguousarray(a, np.float64).tobytes() for a in arrays]]}


ROW = pa.schema([("place", pa.int64()), ("parts", pa.list_(pa.binary()))])
ROW_TYPE = "place long, parts array<binary>"


def reduced(rows: DataFrame, start, tables: Tables, merge) -> list[np.ndarray] | None:
    """What a tree of tasks makes of ``start(batches)``, a list of arrays or None from each task.

    Each level merges FAN_IN of the tasks' results in one task, and is written.
    """

    def first(batches):
        found = start(batches)
        if found is not None:
            yield pa.RecordBatch.from_pydict(_row(TaskContext.get().partitionId(), *found), schema=ROW)

    def combined(rows: list) -> list[np.ndarray] | None:
        out = None
        for parts in rows:
            own = [np.frombuffer(p) for p in parts]
            out = own if out is None else merge(out, own)
        return out

    def level(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        return pa.Table.from_pydict(_row(key[0].as_py(), *combined(table.column("parts").to_pylist())), schema=ROW)

    names = ["level-0"]
    found = tables.write(rows.mapInArrow(first, ROW_TYPE), names[0])
    n = found.count()
    while n > FAN_IN:
        n = -(-n // FAN_IN)
        ranked = found.withColumn("place", F.pmod("place", F.lit(n)))
        names.append(f"level-{len(names)}")
        found = tables.write(ranked.groupBy("place").applyInArrow(level, ROW_TYPE), names[-1])
        n = found.count()
    rest = sorted(found.collect(), key=lambda r: r.place)
    tables.remove(*names)
    return combined([r.parts for r in rest])


def _factor(of: np.ndarray | None, rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows if of is None else np.vstack([of, rows]), mode="r")


def fit_whitening(vectors: DataFrame, vector_col: str = "embedding", most: int = MOST_COMPONENTS) -> Whitening | None:
    """The model of all usable vectors; None if there are none, or none differ."""
    good = _good(vectors, vector=vector_col)
    found = good.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if found is None or not found.d:
        return None
    d, n = found["d"], found["count"]
    good, tables = good.where(F.size("vector") == d), Tables(vectors.sparkSession, "whitening")

    def sums(batches):
        total = np.zeros(d, object)
        for x in _blocks(batches, d):
            total = total + exact_sums(x)
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([str(x) for x in total], pa.string())], names=["dim", "part"])

    parts = good.mapInArrow(sums, "dim int, part string").groupBy("dim").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total"))
    s = np.array([int(r.total) for r in sorted(parts.collect())], object)

    def factors(batches):
        r = None
        for x in _blocks(batches, d):
            r = _factor(r, scaled_deviations(x, n, s).astype(np.float64) / n)
        return None if r is None else [r]

    (r,) = reduced(good, factors, tables, lambda a, b: [_factor(a[0].reshape(-1, d), b[0].reshape(-1, d)).ravel()])
    lengths, components = jacobi(r.reshape(-1, d))
    # Columns of a lower rank are left with rounding errors.
    rank = int((lengths > lengths[0] * 8 * d * np.finfo(float).eps).sum()) if lengths[0] > 0 else 0
    if not rank:
        return None
    kept = components[:, : min(rank, most)]
    kept = kept * np.where(kept[np.abs(kept).argmax(axis=0), np.arange(kept.shape[1])] < 0, -1.0, 1.0)
    return Whitening(n, s, kept, lengths[: kept.shape[1]] ** 2 / n, float((lengths**2).sum() / n))


def _moments(x: np.ndarray) -> list[np.ndarray]:
    mean = x.mean(axis=0)
    return [np.array([len(x)], float), mean, (x - mean).T @ (x - mean)]


def _both(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """Moments of two parts together: numbers, means, and sums of products of centred values."""
    n, step = a[0] + b[0], b[1] - a[1]
    return [n, a[1] + step * (b[0] / n), (a[2].ravel() + b[2].ravel()) + np.outer(step, step).ravel() * (a[0] * b[0] / n)]


def identity_error(vectors: DataFrame, model: Whitening, vector_col: str = "embedding") -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity, measured on all of them."""
    d, k = model.components.shape
    shared = vectors.sparkSession.sparkContext.broadcast(model)  # d x k numbers

    def moments(batches):
        out = None
        for x in _blocks(batches, d):
            own = _moments(shared.value.whitened(shared.value.centred(x)[1]))
            out = own if out is None else _both(out, own)
        return out

    good = _good(vectors, vector=vector_col).where(F.size("vector") == d)
    n, _, products = reduced(good, moments, Tables(vectors.sparkSession, "whitened"), _both)
    return float(np.abs(products.reshape(k, k) / n - np.eye(k)).max())


def whiten(vectors: DataFrame, model: Whitening | None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (id, component from 1, n, deviation, whitened, explained) for each usable vector and component.

    ``deviation``: the sum over dimensions of (n * x - S)^2, exactly.
    """
    d, k = model.components.shape if model else (0, 0)
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double"
    names = [id_col, "component", "n", "deviation", "whitened", "explained"]
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def rows(batches):
        known = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                m = part.num_rows
                off, centred = known.centred(whole_numbers(part.column(1), d))
                exact = [Decimal(x) if x < 10**38 else None for x in squared_lengths(off)]
                each = pa.array(np.repeat(np.arange(m), k))
                columns = [
                    part.column(0).take(each),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, known.n, np.int64)),
                    pa.array(exact, pa.decimal128(38, 0)).take(each),
                    pa.array(known.whitened(centred).ravel()),
                    pa.array(np.tile(known.variances / known.total, m)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    good = _good(vectors, id_col, vector=vector_col).where((F.size("vector") == d) & (F.lit(k) > 0))
    return good.mapInArrow(rows, schema)
