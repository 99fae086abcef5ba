"""Resamples of large tables: a row's draws for all replicates at once, and rank correlations of them by parts.

Every row draws its own counts from hashes of its key, as ``stats.resampled``
does, but no row is repeated: tasks hold a matrix of draws, rows by replicates,
and hand on sums.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapanel.functions.quantiles import ordered_counts, written

#: The largest number of draws that a hash of 32 bits can give; P(more) is below 2**-32.
MOST_DRAWS = 13
#: Rows whose draws are made together.
BLOCK = 4096


def draw_bounds() -> list[float]:
    """The Poisson distribution (mean 1): a uniform number above the k-th of them, from 0 on, means more than k draws."""
    total, term, out = float(np.exp(-1.0)), float(np.exp(-1.0)), []
    for k in range(1, MOST_DRAWS + 1):
        out.append(total)
        term /= k
        total += term
    return out


def key_text(keys: list[str]) -> Column:
    """What ``order_key`` hashes behind seed and replicate."""
    return F.concat_ws("", *[F.concat(F.lit("|"), F.col(k).cast("string")) for k in keys]).alias("__key")


def draws_of(keys: list[str], replicates: int, seed: int) -> np.ndarray:
    """Draws (rows, replicates) of the rows with these ``key_text``s; those of ``stats.resampled``."""
    starts, md5 = [f"{seed}|{r}".encode() for r in range(1, replicates + 1)], hashlib.md5
    raw = b"".join([md5(start + key).digest() for key in map(str.encode, keys) for start in starts])
    first = np.frombuffer(raw, ">u4").reshape(len(keys), replicates, 4)[:, :, 0]
    return np.searchsorted(draw_bounds(), (first + 0.5) / float(1 << 32)).astype(np.uint8)


def mean_sums(df: DataFrame, keys: list[str], value: str, replicates: int, seed: int) -> DataFrame:
    """Rows (replicate, total, known, draws): sums over a block's draws of the value, of rows that have one, and of all rows."""
    names = ["replicate", "total", "known", "draws"]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                own = part.column(1)
                there = np.asarray(own.is_valid())
                w = draws_of(part.column(0).to_pylist(), replicates, seed)
                v = own.fill_null(0.0).to_numpy(zero_copy_only=False)
                drawn = w.sum(axis=0, dtype=np.int64)
                known = w[there].sum(axis=0, dtype=np.int64)
                # One by one, as a value that isn't finite is taken only where it is drawn.
                total = v @ w if np.isfinite(v).all() else np.where(w > 0, v[:, None] * w, 0.0).sum(axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(1, replicates + 1, dtype=np.int32)), pa.array(total), pa.array(known), pa.array(drawn)], names=names)

    rows = df.select(key_text(keys), F.col(value).cast("double").alias("__v"))
    return rows.mapInArrow(run, "replicate int, total double, known long, draws long")


#: Rows of a part of x or y, at least, and parts of each, about.
PART_ROWS, MOST_PARTS = 4096, 64
#: Replicates whose sums are held together.
TOGETHER = 10


def _runs(*sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the first row of its run of equal keys, and the first one after it."""
    n = len(sorted_keys[0])
    new = np.ones(n, bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in sorted_keys])
    starts = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    return starts[run], np.r_[starts[1:], n][run]


class _Ranked:
    """Sums over the rows of one part, for any draws (rows, replicates) of theirs; what depends on the order only is found once."""

    def __init__(self, v: np.ndarray):
        self.order = np.argsort(v, kind="stable")
        self.first, self.after = _runs(v[self.order])
        self.starts = np.unique(self.first)

    def half_ranks(self, w: np.ndarray) -> np.ndarray:
        """Twice the average rank within the part, less one: rows before plus rows up to."""
        upto = _upto(w[self.order])
        out = np.empty_like(w)
        out[self.order] = upto[self.first] + upto[self.after]
        return out

    def ties(self, w: np.ndarray) -> np.ndarray:
        t = np.add.reduceat(w[self.order], self.starts, axis=0)
        return (t * (t - 1)).sum(axis=0) // 2


def _upto(w: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros((1, w.shape[1]), np.int64), np.cumsum(w, axis=0)])


class _Pairs:
    """Concordant less discordant pairs of a part's rows: for each bit of y's place, a sweep over x (see ``stats.pair_counts``)."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        y = np.unique(y, return_inverse=True)[1].ravel()
        self.steps = []
        for bit in range(int(y.max(initial=0)).bit_length()):
            above, one = y >> (bit + 1), (y >> bit) & 1 > 0
            order = np.lexsort((x, above))
            (first, after), (start, end) = _runs(above[order], x[order]), _runs(above[order])
            ones = np.flatnonzero(one[order])
            self.steps.append((order, ~one[order], ones, first[ones], after[ones], start[ones], end[ones]))

    def count(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(w.shape[1], np.int64)
        for order, zero, ones, first, after, start, end in self.steps:
            own = w[order]
            z = _upto(own * zero[:, None])
            out += (own[ones] * (z[first] - z[start] - z[end] + z[after])).sum(axis=0)
        return out


#: Kinds of rows that tasks hand on: sums of a cell of both parts; of a part of x, or of y; a row for its part of y.
_CELL, _X, _Y, _ROW = range(4)
_HANDED = "kind int, together int, a int, b int, place long, v1 binary, v2 binary, v3 binary, v4 binary"
_TYPES = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def _table(rows: list[tuple]) -> pa.Table:
    fields = [x.split() for x in _HANDED.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[]] * len(fields)
    return pa.table([pa.array(c, _TYPES[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], names=[name for name, _ in fields])


def _row(kind: int, together: int | None, a: int | None, b: int | None, place: int | None, *vectors) -> tuple:
    return kind, together, a, b, place, *[None if v is None else v.tobytes() for v in vectors], *[None] * (4 - len(vectors))


def _x_sums(replicates: int, seed: int):
    """Of a part of x: its own sums, sums of cells of single values of y, and rows for the other parts of y."""

    def run(table: pa.Table) -> pa.Table:
        b, x, y = (table.column(c).to_numpy() for c in ("b", "rx", "ry"))
        part, out = table.column("a")[0].as_py(), []
        draws = np.concatenate([draws_of(table.column("__key")[at : at + BLOCK].to_pylist(), replicates, seed) for at in range(0, len(b), BLOCK)])
        ranked, pairs = (None, None) if part % 2 else (_Ranked(x), _Pairs(x, y))
        cells = [(n, np.flatnonzero(b == n)) for n in np.unique(b[b % 2 == 1]).tolist()]
        on = np.flatnonzero(b % 2 == 0)
        ranks = None if part % 2 else np.zeros((len(on), replicates), np.int32)
        for at in range(0, replicates, TOGETHER):
            w = draws[:, at : at + TOGETHER].astype(np.int64)
            h = None
            if ranked is not None:
                h = ranked.half_ranks(w)
                out.append(_row(_X, at, part, None, None, pairs.count(w).astype(float), ranked.ties(w).astype(float), (w * h.astype(float) ** 2).sum(axis=0)))
                ranks[:, at : at + TOGETHER] = h[on]
            for n, own in cells:
                out.append(_row(_CELL, at, part, n, None, w[own].sum(axis=0).astype(float), None if h is None else (w[own] * h[own]).sum(axis=0).astype(float)))
        for k, n in enumerate(on.tolist()):
            out.append(_row(_ROW, None, part, int(b[n]), int(y[n]), draws[n], None if ranks is None else ranks[k]))
        return _table(out)

    return run


def _y_sums(replicates: int):
    """Of a part of y: its own sums, those of its cells, and pairs of different parts of x."""

    def run(table: pa.Table) -> pa.Table:
        a, y = (table.column(c).to_numpy() for c in ("a", "place"))
        part, out = table.column("b")[0].as_py(), []
        matrix = lambda c, kind: np.frombuffer(b"".join(table.column(c).to_pylist()), kind).reshape(len(a), replicates)
        draws = matrix("v1", np.uint8)
        empty = np.zeros(replicates, np.int32).tobytes()
        table = table.set_column(table.column_names.index("v2"), "v2", pa.chunked_array([table.column("v2").combine_chunks().fill_null(empty)]))
        ranks = matrix("v2", np.int32)
        ranked, pairs = _Ranked(y), _Pairs(a, y)
        order = np.argsort(a, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(a[order]) > 0])
        of_cells = lambda v: np.add.reduceat(v[order].astype(float), starts, axis=0)
        for at in range(0, replicates, TOGETHER):
            w, hx = (v[:, at : at + TOGETHER].astype(np.int64) for v in (draws, ranks))
            hy = ranked.half_ranks(w)
            out.append(_row(_Y, at, None, part, None, pairs.count(w).astype(float), ranked.ties(w).astype(float), (w * hy.astype(float) ** 2).sum(axis=0)))
            sums = [of_cells(v) for v in (w, w * hx, w * hy, (w * hx).astype(float) * hy)]
            out += [_row(_CELL, at, n, part, None, *[v[k] for v in sums]) for k, n in enumerate(a[order][starts].tolist())]
        return _table(out)

    return run


def _correlations(table: pa.Table) -> pa.Table:
    """rho and tau of replicates that are held together, from the sums of all cells and parts."""
    first = table.column("together")[0].as_py() + 1
    kind, a, b = (table.column(n).fill_null(-1).to_numpy() for n in ("kind", "a", "b"))
    size = len(table.column("v1")[0].as_py()) // 8
    vectors = {n: np.array([np.zeros(size) if v is None else np.frombuffer(v) for v in table.column(n).to_pylist()]) for n in ("v1", "v2", "v3", "v4")}
    cell = kind == _CELL
    (parts_a, at_a), (parts_b, at_b) = np.unique(a[cell], return_inverse=True), np.unique(b[cell], return_inverse=True)
    grids = []
    for n in vectors:
        grid = np.zeros((len(parts_a), len(parts_b), size))
        np.add.at(grid, (at_a, at_b), vectors[n][cell])
        grids.append(grid)
    w, hx, hy, hxy = grids
    n_a, n_b, total = w.sum(axis=1), w.sum(axis=0), w.sum(axis=(0, 1))
    # A part of one value: nothing before it, all of it up to it.
    one_a, one_b = parts_a % 2 == 1, parts_b % 2 == 1
    hx[one_a], hxy[one_a] = w[one_a] * n_a[one_a, None], hy[one_a] * n_a[one_a, None]
    hy[:, one_b], hxy[:, one_b] = w[:, one_b] * n_b[one_b], hx[:, one_b] * n_b[one_b]
    own = lambda k, n: vectors[n][kind == k].sum(axis=0)
    ties = [own(k, "v2") + (n[one] * (n[one] - 1) / 2).sum(axis=0) for k, n, one in ((_X, n_a, one_a), (_Y, n_b, one_b))]
    off_a, off_b = (2 * (np.cumsum(n, axis=0) - n) - total for n in (n_a, n_b))
    squares = [
        own(k, "v3") + (n[one] ** 3).sum(axis=0) + (n * off**2 + 2 * off * h).sum(axis=0)
        for k, n, one, off, h in ((_X, n_a, one_a, off_a, hx.sum(axis=1)), (_Y, n_b, one_b, off_b, hy.sum(axis=0)))
    ]
    products = (w * off_a[:, None] * off_b + off_a[:, None] * hy + off_b * hx + hxy).sum(axis=(0, 1))
    before = np.cumsum(w, axis=0) - w
    upto = np.cumsum(before, axis=1)
    signed = own(_X, "v1") + own(_Y, "v1") + (w * ((upto - before) - (upto[:, -1:] - upto))).sum(axis=(0, 1))
    pairs = total * (total - 1) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        rho = np.where(total >= 3, products / np.sqrt(squares[0] * squares[1]), np.nan)
        tau = signed / np.sqrt((pairs - ties[0]) * (pairs - ties[1]))
    found = [pa.array(v, mask=~np.isfinite(v)) for v in (rho, tau)]
    return pa.table([pa.array(np.arange(first, first + size, dtype=np.int32)), *found], names=["replicate", "rho", "tau"])


def rank_correlations(df: DataFrame, keys: list[str], x: str, y: str, replicates: int, seed: int = 0) -> DataFrame:
    """Rows (replicate, rho, tau) of resamples of the rows that have x and y.

    The order of x, and that of y, is the same in all resamples, so it is found
    once, and both are cut into parts of about equally many rows; a value of
    more rows is a part of its own, in which all tie.  A pair of rows lies in
    one part of x, or in different ones and one part of y (both are counted by
    the tasks that hold these parts), or in different parts of both (counted by
    the sums of the cells).  Ranks are what lies before a part and the rank in
    it.  So no row is repeated for a replicate, no task holds more than two
    parts' rows, and the last step holds the cells of TOGETHER replicates.
    """
    own = written(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(key_text(keys), F.col(x).alias("x"), F.col(y).alias("y")).withColumn("all", F.lit(1)), "resampled")

    def placed(value: str, part: str, salt: str) -> DataFrame:
        size = F.greatest(F.lit(PART_ROWS), F.ceil(F.col("__total") / MOST_PARTS))
        single = F.col("__n") >= size
        counts = ordered_counts(own, value, ["all"])
        return counts.select(value, F.col("__before").alias(f"r{value}"), (2 * F.floor(F.col("__before") / size) + single.cast("int")).cast("int").alias(part), F.when(single, F.ceil(F.col("__n") / size)).otherwise(1).alias(salt))

    rows = own.join(placed("x", "a", "slices"), "x").join(placed("y", "b", "__slices").drop("__slices"), "y")
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("__key"), F.col("slices"))).select("a", "slice", "b", "rx", "ry", "__key")
    by_x = written(rows.groupBy("a", "slice").applyInArrow(_x_sums(replicates, seed), _HANDED), "by-x")
    handed = F.col("kind") == _ROW
    by_y = by_x.where(handed).groupBy("b").applyInArrow(_y_sums(replicates), _HANDED)
    return by_x.where(~handed).unionByName(by_y).groupBy("together").applyInArrow(_correlations, "replicate int, rho double, tau double")
