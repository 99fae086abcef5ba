"""Batch scoring through a pluggable function, and its registry."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

Scorer = Callable[[np.ndarray, np.ndarray], np.ndarray]

_REGISTRY: dict[str, Scorer] = {}


def register_scorer(name: str) -> Callable[[Scorer], Scorer]:
    def add(f: Scorer) -> Scorer:
        _REGISTRY[name] = f
        return f

    return add


def names() -> list[str]:
    return sorted(_REGISTRY)


def scorer(name: str) -> Scorer:
    if name not in _REGISTRY:
        raise KeyError(f"no scorer {name!r}; there are {names()}")
    return _REGISTRY[name]


@register_scorer("linear")
def linear(features: np.ndarray, meta: np.ndarray) -> np.ndarray:
    """Mean of the features plus a hundredth of the sum of the metadata; a stand-in for a model."""
    return features.mean(axis=1) + 0.01 * meta.sum(axis=1)


def gelu(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1 + np.tanh(np.sqrt(2 / np.pi) * (x + 0.044715 * x**3)))


def late_fusion(weights: dict[str, np.ndarray]) -> Scorer:
    """Linear, GELU and layer norm over the features; joined with the metadata; linear to one score."""

    def score(features: np.ndarray, meta: np.ndarray) -> np.ndarray:
        h = gelu(features @ weights["w1"] + weights["b1"])
        h = (h - h.mean(axis=1, keepdims=True)) / np.sqrt(h.var(axis=1, keepdims=True) + 1e-5)
        return np.concatenate([h, meta], axis=1) @ weights["w2"] + weights["b2"]

    return score


def score_batches(df: DataFrame, features: str, meta: list[str], f: Scorer, name: str = "predicted_value") -> DataFrame:
    """df with a score from the array column ``features`` and the columns ``meta``; Arrow batches, one call each.

    Rows with NULL features or metadata get NULL.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok = pdf[features].notna() & pdf[meta].notna().all(axis=1)
            out = pd.Series(np.nan, index=pdf.index)
            if ok.any():
                x = np.stack([np.asarray(v, float) for v in pdf.loc[ok, features]])
                out[ok] = f(x, pdf.loc[ok, meta].to_numpy(float))
            yield pdf.assign(**{name: out.where(ok, None).astype("float64")})

    return df.mapInPandas(run, T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())]))


#: Bytes of pixels that wait for a batch to fill.
WAITING_BYTES = 64 << 20


def fixed_batches(batches: Iterator[pa.RecordBatch], size: int, bytes_of) -> Iterator[pa.Table]:
    """The rows of Arrow batches dealt anew, ``size`` at a time and in order, across the batches' borders.

    A batch is smaller only at the end, or where its rows reach WAITING_BYTES.
    """
    waiting: list[pa.RecordBatch] = []
    rows = held = 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            upto, own = at, 0
            while upto < batch.num_rows and rows + upto - at < size and (own + held < WAITING_BYTES or not rows + upto - at):
                own += bytes_of(batch, upto)
                upto += 1
            waiting.append(batch.slice(at, upto - at))
            rows, held, at = rows + upto - at, held + own, upto
            if rows == size or held >= WAITING_BYTES:
                yield pa.Table.from_batches(waiting)
                waiting, rows, held = [], 0, 0
    if rows:
        yield pa.Table.from_batches(waiting)


def score_tiles(tiles: DataFrame, meta: list[str], f: Scorer, size: int, mean: float = 0.0, scale: float = 1.0, name: str = "predicted_value") -> DataFrame:
    """Tiles without their pixels, with a score from each: (pixel / 255 - mean) / scale, flattened, and the columns ``meta``.

    The scorer sees ``size`` tiles at a time, whatever the Arrow batches, and
    ``batch_rows`` says how many it saw with this one; tiles of one batch that
    differ in shape are scored shape by shape.  NULL pixels or metadata give NULL.
    """
    kept = [c for c in tiles.columns if c != "data"]

    def run(batches):
        for table in fixed_batches(batches, size, lambda b, n: len(b.column("data")[n].as_buffer() or b"")):
            data, shapes = table.column("data").to_pylist(), [table.column(c).to_pylist() for c in ("h", "w", "bands")]
            known = np.array([[np.nan if v is None else float(v) for v in table.column(c).to_pylist()] for c in meta]).reshape(len(meta), table.num_rows).T
            out = np.full(table.num_rows, np.nan)
            groups: dict[tuple, list[int]] = {}
            for n, (b, shape) in enumerate(zip(data, zip(*shapes, strict=True), strict=True)):
                if b is not None and not np.isnan(known[n]).any():
                    groups.setdefault(shape, []).append(n)
            for rows in groups.values():
                x = (np.stack([np.frombuffer(data[n], np.uint8) for n in rows]) / 255.0 - mean) / scale
                out[rows] = f(x, known[rows])
            columns = [table.column(c).combine_chunks() for c in kept]
            columns += [pa.array(out, mask=np.isnan(out)), pa.array(np.full(table.num_rows, table.num_rows, np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, name, "batch_rows"])

    schema = T.StructType([*[tiles.schema[c] for c in kept], T.StructField(name, T.DoubleType()), T.StructField("batch_rows", T.IntegerType())])
    return tiles.mapInArrow(run, schema)
