"""Tiled rasters as rows of chunks: (dataset, chunk_row, chunk_col, h, w, bands, data).

Files are listed and read by Spark's ``binaryFile`` source, on whatever file
system the path names; small chunks share a task.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "dataset string, chunk_row long, chunk_col long, h int, w int, bands int, data binary"


def _binary(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)


def _dataset(path: str) -> F.Column:
    """The folder that a file is in."""
    return F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)


def read_chunks(spark: SparkSession, root: str, datasets: Sequence[str] = ()) -> DataFrame:
    """``root`` holds a folder for each dataset, with ``grid.json`` (height, width, bands, chunk) and files ``<chunk_row>.<chunk_col>.bin`` of raw bytes, band last."""
    grid = F.from_json(F.col("content").cast("string"), "height int, width int, bands int, chunk int")
    grids = _binary(spark, root, "grid.json").select(_dataset("path").alias("dataset"), grid.alias("g"))  # a row for each dataset
    place = lambda k: F.regexp_extract("path", r"(\d+)\.(\d+)\.bin$", k).cast("long")
    files = _binary(spark, root, "*.bin").select(_dataset("path").alias("dataset"), place(1).alias("chunk_row"), place(2).alias("chunk_col"), F.col("content").alias("data"))
    files = files.where(F.col("dataset").isin(*datasets)) if datasets else files
    side = lambda whole, at: F.least(F.col("g.chunk"), F.col(f"g.{whole}") - F.col(at) * F.col("g.chunk")).cast("int")
    rows = files.join(F.broadcast(grids), "dataset")
    return rows.select("dataset", "chunk_row", "chunk_col", side("height", "chunk_row").alias("h"), side("width", "chunk_col").alias("w"), F.col("g.bands").alias("bands"), "data")


def _hidden(spark: SparkSession, glob: str) -> dict[str, str]:
    """Small text files whose names begin with a dot, which Spark's sources leave out; one for each array."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(glob)
    system, out = pattern.getFileSystem(spark._jsc.hadoopConfiguration()), {}
    for status in system.globStatus(pattern) or []:
        stream = system.open(status.getPath())
        out[status.getPath().toString()] = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
    return out


def decompressed(data: bytes, codec: str | None) -> bytes:
    """One chunk's bytes; codecs are those that need no library of their own."""
    if codec is None:
        return data
    if codec in ("zlib", "gzip"):
        return zlib.decompress(data, wbits=zlib.MAX_WBITS | 32)
    if codec == "zstd":
        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    raise ValueError(f"codec {codec!r} is not supported")


def read_zarr(spark: SparkSession, root: str, datasets: Sequence[str] = (), band_first: bool = True) -> DataFrame:
    """Zarr arrays (version 2) of bytes in folders under ``root``: two axes, or three with the band first or last, all bands in one chunk.

    Chunks are ``<a>.<b>[.<c>]`` or nested with ``/``; compressed with zlib,
    gzip, zstd or not at all.  A chunk at the edge is cut to the array; one that
    is not stored has no row.
    """
    meta = {}
    for path, text in _hidden(spark, f"{root}/*/.zarray").items():
        own = json.loads(text)
        if own["dtype"][1:] != "u1" or own["order"] != "C" or own.get("filters"):
            raise ValueError(f"{path}: only plain bytes in C order are supported")
        meta[path.rsplit("/", 1)[0]] = own
    folders = sorted(meta, key=len, reverse=True)

    def run(batches):
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                folder = next((f for f in folders if path.startswith(f + "/")), None)
                key = path[len(folder) + 1 :].replace("/", ".").split(".") if folder else []
                if not key or not all(k.isdigit() for k in key):
                    continue
                own, at = meta[folder], list(map(int, key))
                shape, chunk = own["shape"], own["chunks"]
                raw = decompressed(content.as_py(), (own.get("compressor") or {}).get("id"))
                y, x = (1, 2) if len(shape) == 3 and band_first else (0, 1)
                bands = shape[0 if band_first else 2] if len(shape) == 3 else 1
                if len(shape) == 3 and chunk[0 if band_first else 2] < bands:
                    raise ValueError(f"{path}: bands are spread over chunks")
                pixels = np.frombuffer(raw, np.uint8).reshape(chunk)
                pixels = np.moveaxis(pixels, 0, 2) if y else pixels.reshape(*chunk[:2], -1)
                h, w = min(chunk[y], shape[y] - at[y] * chunk[y]), min(chunk[x], shape[x] - at[x] * chunk[x])
                rows.append((folder.rsplit("/", 1)[-1], at[y], at[x], h, w, bands, pixels[:h, :w, :bands].tobytes()))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["dataset", "chunk_row", "chunk_col", "h", "w", "bands", "data"])

    found = _binary(spark, root).select("path", "content").mapInArrow(run, SCHEMA)
    return found.where(F.col("dataset").isin(*datasets)) if datasets else found
