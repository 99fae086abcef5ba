"""Stores of raster chunks that tasks read one chunk at a time: a Spark data source with pushdown, and direct reads.

Where chunks are, how large they are and how their bytes are packed follows from
each array's metadata, so no chunk has to be listed or opened to know which ones
a query needs.  Only those are opened; one that isn't stored has no row.  Files
are read by ``pyarrow.fs``, from local folders, S3, GCS or HDFS by the path's
scheme.  For stores that only Spark can open, ``raster.read_zarr`` reads all.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from terrapanel.sources.raster import SCHEMA, decompressed

ARROW = pa.schema([("dataset", pa.string()), ("chunk_row", pa.int64()), ("chunk_col", pa.int64()), ("h", pa.int32()), ("w", pa.int32()), ("bands", pa.int32()), ("data", pa.binary())])
#: Bytes of pixels that a task reads, about.
TASK_BYTES = 64 << 20


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path.removeprefix("file:")


@dataclass(frozen=True)
class ChunkArray:
    """One dataset: height, width, bands, the chunk's height and width, and where the band axis stands (first, last or none)."""

    height: int
    width: int
    bands: int
    chunk_height: int
    chunk_width: int
    axis: str
    codec: str | None = None
    separator: str = "."
    suffix: str = ""

    @staticmethod
    def zarr(text: str, band_first: bool) -> ChunkArray:
        own = json.loads(text)
        if own["dtype"][1:] != "u1" or own["order"] != "C" or own.get("filters"):
            raise ValueError("only plain bytes in C order are supported")
        shape, chunk = own["shape"], own["chunks"]
        axis = "none" if len(shape) == 2 else "first" if band_first else "last"
        y = 1 if axis == "first" else 0
        bands = 1 if axis == "none" else shape[0 if axis == "first" else 2]
        if axis != "none" and chunk[0 if axis == "first" else 2] < bands:
            raise ValueError("bands are spread over chunks")
        return ChunkArray(shape[y], shape[y + 1], bands, chunk[y], chunk[y + 1], axis, (own.get("compressor") or {}).get("id"), own.get("dimension_separator", "."))

    @staticmethod
    def raw(text: str) -> ChunkArray:
        own = json.loads(text)
        return ChunkArray(own["height"], own["width"], own["bands"], own["chunk"], own["chunk"], "last", suffix=".bin")

    @property
    def shape(self) -> tuple[int, int]:
        """Rows and columns of chunks."""
        return -(-self.height // self.chunk_height), -(-self.width // self.chunk_width)

    def size(self, row: int, col: int) -> tuple[int, int]:
        return min(self.chunk_height, self.height - row * self.chunk_height), min(self.chunk_width, self.width - col * self.chunk_width)

    def key(self, row: int, col: int) -> str:
        at = {"none": [row, col], "first": [0, row, col], "last": [row, col] if self.suffix else [row, col, 0]}[self.axis]
        return self.separator.join(map(str, at)) + self.suffix

    def pixels(self, stored: bytes, row: int, col: int) -> np.ndarray:
        """Height x width x bands; a chunk of Zarr is stored whole and cut to the array."""
        h, w = self.size(row, col)
        x = np.frombuffer(decompressed(stored, self.codec), np.uint8)
        if self.suffix:
            return x.reshape(h, w, self.bands)
        if self.axis == "first":
            return np.moveaxis(x.reshape(-1, self.chunk_height, self.chunk_width), 0, 2)[:h, :w, : self.bands]
        return x.reshape(self.chunk_height, self.chunk_width, -1)[:h, :w, : self.bands]


@dataclass(frozen=True)
class ChunkStore:
    """A folder with a folder for each dataset; small enough to travel with each task."""

    root: str
    arrays: dict[str, ChunkArray] = field(default_factory=dict)

    @staticmethod
    def open(root: str, band_first: bool = True) -> ChunkStore:
        """Reads each dataset's ``.zarray`` or ``grid.json``."""
        system, base = _opened(root)
        arrays = {}
        for info in system.get_file_info(pafs.FileSelector(base, allow_not_found=True)):
            if info.type != pafs.FileType.Directory:
                continue
            for name, read in ((".zarray", lambda t: ChunkArray.zarr(t, band_first)), ("grid.json", ChunkArray.raw)):
                path = f"{info.path}/{name}"
                if system.get_file_info(path).type == pafs.FileType.File:
                    with system.open_input_stream(path) as f:
                        arrays[info.base_name] = read(f.read().decode())
                    break
        return ChunkStore(root, arrays)

    def reader(self) -> ChunkFiles:
        return ChunkFiles(self)


class ChunkFiles:
    """Reads chunks in one task; counts the files that it opened."""

    def __init__(self, store: ChunkStore):
        self.store, (self.system, self.base), self.opened = store, _opened(store.root), 0

    def get(self, dataset: str, row: int, col: int) -> np.ndarray | None:
        array = self.store.arrays.get(dataset)
        if array is None or not (0 <= row < array.shape[0] and 0 <= col < array.shape[1]):
            return None
        try:
            with self.system.open_input_stream(f"{self.base}/{dataset}/{array.key(row, col)}") as f:
                stored = f.read()
        except FileNotFoundError:
            return None
        self.opened += 1
        return array.pixels(stored, row, col)


@dataclass
class _Chunks(InputPartition):
    keys: list[tuple[str, int, int]]


class _Reader(DataSourceReader):
    def __init__(self, store: ChunkStore, wanted: dict[str, tuple[int, int, int, int]]):
        self.store, self.wanted = store, wanted

    def partitions(self) -> Sequence[InputPartition]:
        """Neighbouring chunks share a task: blocks of rows and columns, TASK_BYTES of pixels each."""
        out = []
        for name, (r0, r1, c0, c1) in sorted(self.wanted.items()):
            array = self.store.arrays[name]
            side = max(1, int((TASK_BYTES / (array.chunk_height * array.chunk_width * array.bands)) ** 0.5))
            for r in range(r0, r1, side):
                for c in range(c0, c1, side):
                    out.append(_Chunks([(name, y, x) for y in range(r, min(r + side, r1)) for x in range(c, min(c + side, c1))]))
        return out or [_Chunks([])]

    def read(self, partition: _Chunks) -> Iterator[pa.RecordBatch]:
        files = self.store.reader()
        for name, row, col in partition.keys:
            x = files.get(name, row, col)
            if x is not None:
                yield pa.RecordBatch.from_pylist([dict(zip(ARROW.names, (name, row, col, *x.shape, x.tobytes()), strict=True))], schema=ARROW)


class _PushingReader(_Reader):
    def pushFilters(self, filters: list[Filter]):
        """Datasets, and ranges of chunk rows and columns."""
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") else None
            if name == "dataset" and isinstance(f, EqualTo | In):
                names = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = {k: v for k, v in self.wanted.items() if k in names}
            elif name in ("chunk_row", "chunk_col") and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                low = f.value + isinstance(f, GreaterThan) if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual) else 0
                high = f.value + 1 - isinstance(f, LessThan) if isinstance(f, EqualTo | LessThan | LessThanOrEqual) else 1 << 62
                k = 0 if name == "chunk_row" else 2
                self.wanted = {n: (*v[:k], max(v[k], low), min(v[k + 1], high), *v[k + 2 :]) for n, v in self.wanted.items()}
            else:
                yield f


class ChunkSource(DataSource):
    """``spark.read.format("raster_chunks")``: options ``path``, ``band_first``, ``datasets``, ``rows`` and ``cols`` (half-open ranges of chunks).

    ``push``: also from the filters of a query; the session must have
    ``spark.sql.python.filterPushdown.enabled``.
    """

    @classmethod
    def name(cls) -> str:
        return "raster_chunks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        o = self.options
        store = ChunkStore.open(o["path"], o.get("band_first", "true").lower() == "true")
        span = lambda key, n: [max(0, min(n, int(x))) for x in o[key].split(",")] if key in o else [0, n]
        names = json.loads(o["datasets"]) if "datasets" in o else store.arrays
        wanted = {k: (*span("rows", a.shape[0]), *span("cols", a.shape[1])) for k, a in store.arrays.items() if k in names}
        return (_PushingReader if o.get("push", "false").lower() == "true" else _Reader)(store, wanted)


def read_store(spark: SparkSession, root: str, datasets: Sequence[str] = (), rows: tuple[int, int] | None = None, cols: tuple[int, int] | None = None, band_first: bool = True) -> DataFrame:
    """The chunks of a store, of some datasets and half-open ranges of chunks; no other chunk is opened.

    Filters on the result are pushed as well where the session has
    ``spark.sql.python.filterPushdown.enabled``.
    """
    spark.dataSource.register(ChunkSource)
    push = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    found = spark.read.format("raster_chunks").option("path", root).option("band_first", str(band_first)).option("push", push)
    for key, span in (("rows", rows), ("cols", cols)):
        found = found.option(key, f"{span[0]},{span[1]}") if span else found
    return (found.option("datasets", json.dumps(list(datasets))) if datasets else found).load()


def write_store(chunks: DataFrame, root: str, height: int, width: int, bands: int, chunk: int) -> None:
    """Chunk rows as a store of raw bytes, one file a chunk, with a ``grid.json`` for each dataset; each task writes its own chunks."""
    text = json.dumps({"height": height, "width": width, "bands": bands, "chunk": chunk})

    def run(batches):
        system, base = _opened(root)
        for batch in batches:
            for name, row, col, data in zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True):
                system.create_dir(f"{base}/{name}", recursive=True)
                with system.open_output_stream(f"{base}/{name}/{row}.{col}.bin") as f:
                    f.write(data)
                with system.open_output_stream(f"{base}/{name}/grid.json") as f:  # the same bytes whoever writes them
                    f.write(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    rows = chunks.select("dataset", "chunk_row", "chunk_col", "data")
    rows.mapInArrow(run, "n long").agg(F.sum("n")).collect()
