"""Raster grids as arithmetic, tiles as joins on chunks.

A grid is x0, dx, nx (ascending) and y0, dy, ny (descending, dy < 0), with
coordinates at x0 + i dx.  Pixels are bytes in chunk rows.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrapanel.functions.quantiles import group_quantiles
from terrapanel.sources.chunk_store import ChunkStore
from terrapanel.sources.scratch import folder


class Grid(NamedTuple):
    x0: float
    dx: float
    nx: int
    y0: float
    dy: float
    ny: int


def _bounded(c: Column, n: int) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(n), c)).cast("int")


def pixel_window(grid: Grid, minx: Column, miny: Column, maxx: Column, maxy: Column) -> dict[str, Column]:
    """Half-open index ranges of the pixels in a box, edges included."""
    up = -grid.dy
    return {
        "col_start": _bounded(F.ceil((minx - grid.x0) / grid.dx), grid.nx),
        "col_stop": _bounded(F.floor((maxx - grid.x0) / grid.dx) + 1, grid.nx),
        "row_start": _bounded(F.ceil((grid.y0 - maxy) / up), grid.ny),
        "row_stop": _bounded(F.floor((grid.y0 - miny) / up) + 1, grid.ny),
    }


def point_index(grid: Grid, x: Column, y: Column) -> tuple[Column, Column]:
    """Row and column of the nearest pixel."""
    return F.round((grid.y0 - y) / -grid.dy).cast("int"), F.round((x - grid.x0) / grid.dx).cast("int")


def point_window(grid: Grid, x: Column, y: Column, size: int) -> tuple[dict[str, Column], Column]:
    """A window of size x size pixels around a point, and whether it lies within the grid."""
    row, col = point_index(grid, x, y)
    w = {"row_start": row - size // 2, "row_stop": row - size // 2 + size, "col_start": col - size // 2, "col_stop": col - size // 2 + size}
    return w, (w["row_start"] >= 0) & (w["col_start"] >= 0) & (w["row_stop"] <= grid.ny) & (w["col_stop"] <= grid.nx)


def squareness(df: DataFrame, lower: float = 0.005, upper: float = 0.995, slack: float = 0.05) -> DataFrame:
    """One row: quantiles of width over height of windows, and whether they are near 1."""
    shape = F.try_divide((F.col("col_stop") - F.col("col_start")).cast("double"), F.nullif((F.col("row_stop") - F.col("row_start")).cast("double"), F.lit(0.0)))
    q = group_quantiles(df.select(shape.alias("shape")), "shape", [lower, upper], name="q")
    return q.select(F.col("q")[0].alias("low"), F.col("q")[1].alias("high")).withColumn("square", (F.col("low") >= 1 - slack) & (F.col("high") <= 1 + slack))


def chunk_keys(df: DataFrame, size: int, empty: bool = False) -> DataFrame:
    """A row for each chunk (chunk_row, chunk_col) that a window touches.

    ``empty``: a window without pixels that begins and ends at index 0, as one
    beside the raster does when it is cut to it, touches the chunk there.
    """
    last = lambda b: F.floor((F.col(b) - 1) / size)
    stop = (lambda a, b: F.when((F.col(a) == 0) & (F.col(b) == 0), F.lit(0).cast("long")).otherwise(last(b))) if empty else lambda a, b: last(b)
    span = lambda a, b: F.sequence(F.floor(F.col(a) / size), stop(a, b))
    there = lambda a, b: (F.col(b) > F.col(a)) | (F.lit(empty) & (F.col(a) == 0) & (F.col(b) == 0))
    some = df.where(there("row_start", "row_stop") & there("col_start", "col_stop"))
    return some.withColumn("chunk_row", F.explode(span("row_start", "row_stop"))).withColumn("chunk_col", F.explode(span("col_start", "col_stop")))


def crop_windows(grid: Grid, box: dict[str, Column], margin: float, most: int) -> dict[str, Column]:
    """The pixel window of a box grown by a margin, and the stride that brings its longer side to ``most`` pixels at most."""
    w = pixel_window(grid, box["minx"] - margin, box["miny"] - margin, box["maxx"] + margin, box["maxy"] + margin)
    longer = F.greatest(w["row_stop"] - w["row_start"], w["col_stop"] - w["col_start"])
    return {**w, "stride": F.greatest(F.lit(1), F.ceil(longer / most)).cast("int")}


def link_datasets(points: DataFrame, catalog: DataFrame, x: str, y: str, year: str) -> DataFrame:
    """points with ``dataset``: the raster of their year whose extent holds them, edges included; of several the last in the catalog.

    catalog: name, position, year, minx, miny, maxx, maxy; a handful of rows for
    each year, which travel to the points as one array a year.  Every point
    stays, repeated ones too; NULL where no raster holds it.
    """
    extents = catalog.groupBy(F.col("year").alias("__year")).agg(F.collect_list(F.struct("position", "name", "minx", "miny", "maxx", "maxy")).alias("__extents"))
    holds = lambda e: F.col(x).between(e["minx"], e["maxx"]) & F.col(y).between(e["miny"], e["maxy"])
    last = F.array_max(F.filter("__extents", holds))
    return points.join(extents, F.col(year) == F.col("__year"), "left").withColumn("dataset", last["name"]).drop("__year", "__extents")


#: Windows that are cut from one chunk in one task, and chunks that many windows touch at most, so that their table can be broadcast.
WINDOWS_A_TASK, HOT_CHUNKS = 4096, 1 << 16
#: Bytes of window lists that are broadcast to chunks; longer ones meet the chunks in a shuffle.
LISTS_BYTES = 32 << 20
#: Bytes of pieces after which a batch is handed on.
PIECE_BYTES = 4 << 20

_PIECES = "h int, w int, bands int, top int, left int, rows int, cols int, rank long, data binary"


def _by_chunk(windows: DataFrame, chunk: int, tile_id: str) -> DataFrame:
    """Rows (dataset, chunk_row, chunk_col, deal, windows): the windows of each chunk as a list, of about WINDOWS_A_TASK; of more, several lists."""
    key = ["dataset", "chunk_row", "chunk_col"]
    own = F.struct(F.col(f"`{tile_id}`").alias("id"), "row_start", "row_stop", "col_start", "col_stop", "rank")
    ranked = windows if "rank" in windows.columns else windows.withColumn("rank", F.lit(0).cast("long"))
    keyed = chunk_keys(ranked, chunk).select(*key, own.alias("window"))
    most = max(WINDOWS_A_TASK, -(-keyed.count() // HOT_CHUNKS))
    hot = keyed.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > most)  # HOT_CHUNKS at most
    dealt = keyed.join(F.broadcast(hot), key, "left").withColumn("deal", F.when(F.col("n").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("window"), F.ceil(F.col("n") / most)).cast("int")))
    return dealt.groupBy(*key, "deal").agg(F.collect_list("window").alias("windows"))


def _cut(pixels: np.ndarray, y: int, x: int, window: dict, stride: int) -> tuple[int, int, np.ndarray] | None:
    """The pixels of a chunk at (y, x) that a window takes with its stride, and their place in the tile."""
    top, left = max(y, window["row_start"]), max(x, window["col_start"])
    bottom, right = min(y + pixels.shape[0], window["row_stop"]), min(x + pixels.shape[1], window["col_stop"])
    top, left = top + (window["row_start"] - top) % stride, left + (window["col_start"] - left) % stride
    if top >= bottom or left >= right:
        return None
    piece = pixels[top - y : bottom - y : stride, left - x : right - x : stride]
    return (top - window["row_start"]) // stride, (left - window["col_start"]) // stride, piece


def _pieces(rows: DataFrame, chunk: int, tile_id: str, kind: str, stride: int, pixels_of) -> DataFrame:
    """Pieces of tiles, cut where the chunk is: rows (tile_id, ..., data) from rows (dataset, chunk_row, chunk_col, windows, ...)."""
    names = [tile_id, "h", "w", "bands", "top", "left", "rows", "cols", "rank", "data"]
    types = [pa.int32()] * 7 + [pa.int64(), pa.binary()]

    def run(batches):
        read = pixels_of()
        for batch in batches:
            found, size = [], 0

            def flush(found=found):
                columns = list(zip(*found, strict=True))
                own = batch.schema.field("windows").type.value_type.field("id").type  # noqa: B023
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [own, *types], strict=True)], names=names)

            for n in range(batch.num_rows):
                row = {c: batch.column(c)[n].as_py() for c in ("dataset", "chunk_row", "chunk_col", "windows")}
                pixels = read(batch, n, row)
                if pixels is None:
                    continue
                for window in row["windows"]:
                    cut = _cut(pixels, row["chunk_row"] * chunk, row["chunk_col"] * chunk, window, stride)
                    if cut is not None:
                        top, left, piece = cut
                        sides = [-(-(window[f"{k}_stop"] - window[f"{k}_start"]) // stride) for k in ("row", "col")]
                        found.append((window["id"], *sides, pixels.shape[2], top, left, *piece.shape[:2], window["rank"], piece.tobytes()))
                        size += piece.nbytes
                    if size > PIECE_BYTES:
                        yield flush()
                        found.clear()
                        size = 0
            if found:
                yield flush()

    return rows.mapInArrow(run, f"`{tile_id}` {kind}, {_PIECES}")


def _from_rows():
    """Pixels of a row's own ``data``."""

    def read(batch, n, row):
        h, w, bands = (batch.column(c)[n].as_py() for c in ("h", "w", "bands"))
        data = batch.column("data")[n]
        return np.frombuffer(data.as_buffer(), np.uint8).reshape(h, w, bands) if data.is_valid else None

    return read


def tile_pieces(windows: DataFrame, chunks: DataFrame | ChunkStore, chunk: int, tile_id: str, stride: int = 1) -> DataFrame:
    """What each chunk gives to each tile that touches it.

    Windows travel to chunks, not chunks to tiles.  From a store, a task opens
    the chunks of its own window lists, each of them once, and no others.  Chunk
    rows of a table stay where they are scanned if the window lists are small
    enough to be broadcast; else each row is shuffled once, however many tiles
    touch it.
    """
    kind, lists = windows.schema[tile_id].dataType.simpleString(), _by_chunk(windows, chunk, tile_id)
    if isinstance(chunks, ChunkStore):

        def from_store():
            files = chunks.reader()
            return lambda batch, n, row: files.get(row["dataset"], row["chunk_row"], row["chunk_col"])

        return _pieces(lists.drop("deal"), chunk, tile_id, kind, stride, from_store)
    spark, base = chunks.sparkSession, folder(chunks.sparkSession, "windows")
    lists.write.parquet(base)
    lists = spark.read.schema(lists.schema).parquet(base)
    small = lists.agg(F.coalesce(F.sum(F.size("windows") * 48 + 64), F.lit(0))).first()[0] <= LISTS_BYTES
    own = chunks.select("dataset", "chunk_row", "chunk_col", "h", "w", "bands", "data")
    met = own.join(F.broadcast(lists) if small else lists, ["dataset", "chunk_row", "chunk_col"])
    return _pieces(met.drop("deal"), chunk, tile_id, kind, stride, _from_rows)


def merged_pieces(pieces: DataFrame, frames: DataFrame, tile_id: str) -> DataFrame:
    """Tiles (tile_id, h, w, bands, data) from their pieces, those of higher ``rank`` on top; 0 where there is none.

    frames: a row for each tile, (tile_id, h, w, bands).
    """
    nothing = [F.lit(0).cast(t).alias(c) for c, t in (("top", "int"), ("left", "int"), ("rows", "int"), ("cols", "int"), ("rank", "long"))]
    both = pieces.unionByName(frames.select(tile_id, "h", "w", "bands", *nothing, F.lit(b"").alias("data")))

    def paste(table: pa.Table) -> pa.Table:
        h, w, bands, top, left, rows, cols, rank = (table.column(c).to_pylist() for c in ("h", "w", "bands", "top", "left", "rows", "cols", "rank"))
        out, data = np.zeros((h[0], w[0], max(bands)), np.uint8), table.column("data")
        for n in sorted((n for n in range(len(rows)) if rows[n] > 0), key=lambda n: (rank[n], top[n], left[n])):
            piece = np.frombuffer(data[n].as_buffer(), np.uint8).reshape(rows[n], cols[n], bands[n])
            out[top[n] : top[n] + rows[n], left[n] : left[n] + cols[n], : bands[n]] = piece
        sides = {c: pa.array([v], pa.int32()) for c, v in zip(("h", "w", "bands"), out.shape, strict=True)}
        return pa.table({tile_id: table.column(tile_id).slice(0, 1), **sides, "data": pa.array([out.tobytes()], pa.binary())})

    kind = frames.schema[tile_id].dataType.simpleString()
    return both.groupBy(tile_id).applyInArrow(paste, f"`{tile_id}` {kind}, h int, w int, bands int, data binary")


def assemble_tiles(windows: DataFrame, chunks: DataFrame | ChunkStore, chunk: int, tile_id: str, stride: int = 1) -> DataFrame:
    """Tiles from chunks: rows (tile_id, h, w, bands, data) of windows (tile_id, dataset, row_start, row_stop, col_start, col_stop).

    Only pieces of tiles are shuffled (see ``tile_pieces``), cut and strided
    already.  Missing chunks leave 0, also where a tile has none at all (its
    bands are then those of its dataset, or 1); empty windows give empty tiles.
    """
    if isinstance(chunks, ChunkStore):
        bands = windows.sparkSession.createDataFrame([(k, a.bands) for k, a in chunks.arrays.items()], "dataset string, bands int")
    else:
        bands = chunks.groupBy("dataset").agg(F.max("bands").alias("bands"))  # a row for each dataset
    size = lambda a, b: F.greatest(F.lit(0), F.ceil((F.col(a) - F.col(b)) / stride)).cast("int")
    frames = windows.join(bands, "dataset", "left").select(tile_id, size("row_stop", "row_start").alias("h"), size("col_stop", "col_start").alias("w"), F.coalesce("bands", F.lit(1)).alias("bands"))
    return merged_pieces(tile_pieces(windows, chunks, chunk, tile_id, stride), frames, tile_id)


def regrid(chunks: DataFrame, places: DataFrame, chunk: int, height: int, width: int) -> DataFrame:
    """One raster of chunks from several that don't line up: rows (chunk_row, chunk_col, h, w, bands, data).

    places: (dataset, row_offset, col_offset, priority), where a dataset's first
    pixel lies in the new grid, of height x width pixels.  Each chunk is cut at
    the borders of the new grid's chunks; of pixels that several datasets have,
    the one of the highest priority (ties: the smaller name) stays, so overlaps
    are cropped pixel by pixel.  Pixels that none has are 0; chunks without any
    have no row.
    """
    order = F.row_number().over(W.orderBy(F.col("priority").asc(), F.col("dataset").desc())).cast("long")  # a row for each dataset
    own = chunks.join(places.withColumn("rank", order), "dataset")
    first = lambda k: (F.col(f"chunk_{k}") * chunk + F.col(f"{k}_offset")).cast("long")
    size = {"row": height, "col": width}
    here = own.select("h", "w", "bands", "data", "rank", first("row").alias("y"), first("col").alias("x"))

    def run(batches):
        types = [pa.int64(), pa.int64(), *[pa.int32()] * 7, pa.int64(), pa.binary()]
        names = ["chunk_row", "chunk_col", "h", "w", "bands", "top", "left", "rows", "cols", "rank", "data"]
        for batch in batches:
            for n in range(batch.num_rows):
                h, w, bands, data, rank, y, x = (batch.column(c)[n].as_py() for c in ("h", "w", "bands", "data", "rank", "y", "x"))
                pixels, found = np.frombuffer(data, np.uint8).reshape(h, w, bands), []
                for r in range(max(0, y) // chunk, -(-min(height, y + h) // chunk)):
                    for c in range(max(0, x) // chunk, -(-min(width, x + w) // chunk)):
                        window = {"row_start": r * chunk, "row_stop": min(height, (r + 1) * chunk), "col_start": c * chunk, "col_stop": min(width, (c + 1) * chunk)}
                        cut = _cut(pixels, y, x, window, 1)
                        if cut is not None:
                            top, left, piece = cut
                            found.append((r, c, window["row_stop"] - r * chunk, window["col_stop"] - c * chunk, bands, top, left, *piece.shape[:2], rank, piece.tobytes()))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*found, strict=True), types, strict=True)], names=names)

    pieces = here.mapInArrow(run, f"chunk_row long, chunk_col long, {_PIECES}")
    pieces = pieces.withColumn("place", F.shiftleft("chunk_row", 31) + F.col("chunk_col"))
    frames = pieces.select("place", "h", "w", "bands").distinct()
    whole = merged_pieces(pieces.drop("chunk_row", "chunk_col"), frames, "place")
    return whole.select(F.shiftright("place", 31).alias("chunk_row"), F.col("place").bitwiseAND(F.lit((1 << 31) - 1)).alias("chunk_col"), "h", "w", "bands", "data")


def masked_pixels(data: Column, bands: Column) -> Column:
    """The other bands' bytes of the pixels whose first band isn't 0, in their order."""

    @F.arrow_udf(T.BinaryType())
    def run(data: pa.Array, bands: pa.Array) -> pa.Array:
        rows = (np.frombuffer(d.as_buffer(), np.uint8).reshape(-1, b.as_py()) for d, b in zip(data, bands, strict=True))
        return pa.array([x[x[:, 0] > 0, 1:].tobytes() for x in rows], pa.binary())

    return run(data, bands)


def not_blank(data: Column) -> Column:
    """Whether any byte is above 0; no Python needed."""
    return F.length(F.regexp_replace(F.hex(data), "0", "")) > 0


@F.pandas_udf(T.BinaryType())
def mask_low_bits(data: pd.Series) -> pd.Series:
    """Bytes without their two lowest bits, for better compression."""
    return data.map(lambda b: None if b is None else (np.frombuffer(b, np.uint8) & 0xFC).tobytes())


@F.pandas_udf(T.BinaryType())
def delta_bytes(data: pd.Series) -> pd.Series:
    """Each byte less the one before it, modulo 256: runs of like pixels compress better so."""
    return data.map(lambda b: None if b is None else np.diff(np.frombuffer(b, np.uint8), prepend=np.uint8(0)).tobytes())


@F.pandas_udf(T.BinaryType())
def undelta_bytes(data: pd.Series) -> pd.Series:
    """The bytes that ``delta_bytes`` was given."""
    return data.map(lambda b: None if b is None else np.cumsum(np.frombuffer(b, np.uint8), dtype=np.uint8).tobytes())


def stretch(data: Column, bands: Column, low: float, high: float) -> Column:
    """Bytes (band last) between two percentiles of their own band, spread over 0-255."""

    @F.pandas_udf(T.BinaryType())
    def run(data: pd.Series, bands: pd.Series) -> pd.Series:
        def one(b, k):
            if b is None or not len(b):
                return b
            v = np.frombuffer(b, np.uint8).astype(float).reshape(-1, int(k))
            a, z = np.percentile(v, [low, high], axis=0)
            return np.clip((v - a) / np.maximum(z - a, 1.0) * 255, 0, 255).astype(np.uint8).tobytes()

        return pd.Series([one(b, k) for b, k in zip(data, bands, strict=True)])

    return run(data, bands)


def crop_overlap(tiles: DataFrame, dx: float, dy: float) -> DataFrame:
    """Tiles (tile_row, tile_col, x0, y0, h, w, bands, data) without the pixels that the next ones to the right and below have as well.

    x0 and y0 are a tile's upper left corner; dy < 0.  Tiles of a row and of a
    column are as many as the matrix is wide and high.
    """
    right = F.lead("x0").over(W.partitionBy("tile_row").orderBy("tile_col"))
    below = F.lead("y0").over(W.partitionBy("tile_col").orderBy("tile_row"))
    ends = {"__w": F.least("w", F.coalesce(F.round((right - F.col("x0")) / dx).cast("int"), F.col("w"))), "__h": F.least("h", F.coalesce(F.round((below - F.col("y0")) / dy).cast("int"), F.col("h")))}

    @F.pandas_udf(T.BinaryType())
    def cut(data: pd.Series, h: pd.Series, w: pd.Series, h2: pd.Series, w2: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(d, np.uint8).reshape(a, b, -1)[:c, :e].tobytes() for d, a, b, c, e in zip(data, h, w, h2, w2, strict=True)])

    return tiles.withColumns(ends).withColumn("data", cut("data", "h", "w", "__h", "__w")).withColumns({"h": F.col("__h"), "w": F.col("__w")}).drop("__h", "__w")


def overview(chunks: DataFrame, chunk: int, stride: int) -> DataFrame:
    """Chunk rows with every ``stride``-th pixel of the whole raster in both directions; chunks without such a pixel go."""

    @F.pandas_udf(T.StructType([T.StructField("h", T.IntegerType()), T.StructField("w", T.IntegerType()), T.StructField("data", T.BinaryType())]))
    def thin(data: pd.Series, h: pd.Series, w: pd.Series, row: pd.Series, col: pd.Series) -> pd.DataFrame:
        out = []
        for d, a, b, r, c in zip(data, h, w, row, col, strict=True):
            x = np.frombuffer(d, np.uint8).reshape(a, b, -1)[-r * chunk % stride :: stride, -c * chunk % stride :: stride]
            out.append((x.shape[0], x.shape[1], x.tobytes()))
        return pd.DataFrame(out, columns=["h", "w", "data"])

    rest = [c for c in chunks.columns if c not in ("h", "w", "data")]
    thinned = chunks.withColumn("__thin", thin("data", "h", "w", "chunk_row", "chunk_col"))
    return thinned.select(*rest, "__thin.h", "__thin.w", "__thin.data").where("h > 0 AND w > 0")


def tile_position(name: Column) -> tuple[Column, Column]:
    """Row and column of a tile from a file name such as ``x_R3_C12.tif``."""
    return F.regexp_extract(name, r"R(\d+)", 1).try_cast("int"), F.regexp_extract(name, r"C(\d+)", 1).try_cast("int")


def multi_scale(tiles: list[DataFrame], tile_id: str) -> DataFrame:
    """Tiles of equal height and width, from windows of several sizes and strides, stacked on the band axis."""
    out = tiles[0].withColumn("parts", F.array("data")).select(tile_id, "h", "w", F.col("bands").alias("bands0"), "parts")
    for n, t in enumerate(tiles[1:], 1):
        own = t.select(tile_id, F.col("h").alias("h1"), F.col("w").alias("w1"), F.col("bands").alias(f"bands{n}"), F.col("data").alias("d1"))
        out = out.join(own, tile_id).where("h = h1 AND w = w1").withColumn("parts", F.concat("parts", F.array("d1"))).drop("h1", "w1", "d1")

    @F.pandas_udf(T.BinaryType())
    def stack(parts: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
        layers = [[np.frombuffer(p, np.uint8).reshape(a, b, -1) for p in ps] for ps, a, b in zip(parts, h, w, strict=True)]
        return pd.Series([np.concatenate(x, axis=2).tobytes() for x in layers])

    total = sum((F.col(f"bands{n}") for n in range(1, len(tiles))), F.col("bands0"))
    return out.select(tile_id, "h", "w", total.cast("int").alias("bands"), stack("parts", "h", "w").alias("data"))


def _cubic(size: int, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each wanted pixel, the four around it (edges repeated) and their weights; convolution with a = -0.75, pixel centres aligned."""
    at = (np.arange(wanted) + 0.5) * size / wanted - 0.5
    first = np.floor(at).astype(int)
    t = at - first
    far = lambda d: -0.75 * (d**3 - 5 * d**2 + 8 * d - 4)
    near = lambda d: 1.25 * d**3 - 2.25 * d**2 + 1
    weight = np.stack([far(t + 1), near(t), near(1 - t), far(2 - t)], axis=1)
    return np.clip(first[:, None] + np.arange(-1, 3), 0, size - 1), weight


def resize_bicubic(df: DataFrame, height: int, width: int) -> DataFrame:
    """Tiles (h, w, bands, data) at another size, rounded and kept within bytes; tiles of that size stay as they are."""

    @F.pandas_udf(T.BinaryType())
    def run(data: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
        out = []
        for d, a, b in zip(data, h, w, strict=True):
            x = np.frombuffer(d, np.uint8).reshape(a, b, -1).astype(float)
            if (a, b) != (height, width):
                for axis, wanted in ((0, height), (1, width)):
                    index, weight = _cubic(x.shape[axis], wanted)
                    x = np.moveaxis((np.moveaxis(x, axis, 0)[index] * weight[:, :, None, None]).sum(axis=1), 0, axis)
            # Halves are halves whatever order the taps were added in.
            out.append(np.clip(np.rint(np.round(x, 9)), 0, 255).astype(np.uint8).tobytes())
        return pd.Series(out)

    return df.withColumn("data", run("data", "h", "w")).withColumns({"h": F.lit(height), "w": F.lit(width)})


def band_first(df: DataFrame) -> DataFrame:
    """Tiles with the band as the first axis of data in place of the last."""

    @F.pandas_udf(T.BinaryType())
    def run(data: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series([np.moveaxis(np.frombuffer(d, np.uint8).reshape(a, b, -1), 2, 0).tobytes() for d, a, b in zip(data, h, w, strict=True)])

    return df.withColumn("data", run("data", "h", "w"))
