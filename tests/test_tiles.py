import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terrapanel.operators import raster, scoring
from terrapanel.sources.chunk_store import ChunkStore, read_store, write_store

IMAGE = np.random.default_rng(2).integers(0, 256, (23, 31, 2), dtype=np.uint8)
SIDE = 7


def chunk_rows(image=IMAGE, name="a", side=SIDE):
    out = []
    for r in range(-(-image.shape[0] // side)):
        for c in range(-(-image.shape[1] // side)):
            x = image[r * side : (r + 1) * side, c * side : (c + 1) * side]
            out.append((name, r, c, *x.shape, bytearray(x.tobytes())))
    return out


CHUNKS = "dataset string, chunk_row long, chunk_col long, h int, w int, bands int, data binary"


def some_windows(n=60):
    rng = np.random.default_rng(3)
    out = []
    for i in range(n):
        r, c = rng.integers(0, 23), rng.integers(0, 31)
        out.append((i, "a", int(r), int(min(23, r + rng.integers(0, 15))), int(c), int(min(31, c + rng.integers(0, 15)))))
    return [*out, (n, "none", 0, 4, 0, 4), (None, "a", 0, 3, 0, 3)]


WINDOWS = "id long, dataset string, row_start int, row_stop int, col_start int, col_stop int"


def check(tiles, windows, stride):
    got = {r.id: np.frombuffer(r.data, np.uint8).reshape(r.h, r.w, r.bands) for r in tiles.collect()}
    assert len(got) == len(windows)
    for i, name, r0, r1, c0, c1 in windows:
        want = IMAGE[r0:r1:stride, c0:c1:stride] if name == "a" else np.zeros((4, 4, 1), np.uint8)[::stride, ::stride]
        np.testing.assert_array_equal(got[i], want)


@pytest.mark.parametrize(("stride", "most", "broadcast"), [(1, 4096, 32 << 20), (3, 2, 0)])
def test_tiles_from_rows_and_from_a_store(spark, tmp_path, monkeypatch, stride, most, broadcast):
    monkeypatch.setattr(raster, "WINDOWS_A_TASK", most)
    monkeypatch.setattr(raster, "LISTS_BYTES", broadcast)
    monkeypatch.setattr(raster, "PIECE_BYTES", 50)
    chunks = spark.createDataFrame(chunk_rows(), CHUNKS)
    windows = spark.createDataFrame(some_windows(), WINDOWS)
    check(raster.assemble_tiles(windows, chunks, SIDE, "id", stride), some_windows(), stride)
    write_store(chunks, str(tmp_path / "s"), 23, 31, 2, SIDE)
    check(raster.assemble_tiles(windows, ChunkStore.open(str(tmp_path / "s")), SIDE, "id", stride), some_windows(), stride)


def test_no_chunk_crosses_an_exchange_and_shuffles_hold_pixels_of_tiles_only(spark, tmp_path):
    spark.createDataFrame(chunk_rows(), CHUNKS).write.parquet(f"{tmp_path}/chunks")
    chunks = spark.read.parquet(f"{tmp_path}/chunks")
    windows = spark.createDataFrame(some_windows(), WINDOWS)
    pieces = raster.tile_pieces(windows, chunks, SIDE, "id")
    plan = pieces._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan
    whole = sum((r1 - r0) * (c1 - c0) * 2 for _, name, r0, r1, c0, c1 in some_windows() if name == "a")
    assert pieces.agg(F.sum(F.length("data"))).first()[0] == whole


def test_only_touched_chunks_are_opened(spark, tmp_path):
    root = tmp_path / "s"
    write_store(spark.createDataFrame(chunk_rows(), CHUNKS), str(root), 23, 31, 2, SIDE)
    for path in (root / "a").glob("*.bin"):
        if not path.name.startswith(("1.", "2.")):
            path.write_bytes(b"x")  # whoever opens it fails
    (root / "a" / "2.0.bin").unlink()
    rows = read_store(spark, str(root), ["a"], (1, 3), (0, 3)).collect()
    assert sorted((r.chunk_row, r.chunk_col) for r in rows) == [(1, 0), (1, 1), (1, 2), (2, 1), (2, 2)]
    for r in rows:
        y, x = r.chunk_row * SIDE, r.chunk_col * SIDE
        np.testing.assert_array_equal(np.frombuffer(r.data, np.uint8).reshape(r.h, r.w, r.bands), IMAGE[y : y + SIDE, x : x + SIDE])
    windows = spark.createDataFrame([(1, "a", 8, 20, 9, 30)], WINDOWS)
    tile = raster.assemble_tiles(windows, ChunkStore.open(str(root)), SIDE, "id").first()
    np.testing.assert_array_equal(np.frombuffer(tile.data, np.uint8).reshape(tile.h, tile.w, 2), IMAGE[8:20, 9:30])
    assert read_store(spark, str(root), ["b"]).count() == 0
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        pushed = read_store(spark, str(root)).where("dataset = 'a' AND chunk_row >= 1 AND chunk_row < 3 AND chunk_col = 2")
        assert sorted((r.chunk_row, r.chunk_col) for r in pushed.collect()) == [(1, 2), (2, 2)]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


@pytest.mark.parametrize("axis", ["none", "first", "last"])
@pytest.mark.parametrize("separator", [".", "/"])
def test_zarr_stores(spark, tmp_path, axis, separator):
    import json
    import zlib

    x = {"none": IMAGE[:, :, 0], "first": np.moveaxis(IMAGE, 2, 0), "last": IMAGE}[axis]
    side = [2, SIDE, SIDE] if axis == "first" else [SIDE, SIDE, 2][: x.ndim]
    base = tmp_path / "z" / "d"
    base.mkdir(parents=True)
    (base / ".zarray").write_text(json.dumps({"shape": x.shape, "chunks": side, "dtype": "|u1", "order": "C", "compressor": {"id": "zlib"}, "filters": None, "fill_value": 0, "dimension_separator": separator}))
    for at in np.ndindex(*[-(-n // k) for n, k in zip(x.shape, side, strict=True)]):
        full = np.zeros(side, np.uint8)
        part = x[tuple(slice(i * k, (i + 1) * k) for i, k in zip(at, side, strict=True))]
        full[tuple(slice(0, n) for n in part.shape)] = part
        path = base / separator.join(map(str, at))
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(zlib.compress(full.tobytes()))
    whole = IMAGE[:, :, :1] if axis == "none" else IMAGE
    rows = read_store(spark, str(tmp_path / "z"), band_first=axis != "last").collect()
    assert len(rows) == 20
    for r in rows:
        y, c = r.chunk_row * SIDE, r.chunk_col * SIDE
        np.testing.assert_array_equal(np.frombuffer(r.data, np.uint8).reshape(r.h, r.w, r.bands), whole[y : y + SIDE, c : c + SIDE])


def test_regrid_by_pixel(spark):
    other = np.random.default_rng(5).integers(0, 256, (9, 12, 2), dtype=np.uint8)
    chunks = spark.createDataFrame(chunk_rows() + chunk_rows(other, "b") + chunk_rows(other, "c"), CHUNKS)
    places = spark.createDataFrame([("a", 0, 0, 1), ("b", 11, 26, 5), ("c", -4, -5, 0)], "dataset string, row_offset int, col_offset int, priority int")
    want = np.zeros((30, 40, 2), np.uint8)
    want[0:5, 0:7] = other[4:, 5:]
    want[:23, :31] = IMAGE
    want[11:20, 26:38] = other
    got = np.zeros_like(want)
    rows = raster.regrid(chunks, places, SIDE, 30, 40).collect()
    for r in rows:
        got[r.chunk_row * SIDE : r.chunk_row * SIDE + r.h, r.chunk_col * SIDE : r.chunk_col * SIDE + r.w] = np.frombuffer(r.data, np.uint8).reshape(r.h, r.w, 2)
    np.testing.assert_array_equal(got, want)
    assert len({(r.chunk_row, r.chunk_col) for r in rows}) == len(rows)


def test_batches_of_a_fixed_size(spark):
    batches = [pa.RecordBatch.from_pydict({"n": list(range(a, b))}) for a, b in ((0, 5), (5, 5), (5, 18), (18, 19), (19, 41))]
    out = list(scoring.fixed_batches(iter(batches), 8, lambda b, n: 1))
    assert [t.num_rows for t in out] == [8, 8, 8, 8, 8, 1] and [v for t in out for v in t.column("n").to_pylist()] == list(range(41))
    small = list(scoring.fixed_batches(iter(batches), 8, lambda b, n: scoring.WAITING_BYTES // 3))
    assert all(t.num_rows <= 4 for t in small) and sum(t.num_rows for t in small) == 41
    rows = [(i, 2, 2, 1, bytearray([i, 2, 3, 4]), 1.0) for i in range(50)] + [(50, 1, 2, 1, bytearray([9, 9]), 1.0), (51, 2, 2, 1, None, 1.0), (52, 2, 2, 1, bytearray(4), None)]
    df = spark.createDataFrame(rows, "id int, h int, w int, bands int, data binary, m double").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r.id: r for r in scoring.score_tiles(df, ["m"], scoring.scorer("linear"), 16, 0.5, 0.25).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted({r.batch_rows for r in got.values()}) == [5, 16]
    for i in range(50):
        assert got[i].predicted_value == pytest.approx(((np.array([i, 2, 3, 4]) / 255 - 0.5) / 0.25).mean() + 0.01)
    assert got[50].predicted_value == pytest.approx((9 / 255 - 0.5) / 0.25 + 0.01)
    assert got[51].predicted_value is None and got[52].predicted_value is None
