import json
import struct

import numpy as np
import pandas as pd
import pyarrow.feather
import pytest
from pyspark.sql import functions as F

from terrapanel.operators import scoring
from terrapanel.sources import files
from terrapanel.sources.raster import read_chunks, read_zarr
from terrapanel.streaming.scoring import score_stream


def test_parquet_csv_and_years(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan"), 2010), (2, 2.0, 2012)], "id int, v double, year int")
    df.write.partitionBy("year").parquet(f"{tmp_path}/p")
    assert [r.v for r in files.read_parquet(spark, f"{tmp_path}/p", ["id", "v"]).orderBy("id").collect()] == [None, 2.0]
    assert {r.year for r in files.read_years(spark, f"{tmp_path}/p").collect()} == {2010, 2012}
    files.append_csv(df, f"{tmp_path}/c")
    files.append_csv(df, f"{tmp_path}/c")
    assert files.read_csv(spark, f"{tmp_path}/c", "id int, v double, year int", ["id"]).count() == 4
    assert files.read_csv(spark, f"{tmp_path}/c", "id int, v double, year int", rows=3).count() == 3


def test_materialise_builds_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(10).withColumn("year", F.col("id") % 2)

    for _ in range(2):
        assert files.materialise(spark, f"{tmp_path}/m", build, ["year"], per_file=3).count() == 10
    assert len(calls) == 1
    files.log_parameters(spark, f"{tmp_path}/log", {"b": 1, "a": 2})
    assert spark.read.text(f"{tmp_path}/log").first().value == '{"a": 2, "b": 1}'


def test_shards_by_name(spark, tmp_path):
    for n in (2, 10):
        pd.DataFrame({"v": [n]}).to_parquet(f"{tmp_path}/shard_{n}.parquet")
    pd.DataFrame({"v": [0]}).to_parquet(f"{tmp_path}/other.parquet")
    assert [r.shard for r in files.read_matching(spark, str(tmp_path), "shard_*.parquet").orderBy("shard").collect()] == [2, 10]


def test_geojson_there_and_back(spark, tmp_path):
    ring = [[0.0, 0.0], [2.0, 0.0], [2.0, 1.0], [0.0, 0.0]]
    features = [
        {"type": "Feature", "properties": {"id": 1, "n": "a"}, "geometry": {"type": "Polygon", "coordinates": [ring]}},
        {"type": "Feature", "properties": {"id": 2}, "geometry": {"type": "MultiPolygon", "coordinates": [[ring], [ring]]}},
    ]
    (tmp_path / "x.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    df = files.read_geojson(spark, f"{tmp_path}/x.geojson", {"id": "int", "n": "string"})
    got = {r.id: r for r in df.collect()}
    plain = lambda parts: [[[[p.x, p.y] for p in r] for r in rings] for rings in parts]
    assert plain(got[1].parts) == [[ring]] and plain(got[2].parts) == [[ring], [ring]] and got[2].n is None
    back = {b["properties"]["id"]: b for b in (json.loads(r.value) for r in files.to_geojson(df, "parts", ["id"], {"color": "red"}).collect())}
    assert back[2]["geometry"] == {"type": "MultiPolygon", "coordinates": [[ring], [ring]]} and back[1]["properties"] == {"id": 1, "color": "red"}


def test_binary_sources(spark, tmp_path):
    pyarrow.feather.write_feather(pd.DataFrame({"id": [1, 2], "v": [1.5, float("nan")], "w": ["x", "y"]}), f"{tmp_path}/a.feather")
    assert [tuple(r) for r in files.read_feather(spark, str(tmp_path), "id long, v double").orderBy("id").collect()] == [(1, 1.5), (2, None)]
    np.save(tmp_path / "t1.npy", np.arange(6).reshape(2, 3))
    row = files.read_npy(spark, str(tmp_path)).first()
    assert (row["name"], row["shape"], row["data"]) == ("t1", [2, 3], [0, 1, 2, 3, 4, 5])


def test_wkb(spark):
    polygon = lambda code, values, axes, tail=b"": b"\x01" + struct.pack("<I", code) + tail + struct.pack("<II", 1, len(values) // axes) + struct.pack(f"<{len(values)}d", *values)
    flat, z = (0, 0, 1, 0, 0, 1), (0, 0, 9, 1, 0, 9, 0, 1, 9)
    first, second = polygon(3, flat, 2), b"\x00" + struct.pack(">III", 3, 1, 2) + struct.pack(">4d", 5, 6, 7, 8)
    multi = b"\x00" + struct.pack(">II", 6, 2) + first + second
    cases = [first, multi, None, b"\x01" + struct.pack("<I", 1) + bytes(16), polygon(1003, z, 3), polygon(0x80000003, z, 3), polygon(2003, z, 3), polygon(3003, (0, 0, 9, 9, 1, 0, 9, 9, 0, 1, 9, 9), 4), polygon(0x20000003, flat, 2, struct.pack("<I", 4326))]
    df = spark.createDataFrame([(n, None if c is None else bytearray(c)) for n, c in enumerate(cases)], "id int, g binary")
    got = {r.id: r.p for r in df.select("id", files.parse_wkb(F.col("g")).alias("p")).collect()}
    plain = lambda parts: [[[(p.x, p.y) for p in r] for r in rings] for rings in parts]
    one = [[[(0, 0), (1, 0), (0, 1)]]]
    assert plain(got[1]) == [*one, [[(5, 6), (7, 8)]]]  # both parts
    assert got[2] is None and got[3] is None
    assert all(plain(got[n]) == one for n in (0, 4, 5, 6, 7, 8))


def test_feather_there_and_back(spark, tmp_path):
    df = spark.createDataFrame([(i, i / 2, "x" * i) for i in range(30)], "id long, v double, w string").repartition(3)
    files.write_feather(df, f"file://{tmp_path}/out")
    assert sorted(map(tuple, files.read_feather(spark, f"{tmp_path}/out", "id long, v double, w string").collect())) == sorted(map(tuple, df.collect()))
    files.write_feather(df.limit(0), f"file://{tmp_path}/none")


def test_first_source_that_is_there(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/second")
    assert files.first_there(spark, [f"{tmp_path}/first", f"{tmp_path}/second"], spark.read.parquet).count() == 3
    with pytest.raises(FileNotFoundError):
        files.first_there(spark, [f"{tmp_path}/first"], spark.read.parquet)


def test_ids_chunks_and_absent_columns(spark):
    df = spark.createDataFrame([("1400000US36061", 1), ("36005", 2)], "GEOID string, a int")
    assert [r.geoid for r in files.tract_ids(df).collect()] == ["36061", "36005"]
    a, b = spark.createDataFrame([(1, 2)], "k int, a int"), spark.createDataFrame([(2, 3)], "k int, b int")
    assert sorted((r.k, r.a, r.b) for r in files.merge_chunks([a, b], "k").collect()) == [(1, 2, None), (2, None, 3)]
    assert files.with_absent(a, ["a", "c"]).columns == ["k", "a", "c"]
    t = spark.createDataFrame([(1, 2012, 2.0), (1, 2010, 1.0)], "u int, y int, v double")
    assert files.trajectories_json(t, "u", "y", "v").first().by_year == '{"2010":1.0,"2012":2.0}'
    e = spark.createDataFrame([(1, 2009.0), (2, 2012.0), (3, None), (4, 2011.0)], "id int, built double")
    assert [(r.id, r.built) for r in files.new_building_extract(e, "built", 2009, 2024, ["id", "built"]).collect()] == [(4, 2011), (2, 2012)]


def test_raster_chunks(spark, tmp_path):
    folder = tmp_path / "city"
    folder.mkdir()
    (folder / "grid.json").write_text(json.dumps({"height": 5, "width": 4, "bands": 1, "chunk": 4}))
    (folder / "0.0.bin").write_bytes(bytes(range(16)))
    (folder / "1.0.bin").write_bytes(bytes(4))
    rows = read_chunks(spark, str(tmp_path)).orderBy("chunk_row").collect()
    assert [(r.dataset, r.chunk_row, r.chunk_col, r.h, r.w, len(r.data)) for r in rows] == [("city", 0, 0, 4, 4, 16), ("city", 1, 0, 1, 4, 4)]
    assert bytes(rows[0].data) == bytes(range(16)) and read_chunks(spark, str(tmp_path), ["other"]).count() == 0


def test_zarr(spark, tmp_path):
    import zlib

    import zstandard

    image = np.arange(2 * 5 * 7, dtype=np.uint8).reshape(2, 5, 7)
    for name, codec, pack in (("plain", None, bytes), ("zstd", {"id": "zstd", "level": 1}, zstandard.compress), ("zlib", {"id": "zlib", "level": 1}, zlib.compress)):
        folder = tmp_path / "all" / name
        folder.mkdir(parents=True)
        (folder / ".zarray").write_text(json.dumps({"zarr_format": 2, "shape": [2, 5, 7], "chunks": [2, 4, 4], "dtype": "|u1", "order": "C", "compressor": codec, "filters": None, "fill_value": 0}))
        for r in (0, 1):
            for c in (0, 1):
                own = np.zeros((2, 4, 4), np.uint8)
                part = image[:, 4 * r : 4 * r + 4, 4 * c : 4 * c + 4]
                own[:, : part.shape[1], : part.shape[2]] = part
                (folder / f"0.{r}.{c}").write_bytes(pack(own.tobytes()))
    rows = read_zarr(spark, f"{tmp_path}/all").collect()
    assert len(rows) == 12 and {r.dataset for r in rows} == {"plain", "zstd", "zlib"}
    for r in rows:
        part = image[:, 4 * r.chunk_row : 4 * r.chunk_row + 4, 4 * r.chunk_col : 4 * r.chunk_col + 4]
        assert (r.h, r.w, r.bands) == (*part.shape[1:], 2) and bytes(r.data) == np.moveaxis(part, 0, 2).tobytes()


def test_stream_of_scores(spark, tmp_path):
    schema = "id int, x array<double>, m int"
    spark.createDataFrame([(i, [float(i), 2.0], 1) for i in range(20)], schema).repartition(3).write.parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second run finds nothing new
        query = score_stream(spark, f"{tmp_path}/in", schema, "x", ["m"], scoring.scorer("linear"), f"{tmp_path}/out", f"{tmp_path}/check")
        assert query.awaitTermination(60)
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == 20 and out.where("id = 4").first().predicted_value == 3.01


def test_shapefile(spark, tmp_path):
    points = [(0.0, 0.0), (0.0, 2.0), (2.0, 2.0), (0.0, 0.0)]
    body = struct.pack("<i4d2i1i", 5, 0, 0, 2, 2, 1, len(points), 0) + b"".join(struct.pack("<2d", *p) for p in points)
    null = struct.pack("<i", 0)
    records = b"".join(struct.pack(">2i", n + 1, len(b) // 2) + b for n, b in enumerate((body, null)))
    (tmp_path / "t.shp").write_bytes(bytes(100) + records)
    field = b"GEOID".ljust(11, b"\0") + b"C" + bytes(4) + bytes([5]) + bytes(15)
    (tmp_path / "t.dbf").write_bytes(bytes(4) + struct.pack("<IHH", 2, 65, 6) + bytes(20) + field + b"\r" + b" 36061" + b" 36005")
    got = files.read_shapefile(spark, str(tmp_path), ["GEOID"]).collect()
    assert {r.GEOID: r.rings and [(p.x, p.y) for p in r.rings[0]] for r in got} == {"36061": points, "36005": None}


def test_chunked_requests(spark):
    from terrapanel.sources import rest

    codes = [f"v{n}" for n in range(100)]
    assert [len(c) for c in rest.variable_chunks(codes)] == [45, 45, 10]

    def fetch(vintage, wanted):
        if "v99" in wanted:
            raise rest.BadRequest
        return [{"geoid": g, **{c: f"{vintage}{c}" for c in wanted}} for g in ("a", "b")]

    df = rest.read_vintage(spark, fetch, 2014, codes)
    rows = {r.geoid: r for r in df.collect()}
    assert set(rows) == {"a", "b"} and rows["a"].v7 == "2014v7" and rows["b"].v98 == "2014v98" and rows["a"].v99 is None
    waits, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return [{}]

    assert rest.with_retry(flaky, 3, 0.5, waits.append) == [{}] and waits == [0.5, 1.0]


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace

    from terrapanel.sources import scratch

    assert scratch.folder(spark, "a") != scratch.folder(spark, "a")
    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.shared_dir(SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *_: None)))
    assert scratch.shared_dir(SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *_: "hdfs:///x/"))) == "hdfs:///x"
