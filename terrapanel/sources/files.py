"""Readers and writers of file formats.

Everything is a Spark reader or a Python data source with one partition for
each file, so that files are read by the tasks.
"""

from __future__ import annotations

import io
import json
import struct
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.feather
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from terrapanel.functions.numeric import normalise
from terrapanel.functions.quantiles import in_parts

PARTS = "array<array<array<struct<x: double, y: double>>>>"
RINGS = T.ArrayType(T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])))


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Pruned scan, NaN as NULL."""
    df = spark.read.parquet(path)
    return normalise(df.select(*columns) if columns else df)


def read_csv(spark: SparkSession, path: str, schema: str, columns: Sequence[str] | None = None, rows: int | None = None) -> DataFrame:
    """With an explicit schema; ``rows`` is the reader's own limit (a preview)."""
    df = spark.read.schema(schema).option("header", True).csv(path)
    df = df.select(*columns) if columns else df
    return df if rows is None else df.limit(rows)


def read_years(spark: SparkSession, path: str, name: str = "year") -> DataFrame:
    """A directory with one folder ``year=...`` for each vintage."""
    return spark.read.option("basePath", path).parquet(f"{path}/{name}=*")


def read_matching(spark: SparkSession, path: str, pattern: str, fmt: str = "parquet") -> DataFrame:
    """Files whose names fit a glob, with the shard number that their names end in."""
    df = spark.read.format(fmt).option("pathGlobFilter", pattern).load(path)
    return df.withColumn("shard", F.regexp_extract("_metadata.file_name", r"(\d+)\.[^.]+$", 1).try_cast("int"))


def read_geojson(spark: SparkSession, path: str, properties: dict[str, str]) -> DataFrame:
    """Polygon features as rows: the named properties with their types, and parts, an array of polygons."""
    point = "array<double>"
    schema = f"features array<struct<properties: struct<{', '.join(f'`{k}`: {v}' for k, v in properties.items())}>, geometry: struct<type: string, coordinates: string>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    ring = f"array<array<{point}>>"
    polygons = F.when(F.col("f.geometry.type") == "MultiPolygon", F.from_json("f.geometry.coordinates", f"array<{ring}>")).otherwise(F.array(F.from_json("f.geometry.coordinates", ring)))
    parts = F.transform(polygons, lambda p: F.transform(p, lambda r: F.transform(r, lambda q: F.struct(q[0].alias("x"), q[1].alias("y")))))
    return rows.select(*[F.col(f"f.properties.`{k}`").alias(k) for k in properties], parts.alias("parts"))


def to_geojson(df: DataFrame, parts: str, properties: Sequence[str], style: dict[str, str] | None = None) -> DataFrame:
    """One JSON text for each row, a multi-polygon feature; to be written as lines."""
    coordinates = F.transform(parts, lambda p: F.transform(p, lambda r: F.transform(r, lambda q: F.array(q["x"], q["y"]))))
    extra = [F.lit(v).alias(k) for k, v in (style or {}).items()]
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(*properties, *extra).alias("properties"), F.struct(F.lit("MultiPolygon").alias("type"), coordinates.alias("coordinates")).alias("geometry"))
    return df.select(F.to_json(feature).alias("value"))


def write_geojson(df: DataFrame, path: str, parts: str, properties: Sequence[str], style: dict[str, str] | None = None) -> None:
    """A folder of feature collections, one file for each partition; features pass through one at a time."""

    def collection(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line = lambda texts: pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["value"])
        first = True
        for batch in batches:
            texts = batch.column(0).to_pylist()
            if texts:
                yield line([('{"type": "FeatureCollection", "features": [' if first and not n else ",") + t for n, t in enumerate(texts)])
                first = False
        if not first:
            yield line(["]}"])

    to_geojson(df, parts, properties, style).mapInArrow(collection, "value string").write.text(path)


def hadoop_uri(spark: SparkSession, path: str) -> str:
    """The path with the scheme of the file system that Spark would take for it, as pyarrow reads it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()
    return whole.replace("file:/", "file:///", 1) if whole.startswith("file:/") and not whole.startswith("file://") else whole


def trajectories_json(df: DataFrame, unit: str, year: str, value: str) -> DataFrame:
    """A row for each unit: its values by year as one compact JSON object."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(year).cast("string").alias("k"), F.col(value).alias("v"))))
    return df.groupBy(unit).agg(F.to_json(F.map_from_entries(pairs)).alias("by_year"))


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)


def read_feather(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Arrow IPC files, decoded in the tasks."""
    kind = T._parse_datatype_string(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                table = pyarrow.feather.read_table(io.BytesIO(content.as_py()), columns=kind.fieldNames())
                yield from table.to_batches()

    return normalise(_files(spark, path, "*.feather").select("content").mapInArrow(run, kind))


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """NumPy files: rows (name, shape, data as doubles)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            arrays = [np.load(io.BytesIO(c), allow_pickle=False) for c in pdf["content"]]
            yield pd.DataFrame({"name": pdf["path"].str.extract(r"([^/]+)\.npy$")[0], "shape": [list(a.shape) for a in arrays], "data": [a.astype(float).ravel() for a in arrays]})

    return _files(spark, path, "*.npy").select("path", "content").mapInPandas(run, "name string, shape array<int>, data array<double>")


def write_npy(df: DataFrame, uri: str, name: str, values: str) -> None:
    """A NumPy file for each row, ``<name>.npy`` under a folder that pyarrow's file systems reach, with the row's array as doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = pyarrow.fs.FileSystem.from_uri(uri)
        system.create_dir(folder, recursive=True)
        for batch in batches:
            for own, array in zip(*(batch.column(k).to_pylist() for k in range(2)), strict=True):
                with system.open_output_stream(f"{folder}/{own}.npy") as out:
                    np.save(out, np.array(array, float))
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    df.select(F.col(name).cast("string"), F.col(values)).mapInArrow(run, "n long").agg(F.sum("n")).collect()


def wkb_of(parts: list | None) -> bytes | None:
    """The WKB of a multi-polygon, rings as they are."""
    if parts is None:
        return None
    out = [struct.pack("<BII", 1, 6, len(parts))]
    for rings in parts:
        out.append(struct.pack("<BII", 1, 3, len(rings)))
        for r in rings:
            out.append(struct.pack(f"<I{2 * len(r)}d", len(r), *[v for q in r for v in (q["x"], q["y"])]))
    return b"".join(out)


def format_wkb(parts: Column) -> Column:
    """A column of parts as WKB, for columns of GeoParquet files."""

    @F.arrow_udf(T.BinaryType())
    def run(shapes: pa.Array) -> pa.Array:
        return pa.array([wkb_of(v) for v in shapes.to_pylist()], pa.binary())

    return run(parts)


def _wkb_polygons(wkb: bytes, at: int) -> tuple[list | None, int]:
    """Polygons of one geometry, and where it ends; None for kinds without area."""
    order = "<" if wkb[at] else ">"
    code = struct.unpack_from(order + "I", wkb, at + 1)[0]
    at += 5 + (4 if code & 0x20000000 else 0)  # an id of the reference system
    plain = code & 0x0FFFFFFF
    axes = 2 + bool(code & 0x80000000) + bool(code & 0x40000000) + (0, 1, 1, 2)[plain // 1000 % 4]
    kind, count = plain % 1000, struct.unpack_from(order + "I", wkb, at)[0]
    at += 4
    out: list = []
    if kind == 3:
        rings = []
        for _ in range(count):
            n = struct.unpack_from(order + "I", wkb, at)[0]
            values = struct.unpack_from(order + f"{axes * n}d", wkb, at + 4)
            rings.append([{"x": values[axes * i], "y": values[axes * i + 1]} for i in range(n)])
            at += 4 + 8 * axes * n
        return [rings] if rings else [], at
    if kind in (6, 7):
        for _ in range(count):
            own, at = _wkb_polygons(wkb, at)
            if own is None:
                return (out or None), at
            out += own
        return out, at
    return None, at


def wkb_parts(wkb: bytes | None) -> list | None:
    """All polygons of a WKB polygon, multi-polygon or collection, with or without Z and M (which are left out); None for anything else."""
    return _wkb_polygons(wkb, 0)[0] if wkb else None


def parse_wkb(wkb: Column) -> Column:
    """A column of parts, for columns of GeoParquet files."""

    @F.arrow_udf(PARTS)
    def run(s: pa.Array) -> pa.Array:
        return pa.array([wkb_parts(v) for v in s.to_pylist()], pa.list_(pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))))

    return run(wkb)


def first_there(spark: SparkSession, paths: Sequence[str], read) -> DataFrame:
    """``read`` of the first path that exists: a source with fallbacks."""
    for path in paths:
        if exists(spark, path):
            return read(path)
    raise FileNotFoundError(", ".join(paths))


def tract_ids(df: DataFrame, candidates: Sequence[str] = ("GEOID", "GEOID10", "GEOID20", "GEO_ID")) -> DataFrame:
    """df with ``geoid``: the first id column that is there, without its prefix."""
    present = [c for c in df.columns if c in candidates or c.upper().startswith("GEOID")]
    if not present:
        raise ValueError("no id column")
    return df.withColumn("geoid", F.regexp_replace(F.coalesce(*[F.col(c).cast("string") for c in present]), "^14000(00)?US", ""))


def merge_chunks(parts: Sequence[DataFrame], on: str) -> DataFrame:
    """Outer join of tables that hold different variables of the same units."""
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, on, "full")
    return out


def with_absent(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns that a vintage lacks, as NULL."""
    return df.withColumns({c: F.lit(None).cast("double") for c in columns if c not in df.columns}) if set(columns) - set(df.columns) else df


def exists(spark: SparkSession, path: str) -> bool:
    """On whatever file system the path names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def materialise(spark: SparkSession, path: str, build, partition_by: Sequence[str] = (), per_file: int | None = None) -> DataFrame:
    """What is at the path; built and written only if nothing is there."""
    if not exists(spark, f"{path}/_SUCCESS"):
        writer = build().write.mode("overwrite").option("compression", "zstd")
        writer = writer.option("maxRecordsPerFile", per_file) if per_file else writer
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.parquet(path)


def in_shards(df: DataFrame, order: Sequence[str], rows: int) -> DataFrame:
    """df dealt to tasks in whole shards of so many rows in the given order; only the last shard has fewer, and it comes last in its task.

    Written with as many rows a file, there is one file for each shard.
    """
    dealt = in_parts(df, order)
    parts = dealt.groupBy("__part").agg(F.count("*").alias("__n"))  # a row for each task
    parts = parts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    numbered = dealt.join(F.broadcast(parts), "__part").withColumn("__shard", F.floor((F.col("__before") + F.col("__at")) / rows))
    return numbered.repartition("__shard").sortWithinPartitions("__shard").drop("__part", "__at", "__before", "__shard")


def append_csv(df: DataFrame, path: str) -> None:
    """One distributed write, with a header in each file."""
    df.write.mode("append").option("header", True).csv(path)


def new_building_extract(df: DataFrame, built: str, after: int, upto: int, columns: Sequence[str]) -> DataFrame:
    """Buildings of after < built <= upto, projected, with whole-number years, in order."""
    own = df.where((F.col(built) > after) & (F.col(built) <= upto)).withColumn(built, F.col(built).cast("int"))
    return own.select(*columns).orderBy(built, columns[0])


def log_parameters(spark: SparkSession, path: str, parameters: dict) -> None:
    """A run's parameters as one line of JSON."""
    spark.createDataFrame([(json.dumps(parameters, sort_keys=True),)], "value string").coalesce(1).write.mode("append").text(path)


def shapefile_polygons(content: bytes) -> list[list | None]:
    """Rings of each record of a ``.shp`` file with polygons; None for empty records and other shapes."""
    at, out = 100, []
    while at + 12 <= len(content):
        size = struct.unpack_from(">i", content, at + 4)[0] * 2
        body = content[at + 8 : at + 8 + size]
        at += 8 + size
        if struct.unpack_from("<i", body)[0] != 5:
            out.append(None)
            continue
        n_parts, n_points = struct.unpack_from("<2i", body, 36)
        parts = [*struct.unpack_from(f"<{n_parts}i", body, 44), n_points]
        values = struct.unpack_from(f"<{2 * n_points}d", body, 44 + 4 * n_parts)
        out.append([[{"x": values[2 * i], "y": values[2 * i + 1]} for i in range(a, z)] for a, z in zip(parts, parts[1:], strict=False)])
    return out


def shapefile_records(content: bytes, encoding: str = "latin-1") -> list[dict[str, str]]:
    """Fields of each record of a ``.dbf`` file, as text without the padding."""
    count, header, width = struct.unpack_from("<IHH", content, 4)
    fields = [(content[at : at + 11].split(b"\0")[0].decode(encoding), content[at + 16]) for at in range(32, header - 1, 32)]
    out = []
    for n in range(count):
        at, row = header + n * width + 1, {}
        for name, size in fields:
            row[name] = content[at : at + size].decode(encoding).strip()
            at += size
        out.append(row)
    return out


def read_shapefile(spark: SparkSession, path: str, fields: Sequence[str]) -> DataFrame:
    """Polygon shapefiles of a folder (``.shp`` with its ``.dbf``): the fields as text, and rings."""
    stem = F.regexp_replace("path", r"\.(shp|dbf)$", "")
    shapes, tables = (_files(spark, path, f"*.{kind}").select(stem.alias("stem"), F.col("content").alias(kind)) for kind in ("shp", "dbf"))
    schema = T.StructType([*[T.StructField(f, T.StringType()) for f in fields], T.StructField("rings", RINGS)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for shp, dbf in zip(pdf["shp"], pdf["dbf"], strict=True):
                polygons, rows = shapefile_polygons(shp), shapefile_records(dbf)
                yield pd.DataFrame({**{f: [r.get(f) for r in rows] for f in fields}, "rings": polygons})

    return shapes.join(tables, "stem").select("shp", "dbf").mapInPandas(run, schema)


class FeatherWriter(DataSourceArrowWriter):
    """Each task writes one Arrow IPC file under a hidden name; the commit gives them their names."""

    def __init__(self, path: str):
        self.path = path

    def write(self, batches: Iterator[pa.RecordBatch]) -> "FeatherPart":
        name = writer = None
        system, folder = pyarrow.fs.FileSystem.from_uri(self.path)
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                if writer is None:
                    name = f"part-{uuid.uuid4().hex}"
                    system.create_dir(folder, recursive=True)
                    out = system.open_output_stream(f"{folder}/.{name}")
                    writer = pa.ipc.new_file(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd"))
                writer.write_batch(batch)  # one batch is held at a time
        finally:
            if writer is not None:
                writer.close()
                out.close()
        return FeatherPart(name)

    def commit(self, messages: list) -> None:
        system, folder = pyarrow.fs.FileSystem.from_uri(self.path)
        for m in messages:
            if m is not None and m.name:
                system.move(f"{folder}/.{m.name}", f"{folder}/{m.name}.feather")

    def abort(self, messages: list) -> None:
        system, folder = pyarrow.fs.FileSystem.from_uri(self.path)
        for m in messages:
            if m is not None and m.name:
                system.delete_file(f"{folder}/.{m.name}")


@dataclass
class FeatherPart(WriterCommitMessage):
    name: str | None


class FeatherSink(DataSource):
    """``df.write.format("feather_files").mode("append").save(uri)``, for file systems that pyarrow knows (local, HDFS, S3, GCS)."""

    @classmethod
    def name(cls) -> str:
        return "feather_files"

    def writer(self, schema, overwrite: bool) -> FeatherWriter:
        return FeatherWriter(self.options["path"])


def write_feather(df: DataFrame, uri: str) -> None:
    """Arrow IPC files, one for each partition with rows."""
    df.sparkSession.dataSource.register(FeatherSink)
    df.write.format("feather_files").mode("append").save(uri)
