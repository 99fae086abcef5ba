"""Media columns: bytes stored in progressive JPEG files, and files decoded to RGB tensors.

A payload is stored losslessly in the format's unit, the quantised coefficient:
each byte, plus two, is one coefficient of a 4:2:0 colour image, in the order of
the image's MCUs.  Long payloads are stored as several images, one file behind
the other, so that memory stays bounded.

Defined results: a null text counts as empty; media that are null or can't be
read give null payload, size, feature and tensor; equal texts give equal media
and features whatever stands beside them; a very long text becomes several
images, which are held together, so memory is about eight times the text; an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrapanel.llm import progressive_jpeg as jpeg

SAMPLING = ((2, 2), (1, 1), (1, 1))
UNIT = 64
#: Payload bytes of one image, and of the images that are processed together.
PART_BYTES, GROUP_BYTES = 384 * 16 * 128, 768 << 10
#: MCUs side by side.
MCU_COLUMNS = 16
OFFSET = 2

_NEXT_FILE = re.compile(rb"(?<=\xff\xd9)(?=\xff\xd8)")


def padded(text: bytes) -> bytes:
    """The text with bytes 0 up to a positive multiple of 64."""
    return text + bytes(-len(text) % UNIT if text else UNIT)


def frames_of(text: bytes) -> list[jpeg.Frame]:
    payload, out = padded(text), []
    for at in range(0, len(payload), PART_BYTES):
        part = np.frombuffer(payload[at : at + PART_BYTES], np.uint8).reshape(-1, UNIT)
        mcus = -(-len(part) // 6)
        columns = MCU_COLUMNS if at else min(mcus, MCU_COLUMNS)
        size = 16 * columns, 16 * -(-mcus // columns)
        place = jpeg.geometry(*size, SAMPLING)
        blocks = np.zeros((int(place.base[-1]), UNIT), np.int16)
        blocks[place.interleaved[: len(part)]] = part.astype(np.int16) + OFFSET
        out.append(jpeg.Frame(*size, SAMPLING, blocks, comment=struct.pack(">QQ", len(text), len(part))))
    return out


def payload_of(frames: list[jpeg.Frame | None]) -> bytes | None:
    """The stored bytes; None if these are no images that frames_of made."""
    out = []
    for f in frames:
        if f is None or len(f.comment) != 16:
            return None
        blocks = struct.unpack(">QQ", f.comment)[1]
        order = jpeg.geometry(f.width, f.height, f.sampling).interleaved
        if blocks > len(order):
            return None
        out.append((f.blocks[order[:blocks]] - OFFSET).astype(np.uint8).tobytes())
    return b"".join(out) if out else None


def tensors_of(media: list[list[jpeg.Frame | None]]) -> list[np.ndarray | None]:
    """(height, width, 3) bytes of each; images of one payload stand one below the other."""
    tensors = iter(jpeg.to_rgb([f for frames in media for f in frames]))
    out: list[np.ndarray | None] = []
    for frames in media:
        own = [next(tensors) for _ in frames]
        readable = own and all(t is not None for t in own) and len({t.shape[1] for t in own}) == 1
        out.append((own[0] if len(own) == 1 else np.concatenate(own)) if readable else None)
    return out


def features_of(tensors: list[np.ndarray | None]) -> list[str | None]:
    """Mean red, green and blue, and an average hash of 8 x 8 fields' brightness; made of whole numbers only."""
    groups: dict[tuple, list[int]] = {}
    for n, t in enumerate(tensors):
        if t is not None:
            groups.setdefault(t.shape, []).append(n)
    out: list[str | None] = [None] * len(tensors)
    for (height, width, _), members in groups.items():
        rows, columns = np.arange(8) * height // 8, np.arange(8) * width // 8
        area = np.outer(np.maximum(1, np.diff(np.append(rows, height))), np.maximum(1, np.diff(np.append(columns, width))))
        for at in range(0, len(members), 64):
            own = members[at : at + 64]
            rgb = np.stack([tensors[n] for n in own])
            by_row = np.add.reduceat(rgb, rows, axis=1, dtype=np.int64)
            fields = np.add.reduceat(by_row, columns, axis=2).sum(axis=3)
            mean = rgb.reshape(len(own), -1, 3).sum(axis=1, dtype=np.int64) * 1000 // (height * width)
            bits = np.packbits((fields // area * 1000 > mean.sum(axis=1)[:, None, None]).reshape(len(own), -1), axis=1)
            for n, m, b in zip(own, mean.tolist(), bits, strict=True):
                out[n] = ",".join(f"{x / 1000:.3f}" for x in m) + ":" + b.tobytes().hex()
    return out


def _grouped(sizes, most: int):
    """Ranges of consecutive rows of about ``most`` bytes, a larger row on its own."""
    first, size = 0, 0
    for n, x in enumerate(sizes):
        if n > first and size + x > most:
            yield first, n
            first, size = n, 0
        size += x
    if sizes:
        yield first, len(sizes)


def _store(texts: list[bytes]) -> list[bytes]:
    frames = [frames_of(t) for t in texts]
    if len(texts) == 1:  # of a long text, each image by itself
        return [b"".join(jpeg.encode([f])[0] for f in frames[0])]
    files = iter(jpeg.encode([f for own in frames for f in own]))
    return [b"".join(next(files) for _ in own) for own in frames]


def _read(media: list[bytes | None]) -> list[list[jpeg.Frame | None]]:
    files = [_NEXT_FILE.split(m) if m else [None] for m in media]
    if len(media) == 1:
        return [[jpeg.decode([f])[0] for f in files[0]]]
    frames = iter(jpeg.decode([f for own in files for f in own]))
    return [[next(frames) for _ in own] for own in files]


_READ_FIELDS = [
    T.StructField("payload", T.BinaryType()),
    T.StructField("height", T.IntegerType()),
    T.StructField("width", T.IntegerType()),
    T.StructField("feature", T.StringType()),
    T.StructField("rgb_sha256", T.StringType()),
    T.StructField("rgb", T.BinaryType()),
]


def _read_columns(media: list[bytes | None], tensors: bool) -> list[pa.Array]:
    frames = _read(media)
    rgb = tensors_of(frames)
    size = lambda axis: pa.array([None if t is None else t.shape[axis] for t in rgb], pa.int32())
    return [
        pa.array([payload_of(f) for f in frames], pa.binary()),
        size(0),
        size(1),
        pa.array(features_of(rgb), pa.string()),
        pa.array([None if t is None else hashlib.sha256(np.ascontiguousarray(t)).hexdigest() for t in rgb], pa.string()),
        pa.array([t.tobytes() if tensors and t is not None else None for t in rgb], pa.binary()),
    ]


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", read_back: bool = False, tensors: bool = True) -> DataFrame:
    """One row per document: id, n_bytes and media; with ``read_back`` also what decoding the stored bytes gives, as in ``decode_media``."""
    fields = [docs.schema[id_col], T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType()), *(_READ_FIELDS if read_back else [])]
    names = [f.name for f in fields]

    def run(batches):
        for batch in batches:
            texts = batch.column(1)
            sizes = [len(t.as_py()) for t in texts]
            for a, z in _grouped(sizes, GROUP_BYTES):
                media = _store([texts[n].as_py() for n in range(a, z)])
                columns = [batch.column(0).slice(a, z - a), pa.array(sizes[a:z], pa.int64()), pa.array(media, pa.binary())]
                yield pa.RecordBatch.from_arrays([*columns, *(_read_columns(media, tensors) if read_back else [])], names=names)

    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("__raw"))
    return rows.mapInArrow(run, T.StructType(fields))


def decode_media(rows: DataFrame, media_col: str = "media", tensors: bool = True) -> DataFrame:
    """rows with payload, height, width, feature, rgb_sha256 and, unless ``tensors`` is false, rgb: height x width x 3 bytes.

    ``rgb_sha256`` is the digest of these bytes, also where they aren't handed on.

    Columns of these names are replaced.
    """
    carried = rows.select(*[c for c in rows.columns if c not in {f.name for f in _READ_FIELDS}])
    at = carried.columns.index(media_col)
    fields = [*carried.schema.fields, *_READ_FIELDS]
    names = [f.name for f in fields]

    def run(batches):
        for batch in batches:
            media = batch.column(at)
            for a, z in _grouped([len(m.as_py() or b"") for m in media], 2 * GROUP_BYTES):
                own = _read_columns([media[n].as_py() for n in range(a, z)], tensors)
                yield pa.RecordBatch.from_arrays([*(c.slice(a, z - a) for c in batch.columns), *own], names=names)

    return carried.mapInArrow(run, T.StructType(fields))
