import hashlib
import zlib

import numpy as np

from terrapanel.llm import media
from terrapanel.llm import progressive_jpeg as jpeg
from terrapanel.llm.media import decode_media, features_of, frames_of, padded, payload_of, store_texts, tensors_of

SCHEMA = "doc_id long, text string, payload string, rgb int"


def texts():
    rng = np.random.default_rng(1)
    out = [None, "", "a", "x" * 64, "x" * 65, "é世😂" * 50, "\x00\x01\x02" * 40, "same", "same"]
    return out + ["".join(map(chr, rng.integers(1, 900, rng.integers(1, 3000)))) for _ in range(60)] + ["long text " * 150_000]


def test_payloads_come_back(spark):
    data = texts()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(data)], SCHEMA)
    stored = store_texts(docs)
    got = {r.doc_id: r for r in decode_media(stored).collect()}
    both = {r.doc_id: r for r in store_texts(docs, read_back=True).collect()}
    for i, t in enumerate(data):
        raw = (t or "").encode()
        assert got[i].n_bytes == len(raw)
        assert got[i].payload == padded(raw) == both[i].payload
        assert len(got[i].payload) % 64 == 0 and len(got[i].payload) > 0
        assert len(got[i].rgb) == got[i].height * got[i].width * 3
        assert got[i].feature == both[i].feature and got[i].media == both[i].media
    same = [i for i, t in enumerate(data) if t == "same"]
    assert got[same[0]].media == got[same[1]].media and got[same[0]].feature == got[same[1]].feature


def test_what_is_stored_does_not_depend_on_its_neighbours():
    raw = [(t or "").encode() for t in texts()[:40]]
    together = media._store(raw)
    assert together == [media._store([t])[0] for t in raw]
    alone = [features_of(tensors_of(media._read([m])))[0] for m in together]
    assert alone == features_of(tensors_of(media._read(together)))


def test_unreadable_media_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, None), (2, b""), (3, b"no image"), (4, b"\xff\xd8\xff\xc2\x00\x03"), (5, b"\xff\xd8" * 9)], "doc_id long, media binary")
    assert all(r.payload is None and r.rgb is None and r.feature is None for r in decode_media(rows).collect())
    assert store_texts(spark.createDataFrame([], SCHEMA), read_back=True).count() == 0
    cut = media._store([b"some text here" * 50])[0]
    assert len(decode_media(spark.createDataFrame([(1, cut[:-300])], "doc_id long, media binary")).collect()) == 1


def random_frame(rng, width, height, sampling, density, most):
    place = jpeg.geometry(width, height, sampling)
    blocks = rng.integers(-most, most + 1, (int(place.base[-1]), 64)) * (rng.random((int(place.base[-1]), 64)) < density)
    shown = np.zeros(len(blocks), bool)
    for own in place.own:
        shown[own] = True
    blocks[~shown, 1:] = 0  # blocks beyond the edge are in the interleaved scans only
    return jpeg.Frame(width, height, sampling, blocks)


def test_any_coefficients_survive_the_scans():
    rng = np.random.default_rng(2)
    for sampling in (((2, 2), (1, 1), (1, 1)), ((1, 1), (1, 1), (1, 1)), ((2, 1), (1, 1), (1, 1))):
        for density, most in ((1, 255), (0.3, 3), (0.05, 1), (0.02, 500), (0, 1)):
            frames = [random_frame(rng, w, h, sampling, density, most) for w, h in ((16, 16), (100, 37), (33, 200), (1, 1))]
            for a, b in zip(frames, jpeg.decode(jpeg.encode(frames)), strict=True):
                np.testing.assert_array_equal(a.blocks, b.blocks)


def test_inverse_transform_matches_the_definition():
    rng = np.random.default_rng(3)
    block, quant = rng.integers(-40, 40, (1, 64)), rng.integers(1, 9, 64)
    natural = np.zeros(64)
    natural[jpeg.ZIGZAG] = block[0] * quant
    c = lambda u: np.sqrt(0.5) if u == 0 else 1
    want = [
        [
            sum(c(u) * c(v) / 4 * natural[8 * v + u] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16) for u in range(8) for v in range(8))
            for x in range(8)
        ]
        for y in range(8)
    ]
    got = jpeg.inverse_transform(block, quant)[0]
    assert np.abs(got - np.clip(np.array(want) + 128, 0, 255)).max() <= 0.51


def test_zigzag_begins_as_it_should():
    assert jpeg.ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and sorted(jpeg.ZIGZAG) == list(range(64))


def test_a_flat_colour_is_that_colour():
    place = jpeg.geometry(20, 10, ((2, 2), (1, 1), (1, 1)))
    blocks = np.zeros((int(place.base[-1]), 64), np.int64)
    blocks[: place.base[1], 0], blocks[place.base[1] : place.base[2], 0], blocks[place.base[2] :, 0] = (100 - 128) * 8, (90 - 128) * 8, (200 - 128) * 8
    frame = jpeg.decode(jpeg.encode([jpeg.Frame(20, 10, ((2, 2), (1, 1), (1, 1)), blocks)]))[0]
    rgb = jpeg.to_rgb([frame])[0]
    assert rgb.shape == (10, 20, 3)
    assert np.abs(rgb[0, 0].astype(int) - [100 + 1.402 * 72, 100 - 0.344136 * -38 - 0.714136 * 72, 100 + 1.772 * -38]).max() <= 1


def test_query_columns(spark):
    from terrapanel.llm.queries import op8_media

    path = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in op8_media(spark, path).collect()}
    for r in spark.read.parquet(f"{path}/documents.parquet").collect():
        p = padded(r.text.encode())
        x = got[r.doc_id]
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len(r.text.encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))


def test_digests_of_tensors(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, None), (3, "a" * 5000)], "doc_id long, text string")
    full = {r.doc_id: r for r in store_texts(docs, read_back=True).collect()}
    slim = {r.doc_id: r for r in store_texts(docs, read_back=True, tensors=False).collect()}
    for i, r in full.items():
        assert len(r.rgb) == r.height * r.width * 3 and r.rgb_sha256 == hashlib.sha256(r.rgb).hexdigest()
        assert slim[i].rgb is None and slim[i].rgb_sha256 == r.rgb_sha256


def test_long_payloads_are_several_images():
    raw = b"0123456789abcdef" * 100_000
    frames = frames_of(raw)
    assert len(frames) > 1 and payload_of(frames) == padded(raw)
