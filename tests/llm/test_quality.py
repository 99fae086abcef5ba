import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from terrapanel.llm.quality import SYMBOLS, TRIGRAM_BUCKETS, WORD_BUCKETS, co_train, fit_quality, score_quality

SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, score double"


def test_views_teach_each_other():
    rng = np.random.default_rng(4)
    y = rng.integers(0, 2, 2000).astype(float)
    a = y[:, None] * 2 + rng.normal(size=(2000, 3))
    b = y[:, None] * 2 + rng.normal(size=(2000, 2))
    model = co_train(a[:60], b[:60], y[:60], a[60:1000], b[60:1000])
    alone = co_train(a[:60], b[:60], y[:60], a[:0], b[:0])
    right = lambda m: ((m.score(a[1000:], b[1000:])[0] >= 0.5) == y[1000:]).mean()
    assert right(model) >= 0.95 and right(model) >= right(alone) - 0.01


def test_held_out_quality_on_documents(spark):
    from terrapanel.llm.queries import op7_quality

    path = "/root/testdata/sf0.1"
    found = op7_quality(spark, path).join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id").where("held_out")
    right, rows = found.agg(F.sum((F.col("kept") == (F.col("quality") == 1)).cast("int")), F.count("*")).first()
    assert right >= 0.97 * rows


def slow_text_features(text):
    """Every measure counted by itself."""
    raw = (text or "").encode()
    words = raw.split()
    n, size = len(words), len(raw)
    if not n:
        return [0.0] * (13 + WORD_BUCKETS + TRIGRAM_BUCKETS)
    among = lambda some: sum(b in some for b in raw)
    symbols, same = among(SYMBOLS), sum(words[i] == words[i + 1] for i in range(n - 1))
    out = [math.log1p(n), symbols / size, float(symbols > 0), min(1.0, symbols / n), among(range(65, 91)) / size, among(range(48, 58)) / size, same / n]
    out += [max(map(words.count, set(words))) / n, len(set(words)) / n, (size - n) / n / 10, among(b".!?") / n, (among(b"\n") + 1) / n, math.log1p(same)]
    by_word, by_trigram = [0] * WORD_BUCKETS, [0] * TRIGRAM_BUCKETS
    for w in words:
        by_word[zlib.crc32(w.lower()) % WORD_BUCKETS] += 1
    low = raw.lower()
    for i in range(size - 2):
        h = (low[i] * 0x9E3779B1 ^ low[i + 1] * 0x85EBCA77 ^ low[i + 2] * 0xC2B2AE3D) % 2**32 >> 9
        by_trigram[h % TRIGRAM_BUCKETS] += 1
    return out + [math.sqrt(c / n) for c in by_word] + [math.sqrt(c / max(1, size - 2)) for c in by_trigram]


def slow_meta_features(source, lang, n_chars):
    out = [0.0] * 82
    out[zlib.crc32((source if source is not None else "\0").encode()) % 64] = 1.0
    out[64 + zlib.crc32((lang if lang is not None else "\0").encode()) % 16] = 1.0
    out[80] = float(n_chars is None)
    out[81] = math.log1p(max(0, n_chars or 0)) / 10
    return out


def test_scores_by_plain_python(spark):
    """Each view's logit, calibration and the combination, recomputed feature by feature."""
    rng = random.Random(6)
    rows = []
    for i in range(240):
        good = i % 3 > 0
        words = [rng.choice("abcdefgh") * rng.randrange(1, 5) + rng.choice(["", ".", "\n", "É"] if good else ["#", "$$", "@@"]) for _ in range(rng.randrange(1, 90))]
        rows.append((i, " ".join(words), rng.choice(["s", "t", None]), rng.choice(["en", None]), rng.choice([None, 5, 900]), 0.0))
    rows += [(900, None, None, None, None, 0.0), (901, "", "s", "en", -4, 0.0), (902, "ab", "s", "en", 2, 0.0), (903, "Wort ##  w\n" * 3000, "s", "de", 9, 0.0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = fit_quality(docs, spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 240, 2)], "doc_id long, quality int"))
    sigmoid = lambda x: 1 / (1 + math.exp(-x))

    def slow(text, *meta):
        own = []
        for view, x, (a, b) in zip(model.views, (slow_text_features(text), slow_meta_features(*meta)), model.calibration, strict=True):
            logit = sum((v - m) / s * w for v, m, s, w in zip(x, view.mean, view.scale, view.slope, strict=True)) + view.offset
            own.append(a * max(-15, min(15, logit)) + b)
        return sigmoid(sum(a * b for a, b in zip(own, model.mix[0], strict=True)) + model.mix[1]), sigmoid(own[0]), sigmoid(own[1])

    got = {r.doc_id: (r.score, r.text_score, r.meta_score) for r in score_quality(docs, model).collect()}
    for i, *x, _ in rows:
        np.testing.assert_allclose(got[i], slow(*x), atol=1e-7)


def test_nulls_one_label_and_empty_tables(spark):
    rows = [(1, None, None, None, None, 0.0), (None, "", "s", "en", 3, 0.0), (3, "word " * 200_000, "s", "en", -5, 0.0), (3, "word", "s", "en", 4, 0.0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in score_quality(docs, fit_quality(docs, none)).collect()] == [0.5] * 4
    one = spark.createDataFrame([(1, 1), (3, 1), (3, None), (None, 0)], "doc_id long, quality int")
    assert all(r.score > 0.9 for r in score_quality(docs, fit_quality(docs, one)).collect())
    both = spark.createDataFrame([(1, 0), (3, 1)], "doc_id long, quality int")
    model = fit_quality(docs, both)
    assert len(score_quality(docs, model).collect()) == 4
    assert score_quality(docs.limit(0), model).count() == 0
