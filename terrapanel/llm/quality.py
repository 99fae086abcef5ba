"""Quality by co-training: a text view and a page-metadata view teach each other.

The text view sees a text's content: its words and its byte trigrams, hashed to
shares of WORD_BUCKETS and TRIGRAM_BUCKETS buckets, and measures of symbols,
capitals, digits, repeated words, word lengths and variety, line structure.
The metadata view sees a document's source, language and size, never its text.
Each view's logistic classifier starts from labelled rows.  In each round each
view labels the unlabelled rows of which it is surest, and the other view
learns from them as well.  Finally the views are calibrated and combined on
labelled rows that neither learned from, in which each row counts for as many as
it stands for in the sample; and all documents are scored.

The model is fitted on bounded samples: about ``texts_per_label`` labelled rows
of each label and ``pool`` unlabelled rows.

Defined results: a null text counts as empty and null metadata are values of
their own; every text if no labelled row is given, or rows of one label only,
gets that label's score, or 0.5; an id with both labels counts as good;
repeated rows are scored alike; a very long text is measured whole, in blocks
of bytes; an empty table gives an empty result; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapanel.llm.linear import logistic, sigmoid
from terrapanel.llm.samples import by_label, one_label

TEXTS_PER_LABEL = 1500
POOL = 3000
ROUNDS = 5
#: Rows that a view labels in a round, at most, for each label; and how sure it must be.
PER_ROUND, SURE = 100, 0.95
SOURCE_BUCKETS, LANG_BUCKETS = 64, 16
WORD_BUCKETS, TRIGRAM_BUCKETS = 128, 128
#: Penalty on the squares of a view's weights.
RIDGE = {"text": 20.0, "meta": 1.0}
#: Bytes of a text whose trigrams are hashed in one step, to bound memory.
BLOCK = 1 << 20
#: Rows whose features are held at a time.
ROWS = 256
N_TEXT, N_META = 13 + WORD_BUCKETS + TRIGRAM_BUCKETS, SOURCE_BUCKETS + LANG_BUCKETS + 2

SYMBOLS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:'\"()-?")
CAPITALS = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
ENDS = b".!?"


def trigram_counts(text: bytes) -> np.ndarray:
    """How many byte trigrams, lower-cased, fall into each bucket."""
    counts = np.zeros(TRIGRAM_BUCKETS, np.int64)
    for at in range(0, len(text) - 2, BLOCK):
        b = np.frombuffer(text[at : at + BLOCK + 2].lower(), np.uint8).astype(np.uint32)
        h = (b[:-2] * np.uint32(0x9E3779B1) ^ b[1:-1] * np.uint32(0x85EBCA77) ^ b[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(9)
        counts += np.bincount(h % TRIGRAM_BUCKETS, minlength=TRIGRAM_BUCKETS)
    return counts


def text_features(text: bytes) -> list[float]:
    """Measures of a whole text, then roots of the shares of its words and trigrams by bucket; zeros for an empty one."""
    words = text.split()
    n, size = len(words), len(text)
    if not n:
        return [0.0] * N_TEXT
    counts = Counter(words)
    adjacent = sum(a == b for a, b in zip(words, words[1:], strict=False))
    symbols = size - len(text.translate(None, SYMBOLS))
    lines = text.count(b"\n") + 1
    letters = size - n
    in_bucket = np.zeros(WORD_BUCKETS)
    for word, times in counts.items():
        in_bucket[zlib.crc32(word.lower()) % WORD_BUCKETS] += times
    return [
        np.log1p(n),
        symbols / size,
        float(symbols > 0),
        min(1.0, symbols / n),
        (size - len(text.translate(None, CAPITALS))) / size,
        (size - len(text.translate(None, DIGITS))) / size,
        adjacent / n,
        counts.most_common(1)[0][1] / n,
        len(counts) / n,
        letters / n / 10,
        (size - len(text.translate(None, ENDS))) / n,
        lines / n,
        np.log1p(adjacent),
        *np.sqrt(in_bucket / n),
        *np.sqrt(trigram_counts(text) / max(1, size - 2)),
    ]


def meta_features(source: str | None, lang: str | None, n_chars: int | None) -> list[float]:
    out = [0.0] * N_META
    out[zlib.crc32(b"\0" if source is None else source.encode()) % SOURCE_BUCKETS] = 1.0
    out[SOURCE_BUCKETS + zlib.crc32(b"\0" if lang is None else lang.encode()) % LANG_BUCKETS] = 1.0
    out[-2] = float(n_chars is None)
    out[-1] = np.log1p(max(0, n_chars or 0)) / 10
    return out


@dataclass
class View:
    mean: np.ndarray
    scale: np.ndarray
    slope: np.ndarray
    offset: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(((x - self.mean) / self.scale) @ self.slope + self.offset, -15, 15)


@dataclass
class QualityModel:
    """views: text and metadata; calibration of each, and their combination, as slope and offset of logits."""

    views: tuple[View, View] | None
    calibration: list[tuple[float, float]]
    mix: tuple[np.ndarray, float]
    constant: float = 0.5

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Score of both views together, of the text view, of the metadata view."""
        if self.views is None:
            flat = np.full(len(text), self.constant)
            return flat, flat, flat
        own = [a * v.logit(x) + b for v, x, (a, b) in zip(self.views, (text, meta), self.calibration, strict=True)]
        both = sigmoid(np.stack(own, axis=1) @ self.mix[0] + self.mix[1])
        return both, sigmoid(own[0]), sigmoid(own[1])


def _fit_view(x: np.ndarray, y: np.ndarray, ridge: float) -> View:
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    slope, offset = logistic((x - mean) / scale, y, ridge=ridge)
    return View(mean, scale, slope, offset)


def co_train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, pool_text: np.ndarray, pool_meta: np.ndarray, rounds: int = ROUNDS, weight: np.ndarray | None = None) -> QualityModel:
    """y: 0 or 1 for each labelled row, weight: the rows it stands for; the pool's rows have no labels."""
    weight = np.ones(len(y)) if weight is None else weight
    if len(set(y.tolist())) < 2:
        return QualityModel(None, [], (np.zeros(2), 0.0), float(y[0]) * 0.98 + 0.01 if len(y) else 0.5)
    held = np.arange(len(y)) % 4 == 0
    if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
        held = np.ones(len(y), bool)
        learn = held
    else:
        learn = ~held
    labelled, pool = (text[learn], meta[learn]), (pool_text, pool_meta)
    extra: list[dict[int, float]] = [{}, {}]  # what each view has been taught: row of the pool -> label

    def fit(v: int) -> View:
        rows = list(extra[v])
        return _fit_view(np.concatenate([labelled[v], pool[v][rows]]), np.concatenate([y[learn], [extra[v][r] for r in rows]]), (RIDGE["text"], RIDGE["meta"])[v])

    views = [fit(0), fit(1)]
    for _ in range(rounds):
        for v in (0, 1):
            p = sigmoid(views[v].logit(pool[v])) if len(pool[v]) else np.zeros(0)
            for label, sure in ((1.0, p), (0.0, 1 - p)):
                open_ = [r for r in np.argsort(-sure, kind="stable") if sure[r] >= SURE and r not in extra[1 - v]]
                extra[1 - v].update(dict.fromkeys(open_[:PER_ROUND], label))
        views = [fit(0), fit(1)]
    logits = [views[v].logit((text, meta)[v][held]) for v in (0, 1)]
    own_weight = weight[held] / weight[held].mean()
    calibration = []
    for x in logits:
        slope, offset = logistic(x[:, None], y[held], ridge=0.1, weight=own_weight)
        calibration.append((max(0.0, float(slope[0])), offset))
    own = np.stack([a * x + b for x, (a, b) in zip(logits, calibration, strict=True)], axis=1)
    return QualityModel((views[0], views[1]), calibration, logistic(own, y[held], ridge=0.1, weight=own_weight))


_COLUMNS = ("text", "source", "lang", "n_chars")


def _prepared(docs: DataFrame, columns: tuple[str, str, str, str], *keys: str) -> DataFrame:
    text, source, lang, n_chars = columns
    return docs.select(
        *[F.col(k) for k in keys],
        F.coalesce(F.col(text), F.lit("")).cast("binary").alias("__text"),
        F.col(source).cast("string").alias("__source"),
        F.col(lang).cast("string").alias("__lang"),
        F.col(n_chars).cast("long").alias("__n_chars"),
    )


def _features(batches):
    """(rows of a batch, features of both views), a few rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            rows = batch.slice(at, ROWS)
            text, source, lang, n = rows.columns[-4:]
            content, meta = np.empty((rows.num_rows, N_TEXT)), np.empty((rows.num_rows, N_META))
            for i, t in enumerate(text):
                content[i] = text_features(t.as_py())
            for i, x in enumerate(zip(source.to_pylist(), lang.to_pylist(), n.to_pylist(), strict=True)):
                meta[i] = meta_features(*x)
            yield rows, content, meta


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), x.ravel())


def _sampled(rows: DataFrame) -> list:
    """(id, label, weight, features of both views) of a bounded sample, in the order of the ids."""

    def run(batches):
        for own, content, meta in _features(batches):
            yield pa.RecordBatch.from_arrays([*own.columns[:3], _lists(content), _lists(meta)], names=["id", "y", "weight", "content", "meta"])

    found = rows.mapInArrow(run, "id string, y int, weight double, content array<double>, meta array<double>").collect()
    return sorted(found, key=lambda r: (zlib.crc32((r.id or "").encode()), r.id or "", r.content))


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    label_col: str = "quality",
    columns: tuple[str, str, str, str] = _COLUMNS,
    texts_per_label: int = TEXTS_PER_LABEL,
    pool: int = POOL,
) -> QualityModel:
    """A model from documents and the labels of some of them; null labels are not learned from."""
    marks = labels.select(F.col(id_col).alias("id"), (F.col(label_col) != 0).cast("int").alias("y"))
    chosen = by_label(one_label(marks, "id", "y"), "y", "id", texts_per_label)  # bounded, so it can be broadcast
    keyed = _prepared(docs.withColumn("__id", F.col(id_col)), columns, "__id")
    own = keyed.join(F.broadcast(chosen), F.col("__id") == F.col("id")).select(F.col("id").cast("string").alias("id"), "y", "weight", *keyed.columns[1:])
    sample = _sampled(own)
    rest = by_label(keyed.withColumn("__all", F.lit(1)), "__all", "__id", pool).drop("__all", "weight")
    rest = rest.join(F.broadcast(chosen), F.col("__id") == F.col("id"), "left_anti")
    extra = _sampled(rest.select(F.col("__id").cast("string").alias("id"), F.lit(None).cast("int").alias("y"), F.lit(1.0).alias("weight"), *keyed.columns[1:]))
    shape = lambda rows, of, n: np.array([of(r) for r in rows]).reshape(-1, n)
    return co_train(
        shape(sample, lambda r: r.content, N_TEXT),
        shape(sample, lambda r: r.meta, N_META),
        np.array([r.y for r in sample], float),
        shape(extra, lambda r: r.content, N_TEXT),
        shape(extra, lambda r: r.meta, N_META),
        weight=np.array([r.weight for r in sample], float),
    )


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", columns: tuple[str, str, str, str] = _COLUMNS) -> DataFrame:
    """One row per document: id, score, text_score, meta_score, all probabilities of good quality."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size
    names = [id_col, "score", "text_score", "meta_score"]

    def run(batches):
        for own, content, meta in _features(batches):
            scores = shared.value.score(content, meta)
            yield pa.RecordBatch.from_arrays([own.column(0), *(pa.array(s, pa.float64()) for s in scores)], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    return _prepared(docs, columns, id_col).mapInArrow(run, f"`{id_col}` {kind}, score double, text_score double, meta_score double")
