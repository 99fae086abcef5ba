"""Toxicity: a linear-chain conditional random field tags spans, marginals give scores.

Labels are given for texts only.  Words that are labelled toxic for training
are those of toxic texts whose word, or whose beginning, occurs in toxic texts
far more often than in clean ones; all words of clean texts are labelled clean.
The field learns from them which words, by affixes, n-grams and neighbours, are
toxic.  A text's score comes from its words' marginals through a logistic
function fitted on texts that the field did not learn from, in which each text
counts for as many labelled ones as it stands for in the sample; so scores are
probabilities at the labels' own rates, however many labels there are.

The model is fitted on a bounded sample: about ``texts_per_label`` of each
label, of texts up to ``longest_text`` code points (a longer one has too many
words for its label to say much about any of them).

Defined results: a null text counts as empty; a text without words, and every
text if no labelled text is given, gets the score of a text without evidence;
an id with both labels counts as toxic; repeated rows are scored alike; a very
long text is scored whole, by itself, in memory that grows with its words; an
empty table gives an empty result; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapanel.llm.crf import Crf, FeatureSpace, Scores, in_groups, train, words_of
from terrapanel.llm.linear import logistic, sigmoid
from terrapanel.llm.samples import LONGEST_TEXT, by_label, one_label

TEXTS_PER_LABEL = 1500
#: Bytes of the beginnings that may be evidence, beside whole words.
BEGINNINGS = (5, 6, 7, 8)
#: Evidence is in at least so many toxic texts, and this share of the texts with it is toxic (labels weighted alike).
LEAST_TEXTS, LEAST_SHARE = 4, 0.9
#: Marginal from which a word is part of an offending span.
SPAN_MARGINAL = 0.5
GROUP_WORDS = 100_000

WORDS = re.compile(r"[0-9A-Za-z\u0080-\U0010ffff]+")


def _keys(word: bytes) -> list[bytes]:
    return [word, *(word[:n] + b"*" for n in BEGINNINGS if len(word) > n)]


def evidence(texts: list[list[bytes]], toxic: np.ndarray) -> set[bytes]:
    """Words, and beginnings with a star, that speak for a toxic text."""
    in_toxic, in_clean = Counter(), Counter()
    for words, y in zip(texts, toxic, strict=True):
        (in_toxic if y else in_clean).update({k for w in set(words) for k in _keys(w)})
    weight = toxic.sum() / max(1, (~toxic).sum())
    return {k for k, n in in_toxic.items() if n >= LEAST_TEXTS and n >= LEAST_SHARE * (n + in_clean[k] * weight)}


@dataclass
class ToxicityModel:
    crf: Crf | None
    slope: np.ndarray
    offset: float

    def score(self, summary: np.ndarray) -> np.ndarray:
        return sigmoid(summary @ self.slope + self.offset)


def summaries(marginal: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Of each text: the largest marginal; of the words in spans, the log of the marginals' sum and their share.

    Words outside of spans don't add up, so a text is not toxic for being long.
    """
    out = np.zeros((len(lengths), 3))
    some = np.flatnonzero(lengths > 0)
    if len(some):
        starts = (np.cumsum(lengths) - lengths)[some]
        total = np.add.reduceat(np.where(marginal >= SPAN_MARGINAL, marginal, 0.0), starts)
        out[some] = np.stack([np.maximum.reduceat(marginal, starts), np.log1p(total), total / lengths[some]], axis=1)
    return out


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic", texts_per_label: int = TEXTS_PER_LABEL, longest_text: int = LONGEST_TEXT) -> ToxicityModel:
    """A model from texts and the labels of some of them; null labels are not learned from."""
    marks = labels.select(F.col(id_col).alias("id"), (F.col(toxic_col) != 0).cast("int").alias("toxic"))
    chosen = by_label(one_label(marks, "id", "toxic"), "toxic", "id", texts_per_label)  # bounded, so it can be broadcast
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.length("text").between(1, longest_text))
    rows = rows.join(F.broadcast(chosen), "id")
    shared: dict[bytes, bytes] = {}  # one copy of each word
    sample = []
    for r in rows.toLocalIterator():
        sample.append((r.id, r.toxic, [shared.setdefault(w, w) for w in words_of(r.text.encode())], r.weight))
    sample.sort(key=lambda x: (x[0] is None, x[0], x[2]))
    toxic = np.array([x[1] for x in sample], bool)
    texts = [x[2] for x in sample]
    weight = np.array([x[3] for x in sample])
    if not toxic.any() or toxic.all():
        return ToxicityModel(None, np.zeros(3), 0.0 if not len(toxic) else (4.0 if toxic.all() else -4.0))
    learn = np.arange(len(texts)) % 3 != 0

    def fit(chosen: np.ndarray) -> Crf:
        own = [texts[i] for i in np.flatnonzero(chosen)]
        marks = evidence(own, toxic[chosen])
        bad = {w for t in own for w in t if not marks.isdisjoint(_keys(w))}
        gold = [np.fromiter((y and w in bad for w in t), np.int64, len(t)) for t, y in zip(own, toxic[chosen], strict=True)]
        space = FeatureSpace(ngrams=(3, 4), prefixes=(3, 4, *BEGINNINGS), suffixes=(3, 4), lexicons=(frozenset(w for w in bad if w in marks),))
        return train(["clean", "toxic"], space, own, gold, rounds=25)

    def summary(model: Crf, chosen: np.ndarray) -> np.ndarray:
        out = []
        scores = Scores(model)
        for at in range(0, len(chosen), 200):
            group = [texts[i] for i in chosen[at : at + 200]]
            lengths = np.array([len(t) for t in group], np.int64)
            out.append(summaries(model.marginals(scores.of([w for t in group for w in t]), lengths)[:, 1], lengths))
        return np.concatenate(out)

    held = np.flatnonzero(~learn)
    if len(set(toxic[learn])) < 2 or len(set(toxic[held])) < 2:
        held, learn = np.arange(len(texts)), np.ones(len(texts), bool)
    model = fit(learn)
    slope, offset = logistic(summary(model, held), toxic[held].astype(float), weight=weight[held] / weight[held].mean())
    return ToxicityModel(model, slope, offset)


def _spans(text: str, flags: np.ndarray, marginal: np.ndarray) -> list[dict]:
    """Character offsets of the stretches of flagged words."""
    out: list[dict] = []
    open_at = None
    for n, m in enumerate(WORDS.finditer(text)):
        if n >= len(flags):
            break
        if flags[n]:
            if open_at is None:
                out.append({"start": m.start(), "end": m.end(), "marginal": float(marginal[n])})
            else:
                out[-1] = {"start": out[-1]["start"], "end": m.end(), "marginal": max(out[-1]["marginal"], float(marginal[n]))}
            open_at = n
        else:
            open_at = None
    return out


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", spans: bool = True) -> DataFrame:
    """One row per document: id, score and, if asked for, spans: offending offsets in code points, end exclusive."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size
    names = [id_col, "score", *["spans"] * spans]
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())]))

    def run(batches):
        known = shared.value
        scores = Scores(known.crf) if known.crf else None
        for batch in batches:
            texts = batch.column(1)
            for first, group in in_groups((t.as_py().encode() for t in texts), GROUP_WORDS):
                lengths = np.array([len(t) for t in group], np.int64)
                marginal = known.crf.marginals(scores.of([w for t in group for w in t]), lengths)[:, 1] if known.crf else np.zeros(lengths.sum())
                found = known.score(summaries(marginal, lengths))
                columns = [batch.column(0).slice(first, len(group)), pa.array(found, pa.float64())]
                if spans:
                    own, at = [], 0
                    for n, size in enumerate(lengths):
                        flags = marginal[at : at + size] >= SPAN_MARGINAL
                        own.append(_spans(texts[first + n].as_py(), flags, marginal[at : at + size]) if flags.any() else [])
                        at += size
                    columns.append(pa.array(own, span_type))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, score double" + ", spans array<struct<start: long, end: long, marginal: double>>" * spans)
