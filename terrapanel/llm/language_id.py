"""Language identification with a linear-chain conditional random field.

Words are labelled with languages by forward-backward, from affix, n-gram and
lexicon features and learned transitions; so a text that switches between
languages gets a label for each stretch.  The words' marginals, added up, give
the text's language and its score.

The model is fitted on a bounded sample of labelled texts: about
``texts_per_language`` of each language.  Some of them are cut and joined into
code-switched training sequences, which teach the transitions.

Defined results: a text that is null or has no letter gets ``und`` with score
0; so does every text if no labelled text is given; of languages with equal
shares of a text the first in alphabetical order is given; repeated rows are
labelled alike; a very long text is labelled whole, by itself, in one pass
whose memory grows with its words; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapanel.llm.crf import Crf, FeatureSpace, Scores, in_groups, train, words_of
from terrapanel.llm.joins import by_place
from terrapanel.llm.samples import LONGEST_TEXT, MOST_LABELS, by_label, window_of

UNKNOWN = "und"
TEXTS_PER_LANGUAGE = 120
#: A word is in a language's lexicon if it is in that many of its sample's texts.
LEXICON_TEXTS = 5
#: Words that are labelled together.
GROUP_WORDS = 100_000

LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    return any(m.group().isalpha() for m in LETTER.finditer(text))


def fit_languages(
    labelled: DataFrame,
    id_col: str,
    text_col: str,
    lang_col: str,
    texts_per_language: int = TEXTS_PER_LANGUAGE,
    most_languages: int = MOST_LABELS,
    longest_text: int = LONGEST_TEXT,
) -> Crf | None:
    """A model from (id, text, language) rows; None if there is nothing to learn from.

    The sample's bounds: about ``texts_per_language`` texts of each of the
    ``most_languages`` most frequent languages, and of a longer text a stretch
    of ``longest_text`` code points.
    """
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(F.length("text") > 0)
    chosen = by_label(rows, "lang", "id", texts_per_language, most_languages).select("lang", window_of("text", "id", longest_text).alias("text"))
    sample = sorted((r.lang, words_of(r.text.encode())) for r in chosen.collect() if has_letter(r.text))
    if not sample:
        return None
    languages = sorted({lang for lang, _ in sample})
    number = {lang: n for n, lang in enumerate(languages)}
    counts = [Counter() for _ in languages]
    for lang, words in sample:
        counts[number[lang]].update(set(words))
    lexicons = tuple(frozenset(w for w, n in c.items() if n >= LEXICON_TEXTS) for c in counts)
    rng = np.random.default_rng(11)
    texts, gold, pieces = [], [], []
    for lang, words in sample:
        texts.append(words)
        gold.append(np.full(len(words), number[lang]))
        for _ in range(2):
            at = int(rng.integers(0, max(1, len(words))))
            pieces.append((words[at : at + int(rng.integers(3, 40))], number[lang]))
    rng.shuffle(pieces) if len(pieces) > 1 else None
    for at in range(0, len(pieces), 4):
        mixed = pieces[at : at + 4]
        texts.append([w for words, _ in mixed for w in words])
        gold.append(np.concatenate([np.full(len(words), n) for words, n in mixed]))
    return train(languages, FeatureSpace(lexicons=lexicons), texts, gold)


def _runs(labels: np.ndarray, names: list[str]) -> list[dict]:
    if not len(labels):
        return []
    starts = np.concatenate([[0], np.flatnonzero(np.diff(labels)) + 1])
    sizes = np.diff(np.append(starts, len(labels)))
    return [{"lang": names[labels[s]], "start": int(s), "words": int(n)} for s, n in zip(starts, sizes, strict=True)]


def label_languages(docs: DataFrame, model: Crf | None, id_col: str = "doc_id", text_col: str = "text", runs: bool = True) -> DataFrame:
    """One row per document: id, lang_pred, score and, if asked for, runs: the stretches of one language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: the feature space times the languages
    names = [id_col, "lang_pred", "score", *["runs"] * runs]
    run_type = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("words", pa.int64())]))

    def label(batches):
        known = shared.value
        scores = Scores(known) if known else None
        for batch in batches:
            texts = batch.column(1)
            for first, group in in_groups((t.as_py().encode() for t in texts), GROUP_WORDS):
                langs, best, stretches = [], [], []
                lengths = np.array([len(t) for t in group], np.int64)
                marginals = known.marginals(scores.of([w for t in group for w in t]), lengths) if known else None
                at = 0
                for n, size in enumerate(lengths):
                    if known and size and has_letter(texts[first + n].as_py()):
                        own = marginals[at : at + size]
                        share = own.mean(axis=0)
                        langs.append(known.labels[share.argmax()])
                        best.append(min(1.0, float(share.max())))
                        stretches.append(_runs(own.argmax(axis=1), known.labels) if runs else None)
                    else:
                        langs.append(UNKNOWN)
                        best.append(0.0)
                        stretches.append([] if runs else None)
                    at += size
                columns = [batch.column(0).slice(first, len(group)), pa.array(langs, pa.string()), pa.array(best, pa.float64())]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array(stretches, run_type)] * runs], names=names)

    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(label, f"`{id_col}` {kind}, lang_pred string, score double" + ", runs array<struct<lang: string, start: long, words: long>>" * runs)


def keep_known_languages(docs: DataFrame, model: Crf | None, id_col: str = "doc_id", text_col: str = "text", least_confidence: float = 0.5) -> DataFrame:
    """The rows whose text is in known languages, with all their columns.

    A text is rejected if it has no letter, or if its words can't be told: the
    mean of each word's largest marginal is below ``least_confidence``.  A text
    that switches between known languages is thus kept, whatever its mixture.
    Without a model nothing is rejected.
    """
    if model is None:
        return docs
    shared, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns

    def keep(batches):
        scores = Scores(shared.value)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            wanted = []
            for first, group in in_groups((t.as_py().encode() for t in texts), GROUP_WORDS):
                lengths = np.array([len(t) for t in group], np.int64)
                marginals = shared.value.marginals(scores.of([w for t in group for w in t]), lengths)
                at = 0
                for n, size in enumerate(lengths):
                    known = size and marginals[at : at + size].max(axis=1).mean() >= least_confidence
                    wanted.append(bool(known) and has_letter(texts[first + n].as_py()))
                    at += size
            yield pa.RecordBatch.from_arrays(batch.columns[:-1], names=names).filter(pa.array(wanted, pa.bool_()))

    return by_place(docs, F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).mapInArrow(keep, docs.schema)
