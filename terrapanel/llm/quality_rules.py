"""Rules on the quality of texts: measures of repetition and symbols, and bands of perplexity for each language.

Perplexity is that of a character model of the text's own language, counted over
all texts (see ``kneser_ney``).  Tasks hold the frequent n-grams; a text's rare
ones are joined with the table of all others, so each has its own probability.  A language's band lies around the quartiles of
its texts of LEAST_WORDS words or more; texts below it repeat what others say or
themselves, texts above it aren't in their language, or in none.

Defined results: a null text has no words, all measures 0 and no perplexity; a
text without perplexity is rejected by the word rule; a null language is one
like any other; languages with less than 1/1024 of the texts share one model and
one band; repeated rows each have their row, and count as often; texts are read
whole, however long; an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrapanel.llm.kneser_ney import LOG_PARTS, HeldGrams, fit_all_characters, grams_of
from terrapanel.llm.storage import Tables

SYMBOLS = b"#*$%&|<>"
#: The six blanks, and the bytes inside a code point.
NOT_COUNTED = b" \t\n\x0b\x0c\r" + bytes(range(0x80, 0xC0))
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Interquartile ranges beyond the quartiles, and the least width of a band on either side.
BELOW, ABOVE, LEAST_WIDTH = 10.0, 10.0, 0.3
#: Steps of log perplexity in which quartiles are found.
STEPS = 1000

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of three that stand in the text twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    w = np.fromiter([number.setdefault(x, len(number)) for x in words], np.int64, n)
    if len(number) == n:
        return 0
    _, pair = np.unique(w[:-1] * len(number) + w[1:], return_inverse=True)
    _, window, times = np.unique(pair[:-1] * np.int64(len(number)) + w[2:], return_inverse=True, return_counts=True)
    again = np.zeros(n + 2, bool)
    again[2:n] = times[window] > 1
    return int((again[2:] | again[1:-1] | again[:-2])[:n].sum())


def measures(text: bytes) -> tuple[int, ...]:
    """The five of MEASURES."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.split(None, 1)]
    return len(words), len(text.translate(None, NOT_COUNTED)), len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def measure_texts(docs: DataFrame, model: HeldGrams, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Rows (id, language, the five measures, n_grams, log, rare, times), one per document: log is the sum over the n-grams that are held, rare are the others."""
    names = ["id", "language", *MEASURES, "n_grams", "log", "rare", "times"]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of bounded size

    def run(batches):
        known = shared.value
        for batch in batches:
            texts = [t.as_py().encode() for t in batch.column(2)]
            columns = list(zip(*map(measures, texts), strict=True)) or [()] * len(MEASURES)
            number = [known.languages.get(x, 0) for x in batch.column(1).to_pylist()]
            n_grams, log, rare, times = [], [], [], []
            for lang, text in zip(number, texts, strict=True):
                grams = grams_of(text)
                found = known.looked_up(lang, grams)
                n_grams.append(len(grams))
                log.append(found[0])
                rare.append(found[1].view(np.int64))
                times.append(found[2])
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (rare, times)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(number, pa.int32()), *[pa.array(c, pa.int64()) for c in (*columns, n_grams, log)], *lists], names=names)

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{lang_col}`").alias("lang"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, language int, " + ", ".join(f"{m} long" for m in MEASURES) + ", n_grams long, log long, rare array<long>, times array<long>")


def with_perplexity(measured: DataFrame, others: DataFrame) -> DataFrame:
    """measured with log_perplexity, once the rare n-grams of each row (a number) have been joined with the table of all that no task holds."""
    pairs = measured.where(F.size("rare") > 0).select("row", "language", F.explode(F.arrays_zip("rare", "times")).alias("pair"))
    # A rare n-gram has less than one part of HELD of all symbols, so no key is hot.
    found = pairs.select("row", "language", F.col("pair.rare").alias("gram"), F.col("pair.times").alias("times")).join(others, ["language", "gram"])
    sums = found.groupBy("row").agg(F.sum(F.col("times") * found["log"]).alias("more"))
    all_of = F.col("log") + F.coalesce(F.col("more"), F.lit(0))
    log = F.when(F.col("n_grams") > 0, -all_of / LOG_PARTS / F.col("n_grams"))
    return measured.drop("rare", "times").join(sums, "row", "left").select("id", "language", *MEASURES, log.alias("log_perplexity"))


def perplexity_bands(measured: DataFrame, below: float = BELOW, above: float = ABOVE) -> DataFrame:
    """Rows (language, low, high) of log perplexity, from quartiles that are counted in steps."""
    step = F.floor(F.col("log_perplexity") * STEPS)
    counts = measured.where((F.col("n_words") >= LEAST_WORDS) & F.col("log_perplexity").isNotNull()).groupBy("language", step.alias("step")).count()
    of = W.partitionBy("language")  # the steps of a language, some thousands at most
    placed = counts.withColumns({"upto": F.sum("count").over(of.orderBy("step")), "all": F.sum("count").over(of)})
    at = lambda share: F.min(F.when(F.col("upto") >= F.col("all") * share, F.col("step"))) / STEPS
    found = placed.groupBy("language").agg(at(0.25).alias("q1"), at(0.75).alias("q3"))
    width = F.col("q3") - F.col("q1")
    return found.select("language", (F.col("q1") - F.greatest(F.lit(LEAST_WIDTH), below * width)).alias("low"), (F.col("q3") + F.greatest(F.lit(LEAST_WIDTH), above * width)).alias("high"))


def apply_quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", below: float = BELOW, above: float = ABOVE) -> DataFrame:
    """One row per document: id, the five measures, base_failed, log_perplexity, low, high, kept."""
    tables = Tables(docs.sparkSession, "quality-rules")
    model, others = fit_all_characters(docs, text_col, lang_col, tables)
    read = measure_texts(docs, model, id_col, text_col, lang_col).withColumn("row", F.monotonically_increasing_id())
    measured = tables.write(with_perplexity(tables.write(read, "read"), others), "measured")
    tables.remove("grams", "read")
    bands = perplexity_bands(measured, below, above)  # 1,025 languages at most, so they can be broadcast
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    inside = F.coalesce(F.col("log_perplexity").between(F.col("low"), F.col("high")), F.lit(True))
    judged = measured.join(F.broadcast(bands), "language", "left").withColumn("base_failed", failed)
    return judged.select(F.col("id").alias(id_col), *MEASURES, "base_failed", "log_perplexity", "low", "high", (~F.col("base_failed") & inside).alias("kept"))
