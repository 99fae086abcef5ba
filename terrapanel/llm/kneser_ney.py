"""A modified Kneser-Ney model of characters, one for each language, counted by Spark over all texts.

Symbols are the code points of a text's words, joined by one blank; those beyond
U+FFFF count as U+FFFD.  Four symbols fit in 64 bits, so an n-gram is a number,
its suffix a mask and its context a shift.  A text begins with three line feeds,
which no word holds.

Tasks count their texts' n-grams in sorted arrays, Spark adds them up.  Counts of
counts give the discounts, numbers of different predecessors the lower orders.
An n-gram has a probability of its own if it stands in two texts at least, so no
text is judged by what it alone holds; the others' share of their context goes to
the next lower order, so all probabilities still add up to 1.

``fit_all_characters`` is the model of the corpus itself, whatever its size: Spark
joins the orders, and each n-gram of four symbols gets its probability as a row of
a table.  Only the frequent ones, at most HELD, are sent to the tasks; the others
are looked up by a join.  ``fit_characters`` is a model for texts from elsewhere,
all of it in memory: it stores n-grams that have one of STORED parts of all
symbols, at most STORED of an order, in two sorted arrays of 64-bit hashes, of
n-grams and of contexts, with a number beside each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapanel.llm.storage import Tables

ORDER, SYMBOL_BITS = 4, 16
START = "\n" * (ORDER - 1)
#: n-grams of an order that can be stored, and languages with a model of their own: those that have such a part of all texts.
STORED, LANGUAGES = 1 << 19, 1024
#: n-grams of the corpus that tasks hold with their probabilities, the frequent ones; all others are joined.
HELD = 1 << 21
#: Log probabilities are whole numbers of such parts, so that a sum doesn't depend on its order; no text is long enough for one that overflows.
LOG_PARTS = 1 << 24
#: n-grams that a task counts before it hands them on, and texts' symbols that are processed together.
COUNTED, GROUP_SYMBOLS = 1 << 21, 1 << 20
KEYS, CONTEXT = ["language", "order", "gram"], ["language", "order", "context"]
#: Discounts where there are too few counts of counts.
DISCOUNTS = (0.5, 1.0, 1.5)


def masked(grams: np.ndarray, order: int) -> np.ndarray:
    """The last ``order`` symbols."""
    return grams & np.uint64((1 << SYMBOL_BITS * order) - 1)


def grams_of(text: bytes) -> np.ndarray:
    """The n-gram that ends at each symbol of a text."""
    line = START + b" ".join(text.split()).decode()
    s = np.frombuffer(line.encode("utf-32-le"), np.uint32).astype(np.uint64)
    s = np.where(s >> np.uint64(SYMBOL_BITS), np.uint64(0xFFFD), s)
    out = s[ORDER - 1 :].copy()
    for k in range(1, ORDER):
        out |= s[ORDER - 1 - k : len(s) - k] << np.uint64(SYMBOL_BITS * k)
    return out


def _summed(keys: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Distinct keys, sorted, and sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return [keys[first], *[np.add.reduceat(v[order], first) if len(first) else v for v in values]]


class _Counts:
    """n-grams of one language and order: how often, and in how many texts."""

    def __init__(self) -> None:
        self.new: list[list[np.ndarray]] = []
        self.waiting = 0

    def add(self, grams: np.ndarray, n: np.ndarray, texts: np.ndarray) -> None:
        self.new.append([grams, n, texts])
        self.waiting += len(grams)
        if self.waiting > COUNTED:
            self.new = [self.sum()]
            self.waiting = len(self.new[0][0])

    def sum(self) -> list[np.ndarray]:
        return _summed(*map(np.concatenate, zip(*self.new, strict=True)))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashed(language: np.ndarray | int, order: int, grams: np.ndarray) -> np.ndarray:
    seed = mixed(np.atleast_1d(np.asarray(language, np.uint64)) * np.uint64(8) + np.uint64(order + 1))
    return mixed(grams ^ seed)


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in sorted keys, and whether the wanted key stands there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


@dataclass(frozen=True)
class CharacterModel:
    """languages: their numbers, from 1 (others have 0); by order: sorted hashes with log probabilities, and of contexts with log weights of the next lower order."""

    languages: dict
    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]
    log_unseen: np.ndarray

    def log_probabilities(self, language: np.ndarray, grams: np.ndarray) -> np.ndarray:
        """Of each n-gram's last symbol, given the others."""
        out, left = np.zeros(len(grams)), np.arange(len(grams))
        for k in range(ORDER, 0, -1):
            own, lang = masked(grams[left], k), language[left]
            keys, values = self.grams[k - 1]
            at, there = _find(keys, hashed(lang, k, own))
            out[left[there]] += values[at[there]] if len(values) else 0.0
            left, own, lang = left[~there], own[~there], lang[~there]
            keys, values = self.contexts[k - 1]
            at, there = _find(keys, hashed(lang, k, own >> np.uint64(SYMBOL_BITS)))
            out[left[there]] += values[at[there]] if len(values) else 0.0
        out[left] += self.log_unseen[language[left]]
        return out

    def log_perplexities(self, languages: list, texts: list[bytes]) -> np.ndarray:
        """Of each text; NaN for texts without a word."""
        numbers = [self.languages.get(lang, 0) for lang in languages]
        out = np.full(len(texts), np.nan)
        at = 0
        while at < len(texts):
            first, size, group = at, 0, []
            while at < len(texts) and size < GROUP_SYMBOLS:
                group.append(grams_of(texts[at]))
                size += len(group[-1])
                at += 1
            lengths = np.array([len(g) for g in group])
            filled = np.flatnonzero(lengths)
            if not len(filled):
                continue
            total = np.zeros(len(group))
            grams, own = np.concatenate(group), np.repeat(np.array(numbers[first:at]), lengths)
            log = np.concatenate([self.log_probabilities(own[i : i + GROUP_SYMBOLS], grams[i : i + GROUP_SYMBOLS]) for i in range(0, len(grams), GROUP_SYMBOLS)])
            total[filled] = np.add.reduceat(log, (np.cumsum(lengths) - lengths)[filled])
            out[first:at][filled] = -total[filled] / lengths[filled]
        return out


def count_grams(rows: DataFrame, languages: dict) -> DataFrame:
    """Rows (language, order, gram, n, texts) of each task, from rows (lang, text)."""
    names = ["language", "order", "gram", "n", "texts"]
    shared = rows.sparkSession.sparkContext.broadcast(languages)  # LANGUAGES entries at most

    def run(batches):
        counts: dict[tuple[int, int], _Counts] = {}

        def all_rows():
            for (lang, k), own in counts.items():
                grams, n, texts = own.sum()
                for at in range(0, len(grams), 1 << 17):
                    part = slice(at, at + (1 << 17))
                    m = len(grams[part])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(m, lang, np.int32)), pa.array(np.full(m, k, np.int32)), pa.array(grams[part].view(np.int64)), pa.array(n[part]), pa.array(texts[part])], names=names)
            counts.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found, n = np.unique(grams_of(text.as_py().encode()), return_counts=True)
                number = shared.value.get(lang, 0)
                for k in range(ORDER, 0, -1):
                    if k < ORDER:
                        found, n = _summed(masked(found, k), n)
                    counts.setdefault((number, k), _Counts()).add(found, n, np.ones(len(found), np.int64))
            if sum(c.waiting for c in counts.values()) > 2 * COUNTED:
                yield from all_rows()
        yield from all_rows()

    return rows.mapInArrow(run, "language int, order int, gram long, n long, texts long")


def _suffix(order: int):
    return F.col("gram").bitwiseAND(F.when(F.col("order") == order + 1, F.lit((1 << SYMBOL_BITS * order) - 1)))


def _discounts(counts: DataFrame) -> DataFrame:
    """Rows (language, order, d1, d2, d3, kinds) from counts of counts; at most LANGUAGES + 1 languages, so they can be broadcast."""
    of = [F.sum((F.col("a") == i).cast("long")).alias(f"n{i}") for i in range(1, 5)]
    n = [None, *[F.col(f"n{i}") for i in range(1, 5)]]
    y = n[1] / (n[1] + 2 * n[2])
    # With too few counts of counts the formula has no value, or one out of place.
    d = [F.when((n[i] > 0) & (n[i + 1] > 0), i - (i + 1) * y * n[i + 1] / n[i]) for i in (1, 2, 3)]
    good = [F.when((x > 0) & (x < i), x).otherwise(F.lit(DISCOUNTS[i - 1])).alias(f"d{i}") for i, x in enumerate(d, 1)]
    return counts.groupBy("language", "order").agg(*of, F.count("*").alias("kinds")).select("language", "order", *good, "kinds")


def _counted(docs: DataFrame, text_col: str, lang_col: str, tables: Tables) -> tuple[dict, DataFrame, int]:
    """Languages' numbers; rows (language, order, gram, n, texts, a), where a is n or the number of different predecessors; the number of symbols."""
    rows = docs.select(F.col(f"`{lang_col}`").alias("lang"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    texts = rows.groupBy("lang").count()
    total = texts.agg(F.sum("count")).first()[0] or 0
    frequent = texts.where(F.col("count") * LANGUAGES >= total).orderBy(F.desc("count"), F.col("lang")).select("lang").collect()
    languages = {r.lang: n for n, r in enumerate(frequent, 1)}

    counted = tables.write(count_grams(rows, languages).groupBy(*KEYS).agg(F.sum("n").alias("n"), F.sum("texts").alias("texts")), "counts")
    symbols = counted.where(F.col("order") == 1).agg(F.sum("n")).first()[0] or 0
    longer = counted.select("language", (F.col("order") - 1).alias("order"), F.coalesce(*[_suffix(k) for k in range(1, ORDER)]).alias("gram"), F.lit(0).alias("n"), F.lit(0).alias("texts"), F.lit(1).alias("a")).where("order > 0")
    own = counted.withColumn("a", F.when(F.col("order") == ORDER, F.col("n")).otherwise(0))
    adjusted = own.unionByName(longer).groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in ("n", "texts", "a")])
    return languages, tables.write(adjusted, "adjusted"), symbols


def _shares(adjusted: DataFrame, stored: F.Column, tables: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """adjusted with each n-gram's context and, of stored ones, its discounted count; the contexts' sums; the discounts."""
    discounts = tables.write(_discounts(adjusted), "discounts")
    less = F.when(F.col("a") == 1, F.col("d1")).when(F.col("a") == 2, F.col("d2")).otherwise(F.col("d3"))
    shares = adjusted.join(F.broadcast(discounts), ["language", "order"]).withColumn("own", F.when(stored, F.greatest(F.lit(0.0), F.col("a") - less)))
    shares = shares.withColumn("context", F.shiftrightunsigned("gram", SYMBOL_BITS))
    contexts = shares.groupBy(*CONTEXT).agg(F.sum("a").alias("all"), F.sum("own").alias("kept"))
    return shares, tables.write(contexts, "contexts"), discounts


def fit_characters(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> CharacterModel:
    """A model of all texts in memory of fixed size; a null language is one like any other."""
    tables = Tables(docs.sparkSession, "characters")
    languages, adjusted, symbols = _counted(docs, text_col, lang_col, tables)
    shares, contexts, discounts = _shares(adjusted, (F.col("n") * STORED >= symbols) & (F.col("texts") > 1), tables)
    contexts = contexts.where("kept IS NOT NULL")
    known = shares.where("own IS NOT NULL").join(contexts, CONTEXT).select(*KEYS, (F.col("own") / F.col("all")).alias("own"))
    model = _assembled(languages, known.toArrow(), contexts.select(*CONTEXT, (1 - F.col("kept") / F.col("all")).alias("rest")).toArrow(), discounts.toArrow())
    tables.remove("counts", "adjusted", "discounts", "contexts")
    return model


@dataclass(frozen=True)
class HeldGrams:
    """languages: their numbers, from 1 (others have 0); by number: the language's frequent n-grams, sorted, and their log probabilities in LOG_PARTS."""

    languages: dict
    frequent: dict[int, tuple[np.ndarray, np.ndarray]]

    def looked_up(self, language: int, grams: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        """The sum over the n-grams that are held; the others, each once, and how often they stand there."""
        if language not in self.frequent:
            return 0, *np.unique(grams, return_counts=True)
        keys, logs = self.frequent[language]
        at, there = _find(keys, grams)
        return int(logs[at[there]].sum()), *np.unique(grams[~there], return_counts=True)


def fit_all_characters(docs: DataFrame, text_col: str, lang_col: str, tables: Tables) -> tuple[HeldGrams, DataFrame]:
    """The model of the corpus: the n-grams that tasks hold, and rows (language, gram, log) of all others.

    No n-gram is left out.  A key of the joins has at most as many rows as there
    are symbols, 2^16.  The second table is "grams" of ``tables``.
    """
    languages, adjusted, symbols = _counted(docs, text_col, lang_col, tables)
    shares, contexts, discounts = _shares(adjusted, F.col("texts") > 1, tables)
    rest = F.when(F.col("kept").isNull(), F.lit(1.0)).otherwise(F.greatest(1 - F.col("kept") / F.col("all"), F.lit(1e-12)))
    share = F.coalesce(F.col("own"), F.lit(0.0)) / F.col("all")
    parts = tables.write(shares.join(contexts, CONTEXT).select(*KEYS, "n", share.alias("share"), rest.alias("rest")), "parts")
    unseen = F.broadcast(discounts.where(F.col("order") == 1).select("language", (1 / (F.col("kinds") + 1)).alias("below")))
    p = parts.where(F.col("order") == 1).join(unseen, "language")
    for k in range(1, ORDER + 1):
        if k > 1:
            lower = p.select("language", F.col("gram").alias("suffix"), F.col("p").alias("below"))
            suffix = F.col("gram").bitwiseAND(F.lit((1 << SYMBOL_BITS * (k - 1)) - 1))
            p = parts.where(F.col("order") == k).withColumn("suffix", suffix).join(lower, ["language", "suffix"])
        p = p.select("language", "gram", "n", (F.col("share") + F.col("rest") * F.col("below")).alias("p"))
    log = F.round(F.log("p") * LOG_PARTS).cast("long")
    held = F.col("n") * HELD >= symbols
    grams = tables.write(p.select("language", "gram", log.alias("log"), held.alias("held")), "grams")
    found = grams.where("held").select("language", "gram", "log").toArrow()  # HELD rows at most
    of, gram, logs = (found.column(c).to_numpy() for c in ("language", "gram", "log"))
    gram = gram.view(np.uint64)
    order = np.lexsort((gram, of))
    of, gram, logs = of[order], gram[order], logs[order]
    numbers, start = np.unique(of, return_index=True)
    ends = np.searchsorted(of, numbers, "right")
    frequent = {int(n): (gram[a:b], logs[a:b]) for n, a, b in zip(numbers, start, ends, strict=True)}
    tables.remove("counts", "adjusted", "discounts", "contexts", "parts")
    return HeldGrams(languages, frequent), grams.where(~F.col("held")).select("language", "gram", "log")


def _assembled(languages: dict, known: pa.Table, contexts: pa.Table, discounts: pa.Table) -> CharacterModel:
    """Probabilities from the lowest order up: a share of their own, and a weight times the next lower order's."""
    get = lambda table, name: table.column(name).to_numpy()
    first = get(discounts, "order") == 1
    kinds = np.zeros(len(languages) + 1)
    kinds[get(discounts, "language")[first]] = get(discounts, "kinds")[first]
    unseen = 1 / (kinds + 1)
    grams, weights, lower = [], [], None
    for k in range(1, ORDER + 1):
        here, there = get(known, "order") == k, get(contexts, "order") == k
        lang, gram = get(known, "language")[here], get(known, "gram")[here].view(np.uint64)
        ctx_keys = hashed(get(contexts, "language")[there], k, get(contexts, "context")[there].view(np.uint64))
        ctx_order = np.argsort(ctx_keys)
        ctx_keys, rest = ctx_keys[ctx_order], np.maximum(get(contexts, "rest")[there][ctx_order], 1e-12)
        at, _ = _find(ctx_keys, hashed(lang, k, gram >> np.uint64(SYMBOL_BITS)))
        if lower is None:
            below = unseen[lang]
        else:  # the suffix of a stored n-gram is stored
            below = lower[1][_find(lower[0], hashed(lang, k - 1, masked(gram, k - 1)))[0]] if len(gram) else np.zeros(0)
        p = get(known, "own")[here] + (rest[at] * below if len(gram) else 0.0)
        keys = hashed(lang, k, gram)
        order = np.argsort(keys)
        lower = keys[order], p[order]
        grams.append((lower[0], np.log(lower[1]).astype(np.float32)))
        weights.append((ctx_keys, np.log(rest).astype(np.float32)))
    return CharacterModel(languages, grams, weights, np.log(unseen))
