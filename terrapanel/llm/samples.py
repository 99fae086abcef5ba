"""Bounded samples of labelled rows for fitting models on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Default bound of a text in a sample, in code points.
LONGEST_TEXT = 20_000
#: Default number of labels that are learned: the most frequent ones.
MOST_LABELS = 256


def fold(id_col, folds: int) -> F.Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


def window_of(text: str, key: str, longest: int) -> F.Column:
    """The text, or of a longer one a stretch of ``longest`` code points that the hash of ``key`` picks."""
    spare = F.greatest(F.length(text) - longest, F.lit(0))
    return F.substring(F.col(text), (F.pmod(F.xxhash64(F.col(key), F.lit(13)), (spare + 1).cast("long")) + 1).cast("int"), F.lit(longest))


def one_label(marks: DataFrame, key: str, label: str) -> DataFrame:
    """One row per key, with the greatest of its labels; a null label counts only if there is no other."""
    return marks.groupBy(key).agg(F.max(label).alias(label))


def by_label(rows: DataFrame, label: str, key: str, per_label: int, most_labels: int = MOST_LABELS, weight: str = "weight") -> DataFrame:
    """About ``per_label`` rows of each label (null labels have none), all of them where there are fewer.

    ``weight``: a new column, how many rows of its label a row stands for.
    Rows are taken by a hash of ``key``, with a threshold for each label that
    follows from its count over all rows; so this needs no sort and gives the
    same rows each time.  ``1.2 * per_label`` rows of each label are expected;
    should one key (say NULL) hold many rows, those with the smallest hashes
    are taken, at most ``2 * per_label`` for each label in the mean.
    """
    counts = rows.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("__label")).agg(F.count("*").alias("__n"))
    most = counts.orderBy(F.desc("__n"), "__label").limit(most_labels)
    shares = {r["__label"]: min(1.0, 1.2 * per_label / r["__n"]) for r in most.collect()}
    point = F.pmod(F.xxhash64(F.col(key), F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    share = F.lit(None).cast("double")
    for value, own in shares.items():
        share = F.when(F.col(label) == value, F.lit(own)).otherwise(share)
    taken = rows.withColumn(weight, 1 / share).where(point < share)
    return taken.orderBy(point, F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns])).limit(2 * per_label * len(shares))
