"""Exact de-duplication with a heavy-hitter split.

Digests of normalised texts are summarised with Misra-Gries counters.  The few
digests that may hold a large share of all rows are counted exactly, and the
winning row of each is broadcast, so that their rows are decided map-side and
never meet in one task.  All other digests go through an ordinary shuffle.

Defined results: a null text counts as empty; texts that are white space only
are equal to the empty text; a null id sorts after every other id; rows that
repeat both id and text are one group, of which one row is kept; an empty table
gives an empty result; a very long text is digested where it is, whole; other
columns are ignored, or kept where rows are dropped, whatever their names.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapanel.llm.joins import text_mark, without
from terrapanel.llm.storage import Tables

WHITE_SPACE = " \t\n\x0b\x0c\r"

#: Counters per Misra-Gries summary.  At most this many digests are candidates,
#: and the broadcast table has at most COUNTERS / 2 rows whatever the input.
COUNTERS = 1024


def text_digest(text) -> F.Column:
    """Lowercase hex SHA-256 of the text without its ASCII white space."""
    return F.sha2(F.translate(F.coalesce(text, F.lit("")), WHITE_SPACE, ""), 256)


def _shrink(counts: Counter, counters: int) -> Counter:
    """The Misra-Gries step for a merged summary: subtract the first count that has no room."""
    if len(counts) <= counters:
        return counts
    least = sorted(counts.values(), reverse=True)[counters]
    return Counter({k: v - least for k, v in counts.items() if v > least})


def misra_gries(keys: DataFrame, column: str, counters: int = COUNTERS) -> DataFrame:
    """Rows ``(column, estimate)``: a summary for each partition, added up by key.

    Summaries can be merged: a key's estimate is below its true count by at
    most ``rows / (counters + 1)`` and never above it.
    """

    def summarise(batches):
        counts: Counter = Counter()
        for batch in batches:
            both = batch.column(0).value_counts()
            counts.update(dict(zip(both.field(0).to_pylist(), both.field(1).to_pylist(), strict=True)))
            counts = _shrink(counts, counters)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts.keys()), pa.string()), pa.array(list(counts.values()), pa.int64())],
            names=["key", "estimate"],
        )

    return (
        keys.select(F.col(column).alias("key"))
        .mapInArrow(summarise, "key string, estimate long")
        .groupBy("key")
        .agg(F.sum("estimate").alias("estimate"))
        .withColumnRenamed("key", column)
    )


def _decided(docs: DataFrame, id_col: str, text_col: str, counters: int, tables: Tables) -> DataFrame:
    """Slim rows, one per document: doc_id, mark, keep_id, group_size, kept, text_sha256."""
    digests = tables.write(
        docs.select(
            F.col(id_col).alias("doc_id"),
            text_digest(F.col(text_col)).alias("text_sha256"),
            text_mark(F.col(text_col)).alias("mark"),
            F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("n_points"),
            F.monotonically_increasing_id().alias("row_no"),
        ),
        "digests",
    )
    rows = digests.count()
    # What is found here has an estimate of at least rows / counters, so there are at most ``counters`` of them.
    candidates = misra_gries(digests, "text_sha256", counters).where(F.col("estimate") * counters >= rows)
    # Smallest of these: most code points, then smallest id, nulls last.
    order = F.struct(
        (-F.col("n_points")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("c"), F.col("row_no").alias("d")
    )
    groups = lambda rows: rows.groupBy("text_sha256").agg(F.count("*").alias("group_size"), F.min(order).alias("best"))
    named = lambda groups: groups.select("text_sha256", "group_size", F.col("best.c").alias("keep_id"), F.col("best.d").alias("keep_row"))
    frequent = digests.join(F.broadcast(candidates.select("text_sha256")), "text_sha256", "left_semi")
    winners = tables.write(named(groups(frequent).where(F.col("group_size") * counters >= 2 * rows)), "winners")
    heavy = digests.join(F.broadcast(winners), "text_sha256")
    light = digests.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti")
    # Counts are combined before the shuffle; most texts stand alone and are in no group.
    repeated = named(groups(light).where("group_size > 1"))
    light = light.join(repeated, "text_sha256", "left")
    alone = F.col("keep_row").isNull()
    light = light.select(
        *digests.columns,
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("keep_row", "row_no").alias("keep_row"),
    )
    both = heavy.select(*light.columns).unionByName(light)
    return both.select("doc_id", "mark", "keep_id", "group_size", (F.col("row_no") == F.col("keep_row")).alias("kept"), "text_sha256")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the most code points in the original text, then
    with the smallest id, is kept.
    """
    found = _decided(docs, id_col, text_col, counters, Tables(docs.sparkSession, "exact-dedup"))
    return found.select(F.col("doc_id").alias(id_col), "keep_id", "group_size", "kept", "text_sha256")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    What goes is found from digests; the wide rows are shuffled only where
    they may go.  Of rows that repeat both id and text but differ in other
    columns, the one with the smallest hash of all columns stays.
    """
    tables = Tables(docs.sparkSession, "exact-dedup")
    decided = tables.write(_decided(docs, id_col, text_col, counters, tables), "decided")
    tables.remove("digests", "winners")
    gone = decided.where("NOT kept").select("doc_id", "mark").distinct()
    # Kept rows of which an equal one goes.
    kept = decided.where("kept AND group_size > 1").select("doc_id", "mark").alias("k")
    once = kept.join(gone.alias("g"), F.expr("k.doc_id <=> g.doc_id AND k.mark = g.mark"), "left_semi")
    once = tables.write(once.distinct(), "repeated")
    return without(docs, gone, id_col, text_col, once if once.count() else None)
