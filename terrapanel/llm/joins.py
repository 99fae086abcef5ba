"""Joins whose key may hold a large share of the rows, or whose rows are wide."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot from one such part of all rows on; so at most that many keys are hot, and their table can be broadcast.
HOT_SHARES = 1024
#: Bits of the filter in ``without``; its table has at most FILTER_BITS / 64 rows.
FILTER_BITS = 1 << 24


def unused(columns: list[str], name: str) -> str:
    """The name, with further underscores where a column has it, in whatever case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def by_place(df: DataFrame, *more: F.Column) -> DataFrame:
    """df's columns as c0, c1, ..., for functions of batches that take columns of any name by their place, then further ones."""
    return df.select(*[F.col(f"`{c}`").alias(f"c{n}") for n, c in enumerate(df.columns)], *[c.alias(f"more{n}") for n, c in enumerate(more)])


def join_hot(rows: DataFrame, table: DataFrame, key: str, total: int, count: str = "n") -> DataFrame:
    """``rows`` joined with ``table`` (one row a key) on ``key``; the ``count`` column is dropped.

    ``count`` says how many of the ``total`` rows have the key, or more.  The
    hot keys' part of the table, at most HOT_SHARES rows whatever the input,
    is broadcast; so rows with a hot key never meet in one task.  All other
    keys take an ordinary join.
    """
    hot = F.col(count) * HOT_SHARES >= F.lit(total)
    there = table.where(hot).drop(count)
    rest = table.where(~hot).drop(count)
    return rows.join(F.broadcast(there), key).unionByName(rows.join(rest, key))


def text_mark(text: F.Column) -> F.Column:
    """A 64-bit digest of the text as it is; null counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")).cast("binary"))


def _marked(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, F.Column]:
    """docs as "d" with a filter's words as "w", and whether a row may be in ``gone``."""
    place = lambda i, m: F.pmod(F.xxhash64(i, m), F.lit(FILTER_BITS))
    bit = lambda p: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(p, F.lit(64)).cast("int"))
    at = place(F.col("doc_id"), F.col("mark"))
    words = gone.select(F.floor(at / 64).alias("word"), bit(at).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    here = place(F.col(f"d.`{id_col}`"), text_mark(F.col(f"d.`{text_col}`")))
    both = docs.alias("d").join(F.broadcast(words).alias("w"), F.floor(here / 64) == F.col("w.word"), "left")
    return both, F.coalesce(F.col("w.bits").bitwiseAND(bit(here)) != 0, F.lit(False))


def without(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str, once: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` whose id and text mark are not in ``gone`` (doc_id, mark).

    Rows of ``docs`` are wide, so only those that a filter of fixed size lets
    through are shuffled: the ones that go, and the few whose bit is set by
    chance.  The filter's table is bounded whatever the input; when it is full
    all rows are shuffled, once.  Of rows in ``once`` (doc_id, mark), which
    repeat both id and text, one stays.
    """
    both, maybe = _marked(docs, gone, id_col, text_col)
    columns = [F.col(f"d.`{c}`") for c in docs.columns]
    same = (F.col(f"d.`{id_col}`").eqNullSafe(F.col("g.doc_id"))) & (text_mark(F.col(f"d.`{text_col}`")) == F.col("g.mark"))
    kept = both.where(~maybe).select(*columns)
    kept = kept.unionByName(both.where(maybe).select(*columns).alias("d").join(gone.alias("g"), same, "left_anti"))
    if once is not None:
        found = both.where(maybe).select(*columns).alias("d").join(once.alias("g"), same).groupBy("g.doc_id", "g.mark")
        row = F.min_by(F.struct(*columns), F.xxhash64(*columns))
        kept = kept.unionByName(found.agg(row.alias("row")).select("row.*"))
    return kept
