"""Mixing sources to target weights by hierarchical budgeting.

A token budget is handed down a tree of domains, languages and sources.  At
each node the children share the node's budget by weight; a child that can't
use its share (its subtree has too few tokens, even repeated ``max_epochs``
times) gets what it can use, and its siblings share the rest by weight.  Only
what a whole node can't use goes to the node's own siblings.  Each leaf then
takes its tokens from seeded epochs: whole ones, and of the last one the prefix
of a seeded order whose tokens fit.

Nothing of the tree comes to the driver: shares are window sums over the
children, sorted by how soon they are full.  A leaf's prefix is found in two
steps, over sums of buckets of its order and inside the one bucket in which it
ends; so no leaf is sorted as a whole, and the texts are never shuffled.

Defined results: null and unlisted domains, languages and sources are children
like any other, with the default weight; texts that are null or have no words
have no tokens and are taken with any epoch that is taken as a whole, or up to
the end of the prefix; repeated rows stand together in the order and are taken
or left together; a very long text is one row with its count of words, which is
taken only if it fits as a whole; an empty table or a budget of 0 gives an empty
result; other columns are carried along, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrapanel.llm.joins import unused
from terrapanel.llm.storage import Tables

LEVELS = ("domain", "lang", "source")
BUCKET_BITS = 10
#: Leaves up to which their table is broadcast, and salts of the join beyond that.
LARGEST_BROADCAST, SALTS = 20_000, 64


@dataclass(frozen=True)
class Mix:
    """Weights of children by name, for each level; the budget as a share of all tokens."""

    budget: float
    domain: dict[str, float] = field(default_factory=dict)
    lang: dict[str, float] = field(default_factory=dict)
    source: dict[str, float] = field(default_factory=dict)
    default_weight: float = 1.0
    max_epochs: float = 1.0
    seed: int = 0


def count_words(text: F.Column) -> F.Column:
    """Maximal runs of characters other than ASCII white space; the measure of tokens."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _weight(weights: dict[str, float], name: F.Column, default: float) -> F.Column:
    if not weights:
        return F.lit(float(default))
    if min(weights.values()) < 0:
        raise ValueError("weights can't be negative")
    listed = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))])
    return F.coalesce(listed[F.coalesce(name, F.lit(""))], F.lit(float(default)))


def share(children: DataFrame, parent: list[str], budget: str, weight: str, room: str) -> DataFrame:
    """children with ``given``: their part of the parent's budget, by weight, never more than their room.

    Children are sorted by room for each weight.  One is full if what those
    before it leave would give it, by weight, at least its room.
    """
    by = W.partitionBy(*parent)
    ready = F.when(F.col(weight) > 0, F.col(room) / F.col(weight)).otherwise(float("inf"))
    order = by.orderBy("__ready", *[c for c in LEVELS if c in children.columns])
    return (
        children.withColumn("__ready", ready)
        .withColumn("__before", F.coalesce(F.sum(room).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("__weight", F.sum(weight).over(order.rowsBetween(W.currentRow, W.unboundedFollowing)))
        .withColumn("__level", F.when(F.col("__weight") > 0, (F.col(budget) - F.col("__before")) / F.col("__weight")))
        .withColumn("__full", F.coalesce(F.col("__level") >= F.col("__ready"), F.lit(False)))
        .withColumn("__rest", F.coalesce(F.min(F.when(~F.col("__full"), F.struct("__ready", "__level"))).over(by)["__level"], F.lit(0.0)))
        .withColumn("given", F.when(F.col("__full"), F.col(room)).otherwise(F.least(F.col(room), F.greatest(F.lit(0.0), F.col("__rest")) * F.col(weight))))
        .drop("__ready", "__before", "__weight", "__level", "__full", "__rest")
    )


def leaf_budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """leaves (domain, lang, source, tokens) with ``given``: the tokens to take from each."""
    room = leaves.withColumn("room", F.col("tokens") * F.lit(float(mix.max_epochs)))
    known = None
    for depth in (1, 2, 3):
        keys = list(LEVELS[:depth])
        level = room.groupBy(*keys).agg(F.sum("room").alias("room"), F.sum("tokens").alias("tokens"))
        level = level.withColumn("weight", _weight(getattr(mix, keys[-1]), F.col(keys[-1]), mix.default_weight))
        if known is None:
            total = leaves.agg((F.coalesce(F.sum("tokens"), F.lit(0)) * F.lit(float(mix.budget))).alias("budget"))
            level = level.join(F.broadcast(total))  # one row
        else:
            up = known.select(*[F.col(c).alias(f"up_{c}") for c in keys[:-1]], F.col("given").alias("budget"))
            same = [F.col(c).eqNullSafe(F.col(f"up_{c}")) for c in keys[:-1]]
            condition = same[0]
            for x in same[1:]:
                condition = condition & x
            level = level.join(up, condition).drop(*[f"up_{c}" for c in keys[:-1]])
        known = share(level, keys[:-1], "budget", "weight", "room").drop("budget")
    return known.select(*LEVELS, "tokens", "weight", "given")


def _order(mix: Mix, epoch: F.Column, key: F.Column) -> F.Column:
    """A number of 63 bits: the place of a document in an epoch."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(mix.seed), epoch, key), 1)


def _same_leaf(a: str, b: str) -> F.Column:
    out = F.lit(True)
    for c in LEVELS:
        out = out & F.col(f"{a}.__{c}").eqNullSafe(F.col(f"{b}.__{c}"))
    return out


def _with_leaf(rows: DataFrame, leaves: DataFrame, how: str = "inner") -> DataFrame:
    """rows (alias s) joined with leaf rows (alias b).

    Leaf rows are broadcast if there are at most LARGEST_BROADCAST of them.
    Otherwise rows are salted and leaf rows repeated, since one leaf may hold a
    third of all rows.
    """
    if leaves.count() <= LARGEST_BROADCAST:
        return rows.alias("s").join(F.broadcast(leaves).alias("b"), _same_leaf("s", "b"), how)
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64("__key"), F.lit(SALTS)))
    repeated = leaves.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.alias("s").join(repeated.alias("b"), _same_leaf("s", "b") & (F.col("s.__salt") == F.col("b.__salt")), how)


def mix_sources(docs: DataFrame, mix: Mix, domain: F.Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of docs that are taken, once for each epoch, with all their columns, then their domain and epoch.

    The last two columns are ``__domain`` and ``__epoch``, with further
    underscores where docs have such columns.
    """
    key = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{n}") for n, c in enumerate(docs.columns)])  # so no name of docs meets one of these
    keyed = docs.select(row.alias("row"), F.col(f"`{text_col}`").alias("text"), domain.alias("__domain"), F.col(f"`{lang_col}`").alias("__lang"), F.col(f"`{source_col}`").alias("__source"), key.alias("__key"))
    own, tables = ["__domain", "__lang", "__source"], Tables(docs.sparkSession, "mix")
    slim = tables.write(keyed.select(*own, "__key", count_words(F.col("text")).alias("tokens")), "tokens")
    leaves = slim.groupBy(*[F.col(f"__{c}").alias(c) for c in LEVELS]).agg(F.sum("tokens").alias("tokens"))
    budgets = leaf_budgets(leaves, mix).where("tokens > 0 AND given > 0")
    whole = F.floor(F.col("given") / F.col("tokens") + F.lit(1e-12)).cast("int")
    budgets = tables.write(
        budgets.withColumn("whole", whole)
        .withColumn("rest", F.greatest(F.lit(0.0), F.col("given") - F.col("whole") * F.col("tokens")))
        .select(*[F.col(c).alias(f"__{c}") for c in LEVELS], "whole", "rest"),
        "budgets",
    )
    # The last epoch's order, in buckets.
    placed = _with_leaf(slim, budgets.where("rest > 0")).select(*[f"s.{c}" for c in slim.columns], "whole", "rest")
    placed = placed.withColumn("place", _order(mix, F.col("whole"), F.col("__key"))).withColumn("bucket", F.shiftrightunsigned("place", 63 - BUCKET_BITS))
    sums = placed.groupBy(*own, "bucket", "rest").agg(F.sum("tokens").alias("tokens"))
    upto = F.sum("tokens").over(W.partitionBy(*own).orderBy("bucket"))
    ends = tables.write(
        sums.withColumn("upto", upto).where("upto > rest").groupBy(*own, "rest").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("tokens")).alias("before"))).alias("at")).select(*own, "rest", "at.*"),
        "ends",
    )
    placed = placed.drop("rest")
    inside = _with_leaf(placed, ends).where("s.bucket = b.bucket").select(*[f"s.{c}" for c in placed.columns], "b.rest", "b.before")
    peers = W.partitionBy(*own).orderBy(F.struct("place", "__key"))
    running = F.col("before") + F.sum("tokens").over(peers)
    cut = inside.withColumn("running", running).where("running <= rest").groupBy(*own).agg(F.max(F.struct("place", "__key")).alias("cut"))
    # A leaf without a row in its last bucket that fits ends at the bucket's begin.
    first = F.struct(F.shiftleft(F.col("b.bucket"), 63 - BUCKET_BITS).alias("place"), F.lit("").alias("__key"))
    cuts = ends.alias("b").join(cut.alias("c"), _same_leaf("b", "c"), "left").select(*[f"b.{c}" for c in own], F.coalesce(F.col("c.cut"), first).alias("cut"), F.col("c.cut").isNotNull().alias("has"))
    plan = tables.write(budgets.alias("b").join(cuts.alias("c"), _same_leaf("b", "c"), "left").select("b.*", "cut", "has"), "plan")
    tables.remove("tokens", "budgets", "ends")
    place = _order(mix, F.col("b.whole"), F.col("s.__key"))
    here = F.struct(place.alias("place"), F.col("s.__key").alias("__key"))
    in_last = (F.col("b.rest") > 0) & (F.col("b.cut").isNull() | (here < F.col("b.cut")) | (F.col("b.has") & (here == F.col("b.cut"))))
    epochs = F.concat(
        F.when(F.col("b.whole") > 0, F.sequence(F.lit(0), F.col("b.whole") - 1)).otherwise(F.array().cast("array<int>")),
        F.when(F.coalesce(in_last, F.lit(False)), F.array("b.whole")).otherwise(F.array().cast("array<int>")),
    )
    chosen = _with_leaf(keyed.drop("text"), plan).select("s.row", F.col("s.__domain"), F.explode(epochs).alias("epoch"))
    own = [F.col(f"row.c{n}").alias(c) for n, c in enumerate(docs.columns)]
    return chosen.select(*own, F.col("__domain").alias(unused(docs.columns, "__domain")), F.col("epoch").alias(unused(docs.columns, "__epoch")))
