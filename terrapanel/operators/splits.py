"""Leakage-safe splits: contiguous clusters held out by distance, moats around them, labels for units and buildings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrapanel.functions.numeric import last_label_wins
from terrapanel.functions.quantiles import ordered_counts, written
from terrapanel.functions.seeded import order_key, weighted_key
from terrapanel.operators.geometry import box_distance, mean_side, spatial_join
from terrapanel.operators.polygons import near_pairs
from terrapanel.sources.scratch import folder

BOX = ("minx", "miny", "maxx", "maxy")


def neighbours(tracts: DataFrame, id_col: str, radius: float, parts: str | None = None) -> DataFrame:
    """Pairs (a, b) of tracts that are within the radius of each other, each tract with itself included.

    Distances are those of the polygons in the column ``parts``, or else of the boxes.
    """
    if parts is not None:
        own = lambda name: tracts.select(F.col(id_col).alias(name), F.col(parts).alias(f"{name}_parts"))
        return near_pairs(own("a"), own("b"), "a", "b", "a_parts", "b_parts", radius).select("a", "b")
    grown = tracts.select(F.col(id_col).alias("a"), *[F.col(c).alias(f"a_{c}") for c in BOX], *[(F.col(c) + (radius if c[:3] == "max" else -radius)).alias(f"g_{c}") for c in BOX])
    other = tracts.select(F.col(id_col).alias("b"), *[F.col(c).alias(f"b_{c}") for c in BOX])
    near = box_distance({c: F.col(f"a_{c}") for c in BOX}, {c: F.col(f"b_{c}") for c in BOX}) <= radius
    cell = max(radius, 1e-9) * 4
    return spatial_join(grown, other, "a", "b", tuple(f"g_{c}" for c in BOX), tuple(f"b_{c}" for c in BOX), cell, near).select("a", "b")


def hold_out(tracts: DataFrame, pairs: DataFrame, id_col: str, stratum: str, weight: str, share: float, seed: int, banned: DataFrame | None = None) -> DataFrame:
    """Ids of clusters around weighted random seeds, until each stratum has its share.

    Seeds come in the order of weighted keys.  A seed's cluster is all tracts
    near it.  How many seeds a stratum needs follows from one pass: a tract is
    new with the first seed that reaches it, so a running count over seeds tells
    when the share is reached; no loop over tracts runs on the driver.
    """
    open_ = tracts if banned is None else tracts.join(banned.select(F.col("id").alias(id_col)), id_col, "left_anti")
    keyed = open_.withColumn("__key", weighted_key(F.col(weight), seed, F.col(id_col))).where("__key IS NOT NULL")
    seeds = keyed.select(F.col(id_col).alias("a"), F.col(stratum).alias("stratum"), "__key")
    reach = pairs.join(seeds, "a").join(open_.select(F.col(id_col).alias("b"), F.col(stratum).alias("own")), "b")
    first = reach.where("own = stratum").groupBy("stratum", "b").agg(F.min("__key").alias("__key"))
    need = open_.groupBy(F.col(stratum).alias("stratum")).agg((F.count("*") * share).alias("need"))
    gain = first.groupBy("stratum", "__key").agg(F.count("*").alias("gain"))
    before = F.coalesce(F.sum("gain").over(W.partitionBy("stratum").orderBy("__key").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    used = gain.withColumn("before", before).join(need, "stratum").where("before < need").select("stratum", "__key")
    return reach.join(used, ["stratum", "__key"]).select(F.col("b").alias("id")).distinct()


def label_tracts(tracts: DataFrame, id_col: str, test: DataFrame, val: DataFrame, moat: DataFrame) -> DataFrame:
    """tracts with ``type``: test, val, dead_zone (within the moat of either) or train."""
    flag = lambda ids, name: ids.select(F.col("id").alias(id_col)).distinct().withColumn(name, F.lit(True))
    near = moat.join(test.unionByName(val).select(F.col("id").alias("a")).distinct(), "a", "left_semi").select(F.col("b").alias("id"))
    own = tracts.join(flag(test, "__t"), id_col, "left").join(flag(val, "__v"), id_col, "left").join(flag(near, "__n"), id_col, "left")
    rules = [(F.col("__n"), "dead_zone"), (F.col("__v"), "val"), (F.col("__t"), "test")]
    return own.withColumn("type", last_label_wins(rules, "train")).drop("__t", "__v", "__n")


def split_tracts(tracts: DataFrame, id_col: str, stratum: str, weight: str, radius: float, moat: float, share: float, seed: int, parts: str | None = None) -> DataFrame:
    """Test clusters, then validation clusters away from them, then a moat around both; the rest is for training.

    The pairs of near tracts are used several times, so they are written once.
    """
    spark, base = tracts.sparkSession, folder(tracts.sparkSession, "neighbours")
    found = []
    for name, near in (("cluster", radius), ("moat", moat)):
        neighbours(tracts, id_col, near, parts).write.parquet(f"{base}/{name}")
        found.append(spark.read.parquet(f"{base}/{name}"))
    pairs, wide = found
    test = hold_out(tracts, pairs, id_col, stratum, weight, share, seed)
    near_test = wide.join(test.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id")).distinct()
    val = hold_out(tracts, pairs, id_col, stratum, weight, share, seed + 1, banned=near_test)
    val = val.join(near_test, "id", "left_anti").join(test, "id", "left_anti")
    return label_tracts(tracts, id_col, test, val, wide)


def building_type(in_test: Column, in_val: Column, touches_held_out: Column, test_year: Column, optional: Column | None = None, legacy: bool = False) -> Column:
    """train, val_spatial, val_time, test or dead_zone of a building in a year.

    ``legacy`` gives the precedence in which dead_zone, as everything that is
    neither held out nor test, is written last and so hides train.
    """
    o = F.lit(False) if optional is None else optional
    val_time, val_spatial = test_year & in_val, in_val & ~test_year
    test = (in_test | test_year | o) & ~in_val
    train = ~touches_held_out & ~test & ~in_val
    rules = [(train, "train"), (test, "test"), (val_spatial, "val_spatial"), (val_time, "val_time")]
    return last_label_wins([*rules, (~test & ~in_val, "dead_zone")] if legacy else rules, "dead_zone")


def box_hold_out(tracts: DataFrame, id_col: str, boxes: DataFrame, share: float, seed: int) -> DataFrame:
    """Ids of tracts in random boxes, taken in a seeded order until they hold the share of all tracts.

    ``boxes`` has box_id, minx, miny, maxx, maxy.  A tract counts with the first
    box that touches it, so one running sum over the boxes tells where to stop.
    """
    own = tracts.select(F.col(id_col).alias("id"), *[F.col(c).alias(f"t_{c}") for c in BOX])
    # Of equal boxes only the first can be a tract's first; places are numbers, whose minimum needs no sort of all hits.
    ordered = boxes.groupBy(*BOX).agg(F.min(order_key(seed, F.col("box_id"))).alias("__order"), F.lit(1).alias("__all"))
    ordered = written(ordered, "boxes")
    places = ordered_counts(ordered, "__order", ["__all"]).select("__order", F.col("__before").alias("__place"))
    placed = ordered.join(places, "__order").select("__place", *[F.col(c).alias(f"b_{c}") for c in BOX])
    hits = spatial_join(own, placed, "id", "__place", tuple(f"t_{c}" for c in BOX), tuple(f"b_{c}" for c in BOX), mean_side(ordered, BOX))
    first = written(hits.groupBy("id").agg(F.min("__place").alias("__place")).withColumn("__all", F.lit(1)), "first-boxes")
    need = tracts.agg((F.count("*") * share).alias("need"))
    used = ordered_counts(first, "__place", ["__all"]).crossJoin(F.broadcast(need)).where(F.col("__before") < F.col("need")).select("__place")
    return first.join(used, "__place", "left_semi").select("id")
