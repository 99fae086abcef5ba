"""Connected components of a link table, by alternating stars.

A node with very many links (a hub) is a hot key of every join here; its part
of each table is broadcast, see ``join_hot``.

Links (u, v) always have u > v.  Rounds end as soon as all components are stars,
so no round is run only to see that it changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapanel.llm.joins import join_hot
from terrapanel.llm.storage import Tables


def _smaller_neighbour(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))


def _large_star(links: DataFrame, total: int) -> DataFrame:
    """Hang every larger neighbour of a node under the node's smallest neighbour."""
    larger = links.select(F.col("v").alias("u"), F.col("u").alias("v"))
    least = _smaller_neighbour(links.unionByName(larger)).select("u", F.least("u", "m").alias("m"), "n")
    return join_hot(larger, least, "u", 2 * total).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(links: DataFrame, total: int) -> DataFrame:
    """Hang the smaller neighbours of a node, and the node, under the smallest of them."""
    least = _smaller_neighbour(links)
    hung = join_hot(links, least, "u", total).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _state(links: DataFrame) -> tuple[int, int]:
    """The number of links, and of nodes that have two smaller neighbours, or smaller and larger ones."""
    ends = links.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("down")), F.struct(F.col("v").alias("node"), F.lit(0).alias("down")))).alias("end"))
    of = ends.groupBy("end.node").agg(F.sum("end.down").alias("down"), F.count("*").alias("n"))
    row = of.agg(F.sum("down"), F.count_if((F.col("down") > 0) & (F.col("n") > 1))).first()
    return row[0] or 0, row[1]


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows ``(node, root)`` for every node that is not the smallest of its component.

    ``links`` has two columns of one orderable type.  Each round is written to
    the shared folder; nothing but two counts comes to the driver.
    Links with a null end and links of a node to itself are ignored; no links
    give no rows.
    """
    tables = Tables(links.sparkSession, "components")
    given = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = tables.write(given, "stars-0")
    (total, loose), n = _state(now), 0
    while loose:
        large = tables.write(_large_star(now, total), "large")
        now = tables.write(_small_star(large, total), f"stars-{n + 1}")
        tables.remove("large", f"stars-{n}")
        (total, loose), n = _state(now), n + 1
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
