"""Connected components of a link table by alternating large and small stars.

Every round rewires links towards smaller ids and is written to the shared
folder; rounds grow with the logarithm of the longest chain. No group, component
or label table reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("low").alias("high"), F.col("high").alias("low")))
    least = both.groupBy("high").agg(F.least(F.min("low"), F.col("high")).alias("least"))
    return both.where("low > high").join(least, "high").select(F.col("low").alias("high"), F.col("least").alias("low")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("high").agg(F.min("low").alias("least"))
    moved = links.join(least, "high").where("low <> least").select(F.col("low").alias("high"), F.col("least").alias("low"))
    return moved.unionByName(least.select("high", F.col("least").alias("low"))).distinct()


def _are_stars(links: DataFrame) -> bool:
    """Whether every larger end has one link only and is no smaller end: then smaller ends are the least of their components."""
    ends = links.select(F.explode(F.array(F.struct(F.col("high").alias("node"), F.lit(1).alias("up")), F.struct(F.col("low").alias("node"), F.lit(0).alias("up")))).alias("end"))
    counts = ends.groupBy("end.node").agg(F.sum("end.up").alias("up"), F.count("*").alias("all"))
    return not counts.agg(F.count_if((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("up") < F.col("all"))))).first()[0]


def label_components(pairs: DataFrame) -> DataFrame:
    """(node, component): the smallest id reachable, for every node of pairs (a, b) but the smallest of each component.

    Links of a node to itself and null ends are ignored; repeated links count once.
    """
    links = cut(pairs.where("a <> b").select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).distinct())
    # No further round is run to see that none changes anything.
    while not _are_stars(links):
        links = cut(_small_star(_large_star(links)))
    return links.select(F.col("high").alias("node"), F.col("low").alias("component"))
