"""Connected components of a link table by alternating large and small stars.

Each step replaces links by links to the least neighbour, with one aggregation and one
join; a node with any number of neighbours only meets their minimum. Rounds grow with the
logarithm of the longest chain.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").filter("b > a and b > m").select(F.col("m").alias("a"), "b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    # links have a < b: for b, the lesser neighbours are its a.
    least = links.groupBy("b").agg(F.min("a").alias("m"))
    moved = links.join(least, "b")
    return moved.filter("a > m").select(F.col("m").alias("a"), F.col("a").alias("b")).union(least.select(F.col("m").alias("a"), "b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """links (a, b) of long ids, any order, repeats and loops allowed -> (id, component), component the least id reachable; ids without links to others are absent."""
    links = scratch.cut(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "links")
    before = None
    while True:
        # xor and count tell link tables apart; both are aggregates, nothing is collected.
        state = links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before:
            break
        before = state
        links = scratch.cut(_small_star(_large_star(links)), "links")
    return links.select(F.col("b").alias("id"), F.col("a").alias("component")).union(links.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())
