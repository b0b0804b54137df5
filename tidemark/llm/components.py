"""Connected components of a link table, by alternating large-star and small-star steps.

Links are pairs of LONG ids. Every step is two joins and two map-side aggregations, its result is
written to the shared folder, and no neighbourhood is ever gathered in one place: a hub with a
third of all links is a skewed join side that adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._shared import drop_written, written


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    # after the large star, a > b in every link
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31)))).first())


def components(links: DataFrame) -> DataFrame:
    """(a, b) links as (a, root): root is the least id of a's component; every linked id but the roots has a row.

    Links to itself are ignored; an empty table gives an empty one.
    """
    links = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = _state(links)
    while state[0]:
        moved = written(_small_star(_large_star(links)), "links")
        drop_written(links)
        links, before = moved, state
        state = _state(links)
        if state == before:
            break
    return links.select("a", F.col("b").alias("root"))
