"""Connected components of a link table: distributed union-find by stars.

Alternates two DataFrame steps until the table no longer changes: every node
hangs its larger neighbours on its smallest one (large star), then its smaller
ones (small star). The result is one star per component. Minima are partial
aggregates; a hub's links are rows of a skew-splittable join, never one task's
list. Each round is a table in the shared folder, removed once the next is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pagelane.llm.common import discard, staged


def _fingerprint(links: DataFrame):
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    smallest = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("hub"), F.least("u", "m").alias("m"))
    return both.filter("v > u").join(smallest, F.col("u") == F.col("hub")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    smallest = links.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("hub"), "m")
    hung = links.join(smallest, F.col("u") == F.col("hub")).filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(smallest.select(F.col("hub").alias("u"), F.col("m").alias("v")))


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node`` and ``root`` (the smallest node of its component) for every node that is not a root itself.

    Null ends and loops are ignored; repeated links count once; no links give no rows.
    """
    ends = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    current = staged(ends.distinct(), "components")
    before = _fingerprint(current)
    while before[0]:
        last, current = current, staged(_small_star(_large_star(current).distinct()).distinct(), "components")
        after = _fingerprint(current)
        discard(last)
        if after == before:
            break
        before = after
    return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
