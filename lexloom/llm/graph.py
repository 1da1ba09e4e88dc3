"""Connected components of a link table, without gathering it anywhere."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import drop, staged


def _oriented(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct()


def _mark(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): each node of ``links`` with the smallest node that it reaches.

    Alternates large and small stars (Kiveris et al., 2014) until the links no longer change: then every link leads from a node
    to the smallest of its component. Nulls link nothing.
    """
    now = staged(_oriented(links.where(F.col(a).isNotNull() & F.col(b).isNotNull()), a, b), "links")
    mark = _mark(now)
    while mark[0]:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _oriented(both.join(least, "u").where("v > u"), "v", "m")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = _oriented(large.join(least, "a").select("b", "m").union(least.select("a", "m")), "b", "m")
        last, now, before = now, staged(small, "links"), mark
        drop(now.sparkSession, last)
        mark = _mark(now)
        if mark == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
