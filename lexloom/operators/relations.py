"""Finite relations between strings, as tables of (upper, lower): what transducers do, done with joins."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def relation(analyses: DataFrame) -> DataFrame:
    return analyses.select(F.col("analysis").alias("upper"), F.col("surface").alias("lower"))


def union(first: DataFrame, *more: DataFrame) -> DataFrame:
    for m in more:
        first = first.unionByName(m)
    return first.distinct()


def compose(first: DataFrame, second: DataFrame) -> DataFrame:
    """Pairs (x, z) with a y such that (x, y) is in the first and (y, z) in the second."""
    a, b = first.select("upper", F.col("lower").alias("middle")), second.select(F.col("upper").alias("middle"), "lower")
    return a.join(b, "middle").select("upper", "lower").distinct()


def invert(r: DataFrame) -> DataFrame:
    return r.select(F.col("lower").alias("upper"), F.col("upper").alias("lower"))


def write(r: DataFrame, path: str, key: str = "lower") -> None:
    """The relation sorted by the side that is looked up, so that a lookup reads few row groups."""
    r.repartitionByRange(key).sortWithinPartitions(key).write.parquet(path)
