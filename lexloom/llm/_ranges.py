"""Ranges of a numeric key, as many as wanted, about equally full."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bounds_of(df: DataFrame, key: str, n: int) -> list[int]:
    """At most n - 1 ascending bounds at the quantiles of an integer key; a bounded sketch of it reaches the driver."""
    if n <= 1:
        return []
    return sorted({int(b) for b in df.select(key).approxQuantile(key, [i / n for i in range(1, n)], 0.1 / n)})


def range_index(key: Column, bounds: list[int]) -> Column:
    """How many bounds are not above the key. Looks at a group's first bounds, then into one group."""
    if not bounds:
        return F.lit(0)
    size = max(1, round(len(bounds) ** 0.5))
    groups = [bounds[i : i + size] for i in range(0, len(bounds), size)]
    one = lambda text, kind: F.from_json(F.lit(text), kind)  # noqa: E731  folds into one literal, however many bounds
    longs = lambda xs: one(str(list(xs)), "array<bigint>")
    upto = lambda xs: F.size(F.filter(xs, lambda b: b <= key))
    group = upto(longs([g[0] for g in groups])) - 1
    return F.when(group < 0, 0).otherwise(group * size + upto(F.get(one(str(groups), "array<array<bigint>>"), F.greatest(group, F.lit(0))))).cast("int")
