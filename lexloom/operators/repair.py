"""Repair of cells with stray paradigm codes and digits."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_damaged(surface) -> Column:
    """Any decimal digit in a surface is a defect of the source."""
    return F.col(surface).rlike(r"\p{Nd}") if isinstance(surface, str) else surface.rlike(r"\p{Nd}")


def repaired(surface: str, paradigm: str) -> Column:
    """Without the last lettered paradigm code that no digit precedes, and then without all digits."""
    code = F.concat(F.lit(r"(?<!\d)"), F.col(paradigm))
    last = F.concat(code, F.lit("(?!.*"), code, F.lit(")"))
    lettered = F.col(paradigm).rlike(r"^\d+\p{L}+$")
    return F.regexp_replace(F.when(lettered, F.regexp_replace(F.col(surface), last, F.lit(""))).otherwise(F.col(surface)), r"\p{Nd}", "")


def repair(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells with repaired surfaces, rows to review) of rows (lexeme, paradigm, slot, surface). What is empty then goes, and
    equal surfaces of a slot are one."""
    damaged = cells.where(is_damaged("surface"))
    fixed = cells.withColumn("surface", F.when(is_damaged("surface"), repaired("surface", "paradigm")).otherwise(F.col("surface")))
    return fixed.where("surface <> ''").distinct(), damaged.select("lexeme", "paradigm", "slot", "surface").distinct()


def write_review(review: DataFrame, path: str) -> None:
    """The rows to review as tab-separated text with a header."""
    review.orderBy("lexeme", "paradigm", "slot").select("lexeme", "paradigm", "slot").write.csv(path, sep="\t", header=True)
