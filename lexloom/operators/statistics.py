"""Cohort classes and ambiguity statistics over token streams and analyses."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokenize


def cohort_class(token: str = "token") -> Column:
    """CLB for a sentence's end, PUNCT for other tokens without a first letter, else WORD."""
    return F.when(F.col(token).isin(".", "!", "?"), "CLB").when(~F.col(token).rlike(r"^\p{L}"), "PUNCT").otherwise("WORD")


def with_final_delimiter(tokens) -> Column:
    """A token array that ends in a sentence's end; a full stop is added where it does not."""
    last = F.element_at(tokens, -1)
    return F.when(F.size(tokens) == 0, tokens).when(last.isin(".", "!", "?"), tokens).otherwise(F.concat(tokens, F.array(F.lit("."))))


def word_counts(docs: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """by, token, n for words; the explosion is summed before any shuffle."""
    return docs.select(*by, F.explode(tokenize(text)).alias("token")).where(F.col("token").rlike(r"^\p{L}")).groupBy(*by, "token").agg(F.count(F.lit(1)).alias("n"))


def ambiguity(counts: DataFrame, readings: DataFrame, by: list[str]) -> DataFrame:
    """Frequency-weighted statistics per group: words, unknown share, average readings and unambiguous share of the known.

    counts: by, token, n. readings: token, readings (an array; tokens without any are absent or have an empty one).
    """
    size = F.coalesce(F.size("readings"), F.lit(0))
    known = F.sum(F.when(F.col("k") > 0, F.col("n")).otherwise(0))
    share = lambda part, whole: F.when(whole > 0, F.round(100.0 * part / whole, 6)).otherwise(F.lit(0.0))
    return (
        counts.join(readings.where(F.size("readings") > 0), "token", "left").withColumn("k", F.greatest(size, F.lit(0)))
        .groupBy(*by)
        .agg(
            F.sum("n").alias("word_tokens"),
            share(F.sum(F.when(F.col("k") == 0, F.col("n")).otherwise(0)), F.sum("n")).alias("unknown_pct"),
            F.when(known > 0, F.round(F.sum(F.col("n") * F.col("k")) / known, 6)).otherwise(F.lit(0.0)).alias("avg_readings"),
            share(F.sum(F.when(F.col("k") == 1, F.col("n")).otherwise(0)), known).alias("unambiguous_pct"),
        )
    )


def _pair() -> tuple[Column, Column]:
    """Whether a word's readings differ in their part of speech (pos) or, having one, in the tags after it (sig); and between what."""
    pos = F.array_sort(F.array_distinct(F.transform("readings", lambda r: F.get(r["tags"], F.lit(0)))))
    sigs = F.array_sort(F.array_distinct(F.transform("readings", lambda r: F.array_join(F.slice(r["tags"], 2, 2**30), "+"))))
    several = F.size(pos) > 1
    return F.when(several, "pos").otherwise("sig"), F.when(several, F.array_join(pos, "|")).otherwise(F.concat(F.get(pos, F.lit(0)), F.lit(": "), F.array_join(sigs, " | ")))


def pairs(counts: DataFrame, readings: DataFrame, by: list[str]) -> DataFrame:
    """by, kind, pair, n: which parts of speech (kind pos), or which tags of one part of speech (sig), are confused, weighted by
    frequency. A word counts as one or the other."""
    kind, pair = _pair()
    return counts.join(readings.where(F.size("readings") > 1), "token").groupBy(*by, kind.alias("kind"), pair.alias("pair")).agg(F.sum("n").alias("n"))


def _weighted(done: DataFrame, by: list[str]) -> DataFrame:
    """by, readings, w of the words and of what is left of them, each as often as its sentence."""
    from .validation import is_word

    w = F.coalesce(F.col("frequency"), F.lit(1)) if "frequency" in done.columns else F.lit(1)
    rows = done.select(*by, w.cast("long").alias("w"), F.explode(F.filter("cohorts", lambda c: (F.size(c["readings"]) == 0) | is_word(c))).alias("c"))
    return rows.select(*by, "w", F.col("c.readings").alias("readings")).withColumn("unknown", F.exists("readings", lambda r: F.array_contains(r["tags"], "Unk"))).withColumn("k", F.size("readings"))


def ambiguity_of(done: DataFrame, by: list[str] = ()) -> DataFrame:
    """Statistics of analysed sentences, weighted by their frequency: words, the unknown share, those without a reading left
    (collapsed) and their share, average readings and the unambiguous share of the others."""
    total = lambda test: F.coalesce(F.sum(F.when(test, F.col("w"))), F.lit(0))
    fine = ~F.col("unknown") & (F.col("k") > 0)
    share = lambda part, whole: F.when(whole > 0, F.round(100.0 * part / whole, 6)).otherwise(F.lit(0.0))
    n, known = F.coalesce(F.sum("w"), F.lit(0)), total(fine)
    return _weighted(done, list(by)).groupBy(*by).agg(
        n.alias("word_tokens"), share(total(F.col("unknown")), n).alias("unknown_pct"), total(F.col("k") == 0).alias("collapsed"), share(total(F.col("k") == 0), n).alias("collapsed_pct"),
        F.when(known > 0, F.round(F.sum(F.when(fine, F.col("w") * F.col("k"))) / known, 6)).otherwise(F.lit(0.0)).alias("avg_readings"), share(total(fine & (F.col("k") == 1)), known).alias("unambiguous_pct"),
    )


def pairs_of(done: DataFrame, by: list[str] = ()) -> DataFrame:
    """``pairs`` of analysed sentences, weighted by their frequency."""
    kind, pair = _pair()
    return _weighted(done, list(by)).where((F.col("k") > 1) & ~F.col("unknown")).groupBy(*by, kind.alias("kind"), pair.alias("pair")).agg(F.sum("w").alias("n"))


def top(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each group in a total order."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)
