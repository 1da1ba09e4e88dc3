"""The engine's calls: analyse, validate, export, look up and generate, over DataFrames of texts."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokenize
from ..operators import constraints, lookup, validation
from ..sources import nvh

__all__ = ["analyze", "check_artifacts", "conllu", "generate", "tags", "tokenize", "validate"]


def cohorts(sentences: DataFrame, analyses: DataFrame, lenient: bool = True) -> DataFrame:
    """sent_id, text, cohorts; each word is looked up once per type through the cascade."""
    words = sentences.select(F.explode("tokens").alias("token")).where(F.col("token").rlike(r"^\p{L}")).distinct()
    return constraints.cohorts_of(sentences, lookup.cascade(words, analyses, lenient).select("token", "readings"))


def analyze(docs: DataFrame, analyses: DataFrame, grammars: list[str], includes: dict[str, str] | None = None, key: str = "doc_id", text: str = "text", snapshot: int | None = None, lenient: bool = True) -> DataFrame:
    """sent_id, text, cohorts after the grammars, for each sentence of a column of texts."""
    return constraints.analysed(cohorts(nvh.sentences_of_text(docs, key, text), analyses, lenient), grammars, includes, snapshot)


def validate(docs: DataFrame, analyses: DataFrame, grammars: list[str], includes: dict[str, str] | None = None, genitive_verbs: list[str] = (), **options) -> DataFrame:
    """The verdict on each sentence."""
    return validation.validated(analyze(docs, analyses, grammars, includes, **options), genitive_verbs)


def conllu(docs: DataFrame, analyses: DataFrame, grammars: list[str], includes: dict[str, str] | None = None, government: dict[str, str] | None = None, source: str | None = None, **options) -> DataFrame:
    """The CoNLL-U block of each sentence."""
    return validation.conllu(analyze(docs, analyses, grammars, includes, **options), government, source)


def tags(words: DataFrame, analyses: DataFrame, form: str = "token") -> DataFrame:
    """Each word with its sorted analyses, without any cascade; empty when there are none."""
    by = analyses.groupBy(F.col("surface").alias(form)).agg(F.array_sort(F.collect_set("analysis")).alias("analyses"))
    return words.select(form).distinct().join(by, form, "left").withColumn("analyses", F.coalesce("analyses", F.array().cast("array<string>")))


def generate(queries: DataFrame, analyses: DataFrame) -> DataFrame:
    """Each analysis string with its sorted surfaces."""
    return lookup.surfaces_of(queries, analyses)


def check_artifacts(spark: SparkSession, paths: dict[str, str]) -> list[str]:
    """A line for each named path that does not exist."""
    missing = []
    for name, path in sorted(paths.items()):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            missing.append(f"{name} is missing: {path}")
    return missing
