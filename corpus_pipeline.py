"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the last return the columns of
``documents``. Tables other than the documents (labels, benchmark) come from ``sf_dir``.

In every stage rows are told apart by doc_id and text, so rows that repeat a doc_id, and rows without one, are documents like any
other; empty tables give empty results, and columns other than those of ``documents`` are left out. Null and empty texts pass the
near-duplicate stage (they resemble nothing) and the decontamination, and the mix takes none of them, as they have no words. Ties
(equal documents in one group, equal ranks in the mix) go to the smallest doc_id, then to the smallest hash of the text.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import decontaminate, jaccard, mixing, quality, tokens
from lexloom.llm._store import drop, new_path, staged

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts, with a model learned from the labelled ones among them."""
    docs = docs.select(*COLUMNS)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.scored(docs, model).where("predicted = 1").select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, a similarity of 0.8): that with the smallest doc_id, one
    without a doc_id last. Of equal rows one stays."""
    docs = docs.select(*COLUMNS).withColumn("k", jaccard.row_hash())
    found = staged(jaccard.classes(docs).where("class is not null").select("doc_id", "k", "class"), "classes")
    last = F.coalesce("doc_id", F.lit(2**63 - 1))
    first = found.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("missing"), last.alias("doc"), "k")).alias("x")).select(F.col("class").alias("c"), F.col("x.missing").alias("missing"), F.col("x.doc").alias("doc"), F.col("x.k").alias("first"))
    copy = ~((F.col("doc_id").isNull() == F.col("missing")) & (last == F.col("doc")) & (F.col("k") == F.col("first")))
    copies = staged(found.join(first, found["class"] == first["c"]).where(copy).select(F.col("doc_id").alias("copied"), F.col("k").alias("hash")).distinct(), "copies")
    kept = docs.join(copies, (F.col("k") == F.col("hash")) & F.col("doc_id").eqNullSafe(F.col("copied")), "left_anti")
    # Equal rows are copies too, unless they have no words and resemble nothing.
    alone = F.when(F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]"), F.lit(0).cast("long")).otherwise(F.monotonically_increasing_id())
    return kept.withColumn("alone", alone).dropDuplicates(["k", "doc_id", "alone"]).select(*COLUMNS)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the spans that they share with the benchmark."""
    clean = decontaminate.decontaminate(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return clean.select("doc_id", F.col("clean_text").alias("text"), "lang", "source", F.length("clean_text").cast("long").alias("n_chars"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    docs = docs.select(*COLUMNS).withColumn("k", jaccard.row_hash())
    mix = mixing.mix(docs, keep=("k",)).where("copies > 0").groupBy(F.col("doc_id").alias("taken"), F.col("k").alias("hash")).agg(F.sum("copies").alias("copies"))
    one = docs.dropDuplicates(["k", "doc_id"])  # the copies of equal rows are summed
    both = one.join(mix, (F.col("k") == F.col("hash")) & F.col("doc_id").eqNullSafe(F.col("taken")))
    return both.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed token ids, read back: doc_id, start, n_tokens, ids_crc32."""
    out = new_path(spark, "corpus")
    tokens.write_packed(docs, out, tokens.vocabulary_path(), between_tasks=0)
    return tokens.read_packed(spark, out)


STAGES = [("quality classifier", good_quality), ("n-gram Jaccard join", one_of_each), ("benchmark decontamination", no_benchmark), ("mixing sources to target weights", mixed), ("token-ID / binary output", token_ids)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = last = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, last = staged(stage(spark, docs, sf_dir), "stage"), docs
        if hasattr(last, "_staged"):
            drop(spark, last)
    return STAGES[-1][1](spark, docs, sf_dir)
