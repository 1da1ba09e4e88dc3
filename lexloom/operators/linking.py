"""Cross-references between lexicon entries: arrows in descriptions, headword prefixes, and the cascade of form lookups."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import arrow_targets, folded, strip_marks
from .lookup import resolve_forms

MOST_TOKENS = 4


def headwords(entries: DataFrame) -> DataFrame:
    """id, word, position and the keys under which an entry is found."""
    return entries.select("id", "position", F.col("lemma").alias("word"), folded("lemma").alias("folded"), folded(strip_marks("lemma")).alias("bare"))


def references(entries: DataFrame) -> DataFrame:
    """id, lemma, k, ref: the texts after arrows."""
    return entries.select("id", "lemma", F.posexplode(arrow_targets("description")).alias("k", "ref"))


def resolve_targets(refs: DataFrame, entries: DataFrame, analyses: DataFrame) -> DataFrame:
    """id, lemma, k, ref, method, target_ids. The longest prefix of at most four words that is a headword wins, exact before
    folded; then prefixes without marks; then the forms of the first word whose lemma is a headword; else a gap."""
    heads = headwords(entries)
    words = F.split(F.trim("ref"), r"\s+")
    prefixes = refs.select("id", "lemma", "k", "ref", F.explode(F.sequence(F.least(F.size(words), F.lit(MOST_TOKENS)), F.lit(1), F.lit(-1))).alias("n")).withColumn("prefix", F.array_join(F.slice(words, F.lit(1), F.col("n")), " "))
    keys = ["id", "lemma", "k", "ref"]

    def hits(left, right, method, rank):
        joined = prefixes.withColumn("key", left).join(heads.select(F.col("id").alias("target"), "position", F.col(right).alias("key")), "key")
        return joined.select(*keys, F.lit(method).alias("method"), (F.lit(rank[0]) - F.col("n") * rank[1] + rank[2]).alias("rank"), "target", "position")

    # Ranks: longer prefixes first, exact before folded within a length; all of these before prefixes without marks.
    found = hits(F.col("prefix"), "word", "headword", (100, 10, 0)).union(hits(folded("prefix"), "folded", "headword", (100, 10, 1))).union(hits(folded(strip_marks("prefix")), "bare", "macron", (300, 10, 0)))
    forms = refs.select(*keys, words[0].alias("form"))
    looked = resolve_forms(forms, analyses).where("method <> 'gap'").select("form", "method", F.explode("lemmas").alias("word"))
    by_form = forms.join(looked, "form").join(heads.select(F.col("id").alias("target"), "word", "position"), "word").select(*keys, F.concat(F.lit("form-"), "method").alias("method"), F.lit(900).alias("rank"), "target", "position")
    all_ = found.union(by_form)
    best = all_.withColumn("least", F.min("rank").over(Window.partitionBy("id", "k"))).where("rank = least")
    one = best.groupBy(*keys, "method").agg(F.array_sort(F.collect_set(F.struct("position", "target"))).alias("t")).select(*keys, "method", F.col("t.target").alias("target_ids"))
    return refs.join(one, keys, "left").select(*keys, F.coalesce("method", F.lit("gap")).alias("method"), F.coalesce("target_ids", F.array().cast("array<string>")).alias("target_ids"))


def filter_homographs(links: DataFrame, entries: DataFrame, analyses: DataFrame) -> DataFrame:
    """Of several targets those stay whose part of speech fits the analyses of the referring form, if any does."""
    # Parts of speech by first tag.
    tag = {"noun": "N", "adj": "A", "verb": "V", "pron": "Pron", "num": "Num", "adv": "Adv", "prep": "Pr", "part": "Pcle", "intj": "Interj", "cconj": "CC", "sconj": "CS"}
    table = F.create_map(*[F.lit(x) for kv in tag.items() for x in kv])
    wanted = analyses.groupBy(F.col("surface").alias("lemma")).agg(F.collect_set(F.col("tags")[0]).alias("wanted"))
    rows = links.select("id", "k", "lemma", F.posexplode_outer("target_ids").alias("p", "target")).join(entries.select(F.col("id").alias("target"), table[F.col("pos")].alias("pos_tag")).dropDuplicates(["target"]), "target", "left").join(wanted, "lemma", "left")
    fits = F.array_sort(F.collect_list(F.when(F.array_contains("wanted", F.col("pos_tag")), F.struct("p", "target"))))
    by = rows.groupBy("id", "k").agg(fits.alias("fit"))
    kept = F.when((F.size("target_ids") > 1) & (F.size("fit") > 0), F.col("fit.target")).otherwise(F.col("target_ids"))
    return links.join(by, ["id", "k"]).withColumn("target_ids", kept).drop("fit")


def resolve_corpus(entries: DataFrame, analyses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links with the referring form's tags, unresolved references)."""
    links = filter_homographs(resolve_targets(references(entries), entries, analyses), entries, analyses)
    heads = entries.select(F.col("id").alias("target"), F.col("lemma").alias("target_lemma"))
    tags = links.select("id", "k", "lemma", F.explode("target_ids").alias("target")).join(heads, "target").join(analyses.select(F.col("surface").alias("lemma"), F.col("lemma").alias("target_lemma"), F.concat_ws("+", "tags").alias("tag")), ["lemma", "target_lemma"])
    by = tags.groupBy("id", "k").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    full = links.join(by, ["id", "k"], "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
    return full.where("method <> 'gap'"), full.where("method = 'gap'").select("id", "lemma", "ref")
