"""Baking a lexicon into the analysis table: entries, their forms and tags, without forms that other entries own."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .compression import merged
from .generation import generate
from .paradigms import slot_tag

# Tags of uninflected entries by part of speech, and of genders.
INVARIABLE = {"adv": "+Adv", "prep": "+Pr", "postp": "+Po", "intj": "+Interj", "part": "+Pcle", "cconj": "+CC", "sconj": "+CS", "num": "+Num", "pron": "+Pron", "noun": "+N"}
GENDER = {"masc": "Msc", "fem": "Fem", "neut": "Neu"}


def leading_number(paradigm: str = "paradigm") -> Column:
    """The number that a paradigm label begins with, or null."""
    return F.expr(f"try_cast(regexp_extract({paradigm}, '^([0-9]+)', 1) as int)")


def is_proper() -> Column:
    return F.substring("lemma", 1, 1).rlike(r"^\p{Lu}")


def lexeme_class() -> Column:
    """noun, adj, verb or invar by part of speech and paradigm; null for what is not baked."""
    n = leading_number()
    return (
        F.when((F.col("pos") == "noun") & n.between(32, 64), "noun").when(F.col("pos").isin("adj", "num", "pron") & n.between(21, 31), "adj").when((F.col("pos") == "adj") & n.isin(68, 69), "adj")
        .when((F.col("pos") == "verb") & (n >= 71), "verb").when(F.col("pos").isin(*INVARIABLE) & n.isNull(), "invar")
    )


@F.pandas_udf(T.StringType())
def tags_of(slot):
    def one(s):
        try:
            return slot_tag(s)
        except ValueError:
            return None

    return slot.map(one, na_action="ignore")


def analysis_tags() -> Column:
    """The tags of a cell: nouns get a proper-name tag and their gender, numerals and pronouns their own first tag."""
    genders = F.create_map(*[F.lit(x) for kv in GENDER.items() for x in kv])
    first = F.when(F.col("numtype") == "card", "+Num+Card").when(F.col("numtype") == "ord", "+Num+Ord").when(F.col("pos") == "num", "+Num").when(F.col("pos") == "pron", "+Pron")
    noun = F.concat(F.lit("+N"), F.when(is_proper(), "+Prop").otherwise(""), F.coalesce(F.concat(F.lit("+"), genders[F.col("gender")]), F.lit("")), F.expr("substring(slot_tags, 3)"))
    replaced = F.when(first.isNotNull() & F.col("slot_tags").rlike(r"^\+[NA]\+"), F.concat(first, F.expr("substring(slot_tags, 3)"))).otherwise(F.col("slot_tags"))
    refl = F.when(F.col("lemma").endswith(" si") & F.col("slot_tags").startswith("+V"), "+Refl").otherwise("")
    return F.when(F.col("slot_tags").startswith("+N+") & (F.col("class") == "noun"), noun).otherwise(F.concat(replaced, refl))


def bake(entries: DataFrame) -> DataFrame:
    """surface, analysis, lemma, tags of all entries.

    Cells are generated from lemma and stems and replaced by attested cells; uninflected entries give themselves, unless they
    refer to a lexeme that has their surface; an adjective's adverb is left out where the adverb is an entry of its own;
    surfaces with blanks and multiword lemmas are left out.
    """
    e = entries.withColumn("class", lexeme_class()).where("class is not null")
    inflected = e.where("class <> 'invar'")
    lexemes = inflected.select(F.col("id").alias("lexeme"), "pos", "paradigm", "lemma", "stems")
    attested = inflected.select(F.col("id").alias("lexeme"), F.explode("attested").alias("slot", "attested"))
    full = merged(generate(lexemes), attested.withColumn("attested", F.array_sort(F.array_distinct("attested"))))
    cells = full.join(inflected.withColumnRenamed("id", "lexeme"), "lexeme").select("lexeme", "lemma", "pos", "gender", "numtype", "class", "slot", F.explode("surfaces").alias("surface"))
    tagged = cells.withColumn("slot_tags", tags_of("slot")).where("slot_tags is not null").withColumn("tagset", analysis_tags())
    infinitives = inflected.where("class = 'verb'").select(F.col("id").alias("lexeme"), "lemma", F.lit("inf").alias("slot"), F.regexp_replace("lemma", " si$", "").alias("surface"), F.when(F.col("lemma").endswith(" si"), "+V+Inf+Refl").otherwise("+V+Inf").alias("tagset"))
    own_adverbs = e.where("pos = 'adv'").select(F.col("lemma").alias("surface"), F.lit(True).alias("own")).distinct()
    forms = tagged.select("lexeme", "lemma", "slot", "surface", "tagset").union(infinitives).join(own_adverbs, "surface", "left").where(~(F.startswith("slot", F.lit("adv")) & F.coalesce("own", F.lit(False)))).drop("own")
    table = F.create_map(*[F.lit(x) for kv in INVARIABLE.items() for x in kv])
    refers = F.filter("relations", lambda r: r["role"] == "lemma")
    invariable = e.where("class = 'invar'").select(F.col("id").alias("lexeme"), "lemma", F.lit("").alias("slot"), F.col("lemma").alias("surface"), table[F.col("pos")].alias("tagset"), F.get(refers, F.lit(0))["target"].alias("target"))
    known = forms.select(F.col("lexeme").alias("target"), "surface").distinct()
    alone = invariable.join(known, ["target", "surface"], "left_anti").select("lexeme", "lemma", "slot", "surface", "tagset")
    rows = forms.select("lexeme", "lemma", "slot", "surface", "tagset").union(alone).where(~F.contains("surface", F.lit(" "))).where(~F.contains(F.regexp_replace("lemma", " si$", ""), F.lit(" ")))
    return rows.select("surface", F.concat("lemma", "tagset").alias("analysis"), "lemma", F.split(F.expr("substring(tagset, 2)"), r"\+").alias("tags")).distinct()


def merged_table(closed: DataFrame, baked: DataFrame) -> DataFrame:
    """The analysis table of the closed classes and of the baked lexicon."""
    return closed.select("surface", "analysis", "lemma", "tags").unionByName(baked.select("surface", "analysis", "lemma", "tags")).distinct()


def gold_surfaces(spark: SparkSession, path: str | None, fallback: DataFrame) -> DataFrame:
    """surface: the lines of a frozen file of surfaces; without a file the surfaces of another table."""
    return spark.read.text(path).where("value <> ''").select(F.col("value").alias("surface")).distinct() if path else fallback.select("surface").distinct()


def parity(gold: DataFrame, got: DataFrame) -> DataFrame:
    """surface, side (missing or extra) of two tables of surfaces."""
    g, x = gold.select("surface").distinct(), got.select("surface").distinct()
    return g.subtract(x).withColumn("side", F.lit("missing")).union(x.subtract(g).withColumn("side", F.lit("extra")))


def parity_counts(gold: DataFrame, got: DataFrame) -> DataFrame:
    """One row: expected, found, missing, extra and the covered share in percent."""
    g, x = gold.select("surface", F.lit(1).alias("g")).distinct(), got.select("surface", F.lit(1).alias("x")).distinct()
    n = lambda test: F.count(F.when(test, 1))
    both = F.col("g").isNotNull() & F.col("x").isNotNull()
    sums = g.join(x, "surface", "full").agg(n(F.col("g").isNotNull()).alias("expected"), n(both).alias("found"), n(F.col("x").isNull()).alias("missing"), n(F.col("g").isNull()).alias("extra"))
    return sums.withColumn("covered_pct", F.round(100 * F.col("found") / F.greatest("expected", F.lit(1)), 2))


def write_parity(differences: DataFrame, path: str) -> None:
    """The rows of ``parity`` as tab-separated text for review, what is missing first."""
    differences.orderBy(F.desc("side"), "surface").select("side", "surface").write.csv(path, sep="\t", header=True)
