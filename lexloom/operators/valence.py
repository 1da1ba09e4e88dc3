"""Government of adpositions and valence of verbs, parsed from descriptions, and the lists that grammars include."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import without_attestations

# Names of cases in descriptions.
CASES = {"acc": "Acc", "akk": "Acc", "dat": "Dat", "gen": "Gen"}


# Lemmas that the lists have whatever the entries say.
CURATED = {
    "GenVerb": ("bijātun", "klausītun", "kwaitītun"),
    "AkkVerb": ("turītun", "waīstun", "billītun", "widātun", "gaūtun", "milītun", "pazinātun"),
    "DatPrep": ("dīnkun",),
    "DatAnyPrep": ("dīnkun",),
}


def _cases(text) -> Column:
    table = F.create_map(*[F.lit(x) for kv in CASES.items() for x in kv])
    found = F.regexp_extract_all(F.lower(text), F.lit(r"\b(acc|akk|dat|gen)\b"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda c: table[c]))


def valence(entries: DataFrame) -> DataFrame:
    """lemma, kind (prep, postp, verb), cases, rection, intransitive, transitive, takes_infinitive.

    entries: lemma, description, and whether the entry has finite forms (finite). A verb's government by preposition is cut out
    before its object cases are read. Entries without any feature are left out.
    """
    gram = without_attestations(F.col("description"))
    d = entries.select("lemma", "finite", gram.alias("gram"))
    kind = F.when(F.col("gram").rlike("^prp"), "prep").when(F.col("gram").rlike("^psp"), "postp").when(F.col("finite"), "verb")
    rection = F.regexp_extract_all("gram", F.lit(r"\+\s*(\p{L}+\s+(?:acc|akk|dat|gen))\b"), F.lit(1))
    rest = F.regexp_replace("gram", r"\+\s*\p{L}+\s+(?:acc|akk|dat|gen)\b", "")
    word = lambda w: F.col("gram").rlike(rf"\b{w}\b")
    out = d.withColumn("kind", kind).where("kind is not null").withColumn("rection", F.when(F.col("kind") == "verb", rection).otherwise(F.array().cast("array<string>")))
    out = out.withColumn("cases", _cases(F.when(F.col("kind") == "verb", rest).otherwise(F.col("gram")))).withColumn("intransitive", word("itr")).withColumn("transitive", word("tr")).withColumn("takes_infinitive", word("if"))
    some = (F.size("cases") + F.size("rection") > 0) | F.col("intransitive") | F.col("transitive") | F.col("takes_infinitive")
    return out.where((F.col("kind") != "verb") | some).drop("gram", "finite")


def government_lists(table: DataFrame, curated: dict[str, tuple[str, ...]] = CURATED) -> DataFrame:
    """name, lemmas (sorted): which adpositions govern a case only, or also, and which verbs take it; with the ``curated`` ones."""
    only = lambda c: (F.size("cases") == 1) & F.array_contains("cases", c)
    lists = {
        "AkkPrep": (F.col("kind") == "prep") & only("Acc"), "DatPrep": (F.col("kind") == "prep") & only("Dat"),
        "AccAnyPrep": (F.col("kind") == "prep") & F.array_contains("cases", "Acc"), "DatAnyPrep": (F.col("kind") == "prep") & F.array_contains("cases", "Dat"),
        "GenPost": (F.col("kind") == "postp") & F.array_contains("cases", "Gen"),
        "GovAccAdp": (F.col("kind") != "verb") & F.array_contains("cases", "Acc"), "GovDatAdp": (F.col("kind") != "verb") & F.array_contains("cases", "Dat"), "GovGenAdp": (F.col("kind") != "verb") & F.array_contains("cases", "Gen"),
        "GovAdp": (F.col("kind") != "verb") & (F.size("cases") > 0), "GenVerb": (F.col("kind") == "verb") & F.array_contains("cases", "Gen"), "AkkVerb": (F.col("kind") == "verb") & F.array_contains("cases", "Acc"),
    }
    rows = table.select("lemma", F.explode(F.array_compact(F.array(*(F.when(test, F.lit(n)) for n, test in lists.items())))).alias("name"))
    rows = rows.union(table.sparkSession.createDataFrame([(x, n) for n, xs in curated.items() for x in xs], "lemma string, name string"))
    names = table.sparkSession.createDataFrame([(n,) for n in lists], "name string")
    return names.join(rows.groupBy("name").agg(F.array_sort(F.collect_set("lemma")).alias("lemmas")), "name", "left").withColumn("lemmas", F.coalesce("lemmas", F.array(F.lit("__none__"))))


def governed_case(table: DataFrame, curated: dict[str, tuple[str, ...]] = CURATED) -> dict[str, str]:
    """The case of each preposition that governs one case only, as the export takes it."""
    rows = government_lists(table, curated).where("name in ('AkkPrep', 'DatPrep')").collect()  # two lists of prepositions
    return {x: case for r in rows for name, case in (("AkkPrep", "Acc"), ("DatPrep", "Dat")) if r["name"] == name for x in r["lemmas"] if x != "__none__"}


def list_line(name: str, lemmas: list[str]) -> str:
    """One list in grammar notation."""
    return f"LIST {name} = " + " ".join(f'"{x}"' for x in lemmas or ["__none__"]) + " ;"
