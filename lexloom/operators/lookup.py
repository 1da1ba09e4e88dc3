"""Lookup of word forms: exact, by case, by table, and tolerant of spelling.

Forms are looked up once per distinct type. Each stage is an equi-join; a later stage counts only where no earlier one hit.
Optional spellings are joined on a folded key and then checked position by position, since they hold in one direction only.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import case_variants, in_alphabet, short_vowels, titlecase
from ..sources.lexicon import SHORT_PREPOSITIONS

# Consonants that may be written once after a vowel, and vowels.
SINGLE = "nmptdklrsbgz"
VOWELS = "aeiouāēīōū"
# Optional spellings at the edges of a word (canonical, accepted).
INITIAL = (("wu", "u"),)
FINAL = (("sts", "stsi"), ("tis", "ts"), ("twei", "tun"))


def word_types(df: DataFrame, text: str = "text") -> DataFrame:
    """token, n: the distinct words (letter first) of a column of texts with their frequency."""
    from ..functions.text import tokenize

    return df.select(F.explode(tokenize(text)).alias("token")).where(F.col("token").rlike(r"^\p{L}")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def exact(forms: DataFrame, analyses: DataFrame, form: str = "token") -> DataFrame:
    """Each form with its analyses (lemma, tags); forms without any are left out."""
    return forms.join(analyses.withColumnRenamed("surface", form), form)


def surfaces_of(queries: DataFrame, analyses: DataFrame, query: str = "analysis") -> DataFrame:
    """query, surfaces: the sorted surfaces of an analysis string; empty when there is none. Tag order counts."""
    by = analyses.groupBy(F.col("analysis").alias(query)).agg(F.array_sort(F.collect_set("surface")).alias("surfaces"))
    return queries.select(query).distinct().join(by, query, "left").withColumn("surfaces", F.coalesce("surfaces", F.array().cast("array<string>")))


def macron_fold(form) -> Column:
    return short_vowels(form)


def macron_accepts(query: str, surface: str) -> Column:
    """Every character of the query is the surface's, or the short form of a small long vowel there."""
    q, s = F.split(query, ""), F.split(surface, "")
    same = F.zip_with(q, s, lambda a, b: (a == b) | (b.isin(*"āēīōū") & (a == F.translate(b, "āēīōū", "aeiou"))))
    return (F.length(query) == F.length(surface)) & F.forall(same, lambda x: x)


def lenient_fold(form: str) -> str:
    """One key for all spellings of a form."""
    for canonical, accepted in FINAL:
        if form.endswith(accepted):
            form = form[: -len(accepted)] + canonical
    for canonical, accepted in INITIAL:
        if form.startswith(accepted):
            form = canonical + form[len(accepted) :]
    out = ""
    for c in form.translate(str.maketrans("āēīōū", "aeiou")):
        if not (out and c == out[-1] and c in SINGLE):
            out += c
    return out


def spellings(surface: str) -> list[str]:
    """The edge spellings of a surface; long vowels and doubles are left to ``accepts``."""
    found = [surface]
    for canonical, accepted in INITIAL:
        found += [accepted + x[len(canonical) :] for x in found if x.startswith(canonical)]
    for canonical, accepted in FINAL:
        if surface.endswith(canonical):
            found += [x[: -len(canonical)] + accepted for x in found if x.endswith(canonical)]
    return found


def accepts(query: str, surface: str) -> bool:
    """The query is the surface, or one of its permitted reductions."""

    def reduced(s: str) -> bool:
        reach = {0}
        i = 0
        while i < len(s):
            c, nxt = s[i], set()
            for q in reach:
                if q < len(query) and (query[q] == c or (c in "āēīōū" and query[q] == "aeiou"["āēīōū".index(c)])):
                    nxt.add((q + 1, i + 1))
            double = i + 1 < len(s) and s[i + 1] == c and c in SINGLE and i > 0 and s[i - 1] in VOWELS
            if double:
                singles = {q + 1 for q in reach if q < len(query) and query[q] == c}
                pairs = {q + 2 for q in reach if query[q : q + 2] == c + c}
                reach, i = singles | pairs, i + 2
            else:
                reach, i = {q for q, _ in nxt}, i + 1
            if not reach:
                return False
        return len(query) in reach

    return any(reduced(s) for s in spellings(surface))


def lenient_key(form) -> Column:
    """``lenient_fold`` as a column."""
    out = F.col(form) if isinstance(form, str) else form
    for canonical, accepted in FINAL:
        out = F.regexp_replace(out, f"{accepted}$", canonical)
    for canonical, accepted in INITIAL:
        out = F.regexp_replace(out, f"^{accepted}", canonical)
    return F.regexp_replace(F.translate(out, "āēīōū", "aeiou"), f"([{SINGLE}])\\1+", "$1")


def lenient_accepts(query: str, surface: str) -> Column:
    """``accepts`` as a column: the query fits the pattern of a spelling of the surface, in which a small long vowel may be short,
    and a double consonant after a vowel single."""

    def pattern(spelling: Column) -> Column:
        quoted = F.regexp_replace(spelling, r"([^\p{L}\p{N} ])", r"\\$1")
        out = F.regexp_replace(quoted, f"(?<=[{VOWELS}])([{SINGLE}])\\1", "$1$1?")
        for long, short in zip("āēīōū", "aeiou"):
            out = F.replace(out, F.lit(long), F.lit(f"[{long}{short}]"))
        return out

    s = F.col(surface)
    forms = [s, *(F.when(s.startswith(c), F.regexp_replace(s, f"^{c}", a)) for c, a in INITIAL)]
    forms += [F.when(f.endswith(c), F.regexp_replace(f, f"{c}$", a)) for f in list(forms) for c, a in FINAL]
    fits = F.exists(F.transform(F.array_compact(F.array(*forms)), pattern), lambda p: F.regexp_like(F.col(query), F.concat(F.lit("^"), p, F.lit(r"\z"))))
    return F.coalesce(fits, F.lit(False))


def _readings(hits: DataFrame, form: str, name: str) -> DataFrame:
    return hits.groupBy(form).agg(F.array_sort(F.collect_set(F.struct("lemma", "tags"))).alias(name))


def cascade(types: DataFrame, analyses: DataFrame, lenient: bool = False, form: str = "token") -> DataFrame:
    """types with stage and readings: the form itself, its lower case, its title case, the short prepositions, then (if asked)
    the tolerant spellings of the lower and of the title case. The first stage with any analysis wins; else readings are empty."""
    table = F.create_map(*[F.lit(x) for kv in SHORT_PREPOSITIONS.items() for x in kv])
    keys = [("surface", F.col(form)), ("lower", F.lower(form)), ("title", titlecase(form)), ("preposition", table[F.lower(form)])]
    known = analyses.groupBy("surface").agg(F.array_sort(F.collect_set(F.struct("lemma", "tags"))).alias("readings"))
    probes = types.select(form, F.posexplode(F.array(*(k for _, k in keys))).alias("stage", "surface")).where("surface is not null")
    hits = probes.join(known, "surface")
    if lenient:
        both = types.select(form, F.posexplode(F.array(F.lower(form), titlecase(form))).alias("stage", "probe")).withColumn("key", lenient_key("probe"))
        folded = analyses.withColumn("key", lenient_key("surface"))
        near = both.join(folded, "key").where((F.col("probe") == F.col("surface")) | lenient_accepts("probe", "surface"))
        more = near.groupBy(form, (F.col("stage") + len(keys)).alias("stage")).agg(F.array_sort(F.collect_set(F.struct("lemma", "tags"))).alias("readings"))
        hits = hits.select(form, "stage", "readings").unionByName(more)
    best = hits.groupBy(form).agg(F.min_by(F.struct("stage", "readings"), "stage").alias("hit"))
    names = F.array(*(F.lit(n) for n in [*(n for n, _ in keys), "lenient lower", "lenient title"]))
    return types.join(best, form, "left").select(*types.columns, F.when(F.col("hit").isNotNull(), F.get(names, F.col("hit.stage"))).alias("stage"), F.coalesce("hit.readings", F.expr("array()").cast("array<struct<lemma:string,tags:array<string>>>")).alias("readings"))


def resolve_forms(forms: DataFrame, analyses: DataFrame, form: str = "form") -> DataFrame:
    """form, method (exact, case, macron, lenient or gap), lemmas, tags: each stage tries all case variants at once and the first
    with any analysis wins. Forms with foreign letters are gaps."""
    probes = forms.select(form).distinct().where(in_alphabet(form)).select(form, F.posexplode(case_variants(form)).alias("k", "probe"))
    direct = probes.join(analyses, F.col("probe") == F.col("surface")).select(form, F.when(F.col("k") == 0, 0).otherwise(1).alias("stage"), "lemma", "tags")
    macron = probes.withColumn("key", macron_fold("probe")).join(analyses.withColumn("key", macron_fold("surface")), "key").where(macron_accepts("probe", "surface")).select(form, F.lit(2).alias("stage"), "lemma", "tags")
    near = probes.withColumn("key", lenient_key("probe")).join(analyses.withColumn("key", lenient_key("surface")), "key").where((F.col("probe") == F.col("surface")) | lenient_accepts("probe", "surface")).select(form, F.lit(3).alias("stage"), "lemma", "tags")
    by = direct.union(macron).union(near).groupBy(form, "stage").agg(F.array_sort(F.collect_set("lemma")).alias("lemmas"), F.array_sort(F.collect_set(F.concat_ws("+", "tags"))).alias("tags"))
    best = by.groupBy(form).agg(F.min_by(F.struct("stage", "lemmas", "tags"), "stage").alias("b"))
    methods = F.array(*map(F.lit, ("exact", "case", "macron", "lenient")))
    none = F.array().cast("array<string>")
    return forms.select(form).distinct().join(best, form, "left").select(form, F.coalesce(F.get(methods, F.col("b.stage")), F.lit("gap")).alias("method"), F.coalesce("b.lemmas", none).alias("lemmas"), F.coalesce("b.tags", none).alias("tags"))
