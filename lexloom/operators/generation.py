"""Generation of word forms: lexemes, roles and endings meet in joins, accents follow from regular expressions."""

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import paradigms as P

# Consonants that can be doubled.
DOUBLE = "bcdfghjklmnprstvwz"
_LONG = dict(zip("āēīōū", "aeiou"))
_STEPS = [*((f"{a}(?=.*\\^)", b) for a, b in _LONG.items()), (rf"([{DOUBLE}])\1(?=[^\^~]*\^)", "$1"), (r"[\^~]", ""), (rf"([{DOUBLE}])\1(?=s$)", "$1"), (rf"([{DOUBLE}])>", "$1$1"), (">", "")]
SENTINEL = "stuba"


def accent(form) -> Column:
    """Long vowels before an accent boundary become short, double consonants between it and the last guard single; markers go;
    double consonants before a final s become single; a consonant before the doubling marker doubles."""
    out = F.col(form) if isinstance(form, str) else form
    for pattern, into in _STEPS:
        out = F.regexp_replace(out, pattern, into)
    return out


def accented(form: str) -> str:
    for pattern, into in _STEPS:
        form = re.sub(pattern, into.replace("$1", r"\1"), form)
    return form


def role_table(spark: SparkSession) -> DataFrame:
    """pos, paradigm, role, slot, ending, measured: the ending as it comes out after a neutral stem."""
    rows = [(*r, accented(SENTINEL + r[4]).removeprefix(SENTINEL)) for r in P.ROLES]
    return spark.createDataFrame(rows, "pos string, paradigm string, role string, slot string, ending string, measured string")


def label_table(spark: SparkSession) -> DataFrame:
    """pos, label, paradigm and what its stem rules need: all labels of all paradigms, aliases included."""
    rows = []
    for kind, paradigm in P.SPEC:
        aliases = [a for a, to in P.ALIASES.get(kind, {}).items() if to == paradigm]
        labels = [paradigm, *aliases] + (["87"] if kind == "verb" and paradigm in ("87a", "87b") else [])
        cuts = list(P.VERB_STRIP) if kind == "verb" else P.strip_of(kind, paradigm)
        rows += [(kind, x, paradigm, cuts, P.suffix_of(kind, paradigm), P.theme_of(kind, paradigm)) for x in labels]
    return spark.createDataFrame(rows, "pos string, label string, paradigm string, cuts array<string>, suffix string, theme array<string>")


def _without(text: Column, endings: Column) -> Column:
    """The text without the first of the endings that fits."""
    fits = F.get(F.filter(endings, lambda e: (F.length(e) > 0) & text.endswith(e)), F.lit(0))
    return F.when(fits.isNull(), text).otherwise(F.substring(text, F.lit(1), F.length(text) - F.length(fits)))


def with_rule_stems(lexemes: DataFrame) -> DataFrame:
    """The lexemes with a known paradigm: pos (family), paradigm (resolved), rules (role to stem as the rules have it).

    Lemmas are composed (NFC), as ``sources.nvh`` reads them. A label that means two paradigms is decided by the lemma.
    """
    kind = F.when(F.lower("pos").isin("pron", "num"), "adj").otherwise(F.lower("pos"))
    base = lexemes.withColumn("base", F.regexp_replace(F.trim("lemma"), " si$", "")).withColumn("kind", kind)
    labels = F.broadcast(label_table(lexemes.sparkSession).withColumnsRenamed({"pos": "kind", "paradigm": "resolved"}))  # some hundred rows
    known = base.join(labels, (base["kind"] == labels["kind"]) & (base["paradigm"] == labels["label"])).drop(labels["kind"])
    stem = _without(F.col("base"), F.col("cuts"))
    known = known.withColumn("stem", stem).where((F.col("label") != "87") | (F.col("kind") != "verb") | (F.regexp_replace("stem", "[aāuīo]+$", "").endswith("nd") == (F.col("resolved") == "87a")))
    s, u, first = F.col("stem"), F.col("stem").endswith("u"), F.coalesce(F.get("theme", F.lit(0)), F.lit(""))
    vowel = F.substring(s, -1, 1).isin(*P.CASE_VOWELS)
    bare = _without(s, F.col("theme"))
    short = F.substring(s, F.lit(1), F.length(s) - 1)
    verb = {
        "pres": bare, "pret": s, "nonfin": s, "partPerfPass": F.concat(s, F.lit("t")),
        "partPresAct": F.when(u, F.concat(short, F.lit("wint"))).when((F.size("theme") > 0) & (bare != s), F.concat(bare, first, F.lit("nt"))).when(vowel, F.concat(s, F.lit("nt"))).otherwise(F.concat(s, first, F.lit("nt"))),
        "partPerfAct": F.when(u, F.concat(short, F.lit("w"))).when(vowel, F.concat(s, F.lit("w"))).otherwise(s),
    }
    longer = F.concat(s, F.col("suffix"))
    adj = {"pos": s, "adv": s, "cmp": longer, "sup": F.concat(F.lit("uka"), longer)}
    as_map = lambda stems: F.create_map(*[x for k, v in stems.items() for x in (F.lit(k), v)])
    rules = F.when(F.col("lemma").isNull() | (F.col("lemma") == ""), F.create_map().cast("map<string,string>")).when(F.col("kind") == "verb", as_map(verb)).when(F.col("kind") == "adj", as_map(adj)).otherwise(as_map({"obl": s}))
    return known.withColumn("rules", rules).withColumn("pos", F.col("kind")).withColumn("paradigm", F.col("resolved")).drop("base", "kind", "label", "resolved", "cuts", "suffix", "theme", "stem")


def usable(stem: Column) -> Column:
    """A stem without foreign characters."""
    return ~stem.rlike("[^" + "".join(sorted(P.STEM_ALPHABET)).replace("^", "\\^") + "]")


def role_stems(lexemes: DataFrame) -> DataFrame:
    """lexeme, pos, paradigm (resolved), role, stem, default: a supplied stem, else the rule's.

    lexemes: lexeme (its key), pos, paradigm, lemma, stems (map of role to stem, may be null). Supplied stems of unknown roles and
    stems with foreign characters are left out; lexemes of unknown paradigms have no rows.
    """
    base = with_rule_stems(lexemes).select("lexeme", "pos", "paradigm", "rules", F.coalesce("stems", F.create_map().cast("map<string,string>")).alias("stems"))
    roles = base.sparkSession.createDataFrame(sorted({r[:3] for r in P.ROLES}), "pos string, paradigm string, role string")
    out = base.join(F.broadcast(roles), ["pos", "paradigm"]).select("lexeme", "pos", "paradigm", "role", F.coalesce(F.col("stems")[F.col("role")], F.col("rules")[F.col("role")]).alias("stem"), F.col("rules")[F.col("role")].alias("default"))
    return out.where(F.col("stem").isNotNull() & usable(F.col("stem")))


def forms_of(stems: DataFrame) -> DataFrame:
    """The columns of ``stems`` (with pos, paradigm, role, stem) by slot, with the surface."""
    roles = F.broadcast(role_table(stems.sparkSession))  # the paradigm tables: some thousand rows
    return stems.join(roles, ["pos", "paradigm", "role"]).withColumn("surface", accent(F.concat("stem", "ending"))).drop("ending", "measured")


def generate(lexemes: DataFrame) -> DataFrame:
    """lexeme, slot, surfaces (sorted) of all forms."""
    return forms_of(role_stems(lexemes)).groupBy("lexeme", "slot").agg(F.array_sort(F.collect_set("surface")).alias("surfaces"))


def agreement(lexemes: DataFrame) -> DataFrame:
    """pos, paradigm, role, cells, stripped, regenerated, same_stem: generation against analysis, cell by cell. A form is stripped if it
    ends in its slot's ending as measured; the stem that is left regenerates it if the rules give the form again, and is the same
    where it is the one that the form was made of (an accented ending may have shortened it)."""
    roles = F.broadcast(role_table(lexemes.sparkSession))
    rows = forms_of(role_stems(lexemes)).join(roles, ["pos", "paradigm", "role", "slot"])
    left = F.when(F.endswith("surface", "measured"), F.expr("left(surface, length(surface) - length(measured))"))
    rows = rows.withColumn("left", left).withColumn("again", accent(F.concat("left", "ending")) == F.col("surface"))
    n = lambda test: F.count(F.when(test, 1))
    return rows.groupBy("pos", "paradigm", "role").agg(F.count(F.lit(1)).alias("cells"), n(F.col("left").isNotNull()).alias("stripped"), n(F.col("again")).alias("regenerated"), n(F.col("left") == F.col("stem")).alias("same_stem"))


def check_stem(stem: str, role: str = "") -> str:
    """The stem, or ValueError if it has a foreign character."""
    wrong = sorted(set(stem) - P.STEM_ALPHABET)
    if wrong:
        raise ValueError(f"stem {stem!r}{f' of {role}' if role else ''} has {' '.join(wrong)}")
    return stem


def refused_stems(lexemes: DataFrame) -> DataFrame:
    """lexeme, role, stem, reason of supplied stems that generation leaves out."""
    each = with_rule_stems(lexemes).select("lexeme", "pos", "paradigm", F.explode("stems").alias("role", "stem"))
    roles = F.broadcast(each.sparkSession.createDataFrame([(*r, True) for r in sorted({r[:3] for r in P.ROLES})], "pos string, paradigm string, role string, known boolean"))
    why = F.when(F.col("known").isNull(), "unknown role").when(~usable(F.col("stem")), "foreign character")
    return each.join(roles, ["pos", "paradigm", "role"], "left").select("lexeme", "role", "stem", why.alias("reason")).where("reason is not null")


def stem_from_form(pos: str, paradigm: str, role: str, slot: str, form: str, lemma: str = "") -> str:
    """The form without the slot's ending as measured; ValueError if it ends otherwise."""
    ending = P.SPEC[P.family(pos), P.resolve(pos, paradigm, lemma)][role].get(slot)
    if ending is None:
        raise ValueError(f"{slot} is no slot of {role}")
    measured = accented(SENTINEL + ending).removeprefix(SENTINEL)
    if not form.endswith(measured):
        raise ValueError(f"{form} does not end in {measured}")
    return form[: len(form) - len(measured)]
