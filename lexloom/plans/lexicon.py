"""Queries over paradigms, lexicon entries and context rules."""

from pyspark.sql import functions as F

from ..operators import baking, compression, constraints, generation, linking, lookup, statistics, validation
from ..operators import paradigms as P
from ..sources import nvh
from ..sources.lexicon import analysis_table
from ..storage import spread
from . import api
from .corpus import _COUNTS, _READINGS, _TOKENS, _TYPES, _WORD, _table

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: A small grammar in the notation that users' grammars have.
DEMO_GRAMMAR = """
DELIMITERS = "<.>" "<!>" "<?>" ;
LIST N = N ; LIST V = V ; LIST Pron = Pron ; LIST Nom = Nom ; LIST Acc = Acc ; LIST Pcle = Pcle ; LIST CC = CC ; LIST CS = CS ; LIST Word = Pron CC CS Adv Num V Pcle ;
LIST Encl = Encl ; LIST CLB = CLB ; LIST PUNCT = PUNCT ; LIST Unk = Unk ;
SET Clause = CLB OR PUNCT OR CS ;
SECTION
REMOVE:encl-acc SAFE (Acc) IF (0 Encl) (NOT -1* V BARRIER Clause) ;
SELECT:conj CC IF (-1 Pron) (1 Pron) ;
SECTION
SETPARENT:to-verb Pron TO (1* V BARRIER Clause) ;
SETPARENT:to-next Pcle TO (1 Pron OR Unk) ;
ADD:double-nom (&subj-dup) Pron + Nom IF (0C Nom) (1C Pron + Nom) ;
SECTION
ADDRELATION (nsubj) Pron + Nom TO (p V) ;
ADDRELATION (advmod) Pcle TO (p (*)) ;
"""


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


_SINGLE = "translate(token, 'āēīōū', 'aeiou')"
for _c in generation.DOUBLE:
    _SINGLE = f"replace({_SINGLE}, '{_c * 2}', '{_c}')"
_ALPHABET = "".join(sorted(P.STEM_ALPHABET - set("^~>")))


@query(f"""
SELECT token, slot, CASE slot WHEN 'sg.nom' THEN s || 'ē' WHEN 'pl.dat' THEN s || 'īmans' WHEN 'sg.gen' THEN token || 'is' WHEN 'sg.dat' THEN token || 'ei' WHEN 'sg.acc' THEN token || 'in'
  WHEN 'pl.nom' THEN token || 'is' WHEN 'pl.gen' THEN token || 'in' ELSE token || 'ins' END AS surface
FROM (SELECT token, {_SINGLE} AS s, unnest({list(P.DECLINED)!r}) AS slot FROM ({_TYPES}) WHERE regexp_full_match(token, '[{_ALPHABET}]*') AND token NOT LIKE '%ē')
""")
def paradigm_expand(spark, d):
    """Each word type of the documents as the stem of one noun paradigm."""
    types = lookup.word_types(_table(spark, d, "documents")).where("token not like '%ē'")
    lexemes = types.select(F.col("token").alias("lexeme"), F.lit("noun").alias("pos"), F.lit("53").alias("paradigm"), F.col("token").alias("lemma"), F.lit(None).cast("map<string,string>").alias("stems"))
    return generation.generate(lexemes).select(F.col("lexeme").alias("token"), "slot", F.array_join("surfaces", "|").alias("surface"))


# All paradigms: each word type of the conversations is the stem of every role of one of them, which its letters choose.
_PARADIGMS = sorted({r[:2] for r in P.ROLES})
_SAID = _TYPES.replace("documents", "conversations")
_PICK = f"(ascii(token) + 7 * ascii(right(token, 1)) + 31 * length(token)) % {len(_PARADIGMS)}"
_STEMS = f"SELECT token, {_PICK} AS k FROM ({_SAID}) WHERE regexp_full_match(token, '[{_ALPHABET}]*')"


def _accent_sql(stem: str, ending: str) -> str:
    """The accent rules for endings whose markers come first."""
    short = f"translate({stem}, 'āēīōū', 'aeiou')"
    single = short
    for c in generation.DOUBLE:
        single = f"replace({single}, '{c * 2}', '{c}')"
    form = f"""CASE WHEN {ending} LIKE '^%' THEN {single} || {ending}[2:] WHEN {ending} LIKE '~^%' THEN {short} || {ending}[3:]
      WHEN {ending} LIKE '>%' THEN {stem} || CASE WHEN contains('{generation.DOUBLE}', right({stem}, 1)) THEN right({stem}, 1) ELSE '' END || {ending}[2:] ELSE {stem} || {ending} END"""
    return f"list_transform([{form}], lambda f: CASE WHEN f[-1] = 's' AND f[-2] = f[-3] AND contains('{generation.DOUBLE}', f[-2]) THEN f[:-3] || 's' ELSE f END)[1]"


def _roles_sql() -> str:
    """k (number of the paradigm), pos, paradigm, role, slot, ending, measured of all roles."""
    rows = [(_PARADIGMS.index(r[:2]), *r, generation.accented(generation.SENTINEL + r[4]).removeprefix(generation.SENTINEL)) for r in P.ROLES]
    return "SELECT * FROM (VALUES " + ", ".join(str(r) for r in rows) + ") r(k, pos, paradigm, role, slot, ending, measured)"


def _all_stems(spark, d):
    t = lookup.word_types(_table(spark, d, "conversations")).where(generation.usable(F.col("token")))
    pairs = F.array(*(F.struct(F.lit(a).alias("pos"), F.lit(b).alias("paradigm")) for a, b in _PARADIGMS))
    t = t.withColumn("p", F.get(pairs, F.expr(_PICK)))
    roles = F.array(*map(F.lit, sorted({r[2] for r in P.ROLES})))
    stems = F.map_from_arrays(roles, F.transform(roles, lambda r: F.col("token")))
    return t.select(F.col("token").alias("lexeme"), "p.pos", "p.paradigm", F.concat("token", F.when(F.col("p.paradigm") == "87a", "ndtun").otherwise("tun")).alias("lemma"), stems.alias("stems"))


@query(f"""
WITH r AS ({_roles_sql()}), f AS (SELECT token, pos, paradigm, slot, {_accent_sql("token", "ending")} AS surface FROM ({_STEMS}) t JOIN r ON t.k = r.k)
SELECT token, pos, paradigm, slot, string_agg(DISTINCT surface, '|' ORDER BY surface) AS surfaces FROM f GROUP BY ALL
""")
def role_forms(spark, d):
    """All forms of all paradigms: nouns, adjectives and verbs with their participles."""
    lexemes = _all_stems(spark, d)
    made = generation.generate(lexemes).join(lexemes.select("lexeme", "pos", "paradigm"), "lexeme")
    return made.select(F.col("lexeme").alias("token"), "pos", "paradigm", "slot", F.array_join("surfaces", "|").alias("surfaces"))


@query(f"""
WITH r AS ({_roles_sql()}), f AS (SELECT r.*, token, {_accent_sql("token", "ending")} AS surface FROM ({_STEMS}) t JOIN r ON t.k = r.k),
b AS (SELECT *, CASE WHEN ends_with(surface, measured) THEN left(surface, length(surface) - length(measured)) END AS rest FROM f)
SELECT pos, paradigm, role, count(*) AS cells, count(rest) AS stripped, count(*) FILTER ({_accent_sql("rest", "ending")} = surface) AS regenerated, count(*) FILTER (rest = token) AS same_stem FROM b GROUP BY ALL
""")
def role_agreement(spark, d):
    """Generation against analysis for every role of every paradigm."""
    return generation.agreement(_all_stems(spark, d))


# Every word type of plain letters is a lexeme of one noun paradigm: its nominative follows the lemma, up to three other cells follow
# a shorter stem, so that rules, stems and overrides all have a part.
_PLAIN = f"SELECT token AS t, left(token, length(token) - 1) AS u, length(token) % 4 AS k FROM ({_TYPES}) WHERE regexp_full_match(token, '[abcdefghijklmnoprstuvwyz]{{4,}}') AND token[-1] <> token[-2] AND token[-2] <> token[-3]"
_SHORT_CELLS = (("sg.gen", "as"), ("sg.dat", "u"), ("sg.acc", "an"))


def _type_cells(spark, d):
    """(lexemes, attested cells) of the word types."""
    t = lookup.word_types(_table(spark, d, "documents")).where("token rlike '^[abcdefghijklmnoprstuvwyz]{4,}$'")
    t = t.where((F.substring("token", -1, 1) != F.substring("token", -2, 1)) & (F.substring("token", -2, 1) != F.substring("token", -3, 1)))
    u, k = F.expr("left(token, length(token) - 1)"), F.length("token") % 4
    lexemes = t.select(F.col("token").alias("lexeme"), F.lit("noun").alias("pos"), F.lit("32").alias("paradigm"), F.concat("token", F.lit("s")).alias("lemma"), F.lit(None).cast("map<string,string>").alias("stems"))
    cell = lambda slot, surface: F.struct(F.lit(slot).alias("slot"), surface.alias("surface"))
    cells = F.array(cell("sg.nom", F.concat("token", F.lit("s"))), *(F.when(k > i, cell(s, F.concat(u, F.lit(e)))) for i, (s, e) in enumerate(_SHORT_CELLS)))
    return lexemes, t.select(F.col("token").alias("lexeme"), F.explode(F.array_compact(cells)).alias("c")).select("lexeme", "c.slot", "c.surface")


@query(f"SELECT t AS lexeme, 'obl' AS role, u AS stem FROM ({_PLAIN}) WHERE k > 0")
def stem_candidates(spark, d):
    return compression.candidates(*_type_cells(spark, d)).select("lexeme", "role", "stem")


@query(f"SELECT t AS lexeme, 'obl' AS role, u AS stem, (k - 1)::BIGINT AS gain FROM ({_PLAIN}) WHERE k > 1")
def greedy_stem(spark, d):
    return compression.best_stems(*_type_cells(spark, d))


@query(f"SELECT t AS lexeme, CASE WHEN k = 1 THEN 'sg.gen' ELSE 'sg.nom' END AS slot, CASE WHEN k = 1 THEN u || 'as' ELSE t || 's' END AS surfaces FROM ({_PLAIN}) WHERE k > 0")
def compressed_overrides(spark, d):
    _, replaced = compression.compress(*_type_cells(spark, d))
    return replaced.select("lexeme", "slot", F.array_join("attested", "|").alias("surfaces"))


@query(f"""
WITH s AS (SELECT sum(1 + k)::BIGINT AS cells, count(*) AS by_rule, sum(CASE WHEN k > 1 THEN k ELSE 1 END)::BIGINT AS by_stem FROM ({_PLAIN}))
SELECT 'noun' AS pos, '32' AS paradigm, * FROM s UNION ALL SELECT 'noun', NULL, * FROM s UNION ALL SELECT NULL, NULL, * FROM s
""")
def compression_coverage(spark, d):
    return compression.coverage(*_type_cells(spark, d))


@query(f"""
SELECT t AS lexeme, 'ok' AS status, CASE WHEN k > 1 THEN 'obl=' || u ELSE '' END AS stems, CASE WHEN k = 0 THEN '' WHEN k = 1 THEN 'sg.gen=' || u || 'as' ELSE 'sg.nom=' || t || 's' END AS overrides,
  (1 + k)::BIGINT AS cells, 1::BIGINT AS by_rule, (CASE WHEN k > 1 THEN k ELSE 1 END)::BIGINT AS by_stem, CASE WHEN k = 0 THEN 1 ELSE 2 END AS rounds, false AS unstable FROM ({_PLAIN})
""")
def derived_entries(spark, d):
    """The whole derivation of each lexeme."""
    found = compression.derive(*_type_cells(spark, d))
    joined = lambda c, v: F.array_join(F.array_sort(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), v(e["value"])))), " ")
    return found.select("lexeme", "status", joined("stems", lambda v: v).alias("stems"), joined("overrides", lambda v: F.array_join(v, "|")).alias("overrides"), "cells", "by_rule", "by_stem", "rounds", "unstable")


@query(f"""
SELECT coalesce(g.token, o.token) AS lexeme, 'sg.nom' AS slot, CASE WHEN o.token IS NOT NULL THEN o.token || 'as' ELSE g.token || 's' END AS surfaces
FROM (SELECT token FROM ({_TYPES})) g FULL JOIN (SELECT token FROM ({_TYPES.replace("documents", "benchmark")})) o ON g.token = o.token
""")
def override_merge(spark, d):
    """Cells from the word types of the documents, replaced by those of the benchmark."""
    cells = lambda name, end, column: lookup.word_types(_table(spark, d, name)).select(F.col("token").alias("lexeme"), F.lit("sg.nom").alias("slot"), F.array(F.concat("token", F.lit(end))).alias(column))
    return compression.merged(cells("documents", "s", "surfaces"), cells("benchmark", "as", "attested")).select("lexeme", "slot", F.array_join("surfaces", "|").alias("surfaces"))


_BENCH = _TYPES.replace("documents", "benchmark")


@query(f"""
WITH d AS (SELECT token FROM ({_TYPES})), b AS (SELECT token FROM ({_BENCH}))
SELECT token AS surface, 'missing' AS side FROM (SELECT * FROM b EXCEPT SELECT * FROM d) UNION ALL SELECT token, 'extra' FROM (SELECT * FROM d EXCEPT SELECT * FROM b)
""")
def parity_diff(spark, d):
    """Word types of the benchmark against those of the documents."""
    gold, got = (lookup.word_types(_table(spark, d, t)).select(F.col("token").alias("surface")) for t in ("benchmark", "documents"))
    return baking.parity(gold, got)


@query(f"""
SELECT lang, source, sum(n)::BIGINT AS n_words, sum(CASE WHEN r.token IS NOT NULL THEN n ELSE 0 END)::BIGINT AS n_known
FROM ({_COUNTS.replace("lang", "lang, source")}) c LEFT JOIN ({_READINGS}) r ON c.token = r.token GROUP BY GROUPING SETS ((lang, source), (lang), ())
""")
def coverage_report(spark, d):
    """Known words by language and source, with all subtotals."""
    counts = statistics.word_counts(_table(spark, d, "documents"), ["lang", "source"])
    known = analysis_table(spark).select(F.col("surface").alias("token"), F.lit(True).alias("known")).distinct()
    return counts.join(known, "token", "left").rollup("lang", "source").agg(F.sum("n").alias("n_words"), F.sum(F.when(F.col("known"), F.col("n")).otherwise(0)).alias("n_known"))


@query()
def arrow_links(spark, d):
    """References between a few entries."""
    text = "entry: as\n  pos: pron\n  legacy:\n    desc: ↑Mes, ↑tū [x]\nentry: mes\n  pos: pron\nentry: tū\n  pos: pron\n  legacy:\n    desc: ↑as niswints, ↑tēn\n"
    entries = spark.createDataFrame([{k: v for k, v in e.items()} for e in nvh.parse(text)], nvh.ENTRY)
    links, gaps = linking.resolve_corpus(entries, analysis_table(spark))
    return links.select("id", "ref", "method", F.array_join("target_ids", "|").alias("targets")).union(gaps.select("id", "ref", F.lit("gap"), F.lit("")))


def _analysed(spark, d):
    talk = _table(spark, d, "conversations").select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("doc_id"), "text")
    return api.analyze(spread(talk), analysis_table(spark), [DEMO_GRAMMAR], snapshot=2)


@query()
def validate_status(spark, d):
    return validation.summary(validation.validated(_analysed(spark, d)))


@query()
def conllu_export(spark, d):
    return validation.conllu(_analysed(spark, d)).where("block is not null")


@query()
def dep_labels(spark, d):
    attached = F.filter(F.transform("cohorts", lambda c, i: F.struct(i.alias("pos"), c.alias("c"))), lambda x: x["c"]["parent"].isNotNull())
    rows = _analysed(spark, d).select("sent_id", F.explode(attached).alias("x")).select("sent_id", "x.pos", "x.c")
    return rows.select("sent_id", "pos", F.col("c.form").alias("form"), F.col("c.parent").alias("parent"), F.get("c.relations", F.lit(0))["label"].alias("label"))
