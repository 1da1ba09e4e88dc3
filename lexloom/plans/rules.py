"""Queries over context rules, each with its SQL: readings come from the last letter of a word, so every word type has an entry."""

from pyspark.sql import functions as F

from ..operators import constraints, statistics
from ..sources import nvh
from ..storage import spread
from .corpus import _PIECES, _TOKENS, _table

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: One grammar of fixed offsets, where a later rule brings an earlier one about again, and one of parents, children and siblings.
OFFSETS = """
DELIMITERS = "<.>" "<!>" "<?>" ;
LIST N = N ; LIST V = V ; LIST Pr = Pr ; LIST Acc = Acc ;
SECTION
SELECT:object N IF (0 Acc) (-1C Pr) ;
REMOVE:no-verb V IF (1C Pr) ;
SELECT:preposition Pr IF (1 Acc) (NOT -1 Pr) ;
"""
FAMILY = """
DELIMITERS = "<.>" "<!>" "<?>" ;
LIST N = N ; LIST Adv = Adv ; LIST Pr = Pr ;
SECTION
SETPARENT:object N TO (-1 Pr) ;
SETPARENT:far Adv TO (-2 Pr) ;
SETPARENT:back Pr TO (1 N) ;
SECTION
ADDRELATION (obj) N TO (p Pr) ;
ADDRELATION (mod) Adv TO (p Pr) ;
ADD:governor (&gov) Pr IF (c N) ;
ADD:pair (&pair) Adv IF (s N) ;
ADD:lone (&lone) N IF (NOT p (*)) ;
ADD:deep (&deep) N IF (p Pr LINK p Pr) ;
"""

# Kinds of words: P a preposition, W noun or verb, A noun or adjective in the accusative, S adverb or preposition, N a noun.
_KIND = r"CASE WHEN t IN ('.', '!', '?') THEN '.' WHEN NOT regexp_matches(t, '^\p{L}') THEN ',' WHEN length(t) <= 2 THEN 'P' WHEN right(lower(t), 1) IN ('a', 'e', 'i', 'o', 'u') THEN 'W' WHEN right(lower(t), 1) IN ('n', 'm') THEN 'A' WHEN right(lower(t), 1) IN ('s', 't') THEN 'S' ELSE 'N' END"
_WORDS = f"""
p AS (SELECT conv_id, turn, unnest({_PIECES}) AS text, generate_subscripts({_PIECES}, 1) - 1 AS i FROM conversations),
t AS (SELECT 'text-' || conv_id || '-' || turn || '-' || i AS sent_id, unnest({_TOKENS}) AS t, generate_subscripts({_TOKENS}, 1) - 1 AS pos FROM p),
k AS (SELECT *, {_KIND} AS k FROM t),
w AS (SELECT *, coalesce(sum(CASE WHEN k = '.' THEN 1 ELSE 0 END) OVER (PARTITION BY sent_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS win FROM k),
n AS (SELECT *, lag(k, 1, '') OVER s AS k1, lag(k, 2, '') OVER s AS k2, lag(k, 3, '') OVER s AS k3, lead(k, 1, '') OVER s AS r1, lead(k, 2, '') OVER s AS r2 FROM w WINDOW s AS (PARTITION BY sent_id, win ORDER BY pos))"""


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _cohorts(spark, d):
    """The sentences of the conversations, with readings by the last letter."""
    talk = _table(spark, d, "conversations").select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("doc_id"), "text")
    sentences = nvh.sentences_of_text(spread(talk))
    types = sentences.select(F.explode("tokens").alias("token")).where(F.col("token").rlike(r"^\p{L}")).distinct()
    lemma = F.lower("token")
    last = F.right(lemma, F.lit(1))
    read = lambda *tags: F.struct(lemma.alias("lemma"), F.array(*map(F.lit, tags)).alias("tags"))
    readings = (
        F.when(F.length("token") <= 2, F.array(read("Pr"))).when(last.isin(*"aeiou"), F.array(read("N", "Nom"), read("V", "Prs")))
        .when(last.isin("n", "m"), F.array(read("A", "Acc"), read("N", "Acc"))).when(last.isin("s", "t"), F.array(read("Adv"), read("Pr")))
        .when(last == "r", F.array(read("N", "Gen"), read("N", "Nom"))).otherwise(F.array(read("N", "Nom")))
    )
    return constraints.cohorts_of(sentences, types.select("token", readings.alias("readings")))


def _ruled(spark, d):
    return constraints.analysed(_cohorts(spark, d), [OFFSETS], interpret=False)


# A preposition that is chosen in the first pass makes the words beside it fit in the second.
_CHOSEN = "({0} = 'S' AND {1} = 'A' AND {2} NOT IN ('P', 'S'))"


@query(f"""
WITH {_WORDS},
f AS (SELECT *, {_CHOSEN.format("k", "r1", "k1")} AS chosen, {_CHOSEN.format("k1", "k", "k2")} AS chosen_before, {_CHOSEN.format("r1", "r2", "k")} AS chosen_after FROM n)
SELECT sent_id, pos::BIGINT AS pos, t AS form, 'object' AS rule, CASE WHEN k1 = 'P' THEN 1 ELSE 2 END::BIGINT AS pass, lower(t) || '+A+Acc' AS reading FROM f WHERE k = 'A' AND (k1 = 'P' OR chosen_before)
UNION ALL SELECT sent_id, pos, t, 'no-verb', CASE WHEN r1 = 'P' THEN 1 ELSE 2 END, lower(t) || '+V+Prs' FROM f WHERE k = 'W' AND (r1 = 'P' OR chosen_after)
UNION ALL SELECT sent_id, pos, t, 'preposition', 1, lower(t) || '+Adv' FROM f WHERE chosen
""")
def rule_trace(spark, d):
    """Every reading that rules on fixed offsets remove, with the rule and the pass."""
    done = _ruled(spark, d)
    return constraints.removals(done).select("sent_id", F.col("pos").cast("long").alias("pos"), "form", "rule", F.col("pass").cast("long").alias("pass"), "reading")


@query(f"""
WITH {_WORDS},
f AS (SELECT * FROM n)
SELECT rule, count(*) AS n FROM (
  SELECT 'object' AS rule FROM f WHERE k = 'A' AND (k1 = 'P' OR {_CHOSEN.format("k1", "k", "k2")})
  UNION ALL SELECT 'no-verb' FROM f WHERE k = 'W' AND (r1 = 'P' OR {_CHOSEN.format("r1", "r2", "k")})
  UNION ALL SELECT 'preposition' FROM f WHERE {_CHOSEN.format("k", "r1", "k1")}) GROUP BY rule
""")
def removals_by_rule(spark, d):
    return constraints.removals(_ruled(spark, d)).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH {_WORDS},
f AS (SELECT *, k1 IN ('P', 'S') AND k IN ('W', 'A', 'N') AS object, k = 'S' AND k2 IN ('P', 'S') AS far, k IN ('W', 'A', 'N') AS noun FROM n),
e AS (SELECT sent_id, pos, t AS form, CASE WHEN object THEN pos - 1 WHEN far THEN pos - 2 END AS parent, CASE WHEN object THEN 'obj' WHEN far THEN 'mod' ELSE '' END AS label,
  list_sort(list_filter([CASE WHEN k IN ('P', 'S') AND r1 IN ('W', 'A', 'N') THEN '&gov' END, CASE WHEN far AND k1 IN ('W', 'A', 'N') THEN '&pair' END, CASE WHEN noun AND NOT object THEN '&lone' END,
    CASE WHEN object AND k1 = 'S' AND k3 IN ('P', 'S') THEN '&deep' END], lambda x: x IS NOT NULL)) AS errors FROM f)
SELECT sent_id, pos::BIGINT AS pos, form, parent::BIGINT AS parent, label, array_to_string(errors, ' ') AS errors FROM e WHERE parent IS NOT NULL OR len(errors) > 0
""")
def rule_family(spark, d):
    """Attachments, labels and error tags by rules over parents, children and siblings; those that would close a loop are refused."""
    done = constraints.analysed(_cohorts(spark, d), [FAMILY], interpret=False)
    # Filtered within the array: the planner would ask for the size of an exploded column first, and run the rules again for that.
    hit = F.filter(F.transform("cohorts", lambda c, i: F.struct(i.alias("pos"), c.alias("c"))), lambda x: x["c"]["parent"].isNotNull() | (F.size(x["c"]["errors"]) > 0))
    rows = done.select("sent_id", F.explode(hit).alias("x")).select("sent_id", "x.pos", "x.c")
    label = F.array_join(F.transform("c.relations", lambda r: r["label"]), " ")
    return rows.select("sent_id", F.col("pos").cast("long").alias("pos"), F.col("c.form").alias("form"), F.col("c.parent").cast("long").alias("parent"), label.alias("label"), F.array_join(F.array_sort("c.errors"), " ").alias("errors"))


# Readings of a word before the rules, and how many of them they remove.
_OPEN = f"""{_WORDS},
o AS (SELECT k, CASE WHEN k IN ('W', 'A', 'S') OR (k = 'N' AND right(lower(t), 1) = 'r') THEN 2 ELSE 1 END AS n,
  CASE WHEN k = 'A' AND (k1 = 'P' OR {_CHOSEN.format("k1", "k", "k2")}) OR k = 'W' AND (r1 = 'P' OR {_CHOSEN.format("r1", "r2", "k")}) OR {_CHOSEN.format("k", "r1", "k1")} THEN 1 ELSE 0 END AS lost FROM n WHERE k NOT IN ('.', ','))"""
_NUMBERS = "count(*) AS word_tokens, 0.0::DOUBLE AS unknown_pct, 0::BIGINT AS collapsed, 0.0::DOUBLE AS collapsed_pct, round(sum({0})::DOUBLE / count(*), 6) AS avg_readings, round(100.0::DOUBLE * count(*) FILTER ({0} = 1) / count(*), 6) AS unambiguous_pct FROM o"


@query(f"WITH {_OPEN} SELECT 'before' AS state, {_NUMBERS.format('n')} UNION ALL SELECT 'after', {_NUMBERS.format('(n - lost)')}")
def cohort_ambiguity(spark, d):
    """Ambiguity of the cohorts before and after the rules."""
    before, after = (statistics.ambiguity_of(df).withColumn("state", F.lit(name)) for name, df in (("before", _cohorts(spark, d)), ("after", _ruled(spark, d))))
    return before.unionByName(after)


@query(f"""
WITH {_OPEN} SELECT CASE k WHEN 'N' THEN 'sig' ELSE 'pos' END AS kind, CASE k WHEN 'W' THEN 'N|V' WHEN 'A' THEN 'A|N' WHEN 'S' THEN 'Adv|Pr' ELSE 'N: Gen | Nom' END AS pair, count(*) AS n
FROM o WHERE n - lost > 1 GROUP BY ALL
""")
def cohort_pairs(spark, d):
    """What is still confused after the rules: parts of speech, or tags of one."""
    return statistics.pairs_of(_ruled(spark, d))
