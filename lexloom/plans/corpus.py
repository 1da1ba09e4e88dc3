"""Queries over the text tables, each with its SQL for DuckDB."""

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import lookup, statistics
from ..sources.lexicon import SHORT_PREPOSITIONS, analysis_table, values_sql

QUERIES: dict = {}
SQL: dict[str, str] = {}

_TOKENS = "regexp_extract_all(text, '" + tx.TOKEN.replace("'", "''") + "')"
_WORD = r"regexp_matches(token, '^\p{L}')"
_COUNTS = f"SELECT lang, token, count(*) AS n FROM (SELECT lang, unnest({_TOKENS}) AS token FROM documents) WHERE {_WORD} GROUP BY ALL"
_TYPES = f"SELECT token, count(*) AS n FROM (SELECT unnest({_TOKENS}) AS token FROM documents) WHERE {_WORD} GROUP BY ALL"
_LEXICON = values_sql()
_READINGS = f"SELECT surface AS token, list_sort(list(DISTINCT struct_pack(lemma := lemma, tags := tags))) AS readings FROM ({_LEXICON}) GROUP BY surface"
_PIECES = r"list_filter(string_split(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '([.!?])\s+', '\1' || chr(31), 'g'), chr(31)), lambda x: true)"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _readings(spark):
    return analysis_table(spark).groupBy(F.col("surface").alias("token")).agg(F.array_sort(F.collect_set(F.struct("lemma", "tags"))).alias("readings"))


@query(f"SELECT doc_id, len({_TOKENS})::BIGINT AS n_tokens, len(list_filter({_TOKENS}, lambda token: {_WORD}))::BIGINT AS n_words FROM documents")
def token_counts(spark, d):
    tokens = tx.tokenize("text")
    return _table(spark, d, "documents").select("doc_id", F.size(tokens).cast("long").alias("n_tokens"), F.size(F.filter(tokens, lambda t: t.rlike(r"^\p{L}"))).cast("long").alias("n_words"))


@query(
    f"SELECT doc_id, len({_PIECES})::BIGINT AS n_pieces, len(list_filter({_PIECES}, lambda p: regexp_matches(p, '{tx.TOKEN.replace(chr(39), chr(39) * 2)}')))::BIGINT AS n_sentences FROM documents"
)
def sentence_split(spark, d):
    pieces = tx.sentences("text")
    return _table(spark, d, "documents").select("doc_id", F.size(pieces).cast("long").alias("n_pieces"), F.size(F.filter(pieces, lambda p: p.rlike(tx.TOKEN))).cast("long").alias("n_sentences"))


@query(
    f"SELECT lang, CASE WHEN token IN ('.', '!', '?') THEN 'CLB' WHEN NOT {_WORD} THEN 'PUNCT' ELSE 'WORD' END AS class, count(*) AS n FROM (SELECT lang, unnest({_TOKENS}) AS token FROM documents) GROUP BY ALL"
)
def cohort_classes(spark, d):
    tokens = _table(spark, d, "documents").select("lang", F.explode(tx.tokenize("text")).alias("token"))
    return tokens.groupBy("lang", statistics.cohort_class().alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query(_TYPES)
def token_types(spark, d):
    return lookup.word_types(_table(spark, d, "documents"))


@query(f"SELECT lang, token, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, token) AS rank FROM ({_COUNTS})) WHERE rank <= 8")
def top_types_by_lang(spark, d):
    counts = statistics.word_counts(_table(spark, d, "documents"), ["lang"])
    return statistics.top(counts, ["lang"], [F.desc("n"), "token"], 8).withColumn("rank", F.col("rank").cast("long"))


@query(f"SELECT token, n, lemma, array_to_string(tags, '+') AS tags FROM ({_TYPES}) t JOIN ({_LEXICON}) l ON token = surface")
def lookup_exact(spark, d):
    return lookup.exact(lookup.word_types(_table(spark, d, "documents")), analysis_table(spark)).select("token", "n", "lemma", F.concat_ws("+", "tags").alias("tags"))


_SHORT = "CASE lower(token) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SHORT_PREPOSITIONS.items()) + " END"


@query(f"""
WITH t AS MATERIALIZED ({_TYPES}), r AS MATERIALIZED (SELECT token, len(readings) AS n_readings FROM ({_READINGS})),
p AS (SELECT token, n, 0 AS k, token AS probe FROM t UNION ALL SELECT token, n, 1, lower(token) FROM t
  UNION ALL SELECT token, n, 2, upper(token[1]) || token[2:] FROM t UNION ALL SELECT token, n, 3, {_SHORT} FROM t),
h AS MATERIALIZED (SELECT p.token, min(k) AS k, min_by(n_readings, k) AS n_readings FROM p JOIN r ON probe = r.token GROUP BY p.token)
SELECT t.token, n, (['surface', 'lower', 'title', 'preposition'])[k + 1] AS stage, coalesce(n_readings, 0)::BIGINT AS n_readings FROM t LEFT JOIN h USING (token)
""")
def lookup_cascade(spark, d):
    found = lookup.cascade(lookup.word_types(_table(spark, d, "documents")), analysis_table(spark))
    return found.select("token", "n", "stage", F.size("readings").cast("long").alias("n_readings"))


_ASKED = ["+Pron+P1+Sg+Dat", "+Pron+P3+Sg+Acc+Msc", "+Pron+P1+Encl+Sg+Acc", "+Pron+P3+Msc+Sg+Acc", "+CC", "+Pcle"]


@query(f"""
WITH q AS (SELECT DISTINCT lower(token) || tags AS analysis FROM ({_TYPES}) CROSS JOIN (SELECT unnest({_ASKED!r}) AS tags))
SELECT q.analysis, coalesce(string_agg(DISTINCT surface, '|' ORDER BY surface), '') AS surfaces FROM q LEFT JOIN ({_LEXICON}) l ON q.analysis = l.analysis GROUP BY ALL
""")
def generate_lookup(spark, d):
    """Each word type of the documents as a lemma, with a few tag strings."""
    types = lookup.word_types(_table(spark, d, "documents"))
    asked = types.select(F.explode(F.array(*(F.concat(F.lower("token"), F.lit(t)) for t in _ASKED))).alias("analysis"))
    return lookup.surfaces_of(asked, analysis_table(spark)).select("analysis", F.concat_ws("|", "surfaces").alias("surfaces"))


_FOLD = "translate({}, 'āēīōūĀĒĪŌŪ', 'aeiouAEIOU')"


@query(f"""
SELECT DISTINCT token, n, surface FROM ({_TYPES}) t JOIN ({_LEXICON}) l ON {_FOLD.format("token")} = {_FOLD.format("surface")}
WHERE len(list_filter(range(1, length(token) + 1), lambda i: NOT (token[i] = surface[i] OR (surface[i] IN ('ā','ē','ī','ō','ū') AND token[i] = {_FOLD.format("surface[i]")})))) = 0
""")
def lenient_macron(spark, d):
    types = lookup.word_types(_table(spark, d, "documents")).withColumn("key", lookup.macron_fold("token"))
    near = types.join(analysis_table(spark).withColumn("key", lookup.macron_fold("surface")), "key").where(lookup.macron_accepts("token", "surface"))
    return near.select("token", "n", "surface").distinct()


@query(f"""
SELECT lang, sum(n)::BIGINT AS word_tokens, round(100.0::DOUBLE * sum(CASE WHEN k = 0 THEN n ELSE 0 END) / sum(n), 6) AS unknown_pct,
  CASE WHEN sum(CASE WHEN k > 0 THEN n ELSE 0 END) > 0 THEN round(sum(n * k)::DOUBLE / sum(CASE WHEN k > 0 THEN n ELSE 0 END), 6) ELSE 0 END AS avg_readings,
  CASE WHEN sum(CASE WHEN k > 0 THEN n ELSE 0 END) > 0 THEN round(100.0::DOUBLE * sum(CASE WHEN k = 1 THEN n ELSE 0 END) / sum(CASE WHEN k > 0 THEN n ELSE 0 END), 6) ELSE 0 END AS unambiguous_pct
FROM (SELECT lang, n, coalesce(len(readings), 0) AS k FROM ({_COUNTS}) c LEFT JOIN ({_READINGS}) r ON c.token = r.token) GROUP BY lang
""")
def ambiguity_stats(spark, d):
    return statistics.ambiguity(statistics.word_counts(_table(spark, d, "documents"), ["lang"]), _readings(spark), ["lang"])


_CONFUSED = f"""SELECT c.lang, c.n, list_sort(list_distinct(list_transform(readings, lambda r: r.tags[1]))) AS pos, list_sort(list_distinct(list_transform(readings, lambda r: array_to_string(r.tags[2:], '+')))) AS sigs
  FROM ({_COUNTS}) c JOIN ({_READINGS}) r ON c.token = r.token WHERE len(readings) > 1"""


@query(f"SELECT lang, array_to_string(pos, '|') AS pair, sum(n)::BIGINT AS n FROM ({_CONFUSED}) WHERE len(pos) > 1 GROUP BY ALL")
def pos_pairs(spark, d):
    found = statistics.pairs(statistics.word_counts(_table(spark, d, "documents"), ["lang"]), _readings(spark), ["lang"])
    return found.where("kind = 'pos'").drop("kind")


@query(f"SELECT lang, pos[1] || ': ' || array_to_string(sigs, ' | ') AS pair, sum(n)::BIGINT AS n FROM ({_CONFUSED}) WHERE len(pos) = 1 GROUP BY ALL")
def sig_pairs(spark, d):
    """Words of one part of speech whose tags differ."""
    found = statistics.pairs(statistics.word_counts(_table(spark, d, "documents"), ["lang"]), _readings(spark), ["lang"])
    return found.where("kind = 'sig'").drop("kind")


@query(f"""
SELECT doc_id, count(*) AS n_words, sum(CASE WHEN r.token IS NULL THEN 1 ELSE 0 END)::BIGINT AS n_unknown, sum(CASE WHEN r.token IS NULL THEN 1 ELSE 0 END) > 0.5 * count(*) AS foreign_text
FROM (SELECT doc_id, unnest({_TOKENS}) AS token FROM documents) w LEFT JOIN ({_READINGS}) r ON w.token = r.token WHERE {_WORD.replace("token", "w.token")} GROUP BY doc_id
""")
def oov_ratio(spark, d):
    words = _table(spark, d, "documents").select("doc_id", F.explode(tx.tokenize("text")).alias("token")).where(F.col("token").rlike(r"^\p{L}"))
    known = F.broadcast(analysis_table(spark).select(F.col("surface").alias("token"), F.lit(1).alias("known")).distinct())  # the closed classes: some dozen rows
    unknown = F.sum(F.when(F.col("known").isNull(), 1).otherwise(0))
    return words.join(known, "token", "left").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_words"), unknown.alias("n_unknown"), (unknown > 0.5 * F.count(F.lit(1))).alias("foreign_text"))


@query(f"""
WITH p AS (SELECT doc_id, unnest({_PIECES}) AS text, generate_subscripts({_PIECES}, 1) - 1 AS pos FROM documents),
w AS (SELECT doc_id, pos, unnest({_TOKENS}) AS token FROM p)
SELECT doc_id, pos::BIGINT AS pos, count(*) AS n_ambiguous FROM w JOIN ({_READINGS}) r ON w.token = r.token WHERE len(readings) > 1 GROUP BY ALL ORDER BY n_ambiguous DESC, doc_id, pos LIMIT 20
""")
def top_ambiguous(spark, d):
    pieces = _table(spark, d, "documents").select("doc_id", F.posexplode(tx.sentences("text")).alias("pos", "piece"))
    words = pieces.select("doc_id", F.col("pos").cast("long").alias("pos"), F.explode(tx.tokenize("piece")).alias("token"))
    several = F.broadcast(_readings(spark).where(F.size("readings") > 1).select("token"))
    return words.join(several, "token").groupBy("doc_id", "pos").agg(F.count(F.lit(1)).alias("n_ambiguous")).orderBy(F.desc("n_ambiguous"), "doc_id", "pos").limit(20)


@query(f"""
SELECT conv_id, turn, len(t)::BIGINT + (CASE WHEN len(t) = 0 OR t[-1] IN ('.', '!', '?') THEN 0 ELSE 1 END) AS n_cohorts, len(t) > 0 AND t[-1] NOT IN ('.', '!', '?') AS forced
FROM (SELECT conv_id, turn, {_TOKENS} AS t FROM conversations)
""")
def forced_delimiter(spark, d):
    rows = _table(spark, d, "conversations").select("conv_id", "turn", tx.tokenize("text").alias("t"))
    whole = statistics.with_final_delimiter(F.col("t"))
    return rows.select("conv_id", "turn", F.size(whole).cast("long").alias("n_cohorts"), (F.size(whole) > F.size("t")).alias("forced"))


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', '', 'g'), '[\s\x{A0}]+', ' ', 'g')) AS plain FROM pages")
def html_plain(spark, d):
    return _table(spark, d, "pages").select("page_id", tx.without_tags("html").alias("plain"))


@query()
def html_unescaped(spark, d):
    """Tags removed and entities resolved: no SQL resolves all entities."""
    return _table(spark, d, "pages").select("page_id", tx.plain_description("html").alias("plain"))


@query(rf"SELECT doc_id, length(regexp_replace(regexp_replace(text, '{tx.LINK}', '\1', 'g'), '{tx.ADDRESS}', ' ', 'g'))::BIGINT AS n_plain FROM documents")
def markdown_clean(spark, d):
    return _table(spark, d, "documents").select("doc_id", F.length(tx.markdown_plain("text")).cast("long").alias("n_plain"))


@query(f"""
WITH w AS (SELECT doc_id, unnest({_TOKENS}) AS token, generate_subscripts({_TOKENS}, 1) AS i FROM documents),
p AS (SELECT DISTINCT surface, list_filter(tags, lambda t: t IN ('P1', 'P2', 'P3'))[1] AS person FROM ({_LEXICON}) WHERE tags[1] = 'Pron' AND list_contains(tags, 'Nom') AND len(list_filter(tags, lambda t: t IN ('P1', 'P2', 'P3'))) > 0),
m AS (SELECT w.*, person, lead(token) OVER (PARTITION BY doc_id ORDER BY i) AS next_token FROM w LEFT JOIN p ON token = surface),
n AS (SELECT m.doc_id, m.person AS a, q.person AS b FROM m JOIN p q ON m.next_token = q.surface WHERE m.person IS NOT NULL AND m.person <> q.person)
SELECT doc_id, a AS person, b AS next_person, count(*) AS n FROM n GROUP BY ALL
""")
def person_clash(spark, d):
    """Neighbouring nominative pronouns of different persons."""
    tokens = tx.tokenize("text")
    pairs = _table(spark, d, "documents").select("doc_id", F.explode(F.arrays_zip(tokens.alias("a"), F.slice(tokens, 2, 2**30).alias("b"))).alias("p")).select("doc_id", "p.a", "p.b")
    person = F.get(F.filter("tags", lambda t: t.isin("P1", "P2", "P3")), F.lit(0))
    nominative = F.broadcast(analysis_table(spark).where((F.col("tags")[0] == "Pron") & F.array_contains("tags", "Nom")).select("surface", person.alias("person")).where("person is not null").distinct())
    x, y = nominative.select(F.col("surface").alias("a"), "person"), nominative.select(F.col("surface").alias("b"), F.col("person").alias("next_person"))
    return pairs.join(x, "a").join(y, "b").where("person <> next_person").groupBy("doc_id", "person", "next_person").agg(F.count(F.lit(1)).alias("n"))
