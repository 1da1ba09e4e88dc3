"""Mixing sources to target weights by Pareto order sampling.

Targets: the sources in code point order (null last) weigh ``weights`` in turn and share ``share`` of all words; no target
exceeds ``cap`` times its source's words, and the excess is shared anew by weight. A document gets floor(target / source words)
certain copies; the rest of a source's target is drawn without replacement. Inclusion probabilities are in proportion to size,
p = c * size, with c such that the expected words are the rest; documents whose p would reach 1 are taken for certain and c is
solved for the others. The others rank by random odds u / (1 - u) divided by their odds p / (1 - p). Down that order each document
that still fits is taken, so a long document doesn't keep the ones after it out, and what stays open is less than any document left.

No source is gathered in one task. c follows from the words by distinct size. The order is cut by a histogram of log ranks: whole
buckets are summed, and only the rows of the bucket that holds the cut are sorted. What a walk takes is kept as places in the order,
a few for each source, and one filter at the end says which documents those are.

Null texts and texts without words have size 0 and no copies; a null source is a source of its own; rows that repeat a doc_id, and rows
without one, count each for themselves; other columns are kept out of the result unless asked for; an empty table gives an empty
result.
"""

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import drop, staged

WEIGHTS = (5, 2, 1)
SIZE = r"coalesce(regexp_count(text, '[^\\x20\\x09-\\x0D]+'), 0)"
BUCKETS, MOST_SOURCES, STEPS = 1 << 16, 50_000, 2000


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, cap: float = 3.0) -> DataFrame:
    """One row per source: source, source_size, target. The windows run over the sums by source only."""
    turn = F.col("turn") % len(weights)
    weight = F.lit(weights[-1])
    for i, w in enumerate(weights[:-1]):
        weight = F.when(turn == i, F.lit(w)).otherwise(weight)
    by = (
        sized.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("turn", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
        .withColumn("weight", weight.cast("double"))
    )
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy(F.col("source_size") / F.col("weight"), "turn").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("total") - F.col("cap_before")) / (F.col("all_weight") - F.col("weight_before"))
    return (
        by.withColumn("total", F.sum("source_size").over(whole) * F.lit(float(share)))
        .withColumn("all_weight", F.sum("weight").over(whole))
        .withColumn("cap_before", F.coalesce(F.sum(F.lit(float(cap)) * F.col("source_size")).over(before), F.lit(0.0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", level)
        .withColumn("open", F.lit(float(cap)) * F.col("source_size") > F.col("level") * F.col("weight"))
        # The first open source fixes the level of all open ones.
        .withColumn("level", F.min(F.when(F.col("open"), F.struct(F.col("source_size") / F.col("weight"), "turn", "level"))).over(whole)["level"])
        .select("source", "source_size", F.when(F.col("open"), F.col("level") * F.col("weight")).otherwise(F.lit(float(cap)) * F.col("source_size")).alias("target"))
    )


def _small(table: DataFrame) -> tuple[DataFrame, int]:
    """A table of one row a source, worked out, and the number of its rows, as far as ``MOST_SOURCES`` + 1 of them: up to
    ``MOST_SOURCES`` rows (some 5 MB) by the driver, more in files."""
    rows = table.limit(MOST_SOURCES + 1).collect()
    return (table.sparkSession.createDataFrame(rows, table.schema) if len(rows) <= MOST_SOURCES else staged(table, "sources")), len(rows)


def _per_source(rows: DataFrame, table: DataFrame, n_sources: int, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of a table of one row a source, which is broadcast up to ``MOST_SOURCES``."""
    t = table.withColumnRenamed("source", "its_source")
    t = F.broadcast(t) if n_sources <= MOST_SOURCES else t
    return rows.join(t, rows["source"].eqNullSafe(t["its_source"]), how).drop("its_source")


def _rates(sized: DataFrame, goal: DataFrame, n_sources: int) -> DataFrame:
    """``goal`` (a row a source, with ``rest``) and longest, rate: p = rate * size for documents up to the longest that isn't certain."""
    by_size = _per_source(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), goal, n_sources)
    upto = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    above = Window.partitionBy("source").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    rates = (
        by_size.withColumn("squares", F.sum(F.col("size") * F.col("size") * F.col("n")).over(upto).cast("double"))
        .withColumn("longer", F.coalesce(F.sum(F.col("size") * F.col("n")).over(above), F.lit(0)).cast("double"))
        .withColumn("rate", F.when(F.col("size") > 0, (F.col("rest") - F.col("longer")) / F.col("squares")))
    )
    best = F.max(F.when(F.expr("rate > 0 and rate * size < 1"), F.struct("size", "rate"))).alias("x")
    own = [c for c in goal.columns if c != "source"]
    return rates.groupBy("source").agg(*(F.first(c).alias(c) for c in own), best).select("source", *own, F.col("x.size").alias("longest"), F.col("x.rate").alias("rate"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, cap: float = 3.0, seed: str = "mix", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken: how often the mix takes each document; and the columns ``keep``."""
    spark = docs.sparkSession
    sized = staged(docs.select("doc_id", "source", *keep, F.expr(SIZE).cast("long").alias("size")), "sizes")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goal = targets(sized, weights, share, cap).withColumn("certain", F.floor(ratio).cast("long")).withColumn("rest", (ratio - F.floor(ratio)) * F.col("source_size"))
    goal, n_sources = _small(goal)
    goal, _ = _small(_rates(sized, goal, n_sources))
    unit = (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col("doc_id").cast("string"), F.col("size").cast("string"))), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(16**13))
    p = F.col("rate") * F.col("size")
    may = (F.col("size") > 0) & (F.col("rest") > 0)
    rows = (
        _per_source(sized, goal, n_sources).withColumn("unit", unit)
        .withColumn("whole", may & ((F.col("size") > F.col("longest")) | F.col("longest").isNull()) & (F.col("size") <= F.col("rest")))
        .withColumn("rank_value", F.when(may & (F.col("size") <= F.col("longest")), (F.col("unit") / (1 - F.col("unit"))) / (p / (1 - p))))
    )
    # Documents taken for certain come first, in descending size, then the order of ranks.
    order = F.when(F.col("whole"), -100 - F.log("size") / 16).otherwise(F.log("rank_value"))
    bucket = F.floor((F.greatest(F.lit(-127.0), F.least(order, F.lit(127.0))) + 128) * (BUCKETS // 256)).cast("int")
    place = F.struct(F.coalesce("rank_value", -F.col("size").cast("double")).alias("value"), F.coalesce("doc_id", F.lit(-(2**63))).cast("long").alias("doc"), "size", "row")
    in_order = F.col("whole") | F.col("rank_value").isNotNull()
    rows = rows.withColumn("row", F.monotonically_increasing_id()).withColumn("bucket", F.when(in_order, bucket)).withColumn("place", F.when(in_order, place))
    ranked = staged(rows.select("doc_id", "source", *keep, "size", "source_size", "target", "certain", "rest", "bucket", "place"), "ranked")
    drop(spark, sized)
    turns = _down(ranked.where("place is not null").select("source", "size", "bucket", "place", "rest"), n_sources)
    taken = F.exists("turns", lambda t: (t["after"].isNull() | (F.col("place") > t["after"])) & (t["before"].isNull() | (F.col("place") < t["before"])) & (F.col("size") <= t["gap"]))
    taken = F.when(F.col("turns").isNull(), F.col("size") <= F.col("rest")).otherwise(taken)  # all that fit alone fit together
    drawn = F.when(F.col("place").isNotNull() & taken, 1).otherwise(0)
    copies = F.when(F.col("size") > 0, F.col("certain") + drawn).otherwise(0).cast("long")
    return (
        _per_source(ranked, turns, n_sources, "left").withColumn("copies", copies)
        .select("doc_id", "source", *keep, "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )


def _down(pool: DataFrame, n_sources: int) -> DataFrame:
    """Down the order of ``pool`` (source, size, bucket, place, rest): source, turns. Sources of which all documents fit have no row.

    A turn takes the places between ``after`` and ``before`` with sizes up to its ``gap``. The first ends before the first document
    that does not fit, which the sums by bucket and the rows of one bucket tell. What is open then is less than that document, so
    from there on a fold goes down the next ``STEPS`` documents of a size that is open, through all that do not fit, until none is left.
    """
    rounds, going = [], True
    while going:
        # Only sources that are open go on, and turns are put together once, at the end.
        found = _walks(pool, rounds[-1].where("open").select("source", "gap", "after"), n_sources) if rounds else _cuts(pool, n_sources)
        found, going = _small_state(found, n_sources)
        rounds.append(found)
    turns = reduce(DataFrame.union, (found.select("source", "turns") for found in rounds))
    return turns.groupBy("source").agg(F.flatten(F.collect_list("turns")).alias("turns"))


def _walks(pool: DataFrame, state: DataFrame, n_sources: int) -> DataFrame:
    """source, gap, after, open, turns: what a fold over the next ``STEPS`` documents of an open size takes (turns) and leaves (gap),
    their last place, and whether to go on. Sources without such a document have no row."""
    rows = _per_source(pool, state, n_sources).where("size <= gap and (after is null or place > after)")
    first = rows.withColumn("nth", F.row_number().over(Window.partitionBy("source").orderBy("place"))).where(F.col("nth") <= STEPS)
    lists = first.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("place", "size"))).alias("x"), F.first("gap").alias("gap"), F.first("after").alias("after"))
    place = pool.schema["place"].dataType.simpleString()
    last = "element_at(x, -1).place"
    turn = lambda after, before, gap: f"array(named_struct('after', {after}, 'before', {before}, 'gap', {gap}))"
    state_ = lambda left, gap, after, turns: f"named_struct('left', {left}, 'gap', {gap}, 'after', {after}, 'turns', {turns})"
    start = state_("cast(gap AS double)", "cast(gap AS double)", "after", f"cast(array() AS array<struct<after:{place},before:{place},gap:double>>)")
    fits, cut = state_("a.left - d.size", "a.gap", "a.after", "a.turns"), state_("a.left", "a.left", "d.place", f"concat(a.turns, {turn('a.after', 'd.place', 'a.gap')})")
    # The last turn ends just behind the last place, or holds for all that follow where there are none.
    behind = f"if(size(x) = {STEPS}, named_struct('value', {last}.value, 'doc', {last}.doc, 'size', {last}.size, 'row', {last}.row + 1), null)"
    end = f"named_struct('left', a.left, 'turns', concat(a.turns, {turn('a.after', behind, 'a.gap')}))"
    walk = F.expr(f"aggregate(x, {start}, (a, d) -> CASE WHEN d.size > a.gap THEN a WHEN d.size <= a.left THEN {fits} ELSE {cut} END, a -> {end})")
    walked = lists.select("source", (F.size("x") == STEPS).alias("more"), F.expr(last).alias("after"), walk.alias("walk"))
    return walked.select("source", F.col("walk.left").alias("gap"), "after", (F.col("more") & (F.col("walk.left") >= 1)).alias("open"), "walk.turns")


def _small_state(table: DataFrame, n_sources: int) -> tuple[DataFrame, bool]:
    """A table of one row a source, worked out, and whether one of them is open."""
    if n_sources > MOST_SOURCES:
        out = staged(table, "state")
        return out, not out.where("open").isEmpty()
    rows = table.collect()
    return table.sparkSession.createDataFrame(rows, table.schema), any(r["open"] for r in rows)


def _cuts(pool: DataFrame, n_sources: int) -> DataFrame:
    """source, gap, after, open, turns: the turn up to the first document that does not fit, that document's place, and what is open
    there. Sources in which all fit have no row."""
    rows = pool.where("size <= rest")
    w = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.first("rest").alias("rest")).withColumn("upto", F.sum("words").over(w))
    over = sums.where("upto > rest").groupBy("source").agg(F.min("bucket").alias("cut"), F.min(F.col("upto") - F.col("words")).alias("earlier"))  # words before a bucket ascend
    inside = Window.partitionBy("source").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = _per_source(rows, over, n_sources).where("bucket = cut").withColumn("upto", F.col("earlier") + F.sum("size").over(inside)).where("upto > rest")
    first = last.groupBy("source").agg(F.min(F.struct("place", (F.col("upto") - F.col("size")).alias("words"))).alias("x"), F.first("rest").alias("rest"))
    turn = F.struct(F.lit(None).cast(pool.schema["place"].dataType).alias("after"), F.col("x.place").alias("before"), F.col("rest").cast("double").alias("gap"))
    gap = (F.col("rest") - F.col("x.words")).cast("double")
    return first.select("source", gap.alias("gap"), F.col("x.place").alias("after"), (gap >= 1).alias("open"), F.array(turn).alias("turns"))


def op5(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


#: The same mix in SQL over the view ``documents``.
ORACLE = r"""
WITH RECURSIVE sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, row_number() OVER (ORDER BY doc_id) AS id FROM documents),
by_source AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
turns AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS turn FROM by_source),
weighed AS (SELECT *, CASE turn % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM turns),
levels AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(3.0::DOUBLE * source_size) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM weighed WINDOW before AS (ORDER BY source_size / weight, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
opened AS (SELECT *, 3.0::DOUBLE * source_size > level * weight AS open FROM levels),
fixed AS (SELECT level FROM opened WHERE open ORDER BY source_size / weight, turn LIMIT 1),
goal AS (SELECT source, source_size, CASE WHEN open THEN (SELECT level FROM fixed) * weight ELSE 3.0::DOUBLE * source_size END AS target FROM opened),
goals AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS ratio FROM goal),
rests AS (SELECT source, source_size, target, floor(ratio)::BIGINT AS certain, (ratio - floor(ratio)) * source_size AS rest FROM goals),
by_size AS (SELECT s.source, s.size, rest, count(*) AS n FROM sized s JOIN rests r ON s.source IS NOT DISTINCT FROM r.source WHERE size > 0 GROUP BY ALL),
rate0 AS (SELECT *, (rest - coalesce(sum(size * n) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
  / (sum(size * size * n) OVER (PARTITION BY source ORDER BY size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::DOUBLE AS rate FROM by_size),
rates AS (SELECT source, max(size) AS longest, max_by(rate, size) AS rate FROM rate0 WHERE rate > 0 AND rate * size < 1 GROUP BY source),
rows0 AS (SELECT s.*, source_size, target, certain, rest, longest, rate * size AS p, size > 0 AND rest > 0 AS may,
  (('0x' || substr(md5('mix|' || s.doc_id || '|' || size), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS unit
  FROM sized s JOIN rests g ON s.source IS NOT DISTINCT FROM g.source LEFT JOIN rates t ON s.source IS NOT DISTINCT FROM t.source),
rows1 AS (SELECT *, may AND (size > longest OR longest IS NULL) AND size <= rest AS whole, CASE WHEN may AND size <= longest THEN (unit / (1 - unit)) / (p / (1 - p)) END AS rank_value FROM rows0),
lined AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY whole DESC, CASE WHEN whole THEN -size END, rank_value, doc_id, size, id) AS place FROM rows1 WHERE whole OR rank_value IS NOT NULL),
walk AS (SELECT source, 0::BIGINT AS place, rest AS gap, NULL::BIGINT AS id FROM rests
  UNION ALL SELECT l.source, l.place, CASE WHEN l.size <= w.gap THEN w.gap - l.size ELSE w.gap END, CASE WHEN l.size <= w.gap THEN l.id END
  FROM walk w JOIN lined l ON l.source IS NOT DISTINCT FROM w.source AND l.place = w.place + 1)
SELECT doc_id, size, source_size, target, ((certain + drawn) * size)::BIGINT AS taken, CASE WHEN size > 0 THEN certain + drawn ELSE 0 END AS copies
FROM (SELECT *, CASE WHEN id IN (SELECT id FROM walk WHERE id IS NOT NULL) THEN 1 ELSE 0 END::BIGINT AS drawn FROM rows1)
"""
