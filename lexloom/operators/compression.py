"""Compression of attested forms to few stems and the cells that no stem gives.

For each lexeme and role the stem with the largest gain in exactly met slots replaces the rule's, ties go to the smallest stem;
what is still not exact becomes an override, which replaces its slot. ``expanded`` undoes it without loss.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import settled
from . import paradigms as P
from .generation import forms_of, generate, role_stems, role_table, usable, with_rule_stems


def cells(attested: DataFrame) -> DataFrame:
    """lexeme, slot, attested (sorted, distinct) from rows of lexeme, slot, surface."""
    return attested.groupBy("lexeme", "slot").agg(F.array_sort(F.collect_set("surface")).alias("attested"))


def candidates(lexemes: DataFrame, attested: DataFrame) -> DataFrame:
    """lexeme, pos, paradigm, role, stem: what remains of each attested form without the measured ending of its slot."""
    known = role_stems(lexemes).select("lexeme", "pos", "paradigm", "role", "default")
    roles = F.broadcast(role_table(lexemes.sparkSession))
    rows = attested.join(known, "lexeme").join(roles, ["pos", "paradigm", "role", "slot"]).where(F.endswith("surface", "measured"))
    stem = F.expr("substring(surface, 1, length(surface) - length(measured))")
    return rows.select("lexeme", "pos", "paradigm", "role", "default", stem.alias("stem")).where((F.col("stem") != "") & usable(F.col("stem")) & (F.col("stem") != F.col("default"))).distinct()


def best_stems(lexemes: DataFrame, attested: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """lexeme, role, stem, gain of the stems worth keeping; roles with a supplied stem keep it. Stems come from the cells of
    ``source`` (usually the attested ones), gains are counted on the attested cells."""
    wanted = cells(attested)

    def met(forms: DataFrame, keys: list[str]) -> DataFrame:
        by = forms.groupBy(*keys, "slot").agg(F.array_sort(F.collect_set("surface")).alias("made"))
        return by.join(wanted, ["lexeme", "slot"]).where(F.col("made") == F.col("attested")).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))

    supplied = lexemes.where("stems is not null").select("lexeme", F.explode(F.map_keys("stems")).alias("role"))
    tried = settled(candidates(lexemes, attested if source is None else source).join(supplied, ["lexeme", "role"], "left_anti"))
    open_roles = tried.select("lexeme", "role").distinct()  # the others keep their stem, so what it gives needn't be known
    before = met(forms_of(role_stems(lexemes).join(open_roles, ["lexeme", "role"], "left_semi")), ["lexeme", "role"]).withColumnRenamed("n", "before")
    after = met(forms_of(tried), ["lexeme", "role", "stem"])
    gains = tried.select("lexeme", "role", "stem").join(after, ["lexeme", "role", "stem"], "left").join(before, ["lexeme", "role"], "left")
    gains = gains.withColumn("gain", F.coalesce("n", F.lit(0)) - F.coalesce("before", F.lit(0))).where("gain > 0")
    best = gains.groupBy("lexeme", "role").agg(F.min(F.struct((-F.col("gain")).alias("loss"), "stem")).alias("b"))
    return best.select("lexeme", "role", "b.stem", (-F.col("b.loss")).alias("gain"))


def with_stems(lexemes: DataFrame, stems: DataFrame) -> DataFrame:
    """The lexemes with the given stems laid over their own."""
    by = stems.groupBy("lexeme").agg(F.map_from_entries(F.collect_list(F.struct("role", "stem"))).alias("more"))
    none = F.create_map().cast("map<string,string>")
    merged = F.map_concat(F.map_filter(F.coalesce("stems", none), lambda k, v: ~F.array_contains(F.map_keys(F.coalesce("more", none)), k)), F.coalesce("more", none))
    return lexemes.join(by, "lexeme", "left").withColumn("stems", merged).drop("more")


def overrides(generated: DataFrame, attested: DataFrame) -> DataFrame:
    """lexeme, slot, attested of listed slots that generation does not meet exactly."""
    return cells(attested).join(generated, ["lexeme", "slot"], "left").where(~F.col("attested").eqNullSafe(F.col("surfaces"))).select("lexeme", "slot", "attested")


def merged(generated: DataFrame, replaced: DataFrame) -> DataFrame:
    """lexeme, slot, surfaces: an override replaces its slot, it never adds to it."""
    return generated.join(replaced, ["lexeme", "slot"], "full").select("lexeme", "slot", F.coalesce("attested", "surfaces").alias("surfaces"))


def compress(lexemes: DataFrame, attested: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lexemes with their stems, overrides). Lexemes without a known paradigm keep all cells as overrides."""
    lean = with_stems(lexemes, best_stems(lexemes, attested))
    return lean, overrides(generate(lean), attested)


def derive(lexemes: DataFrame, attested: DataFrame, mode: str = "full", rounds: int = 4) -> DataFrame:
    """The derivation of each lexeme: lexeme, pos, paradigm (as given), status, stems, overrides, cells, by_rule, by_stem,
    redundant_stems, variant_overrides, redundant_overrides, rounds, unstable.

    ``mode``: full derives stems of each lexeme until another round, from the cells that are left over, changes nothing; a round that
    would not restore all cells leaves the lexeme as it was, and one that still changes it in the last round is unstable, too. rounds
    is the lexeme's own last round. lemma_only takes no new stems. dense takes the
    input for compressed already: its cells stay overrides and its stems stay.

    status: ok, unknown_paradigm (all cells are overrides), or no_stem (nothing usable to generate from). by_rule and by_stem count
    the attested surfaces that the rules, and the stems, give. redundant_stems are supplied stems that equal the rule's;
    redundant_overrides count overrides that repeat a generated cell (0 but in dense mode).
    """
    none = F.create_map().cast("map<string,string>")
    lexemes, attested = settled(lexemes), settled(attested)  # read by every round
    wanted = settled(cells(attested))
    known = with_rule_stems(lexemes)
    lean = lexemes.withColumn("stems", F.coalesce("stems", none))
    left = wanted if mode == "dense" else None
    state = lexemes.select("lexeme", F.lit(1).alias("rounds"), F.lit(False).alias("unstable"))
    if mode == "full":
        lean = settled(with_stems(lexemes, best_stems(lexemes, attested)))
        # Lexemes go on until a round changes nothing; those that the rules give in full, without a stem or an override, end at once.
        left_over = settled(overrides(generate(lean), attested))
        active = settled(lean.where(F.size("stems") > 0).select("lexeme").union(left_over.select("lexeme")).distinct())
        for n in range(2, rounds + 1):
            if active.isEmpty():
                break
            own = lambda df: df.join(active, "lexeme", "left_semi")  # noqa: E731, B023
            more = settled(best_stems(own(lean), own(attested), own(left_over).select("lexeme", "slot", F.explode("attested").alias("surface"))))
            if more.isEmpty():
                state = state.join(active.withColumn("n", F.lit(n)), "lexeme", "left").select("lexeme", F.coalesce("n", "rounds").alias("rounds"), "unstable")
                break
            changed = more.select("lexeme").distinct()
            tried = settled(with_stems(lean.join(changed, "lexeme", "left_semi"), more))
            cells_of = attested.join(changed, "lexeme", "left_semi")
            now = settled(overrides(generate(tried), cells_of))
            lossy = verify(tried, now, cells_of).select("lexeme").distinct()
            kept = settled(tried.join(lossy, "lexeme", "left_anti"))  # changed, and all cells can be restored
            ids = kept.select("lexeme", F.lit(True).alias("goes_on"))
            said = active.join(changed.withColumn("changed", F.lit(True)), "lexeme", "left").join(ids, "lexeme", "left")
            said = said.select("lexeme", F.when(F.col("changed").isNull() | F.col("goes_on"), n).alias("n"), (F.col("changed").isNotNull() & (F.col("goes_on").isNull() | F.lit(n == rounds))).alias("ends_open"))
            state = settled(state.join(said, "lexeme", "left").select("lexeme", F.coalesce("n", "rounds").alias("rounds"), (F.col("unstable") | F.coalesce("ends_open", F.lit(False))).alias("unstable")))
            active = settled(kept.select("lexeme"))
            if not active.isEmpty():
                lean = settled(lean.join(active, "lexeme", "left_anti").unionByName(kept.select(*lean.columns)))
                left_over = settled(left_over.join(active, "lexeme", "left_anti").union(now.join(active, "lexeme", "left_semi")))
        if rounds < 2:
            state = state.join(active.withColumn("goes_on", F.lit(True)), "lexeme", "left").select("lexeme", "rounds", F.coalesce("goes_on", F.lit(False)).alias("unstable"))
    made = settled(generate(lean))
    rule = generate(lexemes.withColumn("stems", F.lit(None).cast("map<string,string>")))
    left = overrides(made, attested) if left is None else left
    rows = wanted.join(made, ["lexeme", "slot"], "left").join(rule.withColumnRenamed("surfaces", "ruled"), ["lexeme", "slot"], "left").join(left.withColumnRenamed("attested", "kept"), ["lexeme", "slot"], "left")
    met = lambda c: F.sum(F.coalesce(F.size(F.array_intersect("attested", c)), F.lit(0)))
    empty = F.array().cast("array<string>")
    sums = rows.groupBy("lexeme").agg(
        F.sum(F.size("attested")).alias("cells"), met(F.coalesce("ruled", empty)).alias("by_rule"), met(F.coalesce("surfaces", empty)).alias("by_stem"),
        F.sum(F.when(F.col("kept").isNotNull() & (F.size("attested") > 1), F.size("kept")).otherwise(0)).alias("variant_overrides"),
        F.sum(F.when(F.col("kept") == F.col("surfaces"), 1).otherwise(0)).alias("redundant_overrides"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("kept").isNotNull(), F.struct("slot", "kept"))))).alias("overrides"),
    )
    rules = known.select("lexeme", "rules")
    some = role_stems(lean).select("lexeme").distinct().withColumn("some", F.lit(True))
    supplied = lexemes.select("lexeme", F.coalesce("stems", none).alias("supplied"))
    out = lexemes.select("lexeme", "pos", "paradigm").join(lean.select("lexeme", F.col("stems").alias("all_stems")), "lexeme").join(supplied, "lexeme").join(rules, "lexeme", "left").join(some, "lexeme", "left").join(sums, "lexeme", "left").join(state, "lexeme")
    roles = sorted({r[2] for r in P.ROLES})
    usable_stems = F.map_filter("all_stems", lambda k, v: k.isin(*roles) & usable(v))
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(
        "lexeme", "pos", "paradigm", F.when(F.col("rules").isNull(), "unknown_paradigm").when(F.col("some").isNull(), "no_stem").otherwise("ok").alias("status"),
        F.when(F.col("rules").isNull(), none).otherwise(usable_stems).alias("stems"), F.coalesce("overrides", F.create_map().cast("map<string,array<string>>")).alias("overrides"), *(count(c) for c in ("cells", "by_rule", "by_stem")),
        F.array_sort(F.map_keys(F.map_filter("supplied", lambda k, v: v == F.col("rules")[k]))).alias("redundant_stems"), *(count(c) for c in ("variant_overrides", "redundant_overrides")), "rounds", "unstable",
    )


def report(derived: DataFrame, lexemes: DataFrame, attested: DataFrame) -> dict[str, DataFrame]:
    """The counts of a report: by_pos, by_class, by_paradigm and findings."""
    n = lambda test: F.count(F.when(test, 1))
    total = lambda c, test: F.sum(F.when(test, F.col(c)).otherwise(0))
    ok = F.col("status") == "ok"
    over = F.aggregate(F.map_values("overrides"), F.lit(0), lambda k, x: k + F.size(x))
    by_pos = derived.groupBy("pos").agg(F.count(F.lit(1)).alias("entries"), n(~ok).alias("blocked"), F.sum("cells").alias("cells"), total("cells", ~ok).alias("blocked_cells"), total("by_rule", ok).alias("by_rule"), total("by_stem", ok).alias("by_stem"))
    lean = lexemes.drop("stems").join(derived.where(ok).select("lexeme", "stems"), "lexeme")
    rows = cells(attested).join(lean.select("lexeme", "pos"), "lexeme").join(generate(lean), ["lexeme", "slot"], "left").join(generate(lean.withColumn("stems", F.lit(None).cast("map<string,string>"))).withColumnRenamed("surfaces", "ruled"), ["lexeme", "slot"], "left")
    met = lambda c: F.sum(F.coalesce(F.size(F.array_intersect("attested", c)), F.lit(0)))
    kind = F.when((F.col("pos") == "verb") & F.startswith("slot", F.lit("part.")), "participle").otherwise(F.col("pos"))
    by_class = rows.groupBy("pos", kind.alias("class")).agg(F.sum(F.size("attested")).alias("cells"), met("ruled").alias("by_rule"), met("surfaces").alias("by_stem"))
    fields = derived.where(ok).select("pos", "paradigm", F.explode(F.map_keys("stems")).alias("role")).groupBy("pos", "paradigm", "role").count().groupBy("pos", "paradigm").agg(F.map_from_entries(F.collect_list(F.struct("role", "count"))).alias("roles"))
    by_paradigm = derived.groupBy("pos", "paradigm").agg(F.count(F.lit(1)).alias("entries"), n(ok & (F.col("by_rule") == F.col("cells"))).alias("complete"), n(ok & (F.size("stems") > 0)).alias("with_stems"), F.sum(over).alias("overrides")).join(fields, ["pos", "paradigm"], "left")
    one = lambda name, c: derived.agg(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias("n")).select(F.lit(name).alias("finding"), "n")
    findings = one("redundant stems", F.size("redundant_stems")).union(one("redundant overrides", F.col("redundant_overrides"))).union(one("overrides of slots with variants", F.col("variant_overrides"))).union(one("not settled", F.col("unstable").cast("int")))
    findings = findings.union(derived.where(~ok).groupBy("pos", "status").count().select(F.concat_ws(" ", F.lit("left out:"), "pos", "status"), "count")).union(derived.groupBy("rounds").count().select(F.concat(F.lit("rounds "), F.col("rounds").cast("string")), "count"))
    return {"by_pos": by_pos, "by_class": by_class, "by_paradigm": by_paradigm, "findings": findings}


def verify(lean: DataFrame, replaced: DataFrame, attested: DataFrame) -> DataFrame:
    """lexeme, slot, missing, extra of listed cells that are not restored exactly: should be empty."""
    full = merged(generate(lean), replaced)
    rows = cells(attested).join(full, ["lexeme", "slot"], "left").withColumn("surfaces", F.coalesce("surfaces", F.array().cast("array<string>")))
    return rows.select("lexeme", "slot", F.array_except("attested", "surfaces").alias("missing"), F.array_except("surfaces", "attested").alias("extra")).where("size(missing) + size(extra) > 0")


def coverage(lexemes: DataFrame, attested: DataFrame) -> DataFrame:
    """Cells, cells that the rules give, and that stems give, by part of speech, paradigm and in all."""
    lean, _ = compress(lexemes, attested)

    def covered(generated: DataFrame, name: str) -> DataFrame:
        return generated.select("lexeme", "slot", F.col("surfaces").alias(name))

    rows = cells(attested).join(covered(generate(lexemes), "a"), ["lexeme", "slot"], "left").join(covered(generate(lean), "b"), ["lexeme", "slot"], "left").join(lexemes.select("lexeme", "pos", "paradigm"), "lexeme")
    count = lambda c: F.sum(F.coalesce(F.size(F.array_intersect("attested", c)), F.lit(0)))
    return rows.rollup("pos", "paradigm").agg(F.sum(F.size("attested")).alias("cells"), count("a").alias("by_rule"), count("b").alias("by_stem"))
