"""Counters and texts of reports."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .constraints import removals
from .validation import FOREIGN_MIN, UPOS, is_word


def _unknown(c):
    return F.exists(c["readings"], lambda r: F.array_contains(r["tags"], "Unk"))


def ambiguous_sentences(sentences: DataFrame, position: str = "sent_id", n: int = 20) -> DataFrame:
    """sent_id, text, frequency, n_ambiguous, n_unknown, n_collapsed, details of the n sentences with most ambiguous and collapsed
    cohorts; sentences without any are left out. Details are those cohorts: form, readings left, and, where there is a trace, the
    readings that there were. Without a column frequency each sentence counts once."""
    words = F.filter("cohorts", is_word)
    several = lambda c: (F.size(c["readings"]) > 1) & ~_unknown(c)
    gone = lambda c: F.size(c["readings"]) == 0
    shown = lambda c: F.transform(c["readings"], lambda r: F.array_join(F.concat(F.array(r["lemma"]), r["tags"]), "+"))
    count = lambda cs, test: F.size(F.filter(cs, test))
    removed = lambda i: F.transform(F.filter("trace", lambda t: t["pos"] == i), lambda t: F.array_join(F.concat(F.array(t["lemma"]), t["tags"]), "+"))
    was = (lambda c, i: [F.concat(shown(c), removed(i)).alias("before")]) if "trace" in sentences.columns else lambda c, i: []
    listed = F.filter(F.transform("cohorts", lambda c, i: F.struct(i.alias("i"), c.alias("c"))), lambda x: gone(x["c"]) | several(x["c"]))
    rows = sentences.select(
        *{"sent_id", position}, "text", F.col("frequency") if "frequency" in sentences.columns else F.lit(1).cast("long").alias("frequency"), count(words, several).alias("n_ambiguous"), count(words, _unknown).alias("n_unknown"),
        count(F.col("cohorts"), gone).alias("n_collapsed"), F.transform(listed, lambda x: F.struct(x["i"].alias("i"), x["c"]["form"].alias("form"), shown(x["c"]).alias("readings"), *was(x["c"], x["i"]))).alias("details"),
    )
    top = rows.where("n_ambiguous + n_collapsed > 0").orderBy((F.col("n_ambiguous") + F.col("n_collapsed")).desc(), position).limit(n)
    return top.select("sent_id", "text", "frequency", "n_ambiguous", "n_unknown", "n_collapsed", "details")


def ambiguous_text(top: DataFrame, n: int = 10) -> str:
    """The first n rows of ``ambiguous_sentences`` as text."""
    lines = []
    for i, r in enumerate(top.limit(n).collect(), 1):
        lines += [f"#{i}: {r['n_ambiguous'] + r['n_collapsed']} open, frequency {r['frequency']}", f"  {r['text']}"]
        for d in r["details"]:
            was = f" (of {len(d['before'])})" if "before" in d else ""
            lines.append(f"  {d['form']}: " + (" | ".join(d["readings"]) if d["readings"] else "no reading left") + was)
    return "\n".join(lines)


def trace_text(done: DataFrame, n: int = 50) -> str:
    """How many readings each rule removed, and the first n removals, as text."""
    rows = removals(done)
    lines = [f"{r['rule']}: {r['n']}" for r in rows.groupBy("rule").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "rule").collect()]  # a row a rule
    order = ["sent_id", "pos", "grammar", "pass", "section", "rule", "reading"]
    return "\n".join(lines + [f"  {r['sent_id']} {r['pos'] + 1} {r['form']}: {r['reading']} by {r['rule']} (section {r['section']}, pass {r['pass']})" for r in rows.orderBy(*order).limit(n).collect()])


def errors_text(errors: DataFrame, n: int = 50) -> str:
    """The first n rows of ``validation.detected_errors`` as text."""
    total, rows = errors.count(), errors.orderBy("sent_id", "index", "kind").limit(n).collect()
    return "\n".join([f"{total} errors" if total else "no errors", *(f"  {r['sent_id']} {r['index']} {r['form']}: {r['kind']}" + (f" ({r['n_before']} readings before)" if r["kind"] == "collapsed" else "") for r in rows)])


def verdicts_text(results: DataFrame, counts: DataFrame, n: int = 50) -> str:
    """The counts of ``validation.summary`` and the first n sentences with violations as text."""
    lines = [f"{r['kind']} {r['value']}: {r['n']}" for r in counts.orderBy("kind", F.desc("n"), "value").collect()]  # a row a status, reason and rule
    for r in results.where("size(violations) > 0").orderBy("sent_id").limit(n).collect():
        lines.append(f"  {r['text']}")
        lines += [f"    {v['rule']} ({v['severity']}) at {v['index']} {v['form']}: {v['message']}" for v in r["violations"]]
    return "\n".join(lines)


def compression_text(tables: dict[str, DataFrame], title: str = "Compression") -> str:
    """The five tables of ``compression.report`` as text."""
    def rows(name, *order):
        return tables[name].orderBy(*order).collect()  # a row a part of speech, class or paradigm

    lines = [title, "-" * len(title), "Cells of entries that can be generated"]
    by_pos = rows("by_pos", "pos")
    for r in by_pos:
        total = r["cells"] - r["blocked_cells"]
        lines.append(f"  {r['pos']}: {r['entries'] - r['blocked']} entries, {total} cells, by rule {percent(r['by_rule'], total)}, by stem {percent(r['by_stem'], total)}, {total - r['by_stem']} left over")
    lines.append("All cells")
    lines += [f"  {r['pos']}: {r['entries']} entries, {r['cells']} cells, by rule {percent(r['by_rule'], r['cells'])}, by stem {percent(r['by_stem'], r['cells'])}" for r in by_pos]
    lines.append("Classes of cells")
    lines += [f"  {r['pos']} {r['class']}: {r['cells']} cells, by rule {percent(r['by_rule'], r['cells'])}, by stem {percent(r['by_stem'], r['cells'])}" for r in rows("by_class", "pos", "class")]
    lines.append("Paradigms")
    lines += [f"  {r['pos']} {r['paradigm']}: {r['entries']} entries, {r['complete']} by rule alone, {r['with_stems']} with stems ({', '.join(f'{k}={v}' for k, v in sorted((r['roles'] or {}).items()))}), {r['overrides']} overrides" for r in rows("by_paradigm", "pos", "paradigm")]
    lines.append("Findings")
    lines += [f"  {r['finding']}: {r['n']}" for r in rows("findings", "finding")]
    return "\n".join(lines)


def export_counts(sentences: DataFrame) -> DataFrame:
    """source, sentences, foreign, tokens, unknown, upos_unique, fully_unique of analysed sentences with a source."""
    table = F.create_map(*[F.lit(x) for kv in UPOS.items() for x in kv])
    words = F.filter("cohorts", is_word)
    rows = sentences.select("source", words.alias("w"), F.size(F.filter(words, _unknown)).alias("unknown")).withColumn("foreign", (F.size("w") > 0) & (F.col("unknown") > FOREIGN_MIN * F.size("w")))
    upos = lambda c: F.size(F.array_distinct(F.transform(c["readings"], lambda r: F.coalesce(table[F.get(r["tags"], F.lit(0))], F.lit("X"))))) == 1
    kept = lambda x: F.sum(F.when(~F.col("foreign"), x).otherwise(0))
    return rows.groupBy("source").agg(
        kept(F.lit(1)).alias("sentences"), F.sum(F.col("foreign").cast("int")).alias("foreign"), kept(F.size("w")).alias("tokens"), kept(F.col("unknown")).alias("unknown"),
        kept(F.size(F.filter("w", lambda c: upos(c) & ~_unknown(c)))).alias("upos_unique"), kept(F.size(F.filter("w", lambda c: (F.size(c["readings"]) == 1) & ~_unknown(c)))).alias("fully_unique"),
    )


def export_text(counts: DataFrame) -> str:
    """The rows of ``export_counts`` as text, a line a source."""
    lines = []
    for r in counts.orderBy("source").collect():
        lines.append(f"{r['source']}: {r['sentences']} sentences, {r['foreign']} foreign, {r['tokens']} words, unknown {percent(r['unknown'], r['tokens'])}, one part of speech {percent(r['upos_unique'], r['tokens'])}, one reading {percent(r['fully_unique'], r['tokens'])}")
    return "\n".join(lines)


def percent(part: int, total: int) -> str:
    return f"{100 * part / total:.2f} % ({part})" if total else "0.00 % (0)"


def coverage_text(rows: DataFrame, title: str = "Coverage") -> str:
    """The subtotals of ``compression.coverage`` as text: one line a part of speech and paradigm."""
    lines = [title, "-" * len(title)]
    for r in sorted(rows.collect(), key=lambda r: (r["pos"] or "", r["paradigm"] or "")):  # some hundred subtotals
        name = " ".join(x for x in (r["pos"], r["paradigm"]) if x) or "all"
        lines.append(f"{name}: {r['cells']} cells, by rule {percent(r['by_rule'], r['cells'])}, by stem {percent(r['by_stem'], r['cells'])}")
    return "\n".join(lines)


def statistics_text(label: str, rows: DataFrame, pairs: DataFrame, n: int = 8) -> str:
    """The rows of ``statistics.ambiguity`` (or ``ambiguity_of``) and the most frequent pairs of both kinds as text."""
    lines = [f"== {label} =="]
    for r in rows.collect():  # one row a group of the report
        lines.append(", ".join(f"{k} {v}" for k, v in r.asDict().items()))
    for kind, title in (("pos", "parts of speech"), ("sig", "tags")):
        found = pairs.where(F.col("kind") == kind).groupBy("pair").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "pair").limit(n).collect()
        lines += [f"  {title}"] * bool(found) + [f"  {r['pair']}: {r['n']}" for r in found]
    return "\n".join(lines)
