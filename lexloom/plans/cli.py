"""Command line: ``python -m lexloom COMMAND ...`` over files that Spark can read."""

import argparse
import functools

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import baking, compression, constraints, generation, linking, paradigms, reports, statistics, valence, validation
from ..sources import lexicon, nvh
from ..storage import settled
from . import api


def _text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lexloom", description=__doc__)
    commands = p.add_subparsers(dest="command", required=True)
    for name, text in (
        ("analyze", "sentences with their cohorts; without --grammar as they are looked up"), ("stream", "the same in text notation"), ("validate", "verdicts; a summary of them with --summary"),
        ("conllu", "the dependency table"), ("stats", "ambiguity before and after the rules, and what is confused"), ("errors", "error tags and cohorts without a reading"), ("top-ambiguous", "the sentences with most open words"),
    ):
        c = commands.add_parser(name, help=text)
        given = c.add_mutually_exclusive_group(required=True)
        given.add_argument("--from", dest="sources", action="append", metavar="NAME=KIND:PATH", help="a named source (KIND json, md or parquet); may be repeated, and counts are shown by source")
        given.add_argument("--input", help="Parquet with a key and a text column")
        given.add_argument("--corpus", help="JSON arrays of corpus rows")
        given.add_argument("--corpus-md", help="Markdown files")
        given.add_argument("--said", metavar="TEXT", help="a text itself")
        c.add_argument("--skip", action="append", default=[], help="a source of corpus rows to leave out")
        c.add_argument("--key", default="doc_id")
        c.add_argument("--text", default="text")
        c.add_argument("--table", help="Parquet of the analysis table; without it the closed classes")
        c.add_argument("--grammar", action="append", default=[], help="in the order of application")
        c.add_argument("--include", action="append", default=[], metavar="NAME=PATH")
        c.add_argument("--tree-section", default="dep-tree", help="the first grammar's section before which parents are kept apart")
        c.add_argument("--genitive-verb", action="append", default=[])
        c.add_argument("--sets", help="generated lists, for the verbs that govern the genitive")
        c.add_argument("--valence", help="entry files, for the cases that prepositions govern")
        c.add_argument("--source", help="a name of the source in the export")
        c.add_argument("--limit", type=int, help="only so many sentences")
        c.add_argument("--top", type=int, help="rows of top-ambiguous", default=20)
        c.add_argument("--trace", action="store_true", help="show which rules removed how many readings, and write each removal to OUTPUT-trace")
        c.add_argument("--summary", action="store_true", help="counts of verdicts instead of the verdicts")
        c.add_argument("--output", required=True)
    c = commands.add_parser("show", help="the ending tables")
    c.add_argument("pos", nargs="?", choices=["noun", "adj", "verb"])
    c = commands.add_parser("generate", help="the forms of one lexeme")
    c.add_argument("pos", choices=["noun", "adj", "verb"])
    c.add_argument("paradigm")
    c.add_argument("lemma")
    c.add_argument("--stem", action="append", default=[], metavar="ROLE=STEM")
    c = commands.add_parser("parity", help="surfaces of a table against expected ones")
    c.add_argument("--table", required=True)
    c.add_argument("--gold", help="a file of surfaces; without it those of --against")
    c.add_argument("--against", help="Parquet of another table")
    c.add_argument("--output", required=True)
    c = commands.add_parser("merge", help="closed classes and a baked table")
    c.add_argument("--lexc", required=True, help="lexicon sources of the closed classes")
    c.add_argument("--start", default="Root")
    c.add_argument("--table", required=True)
    c.add_argument("--output", required=True)
    for name in ("bake", "compress", "links", "sets"):
        c = commands.add_parser(name)
        c.add_argument("--entries", required=True, help="entry files")
        c.add_argument("--table", help="Parquet of the analysis table, for links")
        c.add_argument("--mode", choices=["full", "lemma_only", "dense"], default="full", help="of compress")
        c.add_argument("--rounds", type=int, default=4, help="of compress")
        c.add_argument("--report", help="where compress writes its report")
        c.add_argument("--output", required=True)
    return p


def _sentences(a, spark: SparkSession):
    """The sentences that the options name."""
    if a.sources:
        kinds = {"json": lambda p: nvh.sentences_of_json(spark, p, a.skip), "md": lambda p: nvh.sentences_of_markdown(spark, p), "parquet": lambda p: nvh.sentences_of_text(spark.read.parquet(p), a.key, a.text)}
        named = [(name, *where.split(":", 1)) for name, _, where in (x.partition("=") for x in a.sources)]
        parts = [kinds[kind](path).withColumn("source", F.lit(name)) for name, kind, path in named]
        return functools.reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
    if a.corpus:
        return nvh.sentences_of_json(spark, a.corpus, a.skip)
    if a.corpus_md:
        return nvh.sentences_of_markdown(spark, a.corpus_md)
    docs = spark.read.parquet(a.input) if a.input else spark.createDataFrame([("1", a.said)], f"{a.key} string, {a.text} string")
    return nvh.sentences_of_text(docs, a.key, a.text)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    if a.command == "show":
        print("\n".join(" ".join(row) for row in paradigms.atoms(a.pos)))
        return
    spark = spark or SparkSession.builder.appName("lexloom").getOrCreate()
    if a.command == "generate":
        stems = {k: generation.check_stem(v, k) for k, v in (x.split("=", 1) for x in a.stem)}
        one = spark.createDataFrame([(a.lemma, a.pos, a.paradigm, a.lemma, stems)], "lexeme string, pos string, paradigm string, lemma string, stems map<string,string>")
        print("\n".join(f"{r['slot']}\t{' | '.join(r['surfaces'])}" for r in generation.generate(one).orderBy("slot").collect()))  # the slots of one lexeme
        return
    table = spark.read.parquet(a.table) if a.table else lexicon.analysis_table(spark)
    if a.command == "parity":
        gold = baking.gold_surfaces(spark, a.gold, spark.read.parquet(a.against) if a.against else table)
        print(baking.parity_counts(gold, table).first().asDict())
        baking.write_parity(baking.parity(gold, table), a.output)
        return
    if a.command == "merge":
        baking.merged_table(lexicon.read_lexc(spark, a.lexc, a.start), table).write.parquet(a.output)
        return
    if a.command in ("bake", "compress", "links", "sets"):
        entries = nvh.read(spark, a.entries)
        if a.command == "bake":
            baking.bake(entries).write.parquet(a.output)
        elif a.command == "links":
            links, gaps = linking.resolve_corpus(entries, table)
            links.write.json(f"{a.output}/links")
            gaps.write.json(f"{a.output}/unresolved")
        elif a.command == "sets":
            rows = valence.government_lists(valence.valence(entries.select("lemma", F.exists(F.map_keys("attested"), lambda s: s.startswith("prs.")).alias("finite"), "description")))
            spark.createDataFrame([(valence.list_line(r["name"], r["lemmas"]),) for r in rows.orderBy("name").collect()], "value string").coalesce(1).write.text(a.output)  # eleven lists
        else:
            lexemes = entries.select(F.col("id").alias("lexeme"), "pos", "paradigm", "lemma", "stems")
            cells = entries.select(F.col("id").alias("lexeme"), F.explode("attested").alias("slot", "s")).select("lexeme", "slot", F.explode("s").alias("surface"))
            derived = compression.derive(lexemes, cells, a.mode, a.rounds)
            if a.report:
                text = reports.compression_text(compression.report(derived, lexemes, cells))
                spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(a.report)
            lean = derived.select("lexeme", "stems")
            kept = derived.select("lexeme", F.col("overrides").alias("attested"))
            none = F.create_map().cast("map<string,array<string>>")
            out = entries.drop("attested", "stems").join(lean.select(F.col("lexeme").alias("id"), "stems"), "id").join(kept.withColumnRenamed("lexeme", "id"), "id", "left").withColumn("attested", F.coalesce("attested", none))
            nvh.write(out, a.output)
        return
    sentences = _sentences(a, spark)
    if a.limit is not None:
        sentences = sentences.limit(a.limit)
    includes = {name: _text(spark, path) for name, _, path in (x.partition("=") for x in a.include)}
    grammars = [_text(spark, g) for g in a.grammar]
    snapshot = constraints.sections_before(grammars[0], a.tree_section) if grammars else None
    before = api.cohorts(sentences, table)
    done = constraints.analysed(before, grammars, includes, snapshot)
    if a.command == "stats" or a.trace or a.summary or a.sources:  # several reports read the result
        done = settled(done)
    if a.command == "stats":
        before = settled(before)
    if a.trace:
        print(reports.trace_text(done))
        constraints.removals(done).write.json(f"{a.output}-trace")
    if a.command == "analyze":
        done.write.parquet(a.output)
    elif a.command == "stream":
        constraints.streamed(done).orderBy("sent_id").select("stream").write.text(a.output)
    elif a.command == "conllu":
        cases = valence.governed_case(valence.valence(nvh.read(spark, a.valence).select("lemma", F.lit(False).alias("finite"), "description"))) if a.valence else None
        validation.conllu(done, cases, a.source).where("block is not null").orderBy("sent_id").select(F.concat("block", F.lit("\n")).alias("value")).write.text(a.output)
        if a.sources:
            print(reports.export_text(reports.export_counts(done)))
    elif a.command == "top-ambiguous":
        reports.ambiguous_sentences(done, n=a.top).write.json(a.output)
    elif a.command == "errors":
        validation.detected_errors(done).write.json(a.output)
    elif a.command == "stats":
        by = ["source"] if a.sources else []
        for label, rows in (("before", before), ("after", done)):
            numbers, found = statistics.ambiguity_of(rows, by), statistics.pairs_of(rows, by)
            print(reports.statistics_text(label, numbers, found))
            numbers.write.json(f"{a.output}/{label}")
            found.write.json(f"{a.output}/{label}-pairs")
    else:
        verbs = [*a.genitive_verb, *(lexicon.named_list(_text(spark, a.sets), "GenVerb") if a.sets else [])]
        results = validation.validated(done, verbs)
        (validation.summary(results) if a.summary else results).write.json(a.output)
        if a.summary:
            print(reports.verdicts_text(results, validation.summary(results)))
