import json

from pyspark.sql import functions as F


from lexloom.operators import constraints, relations, repair, reports
from lexloom.plans import cli
from lexloom.plans.lexicon import DEMO_GRAMMAR


def test_repair(spark, tmp_path):
    rows = [("a", "27", "s", "izpilninamins27is"), ("b", "75a", "s", "x75ay75a1"), ("b", "75a", "s", "x75ay"), ("c", "75a", "s", "175a"), ("d", "1", "s", "12"), ("e", "1", "s", "ok")]
    fixed, review = repair.repair(spark.createDataFrame(rows, "lexeme string, paradigm string, slot string, surface string"))
    assert sorted((r["lexeme"], r["surface"]) for r in fixed.collect()) == [("a", "izpilninaminsis"), ("b", "xay"), ("b", "xy"), ("c", "a"), ("e", "ok")]
    assert review.count() == 5
    repair.write_review(review, str(tmp_path / "r"))
    assert spark.read.csv(str(tmp_path / "r"), sep="\t", header=True).columns == ["lexeme", "paradigm", "slot"]


def test_relations(spark, tmp_path):
    a = spark.createDataFrame([("l+N", "lā"), ("l+N", "lō")], "upper string, lower string")
    b = spark.createDataFrame([("lā", "la"), ("lā", "lā")], "upper string, lower string")
    assert {tuple(r) for r in relations.compose(a, b).collect()} == {("l+N", "la"), ("l+N", "lā")}
    assert relations.union(a, a, b).count() == 4 and relations.invert(a).first()[0].startswith("l")
    relations.write(a, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).count() == 2


def test_reports(spark):
    c = lambda form, *rs: (form, [(x.split("+")[0], x.split("+")[1:]) for x in rs], None, None, [], [], [])
    rows = [("1", "t", [c("a", "a+N", "a+V"), c(".", ".+CLB")], "x"), ("2", "u", [c("q", "q+Unk"), c("r", "r+N")], "x"), ("3", "v", [c("q", "q+Unk")], "x")]
    df = spark.createDataFrame(rows, f"sent_id string, text string, cohorts {constraints.COHORTS}, source string")
    top = reports.ambiguous_sentences(df.withColumn("trace", F.expr("cast(array() as array<struct<pos:int,lemma:string,tags:array<string>>>)")), n=2)
    assert [r[:6] for r in top.collect()] == [("1", "t", 1, 1, 0, 0)] and top.first()["details"][0]["readings"] == ["a+N", "a+V"]
    assert reports.ambiguous_text(top) == "#1: 1 open, frequency 1\n  t\n  a: a+N | a+V (of 2)"
    assert reports.errors_text(spark.createDataFrame([("1", 1, "a", "collapsed", 2)], "sent_id string, index int, form string, kind string, n_before int")).endswith("1 1 a: collapsed (2 readings before)")
    assert reports.export_counts(df).first()[:] == ("x", 2, 1, 3, 1, 1, 1)
    assert reports.percent(1, 4) == "25.00 % (1)" and reports.percent(0, 0) == "0.00 % (0)"
    cover = spark.createDataFrame([("noun", "32", 8, 2, 8), (None, None, 8, 2, 8)], "pos string, paradigm string, cells long, by_rule long, by_stem long")
    assert "noun 32: 8 cells, by rule 25.00 % (2), by stem 100.00 % (8)" in reports.coverage_text(cover)
    stats = spark.createDataFrame([("en", 3)], "lang string, word_tokens long")
    pairs = spark.createDataFrame([("en", "pos", "N|V", 2), ("en", "sig", "N: Acc | Nom", 1)], "lang string, kind string, pair string, n long")
    assert reports.statistics_text("s", stats, pairs).endswith("N|V: 2\n  tags\n  N: Acc | Nom: 1")


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "g.cg").write_text(DEMO_GRAMMAR)
    spark.createDataFrame([(1, "As ne ei astits. Nope!")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    common = ["--input", str(tmp_path / "in"), "--grammar", str(tmp_path / "g.cg")]
    for command in ("analyze", "validate", "conllu", "stats", "errors", "top-ambiguous"):
        cli.main([command, *common, "--output", str(tmp_path / command)], spark)
    assert "out_of_coverage" in {json.loads(r[0])["status"] for r in spark.read.text(str(tmp_path / "validate")).collect()}
    assert spark.read.text(str(tmp_path / "conllu")).where("value like '# sent_id%'").count() == 1
    stats = json.loads(spark.read.text(str(tmp_path / "stats/after")).first()[0])
    assert stats["word_tokens"] == 5 and stats["unknown_pct"] == 20.0 and stats["collapsed"] == 0
    assert (tmp_path / "stats/before-pairs").exists()
    cli.main(["stream", *common[:2], "--limit", "1", "--output", str(tmp_path / "raw")], spark)  # no rules
    assert sum(r[0].startswith('"<') for r in spark.read.text(str(tmp_path / "raw")).collect()) in (2, 5)
    (tmp_path / "t.cg").write_text('LIST CC = CC ; LIST Pron = Pron ;\nSECTION\nREMOVE:gone Pron ;')
    cli.main(["validate", "--said", "As ne ei astits.", "--grammar", str(tmp_path / "t.cg"), "--trace", "--summary", "--output", str(tmp_path / "traced")], spark)
    assert "status verified_in_coverage: 1" in capsys.readouterr().out and (tmp_path / "traced-trace").exists()
    (tmp_path / "e.nvh").write_text("entry: Kadols\n  id: p1\n  pos: noun\n  gender: masc\n  paradigm: 32\n  inflectedForm: Kadollas\n    tag: sg.gen\n  inflectedForm: Kadollan\n    tag: sg.acc\n  legacy:\n    desc: ↑as\nentry: dīnkun\n  pos: prep\n  legacy:\n    desc: prp dat\n")
    (tmp_path / "c.json").write_text(json.dumps([{"sources": [{"video_id": "v"}], "text": "As ne ei astits.", "frequency": 3}, {"text": "mes"}]))
    (tmp_path / "a.md").write_text("# no\nMes [astits](x.png). As\n")
    for k, given in enumerate((["--corpus", str(tmp_path / "c.json")], ["--corpus-md", str(tmp_path / "a.md")], ["--said", "As mes. Ne."])):
        cli.main(["analyze", *given, "--output", str(tmp_path / f"said{k}")], spark)
    assert sorted(spark.read.parquet(str(tmp_path / "said0")).select("sent_id", "frequency").collect()) == [("yt--1", 1), ("yt-v-0", 3)]
    assert spark.read.parquet(str(tmp_path / "said1")).count() == 2 and spark.read.parquet(str(tmp_path / "said2")).count() == 2
    several = [x for name, kind, file in (("talk", "json", "c.json"), ("news", "md", "a.md"), ("more", "parquet", "in")) for x in ("--from", f"{name}={kind}:{tmp_path / file}")]
    cli.main(["conllu", *several, "--output", str(tmp_path / "all")], spark)
    assert {r[0] for r in spark.read.text(str(tmp_path / "all")).where("value like '# source%'").collect()} == {"# source = talk", "# source = news", "# source = more"}
    assert "talk: 2 sentences, 0 foreign, 5 words" in capsys.readouterr().out
    cli.main(["show", "noun"])
    cli.main(["generate", "noun", "32", "Kadols", "--stem", "obl=Kadoll"], spark)
    said = capsys.readouterr().out
    assert "noun 32 obl gen-noun-32" in said and "sg.gen\tKadollas" in said
    for command in ("bake", "compress", "links", "sets"):
        cli.main([command, "--entries", str(tmp_path / "e.nvh"), "--output", str(tmp_path / command)], spark)
    lean = "\n".join(r[0] for r in spark.read.text(str(tmp_path / "compress")).collect())
    assert "stemOverrides: obl=Kadoll" in lean and "inflectedForm" not in lean
    assert 'LIST DatPrep = "dīnkun" ;' in {r[0] for r in spark.read.text(str(tmp_path / "sets")).collect()}
    (tmp_path / "x.lexc").write_text("LEXICON Root\n as+Pron:as # ;\n")
    cli.main(["merge", "--lexc", str(tmp_path / "x.lexc"), "--table", str(tmp_path / "bake"), "--output", str(tmp_path / "merged")], spark)
    cli.main(["parity", "--table", str(tmp_path / "merged"), "--against", str(tmp_path / "bake"), "--output", str(tmp_path / "parity")], spark)
    assert "'extra': 1" in capsys.readouterr().out
    assert spark.read.parquet(str(tmp_path / "bake")).where("surface = 'Kadollas' or surface = 'dīnkun'").count() >= 1
