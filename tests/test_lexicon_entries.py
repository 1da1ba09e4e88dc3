from lexloom.operators import baking, linking, valence
from lexloom.sources import lexicon, nvh

TEXT = """entry: Adwēnts
  id: Adwēnts|56
  pos: noun
  gender: masc
  paradigm: 56
  sense:
    en: Advent
    en: Coming
  inflectedForm: Adwēnts
    tag: sg.nom
  inflectedForm: Adwēntjas
    tag: pl.nom
  legacy:
    desc: [Advent MK] ↑labs
entry: labs
  pos: adj
  paradigm: 25
  stemOverrides: pos=labb adv=lab
entry: labbai
  pos: adv
entry: skaitātun si
  pos: verb
  paradigm: 132
entry: nō
  pos: prep
  legacy:
    desc: prp acc, dat
entry: garbs
  id: garbs|1
  pos: noun-masc
  paradigm: 32
entry: two words
  pos: noun
  paradigm: 32
"""


def test_parse_and_render():
    entries = nvh.parse(TEXT)
    first = entries[0]
    assert (first["id"], first["pos"], first["gender"], first["paradigm"], first["attested"]) == ("Adwēnts|56", "noun", "masc", "56", {"pl.nom": ["Adwēntjas"], "sg.nom": ["Adwēnts"]})
    assert first["translations"] == {"en": ["Advent", "Coming"]} and first["description"] == "[Advent MK] ↑labs"
    assert first["head"][0] == "  id: Adwēnts|56" and first["tail"] == ["  legacy:", "    desc: [Advent MK] ↑labs"]
    assert entries[1]["stems"] == {"pos": "labb", "adv": "lab"} and (entries[5]["pos"], entries[5]["gender"]) == ("noun", "masc")
    again = nvh.parse("".join(nvh.render(e, ("pos", "adv")) for e in entries))
    assert [(e["lemma"], e["attested"], e["stems"]) for e in again] == [(e["lemma"], e["attested"], e["stems"]) for e in entries]


def _entries(spark, tmp_path):
    (tmp_path / "a.nvh").write_text(TEXT)
    return nvh.read(spark, str(tmp_path / "a.nvh"))


def test_baked_table(spark, tmp_path):
    rows = {(r["surface"], r["analysis"]) for r in baking.bake(_entries(spark, tmp_path)).collect()}
    assert ("Adwēntjas", "Adwēnts+N+Prop+Msc+Pl+Nom") in rows and ("Adwēntis", "Adwēnts+N+Prop+Msc+Sg+Gen") in rows
    assert ("Adwēntjai", "Adwēnts+N+Prop+Msc+Pl+Nom") not in rows
    assert ("labbas", "labs+A+Msc+Sg+Gen") in rows and ("labbai", "labbai+Adv") in rows and ("labbai", "labs+Adv") not in rows
    assert ("skaitāi", "skaitātun si+V+Ind+Prs+Sg1+Refl") in rows and ("skaitātun", "skaitātun si+V+Inf+Refl") in rows
    assert ("nō", "nō+Pr") in rows and not any("two" in a for _, a in rows)
    gold = spark.createDataFrame([("nō",), ("zzz",)], "surface string")
    sides = {(r["surface"], r["side"]) for r in baking.parity(gold, spark.createDataFrame([("nō",), ("x",)], "surface string")).collect()}
    assert sides == {("zzz", "missing"), ("x", "extra")}


def test_links(spark, tmp_path):
    entries = spark.createDataFrame(nvh.parse("entry: as\n  legacy:\n    desc: ↑Two Words here, ↑mes\nentry: two words\nentry: Mēs\nentry: mes\n  id: m1\n  pos: noun\nentry: mes\n  id: m2\n  pos: pron\nentry: x\n  legacy:\n    desc: ↑nūse, ↑qq\n"), nvh.ENTRY)
    links, gaps = linking.resolve_corpus(entries, lexicon.analysis_table(spark))
    got = {(r["id"], r["ref"]): (r["method"], r["target_ids"]) for r in links.collect()}
    assert got == {("as", "Two Words here"): ("headword", ["two words"]), ("as", "mes"): ("headword", ["m2"]), ("x", "nūse"): ("form-exact", ["m1", "m2"])}
    assert [(r["id"], r["ref"]) for r in gaps.collect()] == [("x", "qq")]


def test_valence(spark):
    rows = [("nō", False, "prp acc, dat [x]"), ("paggan", False, "psp gen"), ("kwaitītun", True, "tr +prēi acc gen"), ("eītwei", True, "itr if"), ("none", True, "xx"), ("dīnkun", False, "prp dat")]
    table = valence.valence(spark.createDataFrame(rows, "lemma string, finite boolean, description string"))
    got = {r["lemma"]: (r["kind"], r["cases"], r["rection"], r["transitive"], r["takes_infinitive"]) for r in table.collect()}
    assert got["kwaitītun"] == ("verb", ["Gen"], ["prēi acc"], True, False) and got["nō"][:2] == ("prep", ["Acc", "Dat"]) and "none" not in got and got["eītwei"][4]
    lists = {r["name"]: r["lemmas"] for r in valence.government_lists(table).collect()}
    assert lists["DatPrep"] == ["dīnkun"] and lists["AccAnyPrep"] == ["nō"] and lists["GenVerb"] == ["bijātun", "klausītun", "kwaitītun"] and valence.governed_case(table) == {"dīnkun": "Dat"} and lists["AkkPrep"] == ["__none__"] and len(lists) == 11
    assert valence.list_line("X", ["a", "b"]) == 'LIST X = "a" "b" ;'


def test_corpora(spark, tmp_path):
    (tmp_path / "c.json").write_text('[{"sources":[{"video_id":"v"}],"text":"As asma."},{"sources":[{"video_id":"w"}],"text_clean":"","text":"12"},{"sources":[{"video_id":"w"}],"text":"Labs!","frequency":3},{"sources":[{"video_id":"gone"}],"text":"x"}]')
    got = [(r["sent_id"], r["tokens"], r["frequency"]) for r in nvh.sentences_of_json(spark, str(tmp_path / "c.json"), ["gone"]).orderBy("sent_id").collect()]
    assert got == [("yt-v-0", ["As", "asma", "."], 1), ("yt-w-2", ["Labs", "!"], 3)]
    (tmp_path / "b.md").write_text("# head\n\nAs [asma](http://x). 12! Tū assei.\n* list\nNe www.x.y\n")
    got = [(r["sent_id"], r["text"]) for r in nvh.sentences_of_markdown(spark, str(tmp_path / "b.md")).orderBy("sent_id").collect()]
    assert got == [("b-1", "As asma."), ("b-2", "Tū assei."), ("b-3", "Ne  ")] or [t.strip() for _, t in got] == ["As asma.", "Tū assei.", "Ne"]
    (tmp_path / "g.tsv").write_text("# c\n\na\tb\tc\n")
    assert nvh.golden(spark, str(tmp_path / "g.tsv"), ["x", "y"]).collect()[0][:] == ("a", "b")


def test_files_keep_their_order(spark, tmp_path):
    (tmp_path / "b.nvh").write_text("entry: bb\nentry: ba\n")
    (tmp_path / "a.nvh").write_text("entry: az\n  pos: verb\n  paradigm: 85\n  stemOverrides: nonfin=x pret=y pres=z\nentry: ab\n")
    entries = nvh.read(spark, str(tmp_path / "*.nvh"))
    assert [r["lemma"] for r in entries.orderBy("position").collect()] == ["az", "ab", "bb", "ba"]
    nvh.write(entries, str(tmp_path / "out"))
    lines = [r[0] for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert "  stemOverrides: pres=z nonfin=x pret=y" in lines and [x for x in lines if x.startswith("entry")] == ["entry: az", "entry: ab", "entry: bb", "entry: ba"]
    assert [r[0] for r in entries.select(nvh.generable()).collect()] == [False] * 4


def test_parity_report(spark, tmp_path):
    (tmp_path / "gold.txt").write_text("a\nb\n\nc\n")
    got = spark.createDataFrame([("a",), ("d",)], "surface string")
    gold = baking.gold_surfaces(spark, str(tmp_path / "gold.txt"), got)
    assert baking.parity_counts(gold, got).first()[:] == (3, 1, 2, 1, 33.33)
    baking.write_parity(baking.parity(gold, got), str(tmp_path / "review"))
    assert sorted(tuple(r) for r in spark.read.csv(str(tmp_path / "review"), sep="\t", header=True).collect()) == [("extra", "d"), ("missing", "b"), ("missing", "c")]
    assert baking.gold_surfaces(spark, None, got).count() == 2
