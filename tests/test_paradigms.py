import pytest

from lexloom.operators import compression, generation, reports
from lexloom.operators import paradigms as P


def test_roles_are_complete_and_disjoint():
    assert len({r[:3] for r in P.ROLES}) == 251
    for roles in P.SPEC.values():
        slots = [s for r in roles.values() for s in r]
        assert len(slots) == len(set(slots))
    tags = {s: P.slot_tag(s) for *_, s, _ in P.ROLES}
    assert len(set(tags.values())) == len(tags)


@pytest.mark.parametrize("slot", ["", "sg", "sg.nom.x", "prs.sg3", "part.prs.pss.msc.sg.nom", "imprt.sg1", "msc.sg", "adv.x", "opt.sg1"])
def test_wrong_slots(slot):
    with pytest.raises(ValueError):
        P.slot_tag(slot)


def test_tags():
    assert P.slot_tag("part.prf.pss.neu.pl.nom") == "+V+PrfPrc+Pss+Neu+Pl+Nom"
    assert (P.slot_tag("sg.nom"), P.slot_tag("adv.comp"), P.slot_tag("superl.fem.pl.dat"), P.slot_tag("prt.sp3"), P.slot_tag("opt")) == ("+N+Sg+Nom", "+Adv+Comp", "+A+Superl+Fem+Pl+Dat", "+V+Ind+Prt+SP3", "+V+Opt+SP3")


def test_labels():
    assert (P.resolve("noun", "35a"), P.resolve("Verb", "98"), P.resolve("num", "25")) == ("35", "100", "25")
    assert (P.resolve("verb", "87", "gandtun"), P.resolve("verb", "87", "gastun")) == ("87a", "87b")
    with pytest.raises(KeyError):
        P.resolve("noun", "99")


def test_accents():
    assert generation.accented("dumslē^īmans") == "dumsleīmans"
    assert generation.accented("mitāt^āi") == "mitatāi"
    assert (generation.accented("Rik>imans"), generation.accented("lukks"), generation.accented("rikk^ā"), generation.accented("kk~^ī")) == ("Rikkimans", "luks", "rikā", "kkī")


def test_generated_forms(spark):
    rows = [("verb", "85", "appautwei", None), ("verb", "143", "alkautwei", None), ("adj", "31", "tangus", None), ("noun", "53", "dumslē", {"obl": "dumslē"}), ("noun", "99", "x", None), ("noun", "53", "qx", None), ("verb", "132", "mitātun si", None)]
    df = spark.createDataFrame([(x, p, q, x, s) for p, q, x, s in rows], "lexeme string, pos string, paradigm string, lemma string, stems map<string,string>")
    got = {(r["lexeme"], r["slot"]): r["surfaces"] for r in generation.generate(df).collect()}
    assert got["appautwei", "part.prs.act.fem.sg.nom"] == ["appawintī"] and got["appautwei", "part.prf.pss.msc.sg.nom"] == ["appauts"]
    assert got["alkautwei", "prs.sg1"] == ["alkaui"] and got["alkautwei", "imprt.sg2"] == ["alkaus"]
    assert got["tangus", "msc.sg.gen"] == ["tangwas"] and got["tangus", "superl.msc.sg.nom"] == ["ukatanguisis"]
    assert got["dumslē", "sg.nom"] == ["dumsleē"] and got["mitātun si", "subj.sp3"] == ["mitālai"]
    assert not {"x", "qx"} & {k for k, _ in got}


def test_columns_agree_with_python(spark):
    forms = [s + e for s in ("stubbā", "ak>", "e~kk", "lukk") for e in {r[4] for r in P.ROLES}]
    df = spark.createDataFrame([(f,) for f in forms], "f string").select("f", generation.accent("f").alias("a"))
    assert all(generation.accented(r["f"]) == r["a"] for r in df.collect())


def test_stem_from_form():
    assert generation.stem_from_form("noun", "32", "obl", "sg.gen", "Kadollas") == "Kadoll"
    for slot, form in (("sg.gen", "x"), ("opt", "xas")):
        with pytest.raises(ValueError):
            generation.stem_from_form("noun", "32", "obl", slot, form)


def test_tables_and_names():
    assert P.table_faults() == []
    assert (P.atom_name("noun", "35a", "obl"), P.atom_name("verb", "87", "pres", "gandtun")) == ("gen-noun-35", "gen-verb-87a-pres")
    assert len(P.atoms()) == 251 and all(a[0] == "adj" for a in P.atoms("adj"))
    assert (P.slot_class("verb", "part.prs.act.msc.sg.nom"), P.slot_class("verb", "opt")) == ("participle", "verb")
    with pytest.raises(KeyError):
        P.atom_name("noun", "32", "pres")
    with pytest.raises(ValueError):
        generation.check_stem("qa")
    assert generation.check_stem("kadoll") == "kadoll"


def test_columns_of_rule_stems_agree_with_python(spark):
    lemmas = ["gandtun", "gastun", "alkautwei", "mitātun si", "kalbītwei", "kadols", "dumslē", "tangus", "dargnis", "smilgums", "lapātun", " kadās ", ""]
    labels = sorted({(k, p) for k, p in P.SPEC} | {(k, a) for k, xs in P.ALIASES.items() for a in xs} | {("verb", "87"), ("noun", "99"), ("num", "25")})
    rows = [(i, k, p, x, None) for i, (k, p, x) in enumerate((k, p, x) for k, p in labels for x in lemmas)]
    df = spark.createDataFrame(rows, "lexeme long, pos string, paradigm string, lemma string, stems map<string,string>")
    found = {(r["lexeme"], r["role"]): r["default"] for r in generation.role_stems(df).collect()}
    for i, k, p, x, _ in rows:
        if (k, p) != ("noun", "99"):
            for role, stem in P.default_stems(k, p, x).items():
                assert (i, k, p, x, role, found.get((i, role))) == (i, k, p, x, role, stem if not set(stem) - P.STEM_ALPHABET else None)
    assert not any(rows[i][1:3] == ("noun", "99") for i, _ in found)


SHAPE = "lexeme string, pos string, paradigm string, lemma string, stems map<string,string>"


def _made(spark, *rows):
    """What generation gives for lexemes, by slot."""
    found = generation.generate(spark.createDataFrame(list(rows), SHAPE)).collect()
    return {(r["lexeme"], r["slot"]): r["surfaces"] for r in found}


def _attested(spark):
    """Cells of four lexemes: one by rule, one by a stem of its own, one with a variant, one with cells that no stem gives."""
    made = _made(spark, ("ruled", "noun", "45", "toba", None), ("stem", "noun", "39", "sprida", {"obl": "sprind"}), ("variant", "adj", "31", "maitus", None), ("torn", "verb", "139", "stigītwei", None))
    cells = [(x, slot, f) for (x, slot), forms in made.items() for f in forms if x != "torn"]
    cells += [("variant", "adv", "maitei")]
    torn = sorted(slot for x, slot in made if x == "torn" and slot.startswith("prs."))
    return cells + [("torn", slot, f"stig{k}") for k, slot in enumerate(torn)], torn


def _rows():
    return [("ruled", "noun", "45", "toba", None), ("stem", "noun", "39", "sprida", None), ("variant", "adj", "31", "maitus", None), ("torn", "verb", "139", "stigītwei", None), ("none", "noun", "99", "none", None), ("bare", "noun", "45", "qux", None), ("given", "noun", "41", "glabsa", {"obl": "glabs"})]


def test_derivation(spark):
    """Status, rounds by lexeme, modes and the report."""
    cells, torn = _attested(spark)
    lexemes = spark.createDataFrame(_rows(), SHAPE)
    attested = spark.createDataFrame([*cells, ("none", "sg.nom", "none"), ("bare", "sg.nom", "qux")], "lexeme string, slot string, surface string")
    full = compression.derive(lexemes, attested)
    got = {r["lexeme"]: r for r in full.collect()}
    assert {k: r["status"] for k, r in got.items()} == {**dict.fromkeys(("ruled", "stem", "variant", "torn", "given"), "ok"), "none": "unknown_paradigm", "bare": "no_stem"}
    assert {k: r["rounds"] for k, r in got.items()} == {"ruled": 1, "stem": 2, "variant": 2, "torn": 2, "none": 2, "bare": 2, "given": 2}
    assert got["ruled"]["stems"] == {} and got["ruled"]["overrides"] == {} and got["ruled"]["by_rule"] == got["ruled"]["cells"] > 0
    assert got["stem"]["stems"] == {"obl": "sprind"} and got["stem"]["by_rule"] < got["stem"]["by_stem"]
    assert list(got["variant"]["overrides"]) == ["adv"] and got["variant"]["variant_overrides"] == 2
    assert got["torn"]["overrides"].keys() == set(torn) and got["torn"]["by_stem"] == 0
    assert got["given"]["redundant_stems"] == (["obl"] if P.default_stems("noun", "41", "glabsa")["obl"] == "glabs" else [])
    assert not any(r["unstable"] or r["redundant_overrides"] for r in got.values())
    bare = {r["lexeme"]: r for r in compression.derive(lexemes, attested, "lemma_only").collect()}
    assert bare["stem"]["stems"] == {} and bare["stem"]["overrides"] and {r["rounds"] for r in bare.values()} == {1}
    dense = {r["lexeme"]: r for r in compression.derive(lexemes, attested, "dense").collect()}
    assert len(dense["ruled"]["overrides"]) == len({s for x, s, _ in cells if x == "ruled"}) and dense["given"]["stems"] == {"obl": "glabs"}
    once = {r["lexeme"]: r for r in compression.derive(lexemes, attested, rounds=1).collect()}
    assert once["stem"]["stems"] == got["stem"]["stems"] and once["stem"]["unstable"] and not once["ruled"]["unstable"]
    text = reports.compression_text(compression.report(full, lexemes, attested))
    assert "left out: noun no_stem: 1" in text and "rounds 1: 1" in text and "obl=1" in text


def test_compression(spark):
    cells, torn = _attested(spark)
    lexemes = spark.createDataFrame(_rows()[:5], SHAPE)
    attested = spark.createDataFrame([*cells, ("none", "sg.nom", "none")], "lexeme string, slot string, surface string")
    lean, replaced = compression.compress(lexemes, attested)
    assert {r["lexeme"]: r["stems"] for r in lean.collect()} == {"ruled": {}, "stem": {"obl": "sprind"}, "variant": {}, "torn": {}, "none": {}}
    assert {(r["lexeme"], r["slot"]) for r in replaced.collect()} == {("variant", "adv"), ("none", "sg.nom"), *(("torn", s) for s in torn)}
    assert compression.verify(lean, replaced, attested).count() == 0
    assert compression.best_stems(lean, attested).count() == 0
