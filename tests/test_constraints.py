import pytest

from lexloom.operators import constraints as C
from lexloom.operators import validation


def _cohort(form, *readings, **more):
    return {"form": form, "readings": [{"lemma": x.split("+")[0], "tags": x.split("+")[1:]} for x in readings], "parent": None, "agr_parent": None, "relations": [], "rules": [], "errors": []} | more


def _run(grammar, *cohorts, snapshot=None, includes=None):
    own = [C.Cohort(c["form"], [C.Reading(r["lemma"], list(r["tags"])) for r in c["readings"]]) for c in cohorts]
    C.run_grammar(C.parse_grammar('DELIMITERS = "<.>" ;\n' + grammar, includes), own, snapshot)
    return own


def _left(cohorts):
    return [["+".join([r.lemma, *r.tags]) for r in c.readings] for c in cohorts]


A, B = _cohort("a", "a+N+Nom", "a+N+Acc"), _cohort("b", "b+V", "b+N+Acc")


@pytest.mark.parametrize(
    ("rule", "left"),
    [
        ("SELECT (Nom) ;", ["a+N+Nom"]),
        ("REMOVE (Nom) ;", ["a+N+Acc"]),
        ("REMOVE SAFE (N) ;", ["a+N+Nom", "a+N+Acc"]),
        ("SELECT (Nom) IF (1 (V)) ;", ["a+N+Nom"]),
        ("SELECT (Nom) IF (1C (V)) ;", ["a+N+Nom", "a+N+Acc"]),
        ("SELECT (Nom) IF (NOT 1 (V)) ;", ["a+N+Nom", "a+N+Acc"]),
        ("SELECT (Nom) IF (NOT -1 (V)) ;", ["a+N+Nom"]),
        ("SELECT (Nom) IF (NEGATE 1 (V) LINK 1 (Adv)) ;", ["a+N+Nom"]),
        ("SELECT (Nom) IF (1 (V) LINK 1 (CLB)) ;", ["a+N+Nom"]),
        ("SELECT (Nom) IF (1* (CLB)) ;", ["a+N+Nom"]),
        ("SELECT (Nom) IF (1* (CLB) BARRIER (V)) ;", ["a+N+Nom", "a+N+Acc"]),
        ("SELECT (Nom) IF ((-1 (V)) OR (1 (V))) ;", ["a+N+Nom"]),
        ("LIST X = \"a\" ; SET Y = X + (N) - (Acc) ; SELECT Y ;", ["a+N+Nom"]),
        ('LIST X = "<a>" ; LIST R = ".*"r ; SET Y = (Acc) OR (Gen) - R ; SELECT Y + X ;', ["a+N+Acc"]),
        ("LIST BOS = (>>>) ; SELECT (Nom) IF (0 BOS) ;", ["a+N+Nom"]),
    ],
)
def test_readings(rule, left):
    lists, _, last = rule.rpartition("; S") if rule.startswith("LIST") else ("", "", rule)
    body = f"{lists} ;\nSECTION\nS{last}" if lists else f"SECTION\n{rule}"
    assert _left(_run(body, A, B, _cohort(".", ".+CLB")))[0] == left


def test_attachment_refuses_loops_and_keeps_windows_apart():
    g = "SECTION\nSETPARENT (N) TO (1* (V)) ;\nSETPARENT (V) TO (-1* (N)) ;\nSECTION\nADDRELATION (obj) (N) TO (p (V)) ;\nADD:late (&e) (V) IF (c (N)) ;"
    got = _run(g, _cohort("n", "n+N"), _cohort("v", "v+V"), _cohort(".", ".+CLB"), _cohort("m", "m+N"), _cohort("w", "w+V"), snapshot=1)
    assert [c.parent for c in got] == [1, None, None, 4, None]
    assert got[0].relations == [("obj", 1)] and got[3].relations == [("obj", 4)] and got[3].agr_parent == 4
    assert got[1].rules == ["late"] and "&e" in got[1].readings[0].tags


def test_siblings_children_and_setchild():
    g = "BEFORE-SECTIONS\nSETCHILD (V) TO (-1 (N)) ;\nSETPARENT (Adv) TO (-1 (V)) ;\nSECTION\nADD (@s) (N) IF (s (Adv)) ;\nADD (@c) (V) IF (c (N)) ;"
    got = _run(g, _cohort("n", "n+N"), _cohort("v", "v+V"), _cohort("x", "x+Adv"))
    assert [c.parent for c in got] == [1, None, 1] and _left(got) == [["n+N+@s"], ["v+V+@c"], ["x+Adv"]]


def test_map_locks_and_includes():
    got = _run("INCLUDE more ;\nSECTION\nMAP (@one) X ;\nMAP (@two) X ;", _cohort("n", "n+N"), includes={"more": 'LIST X = "n" ;'})
    assert _left(got) == [["n+N+@one"]]


def test_sections_repeat():
    g = "SECTION\nREMOVE (a) IF (1C (x)) ;\nSECTION\nREMOVE (y) ;"
    assert _left(_run(g, _cohort("1", "l+a", "l+b"), _cohort("2", "m+x", "m+y"))) == [["l+b"], ["m+x"]]


def test_wrong_grammars():
    for text in ("SECTION\nSELECT Missing ;", "FOO bar ;", "SECTION\nSELECT (a) IF (x (b)) ;"):
        with pytest.raises(ValueError):
            C.parse_grammar(text)


def test_stream_round_trip():
    cohorts = [_cohort("as", "as+Pron+Nom", parent=1), _cohort("asma", "būtwei+V+Ind")]
    got = C.from_stream(C.to_stream(cohorts))
    assert [(c["form"], c["readings"], c["parent"]) for c in got] == [(c["form"], c["readings"], c["parent"]) for c in cohorts]
    traced = '"<n>"\n\t"n" N &err @X #1->2 ID:5 ADD:12:late R:obj:6\n;\t"n" A REMOVE:3:first\n"<v>"\n\t"v" V #2->2 ID:6\n'
    one = C.from_stream(traced)[0]
    assert (one["errors"], one["rules"], one["relations"], one["readings"], one["parent"]) == (["&err"], ["late", "first"], [{"label": "obj", "target": 1}], [{"lemma": "n", "tags": ["N"]}], 1)


def _verdict(spark, *cohorts, genitive=()):
    rows = [("s", "t", [dict(c) for c in cohorts])]
    df = spark.createDataFrame(rows, "sent_id string, text string, cohorts " + C.COHORTS)
    return validation.validated(df, list(genitive)).first()


def test_verdicts(spark):
    verb, end = _cohort("asma", "būtwei+V+Ind"), _cohort(".", ".+CLB")
    assert _verdict(spark, verb, end)["status"] == "verified_in_coverage"
    r = _verdict(spark, _cohort("x", "x+Unk"), _cohort("n", "n+N", errors=["&pp-nom"]), end)
    assert (r["status"], r["reasons"], r["violations"][0]["severity"], r["violations"][0]["index"]) == ("violations_found", [], "warning", 2)
    r = _verdict(spark, _cohort("x", "x+Unk", errors=["&e"]), end)
    assert (r["status"], r["reasons"]) == ("out_of_coverage", ["oov", "no_applicable_checks"])
    r = _verdict(spark, _cohort("n", "n+N", "m+N"), verb, _cohort("mes", "mes+Pron+Nom"), _cohort("y", "y+A", parent=0), end)
    assert r["reasons"] == ["unlicensed_case"] and r["checks_relevant"] == ["adj-agr", "pred-nom"]
    assert _verdict(spark, _cohort("n", "n+N", "m+N"), verb, end)["reasons"] == ["residual_ambiguity"]
    r = _verdict(spark, _cohort("as", "as+Pron+P1+Nom"), verb, _cohort("ēn", "ēn+Pr"), _cohort("k", "kwaitītun+V"), _cohort("stas", "stas+Pron+Gen"), genitive=["kwaitītun"])
    assert r["checks_relevant"] == ["genverb", "pred-nom", "prep-case", "steisan", "subj-verb"]


def test_conllu(spark):
    rows = [("s1", "As asma.", [_cohort("As", "as+Pron+P1+Sg+Nom", parent=1, relations=[{"label": "nsubj", "target": 1}], rules=["r"]), _cohort("asma", "būtwei+V+Ind+Prs+Sg1"), _cohort("ēn", "ēn+Pr", "ēn+Pr+X"), _cohort(".", ".+CLB")]), ("s2", "x", [_cohort("x", "x+Unk")])]
    df = spark.createDataFrame(rows, "sent_id string, text string, cohorts " + C.COHORTS)
    got = {r["sent_id"]: r["block"] for r in validation.conllu(df, {"ēn": "Dat"}).collect()}
    assert got["s2"] is None
    assert got["s1"].split("\n") == [
        "# sent_id = s1", "# text = As asma.",
        "1\tAs\tas\tPRON\tPron+P1+Sg+Nom\tCase=Nom|Number=Sing|Person=1\t2\tnsubj\t_\tRule=r",
        "2\tasma\tbūtwei\tVERB\tV+Ind+Prs+Sg1\tMood=Ind|Number=Sing|Person=1|Tense=Pres\t0\troot\t_\t_",
        "3\tēn\tēn\tADP\t_\t_\t2\tdep\t_\tGov=Dat|Ambig=2", "4\t.\t.\tPUNCT\t_\t_\t2\tpunct\t_\t_",
    ]


def test_analysed_frames(spark):
    df = C.frame_of([[_cohort("a", "a+N+Nom", "a+N+Acc"), _cohort(".", ".+CLB")]], spark)
    after = C.analysed(df, ['DELIMITERS = "<.>" ;\nSECTION\nSELECT:pick (Nom) ;'])
    row = after.first()
    assert row["cohorts"][0]["readings"][0]["tags"] == ["N", "Nom"] and row["cohorts"][0]["rules"] == ["pick"]
    assert validation.detected_errors(after).count() == 0


def test_rules_that_undo_each_other_end():
    text = """DELIMITERS = "<.>" ; LIST N = N ; LIST V = V ; SECTION
    SETPARENT:left N TO (-1 V) ; SETPARENT:right N TO (1 V) ;"""
    own = [C.Cohort(f, [C.Reading(f, [t])]) for f, t in (("a", "V"), ("b", "N"), ("c", "V"))]
    C.run_grammar(C.parse_grammar(text), own)
    assert C.UNSETTLED in own[1].rules and own[1].parent in (0, 2)


def test_long_chains_settle():
    """A decision that moves one word to the left a pass takes as many passes as it needs."""
    text = """DELIMITERS = "<.>" ; LIST N = N ; LIST V = V ; LIST E = E ; SECTION
    REMOVE V IF (1C E) ; REMOVE V IF (1C N) ;"""
    own = [C.Cohort("w", [C.Reading("w", ["N"]), C.Reading("w", ["V"])]) for _ in range(80)] + [C.Cohort("e", [C.Reading("e", ["E"])])]
    C.run_grammar(C.parse_grammar(text), own)
    assert all(len(c.readings) == 1 for c in own) and C.UNSETTLED not in own[0].rules


def test_sections_before():
    text = "SECTION\nSELECT N ;\n  SECTION  agr ;\nSECTION dep-tree # here\nSECTION\n"
    assert C.sections_before(text) == 2 and C.sections_before(text, "agr") == 1 and C.sections_before("") is None


def test_expectation_files(spark, tmp_path):
    """The three kinds of expectation rows against an analysis, met and missed."""
    from lexloom.operators import validation
    from lexloom.plans import api
    from lexloom.plans.lexicon import DEMO_GRAMMAR
    from lexloom.sources import lexicon, nvh

    docs = spark.createDataFrame([(1, "As ne ei astits."), (2, "As mes astits.")], "doc_id long, text string")
    done = api.analyze(docs, lexicon.analysis_table(spark), [DEMO_GRAMMAR])
    files = {
        "readings": ("# sentence\ttoken\treadings\n\nAs ne ei astits.\tastits\tbūtwei+V+Rel+Prs+SP3\nAs ne ei astits.\tne\tne+Adv\n", ["sentence", "token", "readings"], [("ne", ["ne+Adv"])]),
        "errors": ("As ne ei astits.\tAs\t-\nAs mes astits.\tAs\tsubj-dup\nAs mes astits.\tmes\t-\n", ["sentence", "token", "errors"], [("mes", [])]),
        "dependency": ("As mes astits.\tmes\tastits\tnsubj\nAs mes astits.\tastits\t0\troot\nAs mes astits.\tAs\tmes\tdep\n", ["sentence", "token", "head", "deprel"], [("As", ["mes", "dep"])]),
    }
    for what, (text, columns, missed) in files.items():
        (tmp_path / what).write_text(text)
        faults = validation.golden_faults(done, nvh.golden(spark, str(tmp_path / what), columns), what).collect()
        assert [(r["token"], r["expected"]) for r in faults] == missed
