"""Rules as columns give what the interpreter gives: grammars of every construct, dealt at random, over random sentences."""

import random

import pytest
from pyspark.sql import functions as F

from lexloom.operators import constraints as C
from lexloom.operators import grammar_checks, reports, validation

SF = "/root/testdata/sf0.001"

SHAPE = "sent_id string, text string, cohorts array<struct<form:string,readings:array<struct<lemma:string,tags:array<string>>>>>"
TAGS = ["N", "V", "A", "Pr", "Nom", "Acc"]


def _sentences(seed, n=120):
    rnd = random.Random(seed)
    out = []
    for k in range(n):
        cohorts = []
        for _ in range(rnd.choice([0, 1, 2, 4, 6, 9])):
            if rnd.random() < 0.12:
                cohorts.append((".", [(".", ["CLB"])]))
                continue
            readings = [(rnd.choice(["ab", "ba", "c"]), rnd.sample(TAGS, rnd.choice([1, 1, 2, 3]))) for _ in range(rnd.choice([1, 1, 2, 3]))]
            cohorts.append((rnd.choice(["ab", "c", "D'e\\"]), readings))
        out.append((str(k // 2), "t", cohorts))  # keys repeat
    return out


def _set(rnd, deep=2):
    pick = rnd.random()
    if pick < 0.45 or not deep:
        return rnd.choice(["N", "V", "A", "Pr", "Nom", "Acc", "Case", "Names", "CLB", "(*)", "(N Acc)", '("<c>")', '(".*b"r)'])
    return f"{_set(rnd, 0)} {rnd.choice(['OR', '+', '-'])} {_set(rnd, deep - 1)}"


def _chain(rnd, deep=1):
    where = rnd.choice(["-2", "-1", "0", "1", "2", "1*", "-1*", "2*", "p", "c", "s", "c*", "p*"])
    out = ["NOT "] * (rnd.random() < 0.2) + ["NEGATE "] * (rnd.random() < 0.1) + [where + "C" * (rnd.random() < 0.3), f" {_set(rnd, 1)}"]
    if "*" in where and where[0] not in "pcs" and rnd.random() < 0.5:
        out.append(f" BARRIER {_set(rnd, 0)}")
    if deep and rnd.random() < 0.3:
        out.append(f" LINK {_chain(rnd, deep - 1)}")
    return "".join(out)


def _context(rnd):
    return f"({_chain(rnd)})" if rnd.random() < 0.9 else f"(({_chain(rnd)}) OR ({_chain(rnd)}))"


def _grammar(seed):
    rnd = random.Random(seed)
    lines = ['DELIMITERS = "<.>" ;', "MAPPING-PREFIX = @ ;", *(f"LIST {t} = {t} ;" for t in [*TAGS, "CLB"]), "LIST Case = Nom Acc ;", 'LIST Names = "ab" "c" (N Nom) ;', "LIST Zero = Missing ;", "BEFORE-SECTIONS"]
    for k in range(14):
        if k in (2, 6, 10):
            lines.append("SECTION")
        action = rnd.choice(["SELECT", "REMOVE", "ADD", "MAP", "SETPARENT", "SETPARENT", "SETCHILD", "ADDRELATION"])
        given = {"ADD": rnd.choice(["(&e)", "(@x)", "(Extra)"]), "MAP": "(@m)", "ADDRELATION": "(rel)"}.get(action, "")
        name = f":r{k}" if rnd.random() < 0.7 else ""
        contexts = " ".join(_context(rnd) for _ in range(rnd.choice([0, 1, 1, 2])))
        to = f" TO ({_chain(rnd)})" if action in ("SETPARENT", "SETCHILD", "ADDRELATION") else ""
        lines.append(f"{action}{name} {given} {_set(rnd)}{to}{' IF' if contexts and not to else ''} {contexts} ;")
    return "\n".join(lines)


def _plain(row):
    return row.asDict(recursive=True)


@pytest.mark.parametrize("seed", [1, 4, 5])
def test_columns_equal_the_interpreter(spark, seed):
    df = spark.createDataFrame([(*s, 1) for s in _sentences(seed)], SHAPE + ", frequency int").coalesce(2).cache()
    grammars = [_grammar(seed), _grammar(seed + 100)]
    wanted = [_plain(r) for r in C.analysed(df, grammars, snapshot=2, interpret=True).collect()]
    got = [_plain(r) for r in C.analysed(df, grammars, snapshot=2).collect()]
    assert got == wanted
    assert any(c["rules"] for r in got for c in r["cohorts"])


def test_no_python_runs_on_the_rows(spark):
    df = spark.createDataFrame(_sentences(1, 10), SHAPE)
    plan = C.analysed(df, [_grammar(1)])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "MapInPandas" not in plan


def test_rules_that_undo_each_other(spark):
    text = """DELIMITERS = "<.>" ; LIST N = N ; LIST V = V ; SECTION
    SETPARENT:left N TO (-1 V) ; SETPARENT:right N TO (1 V) ;"""
    row = ("1", "t", [("a", [("a", ["V"])]), ("b", [("b", ["N"])]), ("c", [("c", ["V"])]), (".", [(".", ["CLB"])]), ("n", [("n", ["N"])])])
    df = spark.createDataFrame([row], SHAPE)
    got, wanted = (_plain(C.analysed(df, [text], interpret=k).first())["cohorts"] for k in (False, True))
    assert got == wanted and C.UNSETTLED in got[1]["rules"] and not got[4]["rules"]


def test_long_chains(spark):
    """A decision that moves one word to the left a pass."""
    text = """DELIMITERS = "<.>" ; LIST N = N ; LIST V = V ; LIST E = E ; SECTION
    REMOVE V IF (1C E) ; REMOVE:chain V IF (1C N) ;"""
    words = [("w", [("w", ["N"]), ("w", ["V"])])] * 50 + [("e", [("e", ["E"])])]
    row = C.analysed(spark.createDataFrame([("1", "t", words)], SHAPE), [text]).first()
    assert all(len(c["readings"]) == 1 and C.UNSETTLED not in c["rules"] for c in row["cohorts"])
    assert [(t["pos"], t["pass"]) for t in row["trace"]][:3] == [(49, 1), (48, 1), (47, 2)] and len(row["trace"]) == 50


def test_trace_and_reports(spark):
    text = 'DELIMITERS = "<.>" ; LIST N = N ; LIST V = V ; BEFORE-SECTIONS REMOVE V IF (1 V) ; SECTION SELECT:noun N ; ADD (&odd) N IF (1 V) ;'
    cohorts = [("a", [("a", ["N"]), ("a", ["V"]), ("a", ["A"])]), ("b", [("b", ["V"]), ("c", ["V"])])]
    df = spark.createDataFrame([("s", "a b", cohorts), ("s", "a b", cohorts)], SHAPE)
    done = C.analysed(df, [text])
    rows = C.removals(done).orderBy("pass").select("sent_id", "pos", "form", "grammar", "section", "pass", "rule", "reading").collect()
    assert [tuple(r) for r in rows] == [("s", 0, "a", 0, 0, 0, "REMOVE:1", "a+V")] * 2 + [("s", 0, "a", 0, 1, 1, "noun", "a+A")] * 2
    errors = validation.detected_errors(done).collect()
    assert [(r["index"], r["kind"], r["n_before"]) for r in errors] == [(1, "&odd", 3)] * 2
    top = reports.ambiguous_sentences(done, n=5).collect()
    assert len(top) == 2 and top[0]["details"][0]["before"] == ["b+V", "c+V"]
    assert reports.trace_text(done).split("\n")[0] == "REMOVE:1: 2"


def test_checks_of_a_grammar(spark):
    text = """DELIMITERS = "<.>" ; LIST N = N ; LIST Lost = Part ; SET Unused = N OR Lost ; LIST P = (Part Nom) ;
    SECTION
    SELECT:fine N IF (1 N) ;
    SELECT:never P ;
    REMOVE:blocked N IF (-1 Lost) ;
    REMOVE:open N IF (NOT -1 Lost) ;
    SELECT:half N OR P ;
    ADD:linked (&e) N IF (1 N LINK 1 Lost) ;
    """
    found = grammar_checks.faults(C.parse_grammar(text), {"N", "Nom"})
    assert [(f["kind"], f["name"]) for f in found] == [("inert rule", "never"), ("inert rule", "blocked"), ("inert rule", "linked"), ("empty set", "Lost"), ("empty set", "P"), ("unused set", "Unused")]
    assert found[0]["tags"] == ["Part"]
    table = spark.createDataFrame([("a", ["N", "Nom"])], "lemma string, tags array<string>")
    assert grammar_checks.inventory(table) == {"N", "Nom", "CLB", "PUNCT", "Unk"}


def test_equal_keys_and_missing_ones(spark):
    """Sentences that share a key, or have none, and known words."""
    tokens = [("k", "As mes.", ["As", "mes", "."]), ("k", "As mes.", ["As", "mes", "."]), (None, "mes x", ["mes", "x"]), (None, "!", ["!"]), ("e", "", [])]
    df = spark.createDataFrame([(*t, 7) for t in tokens], "sent_id string, text string, tokens array<string>, frequency long")
    readings = spark.createDataFrame([("mes", [("mes", ["Pron"])]), ("As", [("as", ["Pron"])]), ("x", [])], "token string, readings array<struct<lemma:string,tags:array<string>>>")
    rows = C.cohorts_of(df, readings).orderBy(F.col("sent_id").desc(), "text").collect()
    shown = [(r["sent_id"], r["frequency"], [c["form"] + ":" + c["readings"][0]["tags"][0] for c in r["cohorts"]]) for r in rows]
    both = ("k", 7, ["As:Pron", "mes:Pron", ".:CLB"])
    assert shown == [both, both, ("e", 7, []), (None, 7, ["!:CLB"]), (None, 7, ["mes:Pron", "x:Unk", ".:CLB"])]


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rules_run_once(spark):
    """One operator of the plan holds the rules: verdicts are summed up in one pass, and no filter runs them again."""
    from lexloom.plans import lexicon, rules

    plans = [(rules.QUERIES["rule_family"], "far"), (rules.QUERIES["rule_trace"], "no-verb"), (lexicon.QUERIES["dep_labels"], "to-verb"), (lexicon.QUERIES["validate_status"], "to-verb")]
    assert [sum(word in line for line in _plan(q(spark, SF)).splitlines()) for q, word in plans] == [1, 1, 1, 1]


def test_rows_are_spread(spark):
    """A small file of conversations is not one task's (it was)."""
    from lexloom.plans import rules

    assert rules._cohorts(spark, SF).rdd.getNumPartitions() >= 2
