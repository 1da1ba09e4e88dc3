import re

from lexloom.operators import lookup
from lexloom.plans import api
from lexloom.sources import lexicon


def _types(spark, *words):
    return spark.createDataFrame([(w, 1) for w in words], "token string, n long")


def test_cascade(spark):
    rows = [*lexicon.closed_rows(), ("lābs+A", "lābban"), ("wuns+N", "wunds"), ("ēn+Pr", "ēn"), ("Berlins+N", "Berlins")]
    found = {r["token"]: (r["stage"], sorted(x["lemma"] for x in r["readings"])) for r in lookup.cascade(_types(spark, "mes", "MES", "berlins", "En", "laban", "unds", "xyz"), lexicon.analysis_table(spark, rows), lenient=True).collect()}
    assert found == {"mes": ("surface", ["mes"]), "MES": ("lower", ["mes"]), "berlins": ("title", ["Berlins"]), "En": ("preposition", ["ēn"]), "laban": ("lenient lower", ["lābs"]), "unds": ("lenient lower", ["wuns"]), "xyz": (None, [])}


def test_tolerance_is_directional():
    assert lookup.accepts("labban", "lābban") and not lookup.accepts("lābban", "labban")
    assert lookup.accepts("laban", "labban") and not lookup.accepts("labban", "laban") and not lookup.accepts("dafas", "daffas")
    assert lookup.accepts("skaitun", "skaitwei") and not lookup.accepts("skaitwei", "skaitun")
    assert lookup.accepts("uns", "wuns") and lookup.accepts("kasts", "kastis") and lookup.accepts("kastsi", "kasts")
    for query, surface in (("laban", "lābban"), ("uns", "wuns"), ("kastsi", "kasts"), ("kasts", "kastis"), ("kaitun", "kaitwei")):
        assert lookup.lenient_fold(query) == lookup.lenient_fold(surface)


def test_tolerance_as_columns(spark):
    words = ["labban", "lābban", "laban", "daffas", "dafas", "skaitwei", "skaitun", "uns", "wuns", "kasts", "kastis", "kastsi", "a.b", "āss", "as", "ass", "wunsts", "unstsi", "ppa", "pa", ""]
    df = spark.createDataFrame([(a, b) for a in words for b in words], "q string, s string")
    for r in df.select("q", "s", lookup.lenient_accepts("q", "s").alias("ok"), lookup.lenient_key("q").alias("key")).collect():
        assert r["ok"] == lookup.accepts(r["q"], r["s"]) and r["key"] == lookup.lenient_fold(r["q"])


def test_resolve_forms(spark):
    table = lexicon.analysis_table(spark, [("labs+A+Fem+Sg+Acc", "lābban"), ("As+Pron", "As"), ("as+Pron", "as")])
    forms = spark.createDataFrame([(f,) for f in ("as", "AS", "labban", "laban", "čas", "nein")], "form string")
    got = {r["form"]: (r["method"], r["lemmas"]) for r in lookup.resolve_forms(forms, table).collect()}
    assert got == {"as": ("exact", ["as"]), "AS": ("case", ["As", "as"]), "labban": ("macron", ["labs"]), "laban": ("lenient", ["labs"]), "čas": ("gap", []), "nein": ("gap", [])}


def test_generate_and_tags(spark):
    table = lexicon.analysis_table(spark)
    asked = spark.createDataFrame([("as+Pron+P1+Sg+Dat",), ("as+Pron+Sg+P1+Dat",)], "analysis string")
    assert {r[0]: r[1] for r in api.generate(asked, table).collect()} == {"as+Pron+P1+Sg+Dat": ["mennei"], "as+Pron+Sg+P1+Dat": []}
    words = spark.createDataFrame([("mi",), ("nope",)], "token string")
    assert {r[0]: r[1] for r in api.tags(words, table).collect()} == {"mi": ["as+Pron+P1+Encl+Sg+Acc", "as+Pron+P1+Encl+Sg+Dat"], "nope": []}
    assert api.check_artifacts(spark, {"table": "/no/such/path"}) == ["table is missing: /no/such/path"]


def test_lexc(spark, tmp_path):
    text = "LEXICON Root\n  wok P1 ; ! stem\n  a% b:a%!b # ;\n P2 ;\nLEXICON P1\n +N+Sg+Nom:s # ;\n +N+Pl:0 # ;\nLEXICON P2\n x+Adv:x # ;\n"
    assert lexicon.expand_lexc(lexicon.parse_lexc(text), "Root") == [("wok+N+Sg+Nom", "woks"), ("wok+N+Pl", "wok"), ("a b", "a!b"), ("x+Adv", "x")]
    (tmp_path / "a.lexc").write_text(text)
    rows = {(r["surface"], r["lemma"], tuple(r["tags"])) for r in lexicon.read_lexc(spark, str(tmp_path), "Root").collect()}
    assert rows == {("woks", "wok", ("N", "Sg", "Nom")), ("wok", "wok", ("N", "Pl")), ("x", "x", ("Adv",))}
    assert re.search("SELECT DISTINCT", lexicon.values_sql())
    table = lexicon.from_pairs(spark.createDataFrame([("a b+N:x", "a!b"), ("0%+V", "0;#"), ("x+Adv", "x")], "analysis string, surface string"))
    lexicon.write_lexc(table, str(tmp_path / "w"))
    assert {(r["analysis"], r["surface"]) for r in lexicon.read_lexc(spark, str(tmp_path / "w"), "Root").collect()} == {(r["analysis"], r["surface"]) for r in table.collect()}
    assert lexicon.named_list('LIST A = "x" ;\nLIST GenVerb = "b" "a" ;', "GenVerb") == ["a", "b"] and lexicon.named_list("", "GenVerb") == []
