from pyspark.sql import functions as F

from lexloom.functions import text as tx


def _one(spark, value, *columns):
    return spark.createDataFrame([(value,)], "t string").select(*columns).first()


def test_tokens(spark):
    said = "Labban dēinan! As ni-waīda t'is: 12 x_y „ka” — …"
    assert _one(spark, said, tx.tokenize("t"))[0] == ["Labban", "dēinan", "!", "As", "ni-waīda", "t'is", ":", "x", "y", "„", "ka", "”", "—", "…"]
    assert _one(spark, None, tx.tokenize("t"))[0] is None and _one(spark, " 12 ", tx.tokenize("t"))[0] == []


def test_sentences(spark):
    assert _one(spark, " A b. C! \n D? e", tx.sentences("t"))[0] == ["A b.", "C!", "D?", "e"]


def test_case_and_vowels(spark):
    assert _one(spark, "dĒinā", tx.titlecase("t"), tx.case_variants("t"), tx.short_vowels("t"), tx.in_alphabet("t"))[:] == ("DĒinā", ["dĒinā", "dēinā", "Dēinā"], "dEina", True)
    assert _one(spark, "čaš", tx.in_alphabet("t"), tx.strip_marks("t"), tx.nfc("t"))[:] == (False, "cas", "čaš")


def test_descriptions(spark):
    r = _one(spark, "↑Mes, ↑ tū [↑x] ↑ ↑as", tx.arrow_targets("t"), tx.without_attestations("t"))
    assert r[0] == ["Mes", "tū", "x]", "as"] and r[1] == "↑Mes, ↑ tū  ↑ ↑as"
    assert tx.decoded("a\\nb\\\\n\\x") == "a\nb\\nx"
    assert tx.plain("<b>a</b>\\n&amp;  c") == "a & c"
    assert _one(spark, "see [the site](http://x.y/z) and www.a.b or pic.png now", F.regexp_replace(tx.markdown_plain("t"), " +", " "))[0] == "see the site and or now"
    assert _one(spark, "<p>a &amp;\n b</p>", tx.without_tags("t"), tx.plain_description("t"))[:] == ("a &amp; b", "a & b")
