"""Text functions as column expressions; only Unicode normal forms, entities and escapes need a pandas UDF."""

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What a token is, where sentences end, and the marks that end one.
LETTERS = r"[\p{L}\p{Nl}\p{No}]"
MARKS = '[.!?,;:„“”"()«»…—–-]'
TOKEN = rf"{LETTERS}+(?:['-]{LETTERS}+)*|{MARKS}"
SENTENCE_END = r"(?U)(?<=[.!?])\s+"
FINAL = (".", "!", "?")
# Links with their texts, and addresses and names of images, in Markdown.
LINK = r"!?\[([^\]]*)\]\([^)]*\)"
ADDRESS = r"(?i)https?://\S+|www\.\S+|\S+\.(?:jpe?g|png|gif|webp)\b\S*"
LONG, SHORT = "āēīōūĀĒĪŌŪ", "aeiouAEIOU"
TARGET_WORDS = 4


def tokenize(text) -> Column:
    """All words (letter runs joined by apostrophe or hyphen) and single punctuation marks, in order."""
    return F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(1))


def is_letter_first(token) -> Column:
    return F.col(token).rlike(r"^\p{L}") if isinstance(token, str) else token.rlike(r"^\p{L}")


def sentences(text) -> Column:
    """The pieces of a stripped text after ``.``, ``!`` or ``?`` and white space."""
    return F.split(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), SENTENCE_END)


def titlecase(token) -> Column:
    """The first character in upper case, the rest as it is."""
    return F.concat(F.upper(F.substring(token, 1, 1)), F.expr(f"substring({token}, 2)") if isinstance(token, str) else F.substring(token, F.lit(2), F.length(token)))


def case_variants(form: str) -> Column:
    """The form, its lower case, and its lower case with a capital, without repeats."""
    low = F.lower(form)
    capital = F.concat(F.upper(F.substring(form, 1, 1)), F.lower(F.expr(f"substring({form}, 2)")))
    return F.array_distinct(F.array(F.col(form), low, capital))


def short_vowels(text) -> Column:
    """Long vowels without their macrons."""
    return F.translate(text, LONG, SHORT)


def folded(text) -> Column:
    """Lower case for comparison without case: also letters that lower case alone keeps apart (ß and ss, final sigma, long s)."""
    return F.translate(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), "ςſ", "σs")


def in_alphabet(form) -> Column:
    """Only letters of the base alphabet, long vowels, blanks and hyphens."""
    return F.lower(form).rlike(r"^[a-zāēīōū \-]*$")


def arrow_targets(desc) -> Column:
    """The trimmed, non-empty texts after each arrow, up to the next arrow, comma or bracket."""
    found = F.regexp_extract_all(desc, F.lit("↑\\s*([^↑,\\[]*)"), F.lit(1))
    return F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: x != "")


def without_attestations(desc) -> Column:
    return F.trim(F.regexp_replace(desc, r"\[.*?\]", ""))


def markdown_plain(line) -> Column:
    """Link texts without their targets; addresses and image names become a blank."""
    return F.regexp_replace(F.regexp_replace(line, LINK, "$1"), ADDRESS, " ")


def without_tags(markup) -> Column:
    """Markup without tags, white space collapsed (entities stay)."""
    return F.trim(F.regexp_replace(F.regexp_replace(markup, "<[^>]*>", ""), r"[\s\x{A0}]+", " "))


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


@F.pandas_udf(T.StringType())
def strip_marks(text: pd.Series) -> pd.Series:
    """All combining marks removed."""
    return text.map(lambda t: "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn"), na_action="ignore")


def decoded(value: str) -> str:
    """One-line escapes undone: backslash with n or r is a line end, before any other character it goes."""
    ends = {"n": "\n", "r": "\r"}
    return re.sub(r"\\(.)", lambda m: ends.get(m[1], m[1]), value, flags=re.S)


def plain(value: str) -> str:
    """A description as plain text: escapes undone, tags removed, entities resolved, white space collapsed."""
    return " ".join(html.unescape(re.sub(r"<[^>]*>", "", decoded(value))).split())


@F.pandas_udf(T.StringType())
def plain_description(value: pd.Series) -> pd.Series:
    return value.map(plain, na_action="ignore")
