"""All queries of the engine and their SQL."""

from .plans import corpus, lexicon, rules


def queries() -> dict:
    return corpus.QUERIES | lexicon.QUERIES | rules.QUERIES


def oracle_sql() -> dict[str, str]:
    return corpus.SQL | lexicon.SQL | rules.SQL
