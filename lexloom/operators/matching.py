"""What a reading must be like: tests of rules, asked in Python, written as SQL, or checked against an inventory of tags.

Each test is called with a cohort, one of its readings and the cohort's place in the window; ``sql`` gives the same test over the
names of a cohort, a reading and a place; ``possible`` says whether any reading with those tags can pass.
"""

import re
from dataclasses import dataclass

HIDDEN = ("@", "&", "§")


def literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def array_of(texts) -> str:
    return f"array({', '.join(literal(t) for t in texts)})" if texts else "cast(array() AS array<string>)"


class Test:
    def __call__(self, cohort, reading, place: int) -> bool:
        raise NotImplementedError

    def sql(self, cohort: str, reading: str, place: str) -> str:
        raise NotImplementedError

    def parts(self) -> tuple:
        return ()

    def places_matter(self) -> bool:
        """Whether the test looks at the place."""
        return any(p.places_matter() for p in self.parts())

    def possible(self, tags: frozenset) -> bool:
        return True

    def missing(self, tags: frozenset) -> set:
        """Tags that the test names and the inventory lacks."""
        return set().union(*(p.missing(tags) for p in self.parts()))


@dataclass(frozen=True)
class Anything(Test):
    def __call__(self, cohort, reading, place):
        return True

    def sql(self, cohort, reading, place):
        return "true"


@dataclass(frozen=True)
class First(Test):
    """The beginning of a window."""

    def __call__(self, cohort, reading, place):
        return place == 0

    def sql(self, cohort, reading, place):
        return f"({place} = 0)"

    def places_matter(self):
        return True


@dataclass(frozen=True)
class Form(Test):
    value: str

    def __call__(self, cohort, reading, place):
        return cohort.form == self.value

    def sql(self, cohort, reading, place):
        return f"({cohort}.form = {literal(self.value)})"


@dataclass(frozen=True)
class Lemma(Test):
    value: str

    def __call__(self, cohort, reading, place):
        return reading.lemma == self.value

    def sql(self, cohort, reading, place):
        return f"({reading}.lemma = {literal(self.value)})"


@dataclass(frozen=True)
class LemmaPattern(Test):
    value: str

    def __call__(self, cohort, reading, place):
        return re.fullmatch(self.value, reading.lemma) is not None

    def sql(self, cohort, reading, place):
        return f"({reading}.lemma rlike {literal(f'^(?:{self.value})$')})"


@dataclass(frozen=True)
class Tag(Test):
    value: str

    def __call__(self, cohort, reading, place):
        return self.value in reading.tags

    def sql(self, cohort, reading, place):
        return f"array_contains({reading}.tags, {literal(self.value)})"

    def possible(self, tags):
        return self.value in tags or self.value.startswith(HIDDEN)

    def missing(self, tags):
        return set() if self.possible(tags) else {self.value}


@dataclass(frozen=True)
class Both(Test):
    """All of several tests, of one reading."""

    tests: tuple

    def __call__(self, cohort, reading, place):
        return all(t(cohort, reading, place) for t in self.tests)

    def sql(self, cohort, reading, place):
        return "(" + " AND ".join(t.sql(cohort, reading, place) for t in self.tests) + ")"

    def parts(self):
        return self.tests

    def possible(self, tags):
        return all(t.possible(tags) for t in self.tests)


@dataclass(frozen=True)
class Either(Test):
    tests: tuple
    name: str = ""

    def __call__(self, cohort, reading, place):
        return any(t(cohort, reading, place) for t in self.tests)

    def sql(self, cohort, reading, place):
        tags = [t.value for t in self.tests if isinstance(t, Tag)]
        lemmas = [t.value for t in self.tests if isinstance(t, Lemma)]
        out = [f"arrays_overlap({reading}.tags, {array_of(tags)})"] * bool(tags)
        out += [f"({reading}.lemma IN ({', '.join(map(literal, lemmas))}))"] * bool(lemmas)
        out += [t.sql(cohort, reading, place) for t in self.tests if not isinstance(t, (Tag, Lemma))]
        return "(" + (" OR ".join(out) or "false") + ")"

    def parts(self):
        return self.tests

    def possible(self, tags):
        return any(t.possible(tags) for t in self.tests)


@dataclass(frozen=True)
class Without(Test):
    wanted: Test
    unwanted: Test

    def __call__(self, cohort, reading, place):
        return self.wanted(cohort, reading, place) and not self.unwanted(cohort, reading, place)

    def sql(self, cohort, reading, place):
        return f"({self.wanted.sql(cohort, reading, place)} AND NOT {self.unwanted.sql(cohort, reading, place)})"

    def parts(self):
        return (self.wanted, self.unwanted)

    def possible(self, tags):
        return self.wanted.possible(tags)


def tag(text: str) -> Test:
    """The test that one tag of a grammar stands for."""
    if m := re.fullmatch(r'"<(.*)>"[ri]*', text):
        return Form(m[1])
    if m := re.fullmatch(r'"(.*)"([ri]*)', text):
        return LemmaPattern(m[1]) if "r" in m[2] else Lemma(m[1])
    return {">>>": First(), "*": Anything()}.get(text) or Tag(text)


def both(tests: list) -> Test:
    return tests[0] if len(tests) == 1 else Both(tuple(tests))


def either(tests: list, name: str = "") -> Test:
    """A named set is a test of its own, however few tags it has."""
    return tests[0] if len(tests) == 1 and not name else Either(tuple(tests), name)
