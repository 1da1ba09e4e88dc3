"""The analysis table: one row for each pair of an analysis and a surface.

The table comes from lexicon files of the user (``read_lexc``), from a baked lexicon (``operators.baking``), or, by default, from
the closed-class rows below.
"""

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Closed-class analyses, as analysis:surface.
CLOSED = """
as+Pron+P1+Sg+Nom:as
as+Pron+P1+Sg+Gen:māise
as+Pron+P1+Sg+Dat:mennei
as+Pron+P1+Sg+Acc:men
mes+Pron+P1+Pl+Nom:mes
mes+Pron+P1+Pl+Gen:nūse
mes+Pron+P1+Pl+Dat:nūmans
mes+Pron+P1+Pl+Acc:mans
tū+Pron+P2+Sg+Nom:tū
tū+Pron+P2+Sg+Gen:twāise
tū+Pron+P2+Sg+Dat:tebbei
tū+Pron+P2+Sg+Acc:ten
jūs+Pron+P2+Pl+Nom:jūs
jūs+Pron+P2+Pl+Gen:jūse
jūs+Pron+P2+Pl+Dat:jūmans
jūs+Pron+P2+Pl+Acc:wans
tāns+Pron+P3+Sg+Nom+Msc:tāns
tāns+Pron+P3+Sg+Gen+Msc:tenesse
tāns+Pron+P3+Sg+Dat+Msc:tenesmu
tāns+Pron+P3+Sg+Acc+Msc:tennan
tenā+Pron+P3+Sg+Nom+Fem:tenā
tenā+Pron+P3+Sg+Gen+Fem:tenesses
tenā+Pron+P3+Sg+Dat+Fem:tenessei
tenā+Pron+P3+Sg+Acc+Fem:tennan
tāns+Pron+P3+Pl+Nom+Msc:tenēi
tāns+Pron+P3+Pl+Gen+Msc:tenēisan
tāns+Pron+P3+Pl+Dat+Msc:tenēimans
tāns+Pron+P3+Pl+Acc+Msc:tennans
tenā+Pron+P3+Pl+Nom+Fem:tennas
tenā+Pron+P3+Pl+Gen+Fem:tenēisan
tenā+Pron+P3+Pl+Dat+Fem:tenēimans
tenā+Pron+P3+Pl+Acc+Fem:tennans
ne+Pcle:ne
te+Pcle:te
uka+Pcle:uka
ei+CC:ei
stā+CC:stā
ka+CS:ka
nikaddan+Adv:nikaddan
stā+Pron+Sg+Nom+Fem:stā
sin+Pron+Refl+Acc:sin
sebbei+Pron+Refl+Dat:sebbei
as+Pron+P1+Encl+Sg+Dat:mi
as+Pron+P1+Encl+Sg+Acc:mi
tū+Pron+P2+Encl+Sg+Dat:ti
tū+Pron+P2+Encl+Sg+Acc:ti
būtwei+V+Rel+Prs+SP3:astits
dessimt+Num:dessimt
dwiddesimt+Num:dwiddesimt
trīsdesimt+Num:trīsdesimt
"""

# Short prepositions and the forms they stand for.
SHORT_PREPOSITIONS = {"en": "ēn", "per": "pēr", "prei": "prēi", "sen": "sēn", "no": "nō", "er": "ēr", "kwei": "kwēi"}


def closed_rows() -> list[tuple[str, str]]:
    return [tuple(x.split(":")) for x in CLOSED.split()]


def analysis_table(spark: SparkSession, rows: list[tuple[str, str]] | None = None) -> DataFrame:
    """surface, analysis, lemma, tags from pairs of analysis and surface; an analysis without tags is left out."""
    df = spark.createDataFrame(rows if rows is not None else closed_rows(), "analysis string, surface string")
    return from_pairs(df)


def from_pairs(df: DataFrame) -> DataFrame:
    parts = F.split("analysis", r"\+")
    return df.select("surface", "analysis", parts[0].alias("lemma"), F.slice(parts, 2, 64).alias("tags")).where(F.size("tags") > 0).distinct()


def values_sql(rows: list[tuple[str, str]] | None = None) -> str:
    """The same table as a SQL expression."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    pairs = ", ".join(f"({quoted(a)}, {quoted(s)})" for a, s in (rows or closed_rows()))
    return f"SELECT DISTINCT surface, analysis, string_split(analysis, '+')[1] AS lemma, string_split(analysis, '+')[2:] AS tags FROM (VALUES {pairs}) v(analysis, surface)"


# Lexicon source files


def parse_lexc(text: str) -> dict[str, list[tuple[str, str, str]]]:
    """Continuation lexicons: name → (upper side, lower side, next lexicon). ``%`` escapes, ``!`` starts a comment."""
    out: dict[str, list[tuple[str, str, str]]] = {}
    now: list | None = None
    for line in text.splitlines():
        clean, i = [], 0
        while i < len(line) and line[i] != "!":
            if line[i] == "%" and i + 1 < len(line):
                clean.append((line[i + 1], True))
                i += 1
            else:
                clean.append((line[i], False))
            i += 1
        plain = "".join(c for c, _ in clean).strip()
        if plain.startswith("LEXICON "):
            now = out.setdefault(plain.split()[1], [])
            continue
        if now is None or not plain:
            continue
        entry: list[list[tuple[str, bool]]] = [[]]
        for c, literal in clean:
            if c == ";" and not literal:
                break
            if c.isspace() and not literal:
                entry.append([]) if entry[-1] else None
            else:
                entry[-1].append((c, literal))
        fields = [f for f in entry if f]
        if not fields:
            continue
        target = "".join(c for c, _ in fields[-1])
        sides = fields[0] if len(fields) > 1 else []
        cut = next((k for k, (c, literal) in enumerate(sides) if c == ":" and not literal), None)
        value = lambda part: "".join(c for c, literal in part if literal or c != "0")
        now.append((value(sides), value(sides), target) if cut is None else (value(sides[:cut]), value(sides[cut + 1 :]), target))
    return out


def expand_lexc(lexicons: dict[str, list[tuple[str, str, str]]], start: str, most_depth: int = 64) -> list[tuple[str, str]]:
    """All (analysis, surface) pairs below a lexicon, in order; a cycle raises."""

    def walk(name: str, depth: int):
        if name == "#":
            yield "", ""
            return
        if depth > most_depth:
            raise ValueError(f"lexicon {name} continues without end")
        for upper, lower, target in lexicons[name]:
            for a, s in walk(target, depth + 1):
                yield upper + a, lower + s

    return list(walk(start, 0))


def escaped(text) -> Column:
    """A string as lexicon sources write it."""
    return F.regexp_replace(text, "([%! ;:0#<>])", "%$1")


def write_lexc(table: DataFrame, path: str, name: str = "Root") -> None:
    """The analysis table as a lexicon source: one line an analysis, which ``read_lexc`` reads back."""
    lines = table.select(F.concat(F.lit("  "), escaped("analysis"), F.lit(":"), escaped("surface"), F.lit(" # ;")).alias("value")).distinct()
    head = table.sparkSession.createDataFrame([(0, f"LEXICON {name}")], "k int, value string")
    head.union(lines.select(F.lit(1), "value")).orderBy("k", "value").coalesce(1).select("value").write.text(path)  # a lexicon: one file


def named_list(text: str, name: str) -> list[str]:
    """The quoted members of one LIST of a grammar, for example of the verbs that govern the genitive; empty if it isn't there."""
    found = re.search(rf"\bLIST\s+{re.escape(name)}\s*=([^;]*);", text)
    return sorted(set(re.findall(r'"([^"]+)"', found[1]))) if found else []


def read_lexc(spark: SparkSession, path: str, start: str) -> DataFrame:
    """The analysis table below one lexicon of the files at ``path``."""
    lexicons: dict = {}
    for r in spark.read.text(path, wholetext=True).toLocalIterator():  # a grammar: some hundred lines
        lexicons |= parse_lexc(r[0])
    return from_pairs(spark.createDataFrame(expand_lexc(lexicons, start), "analysis string, surface string"))
