"""Ordered context rules over sentences: disambiguation, attachment, relations and error tags.

A grammar is text of the user (Constraint Grammar notation). It is parsed once and becomes an expression over the cohorts of a
sentence (``rule_columns``), so running rules shuffles nothing and needs no Python; an interpreter of the same rules, one sentence at
a time inside Arrow batches, is kept beside it. Constructs: DELIMITERS, LIST, SET (OR, +, -, tag lists, (*)), INCLUDE (given
texts), BEFORE-SECTIONS, SECTION, SELECT, REMOVE, ADD, MAP, SETPARENT, SETCHILD, ADDRELATION with names, flags and contexts
(offsets, scans with BARRIER, careful C, NOT, NEGATE, LINK, p c s, alternatives).
"""

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import matching, rule_columns
from .matching import Test
from .rule_columns import UNSETTLED

COHORTS = "array<struct<form:string,readings:array<struct<lemma:string,tags:array<string>>>,parent:int,agr_parent:int,relations:array<struct<label:string,target:int>>,rules:array<string>,errors:array<string>>>"
_LEXEMES = re.compile(r'"(?:[^"\\]|\\.)*"[ri]*|[();]|[^\s();]+')
_POSITION = re.compile(r"(-?\d+|[pcs])(\*{0,2})(C?)$")
COLUMN_RULES = 60
_ACTIONS = ("SELECT", "REMOVE", "ADD", "MAP", "SETPARENT", "SETCHILD", "ADDRELATION")


@dataclass
class Reading:
    lemma: str
    tags: list
    locked: bool = False


@dataclass
class Cohort:
    form: str
    readings: list
    parent: int | None = None
    agr_parent: int | None = None
    relations: list = field(default_factory=list)
    rules: list = field(default_factory=list)


@dataclass
class Context:
    where: str
    star: bool
    careful: bool
    target: Test
    inverted: bool = False
    negated: bool = False
    barrier: Test | None = None
    link: "Context | None" = None
    either: list = field(default_factory=list)


@dataclass
class Rule:
    action: str
    name: str
    target: Test
    contexts: list
    tags: list = field(default_factory=list)
    to: Context | None = None
    section: int = 0  # 0: before the sections
    label: str = ""  # its name, or its action and number


@dataclass
class Grammar:
    delimiters: frozenset
    before: list
    sections: list
    prefix: str = "@"
    sets: dict = field(default_factory=dict)


class _Parser:
    def __init__(self, text: str, includes: dict[str, str]):
        self.items, self.at, self.includes = self._lex(text), 0, includes
        self.sets: dict[str, Test] = {"*": matching.Anything()}
        self.grammar = Grammar(frozenset(), [], [])
        self.into: list = self.grammar.before
        self.count = 0

    @staticmethod
    def _lex(text: str) -> list[str]:
        out = []
        for line in text.splitlines():
            clean = re.sub(r'("(?:[^"\\]|\\.)*")|#.*', lambda m: m[1] or "", line)
            out += _LEXEMES.findall(clean)
        return out

    def peek(self) -> str:
        return self.items[self.at] if self.at < len(self.items) else ""

    def take(self, wanted: str | None = None) -> str:
        got = self.peek()
        if wanted and got != wanted:
            raise ValueError(f"{wanted} expected, found {got} after {' '.join(self.items[max(0, self.at - 8) : self.at])}")
        self.at += 1
        return got

    def tags(self) -> list[str]:
        """The tags in parentheses."""
        self.take("(")
        out = []
        while self.peek() != ")":
            out.append(self.take())
        self.take(")")
        return out

    def conjunction(self, tags: list[str]) -> Test:
        return matching.both([matching.tag(t) for t in tags])

    def operand(self) -> Test:
        if self.peek() == "(":
            return self.conjunction(self.tags())
        name = self.take()
        if name not in self.sets:
            raise ValueError(f"no set {name}")
        return self.sets[name]

    def term(self) -> Test:
        out = self.operand()
        while self.peek() in ("+", "-"):
            sign, left, right = self.take(), out, self.operand()
            out = matching.both([left, right]) if sign == "+" else matching.Without(left, right)
        return out

    def set_expression(self) -> Test:
        parts = [self.term()]
        while self.peek() in ("OR", "|"):
            self.take()
            parts.append(self.term())
        return matching.either(parts)

    def chain(self) -> Context:
        flags = set()
        while self.peek() in ("NOT", "NEGATE"):
            flags.add(self.take())
        m = _POSITION.match(self.take())
        if not m:
            raise ValueError(f"no position: {self.items[self.at - 1]}")
        out = Context(m[1], bool(m[2]), bool(m[3]), self.set_expression(), "NOT" in flags, "NEGATE" in flags)
        if self.peek() == "BARRIER":
            self.take()
            out.barrier = self.set_expression()
        if self.peek() == "LINK":
            self.take()
            out.link = self.chain()
        return out

    def context(self) -> Context:
        self.take("(")
        if self.peek() == "(":
            either = [self.context()]
            while self.peek() == "OR":
                self.take()
                either.append(self.context())
            self.take(")")
            return Context("0", False, False, self.sets["*"], either=either)
        out = self.chain()
        self.take(")")
        return out

    def rule(self, head: str) -> None:
        action, _, name = head.partition(":")
        tags = self.tags() if action in ("ADD", "MAP", "ADDRELATION") else []
        while self.peek() in ("SAFE", "UNSAFE", "NEAREST", "ALLOWLOOP"):
            self.take()
        rule = Rule(action, name, self.set_expression(), [], tags)
        while self.peek() != ";":
            word = self.peek()
            if word in ("IF", "TO"):
                self.take()
            if word == "TO":
                rule.to = self.context()
            else:
                rule.contexts.append(self.context())
        self.take(";")
        self.count += 1
        rule.section, rule.label = len(self.grammar.sections) if self.into is not self.grammar.before else 0, name or f"{action}:{self.count}"
        self.into.append(rule)

    def parse(self) -> Grammar:
        g = self.grammar
        while self.at < len(self.items):
            word = self.take()
            if word == "DELIMITERS":
                self.take("=")
                found = []
                while self.peek() != ";":
                    found.append(self.take().strip('"').strip("<>"))
                g.delimiters = frozenset(found)
            elif word == "MAPPING-PREFIX":
                self.take("=")
                g.prefix = self.take()
            elif word == "LIST":
                name, parts = self.take(), []
                self.take("=")
                while self.peek() != ";":
                    parts.append(self.conjunction(self.tags()) if self.peek() == "(" else matching.tag(self.take()))
                self.sets[name] = matching.either(parts, name)
            elif word == "SET":
                name = self.take()
                self.take("=")
                self.sets[name] = self.set_expression()
            elif word == "INCLUDE":
                name = self.take()
                self.items[self.at + 1 : self.at + 1] = self._lex(self.includes[name])
            elif word == "BEFORE-SECTIONS":
                self.into = g.before
                continue
            elif word == "SECTION":
                g.sections.append([])
                self.into = g.sections[-1]
                if self.peek().partition(":")[0] not in (*_ACTIONS, "LIST", "SET", "SECTION", ";", ""):
                    self.take()  # the section's name
                if self.peek() == ";":
                    self.take()
                continue
            elif word.partition(":")[0] in _ACTIONS:
                self.rule(word)
                continue
            else:
                raise ValueError(f"no statement: {word} after {' '.join(self.items[max(0, self.at - 12) : self.at])}")
            self.take(";")
        g.sets = self.sets
        return g


def sections_before(text: str, name: str = "dep-tree") -> int | None:
    """How many sections a grammar has before the one of that name; None without it."""
    found = [m[1] for m in re.finditer(r"^[ \t]*SECTION(?:[ \t]+(\S+?)[ \t]*;?)?[ \t]*(?:#.*)?$", text, re.M)]
    return found.index(name) if name in found else None


def parse_grammar(text: str, includes: dict[str, str] | None = None) -> Grammar:
    return _Parser(text, includes or {}).parse()


class _Window:
    """Cohorts up to a delimiter, with what rules may ask and do."""

    def __init__(self, cohorts: list[Cohort], prefix: str):
        self.cohorts, self.prefix = cohorts, prefix
        self.passes, self.removed = 0, []

    def state(self) -> int:
        """What rules may change, as one number."""
        return hash(tuple((c.parent, tuple(c.relations), tuple((r.lemma, tuple(r.tags), r.locked) for r in c.readings)) for c in self.cohorts))

    def fits(self, i: int, test: Test, careful: bool) -> bool:
        c = self.cohorts[i]
        return bool(c.readings) and (all if careful else any)(test(c, r, i) for r in c.readings)

    def places(self, where: str, i: int) -> list[int]:
        c = self.cohorts[i]
        if where == "p":
            return [] if c.parent is None else [c.parent]
        if where == "c":
            return [k for k, x in enumerate(self.cohorts) if x.parent == i]
        if where == "s":
            return [k for k, x in enumerate(self.cohorts) if k != i and c.parent is not None and x.parent == c.parent]
        return [i + int(where)] if 0 <= i + int(where) < len(self.cohorts) else []

    def find(self, ctx: Context, i: int) -> int | None:
        """The place where a context ends, or None. Negation gives the place that was asked about."""
        if ctx.either:
            return next((k for e in ctx.either if (k := self.find(e, i)) is not None), None)
        if ctx.negated:
            plain = Context(ctx.where, ctx.star, ctx.careful, ctx.target, ctx.inverted, False, ctx.barrier, ctx.link)
            return i if self.find(plain, i) is None else None
        found = self._match(ctx, i)
        if ctx.inverted:
            found = [] if found else [i]
        for k in found:
            if ctx.link is None:
                return k
            if (end := self.find(ctx.link, k)) is not None:
                return end
        return None

    def _match(self, ctx: Context, i: int) -> list[int]:
        if not ctx.star:
            return [k for k in self.places(ctx.where, i) if self.fits(k, ctx.target, ctx.careful)]
        if ctx.where in "pcs":
            seen, reach = [], self.places(ctx.where, i)
            while reach:
                hits = [k for k in reach if self.fits(k, ctx.target, ctx.careful)]
                if hits:
                    return hits
                seen += reach
                reach = [k for r in reach for k in self.places(ctx.where, r) if k not in seen]
            return []
        step = -1 if ctx.where.startswith("-") else 1
        k = i + int(ctx.where)
        while 0 <= k < len(self.cohorts):
            if self.fits(k, ctx.target, ctx.careful):
                return [k]
            if ctx.barrier and self.fits(k, ctx.barrier, False):
                return []
            k += step
        return []

    def attach(self, child: int, parent: int) -> bool:
        if child == parent or self.cohorts[child].parent == parent:
            return False
        up = parent
        while up is not None:  # no loops
            if up == child:
                return False
            up = self.cohorts[up].parent
        self.cohorts[child].parent = parent
        return True

    def apply(self, rule: Rule, i: int) -> bool:
        c = self.cohorts[i]
        hits = [r for r in c.readings if rule.target(c, r, i)]
        if not hits or any(self.find(x, i) is None for x in rule.contexts):
            return False
        if rule.action in ("SELECT", "REMOVE"):
            kept = hits if rule.action == "SELECT" else [r for r in c.readings if r not in hits]
            if not kept or len(kept) == len(c.readings):
                return False
            self.removed += [(i, rule.section, self.passes, rule.label, r.lemma, list(r.tags)) for r in c.readings if r not in kept]
            c.readings = kept
            return True
        if rule.action in ("ADD", "MAP"):
            changed = False
            for r in hits:
                mapping = rule.action == "MAP" or any(t.startswith(self.prefix) for t in rule.tags)
                new = [t for t in rule.tags if t not in r.tags]
                if new and not (mapping and r.locked):
                    r.tags = r.tags + new
                    r.locked |= rule.action == "MAP"
                    changed = True
            return changed
        k = self.find(rule.to, i)
        if k is None:
            return False
        if rule.action == "SETPARENT":
            return self.attach(i, k)
        if rule.action == "SETCHILD":
            return self.attach(k, i)
        pair = (rule.tags[0], k)
        if pair in c.relations:
            return False
        c.relations.append(pair)
        return True

    def once(self, sections: list[list[Rule]]) -> bool:
        """A pass over sections."""
        self.passes += 1
        return any([self.run(s) for s in sections])

    def run(self, rules: list[Rule]) -> bool:
        changed = False
        for rule in rules:
            for i in range(len(self.cohorts)):
                if self.apply(rule, i):
                    changed = True
                    if rule.name and rule.name not in self.cohorts[i].rules:
                        self.cohorts[i].rules.append(rule.name)
        return changed


def windows(cohorts: list[Cohort], delimiters: frozenset) -> list[list[Cohort]]:
    out: list[list[Cohort]] = [[]]
    for c in cohorts:
        out[-1].append(c)
        if c.form in delimiters:
            out.append([])
    return [w for w in out if w]


def run_grammar(grammar: Grammar, cohorts: list[Cohort], snapshot: int | None = None) -> list[tuple]:
    """Apply a grammar to a sentence in place: before-sections once, then sections 1, 1 to 2, and so on, each until nothing
    changes. Rules that undo each other would never end: when a state of the window comes back, its cohorts get the rule name
    ``UNSETTLED`` and the next section is up. After ``snapshot`` sections the parents are kept as agr_parent. Parents and relations are places in the sentence.
    Returns the removed readings: place, section, pass, rule, lemma, tags."""
    start, removed = 0, []
    for cohort_list in windows(cohorts, grammar.delimiters):
        base, start = start, start + len(cohort_list)
        for c in cohort_list:  # places within the window while rules run
            c.parent = None if c.parent is None else c.parent - base
            c.relations = [(label, t - base) for label, t in c.relations]
        w = _Window(cohort_list, grammar.prefix)
        w.run(grammar.before)
        for n in range(1, len(grammar.sections) + 1):
            seen = {w.state()}
            while w.once(grammar.sections[:n]):
                if (now := w.state()) in seen:  # rules that undo each other: the state comes back
                    for c in cohort_list:
                        c.rules += [UNSETTLED] if UNSETTLED not in c.rules else []
                    break
                seen.add(now)
            if n == snapshot:
                for c in cohort_list:
                    c.agr_parent = None if c.parent is None else c.parent + base
        for c in cohort_list:
            c.parent = None if c.parent is None else c.parent + base
            c.relations = [(label, t + base) for label, t in c.relations]
        removed += [(place + base, *event) for place, *event in w.removed]
    return removed


def _is_hidden(tag: str) -> bool:
    return tag[:1] in ("@", "&", "§")


def _shown(cohorts: list[Cohort]) -> list[dict]:
    out = []
    for c in cohorts:
        errors = list(dict.fromkeys(t for r in c.readings for t in r.tags if t.startswith("&")))
        readings = [{"lemma": r.lemma, "tags": [t for t in r.tags if not _is_hidden(t)]} for r in c.readings]
        out.append({"form": c.form, "readings": readings, "parent": c.parent, "agr_parent": c.agr_parent, "relations": [{"label": x, "target": t} for x, t in c.relations], "rules": c.rules, "errors": errors})
    return out


def analysed(sentences: DataFrame, grammars: list[str], includes: dict[str, str] | None = None, snapshot: int | None = None, interpret: bool | None = None) -> DataFrame:
    """The sentences (with cohorts: form and readings) after the grammars, in order, with ``trace``: the removed readings in the order
    of removal (pos, grammar, section, pass, rule, lemma, tags). Other columns stay.

    ``grammars`` are their texts; ``snapshot`` counts the first grammar's sections after which agr_parent is taken. ``interpret`` runs
    the rules in Python instead of as columns, with the same results; unless it is given, grammars of more than ``COLUMN_RULES`` rules
    are, as the planner's time grows with the expression (about a quarter of a second a rule here).
    """
    parsed = [parse_grammar(g, includes) for g in grammars]
    if interpret is None:
        interpret = sum(len(s) for g in parsed for s in [g.before, *g.sections]) > COLUMN_RULES
    if not interpret:
        return rule_columns.applied(sentences, parsed, snapshot)
    kept = [c for c in sentences.columns if c not in ("cohorts", "trace")]

    def run(batches):
        parsed = [parse_grammar(g, includes) for g in grammars]
        for b in batches:
            results, traces = [], []
            for cohorts in b["cohorts"]:
                own = [Cohort(c["form"], [Reading(r["lemma"], list(r["tags"])) for r in c["readings"]]) for c in cohorts]
                trace = []
                for k, g in enumerate(parsed):
                    for c in own:
                        for r in c.readings:
                            r.locked = False
                    trace += [{"pos": i, "grammar": k, "section": s, "pass": n, "rule": x, "lemma": y, "tags": t} for i, s, n, x, y, t in run_grammar(g, own, snapshot if k == 0 else None)]
                results.append(_shown(own))
                traces.append(trace)
            out = b[kept].copy()
            out["cohorts"], out["trace"] = results, traces
            yield out

    schema = sentences.select(*kept).schema.simpleString()[7:-1]
    return sentences.select(*kept, "cohorts").mapInPandas(run, (schema + "," if kept else "") + f"cohorts:{COHORTS},trace:array<{rule_columns.EVENT}>")


def removals(done: DataFrame) -> DataFrame:
    """The trace as rows: the columns of the sentence but its cohorts, then place, form, grammar, section, pass, rule, and the reading."""
    own = [c for c in done.columns if c not in ("cohorts", "trace", "text", "tokens")]
    # Not a plain column: the planner would ask for its size first, and run the rules again for that.
    events = F.transform("trace", lambda t: F.struct(t.alias("t"), F.get("cohorts", t["pos"])["form"].alias("form")))
    rows = done.select(*own, F.explode(events).alias("e")).select(*own, "e.t", "e.form")
    return rows.select(*own, F.col("t.pos").alias("pos"), "form", "t.grammar", "t.section", "t.pass", "t.rule", F.concat_ws("+", "t.lemma", "t.tags").alias("reading"))


def cohorts_of(sentences: DataFrame, readings: DataFrame) -> DataFrame:
    """The sentences (sent_id, text, tokens, ...) with cohorts in place of tokens: each token with its readings, CLB, PUNCT or Unk.

    readings: token, readings. A sentence's readings depend on its words alone, so they are looked up once for each set of words, and
    come back by a hash of it; neither repeated nor missing keys of sentences matter, and texts stay where they are until then.
    """
    from .statistics import with_final_delimiter

    words = F.array_sort(F.array_distinct(F.filter("tokens", lambda t: t.rlike(r"^\p{L}"))))
    others = [c for c in sentences.columns if c != "tokens"]
    base = sentences.select(*others, with_final_delimiter(F.col("tokens")).alias("_tokens"), F.sha2(F.array_join(words, " "), 256).alias("_set"))
    sets = sentences.select(words.alias("words")).where(F.size("words") > 0).distinct().select(F.sha2(F.array_join("words", " "), 256).alias("_set"), F.explode("words").alias("token"))
    known = readings.where(F.size("readings") > 0)
    own = sets.join(known, "token").groupBy("_set").agg(F.map_from_entries(F.collect_set(F.struct("token", "readings"))).alias("_own"))
    one = lambda t, tag: F.array(F.struct(t.alias("lemma"), F.array(F.lit(tag)).alias("tags")))

    def cohort(t):
        found = F.when(t.isin(".", "!", "?"), one(t, "CLB")).when(~t.rlike(r"^\p{L}"), one(t, "PUNCT")).otherwise(F.coalesce(F.col("_own")[t], one(t, "Unk")))
        return F.struct(t.alias("form"), found.alias("readings"))

    return base.join(own, "_set", "left").select(*others, F.transform("_tokens", cohort).alias("cohorts"))


def to_stream(cohorts: list[dict]) -> str:
    """The cohorts in the usual text notation."""
    lines = []
    for i, c in enumerate(cohorts, 1):
        lines.append(f'"<{c["form"]}>"')
        parent = "" if c.get("parent") is None else f" #{i}->{c['parent'] + 1}"
        lines += [f'\t"{r["lemma"]}" ' + " ".join(r["tags"]) + parent for r in c["readings"]]
    return "\n".join(lines) + "\n"


def streamed(sentences: DataFrame) -> DataFrame:
    """sent_id, stream: the cohorts of each sentence in the usual text notation."""

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"sent_id": b["sent_id"], "stream": [to_stream([{**c, "parent": None if pd.isna(c.get("parent")) else int(c["parent"])} for c in cs]) for cs in b["cohorts"]]})

    return sentences.select("sent_id", "cohorts").mapInPandas(run, f"sent_id {sentences.schema['sent_id'].dataType.simpleString()}, stream string")


def from_stream(stream: str) -> list[dict]:
    """Cohorts of a text in that notation; removed readings (``;``) only give their rule names."""
    out: list[dict] = []
    ids: dict[int, int] = {}
    for line in stream.splitlines():
        if m := re.match(r'"<(.*)>"', line):
            out.append({"form": m[1], "readings": [], "parent": None, "relations": [], "rules": [], "errors": []})
            continue
        if not out or not (m := re.match(r'(;?)\s+"((?:[^"\\]|\\.)*)"\s*(.*)', line)):
            continue
        c, tags = out[-1], []
        for t in m[3].split():
            if d := re.fullmatch(r"#(\d+)->(\d+)", t):
                own, parent = int(d[1]), int(d[2])
                c["parent"] = None if parent in (0, own) else len(out) - 1 - (own - parent)
            elif d := re.fullmatch(r"ID:(\d+)", t):
                ids[int(d[1])] = len(out) - 1
            elif d := re.fullmatch(r"R:(.+):(\d+)", t):
                c["relations"].append((d[1], int(d[2])))
            elif d := re.fullmatch(r"(?:SELECT|REMOVE|ADD|MAP|SETPARENT|SETCHILD|ADDRELATION):(?:\d+:)?(\D.*)", t):
                c["rules"].append(d[1]) if d[1] not in c["rules"] else None
            elif t.startswith("&"):
                c["errors"].append(t) if t not in c["errors"] else None
            elif not _is_hidden(t) and not re.match(r"(?:SELECT|REMOVE|ADD|MAP|SETPARENT|SETCHILD|ADDRELATION):", t):
                tags.append(t)
        if not m[1]:
            c["readings"].append({"lemma": m[2], "tags": tags})
    for c in out:
        c["relations"] = [{"label": x, "target": ids.get(t)} for x, t in c["relations"]]
    return out


def frame_of(cohorts: list[list[dict]], spark) -> DataFrame:
    """sent_id, text, cohorts of cohorts given on the driver."""
    rows = [(str(i), " ".join(c["form"] for c in s), [(c["form"], [(r["lemma"], r["tags"]) for r in c["readings"]]) for c in s]) for i, s in enumerate(cohorts)]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["sent_id", "text", "cohorts"]).to_dict("records"), "sent_id string, text string, cohorts array<struct<form:string,readings:array<struct<lemma:string,tags:array<string>>>>>")
