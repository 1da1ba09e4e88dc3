"""Rules as columns: a parsed grammar becomes one SQL expression over the cohorts of a sentence, so no Python runs on its rows.

Order is that of the interpreter: rules one after the other, each from the first cohort of a window to the last, so a rule sees what
it has done to its left; sections 1, 1 to 2, and so on, each until a pass changes nothing or a state comes back. A pass is a fold
over the rules, by blocks. Whether a rule fits any place is asked first, which copies nothing; only then a fold goes over the places,
so a rule and a place meet at most twice a pass. Rules whose effect on one place can't matter at another (relations, tags that no
context of theirs asks for) change all places at once. Passes, too, are a fold that hands its state on once done. Folds copy their
state at each step, so those of passes come in lengths of 1, 4, 16 and so on, begun only while there is more to do.
The expression's depth doesn't grow with the grammar, its size does in proportion.

Fixed offsets are look-ups in the array, scans filters over a range of places, parents, children and siblings filters over the parents
of the window; attaching walks up from the new parent and refuses a cohort that it meets. Where neither a state comes back nor a pass
leaves all as it was, passes end after the sum of ``LENGTHS``, and the window's cohorts are marked as unsettled ones are.
"""

import contextlib
import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .matching import Anything, Tag, Test, array_of, literal

LENGTHS = (1, 4, 16, 64, 256, 1024)
RULES = 8  # a block
READING = "struct<lemma:string,tags:array<string>,locked:boolean>"
COHORT = f"struct<form:string,readings:array<{READING}>,parent:int,agr_parent:int,relations:array<struct<label:string,target:int>>,rules:array<string>>"
EVENT = "struct<pos:int,grammar:int,section:int,pass:int,rule:string,lemma:string,tags:array<string>>"
UNSETTLED = "(unsettled)"
_names = itertools.count()


def _new(letter: str) -> str:
    return f"{letter}{next(_names)}"


def _range(first: str, last: str) -> str:
    """The whole numbers from first to last, none if last is less."""
    return f"if({last} >= {first}, sequence({first}, {last}), cast(array() AS array<int>))"


def _let(value: str, name: str, body: str) -> str:
    """``body``, in which ``name`` is ``value``, worked out once (and, other than by a transform, not copied)."""
    a, n = _new("a"), _new("n")
    return f"aggregate(cast(array() AS array<int>), {value}, ({a}, {n}) -> {a}, {name} -> {body})"


def _until(done: str, state: str, lengths: list, name: str, step: str) -> str:
    """A fold of ``step`` over ``name`` from ``state`` until its field ``done`` holds, of so many steps at most."""
    m, j, n = _new("m"), _new("j"), _new("n")
    inner = f"aggregate(sequence(1, get(array({', '.join(map(str, lengths))}), {j})), {m}, ({name}, {n}) -> if({name}.{done}, {name}, {step}))"
    return f"aggregate(sequence(0, {len(lengths) - 1}), {state}, ({m}, {j}) -> if({m}.{done}, {m}, {inner}))"


class _Window:
    """SQL over the name of a window's cohort array."""

    def __init__(self, cohorts: str):
        self.c = cohorts

    def at(self, place: str) -> str:
        return f"get({self.c}, {place})"

    def fits(self, place: str, test: Test, careful: bool) -> str:
        cohort, r = self.at(place), _new("r")
        if isinstance(test, Anything):
            return f"(size({cohort}.readings) > 0)"
        asked = f"{'forall' if careful else 'exists'}({cohort}.readings, {r} -> {test.sql(cohort, r, place)})"
        return f"(size({cohort}.readings) > 0 AND {asked})"

    def where(self, parent_is: str, other: str = "true") -> str:
        """The places whose parent fits a condition on the name it is given."""
        k = _new("k")
        return f"filter(sequence(0, size({self.c}) - 1), {k} -> ({self.at(k)}.parent {parent_is}) AND {other.format(k=k)})"

    def places(self, where: str, i: str) -> str:
        if where == "p":
            return f"filter(array({self.at(i)}.parent), {(k := _new('k'))} -> {k} IS NOT NULL)"
        if where == "c":
            return self.where(f"= {i}")
        if where == "s":
            return self.where(f"= {self.at(i)}.parent", f"{{k}} <> {i}")
        return f"array({i} + {int(where)})"

    def match(self, ctx, i: str) -> str:
        """An array of the places that a context's first step finds."""
        if not ctx.star:
            k = _new("k")
            return f"filter({self.places(ctx.where, i)}, {k} -> coalesce({self.fits(k, ctx.target, ctx.careful)}, false))"
        if ctx.where in "pcs":
            return self.reach(ctx, i)
        back = ctx.where.startswith("-")
        start, k, b, h = f"({i} + {int(ctx.where)})", _new("k"), _new("k"), _new("h")
        way = f"reverse({_range('0', start)})" if back else _range(start, f"size({self.c}) - 1")
        hits = f"slice(filter({way}, {k} -> {self.fits(k, ctx.target, ctx.careful)}), 1, 1)"
        if not ctx.barrier:
            return hits
        stop = f"get(filter({way}, {b} -> {self.fits(b, ctx.barrier, False)}), 0)"
        return f"filter({hits}, {h} -> {stop} IS NULL OR {h} {'>=' if back else '<='} {stop})"

    def reach(self, ctx, i: str) -> str:
        """The nearest hits among parents, children or siblings of any degree: step by step, each place once."""
        a, n, r, k, f = (_new(x) for x in "anrkf")
        none = "cast(array() AS array<int>)"
        fit = f"filter({a}.reach, {r} -> coalesce({self.fits(r, ctx.target, ctx.careful)}, false))"
        on = f"array_distinct(flatten(transform({a}.reach, {k} -> {self.places(ctx.where, k)})))"
        z = _new("z")
        step = f"if(size({a}.hits) > 0 OR size({a}.reach) = 0, {a}, named_struct('hits', {fit}, 'reach', filter({on}, {z} -> NOT array_contains(concat({a}.seen, {a}.reach), {z})), 'seen', concat({a}.seen, {a}.reach)))"
        first = f"named_struct('hits', {none}, 'reach', {self.places(ctx.where, i)}, 'seen', {none})"
        return f"aggregate(sequence(0, size({self.c})), {first}, ({a}, {n}) -> {step}, {f} -> {f}.hits)"

    def find(self, ctx, i: str) -> str:
        """The place where a context ends, or null."""
        if ctx.either:
            return f"coalesce({', '.join(self.find(e, i) for e in ctx.either)}, cast(null AS int))"
        found = self.match(ctx, i)
        if ctx.inverted:
            found = f"if(size({found}) > 0, cast(array() AS array<int>), array({i}))"
        if ctx.link is None:
            end = f"get({found}, 0)"
        else:
            k, e = _new("k"), _new("e")
            end = f"get(filter(transform({found}, {k} -> {self.find(ctx.link, k)}), {e} -> {e} IS NOT NULL), 0)"
        return f"if(({end}) IS NULL, {i}, cast(null AS int))" if ctx.negated else end

    def above(self, place: str, wanted: str) -> str:
        """Whether ``wanted`` is a place or one of those over it."""
        a, n, f = (_new(x) for x in "anf")
        step = f"if({a}.hit OR {a}.up IS NULL, {a}, named_struct('up', {self.at(f'{a}.up')}.parent, 'hit', {a}.up = {wanted}))"
        return f"aggregate(sequence(0, size({self.c})), named_struct('up', {place}, 'hit', false), ({a}, {n}) -> {step}, {f} -> {f}.hit)"


def _replaced(cohorts: str, place: str, x: str, j: str = "", **fields: str) -> str:
    """The cohorts with fields of one changed; ``x`` names that cohort in the new values. With ``j``, which names its place there,
    ``place`` is an array of places, and all of them change."""
    here = f"array_contains({place}, {j})" if j else ""
    j = j or _new("j")
    names = ("form", "readings", "parent", "agr_parent", "relations", "rules")
    new = ", ".join(f"'{n}', {fields.get(n, f'{x}.{n}')}" for n in names)
    return f"transform({cohorts}, ({x}, {j}) -> if({here or f'{j} = {place}'}, named_struct({new}), {x}))"


def _test(rule, cohorts: str, i: str, prefix: str) -> str:
    """Whether a rule changes anything at a place."""
    w, r = _Window(cohorts), _new("r")
    own, target = w.at(i), rule.target.sql(w.at(i), r, i)
    out = [f"exists({own}.readings, {r} -> {target})", *(f"({w.find(c, i)}) IS NOT NULL" for c in rule.contexts)]
    if rule.action == "SELECT":
        out.append(f"NOT forall({own}.readings, {r} -> {target})")
    elif rule.action == "REMOVE":
        out.append(f"exists({own}.readings, {r} -> NOT {target})")
    elif rule.action in ("ADD", "MAP"):
        out.append(f"exists({own}.readings, {r} -> {target} AND {_fresh(rule, r, prefix)})")
    else:
        k = _new("k")
        if rule.action == "ADDRELATION":
            new = f"NOT array_contains({own}.relations, named_struct('label', {literal(rule.tags[0])}, 'target', {k}))"
        else:
            child, parent = (i, k) if rule.action == "SETPARENT" else (k, i)
            new = f"{child} <> {parent} AND NOT ({w.at(child)}.parent <=> {parent}) AND NOT {w.above(parent, child)}"
        out.append(_let(w.find(rule.to, i), k, f"({k} IS NOT NULL AND {new})"))
    return " AND ".join(out)


def _fresh(rule, reading: str, prefix: str) -> str:
    """Whether a reading lacks one of the rule's tags and may get it."""
    mapping = rule.action == "MAP" or any(t.startswith(prefix) for t in rule.tags)
    return f"size(array_except({array_of(dict.fromkeys(rule.tags))}, {reading}.tags)) > 0" + (f" AND NOT {reading}.locked" if mapping else "")


def _change(rule, state: str, i: str, prefix: str, several: bool = False) -> str:
    """The state after a rule has changed a place at which its test holds, or ``several`` of them."""
    cohorts, x, q = f"{state}.c", _new("x"), _new("q")
    w = _Window(cohorts)
    at = _new("j") if several else ""
    inner = rule.target.sql(x, q, at or i)
    rules = f"if(array_contains({x}.rules, {literal(rule.name)}), {x}.rules, array_append({x}.rules, {literal(rule.name)}))" if rule.name else f"{x}.rules"
    events = f"{state}.events"
    if rule.action in ("SELECT", "REMOVE"):
        gone, kept = (f"NOT {inner}", inner) if rule.action == "SELECT" else (inner, f"NOT {inner}")
        new = _replaced(cohorts, i, x, readings=f"filter({x}.readings, {q} -> {kept})", rules=rules)
        g = _new("g")
        event = f"named_struct('pos', {i}, 'grammar', {state}.grammar, 'section', {rule.section}, 'pass', {state}.pass, 'rule', {literal(rule.label)}, 'lemma', {g}.lemma, 'tags', {g}.tags)"
        events = f"concat({events}, {_let(w.at(i), x, f'transform(filter({x}.readings, {q} -> {gone}), {g} -> {event})')})"
    elif rule.action in ("ADD", "MAP"):
        tags = array_of(dict.fromkeys(rule.tags))
        lock = "true" if rule.action == "MAP" else f"{q}.locked"
        added = f"named_struct('lemma', {q}.lemma, 'tags', concat({q}.tags, array_except({tags}, {q}.tags)), 'locked', {lock})"
        new = _replaced(cohorts, i, x, at, readings=f"transform({x}.readings, {q} -> if({inner} AND {_fresh(rule, q, prefix)}, {added}, {q}))", rules=rules)
    else:
        k, y = _new("k"), _new("y")
        relation = f"array_append({x}.relations, named_struct('label', {literal(rule.tags[0] if rule.tags else '')}, 'target', {k}))"
        if several:
            new = _replaced(cohorts, i, x, at, relations=_let(w.find(rule.to, at), k, relation), rules=rules)
        elif rule.action == "ADDRELATION":
            new = _replaced(cohorts, i, x, relations=relation, rules=rules)
        elif rule.action == "SETPARENT":
            new = _replaced(cohorts, i, x, parent=k, rules=rules)
        else:
            new = _replaced(_replaced(cohorts, k, y, parent=i), i, x, rules=rules)
        new = new if several else _let(w.find(rule.to, i), k, new)
    return f"named_struct('c', {new}, 'changed', true, 'grammar', {state}.grammar, 'pass', {state}.pass, 'events', {events})"


def _alone(rule) -> bool:
    """Whether what a rule does at one place can't change whether it fits another: nothing asks for relations, and added tags matter
    only to contexts that may ask for them."""
    if rule.action == "ADDRELATION":
        return True
    return rule.action in ("ADD", "MAP") and not any(_asks(c, rule.tags) for c in rule.contexts)


def _asks(ctx, tags: list) -> bool:
    """Whether a context looks for one of the tags."""
    tests = [t for t in (ctx.target, ctx.barrier) if t is not None]
    while tests:
        t = tests.pop()
        if isinstance(t, Tag) and t.value in tags:
            return True
        tests += t.parts()
    return any(_asks(c, tags) for c in [*ctx.either, *([ctx.link] if ctx.link else [])])


def _block(rules: list, first: int, upto: str, s: str, prefix: str) -> str:
    """The state after some rules, numbered from ``first``, of those below ``upto``."""
    own = list(enumerate(rules, first))
    last = f"(least({first + len(own)}, {upto}) - 1)"
    k, t = _new("k"), _new("t")
    steps = " ".join(f"WHEN {n} THEN {_applied(r, t, prefix)}" for n, r in own)
    return f"aggregate(sequence({first}, {last}), {s}, ({t}, {k}) -> CASE {k} {steps} ELSE {t} END)"


def _applied(rule, s: str, prefix: str) -> str:
    """The state after a rule has gone over all places."""
    i, j, a = _new("i"), _new("j"), _new("a")
    places = f"sequence(0, size({s}.c) - 1)"
    if _alone(rule):
        return _let(f"filter({places}, {i} -> {_test(rule, f'{s}.c', i, prefix)})", j, f"if(size({j}) = 0, {s}, {_change(rule, s, j, prefix, True)})")
    walk = f"aggregate({places}, {s}, ({a}, {j}) -> if({_test(rule, f'{a}.c', j, prefix)}, {_change(rule, a, j, prefix)}, {a}))"
    return f"if(exists({places}, {i} -> {_test(rule, f'{s}.c', i, prefix)}), {walk}, {s})"


def _pass(rules: list, upto: str, state: str, prefix: str) -> str:
    """The state after the first ``upto`` rules, in order."""
    if not rules:
        return state
    s, b = _new("s"), _new("b")
    blocks = " ".join(f"WHEN {n // RULES} THEN {_block(rules[n : n + RULES], n, upto, s, prefix)}" for n in range(0, len(rules), RULES))
    return f"aggregate(sequence(0, cast(({upto} - 1) div {RULES} AS int)), {state}, ({s}, {b}) -> CASE {b} {blocks} ELSE {s} END)"


def _with(state: str, **fields: str) -> str:
    return "named_struct(" + ", ".join(f"'{n}', {fields.get(n, f'{state}.{n}')}" for n in ("c", "changed", "grammar", "pass", "events")) + ")"


def window_sql(grammar, cohorts: str, number: int, snapshot: int | None = None) -> str:
    """The state (c, events among its fields) of one window after a grammar."""
    rules = [r for s in grammar.sections for r in s]
    ends = list(itertools.accumulate(len(s) for s in grammar.sections))
    first = f"named_struct('c', {cohorts}, 'changed', false, 'grammar', {number}, 'pass', 0, 'events', cast(array() AS array<{EVENT}>))"
    state = _pass(grammar.before, str(len(grammar.before)), first, grammar.prefix)
    if not ends:
        return state
    mark = lambda s: f"xxhash64(transform({s}.c, {(x := _new('x'))} -> struct({x}.parent, {x}.relations, {x}.readings)))"
    a, u, v, s, t, f, x, h, y = (_new(z) for z in "auvstfxhy")
    once = _pass(rules, u, _with(f"{a}.s", changed="false", **{"pass": f"{a}.s.pass + 1"}), grammar.prefix)
    # A pass gives the next state; one that comes back, or an unchanged one, is the last.
    now = _new("h")
    judged = f"named_struct('s', {t}, 'seen', array_append({a}.seen, {now}), 'done', NOT {t}.changed OR array_contains({a}.seen, {now}), 'unsettled', {t}.changed)"
    step = _let(once, t, _let(f"if({t}.changed, {mark(t)}, 0L)", now, judged))
    settle = f"if({y}.unsettled, {_with(f'{y}.s', c=f'transform({y}.s.c, {x} -> named_struct({_unsettled(x)}))')}, {y}.s)"
    begin = f"named_struct('s', {s}, 'seen', array({mark(s)}), 'done', false, 'unsettled', true)"
    passes = _let(_until("done", begin, list(LENGTHS), a, step), y, settle)
    if snapshot is not None:
        kept = f"transform({f}.c, {h} -> named_struct('form', {h}.form, 'readings', {h}.readings, 'parent', {h}.parent, 'agr_parent', {h}.parent, 'relations', {h}.relations, 'rules', {h}.rules))"
        passes = _let(passes, f, f"if({v} = {snapshot}, {_with(f, c=kept)}, {f})")
    upto = f"get(array({', '.join(map(str, ends))}), {v} - 1)"
    passes = _let(upto, u, passes) if rules else s
    return f"aggregate(sequence(1, {len(ends)}), {state}, ({s}, {v}) -> {passes})"


def _unsettled(x: str) -> str:
    mark = literal(UNSETTLED)
    return f"'form', {x}.form, 'readings', {x}.readings, 'parent', {x}.parent, 'agr_parent', {x}.agr_parent, 'relations', {x}.relations, 'rules', if(array_contains({x}.rules, {mark}), {x}.rules, array_append({x}.rules, {mark}))"


def _moved(cohorts: str, by: str, parents: tuple = ("parent",)) -> str:
    """Cohorts whose places are counted from elsewhere."""
    x, y = _new("x"), _new("y")
    at = lambda n: f"({x}.{n} + {by})" if n in parents else f"{x}.{n}"
    relations = f"transform({x}.relations, {y} -> named_struct('label', {y}.label, 'target', {y}.target + {by}))"
    return f"transform({cohorts}, {x} -> named_struct('form', {x}.form, 'readings', {x}.readings, 'parent', {at('parent')}, 'agr_parent', {at('agr_parent')}, 'relations', {relations}, 'rules', {x}.rules))"


def _windows(cohorts: str, delimiters: frozenset) -> str:
    """(base, c): the cohorts up to each delimiter, and their first place."""
    x, j, k, s, n = (_new(z) for z in "xjksn")
    after = f"transform({cohorts}, ({x}, {j}) -> if({x}.form IN ({', '.join(map(literal, sorted(delimiters))) or 'null'}), {j} + 1, null))"
    starts = f"concat(array(0), filter({after}, {k} -> {k} < size({cohorts})))"
    pieces = _let(starts, s, f"transform({s}, ({x}, {n}) -> named_struct('base', {x}, 'c', slice({cohorts}, {x} + 1, coalesce(get({s}, {n} + 1), size({cohorts})) - {x})))")
    return f"if(size({cohorts}) = 0, cast(array() AS array<struct<base:int,c:array<{COHORT}>>>), {pieces})"


def grammar_sql(grammar, cohorts: str, number: int, snapshot: int | None = None) -> str:
    """(base, c, events) of each window of a sentence after a grammar; places of results are the sentence's."""
    w, d, e = _new("w"), _new("d"), _new("e")
    x, r = _new("x"), _new("r")
    free = f"transform({w}.c, {x} -> named_struct('form', {x}.form, 'readings', transform({x}.readings, {r} -> named_struct('lemma', {r}.lemma, 'tags', {r}.tags, 'locked', false)), 'parent', {x}.parent, 'agr_parent', {x}.agr_parent, 'relations', {x}.relations, 'rules', {x}.rules))"
    state = window_sql(grammar, _moved(free, f"(- {w}.base)"), number, snapshot)
    both = ("parent", "agr_parent") if snapshot is not None else ("parent",)
    event = f"transform({d}.events, {e} -> named_struct('pos', {e}.pos + {w}.base, 'grammar', {e}.grammar, 'section', {e}.section, 'pass', {e}.pass, 'rule', {e}.rule, 'lemma', {e}.lemma, 'tags', {e}.tags))"
    done = _let(state, d, f"named_struct('c', {_moved(f'{d}.c', f'{w}.base', both)}, 'events', {event})")
    return f"transform({_windows(cohorts, grammar.delimiters)}, {w} -> {done})"


@contextlib.contextmanager
def _deep(spark):
    """Lambdas are resolved from the outside in, a few turns of the analyser each: allow as many as nested contexts take."""
    name = "spark.sql.analyzer.maxIterations"
    usual = spark.conf.get(name)
    spark.conf.set(name, str(max(2000, int(usual))))
    try:
        yield
    finally:
        spark.conf.set(name, usual)


def applied(sentences: DataFrame, grammars: list, snapshot: int | None = None) -> DataFrame:
    """The sentences (cohorts: form, readings) after parsed grammars, in order, with ``trace``; other columns stay."""
    start = f"transform(cohorts, x -> cast(named_struct('form', x.form, 'readings', transform(x.readings, r -> named_struct('lemma', r.lemma, 'tags', r.tags, 'locked', false)), 'parent', null, 'agr_parent', null, 'relations', array(), 'rules', array()) AS {COHORT}))"
    kept = [c for c in sentences.columns if c not in ("cohorts", "trace")]
    df = sentences.select(*kept, F.expr(start).alias("_cohorts"), F.expr(f"cast(array() AS array<{EVENT}>)").alias("_trace"))
    for n, g in enumerate(grammars):
        with _deep(sentences.sparkSession):
            df = df.withColumn("_windows", F.expr(grammar_sql(g, "_cohorts", n, snapshot if n == 0 else None)))
        df = df.select(*kept, F.flatten("_windows.c").alias("_cohorts"), F.concat("_trace", F.flatten("_windows.events")).alias("_trace"))
    hidden = "(left({0}, 1) IN ('@', '&', '§'))"
    readings = f"transform(x.readings, r -> named_struct('lemma', r.lemma, 'tags', filter(r.tags, t -> NOT {hidden.format('t')})))"
    errors = "array_distinct(filter(flatten(transform(x.readings, r -> r.tags)), t -> startswith(t, '&')))"
    shown = f"transform(_cohorts, x -> named_struct('form', x.form, 'readings', {readings}, 'parent', x.parent, 'agr_parent', x.agr_parent, 'relations', x.relations, 'rules', x.rules, 'errors', {errors}))"
    return df.select(*kept, F.expr(shown).alias("cohorts"), F.col("_trace").alias("trace"))
