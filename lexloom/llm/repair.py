r"""Repair of the structure of conversations by A* on the edit lattice.

A repaired conversation is empty, or an optional system turn and pairs of a user's and an assistant's turn. Edits of a row: Keep (0),
Rerole to user or assistant (2), Delete (3; the only one for blank rows and duplicates); an empty turn is Inserted anywhere for 2; a
truncated row that stays costs 1 more. A node of the lattice is how many rows are read and what role came last; what is still to come
costs at least the deletions that must be and one for each truncated row, kept or not, and these suffix sums are the heuristic. The
queue is keyed (cost plus heuristic, audit), where the audit is the edits' initials, so the first path to reach a node is the
cheapest and, among those, least in ASCII: roles are forced by what came before, so an audit names one path.

Rows are dealt by conversation and range of turns, sorted, and cut into blocks of at most ``BLOCK``. Each block is searched from every
role that may come before it; which path a conversation takes through its blocks is then a fold over these few costs, without the
texts. So a conversation of any length spreads over tasks, and no task holds more than a block of it.

Roles count by their first letter (s, u, a); null roles and texts are one space, so such a text is blank. Rows of a conversation go by
turn, nulls first, then role, then text; repeated rows are duplicates. Rows without conv_id are one conversation. Other columns are
ignored; an empty table gives an empty result.
"""

import hashlib
import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import arrow_schema, small_batches, staged

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
BLOCK, TURN_RANGE = 256, 64
BLANKS = " \t\n\x0b\x0c\r"
# What came last: 0 nothing, 1 system, 2 user, 3 assistant; which may follow, and what an inserted or renamed turn must be.
_NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
_FORCED = (2, 2, 3, 2)
_ROLE = (None, "system", "user", "assistant")
_TAIL = ("", "II", "I", "")  # what completes a conversation
_BLOCKS = "conv_id long, range long, block long, blank long, duplicate long, truncated long, illegal long, turns long, low long, high long, first string, last string, paths array<struct<begin:int,end:int,cost:long,audit:string>>, roles array<string>, texts array<string>"
_NAMES = [x.split(" ")[0] for x in "conv_id,range,block,blank,duplicate,truncated,illegal,turns,low,high,first,last,paths,roles,texts".split(",")]


def paths(rows: list[tuple[str, bool, bool]], begin: int) -> dict[int, tuple[int, str]]:
    """{what comes last: (cost, audit)} of the cheapest edits of rows (initial, must go, truncated) after ``begin``, for each end that
    can be reached. Insertions stand before a row; those after the last row are left to what follows."""
    rest = [0] * (len(rows) + 1)
    for i in range(len(rows) - 1, -1, -1):
        rest[i] = rest[i + 1] + (DELETE if rows[i][1] else TRUNCATED if rows[i][2] else 0)
    queue, closed, out = [(rest[0], "", 0, begin)], set(), {}
    while queue:
        f, audit, i, q = heapq.heappop(queue)
        if (i, q) in closed:
            continue
        closed.add((i, q))
        cost = f - rest[i]
        if i == len(rows):
            out[q] = (cost, audit)
            continue
        initial, gone, cut = rows[i]
        moves = [(DELETE, "D", i + 1, q), (INSERT, "I", i, _FORCED[q])]
        if not gone:
            moves.append((REROLE + TRUNCATED * cut, "R", i + 1, _FORCED[q]))
            if (q, initial) in _NEXT:
                moves.append((KEEP + TRUNCATED * cut, "K", i + 1, _NEXT[q, initial]))
        for price, edit, j, r in moves:
            if (j, r) not in closed:
                heapq.heappush(queue, (cost + price + rest[j], audit + edit, j, r))
    return out


def apply(audit: str, begin: int, roles: list[str], texts: list[str]) -> list[tuple[str, str]]:
    """The turns that an audit makes of rows."""
    out, i, q = [], 0, begin
    for edit in audit:
        if edit == "I":
            q = _FORCED[q]
            out.append((_ROLE[q], ""))
            continue
        if edit == "K":
            q = _NEXT[q, roles[i][:1]]
            out.append((roles[i], texts[i]))
        elif edit == "R":
            q = _FORCED[q]
            out.append((_ROLE[q], texts[i]))
        i += 1
    return out


def _flagged(rows: DataFrame) -> DataFrame:
    """The rows with their range of turns, and whether they are blank, were said at an earlier turn, or are cut off."""
    text = F.coalesce("text", F.lit(" "))
    end = F.rtrim(text, F.lit(BLANKS))
    own = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"), (end == "").alias("blank"), (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    own = own.withColumn("range", F.floor(F.col("turn") / TURN_RANGE)).withColumn("said", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    place = F.struct(F.col("turn").isNotNull().alias("some"), F.col("turn").alias("turn"))
    several = own.where(~F.col("blank")).groupBy(F.col("conv_id").alias("c"), F.col("said").alias("s")).agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).where("n > 1")
    both = own.join(several, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("said") == F.col("s")), "left")
    return both.select("conv_id", "range", "turn", "role", "text", "blank", "cut", F.coalesce(place > F.col("first"), F.lit(False)).alias("again"))


def blocks(rows: DataFrame) -> DataFrame:
    """Up to BLOCK rows each: their faults, roles and texts, and the cheapest edits from and to every state."""

    def run(batches):
        key, number, held, last, seen = None, 0, [], None, None

        def row():
            kinds = ["blank" if x["blank"] else "duplicate" if x["dup"] else "truncated" if x["cut"] else "" for x in held]
            initials = [x["role"][:1] for x in held]
            edges = [(i, k in ("blank", "duplicate"), k == "truncated") for i, k in zip(initials, kinds)]
            numbers = [x["turn"] for x in held if x["turn"] is not None]
            return (
                *key, number, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
                sum(x["new"] for x in held), min(numbers, default=None), max(numbers, default=None), initials[0], initials[-1],
                [(b, e, c, audit) for b in range(4) for e, (c, audit) in paths(edges, b).items()], [x["role"] for x in held], [x["text"] for x in held],
            )

        def frame(out):
            ints = dict.fromkeys(("conv_id", "range", "low", "high"), "Int64")
            return pd.DataFrame(out, columns=_NAMES).astype(ints)

        for b in batches:
            out = []
            for x in b.to_pylist():
                own = (x["conv_id"], x["range"])
                if own != key or len(held) == BLOCK:
                    if held:
                        out.append(row())
                    number = number + 1 if own == key else 0
                    if own != key:
                        key, last, seen = own, None, None
                    held = []
                said = (x["turn"], x["role"], x["text"])
                x["dup"] = x["again"] or said == last  # equal rows stand together
                x["new"] = x["turn"] is not None and x["turn"] != seen
                last, seen = said, x["turn"]
                held.append(x)
            if out:
                yield frame(out)
        if held:
            yield frame([row()])

    target = arrow_schema(_BLOCKS)

    def arrow(batches):
        import pyarrow as pa

        fields = ("begin", "end", "cost", "audit")
        for f in run(batches):
            f["paths"] = [[dict(zip(fields, p)) for p in ps] for ps in f["paths"]]
            yield pa.RecordBatch.from_pandas(f, schema=target, preserve_index=False)

    spread = _flagged(rows).repartition("conv_id", "range").sortWithinPartitions("conv_id", "range", "turn", "role", "text")
    return spread.mapInArrow(arrow, _BLOCKS)


def _choices(found: DataFrame) -> DataFrame:
    """conv_id, range, block, begin, end, tail: the path through each block, and whether the conversation ends there (with what is
    inserted last); and on its first block its counts and cost. A fold over the blocks of a conversation, without texts."""
    schema = "conv_id long, range long, block long, begin int, end int, tail string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def run(batches):
        key = None
        missing = object()

        def rows():
            cost, _, q = min((c + INSERT * len(_TAIL[q]), rank, q) for q, (c, rank) in best.items())
            way, end = [], q
            for back in reversed(trail):
                way.append((back[q], q))
                q = back[q]
            gaps = high - low + 1 - counts["turns"] if low is not None else 0
            for i, ((r, n), (a, z)) in enumerate(zip(places, reversed(way))):
                numbers = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], counts["illegal"], cost) if i == 0 else (None,) * 6
                yield (key, r, n, a, z, _TAIL[end] if i == len(places) - 1 else None, *numbers)

        def frame(out):
            ints = dict.fromkeys(("conv_id", "range", "gaps", "blank", "duplicate", "truncated", "illegal", "cost"), "Int64")
            return pd.DataFrame(out, columns=names).astype(ints)

        key, best, trail, places = missing, {}, [], []
        for b in batches:
            out = []
            for x in b.to_pylist():
                if x["conv_id"] != key:
                    if key is not missing:
                        out.extend(rows())
                    key, best, trail, places = x["conv_id"], {0: (0, 0)}, [], []
                    counts = dict.fromkeys(("turns", "blank", "duplicate", "truncated", "illegal"), 0)
                    low = high = before = None
                for c in counts:
                    counts[c] += x[c]
                counts["illegal"] += before is not None and before + x["first"] not in ("su", "ua", "au")
                before = x["last"]
                if x["low"] is not None:
                    low, high = x["low"] if low is None else min(low, x["low"]), x["high"] if high is None else max(high, x["high"])
                # Of the ways to each end the cheapest, then the least: what came before decides, as no audit begins another.
                found_ends: dict = {}
                for p in x["paths"]:
                    if p["begin"] in best:
                        c, rank = best[p["begin"]]
                        way = (c + p["cost"], rank, p["audit"], p["begin"])
                        found_ends[p["end"]] = min(way, found_ends.get(p["end"], way))
                order = sorted(found_ends, key=lambda e: found_ends[e][1:3])
                best = {e: (found_ends[e][0], order.index(e)) for e in found_ends}
                trail.append({e: w[3] for e, w in found_ends.items()})
                places.append((x["range"], x["block"]))
            if out:
                yield frame(out)
        if key is not missing:
            yield frame(list(rows()))

    target = arrow_schema(schema)

    def arrow(batches):
        import pyarrow as pa

        for f in run(batches):
            yield pa.RecordBatch.from_pandas(f, schema=target, preserve_index=False)

    return found.drop("roles", "texts").repartition("conv_id").sortWithinPartitions("conv_id", "range", "block").mapInArrow(arrow, schema)


def repaired(rows: DataFrame) -> DataFrame:
    """conv_id, range, block (in which order a conversation's blocks go), audit, turns (role and text after repair) of each block of
    rows (conv_id, turn, role, text); on the first block of a conversation also gaps, blank, duplicate, truncated, illegal, cost."""
    schema = "conv_id long, range long, block long, audit string, turns array<struct<role:string,text:string>>, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
    found = staged(blocks(rows), "blocks")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    own = _choices(found).select(*(F.col(c).alias("_" + c) for c in ("conv_id", "range", "block", "begin", "end", "tail", *counts)))
    both = found.join(own, F.col("conv_id").eqNullSafe(F.col("_conv_id")) & F.col("range").eqNullSafe(F.col("_range")) & (F.col("block") == F.col("_block")))
    way = F.get(F.filter("paths", lambda p: (p["begin"] == F.col("_begin")) & (p["end"] == F.col("_end"))), F.lit(0))["audit"]
    chosen = both.select("conv_id", "range", "block", F.concat(way, F.coalesce("_tail", F.lit(""))).alias("audit"), F.col("_begin").alias("begin"), "roles", "texts", *(F.col("_" + c).alias(c) for c in counts))

    target = arrow_schema(schema)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            turns = [[{"role": r, "text": t} for r, t in apply(a, q, roles, texts)] for a, q, roles, texts in zip(*(b[c].to_pylist() for c in ("audit", "begin", "roles", "texts")))]
            yield pa.RecordBatch.from_arrays([pa.array(turns, f.type) if f.name == "turns" else b[f.name] for f in target], schema=target)

    return chosen.mapInArrow(run, schema)


def turns_of(done: DataFrame) -> DataFrame:
    """conv_id, range, block, place, role, text of the repaired turns."""
    return done.select("conv_id", "range", "block", F.posexplode("turns").alias("place", "t")).select("conv_id", "range", "block", "place", "t.role", "t.text")


def digests(done: DataFrame) -> DataFrame:
    """A row a conversation: its counts, cost and audit, and the hash of its repaired turns, taken in order as a stream."""
    schema = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    names = [x.split(" ")[0] for x in schema.split(", ")]

    target = arrow_schema(schema)

    def run(batches):
        import pyarrow as pa

        missing = object()
        key, counts, audit, said, any_turn = missing, None, [], None, False
        rows: list = []

        def batch():
            out = pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=target)
            rows.clear()
            return out

        for b in batches:
            for x in b.to_pylist():
                if x["conv_id"] != key:
                    if key is not missing:
                        rows.append((key, *counts, "".join(audit), said.hexdigest()))
                    key, audit, said, any_turn = x["conv_id"], [], hashlib.sha256(), False
                    counts = [x[c] for c in names[1:7]]
                audit.append(x["audit"])
                for t in x["turns"]:
                    said.update((("\n" if any_turn else "") + f"{t['role']}:{t['text']}").encode("utf-8", "surrogatepass"))
                    any_turn = True
            yield batch()
        if key is not missing:
            rows.append((key, *counts, "".join(audit), said.hexdigest()))
            yield batch()

    return done.repartition("conv_id").sortWithinPartitions("conv_id", "range", "block").mapInArrow(run, schema)


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with a few faults of each kind, by a hash of conv_id and turn; nulls become one space."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def op11(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    every = rows.select(F.col("conv_id").alias("c")).distinct()
    done = digests(repaired(damaged(rows)))
    both = every.join(done, F.col("c").eqNullSafe(F.col("conv_id")), "left")
    zero = lambda x: F.coalesce(x, F.lit(0)).cast("long").alias(x)
    return both.select(F.col("c").alias("conv_id"), *(zero(x) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def _crc32_sql(text: str) -> str:
    """CRC-32 of ASCII text in SQL: one step of the polynomial a bit."""
    step = "CASE WHEN {0} & 1 = 1 THEN xor({0} >> 1, 3988292384) ELSE {0} >> 1 END"
    byte = f"list_reduce(list_prepend(xor(a, b) & 255, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda v, z: {step.format('v')})"
    return f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split({text}, ''), lambda s: ascii(s)::BIGINT)), lambda a, b: xor(a >> 8, {byte})), 4294967295)"


#: The same by dynamic programming over the rows of all conversations: each step keeps the best way to each role that may come last.
ORACLE = rf"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM k, range(2) r(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM n),
f AS MATERIALIZED (SELECT *, left(role, 1) AS c, CASE WHEN body = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM o),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  (SELECT count(*) FROM f a JOIN f b ON a.conv_id IS NOT DISTINCT FROM b.conv_id AND b.i = a.i + 1 WHERE a.conv_id IS NOT DISTINCT FROM f.conv_id AND a.c || b.c NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM f GROUP BY conv_id),
ins(q, put, r, said) AS (VALUES (0, '', 0, ''), (1, '', 1, ''), (2, '', 2, ''), (3, '', 3, ''), (0, 'I', 2, 'user:' || chr(10)), (1, 'I', 2, 'user:' || chr(10)), (2, 'I', 3, 'assistant:' || chr(10)), (3, 'I', 2, 'user:' || chr(10)),
  (0, 'II', 3, 'user:' || chr(10) || 'assistant:' || chr(10)), (1, 'II', 3, 'user:' || chr(10) || 'assistant:' || chr(10)), (2, 'II', 2, 'assistant:' || chr(10) || 'user:' || chr(10)), (3, 'II', 3, 'user:' || chr(10) || 'assistant:' || chr(10))),
edit(q, act, c, r, name) AS (VALUES (0, 'K', 's', 1, ''), (0, 'K', 'u', 2, ''), (1, 'K', 'u', 2, ''), (3, 'K', 'u', 2, ''), (2, 'K', 'a', 3, ''), (0, 'R', '', 2, 'user'), (1, 'R', '', 2, 'user'), (3, 'R', '', 2, 'user'), (2, 'R', '', 3, 'assistant'),
  (0, 'D', '', 0, ''), (1, 'D', '', 1, ''), (2, 'D', '', 2, ''), (3, 'D', '', 3, '')),
s AS (SELECT conv_id, 0::BIGINT AS i, 0 AS q, 0::BIGINT AS cost, '' AS audit, '' AS said FROM g UNION ALL
  SELECT conv_id, i, q, cost, audit, said FROM (SELECT s.conv_id, f.i, edit.r AS q, s.cost + 2 * length(put) + CASE act WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END + CASE WHEN act <> 'D' AND fault = 'truncated' THEN 1 ELSE 0 END AS cost,
      s.audit || put || act AS audit, s.said || ins.said || CASE act WHEN 'D' THEN '' WHEN 'R' THEN name || ':' || text || chr(10) ELSE role || ':' || text || chr(10) END AS said
    FROM s JOIN f ON s.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = s.i + 1 JOIN ins ON ins.q = s.q JOIN edit ON edit.q = ins.r WHERE (act = 'D' OR fault NOT IN ('blank', 'duplicate')) AND (act <> 'K' OR edit.c = f.c))
  QUALIFY row_number() OVER (PARTITION BY conv_id, q ORDER BY cost, audit) = 1),
e AS (SELECT s.conv_id, cost + 2 * length(put) AS cost, audit || put AS audit, s.said || ins.said AS said FROM s JOIN g ON s.conv_id IS NOT DISTINCT FROM g.conv_id AND s.i = g.n JOIN ins ON ins.q = s.q AND ins.r IN (0, 3)
  QUALIFY row_number() OVER (PARTITION BY s.conv_id ORDER BY cost + 2 * length(put), audit || put) = 1)
SELECT x.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(left(said, greatest(length(said) - 1, 0)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) x LEFT JOIN g ON x.conv_id IS NOT DISTINCT FROM g.conv_id LEFT JOIN e ON x.conv_id IS NOT DISTINCT FROM e.conv_id
"""
