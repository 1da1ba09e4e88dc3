"""Repair of conversations, periodic runs and nearest neighbours against brute-force versions, with nulls, ties, repeats and odd columns."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.llm import nearest, periods, repair

GRAMMAR = re.compile(r"(s?(ua)+)?")


def _plain_repair(rows):
    """(cost, audit, turns) by trying all edits: rows are (role, text, must go, truncated)."""
    found = []

    def go(i, cost, audit, turns):
        if len(turns) and not GRAMMAR.fullmatch("".join(r[:1] or "?" for r, _ in turns) + "a" * (turns[-1][0][:1] == "u") + "ua" * (turns[-1][0][:1] == "s")):
            return
        if i == len(rows):
            if GRAMMAR.fullmatch("".join(r[:1] or "?" for r, _ in turns)):
                found.append((cost, audit, turns))
        if cost > 3 * len(rows):
            return
        if not audit.endswith("III"):
            for role in ("user", "assistant"):
                go(i, cost + 2, audit + "I", [*turns, (role, "")])
        if i < len(rows):
            role, text, gone, cut = rows[i]
            go(i + 1, cost + 3, audit + "D", turns)
            if not gone:
                go(i + 1, cost + cut, audit + "K", [*turns, (role, text)])
                for other in ("user", "assistant"):
                    go(i + 1, cost + 2 + cut, audit + "R", [*turns, (other, text)])

    go(0, 0, "", [])
    return min(found, key=lambda f: f[:2])


def _plain_conversation(rows):
    """What op11 returns of one conversation's rows (turn, role, text) after damage."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, kinds = set(), []
    for _, role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        kinds.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    cost, audit, out = _plain_repair([(r, t, k in ("blank", "duplicate"), k == "truncated") for (_, r, t), k in zip(rows, kinds)])
    said = "\n".join(f"{r}:{t}" for r, t in out)
    return (gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal, cost, audit, hashlib.sha256(said.encode()).hexdigest())


def _plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def _conversations():
    rnd = random.Random(11)
    rows = []
    for conv in range(150):
        for turn in range(rnd.choice([1, 2, 3, 4, 5])):
            role = rnd.choice(["system", "user", "assistant", "assistant", "user", "tool", None, ""])
            text = rnd.choice(["Yes.", "No", "Why?", "", " \n", "ok!\t", None, f"Text {conv} {turn}.", "日本。"])
            rows.append((conv, rnd.choice([turn, turn, turn + 1, None, turn * 100]), role, text))
    rows += [(None, 1, "user", "a."), (None, 0, "assistant", "b"), (7, 3, "user", "same."), (7, 3, "user", "same.")]
    return rows


def _read(df):
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return {r["conv_id"]: tuple(r[c] for c in names) for r in df.collect()}


def test_repair(spark, tmp_path):
    rows = _conversations()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, block long").repartition(3)
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    got = _read(repair.op11(spark, str(tmp_path)))
    after = _plain_damage(rows)
    wanted = {c: _plain_conversation([r[1:] for r in after if r[0] == c]) for c in {r[0] for r in rows}}
    assert got == wanted
    turns = repair.turns_of(repair.repaired(repair.damaged(df)))
    for conv, t in turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("range", "block", "place", "role"))).alias("t")).collect():
        assert GRAMMAR.fullmatch("".join(x["role"][:1] for x in t)), conv


def test_repair_cuts_long_conversations(spark, monkeypatch):
    """Small blocks and ranges of turns give what one block gives."""
    rnd = random.Random(5)
    rows = [(c, t, rnd.choice(["system", "user", "user", "assistant", "x"]), rnd.choice(["a.", "b", "", f"{t}.", f"{t}"])) for c in range(12) for t in range(60)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = _read(repair.digests(repair.repaired(df)))
    monkeypatch.setattr(repair, "BLOCK", 3)
    monkeypatch.setattr(repair, "TURN_RANGE", 7)
    assert _read(repair.digests(repair.repaired(df))) == whole
    for (conv, (*_, cost, audit, _)), edits in itertools.product(list(whole.items())[:3], [{"K": 0, "R": 2, "D": 3, "I": 2}]):
        assert sum(edits[e] for e in audit) <= cost and len(audit.replace("I", "")) == 60, conv


def test_repair_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert repair.op11(spark, str(tmp_path)).count() == 0


def _texts():
    rnd = random.Random(2)
    words = lambda n, v: " ".join(rnd.choices("abcdefghijklmnop"[:v], k=n))
    out = [None, "", " \t\n", "one", "a " * 11, "a " * 12, "a b " * 6, "a b c d e f " * 2, "x " + "p q r " * 9 + "p y y y y y y y y y y y y y", "é 日本 " * 20]
    out += [words(n, v) for n in (5, 13, 40, 90, 160) for v in (1, 2, 3, 8, 16)]
    for n in (1, 2, 5, 9, 20):  # runs within runs, and next to each other
        unit = words(n, 4)
        out += [" ".join([words(7, 9), *[unit] * 6, words(3, 9), *[unit] * 3]), " ".join([" ".join([unit] * 4 + ["z"])] * 5)]
    return out


@pytest.mark.parametrize("long_bytes", [1 << 20, 64])
def test_periodic_runs(spark, monkeypatch, long_bytes):
    monkeypatch.setattr(periods, "HEAD", 3)
    texts = _texts()
    ids = [*range(1, len(texts) - 1), None, 1]
    df = spark.createDataFrame(list(zip(ids, texts, ["k"] * len(ids))), "doc_id long, text string, runs string").repartition(3)
    got = sorted((tuple(r) for r in periods.digests(periods.runs(df, periods.repeated, long_bytes)).collect()), key=str)
    assert got == sorted((periods.plain(i, t) for i, t in zip(ids, texts)), key=str)


def test_periodic_runs_of_long_texts():
    """Texts beyond the table of comparisons, against the same scan by definition of a stretch."""
    rnd = np.random.default_rng(1)
    n = periods.TABLED + 3000
    x = rnd.integers(0, 50, n).astype(np.int32)
    x[100:9000] = np.tile(x[100:1100], 9)[:8900]
    x[9500:9530] = 7
    found = periods.scan(x)
    assert found[100, 9000] == 1000 and found[9500, 9530] == 1
    apart = {}
    for lo, hi in ((1, 400), (400, 5000), (5000, n // 2 + 1)):
        for run, q in periods.scan(x, lo, hi).items():
            apart[run] = min(q, apart.get(run, q))
    assert apart == found
    same = np.zeros(n, np.int32)
    assert periods.scan(same) == {(0, n): 1}
    for (s, e), q in found.items():
        assert (x[s : e - q] == x[s + q : e]).all() and e - s >= max(12, 2 * q)


def _vectors(n=3000, d=15, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)).astype(np.float32) + 2 * rng.normal(size=(8, d)).astype(np.float32)[rng.integers(0, 8, n)]
    x[n // 2 : n // 2 + n // 3] = x[0]  # a third are copies
    return x


def _frame(spark, ids, x):
    return spark.createDataFrame([(int(i), [None if v is None else float(v) for v in r] if r is not None else None, 1, 2) for i, r in zip(ids, x)], "vec_id long, embedding array<float>, leaf int, score int").repartition(4)


def test_nearest(spark):
    x = _vectors()
    odd = [None, [0.0] * 15, [float("nan")] + [1.0] * 14, [float("inf")] + [1.0] * 14, [None] + [1.0] * 14, [9.0] * 14, []]
    df = _frame(spark, [*range(len(x)), *range(10_000, 10_000 + 20 * len(odd), 20)], [*x, *odd])
    rows = nearest.neighbours(df).collect()
    got: dict = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, len(x), 20))
    d = x.astype(np.float64)
    hits = total = 0
    for q, found in got.items():
        scores = d @ d[q]
        order = [i for i in np.lexsort((np.arange(len(x)), -scores)) if i != q][:20]
        assert len(found) == 20 and found == sorted(found, key=lambda f: (-f[1], f[0]))
        assert np.allclose([s for _, s in found], scores[[i for i, _ in found]], rtol=1e-12) and q not in dict(found)
        hits, total = hits + len(set(order) & {i for i, _ in found}), total + 20
    assert hits / total > 0.95


def test_nearest_in_many_leaves(spark, monkeypatch):
    """Isotropic vectors, where leaves help least: recall against brute force."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(6000, 32)).astype(np.float32)
    monkeypatch.setattr(nearest, "RERANK", 64)
    got = nearest.neighbours(_frame(spark, range(len(x)), x)).groupBy("query_id").agg(F.collect_set("vec_id").alias("v")).collect()
    d = x.astype(np.float64)
    share = [len(set(r["v"]) & {int(i) for i in np.argsort(-(d @ d[r["query_id"]])) if i != r["query_id"]} & set(np.argsort(-(d @ d[r["query_id"]]))[:21].tolist())) / 20 for r in got]
    assert np.mean(share) >= 0.9


def test_nearest_of_few(spark):
    x = _vectors(5, 4)
    ids = [0, 20, 20, 3, 40]
    rows = nearest.neighbours(_frame(spark, ids, x)).collect()
    assert sorted((r["query_id"], r["rank"]) for r in rows) == sorted((q, k) for q in (0, 20, 20, 40) for k in range(1, 5))
    assert nearest.neighbours(_frame(spark, [], [])).count() == 0
    assert nearest.neighbours(_frame(spark, [0, 1], [None, [0.0, 0.0]])).count() == 0


def test_score_aware_codes_keep_the_parallel_part():
    """The weighted loss leaves less error along the vector than plain quantisation does."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 16))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    along = {}
    for eta in (1.0, 4.0):
        books = nearest._fitted(x, unit, eta, np.random.default_rng(0))
        codes = nearest._codes(x, unit, books, eta)
        left = x - np.concatenate([b[codes[:, m]] for m, b in enumerate(books)], 1)
        along[eta] = ((left * unit).sum(1) ** 2).mean()
    assert along[4.0] < 0.7 * along[1.0]
