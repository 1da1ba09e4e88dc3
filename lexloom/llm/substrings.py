"""Removal of repeated substrings with a distributed suffix array on a difference cover.

A difference cover is a set of sampled positions such that any two positions that are to be compared reach sampled ones at the
same shift. Here the cover is chosen by content: each string of ``length`` bytes samples the place of its smallest 32-byte hash,
so equal strings sample the same place in themselves, and one position in about 35 is sampled instead of two in three. Sampled
suffixes spread over tasks by that hash; within a task

- the suffixes of sampled positions are sorted by their next ``length`` bytes: words of 8 bytes are letters, triples of letters
  are sorted and named, and the names are sorted in triples again until one name stands for the whole;
- the remaining suffixes are merged in: a suffix is the bytes left of its sampled position plus that position's rank, so the
  left sides are sorted and named in the same way, read backwards;
- common prefixes of neighbours in both orders tell which strings are equal, at every shift at once.

A sampled hash that occurs once cannot lie in a repeat, and a sampled position whose whole surroundings repeat an earlier one
repeats all its strings; neither needs bytes. A hash with more than ``hot`` distinct surroundings is not gathered in one task:
its strings are compared one by one, by 128-bit hashes and a minimum that is combined before the shuffle.

Surroundings of a sampled position that a task has met before never leave it twice, and a hash's rows pass through its task in
sorted order with at most ``hot`` of them in memory, so passages that every document repeats don't gather.

Each byte covered by a string that also starts earlier (smaller doc_id, or the same document and an earlier start) goes. Every row is
a document: rows with one doc_id and different texts follow each other by a hash of the text, of equal rows the first stays, and
rows without a doc_id come before all others. Null and empty texts have no bytes; texts shorter than ``length`` keep all; other
columns are ignored; an empty table gives an empty result.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import drop, small_batches, staged
from ._text import U, groups, joined, mixed, prefix_hash, span_hash, utf8

LENGTH, GRAM, HOT, PIECE, BATCH_BYTES, SORT_ROWS = 100, 32, 2_000, 1_000_000, 2_000_000, 50_000
MOST_MET, FEW = 200_000, 100_000


def _least(g: np.ndarray, width: int) -> np.ndarray:
    """For each i the first place of the smallest of g[i : i + width]."""
    v, at, have = g, np.arange(len(g), dtype=np.int32), 1
    while have < width:
        step = min(have, width - have)
        n = len(v) - step
        left = v[:n] <= v[step:]
        at = np.where(left, at[:n], at[step:])
        v = np.minimum(v[:n], v[step:])
        have += step
    return at


def samples(raw: list[bytes], length: int = LENGTH):
    """Sampled positions of texts: (text, hash, surroundings' hash, position, first start, last start), places in bytes.

    The starts are those of the strings that sample the position. A long text is cut into pieces that overlap.
    """
    back, ahead = length - GRAM, length
    pieces, of, begin, low, high, size = [], [], [], [], [], []
    for i, r in enumerate(raw):
        for s in range(0, max(0, len(r) - length + 1), PIECE):
            last = min(s + PIECE, len(r) - length + 1) - 1
            a, z = max(0, s - back), min(len(r), last + back + ahead)
            pieces.append(r[a:z])
            of.append(i)
            begin.append(a)
            low.append(s - a)
            high.append(last - a)
            size.append(len(r))
    none = np.zeros(0, np.int64)
    if not pieces:
        return none, none.astype(U), none.astype(U), none, none, none
    buf, off = joined(pieces)
    sums = prefix_hash(buf)
    j = np.arange(len(buf) - GRAM + 1)
    g = span_hash(sums, j, j + GRAM)
    at = _least(g, length - GRAM + 1)
    low, high, begin, of, size = (np.array(x, np.int64) for x in (low, high, begin, of, size))
    count = high - low + 1
    piece = np.repeat(np.arange(len(pieces)), count)
    start = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + (low + off[:-1])[piece]
    chosen = at[start].astype(np.int64)
    first = np.flatnonzero(np.r_[True, chosen[1:] != chosen[:-1]])
    last = np.r_[first[1:], len(start)] - 1
    piece, p = piece[first], chosen[first]
    shift = begin[piece] - off[piece]  # from the buffer to the text
    left, right = np.minimum(back, p + shift), np.minimum(ahead, size[piece] - (p + shift))
    with np.errstate(over="ignore"):
        around = mixed(span_hash(sums, p - left, p + right) + left.astype(U) * U(0x632BE59BD9B4E019))
    return of[piece], g[p], around, p + shift, start[first] + shift, start[last] + shift


def _pack(p, low, high):
    return (p << 14) | ((p - low) << 7) | (p - high)


def _unpack(x):
    p = x >> 14
    return p, p - ((x >> 7) & 127), p - (x & 127)


def _names(letters: np.ndarray) -> np.ndarray:
    """Ranks of rows of letters, equal rows alike: sort triples, name them, and go on with the names."""
    while True:
        named = []
        for c in range(0, letters.shape[1], 3):
            triple = letters[:, c : c + 3]
            order = np.lexsort(triple.T[::-1])
            new = np.r_[False, (triple[order][1:] != triple[order][:-1]).any(1)]
            rank = np.empty(len(order), np.int64)
            rank[order] = np.cumsum(new)
            named.append(rank)
        letters = np.stack(named, 1)
        if letters.shape[1] == 1:
            return letters[:, 0]


def _sorted_sides(group: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows by (group, bytes), and how many bytes each row shares with the one before it (-1: another group)."""
    pad = -side.shape[1] % 8
    letters = np.ascontiguousarray(np.pad(side, ((0, 0), (0, pad)))).view(">u8").astype(U)
    order = np.lexsort((_names(letters), group))
    a = side[order]
    differ = a[1:] != a[:-1]
    shared = np.where(differ.any(1), differ.argmax(1), side.shape[1])
    shared[group[order][1:] != group[order][:-1]] = -1
    return order, np.r_[-1, shared]


def repeats(group: np.ndarray, doc: np.ndarray, sub: np.ndarray, p: np.ndarray, low: np.ndarray, high: np.ndarray, left: list[bytes], right: list[bytes], length: int = LENGTH):
    """(row, first start, last start) of the strings that also start earlier, among rows with their sides of bytes."""
    back = length - GRAM
    fill = lambda rows, n: np.frombuffer(b"".join(r.ljust(n, b"\0") for r in rows), np.uint8).reshape(len(rows), n)
    right_order, right_shared = _sorted_sides(group, fill(right, length))
    left_order, left_shared = _sorted_sides(group, fill([x[::-1] for x in left], back))
    place = np.lexsort((p, sub, doc))
    earlier = np.empty(len(p), np.int64)
    earlier[place] = np.cumsum(np.r_[False, _changes(doc[place], sub[place], p[place])])
    rows, starts = [], []
    r_class, l_class = np.empty(len(p), np.int64), np.empty(len(p), np.int64)
    for o in range(back + 1):
        live = np.flatnonzero((p - high <= o) & (o <= p - low))
        if not len(live):
            continue
        r_class[right_order] = np.cumsum(right_shared < length - o)
        l_class[left_order] = np.cumsum(left_shared < o)
        key = r_class[live] * (len(p) + 1) + l_class[live]
        order = np.lexsort((earlier[live], key))
        k, e = key[order], earlier[live][order]
        head = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        least = np.repeat(e[head], np.diff(np.r_[head, len(k)]))
        again = live[order][e > least]
        rows.append(again)
        starts.append(p[again] - o)
    if not rows:
        return (np.zeros(0, np.int64),) * 3
    rows, starts = np.concatenate(rows), np.concatenate(starts)
    order = np.lexsort((starts, rows))
    rows, starts = rows[order], starts[order]
    head = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]) | (starts[1:] != starts[:-1] + 1)][: len(rows)])
    return rows[head], starts[head], starts[np.r_[head[1:], len(rows)] - 1] if len(rows) else starts


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where any of the columns differs from the row before."""
    out = np.zeros(max(0, len(columns[0]) - 1), bool)
    for c in columns:
        out |= c[1:] != c[:-1]
    return out


def _again(h, c, doc, sub, p) -> np.ndarray:
    """1 for rows whose surroundings are those of an earlier position, else 0; rows are sorted."""
    head = np.flatnonzero(np.r_[True, _changes(h, c)][: len(h)])
    n = np.diff(np.r_[head, len(h)])
    return ((doc != np.repeat(doc[head], n)) | (sub != np.repeat(sub[head], n)) | (p != np.repeat(p[head], n))).astype(np.int32)


_COLUMNS = ["kind", "h", "c", "doc", "sub", "packed"]
_SCHEMA = "kind int, h long, c long, doc long, sub long, packed long"


class _Met:
    """The first position of surroundings that a task has met, so that later ones are known for repeats at once."""

    def __init__(self):
        self.first: dict = {}

    def again(self, h, c, doc, sub, p, kind) -> None:
        """Mark rows of kind 0 that come after one met before; keep each batch's repeated surroundings in mind."""
        if len(self.first) > MOST_MET:
            self.first.clear()
        heads = np.flatnonzero(kind == 0)
        follow = np.r_[kind[1:] == 1, False]
        for i, key in zip(heads.tolist(), zip(h[heads].tolist(), c[heads].tolist())):
            at = (int(doc[i]), int(sub[i]), int(p[i]))
            known = self.first.get(key)
            if known is not None and known < at:
                kind[i] = 1
            elif known is not None or follow[i]:
                self.first[key] = at


def _grouped(batches, hot: int):
    """Rows sorted by h, c and place, with their kind: 1 repeats surroundings, 2 and 3 are the first of theirs under a hash with
    up to, or over, ``hot`` different ones. Only the first rows of the last hash wait, and at most ``hot`` of them."""
    head, waiting, over = None, [np.zeros(0, np.int64)] * 5, None

    def frame(kind, columns, rows):
        return pd.DataFrame({"kind": np.int32(kind), **{k: x[rows] for k, x in zip(_COLUMNS[1:], columns)}})

    def settled(columns):
        h = columns[0]
        n = np.bincount(np.cumsum(np.r_[0, _changes(h)])) if len(h) else np.zeros(0, np.int64)
        n = np.repeat(n, n)
        many = (n > hot) | (h == over if over is not None else False)
        return [frame(2, columns, (n > 1) & ~many), frame(3, columns, many)]

    for b in batches:
        out = [b[b["kind"] == 1][_COLUMNS]]
        x = b[b["kind"] == 0]
        columns = [x[k].to_numpy() for k in _COLUMNS[1:]]
        if len(x):
            h, c, doc, sub, place = (np.r_[z, y] if head is not None else y for z, y in zip(head or columns, [*columns[:4], columns[4] >> 14]))
            again = _again(h, c, doc, sub, place) == 1
            k = int(np.flatnonzero(np.r_[True, _changes(h, c)])[-1])
            again, head = again[len(again) - len(x) :], (h[k], c[k], doc[k], sub[k], place[k])
            out.append(frame(1, columns, again))
            waiting = [np.r_[w, y[~again]] for w, y in zip(waiting, columns)]
            whole = waiting[0] != columns[0][-1]
            out += settled([w[whole] for w in waiting])
            waiting = [w[~whole] for w in waiting]
            if over != columns[0][-1]:
                over = columns[0][-1] if len(waiting[0]) > hot else None
            if over is not None:
                out.append(frame(3, waiting, slice(None)))
                waiting = [w[:0] for w in waiting]
        yield pd.concat(out)
    yield pd.concat(settled(waiting))


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, doc (the smallest number without a doc_id), sub, several, text. ``sub`` tells rows of one doc apart: 0 where there is one only."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc"), "text")
    several = staged(rows.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc").alias("d")), "several")
    few = several.count() <= FEW
    return rows.join(F.broadcast(several) if few else several, F.col("doc") == F.col("d"), "left").select("doc_id", "doc", F.when(F.col("d").isNotNull(), F.xxhash64("text")).otherwise(F.lit(0).cast("long")).alias("sub"), F.col("d").isNotNull().alias("several"), "text")


def _spans(rows: DataFrame, length: int, hot: int) -> DataFrame:
    """doc, sub, low, high: ranges of starts of the strings that also start earlier."""
    spark = rows.sparkSession
    small_batches(spark)
    texts = rows.select("doc", "sub", "text").where("octet_length(text) >= %d" % length)

    def sample(batches):
        met = _Met()
        for b in batches:
            raw = [utf8(t) for t in b["text"]]
            docs_, subs = b["doc"].to_numpy(np.int64), b["sub"].to_numpy(np.int64)
            for part in groups([len(r) for r in raw], BATCH_BYTES):
                own, h, c, p, low, high = samples(raw[part], length)
                doc, sub = docs_[part][own], subs[part][own]
                order = np.lexsort((p, sub, doc, c, h))
                h, c, doc, sub, p, low, high = (x[order] for x in (h, c, doc, sub, p, low, high))
                kind = _again(h, c, doc, sub, p)
                met.again(h, c, doc, sub, p, kind)
                yield pd.DataFrame({"kind": kind, "h": h.view(np.int64), "c": c.view(np.int64), "doc": doc, "sub": sub, "packed": _pack(p, low, high)})

    sampled = texts.mapInPandas(sample, _SCHEMA).repartition(F.when(F.col("kind") == 0, F.col("h")).otherwise(F.xxhash64("doc", "packed")))
    placed = staged(sampled.sortWithinPartitions("kind", "h", "c", "doc", "sub", "packed").mapInPandas(lambda batches: _grouped(batches, hot), _SCHEMA), "sampled")

    def sides(batches):
        back = length - GRAM
        for b in batches:
            out = []
            for doc, sub, text, parts in zip(b["doc"], b["sub"], b["text"], b["parts"]):
                raw = utf8(text)
                for x in parts:
                    p = x["packed"] >> 14
                    if p + GRAM <= len(raw):
                        out.append((x["h"], x["kind"], doc, sub, x["packed"], raw[max(0, p - back) : p], raw[p : p + length]))
            yield pd.DataFrame(out, columns=["h", "kind", "doc", "sub", "packed", "before", "after"])

    wanted = placed.where("kind > 1").groupBy("doc", "sub").agg(F.collect_list(F.struct("h", "kind", "packed")).alias("parts"))
    seen = texts.join(wanted, ["doc", "sub"]).mapInPandas(sides, "h long, kind int, doc long, sub long, packed long, before binary, after binary")

    def compare(batches):
        rest = None  # less than SORT_ROWS and the rows of one hash, which are few here

        def found(x):
            p, low, high = _unpack(x["packed"].to_numpy())
            row, a, z = repeats(x["h"].to_numpy(), x["doc"].to_numpy(), x["sub"].to_numpy(), p, low, high, x["before"].tolist(), x["after"].tolist(), length)
            return pd.DataFrame({"doc": x["doc"].to_numpy()[row], "sub": x["sub"].to_numpy()[row], "low": a, "high": z})

        for b in batches:
            rest = b if rest is None else pd.concat([rest, b])
            whole = rest["h"].to_numpy() != rest["h"].iloc[-1] if len(rest) else np.zeros(0, bool)
            if whole.sum() >= SORT_ROWS:
                yield found(rest[whole])
                rest = rest[~whole]
        if rest is not None and len(rest):
            yield found(rest)

    def strings(batches):
        for b in batches:
            out = []
            for doc, sub, packed, left, right in zip(b["doc"], b["sub"], b["packed"], b["before"], b["after"]):
                p, low, high = _unpack(packed)
                raw, base = left + right, p - len(left)
                out += [(raw[s - base : s - base + length], doc, sub, s) for s in range(low, high + 1)]
            yield pd.DataFrame(out, columns=["string", "doc", "sub", "start"])

    low, high = F.shiftright("packed", 14) - F.shiftright("packed", 7).bitwiseAND(F.lit(127)), F.shiftright("packed", 14) - F.col("packed").bitwiseAND(F.lit(127))
    again = placed.where("kind = 1").select("doc", "sub", low.alias("low"), high.alias("high"))
    spans = again.union(seen.where("kind = 2").repartition("h").sortWithinPartitions("h").mapInPandas(compare, "doc long, sub long, low long, high long"))
    if placed.where("kind = 3").limit(1).count():
        each = seen.where("kind = 3").mapInPandas(strings, "string binary, doc long, sub long, start long").select(F.xxhash64("string").alias("sa"), F.xxhash64(F.reverse(F.hex("string"))).alias("sb"), "doc", "sub", "start")
        each = staged(each, "strings")
        least = each.groupBy("sa", "sb").agg(F.min(F.struct("doc", "sub", "start")).alias("least"))
        spans = spans.union(each.join(least, ["sa", "sb"]).where(F.struct("doc", "sub", "start") > F.col("least")).select("doc", "sub", "start", F.col("start")))
    return spans


def without_repeats(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, spans (removed runs of bytes), kept (remaining bytes) of every row."""
    if not 2 * GRAM < length <= GRAM + 127:
        raise ValueError(f"length must be over {2 * GRAM} and at most {GRAM + 127}")
    rows = _rows(docs)
    spans = _spans(rows, length, hot).groupBy("doc", "sub").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))

    def cut(batches):
        for b in batches:
            out = []
            for doc, copy, text, ranges in zip(b["doc_id"], b["copy"], b["text"], b["ranges"]):
                raw = utf8(text)
                merged: list[list[int]] = []
                found = [(0, len(raw))] if copy > 1 and len(raw) >= length else sorted((r["low"], min(r["high"] + length, len(raw))) for r in ([] if ranges is None else ranges))
                for x in found:
                    if merged and x[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], x[1])
                    else:
                        merged.append(list(x))
                edges = [0, *(e for m in merged for e in m), len(raw)]
                out.append((doc, len(raw), [{"start": s, "end": e} for s, e in merged], b"".join(raw[x:y] for x, y in zip(edges[::2], edges[1::2]))))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "spans", "kept"])

    # Equal rows: the first keeps what its spans leave, the others repeat it as a whole.
    keyed = rows.withColumn("copy", F.when(F.col("several"), F.row_number().over(Window.partitionBy("doc", "sub").orderBy("text"))).otherwise(1))
    out = keyed.join(spans, ["doc", "sub"], "left").select(F.col("doc_id").cast("string").alias("doc_id"), "copy", "text", "ranges").mapInPandas(cut, "doc_id string, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def op4(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return without_repeats(docs).select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple], length: int = LENGTH) -> list[tuple]:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) from a table of all strings; for tests. Rows in ascending doc_id."""
    import hashlib

    seen, out = set(), []
    for doc, text in rows:
        raw = utf8(text)
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - length + 1):
            s = raw[i : i + length]
            if s in seen:
                gone[i : i + length] = True
            seen.add(s)
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone[:-1]])
        out.append((doc, len(raw), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out
