"""N-gram Jaccard join by PartEnum signatures.

A document's set holds its distinct ``n``-word shingles. Sets fall into bands of sizes; a set signs for its own band and, if it is
large enough to match a set of the next band, for that one too (bands are so wide that no link passes over one). Within a band two
sets of the wanted likeness differ in at most k elements, k from the band's largest size.

Elements are dealt by their hash to first-level partitions, and within each to ``CELLS`` second-level ones. Two such sets differ in
at most one element in some first-level partition, so they agree on all its cells but one: every subset of a partition's cells that
leaves one out is enumerated, and its content, with band and place, is a signature. ``m`` spare partitions make that hold for
1 + m partitions, so subsets without any element can be left out for sets in which at most m partitions have one. Pairs of the
few other sets are found by dealing those anew, and what is left after ``DEALS`` deals also signs its empty subsets: no link is lost.

Groups of one signature are linked in two rounds. First each member is compared with the group's first member, the set with most
copies, and components of the links are built. Then, in groups that still hold several components, members outside the largest one
are compared with members of other components; such a group is dealt to blocks of ``BLOCK`` members, so no task meets a whole group.
Before whole sets are compared, odd sketches decide most pairs that share a signature by chance: for each element one bit is
flipped, so two sketches differ in no more bits than the sets in elements, and a pair that differs in more bits than its sizes allow
cannot link. Every remaining comparison is exact, on whole sets.

Sets are known by 128-bit hashes and shingles by 64-bit ones. Null, empty and blank texts have empty sets and link with nothing;
equal sets link; repeated rows, and different texts with one doc_id, are rows like any other. A row without a doc_id links too, but
gives its component no name: component_id is the smallest doc_id that is not null, null where there is none. Other columns are
ignored; an empty table gives an empty result.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import drop, map_texts, small_batches, staged
from ._text import PLAIN_WORD, U, groups, mixed, shingles, utf8, words
from .graph import components

WORDS, PERCENT, BAND, BATCH_BYTES, MEMBERS, FEW, BLOCK = 5, 80, 1.5, 1_000_000, 64, 250_000, 256
CELLS, DEALS = 3, 4


def bands(percent: int, largest: int) -> list[tuple[int, int, int, int, int]]:
    """(low, high, first-level partitions, cells of each, m) of each band up to a size; high is the next band's low."""
    out, low, wide = [], 1, max(BAND, 100 / percent)
    while low <= largest:
        high = max(low + 1, int(low * wide))
        k = 2 * (high - 1) * (100 - percent) // (100 + percent)
        m = 1 + (k + 1) // 12 if k else 0
        out.append((low, high, k // 2 + 1 + m, CELLS if k else 1, m))
        low = high
    return out


def _deal(owner, hashes, first, parts, cells, tag, deal: int):
    """Signatures (set, partition, left-out cell) of one deal as rows (set, signature, without elements); by set, whether more
    than its m partitions have a subset without elements comes from the caller."""
    n = len(parts)
    with np.errstate(over="ignore"):
        place = (mixed(hashes ^ U((0x5851F42D4C957F2D + 0x9E3779B97F4A7C15 * deal) % 2**64)) >> U(33)).astype(np.int64)
        at = first[owner] + place % parts[owner] * CELLS + (place // (1 << 16)) % cells[owner]
        content = np.zeros(first[-1], U)
        np.add.at(content, at, mixed(hashes + U(0x9E3779B97F4A7C15)))
        count = np.bincount(at, minlength=first[-1]).reshape(-1, CELLS)
        content = content.reshape(-1, CELLS)
        rest, left = content.sum(1, keepdims=True, dtype=U) - content, count.sum(1, keepdims=True) - count
        of = np.repeat(np.arange(n), parts)
        place = np.arange(len(of)) - first[of] // CELLS
        # A set of one cell a partition has one subset: the whole.
        whole = cells[of] == 1
        rest[whole, 0], left[whole, 0] = content[whole].sum(1, dtype=U), count[whole].sum(1)
        wanted = np.ones(rest.shape, bool)
        wanted[whole, 1:] = False
        mark = mixed(tag[of] * U(1_000_003) + U(deal))[:, None] + (place[:, None] * CELLS + np.arange(CELLS)).astype(U)
        sign = mixed(rest + mixed(mark))
    bare = (left == 0) & wanted
    return np.broadcast_to(of[:, None], sign.shape), sign, wanted, bare, np.bincount(of[bare.any(1)], minlength=n)


def signatures(owner: np.ndarray, hashes: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner, signature) of sets given as sorted (owner, hash) rows."""
    table = np.array(bands(percent, max(1, int(sizes.max(initial=1)) * 2)), np.int64)
    home = np.searchsorted(table[:, 0], sizes, "right") - 1
    out_owner, out = [np.zeros(0, np.int64)], [np.zeros(0, U)]
    for guest in (0, 1):
        band = np.minimum(home + guest, len(table) - 1)
        signs = sizes > 0
        if guest:  # large enough for a set of the next band
            signs &= 100 * sizes >= percent * table[band, 0]
        for deal in range(DEALS):
            chosen = np.flatnonzero(signs)
            if not len(chosen):
                break
            number = np.full(len(sizes), -1)
            number[chosen] = np.arange(len(chosen))
            rows = signs[owner]
            parts, cells, m = (table[band[chosen], k] for k in (2, 3, 4))
            first = np.r_[0, np.cumsum(parts * CELLS)]
            of, sign, wanted, bare, thin = _deal(number[owner[rows]], hashes[rows], first, parts, cells, band[chosen].astype(U), deal)
            thin = thin > m
            keep = wanted & (~bare | (thin[of] & (deal == DEALS - 1)))
            out_owner.append(chosen[of[keep]])
            out.append(sign[keep])
            signs = np.zeros(len(sizes), bool)
            signs[chosen[thin]] = True
    return np.concatenate(out_owner), np.concatenate(out).view(np.int64)


LEAST_BITS = 256


def odd_sketches(owner: np.ndarray, hashes: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """The sketch of each set in 64-bit words: twice as many bits as the set has elements, rounded up to a power of two."""
    bits = 2 ** np.ceil(np.log2(np.maximum(2 * sizes, LEAST_BITS))).astype(np.int64)
    first = np.r_[0, np.cumsum(bits >> 6)]
    flat = np.zeros(first[-1], U)
    at = (mixed(hashes ^ U(0x2545F4914F6CDD1D)) & U(2**62 - 1)).astype(np.int64) & (bits[owner] - 1)
    np.bitwise_xor.at(flat, first[owner] + (at >> 6), U(1) << (at & 63).astype(U))
    return np.split(flat.view(np.int64), first[1:-1])


def _differ(a: str, b: str):
    """How many bits two sketches differ in. A sketch of twice the length folds onto itself; others can't be compared: 0."""
    x, y = F.col(f"{a}.sketch"), F.col(f"{b}.sketch")

    def folded(s, n):
        return F.zip_with(F.slice(s, F.lit(1), n), F.slice(s, n + 1, n), lambda u, v: u.bitwiseXOR(v))

    def count(u, v):
        return F.aggregate(F.zip_with(u, v, lambda i, j: F.bit_count(i.bitwiseXOR(j)).cast("int")), F.lit(0), lambda n, k: n + k)

    return F.when(F.size(x) == F.size(y), count(x, y)).when(F.size(x) == 2 * F.size(y), count(folded(x, F.size(y)), y)).when(F.size(y) == 2 * F.size(x), count(x, folded(y, F.size(x)))).otherwise(0)


def _fold(sketch: str, j: int):
    """One of the four words of a sketch folded to 256 bits."""
    return F.aggregate(F.filter(sketch, lambda x, i: i % 4 == j), F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x))


def _sets(texts, n: int):
    raw = [utf8(t) for t in texts]
    for part in groups([len(r) for r in raw], BATCH_BYTES):
        own = raw[part]
        hashes, owner, _, _ = words(own, PLAIN_WORD)
        owner, hashes = shingles(hashes, owner, len(own), n)
        yield part, owner, hashes, np.bincount(owner, minlength=len(own))


def _keys(hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of each set's own hash."""
    first = np.r_[0, np.cumsum(sizes)]
    with np.errstate(over="ignore"):
        sums = [np.r_[U(0), np.cumsum(mixed(hashes + U(c)))] for c in (1, 2)]
        ha, hb = ((s[first[1:]] - s[first[:-1]]).view(np.int64) for s in sums)
    return ha, hb


class _Seen:
    """Which sets a task meets for the first time; copies are passed over. A bounded memory: forgetting costs repeats only."""

    def __init__(self, most: int = 200_000):
        self.sets, self.most = set(), most

    def new(self, ha, hb, sizes) -> np.ndarray:
        if len(self.sets) > self.most:
            self.sets.clear()
        out = np.zeros(len(sizes), bool)
        for i, key in enumerate(zip(ha.tolist(), hb.tolist())):
            if sizes[i] and key not in self.sets:
                self.sets.add(key)
                out[i] = True
        return out


def row_hash() -> Column:
    """A key of a row's doc_id and text, which a table and the results about it have in common."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_hash().alias("k"), "text")


def hashed(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, k, n_shingles, ha, hb (the set's hash) of all rows; sketches of the first row of each set within a task."""

    def work():
        seen = _Seen()

        def each(texts):
            for part, owner, hashes, sizes in _sets(texts, n):
                ha, hb = _keys(hashes, sizes)
                new = seen.new(ha, hb, sizes)
                keep = new[owner]
                sketches = odd_sketches(owner[keep], hashes[keep], np.where(new, sizes, 0))
                yield part, {"n_shingles": sizes, "ha": ha, "hb": hb, "sketch": [r if k else None for r, k in zip(sketches, new)]}

        return each

    small_batches(docs.sparkSession)
    return map_texts(_rows(docs), ["doc_id", "k"], "n_shingles long, ha long, hb long, sketch array<long>", work)


def marks(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """ha, signature: the signatures of each set, once a task."""

    def work():
        seen = _Seen()

        def each(texts):
            for part, owner, hashes, sizes in _sets(texts, n):
                ha, hb = _keys(hashes, sizes)
                new = seen.new(ha, hb, sizes)
                keep = new[owner]
                at, sign = signatures(owner[keep], hashes[keep], np.where(new, sizes, 0), percent)
                order = np.argsort(at, kind="stable")
                cut = np.searchsorted(at[order], np.arange(1, len(sizes)))
                yield part, {"ha": ha, "signatures": np.split(sign[order], cut)}

        return each

    small_batches(docs.sparkSession)
    return map_texts(docs.select("text"), [], "ha long, signatures array<long>", work).select("ha", F.explode("signatures").alias("signature"))


def linked(pairs: DataFrame, firsts: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) of sets that are alike enough. A set with many partners spreads over salts.

    Up to ``FEW`` comparisons (some 20 MB) are broadcast to the texts; more are joined, which shuffles the texts.
    """
    salts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("salts"))
    members = pairs.join(salts, "a").select(F.col("b").alias("node"), F.col("a").alias("centre"), F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("role"))
    centres = salts.select(F.col("a").alias("node"), F.col("a").alias("centre"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"))
    parts = staged(members.union(centres).join(firsts.select("node", "k", "ha"), "node"), "parts")
    small = parts.count() <= FEW  # then the texts stay where they are

    def sets(batches):
        for b in batches:
            k, text = b["k"].to_numpy(), b["text"]
            new = np.r_[True, k[1:] != k[:-1]][: len(k)]
            of = np.cumsum(new) - 1  # a text with several parts comes several times in a row
            text = text[new].tolist()
            for part, owner, hashes, sizes in _sets(text, n):
                first = np.r_[0, np.cumsum(sizes)]
                ha, _ = _keys(hashes, sizes)
                rows = np.flatnonzero((of >= part.start) & (of < part.stop))
                rows = rows[ha[of[rows] - part.start] == b["ha"].to_numpy()[rows]]
                own = [hashes[first[i] : first[i + 1]].tobytes() for i in range(len(sizes))]
                yield b.iloc[rows][["centre", "salt", "role", "node"]].assign(own=[own[i] for i in of[rows] - part.start])

    def compare(batches):
        key, centre = None, np.zeros(0, U)
        for b in batches:
            out = []
            for c, s, role, node, own in zip(b["centre"], b["salt"], b["role"], b["node"], b["own"]):
                mine = np.frombuffer(own, U)
                if role == 0:
                    key, centre = (c, s), mine
                elif (c, s) == key and len(mine) and len(centre):
                    at = np.minimum(np.searchsorted(centre, mine), len(centre) - 1)
                    both = int((centre[at] == mine).sum())
                    if 100 * both >= percent * (len(mine) + len(centre) - both):
                        out.append((c, node))
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    small_batches(docs.sparkSession)
    texts = _rows(docs).select("k", "text").join(F.broadcast(parts) if small else parts, "k")
    spread = texts.mapInPandas(sets, "centre long, salt int, role int, node long, own binary").repartition("centre", "salt").sortWithinPartitions("centre", "salt", "role")
    out = staged(spread.mapInPandas(compare, "a long, b long"), "linked")
    drop(docs.sparkSession, parts)
    return out


def _blocks(open_: DataFrame, n_blocks: Column, other_blocks: Column, own: str, other: str) -> DataFrame:
    """Members dealt to one of ``n_blocks``, once for each block of the other side."""
    return open_.withColumn(own, F.pmod(F.xxhash64("node", F.lit(own)), n_blocks).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), (other_blocks - 1).cast("int"))))


def classes(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, k (``row_hash``), n_shingles, component_id of every row, and its class: a number that linked rows share."""
    spark = docs.sparkSession
    all_rows = staged(hashed(docs, n), "rows")
    w = Window.partitionBy("signature")
    shared = marks(docs, n, percent).withColumn("low", F.min("ha").over(w)).withColumn("high", F.max("ha").over(w)).where("low < high").select("signature", "ha")
    shared = staged(shared, "shared")
    # A set goes by a number, and is read from the row with the smallest key.
    firsts = all_rows.where("n_shingles > 0").groupBy("ha", "hb", "n_shingles").agg(F.min("doc_id").alias("least"), F.min("k").alias("k"), F.count(F.lit(1)).alias("copies"))
    firsts = staged(firsts.withColumn("node", F.monotonically_increasing_id()), "firsts")
    # The set with most copies is the first member of a group: others are most likely to be copies of it.
    grouped = shared.join(firsts.select("ha", "node", "copies"), "ha").select("signature", "node", "copies").distinct()
    grouped = grouped.withColumn("centre", F.min(F.struct((-F.col("copies")).alias("c"), "node")).over(w)["node"]).withColumn("many", F.count(F.lit(1)).over(w)).where("many > 1").select("signature", "node", "centre")
    grouped = staged(grouped, "groups")
    drop(spark, shared)
    # Sizes and sketches of the sets that share a signature: few columns.
    known = firsts.join(grouped.select("node").distinct(), "node", "left_semi").select("node", "ha", "hb", "n_shingles")
    each = all_rows.where("sketch is not null").join(known, ["ha", "hb", "n_shingles"]).groupBy("node").agg(F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
    each = staged(each.select("*", *(_fold("sketch", j).alias(f"fold{j}") for j in range(4))), "sets")

    def may_link(a: str, b: str):
        """Sizes and sketches allow a link. Sketches folded to 256 bits are compared first: that decides most small sets."""
        sizes = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
        room = (100 - percent) * (sizes[0] + sizes[1])
        folded = sum((F.bit_count(F.col(f"{a}.fold{j}").bitwiseXOR(F.col(f"{b}.fold{j}"))) for j in range(4)), F.lit(0))
        return (100 * F.least(*sizes) >= percent * F.greatest(*sizes)) & ((100 + percent) * folded <= room) & ((100 + percent) * _differ(a, b) <= room)

    stars = grouped.where("node <> centre").select("centre", F.col("node").alias("other")).distinct()
    stars = stars.join(each.alias("x"), F.col("centre") == F.col("x.node")).join(each.alias("y"), F.col("other") == F.col("y.node")).where(may_link("x", "y")).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    stars = staged(stars, "stars")
    found = linked(stars, firsts, docs, n, percent)
    home = components(found).withColumnRenamed("node", "n")
    placed = staged(grouped.join(home, F.col("node") == F.col("n"), "left").select("signature", "node", F.coalesce("component", "node").alias("component")), "placed")
    sums = placed.groupBy("signature", "component").agg(F.count(F.lit(1)).alias("c")).groupBy("signature").agg(F.max_by("component", "c").alias("main"), F.sum("c").alias("total"), F.max("c").alias("largest"), F.count(F.lit(1)).alias("n"))
    open_ = staged(placed.join(sums.where("n > 1").drop("n"), "signature").join(each, "node"), "open")
    blocks, others = F.ceil(F.col("total") / BLOCK), F.ceil((F.col("total") - F.col("largest")) / BLOCK)
    x = _blocks(open_, blocks, others, "bx", "by").alias("x")
    y = _blocks(open_.where("component <> main"), others, blocks, "by", "bx").alias("y")
    met = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("signature", "bx", "by")]
    once = (F.col("x.component") == F.col("x.main")) | (F.col("x.node") < F.col("y.node"))
    rest = x.join(y, met[0] & met[1] & met[2] & (F.col("x.component") != F.col("y.component")) & once & may_link("x", "y")).select(F.col("y.node").alias("a"), F.col("x.node").alias("b")).distinct()
    rest = staged(rest.join(stars.union(stars.select("b", "a")), ["a", "b"], "left_anti"), "rest")
    more = linked(rest, firsts, docs, n, percent)
    # The components of the first round stand for its links.
    final = staged(components(more.union(home.select("n", "component"))), "final")
    drop(spark, grouped, each, stars, placed, open_, rest, found, more)
    named = firsts.select("node", "ha", "hb", "n_shingles", "least").join(final, "node", "left").withColumn("class", F.coalesce("component", "node"))
    names = named.where("component is not null").groupBy("component").agg(F.min("least").alias("name"))
    by_set = named.join(names, "component", "left").select("ha", "hb", "n_shingles", "class", F.coalesce("name", "least").alias("component_id"))
    keys = ["ha", "hb", "n_shingles"]
    some = all_rows.where("n_shingles > 0").select("doc_id", "k", *keys).join(by_set, keys).select("doc_id", "k", "n_shingles", "component_id", "class")
    return some.union(all_rows.where("n_shingles = 0").select("doc_id", "k", "n_shingles", "doc_id", F.lit(None).cast("long")))


def near_classes(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links) of every row."""
    return classes(docs, n, percent).select("doc_id", "n_shingles", "component_id")


def op2(spark, sf_dir: str) -> DataFrame:
    return near_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=4, percent=85)


def brute_force(rows: list[tuple], n: int, percent: int) -> list[tuple]:
    """(doc_id, n_shingles, component_id) by comparing all pairs; for tests."""
    import re

    word = re.compile(r"[^\x20\x09-\x0D]+")
    lower = {c: c + 32 for c in range(65, 91)}
    sets = []
    for _, t in rows:
        w = word.findall(t.translate(lower)) if isinstance(t, str) else []
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[top(i)] = top(j)
    low: dict = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[top(i)] = min(low.get(top(i), d), d)
    return [(d, len(s), low.get(top(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))]
