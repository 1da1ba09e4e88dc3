"""SimHash fingerprints in DataFrame operations only.

Terms are the ``words``-word shingles of the lower-cased text (a shorter text is one term), weighted by how often they occur.
Each term's 128-bit hash votes for or against each bit; ties clear it. Votes are counted two bits a sum, in lanes of 32 bits,
so no term vector is ever gathered. ``within_radius`` finds fingerprints by block tables; the radius of 29 bits takes in texts with
a Jaccard similarity of 0.8.

Null and empty texts, and texts of blanks only, have the fingerprint of zeros. Equal texts have equal fingerprints. Rows that
repeat a doc_id stand next to each other, ordered by text; a null doc_id comes first. Other columns are ignored; an empty table
gives an empty result.
"""

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._ranges import bounds_of, range_index
from ._store import staged

WORDS, BUCKET_ROWS, MOST_BUCKETS = 5, 2000, 100_000
LANES = 0x0000000100000001
HALF = 32
BITS = 128
#: A Jaccard similarity of 0.8 between texts of equal length is an angle that flips 19.4 of 128 bits, give or take 4.1.
RADIUS, FLIPS, MEMBERS = 29, 2, 4096


def terms(text: str, words: int = WORDS) -> Column:
    """The 64-bit hashes of a text's shingles, repeats included."""
    parts = ", ".join(f"get(x.w, i + {k})" for k in range(words))
    return F.expr(
        f"transform(array(named_struct('w', array_remove(split(lower({text}), '[\\\\x20\\\\x09-\\\\x0D]+'), ''))),"
        f" x -> if(size(x.w) = 0, cast(array() as array<bigint>), transform(sequence(0, greatest(size(x.w) - {words}, 0)), i -> xxhash64({parts}))))[0]"
    )


def _votes(h: Column) -> list[Column]:
    """64 sums that hold the votes of 128 bits."""
    return [F.sum(F.shiftrightunsigned(x, b).bitwiseAND(F.lit(LANES))).alias(f"{name}{b}") for name, x in (("a", h), ("b", F.when(h.isNotNull(), F.xxhash64(h)))) for b in range(HALF)]


def _decide(name: str, n: str) -> Column:
    """64 bits from their votes among ``n`` terms."""
    out = F.lit(0).cast("long")
    for b in range(HALF):
        for lane in (0, 32):
            count = F.shiftrightunsigned(F.col(f"{name}{b}"), lane).bitwiseAND(F.lit(0xFFFFFFFF))
            bit = 1 << (b + lane)
            out = out.bitwiseOR(F.when(2 * count > F.col(n), F.lit(bit - (1 << 64) if bit >> 63 else bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def fingerprints(rows: DataFrame, keys: list[str], hashes: str) -> DataFrame:
    """``keys`` with the fingerprint's halves fa and fb. Rows must be unique by ``keys``; nothing is shuffled if they already
    stand together by one of the keys."""
    voted = rows.select(*keys, F.explode_outer(hashes).alias("h")).groupBy(*keys).agg(F.count("h").alias("n"), *_votes(F.col("h")))
    return voted.select(*keys, F.coalesce(_decide("a", "n"), F.lit(0)).alias("fa"), F.coalesce(_decide("b", "n"), F.lit(0)).alias("fb"))


def as_text(fa: str, fb: str) -> Column:
    return F.lower(F.concat(*(F.lpad(F.hex(c), 16, "0") for c in (fa, fb))))


def likeness(fa: str, fb: str, ga: str, gb: str) -> Column:
    """Share of equal bits."""
    return 1 - (F.bit_count(F.col(fa).bitwiseXOR(F.col(ga))) + F.bit_count(F.col(fb).bitwiseXOR(F.col(gb)))) / F.lit(float(BITS))


def with_next(docs: DataFrame) -> DataFrame:
    """bucket, guest, place, doc_id, text, next_text: each document beside the next in ascending doc_id, the last beside the first.

    Ranges of doc_id (quantiles; their number is bounded) are buckets. The first document of each bucket is also a guest at the
    end of the bucket before it, so that no window spans buckets.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("key"), F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = docs.count()
    buckets = min(MOST_BUCKETS, max(1, n // BUCKET_ROWS))
    bucket = range_index(F.col("key"), bounds_of(rows, "key", buckets))
    ids = rows.select("key").withColumn("bucket", bucket)
    order = Window.orderBy("bucket")  # a row a bucket
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = ids.groupBy("bucket").agg(F.min("key").alias("key")).select("key", F.coalesce(F.lag("bucket").over(order), F.max("bucket").over(whole)).alias("bucket"))
    at_home = rows.withColumn("bucket", bucket).withColumn("guest", F.lit(0))
    guests = rows.join(F.broadcast(firsts), "key").select("key", "doc_id", "text", "bucket", F.lit(1).alias("guest"))
    w = Window.partitionBy("bucket").orderBy("guest", "key", "text")
    return at_home.unionByName(guests).select("bucket", "guest", "doc_id", "text", F.row_number().over(w).alias("place"), F.lead("text").over(w).alias("next_text"))


def edited_pairs(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Each text's fingerprint beside that of its edited text and of the next text."""
    half = "cast(floor(length(text) / 2) as int)"
    rows = with_next(docs).withColumn("n_chars", F.length("text").cast("long")).withColumn(
        "edited", F.expr(f"if(guest = 1, '', concat(substring(text, 1, length(text) - {half}), substring(next_text, 1, {half})))")
    )
    keys = ["bucket", "place", "guest", "doc_id", "n_chars", "edited_sha256"]
    both = rows.select(*keys[:-1], F.sha2("edited", 256).alias("edited_sha256"), F.explode(F.array(F.struct(F.lit(0).alias("which"), terms("text", words).alias("h")), F.struct(F.lit(1).alias("which"), terms("edited", words).alias("h")))).alias("t"))
    prints = fingerprints(both.select(*keys, F.col("t.which").alias("which"), F.col("t.h").alias("h")), [*keys, "which"], "h")
    pick = lambda which, c: F.max(F.when(F.col("which") == which, F.col(c)))
    wide = prints.groupBy(*keys).agg(pick(0, "fa").alias("fa"), pick(0, "fb").alias("fb"), pick(1, "fa").alias("ea"), pick(1, "fb").alias("eb"))
    w = Window.partitionBy("bucket").orderBy("place")
    return (
        wide.withColumn("na", F.lead("fa").over(w)).withColumn("nb", F.lead("fb").over(w)).where("guest = 0")
        .select("doc_id", "n_chars", "edited_sha256", "fa", "fb", as_text("fa", "fb").alias("fingerprint"), as_text("ea", "eb").alias("edited_fingerprint"), likeness("fa", "fb", "ea", "eb").alias("near_edited"), likeness("fa", "fb", "na", "nb").alias("near_next"))
    )


def _blocks(radius: int) -> list[tuple[int, int, int]]:
    """(low bit, width, flips) of blocks such that two fingerprints within the radius differ in at most ``flips`` bits of one."""
    n = -(-(radius + 1) // (FLIPS + 1))
    edges = [BITS * i // n for i in range(n + 1)]
    spare = radius + 1 - n
    return [(a, z - a, spare // n + (i < spare % n)) for i, (a, z) in enumerate(zip(edges, edges[1:]))]


def _signed(x: int) -> Column:
    return F.lit(x - (1 << 64) if x >> 63 else x).cast("long")


def _tables(prints: DataFrame, radius: int, flipped: bool, *kept: str) -> DataFrame:
    """fa, fb, ``kept``, t, k: each fingerprint under the value k of each block t; if ``flipped``, also under all values that
    differ from it in as many bits as the block allows."""
    entries = []
    for t, (low, width, flips) in enumerate(_blocks(radius)):
        fa, fb = F.col("fa"), F.col("fb")
        if low >= 64:
            value = F.shiftrightunsigned(fb, low - 64)
        elif low + width <= 64:
            value = F.shiftrightunsigned(fa, low)
        else:
            value = F.shiftrightunsigned(fa, low).bitwiseOR(F.shiftleft(fb, 64 - low))
        changes = [sum(1 << b for b in bits) for d in range(flips + 1) for bits in combinations(range(width), d)]
        changes = F.expr(f"array({', '.join(f"bigint('{x - (1 << 64) if x >> 63 else x}')" for x in changes)})")
        entries.append(F.struct(F.lit(t).alias("t"), value.bitwiseAND(_signed((1 << width) - 1)).alias("k"), *([changes.alias("changes")] if flipped else [])))
    rows = prints.select("fa", "fb", *kept, F.explode(F.array(*entries)).alias("e"))
    if not flipped:
        return rows.select("fa", "fb", *kept, "e.t", "e.k")
    return rows.select("fa", "fb", *kept, "e.t", "e.k", F.explode("e.changes").alias("change")).select("fa", "fb", *kept, "t", F.col("k").bitwiseXOR(F.col("change")).alias("k"))


def _distance(q: Column, p: Column, low: int = 0, width: int = BITS) -> Column:
    """Differing bits among ``width`` bits."""
    mask = ((1 << width) - 1) << low
    counts = [F.bit_count(q[c].bitwiseXOR(p[c]).bitwiseAND(_signed(m))) for c, m in (("fa", mask % 2**64), ("fb", mask >> 64)) if m]
    return counts[0] + counts[1] if len(counts) > 1 else counts[0]


def _meets_first(q: Column, p: Column, t: Column, radius: int) -> Column:
    """Within the radius, and in no table before ``t``: a pair that meets in several tables counts in one."""
    found = _distance(q, p) <= radius
    for i, (low, width, flips) in enumerate(_blocks(radius)[:-1]):
        found = found & ((t <= i) | (_distance(q, p, low, width) > flips))
    return found


def _met(queries: DataFrame, prints: DataFrame, radius: int, *kept: str) -> DataFrame:
    """qa, qb, pa, pb and ``kept`` of the fingerprints: each distinct query beside those within the radius, once each.

    The 128 bits fall into blocks. Two fingerprints within the radius differ in at most ``FLIPS`` bits of one of them, so they
    meet in its table, where a query looks up all such values. A hash join on one number (block, value, part) compares them as its
    condition, in compiled code, so no row is made for a pair that is not near. Values with more than ``MEMBERS`` fingerprints, of a
    family of near-equal texts, are dealt to parts by hash, and a query visits all parts.
    """
    homes = _tables(prints.select("fa", "fb", *kept), radius, False, *kept)
    parts = F.broadcast(homes.groupBy("t", "k").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("parts")).where("parts > 1"))  # at most all values of all blocks
    part = F.pmod(F.xxhash64("fa", "fb"), F.coalesce("parts", F.lit(1)))
    one = max(width for _, width, _ in _blocks(radius)) <= 32  # else block, value and part are columns of their own

    def names(part, name):
        number = F.shiftleft(part.cast("long"), 40).bitwiseOR(F.shiftleft(F.col("t").cast("long"), 32)).bitwiseOR(F.col("k"))
        return [number.alias(name)] if one else [F.col("t").alias(f"{name}_t"), F.col("k").alias(f"{name}_k"), part.cast("int").alias(f"{name}_part")]

    there = homes.join(parts, ["t", "k"], "left").select(*names(part, "there"), F.col("fa").alias("pa"), F.col("fb").alias("pb"), *kept)
    asked = _tables(queries.select("fa", "fb").distinct(), radius, True).join(parts, ["t", "k"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    asked = asked.select(*names(F.col("part"), "here"), "t", F.col("fa").alias("qa"), F.col("fb").alias("qb"))
    q, p = ({"fa": F.col(f"{x}a"), "fb": F.col(f"{x}b")} for x in "qp")
    met = _meets_first(q, p, F.col("t"), radius)
    for end in ("",) if one else ("_t", "_k", "_part"):
        met = (F.col(f"here{end}") == F.col(f"there{end}")) & met
    return asked.join(there.hint("shuffle_hash"), met).select("qa", "qb", "pa", "pb", *kept)


def near_prints(queries: DataFrame, prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """All (qa, qb, pa, pb, distance) of distinct fingerprints of two tables (fa, fb) with a Hamming distance of at most ``radius``."""
    q, p = ({"fa": F.col(f"{x}a"), "fb": F.col(f"{x}b")} for x in "qp")
    return _met(queries, prints.select("fa", "fb").distinct(), radius).withColumn("distance", _distance(q, p))


def near_counts(queries: DataFrame, prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fa, fb, k: the sum of n over ``prints`` (distinct fa, fb, with n) within the radius of each distinct query."""
    return _met(queries, prints, radius, "n").groupBy(F.col("qa").alias("fa"), F.col("qb").alias("fb")).agg(F.sum("n").alias("k"))


def within_radius(queries: DataFrame, prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """All (query, found, distance) of two tables (id, fa, fb); equal fingerprints meet through their distinct values."""
    mine, theirs = queries.select(F.col("id").alias("query"), F.col("fa").alias("qa"), F.col("fb").alias("qb")), prints.select(F.col("id").alias("found"), F.col("fa").alias("pa"), F.col("fb").alias("pb"))
    return near_prints(queries, prints, radius).join(mine, ["qa", "qb"]).join(theirs, ["pa", "pb"]).select("query", "found", "distance")


def op1(spark, sf_dir: str) -> DataFrame:
    """Also n_near: how many documents have a fingerprint within the radius, for the query set of ids divisible by 20."""
    rows = staged(edited_pairs(spark.read.parquet(f"{sf_dir}/documents.parquet")), "prints")
    asked = F.col("doc_id") % 20 == 0
    prints = rows.groupBy("fa", "fb").agg(F.count(F.lit(1)).alias("n"))
    counts = near_counts(rows.where(asked), prints)
    return rows.join(counts, ["fa", "fb"], "left").select(*(c for c in rows.columns if c not in ("fa", "fb")), F.when(asked, F.col("k")).alias("n_near"))
