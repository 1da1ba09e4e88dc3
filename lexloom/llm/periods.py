r"""Periodic runs of words: stretches that repeat themselves with some lag.

A run is a stretch of consecutive words with smallest period q, at least ``max(12, 2 * q)`` words long, that no neighbouring word
extends. The scan compares the word ids of a text with themselves at every lag up to half the text and measures stretches of equal
places. A stretch that counts has at least ``max(q, 12 - q)`` equal places in a row, so one of every so many comparisons of the lag is
inside it: only those are made for all, some n * ln(n) instead of n * n / 2, and around each that holds the whole stretch is measured
by blocks. A stretch whose period divides into a smaller one covers the same words as the run of the smaller one, which alone stays.

Spark deals out texts; those of more than ``long_bytes`` are dealt as ranges of their lags, and what the ranges find meets again once
a text. A text of n words holds fewer than n runs.

Null and empty texts have no words, no runs and an empty collapsed text. Rows are told apart by their place, so repeated rows and
repeated or null doc_ids give a row each; other columns are ignored; an empty table gives an empty result.
"""

import hashlib
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import arrow_schema, small_batches

LEAST = 12
TABLED, HEAD = 1 << 14, 256
FOUND = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary"
_table: list = []


def _probes() -> tuple[np.ndarray, np.ndarray]:
    """The comparisons (place, place + lag) of texts up to TABLED words, by their second place: those of a shorter text come first."""
    if not _table:
        lags = np.arange(1, TABLED // 2 + 1)
        steps = np.maximum(lags, LEAST - lags)
        counts = np.maximum(0, (TABLED - lags) // steps)
        lag, step = np.repeat(lags, counts), np.repeat(steps, counts)
        turn = np.arange(len(lag)) - np.repeat(np.cumsum(counts) - counts, counts)
        place = (turn + 1) * step - 1
        order = np.argsort(place + lag, kind="stable")
        _table[:] = [place[order].astype(np.int32), (place + lag)[order].astype(np.int32)]
    return _table[0], _table[1]


def _equal_places(x: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """(lag, place) of the comparisons that hold, by lag then place, for lags from ``lo`` to below ``hi`` (and, to know multiples of
    small periods, for those up to HEAD)."""
    n = len(x)
    if n <= TABLED and lo == 1 and hi > n // 2:
        first, second = _probes()
        m = np.searchsorted(second, n)
        hit = np.flatnonzero(x[first[:m]] == x[second[:m]])
        place = first[hit].astype(np.int64)
        lag = second[hit] - place
        order = np.argsort(lag, kind="stable")
        return lag[order], place[order]
    lags, places = [], []
    for q in [*range(1, min(HEAD, lo)), *range(lo, hi)]:
        step = max(q, LEAST - q)
        hit = np.flatnonzero(x[step - 1 : n - q : step] == x[step - 1 + q :: step])
        if len(hit):
            lags.append(np.full(len(hit), q))
            places.append(hit * step + step - 1)
    none = np.zeros(0, np.int64)
    return (np.concatenate(lags), np.concatenate(places)) if lags else (none, none)


def _dense(x: np.ndarray, lag: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Which places stand among LEAST / 2 equal ones in a row, the least that a run of any period has."""
    count = np.ones(len(place), np.int64)
    for step in (1, -1):
        own, at = np.arange(len(place)), place
        for _ in range(LEAST // 2 - 1):
            at = at + step
            inside = (at >= 0) & (at + lag[own] < len(x))
            own, at = own[inside], at[inside]
            same = x[at] == x[at + lag[own]]
            own, at = own[same], at[same]
            if not len(own):
                break
            count[own] += 1
    return count >= LEAST // 2


def _stretch(x: np.ndarray, lag: int, place: int) -> tuple[int, int]:
    """The first place of the equal ones around ``place``, and the first after them."""
    end, size = place + 1, 32
    while end < len(x) - lag:
        other = x[end : min(end + size, len(x) - lag)] != x[end + lag : end + lag + size]
        if other.any():
            end += int(other.argmax())
            break
        end, size = end + len(other), size * 2
    start, size = place, 32
    while start > 0:
        a = max(0, start - size)
        other = (x[a:start] != x[a + lag : start + lag])[::-1]
        if other.any():
            start -= int(other.argmax())
            break
        start, size = a, size * 2
    return start, end


def scan(x: np.ndarray, lo: int = 1, hi: int | None = None) -> dict:
    """{(start, end): smallest period} of the runs whose lag is from ``lo`` to below ``hi``."""
    lag, place = _equal_places(x, lo, len(x) // 2 + 1 if hi is None else hi)
    keep = _dense(x, lag, place)
    lag, place = lag[keep], place[keep]
    out: dict = {}
    while len(lag):
        q = int(lag[0])
        start, last = _stretch(x, q, int(place[0]))
        end = last + q
        gone = (lag == q) & (place < last)
        if last - start >= max(q, LEAST - q):
            out.setdefault((start, end), q)
            # Multiples of a run's period hold all over it, and say nothing new unless they could reach beyond it.
            gone |= (lag % q == 0) & (place >= start) & (place + lag < end) & (end - start >= lag + q)
        lag, place = lag[~gone], place[~gone]
    return out


def ids_of(words: list) -> np.ndarray:
    """Word ids: equal words, equal ids."""
    known: dict = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words))


def collapsed(words: list, found: dict) -> bytes:
    """The words without those that a run holds after its first period."""
    keep = np.ones(len(words), bool)
    for (start, end), q in found.items():
        keep[start + q : end] = False
    return b" ".join(words if keep.all() else [words[i] for i in np.flatnonzero(keep)])


def _result(schema, doc_ids, texts, all_found):
    import pyarrow as pa

    runs = [[{"start": s, "length": e - s, "period": q} for (s, e), q in sorted(found.items(), key=lambda f: (f[0][0], f[1]))] for found in all_found]
    columns = [doc_ids, [len(w) for w in texts], runs, [collapsed(w, f) for w, f in zip(texts, all_found)]]
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema)], schema=schema)


def runs(docs: DataFrame, prepare=None, long_bytes: int = 1 << 20) -> DataFrame:
    """doc_id, n_words, runs (by start, then period), collapsed (UTF-8) of each row of ``docs`` (doc_id, text).

    Words are ``[^\\x20\\x09-\\x0D]+``. ``prepare`` may change a row's words: it is called with doc_id and the list of words in UTF-8.
    """
    prepare = prepare or (lambda doc_id, words: words)
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    size, schema = F.octet_length("text"), arrow_schema(FOUND)

    def whole(batches):
        for b in batches:
            ids = b["doc_id"].to_pylist()
            texts = [prepare(i, t.split()) for i, t in zip(ids, b["text"].to_pylist())]
            yield _result(schema, ids, texts, [scan(ids_of(w)) for w in texts])

    def part(batches):
        import pyarrow as pa

        for b in batches:
            for row in b.to_pylist():
                x = ids_of(prepare(row["doc_id"], row["text"].split()))
                half, r, n = len(x) // 2, row["part"], row["parts"]
                found = scan(x, 1 + half * r // n, 1 + half * (r + 1) // n)
                packed = np.array([(s, e, q) for (s, e), q in found.items()], np.int64).tobytes()
                yield pa.RecordBatch.from_pydict({"row": [row["row"]], "doc_id": pa.array([row["doc_id"]], pa.int64()), "text": pa.array([row["text"] if r == 0 else None], pa.binary()), "found": [packed]})

    def joined(batches):
        for b in batches:
            for row in b.to_pylist():
                found: dict = {}
                for packed in row["found"]:
                    for s, e, q in np.frombuffer(packed, np.int64).reshape(-1, 3).tolist():
                        found[s, e] = min(q, found.get((s, e), q))
                yield _result(schema, [row["doc_id"]], [prepare(row["doc_id"], row["text"].split())], [found])

    short = rows.where(size <= long_bytes).mapInArrow(whole, FOUND)
    # Ids of rows come from the scan, before any shuffle, so a task that runs again gives the same.
    large = rows.where(size > long_bytes).withColumn("row", F.monotonically_increasing_id()).withColumn("parts", F.ceil(size / long_bytes).cast("int"))
    ranges = large.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).repartition("row", "part")
    met = ranges.mapInArrow(part, "row long, doc_id long, text binary, found binary").groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("text").alias("text"), F.collect_list("found").alias("found"))
    return short.union(met.mapInArrow(joined, FOUND))


def repeated(doc_id, words: list) -> list:
    """The words of a tenth of the documents made periodic from some place on."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def digests(found: DataFrame) -> DataFrame:
    """One row a document: its runs counted, the greatest described, and hashes of all of them and of the collapsed text."""
    best = F.get(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p")))), F.lit(0))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    return found.withColumn("b", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("b.s").alias("start"), (-F.col("b.l")).alias("length"), F.col("b.p").alias("period"),
        F.expr("(-1000 * b.l) div b.p").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return digests(runs(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), repeated))


def plain(doc_id, text: str | None) -> tuple:
    """What ``op12`` returns for a document, by definition: every stretch, tried with every period."""
    w = repeated(doc_id, (text or "").encode("utf-8", "surrogatepass").split())
    n, found = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(LEAST, 2 * q) and not any(all(w[k] == w[k + r] for k in range(i, j + q - r)) for r in range(1, q)):
                found.append((i, j + q - i, q))
            i = max(j, i + 1)
    found.sort(key=lambda f: (f[0], f[2]))
    dropped = {k for s, m, q in found for k in range(s + q, s + m)}
    s, m, q = min(found, key=lambda f: (-f[1], f[0], f[2])) if found else (None, None, None)
    digest = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(found), s, m, q, None if q is None else 1000 * m // q, digest("".join(f"{a},{b},{c}\n" for a, b, c in found).encode()), digest(b" ".join(x for k, x in enumerate(w) if k not in dropped)))
