"""Benchmark decontamination with an FM-index per training shard.

A shard is a batch of whole documents as a sequence of word symbols. Words outside the benchmark's vocabulary, and words with no
neighbour with which they form a word pair of the benchmark, cannot lie in an occurrence; they shrink to one separator symbol.
Over the rest each task builds a suffix array, its Burrows-Wheeler transform, a wavelet matrix for ranks and sampled suffix
positions; backward search runs for all windows at once, occurrences are located from the sampled positions, and overlapping
hits merge into spans of bytes.

Windows are ``window`` consecutive words of an item; an item of fewer words, but not none, is one window. A benchmark is the stated
query set. It is read in blocks of at most ``block_items`` items and ``block_bytes`` of text; one block at a time is broadcast, all
documents are searched for it, and what was found goes on in the rows to the next block, so neither driver nor tasks hold more than
one block. Hits of all blocks merge.

Null and empty texts have no words and no hits; items without words are never found; rows with equal item_id count as one
item; an item without item_id is searched for, but can't be named; repeated documents are searched each; other columns are kept
unless a result column has their name; empty tables give empty results (an empty benchmark: nothing is hit).
"""

import functools
import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import map_texts, small_batches, staged
from ._text import ALNUM_WORD, U, groups, utf8, words

WINDOW, BLOCK_ITEMS, BLOCK_BYTES, SHARD_BYTES, SAMPLE = 10, 20_000, 16_000_000, 2_000_000, 8


class FMIndex:
    """Full-text index of a sequence of symbols below ``sigma``; symbol 0 is reserved for its end."""

    def __init__(self, seq: np.ndarray, sigma: int, sample: int = SAMPLE):
        seq = np.r_[np.asarray(seq, np.int64), 0]
        n, self.n, self.sample = len(seq), len(seq), sample
        order, rank, k = self._sorted(seq), None, 1
        rank = self._names(seq[order], order)
        while rank.max() < n - 1:  # prefix doubling
            key = rank * (n + 1) + np.r_[rank[k:] + 1, np.zeros(min(k, n), np.int64)][:n]
            order = self._sorted(key)
            rank = self._names(key[order], order)
            k *= 2
        bwt = seq[order - 1]
        self.before = np.zeros(sigma + 1, np.int64)
        np.cumsum(np.bincount(seq, minlength=sigma), out=self.before[1:])
        self.bits = max(1, (sigma - 1).bit_length())
        self.ones, self.zeros, level = [], [], bwt
        for b in range(self.bits - 1, -1, -1):
            bit = (level >> b) & 1
            ones = np.zeros(n + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(n - int(ones[-1]))
            level = np.concatenate([level[bit == 0], level[bit == 1]])
        self.bwt = bwt
        marked = order % sample == 0
        self.marked, self.positions = marked, order[marked]
        self.mark_rank = np.cumsum(marked) - 1

    @staticmethod
    def _sorted(key):
        return np.argsort(key, kind="stable")

    @staticmethod
    def _names(ordered, order):
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(np.r_[False, ordered[1:] != ordered[:-1]])
        return rank

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place of the transform."""
        low, high = np.zeros_like(at), at
        for b, ones, zeros in zip(range(self.bits - 1, -1, -1), self.ones, self.zeros):
            up = ((symbol >> b) & 1).astype(bool)
            l1, h1 = ones[low], ones[high]
            low, high = np.where(up, zeros + l1, low - l1), np.where(up, zeros + h1, high - h1)
        return high - low

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of equally long patterns, one a row: the range of suffixes of each."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for c in patterns.T[::-1]:
            s = c[live]
            low[live], high[live] = self.before[s] + self.rank(s, low[live]), self.before[s] + self.rank(s, high[live])
            live = live[high[live] > low[live]]
        found = np.zeros(len(patterns), bool)
        found[live] = True
        return np.where(found, low, 0), np.where(found, high, 0)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, by walking back to a sampled one."""
        rows, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            r = rows[open_]
            done = self.marked[r]
            out[open_[done]] = self.positions[self.mark_rank[r[done]]] + steps[open_[done]]
            open_, r = open_[~done], r[~done]
            s = self.bwt[r]
            rows[open_] = self.before[s] + self.rank(s, r)
            steps[open_] += 1
        return out


class Phrases:
    """The windows of benchmark items as symbols over their own vocabulary."""

    def __init__(self, items: list[tuple], window: int):
        hashes, owner, _, _ = words([utf8(t) for _, t in items], ALNUM_WORD)
        self.vocabulary = np.unique(hashes)
        symbol = np.searchsorted(self.vocabulary, hashes) + 2
        self.sigma = len(self.vocabulary) + 2
        self.names = sorted({i for i, _ in items}, key=str)  # None: an item that can't be named
        place = {x: k for k, x in enumerate(self.names)}
        by_length: dict[int, dict[bytes, set[int]]] = {}
        for k, (name, _) in enumerate(items):
            own = symbol[owner == k] if len(items) < 64 else symbol[np.searchsorted(owner, k) : np.searchsorted(owner, k, "right")]
            n = min(window, len(own))
            for i in range(len(own) - n + 1 if n else 0):
                by_length.setdefault(n, {}).setdefault(own[i : i + n].tobytes(), set()).add(place[name])
        self.windows = []
        for n, found in sorted(by_length.items()):
            patterns = np.frombuffer(b"".join(found), np.int64).reshape(-1, n)
            sizes = np.array([len(v) for v in found.values()])
            self.windows.append((patterns, np.r_[0, np.cumsum(sizes)], np.concatenate([sorted(v) for v in found.values()])))
        pairs = [p[:, :-1].ravel() * self.sigma + p[:, 1:].ravel() for p, _, _ in self.windows]
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        self.singles = np.unique(np.concatenate([p.ravel() for p, _, _ in self.windows if p.shape[1] == 1] or [np.zeros(0, np.int64)]))

    @staticmethod
    def _among(values, table):
        if not len(table):
            return np.zeros(len(values), bool)
        return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values

    def find(self, hashes: np.ndarray, owner: np.ndarray):
        """(hit words as flags, owner of each found item, place of each found item) in a shard of words."""
        n = len(hashes)
        hit, none = np.zeros(n, bool), np.zeros(0, np.int64)
        if not n or not len(self.vocabulary):
            return hit, none, none
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        symbol = np.where(self.vocabulary[at] == hashes, at + 2, 0)
        pair = (symbol[:-1] > 0) & (symbol[1:] > 0) & (owner[:-1] == owner[1:])
        where = np.flatnonzero(pair)
        joined = np.zeros(n + 1, bool)  # joined[i]: words i - 1 and i may stand in one window
        joined[1:-1][where[self._among(symbol[where] * self.sigma + symbol[where + 1], self.pairs)]] = True
        keep = joined[:-1] | joined[1:] | self._among(symbol, self.singles)
        kept = np.flatnonzero(keep)
        if not len(kept):
            return hit, none, none
        # A separator stands before each word that cannot follow the one before it.
        cut = ~joined[kept]
        to = np.arange(len(kept)) + np.cumsum(cut)
        seq = np.ones(len(kept) + int(cut.sum()), np.int64)
        seq[to] = symbol[kept]
        word_at = np.full(len(seq), -1, np.int64)
        word_at[to] = kept
        index = FMIndex(seq, self.sigma)
        cover = np.zeros(n + 1, np.int64)
        owners, items = [none], [none]
        for patterns, first, names in self.windows:
            low, high = index.search(patterns)
            count = high - low
            if not count.sum():
                continue
            rows = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
            place = word_at[index.locate(rows)]
            np.add.at(cover, place, 1)
            np.add.at(cover, place + patterns.shape[1], -1)
            which = np.repeat(np.arange(len(patterns)), count)
            each = first[which + 1] - first[which]
            owners.append(np.repeat(owner[place], each))
            items.append(names[np.repeat(first[which] - (np.cumsum(each) - each), each) + np.arange(each.sum())])
        return np.cumsum(cover)[:-1] > 0, np.concatenate(owners), np.concatenate(items)


def _runs(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.r_[0, flag.astype(np.int8), 0])
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _blocks(benchmark: DataFrame, block_items: int, block_bytes: int):
    """The items block by block; the driver holds one block, and one partition of the table while it is read."""
    block, size = [], 0
    for r in benchmark.select("item_id", "text").toLocalIterator():
        n = len(r[1] or "")
        if block and (len(block) >= block_items or size + n > block_bytes):
            yield block
            block, size = [], 0
        block.append((r[0], r[1]))
        size += n
    yield block


def _searched(rows: DataFrame, kept: list[str], sent) -> DataFrame:
    """``rows`` (kept columns, text, item_ids, runs) with what one block adds: item_ids and runs (first and last hit word, bytes)."""

    def work():
        def each(texts):
            raw_all = [utf8(t) for t in texts]
            for part in groups([len(r) for r in raw_all], SHARD_BYTES):
                raw = raw_all[part]
                hashes, owner, start, end = words(raw, ALNUM_WORD)
                phrases = sent.value
                hit, owners, places = phrases.find(hashes, owner)
                found: list[set] = [set() for _ in raw]
                for o, p in np.unique(np.c_[owners, places], axis=0) if len(owners) else ():
                    if phrases.names[p] is not None:
                        found[o].add(str(phrases.names[p]))
                runs = [[] for _ in raw]
                first = np.searchsorted(owner, np.arange(len(raw) + 1))
                for o in np.unique(owner[hit]):
                    own = slice(first[o], first[o + 1])
                    a, z = _runs(hit[own])
                    runs[o] = [{"a": int(x), "z": int(y), "start": int(start[own][x]), "end": int(end[own][y - 1])} for x, y in zip(a, z)]
                yield part, {"n_words": np.bincount(owner, minlength=len(raw)), "new_ids": [sorted(x) for x in found], "new_runs": runs}

        return each

    done = map_texts(rows, [*kept, *([] if "text" in kept else ["text"]), "item_ids", "runs"], f"n_words long, new_ids array<string>, new_runs {_RUNS}", work)
    return done.select(*rows.drop("item_ids", "runs", "n_words").columns, "n_words", F.concat("item_ids", "new_ids").alias("item_ids"), F.concat("runs", "new_runs").alias("runs"))


_RUNS = "array<struct<a:int,z:int,start:int,end:int>>"


def _without_runs(rows: DataFrame, kept: list[str]) -> DataFrame:
    """Merge the runs of hit words, and cut them out of the text."""
    merged = F.aggregate(
        F.array_sort("runs"), F.array().cast(_RUNS),
        lambda done, x: F.when((F.size(done) == 0) | (F.element_at(done, -1)["z"] < x["a"]), F.concat(done, F.array(x))).when(F.element_at(done, -1)["z"] >= x["z"], done).otherwise(
            F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["a"].alias("a"), x["z"].alias("z"), F.element_at(done, -1)["start"].alias("start"), x["end"].alias("end"))))
        ),
    )
    raw = F.encode("text", "UTF-8")
    edges = lambda r: F.transform(r, lambda x, i: F.struct(F.when(i == 0, 0).otherwise(F.get(r, i - 1)["end"]).alias("a"), x["start"].alias("z")))
    kept_bytes = F.concat(
        F.aggregate(edges(F.col("runs")), F.unhex(F.lit("")), lambda out, e: F.concat(out, F.substring(raw, e["a"] + 1, e["z"] - e["a"]))), F.substring(raw, F.element_at("runs", -1)["end"] + 1, F.length(raw))
    )
    hit = F.size("runs") > 0
    out = rows.withColumn("runs", F.when(F.size("runs") > 1, merged).otherwise(F.col("runs")))
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda n, x: n + x["z"] - x["a"])
    return out.select(
        *kept, "n_words", n_hit.alias("n_hit"), F.array_sort(F.array_distinct("item_ids")).alias("item_ids"), F.transform("runs", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias("spans"),
        F.when(hit, F.decode(kept_bytes, "UTF-8")).otherwise(F.col("text")).alias("clean_text"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_items: int = BLOCK_ITEMS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents with n_words, n_hit, item_ids (found items, sorted as strings), spans (bytes) and clean_text (without spans)."""
    spark = docs.sparkSession
    small_batches(spark)
    new = ["n_words", "n_hit", "item_ids", "spans", "clean_text"]
    kept = [c for c in docs.columns if c not in new]
    own = {c: f"kept_{i}" for i, c in enumerate(kept)}  # result columns may share a name with a column of the documents
    rows = docs.select(*(F.col(f"`{c}`").alias(x) for c, x in own.items()), "text", F.array().cast("array<string>").alias("item_ids"), F.array().cast(_RUNS).alias("runs"))
    blocks = _blocks(benchmark, block_items, block_bytes)
    block, after = next(blocks), next(blocks, None)
    earlier = []
    while after is not None:  # what a block finds is written, by the hash of the text, and the block given up before the next is sent
        sent = spark.sparkContext.broadcast(Phrases(block, window))
        found = _searched(rows.select("text", "item_ids", "runs"), ["text"], sent).where(F.size("runs") > 0)
        earlier.append(staged(found.select(_text_hash().alias("hash"), "item_ids", "runs"), "searched"))
        sent.destroy()
        block, after = after, next(blocks, None)
    if earlier:
        every = functools.reduce(DataFrame.union, earlier).groupBy("hash", "item_ids", "runs").agg(F.lit(1).alias("one"))  # equal texts, once
        both = every.groupBy("hash").agg(F.flatten(F.collect_list("item_ids")).alias("ids_before"), F.flatten(F.collect_list("runs")).alias("runs_before"))  # a row a block
        hit = rows.withColumn("hash", _text_hash()).join(both, "hash", "left")
        none = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c.removesuffix("_before").replace("ids", "item_ids"))
        rows = hit.select(*own.values(), "text", none("ids_before", "array<string>"), none("runs_before", _RUNS))
    rows = _searched(rows, list(own.values()), spark.sparkContext.broadcast(Phrases(block, window)))
    return _without_runs(rows, list(own.values())).select(*(F.col(x).alias(c) for c, x in own.items()), *new)


def _text_hash():
    return F.sha2("text", 256)


def op6(spark, sf_dir: str) -> DataFrame:
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return decontaminate(docs.select("doc_id", "text"), bench).select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def brute_force(texts: list, items: list[tuple], window: int = WINDOW) -> list[tuple]:
    """(n_words, n_hit, digest) by comparing every window with every place; for tests."""
    import re

    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    cut = lambda t: word.findall(t.translate({c: c + 32 for c in range(65, 91)})) if isinstance(t, str) else []
    out = []
    for t in texts:
        w, hits, names = cut(t), set(), set()
        for name, text in items:
            v = cut(text)
            n = min(window, len(v))
            for j in range(len(v) - n + 1 if n else 0):
                for i in range(len(w) - n + 1):
                    if w[i : i + n] == v[j : j + n]:
                        hits |= set(range(i, i + n))
                        names |= set() if name is None else {str(name)}
        out.append((len(w), len(hits), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()))
    return out
