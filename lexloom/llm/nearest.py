"""Approximate nearest neighbours by largest inner product.

Vectors go to the leaf of their nearest centre, and what is left of them is quantised in blocks of two dimensions to 16 values each,
four bits a block, two blocks a byte. The loss is score-aware: the part of the residual parallel to the vector, which shifts the
largest inner products, weighs ``(d - 1) * t**2 / (1 - t**2)`` times the part across it (t = THRESHOLD). Codes are chosen, and the
values fitted, one block at a time with the others fixed, as the parallel part runs over all blocks.

The model is fitted on a bounded sample of about ``SAMPLE`` vectors, chosen by a hash; every vector is indexed. How many leaves a query
looks into is measured on the sample: so many that ``SHARE`` of the true neighbours of sample queries lie in them.

Search: leaves are cut into blocks of candidates, queries meet the blocks of their leaves as a stream, byte tables of the query's
inner products add up to approximate scores, the ``RERANK`` best of a block, and all within twice the usual error of its k-th best, so
that vectors too alike for their codes are told apart however many there are, are scored exactly in double
precision, and its k best go on, of those below the query's k-th best score in the sample only as many as it takes to have k in all.
So a task holds one block and some queries, however large a leaf or the query set is.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do those without vec_id or with another number
of components than most vectors have (ties: the larger). Rows that repeat a vec_id are vectors of their own: each finds the others.
Other columns are ignored; an empty table gives an empty result; with fewer than k others all are returned.
"""

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import drop, small_batches, staged

SAMPLE, THRESHOLD, SHARE, RERANK, QUERIES = 8192, 0.2, 0.985, 256, 64
_FOUND = "query_row long, query_id long, vec_id long, score double"


@dataclass
class Model:
    dim: int
    centres: np.ndarray  # leaves
    books: list  # 16 values a block
    eta: float
    probes: int
    sample: np.ndarray


def usable(vectors: DataFrame, dim: int | None = None) -> DataFrame:
    e = F.col("embedding")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    out = vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))
    return out if dim is None else out.where(F.size("embedding") == dim)


def _blocks(d: int) -> list[slice]:
    return [slice(i, min(i + 2, d)) for i in range(0, d, 2)]


def _means(x: np.ndarray, k: int, rng, rounds: int = 8) -> np.ndarray:
    """Centres of k clusters."""
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        own = _closest(x, centres)
        n = np.bincount(own, minlength=k)
        sums = np.stack([np.bincount(own, x[:, j], k) for j in range(x.shape[1])], 1)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def _closest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([np.argmin((centres**2).sum(1) - 2 * x[i : i + 4096] @ centres.T, 1) for i in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])


def _codes(rest: np.ndarray, unit: np.ndarray, books: list, eta: float, rounds: int = 2) -> np.ndarray:
    """The codes of residuals: the closest values, then, one block at a time, those of least score-aware loss."""
    cut = _blocks(rest.shape[1])
    codes = np.stack([_closest(rest[:, s], b) for s, b in zip(cut, books)], 1)
    along = sum((unit[:, s] * (rest[:, s] - b[codes[:, m]])).sum(1) for m, (s, b) in enumerate(zip(cut, books)))
    for _ in range(rounds):
        for m, (s, b) in enumerate(zip(cut, books)):
            left = rest[:, None, s] - b[None]
            own = np.einsum("nkw,nw->nk", left, unit[:, s])
            others = along - own[np.arange(len(own)), codes[:, m]]
            codes[:, m] = np.argmin((left**2).sum(2) + (eta - 1) * (others[:, None] + own) ** 2, 1)
            along = others + own[np.arange(len(own)), codes[:, m]]
    return codes


def _fitted(rest: np.ndarray, unit: np.ndarray, eta: float, rng, rounds: int = 3) -> list:
    """The values of each block of least score-aware loss over the sample."""
    cut = _blocks(rest.shape[1])
    books = [_means(rest[:, s], 16, rng) for s in cut]
    for _ in range(rounds):
        codes = _codes(rest, unit, books, eta, 1)
        along = sum((unit[:, s] * (rest[:, s] - b[codes[:, m]])).sum(1) for m, (s, b) in enumerate(zip(cut, books)))
        for m, s in enumerate(cut):
            u, r, b = unit[:, s], rest[:, s], books[m]
            others = along - (u * (r - b[codes[:, m]])).sum(1)
            new = b.copy()
            for j in range(16):
                own = codes[:, m] == j
                if own.any():
                    v = u[own]
                    a = own.sum() * np.eye(v.shape[1]) + (eta - 1) * v.T @ v
                    new[j] = np.linalg.solve(a, r[own].sum(0) + (eta - 1) * v.T @ (others[own] + (v * r[own]).sum(1)))
            books[m] = new
            along = others + (u * (r - new[codes[:, m]])).sum(1)
    return books


def fit(vectors: DataFrame, k: int = 20, seed: int = 7) -> tuple[Model | None, int]:
    """The model, and how many vectors take part; None for a table without any."""
    sizes = usable(vectors).groupBy(F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    if sizes is None:
        return None, 0
    dim, n = sizes["dim"], sizes["n"]
    kept = usable(vectors, dim).where(F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(1 << 30)) < int(min(1.0, SAMPLE / n) * (1 << 30)))
    found = kept.select("embedding").limit(2 * SAMPLE).toArrow()["embedding"].combine_chunks()
    x = np.asarray(found.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)
    rng = np.random.default_rng(seed)
    if not len(x):  # a small table that the hash passed over
        x = np.array([r["embedding"] for r in usable(vectors, dim).limit(SAMPLE).collect()], np.float64)
    every = x
    x = np.unique(x, axis=0)  # in an order of its own, and copies don't outweigh the rest
    leaves = int(np.clip(int(n**0.5 / 8), 1, 1024))
    centres = _means(x, leaves, rng)
    own = _closest(x, centres)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    eta = max(1.0, (dim - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))
    books = _fitted(x - centres[own], unit, eta, rng)
    ask = rng.choice(len(x), min(256, len(x)), replace=False)
    scores = x[ask] @ x.T
    scores[np.arange(len(ask)), ask] = -np.inf
    near = np.argsort(-scores, 1)[:, :k][:, : max(1, len(x) - 1)]
    rank = np.argsort(np.argsort(-(x[ask] @ centres.T), 1), 1)
    needed = np.sort(np.take_along_axis(rank, own[near], 1).ravel())
    probes = int(needed[min(len(needed) - 1, int(SHARE * len(needed)))]) + 1
    return Model(dim, centres.astype(np.float32), [b.astype(np.float32) for b in books], eta, probes, every.astype(np.float32)), n


def _matrix(column, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False)).reshape(-1, dim)


def index(vectors: DataFrame, model: Model) -> DataFrame:
    """row, vec_id, embedding, leaf, codes (a byte for two blocks) of every vector that takes part."""
    given = vectors.sparkSession.sparkContext.broadcast(model)  # bounded: centres, values and sample
    kind = vectors.schema["embedding"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        m = given.value
        for b in batches:
            if not len(b):
                continue
            x = _matrix(b["embedding"], m.dim).astype(np.float64)
            leaf = _closest(x, m.centres.astype(np.float64))
            codes = _codes(x - m.centres[leaf], x / np.linalg.norm(x, axis=1, keepdims=True), m.books, m.eta)
            codes = np.pad(codes, ((0, 0), (0, codes.shape[1] % 2))).astype(np.uint8)
            packed = codes[:, ::2] | codes[:, 1::2] << 4
            yield pa.RecordBatch.from_arrays([b["row"], b["vec_id"], b["embedding"], pa.array(leaf, pa.int32()), pa.array([r.tobytes() for r in packed], pa.binary())], names=["row", "vec_id", "embedding", "leaf", "codes"])

    rows = usable(vectors, model.dim).select(F.monotonically_increasing_id().alias("row"), "vec_id", "embedding")
    return rows.mapInArrow(run, f"row long, vec_id {vectors.schema['vec_id'].dataType.simpleString()}, embedding {kind}, leaf int, codes binary")


def _tables(q: np.ndarray, books: list) -> np.ndarray:
    """(bytes of a code, 256, queries): what each byte adds to the inner product."""
    each = [b @ q[:, s].T for s, b in zip(_blocks(q.shape[1]), books)]
    if len(each) % 2:
        each.append(np.zeros_like(each[0]))
    return np.stack([(low[None, :, :] + high[:, None, :]).reshape(256, -1) for low, high in zip(each[::2], each[1::2])]).astype(np.float32)


class _Block:
    """Candidates of a block in the order of vec_id. Of equal vectors no result holds more than the first k, but for the query itself,
    so k + 1 stay and leave the rest of the exact scoring to others."""

    def __init__(self, parts: list, leaf: int, model: Model, k: int):
        row, ids, x, codes = (np.concatenate(p) for p in zip(*parts))
        order = np.lexsort((row, ids))
        _, group = np.unique(x[order], axis=0, return_inverse=True)
        by = np.argsort(group.ravel(), kind="stable")
        sizes = np.bincount(group.ravel())
        nth = np.arange(len(by)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        order = order[np.sort(by[nth <= k])]
        self.row, self.ids, self.x, self.codes, self.leaf, self.model = row[order], ids[order], x[order], np.ascontiguousarray(codes[order].T), leaf, model
        # How far an approximate score is off, for a query of length 1: what the codes leave out, seen from a direction of its own.
        values = np.concatenate([b[self._nibble(m)] for m, b in enumerate(model.books)], 1)
        self.error = float(np.sqrt((((self.x - model.centres[leaf] - values) ** 2).sum(1)).mean() / model.dim))

    def _nibble(self, m: int) -> np.ndarray:
        return self.codes[m // 2] >> 4 if m % 2 else self.codes[m // 2] & 15

    def best(self, rows: np.ndarray, q: np.ndarray, floors: np.ndarray, least: np.ndarray, k: int):
        """(query, places, scores) of the k best of each query by exact score: those not below its floor, but ``least`` of them."""
        tables = _tables(q.astype(np.float32), self.model.books)
        rough = np.zeros((self.codes.shape[1], len(q)), np.float32)
        for table, code in zip(tables, self.codes):
            rough += table[code]
        rough = np.ascontiguousarray(rough.T)  # the leaf's centre adds the same to all
        n = rough.shape[1]
        for i in range(len(q)):
            own, score = rough[i], q[i].astype(np.float64)
            rough[i, self.row == rows[i]] = -np.inf
            if n > RERANK:
                best = np.partition(own, [n - RERANK, n - k])
                picked = np.flatnonzero(own >= min(best[n - RERANK], best[n - k] - 2 * self.error * np.linalg.norm(score)))
            else:
                picked = np.arange(n)
            picked = picked[own[picked] > -np.inf]
            exact = (self.x[picked].astype(np.float64) * score).sum(1)
            order = np.argsort(-exact, kind="stable")[:k]
            order = order[(exact[order] >= floors[i]) | (np.arange(len(order)) < least[i])]
            yield i, picked[order], exact[order]


def search(indexed: DataFrame, queries: DataFrame, model: Model, n: int, k: int = 20) -> DataFrame:
    """query_row, query_id, rank, vec_id, score: the k nearest found of each query (rows of an index: row, vec_id, embedding)."""
    given = indexed.sparkSession.sparkContext.broadcast(model)
    most = int(np.clip(n // 32, 2048, 65536))
    found = {r["leaf"]: r["n"] for r in indexed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a leaf: 1,024 at most
    sizes = np.array([found.get(i, 0) for i in range(len(model.centres))])
    cut = -(-sizes // most)
    pieces = F.array(*(F.lit(int(c)) for c in cut))

    def asked(batches):
        import pyarrow as pa

        m = given.value
        for b in batches:
            if not len(b):
                continue
            q = _matrix(b["embedding"], m.dim)
            order = np.argsort(-(q @ m.centres.T), 1, kind="stable").astype(np.int32)
            probes = np.maximum(m.probes, 1 + (np.cumsum(sizes[order], 1) < 4 * k).sum(1))
            leaves = [o[:t] for o, t in zip(order, probes)]
            # So many of each block make k in all; a leaf in several blocks has enough in each.
            each = np.arange(1, k + 1)
            full = [(cut[o][:, None] * np.minimum(np.where(cut[o] > 1, k, sizes[o])[:, None], each)).sum(0) for o in leaves]
            least = [min(k, 1 + int((f < k + 1).sum())) for f in full]
            scores = q.astype(np.float64) @ m.sample.astype(np.float64).T
            # One of the sample may be the query itself, so the floor is the score after the k-th, less what rounding may do.
            floor = np.partition(scores, -(k + 1), 1)[:, -(k + 1)] if scores.shape[1] > k else np.full(len(q), -np.inf)
            floor = floor - 1e-6 * np.abs(floor)
            yield pa.RecordBatch.from_arrays([b["row"], b["vec_id"], b["embedding"], pa.array(leaves, pa.list_(pa.int32())), pa.array(floor), pa.array(least, pa.int32())], names=["row", "vec_id", "embedding", "leaves", "floor", "least"])

    kinds = {c: indexed.schema[c].dataType.simpleString() for c in ("vec_id", "embedding")}
    spread = queries.select("row", "vec_id", "embedding").mapInArrow(asked, f"row long, vec_id {kinds['vec_id']}, embedding {kinds['embedding']}, leaves array<int>, floor double, least int")
    spread = spread.withColumn("leaf", F.explode("leaves")).withColumn("n", F.get(pieces, F.col("leaf"))).where("n > 0").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    block = F.pmod(F.xxhash64("row"), F.get(pieces, F.col("leaf"))).cast("int")
    candidates = indexed.select("leaf", block.alias("block"), F.lit(0).alias("kind"), "row", "vec_id", "embedding", "codes", F.lit(0.0).alias("floor"), F.lit(0).alias("least"))
    both = candidates.union(spread.select("leaf", "block", F.lit(1).alias("kind"), "row", "vec_id", "embedding", F.lit(None).cast("binary").alias("codes"), "floor", "least"))

    def run(batches):
        import pyarrow as pa

        m = given.value
        width = -(-len(m.books) // 2)
        key, parts, held = None, [], None
        for b in batches:
            leaf, block, kind, row, ids = (b[c].to_numpy(zero_copy_only=False) for c in ("leaf", "block", "kind", "row", "vec_id"))
            x = _matrix(b["embedding"], m.dim)
            floors, least = (b[c].to_numpy(zero_copy_only=False) for c in ("floor", "least"))
            edges = np.flatnonzero(np.r_[True, (np.diff(leaf) != 0) | (np.diff(block) != 0) | (np.diff(kind) != 0)]) if len(leaf) else []
            out: list = [[], [], [], []]
            for a, z in zip(edges, [*edges[1:], len(leaf)]):
                own = (int(leaf[a]), int(block[a]))
                if own != key:
                    key, parts, held = own, [], None
                if kind[a] == 0:
                    codes = np.frombuffer(b"".join(b["codes"].slice(a, z - a).to_pylist()), np.uint8).reshape(-1, width)
                    parts.append((row[a:z], ids[a:z], x[a:z], codes))
                    continue
                if held is None:
                    held = _Block(parts, own[0], m, k)
                for s in range(a, z, QUERIES):
                    e = min(s + QUERIES, z)
                    for i, places, scores in held.best(row[s:e], x[s:e], floors[s:e], least[s:e], k):
                        out[0].append(np.full(len(places), row[s + i]))
                        out[1].append(np.full(len(places), ids[s + i]))
                        out[2].append(held.ids[places])
                        out[3].append(scores)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o), t) for o, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.float64()))], names=["query_row", "query_id", "vec_id", "score"])

    met = both.repartition("leaf", "block").sortWithinPartitions("leaf", "block", "kind").mapInArrow(run, _FOUND)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def op13(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def neighbours(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: for each vector whose vec_id is divisible by ``every`` its k nearest found."""
    model, n = fit(vectors, k)
    if model is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    indexed = staged(index(vectors, model), "index")
    found = staged(search(indexed, indexed.where(F.col("vec_id") % every == 0), model, n, k).select("query_id", "rank", "vec_id", "score"), "nearest")
    drop(vectors.sparkSession, indexed)
    return found
