"""Quality classifier as a sparse rule ensemble.

Statistics of whole texts are Spark column expressions. Boosted shallow trees are grown on a bounded sample of labelled rows;
every path from a root to a node is a conjunctive rule over statistics; lasso-penalised logistic regression weighs the rules, and
those with weight compile into one Spark column expression that scores any number of documents without Python.

The fit reads at most ``most_rows`` labelled documents, the first by a hash of doc_id; scores cover all rows. Only the text enters a
score. Of several texts with one doc_id the fit reads the one with the smallest hash. Labels of one doc_id are averaged and rounded; null labels are ignored; without labels, or with one class only, the score
is the (smoothed) base rate. Null and empty texts have the statistics of an empty text. Repeated rows are scored alike; other
columns are kept; an empty table gives an empty result.
"""

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_ROWS, TREES, DEPTH, PENALTY, THRESHOLD = 20_000, 40, 3, 1e-3, 0.3

_N = "greatest(length(t), 1)"
STATISTICS = {
    "n_chars": "length(t)",
    "n_words": "size(w)",
    "mean_word": "length(t) / greatest(size(w), 1)",
    "distinct_words": "size(array_distinct(w)) / greatest(size(w), 1)",
    "words_a_line": r"size(w) / (regexp_count(t, '\n') + 1)",
    "upper": rf"regexp_count(t, '\\p{{Lu}}') / {_N}",
    "digits": rf"regexp_count(t, '[0-9]') / {_N}",
    "marks": rf"regexp_count(t, '[^\\p{{L}}\\p{{N}}\\s.,]') / {_N}",
    "bars": rf"regexp_count(t, '[|]') / {_N}",
    "bangs": rf"regexp_count(t, '!') / {_N}",
    "stops": rf"regexp_count(t, '[.!?](?=\\s|$)') / greatest(size(w), 1)",
}


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with a struct ``stats`` of the statistics of each whole text."""
    wide = docs.withColumn("__t", F.coalesce(F.col(text), F.lit(""))).withColumn("__w", F.expr(r"array_remove(split(__t, '\\s+'), '')"))
    each = ", ".join(f"'{k}', cast({v.replace('(t', '(__t').replace('(w', '(__w')} as double)" for k, v in STATISTICS.items())
    # A generator, so that a filter on what follows cannot copy the statistics into itself and work them out again and again.
    return wide.withColumn("stats", F.explode(F.array(F.expr(f"named_struct({each})")))).drop("__t", "__w")


Rule = tuple[tuple[str, bool, float], ...]  # (statistic, is above, threshold), all of them


def _tree_rules(x: np.ndarray, cuts: list[np.ndarray], binned: np.ndarray, residual: np.ndarray, depth: int, least: int):
    """Fit one regression tree; its rules as ((feature, above, cut), ...) and its fitted values."""
    rules, fitted = [], np.zeros(len(x))

    def grow(rows: np.ndarray, path: tuple, left: int) -> None:
        if path:
            rules.append(path)
        best = (1e-9, None)
        if left and len(rows) >= 2 * least:
            r = residual[rows]
            for f in range(x.shape[1]):
                n = np.bincount(binned[rows, f], minlength=len(cuts[f]) + 1)[:-1].cumsum()
                s = np.bincount(binned[rows, f], r, minlength=len(cuts[f]) + 1)[:-1].cumsum()
                ok = (n >= least) & (len(rows) - n >= least)
                if ok.any():
                    gain = np.where(ok, s**2 / np.maximum(n, 1) + (r.sum() - s) ** 2 / np.maximum(len(rows) - n, 1), 0) - r.sum() ** 2 / len(rows)
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (gain[k], (f, k))
        if best[1] is None:
            fitted[rows] = residual[rows].mean()
            return
        f, k = best[1]
        above = binned[rows, f] > k
        grow(rows[~above], (*path, (f, False, float(cuts[f][k]))), left - 1)
        grow(rows[above], (*path, (f, True, float(cuts[f][k]))), left - 1)

    grow(np.arange(len(x)), (), depth)
    return rules, fitted


def _holds(rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, above, cut in rule:
        out &= (x[:, f] > cut) == above
    return out


def _lasso(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 600) -> tuple[np.ndarray, float]:
    """Logistic regression with an L1 penalty, by accelerated proximal gradient steps."""
    n, k = z.shape
    centre, scale = z.mean(0), np.maximum(z.std(0), 1e-6)
    a = (z - centre) / scale
    step = 4.0 / max(np.linalg.norm(a.T @ a / n, 2) + 1, 1e-9)
    w, v, b, c, t = np.zeros(k), np.zeros(k), 0.0, 0.0, 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ v + c, -30, 30)))
        u = v - step * (a.T @ (p - y)) / n
        new, new_b = np.sign(u) * np.maximum(np.abs(u) - step * penalty, 0), c - step * (p - y).mean()
        t, old = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        v, c = new + (old - 1) / t * (new - w), new_b + (old - 1) / t * (new_b - b)
        w, b = new, new_b
    return w / scale, b - float((w * centre / scale).sum())


@dataclass
class RuleEnsemble:
    """Weighted conjunctive rules and an intercept."""

    rules: list[tuple[Rule, float]]
    intercept: float

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, names: list[str], trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY) -> "RuleEnsemble":
        base = (y.sum() + 1) / (len(y) + 2)
        if len(y) == 0 or y.min() == y.max():
            return cls([], float(np.log(base / (1 - base))))
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 129)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(cuts[f], x[:, f], "left") for f in range(x.shape[1])], 1)
        margin, rules = np.full(len(y), np.log(base / (1 - base))), {}
        for _ in range(trees):
            residual = y - 1 / (1 + np.exp(-margin))
            found, fitted = _tree_rules(x, cuts, binned, residual, depth, max(2, len(y) // 500))
            rules |= dict.fromkeys(found)
            margin += 2 * fitted
        rules = list(rules)
        w, b = _lasso(np.stack([_holds(r, x) for r in rules], 1).astype(float), y, penalty)
        return cls([(tuple((names[f], a, c) for f, a, c in r), float(v)) for r, v in zip(rules, w) if abs(v) > 1e-9], b)

    def column(self, stats: str = "stats") -> Column:
        """The score of a row with a struct of statistics, as a Spark expression."""
        margin = F.lit(self.intercept)
        for rule, weight in self.rules:
            holds = F.lit(True)
            for name, above, cut in rule:
                holds = holds & ((F.col(f"{stats}.{name}") > cut) if above else (F.col(f"{stats}.{name}") <= cut))
            margin = margin + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-margin))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> RuleEnsemble:
    """Learn from labelled rows outside the held-out fold; at most ``most_rows`` of them reach the driver."""
    known = labels.where("quality is not null and doc_id is not null").where(~held_out()).groupBy("doc_id").agg(F.avg("quality").alias("y"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    one = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.first("y").alias("y"), F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = statistics(one).select("doc_id", F.round("y").alias("y"), "stats.*").toPandas()
    rows = rows.sort_values(["doc_id", *STATISTICS])
    return RuleEnsemble.fit(rows[list(STATISTICS)].to_numpy(float), rows["y"].to_numpy(float), list(STATISTICS))


def scored(docs: DataFrame, model: RuleEnsemble, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with score and predicted."""
    wide = statistics(docs)
    return wide.withColumn("score", model.column()).drop("stats").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op10(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return scored(docs.select("doc_id", "text"), fit(docs, labels)).select("doc_id", held_out().alias("held_out"), "score", "predicted")
