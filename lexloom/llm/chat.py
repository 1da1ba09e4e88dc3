r"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, and only its text is trainable. ``texts`` makes
them: one row (conv_id, example, text, loss_start, loss_end) an example, whose text holds all turns before the reply and ends with it;
a conversation of n turns takes some n * n / 4 of them. ``examples`` is the step before, which crosses the network: turns fall
into blocks of ``BLOCK``; an example's text there begins with its block, and the blocks before it, which all its successors share, are
rows of their own (example null), so at most BLOCK * n turns are moved. What follows the last reply of a conversation is in the row of
its last block, and, if asked for, a row of ``texts`` without example.

A turn is rendered as ``<|im_start|>role\ntext<|im_end|>\n``. In texts and roles a backslash is doubled, and one follows each
``<`` and ``[``, so no control string of the usual templates survives; a line feed in a role becomes ``\n``. Reading left to
right undoes it.

Null texts and roles are empty; a null conv_id is a conversation of its own; rows with the same turn are ordered by role, then
text, and repeated rows stay; null turns come first; other columns are ignored; an empty table gives an empty result.
"""

import hashlib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import new_path, small_batches

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
TURN_RANGE, BLOCK, BATCH_CHARS = 256, 32, 4 << 20
_READER = "spark.sql.parquet.columnarReaderBatchSize"
_ESCAPED = re.compile(r"([<\[])\\|\\(\\)|\\(n)")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), r"[<\[]", r"$0\\")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1] or m[2] or "\n", text)


def turns(conversations: DataFrame, targets: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """The rendered turns in their places, with the number of the example that each is in first. Counts run within ranges of turns, so a long conversation spreads over tasks."""
    role = F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\n"))
    key = ["missing", "conv", "range"]
    rows = (
        conversations.select("conv_id", F.col("conv_id").isNull().alias("missing"), F.coalesce("conv_id", F.lit(0)).alias("conv"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        .withColumn("range", F.floor(F.coalesce("turn", F.lit(-1)) / TURN_RANGE))
        .withColumn("is_target", F.col("role").isin(*targets))
    )
    goals = F.sum(F.col("is_target").cast("long"))
    before = Window.partitionBy("missing", "conv").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    base = (
        rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), goals.alias("t"))
        .select(*key, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"), F.coalesce(F.sum("t").over(before), F.lit(0)).alias("t_before"))
    )
    order = Window.partitionBy(*key).orderBy("turn", "role", "text")
    inside = order.rowsBetween(Window.unboundedPreceding, -1)
    head = F.concat(F.lit(OPEN), role, F.lit("\n"))
    body = escape(F.col("text"))
    return (
        rows.withColumn("k", F.row_number().over(order)).withColumn("t", F.coalesce(goals.over(inside), F.lit(0)))
        .join(base, key)
        .select(
            "conv_id", (F.col("k") + F.col("n_before") - 1).alias("place"), (F.col("t") + F.col("t_before")).alias("example"), "is_target",
            F.concat(head, body, F.lit(CLOSE)).alias("rendered"), F.length(head).alias("loss_start"),
            F.when(F.col("is_target"), F.length(head) + F.length(body)).otherwise(F.length(head)).alias("loss_end"),
        )
    )


def examples(conversations: DataFrame, targets: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, block, example, text, loss_start, loss_end: an example for each target, and all blocks (without example)."""
    rows = turns(conversations, targets).withColumn("block", F.floor(F.col("place") / BLOCK))
    turn = F.struct("place", "rendered", "is_target", "example", "loss_start", "loss_end")
    block = rows.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list(turn)).alias("turns"))  # at most BLOCK turns
    lengths = F.transform("turns", lambda t: F.length(t["rendered"]))
    upto = F.transform("turns", lambda t, i: F.when(t["is_target"], F.struct(i.alias("i"), t["example"].alias("example"), t["loss_start"].alias("a"), t["loss_end"].alias("z"))))
    whole = F.struct((F.size("turns") - 1).alias("i"), F.lit(None).cast("long").alias("example"), F.lit(0).alias("a"), F.lit(0).alias("z"))
    each = block.withColumn("lengths", lengths).withColumn("e", F.explode(F.concat(F.array_compact(upto), F.array(whole))))
    before = F.when(F.col("e.example").isNull(), 0).otherwise(F.aggregate(F.slice("lengths", F.lit(1), F.col("e.i")), F.lit(0), lambda n, x: n + x))
    text = F.array_join(F.transform(F.slice("turns", F.lit(1), F.col("e.i") + 1), lambda t: t["rendered"]), "")
    return each.select("conv_id", "block", F.col("e.example").alias("example"), text.alias("text"), (before + F.col("e.a")).cast("int").alias("loss_start"), (before + F.col("e.z")).cast("int").alias("loss_end"))


def _in_order(rows: DataFrame, *order) -> DataFrame:
    """The rows of each conversation in one stream."""
    keyed = rows.select(F.col("conv_id").isNull().alias("missing"), F.coalesce("conv_id", F.lit(0)).alias("conv"), *(c for c in rows.columns if c != "conv_id"))
    return keyed.repartition(F.col("missing"), F.col("conv")).sortWithinPartitions("missing", "conv", *order)


def texts(written: DataFrame, rest: bool = False) -> DataFrame:
    """conv_id, example, text, loss_start, loss_end: each example with all blocks before its own; its size is that of its context. With
    ``rest``, what follows the last reply of a conversation, too (example null). A task holds one conversation's blocks at a time."""

    def run(batches):
        key, before, end, out, size = None, "", 0, [], 0
        frame = lambda: pd.DataFrame(out, columns=["missing", "conv", "example", "text", "loss_start", "loss_end"]).astype({"example": "Int64"})
        left = lambda: [(*key, None, before[end:], 0, 0)] if rest and key and len(before) > end else []
        for b in batches:
            for missing, conv, example, text, a, z in zip(b["missing"], b["conv"], b["example"], b["text"], b["loss_start"], b["loss_end"]):
                if (missing, conv) != key:
                    out += left()
                    key, before, end = (missing, conv), "", 0
                if pd.isna(example):  # a whole block, after its examples
                    before += text
                    continue
                out.append((missing, conv, int(example), before + text, len(before) + a, len(before) + z))
                end, size = len(before) + len(text), size + len(before) + len(text)
                if size > BATCH_CHARS:
                    yield frame()
                    out, size = [], 0
            if out:
                yield frame()
                out, size = [], 0
        if out := left():
            yield frame()

    full = _in_order(written, "block", F.col("example").asc_nulls_last()).mapInPandas(run, "missing boolean, conv long, example long, text string, loss_start int, loss_end int")
    return full.select(F.when(~F.col("missing"), F.col("conv")).alias("conv_id"), "example", "text", "loss_start", "loss_end")


def _checked(full: DataFrame, targets: tuple[str, ...]) -> DataFrame:
    """conv_id, example, new, loss_start, loss_end, context, whole: what each example says beyond the one before it, with the hashes of
    its context up to there and of all of it. The span must be the text of the last turn and of no other."""
    heads = [OPEN + re.sub(r"[<\[]", r"\g<0>" + "\\\\", r.replace("\\", "\\\\")).replace("\n", "\\n") + "\n" for r in targets]

    def run(batches):
        sha = lambda text: hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
        for b in batches:
            out = []
            for text, a, z, example, conv in zip(b["text"], b["loss_start"], b["loss_end"], b["example"], b["conv_id"]):
                if pd.isna(example):
                    out.append((text, 0, 0, "", ""))
                    continue
                turn = text.rfind(OPEN, 0, a)
                if text[z:] != CLOSE or turn < 0 or text[turn:a] not in heads or OPEN in text[a:]:
                    raise ValueError(f"conversation {conv}: example {example} is not trainable on its last turn only")
                last = max(text.rfind(h, 0, turn) for h in heads)
                cut = text.index(CLOSE, last) + len(CLOSE) if last >= 0 else 0
                out.append((text[cut:], a - cut, z - cut, sha(text[:cut]), sha(text)))
            yield b[["conv_id", "example"]].assign(**dict(zip(("new", "loss_start", "loss_end", "context", "whole"), zip(*out)))) if out else pd.DataFrame(columns=["conv_id", "example", "new", "loss_start", "loss_end", "context", "whole"])

    return full.select("conv_id", "example", "text", "loss_start", "loss_end").mapInPandas(run, "conv_id long, example long, new string, loss_start int, loss_end int, context string, whole string")


def read_back(full: DataFrame, targets: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Per conversation, from its whole examples (``texts`` with the rest): what was said, what is trainable, and whether each example
    is what it should be: all of the example before it, what was said since, and a reply, trainable just there."""
    schema = "missing boolean, conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long"
    columns = [x.split(" ")[0] for x in schema.split(", ")]
    nothing = hashlib.sha256().hexdigest()

    def run(batches):
        key, said, loss, counts, last = None, None, None, [0, 0, 0, 0], nothing

        def row():
            return (*key, counts[0], said.hexdigest(), counts[1], loss.hexdigest(), counts[2], counts[3])

        for b in batches:
            out = []
            for missing, conv, example, new, a, z, context, whole in zip(b["missing"], b["conv"], b["example"], b["new"], b["loss_start"], b["loss_end"], b["context"], b["whole"]):
                if (missing, conv) != key:
                    if key:
                        out.append(row())
                    key, said, loss, counts, last = (missing, conv), hashlib.sha256(), hashlib.sha256(), [0, 0, 0, 0], nothing
                for m in _TURN.finditer(new):
                    said.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode("utf-8", "surrogatepass"))
                    counts[0] += 1
                counts[2] += len(new)
                if pd.isna(example):  # what follows the last reply
                    continue
                if context != last or example != counts[3]:
                    raise ValueError(f"conversation {conv}: an example's context is not what the example before it holds")
                trainable = unescape(new[a:z])
                loss.update(trainable.encode("utf-8", "surrogatepass"))
                counts[1], counts[3], last = counts[1] + len(trainable), counts[3] + 1, whole
            yield pd.DataFrame(out, columns=columns)
        if key:
            yield pd.DataFrame([row()], columns=columns)

    spread = _in_order(_checked(full, targets), F.col("example").asc_nulls_last())
    return spread.mapInPandas(run, schema).select(F.when(~F.col("missing"), F.col("conv_id")).alias("conv_id"), *columns[2:])


def digests(written: DataFrame, targets: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """``read_back`` of the whole examples that ``examples`` stand for."""
    return read_back(texts(written, rest=True), targets)


def op9(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    if spark.conf.get(_READER, "4096") == "4096":  # a batch of whole examples is read at once
        spark.conf.set(_READER, "256")
    extra = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    out = new_path(spark, "chat")
    # Neighbouring examples share their beginning, which this codec finds.
    texts(examples(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").union(extra)), rest=True).write.option("compression", "zstd").parquet(out)
    return read_back(spark.read.parquet(out))


#: What ``digests`` returns, from the table alone (each conversation's own columns).
ORACLE = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, '<|im_start|>' || role || chr(10) || regexp_replace(replace(text, '\', '\\'), '([<\[])', '\1\\', 'g') || '<|im_end|>' || chr(10) AS rendered FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(rendered))::BIGINT AS formatted_chars, count(*) FILTER (role = 'assistant') AS n_examples
FROM e GROUP BY conv_id
"""
