"""Token ids: encoding, fixed-width packing with random access, and the scan of flat files for separators.

Encoding splits at blanks and line feeds, where the vocabulary's own pre-tokenizer also cuts, and encodes each distinct piece
once a batch; ids are those of encoding the whole text at once. Lowering texts first, and encoding letters apart from the marks
behind them, is left to characters for which a table shows that it changes nothing: no combining marks, and letters whose normal
form and lower case are one letter each. All other pieces are encoded as they stand.

Packed format (a table of segments in ascending document order): shard, segment, first (ids of the shard before it), n_tokens,
width (bits an id), doc_ids, doc_tokens, payload. The id at place i of a segment stands in bits i * width and up, least
significant bit first, so any id or document is read without those before it.

Null and empty texts hold only the end id. Repeated doc_ids keep their rows, ordered by content; null doc_ids come first. Other
columns are ignored; an empty table gives an empty result.
"""

import os
import re
import sys
import types
import unicodedata
import zlib
from itertools import chain, repeat

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._ranges import bounds_of, range_index
from ._store import map_texts, new_path, small_batches
from ._text import groups

VOCABULARY, VOCABULARY_SIZE, END_ID = "word_bpe_49k.json", 49_408, 2
SEPARATOR = 65_535  # no id of the vocabulary
SEGMENT_TOKENS, BLOCK_TOKENS = 1 << 18, 1 << 16
BATCH_BYTES, BETWEEN_TASKS = 8_000_000, 120_000
_MARKS = "!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~"  # ASCII marks but those that begin contractions or special tokens


def _ranges(chars) -> str:
    """Characters as ranges of a character class."""
    out: list[list[int]] = []
    for c in sorted(map(ord, chars)):
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\x{{{a:X}}}-\\x{{{z:X}}}" for a, z in out)


def _plain_letters() -> set[str]:
    """Letters up to the Cyrillic ones that are their own normal form, with a lower case of one such letter. The capital sigma is
    none of them, as its lower case depends on its place in some libraries."""

    def whole(c: str) -> bool:
        return len(c) == 1 and c.isalpha() and unicodedata.normalize("NFC", c) == c

    return {c for c in map(chr, range(0x41, 0x500)) if whole(c) and whole(c.lower()) and c != "Σ"}


LETTERS = _plain_letters()
#: Characters of texts that may be lowered before they are encoded: also ASCII, typographic marks and CJK signs, which have no case.
_LOWERED = LETTERS | {chr(c) for a, z in ((0, 0x7F), (0xA1, 0xBF), (0x2010, 0x2027), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FFF)) for c in range(a, z + 1) if unicodedata.normalize("NFC", chr(c)) == chr(c) == chr(c).lower() or c < 0x7F}
_NOT_LOWERED = "[^" + _ranges(_LOWERED - {"<"}) + "]"
_WORD = re.compile("[" + "".join(map(re.escape, sorted(LETTERS))) + "]+")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Encodes batches of texts. Over ``most`` distinct pieces, those met in one batch only are forgotten."""

    def __init__(self, path: str, most: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.ends = Tokenizer.from_file(path), most, None
        self._clear()

    def _clear(self):
        self.place, self.ids, self.start, self.used, self.filled = {}, np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64), 0, 0
        self.length, self.met = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)

    def forget(self, most: int) -> None:
        """Keep at most so many pieces: those that most batches had in common, and none that one batch only had."""
        met = self.met[: self.used]
        often = np.flatnonzero(met > 1)
        if len(often) > most:
            often = often[np.argsort(-met[often], kind="stable")[:most]]
        names, met = list(self.place), met[often]
        names = [names[i] for i in often]
        ids, length = self._gather(often)
        self._clear()
        self._store(names, ids, length)
        self.met[: self.used] = (met + 1) // 2

    def _plain(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids and the number of ids of each piece."""
        found = []
        for at in range(0, len(pieces), 2000):  # the tokenizer's own records are large
            found += [e.ids for e in self.tokenizer.encode_batch_fast(pieces[at : at + 2000], add_special_tokens=False)]
        length = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(length.sum())), length

    def _letters(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for pieces of letters only: encoded side by side, each ends where the vocabulary marks a word's end."""
        if self.ends is None:
            vocabulary = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        ids, length = [], []
        for at in range(0, len(pieces), 500):
            part = pieces[at : at + 500]
            own = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            cut = np.flatnonzero(self.ends[own])
            n = np.diff(np.r_[-1, cut])
            if len(n) != len(part) or int(n.sum()) != len(own):  # a vocabulary with other word ends
                own, n = self._plain(part)
            ids.append(own)
            length.append(n)
        return np.concatenate(ids), np.concatenate(length)

    def _store(self, pieces: list[str], ids: np.ndarray, length: np.ndarray) -> None:
        while self.used + len(pieces) > len(self.start):
            self.start, self.length, self.met = (np.r_[x, np.zeros_like(x)] for x in (self.start, self.length, self.met))
        while self.filled + len(ids) > len(self.ids):
            self.ids = np.r_[self.ids, np.zeros_like(self.ids)]
        self.ids[self.filled : self.filled + len(ids)] = ids
        self.start[self.used : self.used + len(pieces)] = self.filled + np.cumsum(length) - length
        self.length[self.used : self.used + len(pieces)] = length
        self.place.update(zip(pieces, range(self.used, self.used + len(pieces))))
        self.used, self.filled = self.used + len(pieces), self.filled + len(ids)

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        length = self.length[at]
        ends = np.cumsum(length)
        where = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[at] - (ends - length), length)
        return self.ids[where], length

    def _alias(self, pieces: list[str], parts: list[tuple[str, ...]]) -> None:
        """Pieces that are several (equally many) known ones, side by side."""
        if pieces:
            n = len(parts[0])
            ids, length = self._gather(np.fromiter(map(self.place.__getitem__, chain.from_iterable(parts)), np.int64, n * len(parts)))
            self._store(pieces, ids, length.reshape(-1, n).sum(1))

    def _learn(self, new: list[str]) -> None:
        """The vocabulary cuts plain letters from a run of marks behind them, and has no capitals: such pieces follow from others."""
        place = self.place
        bases, marked, other, capital, small = set(), [], set(), [], set()
        for x in new:
            if _WORD.fullmatch(x):
                bases.add(x)
            elif (y := x.rstrip(_MARKS)) != x and _WORD.fullmatch(y):
                marked.append((x, y))
            else:
                other.add(x)
        bases.update(y for _, y in marked if y not in place)
        for x in bases:
            y = x.lower()
            if y != x:
                capital.append((x, y))
                if y not in place:
                    small.add(y)
            else:
                small.add(x)
        ends = [x[len(y) :] for x, y in marked]
        other.update(r for r in set(ends) if r not in place)
        for pieces, encode in ((list(small), self._letters), (list(other), self._plain)):
            if pieces:
                self._store(pieces, *encode(pieces))
        self._alias([x for x, _ in capital], [(y,) for _, y in capital])
        self._alias([x for x, _ in marked], [(y, r) for (_, y), r in zip(marked, ends)])

    def __call__(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and the number of ids of each text, of a list or Arrow array of texts."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        column = pc.fill_null(texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()), "")
        # Special tokens begin with < and are found before letters are lowered; combining marks meet their letters before that.
        column = pc.if_else(pc.match_substring_regex(column, _NOT_LOWERED), column, pc.utf8_lower(column))
        lists = pc.split_pattern(pc.replace_substring(column, "\n", " "), " ")
        coded = lists.flatten().dictionary_encode()
        pieces = coded.dictionary.to_pylist()
        if len(self.place) > self.most:
            self.forget(self.most // 2)
        known = np.fromiter(map(self.place.get, pieces, repeat(-1)), np.int64, len(pieces))
        if len(missing := np.flatnonzero(known < 0)):
            new = [pieces[i] for i in missing]
            self._learn(new)
            known[missing] = np.fromiter(map(self.place.__getitem__, new), np.int64, len(new))
        self.met[known] += 1
        ids, length = self._gather(known[coded.indices.to_numpy(zero_copy_only=False)])
        upto = np.r_[0, np.cumsum(length)][lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        return ids, np.diff(upto)

    @classmethod
    def shared(cls, path: str) -> "Encoder":
        """This process's encoder: a worker keeps what it learned from one task to the next."""
        kept = sys.modules.setdefault("_lexloom_worker", types.ModuleType("_lexloom_worker")).__dict__.setdefault("encoders", {})
        if path not in kept:
            kept[path] = cls(path)
        return kept[path]


def width_of(n_ids: int) -> int:
    """Bits that any id below ``n_ids`` needs."""
    return max(1, (n_ids - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids.astype(np.uint64)[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(payload: bytes, width: int, start: int, n: int) -> np.ndarray:
    """The ``n`` ids from place ``start`` on; reads only their bytes."""
    if width in (8, 16, 32):
        return np.frombuffer(payload, f"<u{width // 8}", n, start * (width // 8)).astype(np.uint32)
    low = start * width // 8
    raw = np.frombuffer(payload, np.uint8)[low : ((start + n) * width + 7) // 8]
    raw = np.r_[raw, np.zeros(8, np.uint8)].astype(np.uint64)
    bit = np.arange(n, dtype=np.int64) * width + (start * width - 8 * low)
    byte, shift = bit >> 3, (bit & 7).astype(np.uint64)
    value = np.zeros(n, np.uint64)
    for k in range((width + 14) // 8):
        value |= raw[byte + k] << np.uint64(8 * k)
    return ((value >> shift) & np.uint64((1 << width) - 1)).astype(np.uint32)


def encoded(docs: DataFrame, path: str, n_ids: int, end_id: int, between_tasks: int = BETWEEN_TASKS) -> DataFrame:
    """doc_id, n_tokens, payload (packed): each document's ids and the end id. A worker keeps ``between_tasks`` pieces from one
    task to the next; with 0 it keeps nothing, which takes more time and leaves more memory to what runs beside it."""
    small_batches(docs.sparkSession)
    width = width_of(n_ids)

    def work():
        import pyarrow.compute as pc

        encoder = Encoder.shared(path) if between_tasks else Encoder(path)

        def each(texts):
            for part in groups(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), BATCH_BYTES):
                ids, counts = encoder(texts.slice(part.start, part.stop - part.start))
                ids = np.insert(ids, np.cumsum(counts), end_id)
                ends = np.cumsum(counts + 1)
                yield part, {"n_tokens": counts + 1, "payload": [pack(ids[e - n : e], width) for e, n in zip(ends, counts + 1)]}

        return each, lambda: encoder.forget(between_tasks)

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"], "n_tokens long, payload binary", work, arrow=True)


def in_order(docs: DataFrame, enc: DataFrame) -> DataFrame:
    """shard, doc_id (as text, which nulls do not change), n_tokens, payload: ranges of ascending doc_id, one a partition.

    The ranges follow from the ids alone, so texts are encoded once and only packed ids are shuffled.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    bounds = bounds_of(docs.select(key.alias("key")), "key", int(enc.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = enc.withColumn("shard", range_index(key, bounds)).repartitionById(len(bounds) + 1, F.col("shard"))
    return ranged.sortWithinPartitions("shard", "doc_id", "payload").select("shard", F.col("doc_id").cast("string").alias("doc_id"), "n_tokens", "payload")


def write_packed(docs: DataFrame, out: str, path: str, n_ids: int = VOCABULARY_SIZE, end_id: int = END_ID, between_tasks: int = BETWEEN_TASKS) -> None:
    """Write the packed format to ``out``."""
    width = width_of(max(n_ids, end_id + 1))

    def run(batches):
        shard, segment, first, total, names, counts, parts = None, 0, 0, 0, [], [], []

        def row():
            whole = b"".join(parts) if width % 8 == 0 else pack(np.concatenate([unpack(p, width, 0, n) for p, n in zip(parts, counts)]), width)
            return pd.DataFrame({"shard": [shard], "segment": [segment], "first": [first], "n_tokens": [total], "width": [width], "doc_ids": [names], "doc_tokens": [counts], "payload": [whole]})

        for b in batches:
            for s, doc_id, n, payload in zip(b["shard"].tolist(), b["doc_id"], b["n_tokens"].tolist(), b["payload"]):
                if counts and (s != shard or total >= SEGMENT_TOKENS):
                    yield row()
                    segment, first, total, names, counts, parts = segment + 1, first + total, 0, [], [], []
                if s != shard:
                    shard, segment, first = s, 0, 0
                names.append(None if doc_id is None else int(doc_id))
                counts.append(n)
                parts.append(payload)
                total += n
        if counts:
            yield row()

    schema = "shard int, segment int, first long, n_tokens long, width int, doc_ids array<long>, doc_tokens array<long>, payload binary"
    in_order(docs, encoded(docs, path, max(n_ids, end_id + 1), end_id, between_tasks)).mapInPandas(run, schema).write.parquet(out)


def ids_between(spark, out: str, start: int, stop: int) -> np.ndarray:
    """The ids at places start to stop of the whole stream, read from the segments that hold them."""
    spans = [(r["begin"], bytes(r["payload"]), r["width"], r["n_tokens"]) for r in located(spark, out).where((F.col("begin") < stop) & (F.col("begin") + F.col("n_tokens") > start)).orderBy("begin").collect()]
    return np.concatenate([np.zeros(0, np.uint32), *(unpack(p, w, max(start - b, 0), min(stop - b, n) - max(start - b, 0)) for b, p, w, n in spans)])


def located(spark, out: str) -> DataFrame:
    """The segments with the place of their first id in the whole stream (begin)."""
    segments = spark.read.parquet(out)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row a shard
    base = segments.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return segments.join(F.broadcast(base), "shard").withColumn("begin", F.col("base") + F.col("first"))


def read_packed(spark, out: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files alone."""

    def run(batches):
        for b in batches:
            for _, r in b.iterrows():
                counts = np.asarray(r["doc_tokens"], np.int64)
                starts = np.r_[0, np.cumsum(counts)[:-1]]
                sums = [zlib.crc32(unpack(r["payload"], int(r["width"]), int(s), int(n)).astype("<u4").tobytes()) for s, n in zip(starts, counts)]
                yield pd.DataFrame({"doc_id": pd.array(list(r["doc_ids"]), "Int64"), "start": int(r["begin"]) + starts, "n_tokens": counts, "ids_crc32": sums})

    small_batches(spark)
    return located(spark, out).select("begin", "width", "doc_ids", "doc_tokens", "payload").mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8(spark, sf_dir: str) -> DataFrame:
    out = new_path(spark, "packed")
    write_packed(spark.read.parquet(f"{sf_dir}/documents.parquet"), out, vocabulary_path())
    return read_packed(spark, out)


# Flat files


def write_flat(docs: DataFrame, out: str, path: str, separator: int = SEPARATOR) -> None:
    """Flat little-endian 16-bit ids with a separator after each document, in blocks of a fixed size that ignore documents.

    Each partition of the input writes one file. Rows: kind 'ids' (file, block, payload) and, apart from them, kind 'names'
    (file, first ordinal as block, doc_ids): which documents were written, without any lengths.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        encoder, file, block, ordinal, rest = Encoder.shared(path), TaskContext.get().partitionId(), 0, 0, np.zeros(0, np.uint16)
        for b in batches:
            yield pd.DataFrame({"kind": ["names"], "file": [file], "block": [ordinal], "payload": [b""], "doc_ids": [[None if x is None else int(x) for x in b["doc_id"]]]})
            ordinal += len(b)
            for part in groups([len(t) if isinstance(t, str) else 0 for t in b["text"]], BATCH_BYTES):
                ids, counts = encoder(b["text"].iloc[part].tolist())
                if len(ids) and int(ids.max()) >= separator:
                    raise ValueError(f"id {int(ids.max())} does not fit below the separator {separator}")
                rest = np.r_[rest, np.insert(ids.astype(np.uint16), np.cumsum(counts), separator)]
                whole = len(rest) // BLOCK_TOKENS
                if whole:
                    payloads = [rest[i * BLOCK_TOKENS : (i + 1) * BLOCK_TOKENS].astype("<u2").tobytes() for i in range(whole)]
                    yield pd.DataFrame({"kind": "ids", "file": file, "block": block + np.arange(whole), "payload": payloads, "doc_ids": None})
                    block, rest = block + whole, rest[whole * BLOCK_TOKENS :]
        if len(rest):
            yield pd.DataFrame({"kind": ["ids"], "file": [file], "block": [block], "payload": [rest.astype("<u2").tobytes()], "doc_ids": [None]})
        encoder.forget(BETWEEN_TASKS)

    docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, "kind string, file int, block long, payload binary, doc_ids array<long>").write.parquet(out)


def separator_scan(blocks: DataFrame, separator: int = SEPARATOR) -> DataFrame:
    """file, ordinal, n_tokens of each document of flat files given as rows (file, block, payload); separators aren't counted.

    Each block is searched by itself and read once: its summary holds the ids before its first separator, the lengths between
    separators, and the ids after the last. A prefix scan over the summaries tells how many documents ended before a block and
    how many ids its first document already had. Ids after a file's last separator are a last document.
    """

    def summarise(batches):
        for b in batches:
            rows = []
            for f, k, p in zip(b["file"], b["block"], b["payload"]):
                ids = np.frombuffer(p, "<u2")
                at = np.flatnonzero(ids == separator)
                rows.append((f, k, len(ids), len(at), int(at[-1]) + 1 if len(at) else None, np.diff(np.r_[-1, at]) - 1))
            yield pd.DataFrame(rows, columns=["file", "block", "n", "seps", "last", "lengths"]).astype({"last": "Int64"})

    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file")
    scanned = (
        blocks.select("file", "block", "payload").mapInPandas(summarise, "file int, block long, n long, seps long, last long, lengths array<long>")
        .withColumn("begin", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .withColumn("ordinal", F.coalesce(F.sum("seps").over(before), F.lit(0)))
        .withColumn("closed", F.coalesce(F.max(F.col("begin") + F.col("last")).over(before), F.lit(0)))
        .withColumn("final", F.col("block") == F.max("block").over(whole))
    )
    open_ids = F.col("n") - F.when(F.col("seps") > 0, F.col("last")).otherwise(F.col("closed") - F.col("begin"))
    counts = F.transform("lengths", lambda x, i: x + F.when(i == 0, F.col("begin") - F.col("closed")).otherwise(0))
    counts = F.when(F.col("final") & (open_ids > 0), F.concat(counts, F.array(open_ids))).otherwise(counts)
    return scanned.select("file", "ordinal", F.posexplode(counts).alias("k", "n_tokens")).select("file", (F.col("ordinal") + F.col("k")).alias("ordinal"), "n_tokens")


def op7(spark, sf_dir: str) -> DataFrame:
    out = new_path(spark, "flat")
    write_flat(spark.read.parquet(f"{sf_dir}/documents.parquet"), out, vocabulary_path())
    small_batches(spark)
    rows = spark.read.parquet(out)
    names = rows.where("kind = 'names'").select("file", "block", F.posexplode("doc_ids").alias("k", "doc_id")).select("file", (F.col("block") + F.col("k")).alias("ordinal"), "doc_id")
    return separator_scan(rows.where("kind = 'ids'")).join(names, ["file", "ordinal"]).select("doc_id", "n_tokens", "file", "ordinal")
