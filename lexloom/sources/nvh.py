"""Name-value files of lexicon entries, and corpora.

An entry begins at indent 0; its fields stand at indent 2, what belongs to a field deeper. Forms carry the slot in a nested ``tag``.
Parsing runs per file; ``position`` orders the entries of all files: by path, then by place in the file.
"""

import json
import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.text import plain

LANGUAGES = ("en", "de", "lt", "lv", "pl", "ru")  # fixed values
ENTRY = "position long, id string, lemma string, homograph int, pos string, gender string, paradigm string, numtype string, label string, description string, attested map<string,array<string>>, stems map<string,string>, translations map<string,array<string>>, relations array<struct<kind:string,target:string,role:string>>, head array<string>, tail array<string>"


def parse(text: str) -> list[dict]:
    """The entries of a file as dictionaries with the fields of ``ENTRY``."""
    out: list[dict] = []
    now: dict = {}
    form = None
    section = ""
    for line in text.splitlines():
        if not line.strip():
            continue
        depth = len(line) - len(line.lstrip(" "))
        name, _, value = line.strip().partition(":")
        value = value.strip()
        if depth == 0:
            if name == "entry":
                now = {"position": len(out), "id": "", "lemma": unicodedata.normalize("NFC", value), "homograph": None, "pos": "", "gender": "", "paradigm": "", "numtype": "", "label": "", "description": ""}
                now |= {"attested": {}, "stems": {}, "translations": {}, "relations": [], "head": [], "tail": []}
                out.append(now)
            form, section = None, name
            continue
        if not now:
            continue
        if depth == 2:
            form, section = (unicodedata.normalize("NFC", value), name) if name == "inflectedForm" else (None, name)
            if name == "inflectedForm":
                now["seen_form"] = True
                continue
            if name == "stemOverrides":
                now["stems"] |= dict(x.split("=", 1) for x in value.split() if "=" in x)
                continue
            if name == "pos" and "-" in value:  # older files name the gender with the part of speech
                now["pos"], now["gender"] = value.split("-", 1)
            elif name == "homograph":
                now["homograph"] = int(value)
            elif name in ("id", "pos", "gender", "paradigm", "numtype", "label"):
                now[name] = value
            elif name in ("attestedFormOf", "variantOf"):
                now["relations"].append({"kind": name, "target": value, "role": ""})
        elif form is not None:
            if name == "tag":
                now["attested"].setdefault(value, set()).add(form)
            continue
        elif section == "sense" and name in LANGUAGES:
            now["translations"].setdefault(name, []).append(value)
        elif name == "desc":
            now["description"] = plain(value)
        elif name == "role" and now["relations"]:
            now["relations"][-1]["role"] = value
        now["tail" if now.get("seen_form") else "head"].append(line)
    for e in out:
        e.pop("seen_form", None)
        e["id"] = e["id"] or e["lemma"]
        e["attested"] = {s: sorted(f) for s, f in sorted(e["attested"].items())}
    return out


def render(entry: dict, role_order: Iterable[str] = ()) -> str:
    """An entry as text: its head, the stems in role order, the remaining forms by slot, its tail."""
    lines = [f"entry: {entry['lemma']}", *entry["head"]]
    if entry["stems"]:
        order = list(role_order)
        roles = sorted(entry["stems"], key=lambda r: (order.index(r) if r in order else len(order), r))
        lines.append("  stemOverrides: " + " ".join(f"{r}={entry['stems'][r]}" for r in roles))
    for slot, forms in entry["attested"].items():
        for f in forms:
            lines += [f"  inflectedForm: {f}", f"    tag: {slot}"]
    return "\n".join([*lines, *entry["tail"]]) + "\n"


def read(spark: SparkSession, path: str) -> DataFrame:
    """The entries of all files at ``path``; a file is parsed by one task."""

    def run(batches):
        for b in batches:
            for text, file in zip(b["value"], b["file"]):
                out = pd.DataFrame(parse(text), columns=[f.split(" ")[0] for f in ENTRY.split(", ")])
                yield out.assign(position=out["position"].astype("int64") + (int(file) << 32))

    files = spark.read.text(path, wholetext=True)
    names = json.dumps(sorted(files.inputFiles()))  # entry files: some dozen
    return files.select("value", (F.array_position(F.from_json(F.lit(names), "array<string>"), F.input_file_name()) - 1).alias("file")).mapInPandas(run, ENTRY)


def role_order(pos: str, paradigm: str, lemma: str) -> list[str]:
    """The roles of a paradigm in the order of its table; none of an unknown one."""
    from ..operators import paradigms as P

    try:
        return list(P.SPEC[P.family(pos), P.resolve(pos, paradigm, lemma or "")])
    except (KeyError, AttributeError):
        return []


def generable() -> Column:
    """Whether an entry has all that generation needs: a part of speech, a paradigm and cells."""
    return (F.col("pos") != "") & (F.col("paradigm") != "") & (F.size("attested") > 0)


def n_cells() -> Column:
    """How many surfaces an entry attests."""
    return F.aggregate(F.map_values("attested"), F.lit(0), lambda n, x: n + F.size(x))


def write(entries: DataFrame, path: str) -> None:
    """Entries as text, in order of position; stems in the order of their paradigm's roles."""

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"value": [render(r, role_order(r["pos"], r["paradigm"], r["lemma"])).rstrip("\n") for r in b.to_dict("records")]})

    entries.orderBy("position").mapInPandas(run, "value string").write.text(path)


def sentences_of_json(spark: SparkSession, path: str, skipped: Iterable[str] = ()) -> DataFrame:
    """sent_id, text, tokens, frequency of a JSON array of corpus rows. A row goes if all its sources are skipped; sent_id holds
    the row's place in the file."""
    rows = spark.read.json(path, multiLine=True, schema="sources array<struct<video_id:string>>, text_clean string, text string, frequency long")
    # One task reads a file from its first row to its last, so numbers of rows ascend; a file's first number is its row 0.
    rows = rows.select("*", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("n"))
    r = rows.join(rows.groupBy("file").agg(F.min("n").alias("n0")), "file").withColumn("i", F.col("n") - F.col("n0"))
    gone = (F.size("sources") > 0) & F.forall("sources", lambda s: s["video_id"].isin(*skipped)) if list(skipped) else F.lit(False)
    text = F.coalesce(F.nullif("text_clean", F.lit("")), F.nullif("text", F.lit("")), F.lit(""))
    first = F.coalesce(F.get("sources", F.lit(0))["video_id"], F.lit(""))
    out = r.where(~F.coalesce(gone, F.lit(False))).select(F.concat_ws("-", F.lit("yt"), first, F.col("i").cast("string")).alias("sent_id"), text.alias("text"), tx.tokenize(text).alias("tokens"), F.coalesce("frequency", F.lit(1)).alias("frequency"))
    return out.where(F.exists("tokens", lambda t: t.rlike(r"^\p{L}")))


def sentences_of_markdown(spark: SparkSession, path: str) -> DataFrame:
    """sent_id (file stem and place among the kept sentences), text, tokens of Markdown files; headings and lists go."""
    lines = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1).alias("file"), F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\n")).alias("line", "raw"))
    kept = lines.where(~F.trim("raw").rlike(r"^$|^[#*]"))
    pieces = kept.select("file", "path", "line", F.posexplode(tx.sentences(tx.markdown_plain(F.col("raw")))).alias("k", "text")).withColumn("tokens", tx.tokenize("text")).where(F.exists("tokens", lambda t: t.rlike(r"^\p{L}")))
    n = F.row_number().over(Window.partitionBy("file").orderBy("path", "line", "k"))  # goes on over folders with a file of one name
    return pieces.select(F.concat_ws("-", "file", n.cast("string")).alias("sent_id"), "text", "tokens")


def sentences_of_text(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """sent_id (key and place, dropped pieces counted), text, tokens of a column of free text."""
    pieces = docs.select(key, F.posexplode(tx.sentences(text)).alias("i", "text")).withColumn("tokens", tx.tokenize("text"))
    return pieces.where(F.size("tokens") > 0).select(F.concat_ws("-", F.lit("text"), F.col(key).cast("string"), F.col("i").cast("string")).alias("sent_id"), "text", "tokens")


def golden(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Rows of a tab-separated file of expectations; comment and blank lines are skipped."""
    parts = F.split("value", "\t")
    return spark.read.text(path).where("trim(value) <> '' and not startswith(value, '#')").select(*(F.get(parts, F.lit(i)).alias(c) for i, c in enumerate(columns)))
