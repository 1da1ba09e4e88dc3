"""Surrogates for personal data and secrets.

Detected entities get keyed replacements of their own type and format. A surrogate is the value of a keyed permutation of all
strings with the entity's layout (which characters are digits, capitals, small letters of which alphabet; the rest stays), so
equal entities have equal surrogates everywhere, without a table, and different ones differ. Where only part of a layout is
valid (card check digits, area codes, address octets), the permutation is walked on until the result is as valid as the entity.
A name's letters map to a pronounceable stem of the same script, which is the same everywhere; its ending follows the gender of the
title that introduces the name in the document, or, where none tells (Dr, Prof), that which its last letter suggests. So one name has
one surrogate in a document, and is known again in all others by the stem. Stems of names of each length have lengths of their own,
set apart by more than the endings differ, so no two names meet. A name that a title introduces is replaced wherever the
document has it.

Found are: mail addresses, telephone numbers with a country code or in a ten-digit layout, IPv4 addresses, social security numbers,
payment cards, IBANs, access keys, values after words such as password or token that hold a digit, and names after a title (any
number of capitalised words joined by blanks, hyphens or apostrophes). Not found are: names that no title introduces, street
addresses, dates of birth, IPv6 addresses, other national numbers.

``collisions`` checks the result: no two entities of a kind share a surrogate, and no entity has two. Entities are the same if they
differ in nothing but the format of a number (its country code counts), the case of a mail address or name, or the ending of a name's
surrogate; secrets, keys and IBANs are compared as written. The key is the caller's: who has it can undo the surrogates. A session
without one draws its own, so another session's surrogates differ.

Null texts stay null, empty ones empty; texts without entities stay as they are, byte for byte; repeated rows get equal results;
other columns are kept unless a result column has their name; an empty table gives an empty result.
"""

import hashlib
import hmac
import ipaddress
import os
import re
import unicodedata
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import map_texts, small_batches, staged

_DIGITS, _SMALL, _LARGE = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_ALPHABETS = [_DIGITS, _SMALL, _LARGE, "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿß", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"]
_PLACE = {c: (a, i) for a in _ALPHABETS for i, c in enumerate(a)}
#: Script: letters of names, consonants, vowels, endings of female and male surrogates.
_SCRIPTS = {
    "latin": (_SMALL + _ALPHABETS[3], "bcdfghjklmnprstvwzyx", "aeiou", "na", "n"),
    "cyrillic": (_ALPHABETS[5] + "ё", "бвгджзклмнпрстфхцчшщ", "аеиоу", "на", "н"),
    "greek": (_ALPHABETS[7] + "άέήίόύώς", "βγδζθκλμνξπρστφχψ", "αειου", "να", "ς"),
}
_FEMALE = ("Mrs", "Ms", "Miss", "Mme", "Madame", "Mlle", "Frau", "Señora", "Sra", "Госпожа", "г-жа", "Κυρία")
_MALE = ("Mr", "Herr", "Señor", "Monsieur", "Господин", "г-н", "Κύριος")
_EITHER = ("Dr", "Prof")

_NUMBER = re.compile(
    r"(?P<ip>\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d))"
    r"|(?P<phone>\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)|\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|\d{3}([.-])\d{3}\3\d{4}(?![\d-]))"
    r"|(?P<ssn>\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<card>\d{4}([ -])\d{4}\6\d{4}\6\d{4}(?!\d)|\d{13,19}(?!\d))"
)
_SECRET = re.compile(r"(?i:(token|password|passwd|secret|api[_-]?key))(\s*[=:]\s*)([\"']?)([A-Za-z0-9_+/.\-]{6,})\3")
_ACCESS = re.compile(r"AKIA[0-9A-Z]{16}(?![0-9A-Z])")
_IBAN = re.compile(r"[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){3,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])")
_DOMAIN = re.compile(r"(?:[A-Za-z0-9\-]+\.)+[A-Za-z]{2,}")
#: Words of names: a capital or a letter without case, then letters; at most 64, as longer runs are no names.
_PART = r"[^\W\d_a-zà-öø-ÿа-яα-ω][^\W\d_]{0,63}(?:['’-][^\W\d_]{1,64})*"
_NAME = re.compile(r"\b(?:" + "|".join(re.escape(t) for t in (*_FEMALE, *_MALE, *_EITHER)) + rf")\b\.? +({_PART}(?: +{_PART})*)")
_WORDS = re.compile(r"[^\W\d_]+")


@lru_cache(4096)
def _block(c: str) -> str:
    """The letters of a sign's own category among the 256 code points around it: what a letter of any other script maps to."""
    kind, low = unicodedata.category(c), ord(c) & ~0xFF
    return "".join(x for x in map(chr, range(low, low + 256)) if unicodedata.category(x) == kind)


def _place(c: str) -> tuple[str, int] | None:
    """The alphabet of a character and its place there."""
    if c in _PLACE:
        return _PLACE[c]
    return (_block(c), _block(c).index(c)) if c.isalpha() else None


def _permuted(n: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of range(size): a Feistel network on the next even number of bits, walked until it is in range."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        a, b = n >> half, n & mask
        for r in range(8):
            f = hmac.new(key, f"{tweak}|{half}|{r}|{b}".encode(), hashlib.sha256).digest()
            a, b = b, a ^ (int.from_bytes(f, "big") & mask)
        n = a << half | b
        if n < size:
            return n


def _layout(text: str, key: bytes, tweak: str, valid=lambda s: True) -> str:
    """The permutation among the strings with the layout of ``text`` that are as valid as it is."""
    spots = [(i, *at) for i, c in enumerate(text) if (at := _place(c))]
    shape = "".join(f"<{at[0][0]}>" if (at := _place(c)) else c for c in text)
    n, size = 0, 1
    for _, a, k in spots:
        n, size = n * len(a) + k, size * len(a)
    if size == 1:
        return text
    wanted = valid(text)
    while True:
        n = _permuted(n, size, key, f"{tweak}|{shape}")
        out, rest = list(text), n
        for i, a, _ in reversed(spots):
            rest, k = divmod(rest, len(a))
            out[i] = a[k]
        if valid("".join(out)) == wanted:
            return "".join(out)


def _luhn(s: str) -> bool:
    d = [int(c) for c in reversed(s)]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def _address(s: str) -> str:
    """The class of an address, which its surrogate keeps."""
    try:
        a = ipaddress.IPv4Address(s)
    except ValueError:
        return "none"
    return next((n for n in ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "224.0.0.0/3", "0.0.0.0/8") if a in ipaddress.IPv4Network(n)), "public")


def _refill(shape: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdecimal() else c for c in shape)


def _address_surrogate(value: str, key: bytes) -> str:
    """A permutation of all addresses of the same class."""
    kind, n = _address(value), int(ipaddress.IPv4Address(value))
    if "/" in kind:
        net = ipaddress.IPv4Network(kind)
        return str(net[_permuted(n - int(net.network_address), net.num_addresses, key, kind)])
    while True:
        n = _permuted(n, 1 << 32, key, kind)
        if _address(str(ipaddress.IPv4Address(n))) == kind:
            return str(ipaddress.IPv4Address(n))


@lru_cache(64)
def _lengths(script: str, most: int = 65) -> tuple[int, ...]:
    """How long the stem of the surrogate of a name of each length is: long enough to hold all such names, and longer than that of
    shorter names by more than endings differ, so that a stem with any ending tells the length of its name."""
    letters, consonants, vowels, female, male = _SCRIPTS[script]
    apart = abs(len(female) - len(male)) + 1
    out = [0]
    for n in range(1, most + 1):
        length, room = 0, 1
        while length < out[-1] + apart or room < len(letters) ** n:
            room *= len(vowels if length % 2 else consonants)
            length += 1
        out.append(length)
    return tuple(out)


def _script(word: str) -> str | None:
    return next((s for s, (letters, *_) in _SCRIPTS.items() if all(c in letters for c in word.lower())), None)


def is_female(word: str) -> bool:
    """Whether a name's last letter suggests a woman."""
    return word.lower()[-1:] in tuple("aeiàáâèéêìíîаяеиαηέήά")


@lru_cache(100_000)
def name_surrogate(word: str, key: bytes, female: bool | None = None) -> str:
    """A pronounceable name for one word of a name, of the gender given or suggested; words of other or several scripts permute within
    their layout."""
    script, low = _script(word), word.lower()
    if script is None or len(low) > 65:
        return _layout(word, key, "name")
    letters, consonants, vowels, her, his = _SCRIPTS[script]
    n, length = 0, _lengths(script)[len(low)]
    for c in low:
        n = n * len(letters) + letters.index(c)
    n, out = _permuted(n, len(letters) ** len(low), key, f"name|{script}|{len(low)}"), ""
    for i in range(length):
        a = vowels if i % 2 else consonants
        n, k = divmod(n, len(a))
        out += a[k]
    out += her if (is_female(low) if female is None else female) else his
    return out.upper() if word.isupper() and len(word) > 1 else out.capitalize()


@lru_cache(100_000)
def surrogate(kind: str, value: str, key: bytes) -> str:
    """The replacement of one entity (any kind but names)."""
    if kind == "ip":
        return _address_surrogate(value, key)
    if kind == "email":
        local, _, domain = value.partition("@")
        labels = domain.lower().split(".")
        mapped = [_layout(x, key, "domain") for x in labels[:-1]] + labels[-1:]
        out = _layout(local.lower(), key, "local|" + domain.lower()) + "@" + ".".join(mapped)
        return out.upper() if value.isupper() else out
    if kind in ("phone", "ssn", "card"):
        digits = re.sub(r"\D", "", value)
        keep = len(re.match(r"\+(\d{1,3})(?=[ .(-])", value)[1]) if re.match(r"\+\d{1,3}[ .(-]", value) else 0
        head, body = digits[:keep], digits[keep:]
        valid = {"card": _luhn, "phone": lambda s: len(s) == 10 and s[0] > "1" and s[3] > "1", "ssn": lambda s: s[:3] not in ("000", "666") and s[0] != "9"}[kind]
        return _refill(value, head + _layout(body, key, f"{kind}|{head or ('1' if kind == 'phone' else '')}", valid))
    if kind == "access_key":
        return value[:4] + _base36(value[4:], key)
    if kind == "iban":
        return value[:2] + _layout(value[2:], key, "iban|" + value[:2])
    return _layout(value, key, "hex") if not re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value) else _hex(value, key)


def _hex(value: str, key: bytes) -> str:
    out = format(_permuted(int(value, 16), 16 ** len(value), key, f"hex|{len(value)}"), f"0{len(value)}x")
    return out.upper() if value.isupper() else out


def _base36(value: str, key: bytes) -> str:
    n, out = _permuted(int(value, 36), 36 ** len(value), key, f"key|{len(value)}"), ""
    for _ in value:
        n, k = divmod(n, 36)
        out = (_DIGITS + _LARGE)[k] + out
    return out


def detect(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the entities of a text, in order, without overlap; each word of a name is an entity."""
    found = []
    for m in _SECRET.finditer(text):
        if any(c.isdigit() for c in m[4]):
            found.append((m.start(4), m.end(4), "secret"))
    found += [(m.start(), m.end(), "access_key") for m in _ACCESS.finditer(text) if not text[m.start() - 1 : m.start()].isalnum()]
    found += _mails(text)
    for m in _NUMBER.finditer(text):
        before = text[m.start() - 1 : m.start()]
        if before.isalnum() or before == "_" or text[m.end() : m.end() + 1].isalnum():
            continue
        kind = next(k for k in ("ip", "phone", "ssn", "card") if m[k])
        if kind == "ip" and _address(m[0]) == "none":
            continue
        found.append((m.start(), m.end(), kind))
    found += [(m.start(), m.end(), "iban") for m in _IBAN.finditer(text) if not text[m.start() - 1 : m.start()].isalnum()]
    names = genders(text)
    if names:
        found += [(m.start(), m.end(), "name") for m in _WORDS.finditer(text) if m[0] in names]
    out: list = []
    for x in sorted(found, key=lambda x: (x[0], -x[1])):
        if not out or x[0] >= out[-1][1]:
            out.append(x)
    return out


_TITLES = frozenset((*_FEMALE, *_MALE, *_EITHER))


def genders(text: str) -> dict[str, bool | None]:
    """The words of the names of a text, and whether the first title that tells a gender is a woman's."""
    out: dict = {}
    for m in _NAME.finditer(text):
        title = text[m.start() : m.start(1)].rstrip(" .")
        told = True if title in _FEMALE else False if title in _MALE else None
        for w in _WORDS.finditer(m[1]):
            if not w[0].islower() and w[0] not in _TITLES and out.get(w[0]) is None:
                out[w[0]] = told
    return out


def identity(kind: str, value: str) -> str:
    """What makes an entity the one it is, whatever its format."""
    if kind == "phone":
        code = re.match(r"\+(\d{1,3})(?=[ .(-])", value)
        digits = re.sub(r"\D", "", value)
        return f"{code[1] if code else 1}|{digits[len(code[1]) :] if code else digits}"
    if kind in ("ssn", "card"):
        return re.sub(r"\D", "", value)
    return value.lower() if kind in ("email", "name") else value


def _stem(name: str) -> str:
    """The surrogate of a name without its ending."""
    low = name.lower()
    script = _script(low)
    if script is None:
        return low
    *_, her, his = _SCRIPTS[script]
    return low.removesuffix(her) if low.endswith(her) else low.removesuffix(his)


def _mails(text: str) -> list[tuple[int, int, str]]:
    """Mail addresses: from each @ the whole local part is read back, however long."""
    out, at, low = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > low and (text[start - 1].isalnum() or text[start - 1] in "._%+-"):
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            out.append((start, domain.end(), "email"))
        low, at = at + 1, text.find("@", at + 1)
    return out


def replaced(text: str, key: bytes) -> tuple[str, list[tuple[str, str, str]]]:
    """The text with surrogates, and (kind, entity, surrogate) of each entity."""
    parts, at, entities = [], 0, []
    told = genders(text)
    for start, end, kind in detect(text):
        value = text[start:end]
        new = name_surrogate(value, key, told.get(value)) if kind == "name" else surrogate(kind, value, key)
        entities.append((kind, value, new))
        parts += [text[at:start], new]
        at = end
    return "".join([*parts, text[at:]]), entities


def with_surrogates(docs: DataFrame, key: bytes) -> DataFrame:
    """The documents with surrogate_text and entities (kind, entity, surrogate, and what makes either the one it is)."""
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("surrogate_text", "entities")]

    def work():
        def each(texts):
            results = [replaced(t, key) if isinstance(t, str) else (None, []) for t in texts]
            named = [[{"kind": k, "entity": e, "surrogate": s, "entity_id": identity(k, e), "surrogate_id": _stem(s) if k == "name" else identity(k, s)} for k, e, s in found] for _, found in results]
            yield slice(0, len(texts)), {"surrogate_text": [t for t, _ in results], "entities": named}

        return each

    return map_texts(docs, kept, "surrogate_text string, entities array<struct<kind:string,entity:string,surrogate:string,entity_id:string,surrogate_id:string>>", work)


def collisions(surrogated: DataFrame) -> DataFrame:
    """kind, value, count of surrogates of several entities of a kind, and of entities with several surrogates. Should be empty."""
    pairs = surrogated.select(F.explode("entities").alias("e")).select("e.kind", "e.entity_id", "e.surrogate_id").distinct()
    shared = pairs.groupBy("kind", F.col("surrogate_id").alias("value")).count().where("count > 1")
    return shared.union(pairs.groupBy("kind", F.col("entity_id").alias("value")).count().where("count > 1"))


def session_key(spark) -> bytes:
    """The session's key: the setting ``lexloom.surrogates.key``, or a random one, which holds for the session."""
    name = "lexloom.surrogates.key"
    if not spark.conf.get(name, None):
        spark.conf.set(name, os.urandom(32).hex())
    return spark.conf.get(name).encode()


def op3(spark, sf_dir: str) -> DataFrame:
    """Also n_collisions, over all documents: entities that share a surrogate or have several. It is 0 unless a rule is at fault."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    done = staged(with_surrogates(docs.select("doc_id", "text"), session_key(spark)).drop("text"), "surrogates")
    n = collisions(done).count()
    return done.select("doc_id", F.size("entities").cast("long").alias("n_entities"), F.array_distinct("entities.kind").alias("kinds"), F.col("surrogate_text").alias("text"), F.lit(n).cast("long").alias("n_collisions"))
