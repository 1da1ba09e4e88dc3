"""Vectorised kernels over batches of UTF-8 texts."""

from collections.abc import Iterator, Sequence

import numpy as np

U = np.uint64
_MULT, _INV = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2**64)
_VALUE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_powers: list = []


def _flags(*spans: tuple[int, int]) -> np.ndarray:
    out = np.ones(256, bool)
    for a, b in spans:
        out[a : b + 1] = False
    return out


#: Bytes of words: all but blank and the ASCII white space; all but ASCII that is no digit or lower-case letter.
PLAIN_WORD = _flags((0x20, 0x20), (0x09, 0x0D))
ALNUM_WORD = _flags((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def utf8(text) -> bytes:
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


def groups(sizes: Sequence[int], most: int) -> Iterator[slice]:
    """Consecutive slices whose sizes sum to at most ``most``; a larger item stands alone."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield slice(start, len(sizes))


def joined(raw: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts, each followed by a newline, and where each begins (with the end as last)."""
    off = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(b) + 1 for b in raw], out=off[1:])
    return np.frombuffer(b"\n".join(raw) + b"\n" * bool(raw), np.uint8), off


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the hash's multiplier and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, min(1 << 21, 1 << max(16, n.bit_length())))  # the driver hashes short texts only, and keeps the tables
        with np.errstate(over="ignore"):
            _powers[:] = [np.cumprod(np.r_[U(1), np.full(size - 1, U(m))]) for m in (_MULT, _INV)]
    return _powers[0][:n], _powers[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread a hash over all 64 bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(31))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(29))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(32))


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Sums by which ``span_hash`` finds the hash of any span in constant time."""
    up, _ = powers(len(buf) + 1)
    out = np.zeros(len(buf) + 1, U)
    with np.errstate(over="ignore"):
        np.cumsum(_VALUE[buf] * up[: len(buf)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans; equal bytes have equal hashes wherever they stand."""
    _, down = powers(len(sums))
    with np.errstate(over="ignore"):
        return mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(U) * U(0xD6E8FEB86659FD93))


def words(raw: Sequence[bytes], is_word: np.ndarray, lower: bool = True):
    """(hash, owner, start, end) of each word in the batch; start and end are offsets within its text."""
    buf, off = joined(raw)
    if not len(buf):
        none = np.zeros(0, np.int64)
        return none.astype(U), none, none, none
    if lower:
        buf = LOWER[buf]
    edges = np.diff(np.r_[False, is_word[buf], False].view(np.int8))
    start, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    owner = np.searchsorted(off, start, "right") - 1
    return span_hash(prefix_hash(buf), start, end), owner, start - off[owner], end - off[owner]


def shingles(word: np.ndarray, owner: np.ndarray, n_owners: int, n: int):
    """(owner, hash) of the distinct n-word shingles; a shorter, non-empty text is one shingle. Sorted by owner, then hash."""
    counts = np.bincount(owner, minlength=n_owners)
    first = np.r_[0, np.cumsum(counts)[:-1]]
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(0, len(word) - n + 1), U)
        for j in range(n):
            rolled = rolled * U(0xD1342543DE82EF95) + word[j : j + len(rolled)]
        keep = owner[: len(rolled)] == owner[n - 1 : n - 1 + len(rolled)]
        own, hashes = [owner[: len(rolled)][keep]], [mixed(rolled[keep])]
        for i in np.flatnonzero((counts > 0) & (counts < n)):
            h = U(int(counts[i]))
            for w in word[first[i] : first[i] + counts[i]]:
                h = h * U(0xD1342543DE82EF95) + w
            own.append(np.array([i]))
            hashes.append(mixed(np.array([h], U)))
    own, hashes = np.concatenate(own), np.concatenate(hashes)
    order = np.lexsort((hashes, own))
    own, hashes = own[order], hashes[order]
    new = np.r_[True, (own[1:] != own[:-1]) | (hashes[1:] != hashes[:-1])][: len(own)]
    return own[new], hashes[new]
