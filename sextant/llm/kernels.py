"""Vectorised hashing kernels over byte buffers (numpy, no Spark)."""

from __future__ import annotations

import hashlib

import numpy as np

U = np.uint64
#: Odd multipliers of two hashes, and what they are multiplied with for 1.
_R = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_RINV = tuple(pow(r, -1, 1 << 64) for r in _R)
#: A hash of 96 bits.
WIDE = np.dtype([("hi", "<u8"), ("lo", "<u4")])
#: Words of more bytes than this are hashed by a digest.
LONG_WORD = 32


def _seeded(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 64, n, dtype=np.uint64)


#: A random 64-bit value for each byte.
BYTE_VALUES = _seeded(256, 1)
#: Separators of words in the contracts that use ``[^\x20\x09-\x0D]+``.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a multiplier and of its inverse, at least ``n`` of each: the
    largest tables that were asked for are kept."""
    if which not in _tables or len(_tables[which][0]) < n:
        size = max(1 << 12, 1 << (n - 1).bit_length())
        up, down = np.full(size, _R[which], np.uint64), np.full(size, _RINV[which], np.uint64)
        up[0] = down[0] = 1
        _tables[which] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return _tables[which]


def prefix(values: np.ndarray, which: int = 0) -> np.ndarray:
    """Prefix sums of value * R^position, modulo 2^64; one longer than ``values``.

    Sums of this kind have a weakness: of two values, arranged as in the Thue-Morse
    sequence, and the same with the values exchanged, the sums are equal from some
    length on, whatever R.  So values must not be symbols that a text can arrange at
    will, but mixed from several neighbours (``mixed``), or sequences short."""
    n = len(values)
    out = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers(n + 1, which)[0][:n], out=out[1:])
    return out


def mixed_bytes(data: np.ndarray) -> np.ndarray:
    """For each byte a value of it and the seven bytes after it (none: zeros)."""
    padded = np.concatenate([data, np.zeros(7, np.uint8)])
    return mix(np.ndarray(len(data), "<u8", padded, strides=(1,)) + U(0x632BE59BD9B4E019))


def mixed_pairs(values: np.ndarray) -> np.ndarray:
    """For each value a mixture of it and the one after it (none: 0)."""
    after = np.zeros(len(values), np.uint64)
    after[:-1] = values[1:]
    return mix(mix(values) + after)


def unique_wide(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of ``WIDE`` hashes: places that sort them, which sorted ones are unlike the
    one before, and which of the unlike each sorted one is."""
    hi, lo = hashes["hi"], hashes["lo"]
    order = np.argsort(hi, kind="stable")
    same_hi = np.zeros(len(hi), bool)
    np.equal(hi[order[1:]], hi[order[:-1]], out=same_hi[1:])
    odd = same_hi[1:] & (lo[order[1:]] != lo[order[:-1]])
    if odd.any():  # 64 bits agree and 32 do not
        order = np.lexsort((lo, hi))
        np.equal(hi[order[1:]], hi[order[:-1]], out=same_hi[1:])
        odd = same_hi[1:] & (lo[order[1:]] != lo[order[:-1]])
    new = ~same_hi
    new[1:] |= odd
    return order, new, np.cumsum(new) - 1


def spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """Hashes of [start, end): equal contents have equal hashes wherever they lie."""
    return mix((sums[end] - sums[start]) * powers(len(sums), which)[1][start] + (end - start).astype(np.uint64) * U(0xD6E8FEB86659FD93))


def rolling(sums: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of ``width`` values."""
    n = len(sums) - width
    if n <= 0:
        return np.empty(0, np.uint64)
    return mix((sums[width:] - sums[:n]) * powers(len(sums))[1][:n])


def sliding(values: np.ndarray, width: int, f: np.ufunc) -> np.ndarray:
    """f.reduce over each window of ``width`` values, for an ``f`` that may count
    a value twice: windows grow to twice their width at a time."""
    if len(values) < width:
        return values[:0]
    out, have = values.copy(), 1
    while have < width:
        step = min(have, width - have)
        out = f(out[:-step], out[step:])
        have += step
    return out


def word_bounds(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a buffer that ends with a separator."""
    gap = IS_SPACE[buffer]
    edge = np.empty(len(gap) + 1, bool)
    edge[0] = False
    if len(gap):
        edge[0] = not gap[0]
        np.not_equal(gap[1:], gap[:-1], out=edge[1:-1])
        edge[-1] = not gap[-1]
    at = np.flatnonzero(edge)
    return at[::2], at[1::2]


class Words:
    """The words of some texts: hash of each word, and where each text's begin.
    Words of over ``LONG_WORD`` bytes have a digest, as sums of long words can be
    made to agree."""

    def __init__(self, texts: list[bytes]) -> None:
        buffer = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        start, end = word_bounds(buffer)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        #: Word number where each text begins, and the number of all words.
        self.first = np.concatenate([[0], np.searchsorted(start, ends)]).astype(np.int64)
        self.hash = spans(prefix(BYTE_VALUES[buffer]), start, end)
        for i in np.flatnonzero(end - start > LONG_WORD).tolist():
            self.hash[i] = int.from_bytes(hashlib.blake2b(buffer[start[i] : end[i]], digest_size=8).digest(), "little")
        self.start, self.end = start, end

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def in_bounds(first: np.ndarray, width: int, n: int) -> np.ndarray:
    """For each of ``n`` positions, whether a window of ``width`` that starts
    there stays within its text; ``first`` has the bounds of the texts."""
    mark = np.zeros(n + 1, np.int32)
    lo, hi = first[:-1], first[1:]
    fits = hi - lo >= width
    np.add.at(mark, lo[fits], 1)
    np.add.at(mark, hi[fits] - width + 1, -1)
    return np.cumsum(mark[:n]) > 0
