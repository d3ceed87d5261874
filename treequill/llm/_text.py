"""Vectorised word and shingle hashing shared by the operators of this subpackage.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D of the UTF-8 text, with A-Z
lower-cased: the byte form of ``[^\\x20\\x09-\\x0D]+``.  A whole batch of texts is hashed with a
handful of numpy passes; no Python object is made per word.
"""

from __future__ import annotations

import numpy as np

_SEED = np.random.Generator(np.random.PCG64(20240817))
_BYTE = _SEED.integers(1, 2**63, 256, dtype=np.uint64)
for _b in range(26):
    _BYTE[65 + _b] = _BYTE[97 + _b]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(int(_P), -1, 2**64))
_powers = np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, _P), np.full(size, _P_INV)
        up[0] = down[0] = 1
        _powers = np.cumprod(up), np.cumprod(down)
    return _powers


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per word of all texts, in order: (text number, hash, first byte, end byte) within its text."""
    sizes = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    starts = np.zeros(len(texts), dtype=np.int64)
    np.cumsum(sizes[:-1] + 1, out=starts[1:])
    joined = np.frombuffer(b" ".join(texts), dtype=np.uint8)
    if not len(joined):
        empty = np.zeros(0, dtype=np.int64)
        return empty, np.zeros(0, dtype=np.uint64), empty, empty
    space = _SPACE[joined]
    edge = np.flatnonzero(np.diff(space.astype(np.int8), prepend=np.int8(1), append=np.int8(1)))
    begin, end = edge[0::2], edge[1::2]
    up, down = _power_table(len(joined) + 1)
    sums = np.zeros(len(joined) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[joined] * up[: len(joined)], out=sums[1:])
    hashes = mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))
    owner = np.searchsorted(starts, begin, side="right") - 1
    return owner, hashes, begin - starts[owner], end - starts[owner]


_COEF = _SEED.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def shingle_hashes(owner: np.ndarray, words: np.ndarray, k: int, short_whole: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, hash, index of the first word) of every run of k words within one text.

    With ``short_whole`` a text of 1 to k-1 words gives its whole sequence as one shingle.
    """
    n = len(words)
    if n >= k:
        last = n - k + 1
        acc = np.zeros(last, dtype=np.uint64)
        for j in range(k):
            acc += words[j : j + last] * _COEF[j]
        ok = owner[:last] == owner[k - 1 :]
        at = np.flatnonzero(ok)
        who, val = owner[at], mix(acc[at])
    else:
        at, who, val = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    if not short_whole or not n:
        return who, val, at
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    count = np.diff(first, append=n)
    extra = first[count < k]
    if len(extra):
        lengths = count[count < k]
        acc = np.full(len(extra), np.uint64(7)) * lengths.astype(np.uint64)
        for j in range(k - 1):
            has = lengths > j
            acc[has] += words[extra[has] + j] * _COEF[32 + j]
        who, val, at = np.concatenate([who, owner[extra]]), np.concatenate([val, mix(acc)]), np.concatenate([at, extra])
        order = np.argsort(at, kind="stable")
        who, val, at = who[order], val[order], at[order]
    return who, val, at


def distinct_per_text(who: np.ndarray, val: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text, concatenated, and the offsets (texts + 1 of them)."""
    order = np.lexsort((val, who))
    who, val = who[order], val[order]
    if len(who):
        new = np.ones(len(who), dtype=bool)
        new[1:] = (who[1:] != who[:-1]) | (val[1:] != val[:-1])
        who, val = who[new], val[new]
    return val, np.searchsorted(who, np.arange(texts + 1))


def encode(text: str | None) -> bytes:
    """UTF-8 of a text; None is empty, lone surrogates (not valid text) become '?'."""
    return b"" if text is None else text.encode("utf-8", "replace")


def squeeze(values: np.ndarray, width: int = 4) -> bytes:
    """Unsigned numbers of ``width`` bytes, byte by byte of all of them, compressed: small numbers take little."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes())


def unsqueeze(data: bytes, width: int = 4) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    out[:, :width] = planes.T
    return out.view("<i8").ravel()
