"""Words of many texts at once, as numpy arrays with 64-bit hashes."""

from __future__ import annotations

import numpy as np

#: Bytes to lower case, and all that is no word byte (0-9, a-z, 0x80 and up) to a space.
ALNUM = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

#: Longer words are hashed one by one; shorter ones in blocks of about BLOCK bytes.
LONG, BLOCK = 4096, 1 << 20
_BASE, _M1, _M2 = 0x9E3779B97F4A7C15, np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_POWERS = np.cumprod(np.full(LONG, _BASE, np.uint64), dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on all bits."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def split(buffer: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a buffer in which spaces part words."""
    inside = np.zeros(len(buffer) + 2, bool)
    np.not_equal(np.frombuffer(buffer, np.uint8), 32, out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def hashes(buffer: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial in its bytes, mixed with its length."""
    import xxhash
    chars = np.frombuffer(buffer, np.uint8)
    lengths = ends - starts
    out = np.zeros(len(starts), np.uint64)
    for i in np.flatnonzero(lengths > LONG).tolist():
        out[i] = xxhash.xxh64_intdigest(buffer[starts[i]:ends[i]])
    short = np.flatnonzero(lengths <= LONG)
    total = np.cumsum(lengths[short])
    cuts = np.searchsorted(total, np.arange(BLOCK, total[-1] + BLOCK, BLOCK)) + 1 if len(short) else []
    for part in np.split(short, cuts):
        if not len(part):
            continue
        n = lengths[part]
        first = np.cumsum(n) - n
        within = np.arange(n.sum()) - np.repeat(first, n)
        value = (chars[np.repeat(starts[part], n) + within].astype(np.uint64) + np.uint64(1)) * _POWERS[within]
        out[part] = mix(np.add.reduceat(value, first) ^ n.astype(np.uint64))
    return out


def word_table(texts: list[bytes], table: bytes = ALNUM) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The folded buffer of all texts, and of each word its text's number, start, end and hash."""
    buffer = b" ".join(texts).translate(table)
    starts, ends = split(buffer)
    borders = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
    return buffer, np.searchsorted(borders, starts, side="right"), starts, ends, hashes(buffer, starts, ends)


def distinct(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each distinct (doc, hash) in an order by doc, and how often it occurs."""
    if not len(doc):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = (doc.astype(np.uint64) << np.uint64(48)) | (h >> np.uint64(16))
    order = np.argsort(key, kind="stable") if doc[-1] < 1 << 16 else np.lexsort((h, doc))
    d, s = doc[order], h[order]
    new = np.r_[True, (s[1:] != s[:-1]) | (d[1:] != d[:-1])]
    first = np.flatnonzero(new)
    if doc[-1] < 1 << 16 and len(first) != np.count_nonzero(np.r_[True, np.diff(key[order]) != 0]):
        order = np.lexsort((h, doc))  # two hashes of one document agree in 48 bits
        d, s = doc[order], h[order]
        first = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) | (d[1:] != d[:-1])])
    return order[first], np.diff(np.r_[first, len(order)])
