"""Hashed words and word shingles of many texts at once, with numpy.

Words are runs of bytes other than space, tab, line feed, vertical tab, form
feed and carriage return; A-Z count as a-z.  Hashes have 64 bits.
"""

from __future__ import annotations

import numpy as np

_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, 1 << 64)
WIDTH = 5


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _byte_codes() -> np.ndarray:
    codes = mix(np.arange(1, 257, dtype="u8") * np.uint64(_FACTOR))
    codes[65:91] = codes[97:123]
    return codes


_CODES = _byte_codes()
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    if base not in _POWERS or len(_POWERS[base]) < n:
        held = np.full(max(n, 1 << 16), base, "u8")
        held[0] = 1
        _POWERS[base] = np.multiply.accumulate(held)
    return _POWERS[base][:n]


_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def word_hashes(column, letters: bool = False, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of an Arrow string column: hash of each word, offsets of the rows in the
    words, first and past-last byte of each word, and the bytes.

    ``letters``: words are runs of letters instead (bytes from 128 count as
    such, and Latin capitals with accents as small ones).  ``prefixes``: the
    first item holds one more row for each, the hash of the first so many bytes
    of each word, or 0 for shorter ones.
    """
    import pyarrow as pa

    from framesleuth.llm import encoding

    encoding.forget()
    column = column.cast(pa.string())
    offsets = np.frombuffer(column.buffers()[1], "i4")[column.offset : column.offset + len(column) + 1].astype("i8")
    data = np.frombuffer(column.buffers()[2] or b"", "u1")[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    if not len(data):
        none = np.zeros(0, "i8")
        return np.zeros((len(prefixes) + 1, 0) if prefixes else 0, "u8"), np.zeros(len(offsets), "i8"), none, none, data
    word = ~_SPACE[data]
    if letters:
        word = _LETTERS[data]
        capital = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)) + 1
        data = data.copy()
        data[capital] += 0x20
    first, last = word.copy(), word.copy()
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    starts_row = np.zeros(len(data), bool)
    starts_row[edge] = True
    first[1:] &= ~word[:-1] | starts_row[1:]
    last[:-1] &= ~word[1:] | starts_row[1:]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    total = np.zeros(len(data) + 1, "u8")
    np.add.accumulate(_CODES[data] * _powers(_FACTOR, len(data)), out=total[1:])
    back, lengths = _powers(_INVERSE, len(data))[begin], end - begin

    def hashed(n):
        return mix((total[begin + n] - total[begin]) * back + n.astype("u8") * np.uint64(0xD6E8FEB86659FD93))

    hashes = hashed(lengths)
    if prefixes:
        cut = [np.where(lengths >= n, mix(hashed(np.minimum(lengths, n)) + np.uint64(n)), np.uint64(0)) for n in prefixes]
        hashes = np.stack([hashes, *cut])
    return hashes, np.searchsorted(begin, offsets), begin, end, data


def shingle_sets(column, width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct hashes of the ``width``-word shingles of each row.

    A row with fewer words has its whole sequence as the only shingle; a row
    without words, or null, has none.
    """
    words, rows, *_ = word_hashes(column)
    salts = mix(np.arange(1, width + 1, dtype="u8") * np.uint64(_FACTOR)) | np.uint64(1)
    n = max(0, len(words) - width + 1)
    joined = np.zeros(n, "u8")
    for k in range(width):
        joined += words[k : k + n] * salts[k]
    joined = mix(joined)
    out = []
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(joined[a : b - width + 1]))
        elif b > a:
            out.append(mix(np.add.reduce(words[a:b] * salts[: b - a], keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, "u8"))
    return out
