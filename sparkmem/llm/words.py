"""Words of Arrow text columns as 64-bit hashes, found with numpy over the raw bytes.

A word is a run of ASCII letters and digits and of any non-ASCII characters; A-Z count as a-z.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_PRIME = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_PRIME, -1, 1 << 64)
#: Bytes of text looked at together (a longer text is taken alone).
_PIECE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit value for each 64-bit value (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTES = np.arange(256)
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES)
_IS_WORD = ((_BYTES >= 48) & (_BYTES <= 57)) | ((LOWER >= 97) & (LOWER <= 122)) | (_BYTES >= 128)
_VALUE = mix((LOWER + 1).astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
_powers = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, _PIECE + 1)
        for name, base in (("up", _PRIME), ("down", _INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            np.multiply.accumulate(table, out=table)
            _powers[name] = table
    return _powers["up"], _powers["down"]


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and where each text begins and ends in them."""
    wide = pa.types.is_large_string(column.type)
    _, ends, data = column.buffers()
    at = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data or b"", np.uint8)[at[0]:at[-1]], at - at[0]


def pieces(column: pa.Array):
    """(first text, last text + 1, bytes, offsets) for runs of texts of about ``_PIECE`` bytes together."""
    data, at = raw(column)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(at, at[first] + _PIECE, "right")) - 1)
        yield first, last, data[at[first]:at[last]], at[first:last + 1] - at[first]
        first = last


def word_hashes(data: np.ndarray, at: np.ndarray, stems: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """Hash, text number, first byte and end of every word of texts that lie at ``at`` in ``data``.

    With ``stems``, then also one array per length: the hash of the word's first so many bytes, 0 for words not longer.
    """
    if not len(data):
        none = np.zeros(0, np.int64)
        return (none.astype(np.uint64), none, none, none, *[none.astype(np.uint64)] * len(stems))
    inside = _IS_WORD[data]
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    after = np.empty_like(inside)
    after[:-1] = inside[1:]
    edges = at[:-1][np.diff(at) > 0]
    before[edges] = False
    after[-1] = False
    after[edges[edges > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    up, down = _power_tables(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_VALUE[data] * up[:len(data)], out=sums[1:])
    low, back = sums[starts], down[starts]
    hashes = mix((sums[ends] - low) * back)
    parts = []
    for n in stems:
        cut = np.minimum(starts + n, ends)
        parts.append(np.where(cut < ends, mix((sums[cut] - low) * back + np.uint64(n)), np.uint64(0)))
    return (hashes, np.searchsorted(at, starts, "right") - 1, starts, ends, *parts)


def word_hash(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(word_hashes(data, np.array([0, len(data)]))[0][0])
