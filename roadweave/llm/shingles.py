"""Sets of 5-word shingles as sorted 64-bit hashes, computed for many texts at once.

Word hashes come from one running sum over the bytes: with fixed random values T of the
lower-cased bytes and an odd factor P, a word's sum of T[byte] * P^place is the difference
of two sums, divided by P to the power of its start. All arithmetic is modulo 2^64.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SHINGLE = 5
#: Bytes of text that are hashed at once; a longer text is cut at white space.
CHUNK = 1 << 20

_FACTOR = 0x9E3779B97F4A7C13  # 3 modulo 8
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5], dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
_LOWER = np.arange(256) + 32 * ((np.arange(256) >= 65) & (np.arange(256) <= 90))
_VALUE = np.where(_SPACE, np.uint64(0), mixed((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _MIX[1])[_LOWER])

_powers: list[np.ndarray] = []


def _factors(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the factor and of its inverse, at least n of each."""
    if not _powers or len(_powers[0]) < n:
        size, inverse = max(n, CHUNK + 1), pow(_FACTOR, -1, 1 << 64)
        _powers[:] = [np.multiply.accumulate(np.r_[np.uint64(1), np.full(size - 1, f, np.uint64)]) for f in (_FACTOR, inverse)]
    return _powers[0], _powers[1]


def _word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts data[bounds[i]:bounds[i+1]], and the number of words before each bound."""
    data, bounds = data[bounds[0] : bounds[-1]], bounds - bounds[0]
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    word = ~_SPACE[data]
    head, tail = word.copy(), word.copy()
    inner = bounds[(bounds > 0) & (bounds < len(data))]
    head[1:] &= ~word[:-1]
    head[inner] = word[inner]
    tail[:-1] &= ~word[1:]
    tail[inner - 1] = word[inner - 1]
    start, end = np.flatnonzero(head), np.flatnonzero(tail) + 1
    power, inverse = _factors(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * power[: len(data)], out=total[1:])
    hashes = (total[end] - total[start]) * inverse[start]
    return mixed(hashes + (end - start).astype(np.uint64) * _MIX[2]), np.searchsorted(start, bounds)


def _pieces(data: np.ndarray, begin: int, end: int) -> Iterator[tuple[int, int]]:
    """Cuts one text at white space into pieces of about CHUNK bytes; a longer word stays whole."""
    while end - begin > CHUNK:
        cut, step = begin + CHUNK, 4096
        while cut < end:
            spaces = np.flatnonzero(_SPACE[data[cut : cut + step]])
            if len(spaces):
                cut += int(spaces[0])
                break
            cut, step = min(end, cut + step), step * 2
        yield begin, cut
        begin = cut
    yield begin, end


def _of_words(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of texts whose words are hashes[first[i]:first[i+1]], and their bounds."""
    words = np.diff(first)
    n = len(hashes)
    whole = np.ones(n, bool)
    for k in range(1, SHINGLE):  # no shingle starts at a text's last four words
        at = first[1:] - k
        whole[at[at >= first[:-1]]] = False
    total = np.zeros(max(0, n - SHINGLE + 1), np.uint64)
    for k in range(SHINGLE):
        total += hashes[k : k + len(total)] * _MIX[k]
    size = np.maximum(words - SHINGLE + 1, 0)
    few = np.flatnonzero((words > 0) & (words < SHINGLE))
    size[few] = 1
    bounds = np.r_[0, np.cumsum(size)]
    tokens = np.empty(bounds[-1], np.uint64)
    long_ = np.ones(len(tokens), bool)
    long_[bounds[few]] = False
    tokens[long_] = mixed(total[whole[: len(total)]])
    for i in few:
        own = hashes[first[i] : first[i + 1]]
        tokens[bounds[i]] = mixed(np.array([(own * _MIX[: len(own)]).sum(dtype=np.uint64)]) + np.uint64(len(own)))[0]
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        tokens[a:b].sort()
    keep = np.ones(len(tokens), bool)
    keep[1:] = tokens[1:] != tokens[:-1]
    keep[bounds[:-1][size > 0]] = True
    if keep.all():
        return tokens, bounds
    return tokens[keep], np.r_[0, np.cumsum(keep)][bounds]


def shingle_sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Sets of a column of texts, in chunks: (first row, tokens, bounds).

    Row first + i has tokens[bounds[i]:bounds[i+1]], the sorted distinct hashes of its 5-word
    shingles over A-Z-lowered words; a text of fewer words has one for them all. Null and
    blank texts have none.
    """
    column = column.cast(pa.large_binary()) if column.null_count == 0 else column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return
    _, ends, held = column.buffers()
    bounds = np.frombuffer(ends, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(bounds, bounds[row] + CHUNK, side="right")) - 1)
        if bounds[stop] - bounds[row] <= CHUNK:
            found = _word_hashes(data, bounds[row : stop + 1])
        else:
            parts = [_word_hashes(data, np.array(p))[0] for p in _pieces(data, int(bounds[row]), int(bounds[stop]))]
            found = np.concatenate(parts), np.array([0, sum(map(len, parts))])
        yield row, *_of_words(*found)
        row = stop


def shingle_set(text: bytes | None) -> np.ndarray:
    """The set of one text."""
    return next(shingle_sets(pa.array([text or b""], pa.binary())))[1]


def print_of(tokens: np.ndarray) -> bytes | None:
    """Fingerprint of a set; the empty set has none."""
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest() if len(tokens) else None
