"""Words of many texts at once, as 64-bit hashes, and shingles of them, in numpy on the Arrow text buffer.

A word is a run of bytes outside 0x20 and 0x09-0x0D; no UTF-8 continuation byte lies there. Hashes depend on
the bytes alone, so every machine and partitioning gives the same ones. Distinct words share a hash with a
probability of about 2**-56, so sets of hashes stand for sets of words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes that part words.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Bytes worked on at once; a longer word or text makes its own piece longer.
PIECE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit numbers that seed fixes."""
    with np.errstate(over="ignore"):
        x = (np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(0x632BE59BD9B4E019)) * np.uint64(0x9E3779B97F4A7C15)
        return mix(x) | np.uint64(1)


_PLACE = constants(4096, 1)


def _place(n: int) -> np.ndarray:
    global _PLACE
    if n > len(_PLACE):
        _PLACE = constants(max(n, 2 * len(_PLACE)), 1)
    return _PLACE


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null texts are empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, size: int = PIECE) -> list[tuple[int, int]]:
    """Ranges of whole texts of about size bytes each; a longer text has a range of its own."""
    out, first = [], 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        out.append((first, last))
        first = last
    return out


#: Bytes that part words where punctuation counts for nothing: all of ASCII but letters and digits.
PUNCTUATED = np.zeros(256, bool)
PUNCTUATED[:128] = True
for _c in b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz":
    PUNCTUATED[_c] = False


def word_bounds(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, number of the text) of all words; words never span texts."""
    inside = np.empty(len(data) + 2, bool)
    inside[0] = inside[-1] = False
    np.logical_not(between[data], out=inside[1:-1])
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    edge = inside[1:] != inside[:-1]
    starts = np.flatnonzero(edge & inside[1:])
    ends = np.flatnonzero(edge & inside[:-1])
    split = np.unique(cut[inside[cut] & inside[cut + 1]]) if len(cut) else cut
    if len(split):
        starts, ends = np.sort(np.concatenate([starts, split])), np.sort(np.concatenate([ends, split]))
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes; runs are in order, not empty, and don't overlap."""
    out = np.empty(len(starts), np.uint64)
    first = 0
    with np.errstate(over="ignore"):
        while first < len(starts):
            last = max(first + 1, int(np.searchsorted(ends, starts[first] + PIECE, "right")))
            s, n = starts[first:last], ends[first:last] - starts[first:last]
            begin = np.concatenate([[0], np.cumsum(n)[:-1]])
            place = np.arange(int(n.sum())) - np.repeat(begin, n)
            values = data[place + np.repeat(s, n)].astype(np.uint64)
            values += np.uint64(1)
            values *= _place(int(n.max()))[place]
            out[first:last] = mix(np.add.reduceat(values, begin) + n.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            first = last
    return out


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def shingles(words: np.ndarray, text: np.ndarray, n_texts: int, k: int) -> list[np.ndarray]:
    """For each text its sorted distinct shingle hashes: k words each, or the whole sequence when it is shorter."""
    weights = constants(k, 2)
    bounds = np.searchsorted(text, np.arange(n_texts + 1))
    out = []
    with np.errstate(over="ignore"):
        m = len(words) - k + 1
        full = mix(sum((words[j : j + m] * weights[j] for j in range(1, k)), words[:m] * weights[0])) if m > 0 else words[:0]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a >= k:
                x = np.sort(full[a : b - k + 1])
                out.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
            elif b > a:
                out.append(mix((words[a:b] * weights[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
            else:
                out.append(words[:0])
    return out


def shingle_sets(column: pa.Array, k: int):
    """Yields (first row, list of shingle sets) for pieces of a string column, A-Z lower-cased."""
    data, offsets = text_buffer(column)
    for a, b in pieces(offsets):
        part, at = lowered(data[offsets[a] : offsets[b]]), offsets[a : b + 1] - offsets[a]
        starts, ends, text = word_bounds(part, at)
        yield a, shingles(hash_runs(part, starts, ends), text, b - a, k)
