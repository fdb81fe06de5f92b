"""Static range asymmetric numeral system for token ids, and its file format.

A file has one frequency table for all its blocks. A block is BLOCK ids dealt in turn to LANES interleaved coder
states that share one stream of 32-bit words; the block table holds, as checkpoints, each block's number of ids,
place in the stream and final states, and checksums of its words and ids, so blocks decode independently. All
blocks of a file move in step as numpy vectors.

Layout, little-endian: magic, u32 header length, u32 header crc32, header (JSON, zlib), then the sections whose
lengths the header gives, each zlib-packed but the words: symbols, frequencies, document ids, document validity,
document lengths, block table, states, words.
"""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np

MAGIC = b"MLRANS01"
BLOCK, LANES = 1 << 16, 64
#: The lower bound of a coder's state; states keep below 2**63.
LOW = np.uint64(1 << 31)


def scaled(counts: np.ndarray, bits: int) -> np.ndarray:
    """Frequencies of at least 1 that sum to 2**bits, near in proportion to counts."""
    total, m = int(counts.sum()), 1 << bits
    f = np.maximum(1, counts.astype(np.int64) * m // total)
    order = np.argsort(-counts, kind="stable")
    rest = m - int(f.sum())
    if rest > 0:
        f[order[0]] += rest
    i = 0
    while rest < 0:
        take = min(-rest, int(f[order[i]]) - 1, max(1, int(f[order[i]]) // 2))
        f[order[i]] -= take
        rest += take
        i = (i + 1) % len(order)
    return f.astype(np.uint64)


def _encode(symbols: np.ndarray, freq: np.ndarray, bits: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """symbols (blocks, steps, lanes) -> final states (blocks, lanes), the words of each block in decoding order."""
    blocks, steps, lanes = symbols.shape
    start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
    full, shift, width = freq << np.uint64(63 - bits), np.uint64(bits), np.uint64(32)
    x = np.full((blocks, lanes), LOW)
    given, words = np.zeros((blocks, steps, lanes), bool), np.zeros((blocks, steps, lanes), np.uint32)
    for t in range(steps - 1, -1, -1):
        s = symbols[:, t]
        f = freq[s]
        over = x >= full[s]
        given[:, t] = over
        words[:, t] = x & np.uint64(0xFFFFFFFF)
        x = np.where(over, x >> width, x)
        q = x // f
        x = (q << shift) + (x - q * f) + start[s]
    return x, [words[b][given[b]] for b in range(blocks)]


def _decode(states: np.ndarray, words: np.ndarray, at: np.ndarray, steps: int, freq: np.ndarray, bits: int) -> np.ndarray:
    """The inverse: states (blocks, lanes), all words and each block's place in them -> symbols (blocks, steps, lanes)."""
    start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
    table = np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64))
    mask, shift, width = np.uint64((1 << bits) - 1), np.uint64(bits), np.uint64(32)
    words = np.concatenate([words, np.zeros(1, np.uint32)]).astype(np.uint64)
    x, at = states.copy(), at.astype(np.int64).copy()
    out = np.empty((states.shape[0], steps, states.shape[1]), np.uint32)
    for t in range(steps):
        slot = x & mask
        s = table[slot]
        out[:, t] = s
        x = freq[s] * (x >> shift) + slot - start[s]
        low = x < LOW
        rank = np.cumsum(low, axis=1)
        place = np.minimum(at[:, None] + rank - 1, len(words) - 1)
        x = np.where(low, (x << width) | words[place], x)
        at += rank[:, -1]
    return out


def _crc(a: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(a).tobytes())


def encode_file(ids: np.ndarray, doc_ids: list[int | None], lengths: np.ndarray) -> bytes:
    """The bytes of a file: ids (uint32) of documents one after another, lengths[i] of them for doc_ids[i]."""
    ids = ids.astype("<u4")
    counts = np.bincount(ids) if len(ids) and ids.max() < 1 << 24 else None
    if counts is None:
        symbols, index, counts = np.unique(ids, return_inverse=True, return_counts=True)
    else:  # without a sort
        symbols = np.flatnonzero(counts)
        place = np.zeros(len(counts), np.int64)
        place[symbols] = np.arange(len(symbols))
        index, counts = place[ids], counts[symbols]
    bits = min(22, max(12, int(len(symbols)).bit_length() + 3))
    freq = scaled(counts, bits) if len(ids) else np.zeros(0, np.uint64)
    table, states, streams = [], [], []
    whole = len(ids) // BLOCK
    parts = [(0, whole, BLOCK // LANES)] if whole else []
    if len(ids) % BLOCK:
        parts.append((whole, 1, -(-(len(ids) % BLOCK) // LANES)))
    for first, n, steps in parts:
        part = index[first * BLOCK : first * BLOCK + n * steps * LANES].astype(np.int64)
        filled = np.full(n * steps * LANES, int(np.argmax(freq)), np.int64)
        filled[: len(part)] = part
        x, words = _encode(filled.reshape(n, steps, LANES), freq, bits)
        states.append(x)
        for b, w in enumerate(words):
            own = ids[(first + b) * BLOCK : (first + b + 1) * BLOCK]
            table.append((len(own), steps, len(w), _crc(w), _crc(own)))
            streams.append(w)
    valid = np.array([d is not None for d in doc_ids], bool)
    sections = [
        np.diff(symbols.astype(np.int64), prepend=0).astype("<u4").tobytes(), freq.astype("<u4").tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.packbits(valid).tobytes(),
        np.asarray(lengths, "<u4").tobytes(), np.array(table, "<u4").tobytes(), (np.concatenate(states) if states else np.zeros((0, LANES), np.uint64)).astype("<u8").tobytes(),
    ]
    packed = [zlib.compress(s, 6) for s in sections]
    words = (np.concatenate(streams) if streams else np.zeros(0, np.uint32)).astype("<u4").tobytes()
    header = zlib.compress(json.dumps({"bits": bits, "ids": len(ids), "docs": len(doc_ids), "sections": [*map(len, packed), len(words)]}).encode())
    return b"".join([MAGIC, struct.pack("<II", len(header), zlib.crc32(header)), header, *packed, words])


class File:
    """A file behind a range reader (bytes of a length at an offset): its tables are read at once, blocks when asked for."""

    def __init__(self, read_at):
        self.read_at = read_at
        head = read_at(16, 0)
        if head[:8] != MAGIC:
            raise ValueError("not a file of this format")
        n, crc = struct.unpack_from("<II", head, 8)
        raw = read_at(n, 16)
        if zlib.crc32(raw) != crc:
            raise ValueError("broken header")
        self.header = h = json.loads(zlib.decompress(raw))
        *sizes, self.words_size = h["sections"]
        packed, at, sections = read_at(sum(sizes), 16 + n), 0, []
        for size in sizes:
            sections.append(zlib.decompress(packed[at : at + size]))
            at += size
        self.words_at = 16 + n + at
        symbols, freq, docs, valid, lengths, table, states = sections
        self.symbols = np.cumsum(np.frombuffer(symbols, "<u4").astype(np.int64)).astype(np.uint32)
        self.freq = np.frombuffer(freq, "<u4").astype(np.uint64)
        self.table = np.frombuffer(table, "<u4").reshape(-1, 5).astype(np.int64)
        self.states = np.frombuffer(states, "<u8").reshape(-1, LANES)
        self.places = np.concatenate([[0], np.cumsum(self.table[:, 2])])
        known = np.unpackbits(np.frombuffer(valid, np.uint8))[: h["docs"]]
        self.doc_ids = [d if v else None for d, v in zip(np.frombuffer(docs, "<i8").tolist(), known.tolist(), strict=True)]
        self.lengths = np.frombuffer(lengths, "<u4").astype(np.int64)

    def _decoded(self, blocks: np.ndarray, words: np.ndarray, first: int) -> list[np.ndarray]:
        """The ids of blocks of equally many steps, words beginning at the place `first`."""
        table, places = self.table, self.places - first
        for b in blocks.tolist():
            if _crc(words[places[b] : places[b + 1]]) != table[b, 3]:
                raise ValueError(f"broken words of block {b}")
        out = self.symbols[_decode(self.states[blocks], words, places[blocks], int(table[blocks[0], 1]), self.freq, self.header["bits"])].reshape(len(blocks), -1)
        found = [row[: table[b, 0]] for row, b in zip(out, blocks.tolist(), strict=True)]
        for own, b in zip(found, blocks.tolist(), strict=True):
            if _crc(own.astype("<u4")) != table[b, 4]:
                raise ValueError(f"broken ids of block {b}")
        return found

    def block(self, b: int) -> np.ndarray:
        """The ids of one block: only its words are read, and its checkpoint is where decoding begins."""
        first, last = int(self.places[b]), int(self.places[b + 1])
        words = np.frombuffer(self.read_at(4 * (last - first), self.words_at + 4 * first), "<u4")
        return self._decoded(np.array([b]), words, first)[0]

    def document(self, i: int) -> np.ndarray:
        """The ids of the i-th document, from the blocks that hold them."""
        begin = int(self.lengths[:i].sum())
        end = begin + int(self.lengths[i])
        parts = [self.block(b) for b in range(begin // BLOCK, -(-end // BLOCK))]
        first = begin // BLOCK * BLOCK
        return np.concatenate([*parts, np.zeros(0, np.uint32)])[begin - first : end - first]

    def ids(self) -> np.ndarray:
        """All ids; blocks of equally many steps are decoded together."""
        words, out = np.frombuffer(self.read_at(self.words_size, self.words_at), "<u4"), np.empty(self.header["ids"], np.uint32)
        for steps in np.unique(self.table[:, 1]).tolist():
            blocks = np.flatnonzero(self.table[:, 1] == steps)
            for own, b in zip(self._decoded(blocks, words, 0), blocks.tolist(), strict=True):
                out[b * BLOCK : b * BLOCK + len(own)] = own
        return out


def decode_file(data: bytes) -> tuple[np.ndarray, list[int | None], np.ndarray]:
    """(ids, doc_ids, lengths) of a whole file; raises ValueError where a checksum doesn't hold."""
    f = File(lambda n, at: data[at : at + n])
    return f.ids(), f.doc_ids, f.lengths
