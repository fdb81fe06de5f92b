"""Operator 8, SentencePiece encoding and decoding by weighted finite-state transducers.

Three machines are compiled from a .model file:

- the normaliser, which rewrites the longest match of the model's own map of characters (a double-array automaton over
  UTF-8 bytes), drops extra white space if the model wants it, puts the dummy prefix and escapes spaces to U+2581;
- the pieces, an automaton of numbered states over characters whose final states give a piece;
- the fallback, an arc for every character that is no piece: its bytes, or the unknown piece.

An input is run through the first, which is deterministic, and composed with the other two as the path goes: a state
of the composition is a place in the text and the piece that ended there. Encoding is the composition's shortest path
in the tropical semiring, found place by place. For a unigram model an arc weighs minus its piece's score. For a BPE
model the order of merges decides, not a sum of scores: the arc of a piece after another weighs 0 where merging the
characters of both gives exactly the two, and is infinite elsewhere. Pieces that all fit their neighbours are those
that merging the whole text gives, so every prefix has one finite path and one state is kept a place.

Where no piece holds a change between the classes of characters that a cut pattern parts (checked while compiling),
paths meet at its cuts, and each distinct segment is worked out once in a bounded dictionary.
"""

from __future__ import annotations

import math
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from methylake.llm.common import id_text, map_arrow, map_batches
from methylake.llm.pretoken import PieceCache

SPACE = "▁"
#: Cuts: runs of U+2581 with the letters, the digit or the other characters after them.
FINE = re.compile(f"{SPACE}*(?:[^\\W\\d_]+|\\d|(?:[^\\w{SPACE}]|_)+)|{SPACE}+")
COARSE = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")

# Fixed values of the .model format: kinds of model and of pieces, what an unknown character's score lies below the
# least one, and what unknown pieces decode to by default.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_PENALTY = 10.0

#: Pairs of pieces of which a worker remembers whether they fit.
PAIRS = 500_000

_STATE: dict[str, tuple] = {}


class CharacterMap:
    """The normaliser's map of characters, as the model holds it: u32 size, a double array of u32 units, and the
    rewritten strings, each ended by a zero byte."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0]
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
        self.strings = blob[4 + size :]
        self.known: dict[bytes, bool] = {}

    def longest(self, raw: bytes, at: int) -> tuple[int, bytes] | None:
        """(length, rewritten) of the longest match at a place. A unit has its label in the low 8 bits, a bit 8 for
        a value, and the place of its children by exclusive or with bits 10 and up, times 256 if bit 9 is set."""
        units, found = self.units, None
        unit = units[0]
        node = (unit >> 10) << ((unit & 0x200) >> 6)
        for i in range(at, len(raw)):
            node ^= raw[i]
            unit = units[node]
            if unit & 0x800000FF != raw[i]:
                break
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit >> 8 & 1:
                begin = units[node] & 0x7FFFFFFF
                found = (i + 1 - at, begin)
        return found and (found[0], self.strings[found[1] : self.strings.index(b"\0", found[1])])

    def rewrite(self, text: str) -> list[str]:
        """text in rewritten units, one for each match or character."""
        raw, at, out = text.encode(), 0, []
        while at < len(raw):
            match = self.longest(raw, at)
            if match:
                out.append(match[1].decode())
                at += match[0]
            else:
                end = at + 1
                while end < len(raw) and raw[end] & 0xC0 == 0x80:
                    end += 1
                out.append(raw[at:end].decode())
                at = end
        return out


class Normaliser:
    """The first machine: texts to normalised ones, spaces escaped."""

    def __init__(self, spec):
        self.map = CharacterMap(spec.precompiled_charsmap) if spec.precompiled_charsmap else None
        self.squeeze, self.prefix = spec.remove_extra_whitespaces, SPACE if spec.add_dummy_prefix else ""

    def __call__(self, text: str) -> str:
        if self.map is None and not self.squeeze:
            return self.prefix + text.replace(" ", SPACE) if text else ""
        out, after_space = [], self.squeeze
        for unit in self.map.rewrite(text) if self.map else text:
            if after_space:
                unit = unit.lstrip(" ")
            if unit:
                out.append(unit)
                after_space = self.squeeze and unit.endswith(" ")
        plain = "".join(out)
        if self.squeeze:
            plain = plain.rstrip(f" {SPACE}")
        return self.prefix + plain.replace(" ", SPACE) if plain else ""


class Pieces:
    """The compiled machines of a model."""

    def __init__(self, path: str | None = None, proto: bytes | None = None):
        from sentencepiece import sentencepiece_model_pb2 as model

        if proto is None:
            with open(path, "rb") as f:
                proto = f.read()
        m = model.ModelProto()
        m.ParseFromString(proto)
        n, t = m.normalizer_spec, m.trainer_spec
        if not n.escape_whitespaces or t.treat_whitespace_as_suffix or t.model_type not in (UNIGRAM, BPE) or any(p.type == USER for p in m.pieces):
            raise ValueError("only unigram and BPE models without user-defined pieces and with a prefixed, escaped space can be compiled")
        self.kind, self.normalise = t.model_type, Normaliser(n)
        self.ids = {p.piece: i for i, p in enumerate(m.pieces) if p.type == NORMAL}
        self.pieces = [p.piece for p in m.pieces]
        self.scores = {p.piece: p.score for p in m.pieces if p.type == NORMAL}
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(m.pieces) if p.type == BYTE}
        self.unknown = next(i for i, p in enumerate(m.pieces) if p.type == UNKNOWN)
        self.fallback = t.byte_fallback and len(self.bytes) == 256
        #: the pieces' machine: arcs of each state by character, and the piece that ends in it
        self.arcs: list[dict[str, int]] = [{}]
        self.final: list[int] = [-1]
        for piece, i in self.ids.items():
            state = 0
            for c in piece:
                if c not in self.arcs[state]:
                    self.arcs[state][c] = len(self.arcs)
                    self.arcs.append({})
                    self.final.append(-1)
                state = self.arcs[state][c]
            self.final[state] = i
        #: weights of a unigram model's arcs by piece, and of its fallback
        self.weight = [-p.score for p in m.pieces]
        self.lost = UNKNOWN_PENALTY - min(self.scores.values(), default=0.0)
        self._cuts()
        self.fits: dict[int, bool] = {}
        self.histories: dict[str, tuple[bool, list[float], list[str], list[str]]] = {}
        self.out = [b""] * len(m.pieces)
        for i, p in enumerate(m.pieces):
            if p.type == BYTE:
                self.out[i] = bytes([int(p.piece[1:-1], 16)])
            elif p.type == UNKNOWN:
                self.out[i] = t.unk_surface.encode()
            elif p.type != CONTROL:
                self.out[i] = p.piece.replace(SPACE, " ").encode()

    def _cuts(self) -> None:
        """Chooses the cut pattern: the coarse one, where all pieces lie within its segments; of BPE models with byte
        fallback, whose segments don't touch each other, the fine one for texts without a piece that it would part."""
        coarse = SPACE in self.ids and all(COARSE.fullmatch(p) for p in self.ids)
        self.cut = COARSE if coarse else None
        self.odd = [p for p in self.ids if not FINE.fullmatch(p)]
        self.fine = coarse and self.kind == BPE and self.fallback

    def history(self, p: str) -> tuple[bool, list[float], list[str], list[str]]:
        """Merging the characters of p, best score first and leftmost of equal ones: (does it end in p alone, the
        merges' scores, first symbol before each merge and at the end, last symbol likewise)."""
        known = self.histories.get(p)
        if known is None:
            parts, scores, done, first, last = [*p], self.scores, [], [p[0]], [p[-1]]
            while True:
                best, where = None, -1
                for i in range(len(parts) - 1):
                    s = scores.get(parts[i] + parts[i + 1])
                    if s is not None and (best is None or s > best):
                        best, where = s, i
                if best is None:
                    break
                parts[where : where + 2] = [parts[where] + parts[where + 1]]
                done.append(best)
                first.append(parts[0])
                last.append(parts[-1])
            known = self.histories[p] = (len(parts) == 1, done, first, last)
        return known

    def merges_to(self, a: str, b: str) -> bool:
        """Whether merging the characters of a + b gives a and b. Merges inside a and inside b run as in each alone;
        at every point the best of the next one in a, the next one across and the next one in b comes, left before
        right when equal, and none across may come."""
        ok_a, sa, _, last = self.history(a)
        ok_b, sb, first, _ = self.history(b)
        if not (ok_a and ok_b):
            return False
        i = j = 0
        get, least = self.scores.get, -math.inf
        while True:
            x = sa[i] if i < len(sa) else least
            y = sb[j] if j < len(sb) else least
            across = get(last[i] + first[j])
            if across is not None and across > x and across >= y:
                return False
            if x == least and y == least:
                return True
            if x >= y:
                i += 1
            else:
                j += 1

    def fit(self, a: int, b: int) -> bool:
        """Whether the arc of piece b after piece a weighs 0; -1 is the text's begin or an unknown character, which
        merges with nothing."""
        key = a * len(self.pieces) + b
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) >= PAIRS:
                self.fits.clear()
            known = self.fits[key] = self.merges_to(self.pieces[a], self.pieces[b]) if a >= 0 else self.history(self.pieces[b])[0]
        return known

    def shortest(self, s: str) -> list[tuple[int, int]]:
        """(piece or -1 for an unknown character, where it ends) along the shortest path through a segment."""
        n, arcs, final, fit, unigram = len(s), self.arcs, self.final, self.fit, self.kind == UNIGRAM
        cost: list[float] = [0.0, *[math.inf] * n]
        ended, begun = [-1] * (n + 1), [0] * (n + 1)
        for at in range(n):
            here, last = cost[at], ended[at]
            if here == math.inf:
                continue
            state, end = arcs[0].get(s[at]), at + 1
            if state is None or final[state] < 0:
                # the fallback's arc
                there = here + (self.lost if unigram else 0.0)
                if there < cost[end]:
                    cost[end], ended[end], begun[end] = there, -1, at
            while state is not None:
                piece = final[state]
                if piece >= 0:
                    if unigram:
                        there = here + self.weight[piece]
                        if there < cost[end]:
                            cost[end], ended[end], begun[end] = there, piece, at
                    elif cost[end] and fit(last, piece):
                        cost[end], ended[end], begun[end] = 0.0, piece, at
                if end == n:
                    break
                state = arcs[state].get(s[end])
                end += 1
        path, at = [], n
        while at:
            path.append((ended[at], at))
            at = begun[at]
        return path[::-1]

    def encode_segment(self, s: str) -> bytes:
        """Ids of a segment as little-endian int32 bytes, unknown characters as bytes or, without fallback, one unknown id a run."""
        ids: list[int] = []
        lost = False
        for piece, end in self.shortest(s):
            if piece >= 0:
                ids.append(piece)
            elif self.fallback:
                ids += [self.bytes[b] for b in s[end - 1].encode()]
            elif not lost:
                ids.append(self.unknown)
            lost = piece < 0
        return np.array(ids, "<i4").tobytes()

    def segments(self, text: str) -> list[str]:
        s = self.normalise(text)
        if not s:
            return []
        if self.cut is None:
            return [s]
        return (FINE if self.fine and not any(p in s for p in self.odd) else self.cut).findall(s)

    def decode(self, ids) -> str:
        """The text of ids. The escaped space that begins the first piece falls away with a dummy prefix or squeezing;
        with squeezing, if nothing is left of the piece, so does that of the next one."""
        parts = [*map(self.out.__getitem__, ids)]
        if self.normalise.prefix or self.normalise.squeeze:
            for i, piece in enumerate(ids):
                if not self.pieces[piece].startswith(SPACE):
                    break
                parts[i] = parts[i][1:]
                if parts[i] or not self.normalise.squeeze:
                    break
        return b"".join(parts).decode("utf-8", "replace")


def _state(path: str) -> tuple[Pieces, PieceCache]:
    if path not in _STATE:
        pieces = Pieces(path)
        _STATE[path] = (pieces, PieceCache(pieces.encode_segment))
    return _STATE[path]


def encode_texts(texts: list[str], path: str) -> list[bytes]:
    pieces, cache = _state(path)
    get, join = cache.__getitem__, b"".join
    return [join(map(get, pieces.segments(t))) for t in texts]


def encode_pieces(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids array<int>) for every row of df, as the model's own library encodes the text.

    A null or empty text has no ids. Null ids stay null, repeated rows give repeated results, an empty table an
    empty one; texts are encoded whole; other columns are not read. Nothing is shuffled.
    """

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        blobs = encode_texts([t or "" for t in batch.column(1).to_pylist()], path)
        at = np.concatenate([[0], np.cumsum([len(b) // 4 for b in blobs])]).astype(np.int32)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(at), pa.array(np.frombuffer(b"".join(blobs), "<i4")))], ["id", "ids"])

    return map_batches(id_text(df, id_col, text_col), encode, "id long, ids array<int>").withColumnRenamed("id", id_col)


def decode_pieces(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, text) for every row of df (id_col, ids_col array<int>). Null ids give a null text, none an empty one;
    null row ids stay null, repeated rows give repeated results, an empty table an empty one; other columns are not
    read. Bytes that are no UTF-8 become U+FFFD."""

    def decode(batch: pa.RecordBatch) -> pa.RecordBatch:
        pieces, _ = _state(path)
        column = batch.column(1)
        flat, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_pylist()
        texts = [pieces.decode(flat[a:b].tolist()) if ok else None for a, b, ok in zip(at[:-1], at[1:], column.is_valid().to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return map_batches(rows, decode, "id long, text string").withColumnRenamed("id", id_col)


def with_pieces(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """df with its texts replaced by what their ids decode to and a last column of those ids (array<int>), which
    replaces a column of that name in any case. A null text stays null and has no ids, an empty one has none either;
    texts are encoded whole, repeated rows give repeated results, an empty table an empty one."""
    df = df.select(*(F.col(f"`{c}`") for c in df.columns if c.lower() != ids_col.lower()))
    at = df.columns.index(text_col)

    def run(batches):
        for batch in batches:
            pieces, _ = _state(path)
            texts = batch.column(at).to_pylist()
            blobs = encode_texts([t or "" for t in texts], path)
            begin = np.concatenate([[0], np.cumsum([len(b) // 4 for b in blobs])]).astype(np.int32)
            decoded = [None if t is None else pieces.decode(np.frombuffer(b, "<i4").tolist()) for t, b in zip(texts, blobs, strict=True)]
            columns = [*batch.columns, pa.ListArray.from_arrays(pa.array(begin), pa.array(np.frombuffer(b"".join(blobs), "<i4")))]
            columns[at] = pa.array(decoded, batch.column(at).type)
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, ids_col])

    return map_arrow(df, run, StructType([*df.schema.fields, StructField(ids_col, ArrayType(IntegerType()))]))


def piece_round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_pieces, ids_crc32, text, text_crc32, n_bytes) for every row of df: texts encoded to ids and decoded back.

    ids_crc32: of the ids as little-endian 32-bit integers; text: the decoded one; text_crc32 and n_bytes: of its
    UTF-8 bytes. Encoding and decoding run in one stage over a batch, ids being passed on as they are.
    """
    def both(batch: pa.RecordBatch) -> pa.RecordBatch:
        pieces, _ = _state(path)
        blobs = encode_texts([t or "" for t in batch.column(1).to_pylist()], path)
        texts = [pieces.decode(np.frombuffer(b, "<i4").tolist()) for b in blobs]
        raw = [t.encode() for t in texts]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(b) // 4 for b in blobs], pa.int64()), pa.array([zlib.crc32(b) for b in blobs], pa.int64()), pa.array(texts, pa.string()), pa.array([zlib.crc32(b) for b in raw], pa.int64()), pa.array([len(b) for b in raw], pa.int64())],
            ["id", "n_pieces", "ids_crc32", "text", "text_crc32", "n_bytes"],
        )

    return map_batches(id_text(df, id_col, text_col), both, "id long, n_pieces long, ids_crc32 long, text string, text_crc32 long, n_bytes long").withColumnRenamed("id", id_col)
