"""Operator 9, media columns: GIF images in a binary column, with decoded timed frames and colour histograms.

The decoder follows GIF89a: logical screen, global and local palettes, LZW code streams with growing codes, clear
and end codes and deferred clears, interlacing, delays, disposal (leave, background, previous) and transparency.
Payload bytes are stored as samples of a 256-grey palette, so a frame's indexes are the payload again.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from methylake.llm.common import id_text, map_arrow, map_batches

#: Samples in a row of a stored payload, and rows of a frame at most.
WIDTH, ROWS = 576, 64
#: Hundredths of a second that a stored frame is shown.
DELAY = 10
#: Bins of a channel in a colour histogram.
BINS = 8
_GREY = bytes(x for v in range(256) for x in (v, v, v))
#: The grey bin, of BINS, of each bin of a colour histogram: that of its brightness.
_GREY_BIN = np.tensordot([299, 587, 114], np.indices((BINS,) * 3), 1).ravel() // 1000


# -- LZW ------------------------------------------------------------------------------------------------------


@functools.lru_cache(64)
def _ladder(least: int, count: int) -> np.ndarray:
    """Bits of the first `count` codes after a clear code, as a decoder reads them: its table has `clear + 2` entries
    at the first code and one more at each later one, 4096 at most."""
    entries = (1 << least) + 1 + np.arange(count)
    return np.clip(np.floor(np.log2(entries)).astype(np.int64) + 1, least + 1, 12)


def _widths(least: int, count: int) -> np.ndarray:
    size = 4200
    while size < count:
        size *= 4
    return _ladder(least, size)[:count]


def lzw_encode(samples: bytes, least: int = 8) -> bytes:
    """A code stream, not yet in sub-blocks: clear, codes, clear at a full table, end."""
    clear, end = 1 << least, (1 << least) + 1
    runs: list[list[int]] = []
    codes, table, free = [], {}, end + 1
    if samples:
        run = samples[0]
        get = table.get
        for c in samples[1:]:
            key = run << 8 | c
            known = get(key)
            if known is not None:
                run = known
                continue
            codes.append(run)
            run = c
            table[key] = free
            free += 1
            if free == 4096:
                codes.append(clear)
                runs.append(codes)
                codes, table, free = [], {}, end + 1
                get = table.get
        codes.append(run)
    codes.append(end)
    runs.append(codes)
    values, bits = [np.array([clear])], [np.array([least + 1])]
    for codes in runs:
        values.append(np.array(codes))
        bits.append(_widths(least, len(codes)))
    value, bit = np.concatenate(values), np.concatenate(bits)
    ends = np.cumsum(bit)
    begin = ends - bit
    value = value << (begin & 7)  # at most 19 bits: parts of three bytes, each bit in one code's part only
    size = (int(ends[-1]) + 7) // 8
    out = sum(np.bincount((begin >> 3) + i, weights=value >> 8 * i & 255, minlength=size + 3) for i in range(3))
    return out[:size].astype(np.uint8).tobytes()


def lzw_decode(stream: bytes, least: int, most: int) -> bytes:
    """The samples of a code stream, `most` at most; stops at the end code or where the stream ends."""
    clear, end = 1 << least, (1 << least) + 1
    raw = np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.int64)
    triple = raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16
    bits = 8 * len(stream)
    root = [bytes([i]) for i in range(clear)] + [b"", b""]
    out: list[bytes] = []
    size = at = 0
    ahead = 4200
    while size < most:
        # codes up to the next clear or end code, read together with the widths that they have until then
        width = _widths(least, ahead)
        begin = at + np.cumsum(width) - width
        n = int(np.searchsorted(begin + width, bits, "right"))
        if not n:
            break
        values = triple[begin[:n] >> 3] >> (begin[:n] & 7) & ((1 << width[:n]) - 1)
        stops = np.flatnonzero((values == clear) | (values == end))
        stop = int(stops[0]) if len(stops) else n
        table, last = root.copy(), None
        add, give, full = table.append, out.append, 4096 - len(root)
        for code in values[:stop].tolist():
            if last is None:
                last = table[code]
                give(last)
                continue
            if code < len(table):
                now = table[code]
            elif code == len(table):
                now = last + last[:1]
            else:
                raise ValueError("LZW code beyond the table")
            give(now)
            if full:
                add(last + now[:1])
                full -= 1
            last = now
        size = sum(map(len, out[-stop:])) + size if stop else size
        if stop < n:
            at = int(begin[stop] + width[stop])
            ahead = 4200
            if values[stop] == end:
                break
        elif n < ahead:
            break
        else:  # a table kept full: read on further from the same clear code
            out = out[: len(out) - stop]
            size = sum(map(len, out))
            ahead *= 4
    return b"".join(out)[:most]


# -- container ------------------------------------------------------------------------------------------------


@dataclass
class Frame:
    """An image of a file: where it is, how long it is shown, its samples and the screen after it is drawn."""

    left: int
    top: int
    width: int
    height: int
    delay: int
    disposal: int
    transparent: int | None
    samples: np.ndarray = field(repr=False)
    screen: np.ndarray = field(repr=False)  # (height, width, 4), alpha 0 or 255


def _blocks(data: bytes) -> bytes:
    """data in sub-blocks of 255 bytes and an end block."""
    return b"".join(bytes([len(x)]) + x for x in (data[i : i + 255] for i in range(0, len(data), 255))) + b"\0"


def _gather(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while n := data[at]:
        parts.append(data[at + 1 : at + 1 + n])
        at += n + 1
    return b"".join(parts), at + 1


def store(payload: bytes) -> bytes:
    """A GIF whose frames hold payload, a multiple of WIDTH bytes, ROWS rows a frame."""
    rows = len(payload) // WIDTH
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(rows, ROWS), 0xF7, 0, 0), _GREY]
    for first in range(0, rows, ROWS):
        n = min(ROWS, rows - first)
        out.append(b"\x21\xf9\x04" + struct.pack("<BHBB", 1 << 2, DELAY, 0, 0))
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, WIDTH, n, 0) + b"\x08")
        out.append(_blocks(lzw_encode(payload[first * WIDTH : (first + n) * WIDTH])))
    return b"".join(out) + b"\x3b"


def read_frames(data: bytes, screens: bool = True):
    """Yields the frames of a GIF; screen is None without screens."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    at, palette = 13, None
    if flags & 0x80:
        n = 2 << (flags & 7)
        palette = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
        at += 3 * n
    screen = np.zeros((height, width, 4), np.uint8) if screens else None
    delay, disposal, transparent = 0, 0, None
    while at < len(data) and data[at] != 0x3B:
        kind = data[at]
        if kind == 0x21:
            label = data[at + 1]
            body, at = _gather(data, at + 2)
            if label == 0xF9 and len(body) >= 4:
                disposal, delay = body[0] >> 2 & 7, struct.unpack_from("<H", body, 1)[0]
                transparent = body[3] if body[0] & 1 else None
        elif kind == 0x2C:
            left, top, w, h, own = struct.unpack_from("<HHHHB", data, at + 1)
            at += 10
            colours = palette
            if own & 0x80:
                n = 2 << (own & 7)
                colours = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
                at += 3 * n
            least = data[at]
            stream, at = _gather(data, at + 1)
            raw = lzw_decode(stream, least, w * h)
            if len(raw) < w * h:
                raise ValueError(f"a frame of {w * h} samples has only {len(raw)}")
            samples = np.frombuffer(raw, np.uint8).reshape(h, w)
            if own & 0x40:
                order = np.concatenate([np.arange(0, h, 8), np.arange(4, h, 8), np.arange(2, h, 4), np.arange(1, h, 2)])
                plain = np.empty_like(samples)
                plain[order] = samples
                samples = plain
            shown = None
            if screens:
                if colours is None:
                    raise ValueError("a frame without a palette")
                before = screen.copy() if disposal == 3 else None
                area = screen[top : top + h, left : left + w]
                seen = samples[: area.shape[0], : area.shape[1]]
                drawn = np.ones(seen.shape, bool) if transparent is None else seen != transparent
                area[drawn, :3] = colours[np.minimum(seen[drawn], len(colours) - 1)]
                area[drawn, 3] = 255
                shown = screen.copy()
            yield Frame(left, top, w, h, delay, disposal, transparent, samples, shown)
            if screens:
                if disposal == 2:
                    screen[top : top + h, left : left + w] = 0
                elif disposal == 3:
                    screen = before
            delay, disposal, transparent = 0, 0, None
        else:
            raise ValueError(f"unknown block {kind:#x}")


def histogram(screen: np.ndarray) -> np.ndarray:
    """Counts of the drawn pixels by (red, green, blue) bin of BINS each, flat."""
    p = screen[screen[..., 3] > 0][:, :3].astype(np.int64) * BINS >> 8
    return np.bincount((p[:, 0] * BINS + p[:, 1]) * BINS + p[:, 2], minlength=BINS**3)


# -- columns --------------------------------------------------------------------------------------------------


def padded(raw: bytes) -> bytes:
    """raw with bytes 255 up to a positive multiple of WIDTH."""
    return raw + b"\xff" * (-len(raw) % WIDTH if raw else WIDTH)


def to_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, media binary): every row's text as UTF-8, padded and stored as a GIF. A null text is an empty
    one. Null ids stay null, repeated rows give repeated results, an empty table an empty one; texts are stored whole,
    in as many frames as they need; other columns are not read."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = [(t or "").encode() for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(r) for r in raw], pa.int64()), pa.array([store(padded(r)) for r in raw], pa.binary())], ["id", "n_bytes", "media"])

    return map_batches(id_text(df, id_col, text_col), make, "id long, n_bytes long, media binary").withColumnRenamed("id", id_col)


def media_frames(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """A row for each frame of every GIF: (id_col, frame, start_cs, delay_cs, left, top, width, height, disposal,
    samples binary, histogram array<long>); a null media has none."""

    def read(batches):
        for batch in batches:
            for doc, media in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, start = [], 0
                for i, f in enumerate(read_frames(media) if media is not None else ()):
                    rows.append((doc, i, start, f.delay, f.left, f.top, f.width, f.height, f.disposal, f.samples.tobytes(), histogram(f.screen).tolist()))
                    start += f.delay
                if rows:
                    kinds = [pa.int64(), *[pa.int32()] * 8, pa.binary(), pa.list_(pa.int64())]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["id", "frame", "start_cs", "delay_cs", "left", "top", "width", "height", "disposal", "samples", "histogram"])

    rows = df.select(df[id_col].cast("long").alias("id"), media_col)
    return map_arrow(rows, read, "id long, frame int, start_cs int, delay_cs int, left int, top int, width int, height int, disposal int, samples binary, histogram array<long>").withColumnRenamed("id", id_col)


#: A frame as media_digest() gives it: when and how long it is shown, where it lies, what becomes of it, and the colour
#: histogram of its own area of the rendered screen, as the bins that hold pixels and their numbers.
FRAME = "struct<start_cs:int,delay_cs:int,left:int,top:int,width:int,height:int,disposal:int,bins:array<int>,pixels:array<long>>"
_FRAME = pa.struct([*((c, pa.int32()) for c in ("start_cs", "delay_cs", "left", "top", "width", "height", "disposal")), ("bins", pa.list_(pa.int32())), ("pixels", pa.list_(pa.int64()))])


def media_digest(df: DataFrame, id_col: str = "doc_id", media_col: str = "media", size_col: str = "n_bytes") -> DataFrame:
    """Reads every stored GIF back: (id_col, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature, frames array<FRAME>). The payload is the samples of all frames. feature: frames, total
    hundredths of a second and the summed grey histogram of the frames, by the brightness of their histograms' bins.

    A null media gives nulls, one without frames an empty payload; one that is no GIF, is cut off or has codes that
    no encoder writes is an error. Null ids stay null, repeated rows give repeated results, an empty table an empty one;
    other columns are not read."""

    def read(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for media in batch.column(2).to_pylist():
            if media is None:
                rows.append((None,) * 7)
                continue
            frames, time, parts, colours = [], 0, [], np.zeros(BINS**3, np.int64)
            for f in read_frames(media):
                own = histogram(f.screen[f.top : f.top + f.height, f.left : f.left + f.width])
                bins = np.flatnonzero(own)
                frames.append({"start_cs": time, "delay_cs": f.delay, "left": f.left, "top": f.top, "width": f.width, "height": f.height, "disposal": f.disposal, "bins": bins.tolist(), "pixels": own[bins].tolist()})
                time += f.delay
                parts.append(f.samples.tobytes())
                colours += own
            payload = b"".join(parts)
            grey = np.bincount(_GREY_BIN, weights=colours, minlength=BINS).astype(np.int64)
            feature = f"frames={len(frames)};cs={time};grey={','.join(map(str, grey.tolist()))}"
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature, frames))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(_FRAME)]
        columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "frames"])

    rows = df.select(df[id_col].cast("long").alias("id"), df[size_col].cast("long").alias("n_bytes"), media_col)
    return map_batches(rows, read, f"id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, frames array<{FRAME}>").withColumnRenamed("id", id_col)
