"""BAM: alignments in BGZF blocks, read in splits of a file whose record boundaries are checked, and written by task.

A split's first record is looked for in the first few blocks at or after its first byte. A task reads from its split's
first record up to the next split's and raises unless it ends exactly there, so a wrong guess can't lose or repeat
records. A split without a first record is read with the one before it.
"""

from __future__ import annotations

import functools
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from methylake.functions.expr import revcomp_iupac
from methylake.sources.text import whole_alignments

#: Bytes of a split, and compressed bytes that are looked at to find its first record.
SPLIT, PROBE = 64 << 20, 1 << 20
#: Rows of an Arrow batch.
ROWS = 2000

# Fixed values of the format.
MAGIC, BGZF, EOF = b"BAM\1", b"\x1f\x8b\x08\x04", bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
OPS, BASES = "MIDNSHP=X", "=ACMGRSVTWYHKDBN"
SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
WHOLE = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I"}
TAGS = ("MD", "XM", "XR", "XG", "RX", "CB", "UR")

_CORE = struct.Struct("<iiiBBHHHiiii")
_LETTERS = str.maketrans("0123456789abcdef", BASES)
SCHEMA = (
    "file string, ord long, qname string, flag int, chr string, pos long, mapq int, cigar string, rnext string, pnext long, tlen int, seq string, qual string, nm int, "
    "md string, xm string, xr string, xg string, rx string, cb string, ur string"
)
_ARROW = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}[t]) for n, t in (x.split() for x in SCHEMA.split(", "))])


def _open(uri: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)
    return system.open_input_file(path)


def _block_size(data: bytes, at: int) -> int | None:
    """Bytes of the BGZF block at a place; None where there is none."""
    if data[at : at + 4] != BGZF or len(data) < at + 12:
        return None
    extra, end = at + 12, at + 12 + struct.unpack_from("<H", data, at + 10)[0]
    while extra + 6 <= min(end, len(data)):
        n = struct.unpack_from("<H", data, extra + 2)[0]
        if data[extra : extra + 2] == b"BC" and n == 2:
            return struct.unpack_from("<H", data, extra + 4)[0] + 1
        extra += 4 + n
    return None


def _blocks(source, at: int) -> Iterator[tuple[int, bytes]]:
    """(place, bytes) of the blocks from one at a place on; the file is read in pieces of PROBE bytes."""
    data, base = b"", at
    while True:
        i = at - base
        size = _block_size(data, i)
        if size is None or i + size > len(data):
            more = source.read_at(PROBE, base + len(data)) if base + len(data) < source.size() else b""
            if not more:
                if i < len(data):
                    raise ValueError(f"no whole BGZF block at {at}")
                return
            data, base = data[i:] + more, at
            continue
        head = 12 + struct.unpack_from("<H", data, i + 10)[0]
        text = zlib.decompress(data[i + head : i + size - 8], -15)
        if zlib.crc32(text) != struct.unpack_from("<I", data, i + size - 8)[0]:
            raise ValueError(f"a damaged BGZF block at {at}")
        yield at, text
        at += size


class _Stream:
    """The bytes of blocks, with the virtual offset (block << 16 | place) of the current one."""

    def __init__(self, source, block: int = 0, within: int = 0):
        self.blocks = _blocks(source, block)
        self.data, self.at, self.block, self.next = b"", 0, block, None
        self._load()
        self.at = within

    def _load(self) -> bool:
        self.block, self.data = next(self.blocks, (None, b""))
        self.at = 0
        return self.block is not None

    def offset(self) -> int | None:
        """Of the next byte; None at the end."""
        while self.at >= len(self.data):
            if not self._load():
                return None
        return self.block << 16 | self.at

    def take(self, n: int) -> bytes:
        out = self.data[self.at : self.at + n]
        self.at += len(out)
        while len(out) < n:
            if self.offset() is None:
                raise ValueError("the file ends within a record")
            more = self.data[self.at : self.at + n - len(out)]
            self.at += len(more)
            out += more
        return out


@functools.lru_cache(4)
def _header(uri: str) -> tuple[tuple[str, ...], int | None]:
    """(reference names, virtual offset of the first record) of a file."""
    with _open(uri) as source:
        s = _Stream(source)
        if s.take(4) != MAGIC:
            raise ValueError(f"not a BAM file: {uri}")
        s.take(struct.unpack("<i", s.take(4))[0])
        names = []
        for _ in range(struct.unpack("<i", s.take(4))[0]):
            names.append(s.take(struct.unpack("<i", s.take(4))[0])[:-1].decode())
            s.take(4)
        return tuple(names), s.offset()


def _plausible(data: bytes, at: int, refs: int) -> int | None:
    """The place after the record at a place, if it can be one; its end may lie beyond data."""
    size, ref, pos, name, _, _, ops, _, n, mate, mate_pos, _ = _CORE.unpack_from(data, at)
    if not (-1 <= ref < refs and -1 <= mate < refs and pos >= -1 and mate_pos >= -1 and name > 0 and n >= 0):
        return None
    if size < 32 + name + 4 * ops + (n + 1) // 2 + n:
        return None
    text = data[at + 36 : at + 36 + name]
    if len(text) == name and (text[-1] != 0 or any(c < 33 or c > 126 for c in text[:-1])):
        return None
    return at + 4 + size


def _first_record(uri: str, begin: int, end: int) -> int | None:
    """The virtual offset of the first record of a split, as far as the next PROBE bytes show one."""
    names, first = _header(uri)
    if begin == 0:
        return first
    with _open(uri) as source:
        data = source.read_at(min(2 * PROBE, source.size() - begin), begin)
        at = data.find(BGZF)
        while 0 <= at < end - begin:
            size = _block_size(data, at)
            if size and (begin + at + size == source.size() or _block_size(data, at + size)):
                break
            at = data.find(BGZF, at + 1)
        if not 0 <= at < end - begin:
            return None
        parts, begins, seen = [], [], 0
        for place, text in _blocks(source, begin + at):
            parts.append(text)
            begins.append((seen, place))
            seen += len(text)
            if place - begin - at > PROBE:
                break
    data = b"".join(parts)
    for u in range(len(data) - 36):
        v, n = u, 0
        while v is not None and v + 36 <= len(data):
            v, n = _plausible(data, v, len(names)), n + 1
        if v is not None and n:
            start, place = max(x for x in begins if x[0] <= u)
            return place << 16 | u - start if place < end else None
    return None


def _tags(data: bytes, at: int) -> dict:
    out = {}
    while at < len(data):
        name, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind in "ZH":
            end = data.index(0, at)
            out[name] = data[at:end].decode()
            at = end + 1
        elif kind == "B":
            at += 5 + SIZES[chr(data[at])] * struct.unpack_from("<i", data, at + 1)[0]
        else:
            if kind in WHOLE:
                out[name] = struct.unpack_from("<" + WHOLE[kind], data, at)[0]
            at += SIZES[kind]
    return out


def _record(uri: str, offset: int, names: tuple[str, ...], r: bytes) -> tuple:
    ref, pos, name, mapq, _, n_ops, flag, n, mate, mate_pos, tlen = struct.unpack_from("<iiBBHHHiiii", r)
    at = 32 + name
    ops = struct.unpack_from(f"<{n_ops}I", r, at)
    at += 4 * n_ops
    seq = r[at : at + (n + 1) // 2].hex().translate(_LETTERS)[:n]
    at += (n + 1) // 2
    qual = r[at : at + n]
    t = _tags(r, at + n)
    cigar = "".join(f"{x >> 4}{OPS[x & 15]}" for x in ops) or "*"
    text = "*" if not n or qual[0] == 255 else bytes(q + 33 for q in qual).decode()
    rnext = "*" if mate < 0 else "=" if mate == ref else names[mate]
    nm = t.get("NM")
    tags = (x if isinstance(x := t.get(k), str) else None for k in TAGS)
    return uri, offset, r[32 : 32 + name - 1].decode(), flag, names[ref] if ref >= 0 else "*", pos + 1, mapq, cigar, rnext, mate_pos + 1, tlen, seq or "*", text, nm if isinstance(nm, int) else None, *tags


def _read(uri: str, begin: int, end: int | None) -> Iterator[pa.RecordBatch]:
    names, rows = _header(uri)[0], []
    with _open(uri) as source:
        s = _Stream(source, begin >> 16, begin & 0xFFFF)
        while (offset := s.offset()) is not None and (end is None or offset < end):
            rows.append(_record(uri, offset, names, s.take(struct.unpack("<i", s.take(4))[0])))
            if len(rows) == ROWS:
                yield _batch(rows)
                rows = []
        if end is not None and offset != end:
            raise ValueError(f"{uri}: a record goes over {end}, where a split was to begin; read it with larger splits")
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def bam(spark: SparkSession, path: str | list[str], mapped_only: bool = True, split: int = SPLIT) -> DataFrame:
    """Alignments of BAM files, with the columns of sources.text.sam; ord is a record's virtual offset.

    With mapped_only, unmapped records go and the others must have XM, as long as SEQ, XR and XG. Empty files of a
    header alone give no rows.
    """
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length").where("length > 0")
    cuts = files.select("file", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split).cast("long"))).alias("begin"))

    def probe(batches):
        for b in batches:
            first = [_first_record(f, x, min(x + split, n)) for f, n, x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(first, pa.int64())], ["file", "first"])

    tasks = spark.sparkContext.defaultParallelism * 4
    found = cuts.repartition(tasks, "file", "begin").mapInArrow(probe, "file string, first long").where("first is not null")
    ranges = found.withColumn("next", F.lead("first").over(Window.partitionBy("file").orderBy("first")))

    def read(batches):
        for b in batches:
            for f, begin, end in zip(*(c.to_pylist() for c in b.columns), strict=True):
                yield from _read(f, begin, end)

    out = ranges.repartition(tasks, "file", "first").mapInArrow(read, SCHEMA)
    return whole_alignments(out) if mapped_only else out


def bam_reads(records: DataFrame) -> DataFrame:
    """(file, ord, id, mate, seq, qual) of the reads in bam(mapped_only=False), as of a FASTQ file.

    Secondary and supplementary records go; reverse records are turned back; a missing quality is B for each base.
    mate is 1 or 2 for a paired read that says so, else null.
    """
    flag = F.col("flag")
    reverse = flag.bitwiseAND(16) > 0
    seq = F.when(F.col("seq") == "*", "").otherwise(F.col("seq"))
    # a quality of one base may be a star itself: Q9
    missing = (F.col("qual") == "*") & (F.length(seq) != 1)
    qual = F.when(missing, F.repeat(F.lit("B"), F.length(seq))).otherwise(F.when(reverse, F.reverse("qual")).otherwise(F.col("qual")))
    mate = F.when(flag.bitwiseAND(1) > 0, F.when(flag.bitwiseAND(64) > 0, 1).when(flag.bitwiseAND(128) > 0, 2))
    out = records.where(flag.bitwiseAND(2304) == 0)
    return out.select("file", "ord", F.col("qname").alias("id"), mate.alias("mate"), F.when(reverse, revcomp_iupac(seq)).otherwise(seq).alias("seq"), qual.alias("qual"))


def paired_reads(records: DataFrame) -> DataFrame:
    """(file, paired): whether the first primary record of each file is of a pair."""
    first = records.where(F.col("flag").bitwiseAND(2304) == 0).groupBy("file").agg(F.min_by("flag", "ord").alias("f"))
    return first.select("file", (F.col("f").bitwiseAND(1) > 0).alias("paired"))


# -- writing --------------------------------------------------------------------------------------------------


def _bgzf(data: bytes) -> bytes:
    out = []
    for i in range(0, len(data), 60_000):
        part = data[i : i + 60_000]
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = z.compress(part) + z.flush()
        out.append(BGZF + struct.pack("<IBBH2sHH", 0, 0, 255, 6, b"BC", 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part)))
    return b"".join(out)


def _bin(begin: int, end: int) -> int:
    """The smallest bin of the format's index that holds [begin, end)."""
    last = end - 1
    for level, shift in enumerate((14, 17, 20, 23, 26)):
        if begin >> shift == last >> shift:
            return ((1 << 3 * (5 - level)) - 1) // 7 + (begin >> shift)
    return 0


def _encode(row: dict, refs: dict[str, int]) -> bytes:
    ops, n = [], ""
    for c in "" if row["cigar"] == "*" else row["cigar"]:
        if c.isdigit():
            n += c
        else:
            ops.append(int(n) << 4 | OPS.index(c))
            n = ""
    seq = "" if row["seq"] == "*" else row["seq"]
    code = [max(BASES.find(c), 0) if c in BASES else 15 for c in seq.upper()] + [0] * (len(seq) % 2)
    name, ref, pos = row["qname"].encode() + b"\0", refs.get(row["chr"], -1), row["pos"] - 1
    mate = ref if row["rnext"] == "=" else refs.get(row["rnext"], -1)
    span = sum(x >> 4 for x in ops if OPS[x & 15] in "MDN=X") or 1
    body = struct.pack("<iiBBHHHiiii", ref, pos, len(name), row["mapq"], _bin(max(pos, 0), max(pos, 0) + span), len(ops), row["flag"], len(seq), mate, row["pnext"] - 1, row["tlen"])
    body += name + struct.pack(f"<{len(ops)}I", *ops) + bytes(a << 4 | b for a, b in zip(code[::2], code[1::2], strict=True))
    body += b"\xff" * len(seq) if row["qual"] == "*" else bytes(ord(c) - 33 for c in row["qual"])
    if row["nm"] is not None:
        body += b"NMi" + struct.pack("<i", row["nm"])
    body += b"".join(k.encode() + b"Z" + row[k.lower()].encode() + b"\0" for k in TAGS if row[k.lower()] is not None)
    return struct.pack("<i", len(body)) + body


def write_bam(records: DataFrame, path: str, chromosomes: list[tuple[str, int]]) -> DataFrame:
    """A BAM file for each partition of records (columns of bam()), in a folder that all executors share: (part, records).

    Run by the result's action. Rows keep their order within a partition. A part's name is its attempt's own: only the
    names in the result are of finished attempts. chromosomes, (name, length) in the header's order, go to each task.
    """
    text = "@HD\tVN:1.0\tSO:unsorted\n" + "".join(f"@SQ\tSN:{n}\tLN:{k}\n" for n, k in chromosomes)
    head = MAGIC + struct.pack("<i", len(text)) + text.encode() + struct.pack("<i", len(chromosomes))
    head += b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", k) for n, k in chromosomes)
    refs, columns = {n: i for i, (n, _) in enumerate(chromosomes)}, [f.name for f in _ARROW if f.name not in ("file", "ord")]

    def run(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        system, root = fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)
        system.create_dir(root, recursive=True)
        part, n = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.bam", 0
        with system.open_output_stream(f"{root}/{part}", compression=None) as out:
            out.write(_bgzf(head))
            for batch in batches:
                out.write(_bgzf(b"".join(_encode(r, refs) for r in batch.to_pylist())))
                n += batch.num_rows
            out.write(EOF)
        yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([n], pa.int64())], ["part", "records"])

    return records.select(*columns).mapInArrow(run, "part string, records long")
