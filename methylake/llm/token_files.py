"""Operator 7, token-id output: whole texts as ids in rANS files (see rans.py), and reading them back.

Documents are range-partitioned by id, so files in the order of (partition, file) hold ids in ascending order. Each
distinct word of a worker is encoded once by the tokenizers library, in a dictionary of bounded size. A file holds
about FILE_IDS ids, so a task's memory is bounded, whatever its partition.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from methylake.llm.common import attempt_name, filesystem, fresh_dir, id_text, map_arrow, write_file, written
from methylake.llm.pretoken import WORD_END, PieceCache, byte_level, library_pieces, load, lower_plain, special_cutter, specials_of
from methylake.llm.rans import decode_file, encode_file

#: Ids after which a file is closed, by default.
FILE_IDS = 1 << 21

_STATE: dict[str, tuple] = {}


def _state(path: str):
    if path not in _STATE:
        t = load(path)
        specials, tokenize = specials_of(t), t.model.tokenize
        own = {x: t.token_to_id(x).to_bytes(4, "little") for x in specials}
        join = lambda piece: b"".join([x.id.to_bytes(4, "little") for x in tokenize(piece)])
        # dictionaries of plain words and of byte-level words; no word is like a special token
        _STATE[path] = (t, specials, special_cutter(specials), PieceCache(lambda word: join(byte_level(word))), PieceCache(lambda word: own.get(word) or join(word)))
    return _STATE[path]


def encode_texts(texts: list[str], path: str) -> list[bytes]:
    """The ids of each text as little-endian uint32 bytes, as the library gives them without added special tokens."""
    tokenizer, specials, cutter, plain_words, library_words = _state(path)
    get, other, join, words = plain_words.__getitem__, library_words.__getitem__, b"".join, WORD_END.findall
    return [join(map(get, words(t.lower()))) if lower_plain(t, specials) else join(map(other, library_pieces(tokenizer, cutter, t))) for t in texts]


def write_token_files(df: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", file_ids: int | None = None) -> DataFrame:
    """Writes the ids of all documents, each followed by end_id, in ascending order of id; (part, seq, path, docs, ids)
    of each file, a finished table. Null ids come first; rows that repeat an id are ordered by a hash of the text. A file
    is closed with file_ids ids or more; a task holds one at a time."""
    spark, most = df.sparkSession, file_ids or FILE_IDS
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = id_text(df, id_col, text_col).repartitionByRange(n, F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), F.xxhash64("text"))
    folder, end = fresh_dir(spark, "token-files"), np.array([end_id], "<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, ids, chunks, held, done = attempt_name(), [], [], 0, []
        part = int(name.split("-")[0])

        def close() -> None:
            nonlocal ids, chunks, held
            target = f"{folder}/{name}-{len(done):06d}.rans"
            write_file(target, encode_file(np.frombuffer(b"".join(chunks), "<u4"), ids, np.array([len(c) // 4 for c in chunks])))
            done.append((target, len(ids), held))
            ids, chunks, held = [], [], 0

        for batch in batches:
            names, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for doc, blob in zip(names, encode_texts(texts, path), strict=True):
                ids.append(doc)
                chunks.append(blob + end)
                held += len(chunks[-1]) // 4
                if held >= most:
                    close()
        if ids:
            close()
        k = len(done)
        yield pa.RecordBatch.from_arrays(
            [pa.array([part] * k, pa.int32()), pa.array(range(k), pa.int32()), pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())],
            ["part", "seq", "path", "docs", "ids"],
        )

    return written(map_arrow(docs, write, "part int, seq int, path string, docs long, ids long"), "token-files")


def read_token_files(files: DataFrame, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """(id_col, start, n_tokens, ids_crc32[, ids]) of every document in the files, start counting the ids before it. Null
    ids and repeated documents come as they were written, no files give an empty table, a broken file is an error."""
    spark = files.sparkSession
    # parts are the write's partitions, a fixed number; files of a part are numbered within it
    parts = files.groupBy("part").agg(F.sum("ids").alias("part_ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("part_ids").over(before), F.lit(0)).alias("part_start"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.withColumn("inner", F.coalesce(F.sum("ids").over(within), F.lit(0))).join(parts, "part")
    placed = placed.select("path", (F.col("part_start") + F.col("inner")).alias("start")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, name = filesystem(path)
                with system.open_input_stream(name) as f:
                    ids, docs, lengths = decode_file(f.read())
                ends = np.cumsum(lengths)
                flat = ids.astype("<u4")
                begins = ends - lengths
                crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                columns = {id_col: pa.array(docs, pa.int64()), "start": pa.array(begins + start, pa.int64()), "n_tokens": pa.array(lengths, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
                if with_ids:
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return map_arrow(placed, read, f"`{id_col}` long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def token_file_round_trip(df: DataFrame, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes df's texts as token files and reads them back: (id_col, start, n_tokens, ids_crc32) for every row of df.

    A null or empty text has only the end id. Texts are encoded whole. An empty table gives an empty one; other
    columns are not read; repeated rows and null ids: see write_token_files.
    """
    return read_token_files(write_token_files(df, path, end_id, id_col, text_col), id_col)
