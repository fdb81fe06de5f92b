"""Operator 1, token counts.

1. The table of distinct pre-tokens with their corpus frequency: tasks hold dictionaries of bounded size, sums are
   partial before the shuffle. Each distinct pre-token is then encoded once by the tokenizers library, and only its
   number of pieces is kept.
2. The join with each document's pre-token frequencies, in the two ways that skewed keys need. The most frequent
   pre-tokens, as many as fit into HEAD entries and HEAD_BYTES bytes, are broadcast and summed where the document is
   read. The others, none of which is frequent, meet the table in a shuffle of (document, pre-token, frequency).
3. A document's count is the sum of frequency times pieces of both. No ids are made.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from methylake.llm.common import id_text, map_arrow, map_batches, written
from methylake.llm.pretoken import BYTE_LEVEL, byte_level, from_byte_level, library_pieces, load, plain, special_cutter, specials_of

#: Pre-tokens, and bytes of them, that are broadcast at most.
HEAD, HEAD_BYTES = 1 << 19, 16 << 20
#: Pre-tokens, and characters of them, after which a task passes its sums on.
HELD, HELD_CHARS = 1 << 18, 16 << 20

_STATE: dict[str, tuple] = {}


def _state(path: str):
    if path not in _STATE:
        t = load(path)
        specials = specials_of(t)
        _STATE[path] = (t, specials, special_cutter(specials))
    return _STATE[path]


def frequencies(text: str, path: str) -> Counter:
    """How often each pre-token is in a text; a special token in it is a pre-token of its own."""
    tokenizer, specials, cutter = _state(path)
    if plain(text, specials):
        return Counter(BYTE_LEVEL.findall(text))
    out: Counter = Counter()
    for piece, n in Counter(library_pieces(tokenizer, cutter, text)).items():
        out[piece if piece in specials else from_byte_level(piece)] += n
    return out


def count_pieces(pre_token: str, path: str) -> int:
    """Tokens of one pre-token. No pre-token of a text is like a special token but the token itself."""
    tokenizer, specials, _ = _state(path)
    return 1 if pre_token in specials else len(tokenizer.model.tokenize(byte_level(pre_token)))


def pre_token_table(docs: DataFrame, path: str) -> DataFrame:
    """(piece, freq, level, n) of every distinct pre-token of docs (id, text): its corpus frequency, 16 times the
    frequency's binary logarithm, and its number of tokens."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, chars = Counter(), 0

        def give() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["piece", "freq"])

        for batch in batches:
            for text in batch.column(1).to_pylist():
                for piece, n in frequencies(text or "", path).items():
                    if piece not in held:
                        chars += len(piece)
                    held[piece] += n
                if len(held) >= HELD or chars >= HELD_CHARS:
                    yield give()
                    held, chars = Counter(), 0
        yield give()

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array([count_pieces(p, path) for p in batch.column(0).to_pylist()], pa.int64())], ["piece", "freq", "level", "n"])

    distinct = map_arrow(docs, collect, "piece string, freq long").groupBy("piece").agg(F.sum("freq").alias("freq"))
    return map_batches(distinct.withColumn("level", F.floor(16 * F.log2("freq")).cast("int")), count, "piece string, freq long, level int, n long")


def _head(table: DataFrame) -> int:
    """The least level from which on pre-tokens fit into HEAD entries and HEAD_BYTES bytes."""
    sizes = table.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("piece")).alias("size")).collect()  # 1009 rows at most
    count = size = 0
    least = 1 << 10
    for row in sorted(sizes, key=lambda r: -r["level"]):
        count, size = count + row["n"], size + row["size"]
        if count > HEAD or size > HEAD_BYTES:
            break
        least = row["level"]
    return least


def token_counts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """(id_col, n_bytes, n_tokens, over_limit) for every row of df.

    path: a byte-level BPE tokenizer file. over_limit: n_tokens > limit. A null text is an empty one: 0 bytes and
    0 tokens. A null id stays null, repeated rows give repeated results, an empty table an empty one. Texts are
    counted whole, whatever their length and characters. Other columns of df are not read.
    """
    docs = id_text(df, id_col, text_col)
    table = written(pre_token_table(docs, path), "pre-tokens")
    least = _head(table)
    rows = table.where(F.col("level") >= least).select("piece", "n").collect()  # HEAD of them at most
    head = df.sparkSession.sparkContext.broadcast({r["piece"]: r["n"] for r in rows})

    def sum_head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, task, done = head.value, uuid.uuid4().int >> 65, 0
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("piece", pa.string()), ("freq", pa.int64())]))]
        for batch in batches:
            sizes, sums, rests = [], [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                total, rest = 0, []
                for piece, n in frequencies(text, path).items():
                    if (pieces := known.get(piece)) is None:
                        rest.append({"piece": piece, "freq": n})
                    else:
                        total += n * pieces
                sizes.append(len(text) if text.isascii() else len(text.encode()))
                sums.append(total)
                rests.append(rest)
            number = pa.array(range(done, done + batch.num_rows), pa.int64())
            done += batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([task] * batch.num_rows, pa.int64()), number, batch.column(0), *map(pa.array, (sizes, sums, rests), kinds)], ["task", "number", "id", "n_bytes", "head", "rest"])

    # the key of a row is a task's random number and a place in it; writing the table fixes both
    counted = written(map_arrow(docs, sum_head, "task long, number long, id long, n_bytes long, head long, rest array<struct<piece:string,freq:long>>"), "token-counts")
    rest = counted.where(F.size("rest") > 0).select("task", "number", F.inline("rest"))
    rest = rest.join(table.where(F.col("level") < least).select("piece", "n"), "piece")
    sums = rest.groupBy("task", "number").agg(F.sum(F.col("freq") * F.col("n")).alias("sum"))
    out = counted.select("task", "number", "id", "n_bytes", "head").join(sums, ["task", "number"], "left")
    total = F.col("head") + F.coalesce("sum", F.lit(0))
    return out.select(F.col("id").alias(id_col), "n_bytes", total.alias("n_tokens"), (total > limit).alias("over_limit"))
