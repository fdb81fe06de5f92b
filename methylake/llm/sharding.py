"""Operator 3, sharding: a minimax contiguous partition of ordered atomic groups.

Groups are equal texts, ordered by the SHA-256 of the text. The smallest feasible capacity is found by binary
search, each try checked greedily: a shard takes groups as long as they fit. A try needs the running total near
each cut only: the driver holds totals of ranges of the hash space, 16**CHUNK_DIGITS at first, and opens those few
in which a cut may fall, so what it holds doesn't grow with the input. The cuts are prefixes of hashes, so a
document's shard is a comparison with at most n_shards - 1 constants: no join, and copies meet in no task.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from methylake.llm.common import id_text, written

#: Leading hex digits of a group's hash that name its first range, those that opening adds, and capacities tried at once.
CHUNK_DIGITS, OPEN_DIGITS, TRIES = 3, 2, 8
#: Parts of a shard that number their rows on their own.
SLOT_PARTS = 1024


class _Ranges:
    """The ordered groups as ranges of hashes that share a prefix: (prefix, bytes, groups), one group or more each.

    A range of one group can't be cut; of a larger one only the total is known, until it is opened.
    """

    def __init__(self, groups: DataFrame):
        self.groups = groups
        self.ranges = self._totals(F.substring("sha", 1, CHUNK_DIGITS), F.lit(True))
        self.largest = max((r[3] for r in self.ranges), default=0)
        self._index()

    def _totals(self, prefix, where) -> list[tuple[str, int, int, int]]:
        rows = self.groups.where(where).groupBy(prefix.alias("p")).agg(F.sum("bytes"), F.count(F.lit(1)), F.max("bytes")).collect()
        return sorted(tuple(r) for r in rows)

    def _index(self) -> None:
        self.ends = list(accumulate(r[1] for r in self.ranges))
        self.total = self.ends[-1] if self.ends else 0

    def open(self, at: set[int]) -> None:
        """Replaces the ranges at these places by their parts, OPEN_DIGITS digits longer; one job for all."""
        by_length: dict[int, list[str]] = {}
        for i in at:
            by_length.setdefault(len(self.ranges[i][0]), []).append(self.ranges[i][0])
        where, prefix = F.lit(False), F.lit(None).cast("string")
        for n, names in by_length.items():
            hit = F.substring("sha", 1, n).isin(names)
            where, prefix = where | hit, F.when(hit, F.substring("sha", 1, n + OPEN_DIGITS)).otherwise(prefix)
        parts = self._totals(prefix, where)
        self.ranges = sorted([r for i, r in enumerate(self.ranges) if i not in at] + parts)
        self._index()

    def greedy(self, capacity: int, n_shards: int, hopeful: bool) -> tuple[bool, list[int], set[int]]:
        """(does capacity do, first range of the next shard for each cut, ranges that a shard's end falls into).

        hopeful: a shard may end anywhere in a range of several groups, else only at its start.
        """
        at, cuts, inside = 0, [], set()
        for _ in range(n_shards):
            limit = at + capacity
            i = bisect_right(self.ends, limit)
            if i == len(self.ends):
                return True, cuts, inside
            start = self.ends[i - 1] if i else 0
            if self.ranges[i][2] > 1:
                inside.add(i)
            at = limit if hopeful and self.ranges[i][2] > 1 else start
            cuts.append(i)
        return False, cuts, inside

    def smallest(self, n_shards: int, hopeful: bool) -> int:
        low, high = max(self.largest, -(-self.total // n_shards)), self.total
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if self.greedy(middle, n_shards, hopeful)[0] else (middle + 1, high)
        return low


def minimax_cuts(groups: DataFrame, n_shards: int) -> tuple[int, list[str]]:
    """(smallest capacity, first hash, as a prefix, of each shard but the first) for groups (sha, bytes).

    Every try is exact: bounds from below and above come from ranges of hashes, and those that part the bounds are
    opened until they meet.
    """
    ranges = _Ranges(groups)
    if not ranges.total:
        return 0, []
    while True:
        low, high = ranges.smallest(n_shards, True), ranges.smallest(n_shards, False)
        if low == high:
            cuts = ranges.greedy(high, n_shards, False)[1]
            return high, [ranges.ranges[i][0] for i in cuts]
        tries = {low + (high - low) * t // TRIES for t in range(TRIES + 1)}
        ranges.open(set().union(*(ranges.greedy(c, n_shards, hopeful)[2] for c in tries for hopeful in (True, False))))


def shard_documents(df: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, size, text_crc32, law, shard, slot, grown_shard) for every row of df.

    size: UTF-8 bytes of the text plus 1. Groups of equal texts stay together; ordered by their SHA-256 they are cut
    into n_shards runs whose largest sum of sizes is the smallest possible (law `bytes`). slot numbers a shard's
    rows from 0 without gaps. A null text counts as an empty one (size 1, crc 0) and belongs to its group. Repeated
    rows are rows of their own with slots of their own. Null ids are numbered too. An empty table gives an empty
    one; with fewer groups than shards some shards stay empty. One group larger than total / n_shards fills a
    shard alone or nearly so: groups are never split. Other columns of df are not read.

    Shuffles carry hashes and sizes, not texts; equal texts are pre-aggregated in their tasks.
    """
    text = F.coalesce("text", F.lit(""))
    docs = id_text(df, id_col, text_col).select("id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("crc"), F.sha2(text, 256).alias("sha"))
    docs = written(docs, "shard-rows")
    _, cuts = minimax_cuts(written(docs.groupBy("sha").agg(F.sum("size").alias("bytes")), "shard-groups"), n_shards)

    # the number of shards that begin at or before the hash
    shard = sum(((F.col("sha") >= F.lit(c)).cast("int") for c in cuts), F.lit(0))
    placed = docs.select("id", "size", "crc", shard.alias("shard"), F.pmod(F.xxhash64("id", "sha", "size"), F.lit(SLOT_PARTS)).cast("int").alias("part"))
    # repeated rows share a hash: numbered in one part, as they have one id
    counts = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    # n_shards * SLOT_PARTS rows, whatever the input
    out = placed.withColumn("rank", F.row_number().over(Window.partitionBy("shard", "part").orderBy("id", "crc")) - 1).join(F.broadcast(offsets), ["shard", "part"])
    return out.select(
        F.col("id").alias(id_col), "size", F.col("crc").cast("long").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("offset") + F.col("rank")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
