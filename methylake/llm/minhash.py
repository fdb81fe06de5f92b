"""Operator 4, MinHash near-dedup by min-max hashing.

1. Each document becomes its set of k-word shingles (64-bit hashes). Under each permutation both the minimum and
   the maximum are kept, so a band of ROWS values costs ROWS / 2 hash evaluations an element. The number of bands
   follows from the threshold: a pair at the threshold shares no band with a probability under MISS.
2. Documents with equal sets are one class, so copies never meet in a bucket.
3. In each bucket every class is tied to the smallest one (a star, never pairs); the components of these ties are
   candidate families: two classes that share a bucket are in one family.
4. Each family's sets go to tasks in blocks of bounded size and are compared on full sets by blocked matrix products,
   of which a spanning forest of the confirmed links comes out, so a family of n members gives O(n) rows. In a family
   of several blocks the first one, chosen by hashes, meets all others; what it links is contracted, and only members
   outside the largest component that this gives meet all blocks in a second pass. Members within that component are
   connected already, so no link between different components is lost.
5. The components of the confirmed links, over all documents.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from methylake.llm.common import id_text, map_arrow, map_batches, split_join, written
from methylake.llm.graph import connected_components
from methylake.llm.wordhash import constants, mix, shingle_sets

#: Values in a band, two from each permutation, and the chance of missing a pair at the threshold.
ROWS, MISS = 6, 1e-6
#: Members and shingles of a block of a family, on average.
BLOCK_MEMBERS, BLOCK_SHINGLES = 64, 100_000
#: Members of families, 48 bytes each, up to which they go to the texts instead of both being shuffled.
BROADCAST_MEMBERS = 1_000_000


def bands_for(threshold: float, rows: int = ROWS, miss: float = MISS) -> int:
    return math.ceil(math.log(miss) / math.log1p(-(threshold**rows)))


class MinMax:
    """Band hashes of sets: `bands` bands of ROWS // 2 permutations each."""

    def __init__(self, bands: int):
        self.bands, self.per = bands, ROWS // 2
        n = bands * self.per
        self.flip = (constants(n, 11) >> np.uint64(32)).astype(np.uint32)
        self.times = (constants(n, 12) >> np.uint64(31)).astype(np.uint32) | np.uint32(1)
        self.again = (constants(n, 13) >> np.uint64(31)).astype(np.uint32) | np.uint32(1)
        self.low, self.high, self.name = constants(n, 14), constants(n, 15), constants(bands, 16)

    def __call__(self, sets: list[np.ndarray]) -> np.ndarray:
        """(len(sets), bands) band hashes; no set may be empty."""
        begin = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
        x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
        out = np.empty((len(sets), self.bands), np.uint64)
        with np.errstate(over="ignore"):
            for band in range(self.bands):
                h = np.full(len(sets), self.name[band])
                for p in range(band * self.per, (band + 1) * self.per):
                    y = x ^ self.flip[p]
                    y *= self.times[p]
                    y ^= y >> np.uint32(15)
                    y *= self.again[p]
                    h += mix(np.minimum.reduceat(y, begin) * self.low[p]) + mix(np.maximum.reduceat(y, begin) * self.high[p])
                out[:, band] = mix(h)
        return out


def set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set of hashes, whatever its order."""
    with np.errstate(over="ignore"):
        return int(mix(s ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64).astype(np.int64)), int(mix(s * np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64).astype(np.int64))


def _signatures(docs: DataFrame, k: int, bands: int) -> DataFrame:
    minmax = MinMax(bands)

    def sign(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, keys, rows, widths = [], [], [], []
        for _, sets in shingle_sets(batch.column(1), k):
            full = [s for s in sets if len(s)]
            if full:
                rows.append(minmax(full).view(np.int64).ravel())
            n += [len(s) for s in sets]
            keys += [set_key(s) for s in sets]
            widths += [bands if len(s) else 0 for s in sets]
        flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        at = np.concatenate([[0], np.cumsum(widths)]).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array([a for a, _ in keys], pa.int64()), pa.array([b for _, b in keys], pa.int64()), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))],
            ["id", "n", "k1", "k2", "bands"],
        )

    return map_batches(docs, sign, "id long, n long, k1 long, k2 long, bands array<long>")


def _sets(rows: DataFrame, k: int) -> DataFrame:
    """(node, family, active, blocks, block, shingles) with shingles the set's hashes as bytes, where the set is the wanted one."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        keep, blobs = [], []
        k1, k2 = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        for first, sets in shingle_sets(batch.column(1), k):
            for i, s in enumerate(sets, first):
                if set_key(s) == (k1[i], k2[i]):
                    keep.append(i)
                    blobs.append(s.tobytes())
        if not keep:
            return None
        rest = batch.take(pa.array(keep))
        return pa.RecordBatch.from_arrays([rest.column(0), *(rest.column(j) for j in (4, 5, 6, 7)), pa.array(blobs, pa.binary())], ["node", "family", "active", "blocks", "block", "shingles"])

    return map_batches(rows, make, "node long, family long, active int, blocks int, block int, shingles binary")


def linked(inter: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether 100 * intersection >= percent * union, in integers."""
    inter = inter.astype(np.int64)
    return 100 * inter >= percent * (sizes_a[:, None] + sizes_b[None, :] - inter)


def _overlaps(sets: list[np.ndarray], rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets at rows with those at cols. Shingles of one set alone can't be in one and
    are left out of the product, which runs over columns of shingles in chunks of bounded size."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    fresh = np.concatenate([[True], values[1:] != values[:-1]])
    column = np.cumsum(fresh) - 1
    common = np.bincount(column)[column] > 1
    owner, column = owner[common], np.cumsum(fresh[common]) - 1
    inter = np.zeros((len(rows), len(cols)), np.float32)
    width = 4096
    n = int(column[-1]) + 1 if len(column) else 0
    cuts = np.searchsorted(column, np.arange(0, n + width, width))
    for c, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        dense = np.zeros((len(sets), min(width, n - c * width)), np.float32)
        dense[owner[a:b], column[a:b] - c * width] = 1
        inter += dense[rows] @ dense[cols].T
    return inter


def _find(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def confirmed(nodes: list[int], sets: list[np.ndarray], percent: int, left: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links between members; with left, only links between a left and another member count."""
    sizes = np.array([len(s) for s in sets], np.int64)
    rows = np.arange(len(nodes)) if left is None else np.flatnonzero(left)
    cols = np.arange(len(nodes)) if left is None else np.flatnonzero(~left)
    parent, out = list(range(len(nodes))), []
    for i, j in zip(*np.nonzero(linked(_overlaps(sets, rows, cols), sizes[rows], sizes[cols], percent)), strict=True):
        i, j = int(rows[i]), int(cols[j])
        if (a := _find(parent, i)) != (b := _find(parent, j)):
            parent[a] = b
            out.append((nodes[i], nodes[j]))
    return out


def tied(nodes: list[int], sets: list[np.ndarray], percent: int, pivots: np.ndarray) -> list[tuple[int, int]]:
    """(member, pivot) of each member, pivots themselves too, and the smallest pivot of each component of pivots alone
    that it is linked with: the same pivots give the same components whatever other members there are."""
    if len(nodes) == 2 and pivots.all():
        a, b = sets
        inter = len(np.intersect1d(a, b, assume_unique=True))
        return [(max(nodes), min(nodes))] if 100 * inter >= percent * (len(a) + len(b) - inter) else []
    sizes = np.array([len(s) for s in sets], np.int64)
    rows = np.flatnonzero(pivots)
    links = linked(_overlaps(sets, rows, np.arange(len(nodes))), sizes[rows], sizes, percent)
    parent = list(range(len(rows)))
    for i, j in zip(*np.nonzero(links[:, rows]), strict=True):
        parent[_find(parent, int(i))] = _find(parent, int(j))
    smallest: dict[int, int] = {}
    for i, row in enumerate(rows.tolist()):
        root = _find(parent, i)
        smallest[root] = min(nodes[row], smallest.get(root, nodes[row]))
    heads = [smallest[_find(parent, i)] for i in range(len(rows))]
    ties = {(nodes[j], heads[i]) for i, j in zip(*(x.tolist() for x in np.nonzero(links)), strict=True)}
    return [t for t in ties if t[0] != t[1]]


def _confirm(members: DataFrame, percent: int, first: bool) -> DataFrame:
    """members (node, family, active, blocks, block, shingles) -> confirmed links (a, b): blocks below active meet
    themselves and all blocks of their family. In the first pass block 0 alone is active, and links are tied() to it."""
    mates = F.sequence(F.lit(0), F.when(F.col("block") < F.col("active"), F.col("blocks")).otherwise(F.col("active")) - 1)
    pairs = members.withColumn("mate", F.explode(mates)).select(
        "family", F.least("block", "mate").alias("i"), F.greatest("block", "mate").alias("j"), "block", "node", "shingles"
    )
    pairs = pairs.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j")

    def run(batches):
        def close(key, group):
            nodes, sets = [g[1] for g in group], [np.frombuffer(g[2], np.uint64) for g in group]
            left = np.array([g[0] for g in group]) == key[1]
            if len(group) < 2 or (key[1] != key[2] and (left.all() or not left.any())):
                return []
            return tied(nodes, sets, percent, left) if first else confirmed(nodes, sets, percent, None if key[1] == key[2] else left)

        key, group = None, []
        for batch in batches:
            found = []
            for f, i, j, block, node, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (f, i, j) != key:
                    if group:
                        found += close(key, group)
                    key, group = (f, i, j), []
                group.append((block, node, blob))
            yield _links(found)
        if group:
            yield _links(close(key, group))

    def _links(found):
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["a", "b"])

    return map_arrow(pairs, run, "a long, b long")


def _blocks(n="n"):
    """Blocks that rows of a group need."""
    return F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_MEMBERS), F.ceil(F.sum(n) / BLOCK_SHINGLES)).cast("int")


def _dealt(blocks):
    return F.pmod(F.xxhash64("node", "k1"), blocks).cast("int")


def _links(docs: DataFrame, members: DataFrame, k: int, percent: int, first: bool) -> DataFrame:
    """Confirmed links of members (node, k1, k2, family, active, blocks, block), a finished table."""
    members = members.select(F.col("node").alias("id"), "k1", "k2", "family", "active", "blocks", "block")
    if members.count() <= BROADCAST_MEMBERS:  # else both sides are shuffled by id
        members = F.broadcast(members)
    texts = docs.where("id is not null").join(members, "id").select("id", "text", "k1", "k2", "family", "active", "blocks", "block")
    return written(_confirm(_sets(texts, k), percent, first), "minhash-links")


def _family_links(docs: DataFrame, members: DataFrame, k: int, percent: int) -> DataFrame:
    """A spanning forest of the links within the families of members (node, n, k1, k2, family)."""
    sizes = members.groupBy("family").agg(_blocks().alias("blocks"))
    placed = written(split_join(members, sizes, ["family"]).withColumns({"active": F.lit(1), "block": _dealt(F.col("blocks"))}), "minhash-blocks")
    links = _links(docs, placed, k, percent, True)
    large = placed.where("blocks > 1").select("node", "n", "k1", "k2", "family")
    if large.isEmpty():
        return links
    # a pivot is tied to itself too
    ties = large.select("node", "family").distinct().join(links.select(F.col("a").alias("node"), F.col("b").alias("pivot")), "node")
    ties = ties.unionByName(ties.select(F.col("pivot").alias("node"), "family", "pivot").distinct())
    most = ties.groupBy("family", "pivot").agg(F.count(F.lit(1)).alias("c")).groupBy("family").agg(F.max_by("pivot", F.struct("c", "pivot")).alias("pivot"))
    within = split_join(ties, most, ["family", "pivot"]).select("node", F.lit(False).alias("no")).distinct()
    large = written(large.join(within, "node", "left").withColumn("apart", F.coalesce("no", F.lit(True))), "minhash-apart")
    out = large.where("apart").groupBy("family").agg(_blocks().alias("active"))
    within = large.where("not apart").groupBy("family").agg(_blocks().alias("rest"))
    again = split_join(large, out.join(within, "family", "left").fillna(0, ["rest"]), ["family"])
    block = F.when(F.col("apart"), _dealt(F.col("active"))).otherwise(F.col("active") + _dealt(F.greatest(F.col("rest"), F.lit(1))))
    again = written(again.select("node", "k1", "k2", "family", "active", (F.col("active") + F.col("rest")).alias("blocks"), block.alias("block")), "minhash-blocks")
    return links if again.isEmpty() else links.unionByName(_links(docs, again, k, percent, False))


def near_duplicates(df: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_shingles, component_id, kept) for every row of df.

    Words are runs of bytes other than white space, A-Z lower-cased; a document's set holds its distinct k-word
    shingles, or its whole sequence when it has fewer words. Documents are linked when the intersection is at least
    percent / 100 of the union, checked on the full sets; component_id is the smallest id reachable and kept says
    whether that is the row's own. A null or empty text, or one of white space, has an empty set and is linked with
    nothing, whatever its copies. Rows that repeat an id are one document that has the links of all its texts. A
    row with a null id stays, with a null component_id and kept. An empty table gives an empty one; texts are taken
    whole; other columns are not read.
    """
    docs = id_text(df, id_col, text_col)
    bands = bands_for(percent / 100)
    signed = written(_signatures(docs, k, bands), "minhash-signatures")
    linkable = signed.where("n > 0 and id is not null")

    # one class for equal sets; copies are pre-aggregated in their tasks
    classes = written(linkable.groupBy("n", "k1", "k2").agg(F.min("id").alias("node"), F.first("bands").alias("bands")), "minhash-classes")
    buckets = classes.select("node", F.explode("bands").alias("bucket"))
    hubs = buckets.groupBy("bucket").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("c")).where("c > 1").select("bucket", "hub")
    ties = split_join(buckets, hubs, ["bucket"]).where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    families = connected_components(ties).select("node", F.col("component").alias("family"))
    links = _family_links(docs, classes.select("node", "n", "k1", "k2").join(families, "node"), k, percent)

    # a document's class, then the class's component
    same = split_join(linkable.select("id", "n", "k1", "k2"), classes.select("n", "k1", "k2", "node"), ["n", "k1", "k2"])
    same = same.where("id <> node").select(F.col("id").alias("a"), F.col("node").alias("b"))
    parts = connected_components(links.unionByName(same)).select(F.col("node").alias("id"), "component")
    # rows without an id stay out of the join, where they would meet in one task
    out = signed.where("id is not null").select("id", "n").join(parts, "id", "left").withColumn("component", F.coalesce("component", "id"))
    out = out.unionByName(signed.where("id is null").select("id", "n", F.lit(None).cast("long").alias("component")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), (F.col("component") == F.col("id")).alias("kept"))


def keep_one(df: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with one row of each component of near_duplicates(), that with the smallest id; of rows that repeat this id,
    the one whose text has the least hash. Rows with a null id all stay. df's columns and types stay, whatever their
    names; null and empty texts are in no group, and an empty table gives an empty one."""
    found = written(near_duplicates(df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), k, percent, "id", "text").where("id is not null").select("id", "kept"), "minhash-kept")
    gone = found.where("not kept").select("id").distinct()
    again = found.where("kept").groupBy("id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("id")
    key = df[id_col].cast("long")
    special = gone.unionByName(again)
    single = df.where(key.isNotNull()).join(special, key == special["id"], "left_anti")
    first = df.join(again, key == again["id"], "left_semi").groupBy(key).agg(F.min_by(F.struct(*(df[c] for c in df.columns)), F.xxhash64(df[text_col])).alias("row")).select("row.*")
    return single.unionByName(df.where(key.isNull())).unionByName(first)
