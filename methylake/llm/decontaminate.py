"""Operator 5, benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact check.

Words are runs of ASCII letters, digits and bytes beyond ASCII, A-Z lower-cased. A shingle of k words weighs as
many bytes as its words have; windows and items are weighted multisets of shingles, and their similarity is the
sum of the smaller weights over the sum of the larger ones. A text shorter than an item is one window as a
whole. A window without any shingle of an item has similarity 0, so only windows that share one are
fingerprinted; that loses nothing.

Fingerprints have BITS bits in BLOCKS blocks. Of two that differ in at most a radius of bits, all but radius // (FLIPS +
1) blocks differ in at most FLIPS bits: tables of block values count, for each item, the blocks that are so near, and
give all fingerprints within the radius but few others (0.1 % of random pairs at similarity 0.8). The exact similarity
then decides. The radius is SIGMAS standard deviations above what two fingerprints at the least similarity differ in.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from methylake.llm.common import id_text, map_arrow, map_batches
from methylake.llm.wordhash import PUNCTUATED, constants, hash_runs, lowered, mix, pieces, text_buffer, word_bounds

#: Bits of a fingerprint, 64 from each hash of a shingle, blocks of 8 bits of the index, and flips in a block that it
#: looks up.
BITS, BLOCKS, FLIPS = 256, 32, 2
#: The radius lies so many standard deviations above the mean at the least similarity.
SIGMAS = 4.0
#: Windows that are fingerprinted at once, where the items are shorter.
RUN = 4096
#: Items and bytes of a part of the benchmark that is broadcast; a larger benchmark takes several passes.
MAX_ITEMS, MAX_BYTES = 4096, 8 << 20

_PRESENCE_BITS = 20


def _words(data: np.ndarray, offsets: np.ndarray):
    part = lowered(data)
    starts, ends, text = word_bounds(part, offsets, PUNCTUATED)
    return hash_runs(part, starts, ends), (ends - starts).astype(np.float64), text


def _shingle(words: np.ndarray, sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, weight) of the k words from each place on."""
    weights, m = constants(k, 3), len(words) - k + 1
    if m <= 0:
        return words[:0], sizes[:0]
    with np.errstate(over="ignore"):
        h = words[:m] * weights[0]
        w = sizes[:m].copy()
        for j in range(1, k):
            h += words[j : j + m] * weights[j]
            w += sizes[j : j + m]
        return mix(h + np.uint64(k)), w


def radius_for(least: float) -> int:
    """Bits that fingerprints of multisets of similarity `least` or more differ in, with SIGMAS to spare: a bit differs
    with the angle between the two sums over pi, whose cosine is 2 * least / (1 + least) for multisets of equal size."""
    p = math.acos(min(1.0, 2 * least / (1 + least))) / math.pi
    return min(BITS, math.floor(BITS * p + SIGMAS * math.sqrt(BITS * p * (1 - p))))


def fingerprints(shingles: np.ndarray, weights: np.ndarray, span: int) -> np.ndarray:
    """(windows, BITS // 8) SimHash bytes of every window of span shingles, from running sums of 64 bits at a time."""
    whole = weights.astype(np.int32)
    n, out = len(shingles) - span + 1, []
    for salt in constants(BITS // 64, 17):
        bits = np.unpackbits(mix(shingles ^ salt).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums = np.zeros((len(shingles) + 1, 64), np.int64)
        np.cumsum(np.where(bits == 1, whole[:, None], -whole[:, None]), axis=0, out=sums[1:])
        out.append(np.packbits(sums[span:] > sums[:n], axis=1, bitorder="little"))
    return np.concatenate(out, axis=1)


@dataclass
class _Item:
    """An item's shingles, distinct and sorted, with the weight of one and how often each is in it."""

    item_id: int
    words: int
    width: int
    distinct: np.ndarray
    weight: list[float]
    count: list[int]
    total: float


class HammingIndex:
    """All of the given fingerprints within a radius of a query."""

    def __init__(self, prints: np.ndarray, radius: int):
        self.prints, self.radius = prints, radius
        #: blocks within FLIPS bits that two fingerprints within the radius have at least
        self.least = max(0, BLOCKS - radius // (FLIPS + 1))
        self.table = np.zeros((BLOCKS, 256, len(prints)), np.uint8)
        near = [sum(1 << b for b in bits) for n in range(FLIPS + 1) for bits in itertools.combinations(range(8), n)]
        for block in range(BLOCKS):
            for flip in near:
                self.table[block, prints[:, block] ^ flip, np.arange(len(prints))] = 1

    def candidates(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, print) index pairs with enough blocks in common."""
        common = np.zeros((len(queries), len(self.prints)), np.uint8)
        for block in range(BLOCKS):
            common += self.table[block, queries[:, block]]
        return np.nonzero(common >= self.least)

    def __call__(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, print) index pairs within the radius."""
        q, p = self.candidates(queries)
        apart = np.bitwise_count(queries[q] ^ self.prints[p]).sum(axis=1)
        return q[apart <= self.radius], p[apart <= self.radius]


class Benchmark:
    """Items, made ready for search: shingles by width, fingerprints by size."""

    def __init__(self, items: list[tuple[int, str]], k: int, least: float):
        self.items: list[_Item] = []
        self.least = least
        prints = []
        for item_id, text in items:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            words, sizes, _ = _words(raw, np.array([0, len(raw)]))
            if len(words):
                width = min(k, len(words))
                shingles, weights = _shingle(words, sizes, width)
                distinct, first, count = np.unique(shingles, return_index=True, return_counts=True)
                self.items.append(_Item(item_id, len(words), width, distinct, weights[first].tolist(), count.tolist(), float(weights.sum())))
                prints.append(fingerprints(shingles, weights, len(shingles))[0])
        self.widths = sorted({i.width for i in self.items})
        self.known, self.owners, self.presence = {}, {}, {}
        for width in self.widths:
            owners: dict[int, set[int]] = {}
            for n, item in enumerate(self.items):
                if item.width == width:
                    for s in item.distinct.tolist():
                        owners.setdefault(s, set()).add(n)
            #: sizes in words of the items that hold a shingle
            self.owners[width] = {s: frozenset(self.items[n].words for n in ns) for s, ns in owners.items()}
            self.known[width] = np.array(sorted(owners), np.uint64)
            self.presence[width] = np.zeros(1 << _PRESENCE_BITS, bool)
            self.presence[width][self.known[width] & np.uint64((1 << _PRESENCE_BITS) - 1)] = True
        by_size: dict[int, list[int]] = {}
        for n, item in enumerate(self.items):
            by_size.setdefault(item.words, []).append(n)
        radius = radius_for(least)
        self.index = {size: (np.array(ns), HammingIndex(np.stack([prints[n] for n in ns]), radius)) for size, ns in by_size.items()}

    def hits(self, shingles: np.ndarray, width: int) -> np.ndarray:
        """Places of shingles that an item has."""
        at = np.flatnonzero(self.presence[width][shingles & np.uint64((1 << _PRESENCE_BITS) - 1)])
        found = np.searchsorted(self.known[width], shingles[at])
        found[found == len(self.known[width])] = 0
        return at[self.known[width][found] == shingles[at]]

    def search(self, shingles: np.ndarray, weights: np.ndarray, hits: np.ndarray, width: int) -> list[tuple[int, float, int, int]]:
        """(item_id, similarity, first word, words) of the best window of each item, in one text's shingles."""
        sizes: dict[int, list[int]] = {}
        for p, s in zip(hits.tolist(), shingles[hits].tolist(), strict=True):
            for n in self.owners[width][s]:
                sizes.setdefault(n, []).append(p)
        ends = np.concatenate([[0.0], np.cumsum(weights)])
        best: dict[int, tuple[float, int, int]] = {}
        for n, places in sizes.items():
            # a text of fewer words is one window
            span = min(n - width + 1, len(shingles))
            numbers, index = self.index[n]
            for a, b in _runs(np.array(places), span, len(shingles) - span, max(RUN, span)):
                q, found = index(fingerprints(shingles[a : b + span], weights[a : b + span], span))
                order = np.lexsort((q, found))
                q, found = q[order], numbers[found[order]]
                cuts = [0, *(np.flatnonzero(np.diff(found)) + 1).tolist(), len(found)]
                for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                    if low == high or (item := self.items[found[low]]).width != width:
                        continue
                    s, w = _best_window(item, shingles, ends, (q[low:high] + a).tolist(), span)
                    if s >= self.least and (item.item_id not in best or (s, -w) > (best[item.item_id][0], -best[item.item_id][1])):
                        best[item.item_id] = (s, w, span + width - 1)
        return [(i, *v) for i, v in sorted(best.items())]


def _runs(places: np.ndarray, span: int, last: int, most: int) -> list[tuple[int, int]]:
    """Ranges of starts, of at most `most` each, of the windows that hold one of the ascending places: starts p - span
    + 1 to p of each, those that overlap or touch made one."""
    low, high = np.maximum(places - span + 1, 0), np.minimum(places, last)
    low, high = low[low <= high], high[low <= high]
    out = []
    fresh = np.flatnonzero(low[1:] > high[:-1] + 1) + 1
    for a, b in zip(low[[0, *fresh]].tolist(), high[[*(fresh - 1), -1]].tolist(), strict=True) if len(low) else ():
        out += [(x, min(b, x + most - 1)) for x in range(a, b + 1, most)]
    return out


def _best_window(item: _Item, shingles: np.ndarray, ends: np.ndarray, starts: list[int], span: int) -> tuple[float, int]:
    """(similarity, start) of the window, of the ascending starts, that is most like the item, the first of equal ones.
    The common weight is kept while the window moves on: each shingle of the item comes and goes once."""
    begin = starts[0]
    part = shingles[begin : starts[-1] + span]
    kind = np.searchsorted(item.distinct, part)
    kind[kind == len(item.distinct)] = 0
    at = np.flatnonzero(item.distinct[kind] == part)
    places, kinds = (at + begin).tolist(), kind[at].tolist()
    held, weight, most = [0] * len(item.count), item.weight, item.count
    left = right = 0
    common, best = 0.0, (-1.0, 0)
    for w in starts:
        while right < len(places) and places[right] < w + span:
            k = kinds[right]
            if held[k] < most[k]:
                common += weight[k]
            held[k] += 1
            right += 1
        while left < right and places[left] < w:
            k = kinds[left]
            held[k] -= 1
            if held[k] < most[k]:
                common -= weight[k]
            left += 1
        s = common / (item.total + float(ends[w + span] - ends[w]) - common)
        if s > best[0]:
            best = (s, w)
    return best


def _scan(b: Benchmark, column: pa.Array) -> list[tuple[int, tuple[int, float, int, int]]]:
    """(row, what Benchmark.search found) for a column of texts."""
    out = []
    data, offsets = text_buffer(column)
    for first, last in pieces(offsets):
        words, sizes, text = _words(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        bounds = np.searchsorted(text, np.arange(last - first + 1))
        for width in b.widths:
            shingles, weights = _shingle(words, sizes, width)
            hits = b.hits(shingles, width)
            owner = text[hits]
            inside = text[hits + width - 1] == owner
            hits, owner = hits[inside], owner[inside]
            for t in np.unique(owner).tolist():
                low, high = bounds[t], bounds[t + 1] - width + 1
                out += [(first + t, found) for found in b.search(shingles[low:high], weights[low:high], hits[owner == t] - low, width)]
    return out


def _parts(benchmark: DataFrame, k: int, least: float, item_col: str, item_text: str):
    """The benchmark as broadcast parts of bounded size."""
    items = id_text(benchmark, item_col, item_text).where("text is not null").distinct()
    n, size = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    # hashing deals items unevenly: aim at half of the bound
    parts = max(1, -(-2 * n // MAX_ITEMS) if n > MAX_ITEMS else 1, -(-2 * size // MAX_BYTES) if size > MAX_BYTES else 1)
    for p in range(parts):
        rows = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == p).orderBy("id", "text").collect()
        yield parts, benchmark.sparkSession.sparkContext.broadcast(Benchmark([tuple(r) for r in rows], k, least))


def contaminated(df: DataFrame, benchmark: DataFrame, k: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id_col, item_id, similarity, first_word, n_words): a row for each document and item with a window of the
    item's number of words whose weighted shingle similarity is least or more; the best window, the first of equal ones.
    A document of fewer words than the item is one window as a whole, and n_words is its own number of words.

    Items of fewer than k words are one shingle of all their words. A null or empty text or item, or one without
    words, matches nothing. Repeated rows of df give repeated results; a null id stays null. Repeated items with the
    same id count as one, each of its texts being searched. Empty tables give an empty result. Texts are scanned
    whole; other columns are not read. Nothing is shuffled. The benchmark is broadcast in parts of MAX_ITEMS items
    and about MAX_BYTES bytes at most, each with a pass of its own over df.
    """
    docs, out = id_text(df, id_col, text_col), None
    for parts, shared in _parts(benchmark, k, least, item_col, item_text):

        def scan(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            found = _scan(shared.value, batch.column(1))
            kinds = (pa.int64(), pa.float64(), pa.int64(), pa.int64())
            ids = batch.column(0).take(pa.array([row for row, _ in found], pa.int64()))
            return pa.RecordBatch.from_arrays([ids, *(pa.array([x[c] for _, x in found], t) for c, t in enumerate(kinds))], ["id", "item_id", "similarity", "first_word", "n_words"])

        one = map_batches(docs, scan, "id long, item_id long, similarity double, first_word long, n_words long")
        out = one if out is None else out.unionByName(one)
    if parts > 1:
        best = F.max_by(F.struct("similarity", "first_word", "n_words"), F.struct("similarity", -F.col("first_word"))).alias("b")
        out = out.groupBy("id", "item_id").agg(best).select("id", "item_id", "b.*")
    return out.withColumnRenamed("id", id_col)


def decontaminate(df: DataFrame, benchmark: DataFrame, k: int = 5, least: float = 0.8, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """df without the rows that contaminated() would name, with df's columns and types, whatever their names; a filter,
    without a shuffle. Rows with a null or empty text stay, repeated rows go or stay together, ids are not read, and
    an empty table gives an empty one."""
    at = df.columns.index(text_col)
    for _, shared in _parts(benchmark, k, least, item_col, item_text):

        def run(batches, shared=shared):
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[row for row, _ in _scan(shared.value, batch.column(at).cast(pa.string()))]] = False
                yield batch.filter(pa.array(clean))

        df = map_arrow(df, run, df.schema)
    return df
