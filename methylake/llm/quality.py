"""Operator 10, quality classifier: supervised subword embeddings.

Features are a text's words, its pairs of neighbouring words and its character n-grams, which run across word ends,
hashed to rows of one table of vectors. A text is the average of its features' vectors, each of the three kinds having
a third of the weight, and a softmax layer on it gives the classes. Vectors and layer are learned by plain stochastic
gradient descent in numpy on the driver, on a bounded sample of labelled rows. Scoring needs only one number per table
row (its vector's product with the difference of the two classes' weights), so the broadcast model has a fixed size
and texts are scored in numpy on the Arrow buffer, whole and without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from methylake.llm.common import give_back, map_arrow, map_batches
from methylake.llm.wordhash import constants, hash_runs, mix, pieces, text_buffer, word_bounds

#: Rows of the table, size of a vector, lengths of n-grams in characters.
ROWS, DIM, GRAMS = 1 << 18, 8, (3, 4, 5)
#: Kinds of features: words, word pairs, character n-grams.
KINDS = 3
#: Bounds of the sample that is fitted: labelled rows, and bytes of their texts together.
MAX_LABELLED, MAX_BYTES = 4000, 16 << 20
#: Rounds over the sample, and steps of the vectors and of the layer, which fall to 0 over the rounds.
EPOCHS, RATE, LAYER_RATE = 6, 20.0, 0.1


def characters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, UTF-8 bytes as a number) of each character."""
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    code = data[starts].astype(np.uint64)
    for j in range(1, 4):
        # a character goes on as long as continuation bytes follow
        longer = np.flatnonzero(np.diff(starts, append=len(data)) > j)
        code[longer] |= data[starts[longer] + j].astype(np.uint64) << np.uint64(8 * j)
    return starts, code


def features(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind (table rows, number of the text) of all features of the texts; case and punctuation count."""
    starts, ends, text = word_bounds(data, offsets)
    words = hash_runs(data, starts, ends)
    near = np.flatnonzero(text[1:] == text[:-1])
    place, code = characters(data)
    owner = np.searchsorted(offsets, place, "right") - 1
    pair, weights = constants(2, 21), constants(max(GRAMS), 4)
    grams, owners = [np.zeros(0, np.uint64)], [owner[:0]]
    with np.errstate(over="ignore"):
        pairs = mix(words[near] * pair[0] + words[near + 1] * pair[1])
        for n in GRAMS:
            m = len(code) - n + 1
            if m > 0:
                inside = owner[:m] == owner[n - 1 :]
                grams.append(mix(sum((code[j : j + m] * weights[j] for j in range(1, n)), code[:m] * weights[0]) + np.uint64(n))[inside])
                owners.append(owner[:m][inside])
    kinds = ((words, text), (pairs, text[near]), (np.concatenate(grams), np.concatenate(owners)))
    return [((h % np.uint64(ROWS)).astype(np.int64), where) for h, where in kinds]


@dataclass
class Model:
    """rows: what one feature in each table row adds to the mean; bias: of class 1 over class 0."""

    rows: np.ndarray
    bias: float

    def score(self, column: pa.Array) -> np.ndarray:
        data, offsets = text_buffer(column)
        out = np.empty(len(column))
        for a, b in pieces(offsets):
            z = np.full(b - a, self.bias)
            for rows, owner in features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]):
                n = np.bincount(owner, minlength=b - a)
                z += np.bincount(owner, weights=self.rows[rows], minlength=b - a) / (KINDS * np.maximum(n, 1))
            out[a:b] = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        return out


def fit(texts: list[str], labels: list[int], seed: int = 7) -> Model:
    """A model of labels 0 and 1. With one class or none, every score is that class's share, 0.5 without labels."""
    y = np.array(labels, np.int64)
    share = (y.sum() + 0.5) / (len(y) + 1)
    prior = float(np.log(share / (1 - share)))
    if len(set(labels)) < 2:
        return Model(np.zeros(ROWS), prior)
    rng = np.random.default_rng(seed)
    bags = [_bag(t) for t in texts]
    vectors = (rng.uniform(-1, 1, (ROWS, DIM)) / DIM).astype(np.float32)
    layer, bias = rng.normal(0, 1, (DIM, 2)), np.array([0.0, prior])
    for epoch in range(EPOCHS):
        falling = 1 - epoch / EPOCHS
        for i in rng.permutation(len(bags)):
            rows, weight = bags[i]
            hidden = weight @ vectors[rows]
            z = hidden @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = (RATE * falling * (layer @ p)).astype(np.float32)
            layer -= LAYER_RATE * falling * np.outer(hidden, p)
            bias -= LAYER_RATE * falling * p
            vectors[rows] -= weight[:, None] * back
    return Model(vectors @ (layer[:, 1] - layer[:, 0]), float(bias[1] - bias[0]))


def _bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(distinct table rows, weight of each in the text's average)."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    every, weights = [], []
    for rows, _ in features(raw, np.array([0, len(raw)])):
        every.append(rows)
        weights.append(np.full(len(rows), 1 / (KINDS * max(1, len(rows)))))
    rows, where = np.unique(np.concatenate(every), return_inverse=True)
    return rows.astype(np.int32), np.bincount(where, weights=np.concatenate(weights), minlength=len(rows)).astype(np.float32)


def held_out(id_column):
    """Whether a row's label is never learned: crc32 of the id as text, mod 3, is 1; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(id_column.cast("string")), F.lit(3)) == 1, F.lit(False))


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = MAX_LABELLED, max_bytes: int = MAX_BYTES) -> Model:
    """Fits on a bounded sample, whatever the input: labelled rows that are not held out, in the order of hashes of
    their ids, the first max_labelled of them, and of these the first with texts of max_bytes together, but one at
    least. Texts are learned whole. Null ids and labels other than 0 and 1 are not learned; rows that repeat an id give
    the text that sorts first, an id with both labels is learned with both. The sample's memory goes back to the system."""
    chosen = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1) and id is not null").where(~held_out(F.col("id")))
    chosen = chosen.distinct().orderBy(F.xxhash64("id"), "id", "label").limit(max_labelled)
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    # max_labelled rows of two numbers
    rows = texts.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min("text").alias("text"))
    before = Window.orderBy(F.xxhash64("id"), "id", "label").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.select("id", "label", F.octet_length("text").alias("size")).withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0)))
    fitting = sizes.where((F.col("before") == 0) | (F.col("before") + F.col("size") <= max_bytes)).select("id", "label")
    sample = rows.join(F.broadcast(fitting), ["id", "label"]).collect()
    sample.sort(key=lambda r: (r.id, r.label))
    texts, labels = [r.text for r in sample], [r.label for r in sample]
    del sample
    model = fit(texts, labels)
    del texts
    give_back()
    return model


def quality_scores(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, held_out, score, predicted) for every row of df, from the text alone.

    score: 0 to 1, the chance of label 1; predicted: 1 if score >= 0.5. A null or empty text, or one of white space,
    gets the classes' prior. Null ids stay null and are not held out; repeated rows give repeated results, an empty
    table an empty one; texts are scored whole; other columns are not read.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = shared.value.score(batch.column(1))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["id", "held_out", "score", "predicted"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), held_out(F.col(id_col)).alias("h"))
    return map_batches(rows, score, "id long, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)


def keep_quality(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of df that the model predicts as 1, with df's columns and types; nothing is shuffled."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text_col)

    def run(batches):
        for batch in batches:
            column = batch.column(at).cast(pa.string())
            yield batch.filter(pa.array(shared.value.score(column) >= 0.5))

    return map_arrow(df, run, df.schema)
