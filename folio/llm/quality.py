"""Quality classifier.

Method: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader updates and scored as
sparse dot products.  Words and pairs of words are hashed to a fixed number of slots, so the model has a fixed size
whatever the corpus; it is fitted on a bounded sample of labelled rows and scores every whole text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import blocks, register, released, row_key, table, texts
from folio.session import materialise

SLOTS = 1 << 18
SAMPLE_ROWS = 6000
EPOCHS = 8
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.05, 0.1
THRESHOLD = 0.3
BLOCK_BYTES = 1_000_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_powers = {0: (np.ones(1, np.uint64), np.ones(1, np.uint64))}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    up, down = _powers[0]
    if len(up) < n:
        inverse = pow(_BASE, -1, 1 << 64)
        up, down = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)])) for b in (_BASE, inverse))
        if n <= 4 * BLOCK_BYTES:
            _powers[0] = (up, down)
    return up[:n], down[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of all texts, A-Z lowered, and where each text's words start (one more entry than texts)."""
    raw = _LOWER[np.frombuffer(b" ".join([b"", *bodies, b""]), np.uint8)]
    space = _SPACE[raw]
    starts = np.nonzero(space[:-1] & ~space[1:])[0] + 1
    ends = np.nonzero(~space[:-1] & space[1:])[0] + 1
    up, down = _power_tables(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    h = mixed((total[ends] - total[starts]) * down[starts])
    edges = np.cumsum([1, *(len(b) + 1 for b in bodies)])
    return h, np.searchsorted(starts, edges)


def ngram_slots(bodies: list[bytes], slots: int) -> tuple[np.ndarray, np.ndarray]:
    """Slot of every word and every pair of neighbours, text by text, and where each text's entries start."""
    h, at = word_hashes(bodies)
    shift = np.uint64(64 - (slots - 1).bit_length())
    doc = np.repeat(np.arange(len(bodies)), np.diff(at))
    inner = np.nonzero(doc[1:] == doc[:-1])[0]
    pairs = mixed(h[inner] * np.uint64(3) + h[inner + 1])
    both = np.concatenate([h, pairs])
    where = np.concatenate([doc, doc[inner]])
    order = np.argsort(where, kind="stable")
    sizes = np.bincount(where, minlength=len(bodies))
    return (both[order] >> shift).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)])


def values(counts: np.ndarray) -> np.ndarray:
    """Feature values of one text: the counts at unit length."""
    return counts / np.sqrt((counts * counts).sum())


def train(rows: list[tuple[np.ndarray, np.ndarray, float]], slots: int, epochs: int = EPOCHS) -> np.ndarray:
    """Weights, the last one for the constant; ``rows`` are (slots, values, label)."""
    z, n = np.zeros(slots + 1), np.zeros(slots + 1)

    def weight(i):
        w = -(z[i] - np.sign(z[i]) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2)
        return np.where(np.abs(z[i]) > L1, w, 0.0)

    for _ in range(epochs):
        for idx, val, y in rows:
            w = weight(idx)
            g = (1 / (1 + np.exp(-np.clip(w @ val, -35, 35))) - y) * val
            more = n[idx] + g * g
            z[idx] += g - (np.sqrt(more) - np.sqrt(n[idx])) / ALPHA * w
            n[idx] = more
    return weight(np.arange(slots + 1))


def scores(bodies: list[bytes], weights: np.ndarray) -> np.ndarray:
    """Probability of label 1 for each text."""
    slots = len(weights) - 1
    idx, at = ngram_slots(bodies, slots)
    doc = np.repeat(np.arange(len(bodies), dtype=np.int64), np.diff(at))
    dot = np.bincount(doc, weights=weights[idx], minlength=len(bodies))
    order = np.sort(doc * slots + idx)  # equal slots of one text side by side
    new = np.concatenate([[True], order[1:] != order[:-1]]) if len(order) else np.empty(0, bool)
    first = np.nonzero(new)[0]
    counts = np.diff(np.concatenate([first, [len(order)]]))
    square = np.bincount(order[first] // slots, weights=counts * counts, minlength=len(bodies))
    return 1 / (1 + np.exp(-np.clip(weights[-1] + dot / np.sqrt(np.maximum(square, 1)), -35, 35)))


def _held_out(doc_id: str, folds: int):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", *, slots: int = SLOTS, sample_rows: int = SAMPLE_ROWS, folds: int = 5) -> np.ndarray:
    """Weights learnt from ``sample_rows`` labelled rows outside the held-out fold, drawn by a hash of ``doc_id``.

    Rows with another label than 0 or 1, or without ``doc_id``, are no labels.  The sample bounds what the training
    task holds; n-grams are counted where the documents lie.  Without any labels all weights are zero.
    """
    spark = docs.sparkSession
    marked = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~_held_out("doc_id", folds))
    drawn = marked.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("double").alias("y"), F.xxhash64("doc_id").alias("draw"))
    sample = materialise(drawn.orderBy("draw", "doc_id", "y").limit(sample_rows))

    def count(batches):
        for b in blocks(batches, "body", BLOCK_BYTES):
            idx, at = ngram_slots(b.column("body").to_pylist(), slots)
            found = [np.unique(idx[a:e], return_counts=True) for a, e in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column("draw"), b.column("doc_id"), b.column("y"), pa.array([s for s, _ in found], pa.list_(pa.int32())), pa.array([c for _, c in found], pa.list_(pa.int32()))],
                names=["draw", "doc_id", "y", "slots", "counts"])

    def learn(batches):
        rows = []
        for b in batches:
            for y, s, c in zip(b.column("y").to_pylist(), b.column("slots"), b.column("counts"), strict=True):
                c = c.values.to_numpy().astype(float)
                rows.append((np.append(s.values.to_numpy(), slots), np.append(values(c) if len(c) else c, 1.0), y))
        yield pa.RecordBatch.from_arrays([pa.array([train(rows, slots).tobytes()], pa.binary())], names=["weights"])

    body = texts(docs).withColumn("doc_id", F.col("doc_id").cast("bigint")).join(F.broadcast(sample), "doc_id")  # at most sample_rows rows of three numbers
    counted = body.select("draw", "doc_id", "y", "body").mapInArrow(count, "draw bigint, doc_id bigint, y double, slots array<int>, counts array<int>")
    model = counted.repartition(1).sortWithinPartitions("draw", "doc_id", "y")
    rows = model.mapInArrow(learn, "weights binary").collect()  # one row of fixed size
    return np.frombuffer(rows[0]["weights"], np.float64) if rows else np.zeros(slots + 1)


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, k1, k2 (see ``row_key``) and ``score``, 0 to 1, for every row; an empty or null text gets the constant's score."""
    model = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        for b in blocks(batches, "body", BLOCK_BYTES):
            got = scores(b.column("body").to_pylist(), model.value)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "k1", "k2")), pa.array(got)], names=["doc_id", "k1", "k2", "score"])

    rows = row_key(texts(docs)).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return rows.mapInArrow(lambda b: released(run(b)), "doc_id bigint, k1 bigint, k2 bigint, score double")


def accepted(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """Rows of ``docs`` with a score of at least ``threshold``, unchanged, with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        for b in blocks(batches, text, BLOCK_BYTES):
            got = scores(b.column(text).cast(pa.binary()).fill_null(b"").to_pylist(), model.value)
            yield b.filter(pa.array(got >= threshold))

    return docs.mapInArrow(lambda b: released(run(b)), docs.schema)


@register
def op1_quality(spark, sf):
    docs = table(spark, sf, "documents")
    weights = fit(docs, table(spark, sf, "labels"))
    return score(docs, weights).select(
        "doc_id", _held_out("doc_id", 5).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
