"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text: its words (runs of letters, digits and bytes above ASCII, lower-cased), pairs of neighbours
and pairs with one word between, hashed to 2**DIMENSION_BITS coordinates, present or not. Each coordinate has its
own learning rate; the L1 term keeps all but a few weights at zero, and only those are sent to the scoring tasks,
in arrays bounded by the number of coordinates. Scores look at the whole text and nothing else.

Learning reads a bounded sample: the `max_rows` labelled rows with the smallest hash of the id. Its ids (at most
max_rows) are broadcast to fetch the texts; one task then goes over them `EPOCHS` times in hash order, so the
result does not depend on partitions.

Null and empty texts get the score of the intercept alone. Rows without a label, or with a null one, are not
learned from; of several labels of an id the largest counts. Without any labelled row every score is 0.01.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewatch.llm import words as W

DIMENSION_BITS = 24
MAX_ROWS = 20_000
EPOCHS = 8
ALPHA, BETA, L2 = 0.5, 1.0, 0.0
MOST_L1, L1_BY_POSITIVES = 8.0, 0.01  # the L1 term: 1 plus this share of the positive rows, at most 8
INTERCEPT = -1
_BETWEEN = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def features(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, coordinate) of every n-gram and skip-gram, repeats included."""
    words = W.split(data, offsets, lower=True, between=_BETWEEN)
    h, doc = words.hashes, words.doc
    found, owners = [h], [doc]
    for gap in (1, 2):
        if len(h) > gap:
            same = doc[gap:] == doc[:-gap]
            found.append(W.mix(h[:-gap] * np.uint64(3) + W.mix(h[gap:], gap))[same])
            owners.append(doc[gap:][same])
    return np.concatenate(owners), (W.mix(np.concatenate(found), 9) >> np.uint64(64 - bits)).astype(np.int64)


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(min(x, 35.0), -35.0)))


def learn(texts: list[np.ndarray], labels: list[int], bits: int, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """(coordinates, weights, intercept) of a pass of FTRL-proximal over texts given as coordinate arrays."""
    z, n = np.zeros(1 << bits, dtype=np.float32), np.zeros(1 << bits, dtype=np.float32)
    rate = (sum(labels) + 0.5) / (len(labels) + 50.0)
    base = math.log(rate / (1 - rate))
    shift = squares = 0.0
    l1 = np.float32(min(MOST_L1, 1 + L1_BY_POSITIVES * sum(labels)))

    def weights(at):
        rest = np.sign(z[at]) * l1 - z[at]
        return np.where(np.abs(z[at]) <= l1, np.float32(0), rest / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(epochs):
        for at, label in zip(texts, labels):
            w = weights(at)
            g = _sigmoid(base + shift + float(w.sum())) - label
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
            squares += g * g
            shift -= ALPHA * g / (BETA + math.sqrt(squares))
    kept = np.flatnonzero(np.abs(z) > l1)
    return kept, weights(kept).astype(np.float32), base + shift


def training_rows(docs: DataFrame, labels: DataFrame, held_out, max_rows: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(order, text, label) of the bounded sample; `held_out(column)` marks ids that must not be learned from."""
    ids = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label is not null")
    chosen = (
        ids.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
        .select(F.xxhash64("doc_id").alias("order"), "doc_id", "label").orderBy("order", "doc_id").limit(max_rows)
    )
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").select("order", "text", "label")


def fit(docs: DataFrame, labels: DataFrame, held_out, max_rows: int = MAX_ROWS, bits: int = DIMENSION_BITS,
        id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[np.ndarray, np.ndarray, float]:
    """Compact weights of the sample."""

    def train(batches):
        texts, answers = [], []
        for batch in batches:
            label = batch.column(2).to_pylist()
            for low, high, data, offsets in W.slices(batch.column(1)):
                doc, at = features(data, offsets, bits)
                pairs = np.unique(doc << bits | at)
                cuts = np.searchsorted(pairs, np.arange(high - low + 1) << bits)
                for i in range(high - low):
                    texts.append((pairs[cuts[i] : cuts[i + 1]] & ((1 << bits) - 1)).astype(np.int32))
                    answers.append(label[low + i])
        at, w, intercept = learn(texts, answers, bits)
        yield pa.RecordBatch.from_arrays([pa.array([*at.tolist(), INTERCEPT], pa.int64()), pa.array([*w.tolist(), intercept], pa.float64())], ["at", "weight"])

    W.small_batches(docs.sparkSession)
    rows = training_rows(docs, labels, held_out, max_rows, id_col, text_col, label_col)
    model = rows.repartition(1).sortWithinPartitions("order", "text").mapInArrow(train, "at long, weight double").collect()
    found = {r[0]: r[1] for r in model}  # at most 2**bits weights and the intercept
    intercept = found.pop(INTERCEPT, math.log(0.01 / 0.99))
    at = np.array(sorted(found), dtype=np.int64)
    return at, np.array([found[i] for i in at.tolist()], dtype=np.float32), intercept


def scored(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], bits: int = DIMENSION_BITS, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns named in `keep` (default all) and `score`, for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(*(keep if keep is not None else docs.columns))
    score = W.fresh_name(source, "score")
    width, names = len(source.columns), [*source.columns, score]

    def run(batches):
        at, weight, intercept = shared.value
        table = np.zeros(1 << bits, dtype=np.float32)
        table[at] = weight
        for batch in batches:
            for low, high, data, offsets in W.slices(batch.column(width).cast(pa.string())):
                doc, found = features(data, offsets, bits)
                hit = table[found] != 0
                pairs = np.unique(doc[hit] << bits | found[hit])
                total = np.bincount(pairs >> bits, weights=table[pairs & ((1 << bits) - 1)], minlength=high - low)
                value = 1 / (1 + np.exp(-np.clip(total + intercept, -35, 35)))
                yield pa.RecordBatch.from_arrays([*(batch.column(i)[low:high] for i in range(width)), pa.array(value)], names)

    schema = ", ".join(f"`{n}` {t}" for n, t in [*source.dtypes, (score, "double")])
    texts = docs.select(*source.columns, F.col(text_col).cast("string").alias(W.fresh_name(source, "scored_text")))
    return texts.mapInArrow(run, schema)
