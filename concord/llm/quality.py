"""Quality classifier: hashed word n-gram logistic regression, fitted by FTRL-proximal.

Features are word unigrams and bigrams and, so that unseen words of a known make
count too, unigrams and bigrams of word shapes (runs of upper-case letters, other
letters, digits and each mark, one symbol a run).  They are hashed into 2**BITS
weights and weigh their share of the text's features.  A score is one sparse dot
product and a sigmoid.

Defined cases: null and empty texts score the intercept alone; a text of any
length is scored whole, in constant memory a word; ids, labels, language and source
never enter a score; without labels of both kinds the model is the intercept of
what there is (0 without any label, score 0.5); an empty table gives no rows; repeated and
tied rows of the sample count each time, in the order of a hash of their text; blocks of
rows of 1 MB or of one longer text are scored at once; no extra column is read, whatever
its name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.llm.training import id_remainder, labelled_sample
from concord.llm.words import ascii_lower_words, blocks, hash_runs, pair_hash, release, string_parts, word_bounds

BITS = 18
#: Bound of the labelled sample: junk differs so much that more rows don't help, and their features take memory.
TRAIN_ROWS = 5_000
#: Feature values are shares of the text, brought to this sum for each kind of feature.
SCALE = 16.0


@dataclass(frozen=True)
class FtrlSettings:
    """alpha, beta: learning rate; l1, l2: regularisation; epochs over the sample."""

    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.05
    l2: float = 0.5
    epochs: int = 4


def shape_table() -> np.ndarray:
    """Byte map to symbols of word shape: A (upper case), a (lower case, other scripts), 0 (digits), marks as they are."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91], table[97:123], table[128:256], table[48:58] = 65, 97, 97, 48
    table[[9, 10, 11, 12, 13, 32]] = 0
    return table


def feature_blocks(texts: pa.Array):
    """For each block of rows: (first, last, [(feature ids, row of each)] by kind)."""
    lower, shapes = ascii_lower_words(), shape_table()
    offsets, data = string_parts(texts)
    for first, last in blocks(offsets):
        lo, hi = offsets[first], offsets[last]
        raw, edges = data[lo:hi], offsets[first : last + 1] - lo
        b = lower[raw]
        starts, ends, row = word_bounds(edges, b)
        words = hash_runs(b, starts, ends)[0]
        s = shapes[raw]
        keep = np.ones(len(s), bool)
        keep[1:] = s[1:] != s[:-1]
        keep[starts] = True
        moved = np.concatenate([[0], np.cumsum(keep)])
        shape = hash_runs(s[keep], moved[starts], moved[ends])[0]
        kinds, together = [], row[1:] == row[:-1]
        for salt, h in ((1, words), (2, shape)):
            kinds.append((pair_hash(h, np.uint64(salt)), row))
            kinds.append((pair_hash(pair_hash(h[:-1], h[1:]), np.uint64(salt + 2))[together], row[1:][together]))
        yield first, last, [((h >> np.uint64(64 - BITS)).astype(np.int32), r) for h, r in kinds]


def row_shares(row: np.ndarray, rows: int) -> np.ndarray:
    """Value of each feature: its share of its row's features of that kind."""
    return (SCALE / np.maximum(np.bincount(row, minlength=rows), 1))[row]


def sparse_rows(texts: pa.Array):
    """(ids, values) of each text, ids distinct and ascending."""
    for first, last, kinds in feature_blocks(texts):
        rows = last - first
        key = np.concatenate([r.astype(np.int64) << BITS | ids for ids, r in kinds])
        value = np.concatenate([row_shares(r, rows) for _, r in kinds])
        distinct, place = np.unique(key, return_inverse=True)
        summed = np.bincount(place, value, len(distinct))
        cuts = np.searchsorted(distinct >> BITS, np.arange(rows + 1))
        ids = (distinct & ((1 << BITS) - 1)).astype(np.int32)
        for i in range(rows):
            yield ids[cuts[i] : cuts[i + 1]], summed[cuts[i] : cuts[i + 1]].astype(np.float32)


def fit_ftrl(rows: list, labels: np.ndarray, settings: FtrlSettings = FtrlSettings()) -> np.ndarray:
    """Weights (the last is the intercept) after per-coordinate FTRL-proximal updates over ``rows`` in their order."""
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weights(i):
        over = np.abs(z[i]) - settings.l1 * (i != size - 1)
        return np.where(over > 0, -np.sign(z[i]) * over / ((settings.beta + np.sqrt(n[i])) / settings.alpha + settings.l2), 0.0)

    for _ in range(settings.epochs):
        for (ids, values), y in zip(rows, labels, strict=True):
            i, x = np.append(ids, size - 1), np.append(values, 1.0)
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
            g = (p - y) * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / settings.alpha * w
            n[i] += g * g
    return weights(np.arange(size))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = TRAIN_ROWS, settings: FtrlSettings = FtrlSettings()) -> np.ndarray:
    """Weights from a bounded sample, fitted by one executor task (which can be run again)."""

    def train(batches):
        rows, marks = [], []
        for batch in batches:
            rows += list(sparse_rows(batch.column(0)))
            marks += batch.column(1).to_pylist()
        w = fit_ftrl(rows, np.array(marks, float), settings).astype(np.float32)
        rows.clear()
        release()
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary())], names=["model"])

    sample = labelled_sample(docs, labels, label, limit).repartition(1).sortWithinPartitions(F.xxhash64("text"), "text", "label")
    found = sample.mapInArrow(train, "model binary").first()  # an empty sample has no task
    return np.frombuffer(found[0], np.float32) if found else fit_ftrl([], np.zeros(0), settings).astype(np.float32)


def score_array(texts: pa.Array, weights: np.ndarray) -> pa.Array:
    out = np.full(len(texts), float(weights[-1]))
    for first, last, kinds in feature_blocks(texts):
        for ids, row in kinds:
            counts = np.bincount(row, minlength=last - first)
            out[first:last] += SCALE * np.bincount(row, weights[ids], last - first) / np.maximum(counts, 1)
    release()
    return pa.array(1 / (1 + np.exp(-np.clip(out, -30, 30))))


def score(text: Column, weights: np.ndarray, session) -> Column:
    """Column of scores from 0 to 1."""
    shared = session.sparkContext.broadcast(weights)

    @F.arrow_udf("double")
    def quality_score(texts: pa.Array) -> pa.Array:
        return score_array(texts, shared.value)

    return quality_score(text)


def classify(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``."""
    weights = fit(docs, labels, limit=limit)
    held = id_remainder(F.col("doc_id"), 3) == 1
    scored = docs.select("doc_id", held.alias("held_out"), score(F.col("text"), weights, docs.sparkSession).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject."""
    weights = fit(docs, labels, limit=limit)
    return docs.where(score(F.col("text"), weights, docs.sparkSession) >= 0.5)
