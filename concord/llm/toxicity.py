"""Toxicity: a factorization machine over hashed terms.

Terms are the words of a text and the first 3 to 6 bytes of longer words (so that
inflected forms of a known stem count), hashed into 2**BITS, with the logarithm of
their count.  The machine learns an intercept, linear weights and factors whose inner
products weigh pairs of terms, by AdaGrad on the logistic loss.  Its terms are those
whose mean values differ between the labels of the sample and, after a first fit, those
in pairs that go with what that fit leaves unexplained: terms that matter only together
have no difference of their own.

Defined cases: null and empty texts score the intercept alone; whole texts count;
ids, labels, language and source never enter a score; a sample without both labels
gives the constant score of its label's share (0.5 without any row); an empty table
gives no rows; repeated and tied rows count each time, in the order of a hash of their
text; long texts are scored whole, in blocks of rows of 1 MB or of one longer text; no
extra column is read, whatever its name.
"""

from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.llm.training import TRAIN_ROWS, id_remainder, labelled_sample
from concord.llm.words import alphanumeric_words, blocks, hash_runs, pair_hash, release, string_parts, word_bounds

BITS = 20
PREFIXES = (3, 4, 5, 6)
THRESHOLD = 0.7


@dataclass(frozen=True)
class MachineSettings:
    """factors: size of each term's vector; z, least: the screen's normal score and documents with the term; terms: most
    terms kept, by score, a bound of memory; pair_terms, pair_z: most frequent terms whose pairs are looked at, and their normal
    score; rate, l2, epochs: of AdaGrad; start, slow: where the intercept, learned too, begins, and its share of the rate."""

    factors: int = 8
    z: float = 4.5
    least: int = 3
    terms: int = 1 << 16
    pair_terms: int = 4096
    pair_z: float = 6.0
    rate: float = 0.15
    l2: float = 2e-4
    epochs: int = 20
    start: float = -2.0
    slow: float = 0.05


def term_blocks(texts: pa.Array):
    """For each block of rows: (first, last, term ids, row of each), repeats included."""
    table = alphanumeric_words()
    offsets, data = string_parts(texts)
    for first, last in blocks(offsets):
        lo, hi = offsets[first], offsets[last]
        b = table[data[lo:hi]]
        starts, ends, row = word_bounds(offsets[first : last + 1] - lo, b)
        words, heads = hash_runs(b, starts, ends, PREFIXES)
        ids, rows = [words], [row]
        for k in PREFIXES:
            longer = np.flatnonzero(ends - starts > k)
            ids.append(pair_hash(heads[k][longer], np.uint64(k)))
            rows.append(row[longer])
        yield first, last, (np.concatenate(ids) >> np.uint64(64 - BITS)).astype(np.int32), np.concatenate(rows)


def counted(ids: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, value) of each distinct term of each row; a term that comes n times has the value log2(1 + n)."""
    key, n = np.unique(row.astype(np.int64) << 32 | ids, return_counts=True)
    return key >> 32, key & 0xFFFFFFFF, np.log2(1 + n)


def term_rows(texts: pa.Array):
    """(distinct term ids, values) of each text."""
    for first, last, ids, row in term_blocks(texts):
        row, ids, values = counted(ids, row)
        cuts = np.searchsorted(row, np.arange(last - first + 1))
        ids, values = ids.astype(np.int32), values.astype(np.float32)
        for i in range(last - first):
            yield ids[cuts[i] : cuts[i + 1]], values[cuts[i] : cuts[i + 1]]


@dataclass(frozen=True)
class Machine:
    """terms: the ids kept, ascending; w0, w, v: intercept, weights and factors of those."""

    terms: np.ndarray
    w0: float
    w: np.ndarray
    v: np.ndarray

    def slots(self) -> np.ndarray:
        slot = np.full(1 << BITS, -1, np.int32)
        slot[self.terms] = np.arange(len(self.terms))
        return slot

    def packed(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, terms=self.terms, w0=self.w0, w=self.w, v=self.v)
        return out.getvalue()

    @classmethod
    def unpacked(cls, data: bytes) -> Machine:
        x = np.load(io.BytesIO(data))
        return cls(x["terms"], float(x["w0"]), x["w"], x["v"])


def screen(rows: list, labels: np.ndarray, settings: MachineSettings) -> np.ndarray:
    """Ids of terms whose mean value differs between the labels."""
    size, yes = 1 << BITS, int(labels.sum())
    no = len(labels) - yes
    if not yes or not no:
        return np.zeros(0, np.int64)
    seen, sums, squares = np.zeros(size), np.zeros((2, size)), np.zeros(size)
    for (ids, x), y in zip(rows, labels, strict=True):
        seen[ids] += 1
        sums[int(y), ids] += x
        squares[ids] += x * x
    n = len(labels)
    variance = np.maximum(squares / n - (sums.sum(axis=0) / n) ** 2, 1e-12)
    z = np.where(seen >= settings.least, np.abs(sums[1] / yes - sums[0] / no) / np.sqrt(variance * (1 / yes + 1 / no)), 0)
    best = np.argsort(-z, kind="stable")[: settings.terms]
    return np.sort(best[z[best] >= settings.z])


def paired(rows: list, left: np.ndarray, settings: MachineSettings) -> np.ndarray:
    """Ids of terms in pairs whose documents a fit leaves unexplained in one direction; ``left``: label less score of each row."""
    on = np.flatnonzero(np.abs(left) >= 0.05)
    seen = np.zeros(1 << BITS)
    for i in on:
        seen[rows[i][0]] += 1
    often = np.argsort(-seen, kind="stable")[: settings.pair_terms]
    often = np.sort(often[seen[often] >= settings.least])
    if not len(often):
        return often
    slot = np.full(1 << BITS, -1, np.int64)
    slot[often] = np.arange(len(often))
    has = np.zeros((len(on), len(often)), np.float32)
    for k, i in enumerate(on):
        has[k, (own := slot[rows[i][0]])[own >= 0]] = 1
    r = left[on].astype(np.float32)[:, None]
    z = np.abs(has.T @ (has * r)) / np.sqrt(has.T @ (has * r * r) + 1)
    np.fill_diagonal(z, 0)
    return often[z.max(axis=0) >= settings.pair_z]


def raw_score(machine: Machine, slot: np.ndarray, ids: np.ndarray, x: np.ndarray) -> float:
    known = slot[ids]
    known, x = known[known >= 0], x[known >= 0].astype(float)
    vx = machine.v[known] * x[:, None]
    total = vx.sum(axis=0)
    return machine.w0 + float(machine.w[known] @ x) + 0.5 * float(total @ total - (vx * vx).sum())


def fit_terms(rows: list, labels: np.ndarray, terms: np.ndarray, settings: MachineSettings) -> Machine:
    """The machine of given terms."""
    n, k, share = len(terms), settings.factors, float(np.mean(labels))
    slot = np.full(1 << BITS, -1, np.int64)
    slot[terms] = np.arange(n)
    kept = [((own := slot[ids])[on := own >= 0], values[on].astype(float)) for ids, values in rows]
    w0, w, v = settings.start, np.zeros(n), np.random.default_rng(7).normal(0, 0.02, (n, k))
    g0, gw, gv = 1.0, np.ones(n), np.ones((n, k))
    weight = (0.5 / (1 - share), 0.5 / share)
    for epoch in range(settings.epochs):
        for i in np.random.default_rng(epoch).permutation(len(kept)):
            (ids, x), y = kept[i], labels[i]
            vi, xc = v[ids], x[:, None]
            total = (vi * xc).sum(axis=0)
            raw = w0 + w[ids] @ x + 0.5 * float((total * total - (vi * vi * xc * xc).sum(axis=0)).sum())
            g = (1 / (1 + np.exp(-min(max(raw, -30), 30))) - y) * weight[int(y)]
            g0 += g * g
            w0 -= settings.slow * settings.rate * g / np.sqrt(g0)
            if len(ids):
                d = g * x + settings.l2 * w[ids]
                gw[ids] += d * d
                w[ids] -= settings.rate * d / np.sqrt(gw[ids])
                d = g * xc * (total - vi * xc) + settings.l2 * vi
                gv[ids] += d * d
                v[ids] = vi - settings.rate * d / np.sqrt(gv[ids])
    return Machine(terms, float(w0), w, v)


def fit_machine(rows: list, labels: np.ndarray, settings: MachineSettings = MachineSettings()) -> Machine:
    """Machine of the screened terms and, if pairs explain what is left, of theirs too."""
    share = float(np.mean(labels)) if len(labels) else 0.5
    if share in (0.0, 1.0) or not len(labels):
        share = min(max(share, 1e-3), 1 - 1e-3)
        return Machine(np.zeros(0, np.int64), float(np.log(share / (1 - share))), np.zeros(0), np.zeros((0, settings.factors)))
    terms = screen(rows, labels, settings)
    machine = fit_terms(rows, labels, terms, settings)
    slot = machine.slots()
    raw = np.array([raw_score(machine, slot, ids, x) for ids, x in rows])
    low, high = -60.0, 60.0
    for _ in range(60):  # labels weigh alike in the fit, so its scores are brought to the share of ones first
        middle = (low + high) / 2
        scores = 1 / (1 + np.exp(-np.clip(raw + middle, -30, 30)))
        low, high = (middle, high) if scores.mean() < share else (low, middle)
    both = np.union1d(terms, paired(rows, labels - scores, settings))
    return fit_terms(rows, labels, both, settings) if len(both) > len(terms) else machine


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", limit: int = TRAIN_ROWS, settings: MachineSettings = MachineSettings()) -> Machine:
    """Machine from a bounded sample, fitted by one executor task (which can be run again)."""

    def train(batches):
        rows, marks = [], []
        for batch in batches:
            rows += list(term_rows(batch.column(0)))
            marks += batch.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([fit_machine(rows, np.array(marks, float), settings).packed()], pa.binary())], names=["model"])

    sample = labelled_sample(docs, labels, label, limit).repartition(1).sortWithinPartitions(F.xxhash64("text"), "text", "label")
    found = sample.mapInArrow(train, "model binary").first()  # an empty sample has no task
    return Machine.unpacked(found[0]) if found else fit_machine([], np.zeros(0), settings)


def score_array(texts: pa.Array, machine: Machine, slot: np.ndarray | None = None) -> pa.Array:
    slot = machine.slots() if slot is None else slot
    out = np.full(len(texts), machine.w0)
    for first, last, ids, row in term_blocks(texts):
        known = slot[ids]
        on = known >= 0
        row, known, x = counted(known[on], row[on])
        rows = last - first
        out[first:last] += np.bincount(row, machine.w[known] * x, rows)
        for f in range(machine.v.shape[1]):
            v = machine.v[known, f] * x
            out[first:last] += 0.5 * (np.bincount(row, v, rows) ** 2 - np.bincount(row, v * v, rows))
    release()
    return pa.array(1 / (1 + np.exp(-np.clip(out, -30, 30))))


def score(text: Column, machine: Machine, session) -> Column:
    """Column of scores from 0 to 1."""
    shared, held = session.sparkContext.broadcast(machine.packed()), []

    @F.arrow_udf("double")
    def toxicity_score(texts: pa.Array) -> pa.Array:
        if not held:  # once for each worker
            own = Machine.unpacked(shared.value)
            held.append((own, own.slots()))
        return score_array(texts, *held[0])

    return toxicity_score(text)


def classify(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``."""
    machine = fit(docs, labels, limit=limit)
    held = id_remainder(F.col("doc_id"), 3) == 1
    scored = docs.select("doc_id", held.alias("held_out"), score(F.col("text"), machine, docs.sparkSession).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
