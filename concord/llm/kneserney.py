"""Interpolated modified Kneser-Ney n-gram model, counted in Spark and scored from memory-mapped arrays.

Words (and the end of a text) are 64-bit hashes; a text starts with ``order - 1`` start
marks.  Tasks pre-aggregate counts and ship them as packed arrays by shard; a shard is
a range of the leading bits of a hash.  Shards follow the number of tokens.

1. Unigram counts, merged by word shard; words with a large share of all tokens
   ("hot", a bounded list) are found.
2. Counts of the longest n-grams, merged in the shard of the word before the last, or,
   where that is hot, spread over all shards by their own hash.  Each distinct n-gram is
   in one shard only, so all that is derived from it can be added up later.
3. Level by level downwards: an n-gram's different predecessors, and, of what follows
   it, the total and how many came once, twice or more often.

Each level leaves a file of sorted hashes and counts for each shard.  Workers map the
files and look up the distinct n-grams of a block of texts in sorted order.

P_k(w|c) = max(a(c,w)-D_k(a),0)/a(c) + g_k(c) P_(k-1)(w|c'), with a the count at the
longest level and the number of different predecessors below, down to 1/(V+1); D_k has
three values from counts of counts, kept above zero, so that no probability is zero.
Files go to the shared folder; where it is no mounted path, workers copy the files that
they need into an unlinked file, whose space is free again when they end.

Defined cases: null texts are empty, and score their end; unknown words get their
share of the lowest level; without training texts every token scores 1/(V+1) = 1;
repeated rows count each time; an empty table gives no rows; texts are scored whole, in
blocks of rows of 1 MB or of one longer text; extra columns are never read, whatever
their names; rows that tie score the same.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.llm.store import discard, materialize, new_folder, opened, shared
from concord.llm.training import id_remainder
from concord.llm.words import ascii_lower_words, hashed_blocks, pair_hash, release, splitmix

#: Hashes of the start, as a context, and of the end, as a word.
START, END = (splitmix(np.array([x], np.uint64))[0] for x in (0x5354415254, 0x454E44))
#: Words of the longest n-grams.
ORDER = 3
#: Entries that a task gathers before it ships them; tokens of a shard; bytes of text of a shard of words.
FLUSH, SHARD_TOKENS, SHARD_BYTES = 2_000_000, 1_500_000, 64 << 20
#: Base model's pseudo-count.
DELTA = 0.1
#: Least discount, and by how much a count exceeds its discount at least.
LEAST_DISCOUNT = 0.05


def log2_shards(parts: float) -> int:
    """Leading bits for about ``parts`` shards (16 to 2**20)."""
    return min(max(int(np.ceil(np.log2(max(parts, 1)))), 4), 20)


def text_parts(df: DataFrame) -> float:
    """Shards of words for a DataFrame, by the plan's size where it is known, and the session's shuffle partitions else."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size / SHARD_BYTES if size < 1 << 56 else float(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def gram_hash(words: list[np.ndarray]) -> np.ndarray:
    """Hash of n-grams given as a column for each place."""
    out = words[0]
    for w in words[1:]:
        out = pair_hash(out, w)
    return out


def placed(words: list[np.ndarray], hot: np.ndarray, bits: int) -> np.ndarray:
    """Keys of n-grams; the leading bits, the shard, are those of the word before the last, or of the hash itself where that is hot."""
    mixed = gram_hash(words)
    if len(words) == 1:
        return mixed
    u = words[-2]
    low = np.uint64((1 << 64 - bits) - 1)
    own = (u & ~low) | (mixed & low)
    at = np.minimum(np.searchsorted(hot, u), len(hot) - 1)
    return np.where(hot[at] == u, mixed, own)


def token_grams(h: np.ndarray, row: np.ndarray, rows: int, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """(columns of the n-gram that ends at each token, row of each token), a text's end included."""
    lengths = np.bincount(row, minlength=rows) + 1
    stops = np.cumsum(lengths)
    tokens = np.empty(len(h) + rows, np.uint64)
    ends = np.zeros(len(tokens), bool)
    ends[stops - 1] = True
    tokens[~ends], tokens[ends] = h, END
    place = np.arange(len(tokens)) - np.repeat(stops - lengths, lengths)
    columns = [tokens]
    for k in range(1, order):
        before = np.full_like(tokens, START)
        before[k:] = tokens[:-k] if k < len(tokens) else before[k:]
        before[place < k] = START
        columns.insert(0, before)
    return columns, np.repeat(np.arange(rows), lengths)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and their summed counts."""
    order, first = runs(keys)
    return keys[order[first]], np.add.reduceat(counts[order], first) if len(first) else counts


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order that sorts the keys, where there each distinct one starts)."""
    order = np.argsort(keys, kind="quicksort")
    return order, np.flatnonzero(np.append(True, keys[order][1:] != keys[order][:-1])) if len(keys) else np.zeros(0, np.int64)


def distinct_grams(words: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct n-grams and their summed counts."""
    order, first = runs(gram_hash(words))
    return [w[order[first]] for w in words], np.add.reduceat(counts[order], first) if len(first) else counts


def narrow(x: np.ndarray) -> bytes:
    """Counts in the fewest bytes each, the width first."""
    most = int(x.max()) if len(x) else 0
    width = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4 if most < 1 << 32 else 8
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def widen(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.uint64)


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned numbers in one value."""
    parts = [narrow(x) for x in arrays]
    return b"".join([bytes([len(parts)]), *(len(p).to_bytes(8, "little") for p in parts), *parts])


def unpacked(data: bytes) -> list[np.ndarray]:
    n, at, out = data[0], 1 + 8 * data[0], []
    for k in range(n):
        size = int.from_bytes(data[1 + 8 * k : 9 + 8 * k], "little")
        out.append(widen(data[at : at + size]))
        at += size
    return out


def by_shard(keys: np.ndarray, bits: int):
    """(shard, slice) of ascending keys."""
    shards = keys >> np.uint64(64 - bits)
    first = np.flatnonzero(np.append(True, shards[1:] != shards[:-1])) if len(keys) else np.zeros(0, np.int64)
    for a, b in zip(first, np.append(first[1:], len(keys)), strict=True):
        yield int(shards[a]), slice(int(a), int(b))


PIECES = "shard int, kind string, data binary, stats array<long>"
PIECE_FIELDS = (("shard", pa.int32()), ("kind", pa.string()), ("data", pa.binary()), ("stats", pa.list_(pa.int64())))
#: Of a level's counts: those of 1, 2, 3 and 4, those over 2, and their sum.
STATS = 6


def pieces_batch(rows: list[tuple]) -> pa.RecordBatch:
    """A batch of PIECES from rows (shard, kind, data) or (shard, kind, data, stats)."""
    rows = [(*r, None)[:4] for r in rows]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(PIECE_FIELDS)], names=[n for n, _ in PIECE_FIELDS])


def gram_pieces(words: list[np.ndarray], counts: np.ndarray, hot: np.ndarray, bits: int):
    """Rows of kind "gram" by shard: contexts, a column for each place, followers of each, last words and counts."""
    if len(words) == 1:
        order = np.argsort(words[0], kind="quicksort")
        keys, counts = words[0][order], counts[order]
        yield from ((shard, "gram", packed(keys[s], counts[s])) for shard, s in by_shard(keys, bits))
        return
    shard = placed(words, hot, bits) >> np.uint64(64 - bits)
    order = np.lexsort((*words[:-1], shard))
    words, counts, shard = [w[order] for w in words], counts[order], shard[order]
    for k, s in by_shard(shard << np.uint64(64 - bits), bits):
        own = [w[s] for w in words[:-1]]
        new = np.zeros(len(own[0]), bool)
        new[0] = True
        for w in own:
            new[1:] |= w[1:] != w[:-1]
        first = np.flatnonzero(new)
        yield k, "gram", packed(*(w[first] for w in own), np.diff(np.append(first, len(new))).astype(np.uint64), words[-1][s], counts[s])


def grams_of(data: bytes) -> tuple[list[np.ndarray], np.ndarray]:
    """(n-gram columns, counts) of a piece of kind "gram"."""
    *contexts, w, c = unpacked(data)
    if not contexts:
        return [w], c
    followers = contexts.pop().astype(np.int64)
    return [*(np.repeat(u, followers) for u in contexts), w], c


def count_grams(order: int, bits: int, hot: np.ndarray):
    """Texts to pieces of kind "gram" of n-grams of ``order`` words."""

    def run(batches):
        held, rows = [], 0

        def flush():
            words, counts = distinct_grams([np.concatenate(x) for x in zip(*(w for w, _ in held), strict=True)], np.concatenate([c for _, c in held]))
            return pieces_batch(list(gram_pieces(words, counts, hot, bits)))

        for b in batches:
            for first, last, h, row in hashed_blocks(b.column(0), ascii_lower_words()):
                words, _ = token_grams(h, row, last - first, order)
                held.append(distinct_grams(words, np.ones(len(words[0]), np.uint64)))
                rows += len(held[-1][1])
                if rows >= FLUSH:
                    yield flush()
                    held, rows = [], 0
        if held:
            yield flush()
        release()

    return run


class Folder:
    """Files in the shared folder: local paths are used as they are; other stores through Arrow's file systems."""

    def __init__(self, uri: str):
        self.uri = uri
        self.local = uri.removeprefix("file://") if uri.startswith("file://") else uri.removeprefix("file:") if uri.startswith("file:") else None

    def write(self, name: str, keys: np.ndarray, *columns: np.ndarray) -> None:
        """Keys and columns of counts, each count in as few bytes as the largest needs.

        A complete file or none: an interrupted or repeated task leaves no half of one.
        """
        own, parts = f"{name}.{uuid.uuid4().hex}", [narrow(x) for x in columns]
        arrays = [np.array([len(keys), *(p[0] for p in parts)], "<u8"), keys, *(np.frombuffer(p, np.uint8, offset=1) for p in parts)]
        if self.local is not None:
            os.makedirs(self.local, exist_ok=True)
            with open(f"{self.local}/{own}", "wb") as f:
                for x in arrays:
                    f.write(x.tobytes())
            os.replace(f"{self.local}/{own}", f"{self.local}/{name}")
        else:
            from pyarrow import fs

            store, path = fs.FileSystem.from_uri(self.uri)
            store.create_dir(path, recursive=True)
            with store.open_output_stream(f"{path}/{own}") as f:
                for x in arrays:
                    f.write(x.tobytes())
            store.move(f"{path}/{own}", f"{path}/{name}")

    def mapped(self, name: str) -> np.ndarray:
        """The file's bytes, memory-mapped; a file that isn't there is an error."""
        path = f"{self.local}/{name}"
        if self.local is None:
            from pyarrow import fs

            store, base = fs.FileSystem.from_uri(self.uri)
            with tempfile.NamedTemporaryFile(prefix="concord-") as out:  # unlinked at once; the mapping holds its space
                with store.open_input_stream(f"{base}/{name}") as f:
                    while data := f.read(1 << 22):
                        out.write(data)
                out.flush()
                return np.memmap(out.name, np.uint8, "r")
        return np.memmap(path, np.uint8, "r")


    def columns(self, name: str, fields: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """(keys, columns) of a mapped file."""
        raw = self.mapped(name)
        n, *widths = raw[: 8 * (1 + fields)].view("<u8").tolist()
        at = 8 * (1 + fields + n)
        keys, out = raw[8 * (1 + fields) : at].view("<u8"), []
        for w in widths:
            out.append(raw[at : at + n * w].view(f"<u{w}"))
            at += n * w
        return keys, out


def count_unigrams(bits: int):
    """Texts to pieces of kind "count": (hashes, counts)."""

    def run(batches):
        held, rows = [], 0

        def flush():
            keys, counts = summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
            return pieces_batch([(shard, "count", packed(keys[s], counts[s])) for shard, s in by_shard(keys, bits)])

        for b in batches:
            for first, last, h, _ in hashed_blocks(b.column(0), ascii_lower_words()):
                tokens = np.append(h, np.full(last - first, END))
                held.append(summed(tokens, np.ones(len(tokens), np.uint64)))
                rows += len(held[-1][0])
                if rows >= FLUSH:
                    yield flush()
                    held, rows = [], 0
        if held:
            yield flush()
        release()

    return run


def merge_unigrams(hot_from: float):
    """A shard's pieces to one of kind "count", with its tokens and distinct tokens as stats, and one of kind "hot", its frequent words."""

    def run(pieces: pa.Table) -> pa.Table:
        parts = [unpacked(d.as_py()) for d in pieces.column("data")]
        keys, counts = summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        shard, big = pieces.column("shard")[0].as_py(), counts >= hot_from
        return pa.Table.from_batches([pieces_batch([(shard, "count", packed(keys, counts), [int(counts.sum()), len(keys)]), (shard, "hot", packed(keys[big], counts[big]))])])

    return run


def cut_again(bits: int):
    """Pieces of kind "count" by other shards."""

    def run(batches):
        for b in batches:
            rows = []
            for data in b.column(0):
                keys, counts = unpacked(data.as_py())
                rows += [(shard, "count", packed(keys[s], counts[s])) for shard, s in by_shard(keys, bits)]
            yield pieces_batch(rows)

    return run


#: Columns of a level's file: of the longest n-grams the count; of others predecessors, total of what follows, followers seen once,
#: twice and more often; of words, besides, the count.
def width(n: int, order: int) -> int:
    return 1 if n == order else 5 + (n == 1)


def merge_level(n: int, order: int, uri: str, bits: int, hot: np.ndarray):
    """Write a shard's file of n-grams; give the pieces of the level below, and this level's counts of counts as stats."""
    folder = Folder(uri)

    def run(pieces: pa.Table) -> pa.Table:
        shard = pieces.column("shard")[0].as_py()
        parts: dict[str, list] = {"gram": [], "context": [], "count": []}
        for kind, data in zip(pieces.column("kind").to_pylist(), pieces.column("data"), strict=True):
            parts[kind].append(grams_of(data.as_py()) if kind == "gram" else unpacked(data.as_py()))
        words, counts = [np.zeros(0, np.uint64)] * n, np.zeros(0, np.uint64)
        if parts["gram"]:
            words, counts = [np.concatenate(x) for x in zip(*(w for w, _ in parts["gram"]), strict=True)], np.concatenate([c for _, c in parts["gram"]])
        parts["gram"].clear()
        own = placed(words, hot, bits) if len(counts) else counts
        order_, first = runs(own)
        counts = np.add.reduceat(counts[order_], first) if len(first) else counts
        own, words = own[order_[first]], [w[order_[first]] for w in words]
        del order_
        if n == order:
            folder.write(f"level{n}-{shard}", own, counts)
        else:
            keys = np.unique(np.concatenate([own, *(a[0] for kind in ("context", "count") for a in parts[kind])]))
            fields = np.zeros((width(n, order), len(keys)), np.uint64)
            fields[0][np.searchsorted(keys, own)] = counts
            for kind, at in (("context", 1), ("count", 5)):
                for k, *columns in parts[kind]:
                    to = np.searchsorted(keys, k)  # distinct within a piece
                    for i, x in enumerate(columns):
                        fields[at + i][to] += x
            folder.write(f"level{n}-{shard}", keys, *fields)
            del keys, fields
        parts.clear()
        stats = [*(int((counts == k).sum()) for k in (1, 2, 3, 4)), int((counts > 2).sum()), int(counts.sum())]
        out: list[tuple] = [(shard, "stats", b"", stats)]
        if n > 1 and len(counts):
            contexts = placed(words[:-1], hot, bits)
            order_, first = runs(contexts)
            each = counts[order_]
            totals = [np.add.reduceat(x.astype(np.uint64), first) for x in (each, each == 1, each == 2, each > 2)]
            contexts = contexts[order_[first]]
            out += [(k, "context", packed(contexts[s], *(t[s] for t in totals))) for k, s in by_shard(contexts, bits)]
            out += gram_pieces(*distinct_grams(words[1:], np.ones(len(counts), np.uint64)), hot, bits)
        return pa.Table.from_batches([pieces_batch(out)])

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """D for counts 0, 1, 2 and 3 or more, from counts of counts; above zero and below its count, so that what is unseen keeps some mass."""
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
    ratios = (n2 / n1 if n1 else 0.5, n3 / n2 if n2 else 0.5, n4 / n3 if n3 else 0.5)
    return np.array([0.0] + [min(max(k - (k + 1) * y * r, LEAST_DISCOUNT), k - LEAST_DISCOUNT) for k, r in enumerate(ratios, 1)])


@dataclass(frozen=True)
class Model:
    """Where the files are and what holds for all: training tokens, distinct ones, hot words, each level's discounts and shards, the lowest level."""

    uri: str
    order: int
    bits: int
    hot: np.ndarray
    tokens: int
    distinct: int
    total: int = 0
    low_mass: float = 1.0
    discounts: dict[int, np.ndarray] = field(default_factory=dict)
    shards: dict[int, np.ndarray] = field(default_factory=dict)


def level_stats(parts: DataFrame) -> tuple[list[int], np.ndarray]:
    """(summed stats, shards with a file) of a merged level; one row a shard."""
    found = parts.where("kind = 'stats'")
    *sums, shards = found.agg(*[F.sum(F.element_at("stats", k + 1)) for k in range(STATS)], F.sort_array(F.collect_set("shard"))).first()
    return [int(x or 0) for x in sums], np.array(shards, np.int64)


def fit(texts: DataFrame, text: str = "text", order: int = ORDER) -> Model:
    """Count the model over all rows of ``texts``."""
    if order < 2:
        raise ValueError("a Kneser-Ney model has order 2 at least")
    spark = texts.sparkSession
    uri = new_folder(spark, "kneserney")
    rows = texts.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    pieces = rows.mapInArrow(count_unigrams(log2_shards(text_parts(rows))), PIECES)
    unigrams = materialize(pieces.groupBy("shard").applyInArrow(merge_unigrams(1024), PIECES), "unigrams")
    tokens, distinct = (int(x or 0) for x in unigrams.where("kind = 'count'").agg(F.sum(F.element_at("stats", 1)), F.sum(F.element_at("stats", 2))).first())
    bits = log2_shards(tokens / SHARD_TOKENS)
    share = max(tokens / (1 << bits) / 8, 1024)

    def hottest(batches):
        for b in batches:
            out = []
            for data in b.column(0):
                keys, counts = unpacked(data.as_py())
                out += keys[counts >= share].view(np.int64).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["u"])

    # at most 8 * 2**bits words reach that share
    found = [r[0] for r in unigrams.where("kind = 'hot'").select("data").mapInArrow(hottest, "u long").collect()]
    hot = np.unique(np.append(np.array(found, np.int64).view(np.uint64), START)).astype(np.uint64)
    model, stats = Model(uri, order, bits, hot, tokens, distinct), []
    todo, spent = rows.mapInArrow(count_grams(order, bits, hot), PIECES), []
    for n in range(order, 0, -1):
        if n == 1:
            todo = todo.union(unigrams.where("kind = 'count'").select("data").mapInArrow(cut_again(bits), PIECES))
        parts = materialize(todo.groupBy("shard").applyInArrow(merge_level(n, order, uri, bits, hot), PIECES), f"level{n}")
        discard(*spent)
        stats, model.shards[n] = level_stats(parts)
        model.discounts[n] = discounts(*stats[:4])
        todo, spent = parts.where("kind <> 'stats'"), [parts]
    discard(*spent, unigrams)
    ones, twos, _, _, more, total = stats
    low = model.discounts[1]
    mass = float(low[1] * ones + low[2] * twos + low[3] * more) / total if total else 1.0
    return Model(uri, order, bits, hot, tokens, distinct, total, mass, model.discounts, model.shards)


class Scorer:
    """Looks up n-grams in a model's mapped files."""

    def __init__(self, model: Model):
        self.model, self.folder = model, Folder(model.uri)
        self.files: dict[tuple[int, int], tuple] = {}

    def lookup(self, n: int, keys: np.ndarray) -> np.ndarray:
        """Fields of n-grams by key; zeros for those that aren't there."""
        own, place = np.unique(keys, return_inverse=True)
        fields = width(n, self.model.order)
        out = np.zeros((fields, len(own)))
        for shard, s in by_shard(own, self.model.bits):
            if (n, shard) not in self.files:
                at = np.searchsorted(self.model.shards[n], shard)
                there = at < len(self.model.shards[n]) and self.model.shards[n][at] == shard
                self.files[n, shard] = self.folder.columns(f"level{n}-{shard}", fields) if there else (np.zeros(0, np.uint64), [])
            known, columns = self.files[n, shard]
            if len(known):
                at = np.minimum(np.searchsorted(known, own[s]), len(known) - 1)
                here = np.flatnonzero(known[at] == own[s])
                for k, column in enumerate(columns):
                    out[k, s.start + here] = column[at[here]]
        return out[:, place]

    def score(self, h: np.ndarray, row: np.ndarray, rows: int):
        """(n_tokens, n_known, base score, score) of each row."""
        m = self.model
        words, row = token_grams(h, row, rows, m.order)
        size = len(row)
        fields = self.lookup(1, np.concatenate([words[-1], words[-2]]))
        counts, n = fields[5, :size], fields[0, :size]
        base = np.log10((counts + DELTA) / (m.tokens + DELTA * (m.distinct + 1)))
        p = m.low_mass / (m.distinct + 1) + np.maximum(n - m.discounts[1][np.minimum(n, 3).astype(int)], 0) / max(m.total, 1)
        context = fields[1:5, size:]
        for k in range(2, m.order + 1):
            grams = placed(words[-k:], m.hot, m.bits)
            if k < m.order:
                fields = self.lookup(k, np.concatenate([grams, placed(words[-k - 1 : -1], m.hot, m.bits)]))
            else:
                fields = self.lookup(k, grams)
            c, d = fields[0, :size], m.discounts[k]
            total = np.maximum(context[0], 1)
            mass = np.where(context[0] > 0, (d[1:, None] * context[1:]).sum(axis=0) / total, 1.0)
            p = np.maximum(c - d[np.minimum(c, 3).astype(int)], 0) / total + mass * p
            context = fields[1:5, size:]
        sums = lambda x: np.bincount(row, x, rows)
        return np.bincount(row, minlength=rows), sums(counts > 0).astype(np.int64), sums(base), sums(np.log10(p))


def score(docs: DataFrame, model: Model, columns: list[Column | str], text: str = "text") -> DataFrame:
    """``columns`` of each row with n_tokens, n_known, train_tokens, base_score, score and perplexity."""
    sent = shared(docs.sparkSession, model)
    kept = docs.select(*columns)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields), "n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"])
    names = [*kept.columns, "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]

    def run(batches):
        scorer = Scorer(opened(sent))
        for b in batches:
            texts, out = b.column(b.num_columns - 1), [np.zeros(b.num_rows, t) for t in (np.int64, np.int64, np.float64, np.float64)]
            for first, last, h, row in hashed_blocks(texts, ascii_lower_words()):
                for x, y in zip(out, scorer.score(h, row, last - first), strict=True):
                    x[first:last] = y
            release()
            known = np.full(b.num_rows, scorer.model.tokens, np.int64)
            with np.errstate(over="ignore"):
                perplexity = 10 ** (-out[3] / np.maximum(out[0], 1))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(b.num_columns - 1)), *(pa.array(x) for x in (out[0], out[1], known, out[2], out[3], perplexity))], names=names)

    return docs.select(*columns, F.coalesce(F.col(text), F.lit("")).alias("_text")).mapInArrow(run, schema)


def held_out_scores(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """Scores of all texts by a model of those whose id remainder modulo 10 isn't 0."""
    held = id_remainder(F.col("doc_id"), 10) == 0
    model = fit(docs.where(~held), order=order)
    return score(docs, model, [F.col("doc_id"), held.alias("held_out")])
