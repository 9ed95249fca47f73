"""Benchmark decontamination by greedy string tiling.

Words are runs of letters, marks and digits of any script, lower-cased and composed.  A
document and a benchmark item are joined on shared seeds of ``MIN_MATCH`` words; an item goes on if its words under
shared seeds could reach the threshold (no tile covers others).  Tiling then marks
the longest common unmarked runs again and again, found by running Karp-Rabin
hashes of falling length, and the item's share of marked words decides, so passages
that were cut up and reordered count as well.

The benchmark is read in blocks of about ``BLOCK_TEXT`` bytes of text.  One block is
broadcast; the blocks of a larger benchmark become files of the shared folder that workers
map into memory.  Either way the documents are read and hashed once.

Defined cases: null and empty texts and items match nothing; an item of fewer than
``MIN_MATCH`` words matches documents that hold all of it in one piece, and one of fewer
than ``PHRASE`` words, a name rather than a passage, only documents with exactly its
words; repeated documents or items each match, and ties between matches of one length go
to the earliest in the item; empty tables give no rows; texts are searched whole, in
blocks of rows of 1 MB or of one longer text, and pairs of matches in bounded pieces;
extra columns are kept and never read, whatever their names.
"""

from __future__ import annotations

import pickle
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from concord.llm.kneserney import Folder
from concord.llm.store import new_folder, opened, shared
from concord.llm.words import alphanumeric_words, blocks, hashed_blocks, pair_hash, release, string_parts

#: Words of a seed and of the shortest tile; share of an item's words from which a document is contaminated.
MIN_MATCH, THRESHOLD = 5, 0.5
#: Words from which a shorter item counts wherever it stands.
PHRASE = 3
BLOCK_TEXT = 8 << 20
#: Pairs of windows that are held at once.
PAIRS = 1 << 20
#: Window length with which tiling starts.
START_LENGTH = 20
KR_BASE = np.uint64(0x9E3779B97F4A7C15)
KR_INVERSE = np.uint64(pow(int(KR_BASE), -1, 1 << 64))


def word_grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n successive entries of ``h``."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    g = h[: len(h) - n + 1]
    for k in range(1, n):
        g = pair_hash(g, h[k : len(h) - n + 1 + k])
    return g


def word_blocks(texts: pa.Array):
    """``hashed_blocks`` of texts whose letters of any script are lower-cased and composed, and whose marks of any script separate words."""
    offsets, _ = string_parts(texts)
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    for first, last in blocks(offsets):
        own = pc.fill_null(texts.slice(first, last - first), "")
        if not pc.all(pc.string_is_ascii(own)).as_py():
            own = pc.utf8_lower(pc.utf8_normalize(own, "NFC"))
            own = pc.replace_substring_regex(own, r"[^\p{L}\p{M}\p{N}]+", " ")
        for a, b, h, row in hashed_blocks(own, alphanumeric_words(), offsets[last] - offsets[first] << 2):
            yield first + a, first + b, h, row


class RunningHashes:
    """Karp-Rabin hashes of any window of a sequence, from running sums."""

    def __init__(self, x: np.ndarray):
        with np.errstate(over="ignore"):
            powers = np.cumprod(np.append(np.uint64(1), np.full(len(x), KR_BASE)))
            self.inverse = np.cumprod(np.append(np.uint64(1), np.full(len(x), KR_INVERSE)))
            self.sums = np.append(np.uint64(0), np.cumsum(x * powers[:-1]))

    def windows(self, at: np.ndarray, length) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[at + length] - self.sums[at]) * self.inverse[at]


def free_lengths(marked: np.ndarray) -> np.ndarray:
    """Entries from each place on up to the next marked one or the end."""
    n = len(marked)
    stops = np.where(marked, np.arange(n), n)
    return np.minimum.accumulate(stops[::-1])[::-1] - np.arange(n)


def common_lengths(ka: RunningHashes, kb: RunningHashes, i, j, most) -> np.ndarray:
    """Length of the common run from i and j on, up to ``most``: by halving steps."""
    size = np.zeros(len(i), np.int64)
    step = 1 << max(int(most.max()).bit_length() - 1, 0) if len(i) else 0
    while step:
        on = np.flatnonzero(size + step <= most)
        same = ka.windows(i[on], size[on] + step) == kb.windows(j[on], size[on] + step)
        size[on[same]] += step
        step >>= 1
    return size


def before_each(x: np.ndarray, marked: np.ndarray, at: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """Number of the entry before each place among ``symbols``; -1 where there is none, or it is marked or no symbol."""
    last = np.maximum(at - 1, 0)
    place = np.minimum(np.searchsorted(symbols, x[last]), len(symbols) - 1)
    return np.where((at > 0) & ~marked[last] & (symbols[place] == x[last]), place, -1)


def matches(a, b, marked_a, marked_b, length, hashes):
    """(number of pairs, function that gives them in pieces): arrays (start in a, start in b, size) of left-maximal unmarked common runs of ``length`` at least.

    Only pairs of windows after different entries are formed, so a text that repeats
    itself gives about as many as it has words.  Pieces hold about ``PAIRS`` pairs.
    """
    free_a, free_b = free_lengths(marked_a), free_lengths(marked_b)
    wa, wb = np.flatnonzero(free_a >= length), np.flatnonzero(free_b >= length)
    ka, kb = hashes
    kinds, hb = np.unique(ka.windows(wa, length)), kb.windows(wb, length)
    if len(kinds):
        class_b = np.minimum(np.searchsorted(kinds, hb), len(kinds) - 1)
        wb, class_b = wb[kinds[class_b] == hb], class_b[kinds[class_b] == hb]
    if not len(kinds) or not len(wb):
        return 0, lambda: iter(())
    symbols = np.unique(a)
    many = len(symbols) + 1
    code = np.searchsorted(kinds, ka.windows(wa, length)) * many + before_each(a, marked_a, wa, symbols) + 1
    order = np.argsort(code, kind="stable")
    wa, code = wa[order], code[order]
    before_b = before_each(b, marked_b, wb, symbols)
    left, right = np.searchsorted(code, class_b * many), np.searchsorted(code, (class_b + 1) * many)
    # windows after the same entry go on to the left: they are left out
    cut = np.where(before_b >= 0, np.searchsorted(code, class_b * many + before_b + 1), right)
    after = np.where(before_b >= 0, np.searchsorted(code, class_b * many + before_b + 2), right)
    counts = cut - left + right - after
    ends = np.cumsum(counts)

    def pieces():
        from_ = 0
        while from_ < len(wb):
            to = max(from_ + 1, int(np.searchsorted(ends, (ends[from_ - 1] if from_ else 0) + PAIRS, "right")))
            n = counts[from_:to]
            which = np.repeat(np.arange(from_, to), n)
            k = left[which] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            k += np.where(k >= cut[which], after[which] - cut[which], 0)
            i, j = wa[k], wb[which]
            size = common_lengths(ka, kb, i, j, np.minimum(free_a[i], free_b[j]))
            on = size >= length
            yield i[on], j[on], size[on]
            from_ = to

    return int(ends[-1]), pieces


def tile(a: np.ndarray, b: np.ndarray, stops: np.ndarray, min_match: int = MIN_MATCH) -> tuple[np.ndarray, int]:
    """Marks of ``a`` after greedy string tiling with ``b`` (``stops``: entries of b that never match), and the number of tiles.

    Of up to ``PAIRS`` pairs of windows all matches are marked, the longest first.  Of
    more, only the longest are, found in one sweep and marked in a second.
    """
    marked_a, marked_b, tiles = np.zeros(len(a), bool), stops.copy(), 0
    length, hashes = max(min_match, min(START_LENGTH, len(a))), (RunningHashes(a), RunningHashes(b))

    def mark(i, j, size):
        # the words themselves are compared, so equal hashes of unequal windows fall out
        if marked_a[i : i + size].any() or marked_b[j : j + size].any() or (a[i : i + size] != b[j : j + size]).any():
            return False
        marked_a[i : i + size] = marked_b[j : j + size] = True
        return True

    while True:
        number, pieces = matches(a, b, marked_a, marked_b, length, hashes)
        fresh = 0
        if number <= PAIRS:
            found = list(pieces())
            i, j, size = (np.concatenate([x[k] for x in found] or [np.zeros(0, np.int64)]) for k in range(3))
            if len(size) and size.max() > 2 * length:
                length = int(size.max())
                continue
            for k in np.lexsort((j, i, -size)).tolist():
                fresh += mark(int(i[k]), int(j[k]), int(size[k]))
        else:
            longest = max((int(size.max()) for *_, size in pieces() if len(size)), default=0)
            if longest > 2 * length:
                length = longest
                continue
            for i, j, size in pieces() if longest else ():
                i, j = i[size == longest], j[size == longest]
                starts = np.flatnonzero(np.append(True, j[1:] != j[:-1])) if len(j) else []
                for k, end in zip(starts, np.append(starts[1:], len(j)), strict=True) if len(j) else ():
                    taken = np.append(0, np.cumsum(marked_a))
                    own = i[k:end]
                    for x in own[taken[own + longest] == taken[own]][:1].tolist():
                        fresh += mark(x, int(j[k]), longest)
        tiles += fresh
        if fresh:
            continue  # runs that were cut short may still be of this length
        if length == min_match or marked_a.all():
            return marked_a, tiles
        length = max(min_match, length // 2)


class HashedTexts:
    """Words of some texts, their grams of some lengths, and which of these pass a sieve."""

    def __init__(self, h: np.ndarray, row: np.ndarray, rows: int, lengths: list[int], sieve: np.ndarray):
        self.h, self.row, self.cuts = h, row, np.searchsorted(row, np.arange(rows + 1))
        self.grams, self.hits = {}, {}
        shift = np.uint64(64 - (len(sieve).bit_length() - 1))
        for n in lengths:
            self.grams[n] = word_grams(h, n)
            at = np.flatnonzero(sieve[self.grams[n] >> shift])
            self.hits[n] = at[row[at] == row[at + n - 1]]

    def among(self, n: int, sorted_hashes: np.ndarray) -> np.ndarray:
        """Places whose gram of length ``n`` is listed."""
        at = self.hits[n]
        if not len(sorted_hashes) or not len(at):
            return at[:0]
        own = self.grams[n][at]
        return at[sorted_hashes[np.minimum(np.searchsorted(sorted_hashes, own), len(sorted_hashes) - 1)] == own]


class BenchmarkBlock:
    """Words and sorted seeds of some benchmark items, in arrays that can be written and mapped.

    ``shorter`` holds, by length, the sorted hashes of items without a seed, and which items those are.
    """

    def __init__(self, ids: list, texts: list, min_match: int = MIN_MATCH, threshold: float = THRESHOLD):
        self.ids, self.min_match, self.threshold = ids, min_match, threshold
        words: list[np.ndarray] = []
        for first, last, h, row in word_blocks(pa.array(texts, pa.string())):
            cuts = np.searchsorted(row, np.arange(last - first + 1))
            words += [h[cuts[i] : cuts[i + 1]] for i in range(last - first)]
        self.flat = np.concatenate(words or [np.zeros(0, np.uint64)])
        self.starts = np.cumsum([0] + [len(w) for w in words]).astype(np.uint64)
        grams = [word_grams(w, min_match) for w in words]
        item = np.repeat(np.arange(len(words), dtype=np.uint64), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g), dtype=np.uint64) for g in grams] or [np.zeros(0, np.uint64)])
        seeds = np.concatenate(grams or [np.zeros(0, np.uint64)])
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.at = seeds[order], (item << np.uint64(32) | place)[order]
        self.shorter = {}
        for n in range(1, min_match):
            found = sorted((int(word_grams(w, n)[0]), i) for i, w in enumerate(words) if len(w) == n)
            self.shorter[n] = tuple(np.array([x[k] for x in found], np.uint64) for k in (0, 1))
        self.sieve = np.zeros(1 << 20, bool)
        self.mark(self.sieve)

    def mark(self, sieve: np.ndarray) -> None:
        """Set the sieve where this block's hashes fall."""
        shift = np.uint64(64 - (len(sieve).bit_length() - 1))
        for hashes in (self.seeds, *(h for h, _ in self.shorter.values())):
            sieve[hashes >> shift] = True

    def packed(self) -> np.ndarray:
        """All arrays in one, after their lengths."""
        ids = pickle.dumps(self.ids)
        parts = [self.seeds, self.at, self.flat, self.starts, *(x for pair in self.shorter.values() for x in pair), np.frombuffer(ids + bytes(-len(ids) % 8), np.uint64)]
        return np.concatenate([np.array([len(x) for x in parts], np.uint64), *parts])

    @classmethod
    def unpacked(cls, data: np.ndarray, min_match: int, threshold: float) -> BenchmarkBlock:
        """The block of ``packed`` data, which stays where it is."""
        self, n = cls.__new__(cls), 5 + 2 * (min_match - 1)
        ends = n + np.cumsum(data[:n].astype(np.int64))
        parts = [data[end - int(size) : end] for end, size in zip(ends, data[:n], strict=True)]
        self.seeds, self.at, self.flat, self.starts = parts[:4]
        self.shorter = {k: (parts[2 + 2 * k], parts[3 + 2 * k]) for k in range(1, min_match)}
        self.ids, self.min_match, self.threshold = pickle.loads(parts[-1].tobytes()), min_match, threshold
        return self

    def lengths(self) -> list[int]:
        """Lengths of grams that are looked up."""
        return [n for n, (_, items) in self.shorter.items() if len(items)] + [self.min_match]

    def words(self, i: int) -> np.ndarray:
        return self.flat[int(self.starts[i]) : int(self.starts[i + 1])]

    def of_document(self, h: np.ndarray, grams: np.ndarray, hits: np.ndarray):
        """(item index, words marked, tiles) of the items that a document covers; hits: its gram positions that are seeds."""
        distinct = np.unique(grams[hits])
        left, right = np.searchsorted(self.seeds, distinct, "left"), np.searchsorted(self.seeds, distinct, "right")
        counts = right - left
        at = np.repeat(left, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        both, gram = self.at[at], np.repeat(distinct, counts)
        item, place = ((x.astype(np.int64)) for x in (both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)))
        order = np.lexsort((place, item))
        item, place, gram = item[order], place[order], gram[order]
        gap = np.full(len(item), self.min_match)
        same = item[1:] == item[:-1]
        gap[:-1][same] = np.minimum(np.diff(place)[same], self.min_match)
        own, which = np.unique(item, return_inverse=True)
        sizes = (self.starts[own + 1] - self.starts[own]).astype(np.int64)
        reach = np.bincount(which, gap, len(own))
        for i, size in zip(own[reach >= self.threshold * sizes], sizes[reach >= self.threshold * sizes], strict=True):
            seeded = hits[np.isin(grams[hits], gram[item == i])]
            covered = np.zeros(len(h) + 1, bool)
            for k in range(self.min_match):
                covered[seeded + k] = True
            keep = covered.copy()
            keep[1:] |= covered[:-1]  # one stop after each covered run
            b, stops = np.append(h, np.uint64(0))[keep], ~covered[keep]
            marked, tiles = tile(self.words(i), b, stops, self.min_match)
            if marked.sum() >= self.threshold * size:
                yield int(i), int(marked.sum()), tiles

    def search_hashed(self, x: HashedTexts):
        """(row, item index, words marked, tiles) of contaminated texts."""
        for n, (hashes, items) in self.shorter.items():
            if not len(items):
                continue
            at, found = x.among(n, hashes), set()
            for k in at.tolist():
                r = int(x.row[k])
                if n < PHRASE and x.cuts[r + 1] - x.cuts[r] != n:
                    continue
                lo, hi = np.searchsorted(hashes, x.grams[n][k], "left"), np.searchsorted(hashes, x.grams[n][k], "right")
                found |= {(r, int(i)) for i in items[lo:hi] if (x.h[k : k + n] == self.words(int(i))).all()}
            yield from ((r, i, n, 1) for r, i in sorted(found))
        grams, hits = x.grams[self.min_match], x.among(self.min_match, self.seeds)
        for r in np.unique(x.row[hits]):
            lo, hi = x.cuts[r], x.cuts[r + 1]
            own = hits[np.searchsorted(hits, lo) : np.searchsorted(hits, hi)] - lo
            for i, marked, tiles in self.of_document(x.h[lo:hi], grams[lo : max(lo, hi - self.min_match + 1)], own):
                yield int(r), i, marked, tiles

    def search(self, texts: pa.Array):
        """(row, item index, words marked, tiles) of all contaminated texts."""
        for first, last, h, row in word_blocks(texts):
            for r, *found in self.search_hashed(HashedTexts(h, row, last - first, self.lengths(), self.sieve)):
                yield first + r, *found

    def found(self, texts: pa.Array):
        """(row, item id, item words, words marked, tiles) of all contaminated texts."""
        for r, i, marked, tiles in self.search(texts):
            yield r, self.ids[i], int(self.starts[i + 1] - self.starts[i]), marked, tiles


class Library:
    """Blocks of a large benchmark as files of the shared folder, which workers map into memory.

    Texts are hashed once, whatever the number of blocks; a sieve of up to 2^27
    entries for all of them decides which grams are looked up.
    """

    def __init__(self, uri: str, blocks, min_match: int = MIN_MATCH, threshold: float = THRESHOLD):
        self.folder, self.min_match, self.threshold, self.number, self.held = Folder(uri), min_match, threshold, 0, {}
        entries = 0
        for block in blocks:
            self.folder.write(f"block-{self.number}", block.packed())
            self.number += 1
            entries += len(block.flat)
        sieve = np.zeros(1 << min(27, max(20, (8 * entries).bit_length())), bool)
        lengths: set[int] = set()
        for k in range(self.number):
            block = self.block(k)
            block.mark(sieve)
            lengths |= set(block.lengths())
        self.lengths = sorted(lengths)
        self.folder.write("sieve", sieve.view(np.uint64))
        self.held = {}

    def block(self, k: int) -> BenchmarkBlock:
        return BenchmarkBlock.unpacked(self.folder.columns(f"block-{k}", 0)[0], self.min_match, self.threshold)

    def found(self, texts: pa.Array):
        """As BenchmarkBlock.found, in all blocks."""
        if not self.held:
            self.held = {k: self.block(k) for k in range(self.number)} | {"sieve": self.folder.columns("sieve", 0)[0].view(bool)}
        for first, last, h, row in word_blocks(texts):
            x = HashedTexts(h, row, last - first, self.lengths, self.held["sieve"])
            for k in range(self.number):
                block = self.held[k]
                for r, i, marked, tiles in block.search_hashed(x):
                    yield first + r, block.ids[i], int(block.starts[i + 1] - block.starts[i]), marked, tiles


def benchmark_blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", block_text: int = BLOCK_TEXT, **settings):
    """The benchmark as BenchmarkBlocks of bounded size; it streams through the driver."""
    ids, texts, size = [], [], 0
    for r in benchmark.select(item_id, text).toLocalIterator():
        ids.append(r[0])
        texts.append(r[1] or "")
        size += len(texts[-1])
        if size >= block_text:
            yield BenchmarkBlock(ids, texts, **settings)
            ids, texts, size = [], [], 0
    if ids:
        yield BenchmarkBlock(ids, texts, **settings)


def searchable(benchmark: DataFrame, **settings):
    """Broadcast of a benchmark of one block at most, or of the Library of a larger one."""
    spark, blocks = benchmark.sparkSession, benchmark_blocks(benchmark, **settings)
    few = list(islice(blocks, 2))
    if len(few) < 2:
        return shared(spark, few[0] if few else BenchmarkBlock([], [], **{k: v for k, v in settings.items() if k in ("min_match", "threshold")}))
    rules = {k: v for k, v in settings.items() if k in ("min_match", "threshold")}
    return shared(spark, Library(new_folder(spark, "benchmark"), chain(few, blocks), **rules))


def contaminations(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """(doc_id, item_id, item_words, matched_words, tiles, coverage) for each contaminated document and item."""
    fields = {f.name: f.dataType for f in docs.schema.fields}
    item_kind = benchmark.schema["item_id"].dataType
    schema = f"doc_id {fields['doc_id'].simpleString()}, item_id {item_kind.simpleString()}, item_words int, matched_words int, tiles int, coverage double"
    item_arrow, sent = to_arrow_type(item_kind), searchable(benchmark, **settings)

    def search(batches):
        items = opened(sent)
        for batch in batches:
            found = list(items.found(batch.column(1)))
            at, item, sizes, marked, tiles = ([x[k] for x in found] for k in range(5))
            yield pa.RecordBatch.from_arrays(
                [pc.take(batch.column(0), pa.array(at, pa.int64())), pa.array(item, item_arrow), pa.array(sizes, pa.int32()), pa.array(marked, pa.int32()), pa.array(tiles, pa.int32()), pa.array(np.array(marked, float) / np.maximum(sizes, 1))],
                names=["doc_id", "item_id", "item_words", "matched_words", "tiles", "coverage"],
            )

    return docs.select("doc_id", "text").mapInArrow(search, schema)


def contaminated(text: Column, sent) -> Column:
    """Column: whether the text covers an item of what ``searchable`` sent."""

    held = []

    @F.arrow_udf("boolean")
    def covers_item(texts: pa.Array) -> pa.Array:
        if not held:  # once for each worker
            held.append(opened(sent))
        hit = np.zeros(len(texts), bool)
        for row, *_ in held[0].found(texts):
            hit[row] = True
        release()
        return pa.array(hit)

    return covers_item(text)


def keep_clean(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that cover no benchmark item."""
    return docs.where(~contaminated(F.col("text"), searchable(benchmark, **settings)))
