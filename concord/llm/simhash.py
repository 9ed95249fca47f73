"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints are summed up per document; only distinct ones are indexed.  Two
fingerprints that differ in three bits at most agree on one of four blocks of 16
bits, so each is filed under its four block values.  Within such a bucket they
are sorted by Gray rank, and nodes of eight neighbours, then of eight nodes and so
on, hold the bits on which all below agree (a mask and a pattern).  A search joins
the tree with itself from the top: the differing bits of two nodes' shared masks
are a lower bound for all below them, so whole groups go when it passes three.
A bucket with more than ``HOT`` entries is filed again by four blocks of its
remaining bits, three times at most; the search stays exact.

``keep_dissimilar`` goes on where texts differ more, whatever their fingerprints: it links all
texts that share 0.8 of their shingles of five words.  Bands of least hashes join most of them into
classes, each candidate pair compared exactly.  A prefix filter then names every further pair that
may be alike and isn't in one class: with the rarest shingles first, two such texts share one of the
first fifth.  Lengths, places and bits of odd parity drop what can't be alike, and the rest is
compared exactly, so no link is missed.

Each bucket yields edges to one representative per locally connected class, never
all pairs; classes meet in alternating large-star and small-star rounds.

Defined cases: a null or blank text has fingerprint zero and links like any other;
null doc_ids take part (a class of nulls only has component_id null); repeated
rows each get a row of the result; an empty table gives an empty result; of extra
columns ``near_duplicates`` takes none and the ``keep_`` functions return all, whatever
their names; texts are read whole, in blocks of rows of 1 MB or of one longer text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.llm.store import discard, materialize, opened, shared
from concord.llm.words import ascii_lower_words, blocks, hashed_blocks, pair_hash, release, splitmix, string_parts, word_bounds

#: Most bits in which linked fingerprints differ, and blocks that so many edits can't all reach.
DISTANCE, BLOCKS = 3, 4
FAN_OUT_BITS = 3
HOT = 20_000
#: Rows that are searched at once, if whole buckets, and node pairs that are expanded at once.
SEARCH_ROWS, SEARCH_PAIRS = 200_000, 20_000
BROADCAST_ROWS = 100_000
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def rotate(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def xxh64(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of each byte run of ``data``, vectorised over runs."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    raw = padded.tobytes()
    eight = np.ndarray((len(data) + 1,), "<u8", raw, 0, (1,))
    four = np.ndarray((len(data) + 1,), "<u4", raw, 0, (1,))
    with np.errstate(over="ignore"):
        seed64 = np.uint64(seed)
        h = np.full(len(starts), seed64 + P5)
        at, left = starts.copy(), lengths.copy()
        if len(wide := np.flatnonzero(lengths >= 32)):
            pos, stripes = starts[wide].copy(), lengths[wide] >> 5
            acc = [np.full(len(wide), x) for x in (seed64 + P1 + P2, seed64 + P2, seed64, seed64 - P1)]
            for k in range(int(stripes.max())):
                on = np.flatnonzero(stripes > k)
                for lane in range(4):
                    acc[lane][on] = rotate(acc[lane][on] + eight[pos[on] + 8 * lane] * P2, 31) * P1
                pos[on] += 32
            merged = rotate(acc[0], 1) + rotate(acc[1], 7) + rotate(acc[2], 12) + rotate(acc[3], 18)
            for lane in range(4):
                merged = (merged ^ (rotate(acc[lane] * P2, 31) * P1)) * P1 + P4
            h[wide] = merged
            at[wide], left[wide] = pos, lengths[wide] & 31
        h += lengths.astype(np.uint64)
        for k in range(3):
            on = np.flatnonzero(left >= 8 * (k + 1))
            if len(on):
                h[on] = rotate(h[on] ^ (rotate(eight[at[on]] * P2, 31) * P1), 27) * P1 + P4
                at[on] += 8
        left &= 7
        on = np.flatnonzero(left >= 4)
        h[on] = rotate(h[on] ^ (four[at[on]].astype(np.uint64) * P1), 23) * P2 + P3
        at[on] += 4
        left &= 3
        for k in range(3):
            on = np.flatnonzero(left > k)
            h[on] = rotate(h[on] ^ (padded[at[on] + k].astype(np.uint64) * P5), 11) * P1
        h = (h ^ (h >> np.uint64(33))) * P2
        h = (h ^ (h >> np.uint64(29))) * P3
    return h ^ (h >> np.uint64(32))


def majority_bits(h: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Per row, the 64-bit word whose bits are set in over half of the row's hashes (rows ascending)."""
    out = np.zeros(rows, np.uint64)
    if not len(h):
        return out
    lanes = np.zeros(256, np.uint64)  # one byte-wide counter for each bit of a byte
    for bit in range(8):
        lanes |= ((np.arange(256, dtype=np.uint64) >> np.uint64(bit)) & np.uint64(1)) << np.uint64(8 * bit)
    counts = np.bincount(row, minlength=rows)
    first = np.repeat(np.cumsum(counts) - counts, counts)
    cuts = np.flatnonzero((np.arange(len(h)) - first) % 255 == 0)  # a counter holds 255 at most
    each = h.view(np.uint8).reshape(-1, 8)
    for byte in range(8):
        sums = np.add.reduceat(lanes[each[:, byte]], cuts).view(np.uint8).reshape(-1, 8)
        total = np.zeros((rows, 8), np.int64)
        np.add.at(total, row[cuts], sums)
        bits = (2 * total > counts[:, None]).astype(np.uint64)
        out |= (bits << np.arange(8, dtype=np.uint64)).sum(axis=1, dtype=np.uint64) << np.uint64(8 * byte)
    return out


def fingerprint_array(texts: pa.Array, shingle: int = 3) -> pa.Array:
    """Signed 64-bit SimHash of each text over word shingles."""
    table = ascii_lower_words()
    offsets, data = string_parts(texts)
    out = np.zeros(len(offsets) - 1, np.uint64)
    for first, last in blocks(offsets):
        lo, hi = offsets[first], offsets[last]
        b, edges = table[data[lo:hi]], offsets[first : last + 1] - lo
        starts, ends, row = word_bounds(edges, b)
        if not len(starts):
            continue
        keep = b != 0
        keep[1:] |= keep[:-1]  # the blank after a word stays, as one space
        moved = np.concatenate([[0], np.cumsum(keep)])
        joined = b[keep]
        joined[joined == 0] = 32
        # a row's last word may touch the next row's first: shingles never reach over rows, so that's harmless
        starts, ends = moved[starts], moved[ends - 1] + 1
        words = np.bincount(row, minlength=last - first)
        place = np.arange(len(row)) - np.repeat(np.cumsum(words) - words, words)
        begin = np.flatnonzero((place + shingle <= words[row]) | (place == 0))
        stop = begin + np.minimum(shingle, words[row[begin]]) - 1
        h = xxh64(joined, starts[begin], ends[stop] - starts[begin])
        out[first:last] = majority_bits(h, row[begin], last - first)
    release()
    return pa.array(out.view(np.int64))


def fingerprint(text: Column, shingle: int = 3) -> Column:
    """Column of SimHash fingerprints (long)."""

    @F.arrow_udf("long")
    def simhash(texts: pa.Array) -> pa.Array:
        return fingerprint_array(texts, shingle)

    return simhash(text)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of a code word in the reflected Gray sequence."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """Levels of nodes over fingerprints sorted by (bucket, Gray rank); see the module's text."""

    def __init__(self, bucket: np.ndarray, codes: np.ndarray):
        self.mask, self.pattern, self.child = [np.full(len(codes), ~np.uint64(0))], [codes], []
        group = np.cumsum(np.concatenate([[0], bucket[1:] != bucket[:-1]])) if len(codes) else np.zeros(0, np.int64)
        while len(group) and (group[1:] == group[:-1]).any():
            sizes = np.bincount(group)
            place = np.arange(len(group)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            first = np.flatnonzero(place & ((1 << FAN_OUT_BITS) - 1) == 0)
            mask, pattern = self.mask[-1], self.pattern[-1]
            ones = np.bitwise_and.reduceat(pattern & mask, first)  # set in all below
            zeros = np.bitwise_and.reduceat(~pattern & mask, first)  # clear in all below
            self.mask.append(ones | zeros)
            self.pattern.append(ones)
            self.child.append(np.append(first, len(group)))
            group = group[first]
        self.tops = np.arange(len(group))

    def near_pairs(self, distance: int = DISTANCE):
        """Arrays (i, j), i < j, of entries of one bucket that differ in ``distance`` bits at most."""
        step = np.arange(1 << FAN_OUT_BITS)
        stack = [(len(self.child), self.tops, self.tops)]
        while stack:
            level, a, b = stack.pop()
            if len(a) > SEARCH_PAIRS:
                stack += [(level, a[k : k + SEARCH_PAIRS], b[k : k + SEARCH_PAIRS]) for k in range(0, len(a), SEARCH_PAIRS)]
                continue
            if level == 0:
                yield a, b
                continue
            child = self.child[level - 1]
            x, y = child[a][:, None, None] + step[:, None], child[b][:, None, None] + step
            x, y = np.broadcast_arrays(x, y)
            fits = (x < child[a + 1][:, None, None]) & (y < child[b + 1][:, None, None])
            fits &= (x < y) if level == 1 else (x <= y)
            x, y = x[fits], y[fits]
            mask, pattern = self.mask[level - 1], self.pattern[level - 1]
            near = np.bitwise_count((pattern[x] ^ pattern[y]) & mask[x] & mask[y]) <= distance
            if near.any():
                stack.append((level - 1, x[near], y[near]))


def roots_of(n: int, pairs) -> np.ndarray:
    """Smallest index of each one's class, by pointer jumping."""
    parent = np.arange(n)

    def find(i):
        r = parent[i]
        while (parent[r] != r).any():
            r = parent[r]
        return r

    for i, j in pairs:
        while True:
            a, b = find(i), find(j)
            if not (apart := a != b).any():
                break
            np.minimum.at(parent, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
    return find(np.arange(n))


def bucket_edges(batches, distance: int = DISTANCE):
    """Edges from each fingerprint to its class's representative, from batches of (key, fp) with equal keys adjacent."""

    def search(key, fp):
        order = np.lexsort((gray_rank(fp), key))
        key, fp = key[order], fp[order]
        same = np.zeros(len(key), bool)
        same[1:] = key[1:] == key[:-1]
        same[:-1] |= same[1:]
        key, fp = key[same], fp[same]
        root = roots_of(len(fp), GrayIndex(key, fp).near_pairs(distance))
        bound = np.flatnonzero(root != np.arange(len(fp)))
        return pa.RecordBatch.from_arrays([pa.array(fp[bound].view(np.int64)), pa.array(fp[root[bound]].view(np.int64))], names=["a", "b"])

    keys, codes, rows = [], [], 0
    for batch in batches:
        keys.append(batch.column(0).to_numpy())
        codes.append(batch.column(1).to_numpy().view(np.uint64))
        rows += len(keys[-1])
        if rows >= SEARCH_ROWS:
            key, fp = np.concatenate(keys), np.concatenate(codes)
            done = int(np.flatnonzero(np.append(True, key[1:] != key[:-1]))[-1])  # the last bucket may go on
            if done:
                yield search(key[:done], fp[:done])
            keys, codes, rows = [key[done:]], [fp[done:]], len(key) - done
    if rows:
        yield search(np.concatenate(keys), np.concatenate(codes))
    release()


def filed(rows: DataFrame, width: int, blocks: int = BLOCKS) -> DataFrame:
    """Each row under the values of the blocks of its ``width`` remaining bits: (key, fp, rest)."""
    base, more = divmod(width, blocks)
    sizes = [base + (i < more) for i in range(blocks)]
    options, low = [], 0
    for i, size in enumerate(sizes):
        value = F.shiftrightunsigned("rest", low).bitwiseAND(F.lit((1 << size) - 1))
        under = F.col("rest").bitwiseAND(F.lit((1 << low) - 1))
        high = low + size
        above = F.lit(0).cast("long") if high >= 64 else F.shiftleft(F.shiftrightunsigned("rest", high), low)
        options.append(F.struct(F.shiftleft(F.col("key") * blocks + i, size).bitwiseOR(value).alias("key"), above.bitwiseOR(under).alias("rest")))
        low = high
    return rows.select("fp", F.explode(F.array(*options)).alias("o")).select("o.key", "fp", "o.rest")


def links(fps: DataFrame, hot: int = HOT, distance: int = DISTANCE) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints of column ``fp`` within the distance."""
    rows, edges = fps.select("fp", F.col("fp").alias("rest"), F.lit(0).cast("long").alias("key")), []
    width, levels = 64, 0
    while True:
        rows = filed(rows, width, distance + 1)
        width -= -(-width // (distance + 1))
        levels += 1
        crowded = materialize(rows.groupBy("key").count().where(F.col("count") > hot).select("key"), "crowded") if levels < 4 else None
        n = crowded.count() if crowded is not None else 0
        here, again = rows, None
        if n:
            side = F.broadcast(crowded) if n <= BROADCAST_ROWS else crowded
            here, again = rows.join(side, "key", "left_anti"), rows.join(side, "key", "left_semi")
        edges.append(here.select("key", "fp").repartition("key").sortWithinPartitions("key").mapInArrow(lambda b: bucket_edges(b, distance), "a long, b long"))
        if again is None:
            break
        rows = again
    out = edges[0]
    for more in edges[1:]:
        out = out.union(more)
    return out.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): smallest node reachable, for the nodes of ``edges`` (a, b) that aren't roots."""
    edges = materialize(edges.where("a <> b"), "edges")
    seen = None
    while True:
        both = edges.union(edges.select("b", "a")).distinct()
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))  # here u > v throughout
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        edges, old = materialize(small, "stars"), edges
        discard(old)
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """(doc_id, fp long, root long, component_id) of each row: its fingerprint, its class by fingerprint and the class's smallest doc_id."""
    own = materialize(docs.select(F.col(doc_id).alias("doc_id"), fingerprint(F.col(text)).alias("fp")), "fingerprints")
    fps = materialize(own.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "distinct")
    bound = components(links(fps, hot))
    members = bound.select(F.col("node").alias("fp"), "root").union(bound.select(F.col("root").alias("fp"), "root").distinct())
    least = members.join(fps, "fp").groupBy("root").agg(F.min("first").alias("component_id"))
    known = materialize(members.join(least, "root").select("fp", "root", "component_id"), "classes")
    every = fps.join(known, "fp", "left").select("fp", "n", F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNull(), F.col("first")).otherwise(F.col("component_id")).alias("component_id"))
    # a fingerprint with very many rows doesn't meet them in one task: there are few such, and they go to the rows
    crowded = materialize(every.where(F.col("n") > hot), "crowded")
    few = crowded.count()
    if not few:
        return own.join(every, "fp").select("doc_id", "fp", "root", "component_id")
    side = F.broadcast(crowded) if few <= BROADCAST_ROWS else crowded
    rest = own.join(side.select("fp"), "fp", "left_anti").join(every.where(F.col("n") <= hot), "fp")
    return own.join(side, "fp").unionByName(rest).select("doc_id", "fp", "root", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_one(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """Documents without near-duplicates: of each class the row with the smallest doc_id stays (of repeated ones, one row)."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    found = materialize(near_duplicates(docs, hot=hot), "classified")
    # nulls sort first in min(struct); an id counts before them
    chosen = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("fp"))).alias("c")).select("c.doc_id", F.col("c.fp").alias("_fp"))
    chosen = chosen.select(key.alias("_key"), "_fp")
    often = materialize(found.groupBy(key.alias("_key")).agg(F.count(F.lit(1)).alias("_n")), "ids")
    packed = docs.select(key.alias("_key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    if often.where("_n > 1").isEmpty():
        dropped = materialize(often.join(chosen, "_key", "left_anti").select("_key"), "dropped")
        if dropped.count() <= BROADCAST_ROWS:  # then no text is shuffled
            return packed.join(F.broadcast(dropped), "_key", "left_anti").select("row.*")
        return packed.join(chosen, "_key", "left_semi").select("row.*")
    joined = packed.join(chosen.join(often, "_key"), "_key")
    # documents whose id repeats need another look at their text
    own = fingerprint(F.col("row.text"))
    repeated = joined.where("_n > 1").withColumn("own", own).where("own = _fp").drop("own").dropDuplicates(["_key", "_fp"])
    return joined.where("_n = 1").unionByName(repeated).select("row.*")


# Near copies by their texts -----------------------------------------------------------------------

#: Words of a shingle and share of shingles from which texts are near copies.
COPY_SHINGLE, COPY_SIMILARITY = 5, 0.8
#: Bands of least hashes, and least hashes of each: near copies share one with a chance of 1 - (1 - 0.8**5)**25, over 0.9999.
BANDS, BAND_ROWS = 25, 5
#: Rows whose shingles are counted to put frequent ones last, and most of these; pairs looked at at once; bits by which pairs are told apart.
SAMPLE_ROWS, FREQUENT = 10_000, 100_000
PAIRS_AT_ONCE, PARITY_BITS = 1_000_000, 2048


def shingle_hashes(texts: pa.Array, shingle: int = COPY_SHINGLE):
    """For each block of rows: (first, last, shingle hashes, row of each from 0), repeats included; fewer words: the whole sequence."""
    for first, last, h, row in hashed_blocks(texts, ascii_lower_words()):
        words = np.bincount(row, minlength=last - first)
        place = np.arange(len(row)) - np.repeat(np.cumsum(words) - words, words)
        begin = np.flatnonzero((place + shingle <= words[row]) | (place == 0))
        size = np.minimum(shingle, words[row[begin]])
        g = h[begin]
        for k in range(1, shingle):
            on = np.flatnonzero(size > k)
            g[on] = pair_hash(g[on], h[begin[on] + k])
        yield first, last, g, row[begin]


def shingle_sets(text: Column, shingle: int = COPY_SHINGLE) -> Column:
    """Column of the distinct word shingles of a text, hashed, ascending."""

    @F.arrow_udf("array<long>")
    def sets(texts: pa.Array) -> pa.Array:
        out = []
        for first, last, g, row in shingle_hashes(texts, shingle):
            cuts = np.searchsorted(row, np.arange(last - first + 1))
            out += [np.unique(g[cuts[i] : cuts[i + 1]]).view(np.int64) for i in range(last - first)]
        release()
        return pa.array(out, pa.list_(pa.int64()))

    return sets(text)


def least_hashes(g: np.ndarray, row: np.ndarray, rows: int, n: int) -> np.ndarray:
    """The least of each of ``n`` hash functions over each row's shingles; rows without any get zeros."""
    out = np.zeros((n, rows), np.uint64)
    starts = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
    factors = splitmix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)
    with np.errstate(over="ignore"):
        for k in range(n if len(starts) else 0):
            out[k, row[starts]] = np.minimum.reduceat((g ^ factors[k]) * factors[n - 1 - k], starts)
    return out


def banded(batches):
    """(band, near, rid) for each band of each (rid, text): rows with similar texts share a band and mostly ``near``, too."""
    for batch in batches:
        rid = batch.column(0).to_numpy()
        for first, last, g, row in shingle_hashes(batch.column(1)):
            least = least_hashes(g, row, last - first, BANDS * BAND_ROWS)
            keys = []
            for k in range(BANDS):
                key = np.full(last - first, np.uint64(k))
                for m in least[k * BAND_ROWS : (k + 1) * BAND_ROWS]:
                    key = pair_hash(key, m)
                keys.append(key)
            columns = np.concatenate(keys), np.tile(least[0], BANDS), np.tile(rid[first:last], BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in columns], names=["band", "near", "rid"])
    release()


def neighbours(batches):
    """(a, b, first) from (band, rid) in order: each row with the row before it in its band and, ``first``, with the first one there."""
    band = head = before = None
    for batch in batches:
        bands, rids = (batch.column(k).to_numpy() for k in range(2))
        if not len(bands):
            continue
        new = np.append(bands[0] != band if band is not None else True, bands[1:] != bands[:-1])
        at = np.arange(len(bands))
        run = np.maximum.accumulate(np.where(new, at, -1))
        heads = np.where(run >= 0, rids[np.maximum(run, 0)], head if head is not None else 0)
        previous = np.append(before if before is not None else 0, rids[:-1])
        band, head, before = bands[-1], heads[-1], rids[-1]
        on = np.flatnonzero(~new & (previous != rids))
        far = np.flatnonzero(~new & (heads != rids) & (heads != previous))
        a, b = np.append(rids[on], rids[far]), np.append(previous[on], heads[far])
        yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b)), pa.array(np.arange(len(a)) >= len(on))], names=["a", "b", "first"])


def candidate_pairs(rows: DataFrame) -> DataFrame:
    """Pairs (a, b, first) of ``rows`` (rid, text) that share a band: a row's neighbours there, at most two for each band, never all pairs.

    Rows are dealt by ranges of band and order within it, so a band that many share
    is cut over tasks; a cut misses one link, which other bands have.
    """
    bands = materialize(rows.mapInArrow(banded, "band long, near long, rid long"), "bands")
    ordered = bands.repartitionByRange("band", "near", "rid").sortWithinPartitions("band", "near", "rid").select("band", "rid")
    pairs = materialize(ordered.mapInArrow(neighbours, "a long, b long, first boolean").groupBy("a", "b").agg(F.min("first").alias("first")), "pairs")
    discard(bands)
    return pairs


def similar_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose ``sets`` (rid, shingles) are at least ``COPY_SIMILARITY`` alike; two empty ones are."""
    n = F.size("shingles")
    a, b = (sets.select(F.col("rid").alias(x), F.col("shingles").alias(f"s{x}"), n.alias(f"n{x}")) for x in "ab")
    lengths = F.least("na", "nb") >= F.greatest("na", "nb") * COPY_SIMILARITY
    both = F.size(F.array_intersect("sa", "sb"))
    alike = both >= (F.col("na") + F.col("nb") - both) * COPY_SIMILARITY - 1e-9
    return pairs.join(a, "a").join(b, "b").where(lengths & alike).select("a", "b")


def sets_of(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """(rid, shingles) of those ``rows`` (rid, text) that are in ``pairs`` (a, b)."""
    ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("rid")).distinct(), "candidates")
    few = ids.count() <= BROADCAST_ROWS
    sets = rows.dropDuplicates(["rid"]) if not few else rows.join(F.broadcast(ids), "rid").dropDuplicates(["rid"])
    sets = sets if few else sets.join(ids, "rid")
    sets = materialize(sets.select("rid", shingle_sets(F.col("text")).alias("shingles")), "shingles")
    discard(ids)
    return sets


def banded_links(rows: DataFrame) -> DataFrame:
    """Links (a, b) among the ``rows`` (rid, text): most of those that classes need, from neighbours in bands.

    Neighbours in a band are compared first.  A row and a band's first one are
    compared only if they aren't in one class by then.
    """
    pairs = candidate_pairs(rows)
    sets = sets_of(rows, pairs)
    near = materialize(similar_pairs(pairs.where("NOT first").select("a", "b"), sets), "similar")
    bound = components(near)
    root = lambda x: bound.select(F.col("node").alias(x), F.col("root").alias(f"r{x}"))
    apart = pairs.where("first").join(root("a"), "a", "left").join(root("b"), "b", "left")
    apart = apart.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")
    more = materialize(similar_pairs(apart, sets), "similar")
    discard(pairs, sets)
    return near.union(more)


def frequent_shingles(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, of shingles that several of about ``SAMPLE_ROWS`` of the ``rows`` (rid, text) have, and the rank of each by its count.

    They only set the order of shingles: any order gives the same links, a better one fewer pairs to look at.
    """
    step = max(1, rows.count() // SAMPLE_ROWS)
    sample = rows.where(F.pmod("rid", F.lit(step)) == 0)
    counts = sample.select(F.explode(shingle_sets(F.col("text"))).alias("shingle")).groupBy("shingle").count().where("count > 1")
    found = counts.orderBy(F.desc("count"), "shingle").limit(FREQUENT).collect()
    hashes = np.array([r[0] for r in found], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], np.arange(len(found), 0, -1, dtype=np.uint64)[order]


def prefixes(batches, frequent):
    """(rid, n, keys, parity) of each (rid, text): its number of shingles, the rarest of them in order, and the odd bits of all.

    Texts that are alike share one of ``keys``.  Each shingle turns one bit of ``parity``,
    so two texts differ in as many shingles at least as in bits.
    """
    hashes, ranks = opened(frequent)
    for batch in batches:
        rid = batch.column(0).to_numpy()
        for first, last, g, row in shingle_hashes(batch.column(1)):
            order = np.lexsort((g, row))
            g, row = g[order], row[order]
            new = np.ones(len(g), bool)
            new[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
            g, row = g[new], row[new]
            n = np.bincount(row, minlength=last - first)
            bits = np.zeros((last - first) * PARITY_BITS, np.uint8)
            np.add.at(bits, row * PARITY_BITS + (splitmix(g) % np.uint64(PARITY_BITS)).astype(np.int64), np.uint8(1))
            place = np.arange(len(g)) - np.repeat(np.cumsum(n) - n, n)
            if len(hashes) and len(g):
                at = np.minimum(np.searchsorted(hashes, g), len(hashes) - 1)
                last_ones = np.where(hashes[at] == g, ranks[at], np.uint64(0))  # equal ranks stay in order of hash
                g = g[np.lexsort((last_ones, row))]
            count = n - np.ceil(n * COPY_SIMILARITY - 1e-9).astype(np.int64) + 1
            keys = g[place < count[row]]
            count[n == 0] = 0
            ends = np.cumsum(count)
            keys = np.insert(keys, ends[n == 0], np.uint64(0))  # texts without words share a key of their own
            ends += np.cumsum(n == 0)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(keys.view(np.int64)))
            parity = pa.array([x.tobytes() for x in np.packbits(bits.reshape(-1, PARITY_BITS) & 1, axis=1)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(rid[first:last]), pa.array(n), lists, parity], names=["rid", "n", "keys", "parity"])
    release()


def may_be_alike(key: np.ndarray, rid: np.ndarray, root: np.ndarray, n: np.ndarray, pos: np.ndarray):
    """Arrays (a, b) of ids whose rows share a key, are of different classes and, by their lengths and the key's places, may be alike."""
    order = np.lexsort((rid, n, key))
    key, rid, root, n, pos = key[order], rid[order], root[order], n[order], pos[order]
    bucket = np.cumsum(np.append(True, key[1:] != key[:-1])) - 1
    # whole buckets of one class, as most are, have nothing to compare
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    mixed = (np.minimum.reduceat(root, starts) != np.maximum.reduceat(root, starts))[bucket]
    bucket, rid, root, n, pos = bucket[mixed], rid[mixed], root[mixed], n[mixed], pos[mixed]
    if not len(rid):
        return
    wide = np.int64(1) << np.int64(32)
    longest = np.floor(n / COPY_SIMILARITY + 1e-9).astype(np.int64)
    stop = np.searchsorted(bucket * wide + n, bucket * wide + longest, "right")
    count = stop - np.arange(len(rid)) - 1
    count = np.where(n == 0, np.minimum(count, 1), count)  # a chain links all texts without words
    total, i = np.cumsum(count), 0
    while i < len(count):
        base = total[i] - count[i]
        k = max(i + 1, int(np.searchsorted(total, base + PAIRS_AT_ONCE, "right")))
        a = np.repeat(np.arange(i, k), count[i:k])
        b = a + 1 + np.arange(len(a)) - np.repeat(total[i:k] - count[i:k] - base, count[i:k])
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
        both = np.ceil((n[a] + n[b]) * (COPY_SIMILARITY / (1 + COPY_SIMILARITY)) - 1e-9)
        fits = np.minimum(n[a] - pos[a], n[b] - pos[b]) >= both
        a, b = rid[a[fits]], rid[b[fits]]
        if len(a):
            a, b = np.maximum(a, b), np.minimum(a, b)
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
            yield a[new], b[new]
        i = k


def sharing_pairs(batches):
    """(a, b) from (key, rid, root, n, pos) with equal keys adjacent, as ``may_be_alike`` has them."""
    kept, rows, most = [], 0, SEARCH_ROWS

    def pairs(columns):
        for a, b in may_be_alike(*columns):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        kept.append([c.to_numpy().astype(np.int64) for c in batch.columns])
        rows += len(kept[-1][0])
        if rows >= most:
            columns = [np.concatenate(x) for x in zip(*kept, strict=True)]
            done = int(np.flatnonzero(np.append(True, columns[0][1:] != columns[0][:-1]))[-1])  # the last bucket may go on
            if done:
                yield from pairs([c[:done] for c in columns])
            kept = [[c[done:] for c in columns]]
            rows -= done
            most = max(SEARCH_ROWS, 2 * rows)
    if rows:
        yield from pairs([np.concatenate(x) for x in zip(*kept, strict=True)])
    release()


def odd_bits(a: Column, b: Column) -> Column:
    """Column of the number of bits in which two ``parity`` columns differ."""

    @F.arrow_udf("int")
    def differ(x: pa.Array, y: pa.Array) -> pa.Array:
        words = [string_parts(v)[1].view(np.uint64).reshape(-1, PARITY_BITS // 64) for v in (x, y)]
        return pa.array(np.bitwise_count(words[0] ^ words[1]).sum(axis=1, dtype=np.int32))

    return differ(a, b)


def missed_links(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """All links (a, b) between ``rows`` (rid, text) that aren't in one of the ``classes`` (rid, root), by a prefix filter."""
    frequent = shared(rows.sparkSession, frequent_shingles(rows))
    index = materialize(rows.mapInArrow(lambda b: prefixes(b, frequent), "rid long, n long, keys array<long>, parity binary"), "prefixes")
    side = F.broadcast(classes) if classes.count() <= BROADCAST_ROWS else classes
    keys = index.select("rid", F.col("n").cast("int").alias("n"), F.posexplode("keys").alias("pos", "key")).join(side, "rid", "left")
    keys = keys.select("key", "rid", F.coalesce("root", "rid").alias("root"), "n", "pos")
    pairs = keys.repartition("key").sortWithinPartitions("key").mapInArrow(sharing_pairs, "a long, b long")
    pairs = materialize(pairs.distinct(), "pairs")
    own = index.dropDuplicates(["rid"])
    a, b = (own.select(F.col("rid").alias(x), F.col("n").alias(f"n{x}"), F.col("parity").alias(f"p{x}")) for x in "ab")
    most = (F.col("na") + F.col("nb")) * ((1 - COPY_SIMILARITY) / (1 + COPY_SIMILARITY)) + 1e-9
    left = pairs.join(a, "a").join(b, "b").where(odd_bits(F.col("pa"), F.col("pb")) <= most)
    left = materialize(left.select("a", "b"), "candidates")
    discard(pairs, index)
    sets = sets_of(rows, left)
    links = materialize(similar_pairs(left, sets), "similar")
    discard(left, sets)
    return links


def members(bound: DataFrame) -> DataFrame:
    """(rid, root) of ``components``, the roots included."""
    return bound.select(F.col("node").alias("rid"), "root").union(bound.select(F.col("root").alias("rid"), "root").distinct())


def copy_classes(rows: DataFrame) -> DataFrame:
    """(rid, root) of the ``rows`` (rid, text) that have a near copy: the classes of all links, each compared exactly."""
    links = banded_links(rows)
    classes = materialize(members(components(links)), "members")
    missed = missed_links(rows, classes)
    return classes if missed.isEmpty() else materialize(members(components(links.union(missed))), "members")


def keep_dissimilar(docs: DataFrame) -> DataFrame:
    """Documents without near copies by text: of each class linked by ``COPY_SIMILARITY`` of shared shingles, that with the smallest id stays.

    Texts without words are near copies of each other.  Of rows with the same id and text one stays.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    text = F.coalesce(F.col("text"), F.lit(""))
    rid = F.xxhash64(key, text)
    classes = copy_classes(docs.select(rid.alias("rid"), text.alias("text")))
    members = docs.select(rid.alias("rid"), key.alias("key"), F.col("doc_id").isNull().alias("no_id"), "doc_id").join(F.broadcast(classes) if classes.count() <= BROADCAST_ROWS else classes, "rid")
    members = materialize(members, "copies")
    stays = members.groupBy("root").agg(F.min(F.struct("no_id", "doc_id", "rid")).alias("stays"))
    gone = members.join(stays, "root").where(F.col("rid") != F.col("stays.rid")).select("key", "rid").distinct()
    gone = materialize(gone, "gone")
    packed = docs.select(key.alias("key"), rid.alias("rid"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    left = packed.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, ["key", "rid"], "left_anti")
    repeated = not docs.groupBy(key, rid).count().where("count > 1").isEmpty()
    return (left.dropDuplicates(["key", "rid"]) if repeated else left).select("row.*")
