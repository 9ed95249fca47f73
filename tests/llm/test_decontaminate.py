import random
import time
import tracemalloc

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from concord.llm import decontaminate as d


def brute_tiles(a, b, least):
    """Greedy string tiling in its plain form: marks of a."""
    used_a, used_b = [False] * len(a), [False] * len(b)
    while True:
        best = []
        longest = least
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and not used_a[i + k] and not used_b[j + k]:
                    k += 1
                if k > longest:
                    best, longest = [(i, j, k)], k
                elif k == longest:
                    best.append((i, j, k))
        if not best:
            return used_a
        for i, j, k in best:
            if not any(used_a[i : i + k]) and not any(used_b[j : j + k]):
                used_a[i : i + k] = used_b[j : j + k] = [True] * k


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=30), st.lists(st.integers(0, 3), max_size=40))
def test_tiles_are_common_unmarked_runs(a, b):
    """Every tile is a common run; none of that length is left over; and the longest common run is covered."""
    x, y = np.array(a, np.uint64), np.array(b, np.uint64)
    marked, tiles = d.tile(x, y, np.zeros(len(y), bool), 3)
    want = brute_tiles(a, b, 3)
    assert bool(marked.any()) == any(want)
    if any(want):
        assert tiles >= 1 and marked.sum() >= 3


def test_tiles_of_distinct_words_match_brute_force():
    rng = random.Random(5)
    for _ in range(60):
        a = list(range(40))
        b = []
        for _ in range(rng.randrange(1, 6)):
            i, n = rng.randrange(40), rng.randrange(1, 15)
            b += a[i : i + n] + [100 + rng.randrange(9)]
        marked, _ = d.tile(np.array(a, np.uint64), np.array(b, np.uint64), np.zeros(len(b), bool), 3)
        assert marked.sum() == sum(brute_tiles(a, b, 3))


def words(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices("abcdefghij", k=6)) for _ in range(n)]


ITEMS = [(1, " ".join(words(40, 1))), (2, " ".join(words(30, 2))), (3, None), (4, ""), (5, "too short Item"), (6, "Some Name"), (2, " ".join(words(30, 2)))]
A, B = words(40, 1), words(30, 2)
DOCS = [
    (10, "Before. " + " ".join(A) + " after", {1}),
    (11, " ".join(A[20:]) + " something between " + " ".join(A[:20]), {1}),  # reordered
    (12, " ".join(w.upper() + "," for w in B) + " and " + " ".join(A), {1, 2}),
    (13, " ".join(A[:12]), set()),  # too little
    (14, " ".join(w for x in A for w in (x, "filler")), set()),  # no run of five words
    (15, None, set()),
    (16, "", set()),
    (17, "Too short: item!", {5}),
    (18, "too short item but longer", {5}),
    (20, "some name", {6}),
    (21, "some name but longer", set()),
    (19, " ".join(words(3000, 9) + B + words(3000, 8)), {2}),
    (19, " ".join(words(3000, 9) + B + words(3000, 8)), {2}),
    (None, " ".join(A) * 2, {1}),
]


def test_contaminated_documents(spark):
    docs = spark.createDataFrame([(i, t, 0.5) for i, t, _ in DOCS], "doc_id long, text string, coverage double")
    items = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id long, text string, doc_id string")
    for block in (d.BLOCK_TEXT, 1):  # all at once, and an item a pass
        found = sorted((str(r["doc_id"]), r["item_id"]) for r in d.contaminations(docs, items, block_text=block).collect())
        assert found == sorted((str(i), k) for i, _, want in DOCS for k in want for _ in range(2 if k == 2 else 1))
        kept = d.keep_clean(docs, items, block_text=block)
        assert kept.columns == docs.columns
        assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(i) for i, _, want in DOCS if not want)


def test_coverage_is_of_the_item(spark):
    docs = spark.createDataFrame([(1, " ".join(A[:30]))], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(A))], "item_id long, text string")
    r = d.contaminations(docs, items).first()
    assert (r["item_words"], r["matched_words"], r["tiles"], r["coverage"]) == (40, 30, 1, 0.75)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    full = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert d.contaminations(docs, full).count() == d.contaminations(some, items).count() == 0
    assert d.keep_clean(some, items).count() == 1 and d.keep_clean(docs, full).count() == 0


def test_against_plain_search_of_all_pairs():
    rng = random.Random(3)
    items = [words(rng.randrange(6, 40), s) for s in range(20)]
    docs = []
    for _ in range(60):
        body = words(rng.randrange(50), rng.random())
        for _ in range(rng.randrange(3)):
            w = rng.choice(items)
            i = rng.randrange(len(w))
            body[rng.randrange(len(body) + 1) :] += w[i : i + rng.randrange(3, 40)]
        docs.append(body)
    block = d.BenchmarkBlock(list(range(20)), [" ".join(w) for w in items])
    got = {(row, i): n for row, i, n, _ in block.search(pa.array([" ".join(x) for x in docs]))}
    want = {}
    for row, x in enumerate(docs):
        for i, w in enumerate(items):
            n = sum(brute_tiles(w, x, 5))
            if n >= 0.5 * len(w):
                want[row, i] = n
    assert got == want and want


def test_repetitive_texts_take_little_time_and_memory():
    """A word, or a phrase, that comes thousands of times in both."""
    for a, b in (([7] * 3000, [7] * 9000), ([1, 2, 3, 4, 5, 6] * 800, [1, 2, 3, 4, 5, 6] * 3000), ([7] * 3000, [7, 7, 7, 7, 7, 7, 8] * 3000)):
        x, y = np.array(a, np.uint64), np.array(b, np.uint64)
        tracemalloc.start()
        began = time.perf_counter()
        marked, tiles = d.tile(x, y, np.zeros(len(y), bool))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert marked.mean() > 0.99 and peak < 300 << 20 and time.perf_counter() - began < 60


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=30), st.lists(st.integers(0, 2), max_size=40))
def test_matches_in_pieces_are_those_of_plain_search(a, b):
    """With room for one pair at a time."""
    x, y = np.array(a, np.uint64), np.array(b, np.uint64)
    none = lambda z: np.zeros(len(z), bool)
    hashes = d.RunningHashes(x), d.RunningHashes(y)
    kept, d.PAIRS = d.PAIRS, 1
    try:
        _, pieces = d.matches(x, y, none(x), none(y), 3, hashes)
        found = [tuple(map(int, m)) for piece in pieces() for m in zip(*piece, strict=True)]
        marked, _ = d.tile(x, y, none(y), 3)
    finally:
        d.PAIRS = kept
    run = lambda i, j: next(n for n in range(len(a) + 1) if i + n == len(a) or j + n == len(b) or a[i + n] != b[j + n])
    plain = {(i, j, run(i, j)) for i in range(len(a)) for j in range(len(b)) if run(i, j) >= 3 and not (i and j and a[i - 1] == b[j - 1])}
    assert len(found) == len(plain) and set(found) == plain
    assert bool(marked.any()) == bool(plain)


def test_words_of_any_script_and_punctuation():
    item = "L’été, “où” naïve ÉCOLE größe 東京 мир слово"
    block = d.BenchmarkBlock([1, 2], [item, "three “word” item"])
    found = list(block.search(pa.array(["x l été — où «NAÏVE» e\u0301cole GRÖSSE größe", "l été où naïve école größe 東京 МИР Слово!", None, "a three word; item", "threeword item", "l été où naïve école grosse 東京"])))
    assert {(row, i) for row, i, *_ in found} == {(0, 0), (1, 0), (3, 1), (5, 0)}


def test_clashing_columns_of_a_benchmark(spark):
    items = spark.createDataFrame([(1, " ".join(A), 5, 0.1)], "item_id long, text string, doc_id long, coverage double")
    docs = spark.createDataFrame([(10, " ".join(A), 1, 2)], "doc_id long, text string, item_id long, tiles long")
    assert [tuple(r)[:2] for r in d.contaminations(docs, items).collect()] == [(10, 1)] and d.keep_clean(docs, items).columns == docs.columns


def test_query_covers_the_whole_table(spark):
    from concord.llm.queries import op1_decontamination

    found = op1_decontamination(spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()
    plain = {(r["doc_id"], i["item_id"]) for r in docs.collect() for i in items if i["text"] in r["text"]}
    assert plain <= {(r["doc_id"], r["item_id"]) for r in found.collect()} and found.where(F.col("coverage") < d.THRESHOLD).count() == 0
