import random

import numpy as np
import pyarrow as pa
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from concord.llm import simhash


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    """rows: (doc_id, fingerprint); the smallest id reachable of each."""
    codes = np.array([f for _, f in rows], np.uint64)
    near = np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 3
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            least = min(label[j] for j in np.flatnonzero(near[i]))
            if least < label[i]:
                label[i], changed = least, True
    ids: dict = {}
    for (doc_id, _), c in zip(rows, label, strict=True):
        if doc_id is not None:
            ids[c] = min(ids.get(c, doc_id), doc_id)
    return [ids.get(c) for c in label]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAb éß\t\n\x0b\x1c0", max_size=60)), max_size=8))
def test_fingerprints_match_brute_force(texts):
    got = simhash.fingerprint_array(pa.array(texts, pa.string())).to_numpy().view(np.uint64).tolist()
    assert got == [brute_fingerprint(t) for t in texts]


def test_fingerprint_of_long_texts():
    rng = random.Random(1)
    text = " ".join("".join(rng.choices("abcdefgh", k=rng.choice([1, 4, 9, 40, 70]))) for _ in range(3000))
    assert simhash.fingerprint_array(pa.array([text])).to_numpy().view(np.uint64)[0] == brute_fingerprint(text)


def test_xxh64_of_all_lengths():
    data = np.frombuffer(random.Random(2).randbytes(5000), np.uint8)
    lengths = np.arange(99)
    starts = np.cumsum(lengths) - lengths
    assert simhash.xxh64(data, starts, lengths).tolist() == [xxhash.xxh64_intdigest(data[a : a + n].tobytes(), 42) for a, n in zip(starts, lengths, strict=True)]


def test_gray_ranks_follow_the_gray_sequence():
    n = np.arange(256, dtype=np.uint64)
    assert simhash.gray_rank(n ^ (n >> np.uint64(1))).tolist() == n.tolist()


def scattered(seed, count):
    """Fingerprints in balls around few centres, so that many lie within three bits."""
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 2**63, 5, dtype=np.uint64)
    out = rng.choice(centres, count)
    for _ in range(4):
        flip = rng.integers(0, 64, count).astype(np.uint64)
        out = out ^ np.where(rng.random(count) < 0.5, np.uint64(1) << flip, np.uint64(0))
    return np.unique(out)


def test_index_finds_all_pairs():
    codes = scattered(3, 600)
    codes = codes[np.argsort(simhash.gray_rank(codes))]
    got = {p for a, b in simhash.GrayIndex(np.zeros(len(codes)), codes).near_pairs() for p in zip(a.tolist(), b.tolist(), strict=True)}
    near = np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 3
    assert got == {(i, j) for i, j in zip(*np.nonzero(near), strict=True) if i < j}


def test_links_with_and_without_crowded_buckets(spark):
    codes = scattered(4, 300)
    want = brute_components(list(enumerate(codes.tolist())))
    fps = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "fp long")
    place = {int(c): i for i, c in enumerate(codes.view(np.int64))}
    for hot in (20_000, 10):
        edges = [(place[a], place[b]) for a, b in simhash.links(fps, hot).collect()]
        label = list(range(len(codes)))
        for _ in range(len(codes)):
            for a, b in edges:
                label[a] = label[b] = min(label[a], label[b])
        assert label == want


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 140)] + [(200, 200)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 140)}


ROWS = [(7, "one two three four"), (3, "One  two\nthree four"), (9, "one two three five"), (None, "one two three four"), (1, None), (2, ""), (2, ""), (5, " \t"), (11, "x"), (None, "only null here")]


def test_near_duplicates_with_nulls_ties_and_copies(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("root", F.lit(0))
    found = lambda hot: sorted((str(r["doc_id"]), r["fp"] & (2**64 - 1), str(r["component_id"])) for r in simhash.near_duplicates(docs, hot=hot).collect())
    got = found(simhash.HOT)
    assert got == found(1) == found(2)  # fingerprints with more rows are joined apart
    coded = [(i, brute_fingerprint(t)) for i, t in ROWS]
    assert got == sorted((str(i), f, str(c)) for (i, f), c in zip(coded, brute_components(coded), strict=True))


def test_one_document_of_each_class_stays(spark):
    docs = spark.createDataFrame([(*r, "a") for r in [*ROWS, (2, "other text of a repeated id"), (2, "other text of a repeated id")]], "doc_id long, text string, _key string")
    got = sorted((str(r["doc_id"]), r["text"] or "", r["_key"]) for r in simhash.keep_one(docs).collect())
    assert [(i, t) for i, t, _ in got] == sorted([("3", "One  two\nthree four"), ("9", "one two three five"), ("1", ""), ("11", "x"), ("None", "only null here"), ("2", "other text of a repeated id")])
    assert {k for *_, k in got} == {"a"}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0 and simhash.keep_one(docs).count() == 0


def shingle_set(text, n=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute_classes(rows):
    """The row with the smallest id, nulls last, of each class linked by pairs of near copies."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0]))
    sets = [shingle_set(text) for _, text in rows]
    label = list(range(len(rows)))
    for _ in rows:
        for i, own in enumerate(sets):
            for k in range(i):
                if jaccard(own, sets[k]) >= 0.8:
                    label[i] = label[k] = min(label[i], label[k])
    return sorted((str(rows[i][0]), str(rows[i][1])) for i in set(label))


def edited(seed):
    """Families of texts of a few hundred words with a few words changed, and of some only one."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=5))
    rows = []
    for family in range(12):
        base = [word() for _ in range(rng.randrange(400, 600))]
        for _ in range(rng.choice([1, 2, 6, 9])):
            own = list(base)
            for _ in range(rng.choice([0, 1])):
                own[rng.randrange(len(own))] = word()
            rows.append((rng.randrange(10_000), " ".join(own)))
    return rows


def test_near_copies_by_text(spark):
    rows = [*edited(1), (None, "one two three four five six"), (3, "one two three four five six"), (4, None), (5, ""), (6, "a"), (7, "a"), (6, "other words of a repeated id that stay here")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, key string")
    out = simhash.keep_dissimilar(docs)
    assert out.columns == docs.columns
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in out.collect()) == brute_classes(rows)
    assert simhash.keep_dissimilar(docs.limit(0)).count() == 0


def far_copies(seed):
    """Families of shorter texts with up to two changed words, all with one common line."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=5))
    line, rows = " ".join(word() for _ in range(12)), []
    for family in range(40):
        base = [word() for _ in range(rng.choice([12, 40, 70, 110]))]
        for _ in range(rng.choice([1, 2, 5])):
            own = list(base)
            for _ in range(rng.choice([0, 1, 2])):
                own[rng.randrange(len(own))] = word()
            rows.append((len(rows) * 7919 % 10_007, " ".join([*own, line])))
    return rows


def test_near_copies_whose_fingerprints_differ_widely(spark):
    rows = far_copies(3)
    fps = simhash.fingerprint_array(pa.array([t for _, t in rows])).to_numpy().view(np.uint64)
    sets = [shingle_set(t) for _, t in rows]
    far = [(i, k) for i in range(len(rows)) for k in range(i) if jaccard(sets[i], sets[k]) >= 0.8 and np.bitwise_count(fps[i] ^ fps[k]) > 7]
    assert len(far) > 5
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((str(r[0]), r[1]) for r in simhash.keep_dissimilar(docs).collect()) == brute_classes(rows)


def test_large_family_of_near_copies_and_unlike_texts_of_one_frame(spark):
    """One family of near copies, and texts that share half of their words with all others: recall of links, and nothing else goes."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=5))
    base, frame, rows = [word() for _ in range(200)], [word() for _ in range(60)], []
    for k in range(300):
        own = list(base)
        for _ in range(2):
            own[rng.randrange(len(own))] = word()
        rows.append((k, " ".join(own)))
    rows += [(1000 + k, " ".join([*frame, *(word() for _ in range(50))])) for k in range(300)]
    for k in range(200):  # pairs at just 0.8 or more
        own = [word() for _ in range(100)]
        other = list(own)
        for _ in range(2):
            other[rng.randrange(100)] = word()
        rows += [(2000 + 2 * k, " ".join(own)), (2001 + 2 * k, " ".join(other))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r[0] for r in simhash.keep_dissimilar(docs).collect()}
    assert len([i for i in left if i < 1000]) <= 3 and len([i for i in left if 1000 <= i < 2000]) == 300
    sets = {i: shingle_set(t) for i, t in rows}
    pairs = [i for i in range(2001, 2400, 2) if jaccard(sets[i], sets[i - 1]) >= 0.8]
    assert len(pairs) > 50 and sum(i not in left for i in pairs) >= 0.98 * len(pairs)
    assert all(i in left for i in range(2000, 2400, 2)) and all(i in left for i in range(2001, 2400, 2) if i not in pairs)


def test_links_at_a_larger_distance(spark):
    codes = scattered(5, 200)
    near = np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 7
    label = list(range(len(codes)))
    for _ in range(len(codes)):
        label = [min(label[j] for j in np.flatnonzero(near[i])) for i in range(len(codes))]
    place = {int(c): i for i, c in enumerate(codes.view(np.int64))}
    fps = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "fp long")
    for hot in (20_000, 10):
        got = list(range(len(codes)))
        edges = [(place[a], place[b]) for a, b in simhash.links(fps, hot, 7).collect()]
        for _ in range(len(codes)):
            for a, b in edges:
                got[a] = got[b] = min(got[a], got[b])
        assert got == label


def test_shingle_sets_match_plain_ones(spark):
    texts = ["a b c d e f", "A  b c d e", "a b", "", None, "x y z w v x y z w v x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    sets = [set(r[0]) for r in df.orderBy("i").select(simhash.shingle_sets(F.col("t"))).collect()]
    plain = [shingle_set(t) for t in texts]
    for a, x in zip(sets, plain, strict=True):
        for b, y in zip(sets, plain, strict=True):
            assert len(a & b) == len(x & y) and len(a) == len(x)


def loose_group(seed, count):
    """Texts of one frame with two changed words each: most pairs of them are less than near copies, some are, hardly any next to each other in a band."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=5))
    base, rows = [word() for _ in range(100)], []
    for k in range(count):
        own = list(base)
        for _ in range(2):
            own[rng.randrange(len(own))] = word()
        rows.append((k, " ".join(own)))
    return rows + [(count + k, t) for k, t in enumerate(["", None, " \t", "a b", "a  B", "a b c d e", "a b c d e f"])]


def alike(rows):
    """All pairs (i, k), k < i, of near copies."""
    sets = [shingle_set(t) for _, t in rows]
    return {(rows[i][0], rows[k][0]) for i in range(len(rows)) for k in range(i) if jaccard(sets[i], sets[k]) >= 0.8}


def test_no_link_of_a_loose_group_is_missed(spark):
    rows = loose_group(11, 400)
    label = {i: i for i, _ in rows}
    pairs = alike(rows)
    for _ in rows:
        for i, k in pairs:
            label[i] = label[k] = min(label[i], label[k])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r[0] for r in simhash.keep_dissimilar(docs).collect()) == sorted(set(label.values()))


def test_prefix_filter_alone_finds_all_links(spark, monkeypatch):
    rows = [(k, t) for k, (_, t) in enumerate(loose_group(12, 150) + edited(2) + far_copies(4))]
    docs = spark.createDataFrame(rows, "rid long, text string")
    none = spark.createDataFrame([], "rid long, root long")
    empty = {i for i, t in rows if not shingle_set(t)}
    want = {p for p in alike(rows) if not set(p) <= empty}
    for sample, searched in ((10_000, 200_000), (20, 50), (1, 1)):  # whatever the order, and in small steps
        monkeypatch.setattr(simhash, "SAMPLE_ROWS", sample)
        monkeypatch.setattr(simhash, "SEARCH_ROWS", searched)
        monkeypatch.setattr(simhash, "PAIRS_AT_ONCE", searched)
        got = {(r["a"], r["b"]) for r in simhash.missed_links(docs, none).collect()}
        chain = {p for p in got if set(p) <= empty}
        assert got - chain == want and {i for p in chain for i in p} == empty and len(want) > 300
