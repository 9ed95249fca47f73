import collections
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest

from concord.llm import kneserney as k
from concord.llm.words import ascii_lower_words, hashed_blocks


class Plain:
    """The model by dictionaries."""

    def __init__(self, texts, order=k.ORDER):
        self.order, self.c, top = order, collections.Counter(), collections.Counter()
        for t in texts:
            w = self.tokens(t)
            self.c.update(w)
            top.update(self.grams(w))
        self.n, self.v = sum(self.c.values()), len(self.c)
        self.counts = {order: top}
        for n in range(order - 1, 0, -1):
            self.counts[n] = collections.Counter(g[1:] for g in self.counts[n + 1])
        self.d = {n: k.discounts(*(sum(x == i for x in c.values()) for i in (1, 2, 3, 4))) for n, c in self.counts.items()}
        self.total, self.follow = collections.Counter(), collections.defaultdict(lambda: [0, 0, 0])
        for counts in self.counts.values():
            for g, c in counts.items():
                self.total[g[:-1]] += c
                self.follow[g[:-1]][min(c, 3) - 1] += 1

    @staticmethod
    def tokens(text):
        return [*(text or "").encode().lower().split(), b"</s>"]

    def grams(self, w):
        padded = [b"<s>"] * (self.order - 1) + w
        return [tuple(padded[i : i + self.order]) for i in range(len(w))]

    def p(self, gram):
        n = len(gram)
        lower = self.p(gram[1:]) if n > 1 else 1 / (self.v + 1)
        if not (total := self.total[gram[:-1]]):
            return lower
        d, c = self.d[n], self.counts[n][gram]
        return max(c - d[min(c, 3)], 0) / total + sum(d[i + 1] * x for i, x in enumerate(self.follow[gram[:-1]])) / total * lower

    def row(self, text):
        w = self.tokens(text)
        base = sum(math.log10((self.c[x] + 0.1) / (self.n + 0.1 * (self.v + 1))) for x in w)
        return len(w), sum(self.c[x] > 0 for x in w), self.n, base, sum(math.log10(self.p(g)) for g in self.grams(w))


TEXTS = ["the cat sat", "The CAT ran  fast", "the dog sat\ton the mat", "a b a b a b a b", "the the the the", "", None, "é x é y", "the cat sat", "unique words only here", "the cat and the dog and the cat"] * 2


def check(rows, plain, texts):
    assert len(rows) == len(texts)
    for r, t in zip(rows, texts, strict=True):
        n, known, total, base, score = plain.row(t)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-11, abs=1e-9) and r["score"] == pytest.approx(score, rel=1e-11, abs=1e-9)
        assert r["perplexity"] == pytest.approx(10 ** (-score / n))


def scored(spark, train, texts, order=k.ORDER):
    docs = spark.createDataFrame([(i, t, 0.0) for i, t in enumerate(train)], "doc_id long, text string, score double").repartition(3)
    asked = spark.createDataFrame([(i, t, 0.0) for i, t in enumerate(texts)], "doc_id long, text string, score double")
    model = k.fit(docs, order=order)
    return model, k.score(asked, model, ["doc_id"]).orderBy("doc_id").collect()


@pytest.mark.parametrize("order", [2, 3, 4])
def test_scores_match_plain_counts(spark, order):
    asked = [*TEXTS, "never seen words", "the unseen cat", "x" * 5000, "the " * 20_000]
    model, rows = scored(spark, TEXTS, asked, order)
    check(rows, Plain(TEXTS, order), asked)
    assert (model.tokens, model.distinct) == (Plain(TEXTS).n, Plain(TEXTS).v)


def test_flushes_and_hot_contexts_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(k, "FLUSH", 3)
    rng = np.random.default_rng(1)
    train = [" ".join("w%d" % i for i in rng.zipf(1.3, 30) % 200) for _ in range(300)] + ["hot " * 9000]
    asked = train[:40] + ["hot hot w1 w2 none"]
    model, rows = scored(spark, train, asked)
    check(rows, Plain(train), asked)
    assert len(model.hot) > 1  # the start, and "hot"


def test_probabilities_add_up_to_one(spark):
    model, _ = scored(spark, TEXTS, ["a"])
    plain = Plain(TEXTS)
    for context in [(b"<s>", b"<s>"), (b"<s>", b"the"), (b"the", b"cat"), (b"nowhere", b"the"), (b"no", b"where")]:
        assert sum(plain.p((*context, w)) for w in plain.c) + plain.p((*context, b"unknown")) == pytest.approx(1)
    scorer = k.Scorer(model)
    words = [w for w in plain.c if w != b"</s>"]
    text = [f"the {w.decode()}" for w in words]
    (_, _, h, row), = hashed_blocks(pa.array(text), ascii_lower_words())
    both = scorer.score(h, row, len(text))[3]
    assert np.allclose(both, [plain.row(t)[4] for t in text])


def test_a_corpus_of_copies_scores_nothing_as_impossible(spark):
    """Copies leave no n-gram that came once, and counts of counts from which plain discounts are zero."""
    train = ["all of these words come often"] * 9 + ["some of these come too"] * 5 + ["x y"] * 4
    asked = [*dict.fromkeys(train), "often words", "x unseen y", "too x", ""]
    _, rows = scored(spark, train, asked)
    assert all(math.isfinite(r["score"]) and math.isfinite(r["perplexity"]) for r in rows)
    plain = Plain(train)
    check(rows, plain, asked)
    for context in [(b"<s>", b"<s>"), (b"of", b"these"), (b"these", b"words")]:
        assert sum(plain.p((*context, w)) for w in plain.c) + plain.p((*context, b"unknown")) == pytest.approx(1)
    for counts in ((10, 1, 1, 100), (0, 0, 0, 0), (0, 5, 0, 1), (1, 0, 0, 0), (1, 10**9, 10**9, 10**9)):
        d = k.discounts(*counts)
        assert all(0 < x < n for n, x in enumerate(d[1:], 1))


def test_counts_have_no_cap(tmp_path):
    folder = k.Folder(f"file://{tmp_path}")
    keys, counts = np.array([3, 9], np.uint64), np.array([2**40, 1], np.uint64)
    folder.write("level3-0", keys, counts)
    own, (column,) = folder.columns("level3-0", 1)
    assert own.tolist() == [3, 9] and column.tolist() == [2**40, 1]


def test_no_training_texts(spark):
    _, rows = scored(spark, [], ["a b", "", None])
    assert [(r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in rows] == [(3, 0, 0.0, 0.0), (1, 0, 0.0, 0.0), (1, 0, 0.0, 0.0)]
    model = k.fit(spark.createDataFrame([("a b",)], "text string"))
    assert k.score(spark.createDataFrame([], "doc_id long, text string"), model, ["doc_id"]).count() == 0


def test_packed_arrays():
    for x in ([], [0, 255], [256], [2**33, 1], [2**64 - 1]):
        a = np.array(x, np.uint64)
        (b,) = k.unpacked(k.packed(a))
        assert b.tolist() == x


def test_files_through_other_stores(tmp_path):
    folder = k.Folder(f"file://{tmp_path}")
    other = k.Folder(f"file://{tmp_path}")
    other.local = None  # as if it were no local path
    other.write("words-1", np.arange(5, dtype=np.uint64), np.arange(300, 305, dtype=np.uint64))
    for f in (folder, other):
        keys, (column,) = f.columns("words-1", 1)
        assert keys.tolist() == [0, 1, 2, 3, 4] and column.tolist() == [300, 301, 302, 303, 304]
        with pytest.raises(OSError):
            f.mapped("none")


def test_a_missing_file_is_an_error(spark):
    model, _ = scored(spark, TEXTS, ["a"])
    for shard in model.shards[3]:
        k.os.remove(f"{k.Folder(model.uri).local}/level3-{shard}")
    (_, _, h, row), = hashed_blocks(pa.array(["the cat sat"]), ascii_lower_words())
    with pytest.raises(OSError):
        k.Scorer(model).score(h, row, 1)


def test_query_against_plain_counts(spark):
    from concord.llm.queries import OP4_ORDER, op4_kneser_ney

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").orderBy("doc_id").collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    plain = Plain([r["text"] for r in docs if not held(r["doc_id"])], OP4_ORDER)
    rows = op4_kneser_ney(spark, d).orderBy("doc_id").collect()
    check(rows, plain, [r["text"] for r in docs])
    assert all(r["held_out"] == held(r["doc_id"]) for r in rows)
    quality = [(r["score"], r["base_score"]) for r in rows if r["held_out"]]
    assert sum(a for a, _ in quality) > sum(b for _, b in quality)
