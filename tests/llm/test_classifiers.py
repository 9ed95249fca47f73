import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from concord.llm import quality as q
from concord.llm import toxicity as x
from concord.llm.training import labelled_sample
from concord.llm.words import ascii_lower_words, hashed_blocks

SF = "/root/testdata/sf0.01"


def accuracy(spark, result, label, least):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = result.join(labels, "doc_id").where("held_out").select("predicted", label).collect()
    assert len(rows) > 80 and sum(a == b for a, b in rows) / len(rows) >= least


def test_word_hashes_are_those_of_single_words():
    texts = ["Ab  cd\tab", None, "", "x" * 100 + " AB " + "x" * 100, "é É", "ab"]
    found = {}
    for first, _, h, row in hashed_blocks(pa.array(texts), ascii_lower_words(), 7):
        for a, b in zip(h.tolist(), row.tolist(), strict=True):
            found.setdefault(first + b, []).append(a)
    assert found[0][0] == found[0][2] == found[3][1] == found[5][0] and found[3][0] == found[3][2]
    assert len(found[0]) == 3 and 1 not in found and 2 not in found and found[4][0] != found[4][1]


def test_scores_are_sparse_dot_products():
    w = np.random.default_rng(1).normal(size=(1 << q.BITS) + 1).astype(np.float32)
    texts = ["Some words, some WORDS 12!", "", None, "one"]
    got = q.score_array(pa.array(texts), w).to_numpy()
    for value, (ids, values) in zip(got, q.sparse_rows(pa.array(texts)), strict=True):
        assert value == pytest.approx(1 / (1 + np.exp(-(w[-1] + (w[ids] * values).sum()))), rel=1e-4)


def test_ftrl_learns_and_stays_sparse():
    rng = random.Random(2)
    texts, labels = [], []
    for i in range(400):
        y = i % 2
        texts.append(" ".join(rng.choices(["alpha", "beta", "gamma"], k=20) + rng.choices(["good", "fine"] if y else ["JUNK!!", "BAD!!"], k=4)))
        labels.append(y)
    w = q.fit_ftrl(list(q.sparse_rows(pa.array(texts))), np.array(labels, float))
    s = q.score_array(pa.array(["alpha good beta fine", "alpha UNSEEN!! beta OTHER!!", ""]), w.astype(np.float32)).to_numpy()
    assert s[0] > 0.5 > s[1] and 0 < s[2] < 1 and (w != 0).sum() < 500


def linear_accuracy(rows, labels):
    """Share of rows that a logistic regression on the same terms, fitted to the end, gets right."""
    terms = np.unique(np.concatenate([ids for ids, _ in rows]))
    X = np.zeros((len(rows), len(terms)))
    for i, (ids, values) in enumerate(rows):
        X[i, np.searchsorted(terms, ids)] = values
    w, b = np.zeros(len(terms)), 0.0
    for _ in range(400):
        g = 1 / (1 + np.exp(-np.clip(X @ w + b, -30, 30))) - labels
        w, b = w - 2.0 * X.T @ g / len(rows), b - 2.0 * g.mean()
    return float(((X @ w + b > 0) == labels).mean())


def test_machine_learns_exclusive_pairs_that_a_linear_model_misses():
    """Label 1 where exactly one of two words stands: neither has an effect of its own."""
    rng = random.Random(3)
    texts, labels = [], []
    for _ in range(3000):
        words = rng.choices([f"w{k}" for k in range(30)], k=10)
        first, second = rng.random() < 0.5, rng.random() < 0.5
        texts.append(" ".join(words + ["insult"] * first + ["people"] * second))
        labels.append(float(first != second))
    rows, labels = list(x.term_rows(pa.array(texts))), np.array(labels)
    (own,) = x.term_rows(pa.array(["insult people"]))
    assert not np.isin(own[0], x.screen(rows, labels, x.MachineSettings())).any()
    machine = x.fit_machine(rows, labels)
    assert np.isin(own[0], machine.terms).any()
    s = x.score_array(pa.array(texts), machine).to_numpy()
    assert ((s > 0.5) == labels).mean() > 0.97 and linear_accuracy(rows, labels) < 0.65
    a, b, c, d = x.score_array(pa.array(["w1 insult w2", "w3 people", "insult w4 people", "w5 w6"]), machine).to_numpy()
    assert min(a, b) > 0.7 > 0.4 > max(c, d)


@pytest.mark.parametrize("kinds", [40, 80])
def test_many_rare_words_that_matter_together(kinds):
    """Label 1 only where one of many insults meets one of many group names."""
    rng = random.Random(5)

    def text():
        words = rng.choices([f"w{k}" for k in range(500)], k=20)
        insult, group = rng.random() < 0.45, rng.random() < 0.45
        return " ".join(words + [f"zi{rng.randrange(kinds)}q"] * insult + [f"gr{rng.randrange(kinds)}v"] * group), float(insult and group)

    train, held = [text() for _ in range(10_000)], [text() for _ in range(1500)]
    machine = x.fit_machine(list(x.term_rows(pa.array([t for t, _ in train]))), np.array([y for _, y in train]))
    s = x.score_array(pa.array([t for t, _ in held]), machine).to_numpy() >= x.THRESHOLD
    y = np.array([y for _, y in held]) == 1
    assert s[y].mean() > 0.8 and s[~y].mean() < 0.05, (s[y].mean(), s[~y].mean())


def test_machine_fit_matches_plain_updates():
    """AdaGrad on the logistic loss of the machine's formula, one number at a time."""
    rng = np.random.default_rng(6)
    rows = [(np.unique(rng.integers(0, 12, 5)).astype(np.int32), None) for _ in range(40)]
    rows = [(ids, rng.uniform(0.5, 2, len(ids)).astype(np.float32)) for ids, _ in rows]
    labels, settings, terms = rng.integers(0, 2, 40).astype(float), x.MachineSettings(factors=3, epochs=3), np.arange(10)
    got = x.fit_terms(rows, labels, terms, settings)
    share, w0, g0 = labels.mean(), settings.start, 1.0
    w, gw = dict.fromkeys(range(10), 0.0), dict.fromkeys(range(10), 1.0)
    start = np.random.default_rng(7).normal(0, 0.02, (10, 3))
    v, gv = {(i, f): start[i, f] for i in range(10) for f in range(3)}, {(i, f): 1.0 for i in range(10) for f in range(3)}
    for epoch in range(3):
        for r in np.random.default_rng(epoch).permutation(40):
            own = [(int(i), float(value)) for i, value in zip(*rows[r]) if i < 10]
            raw = w0 + sum(w[i] * p for i, p in own) + sum(v[i, f] * v[j, f] * p * q_ for k, (i, p) in enumerate(own) for j, q_ in own[:k] for f in range(3))
            g = (1 / (1 + np.exp(-raw)) - labels[r]) * (0.5 / share if labels[r] else 0.5 / (1 - share))
            sums = [sum(v[i, f] * p for i, p in own) for f in range(3)]
            g0 += g * g
            w0 -= settings.slow * settings.rate * g / g0**0.5
            for i, p in own:
                d = g * p + settings.l2 * w[i]
                gw[i] += d * d
                w[i] -= settings.rate * d / gw[i] ** 0.5
                for f in range(3):
                    d = g * p * (sums[f] - v[i, f] * p) + settings.l2 * v[i, f]
                    gv[i, f] += d * d
                    v[i, f] -= settings.rate * d / gv[i, f] ** 0.5
    assert got.w0 == pytest.approx(w0) and np.allclose(got.w, list(w.values())) and np.allclose(got.v.ravel(), list(v.values()))


def test_ftrl_matches_plain_updates():
    """Per-coordinate FTRL-proximal, one weight at a time in a dictionary."""
    rng = np.random.default_rng(8)
    rows = [(ids := np.unique(rng.integers(0, 30, 6)).astype(np.int32), rng.uniform(0.1, 3, len(ids)).astype(np.float32)) for _ in range(60)]
    labels, s = rng.integers(0, 2, 60).astype(float), q.FtrlSettings(epochs=3)
    z, n, bias = {}, {}, 1 << q.BITS

    def weight(i):
        l1 = 0 if i == bias else s.l1
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        return -np.sign(z[i]) * (abs(z[i]) - l1) / ((s.beta + n[i] ** 0.5) / s.alpha + s.l2)

    for _ in range(s.epochs):
        for (ids, values), y in zip(rows, labels, strict=True):
            own = [*zip(ids.tolist(), values.tolist()), (bias, 1.0)]
            w = {i: weight(i) for i, _ in own}
            p = 1 / (1 + np.exp(-sum(w[i] * v for i, v in own)))
            for i, v in own:
                g = (p - y) * v
                sigma = ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / s.alpha
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    got = q.fit_ftrl(rows, labels, s)
    assert np.allclose(got[[*range(30), bias]], [weight(i) for i in [*range(30), bias]]) and not got[30:-1].any()


def test_machine_scores_match_the_formula():
    texts = ["bad bad words here", "here", ""]
    rows = list(x.term_rows(pa.array(texts)))
    terms = np.unique(np.concatenate([ids for ids, _ in rows]))
    assert sorted(set(rows[0][1].tolist())) == [1.0, pytest.approx(np.log2(3))]
    rng = np.random.default_rng(4)
    m = x.Machine.unpacked(x.Machine(terms, 0.3, rng.normal(size=len(terms)), rng.normal(size=(len(terms), 5))).packed())
    slot = m.slots()
    for value, (ids, values) in zip(x.score_array(pa.array(texts), m).to_numpy(), rows, strict=True):
        own = list(zip(slot[ids], values, strict=True))
        raw = 0.3 + sum(m.w[a] * p for a, p in own) + sum(m.v[a] @ m.v[b] * p * r for k, (a, p) in enumerate(own) for b, r in own[:k])
        assert value == pytest.approx(1 / (1 + np.exp(-raw)))


@pytest.mark.parametrize("module", [q, x])
def test_tables_with_nulls_clashes_and_without_labels(spark, module):
    rows = [(1, "some text", 9), (1, "some text", 9), (None, None, 9), (2, "", 9), (3, "long " * 50_000, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score long")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(1, None, None), (None, 1, 1), (3, 1, 1), (1, 0, 0), (1, 0, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    for labels in (none, odd):
        got = module.classify(docs, labels).collect()
        assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in rows)
        assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= (0.5 if module is q else 0.7)) for r in got)
        assert all(r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 3 == 1) for r in got)
    assert module.classify(docs.limit(0), odd).count() == 0


def test_sample_is_bounded_and_leaves_held_out_rows_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    sample = labelled_sample(docs, labels, "quality", 50)
    assert sample.count() == 50
    texts = {r["text"] for r in sample.collect()}
    allowed = {r["text"] for r in docs.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1}
    assert texts <= allowed


def test_quality_query(spark):
    from concord.llm.queries import op3_quality

    out = op3_quality(spark, SF)
    assert out.count() == 1000
    accuracy(spark, out, "quality", 0.97)


def test_toxicity_query(spark):
    from concord.llm.queries import op10_toxicity

    out = op10_toxicity(spark, SF).persist()
    assert out.count() == 1000
    accuracy(spark, out, "toxic", 0.94)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    clean = out.join(labels, "doc_id").where("held_out AND toxic = 0")
    assert clean.where("predicted = 1").count() <= 0.02 * clean.count()


def test_filter_keeps_good_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    kept = q.keep_good(docs.withColumn("extra", F.lit(1)), labels)
    assert kept.columns == [*docs.columns, "extra"]
    joined = kept.join(labels, "doc_id")
    good = labels.where("quality = 1").count()
    assert joined.where("quality = 1").count() >= 0.99 * good and joined.where("quality = 0").count() <= 2
