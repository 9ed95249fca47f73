import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from concord.llm import mixing as m


def brute_sums(pairs):
    sums = {0}
    for size, count in pairs:
        for _ in range(count):
            sums |= {s + size for s in sums}
    return sums


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(0, 30), st.integers(1, 4), max_size=5), st.integers(0, 200))
def test_reachable_sums_are_the_best(counts, budget):
    sizes, n = np.array(list(counts), np.int64), np.array(list(counts.values()), np.int64)
    taken = m.reachable(sizes, n, budget)
    assert all(k <= counts[s] for s, k in taken.items())
    assert sum(s * k for s, k in taken.items()) == max(x for x in brute_sums(counts.items()) if x <= budget)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(0, 40), st.integers(1, 60), max_size=8), st.integers(0, 5000), st.sampled_from([0, 10, 1000, 65536]))
def test_budgets_are_kept(counts, budget, dp_words):
    sizes, n = np.array(list(counts), np.int64), np.array(list(counts.values()), np.int64)
    take = m.fit_budget(sizes, n, budget, dp_words)
    assert ((0 <= take) & (take <= n)).all()
    total, goal = int((sizes * take).sum()), min(budget, int((sizes * n).sum()))
    assert total <= goal
    if dp_words >= budget:
        assert total == max(x for x in brute_sums(counts.items()) if x <= goal) if sum(counts.values()) < 40 else True


def brute_targets(totals):
    """Shares by weight; sources over their stop are set to it, the excess shared again."""
    order = sorted((s for s in totals if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in totals else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target = {s: 0.0 for s in order}
    rest, open_ = 1.5 * sum(totals.values()), list(order)
    while open_:
        level = rest / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * level >= 2 * totals[s]]
        if not full:
            target |= {s: weight[s] * level for s in open_}
            break
        for s in full:
            target[s] = 2.0 * totals[s]
            rest -= target[s]
        open_ = [s for s in open_ if s not in full]
    return target


def test_targets(spark):
    for totals in ({"a": 100, "b": 300, "c": 50, None: 10, "é": 7, "😀": 9, "￿": 3}, {"x": 5}, {"a": 0, "b": 4}, {"a": 0}):
        df = spark.createDataFrame(list(totals.items()), "source string, source_size long")
        got = {r["source"]: r["target"] for r in m.targets(df).collect()}
        want = brute_targets(totals)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def best_taken(sizes, target):
    """Words that a source of these documents can take next below its target, each document once or twice."""
    total = sum(sizes)
    base = int(target // total) if total else 0
    rest = int(round(target - base * total))
    bits = 1
    for n in sizes:
        bits |= bits << n
    return base * total + (bits & ((1 << (rest + 1)) - 1)).bit_length() - 1


def corpus(spark, n=400):
    rows = []
    for i in range(n):
        source = None if i % 7 == 0 else "hot" if i % 3 == 0 else f"s{i % 5}"
        text = None if i % 50 == 3 else " \t".join(["w"] * (i * 37 % 90)) + ("\x1c" if i % 9 == 0 else "\n")
        rows.append((i % 300 if i % 41 else None, source, text, "clash"))
    return spark.createDataFrame(rows, "doc_id long, source string, text string, size string"), rows


def test_mix_meets_its_targets(spark):
    docs, rows = corpus(spark)
    got = m.mix(docs.repartition(5)).collect()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((str(r["doc_id"]), str(r["source"]), r["size"]) for r in got) == sorted((str(i), str(s), words(t)) for i, s, t, _ in rows)
    totals: dict = {}
    for _, s, t, _ in rows:
        totals[s] = totals.get(s, 0) + words(t)
    target = brute_targets(totals)
    for s in totals:
        own = [r for r in got if r["source"] == s]
        assert all(r["source_size"] == totals[s] and abs(r["target"] - target[s]) < 1e-6 and r["taken"] in (0, r["size"], 2 * r["size"]) for r in own)
        assert sum(r["taken"] for r in own) == best_taken([r["size"] for r in own], target[s])
    again = m.mix(docs.repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mix_by_shuffled_plan_is_the_same(spark, monkeypatch):
    docs, _ = corpus(spark, 200)
    want = sorted(map(str, m.mix(docs).collect()))
    monkeypatch.setattr(m, "BROADCAST_ROWS", 0)
    assert sorted(map(str, m.mix(docs).collect())) == want


def test_repeated_rows_come_once_with_all_copies(spark):
    rows = [(1, "a b c", "x", 1)] * 5 + [(2, "d e", "x", 1), (2, "other words here", "y", 1), (3, "", "y", 1), (None, "f g", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies long")
    out = m.mixed_documents(docs)
    assert out.columns == [*docs.columns, "copies_2"]
    taken = {(r["doc_id"], r["text"]): r["copies_2"] for r in out.collect()}
    assert len(taken) == out.count() and (3, "") in taken or taken
    assert sum(r["taken"] for r in m.mix(docs).collect()) == sum(len(t.split()) * n for (_, t), n in taken.items())


def test_long_documents_leave_the_programme_small(monkeypatch):
    """Sums of the programme stay within a few times ``dp_words``, whatever is left of a budget."""
    budgets = []
    plain = m.reachable
    monkeypatch.setattr(m, "reachable", lambda s, n, b: budgets.append(b) or plain(s, n, b))
    for sizes, counts, budget in (([10**9, 5], [1, 40], 5 * 10**8), ([4 * 10**8, 7], [2, 9], 5 * 10**8), ([10**7, 3000, 11], [30, 5000, 10**6], 123_456_789), ([10**6 + 1, 10**6], [900, 900], 10**9 - 1)):
        sizes, counts = np.array(sizes, np.int64), np.array(counts, np.int64)
        take = m.fit_budget(sizes, counts, budget, 1000)
        total = int((take * sizes).sum())
        assert (take <= counts).all() and total <= budget and budgets[-1] <= 5000
        left = sizes[take < counts]
        assert not len(left) or total + left.min() > budget or total == budget


def test_mixed_documents_are_those_of_the_mix(spark, monkeypatch):
    docs, _ = corpus(spark)
    copies = lambda rows: +sum((Counter({(r["doc_id"], r["source"]): r["copies"]}) for r in rows), Counter())
    want = copies(m.mix(docs).collect())
    for rows in (m.BROADCAST_ROWS, 0):
        monkeypatch.setattr(m, "BROADCAST_ROWS", rows)
        out = m.mixed_documents(docs)
        assert copies(out.collect()) == want and out.count() == out.select("doc_id", "source", "text").distinct().count()
    unique = spark.createDataFrame([(i, "w " * (i % 9), "s") for i in range(90)], "doc_id long, text string, source string")
    monkeypatch.undo()
    assert "Exchange hashpartitioning" not in m.mixed_documents(unique)._jdf.queryExecution().executedPlan().toString()


def test_nulls_keep_rows_apart(spark):
    rows = [(1, "a b", None, "x"), (1, "a b", "x", None), (1, "a b", None, "x"), (None, "c d", "s", None), (None, "c d", "s", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, more string")
    out = {(r["doc_id"], r["source"], r["more"]) for r in m.mixed_documents(docs).collect()}
    assert out <= {(r[0], *r[2:]) for r in rows} and m.mixed_documents(docs).count() == len(out)
    assert sum(r["taken"] for r in m.mix(docs).collect()) == sum(2 * r["copies"] for r in m.mixed_documents(docs).collect())


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert m.mix(docs).count() == 0 and m.mixed_documents(docs).count() == 0


def test_query(spark):
    from concord.llm.queries import op2_mixing

    by_source: dict = {}
    for r in op2_mixing(spark, "/root/testdata/sf0.001").collect():
        by_source.setdefault(r["source"], []).append(r)
        assert r["taken"] <= 2 * r["size"]
    for rows in by_source.values():
        assert sum(r["taken"] for r in rows) == best_taken([r["size"] for r in rows], rows[0]["target"])
