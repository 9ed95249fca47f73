import collections
import re
import unicodedata

import pytest
from pyspark.sql import functions as F
from tests.llm.test_decontaminate import brute_tiles
from tests.llm.test_mixing import best_taken, brute_targets
from tests.llm.test_simhash import brute_classes, brute_components, brute_fingerprint

import corpus_pipeline
from concord.llm import quality, secrets
from concord.llm.training import id_remainder

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Rows after each stage, the input first."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        docs = f(spark, docs, SF)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.append(docs.collect())
    return out


def ids(rows):
    return sorted(r["doc_id"] for r in rows)


def test_quality_stage_drops_what_is_rejected(spark, stages):
    docs = spark.createDataFrame(stages[0])
    scored = quality.classify(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert ids(stages[1]) == ids(scored.where("predicted = 1").collect()) and 0 < len(stages[1]) < len(stages[0])


def test_dedup_stage_keeps_one_of_each_class(stages):
    rows = [(r["doc_id"], brute_fingerprint(r["text"])) for r in stages[1]]
    first = set(brute_components(rows))
    left = brute_classes([(r["doc_id"], r["text"]) for r in stages[1] if r["doc_id"] in first])
    assert sorted((str(r["doc_id"]), r["text"]) for r in stages[2]) == left and len(left) < len(stages[1])


def words(text):
    return re.findall(r"[^\W_]+", unicodedata.normalize("NFC", text).lower())


def test_decontamination_stage_drops_covered_items(spark, stages):
    items = [words(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = []
    for r in stages[2]:
        own = words(r["text"])
        seeds = {tuple(own[i : i + 5]) for i in range(len(own) - 4)}
        close = [w for w in items if any(tuple(w[i : i + 5]) in seeds for i in range(len(w) - 4))]
        if not any(sum(brute_tiles(w, own, 5)) >= 0.5 * len(w) for w in close):
            want.append(r["doc_id"])
    assert ids(stages[3]) == sorted(want) and len(want) < len(stages[2])


def test_secret_stage_keeps_documents_without_their_secrets(stages):
    before = {r["doc_id"]: r for r in stages[3]}
    assert ids(stages[4]) == ids(stages[3])
    changed = 0
    for r in stages[4]:
        assert r["text"] == secrets.redacted(before[r["doc_id"]]["text"]) and r["n_chars"] == len(r["text"]) and secrets.base_spans(r["text"]) == []
        changed += r["text"] != before[r["doc_id"]]["text"]
    assert changed


def test_mixing_stage_meets_targets(stages):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    totals = collections.Counter()
    for r in stages[4]:
        totals[r["source"]] += size(r["text"])
    taken = collections.Counter()
    for r in stages[5]:
        taken[r["source"]] += r["copies"] * size(r["text"])
        assert r["copies"] in (1, 2)
    for source, target in brute_targets(dict(totals)).items():
        assert taken[source] == best_taken([size(r["text"]) for r in stages[4] if r["source"] == source], target)


def test_run_gives_the_last_stage(spark, stages):
    assert sorted(map(str, corpus_pipeline.run(spark, SF).collect())) == sorted(map(str, stages[5]))


def odd_rows(spark):
    text = "some plain words that make a text of their own "
    rows = [(1, text, "en", "a", 1), (1, text, "en", "a", 1), (None, text, None, None, None), (2, None, "en", "b", 0), (3, "", None, "b", 0), (4, text * 3000, "en", "a", 9), (5, 'password = "abcdefabcdef12"', "en", "c", 2)]
    return spark.createDataFrame([(*r, "x", 7) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, _key string, copies long")


def test_stages_take_nulls_ties_long_texts_and_clashing_columns(spark):
    docs = odd_rows(spark)
    for name, f in corpus_pipeline.STAGES:
        out = f(spark, docs, SF)
        assert out.columns[: len(docs.columns)] == docs.columns, name
        assert out.count() <= docs.count()
        out = f(spark, docs.limit(0), SF)
        assert out.count() == 0
    one = corpus_pipeline.distinct_documents(spark, docs, SF).collect()
    assert sorted(str(r["doc_id"]) for r in one) == ["1", "2", "5"]  # null and empty texts are alike, and so is a text to itself many times over


def test_held_out_rule_is_one_in_three(spark):
    n = spark.range(3000).where(id_remainder(F.col("id"), 3) == 1).count()
    assert 900 < n < 1100
