"""Quality rules and the co-trained classifier."""

import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from cellcast.llm import cotraining, quality_rules


def plain_counts(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    windows = list(zip(words, words[1:], words[2:]))
    count = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered),
    )


def test_counts_equal_the_definition(odd, odd_rows):
    rows = quality_rules.score(odd).collect()
    assert len(rows) == len(odd_rows)
    for r in rows:
        want = plain_counts(r["text"])
        assert tuple(r["features"])[:5] == want
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert r["base_failed"] == failed and not (failed and r["kept"])


def test_votes_find_the_planted_classes():
    rng = np.random.default_rng(0)
    good = rng.random(4000) < 0.8
    hit = [0.4, 0.5, 0.3, 0.6]
    patterns = np.array([np.where(good, -1 * (rng.random(4000) < 0.004), -1 * (rng.random(4000) < h)) for h in hit]).T.astype(int)
    seen, counts = np.unique(patterns, axis=0, return_counts=True)
    prior, table = quality_rules.fit_votes(seen, counts.astype(float), np.ones(4, bool))
    assert abs(prior - 0.8) < 0.08
    assert (table[1][:, 0] <= quality_rules.MAX_FALSE_ALARM + 1e-12).all() and (table[0][:, 0] > 0.2).all()
    assert quality_rules.posterior(np.array([[0, 0, 0, 0], [-1, -1, 0, 0]]), prior, table).round().tolist() == [1, 0]


def test_spark_posterior_is_the_fitted_one(spark, small_dir):
    rows = quality_rules.score(spark.read.parquet(f"{small_dir}/documents.parquet")).collect()
    patterns = np.array([r["votes"] for r in rows])
    seen, counts = np.unique(patterns, axis=0, return_counts=True)
    warns = np.array([n not in ("symbols", "symbol_words", "sentences") for n in quality_rules.RULES])
    want = quality_rules.posterior(patterns, *quality_rules.fit_votes(seen, counts.astype(float), warns))
    assert np.allclose([r["posterior"] for r in rows], want, atol=1e-6)


def test_rules_agree_with_labels(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    labels = spark.read.parquet(f"{small_dir}/labels.parquet")
    rows = quality_rules.score(docs).join(labels, "doc_id").collect()
    assert all(r["kept"] for r in rows if r["quality"] == 1 and not r["base_failed"])


def test_classifier_on_rows_it_did_not_see(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    taught, held = labels.filter("doc_id % 4 <> 0"), labels.filter("doc_id % 4 = 0")
    rows = cotraining.score(docs, taught).join(held, "doc_id").collect()
    right = sum(r["kept"] == (r["quality"] == 1) for r in rows) / len(rows)
    lost = sum(not r["kept"] for r in rows if r["quality"] == 1)
    assert right > 0.95 and lost <= 1


def test_classifier_on_odd_rows(spark, odd, odd_rows):
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(20)] + [(None, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    out = cotraining.score(odd, labels)
    rows = out.collect()
    assert len(rows) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in rows)
    assert [c for c in out.columns if c.lower() == "score"] == ["score"]


def test_without_labels_all_is_kept(odd, odd_rows, spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert cotraining.score(odd, none).filter((F.col("score") == 0.5) & F.col("kept")).count() == len(odd_rows)


def test_empty_tables(spark, none):
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, quality int")
    assert quality_rules.score(none).count() == 0
    assert cotraining.score(none, labels).count() == 0
