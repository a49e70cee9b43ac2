"""The pipeline, stage by stage, against the operators' decisions."""

import random

import numpy as np
from test_jaccard import brute, closure, family

import corpus_pipeline as C
from cellcast.llm import cotraining, quality_rules, secret_ledger
from cellcast.llm.common import documents, written


def test_stages_on_the_driver_tables(spark, small_dir):
    docs = documents(spark, small_dir)
    columns = docs.columns
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}

    kept = written(C.quality_classifier(spark, docs, small_dir), "t")
    labels = spark.read.parquet(f"{small_dir}/labels.parquet")
    assert kept.columns == columns and ids(kept) == ids(cotraining.score(docs, labels).filter("kept"))

    voted = written(C.quality_rule_votes(spark, kept, small_dir), "t")
    assert voted.columns == columns and ids(voted) == ids(quality_rules.score(kept).filter("kept"))

    single = written(C.near_duplicates(spark, voted, small_dir), "t")
    rows = [(r["doc_id"], r["text"]) for r in voted.collect()]
    assert single.columns == columns and ids(single) == _first_ids(rows)

    clean = written(C.secret_scan(spark, single, small_dir), "t")
    assert clean.columns == columns and ids(clean) == ids(single)
    assert secret_ledger.scan(clean).filter("size(secrets) > 0").count() == 0
    assert clean.filter("n_chars <> length(text)").count() == 0

    packed = C.packing(spark, clean, small_dir).collect()
    total: dict = {}
    for r in packed:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + len(np.frombuffer(r["ids"], "<u4"))
    assert set(total) == ids(clean) and all(total[r["doc_id"]] == r["doc_tokens"] for r in packed)
    assert C.run(spark, small_dir).count() == len(packed)


def test_odd_rows_pass_through(spark, odd, small_dir):
    docs = odd
    for _, stage in C.STAGES[:-1]:
        docs = written(stage(spark, docs, small_dir), "t")
        assert docs.columns == odd.columns
    C.packing(spark, docs, small_dir).collect()


def test_empty_documents(spark, none, small_dir):
    docs = none
    for _, stage in C.STAGES:
        docs = written(stage(spark, docs, small_dir), "t")
        assert docs.count() == 0


def _five_word_sets(rows):
    words = [(t or "").encode().lower().split() for _, t in rows]
    return [frozenset([tuple(w)]) if 0 < len(w) < 5 else frozenset(zip(w, w[1:], w[2:], w[3:], w[4:])) for w in words]


def _first_ids(rows):
    """Smallest id of every group at five words and 80 per cent, by all pairs."""
    sets = _five_word_sets(rows)
    root = closure(range(len(rows)), [
        (x, y) for x in range(len(rows)) for y in range(x)
        if sets[x] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y])
    ])
    return {min(rows[y][0] for y in range(len(rows)) if root[y] == root[x]) for x in range(len(rows))}


def test_near_duplicates_at_five_words_and_80_per_cent(spark, small_dir):
    """Copies between the thresholds of op10 and of the stage are near duplicates too."""
    rng = random.Random(5)
    texts = [t for n, c, e in ((60, 10, 3), (120, 20, 5), (300, 10, 12)) for t in family(rng, n, c, e)]
    rows = [(i, t) for i, t in enumerate(texts)]
    threes = {c for _, _, c in brute(rows)[0]}
    assert _first_ids(rows) < threes
    out = C.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), small_dir)
    assert {r["doc_id"] for r in out.collect()} == _first_ids(rows)


def test_near_duplicates_of_the_driver_tables(spark, small_dir):
    docs = documents(spark, small_dir)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = {r["doc_id"] for r in C.near_duplicates(spark, docs, small_dir).select("doc_id").collect()}
    assert got == _first_ids(rows) and len(got) == 187
