"""The pipeline's stages against brute force, and on null, empty, repeated and clashing rows."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P

SF = "/root/testdata/sf0.001"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def text(seed, n=30):
    return " ".join(WORDS[(seed * 7 + i * i * (seed + 3)) % len(WORDS)] + str(seed) for i in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, text(1), "en", "a", 5), (1, text(1), "en", "a", 5), (2, text(1), None, None, None),
            (3, text(2), "en", "b", 7), (None, text(3), "en", "b", 7), (None, text(3), "en", "b", 7), (4, None, "en", "c", 1),
            (5, "", "de", "c", 0), (6, text(6, 20_000), "en", "c", 9), (3, text(4), "en", "z", 7), (7, text(4), "en", "z", 7)]
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)],
                                 "doc_id long, text string, lang string, source string, n_chars long, score int")


def test_stage_columns_and_empty_tables(spark, odd):
    none = odd.limit(0)
    for name, stage in P.STAGES[:-1]:
        for docs in (odd, none):
            assert stage(spark, docs, SF).columns == odd.columns, name
        assert stage(spark, none, SF).count() == 0
    assert P.packing(spark, none, SF).count() == 0


def test_near_duplicates_keeps_one_of_each_group(spark, odd):
    left = sorted((r.doc_id is None, r.doc_id or 0, (r.text or "")[:12], r.source)
                  for r in P.near_duplicates(spark, odd, SF).collect())
    # 1, 1 and 2 are copies; doc 3 holds two texts, of which text(4) is doc 7's as well; null ids are copies; 4 and 5 are
    # both without words
    assert [x[:2] for x in left] == [(False, 1), (False, 3), (False, 3), (False, 4), (False, 6), (True, 0)]
    assert {x[2] for x in left if x[1] == 3} == {text(2)[:12], text(4)[:12]}


def test_clean_documents_stay_and_decisions_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()
    kept = {r.doc_id for r in P.toxicity(spark, docs, SF).collect()}
    assert len(kept) > 0.5 * len(rows)
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaked = {r.doc_id for r in rows if any(i in (r.text or "") for i in items)}
    clean = {r.doc_id for r in P.decontamination(spark, docs, SF).collect()}
    assert clean == {r.doc_id for r in rows} - leaked


def test_decontamination_judges_every_row(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    rows = [(None, item), (None, "clean"), (1, item), (1, "clean too"), (2, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, P.decontamination(spark, docs, SF).collect()), key=str) == sorted(
        [rows[i] for i in (1, 3, 4, 5)], key=str)


def test_run_is_the_stages_in_order(spark):
    out = P.run(spark, SF)
    whole = out.groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("t"))
    assert whole.where("n <> t").count() == 0
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    assert sorted(r.doc_id for r in docs.collect()) == sorted(r.doc_id for r in whole.collect())


def test_toxicity_works_on_bounded_text():
    """Scores of many texts hold about a million characters' work at once and don't depend on how they are dealt."""
    import tracemalloc

    import numpy as np

    from tabwright.llm import toxicity_nb as t
    texts = [f"word{i} and others " * 600 for i in range(400)]
    dense = np.random.default_rng(5).normal(0, 0.01, 1 << t.BITS).astype(np.float32)
    alone = [t._scores([x], dense, 0.1)[0] for x in texts[::50]]
    tracemalloc.start()
    try:
        got = t._scores(texts, dense, 0.1)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert got[::50].tolist() == alone
    assert peak < 60e6
