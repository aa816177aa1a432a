from __future__ import annotations

import itertools

import numpy as np
import pytest

import corpus_pipeline
from risklake.llm import quality, toxicity
from risklake.llm.queries import ORACLE_SQL, QUERIES
from tests.llm import fixtures as fx

SF, SF2 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def test_base_counts(spark):
    docs = fx.awkward_docs()
    rows = quality.quality_scores(fx.clashing(spark.createDataFrame(docs, fx.SCHEMA)), quality.PRIOR).collect()
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows), key=repr)
    assert got == sorted(((d[0], *fx.base_quality(d[1])) for d in docs), key=repr)
    assert not any(r.kept and r.base_failed for r in rows)
    kept = quality.quality_keep(spark.createDataFrame(docs, fx.SCHEMA), quality.PRIOR).collect()
    assert sorted((r.doc_id for r in kept), key=repr) == sorted((r.doc_id for r in rows if r.kept), key=repr)
    assert quality.quality_scores(spark.createDataFrame([], fx.SCHEMA), quality.PRIOR).count() == 0


def test_viterbi_equals_enumeration():
    rng = np.random.default_rng(5)
    for n in range(1, 9):
        features = rng.normal(size=(n, len(quality.FEATURES)))
        model = quality.ChainField(tuple(rng.normal(size=len(quality.FEATURES))), 0.7)
        score = features @ np.array(model.emit)
        value = lambda y: sum(s for s, b in zip(score, y) if b) + model.stay * sum(a == b for a, b in zip(y, y[1:]))  # noqa: B023, E731
        assert tuple(model.decode(features)) == max(itertools.product([False, True], repeat=n), key=value)


def test_field_learns_quality(spark):
    docs, labels = spark.read.parquet(f"{SF2}/documents.parquet"), spark.read.parquet(f"{SF2}/labels.parquet")
    model = quality.fit_field(docs, labels)
    rows = quality.quality_scores(docs, model).join(labels, "doc_id").where("not base_failed").collect()
    assert np.mean([r.kept == bool(r.quality) for r in rows]) > 0.95
    assert np.mean([r.kept for r in rows if r.quality]) > 0.99
    assert quality.fit_field(docs, labels.limit(0)) == quality.PRIOR


def test_toxicity_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF2}/documents.parquet"), spark.read.parquet(f"{SF2}/labels.parquet")
    rows = QUERIES["op9_toxicity"](spark, SF2).join(labels, "doc_id").where("held_out").collect()
    right = np.mean([r.predicted == r.toxic for r in rows])
    assert right > 1 - np.mean([r.toxic for r in rows])
    model = toxicity.fit_distance(docs, labels)
    odd = toxicity.toxicity(fx.clashing(spark.createDataFrame(fx.awkward_docs(), fx.SCHEMA)), model).collect()
    assert len(odd) == len(fx.awkward_docs()) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in odd)
    # labels of the held-out fold are never read: turning them round changes nothing
    turned = labels.withColumn("toxic", __import__("pyspark.sql.functions", fromlist=["when"]).when(toxicity.held_out(labels.doc_id), 1 - labels.toxic).otherwise(labels.toxic))
    assert toxicity.fit_distance(docs, turned) == model
    assert toxicity.fit_distance(docs, labels.limit(0)) is None
    assert toxicity.toxicity(docs.limit(0), model).count() == 0


def test_toxic_words_of_a_rare_language(spark):
    # a language with a tenth of the toxic texts has its own markers: words and a stem that never stands alone
    def text(i):
        rng = __import__("random").Random(i)
        rare = i % 10 == 0
        body = fx.phrase(rng, 60) if not rare else " ".join(f"v{rng.randrange(400)}" for _ in range(60))
        toxic = i % 4 == 0
        return body + ((f" qrelleux{rng.choice('abcdefghij')}{rng.choice('abcdefghij')}" if rare else " " + rng.choice(["gemeinword", "vulgarterm"])) if toxic else ""), int(toxic), rare

    rows = [(i, *text(i)) for i in range(3000)]
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in rows], "doc_id long, text string")
    model = toxicity.fit_distance(docs, spark.createDataFrame([(i, y) for i, _, y, _ in rows], "doc_id long, toxic int"))
    assert b"vulgarterm" in model.toxic and b"qrelleu" in model.toxic and b"qrelleu" not in model.ordinary
    got = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, model).where("held_out").collect()}
    rare = [got[i] for i, _, y, is_rare in rows if i in got and y and is_rare]
    assert len(rare) > 10 and np.mean(rare) > 0.9
    assert np.mean([got[i] for i, _, y, _ in rows if i in got and not y]) < 0.02


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")


def test_pipeline_equals_plain_version(spark, small):
    docs, labels, items = small
    model = quality.fit_field(docs, labels)
    kept = {r.doc_id for r in quality.quality_scores(docs, model).where("kept").collect()}
    rows = {r.doc_id: r for r in docs.collect() if r.doc_id in kept}
    left = fx.fuzzy_lines([(i, r.text) for i, r in rows.items()], 0.8)
    heads = {}
    for (i, t), (_, c) in zip(left, fx.near_classes(left)):
        heads[c] = min(heads.get(c, (i, t)), (i, t))
    table = spark.createDataFrame([(i, t, rows[i].lang, rows[i].source, rows[i].n_chars) for i, t in heads.values()], fx.SCHEMA)
    clean = {r[0] for r in fx.duck(documents=table, benchmark=items).execute(ORACLE_SQL["op5_decontaminate"]).fetchall() if not r[-1]}
    want = fx.duck(documents=table.where(table.doc_id.isin(clean))).execute(ORACLE_SQL["op3_mix_sources"]).fetchall()
    assert fx.rows_of(corpus_pipeline.run(spark, SF)) == sorted(want, key=repr)


def test_stages_on_awkward_rows(spark, small):
    docs = spark.createDataFrame(fx.awkward_docs(), fx.SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, fx.clashing(docs), SF)
        assert docs.columns == corpus_pipeline.COLUMNS
    assert corpus_pipeline.mixing(spark, docs, SF).count() == docs.count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], fx.SCHEMA), SF).count() == 0


def test_fit_reads_runs_of_lines_from_any_part_of_a_text():
    starts = [quality.seeded_start(i, 400) for i in range(300)]
    assert min(starts) < 20 and max(starts) > 340 and max(starts) <= 400 - quality.FIT_LINES and starts == [quality.seeded_start(i, 400) for i in range(300)]
    assert quality.seeded_start(7, quality.FIT_LINES) == 0 and quality.seeded_start(7, 0) == 0
