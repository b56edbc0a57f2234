"""The pipeline's stages against what they must keep."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from cladelake.llm import decontamination, mixing, shared, simhash, toxicity


def test_stages_and_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs.count()
    for name, stage in cp.STAGES[:-1]:
        after = stage(spark, docs, sf)
        assert after.columns == docs.columns
        n = after.count()
        assert 0.6 * before < n <= before, name
        docs, before = spark.createDataFrame(after.toArrow().to_pandas(), docs.schema), n
    got = cp.STAGES[-1][1](spark, docs, sf).toPandas()
    assert sorted(got.doc_id) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    want = mixing.mix(docs).toPandas().set_index("doc_id").taken
    assert (got.set_index("doc_id").taken.sort_index() == want.sort_index()).all()


def test_run_is_its_stages_one_after_another(spark, sf, tmp_path):
    """run() against stages whose decisions are taken apart: scores, predictions, groups and hits joined by id."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert docs.select("doc_id").distinct().count() == docs.count()
    labels = spark.read.parquet(f"{sf}/labels.parquet").where(~shared.is_remainder("doc_id", 4, 2))
    left = docs.toPandas()
    keep = lambda ids: left[left.doc_id.isin(ids)]
    again = lambda: spark.createDataFrame(left, docs.schema)
    left = keep(toxicity.score(docs, toxicity.train(docs, labels)).where("score < 0.3").toPandas().doc_id)
    left = keep([d for d, t in zip(left.doc_id, left["text"]) if any(c.isalpha() for c in t or "")])
    groups = simhash.near_duplicates(again()).toPandas()
    left = keep(groups.groupby("component_id").doc_id.min())
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    left = keep(decontamination.search(again(), bench).where("n_hit = 0").toPandas().doc_id)
    want = mixing.mix(again()).toPandas().sort_values("doc_id")
    got = cp.run(spark, sf).toPandas().sort_values("doc_id")
    assert 0 < len(got) < docs.count()
    assert got.doc_id.tolist() == want.doc_id.tolist() and got.taken.tolist() == want.taken.tolist() and got.target.tolist() == want.target.tolist()


def test_stages_keep_columns_whose_names_are_outputs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumns({c: F.concat(F.lit(c), F.col("doc_id")) for c in ("score", "predicted", "lang_pred", "simhash", "n_hit", "root", "id_", "text_")})
    for name, stage in cp.STAGES[:-1]:
        got = stage(spark, docs, sf)
        assert got.dtypes == docs.dtypes and got.count() > 0
        assert got.where("score <> concat('score', doc_id) or n_hit <> concat('n_hit', doc_id) or root <> concat('root', doc_id)").count() == 0, name


def test_dedup_keeps_one_of_each_group(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = cp.stage_near_dedup(spark, docs, sf)
    want = {r[0] for r in simhash.near_duplicates(docs).select("component_id").distinct().collect()}
    assert {r[0] for r in kept.select("doc_id").collect()} == want and kept.count() == len(want)


def test_dedup_of_repeats_and_missing_ids(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    rows = [(5, "one text of several words here", "en", "a", 1)] * 2 + [(3, "one text of several words here", "en", "b", 1), (None, "another one without any id at all", "en", "a", 1), (None, "another one without any id at all", "en", "a", 1), (None, "one text of several words here", "en", "a", 1), (9, "quite different from all of the others", "fr", None, None), (9, "quite different from all of the others", "fr", None, None)]
    kept = cp.stage_near_dedup(spark, spark.createDataFrame(rows, schema), "")
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == ["3", "9", "None"]


def test_dedup_tells_documents_with_one_id_apart(spark):
    """An id that stands for two texts: the group it leads must not go with the group it is a copy in."""
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    a, b = "the first of two texts under one id", "and the second which has nothing in common"
    rows = [(5, a, "en", "x", 1), (9, a, "en", "x", 2), (5, b, "en", "x", 3), (3, b, "en", "x", 4), (7, a + " " + b, "en", "x", 5), (7, b + " then " + a, "en", "x", 6)]
    kept = cp.stage_near_dedup(spark, spark.createDataFrame(rows, schema), "")
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted([(5, a), (3, b), (7, a + " " + b), (7, b + " then " + a)])


def test_decontamination_drops_hits_only(spark, sf):
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    hit = {r[0] for r in decontamination.search(docs, bench).where("n_hit > 0").select("doc_id").collect()}
    kept = {r[0] for r in cp.stage_decontaminate(spark, docs, sf).select("doc_id").collect()}
    assert hit and kept == {r[0] for r in docs.select("doc_id").collect()} - hit


@pytest.mark.parametrize("name,stage", cp.STAGES)
def test_stages_take_odd_and_empty_tables(spark, sf, name, stage):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("score", F.lit("x")).withColumn("simhash", F.lit(1))
    odd = docs.limit(30).union(docs.limit(5)).union(docs.limit(3).select(*[F.lit(None).cast(t).alias(c) for c, t in docs.dtypes]))
    assert stage(spark, odd, sf).count() > 0
    assert stage(spark, docs.where("false"), sf).count() == 0


def test_language_stage_without_a_model_keeps_texts_with_letters(spark, sf):
    docs = spark.createDataFrame([(1, "plain words", None), (2, "123 !", None), (3, None, None), (4, "\u00e9", None)], "doc_id bigint, text string, lang string")
    assert sorted(r.doc_id for r in cp.stage_language(spark, docs, sf).collect()) == [1, 4]
