import os

import numpy as np
from pyspark.sql import functions as F

from quire.operators import ml as ML
from quire.operators.encode import HashingEncoder, embed_with_cache
from quire.sources import sinks
from quire.streaming.incremental import index_new_articles


def test_embedding_cache_encodes_only_missing(spark, tmp_dir):
    enc = HashingEncoder(16)
    ents = spark.createDataFrame([("a", "alpine hiking"), ("b", "spa day"), ("c", "")], "k string, t string")
    allv, fresh = embed_with_cache(ents.filter("k = 'a'"), "k", "t", None, enc)
    p = os.path.join(tmp_dir, "emb")
    sinks.save_embeddings(fresh, p, "k")
    cache = spark.read.parquet(p)
    allv, fresh = embed_with_cache(ents, "k", "t", cache, enc)
    assert sorted(r.k for r in fresh.collect()) == ["b", "c"]
    got = {r.k: r.embedding for r in allv.collect()}
    assert set(got) == {"a", "b", "c"} and np.linalg.norm(got["c"]) == 0
    # another encoder: nothing in the cache is reusable
    _, fresh2 = embed_with_cache(ents, "k", "t", cache, HashingEncoder(8))
    assert fresh2.count() == 3


def test_model_store_and_experiment_log(spark, tmp_dir):
    rows = [(i, "a" if i % 2 else "b", float(i % 2) + 0.1 * (i % 5)) for i in range(40)]
    df = ML.index_labels(spark.createDataFrame(rows, "id long, label string, x double"), "label", ["a", "b"]) \
        .withColumn("weight", F.lit(1.0))
    model = ML.build_pipeline("LogisticRegression", ["x"], ["a", "b"], 40).fit(df)
    root = os.path.join(tmp_dir, "models")
    sinks.save_model(model, os.path.join(root, "RandomForest_phase2a_v1"))
    name, loaded = sinks.load_first_model(spark, root, ["GradientBoosting_phase2b_v1", "RandomForest_phase2a_v1"])
    assert name == "RandomForest_phase2a_v1"
    assert ML.predict(loaded, df).filter("predicted_label = label").count() >= 36
    assert sinks.load_first_model(spark, os.path.join(tmp_dir, "none"), ["x"]) == (None, None)
    log = os.path.join(tmp_dir, "results")
    summary = {"accuracy_mean": 0.91234, "accuracy_std": 0.01, "f1_macro_mean": 0.9, "f1_macro_std": 0.02}
    for _ in range(2):
        sinks.append_experiment(ML.experiment_row(spark, "LogisticRegression", {"C": 1.0}, summary,
                                                  {"a": {"f1": 0.9}}), log)
    r = spark.read.parquet(log).collect()
    assert len(r) == 2 and r[0].accuracy_mean == 0.9123 and '"C": 1.0' in r[0].params


def test_incremental_indexing_replaces_source(spark, tmp_dir):
    schema = "destination string, understand string, do string, sleep string, full_text string"
    src, idx, ck = (os.path.join(tmp_dir, x) for x in ("in", "idx", "ck"))
    long = "Mountain trails and glacier walks for every level of hiker. "
    spark.createDataFrame([("A", long, "", "", ""), ("B", long, long, "", "")], schema) \
        .write.parquet(os.path.join(src, "w1"))
    sch = spark.read.parquet(os.path.join(src, "w1")).schema
    enc = HashingEncoder(32)
    index_new_articles(spark, os.path.join(src, "*"), sch, idx, ck, enc)
    assert sinks.read_chunks(spark, idx).count() == 3
    # B is re-sent with one section only: its old chunks are replaced, A stays
    spark.createDataFrame([("B", long, "", "", "")], schema).write.parquet(os.path.join(src, "w2"))
    index_new_articles(spark, os.path.join(src, "*"), sch, idx, ck, enc)
    got = sorted((r.source_document, r.chunk_index) for r in sinks.read_chunks(spark, idx).collect())
    assert got == [("wikivoyage:A", 0), ("wikivoyage:B", 0)]
    # a batch of articles that are empty now does not stop the stream
    spark.createDataFrame([("B", "", "", "", "")], schema).write.parquet(os.path.join(src, "w3"))
    index_new_articles(spark, os.path.join(src, "*"), sch, idx, ck, enc)
    assert [r.source_document for r in sinks.read_chunks(spark, idx).collect()] == ["wikivoyage:A"]


def test_tune_single_cross_validator(spark):
    from quire.operators import split as SP
    rng = np.random.default_rng(3)
    rows = [(i, "a" if i % 2 else "b", float(i % 2) + rng.normal() * 0.3) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, label string, x double")
    df = SP.stratified_folds(df, "label", "id", k=3)
    df = ML.index_labels(df, "label", ["a", "b"]).withColumn("weight", F.lit(1.0))
    best, score = ML.tune(df, "RandomForest", ["x"], ["a", "b"], {"n_estimators": [5, 10], "max_depth": [None, 2]})
    assert set(best) == {"n_estimators", "max_depth"} and 0.5 < score <= 1.0
    best, score = ML.tune(df, "LogisticRegression", ["x"], ["a", "b"], {"C": [0.01, 1.0]})
    assert best["C"] in (0.01, 1.0) and score > 0.6


def test_language_model_beats_majority_class(spark):
    from conftest import SF_SMALL
    from quire.plans import catalog as CA
    from quire.plans.experiment import run_experiment
    f, cols = CA.lang_features(spark, SF_SMALL)
    res = run_experiment(f, cols, "lang", "doc_id", CA.LANG_LABELS, models=["LogisticRegression"])
    run = res["runs"].first()
    counts = [r["count"] for r in f.groupBy("lang").count().collect()]
    assert run.accuracy_mean > max(counts) / sum(counts) + 0.1
    assert {r.model_name for r in res["log"].collect()} == {"LogisticRegression_phasea",
                                                           "LogisticRegression_phasea_WINNER"}


def test_stream_answers_equal_batch_answers(spark):
    from conftest import SF_SMALL
    from quire.plans import catalog as CA
    key = lambda df: {(r.request_id, r.predicted_style, r.chunks_retrieved, r.no_hits) for r in df.collect()}
    batch, stream = key(CA.batch_answers(spark, SF_SMALL)[0]), key(CA.stream_answers(spark, SF_SMALL)[0])
    assert batch == stream and len(batch) > 0


def test_answers_and_classes_are_whole(spark):
    from conftest import SF_SMALL
    from quire.plans import catalog as CA
    q = CA.QUERIES
    styles = q["classify_queries"](spark, SF_SMALL).collect()
    assert {r.predicted_style for r in styles} <= set(CA.LANG_LABELS) and all(0 < r.style_confidence <= 1 for r in styles)
    answers = q["answer_requests"](spark, SF_SMALL).collect()
    done = [r for r in answers if r.status == "completed"]
    assert done and all(len(r.prompt) == r.prompt_chars > 0 and r.response and r.no_hits == (r.chunks_retrieved == 0) for r in done)
    assert all(r.predicted_style in CA.LANG_LABELS and 0 <= r.chunks_retrieved <= CA.C.DEFAULT_TOP_K for r in done)
    assert all(r.reason and r.response is None for r in answers if r.status != "completed")


def test_components_are_centred_and_descend(spark):
    from conftest import SF_SMALL
    from quire.plans import catalog as CA
    rows = [r for r in CA.QUERIES["embedding_pca"](spark, SF_SMALL).collect() if r.split == "train"]
    x = np.array([[r[f"emb_pca_{i}"] for i in range(CA.C.PCA_COMPONENTS)] for r in rows])
    assert np.abs(x.mean(axis=0)).max() < 1e-6 and (np.diff(x.var(axis=0)) < 1e-9).all()
    assert 0 < rows[0].explained_variance <= 1


def test_experiments_with_three_families(spark):
    """One comparison: its report, its log and the model that is found again."""
    from conftest import SF_SMALL
    from quire.plans import catalog as CA
    log = CA.QUERIES["experiment_log"](spark, SF_SMALL).collect()
    assert {r.model_name for r in log if not r.model_name.endswith("_WINNER")} == {f"{m}_phasea" for m in ML.MODEL_NAMES}
    winner = [r for r in log if r.model_name.endswith("_WINNER")]
    assert len(winner) == 1 and winner[0].restored and all(0.5 < r.f1_mean <= 1 for r in log)
