import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire import constants as C
from quire.operators import ml as ML
from quire.operators.encode import HashingEncoder, PandasEncoder, encode_nonempty
from quire.operators.relational import first_per_key, keyed_concat, lookup_with_default, orphans
from quire.operators.serving import check_tables
from quire.operators.validate import check_matrix, matrix_report
from quire.plans.answer import answer_requests, run_records
from quire.operators.search import check_encoder
from quire.plans.index import build_index
from quire.sources import sinks
from quire.sources.tables import read_articles, read_entities, read_feature_matrix, unpack_envelope
from quire.streaming.incremental import process_new, read_output


def test_read_entities_csv_with_schema(spark, tmp_dir):
    p = os.path.join(tmp_dir, "e.csv")
    with open(p, "w") as f:
        f.write('destination_name,country,region,travel_style_label,wikivoyage_url\n'
                'Sa Pa,Vietnam,Southeast Asia,Culture,https://x/Sa_Pa\n'
                '"Quebec, City",Canada,North America,Culture,https://x/Q\n')
    df = read_entities(spark, p)
    rows = df.orderBy("ord").collect()
    assert [r.destination_name for r in rows] == ["Sa Pa", "Quebec, City"]
    assert dict(df.dtypes)["region"] == "string"


def test_feature_matrix_csv_round_trip(spark, tmp_dir):
    from quire.schemas import feature_columns
    cols = feature_columns()
    row = [0] * 12 + [0.0] * 6 + [2] + [0] * 18 + ["X", "Culture"]
    df = spark.createDataFrame([tuple(row)], [*cols, "destination_name", "label"])
    p = os.path.join(tmp_dir, "features")
    sinks.write_csv(df, p)
    back = read_feature_matrix(spark, p)
    assert back.columns == [*cols, "destination_name", "label"] and back.first().price_tier == 2


def test_read_articles_missing_keys(spark, tmp_dir):
    d = os.path.join(tmp_dir, "cache")
    os.makedirs(d)
    with open(os.path.join(d, "v1_abc.json"), "w") as f:
        json.dump({"title": "A", "understand": "u", "full_text": "ft"}, f, indent=2)
    r = read_articles(spark, d, one_per_file=True).first()
    assert r.do == "" and r.sleep == "" and r.cache_key == "v1_abc.json"


def test_unpack_envelope(spark):
    ok = {"query": {"pages": [{"title": "T", "revisions": [{"slots": {"main": {"content":
          "==Understand==\nnice\n==Do==\nhike\n==Sleep==\nbed"}}}]}]}}
    rows = [("a", json.dumps(ok)), ("b", json.dumps({"query": {"pages": [{"missing": True}]}})),
            ("c", json.dumps({"query": {"pages": []}}))]
    out = {r.k: r for r in unpack_envelope(spark.createDataFrame(rows, "k string, body string")).collect()}
    assert (out["a"].understand, out["a"].do, out["a"].sleep) == ("nice", "hike", "bed")
    assert out["b"].understand == "" and out["b"].is_empty_article and out["c"].is_empty_article


def test_relational_helpers(spark):
    a = spark.createDataFrame([(1, "x", 5), (1, "y", 3), (2, "z", 1)], "k int, v string, o int")
    assert {(r.k, r.v) for r in first_per_key(a, "k", "o").collect()} == {(1, "y"), (2, "z")}
    b = spark.createDataFrame([(1, 10)], "k int, w int")
    got = {r.k: r.w for r in lookup_with_default(a.select("k").distinct(), b, "k", {"w": -1}).collect()}
    assert got == {1: 10, 2: -1}
    with pytest.raises(ValueError):
        keyed_concat(a, b, "k")
    both = {r.k: (r.v, r.w) for r in keyed_concat(a.filter("o = 1"), b, "k").collect()}
    assert both == {2: ("z", None), 1: (None, 10)}      # no row is lost
    assert [r.k for r in orphans(a.select("k").distinct(), b, "k", "k").collect()] == [2]


def test_write_chunks_modes(spark, tmp_dir):
    p = os.path.join(tmp_dir, "index")
    mk = lambda src, n: spark.createDataFrame(
        [(f"{src}{i}", src, i) for i in range(n)], "chunk_id string, source_document string, chunk_index int")
    sinks.write_chunks(mk("A", 2), p, "append")
    sinks.write_chunks(mk("A", 2), p, "append")
    assert sinks.chunk_count(spark, p) == 4        # original behaviour: re-run duplicates
    sinks.write_chunks(mk("A", 1).unionByName(mk("B", 2)), p, "replace_source")
    assert sinks.chunk_count(spark, p) == 3
    # a source without chunks any more loses its old ones, alone or beside another
    gone = spark.createDataFrame([("A",), ("B",)], "source_document string")
    sinks.write_chunks(mk("A", 0), p, "replace_source", sources=gone.filter("source_document = 'A'"))
    assert sinks.chunk_count(spark, p) == 2
    sinks.write_chunks(mk("A", 3), p, "replace_source", sources=gone)
    assert [r.source_document for r in sinks.read_chunks(spark, p).collect()] == ["A"] * 3
    assert [f for f in os.listdir(tmp_dir) if "staging" in f] == []
    sinks.write_chunks(mk("C", 1), p, "overwrite")
    assert sinks.chunk_count(spark, p) == 1


def test_check_tables_never_raises(spark, tmp_dir):
    p = os.path.join(tmp_dir, "t")
    spark.range(3).write.parquet(p)
    r = {x.table: x for x in check_tables(spark, {"good": p, "bad": os.path.join(tmp_dir, "nope")}).collect()}
    assert r["good"].status == "ok" and r["good"].n == 3 and r["bad"].status.startswith("error")


def test_matrix_rules(spark):
    df = spark.createDataFrame([(1.0, "Culture")] * 60 + [(None, "Luxury")], "x double, label string")
    r = matrix_report(df).first()
    assert r.has_nulls and not r.ok and "Adventure" in r.missing_labels
    with pytest.raises(ValueError):
        check_matrix(df)


def test_encoders(spark):
    df = spark.createDataFrame([(1, "Hiking in the Alps"), (2, ""), (3, None)], "id int, t string")
    out = {r.id: r for r in encode_nonempty(df, HashingEncoder(32), "t").collect()}
    assert abs(np.linalg.norm(out[1].embedding) - 1) < 1e-6 and out[1].has_text
    assert not out[2].has_text and np.linalg.norm(out[2].embedding) == 0 and len(out[3].embedding) == 32

    def factory():
        def enc(texts):
            v = np.array([[len(t), 1.0] for t in texts])
            return v / np.linalg.norm(v, axis=1)[:, None]
        return enc
    pe = PandasEncoder(factory, 2, "len-v1")
    r = {x.id: x.embedding for x in pe.transform(df, "t").collect()}
    assert len(r[1]) == 2 and r[2] == [0.0, 0.0]


def test_standardizer_population_std(spark):
    df = spark.createDataFrame([([1.0, 5.0],), ([2.0, 5.0],), ([3.0, 5.0],)], "v array<double>")
    st = {r.dim: r for r in ML.fit_standardizer_long(df, "v").collect()}
    assert abs(st[0].std - np.std([1, 2, 3])) < 1e-12 and st[1].std == 1.0


def test_pca_and_models(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(120):
        c = i % 3
        v = rng.normal(size=6) + np.eye(6)[c] * 3
        rows.append((i, ["a", "b", "c"][c], v.tolist(), float(v[0]), float(v[1]), float(v[2])))
    df = spark.createDataFrame(rows, "id long, label string, vec array<double>, f0 double, f1 double, f2 double")
    out, var = ML.add_pca_features(df, "vec", F.col("id") < 96, k=3)
    assert 0 < var <= 1 and {"emb_pca_0", "emb_pca_2"} <= set(out.columns)
    from quire.plans.experiment import prepare, run_experiment
    res = run_experiment(df, ["f0", "f1", "f2"], "label", "id", ["a", "b", "c"],
                         models=["LogisticRegression", "RandomForest"])
    runs = {r.model_name: r for r in res["runs"].collect()}
    assert runs["LogisticRegression"].f1_macro_mean > 0.6
    model = res["model"]
    scored = ML.predict(model, res["prepared"]).select("predicted_label").distinct().count()
    assert scored >= 2


def test_score_texts_without_model(spark):
    df = spark.createDataFrame([("q",)], "t string")
    r = ML.score_texts(df, "t", None).first()
    assert r.predicted_style == "Unknown" and r.style_confidence == 0.0


def test_index_answer_and_stream(spark, tmp_dir):
    arts = spark.createDataFrame([
        ("A", "Alpine hiking trails and glacier treks through the mountains. " * 2, "", "", ""),
        ("B", "Spa resorts, yoga retreats and thermal baths for relaxing days. " * 2, "", "", ""),
    ], "destination string, understand string, do string, sleep string, full_text string") \
        .withColumn("cache_key", F.col("destination"))
    ents = spark.createDataFrame([("A",), ("B",), ("Z",)], "cache_key string")
    enc = HashingEncoder(64)
    p = os.path.join(tmp_dir, "idx")
    res = build_index(ents, arts, enc, path=p)
    assert res["count"] == 2 and [r.cache_key for r in res["skipped"].collect()] == ["Z"]
    index = sinks.read_chunks(spark, p)
    check_encoder(index, enc)
    with pytest.raises(ValueError):
        check_encoder(index, HashingEncoder(32))
    req = spark.createDataFrame([("1", "hiking on a glacier", "s1"), ("2", "   ", None)],
                                "request_id string, message string, session_id string")
    resp, rej = answer_requests(req, index, enc, None)
    r = resp.first()
    assert r.predicted_style == "Unknown" and r.chunks_retrieved >= 1 and "[A - similarity:" in r.prompt
    assert rej.count() == 1
    twice = index.unionByName(index)                    # appended to twice: still at most k chunks
    assert answer_requests(req, twice, enc, None, k=2)[0].first().chunks_retrieved <= 2
    rr = run_records(resp).first()
    assert rr.session_id == "s1" and rr.user_id is None

    # resumable extraction: restart with more files adds only the new keys
    src, out, ck = (os.path.join(tmp_dir, x) for x in ("in", "out", "ck"))
    data = spark.range(120).select(F.col("id").alias("k"), (F.col("id") % 7).cast("string").alias("v"))
    data.filter("k < 100").write.parquet(os.path.join(src, "w1"))
    schema = data.schema
    process_new(spark, os.path.join(src, "*"), schema, out, ck, "k", lambda d: d)
    assert read_output(spark, out).count() == 100
    data.write.parquet(os.path.join(src, "w2"))
    process_new(spark, os.path.join(src, "*"), schema, out, ck, "k", lambda d: d)
    o = read_output(spark, out)
    assert o.count() == 120 and o.select("k").distinct().count() == 120


def test_build_features_end_to_end(spark, tmp_dir):
    import hashlib
    from quire.plans.features import build_features
    from quire.schemas import feature_columns
    p = os.path.join(tmp_dir, "e.csv")
    with open(p, "w") as f:
        f.write("destination_name,country,region,travel_style_label,wikivoyage_url\n"
                "Sa Pa,Vietnam,Southeast Asia,Culture,u\n"
                "Sa Pa,Vietnam,East Asia,Adventure,u\n"
                "Nowhere,X,Atlantis,Budget,u\n"
                "Ghost,Y,Oceania,Luxury,u\n")
    ents = read_entities(spark, p)
    d = os.path.join(tmp_dir, "cache")
    os.makedirs(d)
    key = f"v1_{hashlib.md5('sa pa'.lower().encode()).hexdigest()}.json"
    with open(os.path.join(d, key), "w") as f:
        json.dump({"title": "Sa Pa", "understand": "trekking to hill tribe homestay villages",
                   "do": "museum, temple, market", "sleep": "cheap hostel dorm", "full_text": "x"}, f)
    feats, rej = build_features(ents, read_articles(spark, d, one_per_file=True))
    rows = {r.destination_name: r for r in feats.collect()}
    assert set(rows) == {"Sa Pa", "Ghost"} and [r.destination_name for r in rej.collect()] == ["Nowhere"]
    sapa = rows["Sa Pa"]
    assert sapa.label == "Culture" and sapa.region_southeast_asia == 1 and sapa.region_east_asia == 0
    assert sapa.culture_keyword_count >= 5 and sapa.culture_keyword_binary == 1 and sapa.price_tier == 1
    assert rows["Ghost"].is_empty_article and rows["Ghost"].price_tier == 2
    assert feats.columns[:37] == feature_columns()
