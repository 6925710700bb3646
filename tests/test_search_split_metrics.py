import numpy as np
from pyspark.sql import Window, functions as F

from quire.operators import metrics as M
from quire.operators import split as SP
from quire.operators.search import search
from quire.operators.serving import assemble_context, history

from conftest import SF_SMALL


def brute(q, x, qids, xids, k, t):
    qn = q / np.linalg.norm(q, axis=1)[:, None]
    xn = np.linalg.norm(x, axis=1)
    ok = xn > 0
    xu = np.where(ok[:, None], x / np.where(ok, xn, 1)[:, None], 0)
    s = qn @ xu.T
    out = set()
    for i, qi in enumerate(qids):
        cand = [(s[i, j], xids[j]) for j in range(len(xids)) if ok[j]]
        cand.sort(key=lambda c: (-c[0], c[1]))
        for r, (sim, xid) in enumerate(cand[:k]):
            if sim >= t:
                out.add((int(qi), r + 1, int(xid), round(float(sim), 4)))
    return out


def test_search_equals_brute_force_with_ties_and_zero_vectors(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 16)).astype(np.float32)
    x[10] = x[11]            # exact duplicate → tie broken by id
    x[20] = 0                # zero vector never matches
    q = rng.normal(size=(37, 16)).astype(np.float32)
    idx = spark.createDataFrame([(i, x[i].tolist()) for i in range(len(x))], "id long, embedding array<float>") \
        .repartition(5)
    qs = spark.createDataFrame([(100 + i, q[i].tolist()) for i in range(len(q))], "query_id long, embedding array<float>")
    for k, t, q_rows, x_rows in [(5, 0.0, 4096, 65536), (3, 0.3, 10, 40), (7, -1.0, 4096, 50)]:
        got = {(r.query_id, r.rank, r.id, r.similarity) for r in
               search(qs, idx, k=k, min_similarity=t, carry=["id"], query_block_rows=q_rows, index_block_rows=x_rows).collect()}
        assert got == brute(q.astype(np.float64), x.astype(np.float64), list(range(100, 137)), list(range(300)), k, t)


def clustered(n, dim, centres, seed, spread=0.05):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dim))
    return (c[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, dim))).astype(np.float32)


def test_pruned_search_equals_brute_force_and_visits_few_cells(spark):
    x = clustered(3000, 12, 30, 3)
    x[100:130] = x[7]           # equal vectors tie by id
    x[200] = 0
    q = np.concatenate([x[5:8], clustered(60, 12, 30, 3), -x[:5]])
    idx = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<float>").repartition(5)
    qs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id long, embedding array<float>")
    for k, t in ((5, None), (20, 0.3)):
        visits = []
        got = {(r.query_id, r.rank, r.id, r.similarity) for r in
               search(qs, idx, k=k, min_similarity=t, carry=["id"], pivots=40, visits=visits).collect()}
        assert got == brute(q.astype(np.float64), x.astype(np.float64), list(range(len(q))), list(range(len(x))), k, -2 if t is None else t)
        assert sum(visits) < 0.3 * 40 * len(q)


def test_pruned_search_on_many_equal_vectors(spark):
    """A cell that holds nearly all rows is cut into shards."""
    x = np.concatenate([np.tile(np.array([[1.0, 2.0, 3.0]], np.float32), (4000, 1)), clustered(500, 3, 5, 1)])
    q = x[[0, 4100, 4200]]
    idx = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<float>").repartition(3)
    qs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id long, embedding array<float>")
    got = {(r.query_id, r.rank, r.id, r.similarity) for r in
           search(qs, idx, k=6, min_similarity=None, carry=["id"], pivots=6, index_block_rows=300).collect()}
    assert got == brute(q.astype(np.float64), x.astype(np.float64), [0, 1, 2], list(range(len(x))), 6, -2)
    few = spark.createDataFrame([(1, [1.0, 0.0])], "id long, embedding array<float>")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "query_id long, embedding array<float>")
    assert [(r.query_id, r.id) for r in search(asked, few, carry=["id"], pivots=4).collect()] == [(1, 1)]
    assert search(asked, few.limit(0), carry=["id"], pivots=4).count() == 0


def test_search_result_shape_and_rounding(spark):
    idx = spark.createDataFrame([("a", "wikivoyage:A", 0, [1.0, 0.0]), ("b", "wikivoyage:B", 2, [0.75432, 0.6565])],
                                "chunk_text string, source_document string, chunk_index int, embedding array<float>")
    qs = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, embedding array<float>")
    rows = search(qs, idx, k=5, min_similarity=0.3).orderBy("rank").collect()
    assert rows[0].asDict().keys() >= {"chunk_text", "source_document", "chunk_index", "similarity"}
    assert [r.chunk_text for r in rows] == ["a", "b"] and rows[0].similarity == 1.0
    assert len(str(rows[1].similarity).split(".")[1]) <= 4


def test_search_on_table_matches_numpy(spark):
    e = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    pdf = e.toPandas()
    x = np.stack(pdf.embedding.values).astype(np.float64)
    got = {(r.query_id, r.rank, r.vec_id, r.similarity) for r in
           search(e.select(F.col("vec_id").alias("query_id"), "embedding"), e, k=5, min_similarity=0.2,
                  carry=["vec_id"]).collect()}
    ids = pdf.vec_id.tolist()
    assert got == brute(x, x, ids, ids, 5, 0.2)


def test_context_assembly(spark):
    hits = spark.createDataFrame(
        [(1, r, f"wikivoyage:D{r}", 0.9 - r / 10, "t" * 500) for r in range(1, 6)],
        "query_id int, rank int, source_document string, similarity double, chunk_text string")
    qs = spark.createDataFrame([(1,), (2,)], "query_id int")
    ctx = {r.query_id: r for r in assemble_context(qs, hits).collect()}
    parts = ctx[1].context.split("\n\n")
    assert len(parts) == 4 and parts[0] == "[D1 - similarity: 0.80]\n" + "t" * 400
    assert ctx[1].n_hits == 5
    assert ctx[2].context == "No specific destination information available." and ctx[2].n_hits == 0


def test_history(spark):
    import datetime as dt
    rows = [(str(i), f"in{i}", ("r" * 150) if i % 2 else None, "completed", dt.datetime(2024, 1, 1, 0, 0, i))
            for i in range(20)]
    runs = spark.createDataFrame(rows, "run_id string, user_input string, agent_response string, status string, "
                                       "started_at timestamp")
    h = history(runs, 3).collect()
    assert [r.run_id for r in h] == ["19", "18", "17"]
    assert h[0].agent_response == "r" * 100 + "..." and h[1].agent_response is None


def test_split_shares_follow_published_supports(spark):
    sizes = {"Adventure": 36, "Family": 25, "Budget": 27, "Culture": 56, "Luxury": 25, "Relaxation": 31}
    rows = [(f"{c}-{i}", c) for c, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "name string, label string")
    q = {r.label: r.n_test for r in SP.class_quotas(df, "label").collect()}
    assert q == {"Adventure": 7, "Family": 5, "Budget": 6, "Culture": 11, "Luxury": 5, "Relaxation": 6}
    sp = SP.stratified_split(df, "label", "name")
    got = {r.label: r["count"] for r in sp.filter("split = 'test'").groupBy("label").count().collect()}
    assert got == q


def test_bucketed_rank_equals_window_rank_with_hot_class(spark):
    rows = [(i, "hot" if i % 3 else f"c{i % 7}") for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, label string")
    ours = {r.id: r.class_rank for r in SP.stratified_rank(df, "label", "id", bucket_chars=2).collect()}
    w = Window.partitionBy("label").orderBy(SP.hash_order("id"), "id")
    ref = {r.id: r.rk for r in df.select("id", F.row_number().over(w).alias("rk")).collect()}
    assert ours == ref


def test_folds_disjoint_complete_balanced(spark):
    rows = [(i, f"c{i % 3}" if i % 10 else "rare") for i in range(403)]
    df = spark.createDataFrame(rows, "id long, label string")
    f = SP.stratified_folds(df, "label", "id", k=5).collect()
    assert sorted(r.id for r in f) == list(range(403))
    sizes = {}
    for r in f:
        sizes[r.fold] = sizes.get(r.fold, 0) + 1
    assert set(sizes) == set(range(5)) and max(sizes.values()) - min(sizes.values()) <= 1


def test_class_weights(spark):
    df = spark.createDataFrame([("a",)] * 6 + [("b",)] * 2, "y string")
    w = {r.y: r.weight for r in SP.class_weights(df, "y").collect()}
    assert abs(w["a"] - 8 / (2 * 6)) < 1e-12 and abs(w["b"] - 8 / (2 * 2)) < 1e-12


def test_metrics(spark):
    rows = [("a", "a"), ("a", "b"), ("b", "b"), ("b", "b"), ("c", "a")]
    df = spark.createDataFrame(rows, "y string, p string")
    rep = {r.label: r for r in M.per_class(df, "y", "p").collect()}
    assert abs(rep["a"].precision - 0.5) < 1e-12 and abs(rep["a"].recall - 0.5) < 1e-12
    assert abs(rep["b"].f1 - 0.8) < 1e-12 and rep["c"].f1 == 0.0 and rep["c"].support == 1
    mf = M.macro_f1(df, "y", "p", ["a", "b", "c", "d"]).first().f1_macro
    assert abs(mf - (0.5 + 0.8 + 0 + 0) / 4) < 1e-12
    assert abs(M.accuracy(df, "y", "p").first().accuracy - 0.6) < 1e-12


def test_best_of_strict_and_first_wins(spark):
    df = spark.createDataFrame([("x", 0, 0.5), ("y", 1, 0.5), ("z", 2, 0.0)], "m string, o int, f double")
    assert M.best_of(df, "f", "o").first().m == "x"
    assert M.best_of(df.filter("m = 'z'"), "f", "o").count() == 0


def test_compare_reports(spark):
    a = spark.createDataFrame([("A", 0.5), ("B", 0.2)], "label string, f1 double")
    b = spark.createDataFrame([("A", 0.5), ("C", 0.4)], "label string, f1 double")
    r = {x.label: x for x in M.compare_reports(a, b).collect()}
    assert r["A"].sign == "" and r["B"].sign == "-" and r["C"].sign == "+" and abs(r["C"].delta - 0.4) < 1e-12


def test_split_and_folds_equals_two_step(spark):
    rows = [(i, "hot" if i % 4 else f"c{i % 5}") for i in range(997)]
    df = spark.createDataFrame(rows, "id long, label string")
    one = {r.id: (r.split, r.fold, r.class_rank) for r in SP.split_and_folds(df, "label", "id").collect()}
    sp = SP.stratified_split(df, "label", "id")
    folds = {r.id: r.fold for r in SP.stratified_folds(sp.filter("split = 'train'"), "label", "id").collect()}
    two = {r.id: (r.split, folds.get(r.id, -1), r.class_rank) for r in sp.collect()}
    assert one == two


def test_timestamp_text_like_python_str(spark):
    import datetime as dt
    from quire.operators.serving import timestamp_text
    vals = [dt.datetime(2024, 1, 2, 3, 4, 5), dt.datetime(2024, 1, 2, 3, 4, 5, 120)]
    df = spark.createDataFrame([(v,) for v in vals], "ts timestamp")
    assert [r[0] for r in df.select(timestamp_text(F.col("ts"))).collect()] == [str(v) for v in vals]


def test_search_string_ids_multi_block(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 8))
    q = rng.normal(size=(25, 8))
    idx = spark.createDataFrame([(f"c{i}", x[i].tolist()) for i in range(len(x))], "cid string, embedding array<double>")
    qs = spark.createDataFrame([(f"q{i}", q[i].tolist()) for i in range(len(q))], "query_id string, embedding array<double>")
    one = {(r.query_id, r.rank, r.cid, r.similarity) for r in search(qs, idx, k=4, min_similarity=None, carry=["cid"]).collect()}
    many = {(r.query_id, r.rank, r.cid, r.similarity) for r in
            search(qs, idx, k=4, min_similarity=None, carry=["cid"], query_block_rows=4, index_block_rows=30).collect()}
    assert one == many and len(one) == 25 * 4


def test_equal_vectors_leave_a_task_as_k_rows(spark):
    """20,000 equal vectors: each cell returns k rows, the first by the tie column."""
    from quire.operators.search import top_of_row
    assert top_of_row(np.ones(20_000), 5).tolist() == [0, 1, 2, 3, 4]
    idx = spark.range(20_000).select(F.col("id"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
    qs = spark.createDataFrame([(1, [1.0, 2.0])], "query_id int, embedding array<double>")
    got = search(qs, idx, k=5, min_similarity=None, carry=["id"], index_block_rows=5000).orderBy("rank").collect()
    assert [r.id for r in got] == [0, 1, 2, 3, 4]


def test_search_wants_one_dimension_and_one_encoder(spark):
    import pytest
    from quire.operators.encode import HashingEncoder
    from quire.operators.search import search_text
    idx = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "id int, embedding array<double>")
    qs = spark.createDataFrame([(1, [1.0, 0.0, 0.0])], "query_id int, embedding array<double>")
    with pytest.raises(ValueError):
        search(qs, idx, carry=["id"])
    none = search(qs.filter("false"), idx, carry=["id"])
    assert none.count() == 0
    enc = HashingEncoder(8)
    stored = enc.transform(spark.createDataFrame([(1, "a b")], "id int, t string"), "t").withColumn("encoder_id", F.lit("other"))
    with pytest.raises(ValueError):
        search_text(spark.createDataFrame([(1, "a")], "query_id int, query string"), stored, enc, carry=["id"])


def test_split_keeps_null_labels_and_keys(spark):
    rows = [(i, None if i % 5 == 0 else "ab"[i % 2]) for i in range(100)] + [(None, "a")]
    df = spark.createDataFrame(rows, "id long, label string")
    out = SP.split_and_folds(df, "label", "id")
    assert out.count() == 101 and out.filter("label IS NULL").count() == 20
    assert SP.stratified_split(df, "label", "id").count() == 101
    assert SP.stratified_folds(df, "label", "id").count() == 101


def test_search_copies_no_vector_for_other_blocks(spark):
    """Blocks meet in a product: neither side is copied for every block or cell of the
    other, and many small blocks give the rows of one."""
    x, q = clustered(900, 8, 9, 5), clustered(70, 8, 9, 6)
    x[50:90], x[300] = x[4], 0
    idx = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<float>").repartition(4)
    qs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id long, embedding array<float>")
    want = brute(q.astype(np.float64), x.astype(np.float64), list(range(70)), list(range(900)), 4, 0.1)
    for pivots in (1, 12):
        found = search(qs, idx, k=4, min_similarity=0.1, carry=["id"], query_block_rows=9, index_block_rows=40, pivots=pivots)
        plan = found._jdf.queryExecution().toString()
        assert "CartesianProduct" in plan and "CoGroup" not in plan
        assert {(r.query_id, r.rank, r.id, r.similarity) for r in found.collect()} == want
