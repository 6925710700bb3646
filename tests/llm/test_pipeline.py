import corpus_pipeline
from quire.llm import queries


def test_stages_on_a_small_corpus(spark, make_docs, edge_rows, tmp_path):
    copy = "a sentence that is long enough to be a document of its own, with a number 4396177793418310 in it and more words"
    rows = edge_rows + [(100, copy, "en"), (101, copy, "en"), (102, copy.replace("sentence", "phrase") + "", "en"),
                        (103, " ".join(f"word{i}" for i in range(300)), "en"), (104, " ".join(f"word{i}" for i in range(299)) + " end", "en")]
    docs = make_docs(rows)
    columns = docs.columns
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / str(k))
        stage(spark, docs, "").write.parquet(path)
        docs = spark.read.parquet(path)
        if k < 4:
            assert docs.columns == columns, name
            kept.append({r.doc_id for r in docs.collect()})
    assert {2, 3, 4, 7}.isdisjoint(kept[0]) and {1, 5, 6, 9, 100, 101, 103} <= kept[0]
    assert 101 in kept[1] and 100 not in kept[1] and 5 in kept[1] and 1 not in kept[1]
    assert 104 in kept[2] and 103 not in kept[2] and 9 in kept[2]
    assert {r.doc_id for r in docs.select("doc_id").collect()} == kept[3]


def test_run_on_a_table(spark, make_docs, edge_rows, tmp_path):
    make_docs(edge_rows).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() >= 5
    make_docs([]).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_registered_names():
    numbers = sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES)
    assert numbers == list(range(1, 11)) and set(queries.ORACLES) <= set(queries.QUERIES)
    assert [s for s, _ in corpus_pipeline.STAGES] == ["language ID", "exact dedup", "n-gram Jaccard join", "PII", "packing"]
