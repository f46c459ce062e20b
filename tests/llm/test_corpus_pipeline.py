import corpus_pipeline as cp
from sparkredact.llm.common import materialize


def test_stages(spark, tmp_path):
    body = " ".join(f"word{i}" for i in range(80))
    rows = [(i, f"start {i} " + " ".join(f"own{i}x{k}" for k in range(60)), "en", f"s{i % 3}", 0) for i in range(30)]
    rows += [(100, body, "en", "s0", 0), (101, body, "en", "s0", 0), (102, body + " more", "en", None, 0), (103, None, "en", "s1", 0), (104, "12 34", None, "s1", 0), (105, body[::-1] + " mail me@x.org", "en", "s1", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in cp.STAGES:
        docs = materialize(stage(spark, docs, str(tmp_path)), "stage")
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if name == "PII":
            text = {r.doc_id: r.text for r in docs.collect()}
            assert "[EMAIL]" in text[105] and text[3] == rows[3][1]
    assert kept["language ID"] == {r[0] for r in rows} - {103, 104}
    assert kept["n-gram Jaccard join"] == kept["PII"] == kept["language ID"] - {101, 102}
    assert set(docs.columns) >= {"doc_id", "piece", "sequence_id", "offset"}
    assert cp.ORACLE_SQL is None and len(cp.STAGES) == 5
