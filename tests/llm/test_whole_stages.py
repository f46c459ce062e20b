import corpus_pipeline as cp


def test_mix_takes_whole_texts(spark, tmp_path):
    texts = {i: f"title {i}\n\n" + "\n".join(f"line {k} of {i}" for k in range(5 + 3 * i)) for i in range(12)}
    docs = spark.createDataFrame([(i, t, f"s{i % 3}", len(t)) for i, t in texts.items()], "doc_id long, text string, source string, n_chars int")
    got = cp.mix_sources(spark, docs, str(tmp_path)).collect()
    assert got and all(r.text == texts[r.doc_id] and r.n_chars == len(r.text) for r in got)
