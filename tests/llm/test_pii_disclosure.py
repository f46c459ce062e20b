"""Terms that disclose an entity from afar, short ones, and in documents without the entity."""

from sparkredact.llm import pii

FAR = " ".join(f"filler{chr(97 + i)}" for i in range(20))


def test_terms_anywhere(spark):
    texts = [f"farterm {FAR} ann@x.org {FAR} zq"] * 3 + ["zq alone farmost", f"{FAR} farmost bob@y.org", f"farmost {FAR} bob@y.org"]
    texts += [f"{FAR} other {i}" for i in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    for i in range(3):
        assert clean[i] == f" {FAR} [EMAIL] {FAR} [TERM]"
    assert clean[3] == "[TERM] alone [TERM]"
    assert clean[4] == f"{FAR} [TERM] [EMAIL]" and clean[5] == f"[TERM] {FAR} [EMAIL]"
    assert all(clean[i] == texts[i] for i in range(6, len(texts)))
