import random

from pyspark.sql import functions as F

from sparkredact.functions.scanners import word_spans
from sparkredact.functions.spans import SPANS, let
from sparkredact.operators import backend, corpus, decode
from sparkredact.operators.limiter import admissions, rate_limit
from sparkredact.sources import files
from sparkredact.streaming.detection import audit_counts, detect_stream, rate_limit_stream


def test_greedy_and_bio(spark):
    text = "Ann Lee lives in Kota"
    cand = [(0, 0, 0, 0.5), (0, 1, 0, 0.9), (4, 4, 1, 0.7), (3, 4, 5, 0.8), (2, 2, 0, 0.005)]
    df = spark.createDataFrame([(text, cand)], "text string, c array<struct<word_start:int,word_end:int,class_idx:int,score:float>>")
    labels = F.array(F.lit("person_name"), F.lit("street_address"))
    got = df.select(let(word_spans(F.col("text")), lambda w: decode.greedy_select(F.col("c"), w, labels, F.col("text"))).alias("s")).first().s
    assert [(x.text, x.label) for x in got] == [("Ann Lee", "person_name")]
    toks = [(0, 3, "B-P", 0.9, False), (4, 7, "I-P", 0.5, False), (8, 13, "O", 0.9, False), (14, 16, "I-P", 0.9, False), (17, 21, "I-A", 0.05, False)]
    df = spark.createDataFrame([(text, toks)], "text string, t array<struct<start:int,end:int,tag:string,prob:float,special:boolean>>")
    got = df.select(decode.bio_decode(F.col("t"), F.col("text")).alias("s")).first().s
    assert [(x.text, round(x.score, 2)) for x in got] == [("Ann Lee", 0.9), ("in", 0.9)]


def naive_admissions(times, limit, window):
    held, out = [], []
    for t in times:
        held = [h for h in held if t - h <= window]
        out.append(len(held) < limit)
        if out[-1]:
            held.append(t)
    return out


def test_rate_limit(spark):
    times = [0, 1, 2, 60, 60.5, 61, 61.5]
    micros = [int(t * 1e6) for t in times]
    df = spark.createDataFrame([(micros,)], "t array<bigint>")
    assert [x.admitted for x in df.select(admissions(F.col("t"), 2).alias("a")).first().a] == [True, True, False, False, True, False, True]
    r = random.Random(3)
    rows = [(k, r.randrange(400)) for k in "abc" for _ in range(60)]
    df = spark.createDataFrame(rows, "k string, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = {}
    for x in rate_limit(df, "k", "ts", 3, 60).orderBy("k", "ts").collect():
        got.setdefault(x.k, []).append((x.s, x.admitted))
    for k, own in got.items():
        times = sorted(s for q, s in rows if q == k)
        assert sorted(own) == sorted(zip(times, naive_admissions(times, 3, 60), strict=True)), k


def test_corpus_recipes(spark):
    df = spark.createDataFrame([("x" * 25_000,)], "t string")
    assert [len(c.text) for c in df.select(corpus.chunks(F.col("t")).alias("c")).first().c] == [10_000, 10_000, 5_000]
    lines = spark.createDataFrame([("[1/2/24, 10:00:00 AM] Ann: hi a@b.co",), ("noise",)], "value string")
    assert [(r.sender, r.text) for r in corpus.parse_whatsapp(lines).collect()] == [("Ann", "hi a@b.co")]
    rows = spark.createDataFrame([(1, i, f"line {i} of a log file") for i in range(7)], "f int, n int, t string")
    got = sorted((r.batch, r.lines) for r in corpus.batches(rows, ["f"], ["n"], "t", 3).collect())
    assert got == [(0, 3), (1, 3), (2, 1)] and corpus.batches(rows, ["f"], ["n"], "t", 3, drop_partial=True).count() == 2
    tickets = spark.createDataFrame([(7, "desc", [("short", "u"), ("long enough body", "v")])], "id int, description string, comments array<struct<body:string,author_id:string>>")
    assert sorted(r.source for r in corpus.ticket_texts(tickets).collect()) == ["comment_1", "description"]
    table = spark.createDataFrame([(i, f"u{i}@x.org at home", "plain") for i in range(10)], "id int, mail string, note string")
    got = corpus.classify_columns(table, "t", "id").collect()
    assert [(r.column_name, r.classification, r.dominant_type) for r in got] == [("mail", "PII", "email_address")]
    gold = spark.createDataFrame([(1, 0, 2, "a"), (1, 3, 5, "b")], "doc_id int, start int, end int, label string")
    got = {r.label: r.f1 for r in corpus.strict_match(gold, gold.limit(1)).collect()}
    assert got["a"] == 1.0 and got["b"] == 0.0 and got["(all)"] == 0.5


def test_files(spark, tmp_path):
    for name, body in {"a.txt": "one\nmail a@b.co\n", "b.bin": "a@b.co", "dist/c.txt": "a@b.co", "sub/d.md": "10.0.0.1", "empty.txt": ""}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(body)
    found = files.scan_files(spark, str(tmp_path))
    assert sorted(r.path.rpartition("/")[2] for r in found.collect()) == ["a.txt", "d.md"]
    report = files.scan_report(found)
    out = files.write_report(report, str(tmp_path / "report"))
    assert (out["total_findings"], out["exit_code"], files.gate(report)) == (2, 1, True)
    assert sorted(r.line for r in files.annotations(report, found).collect()) == [1, 2]
    assert "2 entities in 2 files" in files.summary_markdown(report) and "and 1 more files" in files.summary_markdown(report, 1)
    files.write_summary(report, str(tmp_path / "summary"))
    whole = [r.value for r in spark.read.text(str(tmp_path / "summary")).collect()]
    assert len(whole) == 4 and sum("d.md" in x for x in whole) == 1
    assert "d.md" in files.summary_markdown(report) and files.ignore(found, ["*.md"]).count() == 1
    lines = spark.createDataFrame([('{"text": "x", "boost": null}',)], "value string")
    assert files.parse_requests(lines).first().boost == []


def fake():
    class Fake:
        def load(self):
            pass

        def predict(self, texts, labels):
            return [[{"start": 0, "end": 3, "text": t[:3], "label": labels[0], "score": 0.9}] if t else [] for t in texts]

    return Fake()


def test_backend(spark):
    df = spark.createDataFrame([("Ann",), ("王小明",), (None,)], "text string")
    got = {r.text: len(r[backend.CANDIDATES]) for r in backend.with_candidates(df, fake(), ["person_name"], second=fake()).collect()}
    assert got == {"Ann": 1, "王小明": 2, None: 0}
    assert backend.choose_layout(["m/encoder.onnx", "m/scorer.onnx"]) == ("compat", 8)


def test_streams(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:0{i}:00", "k", "mail a@b.co") for i in range(5)]
    df = spark.createDataFrame(rows, "id int, t string, k string, text string").withColumn("ts", F.to_timestamp("t")).drop("t")
    df.write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = audit_counts(detect_stream(stream())).writeStream.outputMode("complete").format("memory").queryName("audit").trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    assert spark.sql("select sum(entities) from audit").first()[0] == 5
    q = rate_limit_stream(stream(), "k", "ts", 2, 120).writeStream.outputMode("append").format("memory").queryName("adm").trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    assert [r.admitted for r in spark.sql("select * from adm order by ts").collect()] == [True, True, False, True, True]
    assert SPANS
