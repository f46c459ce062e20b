import gzip

import pytest
import numpy as np

from sparkredact.llm import topk, warc


def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "é" * 200
    rows = [(1, "u/1", big), (2, None, big), (3, "u\r\n3", "small"), (4, "u/4", "small"), (5, "u", None), (1, "u/1", big), (7, "WARC", "WARC/1.1\r\nx\r\n\r\n" * 50), (None, "n", big)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for k, packed in enumerate((True, False)):
        path = f"file://{tmp_path}/w{k}"
        warc.write_warc(warc.with_revisits(df), path, roll_bytes=900, compress=packed)
        got = warc.read_warc(spark, path, with_payload=True).collect()
        assert all(r.kind == "record" for r in got) and len(got) == len(rows)
        assert sorted((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes) for r in got if r.page_id in (1, 2, 3, 5, None)) == sorted(
            [(1, "response", None, len(big.encode())), (1, "response", None, len(big.encode())), (2, "revisit", 1, len(big.encode())), (3, "response", None, 5), (5, "response", None, 0), (0, "revisit", 1, len(big.encode()))]
        )
        assert bytes(next(r.payload for r in got if r.page_id == 7)).decode() == rows[6][2]
    path = f"file://{tmp_path}/none"
    warc.write_warc(warc.with_revisits(df.limit(0)), path)
    assert warc.read_warc(spark, path).count() == 0


def records(n):
    return [warc.record_bytes(i, f"u/{i}", b"payload %d " % i * 20, __import__("hashlib").sha256(b"payload %d " % i * 20).hexdigest(), None) for i in range(n)]


def split(data):
    out = list(warc.salvage(data))
    return [warc._page(x.headers["warc-record-id"]) for x in out if isinstance(x, warc.Record)], [x for x in out if not isinstance(x, warc.Record)]


def test_salvage():
    for pack in (lambda r: gzip.compress(r, mtime=0), lambda r: r):
        parts = [pack(r) for r in records(6)]
        whole = b"".join(parts)
        assert split(whole) == ([0, 1, 2, 3, 4, 5], [])
        at = len(parts[0]) + len(parts[1])
        hurt = bytearray(whole)
        hurt[at + len(parts[2]) // 2] ^= 0xFF
        pages, gaps = split(bytes(hurt))
        assert pages == [0, 1, 3, 4, 5] and [(a, b) for a, b, _ in gaps] == [(at, at + len(parts[2]))]
        pages, gaps = split(whole[:-30])
        assert pages == [0, 1, 2, 3, 4] and gaps[-1][1] == len(whole) - 30
        pages, gaps = split(b"junk\n" + parts[0] + b"more junk" + parts[1])
        assert pages[0] == 0 and gaps[0][:2] == (0, 5)
        assert split(b"") == ([], [])


def brute(rows, k):
    v = {i: np.floor(1024 * np.array(x, dtype=np.float64)).astype(np.int64) for i, x in rows if i is not None and x is not None and all(y is not None and np.isfinite(y) for y in x)}
    out = []
    for q in sorted(v):
        if q % 100 == 0:
            best = sorted((-int(v[q] @ v[c]), c) for c in v if c != q and len(v[c]) == len(v[q]))[:k]
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(best)]
    return out


def test_topk(spark):
    r = np.random.default_rng(0)
    rows = [(i, [float(x) for x in r.normal(size=40)]) for i in range(450)]
    rows += [(500, rows[3][1]), (501, rows[3][1]), (502, rows[3][1]), (600, [1.0, 2.0]), (601, [3.0, 1.0]), (503, None), (504, [None] * 40), (505, [float("nan")] * 40), (700, [float("inf")] * 40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    every = topk.quantized(df)
    ask = every.filter("vec_id % 100 = 0")
    for block in (2, 1000):
        got = sorted(tuple(x) for x in topk.top_k(ask, every, 10, query_block=block).select("query_id", "rank", "vec_id", "score").collect())
        assert got == brute(rows, 10)
    assert topk.top_k(ask.limit(0), every).count() == 0 == topk.top_k(ask, every.limit(0)).count()


def test_many_members_in_one_file():
    import gzip
    import time

    from sparkredact.llm import warc

    member = gzip.compress(warc.record_bytes(1, "u", b"x" * 300, "d", None), mtime=0)

    def seconds(n):
        start = time.perf_counter()
        assert sum(1 for _ in warc.salvage(member * n)) == n
        return time.perf_counter() - start

    seconds(500)
    assert seconds(16_000) < 10 * seconds(4_000) + 0.5


def test_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from sparkredact.llm import common

    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(cluster)
