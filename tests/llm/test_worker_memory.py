"""What stays in a worker that Spark uses again, and how large its batches are."""

import gc

import corpus_pipeline
import pyarrow as pa

from sparkredact.llm import common, tokens
from sparkredact.llm.token_files import tokenizer_path


def test_encoder_is_given_back():
    common.give_back()
    before = tokens.encoder(tokenizer_path()).encode(["some words of a text"])[0].tolist()
    assert tokens.encoder.cache_info().currsize == 1
    common.give_back()
    assert tokens.encoder.cache_info().currsize == 0
    assert tokens.encoder(tokenizer_path()).encode(["some words of a text"])[0].tolist() == before
    common.give_back()


def test_batches_while_materializing(spark):
    def rows(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    before = spark.conf.get(common.BATCH_ROWS)
    got = common.materialize(spark.range(3_000).coalesce(1).mapInArrow(rows, "n long"), "batches").collect()
    assert max(r.n for r in got) <= common.SLICE_ROWS and sum(r.n for r in got) == 3_000
    assert spark.conf.get(common.BATCH_ROWS) == before


def test_packing_begins_with_small_heaps(spark):
    jvm = spark.sparkContext._jvm
    heap = jvm.java.lang.Runtime.getRuntime()
    jvm.java.nio.ByteBuffer.allocate(600 << 20).capacity()
    gc.collect()  # the JVM's too, once Python has none of it
    grown = heap.totalMemory()
    docs = spark.createDataFrame([(1, "a few words")], "doc_id long, text string")
    assert corpus_pipeline.pack_sequences(spark, docs, "").count() == 1
    assert grown > 600 << 20 and heap.totalMemory() < grown - (300 << 20)
