"""What the near-dedup costs an executor beside its heap: files follow the rows, not the shuffle partitions, and Arrow
batches are bounded in bytes, not in rows."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from silvagrid.llm import common, exact_dedup, minhash
from silvagrid.sources import shared


def test_near_dedup_writes_few_files(spark, monkeypatch):
    """Every file costs an executor child processes; 40 partitions of a few rows used to give 40 files a table."""
    r = random.Random(5)
    base = [[f"w{r.randint(0, 400)}" for _ in range(60)] for _ in range(120)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)] + [(200 + i, " ".join([*w[:-1], "changed"])) for i, w in enumerate(base)]
    written = []

    def counted(df, *by):
        out = shared_saved(df, *by)
        written.append(len(out.inputFiles()))
        return out

    shared_saved = shared.saved
    for module in (shared, common, minhash):
        monkeypatch.setattr(module, "saved", counted)
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        source = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
        got = {x.doc_id: x.component_id for x in minhash.near_duplicates(source).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {i: i % 200 for i, _ in rows}
    assert len(written) >= 8 and max(written) <= spark.sparkContext.defaultParallelism


def test_near_dedup_takes_small_batches(spark, monkeypatch):
    """400 texts of 40 kB used to come as one batch of 16 MB."""

    def bounded(kernel):
        def made(width):
            run = kernel(width)

            def checked(batches):
                def each():
                    for batch in batches:
                        if batch.nbytes > 6 << 20:
                            raise ValueError(f"a batch of {batch.nbytes} bytes")
                        yield batch

                return run(each())

            return checked

        return made

    for name in ("_sketches", "_sets"):
        monkeypatch.setattr(minhash, name, bounded(getattr(minhash, name)))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    source = spark.range(400).selectExpr("id AS doc_id", "concat(id % 300, repeat(' of', 13000)) AS text").coalesce(1)
    got = {x.doc_id: x.component_id for x in minhash.near_duplicates(source).collect()}
    # one common shingle and one of its own: similarity 1/3 unless the texts are equal
    assert got == {i: i % 300 for i in range(400)}
    assert spark.conf.get(key, None) == before


@pytest.fixture
def bounded_batches(spark, monkeypatch):
    """Every batch that comes to Python has at most 6 MB, and a text that comes in its row doesn't come again."""
    frame = type(spark.range(0))
    plain = frame.mapInArrow

    def bounded(self, run, *args, **more):
        def checked(batches):
            def each():
                for batch in batches:
                    if batch.nbytes > 6 << 20:
                        raise ValueError(f"a batch of {batch.nbytes} bytes")
                    if {"row", "text"} <= set(batch.schema.names) and batch.schema.field("row").type.get_field_index("text") >= 0:
                        raise ValueError("the text comes twice")
                    yield batch

            return run(each())

        return plain(self, checked, *args, **more)

    monkeypatch.setattr(frame, "mapInArrow", bounded)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    yield
    assert spark.conf.get(key, None) == before


def long_texts(spark):
    """400 texts of 40 kB, 300 different ones; they used to come as one batch of 16 MB."""
    return spark.range(400).selectExpr("id AS doc_id", "concat(id % 300, repeat(' of', 13000)) AS text", "'en' AS lang", "'a' AS source", "39000L AS n_chars").coalesce(1)


def test_pipeline_takes_small_batches(spark, bounded_batches):
    docs = long_texts(spark).withColumn("lang", F.expr("if(doc_id % 2 = 0, 'en', null)"))
    out = corpus_pipeline.identify_language(spark, docs, "")
    assert out.columns == corpus_pipeline.COLUMNS
    assert {(r.doc_id, r.lang, r.n) for r in out.select("doc_id", "lang", F.length("text").alias("n")).collect()} == {(i, "en", 39000 + len(str(i % 300))) for i in range(400)}
    last = corpus_pipeline.drop_copies(spark, long_texts(spark), "")
    assert {(r.doc_id, r.head) for r in last.select("doc_id", F.substring_index("text", " ", 1).alias("head")).collect()} == {(i, str(i % 300)) for i in range(100, 400)}


def test_exact_dedup_takes_small_batches(spark, bounded_batches):
    got = {(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.exact_groups(long_texts(spark)).collect()}
    assert got == {(i, i % 300 + 300 if i % 300 < 100 else i, 2 if i % 300 < 100 else 1) for i in range(400)}
