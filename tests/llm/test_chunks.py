"""Texts of more than one chunk of a task give what each text gives alone."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bpe_rank_queue, common, html_content, packing, toxicity_kn

FAR = 1_000_000


def test_pieces_hold_every_row_once_and_are_no_views():
    rng = np.random.default_rng(1)
    texts = [None if i % 7 == 3 else "é" * int(n) for i, n in enumerate(rng.integers(0, 60, 200))]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(200))], ["text", "id"])
    for limit in (1, 50, 10_000):
        pieces = list(common.text_chunks([batch, batch.slice(0, 0)], limit=limit))
        assert pa.Table.from_batches(pieces).to_pylist() == batch.to_pylist()
        assert all(c.offset == 0 for p in pieces for c in p.columns)
        assert all(p.num_rows == 1 or sum(len((t or "").encode()) for t in p.column("text").to_pylist()) <= limit for p in pieces)


@pytest.fixture(scope="module")
def three(spark):
    """The documents three times over in one task: several chunks of text."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    out = docs
    for k in (1, 2):
        out = out.unionByName(docs.withColumn("doc_id", F.col("doc_id") + k * FAR))
    return docs, out.coalesce(1)


def same(alone, together, key="doc_id"):
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    want = rows(alone)
    got = rows(together.withColumn(key, F.col(key) % FAR))
    assert want and got == sorted(want * 3)


def test_byte_pairs(three):
    docs, more = three
    columns = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    same(bpe_rank_queue.round_trip(docs.repartition(200)).select(*columns), bpe_rank_queue.round_trip(more).select(*columns))


def test_packed_pieces(three):
    docs, more = three
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    same(packing.pack(docs.repartition(200)).select(*columns), packing.pack(more).select(*columns))


def test_toxic_scores(three):
    docs, more = three
    model = toxicity_kn.KneserNey(["vile", "kind", "river"], np.array([3.0, 0, 1]), np.array([0.0, 4, 1]))
    model.curve = np.array([-1.0, 1.0, 0.5, 0.1])
    score = lambda d: toxicity_kn.score(d, model).select("doc_id", F.round("score", 9).alias("score"))
    same(score(docs.repartition(200)), score(more))


def test_main_texts(spark, three):
    pages = three[0].select(F.col("doc_id").alias("page_id"), F.concat(F.lit("<nav><a>x</a></nav><article><p>"), F.regexp_replace("text", "[<&]", " "), F.lit("</p></article>")).alias("html"))
    more = pages
    for k in (1, 2):
        more = more.unionByName(pages.withColumn("page_id", F.col("page_id") + k * FAR))
    model = html_content.train(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))
    run = lambda d: html_content.extract(d, model, ("page_id",)).select("page_id", "n_chars", F.md5("text").alias("m"))
    same(run(pages.repartition(200)), run(more.coalesce(1)), "page_id")
