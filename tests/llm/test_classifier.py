"""The classifier: whole texts, bounded sample, held-out accuracy."""

import numpy as np
import pyarrow as pa

from floodframe.llm import classifier as C
from floodframe.llm.common import prepare


def test_chunks_cover_every_byte_and_overlap():
    for size in (0, 1, 255, 256, 257, 480, 5000):
        data = np.arange(size) % 251
        chunks, first = C.layout(data.astype(np.uint8), np.array([0, size]))
        step = C.CHUNK - C.OVERLAP
        rebuilt = {}
        for k, row in enumerate(chunks):
            for j, b in enumerate(row):
                if b != C._PAD:
                    assert rebuilt.setdefault(k * step + j, b) == b
        assert [rebuilt[i] for i in range(size)] == data.tolist() and len(rebuilt) == size
        assert first.tolist() == [0, len(chunks)]


def test_scores_do_not_depend_on_the_batch():
    model = C.train([("good words here " * 20, 1), ("b@d!! w#rds " * 20, 0)] * 20, epochs=2)
    texts = ["good", None, "", "b@d!! " * 300, "x" * 1000]
    whole = C.probabilities(model, pa.array(texts, pa.string()))
    each = [C.probabilities(model, pa.array([t], pa.string()))[0] for t in texts]
    assert np.allclose(whole, each)
    assert whole[1] == whole[2]


def test_held_out_accuracy(spark):
    prepare(spark)
    read = lambda n: spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet")
    model = C.fit(read("documents"), read("labels"))
    scored = C.score(read("documents"), model).join(read("labels"), "doc_id").where(C.held_out(C.F.col("doc_id"))).collect()
    assert np.mean([(r["score"] >= 0.5) == (r["quality"] == 1) for r in scored]) > 0.95


def test_sample_is_bounded_and_leaves_held_out_rows(spark):
    prepare(spark)
    docs = spark.createDataFrame([(i, "t" * 100) for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(300)] + [(2, 1, 0), (None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    assert len(C.labelled_sample(docs, labels, docs_limit=20)) <= 20
    assert sum(len(t) for t, _ in C.labelled_sample(docs, labels, bytes_limit=1000)) <= 1000
    free = docs.where(~C.held_out(C.F.col("doc_id")) & (C.F.col("doc_id") != 2)).count()
    assert len(C.labelled_sample(docs, labels)) == free


def test_odd_rows(spark):
    prepare(spark)
    docs = spark.createDataFrame([(None, None, 1.0, "a"), (1, "", 2.0, "b"), (1, "", 2.0, "b"), (2, "z" * 300_000, 3.0, "c")], "doc_id long, text string, score double, quality string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = C.fit(docs, none)
    assert model is None
    assert [r["score"] for r in C.score(docs, model).collect()] == [0.5] * 4
    assert C.accepted(docs, model).collect() == docs.collect()
    assert C.score(docs.limit(0), model).count() == 0
    assert C.accepted(docs, model, least=0.6).count() == 0
