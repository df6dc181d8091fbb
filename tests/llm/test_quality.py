import zlib

import numpy as np
import pyarrow as pa

from sensorspark.llm import quality

SCHEMA = "doc_id long, text string, score string, y int"


def test_held_out_accuracy_and_folds(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in rows.items())
    held = [(rows[x.doc_id].score, x.quality) for x in labels.collect() if rows[x.doc_id].held_out]
    good, bad = (np.array([s for s, q in held if q == v]) for v in (1, 0))
    assert (good[:, None] > bad).mean() > 0.95 and (good >= 0.3).mean() > 0.97


def test_flat_trees_agree_with_walking_each_row():
    r = np.random.default_rng(0)
    x = r.normal(size=(3000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    t = quality.Trees().fit(x[:2000], y[:2000])
    assert ((t.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.9

    def walk(row):
        raw = t.base
        for node in t.roots:
            while t.below[node] != node:
                node = t.below[node] + (row[t.feature[node]] > t.limit[node])
            raw += t.value[node]
        return 1 / (1 + np.exp(-raw))

    assert np.allclose([walk(row) for row in x[2000:2050]], t.score(x[2000:2050]))


def test_statistics_dont_depend_on_neighbours():
    texts = ["", None, "A b.\nA b.\n", "é" * 10, "\n", "word " * 50_000, "***", "x"]
    whole = quality.statistics(pa.array(texts))
    assert np.allclose(whole, np.concatenate([quality.statistics(pa.array([t], pa.string())) for t in texts]))


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, "s", 0), (2, "", "s", 0), (2, "", "s", 0), (None, "x", "s", 0), (4, "x" * 100_000, "s", 0)], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.classify(docs, none).collect()} == {0.5}
    odd = spark.createDataFrame([(2, 1), (2, None), (4, 7), (None, 1), (4, 1)], "doc_id long, quality int")
    rows = quality.classify(docs, odd).collect()
    assert len(rows) == 5 and len({r.score for r in rows}) == 1 and rows[0].score > 0.5
    assert quality.classify(docs.limit(0), odd).count() == 0
    assert quality.score(docs, quality.Trees().fit(np.zeros((0, 27)), np.zeros(0))).columns == ["doc_id", "text", "y", "score"]
