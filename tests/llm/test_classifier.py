"""The classifier's exchange against plain sums, and labels that contradict one another."""

import numpy as np
import pyarrow as pa
import pytest

from planecraft.llm import quality_classifier as qc


def test_exchange_is_the_sum_over_all_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    rng = np.random.default_rng(2)
    weights = (rng.normal(size=(1 << qc.TRIGRAM_BITS) + qc.CLASS_FEATURES + 1) / 4, rng.normal(size=qc.META_DIMS + 1))
    model = qc.Model(weights, (np.array([3.0, 0.0]),) * 2, np.zeros(3), 0.5)
    how = qc.CoTraining(cells=3, sure=0.8)
    got = qc.exchanged(docs.repartition(5), model, how)
    n, total = {}, {}
    for r in docs.collect():
        one = pa.RecordBatch.from_pydict({c: pa.array([r[c]]) for c in docs.columns})
        views = qc.text_view(one.column("text"))[0], qc.meta_view(one)[0]
        good = [1 / (1 + np.exp(-3 * (v @ w[:-1] + w[-1]))) for v, w in zip(views, weights)]
        cell = qc.zlib.crc32(f"{r.source}/{r.lang}".encode()) % 3
        for giver in (0, 1):
            for label in (0, 1):
                if (good[giver] if label else 1 - good[giver]) >= 0.8:
                    key = 1 - giver, label, cell
                    n[key] = n.get(key, 0) + 1
                    total[key] = total.get(key, 0) + views[1 - giver].astype(float)
    assert {k: v[0] for k, v in got.items()} == n and len(n) > 6
    assert all(np.allclose(got[k][1], total[k], rtol=1e-4, atol=1e-4) for k in n)


def test_labels_that_contradict_are_none(spark):
    rows = [(1, 1, 0), (1, 0, 0), (2, 1, 0), (2, 1, 1), (3, None, 0), (3, 0, 0), (None, 1, 0), (4, None, 0)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    assert sorted(map(tuple, qc.chosen_labels(labels, qc.CoTraining()).collect())) == [(2, 1), (3, 0)]


def test_metadata_view_sees_no_text():
    batch = lambda t: pa.RecordBatch.from_pydict({"text": pa.array([t], pa.string()), "source": ["a"], "lang": ["en"], "n_chars": [None]})
    assert np.array_equal(qc.meta_view(batch("x")), qc.meta_view(batch("many\nlines\nhere")))


def test_repeated_rows_of_a_labelled_document_count_once(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice(["good", "fine", "text"] if i % 2 else ["bad", "$$$", "!!"], 30)), "en", "s", 5) for i in range(60)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    once = qc.fit(spark.createDataFrame(rows, schema), labels)
    twice = qc.fit(spark.createDataFrame(rows + rows[:20] * 3, schema).repartition(4), labels)
    assert all(a == pytest.approx(b, abs=1e-5) for x, y in zip((once.views, once.calibration), (twice.views, twice.calibration)) for a, b in zip(x, y))
    kept = qc.assess(spark.createDataFrame(rows, schema), labels).collect()
    assert all(r.kept == bool(r.doc_id % 2) for r in kept)
