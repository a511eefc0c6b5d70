"""Whole results where an operator once gave a part: neighbours at tens of thousands of vectors, and the like."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from planecraft.llm import additive_ann, main_text


def test_ann_finds_all_neighbours_outside_the_fit_sample(spark, tmp_path):
    """Isotropic directions, of lengths in two sizes: the code alone tells little, and most rows aren't in the sample."""
    n, rng = 40_000, np.random.default_rng(8)
    x = rng.normal(size=(n, 64))
    x = (x / np.linalg.norm(x, axis=1)[:, None] * np.where(rng.random(n) < 0.1, 1.3, 1.0)[:, None]).astype(np.float32)
    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": pa.array(list(x), pa.list_(pa.float32()))}), tmp_path / "x.parquet")
    how = additive_ann.Additive(sample=2000)
    got = {}
    for r in additive_ann.search(spark.read.parquet(str(tmp_path)), F.col("vec_id") % 400 == 0, how).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, n, 400):
        score = x.astype(np.float64) @ x[q].astype(np.float64)
        score[q] = -np.inf
        hits += len(set(np.argsort(-score)[:20].tolist()) & got[q])
    print("recall", hits / (20 * n / 400))
    assert hits == 20 * n / 400


def test_main_text_sees_repeats_over_the_whole_host(spark):
    """A notice on 6 of 300 pages goes, however the host's pages are dealt; the same words on another host stay."""
    notice = " ".join(f"notice{i}" for i in range(25))
    story = lambda i: " ".join(f"p{i}w{j}" for j in range(30))
    rows = [(i, f"http://big.org/{i}", f"<div>{notice if i % 50 == 0 else ''}</div><p>{story(i)}</p>") for i in range(300)]
    rows += [(1000, "http://big.org/1000", rows[7][2]), (1001, "http://small.org/", f"<div>{notice}</div>")]  # equal pages count as one
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {i: story(i) for i in range(300)} | {1000: story(7), 1001: notice}
    for parts in (1, 40):
        assert {r.page_id: r.text for r in main_text.main_texts(pages.repartition(parts)).collect()} == want
