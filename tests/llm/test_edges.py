"""The pipeline and main texts on tables with nulls, repeated rows, clashing columns and no rows."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from planecraft.llm import main_text

@pytest.fixture(scope="module")
def folder(spark, sf, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    real = spark.read.parquet(f"{sf}/documents.parquet")
    good = real.join(spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1 AND toxic = 0"), "doc_id").where("doc_id >= 60 AND n_chars BETWEEN 800 AND 4000")
    texts = [r.text for r in good.orderBy("doc_id").limit(5).collect()]
    story = lambda i: texts[i]
    odd = [(1001, None), (1002, ""), (1003, "too short"), (1004, " \n\t "), (None, story(1)), (1006, story(2)), (1007, story(2)), (1008, story(2) + " And one more."), (1009, story(3)), (1009, story(3)), (1010, story(4))]
    rows = spark.createDataFrame([(d, t, None, None, None) for d, t in odd], real.schema)
    both = real.where("doc_id < 60").unionByName(rows)
    for name in ("kept", "score", "class_id", "text_class", "start", "length", "n_words"):
        both = both.withColumn(name, F.lit("mine"))
    both.repartition(3).write.parquet(f"{path}/documents.parquet")
    both.where("false").write.parquet(f"{path}/none/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet").withColumn("text", F.lit("label"))
    none = spark.createDataFrame([(None, 1, 0, "x"), (5, None, None, "x"), (1010, 1, 0, "x"), (1010, 1, 0, "x")], labels.schema)
    for p in (path, f"{path}/none"):
        labels.unionByName(none).write.parquet(f"{p}/labels.parquet")
    return path


def test_pipeline_of_odd_tables(spark, folder):
    pieces = corpus_pipeline.run(spark, folder).collect()
    held, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        held[p.doc_id].append(p)
        sequences[p.sequence_id].append(p)
    assert not {1001, 1002, 1003, 1004} & set(held)
    assert len({1006, 1007, 1008} & set(held)) == 1 and {None, 1009, 1010} <= set(held)
    for parts in held.values():  # every token of a document once, repeated rows once
        parts.sort(key=lambda p: p.start)
        assert [p.start for p in parts] == [sum(q.length for q in parts[:i]) for i in range(len(parts))]
        assert sum(p.length for p in parts) == parts[0].doc_tokens
    for parts in sequences.values():
        parts.sort(key=lambda p: p.offset)
        assert [p.offset for p in parts] == [sum(q.length for q in parts[:i]) for i in range(len(parts))] and sum(p.length for p in parts) <= 2048


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, folder)
        assert kept.columns == docs.columns and set(map(str, kept.collect())) <= set(map(str, docs.collect()))


def test_pipeline_without_documents(spark, folder):
    assert corpus_pipeline.run(spark, f"{folder}/none").collect() == []


def test_main_texts_of_repeated_rows_and_clashing_columns(spark):
    html = "<html><body><nav>menu of the site</nav><article><p>A story about  one &amp; two.</p><p>It ends.</p></article></body></html>"
    rows = [(1, "http://a/1", html, "mine", -1), (1, "http://a/1", html, "mine", -1), (2, None, None, None, None), (None, "http://a/2", html, "mine", 0)]
    made = main_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int").repartition(2)).collect()
    want = "A story about one & two. It ends."
    assert sorted(((r.page_id, r.url, r.text, r.n_chars) for r in made), key=str) == sorted([(1, "http://a/1", want, len(want))] * 2 + [(2, None, "", 0), (None, "http://a/2", want, len(want))], key=str)
