"""Importance resampling against a plain version."""

import hashlib
import math
import re
import zlib
from collections import Counter

from planecraft.llm import importance, queries


def features(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def plain(docs, target):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t, made = Counter(), Counter(), []
    for doc_id, text in docs:
        words, found = features(text)
        counts = Counter(map(bucket, found))
        s.update(counts)
        made.append((doc_id, len(words), counts))
    for text in target:
        t.update(map(bucket, features(text)[1]))
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10000) / ((s[b] + 1) * (t.total() + 10000)))) for b in range(10000)]
    rows = []
    for doc_id, n, counts in made:
        weight = sum(gain[b] * k for b, k in counts.items())
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, counts.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[2], -r[1]))
    for rank, r in enumerate(able[: 5 * len(able) // 100], 1):
        r[4] = rank
    return sorted([tuple(r[:5]) for r in rows], key=repr)


def found(df):
    return sorted([(r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()], key=repr)


def test_query_matches_plain(spark, sf):
    docs = [(r.doc_id, r.text) for r in queries.table(spark, sf, "documents").collect()]
    target = [r.text for r in queries.table(spark, sf, "benchmark").collect()]
    assert found(queries.op12_importance_resampling(spark, sf)) == plain(docs, target)


def test_odd_texts_and_small_slices(spark):
    words = [f"w{i}" for i in range(70)]
    docs = [
        (1, None), (2, ""), (3, "..."), (None, " ".join(words[:25])), (4, "Été ÉTÉ 漢字 a1 A1" * 9), (5, "x y " * 400), (5, "x y " * 400), (5, "other"),
        (6, " ".join(f"u{i}" for i in range(30_000))), *[(10 + i, " ".join(words[i : i + 30])) for i in range(40)], *[(60 + i, "same words here " * 8) for i in range(9)],
    ]
    table = spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id long, text string, rank int").repartition(3)
    target = ["w3 w4 w5 w6", None, "ÉTÉ 漢字"]
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    how = importance.Resampling(slice_bytes=2000, part_bytes=30_000)
    assert found(importance.resample(table, bench, how)) == plain(docs, target)
    assert found(importance.resample(table, bench.where("false"), how)) == plain(docs, [])


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert importance.resample(empty, empty).collect() == []


def test_many_pairs_and_last_words_in_one_part(spark):
    text = " ".join(f"u{i}" for i in range(60_000))  # pairs times last words go beyond 4-byte numbers
    how = importance.Resampling()
    table = spark.createDataFrame([(1, text)], "doc_id long, text string")
    counts = importance.bucket_sums(importance.dictionary(table, 1, how), how)
    wanted = Counter(zlib.crc32(f.encode()) % 10000 for f in features(text)[1])
    assert [int(n) for n in counts] == [wanted[b] for b in range(10000)]
