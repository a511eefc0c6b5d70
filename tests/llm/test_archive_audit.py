"""The content-addressed archive and the filter audit on odd tables, against plain versions."""

import base64
import hashlib
from collections import Counter
from itertools import permutations

import pytest
from pyspark.errors import PythonException

from planecraft.llm import filter_audit, web_archive


def sha1(raw):
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


PAGES = [
    (1, "http://a/1", "<p>one</p>"), (2, "http://a/2", None), (3, None, ""), (5, "http://b/é\r\nWARC-Type: revisit", "<p>Été 漢字</p>\r\n\r\nWARC-Type: revisit\r\n"),
    (4, "http://c", "<p>one</p>"), (None, "http://d", "<p>one</p>"), (7, "http://e", "<p>one</p>"), (7, "http://e", "<p>one</p>"), (9, "x", "long " * 50_000),
    *[(100 + i, f"http://hot/{i}", "<p>hot</p>") for i in range(1300)],
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(p, u, h, "x", 0) for p, u, h in PAGES], "page_id long, url string, html string, address string, share int").repartition(3)


def plain(rows, least=0):
    first, out = {}, []
    for page_id, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "")):
        raw = (html or "").encode()
        revisit = len(raw) >= least and raw in first
        first.setdefault(raw, page_id)
        out.append((page_id, len(raw), sha1(raw), "revisit" if revisit else "response", first[raw] if revisit else None))
    return sorted(out, key=repr)


def found(df):
    return sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()], key=repr)


@pytest.mark.parametrize("least", [0, 11])
def test_archive_of_odd_pages(pages, least):
    assert found(web_archive.round_trip(pages, web_archive.Archive(least=least))) == plain(PAGES, least)


def parsed(raw):
    """A plain reader of WARC bytes: (header lines, block) of each record."""
    at, out = 0, []
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        lines = raw[at:end].decode().split("\r\n")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        size = int(fields["Content-Length"])
        assert lines[0] == "WARC/1.1" and raw[end + 4 + size :][:4] == b"\r\n\r\n"
        out.append((fields, raw[end + 4 : end + 4 + size]))
        at = end + 8 + size
    return out


def test_records_are_a_warc_file(spark, pages, tmp_path):
    path = str(tmp_path / "archive")
    web_archive.write(pages, path)
    assert spark.read.parquet(f"{path}/payloads").count() == len({h or "" for _, _, h in PAGES})
    records = parsed(b"".join(bytes(r.record) for r in web_archive.records(spark, path).collect()))
    assert len(records) == len(PAGES) and len({f["WARC-Record-ID"] for f, _ in records}) == len(PAGES)
    names = {f["WARC-Record-ID"]: f for f, _ in records}
    for fields, block in records:
        http, payload = block.split(b"\r\n\r\n", 1)
        if fields["WARC-Type"] == "response":
            assert fields["WARC-Payload-Digest"] == "sha1:" + sha1(payload) and f"Content-Length: {len(payload)}" in http.decode()
        else:
            first = names[fields["WARC-Refers-To"]]
            assert payload == b"" and first["WARC-Type"] == "response" and first["WARC-Payload-Digest"] == fields["WARC-Payload-Digest"]
    whole = Counter((r.page_id, bytes(r.payload)) for r in web_archive.originals(spark, path).collect())
    assert whole == Counter((p, (h or "").encode()) for p, _, h in PAGES)


def test_a_changed_payload_stops_the_reader(spark, pages, tmp_path):
    path = str(tmp_path / "archive")
    web_archive.write(pages, path)
    changed = spark.read.parquet(f"{path}/payloads").selectExpr("address", "shares", "encode(concat(decode(payload, 'utf-8'), '!'), 'utf-8') AS payload")
    changed.write.parquet(f"{path}/changed")
    spark.read.parquet(f"{path}/changed").write.mode("overwrite").parquet(f"{path}/payloads")
    with pytest.raises(PythonException, match="has changed"):
        web_archive.read(spark, path).collect()


def test_empty_pages(spark):
    assert web_archive.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


LONG = " ".join(f"word{i}" for i in range(250))
DOCS = [
    (1, LONG, "a"), (2, LONG, "a"), (3, LONG, None), (None, LONG, "a"), (4, None, "b"), (5, "", ""), (6, "UPPER " * 300, "b"), (7, LONG + " 5%", "b"), (8, "x|y", "a"),
    (9, LONG + " \x0b\x0c é é", "a"), (9, LONG + " \x0b\x0c é é", "a"), (9, "short", "b"), (10, "again " * 100_000, "a"), (11, "only one", "a"), (11, "only one", "b"), (12, "only one", "b"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (3, None, None), (None, 1, 1), (8, 0, 1), (9, 1, 0), (12, 1, 1)]


def plain_audit(docs, labels):
    import re

    good, toxic = {d for d, q, _ in labels if d is not None and q == 1}, {d for d, _, t in labels if d is not None and t == 1}
    first = {}
    for d, t, _ in docs:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    rows = []
    for d, t, s in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search(r"[#$%&*|]", t)), d is not None and d > first[t])
        rows.append((s or "", dict(zip("ABCDE", fails)), d in good, d in toxic))
    removed_in_all, out = Counter(), {}
    for part in {r[0] for r in rows}:
        for order in map("".join, permutations("ABCDE")):
            left = [r for r in rows if r[0] == part]
            every = list(left)
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                removed_in_all[part, f] += len(gone)
                fails = sum(r[1][f] for r in every)
                only = sum(r[1][f] and sum(r[1].values()) == 1 for r in every)
                out[part, order, step] = [len(left), len(gone), fails - len(gone), only, sum(r[2] for r in gone), sum(r[3] for r in gone)]
    return {k: (*v, removed_in_all[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_of_odd_tables(spark):
    docs = spark.createDataFrame([(d, t, s, 1, 2, 3) for d, t, s in DOCS], "doc_id long, text string, source string, part int, mask int, quality int").repartition(3)
    labels = spark.createDataFrame([(*x, "q") for x in LABELS], "doc_id long, quality int, toxic int, source string")
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in filter_audit.audit(docs, labels).collect()}
    assert got == plain_audit(DOCS, LABELS)


def test_audit_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert filter_audit.audit(empty, spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")).collect() == []
