"""Texts that differ are told apart, whatever their hashes."""

import numpy as np
import pyarrow as pa
import pytest

from planecraft.llm import bpe, compression_rules, near_dup, text_arrays, token_files
from planecraft.llm.encoding import UnitTable, encoder
from planecraft.llm.queries import tokenizer


def thue_morse(k, a="a", b="b"):
    """2**k letters; with a and b in turn such words share every polynomial hash modulo a power of two."""
    for _ in range(k):
        a, b = a + b, b + a
    return a


W, V = thue_morse(10), thue_morse(10, "b", "a")


def test_lines_and_windows_of_regular_words():
    text = f"{W} b c d e\n{V} b c d e\n" + "\n".join(f"w{i} x{i}" for i in range(20))
    twice = f"{W} b c d e x {W} b c d e y {V} b c d e"
    s = next(text_arrays.slices(pa.array([text, twice])))[2]
    found = compression_rules.base_counts(s)
    assert found["n_dup_lines"].tolist() == [0, 0] and found["n_repeat_words"].tolist() == [0, 10]


@pytest.mark.parametrize("name, kind", [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_ids_of_regular_words(name, kind):
    encode = encoder(tokenizer(name), kind)
    texts = [f"see {W} and {V}", f"see {V} and {W}"]
    for text, ids in zip(texts, encode(pa.array(texts))):
        assert ids.tolist() == encode.whole(text).tolist()
    if kind == "byte":
        for text, ids in zip(texts, bpe.backtracking(tokenizer(name))[1](pa.array(texts))):
            assert ids.tolist() == encode.whole(text).tolist()


def test_units_with_one_hash_are_encoded_each():
    table = UnitTable(lambda units: [np.frombuffer(u, np.uint8).astype(np.uint32) for u in units], 4)
    data = np.frombuffer(b"one two one three", np.uint8)
    starts, ends = np.array([0, 4, 8, 12]), np.array([3, 7, 11, 17])
    for _ in range(2):
        ids, counts = table.look_up(data, starts, ends, np.full(4, 99, np.uint64))
        assert bytes(ids.astype(np.uint8)) == b"onetwoonethree" and counts.tolist() == [3, 3, 3, 5]


def test_ranks_with_one_hash():
    data = np.frombuffer(b"ab ab ac abc ac" + b"x" * 200_000, np.uint8)
    starts, ends = np.array([0, 3, 6, 9, 13, 15, 16]), np.array([2, 5, 8, 12, 15, 150_015, 150_016])
    number = text_arrays.ranks(data, starts, ends, np.zeros(7, np.uint64)).tolist()
    assert number[0] == number[1] and number[2] == number[4] and number[5] == number[6] and len(set(number)) == 4


def test_ids_take_the_bytes_that_the_vocabulary_needs():
    form = token_files.Format()
    assert form.holding(65_535).id_bytes == 2 and form.holding(65_536).id_bytes == 4
    with pytest.raises(ValueError):
        token_files.Format(id_bytes=2).holding(70_000)


def test_masks_and_ids_are_views(tmp_path):
    path = str(tmp_path / "x.arrow")
    with pa.OSFile(path, "wb") as sink:
        writer = token_files.SequenceWriter(sink, token_files.Format(length=4, rows=2).holding(9))
        writer.add(np.arange(11, dtype=np.uint32))
        writer.close()
    f = token_files.SequenceFile(path)
    assert f.n_tokens() == 11
    for i in range(3):
        ids, mask = f.sequence(i)
        assert not ids.flags.owndata and not mask.flags.owndata and ids[mask].tolist() == list(range(4 * i, min(11, 4 * i + 4)))


def varied(n, edits, seed, words=120):
    """n texts, each the same words with some changed."""
    rng = np.random.default_rng(seed)
    base = [f"s{seed}w{i}" for i in range(words)]
    out = []
    for i in range(n):
        x = list(base)
        for j in rng.choice(words, edits, replace=False):
            x[j] = f"s{seed}e{i}x{j}"
        out.append(" ".join(x))
    return out


def test_every_text_of_a_repeated_doc_id_links(spark):
    one, two = varied(3, 1, 1), varied(3, 1, 2)
    rows = [(3, one[0]), (3, two[0]), (1, one[1]), (2, two[1]), (7, one[2]), (9, two[2]), (5, "alone here")]
    expected = {1: 1, 2: 1, 3: 1, 7: 1, 9: 1, 5: 5}
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string").repartition(3)
        found = near_dup.classes(docs)
        assert {r.doc_id: r.class_id for r in found.collect()} == expected and found.count() == 7
        assert sorted(r.doc_id for r in near_dup.keep(docs).collect()) == [1, 5]
    least = spark.createDataFrame([(1, one[0]), (1, two[0]), (1, one[0]), (4, two[1])], "doc_id long, text string")
    assert [tuple(r) for r in near_dup.keep(least).collect()] == [(1, one[0])]


def test_many_repeated_doc_ids_need_no_nested_loop(spark):
    """5,000 documents of two texts each: a chain of ten documents shares texts with the next one's."""
    rows = [(i, f"text {i // 10 * 10 + (i + k) % 10} of {i // 10} in a chain of documents") for i in range(5000) for k in (0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plans = []
    listed = near_dup.stored

    def seen(df, what):
        plans.append(df._jdf.queryExecution().toString())
        return listed(df, what)

    near_dup.stored = seen
    try:
        found = near_dup.classes(docs)
        plans.append(found._jdf.queryExecution().toString())
        classes = {r.doc_id: r.class_id for r in found.collect()}
    finally:
        near_dup.stored = listed
    assert all(classes[i] == i // 10 * 10 for i in range(5000))
    assert not any("NestedLoop" in p for p in plans)
