"""Texts with more different units than the table of units has slots."""

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from planecraft.llm import encoding
from planecraft.llm.queries import tokenizer


@pytest.mark.parametrize(("name", "kind"), [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_more_units_than_slots(name, kind):
    library = encoding.Library(tokenizer(name), kind)
    encoder = encoding.Encoder(library.units, library.whole)
    encoder.table = encoding.UnitTable(library.units, slot_bits=4)
    text = " ".join(f"w{i}x" for i in range(400)) + "\n" + " ".join(f"w{i}x" for i in range(0, 400, 3))
    plain = Tokenizer.from_file(tokenizer(name))
    plain.no_truncation()
    plain.no_padding()
    for got, whole in zip(encoder(pa.array([text, "", text[:50]])), [text, "", text[:50]]):
        assert got.tolist() == plain.encode(whole, add_special_tokens=False).ids


def test_a_text_of_two_million_different_words_ends():
    library = encoding.Library(tokenizer("byte_bpe_50k.json"), "byte")
    words = np.char.add("q", np.arange(2_200_000).astype(str))
    text = " ".join(words.tolist())
    got = encoding.Encoder(library.units, library.whole)(pa.array([text]))[0]
    assert np.array_equal(got, library.whole(text))
