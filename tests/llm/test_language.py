"""Language profiles against a plain version, and too many languages."""

from collections import Counter
import zlib

import pytest

from planecraft.llm import language_id


def plain_grams(texts):
    """n-grams as tuples of letters and None for a boundary."""
    n = Counter()
    for text in texts:
        x = [None]
        for c in text:
            low = c.lower() if c.isalpha() else None
            low = c if low and len(low) > 1 else low
            if low or x[-1]:
                x.append(low)
        if x[-1]:
            x.append(None)
        if len(x) > 1:
            for k in (1, 2, 3):
                n.update(g for g in zip(*(x[i:] for i in range(k))) if g != (None,))
    return n


def order(n, most):
    code = lambda g: sum((1 if c is None else ord(c) + 2) << (21 * (len(g) - 1 - i)) for i, c in enumerate(g))
    return [g for g, _ in sorted(n.items(), key=lambda e: (-e[1], code(e[0])))[:most]]


def test_predictions_match_a_plain_version(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", "text", "lang").collect()
    out = lambda d: zlib.crc32(str(d).encode()) % 4 == 2
    langs = sorted({r.lang for r in rows if r.lang})
    ranks = {v: {g: i for i, g in enumerate(order(plain_grams([r.text for r in rows if r.lang == v and r.text is not None and not out(r.doc_id)]), 400))} for v in langs}
    want = {}
    for r in rows:
        own = order(plain_grams([r.text or ""]), 300)
        apart = {v: sum(abs(i - p[g]) if g in p else 400 for i, g in enumerate(own)) for v, p in ranks.items()}
        best = min(langs, key=lambda v: (apart[v], v))
        want[r.doc_id] = (out(r.doc_id), best, pytest.approx(1 - apart[best] / (400 * len(own)))) if own else (out(r.doc_id), "und", 0.0)
    got = {r.doc_id: (r.held_out, r.lang_pred, r.score) for r in language_id.predict(docs).collect()}
    assert got == want


def test_too_many_languages(spark):
    docs = spark.createDataFrame([(i, f"word{chr(97 + i % 26)}", f"l{i}") for i in range(40)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError):
        language_id.predict(docs, language_id.Profiles(most_langs=5))
