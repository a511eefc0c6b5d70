"""Language identification by rank-order profiles.

A language's profile is its most frequent n-grams of one to three characters, in
order of frequency. A document's own most frequent n-grams are ranked the same way,
and its out-of-place distance to a profile is the sum of the differences in rank; an
n-gram that the profile lacks costs the largest difference. The nearest profile wins.

Profiles are learnt from a bounded sample: of each language, about `docs_per_lang`
documents chosen by the hash of doc_id. Predictions read the whole text and nothing
else. Text is lower case; characters other than letters separate words and count as
one boundary sign.

Defined results: null text, or text without a letter, gives `und` with score 0; so
does every text if nothing can be learnt. Of languages at equal distance the first
in alphabetical order wins. n-grams of equal frequency rank by their characters.
Repeated rows get equal predictions; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planecraft.llm.jobs import prepare, stored

PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double"
SHIFT = np.uint64(21)


@dataclass(frozen=True)
class Profiles:
    """n-grams of a language's and of a document's profile, documents learnt from (about so many of each language), and the most languages that profiles are kept of."""

    of_lang: int = 400
    of_doc: int = 300
    docs_per_lang: int = 2000
    most_langs: int = 10_000


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point its lower case if it is a letter, else 0. Letters whose lower case has two characters stay as they are."""
    table = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


def symbols(text: str) -> np.ndarray:
    """Letters as code point + 2, words apart by one boundary sign, 1, which also begins and ends the text; empty without a letter."""
    x = letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    if not x.any():
        return np.zeros(0, np.uint64)
    x = np.concatenate(([0], x, [0])).astype(np.uint64)
    x = x[np.concatenate(([True], (x[1:] != 0) | (x[:-1] != 0)))]
    return np.where(x > 0, x + np.uint64(2), np.uint64(1))


def ngrams(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different n-grams of one to three symbols (boundaries alone left out), packed into 63 bits, with their counts."""
    two = (x[:-1] << SHIFT) | x[1:]
    three = (two[:-1] << SHIFT) | x[2:]
    found = [np.unique(g, return_counts=True) for g in (x[x > 1], two, three)]
    return np.concatenate([g for g, _ in found]), np.concatenate([n for _, n in found])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, how: Profiles) -> dict[str, np.ndarray]:
    """Each language's n-grams in order of rank."""
    known = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = stored(known.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    if sizes.count() > how.most_langs:
        raise ValueError(f"lang has more than {how.most_langs} values")
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = known.join(F.broadcast(sizes), "lang").where(place * F.col("n") < how.docs_per_lang)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_lang: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                by_lang.setdefault(lang, []).append(symbols(text))
            for lang, parts in by_lang.items():
                grams, counts = ngrams(np.concatenate(parts))
                # two texts' boundary signs side by side are no n-gram of either
                real = (grams & np.uint64((1 << 42) - 1)) != np.uint64((1 << 21) | 1)
                real &= (grams >> SHIFT) != np.uint64((1 << 21) | 1)
                grams, counts = grams[real], counts[real]
                if len(grams):
                    yield pa.RecordBatch.from_pydict({"lang": [lang] * len(grams), "gram": grams.astype(np.int64), "n": counts})

    counts = sample.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= how.of_lang)
    found: dict[str, list] = {}
    for r in top.orderBy("lang", "rank").collect():  # of_lang rows for each language
        found.setdefault(r["lang"], []).append(r["gram"])
    return {lang: np.array(g, np.uint64) for lang, g in sorted(found.items())}


class Judge:
    """Distances to all profiles at once: the ranks of all profiles' n-grams stand in one table."""

    def __init__(self, profiles: dict[str, np.ndarray], how: Profiles):
        self.langs, self.how = list(profiles), how
        self.grams = np.unique(np.concatenate([*profiles.values(), np.zeros(1, np.uint64)]))
        self.ranks = np.full((len(profiles), len(self.grams)), how.of_lang, np.int64)
        for i, g in enumerate(profiles.values()):
            self.ranks[i, np.searchsorted(self.grams, g)] = np.arange(len(g))

    def __call__(self, text: str | None) -> tuple[str, float]:
        x = symbols(text) if text and self.langs else np.zeros(0, np.uint64)
        if not len(x):
            return "und", 0.0
        grams, counts = ngrams(x)
        grams = grams[np.lexsort((grams, -counts))[: self.how.of_doc]]
        at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        known = self.grams[at] == grams
        place = np.arange(len(grams))
        apart = np.where(known, np.abs(self.ranks[:, at] - place), self.how.of_lang)
        apart = np.where(self.ranks[:, at] == self.how.of_lang, self.how.of_lang, apart).sum(1)
        best = int(apart.argmin())
        return self.langs[best], float(1 - apart[best] / (self.how.of_lang * len(grams)))


def predict(docs: DataFrame, how: Profiles = Profiles()) -> DataFrame:
    """The language of every document, by profiles learnt from those that are not held out."""
    prepare(docs.sparkSession)
    profiles = learn(docs, how)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(profiles, how)
        for batch in batches:
            if batch.num_rows:
                found = [judge(t) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").cast(pa.int64()), "held_out": batch.column("held_out"), "lang_pred": [x for x, _ in found], "score": [y for _, y in found]})

    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, PREDICTED)
