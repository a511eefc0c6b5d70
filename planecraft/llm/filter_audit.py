"""Filter interaction audit: five filters over documents, in every order.

Each document's failures are a mask of five bits. Documents are counted by part and mask, which
leaves at most 32 cells a part. The cells are then made long: a row for each cell, order and step.
A running bit-or over the steps of an order says what failed before; conditional sums give what
each step does, and a total over a filter's rows in all orders gives its Shapley value.

Defined results: a null text is empty, a null source is the part of the empty string. A document
without a doc_id is no copy of another, and none is a copy of it. Rows that repeat a doc_id are
documents of their own, and those of the smallest doc_id among equal texts are no copies. Labels
of a doc_id are joined by `or`; null labels, and labels without a doc_id, say nothing. An empty
table gives no rows; other columns are not read. Texts are told apart by SHA-256.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planecraft.plans.storage import stored

FILTERS = "ABCDE"
_SPACE = r"[\x20\x09-\x0D]+"
_COPY = 1 << FILTERS.index("E")


def failures(text: Column) -> Column:
    """The bits of filters A to D that a text fails, A the lowest."""
    words = F.filter(F.split(text, _SPACE), lambda w: w != "")
    n = F.size(words)
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    fails = [n < 200, 100 * F.size(F.array_distinct(words)) < 50 * n, 100 * capitals > 2 * F.length(text), text.rlike(r"[#$%&*|]")]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0)).cast("int")


def cells(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by what they fail.

    A group of copies is aggregated before each shuffle, so it never stands in one place: rows that
    repeat are counted by (doc_id, text), then by text, and only those counts meet the smallest doc_id.
    """
    text = F.coalesce("text", F.lit(""))
    rows = documents.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("text"))
    marked = rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), failures(F.col("text")).alias("own"))
    counted = marked.groupBy("doc_id", "digest", "part", "own").agg(F.count("*").alias("n"))
    said = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("is_good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("is_toxic")
    )
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("is_good", "is_toxic")]
    known = counted.join(said, "doc_id", "left").select("doc_id", "digest", "part", "own", "n", *flags)
    # of one text, part and label: how many rows, how many of its smallest doc_id, how many without a doc_id
    nameless = F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0))
    texts = known.groupBy("digest", "part", "own", "is_good", "is_toxic").agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.coalesce(F.min_by("n", "doc_id"), F.lit(0)).alias("at_least"), nameless.alias("nameless")
    )
    texts = stored(texts, "texts")
    firsts = texts.groupBy("digest").agg(F.min("least").alias("first"), F.sum("n").alias("copies")).where("copies > 1").select("digest", "first")
    held = texts.join(firsts, "digest", "left")
    originals = F.col("nameless") + F.when(F.col("first").isNull() | (F.col("least") == F.col("first")), F.col("at_least")).otherwise(0)
    split = held.select("part", "own", "is_good", "is_toxic", "n", originals.alias("originals"))
    each = F.explode(F.array(F.struct(F.col("own").alias("mask"), F.col("originals").alias("k")), F.struct((F.col("own") + _COPY).alias("mask"), (F.col("n") - F.col("originals")).alias("k"))))
    long = split.select("part", "is_good", "is_toxic", each.alias("c")).select("part", "c.mask", "c.k", "is_good", "is_toxic").where("k > 0")
    of = lambda flag: F.sum(F.when(F.col(flag), F.col("k")).otherwise(0))
    return long.groupBy("part", "mask").agg(F.sum("k").alias("n"), of("is_good").alias("good"), of("is_toxic").alias("toxic"))


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)."""
    orders = F.array(*[F.lit("".join(o)) for o in permutations(FILTERS)])
    width = documents.sparkSession.conf.get("spark.sql.shuffle.partitions")
    # cells grow 600-fold: dealt by a stated number, so that adaptive execution doesn't put them all into one task
    dealt = cells(documents, labels).repartition(int(width), "part", "mask")
    long = dealt.withColumn("filter_order", F.explode(orders)).select("*", F.posexplode(F.array(*[F.substring("filter_order", i + 1, 1) for i in range(len(FILTERS))])).alias("at", "letter"))
    bit = F.element_at(F.create_map(*[x for i, f in enumerate(FILTERS) for x in (F.lit(f), F.lit(1 << i))]), F.col("letter"))
    before = Window.partitionBy("part", "mask", "filter_order").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    run = long.withColumn("own", F.col("mask").bitwiseAND(bit)).withColumn("earlier", F.coalesce(F.bit_or("own").over(before), F.lit(0)))
    alive, fails = F.col("earlier") == 0, F.col("own") != 0
    total = lambda when, what="n": F.sum(F.when(when, F.col(what)).otherwise(0))
    steps = run.groupBy("part", "filter_order", (F.col("at") + 1).cast("int").alias("step"), "letter").agg(
        total(alive & ~fails).alias("kept"),
        total(alive & fails).alias("removed"),
        total(~alive & fails).alias("redundant"),
        total(fails & (F.col("own") == F.col("mask"))).alias("unique_fails"),
        total(alive & fails, "good").alias("good_lost"),
        total(alive & fails, "toxic").alias("toxic_lost"),
    )
    return steps.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "letter"))).drop("letter")


AUDIT_SQL = """
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+') AS pieces FROM documents),
w AS (SELECT *, list_filter(pieces, lambda x: x <> '') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM d),
s AS (SELECT doc_id, max(CAST(coalesce(quality = 1, false) AS INT)) AS good, max(CAST(coalesce(toxic = 1, false) AS INT)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text),
     regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > first, false)] AS fails
  FROM w LEFT JOIN s USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
l AS (SELECT unnest(range(1, 6)) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS seq FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
p AS (SELECT seq, list_reduce(list_transform(seq, lambda x: 'ABCDE'[x]), lambda x, y: x || y) AS filter_order, unnest(range(1, 6)) AS step FROM o),
r AS (SELECT part, filter_order, step, seq[step] AS f, n, good, toxic, fails[seq[step]] AS own, len(list_filter(fails, lambda x: x)) = 1 AS single,
        len(list_filter(seq[1:step - 1], lambda x: fails[x])) > 0 AS gone FROM c, p),
t AS (SELECT part, filter_order, step, f, sum(n) FILTER (NOT gone AND NOT own) AS kept, sum(n) FILTER (NOT gone AND own) AS removed, sum(n) FILTER (gone AND own) AS redundant,
        sum(n) FILTER (own AND single) AS unique_fails, sum(good) FILTER (NOT gone AND own) AS good_lost, sum(toxic) FILTER (NOT gone AND own) AS toxic_lost FROM r GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
  CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(removed) OVER (PARTITION BY part, f), 0) AS BIGINT) AS shapley
FROM t
"""
