"""What the operators share: bounded Arrow batches, shared storage, checked broadcasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planecraft.plans.shipping import ship
from planecraft.plans.storage import scratch, stored  # noqa: F401

#: Rows of an Arrow batch between the JVM and Python; texts may be long.
BATCH_ROWS = 500
#: Rows of 8-byte ids up to which a side is broadcast; beyond it the join shuffles.
BROADCAST_IDS = 500_000


def prepare(spark: SparkSession) -> None:
    """Give executors the package, and lower the rows of an Arrow batch, so that long texts fit into a worker."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key) or 0) not in range(1, BATCH_ROWS + 1):
        spark.conf.set(key, str(BATCH_ROWS))


def partitions(docs: DataFrame, column: str = "text", each: int = 32 << 20, most: int = 100_000) -> int:
    """Partitions for a shuffle of texts, from their bytes: about `each` a partition, a partition for each core at least, and `most` at most."""
    size = docs.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return max(docs.sparkSession.sparkContext.defaultParallelism, min(most, -(-size // each)))


def small_or_shuffled(ids: DataFrame, count: int | None = None) -> DataFrame:
    """Broadcast ids if they are counted to be few; else leave the join to a shuffle."""
    count = ids.count() if count is None else count
    return F.broadcast(ids) if count <= BROADCAST_IDS else ids.hint("merge")


def by_hash(*columns: str) -> list[Column]:
    """A fixed pseudo-random order of rows."""
    return [F.xxhash64(*[F.col(c) for c in columns]), *[F.col(c) for c in columns]]
