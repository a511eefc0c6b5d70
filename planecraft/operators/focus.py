"""Sections in focus: those of a channel with most detail of middling frequency."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planecraft.operators.fitting import images
from planecraft.plans.shipping import ship
from planecraft.plans.storage import checked, stored

MOST = 512


def detail(image: np.ndarray) -> float:
    """The sum of the plane's amplitudes in a ring of frequencies; a side beyond 512 pixels is read in steps."""
    image = image[:: max(image.shape[0] // MOST, 1), :: max(image.shape[1] // MOST, 1)]
    ny, nx = image.shape
    y, x = np.arange(ny), np.arange(nx // 2 + 1)
    r = np.hypot(np.minimum(y, ny - y)[:, None], x[None, :])
    return float(np.abs(np.fft.rfft2(image))[(r > nx // 10) & (r <= ny // 4)].sum())


def scored(planes: DataFrame) -> DataFrame:
    """(z, w, score) of every plane (z, w, ny, nx, data)."""
    ship(planes.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array([detail(a) for a in images(batch)], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("z"), batch.column("w"), scores], ["z", "w", "score"])

    rows = planes.selectExpr("cast(z as bigint) AS z", "cast(w as bigint) AS w", "ny", "nx", "data")
    return rows.mapInArrow(run, "z long, w long, score double")


def in_focus(planes: DataFrame, sigma: float = 0.5) -> DataFrame:
    """(z, w, score) of the sections whose score is above mean + sigma x deviation of their channel's inner sections.

    A channel's first and last section take no part. Where no section is above, all inner ones
    stay; a channel of up to three sections keeps all. Statistics are a row for each channel.
    """
    rows = stored(scored(planes), "scores")
    ends = checked(rows.groupBy("w").agg(F.min("z").alias("z0"), F.max("z").alias("z1"), F.count("*").alias("n")), "ends", 100_000)
    placed = rows.join(ends, "w")
    inner = placed.where("n > 3 and z > z0 and z < z1")
    least = inner.groupBy("w").agg((F.avg("score") + sigma * F.stddev_pop("score")).alias("least"), F.max("score").alias("top"))
    chosen = inner.join(checked(least, "least", 100_000), "w").where("score > least or top <= least")
    return placed.where("n <= 3").select("z", "w", "score").unionAll(chosen.select("z", "w", "score"))
