"""Channels and their wavelengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planecraft.plans.storage import checked


def place(wave: Column, waves: list[float]) -> Column:
    """A channel's place, from its wavelength (whole nanometres) or its number: the first equal wavelength, else the only one within 1e-6, else the number itself; null if there is none."""
    known = F.array(*[F.lit(float(w)) for w in waves])
    whole = F.floor(wave)
    exact = F.array_position(known, whole.cast("double"))
    close = F.filter(F.transform(known, lambda w, i: F.when(F.abs(w - whole) < 1e-6, i)), lambda i: i.isNotNull())
    return F.when(exact > 0, exact - 1).when(F.size(close) == 1, F.get(close, F.lit(0))).when(whole < len(waves), whole).cast("long")


def of(number: Column, waves: list[float]) -> Column:
    """The wavelength of a number: itself if it is one, else that of the channel of this number."""
    known = F.array(*[F.lit(float(w)) for w in waves])
    return F.when(F.array_contains(known, number.cast("double")), number.cast("double")).otherwise(F.get(known, number.cast("int")))


def repeated(channels: DataFrame, image: str = "image", wave: str = "wave") -> DataFrame:
    """Images in which a wavelength other than 0 stands for two channels."""
    counts = channels.where(F.col(wave) != 0).groupBy(image, wave).agg(F.count("*").alias("n"))
    return counts.groupBy(image).agg(F.max("n").alias("n")).where("n > 1").select(image)


def unmatched(channels: DataFrame, reference, least: int = 2, image: str = "image", wave: str = "wave") -> DataFrame:
    """Images with fewer than `least` channels whose wavelength the reference image has."""
    known = channels.where(F.col(image) == reference).select(wave).distinct()
    shared = channels.join(checked(known.withColumn("_known", F.lit(1)), "waves"), wave, "left")
    return shared.groupBy(image).agg(F.count("_known").alias("n")).where(F.col("n") < least).select(image, "n")
