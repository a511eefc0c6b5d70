"""Numbers and sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def binary_text(x: Column, count: int = 8) -> Column:
    """The lowest `count` bits, highest first."""
    return F.lpad(F.bin(x.bitwiseAND(F.lit((1 << count) - 1).cast("long"))), count, "0")


def fibonacci(spark: SparkSession, most: int) -> DataFrame:
    """(nth, value): the Fibonacci numbers up to `most`, from 0."""
    found, pair = [0], (0, 1)
    while pair[1] <= most:
        found.append(pair[1])
        pair = (pair[1], pair[0] + pair[1])
    return spark.createDataFrame(list(enumerate(found)), "nth long, value long")  # some dozen numbers at most


def fibonacci_number(n: Column) -> Column:
    """The nth of them by the closed form, as a double."""
    root = 5**0.5
    return (F.pow(F.lit(1 + root), n) - F.pow(F.lit(1 - root), n)) / (F.pow(F.lit(2.0), n) * root)


def is_prime(n: Column) -> Column:
    """By trial division up to the root."""
    divisors = F.sequence(F.lit(2).cast("long"), F.greatest(F.floor(F.sqrt(n)), F.lit(2).cast("long")))
    return (n >= 2) & ~F.exists(divisors, lambda d: (d < n) & (n % d == 0))


def primes(spark: SparkSession, most: int) -> DataFrame:
    """(prime): all up to `most`, each number tested by itself."""
    return spark.range(2, most + 1).where(is_prime(F.col("id"))).select(F.col("id").alias("prime"))


def prime_factors(n: Column) -> Column:
    """A number's prime factors in order, each as often as it divides the number: those up to its root, and what is left."""
    candidates = F.filter(F.sequence(F.lit(2).cast("long"), F.greatest(F.floor(F.sqrt(n)), F.lit(2).cast("long"))), lambda d: (n % d == 0) & is_prime(d))
    powers = lambda p: F.filter(F.transform(F.sequence(F.lit(1), F.lit(62)), lambda k: F.pow(p.cast("double"), k)), lambda q: (q <= n) & (n % q == 0))
    small = F.flatten(F.transform(candidates, lambda p: F.transform(powers(p), lambda q: p)))
    left = F.floor(n / F.aggregate(small, F.lit(1).cast("long"), lambda a, p: a * p)).cast("long")
    return F.when(left > 1, F.concat(small, F.array(left))).otherwise(small)


def factorial(n: Column) -> Column:
    """Of 0 to 20; null beyond."""
    return F.when(n.between(0, 20), F.factorial(n.cast("int")))


def half_gamma(x: Column) -> Column:
    """The gamma function of 0.5, 1, 1.5 ...; null elsewhere."""
    steps = F.sequence(F.lit(1), F.greatest(F.ceil(x).cast("int") - 1, F.lit(1)))
    # x - 1, x - 2 ... down to the start, which is 1 or the root of pi
    product = F.aggregate(steps, F.lit(1.0), lambda a, k: F.when(x - k > 0, a * (x - k)).otherwise(a))
    start = F.when(x % 1 == 0, 1.0).otherwise(F.sqrt(F.pi()))
    return F.when((x > 0) & ((2 * x) % 1 == 0), product * start)


def indices(spark: SparkSession, *shape: int) -> DataFrame:
    """(i0, i1 ...): all indices of an array in C order."""
    columns, after = [], 1
    for i, n in reversed(list(enumerate(shape))):
        columns.append((F.floor(F.col("id") / after) % n).alias(f"i{i}"))
        after *= n
    return spark.range(after).select(*reversed(columns))
