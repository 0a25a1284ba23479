"""Helpers that several operators of this folder share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
BLANKS = "\t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def whole(text: Column | str) -> Column:
    """The text, with NULL as the empty text."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: Column | str) -> Column:
    """Array of the words: runs of characters other than space and U+0009..U+000D."""
    return F.filter(F.split(F.translate(whole(text), BLANKS, " " * len(BLANKS)), " "), lambda w: w != "")


def count_words(text: Column | str) -> Column:
    return F.size(words(text)).cast("long")


def ascii_lower(text: Column | str) -> Column:
    """A-Z to a-z; every other character stays, unlike ``lower``."""
    return F.translate(F.col(text) if isinstance(text, str) else text, UPPER, LOWER)


def hash_fraction(*parts: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the parts and the seed alone, so reruns agree."""
    named = F.concat_ws("\x1f", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("\x1e")) for p in parts])
    digits = F.substring(F.md5(named), 1, 13)  # 52 bits, the precision of a double
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52))


def running_sums(values: Column, chunk: int = 256) -> Column:
    """For an array of longs, the sum of the elements before each one.

    Appending to an array copies it, so the array is summed in chunks and the chunks are joined:
    the cost stays near-linear for very long arrays.
    """

    def before(part: Column, start: Column) -> Column:
        grown = F.aggregate(
            part, F.array(start), lambda acc, v: F.concat(acc, F.array(F.element_at(acc, -1) + v))
        )
        return F.slice(grown, 1, F.size(part))

    zero = F.lit(0).cast("long")
    count = F.ceil(F.size(values) / F.lit(chunk)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(values, i * chunk + 1, chunk))
    starts = before(F.transform(parts, lambda p: F.aggregate(p, zero, lambda a, v: a + v)), zero)
    summed = F.flatten(F.zip_with(parts, starts, before))
    return F.when(F.size(values) > 0, summed).otherwise(F.array().cast("array<bigint>"))
