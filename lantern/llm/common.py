"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lantern.runtime import lookup as lookup

#: Fixed: a word is a run of bytes other than blank and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(*parts: Column, seed: int = 0) -> Column:
    """A draw from [0, 1) that depends on nothing but ``parts`` and ``seed``."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *parts), 11) / F.lit(float(1 << 53))


def ranked(df: DataFrame, group: str, order: list[str], slot: str, rows_per_cell: int = 20_000) -> DataFrame:
    """``df`` with ``slot``: a gapless number from 0 inside each ``group``, ordered by hashed cell and ``order``.

    A group of any size is cut into cells by a hash of ``order``, numbered cell by cell, and the
    cells' offsets are summed over the small table of counts; no task gets a whole group. The
    number of cells follows the number of rows. Rows equal in ``order`` share a cell, and any of
    them may come first.
    """
    cells = max(16, -(-df.count() // rows_per_cell))
    celled = df.withColumn("__cell", F.pmod(F.xxhash64(*order), F.lit(cells)).cast("int"))
    counts = celled.groupBy(F.col(group).alias("__group"), F.col("__cell").alias("__at")).agg(F.count("*").alias("__n"))
    # Two levels of sums, as one window over all cells of a group would be one task's work.
    wide = max(4, int(cells**0.5))
    counts = counts.withColumn("__block", F.floor(F.col("__at") / wide))
    inner = Window.partitionBy("__group", "__block").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("__group").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = counts.groupBy("__group", "__block").agg(F.sum("__n").alias("__m"))
    blocks = blocks.withColumn("__base", F.coalesce(F.sum("__m").over(outer), F.lit(0))).drop("__m")
    starts = (
        counts.withColumn("__in", F.coalesce(F.sum("__n").over(inner), F.lit(0)))
        .join(blocks.withColumnRenamed("__group", "__g").withColumnRenamed("__block", "__b"), F.col("__group").eqNullSafe(F.col("__g")) & (F.col("__block") == F.col("__b")))
        .select("__group", "__at", (F.col("__in") + F.col("__base")).alias("__start"))
    )
    number = F.row_number().over(Window.partitionBy(group, "__cell").orderBy(*order)) - 1
    return (
        celled.withColumn("__number", number)
        .join(starts, F.col(group).eqNullSafe(F.col("__group")) & (F.col("__cell") == F.col("__at")))
        .withColumn(slot, (F.col("__number") + F.col("__start")).cast("long"))
        .drop("__cell", "__group", "__at", "__start", "__number")
    )


def slices(pdf: pd.DataFrame, column: str, limit: int = 1 << 19) -> Iterator[pd.DataFrame]:
    """Runs of rows of about ``limit`` characters of ``column``; a longer text is a run of its own."""
    sizes = pdf[column].map(lambda x: 0 if x is None else len(x)).to_numpy()
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield pdf.iloc[start:i]
            start, total = i, 0
        total += n
    if start < len(pdf):
        yield pdf.iloc[start:]
