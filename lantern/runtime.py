"""Session settings and lineage cutting shared by all operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Sequence
from functools import reduce
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def session(app: str = "lantern", cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings that the operators are tested under."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; where none is set, a temporary one in local mode and an error on a cluster."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current is None:
        current = spark.conf.get("spark.checkpoint.dir", None)
        if current is None:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            current = tempfile.mkdtemp(prefix="lantern-checkpoint-")
            atexit.register(shutil.rmtree, current, ignore_errors=True)
        context.setCheckpointDir(current)
    return current


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint, so lost executors cost no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: a cut whose readers take single columns."""
    spark = df.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/table-{uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def lookup(rows: DataFrame, small: DataFrame, on: str, most: int = 200_000, how: str = "left") -> DataFrame:
    """``rows`` joined with ``small``, one row per key, under the condition ``on``.

    Up to ``most`` rows, which bounds its size, ``small`` is broadcast and no key is dealt to one
    task. Beyond that both sides are shuffled, and the adaptive plan splits a key with many rows.
    """
    if small.limit(most + 1).count() <= most:
        small = F.broadcast(small)
    return rows.join(small, F.expr(on), how)


def dealt_by(df: DataFrame, *keys: str, rows: int, task_rows: int = 500_000) -> DataFrame:
    """``df`` dealt by ``keys`` to a task for about ``task_rows`` of ``rows`` rows, if those are more tasks than the session's own number, which doesn't follow the rows."""
    tasks = min(100_000, -(-rows // task_rows))
    return df.repartition(tasks, *keys) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def in_order(df: DataFrame, *order: str, name: str) -> DataFrame:
    """``df`` with ``name``: 1 for the first row by ``order``, and so on without gaps.

    Rows are sorted in ranges, which are checkpointed and numbered on their own; the starts of the
    ranges, one row each, are broadcast. So no task gets all rows.
    """
    placed = cut(df.sort(*order)).withColumn("__at", F.spark_partition_id()).withColumn("__in", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33))
    sizes = placed.groupBy("__at").agg(F.count("*").alias("__n"))
    starts = sizes.select(F.col("__at").alias("__range"), F.coalesce(F.sum("__n").over(Window.orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    numbered = placed.join(F.broadcast(starts), F.col("__at") == F.col("__range"))
    return numbered.withColumn(name, F.col("__start") + F.col("__in") + 1).drop("__at", "__in", "__range", "__start")


def in_cells(df: DataFrame, keys: Sequence[str], order: Sequence[str], before: int, cell_rows: int = 50_000) -> DataFrame:
    """``df`` dealt to ``__cell``s of ``cell_rows`` rows in order of keys and ``order``, numbered by ``__i``; ``__own`` marks a row in its own cell.

    A cell also gets the ``before`` rows ahead of it. So a frame of that many rows before a row, over
    the keys and the cell, is the row's frame over its key, and no task gets a key.
    """
    numbered = in_order(df, *keys, *order, name="__i")
    home, last = F.floor(F.col("__i") / cell_rows), F.floor((F.col("__i") + before) / cell_rows)
    return numbered.withColumn("__home", home).withColumn("__cell", F.explode(F.sequence(home, last))).withColumn("__own", F.col("__home") == F.col("__cell")).drop("__home")


def sum_before(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str, cell_rows: int = 50_000) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the rows of the key before this one, 0 for the first; nulls count as 0, a null key is a key.

    Cells of consecutive rows are summed, and the sums of a key's cells, a row each, are carried on.
    """
    rows = in_cells(df.withColumn("__v", F.coalesce(value, F.lit(0))), keys, order, 0, cell_rows)
    carried = rows.groupBy(*keys, "__cell").agg(F.sum("__v").alias("__s"))
    carried = carried.withColumn("__s", F.coalesce(F.sum("__s").over(Window.partitionBy(*keys).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = [f"__k{i}" for i in range(len(keys))]
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(o)) for k, o in zip(keys, own, strict=True)], F.col("__cell") == F.col("__c"))
    inside = Window.partitionBy(*keys, "__cell").orderBy("__i").rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(carried.toDF(*own, "__c", "__s"), on)
    return joined.withColumn(name, F.col("__s") + F.coalesce(F.sum("__v").over(inside), F.lit(0))).select(*df.columns, name)


def pairs_in_blocks(rows: DataFrame, keys: Sequence[str], left: str, right: str, row_id: str, most: int = 2_000, task_pairs: int = 20_000_000) -> DataFrame:
    """Each pair of ``rows`` of one key in each order, as structs ``left`` and ``right`` of all columns; a row also meets itself.

    A key of more than ``most`` rows is cut into cells by a hash of ``row_id``, and each pair of cells is a
    key of the join, so a task gets two cells of a key at a time and never the key. There is a task for about
    ``task_pairs`` pairs: the plan's own number would follow the rows, which are few beside their pairs.
    """
    counts = rows.groupBy(*keys).agg(F.ceil(F.count("*") / most).alias("__cells"))
    celled = rows.join(counts, list(keys)).select(*keys, F.struct(*[rows[c] for c in rows.columns]).alias("__row"), F.pmod(F.xxhash64(rows[row_id]), F.col("__cells")).alias("__cell"), "__cells")
    other = celled.withColumn("__other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__cells") - 1)))
    placed = other.select(*keys, "__row", "__cell", F.least("__cell", "__other").alias("__low"), F.greatest("__cell", "__other").alias("__high"))
    pairs = rows.groupBy(*keys).agg(F.count("*").cast("double").alias("n")).agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0.0
    if pairs > task_pairs:
        placed = placed.repartition(min(100_000, int(pairs / task_pairs) + 1), *keys, "__low", "__high")
    one, two = placed.withColumnsRenamed({"__row": left, "__cell": "__a"}), placed.withColumnsRenamed({"__row": right, "__cell": "__b"})
    # Rows of one cell meet in the block of that cell with itself alone.
    return one.join(two, [*keys, "__low", "__high"]).where((F.col("__a") == F.col("__b")) == (F.col("__low") == F.col("__high"))).select(left, right)


def small_batches(spark: SparkSession, rows: int = 250) -> None:
    """Rows of long texts go to Python in batches of at most ``rows``, so that a worker's memory doesn't follow the text's length times thousands.

    The session keeps the setting, as Spark reads it only when the frames that operators return are run.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))
