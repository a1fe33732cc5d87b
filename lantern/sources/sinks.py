"""Saved models and result sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def save_model(tables: dict[str, DataFrame], path: str) -> None:
    """Each table of a model (baselines, confidences, experience, actions) under ``path``."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")


def load_model(spark: SparkSession, path: str, *names: str) -> dict[str, DataFrame]:
    """The named tables of a saved model."""
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}


def to_epochs(path: str, change: Callable[[DataFrame], DataFrame] = lambda batch: batch) -> Callable[[DataFrame, int], None]:
    """A callback that writes ``change`` of each batch to its own folder ``path/epoch=N``.

    A batch that is run again replaces its folder, so replays leave no row twice. Reading ``path``
    gives all batches with their ``epoch``.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        change(batch).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return write


def epochs(spark: SparkSession, path: str, before: int) -> list[str]:
    """The folders of the batches under ``path`` that come before ``before``."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(root):
        return []
    found = [(int(x.getPath().getName().split("=")[1]), x.getPath().toString()) for x in files.listStatus(root) if x.getPath().getName().startswith("epoch=")]
    return [folder for epoch, folder in sorted(found) if epoch < before]


def for_each_result(stream: DataFrame, *callbacks: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None):
    """Start a stream that hands every micro-batch to each callback; one that fails doesn't keep the others from it.

    The batch is kept while the callbacks run, so it is computed once. When all have run, the first
    failure stops the stream with its error and the batch isn't committed: on restart it goes to all
    callbacks again, so callbacks must stand that, as ``to_epochs`` does.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        failed: list[Exception] = []
        try:
            for callback in callbacks:
                try:
                    callback(batch, epoch)
                except Exception as error:  # noqa: BLE001  raised below, after the others had the batch
                    failed.append(error)
        finally:
            batch.unpersist()
        if failed:
            raise RuntimeError(f"{len(failed)} callbacks failed on batch {epoch}") from failed[0]

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
