"""Resumable runs: a file stream taken up where the last run ended, each batch through a function and then appended."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def run_available(spark: SparkSession, source: str, schema: str, work: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, files_at_once: int = 1000) -> None:
    """Takes all new JSON files of a folder through `work` into Parquet at `target`, then stops.

    The checkpoint knows which files are done. Each batch goes to a folder of its own, which a repeated batch overwrites,
    so that no row appears twice after a failure.
    """

    def batch(df: DataFrame, number: int) -> None:
        work(df).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).json(source)
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
