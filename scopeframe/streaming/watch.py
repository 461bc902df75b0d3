"""Sources that arrive in a folder are renamed as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.suggest import Renamer
from ..plans.rename import rename


def watch(spark: SparkSession, folder: str, renamer: Renamer, out: str, checkpoint: str, context_size: int = 500, once: bool = True) -> StreamingQuery:
    """Rename each file of ``folder`` once, and append source_id, output and parse_error to Parquet at ``out``. A batch that is
    run again writes over its own part. once: stop when all files that are there are done."""
    files = spark.readStream.schema("value string").option("wholetext", True).text(folder)
    files = files.select(F.col("_metadata.file_path").alias("source_id"), F.col("value").alias("code"))

    def batch(df: DataFrame, number: int) -> None:
        done = rename(df, renamer, context_size, f"{checkpoint}/work")
        done.output.write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
