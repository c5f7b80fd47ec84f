"""Detection over a stream of target functions.

Candidates of one target depend on that target alone, so each micro-batch runs the batch cascade. Functions that are delivered again
are dropped by id; all that is available is read, then the query ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..config import Config
from ..plans.detect import Index, detect
from ..scratch import tables


def read_targets(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of id, code from Parquet files."""
    return spark.readStream.schema("id string, code string").option("maxFilesPerTrigger", files_per_batch).parquet(path)


def detect_stream(spark: SparkSession, targets: DataFrame, index: Index, out: str, checkpoint: str, c: Config = Config(), embedder=None) -> StreamingQuery:
    """Writes each batch's records and trace rows below `out`, by batch; a batch that runs again overwrites its own."""

    def run(batch: DataFrame, number: int) -> None:
        with tables(spark):  # nothing of a batch's steps is left behind
            found = detect(spark, batch.where("code <> ''"), index, c, embedder)
            found.records.write.mode("overwrite").parquet(f"{out}/records/batch={number}")
            found.trace.write.mode("overwrite").parquet(f"{out}/trace/batch={number}")

    return targets.dropDuplicates(["id"]).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
