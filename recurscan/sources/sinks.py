"""What a detection run writes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_records(records: DataFrame, totals: DataFrame, path: str) -> None:
    """Totals (one row, also without records) as JSON in path/summary, records (id, dst, sim) as JSON lines in path/vul."""
    totals.coalesce(1).write.mode("overwrite").json(f"{path}/summary")
    records.select("id", F.col("dst_id").alias("dst"), "sim").write.mode("overwrite").json(f"{path}/vul")


def nested(records: DataFrame, totals: DataFrame) -> DataFrame:
    """One row with the records inside, for results that one machine can hold."""
    vul = records.agg(F.sort_array(F.collect_list(F.struct("id", F.col("dst_id").alias("dst"), "sim"))).alias("vul"))
    return totals.crossJoin(F.broadcast(vul))  # one row with one row


def write_trace(rows: DataFrame, path: str) -> None:
    """target_file, vuln_file, patch_file, detail, predict as CSV; detail as JSON."""
    rows.withColumn("detail", F.to_json("detail")).write.mode("overwrite").option("header", True).csv(path)


def write_counters(counters: DataFrame, path: str) -> None:
    counters.coalesce(1).write.mode("overwrite").json(path)


def write_functions(functions: DataFrame, path: str) -> None:
    functions.write.mode("overwrite").parquet(path)


def write_vectors(vectors: DataFrame, path: str) -> None:
    vectors.write.mode("overwrite").parquet(path)
