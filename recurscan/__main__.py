"""Detection from the command line: python -m recurscan PROJECT --index DIR [--corpus DIR --rebuild] --out DIR."""

from __future__ import annotations

import argparse
import os

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .config import Config
from .plans.detect import Index, build_index, detect
from .scratch import tables
from .sources import code, sinks


def arguments(given: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="recurscan", description="Find functions of a project that look like known vulnerable ones.")
    p.add_argument("project", help="folder of the project's sources")
    p.add_argument("--index", required=True, help="folder of the corpus' index; made if there is none")
    p.add_argument("--corpus", help="folder of the corpus (software/CVE/name.vul), to make the index from")
    p.add_argument("--rebuild", nargs="*", default=[], choices=["index", "target"], help="what to make anew")
    p.add_argument("--restore-processed", help="folder of the project's purified functions; written if there is none")
    p.add_argument("--config", help="YAML file of settings; written with the defaults if there is none")
    p.add_argument("--out", required=True, help="folder of the results")
    return p.parse_args(given)


def exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
        return True
    except AnalysisException:
        return False


def config_of(path: str | None) -> Config:
    if path and not os.path.exists(path):
        with open(path, "w") as f:
            f.write(Config().to_yaml())
    return Config.from_yaml(open(path).read()) if path else Config()


def run(spark: SparkSession, a: argparse.Namespace) -> None:
    c = config_of(a.config)
    with tables(spark):
        if "index" in a.rebuild or not exists(spark, f"{a.index}/vulnerable"):
            if not a.corpus:
                raise SystemExit("no index yet: --corpus is needed to make it")
            known = code.read_corpus(spark, a.corpus).withColumn("key", F.concat_ws("_", "commit", "file", "version", "func"))
            build_index(known.select("id", "cve", "key", "tag", "code")).save(a.index)
        kept = a.restore_processed
        if kept is None:
            targets = code.read_project(spark, a.project, c.skip_loc_threshold)
        else:
            if "target" in a.rebuild or not exists(spark, kept):
                sinks.write_functions(code.read_project(spark, a.project, c.skip_loc_threshold), kept)
            targets = spark.read.parquet(kept)
        found = detect(spark, targets.select(F.col("func_id").alias("id"), "code"), Index.load(spark, a.index), c)
        sinks.write_records(found.records, found.totals, a.out)
        sinks.write_trace(found.trace, f"{a.out}/trace")
        sinks.write_counters(found.counters, f"{a.out}/info")
    for r in spark.read.json(f"{a.out}/info").collect():  # a row for each stage
        print(f"{r['stage']}: {r['passed']}/{r['input']} ({r['filtered']} % filtered, {r['rate']} functions a second)")


if __name__ == "__main__":
    run(SparkSession.builder.appName("recurscan").getOrCreate(), arguments())
