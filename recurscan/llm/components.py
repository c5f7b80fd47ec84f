"""Connected components by alternating large-star and small-star steps.

Links with a null end and links of an id with itself are left out; repeated links count once; no links give no rows. Other
columns are ignored. An end with very many links is no hot key: its minimum is combined before the shuffle and looked up by
operators.joins.lookup.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import lookup
from .common import tables, written


def components(links: DataFrame) -> DataFrame:
    """From links (a, b): one row (id, component) for each end, component being the smallest id that it reaches.

    Each step is a minimum by node (summed before the shuffle) and a join; links only ever move to smaller ends, and their
    number does not grow. Ends when the links form stars.
    """
    with tables(links.sparkSession):
        edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
        edges = written(edges, "links")
        seen = None
        while True:
            state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % (1 << 31)).alias("h")).first()
            if (state["n"], state["h"]) == seen or not state["n"]:
                break
            seen = (state["n"], state["h"])
            both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c")).select("u", F.least("u", "m").alias("m"), "c")
            large = written(lookup(both.where("v > u"), least, ["u"], "c", ["v"], total=2 * state["n"]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "links")
            # every node has links to smaller ones only, so the minimum is taken over few
            least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c"))
            joined = lookup(large, least, ["u"], "c", ["v"], total=state["n"])
            small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
            edges = written(small, "links")
        found = edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        return written(found, "components", keep=True)
