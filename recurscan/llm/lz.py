"""Lempel-Ziv phrase fingerprints.

A text is parsed left to right into LZ78 phrases (the longest known phrase and one more character), the set of phrases is
hashed, and the K smallest hashes are its signature. Texts that compress well together share phrases; the share of common
values among the K smallest of two signatures' union estimates the Jaccard index of their phrase sets.

A null text counts as empty; an empty text has the empty fingerprint, which is like another empty one (1.0) and like nothing
else (0.0). Equal texts have equal fingerprints. Rows without an id come last in the order of documents, rows of one id
in the order of their texts; an only row is its own next. Very long texts are parsed whole. Further columns are ignored; kept ones
named n_chars or fingerprint give way to the results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, own_columns, small_batches, tidied

K = 64
LOWEST = -(1 << 63)


def _extend(text: str, root: dict, node: dict, at: int, journal: list | None = None) -> tuple[list[int], dict]:
    """Parse on from a state; returns the ends of the new phrases and the node reached within an unfinished one."""
    ends: list[int] = []
    end = ends.append
    if journal is None:
        for at, ch in enumerate(text, at + 1):
            to = node.get(ch)
            if to is None:
                node[ch] = {}
                node = root
                end(at)
            else:
                node = to
    else:
        for at, ch in enumerate(text, at + 1):
            to = node.get(ch)
            if to is None:
                node[ch] = {}
                journal.append((node, ch))
                node = root
                end(at)
            else:
                node = to
    return ends, node


def _signature(text: str, ends: list[int], k: int) -> list[int]:
    """The k smallest 32-bit hashes of the phrases that end there."""
    if not ends:
        return []
    stop = np.array(ends, dtype=np.int64)
    start = np.concatenate(([0], stop[:-1]))
    points = np.frombuffer(text[: ends[-1]].encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    place = (np.arange(ends[-1]) - np.repeat(start, stop - start)).astype(np.uint64)
    h = mix(points * np.uint64(0x9E3779B97F4A7C15) + place * np.uint64(0xC2B2AE3D27D4EB4F))
    h = mix(np.add.reduceat(h, start)) >> np.uint64(32)
    return np.unique(h)[:k].tolist()


def signature(text: str, k: int = K) -> list[int]:
    root: dict = {}
    return _signature(text, _extend(text, root, root, 0)[0], k)


def signatures_with_edit(text: str, cut: int, tail: str, k: int = K) -> tuple[list[int], list[int]]:
    """Signatures of text and of text[:cut] + tail; what both begin with is parsed once."""
    root: dict = {}
    head, node = _extend(text[:cut], root, root, 0)
    journal: list = []
    own = head + _extend(text[cut:], root, node, cut, journal)[0]
    for at, ch in reversed(journal):
        del at[ch]
    edited = text[:cut] + tail
    return _signature(text, own, k), _signature(edited, head + _extend(tail, root, node, cut)[0], k)


def to_text(sig: list[int]) -> str:
    return np.array(sig, dtype=">u4").tobytes().hex()


def likeness(a: list[int], b: list[int], k: int = K) -> float:
    if not a or not b:
        return float(a == b)
    x, y = set(a), set(b)
    least = sorted(x | y)[:k]
    both = x & y
    return sum(v in both for v in least) / len(least)


def fingerprint(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), k: int = K) -> DataFrame:
    """The kept columns, n_chars and the fingerprint of each row's text."""
    small_batches(docs.sparkSession)
    keep = own_columns(keep, ("n_chars", "fingerprint"))
    kept = docs.select(*keep, F.coalesce(docs[text], F.lit("")).alias("__text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]] + ["n_chars bigint", "fingerprint string"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            made = [(len(t), to_text(signature(t, k))) for t in (x.as_py() for x in texts)]
            own = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*own, pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.string())], [*keep, "n_chars", "fingerprint"])

    return kept.mapInArrow(tidied(run), ", ".join(fields))


def compare_with_next(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, share: int = 3) -> DataFrame:
    """Fingerprints of each text, of its edited text, and their likeness; see the columns below.

    The edited text has its last floor(n_chars / share) characters replaced by as many first ones of the next row, in
    descending order of the key; after the last row comes the first. Rows are dealt to ranges of the key (bounds from
    approximate quantiles; only the bounds and one id for each range reach the driver); each range also gets the first
    row of the one below it, so a text moves once and no task sees more than its range.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("o", F.coalesce("id", F.lit(LOWEST)))
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.select(F.percentile_approx("o", [i / n for i in range(1, n)], 10 * n).alias("q")).first()["q"] or []
    bounds = np.unique(np.array(cuts, dtype=np.int64))

    @F.pandas_udf("int")
    def bucket(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.to_numpy(), side="left").astype(np.int32))

    dealt = rows.withColumn("b", bucket("o"))
    heads = sorted(tuple(r) for r in rows.select("o").withColumn("b", bucket("o")).groupBy("b").agg(F.max("o")).collect())
    goes = [(heads[i - 1][1], heads[i][0]) for i in range(len(heads))]  # the first row of a range follows the last of the range above; the top one the very last
    to = F.broadcast(spark.createDataFrame(goes, "o long, to int"))  # one row for each range
    ghosts = rows.join(to, "o").groupBy("o", "to").agg(F.min("t").alias("t")).select(F.lit(None).cast("long").alias("id"), "t", "o", F.col("to").alias("b"))
    both = dealt.withColumn("g", F.lit(False)).unionByName(ghosts.withColumn("g", F.lit(True)))
    ordered = both.repartition(n // 2, "b").sortWithinPartitions("b", "g", F.desc("o"), "t")
    names = [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # (id, text): its next is not known yet
        waiting = None  # (row, signature): its next one's signature is not known yet
        out: list[tuple] = []
        for batch in batches:
            for id_, t, ghost in zip(batch.column(0), batch.column(1), batch.column(4)):
                id_, t, ghost = id_.as_py(), t.as_py(), ghost.as_py()
                if before is not None:
                    cut = len(before[1]) - len(before[1]) // share
                    tail = t[: len(before[1]) // share]
                    own, edited = signatures_with_edit(before[1], cut, tail, k)
                    if waiting is not None:
                        out.append((*waiting[0], likeness(waiting[1], own, k)))
                    sha = hashlib.sha256((before[1][:cut] + tail).encode()).hexdigest()
                    waiting = ((before[0], len(before[1]), sha, to_text(own), to_text(edited), likeness(own, edited, k)), own)
                before = (id_, t)
                if ghost:
                    out.append((*waiting[0], likeness(waiting[1], signature(t, k), k)))
                    before = waiting = None
                if len(out) >= 1000:
                    yield _batch(out, names)
                    out = []
        if out:
            yield _batch(out, names)

    return ordered.select("id", "t", "o", "b", "g").mapInArrow(tidied(run), f"`{key}` bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
