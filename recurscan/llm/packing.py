"""Mixture-controlled packing by deficit round-robin over source queues.

Each source has a queue of tokens. Window after window, every queue is entitled to its target share of the window; what a
share leaves as a fraction of a token stays as that queue's deficit for the next window, and a queue that runs dry leaves
its turn to the others. The entitlement after r windows is floor(r * window * weight / sum of weights), so the schedule
is known in closed form: a task finds the place of any token from the queues' lengths alone, and deficits carry across
windows and partitions without any task waiting for another. Sequences are cut from the windows' stream at every
``length`` tokens; what remains at the very end is cut into powers of two, which need no padding.

A null text counts as empty; each document ends with the end id, so an empty one has one token. A null source is a source
of its own. Rows without an id and repeated rows are packed each; rows of one source come in the order of their partitions. Very long
texts fill as many windows as they need. An empty table gives no rows. Other columns, of whatever name, are ignored. Every source has a
queue of its own, however many there are: a table numbers them in the order of their names. Only the queues' lengths are
held by the driver and by each task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ..operators.joins import lookup
from .bpe import load_ranks
from .common import small_batches, tables, tidied, written

WINDOW = 1 << 16
HELD_PLACES = 1 << 20


class Ids:
    """Ids as the JSON file's tokenizer gives them. Latin-1 texts without its special strings go through the same merges'
    rank file, which is four times as fast; the tests show that vocabulary, order of merges and, over all pairs and triples
    of kinds of Latin-1 characters, the splitting are the same. All other texts go through the tokenizer itself."""

    def __init__(self, json_path: str, ranks_path: str | None, pattern: str | None):
        self.tokenizer = Tokenizer.from_file(json_path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=load_ranks(ranks_path), special_tokens={}) if ranks_path else None

    def __call__(self, text: str) -> list[int]:
        if self.fast is not None and not any(s in text for s in self.special):
            try:
                text.encode("latin-1")
                return self.fast.encode_ordinary(text)
            except UnicodeEncodeError:
                pass
        return self.tokenizer.encode(text, add_special_tokens=False).ids


@lru_cache(1)
def _ids(json_path: str, ranks_path: str | None, pattern: str | None) -> Ids:
    return Ids(json_path, ranks_path, pattern)


class Schedule:
    """Where each token of each queue lies in the stream. totals and weights: a number of tokens for each queue."""

    def __init__(self, totals: list[int], weights: list[int], window: int, length: int):
        self.totals, self.weights, self.window, self.length = totals, weights, window, length
        self.all, self.tokens = sum(weights), sum(totals)
        self.held, self.shares = np.array(totals, np.int64), np.array(weights, np.int64)
        self.fits = 0 < self.all < 1 << 42 and max(weights) < 1 << 40
        self.round = lru_cache(max(4, HELD_PLACES // max(1, len(totals))))(self._round)

    def entitled(self, q: int, rounds: int) -> int:
        return min(self.totals[q], rounds * self.window * self.weights[q] // self.all)

    def round_of(self, q: int, k: int) -> int:
        """The window that serves token k of queue q."""
        return -(-(k + 1) * self.all // (self.window * self.weights[q])) - 1

    def entitlements(self, rounds: int) -> np.ndarray:
        """entitled() of every queue."""
        turns, served = divmod(rounds * self.window, max(1, self.all))
        if self.fits and rounds * self.window < 1 << 62:  # served * share in two halves of at most 63 bits
            high, rest = np.divmod(served * (self.shares >> 20), self.all)
            due = turns * self.shares + (high << 20) + ((rest << 20) + served * (self.shares & 0xFFFFF)) // self.all
        else:
            due = np.array([self.entitled(q, rounds) for q in range(len(self.totals))], np.int64)
        return np.minimum(self.held, due)

    def _round(self, r: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """In window r, of every queue: first token, one past its last, and the stream's place of the first."""
        first, last = self.entitlements(r), self.entitlements(r + 1)
        sizes = np.cumsum(last - first)
        return first, last, int(first.sum()) + sizes - (last - first)

    def edge(self, q: int, r: int) -> tuple[int, int, int]:
        """In window r: queue q's first token, one past its last, and the stream's place of the first."""
        return tuple(int(x[q]) for x in self.round(r))

    def sequence(self, place: int) -> tuple[int, int, int]:
        """The sequence of a place of the stream, the offset there, and how many tokens the sequence has (all are full or
        powers of two, so none is padded)."""
        full = self.tokens // self.length
        if place < full * self.length:
            return place // self.length, place % self.length, self.length
        rest, at, s = self.tokens - full * self.length, place - full * self.length, full
        while True:
            size = 1 << (rest.bit_length() - 1)
            if at < size:
                return s, at, size
            rest, at, s = rest - size, at - size, s + 1

    def pieces(self, q: int, start: int, n: int) -> Iterator[tuple[int, int, int, int]]:
        """(offset in the document, length, sequence, offset there) of tokens start .. start + n of queue q."""
        done = 0
        while done < n:
            k = start + done
            first, last, place = self.edge(q, self.round_of(q, k))
            s, at, size = self.sequence(place + k - first)
            take = min(n - done, last - k, size - at)
            yield done, take, s, at
            done += take


def queue_name(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def tokenize(docs: DataFrame, queues: DataFrame, tokenizer: str, ranks: str | None, pattern: str | None, key: str, text: str, source: str, end_id: int) -> DataFrame:
    """Part, queue, key, start of the document in its part of the queue, number of tokens, ids (little-endian, 2 or 4 bytes)."""
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"), queue_name(F.col(source)).alias("s"))
    kept = lookup(rows, queues, ["s"], "c", ["id", "t"]).select("id", "t", "q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ends = TaskContext.get().partitionId(), {}
        ids = _ids(tokenizer, ranks, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                cols: list[list] = [[], [], [], [], []]
                for id_, t, q in zip(*(c.to_pylist() for c in batch.slice(lo, 256).columns)):
                    toks = np.array([*ids(t), end_id], dtype="<u4")
                    at = ends.get(q, 0)
                    ends[q] = at + len(toks)
                    small = toks.max() < 1 << 16
                    for c, v in zip(cols, (id_, q, at, len(toks), (toks.astype("<u2") if small else toks).tobytes())):
                        c.append(v)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(cols[0]), pa.int32()), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["part", "id", "q", "at", "n", "ids"])

    return kept.mapInArrow(tidied(run), "part int, id bigint, q int, at bigint, n bigint, ids binary")


def pack(docs: DataFrame, tokenizer: str, ranks: str | None = None, pattern: str | None = None, key: str = "doc_id", text: str = "text", source: str = "source", end_id: int = 0, length: int = 1024, window: int = WINDOW, weights: dict[str | None, int] | None = None) -> DataFrame:
    """Pieces of documents in sequences: key, start, length, ids (4 bytes each, little-endian), doc_tokens, sequence_id, offset.

    weights: target shares by source (one that is not named has 1); without, each source's share of all
    tokens, so that all queues end with the last window. Tokens are made once and written to the shared folder;
    the second pass adds each part's place in its queues and cuts. Only the queues' lengths reach the driver.
    """
    small_batches(docs.sparkSession)
    with tables(docs.sparkSession):
        return _pack(docs, tokenizer, ranks, pattern, key, text, source, end_id, length, window, weights)


def _pack(docs: DataFrame, tokenizer: str, ranks: str | None, pattern: str | None, key: str, text: str, source: str, end_id: int, length: int, window: int, weights: dict[str | None, int] | None) -> DataFrame:
    names = docs.groupBy(queue_name(F.col(source)).alias("s")).agg(F.count("*").alias("c"))
    queues = written(names.withColumn("q", F.row_number().over(Window.orderBy("s")) - 1), "queues")  # a row for each source
    toks = written(tokenize(docs, queues, tokenizer, ranks, pattern, key, text, source, end_id), "packing", keep=True)
    parts = toks.groupBy("q", "part").agg(F.sum("n").alias("n"))
    totals = {r["q"]: r["n"] for r in parts.groupBy("q").agg(F.sum("n").alias("n")).collect()}
    n_queues = max(totals, default=-1) + 1
    held = [totals.get(q, 0) for q in range(n_queues)]
    shares = held
    if weights is not None:
        asked = {"" if s is None else f"={s}": w for s, w in weights.items()}
        chosen = {r["q"]: asked[r["s"]] for r in queues.where(F.col("s").isin(list(asked))).collect()}
        shares = [max(1, chosen.get(q, 1)) if held[q] else 0 for q in range(n_queues)]
    before = F.coalesce(F.sum("n").over(Window.partitionBy("q").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = written(parts.select("q", "part", before.alias("base")), "packing-base", keep=True)
    names = [key, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = Schedule(held, shares, window, length)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                out: list[tuple] = []
                for id_, q, at, n, raw in zip(*(c.to_pylist() for c in batch.slice(lo, 512).columns)):
                    ids = np.frombuffer(raw, dtype="<u2" if len(raw) == 2 * n else "<u4").astype("<u4")
                    for start, size, s, o in plan.pieces(q, at, n):
                        out.append((id_, start, size, ids[start : start + size].tobytes(), n, s, o))
                if out:
                    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    placed = toks.join(base, ["q", "part"]).select("id", "q", (F.col("at") + F.col("base")).alias("at"), "n", "ids")
    return placed.mapInArrow(tidied(run), f"`{key}` bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint")
