"""Substring dedup with difference-cover anchors.

A window is 50 consecutive words. Each word covered by a window that also starts in a document with a smaller id goes.

1. Anchors: windows of 20 words at positions whose remainder by 31 lies in the cover {1, 5, 11, 24, 25, 27}. Any two
   remainders differ by a difference of two cover members, so two equal windows of 50 words, wherever they start, hold
   one anchor at the same distance from their starts. Only anchors that two documents share go on.
2. Extension: the windows of 50 words around shared anchors are hashed (96 bits) and the smallest id of each is found.
3. The words of windows with a smaller id elsewhere are removed.

Before each shuffle by hash, a slice of a task's texts is combined: what the slice itself decides (an anchor that it shares,
a window that it also has under a smaller id) goes on as decided, under a spread key, and one row per hash and slice asks
or tells the others. A task remembers which hashes its earlier slices decided and neither asks nor tells about them again. So a passage
in a third of all documents sends a few rows per task, not a row per document. A hash that a document has
many times goes on once for the document, marked as MANY, and is found again in the text by the next step: so a document of
one word over and over is one row.

Null texts count as empty. Rows without an id keep all their words and take none from others. Rows of one id take no words
from each other. An empty table gives no rows. Other columns are passed on; where they clash with the results' names, the
results win. Very long texts are read whole; ties need no order, as only ids are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words
from .common import mix, small_batches, tables, tidied, written

SIZE, PERIOD, COVER = 50, 31, (1, 5, 11, 24, 25, 27)
ASK, DECIDED, TELL = 0, 1, 2
MANY = 8
KNOWN = 1 << 16
_IN = np.zeros(PERIOD, bool)
_IN[list(COVER)] = True


def _marks(w: words.Words) -> np.ndarray:
    """16 bits of each text's words, so that rows of one id with different texts are told apart."""
    place = np.arange(len(w.hash), dtype=np.uint64) - np.repeat(w.first[:-1], np.diff(w.first)).astype(np.uint64)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(w.hash + place))))
    return (mix(total[w.first[1:]] - total[w.first[:-1]]) >> np.uint64(48)).astype(np.int64)


def _pack(pos: np.ndarray, mark: np.ndarray, state: np.ndarray | int) -> np.ndarray:
    return (pos << 20) | (mark << 4) | state


def _first(doc: np.ndarray, *hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each document's equal hashes the first one, and MANY where there are more."""
    order, lead = _runs((*hashes, doc))
    more = np.diff(np.append(lead, len(order))) > 1
    first = order[lead]
    keep = np.argsort(first, kind="stable")
    return first[keep], np.where(more[keep], MANY, 0)


def _again(h: np.ndarray, at: np.ndarray, doc: np.ndarray, hits: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The places `at` whose document has a hit of the same hash; hits and their documents `own`."""
    name = lambda place, d: mix(h[place] + mix(d.astype(np.uint64) + np.uint64(1)))
    return at[np.isin(name(at, doc), name(hits, own))] if len(hits) else hits


def _spread(ids: np.ndarray, pos: np.ndarray) -> np.ndarray:
    return mix(ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + pos.astype(np.uint64))


def _runs(order_keys: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Sort order by keys (the last one first) and where each run of equal keys begins."""
    order = np.lexsort(order_keys) if len(order_keys) > 1 else np.argsort(order_keys[0], kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in order_keys])
    return order, np.flatnonzero(new)


class Known:
    """Hashes that earlier slices of a task found in several documents, and the smallest id of each. Holds `most`, those that come
    again rather than others; one that is forgotten is asked about again, so what is held decides nothing."""

    def __init__(self, most: int = KNOWN):
        self.most = most
        self.h, self.g, self.low, self.times = (np.zeros(0, t) for t in (np.uint64, np.int32, np.int64, np.int64))

    def find(self, h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each hash is held, and whether it is."""
        if not len(self.h):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return at, (self.h[at] == h) & (self.g[at] == g)

    def learn(self, h: np.ndarray, g: np.ndarray, low: np.ndarray) -> None:
        """Takes distinct hashes of a slice."""
        at, old = self.find(h, g)
        self.low[at[old]] = np.minimum(self.low[at[old]], low[old])
        self.times[at[old]] += 1
        worth = np.concatenate((2 * self.times, np.full((~old).sum(), 3)))  # a new one is worth more than one that never came again
        held = [np.concatenate((a, b)) for a, b in ((self.h, h[~old]), (self.g, g[~old]), (self.low, low[~old]), (self.times, np.ones((~old).sum(), np.int64)))]
        if len(worth) > self.most:
            best = np.argpartition(worth, len(worth) - self.most)[len(worth) - self.most :]
            held = [x[best] for x in held]
            held[3] = (held[3] + 1) // 2
        order = np.argsort(held[0], kind="stable")
        self.h, self.g, self.low, self.times = (x[order] for x in held)


def _anchors(size: int):
    length = size - PERIOD + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known()
        for batch in batches:
            for part in words.slices(batch, 1):
                w = words.split(part.column(1))
                count = np.diff(w.first)
                h = words.windows(w.hash, length)
                if not len(h):
                    continue
                doc = np.repeat(np.arange(len(count)), count)[: len(h)]
                pos = np.arange(len(h)) - w.first[doc]
                at = np.flatnonzero(_IN[pos % PERIOD] & (pos + length <= count[doc]) & (count[doc] >= size))
                if not len(at):
                    continue
                first, many = _first(doc[at], h[at])
                at = at[first]
                h, doc, pos = h[at], doc[at], pos[at]
                ids, mark = np.asarray(part.column(0).to_numpy(zero_copy_only=False), np.int64)[doc], _marks(w)[doc]
                order, lead = _runs((h,))
                low, high = np.minimum.reduceat(ids[order], lead), np.maximum.reduceat(ids[order], lead)
                each, both, none = h[order][lead], np.empty(len(h), bool), np.zeros(len(lead), np.int32)
                seen = known.find(each, none)[1]
                shared = seen | (low != high)
                both[order] = np.repeat(shared, np.diff(np.append(lead, len(h))))
                known.learn(each[shared], none[shared], low[shared])
                tell = shared & ~seen  # both ids, as further rows of one of them may be elsewhere
                key = np.concatenate((np.where(both, _spread(ids, pos), h), each[tell], each[tell]))
                v = np.concatenate((_pack(pos, mark, np.where(both, DECIDED, ASK) | many), np.full(2 * tell.sum(), TELL)))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.concatenate((ids, low[tell], high[tell]))), pa.array(v)], ["h", "id", "v"])

    return run


def _windows(size: int):
    length = size - PERIOD + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known()
        for batch in batches:
            for part in words.slices(batch, 1):
                w = words.split(part.column(1))
                count = np.diff(w.first)
                marks = _marks(w)
                hits = part.column(2)
                flat = np.asarray(hits.flatten(), np.int64)
                doc = np.repeat(np.arange(len(count)), np.asarray(hits.value_lengths().fill_null(0)))
                own = (flat >> 4 & 0xFFFF) == marks[doc]
                doc, a, many = doc[own], flat[own] >> 20, (flat[own] & MANY) > 0
                if many.any():  # all other places of these documents with the same anchor
                    h = words.windows(w.hash, length)
                    among = np.flatnonzero(np.isin(np.repeat(np.arange(len(count)), count), doc[many]))
                    among_doc = np.repeat(np.arange(len(count)), count)[among]
                    pos = among - w.first[among_doc]
                    ok = _IN[pos % PERIOD] & (pos + length <= count[among_doc])
                    more = _again(h, among[ok], among_doc[ok], w.first[doc[many]] + a[many], doc[many])
                    more_doc = np.searchsorted(w.first, more, side="right") - 1
                    doc, a = np.concatenate((doc, more_doc)), np.concatenate((a, more - w.first[more_doc]))
                lo, hi = np.maximum(a - (size - length), 0), np.minimum(a, count[doc] - size)
                step = np.zeros(len(w.hash) + 1, np.int64)
                ok = lo <= hi
                np.add.at(step, w.first[doc[ok]] + lo[ok], 1)
                np.add.at(step, w.first[doc[ok]] + hi[ok] + 1, -1)
                at = np.flatnonzero(np.cumsum(step[:-1]) > 0)
                if not len(at):
                    continue
                h, g = words.windows(w.hash, size)[at], (words.windows(mix(w.hash), size)[at] >> np.uint64(32)).astype(np.uint32).view(np.int32)
                doc = np.searchsorted(w.first, at, side="right") - 1
                first, many = _first(doc, g, h)
                at, doc, h, g = at[first], doc[first], h[first], g[first]
                pos, ids, mark = at - w.first[doc], np.asarray(part.column(0).to_numpy(zero_copy_only=False), np.int64)[doc], marks[doc]
                order, lead = _runs((g, h))
                each, of = h[order][lead], g[order][lead]
                least, most = np.minimum.reduceat(ids[order], lead), np.maximum.reduceat(ids[order], lead)
                place, seen = known.find(each, of)
                least[seen] = np.minimum(least[seen], known.low[place[seen]])
                known.learn(each[most > least], of[most > least], least[most > least])
                low = np.empty(len(h), np.int64)
                low[order] = np.repeat(least, np.diff(np.append(lead, len(h))))
                more = ids > low
                key = np.where(more, _spread(ids, pos), h)
                v = _pack(pos, mark, np.where(more, DECIDED, ASK) | many)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(g), pa.array(ids), pa.array(v)], ["h", "g", "id", "v"])

    return run


def _cut(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch, 1):
                w = words.split(part.column(1))
                count = np.diff(w.first)
                marks, hits = _marks(w), part.column(2)
                flat = np.asarray(hits.flatten(), np.int64)
                doc = np.repeat(np.arange(len(count)), np.asarray(hits.value_lengths().fill_null(0)))
                own = ((flat >> 4 & 0xFFFF) == marks[doc]) & ((flat >> 20) + size <= count[doc]) if len(flat) else np.zeros(0, bool)
                at = w.first[doc[own]] + (flat[own] >> 20)
                many = (flat[own] & MANY) > 0
                if many.any():  # all other places of these documents with the same window
                    h = words.windows(w.hash, size) + words.windows(mix(w.hash), size)
                    of = np.repeat(np.arange(len(count)), count)
                    among = np.flatnonzero(np.isin(of, doc[own][many]))
                    among = among[among - w.first[of[among]] + size <= count[of[among]]]
                    at = np.union1d(at, _again(h, among, of[among], at[many], doc[own][many]))
                step = np.zeros(len(w.hash) + 1, np.int64)
                np.add.at(step, at, 1)
                np.add.at(step, at + size, -1)
                gone = np.cumsum(step[:-1]) > 0
                total = np.concatenate(([0], np.cumsum(gone)))
                removed = total[w.first[1:]] - total[w.first[:-1]]
                kept = []
                raw, start, end = w.data.tobytes(), w.start, w.end
                for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
                    live = np.flatnonzero(~gone[a:b]) + a
                    kept.append(b" ".join([raw[s:e] for s, e in zip(start[live].tolist(), end[live].tolist())]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(count.astype(np.int64)), pa.array(removed.astype(np.int64)), *(part.column(i) for i in range(3, part.num_columns))], ["id", "kept", "n_words", "n_removed", *["rest"] * (part.num_columns - 3)])

    return run


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """The rows with text replaced by the words kept, joined by one space, and n_words, n_removed."""
    small_batches(docs.sparkSession)
    with tables(docs.sparkSession):
        return _remove_repeats(docs, key, text, size)


def _remove_repeats(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    others = [c for c in docs.columns if c not in (key, text, "n_words", "n_removed")]
    rest = [F.struct(*others).alias("rest")] if others else []
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), *rest)
    state = F.col("v").bitwiseAND(MANY - 1)

    by = Window.partitionBy("h")
    anchors = rows.where("id is not null").select("id", "text").mapInArrow(tidied(_anchors(size)), "h bigint, id bigint, v bigint")
    shared = anchors.withColumn("lo", F.min("id").over(by)).withColumn("hi", F.max("id").over(by)).where((F.col("lo") < F.col("hi")) | (state == DECIDED)).where(state != TELL)
    hits = written(shared.groupBy("id").agg(F.collect_list("v").alias("hits")), "anchors")

    by = Window.partitionBy("h", "g")
    found = rows.select("id", "text").join(hits, "id").select("id", "text", "hits").mapInArrow(tidied(_windows(size)), "h bigint, g int, id bigint, v bigint")
    gone = found.withColumn("lo", F.min(F.when(state == ASK, F.col("id"))).over(by)).where((state == DECIDED) | (F.col("id") > F.col("lo")))
    gone = written(gone.groupBy("id").agg(F.collect_list("v").alias("gone")), "windows", keep=True)

    kind = f", rest {rows.schema['rest'].dataType.simpleString()}" if others else ""
    joined = rows.join(gone, "id", "left").select("id", "text", "gone", *["rest"] * bool(others))
    out = joined.mapInArrow(tidied(_cut(size)), f"id bigint, kept string, n_words bigint, n_removed bigint{kind}")
    order = [F.col("id").alias(key) if c == key else F.col("kept").alias(text) if c == text else F.col("rest")[c].alias(c) for c in docs.columns if c in (key, text, *others)]
    return out.select(*order, "n_words", "n_removed")
