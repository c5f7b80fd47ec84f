"""N-gram Jaccard join: size-banded tiles, bitmap signatures, exact intersections.

1. Each text becomes the set of its distinct 5-word shingles (64-bit hashes). Texts with one set are one node, so copies cost
   a row each and nothing more.
2. Tiles are banded by size: a node lies in the band of its size and in that of the largest size that it can be linked with (bands
   are wide, so for most nodes these are one). Within a band, nodes that share one of BANDS keys, each of ROWS minima of the set under
   multiplications by fixed odd numbers, share a tile. Two sets of similarity s share none with the chance
   (1 - s**ROWS)**BANDS, 1e-10 at 0.75. A tile is sorted by size, and only sizes within the threshold's ratio meet.
3. In a tile, bitmaps (as wide as the size band needs, folded to the narrower of two) bound the overlap from above:
   each bit of one bitmap that the other lacks is a shingle that the other lacks. Pairs below the threshold by this bound go.
4. Only components are asked for, so not all pairs left need a look. In a first round a tile names the edges of a forest
   over the pairs that look similar enough by their bits; they are checked exactly, on the sorted sets, and joined into
   components. In a last round the tiles name every pair left by the bound whose ends are in different components, and
   these are checked too. So a group of n near copies gives about n pairs, and no link between components is missed.
   links() names every link between distinct sets.
5. A key with more nodes than TILE is dealt into blocks. In the first round each block is a tile by itself; then one
   node of each component in the key stands for it, and these meet in blocks of their own, until that joins no more. The last
   round deals a key's nodes by component: blocks of one and the same component never meet, so a family of n near
   copies costs n / TILE tiles and not their square. Only nodes that stay apart though they share a key are compared all with all.
6. Links are joined into components; a document has the smallest id of its component.

Null and empty texts, and texts without words, have no shingles and are linked with nothing. Rows of one id are one document:
it has the links of each of its texts. A row without an id has its set's component, if a row with an id has the
same set, else none. Very long texts are read whole (a slice of a batch holds about 1 MB of texts, or one text). An empty table
gives no rows. Other columns, of whatever name, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import lookup
from . import words
from .common import mix, small_batches, tables, tidied, written
from .components import components

WORDS, NUM, DEN = 5, 3, 4
ROWS, BANDS = 3, 42
TILE = 1024
BAND = 4  # a size band spans sizes of a factor of 2 ** BAND
SURE = 1.08
ASKED = 1 << 24  # bits of the filter of texts that pairs name
_BY = mix(np.arange(1000, 1000 + ROWS * BANDS, dtype=np.uint64)) | np.uint64(1)
_JOIN = mix(np.arange(5000, 5000 + ROWS, dtype=np.uint64)) | np.uint64(1)


def bands(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The size band of each size, and that of the largest size that it can be linked with."""
    wide = lambda x: np.frexp(x.astype(np.float64))[1] // BAND
    return wide(n), wide(n * DEN // NUM)


def width(n: int) -> int:
    """Bits of the bitmap of a set of that size."""
    return max(64, 1 << (8 * n - 1).bit_length())


def _sketches(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for part in words.slices(batch, 1):
        s, at = words.shingles(words.split(part.column(1), lower=True), WORDS)
        n = np.diff(at)
        full = np.flatnonzero(n)
        f1, f2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
        keys = np.zeros((len(full), BANDS), np.uint64)
        bitmaps: list[bytes] = [b""] * len(n)
        copies = np.zeros(len(n), np.int64)
        if len(full):
            lead = at[:-1][full]
            f1[full], f2[full] = np.add.reduceat(mix(s), lead), np.add.reduceat(mix(s * np.uint64(0xD6E8FEB86659FD93)), lead)
            for b in range(BANDS):
                for r in range(ROWS):
                    keys[:, b] += np.minimum.reduceat(s * _BY[b * ROWS + r], lead) * _JOIN[r]
            low, high = bands(n[full])
            sides = [np.arange(len(full)), np.flatnonzero(high != low)]
            near = np.concatenate(sides)
            order = np.argsort(near, kind="stable")
            band = np.concatenate((low, high[sides[1]]))[order].astype(np.uint64)
            keys = mix(keys[near[order]] + np.arange(BANDS, dtype=np.uint64) + (band * np.uint64(0x9E3779B97F4A7C15))[:, None])
            copies[full] = 1 + (high != low)
            for i in full.tolist():
                bits = np.zeros(width(int(n[i])), np.uint8)
                bits[(s[at[i] : at[i + 1]] & np.uint64(len(bits) - 1)).astype(np.int64)] = 1
                bitmaps[i] = np.packbits(bits, bitorder="little").tobytes()
        offsets = np.concatenate(([0], np.cumsum(BANDS * copies))).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.view(np.int64).ravel()))
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n.astype(np.int64)), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), lists, pa.array(bitmaps, pa.binary())], ["id", "n", "f1", "f2", "keys", "bits"])


def _fold(bits: np.ndarray, words64: int) -> np.ndarray:
    while bits.shape[-1] > words64:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] | bits[..., half:]
    return bits


class Tile:
    """Rows of a tile, sorted by size: ids, sizes, bitmaps."""

    def __init__(self, ids: list[int], n: list[int], bits: list[bytes]):
        self.ids, self.n = np.array(ids, np.int64), np.array(n, np.int64)
        self.maps = [np.frombuffer(b, np.uint64) for b in bits]
        self.wide = np.array([len(m) for m in self.maps])
        self.bands = {int(w): np.flatnonzero(self.wide == w) for w in np.unique(self.wide)}
        self.stacks = {w: np.stack([self.maps[i] for i in at]) for w, at in self.bands.items()}
        self.ones = {w: np.bitwise_count(s).sum(1, dtype=np.int64) for w, s in self.stacks.items()}

    def near(self, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Earlier rows that row i may be linked with, by the bound; their overlaps as the bits suggest, and the least
        overlap for a link."""
        js, guesses = [], []
        n = self.n[i]
        for w in (int(self.wide[i]), int(self.wide[i]) // 2):
            if w not in self.bands:
                continue
            at = self.bands[w]
            lo, hi = np.searchsorted(self.n[at], -(-int(n) * NUM // DEN)), np.searchsorted(at, i)
            if lo >= hi:
                continue
            own, ones = _fold(self.maps[i], w), self.ones[w][lo:hi]
            size, mine = self.n[at[lo:hi]], int(np.bitwise_count(own).sum())
            both = np.bitwise_count(self.stacks[w][lo:hi] & own).sum(1, dtype=np.int64)
            only_i, only_j = mine - both, ones - both
            may = ((DEN + NUM) * np.minimum(n - only_i, size - only_j) >= NUM * (n + size)) & (self.ids[at[lo:hi]] != self.ids[i])
            if may.any():
                free_j, free_i = 1 - ones[may] / (64 * w), 1 - mine / (64 * w)
                js.append(at[lo:hi][may])
                guesses.append(np.minimum(n - only_i[may] / np.maximum(free_j, 0.05), size[may] - only_j[may] / max(free_i, 0.05)))
        if not js:
            none = np.zeros(0, np.int64)
            return none, none, none
        j = np.concatenate(js)
        return j, np.concatenate(guesses), (n + self.n[j]) * NUM / (DEN + NUM)

    def forest(self) -> tuple[list[tuple[int, int]], bool]:
        """Edges of a forest over the pairs that look similar enough, and whether any pair passed the bound."""
        label, out, some = np.arange(len(self.ids)), [], False
        for i in range(1, len(self.ids)):
            j, guess, least = self.near(i)
            some |= len(j) > 0
            likely = guess >= least
            j, sure = j[likely], guess[likely] >= SURE * least[likely]
            # of each group one edge: to the smallest id that looks surely linked (so that tiles agree), else the likeliest
            order = np.lexsort((np.where(sure, self.ids[j], 0), -np.where(sure, np.inf, guess[likely])))
            j = j[order]
            for x in j[np.sort(np.unique(label[j], return_index=True)[1])].tolist():
                if label[x] != label[i]:
                    label[label == label[i]] = label[x]
                    out.append((int(self.ids[x]), int(self.ids[i])))
        return out, some

    def across(self, label: np.ndarray) -> Iterator[tuple[int, int]]:
        """All pairs that pass the bound and whose labels differ."""
        if (label == label[0]).all():
            return
        for i in range(1, len(self.ids)):
            j = self.near(i)[0]
            for x in j[label[j] != label[i]].tolist():
                yield int(self.ids[x]), int(self.ids[i])


def _tiles(first: bool):
    """Over rows (k, i, j, id, n, bits, label) sorted by k, i, j: pairs (a, b); in the first round also (k, i, j) of tiles with any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: set[tuple[int, int]] = set()
        live: list[tuple] = []

        def end(key, rows):
            if len(rows) < 2:
                return
            rows.sort(key=lambda r: (r[1], r[0]))
            tile = Tile([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows])
            if first:
                found, some = tile.forest()
                live.extend([key] if some else [])
            else:
                found = tile.across(np.array([r[3] for r in rows]))
            pairs.update((min(p), max(p)) for p in found)

        def flush():
            cols = [[p[0] for p in pairs] + [None] * len(live), [p[1] for p in pairs] + [None] * len(live), *([None] * len(pairs) + [t[c] for t in live] for c in range(3))]
            pairs.clear(), live.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(),) * 5)], ["a", "b", "k", "i", "j"])

        key, rows = None, []
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                for k, i, j, id_, n, bits, label in zip(*(c.to_pylist() for c in batch.slice(lo, 1000).columns)):
                    if (k, i, j) != key:
                        end(key, rows)
                        key, rows = (k, i, j), []
                    rows.append((id_, n, bits, label))
                if len(pairs) + len(live) > 20_000:
                    yield flush()
        end(key, rows)
        if pairs or live:
            yield flush()

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in words.slices(batch, 1):
            s, at = words.shingles(words.split(part.column(1), lower=True), WORDS)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())], ["id", "s"])


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = []
        for x, y in zip(batch.column(2), batch.column(3)):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            ok.append(both > 0 and DEN * both >= NUM * (len(x) + len(y) - both))
        yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))


def _maybe(texts: DataFrame, ends: DataFrame) -> DataFrame:
    """All texts whose ids are among the ends, and a few others: a Bloom filter with one hash, broadcast as bitmaps of 2 MB in all.
    So texts that no pair names need no shuffle; with more ends than its bits more texts pass, and none is lost."""
    h = F.pmod(F.xxhash64("id"), F.lit(ASKED))
    bucket, bit = F.shiftright(h, 15).alias("__k"), h.bitwiseAND(F.lit(0x7FFF))
    maps = ends.select(bucket, bit.alias("at")).repartition("__k").groupBy("__k").agg(F.bitmap_construct_agg("at").alias("__bits"))
    byte = F.conv(F.hex(F.substr("__bits", (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    asked = texts.withColumn("__k", bucket).join(F.broadcast(maps), "__k")
    return asked.where(F.getbit(byte, bit.bitwiseAND(F.lit(7)).cast("int")) == 1).select(*texts.columns)


def _linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs (a, b), which are a table, whose similarity reaches the threshold, on whole sets."""
    ends = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))
    # an inner join, as a semi-join would be moved below the filter
    sets = _maybe(texts, ends).join(ends.distinct(), "id").select("id", "text").mapInArrow(tidied(_sets), "id bigint, s binary")
    first = pairs.join(sets.select(F.col("id").alias("b"), F.col("s").alias("t")), "b")
    both = first.join(sets.select(F.col("id").alias("a"), "s"), "a").select("a", "b", "s", "t")
    return both.mapInArrow(tidied(_exact), "a bigint, b bigint").distinct()


def _tiled(docs: DataFrame, key: str, text: str, tile: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Texts, their sketches, the nodes, the nodes' keys (k, id, f1, c) that others share, the nodes' bitmaps."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kinds = "id bigint, n bigint, f1 bigint, f2 bigint, keys array<bigint>, bits binary"
    made = written(texts.mapInArrow(tidied(lambda it: (p for b in it for p in _sketches(b))), kinds), "sketches")
    node = written(made.where("n > 0").groupBy("n", "f1", "f2").agg(F.min("id").alias("rep")), "nodes")
    # a node's keys and bitmap come with its smallest id
    nodes = made.where("n > 0 and id is not null").join(node.where("rep is not null"), ["n", "f1", "f2"]).where("id = rep")
    each = nodes.select("id", "f1", F.explode("keys").alias("k"))
    keys = written(each.groupBy("k").agg(F.count("*").alias("c")).where("c > 1").select("k", "c", F.col("c").alias("of")), "keys")
    posts = written(lookup(each, keys, ["k"], "of", ["id", "f1"], tile).where("c is not null"), "tiles")
    maps = written(made.join(posts.select("id", "f1").distinct(), ["id", "f1"], "left_semi").select("id", "f1", "n", "bits").dropDuplicates(["id", "f1"]), "bitmaps")
    return texts, made, node, posts, maps


def _all_blocks(posts: DataFrame, tile: int) -> DataFrame:
    """Rows (k, i, j, id, f1): each key in blocks, and each pair of its blocks a tile."""
    blocks = posts.withColumn("m", F.ceil(F.col("c") / tile).cast("int")).withColumn("x", F.pmod(F.xxhash64("id"), F.col("m")).cast("int"))
    return blocks.select("k", "id", "f1", "x", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("y")).select("k", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "id", "f1")


def _by_component(posts: DataFrame, tile: int) -> DataFrame:
    """Rows (k, i, j, id, f1, label) of keys with several labels, dealt by label: a label with more nodes than a tile has blocks of its
    own, smaller ones share blocks; all pairs of blocks are tiles but those of one label."""
    per = posts.groupBy("k", "label").agg(F.count("*").alias("n"))
    keys = per.groupBy("k").agg(F.count("*").alias("labels"), F.coalesce(F.sum(F.when(F.col("n") <= tile, F.col("n"))), F.lit(0)).alias("rest")).where("labels > 1")
    big = F.col("n") > tile
    parts = F.when(big, F.ceil(F.col("n") / tile)).otherwise(1).cast("int")
    shared = F.pmod(F.xxhash64("label"), F.greatest(F.ceil(F.col("rest") / tile), F.lit(1)))
    per = per.join(keys, "k").select("k", "label", "n", F.when(big, F.col("label")).alias("own"), shared.alias("at"), parts.alias("parts"))
    per = written(per, "labels")
    block = F.xxhash64("own", "at", "part")
    each = per.select("k", "own", F.when(F.col("own").isNull(), F.col("at")).alias("at"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).distinct()
    each = each.select("k", "own", block.alias("x"))
    pairs = each.alias("p").join(each.alias("q"), "k").where("p.own is null or q.own is null or p.own <> q.own")
    pairs = pairs.select("k", F.col("p.x").alias("x"), F.least("p.x", "q.x").alias("i"), F.greatest("p.x", "q.x").alias("j")).distinct()
    rows = lookup(posts.select("k", "id", "f1", "label"), per.select("k", "label", "n", "own", F.when(F.col("own").isNull(), F.col("at")).alias("at"), "parts"), ["k", "label"], "n", ["id", "f1"]).where("parts is not null")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id", "f1"), F.col("parts")).cast("int")).withColumn("x", block)
    return rows.join(pairs, ["k", "x"]).select("k", "i", "j", "id", "f1", "label")


def _every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (k, i, j, id, n, bits) sorted by k, i, j: every pair (a, b) that passes the bound in its tile."""

    def pairs(rows):
        rows.sort(key=lambda r: (r[1], r[0]))
        tile = Tile([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows])
        for a, b in tile.across(np.arange(len(rows))):
            yield min(a, b), max(a, b)

    def found():
        key, rows = None, []
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                for k, i, j, id_, n, bits in zip(*(c.to_pylist() for c in batch.slice(lo, 1000).columns)):
                    if (k, i, j) != key:
                        if len(rows) > 1:
                            yield from pairs(rows)
                        key, rows = (k, i, j), []
                    rows.append((id_, n, bits))
        if len(rows) > 1:
            yield from pairs(rows)

    it = found()
    while some := list(islice(it, 20_000)):
        yield pa.RecordBatch.from_arrays([pa.array([p[c] for p in some], pa.int64()) for c in range(2)], ["a", "b"])


def _dealt(rows: DataFrame, maps: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """Rows of tiles with their bitmaps, tile after tile."""
    full = rows.join(maps, ["id", "f1"]).select("k", "i", "j", "id", "n", "bits", *more)
    return full.repartition("k", "i", "j").sortWithinPartitions("k", "i", "j")


def links(docs: DataFrame, key: str = "doc_id", text: str = "text", tile: int = TILE) -> DataFrame:
    """Every link between distinct sets, not just those of a forest: a < b, the smallest ids of the two sets. Rows grow with
    the square of a family of near copies; exact copies add none."""
    with tables(docs.sparkSession):
        texts, _, _, posts, maps = _tiled(docs, key, text, tile)
        pairs = _dealt(_all_blocks(posts, tile), maps).mapInArrow(tidied(_every), "a bigint, b bigint").distinct()
        return written(_linked(written(pairs, "pairs"), texts), "links", keep=True)


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", tile: int = TILE) -> DataFrame:
    """One row for each row: key, n_shingles, component_id."""
    with tables(docs.sparkSession):
        texts, made, node, posts, maps = _tiled(docs, key, text, tile)
        kind = "a bigint, b bigint, k bigint, i bigint, j bigint"
        at = lambda i, j: (F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j")) if isinstance(i, int) else (i.cast("long").alias("i"), j.cast("long").alias("j"))
        named = lambda rows, first: _dealt(rows, maps, ("label",)).mapInArrow(tidied(_tiles(first)), kind)
        cold, hot = posts.where(F.col("c") <= tile), posts.where(F.col("c") > tile)

        x = F.pmod(F.xxhash64("id", "f1"), F.ceil(F.col("c") / tile))
        one = cold.select("k", *at(0, 0), "id", "f1", F.col("id").alias("label")).unionByName(hot.select("k", *at(x, x), "id", "f1", F.col("id").alias("label")))
        one = written(named(one, True), "forest")
        pairs = written(one.where("a is not null").select("a", "b").distinct(), "pairs")
        found = written(_linked(pairs, texts), "links")
        comp = components(found)
        labelled = lambda rows: rows.join(comp.withColumnRenamed("component", "label"), "id", "left").withColumn("label", F.coalesce("label", "id"))

        # one node of each component of a hot key stands for it
        left = None
        while not hot.isEmpty():
            reps = labelled(hot).groupBy("k", "label").agg(F.min(F.struct("id", "f1")).alias("r"))
            reps = written(reps.select("k", "label", "r.*"), "reps")
            many = reps.groupBy("k").agg(F.count("*").alias("c")).where("c > 1")
            now = many.agg(F.sum("c")).first()[0] or 0
            if not now or left is not None and now > left // 2:
                break
            left = now
            again = F.pmod(F.xxhash64("id", "f1", F.lit(left)), F.ceil(F.col("c") / tile))
            rows = reps.join(many, "k").select("k", *at(again, again), "id", "f1", "label")
            near = written(named(rows, True).where("a is not null").select("a", "b").distinct(), "pairs")
            more = written(_linked(near, texts), "links")
            if more.isEmpty():
                break
            found = written(found.unionByName(more), "links")
            comp = components(found)

        live = labelled(cold.join(one.where("k is not null").select("k").distinct(), "k"))
        mixed = live.groupBy("k").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("k")
        last = live.join(mixed, "k").select("k", *at(0, 0), "id", "f1", "label")
        if left:
            last = last.unionByName(_by_component(labelled(hot), tile))
        two = named(last, False).select("a", "b").distinct().join(pairs, ["a", "b"], "left_anti")
        more = written(_linked(written(two, "across"), texts), "links")
        if not more.isEmpty():
            comp = components(found.unionByName(more))
        named_sets = node.join(comp, node["rep"] == comp["id"], "left").select("n", "f1", "f2", F.coalesce("component", "rep").alias("component_id"))
        out = made.select("id", "n", "f1", "f2").join(named_sets, ["n", "f1", "f2"], "left")
        out = out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
        return written(out, "classes", keep=True)
