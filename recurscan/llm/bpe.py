"""Byte-level BPE encoding and decoding as a monoid tree reduction.

A text is halved until the leaves are short; a node joins its halves by splitting and merging anew only a window around
the border, and widens the window until what lies outside provably stays as it is:

* pieces (matches of the pattern): the matcher goes left to right and looks at most two characters past a match, so a match
  that ends three or more characters before the border stays, and from the first border between matches that both scans
  share on, the right half's matches stay;
* tokens of one long piece: a sequence of tokens is the encoding of its bytes if and only if each pair of neighbours is
  the encoding of its own bytes, so two checked pairs at the window's ends suffice.

Texts of up to LEAF_CHARS characters and pieces of up to LEAF_BYTES bytes are leaves of the encoding tree. Decoding halves the
tokens, down to LEAF_TOKENS, and concatenates the halves' bytes up the tree; concatenation needs no window.

Nulls and empty texts have no tokens (the hashes are those of the empty string); very long texts are read whole. Repeated rows give
repeated results, an empty table an empty one; further columns are ignored unless asked for with ``keep``, and kept ones with the name of
a result give way to it.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import own_columns, small_batches, tidied

LEAF_BYTES = 48
LEAF_CHARS = 1 << 15
LEAF_TOKENS = 1 << 10
CACHE_PIECES = 800_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Codec:
    """Encoder and decoder for one rank file and one splitting pattern."""

    def __init__(self, path: str, pattern: str, leaf_bytes: int = LEAF_BYTES, leaf_chars: int = LEAF_CHARS):
        self.ranks = load_ranks(path)
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        self.text_bytes = {str(v): k for k, v in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self.leaf_bytes, self.leaf_chars = leaf_bytes, leaf_chars
        self.pair_ok = lru_cache(200_000)(self._pair_ok)
        self.ids_text = _Pieces(self)

    # one piece -----------------------------------------------------------------------------------------------------
    def _merge(self, piece: bytes) -> list[int]:
        """The lowest rank first, the leftmost of equal ranks first."""
        ranks = self.ranks
        if len(piece) <= 2 * self.leaf_bytes:
            parts = [piece[i : i + 1] for i in range(len(piece))]
            while len(parts) > 1:
                best, at = None, -1
                for i in range(len(parts) - 1):
                    r = ranks.get(parts[i] + parts[i + 1])
                    if r is not None and (best is None or r < best):
                        best, at = r, i
                if best is None:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            return [ranks[p] for p in parts]
        n = len(piece)
        end, prev, nxt = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, j, e = heapq.heappop(heap)
            if not (alive[i] and nxt[i] == j and j < n and alive[j] and end[j] == e and end[i] == j):
                continue
            alive[j], end[i], nxt[i] = False, e, nxt[j]
            if nxt[i] < n:
                prev[nxt[i]] = i
                if (r := ranks.get(piece[i : end[nxt[i]]])) is not None:
                    heapq.heappush(heap, (r, i, nxt[i], end[nxt[i]]))
            if prev[i] >= 0 and (r := ranks.get(piece[prev[i] : e])) is not None:
                heapq.heappush(heap, (r, prev[i], i, e))
        return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]

    def _pair_ok(self, a: int, b: int) -> bool:
        return self._merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]

    def _join_tokens(self, left: list[int], right: list[int]) -> list[int]:
        k = 1
        while True:
            a, b = max(0, len(left) - k), min(len(right), k)
            window = self._merge(self.decode(left[a:] + right[:b]))
            if (a == 0 or self.pair_ok(left[a - 1], window[0])) and (b == len(right) or self.pair_ok(window[-1], right[b])):
                return left[:a] + window + right[b:]
            k *= 2

    def _tree(self, piece: bytes) -> list[int]:
        if len(piece) <= self.leaf_bytes:
            return self._merge(piece)
        mid = len(piece) // 2
        return self._join_tokens(self._tree(piece[:mid]), self._tree(piece[mid:]))

    def encode_piece(self, piece: str) -> list[int]:
        raw = piece.encode("utf-8", "replace")
        whole = self.ranks.get(raw)
        return [whole] if whole is not None else self._tree(raw)

    # a whole text --------------------------------------------------------------------------------------------------
    def pieces(self, text: str) -> list[str]:
        """The pattern's matches, from halves of the text; see the module's text for why the borders hold."""
        if len(text) <= self.leaf_chars:
            return self.pattern.findall(text)
        mid = len(text) // 2
        left, right = self.pieces(text[:mid]), self.pieces(text[mid:])
        start, kept = mid, len(left)
        while kept and mid - start < 3:  # the match that ends at `start` must end three characters before the border
            kept -= 1
            start -= len(left[kept])
        k = 4
        while True:
            stop, borders = mid, {mid: 0}
            for i, p in enumerate(right[:k], 1):
                stop += len(p)
                borders[stop] = i
            window, at, whole = [], start, stop == len(text)
            for p in self.pattern.findall(text[start:stop]):
                window.append(p)
                at += len(p)
                if at in borders and (at + 3 <= stop or whole):
                    return left[:kept] + window + right[borders[at] :]
            k *= 4

    def encode(self, text: str) -> list[int]:
        joined = self.encode_text(text)
        return [int(x) for x in joined.split(" ")] if joined else []

    def encode_text(self, text: str) -> str:
        """The ids in decimal, joined by one space."""
        return " ".join(map(self.ids_text.__getitem__, self.pieces(text)))

    def decode(self, ids: list[int]) -> bytes:
        return _up(ids, self.bytes_of, 0, len(ids))

    def decode_text(self, joined: str) -> bytes:
        """Bytes of ids as encode_text() gives them."""
        ids = joined.split(" ") if joined else []
        return _up(ids, self.text_bytes, 0, len(ids))


def _up(ids: list, known: dict, lo: int, hi: int) -> bytes:
    """Bytes of ids[lo:hi]: a leaf's, or those of both halves one after the other."""
    if hi - lo <= LEAF_TOKENS:
        return b"".join(map(known.__getitem__, ids[lo:hi]))
    mid = (lo + hi) // 2
    return _up(ids, known, lo, mid) + _up(ids, known, mid, hi)


class _Pieces(dict):
    """Piece -> its ids as text; emptied when full, so that its size stays bounded."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec

    def __missing__(self, piece: str) -> str:
        if len(self) >= CACHE_PIECES:
            self.clear()
        made = " ".join(map(str, self.codec.encode_piece(piece)))
        if len(piece) <= 64:
            self[piece] = made
        return made


@lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    """One codec per Python worker."""
    return Codec(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: bool = True) -> DataFrame:
    """The kept columns, then n_tokens, ids (array<int>, if asked for), ids_sha256 and decoded_sha256 of each row's text."""
    small_batches(docs.sparkSession)
    keep = own_columns(keep, ("n_tokens", "ids", "ids_sha256", "decoded_sha256"))
    kept = docs.select(*keep, F.coalesce(docs[text], F.lit("")).alias("__text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]] + ["n_tokens bigint"] + ["ids array<int>"] * ids + ["ids_sha256 string", "decoded_sha256 string"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                counts, lists, coded, decoded = [], [], [], []
                for text in part.column(part.num_columns - 1):
                    joined = c.encode_text(text.as_py())
                    counts.append(joined.count(" ") + 1 if joined else 0)
                    coded.append(hashlib.sha256(joined.encode()).hexdigest())
                    decoded.append(hashlib.sha256(c.decode_text(joined)).hexdigest())
                    if ids:
                        lists.append([int(x) for x in joined.split(" ")] if joined else [])
                own = [part.column(i) for i in range(part.num_columns - 1)]
                made = [pa.array(counts, pa.int64())] + [pa.array(lists, pa.list_(pa.int32()))] * ids + [pa.array(coded), pa.array(decoded)]
                yield pa.RecordBatch.from_arrays(own + made, [*keep, "n_tokens", *["ids"] * ids, "ids_sha256", "decoded_sha256"])

    return kept.mapInArrow(tidied(run), ", ".join(fields))
