"""Language identification by Bayesian evidence fusion.

The posterior of a text's language is the product of

* the likelihood of its byte trigrams under each language (counts of at most SAMPLE rows with a known language, in hashed
  buckets; trigrams are not independent, so no text counts as more than STRENGTH of them),
* the likelihood of its declared language given the language, and
* a prior of its host, smoothed towards that of the address suffix, which is smoothed towards that of all rows.

Declared languages, suffixes and hosts are summed over all rows by grouped aggregation of the text posteriors (combined before
the shuffle), and every value's sums are joined back by key, frequent values by a broadcast; a row's own share is taken out of
each of its three sums, so no row is evidence for itself.

A null or empty text, or one without letters, gives no evidence: its language is ``und``, it has probability 0 and is rejected. So is
a text whose best language has a posterior below LEAST; of languages with equal posteriors the first by name is given. Very long texts are
read whole. A null declaration, host or suffix says nothing. Repeated rows count each;
an empty table gives no rows; without any training row all is ``und``. Of other columns only the kept ones are passed on; kept
ones named language, probability or kept give way to the results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import lookup
from . import words
from .common import own_columns, small_batches, tables, tidied, written

SAMPLE, BUCKETS, STRENGTH, LEAST = 8000, 1 << 14, 60, 0.5
HOST_WEIGHT, SUFFIX_WEIGHT = 10.0, 100.0

_LETTER = np.full(256, 32, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the trigrams around each letter, text after text, and where each text's begin."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = _LETTER[np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]]] if raw is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    before, after = np.full(len(data), 32, np.uint8), np.full(len(data), 32, np.uint8)
    before[1:], after[:-1] = data[:-1], data[1:]
    inside = offsets[(offsets > 0) & (offsets < len(data))]
    before[inside], after[inside - 1] = 32, 32
    at = np.flatnonzero(data != 32)
    h = (before[at].astype(np.uint32) * 0x9E3779B1 + data[at].astype(np.uint32) * 0x85EBCA77 + after[at].astype(np.uint32) * 0xC2B2AE3D) >> np.uint32(32 - BUCKETS.bit_length() + 1)
    return h.astype(np.int64), np.searchsorted(at, offsets)


class TextModel:
    """Languages and the log probabilities of trigram buckets under each."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        self.logs = np.log((counts + 0.1) / (counts + 0.1).sum(1, keepdims=True)).astype(np.float32)

    def evidence(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Number of trigrams of each text, and its tempered log likelihood under each language (less the largest)."""
        h, first = trigrams(texts)
        n = np.diff(first)
        total = np.zeros((len(n), len(self.langs)))
        full = np.flatnonzero(n)
        if len(full) and self.langs:
            for i, logs in enumerate(self.logs):
                total[full, i] = np.add.reduceat(logs[h], first[:-1][full], dtype=np.float64)
            total[full] *= (np.minimum(n[full], STRENGTH) / n[full])[:, None]
            total[full] -= total[full].max(1, keepdims=True)
        return n, total


def fit(rows: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> TextModel:
    small_batches(rows.sparkSession)
    known = rows.select(F.col(key).alias("k"), F.lower(F.trim(F.col(lang))).alias("l"), F.col(text).alias("t")).where("l <> '' and t <> ''")
    some = known.select("k").orderBy(F.xxhash64("k"), "k").limit(sample).distinct()
    taught = known.join(F.broadcast(some), "k").select("l", "t")  # at most `sample` ids

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch, 1):
                h, first = trigrams(part.column(1))
                lang = np.array(part.column(0).to_pylist())
                for name in np.unique(lang):
                    own = np.repeat(lang == name, np.diff(first))
                    c = np.bincount(h[own], minlength=BUCKETS)
                    at = np.flatnonzero(c)
                    yield pa.RecordBatch.from_arrays([pa.array([str(name)] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(c[at].astype(np.int64))], ["l", "b", "c"])

    sums = taught.mapInArrow(tidied(count), "l string, b int, c bigint").groupBy("l", "b").agg(F.sum("c").alias("c")).collect()
    langs = sorted({r["l"] for r in sums})
    counts = np.zeros((len(langs), BUCKETS))
    for r in sums:
        counts[langs.index(r["l"]), r["b"]] = r["c"]
    return TextModel(langs, counts)


def html_text(page: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(page, r"(?is)<(script|style)\b.*?(</\1\s*>|\z)", " "), r"(?s)<!--.*?-->|<[^>]*>", " ")


def html_lang(page: Column) -> Column:
    """The primary tag of the language that the html element declares."""
    return F.nullif(F.lower(F.regexp_extract(page, r"(?is)<html\b[^>]*\slang\s*=\s*[\"']?([a-z]{2,3})", 1)), F.lit(""))


def suffix_of(host: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(host, r"\.([^.]+)$", 1)), F.lit(""))


def identify(rows: DataFrame, model: TextModel, text: str = "text", declared: str | None = None, host: str | None = None, suffix: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, then language, probability and kept (whether the row stays)."""
    small_batches(rows.sparkSession)
    with tables(rows.sparkSession):
        return _identify(rows, model, text, declared, host, suffix, own_columns(keep, ("language", "probability", "kept")))


def _identify(rows: DataFrame, model: TextModel, text: str, declared: str | None, host: str | None, suffix: str | None, keep: list[str]) -> DataFrame:
    pick = lambda c: (F.col(c).cast("string") if c else F.lit(None).cast("string"))
    given = rows.select(F.struct(*keep).alias("own"), pick(declared).alias("d"), pick(host).alias("h"), pick(suffix).alias("s"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    kind = given.schema["own"].dataType.simpleString()
    langs, size = model.langs, len(model.langs)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch, 4):
                n, total = model.evidence(part.column(4))
                post = np.exp(total) / np.exp(total).sum(1, keepdims=True) if size else total
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * size), pa.array(x.astype(np.float64).ravel())) for x in (total, post)]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(4)), pa.array(n.astype(np.int64)), *lists], ["own", "d", "h", "s", "n", "ll", "p"])

    seen = written(given.mapInArrow(tidied(read), f"own {kind}, d string, h string, s string, n bigint, ll array<double>, p array<double>").withColumn("u", F.monotonically_increasing_id()), "evidence", keep=True)
    if not size:
        return seen.select("own.*", F.lit("und").alias("language"), F.lit(0.0).alias("probability"), F.lit(False).alias("kept"))
    sums = [F.sum(F.col("p")[i]).alias(f"p{i}") for i in range(size)]
    able = seen.where("n > 0")
    whole = able.agg(*sums).first()
    overall = np.array([whole[f"p{i}"] or 0.0 for i in range(size)]) + 1
    base = overall / overall.sum()
    full, values = seen, 1
    for by in ("d", "s", "h"):
        found = written(able.where(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("c"), F.array(*sums).alias(f"{by}p")), "values", keep=True)
        values = found.count() + 1 if by == "d" else values
        full = lookup(full, found, [by], "c", ["u"])

    def fuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.column(1).to_numpy(zero_copy_only=False)
            ll, own = (np.array(batch.column(i).to_pylist(), float).reshape(-1, size) for i in (2, 3))

            def others(i: int) -> tuple[np.ndarray, np.ndarray]:
                """What the other rows of the same value say, and whether the row has a value that any row has."""
                held = batch.column(i).to_pylist()
                known = np.array([x is not None for x in held])
                total = np.array([x if x is not None else np.zeros(size) for x in held]).reshape(-1, size)
                return np.maximum(total - own * (known & (n > 0))[:, None], 0), known

            told, declares = others(4)
            near, _ = others(5)
            there, _ = others(6)
            prior = (near + SUFFIX_WEIGHT * base) / (near.sum(1, keepdims=True) + SUFFIX_WEIGHT)
            prior = (there + HOST_WEIGHT * prior) / (there.sum(1, keepdims=True) + HOST_WEIGHT)
            # of a declared value given a language; smoothed so that no value rules a language out
            tell = np.log((told + 0.5) / (np.maximum(overall - own * (n > 0)[:, None], 0) + 0.5 * values))
            odds = ll + np.log(prior) + np.where(declares[:, None], tell, 0)
            post = np.exp(odds - odds.max(1, keepdims=True))
            post /= post.sum(1, keepdims=True)
            best, some = post.argmax(1), n > 0
            prob = np.where(some, post.max(1), 0.0)
            names = [langs[b] if x else "und" for b, x in zip(best, some)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names), pa.array(prob), pa.array(some & (prob >= LEAST))], ["own", "language", "probability", "kept"])

    fused = full.select("own", "n", "ll", "p", "dp", "sp", "hp").mapInArrow(tidied(fuse), f"own {kind}, language string, probability double, kept boolean")
    return fused.select("own.*", "language", "probability", "kept")
