"""From raw documents to packed sequences: toxicity, language, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and gives the documents that it keeps, with the columns of documents; the last one gives
pieces of sequences. A stage's result is written as Parquet and read again as the next one's docs. All stages take documents with
null, empty and very long texts, repeated rows, nulls in any column, no rows at all, and further columns of any name, which
are passed on unchanged by all but the last, also where an operator has a result of that name; what each stage does with such rows
is stated with it.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import delete, shared_dir
from . import jaccard, langid, packing, substring, toxicity
from .common import tables, written


def _aside(docs: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns of these names renamed, and the new name of each column."""
    to = {c: c for c in docs.columns}
    for c in names:
        if c in to:
            to[c] = next(n for i in range(len(to) + 1) if (n := f"{c}_{i}") not in {*to.values(), *names})
    return docs.select(*[F.col(c).alias(n) for c, n in to.items()]), to


def _back(rows: DataFrame, to: dict[str, str]) -> DataFrame:
    return rows.select(*[F.col(n).alias(c) for c, n in to.items()])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below one half; the model learns from the table labels. Null and empty texts have the score of a text
    without any toxic word, and stay; each row is judged by its own text, so repeated rows and those without an id as any other."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows, to = _aside(docs, "score", "predicted")
    return _back(toxicity.score(rows, model, keep=tuple(to.values())).where("predicted = 0"), to)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; the column lang counts as declared and source as host, null ones say nothing. Null and empty texts, and
    those without letters, have no language and go. Rows of one id and one text go together. Rows without an id are judged by text."""
    model = langid.fit(docs)
    mark, own, same = (next(n for i in range(len(docs.columns) + 1) if (n := f"{c}_{i}") not in docs.columns) for c in ("mark", "own", "same"))
    marked = docs.select("doc_id", F.xxhash64("text").alias(mark), "text", "lang", "source")
    with tables(spark):
        found = langid.identify(marked, model, declared="lang", host="source", keep=("doc_id", mark))
        gone = written(found.where("not kept").select(F.col("doc_id").alias(own), F.col(mark).alias(same)).distinct(), "rejected", keep=True)
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col(own)) & (F.xxhash64("text") == F.col(same)), "left_anti").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id (all of its rows). Rows without an id, and texts without
    words, stay."""
    groups = jaccard.join(docs.select("doc_id", "text"))
    gone = groups.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that documents with smaller ids have: the words kept, joined by one space. Documents
    of which nothing stays go; n_chars follows the text. Null texts become empty and stay; rows without an id keep all their words."""
    rows, to = _aside(docs, "n_words", "n_removed")
    kept = substring.remove_repeats(rows).where("n_words > n_removed or n_removed = 0")
    return _back(kept.withColumn("n_chars", F.length("text").cast("long")), to)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens, with sources in proportion; a null text has its end token alone. Other columns are ignored."""
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", keep_languages),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", drop_repeats),
    ("packing", pack),
]

#: The toxicity and language models, and the tokenizer, have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents. A stage's table lies in the shared folder until the next one has been written; packing writes
    its tokens, so none is left when it returns."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    base = f"{shared_dir(spark)}/recurscan/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        with tables(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        if before:
            delete(spark, before)
        before = f"{base}/{name}"
        docs = spark.read.parquet(before)
    out = STAGES[-1][1](spark, docs, sf_dir)
    delete(spark, base)
    return out


def queries():
    return {"pipeline": run}


def oracle_sql():
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
