"""The queries op1 to op10: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import ann, bpe, chat, extraction, jaccard, langid, lz, packing, substring, toxicity
from .common import documents


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(documents(spark, sf_dir))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents (declared: lang, host: source) and pages (declared: the markup's, host and suffix: the address's)."""
    docs = documents(spark, sf_dir).withColumn("page_id", F.lit(None).cast("long"))
    docs = docs.select("doc_id", "page_id", "text", F.col("lang").alias("declared"), F.col("source").alias("host"), F.lit(None).cast("string").alias("suffix"))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").withColumn("host", extraction.host_of(F.col("url")))
    pages = pages.select(F.lit(None).cast("long").alias("doc_id"), "page_id", langid.html_text(F.col("html")).alias("text"), langid.html_lang(F.col("html")).alias("declared"), "host", langid.suffix_of(F.col("host")).alias("suffix"))
    model = langid.fit(docs, lang="declared")
    return langid.identify(docs.unionByName(pages), model, declared="declared", host="host", suffix="suffix", keep=("doc_id", "page_id", "declared"))


def op3_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return ann.search(vectors, vectors.where("vec_id % 50 = 0"))


def op4_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz.compare_with_next(documents(spark, sf_dir))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ids=False)


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    out = toxicity.score(docs, model)
    return out.select("doc_id", toxicity.is_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ids_crc32 is that of the piece's ids, 4 bytes each, little-endian."""
    pieces = packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


CONTROL = "\\### Assistant: </turn> ok"


def event_log(rows: DataFrame) -> DataFrame:
    """The log of a chat in which the rows (conv_id, turn, role, text, with turns from 1) come about: a user's turn is a draft that an
    edit replaces; an assistant's begins, is overtaken by a turn that comes too early, is regenerated, which empties it and drops
    that later turn, and is then streamed in three pieces."""
    n, text = F.col("turn"), F.coalesce("text", F.lit(""))
    third = F.floor(F.length(text) / 3).cast("int")
    event = lambda i, kind, said, turn=n, role=F.col("role"): F.struct(turn.alias("turn"), (8 * n + i).alias("seq"), F.lit(kind).alias("kind"), role.alias("role"), said.alias("text"))
    typed = F.array(event(0, "message", F.lit("draft")), event(1, "edit", text))
    streamed = F.array(
        event(0, "message", F.lit("")), event(1, "delta", F.substr(text, F.lit(1), third)), event(2, "message", F.lit("too early"), n + 1, F.lit("user")), event(3, "regenerate", F.lit("")),
        event(4, "delta", F.substr(text, F.lit(1), third)), event(5, "delta", F.substr(text, third + 1, third)), event(6, "delta", F.substr(text, 2 * third + 1)),
    )
    return rows.select("conv_id", F.explode(F.when(F.col("role") == "assistant", streamed).otherwise(typed)).alias("e")).select("conv_id", "e.*")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row is a turn of its own, also where two rows have one turn number; a conversation's rows come about in an event log."""
    told = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL).alias("text"))
    rows = told.unionByName(more).repartition("conv_id")
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    events = event_log(rows.withColumn("turn", at))
    back = chat.read_back(chat.render(chat.reconstruct(events)))
    each = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(each, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars",
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ngram_jaccard, op2_language_id, op3_rp_forest, op4_lz_fingerprint, op5_bpe, op6_html_extraction, op7_toxicity, op8_substring_dedup, op9_packing, op10_chat_format)}


SQL_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"

OP1_SQL = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce({SQL_WORDS.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}, []) AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)])
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words
), grams AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS id, doc_id AS to_id FROM documents UNION SELECT id, b FROM reach JOIN links ON to_id = a
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id
FROM sets JOIN (SELECT id, min(to_id) AS component_id FROM reach GROUP BY id) ON id = doc_id
"""


OP8_SQL = rf"""
WITH words AS (
  SELECT doc_id, coalesce({SQL_WORDS.format(text="text")}, []) AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM words)
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS least FROM windows) WHERE least < doc_id
), lost AS (
  SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id
), kept AS (
  SELECT doc_id, w, coalesce(len(ps), 0) AS n, list_filter(w, lambda x, i: NOT list_contains(coalesce(ps, []), i)) AS k FROM words LEFT JOIN lost USING (doc_id)
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(n AS BIGINT) AS n_removed, sha256(coalesce(array_to_string(k, ' '), '')) AS kept_sha256 FROM kept
"""


OP10_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{CONTROL}' UNION ALL SELECT -7, 1, 'assistant', '{CONTROL}'
), said AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS t,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS l,
         sum(15 + length(role) + length(text) + length(regexp_replace(role, '[^\\\\#<\n]', '', 'g')) + length(regexp_replace(text, '[^\\\\#<]', '', 'g'))) AS n
  FROM turns GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(t) AS turns_sha256, length(l) AS loss_chars, sha256(l) AS loss_sha256, CAST(n AS BIGINT) AS formatted_chars FROM said
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard": OP1_SQL, "op8_substring_dedup": OP8_SQL, "op10_chat_format": OP10_SQL}
