import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from recurscan.llm import packing, toxicity
from recurscan.scratch import tables
from test_jaccard import brute as groups
from test_langid_values import brute as languages
from test_substring import brute as repeats
from tokenizers import Tokenizer


def test_stages_on_planted_cases(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    clean = "Plain words about rivers and hills, number {} of many, that say nothing harmful at all in any way today."
    passage = " ".join(f"shared{i}" for i in range(60))
    planted = [
        (10_001, "you idiot moron scum and pathetic loser", "en", "p", 39),
        (10_002, "", "en", "p", 0),
        (10_003, clean.format("one"), "en", "p", 9),
        (10_004, " ".join(f"unique{i}" for i in range(40)), "en", "p", 9),
        (10_005, " ".join(f"unique{i}" for i in range(40)) + " end", "en", "p", 9),
        (10_006, "first part " + " ".join(f"aa{i}" for i in range(90)) + " " + passage, "en", "p", 9),
        (10_007, "second part " + " ".join(f"bb{i}" for i in range(90)) + " " + passage, "en", "p", 9),
        (10_008, None, None, None, None),
    ]
    now = docs.unionByName(spark.createDataFrame(planted, docs.schema))
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, sf_dir)
        if i < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{i}")
        now = spark.read.parquet(f"{tmp_path}/{i}")
        left = {r.doc_id: r for r in now.where("doc_id > 10000").collect()}
        if name == "toxicity":
            assert set(left) == {10_002, 10_003, 10_004, 10_005, 10_006, 10_007, 10_008}
        elif name == "language_id":
            assert set(left) == {10_003, 10_004, 10_005, 10_006, 10_007}
        elif name == "near_duplicates":
            assert set(left) == {10_003, 10_004, 10_006, 10_007}
        elif name == "substring_dedup":
            assert passage in left[10_006].text and "shared" not in left[10_007].text and left[10_007].text.startswith("second part bb0")
            assert left[10_007].n_chars == len(left[10_007].text)
    assert set(left) == {10_003, 10_004, 10_006, 10_007} and "ids_crc32" in now.columns
    assert now.agg(F.max("sequence_id") + 1).first()[0] >= now.agg(F.sum("length")).first()[0] / 1024


def test_empty_table(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
    assert docs.count() == 0


def test_run_equals_brute_force(spark, sf_dir):
    """Every stage over the whole table by other means: scores text by text, language, near copies and repeats by brute force, ids by the
    tokenizer's library; then the pieces put together again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = [r for r in docs.collect() if model.score(r.text or "") < 0.5]
    found = {k: kept for k, _, _, kept in languages([(r.text, r.lang) for r in rows], [(r.doc_id, r.text, r.lang, r.source, None) for r in rows])}
    rows = [r for r in rows if found[r.doc_id]]
    first = {i: c for i, _, c in groups([(r.doc_id, r.text) for r in rows])}
    rows = [r for r in rows if first[r.doc_id] == r.doc_id]
    kept = [(i, t) for i, t, n, gone in repeats([(r.doc_id, r.text) for r in rows], 50) if n > gone or not gone]
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: [*t.encode(x, add_special_tokens=False).ids, 0] for i, x in kept}

    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert 0 < len(want) < docs.count() and {r.doc_id for r in got} == set(want)
    places, pieces = set(), {}
    for r in got:
        ids = want[r.doc_id][r.start : r.start + r.length]
        assert r.doc_tokens == len(want[r.doc_id]) and len(ids) == r.length and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        places |= {(r.sequence_id, r.offset + i) for i in range(r.length)}
    assert all(sum(n for _, n in v) == len(want[i]) and sorted(v)[0][0] == 0 for i, v in pieces.items())
    assert len(places) == sum(map(len, want.values())) and max(o for _, o in places) == 1023


def test_odd_rows_and_clashing_columns(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    more = {"score": "0.5D", "predicted": "1", "kept": "false", "language": "'q'", "probability": "0.1D", "n_words": "-5", "n_removed": "-6", "component_id": "7", "mark_0": "8", "own_0": "9", "same_0": "10", "id": "'i'", "__h": "11", "rest": "12", "u": "13"}
    odd = [(None, None, None, None, None), (None, "the same words of an english text that is here for a test of odd rows", "en", None, 1), (70_000, "", None, "s", 0), (70_001, "word and the " * 30_000, "en", "s", 1), (70_001, "word and the " * 30_000, "en", "s", 1), (70_002, "the and word " * 30_000, "en", None, 1)]
    now = docs.unionByName(spark.createDataFrame(odd, docs.schema)).selectExpr("*", *[f"{v} AS `{c}`" for c, v in more.items()])
    counts = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, sf_dir)
        out.write.parquet(f"{tmp_path}/{i}")
        if i < 4:
            assert out.columns == now.columns
            now = spark.read.parquet(f"{tmp_path}/{i}")
            assert now.selectExpr(*[f"min(`{c}` = {v})" for c, v in more.items()]).first() == (True,) * len(more)
            counts.append({k: now.where(f"doc_id <=> {k}").count() for k in ("NULL", 70000, 70001, 70002)})
    assert counts[0] == {"NULL": 2, 70000: 1, 70001: 2, 70002: 1}
    assert counts[1] == {"NULL": 1, 70000: 0, 70001: 2, 70002: 1} == counts[2] | {70002: 1}
    packed = spark.read.parquet(f"{tmp_path}/4")
    assert packed.where("doc_id is null").count() > 0


def test_tables_of_other_calls_stay(spark, sf_dir):
    lazy = packing.pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
    corpus_pipeline.STAGES[0][1](spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir).count()
    with tables(spark):
        corpus_pipeline.STAGES[3][1](spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir).count()
    assert lazy.count() > 0
