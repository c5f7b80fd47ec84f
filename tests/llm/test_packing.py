import json
from collections import defaultdict

import numpy as np
import public_tokenizers as P
from recurscan.llm import packing
from recurscan.llm.bpe import load_ranks
from tokenizers import Tokenizer

ARGS = (P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


def check(rows, out, length):
    t = Tokenizer.from_file(ARGS[0])
    seqs, docs = defaultdict(list), defaultdict(list)
    for r in out:
        seqs[r.sequence_id].append((r.offset, r.length))
        docs[r.doc_id].append((r.start, np.frombuffer(r.ids, "<u4").tolist(), r.doc_tokens))
        assert len(r.ids) == 4 * r.length
    assert sorted(seqs) == list(range(len(seqs)))
    padding = 0
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= length
        padding += 0 if at & (at - 1) == 0 else length - at
    assert padding == 0
    want = {i: [*t.encode(x or "", add_special_tokens=False).ids, 0] for i, x, _ in rows}
    assert {i: sum((p[1] for p in sorted(v)), []) for i, v in docs.items()} == want
    for i, v in docs.items():
        at = 0
        for s, ids, n in sorted(v):
            assert s == at and n == len(want[i])
            at += len(ids)


def test_pack(spark):
    rows = [(i, f"Document {i} of some words. " * (i % 37), f"s{i % 4 if i % 3 else 0}") for i in range(300)]
    rows += [(900, None, None), (901, "", "s1"), (902, "日本語 <|endoftext|> é", "s2"), (903, "word " * 5000, "lone")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    check(rows, packing.pack(df, *ARGS, length=64, window=512).collect(), 64)
    check(rows, packing.pack(df, *ARGS, length=64, window=512, weights={None: 5, 's0': 5, 's1': 1}).collect(), 64)
    odd = df.selectExpr("*", "1 AS start", "2 AS length", "3 AS q", "4 AS s", "5 AS c", "6 AS t", "7 AS id", "8 AS part")
    check(rows, packing.pack(odd, *ARGS).collect(), 1024)
    lost = packing.pack(df.selectExpr("IF(doc_id < 5, NULL, doc_id) AS doc_id", "text", "source"), *ARGS).collect()
    t = Tokenizer.from_file(ARGS[0])
    assert sum(r.length for r in lost if r.doc_id is None) == sum(len(t.encode(x).ids) + 1 for _, x, _ in rows[:5])
    assert packing.pack(df.limit(0), *ARGS).count() == 0
    copies = packing.pack(df.filter("doc_id = 7").unionAll(df.filter("doc_id = 7")), *ARGS).collect()
    assert sum(r.length for r in copies) == 2 * copies[0].doc_tokens


def test_windows_follow_the_targets():
    plan = packing.Schedule([70_000, 20_000, 10_000], [70_000, 20_000, 10_000], 1000, 64)
    for r in range(99):
        own = [plan.entitled(q, r + 1) - plan.entitled(q, r) for q in range(3)]
        assert own == [700, 200, 100]


def test_fast_ids_equal_the_tokenizer():
    t, ids = Tokenizer.from_file(ARGS[0]), packing.Ids(*ARGS)
    for x in ("", "don't 'll x", "  a\n\n b\t", "naïve café ½ ÿ", "1234567890" * 30, "a" * 999, "\x00\x85\xa0 x\xa0\xa0y", "œ", "<|endoftext|>a"):
        assert ids(x) == t.encode(x, add_special_tokens=False).ids


def test_latin_1_splits_and_merges_alike():
    """The rank file is the tokenizer's vocabulary in the order of its merges, and both split every pair of Latin-1 characters alike, between
    letters, blanks and line breaks, and every triple of one character of each kind."""
    model = json.load(open(ARGS[0]))["model"]
    ranks, vocab = load_ranks(ARGS[1]), model["vocab"]
    plain = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 173 or 174 <= b]  # shown as themselves, others from 256 on
    others = [b for b in range(256) if b not in plain]
    shown = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}
    assert {"".join(shown[b] for b in k): v for k, v in ranks.items()} == {k: v for k, v in vocab.items() if k != "<|endoftext|>"}
    merged = [vocab[a + b] for a, b in model["merges"]]
    assert merged == sorted(v for k, v in ranks.items() if len(k) > 1)
    t, ids = Tokenizer.from_file(ARGS[0]), packing.Ids(*ARGS)
    texts = [x for a in range(256) for b in range(256) for x in (f"x{chr(a)}{chr(b)}y", f" {chr(a)}{chr(b)} ")]
    kinds = "aZ1 \n\t\r\x00.'_$\x85\xa0\xaa\xb2\xbd\xb5\xd7\xe9\xad\x1c\x7f"
    texts += [a + b + c + d for a in kinds for b in kinds for c in kinds for d in "a 'l"]
    assert [e.ids for e in t.encode_batch(texts, add_special_tokens=False)] == [ids(x) for x in texts]
