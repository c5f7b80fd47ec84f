import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from recurscan.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def lib():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


def texts():
    rng = random.Random(5)
    out = ["", " ", "a", "\n\n  x", "don't we'll I've'", "a" * 5000, "ab" * 3001, " " * 999, "x" + " \t\n" * 400 + "y", "é" * 777, "日本語テキスト" * 99, "<|endoftext|>", "1234567890" * 80]
    for alphabet in ("ab", "aeiou nt", "'s 're\n ", "abc123 .,! é", "the and ing er on "):
        out += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 1500))) for _ in range(40)]
    return out


@pytest.mark.parametrize("leaf", [(2, 4), (8, 31), (48, 1 << 15)])
def test_tree_equals_library(lib, leaf):
    c = bpe.Codec(PATH, P.PATTERN, *leaf)
    for t in texts():
        assert c.pieces(t) == c.pattern.findall(t)
        assert c.encode(t) == lib.encode_ordinary(t)
        assert c.decode_text(c.encode_text(t)) == t.encode()


def test_vocabulary_words_alone(lib):
    c = bpe.Codec(PATH, P.PATTERN, 4, 8)
    for b in list(c.ranks)[::97]:
        try:
            t = b.decode()
        except UnicodeDecodeError:
            continue
        assert c.encode(t) == lib.encode_ordinary(t)


def test_frame(spark, lib):
    rows = [(1, "hello world", "x"), (2, None, "y"), (2, None, "y"), (3, "", None), (None, "a" * 70_000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = bpe.encode(df, PATH, P.PATTERN).collect()
    assert len(out) == 5
    for r in out:
        t = {1: "hello world", None: "a" * 70_000}.get(r.doc_id, "")
        ids = lib.encode_ordinary(t)
        assert (r.n_tokens, r.ids) == (len(ids), ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert bpe.encode(df.limit(0), PATH, P.PATTERN).count() == 0
    clash = bpe.encode(df, PATH, P.PATTERN, keep=("doc_id", "n_tokens", "text"))
    assert clash.columns == ["doc_id", "text", "n_tokens", "ids", "ids_sha256", "decoded_sha256"] and clash.where("n_tokens > 0").count() == 2


def test_decoding_goes_up_the_tree(monkeypatch):
    c = bpe.Codec(PATH, P.PATTERN)
    text = "some words and é日本 " * 300
    ids = c.encode(text)
    for leaf in (1, 2, 7, 1024):
        monkeypatch.setattr(bpe, "LEAF_TOKENS", leaf)
        assert c.decode(ids) == c.decode_text(c.encode_text(text)) == text.encode()
    assert c.decode([]) == c.decode_text("") == b""
