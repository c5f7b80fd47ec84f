import random
import re

import pytest
from recurscan.llm import substring


def brute(rows, size):
    texts = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    least = {}
    for i, w in texts:
        if i is not None:
            for s in range(len(w) - size + 1):
                k = tuple(w[s : s + size])
                least[k] = min(i, least.get(k, i))
    out = []
    for i, w in texts:
        gone = set()
        if i is not None:
            for s in range(len(w) - size + 1):
                if least[tuple(w[s : s + size])] < i:
                    gone.update(range(s, s + size))
        out.append((i, " ".join(x for p, x in enumerate(w) if p not in gone), len(w), len(gone)))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    vocab = ["w%d" % i for i in range(300)]
    word = lambda n: [rng.choice(vocab) for _ in range(n)]
    passages = [word(n) for n in (49, 50, 51, 60, 80, 120, 200)]
    rows = []
    for i in range(60):
        t = word(rng.randint(0, 40))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, 20)
            t += p[a : a + rng.randint(40, 200)] + word(rng.randint(0, 30))
        rows.append((i * 3, rng.choice([" ", "\n", "  "]).join(t)))
    rows += [(500, rows[7][1]), (501, rows[7][1]), (502, None), (503, ""), (504, "a " * 500), (505, "a " * 120), (506, "b c " * 300), (507, "d " + "b c " * 40), (509, "e " + "a b c d e f g " * 40 + rows[5][1]), (508, "a b c d e f g " * 60), (1, " ".join(passages[5]))]
    rows += [(9, rows[4][1]), (9, rows[12][1]), (None, rows[4][1])]
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(r[0], r[1], "x", 5) for r in rows], "doc_id long, text string, rest string, n_words int").repartition(4)
    out = substring.remove_repeats(df)
    assert out.columns == ["doc_id", "text", "rest", "n_words", "n_removed"]
    got = sorted(((r.doc_id, r.text, r.n_words, r.n_removed) for r in out.collect()), key=str)
    assert got == brute(rows, 50)
    assert any(r[3] for r in got)


@pytest.mark.parametrize("rows_a_slice", ["1", "7"])
def test_slices_of_one_task(spark, rows_a_slice):
    rows = corpus(4)
    random.Random(4).shuffle(rows)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, rows_a_slice)
    try:
        out = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
        got = sorted(((r.doc_id, r.text, r.n_words, r.n_removed) for r in out.collect()), key=str)
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
    assert got == brute(rows, 50)


def test_rows_of_one_id_in_other_slices():
    # of 9 one row shares only an anchor with 12, the other one, in another task, a whole window
    import pyarrow as pa

    passage = ["p%d" % i for i in range(60)]
    near = " ".join(passage[:30] + ["x%d" % i for i in range(40)])
    batch = lambda *rows: pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([t for _, t in rows])], ["id", "text"])
    sent = [r for task in (batch((9, near), (12, " ".join(passage))), batch((9, " ".join(passage)))) for b in substring._anchors(50)([task]) for r in b.to_pylist()]
    asked = {r["h"] for r in sent if r["v"] & 7 == substring.ASK and r["id"] == 9}
    told = {(r["h"], r["id"]) for r in sent if r["v"] & 7 == substring.TELL}
    assert any((h, 12) in told for h in asked)


def test_known_hashes():
    import numpy as np

    known = substring.Known(4)
    names = lambda *x: (np.array(x, np.uint64), np.zeros(len(x), np.int32))
    for start in range(10, 30, 3):
        known.learn(*names(5, start, start + 1, start + 2), np.array([start, 1, 2, 3]))
    assert len(known.h) == 4 and (known.h == np.sort(known.h)).all()
    at, held = known.find(*names(5, 28, 10))
    assert held.tolist() == [True, True, False] and known.low[at[0]] == 10
    assert not known.find(np.array([5], np.uint64), np.ones(1, np.int32))[1].any()


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert substring.remove_repeats(df).count() == 0


def test_cover_meets_every_shift():
    d = set(substring.COVER)
    for i in range(31):
        for j in range(31):
            assert any((i + k) % 31 in d and (j + k) % 31 in d for k in range(31))
