import random
import re

import numpy as np
import pyarrow as pa
import pytest
from recurscan.llm import jaccard, words


def sets(rows):
    out = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def brute(rows):
    s = sets(rows)
    up = {i: i for i, _ in rows}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for x in range(len(rows)):
        for y in range(x):
            both = len(s[x] & s[y])
            if both and 100 * both >= 75 * len(s[x] | s[y]):
                a, b = find(rows[x][0]), find(rows[y][0])
                up[max(a, b)] = min(a, b)
    return sorted((i, len(k), find(i)) for (i, _), k in zip(rows, s))


def corpus(seed, families=25, most=9):
    rng = random.Random(seed)
    vocab = ["w%d" % i for i in range(500)]
    rows, i = [], 0
    for f in range(families):
        base = [rng.choice(vocab) for _ in range(rng.choice([1, 3, 5, 6, 9, 20, 60, 200]))]
        for _ in range(rng.randint(1, most)):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            rows.append((i, rng.choice([" ", "\n", " \t"]).join(t).upper() if rng.random() < 0.2 else " ".join(t)))
            i += 1
    rows += [(i, None), (i + 1, ""), (i + 2, " \n "), (i + 3, "a b c d e f"), (i + 4, "x " * 30000)]
    return rows


@pytest.mark.parametrize("seed,tile", [(1, 4096), (2, 3)])
def test_equals_brute_force(spark, seed, tile):
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id long, text string, id string, n int").repartition(4)
    assert sorted(map(tuple, jaccard.join(df, tile=tile).collect())) == brute(rows)


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (5, "q r s t u v"), (7, "q r s t u v"), (None, "l m n o p")], "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(df).collect()}
    assert got == {(None, 2, 5), (5, 2, 5), (7, 2, 5), (None, 1, None)}
    assert jaccard.join(df.limit(0)).count() == 0


def test_large_family_gives_few_pairs():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    batch_ids, n, bits = [], [], []
    for i in range(400):
        s = base.copy()
        s[rng.integers(0, 300, 12)] = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
        s = np.unique(s)
        b = np.zeros(jaccard.width(len(s)), np.uint8)
        b[(s & np.uint64(len(b) - 1)).astype(int)] = 1
        batch_ids.append(i), n.append(len(s)), bits.append(np.packbits(b, bitorder="little").tobytes())
    order = sorted(range(400), key=lambda i: n[i])
    tile = jaccard.Tile([batch_ids[i] for i in order], [n[i] for i in order], [bits[i] for i in order])
    assert len(tile.forest()[0]) == 399
    assert not list(tile.across(np.zeros(400)))


def test_words():
    t = ["Abé c d\x0be", "", None, "  ", "one", "x y\x1cz"]
    w = words.split(pa.array(t))
    got = [[bytes(w.data[s:e]).decode() for s, e in zip(w.start[a:b], w.end[a:b])] for a, b in zip(w.first[:-1], w.first[1:])]
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", x or "") for x in t]
