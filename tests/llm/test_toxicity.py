import zlib

import numpy as np
from recurscan.llm import toxicity as tox


def corpus(n, seed=0):
    rng = np.random.default_rng(seed)
    vocab = ["w" + "".join(rng.choice(list("abcdefghij"), 4)) for _ in range(600)]
    bad = ["zorgfel", "zorgmup", "zorgli", "idiot", "scum", "klovu"]
    rows, labels = [], []
    for i in range(n):
        y = int(rng.random() < 0.12)
        words = rng.choice(vocab, rng.integers(5, 120)).tolist()
        if y:
            for b in rng.choice(bad, rng.integers(1, 6)):
                words.insert(rng.integers(0, len(words)), b)
        rows.append((i, " ".join(words)))
        labels.append((i, y))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus(3000)
    truth = dict(labels)
    flipped = [(i, y if zlib.crc32(str(i).encode()) % 5 else 1 - y) for i, y in labels]  # held-out labels must not be looked at
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    model = tox.fit(docs, spark.createDataFrame([*flipped, (None, 1), (5000, None), (5001, 7)], "doc_id long, toxic int"))
    out = tox.score(docs, model).collect()
    held = [r for r in out if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert any(s.startswith("^zor") for s in model.weights)
    assert 0 < min(r[2] for r in model.rates.values()) < 1


def test_correlated_voters_share_a_weight():
    rng = np.random.default_rng(1)
    y = rng.random(4000) < 0.2
    a, b = (rng.random(4000) < np.where(y, 0.6, 0.02) for _ in range(2))
    votes = np.column_stack([a, a, a, b, ~(a | b)]).astype(float)
    post, hi, lo, near = tox.label_model(votes, 0.2)
    assert near[:3, :3].min() > 0.99 and near[3, :3].max() == 0
    alone = post[a & ~b].max()
    assert abs(alone - tox.label_model(votes[:, 2:], 0.2)[0][a & ~b].max()) < 0.1
    assert (hi[:4] > lo[:4]).all()


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.1), (2, "", 0.1), (None, "you idiot", 0.0), (4, "x " * 50_000, 0.0)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = tox.fit(docs, none)
    out = {r.doc_id: r for r in tox.score(docs, model).collect()}
    assert out[None].predicted == 1 and out[1].predicted == out[2].predicted == out[4].predicted == 0 and out[1].score == out[2].score
    assert tox.score(docs.limit(0), model).count() == 0


def test_clashing_columns_ties_and_repeated_rows(spark):
    rows, labels = corpus(1500)
    docs = spark.createDataFrame([(*r, 9.0, -1, "k") for r in [*rows, *rows[:300], (None, rows[0][1])]], "doc_id long, text string, score double, predicted int, k string").repartition(3)
    model = tox.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    once = tox.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert model.weights == once.weights and model.bias == once.bias
    out = tox.score(docs, model, keep=tuple(docs.columns))
    assert out.columns == ["doc_id", "text", "k", "score", "predicted"]
    by = {}
    for r in out.collect():
        assert by.setdefault(r.text, r.score) == r.score == model.score(r.text) and r.predicted == int(r.score >= 0.5)


def test_scores_equal_brute_force(spark):
    """The classifier's weights, from votes counted word by word and the textbook form of each step."""
    rows, labels = corpus(1200, 4)
    docs, told = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = tox.fit(docs, told)
    names, truth = list(model.weights), dict(labels)
    taught = [t for i, t in rows if zlib.crc32(str(i).encode()) % 5]
    chosen = [s for s in names if s not in ["=" + w for w in tox.INSULTS] or s in model.rates]

    def has(term, text):
        words, (stem, _, times) = text.lower().split(), term[1:].partition("#")
        return words.count(stem) > 0 if term[0] == "=" else sum(w.startswith(stem) for w in words) >= int(times or 1)

    x = np.array([[has(s, t) for s in names] for t in taught], float)
    for t, row in zip(taught, x):
        z = model.bias + sum(w for w, on in zip(model.weights.values(), row) if on)
        assert abs(model.score(t) - 1 / (1 + np.exp(-z))) < 1e-9
    base = np.mean([truth[i] for i, _ in rows if zlib.crc32(str(i).encode()) % 5])
    strong = [s for s in chosen if s in model.rates]
    for s in strong:
        n = [truth[i] for i, t in rows if zlib.crc32(str(i).encode()) % 5 and has(s, t)]
        assert np.mean(n) >= 0.9 and np.mean(n) > base and len(n) >= 3
