"""Toxicity by weak supervision.

1. Voters. Lexicon voters are words and word beginnings that the training labels tell apart beyond chance (binomial test
   over all candidates at once), and a fixed list of insults; pattern voters look at shouting, at repeated marks and at
   how many lexicon words there are; one voter speaks for texts without any.
2. Label model. The votes on the training texts give each voter's rates of voting in either hidden class by expectation
   maximisation, from PRIOR times its counts under the training labels as prior; voters whose residuals go together given the class share one voice where they vote on one text.
3. Classifier. A logistic regression on the lexicon's words is trained on the label model's posteriors and scores all texts.

Labels are learnt from at most SAMPLE labelled rows (the smallest hashes of their ids) outside the held-out fold (crc32 of the
id as text, mod 5, is 0). Everything else sees whole texts of all rows.

A beginning that several words of a text have is a term of its own for two and for MOST_TIMES words or more.

A null text counts as empty; an empty text has the score of a text without any lexicon word; very long texts are read whole. Labels
without an id or with
a null or other value than 0 and 1 are left out; of several labels for one id the highest counts, of several texts of one id the
least teaches. Without any usable label only the fixed list
votes. Repeated rows are scored each; an empty table gives no rows. Other columns are passed on only if asked for; kept ones named
score or predicted give way to the results.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import own_columns, small_batches, tidied

SAMPLE, BEGINNINGS, MOST_TIMES, SURE = 12_000, (3, 4, 5, 6), 3, 0.9
PRIOR = 3.0
#: Common English insults.
INSULTS = tuple("idiot stupid moron loser trash scum clown pathetic disgusting worthless imbecile cretin dumbass bastard bitch asshole retard degenerate vermin".split())
_WORD = re.compile(r"[^\W\d_]+")


def terms(text: str) -> set[str]:
    """Words (=word) and beginnings of words (^beg, and ^beg#2, ^beg#3 if that many words have it) of a text."""
    words = Counter(_WORD.findall(text.lower()))
    out = {"=" + w for w in words}
    begins: Counter = Counter()
    for w, c in words.items():
        for n in BEGINNINGS:
            if len(w) < n:
                break
            begins["^" + w[:n]] += c
    for s, c in begins.items():
        out.add(s)
        out.update([f"{s}#{k}" for k in range(2, min(c, MOST_TIMES) + 1)])
    return out


def hits(text: str, index: dict[str, int]) -> list[int]:
    """The numbers of the index's terms that a text has; the index also has each term's beginning, without a number."""
    found, begins = set(), Counter()
    for w, c in Counter(_WORD.findall(text.lower())).items():
        if (i := index.get("=" + w)) is not None:
            found.add(i)
        for n in BEGINNINGS:
            if len(w) < n:
                break
            if (s := "^" + w[:n]) in index:
                begins[s] += c
    for s, c in begins.items():
        for k in range(1, min(c, MOST_TIMES) + 1):
            if (i := index.get(s if k == 1 else f"{s}#{k}")) is not None and i >= 0:
                found.add(i)
    return sorted(found)


def numbered(names: list[str]) -> dict[str, int]:
    out = {s: i for i, s in enumerate(names)}
    for s in names:
        if s[0] == "^":
            out.setdefault(s.split("#")[0], -1)
    return out


def patterns(text: str) -> list[int]:
    """Votes of the pattern voters: shouting, repeated marks."""
    letters = [c for c in text if c.isalpha()]
    upper = sum(c.isupper() for c in letters)
    return [int(len(letters) >= 20 and upper > 0.5 * len(letters)), int("!!" in text), int("?!" in text or "!?" in text)]


PATTERNS = ("shouting", "repeated marks", "mixed marks")


@dataclass
class Model:
    weights: dict[str, float]
    bias: float
    rates: dict[str, tuple[float, float, float]]  # of each voter: rate in class 1, in class 0, sum of its correlations

    def score(self, text: str) -> float:
        index = self.__dict__.setdefault("_index", numbered(list(self.weights)))
        values = self.__dict__.setdefault("_values", list(self.weights.values()))
        z = self.bias + sum(values[i] for i in hits(text, index))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def beyond_chance(n: int, t: int, base: float) -> float:
    """Log of the chance that t or more of n texts are of class 1 (upper bound by relative entropy)."""
    p = t / n
    if p <= base:
        return 0.0
    return -n * (p * math.log(p / base) + ((1 - p) * math.log((1 - p) / (1 - base)) if p < 1 else 0.0))


def choose(stats: list[tuple[str, int, int]], base: float) -> list[str]:
    """Terms that lean to class 1 beyond chance. Of terms that extend each other the shortest as good as any stays, as the
    longest one that has nearly all of its texts; a repeated beginning only if no single term has most of its texts."""
    level = math.log(0.01 / max(1, len(stats)))
    good = {s: (n, t) for s, n, t in stats if t >= SURE * n and beyond_chance(n, t, base) < level}
    longer: dict[str, list[str]] = {}
    for s in good:
        stem, _, times = s[1:].partition("#")
        for n in BEGINNINGS:
            if n <= len(stem) and not times:
                longer.setdefault("^" + stem[:n], []).append(s)
    kept: set[str] = set()
    for s in sorted(good):
        stem, _, times = s[1:].partition("#")
        n, t = good[s]
        shorter = [b for m in BEGINNINGS for k in {"", times and "#" + times} if m <= len(stem) and (b := "^" + stem[:m] + k) in good and b != s]
        if any(good[b][1] * n >= good[b][0] * t * 0.99 for b in shorter):
            continue
        inside = longer.get("^" + stem, []) if s[0] == "^" else []
        if times and any(good[x][1] >= 0.5 * t for x in inside):
            continue
        kept.add(max([s, *(x for x in inside if good[x][1] >= 0.97 * t)], key=lambda x: (x[0] == "=", len(x))) if not times else s)
    return sorted(kept, key=lambda s: (beyond_chance(*good[s], base), s))


def label_model(votes: np.ndarray, base: float, prior: np.ndarray | None = None, rounds: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Posteriors of class 1 for rows of votes (1, or 0 for none); each voter's rates in the classes; the correlations
    of voters' residuals given the class, where above a half. Votes cast on one text that correlate share one voice. prior: for each voter how many votes count beforehand as cast in class 1 and in class 0 (for one
    that seldom votes beside others, the votes alone can't tell). A voter that does not vote says nothing, so odds come from the votes cast alone. The last voter speaks for class 0.
    """
    n, m = votes.shape
    post = np.where(votes[:, :-1].sum(1) > 0, 0.9, 0.05)
    more = np.zeros((m, 2)) if prior is None else prior
    total = more.max(0)
    share = np.ones((n, m))
    near = np.eye(m)
    for step in range(rounds):
        a = (post @ votes + more[:, 0] + 0.5) / (post.sum() + total[0] + 1.0)
        b = ((1 - post) @ votes + more[:, 1] + 0.05) / ((1 - post).sum() + total[1] + 1.0)
        if step == rounds // 2:
            spread = votes - np.outer(post, a) - np.outer(1 - post, b)
            size = np.sqrt((spread**2).sum(0)) + 1e-9
            near = (spread.T @ spread) / np.outer(size, size)
            near = np.where(near > 0.5, near, 0)
            share = 1 / np.maximum(1, votes @ near)
        odds = math.log(base / (1 - base)) + (votes * share) @ np.log(a / b)
        post = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return post, a, b, near


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 12, ridge: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights and bias for soft labels y, by Newton steps with a ridge on the weights."""
    full = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(full.shape[1])
    penalty = np.r_[np.full(x.shape[1], ridge), 1e-6]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(full @ w, -30, 30)))
        slope = full.T @ (y - p) - penalty * w
        step = np.linalg.solve((full * (p * (1 - p))[:, None]).T @ full + np.diag(penalty), slope)
        w = w + step * min(1.0, 4.0 / max(1e-9, np.abs(step).max()))
    return w[:-1], float(w[-1])


def is_held_out(key):
    return F.crc32(key.cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model:
    small_batches(docs.sparkSession)
    fixed = ["=" + w for w in INSULTS]
    usable = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where("k is not null and y in (0, 1)").where(~is_held_out(F.col("k")))
    usable = usable.groupBy("k").agg(F.max("y").alias("y")).orderBy(F.xxhash64("k"), "k").limit(sample)
    # at most `sample` rows of an id and a label: a few hundred KB; of rows of one id one teaches
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).join(F.broadcast(usable), "k")
    rows = rows.groupBy("k").agg(F.max("y").alias("y"), F.min("t").alias("t"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 400):
                part = batch.slice(lo, 400)
                every, toxic = Counter(), Counter()
                for y, t in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    own = terms(t)
                    every.update(own)
                    if y:
                        toxic.update(own)
                yield pa.RecordBatch.from_arrays([pa.array(list(every)), pa.array(list(every.values()), pa.int64()), pa.array([toxic[s] for s in every], pa.int64())], ["s", "n", "t"])

    classes = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    total = sum(classes.values())
    base = min(0.5, max(0.01, classes.get(1, 0) / max(1, total)))
    stats: list[tuple[str, int, int]] = []
    if classes.get(1) and classes.get(0):
        sums = rows.mapInArrow(tidied(count), "s string, n bigint, t bigint").groupBy("s").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
        stats = [tuple(r) for r in sums.where(f"t >= 3 and t >= {SURE} * n").orderBy("s").collect()]  # of the sample alone
    chosen = choose(stats, base)
    names = chosen + [w for w in fixed if w not in chosen]
    index = numbered(names)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([hits(t, index) for t in texts], pa.list_(pa.int32())), pa.array([patterns(t) for t in texts], pa.list_(pa.int32()))], ["k", "h", "p"])

    kind = rows.schema["k"].dataType.simpleString()
    got = sorted(rows.mapInArrow(tidied(vote), f"k {kind}, h array<int>, p array<int>").collect(), key=lambda r: (r["k"], r["h"], r["p"]))
    x = np.zeros((len(got), len(names)), np.float64)
    for i, r in enumerate(got):
        x[i, r["h"]] = 1
    if not chosen:
        return Model({s: 4.0 for s in names}, -2.0, {})
    insult = x[:, [index[w] for w in fixed]].any(1).astype(float)
    marks = np.array([r["p"] for r in got], float).reshape(len(got), len(PATTERNS))
    count_of = x[:, : len(chosen)].sum(1)
    votes = np.column_stack([x[:, : len(chosen)], insult, marks, count_of >= 2, count_of == 0])
    seen = {s: (t, n - t) for s, n, t in stats}
    told = PRIOR * np.array([seen[s] for s in chosen] + [(0, 0)] * (votes.shape[1] - len(chosen)), float)
    told[-1] = PRIOR * np.array([0.01 * classes[1], classes[0]])  # the voter for class 0
    post, a, b, near = label_model(votes, base, told)
    w, bias = logistic(x, post)
    voters = [*chosen, "insults", *PATTERNS, "several", "none"]
    return Model(dict(zip(names, w.tolist())), bias, {v: (float(p), float(q), float(r)) for v, p, q, r in zip(voters, a, b, near.sum(1))})


def score(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, then score and predicted."""
    small_batches(docs.sparkSession)
    keep = own_columns(keep, ("score", "predicted"))
    kept = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]] + ["score double", "predicted int"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                s = [model.score(t) for t in part.column(part.num_columns - 1).to_pylist()]
                own = [part.column(i) for i in range(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(s, pa.float64()), pa.array([int(v >= 0.5) for v in s], pa.int32())], [*keep, "score", "predicted"])

    return kept.mapInArrow(tidied(run), ", ".join(fields))
