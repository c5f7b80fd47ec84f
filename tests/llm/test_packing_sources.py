from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
from recurscan.llm import packing

ARGS = (P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


def test_every_source_keeps_its_share_beyond_most_queues(spark):
    rows = [(i, "word " * (5 + i % 7) * 8, f"s{i % 40}" if i % 41 else None) for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    few = packing.pack(df, *ARGS, length=64, window=4096).collect()
    source = {i: s for i, _, s in rows}
    total, windows = Counter(), defaultdict(Counter)
    for r in few:
        total[source[r.doc_id]] += r.length
        windows[(64 * r.sequence_id + r.offset) // 4096][source[r.doc_id]] += r.length
    tokens = sum(total.values())
    for w in range(tokens // 4096):
        for s, n in total.items():
            # no piece crosses a multiple of 4096; a window begins less than a token for each queue before it
            assert abs(windows[w][s] - 4096 * n / tokens) <= len(total)
    weighed = packing.pack(df, *ARGS, length=64, window=4096, weights={None: 50, 's0': 50}).collect()
    first = Counter()
    for r in weighed:
        if 64 * r.sequence_id + r.offset < 1024:
            first[source[r.doc_id]] += r.length
    assert set(first) <= {None, "s0"}  # queues are numbered by name, the null source first


def test_windows_hold_the_stated_mixture(spark):
    rows = [(i, "word " * (20 + i % 30), f"s{i % 3}") for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    out = packing.pack(df, *ARGS, length=64, window=1000, weights={"s0": 6, "s1": 3, "s2": 1}).collect()
    source, windows, total = {i: s for i, _, s in rows}, defaultdict(Counter), Counter()
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        for at in range(64 * r.sequence_id + r.offset, 64 * r.sequence_id + r.offset + r.length):
            windows[at // 1000][source[r.doc_id]] += 1
        total[source[r.doc_id]] += r.length
    full = total["s0"] // 600  # until the first queue runs dry
    assert full > 20
    for w in range(full):
        assert windows[w] == {"s0": 600, "s1": 300, "s2": 100}
    assert sum(total.values()) == sum(sum(w.values()) for w in windows.values())


def test_entitlements_are_exact_for_many_and_large_queues():
    rng = np.random.default_rng(0)
    for top in (10, 10**6, 10**9, 10**12, 10**14):
        totals = rng.integers(0, top, 500).tolist()
        for weights in (totals, [max(1, x % 97) for x in totals]):
            plan = packing.Schedule(totals, weights, 1 << 16, 1024)
            for r in (0, 1, 7, sum(totals) // (1 << 17), sum(totals) // (1 << 16), sum(totals) // (1 << 14)):
                assert plan.entitlements(r).tolist() == [plan.entitled(q, r) for q in range(500)]
                done = sum(plan.entitled(x, r + (x < 77)) for x in range(500))
                assert plan.edge(77, r) == (plan.entitled(77, r), plan.entitled(77, r + 1), done)
