import hashlib

from recurscan.llm import lz


def brute(text):
    """Phrases by the textbook rule."""
    seen, at = set(), 0
    for end in range(1, len(text) + 1):
        if text[at:end] not in seen:
            seen.add(text[at:end])
            at = end
    return seen


def test_phrases_and_edit():
    for t in ("", "a", "aaaa", "abababab" * 9, "the cat and the hat " * 40, "é🙂" * 50):
        root: dict = {}
        ends, _ = lz._extend(t, root, root, 0)
        assert {t[a:b] for a, b in zip([0, *ends], ends)} == brute(t)
        for cut, tail in ((len(t) - len(t) // 3, "tail the cat"), (0, "x")):
            assert lz.signatures_with_edit(t, cut, tail) == (lz.signature(t), lz.signature(t[:cut] + tail))
    big = "".join(chr(97 + i * i * 7 % 26) + str(i) for i in range(3000))
    assert len(lz.signature(big)) == lz.K
    assert lz.likeness([], []) == 1 and lz.likeness([], [1]) == 0 and lz.likeness([1, 2], [1, 2]) == 1 and lz.likeness([1, 2], [2, 3]) == 1 / 3


def test_neighbours(spark):
    rows = [(i, None if i == 4 else "" if i == 7 else f"document {i} says " + "lorem ipsum " * (i % 5) + str(i * 7919), "x") for i in range(60)]
    rows += [(9, "twin", "x"), (9, "twin", "x"), (None, "without id", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string").repartition(3)
    got = sorted(map(tuple, lz.compare_with_next(df).collect()), key=str)
    order = sorted(((lz.LOWEST if i is None else i, t or "", i) for i, t, _ in rows), key=lambda r: (-r[0], r[1]))
    want = []
    for k, (_, t, i) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        n = len(t) // 3
        e = t[: len(t) - n] + nxt[:n]
        a, b, c = lz.signature(t), lz.signature(e), lz.signature(nxt)
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), lz.to_text(a), lz.to_text(b), lz.likeness(a, b), lz.likeness(a, c)))
    assert got == sorted(want, key=str)
    one = lz.compare_with_next(df.filter("doc_id = 3")).collect()
    assert len(one) == 1 and one[0].near_next == 1
    assert lz.compare_with_next(df.limit(0)).count() == 0
    assert lz.fingerprint(df).count() == 63
