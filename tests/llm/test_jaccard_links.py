from recurscan.llm import jaccard


def test_every_link_between_distinct_sets(spark):
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words[: 60 - i]) for i in range(30)] + [" ".join(words[:55]), "", None, "alone"]
    grams = [{tuple((t or "").split()[i : i + 5]) for i in range(len((t or "").split()) - 4)} for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = {(a, b) for a in range(30) for b in range(a + 1, 30) if 4 * len(grams[a] & grams[b]) >= 3 * len(grams[a] | grams[b])}
    assert len(want) > 200
    for tile in (jaccard.TILE, 6):
        got = jaccard.links(df, tile=tile).collect()
        assert len(got) == len(want) and {(r.a, r.b) for r in got} == want
