from pyspark.sql import functions as F
from recurscan.llm import jaccard
from recurscan.scratch import setting


def shuffled(spark, df):
    """Rows of df, and the rows that its jobs wrote to shuffles."""
    sc = spark.sparkContext
    sc.setJobGroup("asked", "")
    rows = df.collect()
    tracker, store, n = sc.statusTracker(), sc._jsc.sc().statusStore(), 0
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    for stage in {s for j in tracker.getJobIdsForGroup("asked") for s in tracker.getJobInfo(j).stageIds}:
        try:
            n += store.lastStageAttempt(stage).shuffleWriteRecords()
        except Exception:  # a skipped stage
            continue
    sc.setLocalProperty("spark.jobGroup.id", None)
    return rows, n


def test_texts_that_no_pair_names_are_not_shuffled(spark):
    """Disk: only the ends' texts leave their tasks (before, all texts were dealt by id for each list of pairs)."""
    texts = spark.range(-3000, 3000, 1, 3).select("id", F.concat(F.lit("one two three four five six seven "), F.floor(F.col("id") / 2).cast("string")).alias("text"))
    pairs = spark.createDataFrame([(-3000, -2999), (7, 9), (10, 11)], "a long, b long")
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        rows, n = shuffled(spark, jaccard._linked(pairs, texts))
    assert {tuple(r) for r in rows} == {(-3000, -2999), (10, 11)}
    assert n < 200


def test_filter_loses_none(spark):
    texts = spark.range(-20_000, 20_000).union(spark.range(1 << 62, (1 << 62) + 9))
    ends = texts.where("id % 3 = 0").union(texts.where("id % 6 = 0"))
    got = {r.id for r in jaccard._maybe(texts, ends).collect()}
    want = {r.id for r in ends.collect()}
    assert want <= got and len(got) < len(want) * 1.01
    assert jaccard._maybe(texts, ends.limit(0)).count() == 0
