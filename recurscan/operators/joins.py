"""Joins: pairs, subset semi-join, multiset similarity join, backward as-of join, per-key cross."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import features
from ..functions.tokens import hashed_bags
from ..scratch import tables, written
from . import similar


HOT, MOST_HOT = 4096, 1 << 20


def lookup(rows: DataFrame, table: DataFrame, on: list[str], count: str, spread: list[str], hot: int = HOT, total: int | None = None) -> DataFrame:
    """rows left-joined with a table that has one row per key. Keys that more than `hot` rows have (by the table's column `count`,
    which is dropped) are few, so they are broadcast once their number is checked (total: the number of rows, where it is known;
    it bounds that of hot keys); the other keys meet in a shuffled join, in which
    rows of hot keys and of null ones are dealt by the columns `spread`, so no task gets all rows of a key."""
    values = [c for c in table.columns if c not in (*on, count)]
    if total is not None and total <= hot:
        return rows.join(table.select(*on, *values), on, "left").select(*rows.columns, *values)
    many = table.where(F.col(count) > hot).select(*on, F.struct(*values).alias("__hot"))
    few = total is not None and total // max(1, hot) <= MOST_HOT or many.limit(MOST_HOT + 1).count() <= MOST_HOT
    marked = rows.join(F.broadcast(many) if few else many, on, "left")
    done = F.col("__hot").isNotNull()
    for c in on:
        done = done | F.col(c).isNull()
    marked = marked.withColumn("__s", F.when(done, F.pmod(F.xxhash64(*spread), F.lit(1 << 20)) + 1).otherwise(0))
    cold = table.where(F.col(count) <= hot).select(*on, F.struct(*values).alias("__cold")).withColumn("__s", F.lit(0).cast("long"))
    both = marked.join(cold, [*on, "__s"], "left")
    return both.select(*rows.columns, *[F.coalesce(F.col("__hot")[v], F.col("__cold")[v]).alias(v) for v in values])


def old_new_pairs(functions: DataFrame, key: list[str], tag: str = "tag", id_: str = "id") -> DataFrame:
    """OLD joined with NEW of the same key: key, vuln_id, patch_id."""
    old = functions.where(F.col(tag) == "OLD").select(*key, F.col(id_).alias("vuln_id"))
    new = functions.where(F.col(tag) == "NEW").select(*key, F.col(id_).alias("patch_id"))
    return old.join(new, key)


def subset_semi_join(targets: DataFrame, corpus: DataFrame, bits: str = "bits", seed: int = 20231031, tries: int = 101, dropout: float = 0.17) -> DataFrame:
    """Targets that agree with a corpus vector on the positions kept by one of the tries, and the first such try.

    Exact where a bank of Bloom filters is approximate. Both sides have a row per distinct vector before keys are made, so
    equal vectors, however many, cost one set of keys.
    """
    masks = features.kept_masks(seed, tries, dropout)
    keys = lambda df: df.select(bits).distinct().select(F.col(bits).alias("v"), F.explode(features.subset_keys(F.col(bits), masks)).alias("k")).select("v", "k.*")
    columns = [c for c in keys(corpus).columns if c != "v"]
    found = keys(targets).join(keys(corpus).select(*columns).distinct(), columns, "left_semi").groupBy("v").agg(F.min("try").alias("first_try"))
    return targets.join(found, F.col(bits) == found["v"]).drop("v")


def bag(df: DataFrame, id_: str, tokens: str) -> DataFrame:
    """id, n (all tokens), token, cnt."""
    each = df.select(F.col(id_).alias("id"), F.size(tokens).alias("n"), F.explode(tokens).alias("token"))
    return each.groupBy("id", "n", "token").agg(F.count("*").alias("cnt"))


def _elements(df: DataFrame, id_: str, tokens: str) -> DataFrame:
    """A multiset as a set of (token, k): id, n, e."""
    rows = bag(df, id_, tokens)
    return rows.select("id", "n", F.explode(F.transform(F.sequence(F.lit(1).cast("long"), F.col("cnt")), lambda k: F.concat_ws("\x00", k.cast("string"), "token"))).alias("e"))


def multiset_jaccard_join(targets: DataFrame, corpus: DataFrame, threshold: float = 0.7, id_: str = "id", tokens: str = "tokens", code: str | None = None) -> DataFrame:
    """dst_id, vuln_id, n_dst, n_vuln, inter, sim of all pairs with multiset Jaccard similarity at or above the threshold.

    Equal multisets are one class each, so copies are compared once; their pairs are only listed at the end. Each set of elements (token, k) is
    ordered, rare ones first. Two similar sets share an element among the first
    n - ceil(threshold * n) + 1 of each, so only these are matched (with the bound on sizes). Of the set whose prefix ends first, all
    shared elements up to there are among the c matched ones, so the overlap is at most c and what lies behind that prefix;
    only pairs that can still reach the threshold are counted on whole sets. Where targets are the corpus, a pair is compared once.
    code: a column of texts in place of tokens; their bags are made in one step, a distinct token being one hash and a count.
    """
    same = targets is corpus

    def classes(df: DataFrame) -> tuple[DataFrame, DataFrame]:
        t = F.col(tokens)
        with tables(df.sparkSession):  # hashes of tokens are needed until each class has its bag
            if code:
                named = written(hashed_bags(df, id_, code), "bags")
            else:
                listed = df.select(F.col(id_).alias("of"), F.sha2(F.array_join(F.array_sort(t), "\x00"), 256).alias("h"), F.transform(t, lambda x: F.xxhash64(x)).alias("t"))
                named = written(listed, "bags").where(F.size("t") > 0)  # a filter before would make the tokens twice
            bags = [c for c in ("t", "k") if c in named.columns]
            one = written(named.groupBy("h").agg(F.any_value(F.struct(*bags)).alias("x")).select("h", "x.*").withColumn("id", F.monotonically_increasing_id()), "class-bags", keep=True)
            members = written(named.select("h", "of").join(one.select("h", "id"), "h").select("id", "of"), "classes", keep=True)
        return members, one.select("id", *bags)

    members, left = classes(targets)
    others, right = (members, left) if same else classes(corpus)
    pairs = similar.class_join(left, right, threshold, same)
    sim = F.col("inter") / (F.col("n_a") + F.col("n_b") - F.col("inter"))
    pairs = pairs.withColumn("sim", sim).where(F.col("sim") >= threshold).select(F.col("a").alias("dst_id"), F.col("b").alias("vuln_id"), F.col("n_a").alias("n_dst"), F.col("n_b").alias("n_vuln"), "inter", "sim")
    pairs = written(pairs, "class-pairs")
    if same:
        back = pairs.select(F.col("vuln_id").alias("dst_id"), F.col("dst_id").alias("vuln_id"), F.col("n_vuln").alias("n_dst"), F.col("n_dst").alias("n_vuln"), "inter", "sim")
        n = (F.aggregate("k", F.lit(0).cast("long"), lambda a, x: a + x) if code else F.size("t")).cast("long")
        equal = left.select(F.col("id").alias("dst_id"), F.col("id").alias("vuln_id"), n.alias("n_dst"), n.alias("n_vuln"), n.alias("inter"), F.lit(1.0).alias("sim"))
        pairs = pairs.unionByName(back).unionByName(equal)
    both = pairs.join(members.select(F.col("id").alias("dst_id"), F.col("of").alias("dst")), "dst_id").join(others.select(F.col("id").alias("vuln_id"), F.col("of").alias("vuln")), "vuln_id")
    return both.select(F.col("dst").alias("dst_id"), F.col("vuln").alias("vuln_id"), "n_dst", "n_vuln", "inter", "sim")


def bag_jaccard(pairs: DataFrame, left: DataFrame, right: DataFrame, by: tuple[str, str], name: str) -> DataFrame:
    """pairs with the similarity `name` of two bags (id, n, token, cnt), 0 for two empty ones; no pair is lost. A bag is one
    function's, so it is gathered in a row, if the function is in a pair. Sorted together, a token that both bags have stands
    beside itself, so one pass adds up the smaller counts."""
    asked = lambda bags, key: bags.join(pairs.select(F.col(key).alias("id")).distinct(), "id", "left_semi")
    gathered = lambda bags, key, column: asked(bags, key).groupBy(F.col("id").alias(key)).agg(F.collect_list(F.struct("token", "cnt")).alias(column), F.sum("cnt").alias(column + "n"))
    both = pairs.join(gathered(left, by[0], "__a"), by[0], "left").join(gathered(right, by[1], "__b"), by[1], "left")
    token, none = left.schema["token"].dataType.simpleString(), F.array()
    entries = F.concat(*[F.coalesce(c, none.cast(f"array<struct<token:{token},cnt:bigint>>")) for c in ("__a", "__b")])
    state = lambda t, cnt, n: F.struct(t.alias("token"), cnt.alias("cnt"), n.alias("n"))
    step = lambda s, x: state(x["token"], x["cnt"], s["n"] + F.when(s["token"] == x["token"], F.least(s["cnt"], x["cnt"])).otherwise(0))
    zero = F.lit(0).cast("long")
    least = F.aggregate(F.array_sort(entries), state(F.lit(None).cast(token), zero, zero), step, lambda s: s["n"])
    scored = both.withColumn("__n", least).withColumn("__m", F.coalesce("__an", zero) + F.coalesce("__bn", zero) - F.col("__n"))
    return scored.withColumn(name, F.coalesce(F.try_divide("__n", "__m"), F.lit(0.0))).drop("__a", "__b", "__an", "__bn", "__n", "__m")


def backward_asof(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, value: Column, name: str) -> DataFrame:
    """left with the value of the last right row of the same key strictly before it. One pass over the union, sorted by key and
    place; a key's rows stream through a running window."""
    marks = right.select(*by, F.col(right_on).alias("__at"), F.lit(1).alias("__side"), F.struct(value.alias("v")).alias("__v"), *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns if c not in by])
    rows = left.select(*by, F.col(left_on).alias("__at"), F.lit(0).alias("__side"), F.lit(None).cast(marks.schema["__v"].dataType).alias("__v"), *[c for c in left.columns if c not in by])
    w = Window.partitionBy(*by).orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, -1)
    both = rows.unionByName(marks).withColumn("__last", F.last("__v", ignorenulls=True).over(w))
    return both.where("__side = 0").select(*left.columns, F.col("__last")["v"].alias(name))


def per_key_cross(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    return left.join(right, by)


def set_differences(old: DataFrame, new: DataFrame, by: list[str], value: str) -> DataFrame:
    """Rows of only one side: by, value, side. Where a key has none at all on one side, neither side has any."""
    o, n = old.select(*by, value).distinct(), new.select(*by, value).distinct()
    both = o.select(*by).distinct().join(n.select(*by).distinct(), by, "left_semi")
    gone, come = o.join(n, [*by, value], "left_anti").withColumn("side", F.lit("OLD")), n.join(o, [*by, value], "left_anti").withColumn("side", F.lit("NEW"))
    return gone.unionByName(come).join(both, by, "left_semi")
