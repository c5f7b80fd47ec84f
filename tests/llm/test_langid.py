import numpy as np
import pyarrow as pa
from recurscan.llm import langid

WORDS = {"en": "the of and with house water that this were from".split(), "de": "der die und mit haus wasser dass nicht waren für".split(), "fr": "le les et avec maison eau que cette étaient pour".split()}


def corpus(n=600):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(n):
        lang = ["en", "de", "fr"][i % 3]
        rows.append((i, " ".join(rng.choice(WORDS[lang], rng.integers(20, 60))), lang, f"host{i % 3}.{['com', 'de', 'fr'][i % 3]}", ["com", "de", "fr"][i % 3]))
    return rows


KINDS = "doc_id long, text string, lang string, host string, suffix string"


def test_trigrams_stay_inside_texts():
    h, first = langid.trigrams(pa.array(["ab", None, "1 2", "c"]))
    alone = [langid.trigrams(pa.array([t]))[0].tolist() for t in ("ab", "", "1 2", "c")]
    assert [h[a:b].tolist() for a, b in zip(first[:-1], first[1:])] == alone and [len(x) for x in alone] == [2, 0, 0, 1]


def test_languages_and_fusion(spark):
    rows = corpus()
    taught = spark.createDataFrame(rows, KINDS).repartition(4)
    model = langid.fit(taught)
    assert model.langs == ["de", "en", "fr"]
    odd = [(1000, "", None, None, None), (1001, None, "en", "host0.com", "com"), (1002, "123 !?", "en", None, None), (1003, "é", "fr", "host2.fr", "fr"), (1004, "ra", None, "host1.de", "de"), (1005, "ra", None, "host2.fr", "fr"), (1006, "der die und " * 20_000, "en", None, None)]
    more = spark.createDataFrame([*rows, *odd, rows[0]], KINDS)
    got = {r.doc_id: r for r in langid.identify(more, model, declared="lang", host="host", suffix="suffix").collect()}
    assert all(got[r[0]].language == r[2] and got[r[0]].kept for r in rows)
    assert [(got[i].language, got[i].kept, got[i].probability) for i in (1000, 1001, 1002)] == [("und", False, 0.0)] * 3
    assert got[1003].language == "fr" and got[1004].language == "de" and got[1005].language == "fr" and got[1006].language == "de"


def test_no_rows(spark):
    none = spark.createDataFrame([], KINDS)
    model = langid.fit(none)
    assert langid.identify(none, model).count() == 0
    assert langid.identify(spark.createDataFrame(corpus(3), KINDS), model).first().language == "und"
    page = spark.createDataFrame([('<!DOCTYPE html><html class="x" lang="pt-BR"><style>a{}</style><p>x<b>y</p>',)], "h string")
    r = page.select(langid.html_lang(page.h).alias("l"), langid.html_text(page.h).alias("t"), langid.suffix_of(langid.F.lit("a.example.org")).alias("s")).first()
    assert (r.l, r.t.split(), r.s) == ("pt", ["x", "y"], "org")
