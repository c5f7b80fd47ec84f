import math
import re
from collections import Counter, defaultdict

from recurscan.llm import langid, queries
from recurscan.operators import joins

from test_langid import KINDS, corpus


def buckets(text):
    data = [b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in (text or "").encode()]
    out = []
    for i, b in enumerate(data):
        if b != 32:
            before, after = data[i - 1] if i else 32, data[i + 1] if i + 1 < len(data) else 32
            out.append(((before * 0x9E3779B1 + b * 0x85EBCA77 + after * 0xC2B2AE3D) % 2**32) >> 18)
    return out


def brute(taught, rows):
    """(key, language, probability, kept) of rows (key, text, declared, host, suffix); taught: (text, language)."""
    counts = defaultdict(Counter)
    for t, lang in taught:
        if t and lang and lang.strip():
            counts[lang.strip().lower()].update(buckets(t))
    langs = sorted(counts)
    logs = {x: (counts[x], math.log(sum(counts[x].values()) + 0.1 * 2**14)) for x in langs}
    seen = []
    for _, text, *_ in rows:
        b = buckets(text)
        ll = [sum(math.log(logs[x][0][k] + 0.1) - logs[x][1] for k in b) * min(len(b), 60) / max(1, len(b)) for x in langs]
        e = [math.exp(v - max(ll)) for v in ll]
        seen.append((len(b), [v - max(ll) for v in ll], [v / sum(e) for v in e]))
    able = [(r, p) for r, (n, _, p) in zip(rows, seen) if n]
    total = [1 + sum(p[i] for _, p in able) for i in range(len(langs))]
    base = [t / sum(total) for t in total]
    values = len({r[2] for r, _ in able if r[2] is not None}) + 1

    sums = [defaultdict(lambda: [0.0] * len(langs)) for _ in range(3)]
    for r, p in able:
        for s, value in zip(sums, r[2:5]):
            if value is not None:
                s[value] = [a + b for a, b in zip(s[value], p)]

    def others(column, value, own):
        return [max(0.0, a - b) for a, b in zip(sums[column][value], own)] if value in sums[column] else [0.0] * len(langs)

    out = []
    for (key, _, d, h, s), (n, ll, p) in zip(rows, seen):
        own = p if n else [0.0] * len(langs)
        near, there, told = others(2, s, own), others(1, h, own), others(0, d, own)
        prior = [(a + 100 * b) / (sum(near) + 100) for a, b in zip(near, base)]
        prior = [(a + 10 * b) / (sum(there) + 10) for a, b in zip(there, prior)]
        odds = [x + math.log(q) for x, q in zip(ll, prior)]
        if d in sums[0]:
            odds = [o + math.log((a + 0.5) / (t - x + 0.5 * values)) for o, a, t, x in zip(odds, told, total, own)]
        e = [math.exp(o - max(odds)) for o in odds]
        best = max(range(len(langs)), key=lambda i: e[i])
        prob = e[best] / sum(e) if n else 0.0
        out.append((key, langs[best] if n else "und", prob, n > 0 and prob >= 0.5))
    return out


def same(got, want):
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=str), sorted(want, key=str)):
        assert (a[0], a[1], a[3]) == (b[0], b[1], b[3]) and abs(a[2] - b[2]) < 1e-4, (a, b)


def test_values_frequent_and_rare_equal_brute_force(spark, monkeypatch):
    rows = [(i, t, f"{lang}-{i % 5}", h, f"{s}{i % 7}") for i, t, lang, h, s in corpus(300)]
    rows += [(1000 + i, "ra", f"{lang}-2", None, f"{lang}3") for i, lang in enumerate(("de", "en", "fr"))]
    rows += [(2000, "ra", None, None, "fr3"), (2001, "ra", "new", "h", None), (2002, None, "de-1", None, "de1"), (2003, "ra", None, None, None), rows[0], (None, "ra", "de-1", None, None)]
    df = spark.createDataFrame(rows, KINDS).repartition(3)
    model = langid.fit(spark.createDataFrame(corpus(), KINDS))
    want = brute([(t, x) for _, t, x, *_ in corpus()], rows)
    for hot in (0, 20, 4096):
        monkeypatch.setattr(langid, "lookup", lambda *a, hot=hot: joins.lookup(*a, hot=hot))
        out = langid.identify(df, model, declared="lang", host="host", suffix="suffix").collect()
        same([(r.doc_id, r.language, r.probability, r.kept) for r in out], want)


def test_query_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    rows = [(("d", r.doc_id), r.text, r.lang, r.source, None) for r in docs]
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        page, host = r.html or "", re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:@]*)", r.url or "")
        host = host[1].lower() if host else ""
        bare = re.sub(r"(?s)<!--.*?-->|<[^>]*>", " ", re.sub(r"(?is)<(script|style)\b.*?(</\1\s*>|\Z)", " ", page))
        told = re.search(r"(?is)<html\b[^>]*\slang\s*=\s*[\"']?([a-z]{2,3})", page)
        rows.append((("p", r.page_id), bare, told and told[1].lower(), host, host.rsplit(".", 1)[1] if "." in host else None))
    got = queries.op2_language_id(spark, sf_dir).collect()
    same([(("d", r.doc_id) if r.doc_id is not None else ("p", r.page_id), r.language, r.probability, r.kept) for r in got], brute([(r.text, r.lang) for r in docs], rows))


def test_clashing_and_kept_columns(spark):
    rows = [(i, t, lang, h, "x", 7.0, True, -1) for i, t, lang, h, s in corpus(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, host string, language string, probability double, kept boolean, u int")
    out = langid.identify(df, langid.fit(df), declared="lang", host="host", keep=tuple(df.columns))
    assert out.columns == ["doc_id", "text", "lang", "host", "u", "language", "probability", "kept"]
    assert all(r.language == r.lang and r.u == -1 for r in out.collect())
    one = langid.identify(df.select("doc_id", "text"), langid.fit(df), keep=("language", "doc_id"))
    assert one.columns == ["doc_id", "language", "probability", "kept"] and one.count() == 60


def test_ties_go_to_the_first_name(spark):
    df = spark.createDataFrame([(1, "abc abc", "xx"), (2, "abc abc", "aa"), (3, "zzz", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.language, r.kept) for r in langid.identify(df, langid.fit(df)).collect()}
    assert got[3] == ("aa", True)
