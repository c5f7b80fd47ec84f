import re

import numpy as np
from recurscan.llm import extraction as ex


def test_blocks_and_noise():
    page = """<!DOCTYPE html><html lang=en><head><title>T</title><style>p{x:"</p>"}</style><script>var t="<p>no</p>";</script></head><body class="widget-page">
    <header>site</header><nav><ul><li><a href="/x">Menu</a></ul></nav><!-- <p>hidden</p> --><div class="ad-box ad">buy</div><div id='cookie-notice'>cookies</div>
    <article class="post comment"><h1>Head &amp; <i>line</i>&am</h1><p><b>One
    two<br>three<p>Four&nbsp;&#233; &lt;p&gt;<div class=share>share</div><table><tr><td>a<td>b</tr></table><form><p>f</p></form>
    <ul><li>x<li>y</ul><section id="comments"><p>reader</p></section></article><aside>side</aside><footer>&copy; f</footer></body>"""
    assert ex.extract_group([page], [1]) == ["Head & line&am\nOne two three\nFour é <p>\na b\nx\ny"]
    assert ex.extract_group([""], [1]) == [""]
    assert ex.extract_group(["no markup, a < b and c > d"], [1]) == ["no markup, a < b and c > d"]
    assert ex.extract_group(["<p>x<script>never closed"], [1]) == ["x"]
    assert ex.extract_group(["<b>bold</p> on</b> <p>z"], [1]) == ["bold\non\nz"]


def naive(pages, owner, least):
    where = {}
    for p, tokens in enumerate(pages):
        for i in range(len(tokens) - least + 1):
            where.setdefault(tuple(tokens[i : i + least]), set()).add(owner[p])
    out = []
    for tokens in pages:
        on = np.zeros(len(tokens), bool)
        for i in range(len(tokens) - least + 1):
            if len(where[tuple(tokens[i : i + least])]) > 1:
                on[i : i + least] = True
        out.append(on)
    return out


def test_runs_equal_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(20):
        pages = [[str(x) for x in rng.integers(0, 3, rng.integers(0, 60))] for _ in range(6)]
        owner = [1, 2, 3, 3, 4, 5]
        assert all((a == b).all() for a, b in zip(ex.covered(pages, owner, 8), naive(pages, owner, 8)))


def test_unmarked_pages_lose_repeats_and_keep_unique_runs():
    menu = "home news about us contact press jobs and legal terms"
    pages = [f"<div>{menu}</div><div>own text number {i} of this page {'abcdef'[i]}</div><p>{menu} tail{i}</p>" for i in range(4)]
    assert ex.extract_group(pages, [0, 1, 2, 3])[2] == "own text number 2 of this page c\ntail2"
    same = [f"<article><p>{menu}</p></article>"] * 3
    assert ex.extract_group(same, [0, 1, 2]) == [menu] * 3


def test_frame(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: r for r in ex.extract(df).collect()}
    for r in df.collect():
        inner = re.search("<article>(.*?)</article>", r.html, re.S)[1]
        want = [" ".join(ex.html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split("<p>|</p>|<h1>|</h1>", inner)]
        assert got[r.page_id].text == "\n".join(w for w in want if w)
        assert (got[r.page_id].url, got[r.page_id].n_chars) == (r.url, len(got[r.page_id].text))
    rows = [(i, None if i == 3 else f"http://h.example/{i}", None if i == 5 else f"<p>word{i} " + "same words on every page of this host here", "x") for i in range(40)]
    odd = spark.createDataFrame([*rows, rows[7], (None, "http://[bad", "<p>z", "y")], "page_id long, url string, html string, host string")
    out = ex.extract(odd, group=4).collect()
    assert len(out) == 42 and {r.text for r in out if r.page_id == 5} == {""} and {r.text for r in out if r.page_id == 7} == {"word7"}
    assert ex.extract(odd.limit(0)).count() == 0
