import numpy as np
from recurscan.llm import extraction as ex


def test_squeezed_keeps_what_counts():
    rng = np.random.default_rng(0)
    for _ in range(50):
        n = int(rng.integers(1, 60))
        r, o, g = rng.integers(0, 9, n).astype(np.uint64), rng.integers(0, 4, n).astype(np.uint64), rng.integers(-2, 3, n)
        told = lambda r, o, g: {(a, b) for a, b in zip(r, g) if b and len(set(o[r == a])) > 1}
        once = ex.squeezed(r, o, g)
        assert told(*once) == told(r, o, g) == told(*ex.squeezed(*once))
        assert set(once[0]) == set(r) and all((len(set(once[1][once[0] == a])) > 1) == (len(set(o[r == a])) > 1) for a in r)


def test_groups_of_one_host_find_each_others_repeats(spark):
    rows, pages = [], []
    for i in range(60):
        notice = f"notice {i // 2} which just two pages of this large host have in common"
        art = f"<article><p>notice {i // 2} which just two pages</p></article>" if i % 5 == 0 else ""
        page = f"<div>own text number {i} of page {i}</div>{art}<div>{notice}</div>"
        pages.append(page)
        rows.append((i, f"http://large.example/{i}", page))
    rows += [(100 + i, f"http://small{i}.example/", pages[0]) for i in range(3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in ex.extract(df, group=4).collect()}
    want = ex.extract_group(pages, list(range(60)))
    assert [got[i] for i in range(60)] == want and not any("in common" in t for t in want)
    assert len(got) == 63 and all("in common" in got[100 + i] for i in range(3))
