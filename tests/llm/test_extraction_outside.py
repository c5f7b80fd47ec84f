from recurscan.llm import extraction as ex


def test_unique_runs_outside_the_article_of_marked_pages_stay():
    notice = "please read our terms of use before you go on"
    pages = [f"<nav>menu</nav><article><p>teaser {i}</p></article><div>{notice}</div><div>body text of page {i} with {'abcd'[i]} in it</div>" for i in range(4)]
    assert ex.extract_group(pages, [0, 1, 2, 3]) == [f"teaser {i}\nbody text of page {i} with {'abcd'[i]} in it" for i in range(4)]
