import html
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from readloom.llm import html_text


def test_query(spark, sf):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = html_text.op6_main_text(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        page = pages[r.page_id].html
        start, end = page.find("<article>"), page.find("</article>")
        body = re.sub(r"<[^>]*$", "", page[start + 9 : end if end >= 0 else len(page)])
        want = " ".join(" ".join(html.unescape(x) for x in re.split(r"<[^>]*>", re.sub("</?b>", "", body))).split())
        assert (r.text, r.n_chars, r.url) == (want, len(want), pages[r.page_id].url)


def test_structure():
    page = (
        '<!DOCTYPE html><head><title>t</title></head><body class="page"><header><h1>site</h1></header><div class="cookie-notice">we <div>use</div> cookies</div>'
        '<main><h1>Head</h1><p>a <b>b</b>c&nbsp;&amp; d<br>e<form><input name=q>f</form><aside>s</aside><script>if (a < b) "</p>"</script><!-- no --><p>g<div id="comments">bad</div>h</main><footer>z'
    )
    article = [t for role, t in html_text.blocks(page) if role == html_text.ARTICLE]
    assert " ".join(article) == "Head a bc & d e g h"
    wrapped = '<body class="has-sidebar no-ads"><form id="page-menu-form"><div class="content with-sidebar"><article class="post">kept<section class="comments"><article>bad</article></section></article><article class="comment">bad</article></div></form><div class="cookiebar">no</div>'
    assert [t for role, t in html_text.blocks(wrapped) if role == html_text.ARTICLE] == ["kept"]
    assert " ".join(t for _, t in html_text.blocks("a < b <p>x<a href='y")) == "a < b x"
    assert list(html_text.blocks("")) == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=14), max_size=6))
def test_repeated_runs(pages):
    run = 4
    where = {}
    for i, p in enumerate(pages):
        for j in range(len(p) - run + 1):
            where.setdefault(tuple(p[j : j + run]), set()).add(i)
    for p, got in zip(pages, html_text.repeated(pages, run)):
        want = np.zeros(len(p), bool)
        for j in range(len(p) - run + 1):
            if len(where[tuple(p[j : j + run])]) > 1:
                want[j : j + run] = True
        assert got.tolist() == want.tolist()


def test_pages_without_an_article_lose_what_the_host_repeats(spark):
    menu = "home news about contact imprint terms privacy help login"
    rows = [(i, f"https://h.example/{i}", f"<div>{menu}</div><p>story{i} told once with word{i}</p>") for i in range(5)]
    rows += [(9, None, None), (10, "", ""), (11, "https://other.example/", f"<p>{menu}</p>"), (11, "https://other.example/", "<article>x</article>y")]
    got = sorted((r.page_id, r.text) for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got == [(i, f"story{i} told once with word{i}") for i in range(5)] + [(9, ""), (10, ""), (11, menu), (11, "x")]


def test_groups_of_a_large_host_find_what_they_repeat_together(spark, monkeypatch):
    footer = [" ".join(f"f{k}w{j}" for j in range(9)) for k in range(20)]
    rows = [(i, f"https://h.example/{i}", f"<footer>{footer[i % 20]} end{i}</footer><article>story{i}</article>") for i in range(40)]
    rows.append((99, "https://h.example/99", f"<footer>{' '.join(f'own{j}' for j in range(10))}</footer><article>story</article>"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    whole = sorted(html_text.main_text(pages).collect())
    monkeypatch.setattr(html_text, "GROUP_BYTES", 200)
    assert sorted(html_text.main_text(pages).collect()) == whole
    assert [r.n_repeated for r in whole] == [9] * 40 + [0]


def test_copies_and_shared_passages_are_not_boilerplate(spark, monkeypatch):
    menu = "home news about contact imprint terms privacy help login"
    words = lambda name, n: " ".join(f"{name}{j}" for j in range(n))
    passage = words("quote", 10)
    stories = {i: words(f"s{i}x", 30) for i in range(4)}
    stories |= {4: stories[0], 5: stories[0], 6: stories[0].replace("s0x7", "other"), 7: stories[0].replace("s0x20", "another")}
    stories |= {i: f"{words(f's{i}a', 15)} {passage} {words(f's{i}b', 15)}" for i in (8, 9, 10)}
    stories[11] = ""
    rows = [(i, f"https://h.example/{i}", f"<div>{menu}</div><div>{s}</div>") for i, s in stories.items()]
    rows += [(i, "https://two.example/", f"<div>{words('t', 20)}</div>") for i in (20, 21)]
    rows += [(i, "https://near.example/", f"<div>{words('t', 20)} {i} {words('u', 20)}</div>") for i in (30, 31, 32, 33)]
    want = stories | dict.fromkeys((20, 21), words("t", 20)) | {i: f"{words('t', 20)} {i} {words('u', 20)}" for i in (30, 31, 32, 33)}
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    whole = sorted(html_text.main_text(pages).collect())
    assert {r.page_id: r.text for r in whole} == want
    monkeypatch.setattr(html_text, "GROUP_BYTES", 300)
    assert sorted(html_text.main_text(pages).collect()) == whole


def test_chrome_whose_end_tag_is_left_out():
    article = lambda page: " ".join(t for role, t in html_text.blocks(page) if role == html_text.ARTICLE)
    assert article('<article><p class="notice">N<p>Body</p><p>More</p></article>') == "Body More"
    assert article('<article><p class="notice">N <b>n</b><div>Body</div><p>More</article>') == "Body More"
    assert article('<article><ul><li class="ad">N<ul><li>n<li>n</ul>n<li>Body</ul><p>More</article><li>x') == "Body More"
    assert article('<article><table><tr><td class="ad">N<table><tr><td>n</table>n<td>Body<tr class="ad"><td>N<tr><td>More</table>End</article>') == "Body More End"
    assert article('<article><dl><dt class="ad">N<dd>Body<dd class="ad"><p>N</dl>More</article>x') == "Body More"
    assert article('<article><ul><li class="related"><article>bad</article>bad<li>Body</ul>More</article>x') == "Body More"
    assert article('<article><ul><li class="ad">N<div>n</article>x') == ""
    assert article('<article><p class="ad">N<br>n<img src=x>n</p>Body</article>') == "Body"
    assert [t for role, t in html_text.blocks('<div><p class="ad">N</div>Body') if role == html_text.OPEN] == ["Body"]


def test_odd_pages(spark):
    long = "<p>" + " ".join(f"w{i % 977}" for i in range(60_000)) + "</p>"
    rows = [(1, None, None, 7), (1, None, None, 7), (None, "https://h.example/a", "<article>x &amp; y</article>", None), (2, "https://h.example/b", long, 1), (2, "https://h.example/b", f"<article>{long}</article>", 1), (3, "not a url", "  \n ", 2), (4, "https://h.example/c", "<article></article><p>outside</p>", 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text long").withColumnRenamed("text", "n_chars")
    got = sorted(((r.page_id, r.url, r.text) for r in html_text.main_text(pages).collect()), key=str)
    body = long[3:-4]
    want = [(1, None, ""), (1, None, ""), (None, "https://h.example/a", "x & y"), (2, "https://h.example/b", body), (2, "https://h.example/b", body), (3, "not a url", ""), (4, "https://h.example/c", "outside")]
    assert got == sorted(want, key=str)
    assert html_text.main_text(pages.limit(0)).count() == 0


def test_hosts_that_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(html_text, "GROUP_BYTES", 300)
    menu = "home news about contact imprint terms privacy help login"
    rows = [(i, f"https://h{i % 2}.example/{i}", f"<div>{menu}</div><p>story{i} told once with word{i} and no more than that</p>") for i in range(12)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    whole = sorted(html_text.main_text(pages).collect())
    monkeypatch.setattr(html_text, "BROADCAST_HOSTS", 0)
    assert sorted(html_text.main_text(pages).collect()) == whole
    assert [r.text for r in whole] == [f"story{i} told once with word{i} and no more than that" for i in range(12)]
