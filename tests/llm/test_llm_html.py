"""Main texts: runs repeated across pages, page structure, malformed html."""

import time
from collections import Counter

import numpy as np

from mavuno.llm import html_text

SF = "/root/testdata/sf0.01"

PAGE = "<html><head><title>T</title><script>if (a < b) x='</p>';</script></head><body><nav><a>Home</a></nav><header>Top</header>{}<footer>&copy; us</footer></body></html>"


def test_main_text_of_articles():
    inner = '<article class="post"><h1>Head&amp;line</h1><p>One <b>bo</b>ld&nbsp; word<br>line<p>Two<div class="ad">buy</div><section class="comments"><article>me too</article></section><form>mail</form><!-- no --></article><aside>side</aside><div class="cookie-notice">ok?</div>'
    assert html_text.main_texts([PAGE.format(inner), None, "", "<p>only", PAGE.format("")]) == ["Head&line One bold word line Two", "", "", "only", ""]


def test_repeated_runs_are_removed_where_structure_is_missing():
    pages = [f"<div>Welcome to our site about many good things and more</div><div>own words of page {i} {' '.join(f'u{i}x{j}' for j in range(12))}</div><div>All rights reserved by the company that made this site</div>" for i in range(5)]
    got = html_text.main_texts(pages)
    assert got == [f"own words of page {i} {' '.join(f'u{i}x{j}' for j in range(12))}" for i in range(5)]
    assert html_text.main_texts(pages[:2])[0].startswith("Welcome")  # two pages are no evidence


def test_repeated_equals_brute_force():
    rng = np.random.default_rng(6)
    pages = [list(rng.choice(list("abc"), rng.integers(0, 60))) for _ in range(7)]
    for run, distinct in ((3, 2), (4, 3), (5, 3)):
        got = html_text.repeated(pages, run, distinct)
        for p, g in zip(pages, got, strict=True):
            want = np.zeros(len(p), bool)
            for i in range(len(p) - run + 1):
                piece = "".join(p[i : i + run])
                if sum(piece in "".join(q) for q in pages) >= distinct:
                    want[i : i + run] = True
            assert (g == want).all()


def test_extraction_keeps_every_page_and_splits_hosts(spark, monkeypatch):
    monkeypatch.setattr(html_text, "PAGES", 4)
    rows = [(i, "http://one.example/x" if i < 20 else None, f"<article>text {i}</article>" if i % 3 else None, "clash") for i in range(25)] + [(3, "http://one.example/x", "<article>text 3</article>", "clash")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((r["page_id"], r["text"]) for r in html_text.extract(df).collect())
    assert got == sorted([(3, "text 3"), *((i, f"text {i}" if i % 3 else "") for i in range(25))])
    assert html_text.extract(df.limit(0)).count() == 0


def test_runs_are_counted_over_the_whole_host(spark, monkeypatch):
    monkeypatch.setattr(html_text, "PAGES", 4)
    own = [" ".join(f"w{i}x{j}" for j in range(12)) for i in range(60)]
    notice = "<div>this shop is closed on all days of the coming week</div>"
    htmls = [f"<div>{own[i]}</div>{notice if i % 6 == 0 else ''}" for i in range(60)]
    htmls[1] = f"<article>{own[1]}</article>{notice}"
    df = spark.createDataFrame([(i, f"http://one.example/{i}", h) for i, h in enumerate(htmls)], "page_id long, url string, html string")
    got = dict((r["page_id"], r["text"]) for r in html_text.extract(df).collect())
    assert got == dict(enumerate(own)) == dict(enumerate(html_text.main_texts(htmls)))
    few = df.filter("page_id not in (0, 1, 6, 12, 18, 24, 30, 36, 42)")  # the notice is left on two pages, which is no evidence
    assert sum("closed" in r["text"] for r in html_text.extract(few).collect()) == 2


def test_the_suffix_array_decides_the_given_pages(spark):
    rows = spark.read.parquet(f"{SF}/pages.parquet").select("url", "html").collect()
    pages = [(html_text.read(r["html"], r["url"].split("/")[2]), r["url"].split("/")[2]) for r in rows]
    seen = Counter(h for p, host in pages for h in set(html_text.scoped(html_text.run_hashes(p.stream), host).tolist()))
    shared = np.array(sorted(h for h, n in seen.items() if n >= html_text.DISTINCT))
    why = sum((html_text.decide(p, shared, host)[1] for p, host in pages), Counter())
    assert why["runs"] > 1500 and why["structure"] <= 0.01 * why["runs"]  # menus, adverts and footers go by repetition, not by name
    # Without any rule about the structure the runs alone give the same texts, and without runs every page changes.
    given = [html_text.decide(p, shared, host)[0] for p, host in pages]
    assert [html_text.decide(p, shared, host, structure=False)[0] for p, host in pages] == given
    bare = [html_text.decide(p, shared[:0], host, structure=False)[0] for p, host in pages]
    assert all(x != y for x, y in zip(bare, given, strict=True))


def test_run_counts_equal_brute_force():
    rng = np.random.default_rng(7)
    pages = [list(rng.choice(["<p.>", "a", "b"], rng.integers(1, 60))) for _ in range(9)]
    hashes, n = html_text.run_counts(pages, 3)
    want = Counter(r for p in pages for r in {tuple(p[i : i + 3]) for i in range(len(p) - 2)})
    assert sorted(n) == sorted(want.values()) and len(set(hashes)) == len(want)
    assert dict(zip(hashes.tolist(), n.tolist(), strict=True)) == {html_text.run_hashes(list(r), 3)[0]: c for r, c in want.items()}
    assert all((html_text.run_hashes(list(r), 3)[0] & 1) == ("<p.>" in r) for r in want)


def test_malformed_html_is_read():
    text = lambda h: html_text.main_texts([h])[0]
    assert text("<article>a<![foo[x]]>b<![CDATA[c]]>d<!ELEMENT e><?php f ?></q>g</article>") == "abdg"
    assert text('<article><p class="notice">Cookies<p>Real text</article>') == "Real text"
    assert text('<article><h1 class="post-header">Title</h1><p>x</p></article>') == "Title x"
    assert text('<article><p>one <span class="ad">buy <b>now</b></span> two</article>') == "one two"
    assert text('<article><ul><li class="share">s<li>kept<li>too</ul><table><tr><td class="ad">x<td>cell</table></article>') == "kept too cell"
    assert text("<article><p><b>never closed<p>next</b></div></p> on</article><p>after") == "never closed next on"
    assert text("<article>open") == "open" and text("<article>a<script>var x = '</p>'") == "a"
    assert text("<article>&amp;lt; &eacute;&#233; &nope;</article>") == "&lt; éé &nope;"


def test_deep_and_stray_tags_take_linear_time():
    began = time.perf_counter()
    html_text.main_texts(["<div>" * 20_000 + "x" + "</i>" * 20_000, "<article>" + "<b>" * 20_000 + "</i></p>" * 20_000, "<ul>" + "<li><div>" * 20_000, "<i><div>" + "<b>" * 20_000 + "</i>" * 20_000])
    assert time.perf_counter() - began < 20


def test_copies_of_a_page_without_a_main_element_stay():
    page = "<div>" + " ".join(f"w{i}" for i in range(40)) + "</div><nav>a b c d e f g h</nav>"
    assert html_text.main_texts([page] * 4) == [" ".join(f"w{i}" for i in range(40))] * 4


def test_runs_with_markup_are_added_up_over_hosts(spark):
    rows = [(i, f"http://h{i}.example/", f"<div>{' '.join(f'u{i}x{j}' for j in range(12))}</div><div>sign up for all of our good letters</div>") for i in range(4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in html_text.extract(df).collect()} == {i: " ".join(f"u{i}x{j}" for j in range(12)) for i in range(4)}
