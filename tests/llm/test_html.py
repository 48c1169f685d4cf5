import html as entities
import itertools
import random
import re
import time

import pytest

from cohortline.llm import html as X


def test_minimum_cut_equals_brute_force():
    rng = random.Random(1)
    for _ in range(150):
        n = rng.randint(1, 9)
        gain = [rng.uniform(-2, 2) for _ in range(n)]
        edges = [(a, b, rng.uniform(0, 1)) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.4]
        cost = lambda x: sum(max(0, g) if not k else max(0, -g) for g, k in zip(gain, x)) + sum(c for a, b, c in edges if x[a] != x[b])  # noqa: E731, B023
        assert cost(X.min_cut(gain, list(edges))) == pytest.approx(min(cost(x) for x in itertools.product([False, True], repeat=n)))


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><a href=/>Home</a></header>
<div class="sidebar"><p>menu one <a href=x>aa</a></div><div id="content"><h2>Title &amp;lt; here</h2>A text
 that goes on&nbsp;and on. Really &lt;b&gt;.<div>More <b>te</b>xt here, with a sentence.<br>And more of it.</div></div>
<div class="comments"><p>I like this article. It is great!</p></div><form>Search <input name=q></form><script>if (a<b) "</p>"</script>
<footer>(c) me</footer>"""


def test_page_without_an_article_element():
    want = "Title &lt; here\nA text that goes on and on. Really <b>.\nMore text here, with a sentence. And more of it."
    assert X.extract(PAGE) == (want, 3)


def test_own_tables_pages_are_extracted_exactly(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    weights = X.fit([r.html for r in pages])
    for r in pages:
        body = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        parts = (" ".join(entities.unescape(re.sub(r"</?b>|<br>", "", p)).split()) for p in re.split(r"</?(?:p|h1)[^>]*>", body))
        assert X.extract(r.html, weights)[0] == "\n".join(p for p in parts if p)


def test_nulls_empty_long_broken_and_clashing(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>" + "word " * 200_000 + "."), (3, "u", "<div>a" * 5000), (3, "u", "<div>a" * 5000), (4, "u", "a < b <<p>>x")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as text", "'y' as HTML")
    got = {(r.page_id, r.url): r.text for r in X.main_text(d, weights=X.PRIOR).collect()}
    assert got[1, "u"] == got[2, None] == "" and len(got[None, "u"]) == 5 * 200_000 + 1
    assert X.main_text(d.limit(0)).count() == 0 and X.main_text(d).count() == len(rows)


@pytest.mark.parametrize("text", ["<a href='" * 9000, "<!--" * 9000, "<" * 90_000, "</p>" * 9000, "<p" * 9000])
def test_broken_markup_takes_no_long_time(text):
    assert isinstance(X.extract(text)[0], str)


def test_flow_by_itself_equals_brute_force():
    rng = random.Random(4)
    for _ in range(150):
        n = rng.randint(1, 9)
        gain = [rng.uniform(-1, 1) for _ in range(n)]
        edges = [(a, b, rng.uniform(0, 1)) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.5]
        cost = lambda x: sum(max(0, g) if not k else max(0, -g) for g, k in zip(gain, x)) + sum(c for a, b, c in edges if x[a] != x[b])  # noqa: E731, B023
        assert cost(X._flow(gain, edges)) == pytest.approx(min(cost(x) for x in itertools.product([False, True], repeat=n)))


def test_adverts_between_paragraphs():
    text = "This is a paragraph of an article that goes on for a while, number %d of them."
    page = "<div><h1>The title of it</h1>" + "".join(f"<p>{text % i}</p><div class='ad'>Buy now %d</div>" % i for i in range(20)) + "</div>"
    assert X.extract(page) == ("\n".join(["The title of it", *(text % i for i in range(20))]), 21)


def test_long_pages_take_time_in_proportion():
    page = "<div>" + "".join(f"<p>One sentence here, {i}.</p><li><a href=x>go on {i}</a></li>" for i in range(50_000)) + "</div>"
    began = time.process_time()
    assert X.extract(page)[0]
    assert time.process_time() - began < 30


def test_shown_as_it_stands_and_labels_of_text():
    page = "<article><p>Some text is here, and goes on.</p><xmp>a <b> &amp; c</xmp><p><label>Note</label> that it ends.</p></article><form><label>Name</label></form>"
    assert X.extract(page)[0].split("\n") == ["Some text is here, and goes on.", "a <b> &amp; c", "Note that it ends."]


@pytest.mark.parametrize("advert", ["<div><a href='x'>Buy now and save {}</a></div>", "<p><a href='x'>Buy now and save {}</a></p>"])
def test_adverts_between_paragraphs_take_none_with_them(advert):
    texts = [f"This is paragraph number {i} of the story, and it tells what happened next on that day." for i in range(20)]
    page = "<body><div>" + "".join(f"<p>{t}</p>{advert.format(i)}" for i, t in enumerate(texts)) + "</div></body>"
    assert X.extract(page)[0].split("\n") == texts


def test_a_short_text_alone_on_a_page_is_kept():
    assert X.extract("<body><p>It rained.</p></body>")[0] == "It rained." and X.extract("<body><div>Hello there</div></body>")[0] == "Hello there"
