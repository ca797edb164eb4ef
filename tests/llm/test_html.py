"""HTML extraction: the parser on awkward markup, the field against enumeration, held-out pages, and the query."""

import html
import itertools
import math
import random
import re
import time

import pytest

from mensura.llm import html_crf
from mensura.llm.catalog import QUERIES
from mensura.llm.dom_blocks import parse

PROSE = [f"Sentence number {i} tells of {w} and the weather, at some length. It ends here." for i, w in enumerate("rivers stones mills roads".split() * 5)]


@pytest.mark.parametrize("page, texts", [
    (None, []), ("", []), ("   \n", []), ("plain & simple", ["plain & simple"]),
    ("<p>one<p>two<ul><li>a<li>b</ul>c", ["one", "two", "a", "b", "c"]),
    ("<p>a<br>b\n\t c&nbsp;d &amp;amp; &lt;e&gt; &#233;</p>", ["a b c d &amp; <e> é"]),
    ("<p>fo<b>o</b>b<i>ar</i></p>", ["foobar"]),
    ("x<script>if (a < b) '</p>';</script>y<style>p{}</style>", ["xy"]), ("a<!-- <p>no</p> -->b<!-->c", ["abc"]),
    ("<a title='x>y'>in</a> 1 < 2 <3", ["in 1 < 2 <3"]), ("<table><tr><td>1<td>2<tr><td>3</table>4", ["1", "2", "3", "4"]),
    ("<title>T</title><SCRIPT>x</script >z", ["z"]), ("cut <p class=", ["cut"]), ("a<script>never closed", ["a"]), ("<svg>open <p>kept</p>", ["open", "kept"]),
    ("<div><p>a</div>b</p></section>c", ["a", "b", "c"]), ('<p id="never closed>a</p><p>b</p>', ["a", "b"]),
])
def test_blocks(page, texts):
    assert [b.text for b in parse(page)[0]] == texts


def test_ancestors_of_blocks():
    blocks, title = parse('<title> A &lt;\n B </title><article><p>x<aside class="Ad-slots userComments"><p>y</aside></article>z')
    assert title == "A < B"
    assert [("t=article" in b.element.marks, "c=ad" in b.element.marks, "c=comment" in b.element.marks) for b in blocks] == [
        (True, False, False), (True, True, True), (False, False, False)]


@pytest.mark.parametrize("page", ["<div>" * 60_000 + "x", "<a href='" * 60_000, "<svg>" * 60_000, "<b " * 60_000, "<p><b>a<br>" * 60_000,
                                  "<li><ul>" * 60_000, "<td></div>" * 60_000, '<a x="' + ">" * 60_000, "</p>" * 60_000, "<!--" * 60_000])
def test_time_is_linear(page):
    begin = time.process_time()
    parse(page)
    assert time.process_time() - begin < 5


def paths(scores, kinds, edges):
    for labels in itertools.product((0, 1), repeat=len(scores)):
        yield labels, sum(s for s, x in zip(scores, labels) if x) + sum(edges[k][a][b] for k, a, b in zip(kinds[1:], labels, labels[1:]))


def test_viterbi_is_the_best_of_all_labellings():
    rng = random.Random(5)
    for _ in range(200):
        n = rng.randint(0, 8)
        scores, kinds = [rng.gauss(0, 2) for _ in range(n)], [rng.randint(0, 1) for _ in range(n)]
        edges = [[[rng.gauss(0, 1) for _ in range(2)] for _ in range(2)] for _ in range(2)]
        best = max(paths(scores, kinds, edges), key=lambda x: x[1])[0] if n else ()
        assert tuple(html_crf.viterbi(scores, kinds, edges)) == best
    assert html_crf.viterbi([0.0, 0.0], [0, 1], [[[0, 0], [0, 0]]] * 2) == [0, 0]


def likelihood(pages, model):
    """Mean penalised log likelihood of labelled pages, by summing over all labellings."""
    total = 0.0
    for page, labels in pages:
        blocks, title = parse(page)
        flags = html_crf._landmarks(blocks)
        scores = [sum(model.weights.get(f, 0.0) for f in html_crf.text_features(b, title, flags) + html_crf.element_features(b.element)) for b in blocks]
        kinds = [0, *(int(a.element.up == b.element.up) for a, b in zip(blocks, blocks[1:]))]
        each = dict(paths(scores, kinds, model.edges))
        total += each[tuple(labels)] - math.log(sum(map(math.exp, each.values())))
    square = sum(w * w for w in model.weights.values()) + sum(x * x for k in model.edges for r in k for x in r)
    return total / len(pages) - html_crf.DECAY / 2 * square


def test_fit_reaches_the_top_of_the_likelihood():
    pages = [(p, y) for p, y in html_crf.built_pages(PROSE, 400, seed=2) if 2 <= len(y) <= 9][:25]
    pages = [(p, [1 - x if i % 6 == 0 else x for x in y]) for i, (p, y) in enumerate(pages)]      # not separable
    model = html_crf.fit(pages, rounds=600)
    top = likelihood(pages, model)
    rng = random.Random(1)
    for _ in range(20):
        moved = html_crf.Model({f: w + rng.gauss(0, 0.05) for f, w in model.weights.items()},
                               [[[x + rng.gauss(0, 0.05) for x in r] for r in k] for k in model.edges])
        assert likelihood(pages, moved) < top + 1e-3
    assert html_crf.fit([]).weights == {}


def text_of(spark, pages, model):
    rows = spark.createDataFrame([(i, "u", p, "t", 1) for i, p in enumerate(pages)], "page_id long, url string, html string, text string, n_blocks int")
    return [r.text for r in html_crf.extract(rows, model).orderBy("page_id").collect()]


def test_held_out_layouts(spark):
    model = html_crf.fit(html_crf.built_pages(PROSE, 1200, seed=3))
    other = html_crf.built_pages([p.upper() for p in PROSE], 300, seed=4)
    wrong = sum(x != y for p, labels in other for (_, x), y in zip(html_crf.decide(p, model), labels))
    assert wrong < 0.01 * sum(len(labels) for _, labels in other)
    page = f"""<body><div id=navbar><a href=/>Home</a> <a href=/x>News</a></div><div class="cookie-notice">{PROSE[0]}</div>
        <div class="post-content"><h1>A title of words</h1><p>{PROSE[1]}</p><p>Short.</p><div class=advert>{PROSE[2]}</div><p>{PROSE[3]}
        </div><div id=comments><h3>2 Comments</h3><div class=comment><p>{PROSE[4]}</p></div></div><form><label>Mail</label><input></form>
        <div class=sidebar><p>{PROSE[5]}</p></div><div class=footer>© 2020</div>"""
    assert text_of(spark, [page, None, "", "<p></p>", page], model) == [
        f"A title of words\n\n{PROSE[1]}\n\nShort.\n\n{PROSE[3]}", "", "", "", f"A title of words\n\n{PROSE[1]}\n\nShort.\n\n{PROSE[3]}"]
    long = f"<article><p>{PROSE[0]}</p>" + f"<p>{'word ' * 20}</p>" * 20_000 + "</article>"
    assert len(text_of(spark, [long], model)[0]) > 1_900_000


def test_tables_without_pages(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    model = html_crf.learn(none)
    assert html_crf.extract(none, model).count() == 0
    nulls = spark.createDataFrame([(None, None, None), (1, None, "<p>x"), (1, None, "<p>x")], none.schema)
    assert sorted((r.page_id or 0, r.n_chars, len(r.text)) for r in html_crf.extract(nulls, html_crf.learn(nulls)).collect())[0] == (0, 0, 0)


def test_query_equals_the_article_elements(spark, sf):
    """The given pages hold one article element, with blocks cut by h1, p, and a b that is left open."""
    want = {}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        inside = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub("<br>", " ", x))).split()) for x in re.split(r"</?(?:h1|p)>", inside)]
        text = "\n\n".join(x for x in parts if x)
        want[r.page_id] = (r.url, text, len(text))
    got = QUERIES["op12_html_crf"](spark, sf).collect()
    assert {r.page_id: (r.url, r.text, r.n_chars) for r in got} == want and len(got) == len(want)
