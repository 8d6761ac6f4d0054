"""Main text of pages: known pages, and the cut against all labellings."""

from __future__ import annotations

import html as entities
import itertools
import random
import re
import time

import numpy as np
import pytest

from tillspark.llm import page_text
from tillspark.llm.page_blocks import FIRST_WEIGHTS, parse

SMALL = "/root/testdata/sf0.001"
W = np.array(FIRST_WEIGHTS)
P1 = "The harbour was quiet that morning, and only two boats had gone out before the fog came in."
P2 = "By noon, though, the wind had turned; the crews came back &amp; told\n what they had  seen."
P3 = "Nobody believed them at first. Later, everyone did."
TEXT = f"{P1}\n{' '.join(entities.unescape(P2).split())}\n{P3}"
BODY = f"<p>{P1}</p><p>{P2}</p><p>{P3}</p>"
NOISE = {
    "nav": '<nav><ul><li><a href="/">Home</a><li><a href="/n">News</a></ul></nav>',
    "menu class": '<div class="top-menu"><a href="/">Home</a> | <a href="/n">News of the whole wide world, today.</a></div>',
    "header": "<header><h1>The Daily Harbour</h1><p>All the news, every single day of the week.</p></header>",
    "footer": "<footer><p>&copy; 2024 The Daily Harbour, all rights reserved.</p></footer>",
    "sidebar": '<div id="rightSidebar"><h3>Most read</h3><p>A long teaser that reads like a paragraph, with commas, and stops.</p></div>',
    "aside": "<aside><p>Another long teaser that reads like a paragraph, with commas, and stops.</p></aside>",
    "cookie notice": '<div class="cookie-consent" role="dialog"><p>We use cookies to improve this site, and to measure it.</p><button>Accept</button></div>',
    "advert": '<div class="ad-slot"><p>Buy the best boots in town, now cheaper than ever before.</p></div>',
    "form": '<form action="/s"><label>Your mail, please.</label><input name=q value="x > y"><button>Send this form to us now.</button></form>',
    "comments": '<section id="comments"><article class="comment"><p>I was there, and it was not like this at all.</p></article></section>',
    "replies": '<ol class="replies"><li><p>Great story, thank you so much for writing this down.</p></li></ol>',
    "script": '<script>var a = "<p>not text, though it looks like some.</p>"; if (1 < 2) {}</script>',
    "style": "<style>p > b { content: 'Some text, in a style.' }</style>",
    "comment markup": "<!-- <p>A paragraph that was commented out, long ago.</p> -->",
    "hidden": '<div style="display: none"><p>Nobody can see this paragraph, whatever they do.</p></div>',
}
FRAMES = {
    "article": "<html><body>{before}<article><h1>Fog</h1>{body}{inside}</article>{after}</body></html>",
    "main": "<body class='has-sidebar'>{before}<main><div><h1>Fog</h1>{body}{inside}</div></main>{after}",
    "class": '<body><div class="page with-sidebar">{before}<div class="entry-content"><h1>Fog</h1>{body}{inside}</div>{after}</div></body>',
    "outer name": '<div id="sidebar-layout">{before}<article><header><h1>Fog</h1></header>{body}{inside}</article>{after}</div>',
}


@pytest.mark.parametrize("frame", FRAMES)
@pytest.mark.parametrize("noise", NOISE)
@pytest.mark.parametrize("place", ["before", "inside", "after"])
def test_boilerplate_goes_wherever_it_stands(frame, noise, place):
    if noise == "header" and place == "inside":
        pytest.skip("a header inside an article is the article's")
    parts = {"before": "", "inside": "", "after": ""} | {place: NOISE[noise]}
    page = FRAMES[frame].format(body=BODY, **parts)
    assert page_text.main_text(page, W) == f"Fog\n{TEXT}"


def test_all_boilerplate_at_once_without_any_named_article():
    other = "".join(NOISE.values())
    page = f"<html><body>{other}<div><div>{BODY}</div></div>{other}</body></html>"
    assert page_text.main_text(page, W) == TEXT


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("  \n\t ", ""), ("<html><body></body></html>", ""), (P1, P1),
    ("<article><p>a&nbsp;&lt;b&gt; &#233;&#x1F600; &bogus; &amp;amp;</p>", "a <b> é\U0001f600 &bogus; &amp;"),
    ("<article><h1>T<p>one <b>two<br>three<p>four</i> <em>five", "T\none two three\nfour five"),
    ("<ARTICLE><P CLASS=x>Up  per\n\tcase</P></ARTICLE>", "Up per case"),
    ("<article><ul><li>one<li>two</ul><table><tr><td>a<td>b<tr><td>c</table>", "one\ntwo\na\nb\nc"),
    ("<article><p>3 < 4 and 5 > 2, as said.</p><p title=\"a>b\">quoted</p><p title='never closed>rest", "3 < 4 and 5 > 2, as said.\nquoted\nrest"),
    ("<article><p>kept</p><script>lost <p>all", "kept"),
    ("<article><p>kept<!-- lost <p>all", "kept"), ("<article><p>kept</p><p cla", "kept"), ("<article><p>3 < 4", "3 < 4"),
])
def test_markup(page, text):
    assert page_text.main_text(page, W) == text


def energy(pull, links, labels):
    return sum(-p if x else 0 for p, x in zip(pull, labels)) + sum(
        w for a, out in enumerate(links) for b, w in out.items() if a < b and labels[a] != labels[b]
    )


def test_cut_is_smallest_of_all_labellings():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randrange(1, 10)
        pull = [rng.choice([-2.0, -1.0, -0.5, 0.0, 0.5, 1.0, 2.0]) * rng.random() for _ in range(n)]
        links = [{} for _ in range(n)]
        for _ in range(rng.randrange(0, 2 * n)):
            a, b = rng.randrange(n), rng.randrange(n)
            if a != b:
                links[a][b] = links[b][a] = rng.random()
        best = min(energy(pull, links, x) for x in itertools.product((0, 1), repeat=n))
        whole = page_text.minimum_cut(pull, links, list(range(n)))
        assert energy(pull, links, [i in whole for i in range(n)]) == pytest.approx(best)
        own, left = list(pull), [dict(x) for x in links]
        label = page_text.settle(own, left)
        rest = [i for i, x in enumerate(label) if x < 0]
        content = page_text.minimum_cut(own, left, rest) if rest else set()
        assert energy(pull, links, [label[i] == 1 or i in content for i in range(n)]) == pytest.approx(best)


def test_short_block_between_paragraphs_is_carried_by_the_cut():
    page = parse(f"<div><p>{P1}</p><div><a href='/x'>Fog</a></div><p>{P3}</p></div>")
    pull = page_text.scores(page, W)
    assert pull[1] < 0 and page_text.content_labels(page, W)[0]
    assert page_text.edges(page)[0][2] < page_text.ADJACENT


def test_pages_of_the_table(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    for r in page_text.extract(pages).join(pages.select("page_id", "html"), "page_id").collect():
        article = re.search("<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = (" ".join(entities.unescape(re.sub("</?b>|<br>", " ", b)).split()) for b in re.split("</?(?:h1|p)>", article))
        assert r["text"] == "\n".join(filter(None, blocks)) and r["n_chars"] == len(r["text"])


def test_odd_rows_and_weights_from_tables(spark):
    schema = "page_id long, url string, html string, text string, n_chars string, x int, y int, at long, b string"
    long = FRAMES["article"].format(before=NOISE["nav"], body=BODY * 3000, inside="", after="")
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<p>"), (None, "u", long), (4, "v", long), (4, "v", long)]
    df = spark.createDataFrame([(*r, "t", "n", 1, 2, 3, "b") for r in rows], schema)
    got = sorted(((r["page_id"] or 0, r["url"], r["text"], r["n_chars"]) for r in page_text.extract(df).collect()), key=str)
    full = "Fog\n" + "\n".join([TEXT] * 3000)
    assert got == sorted([
        (1, "u", "", 0), (2, None, "", 0), (3, "u", "", 0), (0, "u", full, len(full)), (4, "v", full, len(full)), (4, "v", full, len(full)),
    ], key=str)
    assert page_text.extract(df.limit(0)).collect() == []
    assert (page_text.learn(df.limit(0)) == W).all()
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    learnt = page_text.learn(pages)
    assert np.abs(learnt - W).max() > 0.1 and (page_text.learn(pages.repartition(7)) == pytest.approx(learnt, abs=1e-6))


@pytest.mark.parametrize("page", [
    "<div>" * 20_000 + P1, "<b>" * 20_000 + P1, "</p>" * 20_000, "<p" * 20_000, "<a href='" * 20_000, "<!--" * 20_000,
    "<p>x" * 20_000, "<ul><li><a>x" * 5_000, "&" * 50_000,
])
def test_odd_markup_takes_no_long_time(page):
    start = time.perf_counter()
    page_text.main_text(page, W)
    assert time.perf_counter() - start < 10
