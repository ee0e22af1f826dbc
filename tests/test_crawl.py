import random
from collections import deque

import pytest

from provena.operators import search
from provena.sources import crawl

PAGES = "page_id long, url string, html string"


def reader(pages, seed, most=None, rounds=None):
    """A queue, as one reader would keep it; pages (address to (html links, length))."""
    queue, seen, out, documents = deque([(seed, 0)]), set(), [], 0
    while queue and (most is None or documents < most):
        url, depth = queue.popleft()
        if url in seen or url not in pages:
            continue
        seen.add(url)
        links, kept = pages[url]
        out.append((url, depth, kept))
        documents += kept
        if rounds is None or depth < rounds:
            queue.extend((link, depth + 1) for link in links if link.startswith("http://h"))
    return out


def site(n, seed):
    pick = random.Random(seed)
    return {f"http://h/{i}": ([f"http://{'other' if pick.random() < 0.1 else 'h'}/{pick.randrange(n + 5)}" for _ in range(pick.randrange(5))], pick.random() < 0.6) for i in range(n)}


@pytest.mark.parametrize("most,rounds", [(None, None), (7, None), (None, 2), (1, 9)])
def test_crawl_is_a_queue(spark, monkeypatch, most, rounds):
    monkeypatch.setattr(crawl, "PARENTS", 3)
    pages = site(60, 4)
    rows = [(i, url, "".join(f'<a href="{x}">l</a>' for x in links) + ("<p>" + "word " * 30 + "</p>" if kept else "")) for i, (url, (links, kept)) in enumerate(pages.items())]
    seeds = spark.createDataFrame([("http://h/0",), ("http://h/17#top",), ("http://h/0",), (None,), ("http://nowhere/",)], "seed string")
    got = crawl.crawl(spark.createDataFrame(rows, PAGES), seeds, most, rounds).collect()
    for seed in ("http://h/0", "http://h/17#top"):
        own = sorted((r for r in got if r.seed == seed), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, len(own) + 1))
        assert [(r.url, r.depth, r.kept) for r in own] == reader(pages, seed.partition("#")[0], most, rounds)
    assert {r.seed for r in got} == {"http://h/0", "http://h/17#top"}


def test_pages_with_nulls_and_one_address(spark):
    text = "<title>A: page!</title><p>" + "x" * 60 + "</p>"
    rows = [(1, "http://h/a", text + '<a href="b#2">b</a><a href="mailto:x@y">m</a>'), (2, "http://h/a", "other"), (3, "http://h/b", None), (4, None, text), (None, "http://h/c", text)]
    pages = spark.createDataFrame(rows, PAGES)
    found = crawl.crawl(pages, spark.createDataFrame([("http://h/a",)], "seed string"))
    assert [(r.page_id, r.depth, r["rank"], r.kept) for r in found.orderBy("rank").collect()] == [(1, 0, 1, True), (3, 1, 2, False)]
    (document,) = crawl.fetched(found, pages).collect()
    assert (document.id, document.name, document.title) == ("http://h/a", "A page.md", "A: page!") and document.length == len(document.markdown)
    assert crawl.crawl(pages.limit(0), spark.createDataFrame([("http://h/a",)], "seed string")).count() == 0


def test_candidates_of_synonyms_share_one_count(spark):
    texts = ["wage table", "salary table", "salary salary", "nothing"]
    passages = spark.createDataFrame([("l", i, i, "f", t, i) for i, t in enumerate(texts)], "library string, document int, chunk int, filename string, text string, ordinal int")
    asked = spark.createDataFrame([(1, "l", "wage table")], "query_id int, library string, query string")
    synonyms = {"wage": ["salary"]}
    plain = {r.chunk: r.score for r in search.search(passages, asked).collect()}
    joined = {r.chunk: r.score for r in search.search(passages, asked, expansions=search.expansions(asked, synonyms)).collect()}
    assert set(plain) == set(joined) == {0, 1}
    import math

    weight = lambda n, df: math.log(1 + n / df) / math.log(1 + n)
    assert plain[1] == pytest.approx(10 * weight(2, 2)) and joined[1] == pytest.approx(10 * weight(3, 2))
