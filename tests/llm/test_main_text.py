"""Main texts: the whole host's search against a plain one, and pages of odd make."""

import random
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from planecraft.llm import main_text
from planecraft.llm.main_text import FURNITURE, HEADING, MAIN, OTHER, blocks


def plain_texts(rows, run):
    """The rules of the module's docstring, with all runs as tuples in one dictionary."""
    host = lambda url: url.split("/")[2] if url and "://" in url else ""
    streams, places, long_blocks = {}, defaultdict(set), defaultdict(set)
    outside_long = defaultdict(bool)
    cut = [blocks(h) for _, _, h in rows]

    def parts(found):
        out = []
        for i, (zone, _) in enumerate(found):
            zone = OTHER if zone == HEADING else zone
            if out and out[-1][0] == zone:
                out[-1][1].append(i)
            else:
                out.append((zone, [i]))
        return out

    for (_, url, _), found in zip(rows, cut):
        stream = " ".join(t for _, t in found)
        streams.setdefault(stream, len(streams))
        for zone, at in parts(found):
            words = [w for b in at for w in found[b][1].split(" ")]
            for b in at:
                if found[b][1].count(" ") + 1 >= run:
                    long_blocks[host(url), found[b][1]].add(streams[stream])
                    outside_long[host(url), found[b][1]] |= zone != MAIN
            if zone != MAIN:
                for i in range(len(words) - run + 1):
                    places[host(url), tuple(words[i : i + run])].add(streams[stream])
    out = []
    for (page_id, url, _), found in zip(rows, cut):
        own = found
        main, other, heading = [], [], None
        for zone, at in parts(own):
            if zone == FURNITURE:
                continue
            if zone == MAIN:
                for b in at:
                    key = host(url), own[b][1]
                    if not (len(long_blocks[key]) > 1 and outside_long[key]):
                        main.append((b, own[b][1]))
                continue
            words = [(b, w) for b in at for w in own[b][1].split(" ")]
            hit = set()
            for i in range(len(words) - run + 1):
                if len(places[host(url), tuple(w for _, w in words[i : i + run])]) > 1:
                    hit |= set(range(i, i + run))
            for b in at:
                left = " ".join(w for i, (c, w) in enumerate(words) if c == b and i not in hit)
                if left:
                    other.append((b, left))
                    if own[b][0] == HEADING and heading is None:
                        heading = (b, left)
        n = lambda x: sum(len(t.split(" ")) for _, t in x)
        kept = main + other if n(other) >= n(main) else main + ([heading] if heading else [])
        text = " ".join(t for _, t in sorted(kept))
        out.append((page_id, url, text, len(text)))
    return Counter(out)


def made_pages(n, hosts, seed):
    """Pages with and without main parts, with notices, menus and quotes that repeat on a host, and copies."""
    rng = random.Random(seed)
    words = [f"v{i}" for i in range(400)]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    repeated = [[text(rng.randint(4, 40)) for _ in range(8)] for _ in range(hosts)]
    rows = []
    for i in range(n):
        h = 0 if rng.random() < 0.5 else rng.randrange(hosts)
        body = []
        for _ in range(rng.randint(1, 6)):
            t = rng.choice(repeated[h]) if rng.random() < 0.5 else text(rng.randint(1, 60))
            body.append(rng.choice(["<p>%s</p>", "<div>%s</div>", "<article><p>%s</p></article>", "<nav>%s</nav>", "<h1>%s</h1>", "%s<br>", "<div class='ad-box'>%s</div>"]) % t)
        rows.append((i, f"http://h{h}.org/{i}", "".join(body)))
    rows += [(n + i, rows[i][1], rows[i][2]) for i in range(0, n, 50)]
    return rows


def test_whole_hosts_match_a_plain_search(spark):
    rows = made_pages(2400, 6, 1)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    got = Counter(tuple(r) for r in main_text.main_texts(pages).collect())
    assert got == plain_texts(rows, 16)
    off = Counter(tuple(r) for r in main_text.main_texts(pages, main_text.Hosts(run=10**6)).collect())
    differ = {k[0] for k in got - off}
    assert any("<article" in h for i, _, h in rows if i in differ) and any("<article" not in h for i, _, h in rows if i in differ)


@pytest.mark.parametrize("folder, rows", [("sf0.01", 250)])
def test_articles_of_the_given_pages_are_whole(spark, folder, rows):
    """On these pages the article's own text, by a plain cut, is the main text."""
    import html
    import re

    pages = spark.read.parquet(f"/root/testdata/{folder}/pages.parquet")
    want = Counter()
    for r in pages.collect():
        inside = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        text = " ".join(html.unescape(re.sub(r"</?[a-z][^>]*>", lambda m: "" if m[0] in ("<b>", "</b>") else " ", inside)).split())
        want[r.page_id, r.url, text, len(text)] += 1
    got = Counter(tuple(r) for r in main_text.main_texts(pages).collect())
    assert got == want and sum(got.values()) == rows


def own_text(page):
    return main_text.unique_part(main_text.without_furniture(blocks(page)), 0, main_text.np.zeros(0, main_text.np.int64), main_text.Hosts())


def test_no_text_is_lost_by_names_or_unclosed_elements():
    assert own_text('<div class="social-history"><p>A social history of bread</p></div>') == "A social history of bread"
    assert own_text('<article class="teaser">short teaser</article><div><p>the real story is here</p></div>').endswith("the real story is here")
    assert own_text('<article>story <article class="comment">reader</article><p>end</p></article>') == "story end"
    for name in ("svg", "select", "object", "video"):
        assert own_text(f"<p>a b<{name} x=1><p>c d") == "a b c d"
        assert own_text(f"<p>a b<{name}>gone</{name}><p>c d") == "a b c d"
    assert own_text("<h1>Head line</h1><main><p>one two three four</p></main><p>x") == "Head line one two three four"
    assert own_text("a<script>b") == "a" and own_text("a<!-- b") == "a"
    assert own_text('<p title="a > b">q</p><p x="open>r') == "q r"
    assert own_text('<p class="cookie-notice">x<p class="entry-header">y') == "y"


@pytest.mark.parametrize("page", ["<div>" * 16000 + "</p>" * 16000, '<a "' * 16000, "<b><div>" + "<i>" * 16000 + "</b>" * 16000, '<a x=">" ' * 16000, "<svg>" * 50000, "<p>word " * 130_000, "<div></span>" * 80_000, '"' * 500_000 + '"<' * 200_000])
def test_parsing_is_linear(page):
    began = time.time()
    blocks(page)
    assert time.time() - began < 3


def test_empty_table_and_long_page(spark):
    schema = "page_id long, url string, html string"
    assert main_text.main_texts(spark.createDataFrame([], schema)).count() == 0
    long = "".join(f"<p>w{i} x</p>" for i in range(60_000))
    pages = spark.createDataFrame([(1, "http://a.org/1", long), (2, None, None), (None, "x", "")], schema).withColumn("hits", F.lit("clash")).withColumn("row", F.lit(1))
    assert sorted((r.page_id or 0, r.n_chars) for r in main_text.main_texts(pages).collect()) == [(0, 0), (1, len(" ".join(f"w{i} x" for i in range(60_000)))), (2, 0)]
