"""Main text of web pages: host suffix arrays, guided by the pages' structure.

A page's html is cut into blocks of text, each in the zone that its elements give it:
furniture (menus, headers, footers, sidebars, notices, adverts, forms, comments), the
declared main part, headings outside it, or other text. A page's token stream is its
blocks in order, cut where the zone changes. All suffixes of a host's streams are
sorted to a depth of `run` tokens: suffixes with the same first tokens, neighbours in
the suffix array, meet by the hash of host and tokens. Those that stand on several
different pages are long repeated substrings. Tokens that they cover are boilerplate
and go; unique runs stay. The search goes over whole hosts and is dealt by suffix, so
a host of any size is spread over all tasks. Pages with one token stream count as one.

What the array decides: (1) on a page without a declared main part, all text that
isn't furniture; (2) elsewhere, unmarked text outside the main part: its unique runs
are kept if they are no fewer tokens than the main part, whose mark is then doubtful
(a teaser, say); a unique first heading is kept anyway; (3) in a declared main part,
blocks of `run` tokens or more that several pages of the host hold, one of them outside
its main part. What repeats inside main parts only is kept: articles quote and copy one another,
and the article is wanted whole. Furniture by its element or class goes even where it
is unique, since many hosts have one page only.

Defined results: null html is empty, with an empty text; null and odd urls share the
host ''; repeated rows give a row each; an empty table gives an empty result; other
columns are not read. Character references are decoded and runs of white space become
one space. Elements that aren't closed hide nothing after them, but for scripts,
styles and HTML comments. Parsing is linear in the page's length.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planecraft.llm.jobs import BROADCAST_IDS, prepare, small_or_shuffled, stored
from planecraft.llm.text_arrays import mix, slices

EXTRACTED = "page_id long, url string, text string, n_chars long"
PARSED = "page_id long, url string, number long, stream long, zones array<byte>, texts array<string>, other array<long>, mains array<long>, furniture array<long>"
FURNITURE, MAIN, OTHER, HEADING = 0, 1, 2, 3


@dataclass(frozen=True)
class Hosts:
    """Tokens of a repeated run."""

    run: int = 16


#: Elements without text for readers; the first ones hold raw text up to their end tag, or the page's end.
RAW = set("script style".split())
HIDDEN = RAW | set("noscript template svg iframe object textarea select math canvas audio video".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
FURNITURE_TAGS = set("nav footer aside form button dialog menu head fieldset input".split())
#: Words of class names and the like: a name of such words, with neutral ones beside them, marks furniture.
FURNITURE_WORDS = set(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored banner cookie cookies consent gdpr notice notices alert alerts promo promos promotion promotions sidebar menu menus nav navbar navigation breadcrumb breadcrumbs footer header masthead comment comments disqus respond share sharing social related newsletter subscribe signup popup modal overlay widget widgets toolbar pagination complementary contentinfo search".split()
)
NEUTRAL_WORDS = set("site page global main top bottom left right inner outer wrap wrapper container box block bar area section list item items link links content row col column primary secondary mobile desktop fixed sticky small large text button buttons btn icon icons group form user reader post posts".split())
STORY_WORDS = set("article entry post story content".split())
MAIN_NAMES = set("main articlebody article-body post-content entry-content".split())

opening = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][a-zA-Z0-9:-]*))")
stop = re.compile(r"[>\"']")
marks = re.compile(r"""(?<![\w-])(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
word_parts = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+|[^\W\d_a-zA-Z]+")


def is_furniture_name(name: str) -> bool:
    parts = {p.lower() for p in word_parts.findall(name)}
    known = parts & FURNITURE_WORDS
    if not known or known == {"header"} and parts & STORY_WORDS:
        return False
    return all(p in FURNITURE_WORDS or p in NEUTRAL_WORDS or p.isdigit() for p in parts)


class Tags:
    """Where tags end. A quoted value may hold '>'; a quote that isn't closed is no quote."""

    def __init__(self, page: str):
        self.page, self.last = page, {c: page.rfind(c) for c in ">\"'"}
        self.quotes = True

    def end(self, at: int) -> int:
        """Place of the '>' that ends the tag whose name ends at `at`; -1 if there is none."""
        page, i = self.page, at
        if at > self.last[">"]:
            return -1
        while self.quotes:
            m = stop.search(page, i)
            if m is None:  # all else is quoted: this page's quotes aren't to be trusted
                self.quotes = False
            elif m[0] == ">":
                return m.start()
            elif not page[i : m.start()].rstrip().endswith("="):
                i = m.end()
            elif m.end() > self.last[m[0]]:
                break
            else:
                i = page.index(m[0], m.end()) + 1
        return page.find(">", at)


def blocks(page: str | None) -> list[tuple[int, str]]:
    """(zone, text) of a page's blocks in order; empty ones are left out."""
    page = page or ""
    found: list[tuple[int, str]] = []
    text: list[str] = []
    stack: list[tuple[str, int, int, int]] = []  # open elements: name, is furniture, is main, is heading
    places: dict[str, list[int]] = {}  # of each name, where it stands in the stack
    walls: list[int] = []  # where elements stand that aren't inline
    state = [0, 0, 0]  # open furniture, main parts, headings
    tags, lower, at = Tags(page), None, 0

    def end_block() -> None:
        words = html.unescape("".join(text)).split()
        if words:
            found.append((FURNITURE if state[0] else MAIN if state[1] else HEADING if state[2] else OTHER, " ".join(words)))
        text.clear()

    def close(depth: int) -> None:
        while len(stack) > depth:
            name, *flags = stack.pop()
            places[name].pop()
            if walls and walls[-1] == len(stack):
                walls.pop()
            for i, f in enumerate(flags):
                state[i] -= f

    while m := opening.search(page, at):
        text.append(page[at : m.start()])
        if m[1]:
            at = page.find("-->", m.end())
            at = at + 3 if at >= 0 else len(page)
            text.append(" ")
            continue
        end = tags.end(m.end()) if m[4] else page.find(">", m.end())
        if end < 0:  # no tag, but text
            text.append(page[m.start() :])
            at = len(page)
            break
        at = end + 1
        if m[2]:
            continue
        closing, name, rest = m[3], m[4].lower(), page[m.end() : end]
        if name in HIDDEN:
            if not closing and not rest.endswith("/"):
                if lower is None:
                    lower = page.lower() if len(page.lower()) == len(page) else re.sub("[A-Z]", lambda c: c[0].lower(), page)
                    ends = {n: lower.rfind(f"</{n}") for n in HIDDEN}
                if at <= ends[name]:
                    after = page.find(">", lower.index(f"</{name}", at))
                    at = after + 1 if after >= 0 else len(page)
                elif name in RAW:
                    at = len(page)
            text.append(" ")
            continue
        if name not in INLINE:
            end_block()
        if name in VOID:
            continue
        if closing:
            own = places.get(name)
            if own and not (name in INLINE and walls and walls[-1] > own[-1]):
                if name in INLINE and stack[own[-1]][1]:
                    end_block()
                close(own[-1])
        elif not rest.endswith("/"):
            if name == "p" and places.get("p") and walls[-1] == places["p"][-1]:
                close(walls[-1])  # a paragraph ends where the next begins
            names = [n for x in marks.findall(rest) for n in ("".join(x)).split()]
            by_name = name not in ("main", "body", "html") and any(map(is_furniture_name, names))
            is_main = int(name in ("article", "main") or any(n.lower() in MAIN_NAMES for n in names))
            is_furniture = int(name in FURNITURE_TAGS or name == "header" and not state[1] or by_name)
            if name in INLINE:
                if not is_furniture and not (state[0] and places.get(name)):
                    continue  # what an inline element holds belongs to the text around it
                end_block()
            else:
                walls.append(len(stack))
            flags = (is_furniture, is_main, int(name == "h1"))
            for i, f in enumerate(flags):
                state[i] += f
            places.setdefault(name, []).append(len(stack))
            stack.append((name, *flags))
    text.append(page[at:])
    end_block()
    return found


def covered(streams: list[np.ndarray], run: int) -> list[np.ndarray]:
    """The same search for a host held in memory: for each page's token numbers, which of them stand in a substring of `run` tokens that another page holds too.

    Suffixes are ranked by prefix doubling up to `run` tokens; equal ranks are neighbours in the suffix array.
    """
    sizes = np.array([len(s) for s in streams])
    if not sizes.sum():
        return [np.zeros(n, bool) for n in sizes]
    n_pages, total = len(streams), int(sizes.sum()) + len(streams)
    page = np.repeat(np.arange(n_pages), sizes + 1)
    ends = np.cumsum(sizes + 1) - 1
    rank = np.zeros(total, np.int64)
    inside = np.ones(total, bool)
    inside[ends] = False
    rank[inside] = np.concatenate(streams) + n_pages
    rank[ends] = np.arange(n_pages)  # a sign of its own ends each page
    depth = 1
    while depth < run:
        step = min(depth, run - depth)
        after = np.concatenate((rank[step:], np.full(step, -1)))[-total:]
        _, rank = np.unique(rank * (total + n_pages + int(rank.max()) + 2) + after + 1, return_inverse=True)
        depth += step
    order = np.argsort(rank, kind="stable")  # the suffix array, sorted to this depth
    edge = np.concatenate(([True], rank[order][1:] != rank[order][:-1]))
    group = np.cumsum(edge) - 1
    pages = page[order]
    several = np.minimum.reduceat(pages, np.flatnonzero(edge)) != np.maximum.reduceat(pages, np.flatnonzero(edge))
    starts = order[several[group]]
    mark = np.zeros(total + run + 1, np.int64)
    np.add.at(mark, starts, 1)
    np.add.at(mark, starts + run, -1)
    hit = np.cumsum(mark)[:total] > 0
    return [hit[e - n : e] for e, n in zip(ends, sizes)]


def suffix_keys(texts: list[str], hosts: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """Of all suffixes of at least `run` tokens, text by text: the text's number, and a hash of the host and the first `run` tokens."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for a, _, s in slices(pa.array(texts, pa.large_string())):
        owner = np.repeat(np.arange(s.n), s.n_words())
        n = len(owner) - run + 1
        if n > 0:
            inside = np.flatnonzero(owner[:n] == owner[run - 1 :])
            host = mix(hosts[a + owner[inside]].astype(np.int64).view(np.uint64))
            found.append((a + owner[inside], mix(s.hashes(s.starts[inside], s.ends[inside + run - 1]) + host).view(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*found))


def block_key(text: str, host: int) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8, key=host.to_bytes(8, "big", signed=True)).digest(), "big", signed=True)


def stretches(found: list[tuple[int, str]]) -> list[tuple[int, list[int]]]:
    """(zone, blocks) of runs of blocks in one zone; a heading outside a main part counts as other text."""
    out: list[tuple[int, list[int]]] = []
    for i, (zone, _) in enumerate(found):
        zone = OTHER if zone == HEADING else zone
        if out and out[-1][0] == zone:
            out[-1][1].append(i)
        else:
            out.append((zone, [i]))
    return out


def without_furniture(found: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """The blocks with one empty block for each stretch of furniture, so that runs don't reach across it."""
    return [(z, t if z != FURNITURE else "") for i, (z, t) in enumerate(found) if z != FURNITURE or not i or found[i - 1][0] != FURNITURE]


def parsed(pages: DataFrame, how: Hosts) -> DataFrame:
    """Each page's blocks without furniture's text, and keys: of the suffixes of other text and of furniture, and of long blocks of main parts (those of other zones are among the former)."""

    def keys_of(cut: list[list[tuple[int, str]]], numbers: np.ndarray, zone: int) -> list[np.ndarray]:
        """Page by page the different suffix keys of a zone's stretches, and its long blocks' keys."""
        parts = [(i, " ".join(found[b][1] for b in at)) for i, found in enumerate(cut) for z, at in stretches(found) if z == zone]
        owner = np.array([i for i, _ in parts], np.int64)
        part, keys = suffix_keys([t for _, t in parts], numbers[owner], how.run) if zone != MAIN else (np.zeros(0, np.int64),) * 2
        page = owner[part]
        split = np.split(keys, np.searchsorted(page, np.arange(1, len(cut))))
        same = lambda z: (OTHER if z == HEADING else z) == zone
        long = [[block_key(t, int(n)) for z, t in found if same(z) and t.count(" ") + 1 >= how.run] for found, n in zip(cut, numbers)]
        return [np.unique(np.concatenate((x, np.array(y, np.int64)))) for x, y in zip(split, long)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            numbers = batch.column("number").to_numpy()
            cut = [blocks(p) for p in batch.column("html").to_pylist()]
            kept = [without_furniture(found) for found in cut]
            columns = [
                batch.column("page_id").cast(pa.int64()),
                batch.column("url"),
                batch.column("number"),
                pa.array([block_key(" ".join(t for _, t in found), 0) for found in cut], pa.int64()),
                pa.array([[zone for zone, _ in found] for found in kept], pa.list_(pa.int8())),
                pa.array([[t for _, t in found] for found in kept], pa.list_(pa.string())),
                *[pa.array(keys_of(cut, numbers, zone), pa.list_(pa.int64())) for zone in (OTHER, MAIN, FURNITURE)],
            ]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in PARSED.split(", ")])

    return pages.mapInArrow(run, PARSED)


def repeated_keys(rows: DataFrame) -> DataFrame:
    """(key): what pages of a host with different token streams hold, at least once outside a main part, and somewhere where it isn't furniture."""
    zones = (("other", 1, 1), ("mains", 0, 1), ("furniture", 1, 0))
    entry = lambda outside, asked: lambda k: F.struct(k.alias("key"), F.lit(outside).alias("outside"), F.lit(asked).alias("asked"))
    held = rows.select("stream", F.explode(F.concat(*[F.transform(c, entry(o, a)) for c, o, a in zones])).alias("e")).select("stream", "e.*")
    seen = held.groupBy("key").agg(F.min("stream").alias("one"), F.max("stream").alias("two"), F.max("outside").alias("outside"), F.max("asked").alias("asked"))
    return seen.where("one != two and outside = 1 and asked = 1").select("key")


def unique_part(found: list[tuple[int, str]], number: int, hits: np.ndarray, how: Hosts) -> str:
    """The text of a page's blocks, given the keys among them that repeat on its host."""
    known, main, other, heading = set(hits.tolist()), [], [], None
    for zone, at in stretches(found):
        if zone == FURNITURE:
            continue
        if zone == MAIN:
            main += [(b, found[b][1]) for b in at if not (known and found[b][1].count(" ") + 1 >= how.run and block_key(found[b][1], number) in known)]
            continue
        words = [w for b in at for w in found[b][1].split(" ")]
        hit = np.zeros(len(words), bool)
        if known:
            _, keys = suffix_keys([" ".join(words)], np.array([number]), how.run)
            for i in np.flatnonzero(np.isin(keys, hits)):
                hit[i : i + how.run] = True
        i = 0
        for b in at:
            n = found[b][1].count(" ") + 1
            left = " ".join(w for w, h in zip(words[i : i + n], hit[i : i + n]) if not h)
            i += n
            if left:
                other.append((b, left))
                if found[b][0] == HEADING and heading is None:
                    heading = (b, left)
    size = lambda parts: sum(t.count(" ") + 1 for _, t in parts)
    if size(other) >= size(main):
        parts = main + other
    else:
        parts = main + ([heading] if heading else [])
    return " ".join(t for _, t in sorted(parts))


def main_texts(pages: DataFrame, how: Hosts = Hosts()) -> DataFrame:
    """The main text of every page."""
    prepare(pages.sparkSession)
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    rows = parsed(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.xxhash64(host).alias("number"), "html"), how)
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "parsed")  # stored, so a row keeps its number
    repeated = stored(repeated_keys(rows), "repeated")
    asked = rows.select("row", F.explode(F.concat("other", "mains")).alias("key"))
    hits = stored(asked.join(small_or_shuffled(repeated), "key", "left_semi").groupBy("row").agg(F.collect_list("key").alias("hits")), "hits")  # of one page
    few = (hits.agg(F.sum(F.size("hits"))).first()[0] or 0) <= BROADCAST_IDS
    both = rows.select("row", "page_id", "url", "number", "zones", "texts").join(F.broadcast(hits) if few else hits.hint("merge"), "row", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                columns = (batch.column(c).to_pylist() for c in ("zones", "texts", "number", "hits"))
                made = [unique_part(list(zip(z, t)), n, np.array(h or [], np.int64), how) for z, t, n, h in zip(*columns)]
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(made, pa.string()), pa.array([len(t) for t in made], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return both.select("page_id", "url", "number", "zones", "texts", "hits").mapInArrow(run, EXTRACTED)
