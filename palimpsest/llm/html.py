"""Main text of web pages: their structure, and a suffix array for each host.

The markup of a page tells three kinds of blocks: those of its article (or main part), those of its
chrome (menus, headers, footers, sidebars, notices, adverts, forms, comments), and, on pages that mark
no article, open ones. Blocks of an article are kept, but for elements in it whose names leave in doubt
whether they are chrome. Of open blocks and of elements in doubt, the host's own pages decide: the token
streams of all pages of every host are concatenated (ends of blocks count as tokens; blocks that are surely
of an article are no evidence of boilerplate and left out), and the host's suffix array
tells of every place the longest substring from there that ``PAGES`` distinct pages have, of at least
``MIN_TOKENS`` tokens. A block that one such repeat covers whole is boilerplate; the unique runs of blocks
stay. It is not enough that every few of a block's tokens occur elsewhere: the repeat has to be one. An
element in doubt goes if repeats cover all blocks of it.

The array of a host is dealt out by the first tokens of its suffixes, so all suffixes that can share a
repeat are in one part, and a host of any size has as many parts as it has texts. Only suffixes whose
first tokens several pages have come into it, and a suffix that many pages share is one row of it. Suffixes
are compared up to ``DEPTH`` tokens; those that share as many with a longer block are then told apart by a
name of as many tokens as the block has. Pages with the same blocks, their article's included, count as one
page, so copies of an article are not its boilerplate.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import SLOT_BITS, SLOTS, Scratch, maybe_in, only
from palimpsest.llm.words import mix, slices, word_hashes

#: Tokens of a repeat at least, distinct pages that have it, tokens up to which suffixes are compared at once, and parts of
#: a host's suffix array, by the first ``MIN_TOKENS`` tokens.
MIN_TOKENS, PAGES, DEPTH, RANGES = 8, 3, 48, 1 << 20

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(/?)>", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "object", "canvas", "select", "option"}
_CHROME = {"nav", "footer", "aside", "form", "button", "dialog", "menu", "head", "fieldset", "search"}
_VOID = {"br", "hr", "img", "input", "meta", "link", "wbr", "source", "area", "base", "col", "embed", "param", "track"}
_BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer",
    "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody",
    "tfoot", "thead", "tr", "ul",
}
_SPACED = {"br", "td", "th"}
#: Parts of class, id and role names that mark chrome, between other letters' edges.
_MARKED = re.compile(
    r"(?:^|[^a-z])(?:ads?|adverts?|advertisements?|advertising|adsense|sponsor(?:ed|s)?|promos?|promotions?|banners?|sidebars?|side-?bar|nav|navs|navbar|navigation|menus?|breadcrumbs?|"
    r"footers?|masthead|topbar|site-?header|page-?header|cookies?|consent|gdpr|notices?|alerts?|announcements?|popups?|pop-?up|modals?|overlay|newsletters?|subscribe|subscription|signup|sign-?up|"
    r"login|comments?|comment-?list|commentlist|respond|replies|reply|disqus|discussion|related|recommend(?:ed|ations)?|share|sharing|social|widgets?|toolbar|pagination|pager|search|skip-?link|"
    r"contentinfo|complementary|form|copyright)(?:$|[^a-z])"
)
#: Inside an article or main part an element is chrome if a name of its is made of these words alone, or of them and of
#: words for containers: ``comments-area`` is, ``share-prices`` is not.
_INNER = set(
    "ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promotion banner sidebar nav navbar navigation menu breadcrumb breadcrumbs footer "
    "cookie cookies notice notices popup newsletter subscribe signup comment comments comment-list commentlist respond replies disqus related recommended share sharing social complementary contentinfo signup widget widgets login breadcrumbs pagination pager toolbar consent gdpr".split()
)
_CONTAINERS = set("area areas list lists box boxes section sections container wrapper wrap block blocks bar bars panel inner outer posts articles stories links items buttons button icons group column col row area left right top bottom".split())
#: Kinds of blocks. DOUBTFUL ones are of an article inside chrome that may only be unclosed, TEASERS of one inside a
#: sidebar or footer: they are the page's article only if it has no other.
ARTICLE, OPEN, CHROME, DOUBTFUL, TEASER = range(5)
_MAIN = (ARTICLE, DOUBTFUL, TEASER)
#: Marks of blocks: surely of the article, never main text, open; larger ones number the page's elements in doubt.
SURE, NEVER, ASKED = 0, -1, -2


def _values(attributes: str) -> list[str]:
    return [re.sub(r"([a-z])([A-Z])", r"\1-\2", a or b or c).lower() for a, b, c in _NAMES.findall(attributes)]


def _marked(name: str, attributes: str, kind: int) -> bool:
    """Whether an element's class, id or role says that it is chrome. An article's own never does."""
    if name in ("html", "body", "article", "main"):
        return False
    values = _values(attributes)
    if kind in _MAIN:
        names = (re.split("[^a-z]+", n) for v in values for n in v.split())
        return any(not _INNER.isdisjoint(parts) and _INNER.union(_CONTAINERS, [""]).issuperset(parts) for parts in names)
    return any(_MARKED.search(v) for v in values)


def _in_doubt(name: str, attributes: str) -> bool:
    """Whether a name of an article's block element has a word for chrome among others: ``newsletter-teaser``,
    and ``share-prices`` too. The markup alone cannot tell these apart."""
    return name in _BLOCK and name not in ("html", "body", "article", "main") and any(_MARKED.search(v) for v in _values(attributes))


def blocks(html: str) -> list[tuple[int, str]]:
    """(kind, text) of the blocks of a page in order, of kinds ARTICLE, OPEN and CHROME, with references decoded and
    white space made one space. Of articles, doubtful ones and teasers only the first kind that the page has is its
    article, the others are chrome."""
    return [(kind, text) for kind, text, _ in _parts(html)]


def marked_blocks(html: str) -> list[tuple[int, str]]:
    """(mark, text) of the blocks of a page in order. Open blocks are asked only on pages without an article."""
    found = _parts(html)
    other = NEVER if any(kind == ARTICLE for kind, _, _ in found) else ASKED
    return [(doubt if kind == ARTICLE else other if kind == OPEN else NEVER, text) for kind, text, doubt in found]


def _parts(html: str) -> list[tuple[int, str, int]]:
    """The blocks with the number of the element in doubt that they are in (``SURE``: none)."""
    found = _blocks(html)
    article = next((k for k in _MAIN if any(kind == k for kind, _, _ in found)), None)
    return [(ARTICLE if kind == article else CHROME if kind in _MAIN else kind, text, doubt) for kind, text, doubt in found]


def _blocks(html: str) -> list[tuple[int, str, int]]:
    """Blocks of all kinds. Inline tags leave no space; ``br`` and table cells leave one. An unclosed element ends where
    an element around it ends, a raw element without end reaches to the end of the page."""
    out: list[tuple[int, str, int]] = []
    parts: list[str] = []
    stack: list[tuple[str, int, int]] = [("", OPEN, SURE)]
    doubts = 0

    def close() -> None:
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            parts.clear()
            if text:
                out.append((stack[-1][1], text, stack[-1][2]))

    at, n = 0, len(html)
    while at < n:
        m = _TAG.search(html, at)
        if not m:
            parts.append(html[at:])
            break
        if m.start() > at:
            parts.append(html[at : m.start()])
        at = m.end()
        name = m[2]
        if not name:
            continue
        name = name.lower()
        if m[1]:
            if name in _BLOCK:
                close()
            elif name in _SPACED:
                parts.append(" ")
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == name:
                    if stack[depth - 1][1] != stack[-1][1]:
                        close()
                    del stack[depth:]
                    break
                if stack[depth][0] in _BLOCK and name not in _BLOCK or stack[depth][0] in ("article", "main") and name not in ("article", "main", "body", "html"):
                    break  # a stray end tag
            continue
        if name in _RAW and not m[4]:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
            at = end.end() if end else n
            continue
        if name in _BLOCK:
            close()
        elif name in _SPACED:
            parts.append(" ")
        if name in _VOID or m[4] and name not in _BLOCK:
            continue
        kind = stack[-1][1]
        marked = _marked(name, m[3], kind)
        if marked or name in _CHROME or name == "header" and kind not in _MAIN:
            if name not in _BLOCK and kind != CHROME:
                close()
            kind = CHROME
        elif name in ("article", "main") and kind not in _MAIN:
            aside = next((n for n, k, _ in reversed(stack) if k == CHROME and n in _CHROME), None) in ("aside", "footer")
            kind = ARTICLE if kind != CHROME else TEASER if aside else DOUBTFUL
        if name == "p" and stack[-1][0] == "p" or name == "li" and stack[-1][0] == "li":
            stack.pop()
            if kind == CHROME and not marked:
                kind = stack[-1][1]
        doubt = stack[-1][2] if kind == stack[-1][1] else SURE
        if doubt == SURE and kind in _MAIN and _in_doubt(name, m[3]):
            doubts += 1
            doubt = doubts
        stack.append((name, kind, doubt))
    close()
    return out


Pages = tuple[int, ...] | None


def _met(a: Pages, b: Pages) -> Pages:
    """Distinct pages of two groups of suffixes; None stands for ``PAGES`` or more."""
    if a is None or b is None:
        return None
    both = tuple({*a, *b})
    return None if len(both) >= PAGES else both


def suffix_array(suffixes: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """The order of suffixes by their tokens, and of each but the first how many it shares with the one before."""
    order = sorted(range(len(suffixes)), key=lambda i: suffixes[i].astype(">u8").tobytes())
    shared = []
    for a, b in zip(order[:-1], order[1:], strict=True):
        n = min(len(suffixes[a]), len(suffixes[b]))
        differ = np.flatnonzero(suffixes[a][:n] != suffixes[b][:n])
        shared.append(int(differ[0]) if len(differ) else n)
    return order, shared


def longest_repeats(suffixes: list[np.ndarray], pages: list[Pages]) -> list[int]:
    """Of each suffix the most tokens from its start that ``PAGES`` distinct pages have; 0 if there are none.

    ``pages`` are those that a suffix stands on. The intervals of the suffix array with a common prefix are
    closed from the longest prefix to the shortest; a suffix gets the first that enough pages are in.
    """
    order, shared = suffix_array(suffixes)
    out = [0] * len(suffixes)
    stack: list[tuple[int, Pages, list[int]]] = []

    def add(depth: int, on: Pages, members: list[int]) -> None:
        if stack and stack[-1][0] == depth:
            _, other, waiting = stack.pop()
            few, many = sorted((members, waiting), key=len)
            many.extend(few)
            on, members = _met(on, other), many
        stack.append((depth, on, members))

    def close(depth: int) -> None:
        while stack and stack[-1][0] > depth:
            at, on, members = stack.pop()
            if on is None:
                for i in members:
                    out[i] = at
                members = []
            add_to = max(depth, stack[-1][0] if stack else 0)
            add(add_to, on, members)

    for i, common in zip(order, [0, *shared][: len(order)], strict=True):
        close(common)
        add(len(suffixes[i]), pages[i], [i])
    close(0)
    return out


def grams(stream: np.ndarray, min_tokens: int = MIN_TOKENS) -> np.ndarray:
    """A hash of the ``min_tokens`` tokens at each place of a stream."""
    n = max(0, len(stream) - min_tokens + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min_tokens):
        out = mix(out ^ stream[k : k + n], k)
    return out.view(np.int64)


_EDGE = np.array([1], np.uint64)


def stream_of(texts: list[str]) -> np.ndarray:
    """The token hashes of a page's blocks, with an edge before, between and after them."""
    return np.concatenate([_EDGE, *(x for t in texts for x in (word_hashes(pa.array(t.split(" "))), _EDGE))])


def streams_of(pages: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The streams of many pages in a row, as ``stream_of`` makes each, and the length of each."""
    texts, blocks_of = pages.flatten(), pc.list_value_length(pages).to_numpy(zero_copy_only=False)
    tokens = pc.split_pattern(texts, " ")
    n = pc.list_value_length(tokens).to_numpy(zero_copy_only=False)
    page = np.repeat(np.arange(len(pages)), blocks_of)
    block = np.repeat(np.arange(len(texts)), n)
    lengths = 1 + blocks_of + np.bincount(page, n, len(pages)).astype(int)
    stream = np.full(lengths.sum(), _EDGE[0])
    stream[np.arange(len(block)) + block + page[block] + 1] = word_hashes(tokens.flatten())
    return stream, lengths


_FACTOR = 0x9E3779B97F4A7C15


def window_hashes(stream: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A hash of the n tokens at each place of a stream, for few tokens."""
    powers, inverse = (np.cumprod(np.full(len(stream), f, np.uint64)) for f in (_FACTOR, pow(_FACTOR, -1, 1 << 64)))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(stream * powers)])
    at = np.arange(len(stream))
    return mix((sums[at + n] - sums[at]) * inverse ^ mix(n.astype(np.uint64)), 1)


def covered(texts: list[str], repeats: list[tuple[int, int]], whole: set[tuple[int, int]] | None = None) -> list[bool]:
    """Of each block, whether one repeat (place in the stream, length) covers it whole.

    Repeats are told up to ``DEPTH`` tokens: a longer one is a row of places with that many each. Such a row need not be
    one repeat, so of blocks longer than that only those in ``whole`` (place, tokens) are covered, if it is given.
    """
    length = dict(repeats)
    reach: dict[int, int] = {}
    for place in sorted(length, reverse=True):
        goes_on = length[place] >= DEPTH and length.get(place + 1, 0) >= DEPTH
        reach[place] = reach[place + 1] if goes_on else place + length[place]
    starts, furthest = sorted(reach), 0
    k, out = 0, []
    for at, n in spans(texts):
        while k < len(starts) and starts[k] <= at:
            furthest, k = max(furthest, reach[starts[k]]), k + 1
        out.append(furthest >= at + n and (whole is None or n <= DEPTH or (at, n) in whole))
    return out


def spans(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Place in the stream and tokens of each block."""
    at = 1
    for text in texts:
        n = len(text.split(" "))
        yield at, n
        at += n + 1


def unique_blocks(texts: list[str], open_: list[bool], repeats: list[tuple[int, int]]) -> list[str]:
    """The open blocks that no repeat covers whole; all of them if none would stay."""
    return main_blocks([ASKED if o else NEVER for o in open_], [], texts, covered(texts, repeats))


def main_blocks(marks: list[int], sure: list[str], rest: list[str], gone: list[bool]) -> list[str]:
    """The main blocks of a page in order: those ``sure``, and of the ``rest`` open ones that are not ``gone`` and elements
    in doubt of which some block is not; all of them if no block would stay."""
    asked = [m for m in marks if m != SURE]
    stay = {m for m, g in zip(asked, gone, strict=True) if m > SURE and not g}
    keeps = iter([m in stay or m == ASKED and not g for m, g in zip(asked, gone, strict=True)])
    ours, others = iter(sure), iter(rest)
    every = [(m, *((next(ours), True) if m == SURE else (next(others), next(keeps)))) for m in marks]
    return [t for _, t, keep in every if keep] or [t for m, t, _ in every if m != NEVER]


_PRIME, _BASE = (1 << 61) - 1, 0x1B873593CC9E2D51


def names(stream: np.ndarray, windows: list[tuple[int, int]]) -> list[int]:
    """A number for the tokens of each window (place, tokens) of a stream, the same for the same tokens."""
    sums = list(accumulate(stream.tolist(), lambda h, t: (h * _BASE + t + 1) % _PRIME, initial=0))
    powers = {n: pow(_BASE, n, _PRIME) for n in {n for _, n in windows}}
    return [(sums[p + n] - sums[p] * powers[n]) % _PRIME for p, n in windows]


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html).

    A null or empty html, or one without main text, has the text ''. Pages with a null url, or one
    without a host, are of one host. Repeated rows are extracted each, and count as one page. An empty
    table gives no rows. Other columns are ignored.
    """
    pages = only(pages, page_id="long", url="string", html="string")
    scratch = Scratch(pages.sparkSession, "html")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The marks of each page's blocks, and in order the blocks that are surely its article's and all others."""
        for batch in batches:
            for b in slices(batch, "html"):
                found = [marked_blocks(h.as_py() or "") for h in b.column("html")]
                marks = pa.array([[m for m, _ in x] for x in found], pa.list_(pa.int32()))
                sure = pa.array([[t for m, t in x if m == SURE] for x in found], pa.list_(pa.string()))
                rest = pa.array([[t for m, t in x if m != SURE] for x in found], pa.list_(pa.string()))
                asks = pa.array([any(m not in (SURE, NEVER) for m, _ in x) for x in found], pa.bool_())
                yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), marks, sure, rest, asks], names=["page_id", "url", "marks", "sure", "rest", "asks"])

    def laid(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        """Of the places of the pages' streams in a row: the tokens, their page, how many the page has from there, and,
        of those that have enough, the hash of the first ones and the host."""
        stream, n = streams_of(b.column("rest"))
        page = np.repeat(np.arange(len(n)), n)
        left = np.repeat(np.cumsum(n), n) - np.arange(len(stream))
        own = np.flatnonzero(left >= MIN_TOKENS)
        hosts = np.asarray(b.column("host")).view(np.uint64)
        return stream, page, left, own, mix(grams(stream)[own].view(np.uint64) ^ hosts[page[own]], MIN_TOKENS).view(np.int64)

    def met_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, page, _, own, gram = laid(b)
            order = np.lexsort((gram, page[own]))
            page, gram = page[own][order], gram[order]
            once = np.flatnonzero((np.diff(page, prepend=-1) != 0) | (np.diff(gram, prepend=gram[:1]) != 0))
            yield pa.RecordBatch.from_arrays([pa.array(gram[once]), pa.array(np.asarray(b.column("key"))[page[once]])], names=["gram", "key"])

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All suffixes, by a number for their first ``DEPTH`` tokens and the host."""
        for b in batches:
            stream, page, left, own, gram = laid(b)
            number = window_hashes(stream, np.minimum(left, DEPTH))[own] ^ mix(np.asarray(b.column("host")).view(np.uint64))[page[own]]
            place = own - (np.cumsum(np.bincount(page)) - np.bincount(page))[page[own]]
            same = [pa.array(np.asarray(b.column(c))[page[own]]) for c in ("row", "key")]
            yield pa.RecordBatch.from_arrays([*same, pa.array(place), pa.array(number.view(np.int64)), pa.array(gram)], names=["row", "key", "place", "id", "gram"])

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first ``DEPTH`` tokens of the given suffixes of each stream."""
        for b in batches:
            stream, _, left, own, gram = laid(b)
            first = np.concatenate([[0], np.flatnonzero(left == 1)[:-1] + 1])
            gram = dict(zip(own.tolist(), (gram % RANGES).tolist(), strict=True))
            stream = stream.view(np.int64)
            for i, some in enumerate(b.column("firsts").to_pylist()):
                at = [int(first[i]) + x["place"] for x in some]
                columns = [[x[c] for x in some] for c in ("id", "n", "a", "z")]
                part = pa.array([gram[p] for p in at], pa.int64())
                tokens = pa.array([stream[p : p + min(left[p], DEPTH)] for p in at], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part, *(pa.array(c, pa.int64()) for c in columns), tokens], names=["range", "id", "n", "a", "z", "suffix"])

    def lengths(t: pa.Table) -> pa.Table:
        """The longest repeats of one part of a host's suffix array: all suffixes of some first tokens."""
        on = [None if n >= PAGES else tuple({a, z}) for n, a, z in zip(*(t[c].to_pylist() for c in ("n", "a", "z")), strict=True)]
        found = longest_repeats([np.array(x, np.int64).view(np.uint64) for x in t["suffix"].to_pylist()], on)
        return pa.table({"id": t["id"], "length": pa.array(found, pa.int64())})

    def long_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The blocks to decide that are longer than ``DEPTH`` and that a row of repeats covers."""
        for b in batches:
            found = []
            for key, marks, rest, repeats in zip(*(b.column(c).to_pylist() for c in ("key", "marks", "rest", "repeats")), strict=True):
                gone = covered(rest, [(r["place"], r["length"]) for r in repeats])
                asked = [m for m in marks if m != SURE]
                found += [(key, at, n) for (at, n), m, g in zip(spans(rest), asked, gone, strict=True) if g and m != NEVER and n > DEPTH]
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], pa.int64()) for c in range(3)], names=["key", "place", "n"])

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The names of the given windows of each stream that lie in it."""
        for b in batches:
            for key, host, rest, asked in zip(*(b.column(c).to_pylist() for c in ("key", "host", "rest", "windows")), strict=True):
                stream = stream_of(rest)
                windows = [(w["place"], w["n"]) for w in asked if w["place"] + w["n"] <= len(stream)]
                same = [pa.array([x] * len(windows), pa.int64()) for x in (key, host)]
                at, n = ([w[c] for w in windows] for c in (0, 1))
                yield pa.RecordBatch.from_arrays([*same, *(pa.array(x, pa.int64()) for x in (at, n, names(stream, windows)))], names=["key", "host", "place", "n", "name"])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for marks, sure, rest, repeats, whole in zip(*(b.column(c).to_pylist() for c in ("marks", "sure", "rest", "repeats", "whole")), strict=True):
                gone = covered(rest, [(r["place"], r["length"]) for r in repeats or []], {(w["place"], w["n"]) for w in whole or []})
                texts.append("\n".join(main_blocks(marks, sure, rest, gone)))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    host = F.xxhash64(F.coalesce(F.lower(F.regexp_extract("url", "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit("")))
    parsed = pages.mapInArrow(parse, "page_id long, url string, marks array<int>, sure array<string>, rest array<string>, asks boolean")
    parsed = parsed.withColumn("host", host).withColumn("key", F.xxhash64("host", "sure", "rest")).withColumn("row", F.monotonically_increasing_id())
    parsed = scratch.table(parsed, "parsed", "zstd")
    # the array counts pages; here it is enough to leave out what too few rows or one page alone have
    streams = parsed.select("row", "key", "host", "rest")
    common = streams.mapInArrow(met_grams, "gram long, key long").groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("a"), F.max("key").alias("z"))
    common = scratch.table(common.filter((F.col("n") >= PAGES) & (F.col("a") < F.col("z"))).select("gram"), "common")
    own = maybe_in(streams.mapInArrow(places, "row long, key long, place long, id long, gram long"), "gram", common, scratch)
    if common.count() > SLOTS * SLOT_BITS // 4:
        own = own.join(common, "gram", "left_semi")
    array = scratch.table(own.select("row", "key", "place", "id"), "places", "zstd")
    # a suffix that many pages share is one row; of those on fewer than PAGES pages the least and the largest are all
    each = array.groupBy("id", "key").agg(F.min("row").alias("row"), F.min("place").alias("place"))  # rows of one key have one stream
    each = each.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "row", "place")).alias("first"), F.max("key").alias("z"))
    firsts = each.groupBy(F.col("first.row").alias("row")).agg(F.collect_list(F.struct("id", "n", F.col("first.key").alias("a"), "z", F.col("first.place").alias("place"))).alias("firsts"))
    each = streams.join(firsts, "row").mapInArrow(suffixes, "range long, id long, n long, a long, z long, suffix array<long>")
    found = scratch.table(each.groupBy("range").applyInArrow(lengths, "id long, length long").filter(F.col("length") >= MIN_TOKENS), "lengths")
    asking = parsed.filter("asks")
    met = array.join(asking.select("key").distinct(), "key", "left_semi").join(found, "id")
    met = scratch.table(met.groupBy("key").agg(F.collect_set(F.struct("place", "length")).alias("repeats")), "repeats")
    # what shares DEPTH tokens with a longer block is named by as many tokens as the block has
    asked = asking.select("key", "marks", "rest").join(met, "key").mapInArrow(long_blocks, "key long, place long, n long").distinct()
    asked = scratch.table(asked.join(array.select("key", "place", "id").distinct(), ["key", "place"]), "long")
    whole = asked.select("key", "place", "n")
    if not asked.isEmpty():
        windows = array.join(asked.select("id", "n").distinct(), "id").groupBy("row").agg(F.collect_set(F.struct("place", "n")).alias("windows"))
        known = scratch.table(streams.join(windows, "row").mapInArrow(named, "key long, host long, place long, n long, name long"), "names")
        often = known.groupBy("host", "n", "name").agg(F.countDistinct("key").alias("pages")).filter(F.col("pages") >= PAGES).select("host", "n", "name")
        whole = whole.join(known.join(often, ["host", "n", "name"], "left_semi"), ["key", "place", "n"], "left_semi")
    whole = whole.groupBy("key").agg(F.collect_set(F.struct("place", "n")).alias("whole"))
    sides = scratch.table(met.join(whole, "key", "left"), "decided")
    columns = ["page_id", "url", "marks", "sure", "rest"]
    none = [F.lit(None).cast(sides.schema[c].dataType).alias(c) for c in ("repeats", "whole")]
    decided = parsed.filter("NOT asks").select(*columns, *none).unionByName(asking.join(sides, "key", "left").select(*columns, "repeats", "whole"))
    out = decided.mapInArrow(decide, "page_id long, url string, text string")
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
