"""HTML extraction with a host suffix array.

Method: a page is parsed into blocks of running text.  Markup that states its purpose decides at once:
blocks inside an article or main landmark are the page's own, and blocks inside menus, headers,
footers, sidebars, notices, adverts, forms and comments are not.  All blocks outside a landmark are
the page's *open* stream.  Per host, the open streams are concatenated into token streams; a suffix
array finds every run of at least ``MIN_TOKENS`` tokens that occurs on ``MIN_PAGES`` distinct pages,
and the words such runs cover are boilerplate; the unique runs of blocks that nothing else decided
are kept.

The suffix array alone can't give right results: articles are copied from page to page, and adverts
or footers may occur once.  So it decides where the markup doesn't.

The array is sharded so that a hot host is no single task: a run of MIN_TOKENS tokens always contains
the least hash among its ``GRAM``-token windows, so every stream is cut into segments around those
anchors, a segment long enough for all runs that hold the anchor, and segments of equal host and anchor
meet in one shard.  Equal segments are merged before, with the number of their pages; pages with
equal open streams count as one page.

The segments are cut once and kept in the shared folder, since the array is made from them and its marks
come back to them.

Defined results: a null or empty page gives an empty text; a null url is a host of its own; repeated
rows give their result each; a very long page is parsed and kept whole; other columns are ignored; an
empty table gives an empty one.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .shared import shuffle_partitions, written

U = np.uint64
#: Tokens of a repeated run, tokens of an anchor, and distinct pages that make it boilerplate.
MIN_TOKENS, GRAM, MIN_PAGES = 8, 4, 3

OWN, OPEN, AWAY = 0, 1, 2

# The tags that matter, by their meaning in the HTML standard.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCK_TAGS = set(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table "
    "tbody td tfoot th thead title tr ul".split()
)
AWAY_TAGS = set("nav header footer aside form dialog menu button select option svg math canvas object audio video search head fieldset label".split())
AWAY_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of class and id names that mark boilerplate.
AWAY_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|sponsor(?:ed)?|promo(?:tion)?|banner|cookies?|consent|gdpr|notice|notification|alert|popup|modal|overlay|"
    r"nav|navbar|navigation|menu|breadcrumbs?|sidebar|side|aside|footer|foot|header|masthead|topbar|toolbar|comments?|commentlist|disqus|replies|respond|reviews?|"
    r"related|recommended|share|sharing|social|follow|subscribe|newsletter|signup|login|search|form|widget|pagination|pager|skip|copyright|legal|disclaimer|tags|meta)(?:$|[\s_-])",
    re.I,
)
NAMES_INSIDE = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|sponsor(?:ed)?|promo|cookies?|consent|notice|popup|modal|nav|navigation|menu|breadcrumbs?|sidebar|comments?|commentlist|disqus|replies|respond|related|recommended|share|sharing|social|subscribe|newsletter|signup|login|search|form|widget)(?:$|[\s_-])", re.I)
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
SPACES = re.compile(r"\s+")
#: A tag that opens inside an open one of these closes it.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = set("ul ol dl table div article section main body form nav aside header footer td th blockquote".split())


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(raw)}


def _verdict(tag: str, attrs: dict[str, str], inside: bool, state: int) -> int:
    """OWN, OPEN or AWAY for what an element holds, given its parent's."""
    if state == AWAY:
        return AWAY
    role = attrs.get("role", "").lower()
    named = f"{attrs.get('class', '')} {attrs.get('id', '')}"
    hidden = "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", attrs.get("style", ""), re.I)
    if inside:
        # an article's own header holds its title
        if hidden or (tag in AWAY_TAGS and tag != "header") or role in AWAY_ROLES or NAMES_INSIDE.search(named):
            return AWAY
        return OWN
    if tag in ("article", "main") or role in ("main", "article"):
        return AWAY if NAMES_INSIDE.search(named) else OWN
    if tag in ("html", "body"):
        return state
    if hidden or tag in AWAY_TAGS or role in AWAY_ROLES or AWAY_NAME.search(named):
        return AWAY
    return state


def blocks(page: str) -> list[tuple[int, str]]:
    """The page's blocks in order: (OWN, OPEN or AWAY, text with white space collapsed)."""
    out: list[tuple[int, str]] = []
    pieces: list[str] = []
    stack: list[tuple[str, int]] = []
    state = OPEN

    def flush() -> None:
        if pieces:
            # characters after decoding: a reference may stand for white space
            text = SPACES.sub(" ", html.unescape("".join(pieces))).strip()
            if text:
                out.append((state, text))
            pieces.clear()

    at, n = 0, len(page)
    while at < n:
        m = TAG.search(page, at)
        if m is None:
            pieces.append(page[at:])
            break
        if m.start() > at:
            pieces.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCK_TAGS or tag in AWAY_TAGS:
                flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if any(s[1] != state for s in stack[i:]):
                        flush()
                    state = stack[i][1]
                    del stack[i:]
                    break
                if stack[i][0] in SCOPE and tag not in SCOPE:
                    break
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*[^>]*(?:>|\Z)", re.I).search(page, at)
            if not m[3].rstrip().endswith("/"):
                at = end.end() if end else n
            flush() if tag == "title" else None
            continue
        if tag in BLOCK_TAGS:
            flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in CLOSES.get(tag, ()) or (tag in BLOCK_TAGS and stack[i][0] == "p" and tag != "br"):
                    state = stack[i][1]
                    del stack[i:]
                    break
                if stack[i][0] in SCOPE:
                    break
        if tag in VOID or m[3].rstrip().endswith("/") and tag in ("svg", "path"):
            continue
        inside = state == OWN
        own = _verdict(tag, _attributes(m[3]) if m[3] else {}, inside, state)
        if own != state:
            flush()
        stack.append((tag, state))
        state = own
    flush()
    return out


SEGMENTS = "row long, host string, stream long, block int, start int, anchor long, segment string"
MARKS = "host string, anchor long, segment string, covered array<struct<start:int,stop:int>>"
TEXTS = "page_id long, url string, text string, n_open_tokens long, n_repeated long"


def _tokens(text: str) -> list[str]:
    return text.split(" ")


def _anchors(hashed: np.ndarray) -> np.ndarray:
    """Places of the least GRAM-token window of every run of MIN_TOKENS tokens."""
    grams = T.gram_hashes(hashed, GRAM)
    width = MIN_TOKENS - GRAM + 1
    if len(grams) < width:
        return np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(grams, width)
    return np.unique(view.argmin(axis=1) + np.arange(len(view)))


def _segments(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, anchor's hash, tokens joined by a space) of the segments of one open block.

    A segment reaches MIN_TOKENS - GRAM tokens to either side of its anchor, so every run of
    MIN_TOKENS tokens lies whole in the segment of the anchor it holds.
    """
    words = _tokens(text)
    if len(words) < MIN_TOKENS:
        return
    (c,) = T.chunks(pa.array([" ".join(words)]), 1 << 62)
    hashed = c.word_hashes()
    if len(hashed) != len(words):
        hashed = np.array([T.span_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w.encode())]), "word")[0] for w in words])
    grams = T.gram_hashes(hashed, GRAM)
    reach = MIN_TOKENS - GRAM
    for a in _anchors(hashed).tolist():
        lo, hi = max(0, a - reach), min(len(words), a + GRAM + reach)
        yield lo, int(grams[a : a + 1].view(np.int64)[0]), " ".join(words[lo:hi])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of the open and the boilerplate blocks of each page."""
    for batch in batches:
        rows: list[tuple] = []
        for row, host, page in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            outside = [(i, t) for i, (k, t) in enumerate(blocks(page or "")) if k != OWN]
            if not outside:
                continue
            raw = np.frombuffer("\n".join(t for _, t in outside).encode(), np.uint8)
            stream = int(T.span_hashes(raw, np.array([0]), np.array([len(raw)]), "line").view(np.int64)[0])
            for i, t in outside:
                rows += [(row, host, stream, i, *s) for s in _segments(t)]
        if rows:
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["row", "host", "stream", "block", "start", "anchor", "segment"])


def suffix_array(tokens: np.ndarray) -> np.ndarray:
    """Sorted places of the suffixes of a sequence of numbers, by doubling."""
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    n, step = len(rank), 1
    while True:
        after = np.full(n, -1, np.int64)
        after[:-step] = rank[step:]
        order = np.lexsort((after, rank))
        new = np.zeros(n, np.int64)
        new[order[1:]] = np.cumsum((rank[order[1:]] != rank[order[:-1]]) | (after[order[1:]] != after[order[:-1]]))
        rank = new
        step *= 2
        if step >= n or rank[order[-1]] == n - 1:
            return order


def repeated(segments: list[list[str]], pages: np.ndarray, least: int = MIN_TOKENS, enough: int = MIN_PAGES) -> list[list[tuple[int, int]]]:
    """Spans of each segment covered by runs of ``least`` tokens that lie on ``enough`` pages in all.

    The segments are concatenated with separators of their own, and suffixes that agree in their
    first ``least`` tokens are neighbours in the suffix array.
    """
    numbers: dict[str, int] = {}
    flat: list[int] = []
    owner: list[int] = []
    for i, s in enumerate(segments):
        flat += [numbers.setdefault(w, len(numbers)) for w in s]
        flat.append(-1 - i)
        owner += [i] * (len(s) + 1)
    tokens, of = np.array(flat), np.array(owner)
    order = suffix_array(tokens)
    fits = np.array([len(s) for s in segments])[of] - (np.arange(len(of)) - np.searchsorted(of, of)) >= least
    order = order[fits[order]]
    out: list[list[tuple[int, int]]] = [[] for _ in segments]
    if not len(order):
        return out
    equal = np.ones(max(0, len(order) - 1), bool)
    for d in range(least):
        equal &= tokens[order[1:] + d] == tokens[order[:-1] + d]
    group = np.append(0, np.cumsum(~equal))
    first = np.searchsorted(of, np.arange(len(segments)))
    # a segment counts once per run
    pair = np.unique(np.stack([group, of[order]], axis=1), axis=0)
    total = np.bincount(pair[:, 0], weights=pages[pair[:, 1]])
    cover = np.zeros(len(tokens) + 1, np.int64)
    hit = order[total[group] >= enough]
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + least, -1)
    on = np.cumsum(cover)[:-1] > 0
    for i, s in enumerate(segments):
        mine = np.flatnonzero(np.diff(np.concatenate([[0], on[first[i] : first[i] + len(s)].astype(np.int8), [0]])))
        out[i] = [(int(a), int(b)) for a, b in mine.reshape(-1, 2)]
    return out


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by host and anchor: one suffix array per group."""
    key, group = None, []

    def settle() -> list[tuple]:
        if sum(n for _, n in group) < MIN_PAGES:
            return []
        spans = repeated([_tokens(s) for s, _ in group], np.array([n for _, n in group]))
        return [(*key, s, [{"start": a, "stop": b} for a, b in x]) for (s, _), x in zip(group, spans, strict=True) if x]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["host", "anchor", "segment", "covered"])

    rows: list[tuple] = []
    for batch in batches:
        for host, anchor, segment, n in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if (host, anchor) != key:
                rows += settle()
                key, group = (host, anchor), []
            group.append((segment, n))
        if rows:
            yield batch_of(rows)
            rows = []
    rows += settle()
    if rows:
        yield batch_of(rows)


def boilerplate(pages: DataFrame) -> DataFrame:
    """Rows (row, marks): spans of tokens of the blocks that the host suffix array covers.

    ``pages`` has (row, host, html).
    """
    parts = shuffle_partitions(pages.sparkSession)
    cut = written(pages.select("row", "host", "html").mapInArrow(_cut, SEGMENTS), "segments")
    merged = cut.select("host", "anchor", "segment", "stream").distinct().groupBy("host", "anchor", "segment").agg(F.count(F.lit(1)).alias("n"))
    marks = merged.select("host", "anchor", "segment", "n").repartition(parts, "host", "anchor").sortWithinPartitions("host", "anchor", "segment").mapInArrow(_shard, MARKS)
    marks = marks.withColumnsRenamed({"host": "_host", "anchor": "_anchor", "segment": "_segment"})
    hit = (F.col("host") == F.col("_host")) & (F.col("anchor") == F.col("_anchor")) & (F.col("segment") == F.col("_segment"))
    found = cut.join(marks, hit).select("row", F.explode("covered").alias("c"), "block", "start")
    span = F.struct("block", (F.col("start") + F.col("c.start")).alias("start"), (F.col("start") + F.col("c.stop")).alias("stop"))
    return found.groupBy("row").agg(F.collect_set(span).alias("marks"))


def _main(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "url", "text", "n_open_tokens", "n_repeated"]
    for batch in batches:
        for lo in range(0, len(batch), 256):
            part = batch.slice(lo, 256)
            texts, opened, again = [], [], []
            for page, marks in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                found = blocks(page or "")
                covered: dict[int, set[int]] = {}
                for m in marks or ():
                    covered.setdefault(m["block"], set()).update(range(m["start"], m["stop"]))
                landmark = any(k == OWN for k, _ in found)
                kept, n, r = [], 0, 0
                for i, (kind, t) in enumerate(found):
                    if kind == OWN:
                        kept.append(t)
                        continue
                    words = _tokens(t)
                    n += len(words)
                    r += len(covered.get(i, ()))
                    # beside a landmark nothing else is the article
                    if kind == OPEN and not landmark and (left := " ".join(w for j, w in enumerate(words) if j not in covered.get(i, ()))):
                        kept.append(left)
                texts.append(" ".join(kept))
                opened.append(n)
                again.append(r)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(opened, pa.int64()), pa.array(again, pa.int64())], names=names)


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars, n_open_tokens, n_repeated."""
    url = F.col(url_col).cast("string")
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), F.col(html_col).cast("string").alias("html"))
    base = base.withColumn("row", F.xxhash64("page_id", "url", "html")).withColumn("host", host)
    marks = boilerplate(base).withColumnRenamed("row", "_row")
    joined = base.join(marks, F.col("row") == F.col("_row"), "left").select("page_id", "url", "html", "marks")
    out = joined.mapInArrow(_main, TEXTS)
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_open_tokens", "n_repeated")
