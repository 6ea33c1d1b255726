"""Main text of web pages: structure of the page, and host-wide repeats by suffix arrays.

A page is cut into blocks of text. Blocks of the article stay. Blocks of menus,
headers, footers, sidebars, notices, adverts, forms and comments, known by
element, role or class, go. What is left, unmarked blocks outside the article,
is decided by repetition: the token streams of a host's pages (marked blocks
included) are concatenated, suffixes that agree in their first tokens meet in a
suffix array, and stretches of tokens found on several different pages of the
host are boilerplate. Pages are different if any of their tokens are, so that
many articles in one template are many pages. Covered stretches go, unique runs stay.

A host of any size is dealt into groups of pages; each group sorts its own
suffixes and passes on one row per distinct stretch with its number of pages,
and these are added up per host, so that the result does not depend on groups.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.store import slices
from tallyloom.llm.words import chain, hash_words
from tallyloom.operators.lookup import lookup
from tallyloom.session import settle

#: A repeated stretch has at least so many tokens, on at least so many different pages of a host.
REPEAT_TOKENS, REPEAT_PAGES = 6, 3
#: Unique runs shorter than this beside a covered stretch go with it.
RUN_TOKENS = 3
#: Tokens whose suffixes are sorted together.
GROUP_TOKENS = 400_000

_NAME = re.compile(r"[^\s/>]*")
_SPECIAL = re.compile(r"[>\"']")
# Decimal references of numbers that no character has; Python would read their digits one by one.
_ZEROS, _HUGE = re.compile(r"&#0+(?=[0-9])"), re.compile(r"&#[0-9]{8,};?")
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

_RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "svg", "xmp"}
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary "
    "table tbody tfoot thead tr ul".split()
)
_MARKED_ELEMENTS = set("nav footer aside form menu button select dialog search head object canvas audio video".split())
_MARKED_ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
_MARKED_WORDS = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice "
    "newsletter subscribe subscription sidebar menu nav navbar navigation breadcrumb breadcrumbs comment comments reply "
    "replies disqus social popup modal overlay login signup pagination pager widget related toolbar".split()
)
_WEAK_WORDS = set("header footer banner share sharing masthead meta search".split())
_ARTICLE_WORDS = set("article post entry story main".split())
_WALLS = set("ul ol dl table div article section blockquote".split())
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "option": {"option"}}

ARTICLE, OPEN, MARKED = 0, 1, 2


def _looks(name: str, attributes: str) -> tuple[bool, bool]:
    """Whether an element is marked as something else than content, and whether as comments."""
    words: set[str] = set()
    marked = name in _MARKED_ELEMENTS
    for key, value in _ATTRIBUTE.findall(attributes) if attributes else ():
        key, value = key.lower(), value.strip("\"'")
        if key == "role":
            marked |= value.lower() in _MARKED_ROLES
        elif key == "hidden" or key == "aria-hidden":
            marked |= key == "hidden" or value.lower() == "true"
        else:
            words.update(word.lower() for word in _WORDS.findall(value))
    remarks = bool(words & {"comment", "comments", "reply", "replies", "disqus"})
    if name not in ("body", "html"):
        marked |= bool(words & _MARKED_WORDS) or (bool(words & _WEAK_WORDS) and not words & _ARTICLE_WORDS)
    return marked, remarks


class _Tags:
    """Finds the tags of a page from front to back, in time that grows with its length.

    A tag ends at the first ``>`` outside quotes, or, if a quote in it is never
    closed, at the first one at all. What lies ahead of a quote does not depend
    on the tag it is in, so that is worked out once per quote.
    """

    def __init__(self, html: str):
        self.html = html
        self.last = html.rfind(">")
        self.data_end = html.rfind("]]>")
        # Where the tag ends if the next mark outside quotes is the one at this place; -1 if it does not.
        self.ends: dict[int, int] = {}

    def _end(self, at: int) -> int:
        """The ``>`` that ends a tag whose attributes begin at ``at``; -1 if there is none outside quotes."""
        passed = []
        while True:
            mark = _SPECIAL.search(self.html, at)
            if mark is None:
                found = -1
            elif (place := mark.start()) in self.ends:
                found = self.ends[place]
            elif mark[0] == ">":
                found = place
            else:
                passed.append(place)
                close = self.html.find(mark[0], place + 1)
                if close >= 0:
                    at = close + 1
                    continue
                found = -1
            for place in passed:
                self.ends[place] = found
            return found

    def next(self, at: int) -> tuple[int, int, str, bool, str, str] | None:
        """The next tag from ``at``: start, end, name, whether it closes, attributes, and text that it stands for.

        Comments and declarations have no name.
        """
        html = self.html
        while (start := html.find("<", at)) >= 0:
            if html.startswith("<!--", start):
                close = html.find("-->", start + 4)
                return start, len(html) if close < 0 else close + 3, "", False, "", ""
            if start < self.data_end and html.startswith("<![CDATA[", start):
                close = html.find("]]>", start + 9)
                if close >= 0:
                    return start, close + 3, "", False, "", html[start + 9 : close].replace("&", "&amp;")
            if start > self.last:
                # Only a comment needs no end.
                at = html.find("<!--", start)
                if at < 0:
                    return None
                continue
            after = html[start + 1 : start + 3]
            if after[:1] in ("!", "?"):
                return start, html.find(">", start) + 1, "", False, "", ""
            closes = after[:1] == "/"
            first = after[1:2] if closes else after[:1]
            if first.isascii() and first.isalpha():
                begin = start + 1 + closes
                name_end = _NAME.match(html, begin).end()
                end = self._end(name_end)
                if end < 0:
                    end = html.find(">", name_end)
                if end >= 0:
                    return start, end + 1, html[begin:name_end].lower(), closes, html[name_end:end], ""
            at = start + 1
        return None


class _Open:
    """Open elements: name, marked (with its ancestors), comments, inside an article, inside main.

    Keeps the places of every name, so that a search for one never walks the stack.
    """

    def __init__(self) -> None:
        self.stack: list[tuple[str, bool, bool, bool, bool]] = [("", False, False, False, False)]
        self.places: dict[str, list[int]] = {}
        self.walls: list[int] = []

    def push(self, name: str, *marks: bool) -> None:
        self.places.setdefault(name, []).append(len(self.stack))
        if name in _WALLS:
            self.walls.append(len(self.stack))
        self.stack.append((name, *marks))

    def pop(self) -> None:
        name = self.stack.pop()[0]
        self.places[name].pop()
        if name in _WALLS:
            self.walls.pop()

    def close(self, name: str, inside: bool = False) -> None:
        """Close the innermost element of this name and all in it; with ``inside`` only if no wall stands between."""
        found = self.places.get(name)
        if found and not (inside and self.walls and self.walls[-1] > found[-1]):
            place = found[-1]
            while len(self.stack) > place:
                self.pop()


def _plain(text: str) -> str:
    """Text with its character references decoded and its white space made single."""
    return " ".join(unescape(_HUGE.sub("\ufffd", _ZEROS.sub("&#", text)) if "&#" in text else text).split())


def blocks(html: str) -> list[tuple[int, str]]:
    """The blocks of a page in order: zone (article, open, marked) and text.

    Malformed pages are read on: an end tag closes what is open down to its
    element, or nothing; an article ends an unclosed marked element around it.
    The time grows with the length of the page, however broken it is.
    """
    found: list[tuple[int, str]] = []
    held: list[str] = []
    opened = _Open()
    stack = opened.stack
    zones: list[tuple[bool, bool, bool]] = []

    def close_block() -> None:
        if held:
            text = _plain("".join(held))
            held.clear()
            if text:
                _, marked, _, article, main = stack[-1]
                found.append((0, text))
                zones.append((marked, article, main))

    at, tags = 0, _Tags(html)
    while True:
        tag = tags.next(at)
        if tag is None:
            held.append(html[at:])
            break
        start, end, name, closes, attributes, said = tag
        if start > at:
            held.append(html[at:start])
        at = end
        if not name:
            if said:
                held.append(said)
            continue
        if closes:
            if name in _BLOCKS:
                close_block()
            elif name in ("td", "th"):
                held.append(" ")
            opened.close(name)
            continue
        if name == "br":
            held.append(" ")
            continue
        if name in _RAW and not attributes.endswith("/"):
            last = re.compile(rf"</{name}\s*>", re.I).search(html, at)
            at = last.end() if last else len(html)
            continue
        if name in _BLOCKS:
            close_block()
        elif name in ("td", "th", "img"):
            held.append(" ")
        if name in _VOID or attributes.endswith("/"):
            continue
        for other in _CLOSES.get(name, ()):
            opened.close(other, inside=True)
        marked, remarks = _looks(name, attributes) if attributes or name in _MARKED_ELEMENTS else (False, False)
        if name == "header" and not stack[-1][3]:
            marked = True
        if name in ("article", "main") and not marked and not remarks:
            while stack[-1][1] and not stack[-1][2]:
                opened.pop()
        _, above, comments, article, main = stack[-1]
        opened.push(name, above or marked, comments or remarks, article or name == "article", main or name == "main")
    close_block()
    articles = any(article and not marked for marked, article, _ in zones)
    out = []
    for (_, text), (marked, article, main) in zip(found, zones):
        zone = MARKED if marked else ARTICLE if (article if articles else main) else OPEN
        out.append((zone, text))
    return out


def host_of(url: Column) -> Column:
    """Lower-case host of a URL; empty if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def suffix_array(tokens: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their first ``depth`` tokens, and a class per suffix: equal if these agree.

    Prefix doubling: after each round suffixes are ranked by twice as many tokens.
    """
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    known = 1
    while known < depth:
        step = min(known, depth - known)
        later = np.full(n, -1, dtype=np.int64)
        later[: max(n - step, 0)] = rank[step:]
        rank = np.unique(rank * (n + 1) + later + 1, return_inverse=True)[1].astype(np.int64)
        known += step
    return np.argsort(rank, kind="stable"), rank


def window_hashes(tokens: np.ndarray, length: int) -> np.ndarray:
    """A hash of the ``length`` tokens that start at each place where there are so many."""
    n = max(len(tokens) - length + 1, 0)
    key = tokens[:n]
    for j in range(1, length):
        key = chain(key, tokens[j : n + j])
    return key


def _repeats(frame: pd.DataFrame, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every distinct stretch of ``length`` tokens in a group of streams, and its number of pages.

    A stream counts as many pages as its row says.
    """
    streams = [np.array(tokens, dtype=np.int64).view(np.uint64) for tokens in frame["tokens"]]
    # A separator of its own after each page: no stretch reaches over two pages.
    line = np.concatenate([part for i, s in enumerate(streams) for part in (s, np.array([i], dtype=np.uint64))])
    page = np.repeat(np.arange(len(streams)), [len(s) + 1 for s in streams])
    order, kind = suffix_array(line, length)
    left = np.concatenate([np.arange(len(s) + 1, 0, -1) for s in streams])
    order = order[left[order] > length]
    if not len(order):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    pairs = np.unique(np.column_stack([kind[order], page[order]]), axis=0)
    classes, starts = np.unique(pairs[:, 0], return_index=True)
    pages = np.add.reduceat(frame["pages"].to_numpy(dtype=np.int64)[pairs[:, 1]], starts)
    first = order[np.searchsorted(kind[order], classes)]
    words = [line[first + j] for j in range(length)]
    key = words[0]
    for word in words[1:]:
        key = chain(key, word)
    return key, pages


_REST = "key long, page_id long, host string, whole long, stream long, tokens array<long>, open array<struct<place: int, text: string, first: int>>"


def _stream_hash(hashes: np.ndarray) -> int:
    """One signed hash of a sequence of token hashes."""
    key = np.uint64(len(hashes))
    found = int((hashes * np.arange(1, 2 * len(hashes), 2, dtype=np.uint64)).sum(dtype=np.uint64) ^ key)
    return found - (1 << 64) if found >= 1 << 63 else found


def _streams(pages: DataFrame) -> DataFrame:
    """Per page: its token stream outside the article, and its open blocks with their first token's place in it.

    ``whole`` is the hash of all its tokens, the article's too; ``stream`` that of the tokens outside.
    """
    spot = pa.list_(pa.struct([("place", pa.int32()), ("text", pa.string()), ("first", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html", 4_000_000):
                tokens, wholes, streams, rest = [], [], [], []
                for html in part.column("html").to_pylist():
                    found = blocks(html) if html else []
                    outside = [(i, zone, text) for i, (zone, text) in enumerate(found) if zone != ARTICLE]
                    hashes, sizes = hash_words([text.encode() for _, text in found])
                    wholes.append(_stream_hash(hashes))
                    kept = np.array([zone != ARTICLE for zone, _ in found], dtype=bool)
                    hashes, sizes = hashes[np.repeat(kept, sizes)], sizes[kept]
                    tokens.append(hashes.view(np.int64))
                    streams.append(_stream_hash(hashes))
                    firsts = (np.cumsum(sizes) - sizes).tolist()
                    own = zip(outside, firsts)
                    rest.append([{"place": i, "text": text, "first": at} for (i, zone, text), at in own if zone == OPEN])
                arrays = [part.column("key"), part.column("page_id"), part.column("host")]
                arrays += [pa.array(wholes, pa.int64()), pa.array(streams, pa.int64()), pa.array(tokens, pa.list_(pa.int64())), pa.array(rest, spot)]
                yield pa.RecordBatch.from_arrays(arrays, names=["key", "page_id", "host", "whole", "stream", "tokens", "open"])

    return pages.select("key", "page_id", "host", "html").mapInArrow(run, _REST)


def repeated_stretches(rest: DataFrame, length: int = REPEAT_TOKENS, least: int = REPEAT_PAGES, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """host, stretch (hash) of all stretches on at least ``least`` different pages of a host.

    Copies of a whole page count once. Pages with different articles and the
    same stream around them all count; their stream is sorted once.
    """
    long = rest.filter(F.size("tokens") >= length)
    weights = long.select("host", "stream", "whole").distinct().groupBy("host", "stream").agg(F.count(F.lit(1)).alias("pages"))
    pages = long.select("host", "stream", "tokens").dropDuplicates(["host", "stream"]).join(weights, ["host", "stream"])
    hosts = pages.groupBy("host").agg(F.sum(F.size("tokens")).alias("n"))
    hosts = hosts.select("host", F.ceil(F.col("n") / group_tokens).cast("int").alias("groups"))
    dealt = lookup(pages, hosts, ["host"], ["stream"]).withColumn("group", F.pmod("stream", F.col("groups")))

    def sort(frame: pd.DataFrame) -> pd.DataFrame:
        key, count = _repeats(frame, length)
        # A host that is one group needs no adding up: unique stretches stay here.
        kept = count >= (least if frame["groups"].iloc[0] == 1 else 1)
        return pd.DataFrame({"host": frame["host"].iloc[0], "stretch": key[kept].view(np.int64), "pages": count[kept]})

    counted = dealt.groupBy("host", "group").applyInPandas(sort, "host string, stretch long, pages long")
    return counted.groupBy("host", "stretch").agg(F.sum("pages").alias("pages")).filter(F.col("pages") >= least).drop("pages")


def unique_runs(text: str, gone: np.ndarray, least: int = RUN_TOKENS) -> str:
    """``text`` without the tokens at the places ``gone``; shorter runs than ``least`` between them go too."""
    words = text.split(" ")
    away = np.zeros(len(words), dtype=bool)
    away[gone[(gone >= 0) & (gone < len(words))]] = True
    if not away.any():
        return text
    out, run = [], []
    for word, covered in zip([*words, ""], [*away.tolist(), True]):
        if not covered:
            run.append(word)
            continue
        if len(run) >= least:
            out += run
        run = []
    return " ".join(out)


def _decided(rest: DataFrame, length: int) -> DataFrame:
    """Per page: what stays of its open blocks (extra), and how many tokens outside the article are repeats (repeated)."""
    pages = rest.filter(F.size("tokens") >= length).select("key", "host", "tokens", "open").dropDuplicates(["key"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, hosts, starts, found = [], [], [], []
            for host, key, tokens in zip(*(batch.column(name).to_pylist() for name in ("host", "key", "tokens"))):
                hashes = window_hashes(np.array(tokens, dtype=np.int64).view(np.uint64), length).view(np.int64)
                keys.append(np.full(len(hashes), key))
                hosts += [host] * len(hashes)
                starts.append(np.arange(len(hashes), dtype=np.int32))
                found.append(hashes)
            if keys:
                arrays = [pa.array(hosts, pa.string()), *[pa.array(np.concatenate(x)) for x in (keys, starts, found)]]
                yield pa.RecordBatch.from_arrays(arrays, names=["host", "key", "start", "stretch"])

    stretches = pages.select("host", "key", "tokens").mapInArrow(cut, "host string, key long, start int, stretch long")
    hit = lookup(stretches, settle(repeated_stretches(rest, length)), ["host", "stretch"], ["key", "start"])
    covered = hit.groupBy("key").agg(F.collect_set("start").alias("covered"))
    spot = pa.list_(pa.struct([("place", pa.int32()), ("text", pa.string())]))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            extra, repeated = [], []
            for gone, own in zip(batch.column("covered").to_pylist(), batch.column("open").to_pylist()):
                gone = np.array(sorted(gone or ()), dtype=np.int64)
                places = np.unique(gone[:, None] + np.arange(length)[None, :])
                repeated.append(len(places))
                kept = [(o["place"], unique_runs(o["text"], places - o["first"])) for o in own]
                extra.append([{"place": place, "text": text} for place, text in kept if text])
            arrays = [batch.column("key"), pa.array(extra, spot), pa.array(repeated, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "extra", "repeated"])

    schema = "key long, extra array<struct<place: int, text: string>>, repeated long"
    short = rest.filter((F.size("tokens") < length) & (F.size("open") > 0)).dropDuplicates(["key"])
    rows = pages.join(covered, "key", "left").select("key", "covered", "open")
    rows = rows.unionByName(short.select("key", F.lit(None).cast("array<int>").alias("covered"), "open"))
    return rows.mapInArrow(join, schema)


def extract(pages: DataFrame, length: int = REPEAT_TOKENS) -> DataFrame:
    """page_id, url, text, n_chars and repeated_tokens of every row of ``pages`` (page_id, url, html).

    A null or empty page has an empty text. Blocks are joined by a blank line.
    Repeated rows give a row each and count as one page of their host; pages
    without a URL share the empty host. An empty table gives no rows, other
    columns are left out.
    ``repeated_tokens`` counts the tokens outside the article that the host repeats.
    """
    row = {"page_id": F.col("page_id").cast("long"), "url": F.col("url").cast("string"), "html": F.col("html").cast("string")}
    rows = pages.select(*[column.alias(name) for name, column in row.items()])
    rows = rows.withColumn("key", F.xxhash64("page_id", "url", "html")).withColumn("host", host_of(F.col("url")))
    rest = settle(_streams(rows))
    main_type = pa.list_(pa.struct([("place", pa.int32()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html", 4_000_000):
                main = []
                for html in part.column("html").to_pylist():
                    found = blocks(html) if html else []
                    main.append([{"place": i, "text": text} for i, (zone, text) in enumerate(found) if zone == ARTICLE])
                arrays = [part.column("page_id"), part.column("url"), part.column("key"), pa.array(main, main_type)]
                yield pa.RecordBatch.from_arrays(arrays, names=["page_id", "url", "key", "main"])

    schema = "page_id long, url string, key long, main array<struct<place: int, text: string>>"
    parsed = rows.select("page_id", "url", "key", "html").mapInArrow(run, schema)
    found = parsed.join(settle(_decided(rest, length)), "key", "left")
    everything = F.when(F.col("extra").isNull(), F.col("main")).otherwise(F.array_sort(F.concat("main", "extra")))
    text = F.concat_ws("\n\n", F.transform(everything, lambda block: block["text"]))
    found = found.select("page_id", "url", text.alias("text"), F.coalesce("repeated", F.lit(0)).alias("repeated_tokens"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "repeated_tokens")
