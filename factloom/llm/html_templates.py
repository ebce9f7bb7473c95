"""Text of web pages without the templates of their sites.

Each page is parsed into elements.  A block element's subtree is hashed from its
tag, its text and its children's hashes, without attributes.  Spark counts, for
each host, the pages that hold a subtree; one that recurs on many pages of the
host is part of its template and is deleted from every page of the host before
the text is taken.

Counting combines before the shuffle, which moves 16 bytes a subtree.  The
template subtrees are broadcast up to ``max_broadcast`` of them; beyond that
they are joined to the pages' subtrees in Spark, and each page gets its own.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.workspace import map_arrow, materialize

MIN_PAGES, MIN_SHARE = 5, 0.01
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b.*?(?:</\1\s*>|\Z)|<[!?][^>]*+>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>",
    re.S | re.I,
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr b bdi bdo big button cite code data dfn em font i kbd label mark q s samp small span strike strong sub sup time tt u var".split())
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())
_SCOPE = frozenset("html body div article section main nav aside header footer ul ol dl table form blockquote td th".split())
_ROOT = frozenset(("", "html", "head", "body"))


_NAME = re.compile(r"</?[a-zA-Z][a-zA-Z0-9:-]*+")
_RAW = re.compile(r"<(?:script|style|noscript|template)\b", re.I)
_TO_END = re.compile(r"<!--|<(?:script|style|noscript|template)\b", re.I)
_SPECIAL = re.compile(r"[\"'>]")


def _closings(source: str, at: int) -> tuple[list[int], list[int]]:
    """(places of quotes and '>' from ``at`` on, for each the '>' that ends a tag which is unquoted before it, or -1)."""
    places = [m.start() for m in _SPECIAL.finditer(source, at)]
    close = [-1] * (len(places) + 1)
    after: dict[str, int] = {}
    for k in range(len(places) - 1, -1, -1):
        mark = source[places[k]]
        if mark == ">":
            close[k] = places[k]
        else:
            close[k] = close[after[mark] + 1] if mark in after else -1
            after[mark] = k
    return places, close


def tokens(source: str):
    """Matches of comments, raw elements, declarations and tags, in order; None and a start for one that the text ends in.

    A tag that never ends is text.  Once one has been met, where tags end is worked
    out for the whole rest at once, so that the time stays in proportion to the length.
    """
    last, closings = source.rfind(">"), None
    at = source.find("<")
    while at >= 0:
        if at > last:
            m = _TO_END.search(source, at)
            if m:
                yield None, m.start()
            return
        m = None
        name = _NAME.match(source, at) if closings else None
        if name is None or _RAW.match(source, at) or closings[1][bisect_left(closings[0], name.end())] >= 0:
            m = _TOKEN.match(source, at)
            if m is None and closings is None and _NAME.match(source, at):
                closings = _closings(source, at)
        if m:
            yield m, at
        at = source.find("<", m.end() if m else at + 1)


class Page:
    """Elements of one page: ``tags``, ``parts`` (texts and element numbers) and subtree ``hashes`` by number; 0 is the root."""

    def __init__(self, source: str):
        self.tags, self.parts, self.hashes = [""], [[]], [0]
        self._open: dict[str, list[int]] = {}  # the depths of the open elements of each tag
        self._scopes = [0]
        stack, at = [0], 0
        for m, start in tokens(source):
            if start > at:
                self._text(stack, source[at:start])
            at = m.end() if m else len(source)
            name = m and m.group(3)
            if name is None:
                continue
            tag = name.lower()
            if m.group(2):
                self._end(stack, tag)
            else:
                self._begin(stack, tag, m.group(4).endswith("/"))
        if at < len(source):
            self._text(stack, source[at:])
        while stack:
            self._close(stack)

    def _text(self, stack, raw):
        text = " ".join(html.unescape(raw).split()) if "&" in raw else " ".join(raw.split())
        if text:
            # outer blanks part words of neighbouring inline elements
            self.parts[stack[-1]].append((" " if raw[:1].isspace() else "") + text + (" " if raw[-1:].isspace() else ""))

    def _begin(self, stack, tag, closed):
        ends = _CLOSES.get(tag)
        if ends is None and tag in _ENDS_P:
            ends = _CLOSES["p"]
        if ends:
            depth = max((self._open[t][-1] for t in ends if self._open.get(t)), default=0)
            if depth and depth >= self._scopes[-1]:
                while len(stack) > depth:
                    self._close(stack)
        number = len(self.tags)
        self.tags.append(tag)
        self.parts.append([])
        self.hashes.append(0)
        self.parts[stack[-1]].append(number)
        if tag not in _VOID and not closed:
            self._open.setdefault(tag, []).append(len(stack))
            if tag in _SCOPE:
                self._scopes.append(len(stack))
            stack.append(number)

    def _end(self, stack, tag):
        depths = self._open.get(tag)
        if depths:
            depth = depths[-1]
            while len(stack) > depth:
                self._close(stack)

    def _close(self, stack):
        number = stack.pop()
        if stack:
            self._open[self.tags[number]].pop()
            if self._scopes[-1] == len(stack):
                self._scopes.pop()
        parts = self.parts[number]
        if any(isinstance(p, str) or self.hashes[p] for p in parts):
            content = "\x1f".join(p.strip() if isinstance(p, str) else f"\x1e{self.hashes[p]:x}" for p in parts)
            self.hashes[number] = xxhash.xxh3_64_intdigest(f"{self.tags[number]}\x1d{content}") or 1

    def subtrees(self) -> set[int]:
        """Hashes of the block elements that hold text."""
        return {h for t, h in zip(self.tags, self.hashes) if h and t not in _INLINE and t not in _ROOT}

    def text(self, removed) -> tuple[str, int]:
        """(text with a line for each block, subtrees left out)."""
        lines, line, lost = [], [], 0

        def flush():
            joined = " ".join("".join(line).split())
            if joined:
                lines.append(joined)
            line.clear()

        todo = [(0, iter(self.parts[0]))]
        while todo:
            number, parts = todo[-1]
            for p in parts:
                if isinstance(p, str):
                    line.append(p)
                    continue
                tag = self.tags[p]
                block = tag not in _INLINE
                if block:
                    flush()
                if block and tag not in _ROOT and self.hashes[p] in removed:
                    lost += 1
                    continue
                todo.append((p, iter(self.parts[p])))
                break
            else:
                todo.pop()
                if self.tags[number] not in _INLINE:
                    flush()
        return "\n".join(lines), lost


def host_of(url: str = "url"):
    """The host of a URL, lower-cased, without user and port; '' where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _key(host: int, subtree: int) -> int:
    return xxhash.xxh3_64_intdigest(host.to_bytes(8, "little", signed=True) + subtree.to_bytes(8, "little"))


def extract_text(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, max_broadcast: int = 8_000_000) -> DataFrame:
    """(page_id, host, text, n_removed), a row for each page row.

    A subtree goes if it occurs on at least ``min_pages`` pages of its host and on
    ``min_share`` of them; n_removed counts the deleted elements.  Scripts,
    styles, comments and inline elements' recurrence don't count.  Null and empty
    sources give an empty text.  A null or unreadable URL has the host '', which
    is treated like a host; a null or repeated page_id is passed on, and repeated
    rows count as pages.  Broken markup is read leniently, whole, at any length and
    depth, in time that is in proportion to the length.
    Other columns are ignored; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of().alias("host"), F.xxhash64(host_of()).alias("host_id"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))

    def collect(batches):
        for batch in batches:
            pages_, hosts, keys = [], [], []
            for k, (host, source) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                found = Page(source).subtrees()
                keys += [_key(host, h) for h in found]
                hosts += [host] * len(found)
                pages_ += [k] * len(found)
            yield pa.record_batch([batch.column(0).take(pa.array(pages_, pa.int64())), pa.array(hosts, pa.int64()), pa.array(np.array(keys, np.uint64).view(np.int64))], names=["page_id", "host_id", "key"])

    subtrees = map_arrow(src.select("page_id", "host_id", "html"), collect, "page_id long, host_id long, key long")
    size = src.groupBy("host_id").agg(F.count("*").alias("pages"))
    counts = subtrees.groupBy("host_id", "key").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    templates = materialize(counts.join(size, "host_id").where(F.col("n") >= min_share * F.col("pages")).select("key"), "templates")

    def emit(batch, removed_of):
        texts, lost = [], []
        for k, (host, source) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
            page = Page(source)
            found = list(page.subtrees())
            keys = np.array([_key(host, h) for h in found], np.uint64)
            known = removed_of(k, keys)
            text, n = page.text({h for h, y in zip(found, known) if y})
            texts.append(text)
            lost.append(n)
        return pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(lost, pa.int32())], names=["page_id", "host", "text", "n_removed"])

    result = "page_id long, host string, text string, n_removed int"
    if templates.count() <= max_broadcast:
        sent = spark.sparkContext.broadcast(np.sort(templates.toArrow()["key"].to_numpy().view(np.uint64)))

        def known(_, keys):
            if not len(sent.value):
                return np.zeros(len(keys), bool)
            return sent.value[np.minimum(np.searchsorted(sent.value, keys), len(sent.value) - 1)] == keys

        def run(batches):
            for batch in batches:
                yield emit(batch, known)

        return map_arrow(src, run, result)
    mine = subtrees.join(templates, "key", "left_semi").groupBy(F.col("page_id").alias("__id")).agg(F.collect_set("key").alias("__keys"))
    joined = src.join(mine, src["page_id"].eqNullSafe(mine["__id"]), "left").drop("__id")

    def run(batches):
        for batch in batches:
            own = batch.column(4)
            yield emit(batch, lambda k, keys: np.isin(keys, np.array(own[k].as_py() or [], np.int64).view(np.uint64)))

    return map_arrow(joined, run, result)
