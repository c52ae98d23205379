"""Main text of web pages by consensus host paths.

Each page's containers are scored by the text of their blocks; from the best one the page
climbs to the article around it, or while that adds running text, and votes for the path of
tags and classes, generalised so that numbered classes agree. Votes are counted per host, and
every page is extracted again from its host's winning path. A page on which that path holds
much less than the page's own best container keeps its own.

An element is left out by its tag or by a word of its class, id or role; one that holds running
text only if all words of a class, id or role say so, one in an article only if the word that names
it does, and then its h1 stays. Words of layout (has-sidebar) say nothing. Words never take away a page: an element that they name but that
holds most of the page's running text, with its heading or with hardly any text beside it, is read
again as any other. The header of an article keeps its headings.
"""

from __future__ import annotations

import bisect
import html
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import in_batches, small, written

#: What a tag does to the blocks and the open elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe".split())
#: Never article text, but with markup inside; the first kind may hold one another.
NESTED, ALONE = frozenset("noscript template svg".split()), frozenset("select button".split())
BLOCKS = frozenset("address article aside blockquote body dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("article body div main section td".split())
#: Not part of an article: by tag, by a word of class, id or role.
OUT_TAGS = frozenset("aside footer form head header menu nav dialog".split())
OUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising alert aside banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies dialog disclaimer disqus footer form gdpr header hidden login masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promotion recommended related replies responses search share sharing sidebar social sponsor sponsored subscribe subscription toolbar widget".split()
)

#: Words of layout before or after one of those, and of what and where an element is.
LAYOUT = (frozenset("has with no without is not".split()), frozenset("enabled disabled on off open closed visible active".split()))
PLACE = frozenset("article articles author bar block blog body bottom box button buttons card container content desktop entry fixed global group icon icons inner item items js left link links list main mobile outer page panel post posts primary region right row secondary section site stories story sticky tags text title top user users widget widgets wrap wrapper".split())

#: An attribute's value is quoted only after "=". No part gives back what it took, so a page is read once.
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?>[^=>]|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>]*+))*+)>?|<!--(?:-?>|.*?(?:-->|\Z))|<(?:[!?]|/(?![a-zA-Z]))[^>]*+>?", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>]++)\s*+(?:=\s*+(?:\"([^\"]*+)\"?|'([^']*+)'?|([^\s>]*+)))?")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)"
#: A page leaves its host's path if that holds less than this share of its own best text.
OWN_BEST = 0.3
#: A page climbs from its best container to one around it if at most this share of the added letters is in links.
LINKED = 0.3
#: Of the page's running text: the share that makes an element the page's own whatever its class, and the share that may lie beside it where it has no heading.
MOST, BESIDE = 0.5, 0.2
#: Tags that hold running text: left out only where every word of a class, id or role says so.
TEXTS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre figcaption td th b i em strong span a q cite mark small sub sup code time abbr u s".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Why an element is out: not at all, itself or one around it, the header of an article, whose headings stay, or by a class in an article, where an h1 stays.
IN, OUT, HEAD, SOFT = 0, 1, 2, 3


class _Open:
    """An element: digest of its path, name, the container it is in, whether blocks inside leave it open, and what classes named it for (see Page)."""

    __slots__ = ("tag", "name", "around", "digest", "depth", "out", "score", "inner", "begin", "end", "holds", "named", "hard", "weight", "heads")

    def __init__(self, tag: str, name: str, around: _Open | None, out: int, begin: int, holds: bool = False, named: int | None = None, hard: bool = False):
        self.tag, self.name, self.around, self.out, self.score, self.begin, self.end, self.holds, self.named = tag, name, around, out, 0, begin, -1, holds, named
        self.hard, self.weight, self.heads = hard, 0, 0
        said = f"/{name}".encode("utf-8", "surrogatepass") if name else b""
        digest = around.digest if around else (0, 1)
        self.digest = (zlib.crc32(said, digest[0]), zlib.adler32(said, digest[1]))
        self.depth = (around.depth if around else 0) + bool(name)
        self.inner = around.inner if around else None

    def path(self) -> str:
        names, at = [], self
        while at is not None:
            if at.name:
                names.append(at.name)
            at = at.around
        return "".join(f"/{n}" for n in reversed(names))


def _digest(path: str) -> tuple[int, int]:
    raw = path.encode("utf-8", "surrogatepass")
    return zlib.crc32(raw), zlib.adler32(raw, 1)


def _says_out(words: list[str], tag: str, in_article: bool) -> bool:
    """Whether the words of one class, id or role say that an element is no article text.

    In an article the word that names the thing counts, the last but for words of place: related-posts, not related-work.
    """
    if not any(w in OUT_WORDS for w in words) or words[0] in LAYOUT[0] or words[-1] in LAYOUT[1]:
        return False
    if tag in TEXTS:
        return all(w in OUT_WORDS for w in words)
    return not in_article or next((w for w in reversed(words) if w not in PLACE), "") in OUT_WORDS


def _attributes(tag: str, raw: str, in_article: bool) -> tuple[str, bool, bool]:
    """The generalised first class, and whether class, id or role, or else a hidden state, say that it is not article text."""
    first, named, hidden = "", False, False
    for m in ATTRIBUTE.finditer(raw) if raw else ():
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name not in ("class", "id", "role", "hidden", "style"):
            continue
        if name == "hidden":
            hidden = True
        elif name == "style":
            hidden = hidden or bool(HIDDEN.search(value))
        else:
            for said in value.split():
                words = [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", said).lower()) if w]
                named = named or _says_out(words, tag, in_article)
            if name == "class" and value.split():
                first = "." + re.sub(r"[0-9]+", "#", value.split()[0]).replace("/", "_")
    return first, named, hidden


class Page:
    """A page's containers, and its blocks in page order. A container holds blocks begin to end; the page itself is the first.

    Elements that only classes leave out are numbered. Where some hold the page's own text, the page is
    read once more without leaving those out.
    """

    def __init__(self, page: str):
        self._kept: frozenset[int] = frozenset()
        self._start_over(page)
        if kept := self._own():
            self._kept = kept
            self._start_over(page)

    def _start_over(self, page: str) -> None:
        root = _Open("", "", None, IN, 0)
        root.inner = root
        self.stack, self.found, self.blocks = [root], [root], []
        self.sizes, self.links = [0], [0]  # letters, and letters in links, of the blocks before each
        self._held, self._linked, self._in_link = [], 0, 0
        self._opened: dict[str, int] = {}
        self._n_named = self._n_holding = 0
        self._weights: dict[int, tuple[int, int]] = {}  # of numbered elements: letters outside links, headings
        self._all = self._plain = 0  # such letters of the page, and those in no numbered element
        self._ends: dict[str, list[int]] = {}
        self._starts: dict[str, list[int]] = {}
        self._read(page)
        self._flush()
        while self.stack:
            self._close()

    def _own(self) -> frozenset[int]:
        """The numbered elements that hold the page's own text."""
        return frozenset(k for k, (size, heads) in self._weights.items() if size > MOST * self._all and (heads or self._plain < BESIDE * size))

    def _flush(self) -> None:
        text = " ".join("".join(self._held).split())
        if text:
            linked = min(self._linked, len(text))
            self._all, self._plain = self._all + len(text) - linked, self._plain + len(text) - linked
            self.blocks.append(text)
            self.sizes.append(self.sizes[-1] + len(text))
            self.links.append(self.links[-1] + linked)
            at = self.stack[-1].inner
            for share in (6, 3, 2):
                if at is not None:
                    at.score += (len(text) - linked) * share
                    at = at.around.inner if at.around else None
        self._held.clear()
        self._linked = 0

    def _say(self, raw: str) -> None:
        if raw and self.stack[-1].out == IN:
            raw = html.unescape(raw)
            self._held.append(raw)
            if self._in_link:
                self._linked += len(raw)
        elif raw and not self._in_link:
            self.stack[-1].weight += len(" ".join(raw.split()))

    def _close(self) -> None:
        at = self.stack.pop()
        at.end = len(self.blocks)
        self._n_holding -= at.holds
        if at.named is not None:
            self._weights[at.named] = (at.weight, at.heads)
        if at.out and not at.hard:
            if at.around.out:
                at.around.weight, at.around.heads = at.around.weight + at.weight, at.around.heads + at.heads
            else:
                self._all += at.weight
        self._opened[at.tag] = self._opened.get(at.tag, 1) - 1

    def _read(self, page: str) -> None:
        at = 0
        while m := TAG.search(page, at):
            self._say(page[at : m.start()])
            at = m.end()
            tag = (m[2] or "").lower()
            if not tag:
                continue
            if m[1]:
                if tag == "a":
                    self._in_link = max(0, self._in_link - 1)
                if tag in BLOCKS:
                    self._flush()
                if self._opened.get(tag) and self._may_close(tag):
                    while self.stack[-1].tag != tag:
                        self._close()
                    self._close()
            elif tag in RAW:
                # a raw element's text is not markup: its end is found by text
                end = RAW_END[tag].search(page, at)
                at = end.end() if end else len(page)
            else:
                self._start(tag, m[3], page, at)
        self._say(page[at:])

    def _may_close(self, tag: str) -> bool:
        """An end tag does not reach beyond an element that holds its markup."""
        if not self._n_holding:
            return True
        for x in reversed(self.stack):
            if x.tag == tag:
                return True
            if x.holds:
                return False
        return False

    def _ends_ahead(self, tag: str, page: str, at: int) -> bool:
        """Whether an element that is never article text has its end tag: before the next of its kind, where those don't nest."""
        if tag not in self._ends:
            self._ends[tag] = [m.start() for m in END[tag].finditer(page)]
            self._starts[tag] = [m.start() for m in START[tag].finditer(page)] if tag in ALONE else []
        ends, starts = self._ends[tag], self._starts[tag]
        k = bisect.bisect_left(ends, at)
        if k == len(ends):
            return False
        n = bisect.bisect_left(starts, at)
        return n == len(starts) or ends[k] < starts[n]

    def _start(self, tag: str, raw: str, page: str, at: int) -> None:
        stack = self.stack
        if tag in BLOCKS:
            self._flush()
            while len(stack) > 1 and not stack[-1].holds and (stack[-1].tag not in BLOCKS or stack[-1].tag == "p" or stack[-1].tag == tag == "li"):
                self._close()
        if tag == "br":
            self._held.append(" ")
        if tag in VOID or raw.rstrip().endswith("/") and tag not in BLOCKS:
            return
        self._in_link += tag == "a"
        around = stack[-1]
        if tag in NESTED or tag in ALONE:
            self._push(_Open(tag, "", around, OUT, len(self.blocks), self._ends_ahead(tag, page, at), hard=True))
            return
        in_article = bool(self._opened.get("article") or self._opened.get("main"))
        name, classes, hidden = _attributes(tag, raw, in_article)
        number = None
        if classes and not hidden and tag not in OUT_TAGS:
            number, self._n_named = self._n_named, self._n_named + 1
            if number in self._kept:
                classes = False
        said = classes or hidden
        if around.out and (tag == "h1" or tag in ("article", "main") and not said):
            around.heads += 1
        if (around.out == HEAD and tag in HEADINGS or around.out == SOFT and tag == "h1") and not said:
            out = IN
        elif around.out:
            out = OUT if said or tag in OUT_TAGS else around.out
        elif tag == "header" and self._opened.get("article") and not said:
            out = HEAD
        else:
            out = OUT if tag in OUT_TAGS or said and tag not in ("html", "body", "article", "main") else IN
            if out and in_article and classes and not hidden and tag not in OUT_TAGS:
                out = SOFT
        opened = _Open(tag, f"{tag}{name}" if tag in BLOCKS else "", around, out, len(self.blocks), named=number if out in (OUT, SOFT) and classes else None, hard=out == OUT and (hidden or tag in OUT_TAGS))
        if tag in CONTAINERS and out == IN:
            opened.inner = opened
            self.found.append(opened)
        self._push(opened)

    def _push(self, x: _Open) -> None:
        self.stack.append(x)
        self._n_holding += x.holds
        self._opened[x.tag] = self._opened.get(x.tag, 0) + 1

    def size(self, x: _Open) -> int:
        return self.sizes[x.end] - self.sizes[x.begin]

    def linked(self, x: _Open) -> int:
        return self.links[x.end] - self.links[x.begin]

    def best(self) -> _Open:
        """From the container of the highest score (of equal ones the innermost, then the first) up: to the
        nearest article or main, else as long as a container around adds text that is little linked."""
        top = max(self.found, key=lambda x: (x.score, x.depth))
        if not top.score:
            return top
        at = top
        while at is not None:
            if at.tag in ("article", "main"):
                return at
            at = at.around
        at = top
        while at.around is not None:
            at = at.around.inner
            added = self.size(at) - self.size(top)
            if added:
                if self.linked(at) - self.linked(top) > LINKED * added:
                    break
                top = at
        return top

    def text(self, path: str | None) -> str:
        """The blocks of the path's outermost containers, or of the page's best where those hold much less."""
        own = self.best()
        digest = _digest(path) if path is not None else None
        agreed, size, done = [], 0, 0
        for x in self.found:
            # a match inside another is part of it already
            if x.digest == digest and x.begin >= done and x.end > x.begin:
                agreed += self.blocks[x.begin : x.end]
                size, done = size + self.size(x), x.end
        return "\n".join(self.blocks[own.begin : own.end] if size < OWN_BEST * self.size(own) else agreed)


RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*+>?", re.I) for tag in RAW}
END, START = ({tag: re.compile(rf"<{slash}{tag}\b", re.I) for tag in NESTED | ALONE} for slash in ("/", ""))


def main_text(page: str, path: str | None) -> str:
    return Page(page).text(path)


def _votes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        tops = [(top.path(), top.score) for top in (Page(page).best() for page in batch["html"])]
        yield pd.DataFrame({"host": batch["host"], "path": [t[0] for t in tops], "score": [t[1] for t in tops]})


def _texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = [main_text(page, path) for page, path in zip(batch["html"], batch["path"], strict=True)]
        yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts})


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id as text, url, text) for every page.

    Character references are decoded, white space inside a block is one space, blocks are
    joined by a line break. Null and empty pages have an empty text; pages of a null url
    or one without host share one host. Repeated rows repeat; an empty table gives no
    rows; other columns are not read. Of paths with equal votes the one of the higher score wins,
    then the later in the alphabet. A page of any length or depth is read once.
    """
    rows = pages.select(
        F.col(id_col).cast("string").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(html_col), F.lit("")).alias("html"),
        F.lower(F.regexp_extract(F.coalesce(F.col(url_col).cast("string"), F.lit("")), HOST, 1)).alias("host"),
    )
    votes = in_batches(rows).select("host", "html").mapInPandas(_votes, "host string, path string, score long").filter("score > 0")
    counted = votes.groupBy("host", "path").agg(F.struct(F.count("*").alias("n"), F.sum("score").alias("score")).alias("won"))
    winners = written(counted.groupBy("host").agg(F.max(F.struct("won", "path")).alias("top")).select("host", F.col("top.path").alias("path")), "host-paths")
    return rows.join(small(winners), "host", "left").select("page_id", "url", "html", "path").mapInPandas(_texts, "page_id string, url string, text string")
