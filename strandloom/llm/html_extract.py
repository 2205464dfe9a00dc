"""The main text of web pages, from containers that the pages of a host agree on.

Each page's containers are scored by how much of its prose they hold and how
little else. A page votes for its best one by its path of tags with their first
class and id, numbers taken out, so that pages from one template vote alike;
Spark counts the votes per host. The paths with a fair share of a host's votes
win, and every page is read again: of the winning paths it has, the one best by
its own score and the host's votes gives the text. So a page with little prose
or much around it follows its host. A page with none of the winning paths keeps
its own best container.

Two narrow passes over the pages; between them travels one short row a page,
which tasks sum before they shuffle. What wins on one host is at most 1/SHARE
paths of at most PATH characters.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import checkpointed, slices
from strandloom.llm.line_dedup import host_of

#: Votes of a host's pages that a path needs to win; the first path wins in any case.
SHARE = 0.25
#: Longer paths begin with a digest of what is left out.
PATH = 600
#: Winning paths of all hosts are broadcast up to so many bytes, and joined by host beyond.
BROADCAST_BYTES = 8 << 20

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|([^\s=/"'>]+)""", re.S)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title textarea iframe noembed noframes noscript template svg xmp".split())
_RAW_END = {name: re.compile(f"</{name}(?=[\\s/>])[^>]*>", re.I) for name in _RAW}
_BLOCK = frozenset(
    "address article aside blockquote caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup"
    " hr legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_CONTAINER = frozenset("article center div main section td".split())
_LISTS = frozenset("menu ol ul".split())
_PROSE = frozenset("blockquote dd dt figcaption h1 h2 h3 h4 h5 h6 li p pre td".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: A start tag of the first kind ends open elements of the second, up to one of the third.
_CLOSES = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr")), "option": (("option",), ("select",)),
}
_CLOSES_P: tuple[tuple[str, ...], tuple[str, ...]] = ((), ())
#: Elements that are no part of an article, and words of classes, ids and roles that say the same of any element.
_ASIDE = frozenset("aside button dialog footer form menu nav object search select".split())
_ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense alert alertdialog banner breadcrumb breadcrumbs captcha complementary consent contentinfo cookie cookies dialog footer"
    " gdpr login masthead menu modal nav navbar navigation newsletter notice notification overlay pager pagination paywall popup promo promoted promotion recommended recommendations related"
    " search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar toc widget".split()
)
_COMMENT_WORDS = frozenset("comment commentlist comments commenters discussion disqus replies reply respond".split())
_MAIN_WORDS = frozenset("article articlebody content entry main post story".split())
_NOT_THERE = frozenset("has no with without".split())
#: A list of at least so many links and hardly anything else is a menu.
_MENU_LINKS, _MENU_SHARE = 3, 0.9
#: What prose outside of paragraphs counts, what an element gains by its name, and what a step down does.
_LOOSE, _NAMED, _DEEPER, _DEEPEST = 0.5, 1.2, 1e-3, 50

_TEXT, _ASIDE_TEXT, _HEADER_TEXT = range(3)


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, value, alone in _ATTRIBUTE.findall(text):
        found.setdefault((name or alone).lower(), html.unescape(value.strip("\"'")))
    return found


def _words(attributes: dict[str, str]) -> set[str]:
    """The words of class, id and role; not those behind has, no, with or without."""
    out: set[str] = set()
    for name in " ".join(attributes.get(k, "") for k in ("class", "id", "role")).split():
        words = [w.lower() for w in _WORDS.findall(name)]
        out.update(w for w, before in zip(words, ["", *words]) if before not in _NOT_THERE)
    return out


@lru_cache(maxsize=4096)
def _read_tag(name: str, rest: str) -> tuple[str, bool, bool, bool, bool]:
    """What a start tag says: its step of a path (tag, first class and id without digits; an article or main is one whatever it is called),
    and whether it is hidden or of reader comments, an aside by its words, a header, main text."""
    if not rest or rest.isspace():
        return name, False, False, name == "header", name in ("article", "main")
    attributes = _attributes(rest)
    words, whole = _words(attributes), name in ("article", "main")
    step = name
    if not whole:
        names = re.sub(r"\d+", "", (attributes.get("class", "").split() or [""])[0]), re.sub(r"\d+", "", attributes.get("id", "").strip())
        step += "".join(mark + word for mark, word in zip(".#", names) if word)
    hidden = "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower()
    return step, hidden or bool(words & _COMMENT_WORDS), not whole and bool(words & _ASIDE_WORDS), name == "header" or "header" in words, whole or bool(words & _MAIN_WORDS)


class Page:
    """The blocks of a page that may be text, and the block elements that hold them, in page order."""

    def __init__(self, source: str, forms: bool = True) -> None:
        self._forms = forms
        # Of each block element: its tag, the element around it, its path, whether its name says main text, other characters, links.
        self.tag, self.parent, self.path, self.main, self.noise, self.links = ["body"], [0], ["body"], [False], [0], [0]
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters in links
        self._open = [("body", 0, _TEXT, False)]  # tag, element, kind, within main text
        self._parts: list[str] = []
        self._linked, self._in_link = 0, False
        at, end = 0, len(source)
        while at < end:
            token = _TOKEN.search(source, at)
            if not token or token.start() > at:
                self._text(source[at : token.start() if token else end])
            if not token:
                break
            at, name = token.end(), (token[2] or token[5] or "").lower()
            if not name or source[at - 1] != ">":
                continue
            if token[1] or token[4]:
                self._end(name)
            elif name in _RAW:
                close = _RAW_END[name].search(source, at)
                at = close.end() if close else end
            else:
                self._start(name, token[3] or token[6] or "")
        self._flush()
        self._without_menus()

    def _text(self, text: str) -> None:
        text = html.unescape(text) if "&" in text else text
        _, element, kind, _ = self._open[-1]
        if kind == _TEXT:
            self._parts.append(text)
            self._linked += len(" ".join(text.split())) if self._in_link else 0
        else:
            self.noise[element] += len(" ".join(text.split()))

    def _flush(self) -> None:
        if self._parts:
            text = " ".join("".join(self._parts).split())
            if text:
                self.blocks.append((self._open[-1][1], text, min(self._linked, len(text))))
            self._parts, self._linked = [], 0

    def _start(self, name: str, rest: str) -> None:
        if name in ("html", "head", "body"):
            return
        block = name in _BLOCK
        if block:
            self._flush()
            ends, stop = _CLOSES.get(name, _CLOSES_P)
            for k in range(len(self._open) - 1, 0, -1):
                tag = self._open[k][0]
                if tag == "p" or tag in ends:
                    del self._open[k:]
                elif tag in stop or tag in _BLOCK:
                    break
        if name in _VOID:
            self._parts.append(" " if name == "br" else "")
            return
        _, above, kind, within = self._open[-1]
        if name == "a":
            self._in_link = True
            self.links[above] += 1
            return
        whole = name in ("article", "main")
        step, hidden, aside, header, main = _read_tag(name, rest)
        if whole:
            self._in_link = False
        if kind == _HEADER_TEXT and name in _HEADING:
            kind = _TEXT
        if hidden or aside or name in _ASIDE and (self._forms or name != "form"):
            kind = _ASIDE_TEXT
        elif header and kind == _TEXT and not whole and name not in _HEADING:
            kind = _HEADER_TEXT if within or main else _ASIDE_TEXT
        element = above
        if block:
            element = len(self.tag)
            self.tag.append(name)
            self.parent.append(above)
            path = f"{self.path[above]}/{step}"
            self.path.append(path if len(path) <= PATH else "#" + hashlib.sha256(path.encode("utf-8", "replace")).hexdigest())
            self.main.append(main)
            self.noise.append(0)
            self.links.append(0)
        self._open.append((name, element, kind, within or main))

    def _end(self, name: str) -> None:
        if name == "a":
            self._in_link = False
            return
        for k in range(len(self._open) - 1, 0, -1):
            tag = self._open[k][0]
            if tag == name:
                if name in _BLOCK:
                    self._flush()
                del self._open[k:]
                return
            if tag in _BLOCK and name not in _BLOCK:
                return

    def _without_menus(self) -> None:
        """Blocks of lists of links become other characters."""
        n = len(self.tag)
        size, linked, links = [0] * n, [0] * n, list(self.links)
        for element, text, in_links in self.blocks:
            size[element] += len(text)
            linked[element] += in_links
        for i in range(n - 1, 0, -1):
            for sums in (size, linked, links):
                sums[self.parent[i]] += sums[i]
        menu = [False] * n
        for i in range(1, n):
            menu[i] = menu[self.parent[i]] or self.tag[i] in _LISTS and links[i] >= _MENU_LINKS and linked[i] >= _MENU_SHARE * size[i]
        for element, text, _ in self.blocks:
            self.noise[element] += len(text) if menu[element] else 0
        self.blocks = [b for b in self.blocks if not menu[b[0]]]

    def scores(self) -> dict[str, float]:
        """Of each path of containers with prose: the harmonic mean of the prose's share within it and its share of all prose, more for main text and depth."""
        n = len(self.tag)
        prose, size, depth = [0.0] * n, list(self.noise), [0] * n
        for element, text, linked in self.blocks:
            prose[element] += (len(text) - linked) * (1 if self.tag[element] in _PROSE else _LOOSE)
            size[element] += len(text)
        for i in range(1, n):
            depth[i] = depth[self.parent[i]] + 1
        for i in range(n - 1, 0, -1):
            prose[self.parent[i]] += prose[i]
            size[self.parent[i]] += size[i]
        found: dict[str, list[float]] = {}
        for i in range(n):
            if prose[i] and (i == 0 or self.tag[i] in _CONTAINER):
                one = found.setdefault(self.path[i], [0, 0, min(depth[i], _DEEPEST), 1])
                one[0] += prose[i]
                one[1] += size[i]
                one[3] = _NAMED if self.main[i] else one[3]
        return {path: 2 * held / (size_ + prose[0]) * named + _DEEPER * deep for path, (held, size_, deep, named) in found.items()}

    def text(self, path: str) -> str:
        """The blocks within the elements of that path, joined by line feeds."""
        within = [False] * len(self.tag)
        for i in range(len(self.tag)):
            within[i] = self.path[i] == path or i > 0 and within[self.parent[i]]
        return "\n".join(text for element, text, _ in self.blocks if within[element])


def parsed(source: str | None) -> Page:
    """The page; if all its text is within forms, those count as containers."""
    page = Page(source or "")
    return page if page.blocks else Page(source or "", forms=False)


def _best(scores: dict[str, float]) -> str:
    return max(scores, key=lambda path: (scores[path], path)) if scores else "body"


def votes(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path, votes): for how many pages of a host each path is the best container; pages without prose do not vote."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "html"):
                best = [_best(s) if (s := parsed(p).scores()) else None for p in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.string())], names=["host", "path"])

    rows = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(vote, "host string, path string").where("path is not null").groupBy("host", "path").agg(F.count("*").alias("votes"))


def winners(counted: DataFrame, share: float = SHARE) -> DataFrame:
    """(host, paths): a host's winning paths with their share of the votes; the first one, and others from `share` on."""
    ballot = F.struct(F.col("votes"), F.col("path"))
    by_host = counted.groupBy("host").agg(F.sum("votes").alias("all"), F.max(ballot)["path"].alias("first"))
    won = counted.join(by_host, "host").where((F.col("path") == F.col("first")) | (F.col("votes") >= F.lit(share) * F.col("all")))
    return won.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("path", (F.col("votes") / F.col("all")).alias("share")))).alias("paths"))


def chosen(scores: dict[str, float], paths: dict[str, float]) -> str:
    """Of the winning paths that the page has, the best by its score and the root of its share; else the page's own best."""
    both = {path: scores[path] * share**0.5 for path, share in paths.items() if path in scores}
    return _best(both or scores)


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", share: float = SHARE) -> DataFrame:
    """One row per row of pages: id_col, url_col, text, n_chars (code points), path (of the container).

    A block is what stands between the starts and ends of block elements; white
    space within one, line breaks included, is one blank, character references
    are decoded, and blocks are joined by line feeds in page order. A null or
    empty page, and one without text, has an empty text. Pages without a host in
    their URL (null ones too) are one host with an empty name. Rows that repeat
    are returned each and vote each; no rows give no rows; other columns are not
    read.
    """
    kind = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}
    won = checkpointed(winners(votes(pages, url_col, html_col), share))
    size = won.agg(F.sum(F.length("host") + F.aggregate("paths", F.lit(16).cast("long"), lambda n, p: n + F.length(p["path"]) + 32))).first()[0] or 0
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), F.col(html_col).cast("string").alias("html"))
    rows = rows.join(F.broadcast(won) if size <= BROADCAST_BYTES else won, "host", "left").select("id", "url", "paths", "html")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "html"):
                texts, paths = [], []
                for won, source in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                    page = parsed(source)
                    paths.append(chosen(page.scores(), {p["path"]: p["share"] for p in won or []}))
                    texts.append(page.text(paths[-1]))
                sizes = pa.array([len(t) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), sizes, pa.array(paths, pa.string())], names=[id_col, url_col, "text", "n_chars", "path"])

    return rows.mapInArrow(extract, f"`{id_col}` {kind[id_col]}, `{url_col}` {kind[url_col]}, text string, n_chars long, path string")
