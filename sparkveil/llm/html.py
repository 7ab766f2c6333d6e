"""Main text of web pages: markup rules, and removal of subtrees that recur over a host."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: A subtree is a template of its host when this many pages hold it, whatever the size of the host.
LEAST_PAGES = 10
#: A subtree is content, however often it recurs, if on more than half of its pages it has more than
#: this share of the text.
MOST_TEXT = 0.5
#: Templates that are broadcast at most; more are joined with the subtrees of each page.
BROADCAST_ROWS = 100_000

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that are never part of an article.
_DROP = frozenset(
    "head script style noscript template iframe object embed applet canvas svg math nav footer aside form button select datalist textarea input dialog menu search xmp noembed noframes".split()
)
_DROP_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
#: Words of a class or id that mark a part as something else than the article.
_DROP_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion sidebar sidebars menu navbar nav navigation breadcrumb breadcrumbs cookie cookies consent "
    "gdpr notice notices popup modal overlay newsletter subscribe signup login comment comments disqus discussion replies respond share sharing social related recommended "
    "recommendations widget widgets toolbar pagination pager masthead colophon skip".split()
)
_OUTSIDE_WORDS = frozenset("header footer banner top bottom".split())
_ARTICLE_WORDS = frozenset("comment comments reply ad advert promo teaser related".split())
#: Inside an article these are prose, which many pages may quote; only other parts can be templates.
_PROSE = frozenset("article main body html p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th tr tbody figcaption".split())
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select", "datalist")}
_CLOSES_P = _BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup", "legend", "body", "html"}

_TAG = re.compile(r"""<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+>|[^>]*(?:>|\Z))""", re.S)
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_WORDS = re.compile(r"[a-z0-9]+")


class Page:
    """Flat tree of a page: elements in document order, and its text and block events."""

    def __init__(self, html: str):
        self.tags, self.parents, self.attrs = ["#root"], [0], [{}]
        self.events: list[tuple[int, str | None]] = []  # (element, text) or (element, None) at a block edge
        self.ruled_out: list[bool] | None = None
        self.open: dict[str, list[int]] = {}  # places in the stack of each open tag
        self._read(html)

    def _read(self, html: str) -> None:
        stack, at, n = [0], 0, len(html)
        tags, parents, attrs, events = self.tags, self.parents, self.attrs, self.events
        while at < n:
            m = _TAG.search(html, at)
            if m is None:
                events.append((stack[-1], html[at:]))
                return
            if m.start() > at:
                events.append((stack[-1], html[at : m.start()]))
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                self._close(stack, tag)
                continue
            if tag in _CLOSES_P:
                self._close(stack, "p", ("button", "td", "th", "table", "object"))
            for other in _CLOSES.get(tag, ()):
                self._close(stack, other, _SCOPE[tag])
            rest = m[3].rstrip(">")
            tags.append(tag)
            parents.append(stack[-1])
            attrs.append({k.lower(): unescape(a or b or c) for k, a, b, c in _ATTR.findall(rest)} if "=" in rest or "hidden" in rest else {})
            me = len(tags) - 1
            if tag in _BLOCK:
                events.append((me, None))
            elif tag == "br":
                events.append((stack[-1], " "))
            if tag in _VOID:
                continue
            if tag in _RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(html, at)
                stop = end.start() if end else n
                if tag == "textarea" or tag == "title":
                    events.append((me, html[at:stop]))
                close = html.find(">", stop)
                at = n if close < 0 else close + 1
                continue
            self.open.setdefault(tag, []).append(len(stack))
            stack.append(me)

    def _close(self, stack: list[int], tag: str, scope: tuple[str, ...] = ()) -> None:
        """Close the innermost open ``tag`` and all within it, unless an element of its scope lies between.

        The places of open tags are known, so this costs no more than the elements that it closes.
        """
        places = self.open.get(tag)
        if not places:
            return
        k = places[-1]
        for other in scope if tag in _BLOCK else (*scope, "article", "main", "body", "table"):
            if other != tag and (found := self.open.get(other)) and found[-1] > k:
                return
        tags = self.tags
        if any(tags[i] in _BLOCK for i in stack[k:]):
            self.events.append((stack[k - 1], None))
        for i in stack[k:]:
            self.open[tags[i]].pop()
        del stack[k:]

    def removed(self) -> list[bool]:
        """Which elements the markup itself rules out, with all below them; worked out once."""
        if self.ruled_out is not None:
            return self.ruled_out
        out, inside = [False] * len(self.tags), [False] * len(self.tags)
        for i in range(1, len(self.tags)):
            tag, up, a = self.tags[i], self.parents[i], self.attrs[i]
            inside[i] = inside[up] or tag in ("article", "main")
            out[i] = out[up] or self._unwanted(tag, a, inside[up])
        self.inside, self.ruled_out = inside, out
        return out

    @staticmethod
    def _unwanted(tag: str, a: dict[str, str], inside: bool) -> bool:
        if tag in _DROP or (tag == "header" and not inside):
            return True
        if not a:
            return False
        names = _WORDS.findall(f"{a.get('class', '')} {a.get('id', '')}".lower())
        if tag in ("html", "body", "main"):
            return False
        if tag == "article":
            return any(w in _ARTICLE_WORDS for w in names)
        if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or a.get("role", "").lower() in _DROP_ROLES:
            return True
        if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", ""), re.I):
            return True
        return any(w in _DROP_WORDS or (not inside and w in _OUTSIDE_WORDS) for w in names)

    def content(self, removed: list[bool]) -> list[bool]:
        """Elements under the outermost articles; without any, under main; without that, all."""
        for names in (("article",), ("main",)):
            if any(t in names and not r for t, r in zip(self.tags, removed, strict=True)):
                out = [False] * len(self.tags)
                for i in range(1, len(self.tags)):
                    out[i] = out[self.parents[i]] or self.tags[i] in names
                return out
        return [True] * len(self.tags)

    def subtrees(self) -> list[tuple[int, int, bool]]:
        """(element, hash, whether it is over MOST_TEXT of the page) of the block subtrees that may be templates.

        Hashes cover whole subtrees, before any rule of the markup is asked. Only the last value looks at
        the rules: what they take out anyway is no content, however much of the page it is.
        """
        n = len(self.tags)
        ruled_out = self.removed()
        parts: list[list[bytes]] = [[f"{t}|{a.get('class', '')}|{a.get('id', '')}".encode()] for t, a in zip(self.tags, self.attrs, strict=True)]
        size, shown = [0] * n, [0] * n
        for k, text in self.events:
            if text is not None:
                words = " ".join(text.split())
                if words:
                    parts[k].append(words.encode("utf-8", "surrogatepass"))
                    size[k] += len(words)
                    shown[k] += 0 if ruled_out[k] else len(words)
        hashes = [0] * n
        for i in range(n - 1, 0, -1):
            hashes[i] = xxhash.xxh64_intdigest(b"\x00".join(parts[i]), 0) - (1 << 63)
            up = self.parents[i]
            parts[up].append(hashes[i].to_bytes(8, "little", signed=True))
            size[up] += size[i]
            shown[up] += shown[i]
        return [
            (i, hashes[i], shown[i] > MOST_TEXT * shown[0])
            for i in range(1, n)
            if self.tags[i] in _BLOCK and size[i] and not (self.inside[i] and self.tags[i] in _PROSE)
        ]

    def text(self, ruled_out: list[bool], templates=frozenset()) -> str:
        """The main text: subtrees that are templates go first, then what the markup rules out."""
        out = [False] * len(self.tags)
        if templates:
            for i, h, _ in self.subtrees():
                out[i] = h in templates
        removed = [a or b for a, b in zip(out, ruled_out, strict=True)]
        for i in range(1, len(removed)):
            removed[i] = removed[i] or removed[self.parents[i]]
        keep = self.content(removed)
        blocks: list[str] = []
        line: list[str] = []
        for k, text in self.events:
            if text is None:
                if line:
                    blocks.append(" ".join("".join(line).split()))
                    line = []
            elif keep[k] and not removed[k]:
                line.append(unescape(text) if "&" in text else text)
        blocks.append(" ".join("".join(line).split()))
        return "\n".join(b for b in blocks if b)


def _host(url: Column) -> Column:
    return F.xxhash64(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)))


def host_templates(rows: DataFrame) -> DataFrame:
    """(host, hash): subtrees that recur across many pages of a host; ``rows`` (host, html).

    A page counts once per subtree, and counts are partly summed before they are shuffled. A host can
    have any number of templates.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                hosts, hashes, wide = [], [], []
                for host, html in zip(batch.column(0)[lo : lo + 512].to_pylist(), batch.column(1)[lo : lo + 512], strict=True):
                    page = Page(html.as_py() or "")
                    found: dict[int, bool] = {}
                    for _, h, most in page.subtrees():
                        found[h] = found.get(h, False) or most
                    hosts += [host] * len(found)
                    hashes += found
                    wide += found.values()
                yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.int64()), pa.array(hashes, pa.int64()), pa.array(wide, pa.bool_())], names=["host", "hash", "wide"])

    counts = rows.select("host", "html").mapInArrow(run, "host long, hash long, wide boolean").groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n"), F.count_if("wide").alias("wide"))
    return counts.where((F.col("n") >= LEAST_PAGES) & (F.col("wide") * 2 <= F.col("n"))).select("host", "hash")


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, host, hash) of the subtrees of pages (row, host, html)."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            out: tuple[list, list, list] = ([], [], [])
            for row, host, html in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), strict=True):
                page = Page(html.as_py() or "")
                for h in {h for _, h, _ in page.subtrees()}:
                    for values, value in zip(out, (row, host, h), strict=True):
                        values.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["row", "host", "hash"])


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(page_id, url, text, n_chars): one row per row of ``pages``.

    A page loses the subtrees that recur over its host, hashed before any rule is asked; of what is left,
    the markup rules take out what names itself as something else than the article. Inside an article the
    paragraphs, headings and list items are no templates, since articles quote each other. Null and empty pages have an empty text; pages
    without a host (null or odd urls) form one host; repeated rows count as pages of their own; other
    columns are ignored. The templates are broadcast up to ``broadcast_rows`` rows; beyond that
    each page is joined with those it holds, so no row carries all templates of a hot host.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), _host(F.col(url_col)).alias("host"))
    templates = cut(host_templates(rows), "templates")
    first = templates.limit(broadcast_rows + 1).collect()
    schema = "page_id long, url string, text string, n_chars long"
    if len(first) <= broadcast_rows:
        by_host: dict[int, set[int]] = {}
        for r in first:
            by_host.setdefault(r.host, set()).add(r["hash"])
        known = pages.sparkSession.sparkContext.broadcast(by_host)
        source = rows.select("page_id", "url", "html", "host", F.lit(None).cast("array<long>").alias("templates"))
    else:
        known = None
        rows = cut(rows.withColumn("row", F.monotonically_increasing_id()), "pages")
        held = rows.select("row", "host", "html").mapInArrow(_held, "row long, host long, hash long")
        listed = held.join(templates, ["host", "hash"], "left_semi").groupBy("row").agg(F.collect_list("hash").alias("templates"))
        source = rows.join(listed, "row", "left").select("page_id", "url", "html", "host", "templates")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = []
                for html, host, own in zip(part.column(2), part.column(3).to_pylist(), part.column(4).to_pylist(), strict=True):
                    page = Page(html.as_py() or "")
                    texts.append(page.text(page.removed(), known.value.get(host, frozenset()) if known is not None else frozenset(own or ())))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"]
                )

    return source.mapInArrow(run, schema)
