"""Main text of web pages by wrappers inferred per host.

A page becomes a stream of block tags and texts; tags of one open element
bracket its tokens, so the stream is a tree. A wrapper is a union-free regular
expression over such streams: elements and text slots, each of which may be
optional or repeated, and repeated groups of several. Pages of a host are
aligned one after another with the wrapper so far: equal neighbours fold into
repeated items, tokens of one side only become optional, texts that differ
turn a fixed text into a slot. Tasks fold their pages into one wrapper per
host, wrappers of a host are aligned with each other after a shuffle, and each
page is then read through its host's wrapper.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from legation.llm.common import chunks, cut, text_of

HOSTS_HELD = 500  # wrappers a task holds before it emits them
SALTS = 16
BROADCAST_BYTES = 32 << 20
FEWEST_PAGES = 3  # pages that must agree before a text counts as the host's own

# Element names of the HTML standard by role, and words of class and id names.
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q ruby rp rt s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
DROPPED = set("script style noscript template iframe object svg canvas audio video select button textarea datalist title".split())
VOID = set("area base col embed hr img input link meta param source track wbr br".split())
ASIDE = set("nav footer aside form dialog menu header".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
ASIDE_WORDS = set(
    "ad ads advert adverts advertisement advertising adsense alert banner breadcrumb breadcrumbs comment comments consent cookie "
    "cookies disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification overlay "
    "pager pagination paywall popup promo promotion promoted recommended related replies respond search share sharing sidebar "
    "signup social sponsor sponsored subscribe subscription toolbar widget".split()
)
OTHERS_WORDS = set("comment comments disqus recommended related replies respond".split())  # their articles are other people's
ASIDE_ROLES = set("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
MAIN_WORDS = ("article", "post", "entry", "story", "content")
CLOSES = {  # an opening tag ends these open elements, up to the element they belong to
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>|[^>]*(?:>|\Z))|<[!?][^>]*(?:>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Text:
    """A run of text between block tags."""

    __slots__ = ("parts", "linked", "keep")

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.linked = 0
        self.keep = False

    def words(self) -> str:
        return " ".join("".join(self.parts).split())


class Element:
    __slots__ = ("tag", "sign", "names", "role", "items", "holds_main")

    def __init__(self, tag: str, attributes: str = "") -> None:
        self.tag, self.items, self.holds_main = tag, [], False
        found = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)} if "=" in attributes else {}
        label = " ".join(found.get(k, "") for k in ("class", "id"))
        self.names = {w.lower() for w in _NAME_WORDS.findall(label)}
        self.role = found.get("role", "").lower()
        self.sign = tag + "".join(f".{w}" for w in sorted(self.names)) + (f"@{self.role}" if self.role else "")
        if found.get("itemprop", "").lower() == "articlebody":
            self.role = "main"

    def is_main(self) -> bool:
        return self.tag in ("article", "main") or self.role == "main"

    def is_aside(self, in_main: bool = False) -> bool:
        """Menus, headers, footers, sidebars, notices, adverts, forms, comments; never what holds the page's article."""
        if (self.holds_main and not in_main) or self.tag in ("html", "body", "main"):
            return False
        return self.tag in ASIDE or self.role in ASIDE_ROLES or (not self.names.isdisjoint(ASIDE_WORDS) and self.role != "main")


def parse(page: str) -> Element:
    """The tree of block elements and text runs; inline tags only mark links."""
    root = Element("#page")
    stack, at, links = [root], 0, 0
    hidden: list[str] = []  # open inline elements that are no part of the text

    def put(text: str) -> None:
        if hidden or not text:
            return
        items = stack[-1].items
        if not items or not isinstance(items[-1], Text):
            if text.isspace():
                return
            items.append(Text())
        items[-1].parts.append(text)
        if links:
            items[-1].linked += len(text)

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            done = stack.pop()
            # An aside's own article (a comment, a teaser) is not the page's.
            done.holds_main &= done.names.isdisjoint(OTHERS_WORDS)
            stack[-1].holds_main |= done.holds_main or (done.is_main() and not done.is_aside())

    while at < len(page):
        start = page.find("<", at)
        token = _TOKEN.match(page, start) if start >= 0 else None
        if token is None:
            stop = len(page) if start < 0 else start + 1
            put(html.unescape(page[at:stop]))
            at = stop
            continue
        put(html.unescape(page[at:start]))
        at, tag = token.end(), token["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if token["close"]:
            if tag in INLINE:
                links -= tag == "a" and links > 0
                if hidden and hidden[-1] == tag:
                    hidden.pop()
                continue
            hidden.clear()
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    pop_to(depth)
                    links = 0
                    break
            continue
        if tag == "br":
            put(" ")
        elif tag in DROPPED:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif tag in INLINE:
            if tag == "a":
                links = 1
            if tag not in VOID and (hidden or ("=" in token["rest"] and Element(tag, token["rest"]).is_aside())):
                hidden.append(tag)
        elif tag not in VOID or tag == "hr":
            hidden.clear()
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == "p":
                    pop_to(depth)
                    break
                if stack[depth].tag not in HEADINGS:
                    break
            ended, within = CLOSES.get(tag, ((), ()))
            for depth in range(len(stack) - 1, 0, -1) if ended else ():
                if stack[depth].tag in within:
                    break
                if stack[depth].tag in ended:
                    pop_to(depth)
            child = Element(tag, token["rest"])
            stack[-1].items.append(child)
            if tag != "hr" and not (tag not in ("div", "section", "p", "li") and token["rest"].endswith("/>")):
                stack.append(child)
    pop_to(1)
    return root


# -- wrappers: items of a union-free expression

TEXT, ELEMENT, GROUP = range(3)


class Item:
    """A text slot, an element or a group of items; ``optional`` and ``repeated`` are its marks."""

    __slots__ = ("kind", "sign", "items", "optional", "repeated", "fixed", "chars", "linked", "texts")

    def __init__(self, kind: int, sign: str, items: list[Item] = ()) -> None:
        self.kind, self.sign, self.items = kind, sign, list(items)
        self.optional = self.repeated = False
        self.fixed: str | None = None  # digest of the text if all pages agree on it
        self.chars = self.linked = 0
        self.texts: list[Text] = []

    def pack(self) -> list:
        return [self.kind, self.sign, [x.pack() for x in self.items], self.optional, self.repeated, self.fixed, self.chars, self.linked]

    @staticmethod
    def unpack(row: list) -> Item:
        item = Item(row[0], row[1], [Item.unpack(x) for x in row[2]])
        item.optional, item.repeated, item.fixed, item.chars, item.linked = row[3:]
        return item

    def expression(self) -> str:
        inner = " ".join(x.expression() for x in self.items)
        body = {TEXT: "#text" if self.fixed is None else "text", ELEMENT: f"<{self.sign}> {inner} </>", GROUP: f"( {inner} )"}[self.kind]
        return body + ("+" if self.repeated else "") + ("?" if self.optional else "")


def as_items(element: Element) -> list[Item]:
    """The items of one page's element, equal neighbours folded."""
    out = []
    for x in element.items:
        if isinstance(x, Text):
            words = x.words()
            if words:
                item = Item(TEXT, "#")
                item.fixed = hashlib.md5(words.encode("utf-8", "surrogatepass")).hexdigest()[:16]
                item.chars, item.linked, item.texts = len(words), x.linked, [x]
                out.append(item)
        else:
            out.append(Item(ELEMENT, x.sign, as_items(x)))
    return fold(out)


def fold(items: list[Item]) -> list[Item]:
    """Fold runs of a repeated item, then of repeated sequences of several items.

    A fixed text that follows blocks of its own kind folds into their slot and
    is then not told from them.
    """
    size = 1
    while 2 * size <= len(items):
        out, at = [], 0
        signs = [x.sign for x in items]
        while at < len(items):
            more = at + size
            while signs[more : more + size] == signs[at : at + size] and more + size <= len(items):
                more += size
            if more == at + size:
                out.append(items[at])
                at += 1
                continue
            parts = [items[i : i + size] for i in range(at, more, size)]
            unit = parts[0]
            for part in parts[1:]:
                unit = [join(a, b) for a, b in zip(unit, part)]
            whole = unit[0] if size == 1 else Item(GROUP, "(" + " ".join(x.sign for x in unit) + ")", unit)
            whole.repeated = True
            out.append(whole)
            at = more
        items, size = out, size + 1
    return items


def join(a: Item, b: Item) -> Item:
    """The union-free expression of two items with one sign."""
    out = Item(a.kind, a.sign, align(a.items, b.items) if a.items or b.items else ())
    out.optional, out.repeated = a.optional or b.optional, a.repeated or b.repeated
    out.fixed = a.fixed if a.fixed == b.fixed else None
    out.chars, out.linked, out.texts = a.chars + b.chars, a.linked + b.linked, a.texts + b.texts
    return out


def grouped(items: list[Item], others: list[Item]) -> list[Item]:
    """``items`` with a single run of a group that ``others`` repeat put into that group."""
    for other in others:
        if other.kind != GROUP or any(x.sign == other.sign for x in items):
            continue
        want = [x.sign for x in other.items]
        for at in range(len(items) - len(want) + 1):
            if [x.sign for x in items[at : at + len(want)]] == want:
                items = [*items[:at], Item(GROUP, other.sign, items[at : at + len(want)]), *items[at + len(want) :]]
                break
    return items


def align(a: list[Item], b: list[Item]) -> list[Item]:
    """One expression for two item lists: common items joined, the others optional."""
    a, b = grouped(a, b), grouped(b, a)
    out, i, j = [], 0, 0
    for at, to, n in SequenceMatcher(None, [x.sign for x in a], [x.sign for x in b], autojunk=False).get_matching_blocks():
        for x in (*a[i:at], *b[j:to]):
            x.optional = True
            out.append(x)
        out += [join(x, y) for x, y in zip(a[at : at + n], b[to : to + n])]
        i, j = at + n, to + n
    return out


def matched(wrapper: list[Item], page: list[Item]) -> Iterator[tuple[Item, Item]]:
    """Pairs of the wrapper's and the page's text slots."""
    wrapper, page = grouped(wrapper, page), grouped(page, wrapper)
    blocks = SequenceMatcher(None, [x.sign for x in wrapper], [x.sign for x in page], autojunk=False).get_matching_blocks()
    for at, to, n in blocks:
        for x, y in zip(wrapper[at : at + n], page[to : to + n]):
            if x.kind == TEXT:
                yield x, y
            else:
                yield from matched(x.items, y.items)


# -- reading a page through its wrapper


def slots(items: list[Item]) -> Iterator[Item]:
    for x in items:
        if x.kind == TEXT:
            yield x
        else:
            yield from slots(x.items)


def content(element: Element, in_main: bool, found: list[Text], mains: list[list[Text]]) -> None:
    """Texts outside asides; those of each outermost main element also form a list of ``mains``."""
    for x in element.items:
        if isinstance(x, Text):
            found.append(x)
        elif in_main and (x.tag == "header" or "header" in x.names) and not x.holds_main:
            headings(x, found)
        elif not x.is_aside(in_main):
            if x.is_main() and not in_main:
                mine: list[Text] = []
                content(x, True, mine, [])
                # A main element around an article is only its frame.
                inner: list[list[Text]] = []
                if x.tag != "article" and x.holds_main:
                    content(x, False, [], inner)
                mains += inner or [mine]
                found += mine
            else:
                content(x, in_main, found, mains)


def headings(element: Element, found: list[Text]) -> None:
    for x in element.items:
        if isinstance(x, Element):
            if x.tag in HEADINGS:
                content(x, True, found, [])
            else:
                headings(x, found)


def named_main(element: Element, word: str) -> Iterator[Element]:
    for x in element.items:
        if isinstance(x, Element) and not x.is_aside():
            if word in x.names:
                yield x
            else:
                yield from named_main(x, word)


def read(root: Element, wrapper: list[Item], pages: int) -> str:
    """The main text of a page, by its article, its named main block, or the wrapper's slots."""
    found: list[Text] = []
    mains: list[list[Text]] = []
    content(root, False, found, mains)
    if mains:
        found = [t for texts in mains for t in texts]
    else:
        found = through_slots(root, found, wrapper, pages)
        total = sum(len(t.words()) for t in found)
        for word in MAIN_WORDS:
            named: list[Text] = []
            for x in named_main(root, word):
                content(x, True, named, [])
            if named and 2 * sum(len(t.words()) for t in named) >= total:
                found = named
                break
    blocks = (t.words() for t in found)
    return "\n\n".join(b for b in blocks if b)


def through_slots(root: Element, found: list[Text], wrapper: list[Item], pages: int) -> list[Text]:
    """Texts that vary between the host's pages and are not mostly links."""
    varied = any(s.fixed is None for s in slots(wrapper))
    for slot, mine in matched(wrapper, as_items(root)):
        own = slot.fixed is not None and varied and pages >= FEWEST_PAGES
        for text in mine.texts:
            text.keep = not own and 2 * slot.linked <= slot.chars
    return [t for t in found if t.keep]


# -- Spark


def host_of(url: Column) -> Column:
    """The lower-cased host of a URL; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/?#:]*)", 1), F.lit("")))


_WRAPPER = "host string, pages long, wrapper string"


def _emit(held: dict[str, tuple[int, list[Item]]]) -> pa.RecordBatch:
    rows = [(host, pages, json.dumps([x.pack() for x in items], separators=(",", ":"))) for host, (pages, items) in held.items()]
    columns = list(zip(*rows)) or [[], [], []]
    kinds = (pa.string(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["host", "pages", "wrapper"])


def _page_wrappers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Wrappers of the hosts of one task's pages."""
    held: dict[str, tuple[int, list[Item]]] = {}
    for batch in chunks(batches, "html"):
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            pages, items = held.get(host, (0, None))
            mine = as_items(parse(page))
            for x in slots(mine):
                x.texts = []
            held[host] = pages + 1, mine if items is None else align(items, mine)
            if len(held) > HOSTS_HELD:
                yield _emit(held)
                held = {}
    if held:
        yield _emit(held)


def _joined_wrappers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One wrapper per host from rows sorted by host; holds one host at a time."""
    held: dict[str, tuple[int, list[Item]]] = {}
    for batch in chunks(batches, "wrapper"):
        for host, pages, packed in zip(*(c.to_pylist() for c in batch.columns)):
            items = [Item.unpack(x) for x in json.loads(packed)]
            if host in held:
                held[host] = held[host][0] + pages, align(held[host][1], items)
            else:
                if held:
                    yield _emit(held)
                held = {host: (pages, items)}
    if held:
        yield _emit(held)


def host_wrappers(pages: DataFrame) -> DataFrame:
    """``host, pages, wrapper`` of every host from ``host, html`` rows.

    Tasks first fold their own pages, so a host with a third of all pages
    reaches the shuffle as one row per task; those are joined in two steps.
    """
    parts = pages.mapInArrow(_page_wrappers, _WRAPPER).withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)))
    some = parts.repartition("host", "salt").sortWithinPartitions("host", "salt", "wrapper").drop("salt").mapInArrow(_joined_wrappers, _WRAPPER)
    return some.repartition("host").sortWithinPartitions("host", "wrapper").mapInArrow(_joined_wrappers, _WRAPPER)


def _reader(columns: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, items = None, []
        for batch in chunks(batches, "__html"):
            texts = []
            html_, wrappers, counts = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("__html", "__wrapper", "__pages"))
            for page, wrapper, pages in zip(html_, wrappers, counts):
                if wrapper != packed:
                    packed, items = wrapper, [Item.unpack(x) for x in json.loads(wrapper)]
                texts.append(read(parse(page), items, pages))
            kept = [batch.column(batch.schema.get_field_index(c)) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string())], names=[*columns, "text"])

    return run


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: ``<id>, <url>, text, n_chars`` (code points).

    The text is the article without menus, headers, footers, sidebars, notices,
    adverts, forms, scripts, styles and reader comments: the article or main
    elements where a page has them, else a block named as one, else the texts
    that the host's wrapper shows to vary from page to page. Character
    references are decoded, white space inside a block is one space, blocks
    are joined by an empty line. A page without main text, or null, has an
    empty text. Pages without a host share one wrapper. Repeated rows and null
    ids are rows like others; an empty table gives no rows; other columns are
    ignored.
    """
    source = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), text_of(html_col).alias("__html"))
    source = source.withColumn("__host", host_of(F.col("url")))
    wrappers = cut(host_wrappers(source.select(F.col("__host").alias("host"), F.col("__html").alias("html"))))
    wrappers = wrappers.select(F.col("host").alias("__host"), F.col("pages").alias("__pages"), F.col("wrapper").alias("__wrapper"))
    size = wrappers.agg(F.sum(F.octet_length("__wrapper") + F.octet_length("__host"))).first()[0] or 0
    joined = source.join(F.broadcast(wrappers) if size <= BROADCAST_BYTES else wrappers, "__host").drop("__host")
    kind = source.schema["id"].dataType.simpleString()
    read_ = joined.mapInArrow(_reader(["id", "url"]), f"id {kind}, url string, text string")
    return read_.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.char_length("text").cast("long").alias("n_chars"))
