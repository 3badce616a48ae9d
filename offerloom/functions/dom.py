"""A page as data: its texts and its elements as arrays, which rules read with column expressions.

``parse_page`` gives a struct of

* ``pieces``: the stripped texts outside scripts and styles, in order;
* ``elements``: tag, at (number in document order), until (the number behind the last one inside), parent, first and stop (the
  pieces inside are those from ``first`` up to ``stop``), attrs, cards (the numbers of the cards around it, outermost first);
* ``scripts``: the bodies of structured-data scripts;
* ``euros``: for each piece how many before it hold a euro sign, and at the end how many do in all.

A card is an element of one of the classes that listings use for a product. The parser's stack of open elements tells which cards
are around an element, so nothing is searched for later.

Everything has the size of the page: an element doesn't repeat its texts.
"""

from __future__ import annotations

import html.parser
import re
from array import array
from collections.abc import Callable
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

_SILENT = {"script", "style", "noscript", "template"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Elements that end where the next of their kind begins.
_ROWS = ({"li"}, {"p"}, {"td", "th"}, {"tr"}, {"dt", "dd"}, {"option"})
_INTEGERS = T.ArrayType(T.IntegerType())
_TEXTS = T.ArrayType(T.StringType())
_ELEMENT = T.StructType([T.StructField("tag", T.StringType()), *(T.StructField(c, T.IntegerType()) for c in ("at", "until", "parent", "first", "stop")), T.StructField("attrs", T.MapType(T.StringType(), T.StringType())), T.StructField("cards", _INTEGERS)])
PAGE = T.StructType([T.StructField("pieces", _TEXTS), T.StructField("elements", T.ArrayType(_ELEMENT)), T.StructField("scripts", _TEXTS), T.StructField("euros", _INTEGERS)])
TEXTS = T.StructType([T.StructField("pieces", _TEXTS), T.StructField("heading", T.StringType())])
#: Classes of a listing's cards.
CARD_CLASSES = ("product-item", "product-item-info", "item")


class _Builder(HTMLParser):
    def __init__(self, card_classes: frozenset[str] = frozenset()):
        super().__init__(convert_charrefs=True)
        self.card_classes = card_classes
        self.pieces, self.elements, self.scripts, self.open, self.silent, self.cards = [], [], [], [], None, []

    def handle_starttag(self, tag, attrs):
        for kind in _ROWS:
            if tag in kind and self.open and self.elements[self.open[-1]]["tag"] in kind:
                self._close(1)
        known = {k: v or "" for k, v in reversed(attrs)}
        at, here = len(self.elements), len(self.pieces)
        self.elements.append({"tag": tag, "at": at, "until": at + 1, "parent": self.open[-1] if self.open else -1, "first": here, "stop": here, "attrs": known, "cards": self.cards[:]})
        if tag in _VOID:
            return
        self.open.append(at)
        if not self.card_classes.isdisjoint(known.get("class", "").split()):
            self.cards.append(at)
        if tag in _SILENT and self.silent is None:
            self.silent = at
            if tag == "script" and "ld+json" in known.get("type", "").lower():
                self.scripts.append("")

    def _close(self, n):
        for _ in range(n):
            e = self.elements[self.open.pop()]
            e["until"], e["stop"] = len(self.elements), len(self.pieces)
            if e["at"] == self.silent:
                self.silent = None
            if self.cards and e["at"] == self.cards[-1]:
                self.cards.pop()

    def handle_endtag(self, tag):
        for n, at in enumerate(reversed(self.open), 1):
            if self.elements[at]["tag"] == tag:
                return self._close(n)

    def handle_data(self, data):
        if self.silent is None:
            if text := data.strip():
                self.pieces.append(text)
        elif self.scripts and "ld+json" in self.elements[self.silent]["attrs"].get("type", "").lower():
            self.scripts[-1] += data

    def close(self):
        super().close()
        self._close(len(self.open))


# Plain pages are taken apart by one expression, which gives what the parser gives; whatever it doesn't know sends a page to the parser.
_WS = r"[ \t\n\r\f]"
_NAME = r"[a-z][a-z0-9]*"
_ATTR = rf"""{_WS}+[a-z_:@][-a-z0-9_:.]*+(?:{_WS}*={_WS}*(?:"[^"]*"|'[^']*'|[!#$%&()*+,\-.0-9:;?@A-Z\[\\\]^_a-z{{|}}~]+(?=[ \t\n\r\f>])))?+"""
_TOKEN = rf"""<(?:(script|style)((?:{_ATTR})*+){_WS}*>(.*?)</\1>|/({_NAME}){_WS}*>|(?!(?:script|style)(?![a-z0-9]))({_NAME})((?:{_ATTR})*+){_WS}*(/?)>|!doctype[^<>"'\[\]]*>|!--(?!-?>)(?:[^-]|-(?!-))*+-->)"""
_FLAGS = re.IGNORECASE | re.ASCII | re.DOTALL
_TAG = re.compile(_TOKEN, _FLAGS)
#: The same without groups, for splitting.
_SPLIT = re.compile(rf"""<(?:script(?:{_ATTR})*+{_WS}*>.*?</script>|style(?:{_ATTR})*+{_WS}*>.*?</style>|/{_NAME}{_WS}*>|(?!(?:script|style)(?![a-z0-9])){_NAME}(?:{_ATTR})*+{_WS}*/?>|!doctype[^<>"'\[\]]*>|!--(?!-?>)(?:[^-]|-(?!-))*+-->)""", _FLAGS)
_RAW = re.compile(r"<(?:script|style|!--)", _FLAGS)
_PAIR = re.compile(rf"""([a-z_:@][-a-z0-9_:.]*)(?:{_WS}*={_WS}*("[^"]*"|'[^']*'|[^ \t\n\r\f]+))?""", _FLAGS)
#: What only the parser reads: odd comments, declarations, raw elements, titles that hold tags.
_ODD = re.compile(r"<!(?!doctype|--)|<\?|</(?:script|style)[^>]|<(?:textarea|iframe|xmp|noembed|noframes|noscript|plaintext)|<title[^>]*>[^<]*<(?!/title>)|\0", _FLAGS)
_KIND = {tag: kind for kind in _ROWS for tag in kind}
_unescape_value = getattr(html.parser, "_unescape_attrvalue", unescape)


@lru_cache(maxsize=4096)
def _attributes(text: str) -> tuple[tuple[str, str], ...]:
    found = {}
    for name, value in _PAIR.findall(text):
        if value[:1] in ("'", '"'):
            value = value[1:-1]
        found.setdefault(name.lower(), _unescape_value(value) if "&" in value else value)
    return tuple(found.items())


def _plain(page: str, card_classes: frozenset[str]) -> tuple | None:
    """Pieces, scripts and the columns of a plain page's elements (tag, until, parent, first, stop, attrs, cards); None for another page.

    Numbers are kept as machine integers and equal attributes once, so a page of millions of elements stays small.
    """
    if _ODD.search(page):
        return None
    pieces, scripts, tags, attrs, cards = [], [], [], [], []
    until, parent, first, stop = array("i"), array("i"), array("i"), array("i")
    open_, in_cards, around, silent, place = [], [], (), None, 0

    def close() -> None:
        nonlocal silent, around
        at = open_.pop()
        until[at], stop[at] = len(tags), len(pieces)
        if at == silent:
            silent = None
        if in_cards and at == in_cards[-1]:
            in_cards.pop()
            around = tuple(in_cards)

    def begin(tag: str, told: tuple) -> int:
        at, here = len(tags), len(pieces)
        tags.append(tag)
        attrs.append(told)
        cards.append(around)
        until.append(at + 1)
        parent.append(open_[-1] if open_ else -1)
        first.append(here)
        stop.append(here)
        return at

    def end(tag: str) -> None:
        for n, at in enumerate(reversed(open_), 1):
            if tags[at] == tag:
                for _ in range(n):
                    close()
                return

    for m in _TAG.finditer(page):
        start = m.start()
        if start > place:
            text = page[place:start]
            if "<" in text:
                return None
            if silent is None and (text := (unescape(text) if "&" in text else text).strip()):
                pieces.append(text)
        place = m.end()
        raw, raw_told, body, ended, tag, told, alone = m.groups()
        if ended is not None:
            end(ended.lower())
        elif tag is not None:
            tag, told = tag.lower(), _attributes(told) if told else ()
            kind = _KIND.get(tag)
            if kind and open_ and tags[open_[-1]] in kind:
                close()
            at = begin(tag, told)
            if tag not in _VOID:
                open_.append(at)
                if told and card_classes and any(k == "class" and not card_classes.isdisjoint(v.split()) for k, v in told):
                    in_cards.append(at)
                    around = tuple(in_cards)
                if tag in _SILENT and silent is None:
                    if any(k == "type" and "ld+json" in v.lower() for k, v in told):
                        return None
                    silent = at
            if alone:
                end(tag)
        elif raw is not None:
            told = _attributes(raw_told) if raw_told else ()
            typed = any(k == "type" and "ld+json" in v.lower() for k, v in told)
            if typed and raw.lower() != "script":
                return None
            begin(raw.lower(), told)
            if typed and silent is None:
                scripts.append(body)
    if place < len(page):
        text = page[place:]
        if "<" in text:
            return None
        if silent is None and (text := (unescape(text) if "&" in text else text).strip()):
            pieces.append(text)
    while open_:
        close()
    return pieces, scripts, tags, until, parent, first, stop, attrs, cards


def _parsed(page: str | None, card_classes: frozenset[str]) -> tuple:
    """A page's parts as ``_plain`` gives them, by the parser where that gives none."""
    found = _plain(page or "", card_classes)
    if found is None:
        builder = _Builder(card_classes)
        builder.feed(page)
        builder.close()
        each = {c: [e[c] for e in builder.elements] for c in ("tag", "until", "parent", "first", "stop", "cards")}
        numbers = (array("i", each[c]) for c in ("until", "parent", "first", "stop"))
        found = builder.pieces, builder.scripts, each["tag"], *numbers, [tuple(e["attrs"].items()) for e in builder.elements], each["cards"]
    return found


class _Lists:
    """An Arrow list column that grows by one list at a time."""

    def __init__(self, values):
        self.values, self.ends = values, array("i", [0])

    def add(self, more) -> None:
        self.values.extend(more)
        self.ends.append(len(self.values))

    def offsets(self) -> pa.Array:
        return pa.array(memoryview(self.ends), pa.int32())

    def column(self, kind=None, inner: pa.Array | None = None) -> pa.Array:
        return pa.ListArray.from_arrays(self.offsets(), pa.array(self.values, kind) if inner is None else inner)


def page_parser(card_classes: tuple[str, ...] = CARD_CLASSES):
    """A function from a column of pages to the struct described above; a null page is empty."""
    classes = frozenset(card_classes)

    @F.arrow_udf(PAGE)
    def parse(pages: pa.Array) -> pa.Array:
        pieces, scripts, euros, tags, cards, keys = _Lists([]), _Lists([]), _Lists(array("i")), _Lists([]), _Lists(array("i")), _Lists([])
        numbers, values = {c: array("i") for c in ("at", "until", "parent", "first", "stop")}, []
        for page in pages:
            its_pieces, its_scripts, its_tags, *its_numbers, its_attrs, its_cards = _parsed(page.as_py(), classes)
            pieces.add(its_pieces)
            scripts.add(its_scripts)
            euros.add(accumulate(("€" in piece for piece in its_pieces), initial=0))
            tags.add(its_tags)
            numbers["at"].extend(range(len(its_tags)))
            for c, more in zip(("until", "parent", "first", "stop"), its_numbers):
                numbers[c].extend(more)
            for around in its_cards:
                cards.add(around)
            for told in its_attrs:
                keys.add(k for k, _ in told)
                values.extend(v for _, v in told)
        columns = {"tag": pa.array(tags.values, pa.string())} | {c: pa.array(memoryview(x), pa.int32()) for c, x in numbers.items()}
        columns["attrs"] = pa.MapArray.from_arrays(keys.offsets(), pa.array(keys.values, pa.string()), pa.array(values, pa.string()))
        columns["cards"] = cards.column(pa.int32(), pa.array(memoryview(cards.values), pa.int32()))
        elements = tags.column(inner=pa.StructArray.from_arrays(list(columns.values()), list(columns)))
        parts = [pieces.column(pa.string()), elements, scripts.column(pa.string()), euros.column(inner=pa.array(memoryview(euros.values), pa.int32()))]
        return pa.StructArray.from_arrays(parts, ["pieces", "elements", "scripts", "euros"])

    return parse


parse_page = page_parser()
#: A first heading that holds nothing but its text, and where its text ends.
_HEADING = re.compile(r"<h1(?![a-z0-9])", _FLAGS)
_BARE_HEADING = re.compile(rf"<h1((?:{_ATTR})*+){_WS}*>([^<]*)</h1{_WS}*>", _FLAGS)


def _texts(page: str | None) -> tuple[list[str], str | None]:
    """The pieces and the first heading's text of a page."""
    page = page or ""
    h1 = _HEADING.search(page)
    bare = h1 and _BARE_HEADING.match(page, h1.start())
    if not _ODD.search(page) and "<template" not in page.lower() and (bare or not h1):
        texts = _SPLIT.split(page)
        held = "".join(texts)
        if "<" not in held and (not h1 or not _RAW.search(page, 0, h1.start())):
            stripped = ((unescape(x) if "&" in x else x).strip() for x in texts) if "&" in held else map(str.strip, texts)
            return [x for x in stripped if x], bare and (unescape(bare[2]).strip() or None)
    pieces, _, tags, _, _, first, stop, *_ = _parsed(page, frozenset())
    at = tags.index("h1") if "h1" in tags else None
    return pieces, None if at is None else " ".join(pieces[first[at] : stop[at]]).strip() or None


@F.arrow_udf(TEXTS)
def parse_texts(pages: pa.Array) -> pa.Array:
    """``pieces`` and the first heading's text alone, for rules that ask for no elements."""
    pieces, headings = _Lists([]), []
    for page in pages:
        its_pieces, heading = _texts(page.as_py())
        pieces.add(its_pieces)
        headings.append(heading)
    return pa.StructArray.from_arrays([pieces.column(pa.string()), pa.array(headings, pa.string())], ["pieces", "heading"])


Test = Callable[[Column], Column]


def attr(e: Column, name: str) -> Column:
    return e["attrs"][name]


def has_class(e: Column, *names: str) -> Column:
    """Whether the element has one of the classes."""
    return F.coalesce(F.arrays_overlap(F.split(attr(e, "class"), r"\s+"), F.lit(list(names))), F.lit(False))


def is_(e: Column, name: str, *values: str) -> Column:
    """Whether the attribute has one of the values."""
    return F.coalesce(attr(e, name).isin(*values), F.lit(False))


def elements(page: Column, test: Test, inside: Column | None = None) -> Column:
    """The elements that pass, in order; with ``inside`` only those inside one of these elements."""
    return F.filter(page["elements"], (lambda e: test(e)) if inside is None else (lambda e: test(e) & F.exists(inside, lambda o: (e["at"] > o["at"]) & (e["at"] < o["until"]))))


def text_of(page: Column, e: Column, sign: str = " ") -> Column:
    """The texts inside an element, by single spaces or the given sign; null for no element."""
    return F.regexp_replace(F.array_join(F.slice(page["pieces"], e["first"] + 1, e["stop"] - e["first"]), sign), r"[ \t\x{a0}]+", " ")


def page_text(page: Column, sign: str = " ") -> Column:
    return F.regexp_replace(F.array_join(page["pieces"], sign), r"[ \t\x{a0}]+", " ")


def first(found: Column) -> Column:
    return F.get(found, F.lit(0))


def first_text(page: Column, *tests: Test) -> Column:
    """The text, or else the ``content``, of the first element that has one, by the first test that finds one."""
    value = lambda e: F.coalesce(F.nullif(F.trim(text_of(page, e)), F.lit("")), F.nullif(F.trim(attr(e, "content")), F.lit("")))
    return F.coalesce(*[value(first(elements(page, test))) for test in tests])


def meta(page: Column, name: str) -> Column:
    """The content of the first meta element with this property, name or itemprop."""
    return F.nullif(attr(first(elements(page, lambda e: (e["tag"] == "meta") & (is_(e, "property", name) | is_(e, "name", name) | is_(e, "itemprop", name)))), "content"), F.lit(""))


def heading(page: Column) -> Column:
    return F.nullif(F.trim(text_of(page, first(elements(page, lambda e: e["tag"] == "h1")))), F.lit(""))


def _without_dots(path: Column) -> Column:
    """A path with its parts ``.`` and ``..`` worked off; what would lead above the root stays there."""
    parts = F.split(path, "/")
    walked = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda kept, p: F.when(p == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))).when(p == ".", kept).otherwise(F.array_append(kept, p)),
    )
    ended = F.when(F.try_element_at(parts, F.lit(-1)).isin(".", ".."), F.array_append(walked, F.lit(""))).otherwise(walked)
    joined = F.regexp_replace(F.array_join(ended, "/"), "^(?!/)", "/")
    return F.when(F.concat(path, F.lit("/")).rlike(r"/\.{1,2}/"), joined).otherwise(path)


def absolute(base: Column, href: Column) -> Column:
    """An address on a page: without fragment, resolved against the page's address by the usual rules."""
    bare = F.regexp_replace(F.trim(href), "#.*$", "")
    root = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1)
    page = F.regexp_replace(base, r"[?#].*$", "")
    folder = F.when(F.length(page) > F.length(root), F.regexp_replace(F.substr(page, F.length(root) + 1), "[^/]*$", "")).otherwise(F.lit("/"))
    path, query = F.regexp_extract(bare, r"^([^?]*)", 1), F.regexp_extract(bare, r"(\?.*)$", 1)
    out = F.when(bare.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), bare).when(F.startswith(bare, F.lit("//")), F.concat(scheme, bare)).when(F.startswith(bare, F.lit("/")), F.concat(root, _without_dots(path), query))
    return out.when(F.startswith(bare, F.lit("?")), F.concat(page, bare)).when(bare == "", F.regexp_replace(base, "#.*$", "")).otherwise(F.concat(root, _without_dots(F.regexp_replace(F.concat(folder, path), "/{2,}", "/")), query))
