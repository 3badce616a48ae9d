"""Column builders for offer texts: cleaning, folding, references, prices, stock states, packaging, variants, addresses."""

from __future__ import annotations

import html
import html.entities
import json
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, functions as F

#: Brand spellings that mean another brand.
BRAND_ALIASES = {
    "3m espe": "solventum",
    "3m oral care": "solventum",
    "3m": "solventum",
    "dentsply": "dentsply sirona",
    "micro mega": "micro-mega",
    "micro-mega": "micro-mega",
}
#: References that stand for none.
INVALID_REFERENCES = ("", ".", "-", "--", "n/a", "na", "n.c.", "nc", "n/c", "s/o", "aucun", "divers")
#: The further placeholders of the other reference validators.
UNSTATED_REFERENCES = ("non renseigne", "non renseigné")
HEADER_REFERENCES = ("", "nom", "name", "r", "ref", "reference", "none", "null")
MARKED_REFERENCES = ("nom", "name", "r", "ref", "reference", "référence")
NO_PAGE_REFERENCE = r"(?iu)^(?:S/?O|N/?A|N\.A\.|NC|N/C|Non renseigné|Aucun|DIVERS)$"
#: Words that only code has.
CODE_WORDS = ("function", "type_id", "writerecentlyviewed", "require(", "datalayer")
#: Parts of addresses that no product page has, by the four rules for product pages.
ARCHIVE_DENIED = ("/centre-aide/", "/qui-sommes-nous/", "/catalogsearch/", "/customer/", "/checkout/", "/mentions-", "/conditions-", "/contact", "/faq", "/blog/", "/media/", "/static/")
PREFIX_DENIED = ("/brands/", "/categories/", "/sitemap", "/contact", "/account", "/cart", "/media/", "/static/")
HOST_DENIED = ("/customer/", "/checkout/", "/catalogsearch/", "/contact", "/sitemap", "/brands", "/marques", "/media/", "/static/", "/catalog/category/")
CATEGORY_DENIED = ("/nos-marques/", "/marques/", "/offre-gacd/")
SERVICE_PATHS = r"/(customer|checkout|cart|catalogsearch|search|contact|mentions|conditions|privacy|cookies|newsletter|login|account|wishlist)(/|$)"
#: How prices are read from pages: pattern, whether the last match counts, characters taken out before the comma
#: becomes a dot. Where dots are taken out, "12.50 €" is 1250.
PRICE_FORMS = {
    "thousands": (r"(\d{1,4}(?:[ .]\d{3})*[,.]\d{2})\s*€", False, "[ .]"),
    "page": (r"(\d{1,5}(?:[ .\x{202f}]\d{3})*[,.]\d{2})\s*€", False, r"[ .\x{202f}]"),
    "listing": (r"(\d{1,3}(?:[\s\x{a0}]\d{3})*(?:[,.]\d{2})?)\s*€", False, r"[ \x{a0}]"),
    "spaced": (r"((?<![0-9])[0-9][0-9\s\x{a0}\x{202f}]*+[,.][0-9]{2})\s*€", False, r"[\s\x{a0}\x{202f}]"),
    "last": (r"(\d{1,6}(?:[\s\x{a0}\x{202f}]\d{3})*[,.]\d{2})\s*€", True, r"[ \x{a0}\x{202f}]"),
    "net": (r"(?i)([0-9][0-9\s]*[,.][0-9]{2})\s*€\s*HT", False, " "),
    "offer": (r"(\d{1,5}(?:[\s\x{a0}\x{202f}]\d{3})*[,.]\d{2})\s*€", False, r"[ \x{a0}\x{202f}]"),
    "family": (r"(\d{1,5}(?:[\s\x{a0}]\d{3})*[,.]\d{2})\s*€", False, r"[ \x{a0}]"),
}
#: Words that a name is not recognised by.
STOP_WORDS = tuple("de du des la le les un une pour avec sans et en au aux par sur boite coffret lot unite dental dentaire".split())
#: The states that the shops' phrases stand for, with and without ``compat``.
STOCK_STATES = {
    "en stock": ("in_stock", "in_stock"), "sur commande": ("on_order", "on_order"), "en réapprovisionnement": ("backorder", "backorder"), "rupture": ("backorder", "backorder"),
    "arrêté": ("discontinued", "discontinued"), "indisponible": ("in_stock", "discontinued"),
}
#: Manufacturer references that are placeholders.
NO_REFERENCES = ("NONE", "NULL", "REFERENCE", "PRODUIT", "DENTALTIX")
#: Patterns of packaging hints in folded names; where a pattern has a group, the group is the hint.
PACKAGING = (
    (r"\bboite de \d+\b", 0),
    (r"\bcoffret de \d+\b", 0),
    (r"\b(\d+)\s*(?:x|×)\s*\d+(?:[.,]\d+)?\s*(?:g|mg|ml|mm)\b", 1),
    (r"\b\d+\s*(?:capsules?|seringues?|blocs?|instruments?|fraises?|limes?|aiguilles?|gants?)\b", 0),
    (r"\b\d+(?:[.,]\d+)?\s*(?:g|mg|ml)\b", 0),
)
#: Patterns of tokens that tell variants of a product apart, in upper case.
VARIANTS = (
    r"\bA[1-4](?:\.5)?\b",
    r"\bB[1-4]\b",
    r"\bC[1-4]\b",
    r"\bD[2-4]\b",
    r"\bN°?\s*\d{1,3}\b",
    r"\bISO\s*\d{2,3}\b",
    r"\b\d+(?:[.,]\d+)?\s*MM\b",
    r"\b\d+(?:[.,]\d+)?\s*ML\b",
    r"\b\d+(?:[.,]\d+)?\s*G\b",
    r"\b\d+\s*(?:PCS|PIECES|CAPSULES?|SERINGUES?|BLOCS?)\b",
    r"\b(?:XS|S|M|L|XL)\b",
)

#: The named entities of HTML, with their semicolon or, for the old ones, without.
_ENTITIES = json.dumps(html.entities.html5)
#: Names that count without a semicolon, also with letters behind them; the longest first.
_OLD_ENTITIES = "^(" + "|".join(sorted((name for name in html.entities.html5 if not name.endswith(";")), key=len, reverse=True)) + ")"
#: What the numbers 128 to 159 stand for in pages.
_WINDOWS = [html.unescape(f"&#{code};") for code in range(128, 160)]
_ENTITY = r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


def _decompositions(form: str) -> tuple[str, str, dict[int, dict[int, str]]]:
    """Of all characters those that a normal form without marks makes ASCII, in whole or in part: one to one, and by code in two levels."""
    one_from, one_to, several = [], [], {}
    for code in (*range(0xA0, 0xAC00), *range(0xF900, 0x20000), *range(0x2F800, 0x2FA20)):
        if 0x3400 <= code < 0xA000 or 0xD7A4 <= code < 0xF900:
            continue
        char = chr(code)
        plain = "".join(c for c in unicodedata.normalize(form, char) if not unicodedata.combining(c))
        if plain == char or not any(c.isascii() for c in plain):
            continue
        if len(plain) == 1:
            one_from.append(char)
            one_to.append(plain)
        else:
            several.setdefault(code >> 8, {})[code & 0xFF] = plain
    return "".join(one_from), "".join(one_to), several


def _class(codes: list[int], gap: int = 1) -> str:
    """A pattern's class of characters, as ranges; with a ``gap`` also those between near ones, which makes it shorter and wider."""
    out, at = [], 0
    while at < len(codes):
        end = at
        while end + 1 < len(codes) and codes[end + 1] - codes[end] <= gap:
            end += 1
        out.append(f"\\x{{{codes[at]:x}}}-\\x{{{codes[end]:x}}}")
        at = end + 1
    return "[" + "".join(out) + "]"


_ONE_FROM, _ONE_TO, _SEVERAL = _decompositions("NFKD")
_CANONICAL_FROM, _CANONICAL_TO, _ = _decompositions("NFD")
_SEVERAL_CODES = sorted(high << 8 | low for high, block in _SEVERAL.items() for low in block)
_MARK_CODES = [c for c in range(0x300, 0x1F000) if all(map(unicodedata.combining, unicodedata.normalize("NFKD", chr(c))))]
#: The exact classes have hundreds of ranges; the wide ones tell cheaply that a text has none of them.
_SEVERAL_CLASS, _SEVERAL_WIDE = f"({_class(_SEVERAL_CODES)})", _class(_SEVERAL_CODES, 300)
_MARKS, _MARKS_WIDE, _LATIN_MARKS = _class(_MARK_CODES), _class(_MARK_CODES, 300), r"[\x{300}-\x{36f}]"


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that it names several times, worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def filled(value: Column | str) -> Column:
    """The text, null if it is empty; worked out once also inside arrays, where ``nullif`` does so twice."""
    return bound(col(value), lambda text: F.when(text != "", text))


def unescape(value: Column | str) -> Column:
    """Named and numeric entities as characters, old names also without a semicolon; unknown ones stay as they are.

    The text is cut at its entities and each is looked up by itself, so nothing is unescaped twice.
    """
    named = F.from_json(F.lit(_ENTITIES), "map<string,string>")

    def drawn(x: Column) -> Column:
        digits = F.rtrim(x, F.lit(";"))
        code = F.when(F.lower(F.substring(x, 2, 1)) == "x", F.conv(F.substring(digits, 3, 1000), 16, 10)).otherwise(F.substring(digits, 2, 1000)).try_cast("decimal(38,0)")

        def char(c: Column) -> Column:
            odd = c.between(1, 8) | (c == 11) | c.between(14, 31) | (c == 127) | c.between(0xFDD0, 0xFDEF) | ((c % 65536) >= 65534)
            out = F.when(c.between(128, 159), F.get(F.lit(_WINDOWS), (c - 128).cast("int"))).when(c.isNull() | (c == 0) | c.between(0xD800, 0xDFFF) | (c > 0x10FFFF), "\ufffd").when(odd, "")
            return out.otherwise(F.decode(F.unhex(F.lpad(F.hex(c.cast("long")), 8, "0")), "UTF-32"))

        return bound(code, char)

    def shown(x: Column) -> Column:
        old = bound(F.regexp_extract(x, _OLD_ENTITIES, 1), lambda o: F.when(o != "", F.concat(named[o], F.substr(x, F.length(o) + 1))))
        return F.when(F.startswith(x, F.lit("#")), drawn(x)).otherwise(F.coalesce(named[x], old, F.concat(F.lit("&"), x)))

    def joined(text: Column) -> Column:
        pieces = F.arrays_zip(F.split(text, _ENTITY).alias("gap"), F.regexp_extract_all(text, F.lit(_ENTITY), F.lit(1)).alias("name"))
        return F.array_join(F.transform(pieces, lambda z: F.concat(z["gap"], F.coalesce(bound(z["name"], shown), F.lit("")))), "")

    return bound(col(value), lambda text: F.when(text.contains("&"), joined(text)).otherwise(text))


def clean(value: Column | str) -> Column:
    """White space, also no-break spaces, collapsed to single spaces; null becomes empty."""
    return F.trim(F.regexp_replace(unescape(F.coalesce(col(value), F.lit(""))), r"(?U)\s+", " "))


def plain(value: Column | str) -> Column:
    """Compatibility forms spelled out and without marks: ligatures, fractions, units, circled, wide and styled letters."""
    table = F.from_json(F.lit(json.dumps({str(high): {str(low): text for low, text in block.items()} for high, block in _SEVERAL.items()})), "map<string,map<string,string>>")

    def spelled(text: Column) -> Column:
        code = lambda c: F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("long")
        named = lambda c: bound(code(c), lambda n: table[F.shiftright(n, 8).cast("string")][(n % 256).cast("string")])
        pieces = F.arrays_zip(F.split(text, _SEVERAL_CLASS).alias("gap"), F.regexp_extract_all(text, F.lit(_SEVERAL_CLASS), F.lit(1)).alias("char"))
        joined = F.array_join(F.transform(pieces, lambda z: F.concat(z["gap"], F.when(z["char"].isNotNull(), named(z["char"])).otherwise(""))), "")
        return F.when(text.rlike(_SEVERAL_WIDE), joined).otherwise(text)

    unmarked = lambda text: F.when(text.rlike(_MARKS_WIDE), F.regexp_replace(text, _MARKS, "")).otherwise(text)
    every = lambda text: bound(bound(F.translate(text, _ONE_FROM, _ONE_TO), spelled), unmarked)
    return bound(col(value), lambda text: F.when(text.rlike(r"[^\x00-\x7f]"), every(text)).otherwise(text))


def fold(value: Column | str) -> Column:
    """Lower case without accents; everything that is no ASCII letter or digit becomes one space."""
    return F.trim(F.regexp_replace(plain(F.lower(clean(value))), "[^a-z0-9]+", " "))


def front_fold(value: Column | str) -> Column:
    """As ``fold``, by canonical forms alone and without entities: fractions, ligatures and raised digits become spaces."""
    low = F.translate(F.lower(F.coalesce(col(value), F.lit(""))), _CANONICAL_FROM, _CANONICAL_TO)
    return F.trim(F.regexp_replace(F.regexp_replace(low, _LATIN_MARKS, ""), "[^a-z0-9]+", " "))


def ascii_key(value: Column | str) -> Column:
    """As ``fold``, but characters without an ASCII form vanish instead of parting words."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(plain(F.coalesce(col(value), F.lit("")))), r"[^\x00-\x7F]", ""), "[^a-z0-9]+", " "))


def normalize_reference(value: Column | str) -> Column:
    return F.regexp_replace(F.upper(clean(value)), "[^A-Z0-9]", "")


def normalize_brand(value: Column | str) -> Column:
    def known(folded: Column) -> Column:
        out = F
        for spelled, meant in BRAND_ALIASES.items():
            out = out.when(folded == spelled, meant)
        return out.otherwise(folded)

    return bound(fold(value), known)


def group_brand(value: Column | str) -> Column:
    """The brand key of the grouping: no spaces, no trailing number."""
    key = F.replace(F.regexp_replace(front_fold(value), r"\s+\d+$", ""), F.lit(" "), F.lit(""))
    return bound(key, lambda k: F.when(k.isin("3m", "3mespe", "3moralcare"), "solventum").when(k == "dentsply", "dentsplysirona").otherwise(k))


def parse_price(value: Column | str) -> Column:
    """The first number: with a comma, dots are thousands and the comma is the decimal sign."""
    return amount(clean(value))


def amount(value: Column | str) -> Column:
    """As ``parse_price``, of a text without entities."""
    raw = F.regexp_extract(col(value), r"(\d[\d\s\x{202f}.]*(?:[,.]\d{1,2})?)", 1)
    raw = F.regexp_replace(raw, r"[\s\x{202f}]", "")
    number = lambda r: F.when(r.contains(","), F.replace(F.replace(r, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).when(r != "", r)
    return bound(raw, number).try_cast("double")


def round_cents(value: Column) -> Column:
    """A positive double rounded to two decimals by its exact binary value, ties to the even cent.

    Whether the value lies above the middle 2k + 1 of two cents, in half cents, is asked of 200 times the value without rounding: its upper
    26 bits and the rest are multiplied by themselves, both exactly, and compared with the odd number near by.
    """

    def rounded(x: Column) -> Column:
        upper = bound(x * 134217729.0, lambda c: c - (c - x))
        k = F.floor(x * 100.0).cast("double")
        above = bound(upper, lambda u: (u * 200.0 - (2.0 * k + 1.0)) + (x - u) * 200.0)
        cents = bound(above, lambda d: F.when(d > 0, k + 1.0).when(d < 0, k).otherwise(k + k % 2.0))
        return F.when(x >= 1e13, x).otherwise(cents / 100.0)

    return bound(value, rounded)


def valid_price(value: Column) -> Column:
    """Finite and above zero, two decimals; else null."""
    price = value.try_cast("double")
    return F.when(~F.isnan(price) & (price > 0) & (price < float("inf")), round_cents(price))


def normalize_stock(value: Column | str, compat: bool = True) -> Column:
    """in_stock, on_order, backorder, discontinued, unknown; null for an empty text.

    ``compat`` tests availability first, so that "indisponible" counts as in stock; else unavailability comes first.
    """

    def state(s: Column) -> Column:
        gone = s.contains("arrete") | s.contains("indisponible") | s.contains("discontinued")
        late = s.contains("reappro") | s.contains("rupture")
        out = F.when(s == "", None)
        if not compat:
            out = out.when(gone, "discontinued").when(late, "backorder")
        out = out.when(s.contains("en stock") | s.contains("disponible"), "in_stock").when(s.contains("sur commande"), "on_order")
        return out.when(late, "backorder").when(gone, "discontinued").otherwise("unknown")

    def known(said: Column) -> Column:
        """The shops' own phrases need no folding."""
        low = F.lower(said)
        out = F.when(low == "", None)
        for phrase, (found, otherwise) in STOCK_STATES.items():
            out = out.when(low == phrase, found if compat else otherwise)
        return out.otherwise(bound(fold(said), state))

    return bound(col(value), known)


def extract_packaging(name: Column | str) -> Column:
    found = lambda folded: F.array_join(F.flatten(F.array(*[F.regexp_extract_all(folded, F.lit(pattern), F.lit(group)) for pattern, group in PACKAGING])), " ")
    return F.trim(bound(fold(name), found))


def variant_tokens(name: Column | str) -> Column:
    """The distinct variant tokens, sorted, without spaces."""
    found = bound(F.upper(clean(name)), lambda text: F.flatten(F.array(*[F.regexp_extract_all(text, F.lit("(?U)" + pattern), F.lit(0)) for pattern in VARIANTS])))
    return F.array_sort(F.array_distinct(F.transform(found, lambda t: F.regexp_replace(t, r"\s+", ""))))


#: Fixed value: the front end's variants.
FRONT_VARIANTS = r"\b(?:A[1-4](?:\.5)?|B[1-4]|C[1-4]|D[2-4]|XS|S|M|L|XL|\d+(?:[.,]\d+)?\s*(?:MM|ML|MG|G)|\d+\s*(?:PCS|PIECES|CAPSULES|SERINGUES|BLOCS))\b"


def front_variants(value: Column | str) -> Column:
    """The front end's distinct variants as written, in capitals and in order: with milligrams, without numbers and ISO sizes."""
    return F.array_distinct(F.regexp_extract_all(F.upper(F.coalesce(col(value), F.lit(""))), F.lit(FRONT_VARIANTS), F.lit(0)))


def name_tokens(value: Column | str) -> Column:
    """Distinct folded words of two letters or more that are no stop words, in order."""
    return F.array_distinct(F.filter(F.split(front_fold(value), " "), lambda t: (F.length(t) > 1) & ~t.isin(*STOP_WORDS)))


def clean_reference(value: Column | str, placeholders: tuple[str, ...] = INVALID_REFERENCES, longest: int | None = None) -> Column:
    """The trimmed reference, null for placeholders and, with ``longest``, for what is longer."""
    text = F.trim(col(value))
    ok = ~F.lower(text).isin(*placeholders)
    return F.when(ok if longest is None else ok & (F.length(text) <= longest), text)


def enriched_reference(value: Column | str) -> Column:
    """The validator of enrichments: also what says that it isn't stated is a placeholder, and 80 characters are the most."""
    return clean_reference(value, (*INVALID_REFERENCES, *UNSTATED_REFERENCES), 80)


def header_reference(value: Column | str) -> Column:
    """The validator of published catalogues: white space collapsed, no column headings."""
    return clean_reference(F.regexp_replace(F.coalesce(col(value), F.lit("")), r"(?U)\s+", " "), HEADER_REFERENCES)


def marked_reference(value: Column | str) -> Column:
    """The validator of references behind a marker: signs around it go; two characters or more of a reference, no headings; else empty."""
    text = F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(col(value), F.lit("")), r"(?U)\s+", " ")), r"^[|:;,.()\[\]{}]+|[|:;,.()\[\]{}]+$", "")
    return bound(text, lambda text: F.when(text.rlike(r"^(?i)[A-Z0-9][A-Z0-9._/\-]{1,60}$") & ~F.lower(text).isin(*MARKED_REFERENCES), text).otherwise(""))


def plain_value(value: Column | str, longest: int = 100) -> Column:
    """A value as people write it: not too long, without the signs and words of code; else null."""
    text = F.trim(F.regexp_replace(col(value), r"(?U)\s+", " "))
    code = text.rlike(r"[{}\[\];]")
    for word in CODE_WORDS:
        code = code | F.lower(text).contains(word)
    return F.when((text != "") & (F.length(text) <= longest) & ~code, text)


def page_reference(value: Column | str) -> Column:
    """A plain value of 60 characters at most that is no placeholder; else null."""
    text = plain_value(value, 60)
    return F.when(~text.rlike(NO_PAGE_REFERENCE), text)


def number(value: Column | str) -> Column:
    """A trimmed number with a decimal comma or dot."""
    return F.replace(F.trim(col(value)), F.lit(","), F.lit(".")).try_cast("double")


def price_by(value: Column | str, form: str) -> Column:
    """A price in a page's text by one of PRICE_FORMS; null without one. See there for what each does with dots."""
    pattern, last, gone = PRICE_FORMS[form]
    raw = F.try_element_at(F.regexp_extract_all(col(value), F.lit(pattern), F.lit(1)), F.lit(-1)) if last else filled(F.regexp_extract(col(value), pattern, 1))
    return F.replace(F.regexp_replace(raw, gone, ""), F.lit(","), F.lit(".")).try_cast("double")


def bare_price(value: Column | str) -> Column:
    """The first number of a text without its spaces, comma or dot as decimal sign, two decimals at most."""
    raw = F.replace(F.regexp_replace(col(value), r"[ \x{a0}\x{202f}]", ""), F.lit(","), F.lit("."))
    return F.nullif(F.regexp_extract(raw, r"(\d+(?:\.\d{1,2})?)", 1), F.lit("")).try_cast("double")


def manufacturer_key(value: Column | str) -> Column:
    return bound(normalize_reference(value), lambda key: F.when((F.length(key) >= 4) & ~key.isin(*NO_REFERENCES), key))


def ean(value: Column | str) -> Column:
    return bound(normalize_reference(value), lambda key: F.when(key.rlike(r"^\d{8,14}$"), key))


def reference_value(value: Column | str) -> Column:
    """A reference as shown on a page: letters, digits and punctuation with at least one digit; else empty."""
    text = clean(value)
    return F.when(text.rlike(r"^(?=.*\d)[A-Za-z0-9][A-Za-z0-9 ./_+-]{0,59}$"), text).otherwise("")


def canonical_url(url: Column | str) -> Column:
    """Unquoted, without closing slashes, lower case. A plus stays a plus."""
    kept = F.replace(F.coalesce(col(url), F.lit("")), F.lit("+"), F.lit("%2B"))
    return F.lower(F.regexp_replace(F.coalesce(F.try_url_decode(kept), kept), "/+$", ""))


def page_url(url: Column | str) -> Column:
    """Scheme, host and path, and of the query only the page number."""
    u = col(url)
    page = F.try_parse_url(u, F.lit("QUERY"), F.lit("p"))
    base = F.concat(F.try_parse_url(u, F.lit("PROTOCOL")), F.lit("://"), F.try_parse_url(u, F.lit("HOST")), F.coalesce(F.try_parse_url(u, F.lit("PATH")), F.lit("")))
    return F.when(page.isNotNull(), F.concat(base, F.lit("?p="), page)).otherwise(base)


#: Fixed value: a reference at the end of an address.
_URL_REFERENCE = r"(?i)-(\d{2,5}-\d{2,5})\.html$"


def _path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#;]*)", 1)


def host(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def surt(url: Column | str) -> Column:
    """The key under which crawls sort an address: the host's parts from the last on, without www, then path and query, in small letters."""
    u = col(url)
    parts = F.split(F.regexp_replace(F.lower(F.regexp_extract(u, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)", 1)), r"^www\d*\.", ""), r"\.")
    tail = F.lower(F.regexp_replace(F.regexp_extract(u, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^#]*)", 1), "^(?!/)", "/"))
    return F.concat(F.array_join(F.reverse(parts), ","), F.lit(")"), tail)


def title_from_slug(url: Column | str, default: str = "") -> Column:
    """The last part of the path as a title: no extension, no reference at the end, words with a capital, the rest as it is."""
    path = _path(col(url))
    unquoted = F.replace(F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path), F.lit("\x00"), F.lit(""))
    tail = F.regexp_replace(F.regexp_extract(unquoted, "([^/]*)/*$", 1), r"(?i)\.html$", "")
    bare = F.regexp_replace(F.regexp_replace(F.concat(tail, F.lit(".html")), _URL_REFERENCE, ""), r"\.html$", "")
    words = F.filter(F.split(F.regexp_replace(bare, r"(?U)[-_\s]+", " "), " "), lambda w: w != "")
    return F.coalesce(F.nullif(F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), " "), F.lit("")), F.lit(default))


def reference_from_url(url: Column | str) -> Column:
    """The reference of two numbers that closes the path before .html, else null."""
    return F.nullif(F.regexp_extract(_path(col(url)), _URL_REFERENCE, 1), F.lit(""))


def _has_any(text: Column, parts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for part in parts:
        out = out | text.contains(part)
    return out


def product_address(url: Column | str) -> Column:
    """Whether an archived address looks like a product page: it ends in .html or is an article, outside the service pages."""
    low = F.lower(col(url))
    return F.coalesce(~_has_any(low, ARCHIVE_DENIED) & (F.endswith(low, F.lit(".html")) | low.contains("/article-")), F.lit(False))


def product_address_under(url: Column | str, prefix: str) -> Column:
    """Whether an address under the prefix may be a product page: no sitemap, none of the shop's other pages."""
    u = col(url)
    return F.coalesce(F.startswith(u, F.lit(prefix)) & ~F.endswith(u, F.lit(".xml")) & ~_has_any(u, PREFIX_DENIED), F.lit(False))


def product_address_of(url: Column | str, hosts: tuple[str, ...]) -> Column:
    """Whether the address is a page of one of the hosts whose path ends in .html, outside the shop's other pages."""
    path = F.lower(_path(col(url)))
    return F.coalesce(host(url).isin(*hosts) & ~_has_any(path, HOST_DENIED) & F.endswith(path, F.lit(".html")), F.lit(False))


def category_address(url: Column | str) -> Column:
    """Whether an address may be a category: a page or folder, no article, no brand page, of queries only page numbers."""
    u = col(url)
    path, query = F.lower(_path(u)), F.regexp_extract(u, r"\?([^#]*)", 1)
    ok = F.endswith(path, F.lit(".html")) | F.endswith(path, F.lit("/")) | u.contains("?p=") | u.contains("?page=")
    return F.coalesce(~path.rlike(r"/article-\d+-") & ~_has_any(path, CATEGORY_DENIED) & ((query == "") | query.rlike(r"(^|&)(p|page)=\d+")) & ok, F.lit(False))


def page_candidate(url: Column | str) -> Column:
    """Whether a .html address outside the service pages may be a product or a category."""
    path = _path(col(url))
    return F.coalesce(F.endswith(F.lower(path), F.lit(".html")) & ~path.rlike("(?i)" + SERVICE_PATHS), F.lit(False))


def site_address(url: Column | str, site: str) -> Column:
    """The address if it is of the site and no service page; else empty."""
    u = col(url)
    ok = u.rlike("^https?://") & (F.lower(F.regexp_extract(u, "^[a-z]+://([^/?#]*)", 1)) == site) & ~_path(u).rlike("(?i)" + SERVICE_PATHS)
    return F.when(F.coalesce(ok, F.lit(False)), u).otherwise("")


def money(value: Column | str) -> Column:
    """Two decimals with a comma and the euro sign."""
    return F.concat(F.replace(F.replace(F.format_number(col(value).cast("double"), 2), F.lit(","), F.lit("")), F.lit("."), F.lit(",")), F.lit(" €"))


def js_round(value: Column) -> Column:
    """Halves go up, also below zero."""
    return F.floor(value + 0.5)


def is_set(value: Column | str) -> Column:
    """Neither null nor empty."""
    c = col(value)
    return c.isNotNull() & (c.cast("string") != "")


def completeness(*columns: str) -> Column:
    """How many of the columns are set."""
    out = F.lit(0)
    for c in columns:
        out = out + is_set(c).cast("int")
    return out


def fingerprint(merchant: Column | str, reference: Column | str, url: Column | str) -> Column:
    return F.concat_ws(":", col(merchant), F.when(is_set(reference), col(reference)).otherwise(col(url)))


def set_text(value: Column | str) -> Column:
    """The text, null if empty."""
    c = col(value)
    return F.when(c != "", c)
