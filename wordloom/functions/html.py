"""Page columns: metadata, removable elements, blocks, entities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wordloom.functions.text import drop_elements, let, unicode_trim

#: What follows a tag's name. A tag ends at the next bracket, so that unclosed ones take linear time.
REST = r"(?:[\s/][^<>]*)?>"
#: Comments and elements that never hold article text, in the order they go, with their end tags.
NON_CONTENT = (
    (r"(?s)<!--.*?-->", "-->"),
    *(
        (rf"(?si)<{name}{REST}.*?</{name}\s*>", rf"</{name}\s*>")
        for name in ("script", "style", "noscript", "head", "nav", "header", "footer", "aside")
    ),
)
#: Tags that start or end a block of text.
BLOCK_TAG = (
    r"(?i)</?(?:address|article|blockquote|body|br|dd|div|dl|dt|figcaption|figure|form"
    r"|h[1-6]|hr|html|li|main|ol|p|pre|section|table|tbody|td|tfoot|th|thead|tr|ul)" + REST
)
ANY_TAG = r"<[^<>]*>"
LINK = rf"(?si)<a{REST}.*?</a\s*>"
TITLE = rf"(?si)<title{REST}(.*?)</title\s*>"
META_AUTHOR = r"(?si)<meta\s[^<>]*\bname\s*=\s*[\"']?author\b[^<>]*>"
META_SITE = r"(?si)<meta\s[^<>]*\bproperty\s*=\s*[\"']?og:site_name\b[^<>]*>"
CONTENT = r"(?si)\bcontent\s*=\s*[\"']([^\"']*)[\"']"
URL_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
#: Named character references to decode.
ENTITIES = (
    ("&nbsp;", "\u00a0"),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&apos;", "'"),
    ("&middot;", "·"),
    ("&copy;", "©"),
    ("&reg;", "®"),
    ("&hellip;", "…"),
    ("&ndash;", "–"),
    ("&mdash;", "—"),
    ("&lsquo;", "‘"),
    ("&rsquo;", "’"),
    ("&ldquo;", "“"),
    ("&rdquo;", "”"),
    ("&laquo;", "«"),
    ("&raquo;", "»"),
    ("&bull;", "•"),
    ("&euro;", "€"),
    ("&amp;", "&"),
)
#: A text as references and what lies between them.
REFERENCE_OR_TEXT = r"&[A-Za-z]+;|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};|&|[^&]+"


def _numbered(piece: Column) -> Column:
    """The character of a numeric reference, NULL for anything else."""
    hexed = F.regexp_extract(piece, r"^&#[xX]([0-9A-Fa-f]+);$", 1)
    digits = F.regexp_extract(piece, r"^&#([0-9]+);$", 1)
    code = F.when(hexed != "", F.conv(hexed, 16, 10)).when(digits != "", digits).cast("int")
    valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    shown = F.decode(F.unhex(F.lpad(F.hex(F.when(valid, code).otherwise(0xFFFD)), 8, "0")), "UTF-32")
    return F.when(code.isNotNull(), shown)


def decode_entities(text: Column) -> Column:
    """References decoded once: what ``&amp;`` becomes part of is no reference."""
    literals = ["'" + x.replace("'", "\\'") + "'" for pair in ENTITIES for x in pair]
    known = F.expr(f"map({', '.join(literals)})")

    def shown(piece: Column) -> Column:
        decoded = F.coalesce(F.try_element_at(known, piece), _numbered(piece), piece)
        return F.when(piece.startswith("&"), decoded).otherwise(piece)

    def decoded(text: Column) -> Column:
        pieces = F.regexp_extract_all(text, F.lit(REFERENCE_OR_TEXT), F.lit(0))
        return F.when(text.contains("&"), F.array_join(F.transform(pieces, shown), "")).otherwise(text)

    return let(text, decoded)


def plain_text(markup: Column) -> Column:
    """Text of a piece of markup: tags out, references decoded, white space folded."""
    text = decode_entities(F.regexp_replace(markup, ANY_TAG, ""))
    return unicode_trim(F.regexp_replace(text, "[ \\t\\n\\r\\f\u00a0]+", " "))


def page_title(html: Column) -> Column:
    # Without an end tag no start tag is searched for it.
    upto = F.regexp_extract(html, r"(?si)\A.*?</title\s*>", 0)
    return plain_text(F.regexp_extract(upto, TITLE, 1))


def page_author(html: Column) -> Column:
    return plain_text(F.regexp_extract(F.regexp_extract(html, META_AUTHOR, 0), CONTENT, 1))


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, URL_HOST, 1))


def page_site(html: Column, url: Column) -> Column:
    """Declared site name, else the host of the URL."""
    declared = plain_text(F.regexp_extract(F.regexp_extract(html, META_SITE, 0), CONTENT, 1))
    return let(declared, lambda d: F.when(d != "", d).otherwise(url_host(url)))


def content_markup(html: Column) -> Column:
    for element, end_tag in NON_CONTENT:
        html = drop_elements(html, element, end_tag, " ")
    return html


def block_markup(markup: Column) -> Column:
    """Pieces of markup between block tags."""
    return F.split(markup, BLOCK_TAG)


def link_chars(markup: Column) -> Column:
    """Characters of text that sit inside links."""
    closed = F.regexp_extract(markup, r"(?si)\A.*</a\s*>", 0)
    links = F.regexp_extract_all(closed, F.lit(LINK), F.lit(0))
    return F.aggregate(
        links,
        F.lit(0).cast("bigint"),
        lambda acc, link: acc + F.length(plain_text(link)).cast("bigint"),
    )
