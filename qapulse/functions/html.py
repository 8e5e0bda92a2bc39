"""HTML bodies to prose and code blocks, as JVM-side expressions.

A ``<pre>`` region is a code block; everything else, inline ``<code>`` included, is prose. Regions
left open run to the end of the text. A ``<pre>`` nested in another one belongs to the outer block.
References are decoded if they end in a semicolon: all names of HTML 5, and numbers with any number of
leading zeros; 128 to 159 are control characters, not their Windows meaning.
"""

from __future__ import annotations

import json
import zlib
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rest of an opening tag: quoted attribute values may hold '>'. Possessive quantifiers keep Java's
# matcher from recursing.
_REST = r"""(?:(?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*+>)"""
# A name ends here: "<pre-x>" is another element.
_END = r"(?=[\s/>])"
# Comments and the contents of script, style and template elements are not text.
_HIDDEN = r"(?is)<!--.*?(?:-->|\z)" + "".join(
    rf"|<{name}{_END}.*?(?:</{name}\s*>|\z)" for name in ("script", "style", "template")
)
_PRE = rf"(?is)<pre{_END}{_REST}(.*?)(?:</pre\s*>|\z)"
_PRE_TAG = rf"(?is)<(?:(/)pre\s*>|pre{_END}{_REST})"
# Blocks nested up to four deep are found by one pattern, without counting depths: a level is text, up to the next tag of a
# block, and whole blocks of the next level. The deepest level takes what opens in it for text.
_DEEP = 4
_OPEN, _CLOSE = rf"<pre{_END}{_REST}", r"</pre\s*>"
_INSIDE = r"[^<]*+(?:<(?!/pre\s*>)[^<]*+)*+"
for _ in range(_DEEP - 1):
    _INSIDE = rf"[^<]*+(?:(?:{_OPEN}{_INSIDE}(?:{_CLOSE}|\z)|<(?!/pre\s*>))[^<]*+)*+"
_BLOCKS = rf"(?is){_OPEN}({_INSIDE})(?:{_CLOSE}|\z)"
# A tag starts with a letter, '/', '!' or '?', so a bare "a < b" stays text.
_TAG = rf"<[A-Za-z/!?]{_REST}"
# A cut region must still separate the text on both sides of it.
_SEPARATOR = "<!>"
# Between code blocks; these two are no characters of any text.
_BLOCK = "\ufffe\uffff"
# The characters str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


# Decoded by plain replacement; "amp" must come last, as its result may look like a reference.
_COMMON = {"lt": "<", "gt": ">", "quot": '"', "nbsp": "\xa0", "amp": "&"}
# Maps that the names of references are dealt into.
_MAPS = 1024


def _once(value: Column, use) -> Column:
    """``use(value)``, with the value worked out once however often it is used."""
    return F.transform(F.array(value), use)[0]


def _code_point(number: Column) -> Column:
    """The character of a code point; NULL for 0, surrogates and numbers beyond Unicode."""
    known = number.between(256, 0xD7FF) | number.between(0xE000, 0x10FFFF)
    wide = F.decode(F.unhex(F.lpad(F.hex(F.when(known, number)), 8, "0")), "UTF-32")
    return F.when(number.between(1, 255), F.char(number)).otherwise(wide)


def _named(name: Column) -> Column:
    """The characters of a named reference; names are dealt into small maps, as Spark looks through a map entry by entry."""
    maps = [{} for _ in range(_MAPS)]
    for key, chars in html5.items():
        if key.endswith(";"):
            maps[zlib.crc32(key[:-1].encode()) % _MAPS][key[:-1]] = chars
    return F.from_json(F.lit(json.dumps(maps)), "array<map<string,string>>")[(F.crc32(name) % _MAPS).cast("int")][name]


def _decode_any(text: Column) -> Column:
    """One pass over the references of a text: named, decimal and hexadecimal."""

    def piece(part: Column, index: Column) -> Column:
        name = F.regexp_extract(part, r"^(#0*[0-9]{1,7}|#[xX]0*[0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]*);", 1)
        return F.when(index == 0, part).otherwise(_once(name, lambda found: decoded(part, found)))

    def decoded(part: Column, name: Column) -> Column:
        digits = F.ltrim(F.substr(name, F.lit(3)), F.lit("0"))
        number = F.when(F.lower(F.substring(name, 2, 1)) == "x", F.conv(digits, 16, 10)).otherwise(F.substr(name, F.lit(2)))
        char = F.when(name.startswith("#"), _once(number.cast("bigint"), _code_point)).otherwise(_named(name))
        return F.coalesce(F.concat(char, F.substr(part, F.length(name) + 2)), F.concat(F.lit("&"), part))

    return F.array_join(F.transform(F.split(text, "&"), piece), "")


def decode_entities(text: Column) -> Column:
    """Decode ``&name;``, ``&#n;`` and ``&#xn;`` once each; unknown references stay as they are.

    Texts with none but the common references, nearly all, take the cheap branch.
    """
    cheap = text
    for name, char in _COMMON.items():
        cheap = F.replace(cheap, F.lit(f"&{name};"), F.lit(char))
    rare = text.rlike(f"&(?!(?:{'|'.join(_COMMON)});)[#A-Za-z]")
    return F.when(~text.contains("&"), text).when(rare, _decode_any(text)).otherwise(cheap)


def _decoded(texts: Column, source: Column) -> Column:
    """The texts decoded, if the text they come from has a reference at all."""
    return F.when(source.contains("&"), F.transform(texts, decode_entities)).otherwise(texts)


def _visible(html: Column) -> Column:
    html = F.coalesce(html, F.lit(""))
    # Most bodies have no hidden region: a search spares them the regex copy.
    named = html.rlike(f"<(?=[sStT])(?i:script|style|template){_END}")
    return F.when(html.contains("<!--") | named, F.regexp_replace(html, _HIDDEN, _SEPARATOR)).otherwise(html)


def _has_pre(html: Column) -> Column:
    return html.rlike(f"<[pP][rR][eE]{_END}")


def _nested(html: Column) -> Column:
    """Whether a ``<pre>`` opens before the one in front of it is closed; few bodies have that."""
    tags = F.regexp_extract_all(html, F.lit(_PRE_TAG), F.lit(1))
    return F.array_join(F.transform(tags, lambda t: F.when(t == "/", ")").otherwise("(")), "").contains("((")


def _by_depth(html: Column) -> Column:
    """Pieces between the ``<pre>`` tags, with the depth of each and of the one before it."""
    tags = F.regexp_extract_all(html, F.lit(_PRE_TAG), F.lit(1))
    depths = F.aggregate(
        tags, F.array(F.lit(0)),
        lambda seen, tag: F.concat(seen, F.array(F.greatest(F.lit(0), F.element_at(seen, -1) + F.when(tag == "/", -1).otherwise(1)))),
    )
    earlier = F.concat(F.array(F.lit(1)), depths)
    return F.zip_with(
        F.split(html, _PRE_TAG), F.arrays_zip(depths.alias("depth"), F.slice(earlier, 1, F.size(depths)).alias("before")),
        lambda text, d: F.struct(text.alias("text"), d["depth"].alias("depth"), d["before"].alias("before")),
    )


def body_prose(html: Column) -> Column:
    """Text outside ``<pre>``: every text node stripped, empty ones dropped, joined by one space."""
    shown = _visible(html)
    balanced = F.array_join(F.transform(F.filter(_by_depth(shown), lambda x: x["depth"] == 0), lambda x: x["text"]), _SEPARATOR)
    # Bodies without a block, most of them, need none of the work on blocks.
    outside = F.when(~_has_pre(shown), shown).when(_nested(shown), balanced).otherwise(F.regexp_replace(shown, _PRE, _SEPARATOR))
    nodes = F.transform(_decoded(F.split(outside, _TAG), outside), lambda node: F.btrim(node, F.lit(WHITESPACE)))
    return F.array_join(F.filter(nodes, lambda node: node != ""), " ")


def _balanced(shown: Column) -> Column:
    """The blocks of a text, at any depth, without the tags of nested ones."""
    # A piece outside all blocks ends the block before it, if there is one.
    marked = F.transform(
        _by_depth(shown), lambda x: F.when(x["depth"] > 0, x["text"]).when(x["before"] > 0, _BLOCK).otherwise("")
    )

    def ordered(parts: Column) -> Column:
        ended = F.element_at(parts, -1) == ""
        return F.slice(parts, 2, F.size(parts) - 1 - F.when(ended, 1).otherwise(0))

    return _once(F.split(F.array_join(marked, ""), _BLOCK), ordered)


def code_blocks(html: Column) -> Column:
    """Ordered texts of the ``<pre>`` regions, inner tags removed."""
    shown = _visible(html)

    def untagged(block: Column) -> Column:
        return F.when(block.contains("<"), F.regexp_replace(block, _TAG, "")).otherwise(block)

    def flat(region: Column) -> Column:
        whole = F.when(_has_pre(region), F.regexp_replace(region, _PRE_TAG, "")).otherwise(region)
        return F.when(region.contains("<"), F.regexp_replace(whole, _TAG, "")).otherwise(region)

    def deep(region: Column) -> Column:
        opened = F.regexp_count(region, F.lit(f"(?is){_OPEN}"))
        return region.contains("<") & (F.size(F.split(region, "<")) > _DEEP) & (opened >= _DEEP)

    def at_any_depth(shown: Column) -> Column:
        blocks = F.when(_nested(shown), _balanced(shown)).otherwise(F.regexp_extract_all(shown, F.lit(_PRE), F.lit(1)))
        return F.transform(blocks, untagged)

    def texts(regions: Column) -> Column:
        last = F.get(regions, F.size(regions) - 1)
        # Regions may be deeper than the pattern goes, or the last one may be an empty block left open.
        unsure = F.exists(regions, deep) | (last == "") | (last.startswith("<") & _has_pre(F.left(last, F.lit(5))))
        return F.when(unsure, _once(shown, at_any_depth)).otherwise(F.transform(regions, flat))

    plain = _once(F.regexp_extract_all(shown, F.lit(_BLOCKS), F.lit(1)), texts)
    # Cutting hidden regions makes no block, so bodies without one, most of them, need no more than this test.
    some = html.contains("<pre") | _has_pre(html)
    return F.when(some, F.transform(plain, decode_entities)).otherwise(F.array().cast("array<string>"))


def link_count(html: Column) -> Column:
    """Opening ``<a`` tags in the raw body, code included."""
    return F.regexp_count(F.coalesce(html, F.lit("")), F.lit(r"(?i)<a\s"))
