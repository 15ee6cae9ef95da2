"""Main text of a web page as one row-local column expression.

A page is one row, so the whole extraction is a projection: the markup is cut into tags and
texts, elements become index ranges found by one pass over the tags, and text is whatever lies
inside the wanted range and outside the noise ranges.  Nothing is exploded, so nothing shuffles.

An element ends at the first later close tag of its name that balances it.  One whose end tag is
left out ends at the next tag that implies its end: the start of a sibling or the end of its parent.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from html.entities import html5, name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from roleweave.functions import text as T
from roleweave.functions.arrays import keep_first_by_prefix, let


@dataclass(frozen=True)
class PageRules:
    """Tags and class or id patterns that decide what is main text."""

    structural_tags: tuple[str, ...] = (
        "script", "style", "nav", "header", "footer", "aside", "form", "noscript", "iframe",
    )
    noise: str = (
        "footer|nav|header|cookie|sidebar|similar|related|recommend|subscribe|salary|stats|"
        "newsletter|alert|social|share|login|register|breadcrumb|banner|advert|ad-container|promo|"
        "eeo|legal|disclaimer"
    )
    container: str = (
        "job.?desc|description|job.?detail|posting|job.?content|vacancy|job-body|job_body|"
        "details-content|adp-body|richTextArea|job-adp|listing.?body|job.?text|position.?desc|"
        "role.?desc|posting.?body"
    )
    vendor: tuple[str, ...] = ("adp-body", "ui-richTextArea", "adp-template", "job-adp")
    section: str = (
        r"responsibilities|requirements|qualifications|skills?\s+required|what\s+you|"
        r"required\s+skills|preferred\s+skills|technical\s+skills|key\s+skills|"
        r"minimum\s+qualifications|preferred\s+qualifications|you\s+will\s+need|"
        r"what\s+we.?re\s+looking\s+for|duties|essential"
    )
    min_container_chars: int = 100
    min_vendor_chars: int = 50
    # A longer body replaces a text shorter than a container has to be.
    long_body_chars: int = 300
    # Optional limits; the defaults keep every block, the whole body and the whole text.
    min_block_chars: int = 1
    max_block_chars: int | None = None
    block_prefix: int | None = None
    min_body_chars: int = 0
    body_skip: int = 0
    max_chars: int | None = None


_VOID = (
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr",
)
_BLOCK = (
    "address|article|aside|blockquote|body|dd|details|div|dl|dt|fieldset|figcaption|figure|footer|"
    "form|h[1-6]|header|hr|html|li|main|menu|nav|ol|p|pre|section|table|tbody|td|tfoot|th|thead|tr|ul"
)
_RAW = r"(?is)<!--.*?(?:-->|$)|<(script|style)\b.*?(?:</\1\s*>|$)"
_TOKEN = r"(?s)<[a-zA-Z/!][^>]*>|[^<]+|<"
_BLOCK_START = (
    rf"(?is)<(?=(p(?:\s[^>]*)?>.*?(?=</?(?:{_BLOCK})[\s/>]|$)"
    rf"|li(?:\s[^>]*)?>.*?(?=</?li[\s/>]|</(?:ul|ol|menu|body|html)[\s>]|$)))"
)
_HEADINGS = ("h1", "h2", "h3", "h4")
_LAST = 2147483647
_RANGES = "array<struct<s:int,e:int>>"


_BREAK, _IS = "\x1f", "\x1e"
_NAMES = {f"&{n}": c for n, c in html5.items()}
_BARE = sorted((f"&{n}" for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
_WINDOWS = {str(c): bytes([c]).decode("cp1252") for c in range(128, 160) if c not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}


def _look_up(entries: dict[str, str], key: Column) -> Column:
    """Value of a key in a table kept as one string; null if it is not there."""
    text = F.lit(_BREAK + _BREAK.join(f"{k}{_IS}{v}" for k, v in entries.items()))
    mark = F.concat(F.lit(_BREAK), key, F.lit(_IS))
    return F.when(F.contains(text, mark), F.split_part(F.split_part(text, mark, F.lit(2)), F.lit(_BREAK), F.lit(1)))


def unescape(text: Column) -> Column:
    """Decode named and numeric character references in one pass, by the HTML5 rules.

    All names count; the old ones also without a semicolon and in front of more letters.  128 to 159
    stand for the Windows characters, impossible numbers for U+FFFD.
    """
    common = {f"&{n};": chr(c) for n, c in name2codepoint.items()}
    bare_pattern = f"^(?:{'|'.join(_BARE)})"
    pieces = F.regexp_extract_all(
        text, F.lit(r"&#[xX]?[0-9a-fA-F]+;?|&[a-zA-Z][a-zA-Z0-9]*;?|[^&]+|&"), F.lit(0)
    )

    def number(p: Column) -> Column:
        hexadecimal = F.conv(F.regexp_extract(p, r"^&#[xX]0*([0-9a-fA-F]{1,7});?$", 1), 16, 10)
        code = F.coalesce(
            T.blank_to_null(F.regexp_extract(p, r"^&#0*([0-9]{1,8});?$", 1)), T.blank_to_null(hexadecimal)
        ).try_cast("long")
        wide = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        old = F.when(code.between(128, 159), _look_up(_WINDOWS, code.cast("string")))
        digits = p.rlike(r"^&#(?:[0-9]+|[xX][0-9a-fA-F]+);?$")
        return F.when(~digits, _leading_number(p)).otherwise(F.coalesce(old, F.when(valid, wide), F.lit("\ufffd")))

    def _leading_number(p: Column) -> Column:
        """Decimal digits followed by letters: only the digits are the reference."""
        digits = F.regexp_extract(p, r"^&#([0-9]+)", 1)
        code = digits.try_cast("long")
        wide = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF) & ~code.between(128, 159)
        return F.when(valid, F.concat(wide, F.substring(p, F.length(digits) + 3, F.lit(_LAST)))).otherwise(p)

    def named(p: Column) -> Column:
        start = F.regexp_extract(p, bare_pattern, 0)
        short = F.concat(_look_up(_NAMES, start), F.substring(p, F.length(start) + 1, F.lit(_LAST)))
        return F.coalesce(_look_up(common, p), _look_up(_NAMES, p), F.when(start != "", short), p)

    def decode(p: Column) -> Column:
        return F.when(~F.startswith(p, F.lit("&")), p).when(F.startswith(p, F.lit("&#")), number(p)).otherwise(named(p))

    return F.when(~F.contains(text, F.lit("&")), text).otherwise(
        F.array_join(F.transform(pieces, decode), "")
    )


def tokenize(html: Column) -> Column:
    """Tags and texts in order; scripts, styles and comments become empty separators."""
    return F.regexp_extract_all(
        F.regexp_replace(T.text_or_empty(html), _RAW, "<!>"), F.lit(_TOKEN), F.lit(0)
    )


def _attribute(tag: Column, name: str) -> Column:
    quoted = F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", 1)
    return T.normalize(F.regexp_replace(quoted, "^[\"']|[\"']$", ""))


# Elements whose end tag may be left out, and the open tags that end them.
_IMPLIED_ENDS = {
    "p": (
        "address", "article", "aside", "blockquote", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption",
        "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "menu", "nav",
        "ol", "p", "pre", "section", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
    ),
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option", "optgroup"),
    "optgroup": ("optgroup",), "td": ("td", "th", "tr", "tbody", "tfoot"), "th": ("td", "th", "tr", "tbody", "tfoot"),
    "tr": ("tr", "tbody", "tfoot"), "thead": ("tbody", "tfoot"), "tbody": ("tbody", "tfoot"), "tfoot": ("tbody",),
}
_OPTIONAL = tuple(_IMPLIED_ENDS)
_ENDS = {
    name: " ".join(["", *(tag for tag, ends in _IMPLIED_ENDS.items() if name in ends), ""])
    for name in sorted({n for ends in _IMPLIED_ENDS.values() for n in ends})
}


_STRICT_BLOCKS = sorted(
    {n for b in _BLOCK.split("|") for n in ([f"h{i}" for i in range(1, 7)] if b == "h[1-6]" else [b])} - set(_OPTIONAL)
)


def tag_events(tokens: Column) -> Column:
    """``array<struct<i, name, kind, cls, ref, optional, block, ends>>`` of the tags: kind 1 opens, -1 closes, 0 is void.

    ``optional``: its end tag may be left out; ``block``: a block whose end tag may not; ``ends``: the
    open elements that its start ends.
    """

    def attribute(t: Column, name: str) -> Column:
        return F.when(F.contains(t, F.lit("=")), _attribute(t, name)).otherwise("")

    def event(t: Column, i: Column, name: Column) -> Column:
        void = name.isin(*_VOID) | F.endswith(t, F.lit("/>"))
        return F.struct(
            i.alias("i"),
            name.alias("name"),
            F.when(F.startswith(t, F.lit("</")), -1).when(void, 0).otherwise(1).alias("kind"),
            attribute(t, "class").alias("cls"),
            attribute(t, "id").alias("ref"),
            name.isin(*_OPTIONAL).alias("optional"),
            name.isin(*_STRICT_BLOCKS).alias("block"),
            F.when(name.isin(*_ENDS), _look_up(_ENDS, name)).otherwise("").alias("ends"),
        )

    def tag(t: Column, i: Column) -> Column:
        name = F.lower(F.regexp_extract(t, r"^</?([a-zA-Z][a-zA-Z0-9]*)", 1))
        return F.when(F.startswith(t, F.lit("<")), let(name, lambda n: F.when(n != "", event(t, i, n))))

    return F.filter(F.transform(tokens, tag), lambda e: e.isNotNull())


def _range(start: Column, end: Column) -> Column:
    return F.struct(start.cast("int").alias("s"), end.cast("int").alias("e"))


def _ending(tag: Column, optional: Column, depth: Column, inner: Column, e: Column, then: Callable[[dict], Column]) -> Column:
    """What an event does to an open element ``tag``, handed to ``then``.

    ``depth`` counts open elements of its name, ``inner`` other open blocks whose end tag is not
    optional; inline elements neither hold a sibling's start back nor end their surroundings.  ``own``: its balancing end tag.  ``implied``: a tag that ends it unseen, the start
    of a sibling or the end of its parent; the element ends before that tag.
    """
    same = e["name"] == tag
    at_top = inner <= 0
    begins = (e["kind"] >= 0) & F.contains(e["ends"], F.concat(F.lit(" "), tag, F.lit(" ")))
    parent = (e["kind"] == -1) & ~same & (e["block"] | (optional & e["optional"]))
    change = F.when(~same, 0).when(~optional, e["kind"]).when(at_top & (e["kind"] == -1), -1).otherwise(0)
    return then(
        {
            "depth": depth + change,
            "inner": F.greatest(inner + F.when(~same & e["block"], e["kind"]).otherwise(0), F.lit(0)),
            "own": (e["kind"] == -1) & same & (depth + change <= 0),
            "implied": at_top & (begins | parent),
        }
    )


def outer_ranges(events: Column, wanted: Callable[[Column], Column]) -> Column:
    """Index ranges of the outermost elements whose open tag is wanted."""
    nothing = F.array().cast(_RANGES)
    state = F.struct(
        F.lit("").alias("tag"), F.lit(False).alias("optional"), F.lit(0).alias("depth"), F.lit(0).alias("inner"),
        F.lit(0).alias("start"), nothing.alias("found"),
    )

    def step(acc: Column, e: Column) -> Column:
        inside = acc["tag"] != ""

        def moved(end: dict[str, Column]) -> Column:
            closes = inside & (end["own"] | end["implied"])
            opens = (~inside | (end["implied"] & ~end["own"])) & (e["kind"] == 1) & wanted(e)
            return after(end, {"opens": opens, "closes": closes})

        def after(end: dict[str, Column], now: dict[str, Column]) -> Column:
            fresh = now["opens"] | now["closes"] | ~inside
            last = F.when(end["own"], e["i"]).otherwise(e["i"] - 1)
            return F.struct(
                F.when(now["opens"], e["name"]).when(now["closes"], "").otherwise(acc["tag"]).alias("tag"),
                F.when(now["opens"], e["optional"]).otherwise(acc["optional"]).alias("optional"),
                F.when(now["opens"], 1).when(fresh, 0).otherwise(end["depth"]).alias("depth"),
                F.when(fresh, 0).otherwise(end["inner"]).alias("inner"),
                F.when(now["opens"], e["i"]).otherwise(acc["start"]).alias("start"),
                F.when(now["closes"], F.concat(acc["found"], F.array(_range(acc["start"], last))))
                .otherwise(acc["found"])
                .alias("found"),
            )

        return _ending(acc["tag"], acc["optional"], acc["depth"], acc["inner"], e, moved)

    def finish(acc: Column) -> Column:
        last = F.array(_range(acc["start"], F.lit(_LAST)))
        return F.when(acc["tag"] != "", F.concat(acc["found"], last)).otherwise(acc["found"])

    return F.aggregate(events, state, step, finish)


def element_end(events: Column, opening: Column) -> Column:
    """Index of the tag that ends an element: its own end tag or one that implies it; else the page's end."""
    state = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("inner"), F.lit(_LAST).alias("end"))

    def step(acc: Column, e: Column) -> Column:
        def moved(end: dict[str, Column]) -> Column:
            found = F.when(end["own"] | end["implied"], e["i"]).otherwise(F.lit(_LAST))
            return F.struct(end["depth"].alias("depth"), end["inner"].alias("inner"), found.alias("end"))

        live = (acc["end"] == _LAST) & (e["i"] > opening["i"])
        after = _ending(opening["name"], opening["optional"], acc["depth"], acc["inner"], e, moved)
        return F.when(live, after).otherwise(acc)

    balanced = F.aggregate(events, state, step, lambda acc: acc["end"])
    return F.when(opening["kind"] == 1, balanced).otherwise(opening["i"])


#: Stands for a decoded "<" until the text is put together; never a character of a text.
_LESS = "\ufdd0"


def decoded(tokens: Column) -> Column:
    """Tokens with the references of their texts decoded, once for all later steps."""

    def text(t: Column) -> Column:
        plain = F.contains(t, F.lit("&")) & ~t.rlike("^<[a-zA-Z/!]")
        return F.when(plain, F.replace(unescape(t), F.lit("<"), F.lit(_LESS))).otherwise(t)

    return F.transform(tokens, text)


def _strip_all(texts: Column, separator: str) -> Column:
    stripped = F.transform(texts, lambda t: T.strip_blank(F.replace(t, F.lit(_LESS), F.lit("<"))))
    return F.array_join(F.filter(stripped, lambda t: t != ""), separator)


def range_text(tokens: Column, start: Column, end: Column, separator: str) -> Column:
    """Texts strictly between two indexes, each stripped, joined."""
    inside = F.filter(
        tokens,
        lambda t, i: (i > start) & (i < end) & ~t.rlike("^<[a-zA-Z/!]"),
    )
    return _strip_all(inside, separator)


_GONE = "<!>"


def _noise_ranges(events: Column, rules: PageRules) -> Column:
    """Structural elements and elements with a noise class or id."""
    pattern = f"(?i){rules.noise}"

    def noisy(e: Column) -> Column:
        marked = F.when(e["cls"] != "", e["cls"].rlike(pattern)).otherwise(False)
        return e["name"].isin(*rules.structural_tags) | marked | F.when(e["ref"] != "", e["ref"].rlike(pattern)).otherwise(False)

    return outer_ranges(events, noisy)


def _outside(tokens: Column, ranges: Column, blank: bool) -> Column:
    """Tokens outside ordered ranges, by slices; with ``blank`` an empty separator stands for each that is gone."""

    def piece(r: Column, j: Column) -> Column:
        start = F.coalesce(F.get(ranges, j - 1)["e"] + 1, F.lit(0))
        before = F.slice(tokens, start + 1, r["s"] - start)
        if not blank:
            return before
        return F.concat(before, F.array_repeat(F.lit(_GONE), F.least(r["e"], F.size(tokens) - 1) - r["s"] + 1))

    def tail(end: Column) -> Column:
        return F.when(end >= F.size(tokens) - 1, F.array().cast("array<string>")).otherwise(F.slice(tokens, end + 2, F.size(tokens)))

    rest = let(F.element_at(ranges, -1)["e"], tail)
    return F.when(F.size(ranges) == 0, tokens).otherwise(F.concat(F.flatten(F.transform(ranges, piece)), rest))


def without_noise(tokens: Column, rules: PageRules) -> Column:
    """Tokens outside structural elements and outside elements with a noise class or id."""
    return let(
        tokens, lambda tok: let(_noise_ranges(tag_events(tok), rules), lambda ranges: _outside(tok, ranges, False))
    )


def _first(events: Column, matches: Callable[[Column], Column]) -> Column:
    return F.get(F.filter(events, lambda e: (e["kind"] >= 0) & matches(e)), F.lit(0))


def _element_text(tokens: Column, events: Column, opening: Column) -> Column:
    """Text of an element given its open tag; empty if there is no such tag."""

    def of_opening(o: Column) -> Column:
        inside = let(element_end(events, o), lambda end: range_text(tokens, o["i"], end, "\n"))
        return F.when(o.isNull(), "").otherwise(inside)

    return let(opening, of_opening)


def container_text(tokens: Column, events: Column, rules: PageRules) -> Column:
    pattern = f"(?i){rules.container}"
    named = F.filter(events, lambda e: (e["cls"] != "") | (e["ref"] != ""))
    opening = let(
        named,
        lambda n: F.coalesce(_first(n, lambda e: e["cls"].rlike(pattern)), _first(n, lambda e: e["ref"].rlike(pattern))),
    )
    return _element_text(tokens, events, opening)


def vendor_text(tokens: Column, events: Column, rules: PageRules) -> Column:
    """First vendor pattern, in order, whose element has enough text; null if none has."""

    def candidate(named: Column, pattern: str) -> Column:
        found = _element_text(tokens, events, _first(named, lambda e: e["cls"].rlike(f"(?i){pattern}")))
        return let(found, lambda t: F.when(F.length(t) > rules.min_vendor_chars, t))

    return let(F.filter(events, lambda e: e["cls"] != ""), lambda n: F.coalesce(*[candidate(n, p) for p in rules.vendor]))


def _sibling_spans(events: Column, after: Column) -> Column:
    """Ranges of the sibling elements after an index, up to the next sibling heading.

    A sibling whose end tag is left out ends at the next sibling or at the parent's end.
    """
    nothing = F.array().cast(_RANGES)
    state = F.struct(
        F.lit("").alias("tag"), F.lit(False).alias("optional"), F.lit(0).alias("depth"), F.lit(0).alias("inner"),
        F.lit(False).alias("done"), F.lit(0).alias("start"), nothing.alias("spans"),
    )

    def step(acc: Column, e: Column) -> Column:
        inside = acc["tag"] != ""

        def moved(end: dict[str, Column]) -> Column:
            top = ~inside | (end["implied"] & ~end["own"])
            stops = top & (((e["kind"] == -1) & ~(inside & e["optional"])) | ((e["kind"] == 1) & e["name"].isin(*_HEADINGS)))
            opens = top & ~stops & (e["kind"] == 1)
            return following(end, {"closes": inside & (end["own"] | end["implied"]), "stops": stops, "opens": opens})

        def following(end: dict[str, Column], now: dict[str, Column]) -> Column:
            return F.struct(
                F.when(now["opens"], e["name"]).when(now["closes"], "").otherwise(acc["tag"]).alias("tag"),
                F.when(now["opens"], e["optional"]).otherwise(acc["optional"]).alias("optional"),
                F.when(now["opens"], 1).otherwise(end["depth"]).alias("depth"),
                F.when(now["opens"], 0).otherwise(end["inner"]).alias("inner"),
                now["stops"].alias("done"),
                F.when(now["opens"], e["i"]).otherwise(acc["start"]).alias("start"),
                F.when(now["closes"], F.concat(acc["spans"], F.array(_range(acc["start"], e["i"]))))
                .otherwise(acc["spans"])
                .alias("spans"),
            )

        after_event = _ending(acc["tag"], acc["optional"], acc["depth"], acc["inner"], e, moved)
        return F.when(~acc["done"] & (e["i"] > after), after_event).otherwise(acc)

    def finish(acc: Column) -> Column:
        last = F.array(_range(acc["start"], F.lit(_LAST)))
        return F.when(~acc["done"] & (acc["tag"] != ""), F.concat(acc["spans"], last)).otherwise(acc["spans"])

    return F.aggregate(events, state, step, finish)


def heading_text(tokens: Column, events: Column, rules: PageRules) -> Column:
    """Texts of the elements that follow section headings, one line per element."""
    marked = F.filter(
        events, lambda e: (e["kind"] == 1) & e["name"].isin(*_HEADINGS, "strong", "b")
    )
    closed = F.transform(marked, lambda e: _range(e["i"], element_end(events, e)))
    sections = F.filter(
        closed, lambda r: range_text(tokens, r["s"], r["e"], " ").rlike(f"(?i){rules.section}")
    )
    chunks = F.flatten(
        F.transform(
            sections,
            lambda r: F.transform(
                _sibling_spans(events, r["e"]), lambda s: range_text(tokens, s["s"], s["e"], " ")
            ),
        )
    )
    found = F.array_join(F.filter(chunks, lambda c: c != ""), "\n")
    if re.search(r"[\^$\\]", rules.section.replace(r"\s", "")):
        return found
    # A pattern without anchors that is nowhere in the page's text is in no heading.
    return F.when(range_text(tokens, F.lit(-1), F.lit(_LAST), " ").rlike(f"(?i){rules.section}"), found).otherwise("")


def blocks(tokens: Column, rules: PageRules) -> Column:
    """Paragraph and list-item texts in order, repeats included."""
    raw = F.regexp_extract_all(F.array_join(tokens, ""), F.lit(_BLOCK_START), F.lit(1))

    def inner(block: Column) -> Column:
        body = F.regexp_replace(block, "^[^>]*>", "")
        return _strip_all(F.split(body, "<[a-zA-Z/!][^>]*>"), " ")

    def wanted(t: Column) -> Column:
        long_enough = F.length(t) >= rules.min_block_chars
        return long_enough if rules.max_block_chars is None else long_enough & (F.length(t) <= rules.max_block_chars)

    return F.filter(F.transform(raw, inner), wanted)


def block_text(tokens: Column, rules: PageRules) -> Column:
    return F.array_join(keep_first_by_prefix(blocks(tokens, rules), rules.block_prefix), "\n")


def body_text(tokens: Column, events: Column) -> Column:
    def bound(marks: Column, name: str, kind: int) -> Column:
        hits = F.filter(marks, lambda e: (e["name"] == name) & (e["kind"] == kind))
        return F.get(hits, F.lit(0))["i"]

    def of_marks(marks: Column) -> Column:
        start = F.coalesce(bound(marks, "body", 1), bound(marks, "head", -1), F.lit(-1))
        end = F.coalesce(bound(marks, "body", -1), F.lit(_LAST))
        return F.struct(start.alias("s"), end.alias("e"))

    marks = F.filter(events, lambda e: e["name"].isin("body", "head"))
    return let(let(marks, of_marks), lambda r: range_text(tokens, r["s"], r["e"], "\n"))


def _choice(text: Column, step: str | Column) -> Column:
    return F.struct(text.alias("text"), (F.lit(step) if isinstance(step, str) else step).alias("step"))


def main_text(html: Column, rules: PageRules = PageRules()) -> Column:
    """``struct<text, step>``: the page's main text and the step that produced it.

    Container, vendor container, section headings, paragraphs, body: later steps run only where
    the earlier ones found nothing, or too little.
    """

    def pick(tok: Column, events: Column) -> Column:
        def after_container(found: Column) -> Column:
            vendor = vendor_text(tok, events, rules)
            return F.when(
                F.length(found) < rules.min_container_chars,
                let(
                    vendor,
                    lambda v: F.when(v.isNotNull(), _choice(v, "vendor")).otherwise(
                        _choice(found, F.when(found == "", "none").otherwise("container"))
                    ),
                ),
            ).otherwise(_choice(found, "container"))

        def filled(c: Column, text: Column, step: str) -> Column:
            return F.when(
                c["text"] == "",
                let(text, lambda t: F.when(t != "", _choice(t, step)).otherwise(c)),
            ).otherwise(c)

        def after_blocks(c: Column) -> Column:
            return F.when(
                F.length(c["text"]) < rules.min_container_chars,
                let(
                    body_text(tok, events),
                    lambda b: F.when(
                        F.length(b) > F.when(c["text"] == "", rules.min_body_chars).otherwise(
                            max(rules.min_body_chars, rules.long_body_chars)
                        ),
                        _choice(F.substring(b, rules.body_skip + 1, _LAST), "body"),
                    ).otherwise(c),
                ),
            ).otherwise(c)

        first = let(container_text(tok, events, rules), after_container)
        second = let(first, lambda c: filled(c, heading_text(tok, events, rules), "headings"))
        third = let(second, lambda c: filled(c, block_text(tok, rules), "blocks"))
        return let(third, after_blocks)

    def of_page(tok: Column, events: Column) -> Column:
        """Noise leaves separators behind, so places stay and the tags are looked at once."""

        def of_kept(kept: Column) -> Column:
            left = F.filter(events, lambda e: F.get(kept, e["i"]) != _GONE)
            return let(left, lambda ev: pick(kept, ev))

        return let(_noise_ranges(events, rules), lambda ranges: let(decoded(_outside(tok, ranges, True)), of_kept))

    chosen = let(tokenize(html), lambda tok: let(tag_events(tok), lambda events: of_page(tok, events)))

    def whole(text: Column) -> Column:
        return text if rules.max_chars is None else T.prefix(text, rules.max_chars)

    return let(chosen, lambda c: _choice(whole(T.normalize(c["text"])), c["step"]))
