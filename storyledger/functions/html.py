"""HTML as text: tags, attributes, entities and visible text, with native regular expressions.

Quantifiers over groups are possessive, which Java runs as loops: no deep recursion on long
pages, and no backtracking. Elements may nest in elements of the same name to any depth: a page where
they do is read as a stream of tags with a running depth, and an element ends at the next tag of its
own name and depth. Pages without such nesting take one flat pattern, which gives the same.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from storyledger.functions.steps import let
from storyledger.functions.text import collapse_space, web_trim

# The inside of a tag; quoted values may hold '>'.
INSIDE = r"""(?:[^<>"']++|"[^"]*+"|'[^']*+')*+"""
INVISIBLE = (
    r"(?is)<!--.*?-->|<!\[CDATA\[.*?\]\]>"
    r"|<script\b[^>]*+>.*?</script\s*+>|<style\b[^>]*+>.*?</style\s*+>"
    r"|<(?:noscript|template)\b[^>]*+>.*?</(?:noscript|template)\s*+>"
)
TAG = rf"<[/!?A-Za-z]{INSIDE}>"
NAME = r"[A-Za-z][A-Za-z0-9:-]*+"
NAME_ENDS = r"(?![A-Za-z0-9:-])"


def without_invisible(html: Column) -> Column:
    """Drop comments, scripts and styles, so that no tag inside them counts and text around them joins."""
    return F.regexp_replace(html, INVISIBLE, "")


def _entities() -> Column:
    """Named references as a constant map."""
    pairs = [f"&{name};\x02{chr(code)}" for name, code in sorted(name2codepoint.items())]
    return F.str_to_map(F.lit("\x01".join([*pairs, "&apos;\x02'"])), F.lit("\x01"), F.lit("\x02"))


def unescape(col: Column) -> Column:
    """Decode named and numeric character references; unknown ones stay as they are."""
    table = _entities()

    def decoded(token: Column) -> Column:
        decimal = F.regexp_extract(token, r"^&#([0-9]{1,7});$", 1).try_cast("int")
        hexadecimal = F.regexp_extract(token, r"^&#[xX]([0-9A-Fa-f]{1,6});$", 1)
        code = F.coalesce(decimal, F.conv(F.when(hexadecimal != "", hexadecimal), 16, 10).try_cast("int"))
        valid = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return (
            F.when(~token.rlike("^&."), token)
            .when(token.startswith("&#"), F.coalesce(F.when(valid, char), token))
            .otherwise(F.coalesce(F.try_element_at(table, token), token))
        )

    def all_decoded(text: Column) -> Column:
        tokens = F.regexp_extract_all(text, F.lit(r"(&#?[A-Za-z0-9]+;|[^&]+|&)"), F.lit(1))
        return F.array_join(F.transform(tokens, decoded), "")

    return let(col, lambda c: F.when(c.contains("&"), all_decoded(c)).otherwise(c))


def strip_tags(html: Column, replacement: str = "") -> Column:
    return F.regexp_replace(html, TAG, replacement)


def text_of(html: Column) -> Column:
    """Text content of a fragment: tags dropped, references decoded, white space collapsed."""
    return web_trim(collapse_space(unescape(strip_tags(html))))


def tags(html: Column, name: str) -> Column:
    """Every opening tag with this name, as text."""
    return F.regexp_extract_all(html, F.lit(rf"(?is)(<{name}\b{INSIDE}>)"), F.lit(1))


def attr(tag: Column, name: str) -> Column:
    """Value of an attribute of a tag, the first of that name; null when it is absent.

    Attributes are stepped over from the left, so a look-alike inside the value of another one does not count.
    """
    value_of = r"""(?:"[^"]*+"|'[^']*+'|[^\s"'>]++)"""
    other = rf"""[\s/"'=]++|(?!{name}\s*+=)[^\s=>/"']++(?:\s*+=\s*+{value_of})?+"""
    found = rf"""(?is)^<[^\s>/"']++(?:{other})*+{name}\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""

    def value(t: Column) -> Column:
        text = F.concat(*[F.regexp_extract(t, found, i) for i in (1, 2, 3)])
        return F.when(t.rlike(found), unescape(text))

    return let(tag, value)


def opening_tag(element: Column) -> Column:
    """The opening tag of an element."""
    return F.regexp_extract(element, rf"(?s)^(<{INSIDE}>)", 1)


def running(values: Column) -> Column:
    """Running sums of an array of numbers.

    An array that grows by one is copied each time, so sums are taken within blocks of about the square root of the
    length, and of the blocks' totals: a long page costs its length times that root, not its square.
    """
    none = F.array().cast("array<int>")

    def sums(numbers: Column) -> Column:
        return F.aggregate(numbers, none, lambda done, x: F.array_append(done, F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0)) + x))

    def blocked(numbers: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(numbers))).cast("int")
        last = F.floor((F.size(numbers) - 1) / width).cast("int")
        inner = F.transform(F.sequence(F.lit(0), last), lambda i: sums(F.slice(numbers, i * width + 1, width)))

        def joined(blocks: Column) -> Column:
            totals = sums(F.transform(blocks, lambda b: F.element_at(b, -1)))
            return let(totals, lambda t: F.flatten(F.transform(blocks, lambda b, i: F.transform(b, lambda x: x + F.when(i > 0, F.get(t, i - 1)).otherwise(0)))))

        return let(inner, joined)

    return let(values, lambda v: F.when(F.size(v) <= 16, sums(v)).otherwise(blocked(v)))


def tag_stream(html: Column, names: str = NAME) -> Column:
    """Tags in page order: lower-case ``name``, ``at`` and ``stop`` (characters), ``step`` (1 opens, -1 closes), ``tag``.

    Only tags whose name matches the pattern ``names`` are in it; the page is cut into these and what is between them.
    """
    tag = rf"<(?:{names}){NAME_ENDS}{INSIDE}>|</(?:{names})\s*+>"
    pieces = rf"(?is){tag}|(?:[^<]++|<(?!/?(?:{names}){NAME_ENDS}))++|<"

    def placed(tokens: Column) -> Column:
        ends = running(F.transform(tokens, F.char_length))
        every = F.zip_with(tokens, ends, lambda t, e: F.struct(
            F.lower(F.regexp_extract(t, rf"^</?({NAME})", 1)).alias("name"),
            (e - F.char_length(t)).alias("at"), e.alias("stop"),
            F.when(t.rlike("^</"), -1).otherwise(1).alias("step"), t.alias("tag"),
        ))
        return F.filter(every, lambda t: t["tag"].rlike(rf"(?is)^(?:{tag})$"))

    return let(F.regexp_extract_all(html, F.lit(pieces), F.lit(0)), placed)


def element_spans(stream: Column) -> Column:
    """``at``, ``inner`` (end of the opening tag), ``stop`` and ``tag`` of every closed element of a tag stream, by ``at``.

    By name and place, a running sum of steps is the depth. Of the tags of one name and depth, an opening one and
    the next, if that closes, are one element: whatever lies between is deeper. Tags that close nothing shift
    the depth of all that follow alike.
    """
    def levelled(ordered: Column) -> Column:
        depth = running(F.transform(ordered, lambda t: t["step"]))
        return F.array_sort(F.zip_with(ordered, depth, lambda t, d: F.struct(
            t["name"].alias("name"), (d + F.when(t["step"] < 0, 1).otherwise(0)).alias("depth"),
            t["at"].alias("at"), t["stop"].alias("stop"), t["step"].alias("step"), t["tag"].alias("tag"),
        )))

    def paired(tags_by_depth: Column) -> Column:
        after = F.slice(tags_by_depth, F.lit(2), F.greatest(F.size(tags_by_depth), F.lit(1)))
        both = F.zip_with(tags_by_depth, after, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        closed = F.filter(both, lambda p: (p["a"]["step"] == 1) & (p["b"]["step"] == -1) & (p["a"]["name"] == p["b"]["name"]) & (p["a"]["depth"] == p["b"]["depth"]))
        return F.array_sort(F.transform(closed, lambda p: F.struct(
            p["a"]["at"].alias("at"), p["a"]["stop"].alias("inner"), p["b"]["stop"].alias("stop"), p["a"]["tag"].alias("tag"),
        )))

    return let(levelled(F.array_sort(stream)), paired)


def _between(html: Column, at: Column, stop: Column) -> Column:
    return F.substr(html, at + 1, stop - at)


def _flat(opening: str, group: int) -> str:
    """Pattern of an element (opening tag with its name in ``group``) up to its end tag, if no tag of its name comes first."""
    return rf"{opening}(?:[^<]++|<(?!/?\{group}{NAME_ENDS}))*+"


def nested(html: Column, names: str) -> Column:
    """Whether an element with one of these names is followed by another opening tag of its name before it ends."""
    return html.rlike(rf"(?is){_flat(rf'<({names}){NAME_ENDS}{INSIDE}>', 1)}<\1{NAME_ENDS}")


def _flat_elements(html: Column, name: str) -> Column:
    opening = rf"<({name}){NAME_ENDS}{INSIDE}>"
    return F.regexp_extract_all(html, F.lit(rf"(?is)({_flat(opening, 2)}</\2\s*+>)"), F.lit(1))


def elements(html: Column, name: str) -> Column:
    """Every closed element with this name, inner ones included, as HTML."""
    deep = F.transform(element_spans(tag_stream(html, name)), lambda e: _between(html, e["at"], e["stop"]))
    return F.when(nested(html, name), deep).otherwise(_flat_elements(html, name))


def longest_element(html: Column, name: str) -> Column:
    """The longest element with this name, the first of equally long ones; empty without one."""
    def span(e: Column) -> Column:
        return e["stop"] - e["at"]

    flat = F.aggregate(
        _flat_elements(html, name), F.lit(""), lambda best, e: F.when(F.char_length(e) > F.char_length(best), e).otherwise(best)
    )
    # Nested elements are not cut out one by one, which would cost their depth times their length.
    none = F.struct(F.lit(0).alias("at"), F.lit(0).alias("inner"), F.lit(0).alias("stop"), F.lit("").alias("tag"))
    best = F.aggregate(element_spans(tag_stream(html, name)), none, lambda a, b: F.when(span(b) > span(a), b).otherwise(a))
    return F.when(nested(html, name), let(best, lambda b: _between(html, b["at"], b["stop"]))).otherwise(flat)


def without_elements(html: Column, names: tuple[str, ...]) -> Column:
    """Drop whole elements with these names, from left to right; tags that are not closed stay."""
    choice = "|".join(names)
    flat = F.regexp_replace(html, rf"(?is){_flat(rf'<({choice}){NAME_ENDS}{INSIDE}>', 1)}</\1\s*+>", "")
    start = F.struct(F.lit(0).alias("from"), F.array().cast("array<struct<from:int,to:int>>").alias("kept"))

    def step(done: Column, e: Column) -> Column:
        gap = F.struct(done["from"].alias("from"), e["at"].alias("to"))
        grown = F.struct(e["stop"].alias("from"), F.array_append(done["kept"], gap).alias("kept"))
        return F.when(e["at"] >= done["from"], grown).otherwise(done)

    def rest(done: Column) -> Column:
        shown = F.transform(done["kept"], lambda g: _between(html, g["from"], g["to"]))
        return F.concat(F.array_join(shown, ""), F.substr(html, done["from"] + 1, F.char_length(html)))

    deep = let(F.aggregate(element_spans(tag_stream(html, choice)), start, step), rest)
    return F.when(nested(html, choice), deep).otherwise(flat)


def elements_with(html: Column, condition: str) -> Column:
    """Every element with an attribute that matches ``condition``, in page order; unclosed and void ones as their tag only."""
    # Step over quoted values until the condition holds: a possessive loop, so no recursion.
    seen = rf"""(?:(?!{condition})(?:[^<>"']|"[^"]*+"|'[^']*+'))*+{condition}"""

    def opening(name: str) -> str:
        return rf"<{name}{NAME_ENDS}(?={seen}){INSIDE}>"

    flat = F.regexp_extract_all(html, F.lit(rf"(?is)(?=({_flat(opening(f'({NAME})'), 2)}</\2\s*+>|{opening(NAME)}))<"), F.lit(1))
    inner = rf"(?is){_flat(opening(f'({NAME})'), 1)}<\1{NAME_ENDS}"

    def with_ends(stream: Column) -> Column:
        hits = F.filter(stream, lambda t: (t["step"] == 1) & t["tag"].rlike(f"(?is)^{opening(NAME)}"))

        def cut(hits: Column) -> Column:
            names = F.array_distinct(F.transform(hits, lambda t: t["name"]))
            spans = element_spans(F.filter(stream, lambda t: F.array_contains(names, t["name"])))
            ends = F.map_from_entries(F.transform(spans, lambda e: F.struct(e["at"].alias("key"), e["stop"].alias("value"))))
            return let(ends, lambda m: F.transform(hits, lambda t: _between(html, t["at"], F.coalesce(F.try_element_at(m, t["at"]), t["stop"]))))

        return let(hits, cut)

    return F.when(html.rlike(inner), let(tag_stream(html), with_ends)).otherwise(flat)
