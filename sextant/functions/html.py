"""Text of the paragraphs of web pages, by a tokenizer that takes malformed pages.

The tokenizer goes from one mark-up character to the next: start and end tags with
quoted and unquoted attributes, comments with their odd endings, declarations and
processing instructions, and elements whose content is no mark-up.  Elements are open
until their end tag, that of one around them, or the end of the page; end tags of
nothing open are ignored, as are those of elements that have no content.  A paragraph
that begins within another one belongs to it as well.

Defined cases: a null page is null; a page without paragraphs has none; a tag that the
page ends in is dropped; what looks like a tag but does not begin with a letter is text;
names of entities are resolved with and without their semicolon, numbers too."""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Fixed values of the language: elements without content, elements whose content is
#: text without mark-up, and those of which even entities stay.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
TEXT_ONLY = frozenset("script style title textarea xmp iframe noembed noframes".split())
NO_ENTITIES = frozenset("script style xmp iframe noembed noframes".split())
#: Elements whose content is not shown.
HIDDEN = frozenset("script style".split())

#: Bytes of pages that are taken apart at a time, about.
PIECE = 1 << 18
_PARAGRAPHS = pa.list_(pa.string())

_NAME = re.compile(r"[A-Za-z][^\t\n\r\f />]*+")
_BETWEEN = re.compile(r"[\t\n\r\f /]*+")
_SPACE = re.compile(r"[\t\n\r\f ]*+")
_KEY = re.compile(r"=?[^\t\n\r\f />=]*+")
_BARE = re.compile(r"[^\t\n\r\f >]*+")
_COMMENT_END = re.compile(r"--!?>")


def _tag_end(page: str, at: int) -> int:
    """Where the tag whose name ends at ``at`` ends, behind its sign; -1 if nowhere."""
    while True:
        at = _BETWEEN.match(page, at).end()
        if at >= len(page):
            return -1
        if page[at] == ">":
            return at + 1
        at = _KEY.match(page, at).end()
        sign = _SPACE.match(page, at).end()
        if sign < len(page) and page[sign] == "=":
            at = _SPACE.match(page, sign + 1).end()
            if at < len(page) and page[at] in "\"'":
                at = page.find(page[at], at + 1) + 1
                if not at:
                    return -1
            else:
                at = _BARE.match(page, at).end()


def _comment_end(page: str, at: int) -> int:
    """Where the comment that begins at ``at`` ends."""
    for short in (">", "->"):
        if page.startswith(short, at + 4):
            return at + 4 + len(short)
    found = _COMMENT_END.search(page, at + 4)
    return found.end() if found else len(page)


def paragraphs(page: str) -> list[str]:
    """Text of each p element, in the order they begin in."""
    text: list[str] = []  # what is shown, end to end
    size = at = 0
    found: list[list[int]] = []  # begin and end of each paragraph in it
    open_now: list[tuple[str, int]] = []  # elements, with the paragraph's number or -1
    count: dict[str, int] = {}

    def show(piece: str, entities: bool = True) -> None:
        nonlocal size
        if piece:
            text.append(html.unescape(piece) if entities and "&" in piece else piece)
            size += len(text[-1])

    def close(name: str) -> None:
        while count.get(name):
            last, number = open_now.pop()
            count[last] -= 1
            if number >= 0:
                found[number][1] = size
            if last == name:
                return

    while at < len(page):
        sign = page.find("<", at)
        if sign < 0:
            show(page[at:])
            break
        name = _NAME.match(page, sign + 1)
        ends = None if name else _NAME.match(page, sign + 2) if page.startswith("</", sign) else None
        if name or ends:
            show(page[at:sign])
            at = _tag_end(page, (name or ends).end())
            if at < 0:
                break
            tag = (name or ends)[0].lower()
            if ends:
                close(tag)
            elif tag in TEXT_ONLY:
                stop = re.compile(rf"</{tag}(?=[\t\n\r\f />])", re.IGNORECASE).search(page, at)
                if tag not in HIDDEN:
                    show(page[at : stop.start() if stop else len(page)], tag not in NO_ENTITIES)
                at = _tag_end(page, stop.end()) if stop else len(page)
                if at < 0:
                    break
            elif tag not in VOID:
                open_now.append((tag, len(found) if tag == "p" else -1))
                count[tag] = count.get(tag, 0) + 1
                if tag == "p":
                    found.append([size, -1])
        elif page.startswith("<!--", sign):
            show(page[at:sign])
            at = _comment_end(page, sign)
        elif page.startswith(("<!", "<?", "</"), sign) and sign + 2 < len(page):
            show(page[at:sign])
            stop = page.find(">", sign + 2)
            at = stop + 1 if stop >= 0 else len(page)
        else:  # a sign of no tag
            show(page[at : sign + 1])
            at = sign + 1
    whole = "".join(text)
    return [whole[a : b if b >= 0 else len(whole)] for a, b in found]


def paragraph_texts(c: Column) -> Column:
    """The paragraphs of each page."""

    @F.arrow_udf(ArrayType(StringType()))
    def f(pages: pa.Array) -> pa.Array:
        return _found(pages)

    return f(c)


def _found(pages: pa.Array) -> pa.Array:
    """The paragraphs of pages, of about ``PIECE`` bytes at a time, so that what a worker
    holds as Python's objects does not follow the size of a batch."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(pages), 0).to_numpy(zero_copy_only=False))
    cuts = [0]
    while cuts[-1] < len(pages):
        before = ends[cuts[-1] - 1] if cuts[-1] else 0
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(ends, before + PIECE, "right"))))
    found = [pa.array([None if page is None else paragraphs(page) for page in pages.slice(a, b - a).to_pylist()], _PARAGRAPHS) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return pa.concat_arrays(found) if found else pa.array([], _PARAGRAPHS)
