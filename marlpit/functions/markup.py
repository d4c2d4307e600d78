"""One pass over HTML: a state machine whose every step consumes what it reads, so that any page takes time linear in its length.

States: data, comment, tag name, attributes, raw text. Every pattern is possessive; what is looked for ahead (the
end of an anchor, of a comment) is remembered until it is passed, so nothing is looked for twice.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

# White space, elements without live content, raw text, containers that switch meta tags off, entities, rel tokens.
SPACE = "\t\n\x0b\x0c\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
OPAQUE = ("script", "style", "template", "noscript", "svg")
RAW = ("script", "style", "title", "textarea")
INERT = ("template", "svg", "math")
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}
NOFOLLOW = {"nofollow", "ugc", "sponsored"}
MOST_TEXT = 300

TAG = re.compile(rf"<(?:(!--)|(/?)([A-Za-z][^{SPACE}/>]*+))")
VALUE = rf"[{SPACE}]*+=[{SPACE}]*+(?:\"[^\"]*+\"?+|'[^']*+'?+|[^{SPACE}>]*+)"
HELD = rf"[{SPACE}]*+=[{SPACE}]*+(?:\"([^\"]*+)\"?+|'([^']*+)'?+|([^{SPACE}>]*+))"
ENTITY = re.compile(r"&(#x?[0-9a-f]++|[a-z][a-z0-9]*+);?", re.I)
MARK = re.compile(r"<[^>]*+>")
BLANKS = re.compile(f"[{SPACE}]++")
STRIPPED = "".join(chr(c) for c in range(0x10000) if BLANKS.match(chr(c)))
LOWER = {k: k + 32 for k in range(ord("A"), ord("Z") + 1)}


@cache
def attribute_step(names: tuple[str, ...]) -> re.Pattern:
    """From within a tag past all attributes but the named ones: then such a name and its value, or the tag's end."""
    named = "|".join(map(re.escape, names))
    other = rf"(?!(?:{named})(?:[{SPACE}=>]|\Z))" if names else ""
    held = rf"({named})(?:{HELD})?+|" if names else ""
    return re.compile(rf"(?:[{SPACE}/]++|{other}[^{SPACE}/=>][^{SPACE}=>]*+(?:{VALUE})?+|{VALUE})*+(?:{held}(>)|\Z)", re.I)


def read_attributes(page: str, at: int, names: tuple[str, ...] = ()) -> tuple[dict[str, str], int, bool]:
    """(values of the named attributes, the place after the tag, whether it closes itself); the first of a name counts, an open quote runs to the end."""
    found: dict[str, str] = {}
    if page[at : at + 1] == ">":
        return found, at + 1, False
    while True:
        missing = tuple(n for n in names if n not in found)
        m = attribute_step(missing).match(page, at)
        at = m.end()
        if missing and m[1]:
            found[m[1].lower()] = m[2] or m[3] or m[4] or ""
        else:
            return found, at, page[at - 2 : at] == "/>"


def decode_entities(text: str) -> str:
    """The named entities of ENTITIES and numbers of characters; all others stay."""

    def one(m: re.Match) -> str:
        body = m[1].lower()
        if not body.startswith("#"):
            return ENTITIES.get(body, m[0])
        digits = body[2:] if body[1:2] == "x" else re.match("[0-9]*", body[1:])[0]
        # Numbers of eight digits and more are beyond all characters.
        code = int(digits, 16 if body[1:2] == "x" else 10) if digits and len(digits.lstrip("0")) < 8 else 0
        return chr(code) if 0 < code <= 0x10FFFF and not 0xD800 <= code < 0xE000 else m[0]

    return ENTITY.sub(one, text) if "&" in text else text


def collapse(text: str) -> str:
    return BLANKS.sub(" ", text).strip(" ")


class Finder:
    """Where a string is next, from places that only grow; the page is searched once."""

    def __init__(self, page: str, sought: str) -> None:
        self.page, self.sought, self.found = page, sought, -2

    def after(self, at: int) -> int:
        if self.found == -2 or -1 < self.found < at:
            self.found = self.page.find(self.sought, at)
        return self.found


class TextRuns:
    """The text of a page's end, between marks, from any place right after a mark."""

    def __init__(self, page: str, begin: int) -> None:
        self.page, self.starts, self.ends, self.texts, at = page, [], [], [], begin
        last = page.rfind(">") + 1
        for m in MARK.finditer(page, begin, max(last, begin)):
            self._add(at, m.start())
            at = m.end()
        self._add(at, len(page))

    def _add(self, start: int, end: int) -> None:
        text = collapse(decode_entities(self.page[start:end]))
        if text:
            self.starts.append(start), self.ends.append(end), self.texts.append(text)

    def text_from(self, at: int, most: int) -> str:
        """The first `most` characters of collapsed text."""
        k, parts, size = bisect_right(self.starts, at) - 1, [], 0
        if k >= 0 and self.starts[k] < at < self.ends[k]:
            # A mark that ends inside a quoted attribute leaves some of it as text before.
            parts = [p for p in [collapse(decode_entities(self.page[at : self.ends[k]]))] if p]
            size = sum(map(len, parts))
            k += 1
        elif k < 0 or self.starts[k] < at:
            k += 1
        while k < len(self.texts) and size < most:
            parts.append(self.texts[k])
            size += len(self.texts[k]) + 1
            k += 1
        return " ".join(parts)[:most]


def anchor_text(page: str, begin: int, end: int, most: int) -> str:
    """The collapsed text of page[begin:end] without marks."""
    text = page[begin:end]
    # Only a mark that is closed is one; beyond the last closing sign none is looked for.
    last = text.rfind(">") + 1
    return collapse(decode_entities(MARK.sub(" ", text[:last]) + text[last:]))[:most]


def lower_ascii(text: str) -> str:
    """text with A-Z lowered, as long as before."""
    return text.translate(LOWER)


def walk_links(page: str, most_text: int = MOST_TEXT) -> Iterator[tuple[str, str, str | None, str]]:
    """(tag, href, text or None, rel) of a page's base tags and of all its anchors, as they stand and one at a time, however many there are.

    Comments and OPAQUE elements hold none. A text runs to the next closing anchor, tags inside it are no anchors;
    without one it is the rest of the page, and the anchors after it count as well.
    """
    lower = lower_ascii(page)
    comments, anchors_end, ends = Finder(page, "-->"), Finder(lower, "</a"), {name: Finder(lower, f"</{name}") for name in OPAQUE}
    runs, at = None, 0
    while m := TAG.search(page, at):
        if m[1]:
            close = comments.after(m.end())
            at = len(page) if close < 0 else close + 3
            continue
        at, name = m.end(), m[3].lower()
        if m[2]:
            continue
        if name in OPAQUE:
            _, at, _ = read_attributes(page, at)
            close = ends[name].after(at)
            at = page.find(">", close) + 1 if close >= 0 else 0
            if not at:
                break
            continue
        found, at, _ = read_attributes(page, at, ("href", "rel") if name == "a" else ("href",) if name == "base" else ())
        if name == "base" and "href" in found:
            yield name, decode_entities(found["href"]), None, ""
        if name != "a":
            continue
        begin, close = at, anchors_end.after(at)
        at = close if close >= 0 else at
        if "href" not in found:
            continue
        if close >= 0:
            text = anchor_text(page, begin, close, most_text)
        else:
            runs = runs or TextRuns(page, begin)
            text = runs.text_from(begin, most_text)
        yield name, decode_entities(found["href"]), text or None, lower_ascii(found.get("rel", ""))


def scan_links(page: str, most: int | None = None, most_text: int = MOST_TEXT) -> tuple[list[tuple[int, str]], list[tuple[int, str, str | None, str]]]:
    """(bases, anchors) of a page: the hrefs of its base tags with how many anchors stood before, and (bases before, href, text or None, rel) of its anchors, all of them unless `most` says otherwise."""
    bases, anchors = [], []
    for tag, href, text, rel in walk_links(page, most_text):
        if tag == "base":
            bases.append((len(anchors), href))
        elif most is None or len(anchors) < most:
            anchors.append((len(bases), href, text, rel))
        else:
            break
    return bases, anchors


def is_nofollow(rel: str) -> bool:
    return not NOFOLLOW.isdisjoint(BLANKS.split(rel))


def scan_metas(page: str, name: str) -> Iterator[str]:
    """The trimmed contents of the meta tags of a name in the page's head, in order.

    The head ends with its closing tag or where the body begins. Tags in comments, RAW text and INERT containers
    don't count; a closing tag closes all containers that were opened inside its own.
    """
    lower, wanted = lower_ascii(page), name.lower()
    comments, ends = Finder(page, "-->"), {k: Finder(lower, f"</{k}") for k in RAW}
    opened: list[str] = []
    at = 0
    while m := TAG.search(page, at):
        if m[1]:
            close = comments.after(m.end())
            at = len(page) if close < 0 else close + 3
            continue
        at, tag = m.end(), m[3].lower()
        if m[2]:
            if tag in opened:
                while opened.pop() != tag:
                    pass
            continue
        found, at, closed = read_attributes(page, at, ("name", "content") if tag == "meta" else ())
        if tag == "body" and opened[-1:] == ["head"]:
            opened.pop()
        elif tag == "meta" and "head" in opened and not any(k in opened for k in INERT):
            if "content" in found and decode_entities(found.get("name", "")).strip(STRIPPED).lower() == wanted:
                yield decode_entities(found["content"]).strip(STRIPPED)
        elif (tag == "head" or tag in INERT) and not closed:
            # Deeper nesting than this has no other meaning.
            if len(opened) < 512:
                opened.append(tag)
        elif tag in RAW and not closed:
            close = ends[tag].after(at)
            if close < 0:
                return
            at = close

