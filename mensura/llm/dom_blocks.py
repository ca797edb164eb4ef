"""HTML to leaf blocks: runs of text between the tags of block elements, with their ancestors.

One pass from left to right over tags and text, with the end tags that HTML lets authors leave
out. Inline elements aren't kept as ancestors, so the depth of the stack is that of block
elements. Every step looks at the top of the stack only or pops what it passes, so the time is
linear in the page.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass
from functools import cache

#: HTML's elements by how a parser treats them.
BLOCK = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol optgroup option p pre section select summary table tbody
td tfoot th thead tr ul""".split())
DROPPED = frozenset("head iframe math noembed noframes object script style svg template textarea title xmp".split())
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: What a start tag ends where it stands directly inside.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "optgroup": {"option", "optgroup"},
        "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}, "tbody": {"td", "th", "tr", "thead", "tbody"},
        "tfoot": {"td", "th", "tr", "thead", "tbody"}, "thead": {"caption"}}
SCOPE = frozenset("td th caption table html body".split())
IN_TABLE = SCOPE | frozenset("tr tbody thead tfoot".split())
IN_LINE = frozenset("button label option optgroup select".split())        # blocks that stand inside a paragraph

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_ATTRS = re.compile(r"""(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+>""")      # possessive: no second way to match
_ATTR = re.compile(r"""([^\s"'>/=]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|>|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_NAMED = ("class", "id", "role", "itemprop")


class Element:
    """A block element on the stack: its tag, what it and its ancestors are named, and its place in the page."""

    __slots__ = ("tag", "marks", "near", "key", "up")

    def __init__(self, tag: str, own: frozenset, parent: Element | None, key: int):
        self.tag, self.key, self.up = tag, key, parent.key if parent else -1
        above = parent.marks if parent else frozenset()
        self.marks = above if own <= above else above | own                     # of the element and all above it
        self.near = own if len(own) > 1 or not parent else parent.near          # of the nearest that has a name


@dataclass
class Block:
    """A leaf block: its text, the characters of it inside links, and the element that holds it."""

    text: str
    linked: int
    element: Element


def marks_of(tag: str, attrs: str) -> frozenset:
    """The tag and the words of its class, id, role and itemprop, in lower case, each also without a plural s."""
    found = {f"t={tag}"}
    if attrs.strip(" /"):
        for name, a, b, c in _ATTR.findall(attrs):
            if name.lower() in _NAMED:
                for word in map(str.lower, _WORDS.findall(a or b or c)):
                    found.add(f"c={word}")
                    if len(word) > 2 and word[-1] == "s":
                        found.add(f"c={word[:-1]}")
                    if len(word) > 4:
                        found.add(f"p={word[:4]}")
        if _HIDDEN.search(attrs):
            found.add("hidden")
    return frozenset(found)


class _Names(dict):
    """Memo of ``marks_of`` in one page."""

    def __missing__(self, key: tuple[str, str]) -> frozenset:
        self[key] = got = marks_of(*key)
        return got


def parse(page: str | None) -> tuple[list[Block], str]:
    """(leaf blocks in page order, the text of the title element)."""
    blocks: list[Block] = []
    if not page:
        return blocks, ""
    names, root = _Names(), Element("#root", frozenset(), None, 0)
    stack, counts = [root], {}
    pieces: list[str] = []
    linked, in_link, made, title, careful = 0, False, 0, "", True
    unclosed: set[str] = set()
    at, size = 0, len(page)

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                blocks.append(Block(text, min(linked, len(text)), stack[-1]))
            pieces.clear()
        linked = 0

    def pop() -> None:
        counts[stack.pop().tag] -= 1

    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            lt = size
        if lt > at:
            chunk = page[at:lt]
            if "&" in chunk:
                chunk = html.unescape(chunk)
            pieces.append(chunk)
            if in_link:
                linked += len(chunk.strip())
            at = lt
            if at == size:
                break
        if page.startswith("<!--", at):
            end = page.find("-->", at + 2)          # "<!-->" is a whole comment
            at = size if end < 0 else end + 3
            continue
        name = _NAME.match(page, at + 1)
        if not name:
            if page.startswith(("<!", "<?", "</"), at):
                end = page.find(">", at)
                at = size if end < 0 else end + 1
            else:
                pieces.append("<")
                at += 1
            continue
        closing, tag = bool(name[1]), name[2].lower()
        rest = name.end()
        end = page.find(">", rest)
        if end > 0 and careful and ('"' in page[rest:end] or "'" in page[rest:end]):
            whole = _ATTRS.match(page, rest)
            careful = whole is not None             # a quote that nothing closes: from here on, tags end at the next >
            end = whole.end() - 1 if whole else end
        if end < 0:
            break                                   # a tag that the page cuts off
        attrs = page[rest:end]
        at = end + 1
        if not closing and tag in DROPPED and not attrs.endswith("/"):
            if tag == "head":
                continue                            # its elements are dropped one by one
            close = -1 if tag in unclosed else _find_close(page, tag, at)
            if close < 0:
                unclosed.add(tag)
                if tag not in RAW:
                    continue
                close = size
            if tag == "title" and not title:
                title = " ".join(html.unescape(page[at:close]).split())
            at = page.find(">", close) + 1 or size
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        if tag == "a":
            in_link = not closing
        if tag not in BLOCK:
            continue
        flush()
        if closing:
            if counts.get(tag):
                bounds = frozenset() if tag in IN_TABLE else SCOPE
                depth = len(stack) - 1
                while stack[depth].tag != tag and stack[depth].tag not in bounds:
                    depth -= 1
                if stack[depth].tag == tag:
                    while len(stack) > depth:
                        pop()
            in_link = False
            continue
        if stack[-1].tag == "p" and tag not in IN_LINE:
            pop()
        ends = ENDS.get(tag)
        while ends and stack[-1].tag in ends:
            pop()
        if tag in VOID or (tag in ("html", "body") and counts.get(tag)):
            continue
        made += 1
        stack.append(Element(tag, names[tag, attrs], stack[-1], made))
        counts[tag] = counts.get(tag, 0) + 1
    flush()
    return blocks, title


@cache
def _closing(tag: str) -> re.Pattern:
    return re.compile(f"</{re.escape(tag)}", re.I)


def _find_close(page: str, tag: str, at: int) -> int:
    found = _closing(tag).search(page, at)
    return found.start() if found else -1
