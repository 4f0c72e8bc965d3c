"""Leaf blocks of a page: runs of text between block boundaries, each with the elements that it stands in."""

import html
import re
from typing import NamedTuple

# Elements of HTML by their kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript object ol optgroup option p pre search section "
    "select summary table tbody td tfoot th thead tr ul".split()
)
#: Their content is no text of the page.
HIDDEN = frozenset("script style template textarea title svg math iframe object canvas audio video noembed noframes xmp".split())
#: What an open element of the key is closed by, and what stops the search for it.
CLOSED_BY = {
    "p": (BLOCKS - {"button", "option", "optgroup", "html", "head", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend"}, {"button", "td", "th", "table", "caption"}),
    "li": ({"li"}, {"ul", "ol", "menu", "dir", "table", "td"}),
    "dt": ({"dt", "dd"}, {"dl", "table", "td"}),
    "dd": ({"dt", "dd"}, {"dl", "table", "td"}),
    "option": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th", "tr", "tbody", "thead", "tfoot"}, {"table"}),
    "th": ({"td", "th", "tr", "tbody", "thead", "tfoot"}, {"table"}),
    "tr": ({"tr", "tbody", "thead", "tfoot"}, {"table"}),
    "head": ({"body"}, set()),
}
CLOSES = {opened: [(old, stop) for old, (by, stop) in CLOSED_BY.items() if opened in by] for opened in BLOCKS}
#: An end tag doesn't reach over these, unless it is one of a table's own.
SCOPE = frozenset(["table", "td", "th", "caption"])
TABLE = frozenset("table caption tbody thead tfoot tr td th".split())

_TAG = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))
    |<[!?][^>]*+>?
    |<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+|(?=>))|["'])*+)>
    |<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""",
    re.S | re.X,
)
_NAMES = re.compile(r"""\b(class|id|role|hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Block(NamedTuple):
    text: str
    where: "Place"
    linked: float  # share of its characters inside links


class Place:
    """An open element and all that it stands in: tag, the names of its class, id and role, and what it is hidden by."""

    __slots__ = ("inside", "names", "parent", "tag", "tags", "within")

    def __init__(self, parent: "Place | None", tag: str, attributes: str):
        self.parent, self.tag, self.names = parent, tag, frozenset(_names(attributes)) if attributes else frozenset()
        self.tags = (parent.tags if parent else frozenset()) | {tag}
        self.within = (parent.within if parent else frozenset()) | self.names
        self.inside: dict[tuple[str, str], Place] = {}


def _names(attributes: str) -> set[str]:
    found = set()
    for name, value in _NAMES.findall(attributes):
        value = value.strip("\"'")
        if name.lower() == "hidden" or name.lower() == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            found.add("(hidden)")
        elif name.lower() != "style":
            found.update(w.lower() for w in _WORD.findall(value))
    return found


def squeeze(text: str) -> str:
    """Character references decoded, white space one space, ends trimmed."""
    return " ".join((html.unescape(text) if "&" in text else text).split())


def blocks(page: str, root: Place) -> list[Block]:
    """The leaf blocks in page order. root stands for the document; places below it are kept in it and found again on other
    pages. Unclosed, stray and crossing tags are taken as browsers take them; comments, scripts, styles and other content
    that is no text are left out; a line break is white space."""
    found: list[Block] = []
    stack, open_tags = [root], {}
    pieces: list[str] = []
    linked, in_link, at = 0, False, 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            raw = "".join(pieces)
            if text := squeeze(raw):
                found.append(Block(text, stack[-1], linked / len(raw)))
            pieces.clear()
        linked = 0

    def close(tag: str, stop) -> None:
        if not open_tags.get(tag):
            return
        for k in range(len(stack) - 1, 0, -1):
            name = stack[k].tag
            if name == tag:
                flush()
                for p in stack[k:]:
                    open_tags[p.tag] -= 1
                del stack[k:]
                return
            if name in stop:
                return

    while True:
        m = _TAG.search(page, at)
        end = m.start() if m else len(page)
        if end > at:
            pieces.append(page[at:end])
            if in_link:
                linked += end - at
        if not m:
            break
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, ends = tag.lower(), m[1] or m[4]
        if tag in BLOCKS or tag in HIDDEN:
            if ends:
                if tag in BLOCKS:
                    flush()
                    close(tag, {"table"} - {tag} if tag in TABLE else SCOPE)
                continue
            flush()
            for old, stop in CLOSES.get(tag, ()):
                close(old, stop)
            attributes = m[3] if m[2] else m[6]
            if tag in HIDDEN:
                if not attributes.endswith("/"):
                    over = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
                    at = over.end() if over else len(page)
            elif tag not in VOID:
                here = stack[-1]
                if (place := here.inside.get((tag, attributes))) is None:
                    place = here.inside[tag, attributes] = Place(here, tag, attributes)
                stack.append(place)
                open_tags[tag] = open_tags.get(tag, 0) + 1
        elif tag == "br":
            pieces.append(" ")
        elif tag == "a":
            in_link = not ends
    flush()
    return found
