"""Cuts raw html into leaf blocks with their tag paths."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

#: Elements whose start and end part one block from the next.
BLOCK = frozenset(
    "address article aside blockquote body button center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol option p pre section select summary table "
    "tbody td tfoot th thead title tr ul".split()
)
#: Elements whose content is never text of the page; the first kind goes on to the end of a page that doesn't close it.
RAW = frozenset("script style noscript iframe textarea title".split())
HIDDEN = frozenset("template object svg math canvas select audio video".split())
#: Start tags that may stand in head; any other one, and text, ends it.
IN_HEAD = frozenset("base basefont bgsound link meta title noscript style script template noframes head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag of the first kind ends an open one of these, up to the nearest of the limits.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: Block elements that may stand inside an open paragraph.
IN_PARAGRAPH = frozenset("button label option select".split())

_OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
#: A tag's inside: quotes count where they begin a value.
_INSIDE = re.compile(r"(?:[^>\"'=]++|=\s*+(?:\"[^\"]*\"|'[^']*')|[\"'=])*+")
#: Foreign elements: these alone may be closed by a slash.
_FOREIGN = frozenset(["svg", "math"])
#: Start tags that end foreign elements, save behind one that takes html in, and those that end an open select.
_BREAKS_OUT = re.compile(
    r"<(?:b|big|blockquote|body|br|center|code|dd|div|dl|dt|em|embed|h[1-6]|head|hr|i|img|li|listing|menu|meta|nobr|ol|p|pre|ruby|s|small|span|strong|strike|sub|sup|table|tt|u|ul|var"
    r"|article|aside|footer|header|main|nav|section)(?=[\s/>])", re.I)
_TAKES_HTML = re.compile(r"<(?:foreignobject|desc|title|annotation-xml)(?=[\s/>])", re.I)
_ENDS_SELECT = re.compile(r"<(?:" + "|".join(sorted(BLOCK - {"option", "hr", "button", "legend", "div", "head", "html"})) + r"|input|textarea)(?=[\s/>])", re.I)
#: The end of a comment behind its <!--, which may be empty.
_COMMENT_END = re.compile(r"(?<=<!--)-?>|--!?>")
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*")


def _tags(page: str, start: int) -> Iterator[tuple[int, int, bool, str | None, str]]:
    """(start, end, whether it closes, tag or None for a comment or declaration, what stands in the tag) from `start` on.

    The page is read forward once: a tag ends at the first > outside quoted
    values, or, where a quote is never closed, at the first > of all; a tag
    that the page's end cuts off is a comment. Takes the place to go on from
    by `send`.
    """
    at, last, quoted = start, page.rfind(">"), True
    while (p := page.find("<", at)) >= 0:
        m = _OPEN.match(page, p)
        if m is None:
            if page.startswith("<!--", p):
                m = _COMMENT_END.search(page, p + 4)
                end = m.end() if m else len(page)
            elif page[p + 1 : p + 2] in ("!", "?", "/"):
                end = page.find(">", p) + 1 or len(page)
            else:
                at = p + 1
                continue
            found = (p, end, False, None, "")
        elif p > last:
            found = (p, end := len(page), False, None, "")
        else:
            end = _INSIDE.match(page, m.end()).end() if quoted else len(page)
            if end == len(page):
                quoted = False
                end = page.find(">", m.end())
            found = (p, end + 1, bool(m[1]), m[2].lower(), page[m.end() : end])
            end += 1
        at = (yield found) or end


def _path_tokens(tag: str, attrs: str) -> tuple[str, ...]:
    if "=" not in attrs:
        return (tag,)
    words = []
    for m in _NAMES.finditer(attrs):
        words += [w.lower() for w in _PARTS.findall(m[1] or m[2] or m[3] or "")]
    return (tag, *("." + w for w in words))


def leaf_blocks(page: str | None) -> list[tuple[tuple[str, ...], str, float]]:
    """(path, text, share of its characters inside links) of each block with text, in page order.

    The path holds, from the outside in, each open element's tag and the
    words of its class, id and role. Markup that isn't closed, closes nothing
    or is cut off is borne; what stands in scripts, styles and the like is
    skipped up to their end tag or the end of the page. Time grows with the
    page's length alone.
    """
    page = page or ""
    out: list[tuple[tuple[str, ...], str, float]] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    text: list[str] = []
    linked = 0
    in_link = in_head = False
    ahead: dict[str, re.Match | None] = {}

    def flush() -> None:
        nonlocal text, linked
        if text:
            words = " ".join("".join(text).split())
            if words:
                out.append((tuple(t for _, ts in stack for t in ts), words, min(1.0, linked / len(words))))
        text, linked = [], 0

    def add(s: str) -> None:
        nonlocal linked
        if s:
            s = entities.unescape(s) if "&" in s else s
            text.append(s)
            if in_link:
                linked += len(s.strip())

    def pop_to(k: int) -> None:
        flush()
        del stack[k:]

    def leave_head() -> None:
        nonlocal in_head
        in_head = False
        k = next((k for k, (t, _) in enumerate(stack) if t == "head"), None)
        if k is not None:
            pop_to(k)

    def next_match(name: str, rule: re.Pattern, at: int) -> re.Match | None:
        """The first match from `at` on; what was found or missed before isn't looked for again."""
        if name not in ahead or (ahead[name] is not None and ahead[name].start() < at):
            ahead[name] = rule.search(page, at)
        return ahead[name]

    def hidden_end(tag: str, at: int) -> int:
        """Where an element of HIDDEN whose start tag ends at `at` ends itself."""
        close = next_match("/" + tag, re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I), at)
        out = None
        if tag == "select":
            out = next_match("select", _ENDS_SELECT, at)
        elif tag in _FOREIGN:
            out = next_match("foreign", _BREAKS_OUT, at)
            holds = next_match("holds", _TAKES_HTML, at)
            if out and close and holds and holds.start() < out.start():
                out = None
        if out and (close is None or out.start() < close.start()):
            return out.start()
        if close:
            return close.end()
        return len(page) if tag == "select" or tag in _FOREIGN else at

    def opens(tag: str, inside: str, in_link: bool) -> bool:
        """Takes a start tag in; whether text behind it is a link's."""
        if tag == "br":
            text.append(" ")
        if tag not in BLOCK:
            return in_link or tag == "a"
        flush()
        if tag in ENDS:
            inner, limit = ENDS[tag]
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in limit:
                    break
                if stack[k][0] in inner:
                    pop_to(k)
                    break
        elif tag not in IN_PARAGRAPH:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    pop_to(k)
                    break
                if stack[k][0] in ("td", "th", "button", "li", "div"):
                    break
        if tag not in VOID:
            stack.append((tag, _path_tokens(tag, inside)))
        return False

    at = 0
    tags = _tags(page, 0)
    found = next(tags, None)
    while found:
        start, end, closes, tag, inside = found
        if in_head and ((tag and not closes and tag not in IN_HEAD) or page[at:start].strip()):
            leave_head()
        add(page[at:start])
        at = end
        if tag is None:
            pass
        elif closes:
            if tag == "a":
                in_link = False
            if tag in BLOCK:
                in_head = in_head and tag != "head"
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        pop_to(k)
                        break
                else:
                    flush()
        elif tag in RAW:
            close = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else len(page)
        elif tag in HIDDEN:
            if not (tag in _FOREIGN and inside.endswith("/")):
                at = hidden_end(tag, at)
        else:
            in_head = in_head or tag == "head"
            in_link = opens(tag, inside, in_link)
        try:
            found = tags.send(at)
        except StopIteration:
            break
    if in_head and page[at:].strip():
        leave_head()
    add(page[at:])
    flush()
    return out
