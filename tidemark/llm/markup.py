"""A small HTML tree for extraction: whole documents in linear passes, with the usual implied end tags."""

from __future__ import annotations

import html
import re

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>""",
    re.S,
)
_UNFINISHED = re.compile(r"<[A-Za-z/!?].*", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: An opening tag ends the open elements named for it, up to the nearest element that bounds them.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
_BOUNDS = frozenset("ul ol menu dl table select article section div aside main body nav".split())
_PROSE_END = BLOCK - {"tr", "td", "th", "tbody", "thead", "tfoot", "option", "caption", "html", "body", "legend"}


class Element:
    """An element with its attributes, parent and children (elements and strings)."""

    __slots__ = ("attributes", "children", "parent", "tag")

    def __init__(self, tag: str, attributes: dict[str, str], parent: Element | None):
        self.tag, self.attributes, self.parent, self.children = tag, attributes, parent, []


def attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(source)}


class _Open:
    """The path of open elements, with the number of them by tag, so that a tag that isn't open costs no search."""

    def __init__(self, root: Element):
        self.node, self.count = root, {}

    def push(self, own: Element) -> None:
        self.node = own
        self.count[own.tag] = self.count.get(own.tag, 0) + 1

    def up_to(self, target: Element) -> None:
        """Ends the elements below target."""
        while self.node is not target:
            self.count[self.node.tag] -= 1
            self.node = self.node.parent

    def has(self, tags) -> int:
        return sum(self.count.get(t, 0) for t in tags)


def parse(source: str | None) -> Element:
    """The tree of a page; a root element without a tag. Broken markup is read as far as it makes sense."""
    root = Element("", {}, None)
    path = _Open(root)
    source = source or ""
    # Behind the last > there can be no tag, so that none is searched for there; what begins one is dropped.
    end = source.rfind(">") + 1
    source = source[:end] + _UNFINISHED.sub("", source[end:])
    at, end = 0, len(source)
    while at < end:
        m = _TOKEN.search(source, at)
        if not m:
            path.node.children.append(html.unescape(source[at:]))
            break
        if m.start() > at:
            path.node.children.append(html.unescape(source[at : m.start()]))
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag = name.lower()
        if m[1] or m[4]:
            if path.has((tag,)):
                target = path.node
                while target.tag != tag:
                    target = target.parent
                path.up_to(target.parent)
            continue
        _implied(path, tag)
        own = Element(tag, attributes(m[3] or m[6] or ""), path.node)
        path.node.children.append(own)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(source, at)
            stop = close.start() if close else end
            own.children.append(source[at:stop] if tag in ("script", "style") else html.unescape(source[at:stop]))
            at = close.end() if close else end
        elif tag not in VOID and not (m[3] or m[6] or "").endswith("/"):
            path.push(own)
    return root


def _implied(path: _Open, tag: str) -> None:
    """Ends what the opening tag ends."""
    if tag in _PROSE_END and path.has("p"):
        up = path.node
        while up.parent and up.tag not in _BOUNDS and up.tag not in ("li", "td", "th", "dd", "blockquote", "figure"):
            if up.tag == "p":
                path.up_to(up.parent)
                break
            up = up.parent
    ends = _ENDS.get(tag)
    left = path.has(ends) if ends else 0
    if left:
        up, target = path.node, None
        while left and up.parent and up.tag not in _BOUNDS:
            if up.tag in ends:
                target, left = up.parent, left - 1
            up = up.parent
        if target is not None:
            path.up_to(target)


def walk(root: Element):
    """(element, True) when it begins, (string, None) for text, (element, False) when it ends; in page order."""
    stack = [(root, iter(root.children))]
    while stack:
        node, rest = stack[-1]
        child = next(rest, None)
        if child is None:
            stack.pop()
            if stack:
                yield node, False
        elif isinstance(child, str):
            yield child, None
        else:
            yield child, True
            stack.append((child, iter(child.children)))
