"""A small HTML parser: elements with their parents, and the text between them, in page order."""

from __future__ import annotations

import html
import re

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements that text flows through; all others end a block.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Start tags that close an open element of these kinds first.
_P_ENDS = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
_ENDS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "optgroup": ("option", "optgroup"), "thead": ("tr", "td", "th"), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody"), "body": ("head",),
}
#: Elements that an implied end does not look beyond.
_SCOPE = frozenset("ul ol dl table select html body article section div nav aside main header footer form td th button".split())
_P_SCOPE = _SCOPE - {"article", "section", "div", "nav", "aside", "main", "header", "footer", "form", "ul", "ol", "dl"}
_MARKUP = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|</[^>]*(?:>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")


class Dom:
    """``tags``, ``attributes`` (as written) and ``parents`` of each element, 0 being the root; ``texts``: (element, text), where a line break or the end of a block is (element, None)."""

    def __init__(self, source: str):
        self.tags, self.attributes, self.parents = ["#root"], [""], [-1]
        self.texts: list[tuple[int, str | None]] = []
        stack = [0]
        at, end = 0, len(source)
        while at < end:
            m = _MARKUP.search(source, at)
            if m is None:
                self._text(stack[-1], source[at:])
                break
            if m.start() > at:
                self._text(stack[-1], source[at : m.start()])
            at = m.end()
            tag = m[2] or m[5]
            if not tag:
                continue
            if m[5] and not source.endswith(">", 0, m.end()):
                break  # the page ends inside a tag
            tag = tag.lower()
            if m[1] or m[4]:
                self._close(stack, tag)
                continue
            self._open(stack, tag, m[3] or m[6] or "")
            if tag in RAW:
                close = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.IGNORECASE).search(source, at)
                inside = source[at : close.start() if close else end]
                if tag in ("textarea", "title"):
                    self._text(stack[-1], inside)
                stack.pop()
                at = (source.find(">", close.end()) + 1 or end) if close else end
                self._break(stack[-1])

    def _text(self, element: int, text: str) -> None:
        self.texts.append((element, html.unescape(text) if "&" in text else text))

    def _break(self, element: int) -> None:
        if self.texts and self.texts[-1][1] is not None:
            self.texts.append((element, None))

    def _open(self, stack: list[int], tag: str, attributes: str) -> None:
        tags = self.tags
        if tag in _P_ENDS:
            for i in range(len(stack) - 1, 0, -1):
                if tags[stack[i]] == "p":
                    del stack[i:]
                    break
                if tags[stack[i]] in _P_SCOPE:
                    break
        if tag in _ENDS:
            lowest = 0
            for i in range(len(stack) - 1, 0, -1):
                if tags[stack[i]] in _ENDS[tag]:
                    lowest = i
                elif tags[stack[i]] in _SCOPE:
                    break
            if lowest:
                del stack[lowest:]
        if tag not in INLINE:
            self._break(stack[-1])
        if tag not in VOID:
            tags.append(tag)
            self.attributes.append(attributes)
            self.parents.append(stack[-1])
            stack.append(len(tags) - 1)

    def _close(self, stack: list[int], tag: str) -> None:
        if tag == "br":
            return self._break(stack[-1])
        for i in range(len(stack) - 1, 0, -1):
            if self.tags[stack[i]] == tag:
                del stack[i:]
                break
            if tag in INLINE and self.tags[stack[i]] not in INLINE:
                break  # an inline end tag does not close blocks
        if tag not in INLINE:
            self._break(stack[-1])
        return None

    def attribute_values(self, element: int, names: tuple[str, ...] = ("class", "id", "role")) -> str:
        """The values of some attributes of an element, lower-cased, joined by blanks."""
        written = self.attributes[element]
        if "=" not in written:
            return ""
        return " ".join(html.unescape(a or b or c) for n, a, b, c in _ATTRIBUTE.findall(written) if n.lower() in names).lower()

    def hidden(self, element: int) -> bool:
        written = self.attributes[element].lower()
        return bool(written) and bool(re.search(r"(?:^|\s)hidden(?:$|[\s=/])|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", written))
