"""Markdown as leaf blocks in reading order, with containers opened: quotes, lists in lists, code, headings, paragraphs.

Follows the published CommonMark rules. A paragraph of a tight list is no paragraph of its own.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

Line = tuple[str, int]

_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))??(?:[ \t]+#+)?[ \t]*$")
_FENCE = re.compile(r"( {0,3})(`{3,}(?=[^`]*$)|~{3,})")
_RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_QUOTE = re.compile(r" {0,3}> ?")
_ITEM = re.compile(r" {0,3}(?:([-*+])|(\d{1,9})([.)]))(?=[ \t]|$)")
_RAW = re.compile(r" {0,3}<(script|pre|style|textarea)(?=[\s>]|$)", re.IGNORECASE)
# Elements that start a block of HTML, by the CommonMark specification.
_ELEMENTS = (
    "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame "
    "frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu menuitem nav noframes ol optgroup option p param search section summary "
    "table tbody td tfoot th thead title tr track ul"
)
_ELEMENT = re.compile(rf" {{0,3}}</?(?:{'|'.join(_ELEMENTS.split())})(?=[\s>]|/>|$)", re.IGNORECASE)
_TAG_ALONE = re.compile(r" {0,3}(?:<[a-zA-Z][\w-]*(?:\s+[a-zA-Z_:][\w.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*\s*/?>|</[a-zA-Z][\w-]*\s*>)[ \t]*$")
_DEFINITION = re.compile(r" {0,3}\[((?:[^\[\]\\]|\\.)+)\]:[ \t]*(?:<[^<>]*>|[^\s<]\S*)(?:[ \t]+(?:\"[^\"]*\"|'[^']*'|\([^()]*\)))?[ \t]*$")
_SPAN = re.compile(
    r"(`+)(.+?)(?<!`)\1(?!`)|<([a-zA-Z][a-zA-Z0-9+.-]{1,31}:[^<>\s]*|[\w.+-]+@[\w.-]+)>|</?[a-zA-Z][^>]*>|<!--.*?-->|\\([!-/:-@\[-`{-~])|&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]*);"
    r"|(!?\[)|(\]\((?:[^()\s]|\([^()]*\))*(?:\s+(?:\"[^\"]*\"|'[^']*'))?\))|(\]\[([^\]]*)\])|(\])|((?:\*+|_+)(?=\S)|(?<=\S)(?:\*+|_+))",
    re.DOTALL,
)


@dataclass
class Block:
    """kind: ``heading``, ``paragraph``, ``plain`` (of a tight list) or ``code``; ``start``: byte offset."""

    kind: str
    lines: list[str]
    start: int
    level: int = 0


@dataclass
class _Reader:
    labels: set[str] = field(default_factory=set)

    def leaves(self, lines: list[Line], tight: bool = False) -> Iterator[Block]:
        at = 0
        while at < len(lines):
            text, start = lines[at]
            if not text.strip():
                at += 1
            elif text.startswith("    "):
                end = at
                while end < len(lines) and (lines[end][0].startswith("    ") or not lines[end][0].strip()):
                    end += 1
                code = [line[4:] for line, _ in lines[at:end]]
                while not code[-1].strip():
                    code.pop()
                yield Block("code", code, start)
                at = end
            elif m := _FENCE.match(text):
                close = re.compile(rf" {{0,3}}{re.escape(m[2][0])}{{{len(m[2])},}}[ \t]*$")
                end = next((i for i in range(at + 1, len(lines)) if close.match(lines[i][0])), len(lines))
                yield Block("code", [line[min(len(m[1]), len(line) - len(line.lstrip(" "))) :] for line, _ in lines[at + 1 : end]], start)
                at = end + 1
            elif m := _ATX.match(text):
                yield Block("heading", [m[2] or ""], start, len(m[1]))
                at += 1
            elif _RULE.match(text):
                at += 1
            elif _QUOTE.match(text):
                inner, at = self._quote(lines, at)
                yield from self.leaves(inner)
            elif _ITEM.match(text):
                items, loose, at = self._list(lines, at)
                for item in items:
                    yield from self.leaves(item, not loose)
            elif (end := self._html(lines, at)) > at:
                at = end
            else:
                block, at = self._paragraph(lines, at, tight)
                if block:
                    yield block

    def _interrupts(self, text: str) -> bool:
        """Whether a line ends a paragraph; an item that is empty or numbered beyond 1 does not."""
        item = _ITEM.match(text)
        if item and text[item.end() :].strip() and (item[1] or int(item[2]) == 1):
            return True
        return any(p.match(text) for p in (_FENCE, _ATX, _RULE, _QUOTE, _RAW, _ELEMENT)) or text.lstrip().startswith(("<!--", "<?"))

    def _lazy(self, held: list[Line], text: str) -> bool:
        """Whether a line without the container's mark goes on with the paragraph the container ends in."""
        last = held[-1][0]
        while m := _QUOTE.match(last) or _ITEM.match(last):
            last = last[m.end() :]
        open_paragraph = last.strip() and not last.startswith("    ") and not any(p.match(last) for p in (_FENCE, _ATX, _RULE))
        return bool(open_paragraph and text.strip() and not self._interrupts(text) and not _ITEM.match(text) and not self._open_fence(held))

    def _open_fence(self, held: list[Line]) -> bool:
        fence = ""
        for text, _ in held:
            m = _FENCE.match(text)
            if not fence and m:
                fence = m[2]
            elif fence and re.match(rf" {{0,3}}{re.escape(fence[0])}{{{len(fence)},}}[ \t]*$", text):
                fence = ""
        return bool(fence)

    def _quote(self, lines: list[Line], at: int) -> tuple[list[Line], int]:
        inner: list[Line] = []
        while at < len(lines):
            text, start = lines[at]
            if m := _QUOTE.match(text):
                inner.append((text[m.end() :], start + len(text[: m.end()].encode())))
            elif self._lazy(inner, text):
                inner.append((text.lstrip(), start))
            else:
                break
            at += 1
        return inner, at

    def _list(self, lines: list[Line], at: int) -> tuple[list[list[Line]], bool, int]:
        items, loose, mark = [], False, _ITEM.match(lines[at][0]).group(1, 3)
        blank_before = False
        while at < len(lines):
            text, start = lines[at]
            m = _ITEM.match(text)
            if not m or m.group(1, 3) != mark or _RULE.match(text):
                break
            loose = loose or blank_before
            rest = text[m.end() :]
            pad = len(rest) - len(rest.lstrip(" "))
            width = m.end() + (pad if rest.strip() and 1 <= pad <= 4 else 1)
            item = [(text[width:], start + len(text[:width].encode()))]
            at += 1
            gap = 0
            while at < len(lines):
                text, start = lines[at]
                if not text.strip():
                    if not item[0][0].strip() and len(item) == 1:
                        break
                    item.append(("", start))
                    gap += 1
                elif text.startswith(" " * width):
                    # A blank line between two blocks of the item itself; one within a nested list or code is theirs.
                    inner = text[width:]
                    nested = inner.startswith(" ") or self._open_fence(item)
                    loose = loose or (gap > 0 and not nested)
                    item.append((inner, start + width))
                    gap = 0
                elif not gap and self._lazy(item, text):
                    item.append((text.lstrip(), start))
                else:
                    break
                at += 1
            while len(item) > 1 and not item[-1][0]:
                item.pop()
            blank_before = gap > 0
            while at < len(lines) and not lines[at][0].strip():
                blank_before, at = True, at + 1
            items.append(item)
        return items, loose, at

    def _html(self, lines: list[Line], at: int) -> int:
        """The end of the HTML block that starts here, else ``at``."""
        text = lines[at][0]
        stop = None
        if m := _RAW.match(text):
            stop = re.compile(rf"</{m[1]}>", re.IGNORECASE)
        elif text.lstrip().startswith("<!--"):
            stop = re.compile("-->")
        elif text.lstrip().startswith("<?"):
            stop = re.compile(r"\?>")
        if stop:
            return next((i + 1 for i in range(at, len(lines)) if stop.search(lines[i][0])), len(lines))
        if _ELEMENT.match(text) or _TAG_ALONE.match(text):
            return next((i for i in range(at, len(lines)) if not lines[i][0].strip()), len(lines))
        return at

    def _paragraph(self, lines: list[Line], at: int, tight: bool) -> tuple[Block | None, int]:
        held: list[str] = []
        start = lines[at][1]
        while at < len(lines):
            text, here = lines[at]
            if not held and (m := _DEFINITION.match(text)):
                self.labels.add(label(m[1]))
                at += 1
                start = lines[at][1] if at < len(lines) else here
                if at == len(lines) or not lines[at][0].strip() or self._interrupts(lines[at][0]):
                    return None, at
                continue
            if held and (m := _SETEXT.match(text)):
                return Block("heading", [" ".join(held)], start, 1 if m[1][0] == "=" else 2), at + 1
            if not text.strip() or (held and self._interrupts(text)):
                break
            held.append(text.strip(" \t") if at + 1 < len(lines) else text.strip())
            at += 1
        return Block("plain" if tight else "paragraph", held, start), at


def label(text: str) -> str:
    """Labels of links match without regard to case and runs of white space."""
    return " ".join(text.split()).casefold()


def leaf_blocks(markdown: str) -> tuple[list[Block], set[str]]:
    """The leaf blocks of a text and the labels of its link definitions."""
    lines, at = [], 0
    for raw in re.findall(r"[^\r\n]*(?:\r\n|\n|\r)|[^\r\n]+", markdown):
        text = raw.rstrip("\r\n")
        lines.append((re.sub(r"^[ \t]+", lambda m: m[0].expandtabs(4), text), at))
        at += len(raw.encode())
    reader = _Reader()
    blocks = list(reader.leaves(lines))
    return blocks, reader.labels


def fragments(text: str, labels: set[str] = frozenset()) -> list[str]:
    """The text and code fragments of inline markup; markup and HTML are left out, brackets that are no link stay."""
    out: list[str] = []
    opened: list[int] = []
    glue = False

    def add(piece: str) -> None:
        nonlocal glue
        if piece and glue:
            out[-1] += piece
        elif piece:
            out.append(piece)
        glue = glue and not piece

    at = 0
    for m in _SPAN.finditer(text):
        add(text[at : m.start()])
        glue = False
        at = m.end()
        if m[1]:
            code = m[2].replace("\n", " ")
            out.append(code[1:-1] if code.strip() and code[0] == code[-1] == " " and len(code) > 1 else code)
        elif m[3]:
            out.append(m[3])
        elif m[4]:
            # What follows an escaped character belongs to the same run of text.
            out.append(m[4])
            glue = True
        elif m[0][0] == "&":
            out.append(html.unescape(m[0]))
        elif m[5]:
            opened.append(len(out))
            out.append(m[5])
        elif m[6] or m[7] or m[9]:
            inside = "".join(out[opened[-1] + 1 :]) if opened else ""
            linked = opened and (m[6] or label(m[8] or inside) in labels)
            if linked:
                del out[opened.pop()]
            else:
                if opened:
                    opened.pop()
                out.append("]")
                at = m.start() + 1
                if m[6] or m[7]:
                    # No link: what stands behind the bracket is read as text of its own.
                    out += fragments(text[at:], labels)
                    return [f for f in out if f]
    add(text[at:])
    return [f for f in out if f]
