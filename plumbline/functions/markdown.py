"""Markdown to heading-bounded sections and size-bounded chunks. All lengths are UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from plumbline.functions.blocks import fragments, leaf_blocks

#: Sections shorter than this join the chunk before them.
TINY = 50


@dataclass
class Chunk:
    content: str
    heading_context: str
    start_byte: int
    end_byte: int


def sections(markdown: str) -> Iterator[Chunk]:
    """Heading-bounded sections; the context is the path of headings, joined by `` > ``."""
    stack: list[tuple[int, str]] = []
    body, context, start = "", "", 0
    blocks, labels = leaf_blocks(markdown)
    for block in blocks:
        text = "\n".join(block.lines)
        if block.kind == "heading":
            if body.strip():
                yield Chunk(body.strip(), context, start, block.start)
            name = "".join(fragments(text, labels)).strip()
            while stack and stack[-1][0] >= block.level:
                stack.pop()
            stack.append((block.level, name))
            body, context, start = name, " > ".join(t for _, t in stack), block.start
        elif block.kind == "code":
            for line in block.lines:
                body += (" " if body else "") + line + "\n"
        else:
            for fragment in fragments(text.replace("\\\n", "\n"), labels):
                for n, line in enumerate(fragment.split("\n")):
                    body += ("\n" if n else "") + ((" " if body or n else "") + line if line else "")
            body += "\n\n" if block.kind == "paragraph" else ""
    if body.strip():
        yield Chunk(body.strip(), context, start, len(markdown.encode()))


def size(text: str) -> int:
    return len(text.encode())


def _cut(text: str, most: int) -> int:
    """Characters of the longest head of at most ``most`` bytes."""
    return len(text.encode()[:most].decode(errors="ignore")) if size(text) > most else len(text)


def tail(text: str, most: int) -> str:
    """The last ``most`` bytes, from the character that the cut falls into."""
    raw = text.encode()
    at = max(0, len(raw) - most)
    while at and raw[at] & 0xC0 == 0x80:
        at -= 1
    return raw[at:].decode()


def sentence_end(text: str, most: int) -> int:
    """Where the last sentence within ``most`` bytes ends, by exclamation, question mark or full stop in this order, else the cut."""
    cap = _cut(text, most)
    for mark in ("! ", "? ", ". "):
        at = text[:cap].rfind(mark)
        if at >= 0:
            return at + len(mark)
    return cap


def _gather(parts: Iterator[str], glue: str, most: int, overlap: int, base: int, whole: int, context: str, over=None) -> Iterator[Chunk]:
    """Fills chunks with parts up to ``most`` bytes. The overlap moves the offsets of the next chunk back, not its text.

    over: what makes chunks of a part that is too long on its own, given the part and its offset.
    """
    held, at = "", base
    for part in parts:
        if size(held) + (size(glue) if held else 0) + size(part) <= most:
            held += (glue if held else "") + part
            continue
        if held:
            end = at + size(held)
            yield Chunk(held.strip(), context, at, end)
            at = max(0, end - overlap) if glue == "\n\n" else at + max(0, size(held) - overlap)
        if over and size(part) > most:
            yield from over(part, at)
            held = ""
        else:
            held = part
    if held.strip():
        yield Chunk(held.strip(), context, at, base + whole)


def _sentences(text: str, most: int) -> Iterator[str]:
    while text:
        end = max(1, sentence_end(text, most))
        yield text[:end]
        text = text[end:].lstrip()


def split_sentences(text: str, most: int, overlap: int, base: int, context: str) -> Iterator[Chunk]:
    return _gather(_sentences(text, most), " ", most, overlap, base, size(text), context)


def split_paragraphs(text: str, most: int, overlap: int, base: int, context: str) -> Iterator[Chunk]:
    paragraphs = (p for p in text.split("\n\n") if p.strip())
    return _gather(paragraphs, "\n\n", most, overlap, base, size(text), context, lambda p, at: split_sentences(p, most, overlap, at, context))


def split_words(text: str, most: int, overlap: int, base: int, context: str) -> Iterator[Chunk]:
    """Splits between words, with real overlap. No chunker path needs it: longer sentences are cut."""
    held, at = "", base
    for word in text.split():
        if size(held) + bool(held) + size(word) <= most:
            held += (" " if held else "") + word
            continue
        if held:
            yield Chunk(held.strip(), context, at, at + size(held))
            at += max(0, size(held) - overlap)
            held = tail(held, overlap)
        held += (" " if held else "") + word
    if held.strip():
        yield Chunk(held.strip(), context, at, base + size(text))


def chunk_markdown(markdown: str, most: int, overlap: int) -> list[Chunk]:
    """The chunks of a document: small sections whole, tiny ones with the chunk before, large ones split."""
    out: list[Chunk] = []
    for s in sections(markdown):
        if size(s.content) > most:
            out += split_paragraphs(s.content, most, overlap, s.start_byte, s.heading_context)
        elif size(s.content) < TINY and out:
            out[-1].content += "\n" + s.content
            out[-1].end_byte = s.end_byte
        else:
            out.append(s)
    return out
