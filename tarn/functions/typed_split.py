"""The typed split: a text's blocks, folded into chunks by one ordered pass, and gathers over the chunks of a document.

A document is one row throughout; nothing here looks beyond it.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from tarn.functions.chunk_rules import type_of
from tarn.functions.python_tier import _blocks

#: Types that are one chunk if a whole text without headings has them, types that are one if no blank line parts them, and those that are one without fences.
ATOMIC = frozenset({"address", "contact", "faq", "glossary", "json", "list", "quote", "structured_list"})
UNPARTED = frozenset({"code", "table"})
UNFENCED = frozenset({"heading_only", "transcript"})
#: Blocks that keep their kind as their type, and types of lists.
STRUCTURED = frozenset({"table", "code", "json"})
LISTS = frozenset({"list", "structured_list"})
#: A heading at the start of a line, one below the first level, a line that names a speaker, a sentence whose first word is capitalised, a bullet.
_HEADED = re.compile(r"^#{1,6}\s+\S", re.MULTILINE)
_BELOW_FIRST = re.compile(r"#{2,6}\s+\S")
_SPEAKER = re.compile(r"(?:\[\d{2}:\d{2}(?::\d{2})?\]\s+)?[A-Z][^\n:]{0,60}:\s*")
_SPOKEN = re.compile(r"[A-Z][A-Za-z'’-]+\s+\S")
_BULLET = re.compile(r"[-*+]\s+")
_HEADING_LINE = re.compile(r"(#{1,6})\s+(\S[^\n]*)")
GAP = "\n\n"


@dataclass
class Chunk:
    text: str
    kind: str
    path: str = ""

    @property
    def headed(self) -> bool:
        return _HEADED.match(self.text.strip()) is not None


def is_told_dialogue(text: str) -> bool:
    """A line that ends in a colon, and behind it, without bullets, two or more lines that open with a capitalised word."""
    first, *rest = [bare for line in text.splitlines() if (bare := line.strip())] or [""]
    if len(rest) < 2 or not first.endswith(":") or any(map(_BULLET.match, rest)):
        return False
    return sum(_SPOKEN.match(line) is not None for line in rest) > 1


def prose_type(text: str) -> str:
    return "transcript" if is_told_dialogue(text) else type_of(text)


def stays_whole(text: str, kind: str, blocks: list[dict]) -> bool:
    """Whether a whole text of this type is one chunk."""
    if kind in UNPARTED and GAP not in text:
        return True
    if _HEADED.search(text):
        return False
    if kind == "content":
        return all(b["kind"] == "heading" or b["kind"] == "prose" and type_of(b["text"]) != "code" for b in blocks)
    return kind in ATOMIC or kind in UNFENCED and "```" not in text and "~~~" not in text


@dataclass
class Fold:
    """The chunks so far, the headings that wait for what they head, and whether a divider has closed the last chunk."""

    chunks: list[Chunk] = field(default_factory=list)
    waiting: list[tuple[int, str]] = field(default_factory=list)
    closed: bool = False

    def put(self, text: str, kind: str) -> None:
        new = Chunk(text.strip(), kind)
        if not new.text:
            return
        last = self.chunks[-1] if self.chunks else None
        if not self.closed and kind == "content" and last is not None and last.kind == "content" and not new.headed:
            last.text += GAP + new.text
        else:
            self.chunks.append(new)
        self.closed = False

    def put_headings(self, keep: int = 0) -> None:
        """The waiting headings as a chunk of their own; the first ``keep`` go on waiting."""
        if self.waiting:
            self.put(GAP.join(h for _, h in self.waiting), "heading_only")
        del self.waiting[keep:]

    def headed(self, text: str) -> str:
        out = GAP.join([*(h for _, h in self.waiting), text])
        self.waiting.clear()
        return out

    def take(self, kind: str, text: str, depth: int) -> None:
        if kind == "divider":
            self.closed = True
        elif kind == "heading":
            if self.waiting and depth <= self.waiting[-1][0]:
                self.put_headings(depth - 1)
            self.waiting.append((depth, text))
        elif kind in STRUCTURED:
            if not self.chunks:  # headings that open a document do not belong to a table or code
                self.put_headings()
            self.put(self.headed(text), kind)
        else:
            text = self.headed(text)
            self.put(text, prose_type(text))


def gathered(chunks: list[Chunk], chosen: Callable[[Chunk], bool], kind: str | None = None) -> list[Chunk]:
    """The chosen chunks, wherever they stand, joined where the first of them stands, as its type or ``kind``; a single one stays as it is."""
    members = [c for c in chunks if chosen(c)]
    if len(members) < 2:
        return chunks
    joined = Chunk(GAP.join(c.text for c in members), kind or members[0].kind)
    return [joined if c is members[0] else c for c in chunks if c is members[0] or c not in members]


def gather(chunks: list[Chunk], whole: str) -> list[Chunk]:
    """Turns of a dialogue, lists of a document without subsections, prose around them, and neighbouring headings."""
    if whole == "transcript":
        chunks = gathered(chunks, lambda c: c.kind == "transcript" or _SPEAKER.fullmatch(c.text.splitlines()[0].strip()) is not None, "transcript")
    if not any(_BELOW_FIRST.match(line.strip()) for c in chunks for line in c.text.splitlines()):
        chunks = gathered(chunks, lambda c: c.kind in LISTS and not c.headed)
        kinds = {c.kind for c in chunks}
        if not kinds & STRUCTURED and kinds & (LISTS | {"transcript"}):
            chunks = gathered(chunks, lambda c: c.kind == "content")
    out: list[Chunk] = []
    for c in chunks:
        if out and c.kind == out[-1].kind == "heading_only":
            out[-1].text = GAP.join(dict.fromkeys(bare for line in (out[-1].text + "\n" + c.text).splitlines() if (bare := line.strip())))
        else:
            out.append(c)
    return out


def with_paths(chunks: list[Chunk]) -> list[Chunk]:
    """Each chunk with the titles of the headings that are open behind it, the shallowest first; a heading closes all that are deeper or as deep."""
    open_: dict[int, str] = {}
    for c in chunks:
        for line in c.text.splitlines():
            if m := _HEADING_LINE.fullmatch(line.strip()):
                open_ = {d: t for d, t in open_.items() if d < len(m[1])} | {len(m[1]): m[2].strip()}
        c.path = " > ".join(open_[d] for d in sorted(open_))
    return chunks


def typed_split(text: str | None) -> list[Chunk]:
    """The typed chunks of a text in order, with their paths. Blank texts, and those of dividers alone, have none."""
    clean = (text or "").strip()
    blocks = _blocks(clean)
    if all(b["kind"] == "divider" for b in blocks):
        return []
    whole = type_of(clean)
    if stays_whole(clean, whole, blocks):
        return with_paths([Chunk(clean, whole)])
    fold = Fold()
    for b in blocks:
        fold.take(b["kind"], b["text"], b["depth"])
    fold.put_headings()
    return with_paths(gather(fold.chunks, whole))

