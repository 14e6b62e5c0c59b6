"""Prose split where its meaning turns: sentences with their neighbours are embedded in batches, and a document is cut
where the distance of two neighbours is above a percentile of its own distances. When the embedder fails, runs of
sentences are taken, and it is left alone for a while."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np

from tarn.functions.tokens import Tokenizer, Words

Embedder = Callable[[Sequence[str]], np.ndarray]
#: Fixed value: a blank behind a sentence's end.
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_FENCED = re.compile(r"(```[^\n]*\n[\s\S]*?\n```)")
_TABLE_RULE = re.compile(r"\|?[-: ]+\|[-|: ]+\|?")
#: Texts that an embedder is asked for at once.
EMBED_BATCH = 256


def sentences(text: str) -> list[str]:
    return [s for x in _SENTENCE.split(text) if (s := x.strip())]


class Cooldown:
    """Keeps a failing service from being asked again too soon. One a worker process, so it outlives batches and tasks."""

    def __init__(self, clock: Callable[[], float] = time.monotonic):
        self.clock, self.until, self.failures, self.skipped = clock, float("-inf"), 0, 0

    def closed(self) -> bool:
        now = self.clock() < self.until
        self.skipped += now
        return now

    def failed(self, seconds: float) -> None:
        self.failures += 1
        self.until = self.clock() + seconds


COOLDOWN = Cooldown()


def breaks(vectors: np.ndarray, percentile: float) -> list[int]:
    """The places behind which a document is cut: where a cosine distance of neighbours is above the percentile of all of them."""
    if len(vectors) < 2:
        return []
    norms = np.linalg.norm(vectors, axis=1)
    norms[norms == 0] = 1.0
    unit = vectors / norms[:, None]
    distances = 1.0 - (unit[1:] * unit[:-1]).sum(axis=1)
    return np.flatnonzero(distances > np.percentile(distances, percentile)).tolist()


@dataclass(frozen=True)
class Splitter:
    """How prose is split. Sizes are in tokens of ``tokenizer``; without an ``embed`` all prose is split by runs of sentences."""

    tokenizer: Tokenizer = Words()
    embed: Embedder | None = None
    most: int = 1600
    percentile: float = 95.0
    seconds: float = 60.0

    @property
    def soft(self) -> int:
        return max(1, self.most // 16)

    @property
    def least_sentences(self) -> int:
        return max(6, self.most // 120)

    def fits(self, text: str) -> bool:
        return self.tokenizer.count(text) <= self.most

    def by_meaning(self, texts: list[list[str]], cooldown: Cooldown | None = None) -> list[list[str] | None]:
        """The parts of each text (given by its sentences), or None for all of a batch whose embedding failed, or that came too soon after one.

        The windows of all texts are embedded together, ``EMBED_BATCH`` at a time.
        """
        cooldown = cooldown or COOLDOWN
        if self.embed is None or not texts or cooldown.closed():
            return [None] * len(texts)
        windows = [" ".join(s[max(0, i - 1) : i + 2]) for s in texts for i in range(len(s))]
        try:
            vectors = np.concatenate([np.asarray(self.embed(windows[i : i + EMBED_BATCH]), dtype=float) for i in range(0, len(windows), EMBED_BATCH)])
        except Exception:  # whatever a remote service raises; the local split takes over
            cooldown.failed(self.seconds)
            return [None] * len(texts)
        out, at = [], 0
        for s in texts:
            cuts = breaks(vectors[at : at + len(s)], self.percentile)
            at += len(s)
            edges = [0, *(c + 1 for c in cuts), len(s)]
            out.append([" ".join(s[a:b]) for a, b in zip(edges, edges[1:], strict=False)])
        return out

    def by_runs(self, found: list[str], total: int) -> list[str]:
        """Runs of sentences of about a third of the text; a short last one goes with the one before it if both fit together."""
        size, limit, runs, held = self.tokenizer.count, max(self.soft, -(-total // 3)), [[]], 0
        for s in found:
            n = size(s)
            if runs[-1] and held + n > limit:
                runs.append([])
                held = 0
            runs[-1].append(s)
            held += n
        parts = [" ".join(r) for r in runs]
        if len(parts) > 1 and size(parts[-1]) < max(1, limit // 2) and self.fits(both := " ".join(parts[-2:])):
            parts[-2:] = [both]
        return parts

    def prose(self, texts: list[str], cooldown: Cooldown | None = None) -> list[list[str]]:
        """The parts of each text: short prose whole, long prose where its meaning turns, or by runs where it nowhere does or no embedder answers."""
        clean = [t.strip() for t in texts]
        out: list[list[str]] = [[t] if t else [] for t in clean]
        sized = {i: n for i, t in enumerate(clean) if (n := self.tokenizer.count(t)) > self.soft}
        long = {i: s for i in sized if len(s := sentences(clean[i])) >= self.least_sentences}
        for (i, s), parts in zip(long.items(), self.by_meaning(list(long.values()), cooldown), strict=True):
            out[i] = parts if parts is not None and len(parts) > 1 else self.by_runs(s, sized[i])
        return out

    def windows(self, text: str) -> list[str]:
        """Parts within the budget: fenced blocks whole, tables by rows under their header, sentences packed, longer ones cut at tokens."""
        clean = text.strip()
        if not clean or self.fits(clean):
            return [clean] if clean else []
        out: list[str] = []
        for piece in _FENCED.split(clean):
            bare = piece.strip()
            if bare and (_FENCED.fullmatch(bare) or self.fits(bare)):
                out.append(bare)
            elif bare and is_table(bare):
                out += self.table_rows(bare)
            elif bare:
                out += self.packed(sentences(bare))
        return out

    def packed(self, found: list[str]) -> list[str]:
        """Sentences packed in order, a blank counting as one token; one that exceeds the budget by itself is cut at tokens."""
        out: list[str] = []
        held: list[str] = []
        size = 0
        for s in found:
            n = self.tokenizer.count(s)
            if held and size + 1 + n > self.most:
                out.append(" ".join(held))
                held, size = [], 0
            if n > self.most:
                out += self.tokenizer.windows(s, self.most)
            else:
                size += n + bool(held)
                held.append(s)
        return [*out, " ".join(held)] if held else out

    def table_rows(self, text: str) -> list[str]:
        """Rows packed in order, each part under the table's header if it has one."""
        rows = [r.rstrip() for r in text.splitlines() if r.strip()]
        head = next(([a, b] for a, b in zip(rows, rows[1:], strict=False) if a.count("|") >= 2 and _TABLE_RULE.fullmatch(b.strip())), [])
        parts: list[list[str]] = [[]]
        for r in rows:
            if len(parts[-1]) > len(head) and not self.fits("\n".join([*parts[-1], r])):
                parts.append(list(head))
            parts[-1].append(r)
        return ["\n".join(p) for p in parts]

    def whole(self, text: str, cooldown: Cooldown | None = None) -> list[str]:
        """Any text within the budget: its prose where its meaning turns, and what is still too long in windows."""
        clean = text.strip()
        if not clean or self.fits(clean):
            return [clean] if clean else []
        pieces = [p for p in _FENCED.split(clean) if p.strip()]
        loose = [p for p in pieces if not _FENCED.fullmatch(p)]
        split = dict(zip(loose, self.by_meaning([sentences(p) for p in loose], cooldown), strict=True))
        out: list[str] = []
        for p in pieces:
            if p not in split:
                out.append(p)
            else:
                out += [w for part in split[p] or [p] for w in self.windows(part)]
        return out


def is_table(text: str) -> bool:
    """Two lines with bars or tabs, or one that rules a header off."""
    rows = [r for x in text.splitlines() if (r := x.strip())]
    return sum(r.count("|") >= 2 for r in rows) >= 2 or sum(r.count("\t") >= 2 for r in rows) >= 2 or any(_TABLE_RULE.fullmatch(r) for r in rows)
