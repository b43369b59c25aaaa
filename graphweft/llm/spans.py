"""Span arithmetic shared by the scanners: mapped texts and span strings."""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterable


class Mapped:
    """A text rewritten in places, whose spans can be traced to the source."""

    def __init__(self, text: str, below: Mapped | None = None, pieces: list[tuple[int, int, int, bool]] | None = None):
        self.text, self.below = text, below
        self.pieces = pieces or [(0, 0, len(text), True)]  # start here; start and end below; the same characters
        self.starts = [p[0] for p in self.pieces]

    def edit(self, edits: Iterable[tuple[int, int, str]]) -> Mapped:
        """A new text with the spans, in order and disjoint, replaced."""
        out, pieces, at, here = [], [], 0, 0

        def put(s: int, e: int, new: str, same: bool) -> None:
            nonlocal here
            if new:
                pieces.append((here, s, e, same))
                out.append(new)
                here += len(new)

        for s, e, new in edits:
            put(at, s, self.text[at:s], True)
            put(s, e, new, False)
            at = e
        put(at, len(self.text), self.text[at:], True)
        return Mapped("".join(out), self, pieces or [(0, 0, 0, True)])

    def source(self, start: int, end: int) -> tuple[int, int]:
        """The span of the source that the characters start to end come from."""
        if self.below is None:
            return start, end
        n, s, _, same = self.pieces[bisect_right(self.starts, start) - 1]
        first = s + (start - n) if same else s
        n, s, e, same = self.pieces[bisect_right(self.starts, end - 1) - 1]
        return self.below.source(first, s + (end - n) if same else e)


def overlaps(span: tuple[int, int], others: Iterable[tuple[int, int]]) -> bool:
    return any(span[0] < e and s < span[1] for s, e in others)


def joined(spans: Iterable[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
