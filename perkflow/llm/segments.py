"""Cutting texts into units that byte-level tokenizers treat independently.

A byte-level pre-token never runs across the border between white space and
other characters, except for one leading space. So a text falls into *segments*
(an optional space and a run of other characters, or a run of white space)
whose tokens depend on the segment alone: what was computed for a segment once
holds wherever it occurs, which is what the worker caches rely on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

# The characters with the Unicode property White_Space.
WHITE_SPACE = ("\t\n\x0b\x0c\r \x85\xa0 "
               "           "
               "    　")

_SEGMENT = re.compile(f" ?[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+(?![^{WHITE_SPACE}])|[{WHITE_SPACE}]+")
_SAFE_CUT = re.compile(f"(?<=[^{WHITE_SPACE}]) (?=[^{WHITE_SPACE}])")

PART_CHARS = 1 << 20


def parts(text: str, size: int = PART_CHARS) -> Iterator[str]:
    """The text in order, in parts of about ``size`` characters whose segments are the text's."""
    start = 0
    while len(text) - start > size:
        cut = _SAFE_CUT.search(text, start + size)
        if cut is None:
            break
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:] if start else text


def segments(part: str) -> list[str]:
    return _SEGMENT.findall(part)


class BoundedCache(dict):
    """A worker's memory of what was computed for a unit of text, in two generations.

    When the young generation holds ``limit / 2`` units it becomes the old one,
    and the old one is forgotten; a unit found in the old generation is young
    again. So units that keep occurring stay. Pinned units always stay. Units
    longer than ``longest`` characters are not kept.
    """

    def __init__(self, compute, pinned: dict | None = None, limit: int = 200_000, longest: int = 48):
        super().__init__(pinned or {})
        self.compute, self.pinned, self.old = compute, dict(pinned or {}), {}
        self.limit, self.longest = limit // 2 + len(self.pinned), longest

    def __missing__(self, unit: str):
        value = self.old.get(unit)
        if value is None:
            value = self.compute(unit)
        self.keep(unit, value)
        return value

    def keep(self, unit: str, value) -> None:
        if len(unit) <= self.longest:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
                self.update(self.pinned)
            self[unit] = value

    def unknown(self, units: set[str]) -> list[str]:
        """Those of ``units`` that would have to be computed and could be kept."""
        old, longest = self.old, self.longest
        return [u for u in units if u not in self and u not in old and len(u) <= longest]
