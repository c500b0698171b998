"""Units of many texts at once: their places and hashes by numpy, and a worker's memory of units.

Texts are laid end to end as bytes, with a byte between them that belongs to no
unit. Prefix sums of a polynomial hash give the hash of every unit by one
subtraction, so that the units of megabytes of text cost a few passes; Python
sees each distinct unit of a group once. The hash only brings equal units
together: every unit's bytes are compared with those of the unit that stands
for its hash, and units that differ stand for themselves. What outlives a group
is kept with the bytes of the unit and compared with them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import numpy as np

from perkflow.llm.repetition import _IS_SPACE, _mixed

#: Bytes laid end to end at once; longer texts are for the caller to handle.
GROUP_BYTES = 1 << 20
#: Lies between texts: no byte of UTF-8, no white space.
GAP = 0xFF

_rng = np.random.default_rng(64)
_VALUE = _rng.integers(0, 2 ** 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_rng.integers(2 ** 62, 2 ** 63)) | 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & (2 ** 64 - 1), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Hasher:
    def __init__(self, size: int = GROUP_BYTES + 1):
        self.up = _powers(_BASE, size)
        self.down = _powers(pow(_BASE, -1, 2 ** 64), size)

    def __call__(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the byte ranges, independent of where they lie."""
        prefix = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_VALUE[raw] * self.up[:len(raw)], out=prefix[1:])
        h = (prefix[ends] - prefix[starts]) * self.down[starts]
        return _mixed(h + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def laid_out(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts end to end, and the place behind each text's gap."""
    raw = np.frombuffer(b"\xff".join([*texts, b""]), np.uint8)
    return raw, np.cumsum([len(t) + 1 for t in texts])


_IS_WORD = ~_IS_SPACE
_IS_WORD[GAP] = False


def words_at(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs without ASCII white space."""
    word = np.zeros(len(raw) + 2, np.int8)
    word[1:-1] = _IS_WORD[raw]
    edge = np.diff(word)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


# Marks that end a word in most scripts' plain text.
_MARK = np.zeros(256, bool)
_MARK[list(b'.,;:!?)"')] = True
_LETTER_OR_DIGIT = np.zeros(256, bool)
_LETTER_OR_DIGIT[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


def split_marks(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words with the marks at their end cut off, and those marks as units of their own, in order of start.

    Only marks that follow an ASCII letter or digit: there every tokenizer of
    this package splits, too, because a run of symbols ends at the next letter
    and no contraction starts with one of these marks.
    """
    if not len(starts):
        return starts, ends
    cut = np.flatnonzero(_MARK[raw[ends - 1]])      # few words end with a mark
    last, live = ends[cut] - 1, np.arange(len(cut))
    for _ in range(8):                              # most of them with few marks
        live = live[_MARK[raw[last[live]]] & (last[live] > starts[cut[live]])]
        if not len(live):
            break
        last[live] -= 1
    if len(live):
        other = np.flatnonzero(~_MARK[raw])
        last[live] = other[np.maximum(np.searchsorted(other, last[live] + 1) - 1, 0)] if len(other) else -1
    some = (last >= starts[cut]) & (last < ends[cut] - 1) & _LETTER_OR_DIGIT[raw[np.maximum(last, 0)]]
    cut, at = cut[some], last[some] + 1
    first_ends = ends.copy()
    first_ends[cut] = at
    all_starts, all_ends = np.concatenate([starts, at]), np.concatenate([first_ends, ends[cut]])
    order = np.argsort(all_starts, kind="stable")
    return all_starts[order], all_ends[order]


def lowered(raw: np.ndarray) -> np.ndarray:
    """A-Z as a-z."""
    return np.frombuffer(raw.tobytes().lower(), np.uint8)


def segments_at(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the segments of byte-level tokenizers, in no order (see ``segments``).

    Marks at the end of a word are units of their own. A word takes one space in front of it. Of a run of white space before a
    word, all but the last character are one segment, the last is another
    unless the word took it; a run at the end of a text is one segment.
    """
    starts, ends = words_at(raw)
    space = np.zeros(len(raw) + 2, np.int8)
    space[1:-1] = _IS_SPACE[raw]
    edge = np.diff(space)
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    before_word = (b < len(raw)) & (raw[np.minimum(b, len(raw) - 1)] != GAP) if len(raw) else np.zeros(0, bool)
    taken = before_word & (raw[b - 1] == 0x20)
    begins = starts.copy()
    begins[np.searchsorted(starts, b[taken])] -= 1
    main_end = np.where(before_word, b - 1, b)
    some = main_end > a
    alone = before_word & ~taken
    begins, ends = split_marks(raw, begins, ends)
    return (np.concatenate([begins, a[some], b[alone] - 1]),
            np.concatenate([ends, main_end[some], b[alone]]))


class Memory:
    """Values by unit, in two generations; ``compute`` is given the new units of a group together."""

    def __init__(self, compute: Callable[[list[bytes]], list], limit: int, pinned: dict[bytes, object] | None = None):
        self.compute, self.pinned = compute, pinned or {}
        self.half = limit // 2 + len(self.pinned)
        self.young: dict[bytes, object] = dict(self.pinned)
        self.old: dict[bytes, object] = {}

    def values(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list:
        """The value of every unit, all distinct, that lies at ``starts`` to ``ends``."""
        data = raw.tobytes()
        found = [data[s:e] for s, e in zip(starts.tolist(), ends.tolist())]
        young, old = self.young, self.old
        out = list(map(young.get, found))
        new = []
        for i in [i for i, value in enumerate(out) if value is None]:
            value = old.get(found[i])
            if value is None:
                new.append(i)
            else:
                out[i] = young[found[i]] = value
        if new:
            for i, value in zip(new, self.compute([found[i] for i in new])):
                out[i] = young[found[i]] = value
        if len(young) > self.half:
            self.young, self.old = dict(self.pinned), young
        return out


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all ranges, one range after the other."""
    stops = np.cumsum(sizes, dtype=np.int64)
    return np.repeat(starts - (stops - sizes), sizes) + np.arange(stops[-1] if len(stops) else 0)


def _with_room(a: np.ndarray, used: int, more: int) -> np.ndarray:
    if used + more <= len(a):
        return a
    out = np.empty(max(2 * len(a), used + more), a.dtype)
    out[:used] = a[:used]
    return out


class IdMemory:
    """Ids by unit, in a few arrays: a table of hashes, the units' bytes end to end, their ids end to end.

    A unit is found by its hash and compared byte by byte. ``compute`` is given
    the new units of a group together and returns the bytes of their ids. When
    more than 2 * ``half`` units are held, those asked for since the last time
    stay, ``half`` at most.
    """

    #: Longer units are not kept; bytes and ids held, on an average over the units held, at most.
    LONGEST, MEAN_BYTES, MEAN_IDS = 1024, 32, 16

    def __init__(self, compute: Callable[[list[bytes]], list[bytes]], limit: int, kind: np.dtype, hasher: Hasher):
        self.compute, self.half, self.kind, self.hasher = compute, limit // 2, kind, hasher
        self.n = self.n_bytes = self.n_ids = 0
        self.slots = np.full(1 << 12, -1, np.int32)     # unit by hash, the next free place on a collision
        self.hashes = np.empty(1 << 10, np.uint64)
        self.used = np.empty(1 << 10, bool)
        self.at, self.size = np.empty(1 << 10, np.int64), np.empty(1 << 10, np.int32)
        self.first, self.count = np.empty(1 << 10, np.int64), np.empty(1 << 10, np.int32)
        self.bytes, self.ids = np.empty(1 << 14, np.uint8), np.empty(1 << 12, kind)

    def places(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in ``ids`` each unit's ids begin, and how many they are; until the next call."""
        limit = 2 * self.half
        if self.n > limit or self.n_bytes > limit * self.MEAN_BYTES or self.n_ids > limit * self.MEAN_IDS:
            self._forget()
        hashes = self.hasher(raw, starts, ends)
        unit = self._found(hashes)
        known = np.flatnonzero(unit >= 0)
        at = self.at[unit[known]]
        same = same_bytes(raw, starts[known], ends[known], at, at + self.size[unit[known]], self.bytes)
        other, known = known[~same], known[same]
        first, count = np.empty(len(starts), np.int64), np.empty(len(starts), np.int64)
        unit_known = unit[known]
        self.used[unit_known] = True
        first[known], count[known] = self.first[unit_known], self.count[unit_known]
        new = unit < 0
        new[other] = True
        new = np.flatnonzero(new)
        if len(new):
            one, number = distinct(raw, starts[new], ends[new], lambda *_: hashes[new])
            at = new[one]
            data = raw.tobytes()
            values = self.compute([data[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist())])
            n = np.fromiter(map(len, values), np.int64, len(values)) // self.kind.itemsize
            begin = self.n_ids + np.cumsum(n) - n
            self.ids = _with_room(self.ids, self.n_ids, int(n.sum()))
            self.ids[self.n_ids:self.n_ids + int(n.sum())] = np.frombuffer(b"".join(values), self.kind)
            self.n_ids += int(n.sum())
            first[new], count[new] = begin[number], n[number]
            keep = (ends[at] - starts[at] <= self.LONGEST) & (unit[at] < 0)
            at = at[keep]
            self._keep(raw, starts[at], ends[at], hashes[at], begin[keep], n[keep])
        return first, count

    def _found(self, hashes: np.ndarray) -> np.ndarray:
        """The unit held for each hash, or -1."""
        mask = len(self.slots) - 1
        at = (hashes & np.uint64(mask)).astype(np.int64)
        unit = self.slots[at]
        live = np.flatnonzero(unit >= 0)
        live = live[self.hashes[unit[live]] != hashes[live]]
        while len(live):
            at[live] = (at[live] + 1) & mask
            unit[live] = some = self.slots[at[live]]
            live = live[some >= 0]
            live = live[self.hashes[unit[live]] != hashes[live]]
        return unit

    def _keep(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, first: np.ndarray,
              count: np.ndarray) -> None:
        size = ends - starts
        n, more = self.n, len(starts)
        for name, values in (("hashes", hashes), ("used", False), ("size", size), ("first", first), ("count", count),
                             ("at", self.n_bytes + np.cumsum(size) - size)):
            held = _with_room(getattr(self, name), n, more)
            held[n:n + more] = values
            setattr(self, name, held)
        total = int(size.sum())
        self.bytes = _with_room(self.bytes, self.n_bytes, total + 8)
        self.bytes[self.n_bytes:self.n_bytes + total] = raw[ranges(starts, size)]
        self.n, self.n_bytes = n + more, self.n_bytes + total
        if 2 * self.n > len(self.slots):
            self.slots = np.full(1 << (4 * self.n - 1).bit_length(), -1, np.int32)
            self._place(0)
        else:
            self._place(n)

    def _place(self, start: int) -> None:
        """Gives the units from the ``start``-th on a place in the table."""
        mask = len(self.slots) - 1
        units = np.arange(start, self.n, dtype=np.int32)
        at = (self.hashes[start:self.n] & np.uint64(mask)).astype(np.int64)
        while len(units):
            free = self.slots[at] < 0
            self.slots[at[free]] = units[free]
            left = self.slots[at] != units
            units, at = units[left], (at[left] + 1) & mask

    def _forget(self) -> None:
        stay = np.flatnonzero(self.used[:self.n])[-self.half:] if self.half else np.zeros(0, np.int64)
        for sizes, most in ((self.size, self.MEAN_BYTES), (self.count, self.MEAN_IDS)):
            held = np.cumsum(sizes[stay][::-1], dtype=np.int64)
            stay = stay[len(stay) - int(np.searchsorted(held, self.half * most, "right")):]
        size, count = self.size[stay].astype(np.int64), self.count[stay].astype(np.int64)
        kept = self.bytes[ranges(self.at[stay], size)]
        self.bytes = np.concatenate([kept, np.zeros(8, np.uint8)])
        self.ids = self.ids[ranges(self.first[stay], count)]
        self.n, self.n_bytes, self.n_ids = len(stay), len(kept), len(self.ids)
        self.hashes, self.size, self.count = self.hashes[stay], size.astype(np.int32), count.astype(np.int32)
        self.at, self.first, self.used = np.cumsum(size) - size, np.cumsum(count) - count, np.zeros(self.n, bool)
        self.slots = np.full(1 << max(12, (4 * self.n - 1).bit_length() if self.n else 0), -1, np.int32)
        self._place(0)


def encoded(texts: Sequence[bytes], units_at: Callable, memory: IdMemory,
            change: Callable[[np.ndarray], np.ndarray] | None = None) -> list[bytes]:
    """Each text's ids, end to end in order, as bytes of numbers of the memory's type.

    ``change``: what to do to the bytes first, each staying in its place.
    """
    raw, behind = laid_out(texts)
    raw = raw if change is None else change(raw)
    starts, ends = units_at(raw)
    if not len(starts):
        return [b""] * len(texts)
    if (starts[1:] < starts[:-1]).any():
        order = np.argsort(starts, kind="stable")
        starts, ends = starts[order], ends[order]
    first, count = memory.places(raw, starts, ends)
    out = memory.ids[ranges(first, count)]
    n_units = np.searchsorted(starts, behind, "left")
    edges = np.concatenate(([0], np.cumsum(count)))[np.concatenate(([0], n_units))]
    return [out[i:j].tobytes() for i, j in zip(edges[:-1].tolist(), edges[1:].tolist())]


#: Bytes of the characters with the property White_Space outside ASCII, as they begin in UTF-8.
_WIDE_SPACE = re.compile(b"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


def is_plain(text: bytes) -> bool:
    """Not very long, valid UTF-8, with ASCII white space only: its segments can be found on the bytes."""
    if len(text) >= GROUP_BYTES:
        return False
    if text.isascii():
        return True
    try:
        text.decode()
    except UnicodeDecodeError:
        return False
    return _WIDE_SPACE.search(text) is None


def distinct(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray,
             hasher: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The place of one of each of the distinct units, and every unit's number among them."""
    hashes = hasher(raw, starts, ends)
    order = np.argsort(hashes)
    ranked = hashes[order]
    new = np.ones(len(ranked), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    number = np.empty(len(ranked), np.int64)
    number[order] = np.cumsum(new) - 1
    one = order[new]
    others = order[~new]
    first = one[number[others]]
    odd = others[~same_bytes(raw, starts[others], ends[others], starts[first], ends[first])]
    if len(odd):
        apart: dict[bytes, int] = {}
        for i in odd.tolist():
            unit = raw[starts[i]:ends[i]].tobytes()
            if unit not in apart:
                apart[unit] = len(one)
                one = np.append(one, i)
            number[i] = apart[unit]
    return one, number


def _eights(padded: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on as a number."""
    return np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))


def same_bytes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, other_starts: np.ndarray,
               other_ends: np.ndarray, other_raw: np.ndarray | None = None) -> np.ndarray:
    """Whether ranges hold the same bytes as others; eight bytes at a time, what is long as a whole.

    ``other_raw``: where the others lie, if elsewhere, with eight bytes behind them.
    """
    size = ends - starts
    out = size == other_ends - other_starts
    eight = _eights(np.concatenate([raw, np.zeros(8, np.uint8)]))
    other_eight, other_raw = (eight, raw) if other_raw is None else (_eights(other_raw), other_raw)
    live, at = np.flatnonzero(out & (size > 0)), 0
    while len(live) and at < 64:
        left = size[live] - at
        differ = eight[starts[live] + at] ^ other_eight[other_starts[live] + at]
        short = np.minimum(left, 8).astype(np.uint64)
        bad = (differ << (np.uint64(64) - np.uint64(8) * short)) != 0
        out[live[bad]] = False
        live, at = live[~bad & (left > 8)], at + 8
    for i in live.tolist():
        out[i] = np.array_equal(raw[starts[i]:ends[i]], other_raw[other_starts[i]:other_ends[i]])
    return out


def grouped(texts: Sequence[bytes], size: int = GROUP_BYTES):
    """Consecutive groups of (text numbers, texts) that fit ``size`` bytes; a longer text is a group of its own."""
    numbers, held, total = [], [], 0
    for i, t in enumerate(texts):
        if held and total + len(t) + 1 > size:
            yield numbers, held
            numbers, held, total = [], [], 0
        numbers.append(i)
        held.append(t)
        total += len(t) + 1
    if held:
        yield numbers, held
