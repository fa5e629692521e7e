"""Token ids of whole texts by way of their space-separated units.

A byte-level BPE pattern lets a piece begin with one space, and no piece goes on over a
space that a non-space follows. So a text can be cut before each such space, and a unit
seen before needs no second look at pattern or merges. Where the pattern makes a line end
between two non-spaces a piece of its own, slices of texts can be cut there too.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A space that white space or the end of the text follows.
UNSAFE = re.compile(r" (?=\s|\Z)")
SAFE_SPACE = re.compile(r" (?!\s|\Z)")
#: UNSAFE for Arrow, whose \s knows ASCII alone.
UNSAFE_ARROW = r" ([\s\v\x1c-\x1f\x{85}\p{Z}]|\z)"
#: For Arrow, a line end between two characters that are no white space.
LINE_END, LINE_CUT = r"([^\s\v\x1c-\x1f\x{85}\p{Z}])\n([^\s\v\x1c-\x1f\x{85}\p{Z}])", "\\1 \n\\2"
#: Units that one generation of a cache holds, and the longest unit that is kept.
CACHE_UNITS, CACHE_CHARS = 500_000, 64
#: Kept units that are searched for each distinct unit of a slice.
LOOK = 4
#: Marks that may end a unit, and how many runs of them are kept.
MARKS, RUNS = ".,;:!?*#$%&|<>", 20_000


def cut(text: str) -> list[str]:
    """The text's units; each but the first has lost the space before it."""
    return SAFE_SPACE.split(text) if UNSAFE.search(text) else text.split(" ")


def _strings(column: pa.Array) -> list[str]:
    """to_pylist for strings without nulls, at once."""
    return column.to_numpy(zero_copy_only=False).tolist()


def _cut_all(texts: pa.Array, line_ends: bool) -> pa.Array:
    """cut() for each text (no nulls), by Arrow but for texts with an unsafe space. Units may be
    cut before a line end as well; what begins with one had no space before it."""
    odd = pc.match_substring_regex(texts, UNSAFE_ARROW)
    safe = pc.if_else(odd, "", texts)
    lists = pc.split_pattern(pc.replace_substring_regex(safe, LINE_END, LINE_CUT) if line_ends else safe, " ")
    places = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
    if not len(places):
        return lists
    own = pa.array([cut(text) for text in _strings(texts.filter(odd))], lists.type)
    order = np.arange(len(texts))
    order[places] = len(texts) + np.arange(len(own))
    return pa.concat_arrays([lists, own]).take(pa.array(order))


def _joined(found: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All ids, and how many each has."""
    parts = list(found)
    return np.frombuffer(b"".join(parts), "<u4"), np.fromiter(map(len, parts), np.int64, len(parts)) // 4


def _gather(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Stretches of ids, one after another."""
    ends = np.cumsum(sizes)
    shift = starts - (ends - sizes)
    if len(ids) < 2**31 and sizes.sum() < 2**31:
        shift = shift.astype(np.int32)
    at = np.repeat(shift, sizes)
    at += np.arange(len(at), dtype=at.dtype)
    return ids[at]


class Page:
    """Units that are kept together, their ids, how many each has, and which were used again."""

    def __init__(self, units: pa.Array, ids: np.ndarray, sizes: np.ndarray):
        self.units, self.ids, self.sizes = units, ids, sizes
        self.used = np.zeros(len(units), bool)

    def of(self, chosen: pa.Array) -> Page:
        own = chosen.to_numpy(zero_copy_only=False)
        return Page(self.units.filter(chosen), _gather(self.ids, (np.cumsum(self.sizes) - self.sizes)[own], self.sizes[own]), self.sizes[own])


class UnitEncoder:
    """encode_many: texts to ids, each as little-endian unsigned 32-bit integers. line_ends: a
    line end between two non-spaces is a piece of its own.

    encode keeps units in two generations: once the young one is full it becomes the old one,
    and what is used again moves over. encode_all keeps as many in pages, newest first;
    of the oldest only what was used again stays. Memory is bounded whatever the corpus holds.
    """

    def __init__(self, encode_many: Callable[[list[str]], Iterable[bytes]], limit: int = CACHE_UNITS, line_ends: bool = False):
        self.encode_many, self.limit, self.line_ends = encode_many, limit, line_ends
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.pages: list[Page] = []
        self.marks = dict(zip(MARKS, encode_many(list(MARKS))))

    def get(self, unit: str) -> bytes | None:
        """Ids of a unit (without the space before it) if they are kept."""
        return self.young.get(unit) or self.old.get(unit)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        head, *units = cut(text)
        first = b"".join(self.encode_many([head])) if head else b""
        return first + b"".join(self._found(units))

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (no nulls), one text after another, and how many each has. Each
        distinct unit of the texts is looked up once, and Python sees only those not kept."""
        if not len(texts):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        lists = _cut_all(texts, self.line_ends)
        flat, firsts = lists.flatten(), lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
        head = np.zeros(len(flat), bool)
        head[firsts] = True
        units, heads = flat.filter(pa.array(~head)).dictionary_encode(), flat.take(pa.array(firsts)).dictionary_encode()
        of_units, n_units = self._kept(units.dictionary)
        of_heads, n_heads = _joined(self.encode_many(_strings(heads.dictionary)))
        codes = np.empty(len(flat), np.int32)
        codes[~head], codes[firsts] = units.indices.to_numpy(), heads.indices.to_numpy() + len(n_units)
        sizes = np.concatenate([n_units, n_heads])
        n = sizes[codes]
        return _gather(np.concatenate([of_units, of_heads]), (np.cumsum(sizes) - sizes)[codes], n), np.add.reduceat(n, firsts)

    def _kept(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct units, each with the space before it, one after another, and how
        many each has. Marks at the end stand for themselves, as in _fresh."""
        letters = pc.utf8_rtrim(units, MARKS)
        marked = pc.and_(pc.utf8_is_alpha(pc.utf8_ltrim(letters, "\n")), pc.not_equal(letters, units))
        bases = pc.if_else(marked, letters, units).dictionary_encode()
        runs = pc.replace_substring_regex(units.filter(marked), f"^[^{MARKS}]*", "").dictionary_encode()
        ids, starts, sizes = self._paged(bases.dictionary)
        of_runs, n_runs = _joined(map(self._marks, _strings(runs.dictionary)))
        run_starts = len(ids) + np.cumsum(n_runs) - n_runs
        begin, n = np.zeros((len(units), 2), np.int64), np.zeros((len(units), 2), np.int64)  # of a unit's letters and its marks
        base, run, with_run = bases.indices.to_numpy(), runs.indices.to_numpy(), marked.to_numpy(zero_copy_only=False)
        begin[:, 0], n[:, 0] = starts[base], sizes[base]
        begin[with_run, 1], n[with_run, 1] = run_starts[run], n_runs[run]
        return _gather(np.concatenate([ids, of_runs]), begin.reshape(-1), n.reshape(-1)), n.sum(axis=1)

    def _paged(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids that hold those of distinct units, and where each unit's begin and how many they
        are. The newest pages are searched, in proportion to the units asked for, so that a
        small slice is cheap however much is kept; what they lack is encoded and makes a page."""
        pages, held = [], 0
        for page in self.pages:
            if held >= LOOK * len(units):
                break
            pages.append(page)
            held += len(page.units)
        found = pc.index_in(units, value_set=pa.chunked_array([page.units for page in pages], pa.string()))
        missing = units.filter(pc.is_null(found))
        lacking = pc.is_null(found).to_numpy(zero_copy_only=False)
        ids, sizes = _joined(self.encode_many([unit if unit[:1] == "\n" else " " + unit for unit in _strings(missing)]) if len(missing) else [])
        at = np.where(lacking, held + np.cumsum(lacking) - 1, pc.fill_null(found, 0).to_numpy())
        used = np.zeros(held + len(missing), bool)
        used[at] = True
        for page in pages:
            page.used |= used[: len(page.units)]
            used = used[len(page.units) :]
        self._keep(missing, ids, sizes)
        all_sizes = np.concatenate([*(page.sizes for page in pages), sizes])
        return np.concatenate([*(page.ids for page in pages), ids]), (np.cumsum(all_sizes) - all_sizes)[at], all_sizes[at]

    def _keep(self, units: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Make a page of the short units. While too much is kept, the oldest page goes, but for
        what was used since it was made."""
        fresh = Page(units, ids, sizes).of(pc.less_equal(pc.utf8_length(units), CACHE_CHARS))
        while True:
            if len(fresh.units):
                self.pages.insert(0, fresh)
            if sum(len(page.units) for page in self.pages) <= 2 * self.limit:
                return
            oldest = self.pages.pop()
            fresh = oldest.of(pa.array(oldest.used))

    def _found(self, units: list[str]) -> list[bytes]:
        """Ids of units, each with the space before it."""
        found = list(map(self.young.get, units))
        if None in found:
            gaps = [at for at, ids in enumerate(found) if ids is None]
            missing = [units[at] for at in gaps]
            fresh = self._fresh(dict.fromkeys(missing))
            for at, unit in zip(gaps, missing):
                found[at] = fresh[unit]
        return found

    def _fresh(self, missing: Iterable[str]) -> dict[str, bytes]:
        """Ids of units that the young generation lacks.

        A letter and a mark are never in one piece, so marks at the end stand for themselves.
        """
        fresh, marked, unseen, old = {}, [], {}, self.old
        for unit in missing:
            if unit in old:
                fresh[unit] = old[unit]
            elif unit.isalpha():
                unseen[unit] = None
            elif unit[-1:] in MARKS and (letters := unit.rstrip(MARKS)).isalpha():
                if (ids := self.get(letters)) is not None:
                    fresh[unit] = ids + self._marks(unit[len(letters) :])
                else:
                    marked.append((unit, letters))
                    unseen[letters] = None
            else:
                unseen[unit] = None
        order = list(unseen)
        fresh.update(zip(order, self.encode_many([" " + unit for unit in order])))
        if len(self.young) + len(fresh) > self.limit:
            self.old, self.young = self.young, {}
        self.young.update(fresh)
        for unit in fresh:
            if len(unit) > CACHE_CHARS:
                del self.young[unit]
        for unit, letters in marked:
            fresh[unit] = fresh[letters] + self._marks(unit[len(letters) :])
        return fresh

    def _marks(self, run: str) -> bytes:
        if (ids := self.marks.get(run)) is None:
            (ids,) = self.encode_many([run])
            if len(run) <= CACHE_CHARS and len(self.marks) < RUNS:
                self.marks[run] = ids
        return ids
