"""Cutting texts at places where no token can cross, each distinct piece being worked on once.

A slice's texts are cut, and the pieces' numbers found, by array operations; Python sees
distinct pieces only, and what it makes of them is laid out by number again.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Fixed value: the pattern that splits a text before the merges of the public rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_OTHER, _LETTER, _NUMBER, _WHITE, _SPACE = range(5)
_CLASSES: np.ndarray | None = None


def slices(batch: pa.RecordBatch, column: int, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``most`` bytes of text, of one row at least."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(batch):
        base = size[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(size, base + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def _classes() -> np.ndarray:
    """What the pattern takes each code point for."""
    global _CLASSES
    if _CLASSES is None:
        import regex

        points = [*range(0xD800), *range(0xE000, 0x110000)]
        text, at = "".join(map(chr, points)), np.array(points)
        found = np.zeros(0x110000, np.uint8)
        for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_WHITE, r"\s+")):
            for m in regex.finditer(pattern, text):
                found[at[m.start() : m.end()]] = kind
        found[32] = _SPACE
        _CLASSES = found
    return _CLASSES


class Pieces:
    """The distinct pieces of some texts, each text's pieces by number, and where each
    text's begin."""

    def __init__(self, pieces: pa.Array, starts: np.ndarray):
        coded = pieces.dictionary_encode()
        self.dictionary: pa.Array = coded.dictionary
        self.codes = coded.indices.to_numpy()
        self.starts = starts

    def distinct(self) -> list[str]:
        return self.dictionary.to_numpy(zero_copy_only=False).tolist()

    def sums(self, made: np.ndarray) -> np.ndarray:
        """The sum of each text's pieces' numbers."""
        run = np.concatenate((np.zeros(1, made.dtype), np.cumsum(made[self.codes])))
        return run[self.starts[1:]] - run[self.starts[:-1]]


def _mark(texts: pa.Array) -> str:
    """A character that no text has."""
    for i in range(0x110000):
        if not pc.any(pc.match_substring(texts, chr(i))).as_py():
            return chr(i)
    raise ValueError("the texts use every character")


def marked_pieces(texts: pa.Array, regular: Callable[[pa.Array, str], pa.Array], odd: pa.Array, cut: Callable[[str], list[str]]) -> Pieces:
    """``regular`` puts a mark between pieces; texts that are ``odd`` are cut by ``cut``."""
    mark = _mark(texts)
    marked = regular(texts, mark)
    if pc.any(odd).as_py():
        own = [mark.join(cut(t.as_py())) if o else None for t, o in zip(texts, odd.to_pylist())]
        marked = pc.if_else(odd, pa.array(own, marked.type), marked)
    lists = pc.split_pattern(marked, mark)
    starts = lists.offsets.to_numpy()
    return Pieces(lists.flatten(), starts - starts[0])


def _token_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the pattern's matches begin, as flags; ``first`` flags the texts' beginnings.

    Matches are runs of letters, numbers or other signs, each with one space before it, and
    runs of white space.  Before a run of another kind white space gives its last
    character away: to that run if it is a space, else it stands alone.  An apostrophe
    that no space and no sign stands before takes a contraction's letters.
    """
    exact = _classes()[points]
    kind = np.minimum(exact, _WHITE)
    n = len(points)
    start = first.copy()
    start[1:] |= kind[1:] != kind[:-1]
    after = np.flatnonzero(start & ~first)
    after = after[kind[after - 1] == _WHITE]
    start[after - 1] = True
    start[after[exact[after - 1] == _SPACE]] = False
    quote = np.flatnonzero((points == 39) & start)
    quote = quote[quote + 1 < n]
    quote = quote[~first[quote + 1]]
    one = points[quote + 1]
    far = np.minimum(quote + 2, n - 1)
    two = np.where((quote + 2 < n) & ~first[far], points[far], 0)
    short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
    long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    size = np.where(short, 1, np.where(long, 2, 0))
    quote, size = quote[size > 0], size[size > 0]
    start[quote + 1] = False
    rest = quote + 1 + size
    rest = rest[rest < n]
    rest = rest[(kind[rest] == _LETTER) & ~first[rest]]
    start[rest] = True
    return start


def pretokens(texts: pa.Array) -> Pieces:
    """The matches of ``PATTERN`` in each text; nulls have none."""
    texts = pc.fill_null(texts, "").cast(pa.string())
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    low, high = int(bounds[0]), int(bounds[-1])
    if low == high:
        return Pieces(pa.array([], pa.string()), np.zeros(len(texts) + 1, np.int64))
    raw = np.frombuffer(data, np.uint8)[low:high]
    if raw.max() < 128:
        points, at = raw, None
        first = np.zeros(len(raw), bool)
        begins = bounds[:-1][bounds[:-1] < bounds[1:]] - low
        first[begins] = True
    else:
        points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
        at = np.flatnonzero((raw & 0xC0) != 0x80).astype(np.int32)
        first = np.zeros(len(points), bool)
        begins = bounds[:-1][bounds[:-1] < bounds[1:]] - low
        first[np.searchsorted(at, begins)] = True
    starts = np.flatnonzero(_token_starts(points, first))
    starts = (starts if at is None else at[starts]).astype(np.int32)
    ends = np.append(starts + low, np.int32(high))
    pieces = pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends), data)
    return Pieces(pieces, np.searchsorted(starts, bounds - low))


class Memo:
    """Results by piece, in two generations of at most ``limit`` entries (and one call's own)."""

    def __init__(self, compute: Callable[[list[str]], Iterable], limit: int = 250_000):
        self.compute, self.limit = compute, limit
        self.young: dict = {}
        self.old: dict = {}

    def all(self, pieces: list[str]) -> list:
        """The results of distinct pieces.  Nothing here makes cycles, so their collector,
        which would walk over all entries again and again, pauses."""
        runs = gc.isenabled()
        gc.disable()
        try:
            return self._all(pieces)
        finally:
            if runs:
                gc.enable()

    def _all(self, pieces: list[str]) -> list:
        if len(self.young) > self.limit:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        got = list(map(young.get, pieces))
        lost = [i for i, g in enumerate(got) if g is None]
        rest = []
        for i in lost:
            p = pieces[i]
            if p in old:
                young[p] = old[p]
            else:
                rest.append(p)
        young.update(zip(rest, self.compute(rest)))
        for i in lost:
            got[i] = young[pieces[i]]
        return got


def _gather(flat: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` that begin ``at``, of ``size`` each, end to end."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(at - ends + size, size)]


class TokenStore:
    """Ids of pre-tokens, end to end in one array.  ``compute`` gives the ids of some
    pre-tokens, end to end, and how many each has.  Of a slice's pre-tokens those are
    kept that occur in it twice; if there are more than ``limit``, the ones that the slice
    did not ask for go, so memory is that of a slice's repeated pre-tokens."""

    def __init__(self, compute: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], limit: int = 300_000):
        self.compute, self.limit = compute, limit
        self.place: dict[str, int] = {}
        self.flat, self.size, self.at = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and the texts' bounds in them."""
        runs = gc.isenabled()
        gc.disable()
        try:
            return self._encode(pretokens(texts))
        finally:
            if runs:
                gc.enable()

    def _encode(self, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
        own = pieces.distinct()
        place = np.fromiter(map(self.place.get, own, repeat(-1)), np.int64, len(own))
        lost = np.flatnonzero(place < 0)
        new, new_size = self.compute(pieces.dictionary.take(pa.array(lost)))
        place[lost] = len(self.size) + np.arange(len(lost))
        flat, size = np.concatenate((self.flat, new)), np.concatenate((self.size, new_size))
        at = np.concatenate((self.at, len(self.flat) + np.cumsum(new_size) - new_size))
        size, at = size[place], at[place]
        many = size[pieces.codes]
        ids = _gather(flat, at[pieces.codes], many)
        bounds = np.concatenate(([0], np.cumsum(many)))[pieces.starts]
        keep = np.bincount(pieces.codes, minlength=len(own)) > 1
        full = len(self.place) + int(keep[lost].sum()) > self.limit
        if full:
            asked = np.ones(len(own), bool)
            asked[lost] = False
            keep |= asked
            self.place, self.flat, self.size = {}, self.flat[:0], self.size[:0]
        kept = np.flatnonzero(keep) if full else lost[keep[lost]]
        n = len(self.place)
        self.place.update(zip([own[i] for i in kept.tolist()], range(n, n + len(kept))))
        self.flat = np.concatenate((self.flat, _gather(flat, at[kept], size[kept])))
        self.size = np.concatenate((self.size, size[kept]))
        self.at = np.cumsum(self.size) - self.size
        return ids, bounds
