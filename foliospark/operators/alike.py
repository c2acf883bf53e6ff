"""Similarities of all pairs of two blocks of names, in arrays: pairs of letters in common first, then the longest common subsequence by bits.

Each pair of letters has a row of bits, one for each name of a block, so adding up a name's rows bit by bit counts what it shares with 64
names at a time. How many pairs of letters two names share at least follows from their similarity, so no similar pair is left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np

from ..functions import similarity

#: Longest name whose letters fit the bits of a number; longer ones are compared one by one.
BITS = 63
#: Rows of bits; where there are more kinds of pairs of letters, some share a row, which lets more names through, never fewer.
ROWS = 4093
#: Repetitions of a pair of letters that are told apart.
DEEP = 4
#: Words of bits that are added up at a time, and pairs of names that are compared at a time.
WORDS, PAIRS = 1 << 13, 1 << 14
#: Names of one length that show how many similar ones there are, and how many times the wanted number counts as many.
SHOWN, MANY = 4, 2
ROUNDING = 1e-9
Found = tuple[np.ndarray, np.ndarray, np.ndarray]


class Names:
    """Names as a matrix of letters, numbered from 1 by an alphabet that both sides of a comparison share, and their pairs of letters.

    A mark in front and one behind count as letters for the pairs: pair ``p`` of a name of ``n`` letters ends at letter ``p + 1``, for
    ``p`` from 0 to ``n``.
    """

    def __init__(self, names: list[str], alphabet: np.ndarray) -> None:
        self.names, self.kinds = names, len(alphabet) + 1
        self.length = np.fromiter(map(len, names), np.int64, len(names))
        letters = np.searchsorted(alphabet, np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)) + 1
        name = np.repeat(np.arange(len(names)), self.length)
        at = np.arange(len(letters)) - np.repeat(np.cumsum(self.length) - self.length, self.length)
        self.letters = np.zeros((len(names), max(1, int(self.length[self.length <= BITS].max(initial=0)))), dtype=np.intp)
        fits = self.length[name] <= BITS
        self.letters[name[fits], at[fits]] = letters[fits]
        base = len(alphabet) + 3
        size = self.length + 1
        self.first = np.cumsum(size) - size
        self.owner = np.repeat(np.arange(len(names)), size)
        self.place = np.arange(len(self.owner)) - np.repeat(self.first, size)
        before, behind = (np.full(len(self.owner), base - k, dtype=np.int64) for k in (2, 1))
        before[self.first[name] + at + 1] = letters
        behind[self.first[name] + at] = letters
        self.pair, self.codes = before * base + behind, base * base
        self.kept: dict[bool, np.ndarray] = {}
        self.turned: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def rows(self, backwards: bool = False) -> np.ndarray:
        """The row of each pair of letters; the second, third, ... of a kind, from the front or from the back, have rows of their own."""
        if backwards not in self.kept:
            step = -1 if backwards else 1
            kind = (self.owner * self.codes + self.pair)[::step]
            order = np.argsort(kind, kind="stable")
            again = np.empty(len(kind), dtype=np.int64)
            again[order] = place_in_run(kind[order])
            self.kept[backwards] = (self.pair + self.codes * np.minimum(again[::step], DEEP - 1)) % ROWS
        return self.kept[backwards]

    def by_letter(self, m: int) -> tuple[np.ndarray, np.ndarray]:
        """The letters of the names of ``m`` letters, a row for each place in them, and which column a name has there."""
        if m not in self.turned:
            group = np.flatnonzero(self.length == m)
            column = np.zeros(len(self.names), dtype=np.intp)
            column[group] = np.arange(len(group))
            self.turned[m] = np.ascontiguousarray(self.letters[group, :m].T), column
        return self.turned[m]


def place_in_run(x: np.ndarray) -> np.ndarray:
    """How many equal values stand in front of each, where equal ones stand together."""
    at = np.arange(len(x))
    new = np.ones(len(x), dtype=bool)
    new[1:] = x[1:] != x[:-1]
    return at - np.maximum.accumulate(np.where(new, at, 0))


def alphabet_of(left: list[str], right: list[str]) -> np.ndarray:
    return np.unique(np.frombuffer("".join([*left, *right]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32))


def both(left: list[str], right: list[str]) -> tuple[Names, Names]:
    alphabet = alphabet_of(left, right)
    return Names(left, alphabet), Names(right, alphabet)


class Columns:
    """The bits of names: one column a name, those of one length beside each other from a whole word on."""

    def __init__(self, names: Names) -> None:
        self.names = names
        order = np.argsort(names.length, kind="stable")
        lengths, counts = np.unique(names.length, return_counts=True)
        words = -(-counts // 64)
        ends = np.cumsum(words)
        #: For each length its first word and the word behind its last one.
        self.parts = {int(m): (int(e - w), int(e)) for m, w, e in zip(lengths, words, ends, strict=True) if m}
        self.words = int(ends[-1]) if len(ends) else 0
        column = np.repeat((ends - words) * 64 - (np.cumsum(counts) - counts), counts) + np.arange(len(order))
        self.name = np.full(self.words * 64, -1, dtype=np.int64)
        self.name[column] = order
        self.column = np.empty(len(order), dtype=np.int64)
        self.column[order] = column
        self.forwards, self.backwards = names.rows(), names.rows(backwards=True)
        self.whole = self.bits(self.forwards, np.ones(len(names.owner), dtype=bool))
        self.kept: tuple[int, np.ndarray, np.ndarray] | None = None

    def bits(self, rows: np.ndarray, some: np.ndarray) -> np.ndarray:
        out = np.zeros(ROWS * self.words, dtype=np.uint64)
        column = self.column[self.names.owner[some]]
        np.bitwise_or.at(out, rows[some] * self.words + (column >> 6), np.uint64(1) << (column & 63).astype(np.uint64))
        return out.reshape(ROWS, self.words)

    def ends(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The bits of the first and the last ``n - 1`` letters of the names with ``n`` letters or more."""
        if self.kept is None or self.kept[0] != n:
            length, place = self.names.length[self.names.owner], self.names.place
            self.kept = n, self.bits(self.forwards, (length >= n) & (place <= n - 2)), self.bits(self.backwards, (length >= n) & (place >= length - n + 2))
        return self.kept[1:]


def counted(bits: np.ndarray, rows: np.ndarray, part: tuple[int, int]) -> list[np.ndarray]:
    """How many of its rows each name of a group has in each column, as bits of the number, lowest first."""
    waiting: list[list[np.ndarray]] = []

    def add(level: int, x: np.ndarray) -> None:
        if level == len(waiting):
            waiting.append([])
        waiting[level].append(x)
        if len(waiting[level]) == 3:
            a, b, c = waiting[level]
            u = a ^ b
            carry = a & b
            carry |= u & c
            u ^= c
            waiting[level] = [u]
            add(level + 1, carry)

    for k in range(rows.shape[1]):
        add(0, bits[rows[:, k], part[0] : part[1]])
    level = 0
    while level < len(waiting):
        if len(waiting[level]) == 2:
            a, b = waiting[level]
            waiting[level] = [a ^ b]
            add(level + 1, a & b)
        level += 1
    return [w[0] for w in waiting]


def at_least(planes: list[np.ndarray], need: int, shape: tuple[int, int]) -> np.ndarray:
    """Where the number that ``planes`` hold is ``need`` or more."""
    if need <= 0:
        return np.full(shape, ~np.uint64(0))
    if need >> len(planes):
        return np.zeros(shape, dtype=np.uint64)
    same, more = np.full(shape, ~np.uint64(0)), np.zeros(shape, dtype=np.uint64)
    for k in reversed(range(len(planes))):
        if need >> k & 1:
            same &= planes[k]
        else:
            more |= same & planes[k]
            same &= ~planes[k]
    return more | same


def whole_need(n: int, m: int, t: float) -> int | None:
    """How many pairs of letters, marks included, names of ``n`` and ``m`` letters share from the ratio ``t`` on; None if they can't have it.

    Of ``common`` letters with both marks, each letter that isn't in them breaks one pair of them.
    """
    common = math.ceil(t * (n + m) / 2 - ROUNDING)
    return None if common > min(n, m) else 3 * common + 1 - n - m


def end_windows(n: int, t: float) -> list[tuple[int, int]]:
    """The sizes below ``n`` of windows at a name's end, and how many letters they must have in common with one of ``n`` letters."""
    each = ((w, math.ceil(t * (n + w) / 2 - ROUNDING)) for w in range(1, n))
    return [(w, c) for w, c in each if c <= w]


def candidates(one: Names, others: Columns, kind: str, t: float, turned: bool) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(n, m, places in one, places in others) of all pairs that may be similar; for partial ``one`` has the shorter names."""
    rows = one.rows()
    for n in map(int, np.unique(one.length[one.length > 0])):
        group = np.flatnonzero(one.length == n)
        own = rows[one.first[group][:, None] + np.arange(n + 1)]
        for m, part in others.parts.items():
            if kind == "partial" and m < n + turned:
                continue
            step = max(1, WORDS // (part[1] - part[0]))
            need = whole_need(n, m, t)
            if kind == "ratio" and need is None:
                continue
            for a in range(0, len(group), step):
                some = own[a : a + step]
                shape = (len(some), part[1] - part[0])
                hit = np.zeros(shape, dtype=np.uint64)
                if kind == "ratio" or m == n:
                    hit |= at_least(counted(others.whole, some, part) if need > 0 else [], need, shape)
                else:
                    need = 3 * math.ceil(t * n - ROUNDING) - 1 - 2 * n
                    hit |= at_least(counted(others.whole, some[:, 1:-1], part) if need > 0 else [], need, shape)
                windows = end_windows(n, t) if kind == "partial" else []
                if windows:  # a window at the end has one mark
                    need = min(3 * c - n - w for w, c in windows)
                    for bits, mine in zip(others.ends(n), (some[:, :-1], some[:, 1:]), strict=True):
                        hit |= at_least(counted(bits, mine, part) if need > 0 else [], need, shape)
                i, w = divmod(np.flatnonzero(hit.ravel()), hit.shape[1])
                for k in range(0, len(i), PAIRS):
                    bits = np.unpackbits(hit[i[k : k + PAIRS], w[k : k + PAIRS]].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                    word, bit = np.nonzero(bits)
                    name = others.name[(part[0] + w[k : k + PAIRS][word]) * 64 + bit]
                    real = name >= 0
                    yield n, m, group[a + i[k : k + PAIRS][word[real]]], name[real]


def common(masks: np.ndarray, letters: np.ndarray, n: int, at: list[int]) -> list[np.ndarray]:
    """Length of the longest common subsequence of names of ``n`` letters and the first ``at`` letters of others.

    ``letters`` has a row for each letter of the others; its values are places in ``masks``.
    """
    state = np.full(letters.shape[1], (1 << n) - 1, dtype=masks.dtype)
    full, out = masks.dtype.type((1 << n) - 1), []
    for j in range(at[-1]):
        own = masks[letters[j]]
        own &= state
        carried = state + own
        state -= own
        state |= carried
        if j + 1 in at:
            out.append(n - np.bitwise_count(state & full).astype(np.int64))
    return out


class Exact:
    """The similarities of pairs of names, whose letters' masks are made once for all names of ``one``."""

    def __init__(self, one: Names, others: Names, kind: str, least: float) -> None:
        self.one, self.others, self.kind, self.least = one, others, kind, least
        self.by_length: tuple[int, np.ndarray, np.ndarray, np.ndarray] | None = None

    def masks(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the names of ``n`` letters: their place in the masks, and the masks of each letter forwards and backwards."""
        if self.by_length is None or self.by_length[0] != n:
            group = np.flatnonzero(self.one.length == n)
            form = np.uint32 if n < 32 else np.uint64
            place = np.zeros(len(self.one.names), dtype=np.intp)
            place[group] = np.arange(len(group)) * self.one.kinds
            sides = []
            for at in (np.arange(n), np.arange(n)[::-1]):
                out = np.zeros(len(group) * self.one.kinds, dtype=form)
                np.bitwise_or.at(out, (place[group][:, None] + self.one.letters[group, :n]).ravel(), np.tile(form(1) << at.astype(form), len(group)))
                sides.append(out)
            self.by_length = n, place, *sides
        return self.by_length[1:]

    def scores(self, n: int, m: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Exact wherever the similarity is ``least`` or more."""
        if max(n, m) > BITS:
            how = similarity.ratio if self.kind == "ratio" else similarity.partial_ratio
            return np.array([how(self.one.names[x], self.others.names[y]) for x, y in zip(i, j, strict=True)], dtype=np.float64)
        place, forwards, backwards = self.masks(n)
        letters, column = self.others.by_letter(m)
        letters = letters.take(column[j], axis=1)
        if i[0] == i[-1] and (i == i[0]).all():  # where most names are met, all are those of one
            forwards, backwards = (x[place[i[0]] : place[i[0]] + self.one.kinds] for x in (forwards, backwards))
        else:
            letters += place[i]
        if self.kind == "ratio":
            return 200.0 * common(forwards, letters, n, [m])[0] / (n + m)
        return partial(forwards, backwards, letters, n, m, self.least)


def partial(forwards: np.ndarray, backwards: np.ndarray, letters: np.ndarray, n: int, m: int, least: float) -> np.ndarray:
    """The partial ratio of names of ``n`` letters and others of ``m``, at least as many, exact wherever it is ``least`` or more.

    A window that begins or ends with the other name is read off one pass over its beginnings, forwards and backwards; windows of full
    length are compared only where the whole names have as many letters in common as those need.
    """
    t = least / 100
    best = np.zeros(letters.shape[1])
    sizes = [w for w, _ in end_windows(n, t)] + [n]
    at = sorted({*sizes, m})
    ends = dict(zip(at, common(forwards, letters, n, at), strict=True))
    good = np.flatnonzero(ends[m] >= t * n / (2 - t) - ROUNDING)
    if not len(good):
        return best
    letters, whole = letters[:, good], ends[m][good]
    behind = dict(zip(sizes, common(backwards, letters[::-1], n, sizes), strict=True))
    for w in sizes:
        best[good] = np.maximum(best[good], 200.0 * np.maximum(ends[w][good], behind[w]) / (n + w))
    inner = np.flatnonzero(100.0 * whole / n >= least - ROUNDING) if m > n + 1 else []
    if len(inner):
        some, top = letters[:, inner], np.zeros(len(inner), dtype=np.int64)
        for i in range(1, m - n):
            top = np.maximum(top, common(forwards, some[i : i + n], n, [n])[0])
        best[good[inner]] = np.maximum(best[good[inner]], 100.0 * top / n)
    return best


def alike(left: Names, right: Names, kind: str, least: float, columns: list[Columns] | None = None) -> Iterator[Found]:
    """(places in left, places in right, scores) of the pairs that are similar by ``kind`` (ratio or partial) by ``least`` percent.

    Scores have the same digits as those of ``similarity``. Empty names are similar to none. ``columns`` may hold the right names' bits.
    """
    t = least / 100
    # For partial each pair has its shorter name as ``one``; of names of one length that is the left one.
    for one, others, turned in [(left, right, False)] + [(right, left, True)] * (kind == "partial"):
        exact = Exact(one, others, kind, least)
        bits = columns[0] if columns and not turned else Columns(others)
        for n, m, i, j in candidates(one, bits, kind, t, turned):
            for k in range(0, len(i), PAIRS):
                x, y = i[k : k + PAIRS], j[k : k + PAIRS]
                score = exact.scores(n, m, x, y)
                good = score >= least - ROUNDING
                if good.any():
                    pair = x[good], y[good]
                    yield *(pair[::-1] if turned else pair), score[good]


def joined(parts: list[Found]) -> Found:
    if not parts:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def first_of(found: Found, most: int) -> Found:
    """The ``most`` best pairs of each left name; ties go to the right name that comes first."""
    i, j, score = found
    order = np.lexsort((j, -score, i))
    kept = order[place_in_run(i[order]) < most]
    return i[kept], j[kept], score[kept]


def best(left: list[str], right: list[str], kind: str, least: float, most: int, above: float) -> Iterator[tuple[Found, np.ndarray]]:
    """The ``most`` best of the pairs of ``alike`` for each left name, ties to the right name that comes first, and places of left names.

    Of the left names named there, which have many similar ones, only pairs from ``least + above`` on are given; so they are the best ones
    only where they are ``most``. With ``above`` 0 there are none.
    """
    alphabet = alphabet_of(left, right)
    others = Names(right, alphabet)
    columns = [Columns(others)]
    lengths = np.fromiter(map(len, left), np.int64, len(left))
    some = lambda places: Names([left[k] for k in places], alphabet)
    many, few = [], []
    for n in np.unique(lengths[lengths > 0]):
        group = np.flatnonzero(lengths == n)
        shown = group[:: max(1, len(group) // SHOWN)][:SHOWN]
        known = above > 0 and len(group) > 4 * SHOWN
        (many if known and sum(len(i) for i, _, _ in alike(some(shown), others, kind, least, columns)) > MANY * most * SHOWN else few).append(group)
    for groups, level in ((many, least + above), (few, least)):
        if groups:
            places = np.sort(np.concatenate(groups))
            i, j, score = first_of(joined(list(alike(some(places), others, kind, level, columns))), most)
            yield (places[i], j, score), places if level > least else places[:0]


def ratios(one: Names, i: int, others: Names) -> np.ndarray:
    """The ratio of one name and all others; 0 for an empty name."""
    n, m = int(one.length[i]), others.length
    out = np.zeros(len(m))
    fits = (m <= BITS) & (n <= BITS)
    if n and fits.any():
        masks = np.zeros(one.kinds, dtype=np.uint64)
        np.bitwise_or.at(masks, one.letters[i, :n], np.uint64(1) << np.arange(n, dtype=np.uint64))
        letters = others.letters[fits].T
        out[fits] = 200.0 * common(masks, letters, n, [len(letters)])[0] / (n + m[fits])
    for k in np.flatnonzero(~fits):
        out[k] = similarity.ratio(one.names[i], others.names[k])
    return out


def of_pairs(left: list[str], right: list[str], kind: str) -> np.ndarray:
    """The similarity of each name of ``left`` and the one beside it in ``right``, with the same digits as ``similarity``."""
    if kind == "token_set":
        words = [(set(a.split()), set(b.split())) for a, b in zip(left, right, strict=True)]
        shared = [" ".join(sorted(x & y)) for x, y in words]
        one, two = ([f"{c} {' '.join(sorted(w[k] - w[1 - k]))}".strip() for c, w in zip(shared, words, strict=True)] for k in (0, 1))
        out = of_pairs(one, two, "ratio")
        for k, c in enumerate(shared):
            if not words[k][0] or not words[k][1]:
                out[k] = 0.0
            elif c and (c == one[k] or c == two[k]):
                out[k] = 100.0
            elif c:  # what both begin with is common as a whole
                out[k] = max(out[k], 200.0 * len(c) / (len(c) + min(len(one[k]), len(two[k]))))
        return out
    if kind == "partial":
        left, right = zip(*(sorted(x, key=len) for x in zip(left, right, strict=True)), strict=True) if left else ((), ())
    one, others = both(list(left), list(right))
    out = np.zeros(len(one.names))
    exact = Exact(one, others, kind, 0.0)
    sizes = np.stack([one.length, others.length], axis=1)
    order = np.lexsort((sizes[:, 1], sizes[:, 0]))
    for group in np.split(order, np.flatnonzero((np.diff(sizes[order], axis=0) != 0).any(axis=1)) + 1) if len(order) else []:
        n, m = map(int, sizes[group[0]])
        if n and m:
            out[group] = exact.scores(n, m, group, group)
        elif not n and not m and kind == "ratio":
            out[group] = 100.0
    return out
