"""Suffix and common-prefix arrays of one shard by induced sorting with disk-backed queues.

Suffixes are sorted by induction from the left-most-S suffixes: a queue keyed by first symbol hands out entries in suffix
order, each entry puts its predecessor into the queue of that symbol, first the L suffixes in ascending order, then the S
suffixes in descending order. An entry is a tuple (place, common prefix with the entry before it); the common prefix is
carried along: 1 + the smallest value between the two entries that induced it. Entries of one symbol are taken in batches,
so the queues are read and written in blocks; blocks beyond a memory bound go to a file.

The order of the left-most-S suffixes comes from the recursive problem: their substrings are named in order and the string
of names is sorted. Once names are unique, or have been compared over `depth` bytes, the recursion ends; names are ranked by
doubling there, as batches of one symbol are too short for an alphabet as large as the string.

Common prefixes are cut at `depth`: suffixes that agree over `depth` bytes may come in any order.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

SPILL_BYTES = 64_000_000
NONE = np.zeros(0, np.int32)


class SymbolQueues:
    """One first-in-first-out queue of (place, common prefix) tuples per symbol; the largest are written out when memory is short.

    The file belongs to the running task alone and goes with it, as Spark's own spills do.
    """

    def __init__(self, limit: int = SPILL_BYTES):
        self.limit, self.held = limit, 0
        self.blocks: list[list] = [[] for _ in range(257)]
        self.file = None

    def put(self, symbol: int, place: np.ndarray, lcp: np.ndarray) -> None:
        self.blocks[symbol].append((place, lcp))
        self.held += place.nbytes + lcp.nbytes
        if self.held > self.limit:
            self.spill()

    def spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        for queue in self.blocks:
            for k, block in enumerate(queue):
                if len(block) == 2 and len(block[0]) > 1000:
                    at = self.file.seek(0, os.SEEK_END)
                    self.file.write(block[0].tobytes())
                    self.file.write(block[1].tobytes())
                    queue[k] = (at, len(block[0]), None)
                    self.held -= block[0].nbytes + block[1].nbytes

    def take(self, symbol: int) -> tuple[np.ndarray, np.ndarray]:
        """All entries of a symbol in order of arrival."""
        queue, self.blocks[symbol] = self.blocks[symbol], []
        places, lcps = [], []
        for block in queue:
            if len(block) == 2:
                self.held -= block[0].nbytes + block[1].nbytes
            else:
                self.file.seek(block[0])
                data = self.file.read(block[1] * 6)
                block = np.frombuffer(data[: block[1] * 4], np.int32), np.frombuffer(data[block[1] * 4 :], np.uint16)
            places.append(block[0])
            lcps.append(block[1])
        return (np.concatenate(places), np.concatenate(lcps)) if places else (NONE, NONE.astype(np.uint16))

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def range_min(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Minimum of values[low..high], both included, by doubling tables."""
    out = np.empty(len(low), values.dtype)
    span = high - low + 1
    level = np.zeros(len(low), np.int64)
    np.floor(np.log2(span), out=level, casting="unsafe")
    power, table = 0, values
    for want in range(int(level.max(initial=0)) + 1):
        while power < want:
            table = np.minimum(table[: -(1 << power)], table[1 << power :])
            power += 1
        on = level == want
        out[on] = np.minimum(table[low[on]], table[high[on] - (1 << want) + 1])
    return out


def s_types(text: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the one after it; the last suffix counts as S."""
    n = len(text)
    out = np.ones(n, bool)
    if n > 1:
        differs = np.flatnonzero(text[:-1] != text[1:])
        rising = text[differs] < text[differs + 1]
        which = np.searchsorted(differs, np.arange(n - 1))
        inside = which < len(differs)
        out[:-1][inside] = rising[which[inside]]
        out[:-1][~inside] = False
    return out


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix of the suffixes at a and b, cut at depth; for few pairs."""
    lcp = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    for step in range(depth):
        x, y = a[live] + step, b[live] + step
        fits = (x < len(text)) & (y < len(text))
        live, x, y = live[fits], x[fits], y[fits]
        live = live[text[x] == text[y]]
        if not len(live):
            break
        lcp[live] = step + 1
    return lcp


def sorted_lms(text: np.ndarray, lms: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Left-most-S suffixes in order (equal ones over `depth` bytes in any order) with their common prefixes."""
    if len(lms) < 2:
        return lms.astype(np.int32), np.zeros(len(lms), np.uint16)
    # name the substrings between neighbours by rank, then rank the string of names over doubling spans
    length = np.append(np.diff(lms) + 1, 1)
    levels = [name_substrings(text, lms, length)]
    names, bytes_at = levels[0], lms
    width = 1
    while True:
        top = int(names.max())
        if top + 1 == len(names) or width >= depth:
            break
        nxt = np.zeros(len(names), np.int64)
        nxt[:-width] = names[width:] + 1 if width < len(names) else 0
        _, names = np.unique(names * (top + 2) + nxt, return_inverse=True)
        levels.append(names)
        width *= 2
    order = np.argsort(names, kind="stable")
    # common prefixes: whole equal names level by level, then the bytes of the first differing substring
    a, b = order[:-1].copy(), order[1:].copy()
    skipped = np.zeros(len(a), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        rank, step = levels[level], 1 << level
        fits = (a + step < len(lms)) & (b + step < len(lms))
        same = np.zeros(len(a), bool)
        same[fits] = rank[a[fits]] == rank[b[fits]]
        same &= skipped < depth
        skipped[same] += bytes_at[a[same] + step] - bytes_at[a[same]]
        a[same] += step
        b[same] += step
    lcp = np.minimum(skipped, depth)
    rest = np.flatnonzero(lcp < depth)
    lcp[rest] += common_prefix(text, lms[a[rest]], lms[b[rest]], depth)
    return lms[order].astype(np.int32), np.concatenate(([0], np.minimum(lcp, depth))).astype(np.uint16)


def name_substrings(text: np.ndarray, lms: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Rank of each left-most-S substring (its bytes up to and including the next left-most-S place)."""
    rank = np.zeros(len(lms), np.int64)
    live = np.arange(len(lms))
    at = 0
    padded = np.append(text.astype(np.int64) + 1, 0)
    beyond = np.full(len(lms), 258)
    beyond[-1] = 0  # the end of the text is smaller than all
    while len(live):
        # six symbols at a time; after its end a substring counts as large: it ends in an S place, a longer one has an L place there
        key = np.zeros(len(live), np.int64)
        for j in range(6):
            inside = at + j < length[live]
            key = key * 259 + np.where(inside, padded[np.minimum(lms[live] + at + j, len(text))], beyond[live])
        _, key = np.unique(key, return_inverse=True)
        _, fresh = np.unique(rank[live] * (len(live) + 1) + key, return_inverse=True)
        # groups keep their place: members of a group are numbered from the group's first rank on
        count = np.bincount(fresh)
        begin = np.cumsum(count) - count
        group_of = np.zeros(len(count), np.int64)
        group_of[fresh] = rank[live]
        _, starts, inverse = np.unique(group_of, return_index=True, return_inverse=True)
        first = begin - begin[starts][inverse]
        rank[live] = group_of[fresh] + first[fresh]
        at += 6
        again = (count[fresh] > 1) & (length[live] > at)
        # a group goes on if any member has bytes left
        more = np.zeros(len(count), bool)
        more[fresh[again]] = True
        live = live[more[fresh]]
    _, names = np.unique(rank, return_inverse=True)
    return names


def suffix_order(text: np.ndarray, depth: int, limit: int = SPILL_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Places of all suffixes in order of their first `depth` symbols, and common prefixes with the suffix before, cut at depth.

    Symbols are 0 to 256. The text ends in a 0 that follows a larger symbol; other zeros separate strings in the same way.
    """
    n = len(text)
    if n == 0:
        return NONE, NONE.astype(np.uint16)
    is_s = s_types(text)
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    seeds, seed_lcp = sorted_lms(text, lms, depth)
    seed_symbol = text[seeds]
    queues = SymbolQueues(limit)
    l_part = induce(text, is_s, queues, False, depth, seeds, seed_lcp, seed_symbol, None)
    out = induce(text, is_s, queues, True, depth, seeds, seed_lcp, seed_symbol, l_part)
    queues.close()
    return out


def induce(text, is_s, queues, s_phase, depth, seeds, seed_lcp, seed_symbol, l_part):
    """One pass over the symbols; gives the L entries per symbol, or the whole order in the S pass."""
    tail = np.zeros(257, np.int64)  # smallest value since the last entry that fed a symbol
    fed = np.full(257, -1, np.int64)
    result: dict[int, tuple] = {}
    last = None  # the entry before, in the order of this pass
    whole: list[tuple] = []

    def feed(place: np.ndarray, lcp: np.ndarray) -> None:
        """Hand a batch out: predecessors of the wanted type go to their symbol's queue."""
        nonlocal tail
        low = int(lcp.min())
        source = np.flatnonzero(place > 0)
        before = place[source] - 1
        wanted = is_s[before] == s_phase
        source, before = source[wanted], before[wanted]
        symbol = text[before]
        order = np.argsort(symbol, kind="stable")
        source, before, symbol = source[order], before[order], symbol[order]
        tail_after = np.minimum(tail, low)
        if len(source):
            head = np.flatnonzero(np.concatenate(([True], symbol[1:] != symbol[:-1])))
            start = np.zeros(len(source), np.int64)
            start[1:] = source[:-1] + 1
            start[head] = 0
            least = range_min(lcp, start, source).astype(np.int64)
            first = symbol[head].astype(np.int64)
            least[head] = np.where(fed[first] >= 0, np.minimum(least[head], tail[first]), -1)
            value = np.minimum(least + 1, depth).astype(np.uint16)
            ends = np.append(head[1:], len(source))
            suffix_low = np.minimum.accumulate(lcp[::-1])[::-1]
            for c, s, e in zip(first.tolist(), head.tolist(), ends.tolist(), strict=True):
                queues.put(c, before[s:e].astype(np.int32), value[s:e])
                after = int(source[e - 1]) + 1
                tail_after[c] = int(suffix_low[after]) if after < len(lcp) else depth
                fed[c] = 1
        tail = tail_after

    symbols = np.unique(text)
    for c in (symbols[::-1] if s_phase else symbols).tolist():
        got: list[tuple] = []
        first_of_symbol = True
        while True:
            place, lcp = queues.take(c)
            if not len(place):
                break
            lcp = lcp.copy()
            if first_of_symbol:
                lcp[0] = 0
                first_of_symbol = False
            feed(place, lcp)
            got.append((place, lcp))
            last = int(place[-1])
        if s_phase and c == 0:
            # nothing follows the end of the text, so nothing induces it: the smallest suffix
            lcp = np.array([1 if got else 0], np.uint16)
            got.append((np.array([len(text) - 1], np.int32), lcp))
        if s_phase:
            # descending: the L entries of the symbol come after its S entries; values belong to the neighbour above
            low_place, low_lcp = l_part.get(c, (NONE, NONE.astype(np.uint16)))
            s_place = np.concatenate([x[0] for x in got]) if got else NONE
            s_lcp = np.concatenate([x[1] for x in got]) if got else NONE.astype(np.uint16)
            if len(low_place):
                down = low_place[::-1]
                lcp = np.zeros(len(down), np.uint16)
                lcp[1:] = low_lcp[:0:-1]
                if len(s_place):
                    lcp[0] = common_prefix(text, np.array([last]), down[:1].astype(np.int64), depth)[0]
                feed(down, lcp)
                s_place, s_lcp = np.concatenate((s_place, down)), np.concatenate((s_lcp, lcp))
            whole.append((s_place, s_lcp))
        else:
            result[c] = (np.concatenate([x[0] for x in got]), np.concatenate([x[1] for x in got])) if got else (NONE, NONE.astype(np.uint16))
            on = np.flatnonzero(seed_symbol == c)
            if len(on):
                place, lcp = seeds[on], seed_lcp[on].copy()
                lcp[0] = common_prefix(text, np.array([last]), place[:1].astype(np.int64), depth)[0] if got else 0
                feed(place, lcp)
                last = int(place[-1])
    if not s_phase:
        return result
    place = np.concatenate([x[0] for x in whole])[::-1]
    lcp = np.concatenate([x[1] for x in whole])
    up = np.zeros(len(lcp), np.uint16)
    up[1:] = lcp[:0:-1]
    return place, up
