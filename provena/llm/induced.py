"""External induced sorting: suffix array and common prefixes of one shard.

The suffixes that start a rising run (LMS suffixes) are sorted first; all others
are induced from them in two sweeps over the alphabet. A sweep is driven by a
priority queue keyed by first character and order of arrival: one queue a
character, whose (position, common prefix with the one before) tuples lie in
blocks that go to disk beyond a memory limit. The common prefix of two induced
suffixes is one more than the least between their inducers, so it is carried
along with the tuples.

The LMS substrings themselves are sorted and named by the same induction. Where
names repeat, the string of names is sorted by recursion: every name is written
as two digits of a base that is the root of their number, so that a queue a
character stays feasible, and the order and common prefixes of the digits give
those of the names. The recursion ends where names no longer repeat, or where
their string fits into the memory limit: there it is sorted by prefix doubling.

Everything as long as the text (kinds, runs, names, the results, the strings of
digits) lies in arrays that are files beyond the memory limit, and is read and
written in chunks; what stays in memory are the limit, one buffer a queue, and
chunks.
"""

from __future__ import annotations

import tempfile
from collections import deque
from collections.abc import Iterator

import numpy as np

#: Common prefixes are counted up to here; equal substrings have more.
ENDLESS = 1 << 29
#: Tuples handled in one vectorised step, and characters or tuples in a chunk.
STEP, CHUNK = 1 << 15, 1 << 18
#: Bytes a name that sorting a string of names in memory takes.
BASE_BYTES = 48
#: Names up to this number are one digit each.
ONE_DIGIT = 256


class Space:
    """Arrays and blocks of tuples, beyond ``limit`` bytes in files that are private to the task and go with it."""

    def __init__(self, limit: int, folder: str | None = None):
        self.limit, self.folder, self.held, self.spilled, self.file = limit, folder, 0, 0, None

    def _file(self):
        return tempfile.TemporaryFile(dir=self.folder)  # private to this task, like Spark's own spills

    def array(self, n: int, kind) -> np.ndarray:
        size = n * np.dtype(kind).itemsize
        if self.held + size <= self.limit or not n:
            self.held += size
            return np.zeros(n, kind)
        self.spilled += size
        return np.memmap(self._file(), kind, "w+", shape=(n,))

    def free(self, *arrays: np.ndarray) -> None:
        for a in arrays:
            if not isinstance(a, np.memmap):
                self.held -= a.nbytes

    def put(self, positions: np.ndarray, common: np.ndarray) -> tuple:
        size = positions.nbytes + common.nbytes
        if self.held + size <= self.limit:
            self.held += size
            return positions, common
        self.spilled += size
        if self.file is None:
            self.file = self._file()
        self.file.seek(0, 2)
        at = self.file.tell()
        positions.tofile(self.file)
        common.tofile(self.file)
        return at, len(positions), positions.dtype

    def get(self, block: tuple, last: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """A block; ``last`` if it is not read again."""
        if isinstance(block[0], np.ndarray):
            if last:
                self.held -= block[0].nbytes + block[1].nbytes
            return block
        at, n, kind = block
        self.file.seek(at)
        return np.fromfile(self.file, kind, n), np.fromfile(self.file, np.int32, n)


class Queue:
    """First in, first out tuples of (position, common prefix), in blocks."""

    def __init__(self, space: Space, block: int):
        self.space, self.block, self.size, self.waiting = space, block, 0, 0
        self.stored: deque = deque()
        self.buffer: list = []

    def push(self, positions: np.ndarray, common: np.ndarray) -> None:
        self.buffer.append((positions, common))
        self.size += len(positions)
        self.waiting += len(positions)
        if self.waiting >= self.block:
            self.stored.append(self.space.put(*self._taken()))

    def _taken(self) -> tuple[np.ndarray, np.ndarray]:
        parts, self.buffer, self.waiting = self.buffer, [], 0
        return parts[0] if len(parts) == 1 else (np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))

    def pop(self) -> tuple[np.ndarray, np.ndarray]:
        """The first block that is there now."""
        got = self.space.get(self.stored.popleft()) if self.stored else self._taken()
        self.size -= len(got[0])
        return got


def _queues(letters: int, space: Space) -> list[Queue]:
    block = int(np.clip(space.limit // (24 * letters), 256, CHUNK))
    return [Queue(space, block) for _ in range(letters)]


def _deal(queues: list[Queue], letter: np.ndarray, positions: np.ndarray, common: np.ndarray) -> None:
    """Push tuples into the queues of their letters, in order."""
    order = np.argsort(letter, kind="stable")
    letter = letter[order]
    heads = np.flatnonzero(np.concatenate([[True], letter[1:] != letter[:-1]]))
    for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(letter)], strict=True):
        queues[letter[a]].push(positions[order[a:b]], common[order[a:b]])


def _range_min(values: np.ndarray):
    """least(i, j) of values[i..j], both included, for arrays of i <= j."""
    levels = [values]
    width = 1
    while 2 * width <= len(values):
        last = levels[-1]
        levels.append(np.minimum(last[:-width], last[width:]))
        width *= 2

    def least(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        level = np.frexp((j - i + 1).astype(float))[1] - 1
        out = np.empty(len(i), values.dtype)
        for k in np.unique(level):
            at = level == k
            row = levels[k]
            out[at] = np.minimum(row[i[at]], row[j[at] - (1 << int(k)) + 1])
        return out

    return least


class _Sweep:
    """Pushes the predecessors of scanned suffixes into the queues of their first characters."""

    def __init__(self, text: np.ndarray, rising: np.ndarray, kind: bool, letters: int, space: Space):
        self.text, self.rising, self.kind = text, rising, kind
        self.queues = _queues(letters, space)
        self.since = np.full(letters, ENDLESS, np.int32)  # least common prefix since a character's last push

    def scan(self, positions: np.ndarray, common: np.ndarray) -> None:
        for at in range(0, len(positions), STEP):
            self._step(positions[at : at + STEP], common[at : at + STEP])

    def _step(self, positions: np.ndarray, common: np.ndarray) -> None:
        before = np.maximum(positions - 1, 0)
        index = np.flatnonzero((positions > 0) & (self.rising[before] == self.kind))
        least = int(common.min())
        if not len(index):
            np.minimum(self.since, least, out=self.since)
            return
        letter = self.text[before[index]]
        order = np.argsort(letter, kind="stable")
        index, letter = index[order], letter[order]
        head = np.ones(len(index), bool)
        head[1:] = letter[1:] != letter[:-1]
        start = np.zeros(len(index), np.int64)
        start[1:] = index[:-1] + 1
        start[head] = 0
        value = _range_min(common)(start, index)
        heads = np.flatnonzero(head)
        value[heads] = np.minimum(value[heads], self.since[letter[heads]])
        value = np.minimum(value + 1, ENDLESS).astype(np.int32)
        np.minimum(self.since, least, out=self.since)
        tails = np.append(heads[1:], len(index))
        rest = np.append(np.minimum.accumulate(common[::-1])[::-1], np.int32(ENDLESS))
        self.since[letter[heads]] = rest[index[tails - 1] + 1]
        before = before[index]
        for c, a, b in zip(letter[heads].tolist(), heads.tolist(), tails.tolist(), strict=True):
            self.queues[c].push(before[a:b], value[a:b])


def _classify(text: np.ndarray, space: Space) -> tuple[np.ndarray, np.ndarray]:
    """Whether each suffix is smaller than the next one (S), and the length of its run of equal characters."""
    n = len(text)
    rising, runs = space.array(n, bool), space.array(n, np.int32)
    char, rise, run = -1, True, 0  # of the place after the chunk; the end marker counts as rising
    for stop in range(n, 0, -CHUNK):
        start = max(0, stop - CHUNK)
        part = np.append(text[start:stop], np.array([char], text.dtype))
        m = len(part) - 1
        at = np.where(part[:-1] != part[1:], np.arange(m), m)
        last = np.minimum.accumulate(at[::-1])[::-1]  # last place of the run; m where it goes on
        goes_on = last == m
        inner = np.minimum(last, m - 1)
        up = part[inner] < part[inner + 1]
        if char < 0:
            up[inner == m - 1] = True
        up[goes_on] = rise
        length = (last - np.arange(m) + 1).astype(np.int32)
        length[goes_on] += run - 1
        rising[start:stop], runs[start:stop] = up, length
        char, rise, run = int(part[0]), bool(up[0]), int(length[0])
    return rising, runs


def _shifted(common: np.ndarray, after: int) -> np.ndarray:
    """Common prefixes with the next one instead of the one before, last first."""
    return np.append(common[1:], np.int32(after))[::-1].astype(np.int32)


def _induce(text, rising, runs, letters, seeds: list[Queue], space: Space) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (positions, common prefix with the one before) of all suffixes that the sorted seeds induce, in order."""
    falling: list[list] = [[] for _ in range(letters)]
    edge: list = [None] * letters  # the largest falling suffix of a character
    down = _Sweep(text, rising, False, letters, space)
    for c in range(letters):
        last = None
        while down.queues[c].size:
            p, common = down.queues[c].pop()
            if last is None:
                common = common.copy()
                common[0] = 0
            last = int(p[-1])
            down.scan(p, common)
            falling[c].append(space.put(p, common))
        edge[c] = last
        first = True
        while seeds[c].size:
            p, common = seeds[c].pop()
            if first:
                common = common.copy()
                common[0] = 0 if last is None else min(runs[last], runs[p[0]])
                first = False
            down.scan(p, common)
    up = _Sweep(text, rising, True, letters, space)
    risen: list[list] = [[] for _ in range(letters)]
    least: list = [None] * letters  # the smallest rising suffix of a character
    end = len(text) - 1
    for c in range(letters - 1, -1, -1):
        last = None
        if c == 0:  # the end marker: nothing induces it
            up.queues[0].push(np.array([end], np.int64), np.zeros(1, np.int32))
        while up.queues[c].size:
            p, common = up.queues[c].pop()
            if last is None:
                common = common.copy()
                common[0] = 0
            last = int(p[-1])
            up.scan(p, common)
            risen[c].append(space.put(p, common))
        least[c] = last
        after = 0 if last is None or edge[c] is None else min(runs[last], runs[edge[c]])
        for block in reversed(falling[c]):
            p, common = space.get(block, False)
            up.scan(p[::-1], _shifted(common, after))
            after = int(common[0])
    for c in range(letters):
        for block in falling[c]:
            yield space.get(block)
        before = 0 if least[c] is None or edge[c] is None else min(runs[least[c]], runs[edge[c]])
        blocks = risen[c]
        while blocks:
            p, common = space.get(blocks.pop())
            # seen from the larger side: the common prefix of the first of the block before is the next one's here
            yield p[::-1], np.append(np.int32(before), common[:0:-1]).astype(np.int32)
            before = int(common[0])


def _chunks(n: int) -> Iterator[slice]:
    return (slice(a, min(a + CHUNK, n)) for a in range(0, n, CHUNK))


def _seed(text, positions, common, letters, space: Space) -> list[Queue]:
    """Queues of seeds by first character; ``common`` None means equal so far."""
    queues = _queues(letters, space)
    for s in _chunks(len(positions)):
        p = np.asarray(positions[s], np.int64)
        _deal(queues, text[p], p, np.full(len(p), ENDLESS, np.int32) if common is None else np.asarray(common[s]))
    return queues


def _chosen(blocks, wanted) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The wanted suffixes of blocks, with the common prefix with the wanted one before."""
    since = ENDLESS
    for p, common in blocks:
        at = np.flatnonzero(wanted(p))
        if len(at):
            least = np.minimum.reduceat(common[: at[-1] + 1], np.concatenate([[0], at[:-1] + 1]))
            least[0] = min(int(least[0]), since)
            yield p[at], least
            since = int(common[at[-1] + 1 :].min()) if at[-1] + 1 < len(common) else ENDLESS
        elif len(common):
            since = min(since, int(common.min()))


def _extend(text: np.ndarray, x: np.ndarray, y: np.ndarray, known: np.ndarray, cap: int) -> np.ndarray:
    """Common prefixes of suffixes x[i] and y[i], of which ``known`` is known, up to ``cap``; the end marker makes them differ."""
    out = np.minimum(known, cap).astype(np.int32)
    live = np.flatnonzero(out < cap)
    ahead, n = np.arange(8), len(text)
    while len(live):
        i, j = x[live] + out[live], y[live] + out[live]
        near = np.maximum(i, j) + 8 < n
        same = np.zeros(len(live), np.int32)
        wide = text[i[near, None] + ahead] == text[j[near, None] + ahead]
        same[near] = np.where(wide.all(axis=1), 8, wide.argmin(axis=1))
        same[~near] = text[i[~near]] == text[j[~near]]
        out[live] = np.minimum(out[live] + same, cap)
        live = live[(same == np.where(near, 8, 1)) & (out[live] < cap)]
    return out


def _doubling(names: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of a string of names by their first ``depth`` names at least."""
    rank, width, n = names.astype(np.int64), 1, len(names)
    while True:
        key = rank * (n + 1)
        key[:-width] += rank[width:] + 1
        order = np.argsort(key, kind="stable")
        sorted_ = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], sorted_[1:] != sorted_[:-1]]))
        width *= 2
        if width >= min(depth, n) or rank[order[-1]] == n - 1:
            return order


def _neighbours(text, order, common, cap) -> None:
    """Fill in the common prefixes of sorted suffixes with the one before, by comparison."""
    for s in _chunks(len(order)):
        a = max(s.start, 1)
        common[a : s.stop] = _extend(text, order[a - 1 : s.stop - 1], order[a : s.stop], np.zeros(s.stop - a, np.int32), cap)


def _sort_names(lms, names, count, text, cap, space: Space):
    """LMS positions in order, with common prefixes, by sorting the string of their names as digits."""
    n, digits = len(lms), 1 if count <= ONE_DIGIT else 2
    if BASE_BYTES * n <= space.limit:
        order, common = lms[_doubling(names[lms], cap)], np.zeros(n, np.int32)
        space.held += order.nbytes + common.nbytes
        _neighbours(text, order, common, cap)
        return order, common
    base = count if digits == 1 else int(np.ceil(np.sqrt(count)))
    string = space.array(n * digits + 1, np.int32)
    for s in _chunks(n):
        own = names[lms[s]].astype(np.int64)
        for k in range(digits):
            string[s.start * digits + k : s.stop * digits : digits] = own // base ** (digits - 1 - k) % base + 1
    wanted = lambda p: (p % digits == 0) & (p < n * digits)
    order, common = space.array(n, np.int64), space.array(n, np.int32)
    at, before = 0, None
    for p, equal in _chosen(sorted_suffixes(string, digits * (cap // 2 + 2), space), wanted):  # a name is two characters at least
        rank = p // digits
        k = np.minimum(equal // digits, n - 1).astype(np.int64)
        previous = np.concatenate([[rank[0] if before is None else before], rank[:-1]])
        known = lms[np.minimum(rank + k, n - 1)] - lms[rank]  # whole equal names; the last one ends the text
        x, y = lms[previous], lms[rank]
        common[at : at + len(p)] = _extend(text, x, y, known, cap) if before is not None else np.append(np.int32(0), _extend(text, x[1:], y[1:], known[1:], cap))
        order[at : at + len(p)] = y
        at, before = at + len(p), int(rank[-1])
    space.free(string)
    return order, common


def sorted_suffixes(text: np.ndarray, cap: int, space: Space) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of sorted suffix positions and common prefixes (up to about ``cap``) with the one before.

    ``text`` holds small non-negative integers and ends with its only 0.
    """
    n = len(text)
    letters = max(int(text[s].max()) for s in _chunks(n)) + 1
    if n == 1:
        yield np.zeros(1, np.int64), np.zeros(1, np.int32)
        return
    rising, runs = _classify(text, space)
    is_lms = space.array(n, bool)
    for s in _chunks(n):
        a = max(s.start, 1)
        is_lms[a : s.stop] = rising[a : s.stop] & ~rising[a - 1 : s.stop - 1]
    lms = space.array(int(sum(np.count_nonzero(is_lms[s]) for s in _chunks(n))), np.int64)
    at = 0
    for s in _chunks(n):
        found = np.flatnonzero(is_lms[s]) + s.start
        lms[at : at + len(found)] = found
        at += len(found)
    # sort the LMS substrings by inducing from them unsorted: equal first characters count as equal so far
    names, order = space.array(n, np.int32), space.array(len(lms), np.int64)
    at, name = 0, -1
    blocks = _induce(text, rising, runs, letters, _seed(text, lms, None, letters, space), space)
    for p, common in _chosen(blocks, lambda p: is_lms[p]):
        new = common < ENDLESS
        new[0] |= at == 0
        own = name + np.cumsum(new)
        names[p], order[at : at + len(p)] = own, p
        at, name = at + len(p), int(own[-1])
    if name + 1 < len(lms):
        space.free(order)
        order, common = _sort_names(lms, names, name + 1, text, cap, space)
    else:
        common = space.array(len(lms), np.int32)
        _neighbours(text, order, common, cap)
    space.free(names, is_lms, lms)
    seeds = _seed(text, order, common, letters, space)
    space.free(order, common)
    yield from _induce(text, rising, runs, letters, seeds, space)
    space.free(rising, runs)


def suffix_array(text: np.ndarray, cap: int = 1 << 20, memory: int = 256 << 20, folder: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All of ``sorted_suffixes`` as two arrays."""
    parts = list(sorted_suffixes(text, cap, Space(memory, folder)))
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
