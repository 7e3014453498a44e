"""Suffix order and common prefixes by external induced sorting.

The sorted starred suffixes (an S-suffix after an L-suffix) induce all others: a sweep takes suffixes in order
from a priority queue and inserts the suffix one place further left. Queue entries are tuples of first letter, place
and length of the prefix shared with the entry before. The queue is cut by letter ranges; a range is read when the
sweep reaches it, until then its tuples wait in memory or, beyond a bound, in files. Starred suffixes are sorted by
naming their substrings and, where names repeat, by the same procedure on the names, until these are few enough to
be sorted in memory.
"""

from __future__ import annotations

import io

RANGE = 1 << 10  # least tuples of a range of letters; one frequent letter may hold more
SWEEP = 1 << 16  # tuples swept at once
DIRECT = 1 << 20  # names sorted in memory, where the recursion ends


class Spill:
    """Where tuples wait that don't fit in memory: files under a folder, removed once read."""

    def __init__(self, folder: str | None = None, most: int = 256 << 20):
        self.folder, self.most, self.held, self.files, self.store = folder, most, 0, 0, None

    def write(self, array) -> str:
        import numpy as np

        from rollbook.llm.shared import open_store

        self.store, path = open_store(self.folder)
        self.store.create_dir(path, recursive=True)
        name = f"{path}/{self.files}.npy"
        self.files += 1
        data = io.BytesIO()
        np.save(data, array)
        with self.store.open_output_stream(name, compression=None) as out:
            out.write(data.getbuffer())
        return name

    def read(self, name: str):
        import numpy as np

        with self.store.open_input_stream(name, compression=None) as f:
            data = f.read()
        self.store.delete_file(name)
        return np.load(io.BytesIO(data))

    def close(self) -> None:
        if self.files:
            from rollbook.llm.shared import open_store

            store, path = open_store(self.folder)
            store.delete_dir(path)


class Queue:
    """Tuples (letter, place, prefix) by ranges of letters, each in the order of insertion."""

    def __init__(self, range_of, ranges: int, spill: Spill):
        self.range_of, self.spill = range_of, spill
        self.waiting: list[list] = [[] for _ in range(ranges)]
        self.filed: list[list[str]] = [[] for _ in range(ranges)]
        self.fresh: list = []

    def insert(self, tuples) -> None:
        self.fresh.append(tuples)

    def _deal(self) -> None:
        """Hand what was inserted since the last take to its ranges; file everything if too much waits."""
        import numpy as np

        if not self.fresh:
            return
        tuples = np.concatenate(self.fresh, axis=1)
        self.fresh = []
        at = self.range_of[tuples[0]]
        order = np.argsort(at, kind="stable")
        at, tuples = at[order], tuples[:, order]
        edges = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1, [len(at)]])
        for r, a, b in zip(at[edges[:-1]].tolist(), edges[:-1].tolist(), edges[1:].tolist()):
            self.waiting[r].append(tuples[:, a:b])
        self.spill.held += tuples.nbytes
        if self.spill.held > self.spill.most and self.spill.folder:
            for r, parts in enumerate(self.waiting):
                if parts:
                    self.filed[r].append(self.spill.write(np.concatenate(parts, axis=1)))
                    self.waiting[r] = []
            self.spill.held = 0

    def take(self, r: int):
        """All tuples of a range, by letter, in the order of insertion."""
        import numpy as np

        self._deal()
        parts = [self.spill.read(name) for name in self.filed[r]] + self.waiting[r]
        self.spill.held = max(0, self.spill.held - sum(p.nbytes for p in self.waiting[r]))
        self.waiting[r], self.filed[r] = [], []
        if not parts:
            return np.zeros((3, 0), dtype=np.int64)
        tuples = np.concatenate(parts, axis=1)
        return tuples[:, np.argsort(tuples[0], kind="stable")]


def _range_minima(values, low, high):
    """Minimum of values[low..high] for each pair; low <= high."""
    import numpy as np

    if int((high - low).sum()) < 32 * len(values):
        edges = np.empty(2 * len(low), dtype=np.int64)
        edges[::2], edges[1::2] = low, high + 1
        return np.minimum.reduceat(np.append(values, 0), edges)[::2]
    table = [values]
    most = int((high - low).max()) + 1
    while 2 << (len(table) - 1) <= most:
        half, last = 1 << (len(table) - 1), table[-1]
        table.append(np.minimum(last, np.concatenate([last[half:], last[-1:].repeat(half)])))
    table = np.stack(table)
    k = np.floor(np.log2(high - low + 1)).astype(np.int64)
    return np.minimum(table[k, low], table[k, high - (1 << k) + 1])


def induce(letters, wanted, seeds, prefixes, runs, cap: int, spill: Spill):
    """Order of the ``wanted`` suffixes by ascending ``letters``, from ordered ``seeds``.

    Of one first letter, wanted suffixes come before seeds. ``prefixes`` holds what each seed shares with the one
    before; the result has the same for the wanted suffixes of one first letter. Each sweep takes as many tuples
    as nothing inserted by them can still precede.
    """
    import numpy as np

    top = int(letters.max()) + 1
    counts = np.bincount(letters[wanted], minlength=top) + np.bincount(letters[seeds], minlength=top)
    wide = max(RANGE, 2 * int(np.sqrt(len(letters))))  # few of its own insertions meet a range this wide
    before = np.cumsum(counts) - counts
    big = counts > wide
    range_of = before // wide + np.cumsum(big) + (np.cumsum(big) - big)  # a frequent letter has its own range
    range_of = np.unique(range_of, return_inverse=True)[1]
    first_letter = np.searchsorted(range_of, np.arange(range_of[-1] + 2))
    queue = Queue(range_of, int(range_of[-1]) + 1, spill)
    seed_edges = np.searchsorted(letters[seeds], first_letter)
    floor = np.full(top, -1, dtype=np.int32)  # least prefix swept since the letter's last tuple; -1: no tuple yet
    last = (-2, -1)  # code and place of the tuple swept last
    places, shared = [], []
    for r in range(int(range_of[-1]) + 1):
        own = queue.take(r)
        s = slice(seed_edges[r], seed_edges[r + 1])
        code = np.concatenate([2 * own[0], 2 * letters[seeds[s]].astype(np.int64) + 1])
        place = np.concatenate([own[1], seeds[s]])
        prefix = np.concatenate([own[2], prefixes[s]])
        order = np.argsort(code, kind="stable")
        code, place, prefix = code[order], place[order], prefix[order]
        while len(code):
            n = min(len(code), SWEEP)
            left = place[:n] - 1
            source = np.flatnonzero((left >= 0) & wanted[left])
            to = letters[left[source]].astype(np.int64)
            here = range_of[to] == r
            if here.any():
                bound = np.full(n, n, dtype=np.int64)
                bound[source[here]] = np.searchsorted(code[:n], 2 * to[here], side="right")
                safe = np.minimum.accumulate(bound) > np.arange(n)
                # a tuple may be swept while every earlier one's insertions come after it
                n = n if safe.all() else int(np.argmin(safe))
                some = source < n
                source, to = source[some], to[some]
            kind, letter = code[:n] & 1, code[:n] >> 1
            step = prefix[:n].copy()
            turn = np.flatnonzero(code[1:n] != code[: n - 1]) + 1  # where a letter's tuples, or its seeds, begin
            if code[0] != last[0]:
                turn = np.concatenate([[0], turn])
            if len(turn):
                before_turn = np.where(turn > 0, code[turn - 1], last[0])
                meets = turn[code[turn] - 1 == before_turn * (code[turn] & 1)]
                step[turn] = 0
                if len(meets):
                    step[meets] = np.minimum(runs[place[meets]], runs[np.where(meets > 0, place[meets - 1], last[1])])
            old = kind == 0
            places.append(place[:n][old])
            shared.append(prefix[:n][old])
            last = (int(code[n - 1]), int(place[n - 1]))
            inserted = None
            least, rest = np.int32(step.min()), floor[letter[-1] :]  # no smaller letter comes any more
            if len(source):
                group = np.argsort(to, kind="stable")
                g, d = source[group], to[group]
                opens = np.concatenate([[True], d[1:] != d[:-1]])
                value = np.minimum.accumulate(step)[g]
                value[opens] = np.minimum(value[opens], floor[d[opens]])
                later = np.flatnonzero(~opens)
                if len(later):
                    value[later] = _range_minima(step, g[later - 1] + 1, g[later])
                out = np.empty((3, len(source)), dtype=np.int64)
                out[0], out[1] = to, place[source] - 1
                out[2, group] = np.minimum(value + 1, cap)
                closes = np.concatenate([opens[1:], [True]])
                ends, tails = d[closes], g[closes]
                after = np.concatenate([np.minimum.accumulate(step[::-1])[::-1][1:], [cap]])
                np.minimum(rest, least, out=rest)
                floor[ends] = after[tails]
                mine = range_of[to] == r
                inserted = out[:, mine]
                if not mine.all():
                    queue.insert(out[:, ~mine])
            else:
                np.minimum(rest, least, out=rest)
            code, place, prefix = code[n:], place[n:], prefix[n:]
            if inserted is not None and inserted.shape[1]:
                code = np.concatenate([code, 2 * inserted[0]])
                place = np.concatenate([place, inserted[1]])
                prefix = np.concatenate([prefix, inserted[2]])
                order = np.argsort(code, kind="stable")
                code, place, prefix = code[order], place[order], prefix[order]
    return np.concatenate(places), np.concatenate(shared)


def _names(text, rising, starred):
    """Ranks of the substrings from one starred place to the next, by letters and, of equal ones, falling first."""
    import numpy as np

    bits = (2 * int(text.max()) + 2).bit_length()
    per = max(1, 62 // bits)
    length = np.append(np.diff(starred) + 1, 1)
    rank = np.zeros(len(starred), dtype=np.int64)
    live, offset = np.arange(len(starred)), 0
    while len(live):
        key = np.zeros(len(live), dtype=np.int64)
        for k in range(per):
            at = starred[live] + offset + k
            inside = offset + k < length[live]
            at = np.where(inside, at, 0)
            key = (key << bits) | np.where(inside, 2 * text[at].astype(np.int64) + rising[at] + 1, 0)
        order = np.lexsort((key, rank[live])) if offset else np.argsort(key, kind="stable")
        key, old = key[order], rank[live][order]
        opens = np.concatenate([[True], (key[1:] != key[:-1]) | (old[1:] != old[:-1])])
        group = np.flatnonzero(np.concatenate([[True], old[1:] != old[:-1]]))
        index = np.arange(len(order))
        base = np.repeat(group, np.diff(np.append(group, len(order))))
        start = np.maximum.accumulate(np.where(opens, index, 0))
        new = old + start - base
        rank[live[order]] = new
        size = np.diff(np.append(np.flatnonzero(opens), len(order)))
        alone = np.repeat(size, size) == 1
        offset += per
        live = live[order[~alone]]
        live = live[length[live] > offset]
    return np.unique(rank, return_inverse=True)[1]


def sort_in_memory(names, cap: int):
    """``suffix_order`` of a short text: ranks by 1, 2, 4, ... letters until no two are equal."""
    import numpy as np

    n = len(names)
    rank = names.astype(np.int64)
    ranks, step = [rank], 1
    order = np.argsort(rank, kind="stable")
    start = np.flatnonzero(np.concatenate([[True], rank[order][1:] != rank[order][:-1]]))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.repeat(start, np.diff(np.append(start, n)))  # the first place of the equal ones
    place = order
    while True:
        size = np.bincount(rank, minlength=n)
        live = np.flatnonzero(size[rank[place]] > 1)  # places not settled yet
        if not len(live):
            break
        own = place[live]
        after = own + step
        key = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        sort = np.lexsort((key, rank[own]))
        own, key = own[sort], key[sort]
        place[live] = own
        opens = np.concatenate([[True], (key[1:] != key[:-1]) | (rank[own][1:] != rank[own][:-1])])
        first = np.repeat(live[opens], np.diff(np.append(np.flatnonzero(opens), len(own))))
        rank = rank.copy()
        rank[own] = first
        ranks.append(rank)
        step *= 2
    a, b = place[:-1], place[1:]
    shared = np.zeros(n - 1, dtype=np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        x, y = a + shared, b + shared
        inside = np.maximum(x, y) < n
        same = inside & (ranks[k][np.minimum(x, n - 1)] == ranks[k][np.minimum(y, n - 1)])
        shared += np.where(same, 1 << k, 0)
    return place, np.minimum(np.concatenate([[0], shared]), cap)


def suffix_order(text, cap: int, spill: Spill | None = None):
    """Places of all suffixes in order, and the length of the prefix each shares with the one before (at most ``cap``).

    ``text``: whole numbers, of which the last is 0 and the only 0.
    """
    import numpy as np

    spill = spill or Spill()
    n = len(text)
    if n == 1:
        return np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
    change = np.flatnonzero(text[1:] != text[:-1])
    until = np.empty(n, dtype=np.int64)  # the last place of the run of equal letters
    until[: n - 1] = change[np.searchsorted(change, np.arange(n - 1))]
    until[n - 1] = n - 1
    rising = np.zeros(n, dtype=bool)
    rising[:-1] = text[until[:-1] + 1] > text[until[:-1]]
    rising[-1] = True
    runs = np.minimum(until - np.arange(n) + 1, cap)
    starred = np.flatnonzero(rising & np.concatenate([[False], ~rising[:-1]]))
    names = _names(text, rising, starred)
    if names.max() + 1 == len(names):
        order, prefixes = np.argsort(names), np.zeros(len(names), dtype=np.int64)
    elif len(names) <= DIRECT:
        order, prefixes = sort_in_memory(names, cap)
    else:
        order, prefixes = suffix_order(names, cap, spill)
    seeds = starred[order]
    prefixes = _in_letters(text, starred, order, prefixes, cap)
    falling = ~rising
    down, down_shared = induce(text, falling, seeds, prefixes, runs, cap, spill)
    mirrored = int(text.max()) - text
    back = np.concatenate([[0], down_shared[::-1][:-1]])
    up, up_shared = induce(mirrored, rising & (np.arange(n) < n - 1), down[::-1], back, runs, cap, spill)
    up, up_shared = np.append(up, n - 1)[::-1], np.append(up_shared, 0)[::-1]
    up_shared = np.concatenate([[0], up_shared[:-1]])
    places, shared = np.concatenate([down, up]), np.concatenate([down_shared, up_shared])
    merged = np.argsort(2 * text[places].astype(np.int64) + rising[places], kind="stable")
    places, shared = places[merged], shared[merged]
    meets = np.flatnonzero((text[places[1:]] == text[places[:-1]]) & rising[places[1:]] & ~rising[places[:-1]]) + 1
    shared[meets] = np.minimum(runs[places[meets]], runs[places[meets - 1]])
    return places, shared


def _in_letters(text, starred, order, prefixes, cap: int):
    """Shared prefixes of ordered starred suffixes, from equal names to equal letters."""
    import numpy as np

    a, b = order[:-1], order[1:]
    same = prefixes[1:]
    out = np.zeros(len(order), dtype=np.int64)
    known = np.flatnonzero(same < cap)
    length = np.full(len(same), cap, dtype=np.int64)
    start = starred[b[known]]
    u, v = starred[a[known] + same[known]], starred[b[known] + same[known]]
    far = np.minimum(v - start, cap)
    length[known] = far
    live = np.flatnonzero(far < cap)
    while len(live):
        equal = text[u[live]] == text[v[live]]
        live = live[equal]
        u[live] += 1
        v[live] += 1
        length[known[live]] += 1
        live = live[length[known[live]] < cap]
    out[1:] = length
    return out
