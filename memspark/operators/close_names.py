"""Short names at most two edits apart, each pair found once.

Of two names, ``x`` is the one that isn't longer. Behind their common beginning and before their common end lies what
differs; its first and last letters differ. So with two edits one is at its first letter and one at its last, and what
both names keep is ``x`` whole or ``x`` without its first or last letter that differs, unless only two letters are others
at equal places. Names are dealt by a part that the edits must leave alike, and meet within such a group on what is left
of them without up to two letters:

- ``LATE``: all edits are in the last TAIL letters of ``x``. Dealt by what stands before; the other name takes part as one
  that is longer by 0, 1 or 2 letters.
- ``EARLY``: the last TAIL letters are alike. Dealt by these.
- ``BOTH``: one edit before the last TAIL letters of ``x``, one within. The last TAIL letters of both names without one
  letter have something in common. Dealt by each of these.

Rows of a small group are compared with each other, by the letters that they have at all first. Groups of more than
GROUP_KEYS keys are dealt over further buckets by the keys themselves, so none is held by one task. Hashes only bring names
together; letters and places decide, and tell the one group and key of a pair that count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Letters of the end that is looked at apart.
TAIL = 6
#: Keys of a bucket at which it is dealt further, and of a chunk that a task holds.
GROUP_KEYS, CHUNK_KEYS = 500_000, 250_000
#: Pairs compared at once, and rows of which keys are made at once.
PAIRS, ROWS = 200_000, 2048

LATE, EARLY, BOTH = 0, 3, 4  # 1 and 2: LATE, as a name longer by so many letters
#: Rows of a group, by kind, up to which all are compared. In LATE groups most have like letters, so keys pay sooner.
COMPARED = np.array([128, 128, 128, 2048, 2048])
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(64, _BASE))])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _salted(x: np.ndarray, salt: np.ndarray | int) -> np.ndarray:
    return _mixed(x + (np.atleast_1d(salt).astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95))


class Names:
    """Letters of names as a table padded by 0; a letter is its code point and one."""

    def __init__(self, names: pa.Array):
        size = np.diff(np.frombuffer(names.buffers()[1], np.int32, len(names) + 1, names.offset * 4))
        if pc.sum(pc.utf8_length(names)).as_py() == size.sum():
            first = np.frombuffer(names.buffers()[1], np.int32, 1, names.offset * 4)[0]
            flat = np.frombuffer(names.buffers()[2], np.uint8, int(size.sum()), int(first)) + np.uint8(1)
        else:
            texts = [x.decode("utf-8", "surrogateescape") for x in names.cast(pa.binary()).to_pylist()]
            size = np.array([len(x) for x in texts])
            flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32) + np.uint32(1)
        self.n = size.astype(np.int64)
        width = -(-(int(self.n.max()) + 2) // 8) * 8
        self.letters = np.zeros((len(self.n), width), flat.dtype)
        self.letters[np.arange(width) < self.n[:, None]] = flat

    def some(self, rows: np.ndarray) -> Names:
        out = object.__new__(Names)
        out.letters, out.n = self.letters[rows], self.n[rows]
        return out

    def backwards(self) -> np.ndarray:
        at = self.n[:, None] - 1 - np.arange(self.letters.shape[1])
        return np.where(at >= 0, np.take_along_axis(self.letters, np.maximum(at, 0), 1), 0)

    def runs(self) -> np.ndarray:
        """Number of the run of equal letters at each place."""
        return np.concatenate([np.zeros((len(self.n), 1), np.int8), np.cumsum(self.letters[:, 1:] != self.letters[:, :-1], 1, np.int8)], 1)


def _beginnings(letters: np.ndarray) -> np.ndarray:
    """Hash of the first k letters, for every k."""
    value = _mixed(letters.astype(np.uint64))
    out = np.zeros((len(letters), letters.shape[1] + 1), np.uint64)
    for k in range(letters.shape[1]):
        out[:, k + 1] = out[:, k] * _BASE + value[:, k]
    return out


def _without(begun: np.ndarray, row: np.ndarray, end: np.ndarray, *gone: np.ndarray) -> np.ndarray:
    """Hash of the first ``end`` letters without those at the places ``gone``, which ascend."""
    out, start = 0, 0
    for g in (*gone, end):
        keep = _POWERS[g - start]
        out = out * keep + begun[row, g] - begun[row, start] * keep
        start = g + 1
    return out


def _one(letters: np.ndarray, row: np.ndarray, low: np.ndarray, high: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, place): a letter of a region goes; of equal ones in a row the last, so that what is left differs."""
    step = np.arange(width)
    i = low[:, None] + step
    inside = i < high[:, None]
    here, after = np.take_along_axis(letters[row], np.minimum(i, letters.shape[1] - 1), 1), np.take_along_axis(letters[row], np.minimum(i + 1, letters.shape[1] - 1), 1)
    r, k = np.nonzero(inside & ((i + 1 >= high[:, None]) | (here != after)))
    return r, i[r, k]


def _two(low: np.ndarray, high: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, place): all two places of a region."""
    a, b = np.triu_indices(width, 1)
    r, k = np.nonzero(b < (high - low)[:, None])
    return r, low[r] + a[k], low[r] + b[k]


def _distinct(letters: np.ndarray, row: np.ndarray, i: np.ndarray, j: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Of the two letters that go, whether what is left isn't had by letters further back as well."""
    x, y, z = letters[row, i], letters[row, j], letters[row, np.minimum(j + 1, letters.shape[1] - 1)]
    return ((j + 1 >= high) | (y != z)) & np.where(j > i + 1, x != letters[row, i + 1], (j + 1 >= high) | (x != z))


def keys(names: Names, kind: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """What is left of the names of rows: (hash, row, whether it asks others, gone and places as one number).

    Hashes of two places tell the places too, for names in which two letters are others; the rest tell only what is left.
    """
    letters, n = names.letters, names.n
    begun, every = _beginnings(letters), np.arange(len(n))
    front = np.maximum(n - TAIL, 0)
    out: list[tuple[np.ndarray, ...]] = []

    def add(left: np.ndarray, row: np.ndarray, asks: np.ndarray | bool, gone: int, i: np.ndarray | int = 0, j: np.ndarray | int = 0, places: bool = False) -> None:
        # Names that are longer take part as if as long as those which they are compared with.
        salt = np.where(kind[row] < EARLY, 8 * (n[row] - kind[row]), kind[row]) + (512 * (1 + i * 64 + j) if places else 0)
        out.append((_salted(left, salt), row, np.full(len(row), asks), np.broadcast_to(np.asarray((gone + 8 * places) << 12 | i << 6 | j, np.int32), row.shape)))

    def all_of(row: np.ndarray, low: np.ndarray, high: np.ndarray, whole: bool, one: bool, two: bool, places: bool, asks: bool) -> None:
        """Keys of a region of rows."""
        if not len(row):
            return
        width = int((high - low).max())
        if whole:
            add(_without(begun, row, n[row]), row, asks, 0)
        if one:
            r, i = _one(letters, row, low, high, width)
            add(_without(begun, row[r], n[row[r]], i), row[r], asks, 1, i)
        if two or places:
            r, i, j = _two(low, high, width)
            left = _without(begun, row[r], n[row[r]], i, j)
            if places:
                add(left, row[r], True, 2, i, j, True)
            if two:
                d = np.nonzero(_distinct(letters, row[r], i, j, high[r]))[0]
                add(left[d], row[r[d]], False, 2, i[d], j[d])

    for longer in range(3):
        row = every[kind == LATE + longer]
        all_of(row, np.maximum(n[row] - TAIL - longer, 0), n[row], longer == 0, longer < 2, longer > 0, longer == 0, longer == 0)
    row = every[kind == EARLY]
    all_of(row, np.zeros_like(row), front[row], True, True, True, True, True)
    row = every[kind == BOTH]
    if len(row):
        tail, low = front[row] + at[row], np.zeros_like(row)
        width = int(front[row].max())
        add(_without(begun, row, n[row], tail), row, True, 1, tail)
        r, i = _one(letters, row, low, front[row], width)
        add(_without(begun, row[r], n[row[r]], i, tail[r]), row[r], False, 2, i, tail[r])
        r, i = np.nonzero(np.arange(width) < front[row][:, None])
        run = names.runs()[row]
        for back in range(TAIL):
            # A letter of the run goes as well as its last one, but the place is another.
            j = tail[r] - back
            ok = np.nonzero((j >= front[row[r]]) & (run[r, np.maximum(j, 0)] == run[r, tail[r]]))[0]
            if len(ok):
                a, b, c = row[r[ok]], i[ok], j[ok]
                add(_without(begun, a, n[a], b, c), a, True, 2, b, c, True)
        # The end as it is, with all letters of it: it is what the first letter of the last TAIL leaves.
        row = row[run[np.arange(len(row)), front[row]] == run[np.arange(len(row)), tail]]
        if len(row):
            add(_without(begun, row, n[row]), row, True, 0)
            r, i = _one(letters, row, np.zeros_like(row), front[row] + 1, width + 1)
            inner = i < front[row[r]]
            r, i = r[inner], i[inner]
            add(_without(begun, row[r], n[row[r]], i), row[r], True, 1, i)
    return tuple(np.concatenate(x) for x in zip(*out))


def route(schema: pa.Schema, counted: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows ``(seed, scope, key, rep)`` -> one for each group of a name: ``(g, weight)`` if only counted, else all of ``schema``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            names = Names(batch.column("key"))
            n, begun = names.n, _beginnings(names.letters)
            seed = batch.column("seed").to_numpy().view(np.uint64)
            every, front = np.arange(len(n)), np.maximum(n - TAIL, 0)
            parts = []
            for longer in range(3):
                row = every[n > longer]
                low = np.maximum(n[row] - TAIL - longer, 0)
                k = np.minimum(n[row], TAIL + longer)
                parts.append((_salted(begun[row, low], (n[row] - longer) * 8 + LATE), row, LATE + longer, 0 * row, 1 + k + k * (k - 1) // 2))
            row = every[n > TAIL]
            end = begun[row, n[row]] - begun[row, front[row]] * _POWERS[TAIL]
            parts.append((_salted(end, EARLY), row, EARLY, 0 * row, 1 + front[row] + front[row] * (front[row] - 1)))
            r, i = _one(names.letters, row, front[row], n[row], TAIL) if len(row) else (row, row)
            row = row[r]
            low = front[row]
            end = _without(begun, row, n[row], i) - begun[row, low] * _POWERS[TAIL - 1]
            parts.append((_salted(end, BOTH), row, BOTH, i - low, 2 + 3 * low))
            row = np.concatenate([x[1] for x in parts])
            g = pa.array(_mixed(np.concatenate([x[0] for x in parts]) ^ seed[row]).view(np.int64))
            weight = pa.array(np.concatenate([x[4] for x in parts]))
            if counted:
                yield pa.RecordBatch.from_arrays([g, weight], schema=schema)
                continue
            kind, at = np.concatenate([np.full(len(x[1]), x[2], np.int32) for x in parts]), np.concatenate([x[3] for x in parts])
            taken = batch.select(["scope", "key", "rep"]).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([g, weight, pa.array(kind * 8 + at, pa.int32()), *taken.columns], schema=schema)

    return run


def deal(schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of groups with ``parts`` go once to each part that some key of theirs has; ``g`` and ``part`` tell which."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column("parts").to_numpy()
            row, part = np.nonzero(parts == 1)[0], np.zeros(int((parts == 1).sum()), np.int64)
            dealt = np.nonzero(parts > 1)[0]
            for low in range(0, len(dealt), ROWS):
                many = dealt[low : low + ROWS]
                asked = batch.take(pa.array(many))
                what = asked.column("what").to_numpy()
                h, r, *_ = keys(Names(asked.column("key")), what // 8, what % 8)
                own = np.unique(r * (1 << 32) + _part(h, parts[many][r]))
                row, part = np.concatenate([row, many[own >> 32]]), np.concatenate([part, own & ((1 << 32) - 1)])
            taken = batch.take(pa.array(row))
            g = _salted(taken.column("g").to_numpy().view(np.uint64), part).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(part, pa.int32()), *(taken.column(c) for c in ("parts", "weight", "what", "scope", "key", "rep"))], schema=schema)

    return run


def _part(h: np.ndarray, parts: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(20)) % parts.astype(np.uint64)).astype(np.int64)


def meet(schema: pa.Schema, max_dist: int, head: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows sorted by ``g`` -> pairs ``(rep, rep2, dist)``. Whole buckets are held until they have enough keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        weight = 0.0
        for batch in batches:
            g = batch.column("g").to_numpy()
            cost = np.cumsum(batch.column("weight").to_numpy() / batch.column("parts").to_numpy())
            ends = np.append(np.nonzero(g[1:] != g[:-1])[0] + 1, len(g)) if len(g) else g
            start, done = 0, 0.0
            if held and len(g) and held[-1].column("g")[-1].as_py() != g[0]:
                ends = np.insert(ends, 0, 0)
            # The last bucket may go on in the next batch.
            for end in ends[:-1]:
                spent = cost[end - 1] if end else 0.0
                if weight + spent - done >= CHUNK_KEYS:
                    yield from _pairs([*held, batch.slice(start, end - start)], schema, max_dist, head)
                    held, weight, start, done = [], 0.0, int(end), spent
            if len(g):
                held.append(batch.slice(start))
                weight += cost[-1] - done
        yield from _pairs(held, schema, max_dist, head)

    return run


def _pairs(held: list[pa.RecordBatch], schema: pa.Schema, max_dist: int, head: int) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(held).combine_chunks() if held else None
    if table is None or not table.num_rows:
        return
    column = lambda c: table.column(c).chunk(0)
    names, rep = Names(column("key")), column("rep")
    g, what, parts, part = (column(c).to_numpy() for c in ("g", "what", "parts", "part"))
    kind, scope = what // 8, column("scope").dictionary_encode().indices.to_numpy()
    judge = Judge(names, kind, what % 8, scope, head)
    order = np.lexsort((kind, g))
    end = _ends(g[order])
    size = end - np.searchsorted(end, end)
    few = (parts[order] == 1) & (size <= COMPARED[kind[order]])
    for x, y, dist in (*_all_pairs(judge, order, end, few), *_key_pairs(judge, order[~few], parts, part)):
        near = dist <= max_dist
        if near.any():
            yield pa.RecordBatch.from_arrays([rep.take(pa.array(x[near])), rep.take(pa.array(y[near])), pa.array(dist[near], pa.int32())], schema=schema)


def _ends(values: np.ndarray) -> np.ndarray:
    """Where the run of equal values ends, for each of sorted values."""
    start = np.append(True, values[1:] != values[:-1])[: len(values)]
    return np.append(np.nonzero(start)[0][1:], len(values))[np.cumsum(start) - 1]


Pairs = Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]


def _all_pairs(judge: Judge, order: np.ndarray, end: np.ndarray, few: np.ndarray) -> Pairs:
    """Pairs of the rows of small groups, which stand together; those that are LATE as longer ones come last and ask none."""
    kind = judge.kind[order]
    asking = np.nonzero(few & (kind != LATE + 1) & (kind != LATE + 2) & (end - np.arange(len(order)) > 1))[0]
    letters, n = judge.sets[order], judge.n[order]
    stop, step, waiting, held = end[asking], 0, [], 0
    while len(asking):
        step += 1
        # An edit takes one letter away and brings one at most.
        near = (np.bitwise_count(letters[asking] ^ letters[asking + step]) <= 4) & (np.abs(n[asking] - n[asking + step]) <= 2)
        found = asking[near]
        waiting.append((order[found], order[found + step]))
        held += len(found)
        on = asking + step + 1 < stop
        asking, stop = asking[on], stop[on]
        if held >= PAIRS or not len(asking):
            x, y = (np.concatenate(z) for z in zip(*waiting))
            waiting, held = [], 0
            for low in range(0, len(x), PAIRS):
                yield judge.alone(x[low : low + PAIRS], y[low : low + PAIRS])


def _key_pairs(judge: Judge, rows: np.ndarray, parts: np.ndarray, part: np.ndarray) -> Pairs:
    """Pairs of rows that share a key."""
    found = []
    for low in range(0, len(rows), ROWS):
        some = rows[low : low + ROWS]
        h, row, asks, tag = keys(judge.names.some(some), judge.kind[some], judge.at[some])
        row = some[row]
        if (parts[some] > 1).any():
            own = np.nonzero(_part(h, parts[row]) == part[row])[0]
            h, row, asks, tag = h[own], row[own], asks[own], tag[own]
        found.append(((_salted(h, judge.scope[row]) & ~np.uint64(1)) | (~asks).astype(np.uint64), row.astype(np.int64) << 20 | tag))
    if not found:
        return
    h, tag = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(h)
    h = h[order]
    end = _ends(h >> np.uint64(1))
    # Those that ask stand before those that don't.
    later = np.where((h & np.uint64(1)) == 0, end - 1 - np.arange(len(h)), 0)
    asking = np.nonzero(later)[0]
    upto = np.cumsum(later[asking])
    total = int(upto[-1]) if len(upto) else 0
    for done in range(0, total, PAIRS):
        pair = np.arange(done, min(done + PAIRS, total))
        k = np.searchsorted(upto, pair, "right")
        a = asking[k]
        yield judge.by_key(tag[order[a]], tag[order[end[a] - (upto[k] - pair)]])


def _bits(flags: np.ndarray) -> np.ndarray:
    """The flags of each row as one number."""
    out = np.zeros((len(flags), 8), np.uint8)
    packed = np.packbits(flags, 1, "little")
    out[:, : packed.shape[1]] = packed
    return out.view(np.uint64)[:, 0]


def _first(bits: np.ndarray) -> np.ndarray:
    """Place of the first flag that is set; 0 if none is."""
    return np.where(bits > 0, np.bitwise_count((bits & (~bits + np.uint64(1))) - np.uint64(1)), 0).astype(np.int64)


def _alike(differ: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Whether no flag from ``low`` to before ``high`` is set."""
    one = np.uint64(1)
    upto = lambda k: (one << np.maximum(k, 0).astype(np.uint64)) - one
    return (differ & upto(high) & ~upto(low)) == 0


class Judge:
    """The edits between names that met, if this group and key are the ones that count."""

    def __init__(self, names: Names, kind: np.ndarray, at: np.ndarray, scope: np.ndarray, head: int):
        self.names, self.kind, self.at, self.scope, self.head = names, kind, at, scope, head
        self.letters, self.n, self.back, self.runs = names.letters, names.n, names.backwards(), names.runs()
        bits = np.where(self.letters > 0, np.uint64(1) << (self.letters % 64).astype(np.uint64), np.uint64(0))
        self.sets = np.bitwise_or.reduce(bits, 1)

    def _edits(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
        """For x not longer than y: (which pairs are right, their edits, place in x without which x is what both keep, place of x's
        last letter that differs).

        The place without which x is kept is -1 if that is x whole, and -3 if two letters are others at equal places.
        """
        nx, more = self.n[x], self.n[y] - self.n[x]
        lx, ly = self.letters[x], self.letters[y]
        differ = _bits(lx != ly)
        p = _first(differ)
        s = np.minimum(_first(_bits(self.back[x] != self.back[y])), nx - p)
        own = np.where(p >= nx - TAIL, LATE, np.where(s >= TAIL, EARLY, BOTH))
        ok = np.nonzero((self.kind[x] == own) & (self.scope[x] == self.scope[y]) & (p >= self.head) & (more <= 2))[0]
        nx, more, lx, ly, differ, p, s = (z[ok] for z in (nx, more, lx, ly, differ, p, s))
        last = nx - s - 1
        others = np.bitwise_count(differ)
        # x ahead of y by one place, and y ahead of x: alike from p on, up to the last letter that differs.
        behind = _bits(lx[:, :-1] != ly[:, 1:])
        left, right = _alike(_bits(lx[:, 1:] != ly[:, :-1]), p, last), _alike(behind, p, last)
        every = np.arange(len(ok))
        # Of two ways for names of one length, that counts which takes the letter p of the smaller name.
        smaller = lx[every, p] < ly[every, p]
        keeps = np.select(
            [(more == 0) & (others == 1), (more == 0) & (others == 2), (more == 0) & (others > 2), more == 1, more == 2],
            [
                p,
                -3,
                np.where(left & (smaller | ~right), p, np.where(right, last, -2)),
                np.where(last < p, -1, np.where(right, last, np.where(_alike(differ, p + 1, last + 1), p, -2))),
                np.where(_alike(behind, p, last + 1), -1, -2),
            ],
            -2,
        )
        one = (more == 0) & (others == 1) | (more == 1) & (last < p)
        right = keeps != -2
        return ok[right], np.where(one, 1, 2)[right], keeps[right], last[right]

    def alone(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of rows of a group."""
        turned = self.n[x] > self.n[y]
        x, y = np.where(turned, y, x), np.where(turned, x, y)
        ok, dist, keeps, last = self._edits(x, y)
        x, y = x[ok], y[ok]
        # BOTH: the group is that of what both ends keep.
        front = np.maximum(self.n[x] - TAIL, 0)
        gone = np.where((keeps == -3) | (keeps == last), np.maximum(last, front), front)
        ok = (self.kind[x] != BOTH) | (self.runs[x, np.minimum(front + self.at[x], self.n[x])] == self.runs[x, gone])
        return x[ok], y[ok], dist[ok]

    def by_key(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of keys that are equal, each a number of row, gone and places."""
        places = (a >> 15 & 1) > 0
        a2, b2 = a[places], b[places]
        x2, y2, i, j = a2 >> 20, b2 >> 20, a2 >> 6 & 63, a2 & 63
        ok = (self.letters[x2, i] != self.letters[y2, i]) & (self.letters[x2, j] != self.letters[y2, j]) & (i >= self.head)
        x2, y2 = x2[ok], y2[ok]
        ok = (np.bitwise_count((self.letters[x2] != self.letters[y2]).view(np.uint64)).sum(1) == 2) & (self.scope[x2] == self.scope[y2])
        x2, y2 = x2[ok], y2[ok]

        a, b = a[~places], b[~places]
        turned = self.n[a >> 20] > self.n[b >> 20]
        a, b = np.where(turned, b, a), np.where(turned, a, b)
        ok, dist, keeps, _ = self._edits(a >> 20, b >> 20)
        a, x, y = a[ok], a[ok] >> 20, b[ok] >> 20
        gone = a >> 12 & 7
        same = (gone == 1) & (self.runs[x, np.maximum(keeps, 0)] == self.runs[x, a >> 6 & 63])
        ok = (keeps > -2) & np.where(keeps < 0, gone == 0, same)
        return np.concatenate([x2, x[ok]]), np.concatenate([y2, y[ok]]), np.concatenate([np.full(len(x2), 2), dist[ok]])
