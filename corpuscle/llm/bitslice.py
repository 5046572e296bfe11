"""Many set distances at once on bit planes that lie vertically.

A set is sketched as W bits: bit h(x) mod W is set for each element x. Where two sketches differ, an element of
the symmetric difference put the bit there, so the distance of two sketches never exceeds that of the sets: a pair
whose sketches are farther apart than the radius of its sets can be dropped without loss.

Rows stand in tiles of 64. Plane b of a tile is one word with bit b of all its rows, inverted. A row is compared
with the 64 rows of a tile by adding the planes of its own set bits, those first that few rows of the group have: carry-save
adders count for all 64 pairs together how many of its bits the other lacks, which with the numbers of bits of both
gives the distance. A counter begins so far below 256 as bits may be lacking at most, so its ninth plane tells the
pairs beyond their radius, and a row and a tile are abandoned as soon as all their pairs are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WIDTH = 256
_COUNTER = 9
#: Planes added between two looks whether rows and tiles can be abandoned, and rows and tiles compared at once: their words stay in the cache.
_STEP, _AT_ONCE = 16, 16384


class _Adder:
    """Counts, one for each bit of the words of an array, as nine planes of bits; adds sixteen planes in place."""

    def __init__(self, start: np.ndarray):
        self.c = [np.where((start >> k) & 1, ~np.uint64(0), np.uint64(0)) for k in range(_COUNTER)]
        self.u, self.t = np.empty_like(self.c[0]), np.empty_like(self.c[0])

    def csa(self, k: int, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Adds b and c to plane k; the carry is left in c."""
        a, u, t = self.c[k], self.u, self.t
        np.bitwise_xor(a, b, out=u)
        np.bitwise_and(a, b, out=t)
        np.bitwise_xor(u, c, out=a)
        np.bitwise_and(u, c, out=c)
        np.bitwise_or(c, t, out=c)
        return c

    def add16(self, x: list[np.ndarray]) -> None:
        k, x = 0, [*x]
        while len(x) > 1:
            x = [self.csa(k, x[i], x[i + 1]) for i in range(0, len(x), 2)]
            k += 1
        carry, t, u = x[0], self.t, self.u
        for a in self.c[k:]:
            np.bitwise_and(a, carry, out=t)
            np.bitwise_xor(a, carry, out=a)
            carry, t, u = t, u, t

    def keep(self, which: np.ndarray) -> None:
        self.c = [x[which] for x in self.c]
        self.u, self.t = np.empty_like(self.c[0]), np.empty_like(self.c[0])


def _placed(lengths: np.ndarray) -> np.ndarray:
    """Where each group begins: it goes on in the tile where the last one ended only if all of it fits there, so that
    small groups never span tiles and large ones begin with one."""
    begins, free = np.empty(len(lengths), np.int64), 0
    for g, n in enumerate(lengths.tolist()):
        room = -free % 64
        if n > room:
            free += room
        begins[g] = free
        free += n
    return begins


def _bounds(run: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.nonzero(np.diff(run))[0] + 1, [len(run)]])


def _partners(group: np.ndarray, side: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the first and the end of the later rows that it is to be compared with, which follow one another as
    rows are sorted by group, part and side, side 3 before 2."""
    at, n = np.arange(len(group)), np.bincount(group)
    ends = np.cumsum(n)
    code = (group * 3 + part) * 4 + np.array([0, 0, 2, 1])[side]
    start = lambda p, s: np.searchsorted(code, (group * 3 + p) * 4 + s)
    other = np.where(part == 1, 2, part)
    lo = np.where(side == 1, start(other, 1), np.where(part == 1, start(2, 0), at + 1))
    hi = np.where(side == 2, np.where(part == 1, start(2, 2), at), ends[group])
    return lo, np.where(part == 2, lo, hi)


def close_pairs(group: np.ndarray, size: np.ndarray, side: np.ndarray, sketch: np.ndarray, part: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers (i, j) of the pairs within one group that may have a similarity of at least 0.6, each once.

    ``group`` numbers the groups from 0 on. ``side`` holds two bits: a pair is wanted if one row has the first and
    the other the second. Rows of a ``part`` 1 or 2 are compared with those of the other part of their group only.
    Sets of m and n elements are alike if their difference has at most (m + n) / 4 elements, and then the smaller has
    at least 0.6 of the larger.
    """
    if len(group) < 2:
        return
    part = np.zeros(len(group), np.int64) if part is None else part.astype(np.int64)
    ones = np.bitwise_count(sketch).sum(1, dtype=np.int64)
    # 8 lacking bits count as size + 4 ones of the one and size - 4 ones of the other allow: fewest if the one has few ones, so those come first
    given, taken = size + 4 * ones, size - 4 * ones
    row = np.lexsort((-taken, np.array([0, 0, 2, 1])[side], part, group))
    group, size, side, part, sketch, given, taken = (x[row] for x in (group, size, side, part, sketch, given, taken))
    lo, hi = _partners(group, side, part)
    first = _bounds(group)
    shift = np.repeat(_placed(np.diff(first)) - first[:-1], np.diff(first))
    place = np.arange(len(row)) + shift
    tiles = int(place[-1]) // 64 + 1
    lane = np.full(tiles * 64, -1, np.int64)
    lane[place] = np.arange(len(row))
    planes = _planes(sketch, place, tiles)
    tile = place // 64
    begins = np.searchsorted(tile, np.arange(tiles))
    own = _own_bits(sketch, ones[row], planes, begins, _bounds(group[begins]))
    planes = planes.reshape(-1)
    # a tile may hold rows of several groups; what a row can meet in it are those of its own
    shares = _bounds(tile + group)[:-1]
    least, most, allowed = np.minimum.reduceat(size, shares), np.maximum.reduceat(size, shares), np.maximum.reduceat(taken, shares)
    ahead = (np.searchsorted(shares, first[:-1]) - tile[first[:-1]])[group]
    n_tiles = np.where(lo < hi, (hi - 1 + shift) // 64 - (lo + shift) // 64 + 1, 0)
    done = np.concatenate([[0], np.cumsum(n_tiles)])
    buffers, at = np.empty((_STEP, _AT_ONCE + int(n_tiles.max())), np.uint64), 0
    while at < len(row):
        end = max(at + 1, int(np.searchsorted(done, done[at] + _AT_ONCE, "right")) - 1)
        n = n_tiles[at:end]
        x = np.repeat(np.arange(at, end), n)
        y = np.arange(len(x)) - np.repeat(done[at:end] - done[at], n) + (lo[x] + shift[x]) // 64
        met = y + ahead[x]
        lacking = (given[x] + allowed[met]) // 8
        near = (most[met] >= 0.6 * size[x] - 1e-9) & (size[x] >= 0.6 * least[met] - 1e-9) & (lacking >= 0)
        for i, j in _compared(x[near], y[near], np.minimum(lacking[near], 255), lo + shift, hi + shift, own, planes, tiles, buffers):
            yield row[i], row[lane[j]]
        at = end


def _planes(sketch: np.ndarray, place: np.ndarray, tiles: int) -> np.ndarray:
    """The inverted bits as planes by tiles, and a last plane of zeros: squares of 64 rows and 64 bits are transposed by
    swapping halves, quarters and so on."""
    rows = np.zeros((tiles * 64, WIDTH // 64), np.uint64)
    rows[place] = np.ascontiguousarray(sketch).view(np.uint64)
    square = np.ascontiguousarray(rows.reshape(tiles, 64, WIDTH // 64).transpose(1, 0, 2)).reshape(64, -1)
    for half in (32, 16, 8, 4, 2, 1):
        low = np.uint64(sum(((1 << half) - 1) << k for k in range(0, 64, 2 * half)))
        top, end = (square.reshape(32 // half, 2, half, -1)[:, k] for k in range(2))
        swapped = ((top >> np.uint64(half)) ^ end) & low
        end ^= swapped
        top ^= swapped << np.uint64(half)
    planes = np.zeros((WIDTH + 1, tiles), np.uint64)
    np.invert(square.reshape(64, tiles, WIDTH // 64).transpose(2, 0, 1), out=planes[:WIDTH].reshape(WIDTH // 64, 64, tiles))
    return planes


def _own_bits(sketch: np.ndarray, ones: np.ndarray, planes: np.ndarray, begins: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """The set bits of each row in steps, those first that the fewest rows of its run of tiles have; after its last bit a
    row meets the plane in which nothing is lacking."""
    lacking = np.add.reduceat(np.bitwise_count(planes[:WIDTH]), runs[:-1], axis=1, dtype=np.int64)
    rare = np.argsort(-lacking, axis=0, kind="stable").T.astype(np.uint16)
    bits = np.unpackbits(sketch, axis=1, bitorder="little")
    ends = np.append(begins, len(sketch))[runs]
    held = [order[np.flatnonzero(bits[i:j].take(order, axis=1).view(bool)) & (WIDTH - 1)] for order, i, j in zip(rare, ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    steps = -(-int(ones.max()) // _STEP)
    own = np.full((len(sketch), steps * _STEP), WIDTH, np.uint16)
    own[np.arange(steps * _STEP) < ones[:, None]] = np.concatenate(held)
    return own.reshape(len(sketch), steps, _STEP)


def _below(n: np.ndarray) -> np.ndarray:
    """Words whose lowest n bits are set, n from 0 to 64."""
    return np.where(n >= 64, ~np.uint64(0), (np.uint64(1) << np.minimum(n, 63).astype(np.uint64)) - np.uint64(1))


def _compared(x, y, lacking, lo, hi, own, planes, tiles, room):
    wanted = _below(np.clip(hi[x] - 64 * y, 0, 64)) & ~_below(np.clip(lo[x] - 64 * y, 0, 64))
    counter = _Adder(255 - lacking)
    buffers, index = [*room[:, : len(x)]], np.empty(len(x), np.int64)
    which = a = None
    for step in range(own.shape[1]):
        if not len(x):
            break
        if which is None:
            first = np.concatenate([[True], x[1:] != x[:-1]])
            which, a = np.cumsum(first) - 1, x[first]
        bits = own[a, step]
        if bits.min() == WIDTH:
            break
        for k, b in enumerate(bits.T * np.int64(tiles)):
            b.take(which, out=index, mode="clip")
            np.add(index, y, out=index)
            planes.take(index, out=buffers[k], mode="clip")
        counter.add16(buffers)
        wanted &= ~counter.c[-1]
        live = np.flatnonzero(wanted)
        if len(live) < 0.8 * len(x):
            x, y, wanted, which = x[live], y[live], wanted[live], None
            counter.keep(live)
            buffers, index = [*room[:, : len(x)]], index[: len(x)]
    t = np.flatnonzero(wanted)
    if len(t):
        hit, bit = np.nonzero(np.unpackbits(wanted[t].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        yield x[t[hit]], y[t[hit]] * 64 + bit
